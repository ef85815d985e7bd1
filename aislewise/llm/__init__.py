"""Training-data operators: media, archives, packing, language, decontamination, token files, dedup, quality."""
