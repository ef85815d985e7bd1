"""Token ids of many texts with a tokenizers file, each distinct piece of text encoded once per worker.

A piece starts where the file's own rules always start a new token: before a single space that
follows a character other than white space ("byte" files), or after any white space ("word" files,
which drop it).  So ids of pieces, joined, are the ids of the text.  Pieces not seen yet go to the
library many at a time; a worker keeps up to PIECES of them.  Texts of "byte" files are cut by Arrow,
which also finds a call's distinct pieces and looks them up among up to KEPT of earlier calls.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECES = 900_000
KEPT, KEPT_BYTES = 1_000_000, 32 << 20
_CONTROL = "\x1c\x1d\x1e\x1f\x85"  # white space to Python or to the file's rules, but not to both
_RUNS = [chr(c) + " " for c in (*range(9, 14), 32, 160, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
_JOINED = 200
_GROUPS = 64  # groups of _JOINED pieces that are encoded in one call
_LONG = 400  # longer pieces are encoded alone and not kept


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


class Encoder:
    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True  # their strings in a text are ordinary text
        vocab = self.tok.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocab.values(), default=0) < 1 << 16 else "<u4")
        self.words = any(t.endswith("</w>") for t in vocab)  # a file with word ends drops white space
        self.opens = np.zeros(max(vocab.values(), default=0) + 1, bool)
        for token, i in vocab.items():
            self.opens[i] = token.startswith("Ġ")
        self.mark = self.whole("0").tobytes() if self.words else b""
        self.cache: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        self.kept = pa.array([], pa.large_string())
        self.kept_ids, self.kept_sizes = np.empty(0, self.dtype), np.empty(0, np.int64)

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.dtype)

    def _pieces(self, text: str) -> list[str]:
        if self.words:
            return text.split()
        if any(r in text for r in _RUNS):
            out = re.split(r"(?<=\S)(?= )", text)
            return [out[0], *(p[1:] for p in out[1:])]
        return text.split(" ")

    def _encode_new(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pieces, many joined in one string and cut again by their first tokens."""
        out: dict[str, bytes] = {}
        plain = []
        for p in new:
            if len(p) > _LONG or (self.words and "0" in p):
                out[p] = self.whole(p if self.words else " " + p).tobytes()
            else:
                plain.append(p)
        groups = [plain[i : i + _JOINED] for i in range(0, len(plain), _JOINED)]
        glue = " 0 " if self.words else " "
        lead = "" if self.words else " "
        encoded = self.tok.encode_batch_fast([lead + glue.join(g) for g in groups], add_special_tokens=False)
        for group, e in zip(groups, encoded, strict=True):
            ids = np.array(e.ids, self.dtype)
            if self.words:
                cuts = np.flatnonzero(ids == np.frombuffer(self.mark, self.dtype)[0])
                starts, ends = np.concatenate(([0], cuts + 1)), np.concatenate((cuts, [len(ids)]))
            else:
                starts = np.flatnonzero(self.opens[ids])
                ends = np.concatenate((starts[1:], [len(ids)]))
            if len(starts) != len(group):  # a rule of the file that this cut does not know
                out.update((p, self.whole(lead + p).tobytes()) for p in group)
                continue
            out.update((p, ids[a:b].tobytes()) for p, a, b in zip(group, starts.tolist(), ends.tolist(), strict=True))
        return out

    def encode(self, many: list[str]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``dtype``."""
        if self.words:
            return self._encode_each(many)
        plain = [not any(c in text for c in _CONTROL) and not any(r in text for r in _RUNS) for text in many]
        split = iter(self._encode_split([t for t, p in zip(many, plain, strict=True) if p]))
        each = iter(self._encode_each([t for t, p in zip(many, plain, strict=True) if not p]))
        return [next(split if p else each) for p in plain]

    def _encode_split(self, many: list[str]) -> list[bytes]:
        """Of texts that are cut at every space."""
        cut = [text.partition(" ") for text in many]
        pieces = pc.split_pattern(pa.array([rest if space else None for _, space, rest in cut], pa.large_string()), " ")
        coded = pieces.flatten().dictionary_encode()
        known = pc.index_in(coded.dictionary, self.kept)
        new = known.is_null().to_numpy(zero_copy_only=False)
        fresh = coded.dictionary.filter(pa.array(new))
        fresh_ids, fresh_sizes = self._encode_distinct(fresh)
        ids, sizes = np.concatenate((self.kept_ids, fresh_ids)), np.concatenate((self.kept_sizes, fresh_sizes))
        entry = known.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        entry[new] = len(self.kept) + np.arange(len(fresh))
        room = min(KEPT - len(self.kept), len(fresh))
        if room > 0 and self.kept.nbytes + fresh.nbytes <= KEPT_BYTES:
            self.kept = pa.concat_arrays([self.kept, fresh.slice(0, room)])
            self.kept_sizes = sizes[: len(self.kept)]
            self.kept_ids = ids[: self.kept_sizes.sum()]
        piece = entry[coded.indices.to_numpy(zero_copy_only=False)]
        counts = sizes[piece]
        ends = np.concatenate(([0], np.cumsum(counts)))
        flat = ids[np.repeat((np.cumsum(sizes) - sizes)[piece] - ends[:-1], counts) + np.arange(ends[-1])]
        pieces_of = pc.fill_null(pc.list_value_length(pieces), 0).to_numpy(zero_copy_only=False)
        edges = ends[np.concatenate(([0], np.cumsum(pieces_of)))].tolist()
        return [self._first(c[0]) + flat[a:b].tobytes() for c, a, b in zip(cut, edges, edges[1:], strict=False)]

    def _encode_distinct(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, each after a space, one after the other, and how many each has."""
        edges = np.append(np.arange(0, len(pieces), _JOINED), len(pieces))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pieces), pa.scalar(" ", pa.large_string()))
        ids, sizes = [np.empty(0, self.dtype)], [np.empty(0, np.int64)]
        for g in range(0, len(joined), _GROUPS):
            encoded = self.tok.encode_batch_fast([" " + t for t in joined.slice(g, _GROUPS).to_pylist()], add_special_tokens=False)
            for k, e in enumerate(encoded, g):
                found = np.array(e.ids, self.dtype)
                starts = np.flatnonzero(self.opens[found])
                if len(starts) == edges[k + 1] - edges[k]:
                    ids.append(found)
                    sizes.append(np.diff(starts, append=len(found)))
                else:  # a rule of the file that this cut does not know
                    alone = [self.whole(" " + p) for p in pieces.slice(edges[k], edges[k + 1] - edges[k]).to_pylist()]
                    ids += alone
                    sizes.append(np.array([len(a) for a in alone], np.int64))
        return np.concatenate(ids), np.concatenate(sizes)

    def _first(self, piece: str) -> bytes:
        """Ids of a text's first piece, which no space precedes."""
        if not piece:
            return b""
        head = self.first.get(piece)
        if head is None:
            head = self.whole(piece).tobytes()
            if len(self.first) < PIECES // 10 and len(piece) <= _LONG:
                self.first[piece] = head
        return head

    def _keep(self, fresh: dict[str, bytes]) -> None:
        room = PIECES - len(self.cache)
        if room > 0 and fresh:
            self.cache.update((w, fresh[w]) for w in list(fresh)[:room] if len(w) <= _LONG)

    def _encode_each(self, many: list[str]) -> list[bytes]:
        split: list[list[str] | None] = []
        for text in many:
            split.append(None if any(c in text for c in _CONTROL) else self._pieces(text))
        get = self.cache.get
        found = [None if p is None else list(map(get, p if self.words else p[1:])) for p in split]
        new = set()
        for p, f in zip(split, found, strict=True):
            if f and None in f:
                new.update(w for w, i in zip(p if self.words else p[1:], f, strict=True) if i is None)
        fresh = self._encode_new(list(new)) if new else {}
        out = []
        for text, p, f in zip(many, split, found, strict=True):
            if p is None:
                out.append(self.whole(text).tobytes())
                continue
            if f and None in f:
                f = [fresh[w] if i is None else i for w, i in zip(p if self.words else p[1:], f, strict=True)]
            out.append((b"" if self.words else self._first(p[0])) + b"".join(f))
        self._keep(fresh)
        return out
