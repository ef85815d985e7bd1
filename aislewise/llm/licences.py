"""Licence scans: notice phrases and identifier tags by Aho-Corasick, licence expressions by shunting-yard.

Texts are read as UTF-8 bytes.  Letters A-Z become small, every run of letters, digits and bytes above 127 is a word,
and words are joined by one space; one automaton then walks over the words of a whole text and reports every phrase
and every tag, overlapping ones included.  A tag is followed by an expression in the original text, which the parser
turns into postfix order and evaluates.  Documents stand alone: one scan in, one table out, no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import map_batches, record, slices, utf8

# The phrases and labels of the contract.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Further notices: phrase, label.
NOTICES = {
    "gnu general public license version 2": "gpl-2",
    "gnu general public license version 3": "gpl-3",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license version 2": "mpl-2",
    "eclipse public license": "epl",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "cc by 4": "cc-by",
    "cc0 1 0 universal": "cc0",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution sharealike": "cc-by-sa",
    "dedicated to the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}

#: Words of a tag; a colon or equals sign and an expression follow it on its line, else it is ordinary text.
TAGS = ("spdx license identifier", "license expression")

#: Label of an identifier, and how freely its works may be reused: 1 as one likes, 0 not at all.
IDENTIFIERS = {
    "mit": ("mit", 1.0),
    "isc": ("isc", 1.0),
    "0bsd": ("bsd", 1.0),
    "bsd-2-clause": ("bsd", 1.0),
    "bsd-3-clause": ("bsd", 1.0),
    "apache-2.0": ("apache-2", 1.0),
    "cc0-1.0": ("cc0", 1.0),
    "unlicense": ("public-domain", 1.0),
    "cc-by-4.0": ("cc-by", 0.9),
    "mpl-2.0": ("mpl-2", 0.7),
    "epl-2.0": ("epl", 0.7),
    "lgpl-2.1": ("lgpl", 0.6),
    "lgpl-3.0": ("lgpl", 0.6),
    "cc-by-sa-4.0": ("cc-by-sa", 0.5),
    "gpl-2.0": ("gpl-2", 0.4),
    "gpl-3.0": ("gpl-3", 0.4),
    "agpl-3.0": ("agpl", 0.3),
    "cc-by-nc-4.0": ("cc-by-nc", 0.2),
    "cc-by-nd-4.0": ("cc-by-nd", 0.1),
}
UNKNOWN = 0.0  # what an identifier without an entry permits
EXCEPTION = 0.2  # what an exception adds
UNREADABLE = "unreadable"

_OPENED = re.compile(rb"[ \t\"']*[:=][ \t\"']*")
_TOKEN = re.compile(rb"[ \t]*(?:([()])|([0-9A-Za-z][0-9A-Za-z.+:-]*))")
_STRENGTH = {"or": 1, "and": 2, "with": 3}


def read_expression(raw: bytes) -> list[str]:
    """The longest licence expression at the start of ``raw``, as tokens in small letters; none if there is none."""
    tokens, depth, whole, operand, at = [], 0, 0, False, 0
    while (m := _TOKEN.match(raw, at)) is not None:
        token = (m[1] or m[2].rstrip(b".:-")).decode().lower()
        if token == "(" and not operand and tokens[-1:] != ["with"]:
            depth += 1
        elif token == ")" and operand and depth:
            depth -= 1
        elif token in _STRENGTH and operand:
            if token == "with" and (tokens[-1] == ")" or tokens[-2:-1] == ["with"]):
                break
            operand = False
        elif token not in _STRENGTH and token not in "()" and not operand:
            operand = True
        else:
            break
        tokens.append(token)
        whole = len(tokens) if operand and not depth else whole
        if m[2] is not None and m[2][-1:] in b".:-":
            break
        at = m.end()
    return tokens[:whole]


def postfix(tokens: list[str]) -> list[str]:
    """A whole expression in postfix order: `with` binds before `and`, `and` before `or`."""
    out, waiting = [], []
    for token in tokens:
        if token == "(":
            waiting.append(token)
        elif token == ")":
            while (top := waiting.pop()) != "(":
                out.append(top)
        elif token in _STRENGTH:
            while waiting and _STRENGTH.get(waiting[-1], 0) >= _STRENGTH[token]:
                out.append(waiting.pop())
            waiting.append(token)
        else:
            out.append(token)
    return out + waiting[::-1]


def identifier(token: str) -> tuple[str, float]:
    """Label and permission of an identifier; later versions and `only` count as the version named."""
    bare = re.sub(r"(\+|-only|-or-later)$", "", token)
    return IDENTIFIERS.get(bare, (bare, UNKNOWN))


def evaluate(tokens: list[str]) -> tuple[set[str], float]:
    """Labels of an expression in postfix order, and what it permits: `and` the less, `or` the more of both sides."""
    stack: list[tuple[set[str], float]] = []
    for token in tokens:
        if token not in _STRENGTH:
            label, permits = identifier(token)
            stack.append(({label}, permits))
            continue
        (right, b), (left, a) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((left, min(1.0, a + EXCEPTION)))
        else:
            stack.append((left | right, min(a, b) if token == "and" else max(a, b)))
    return stack[0]


@dataclass(frozen=True)
class Scanner:
    """Phrases, tags and the automaton over their words."""

    base: tuple[tuple[str, str], ...]
    notices: tuple[tuple[str, str], ...]
    tags: tuple[str, ...]
    automaton: ahocorasick.Automaton = field(compare=False, repr=False)

    @classmethod
    @lru_cache(maxsize=4)
    def of(cls, base: tuple, notices: tuple, tags: tuple) -> Scanner:
        entries: dict[str, list] = {}
        for kind, phrases in (("base", base), ("notice", notices), ("tag", [(t, "") for t in tags])):
            for phrase, label in phrases:
                entries.setdefault(f" {phrase} ", []).append((kind, label, len(phrase.split())))
        automaton = ahocorasick.Automaton()
        for phrase, meant in entries.items():
            automaton.add_word(phrase, (len(phrase), meant))
        automaton.make_automaton()
        return cls(base, notices, tags, automaton)

    def find(self, raw: bytes) -> tuple[int, list[dict]]:
        """Number of words of a text and its findings, by first word, kind and label."""
        flat = np.frombuffer(raw, np.uint8)
        solid = _WORD[flat]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], solid, [False])).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        n = len(starts)
        if not n or not len(self.automaton):
            return n, []
        keep = solid.copy()
        keep[ends[ends < len(flat)]] = True  # one space after each word
        line = np.where(solid, _LOWER[flat], 32)[keep].astype(np.uint8).tobytes().decode("latin-1")
        text = f" {line} "
        first = np.concatenate(([0], np.cumsum(ends - starts + 1)[:-1]))  # in text, of the space before each word
        out = []
        for end, (size, meant) in self.automaton.iter(text):
            word = int(np.searchsorted(first, end - size + 1))
            for kind, label, length in meant:
                found = {"kind": kind, "word": word, "n_words": length, "start": int(starts[word]), "expression": None}
                found |= {"end": int(ends[word + length - 1]), "permits": None, "labels": [label]}
                if kind == "tag":
                    opened = _OPENED.match(raw, found["end"])
                    if opened is None:
                        continue
                    stop = raw.find(b"\n", opened.end())
                    tokens = postfix(read_expression(raw[opened.end() : stop if stop >= 0 else len(raw)]))
                    labels, permits = evaluate(tokens) if tokens else ({UNREADABLE}, None)
                    found |= {"expression": " ".join(tokens) or None, "labels": sorted(labels), "permits": permits}
                out.append(found)
        return n, sorted(out, key=lambda f: (f["word"], f["kind"], f["labels"]))


_BYTES = np.arange(256)
_WORD = (_BYTES > 127) | np.isin(_BYTES, np.frombuffer(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", np.uint8))
_LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)

FINDING = pa.struct(
    [
        ("kind", pa.string()),
        ("word", pa.int64()),
        ("n_words", pa.int64()),
        ("start", pa.int64()),
        ("end", pa.int64()),
        ("labels", pa.list_(pa.string())),
        ("expression", pa.string()),
        ("permits", pa.float64()),
    ]
)
SCAN = (
    "doc_id long, n_words long, findings array<struct<kind: string, word: long, n_words: long, start: long,"
    " end: long, labels: array<string>, expression: string, permits: double>>"
)


def scan_licences(
    docs: DataFrame,
    base: dict[str, str] = BASE_PHRASES,
    notices: dict[str, str] = NOTICES,
    tags: tuple[str, ...] = TAGS,
) -> DataFrame:
    """Every licence phrase and tagged expression of every whole text.

    A finding has its kind (base, notice or tag), first word (from 0) and length in words, first byte and the byte
    after its last, and labels; a tag has its expression in postfix order and what that permits, or the label
    ``unreadable`` and nulls.  Phrases are words of small letters and digits with single spaces.  Overlapping and
    repeated places all count.  One row per row of ``docs``: repeated rows and ids stay apart, null ids stay null;
    null, empty and wordless texts have no word and no finding; an empty table gives no row; further columns of any
    name are ignored.
    """
    asked = tuple(base.items()), tuple(notices.items()), tuple(tags)

    def run(batches):
        scanner = Scanner.of(*asked)
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [scanner.find(raw) for raw in utf8(batch.column("text"))]
                yield record(
                    {
                        "doc_id": (batch.column("doc_id"), pa.int64()),
                        "n_words": ([n for n, _ in found], pa.int64()),
                        "findings": ([f for _, f in found], pa.list_(FINDING)),
                    }
                )

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, SCAN)


#: How sure a finding of each kind makes that the text has a licence.
SURE = {"tag": 0.95, "base": 0.8, "notice": 0.7}


def licence_digests(scanned: DataFrame) -> DataFrame:
    """Per row of :func:`scan_licences`: counts and places of base phrases, labels, permission and score.

    ``permits`` is the least that any readable expression permits, else null.  ``score`` is how sure it is that the
    text has a licence: the surest kind of finding, raised by 0.05 where a second kind agrees, 0 without any.
    """
    base = F.filter("findings", lambda f: f["kind"] == "base")
    readable = F.filter("findings", lambda f: f["permits"].isNotNull())
    def of(kind):
        return F.exists("findings", lambda f: (f["kind"] == kind) & (f["labels"][0] != UNREADABLE))

    has = {kind: of(kind) for kind in SURE}
    kinds = sum((h.cast("int") for h in has.values()), F.lit(0))
    best = F.greatest(*(F.when(h, SURE[k]).otherwise(0.0) for k, h in has.items()))

    def listed(findings):
        return F.array_join(F.array_sort(F.array_distinct(F.flatten(F.transform(findings, lambda f: f["labels"])))), ",")

    return scanned.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda f: f["word"])).alias("first_word"),
        F.array_max(F.transform(base, lambda f: f["word"])).alias("last_word"),
        listed(base).alias("base_labels"),
        listed(F.col("findings")).alias("labels"),
        F.array_min(F.transform(readable, lambda f: f["permits"])).alias("permits"),
        F.least(F.lit(1.0), F.round(best + F.when(kinds > 1, 0.05).otherwise(0.0), 2)).alias("score"),
    )
