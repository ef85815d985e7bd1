"""Runs of words that repeat with a period, found with a dictionary of basic factors.

A basic factor is a stretch of 2**k words; the dictionary names, for every k, the factors that occur more than
once in their document.  Names of one k come from pairs of names of the k before, so equal names are equal words.

A run of period q is proposed at the k with L = 2**k <= q < 2 * L, from the factor at its first word, which comes
again q words on.  Occurrences of one factor at most L / 2 apart form an arithmetic progression whose step is the
factor's own period; progressions are more than L / 2 apart, so fewer than four others begin within 2 * L.  With
R the stretch of that step around the run's first word and S the one around its repetition (they differ, or q would
not be the smallest period): if R ends within the run's first q words, both ends lie in the run, and q is the
distance of the last members of the two progressions; else R and S overlap by less than a step, so the repetition
is the first member of its progression.  Both distances are proposed, to each of the next four progressions.

Every proposal is extended word by word to both sides with the dictionary, as far as the period holds.  Equal
stretches keep their smallest period.  Documents stand alone: one scan in, one table out, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.functions.numeric import let
from aislewise.llm.common import map_batches, record, slices, utf8

NEXT = 4  # progressions looked at beyond a factor's own
SPACES = r"[\x20\x09-\x0D]+"
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def _shared(keys: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Names of the positions ``at`` by key, where a key occurs twice or more; -1 elsewhere."""
    names = np.full(size, -1, np.int64)
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    new = np.concatenate(([True], s[1:] != s[:-1])) if len(s) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    often = np.bincount(group)[group] > 1 if len(s) else new
    names[at[order[often]]] = group[often]
    return names


@dataclass(frozen=True)
class Factors:
    """The dictionary: ``names[k][i]`` names the 2**k words from i on, -1 where no other stretch is equal."""

    names: list[np.ndarray]

    @classmethod
    def of(cls, words: np.ndarray) -> Factors:
        """``words``: ids, equal only for equal words of one document, with ids of their own between documents."""
        size = len(words)
        level = _shared(words, np.arange(size), size)
        names = []
        while (level >= 0).any():
            names.append(level)
            width = 1 << (len(names) - 1)
            at = np.flatnonzero(level[: size - width] >= 0) if size > width else np.empty(0, np.int64)
            at = at[level[at + width] >= 0]
            level = _shared(level[at] * (level.max() + 1) + level[at + width], at, size)
        return cls(names)

    def _step(self, k: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether the 2**k words from i and from j on are equal; outside the text nothing is."""
        level = self.names[k]
        inside = (np.minimum(i, j) >= 0) & (np.maximum(i, j) < len(level))
        a, b = level[np.where(inside, i, 0)], level[np.where(inside, j, 0)]
        return inside & (a == b) & (a >= 0)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal from i and j on."""
        n = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.names))):
            n += self._step(k, i + n, j + n).astype(np.int64) << k
        return n

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words are equal before i and j."""
        n = np.zeros(len(i), np.int64)
        for k in reversed(range(len(self.names))):
            width = 1 << k
            n += self._step(k, i - n - width, j - n - width).astype(np.int64) << k
        return n

    def proposals(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and periods, L <= period < 2 * L, that factors of L = 2**k words propose."""
        level, width = self.names[k], 1 << k
        at = np.flatnonzero(level >= 0)
        at = at[np.argsort(level[at], kind="stable")]  # by name, then position
        name, n = level[at], len(at)
        same = name[1:] == name[:-1]
        chain = np.concatenate(([0], np.cumsum(~(same & (2 * np.diff(at) <= width)))))
        first = np.flatnonzero(np.concatenate(([True], np.diff(chain) > 0)))
        last = np.concatenate((first[1:], [n])) - 1
        found = []
        for t in range(1, NEXT + 1):
            there = np.minimum(chain + t, len(first) - 1)
            ok = (chain + t < len(first)) & (name[first[there]] == name)
            found.append((at[ok], at[first[there[ok]]] - at[ok]))
            here, beyond = last[: max(0, len(last) - t)], last[t:]
            ok = name[here] == name[beyond]
            found.append((at[here[ok]], at[beyond[ok]] - at[here[ok]]))
        i, d = (np.concatenate(x) for x in zip(*found, strict=True))
        fits = (d >= width) & (d < 2 * width)
        return i[fits], d[fits]

    def runs(self, least: int) -> np.ndarray:
        """(start, end, period) of all runs of ``least`` words and two periods or more, by start, then period."""
        rows = []
        for k in range(len(self.names)):
            i, d = self.proposals(k)
            start = i - self.backward(i, i + d)
            end = i + d + self.forward(i, i + d)
            long = end - start >= np.maximum(least, 2 * d)
            rows.append(np.unique(np.stack((start[long], end[long], d[long]), 1), axis=0))
        rows = np.concatenate(rows) if rows else np.empty((0, 3), np.int64)
        rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
        again = np.concatenate(([False], (rows[1:, :2] == rows[:-1, :2]).all(1))) if len(rows) else np.empty(0, bool)
        rows = rows[~again]
        return rows[np.lexsort((rows[:, 2], rows[:, 0]))]


def document_runs(many: list[list[bytes]], least: int) -> list[np.ndarray]:
    """The runs of each of many documents, given as lists of words."""
    ids: dict[bytes, int] = {}
    flat = [np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words)) for words in many]
    begins = np.cumsum([0] + [len(f) + 1 for f in flat])
    joined = np.empty(begins[-1], np.int64)
    for k, f in enumerate(flat):
        joined[begins[k] : begins[k + 1] - 1] = f + k * (len(ids) + 1)
        joined[begins[k + 1] - 1] = k * (len(ids) + 1) + len(ids)
    rows = Factors.of(joined).runs(least)
    cuts = np.searchsorted(rows[:, 0], begins)
    return [rows[a:b] - np.array([base, base, 0]) for a, b, base in zip(cuts[:-1], cuts[1:], begins[:-1], strict=True)]


def kept_words(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words no run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 1], -1)
    return np.cumsum(change)[:n] == 0


def find_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """Maximal periodic runs of words of every whole text, and the text with each run cut to its first period.

    Words are cut at ASCII white space and compared as bytes.  A run has its smallest period, twice that or more
    words and ``least`` or more, and no neighbouring word continues it; runs stand by start, then period, words
    counted from 0.  ``collapsed`` joins the kept words with one space.  One row per row of ``docs``: repeated rows
    and ids stay apart, null ids stay null; a null, empty or blank text has no word, no run and an empty
    ``collapsed``; an empty table gives no row; further columns of any name are ignored.
    """

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                many = [raw.split() for raw in utf8(batch.column("text"))]
                found = document_runs(many, least)
                kept = [
                    b" ".join(compress(words, kept_words(len(words), runs)) if len(runs) else words)
                    for words, runs in zip(many, found, strict=True)
                ]
                flat = np.concatenate(found) if found else np.empty((0, 3), np.int64)
                fields = [flat[:, 0], flat[:, 1] - flat[:, 0], flat[:, 2]]
                ends = np.cumsum([0] + [len(f) for f in found])
                runs = pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in fields], fields=list(RUN))
                yield record(
                    {
                        "doc_id": (batch.column("doc_id"), pa.int64()),
                        "n_words": ([len(words) for words in many], pa.int64()),
                        "runs": (pa.ListArray.from_arrays(pa.array(ends, pa.int32()), runs), pa.list_(RUN)),
                        "collapsed": (pa.array(kept, pa.binary()).cast(pa.string()), pa.string()),
                    }
                )

    return map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, FOUND)


def with_periods(docs: DataFrame) -> DataFrame:
    """Documents whose id has a checksum that ends in 0 get a periodic end: doc_id and text.

    With h the checksum of the decimal id, g = h div 10 and n words, word i >= a becomes word a + (i - a) mod p,
    a = g mod n, p = 1 + (n - a) div (3 + g mod 8).  All other texts stay as they are.
    """

    def periodic(words: Column, g: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        place = F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: F.when(i < a, i).otherwise(a + (i - a) % p))
        return F.array_join(F.transform(place, lambda i: F.get(words, i.cast("int"))), " ")

    h = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary"))
    words = F.filter(F.split("text", SPACES), lambda w: w != "")
    cut = let(words, lambda w: periodic(w, F.floor(h / 10)))
    text = F.when((h % 10 == 0) & F.col("text").rlike(r"[^\x20\x09-\x0D]"), cut).otherwise(F.col("text"))
    return docs.select("doc_id", text.alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Per row of :func:`find_runs`: the longest run and checksums of all runs and of the collapsed text.

    Of runs of equal length the one with the smallest start counts, then that with the smallest period.
    """
    order = F.transform(
        "runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period"))
    )
    best = F.array_min(order)
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * (-best.less) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
