"""Token-set similarity of whole tables of texts, exact, in blocks.

Texts are dealt into blocks of a fixed size and asks into chunks; each block meets each chunk in one task.  A task
holds its block as arrays: letters by class, letters by place, and for every word the texts that hold it.  An ask
first gets an upper bound for every text of fitting length, from the letters both have and the words both share;
the alignment is computed, for many texts at once, only where the bound reaches the floor.  With ``n`` best texts
asked for, texts are taken by falling bound and left as soon as the bound falls below the n-th score.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.functions.similarity import common_subsequence
from aislewise.functions.text import squeeze
from aislewise.session import cut_lineage

PER_BLOCK = 8192  # texts a task holds at once
PER_CHUNK = 1024  # asks a task answers
LEAST_ASKS = 64  # per task, below which more tasks are not worth their copies of the block
CLASSES = 32  # letters are counted by class; more letters than classes only loosen the bound
STEP = 512  # alignments computed at once
MARGIN = 1e-9


def processed(text: Column) -> Column:
    """Lower-case letters and digits; everything else parts words."""
    return squeeze(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", " "))


class Block:
    """Texts as arrays, by rising length.  A text counts as its distinct words, sorted and joined."""

    def __init__(self, texts: list[str], order: np.ndarray):
        words = [sorted(set(t.split())) for t in texts]
        size = np.array([len(" ".join(w)) for w in words], np.int64)
        by = np.lexsort((order, size))
        self.texts = [texts[i] for i in by]
        self.words = [words[i] for i in by]
        self.order, self.size = np.asarray(order)[by], size[by]
        letters = "".join(" ".join(w) for w in self.words)
        flat = np.frombuffer(letters.encode("utf-32-le"), "<u4")
        self.alphabet, codes = np.unique(flat, return_inverse=True)
        ends = np.cumsum(self.size)
        place = np.arange(len(flat)) - np.repeat(ends - self.size, self.size)
        row = np.repeat(np.arange(len(texts)), self.size)
        self.codes = np.full((int(self.size.max(initial=0)), len(texts)), len(self.alphabet), np.int32)
        self.codes[place, row] = codes
        self.counts = np.zeros((CLASSES, len(texts)), np.int32)
        np.add.at(self.counts, (flat % CLASSES, row), 1)
        where: dict[str, list[int]] = {}
        for i, own in enumerate(self.words):
            for w in own:
                where.setdefault(w, []).append(i)
        self.where = {w: np.array(at) for w, at in where.items()}

    def bounds(self, ask: str, words: list[str], floor: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Texts that may reach ``floor``, an upper bound of their scores, and how many words each shares."""
        n = len(self.texts)
        shared, letters = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for w in words:
            if (at := self.where.get(w)) is not None:
                shared[at] += 1
                letters[at] += len(w) + 1
        both = np.zeros(n, np.int64)
        mine = np.bincount(np.frombuffer(ask.encode("utf-32-le"), "<u4") % CLASSES, minlength=CLASSES)
        for k in np.flatnonzero(mine):
            both += np.minimum(self.counts[k], mine[k])
        bound = 200.0 * both / (len(ask) + self.size)
        joined = np.maximum(letters - 1, 0)  # shared words and the spaces between them
        part = 200.0 * joined / (joined + np.minimum(len(ask), self.size))
        bound = np.where(shared > 0, np.maximum(bound, part), bound)
        bound[(shared > 0) & ((shared == len(words)) | (shared == self.n_words))] = 100.0
        at = np.flatnonzero(bound >= floor - MARGIN)
        return at, bound[at], shared[at]

    @property
    def n_words(self) -> np.ndarray:
        if not hasattr(self, "_n_words"):
            self._n_words = np.array([len(w) for w in self.words], np.int64)
        return self._n_words

    def aligned(self, ask: str, at: np.ndarray) -> np.ndarray:
        """Longest common subsequence of the ask with each text, one machine word per text and letter."""
        if len(ask) > 64:
            return np.array([common_subsequence(ask, " ".join(self.words[i])) for i in at], np.int64)
        masks = np.zeros(len(self.alphabet) + 1, np.uint64)
        for i, letter in enumerate(np.frombuffer(ask.encode("utf-32-le"), "<u4")):
            code = np.searchsorted(self.alphabet, letter)
            if code < len(self.alphabet) and self.alphabet[code] == letter:
                masks[code] |= np.uint64(1 << i)
        rows = np.full(len(at), (1 << len(ask)) - 1, np.uint64)
        for codes in self.codes[: int(self.size[at].max(initial=0)), at]:
            hit = rows & masks[codes]
            rows = (rows + hit) | (rows - hit)
        left = rows & np.uint64((1 << len(ask)) - 1)
        return len(ask) - np.bitwise_count(left).astype(np.int64)

    def scores(self, ask: str, words: list[str], at: np.ndarray, shared: np.ndarray) -> np.ndarray:
        out = np.empty(len(at))
        apart = shared == 0
        out[apart] = 200.0 * self.aligned(ask, at[apart]) / (len(ask) + self.size[at[apart]])
        mine = set(words)
        for k in np.flatnonzero(~apart):
            theirs = self.words[at[k]]
            if shared[k] in (len(words), len(theirs)):
                out[k] = 100.0
                continue
            both = len(" ".join(w for w in theirs if w in mine))
            rest = " ".join(w for w in words if w not in theirs)
            other = " ".join(w for w in theirs if w not in mine)
            total = len(ask) + int(self.size[at[k]])
            # Shared words stand first on both sides, so all of them and the space after them are matched.
            out[k] = max(
                200.0 * (both + 1 + common_subsequence(rest, other)) / total,
                200.0 * both / (both + min(len(ask), int(self.size[at[k]]))),
            )
        return out

    def answers(self, text: str, floor: float, n: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Texts scoring ``floor`` or more and their scores; with ``n`` only the best, ties by order."""
        words = sorted(set(text.split()))
        ask = " ".join(words)
        at, bound, shared = self.bounds(ask, words, floor)
        if n is not None:
            by = np.argsort(-bound, kind="stable")
            at, bound, shared = at[by], bound[by], shared[by]
        found = np.empty(0)
        for low in range(0, len(at), STEP):
            if n is not None and len(found) >= n and np.partition(found, -n)[-n] > bound[low] + MARGIN:
                break
            found = np.append(found, self.scores(ask, words, at[low : low + STEP], shared[low : low + STEP]))
        at = at[: len(found)]
        keep = np.flatnonzero(found >= floor)
        if n is not None:
            keep = keep[np.lexsort((self.order[at[keep]], -found[keep]))][:n]
        return at[keep], found[keep]


def _answers(mine: pd.DataFrame, theirs: pd.DataFrame, floor: float, n: int | None) -> pd.DataFrame:
    asks, texts, order, scores = [], [], [np.empty(0, np.int64)], [np.empty(0)]
    block = Block(theirs["b"].tolist(), theirs["ord"].to_numpy(np.int64)) if len(theirs) else None
    for a in mine["a"] if block else ():
        at, found = block.answers(a, floor, n)
        asks += [a] * len(at)
        texts += [block.texts[i] for i in at]
        order.append(block.order[at])
        scores.append(found)
    columns = {"a": pd.Series(asks, dtype=object), "b": pd.Series(texts, dtype=object)}
    return pd.DataFrame(columns | {"ord": np.concatenate(order), "score": np.concatenate(scores)})


def _similar(asks: DataFrame, texts: DataFrame, floor: float, n: int | None, within: str | None) -> DataFrame:
    """(group, a, b, ord, score) of processed asks (a) and texts (b, ord), inside equal groups if there are any."""
    group = F.col(within) if within else F.lit(0)
    asks = cut_lineage(asks.filter("a <> ''").select(group.alias("_g"), "a").distinct())
    texts = texts.filter("b <> ''").groupBy(group.alias("_g"), "b").agg(F.min("ord").cast("long").alias("ord"))
    texts = cut_lineage(texts)
    cores = asks.sparkSession.sparkContext.defaultParallelism

    def dealt(rows: DataFrame, column: str, name: str, parts: Column, least: int) -> tuple[DataFrame, DataFrame]:
        """Rows with their part of the group, and the parts of groups above ``least`` rows: few, as rows / least."""
        many = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > least)
        many = many.select(F.col("_g").alias("_of"), parts.cast("int").alias("_parts"))
        known = rows.join(F.broadcast(many), F.col("_g").eqNullSafe(F.col("_of")), "left")
        return known.withColumn(name, F.pmod(F.xxhash64(column), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_of", "_parts"), many

    def copied(rows: DataFrame, many: DataFrame, name: str) -> DataFrame:
        known = rows.join(F.broadcast(many), F.col("_g").eqNullSafe(F.col("_of")), "left")
        every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))
        return known.withColumn(name, every).drop("_of", "_parts")

    size = F.col("_n")
    blocks, many_blocks = dealt(texts, "b", "_block", F.ceil(size / PER_BLOCK), PER_BLOCK)
    spread = F.least(F.ceil(size / LEAST_ASKS), F.lit(4 * cores))
    chunks, many_chunks = dealt(asks, "a", "_chunk", F.greatest(F.ceil(size / PER_CHUNK), spread), LEAST_ASKS)
    left, right = copied(chunks, many_blocks, "_block"), copied(blocks, many_chunks, "_chunk")
    kind = asks.schema["_g"].dataType.simpleString()

    def run(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        out = _answers(mine, theirs, floor, n)
        out.insert(0, "_g", pd.Series([mine["_g"].iloc[0]] * len(out), dtype=object) if len(out) else pd.Series(dtype=object))
        return out

    keys = ["_g", "_block", "_chunk"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys))
    return hits.applyInPandas(run, f"_g {kind}, a string, b string, ord long, score double")


def token_set_pairs(left: DataFrame, right: DataFrame, floor: float) -> DataFrame:
    """(left text a, right text b, score >= floor) for distinct processed texts; any floor above 0."""
    asks = left.select(processed(F.col("text")).alias("a"))
    texts = right.select(processed(F.col("text")).alias("b"), F.lit(0).alias("ord"))
    return _similar(asks, texts, floor, None, None).select("a", "b", "score")


def token_set_best(asks: DataFrame, texts: DataFrame, floor: float, n: int = 1, within: str | None = None) -> DataFrame:
    """The best ``n`` texts (b, ord) per ask (a) scoring ``floor`` or more, ties by the lowest ord, with their rank.

    Both sides hold processed texts.  ``within`` names a column of both: only equal values meet.
    """
    from aislewise.operators.ordered import top_per_group

    hits = _similar(asks, texts, floor, n, within)
    best = top_per_group(hits, ["_g", "a"], [F.desc("score"), "ord"], n, rank="rank")
    return best.withColumnRenamed("_g", within) if within else best.drop("_g")
