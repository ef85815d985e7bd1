"""Repeated byte strings of a threshold length, found by depth-limited ordering of suffixes.

Suffixes are ordered only to the threshold depth, in passes from the most significant digit on, and a
suffix that is alone in its group after a pass is dropped: it starts no repeated string.  So that a pass
does not move every position, suffixes are taken at anchors: positions whose gram has the smallest
fingerprint of a run of RUN positions, where a run of grams is as long as the threshold.  So every string of
the threshold length holds one run, and equal strings have their anchor at the same offset, below RUN.

1. Digit one: the gram at each anchor.  Anchors whose gram occurs once are dropped.
2. Anchors are grouped by it, equal surroundings are counted once, and the next digits are the bytes to the
   right and left that complete the string for each offset.  Groups of two or more are exactly the
   repeated strings.

All strings of one anchor hold the same bytes, so their union is one span, from the largest repeated
offset to the smallest.  A passage that a third of all documents share gives few distinct surroundings;
a group that still has very many is dealt out by its last digits over all tasks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import U64, map_batches, mix, record, release, signed, slices, stored, utf8

RUN = 100  # positions an anchor's gram is the smallest of; depth - RUN + 1 bytes make a gram
CHUNK = 1 << 20  # positions worked at once, so a very long text does not fill a task
NO_ID = -(1 << 63)  # stands for a null id, so that such rows join
_RNG = np.random.default_rng(20011)
TABLES = _RNG.integers(0, 1 << 64, (2, 256), U64)
GROUP_ROWS = 50_000  # distinct surroundings of one core that a task takes at once
BASES = _RNG.integers(0, 1 << 63, 2, U64) * U64(2) + U64(1)


def with_row(docs: DataFrame) -> DataFrame:
    """(doc_id, row, text): ``row`` tells rows of one id apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("row"), text.alias("text")
    )


def fingerprints(raw: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of the ``length`` bytes at each position, by doubling."""
    step = TABLES[which][raw]
    base, out, done = int(BASES[which]), None, 0
    bit, size = 1, 1
    while bit <= length:
        if length & bit:
            if out is None:
                out, done = step, size
            else:
                n = len(raw) - done - size + 1
                out = out[:n] * U64(pow(base, size, 1 << 64)) + step[done : done + n]
                done += size
        bit <<= 1
        if bit <= length:
            n = len(step) - size
            step = step[:n] * U64(pow(base, size, 1 << 64)) + step[size:]
            size *= 2
    return mix(out)


def _running(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (minimum or maximum) of each run of ``width`` values."""
    size = 1
    while 2 * size <= width:
        values = pick(values[:-size], values[size:])
        size *= 2
    return pick(values[: len(values) - (width - size)], values[width - size :]) if size < width else values


def anchors(raw: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions and fingerprints of the anchors of a text; none in a text shorter than ``depth``."""
    places, prints = [], []
    for a in range(0, max(0, len(raw) - depth + RUN), CHUNK):
        low = max(0, a - RUN + 1)
        part = raw[low : a + CHUNK + depth - 1]
        if len(part) < depth:
            continue
        h = fingerprints(part, depth - RUN + 1)
        edge = np.zeros(RUN - 1, U64)
        smallest = np.concatenate((edge, _running(h, RUN, np.minimum), edge))
        at = np.flatnonzero(h == _running(smallest, RUN, np.maximum))  # the smallest of a run that holds it
        at = at[(at + low >= a) & (at + low < a + CHUNK)]
        places.append(at + low)
        prints.append(h[at])
    if not places:
        return np.empty(0, np.int64), np.empty(0, U64)
    return np.concatenate(places), np.concatenate(prints)


def cover(n: int, spans: np.ndarray) -> np.ndarray:
    """Mask of the bytes in any of the (k, 2) spans."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, spans[:, 0], 1)
    np.add.at(edge, spans[:, 1], -1)
    return np.cumsum(edge[:n]) > 0


def _bytes(column: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(r, np.uint8) for r in utf8(column)]


def _longs(value: pa.Scalar) -> np.ndarray:
    return value.values.to_numpy(zero_copy_only=False).astype(np.int64) if value.is_valid else np.empty(0, np.int64)


def _rows(batch: pa.RecordBatch, counts: list[int]) -> dict:
    """Ids of a batch's rows, each repeated as often as it gives rows."""
    return {
        c: (np.repeat(np.array(batch.column(c).to_pylist(), np.int64), counts), pa.int64()) for c in ("doc_id", "row")
    }


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows whose key occurs more than once."""
    twice = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("times")).filter("times > 1").drop("times")
    return rows.join(twice, keys)


def anchor_rows(rows: DataFrame, depth: int) -> DataFrame:
    """(doc_id, row, anchor): fingerprints of all anchors."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [anchors(r, depth)[1] for r in _bytes(batch.column("text"))]
                yield record(_rows(batch, [len(f) for f in found]) | {"anchor": (signed(np.concatenate(found)), pa.int64())})

    return stored(map_batches(rows, run, "doc_id long, row long, anchor long"), "repeat-anchors")


def surroundings(held: DataFrame, depth: int) -> DataFrame:
    """(doc_id, row, pos, core, around, left, right) of each repeated anchor.

    ``core`` is a second fingerprint of its gram, ``left`` and ``right`` are the bytes before and after, as far
    as strings reach, ``around`` a hash of both.
    """
    core, side = depth - RUN + 1, RUN - 1

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                counts, places, cores, left, right = [], [], [], [], []
                for raw, known in zip(utf8(batch.column("text")), batch.column("anchors"), strict=True):
                    at, prints = anchors(np.frombuffer(raw, np.uint8), depth)
                    at = at[np.isin(prints, _longs(known).view(U64))].tolist()
                    counts.append(len(at))
                    places += at
                    cores += [xxhash.xxh3_64_intdigest(raw[p : p + core]) for p in at]
                    left += [raw[max(0, p - side) : p] for p in at]
                    right += [raw[p + core : p + core + side] for p in at]
                around = [xxhash.xxh3_64_intdigest(b"%d %b%b" % (len(a), a, b)) for a, b in zip(left, right, strict=True)]
                yield record(
                    _rows(batch, counts)
                    | {
                        "pos": (places, pa.int64()),
                        "core": (signed(np.array(cores, U64)), pa.int64()),
                        "around": (signed(np.array(around, U64)), pa.int64()),
                        "left": (left, pa.binary()),
                        "right": (right, pa.binary()),
                    }
                )

    return stored(map_batches(held, run, SURROUNDINGS), "repeat-around")


SURROUNDINGS = "doc_id long, row long, pos long, core long, around long, left binary, right binary"


def side_prints(sides: list[bytes], backwards: bool, which: int) -> np.ndarray:
    """(RUN, n) fingerprints of the first (or, backwards, last) 0, 1, ... bytes; 0 where a side is shorter."""
    sizes = np.array([len(x) for x in sides])
    flat = np.frombuffer(b"".join(sides), np.uint8)
    begins = np.cumsum(sizes) - sizes
    out = np.zeros((RUN, len(sides)), U64)
    now = np.full(len(sides), U64(1))
    out[0] = now
    for k in range(1, RUN):
        on = sizes >= k
        at = (begins + sizes - k if backwards else begins + k - 1)[on]
        now[on] = now[on] * BASES[which] + TABLES[which][flat[at]]
        out[k, on] = mix(now[on])
    return out


def string_prints(core: np.ndarray, left: list[bytes], right: list[bytes], which: int):
    """For each offset, the rows that have the string at it and the fingerprints of these strings."""
    before, after = side_prints(left, True, which), side_prints(right, False, which)
    for o in range(RUN):
        one, two = before[o], after[RUN - 1 - o]
        have = np.flatnonzero((one != 0) & (two != 0))
        yield o, have, mix(mix(core[have] + one[have]) + two[have] * U64(0x9E3779B97F4A7C15))


def repeated_offsets(core: np.ndarray, times: np.ndarray, left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Smallest and largest offset of a repeated string of each distinct surrounding; -1 for none.

    ``times`` says how often a surrounding occurs: all strings of one that occurs twice repeat.
    """
    low, high = np.full(len(core), -1, np.int64), np.full(len(core), -1, np.int64)
    for o, have, prints in string_prints(core, left, right, 0):
        order = np.argsort(prints, kind="stable")
        same = prints[order][1:] == prints[order][:-1]
        twice = np.zeros(len(have), bool)
        twice[order[1:][same]] = twice[order[:-1][same]] = True
        hit = have[twice | (times[have] > 1)]
        low[hit] = np.where(low[hit] < 0, o, low[hit])
        high[hit] = o
    return low, high


OFFSETS = "core long, around long, low long, high long"


def small_groups(distinct: DataFrame, limit: int) -> DataFrame:
    """Repeated offsets where each core's surroundings fit a task: a task takes whole cores, some at a time.

    Cores of more than ``limit`` surroundings are passed over.
    """

    def run(batches):
        held, size, passed = [], 0, None
        for batch in batches:
            core = batch.column("core").to_numpy()
            if passed is not None:
                batch = batch.slice(int(np.searchsorted(core, passed, "right")))
                core = batch.column("core").to_numpy()
            if not len(core):
                continue
            passed = None
            if held and held[-1].column("core")[0].as_py() != core[0]:
                yield solve(held)
                held, size = [], 0
            cut = int(np.searchsorted(core, core[-1]))  # the last core may go on
            if cut:
                yield solve([*held, batch.slice(0, cut)])
                held, size = [], 0
            held.append(batch.slice(cut))
            size += batch.num_rows - cut
            if size > limit:
                held, size, passed = [], 0, core[-1]
        if held:
            yield solve(held)

    def solve(held):
        table = pa.Table.from_batches(held)
        core, around = table.column("core").to_numpy(), table.column("around").to_numpy()
        sides = (table.column(c).to_pylist() for c in ("left", "right"))
        low, high = repeated_offsets(core.view(U64), table.column("times").to_numpy(), *sides)
        some = low >= 0
        return record(
            {"core": (core[some], pa.int64()), "around": (around[some], pa.int64()), "low": (low[some], pa.int64()), "high": (high[some], pa.int64())}
        )

    dealt = distinct.repartition("core").sortWithinPartitions("core")
    return map_batches(dealt, run, OFFSETS)


def large_groups(distinct: DataFrame) -> DataFrame:
    """The same for cores with very many surroundings: their strings are dealt out and counted as rows."""

    def run(batches):
        for batch in batches:
            core, around = batch.column("core").to_numpy(), batch.column("around").to_numpy()
            sides = [batch.column(c).to_pylist() for c in ("left", "right")]
            times = batch.column("times").to_numpy()
            both = zip(string_prints(core.view(U64), *sides, 0), string_prints(core.view(U64), *sides, 1), strict=True)
            for (o, have, one), (_, _, two) in both:
                yield record(
                    {
                        "core": (core[have], pa.int64()),
                        "around": (around[have], pa.int64()),
                        "times": (times[have], pa.int64()),
                        "o": (np.full(len(have), o), pa.int64()),
                        "one": (signed(one), pa.int64()),
                        "two": (signed(two), pa.int64()),
                    }
                )

    strings = map_batches(distinct, run, "core long, around long, times long, o long, one long, two long")
    key = ["core", "o", "one", "two"]
    counts = strings.groupBy(*key).agg(F.sum("times").alias("all"))
    hit = strings.join(counts.filter("all > 1").drop("all"), key)
    return hit.groupBy("core", "around").agg(F.min("o").alias("low"), F.max("o").alias("high"))


def repeated_spans(around: DataFrame, depth: int) -> DataFrame:
    """(doc_id, row, start, stop): the union of the repeated strings of each anchor."""
    distinct = around.groupBy("core", "around", "left", "right").agg(F.count(F.lit(1)).alias("times"))
    distinct = stored(distinct, "repeat-distinct")
    release(distinct.sparkSession)
    crowded = distinct.groupBy("core").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > GROUP_ROWS)
    small = small_groups(distinct, GROUP_ROWS)
    large = large_groups(distinct.join(crowded.select("core"), "core", "left_semi"))
    offsets = stored(small.unionByName(large), "repeat-offsets")
    return around.select("doc_id", "row", "pos", "core", "around").join(offsets, ["core", "around"]).select(
        "doc_id", "row", (F.col("pos") - F.col("high")).alias("start"), (F.col("pos") - F.col("low") + depth).alias("stop")
    )


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def cut_out(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """Every row without the bytes of its spans."""
    listed = spans.groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))
    joined = rows.join(listed, ["doc_id", "row"], "left").select(
        "doc_id", "text", F.col("spans.start").alias("starts"), F.col("spans.stop").alias("stops")
    )

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                out = {c.split()[0]: [] for c in RESULT.split(", ")}
                for key, raw, a, b in zip(
                    batch.column("doc_id").to_pylist(), _bytes(batch.column("text")), batch.column("starts"), batch.column("stops"),
                    strict=True,
                ):
                    gone = cover(len(raw), np.column_stack((_longs(a), _longs(b))))
                    kept = raw[~gone].tobytes()
                    runs = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1))
                    row = (None if key == NO_ID else key, len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept)
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
                kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
                yield record({c.split()[0]: (out[c.split()[0]], kinds[c.split()[1]]) for c in RESULT.split(", ")})

    return map_batches(joined, run, RESULT)


def remove_repeats(docs: DataFrame, depth: int = 200) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row.

    Removed are the bytes of every string of ``depth`` bytes that starts somewhere else, too, in this or
    another document; overlapping occurrences count; ``depth`` is above RUN.  Null and empty texts
    keep nothing and lose nothing.  Equal rows are different documents, so long ones lose all
    their bytes.  ``kept`` can end within a character.  An empty table gives no row; further
    columns are ignored.
    """
    if depth <= RUN:
        raise ValueError(f"depth must exceed {RUN}")
    spark = docs.sparkSession
    rows, key = with_row(docs), ["doc_id", "row"]
    known = stored(repeated(anchor_rows(rows, depth), ["anchor"]).distinct(), "repeat-known")
    release(spark)
    held = rows.join(known.groupBy(*key).agg(F.collect_list("anchor").alias("anchors")), key)
    around = surroundings(held, depth)
    release(spark)
    spans = stored(repeated_spans(around, depth), "repeat-spans")
    release(spark)
    return cut_out(rows, spans)
