"""Product codes of vectors: Lloyd's rounds over cover trees, in whole numbers.

Rows are cut into blocks where they lie.  Each part of a block's vectors becomes a cover tree: a node covers a run
of the block's points within its radius, its children lie more than half the radius it was split at from each other.
Blocks with their trees are written once; a round reads them, the codebook travels with the task, and 8 numbers an
entry come back.  A node whose radius proves one entry nearest for all its points gives its whole run's sum, a
difference of two cumulative sums; other nodes hand their remaining entries down, and the points of small nodes are
compared exactly.  Distances are exact integers; a bound decides only with a margin wider than its rounding error,
so the result is that of plain Lloyd rounds, ties included.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import map_batches, record, stored

BLOCK_ROWS = 4096
LEAF_ROWS = 24  # a node of so many points is not split further
MARGIN = 1e-9  # relative; far above the rounding of square roots
LIMIT = 1 << 28  # of a scaled component, so that sums of squares stay within 64 bits
FEW_LABELS, SALTS = 100_000, 64


@dataclass(frozen=True)
class CoverTree:
    """Points in tree order, and nodes by level: node i covers points lo[i] to hi[i], the first of them its centre.

    ``radius`` bounds the distance of a node's points to its centre; children of node i are nodes first[i] to
    first[i] + n_children[i].
    """

    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    radius: np.ndarray
    first: np.ndarray
    children: np.ndarray

    @classmethod
    def of(cls, points: np.ndarray) -> CoverTree:
        n = len(points)
        order = np.arange(n)
        lo, hi = np.zeros(min(n, 1), np.int64), np.full(min(n, 1), n, np.int64)
        levels, base = [], len(lo)
        while len(lo):
            node = np.repeat(np.arange(len(lo)), hi - lo)
            spots = np.arange(len(node)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + np.repeat(lo, hi - lo)
            here = points[order[spots]]
            away = np.sqrt(((here - points[order[lo]][node]) ** 2).sum(1).astype(float))
            radius = np.maximum.reduceat(away, np.cumsum(hi - lo) - (hi - lo))
            split = (hi - lo > LEAF_ROWS) & (radius > 0)
            among = split[node]
            owner = _cover(here[among], node[among], away[among], radius / 2)
            spots, node = spots[among], node[among]
            by = np.lexsort((owner, node))
            order[spots] = order[spots[by]]
            node, owner = node[by], owner[by]
            new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (node[1:] != node[:-1])))) if len(by) else by
            count = np.bincount(node[new], minlength=len(lo))
            first = base + np.cumsum(count) - count
            levels.append((lo, hi, radius * (1 + MARGIN), first, count))
            ends = np.append(new[1:], len(node))
            lo, hi = spots[new], spots[new] + (ends - new)
            base += len(lo)
        columns = [np.concatenate(c) for c in zip(*levels, strict=True)] if levels else [np.empty(0, np.int64)] * 5
        return cls(order, *columns)

    def assign(self, points: np.ndarray, book: np.ndarray) -> tuple[list, list]:
        """Runs (lo, hi, entry) that nodes decide, and (places, entries) compared one by one; ``points`` in tree order."""
        runs, singles = [], []
        node = np.arange(min(len(self.lo), 1))
        open_ = np.ones((len(node), len(book)), bool)
        while len(node):
            d = np.sqrt(((points[self.lo[node]][:, None, :] - book) ** 2).sum(2).astype(float))
            d = np.where(open_, d, np.inf)
            best = d.min(1)
            reach = 2 * self.radius[node]
            open_ = d * (1 - MARGIN) <= (best + reach)[:, None] * (1 + MARGIN)
            sure = open_.sum(1) == 1
            runs.append((self.lo[node[sure]], self.hi[node[sure]], open_[sure].argmax(1)))
            node, open_ = node[~sure], open_[~sure]
            leaf = self.children[node] == 0
            if leaf.any():
                size = self.hi[node[leaf]] - self.lo[node[leaf]]
                at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.lo[node[leaf]], size)
                singles.append((at, nearest(points[at], book)[0]))
            node, open_ = node[~leaf], open_[~leaf]
            count = self.children[node]
            open_ = np.repeat(open_, count, axis=0)
            node = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(self.first[node], count)
        return runs, singles


def _cover(points: np.ndarray, node: np.ndarray, away: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """For each point its child: every node takes centres in turn and gives them all free points within its reach.

    The first child is the node's own centre, whose distances are ``away``; later centres are the first free points,
    so centres of one node lie more than its reach from each other.
    """
    owner = np.where(away <= reach[node], 0, -1)
    free = np.flatnonzero(owner < 0)
    turn = 0
    while len(free):
        turn += 1
        group = node[free]
        centre = free[np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))]
        its = np.repeat(centre, np.diff(np.append(np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1]))), len(free))))
        d = np.sqrt(((points[free] - points[its]) ** 2).sum(1).astype(float))
        near = (d <= reach[group]) | (free == its)
        owner[free[near]] = turn
        free = free[~near]
    return owner


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry, the lower of equal ones, and its squared distance."""
    d = ((points[:, None, :] - book) ** 2).sum(2)
    entry = d.argmin(1)
    return entry, np.take_along_axis(d, entry[:, None], 1)[:, 0]


BLOCK = (
    "ids array<long>, labels array<long>, width int, vectors binary, orders array<binary>, los array<binary>,"
    " his array<binary>, radii array<binary>, firsts array<binary>, children array<binary>"
)
_FIELDS = {"los": ("lo", "<i4"), "his": ("hi", "<i4"), "radii": ("radius", "<f8"), "firsts": ("first", "<i4"), "children": ("children", "<i4")}


def tree_blocks(vectors: DataFrame, parts: int) -> DataFrame:
    """One row per block of ``vectors`` (id, label, whole-number vector): the vectors and a tree per part."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK_ROWS):
                batch = whole.slice(at, BLOCK_ROWS)
                n = batch.num_rows
                flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                trees = [CoverTree.of(p) for p in np.split(flat, parts, axis=1)]
                fields = {
                    "ids": ([batch.column("id").to_pylist()], pa.list_(pa.int64())),
                    "labels": ([batch.column("label").to_pylist()], pa.list_(pa.int64())),
                    "width": ([flat.shape[1]], pa.int32()),
                    "vectors": ([flat.astype("<i4").tobytes()], pa.binary()),
                    "orders": ([[t.order.astype("<i2").tobytes() for t in trees]], pa.list_(pa.binary())),
                }
                for name, (field, kind) in _FIELDS.items():
                    fields[name] = ([[getattr(t, field).astype(kind).tobytes() for t in trees]], pa.list_(pa.binary()))
                yield record(fields)

    return map_batches(vectors, run, BLOCK)


def _read_blocks(batches):
    """(row, whole vectors, tree of each part) of stored blocks."""
    for batch in batches:
        for row in batch.to_pylist():
            flat = np.frombuffer(row["vectors"], "<i4").astype(np.int64).reshape(-1, row["width"])
            trees = []
            for k, order in enumerate(row["orders"]):
                columns = (np.frombuffer(row[name][k], kind) for name, (_, kind) in _FIELDS.items())
                trees.append(CoverTree(np.frombuffer(order, "<i2").astype(np.int64), *(c.astype(float if c.dtype.kind == "f" else np.int64) for c in columns)))
            yield row, flat, trees


def round_sums(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """For each part and entry, the count of the parts nearest to it and their sum: (parts, entries, 1 + width)."""
    parts, entries, width = books.shape

    def run(batches):
        total = np.zeros((parts, entries, 1 + width), np.int64)
        for _, flat, trees in _read_blocks(batches):
            for part, (points, tree) in enumerate(zip(np.split(flat, parts, axis=1), trees, strict=True)):
                points = points[tree.order]
                sums = np.concatenate((np.zeros((1, width), np.int64), np.cumsum(points, axis=0)))
                runs, singles = tree.assign(points, books[part])
                for lo, hi, entry in runs:
                    np.add.at(total[part], entry, np.concatenate(((hi - lo)[:, None], sums[hi] - sums[lo]), 1))
                for at, entry in singles:
                    np.add.at(total[part], entry, np.concatenate((np.ones((len(at), 1), np.int64), points[at]), 1))
        place = np.indices(total.shape).reshape(3, -1)
        names = ("part", "entry", "position")
        yield record({n: (p, pa.int32()) for n, p in zip(names, place, strict=True)} | {"total": (total.reshape(-1), pa.int64())})

    out = np.zeros((parts, entries, 1 + width), np.int64)
    each = map_batches(blocks, run, "part int, entry int, position int, total long")
    for row in each.groupBy("part", "entry", "position").agg(F.sum("total").alias("total")).collect():
        out[row["part"], row["entry"], row["position"]] = row["total"]
    return out


CODES = "vec_id long, label long, code string, error long"


def encode(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """Codes and errors of all vectors in ``blocks``: two hex digits a part."""
    parts = len(books)
    digits = np.array([f"{k:02x}" for k in range(books.shape[1])])

    def run(batches):
        for row, flat, trees in _read_blocks(batches):
            codes = np.empty((len(flat), parts), np.int64)
            error = np.zeros(len(flat), np.int64)
            for part, (points, tree) in enumerate(zip(np.split(flat, parts, axis=1), trees, strict=True)):
                ordered = points[tree.order]
                entries = np.empty(len(flat), np.int64)
                runs, singles = tree.assign(ordered, books[part])
                for lo, hi, entry in runs:
                    size = hi - lo
                    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
                    entries[at] = np.repeat(entry, size)
                for at, entry in singles:
                    entries[at] = entry
                codes[tree.order, part] = entries
                error += ((points - books[part][codes[:, part]]) ** 2).sum(1)
            yield record(
                {
                    "vec_id": (row["ids"], pa.int64()),
                    "label": (row["labels"], pa.int64()),
                    "code": (["".join(c) for c in digits[codes]], pa.string()),
                    "error": (error, pa.int64()),
                }
            )

    return map_batches(blocks, run, CODES)


def whole_vectors(vectors: DataFrame, scale: int) -> DataFrame:
    """id, label and floor(scale * x) of the vectors that are not null and hold finite components only."""
    x = F.col("embedding").cast("array<double>")
    whole = vectors.select(
        F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), x.alias("x")
    ).filter(F.col("x").isNotNull() & F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))))
    return whole.select("id", "label", F.transform("x", lambda v: F.floor(v * scale)).alias("vector"))


def compress_vectors(
    vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096
) -> tuple[DataFrame, np.ndarray]:
    """Product codes of ``vectors`` (vec_id, embedding, label) and the codebooks: (parts, entries, width).

    Components become floor(scale * x).  The codebooks start as the ``entries`` smallest ids' vectors (null ids come
    last, equal ids by vector; fewer vectors give fewer entries) and take ``rounds`` of Lloyd's rounds: each entry
    becomes the floor of its parts' mean, an entry without parts stays, equal distances go to the lower entry.
    Vectors that are null or hold null or non-finite components have no row, and so have those whose length is not
    that of the smallest id's vector.  Repeated rows and ids stay apart and keep their order in nothing but the
    codebook's start; an empty table gives no row; further columns are ignored.  That length must divide into
    ``parts``, and a scaled component must stay below 2**28 in size: otherwise an error says so.
    """
    whole = whole_vectors(vectors, scale).filter(F.size("vector") > 0)
    start = whole.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()
    if not start:
        return vectors.sparkSession.createDataFrame([], CODES), np.zeros((parts, 0, 0), np.int64)
    size = len(start[0]["vector"])
    if size % parts:
        raise ValueError(f"vectors of {size} components do not divide into {parts} parts")
    whole = whole.filter(F.size("vector") == size)
    if any(len(r["vector"]) != size for r in start):
        start = whole.orderBy(F.asc_nulls_last("id"), "vector").limit(entries).collect()
    small = F.forall("vector", lambda v: F.abs(v) < LIMIT)
    checked = F.when(small, F.col("vector")).otherwise(F.raise_error(F.lit("a scaled component is 2**28 or more")))
    blocks = stored(tree_blocks(whole.select("id", "label", checked.alias("vector")), parts), "vector-trees")
    books = np.array([r["vector"] for r in start], np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        sums = round_sums(blocks, books)
        count = sums[:, :, :1]
        books = np.where(count > 0, sums[:, :, 1:] // np.maximum(count, 1), books)
    return encode(blocks, books), books


def books_sha256(books: np.ndarray) -> str:
    """Checksum of all entries' decimal components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_total(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows of equal ``key``, nulls together.

    Few totals are broadcast; many are joined on the key and a salt, so that one key's rows stay spread.
    """
    totals = rows.groupBy(F.col(key).alias("_key")).agg(F.sum(value).alias(name))
    totals = stored(totals, "totals")
    if totals.count() <= FEW_LABELS:
        return rows.join(F.broadcast(totals), rows[key].eqNullSafe(totals["_key"])).drop("_key")
    salted = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_of", (F.rand(7) * SALTS).cast("int"))
    joined = dealt.join(salted, dealt[key].eqNullSafe(salted["_key"]) & (dealt["_of"] == salted["_salt"]))
    return joined.drop("_key", "_salt", "_of")


def code_digests(vectors: DataFrame, **settings) -> DataFrame:
    """Per vector its code, its error, the error of its label, and the checksum of the codebooks."""
    codes, books = compress_vectors(vectors, **settings)
    codes = with_total(stored(codes, "vector-codes"), "label", "error", "label_error")
    return codes.withColumn("codebooks_sha256", F.lit(books_sha256(books))).drop("label")
