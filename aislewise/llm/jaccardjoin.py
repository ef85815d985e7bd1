"""Exact Jaccard join of word n-gram sets, with answers skipped through set relations.

Equal sets are one class.  N-grams are ordered by how crowded their count bucket is, then by hash; two
sets that link share an n-gram of their prefixes.  An index list is the sets with one prefix n-gram.
Instead of all pairs of a list:

1. every member is compared with the list's pivot, unless sizes or list positions rule the link out;
   the pivot holds the n-gram earliest in its order, so it has the fewest n-grams of its own and, in
   a group of near copies, is the text they are all copies of, or close to it;
2. members that a link already joins need no further comparison with each other, as only
   components are asked for: a set takes over the answers of the pivot it is like;
3. members outside the pivot's component meet the others of another component, except
   where their distances from the pivot differ by more than the limit: Jaccard distance is a metric,
   so the pivot's computed answers decide.

What remains is compared exactly.  A list that one group of copies fills thus costs one comparison a
member, and lists are joined by key, never gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aislewise.llm.common import (
    U64, lowered_word_hashes, map_batches, mix, record, release, shingles, signed, slices, stored, utf8,
)
from aislewise.operators.graph import components

NO_ID = -(1 << 63)  # stands for a null id, so that such rows join
BUCKET_BITS = 20  # counts of n-grams are kept for 2**20 buckets, whatever the corpus
BLOCK = 4096  # buckets a row of counts


def gram_sets(many: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted hashes of each text's distinct n-grams: ASCII letters lower-cased, words cut at ASCII white space.

    A text of fewer words than ``width`` has its whole word sequence as the only element.
    """
    h, begins = lowered_word_hashes(many)
    grams = shingles(h, width)
    out = []
    for a, b in zip(begins.tolist(), begins[1:].tolist(), strict=False):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        else:
            out.append(mix(shingles(h[a:b], b - a) + U64(b - a)) if b > a else h[:0])
    return out


def set_id(grams: np.ndarray) -> int:
    return int(np.array([xxhash.xxh3_64_intdigest(grams.tobytes())], U64).view(np.int64)[0])


def row_of(text: str) -> Column:
    """Tells rows of one id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def own_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))


SCAN = "doc_id long, row long, n long, sid long, block int, counts binary"


def scan_sets(docs: DataFrame, width: int) -> DataFrame:
    """One row per document (size and id of its set) and, with ``block`` set, counts of n-gram buckets."""

    def run(batches):
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                sets = gram_sets(utf8(batch.column("text")), width)
                counts += np.bincount((np.concatenate(sets) >> U64(64 - BUCKET_BITS)).astype(np.int64), minlength=len(counts))
                none = [None] * len(sets)
                yield record(
                    {
                        "doc_id": (batch.column("doc_id"), pa.int64()),
                        "row": (batch.column("row"), pa.int64()),
                        "n": ([len(s) for s in sets], pa.int64()),
                        "sid": ([set_id(s) if len(s) else None for s in sets], pa.int64()),
                        "block": (none, pa.int32()),
                        "counts": (none, pa.binary()),
                    }
                )
        blocks = [(b, c) for b, c in enumerate(counts.reshape(-1, BLOCK)) if c.any()]
        none = [None] * len(blocks)
        yield record(
            {
                "doc_id": (none, pa.int64()),
                "row": (none, pa.int64()),
                "n": (none, pa.int64()),
                "sid": (none, pa.int64()),
                "block": ([b for b, _ in blocks], pa.int32()),
                "counts": ([c.tobytes() for _, c in blocks], pa.binary()),
            }
        )

    rows = docs.select(F.col("doc_id").cast("long"), row_of("text").alias("row"), "text")
    return stored(map_batches(rows, run, SCAN), "join-sets")


def crowding(scan: DataFrame) -> np.ndarray:
    """A byte per bucket that grows with the logarithm of its count.  Its size is fixed."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[b] = sums.get(b, 0) + np.frombuffer(c, np.int64)
        yield record({"block": (list(sums), pa.int32()), "counts": ([c.tobytes() for c in sums.values()], pa.binary())})

    rows = scan.filter("block is not null").select("block", "counts")
    total = np.zeros(((1 << BUCKET_BITS) // BLOCK, BLOCK), np.int64)
    for r in map_batches(rows.repartition(64, "block"), run, "block int, counts binary").toLocalIterator():
        total[r["block"]] += np.frombuffer(r["counts"], np.int64)
    return np.minimum(4 * np.log2(total.reshape(-1) + 1), 255).astype(np.uint8)


def postings(docs: DataFrame, crowd: np.ndarray, width: int, percent: int) -> DataFrame:
    """(gram, sid, n, pos) of the prefix of every set: enough of its least crowded n-grams that two sets
    that link share one of them."""
    held = docs.sparkSession.sparkContext.broadcast(crowd)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                grams, sids, sizes, prefix = [], [], [], []
                for s in gram_sets(utf8(batch.column("text")), width):
                    if len(s):
                        take = len(s) - -(-len(s) * percent // 100) + 1
                        order = np.lexsort((s, held.value[(s >> U64(64 - BUCKET_BITS)).astype(np.int64)]))
                        grams.append(s[order[:take]])
                        sids.append(set_id(s))
                        sizes.append(len(s))
                        prefix.append(take)
                if not grams:
                    continue
                prefix = np.array(prefix)
                yield record(
                    {
                        "gram": (signed(np.concatenate(grams)), pa.int64()),
                        "sid": (np.repeat(np.array(sids, np.int64), prefix), pa.int64()),
                        "n": (np.repeat(np.array(sizes, np.int32), prefix), pa.int32()),
                        "pos": ((np.arange(prefix.sum()) - np.repeat(np.cumsum(prefix) - prefix, prefix)).astype(np.int32), pa.int32()),
                    }
                )

    return stored(map_batches(docs.select("text"), run, "gram long, sid long, n int, pos int"), "join-postings")


def may_link(n1: Column, p1: Column, n2: Column, p2: Column, percent: int) -> Column:
    """Length and position filters: whether sets that share first the n-gram at these places can link."""
    overlap = F.ceil((n1 + n2) * percent / (100 + percent))
    return (100 * F.least(n1, n2) >= percent * F.greatest(n1, n2)) & (F.least(n1 - p1, n2 - p2) >= overlap)


def list_members(posted: DataFrame) -> DataFrame:
    """Members of every index list with two sets or more, each beside the list's pivot."""
    pivot = F.min(F.struct("pos", "sid", "n")).alias("pivot")
    lists = posted.groupBy("gram").agg(pivot, F.min("sid").alias("low"), F.max("sid").alias("high")).filter("low < high")
    return stored(posted.join(lists.select("gram", "pivot"), "gram").distinct(), "join-lists")


def texts_of(docs: DataFrame, classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(sid, text): one text of each set in pairs (a, b)."""
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).distinct()
    reps = classes.join(wanted, "sid").select("sid", "rep.doc_id", "rep.row")
    texts = docs.select(own_id().alias("doc_id"), row_of("text").alias("row"), "text")
    return stored(texts.join(reps, ["doc_id", "row"]).dropDuplicates(["doc_id", "row"]).select("sid", "text"), "join-texts")


def compared(pairs: DataFrame, held: DataFrame, width: int) -> DataFrame:
    """(a, b, shared, together): exact sizes of the intersection and union of each pair."""
    one = held.select(F.col("sid").alias("a"), F.col("text").alias("text_a"))
    two = held.select(F.col("sid").alias("b"), F.col("text").alias("text_b"))

    def run(batches):
        last, other = None, None
        for whole in batches:
            for batch in slices(whole, "text_a", 4 << 20):
                a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
                right = batch.column("text_b")
                shared, together = [], []
                for i, s in enumerate(gram_sets(utf8(batch.column("text_a")), width)):
                    if b[i] != last:
                        last, other = b[i], gram_sets([(right[i].as_py() or "").encode()], width)[0]
                    n = len(np.intersect1d(s, other, assume_unique=True))
                    shared.append(n)
                    together.append(len(s) + len(other) - n)
                yield record(
                    {
                        "a": (a, pa.int64()),
                        "b": (b, pa.int64()),
                        "shared": (shared, pa.int64()),
                        "together": (together, pa.int64()),
                    }
                )

    rows = pairs.join(one, "a").join(two, "b").select("a", "b", "text_a", "text_b")
    return stored(map_batches(rows, run, "a long, b long, shared long, together long"), "join-compared")


def _labels(edges: DataFrame) -> DataFrame:
    """(sid, label) of every set that has a link."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    found = components(nodes.withColumn("key", F.lit(0)), edges.select(F.lit(0).alias("key"), "a", "b"), "key")
    return found.select(F.col("node").alias("sid"), "label")


def remaining_pairs(members: DataFrame, labels: DataFrame, answers: DataFrame, percent: int) -> DataFrame:
    """Pairs of one list that neither a component nor their distances from the pivot decide."""
    known = answers.select(
        F.col("a").alias("sid"), F.col("b").alias("first"), (1 - F.col("shared") / F.col("together")).alias("far")
    )
    part = labels.withColumnRenamed("label", "part")
    rows = (
        members.select("gram", "sid", "n", "pos", F.col("pivot.sid").alias("first"))
        .join(part, "sid", "left")
        .join(part.select(F.col("sid").alias("first"), F.col("part").alias("first_part")), "first", "left")
        .join(known, ["sid", "first"], "left")
        .select(
            "gram", "sid", "n", "pos", "first",
            F.coalesce("part", "sid").alias("part"),
            F.coalesce("first_part", "first").alias("first_part"),
            F.when(F.col("sid") == F.col("first"), 0.0).otherwise(F.col("far")).alias("far"),
        )
    )
    rows = stored(rows, "join-members")
    apart = rows.filter("part <> first_part").select(*(F.col(c).alias(f"x_{c}") for c in ("gram", "sid", "n", "pos", "part", "far")))
    near = F.abs(F.col("x_far") - F.col("far")) <= 1 - percent / 100 + 1e-9
    met = apart.join(rows, apart["x_gram"] == rows["gram"]).filter(
        (F.col("x_part") != F.col("part"))
        & (F.col("sid") != F.col("first"))
        & may_link(F.col("x_n"), F.col("x_pos"), F.col("n"), F.col("pos"), percent)
        & F.coalesce(near, F.lit(True))
    )
    return met.select(F.least("x_sid", "sid").alias("a"), F.greatest("x_sid", "sid").alias("b")).distinct()


def jaccard_components(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, row, n_shingles, component_id) of every row; ``row`` is a hash of the text.

    Texts link when 100 * intersection >= percent * union of their n-gram sets.  Null, empty and wordless
    texts have an empty set and link with nothing.  Repeated rows are one class; a null id stays null
    and names a component only if no member has an id.  An empty table gives no row; further columns
    are ignored.
    """
    spark = docs.sparkSession
    scan = scan_sets(docs, width)
    posted = postings(docs, crowding(scan), width, percent)
    members = list_members(posted)
    release(spark)
    tested = stored(
        members.filter(F.col("sid") != F.col("pivot.sid"))
        .filter(may_link(F.col("n"), F.col("pos"), F.col("pivot.n"), F.col("pivot.pos"), percent))
        .select(F.col("sid").alias("a"), F.col("pivot.sid").alias("b"))
        .distinct(),
        "join-pairs",
    )
    rep = F.min(F.struct(own_id().alias("doc_id"), "row")).alias("rep")
    classes = scan.filter("sid is not null").groupBy("sid").agg(rep)
    answers = compared(tested, texts_of(docs, classes, tested), width)
    release(spark)
    link = F.expr(f"100 * shared >= {percent} * together")
    edges = answers.filter(link).select("a", "b")
    labels = _labels(edges)
    more = stored(remaining_pairs(members, labels, answers, percent), "join-rest")
    found = compared(more, texts_of(docs, classes, more), width).filter(link).select("a", "b")
    if not found.isEmpty():
        labels = _labels(edges.unionByName(found))
    release(spark)
    rows = (
        scan.filter("block is null").select("doc_id", "row", "n", "sid").join(labels, "sid", "left")
        .select("doc_id", "row", F.col("n").alias("n_shingles"), F.coalesce("label", "sid").alias("label"))
    )
    names = rows.filter("label is not null").groupBy("label").agg(F.min("doc_id").alias("named"))
    return rows.join(names, "label", "left").select(
        "doc_id", "row", "n_shingles", F.when(F.col("label").isNotNull(), F.col("named")).otherwise(F.col("doc_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """The rows of ``docs`` that name their component in ``joined``; of rows equal in id and text, one."""
    named = joined.filter(F.col("component_id").eqNullSafe(F.col("doc_id")))
    keys = named.select(own_id().alias("kept_id"), F.col("row").alias("kept_row")).distinct()
    hit = (own_id() == keys["kept_id"]) & (row_of("text") == keys["kept_row"])
    return docs.join(keys, hit, "left_semi").dropDuplicates(["doc_id", "text"])
