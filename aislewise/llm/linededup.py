"""Near-duplicate lines removed by an exact set-similarity join, in DataFrame functions alone.

A line is the set of its words.  Words are ordered by rarity: by how crowded their count bucket is,
then by hash.  With at most d words of a line x missing in y and e words of y missing in x, at most 2d + e
neighbours-in-order of x are no neighbours in y.  So two lines that match share a pair of neighbours
among the first 2d + e + 1 of each (prefix filter), at places that the sizes bound (positional
filter), and the sizes bound each other (length filter).  Pairs of neighbouring rare words are hardly ever
shared by chance, so lists of lines per pair stay short, except for real groups of near copies:

* equal sets are one class, which only its first line represents;
* each class is compared with the earliest of its list, and with the most central one before it; what
  matches is a later match and done;
* the others are compared with the earlier classes of their lists.

Before any words are fetched, sketches are compared: a word flips one of 64 bits of its line's sketch (of 128 if
the line is long), so sketches differ in no more bits than the sets in words.  Unrelated lines that share a pair by chance, whose
number grows with the square of the corpus, end there.  Signatures, texts and pairs go through the joins slice
by slice, so the disk they need at once is a fixed share of theirs.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislewise.llm.common import drop_scratch, release, scratch, stored

NO_ID = -(1 << 63)  # stands for a null id, so that such rows join
BUCKETS = 8192  # counts of words are kept for so many buckets, whatever the corpus
LINE = ["doc_id", "row", "line_no"]  # a line's place; in this order lines are earlier or later
SLICES = 4  # parts, at most, in which signatures and texts are shuffled, one after the other
SLICE_CLASSES = 100_000  # sets of words for which another part is worth its jobs
LONG = 64  # words from which a line's sketch has 128 bits
PLACE_BITS = 16  # a signature's place in its line travels in so many low bits of it; later places count as the last


def with_row(docs: DataFrame, *carried: Column) -> DataFrame:
    """(doc_id, row, text): ``row`` tells rows of one id apart; rows equal in both are one document."""
    text = F.coalesce("text", F.lit(""))
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")
    return docs.select(key, F.xxhash64(text).alias("row"), text.alias("text"), *carried)


def word_hashes(line: Column) -> Column:
    words = F.array_remove(F.split(F.translate(F.lower(line), "\t", " "), " "), "")
    return F.array_distinct(F.transform(words, lambda w: F.xxhash64(w)))


def crowding(rows: DataFrame) -> np.ndarray:
    """A class per bucket of word hashes that grows with the logarithm of its count, from all words.

    The counts come to the driver: BUCKETS rows at most.
    """
    words = rows.select(F.explode(F.split(F.translate(F.lower("text"), "\t\n", "  "), " ")).alias("w"))
    counts = words.select(F.pmod(F.xxhash64("w"), F.lit(BUCKETS)).cast("int").alias("b")).groupBy("b").count()
    total = np.zeros(BUCKETS)
    for r in counts.toLocalIterator():
        total[r["b"]] = r["count"]
    return np.minimum(4 * np.log2(total + 1), 127).astype(np.int32)


def lines_of(rows: DataFrame, crowd: np.ndarray) -> DataFrame:
    """(doc_id, row, line_no, toks, cid) of each line: its words in order of rarity, and the id of their set.

    A line without words has no set and matches nothing.
    """
    level = F.lit(crowd)
    lines = rows.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    order = lambda h: F.shiftleft(F.get(level, F.pmod(h, F.lit(BUCKETS)).cast("int")).cast("long"), 56).bitwiseOR(
        F.shiftrightunsigned(h, 8)
    )
    toks = F.sort_array(F.transform(word_hashes(F.col("line")), order))
    return lines.select(*LINE, toks.alias("toks")).withColumn("cid", F.when(F.size("toks") > 0, F.xxhash64("toks")))


def signatures(percent: int) -> Column:
    """The prefix of neighbouring pairs of a line's ``toks``, hashed to 48 bits, in order.  What a hash brings
    together by chance is compared like the rest.

    Against a partner of m words 2d + e falls as m grows, so it is largest at m = t n, where d = n - m, e = 0
    and it is 2 (1 - t) n.  Lines of fewer than t / (1 - t) words match equal sets only and have none.
    """
    t, n = percent / 100, F.size("toks")
    last = F.least(F.floor(2 * (1 - t) * n + 1e-9).cast("int"), n - 2)
    pair = lambda i: F.shiftrightunsigned(F.xxhash64(F.get("toks", i), F.get("toks", i + 1)), PLACE_BITS)
    pairs = F.transform(F.sequence(F.lit(0), last), pair)
    return F.when((n >= 2) & (n >= int(t / max(1 - t, 1e-9) + 1e-9)), pairs)


def needed(n: Column, m: Column, percent: int) -> Column:
    """Words that sets of these sizes must share to match."""
    return F.ceil((n + m) * percent / (100 + percent))


def may_match(n: Column, i: Column, m: Column, j: Column, percent: int) -> Column:
    o = needed(n, m, percent)
    sizes = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    return sizes & (i <= 2 * (n - o) + (m - o)) & (j <= 2 * (m - o) + (n - o))


def sketch() -> list[Column]:
    """(lo, hi): 128 bits of a line's ``toks``, of which each word flips one.  Short lines have both halves folded
    into the first."""
    half = lambda w: w.bitwiseAND(64) != 0
    bit = lambda w: F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(63).cast("int"))
    long, none = F.size("toks") >= LONG, F.lit(0).cast("long")
    lo = F.aggregate("toks", none, lambda bits, w: F.when(long & half(w), bits).otherwise(bits.bitwiseXOR(bit(w))))
    hi = F.aggregate("toks", none, lambda bits, w: F.when(half(w), bits.bitwiseXOR(bit(w))).otherwise(bits))
    return [lo.alias("lo"), F.when(long, hi).otherwise(none).alias("hi")]


def may_be_close(x: Callable[[str], Column], y: Callable[[str], Column], percent: int) -> Column:
    """Whether sets x and y of sizes ``n`` and sketches (``lo``, ``hi``) may match: each differing bit is a word that
    one of them lacks."""
    n, m = x("n"), y("n")
    lo, hi = x("lo").bitwiseXOR(y("lo")), x("hi").bitwiseXOR(y("hi"))
    both = F.bit_count(lo) + F.bit_count(hi)
    differ = F.when((n >= LONG) & (m >= LONG), both).otherwise(F.bit_count(lo.bitwiseXOR(hi)))
    return differ <= n + m - 2 * needed(n, m, percent)


def line_classes(lines: DataFrame) -> DataFrame:
    """(cid, first, num, ...) of each set of words: its first line, a short number, and what its lines have in common."""
    first = F.min(F.struct(*LINE)).alias("first")
    common = [F.first(c).alias(c) for c in lines.columns if c not in (*LINE, "cid")]
    return lines.filter("cid is not null").groupBy("cid").agg(first, *common).withColumn("num", F.monotonically_increasing_id())


def ranked(classes: DataFrame) -> DataFrame:
    """``classes`` numbered by ``rank`` in the order of their first lines, which no two share, instead of ``num``.
    The numbers stand for the places in all lists."""
    return classes.drop("num").orderBy("first").withColumn("rank", F.monotonically_increasing_id())


def shared_signatures(classes: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """(sig, pos, ...): the signatures that two classes or more have, each class once, with its number, size and
    sketch; only those of one part of ``parts``.

    Most signatures have one class only.  They are shuffled and sorted once; a place beyond the bits it
    travels in counts as earlier than it is, which only lets more pairs be compared.
    """
    carried = [c for c in classes.columns if c not in ("cid", "first", "sigs")]
    place = F.least(F.col("pos"), F.lit((1 << PLACE_BITS) - 1)).cast("long")
    packed = F.shiftleft("sig", PLACE_BITS).bitwiseOR(place).alias("packed")
    posted = classes.select(*carried, F.posexplode("sigs").alias("pos", "sig"))
    if parts > 1:
        posted = posted.filter(F.pmod("sig", F.lit(parts)) == part)
    sig = F.shiftrightunsigned("packed", PLACE_BITS)
    dealt = posted.select(packed, *carried).repartition(sig).withColumn("sig", sig)
    many = dealt.withColumn("many", F.count(F.lit(1)).over(Window.partitionBy("sig"))).filter("many > 1")
    return many.select("sig", F.col("packed").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("pos"), *carried)


def list_members(shared: DataFrame, percent: int) -> DataFrame:
    """(sig, rank, pos, n, lo, hi, early, middle): classes of every list that holds two or more, each with two
    classes before it, where it may match them: the list's earliest, and the one that has the pair earliest
    in its order: with the fewest rare words of its own, it is what near copies are copies of.

    A list streams through its window, which spills.
    """
    before = Window.partitionBy("sig").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    placed = shared.withColumn("one", F.first(F.struct("rank", "n", "pos", "lo", "hi")).over(before)).withColumn(
        "two", F.min(F.struct("pos", "rank", "n", "lo", "hi")).over(before)
    )

    def where(other: str) -> Column:
        of = lambda c: F.col(f"{other}.{c}")
        open_pair = may_match(F.col("n"), F.col("pos"), of("n"), of("pos"), percent) & may_be_close(F.col, of, percent)
        return F.when(open_pair, of("rank"))

    return placed.select("sig", "rank", "pos", "n", "lo", "hi", where("one").alias("early"), where("two").alias("middle"))


def tokens_of(rows: DataFrame, places: DataFrame) -> DataFrame:
    """(rank, toks) of the lines at ``places`` (rank, doc_id, row, line_no): their word hashes; other lines are not
    cut into words."""
    by_text = places.groupBy("doc_id", "row").agg(F.collect_list(F.struct("line_no", "rank")).alias("asked"))
    split = F.split("text", "\n").alias("split")
    asked = rows.join(by_text, ["doc_id", "row"]).select("doc_id", "row", split, F.explode("asked").alias("a"))
    found = asked.select("doc_id", "row", "a.*", word_hashes(F.get("split", F.col("a.line_no"))).alias("toks"))
    return found.dropDuplicates(["doc_id", "row", "line_no"]).select("rank", "toks")


def compared(pairs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(x, y, shared, together) of pairs (x, y) of classes: exact sizes of intersection and union."""
    one = tokens.select(F.col("rank").alias("x"), F.col("toks").alias("tx"))
    two = tokens.select(F.col("rank").alias("y"), F.col("toks").alias("ty"))
    shared = F.size(F.array_intersect("tx", "ty"))
    return pairs.join(one, "x").join(two, "y").select(
        "x", "y", shared.alias("shared"), (F.size("tx") + F.size("ty") - shared).alias("together")
    )


def together(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def answers_of(rows: DataFrame, classes: DataFrame, pairs: DataFrame, parts: int, most: int) -> DataFrame:
    """``compared`` of the pairs, written; the words of their lines are let go again.

    Texts are shuffled in ``parts``.  ``most`` pairs or so, by hash of x, take their words along at once.
    """
    spark = rows.sparkSession
    wanted = pairs.select(F.col("x").alias("rank")).union(pairs.select("y")).distinct()
    places = stored(classes.join(wanted, "rank").select("rank", "first.*"), "line-asked")
    paths = [scratch(spark, "line-tokens") for _ in range(parts)]
    of = lambda t, k: t.filter(F.pmod("row", F.lit(parts)) == k)
    tokens = together([stored(tokens_of(of(rows, k), of(places, k)), "line-tokens", path) for k, path in enumerate(paths)])
    rounds = max(1, -(-pairs.count() // most))
    turn = F.pmod(F.xxhash64("x"), F.lit(rounds))
    answers = [stored(compared(pairs.filter(turn == k), tokens), "line-compared") for k in range(rounds)]
    for path in paths:
        drop_scratch(spark, path)
    return together(answers)


def later_matches(lists: list[DataFrame], answers_for: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(rank,) of classes whose first line matches an earlier line, from the ``list_members`` of each slice of
    signatures; ``answers_for`` pairs compares them."""
    against = lambda c: [m.filter(f"{c} is not null").select(F.col("rank").alias("x"), F.col(c).alias("y")) for m in lists]
    tested = stored(together(against("early") + against("middle")).distinct(), "line-tested")
    match = F.expr(f"100 * shared >= {percent} * together")
    answers = answers_for(tested)
    done = stored(answers.filter(match).select(F.col("x").alias("rank")).distinct(), "line-matched")

    def candidates(members: DataFrame) -> DataFrame:
        rows = members.select("sig", "rank", "pos", "n", "lo", "hi")
        open_rows = rows.join(done, "rank", "left_anti").select(*(F.col(c).alias(f"x_{c}") for c in rows.columns))
        return (
            open_rows.join(rows, open_rows["x_sig"] == rows["sig"])
            .filter(F.col("rank") < F.col("x_rank"))
            .filter(may_match(F.col("x_n"), F.col("x_pos"), F.col("n"), F.col("pos"), percent))
            .filter(may_be_close(lambda c: F.col(f"x_{c}"), F.col, percent))
            .select(F.col("x_rank").alias("x"), F.col("rank").alias("y"))
            .distinct()
        )

    found = together([stored(candidates(m), "line-pairs") for m in lists]).distinct()
    rest = stored(found.join(answers.select("x", "y"), ["x", "y"], "left_anti"), "line-rest")
    more = answers_for(rest).filter(match).select(F.col("x").alias("rank"))
    return stored(done.unionByName(more).distinct(), "line-later")


def dedup_lines(docs: DataFrame, percent: int = 80, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, n_lines, n_removed, text) of every row: its text without lines that match an earlier line.
    Columns named in ``carry`` come along in a struct of that name.

    Two lines match when 100 * intersection >= percent * union of their sets of lower-cased words, cut at
    blanks and tabs.  Earlier means a smaller (doc_id, hash of the text, line number); a null id is
    smaller than all.  Every line but the first of a group of equals goes, and so does one that is like an
    earlier line which goes itself.  Lines without words stay.  Null and empty texts come back as an
    empty text with one line; rows that repeat an id and its text are one document to each other
    and are all treated alike; an empty table gives no row; further columns are ignored.  The prefix bound
    holds for ``percent`` of 75 and more.
    """
    if not 75 <= percent <= 100:
        raise ValueError("percent must be 75 to 100")
    spark = docs.sparkSession
    rows = with_row(docs)
    crowd = crowding(rows)
    size = F.size("toks").alias("n")
    found = lines_of(rows, crowd).select(*LINE, "cid", size, *sketch(), signatures(percent).alias("sigs"))
    lines_at, sets_at, ranks_at = (scratch(spark, n) for n in ("lines", "line-sets", "line-ranks"))
    lines = stored(found, "lines", lines_at)
    sets = stored(line_classes(lines), "line-sets", sets_at)
    places = stored(lines.select(*LINE, "cid"), "line-places")
    drop_scratch(spark, lines_at)
    ranks = stored(ranked(sets), "line-ranks", ranks_at)
    drop_scratch(spark, sets_at)
    classes = stored(ranks.select("rank", "cid", "first"), "line-classes")
    n = classes.count()
    parts, most = min(SLICES, 1 + n // SLICE_CLASSES), max(SLICE_CLASSES, n // SLICES)
    lists_at = [scratch(spark, "line-lists") for _ in range(parts)]
    lists = [stored(list_members(shared_signatures(ranks, k, parts), percent), "line-lists", at) for k, at in enumerate(lists_at)]
    drop_scratch(spark, ranks_at)
    later = later_matches(lists, lambda pairs: answers_of(rows, classes, pairs, parts, most), percent).withColumn("later", F.lit(True))
    for at in lists_at:
        drop_scratch(spark, at)
    release(spark)
    marked = places.join(classes.join(later, "rank", "left"), "cid", "left").select(
        *LINE, (F.col("later").isNotNull() | F.coalesce(F.struct(*LINE) > F.col("first"), F.lit(False))).alias("gone")
    )
    flags = F.transform(F.sort_array(F.collect_set(F.struct("line_no", "gone"))), lambda s: s["gone"])
    by_row = marked.groupBy("doc_id", "row").agg(flags.alias("gone")).filter(F.exists("gone", lambda g: g))
    split = F.split("text", "\n")
    kept = F.filter(split, lambda _, i: ~F.get("gone", i))
    whole = with_row(docs, F.struct(*carry).alias("carry")) if carry else rows
    return whole.join(by_row, ["doc_id", "row"], "left").select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"),
        F.size(split).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size(split) - F.size(kept)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        *(["carry"] if carry else []),
    )
