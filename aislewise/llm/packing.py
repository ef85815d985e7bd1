"""Lexical retrieval packing: windows filled with BM25 neighbours of their seed document.

Token ids are written once.  Documents are ranged by their smallest word hash, so texts with common
words tend to meet, and cut at quantiles into shards of a bounded number of tokens; a group of copies that
holds a third of all documents is simply cut into many shards.  Each shard has its own inverted index; document
frequencies, count and mean length are those of the whole table, and every term of a seed counts.  Neighbours
are looked for in the seed's shard only.  A seed
document opens a window; its unused neighbours, best score first, fill it; the document that meets
the window's end is cut there and seeds the next window.  The last window of a shard is cut
into sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from aislewise.llm.bpe import Encoder, encoder
from aislewise.llm.common import U64, drop_scratch, map_batches, mix, parts_for, record, release, scratch, signed, slices, stored, texts

WINDOW = 2048
SHARD_TOKENS = 4 << 20
CUT_TOKENS = 1024
TIE_BITS = 20  # low bits of a document's place among the shards that tell documents of one smallest hash apart
GROUP_TOKENS = 1 << 16
ENCODE_BYTES = 16 << 20  # texts that are encoded together
COMMON = 32  # terms that more than one in so many documents of a shard have are held as dense rows
DENSE = 8 << 20  # numbers in all dense rows, and in the scores of a shard whose seeds are worked out together, at most
K1, B = 1.2, 0.75


def word_terms(ids: np.ndarray, opens: np.ndarray) -> np.ndarray:
    """One hash per word of a token sequence; a word starts at each token that carries its space."""
    return terms_of([ids], opens)[0]


def terms_of(many: list[np.ndarray], opens: np.ndarray) -> list[np.ndarray]:
    """One hash per word of each token sequence; about GROUP_TOKENS of them are hashed together."""
    out: list[np.ndarray] = []
    ends = np.cumsum([len(ids) for ids in many])
    while len(out) < len(many):
        first = len(out)
        base = ends[first - 1] if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, base + GROUP_TOKENS, "right")))
        flat, edges = np.concatenate(many[first:stop]), np.concatenate(([0], ends[first:stop] - base))
        begins = opens[flat]
        begins[edges[:-1][np.diff(edges) > 0]] = True
        starts = np.flatnonzero(begins)
        if len(starts):
            place = np.arange(len(flat), dtype=U64) - np.repeat(starts.astype(U64), np.diff(starts, append=len(flat)))
            terms = np.add.reduceat(mix(flat + U64(1) + (place << U64(32))), starts)
        else:
            terms = np.empty(0, U64)
        at = np.searchsorted(starts, edges).tolist()
        out += [terms[i:j] for i, j in zip(at, at[1:], strict=False)]
    return out


def encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, ids, n, words, near): token ids with the end id, number of words, and a place near texts with
    the same smallest word hash."""

    def run(batches):
        tok = encoder(path)
        end = np.array([end_id], tok.dtype).tobytes()
        for whole in batches:
            for batch in slices(whole, "text", ENCODE_BYTES):
                ids = [i + end for i in tok.encode(texts(batch.column("text")))]
                terms = terms_of([np.frombuffer(i, tok.dtype)[:-1] for i in ids], tok.opens)
                yield record(
                    {
                        "doc_id": (batch.column("doc_id"), pa.int64()),
                        "ids": (ids, pa.binary()),
                        "n": ([len(i) // tok.dtype.itemsize for i in ids], pa.int64()),
                        "words": ([len(t) for t in terms], pa.int64()),
                        "near": (signed(np.array([t.min() if len(t) else 0 for t in terms], U64)), pa.int64()),
                    }
                )

    rows = map_batches(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, ids binary, n long, words long, near long")
    tie = F.shiftrightunsigned(F.xxhash64("doc_id", "ids"), 64 - TIE_BITS)
    near = F.shiftleft(F.shiftright("near", TIE_BITS), TIE_BITS).bitwiseOR(tie).alias("near")
    return stored(rows.select("doc_id", "ids", "n", "words", near), "packing-ids")


def sharded(ids: DataFrame, shards: int) -> DataFrame:
    """(shard, doc_id, ids): documents cut by ``near`` into shards of about as many tokens.

    Long documents have small hashes and stand together, so a document counts once in each CUT_TOKENS.  Only
    the cuts reach the driver.
    """
    if shards == 1:
        return ids.select(F.lit(0).cast("long").alias("shard"), "doc_id", "ids")
    weighed = ids.select("near", F.explode(F.sequence(F.lit(1), F.ceil(F.col("n") / CUT_TOKENS))))
    cuts = weighed.approxQuantile("near", [k / shards for k in range(1, shards)], 1 / (16 * shards))
    cut = Bucketizer(splits=[-float("inf"), *sorted(set(cuts)), float("inf")], inputCol="place", outputCol="bucket")
    placed = cut.transform(ids.select("doc_id", "ids", F.col("near").cast("double").alias("place")))
    return placed.select(F.col("bucket").cast("long").alias("shard"), "doc_id", "ids")


def shard_terms(documents: DataFrame, path: str) -> DataFrame:
    """(shard, term, df): the terms of each shard and how many of its documents have them."""

    def run(key: tuple, shard: pa.Table) -> pa.Table:
        tok = encoder(path)
        seen = [np.unique(t) for t in terms_of([np.frombuffer(i, tok.dtype)[:-1] for i in shard.column("ids").to_pylist()], tok.opens)]
        terms, df = np.unique(np.concatenate(seen), return_counts=True)
        number = np.full(len(terms), key[0].as_py(), np.int64)
        return pa.table({"shard": number, "term": signed(terms), "df": df.astype(np.int64)})

    return documents.groupBy("shard").applyInArrow(run, "shard long, term long, df long")


def frequencies(counted: DataFrame) -> DataFrame:
    """(shard, term, df): how many documents of the whole table have a term, for each term that two of the shard have."""
    total = F.sum("inside").over(Window.partitionBy("term"))
    return counted.withColumnRenamed("df", "inside").withColumn("df", total).filter("inside > 1").select("shard", "term", "df")


class Table(NamedTuple):
    """Statistics of the whole table; ``df`` of the sorted ``terms``, terms that are not listed have one document."""

    n: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


class Shard:
    """BM25 inverted index over the word hashes of a shard's documents, weighted by the table's statistics or,
    without them, by those of the shard."""

    def __init__(self, terms: list[np.ndarray], table: Table | None = None) -> None:
        self.n = len(terms)
        owner = np.repeat(np.arange(self.n), [len(t) for t in terms])
        flat = np.concatenate(terms) if terms else np.empty(0, U64)
        order = np.argsort(flat, kind="stable")  # by term, then document
        flat, doc = flat[order], owner[order]
        opens = np.diff(flat, prepend=~flat[:1]) != 0
        term = np.cumsum(opens) - 1
        self.vocab = flat[opens]
        firsts = np.flatnonzero(opens | (np.diff(doc, prepend=-1) != 0))
        count = np.diff(firsts, append=len(flat))
        self.term, self.doc = term[firsts], doc[firsts]
        length = np.bincount(owner, minlength=self.n).astype(np.float64)
        df = np.bincount(self.term, minlength=len(self.vocab))
        total, mean, wide = self.n, length.mean() if self.n else 1.0, df
        if table is not None:
            total, mean, wide = table.n, table.mean, df.copy()
            if len(table.terms):
                at = np.minimum(np.searchsorted(table.terms, self.vocab), len(table.terms) - 1)
                wide = np.where(table.terms[at] == self.vocab, table.df[at], df)
        idf = np.log1p((total - wide + 0.5) / (wide + 0.5))
        norm = K1 * (1 - B + B * length / max(1.0, mean))
        self.weight = idf[self.term] * count * (K1 + 1) / (count + norm[self.doc])
        self.starts = np.concatenate(([0], np.cumsum(df)))
        self.joint = self.n * self.n <= DENSE
        common = np.flatnonzero((df > 1) & (df * (COMMON if self.joint else COMMON // 4) > self.n))
        common = common[np.argsort(-df[common], kind="stable")][: DENSE // max(1, self.n)]
        self.row = np.full(len(self.vocab), -1)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n), np.float32)
        inside = self.row[self.term] >= 0
        self.dense[self.row[self.term[inside]], self.doc[inside]] = self.weight[inside]
        self.known = np.empty((0, self.n), np.float32)
        shared = np.flatnonzero(df[self.term] > 1)
        order = shared[np.argsort(self.doc[shared], kind="stable")]
        self.query_terms = self.term[order]
        self.query_starts = np.searchsorted(self.doc[order], np.arange(self.n + 1))

    def common_scores(self, seed: int, rows: np.ndarray) -> np.ndarray:
        """What the dense ``rows`` of a seed add to the scores.  Few documents have one product for all their seeds."""
        if self.joint:
            if not len(self.known):
                self.known = (self.dense > 0).astype(np.float32).T @ self.dense
            return self.known[seed].astype(np.float64)
        out = np.zeros(self.n)
        for r in rows.tolist():
            out += self.dense[r]
        return out

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents for all terms of the seed that another document has."""
        terms = self.query_terms[self.query_starts[seed] : self.query_starts[seed + 1]]
        row = self.row[terms]
        out = self.common_scores(seed, row[row >= 0])
        terms = terms[row < 0]
        if not len(terms):
            return out
        first, size = self.starts[terms], self.starts[terms + 1] - self.starts[terms]
        at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
        return out + np.bincount(self.doc[at], self.weight[at], self.n)


def pack(lengths: list[int], shard: Shard, window: int = WINDOW) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of every piece; each id is in exactly one piece."""
    unused, left = np.ones(len(lengths), bool), list(lengths)
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence, fill, first, cut = 0, 0, 0, None
    queue: list[int] = []
    while True:
        if cut is not None:
            doc, cut = cut, None
        else:
            while queue and not unused[queue[-1]]:
                queue.pop()
            if queue:
                doc = queue.pop()
            else:
                while first < len(lengths) and not unused[first]:
                    first += 1
                if first == len(lengths):
                    break
                doc = first
            unused[doc] = False
        if fill == 0 and left[doc] <= window:  # this document seeds the window; a longer one fills it alone
            score = np.where(unused, shard.scores(doc), 0)
            need = np.flatnonzero(score > 0)
            queue = need[np.argsort(score[need], kind="stable")].tolist()
        take = min(left[doc], window - fill)
        if take:
            pieces.append((doc, lengths[doc] - left[doc], take, sequence, fill))
        left[doc] -= take
        fill += take
        if left[doc]:
            cut = doc
        if fill == window:
            sequence, fill = sequence + 1, 0
    return _cut_last(pieces, sequence, fill)


def _cut_last(pieces: list[tuple], sequence: int, fill: int) -> list[tuple]:
    """The open window ``sequence`` of ``fill`` ids as sequences of power-of-two lengths."""
    if not fill:
        return pieces
    done = [p for p in pieces if p[3] != sequence]
    edges, at = [], 0
    for bit in range(fill.bit_length() - 1, -1, -1):
        if fill >> bit & 1:
            edges.append((at, at + (1 << bit)))
            at += 1 << bit
    for doc, start, length, _, offset in (p for p in pieces if p[3] == sequence):
        for k, (a, b) in enumerate(edges):
            low, high = max(a, offset), min(b, offset + length)
            if low < high:
                done.append((doc, start + low - offset, high - low, sequence + k, low - a))
    return done


PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


def pack_documents(docs: DataFrame, path: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """All documents cut into pieces of sequences of at most ``window`` ids; one row per piece.

    Null and empty texts are the end id alone.  Repeated rows and ids are packed each for itself, null ids
    stay null, a long text runs through as many windows as it needs, an empty table gives no row, and
    further columns are ignored.  ``sequence_id`` is the shard's number and the sequence's in it.
    """
    spark = docs.sparkSession
    ids = encode(docs, path, end_id)
    release(spark)
    documents = sharded(ids, parts_for(ids, "n", SHARD_TOKENS))
    terms_at = scratch(spark, "packing-terms")
    known = stored(frequencies(stored(shard_terms(documents, path), "packing-terms", terms_at)), "packing-df")
    drop_scratch(spark, terms_at)
    release(spark)
    size, words = ids.agg(F.count(F.lit(1)), F.sum("words")).first()
    mean = (words or 0) / max(1, size)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        tok: Encoder = encoder(path)
        rows = sorted(
            ((np.frombuffer(i, tok.dtype), d) for d, i in zip(*(left.column(c).to_pylist() for c in ("doc_id", "ids")), strict=True)),
            key=lambda r: (r[1] is not None, r[1] or 0, len(r[0]), r[0].tobytes()),
        )
        held, keys = [r[0] for r in rows], [r[1] for r in rows]
        terms = terms_of([i[:-1] for i in held], tok.opens)
        near = [int(t.min().view(np.int64)) if len(t) else 0 for t in terms]
        order = sorted(range(len(held)), key=near.__getitem__)
        held, keys, terms = ([c[k] for k in order] for c in (held, keys, terms))
        listed = right.column("term").to_numpy().view(U64)
        rank = np.argsort(listed)
        shard = Shard(terms, Table(size, mean, listed[rank], right.column("df").to_numpy()[rank]))
        base = key[0].as_py() << 32
        pieces = pack([len(i) for i in held], shard, window)
        crc = [zlib.crc32(held[d][s : s + k].astype("<u4").tobytes()) for d, s, k, _, _ in pieces]
        doc, start, length, sequence, offset = (list(c) for c in zip(*pieces, strict=True))
        out = record(
            {
                "doc_id": ([keys[d] for d in doc], pa.int64()),
                "start": (start, pa.int64()),
                "length": (length, pa.int64()),
                "ids_crc32": (crc, pa.int64()),
                "doc_tokens": ([len(held[d]) for d in doc], pa.int64()),
                "sequence_id": ([base + q for q in sequence], pa.int64()),
                "offset": (offset, pa.int64()),
            }
        )
        return pa.Table.from_batches([out])

    return documents.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(run, PIECES)
