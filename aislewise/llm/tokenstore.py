"""Token ids in raw shard files, found by document key through a minimal perfect hash.

Files: ids of documents in ascending key order, as little-endian integers of the tokenizer's width, in
segments of a bounded size.  Index: keys are dealt to buckets by hash; each bucket holds a minimal
perfect hash (levels of bit arrays: a key sits in the first level where no other key shares its bit)
and, per slot, a stored fingerprint and the place of the ids.  A lookup is a few bit tests, a rank
and one read; a key that is not stored fails its fingerprint.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aislewise.llm.bpe import encoder
from aislewise.llm.common import U64, map_batches, mix, parts_for, record, release, slices, stored, texts

NO_ID = -(1 << 63)  # the key that stands for a null id
SHARD_BYTES = 32 << 20  # of text a shard
SEGMENT_IDS = 1 << 20
BUCKET_KEYS = 10_000
GAMMA = 1.5  # bits a key and level

SEGMENTS = "shard int, seg int, n_ids long, keys array<long>, copies array<int>, lengths array<long>, payload binary"


def write_segments(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Segments of token ids: shard by shard, segment by segment, in ascending order of doc_id.

    Rows of one id stay in one shard and are told apart by ``copy``, counted in order of their text.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), "text")
    n = parts_for(rows, "octet_length(text) + 8", SHARD_BYTES)
    ranged = rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches):
        tok = encoder(path)
        end = np.array([end_id], tok.dtype).tobytes()
        shard, seg, last, copy = TaskContext.get().partitionId(), 0, None, 0
        keys, copies, lengths, chunks, size = [], [], [], [], 0

        def segment():
            return record(
                {
                    "shard": ([shard], pa.int32()),
                    "seg": ([seg], pa.int32()),
                    "n_ids": ([sum(lengths)], pa.int64()),
                    "keys": ([keys], pa.list_(pa.int64())),
                    "copies": ([copies], pa.list_(pa.int32())),
                    "lengths": ([lengths], pa.list_(pa.int64())),
                    "payload": ([b"".join(chunks)], pa.binary()),
                }
            )

        for whole in batches:
            for batch in slices(whole, "text"):
                encoded = tok.encode(texts(batch.column("text")))
                for key, ids in zip(batch.column("doc_id").to_pylist(), encoded, strict=True):
                    copy = copy + 1 if key == last else 0
                    last = key
                    keys.append(key)
                    copies.append(copy)
                    chunks.append(ids + end)
                    lengths.append(len(chunks[-1]) // tok.dtype.itemsize)
                    size += lengths[-1]
                    if size >= SEGMENT_IDS:
                        yield segment()
                        seg, keys, copies, lengths, chunks, size = seg + 1, [], [], [], [], 0
        if keys:
            yield segment()

    return stored(map_batches(ranged, run, SEGMENTS), "token-segments")


def places(segments: DataFrame) -> DataFrame:
    """(doc_id, copy, shard, seg, at, n_tokens, start): where each document's ids stand.

    Totals are one row per segment; only the totals of whole shards meet in one task.
    """
    sizes = segments.select("shard", "seg", "n_ids")
    so_far = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select("shard", so_far(Window.orderBy("shard")).alias("base"))
    within = sizes.withColumnRenamed("n_ids", "n").select(
        "shard", "seg", so_far(Window.partitionBy("shard").orderBy("seg")).alias("before")
    )
    based = within.join(shards, "shard").select("shard", "seg", (F.col("base") + F.col("before")).alias("base"))

    def run(batches):
        for batch in batches:
            for shard, seg, base, keys, copies, lengths in zip(*(batch.column(c) for c in names), strict=True):
                n = np.array(lengths.values.to_numpy(zero_copy_only=False), np.int64)
                at = np.cumsum(n) - n
                yield record(
                    {
                        "doc_id": (keys.values, pa.int64()),
                        "copy": (copies.values, pa.int32()),
                        "shard": (np.full(len(n), shard.as_py(), np.int32), pa.int32()),
                        "seg": (np.full(len(n), seg.as_py(), np.int32), pa.int32()),
                        "at": (at, pa.int64()),
                        "n_tokens": (n, pa.int64()),
                        "start": (at + base.as_py(), pa.int64()),
                    }
                )

    names = ["shard", "seg", "base", "keys", "copies", "lengths"]
    listed = segments.select("shard", "seg", "keys", "copies", "lengths").join(based, ["shard", "seg"]).select(*names)
    return map_batches(
        listed, run, "doc_id long, copy int, shard int, seg int, at long, n_tokens long, start long"
    )


def key_hash(doc_id: np.ndarray, copy: np.ndarray) -> np.ndarray:
    return mix(doc_id.astype(np.int64).view(U64) + mix(copy.astype(np.int64).view(U64) + U64(0x9E3779B97F4A7C15)))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: ``slots`` maps each of n keys to its own number below n."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels = levels
        self.ranks = []
        base = 0
        for bits in levels:
            self.ranks.append(base + np.cumsum(bits) - bits)
            base += int(bits.sum())

    @staticmethod
    def _bit(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        seed = U64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
        return (mix(keys + seed) % U64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, left = [], keys
        while len(left):
            if len(levels) > 200:
                raise ValueError("keys repeat")
            size = max(8, int(GAMMA * len(left)))
            bit = cls._bit(left, len(levels), size)
            alone = np.bincount(bit, minlength=size) == 1
            levels.append(alone.astype(np.int64))
            left = left[~alone[bit]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 or any slot for a key that was not built in."""
        out = np.full(len(keys), -1, np.int64)
        for level, bits in enumerate(self.levels):
            todo = np.flatnonzero(out < 0)
            bit = self._bit(keys[todo], level, len(bits))
            hit = bits[bit] == 1
            out[todo[hit]] = self.ranks[level][bit[hit]]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.levels), *map(len, self.levels)], "<u4").tobytes()
        return head + b"".join(np.packbits(b.astype(np.uint8)).tobytes() for b in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n = int.from_bytes(raw[:4], "little")
        sizes = np.frombuffer(raw, "<u4", n, 4)
        at, levels = 4 + 4 * n, []
        for size in sizes.tolist():
            packed = np.frombuffer(raw, np.uint8, (size + 7) // 8, at)
            levels.append(np.unpackbits(packed, count=size).astype(np.int64))
            at += len(packed)
        return cls(levels)


SLOT = np.dtype([("print", "<u4"), ("shard", "<i4"), ("seg", "<i4"), ("at", "<i8"), ("n", "<i8"), ("start", "<i8")])
INDEX = "bucket int, n_keys long, hash binary, slots binary"


def bucket_of(buckets: int) -> F.Column:
    return F.pmod(F.xxhash64("doc_id", "copy"), F.lit(buckets)).cast("int").alias("bucket")


def build_index(found: DataFrame, buckets: int) -> DataFrame:
    """One row per bucket: the perfect hash of its keys and a fingerprinted place per slot."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        keys = key_hash(rows["doc_id"].to_numpy(), rows["copy"].to_numpy())
        perfect = PerfectHash.build(keys)
        table = np.zeros(len(keys), SLOT)
        at = perfect.slots(keys)
        table["print"][at] = (mix(keys) >> U64(32)).astype(np.uint32)
        for field, column in (("shard", "shard"), ("seg", "seg"), ("at", "at"), ("n", "n_tokens"), ("start", "start")):
            table[field][at] = rows[column].to_numpy()
        return pd.DataFrame(
            {"bucket": [int(rows["bucket"].iloc[0])], "n_keys": [len(keys)], "hash": [perfect.to_bytes()], "slots": [table.tobytes()]}
        )

    return stored(found.withColumn("bucket", bucket_of(buckets)).groupBy("bucket").applyInPandas(build, INDEX), "token-index")


def look_up(index: DataFrame, keys: DataFrame, buckets: int) -> DataFrame:
    """Places of (doc_id, copy) keys through the index; keys that are not stored give no row."""

    def find(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        out = asked[["doc_id", "copy"]]
        if rows.empty or asked.empty:
            got, known = np.zeros(len(out), SLOT), np.zeros(len(out), bool)
        else:
            hashed = key_hash(asked["doc_id"].to_numpy(), asked["copy"].to_numpy())
            table = np.frombuffer(rows["slots"].iloc[0], SLOT)
            at = PerfectHash.from_bytes(rows["hash"].iloc[0]).slots(hashed)
            got = table[np.maximum(at, 0)]
            known = (at >= 0) & (got["print"] == (mix(hashed) >> U64(32)).astype(np.uint32))
        found = {"shard": got["shard"], "seg": got["seg"], "at": got["at"], "n_tokens": got["n"], "start": got["start"]}
        return out.assign(**found)[known]

    asked = keys.withColumn("bucket", bucket_of(buckets))
    return asked.groupBy("bucket").cogroup(index.groupBy("bucket")).applyInPandas(
        find, "doc_id long, copy int, shard int, seg int, at long, n_tokens long, start long"
    )


def read_ids(segments: DataFrame, asked: DataFrame, width: int) -> DataFrame:
    """(doc_id, copy, start, n_tokens, ids_crc32) of asked places, from the stored payloads.

    A segment's requests are no more than its documents, so one segment and its requests fit a task.
    """

    def fetch(wanted: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        payload = rows["payload"].iloc[0] if len(rows) else b""
        crcs = []
        for at, n in zip(wanted["at"].tolist(), wanted["n_tokens"].tolist(), strict=True):
            ids = np.frombuffer(payload, f"<u{width}", n, at * width)
            crcs.append(zlib.crc32(ids.astype("<u4").tobytes()))
        return wanted[["doc_id", "copy", "start", "n_tokens"]].assign(ids_crc32=np.array(crcs, np.int64))

    files = segments.select("shard", "seg", "payload")
    return asked.groupBy("shard", "seg").cogroup(files.groupBy("shard", "seg")).applyInPandas(
        fetch, "doc_id long, copy int, start long, n_tokens long, ids_crc32 long"
    )


def token_store(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """Write all documents' ids, index them, and read every document back by its key.

    One row per row of ``docs``.  Null and empty texts hold the end id alone.  Rows that repeat an id are
    kept as copies, in order of their text; a null id sorts first and stays null.  An empty table
    gives no row; further columns are ignored.
    """
    spark = docs.sparkSession
    width = encoder(path).dtype.itemsize
    segments = write_segments(docs, path, end_id)
    release(spark)
    buckets = parts_for(segments, "size(keys)", BUCKET_KEYS)
    index = build_index(places(segments), buckets)
    copies = (
        docs.groupBy(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select("doc_id", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("copy"))
    )
    out = read_ids(segments, look_up(index, copies, buckets), width)
    return out.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "start", "n_tokens", "ids_crc32"
    )
