"""Helpers shared by the training-data operators: scratch tables, batches and word hashes."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aislewise.session import checkpoint_dir

U64 = np.uint64
BATCH_CONF, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 32 << 20
CLEAN_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
WORD_CACHE = 400_000  # words a worker keeps hashed; later words are hashed each time they occur


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that every executor reaches."""
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of steps that are written and no longer referenced."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_scratch(spark: SparkSession, path: str) -> None:
    """Delete a table that was ``stored`` at ``path``, once no later step reads it."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def stored(df: DataFrame, name: str, path: str | None = None, **options: str) -> DataFrame:
    """``df`` written to the shared folder and read again: ends the lineage, survives lost executors.

    What earlier steps shuffled is let go first, and what this one shuffles as soon as it is written, so a
    chain of steps needs the disk of one.  A caller that drops the table later names its ``path``, made by
    ``scratch``; ``options`` go to the writer.
    """
    spark = df.sparkSession
    release(spark)
    path = path or scratch(spark, name)
    before = spark.conf.get(CLEAN_CONF, None)
    spark.conf.set(CLEAN_CONF, "true")
    try:
        df.write.option("compression", "zstd").options(**options).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEAN_CONF)
        else:
            spark.conf.set(CLEAN_CONF, before)
    return spark.read.schema(df.schema).parquet(path)


def parts_for(df: DataFrame, size: str, per_part: int) -> int:
    """How many parts of about ``per_part`` hold the sum of the SQL expression ``size``."""
    total = df.agg(F.sum(F.expr(size))).first()[0] or 0
    return max(1, -(-int(total) // per_part))


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with batches bounded in bytes as well as rows, for very long texts."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, None) in (None, "-1", str((1 << 31) - 1)):
        conf.set(BATCH_CONF, str(BATCH_BYTES))
    return df.mapInArrow(fn, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8 bytes, null as empty."""
    return [v or b"" for v in column.cast(pa.binary()).to_pylist()]


def texts(column: pa.Array) -> list[str]:
    return [v or "" for v in column.to_pylist()]


def slices(batch: pa.RecordBatch, column: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose ``column`` holds about ``limit`` bytes, one row at least."""
    sizes = batch.column(column).cast(pa.binary())
    return runs(batch, [len(v.as_buffer()) if v.is_valid else 0 for v in sizes], limit)


def runs(batch: pa.RecordBatch, sizes: list[int], limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` in all, one row at least."""
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def record(fields: dict[str, tuple[object, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, type=t) for v, t in fields.values()], names=list(fields))


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered up to WORD_CACHE words."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < WORD_CACHE:
            self[word] = value
        return value


_HASHES = WordHashes()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_HASHES.__getitem__, words), U64, len(words))


_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
_LOWER = np.arange(256)
_LOWER[65:91] += 32
_BYTE = np.random.default_rng(4242).integers(0, 1 << 64, 256, np.uint64)[_LOWER]
_POWER = 0xD6E8FEB86659FD93


def lowered_word_hashes(many: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of many texts, and where each text's words begin, with the end last.

    Words are cut at ASCII white space; ASCII capitals hash like small letters.  One pass over the joined
    bytes: a word's hash is the sum of its bytes' random values times powers of a constant.
    """
    flat = np.frombuffer(b" ".join([b"", *many]), np.uint8)
    solid = np.concatenate((~_SPACE[flat], [False]))
    starts = np.flatnonzero(solid[1:] & ~solid[:-1]) + 1
    text_at = np.cumsum([1 + len(t) for t in many])[: len(many)] if many else np.empty(0, np.int64)
    begins = np.searchsorted(starts, np.concatenate(([0], text_at)))
    if not len(starts):
        return np.empty(0, U64), begins
    at = np.flatnonzero(solid)
    sizes = np.diff(np.searchsorted(at, np.append(starts, len(solid))))
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(at)) - np.repeat(first, sizes)
    power = np.full(int(sizes.max()), _POWER, U64)
    power[0] = 1
    values = _BYTE[flat[at]] * np.multiply.accumulate(power)[place]
    return mix(np.add.reduceat(values, first)), begins


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit over all others."""
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return h ^ (h >> U64(32))


def shingles(h: np.ndarray, width: int) -> np.ndarray:
    """One hash per run of ``width`` word hashes, in order."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, U64)
    out = h[:n].copy()
    for k in range(1, width):
        out = out * U64(0x9E3779B97F4A7C15) + h[k : k + n]
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


def keep_rows(df: DataFrame, keep: Callable[[pa.RecordBatch], list[bool]], size: int = 4 << 20) -> DataFrame:
    """The rows of ``df``, all columns untouched, for which ``keep`` says so; it sees batches with ``text``."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", size):
                yield batch.filter(pa.array(keep(batch), pa.bool_()))

    return map_batches(df, run, df.schema)
