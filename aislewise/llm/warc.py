"""Web archives: write captures as WARC files, read them back, and merge their indexes.

Files are written by Spark's text writer, whose line separator is the end mark of a WARC record.
Each file gives one locally sorted run of its index.  The runs are cut at sampled key ranges; a
task takes one range of all runs and merges them with a loser tree, so the parts in order
are one index ordered by URL key and time, and captures of one URL stand together as its history.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aislewise.llm.common import map_batches, record, scratch, stored

END = b"\r\n\r\n"
NO_ID = -(1 << 63)  # stands for a null page id inside the archives
RECORDS_PER_FILE = 1000
FIRST_CAPTURE = 1_600_000_000  # pages carry no time: their id counts seconds from here


def url_key(url: Column) -> Column:
    """Sortable key: host labels in reverse, then the path, lower-cased, without scheme, port and fragment."""
    bare = F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?|#.*$", "")
    host = F.regexp_replace(F.regexp_extract(bare, "^[^/?]*", 0), r":\d*$", "")
    rest = F.regexp_extract(bare, r"^[^/?]*(?s)(.*)$", 1)
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest)


def plan_captures(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, sha1, refers_to) per distinct page: which earlier-listed payload a record revisits.

    Among payloads that are equal and have ``min_bytes`` or more, the largest page_id is the
    response.  Only digests are grouped, and the group is an aggregate, so a payload that a third
    of all pages share costs one row per task.
    """
    html = F.coalesce("html", F.lit(""))
    small = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"),
        F.sha1(html.cast("binary")).alias("sha1"),
        F.octet_length(html).cast("long").alias("size"),
    ).distinct()
    winners = small.filter(F.col("size") >= min_bytes).groupBy("sha1").agg(F.max("page_id").alias("winner"))
    return small.join(winners, "sha1", "left").select(
        "page_id", "sha1", F.when(F.col("winner") != F.col("page_id"), F.col("winner")).alias("refers_to")
    )


def write_archives(pages: DataFrame, min_bytes: int = 0) -> str:
    """Write one record per page row; the folder of the files.  A revisit carries no payload."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("url"),
        html.alias("html"),
    )
    plan = plan_captures(pages, min_bytes)
    joined = rows.withColumn("sha1", F.sha1(F.col("html").cast("binary"))).join(plan, ["page_id", "sha1"])
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, "").otherwise(F.col("html"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value)
    head = F.concat_ws(
        "\r\n",
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.date_format(
            F.timestamp_seconds(FIRST_CAPTURE + F.pmod(F.col("page_id"), F.lit(1 << 30))), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1hex:"), F.col("sha1"))),
        F.when(revisit, line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">")))),
        F.when(revisit, line("X-Payload-Length", F.octet_length("html").cast("string"))),
        line("Content-Length", F.octet_length(body).cast("string")),
    )
    path = scratch(pages.sparkSession, "warc")
    joined.select(F.concat(head, F.lit("\r\n\r\n"), body).alias("value")).write.option("lineSep", END.decode()).option(
        "compression", "gzip"
    ).option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    return path


def parse_warc(file: bytes) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
    """Offset, length, headers and payload of each record of an uncompressed WARC file."""
    at = 0
    while at < len(file):
        cut = file.index(END, at)
        lines = file[at:cut].decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        body = file[cut + 4 : cut + 4 + size]
        stop = cut + 4 + size
        if file[stop : stop + 4] != END:
            raise ValueError(f"record at {at} does not end after its length")
        yield at, stop + 4 - at, headers, body
        at = stop + 4


def _page(urn: str | None) -> int | None:
    return None if urn is None else int(urn[len("<urn:page:") : -1])


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


RUN = (
    "run string, seq long, url string, ts string, page_id long, record_type string, refers_to long,"
    " payload_bytes long, payload_digest string, at long, length long"
)


def read_archives(spark, path: str) -> DataFrame:
    """One row per record, with the payload's size and digest taken from the bytes read.

    A revisit has them in its header, as the format has it.  A payload that does not give its header's
    digest is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                out = {k.split()[0]: [] for k in RUN.split(", ")}
                for seq, (at, length, h, body) in enumerate(parse_warc(zlib.decompress(content, 31))):
                    said = bytes.fromhex(h["WARC-Payload-Digest"].removeprefix("sha1hex:"))
                    response = h["WARC-Type"] == "response"
                    digest = hashlib.sha1(body).digest() if response else said
                    if digest != said:
                        raise ValueError(f"payload of {h['WARC-Record-ID']} is damaged")
                    row = (
                        name.rsplit("/", 1)[-1], seq, h["WARC-Target-URI"], h["WARC-Date"], _page(h["WARC-Record-ID"]),
                        h["WARC-Type"], _page(h.get("WARC-Refers-To")), len(body) if response else int(h["X-Payload-Length"]),
                        base32_sha1(digest), at, length,
                    )
                    for column, value in zip(out.values(), row, strict=True):
                        column.append(value)
                kinds = {"long": pa.int64(), "string": pa.string()}
                yield record({k.split()[0]: (out[k.split()[0]], kinds[k.split()[1]]) for k in RUN.split(", ")})

    return map_batches(files, run, RUN)


class LoserTree:
    """k sorted iterators merged: each step replays one path of lost matches, log2(k) comparisons."""

    _DONE = (1,)  # sorts after every (0, key)

    def __init__(self, runs: list[Iterator[tuple]]) -> None:
        self.runs = runs
        self.heads = [self._next(i) for i in range(len(runs))]
        self.losers = [-1] * max(1, len(runs))
        self.winner = self._play(1) if len(runs) > 1 else 0

    def _next(self, i: int) -> tuple:
        row = next(self.runs[i], None)
        return self._DONE if row is None else (0, *row)

    def _play(self, node: int) -> int:
        """Winner below ``node``; the loser of each match stays at its node."""
        k = len(self.runs)
        if node >= k:
            return node - k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if self.heads[b] < self.heads[a]:
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[self.winner] != self._DONE:
            yield self.heads[self.winner][1:]
            i = self.winner
            self.heads[i] = self._next(i)
            node = (i + len(self.runs)) // 2
            while node >= 1:
                if self.heads[self.losers[node]] < self.heads[i]:
                    i, self.losers[node] = self.losers[node], i
                node //= 2
            self.winner = i


def merge_runs(captures: DataFrame, parts: int | None = None) -> DataFrame:
    """The captures with ``url_key``, ``part`` and ``place``: part by part, place by place, in global order.

    Order: URL key, time, page id, then run and place in the run, so no two rows tie and a URL that
    holds a third of all captures is still cut into even parts.
    """
    spark = captures.sparkSession
    keys = ["url_key", "ts", "page_id", "run", "seq"]
    runs = stored(captures.withColumn("url_key", url_key(F.col("url"))).sortWithinPartitions(*keys), "runs")
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = runs.repartitionByRange(n, *keys)
    names = ranged.columns

    def run(batches):
        rows: dict[str, list[tuple]] = {}
        at = [names.index(k) for k in keys]
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in names]
            for row in zip(*columns, strict=True):
                rows.setdefault(row[names.index("run")], []).append((tuple(row[i] for i in at), row))
        for one in rows.values():
            if any(b[0] < a[0] for a, b in zip(one, one[1:], strict=False)):
                one.sort(key=lambda r: r[0])  # blocks of one run can arrive out of turn
        part, out = TaskContext.get().partitionId(), []
        for place, (_, row) in enumerate(LoserTree([iter(r) for r in rows.values()])):
            out.append((*row, part, place))
            if len(out) == 20_000:
                yield pa.RecordBatch.from_pylist([dict(zip([*names, "part", "place"], r, strict=True)) for r in out], schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip([*names, "part", "place"], r, strict=True)) for r in out], schema)

    kinds = dict(ranged.dtypes)
    schema = pa.schema(
        [(c, pa.int64() if kinds[c] == "bigint" else pa.string()) for c in names] + [("part", pa.int32()), ("place", pa.int64())]
    )
    ddl = ", ".join(f"{c} {kinds[c]}" for c in names) + ", part int, place long"
    return map_batches(ranged, run, ddl)


def histories(merged: DataFrame) -> DataFrame:
    """The merged index with ``position``, the place of a capture in the whole order.

    The table of part sizes has one row per part, however many captures there are.
    """
    index = stored(merged, "index")
    sizes = index.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return index.join(sizes.select("part", before.alias("before")), "part").withColumn("position", F.col("before") + F.col("place"))


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write, read back and index every page: one row per row of ``pages``, in a globally ordered index.

    Null html and url are empty; a null page_id is kept (as a record it sorts before all others and is
    response to its equals only if no equal has an id).  Rows that repeat the largest page_id of their
    payload are all responses.  An empty table gives no row; further columns are ignored.
    """
    path = write_archives(pages, min_bytes)
    out = histories(merge_runs(read_archives(pages.sparkSession, path)))
    null_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(
        null_id("page_id"), "payload_bytes", "payload_digest", "record_type", null_id("refers_to"),
        "url_key", "ts", "position",
    )
