"""WARC archives of captures, and their index merged into ordered histories.

Writing: of captures with equal payloads of at least ``least_bytes`` the one with
the largest id is the response, and the others revisit it.  Records are written
by Spark's text writer, one gzip file a task, with the record separator of the
format; nothing of a payload passes the driver.

Reading: each archive is parsed as a stream and yields one locally sorted run of
index rows (URL key, time, id).  ``merge_runs`` cuts each run at the bounds of ranges of that
key, so that a range gets one packed, sorted slice of each run, and merges the slices
by a loser tree, reading them in turn; ranges follow each other, so the whole is
ordered, and ``history`` numbers the captures of a URL.  Bounds are drawn from a sample of
at most ``BOUND_ROWS`` rows, which only balances the ranges: every row is merged.

Defined cases: a null payload is empty; a null URL has the empty key; equal rows
(same id, too) each have a record, and rows of the largest id are all responses;
a null id is written as ``-`` and never named by a revisit; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, settle, shuffle_width

LEAST_BYTES = 1000
#: Records of an archive at most; an archive is read as one value.
RECORDS = 20_000
#: Rows that the bounds of ranges are drawn from, rows of a packed batch, and of a slice at most.
BOUND_ROWS, SLICE_ROWS, MOST_SLICE_ROWS = 20_000, 4096, 1 << 16
#: Captures without a time of their own are taken to be a second apart from here on.
EPOCH = "2024-01-01 00:00:00"
BREAK = "\r\n"


def url_key(url: Column) -> Column:
    """Host labels reversed and comma-joined, then ')' and the rest, in lower case: captures of a site sort together."""
    u = F.lower(F.coalesce(url.cast("string"), F.lit("")))
    bare = F.regexp_replace(u, r"^[a-z][a-z0-9+.-]*://(www\d*\.)?", "")
    host = F.regexp_extract(bare, r"^([^/:?#]*)", 1)
    rest = F.regexp_replace(F.substring(bare, F.length(host) + 1, F.length(bare)), r"^:\d+", "")
    return F.when(u == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def decided(captures: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(id, url, payload, time) with ``n_bytes sha1 refers``: null for a response, else the response's id."""
    body = F.coalesce(F.col("payload").cast("string"), F.lit(""))
    rows = captures.withColumn("payload", body).withColumns({"n_bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1(F.col("payload").cast("binary"))})
    # a row for each payload that occurs twice; a frequent payload is one row a task before the shuffle
    often = rows.where(F.col("n_bytes") >= least_bytes).groupBy(F.col("sha1").alias("often")).agg(F.max("id").alias("newest"), F.count(F.lit(1)).alias("n")).where("n > 1 and newest is not null").drop("n")
    # written, so that its size is known: payloads move only if very many occur twice
    joined = rows.join(settle(often, "warc-often"), (F.col("sha1") == F.col("often")) & (F.col("n_bytes") >= least_bytes), "left")
    return joined.withColumn("refers", F.when(F.col("id").eqNullSafe(F.col("newest")), F.lit(None).cast("long")).otherwise(F.col("newest"))).drop("often", "newest")


def record_uri(id_: Column) -> Column:
    return F.concat(F.lit("<urn:capture:"), F.coalesce(id_.cast("string"), F.lit("-")), F.lit(">"))


def records(rows: DataFrame) -> DataFrame:
    """One column, ``value``: a WARC/1.1 record up to its final separator."""
    revisit = F.col("refers").isNotNull()
    block = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))
    safe_url = F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), r"[\r\n]", " ")
    head = F.concat(
        F.lit("WARC/1.1" + BREAK),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_uri(F.col("id"))),
        line("WARC-Date", F.date_format("time", "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", safe_url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("X-Payload-Length", F.col("n_bytes").cast("string")),
        line("X-URL-Key", F.regexp_replace("key", r"[\r\n]", " ")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", record_uri(F.col("refers"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit(BREAK),
    )
    return rows.select(F.concat(head, block).alias("value"))


def write_archives(captures: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write (id, url, payload, time) captures to gzip WARC files under ``path``."""
    rows = decided(captures, least_bytes).withColumn("key", url_key(F.col("url")))
    records(rows).write.option("maxRecordsPerFile", RECORDS).option("lineSep", BREAK * 2).option("compression", "gzip").text(path)


HEADER = re.compile(rb"([^:\r\n]+): ?([^\r\n]*)\r\n")


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset in the unpacked stream, headers, block) of each record of an archive given in parts."""
    held, offset = bytearray(), 0
    more = True

    def fill(n: int) -> bool:
        nonlocal more
        while len(held) < n and more:
            part = next(chunks, None)
            if part is None:
                more = False
            else:
                held.extend(part)
        return len(held) >= n

    while fill(1):
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not fill(len(held) + 1):
                raise ValueError("the archive ends within a record's headers")
        head = {k.decode(): v.decode() for k, v in HEADER.findall(bytes(held[: end + 2]))}
        size = end + 4 + int(head["Content-Length"])
        if not fill(size + 4):
            raise ValueError("the archive ends within a record")
        yield offset, head, bytes(held[end + 4 : size])
        del held[: size + 4]
        offset += size + 4


def unpacked(data: bytes) -> Iterator[bytes]:
    """The content of gzip members in turn, in parts of about a MiB."""
    while data:
        member = zlib.decompressobj(31)
        rest = data
        while rest and not member.eof:
            yield member.decompress(rest, 1 << 20)
            rest = member.unconsumed_tail
        data = member.unused_data


RUN = "run string, url_key string, time string, id long, n_bytes long, sha1 string, type string, refers long, offset long, size long"


def _archive_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import hashlib

    schema = pa.schema([("run", pa.string()), ("url_key", pa.string()), ("time", pa.string()), ("id", pa.int64()), ("n_bytes", pa.int64()), ("sha1", pa.string()), ("type", pa.string()), ("refers", pa.int64()), ("offset", pa.int64()), ("size", pa.int64())])

    def number(uri: str | None) -> int | None:
        value = (uri or "-").removeprefix("<urn:capture:").removesuffix(">")
        return None if value == "-" else int(value)

    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            rows = []
            for offset, head, block in parse(unpacked(content.as_py())):
                kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                n_bytes = int(head["X-Payload-Length"])
                if kind == "response" and (len(block) != n_bytes or hashlib.sha1(block).hexdigest() != digest):
                    raise ValueError(f"the payload at {offset} of {path.as_py()} does not match its headers")
                rows.append((path.as_py(), head["X-URL-Key"], head["WARC-Date"], number(head["WARC-Record-ID"]), n_bytes, digest, kind, number(head.get("WARC-Refers-To")), offset, len(block)))
            rows.sort(key=_order)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _order(row: tuple) -> tuple:
    """URL key in UTF-8, time, id with null first, then place."""
    return row[1].encode(), row[2], row[3] is not None, row[3] or 0, row[0], row[8]


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Index rows of every archive under ``path``; each archive's rows are one sorted run."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("path"), "content")
    return files.mapInArrow(_archive_runs, RUN)


class LoserTree:
    """The least head of k sorted runs: a replay costs one comparison a level."""

    def __init__(self, runs: list[Iterator], key):
        self.key, self.runs = key, runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.keys = [None if h is None else key(h) for h in self.heads]
        self.tree = [-1] * self.k
        for i in range(self.k):
            self._replay(i)

    def _less(self, a: int, b: int) -> bool:
        ka, kb = self.keys[a], self.keys[b]
        if ka is None or kb is None:
            return kb is None and (ka is not None or a < b)
        return ka < kb or (ka == kb and a < b)

    def _replay(self, winner: int) -> None:
        node = (winner + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while (w := self.tree[0]) >= 0 and self.heads[w] is not None:
            yield self.heads[w]
            self.heads[w] = next(self.runs[w], None)
            self.keys[w] = None if self.heads[w] is None else self.key(self.heads[w])
            self._replay(w)


SLICES = "part long, run string, slice long, rows binary"


def _pack_slice(part: int, run: str, number: int, rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        for a in range(0, len(rows), SLICE_ROWS):
            out.write_batch(pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[a : a + SLICE_ROWS]), schema)], schema=schema))
    return pa.RecordBatch.from_pydict({"part": [part], "run": [run], "slice": [number], "rows": [sink.getvalue().to_pybytes()]}, schema=pa.schema([("part", pa.int64()), ("run", pa.string()), ("slice", pa.int64()), ("rows", pa.binary())]))


def _cut_runs(bounds: list[tuple]):
    """Slices of sorted runs at the bounds; rows come in the order of their run, and a slice is closed where that order ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at, last, number = (None, None), None, 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                key = _order(row)
                here = (bisect_right(bounds, key), row[0])
                if held and (here != at or key < last or len(held) >= MOST_SLICE_ROWS):
                    yield _pack_slice(*at, number, held, batch.schema)
                    held, number = [], number + 1
                held.append(row)
                at, last = here, key
        if held:
            yield _pack_slice(*at, number, held, batch.schema)

    return run


def _unpacked_rows(data: bytes) -> Iterator[tuple]:
    for batch in pa.ipc.open_stream(data):
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _merge_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed slices in order of their range: each range merged by key, time, id."""

    def merged(slices: list[bytes]) -> Iterator[pa.RecordBatch]:
        schema = pa.ipc.open_stream(slices[0]).schema
        out: list[tuple] = []
        for row in LoserTree([_unpacked_rows(x) for x in slices], _order):
            out.append(row)
            if len(out) == SLICE_ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)

    held: list[bytes] = []
    part = None
    for batch in batches:
        for p, rows in zip(batch.column("part").to_pylist(), batch.column("rows")):
            if held and p != part:
                yield from merged(held)
                held = []
            part = p
            held.append(rows.as_py())
    if held:
        yield from merged(held)


def range_bounds(runs: DataFrame, width: int) -> list[tuple]:
    """At most ``width - 1`` ascending keys that part a bounded sample evenly; the same for the same rows."""
    spread = F.xxhash64("run", "offset")
    some = runs.orderBy(spread).select(*(f.split()[0] for f in RUN.split(", "))).limit(BOUND_ROWS).collect()
    keys = sorted(_order(tuple(r)) for r in some)
    return sorted({keys[len(keys) * k // width] for k in range(1, width)}) if keys else []


def merge_runs(runs: DataFrame, width: int | None = None) -> DataFrame:
    """The rows of all runs in order of (url_key, time, id), range after range.

    Range bounds are over the whole key, which ends with the id and the place, so
    that a URL or a host with many captures is split like any other rows.  What is
    shuffled and put in order is packed slices, a row for each run and range.
    """
    width = width or 4 * shuffle_width(runs.sparkSession)
    bounds = range_bounds(runs, width)
    slices = runs.mapInArrow(_cut_runs(bounds), SLICES)
    return slices.repartitionById(width, F.col("part").cast("int")).sortWithinPartitions("part").mapInArrow(_merge_slices, RUN)


def capture_index(captures: DataFrame, least_bytes: int = LEAST_BYTES, path: str | None = None) -> DataFrame:
    """Write (id, url, payload, time) captures to archives, read them back, and merge their index."""
    spark = captures.sparkSession
    path = path or fresh_path(spark, "warc")
    write_archives(captures, path, least_bytes)
    # ranges are drawn from a sample of the runs: archives are parsed once, not once more for it
    return merge_runs(settle(read_archives(spark, path), "warc-runs"))


def histories(index: DataFrame) -> DataFrame:
    """Number the captures of each URL in time, from 1."""
    return index.withColumn("capture", F.row_number().over(Window.partitionBy("url_key").orderBy("time", "id", "run", "offset")))


def captures_of(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", time_column: str | None = None) -> DataFrame:
    """(id, url, payload, time) of a table of pages; times follow the ids where there is no such column."""
    id_ = F.col(id_column).cast("long")
    time = F.col(time_column).cast("timestamp") if time_column else F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + F.pmod(F.coalesce(id_, F.lit(0)), F.lit(86400 * 36500)))
    return pages.select(id_.alias("id"), F.col(url_column).cast("string").alias("url"), F.col(payload_column).cast("string").alias("payload"), time.alias("time"))
