"""WARC archives of captures, and a globally ordered index of them by external merge.

Writing: a record for each page, as a compressed text file whose record separator is the two line breaks that end a WARC
record, so Spark's own writer commits the files on any file system. Of records with equal payloads of at least
``revisit_bytes`` bytes, the one with the smallest page_id is a response and the others are revisits that refer to it.

Reading: a record separator is also what the archives are split at. A payload may hold one itself, so a record goes on
until it has the length that its header gives. Payload digests are recomputed and compared. Each task sorts the captures
that it reads by URL key, timestamp and id, and writes them as sorted runs of at most ``RUN_ROWS`` rows.

Merging: the runs are cut into ranges of that key of about ``MERGE_ROWS`` rows, a URL with many captures into several,
and in each range a loser tree merges the runs' pieces. The partitions of the result, in order, are the capture histories.

Defined results: a null payload is an empty one; a null URL is an empty one; line breaks in a URL are written as %0D and
%0A. A row with a null page_id is a revisit if another row with an id has its payload, else a response. Rows that repeat
a response's page_id and payload are responses too. Empty tables give empty archives. Further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.shared import bounded_batches, new_path, small_or_shuffled, stage

VERSION = "WARC/1.1\r\n"
END = "\r\n\r\n"
#: Rows of a sorted run, and of a range in which runs are merged.
RUN_ROWS = 50_000
MERGE_ROWS = 100_000
#: The first moment of the default capture times.
EPOCH = "2024-01-01 00:00:00"
CAPTURE = "url_key string, captured string, page_id bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, file string, record bigint, intact boolean"


def base32_digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a text in UTF-8: 40 bits at a time, as eight digits of base 32."""
    digest = F.sha1(payload)
    digits = F.concat(*(F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)))
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def default_time(page_id: Column) -> Column:
    """A capture time of second resolution, within a year, that follows the page's id."""
    second = F.pmod(F.coalesce(page_id.cast("long"), F.lit(0).cast("long")), F.lit(31_536_000).cast("long"))
    moment = F.expr(f"timestamp_ntz'{EPOCH}'") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), second.cast("decimal(18,6)"))
    return F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def write_archives(pages: DataFrame, path: str, payload: str = "html", page_id: str = "page_id", url: str = "url", captured: Column | None = None, revisit_bytes: int = 0) -> None:
    """Write a record for each row of ``pages`` to ``path``. ``captured``: the capture time, as WARC writes it."""
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.regexp_replace(F.regexp_replace(F.coalesce(F.col(url), F.lit("")), "\r", "%0D"), "\n", "%0A").alias("url"),
        F.coalesce(F.col(payload), F.lit("")).alias("payload"),
        (default_time(F.col(page_id)) if captured is None else captured).alias("captured"),
    )
    rows = rows.withColumn("digest", base32_digest(F.col("payload"))).withColumn("bytes", F.octet_length("payload"))
    groups = rows.filter(F.col("bytes") >= revisit_bytes).groupBy(F.col("digest").alias("copied")).agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    copied = stage(groups.filter("n > 1 AND first IS NOT NULL").select("copied", "first"), "copied-payloads")
    rows = rows.join(small_or_shuffled(copied), F.col("digest") == F.col("copied"), "left")
    revisits = F.coalesce(~F.col("page_id").eqNullSafe(F.col("first")) & F.col("first").isNotNull(), F.lit(False))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(revisits, F.lit("")).otherwise(F.col("payload")))

    def field(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))

    def record_id(number: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), number.cast("string"), F.lit(">"))

    text = F.concat(
        F.lit(VERSION),
        field("WARC-Type", F.when(revisits, F.lit("revisit")).otherwise(F.lit("response"))),
        field("WARC-Record-ID", F.coalesce(record_id(F.col("page_id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))),
        field("WARC-Date", F.col("captured")),
        field("WARC-Target-URI", F.col("url")),
        field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        field("WARC-Profile", F.when(revisits, F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        field("WARC-Refers-To", F.when(revisits, record_id(F.col("first")))),
        field("Content-Type", F.lit("application/http;msgtype=response")),
        field("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )
    rows.select(text.alias("value")).write.option("lineSep", END).option("compression", "gzip").text(path)


def url_key(url: str) -> str:
    """The host's labels from the last to the first, then what follows the host, so that a site's captures are neighbours."""
    rest = url.partition("://")[2] or url
    cut = min((k for k in map(rest.find, "/?#") if k >= 0), default=len(rest))
    host = rest[:cut].rpartition("@")[2].partition(":")[0].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (rest[cut:].partition("#")[0] or "/")


def _page(value: bytes | None) -> int | None:
    number = (value or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return int(number) if number.lstrip(b"-").isdigit() else None


def parse_record(raw: bytes) -> tuple | None:
    """The capture in a record without its version line; nothing if the record isn't complete."""
    head, blank, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n") if b": " in line)
    size = int(fields.get(b"Content-Length", b"0"))
    if not blank or len(block) < size:
        return None
    http, _, payload = block[:size].partition(b"\r\n\r\n")
    length = next((int(x[16:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length: ")), len(payload))
    digest = fields.get(b"WARC-Payload-Digest", b"").removeprefix(b"sha1:").decode()
    kind = fields.get(b"WARC-Type", b"").decode()
    intact = kind == "revisit" or (length == len(payload) and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest)
    url = fields.get(b"WARC-Target-URI", b"").decode("utf-8", "replace")
    return url_key(url), fields.get(b"WARC-Date", b"").decode(), _page(fields.get(b"WARC-Record-ID")), url, kind, length, digest, _page(fields.get(b"WARC-Refers-To")), intact


def _order(capture: tuple) -> tuple:
    """URL key, timestamp, id (none before any), then the place in the archives."""
    return capture[0], capture[1], capture[2] is not None, capture[2] or 0, capture[8], capture[9]


_names = [c.split(" ")[0] for c in CAPTURE.split(", ")]
_kinds = [{"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_()}[c.split(" ")[1]] for c in CAPTURE.split(", ")]


def _batch(captures: list[tuple], *more: pa.Array) -> pa.RecordBatch:
    columns = list(zip(*captures, strict=True)) or [[] for _ in _names]
    arrays = [pa.array(c, k) for c, k in zip(columns, _kinds, strict=True)]
    return pa.RecordBatch.from_arrays([*arrays, *more], names=[*_names, "run"][: len(arrays) + len(more)])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted runs of the captures in the records of archives; a run is named by its first capture's place."""
    held: list[tuple] = []
    file, number, waiting = None, 0, b""

    def run() -> pa.RecordBatch:
        name = f"{held[0][8]}#{held[0][9]}"
        held.sort(key=_order)
        return _batch(held, pa.array([name] * len(held)))

    for batch in batches:
        for source, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            if source != file:
                if waiting:
                    raise ValueError(f"{file}: its last record is cut off")
                file, number = source, 0
            raw = waiting + (END + VERSION).encode() + value if waiting else value.removeprefix(VERSION.encode())
            found = parse_record(raw)
            waiting = b"" if found else raw
            if found:
                held.append((*found[:8], file, number, found[8]))
                number += 1
                if len(held) >= RUN_ROWS:
                    yield run()
                    held.clear()
    if waiting:
        raise ValueError(f"{file}: its last record is cut off")
    if held:
        yield run()


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """The sorted runs of the captures in the archives at ``path``, as a staged table."""
    records = spark.read.option("lineSep", END + VERSION).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    bounded_batches(records)
    return stage(records.mapInArrow(_runs, f"{CAPTURE}, run string"), "capture-runs")


class LoserTree:
    """Merges sorted iterators. Each inner node keeps the loser of the match played there, so the next item costs one
    match for each level; equal items come in the iterators' order."""

    def __init__(self, sources: list[Iterator], key):
        self.sources, self.key, self.n = [iter(s) for s in sources], key, max(1, len(sources))
        self.heads: list[tuple | None] = [self._next(k) for k in range(len(sources))]
        self.losers = [-1] * self.n
        self.winner = self._play(1) if sources else -1

    def _next(self, k: int) -> tuple | None:
        for item in self.sources[k]:
            return self.key(item), k, item
        return None

    def _beats(self, a: int, b: int) -> bool:
        one, other = self.heads[a], self.heads[b]
        return other is None or (one is not None and one[:2] < other[:2])

    def _play(self, node: int) -> int:
        """The winner below a node; leaves follow the inner nodes."""
        if node >= self.n:
            return node - self.n
        a, b = self._play(2 * node), self._play(2 * node + 1)
        if not self._beats(a, b):
            a, b = b, a
        self.losers[node] = b
        return a

    def __iter__(self) -> Iterator:
        while self.winner >= 0 and (head := self.heads[self.winner]) is not None:
            yield head[2]
            k = self.winner
            self.heads[k] = self._next(k)
            node = (k + self.n) // 2
            while node:
                if not self._beats(k, self.losers[node]):
                    k, self.losers[node] = self.losers[node], k
                node //= 2
            self.winner = k


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the runs' pieces in one range; the input is sorted by run and, within it, as the run is."""
    pieces: dict[str, list[tuple]] = {}
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for run, *capture in zip(columns[-1], *columns[:-1], strict=True):
            pieces.setdefault(run, []).append(tuple(capture))
    out: list[tuple] = []
    for capture in LoserTree([iter(p) for _, p in sorted(pieces.items())], _order):
        out.append(capture)
        if len(out) == 10_000:
            yield _batch(out)
            out = []
    if out:
        yield _batch(out)


def merge_runs(runs: DataFrame) -> DataFrame:
    """The captures of all runs in the order of URL key, timestamp and id, over the partitions and within each."""
    key = ["url_key", "captured", "page_id", "file", "record"]
    n = 1 + runs.count() // MERGE_ROWS
    return runs.repartitionByRange(n, *key).sortWithinPartitions("run", *key).mapInArrow(_merge, CAPTURE)


def capture_histories(pages: DataFrame, path: str | None = None, revisit_bytes: int = 0, **columns: str) -> DataFrame:
    """Write ``pages`` as archives, read them back, and return their captures in global order."""
    spark = pages.sparkSession
    path = path or new_path(spark, "archives")
    write_archives(pages, path, revisit_bytes=revisit_bytes, **columns)
    return merge_runs(read_runs(spark, path))


def page_records(pages: DataFrame, revisit_bytes: int = 0, **columns: str) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return capture_histories(pages, None, revisit_bytes, **columns).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
