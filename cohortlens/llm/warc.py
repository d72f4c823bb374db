"""WARC archives of pages, and their capture index by an external merge.

Writing: one record per page, as text through Spark's writer (any file system, its
commit protocol): a WARC 1.1 record with an HTTP response block.  Of records with
equal payloads of at least ``REVISIT_BYTES`` the one with the smallest page id is
the response, the others are revisits that refer to it and carry no payload.

Reading: every archive file is parsed by record lengths; its captures, sorted by
(URL key, time, page id), are a run, and the runs are written.

Merging: a regular sample of the runs' keys gives cuts, so that a range of keys
has about ``RANGE_ROWS`` captures; each run's slice of a range travels as one row,
and a range's slices are merged by a loser tree.  Ranges follow each other, so the
positions are a global order: each URL's captures lie together in order of time.

Defined results: a null html is an empty payload; a null URL is ``urn:page:<id>``;
control characters and spaces of a URL are written as %20; rows with a repeated id
are records of their own; a null id is kept, sorts last, and is never referred to
(its copies are responses if no row with an id has the payload).  An empty table
gives no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import bisect
import datetime as dt
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import fresh_path
from .common import materialize, read_table
from .registry import register

REVISIT_BYTES = 100
FILE_RECORDS = 1000
RANGE_ROWS = 20_000
SAMPLE_STEP = 100  # every so many captures of a run give one sampled key
EPOCH = 1_700_000_000  # capture time of page 0; page n is n seconds later
SALTS = 16


def write_archives(pages: DataFrame, path: str, file_records: int = FILE_RECORDS) -> None:
    """Write ``pages`` (page_id, url, html, seconds) as gzip-compressed WARC files under ``path``."""
    payload = F.coalesce("html", F.lit(""))
    url = F.coalesce(F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(
        F.col("page_id").cast("string"), F.lit("null"))))
    pages = pages.select("page_id", url.alias("url"), payload.alias("payload"), "seconds")
    pages = pages.withColumns({"digest": F.sha2("payload", 256), "bytes": F.octet_length("payload"),
                               "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")})
    first = (pages.filter(F.col("bytes") >= REVISIT_BYTES).groupBy("digest")
             .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
             .select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")))
    pages = pages.join(first, ["digest", "salt"], "left")
    # Of repeated rows of the first id, one is the response; the salt keeps them together, so pages move once.
    nth = F.row_number().over(W.partitionBy("digest", "salt", "page_id").orderBy("url"))
    is_first = F.coalesce(F.col("first") == F.col("page_id"), F.lit(False)) & (F.col("nth") == 1)
    pages = pages.withColumn("nth", nth)
    revisit = F.col("first").isNotNull() & ~is_first

    def line(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    date = F.date_format(F.timestamp_seconds("seconds"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    record = F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))),
        line("WARC-Date", date), line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
            line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("first").cast("string"), F.lit(">"))))).otherwise(""),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))).cast("string")),
        F.lit("\r\n"), http, F.when(revisit, "").otherwise(F.col("payload")),
        F.lit("\r\n\r"))  # the writer's line end completes the record's end
    pages.select(record.alias("value")).write.option("maxRecordsPerFile", file_records).text(
        path, compression="gzip", lineSep="\n")


def records(data: bytes) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of every record of an uncompressed archive."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        size = int(headers["Content-Length"])
        yield at, headers, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def url_key(url: str) -> str:
    """Sort-friendly form: host labels reversed and joined by commas, ``)``, then path and query."""
    found = re.match(r"[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)", url)
    if not found:
        return url
    return ",".join(reversed(found[1].lower().split("."))) + ")" + found[2]


def _page(urn: str | None) -> int | None:
    number = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(number[1]) if number else None


def _capture(offset: int, headers: dict[str, str], block: bytes) -> dict:
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", head)[1])
    kind = headers["WARC-Type"]
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"record {headers['WARC-Record-ID']} is damaged")
    when = dt.datetime.strptime(headers["WARC-Date"], "%Y-%m-%dT%H:%M:%SZ").replace(tzinfo=dt.timezone.utc)
    return {"url_key": url_key(headers["WARC-Target-URI"]), "seconds": int(when.timestamp()),
            "page_id": _page(headers["WARC-Record-ID"]), "payload_bytes": size, "payload_digest": digest,
            "record_type": kind, "refers_to": _page(headers.get("WARC-Refers-To")), "offset": offset}


def _key(c: dict) -> tuple:
    return c["url_key"], c["seconds"], c["page_id"] is None, c["page_id"] or 0


_CAPTURE = pa.schema([("url_key", pa.string()), ("seconds", pa.int64()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                      ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                      ("offset", pa.int64())])
_FIELDS = ("url_key string, seconds long, page_id long, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, offset long")


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(run, place, capture fields): the sorted captures of each archive file."""
    def parse(batches):
        for batch in batches:
            for name, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                data = zlib.decompress(content, wbits=47) if name.endswith(".gz") else content
                found = sorted((_capture(*r) for r in records(data)), key=_key)
                run = pa.RecordBatch.from_pylist(found, _CAPTURE)
                head = [pa.array([name] * len(found), pa.string()), pa.array(range(len(found)), pa.int64())]
                yield pa.RecordBatch.from_arrays([*head, *run.columns], ["run", "place", *_CAPTURE.names])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(parse, f"run string, place long, {_FIELDS}")


class LoserTree:
    """Merge of sorted lists: each inner node holds the loser of its match, the winner moves up.

    After the winner's list gives its next item, only the matches on its path to
    the root are played again.
    """

    def __init__(self, runs: list[list[dict]], key=_key):
        self.runs, self.key = runs, key
        self.at = [0] * len(runs)
        self.leaves = 1
        while self.leaves < len(runs):
            self.leaves *= 2
        self.heads = [self._head(i) for i in range(self.leaves)]
        self.losers = [0] * self.leaves
        winners = [0] * self.leaves + list(range(self.leaves))
        for node in range(self.leaves - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self.heads[a] <= self.heads[b] else (b, a)
        self.winner = winners[1] if self.leaves > 1 else 0

    def _head(self, i: int) -> tuple:
        """(ended, key, run): ended lists lose against all others, ties go to the first run."""
        if i >= len(self.runs) or self.at[i] >= len(self.runs[i]):
            return (True, (), i)
        return (False, self.key(self.runs[i][self.at[i]]), i)

    def __iter__(self) -> Iterator[dict]:
        while self.runs and not self.heads[self.winner][0]:
            i = self.winner
            yield self.runs[i][self.at[i]]
            self.at[i] += 1
            self.heads[i] = self._head(i)
            node = (i + self.leaves) // 2
            while node:
                if self.heads[self.losers[node]] < self.heads[i]:
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def _every(step: int):
    """Evenly spaced rows of a sorted partition, one for every ``step`` rows."""
    def pick(batches):
        found = list(batches)
        rows = pa.Table.from_batches(found) if found else None
        n = round(rows.num_rows / step) if found else 0
        if n:
            yield from rows.take([int((j + 0.5) * rows.num_rows / n) for j in range(n)]).to_batches()
    return pick


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS, step: int = SAMPLE_STEP) -> DataFrame:
    """(range, position, run, capture fields): all captures; (range, position) is their order by key."""
    spark = runs.sparkSession
    # Regular samples of the sorted runs; the driver gets one cut per range.
    keys = [F.col("url_key"), F.col("seconds"), F.col("page_id").isNull(), F.coalesce("page_id", F.lit(0))]
    sample = runs.filter(F.col("place") % step == step // 2).select(F.struct(
        *[k.alias(f"k{i}") for i, k in enumerate(keys)]).alias("k"))
    every = max(1, range_rows // step)
    partitions = 1 + sample.count() // (16 * every)
    sorted_sample = sample.repartitionByRange(partitions, "k").sortWithinPartitions("k")
    cuts = sorted(tuple(r["k"].values()) for b in sorted_sample.mapInArrow(_every(every), sorted_sample.schema).toArrow()
                  .to_batches() for r in b.to_pylist())
    shared = spark.sparkContext.broadcast(cuts)

    def slices(batches):
        for batch in batches:
            groups: dict[tuple, list[dict]] = {}
            for c in batch.to_pylist():
                groups.setdefault((c["run"], bisect.bisect_right(shared.value, _key(c))), []).append(c)
            yield pa.RecordBatch.from_pylist(
                [{"range": r, "run": run, "captures": [{k: c[k] for k in _CAPTURE.names} for c in own]}
                 for (run, r), own in groups.items()],
                pa.schema([("range", pa.int64()), ("run", pa.string()), ("captures", pa.list_(pa.struct(list(_CAPTURE))))]))

    def merge(table):
        # A run's slice may come in several sorted pieces; each piece is a list of its own.
        rows = sorted(table.to_pylist(), key=lambda r: (r["run"], _key(r["captures"][0])))
        lists = [[{**c, "run": r["run"]} for c in r["captures"]] for r in rows]
        merged = list(LoserTree(lists))
        out = pa.Table.from_pylist(merged, pa.schema([*_CAPTURE, ("run", pa.string())]))
        n = len(merged)
        return (out.append_column("range", pa.array([rows[0]["range"]] * n, pa.int64()))
                .append_column("position", pa.array(range(n), pa.int64())))

    sliced = runs.sortWithinPartitions("run", "place").mapInArrow(
        slices, f"range long, run string, captures array<struct<{_FIELDS.replace(' ', ':').replace(',:', ', ')}>>")
    return sliced.groupBy("range").applyInArrow(merge, f"{_FIELDS}, run string, range long, position long")


def capture_index(pages: DataFrame) -> DataFrame:
    """Write ``pages`` (page_id, url, html, seconds) to archives, read them back, merge; ``capture_seq`` from 0."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(pages, path)
    merged = materialize(merge_runs(materialize(read_runs(spark, path), "warc-runs")), "warc-index")
    before = F.sum("n").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1))
    starts = (merged.groupBy("range").agg(F.count(F.lit(1)).alias("n"))  # one row per range
              .select("range", F.coalesce(before, F.lit(0)).alias("start")))
    return merged.join(starts, "range").withColumn("capture_seq", F.col("start") + F.col("position"))


SQL = r"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS payload FROM pages),
q AS (SELECT page_id, url, CAST(strlen(payload) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS lo FROM q),
k AS (SELECT *, array_to_string(list_reverse(string_split(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)', 1)), '.')), ',')
      || ')' || regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^#]*)', 2) AS url_key FROM f)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND lo < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND lo < page_id THEN lo END AS refers_to, url_key,
  row_number() OVER (ORDER BY url_key, page_id) - 1 AS capture_seq FROM k"""


@register("op2_warc_captures", SQL)
def op2_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Operator 2: all pages through WARC archives, as the merged capture index."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html").withColumn(
        "seconds", F.coalesce("page_id", F.lit(0)) + EPOCH)
    return capture_index(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key",
                                       F.col("capture_seq").cast("long").alias("capture_seq"))
