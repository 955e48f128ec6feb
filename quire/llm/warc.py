"""WARC archives of captures, and their index by an external merge.

Writing: one record per page, as a native expression; Spark's own text writer puts records into files
(records end in a blank line, which is its line separator), so archives land on any file system with
Spark's commit protocol and a lost executor leaves no half-written file. Of pages with equal payloads the
smallest id is a `response`, the others are `revisit` records that refer to it. Which rows are revisits is
settled on narrow rows; payloads stay where they are, and a revisit has none to write. Archives are rolled at a
bounded size and gzip-compressed as whole files.

Reading: every archive is parsed by its records' own lengths. Its captures, sorted by (URL key,
timestamp, page id), form one run, written to the shared folder. Runs are dealt out by key range, and each
range merges its run segments, held as columns and read row by row, with a k-way loser tree, so that ranges
in order hold one globally ordered capture history. There are as many ranges as RANGE_ROWS asks for, so a task holds about so many captures
at any size, never all of a host.

Defined cases: a null payload is empty; a null URL has an empty URL key; repeated rows share their type
(rows equal in id and payload are all responses or all revisits); the separator inside a payload is
harmless; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from itertools import islice
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm._shared import drop_keys, materialise, scratch_path, table, ticked

CRLF = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of records before an archive is rolled, on average.
ARCHIVE_BYTES = 16 << 20
#: Captures that one range of the merge holds, about.
RANGE_ROWS = 200_000
#: First capture time; a page's capture time is this plus its id in seconds, where the table has none.
EPOCH = 1_704_067_200


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of SHA-1: five hex digits are four base32 digits."""
    digest = F.sha1(data)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * k + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.upper(F.concat(*groups)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("capture:"), F.coalesce(page_id.cast("string"), F.lit(""))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _header_safe(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for char, code in ((" ", "%20"), ("\r", "%0D"), ("\n", "%0A"), ("\t", "%09")):
        out = F.replace(out, F.lit(char), F.lit(code))
    return out


def warc_records(pages: DataFrame) -> DataFrame:
    """(record): the record of each row of pages (page_id, url, payload, size, digest, first).

    first is the id it revisits, or null; a revisit needs no payload, only its size and SHA-1 in base32.
    """
    revisit = F.col("first").isNotNull()
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    when = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.coalesce(F.col("page_id").cast("long"), F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), when),
        F.concat(F.lit("WARC-Target-URI: "), _header_safe(F.col("url"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit(f"WARC-Profile: {REVISIT_PROFILE}{CRLF}WARC-Refers-To: "), record_id(F.col("first")), F.lit(f"{CRLF}X-Refers-To-Page: "), F.col("first").cast("string"))),
        F.concat(F.lit("X-Page: "), F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    ]
    return pages.select(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), block).alias("record"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> None:
    """Archives of all rows under path; payloads shorter than least_bytes are responses without revisits."""
    rows = pages.select(ticked(id_col).alias("page_id"), ticked(url_col).alias("url"), F.coalesce(ticked(payload_col).cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("key", F.monotonically_increasing_id()).withColumn("digest", base32_sha1(F.col("payload").cast("binary"))).withColumn("size", F.octet_length("payload"))
    rows = materialise(rows, "payloads")
    narrow = rows.select("key", "page_id", "url", "digest", "size")
    least = narrow.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    later = F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))
    # Adaptive execution broadcasts the repeated digests or splits the rows of a hot one; either way only narrow rows move.
    revisits = materialise(narrow.where(F.col("size") >= least_bytes).join(least, "digest").where(later & F.col("first").isNotNull()), "revisits")
    responses = drop_keys(rows, "key", revisits.select("key"))
    total = narrow.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    per_file = max(1, int(ARCHIVE_BYTES // max(1, (total.bytes or 0) // max(1, total.n) + 600)))
    fields = ["page_id", "url", "payload", "size", "digest", "first"]
    records = responses.withColumn("first", F.lit(None).cast(revisits.schema["first"].dataType)).select(*fields).unionByName(revisits.withColumn("payload", F.lit("")).select(*fields))
    warc_records(records).write.option("lineSep", CRLF * 2).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


def url_key(url: str) -> str:
    """Host labels reversed, then path and query: `com,example,www)/a?b`."""
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host = ",".join(reversed((parts.hostname or "").split(".")))
    except ValueError:
        return url.lower()
    return f"{host}){parts.path or '/'}{'?' + parts.query if parts.query else ''}".lower()


def parse_archive(data: bytes):
    """(headers, payload, offset, length) of every record of a decompressed archive, by its own lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        headers = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in data[at:end].decode("utf-8", "surrogateescape").split(CRLF)[1:])
        start = end + 4
        stop = start + int(headers["Content-Length"])
        body = data.index(b"\r\n\r\n", start) + 4
        yield headers, data[body:stop], data[start:body], at, stop - at
        at = stop + 4


RUN = pa.schema(
    [("run", pa.string()), ("seq", pa.int64()), ("key", pa.string()), ("stamp", pa.string()), ("page", pa.string()), ("url", pa.string()), ("record_type", pa.string()),
     ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("intact", pa.bool_()), ("refers_to", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
)
RUN_SQL = "run string, seq long, key string, stamp string, page string, url string, record_type string, payload_bytes long, payload_digest string, intact boolean, refers_to string, offset long, length long"


def _runs(batches):
    for b in batches:
        for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            found = []
            for h, payload, http, at, length in parse_archive(zlib.decompress(content.as_buffer(), 47)):
                stated = h["WARC-Payload-Digest"].removeprefix("sha1:")
                declared = int(http.rsplit(b"Content-Length: ", 1)[1].split(b"\r\n", 1)[0])
                if h["WARC-Type"] == "response":
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    intact, size = digest == stated and len(payload) == declared, len(payload)
                else:
                    digest, intact, size = stated, True, declared
                url = h["WARC-Target-URI"]
                found.append((url_key(url), h["WARC-Date"], h["X-Page"].zfill(20) if h["X-Page"] else "", url, h["WARC-Type"], size, digest, intact, h.get("X-Refers-To-Page"), at, length))
            found.sort()
            cols = list(zip(*found)) or [()] * 11
            yield pa.record_batch([pa.array([path] * len(found), pa.string()), pa.array(range(len(found)), pa.int64()), *[pa.array(c, f.type) for c, f in zip(cols, list(RUN)[2:], strict=True)]], schema=RUN)


class LoserTree:
    """k-way merge of sorted iterators: each inner node keeps the loser of its match, the root the winner."""

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.k = len(self.runs)
        self.head = [next(r, None) for r in self.runs]
        self.tree = [-1] * max(self.k, 1)
        for leaf in range(self.k):
            self._enter(leaf)

    def _less(self, a: int, b: int) -> bool:
        """Whether run a's head comes first; ended runs come last, equal heads by run number."""
        x, y = self.head[a], self.head[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return x < y or (x == y and a < b)

    def _enter(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            other = self.tree[node]
            if other < 0:  # the first to arrive waits for the other side
                self.tree[node] = winner
                return
            if self._less(other, winner):
                self.tree[node], winner = winner, other
            node //= 2
        self.tree[0] = winner

    def __iter__(self):
        while self.k and (w := self.tree[0]) >= 0 and self.head[w] is not None:
            yield self.head[w]
            self.head[w] = next(self.runs[w], None)
            node = (w + self.k) // 2
            while node > 0:
                if self._less(self.tree[node], w):
                    self.tree[node], w = w, self.tree[node]
                node //= 2
            self.tree[0] = w


def _rows_of(slices: list[pa.RecordBatch], some: int = 256):
    """The rows of a run segment as tuples behind their sort keys, made as they are taken."""
    for b in slices:
        for at in range(0, b.num_rows, some):
            for row in zip(*[c.to_pylist() for c in b.slice(at, some).columns]):
                yield (*row[2:5], *row)


def _merge(batches):
    from pyspark import TaskContext

    part, segments, last = TaskContext.get().partitionId(), [], None
    for b in batches:
        runs = b.column(0).to_pylist()
        cuts = [0, *(k for k in range(1, len(runs)) if runs[k] != runs[k - 1]), len(runs)]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if start < end:
                if runs[start] != last:
                    last = runs[start]
                    segments.append([])
                segments[-1].append(b.slice(start, end - start))
    names = ["part", "position", *RUN.names]
    merged, position = iter(LoserTree([_rows_of(s) for s in segments])), 0
    while rows := list(islice(merged, 10_000)):
        cols = list(zip(*[r[3:] for r in rows]))
        yield pa.record_batch([pa.array([part] * len(rows), pa.int32()), pa.array(range(position, position + len(rows)), pa.int64()), *[pa.array(c, f.type) for c, f in zip(cols, RUN, strict=True)]], names=names)
        position += len(rows)


def capture_index(spark, path: str) -> DataFrame:
    """The captures under path, globally ordered by (key, stamp, page): order of (part, position).

    A scan task takes whole archives up to spark.sql.files.maxPartitionBytes, which bounds its memory.
    """
    archives = spark.read.format("binaryFile").load(path).select("path", "content")
    runs = materialise(archives.mapInArrow(_runs, RUN_SQL), "runs")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // RANGE_ROWS))
    dealt = runs.repartitionByRange(parts, "key", "stamp", "page", "run", "seq").sortWithinPartitions("run", "seq")
    return dealt.mapInArrow(_merge, "part int, position long, " + RUN_SQL)


def op8_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = scratch_path(spark, "archives")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType
    found = capture_index(spark, path)
    page = F.when(F.col("page") != "", F.col("page")).cast(kind)
    return found.select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to"))
