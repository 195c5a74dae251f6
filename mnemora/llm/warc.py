"""WARC archives with a two-level capture index.

Writing. Pages are dealt into ranges of their reversed-host key, and each range becomes one archive file in the shared
folder: WARC/1.0 records, a gzip member each. Payloads of at least `least` bytes that are equal (SHA-1 and size) are
stored once, with the largest page_id; the others are revisit records that name it.
Index. Each archive's captures, one text line each, are sorted by (reversed-host key, page) and cut into gzip blocks of
`lines` lines; the first key of each block goes into a sparse directory. Ranges, order and directory have one key, made
once, and ranges don't overlap, so archives in order of their range make one sorted index.
Lookup. A binary search in the directory finds the block, a binary search in the block the line, and a range read of
the archive the record. Files are written under a name of the attempt's own and named by what the task returns, so a
lost executor leaves an orphan at worst.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemora.llm.common import materialize, new_path, table

LEAST, LINES, SALT = 1000, 256, 16
VERSION = b"WARC/1.0\r\n"
_DIRECTORY = T.StructType([T.StructField(c, t) for c, t in (("part", T.IntegerType()), ("block", T.IntegerType()), ("first_key", T.StringType()), ("archive", T.StringType()), ("index", T.StringType()), ("offset", T.LongType()), ("size", T.LongType()), ("captures", T.LongType()))])


#: A URL's authority, path and query; the same pattern for Spark and Python.
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)(?::[0-9]*)?([^?#]*)(\?[^#]*)?"
_BLANK, _UPPER, _LOWER = "".join(map(chr, range(33))), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def reversed_host(url: str | None) -> str:
    """`http://a.b.org:80/x?y#z` as `org,b,a)/x?y`: A-Z of the host lower-cased, its parts from the right, no scheme, user,
    port or fragment, an empty path as `/`. What has no host is its own key, without blanks around it; null is empty."""
    url = (url or "").strip(_BLANK)
    m = re.match(_URL, url)
    if not m or not m[1]:
        return url
    return ",".join(reversed(m[1].translate(str.maketrans(_UPPER, _LOWER)).split("."))) + ")" + (m[2] or "/") + (m[3] if len(m[3] or "") > 1 else "")


def key_column(url: object) -> object:
    """reversed_host() as an expression. Archives are ranges of this key and captures are sorted by it."""
    url = F.coalesce(F.btrim(url, F.lit(_BLANK)), F.lit(""))
    host, path, query = (F.regexp_extract(url, _URL, i) for i in (1, 2, 3))
    turned = F.array_join(F.reverse(F.split(F.translate(host, _UPPER, _LOWER), r"\.", -1)), ",")
    return F.when(host == "", url).otherwise(F.concat(turned, F.lit(")"), F.when(path == "", "/").otherwise(path), F.when(F.length(query) > 1, query).otherwise("")))


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI: file:, hdfs:, s3: and others that Arrow knows."""
    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def _line_safe(text: str) -> str:
    return "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in text)


def record(page: str, url: str, payload: bytes, refers: str | None, digest: bytes, size: int) -> bytes:
    """One gzip member: a response with the payload, or a revisit with the digest of what it would hold."""
    head = [b"WARC-Type: " + (b"response" if refers is None else b"revisit"), f"WARC-Record-ID: <urn:page:{quote(page, safe='')}>".encode(), b"WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_line_safe(url)}".encode(), b"WARC-Payload-Digest: sha1:" + base64.b32encode(digest), b"X-Payload-Length: %d" % size, b"Content-Type: application/http; msgtype=response"]
    if refers is not None:
        head += [f"WARC-Refers-To: <urn:page:{quote(refers, safe='')}>".encode(), b"WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"]
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (payload if refers is None else b"")
    raw = VERSION + b"\r\n".join(head) + b"\r\nContent-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, payload) of a gzip member; sizes and, of responses, the payload digest are verified."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if lines[0] + b"\r\n" != VERSION:
        raise ValueError("not a WARC record")
    headers = {k.decode().lower(): v.decode() for k, _, v in (x.partition(b": ") for x in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    payload = rest[:size].partition(b"\r\n\r\n")[2]
    if headers["warc-type"] == "response" and base64.b32encode(hashlib.sha1(payload).digest()).decode() != headers["warc-payload-digest"].removeprefix("sha1:"):
        raise ValueError("a payload's digest is wrong")
    return headers, payload


def write_archives(df: DataFrame, page: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST, lines: int = LINES) -> DataFrame:
    """The sparse directory, one row a block: part, block, first_key, archive, index, offset, size, captures. Written once.

    Null html is an empty payload, null url an empty one; a null page can't be referred to and is always a response.
    Repeated rows with one page_id are equal copies of one capture: each is written, and refers to the first's page.
    Payloads of any length are one record (a member is made in memory); of equal payloads the largest page_id is the
    response. An empty table has an empty directory. Other columns of the input aren't used, whatever their names.
    """
    spark = df.sparkSession
    spark_root = new_path(spark, "warc")
    pages = df.select(F.col(page).alias("page"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html).cast("string"), F.lit("")).cast("binary").alias("payload"))
    pages = pages.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload").cast("long")).withColumn("key", key_column(F.col("url")))
    # small pre-aggregated rows; hot digests meet their copies salted
    small = pages.where((F.col("size") >= least) & F.col("page").isNotNull()).select("digest", "size", "page", "key")
    twice = small.groupBy("digest", "size").agg(F.max("page").alias("best"), F.count("*").alias("c")).where("c > 1")
    twice = twice.select(F.col("digest").alias("d2"), F.col("size").alias("s2"), "best", F.explode(F.array(*[F.lit(i) for i in range(SALT)])).alias("salt2"))
    refers = small.withColumn("salt", F.pmod(F.hash("page"), F.lit(SALT))).join(twice, F.expr("digest = d2 and size = s2 and salt = salt2 and page <> best"))
    # a reference travels to its page's place in the order, just before the page, so payloads are shuffled once
    kind = [F.lit(None).cast(t).alias(n) for n, t in (("url", "string"), ("payload", "binary"))]
    ahead = refers.select("key", "page", F.lit(0).cast("long").alias("tie"), F.lit(0).alias("kind"), *kind, F.col("digest"), F.col("size"), F.col("best").alias("refers")).distinct()
    tie = lambda c: F.when(F.col("page").isNull(), c).otherwise(F.lit(0).cast("long")).alias("tie")  # noqa: E731  pages without an id are spread, too
    rows = pages.select("key", "page", tie(F.monotonically_increasing_id()), F.lit(1).alias("kind"), "url", "payload", "digest", "size", F.lit(None).cast(pages.schema["page"].dataType).alias("refers"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.union(ahead).repartitionByRange(parts, "key", "page", "tie").sortWithinPartitions("key", "page", "tie", "kind").select("key", "page", "kind", "url", "payload", "digest", "size", "refers")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        captures, out, at, archive, ahead = [], None, 0, "", {}
        for b in batches:
            for key, p, kind, u, payload, digest, size, refers in zip(*[b.column(i).to_pylist() for i in range(8)], strict=True):
                if not kind:
                    ahead = {k: v for k, v in ahead.items() if k[0] == p} | {(p, digest, size): refers}
                    continue
                refers = ahead.get((p, digest, size))
                if out is None:
                    store, root = open_store(spark_root)
                    store.create_dir(root, recursive=True)
                    archive = f"{root}/part-{part:05d}-{name}.warc.gz"
                    out = store.open_output_stream(archive, compression=None)
                member = record(str(p), u, payload, None if refers is None else str(refers), digest, size)
                out.write(member)
                captures.append((key, p, at, len(member)))
                at += len(member)
        if out is None:
            return
        out.close()
        rows, offset = [], 0
        index = f"{root}/part-{part:05d}-{name}.cdx.gz"
        with store.open_output_stream(index, compression=None) as f:
            for block, a in enumerate(range(0, len(captures), lines)):
                some = captures[a : a + lines]
                text = "".join(json.dumps(c) + "\n" for c in some)
                data = gzip.compress(text.encode(), mtime=0)
                f.write(data)
                rows.append((part, block, some[0][0], archive, index, offset, len(data), len(some)))
                offset += len(data)
        cols = list(zip(*rows, strict=True))
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=_DIRECTORY.names)

    schemes = spark_root.split(":/", 1)[0] if ":/" in spark_root else "file"
    found = dealt.mapInArrow(run, _DIRECTORY)
    return materialize(found.withColumn("store", F.lit(schemes)), "warc-directory")


def _uri(store: str, path: str) -> str:
    return path if ":/" in path else f"{store}://{path}"


def read_block(store: fs.FileSystem, index: str, offset: int, size: int) -> list[list]:
    with store.open_input_file(index) as f:
        return [json.loads(x) for x in gzip.decompress(f.read_at(size, offset)).splitlines()]


def read_archives(directory: DataFrame) -> DataFrame:
    """Every capture, read through the index: page (string), key, headers' type, refers (string), digest (hex), length, payload (binary; null in revisits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                store, archive = open_store(_uri(r["store"], r["archive"]))
                _, index = open_store(_uri(r["store"], r["index"]))
                rows, size = [], 0
                with store.open_input_file(archive) as f:
                    for key, page, at, n in read_block(store, index, r["offset"], r["size"]):
                        headers, payload = parse(f.read_at(n, at))
                        revisit = headers["warc-type"] == "revisit"
                        digest = base64.b32decode(headers["warc-payload-digest"].removeprefix("sha1:")).hex()
                        rows.append((None if page is None else str(page), key, headers["warc-type"], unquote(headers["warc-refers-to"][10:-1]) if revisit else None, digest, int(headers["x-payload-length"]) if revisit else len(payload), None if revisit else payload))
                        size += len(payload)
                        if size > 8_000_000:
                            yield _captures(rows)
                            rows, size = [], 0
                if rows:
                    yield _captures(rows)

    blocks = directory.repartition(max(1, int(directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "archive", "block")
    return blocks.mapInArrow(run, "page string, key string, type string, refers string, digest string, length long, payload binary")


def _captures(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string()] * 5 + [pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page", "key", "type", "refers", "digest", "length", "payload"])


class CaptureIndex:
    """Point lookups by binary searches: of the archives' first keys (one for each partition that wrote), of the block
    directory of the archives found, of the lines of a block; then a range read of each record.

    The directory stays a table: only the archives' first keys are held, and the blocks of the archives asked last.
    """

    HELD = 64

    def __init__(self, directory: DataFrame) -> None:
        self.directory = directory
        first = directory.where("block = 0").select("first_key", "part").collect()
        self.parts = sorted((r["first_key"], r["part"]) for r in first)
        self.blocks: dict[int, list] = {}

    def _blocks(self, part: int) -> list:
        if part not in self.blocks:
            if len(self.blocks) >= self.HELD:
                self.blocks.clear()
            self.blocks[part] = self.directory.where(F.col("part") == part).orderBy("block").collect()
        return self.blocks[part]

    def lookup(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        """Headers and payloads of all captures of a URL (equal reversed-host key)."""
        key = reversed_host(url)
        at = max(0, bisect.bisect_left(self.parts, key, key=lambda x: x[0]) - 1)
        out = []
        while at < len(self.parts) and self.parts[at][0] <= key:
            blocks = self._blocks(self.parts[at][1])
            b = max(0, bisect.bisect_left(blocks, key, key=lambda r: r["first_key"]) - 1)
            while b < len(blocks) and blocks[b]["first_key"] <= key:
                r = blocks[b]
                store, index = open_store(_uri(r["store"], r["index"]))
                lines = read_block(store, index, r["offset"], r["size"])
                i = bisect.bisect_left(lines, key, key=lambda x: x[0])
                with store.open_input_file(open_store(_uri(r["store"], r["archive"]))[1]) as f:
                    while i < len(lines) and lines[i][0] == key:
                        out.append(parse(f.read_at(lines[i][3], lines[i][2])))
                        i += 1
                b += 1
            at += 1
        return out


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `pages` written to WARC archives and read back through the index."""
    directory = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    got = read_archives(directory)
    return got.select(F.col("page").cast("long").alias("page_id"), F.col("length").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("refers").cast("long").alias("refers_to"))


OP10_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
g AS (SELECT d, n, max(page_id) AS best FROM p WHERE n >= 1000 AND page_id IS NOT NULL GROUP BY d, n)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN g.best IS NULL OR p.page_id IS NULL OR g.best = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.best IS NULL OR p.page_id IS NULL OR g.best = p.page_id THEN NULL ELSE g.best END AS refers_to
FROM p LEFT JOIN g ON p.d = g.d AND p.n = g.n
"""
