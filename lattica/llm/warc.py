"""WARC archives with a two-level capture index.

Records go to one gzip member each, in the order of their reversed-host URL keys, so every archive covers a range of keys.
Beside it lies its index: lines of key and place, in order, in compressed blocks, and a sparse directory with each block's
first key. A look-up binary-searches the directory, unpacks one block, binary-searches it, and range-reads the records. The
round trip asks for every key that the pages have, so what it returns has come through that search.

Of the records whose payloads are equal and at least `least` bytes long, that with the largest page_id is the response and
the others are revisits of it. A null payload is empty; a very long one is one record, in memory whole; ids are cast to bigint, and one
that is no number raises; a null url is the empty one; null ids are smaller than any other
and their records hold no id; rows of one id and payload each get a record (of tied responses all are); an empty table gives
no archives; extra columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import re
import struct
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, partitions_for, put, shared_dir, staged, tune

BLOCK_LINES, DATE = 512, "2024-01-01T00:00:00Z"
#: Bytes of an archive before a new one is begun: bounds a task's memory.
ARCHIVE_BYTES = 32 << 20
#: Bytes of payload in a range partition, about.
PART_BYTES = 64 << 20
#: First keys of archives that the driver holds, about, whatever the input: they part the keys before archives are sought.
FENCES = 1 << 14
#: Records of a batch that a look-up gives out, and bytes of payload after which it ends early.
BATCH, BATCH_BYTES = 512, 8 << 20


#: Host, and path with query, of a URL with a scheme. Patterns that Python and Spark read alike.
HOST, PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)"


def url_key(url: str) -> str:
    """Host labels reversed and comma-joined, then path and query, as sort key: org,example)/a?b. A text without a scheme is its own key."""
    host, rest = re.search(HOST, url), re.search(PATH, url)
    if not host:
        return url
    path = rest[1] if rest[1].startswith("/") else f"/{rest[1]}"
    return ",".join(reversed(host[1].lower().split("."))) + ")" + path


def key_column(url: F.Column) -> F.Column:
    """url_key() as a column."""
    host, rest = F.regexp_extract(url, HOST, 1), F.regexp_extract(url, PATH, 1)
    path = F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))
    return F.when(url.rlike(HOST), F.concat(F.array_join(F.reverse(F.split(F.lower(host), "[.]")), ","), F.lit(")"), path)).otherwise(url)


def record_id(page_id: int | None) -> str:
    """A UUID that spells the page's id as 64 bits; another variant stands for no id."""
    h = f"{(page_id or 0) & (1 << 64) - 1:016x}"
    return f"<urn:uuid:{h[:8]}-{h[8:12]}-{4000 + (page_id is not None)}-8000-00000000{h[12:]}>"


def page_of(record: str) -> int | None:
    m = re.fullmatch(r"<urn:uuid:(\w{8})-(\w{4})-4001-8000-\w{8}(\w{4})>", record)
    if not m:
        return None
    n = int("".join(m.groups()), 16)
    return n - (1 << 64) if n >> 63 else n


def record(page_id: int | None, url: str, payload: bytes | None, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP head alone. digest: hex SHA-1 of the full payload."""
    revisit = refers_to is not None
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = head + (b"" if revisit else payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {re.sub(r'[\r\n]', '', url)}"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(body)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> dict:
    """Headers, payload, and what the query asks of a record; checks a response's digest."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    http, _, payload = rest[: int(headers["Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    kind = headers["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged record {headers['WARC-Record-ID']}")
    return {"page_id": page_of(headers["WARC-Record-ID"]), "url": headers["WARC-Target-URI"], "payload": payload, "payload_bytes": size, "payload_digest": digest, "record_type": kind, "refers_to": page_of(headers.get("WARC-Refers-To", ""))}


def index_file(lines: list[tuple[str, int, int]]) -> bytes:
    """lines: (key, offset, length), sorted. Blocks, then the directory, then its length."""
    blocks, directory, at = [], [], 0
    for i in range(0, len(lines), BLOCK_LINES):
        raw = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False) for x in lines[i : i + BLOCK_LINES]).encode("utf-8", "surrogatepass"))
        blocks.append(raw)
        directory.append((lines[i][0], at, len(raw)))
        at += len(raw)
    tail = zlib.compress(json.dumps(directory).encode())
    return b"".join([*blocks, tail, struct.pack("<QI", at, len(tail))])


class Archive:
    """An archive opened through its index."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.data, self.index = fs.open_input_file(path), fs.open_input_file(f"{path}.cdx")
        size = self.index.size()
        at, n = struct.unpack("<QI", self.index.read_at(12, size - 12))
        self.directory = [tuple(x) for x in json.loads(zlib.decompress(self.index.read_at(n, at)))]
        self.keys = [x[0] for x in self.directory]

        self.at, self.lines = -1, []

    def block(self, k: int) -> list[tuple[str, int, int]]:
        """The lines of a block; the last one unpacked is kept, for keys that come in order."""
        if k != self.at:
            _, at, n = self.directory[k]
            raw = zlib.decompress(self.index.read_at(n, at)).decode("utf-8", "surrogatepass")
            self.at, self.lines = k, [tuple(json.loads(x)) for x in raw.split("\n")]
        return self.lines

    def read(self, offset: int, length: int) -> dict:
        return parse(zlib.decompress(self.data.read_at(length, offset), 31))

    def records(self, key: str) -> Iterator[dict]:
        """The records of a key: the directory is searched, then the blocks that may hold it."""
        k = max(0, bisect.bisect_left(self.keys, key) - 1)
        while k < len(self.keys) and self.keys[k] <= key:
            lines = self.block(k)
            for i in range(bisect.bisect_left(lines, (key,)), len(lines)):
                if lines[i][0] != key:
                    break
                yield self.read(*lines[i][1:])
            k += 1

    def look_up(self, url: str) -> list[dict]:
        return list(self.records(url_key(url)))

    def close(self) -> None:
        self.data.close()
        self.index.close()


def revisit_marks(pages: DataFrame, least: int = 1000) -> DataFrame:
    """(key, page_id, digest, refers_to) of the revisits. Payloads are not shuffled; the join is one that AQE may split."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.where(F.octet_length(html) >= least).select(F.col("page_id").cast("bigint").alias("page_id"), key_column(F.coalesce(F.col("url").cast("string"), F.lit(""))).alias("key"), F.sha1(html).alias("digest"))
    lead = rows.groupBy("digest").agg(F.max("page_id").alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("lead_digest"), "lead")
    return rows.join(lead, F.col("digest") == F.col("lead_digest")).where("NOT (page_id <=> lead)").select("key", "page_id", "digest", F.col("lead").alias("refers_to"))


def write_warc(pages: DataFrame, out: str, least: int = 1000) -> DataFrame:
    """Writes archives and indexes; their manifest (path, first_key, last_key, n_records), a table; paths are in the order of keys.

    Pages and the marks of revisits are range-partitioned together by key and id, each mark before its page: payloads
    are shuffled once.
    """
    spark = pages.sparkSession
    tune(spark)
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    whole = pages.select(key_column(url).alias("key"), F.col("page_id").cast("bigint").alias("page_id"), F.lit(1).alias("is_page"), F.lit(None).cast("string").alias("digest"), F.lit(None).cast("bigint").alias("refers_to"), url.alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("payload"))
    marks = revisit_marks(pages, least).select("key", "page_id", F.lit(0).alias("is_page"), "digest", "refers_to", F.lit("").alias("url"), F.lit("").alias("payload"))
    told = pa.schema([("path", pa.string()), ("first_key", pa.string()), ("last_key", pa.string()), ("n_records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, piece, body, lines, at = TaskContext.get().partitionId(), 0, [], [], 0
        place, marked = None, {}

        def flush() -> pa.RecordBatch:
            path = f"{out}/part-{part:06d}-{piece:04d}.warc.gz"
            put(f"{path}.cdx", index_file(lines))
            put(path, b"".join(body))
            return pa.RecordBatch.from_pydict({"path": [path], "first_key": [lines[0][0]], "last_key": [lines[-1][0]], "n_records": [len(lines)]}, schema=told)

        for b in batches:
            for key, page_id, is_page, digest, refers_to, url, payload in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (key, page_id) != place:
                    place, marked = (key, page_id), {}
                if not is_page:
                    marked[digest] = refers_to
                    continue
                data = payload.encode()
                digest = hashlib.sha1(data).hexdigest()
                raw = record(page_id, url, data, digest, len(data), marked.get(digest))
                c = zlib.compressobj(4, zlib.DEFLATED, 31)
                member = c.compress(raw) + c.flush()
                lines.append((key, at, len(member)))
                body.append(member)
                at += len(member)
                if at >= ARCHIVE_BYTES:
                    yield flush()
                    body, lines, at, piece = [], [], 0, piece + 1
        if lines:
            yield flush()

    n = partitions_for(whole, "payload", PART_BYTES)
    by = [F.col("key"), F.col("page_id").asc_nulls_first()]
    made = whole.unionAll(marks).repartitionByRange(n, *by).sortWithinPartitions(*by, "is_page").mapInArrow(run, "path string, first_key string, last_key string, n_records bigint")
    return staged(made)


FIELDS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
PAYLOAD = pa.schema([("url", pa.string()), ("payload", pa.binary())])


def _fields(with_payload: bool) -> tuple[pa.Schema, str]:
    schema = pa.schema([*FIELDS, *PAYLOAD]) if with_payload else FIELDS
    return schema, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint" + (", url string, payload binary" if with_payload else "")


def _batches(records: Iterator[dict], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in records:
        held.append({f: r[f] for f in schema.names})
        size += len(r["payload"]) if "payload" in schema.names else 0
        if len(held) == BATCH or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=schema)


def read_warc(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row a record, by every line of every index block."""
    fields, schema = _fields(with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                a = Archive(path)
                yield from _batches((a.read(at, n) for k in range(len(a.directory)) for _, at, n in a.block(k)), fields)
                a.close()

    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(run, schema)


def archives_of(manifest: DataFrame, keys: DataFrame) -> DataFrame:
    """(path, key): for each of keys(key), the archives whose range of keys holds it.

    Some FENCES of the archives' first keys part the keys, so keys and archives meet by an equi-join of few archives a part. A key
    that fills many archives gives a row for each.
    """
    n = manifest.count()
    some = manifest.where(F.pmod(F.xxhash64("path"), F.lit(-(-n // FENCES) or 1)) == 0).select("first_key").distinct()
    fences = manifest.sparkSession.sparkContext.broadcast(sorted(r.first_key for r in some.collect()))

    @F.pandas_udf("int")
    def place(key: pd.Series) -> pd.Series:
        return pd.Series([bisect.bisect_right(fences.value, k) for k in key], dtype="int32")

    spans = manifest.select("path", "first_key", "last_key", place("first_key").alias("lo"), place("last_key").alias("hi"))
    spans = spans.select("path", "first_key", "last_key", F.explode(F.sequence("lo", "hi")).alias("place"))
    return keys.select("key", place("key").alias("place")).join(spans, "place").where("first_key <= key AND key <= last_key").select("path", "key")


def look_up_keys(manifest: DataFrame, keys: DataFrame, with_payload: bool = False) -> DataFrame:
    """One row a record of any of keys(key), each key once: an archive's keys come to one task in order, each is searched in its index."""
    fields, schema = _fields(with_payload)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[dict]:
            a, opened = None, None
            for b in batches:
                for path, key in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if path != opened:
                        if a:
                            a.close()
                        a, opened = Archive(path), path
                    yield from a.records(key)
            if a:
                a.close()

        yield from _batches(found(), fields)

    n = max(int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")), manifest.count())
    return archives_of(manifest, keys.select("key").distinct()).repartition(n, "path").sortWithinPartitions("path", "key").mapInArrow(run, schema)


def find_captures(manifest: DataFrame, url: str) -> list[dict]:
    """The records of a url: archives whose key range holds it, then each one's index."""
    key = F.lit(url_key(url))
    at = manifest.where((F.col("first_key") <= key) & (key <= F.col("last_key"))).select("path").collect()
    return [r for m in sorted(at) for r in Archive(m.path).look_up(url)]


def warc_round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes the pages' archives, then looks up the keys of all pages in them."""
    manifest = write_warc(pages, shared_dir(pages.sparkSession), least)
    return look_up_keys(manifest, pages.select(key_column(F.coalesce(F.col("url").cast("string"), F.lit(""))).alias("key")))
