"""Deterministic sharded WARC writer and reader (operator 10).

Records are range-sorted by (page_id, payload digest) into shards of about equal bytes: exact prefix sums over the keys in
order give the bounds, so the same pages give the same files, and neither an outlying id nor many records of one id
fill a shard. A task streams its shard into gzip members, one per record, and rolls the file at a compressed
size. Files are written under temporary names; the manifest that Spark commits lists only those of tasks that
succeeded, a second step renames them and commits the final manifest, and readers open nothing else.
"""

from __future__ import annotations

import base64
import hashlib
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mixtide.llm._common import Tables, new_path

SHARD_BYTES = 16 << 20
ROLL_BYTES = 4 << 20
#: Shards at most: their bounds (56 bytes each) pass through the driver; beyond it shards grow.
MOST_SHARDS = 65_536
DATE = "2020-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "name string, temporary string, records long, bytes long, sha256 string"


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and path of a folder's URI, which every executor can open."""
    if ":/" not in uri:
        return fs.LocalFileSystem(), uri
    scheme, rest = uri.split(":/", 1)
    return fs.FileSystem.from_uri(f"{scheme}:///{rest.lstrip('/')}" if scheme == "file" else uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member without a time stamp."""
    head = [("WARC-Type", kind), *fields, ("WARC-Date", DATE), ("WARC-Block-Digest", f"sha1:{digest(block)}"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    coder = zlib.compressobj(5, zlib.DEFLATED, 31)
    return coder.compress(text.encode()) + coder.compress(block) + coder.compress(b"\r\n\r\n") + coder.flush()


def record_id(page_id: int | None, sha1: str, number: int) -> str:
    """A page's records are told apart by payload, equal ones by their number; number 0 of the smallest page_id is a response."""
    return f"<urn:x-page:{page_id}:{sha1}:{number}>"


def page_record(page_id: int | None, sha1: str, number: int, url: str | None, payload: bytes, refers_to: int | None, small: int) -> bytes:
    own = digest(payload)
    fields = [("WARC-Record-ID", record_id(page_id, sha1, number)), ("WARC-Payload-Digest", f"sha1:{own}"), ("Content-Type", "application/http; msgtype=response")]
    if url:
        fields.append(("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None or refers_to == page_id or len(payload) < small:
        return record("response", fields, http + payload)
    return record("revisit", [*fields, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(refers_to, sha1, 0))], http)


class _Roll:
    """Writes one shard's files, each under a temporary name, and lists them."""

    def __init__(self, out: str, shard: int, attempt: int, roll: int):
        (self.store, self.folder), self.shard, self.attempt, self.roll = filesystem(out), shard, attempt, roll
        self.done: list[tuple] = []
        self.file = None

    def open(self) -> None:
        self.name = f"pages-{self.shard:06d}-{len(self.done):04d}.warc.gz"
        self.temporary = f"_temporary/{self.name}.{self.attempt}"
        self.store.create_dir(f"{self.folder}/_temporary", recursive=True)
        self.file = self.store.open_output_stream(f"{self.folder}/{self.temporary}", compression=None)
        self.records, self.bytes, self.sha = 0, 0, hashlib.sha256()
        self.put(record("warcinfo", [("WARC-Record-ID", f"<urn:x-file:{self.name}>"), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self.records = 0

    def put(self, member: bytes) -> None:
        self.file.write(member)
        self.sha.update(member)
        self.bytes += len(member)
        self.records += 1

    def add(self, member: bytes) -> None:
        if self.file is None:
            self.open()
        self.put(member)
        if self.bytes >= self.roll:
            self.close()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.done.append((self.name, self.temporary, self.records, self.bytes, self.sha.hexdigest()))
            self.file = None


def _rows(done: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*done, strict=True)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["name", "temporary", "records", "bytes", "sha256"])


def _write(out: str, roll: int, small: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        attempt = context.taskAttemptId() if context else 0
        files, now, role, number = None, object(), None, 0
        for batch in batches:
            for shard, page_id, url, html, sha1, refers, note in zip(*(batch.column(c) for c in ("shard", "page_id", "url", "html", "sha1", "refers", "note")), strict=True):
                shard, page_id, sha1 = shard.as_py(), page_id.as_py(), sha1.as_py()
                if files is None or files.shard != shard:
                    if files is not None:
                        files.close()
                        yield _rows(files.done)
                    files = _Roll(out, shard, attempt, roll)
                if (page_id, sha1) != now:
                    now, role, number = (page_id, sha1), None, 0
                if note.as_py():  # the role of a page's payload comes before its records
                    role = refers.as_py()
                    continue
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                files.add(page_record(page_id, sha1, number, url.as_py(), payload, role, small))
                number += 1
        if files is not None:
            files.close()
            yield _rows(files.done)

    return run


def _commit(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(out)
        for batch in batches:
            for name, temporary in zip(batch.column("name").to_pylist(), batch.column("temporary").to_pylist(), strict=True):
                # a repeated task finds the file renamed already
                if store.get_file_info(f"{folder}/{temporary}").type != fs.FileType.NotFound:
                    store.move(f"{folder}/{temporary}", f"{folder}/{name}")
            yield batch

    return run


def place(page_id: Column, sha1: Column) -> Column:
    """A string that sorts as (page_id, sha1) do; null page_ids come first."""
    return F.concat(F.coalesce(F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit("")), sha1)


def shard_bounds(keys: DataFrame, shard_bytes: int, tables: Tables) -> list[str]:
    """(place, n) -> the first place of each shard of about shard_bytes, in order, by exact prefix sums of n in order of place."""
    cost = F.col("n") + 200
    ranged = tables.write(keys.repartitionByRange("place").withColumn("part", F.spark_partition_id()), "ranged")
    offsets, total = {}, 0
    for r in ranged.groupBy("part").agg(F.sum(cost).alias("n")).orderBy("part").collect():  # one row per partition
        offsets[r["part"]] = total
        total += r["n"]
    each = max(shard_bytes, total // MOST_SHARDS + 1)
    if not offsets:
        return []
    known = F.from_json(F.lit(str([offsets.get(k, 0) for k in range(max(offsets) + 1)])), "array<bigint>")
    inside = Window.partitionBy("part").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    before = F.get(known, F.col("part")) + F.coalesce(F.sum(cost).over(inside), F.lit(0))
    first = ranged.select("place", F.floor(before / each).alias("shard")).groupBy("shard").agg(F.min("place").alias("place"))
    return sorted({r["place"] for r in first.collect()})  # MOST_SHARDS rows at most


def shard_of(at: Column, bounds: list[str]) -> Column:
    """The last shard whose first place is not behind at, by halving the sorted bounds; 0 where there is none."""
    known = F.from_json(F.lit(json.dumps(bounds)), "array<string>")  # MOST_SHARDS at most
    steps = F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length())))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        behind = F.get(known, middle) > at
        step = F.struct(F.when(behind, s["low"]).otherwise(middle).alias("low"), F.when(behind, middle).otherwise(s["high"]).alias("high"))
        return F.when(s["high"] - s["low"] > 1, step).otherwise(s)

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.lit(max(1, len(bounds))).alias("high")), halve, lambda s: s["low"])


def write_warc(pages: DataFrame, out: str, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES, smallest: int = 0) -> DataFrame:
    """Write (page_id, url, html) as WARC files in the folder out; returns the committed manifest.

    Of records with equal payloads of at least smallest bytes, those of the smallest page_id are responses, the
    others revisits. Null html is an empty payload, a null url has no target header, rows with a null page_id
    are responses. Rows equal in page_id and payload come in order of url. An empty table gives an empty manifest.
    Other columns are ignored.
    """
    with Tables(pages.sparkSession) as tables:
        html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
        named = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("sha1", F.sha1("html"))
        keys = tables.write(named.select("page_id", "sha1", F.length("html").cast("long").alias("n")), "digests")
        first = keys.groupBy("sha1").agg(F.min("page_id").alias("refers"))
        roles = keys.filter("page_id is not null").join(first, "sha1").filter("page_id <> refers").select("page_id", "sha1", "refers").distinct()
        bounds = shard_bounds(keys.select(place(F.col("page_id"), F.col("sha1")).alias("place"), "n"), shard_bytes, tables)
        none = lambda t: F.lit(None).cast(t)
        rows = named.select("page_id", "url", "html", "sha1", none("long").alias("refers"), F.lit(False).alias("note"))
        notes = roles.select("page_id", none("string").alias("url"), none("binary").alias("html"), "sha1", "refers", F.lit(True).alias("note"))
        dealt = rows.unionByName(notes).withColumn("place", place(F.col("page_id"), F.col("sha1"))).withColumn("shard", shard_of(F.col("place"), bounds))
        ordered = dealt.repartitionById(max(1, len(bounds)), F.col("shard")).sortWithinPartitions("shard", "place", F.col("note").desc(), "url")
        listed = tables.write(ordered.mapInArrow(_write(out, roll_bytes, smallest), _MANIFEST), "written")
        manifest = f"{out}/manifest"
        listed.mapInArrow(_commit(out), _MANIFEST).write.parquet(manifest)
        return pages.sparkSession.read.schema(_MANIFEST).parquet(manifest)


def members(stream) -> Iterator[bytes]:
    """The gzip members of a file, read in pieces."""
    rest, decoder, parts = b"", zlib.decompressobj(31), []
    while rest or (rest := stream.read(1 << 20)):
        parts.append(decoder.decompress(rest))
        rest = decoder.unused_data
        if decoder.eof:
            yield b"".join(parts)
            decoder, parts = zlib.decompressobj(31), []
    if parts:
        raise ValueError("the file breaks off inside a record")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record; its length and block digest are checked."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    return fields, block


def _id(urn: str | None) -> int | None:
    part = urn.split(":")[2] if urn else "None"
    return None if part == "None" else int(part)


_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def _read(out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = filesystem(out)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = []
                with store.open_input_stream(f"{folder}/{name}", compression=None) as stream:
                    for member in members(stream):
                        fields, block = parse(member)
                        if fields["WARC-Type"] not in ("response", "revisit"):
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.split(b"Content-Length: ")[1].split(b"\r\n")[0])
                        own = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if fields["WARC-Type"] == "response" and (len(payload), digest(payload)) != (size, own):
                            raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
                        rows.append((_id(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), size, own, fields["WARC-Type"], _id(fields.get("WARC-Refers-To"))))
                columns = list(zip(*rows, strict=True)) or [()] * 6
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[f.split()[0] for f in _RECORD.split(", ")])

    return run


def read_warc(manifest: DataFrame, out: str) -> DataFrame:
    """The page records of the manifest's files; a file is one task's piece, streamed record by record."""
    files = manifest.select("name")
    return files.repartition(max(1, files.count())).mapInArrow(_read(out), _RECORD)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages as WARC records, read back from the files; nulls, ties and repeats as in write_warc."""
    out = new_path(spark, "warc")
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), out)
    return read_warc(manifest, out).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP10_SQL = """
with p as (select page_id, html, sha1(encode(coalesce(html, ''))) as h, octet_length(encode(coalesce(html, ''))) as n from pages),
f as (select *, min(page_id) over (partition by h) as first from p),
c as (select *, list_transform(range(8), lambda i: ('0x' || substr(h, 5 * i + 1, 5))::int) as parts from f)
select page_id, n::bigint as payload_bytes,
  array_to_string(list_transform(parts, lambda x: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((x >> s) & 31) + 1, 1)), '')), '') as payload_digest,
  case when first = page_id or page_id is null then 'response' else 'revisit' end as record_type,
  case when first <> page_id then first end as refers_to from c
"""
