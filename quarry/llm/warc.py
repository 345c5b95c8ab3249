"""WARC archives as a Spark data source, written and read by Python tasks.

Reading: files are split into byte ranges (one record per gzip member, so a
range can start anywhere); for each record only the head is inflated, then
record-type and header predicates that Spark pushed down are tested, and the
payload of a record that fails them, or that nobody asked for, is stepped over.
Members carry their compressed size in the ``sl`` extra field; members without
it are inflated to their end.

Writing: tasks write to ``_pending`` under names of their own, and the driver
moves the files of the tasks that Spark committed; retried or lost tasks leave
nothing that a reader sees.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan,
                                    GreaterThanOrEqual, In, InputPartition, StringStartsWith, WriterCommitMessage)

from quarry.llm.common import pick, scratch, prepare, stage

SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, "
          "payload_digest string, payload_length long, payload binary, file string, offset long")
SPLIT_BYTES = 32 << 20
LEAST_REVISIT = 1000
_HEAD = 4096  # bytes inflated at a time while a record's head is not complete


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


@dataclass
class Range(InputPartition):
    path: str
    start: int
    end: int  # records whose first byte lies in [start, end)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``; options: ``payload`` (false:
    the column stays null and nothing of it is inflated), ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return WarcWriter(dict(self.options), [f.name for f in schema.fields])


# ------------------------------------------------------------------ reading

_TESTS = {
    EqualTo: lambda have, want: have == want,
    In: lambda have, want: have in want,
    StringStartsWith: lambda have, want: have.startswith(want),
    GreaterThan: lambda have, want: have > want,
    GreaterThanOrEqual: lambda have, want: have >= want,
}


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = str(options.get("payload", "true")).lower() != "false"
        self.split = int(options.get("splitbytes") or options.get("splitBytes") or SPLIT_BYTES)
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if type(f) in _TESTS and column in ("record_id", "record_type", "target_uri", "refers_to", "payload_digest", "payload_length"):
                self.tests.append((column, type(f), f.value))
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        where, base = _filesystem(self.path)
        if where.get_file_info(base).type == fs.FileType.File:
            found = [where.get_file_info(base)]
        else:
            found = where.get_file_info(fs.FileSelector(base, allow_not_found=True))
        out: list[InputPartition] = []
        for f in sorted(found, key=lambda f: f.path):
            if f.base_name.endswith(".warc.gz"):
                out += [Range(f.path, a, min(a + self.split, f.size)) for a in range(0, f.size, self.split)]
            elif f.base_name.endswith(".warc") and f.size:
                out.append(Range(f.path, 0, f.size))
        return out or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if not part.path:
            return
        where, _ = _filesystem(self.path)
        with where.open_input_file(part.path) as f:
            records = _plain if part.path.endswith(".warc") else _members
            for offset, head, body in records(f, part.start, part.end):
                row = _fields(head)
                if all(row[c] is not None and _TESTS[t](row[c], v) for c, t, v in self.tests):
                    payload = None
                    if self.payload and row["record_type"] != "revisit":
                        block = body()
                        payload = block[block.find(b"\r\n\r\n") + 4:] if row["http"] else block
                    yield (row["record_id"], row["record_type"], row["target_uri"], row["refers_to"],
                           row["payload_digest"], row["payload_length"], payload, part.path, offset)


def _fields(head: bytes) -> dict:
    h = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        h[name.strip().lower()] = value.strip()
    digest = h.get("warc-payload-digest")
    length = h.get("x-payload-length")
    http = h.get("content-type", "").startswith("application/http")
    if length is None and not http:
        length = h.get("content-length")
    bare = lambda x: None if x is None else x.removeprefix("<").removesuffix(">")
    return {"record_id": bare(h.get("warc-record-id")), "record_type": h.get("warc-type"), "http": http,
            "target_uri": h.get("warc-target-uri"), "refers_to": bare(h.get("warc-refers-to")),
            "payload_digest": digest.removeprefix("sha1:") if digest else None,
            "payload_length": int(length) if length is not None and length.isdigit() else None}


def _plain(f, start: int, end: int):
    at = start
    while at < end:
        f.seek(at)
        head = b""
        while b"\r\n\r\n" not in head and (more := f.read(_HEAD)):
            head += more
        cut = head.find(b"\r\n\r\n")
        if cut < 0:
            return
        size = next((int(x.split(b":")[1]) for x in head[:cut].split(b"\r\n") if x.lower().startswith(b"content-length:")), 0)
        first = at + cut + 4

        def body(first=first, size=size) -> bytes:
            f.seek(first)
            return f.read(size)
        yield at, head[:cut], body
        at = first + size + 4


def _members(f, start: int, end: int):
    """(offset, head, function for the block) of the gzip members that start in the range."""
    f.seek(start)
    data, base = f.read(end - start), start
    at = start if start == 0 else None

    def have(upto: int) -> bool:
        nonlocal data
        while base + len(data) < upto:
            more = f.read(max(1 << 16, upto - base - len(data)))
            if not more:
                return False
            data += more
        return True

    def head_of(at: int):
        """Offset of the deflate data, size of the member or None, inflater, text so far."""
        if not have(at + 18) or data[at - base:at - base + 3] != b"\x1f\x8b\x08":
            return None
        flags, i, size = data[at - base + 3], at + 10, None
        if flags & 4:
            n = struct.unpack_from("<H", data, i - base)[0]
            if not have(i + 2 + n):
                return None
            extra = data[i + 2 - base:i + 2 + n - base]
            if extra[:4] == b"sl\x08\x00" and n >= 12:
                size = struct.unpack_from("<I", extra, 4)[0]
            i += 2 + n
        for flag in (8, 16):  # name, comment
            if flags & flag:
                while have(i + 1) and data[i - base]:
                    i += 1
                i += 1
        i += 2 * bool(flags & 2)
        inflate, text, fed = zlib.decompressobj(-15), b"", i
        try:
            while b"\r\n\r\n" not in text and not inflate.eof:
                if not inflate.unconsumed_tail:
                    if not have(fed + 1):
                        return None
                    more = data[fed - base:fed - base + _HEAD]
                    fed += len(more)
                else:
                    more = inflate.unconsumed_tail
                text += inflate.decompress(more, _HEAD)
                if not text.startswith(b"WARC/"[:len(text)]):
                    return None
        except zlib.error:
            return None
        return (i, size, inflate, text, fed) if b"\r\n\r\n" in text else None

    def rest(inflate, text: bytes, fed: int) -> tuple[bytes, int]:
        """The whole record, and where the next member starts."""
        out = [text]
        more = inflate.unconsumed_tail
        while not inflate.eof:
            if not more:
                if not have(fed + 1):
                    raise ValueError("a gzip member ends early")
                more = data[fed - base:fed - base + (1 << 16)]
                fed += len(more)
            out.append(inflate.decompress(more))
            more = inflate.unconsumed_tail
        return b"".join(out), fed - len(inflate.unused_data) + 8

    if at is None:  # the first member in the range
        i = data.find(b"\x1f\x8b\x08")
        while i >= 0 and head_of(base + i) is None:
            i = data.find(b"\x1f\x8b\x08", i + 1)
        if i < 0:
            return
        at = base + i
    while at < end:
        got = head_of(at)
        if got is None:
            if not have(at + 1):
                return
            raise ValueError(f"no record at offset {at}")
        i, size, inflate, text, fed = got
        cut = text.find(b"\r\n\r\n")
        whole: list[tuple[bytes, int]] = []

        def body() -> bytes:
            if not whole:
                whole.append(rest(inflate, text, fed))
            return whole[0][0][cut + 4:-4]
        yield at, text[:cut], body
        if size is None and not whole:
            body()
        at = at + size if size is not None else whole[0][1]


# ------------------------------------------------------------------ writing

class WarcWriter(DataSourceWriter):
    """Rows with record_id, record_type, target_uri, refers_to, payload_digest,
    payload_length and payload; a revisit's payload is not written."""

    def __init__(self, options: dict, columns: list[str]):
        self.path = options["path"].rstrip("/")
        self.level = int(options.get("level", 3))
        self.columns = columns

    def write(self, rows) -> Written:
        where, base = _filesystem(self.path)
        name, out = f"part-{uuid.uuid4().hex}.warc.gz", None
        try:
            for r in rows:
                if out is None:
                    where.create_dir(f"{base}/_pending", recursive=True)
                    out = where.open_output_stream(f"{base}/_pending/{name}", compression=None)  # members are squeezed one by one
                out.write(_member(_record(dict(zip(self.columns, r))), self.level))
        finally:
            if out is not None:
                out.close()
        return Written(name if out is not None else None)

    def commit(self, messages) -> None:
        where, base = _filesystem(self.path)
        where.create_dir(base, recursive=True)
        for m in messages:
            if m is not None and m.name:
                where.move(f"{base}/_pending/{m.name}", f"{base}/{m.name}")

    def abort(self, messages) -> None:
        where, base = _filesystem(self.path)
        for m in messages:
            if m is not None and m.name:
                where.delete_file(f"{base}/_pending/{m.name}")


def _clean(value: str) -> str:
    """A header value on one line: control characters percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def _record(r: dict) -> bytes:
    revisit = r["record_type"] == "revisit"
    payload = b"" if revisit else bytes(r["payload"] or b"")
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head = ["WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: <{_clean(r['record_id'])}>",
            "WARC-Date: 2000-01-01T00:00:00Z"]
    if r["target_uri"] is not None:
        head.append(f"WARC-Target-URI: {_clean(r['target_uri'])}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <{_clean(r['refers_to'])}>"]
    head += [f"WARC-Payload-Digest: sha1:{r['payload_digest']}", f"X-Payload-Length: {r['payload_length']}",
             "Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(payload)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + payload + b"\r\n\r\n"


def _member(record: bytes, level: int) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    packed = squeeze.compress(record) + squeeze.flush()
    size = 10 + 2 + 12 + len(packed) + 8
    return (b"\x1f\x8b\x08\x04\x00\x00\x00\x00\x00\xff" + struct.pack("<H", 12) + b"sl\x08\x00"
            + struct.pack("<II", size, len(record) & 0xFFFFFFFF) + packed
            + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF))


def register(spark: SparkSession) -> None:
    prepare(spark)
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives under ``path``.  Read anew for each set of
    filters: Spark keeps what a reader was handed for the frame it belongs to."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def write_pages(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """A record per row of ``pages`` (page_id, url, html).  Of records with
    equal payloads of ``least`` bytes or more the largest page_id's is the
    response, the others revisit it; a row that repeats that page_id is a
    response too.  Null html is an empty payload, a null url is left out, a
    null page_id is written as an empty number and never referred to."""
    spark = pages.sparkSession
    register(spark)
    p = pick(pages, page_id="long", url="string", html="string")
    p = p.withColumn("payload", F.encode(F.coalesce("html", F.lit("")), "UTF-8")).select(
        "page_id", "url", "payload", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size"))
    # only payloads met more than once: without them nothing is to be joined
    keep = (p.where(F.col("size") >= least).groupBy(F.col("digest").alias("_digest"), F.col("size").alias("_size"))
            .agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1 and keep is not null")
            .select("_digest", "_size", "keep"))
    j = p.join(stage(keep, "payloads"), (F.col("digest") == F.col("_digest")) & (F.col("size") == F.col("_size")), "left")
    revisit = F.col("keep").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keep"))
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("")))
    (j.select(urn(F.col("page_id")).alias("record_id"), F.when(revisit, "revisit").otherwise("response").alias("record_type"),
              F.col("url").alias("target_uri"), F.when(revisit, urn(F.col("keep"))).alias("refers_to"),
              F.col("digest").alias("payload_digest"), F.col("size").alias("payload_length"),
              F.when(~revisit, F.col("payload")).alias("payload"))
     .write.format("warc").mode("append").save(path))


def op1_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    write_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    page = lambda c: F.expr(f"try_cast(substring({c}, {len('urn:page:') + 1}) as bigint)")
    responses = read_warc(spark, path).where("record_type = 'response'").select(
        page("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = read_warc(spark, path, payload=False).where("record_type = 'revisit'").select(
        page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest",
        "record_type", page("refers_to").alias("refers_to"))
    return responses.unionByName(revisits)
