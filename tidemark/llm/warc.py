"""Deterministic sharded WARC writer and its reader.

Writing: a light table of digests and sizes is made first. From it come the shards, consecutive ranges of page_id of near equal bytes, found by halving
ranges until none is too heavy (counts of ranges reach the driver, at most a few times as many as shards); and for each group of equal payloads its
first page, by an aggregate that is combined before the shuffle. Pages then are dealt to their shards, each payload once, with what says of a page that its payload is
known beside it, and sorted by page_id. A task streams its shard into record-per-member gzip files, rolls to the next file once one has `roll_bytes`
compressed, and regenerates every header and digest. So the same pages give the same files, byte for byte, however Spark has cut its input.

Committing: a task attempt writes to names of its own under `tmp/`; the rows that name them are a Spark table, so of repeated attempts one counts. A second job
renames those files (again if it is repeated: what is renamed already stays), and one rename publishes the manifest. Readers open only files of the manifest.

Equal payloads are told by SHA-256 and length. Of `min_revisit` bytes or more, that of the smallest page_id (then url) is a response and all others revisit
it; smaller ones are all responses. Null html is an empty payload; null url leaves out the header; null page_id comes first in the files and is chosen as the
response only where a group has no other. Of wholly repeated rows the first is written as the response and the rest revisit it. One page_id whose rows outgrow a shard is
split by a hash of payload and url. Other columns are not read. An empty table gives an empty manifest and no file.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from base64 import b32encode
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import ship, shared_dir, written

SHARD_BYTES, LEAST_SHARDS, ROLL_BYTES, DATE = 256 << 20, 16, 32 << 20, "1970-01-01T00:00:00Z"
#: Groups of equal payloads, the largest first, that meet their pages by a broadcast, and the longest url there: at most 8 MB.
HOT, HOT_URL = 1000, 8192
MANIFEST = "name string, staged string, records long, bytes long, sha256 string, first_page long, last_page long"
RECORD = "file string, record_type string, record_id string, page_id long, url string, payload_digest string, payload_bytes long, refers_to long, payload binary"


def _place(root: str) -> tuple[pafs.FileSystem, str]:
    """A file system that tasks can write to, and the folder there."""
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    return pafs.FileSystem.from_uri(root)


def sha1(data: bytes) -> str:
    return b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, url: str | None, digest: bytes, nth: int) -> str:
    """The same for the same page; `nth` tells wholly repeated rows apart."""
    named = hashlib.sha256(repr((page_id, url, bytes(digest), nth)).encode()).digest()
    return f"<urn:uuid:{uuid.UUID(bytes=named[:16], version=4)}>"


def _printable(url: str) -> str:
    return "".join(chr(b) if 0x21 <= b <= 0x7E else f"%{b:02X}" for b in url.encode())


def http_head(size: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()


def record(kind: str, block: bytes, **fields: object) -> bytes:
    """A WARC record; fields whose value is None are left out."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k.replace('_', '-')}: {v}" for k, v in fields.items() if v is not None), f"WARC-Block-Digest: sha1:{sha1(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, nth: int, first: tuple | None, date: str) -> bytes:
    """The record of a page: a response, or with `first` (page_id, url) a revisit of that page."""
    own = {"WARC_Record_ID": record_id(page_id, url, digest, nth), "WARC_Date": date, "WARC_Target_URI": None if url is None else _printable(url), "WARC_Payload_Digest": f"sha1:{sha1(payload)}", "Content_Type": "application/http; msgtype=response", "Page_Id": page_id}
    head = http_head(len(payload))
    if first is None:
        return record("response", head + payload, **own)
    refers = {"WARC_Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC_Refers_To": record_id(first[0], first[1], digest, 0), "WARC_Refers_To_Target_URI": None if first[1] is None else _printable(first[1]), "WARC_Refers_To_Date": date, "Refers_To_Page": first[0]}
    return record("revisit", head, **own, **refers)


class Roll:
    """A shard's files, one after another."""

    def __init__(self, files: pafs.FileSystem, folder: str, shard: int, roll_bytes: int, date: str):
        self.files, self.folder, self.shard, self.roll_bytes, self.date = files, folder, shard, roll_bytes, date
        self.attempt, self.number, self.out = uuid.uuid4().hex, 0, None
        self.done: list[tuple] = []

    def _put(self, data: bytes) -> None:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member; its header holds neither time nor name
        member = z.compress(data) + z.flush()
        self.out.write(member)
        self.digest.update(member)
        self.size += len(member)

    def add(self, page_id: int | None, data: bytes) -> None:
        if self.out is None:
            self.name = f"{self.shard:08d}-{self.number:05d}.warc.gz"
            self.staged = f"{self.folder}/tmp/{self.name}.{self.attempt}"
            self.out, self.digest, self.size, self.records, self.first = self.files.open_output_stream(self.staged, compression=None), hashlib.sha256(), 0, 0, page_id
            about = f"format: WARC File Format 1.1\r\nsoftware: tidemark\r\nfilename: {self.name}\r\n".encode()
            self._put(record("warcinfo", about, WARC_Record_ID=record_id(None, self.name, b"", 0), WARC_Date=self.date, WARC_Filename=self.name, Content_Type="application/warc-fields"))
        self._put(data)
        self.records, self.last = self.records + 1, page_id
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.done.append((self.name, self.staged, self.records, self.size, self.digest.hexdigest(), self.first, self.last))
            self.out, self.number = None, self.number + 1


def _digests(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    return rows.withColumn("digest", F.unhex(F.sha2("payload", 256))).withColumn("bytes", F.octet_length("payload").cast("long"))


def _spread() -> Column:
    return F.pmod(F.xxhash64("digest", "url"), F.lit(1 << 31))


class Shards:
    """Ranges of page_id, each a shard, or several where one page_id (or null) outgrows it."""

    def __init__(self, starts: list[int], sizes: list[int], none_bytes: int, shard_bytes: int):
        self.starts = np.array(starts, np.int64)
        # The parts of each range, nulls before them.
        self.parts = np.array([-(-none_bytes // shard_bytes), *(1 if n is None else max(1, -(-n // shard_bytes)) for n in sizes)], np.int64)
        self.first = np.cumsum(self.parts) - self.parts
        self.count = int(self.parts.sum())

    def of(self, page_id: pd.Series, spread: pd.Series) -> pd.Series:
        at = np.where(page_id.isna(), 0, np.searchsorted(self.starts, page_id.fillna(0).astype("int64").to_numpy(), side="right"))
        return pd.Series(self.first[at] + spread.to_numpy() * self.parts[at] // (1 << 31))


def plan_shards(keys: DataFrame, shard_bytes: int = SHARD_BYTES, least: int = LEAST_SHARDS) -> Shards:
    """Shards of `keys` (page_id, bytes) of at most about `shard_bytes`, and `least` of them if their pages allow."""
    size = F.sum(F.col("bytes") + 512)
    known = keys.filter("page_id is not null")
    r = known.agg(F.min("page_id").alias("lo"), F.max("page_id").alias("hi"), size.alias("n")).first()
    none = keys.filter("page_id is null").agg(size).first()[0] or 0
    if not (r["n"] or none):
        return Shards([], [], 0, 1)
    limit = max(1, min(shard_bytes, ((r["n"] or 0) + none) // least))
    cells = {r["lo"]: (r["hi"], r["n"])} if r["n"] else {}
    while heavy := {a: x for a, x in cells.items() if x[1] > limit and x[0] > a}:
        # Eight parts for each shard's worth, so that the shards made of them are near even.
        cut = {}
        for a, (b, n) in heavy.items():
            width = -(-(b - a + 1) // min(8 * -(-n // limit), b - a + 1))
            cut |= {x: min(x + width - 1, b) for x in range(a, b + 1, width)}
        starts, ends = np.array(sorted(cut), np.int64), np.array([cut[x] for x in sorted(cut)], np.int64)

        @F.pandas_udf("long")
        def cell(ids: pd.Series) -> pd.Series:
            at = np.maximum(np.searchsorted(starts, ids.to_numpy(), side="right") - 1, 0)
            return pd.Series(np.where((starts[at] <= ids) & (ids <= ends[at]), starts[at], -1)).where((starts[at] <= ids) & (ids <= ends[at]))

        for a in heavy:
            del cells[a]
        for row in known.select(cell("page_id").alias("cell"), "bytes").filter("cell is not null").groupBy("cell").agg(size.alias("n")).collect():
            cells[row["cell"]] = (cut[row["cell"]], row["n"])
    starts, sizes, held = [], [], 0
    for a in sorted(cells):
        b, n = cells[a]
        alone = n > limit  # a single page_id, whose rows are split
        if not starts or alone or held + n > limit:
            starts.append(a)
            sizes.append(n if alone else None)
            held = 0
        held += n if not alone else limit
    return Shards(starts, sizes, none, limit)


def _known(keys: DataFrame, min_revisit: int) -> DataFrame:
    """page_id, url, digest of the pages whose payload others have too, with the first of them."""
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url")).alias("first")
    groups = keys.filter(F.col("bytes") >= min_revisit).groupBy("digest", "bytes").agg(first, F.count("*").alias("n")).filter("n > 1").select("digest", "first", "n")
    hot = F.broadcast(groups.filter(F.coalesce(F.octet_length("first.url"), F.lit(0)) <= HOT_URL).orderBy(F.desc("n"), "digest").limit(HOT).select("digest", "first"))
    rows = keys.filter(F.col("bytes") >= min_revisit).select("page_id", "url", "digest")
    rest = rows.join(hot, "digest", "left_anti").join(groups.join(hot, "digest", "left_anti").select("digest", "first"), "digest")
    return rows.join(hot, "digest").unionByName(rest)


def write_archive(pages: DataFrame, root: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, min_revisit: int = 0, least_shards: int = LEAST_SHARDS, date: str = DATE) -> DataFrame:
    """Write pages (page_id, url, html) as WARC files below `root`, a folder that executors share; the manifest."""
    spark = pages.sparkSession
    ship(spark)
    rows = _digests(pages)
    keys = written(rows.select("page_id", "url", "digest", "bytes"), "warc-keys")
    shards = plan_shards(keys, shard_bytes, least_shards)
    shard_of = F.pandas_udf(shards.of, "long")
    shard = (shard_of(F.col("page_id"), _spread()) if shards.count else F.lit(0)).cast("int")
    known = written(_known(keys, min_revisit).withColumn("shard", shard), "warc-known")
    light = known.select("shard", "page_id", "url", "digest", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("payload"), F.col("first.page_id").alias("first_page"), F.col("first.url").alias("first_url"))
    full = rows.select(shard.alias("shard"), "page_id", "url", "digest", F.lit(1).alias("kind"), "payload", F.lit(None).cast("long").alias("first_page"), F.lit(None).cast("string").alias("first_url"))
    dealt = light.unionByName(full).repartitionById(max(1, shards.count), F.col("shard")).sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "digest", F.asc_nulls_first("url"), "kind")
    files, folder = _place(root)
    files.create_dir(f"{folder}/tmp", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, names = _place(root)[0], [x.split()[0] for x in MANIFEST.split(", ")]
        roll, before, nth, first = None, None, 0, None

        def told() -> pa.RecordBatch:
            made, roll.done = roll.done, []
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in made], pa.int64() if c in (2, 3, 5, 6) else pa.string()) for c in range(7)], names)

        for batch in batches:
            for row in batch.to_pylist():
                if roll is None or roll.shard != row["shard"]:
                    if roll:
                        roll.close()
                        yield told()
                    roll = Roll(out, folder, row["shard"], roll_bytes, date)
                own = row["page_id"], row["digest"], row["url"]
                if own != before:
                    before, nth, first = own, 0, None
                if row["kind"] == 0:
                    first = (row["first_page"], row["first_url"])
                    continue
                refers = None if first is None or nth == 0 and first == (own[0], own[2]) else first
                roll.add(own[0], page_record(own[0], own[2], row["payload"], own[1], nth, refers, date))
                nth += 1
        if roll:
            roll.close()
            yield told()

    staged = written(dealt.mapInArrow(write, MANIFEST), "warc-staged")
    return _publish(spark, staged, root)


def _publish(spark: SparkSession, staged: DataFrame, root: str) -> DataFrame:
    """Rename the files that `staged` names, then publish it as the manifest."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _place(root)
        for batch in batches:
            for name, temp, size in zip(*(batch.column(c).to_pylist() for c in ("name", "staged", "bytes"))):
                if files.get_file_info(temp).type == pafs.FileType.File:
                    files.move(temp, f"{folder}/{name}")
                elif files.get_file_info(f"{folder}/{name}").size != size:
                    raise FileNotFoundError(f"{temp} has gone before it was renamed to {name}")
            yield batch

    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    spread = staged.repartition(max(1, min(256, staged.count() // 16)))
    spread.mapInArrow(rename, MANIFEST).write.mode("overwrite").parquet(f"{root}/manifest.tmp")
    place = path(f"{root}/manifest")
    hadoop = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if hadoop.exists(place) or not hadoop.rename(path(f"{root}/manifest.tmp"), place):
        raise FileExistsError(f"{root} has a manifest already")
    hadoop.delete(path(f"{root}/tmp"), True)  # attempts that did not count
    return manifest(spark, root)


def manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, whose block digest is checked."""
    while line := stream.readline():
        if line.strip() != b"WARC/1.1":
            raise ValueError(f"a record begins with {line[:40]!r}")
        fields = {}
        while (line := stream.readline().strip()) != b"":
            key, _, value = line.decode().partition(": ")
            fields[key] = value
        block = stream.read(int(fields["Content-Length"]))
        if fields["WARC-Block-Digest"] != f"sha1:{sha1(block)}" or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
        yield fields, block


def read_archive(spark: SparkSession, root: str) -> DataFrame:
    """The records of all files of the manifest, but for those that describe a file; payload null for revisits."""
    ship(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, folder = _place(root)
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [{"long": pa.int64(), "binary": pa.binary()}.get(x.split()[1], pa.string()) for x in RECORD.split(", ")]

        def batch_of(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in some], t) for c, t in enumerate(kinds)], names)

        for batch in batches:
            for name in batch.column("name").to_pylist():
                some, size = [], 0
                with files.open_input_stream(f"{folder}/{name}", compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    for fields, block in records_of(stream):
                        if fields["WARC-Type"] == "warcinfo":
                            continue
                        head, _, payload = block.partition(b"\r\n\r\n")
                        length = int(head.rpartition(b"Content-Length: ")[2])
                        response = fields["WARC-Type"] == "response"
                        if response and (len(payload) != length or fields["WARC-Payload-Digest"] != f"sha1:{sha1(payload)}"):
                            raise ValueError(f"payload of {fields['WARC-Record-ID']} is damaged")
                        page, refers = fields.get("Page-Id"), fields.get("Refers-To-Page")
                        some.append((name, fields["WARC-Type"], fields["WARC-Record-ID"], page and int(page), fields.get("WARC-Target-URI"), fields["WARC-Payload-Digest"][5:], length, refers and int(refers), payload if response else None))
                        size += len(payload)
                        if size > 1 << 21 or len(some) == 4096:
                            yield batch_of(some)
                            some, size = [], 0
                if some:
                    yield batch_of(some)

    listed = manifest(spark, root)
    return listed.select("name").repartition(max(1, listed.count()), "name").mapInArrow(read, RECORD)


def archive_dir(spark: SparkSession) -> str:
    """A new folder for an archive in the shared one."""
    return f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
