"""A deterministic sharded WARC writer and its reader.

Records are range-sorted by key over shards whose bounds depend on the keys alone. Each task streams
its shards into files that roll at a compressed size, one gzip member per record, under temporary
names. A manifest lists what the successful attempts wrote; only then the files get their final
names, and only files in the manifest are ever read. Attempts that fail or run twice leave files that
no manifest names. Headers and digests are made anew from the payload; nothing is taken from outside.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turfspark.llm import common

DATE = "2000-01-01T00:00:00Z"  # a fixed capture date keeps the archives the same from run to run
ROLL_BYTES = 64 << 20
SHARD_BYTES = 256 << 20
REVISIT_BYTES = 1000
SAMPLE_PER_SHARD = 64
MOST_TASKS = 100_000
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # fixed value: the URL name space of RFC 4122
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "shard int, part int, temporary string, final string, records long, bytes long, sha256 string"
_RECORDS = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
    "refers_to long, record_id string, file string, offset long"
)


def _record_id(page_id: int | None, url: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{page_id}|{url}|{digest}')}>"


def _plain(value):
    return None if value is None or value != value else value


def _member(row, told=None) -> bytes:
    """One gzip member with one WARC record, a revisit if `told` says of what.

    There is no time stamp, so equal rows give equal bytes.
    """
    payload = (row.html or "").encode("utf-8", "surrogatepass")
    sha = hashlib.sha1(payload)
    if sha.hexdigest() != row.digest:
        raise ValueError(f"page {row.page_id}: the payload changed since its digest was taken")
    page, revisit = _plain(row.page_id), told is not None
    refers = _plain(told.refers_to) if revisit else None
    http = (
        f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    digests = [base64.b32encode(d).decode() for d in (hashlib.sha1(block).digest(), sha.digest())]
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": _record_id(page, row.url, row.digest),
        "WARC-Date": DATE,
        "WARC-Target-URI": (row.url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
        "WARC-Block-Digest": f"sha1:{digests[0]}",
        "WARC-Payload-Digest": f"sha1:{digests[1]}",
        "WARC-X-Page-Id": "" if page is None else str(int(page)),
        "WARC-X-Payload-Length": str(len(payload)),
    }
    if revisit:
        head["WARC-Profile"] = _PROFILE
        head["WARC-Refers-To"] = _record_id(refers, told.refers_url, row.digest)
        head["WARC-X-Refers-To-Page-Id"] = "" if refers is None else str(int(refers))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items())
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", compresslevel=6, mtime=0)


class _File:
    """One archive file under its temporary name."""

    def __init__(self, folder: str, shard: int, part: int, attempt: str) -> None:
        from pyarrow import fs

        self.system, root = fs.FileSystem.from_uri(folder)
        self.system.create_dir(root, recursive=True)
        self.name = f"part-{shard:06d}-{part:05d}.warc.gz"
        self.temporary = f".{self.name}.{attempt}"
        self.shard, self.part, self.records, self.bytes, self.sha = shard, part, 0, 0, hashlib.sha256()
        self.out = self.system.open_output_stream(f"{root}/{self.temporary}", compression=None)

    def write(self, member: bytes) -> None:
        self.out.write(member)
        self.records += 1
        self.bytes += len(member)
        self.sha.update(member)

    def close(self) -> tuple:
        self.out.close()
        return self.shard, self.part, self.temporary, self.name, self.records, self.bytes, self.sha.hexdigest()


def _writer(folder: str, roll: int):
    names = [c.split()[0] for c in _MANIFEST.split(", ")]

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = f"{TaskContext.get().taskAttemptId()}-{uuid.uuid4().hex}"
        file, done, told = None, [], None
        for batch in batches:
            for row in batch.astype(object).itertuples(index=False):
                if not row.told:
                    told = row
                    continue
                same = told is not None and (told.shard, told.page_key, told.url, told.digest) == (
                    row.shard, row.page_key, row.url, row.digest
                )
                if file is not None and (file.shard != row.shard or file.bytes >= roll):
                    done.append(file.close())
                    file = _File(folder, row.shard, file.part + 1 if file.shard == row.shard else 0, attempt)
                elif file is None:
                    file = _File(folder, row.shard, 0, attempt)
                file.write(_member(row, told if same else None))
            if done:
                yield pd.DataFrame(done, columns=names)
                done = []
        if file is not None:
            yield pd.DataFrame([file.close()], columns=names)

    return write


def _publish(folder: str):
    """Give listed files their final names; running it again changes nothing."""

    def publish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.itertuples(index=False):
                final = system.get_file_info(f"{root}/{row.final}")
                if final.type == fs.FileType.NotFound:
                    system.move(f"{root}/{row.temporary}", f"{root}/{row.final}")
                elif final.size != row.bytes:
                    raise ValueError(f"{row.final} is there with another size")
            yield batch

    return publish


def revisits(pages: DataFrame, threshold: int = REVISIT_BYTES) -> DataFrame:
    """Rows of page_id, url, key, page_key, digest that revisit another page: with refers_to, refers_url.

    Of equal payloads of at least `threshold` bytes the largest page_id is the response (all rows that
    have it, if several do; null ids come last, and are responses if no row has an id). The partner is
    found by one aggregate over digests with map-side combining; no payload is moved.
    """
    narrow = pages.where(F.col("payload_bytes") >= threshold).select("page_id", "url", "key", "page_key", "digest")
    last = common.cut(
        narrow.groupBy("digest")
        .agg(F.max(F.struct(F.col("page_id"), F.col("url"))).alias("best"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
        .select("digest", "best")
    )
    found = narrow.join(last, "digest").where(~F.col("page_id").eqNullSafe(F.col("best.page_id")))
    refers = [F.col("best.page_id").alias("refers_to"), F.col("best.url").alias("refers_url")]
    return found.select("page_id", "url", "key", "page_key", "digest", *refers).distinct()


def shard_bounds(rows: DataFrame, shards: int) -> list[tuple[str, int]]:
    """Keys that part the rows into about equal shards, a function of the keys alone.

    Takes the keys with the smallest hashes, SAMPLE_PER_SHARD times as many as shards, and then
    every n-th of them in order. The driver holds that many keys, however many rows there are.
    """
    if shards <= 1:
        return []
    sample = (
        rows.select("key", "page_key", F.xxhash64("key", "page_key").alias("h"))
        .orderBy("h", "key", "page_key")
        .limit(shards * SAMPLE_PER_SHARD)
        .select("key", "page_key")
        .collect()
    )
    keys = sorted({(r.key, r.page_key) for r in sample})
    step = max(1, len(keys) // shards)
    return keys[step::step][: shards - 1]


def write_warc(
    pages: DataFrame,
    folder: str,
    *,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    roll_bytes: int = ROLL_BYTES,
    shard_bytes: int = SHARD_BYTES,
) -> DataFrame:
    """Write one record per page and return the manifest (also stored beside the files).

    Null html is an empty payload; a null url is an empty target. Repeated rows are written as often
    as they come. An empty table gives an empty manifest and no file. Other columns are not read.
    Files of a run are the same bytes whatever the cluster, up to the order of rows that are equal.
    """
    spark = pages.sparkSession
    plain = pages.select(
        F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.col(f"`{html}`").alias("html")
    )
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[A-Za-z]+://([^/?#:]+)", 1), F.lit("")))
    key = F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(" "), F.coalesce("url", F.lit("")))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = plain.withColumns({
        "key": key,
        "page_key": F.coalesce("page_id", F.lit(-(2**63))),
        "payload_bytes": F.octet_length(payload).cast("long"),
        "digest": F.sha1(payload),
    })
    total = plain.agg(F.sum(F.octet_length(F.coalesce("html", F.lit(""))))).first()[0] or 0
    shards = max(1, -(-total // shard_bytes), min(spark.sparkContext.defaultParallelism, total >> 20))
    bounds = shard_bounds(rows, shards)
    cuts = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(p).alias("page_key")) for k, p in bounds])
    place = F.struct("key", "page_key")
    shard = F.lit(0) if not bounds else F.size(F.filter(cuts, lambda c: c <= place))
    # one shuffle for the payloads; what a revisit refers to comes as a row of its own before its page
    told = revisits(rows).withColumns({"html": F.lit(None).cast("string"), "told": F.lit(0)})
    none = {"refers_to": F.lit(None).cast("long"), "refers_url": F.lit(None).cast("string"), "told": F.lit(1)}
    ordered = (
        rows.drop("payload_bytes")
        .withColumns(none)
        .unionByName(told)
        .withColumn("shard", shard.cast("int"))
        .repartition(shards, "shard")
        .sortWithinPartitions("shard", "key", "page_key", "digest", "told")
        .select("shard", "page_id", "url", "page_key", "html", "digest", "refers_to", "refers_url", "told")
    )
    listed = f"{folder}/_manifest"
    ordered.mapInPandas(_writer(folder, roll_bytes), _MANIFEST).write.mode("overwrite").parquet(listed)
    manifest = spark.read.schema(_MANIFEST).parquet(listed)
    _by_file(manifest).mapInPandas(_publish(folder), _MANIFEST).write.mode("overwrite").parquet(
        f"{folder}/_committed"
    )
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/_committed")


def _by_file(manifest: DataFrame) -> DataFrame:
    """Files dealt to as many tasks as there are files, up to a bound; names are small, so AQE would put all in one."""
    return manifest.repartition(min(max(1, manifest.count()), MOST_TASKS), "final")


def _members(stream) -> Iterator[tuple[int, bytes]]:
    """Offset and content of each gzip member, holding one member at a time."""
    offset, rest = 0, b""
    while True:
        chunk = rest or stream.read(1 << 20)
        if not chunk:
            return
        engine, parts, used = zlib.decompressobj(31), [], 0
        while True:
            parts.append(engine.decompress(chunk))
            if engine.eof:
                used += len(chunk) - len(engine.unused_data)
                rest = engine.unused_data
                break
            used += len(chunk)
            chunk = stream.read(1 << 20)
            if not chunk:
                raise ValueError("the file ends inside a record")
        yield offset, b"".join(parts)
        offset += used


def parse(record: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a record, with lengths and digests checked."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a record: {lines[0]!r}")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    block, tail = rest[:size], rest[size:]
    if len(block) != size or tail != b"\r\n\r\n":
        raise ValueError("a record has another length than its header says")
    told = fields["WARC-Block-Digest"].removeprefix("sha1:")
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != told:
        raise ValueError("a block has another digest than its header says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, http, payload


def _reader(folder: str):
    names = [c.strip().split()[0] for c in _RECORDS.split(", ")]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for final in batch["final"]:
                found = []
                with system.open_input_stream(f"{root}/{final}", compression=None) as stream:
                    for offset, record in _members(stream):
                        fields, _, payload = parse(record)
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        kind, refers = fields["WARC-Type"], fields.get("WARC-X-Refers-To-Page-Id") or None
                        size = int(fields["WARC-X-Payload-Length"])
                        if kind == "response" and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                            raise ValueError(f"{final} at {offset}: the payload has another digest than its header says")
                        page = fields["WARC-X-Page-Id"] or None
                        found.append((
                            page and int(page), fields["WARC-Target-URI"], size, digest, kind,
                            refers and int(refers), fields["WARC-Record-ID"], final, offset,
                        ))
                        if len(found) >= 2000:
                            yield _frame(found, names)
                            found = []
                yield _frame(found, names)

    return read


def _frame(rows: list, names: list[str]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=names)
    return frame.astype({"page_id": "Int64", "refers_to": "Int64"})


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record of the files that the manifest of `folder` lists, digests checked.

    Columns: page_id, url, payload_bytes, payload_digest (of the full payload, for revisits too),
    record_type, refers_to, record_id, file, offset.
    """
    manifest = spark.read.schema(_MANIFEST).parquet(f"{folder}/_committed")
    return _by_file(manifest.select("final")).mapInPandas(_reader(folder), _RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages into a new scratch folder and read the archives back."""
    folder = common.scratch(pages.sparkSession)
    write_warc(pages, folder)
    return read_warc(pages.sparkSession, folder)
