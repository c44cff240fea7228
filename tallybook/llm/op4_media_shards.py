"""Media columns: content-addressed payloads in tar shards.

store_media writes each distinct payload of a task once, as a lossless 8-bit
grey PNG (64 samples a row), into tar files in a folder that all executors
share; rows carry digest, shard, offset and length. One place is chosen for
each digest over all shards. read_headers fills the metadata columns from
range reads of the 33 header bytes only; read_payloads reads whole members.

A shard is written under a name of its own for each attempt and then renamed,
and its bytes follow from its rows alone, so a repeated task changes nothing.

Defined results: null text is an empty payload (64 zero bytes); equal texts
have equal values and one place; other columns pass through store_media.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tallybook.llm.runtime import durable, shared_dir, small_batches, without

UNIT = 64
HEADER_BYTES = 33
_SIGNATURE = b"\x89PNG\r\n\x1a\n"
PLACE = ["n_bytes", "digest", "shard", "offset", "length"]


def _piece(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """Payload (a positive multiple of 64 bytes) as an 8-bit grey image, 64 samples a row."""
    rows = np.zeros((len(payload) // UNIT, UNIT + 1), np.uint8)  # each row begins with filter type 0
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    head = struct.pack(">IIBBBBB", UNIT, len(rows), 8, 0, 0, 0, 0)
    return _SIGNATURE + _piece(b"IHDR", head) + _piece(b"IDAT", zlib.compress(rows.tobytes(), level)) + _piece(b"IEND", b"")


def png_header(first: bytes) -> tuple[int, int, int]:
    """Width, height and bits from the first 33 bytes."""
    if first[:8] != _SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIB", first[16:25])


def from_png(data: bytes) -> bytes:
    width, height, _ = png_header(data)
    at, packed = 8, b""
    while at < len(data):
        size = struct.unpack(">I", data[at : at + 4])[0]
        if data[at + 4 : at + 8] == b"IDAT":
            packed += data[at + 8 : at + 8 + size]
        at += size + 12
    return np.frombuffer(zlib.decompress(packed), np.uint8).reshape(height, width + 1)[:, 1:].tobytes()


def padded(text: bytes) -> bytes:
    size = max(UNIT, -(-len(text) // UNIT) * UNIT)
    return text + bytes(size - len(text))


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def store_media(docs: DataFrame, folder: str, text_col: str = "text", shard_bytes: int = 64 << 20) -> DataFrame:
    """docs without the text, with n_bytes, digest, shard, offset and length; computed once."""
    kept = without(docs, PLACE)
    columns = [c for c in kept.columns if c != text_col]
    schema = StructType([kept.schema[c] for c in columns] + [StructField("n_bytes", LongType()), StructField("digest", BinaryType()), StructField("shard", StringType()), StructField("offset", LongType()), StructField("length", LongType())])
    arrow = to_arrow_schema(schema)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        task = TaskContext.get()
        seq, out, seen, at, name, held = 0, None, {}, 0, "", []

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal out, seen, at, seq, held
            if out is not None:
                out.write(bytes(1024))
                out.close()
                files.move(f"{root}/.{name}.{task.taskAttemptId()}", f"{root}/{name}")
                out, seen, at, seq = None, {}, 0, seq + 1
            yield from held
            held = []

        for batch in batches:
            rows = []
            for text in batch.column(text_col).cast(pa.binary()).to_pylist():
                text = text or b""
                payload = padded(text)
                digest = hashlib.sha256(payload).digest()
                if digest not in seen:
                    if out is None:
                        name = f"part-{task.partitionId():06d}-{seq:05d}.tar"
                        out = files.open_output_stream(f"{root}/.{name}.{task.taskAttemptId()}")
                    media = to_png(payload)
                    info = tarfile.TarInfo(f"{digest.hex()}.png")
                    info.size = len(media)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head + media + bytes(-len(media) % 512))
                    seen[digest] = (at + len(head), len(media))
                    at += len(head) + len(media) + -len(media) % 512
                rows.append((len(text), digest, name, *seen[digest]))
            made = [pa.array(c, t) for c, t in zip(zip(*rows), arrow.types[len(columns) :])] if rows else [pa.array([], t) for t in arrow.types[len(columns) :]]
            held.append(pa.RecordBatch.from_arrays([*(batch.column(c).cast(arrow.field(c).type) for c in columns), *made], schema=arrow))
            if at >= shard_bytes:
                yield from close()
        yield from close()

    return durable(kept.mapInArrow(run, schema))


def one_place(manifest: DataFrame) -> DataFrame:
    """For each digest the first shard and offset that hold it."""
    first = manifest.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length", "n_bytes")).alias("p"))
    return first.select("digest", "p.shard", "p.offset", "p.length")


def _members(places: DataFrame, folder: str, read: int | None, describe, made: list[StructField]) -> DataFrame:
    """A range read for each row, the shards dealt to tasks and read in order."""
    schema = StructType(places.schema.fields + made)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        opened, source = None, None
        for batch in batches:
            rows = []
            for shard, offset, length in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length"))):
                if shard != opened:
                    opened, source = shard, files.open_input_file(f"{root}/{shard}")
                rows.append(describe(source.read_at(min(length, read or length), offset)))
            new = [pa.array(c, t) for c, t in zip(zip(*rows), arrow.types[-len(made) :])] if rows else [pa.array([], t) for t in arrow.types[-len(made) :]]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=arrow)

    return places.repartition("shard").sortWithinPartitions("shard", "offset").mapInArrow(run, schema)


def read_headers(places: DataFrame, folder: str) -> DataFrame:
    """places with width, height and bits, from the header bytes alone."""
    return _members(places, folder, HEADER_BYTES, lambda b: png_header(b), [StructField(n, LongType()) for n in ("width", "height", "bits")])


def describe_samples(samples: np.ndarray, width: int, height: int) -> str:
    bins = np.bincount(samples >> 5, minlength=8)
    return f"{width}x{height};sum={int(samples.sum(dtype=np.int64))};max={int(samples.max())};bins={','.join(map(str, bins.tolist()))}"


def _payload(media: bytes) -> tuple:
    data = from_png(media)
    width, height, _ = png_header(media)
    return len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), describe_samples(np.frombuffer(data, np.uint8), width, height)


def read_payloads(places: DataFrame, folder: str) -> DataFrame:
    """places with what the stored bytes, read back, hold."""
    return _members(places, folder, None, _payload, [StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()), StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("feature", StringType())])


def op4_media_shards(spark, sf_dir: str) -> DataFrame:
    import uuid

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = f"{shared_dir(spark)}/media-{uuid.uuid4()}"
    folder = folder if "://" in folder else f"file://{folder}"
    manifest = store_media(docs, folder)
    places = one_place(manifest)
    read = read_payloads(read_headers(places, folder), folder).drop("shard", "offset", "length")
    made = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "width", "height"]
    return manifest.join(read, "digest").select("doc_id", "n_bytes", *made)
