"""SentencePiece encoding and decoding by a table of distinct chunks.

Where no piece of the vocabulary holds a whitespace marker behind another
character, merges never cross the start of a marker run. A text then splits
into marked chunks, which are segmented apart:

1. Each block of texts sends its distinct chunks, sorted, to shards of chunk
   hashes. A shard joins the lists of its blocks to one table of distinct
   chunks and segments each of them once.
2. It sends each block its chunks with their ids, and the block joins them back
   by position. Blocks are joined by a digest of what they hold, so the input may be
   read twice instead of being kept; a chunk without an answer (the input came in
   another order) is segmented in place.

A shard serves at most about GROUP_BLOCKS blocks: beyond, groups of blocks have
tables of their own, so a chunk that every block holds does not gather all
blocks in one task, and is segmented once for each 4 GB of text. Chunks over
LONG bytes are segmented in place, as are texts that hold the marker character
itself; vocabularies without the property above encode whole texts.

Defined results: null text is encoded as empty text (begin and end ids only);
other columns pass through; an input column named like a result is replaced.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tallybook.llm.blocks import block_rows, map_blocks, open_block, texts_of
from tallybook.llm.runtime import shuffle_width, without

MARK = "▁".encode()
CHUNK = re.compile(rb" *[^ ]+(?: +\Z)?")
BETWEEN = b"\xff"  # never in UTF-8
LONG = 200
CHUNKED_BYTES = 8 << 20
GROUP_BLOCKS = 512
SHARD_BYTES = 12_000_000
MADE = ["n_tokens", "ids", "decoded"]
_CODECS: dict[str, "ChunkCodec"] = {}
_ASKED = pa.schema([("shard", pa.int64()), ("digest", pa.string()), ("chunks", pa.binary())])
_TOLD = pa.schema([("digest", pa.string()), ("chunks", pa.binary()), ("ids", pa.binary())])


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class ChunkCodec:
    """The model, and texts as chunks."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        mark = MARK.decode()
        pieces = (self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size()))
        self.splits = all(mark not in p.lstrip(mark) for p in pieces) and self.sp.encode("a  b", out_type=str)[0].startswith(mark)
        self.width = 2 if self.sp.get_piece_size() <= 1 << 16 else 4
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (self.sp.bos_id(), self.sp.eos_id()))

    def chunks(self, text: bytes) -> list[bytes] | None:
        """The text's chunks; None where it must be encoded whole."""
        if not self.splits or MARK in text or not text.strip(b" "):
            return None
        if b"  " in text or text[0] == 32 or text[-1] == 32:
            return [c[1:] for c in CHUNK.findall(b" " + text)]
        return text.split(b" ")

    def segment(self, chunks: list[bytes]) -> list[bytes]:
        """The ids of each chunk, little-endian in the codec's own width."""
        ids = self.sp.encode([c.decode() for c in chunks], num_threads=1) if chunks else []
        ends = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) * self.width).tolist()
        flat = np.fromiter(chain.from_iterable(ids), f"<u{self.width}").tobytes()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def encode(self, texts: list[bytes], split: list[list[bytes] | None], table: dict[bytes, bytes]) -> list[bytes]:
        """Begin, the chunks' ids by position and end, little-endian uint32, for each text; table gets the chunks it lacks."""
        whole = [i for i, s in enumerate(split) if s is None]
        alone = dict(zip(whole, self.segment([texts[i] for i in whole])))

        def ids(chunks: list[bytes]) -> bytes:
            try:
                return b"".join([table[c] for c in chunks])
            except KeyError:
                lacks = [c for c in set(chunks) if c not in table]
                table.update(zip(lacks, self.segment(lacks)))
                return b"".join([table[c] for c in chunks])

        joined = [alone[i] if s is None else ids(s) for i, s in enumerate(split)]
        return [self.begin + np.frombuffer(j, f"<u{self.width}").astype("<u4").tobytes() + self.end for j in joined]

    def decode(self, ids: bytes) -> str:
        return self.sp.decode(np.frombuffer(ids, "<u4").tolist())


def codec(model_file: str | None) -> ChunkCodec:
    """One codec for each model in a Python worker."""
    key = model_file or default_model()
    if key not in _CODECS:
        _CODECS[key] = ChunkCodec(key)
    return _CODECS[key]


def distinct(split: list[list[bytes] | None]) -> list[bytes]:
    """The distinct chunks of some texts, ascending."""
    return sorted(set(chain.from_iterable(filter(None, split))))


def dealt(chunks: list[bytes], shards: int) -> dict[int, list[bytes]]:
    """Ascending chunks for each shard of their hashes; those over LONG bytes are left out."""
    out: dict[int, list[bytes]] = {}
    for c in chunks:
        if len(c) <= LONG:
            out.setdefault(zlib.crc32(c) % shards, []).append(c)
    return out


def with_ids(docs: DataFrame, text_col: str, model_file: str | None, finish: Callable, schema: str | StructType, block_bytes: int = CHUNKED_BYTES) -> DataFrame:
    """finish(table, ids) of the rows of all blocks and their ids, task by task: finish takes an iterator of them and yields Arrow batches of schema."""
    size = docs.agg(F.coalesce(F.sum(F.octet_length(docs[f"`{text_col}`"])), F.lit(0))).first()[0]
    groups = -(-size // (GROUP_BLOCKS * block_bytes)) or 1
    shards = max(-(-size // (groups * SHARD_BYTES)), min(shuffle_width(docs.sparkSession), 1024))
    blocks = block_rows(docs, text_col, block_bytes).select("data", F.sha2("data", 256).alias("digest"))

    def texts_in(row: dict) -> tuple[pa.Table, list[bytes], list[list[bytes] | None]]:
        table, tool = open_block(row["data"]), codec(model_file)
        texts = [t or b"" for t in texts_of(table, text_col)]
        return table, texts, [tool.chunks(t) for t in texts]

    def ask(row: dict) -> Iterator[pa.RecordBatch]:
        _, _, split = texts_in(row)
        group = int(row["digest"][:8], 16) % groups
        asked = [(group * shards + s, row["digest"], zstandard.compress(BETWEEN.join(c), 6)) for s, c in dealt(distinct(split), shards).items()]
        if asked:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*asked), _ASKED.types)], schema=_ASKED)

    def segment(table: pa.Table) -> pa.Table:
        """One shard: its distinct chunks segmented once, and each block's share of the ids."""
        blobs = table.column("chunks").to_pylist()
        lists = [zstandard.decompress(b).split(BETWEEN) for b in blobs]
        chunks = sorted(set().union(*lists))
        known = dict(zip(chunks, codec(model_file).segment(chunks)))
        told = []
        for asked in lists:
            ids = [known[c] for c in asked]
            told.append(zstandard.compress(np.fromiter(map(len, ids), "<u2", len(ids)).tobytes() + b"".join(ids), 3))
        return pa.Table.from_arrays([table.column("digest"), pa.array(blobs, pa.binary()), pa.array(told, pa.binary())], schema=_TOLD)

    def joined(row: dict) -> tuple[pa.Table, list[bytes]]:
        table, texts, split = texts_in(row)
        known: dict[bytes, bytes] = {}
        for told in row["told"] or ():
            asked, raw = zstandard.decompress(told["chunks"]).split(BETWEEN), zstandard.decompress(told["ids"])
            ends = (2 * len(asked) + np.cumsum(np.frombuffer(raw, "<u2", len(asked)), dtype=np.int64)).tolist()
            known.update(zip(asked, [raw[a:b] for a, b in zip([2 * len(asked), *ends], ends)]))
        return table, codec(model_file).encode(texts, split, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple[pa.Table, list[bytes]]]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield joined({n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)})

        yield from finish(rows())

    told = map_blocks(blocks, ask, "shard long, digest string, chunks binary").groupBy("shard").applyInArrow(segment, "digest string, chunks binary, ids binary")
    answers = told.groupBy("digest").agg(F.collect_list(F.struct("chunks", "ids")).alias("told"))
    return blocks.join(answers, "digest", "left").mapInArrow(run, schema)


def encode_pieces(docs: DataFrame, text_col: str = "text", model_file: str | None = None, decode: bool = True, block_bytes: int = CHUNKED_BYTES) -> DataFrame:
    """docs with n_tokens, ids (little-endian uint32, begin and end included) and decoded text."""
    docs = without(docs, MADE)
    schema = StructType(docs.schema.fields + [StructField("n_tokens", LongType()), StructField("ids", BinaryType()), StructField("decoded", StringType())])
    arrow = to_arrow_schema(schema)

    def finish(rows: Iterator[tuple[pa.Table, list[bytes]]]) -> Iterator[pa.RecordBatch]:
        for table, ids in rows:
            tool = codec(model_file)
            for at in range(0, len(ids), 256):
                some, part = ids[at : at + 256], table.slice(at, 256)
                back = [tool.decode(i) if decode else None for i in some]
                made = [pa.array([len(i) // 4 for i in some], pa.int64()), pa.array(some, pa.binary()), pa.array(back, pa.string())]
                yield from pa.Table.from_arrays([*part.columns, *made], names=arrow.names).cast(arrow).combine_chunks().to_batches()

    return with_ids(docs, text_col, model_file, finish, schema, block_bytes)


def op9_piece_codec(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = encode_pieces(docs)
    return done.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))
