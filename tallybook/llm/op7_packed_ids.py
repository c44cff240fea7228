"""Token ids packed into fixed rows by best-fit decreasing.

Documents become piece ids (begin and end included); what is longer than a row
is split into whole rows and a rest, nothing is dropped. A task packs its
segments, longest first, into the fullest row that still has room; a segment
tree over the capacities 0..row_length finds that row. Each packed row carries
its ids (little-endian uint32, padded), the cumulative segment lengths, the
positions (which restart at 0 with each segment) and, for each segment, its
document and the offset in it, so documents can be put together again.

A task segments the distinct chunks of its texts once, as long as it remembers
them (KNOWN chunks at most); tables shared by all tasks would cost more than the
rare chunks, most of all, that a task alone holds. Nothing is shuffled.

Packing works on groups of at most group_tokens tokens, so its memory does not
grow with the partition.

Defined results: null or empty text is a segment of begin and end only; equal
rows are packed like any others; a null document id stays null.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, LongType, StructField, StructType

from tallybook.llm.op9_piece_codec import codec
from tallybook.llm.runtime import small_batches

ROW_LENGTH = 2048
KNOWN = 400_000


def packed_schema(id_type: DataType) -> StructType:
    """Columns of the packed rows; doc_ids are of the documents' own type."""
    kinds = {"row_id": LongType(), "doc_ids": ArrayType(id_type), "doc_offsets": ArrayType(LongType()), "cu_seqlens": ArrayType(IntegerType()), "n_tokens": IntegerType(), "ids": BinaryType(), "positions": BinaryType()}
    return StructType([StructField(n, t) for n, t in kinds.items()])


class CapacityTree:
    """Open rows by room left; the least room of at least a size in logarithmic time."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size <= capacity:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _add(self, room: int, by: int) -> None:
        node = room + self.size
        while node:
            self.count[node] += by
            node //= 2

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, room) of a row with the least room >= need."""
        count, node = self.count, need + self.size
        if not count[node]:
            while node > 1 and (node % 2 or not count[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node *= 2
                if not count[node]:
                    node += 1
        room = node - self.size
        row = self.rows[room].pop()
        self._add(room, -1)
        return row, room


def best_fit(sizes: np.ndarray, capacity: int) -> list[list[int]]:
    """Rows of segment numbers, segments taken longest first (ties in input order)."""
    tree, rows = CapacityTree(capacity), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        found = tree.take(n)
        if found is None:
            rows.append([i])
            tree.put(capacity - n, len(rows) - 1)
        else:
            rows[found[0]].append(i)
            tree.put(found[1] - n, found[0])
    return rows


def coded_texts(batches: Iterator[pa.RecordBatch], model_file: str | None) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Batches (doc, text) with their texts' ids; chunks are segmented when first met."""
    tool, known = codec(model_file), {}
    for batch in batches:
        texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
        split = [tool.chunks(t) for t in texts]
        if len(known) > KNOWN:
            known.clear()
        new = list(set(chain.from_iterable(filter(None, split))) - known.keys())
        known.update(zip(new, tool.segment(new)))
        yield batch, tool.encode(texts, split, known)


def pack_token_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_length: int = ROW_LENGTH, model_file: str | None = None, pad_id: int = 0, group_tokens: int = 4_000_000) -> DataFrame:
    """Packed rows, see packed_schema."""
    schema = packed_schema(docs.schema[id_col].dataType)
    arrow = to_arrow_schema(schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        held: list[tuple] = []  # (document, offset, ids)
        tokens = 0
        count = np.arange(row_length + 1, dtype="<u4").tobytes()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seq
            rows = best_fit(np.array([len(s[2]) // 4 for s in held], np.int64), row_length)
            for at in range(0, len(rows), 64):
                out: list[list] = [[] for _ in arrow]
                for members in rows[at : at + 64]:
                    parts = [held[i] for i in members]
                    ends = np.cumsum([0] + [len(p[2]) // 4 for p in parts]).tolist()
                    used = ends[-1]
                    ids = b"".join(p[2] for p in parts) + padding[: 4 * (row_length - used)]
                    positions = b"".join([count[: len(p[2])] for p in parts]) + count[: 4 * (row_length - used)]
                    for c, v in zip(out, ((part << 32) | seq, [p[0] for p in parts], [p[1] for p in parts], ends, used, ids, positions)):
                        c.append(v)
                    seq += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, arrow)], schema=arrow)

        for batch, coded in coded_texts(batches, model_file):
            for doc, ids in zip(batch.column("doc").to_pylist(), coded):
                for at in range(0, len(ids), 4 * row_length):
                    held.append((doc, at // 4, ids[at : at + 4 * row_length]))
                tokens += len(ids) // 4
                if tokens >= group_tokens:
                    yield from flush()
                    held, tokens = [], 0
        if held:
            yield from flush()

    padding = np.full(row_length, pad_id, "<u4").tobytes()
    named = docs.select(docs[f"`{id_col}`"].alias("doc"), docs[f"`{text_col}`"].alias("text"))
    small_batches(docs.sparkSession)
    return named.mapInArrow(pack, schema)


def op7_packed_ids(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    packed = pack_token_ids(docs)
    return packed.select("row_id", "doc_ids", "doc_offsets", "cu_seqlens", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"))
