"""Substring dedup: windows of words that occur again anywhere are cut.

1. Each block of documents counts its windows in a count-min sketch of two rows
   of cells (as many as fit the corpus) and sends its counters: the cells that
   are not zero, with their counts, dealt by ranges of cells. A shard adds the
   sketches of all blocks, counter by counter, and tells each block which of its
   cells reached two. Estimates are never too small, so no repeat is missed.
2. Only windows that both rows estimate as repeated are grouped exactly, by 128
   hash bits that are independent of the cells; a block sends each window once.
3. Words under a repeated window go; windows are judged on the input.

Defined results: null or empty text has no words and keeps none; fewer words
than a window: all kept; equal rows repeat each other's windows; other columns
pass through, and an input column named like a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallybook.llm.blocks import PAIRS, REPEATED, ask, distinct_pairs, judged, judged_states, keys_from_bytes, keys_to_bytes, map_blocks, open_block, pack_blocks, shard_edges, shards_for, texts_of, total_bytes
from tallybook.llm.kernels import Words, covered, windows_hash
from tallybook.llm.runtime import durable, without

U = np.uint64
ROWS = 2
MADE = ["n_words", "n_removed", "kept_text"]
COUNTERS = "shard int, block long, cells binary, counts binary"
_COUNTERS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("cells", pa.binary()), ("counts", pa.binary())])
_SEEN = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])


def cells_of(hashes: np.ndarray, row: int, width_bits: int) -> np.ndarray:
    """The cell of each window in one row of the sketch."""
    spread = hashes * U(0x9E3779B97F4A7C15) if row else hashes
    return spread >> U(64 - width_bits)


def block_sketch(hashes: np.ndarray, row: int, width_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells of one row that are not zero, ascending, their counters, and each window's place among them."""
    cells, at, counts = np.unique(cells_of(hashes, row, width_bits), return_inverse=True, return_counts=True)
    return cells, np.minimum(counts, 255).astype(np.uint8), at


def cell_cuts(cells: np.ndarray, width_bits: int, shards: int) -> np.ndarray:
    """Where the cells of each shard begin; shards are ranges of cells."""
    return np.append(np.searchsorted(cells, shard_edges(shards) >> U(64 - width_bits)), len(cells))


def add_sketches(table: pa.Table, width_bits: int, shards: int) -> pa.Table:
    """One range of one row: the blocks' counters added, and for each block a bit per cell, set where two or more were counted."""
    s = table.column("shard")[0].as_py() % shards
    edges = np.append(shard_edges(shards) >> U(64 - width_bits), U(1 << width_bits))
    counters = np.zeros(int(edges[s + 1] - edges[s]), np.uint8)
    parts = [(keys_from_bytes(c) - edges[s]).astype(np.int64) for c in table.column("cells").to_pylist()]
    for at, counts in zip(parts, table.column("counts").to_pylist()):
        added = counters[at].astype(np.uint16) + np.frombuffer(zstandard.decompress(counts), np.uint8)  # a block names a cell once
        counters[at] = np.minimum(added, 255)
    masks = [np.packbits(counters[at] > 1).tobytes() for at in parts]
    return pa.Table.from_arrays([table.column("shard"), table.column("block"), pa.array(masks, pa.binary())], schema=_SEEN)


def substring_dedup(docs: DataFrame, text_col: str = "text", window: int = 35) -> DataFrame:
    """docs with n_words, n_removed and kept_text (kept words, one space between)."""
    docs = without(docs, MADE)
    out_schema = StructType(docs.schema.fields + [StructField("n_words", LongType()), StructField("n_removed", LongType()), StructField("kept_text", StringType())])
    blocks = pack_blocks(docs, text_col)
    estimate = total_bytes(blocks) // 6 + 1
    width_bits = min(60, max(12, (8 * estimate).bit_length()))
    shards = shards_for(blocks, estimate, 1_000_000)

    def windows(row: dict) -> tuple[pa.Table, Words, np.ndarray, np.ndarray]:
        table = open_block(row["data"])
        words = Words(texts_of(table, text_col))
        at = np.flatnonzero(words.window_starts(window))
        return table, words, at, windows_hash(words.hashes, window, 1)[at] if len(at) else np.empty(0, U)

    def sketch(row: dict) -> Iterator[pa.RecordBatch]:
        _, _, _, hashes = windows(row)
        rows = []
        for r in range(ROWS):
            cells, counts, _ = block_sketch(hashes, r, width_bits)
            cuts = cell_cuts(cells, width_bits, shards)
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[s], cuts[s + 1])
                rows.append((r * shards + s, row["block"], keys_to_bytes(cells[part]), zstandard.compress(counts[part].tobytes(), 1)))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _COUNTERS.types)], schema=_COUNTERS)

    def added(table: pa.Table) -> pa.Table:
        return add_sketches(table, width_bits, shards)

    merged = durable(map_blocks(blocks, sketch, COUNTERS).groupBy("shard").applyInArrow(added, "shard int, block long, data binary"))

    def estimated(row: dict) -> tuple:
        """Windows that both rows of the merged sketch estimate as repeated."""
        table, words, at, hashes = windows(row)
        hot = np.ones(len(at), bool)
        answers = {a["shard"]: a["data"] for a in row["answers"] or () if a["kind"] == 0}
        for r in range(ROWS):
            cells, _, place = block_sketch(hashes, r, width_bits)
            cuts = cell_cuts(cells, width_bits, shards)
            full = np.zeros(len(cells), bool)
            for s in np.flatnonzero(np.diff(cuts)).tolist():
                full[cuts[s] : cuts[s + 1]] = np.unpackbits(np.frombuffer(answers[r * shards + s], np.uint8), count=cuts[s + 1] - cuts[s])
            hot &= full[place]
        at, hashes = at[hot], hashes[hot]
        again = windows_hash(words.hashes, window, 2)[at] if len(at) else np.empty(0, U)
        return table, words, at, distinct_pairs(again, hashes)

    def candidates(row: dict) -> Iterator[pa.RecordBatch]:
        _, _, _, (keys, further, entry) = estimated(row)
        yield from ask(row["block"], keys, further, np.bincount(entry, minlength=len(keys)) > 1, shards, 0)

    def by_block(parts: DataFrame) -> DataFrame:
        return parts.groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "data")).alias("answers"))

    seen = merged.select("block", F.lit(0).alias("kind"), "shard", "data")
    exact = judged(map_blocks(blocks.join(by_block(seen), "block"), candidates, PAIRS))
    answers = by_block(seen.union(exact.select("block", F.lit(1).alias("kind"), "shard", F.col("states").alias("data"))))
    arrow_out = to_arrow_schema(out_schema)

    def cut(row: dict) -> Iterator[pa.RecordBatch]:
        table, words, at, (keys, _, entry) = estimated(row)
        states = judged_states(keys, [a for a in row["answers"] or () if a["kind"] == 1], shards, 0)
        gone = covered(at[np.isin(states, REPEATED)[entry]], window, len(words.starts))
        removed, kept = [], []
        for d, text in enumerate(words.texts):
            mask = gone[words.first[d] : words.first[d + 1]]
            n = int(mask.sum())
            removed.append(n)
            parts = text.split()
            kept.append(b" ".join(parts if not n else [w for w, g in zip(parts, mask.tolist()) if not g]))
        made = [pa.array(words.counts(), pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())]
        full = pa.Table.from_arrays([*table.columns, *made], names=arrow_out.names).cast(arrow_out)
        yield from full.to_batches(max_chunksize=256)

    return map_blocks(blocks.join(answers, "block", "left"), cut, out_schema)


def op10_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = substring_dedup(docs)
    return done.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
