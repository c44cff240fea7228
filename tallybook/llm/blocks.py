"""Blocks of rows, and the question which keys of a block occur again anywhere.

A block is one row that holds some megabytes of input rows, all columns, as a
compressed Arrow stream. Blocks are written once to the shared folder, so that
several passes see the same rows in the same order, whatever the columns hold:
no pass needs a unique or non-null document id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallybook.llm.runtime import durable, shuffle_width, small_batches

BLOCK_BYTES = 2 << 20
BLOCK_SCHEMA = "block long, n_bytes long, n_rows long, data binary"


def block_rows(df: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (block, n_bytes, n_rows, data); a longer text is a block alone."""
    small_batches(df.sparkSession)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, seq, pending, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, pending, size
            sink, table = pa.BufferOutputStream(), pa.Table.from_batches(pending).combine_chunks()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as out:
                out.write_table(table)
            row = {"block": [(at << 32) | seq], "n_bytes": [size], "n_rows": [sum(p.num_rows for p in pending)], "data": [sink.getvalue().to_pybytes()]}
            seq, pending, size = seq + 1, [], 0
            return pa.RecordBatch.from_pydict(row, schema=pa.schema([("block", pa.int64()), ("n_bytes", pa.int64()), ("n_rows", pa.int64()), ("data", pa.binary())]))

        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(text_col)), 0).to_numpy(zero_copy_only=False)
            begin = 0
            for i, n in enumerate(lengths):
                if size and size + n > block_bytes:
                    if i > begin:
                        pending.append(batch.slice(begin, i - begin))
                    if pending:
                        yield flush()
                    begin, size = i, 0
                size += int(n)
            if len(lengths) > begin:
                pending.append(batch.slice(begin))
        if pending:
            yield flush()

    return df.mapInArrow(pack, BLOCK_SCHEMA)


def pack_blocks(df: DataFrame, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block_rows, computed once and kept in the shared folder."""
    return durable(block_rows(df, text_col, block_bytes))


def open_block(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def texts_of(table: pa.Table, text_col: str = "text") -> list[bytes | None]:
    return table.column(text_col).cast(pa.binary()).to_pylist()


def total_bytes(blocks: DataFrame) -> int:
    return blocks.agg(F.coalesce(F.sum("n_bytes"), F.lit(0))).first()[0]


# ---- sorted keys as small binaries --------------------------------------------------------


def keys_to_bytes(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys as differences in the narrowest type, compressed."""
    gaps = np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys
    first = gaps[:1].copy()
    gaps = gaps[1:]
    top = int(gaps.max()) if len(gaps) else 0
    kind = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    raw = bytes([kind]) + first.tobytes() + gaps.astype(f"<u{kind}").tobytes()
    return zstandard.compress(raw, 1)


def keys_from_bytes(blob: bytes) -> np.ndarray:
    raw = zstandard.decompress(blob)
    if len(raw) == 1:
        return np.empty(0, np.uint64)
    gaps = np.frombuffer(raw, f"<u{raw[0]}", offset=9).astype(np.uint64)
    return np.cumsum(np.concatenate((np.frombuffer(raw, "<u8", 1, 1), gaps)), dtype=np.uint64)


def shard_edges(shards: int) -> np.ndarray:
    """The least key of each shard; shards are equal ranges of 64-bit keys."""
    return np.array([(s << 64) // shards for s in range(shards)], np.uint64)


def by_shard(keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts the keys, and where each of the shards (ranges of keys) starts in it."""
    order = np.argsort(keys, kind="stable")
    return order, np.append(np.searchsorted(keys[order], shard_edges(shards)), len(keys))


KEYS_SCHEMA = "shard int, block long, keys binary, more binary"
_ARROW_KEYS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("more", pa.binary())])


def emit_keys(block: int, keys: np.ndarray, more: np.ndarray | None, shards: int) -> pa.RecordBatch | None:
    """A row for each shard that has keys of this block; more: further bits of each key's hash."""
    order, cuts = by_shard(keys, shards)
    keys, rows = keys[order], []
    for s in np.flatnonzero(np.diff(cuts)):
        part = slice(cuts[s], cuts[s + 1])
        rows.append((int(s), block, keys_to_bytes(keys[part]), None if more is None else more[order[part]].tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW_KEYS.types)], schema=_ARROW_KEYS) if rows else None


# ---- pairs of a key and a further hash: which occur again ---------------------------------

#: What is known of a pair: its key is alone; the pair occurs again (another stands for it); the pair occurs once, its
#: key with other pairs; it occurs again and stands for all its like; the last two again where a key has very many pairs.
ALONE, WHOLE, ASKS, STANDS, HOT_ASKS, HOT_STANDS = range(6)
REPEATED = [WHOLE, STANDS, HOT_STANDS]
HOT = 4096
U = np.uint64
PAIRS = "shard int, block long, keys binary, more binary"
_PAIRS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("more", pa.binary())])
JUDGED = "shard int, block long, states binary, n_sent long, n_hot long"
_JUDGED = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("states", pa.binary()), ("n_sent", pa.int64()), ("n_hot", pa.int64())])


def distinct_pairs(keys: np.ndarray, further: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (key, further) pairs, ascending, and each row's place among them."""
    order = np.lexsort((further, keys))
    k, f = keys[order], further[order]
    fresh = np.append(True, (k[1:] != k[:-1]) | (f[1:] != f[:-1])) if len(k) else np.empty(0, bool)
    entry = np.empty(len(k), np.int64)
    entry[order] = np.cumsum(fresh) - 1
    return k[fresh], f[fresh], entry


def ask(block: int, keys: np.ndarray, further: np.ndarray, many: np.ndarray, shards: int, base: int) -> Iterator[pa.RecordBatch]:
    """A row for each shard that has some of these distinct (key, further) pairs, ascending; many: the pair is there more than once."""
    cuts = np.append(np.searchsorted(keys, shard_edges(shards)), len(keys))
    rows = []
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        part = slice(cuts[s], cuts[s + 1])
        rows.append((base + s, block, keys_to_bytes(keys[part]), further[part].tobytes() + np.packbits(many[part]).tobytes()))
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _PAIRS.types)], schema=_PAIRS)


def judge(table: pa.Table, hot: int) -> pa.Table:
    """The state of each pair that a shard was sent."""
    parts = [keys_from_bytes(b) for b in table.column("keys").to_pylist()]
    sizes = [len(p) for p in parts]
    keys = np.concatenate(parts)
    more = table.column("more").to_pylist()
    further = np.concatenate([np.frombuffer(m, "<u8", n) for m, n in zip(more, sizes)])
    many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8, -1, 8 * n), count=n) for m, n in zip(more, sizes)])
    order = np.lexsort((further, keys))
    k, f = keys[order], further[order]
    new_key = np.append(True, k[1:] != k[:-1])
    new_pair = new_key | np.append(True, f[1:] != f[:-1])
    pair = np.cumsum(new_pair) - 1
    again = (np.bincount(pair, weights=1 + many[order]) > 1)[pair]
    kinds = np.bincount(np.cumsum(new_key) - 1, weights=new_pair)[np.cumsum(new_key) - 1]
    state = np.where(again, np.where((kinds > 1) & new_pair, STANDS, WHOLE), np.where(kinds > 1, ASKS, ALONE)).astype(np.uint8)
    state[(kinds > hot) & (state >= ASKS)] += HOT_ASKS - ASKS
    states = np.empty(len(keys), np.uint8)
    states[order] = state
    split = np.split(states, np.cumsum(sizes)[:-1])
    counts = [np.bincount(s, minlength=6) for s in split]
    return pa.Table.from_arrays([table.column("shard"), table.column("block"), pa.array([zstandard.compress(s.tobytes(), 3) for s in split], pa.binary()), pa.array([int(c[ASKS] + c[STANDS]) for c in counts], pa.int64()), pa.array([int(c[HOT_ASKS] + c[HOT_STANDS]) for c in counts], pa.int64())], schema=_JUDGED)


def judged(asked: DataFrame, hot: int = HOT) -> DataFrame:
    """(shard, block, states, n_sent, n_hot) of the pairs that blocks asked about."""

    def shard(table: pa.Table) -> pa.Table:
        return judge(table, hot)

    return asked.groupBy("shard").applyInArrow(shard, JUDGED)


def judged_states(keys: np.ndarray, answers: list, shards: int, base: int) -> np.ndarray:
    """The states of a block's pairs, from what the shards answered."""
    cuts = np.append(np.searchsorted(keys, shard_edges(shards)), len(keys))
    states = np.zeros(len(keys), np.uint8)
    for a in answers:
        s = a["shard"] - base
        if 0 <= s < shards:
            states[cuts[s] : cuts[s + 1]] = np.frombuffer(zstandard.decompress(a["data"]), np.uint8)
    return states


def map_blocks(df: DataFrame, func: Callable[[dict], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """func for each block row (a dict)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}
                yield from func(row)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def shards_for(blocks: DataFrame, keys: int, per_shard: int = 2_000_000) -> int:
    """As many shards as keep each to about per_shard keys, however many keys there are, and no fewer than tasks can share."""
    needed = -(-keys // per_shard)
    return max(1, needed, min(shuffle_width(blocks.sparkSession), 1024))
