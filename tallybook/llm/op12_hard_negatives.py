"""Hard negatives by angular triangle filtering.

Anchors are a stated query set (ids divisible by EVERY), compared with all rows.

1. Components become whole numbers. Each row keeps its norm and its angles to
   reference directions (label means of a bounded sample, by default at most
   REFERENCES of them). Rows of one label and length are laid out by their
   nearest reference and angle, and packed into blocks with the ranges of their
   norms and angles; anchors are packed into chunks of the same form.
2. If r is at angles a and x from an anchor and a row, the angle between those
   lies within |a - x| and a + x. The tightest interval over all references,
   times the norms and widened for rounding, bounds the whole-number score from
   both sides: for a block and a chunk as wholes first, then row by row.
3. Positives: chunks meet the blocks of their label in cells of bounded size;
   only rows whose upper bound reaches the fifth score so far are scored. Cells
   send their first five, a ranked window keeps five of all.
4. Negatives: each positive is a window of scores. Only rows of other labels
   whose interval overlaps a window of the anchor, and that could still enter
   its first three, are scored; again cells send three, a window keeps three.

Scores are exact: products of float64 where 2^53 bounds them, else Python's own
whole numbers (held within 64 bits when returned).

Defined results: null labels or vectors, and null or non-finite components, take
no part, nor do rows without an id; vectors of different lengths are not
compared; "other" rows are those of another id than the anchor's; rows with
equal ids and scores are ordered by label, repeated rows fill ranks each;
equal anchors (id, label, vector) count once; windows of negative positive
scores are empty; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.runtime import durable, shuffle_width, small_batches

EVERY, MOVED, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95
REFERENCES, SAMPLE = 16, 20_000
BLOCK, CHUNK, BLOCK_BYTES = 2048, 256, 4 << 20
CELL_BLOCKS, CELL_CHUNKS = 16, 16
#: Room for rounding of stored angles and of float32 products, as a part of the product of the norms.
SLACK = 1e-5
EXACT = 2.0**53

ROWS = "vec_id long, label long, dim int, near int, angle double, q binary"
_ROWS = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("dim", pa.int32()), ("near", pa.int32()), ("angle", pa.float64()), ("q", pa.binary())])
PACKED = "kind int, label long, dim int, pack long, data binary"
_PACKED = pa.schema([("kind", pa.int32()), ("label", pa.int64()), ("dim", pa.int32()), ("pack", pa.int64()), ("data", pa.binary())])
TOP = "anchor long, anchor_id long, slot int, positive_id long, positive_score long, vec_id long, label long, score long"
_TOP = pa.schema([(n, pa.int32() if n == "slot" else pa.int64()) for n in ("anchor", "anchor_id", "slot", "positive_id", "positive_score", "vec_id", "label", "score")])


def directions(rows: DataFrame, most: int = REFERENCES, lengths: int = 4) -> dict[int, np.ndarray]:
    """Unit reference directions for the commonest vector lengths of a sample: label means, then rows far from those."""
    sample = rows.select("label", "x").limit(SAMPLE).toArrow()
    label, vectors = sample.column("label").to_numpy(), sample.column("x").to_pylist()
    size = np.array([len(v) for v in vectors], np.int64)
    out = {}
    for n in sorted(set(size[size > 0].tolist()), key=lambda n: -int((size == n).sum()))[:lengths]:
        x = np.array([v for v, k in zip(vectors, size.tolist()) if k == n], np.float64).reshape(-1, n)
        good = np.isfinite(x).all(1)
        x, named = x[good], label[size == n][good]
        length = np.linalg.norm(x, axis=1)
        x, named = x[(length > 0) & (length < 1e150)], named[(length > 0) & (length < 1e150)]
        x = x / np.linalg.norm(x, axis=1)[:, None]
        means = [x[named == c].mean(0) for c in sorted(set(named.tolist()), key=lambda c: -int((named == c).sum()))[:most]]
        chosen = [m / np.linalg.norm(m) for m in means if np.linalg.norm(m) > 1e-9]
        while x.size and len(chosen) < most:
            closest = np.max(x @ np.array(chosen).T, axis=1) if chosen else -x[:, 0]
            chosen.append(x[int(closest.argmin())])
        out[n] = np.array(chosen).reshape(-1, n)
    return out


def angles_to(q: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Angles in radians between the rows of q and the references; zero vectors have a right angle."""
    length = np.linalg.norm(q, axis=1)
    return np.arccos(np.clip((q @ refs.T) / np.where(length > 0, length, 1)[:, None], -1, 1))


def laid_out(rows: DataFrame, refs: dict[int, np.ndarray]) -> DataFrame:
    """Whole-number components, nearest reference and its angle of the rows (vec_id, label, x) that take part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec_id, label, lists = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            size = lists.value_lengths().to_numpy(zero_copy_only=False)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            begins = np.concatenate(([0], np.cumsum(size)))
            for n in np.unique(size).tolist():
                at = np.flatnonzero(size == n)
                with np.errstate(over="ignore", invalid="ignore"):
                    q = np.floor(256 * flat[begins[at][:, None] + np.arange(n)])
                    ok = np.isfinite(q).all(1) & (np.abs(q).max(1, initial=0) < 1e150)
                at, q = at[ok], q[ok]
                angles = angles_to(q, refs[n]) if n in refs else np.zeros((len(at), 0))
                if angles.shape[1]:
                    near, angle = angles.argmin(1), angles.min(1)
                else:
                    near, angle = np.zeros(len(at), np.int64), np.zeros(len(at))
                small = np.abs(q).max(1, initial=0) < 2**31
                data = [(v.astype("<i4") if s else v.astype("<f8")).tobytes() for v, s in zip(q, small.tolist())]
                columns = (vec_id[at], label[at], np.full(len(at), n), near, angle, data)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _ROWS.types)], schema=_ROWS)

    small_batches(rows.sparkSession, 2048)
    return rows.mapInArrow(run, ROWS)


class Pack:
    """Rows of one label and length: ids, whole-number components, norms, angles, and their ranges."""

    def __init__(self, data: bytes, dim: int):
        table = pa.ipc.open_stream(data).read_all()
        self.ids = table.column("vec_id").to_numpy()
        wide = lambda name: np.array(table.column(name).combine_chunks().flatten()).reshape(len(self.ids), -1)
        self.q = wide("q") if dim else np.zeros((len(self.ids), 0))
        self.angles = wide("angles") if table.column("angles").type.list_size else np.zeros((len(self.ids), 0), np.float32)
        self.norms = np.linalg.norm(self.q, axis=1)
        self.cos, self.sin = np.cos(self.angles), np.sin(self.angles)
        self.low, self.high = self.angles.min(0), self.angles.max(0)

    @staticmethod
    def made(ids: list[int], q: list[bytes], dim: int, refs: np.ndarray | None) -> bytes:
        x = np.array([np.frombuffer(v, "<i4" if len(v) == 4 * dim else "<f8") for v in q], np.float64).reshape(len(ids), dim)
        angles = (angles_to(x, refs) if refs is not None else np.zeros((len(ids), 0))).astype(np.float32)
        flat = lambda a, t: pa.FixedSizeListArray.from_arrays(pa.array(a.ravel(), t), a.shape[1])
        hold = lambda a, t: flat(a, t) if a.shape[1] else pa.nulls(len(ids), pa.list_(t, 0))
        table = pa.table({"vec_id": pa.array(ids, pa.int64()), "q": hold(x, pa.float64()), "angles": hold(angles, pa.float32())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(table)
        return sink.getvalue().to_pybytes()


def packed(rows: DataFrame, refs: dict[int, np.ndarray], block: int, chunk: int) -> DataFrame:
    """Blocks (kind 0) of all rows and chunks (kind 1) of the anchors among them, in the order of their layout."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, place, last, copies = TaskContext.get().partitionId(), 0, None, None, set()
        held: tuple[list, list] = ([], [])

        def flush(kind: int) -> Iterator[pa.RecordBatch]:
            nonlocal seq
            if held[kind]:
                label, dim = place
                data = Pack.made([h[0] for h in held[kind]], [h[1] for h in held[kind]], dim, refs.get(dim))
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((kind, label, dim, (part << 32) | seq, data), _PACKED.types)], schema=_PACKED)
                seq += 1
                held[kind].clear()

        for batch in batches:
            for vec_id, label, dim, near, angle, q in zip(*(c.to_pylist() for c in batch.columns)):
                if (label, dim) != place:
                    yield from flush(0)
                    yield from flush(1)
                    place = (label, dim)
                held[0].append((vec_id, q))
                if vec_id % EVERY == 0:
                    now = (label, dim, near, angle, vec_id)
                    copies = copies if now == last else set()
                    last = now
                    if q not in copies:
                        copies.add(q)
                        held[1].append((vec_id, q))
                if len(held[0]) >= max(1, min(block, BLOCK_BYTES // (8 * dim + 8))):
                    yield from flush(0)
                if len(held[1]) >= chunk:
                    yield from flush(1)
        if place is not None:
            yield from flush(0)
            yield from flush(1)

    keys = ["label", "dim", "near", "angle", "vec_id"]
    order = rows.repartitionByRange(max(shuffle_width(rows.sparkSession), rows.sparkSession.sparkContext.defaultParallelism), *keys).sortWithinPartitions(*keys)
    return order.mapInArrow(run, PACKED)


def pack_bounds(one: Pack, other: Pack) -> tuple[float, float]:
    """Bounds of the scores between any rows of two packs."""
    least, most = float(one.norms.min() * other.norms.min()), float(one.norms.max() * other.norms.max())
    up, down = 1.0, -1.0
    if len(one.low):
        apart = np.maximum(0, np.maximum(one.low - other.high, other.low - one.high))
        up = float(np.cos(apart).min())
        begin, end = (one.low + other.low).astype(np.float64), (one.high + other.high).astype(np.float64)
        down = float(np.where((begin <= np.pi) & (end >= np.pi), -1, np.minimum(np.cos(begin), np.cos(end))).max())
    up, down = up + SLACK, down - SLACK
    return max(up * least, up * most) + 1, min(down * least, down * most) - 1


def row_bounds(anchors: Pack, rows: Pack) -> tuple[np.ndarray, np.ndarray]:
    """Upper and lower bounds of every anchor's score with every row of a block."""
    up = np.ones((len(anchors.ids), len(rows.ids)), np.float32)
    down = -up
    for r in range(anchors.cos.shape[1]):
        along = anchors.cos[:, r, None] * rows.cos[None, :, r]
        across = anchors.sin[:, r, None] * rows.sin[None, :, r]
        np.minimum(up, along + across, out=up)
        np.maximum(down, along - across, out=down)
    norms = anchors.norms[:, None] * rows.norms[None, :]
    return norms * (up + SLACK) + 1, norms * (down - SLACK) - 1


def scores(q: np.ndarray, anchor: np.ndarray, exact: bool) -> np.ndarray:
    """Whole-number inner products, held within 64 bits."""
    if exact:
        return (q @ anchor).astype(np.int64)
    a = [int(v) for v in anchor]
    return np.array([min(max(sum(int(x) * y for x, y in zip(row, a)), -(2**63)), 2**63 - 1) for row in q.tolist()], np.int64)


class Best:
    """The first few of what has been scored: higher scores first, ties by id."""

    def __init__(self, most: int):
        self.most, self.found = most, []

    def floor(self) -> float:
        return self.found[-1][0] * -1 if len(self.found) == self.most else -np.inf

    def add(self, score: np.ndarray, ids: np.ndarray, label: int) -> None:
        if len(score) > self.most:
            order = np.lexsort((ids, np.invert(score)))[: self.most]  # ~x falls as x rises, and never overflows
            score, ids = score[order], ids[order]
        self.found = sorted(self.found + [(-int(s), int(i), label) for s, i in zip(score, ids)])[: self.most]


def cell_top(table: pa.Table) -> pa.Table:
    """What the chunks of a cell find among its blocks: first positives where no windows are given, else first negatives of each window."""
    packs: tuple[list, list] = ([], [])
    windows_of = {}
    for row in table.to_pylist():
        packs[row["kind"]].append((row["label"], row["pack"], Pack(row["data"], row["dim"])))
        windows_of[row["pack"]] = row.get("windows")
    out = []
    for label, number, anchors in packs[1]:
        wanted = windows_of[number]
        slots: list[list[tuple]] = [[] for _ in anchors.ids]
        if wanted is None:
            for at in slots:
                at.append((0, None, None, -np.inf, np.inf, Best(POSITIVES)))
        else:
            for w in wanted:
                low, high = -(-LOW * w["score"] // 100), HIGH * w["score"] // 100
                if low <= high:
                    slots[w["row"]].append((w["slot"], w["vec_id"], w["score"], low, high, Best(NEGATIVES)))
        blocks = []
        for other, _, rows in packs[0]:
            if (other == label) == (wanted is None):
                blocks.append((*pack_bounds(anchors, rows), other, rows))
        blocks.sort(key=lambda b: -b[0])
        for top, bottom, other, rows in blocks:
            reached = [i for i, ws in enumerate(slots) if any(top >= max(w[3], w[5].floor()) and bottom <= w[4] for w in ws)]
            if not reached:
                continue
            up, down = row_bounds(anchors, rows)
            exact = float(anchors.norms.max() * rows.norms.max()) < EXACT
            for i in reached:
                may = np.zeros(len(rows.ids), bool)
                for w in slots[i]:
                    may |= (up[i] >= max(w[3], w[5].floor())) & (down[i] <= w[4])
                at = np.flatnonzero(may & (rows.ids != anchors.ids[i]))
                if not len(at):
                    continue
                got, ids = scores(rows.q[at], anchors.q[i], exact), rows.ids[at]
                for w in slots[i]:
                    inside = (got >= max(w[3], w[5].floor())) & (got <= w[4])
                    if inside.any():
                        w[5].add(got[inside], ids[inside], other)
        for i, ws in enumerate(slots):
            for slot, positive, score, _, _, best in ws:
                out += [(number * CHUNK + i, int(anchors.ids[i]), slot, positive, score, v, c, -s) for s, v, c in best.found]
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TOP.types)] if out else [pa.array([], t) for t in _TOP.types], schema=_TOP)


def cells(packs: DataFrame, keys: list[str], cell_blocks: int, cell_chunks: int) -> DataFrame:
    """Packs dealt to cells (keys, strip, wave): each block with each chunk of the same keys once, a bounded number of either in
    a cell, and as many strips as tasks can share where there are few blocks."""
    wide = packs.sparkSession.sparkContext.defaultParallelism
    own = [F.col(k).alias(f"_{k}") for k in keys]
    sizes = packs.groupBy(*own).agg(
        F.greatest(F.ceil(F.count(F.when(F.col("kind") == 0, 1)) / cell_blocks), F.least(F.count(F.when(F.col("kind") == 0, 1)), F.lit(wide))).cast("int").alias("strips"),
        F.ceil(F.count(F.when(F.col("kind") == 1, 1)) / cell_chunks).cast("int").alias("waves"),
    ).filter("strips > 0 and waves > 0")
    on = [packs[k] == F.col(f"_{k}") for k in keys]
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = lambda n: F.array(F.pmod(F.xxhash64("pack"), F.col(n)).cast("int"))
    block = F.col("kind") == 0
    return (
        packs.join(sizes, on).withColumn("strip", F.explode(F.when(block, dealt("strips")).otherwise(each("strips"))))
        .withColumn("wave", F.explode(F.when(block, each("waves")).otherwise(dealt("waves")))).drop("strips", "waves", *[f"_{k}" for k in keys])
    )


def first(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "label"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= most)


def hard_negatives(
    rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    block: int = BLOCK, chunk: int = CHUNK, cell_blocks: int = CELL_BLOCKS, cell_chunks: int = CELL_CHUNKS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    label = F.when(F.col(id_col) % MOVED == 0, (F.col(label_col) + 1) % LABELS).otherwise(F.col(label_col))
    x = F.col(vector_col)
    whole = ~F.exists(x, lambda v: v.isNull())
    kept = rows.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & x.isNotNull() & whole)
    kept = kept.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("long").alias("label"), x.cast("array<double>").alias("x"))
    refs = directions(kept)
    packs = durable(packed(laid_out(kept, refs), refs, block, min(chunk, CHUNK)))
    group = ["label", "dim", "strip", "wave"]
    close = cells(packs, ["label", "dim"], cell_blocks, cell_chunks).groupBy(*group).applyInArrow(cell_top, TOP)
    positives = first(close, ["anchor"], POSITIVES)
    window = F.struct((F.col("anchor") % CHUNK).cast("int").alias("row"), F.col("rank").alias("slot"), "vec_id", "score")
    windows = positives.groupBy(F.floor(F.col("anchor") / CHUNK).alias("_pack")).agg(F.collect_list(window).alias("windows"))
    asking = packs.filter("kind = 1").join(windows, F.col("pack") == F.col("_pack")).drop("_pack")
    both = durable(asking.unionByName(packs.filter("kind = 0"), allowMissingColumns=True))
    far = cells(both, ["dim"], cell_blocks, cell_chunks).groupBy("dim", "strip", "wave").applyInArrow(cell_top, TOP)
    found = first(far, ["anchor", "slot"], NEGATIVES)
    return found.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label"))


ORACLE = """
with r as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same,
    coalesce(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])), 0) as score
  from r a join r b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id and len(a.q) = len(b.q)),
p as (select * from (select anchor_id, vec_id as positive_id, score, row_number() over (partition by anchor_id order by score desc, vec_id) as k from s where same) where k <= 5),
n as (
  select p.anchor_id, p.positive_id, s.vec_id as negative_id, p.score as positive_score, s.score as negative_score,
    row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id) as k
  from p join s on s.anchor_id = p.anchor_id and not s.same and 50 * p.score <= 100 * s.score and 100 * s.score <= 95 * p.score)
select anchor_id, positive_id, cast(k as integer) as rank, negative_id, cast(positive_score as bigint) as positive_score, cast(negative_score as bigint) as negative_score
from n where k <= 3
"""
