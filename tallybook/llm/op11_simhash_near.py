"""SimHash near-dedup: fingerprints of 64 bits that differ in at most four are linked.

1. Every text gets a fingerprint: a bit is set where more than half of the
   XXH64 hashes of its four-word shingles (repeats included) have it set.
   Equal fingerprints are one class; classes are compared, documents are not.
2. Four differing bits over three segments leave one segment with at most one.
   Each class is indexed under 64 deletion variants: for each bit, the rest of
   its segment with that bit left out. Two segments that differ by at most one
   bit share a variant, so an equality of variants finds every link.
3. The classes of a variant are verified by counting bits. Variants are dealt
   to shards by hash; one with more than TILE classes is cut into tiles first.
   A shard sends one edge for each class it could connect, never all pairs.
4. A cut variant whose tiles did not come out connected is finished exactly:
   the classes outside its largest component meet every tile once.

Defined results: null or empty text has fingerprint zero and is linked like any
other; texts under four words have their whole sequence as one shingle; equal
rows are linked; component_id is the least non-null id, null if there is none.
Ids may be of any orderable type; other columns pass through, and an input
column named like a result column is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from tallybook.llm.graph import components
from tallybook.llm.runtime import durable, shuffle_width, small_batches, small_side, without

SHINGLE, SEED = 4, 42
MOST = 4
SEGMENTS = [(0, 21), (21, 42), (42, 64)]
TILE = 4096
SHORT = 12
U = np.uint64
MADE = ["fingerprint", "component_id"]
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_EDGES = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def fingerprint(text: bytes | None) -> int:
    words = (text or b"").translate(_LOWER).split()
    if not words:
        return 0
    said = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= SHINGLE:
        spans = [(0, len(said))]
    else:
        spans = list(zip([0, *(ends[:-SHINGLE] + 1).tolist()], ends[SHINGLE - 1 :].tolist()))
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for k in range(0, len(spans), 1 << 15):
        h = np.array([digest(said[a:b], SEED) for a, b in spans[k : k + (1 << 15)]], "<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """docs with the fingerprint as a signed long, _fp."""
    small_batches(docs.sparkSession)
    kept = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    schema = StructType([*kept, StructField("_fp", LongType())])
    arrow_out, at = to_arrow_schema(schema), docs.columns.index(text_col)
    places = [k for k, f in enumerate(docs.schema.fields) if f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.array([fingerprint(t) for t in b.column(at).cast(pa.binary()).to_pylist()], U).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in places), pa.array(found)], schema=arrow_out)

    return docs.mapInArrow(run, schema)


def variants(classes: DataFrame) -> DataFrame:
    """(variant, fp): for each bit, its number and the rest of its segment."""
    keys = []
    for a, b in SEGMENTS:
        mask = (1 << b) - (1 << a)
        for bit in range(a, b):
            rest = mask & ~(1 << bit)
            rest -= (rest >> 63) << 64
            keys.append(F.lit(bit << 22).bitwiseOR(F.shiftrightunsigned(F.col("fp").bitwiseAND(F.lit(rest).cast("long")), a).cast("int")))
    return classes.select("fp", F.explode(F.array(*keys)).alias("variant"))


def connected(fps: np.ndarray, known: np.ndarray | None = None) -> np.ndarray:
    """For each fingerprint the place of one that stands for its component; places with equal known numbers are connected."""
    n, stands = len(fps), np.full(len(fps), -1)
    left = np.arange(n)
    while len(left):
        first = left[0]
        queue, left = [np.array([first])], left[1:]
        while queue:
            for i in queue.pop().tolist():
                stands[i] = first
                if len(left):
                    near = np.bitwise_count(fps[left] ^ fps[i]) <= MOST
                    if known is not None:
                        near |= known[left] == known[i]
                    if near.any():
                        queue.append(left[near])
                        left = left[~near]
    return stands


def tile_edges(table: pa.Table) -> pa.Table:
    """Edges between the classes of the same variant, in a shard of whole variants or in one tile."""
    variant, fps = table.column("variant").to_numpy(), table.column("fp").to_numpy().view(U)
    order = np.lexsort((fps, variant))
    variant, fps = variant[order], fps[order]
    starts = np.flatnonzero(np.append(True, variant[1:] != variant[:-1])) if len(fps) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(fps)))
    short = np.repeat(sizes <= SHORT, sizes)
    some_v, some_f = variant[short], fps[short]
    a, b = [np.empty(0, U)], [np.empty(0, U)]
    for d in range(1, SHORT):
        at = np.flatnonzero(some_v[d:] == some_v[:-d])
        at = at[np.bitwise_count(some_f[at] ^ some_f[at + d]) <= MOST]
        a.append(some_f[at])
        b.append(some_f[at + d])
    for s, n in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist()):
        group = fps[s : s + n]
        stands = connected(group)
        moved = stands != np.arange(n)
        a.append(group[stands[moved]])
        b.append(group[moved])
    pairs = np.unique(np.stack([np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)]), axis=1)
    return pa.Table.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=_EDGES)


def cross_edges(table: pa.Table) -> pa.Table:
    """Edges that join components: classes outside the largest component (few) against one tile."""
    fps, known, few = table.column("fp").to_numpy().view(U), table.column("component").to_numpy(), table.column("few").to_numpy(zero_copy_only=False)
    a, b = [], []
    joined = {int(c): int(c) for c in np.unique(known)}

    def root(c: int) -> int:
        while joined[c] != c:
            c = joined[c]
        return c

    for i in np.flatnonzero(few).tolist():
        near = np.flatnonzero((np.bitwise_count(fps ^ fps[i]) <= MOST) & (known != known[i]))
        for c, at in zip(*np.unique(known[near], return_index=True)):
            x, y = root(int(c)), root(int(known[i]))
            if x != y:
                joined[x] = y
                a.append(fps[i])
                b.append(fps[near[at]])
    return pa.Table.from_arrays([pa.array(np.array(x, U).view(np.int64)) for x in (a, b)], schema=_EDGES)


def linked(classes: DataFrame, tile: int = TILE, per_shard: int = 500_000) -> DataFrame:
    """(node, component) of the fingerprints of classes (fp, distinct) that have a link."""
    spark = classes.sparkSession
    count = classes.count()
    index = variants(classes)
    sizes = index.groupBy("variant").agg(F.count("*").alias("_n")).filter(F.col("_n") > tile)
    cut = small_side(sizes.select(F.col("variant").alias("_v"), F.ceil(F.col("_n") / tile).cast("int").alias("_k")))
    shards = max(1, -(-64 * count // per_shard), min(shuffle_width(spark), 1024))
    dealt = index.join(cut, index["variant"] == cut["_v"], "left").select(
        "variant", "fp",
        F.when(F.col("_k").isNull(), F.lit(-1)).otherwise(F.col("variant")).alias("x"),
        F.when(F.col("_k").isNull(), F.pmod(F.xxhash64("variant"), F.lit(shards))).otherwise(F.pmod(F.xxhash64("fp"), F.col("_k"))).alias("y"),
    )
    edges = dealt.groupBy("x", "y").applyInArrow(tile_edges, "a long, b long")
    labels = durable(components(edges))
    if cut.isEmpty():
        return labels
    hot = index.join(cut, index["variant"] == cut["_v"]).select("variant", "fp", "_k")
    named = durable(hot.join(labels, hot["fp"] == labels["node"], "left").select("variant", "fp", "_k", F.coalesce("component", "fp").alias("component")))
    parts = named.groupBy("variant", "component").agg(F.count("*").alias("_n"))
    main = parts.groupBy(F.col("variant").alias("_w")).agg(F.max_by("component", F.struct("_n", "component")).alias("_main"), F.sum("_n").alias("_all"), F.max("_n").alias("_most")).filter("_all > _most")
    mixed = durable(named.join(main, named["variant"] == main["_w"]).select("variant", "fp", "component", "_k", (F.col("component") != F.col("_main")).alias("few"), F.ceil((F.col("_all") - F.col("_most")) / tile).cast("int").alias("_m")))
    if mixed.isEmpty():
        return labels
    # each tile of a variant's classes meets each part of the few; a class of the few stands in its own tile as well
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own, part = F.pmod(F.xxhash64("fp"), F.col("_k")).cast("int"), F.pmod(F.xxhash64("fp", F.lit(1)), F.col("_m")).cast("int")
    whole = mixed.select("variant", own.alias("i"), each("_m").alias("j"), "fp", "component", F.lit(False).alias("few"))
    few = mixed.filter("few").select("variant", each("_k").alias("i"), part.alias("j"), "fp", "component", "few")
    more = whole.union(few).groupBy("variant", "i", "j").applyInArrow(cross_edges, "a long, b long")
    return durable(components(more.union(labels.selectExpr("node as a", "component as b"))))


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = True, tile: int = TILE) -> DataFrame:
    """docs with fingerprint (16 hex digits) and component_id."""
    found = durable(fingerprints(without(docs, [c for c in MADE if c != id_col]), text_col, keep_text))
    classes = durable(found.groupBy(F.col("_fp").alias("fp")).agg(F.min(id_col).alias("least")))
    labels = linked(classes.select("fp"), tile)
    named = classes.join(labels, classes["fp"] == labels["node"], "left").select("fp", "least", F.coalesce("component", "fp").alias("comp"))
    ids = named.groupBy(F.col("comp").alias("_comp")).agg(F.min("least").alias("component_id"))
    told = named.join(ids, named["comp"] == ids["_comp"]).select(F.col("fp").alias("_class"), "component_id")
    return found.join(told, found["_fp"] == told["_class"]).withColumn("fingerprint", F.lpad(F.lower(F.hex("_fp")), 16, "0")).drop("_fp", "_class")


def op11_simhash_near(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return simhash_groups(docs, keep_text=False).select("doc_id", "fingerprint", "component_id")
