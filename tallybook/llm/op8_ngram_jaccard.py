"""N-gram Jaccard join: documents whose sets of five-word shingles overlap by 0.75 or more.

1. Documents with equal sets are one class. An exchange of shingle hashes gives
   every block the rough frequency of its shingles in the corpus (rounded to
   powers of two), which fixes one global order, rarest first.
2. Of each set only the first n - ceil(0.75 n) + 1 shingles in that order are
   sent: two sets that link share one of those. Shingles that occur once are
   dropped, so a set with a quarter of its own shingles sends nothing.
3. A shingle's classes form a list; equal lists become one. Classes meet in
   tiles of some hundred, sorted by size: for a class only the band of sizes
   from 0.75 of its own counts, hashed parity bitmaps bound the overlap from
   above by their bit counts, and what is left is decided by intersecting the
   sorted arrays. Pairs that are connected already are not looked at again.
4. The first round of tiles puts each class with the two hubs it shares most
   lists with. Lists whose classes still lie in several components afterwards
   are finished exactly: their classes are dealt to tiles by hub and size band
   (a factor of 4/3), and every two tiles of the same or neighbouring bands
   that meet in such a list are compared once, whatever the list's length.
   Only pairs of tiles are ever listed, not pairs of classes.
5. The whole join deals all classes with a list to tiles as in 4 and decides
   every two sets of tiles that meet, connected or not. A class has one tile, so
   each pair is decided once. links() adds up, inside the tiles, how many rows
   the partners of a class hold and names one class it is connected with, so
   neither pairs nor copies are written out; pairs lists the linked classes.

Hashes are 64 bits wide, for shingles and for classes.

Defined results: null or empty text has an empty set, is linked with nothing
and is its own component; texts under five words have their whole sequence as
one shingle; equal rows are linked; component_id is the least non-null id, in
the order of the id's type (any type that has one); an empty table gives none.
Other columns travel in the blocks and come back from keepers() alone, so no
name clashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DataType, IntegerType, LongType, StructField, StructType

from tallybook.llm.blocks import KEYS_SCHEMA, by_shard, emit_keys, keys_from_bytes, keys_to_bytes, map_blocks, open_block, pack_blocks, shards_for, texts_of, total_bytes
from tallybook.llm.graph import components
from tallybook.llm.kernels import Words, mix, spans_hash, windows_hash
from tallybook.llm.runtime import durable

SHINGLE = 5
TILE = 400
#: Of a tile of the full join: sets, and shingles in all of them (8 bytes each).
JOIN_TILE, JOIN_SHINGLES = 1000, 1_000_000
U = np.uint64


def shingle_sets(texts: list[bytes | None], length: int = SHINGLE) -> list[np.ndarray]:
    """Ascending distinct shingle hashes of each text, A-Z lower-cased."""
    words = Words(texts, lower=True)
    grams = windows_hash(words.hashes, length, 0)
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        if b - a >= length:
            g = np.sort(grams[a : b - length + 1])
            out.append(g[np.append(True, g[1:] != g[:-1])])
        elif b > a:
            out.append(spans_hash(words.hashes[a:b], np.array([0]), np.array([b - a]), 2) + U(b - a))
        else:
            out.append(np.empty(0, U))
    return out


def class_of(s: np.ndarray) -> int:
    """One number for equal sets (-1: the empty set)."""
    if not len(s):
        return -1
    both = np.array([s.sum(dtype=U), mix(s ^ U(0x5851F42D4C957F2D)).sum(dtype=U), len(s)], U)
    return int((mix(both) * np.array([1, 3, 5], U)).sum(dtype=U) >> U(1))


def _block_classes(row: dict, text_col: str) -> tuple[list[int], list[np.ndarray], dict[int, int]]:
    """Class of each row, and the distinct non-empty sets with their places."""
    sets = shingle_sets(texts_of(open_block(row["data"]), text_col))
    classes = [class_of(s) for s in sets]
    first: dict[int, int] = {}
    distinct = []
    for c, s in zip(classes, sets):
        if c >= 0 and c not in first:
            first[c] = len(distinct)
            distinct.append(s)
    return classes, distinct, first


def _joined(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.empty(0, U)), np.concatenate(([0], np.cumsum(sizes)))


def rough_counts(keys: DataFrame) -> DataFrame:
    """(block, answers): for each shard the bit length of (count - 1) of each of the block's sorted keys."""
    out = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("mask", pa.binary())])

    def group(table: pa.Table) -> pa.Table:
        parts = [keys_from_bytes(b) for b in table.column("keys").to_pylist()]
        _, inverse, counts = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
        level = np.ceil(np.log2(counts)).astype(np.uint8)[inverse]
        split = np.split(level, np.cumsum([len(p) for p in parts])[:-1])
        return pa.Table.from_arrays([table.column("shard"), table.column("block"), pa.array([zstandard.compress(x.tobytes(), 1) for x in split], pa.binary())], schema=out)

    return keys.groupBy("shard").applyInArrow(group, "shard int, block long, mask binary").groupBy("block").agg(F.collect_list(F.struct("shard", "mask")).alias("answers"))


def _banded(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """By size: order, sizes, sets, parity bitmaps, and the first place whose size is at least 0.75 of each one's."""
    n = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(n, kind="stable")
    n = n[order]
    ordered = [sets[i] for i in order.tolist()]
    width = 64
    while width < min(8192, int(np.median(n)) if len(n) else 0):
        width *= 2
    packed = np.zeros((len(n), width // 64), np.uint64)
    for i, s in enumerate(ordered):
        packed[i] = np.packbits((np.bincount((s % U(width)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).view(np.uint64)
    return order, n, ordered, packed, np.searchsorted(n, -(-3 * n // 4))


def _may_link(near: np.ndarray, i: int, n: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Those of near whose bitmaps leave room for the overlap that a link with i needs."""
    apart = np.bitwise_count(packed[near] ^ packed[i]).sum(1, dtype=np.int64)
    total = n[near] + n[i]
    most = (total - apart) // 2
    return near[100 * most >= 75 * (total - most)]


def compare_tile(sets: list[np.ndarray], known: list[int] | None = None) -> list[int]:
    """For each set the place of the first set it is connected with inside the tile; known: equal numbers are connected."""
    m = len(sets)
    order, n, ordered, packed, band = _banded(sets)
    part = np.arange(m) if known is None else np.unique(np.array(known, np.int64)[order], return_inverse=True)[1]
    for i in range(m):
        near = np.arange(band[i], i)
        near = near[part[near] != part[i]]
        if not len(near):
            continue
        for j in _may_link(near, i, n, packed).tolist():
            if part[j] != part[i]:
                a, b = ordered[j], ordered[i]
                at = np.minimum(np.searchsorted(b, a), len(b) - 1)
                both = int((b[at] == a).sum())
                if 100 * both >= 75 * (len(a) + len(b) - both):
                    part[part == part[i]] = part[j]
    first: dict[int, int] = {}
    out = [0] * m
    for p, i in sorted(zip(part.tolist(), order.tolist()), key=lambda x: x[1]):
        out[i] = first.setdefault(p, i)
    return out


def tile_pairs(sets: list[np.ndarray], side: list[int]) -> list[tuple[np.ndarray, int, np.ndarray]]:
    """(places of partners, place, sizes of the intersections) of all linked sets; with two sides only across them."""
    order, n, ordered, packed, band = _banded(sets)
    of = np.array(side, np.int64)[order]
    across = len(set(side)) > 1
    out = []
    for i in range(len(sets)):
        near = np.arange(band[i], i)
        if across:
            near = near[of[near] != of[i]]
        if len(near):
            near = _may_link(near, i, n, packed)
        if len(near):
            mine, others = ordered[i], np.concatenate([ordered[j] for j in near.tolist()])
            at = np.minimum(np.searchsorted(mine, others), len(mine) - 1)
            both = np.add.reduceat((mine[at] == others).astype(np.int64), np.cumsum(n[near]) - n[near])
            linked = 100 * both >= 75 * (n[near] + n[i] - both)
            if linked.any():
                out.append((order[near[linked]], int(order[i]), both[linked]))
    return out


def _post(id_type: DataType) -> tuple[StructType, pa.Schema]:
    """What blocks send on: prefix shingles by shard, and (shard -1) id, size and class of each row."""
    many = [("ids", id_type), ("sizes", LongType()), ("classes", LongType())]
    fields = [("shard", IntegerType()), ("block", LongType()), ("keys", BinaryType()), ("more", BinaryType()), *((c, ArrayType(t)) for c, t in many)]
    post = StructType([StructField(c, t) for c, t in fields])
    return post, to_arrow_schema(post)


_LISTS = pa.schema([("list", pa.int64()), ("hub", pa.int64()), ("cls", pa.int64()), ("n", pa.int64())])


class NearDuplicates:
    """The join over docs; pairs, membership() and keepers() read its results."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        self.columns, self.text_col, self.docs_schema = docs.columns, text_col, docs.schema
        self.blocks = blocks = pack_blocks(docs, text_col)
        post, arrow = _post(docs.schema[id_col].dataType)
        estimate = total_bytes(blocks) // 6 + 1
        shards = shards_for(blocks, estimate)
        keep = U(64 - min(64, estimate.bit_length() + 13))

        def coarse(keys: np.ndarray) -> np.ndarray:
            return (keys >> keep) << keep

        def send(row: dict) -> Iterator[pa.RecordBatch]:
            _, sets, _ = _block_classes(row, text_col)
            if sets:
                yield emit_keys(row["block"], coarse(_joined(sets)[0]), None, shards)

        counts = rough_counts(map_blocks(blocks, send, KEYS_SCHEMA))

        def prefixes(row: dict) -> Iterator[pa.RecordBatch]:
            ids = open_block(row["data"]).column(id_col).to_pylist()
            classes, sets, first = _block_classes(row, text_col)
            size = {c: len(sets[k]) for c, k in first.items()}
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((-1, row["block"], None, None, ids, [size.get(c, 0) for c in classes], classes), arrow.types)], schema=arrow)
            if not sets:
                return
            hashes, cuts = _joined(sets)
            order, edges = by_shard(coarse(hashes), shards)
            level = np.zeros(len(hashes), np.uint8)
            for a in row["answers"]:
                level[order[edges[a["shard"]] : edges[a["shard"] + 1]]] = np.frombuffer(zstandard.decompress(a["mask"]), np.uint8)
            keys, owner = [], []
            for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
                n = b - a
                take = np.argsort(level[a:b], kind="stable")[: n - (3 * n + 3) // 4 + 1]
                take = take[level[a:b][take] > 0]
                keys.append(hashes[a:b][take])
                owner.append(np.full(len(take), k, "<u4"))
            keys, owner = np.concatenate(keys), np.concatenate(owner)
            cls, sizes = np.array(list(first), "<i8"), np.array([len(s) for s in sets], "<u4")
            order, edges = by_shard(keys, shards)
            for s in np.flatnonzero(np.diff(edges)).tolist():
                part = order[edges[s] : edges[s + 1]]
                used, local = np.unique(owner[part], return_inverse=True)
                more = np.uint32(len(used)).tobytes() + cls[used].tobytes() + sizes[used].tobytes() + local.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((s, row["block"], keys_to_bytes(keys[part]), zstandard.compress(more, 1), None, None, None), arrow.types)], schema=arrow)

        posted = durable(map_blocks(blocks.join(counts, "block", "left"), prefixes, post))
        self.members = posted.filter("shard = -1").select("block", F.posexplode(F.arrays_zip("ids", "sizes", "classes")).alias("row", "x")).select("block", "row", F.col("x.ids").alias("id"), F.col("x.sizes").alias("n"), F.col("x.classes").alias("cls"))
        self.lists = durable(posted.filter("shard >= 0").select("shard", "keys", "more").groupBy("shard").applyInArrow(shared_lists, "list long, hub long, cls long, n long").distinct())

    @cached_property
    def _tiles(self) -> DataFrame:
        """(x, y, cls, component) of the whole join; the tile stands where the other comparison has the component: it tells sides apart."""
        dealt = durable(self._dealt(self.lists.withColumn("component", F.lit(None).cast("long")), JOIN_TILE, JOIN_SHINGLES))
        meets = durable(self.lists.select("list", "cls").join(dealt, "cls").select("list", "tile", "band").distinct())
        return self._meeting(meets, "true").join(dealt.select("tile", "cls"), "tile").select("x", "y", "cls", F.col("tile").alias("component"))

    @cached_property
    def pairs(self) -> DataFrame:
        """(a, b, n_a, n_b, n_both) of all pairs of different classes that link, each once; names as cls in membership()."""
        return durable(self._compare(self._tiles, linked, LINKED))

    @cached_property
    def _counted(self) -> DataFrame:
        """(a, b, n_rows) for each class a with partners in a tile: one it is connected with there, and the rows that its partners hold."""
        return durable(self._compare(self._tiles, counted, COUNTED))

    @cached_property
    def labels(self) -> DataFrame:
        """(node, component) of all classes with a link: from the whole join, where it was made, else from the links that connect."""
        if "_counted" in self.__dict__:
            return durable(components(self._counted))
        return self._link(self.lists)

    def _around_hubs(self, pairs: DataFrame) -> DataFrame:
        """Tiles (x, y, cls) of about TILE members around each hub, from pairs (hub, cls)."""
        many = pairs.groupBy(F.col("hub").alias("_hub")).agg(F.ceil(F.count("*") / TILE).cast("int").alias("_k"))
        dealt = pairs.join(many, pairs["hub"] == many["_hub"]).select(F.col("hub").alias("x"), F.pmod(F.xxhash64("cls"), F.col("_k")).cast("long").alias("y"), "cls")
        return dealt.union(many.select(F.col("_hub").alias("x"), F.explode(F.sequence(F.lit(0).cast("long"), (F.col("_k") - 1).cast("long"))).alias("y"), F.col("_hub").alias("cls"))).distinct()

    def _dealt(self, rows: DataFrame, sets: int, shingles: int | None = None) -> DataFrame:
        """(cls, component, band, tile) from the lists' rows: a tile holds classes of one hub and size band, about so many sets or shingles."""
        long = rows.groupBy(F.col("list").alias("_list")).agg(F.count("*").alias("_size"))
        banded = rows.join(long, F.col("list") == F.col("_list")).groupBy("cls", "n", "component").agg(F.max_by("hub", F.struct("_size", "list")).alias("hub")).withColumn("band", F.floor(F.log("n") / F.log(F.lit(4 / 3))).cast("int"))
        share = F.count("*") / sets
        sizes = banded.groupBy(F.col("hub").alias("_hub"), F.col("band").alias("_band")).agg(F.ceil(F.greatest(share, F.sum("n") / shingles) if shingles else share).cast("int").alias("_k"))
        dealt = banded.join(sizes, (F.col("hub") == F.col("_hub")) & (F.col("band") == F.col("_band")))
        return dealt.select("cls", "component", "band", F.xxhash64("hub", "band", F.pmod(F.xxhash64("cls"), F.col("_k"))).alias("tile"))

    def _meeting(self, meets: DataFrame, condition: str) -> DataFrame:
        """(x, y, tile), tile either of the two: tiles of the same or neighbouring bands with a list in common, once."""
        one, other = meets.alias("p"), meets.alias("q")
        fits = f"p.list = q.list and p.tile <= q.tile and abs(p.band - q.band) <= 1 and {condition}"
        pairs = durable(one.join(other, F.expr(fits)).select(F.col("p.tile").alias("x"), F.col("q.tile").alias("y")).distinct())
        return pairs.select("x", "y", F.col("x").alias("tile")).union(pairs.filter("x <> y").select("x", "y", F.col("y").alias("tile")))

    def _compare(self, tiles: DataFrame, decide: Callable[[pa.Table], pa.Table] | None = None, schema: str = "a long, b long") -> DataFrame:
        """What decide (else: the edges that connect) finds in the texts of tiles (x, y, cls, component or null)."""
        place = self.members.filter("cls >= 0").groupBy("cls").agg(F.min(F.struct("block", "row")).alias("p"), F.count("*").alias("held"))
        wanted = tiles.join(place, "cls").select(F.col("p.block").alias("block"), F.struct("p.row", "cls", "component", "x", "y", "held").alias("w"))
        asked = wanted.groupBy("block").agg(F.collect_list("w").alias("wanted"))
        text_col = self.text_col
        sent_schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("cls", pa.int64()), ("component", pa.int64()), ("held", pa.int64()), ("data", pa.binary())])

        def texts(row: dict) -> Iterator[pa.RecordBatch]:
            held = texts_of(open_block(row["data"]), text_col)
            for at in range(0, len(row["wanted"]), 64):
                w = row["wanted"][at : at + 64]
                columns = {c: [v[c] for v in w] for c in ("x", "y", "cls", "component", "held")}
                yield pa.RecordBatch.from_pydict({**columns, "data": [zstandard.compress(held[v["row"]], 1) for v in w]}, schema=sent_schema)

        def connect(table: pa.Table) -> pa.Table:
            cls, known = table.column("cls").to_pylist(), table.column("component").to_pylist()
            at = compare_tile(shingle_sets([zstandard.decompress(d) for d in table.column("data").to_pylist()]), None if known[0] is None else known)
            found = [(cls[i], cls[k]) for i, k in enumerate(at) if i != k]
            return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

        sent = map_blocks(self.blocks.join(asked, "block"), texts, "x long, y long, cls long, component long, held long, data binary")
        return sent.groupBy("x", "y").applyInArrow(decide or connect, schema)

    def _link(self, lists: DataFrame) -> DataFrame:
        """(node, component) of all classes with a link."""
        best = Window.partitionBy("cls").orderBy(F.desc("_votes"), "hub")
        votes = durable(lists.groupBy("hub", "cls").agg(F.count("*").alias("_votes")))
        first = votes.filter("hub <> cls").withColumn("_r", F.row_number().over(best)).filter("_r <= 2").select("hub", "cls")
        labels = durable(components(self._compare(self._around_hubs(first).withColumn("component", F.lit(None).cast("long")))))

        named = lists.join(labels, lists["cls"] == labels["node"], "left").select("list", "hub", "cls", "n", F.coalesce("component", "cls").alias("component"))
        mixed = named.groupBy("list").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi")).filter("_lo < _hi").select("list")
        split = durable(named.join(mixed, "list", "left_semi"))
        if split.isEmpty():
            return labels
        # tiles by the hub of a class's longest list and by size band: sets that link lie in the same or in neighbouring
        # bands, and the classes of one long list fill few tiles
        dealt = durable(self._dealt(split, TILE))
        meets = durable(split.select("list", "cls").join(dealt, "cls").groupBy("list", "tile", "band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")))
        sides = self._meeting(meets, "least(p.lo, q.lo) < greatest(p.hi, q.hi)")
        more = self._compare(sides.join(dealt.select("tile", "cls", "component"), "tile").select("x", "y", "cls", "component"))
        return durable(components(more.union(labels.selectExpr("node as a", "component as b"))))

    def membership(self) -> DataFrame:
        """(block, row, id, n, cls, component_id) for every row."""
        named = self.members.join(self.labels, self.members["cls"] == self.labels["node"], "left").withColumn("comp", F.coalesce("component", "cls"))
        least = named.filter("cls >= 0").groupBy(F.col("comp").alias("_comp")).agg(F.min("id").alias("_least"))
        return named.join(least, named["comp"] == least["_comp"], "left").select("block", "row", "id", "n", "cls", "comp", F.coalesce("_least", "id").alias("component_id"))

    def links(self) -> DataFrame:
        """(cls, n_links): how many other rows a row of the class links with, for all classes but the empty set's."""
        held = self.members.filter("cls >= 0").groupBy("cls").agg(F.count("*").alias("held"))
        others = self._counted.groupBy(F.col("a").alias("_cls")).agg(F.sum("n_rows").alias("_others"))
        return held.join(others, held["cls"] == others["_cls"], "left").select("cls", (F.coalesce("_others", F.lit(0)) + F.col("held") - 1).alias("n_links"))

    def keepers(self) -> DataFrame:
        """The rows of docs, one of each component: the least id, the first such row."""
        named = self.membership()
        first = F.struct(F.col("id").isNull().alias("z"), F.col("id"), F.col("block"), F.col("row"))
        linked = named.filter("cls >= 0").groupBy("comp").agg(F.min(first).alias("k")).select("k.block", "k.row")
        alone = named.filter("cls < 0").select("block", "row")
        wanted = linked.union(alone).groupBy("block").agg(F.sort_array(F.collect_list("row")).alias("rows"))

        def pick(row: dict) -> Iterator[pa.RecordBatch]:
            yield from open_block(row["data"]).take(pa.array(row["rows"], pa.int64())).combine_chunks().to_batches(max_chunksize=256)

        return map_blocks(self.blocks.join(wanted, "block"), pick, self.docs_schema)


LINKED = "a long, b long, n_a long, n_b long, n_both long"


def linked(table: pa.Table) -> pa.Table:
    """The linked pairs of the classes of one tile, or across two."""
    cls = np.array(table.column("cls").to_pylist(), np.int64)
    sets = shingle_sets([zstandard.decompress(d) for d in table.column("data").to_pylist()])
    n = np.array([len(s) for s in sets], np.int64)
    found = tile_pairs(sets, table.column("component").to_pylist())
    a = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
    b = np.concatenate([np.full(len(f[0]), f[1]) for f in found]) if found else a
    both = np.concatenate([f[2] for f in found]) if found else a
    return pa.table({"a": cls[a], "b": cls[b], "n_a": n[a], "n_b": n[b], "n_both": both})


COUNTED = "a long, b long, n_rows long"


def counted(table: pa.Table) -> pa.Table:
    """For each class with a partner in the tile, or across two: a class it is connected with, and the rows its partners hold."""
    cls, held = (np.array(table.column(c).to_pylist(), np.int64) for c in ("cls", "held"))
    sets = shingle_sets([zstandard.decompress(d) for d in table.column("data").to_pylist()])
    rows, part = np.zeros(len(cls), np.int64), np.arange(len(cls))
    for partners, i, _ in tile_pairs(sets, table.column("component").to_pylist()):
        rows[i] += held[partners].sum()
        rows[partners] += held[i]
        met = np.unique(np.append(part[partners], part[i]))
        if len(met) > 1:
            part[np.isin(part, met)] = met[0]
    has = rows > 0
    return pa.table({"a": cls[has], "b": cls[part[has]], "n_rows": rows[has]})


def shared_lists(table: pa.Table) -> pa.Table:
    """The lists of at least two classes that share a prefix shingle, each distinct list once."""
    keys, cls, sizes = [], [], []
    for k, m in zip(table.column("keys").to_pylist(), table.column("more").to_pylist()):
        raw = zstandard.decompress(m)
        u = int(np.frombuffer(raw, "<u4", 1)[0])
        local = np.frombuffer(raw, "<u4", -1, 4 + 12 * u)
        keys.append(keys_from_bytes(k))
        cls.append(np.frombuffer(raw, "<i8", u, 4)[local])
        sizes.append(np.frombuffer(raw, "<u4", u, 4 + 8 * u)[local])
    keys, cls, sizes = np.concatenate(keys), np.concatenate(cls), np.concatenate(sizes)
    order = np.lexsort((cls, keys))
    keys, cls, sizes = keys[order], cls[order], sizes[order]
    fresh = np.append(True, (keys[1:] != keys[:-1]) | (cls[1:] != cls[:-1]))
    keys, cls, sizes = keys[fresh], cls[fresh], sizes[fresh]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    lengths = np.diff(np.append(starts, len(keys)))
    spread = mix(cls.view(U))
    name = np.add.reduceat(spread, starts) if len(starts) else spread
    _, pick = np.unique(name[lengths > 1], return_index=True)
    pick = np.flatnonzero(lengths > 1)[pick]
    out: list[list[np.ndarray]] = [[], [], [], []]
    for g in pick.tolist():
        part = slice(starts[g], starts[g] + lengths[g])
        hub = cls[part][int(spread[part].argmin())]
        for column, value in zip(out, (np.full(lengths[g], name[g] >> U(1), U).astype(np.int64), np.full(lengths[g], hub), cls[part], sizes[part].astype(np.int64))):
            column.append(value)
    return pa.Table.from_arrays([pa.array(np.concatenate(c) if c else [], pa.int64()) for c in out], schema=_LISTS)


def op8_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = NearDuplicates(docs)
    links = found.links()
    rows = found.membership().join(links, "cls", "left")
    return rows.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
