"""Suffix-array dedup: bytes under a string of so many bytes that also starts anywhere else are cut.

A sparse suffix array decides it. Suffixes are sorted only at anchors, the
places of least hash among the grams (two fifths of the length) of each
window: equal windows have equal anchors, so nothing is lost.

1. What must be sorted is found first. Each block sends the hashes of its
   anchors' grams, and of all bytes that windows at the anchor can hold (its
   context), each pair once. A gram that occurs once repeats no window. A context
   that occurs again repeats all its windows, whoever holds it; one of its
   holders stands for all. So inside long copies nothing is left to sort: only
   anchors near an edge of a repeat, and one of each repeated context beside
   them, go on.
2. Of those each block sends one sorted run to each shard of grams: front-coded
   (the length shared with the suffix before, and the rest), with the bytes
   before the anchor. A shard merges its runs with a loser tree that knows, for
   each run, how many bytes its head shares with the last output, and compares
   only beyond.
3. The shared lengths to the right come out of the merge; the contexts to the
   left are ordered within each gram. A window at offset j before an anchor
   repeats where another suffix shares j bytes to the left and the rest to the
   right; the least and the largest such j give the anchor's cut.
4. A gram with over hot different contexts (a passage that very many texts
   share, each with its own surroundings) is not merged in one shard. Its
   windows are compared as 128-bit hashes, dealt over all shards and sent once
   from each block, so the work of one task does not grow with that group.

Contexts and the windows of step 4 count as equal where 128 hash bits are.

Defined results: null text is empty; texts below the length keep everything;
equal rows cut each other whole; other columns pass through, and an input
column named like a result column is replaced. kept_bytes is exact; kept_text
keeps a character where any of its bytes is kept, so it stays valid UTF-8.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from tallybook.llm.blocks import (ASKS, HOT, HOT_ASKS, HOT_STANDS, PAIRS, REPEATED, STANDS, ask, distinct_pairs, judged, judged_states, map_blocks, open_block, pack_blocks, shard_edges, shards_for, texts_of,
                                  total_bytes)
from tallybook.llm.kernels import byte_sums, mix, sums_hash
from tallybook.llm.runtime import durable, without

LENGTH = 400
MADE = ["n_bytes", "n_removed", "n_spans", "kept_bytes", "kept_text"]
U = np.uint64


def gram_of(length: int) -> int:
    return max(1, 2 * length // 5)


def _sliding(a: np.ndarray, span: int, best) -> np.ndarray:
    """best over each run of span values, by doubling."""
    d = 1
    while 2 * d <= span:
        a = best(a[:-d], a[d:])
        d *= 2
    return best(a[: len(a) - (span - d)], a[span - d :]) if span > d else a


def _anchors(sums: np.ndarray, down: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor places in texts of these sizes (one byte apart), and the hashes of their grams and contexts."""
    gram, total = gram_of(length), len(sums) - 1
    span = length - gram + 1
    if total < length:
        return np.empty(0, np.int64), np.empty(0, U), np.empty(0, U)
    grams = mix((sums[gram:] - sums[: total - gram + 1]) * down[: total - gram + 1])
    rank = np.maximum((grams >> U(32)).astype(np.uint32), 1)
    least = _sliding(rank, span, np.minimum)  # for each window start
    inside = np.zeros(len(least), bool)
    begins = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
    for at, n in zip(begins.tolist(), sizes.tolist()):
        if n >= length:
            inside[at : at + n - length + 1] = True
    least[~inside] = 0
    # a gram is an anchor where some window that holds it has it as its least
    edge = np.zeros(span - 1, np.uint32)
    highest = _sliding(np.concatenate((edge, least, edge)), span, np.maximum)
    places = np.flatnonzero((highest == rank) & (highest > 0))
    doc = np.searchsorted(begins, places, side="right") - 1
    lo = np.maximum(begins[doc], places - (length - gram))
    hi = np.minimum(begins[doc] + sizes[doc], places + length)
    sides = (places - lo).astype(U) << U(32) | (hi - places).astype(U)
    context = mix(sums_hash(sums, down, lo, hi) ^ mix(sides + U(1)))
    return places, mix(grams[places]), context  # anchors have small hashes; mixed again, they spread over all shards


class Anchors:
    """Anchors of one length in a block's texts; equal (gram, context) pairs are one entry, ascending."""

    def __init__(self, places: np.ndarray, grams: np.ndarray, contexts: np.ndarray):
        self.grams, self.contexts, self.entry = distinct_pairs(grams, contexts)
        self.many = np.bincount(self.entry, minlength=len(self.grams)) > 1
        self.places = places
        self.first = np.empty(len(self.grams), np.int64)
        self.first[self.entry[::-1]] = places[::-1]


class Anchored:
    """A block's texts, joined by one byte, and their anchors for each length."""

    def __init__(self, texts: list[bytes | None], lengths: tuple[int, ...], step: int = 1 << 18):
        texts = [t or b"" for t in texts]
        sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
        self.texts = texts
        self.edges = edges = np.concatenate(([0], np.cumsum(sizes + 1)))
        found: list[list[tuple]] = [[(np.empty(0, np.int64), np.empty(0, U), np.empty(0, U))] for _ in lengths]
        a = 0
        while a < len(texts):  # some texts at a time, to bound memory
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + step, side="right")) - 1)
            sums, down = byte_sums(np.frombuffer(b" ".join(texts[a:b]), np.uint8))
            for k, length in enumerate(lengths):
                places, *hashes = _anchors(sums, down, sizes[a:b], length)
                found[k].append((places + edges[a], *hashes))
            a = b
        self.of = [Anchors(*(np.concatenate(x) for x in zip(*f))) for f in found]
        self.joined = b" ".join(texts)

    def sides(self, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the contexts at these places begin and end."""
        doc = np.searchsorted(self.edges, places, side="right") - 1
        return np.maximum(self.edges[doc], places - (length - gram_of(length))), np.minimum(self.edges[doc + 1] - 1, places + length)


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which known bytes need no look."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[known:n], "big") ^ int.from_bytes(b[known:n], "big")
    return known + ((n - known) * 8 - x.bit_length()) // 8 if x else n


# ---- runs: sorted suffixes, front-coded -----------------------------------------------------


def pack_run(items: list[tuple[bytes, bytes, bool, int]]) -> bytes:
    """items: (right, reversed left, seen more than once, number), ascending by right, left."""
    common, tails, before = [], [], b""
    for right, *_ in items:
        k = shared(before, right)
        common.append(k)
        tails.append(right[k:])
        before = right
    lefts = [i[1] for i in items]
    sizes = np.array([common, [len(t) for t in tails], [len(x) for x in lefts], [i[2] for i in items], [i[3] for i in items]], "<u4")
    return zstandard.compress(np.uint32(len(items)).tobytes() + sizes.tobytes() + b"".join(tails) + b"".join(lefts), 6)


def open_run(blob: bytes) -> list[tuple[int, bytes, bytes, bool, int]]:
    """(bytes shared with the right before, right, left, more than once, number) for each item."""
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    common, tail, left, more, number = np.frombuffer(raw, "<u4", 5 * n, 4).reshape(5, n).tolist()
    t = 4 + 20 * n
    x = t + sum(tail)
    out, before = [], b""
    for k, a, b, m, i in zip(common, tail, left, more, number):
        before = before[:k] + raw[t : t + a]
        out.append((k, before, raw[x : x + b], bool(m), i))
        t, x = t + a, x + b
    return out


def merge_runs(runs: list[list[tuple]]) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, bytes shared with the right put out before), ascending by right.

    A loser tree over the heads of the runs. known[r] is what the head of run r
    shares with the last output: of two heads the one that shares more is
    smaller, and only equal values need bytes compared, beyond what is known.
    """
    k = len(runs)
    size = 1
    while size < k:
        size *= 2
    heads: list[bytes | None] = [r[0][1] if r else None for r in runs] + [None] * (size - k)
    known, place, tree = [0] * size, [0] * size, [0] * (2 * size)

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = heads[a], heads[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        h = shared(x, y, known[a])
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    winners = list(range(size))
    level = size
    while level > 1:
        level //= 2
        nxt = []
        for i in range(level):
            w, tree[level + i] = play(winners[2 * i], winners[2 * i + 1])
            nxt.append(w)
        winners = nxt
    w = winners[0]
    while heads[w] is not None:
        yield w, place[w], known[w]
        place[w] += 1
        run = runs[w]
        if place[w] < len(run):
            heads[w], known[w] = run[place[w]][1], run[place[w]][0]
        else:
            heads[w] = None
        node = (w + size) // 2
        while node:
            w, tree[node] = play(w, tree[node])
            node //= 2


def reach(rights: list[int], lefts: list[bytes], common: np.ndarray, more: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes ascending by their right side: the largest and the least offset of a repeated window (-1: none).

    rights: lengths; common: bytes shared with the one before; more: stands for several equal ones.
    """
    n, gram_size = len(lefts), gram_of(length)
    back = length - gram_size
    top, low = np.full(n, -1), np.full(n, -1)
    gram = np.cumsum(common < gram_size)
    gids = gram.tolist()
    order = np.array(sorted(range(n), key=lambda i: (gids[i], lefts[i])), np.int64)
    near = np.full(n, -1)  # bytes to the left shared with the one before in this order
    ordered = order.tolist()
    for i in range(1, n):
        a, b = ordered[i - 1], ordered[i]
        near[i] = shared(lefts[a], lefts[b]) if gids[a] == gids[b] else -1
    right_len, left_len = np.array(rights), np.array([len(x) for x in lefts])
    best_right = np.maximum(common, np.append(common[1:], 0))
    best_left = np.empty(n, np.int64)
    best_left[order] = np.maximum(near, np.append(near[1:], -1))
    best_right = np.where(more, right_len, best_right)
    best_left = np.where(more, left_len, best_left)
    most = np.minimum(np.minimum(best_left, left_len), back)
    least = np.maximum(length - best_right, 0)
    open_ = (most >= least) & (best_left >= 0)
    # one that stands for several equal ones repeats every window it holds
    whole = more & (right_len + left_len >= length)
    top[whole], low[whole] = np.minimum(left_len, back)[whole], np.maximum(length - right_len, 0)[whole]

    def search(offsets: range, found: np.ndarray) -> None:
        for j in offsets:
            need = open_ & (found < 0) & (most >= j) & (least <= j)
            if not need.any():
                continue
            wanted = np.zeros(int(gram[-1]) + 1, bool)
            wanted[gram[need]] = True
            fit = np.flatnonzero((most >= j) & (least <= j) & open_ & wanted[gram])
            lid = np.empty(n, np.int64)
            lid[order] = np.cumsum(near < j)
            rid = np.cumsum(common < length - j)
            _, inverse, counts = np.unique(lid[fit] * (n + 1) + rid[fit], return_inverse=True, return_counts=True)
            hit = fit[counts[inverse] > 1]
            found[hit[found[hit] < 0]] = j

    search(range(back, -1, -1), top)
    search(range(back + 1), low)
    return top, low


# ---- the operator ---------------------------------------------------------------------------

SENT = "shard int, block long, kind int, data binary, more binary"
_SENT = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("kind", pa.int32()), ("data", pa.binary()), ("more", pa.binary())])
_MERGED = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("data", pa.binary())])
RUN, WINDOWS = 1, 2
SHARD_ITEMS = 20_000


def suffix_dedup(docs: DataFrame, text_col: str = "text", length: int = LENGTH, also: tuple[int, ...] = (), hot: int = HOT) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans, kept_bytes and kept_text; n_repeated_<n> counts the bytes that a further length n would cut."""
    lengths = (length, *also)
    docs = without(docs, MADE + [f"n_repeated_{n}" for n in also])
    made_fields = [StructField("n_bytes", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept_bytes", BinaryType()), StructField("kept_text", StringType())]
    schema = StructType(docs.schema.fields + made_fields + [StructField(f"n_repeated_{n}", LongType()) for n in also])
    arrow = to_arrow_schema(schema)
    blocks = pack_blocks(docs, text_col)
    shards = shards_for(blocks, 2 * total_bytes(blocks) // max(1, min(lengths) - gram_of(min(lengths))), 1_000_000)

    def anchored(row: dict) -> Anchored:
        return Anchored(texts_of(open_block(row["data"]), text_col), lengths)

    def contexts(row: dict) -> Iterator[pa.RecordBatch]:
        for k, a in enumerate(anchored(row).of):
            yield from ask(row["block"], a.grams, a.contexts, a.many, shards, k * shards)

    known_pairs = durable(judged(map_blocks(blocks, contexts, PAIRS), hot))
    n_sent, n_hot = known_pairs.agg(F.coalesce(F.sum("n_sent"), F.lit(0)), F.coalesce(F.sum("n_hot"), F.lit(0))).first()
    runs_in = shards_for(blocks, n_sent, SHARD_ITEMS)

    def windows(a: Anchors, texts: Anchored, state: np.ndarray, size: int) -> tuple:
        """Starts of the windows at hot anchors, and (key, further, many) of the distinct ones with each start's place among them."""
        hot = np.flatnonzero(state >= HOT_ASKS)
        lo, hi = texts.sides(a.first[hot], size)
        starts = np.concatenate([np.arange(x, y - size + 1) for x, y in zip(lo.tolist(), hi.tolist())] or [np.empty(0, np.int64)])
        twice = np.repeat(state[hot] == HOT_STANDS, hi - lo - size + 1)
        starts, at = np.unique(starts, return_inverse=True)
        twice = np.bincount(at, weights=twice, minlength=len(starts)) > 0
        keys, further = np.empty(len(starts), U), np.empty(len(starts), U)
        cuts = np.searchsorted(starts, texts.edges)
        for d in np.flatnonzero(np.diff(cuts)).tolist():
            part, buf = slice(cuts[d], cuts[d + 1]), np.frombuffer(texts.texts[d], np.uint8)
            begin = starts[part] - texts.edges[d]
            for out, which in ((keys, 1), (further, 2)):
                out[part] = mix(sums_hash(*byte_sums(buf, which), begin, begin + size) + U(0x9E3779B97F4A7C15))
        keys, further, entry = distinct_pairs(keys, further)
        return starts, keys, further, np.bincount(entry, weights=1 + twice, minlength=len(keys)) > 1, entry

    def send(row: dict) -> Iterator[pa.RecordBatch]:
        if not row["answers"]:
            return
        texts = anchored(row)
        mirror, size = texts.joined[::-1], len(texts.joined)
        for k, (n, a) in enumerate(zip(lengths, texts.of)):
            state = judged_states(a.grams, row["answers"], shards, k * shards)
            wanted = np.flatnonzero((state == ASKS) | (state == STANDS))
            at = a.first[wanted]
            lo, hi = texts.sides(at, n)
            shard = np.searchsorted(shard_edges(runs_in), a.grams[wanted], side="right") - 1
            by: dict[int, list] = {}
            for i, p, x, y, s, more in zip(wanted.tolist(), at.tolist(), lo.tolist(), hi.tolist(), shard.tolist(), (state[wanted] == STANDS).tolist()):
                by.setdefault(s, []).append((texts.joined[p:y], mirror[size - p : size - x], more, i))
            for s, items in by.items():
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((k * runs_in + s, row["block"], RUN, pack_run(sorted(items)), None), _SENT.types)], schema=_SENT)
            if (state >= HOT_ASKS).any():
                _, keys, further, many, _ = windows(a, texts, state, n)
                for b in ask(row["block"], keys, further, many, shards, k * shards):
                    yield pa.RecordBatch.from_arrays([b.column("shard"), b.column("block"), pa.array([WINDOWS] * b.num_rows, pa.int32()), b.column("keys"), b.column("more")], schema=_SENT)

    def merge(table: pa.Table) -> pa.Table:
        """For each block's items: the largest and the least offset of a repeated window, by number."""
        n = lengths[table.column("shard")[0].as_py() // runs_in]
        opened = [open_run(b) for b in table.column("data").to_pylist()]
        total = sum(map(len, opened))
        rights, lefts, common, more, origin = [], [], np.zeros(total, np.int64), np.zeros(total, bool), []
        for i, (r, place, known) in enumerate(merge_runs(opened)):
            _, right, left, many, _ = opened[r][place]
            rights.append(len(right))
            lefts.append(left)
            common[i], more[i] = known, many
            origin.append((r, place))
        top, low = reach(rights, lefts, common, more, n)
        outs = [np.full((3, len(o)), -1, "<i4") for o in opened]
        for i, (r, place) in enumerate(origin):
            outs[r][:, place] = opened[r][place][4], top[i], low[i]
        return pa.Table.from_arrays([table.column("shard"), table.column("block"), pa.array([zstandard.compress(o.tobytes(), 3) for o in outs], pa.binary())], schema=_MERGED)

    def cut(row: dict) -> Iterator[pa.RecordBatch]:
        table = open_block(row["data"])
        answers: dict[int, list] = {}
        for x in row["answers"] or ():
            answers.setdefault(x["kind"], []).append(x)
        if answers:
            texts = Anchored(texts_of(table, text_col), lengths)
        else:
            texts = Anchored(texts_of(table, text_col), ())
        gone = []
        for k, n in enumerate(lengths):
            edge = np.zeros(int(texts.edges[-1]) + 1, np.int32)
            if answers:
                a = texts.of[k]
                state = judged_states(a.grams, answers.get(0, []), shards, k * shards)
                lo, hi = texts.sides(a.first, n)
                top, low = np.full(len(state), -1, np.int64), np.full(len(state), -1, np.int64)
                whole = np.isin(state, REPEATED)
                top[whole], low[whole] = (a.first - lo)[whole], (a.first + n - hi)[whole]
                for x in answers.get(RUN, []):
                    if x["shard"] // runs_in == k:
                        number, t, w = np.frombuffer(zstandard.decompress(x["data"]), "<i4").reshape(3, -1).astype(np.int64)
                        top[number], low[number] = np.where(t >= 0, t, top[number]), np.where(t >= 0, w, low[number])
                hit = top[a.entry] >= 0
                places, entry = a.places[hit], a.entry[hit]
                np.add.at(edge, places - top[entry], 1)
                np.add.at(edge, places - low[entry] + n, -1)
                if (state >= HOT_ASKS).any():
                    starts, keys, _, _, at = windows(a, texts, state, n)
                    seen = judged_states(keys, answers.get(WINDOWS, []), shards, k * shards)[at]
                    begins = starts[np.isin(seen, REPEATED)]
                    np.add.at(edge, begins, 1)
                    np.add.at(edge, begins + n, -1)
            gone.append(np.cumsum(edge) > 0)
        made: list[list] = [[] for _ in range(5 + len(also))]
        for d, text in enumerate(texts.texts):
            place = slice(texts.edges[d], texts.edges[d] + len(text))
            mask = gone[0][place]
            n = int(mask.sum())
            kept = whole_text = text
            spans = 0
            if n:
                spans = int(mask[0]) + int((mask[1:] & ~mask[:-1]).sum())
                data = np.frombuffer(text, np.uint8)
                kept = data[~mask].tobytes()
                char = np.cumsum((data & 0xC0) != 0x80) - 1
                stays = np.bincount(char, weights=~mask) > 0
                whole_text = data[stays[char]].tobytes()
            for column, value in zip(made, (len(text), n, spans, kept, whole_text, *(int(g[place].sum()) for g in gone[1:]))):
                column.append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), *[pa.int64()] * len(also))
        arrays = [pa.array(c, t) for c, t in zip(made, types)]
        arrays[4] = arrays[4].cast(pa.string())
        yield from pa.Table.from_arrays([*table.columns, *arrays], names=arrow.names).cast(arrow).to_batches(max_chunksize=256)

    def by_block(parts: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.union, parts).groupBy("block").agg(F.collect_list(F.struct("kind", "shard", "data")).alias("answers"))

    known = known_pairs.select("block", F.lit(0).alias("kind"), "shard", F.col("states").alias("data"))
    parts = [known]
    if n_sent or n_hot:
        asked = known_pairs.filter("n_sent + n_hot > 0").select("block").distinct()
        sent = map_blocks(blocks.join(by_block([known.join(asked, "block", "left_semi")]), "block"), send, SENT)
        if n_hot:
            sent = durable(sent)  # read for the runs and for the windows
        runs = sent.filter(f"kind = {RUN}") if n_hot else sent
        parts.append(runs.groupBy("shard").applyInArrow(merge, "shard int, block long, data binary").select("block", F.lit(RUN).alias("kind"), "shard", "data"))
        if n_hot:
            asked_windows = sent.filter(f"kind = {WINDOWS}").select("shard", "block", F.col("data").alias("keys"), "more")
            parts.append(judged(asked_windows).select("block", F.lit(WINDOWS).alias("kind"), "shard", F.col("states").alias("data")))
    return map_blocks(blocks.join(by_block(parts), "block", "left"), cut, schema)


#: A passage of over 50 words of four letters and a space holds more bytes than this.
PASSAGE = 250


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    done = suffix_dedup(docs, also=(PASSAGE,))
    return done.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept_bytes", 256).alias("kept_sha256"), F.col(f"n_repeated_{PASSAGE}").alias("n_passage_bytes"))
