"""LM scoring by masked pseudo-likelihood.

A small network predicts every token from two tokens on either side:
h = tanh(E1[t-2] + E2[t-1] + E3[t+1] + E4[t+2]), then the token's class and the
token within its class, each by softmax. A document's score is the sum of the
conditional log probabilities of all its tokens.

All steps cover the whole corpus. Every word is counted in Spark: each block of
texts sends its distinct words and counts to shards of hashes, a shard adds them
and sends the corpus's counts back. Words counted often enough get ids of their
own; that number, and with it the number of classes, grows as the square root
of the corpus. The others share hashed ids, and the share of the word among all
tokens of its id comes from the joined counts, so each word has a conditional
probability of its own: P(id | context) * n(word) / n(id). Each task trains the
network in numpy on all its tokens; the tasks' parameters are averaged, weighted
by tokens, in a tree of grouped aggregations, and broadcast for scoring. So the
scores depend, a little, on how the texts are dealt to tasks.

Defined results: null or empty text has no tokens and score 0; equal texts (up to rounding)
have equal scores; other columns pass through, and an input column named like
a result column is replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from tallybook.llm.blocks import by_shard, keys_from_bytes, keys_to_bytes, map_blocks, open_block, pack_blocks, shards_for, texts_of, total_bytes
from tallybook.llm.kernels import Words
from tallybook.llm.runtime import durable, small_batches, without

LEAST_CLASSES = 64
KNOWN_FROM = 0.15  # words counted this many times the root of the number of tokens have ids of their own
OOV = 64  # ids 1 to 63 are shared by rare words, 0 is the edge of a text
WIDTH = 16
STEP = 8192
TILE = 1024  # rows of a step whose exponentials are held at a time
FAN = 32
REACH = (-2, -1, 1, 2)
MADE = ["n_tokens", "log_likelihood"]
TEXT_BYTES = 1 << 20


def _chunks(batches: Iterator[pa.RecordBatch], text_col: str) -> Iterator[tuple[pa.RecordBatch, Words]]:
    for batch in batches:
        texts = batch.column(text_col).cast(pa.binary()).to_pylist()
        at = 0
        while at < len(texts):
            end, size = at, 0
            while end < len(texts) and (end == at or size + len(texts[end] or b"") <= TEXT_BYTES):
                size += len(texts[end] or b"")
                end += 1
            yield batch.slice(at, end - at), Words(texts[at:end])
            at = end


def count_words(blocks: DataFrame, text_col: str, shards: int) -> DataFrame:
    """(shard, block, keys, counts): the corpus's count of each distinct word of a block, by ascending hash; with a null block, of each word of the shard."""

    def own(row: dict) -> Iterator[pa.RecordBatch]:
        keys, counts = np.unique(Words(texts_of(open_block(row["data"]), text_col)).hashes, return_counts=True)
        _, cuts = by_shard(keys, shards)
        rows = [(int(s), row["block"], keys_to_bytes(keys[cuts[s] : cuts[s + 1]]), _pack_counts(counts[cuts[s] : cuts[s + 1]])) for s in np.flatnonzero(np.diff(cuts))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _COUNTS.types)], schema=_COUNTS)

    def add(table: pa.Table) -> pa.Table:
        parts = [keys_from_bytes(b) for b in table.column("keys").to_pylist()]
        keys, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        total = np.bincount(inverse, np.concatenate([_open_counts(b) for b in table.column("counts").to_pylist()])).astype(np.int64)
        back = [_pack_counts(c) for c in np.split(total[inverse], np.cumsum([len(p) for p in parts])[:-1])]
        shard = table.column("shard").to_pylist()
        whole = [shard[0]], [None], [keys_to_bytes(keys)], [_pack_counts(total)]
        rows = [a + b for a, b in zip((shard, table.column("block").to_pylist(), [None] * len(back), back), whole)]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(rows, _COUNTS.types)], schema=_COUNTS)

    return durable(map_blocks(blocks, own, COUNTS).groupBy("shard").applyInArrow(add, COUNTS))


def _pack_counts(counts: np.ndarray) -> bytes:
    wide = int(counts.max(initial=0) >= 1 << 32)
    return zstandard.compress(counts.astype("<u8" if wide else "<u4").tobytes() + bytes([wide]), 1)


def _open_counts(blob: bytes) -> np.ndarray:
    raw = zstandard.decompress(blob)
    return np.frombuffer(raw[:-1], "<u8" if raw[-1] else "<u4").astype(np.int64)


def _cells(counts: np.ndarray) -> np.ndarray:
    """Ascending numbers of the counts' cells, eight to each power of two."""
    return (8 * np.log2(np.maximum(counts, 1))).astype(np.int64)


CELLS = 8 * 64
COUNTS = "shard int, block long, keys binary, counts binary"
_COUNTS = pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())])


def shared_ids(hashes: np.ndarray) -> np.ndarray:
    return (1 + hashes % np.uint64(OOV - 1)).astype(np.int32)


class Vocabulary:
    """Ids of words by hash: those counted often by rank, dealt over the classes; the others hashed to shared ids, with the tokens of each."""

    def __init__(self, counted: DataFrame):
        whole = counted.filter("block is null").select("keys", "counts")

        def sums(row: dict) -> Iterator[pa.RecordBatch]:
            n = _open_counts(row["counts"])
            shared = np.bincount(shared_ids(keys_from_bytes(row["keys"])), n, OOV).astype("<i8")
            yield pa.RecordBatch.from_pydict({"tokens": [shared.tobytes()], "words": [np.bincount(_cells(n), minlength=CELLS).astype("<i8").tobytes()]})

        self.shared, words = np.zeros(OOV, np.int64), np.zeros(CELLS, np.int64)
        for r in map_blocks(whole, sums, "tokens binary, words binary").toLocalIterator():
            self.shared += np.frombuffer(r.tokens, "<i8")
            words += np.frombuffer(r.words, "<i8")
        fewest, least = LEAST_CLASSES * LEAST_CLASSES - OOV, max(1, int(KNOWN_FROM * self.shared.sum() ** 0.5))
        enough = np.flatnonzero(np.cumsum(words[::-1])[::-1] >= fewest)
        cell = int(enough[-1]) if len(enough) else 0  # the words of this cell and above are enough

        def frequent(row: dict) -> Iterator[pa.RecordBatch]:
            keys, n = keys_from_bytes(row["keys"]), _open_counts(row["counts"])
            order = np.lexsort((keys.view(np.int64), -n))
            some = min(fewest, int((_cells(n) >= cell).sum()))
            order = order[: max(some, int((n >= least).sum()))]
            yield pa.RecordBatch.from_pydict({"word": keys[order].view(np.int64), "n": n[order]})

        rows = map_blocks(whole, frequent, "word long, n long")
        often = rows.filter(F.col("n") >= least).collect()
        rows = sorted(often if len(often) >= fewest else rows.orderBy(F.desc("n"), "word").limit(fewest).collect(), key=lambda r: (-r.n, r.word))
        self.classes = max(LEAST_CLASSES, math.isqrt(len(rows) + OOV - 1) + 1)
        hashes = np.array([r.word for r in rows], np.int64).view(np.uint64)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], (order + OOV).astype(np.int32)
        known = np.array([r.n for r in rows], np.int64)
        np.subtract.at(self.shared, shared_ids(hashes), known)
        self.frequency = np.full(self.classes * self.classes, 0.5)
        self.frequency[:OOV] += self.shared
        self.frequency[OOV : OOV + len(known)] += known

    def of(self, hashes: np.ndarray) -> np.ndarray:
        shared = shared_ids(hashes)
        if not len(self.keys):
            return shared
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.ids[at], shared)

    def log_shares(self, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Log of the share that words of these ids and counts have in their ids' tokens."""
        out = np.zeros(len(ids))
        rare = ids < OOV
        out[rare] = np.log(counts[rare] / self.shared[ids[rare]])
        return out


def grouped(keys: np.ndarray, most: int) -> np.ndarray:
    """A stable order of keys from 0 to most; those of two bytes are sorted by their digits."""
    return np.argsort(keys.astype(np.uint16) if most <= 1 << 16 else keys, kind="stable")


def weights(logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's exponentials and their sum, all less the row's largest where some row's sum would be very small or large."""
    one = np.ones(logits.shape[1], np.float32)
    with np.errstate(over="ignore"):
        out = np.exp(logits)
        sums = out @ one
    if not 1e-15 <= sums.min() <= sums.max() <= 1e15:
        out = logits - logits.max(1, keepdims=True)
        sums = np.exp(out, out=out) @ one
    return out, sums


def sums_by(keys: np.ndarray, rows: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys, ascending, and the sum of each one's rows; two columns are added as one complex number."""
    order = grouped(keys, most)
    sorted_keys = keys.take(order)
    first = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1]))
    return sorted_keys.take(first), np.add.reduceat(rows.take(order, 0).view(np.complex64), first).view(np.float32)


class Network:
    """Parameters and passes of the window network; an id's class is id mod the number of classes."""

    def __init__(self, frequency: np.ndarray):
        self.classes = k = math.isqrt(len(frequency))
        self.shapes = {"embed": (len(REACH), k * k, WIDTH), "cls": (k, WIDTH), "cls_bias": (k,), "word": (k, k, WIDTH), "word_bias": (k, k)}
        rng = np.random.default_rng(1)
        drawn = {n: (rng.standard_normal(s) * 0.1).astype(np.float32) for n, s in self.shapes.items()}
        table = frequency.reshape(k, k).T  # [class, place]
        drawn["cls_bias"] = np.log(table.sum(1) / table.sum()).astype(np.float32)
        drawn["word_bias"] = np.log(table / table.sum(1, keepdims=True)).astype(np.float32)
        # a bias is the last weight of its row, for an input of one
        self.rows = {"cls": np.empty((k, WIDTH + 1), np.float32), "word": np.empty((k, k, WIDTH + 1), np.float32)}
        self.p = {"embed": drawn["embed"]}
        for n, held in self.rows.items():
            self.p[n], self.p[f"{n}_bias"] = held[..., :WIDTH], held[..., WIDTH]
            self.p[n][...], self.p[f"{n}_bias"][...] = drawn[n], drawn[f"{n}_bias"]
        self.seen = {n: np.full_like(held, 1e-3) for n, held in [("embed", self.p["embed"]), *self.rows.items()]}

    def flat(self) -> np.ndarray:
        return np.concatenate([self.p[n].ravel() for n in self.shapes])

    def load(self, flat: np.ndarray) -> "Network":
        at = 0
        for n, s in self.shapes.items():
            size = int(np.prod(s))
            self.p[n][...] = flat[at : at + size].reshape(s)
            at += size
        return self

    def hidden(self, context: np.ndarray) -> np.ndarray:
        h = self.p["embed"][0].take(context[0], 0)
        for table, at in zip(self.p["embed"][1:], context[1:]):
            h += table.take(at, 0)
        return np.tanh(h, out=h)

    def run(self, ids: np.ndarray, context: np.ndarray, rate: float = 0.0) -> np.ndarray | None:
        """Log probability of each id given its context; with a rate, one Adagrad step instead.

        The ids are taken class by class, in tiles of whole classes that fit a core's cache."""
        n, classes = len(ids), self.classes
        cls = ids % classes
        order = grouped(cls, classes)
        cls, place, context = cls.take(order), (ids // classes).take(order), context.take(order, 1)
        cuts = np.searchsorted(cls, np.arange(classes + 1)).tolist()
        x = np.ones((n, WIDTH + 1), np.float32)
        x[:, :WIDTH] = h = self.hidden(context)
        sorted_out, grad_h = np.empty(n, np.float32), np.empty((n, WIDTH), np.float32)
        grads = {m: np.zeros_like(held) for m, held in self.rows.items()} if rate else {}
        for tile in _tiles([(k, lo, hi) for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])) if hi > lo]):
            own = slice(tile[0][1], tile[-1][2])
            size = own.stop - own.start
            b = np.empty((size, classes), np.float32)
            for k, lo, hi in tile:
                np.matmul(x[lo:hi], self.rows["word"][k].T, out=b[lo - own.start : hi - own.start])
            (a, in_a), (b, in_b) = weights(x[own] @ self.rows["cls"].T), weights(b)
            firsts = np.arange(0, size * classes, classes)
            at_a, at_b = firsts + cls[own], firsts + place[own]
            of_a, of_b = a.ravel().take(at_a), b.ravel().take(at_b)
            if not rate:
                sorted_out[own] = np.log(np.maximum(of_a / in_a, 1e-12)) + np.log(np.maximum(of_b / in_b, 1e-12))
                continue
            # gradients of the logits, but for what divides a row: it is put on the narrow side of each product
            a.ravel()[at_a] = of_a - in_a
            b.ravel()[at_b] = of_b - in_b
            by_a, by_b = (1 / (n * in_a))[:, None], (1 / (n * in_b))[:, None]
            grads["cls"] += a.T @ (x[own] * by_a)
            scaled, back = x[own] * by_b, grad_h[own]
            for k, lo, hi in tile:
                part = b[lo - own.start : hi - own.start]
                np.matmul(part, self.p["word"][k], out=grad_h[lo:hi])
                np.matmul(part.T, scaled[lo - own.start : hi - own.start], out=grads["word"][k])
            back *= by_b
            back += (a @ self.p["cls"]) * by_a
        if rate:
            self._learn(context, h, grad_h, grads, rate)
            return None
        out = np.empty(n, np.float32)
        out[order] = sorted_out
        return out

    def _learn(self, context: np.ndarray, h: np.ndarray, grad_h: np.ndarray, grads: dict[str, np.ndarray], rate: float) -> None:
        """One Adagrad step."""
        for m, grad in grads.items():
            self.seen[m] += grad * grad
            self.rows[m] -= rate * grad / np.sqrt(self.seen[m])
        grad_h *= 1 - h * h
        row = np.dtype((np.void, grad_h.strides[0]))  # rows are written as one item each
        for slot in range(len(REACH)):
            used, grad = sums_by(context[slot], grad_h, self.classes**2)
            e, s = self.p["embed"][slot], self.seen["embed"][slot]
            much = s.take(used, 0)
            much += grad * grad
            s.view(row)[used] = much.view(row)
            grad *= rate
            grad /= np.sqrt(much, out=much)
            e.view(row)[used] = np.subtract(e.take(used, 0), grad, out=grad).view(row)


def _tiles(spans: list[tuple[int, int, int]]) -> Iterator[list[tuple[int, int, int]]]:
    """The spans in runs of about TILE rows."""
    tile: list[tuple[int, int, int]] = []
    for span in spans:
        if tile and span[2] - tile[0][1] > TILE:
            yield tile
            tile = []
        tile.append(span)
    if tile:
        yield tile


def contexts(words: Words, ids: np.ndarray) -> np.ndarray:
    """For each token the ids around it; 0 beyond its text."""
    n = len(ids)
    doc = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    out = np.zeros((len(REACH), n), np.int32)
    for slot, off in enumerate(REACH):
        lag = min(abs(off), n)
        same = doc[lag:] == doc[: n - lag]
        if off < 0:
            out[slot, lag:] = ids[: n - lag] * same
        else:
            out[slot, : n - lag] = ids[lag:] * same
    return out


def train(blocks: DataFrame, vocabulary: Vocabulary, text_col: str, rate: float = 0.05) -> np.ndarray:
    """Parameters averaged over the tasks, each of which has trained on all its tokens, by a tree of FAN branches as deep as needed."""
    box = blocks.sparkSession.sparkContext.broadcast(vocabulary)
    slices = max(8, -(-len(Network(vocabulary.frequency).flat()) // (1 << 16)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, tokens = Network(box.value.frequency), 0
        texts = (open_block(blob.as_py()) for batch in batches for blob in batch.column(0))
        for _, words in _chunks((b for table in texts for b in table.to_batches()), text_col):
            ids = box.value.of(words.hashes)
            around = contexts(words, ids)
            for at in range(0, len(ids), STEP):
                net.run(ids[at : at + STEP], around[:, at : at + STEP], rate)
            tokens += len(ids)
        if tokens:
            parts = np.array_split(net.flat().astype(np.float64) * tokens, slices)
            part = TaskContext.get().partitionId()
            yield pa.RecordBatch.from_pydict({"slice": list(range(slices)), "part": [part] * slices, "n": [tokens] * slices, "sums": [p.astype("<f8").tobytes() for p in parts]}, schema=_PARTS)

    def add(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        total = None
        for chunk in table.column("sums"):
            v = np.frombuffer(chunk.as_buffer(), "<f8")
            total = v.copy() if total is None else total + v
        return pa.Table.from_pydict({"slice": [table.column("slice")[0].as_py()], "part": [table.column("part")[0].as_py()], "n": [sum(table.column("n").to_pylist())], "sums": [total.tobytes()]}, schema=_PARTS)

    level, tasks = blocks.select("data").mapInArrow(run, PARTS), blocks.rdd.getNumPartitions()
    while tasks > FAN:
        level = level.withColumn("part", F.floor(F.col("part") / FAN)).groupBy("slice", "part").applyInArrow(add, PARTS)
        tasks = -(-tasks // FAN)
    rows = level.groupBy("slice").applyInArrow(add, PARTS).collect()
    if not rows:
        return Network(vocabulary.frequency).flat()
    return np.concatenate([np.frombuffer(r.sums, "<f8") / r.n for r in sorted(rows, key=lambda r: r.slice)])


PARTS = "slice int, part long, n long, sums binary"
_PARTS = pa.schema([("slice", pa.int32()), ("part", pa.int64()), ("n", pa.int64()), ("sums", pa.binary())])


def masked_lm_scores(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with n_tokens and log_likelihood (sum over all tokens, rounded to 4 places)."""
    docs = without(docs, MADE)
    small_batches(docs.sparkSession)
    blocks = pack_blocks(docs, text_col)
    counted = count_words(blocks, text_col, shards_for(blocks, total_bytes(blocks) // 16))
    vocabulary = Vocabulary(counted)
    flat = train(blocks, vocabulary, text_col).astype(np.float32)
    box = docs.sparkSession.sparkContext.broadcast((vocabulary, flat))
    schema = StructType(docs.schema.fields + [StructField("n_tokens", LongType()), StructField("log_likelihood", DoubleType())])
    arrow = to_arrow_schema(schema)
    loaded: list[Network] = []

    def score(row: dict) -> Iterator[pa.RecordBatch]:
        vocab, params = box.value
        if not loaded:
            loaded.append(Network(vocab.frequency).load(params))
        net, table = loaded[0], open_block(row["data"])
        words = Words(texts_of(table, text_col))
        keys, inverse = np.unique(words.hashes, return_inverse=True)
        counts = np.concatenate([np.empty(0, np.int64), *[_open_counts(a["counts"]) for a in sorted(row["counts"] or (), key=lambda a: a["shard"])]])
        key_ids = vocab.of(keys)
        ids, shares = key_ids[inverse], vocab.log_shares(key_ids, counts)[inverse]
        around = contexts(words, ids)
        logs = [net.run(ids[at : at + STEP], around[:, at : at + STEP]) for at in range(0, len(ids), STEP)]
        sums = np.concatenate(([0.0], np.cumsum(np.concatenate(logs).astype(np.float64) + shares))) if logs else np.zeros(1)
        scores = np.round(sums[words.first[1:]] - sums[words.first[:-1]], 4)
        made = [pa.array(words.counts(), pa.int64()), pa.array(scores, pa.float64())]
        yield from pa.Table.from_arrays([*table.columns, *made], names=arrow.names).cast(arrow).to_batches(max_chunksize=256)

    known = counted.filter("block is not null").groupBy("block").agg(F.collect_list(F.struct("shard", "counts")).alias("counts"))
    return map_blocks(blocks.join(known, "block", "left"), score, schema)


def op1_masked_lm(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = masked_lm_scores(docs)
    mean = F.round(F.col("log_likelihood") / F.greatest(F.col("n_tokens"), F.lit(1)), 6)
    return scored.select("doc_id", "n_tokens", "log_likelihood", mean.alias("mean_log_likelihood"))
