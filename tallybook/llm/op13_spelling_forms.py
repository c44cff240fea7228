"""Spelling variants: words one edit apart, found by probing generated edits in Bloom filters.

1. Words are counted by a grouped aggregation; the vocabulary is a table.
2. The vocabulary is written into blocked Bloom filters, one for each word
   length (lengths from LONG on share one), in pieces of at most PIECE words.
   Filters are broadcast in passes of at most PASS_BYTES, whatever the size of
   the vocabulary; a pass goes through the words whose edits can be in it.
3. Of each word all deletions and all replacements by a greater letter are
   generated as hashes, many words at once, and probed. That finds each near
   pair from one of its sides: an insertion is another word's deletion.
4. Only edits that a filter holds are spelled out and shuffled to a join with
   the vocabulary, which removes what the filters took for words wrongly.
5. A form has ten times its word's count or more, so chains are short; roots
   follow them by doubling.

Defined results: null or empty text has no words; a null id stands as empty text
in what is hashed; repeated rows are counted each; runs longer than any word are
words like others; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.kernels import mix
from tallybook.llm.runtime import durable, small_batches

#: Fixed values of the contract.
LEAST_LENGTH, LEAST_COUNT, EVERY, TIMES = 7, 2, 31, 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LETTERS = np.array([ord(c) for c in LOWER] + list(range(0xC0, 0x100)), np.uint64)
RUN = f"[A-Za-zÀ-ÿ]{{{LEAST_LENGTH},}}"

LONG = 64
PIECE = 1 << 20
PASS_BYTES = 32 << 20
BLOCK_BITS, WORD_BITS, PROBES = 512, 16, 6
AT_ONCE = 20_000
U = np.uint64
BASE = U(0x9E3779B97F4A7C15)


def counted_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the vocabulary."""
    run = F.explode(F.regexp_extract_all(F.col(text_col), F.lit(RUN), F.lit(0)))
    said = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), run.alias("run")).select("id", F.translate("run", UPPER, LOWER).alias("run"))
    h = said.withColumn("h", F.crc32(F.concat_ws(":", "id", "run")))
    at = F.pmod(F.col("h"), F.char_length("run")).cast("int")
    word = F.when(F.col("h") % EVERY == 0, F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))).otherwise(F.col("run"))
    words = h.withColumn("at", at).select(word.alias("word")).filter(F.char_length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)


def powers(n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([U(1)], np.full(n, BASE))), dtype=U)


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length the places of its words and the matrix of their letters."""
    lengths = np.array([len(w) for w in words], np.int64)
    for n in np.unique(lengths).tolist():
        at = np.flatnonzero(lengths == n)
        letters = np.frombuffer("".join(words[i] for i in at.tolist()).encode("utf-32-le"), "<u4").reshape(len(at), n)
        yield at, letters.astype(U)


def word_hash(letters: np.ndarray) -> np.ndarray:
    return (letters * powers(letters.shape[1])[: letters.shape[1]]).sum(1, dtype=U)


def shard_of(length: int) -> int:
    return min(length, LONG)


def piece_of(hashes: np.ndarray, pieces: int) -> np.ndarray:
    return (mix(hashes) >> U(40)) % U(pieces)


def bits_of(hashes: np.ndarray, blocks: int) -> Iterator[np.ndarray]:
    """The bits that stand for each hash, all within one block."""
    block = (mix(hashes + U(1)) % U(blocks)) * U(BLOCK_BITS)
    spread = mix(hashes + U(2))
    for k in range(PROBES):
        yield block + ((spread >> U(9 * k)) & U(BLOCK_BITS - 1))


def built(hashes: np.ndarray) -> bytes:
    """A blocked Bloom filter of these hashes."""
    blocks = max(1, -(-len(hashes) * WORD_BITS // BLOCK_BITS))
    bits = np.zeros(blocks * BLOCK_BITS // 8, np.uint8)
    for at in bits_of(hashes, blocks):
        np.bitwise_or.at(bits, (at >> U(3)).astype(np.int64), (U(1) << (at & U(7))).astype(np.uint8))
    return bits.tobytes()


def held(hashes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Places of the hashes that the filter holds; each probe looks at what is left."""
    left = np.arange(len(hashes))
    blocks = len(bits) * 8 // BLOCK_BITS
    block = (mix(hashes + U(1)) % U(blocks)) * U(BLOCK_BITS)
    spread = mix(hashes + U(2))
    for k in range(PROBES):
        at = block[left] + ((spread[left] >> U(9 * k)) & U(BLOCK_BITS - 1))
        left = left[(bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 == 1]
    return left


def filters_of(vocabulary: DataFrame, pieces: dict[int, int]) -> DataFrame:
    """(shard, piece, bits): the filters as a table."""
    hashed = pa.schema([("shard", pa.int32()), ("piece", pa.int64()), ("hashes", pa.binary())])
    out = pa.schema([("shard", pa.int32()), ("piece", pa.int64()), ("bits", pa.binary())])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for _, letters in by_length(batch.column(0).to_pylist()):
                shard, h = shard_of(letters.shape[1]), word_hash(letters)
                piece = piece_of(h, pieces[shard])
                rows += [(shard, int(p), h[piece == p].tobytes()) for p in np.unique(piece)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), hashed.types)], schema=hashed)

    def build(table: pa.Table) -> pa.Table:
        h = np.concatenate([np.frombuffer(b, U) for b in table.column("hashes").to_pylist()])
        return pa.Table.from_pydict({"shard": table.column("shard")[:1], "piece": table.column("piece")[:1], "bits": [built(h)]}, schema=out)

    small_batches(vocabulary.sparkSession, 8192)
    sent = vocabulary.select("word").mapInArrow(hashes, "shard int, piece long, hashes binary")
    return durable(sent.groupBy("shard", "piece").applyInArrow(build, "shard int, piece long, bits binary"))


class Probe:
    """The edits of words that the filters of one pass hold."""

    def __init__(self, filters: dict[tuple[int, int], np.ndarray], pieces: dict[int, int]):
        self.filters, self.pieces, self.shards = filters, pieces, {s for s, _ in filters}

    def _held(self, hashes: np.ndarray, length: int) -> np.ndarray:
        shard = shard_of(length)
        if shard not in self.shards:
            return np.empty(0, np.int64)
        piece, found = piece_of(hashes, self.pieces[shard]), []
        for (s, p), bits in self.filters.items():
            if s == shard:
                at = np.flatnonzero(piece == p) if self.pieces[shard] > 1 else np.arange(len(hashes))
                found.append(at[held(hashes[at], bits)])
        return np.concatenate(found)

    def edits(self, words: list[str]) -> Iterator[tuple[int, str]]:
        """(place of a word, an edit of it that a filter holds)."""
        for at, letters in by_length(words):
            n, length = letters.shape
            up = powers(length)
            whole = word_hash(letters)
            if shard_of(length - 1) in self.shards and length > 1:
                zero = np.zeros((n, 1), U)
                before = np.concatenate((zero, np.cumsum(letters * up[:length], axis=1, dtype=U)), axis=1)[:, :length]
                shifted = np.cumsum(letters[:, :0:-1] * up[: length - 1][::-1], axis=1, dtype=U)[:, ::-1]
                after = np.concatenate((shifted, zero), axis=1)
                fresh = np.concatenate((np.ones((n, 1), bool), letters[:, 1:] != letters[:, :-1]), axis=1)
                row, cut = np.nonzero(fresh)
                for k in self._held((before + after)[row, cut], length - 1).tolist():
                    word = words[at[row[k]]]
                    yield int(at[row[k]]), word[: cut[k]] + word[cut[k] + 1 :]
            if shard_of(length) in self.shards:
                for begin in range(0, n * length, AT_ONCE):
                    row, place = np.divmod(np.arange(begin, min(n * length, begin + AT_ONCE)), length)
                    old = letters[row, place]
                    k, new = np.nonzero(LETTERS[None, :] > old[:, None])
                    hashes = whole[row[k]] + (LETTERS[new] - old[k]) * up[place[k]]
                    for x in self._held(hashes, length).tolist():
                        word, i = words[at[row[k[x]]]], place[k[x]]
                        yield int(at[row[k[x]]]), word[:i] + chr(int(LETTERS[new[x]])) + word[i + 1 :]


def passes_of(pieces: dict[int, int], counts: dict[int, int], most: int) -> list[list[tuple[int, int]]]:
    """The filters in order of length, cut into passes of at most so many bytes (or one filter)."""
    out, size = [[]], 0
    for shard in sorted(pieces):
        each = counts[shard] * WORD_BITS // 8 // pieces[shard] + BLOCK_BITS // 8
        for piece in range(pieces[shard]):
            if out[-1] and size + each > most:
                out.append([])
                size = 0
            out[-1].append((shard, piece))
            size += each
    return [p for p in out if p]


def near_words(vocabulary: DataFrame, piece_words: int = PIECE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(word, n, near, near_n): each near pair from both sides; vocabulary (word, n) is kept by the caller."""
    spark = vocabulary.sparkSession
    shard = F.least(F.char_length("word"), F.lit(LONG))
    counts = {r["shard"]: r["count"] for r in vocabulary.groupBy(shard.alias("shard")).count().collect()}  # LONG rows at most
    pieces = {s: -(-c // piece_words) for s, c in counts.items()}
    filters = filters_of(vocabulary, pieces)
    out_schema = pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string())])
    found = []
    for wanted in passes_of(pieces, counts, pass_bytes):
        lo, hi = wanted[0], wanted[-1]
        key = F.struct("shard", "piece")
        within = filters.filter((key >= F.struct(F.lit(lo[0]), F.lit(lo[1]).cast("long"))) & (key <= F.struct(F.lit(hi[0]), F.lit(hi[1]).cast("long"))))
        sent = spark.sparkContext.broadcast({(r["shard"], r["piece"]): bytes(r["bits"]) for r in within.toLocalIterator()})

        def probe(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            probing = Probe({k: np.frombuffer(b, np.uint8) for k, b in sent.value.items()}, pieces)
            for batch in batches:
                words, n = batch.column(0).to_pylist(), batch.column(1)
                edits = list(probing.edits(words))
                at = pa.array([e[0] for e in edits], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), n.take(at), pa.array([e[1] for e in edits], pa.string())], schema=out_schema)

        reach = (shard >= lo[0]) & (shard <= hi[0] + 1)
        small_batches(spark, 2048)
        maybe = vocabulary.filter(reach).repartition(4 * spark.sparkContext.defaultParallelism, "word").mapInArrow(probe, "word string, n long, near string")
        found.append(durable(maybe.join(vocabulary.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "n", "near", "near_n")))
        sent.destroy()
    if not found:
        return spark.createDataFrame([], "word string, n long, near string, near_n long")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs.union(pairs.select(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")))


def spelling_forms(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", piece_words: int = PIECE, pass_bytes: int = PASS_BYTES) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of the vocabulary."""
    vocabulary = durable(counted_words(docs, id_col, text_col))
    near = near_words(vocabulary, piece_words, pass_bytes)
    best = near.groupBy(F.col("word").alias("_word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    large = -F.col("best.less") >= TIMES * F.col("n")
    formed = durable(
        vocabulary.join(best, vocabulary["word"] == best["_word"], "left")
        .select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(large, F.col("best.near")).alias("form"), F.when(large, -F.col("best.less")).alias("form_n"))
    )
    links = durable(formed.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        further = links.select(F.col("word").alias("_at"), F.col("root").alias("_root"))
        links = durable(links.join(further, links["root"] == further["_at"], "left").select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")))
        if links.filter("moved").isEmpty():
            break
        links = links.select("word", "root")
    roots = links.select(F.col("word").alias("_word"), "root")
    return formed.join(roots, formed["word"] == roots["_word"], "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_forms(spark, sf_dir: str) -> DataFrame:
    return spelling_forms(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
