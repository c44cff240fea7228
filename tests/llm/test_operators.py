"""The language-model operators against brute force, with nulls, empty and long texts, ties and clashing names."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallybook.llm import blocks, op1_masked_lm, op2_quality_rules, op3_suffix_dedup, op4_media_shards, op5_length_buckets, op6_site_quality, op7_packed_ids, op8_ngram_jaccard, op9_piece_codec, op10_substring_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_words string, kept string"


def corpus(seed=3):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(300)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base, passage, boiler = say(150), say(90), say(60)
    texts = [None, "", " \n\t ", "one two three", "ONE two Three", base, base, base.upper(), passage + " " + say(40), say(30) + "\n" + passage, "aaaa" * 700, "aaaa" * 700 + "b", say(6000), say(20)]
    for i in range(40):  # near copies around the threshold, and documents with a common part
        w = base.split()
        for _ in range(i // 4):
            w[r.randrange(len(w))] = r.choice(words)
        texts.append(" ".join(w))
    texts += [boiler + " " + say(12) for _ in range(6)] + [say(50) + " x " * 30]
    rows = [(i, t, r.choice(["en", "de", None]), r.choice(["s0", "s0", "s1", None]), "clash", "clash") for i, t in enumerate(texts)]
    return rows + [(None, base + " tail", "en", "s1", None, None), (None, None, None, None, None, None), rows[6], rows[6]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3)


def _bytes(t):
    return (t or "").encode()


@pytest.mark.parametrize("block_bytes", [2 << 20, 2000])
def test_substring_dedup(docs, monkeypatch, block_bytes):
    monkeypatch.setattr(op10_substring_dedup, "pack_blocks", lambda df, col: blocks.pack_blocks(df, col, block_bytes))
    rows = corpus()
    words = [_bytes(r[1]).split() for r in rows]
    seen = collections.Counter(tuple(w[i : i + 35]) for w in words for i in range(len(w) - 34))
    want = []
    for r, w in zip(rows, words):
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if seen[tuple(w[i : i + 35])] > 1:
                gone[i : i + 35] = [True] * 35
        want.append((r[0], len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    out = op10_substring_dedup.substring_dedup(docs)
    assert out.columns.count("n_words") == 1 and "kept" in out.columns
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in out.collect()]
    assert collections.Counter(got) == collections.Counter(want)


def _repeated_bytes(rows, length):
    seen = collections.Counter(_bytes(r[1])[i : i + length] for r in rows for i in range(len(_bytes(r[1])) - length + 1))
    for r in rows:
        b = _bytes(r[1])
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        yield r[0], b, gone


@pytest.mark.parametrize(("length", "block_bytes", "hot"), [(400, 2 << 20, 4096), (400, 3000, 4096), (150, 3000, 4096), (150, 3000, 2), (400, 3000, 1)])
def test_suffix_dedup(docs, monkeypatch, length, block_bytes, hot):
    monkeypatch.setattr(op3_suffix_dedup, "pack_blocks", lambda df, col: blocks.pack_blocks(df, col, block_bytes))
    rows = corpus()
    further = collections.Counter((i, int(gone.sum())) for i, _, gone in _repeated_bytes(rows, 90))
    want = []
    for i, b, gone in _repeated_bytes(rows, length):
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        want.append((i, len(b), int(gone.sum()), spans, bytes(np.frombuffer(b, np.uint8)[~gone])))
    found = op3_suffix_dedup.suffix_dedup(docs, length=length, also=(90,), hot=hot).collect()
    got = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept_bytes)) for r in found]
    assert collections.Counter(got) == collections.Counter(want)
    assert collections.Counter((r.doc_id, r.n_repeated_90) for r in found) == further


def test_loser_tree_merges_front_coded_runs():
    r = random.Random(5)
    runs = []
    for _ in range(7):
        items = sorted({bytes(r.choices(b"ab", k=r.randint(0, 9))) for _ in range(r.randint(0, 12))})
        runs.append(op3_suffix_dedup.open_run(op3_suffix_dedup.pack_run([(i, b"", False, 0) for i in items])))
    out = list(op3_suffix_dedup.merge_runs(runs))
    merged = [runs[a][b][1] for a, b, _ in out]
    assert merged == sorted(x[1] for run in runs for x in run)
    for (_, _, known), before, now in zip(out[1:], merged, merged[1:]):
        assert known == op3_suffix_dedup.shared(before, now)


def _components(rows):
    sets = []
    for r in rows:
        w = bytes(b + 32 if 65 <= b <= 90 else b for b in _bytes(r[1])).split()
        sets.append(frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else []))
    part = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b) and part[i] != part[j]:
                old, new = part[i], part[j]
                part = [new if p == old else p for p in part]
    ids = collections.defaultdict(list)
    for p, r in zip(part, rows):
        ids[p].append(r[0])
    least = {p: min((x for x in v if x is not None), default=None) for p, v in ids.items()}
    return sets, [least[p] for p in part], part


def test_near_duplicates(docs):
    rows = corpus()
    sets, least, part = _components(rows)
    found = op8_ngram_jaccard.NearDuplicates(docs)
    got = [(r.id, r.n, r.component_id) for r in found.membership().collect()]
    assert collections.Counter(got) == collections.Counter((r[0], len(s), c) for r, s, c in zip(rows, sets, least))
    kept = found.keepers().collect()
    assert len(kept) == len(set(part)) and kept[0].__fields__ == docs.columns


def test_near_duplicates_of_a_large_group(spark):
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(700):
        w = list(base)
        for _ in range(r.randint(0, 3)):
            w[r.randrange(60)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", None, None))
    _, least, _ = _components(rows)
    got = {x.id: x.component_id for x in op8_ngram_jaccard.NearDuplicates(spark.createDataFrame(rows, SCHEMA)).membership().collect()}
    assert got == dict(enumerate(least))


def _links(sets):
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]


@pytest.mark.parametrize("tile, shingles", [(1000, 1_000_000), (3, 1_000_000), (1000, 200)])
def test_all_pairs_and_link_counts(spark, monkeypatch, tile, shingles):
    monkeypatch.setattr(op8_ngram_jaccard, "JOIN_TILE", tile)
    monkeypatch.setattr(op8_ngram_jaccard, "JOIN_SHINGLES", shingles)
    rows = [(f"d{i:03d}" if r[0] is not None else None, r[1], "clash", "clash", "clash") for i, r in enumerate(corpus())]
    found = op8_ngram_jaccard.NearDuplicates(spark.createDataFrame(rows, "name string, text string, cls string, block string, n string").repartition(3), "name")
    links = {r.cls: r.n_links for r in found.links().collect()}
    members = found.membership().collect()
    sets, _, part = _components(rows)
    edges = _links(sets)
    degree = collections.Counter(x for e in edges for x in e)
    assert sorted((m.id or "", m.n, links.get(m.cls, 0)) for m in members) == sorted((r[0] or "", len(s), degree[i]) for i, (r, s) in enumerate(zip(rows, sets)))
    of = {m.id: m.cls for m in members if m.id}
    want = {tuple(sorted((of[rows[i][0]], of[rows[j][0]]))): tuple(sorted((len(sets[i]), len(sets[j])))) + (len(sets[i] & sets[j]),) for i, j in edges if rows[i][0] and rows[j][0] and sets[i] != sets[j]}
    got = {tuple(sorted((p.a, p.b))): tuple(sorted((p.n_a, p.n_b))) + (p.n_both,) for p in found.pairs.collect()}
    named = set(of.values())
    assert found.pairs.count() == len(got) and {k: v for k, v in got.items() if named.issuperset(k)} == want
    least = collections.defaultdict(list)
    for p, r in zip(part, rows):
        least[p].append(r[0] or "~")
    assert sorted((m.id or "~", m.component_id or "~") for m in members) == sorted((r[0] or "~", min(least[p])) for p, r in zip(part, rows))


def test_every_pair_of_a_large_group_is_decided_once(spark, monkeypatch):
    monkeypatch.setattr(op8_ngram_jaccard, "JOIN_TILE", 50)
    r = random.Random(10)
    rows = []
    for i in range(300):
        w = [f"w{k}" for k in range(60 if i % 2 else 75)]
        for _ in range(r.randint(0, 2)):
            w[r.randrange(60)] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(w), "en", "s", None, None))
    sets, _, _ = _components(rows)
    edges = _links(sets)
    found = op8_ngram_jaccard.NearDuplicates(spark.createDataFrame(rows, SCHEMA).repartition(4))
    links = {x.cls: x.n_links for x in found.links().collect()}
    degree = collections.Counter(x for e in edges for x in e)
    assert {m.id: links[m.cls] for m in found.membership().collect()} == {i: degree[i] for i in range(300)}
    assert found.pairs.count() == len({frozenset((frozenset(sets[i]), frozenset(sets[j]))) for i, j in edges if sets[i] != sets[j]})


def test_quality_rules(docs):
    out = {r.doc_id: r for r in op2_quality_rules.quality_rules(docs, min_group=5).collect() if r.doc_id is not None}
    for r in corpus():
        if r[0] is None:
            continue
        t = r[1] or ""
        w = _bytes(t).split()
        grams = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        again = {k for i in range(len(w) - 4) if grams[tuple(w[i : i + 5])] > 1 for k in range(i, i + 5)}
        lines = [x for x in t.split("\n") if x.strip(" \t\n\x0b\f\r")]
        want = (len(w), len("".join(x.decode() for x in w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again))
        x = out[r[0]]
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == want
        assert x.base_failed == (len(w) < 10 or 100 * len(again) > 20 * len(w))
        assert not (x.base_failed and x.kept)


def test_media_round_trip(spark, docs, tmp_path):
    folder = f"file://{tmp_path}/media"
    places = op4_media_shards.one_place(op4_media_shards.store_media(docs, folder))
    read = {bytes(r.digest).hex(): r for r in op4_media_shards.read_payloads(op4_media_shards.read_headers(places, folder), folder).collect()}
    payloads = {op4_media_shards.padded(_bytes(r[1])) for r in corpus()}
    assert len(read) == len(payloads)
    for p in payloads:
        r = read[hashlib.sha256(p).hexdigest()]
        assert (r.payload_bytes, r.payload_sha256, r.tail_crc32, r.height, r.bits) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p) // 64, 8)


def test_best_boundaries_match_exhaustive_search():
    import itertools

    r = random.Random(1)
    for top in [60] * 20 + [100_000] * 20:
        lengths = np.array(sorted(r.sample(range(1, top), 8)))
        counts = np.array([r.randint(1, 9) for _ in lengths])
        cost = lambda b: sum(c * (min(x for x in b if x >= n) - n) for n, c in zip(lengths, counts))
        best = min(cost([*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], 2))
        assert cost(op5_length_buckets.best_boundaries(lengths, counts, 3)) == best


def test_length_buckets(docs):
    out = op5_length_buckets.length_buckets(docs, buckets=4, budget=400).collect()
    assert collections.Counter((r.doc_id, r.n_tokens) for r in out) == collections.Counter((r[0], len(_bytes(r[1]).split())) for r in corpus())
    batches = collections.Counter((r.bucket, r.batch) for r in out)
    for r in out:
        assert r.n_tokens + r.padding == r.bucket_length and r.padding >= 0
        assert batches[(r.bucket, r.batch)] <= max(1, 400 // max(1, r.bucket_length))
    assert len({(r.bucket, r.batch, r.place) for r in out}) == len(out)


def test_site_quality_on_held_out_labels(spark):
    r = random.Random(2)
    rows, labels = [], []
    for i in range(600):
        good = r.random() < 0.7
        text = " ".join("".join(r.choice("abcdefg") for _ in range(r.randint(2, 7))) for _ in range(60))
        rows.append((i, text if good else " ".join(x.upper() + "!!" for x in text.split()), "en", f"s{i % 7}", None, None))
        labels.append((i, int(good)))
    table = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([x for x in labels if x[0] % 2], "doc_id long, quality int")
    got = {x.doc_id: x.kept for x in op6_site_quality.site_quality(table, known).collect()}
    held = [got[i] == bool(y) for i, y in labels if i % 2 == 0]
    assert sum(held) / len(held) > 0.95
    assert op6_site_quality.site_quality(spark.createDataFrame(corpus(), SCHEMA), known.limit(0)).filter("kept").count() == len(corpus())


def test_packed_ids_lose_nothing(docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=op9_piece_codec.default_model())
    rows = op7_packed_ids.pack_token_ids(docs, row_length=128, group_tokens=3000).collect()
    parts = collections.defaultdict(list)
    for r in rows:
        ids, pos = np.frombuffer(r.ids, "<u4"), np.frombuffer(r.positions, "<u4")
        assert len(ids) == 128 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens
        for d, off, a, b in zip(r.doc_ids, r.doc_offsets, r.cu_seqlens, r.cu_seqlens[1:]):
            assert pos[a:b].tolist() == list(range(b - a))
            parts[d].append((off, ids[a:b].tolist()))
    for r in corpus():
        if r[0] is not None and r[0] != 6:
            assert sum((p for _, p in sorted(parts[r[0]])), []) == sp.encode(r[1] or "", add_bos=True, add_eos=True)


def test_packed_ids_of_texts(spark):
    rows = op7_packed_ids.pack_token_ids(spark.createDataFrame([("a", "one two"), (None, "three"), ("b", None)], "key string, body string"), id_col="key", text_col="body").collect()
    assert sorted((i or "") for r in rows for i in r.doc_ids) == ["", "a", "b"]


def test_network_steps_by_plain_softmax():
    r = np.random.default_rng(3)
    net = op1_masked_lm.Network(r.random(16) + 0.5)
    for rows, most in ((np.array([3, 1, 3, 0]), 4), (np.array([70_000, 1, 70_000]), 70_001)):
        used, sums = op1_masked_lm.sums_by(rows, np.ones((len(rows), 2), np.float32), most)
        assert used.tolist() == sorted(set(rows.tolist())) and sums[:, 0].tolist() == [(rows == u).sum() for u in used]
    far = np.array([[0, 1], [-300, -301]], np.float32)  # a row far below the other's largest
    out, sums = op1_masked_lm.weights(far)
    assert np.allclose(out / sums[:, None], [[1 / (1 + np.e), np.e / (1 + np.e)], [np.e / (1 + np.e), 1 / (1 + np.e)]], atol=1e-6)
    ids, around = r.integers(0, 16, 50), r.integers(0, 16, (4, 50))
    h = net.hidden(around)
    a = np.exp(h @ net.p["cls"].T + net.p["cls_bias"])
    b = np.exp(np.einsum("nw,nkw->nk", h, net.p["word"][ids % 4]) + net.p["word_bias"][ids % 4])
    at = np.arange(50)
    want = np.log(a[at, ids % 4] / a.sum(1)) + np.log(b[at, ids // 4] / b.sum(1))
    assert np.allclose(net.run(ids, around), want, atol=1e-5)
    before = net.run(ids, around).mean()
    for _ in range(20):
        net.run(ids, around, 0.05)
    assert net.run(ids, around).mean() > before


def test_network_holds_a_tile_of_a_step(monkeypatch):
    r = np.random.default_rng(4)
    monkeypatch.setattr(op1_masked_lm, "TILE", 64)
    rows, weights = [], op1_masked_lm.weights
    monkeypatch.setattr(op1_masked_lm, "weights", lambda logits: rows.append(len(logits)) or weights(logits))
    ids, around = r.integers(0, 256, 1000), r.integers(0, 256, (4, 1000))
    tiled, one = (op1_masked_lm.Network(r.random(256) + 0.5) for _ in range(2))
    one.load(tiled.flat())
    tiled.run(ids, around, 0.05)
    assert max(rows) <= 128 and sum(rows) == 2 * len(ids)
    monkeypatch.setattr(op1_masked_lm, "TILE", 1000)
    one.run(ids, around, 0.05)
    assert np.allclose(tiled.flat(), one.flat(), atol=1e-5)


def test_contexts_end_with_their_text():
    words = op1_masked_lm.Words([b"a b c", None, b"d", b"e f"])
    got = op1_masked_lm.contexts(words, np.arange(1, 7, dtype=np.int32))
    assert got.tolist() == [[0, 0, 1, 0, 0, 0], [0, 1, 2, 0, 0, 5], [2, 3, 0, 0, 6, 0], [3, 0, 0, 0, 0, 0]]
    assert op1_masked_lm.contexts(op1_masked_lm.Words([b"a"]), np.ones(1, np.int32)).tolist() == [[0]] * 4


def test_packing_remembers_a_bounded_number_of_chunks_and_shuffles_nothing(spark, docs, monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=op9_piece_codec.default_model())
    texts = ["one two three", "two  three", None, " one", "four one ▁ five"] * 3
    batch = pa.RecordBatch.from_pydict({"doc": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    monkeypatch.setattr(op7_packed_ids, "KNOWN", 1)
    for _, coded in op7_packed_ids.coded_texts(iter([batch, batch]), None):
        assert [np.frombuffer(c, "<u4").tolist() for c in coded] == [sp.encode(t or "", add_bos=True, add_eos=True) for t in texts]
    assert "hashpartitioning" not in op7_packed_ids.pack_token_ids(docs)._jdf.queryExecution().executedPlan().toString()


def test_best_fit_takes_the_fullest_row():
    rows = op7_packed_ids.best_fit(np.array([6, 3, 5, 4, 2]), 10)
    assert [[int(i) for i in r] for r in rows] == [[0, 3], [2, 1, 4]]


@pytest.mark.parametrize("block_bytes", [2 << 20, 2000])
def test_piece_codec(docs, monkeypatch, block_bytes):
    monkeypatch.setattr(op9_piece_codec, "GROUP_BLOCKS", 8)  # several groups of blocks
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=op9_piece_codec.default_model())
    tool = op9_piece_codec.codec(None)
    odd = ["", " ", "  a", "a  ", " a b", "x ▁ y", "a\nb\t c", "日本 語 🙂", "a" * 500, "a" * 199 + " b"]
    split = [tool.chunks(t.encode()) for t in odd]
    chunks = op9_piece_codec.distinct(split)
    for t, found in zip(odd, tool.encode([t.encode() for t in odd], split, dict(zip(chunks, tool.segment(chunks))))):
        assert np.frombuffer(found, "<u4").tolist() == sp.encode(t, add_bos=True, add_eos=True)
    more = docs.sparkSession.createDataFrame([(1000 + i, t, None, None, None, None) for i, t in enumerate(odd)], SCHEMA)
    for r in op9_piece_codec.encode_pieces(docs.union(more), block_bytes=block_bytes).collect():
        ids = sp.encode(r.text or "", add_bos=True, add_eos=True)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == sp.decode(ids) and r.n_tokens == len(ids)


@pytest.mark.parametrize("tasks", [1, 5])
def test_masked_lm_prefers_the_corpus_order(spark, monkeypatch, tasks):
    monkeypatch.setattr(op1_masked_lm, "FAN", 2)  # five tasks meet in three levels
    r = random.Random(4)
    cycle = [f"w{i}" for i in range(12)]
    text = lambda: " ".join(cycle[(k + s) % 12] for s in [r.randrange(12)] for k in range(200))
    rows = [(i, text(), None, None, None, None) for i in range(60)] + [(100, " ".join(r.choice(cycle) for _ in range(200)), None, None, None, None), (101, None, None, None, None, None)]
    got = {x.doc_id: x for x in op1_masked_lm.masked_lm_scores(spark.createDataFrame(rows, SCHEMA).repartition(tasks)).collect()}
    assert got[101].log_likelihood == 0.0 and got[101].n_tokens == 0
    assert max(got[i].log_likelihood for i in range(60)) < 0
    assert min(got[i].log_likelihood for i in range(60)) > got[100].log_likelihood


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert op1_masked_lm.masked_lm_scores(none).count() == 0
    assert op2_quality_rules.quality_rules(none).count() == 0
    assert op3_suffix_dedup.suffix_dedup(none).count() == 0
    assert op5_length_buckets.length_buckets(none).count() == 0
    assert op6_site_quality.site_quality(none, labels).count() == 0
    assert op7_packed_ids.pack_token_ids(none).count() == 0
    assert op8_ngram_jaccard.NearDuplicates(none).keepers().count() == 0
    assert op9_piece_codec.encode_pieces(none).count() == 0
    assert op10_substring_dedup.substring_dedup(none).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    r = random.Random(8)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7))) for _ in range(500)]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    base = say(120)
    texts = [base, base + " end", base, say(200), say(80) + " " + "shared passage " * 0 + base[:500], "short", None]
    rows = [(i, t, "en", "s0", len(t or "")) for i, t in enumerate(texts)] + [(100 + i, say(60), "en", "s0", 0) for i in range(30)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(100, 1), (101, 1), (3, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert {0, 3, 4} <= got and not {1, 2, 5, 6} & got and {100 + i for i in range(30)} <= got
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert all(stage(spark, docs, str(tmp_path)).columns == docs.columns for _, stage in corpus_pipeline.STAGES[:-1])
