"""Scores, posteriors, buckets, packed ids and stored media, worked out again in plain Python."""

import collections
import hashlib
import math
import struct
import zlib

import numpy as np
import pytest

from tallybook.llm import op1_masked_lm as op1
from tallybook.llm import op4_media_shards, op5_length_buckets, op7_packed_ids, op9_piece_codec
from tallybook.llm import op6_site_quality as op6
from tallybook.llm.kernels import Words
from tests.llm.test_contracts import ROWS, _sha
from tests.llm.test_contracts import folder as folder
from tests.llm.test_operators import _bytes, corpus

DOCS = "doc_id long, text string, lang string, source string"


def test_masked_lm_scores_are_sums_of_conditional_log_probabilities(spark, monkeypatch):
    texts = ["the cat sat on the mat", "the dog sat on the rug and slept", "a", None, "", "cat dog cat dog cat", "the the the zyx"] * 3
    held = {}
    trained = op1.train

    def train(blocks, vocabulary, text_col, *more):
        held["vocabulary"], held["flat"] = vocabulary, trained(blocks, vocabulary, text_col, *more)
        return held["flat"]

    monkeypatch.setattr(op1, "train", train)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(2)
    got = {r.doc_id: r for r in op1.masked_lm_scores(docs).collect()}
    vocabulary = held["vocabulary"]
    net = op1.Network(vocabulary.frequency).load(held["flat"].astype(np.float32))
    p = {n: v.astype(np.float64) for n, v in net.p.items()}
    number = lambda w: int(vocabulary.of(Words([w.encode()]).hashes)[0])
    counts = collections.Counter(w for t in texts for w in (t or "").split())
    of_id = collections.Counter()
    for w, n in counts.items():
        of_id[number(w)] += n
    k = net.classes
    for i, t in enumerate(texts):
        words = (t or "").split()
        ids, total = [number(w) for w in words], 0.0
        for at, (w, x) in enumerate(zip(words, ids)):
            around = [ids[at + off] if 0 <= at + off < len(ids) else 0 for off in op1.REACH]
            h = [math.tanh(sum(p["embed"][s][c][d] for s, c in enumerate(around))) for d in range(op1.WIDTH)]
            dot = lambda row: sum(a * b for a, b in zip(h, row))  # noqa: E731,B023
            a = [dot(p["cls"][c]) + p["cls_bias"][c] for c in range(k)]
            b = [dot(p["word"][x % k][q]) + p["word_bias"][x % k][q] for q in range(k)]
            share = lambda z, j: z[j] - math.log(sum(math.exp(v) for v in z))
            total += share(a, x % k) + share(b, x // k) + math.log(counts[w] / of_id[x])
        assert got[i].n_tokens == len(words) and got[i].log_likelihood == pytest.approx(total, abs=2e-3 * max(1, len(words)))


def _bits(x):
    return len(f"{max(int(x), 0):b}")


def _features(text):
    t = text or ""
    size, w, lines = max(len(t), 1), t.strip(" \t\n\x0b\f\r").split() or [""], t.split("\n")
    share = lambda chars: int(sum(c in chars for c in t) * 1000 / size)
    return {
        "upper": _bits(share(op6.UPPER)), "digits": _bits(share(op6.DIGITS)), "symbols": _bits(share(op6.SYMBOLS)) if any(c in op6.SYMBOLS for c in t) else 1, "bangs": _bits(t.count("!") * 1000 / size),
        "repeats": _bits((len(w) - len(set(w))) * 1000 / len(w)), "word_length": min(40, int(len(t) / len(w))), "dup_lines": _bits((len(lines) - len(set(lines))) * 1000 / len(lines)), "size": _bits(len(w)),
    }


def test_site_posteriors(spark):
    rows = [(i, f"{'WIN BIG ' * (i % 3)}words number {i} and {i * 7} more, {'!' * (i % 5)} end\nline {i % 4}\nline {i % 2}" if i % 11 else None, ["en", "de", None][i % 3], f"s{i % 5}" if i % 7 else None) for i in range(120)]
    truth = [(i, int(i % 3 == 0)) for i in range(0, 120, 2)]
    feats = {i: _features(t) for i, t, *_ in rows}
    good, bad = sum(y for _, y in truth), sum(1 - y for _, y in truth)
    prior, table = (good + 1) / (good + bad + 2), {}
    for f in op6.FEATURES:
        cells = collections.defaultdict(lambda: [0, 0])
        for i, y in truth:
            cells[feats[i][f]][y] += 1
        for b, (n0, n1) in cells.items():
            table[f, b] = max(-op6.CLIP, min(op6.CLIP, math.log((n1 + 1) / (good + 20)) - math.log((n0 + 1) / (bad + 20))))
    logit = lambda x: math.log(x / (1 - x))
    sigmoid = lambda x: 1 / (1 + math.exp(-x))
    evidence = {i: sum(table.get((f, feats[i][f]), 0.0) for f in op6.FEATURES) for i in feats}
    own = {i: sigmoid(e + logit(prior)) for i, e in evidence.items()}
    paths, hosts = collections.defaultdict(list), collections.defaultdict(list)
    for i, _, lang, source in rows:
        paths[source, lang].append(own[i])
        hosts[source].append(own[i])

    def strength(groups, centre):
        some = [(len(v), sum(v), centre(key)) for key, v in groups.items() if len(v) > 1]
        n = sum(x[0] for x in some)
        spread = max(1e-9, (sum(m * (s / m - c) ** 2 for m, s, c in some) - sum(c * (1 - c) for *_, c in some)) / n)
        return min(1000.0, max(2.0, sum(m * c * (1 - c) for m, _, c in some) / n / spread - 1))

    k1 = strength(hosts, lambda _: prior)
    rate = {h: (sum(v) + k1 * prior) / (len(v) + k1) for h, v in hosts.items()}
    k2 = strength(paths, lambda key: rate[key[0]])
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    got = {r.doc_id: r for r in op6.site_quality(docs, spark.createDataFrame(truth, "doc_id long, quality int")).collect()}
    for i, _, lang, source in rows:
        mine = paths[source, lang]
        site = max(1e-6, (sum(mine) - own[i] + k2 * rate[source]) / (len(mine) - 1 + k2))
        score = sigmoid(evidence[i] + logit(min(max(site, 1e-6), 1 - 1e-6)))
        assert (got[i].evidence, got[i].site_rate, got[i].score) == pytest.approx((evidence[i], site, score), abs=2e-5) and got[i].kept == (got[i].score >= 0.3)


def test_op5_columns(spark, folder):
    got = op5_length_buckets.op5_length_buckets(spark, folder).collect()
    lengths = {r[0]: len(_bytes(r[1]).split()) for r in ROWS}
    assert {r.doc_id: r.n_tokens for r in got} == lengths and len(got) == len(lengths)
    bounds = sorted({r.bucket_length for r in got})
    assert len(bounds) <= 16 and bounds[-1] == max(lengths.values())
    batches = collections.defaultdict(list)
    for r in got:
        assert r.bucket_length == min(b for b in bounds if b >= r.n_tokens) and r.padding == r.bucket_length - r.n_tokens
        batches[r.bucket, r.batch].append((r.place, r.bucket_length))
    for (bucket, batch), members in batches.items():
        room = max(1, 16_384 // max(1, members[0][1]))
        last = batch == max(b for k, b in batches if k == bucket)
        assert sorted(m[0] for m in members) == list(range(len(members))) and (len(members) == room or last and len(members) < room)
    distinct = sorted(set(lengths.values()))
    assert sum(r.padding for r in got) == (0 if len(distinct) <= 16 else _least_padding(distinct, collections.Counter(lengths.values()), 16))


def _least_padding(distinct, counts, buckets):
    best = {0: 0}
    for _ in range(buckets):
        new = dict(best)
        for j in range(1, len(distinct) + 1):
            for i, cost in best.items():
                if i < j:
                    c = cost + sum((distinct[j - 1] - distinct[x]) * counts[distinct[x]] for x in range(i, j))
                    new[j] = min(new.get(j, 1 << 60), c)
        best = new
    return best[len(distinct)]


def test_op7_columns(spark, folder):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=op9_piece_codec.default_model())
    ids = {r[0]: sp.encode(r[1] or "", add_bos=True, add_eos=True) for r in ROWS}
    length, seen = op7_packed_ids.ROW_LENGTH, collections.Counter()
    for r in op7_packed_ids.op7_packed_ids(spark, folder).collect():
        parts = [ids[d][o : o + length] for d, o in zip(r.doc_ids, r.doc_offsets)]
        ends = [0]
        for d, o, part in zip(r.doc_ids, r.doc_offsets, parts):
            seen[d] += len(part)
            ends.append(ends[-1] + len(part))
        row = [x for part in parts for x in part]
        places = [x for part in parts for x in range(len(part))] + list(range(length - len(row)))
        packed = lambda v: struct.pack(f"<{length}I", *v)
        assert (list(r.cu_seqlens), r.n_tokens, r.ids_sha256, r.positions_sha256) == (ends, len(row), _sha(packed(row + [0] * (length - len(row)))), _sha(packed(places)))
    assert seen == {d: len(v) for d, v in ids.items() if v}


def test_op4_media_columns(spark, folder):
    for r in op4_media_shards.op4_media_shards(spark, folder).collect():
        b = _bytes(ROWS[r.doc_id][1])
        p = b + b"\0" * (-len(b) % 64 if b else 64)
        piece = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
        rows = b"".join(b"\0" + p[k : k + 64] for k in range(0, len(p), 64))
        media = b"\x89PNG\r\n\x1a\n" + piece(b"IHDR", struct.pack(">IIBBBBB", 64, len(p) // 64, 8, 0, 0, 0, 0)) + piece(b"IDAT", zlib.compress(rows, 6)) + piece(b"IEND", b"")
        bins = collections.Counter(x >> 5 for x in p)
        feature = f"64x{len(p) // 64};sum={sum(p)};max={max(p)};bins={','.join(str(bins[k]) for k in range(8))}"
        assert (r.media_bytes, r.media_sha256, r.feature, r.width, r.height) == (len(media), hashlib.sha256(media).hexdigest(), feature, 64, len(p) // 64)


def test_the_corpus_of_these_tests_has_hard_cases():
    texts = [r[1] for r in corpus()]
    assert None in texts and "" in texts and max(len(t or "") for t in texts) > 10_000
