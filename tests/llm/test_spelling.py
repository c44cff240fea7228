"""Spelling variants against a plain walk over all edits."""

import collections
import random
import re
import zlib

import numpy as np
import pytest

from tallybook.llm import op13_spelling_forms as op13

SCHEMA = "doc_id long, text string, word string, n string, root string"


def rows():
    r = random.Random(2)
    letters = "abcdeéÿ×sst"
    stems = ["".join(r.choice(letters) for _ in range(r.randint(6, 11))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "Straßen", "ÀÉÎõü÷þ", "x" * 200]
    out = []
    for d in range(250):
        words = []
        for _ in range(r.randint(0, 40)):
            w = r.choice(stems[: r.randint(1, len(stems))])
            k = r.randrange(len(w))
            words.append(r.choice([w, w, w, w.upper(), w[:k] + w[k + 1 :], w[:k] + r.choice(letters) + w[k:], w[:k] + r.choice(letters) + w[k + 1 :]]))
        out.append((d, r.choice([" ", ", ", "1", "\n"]).join(words), "clash", "clash", None))
    chain = ["harbours"] * 300 + ["harbourz"] * 26 + ["harbvurz"] * 2
    out.append((260, " ".join(chain), None, None, None))
    return out + [(None, "Elsewhere elsewhere elsewherf", None, None, None), (251, None, None, None, None), (252, "", None, None, None), out[5], out[5]]


def brute(table):
    n = collections.Counter()
    for doc, text, *_ in table:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    around = {w: [v for v in n if near(v, w)] for w in n}
    form = {}
    for w, vs in around.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(around[w]), None if form[w] is None else n[form[w]]) for w in n}


@pytest.mark.parametrize(("piece_words", "pass_bytes"), [(op13.PIECE, op13.PASS_BYTES), (5, 300)])
def test_forms(spark, piece_words, pass_bytes):
    table = rows()
    want = brute(table)
    assert sum(v[0] is not None for v in want.values()) > 20 and any(v[0] is not None and v[0] != v[1] for v in want.values())
    out = op13.spelling_forms(spark.createDataFrame(table, SCHEMA).repartition(3), piece_words=piece_words, pass_bytes=pass_bytes)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(want) and {g[0]: g[1:] for g in got} == want


def test_filters_hold_what_was_put_in():
    hashes = np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64)
    bits = np.frombuffer(op13.built(hashes[:10_000]), np.uint8)
    found = op13.held(hashes, bits)
    assert np.array_equal(found[:10_000], np.arange(10_000)) and len(found) < 10_100


def test_no_words(spark):
    assert op13.spelling_forms(spark.createDataFrame([(1, None), (2, "a b c")], "doc_id long, text string")).count() == 0
    assert op13.spelling_forms(spark.createDataFrame([], "doc_id long, text string")).count() == 0
