"""SimHash groups against all pairs of fingerprints."""

import collections
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallybook.llm import op11_simhash_near as op11
from tests.llm.test_operators import SCHEMA, corpus


def _fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _groups(fps):
    part = {f: f for f in fps}
    listed = list(part)
    for i, a in enumerate(listed):
        for b in listed[:i]:
            if (a ^ b).bit_count() <= 4 and part[a] != part[b]:
                old, new = part[a], part[b]
                part = {f: new if p == old else p for f, p in part.items()}
    return part


def test_fingerprints_and_components(spark):
    rows = corpus()
    fps = [_fingerprint(r[1]) for r in rows]
    part = _groups(fps)
    least = collections.defaultdict(list)
    for f, r in zip(fps, rows):
        least[part[f]] += [r[0]] if r[0] is not None else []
    want = collections.Counter((r[0], f"{f:016x}", min(least[part[f]])) for f, r in zip(fps, rows))
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("fingerprint", F.lit("clash")).withColumn("component", F.lit(1)).repartition(3)
    out = op11.simhash_groups(docs)
    assert sorted(out.columns) == sorted(docs.columns + ["component_id"])
    assert collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in out.collect()) == want


@pytest.mark.parametrize("tile", [4096, 40, 7])
def test_links_of_crowded_variants(spark, tile):
    r = random.Random(4)
    centres = [r.getrandbits(64) for _ in range(6)]
    fps = {c for c in centres}
    for c in centres:
        for _ in range(60):
            x = c
            for _ in range(r.randint(1, 9)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps |= {(centres[0] & ((1 << 42) - 1)) | r.getrandbits(22) << 42 for _ in range(80)} | {r.getrandbits(64) for _ in range(200)}
    part = _groups(fps)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    groups = collections.defaultdict(set)
    for f, p in part.items():
        groups[p].add(signed(f))
    want = {f: min(g) for g in groups.values() if len(g) > 1 for f in g}
    classes = spark.createDataFrame([(signed(f),) for f in fps], "fp long").repartition(3)
    assert {x.node: x.component for x in op11.linked(classes, tile, 2000).collect()} == want


def test_every_pair_of_four_bits_shares_a_variant(spark):
    r = random.Random(8)
    pairs = []
    for _ in range(300):
        a = r.getrandbits(64)
        b = a
        for bit in r.sample(range(64), 4):
            b ^= 1 << bit
        pairs.append((a, b))
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    rows = op11.variants(spark.createDataFrame([(signed(x),) for p in pairs for x in p], "fp long")).collect()
    keys = collections.defaultdict(set)
    for x in rows:
        keys[x.fp].add(x.variant)
    assert all(keys[signed(a)] & keys[signed(b)] for a, b in pairs)
    assert all(len(v) == 64 for v in keys.values())


def test_no_documents(spark):
    assert op11.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = op11.simhash_groups(spark.createDataFrame([(None, None), (4, None)], "doc_id long, text string")).collect()
    assert {(x.doc_id, x.fingerprint, x.component_id) for x in one} == {(None, "0" * 16, 4), (4, "0" * 16, 4)}
