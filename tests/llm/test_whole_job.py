"""Cases in which an operator once did less than its whole job."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallybook.llm import graph, op1_masked_lm, op2_quality_rules
from tallybook.llm.blocks import keys_to_bytes
from tallybook.llm.kernels import Words

SCHEMA = "doc_id long, text string, lang string, source string"


def test_masked_lm_gives_words_of_one_shared_id_their_own_probability(spark):
    shared = {}
    for i in range(500):
        word = f"rare{i}"
        shared.setdefault(int(op1_masked_lm.shared_ids(Words([word.encode()]).hashes)[0]), []).append(word)
    often, seldom = max(shared.values(), key=len)[:2]
    fill = [f"fill{i}" for i in range(4100)]
    rows = [(i, " ".join(fill), None, None) for i in range(10)]
    rows += [(100, f"fill1 fill2 {often} fill3 fill4", None, None), (101, f"fill1 fill2 {seldom} fill3 fill4", None, None)]
    rows += [(200 + i, f"fill1 fill2 {often} fill3 fill4", None, None) for i in range(3)]
    got = {r.doc_id: r.log_likelihood for r in op1_masked_lm.masked_lm_scores(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()}
    assert abs(got[100] - got[101] - math.log(4)) < 1e-2


def test_masked_lm_vocabulary_follows_the_counted_words(spark):
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 9000).astype(np.uint64))
    counts = np.where(np.arange(9000) % 3 < 2, 1000, 2)
    rows = [(0, None, keys_to_bytes(keys), op1_masked_lm._pack_counts(counts))]
    vocabulary = op1_masked_lm.Vocabulary(spark.createDataFrame(rows, op1_masked_lm.COUNTS))
    assert len(vocabulary.keys) == 6000 and vocabulary.classes == 78
    assert vocabulary.shared.sum() == 6000
    assert abs(sum(np.exp(vocabulary.log_shares(vocabulary.of(keys), counts))[counts == 2]) - 63) < 1e-6


def test_components_do_not_stop_before_they_settle(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.component for r in graph.components(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        graph.components(chain, rounds=1)


def test_each_quality_fence_rejects_below_the_base_limit(spark):
    line = lambda d, k, n=10, w=6: " ".join(f"{d:03d}{k:02d}{i:02d}".ljust(w, "x") for i in range(n))
    rows = [(d, "\n".join(line(d, k) for k in range(10)), "en", "s") for d in range(400)]
    phrase = line(904, 99, 8)
    rows += [
        (901, " ".join(f"w{i}#" for i in range(100)), "en", "s"),
        (902, "\n".join(line(902, k) + "\nshort" for k in range(10)), "en", "s"),
        (903, line(903, 0, 100, 30), "en", "s"),
        (904, phrase + " " + line(904, 0, 84) + " " + phrase, "en", "s"),
    ]
    got = {r.doc_id: r for r in op2_quality_rules.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(got[d].base_failed for d in (901, 902, 903, 904))
    assert [got[d].beyond for d in (901, 902, 903, 904)] == [["symbol_rate"], ["dup_line_rate"], ["word_length"], ["repeat_rate"]]
    assert all(got[d].kept for d in range(400))


def test_columns_with_inner_names_pass_through(spark):
    from tallybook.llm import op6_site_quality

    rows = [(i, f"Document {i} says these ten or more words without any harm today {i}", "en", "s") for i in range(30)]
    names = ["_h", "_w", "_t", "_s", "_lang", "_source", "own", "n", "s", "host_rate", "_host", "_key", "f_upper", "fence_repeat_rate", "symbol_rate", "n_lines", "kept"]
    docs = spark.createDataFrame(rows, SCHEMA).withColumns({n: F.lit("mine") for n in names})
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    for out, made in ((op2_quality_rules.quality_rules(docs), [*op2_quality_rules.COUNTS, "n_lines", "beyond", "kept"]), (op6_site_quality.site_quality(docs, labels), op6_site_quality.MADE)):
        mine = [c for c in docs.columns if c not in made]
        assert out.columns == mine + [c for c in out.columns if c in made]
        assert all(r[c] == "mine" for r in out.collect() for c in mine if c in names)
