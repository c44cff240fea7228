"""The opN_ queries, columns and digests, against plain Python on a small folder of documents."""

import hashlib
import zlib

import numpy as np
import pytest

from tallybook.llm import op3_suffix_dedup, op4_media_shards, op8_ngram_jaccard, op9_piece_codec, op10_substring_dedup
from tests.llm.test_operators import _bytes, _components, _repeated_bytes, corpus

ROWS = [(k, *r[1:]) for k, r in enumerate(corpus())]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame([(r[0], r[1]) for r in ROWS], "doc_id long, text string").repartition(3).write.parquet(f"{at}/documents.parquet")
    return at


def _sha(data):
    return hashlib.sha256(data).hexdigest()


def test_op3_columns(spark, folder):
    want = {i: (len(b), int(g.sum()), _sha(np.frombuffer(b, np.uint8)[~g].tobytes())) for i, b, g in _repeated_bytes(ROWS, 400)}
    shorter = {i: int(g.sum()) for i, _, g in _repeated_bytes(ROWS, op3_suffix_dedup.PASSAGE)}
    got = op3_suffix_dedup.op3_suffix_dedup(spark, folder).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.kept_sha256) for r in got} == want and {r.doc_id: r.n_passage_bytes for r in got} == shorter


def test_op4_columns(spark, folder):
    for r in op4_media_shards.op4_media_shards(spark, folder).collect():
        b = _bytes(ROWS[r.doc_id][1])
        p = b + b"\0" * (-len(b) % 64 if b else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), _sha(p), zlib.crc32(p[-64:]))


def test_op8_columns(spark, folder):
    sets, least, _ = _components(ROWS)
    links = [sum(i != j and bool(s) and 100 * len(s & t) >= 75 * len(s | t) for j, t in enumerate(sets)) for i, s in enumerate(sets)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in op8_ngram_jaccard.op8_ngram_jaccard(spark, folder).collect()}
    assert got == {r[0]: (len(s), c if s else r[0], k) for r, s, c, k in zip(ROWS, sets, least, links)}


def test_op9_columns(spark, folder):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=op9_piece_codec.default_model())
    got = op9_piece_codec.op9_piece_codec(spark, folder).collect()
    assert len(got) == len(ROWS)
    for r in got:
        ids = sp.encode(ROWS[r.doc_id][1] or "", add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), _sha(np.array(ids, "<u4").tobytes()), _sha(sp.decode(ids).encode()))


def test_op10_columns(spark, folder):
    words = {r[0]: _bytes(r[1]).split() for r in ROWS}
    seen = {}
    for w in words.values():
        for i in range(len(w) - 34):
            seen[tuple(w[i : i + 35])] = seen.get(tuple(w[i : i + 35]), 0) + 1
    for r in op10_substring_dedup.op10_substring_dedup(spark, folder).collect():
        w = words[r.doc_id]
        gone = {k for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for k in range(i, i + 35)}
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), len(gone), _sha(b" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_op4_of_no_rows(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert op4_media_shards.op4_media_shards(spark, str(tmp_path)).count() == 0
