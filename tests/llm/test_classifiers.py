import math
import random

import numpy as np
import pytest

from quillstream.llm import langid, quality, toxicity
from quillstream.llm.common import fold, read_table

LABELS = "doc_id long, quality int, toxic int, text string"


@pytest.fixture(scope="module")
def no_labels(spark):
    return spark.createDataFrame([], LABELS)


def test_language_of_held_out_documents(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    got = langid.language_predictions(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and held
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.9
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(odd, empty, make_docs):
    got = langid.language_predictions(odd).collect()
    assert len(got) == 9
    by = {(r.doc_id, r.held_out): r for r in got}
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert by is not None and all(0 <= r.score <= 1 for r in got)
    assert langid.language_predictions(empty).collect() == []
    none = langid.language_predictions(make_docs([(1, "some text", None), (2, "123", None)])).collect()
    assert [r.lang_pred for r in none] == ["und", "und"]


def test_presence_is_the_set_of_ngrams():
    a, b = langid.presence("abc"), langid.presence("ABC abc, abc!")
    assert a.sum() > 0 and (a & ~b).sum() == 0
    long = "xyz " * 700_000
    assert (langid.presence(long) == langid.presence("xyz xyz xyz")).all()


def test_kernel_matches_its_definition():
    texts = ["der die das und", "the and of to", "le la les et", "und der", "of the"]
    rows = [{"lang": k, "doc_id": i, "bits": np.packbits(langid.presence(t)).tobytes()} for i, (k, t) in enumerate(zip("defde", texts))]
    model = langid.Kernel(sorted(rows, key=lambda r: r["lang"]))
    x = np.stack([langid.presence(t) for t in texts])
    marks = model.matrix.T.astype(bool)
    want = [[(a & m).sum() / math.sqrt(a.sum() * m.sum()) for m in marks] for a in x]
    assert np.allclose(model.kernel(x), want, atol=1e-5)
    assert [model.langs[i] for i in model.predict(x)[0]] == list("defde")


def test_quality_of_held_out_documents(spark, sf_dir):
    docs, labels = (read_table(spark, sf_dir.replace("sf0.001", "sf0.01"), t) for t in ("documents", "labels"))
    got = quality.quality_scores(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.9
    assert all((r.score >= 0.5) == bool(r.predicted) for r in got)


def test_quality_edge_cases(spark, odd, empty, no_labels):
    labels = spark.createDataFrame([(i, i % 2, 0, "x") for i in range(8)] + [(6, 1, None, "y"), (None, 1, 1, "z")], LABELS)
    for given in (labels, no_labels):
        got = quality.quality_scores(odd, given).collect()
        assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
        assert quality.quality_scores(empty, given).collect() == []


def test_quality_features_are_whole_text_and_of_length_one():
    of = quality.Features()
    i, v = of("some words Some WORDS!! some words 12.5 " * 3)
    assert abs(float(v @ v) - 1) < 1e-9 and (np.diff(i) > 0).all()
    j, _ = of("x " * 50 + "marker")
    k, _ = of("x " * 50)
    assert len(j) > len(k)
    of.MEMO = 8
    assert len(of("a b c d e f g h i j k l m")[0]) > 10


def brute_segments(w):
    """All maximal segments by their definition: the best one, then those left and right of it."""
    best = max(((sum(w[i:j]), -(j - i), -i, i, j) for i in range(len(w)) for j in range(i + 1, len(w) + 1)), default=None)
    if not best or best[0] <= 0:
        return []
    *_, i, j = best
    return brute_segments(w[:i]) + [(i, j, best[0])] + [(a + j, b + j, s) for a, b, s in brute_segments(w[j:])]


def test_segments_match_their_definition():
    rng = random.Random(1)
    for _ in range(300):
        w = [rng.choice([-3.5, -2.25, -1.125, 1.0, 2.5, 4.75]) + rng.random() / 64 for _ in range(rng.randint(0, 14))]
        got = toxicity.segments([(i, i + 1, x) for i, x in enumerate(w)])
        want = brute_segments(w)
        assert [g[:2] for g in got] == [g[:2] for g in want]
        assert np.allclose([g[2] for g in got], [g[2] for g in want])


def test_toxicity_of_held_out_documents(spark, sf_dir):
    docs, labels = (read_table(spark, sf_dir.replace("sf0.001", "sf0.1"), t) for t in ("documents", "labels"))
    few = docs.join(labels.select("doc_id"), "doc_id")
    got = toxicity.toxicity_scores(few, labels).join(labels, "doc_id").filter("held_out").collect()
    toxic = [r for r in got if r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.75
    assert sum(r.predicted for r in got if not r.toxic) / len(got) < 0.02


def test_passages_lie_where_the_words_are(spark, make_docs):
    model = toxicity.Model(toxicity.Weights({"vile": 6.0, "rotte*": 5.0}), -0.05, 1.0, 0.001)
    text = "fine " * 50 + "vile rottenness " + "fine " * 200 + "rottens"
    got = toxicity.toxic_passages(make_docs([(1, text, "en"), (2, "vile " * 9, "en"), (3, None, "en")]), model).collect()
    assert [(r.doc_id, r.first_token, r.end_token) for r in got if r.doc_id == 1] == [(1, 50, 52), (1, 252, 253)]
    assert toxicity.best_log_e("fine words", model) == math.inf
    assert toxicity.weighted_steps(["vile", "vile"], model) == [(0, 1, 6.0)]


def test_toxicity_edge_cases(spark, odd, empty, no_labels):
    labels = spark.createDataFrame([(i, 1, i % 2, "x") for i in range(8)], LABELS)
    for given in (labels, no_labels):
        got = toxicity.toxicity_scores(odd, given).collect()
        assert len(got) == 9 and all(0 <= r.score <= 1 for r in got)
        assert toxicity.toxicity_scores(empty, given).collect() == []
        assert toxicity.without_toxic(odd, given).columns == odd.columns


def test_fold_is_crc32_of_the_id_as_text(spark):
    from zlib import crc32

    ids = spark.range(50)
    got = ids.select("id", fold(ids.id, 3).alias("f")).collect()
    assert all(r.f == crc32(str(r.id).encode()) % 3 for r in got)
