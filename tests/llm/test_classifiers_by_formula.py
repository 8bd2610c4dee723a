"""The classifiers against plain loops over their formulas, and the edge cases of their samples."""

import math
import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillstream.llm import langid, quality, toxicity
from quillstream.llm.common import held_out
from quillstream.llm.sampling import labelled_sample, sampled_texts


def test_ridge_regression_on_landmarks_matches_the_normal_equations():
    rng = random.Random(2)
    words = {"a": "der die das und ist nicht".split(), "b": "the and of is not was".split(), "c": "le la les est pas un".split()}
    rows = [{"lang": k, "doc_id": i, "text": " ".join(rng.choices(w, k=12))} for k, w in words.items() for i in range(20)]
    for r in rows:
        r["bits"] = np.packbits(langid.presence(r["text"])).tobytes()
    model = langid.Kernel(rows)
    sets = [set(np.flatnonzero(langid.presence(r["text"]))) for r in rows]
    k = lambda s, t: len(s & t) / math.sqrt(len(s) * len(t))
    marks = [s for lang in "abc" for s in [x for x, r in zip(sets, rows) if r["lang"] == lang][: langid.LANDMARKS // 3]]
    k_nm, k_mm = (np.array([[k(s, t) for t in marks] for s in left]) for left in (sets, marks))
    y = np.array([[1.0 if r["lang"] == lang else -1.0 for lang in "abc"] for r in rows])
    want = np.linalg.solve(k_nm.T @ k_nm + langid.RIDGE * k_mm + 1e-6 * np.eye(len(marks)), k_nm.T @ y)
    texts = ["und die das", "was not of", "pas un est"]
    own = np.array([[k(set(np.flatnonzero(langid.presence(t))), m) for m in marks] for t in texts])
    top, score = model.predict(np.stack([langid.presence(t) for t in texts]))
    assert top.tolist() == (own @ want).argmax(axis=1).tolist() == [0, 1, 2]
    e = np.exp(langid.SHARPNESS * (own @ want))
    assert np.allclose(score, e.max(axis=1) / e.sum(axis=1), atol=0.02)


def test_repeated_training_rows_count_once(spark, make_docs):
    rows = [(1, "der die das", "de"), (2, "the of and", "en")] * 400 + [(3, None, "en"), (4, "x", None)]
    got = langid.training_rows(make_docs(rows), F.lit(True), 100)
    assert [(r["doc_id"], r["lang"]) for r in got] == [(1, "de"), (2, "en")]


def test_ftrl_matches_its_updates_one_by_one():
    rng = np.random.default_rng(3)
    rows = []
    for _ in range(30):
        index = np.sort(rng.choice(40, 6, replace=False))
        rows.append((index, rng.random(6), int(rng.integers(2))))
    w, b = quality.fit_ftrl(rows)
    z, n, zb, nb = [0.0] * 40, [0.0] * 40, 0.0, 0.0

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - math.copysign(quality.L1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for index, value, y in rows:
            at = {int(i): float(v) for i, v in zip(index, value)}
            now = {i: weight(i) for i in at}
            bias = -zb / ((quality.BETA + math.sqrt(nb)) / quality.ALPHA)
            p = 1 / (1 + math.exp(-(sum(now[i] * v for i, v in at.items()) + bias)))
            for i, v in at.items():
                g = (p - y) * v
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * now[i]
                n[i] += g * g
            g = p - y
            zb += g - (math.sqrt(nb + g * g) - math.sqrt(nb)) / quality.ALPHA * bias
            nb += g * g
    assert np.allclose(w[:40], [weight(i) for i in range(40)], atol=1e-9) and not w[40:].any()
    assert abs(b + zb / ((quality.BETA + math.sqrt(nb)) / quality.ALPHA)) < 1e-9


def test_quality_scores_are_sparse_dot_products(spark, make_docs):
    docs = make_docs([(i, f"good words number {i}. They read well" if i % 2 else f"BUY!!! {i} $$$ now now now", "en") for i in range(200)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    index, weight, bias = quality.fit(docs, labels, "quality", ~held_out(3, 1))
    by = dict(zip(index.tolist(), weight.tolist()))
    of = quality.Features()
    for r, text in zip(sorted(quality.quality_scores(docs, labels).collect()), [r.text for r in sorted(docs.collect())]):
        i, v = of(text)
        s = sum(by.get(int(k), 0.0) * x for k, x in zip(i, v)) + bias
        assert abs(r.score - 1 / (1 + math.exp(-s))) < 1e-6 and r.predicted == (r.doc_id % 2)


def test_all_segments_count_together():
    model = toxicity.Model(toxicity.Weights({}), -0.05, 0.7, 0.02)
    n, scores = 400, [14.0, 13.0, 12.5, 1.0]
    t = [sum(0.7 * x - math.log(0.02 * n) for x in scores[:r]) for r in range(1, 5)]
    one = -t[0]
    three = 2 * math.log(t[2]) - t[2] - math.log(6) - math.log(2) + 2 * math.log(2)
    assert math.isclose(toxicity.aggregated([scores[0]], n, model), one)
    assert math.isclose(toxicity.aggregated(scores[:3], n, model), three) and three < one
    assert toxicity.aggregated(scores, n, model) <= toxicity.aggregated(scores[:3], n, model)
    assert toxicity.aggregated([], n, model) == math.inf


def test_passages_reach_the_scores(spark, make_docs):
    vile = "vile filth scum rot muck slime dregs grime".split()
    fine = "tree lake bird hill moss path rain wind leaf dawn reed fern".split()
    rng = random.Random(5)
    rows = []
    for i in range(1200):
        words = rng.choices(fine, k=60)
        if i % 4 == 0:
            at = rng.randrange(50)
            words[at : at + 4] = rng.choices(vile, k=4)
        rows.append((i, " ".join(words), "en"))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(1200)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(make_docs(rows), labels).collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got)
    assert all((r.passages > 0) == (r.doc_id % 4 == 0) and r.passage_tokens >= 2 * r.passages for r in got)


def test_counts_are_handed_on_in_parts(monkeypatch):
    import pandas as pd

    texts, y = ["alpha beta alphabet", "beta gamma", "alpha"] * 5, [0, 1, 1] * 5
    frames = {}
    for bound in (1, 10**9):
        monkeypatch.setattr(toxicity, "COUNTED", bound)
        parts = list(toxicity._counts(iter([pd.DataFrame({"text": texts, "y": y})])))
        frames[len(parts) > 1] = pd.concat(parts).groupby("token").sum().sort_index()
    assert frames[True].equals(frames[False])
    plain = Counter(k for t, c in zip(texts, y) if c for w in t.split() for k in toxicity._keys(w))
    assert {k: v for k, v in frames[True]["n1"].items() if v} == dict(plain)


def test_samples_with_ties_and_repeats(spark, make_docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] * 3 + [(7, 0), (None, 1), (8, None), (9, 5)], "doc_id long, quality int")
    one = [labelled_sample(labels, "quality", F.lit(True), 40) for _ in range(2)]
    rows = [sorted(map(tuple, s.collect())) for s, _ in one]
    assert rows[0] == rows[1] and len(rows[0]) == 40 and one[0][1] == {0: 50, 1: 50}
    docs = make_docs([(i, "same text" if i < 50 else f"text {i}", "en") for i in range(100)] * 2)
    texts = sampled_texts(docs, one[0][0]).collect()
    assert len({(r.text, r.y) for r in texts}) == len(texts)
