import random

import pytest

from quillstream.llm import similar

pipeline = pytest.importorskip("corpus_pipeline")


def brute_kept(rows):
    """The smallest id of each component of texts with Jaccard >= 0.8 on five-word shingles."""

    def of(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets, root = {i: of(t) for i, t, _ in rows}, {i: i for i, _, _ in rows}
    find = lambda x: x if root[x] == x else find(root[x])
    for a in sets:
        for b in sets:
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted(i for i in sets if find(i) == i)


def edited(words, places):
    return " ".join(f"new{k}" if k in places else w for k, w in enumerate(words))


def corpus():
    rng = random.Random(3)
    rows = []
    for g in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice([6, 40, 150, 300]))]
        rows.append((g * 10, " ".join(words), "en"))
        for k, share in enumerate((0.008, 0.015, 0.02, 0.03, 0.1)):
            places = set(rng.sample(range(len(words)), max(1, int(share * len(words)))))
            rows.append((g * 10 + k + 1, edited(words, places).upper() if k % 2 else edited(words, places), "en"))
    return rows + [(900, "a b", "en"), (901, "A  b", "en"), (902, "", "en"), (903, None, "en")]


@pytest.mark.parametrize("small", [3, 1])
def test_the_stage_drops_texts_of_similarity_0_8(spark, make_docs, sf_dir, small, monkeypatch):
    """Nothing is dropped wrongly, and at least nine tenths of what all pairs drop."""
    monkeypatch.setattr(similar, "SMALL", small)
    rows = corpus()
    kept = {r.doc_id for r in pipeline.drop_near_copies(spark, make_docs(rows), sf_dir).collect()}
    want = set(brute_kept(rows))
    assert want <= kept
    assert len(kept - want) <= 0.1 * (len(rows) - len(want))


def test_fingerprint_is_the_majority_of_mixed_hashes():
    import numpy as np

    for n in (1, 5, 254, 255, 256, 700):
        shingled = np.unique(np.random.default_rng(n).integers(0, 1 << 64, n, np.uint64))
        x = (shingled[:, None] ^ similar._SALTS) * similar._MIX
        x ^= x >> np.uint64(32)
        x *= similar._MIX2
        x ^= x >> np.uint64(29)
        want = [sum(1 << b for b in range(64) if 2 * sum(int(v) >> b & 1 for v in x[:, w]) > len(x)) for w in range(similar.WORDS)]
        assert similar.fingerprint(shingled).tolist() == want


def test_similar_texts_lie_within_the_radius():
    rng = random.Random(5)
    for n in (30, 200, 1000):
        words = [f"w{rng.randrange(9000)}" for _ in range(n)]
        for _ in range(20):
            other = list(words)
            while True:
                other[rng.randrange(n)] = f"n{rng.random()}"
                a, b = similar.shingles(" ".join(words)), similar.shingles(" ".join(other))
                if not similar.similar(a, b):
                    break
                d = sum(bin(int(x) ^ int(y)).count("1") for x, y in zip(similar.fingerprint(a), similar.fingerprint(b), strict=True))
                assert d <= similar.RADIUS


def test_a_large_group_of_near_copies_is_one_component(spark, make_docs, sf_dir):
    rng = random.Random(11)
    words = [f"w{rng.randrange(9000)}" for _ in range(300)]
    rows = [(i, edited(words, {rng.randrange(300)}), "en") for i in range(400)]
    assert [r.doc_id for r in pipeline.drop_near_copies(spark, make_docs(rows), sf_dir).collect()] == [0]


def test_rows_without_id_stay(spark, make_docs, odd, empty, sf_dir):
    assert pipeline.drop_near_copies(spark, empty, sf_dir).count() == 0
    kept = [r.doc_id for r in pipeline.drop_near_copies(spark, odd, sf_dir).collect()]
    assert None in kept and sorted(k for k in kept if k is not None) == [1, 4, 5, 6, 6, 7]


def test_a_group_of_many_similarities_is_exact(spark, make_docs, sf_dir):
    """Near copies of one text at similarity 0.2 to 0.9: more than meet at an anchor, and in more than one block."""
    rng = random.Random(17)
    words = [f"w{rng.randrange(9000)}" for _ in range(120)]
    rows = [(i, edited([w if k else f"{w}x{i}" for k, w in enumerate(words)], set(rng.sample(range(120), rng.randrange(1, 14)))).replace("new", f"n{i % 97}e"), "en") for i in range(700)]
    kept = sorted(r.doc_id for r in pipeline.drop_near_copies(spark, make_docs(rows), sf_dir).collect())
    want = brute_kept(rows)
    assert 20 < len(want) < 680
    assert kept == want


def test_an_anchor_drops_no_candidate():
    """Two tight groups, farther from each other than each node from its nearest, share an anchor."""
    import numpy as np
    import pandas as pd

    near = np.uint64((1 << 18) - 1)
    for n in (20, 200, 9000):
        piece = np.array([(near if i % 2 else np.uint64(0)) ^ np.uint64(1 << (20 + i % 40)) for i in range(n)], np.uint64).view(np.int64)
        rows = pd.DataFrame({"anchor": np.zeros(n, np.int64), "node": np.arange(n), "piece": piece})
        for size in (1 << 16, 100):
            similar_chunk, similar.CHUNK = similar.CHUNK, max(size, 100)
            try:
                if n > size and n <= similar.CROWD:
                    continue
                met = pd.concat(similar._pairs(iter([rows])))
            finally:
                similar.CHUNK = similar_chunk
            node, root = similar.joined(met["a"].to_numpy(np.int64), met["b"].to_numpy(np.int64))
            assert len(node) == n - 1 and set(root) == {0}


def test_products_of_incidence_matrices_are_exact(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(9)
    base = rng.integers(0, 1 << 64, 60, np.uint64)
    sets = [np.unique(np.r_[base[rng.random(60) > rng.random() * 0.3], rng.integers(0, 1 << 64, rng.integers(0, 9), np.uint64)]) for _ in range(90)]
    want = {(i, j) for i in range(40) for j in range(40, 90) if similar.similar(sets[i], sets[j])}
    monkeypatch.setattr(similar, "COLUMNS", 16)
    a, b = similar._alike(sets[:40], sets[40:])
    assert set(zip(a.tolist(), (b + 40).tolist(), strict=True)) == want and 0 < len(want) < 2000
    monkeypatch.setattr(similar, "TILE", 7)
    for other in (40, 90):
        pairs = want if other == 40 else {(i, j) for i in range(90) for j in range(i + 1, 90) if similar.similar(sets[i], sets[j])}
        own = np.arange(90) + 1000
        got = dict(zip(*(x.tolist() for x in similar._forest(own, sets, other)), strict=True))
        full = dict(zip(*(x.tolist() for x in similar.joined(*(np.array(x) + 1000 for x in zip(*pairs, strict=True)))), strict=True))
        assert got == full
