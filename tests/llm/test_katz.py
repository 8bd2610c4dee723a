import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from quillstream.llm import katz

END = None


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low) + [END]


class Brute:
    """The model by its formulas, with dictionaries."""

    def __init__(self, texts):
        self.c = [Counter(), Counter(), Counter()]
        for t in texts:
            w = tokens(t)
            pad = [END, END, *w]
            for n in range(3):
                self.c[n].update(tuple(pad[i - n : i + 1]) for i in range(2, len(pad)))
        self.n = sum(self.c[0].values())
        self.c1 = {w: c for (w,), c in self.c[0].items()}
        ds = [katz.discounts([0] + [sum(c == r for c in x.values()) for r in range(1, katz.K + 2)]) for x in self.c]
        self.d = lambda n, c: ds[n][c] if c <= katz.K else 1.0
        free = sum((1 - self.d(0, c)) * c for c in self.c1.values())
        self.total = self.n if free > 0 else self.n + 1
        self.unknown = (free or 1.0) / self.total
        self.p1 = {w: self.d(0, c) * c / self.total for w, c in self.c1.items()}
        self.below, self.alpha = {}, {}
        for n in (1, 2):
            follow = {}
            for gram, c in self.c[n].items():
                follow.setdefault(gram[:-1], {})[gram[-1]] = c
            for h, x in follow.items():
                free = sum((1 - self.d(n, c)) * c for c in x.values())
                self.below[h] = sum(x.values()) + (free <= 0)
                self.alpha[h] = (free if free > 0 else 1.0) / self.below[h] / (1 - sum(self.p(h[1:], w) for w in x))

    def p(self, h, w):
        if not h:
            return self.p1.get(w, self.unknown)
        c = self.c[len(h)].get((*h, w), 0)
        if c:
            return self.d(len(h), c) * c / self.below[h]
        return self.alpha.get(h, 1.0) * self.p(h[1:], w)

    def score(self, text):
        w = [END, END, *tokens(text)]
        return sum(math.log10(self.p((w[i - 2], w[i - 1]), w[i])) for i in range(2, len(w)))

    def base(self, text):
        v = len(self.c1)
        return sum(math.log10((self.c1.get(w, 0) + 0.1) / (self.n + 0.1 * (v + 1))) for w in tokens(text))


@pytest.fixture(scope="module")
def corpus():
    rng = np.random.default_rng(4)
    words = [f"W{int(k)}" for k in rng.zipf(1.4, 6000) % 300]
    rows = [(i, " ".join(words[i * 15 : i * 15 + 15 - i % 9]), "en") for i in range(400)]
    return rows + [(400, None, "en"), (401, "", None), (402, "  new\tWords  w1 \x1c", "en"), (None, "w1 w2", "en"), (5, rows[5][1], "en")]


@pytest.mark.parametrize("hot_tokens", [katz.HOT_TOKENS, 40])
def test_scores_match_the_formulas(make_docs, corpus, hot_tokens, monkeypatch):
    monkeypatch.setattr(katz, "BLOCK_CHARS", 2000)
    held = lambda i: i is not None and crc32(str(i).encode()) % 10 == 0
    model = Brute([t for i, t, _ in corpus if i is not None and not held(i)])
    rare = next(w for w, c in model.c1.items() if c == 1)
    for h in [(END,), ("w1",), (rare,), ("never",), (END, END), ("w1", "w2"), ("w2", "w1"), (END, "w1"), (rare, "never"), ("never", "w1")]:
        total = sum(model.p(h, w) for w in [*model.c1, "not a word"])
        assert abs(total - 1) < 1e-9
    got = katz.katz_scores(make_docs(corpus), bucket_tokens=700, hot_tokens=hot_tokens).collect()
    assert len(got) == len(corpus)
    texts = {i: t for i, t, _ in corpus}
    for r in got:
        text = texts[r.doc_id]
        assert r.held_out == held(r.doc_id) and r.train_tokens == model.n
        assert r.n_tokens == len(tokens(text)) and r.n_known == sum(w in model.c1 for w in tokens(text))
        assert abs(r.score - model.score(text)) < 1e-8 and abs(r.base_score - model.base(text)) < 1e-8


def test_edge_cases(odd, empty, make_docs):
    assert len(katz.katz_scores(odd).collect()) == 9
    assert katz.katz_scores(empty).collect() == []
    ids = [i for i in range(100) if crc32(str(i).encode()) % 10 == 0]
    got = katz.katz_scores(make_docs([(ids[0], "all held out", "en")])).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got] == [(4, 0, 0, 0.0)]


def test_discounts():
    d = katz.discounts([0, 1000, 400, 220, 140, 100, 75])
    r = np.arange(1, 6)
    assert ((d[1:] > 0) & (d[1:] < 1)).all()
    # Katz: the discounted mass is the Good-Turing mass of unseen events.
    assert abs(((1 - d[1:]) * r * np.array([1000, 400, 220, 140, 100])).sum() - 1000) < 1e-9
    assert (katz.discounts([0, 0, 0, 0, 0, 0, 0])[1:] == 1 - 0.5 / r).all()


def test_packing():
    for a in ([], [0, 3], [300], [70_000], [1 << 40]):
        assert katz.unpack(katz.pack(np.array(a, np.int64))).tolist() == a
    assert katz.unpack(katz.pack(np.array([0.25]))).tolist() == [0.25]


@pytest.mark.parametrize("hot_tokens", [katz.HOT_TOKENS, 3])
def test_histories_before_unknown_words_back_off_in_every_block(make_docs, monkeypatch, hot_tokens):
    """Rare histories before unknown words alone: the same scores whatever the blocks."""
    held = lambda i: crc32(str(i).encode()) % 10 == 0
    rows = [(i, f"never{i} rare{i % 7} unknown{i} w1 other{i}" if held(i) else f"w1 w2 rare{i % 7} w{i % 5} w3", "en") for i in range(120)]
    model = Brute([t for i, t, _ in rows if not held(i)])
    want = {i: model.score(t) for i, t, _ in rows}
    for size in (1, 100, 6_000_000):
        monkeypatch.setattr(katz, "BLOCK_CHARS", size)
        got = {r.doc_id: r.score for r in katz.katz_scores(make_docs(rows), bucket_tokens=100, hot_tokens=hot_tokens).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-8 for i in want)
