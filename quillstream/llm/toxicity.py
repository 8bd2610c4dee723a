"""Toxicity: maximum-scoring segments over token log-odds, calibrated by extreme values.

Weights. Token counts of toxic and of clean labelled documents (equal texts count once) give
log-odds under a Dirichlet prior (``PRIOR`` pseudo tokens spread like the background, and
``FLOOR`` of each) and their z-score. Tokens with |z| >= ``Z_MIN`` that at least ``MIN_DOCS``
documents hold keep their log-odds; all others share one small negative weight, the log-odds
of the rest of the mass. A random clean token then has a negative expected weight.

Search. A linear scan (Ruzzo and Tompa) finds all maximal-scoring segments of a whole text.
Runs of tokens of the common weight are taken as one step; immediate repeats count once.

Calibration. The greatest segment score S of a clean text of n tokens follows an
extreme-value law P(S < x) = exp(-E), E = K n e^(-L x). L solves sum p(w) e^(L s(w)) = 1 over
the clean distribution, K is its maximum-likelihood value on clean documents that the weights
weren't counted on. A segment is significant if E, the number of such segments that chance
gives a clean text of its length, is at most ``E_MAX``. All segments of a text are aggregated by
the sum statistics of Karlin and Altschul: with t the sum of the r best normalised scores
L S - ln(K n), chance gives E_r = e^-t t^(r-1) / (r! (r-1)!) such sums, doubled for every segment
beyond the first as r is chosen. The score of a document is a logistic function of the least
ln E_r, fitted to all the documents set aside, at the natural share of the classes.

The classifier is fitted on at most ``FIT_ROWS`` labelled rows; all texts are scored whole. Every
token that passes the tests above has a weight: at least ``MIN_DOCS`` of those rows hold it, so their
number is bounded by the sample.

Edge cases: null and empty texts score 0; without labels of both classes nothing is
significant and all scores are 0; repeated rows are scored each; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, held_out, per_text, resident, texts_of, written
from .sampling import labelled_sample, sampled_texts

#: Bound on the labelled rows to fit on, half of it for either class.
FIT_ROWS = 24_000
PRIOR, FLOOR = 500.0, 0.5
Z_MIN, MIN_ODDS, MIN_DOCS = 3.5, 1.5, 4
#: Letters of a token that may stand for it, the most first.
STEMS = (6, 5, 4)
#: Expected number of chance segments up to which a segment is significant.
E_MAX = 0.01

_TOKEN = re.compile(r"\w+")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


class Weights(dict):
    """Weights of tokens, looked up by token or stem once for each token; None: the common one."""

    MEMO = 1 << 16

    def __init__(self, known: dict[str, float]) -> None:
        super().__init__()
        self.known = known

    def __reduce__(self):
        return Weights, (self.known,)

    def __missing__(self, token: str) -> float | None:
        if len(self) >= self.MEMO:
            self.clear()
        stems = (f"{token[:n]}*" for n in STEMS if len(token) > n)
        self[token] = out = next((self.known[k] for k in (token, *stems) if k in self.known), None)
        return out


@dataclass(frozen=True)
class Model:
    weights: Weights
    other: float
    lam: float
    k: float
    bias: float = 0.0
    slope: float = 1.0

    def expected(self, score: float, n: int) -> float:
        """Expected number of segments of that score in a clean text of n tokens."""
        return self.k * max(n, 1) * math.exp(-self.lam * score)


def segments(steps: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of consecutive steps of such form.

    Linear time: each candidate looks back over candidates that it then absorbs. An entry
    keeps the running sums left of and after its segment.
    """
    found: list[tuple[int, int, float, float]] = []  # start, end, sum before, sum after
    back: list[int] = []  # nearest earlier candidate with a smaller sum before
    total = 0.0
    for start, end, w in steps:
        before, total = total, total + w
        if w <= 0:
            continue
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= before:
                j = back[j]
            if j < 0 or found[j][3] >= total:
                found.append((start, end, before, total))
                back.append(j)
                break
            start, before = found[j][0], found[j][2]
            del found[j:], back[j:]
    return [(s, e, after - before) for s, e, before, after in found]


def weighted_steps(words: list[str], model: Model) -> list[tuple[int, int, float]]:
    """(start, end, weight): one step for each token with a weight, one for each run between.

    A token that repeats the one before it tells nothing new and has the common weight.
    """
    out, last = [], 0
    for i, w in [(i, w) for i, w in enumerate(map(model.weights.__getitem__, words)) if w is not None]:
        if i and words[i] == words[i - 1]:
            continue
        if i > last:
            out.append((last, i, (i - last) * model.other))
        out.append((i, i + 1, w))
        last = i + 1
    return out


def passages(text: str | None, model: Model) -> list[tuple[int, int, float, float]]:
    """Every significant passage: first token, token after the last, score, expected number."""
    return judged(text, model)[1]


def best_log_e(text: str | None, model: Model) -> float:
    """ln E of the best segment; infinite if no token has a positive weight."""
    words = tokens(text)
    top = max((x for *_, x in segments(weighted_steps(words, model))), default=0.0)
    return math.log(model.k * max(len(words), 1)) - model.lam * top if top > 0 else math.inf


def aggregated(scores: list[float], n: int, model: Model) -> float:
    """The least ln E_r over the r best segment scores of a text of n tokens (infinite without any)."""
    best, total = math.inf, 0.0
    base = math.log(model.k * max(n, 1))
    for r, x in enumerate(sorted(scores, reverse=True), 1):
        total += model.lam * x - base
        if r == 1:
            best = -total
        elif total <= r * (r - 1):  # the law holds for large sums alone
            break
        else:
            e = (r - 1) * math.log(total) - total - math.lgamma(r + 1) - math.lgamma(r) + (r - 1) * math.log(2)
            best = min(best, e)
    return best


def judged(text: str | None, model: Model) -> tuple[float, list[tuple[int, int, float, float]]]:
    """ln E of all segments together, and the significant passages."""
    words = tokens(text)
    found = segments(weighted_steps(words, model))
    each = [(s, e, x, model.expected(x, len(words))) for s, e, x in found]
    return aggregated([x for *_, x in found], len(words), model), [p for p in each if p[3] <= E_MAX]


def probability(log_e: float, model: Model) -> float:
    if log_e == math.inf:
        return 0.0
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, model.bias - model.slope * log_e))))


def score(text: str | None, model: Model) -> float:
    return probability(judged(text, model)[0], model)


def _keys(token: str) -> list[str]:
    return [token, *(f"{token[:n]}*" for n in STEMS if len(token) > n)]


#: Tokens and stems counted before they are handed on, which bounds the memory of a task.
COUNTED = 100_000


def _counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """token, n0, n1, d: partial counts of tokens and stems, by class, and of the documents that hold them."""
    n, docs = (Counter(), Counter()), Counter()

    def made() -> pd.DataFrame:
        keys = list(docs)
        out = pd.DataFrame({"token": keys, "n0": [n[0][k] for k in keys], "n1": [n[1][k] for k in keys], "d": [docs[k] for k in keys]})
        for c in (*n, docs):
            c.clear()
        return out

    resident("toxicity", object)
    for b in batches:
        for text, y in zip(b["text"], b["y"], strict=True):
            held = Counter()
            for w, c in Counter(tokens(text)).items():
                for k in _keys(w):
                    held[k] += c
            n[int(y)].update(held)
            docs.update(held.keys())
            if len(docs) >= COUNTED:
                yield made()
    if docs:
        yield made()


def _solve(weights: np.ndarray, mass: np.ndarray) -> float:
    """The positive L with sum mass * e^(L * weight) = 1 (1 where there is none)."""
    if not (weights > 0).any() or (weights * mass).sum() >= 0:
        return 1.0
    low, high = 1e-3, 1.0
    f = lambda x: (mass * np.exp(np.minimum(x * weights, 600))).sum() - 1
    while f(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column) -> Model:
    sample, sizes = labelled_sample(labels, label, learn, FIT_ROWS)
    if not (sizes.get(0) and sizes.get(1)):
        return Model(Weights({}), -1.0, 1.0, 1.0)
    texts = written(sampled_texts(docs, sample), "toxicity_sample")
    calibrates = F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(4)) == 0
    counts = (
        texts.filter(~calibrates)
        .mapInPandas(_counts, "token string, n0 long, n1 long, d long")
        .groupBy("token")
        .agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "d")))
    )
    t0, t1 = (x or 0 for x in counts.filter("token not like '%*'").agg(F.sum("n0"), F.sum("n1")).first())
    if not (t0 and t1):
        return Model(Weights({}), -1.0, 1.0, 1.0)
    prior = F.lit(PRIOR) * (F.col("n0") + F.col("n1")) / F.lit(float(t0 + t1)) + F.lit(FLOOR)
    a1, a0 = F.col("n1") + prior, F.col("n0") + prior
    odds = F.log(a1 / (t1 + PRIOR + FLOOR - a1)) - F.log(a0 / (t0 + PRIOR + FLOOR - a0))
    kept = (
        counts.filter(F.col("d") >= MIN_DOCS)
        .select("token", "n0", "n1", odds.alias("odds"), (odds / F.sqrt(1 / a1 + 1 / a0)).alias("z"))
        .filter((F.abs("z") >= Z_MIN) & (F.abs("odds") >= MIN_ODDS))
        .collect()
    )
    kept.sort(key=lambda r: (-abs(r["z"]), r["token"]))
    weights = {r["token"]: r["odds"] for r in kept}
    # A stem's mass holds that of its tokens with weights of their own; stems first, the shortest first.
    mass0, mass1 = ({r["token"]: r[c] / t for r in kept} for c, t in (("n0", t0), ("n1", t1)))
    for k in sorted(weights, key=lambda k: (k.endswith("*"), len(k)), reverse=True):
        above = next((a for a in _keys(k.rstrip("*"))[1:] if a != k and a in weights and len(a) < len(k) + (not k.endswith("*"))), None)
        if above:
            mass0[above], mass1[above] = max(0, mass0[above] - mass0[k]), max(0, mass1[above] - mass1[k])
    rest0, rest1 = 1 - sum(mass0.values()), 1 - sum(mass1.values())
    other = min(-1e-3, math.log(max(rest1, 1e-9) / max(rest0, 1e-9)))
    mass = np.array([rest0, *(mass0[k] + 0.5 / t0 for k in weights)])
    lam = _solve(np.array([other, *weights.values()]), mass / mass.sum())
    draft = Model(Weights(weights), other, lam, 1.0)

    aside = texts.filter(calibrates)

    def extremes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            n = [max(len(tokens(t)), 1) for t in b["text"]]
            yield pd.DataFrame({"n": n, "e": [best_log_e(t, draft) for t in b["text"]]})

    # A few numbers for each row set aside, a quarter of FIT_ROWS at most.
    clean = aside.filter("y = 0").mapInPandas(extremes, "n long, e double").toPandas()
    chance = float(np.where(np.isinf(clean["e"]), clean["n"], np.exp(clean["e"].clip(upper=700))).sum())
    k = len(clean) / chance if chance > 0 else 1.0
    known = Model(Weights(weights), other, lam, k)

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"y": b["y"], "e": [judged(t, known)[0] for t in b["text"]]})

    held = aside.mapInPandas(sums, "y int, e double").toPandas()
    natural = {y: sizes[y] / max(1, (held["y"] == y).sum()) for y in (0, 1)}
    found = held[np.isfinite(held["e"])]
    bias, slope = _logistic(found["e"].to_numpy(), found["y"].to_numpy(), found["y"].map(natural).to_numpy(float))
    return Model(Weights(weights), other, lam, k, bias, slope)


def _logistic(e: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Bias and slope (at least 0.05) of a logistic regression on -ln E, by damped Newton steps."""
    x = np.stack([np.ones(len(e)), -np.clip(e, -40, 40)], axis=1)
    beta = np.array([-2.0, 1.0])
    weight = weight / weight.sum() * len(e) if len(e) else weight
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -35, 35)))
        g = x.T @ (weight * (y - p)) - 1e-2 * (beta - np.array([-2.0, 1.0]))
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        beta = beta + np.clip(np.linalg.solve(h, g), -1, 1)
    return float(beta[0]), max(0.05, float(beta[1]))


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted, passages, passage_tokens: one row for each row of ``docs``.

    passages: the number of significant passages; passage_tokens: the tokens in them.
    """
    model = fit(docs, labels, label, fold(F.col("doc_id"), parts) != held)

    def run(texts: list[str | None]) -> Iterator[tuple[int, int, list]]:
        made = [judged(t, model) for t in texts]
        s = np.array([probability(e, model) for e, _ in made], float)
        lengths = [sum(e - b for b, e, *_ in p) for _, p in made]
        yield 0, len(texts), [s, (s >= 0.5).astype(np.int32), [len(p) for _, p in made], lengths]

    added = {"score": "double", "predicted": "int", "passages": "long", "passage_tokens": "long"}
    return per_text(texts_of(docs, held_out(parts, held)), added, run)


def without_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 5, held: int = 0) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns."""
    model = fit(docs, labels, label, fold(F.col("doc_id"), parts) != held)

    @F.pandas_udf("boolean")
    def toxic(texts: pd.Series) -> pd.Series:
        resident("toxicity", object)
        return pd.Series([score(t, model) >= 0.5 for t in texts], dtype=bool)

    return docs.filter(~toxic(F.col("text").cast("string")))


def toxic_passages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, first_token, end_token, score, expected: every significant passage of every text."""

    def find(texts: list[str | None]) -> Iterator[tuple[int, int, list]]:
        for i, t in enumerate(texts):
            for p in passages(t, model):
                yield i, i + 1, [[x] for x in p]

    return per_text(texts_of(docs), {"first_token": "long", "end_token": "long", "score": "double", "expected": "double"}, find)
