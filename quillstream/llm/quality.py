"""Quality classifier: logistic regression over hashed word n-grams, fitted by FTRL.

Every white-space separated word gives two tokens: the word in lower case without outer
punctuation, and its shape (letter runs as ``A`` or ``a``, digit runs as ``0``, other
characters as they are, runs cut to three). Features are hashed uni- and bigrams of the words and uni-, bi- and
trigrams of the shapes, plus one for a word that repeats its predecessor; a document's
vector holds log(1 + count), scaled to length 1. Fitting follows the regularised leader
(FTRL-Proximal, per-coordinate rates, L1 and L2) over at most ``FIT_ROWS`` labelled rows, whose
sparse vectors (at most ``DIMENSIONS`` entries each, made where the texts are) meet in one task that
returns the non-zero weights (at most ``DIMENSIONS``). Scoring is a sparse dot
product per document over its whole text.

Edge cases: null and empty texts have only the bias; without labelled rows of both classes
the score is the share of good labels (0.5 without any label); an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, held_out, per_text, resident, texts_of
from .sampling import labelled_sample, sampled_texts

#: Bound on the labelled rows to fit on, half of it for either class.
FIT_ROWS = 8_000
DIMENSIONS = 1 << 18
ALPHA, BETA, L1, L2, EPOCHS = 0.2, 1.0, 0.02, 0.5, 3

_DIGIT = re.compile(r"\d+")
_RUN = re.compile(r"([^\w\s])\1{3,}")
_EDGES = re.compile(r"^\W+|\W+$")


def _shape(word: str) -> str:
    word = _RUN.sub(r"\1\1\1", word)
    word = re.sub(r"[^\W\d_]+", lambda m: "A" if m[0].isupper() and len(m[0]) > 1 else "Aa" if m[0][0].isupper() else "a", word)
    return _DIGIT.sub("0", word)


class Features:
    """Hashed features of a text; remembers the hashes of words it has seen."""

    MEMO = 1 << 19

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.hashes = np.zeros((2, self.MEMO), np.uint64)

    def _add(self, word: str) -> int:
        at = self.place[word] = len(self.place)
        bare = _EDGES.sub("", word).lower()
        self.hashes[0, at] = crc32(b"w" + bare.encode("utf-8", "surrogatepass"))
        self.hashes[1, at] = crc32(b"s" + _shape(word).encode("utf-8", "surrogatepass"))
        return at

    def _of(self, words: list[str]) -> np.ndarray:
        """Word and shape hashes, in parts that the memory can hold."""
        parts = []
        for i in range(0, len(words), self.MEMO // 2):
            some = words[i : i + self.MEMO // 2]
            if len(self.place) + len(some) > self.MEMO:
                self.place.clear()
            get, add = self.place.get, self._add
            at = np.fromiter((k if (k := get(w)) is not None else add(w) for w in some), np.int64, len(some))
            parts.append(self.hashes[:, at])
        return np.concatenate(parts, axis=1)

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Sorted feature numbers and their values."""
        words = text.split() if text else []
        if not words:
            return np.zeros(0, np.int64), np.zeros(0)
        w, s = self._of(words)
        m1, m2, m3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
        again = np.uint64(0xABCDEF)
        parts = [w * m1, s * m1, w[:-1] * m1 + w[1:] * m2, s[:-1] * m1 + s[1:] * m2]
        parts += [s[:-2] * m1 + s[1:-1] * m2 + s[2:] * m3, np.full(int((w[1:] == w[:-1]).sum()), again)]
        h = np.concatenate(parts)
        h ^= h >> np.uint64(29)
        index = ((h * m2) >> np.uint64(64 - DIMENSIONS.bit_length() + 1)).astype(np.int64)
        index.sort()
        first = np.flatnonzero(np.r_[True, index[1:] != index[:-1]])
        value = np.log1p(np.diff(np.r_[first, len(index)]))
        return index[first], value / math.sqrt(float(value @ value))


def features() -> Features:
    """One for each worker process, so that its memory of words lasts over tasks."""
    return resident("features", Features)


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> tuple[np.ndarray, float]:
    """Weights and bias after ``EPOCHS`` passes of FTRL-Proximal updates."""
    z, n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)
    zb = nb = 0.0

    def bias() -> float:
        return -zb / ((BETA + math.sqrt(nb)) / ALPHA)

    for _ in range(EPOCHS):
        for index, value, y in rows:
            zi, ni = z[index], n[index]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= L1, 0.0, -(zi - np.sign(zi) * L1) / ((BETA + root) / ALPHA + L2))
            b = bias()
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ value) + b))))
            g = (p - y) * value
            z[index] = zi + g - (np.sqrt(ni + g * g) - root) / ALPHA * w
            n[index] = ni + g * g
            gb = p - y
            zb += gb - (math.sqrt(nb + gb * gb) - math.sqrt(nb)) / ALPHA * b
            nb += gb * gb
    w = np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))
    return w, bias()


def _sparse(texts: list[str | None]) -> Iterator[tuple[int, int, list]]:
    of = features()
    for at, text in enumerate(texts):
        index, value = of(text)
        yield at, at + 1, [[index.astype("<u4").tobytes()], [value.astype("<f4").tobytes()]]


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    rows = []
    for b in batches:
        vectors = ((np.frombuffer(i, "<u4").astype(np.int64), np.frombuffer(v, "<f4").astype(float)) for i, v in zip(b["i"], b["v"], strict=True))
        rows += [(int(d), *x, int(y)) for d, y, x in zip(b["doc_id"], b["y"], vectors, strict=True)]
    rows.sort(key=lambda r: (crc32(str(r[0]).encode()), r[0], r[3], r[1].tobytes()))
    w, b = fit_ftrl([r[1:] for r in rows])
    index = np.flatnonzero(w)
    yield pd.DataFrame({"i": [-1, *index.tolist()], "w": [b, *w[index].tolist()]})


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column) -> tuple[np.ndarray, np.ndarray, float]:
    """Feature numbers, their weights and the bias, at the natural share of the classes."""
    sample, sizes = labelled_sample(labels, label, learn, FIT_ROWS)
    none = np.zeros(0, np.int64), np.zeros(0)
    if not (sizes.get(0) and sizes.get(1)):
        share = (sizes.get(1, 0) + 1) / (sum(sizes.values()) + 2) if sizes else 0.5
        return *none, math.log(share / (1 - share))
    half = FIT_ROWS // 2
    shift = math.log(sizes[1] / min(half, sizes[1])) - math.log(sizes[0] / min(half, sizes[0]))
    vectors = per_text(sampled_texts(docs, sample).select("doc_id", "y", "text"), {"i": "binary", "v": "binary"}, _sparse)
    rows = vectors.repartition(1).mapInPandas(_fit, "i long, w double").collect()
    bias = next((r["w"] for r in rows if r["i"] < 0), 0.0) + shift
    rows = [r for r in rows if r["i"] >= 0]
    return np.array([r["i"] for r in rows], np.int64), np.array([r["w"] for r in rows]), bias


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", parts: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted: one row for each row of ``docs``."""
    index, weight, bias = fit(docs, labels, label, fold(F.col("doc_id"), parts) != held)

    def score(texts: list[str | None]) -> Iterator[tuple[int, int, list]]:
        of, w = features(), np.zeros(DIMENSIONS)
        w[index] = weight
        s = np.empty(len(texts))
        for k, text in enumerate(texts):
            i, v = of(text)
            s[k] = w[i] @ v + bias
        p = 1 / (1 + np.exp(-np.clip(s, -35, 35)))
        yield 0, len(texts), [p, (p >= 0.5).astype(np.int32)]

    return per_text(texts_of(docs, held_out(parts, held)), {"score": "double", "predicted": "int"}, score)
