"""Language identification by a string kernel.

The kernel is the blended-spectrum presence kernel: texts are sets of character n-grams of
``ORDERS`` letters, k(s, t) = |S and T| / sqrt(|S| |T|), with n-grams hashed into
``DIMENSIONS`` presence bits. ``LANDMARKS`` training texts stand for the kernel matrix
(Nystroem); one-versus-rest ridge regression on -1/+1 targets gives one weight for each
landmark and language. Scoring multiplies a block of presence rows with the landmark matrix
and the result with the weights: two matrix products for each block of ``BLOCK`` texts.

The classifier is fitted on at most ``FIT_ROWS`` labelled rows, as many for each language;
each comes to the driver as its ``DIMENSIONS`` / 8 bytes of presence bits (10 MB in all; rows that
repeat an id and a language count once). All texts are scored whole.

Edge cases: a text that is null or has no letter is ``und`` with score 0; without training
rows all are; rows without lang don't train; ties go to the language that sorts first;
further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, held_out, per_text, texts_of

FIT_ROWS, LANDMARKS = 2_400, 192
ORDERS = (1, 2, 3)
DIMENSIONS = 1 << 15
RIDGE = 0.05
#: Sharpness of the softmax that turns regression outputs into a score.
SHARPNESS = 6.0
BLOCK = 128
UNDETERMINED = "und"

_LETTER = re.compile(r"[^\W\d_]")
_SPACES = re.compile(r"[\W\d_]+")


def presence(text: str) -> np.ndarray:
    """DIMENSIONS flags: hashed character n-grams of the letters, with one space between words."""
    out = np.zeros(DIMENSIONS, bool)
    part = " " + _SPACES.sub(" ", text.lower()).strip() + " "
    c = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32)
    h = np.zeros(len(c), np.uint32)
    for n in range(1, max(ORDERS) + 1):
        h = (h[: len(c) - n + 1] * np.uint32(0x01000193)) ^ (c[n - 1 :] * np.uint32(0x9E3779B1))
        if n in ORDERS:
            mixed = h ^ (h >> np.uint32(15))
            out[(mixed * np.uint32(0x85EBCA6B)) >> np.uint32(32 - DIMENSIONS.bit_length() + 1)] = True
    return out


def has_letter(text: str | None) -> bool:
    return bool(text) and _LETTER.search(text) is not None


def _packed(texts: list[str | None]) -> Iterator[tuple[int, int, list]]:
    for i, t in enumerate(texts):
        if has_letter(t):
            yield i, i + 1, [[np.packbits(presence(t)).tobytes()]]


def training_rows(docs: DataFrame, learn: Column, fit_rows: int = FIT_ROWS) -> list:
    """At most ``fit_rows`` rows (doc_id, lang, bits), as many for each language, by a hash of the id."""
    known = docs.select("doc_id", "text", "lang").filter(learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.approx_count_distinct("doc_id", 0.02).alias("n")).collect() if r["n"]}
    if not sizes:
        return []
    each = max(2, fit_rows // len(sizes))
    order = F.xxhash64(F.lit(17), "doc_id")
    # A share that gives twice the ids wanted, by a sketch of their number; of them exactly the first `each` are taken.
    share = F.coalesce(*(F.when(F.col("lang") == k, F.lit(min(1.0, 2 * each / n + 20 / n))) for k, n in sizes.items()))
    near = known.filter(F.pmod(order, F.lit(1 << 30)) < share * F.lit(float(1 << 30)))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(order, "doc_id"))
    ids = near.select("doc_id", "lang", first.alias("k")).filter(F.col("k") <= each).select("doc_id", "lang")
    chosen = known.join(F.broadcast(ids.distinct()), ["doc_id", "lang"])
    packed = per_text(texts_of(chosen, F.col("lang").cast("string").alias("lang")), {"bits": "binary"}, _packed)
    rows = packed.groupBy("doc_id", "lang").agg(F.min("bits").alias("bits"))
    return sorted(rows.collect(), key=lambda r: (r["lang"], r["doc_id"]))


class Kernel:
    """Landmarks and weights of a fitted classifier."""

    def __init__(self, rows: list) -> None:
        self.langs = sorted({r["lang"] for r in rows})
        each = max(1, LANDMARKS // max(1, len(self.langs)))
        marks = [b for k in self.langs for b in [r["bits"] for r in rows if r["lang"] == k][:each]]
        self.bits = np.frombuffer(b"".join(marks), np.uint8).reshape(len(marks), DIMENSIONS // 8)
        self.load()
        if not marks:
            self.weights = np.zeros((0, 0))
            return
        x = np.unpackbits(np.frombuffer(b"".join(r["bits"] for r in rows), np.uint8).reshape(len(rows), -1), axis=1)
        k_nm = np.concatenate([self.kernel(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)]).astype(float)
        k_mm = self.kernel(np.unpackbits(self.bits, axis=1)).astype(float)
        y = np.array([[1.0 if r["lang"] == k else -1.0 for k in self.langs] for r in rows])
        left = k_nm.T @ k_nm + RIDGE * k_mm + 1e-6 * np.eye(len(marks))
        self.weights = np.linalg.solve(left, k_nm.T @ y)

    def load(self) -> None:
        self.matrix = np.unpackbits(self.bits, axis=1).astype(np.float32).T.copy() if len(self.bits) else np.zeros((DIMENSIONS, 0), np.float32)
        self.norms = np.sqrt(np.maximum(self.matrix.sum(axis=0), 1))

    def __getstate__(self) -> dict:
        return {"langs": self.langs, "bits": self.bits, "weights": self.weights}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self.load()

    def kernel(self, x: np.ndarray) -> np.ndarray:
        """Kernel values of presence rows (0/1) against the landmarks."""
        own = np.sqrt(np.maximum(x.sum(axis=1, dtype=np.int64), 1)).astype(np.float32)
        return (x.astype(np.float32) @ self.matrix) / own[:, None] / self.norms

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        margin = self.kernel(x) @ self.weights
        top = margin.argmax(axis=1)
        e = np.exp(SHARPNESS * (margin - margin.max(axis=1, keepdims=True)))
        return top, 1 / e.sum(axis=1)


def language_predictions(docs: DataFrame, parts: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row for each row of ``docs``."""
    model = Kernel(training_rows(docs, fold(F.col("doc_id"), parts) != held))

    names = [*model.langs, UNDETERMINED]

    def classify(texts: list[str | None]) -> Iterator[tuple[int, int, list]]:
        for start in range(0, len(texts), BLOCK):
            part = texts[start : start + BLOCK]
            lang, score = np.full(len(part), len(names) - 1), np.zeros(len(part))
            known = np.array([i for i, t in enumerate(part) if model.langs and has_letter(t)], np.int64)
            if len(known):
                lang[known], score[known] = model.predict(np.stack([presence(part[i]) for i in known]))
            yield start, start + len(part), [[names[k] for k in lang], score]

    return per_text(texts_of(docs, held_out(parts, held)), {"lang_pred": "string", "score": "double"}, classify)
