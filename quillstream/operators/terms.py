"""Terminology: candidates from n-grams, longest matches of a glossary, violations."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import term_key

#: Words that no term holds (fixed values).
STOP = (
    "a an the this that these those is are was were be been being of to in on at by for from with without and or but as into than then it "
    "its their our your we they he she which who what when where how not no used using use same must should can could would may might will "
    "shall each all both only also some other such have has had do does did"
).split()
#: Texts whose terms are handed on at once.
TEXTS = 256
#: Up to so many repeated keys are broadcast; beyond it the texts are joined by shuffle.
BROADCAST_KEYS = 1_000_000


_CUT = re.compile(r"(?<![A-Za-z])-|-(?![A-Za-z])|[^A-Za-z \t-]")
_STOPPED = frozenset(STOP)


def counted_terms(text: str | None, longest: int = 4) -> dict[str, list]:
    """By lower-cased n-gram: count and the spelling first seen, in the order of the text."""
    out: dict[str, list] = {}
    # Anything but letters, inner hyphens and blanks ends a run, as stop words do.
    for run in _CUT.sub("\n", text or "").split("\n"):
        words = run.split()
        low, start = [w.lower() for w in words], 0
        for end in [*(i for i, w in enumerate(low) if w in _STOPPED), len(low)]:
            for i in range(start, end):
                k = w = ""
                for j in range(i, min(i + longest, end)):
                    if j > i:
                        k, w = f"{k} {low[j]}", f"{w} {words[j]}"
                    else:
                        k, w = low[j], words[j]
                        if len(w) < 4 and w.upper() != w:
                            continue
                    if k in out:
                        out[k][0] += 1
                    else:
                        out[k] = [1, w]
            start = end + 1
    return out


def best_terms(found: dict[str, list], limit: int) -> list[str]:
    """The keys of the first ``limit`` terms: repeated ones, then of several words, then by count, words and name."""
    size = lambda k: k.count(" ") + 1
    out = sorted((k for k, x in found.items() if x[0] > 1), key=lambda k: (" " not in k, -found[k][0], -size(k), k))
    if len(out) < limit:
        # Of those seen once, the ones of most words come first.
        once: dict[int, list[str]] = {}
        for k, x in found.items():
            if x[0] == 1:
                once.setdefault(size(k), []).append(k)
        for n in sorted(once, reverse=True):
            out += sorted(once[n])
            if len(out) >= limit:
                break
    return out[:limit]


def candidates(df: DataFrame, key: str, text: str, limit: int = 100, longest: int = 4) -> DataFrame:
    """key, rank, term, n: the best n-grams of each text that no stop word or punctuation breaks.

    Order: repeated ones, then of several words, then by count, words and name. Spelling as
    first seen. All windows are within a text, and one pass over it gives its terms where it is; counts of texts
    whose key repeats, null keys too, are added up.
    """
    rows = df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    repeated = rows.groupBy("key").agg(F.count("*").alias("rows")).filter("rows > 1").select(F.col("key").alias("again"))
    same = F.col("key").eqNullSafe(F.col("again"))
    kind = rows.schema["key"].dataType.simpleString()

    def of_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, len(b), TEXTS):
                at, rank, term, n = [], [], [], []
                for i, t in enumerate(b.column("text").slice(start, TEXTS).to_pylist()):
                    found = counted_terms(t, longest)
                    best = best_terms(found, limit)
                    at += [start + i] * len(best)
                    rank += range(1, len(best) + 1)
                    term += [found[k][1] for k in best]
                    n += [found[k][0] for k in best]
                columns = [b.column("key").take(pa.array(at, pa.int64())), pa.array(rank, pa.int32()), pa.array(term, pa.string()), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "rank", "term", "n"])

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, t in enumerate(b.column("text").to_pylist()):
                found = counted_terms(t, longest)
                columns = [b.column("key").take(pa.array([i] * len(found), pa.int64())), pa.array(found, pa.string())]
                columns += [pa.array([x[0] for x in found.values()], pa.int64()), pa.array(range(len(found)), pa.int64()), pa.array([x[1] for x in found.values()], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "k", "n", "pos", "term"])

    first = f"key {kind}, rank int, term string, n long"
    few = repeated.limit(BROADCAST_KEYS + 1).count()
    if not few:
        return rows.mapInArrow(of_text, first).withColumnRenamed("key", key)
    repeated = F.broadcast(repeated) if few <= BROADCAST_KEYS else repeated
    own = rows.join(repeated, same, "left_anti").mapInArrow(of_text, first)
    counted = rows.join(repeated, same, "left_semi").mapInArrow(parts, f"key {kind}, k string, n long, pos long, term string")
    counted = counted.groupBy("key", "k").agg(F.sum("n").alias("n"), F.min_by("term", F.struct("pos", "term")).alias("term"))
    words = F.size(F.split("k", " "))
    order = [F.desc(F.col("n") > 1), F.desc(words > 1), F.desc("n"), F.desc(words), "k"]
    ranked = counted.withColumn("rank", F.row_number().over(Window.partitionBy("key").orderBy(*order))).filter(F.col("rank") <= limit)
    return own.unionByName(ranked.select("key", "rank", "term", "n")).withColumnRenamed("key", key)


def longest_matches(df: DataFrame, glossary: DataFrame, key: str, text: str) -> DataFrame:
    """key, pos, words, source, target: terms of the glossary, left to right, the longest first, without overlap.

    The n-grams of a text, of the lengths that terms have, meet the glossary by equality; the greedy
    choice is one pass over the few matches of a text. glossary: source, target, of any length.
    """
    token = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
    phrase = F.regexp_extract_all(F.lower("source"), F.lit(token), F.lit(0))
    terms = glossary.select(phrase.alias("phrase"), term_key(F.col("source")).alias("source"), "target").filter(F.size("phrase") > 0)
    terms = terms.select(F.size("phrase").alias("n"), F.array_join("phrase", " ").alias("phrase"), "source", "target")
    terms = terms.groupBy("phrase").agg(F.first("n").alias("n"), F.min_by(F.struct("source", "target"), F.struct("source", "target")).alias("t")).select("phrase", "n", "t.*")
    # A few numbers: the lengths of terms.
    lengths = sorted(r["n"] for r in terms.select("n").distinct().collect())
    words = df.select(key, F.regexp_extract_all(F.lower(text), F.lit(token), F.lit(0)).alias("w"))
    none = F.array().cast("array<int>")

    def grams_of(n: int) -> Column:
        places = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(none)
        return F.transform(places, lambda i: F.struct(i.alias("pos"), F.lit(n).alias("words"), F.array_join(F.slice("w", i, n), " ").alias("phrase")))

    grams = words.select(key, F.explode(F.flatten(F.array(*map(grams_of, lengths or [1])))).alias("g")).select(key, "g.*")
    item = F.struct("pos", (-F.col("words")).alias("less"), "words", "source", "target")
    found = grams.join(terms.select("phrase", "source", "target"), "phrase").groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("m"))

    @F.pandas_udf("array<boolean>")
    def free(pos: pd.Series, size: pd.Series) -> pd.Series:
        out = []
        for places, sizes in zip(pos, size, strict=True):
            end, kept = 0, []
            for p, n in zip(places, sizes, strict=True):
                kept.append(bool(p > end))
                end = p + n - 1 if p > end else end
            out.append(kept)
        return pd.Series(out, dtype=object)

    judged = found.select(key, "m", free("m.pos", "m.words").alias("free"))
    chosen = judged.select(key, F.explode(F.arrays_zip("m", "free")).alias("x")).filter("x.free").select(key, "x.m.*")
    return chosen.select(key, "pos", "words", "source", "target")


def violations(df: DataFrame, glossary: DataFrame, key: str, source: str, target: str) -> DataFrame:
    """key, term, wanted: matched terms whose set translation isn't in the target."""
    used = longest_matches(df, glossary, key, source).select(key, "source", F.col("target").alias("wanted")).distinct()
    texts = df.select(key, F.lower(target).alias("_t"))
    return used.join(texts, key).filter(~F.col("_t").contains(F.lower("wanted"))).select(key, F.col("source").alias("term"), "wanted")


def within_budget(snippets: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """The first snippets of each key that fit the budget together."""
    total = F.sum(size).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return snippets.withColumn("_total", total).filter(F.col("_total") <= budget).drop("_total")
