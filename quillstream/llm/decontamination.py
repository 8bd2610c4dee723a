"""Benchmark decontamination by template canonicalisation.

Texts become templates: numbers, names (capitalised words inside a sentence) and units are
replaced by typed placeholders, other words are lower-cased. All windows of ``WINDOW`` template
tokens are hashed; those without an ordinary word with their fillers as they are, as nothing
else tells them apart. Document windows join the
benchmark's on the hash (a hash is confirmed on the window's own words), and matches of one
document and item with the same offset between them form an alignment. An alignment counts
if its slots are consistent: equal fillers of the item are equal in the document and
different ones differ, so numbers may all be new but must follow one assignment. Windows of fewer
than ``LITERALS`` ordinary words (the sparse ones) count where their fillers are the item's own, or
where all windows of the item that hold an ordinary word match in one consistent alignment. A pair is a
leak if the consistent alignments cover at least ``COVERAGE`` of the item's tokens or a run
of ``RUN`` tokens of it.

Documents are canonicalised whole, in one pass of Python that first tests windows against a
bitmap of the benchmark's hashes. The bitmap has ``FILTER_BITS`` bits whatever the
benchmark's size; a fuller bitmap only lets more windows reach the join. Neither side of the
join is broadcast by hand.

Items shorter than a window are one window of their length. Those of fewer than ``SHORTEST`` tokens
have too few words for a template: they match, token for token as written but for case, where the
document has them as a sentence or line of their own, or several.

Edge cases: null and empty texts have no windows, and items without a token match nothing;
repeated rows of a document count as one document, and rows without an id aren't judged; empty
tables give an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import resident, without_ids, written

WINDOW, LITERALS, SHORTEST = 8, 4, 5
COVERAGE, RUN = 0.6, 13
FILTER_BITS = 1 << 24

NUMBER, NAME, UNIT = "<number>", "<name>", "<unit:{}>"
#: Units by what they measure, and number words (fixed values).
UNITS = {
    "length": "mm cm m km meter meters metre metres kilometer kilometers kilometre kilometres inch inches foot feet yard yards mile miles",
    "mass": "mg g kg gram grams kilogram kilograms tonne tonnes ounce ounces pound pounds lb lbs",
    "time": "ms s sec secs second seconds min mins minute minutes h hr hrs hour hours day days week weeks month months year years",
    "volume": "ml l liter liters litre litres gallon gallons cup cups",
    "money": "$ € £ ¥ usd eur gbp dollar dollars euro euros cent cents pence",
    "speed": "mph kph",
    "share": "% percent",
}
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion"
)
_UNIT_OF = {word: UNIT.format(kind) for kind, words in UNITS.items() for word in words.split()}
_NUMBER_WORDS = frozenset(NUMBER_WORDS.split())
_TOKEN = re.compile(r"\d+(?:[.,:/]\d+)*|[^\W\d_]+(?:['’][^\W\d_]+)?|[$€£¥%]|[.!?\n]")
_ENDS = frozenset(".!?\n")
_MULTIPLIERS = tuple(np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) | 1) for k in range(WINDOW))


def _code(word: str) -> int:
    return int.from_bytes(blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Canonicaliser:
    """Template tokens of a text with their codes; remembers the codes of tokens."""

    MEMO = 1 << 17
    PLAIN, CAPITAL, STOP = 1, 2, 4

    def __init__(self) -> None:
        self.place: dict[str, int] = {}
        self.codes = np.zeros(self.MEMO, np.uint64)
        self.flags = np.zeros(self.MEMO, np.uint8)
        self.name = np.uint64(_code(NAME))

    def _add(self, token: str) -> int:
        at = self.place[token] = len(self.place)
        low = token.lower()
        template = _UNIT_OF.get(low) or (NUMBER if token[0].isdigit() or low in _NUMBER_WORDS else low)
        self.codes[at] = _code(template)
        capital = token[0].isupper() and not token.isupper()
        self.flags[at] = self.STOP if token in _ENDS else self.PLAIN * (template == low) + self.CAPITAL * capital
        return at

    def _of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes, flags = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
        for i in range(0, len(tokens), self.MEMO // 2):
            some = tokens[i : i + self.MEMO // 2]
            if len(self.place) + len(some) > self.MEMO:
                self.place.clear()
            get, add = self.place.get, self._add
            at = np.fromiter((k if (k := get(t)) is not None else add(t) for t in some), np.int64, len(some))
            codes.append(self.codes[at])
            flags.append(self.flags[at])
        return np.concatenate(codes), np.concatenate(flags)

    def __call__(self, text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All tokens, the places of words among them, template codes, flags of ordinary words and of
        words that open and that close a sentence (1, 2)."""
        tokens = _TOKEN.findall(text or "")
        codes, flags = self._of(tokens)
        words = np.flatnonzero(flags != self.STOP)
        stops = np.r_[True, flags == self.STOP, True]
        opens, closes = stops[:-2][words], stops[2:][words]
        codes, flags = codes[words], flags[words]
        plain = (flags & self.PLAIN) > 0
        name = plain & ~opens & ((flags & self.CAPITAL) > 0)
        codes[name] = self.name
        return tokens, words, codes, plain & ~name, opens + 2 * closes.astype(np.int8)


def canonicaliser() -> Canonicaliser:
    """One for each worker process, so that its memory of tokens lasts over tasks."""
    return resident("canonicaliser", Canonicaliser)


def window_hashes(codes: np.ndarray, plain: np.ndarray, size: int, exact: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of ``size`` tokens; ``exact`` gives the codes of tokens as written."""
    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = _hashed(codes, np.arange(n), size)
    words = np.r_[0, np.cumsum(plain)]
    bare = np.flatnonzero(words[size:] == words[:n])
    if len(bare):
        own = np.zeros(len(codes), bool)
        for k in range(size):
            own[bare + k] = True
        own = np.flatnonzero(own)
        written = codes.copy()
        written[own] = exact(own)
        h[bare] = _hashed(written, bare, size)
    return np.arange(n), h.view(np.int64)


def sentence_hashes(edges: np.ndarray, size: int, exact: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes, as written, of the windows of ``size`` tokens that are whole sentences."""
    n = max(0, len(edges) - size + 1)
    at = np.flatnonzero((edges[:n] & 1 > 0) & (edges[len(edges) - n :] & 2 > 0))
    own = np.unique((at[:, None] + np.arange(size)).ravel())
    written = np.zeros(len(edges), np.uint64)
    written[own] = exact(own)
    return at, (_hashed(written, at, size) ^ np.uint64(0x5E17E7CE)).view(np.int64)


def _hashed(codes: np.ndarray, starts: np.ndarray, size: int) -> np.ndarray:
    h = np.full(len(starts), size, np.uint64)
    for k in range(size):
        h ^= (codes[starts + k] + np.uint64(k)) * _MULTIPLIERS[k]
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h


def _windows(codes: np.ndarray, plain: np.ndarray, edges: np.ndarray, size: int, exact: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return sentence_hashes(edges, size, exact) if size < SHORTEST else window_hashes(codes, plain, size, exact)


_code_of = lru_cache(maxsize=1 << 16)(_code)


def _exact(tokens: list[str], words: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    return lambda at: np.array([_code_of(tokens[k].lower()) for k in words[at]], np.uint64)


def _surface(tokens: list[str], words: np.ndarray, plain: np.ndarray, at: int, size: int) -> list[str]:
    """The window's surface forms: fillers as written, ordinary words in lower case."""
    return [tokens[k].lower() if p else tokens[k] for k, p in zip(words[at : at + size], plain[at : at + size], strict=True)]


def benchmark_windows(benchmark: DataFrame) -> DataFrame:
    """hash, item_id, place, size, item_tokens, item_words, item_plain of every window of the benchmark, the
    number of its ordinary words, and of the item's windows that hold one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon = canonicaliser()
        for b in batches:
            rows = []
            for item, text in zip(b["item_id"], b["text"], strict=True):
                tokens, words, codes, plain, edges = canon(text)
                if len(words):
                    size = min(WINDOW, len(words))
                    held = np.r_[0, np.cumsum(plain)]
                    literals = held[size:] - held[: len(words) - size + 1]
                    anchored = int((literals > 0).sum())
                    for at, h in zip(*_windows(codes, plain, edges, size, _exact(tokens, words)), strict=True):
                        rows.append((h, item, at, size, len(words), _surface(tokens, words, plain, at, size), plain[at : at + size].tolist(), int(literals[at]), anchored))
            yield pd.DataFrame(rows, columns=["hash", "item_id", "place", "size", "item_tokens", "item_words", "item_plain", "literals", "anchored"])

    schema = "hash long, item_id long, place int, size int, item_tokens int, item_words array<string>, item_plain array<boolean>, literals int, anchored int"
    ids = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return ids.filter("item_id is not null").dropDuplicates().mapInPandas(run, schema)


def _bitmap(windows: DataFrame) -> tuple[bytes, list[int]]:
    """FILTER_BITS bits: those that the hashes of windows fall on; the sizes of windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"byte": (b["hash"].to_numpy(np.int64) & (FILTER_BITS - 1)) >> 3, "bit": 1 << (b["hash"].to_numpy(np.int64) & 7)})

    held = windows.select("hash").mapInPandas(run, "byte long, bit long").groupBy("byte").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    out[held["byte"].to_numpy(np.int64)] = held["bits"].to_numpy(np.int64)
    return out.tobytes(), sorted(r["size"] for r in windows.select("size").distinct().collect())


def document_windows(docs: DataFrame, bitmap: bytes, sizes: list[int]) -> DataFrame:
    """hash, doc_id, at, doc_words of the windows that the bitmap lets through."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        canon, bits = canonicaliser(), np.frombuffer(shared.value, np.uint8)
        for b in batches:
            rows = []
            for doc, text in zip(b["doc_id"], b["text"], strict=True):
                tokens, words, codes, plain, edges = canon(text)
                for size in sizes:
                    at, h = _windows(codes, plain, edges, size, _exact(tokens, words))
                    slot = h & (FILTER_BITS - 1)
                    hit = np.flatnonzero((bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1)
                    rows += [(h[k], doc, at[k], _surface(tokens, words, plain, at[k], size)) for k in hit]
            yield pd.DataFrame(rows, columns=["hash", "doc_id", "at", "doc_words"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ids.filter("doc_id is not null").mapInPandas(run, "hash long, doc_id long, at int, doc_words array<string>")


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, windows, covered_tokens, item_tokens, coverage, longest_run of every leak."""
    items = written(benchmark_windows(benchmark), "benchmark_windows")
    bitmap, sizes = _bitmap(items)
    found = document_windows(docs, bitmap, sizes).join(items, "hash")
    # Ordinary words must be the same, which also rejects collisions of the hash.
    same = F.expr("forall(sequence(0, size - 1), i -> not item_plain[i] or item_words[i] = doc_words[i])")
    fillers = F.expr(
        "transform(filter(sequence(0, size - 1), i -> not item_plain[i]), "
        "i -> struct(lower(item_words[i]) as a, lower(doc_words[i]) as b))"
    )
    exact = F.expr("forall(sequence(0, size - 1), i -> lower(item_words[i]) = lower(doc_words[i]))")
    matched = found.filter("size(doc_words) = size").filter(same).withColumns({"exact": exact, "slots": fillers})
    place, dense = F.struct("place", "size"), F.col("literals") >= F.least(F.lit(LITERALS), F.col("size") - 1)

    def collected(kind: str, which: Column) -> list[Column]:
        """Windows of a kind in an alignment, and their slots."""
        return [
            F.collect_set(F.when(which, place)).alias(f"{kind}_places"),
            F.array_distinct(F.flatten(F.collect_set(F.when(which, F.col("slots"))))).alias(f"{kind}_slots"),
        ]

    anchored = F.col("literals") > 0
    aligned = matched.filter(F.col("exact") | anchored & (F.col("size") >= SHORTEST)).groupBy("doc_id", "item_id", (F.col("at") - F.col("place")).alias("shift")).agg(
        *collected("dense", dense), *collected("sure", dense | F.col("exact")), *collected("exact", F.col("exact")), *collected("all", F.lit(True)),
        F.count_distinct(F.when(anchored, F.col("place"))).alias("found"), F.max("anchored").alias("anchored"), F.max("item_tokens").alias("item_tokens"),
    )

    def consistent(kind: str) -> Column:
        slots = f"{kind}_slots"
        return F.expr(f"size({slots}) = size(array_distinct(transform({slots}, s -> s.a))) and size({slots}) = size(array_distinct(transform({slots}, s -> s.b)))")

    nothing = F.expr("array() :: array<struct<place: int, size: int>>")
    counted = F.concat(
        *(F.when(consistent("dense") & consistent(k), F.col(f"{k}_places")).otherwise(nothing) for k in ("dense", "sure", "exact")),
        F.when(consistent("all") & (F.col("anchored") > 0) & (F.col("found") == F.col("anchored")), F.col("all_places")).otherwise(nothing),
    )
    pairs = aligned.withColumn("places", F.array_distinct(counted)).filter("size(places) > 0").groupBy("doc_id", "item_id").agg(
        F.array_distinct(F.flatten(F.collect_set("places"))).alias("places"), F.max("item_tokens").alias("item_tokens")
    )
    covered = F.expr("array_sort(array_distinct(flatten(transform(places, p -> sequence(p.place, p.place + p.size - 1)))))")
    run = F.expr(
        "aggregate(covered, named_struct('last', -2, 'run', 0, 'best', 0), (s, x) -> named_struct('last', x, "
        "'run', if(x = s.last + 1, s.run + 1, 1), 'best', greatest(s.best, if(x = s.last + 1, s.run + 1, 1))), s -> s.best)"
    )
    measured = pairs.withColumn("covered", covered).select(
        "doc_id",
        "item_id",
        F.size("places").cast("long").alias("windows"),
        F.size("covered").cast("long").alias("covered_tokens"),
        F.col("item_tokens").cast("long").alias("item_tokens"),
        (F.size("covered") / F.col("item_tokens")).alias("coverage"),
        run.cast("long").alias("longest_run"),
    )
    return measured.filter((F.col("coverage") >= COVERAGE) | (F.col("longest_run") >= RUN))


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without a leak."""
    return without_ids(docs, leaks(docs, benchmark))
