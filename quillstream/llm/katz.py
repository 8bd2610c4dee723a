"""Language-model scoring: Katz backoff over trigrams with Good-Turing discounts, over all documents.

Model. Tokens are words in lower case (A-Z) and one end token after each text; end tokens also
stand before a text. With counts c over the training documents, evaluated recursively for each token,

    P(w | g h) = d3(c(g h w)) c(g h w) / c(g h)   if c(g h w) > 0,   else   alpha(g h) P(w | h)
    P(w | h)   = d2(c(h w)) c(h w) / c(h)         if c(h w) > 0,     else   alpha(h) P(w)

d is Katz's Good-Turing discount of its order for counts up to ``K`` (absolute discounting by ``ABSOLUTE``
where the counts of counts allow none; where a history has only larger counts, one more
occurrence in the denominator leaves mass for unseen words). alpha makes the sum over all
words exactly 1; that of a history never seen is 1. P(w) is the Good-Turing unigram; its free mass
goes to one unknown word. Base scores are additively smoothed unigrams.

Execution. Texts are read once, in blocks of about ``BLOCK_CHARS`` characters; a block keeps
its tokens as numbers into its own vocabulary. Counting and look-up share one shuffle
per step: every block sends its distinct n-grams with its own counts to the bucket that owns
them, the bucket adds up and answers each block in the order asked. What moves is thus distinct
n-grams per block, packed in compressed arrays, never tokens. Answers are tables in the shared folder;
the blocks are scored from them. Counts of counts are sums over buckets, a few numbers.

A trigram g h w belongs to the bucket of its middle word h, which so has all bigrams h w as sums of its
trigrams: bigrams need no messages of their own. The weights of a history depend on discounts that are known
only after all buckets have counted; so buckets answer whole numbers that determine them: for a
history its occurrences, how many followers have counts 1 to K, and of the followers' lower-order counts the
sum of the large ones and how many are 1 to K. These are sent for histories that back off.

The hottest words (more than 1/2**20 of the tokens and at least ``HOT_TOKENS``) would heat the bucket of a middle
word. Their bigrams are counted first, spread over all buckets, and their sums, at most 2**20 rows, go to all
tasks; their trigrams are dealt by both words of the history.

A row of a message is a block and a bucket. Both counts grow with the input, so there are at most as many
rows as distinct n-grams of blocks, and at the check tool's sizes a few thousand n-grams to a row.

Edge cases: a null text is empty and has the end token alone; rows without an id are scored
but not learned from; without training documents every token is unknown and has probability
1; repeated rows are learned and scored each; further columns are ignored.
"""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, written

#: Counts up to K are discounted.
K = 5
ABSOLUTE = 0.5
BLOCK_CHARS = 6_000_000
#: Tokens of the corpus for each bucket.
BUCKET_TOKENS = 1_000_000
HOT_TOKENS, HOT_SHARE = 200_000, 2.0**-20
#: Smoothing of the base score.
ADD = 0.1


# ---------------------------------------------------------------- the arithmetic


def discounts(of_counts: np.ndarray) -> np.ndarray:
    """d(0..K) for counts of counts n(0..K+1); d(r) = 1 above."""
    n = np.asarray(of_counts, float)
    out = np.ones(K + 1)
    for k in range(K, 0, -1):
        if (n[1 : k + 2] <= 0).any():
            continue
        common = (k + 1) * n[k + 1] / n[1]
        r = np.arange(1, k + 1)
        star = (r + 1) * n[2 : k + 2] / n[1 : k + 1]
        if common >= 1:
            continue
        d = (star / r - common) / (1 - common)
        if (d > 0).all() and (d < 1).all():
            out[1 : k + 1] = d
            return out
    out[1:] = 1 - ABSOLUTE / np.arange(1, K + 1)
    return out


@dataclass(frozen=True)
class Unigrams:
    """Good-Turing unigrams and additive ones from the counts of counts and totals."""

    tokens: int
    words: int
    d: np.ndarray

    @classmethod
    def of(cls, tokens: int, words: int, of_counts: np.ndarray) -> Unigrams:
        d = discounts(of_counts)
        return cls(tokens, words, d)

    def free(self, of_counts: np.ndarray) -> float:
        r = np.arange(1, K + 1)
        return float(((1 - self.d[1:]) * r * np.asarray(of_counts, float)[1 : K + 1]).sum())

    def probability(self, c: np.ndarray, of_counts: np.ndarray) -> np.ndarray:
        """P(w) of words with these counts; 0 stands for the unknown word."""
        if not self.tokens:
            return np.ones(len(c))
        free = self.free(of_counts)
        total = self.tokens if free > 0 else self.tokens + 1
        p = self.d[np.minimum(c, K)] ** (c <= K) * c / total
        return np.where(c > 0, p, (free or 1.0) / total)

    def base(self, c: np.ndarray) -> np.ndarray:
        return (c + ADD) / (self.tokens + ADD * (self.words + 1))


def backoff(total: np.ndarray, small: np.ndarray, lower: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Denominators and alpha of histories.

    total: occurrences; small: (histories, K) numbers of followers with counts 1..K; lower:
    sums of P(w) over the followers.
    """
    r = np.arange(1, K + 1)
    free = (small * ((1 - d[1:]) * r)).sum(axis=1)
    bare = free <= 0
    below = np.where(bare, total + 1, total)
    return below, np.where(bare, 1.0, free) / below / np.maximum(1 - lower, 1e-300)


# ---------------------------------------------------------------- packed arrays


def pack(a: np.ndarray) -> bytes:
    """A whole-number or float64 array in the narrowest type, byte by byte of its items, compressed."""
    import zstandard

    if a.dtype.kind in "iub":
        top = int(a.max(initial=0))
        a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T
    return a.dtype.str[1:].encode() + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(b: bytes) -> np.ndarray:
    import zstandard

    kind = np.dtype(b[:2].decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(b[2:])), np.uint8).reshape(kind.itemsize, -1)
    a = np.ascontiguousarray(planes.T).reshape(-1).view(kind)
    return a if kind.kind == "f" else a.astype(np.int64) if kind.itemsize < 8 else a


def _mixed(a: np.ndarray) -> np.ndarray:
    h = a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


# ---------------------------------------------------------------- blocks

#: keys_low and keys_high are the halves of the words' hashes; the low one says who owns a word.
BLOCK = (
    "block long, doc_ids binary, has_id binary, held binary, lengths binary, ids binary, keys_low binary, end long, "
    "keys_high binary, learned binary, tokens long"
)
#: Columns that only the requests of order 1 need.
ASKED_ONCE = ("keys_high", "learned", "tokens")
LOW = np.uint64((1 << 32) - 1)


def _word_hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word, 7)


#: No word holds a blank.
END = b" "


def _block(doc_ids: list, held: list, learn: list, lengths: list, ids: list[np.ndarray], vocabulary: dict[bytes, int]) -> tuple:
    keys = np.fromiter(map(_word_hash, vocabulary), np.uint64, len(vocabulary))
    first_seen = np.concatenate(ids)
    # Frequent words get small numbers, which pack well.
    order = np.argsort(-np.bincount(first_seen, minlength=len(keys)), kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    stream = rank[first_seen]
    weights = np.repeat(np.array(learn, float), lengths)
    learned = np.bincount(stream, weights, len(keys)).astype(np.int64)
    has = np.array([d is not None for d in doc_ids])
    numbers = np.array([d or 0 for d in doc_ids], np.int64).view(np.uint64)
    keys = keys[order]
    first = [pack(x) for x in (numbers, has, np.array(held) + 2 * np.array(learn), np.array(lengths), stream, keys & LOW)]
    end = int(rank[vocabulary[END]])
    return (uuid.uuid4().int >> 65, *first, end, pack(keys >> np.uint64(32)), pack(learned), len(stream))


def blocks(docs: DataFrame, parts: int, held: int) -> DataFrame:
    """The texts as token numbers, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [c.split() for c in BLOCK.split(", ")]
        schema = pa.schema([(name, pa.int64() if kind == "long" else pa.binary()) for name, kind in kinds])

        def made() -> pa.RecordBatch:
            row = _block(doc_ids, is_held, learn, lengths, ids, vocabulary)
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, schema, strict=True)], schema=schema)

        doc_ids, is_held, learn, lengths, ids, vocabulary, size = [], [], [], [], [], {}, 0
        for b in batches:
            # Ids come as Python numbers: 64 bits whatever stands beside them.
            for doc, h, t, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "held_out", "learn", "text")), strict=True):
                words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
                words.append(END)
                number = vocabulary.setdefault
                ids.append(np.fromiter((number(w, len(vocabulary)) for w in words), np.int32, len(words)))
                doc_ids.append(doc)
                is_held.append(h)
                learn.append(t)
                lengths.append(len(words))
                size += len(text or "")
                if size >= BLOCK_CHARS:
                    yield made()
                    doc_ids, is_held, learn, lengths, ids, vocabulary, size = [], [], [], [], [], {}, 0
        if ids:
            yield made()

    out = fold(F.col("doc_id"), parts) == held
    inputs = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(out, F.lit(False)).alias("held_out"),
        F.coalesce(~out, F.lit(False)).alias("learn"),
        F.col("text").cast("string").alias("text"),
    )
    return inputs.mapInArrow(run, BLOCK)


# ---------------------------------------------------------------- messages

REQUEST = "block long, bucket long, cells array<binary>"
ANSWER = "block long, bucket long, cells array<binary>, stat array<long>, hot array<double>"
_REQUEST, _ANSWER = ([c.split()[0] for c in x.split(", ")] for x in (REQUEST, ANSWER))


def _rows(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=columns, dtype=object)


def _packed(*arrays: np.ndarray) -> list[bytes]:
    return [pack(a) for a in arrays]


def _cells(group: pd.DataFrame) -> list[list[np.ndarray]]:
    """The arrays of each message, unpacked, by their place in the messages."""
    return [list(column) for column in zip(*([unpack(c) for c in cells] for cells in group["cells"]), strict=True)]


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each bucket with the places of its entries, in order."""
    if not len(bucket):
        return
    order = np.argsort(bucket, kind="stable")
    owners, starts = np.unique(bucket[order], return_index=True)
    for k, rows in zip(owners, np.split(order, starts[1:]), strict=True):
        yield int(k), rows


def _ask_words(buckets: int):
    """Messages: hashes of words, the block's counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, low, high, learned in zip(b["block"], b["keys_low"], b["keys_high"], b["learned"], strict=True):
                low, learned = unpack(low), unpack(learned)
                keys = unpack(high).astype(np.uint64) << np.uint64(32) | low.astype(np.uint64)
                yield _rows([(block, k, _packed(keys[at], learned[at])) for k, at in _split(low % buckets)], _REQUEST)

    return run


def _of_counts(total: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(total, K + 2), minlength=K + 3)[: K + 2]


def _answer_words(buckets: int):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Answers: counts, numbers of words (0 for unknown ones). stat: tokens, words, counts of counts."""
        keys, learned = _cells(group)
        words, inverse = np.unique(np.concatenate(keys).astype(np.uint64), return_inverse=True)
        total = np.bincount(inverse, np.concatenate(learned), len(words)).astype(np.int64)
        bucket = int(group["bucket"].iloc[0])
        rank = np.empty(len(total), np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(1, len(total) + 1)
        number = np.where(total > 0, rank * buckets + bucket, 0)
        rows = [(None, bucket, None, [int(total.sum()), int((total > 0).sum()), *_of_counts(total)[1:].tolist()], None)]
        ends = np.cumsum([len(x) for x in keys])
        for block, at in zip(group["block"], np.split(inverse, ends[:-1]), strict=True):
            rows.append((block, bucket, _packed(total[at], number[at]), None, None))
        return _rows(rows, _ANSWER)

    return run


# ---------------------------------------------------------------- orders 2 and 3


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(8)) % np.uint64(buckets)).astype(np.int64)


@dataclass
class Grams:
    """Distinct n-grams of a block in the order of their histories, and where they stand.

    Histories end in a known word; a history or word may be unknown (number 0).
    """

    far: np.ndarray  # local number of the word before the middle one (trigrams), -1 for an unknown one
    near: np.ndarray  # local number of the middle word, or history of a bigram
    word: np.ndarray  # local number, -1 for an unknown one
    learned: np.ndarray
    inverse: np.ndarray  # per token: its n-gram, or -1


class Opened:
    """A block with the answers of order 1."""

    def __init__(self, row, answers: pd.DataFrame, buckets: int, hot_from: float) -> None:
        self.block, self.buckets = row["block"], buckets
        self.doc_ids = unpack(row["doc_ids"]).astype(np.uint64).view(np.int64)
        self.has_id = unpack(row["has_id"]).astype(bool)
        flags = unpack(row["held"])
        self.held, self.learn = (flags & 1).astype(bool), (flags & 2) > 0
        self.lengths, self.ids = unpack(row["lengths"]), unpack(row["ids"])
        owner = unpack(row["keys_low"]) % buckets
        self.count, self.number = np.zeros(len(owner), np.int64), np.zeros(len(owner), np.int64)
        by = dict(zip(answers["bucket"], answers["cells"], strict=True))
        for k, at in _split(owner):
            self.count[at], self.number[at] = map(unpack, by[k])
        end = int(row["end"])
        # An end token stands before each text, and another before that.
        self.near = np.r_[end, self.ids[:-1]]
        self.far = np.where(self.near == end, end, np.r_[end, end, self.ids][: len(self.ids)])
        self.hot = self.count >= hot_from
        self.weights = np.repeat(self.learn, self.lengths).astype(float)

    def local(self, words: np.ndarray) -> np.ndarray:
        """Unknown words as -1."""
        return np.where(self.count[words] > 0, words, -1)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Numbers over all blocks, 0 for unknown words."""
        return np.where(words < 0, 0, self.number[words])

    def counts(self, words: np.ndarray) -> np.ndarray:
        return np.where(words < 0, 0, self.count[words])

    def _grams(self, of: np.ndarray, far: np.ndarray) -> Grams:
        """n-grams at the places ``of``: by near, far and word."""
        n = len(self.count) + 1
        near, word = self.near[of], self.local(self.ids[of])
        histories, h = np.unique(near * n + far + 1, return_inverse=True)
        distinct, where = np.unique(h * n + word + 1, return_inverse=True)
        inverse = np.full(len(self.ids), -1)
        inverse[of] = where
        learned = np.bincount(where, self.weights[of], len(distinct)).astype(np.int64)
        history = histories[distinct // n]
        return Grams(history % n - 1, history // n, distinct % n - 1, learned, inverse)

    def hot_pairs(self) -> Grams:
        """Bigrams whose history is hot."""
        of = np.flatnonzero(self.hot[self.near])
        return self._grams(of, np.zeros(len(of), np.int64))

    def trigrams(self) -> Grams:
        of = np.flatnonzero(self.count[self.near] > 0)
        return self._grams(of, self.local(self.far[of]))

    def pair_buckets(self, g: Grams) -> np.ndarray:
        return _bucket_of(_mixed(_mixed(self.numbers(g.near)) ^ _mixed(self.numbers(g.word) + 1)), self.buckets)

    def trigram_buckets(self, g: Grams) -> np.ndarray:
        h = _mixed(self.numbers(g.near))
        return _bucket_of(np.where(self.hot[g.near], _mixed(h ^ _mixed(self.numbers(g.far) + 1)), h), self.buckets)

    def hot_counts(self, pairs: Grams, answers: pd.DataFrame) -> np.ndarray:
        """Counts of the hot pairs."""
        by, out = dict(zip(answers["bucket"], answers["cells"], strict=True)), np.zeros(len(pairs.near), np.int64)
        for k, at in _split(self.pair_buckets(pairs)):
            out[at] = unpack(by[k][0])
        return out


def _parts_of(group: pd.DataFrame) -> tuple[pd.Series, dict[int, pd.DataFrame]]:
    """The block's own row, and the answers by step."""
    own = group["keys_low"].notna()
    rest = group[~own]
    return group[own].iloc[0], {k: rest[rest["step"] == k] for k in (1, 2, 3)}


def _ask_pairs(buckets: int, hot_from: float):
    """Messages: hot histories, words, the block's counts, counts of the words."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        row, answers = _parts_of(group)
        block = Opened(row, answers[1], buckets, hot_from)
        g, rows = block.hot_pairs(), []
        for k, at in _split(block.pair_buckets(g)):
            rows.append((block.block, k, _packed(block.number[g.near[at]], block.numbers(g.word[at]), g.learned[at], block.counts(g.word[at]))))
        return _rows(rows, _REQUEST)

    return run


def _ask_trigrams(buckets: int, hot_from: float):
    """Messages: middle words (twice the number, plus 1 for hot ones), words before, words, the block's counts,
    counts of the distinct words in the order of their numbers, and for hot middle words the counts of
    the last two words."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        row, answers = _parts_of(group)
        block = Opened(row, answers[1], buckets, hot_from)
        g, pairs, rows = block.trigrams(), block.hot_pairs(), []
        lower, hot = _hot_lower(block, g, pairs, answers[2]), block.hot[g.near]
        for k, at in _split(block.trigram_buckets(g)):
            near, word = block.number[g.near[at]] * 2 + hot[at], block.numbers(g.word[at])
            counts = block.counts(g.word[at])[np.unique(word, return_index=True)[1]]
            rows.append((block.block, k, _packed(near, block.numbers(g.far[at]), word, g.learned[at], counts, lower[at][hot[at]])))
        return _rows(rows, _REQUEST)

    return run


def _hot_lower(block: Opened, g: Grams, pairs: Grams, answers: pd.DataFrame) -> np.ndarray:
    """For trigrams of a hot middle word the count of their last two words, else 0."""
    out, hot = np.zeros(len(g.near), np.int64), np.flatnonzero(block.hot[g.near])
    if len(hot):
        n = len(block.count) + 1
        known = pairs.near * n + pairs.word + 1
        order = np.argsort(known, kind="stable")
        at = np.searchsorted(known[order], g.near[hot] * n + g.word[hot] + 1)
        out[hot] = block.hot_counts(pairs, answers)[order[at]]
    return out


def _coded(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One number for each pair, in the order of the pairs."""
    if max(first.max(initial=0), second.max(initial=0)) >= 1 << 31:
        first = np.unique(first, return_inverse=True)[1]
        second = np.unique(second, return_inverse=True)[1]
    return first.astype(np.int64) << 32 | second.astype(np.int64)


def _small(of: np.ndarray, counts: np.ndarray, n: int) -> np.ndarray:
    """(n, K): how many of the counts of each group are 1 to K."""
    return np.stack([np.bincount(of, counts == r, n) for r in range(1, K + 1)], axis=1).astype(np.int64)


def _sum(of: np.ndarray, x: np.ndarray, n: int) -> np.ndarray:
    out = np.bincount(of, x, n)
    return out if x.dtype.kind == "f" else out.astype(np.int64)


def _answer_pairs(unigrams: Unigrams, of_words: np.ndarray):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Answers: counts. stat: counts of counts. hot: history, occurrences, sum of P(w) over followers, small counts."""
        first, second, learned, counts = _cells(group)
        sizes = np.cumsum([len(x) for x in first])[:-1]
        first, second, learned, counts = map(np.concatenate, (first, second, learned, counts))
        _, at, inverse = np.unique(_coded(first, second), return_index=True, return_inverse=True)
        total = _sum(inverse, learned, len(at))
        histories, of = np.unique(first[at], return_inverse=True)
        n = len(histories)
        lower = np.bincount(of, np.where(total > 0, unigrams.probability(counts[at], of_words), 0.0), n)
        occurrences, small = _sum(of, total, n), _small(of, total, n)
        bucket = int(group["bucket"].iloc[0])
        rows = [(None, bucket, None, [0, 0, *_of_counts(total)[1:].tolist()], None)]
        rows += [(None, bucket, None, None, [float(histories[k]), float(occurrences[k]), lower[k], *small[k].astype(float)]) for k in range(n)]
        rows += [(block, bucket, _packed(total[own]), None, None) for block, own in zip(group["block"], np.split(inverse, sizes), strict=True)]
        return _rows(rows, _ANSWER)

    return run


def _answer_trigrams(unigrams: Unigrams, of_words: np.ndarray):
    def run(group: pd.DataFrame) -> pd.DataFrame:
        """Answers, by the order of the trigrams asked: their counts; for each history its occurrences and its
        followers' least count; for histories with an unseen follower the numbers that determine alpha; for
        trigrams that are unseen the count of the last two words; for middle words of such (hot ones apart) the
        numbers that determine their alpha. stat: counts of counts of bigrams (hot ones apart) and trigrams."""
        cells = _cells(group)
        sizes = np.cumsum([len(x) for x in cells[0]])[:-1]
        cells[4] = [c[np.unique(w, return_inverse=True)[1]] for w, c in zip(cells[2], cells[4], strict=True)]
        near, far, word, learned, counts, hot_lower = map(np.concatenate, cells)
        given = np.zeros(len(near), np.int64)
        given[near % 2 == 1] = hot_lower
        history = np.unique(_coded(near, far), return_inverse=True)[1]
        _, at, inverse = np.unique(_coded(history, word), return_index=True, return_inverse=True)
        total = _sum(inverse, learned, len(at))
        # Bigrams: sums over the first words; those of hot middle words came with the request.
        _, pair_at, pair = np.unique(_coded(near[at], word[at]), return_index=True, return_inverse=True)
        pair_at = at[pair_at]
        cold = near[pair_at] % 2 == 0
        lower = np.where(cold, _sum(pair, total, len(pair_at)), given[pair_at])
        # Middle words.
        middles, of = np.unique(near[pair_at], return_inverse=True)
        n = len(middles)
        seen = np.where(lower > 0, unigrams.probability(counts[pair_at], of_words), 0.0)
        middle = [*_small(of, lower, n).T, np.bincount(of, seen, n)]
        # Histories.
        h_of, n = history[at], int(history.max(initial=-1)) + 1
        known, below = total > 0, lower[pair]
        small = _small(h_of, total, n)
        least = np.where(small.any(axis=1), (small > 0).argmax(axis=1) + 1, K + 1)
        occurrences = _sum(h_of, total, n)
        large = _sum(h_of, np.where(known & (below > K), below, 0), n)
        weights = [*small.T, large, *_small(h_of, np.where(known, below, 0), n).T]
        bucket = int(group["bucket"].iloc[0])
        stat = [*_of_counts(lower[cold])[1:].tolist(), *_of_counts(total)[1:].tolist()]
        rows = [(None, bucket, None, stat, None)]
        for block, own, h in zip(group["block"], np.split(inverse, sizes), np.split(history, sizes), strict=True):
            asked, open_ = _asked(h, total[own] == 0)
            unseen = own[total[own] == 0]
            m = _cold_middles(near[at[unseen]])
            m = np.searchsorted(middles, m)
            cells = _packed(total[own], occurrences[asked], least[asked], *(x[open_] for x in weights), lower[pair[unseen]], *(x[m] for x in middle))
            rows.append((block, bucket, cells, None, None))
        return _rows(rows, _ANSWER)

    return run


def _asked(history: np.ndarray, unseen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct histories of n-grams in order of histories, and those with an unseen n-gram, in order."""
    first = np.r_[True, history[1:] != history[:-1]] if len(history) else np.zeros(0, bool)
    return history[first], history[first][np.logical_or.reduceat(unseen, np.flatnonzero(first))] if len(history) else history


def _cold_middles(near: np.ndarray) -> np.ndarray:
    return np.unique(near[near % 2 == 0])


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(buckets: int, hot_from: float, unigrams: Unigrams, of_words: np.ndarray, d2: np.ndarray, d3: np.ndarray, hot: np.ndarray):
    r = np.arange(1, K + 1)
    discounted = lambda d, c: d[np.minimum(c, K)] ** (c <= K) * c

    def bare(least: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Histories all of whose followers have counts that no discount touches."""
        return d[np.minimum(least, K)] ** (least <= K) >= 1

    def run(group: pd.DataFrame) -> pd.DataFrame:
        row, answers = _parts_of(group)
        block = Opened(row, answers[1], buckets, hot_from)
        g, pairs = block.trigrams(), block.hot_pairs()
        n = len(block.count)
        # Of middle words: denominator and alpha of order 2; occurrences are the word's own count.
        below2, alpha2 = np.maximum(block.count, 1).astype(float), np.ones(n)
        words = np.flatnonzero(block.hot)
        if len(words):
            at = np.searchsorted(hot[:, 0], block.number[words])
            below2[words], alpha2[words] = backoff(hot[at, 1], hot[at, 3:], hot[at, 2], d2)
        lower = _hot_lower(block, g, pairs, answers[2])
        count = np.zeros(len(g.near), np.int64)
        n_gram = n + 1
        history = np.unique(g.near * n_gram + g.far + 1, return_inverse=True)[1]
        m = int(history.max(initial=-1)) + 1
        total, small, large = np.zeros(m, np.int64), np.zeros((m, K), np.int64), np.zeros(m, np.int64)
        least, lower_small = np.full(m, K + 1), np.zeros((m, K), np.int64)
        by = dict(zip(answers[3]["bucket"], answers[3]["cells"], strict=True))
        for k, at in _split(block.trigram_buckets(g)):
            cells = iter(map(unpack, by[k]))
            take = lambda c, many: np.stack([next(c) for _ in range(many)], axis=1)
            count[at] = next(cells)
            near = block.number[g.near[at]] * 2 + block.hot[g.near[at]]
            unseen = count[at] == 0
            asked, open_ = np.unique(history[at]), np.unique(history[at][unseen])
            total[asked], least[asked] = next(cells), next(cells)
            small[open_], large[open_], lower_small[open_] = take(cells, K), next(cells), take(cells, K)
            lower[at[unseen]] = next(cells)
            cold, first = np.unique(near[unseen], return_index=True)
            first = g.near[at][unseen][first[cold % 2 == 0]]
            small2, lower2 = take(cells, K), next(cells)
            below2[first], alpha2[first] = backoff(block.count[first], small2, lower2, d2)
        p1 = unigrams.probability(block.count, of_words)
        # Order 2, for trigrams that are unseen.
        p2 = np.where(lower > 0, discounted(d2, lower) / below2[g.near], alpha2[g.near] * np.where(g.word < 0, unigrams.probability(np.zeros(1, np.int64), of_words)[0], p1[g.word]))
        # Order 3.
        is_bare = bare(least, d3)
        below3 = np.maximum(np.where(is_bare, total + 1, total), 1)
        free = np.where(is_bare, 1.0, (small * ((1 - d3[1:]) * r)).sum(axis=1))
        near_of = np.zeros(m, np.int64)
        near_of[history] = g.near
        covered = (large + (lower_small * (d2[1:] * r)).sum(axis=1)) / below2[near_of]
        alpha3 = np.where(total > 0, free / below3 / np.maximum(1 - covered, 1e-300), 1.0)
        p3 = np.where(count > 0, discounted(d3, count) / below3[history], alpha3[history] * p2)
        # A token after an unknown word has its unigram.
        logs = np.log10(np.where(g.inverse >= 0, np.append(p3, 1.0)[g.inverse], p1[block.ids]))
        base = np.log10(unigrams.base(block.count))[block.ids] if unigrams.tokens else np.zeros(len(block.ids))
        starts = np.r_[0, np.cumsum(block.lengths)[:-1]]
        return pd.DataFrame(
            {
                "doc_id": pd.arrays.IntegerArray(block.doc_ids.copy(), ~block.has_id),
                "held_out": block.held,
                "n_tokens": block.lengths,
                "n_known": np.add.reduceat((block.count > 0)[block.ids].astype(np.int64), starts),
                "train_tokens": unigrams.tokens,
                "base_score": np.add.reduceat(base, starts),
                "score": np.add.reduceat(logs, starts),
            }
        )

    return run


def _released(spark) -> None:
    """Lets Spark drop the shuffle files of finished steps: it does when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _sums(answers: DataFrame, n: int) -> np.ndarray:
    """Sums of the buckets' statistics."""
    cells = [F.coalesce(F.sum(F.get("stat", F.lit(i))), F.lit(0)) for i in range(n)]
    return np.array(answers.filter("stat is not null").agg(*cells).first(), np.int64)


def katz_scores(docs: DataFrame, parts: int = 10, held: int = 0, bucket_tokens: int = BUCKET_TOKENS, hot_tokens: int = HOT_TOKENS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: a row for each row of ``docs``."""
    text = written(blocks(docs, parts, held), "katz_blocks")
    spark = text.sparkSession
    total = text.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    buckets = max(4, -(-total // bucket_tokens))
    hot_from = max(hot_tokens, total * HOT_SHARE)

    asked = text.select("block", "keys_low", "keys_high", "learned").mapInPandas(_ask_words(buckets), REQUEST)
    words = written(asked.groupBy("bucket").applyInPandas(_answer_words(buckets), ANSWER), "katz_order1")
    tokens, kinds, *counts = _sums(words, K + 3)
    _released(spark)
    of_words = np.array([0, *counts])
    unigrams = Unigrams.of(int(tokens), int(kinds), of_words)

    lines = [c.split()[0] for c in BLOCK.split(", ") if c.split()[0] not in ("block", *ASKED_ONCE)]
    blank = [F.lit(None).cast(text.schema[c].dataType).alias(c) for c in lines]
    answer = [F.lit(None).cast("long").alias("bucket"), F.lit(None).cast("array<binary>").alias("cells")]

    def joined(*answers: tuple[int, DataFrame]) -> DataFrame:
        out = text.select("block", *lines, *answer, F.lit(0).alias("step"))
        for step, df in answers:
            own = df.filter("block is not null").select("block", *blank, "bucket", "cells", F.lit(step).alias("step"))
            out = out.unionAll(own)
        return out

    asked = joined((1, words)).groupBy("block").applyInPandas(_ask_pairs(buckets, hot_from), REQUEST)
    pairs = written(asked.groupBy("bucket").applyInPandas(_answer_pairs(unigrams, of_words), ANSWER), "katz_order2")
    hot_counts = _sums(pairs, K + 3)[2:]
    _released(spark)
    # At most total / hot_from rows, that is 2**20.
    sums = pairs.filter("hot is not null").groupBy(F.get("hot", F.lit(0)).alias("h"))
    hot = sums.agg(*(F.sum(F.get("hot", F.lit(i))).alias(f"s{i}") for i in range(1, K + 3))).orderBy("h").collect()
    hot = np.array(hot, float).reshape(len(hot), K + 3)

    asked = joined((1, words), (2, pairs)).groupBy("block").applyInPandas(_ask_trigrams(buckets, hot_from), REQUEST)
    trigrams = written(asked.groupBy("bucket").applyInPandas(_answer_trigrams(unigrams, of_words), ANSWER), "katz_order3")
    stats = _sums(trigrams, 2 * (K + 1))
    del asked
    _released(spark)
    d2, d3 = (discounts(np.array([0, *counts])) for counts in (hot_counts + stats[: K + 1], stats[K + 1 :]))
    scored = _score(buckets, hot_from, unigrams, of_words, d2, d3, hot)
    return joined((1, words), (2, pairs), (3, trigrams)).groupBy("block").applyInPandas(scored, SCORES)
