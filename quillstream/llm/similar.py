"""SimHash near-duplicates by resemblance: texts that share ``SIMILAR`` of their five-word shingles.

A text's set holds the hashes of its distinct shingles (of the whole text where it has at most
``SHINGLE`` words). Two texts link where the Jaccard similarity of their sets is at least
``SIMILAR``; every link is verified on both sets.

Fingerprints have 64 * ``WORDS`` bits, each the majority of a bit over the set. Sets of
similarity 0.8 differ in 15 % of the bits (the angle between the sets, acos(0.889) / pi), so
``RADIUS`` of 512 lies more than three standard deviations above their distance. Candidates come from the
anchor covering of ``simhash``: each of the 16 blocks of 31 bits is replicated to the code words of the
Hamming code (31, 26) within covering radius plus one. A pair at similarity 0.8 shares no anchor of
any block with probability 0.03, at 0.85 with 0.005, at 0.9 below 0.0002; so that is the expected
loss of recall (measured in the README).

Equal sets are one node, and equal fingerprints one row of anchors. At every anchor, nodes within ``NEAR`` bits by one
word of the fingerprints (of 64, 3.6 standard deviations) are chained to crowds, whatever their number. A crowd of up to
``SMALL`` nodes gives its pairs, which are kept within ``RADIUS``; a larger one links each node to its least. What these
links join is a heap: no pair that shares an anchor within the bounds is outside one. Within a heap every pair of sets
is compared exactly, by products of incidence matrices, and only a spanning forest of the links leaves a task. A heap
of more than ``BLOCK`` sets is dealt to blocks, and each two blocks meet in one task: a set is copied at most
``BLOCKS`` times until blocks hold ``MOST`` sets. So rows grow with the texts; only comparisons, within tasks, grow
with the square of a heap.

Edge cases: null and blank texts are equal; rows without an id link to nothing and stay; rows of one
id count as one document, that of the set with the smallest digest; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, attached, forget, per_text, resident, texts_of, whole, without_ids, written
from .components import connected_components, joined
from .simhash import BLOCK_BITS, anchors

SHINGLE, SIMILAR = 5, 0.8
SEED = 42
WORDS = 8
#: Differing bits, of all and of one word, up to which a pair is a candidate.
RADIUS, NEAR = 104, 20
#: Crowds up to so many nodes give pairs; anchors up to MIDDLE nodes are compared together; beyond CROWD all are one crowd.
SMALL, MIDDLE, CROWD = 3, 64, 1 << 12
#: Rows of anchors that are taken at once.
CHUNK = 1 << 16
#: Sets of a block, blocks of a heap while a block has at most MOST sets, sets that are multiplied at once, columns of a product.
BLOCK, BLOCKS, MOST, TILE, COLUMNS = 256, 16, 1 << 14, 512, 1 << 13
#: Nodes that one task replicates.
TASK_NODES = 8_192
_SALTS = np.random.default_rng(SEED).integers(0, 1 << 64, WORDS, np.uint64)
_MIX, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BITS, _LANES = np.arange(8, dtype=np.uint64)[None, :, None], np.uint64(0x0101010101010101)


def shingles(text: str | None) -> np.ndarray:
    """The sorted hashes of the distinct shingles."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    join = b" ".join
    if len(words) <= SHINGLE:
        return np.array([xxh64_intdigest(join(words), SEED)], np.uint64)
    grams = zip(*(words[i:] for i in range(SHINGLE)), strict=False)
    return np.unique(np.fromiter((xxh64_intdigest(join(g), SEED) for g in grams), np.uint64, len(words) - SHINGLE + 1))


def fingerprint(shingled: np.ndarray) -> np.ndarray:
    """WORDS words; a bit is 1 if it is set in over half the mixed hashes."""
    total = np.zeros((8, WORDS, 8), np.int64)  # bit of a byte, word, byte
    for at in range(0, len(shingled), 255):
        x = (shingled[at : at + 255, None] ^ _SALTS) * _MIX
        x ^= x >> np.uint64(32)
        x *= _MIX2
        x ^= x >> np.uint64(29)
        # Up to 255 rows: each byte of a sum counts one bit.
        lanes = ((x[:, None, :] >> _BITS) & _LANES).sum(axis=0)
        total += lanes.view(np.uint8).reshape(8, WORDS, 8)
    ones = (2 * total > len(shingled)).astype(np.uint8)
    return np.packbits(ones.transpose(1, 2, 0), axis=2, bitorder="little").reshape(-1).view(np.uint64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILAR * (len(a) + len(b) - both)


def _digest(shingled: np.ndarray) -> bytes:
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(shingled.tobytes())


def _fingerprints(texts: list[str | None]) -> list:
    resident("similar", object)
    sets = list(map(shingles, texts))
    return [[*map(_digest, sets)], [fingerprint(x).tobytes() for x in sets]]


def _sets(texts: list[str | None]) -> list:
    sets = list(map(shingles, texts))
    return [[*map(_digest, sets)], [x.tobytes() for x in sets]]


def _words(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, WORDS)


def _replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """anchor, node, piece: a word of the fingerprint apart from the anchor's block."""
    for b in batches:
        for start in range(0, len(b), 4096):
            part = b.iloc[start : start + 4096]
            node, words = part["node"].to_numpy(np.int64), _words(part["fp"])
            for k in range(2 * WORDS):
                block = (words[:, k // 2] >> np.uint64(32 * (k % 2))) & np.uint64((1 << BLOCK_BITS) - 1)
                rows, at = anchors(block)
                piece = words[:, (k // 2 + WORDS // 2) % WORDS].view(np.int64)
                yield pd.DataFrame({"anchor": at.astype(np.int64) | (k << BLOCK_BITS), "node": node[rows], "piece": piece[rows]})


def _far(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).astype(np.int64)


def _crowds(piece: np.ndarray) -> np.ndarray:
    """For each row the first row of its crowd: rows within NEAR of each other, over any number of steps."""
    first, rest = np.arange(len(piece)), np.arange(len(piece))
    while len(rest):
        seed, rest = rest[0], rest[1:]
        ahead = np.array([seed])
        while len(ahead) and len(rest):
            now, ahead = ahead[:MIDDLE], ahead[MIDDLE:]
            met = (_far(piece[now][:, None], piece[rest][None, :]) <= NEAR).any(axis=0)
            first[rest[met]] = seed
            ahead, rest = np.r_[ahead, rest[met]], rest[~met]
    return first


def _met(node: np.ndarray, piece: np.ndarray, starts: np.ndarray, own: np.ndarray, wide: int) -> pd.DataFrame:
    """a, b, apart of the groups of rows that share an anchor; the first ``wide`` rows are of one crowd."""
    first, sizes = np.arange(len(node)), np.repeat(own, own)
    place = first - np.repeat(starts, own)
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    active = np.flatnonzero((sizes > 1) & (sizes <= MIDDLE))
    for gap in range(1, MIDDLE):
        active = active[place[active] + gap < sizes[active]]
        if not len(active):
            break
        near = active[_far(piece[active], piece[active + gap]) <= NEAR]
        left.append(near)
        right.append(near + gap)
    left, right = np.concatenate(left), np.concatenate(right)
    rows, roots = joined(left, right)
    first[rows] = roots
    for g in np.flatnonzero(own > MIDDLE):
        at = slice(starts[g], starts[g] + own[g])
        first[at] = starts[g] + (_crowds(piece[at]) if own[g] <= CROWD else 0)
    first[:wide] = 0
    large = np.bincount(first, minlength=len(node))[first] > SMALL
    large[:wide] = True
    few = ~large[left]
    # The least node is the middle of the star, so that the crowds of many anchors give the same links.
    least = np.full(len(node), np.iinfo(np.int64).max)
    np.minimum.at(least, first, node)
    star = np.flatnonzero(large)
    a, b = np.r_[node[left[few]], least[first[star]]], np.r_[node[right[few]], node[star]]
    apart = np.arange(len(a)) < few.sum()
    pairs = pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "apart": apart})
    return pairs[pairs["a"] < pairs["b"]].drop_duplicates()


def _pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """a < b, apart: links of each anchor, and whether their distance is still to be judged. Rows come sorted by anchor."""

    def chunks() -> Iterator[tuple[np.ndarray, int]]:
        held, wide = np.zeros((3, 0), np.int64), -1
        for b in batches:
            held = np.concatenate([held, np.stack([b[c].to_numpy(np.int64) for c in ("anchor", "node", "piece")])], axis=1)
            while held.shape[1] >= CHUNK:
                # Whole anchors; one beyond a chunk, which is one crowd, is taken in parts that share a row.
                cut = int(np.searchsorted(held[0, :CHUNK], held[0, CHUNK - 1]))
                wide = wide if cut else held[0, 0]
                yield held[:, : cut or CHUNK], wide
                held = held[:, cut or CHUNK - 1 :]
        yield held, wide

    for (anchor, node, piece), wide in chunks():
        if len(anchor):
            starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            own = np.diff(np.r_[starts, len(anchor)])
            yield _met(node, piece.view(np.uint64), starts, own, int(own[0]) if anchor[0] == wide else 0)


def _distances(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            d = np.bitwise_count(_words(b["fp_a"]) ^ _words(b["fp_b"])).sum(axis=1, dtype=np.int64)
            yield b[["a", "b"]][d <= RADIUS]


def _alike(a: list[np.ndarray], b: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of places of sets in ``a`` and ``b`` that are similar: exact, by products of incidence matrices."""
    if len(a) == len(b) == 1:
        hit = np.zeros(int(similar(a[0], b[0])), np.int64)
        return hit, hit
    sizes = [np.array([len(x) for x in side]) for side in (a, b)]
    flat, rows = [np.concatenate(side) for side in (a, b)], [np.repeat(np.arange(len(n)), n) for n in sizes]
    shared = np.intersect1d(*flat)
    both = np.zeros((len(a), len(b)), np.float32)
    places = []
    for k in range(2):
        at = np.minimum(np.searchsorted(shared, flat[k]), max(len(shared) - 1, 0))
        kept = np.flatnonzero(shared[at] == flat[k]) if len(shared) else np.zeros(0, np.int64)
        order = np.argsort(at[kept], kind="stable")
        places.append((rows[k][kept][order], at[kept][order]))
    for start in range(0, len(shared), COLUMNS):
        sides = []
        for k, (row, at) in enumerate(places):
            span = slice(*np.searchsorted(at, [start, start + COLUMNS]))
            m = np.zeros((len(sizes[k]), min(COLUMNS, len(shared) - start)), np.float32)
            m[row[span], at[span] - start] = 1
            sides.append(m)
        both += sides[0] @ sides[1].T
    return np.nonzero(both >= SIMILAR * (sizes[0][:, None] + sizes[1][None, :] - both.astype(np.float64)))


def _forest(own: np.ndarray, sets: list[np.ndarray], other: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest, as ids, of the similar pairs of one block, or of two: the first ``other`` sets and the rest."""
    one = not 0 < other < len(own)
    edges = [0, len(own)] if one else [0, other, len(own)]
    tiles = [[(i, min(i + TILE, end)) for i in range(start, end, TILE)] for start, end in zip(edges, edges[1:], strict=False)]
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n, (i, i_end) in enumerate(tiles[0]):
        for j, j_end in tiles[0][n:] if one else tiles[1]:
            x, y = _alike(sets[i:i_end], sets[j:j_end])
            x, y = x + i, y + j
            node, root = joined(x[x != y], y[x != y])
            left.append(node)
            right.append(root)
    node, root = joined(np.concatenate(left), np.concatenate(right))
    return own[node], own[root]


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """a, b: the forest of each two blocks of a heap. Rows come sorted by heap, blocks and own block."""

    def rows() -> Iterator[tuple]:
        for b in batches:
            yield from b[["heap", "low", "high", "block", "doc_id", "shingles"]].itertuples(index=False, name=None)

    for _, group in groupby(rows(), lambda r: r[:3]):
        _, _, _, block, own, sets = zip(*group, strict=True)
        if len(own) > 1:
            a, b = _forest(np.array(own, np.int64), [np.frombuffer(x, np.uint64) for x in sets], sum(x == block[0] for x in block))
            yield pd.DataFrame({"a": a, "b": b})


def _heaps(nodes: DataFrame, same: DataFrame) -> DataFrame:
    """doc_id, heap: nodes and what shares their fingerprints, by the links of all anchors; alone ones have no heap."""
    # A node makes about 250 rows, so that a file of nodes is far too much for a task.
    dealt = nodes.select("node", "fp").repartition(nodes.count() // TASK_NODES + 1)
    rows = dealt.mapInPandas(_replicate, "anchor long, node long, piece long")
    met = rows.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(_pairs, "a long, b long, apart boolean")
    met = written(met.distinct(), "met")
    side = {s: nodes.select(F.col("node").alias(s), F.col("fp").alias(f"fp_{s}")) for s in "ab"}
    near = met.filter("apart").join(side["b"], "b").join(side["a"], "a").mapInPandas(_distances, "a long, b long")
    links = near.unionByName(met.filter("not apart").select("a", "b")).unionByName(same)
    roots = connected_components(links)
    return written(roots.select(F.col("node").alias("doc_id"), F.col("root").alias("heap")).unionByName(roots.select(F.col("root").alias("doc_id"), F.col("root").alias("heap")).distinct()), "heaps")


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id, component_id of the documents that link to one with a smaller id."""
    prints = per_text(texts_of(docs).filter("doc_id is not null"), {"own": "binary", "fp": "binary"}, whole(_fingerprints))
    prints = written(prints.groupBy("doc_id").agg(F.min(F.struct("own", "fp")).alias("p")).select("doc_id", "p.*"), "wide_fingerprints")
    sets = written(prints.groupBy("own").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.count("*").alias("n")), "wide_sets")
    nodes = written(sets.groupBy("fp").agg(F.min("first").alias("node"), F.count("*").alias("kinds")), "wide_classes")
    shared = nodes.filter("kinds > 1")
    same = attached(sets.select("first", "fp"), shared, "fp", "kinds", sets.count()).filter("first <> node").select(F.col("node").alias("a"), F.col("first").alias("b"))
    heaps = _heaps(nodes, same)
    ids = heaps.select("doc_id")
    ids = F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
    some = per_text(texts_of(docs).join(ids, "doc_id", "left_semi"), {"own": "binary", "shingles": "binary"}, whole(_sets))
    some = some.groupBy("doc_id").agg(F.min(F.struct("own", "shingles")).alias("s")).select("doc_id", "s.shingles")
    sizes = written(heaps.groupBy("heap").agg(F.count("*").alias("n")), "heap_sizes")
    placed = attached(heaps, sizes, "heap", "n", heaps.count())
    blocks = F.greatest(F.least(F.ceil(F.col("n") / BLOCK), F.lit(BLOCKS)), F.ceil(F.col("n") / MOST))
    placed = placed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    placed = written(placed.join(some, "doc_id"), "placed")
    met = placed.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.select("heap", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "doc_id", "shingles")
    # Dealt by ranges, so that the tasks are even, whatever the heaps.
    met = met.repartitionByRange("heap", "low", "high").sortWithinPartitions("heap", "low", "high", "block")
    links = met.mapInPandas(_compared, "a long, b long")
    copies = attached(prints.select("doc_id", "own"), sets.filter("n > 1").select("own", "first", "n"), "own", "n", prints.count())
    links = links.unionByName(copies.filter("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")))
    roots = connected_components(links)
    forget(placed)
    return roots.select(F.col("node").alias("doc_id"), F.col("root").alias("component_id")).filter("doc_id <> component_id")


def similar_deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest id."""
    return without_ids(docs, similar_documents(docs))
