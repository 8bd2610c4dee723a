"""SimHash near-duplicates, candidates by anchor points of a covering code.

A fingerprint has 64 bits; two link at 2 or fewer differing bits. Two disjoint blocks of 31
bits then hold a pair that differs by 1 bit or less in one of them. In each block the anchors
are the 2**26 words of the perfect Hamming code (31, 26): every point of the block has an
anchor within the covering radius 1. A fingerprint is replicated to every anchor within
covering radius plus block threshold (1 + 1 = 2): the word itself if it is a code word, else
its nearest code word and the 15 at distance two. The anchor next to one fingerprint of a
linked pair is thereby shared by the other, so no link is lost, and only fingerprints at the
same anchor are compared, on all 64 bits.

Equal fingerprints are merged before replication, so copies cost one row whatever their
number. An anchor with few fingerprints is compared pairwise in vectorised form; an anchor
with many finds its links by looking up all 2,080 neighbours of every fingerprint, in time
linear in the group. Either way it hands out a spanning forest rather than pairs. Components
come from alternating large-star and small-star steps over distributed tables.

Fingerprints themselves are the nodes of the components, so those that only rows without an id
have link like any other; a component is named by the smallest id among its rows.

Edge cases: null or blank texts have fingerprint zero and link like any other; an empty table
gives an empty result; rows without an id keep a fingerprint and take the component of the
rows that they link to (null if none of these has an id); ids that repeat are rows each.
Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import attached, per_text, texts_of, whole, written
from .components import connected_components

#: The contract's parameters: words in a shingle, hash seed, differing bits.
SHINGLE, SEED, THRESHOLD = 3, 42, 2
#: Groups up to so many fingerprints are compared pair by pair.
SMALL = 64
BLOCK_BITS = 31


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Unsigned 64-bit SimHash of the whole text."""
    from xxhash import xxh64_intdigest

    # bytes.lower() changes A-Z alone; bytes.split() splits at 20 and 09-0D alone.
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    join = b" ".join
    if len(words) <= shingle:
        return xxh64_intdigest(join(words), seed)
    hashes = [xxh64_intdigest(join(s), seed) for s in zip(*(words[i:] for i in range(shingle)), strict=False)]
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = np.array(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""

    def compute(texts: list[str | None]) -> list:
        return [np.fromiter((fingerprint(t, shingle, seed) for t in texts), np.uint64, len(texts)).view(np.int64)]

    return per_text(texts_of(docs), {"fp": "long"}, whole(compute))


def _pairs_by_syndrome() -> np.ndarray:
    """For syndromes 0..31: the masks that lead to the code words within distance 2."""
    masks = np.zeros((32, 16), np.uint64)
    for s in range(1, 32):
        pairs = [(i, i ^ s) for i in range(1, 32) if i < i ^ s]
        masks[s] = [1 << (s - 1)] + [(1 << (i - 1)) | (1 << (j - 1)) for i, j in pairs]
    return masks


def anchors(block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and anchors: every code word within distance 2 of each 31-bit word."""
    masks = _pairs_by_syndrome()
    syndrome = np.zeros(len(block), np.uint64)
    for bit in range(BLOCK_BITS):
        syndrome ^= ((block >> np.uint64(bit)) & np.uint64(1)) * np.uint64(bit + 1)
    syndrome = syndrome.astype(np.int64)
    coded = np.flatnonzero(syndrome == 0)
    other = np.flatnonzero(syndrome)
    words = (block[other][:, None] ^ masks[syndrome[other]]).ravel()
    return np.concatenate([coded, np.repeat(other, 16)]), np.concatenate([block[coded], words])


def _replicate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        fp = b["fp"].to_numpy(np.int64)
        for k in range(2):
            block = (fp.view(np.uint64) >> np.uint64(32 * k)) & np.uint64((1 << BLOCK_BITS) - 1)
            rows, words = anchors(block)
            key = words.astype(np.int64) | (k << BLOCK_BITS)
            yield pd.DataFrame({"anchor": key, "fp": fp[rows]})


def _find(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _masks(bits: int) -> list[int]:
    single = [1 << i for i in range(64)]
    double = [a | b for i, a in enumerate(single) for b in single[i + 1 :]]
    return single + (double if bits > 1 else [])


def forest(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, a first member of its group) of the links among distinct fingerprints.

    Linear in the group: every fingerprint looks up its neighbours in the sorted group.
    """
    f = np.sort(fp.view(np.uint64))
    parent = np.arange(len(f))
    for mask in _masks(THRESHOLD):
        want = f ^ np.uint64(mask)
        at = np.minimum(np.searchsorted(f, want), len(f) - 1)
        a = np.flatnonzero((f[at] == want) & (want > f))
        b = at[a]
        while len(a):
            x, y = parent[a], parent[b]
            apart = x != y
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            if len(a):
                np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
                parent = _find(parent)
    joined = parent != np.arange(len(f))
    return f[joined].view(np.int64), f[parent[joined]].view(np.int64)


def links(anchor: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges among fingerprints of the same anchor; ``anchor`` is sorted."""
    starts = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    sizes = np.diff(np.r_[starts, len(anchor)])
    left, right = [], []
    small = np.repeat(np.where(sizes <= SMALL, sizes, 0), sizes)
    place = np.arange(len(anchor)) - np.repeat(starts, sizes)
    active = np.flatnonzero(small > 1)
    for gap in range(1, SMALL):
        active = active[place[active] + gap < small[active]]
        if not len(active):
            break
        near = np.bitwise_count(fp[active].view(np.uint64) ^ fp[active + gap].view(np.uint64)) <= THRESHOLD
        left.append(fp[active[near]])
        right.append(fp[active[near] + gap])
    for g in np.flatnonzero(sizes > SMALL):
        a, b = forest(fp[starts[g] : starts[g] + sizes[g]])
        left.append(a)
        right.append(b)
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def _compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come sorted by anchor; a group may go over several batches."""
    held: list[np.ndarray] = []
    for b in batches:
        if not len(b):
            continue
        rows = np.stack([b[c].to_numpy(np.int64) for c in ("anchor", "fp")])
        if held and held[0][0, -1] == rows[0, -1]:
            held.append(rows)
            continue
        rows = np.concatenate([*held, rows], axis=1)
        cut = np.searchsorted(rows[0], rows[0, -1])
        held = [rows[:, cut:]]
        a, c = links(rows[0, :cut], rows[1, :cut])
        yield pd.DataFrame({"a": a, "b": c})
    if held:
        rows = np.concatenate(held, axis=1)
        a, c = links(rows[0], rows[1])
        yield pd.DataFrame({"a": a, "b": c})


def fingerprint_links(classes: DataFrame) -> DataFrame:
    """a, b: links among the distinct fingerprints ``classes`` (fp), enough to join what is joined."""
    near = classes.select("fp").mapInPandas(_replicate, "anchor long, fp long")
    return near.repartition("anchor").sortWithinPartitions("anchor").mapInPandas(_compare, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id: one row for each row of ``docs``."""
    fps = written(fingerprints(docs), "fingerprints")
    classes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "classes")
    roots = connected_components(fingerprint_links(classes))
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    placed = written(placed.withColumn("root", F.coalesce("root", "fp")), "placed")
    names = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("kinds"))
    total = classes.agg(F.count("*"), F.sum("n")).first()
    named = attached(placed, names, "root", "kinds", total[0]).select("fp", "n", "component_id")
    return attached(fps, written(named, "named"), "fp", "n", total[1] or 0).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
