import hashlib
import re
from collections import defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstream.llm import components, exact_dedup, simhash


def brute_exact(rows):
    groups = defaultdict(list)
    for i, t, _ in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()].append(i)
    out = []
    for h, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), i == keep, h) for i in ids]
    return sorted(out, key=repr)


def test_exact_dedup_matches_brute_force(spark, make_docs, odd):
    rows = [(i, f"text {i % 37}  of\tsome" if i % 3 else f"only {i}", "en") for i in range(600)]
    for docs, given_rows in ((make_docs(rows), rows), (odd, [(r.doc_id, r.text, r.lang) for r in odd.collect()])):
        got = [tuple(r) for r in exact_dedup.exact_dedup(docs).collect()]
        assert sorted(got, key=repr) == brute_exact(given_rows)


def test_exact_dedup_passes_unique_rows_and_stays_exact_when_the_filter_is_full(spark, make_docs, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAX_SLOTS", 1 << 16)
    monkeypatch.setattr(exact_dedup, "_slots", lambda n: 1 << 16)
    rows = [(i, f"t{i // 2}", "en") for i in range(3000)]
    got = exact_dedup.exact_dedup(make_docs(rows)).collect()
    assert len(got) == 3000 and sum(r.kept for r in got) == 1500


def test_exact_dedup_of_nothing(empty):
    assert exact_dedup.exact_dedup(empty).collect() == []
    assert exact_dedup.deduplicated(empty).columns == empty.columns


def brute_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB \t\n\x0bé\x1c\u2003.", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_xxhash_agrees_with_spark(spark):
    h = spark.sql("select xxhash64('a b c') h").first().h
    assert h % (1 << 64) == xxhash.xxh64_intdigest(b"a b c", seed=42)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**31 - 1), st.integers(0, 30), st.integers(0, 30))
def test_words_a_bit_apart_share_an_anchor(word, i, j):
    near = word ^ (1 << i)
    words = np.array([word, near], np.uint64)
    rows, anchors = simhash.anchors(words)
    mine, other = (set(anchors[rows == k].tolist()) for k in (0, 1))
    assert mine & other
    assert all(bin(a ^ word).count("1") <= 2 for a in mine)
    assert min(bin(a ^ word).count("1") for a in mine) <= 1


def brute_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and bin(fps[a] ^ fps[b]).count("1") <= 2:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def clustered(seed, groups, size):
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(groups):
        f = int(rng.integers(0, 2**63))
        for _ in range(size):
            f ^= (1 << int(rng.integers(64))) ^ (1 << int(rng.integers(64)))
            out.append(f)
    return list(dict.fromkeys(out))


def test_links_are_complete(spark):
    """Chains of fingerprints two bits apart, replicated, compared and joined."""
    fps = clustered(3, 40, 12) + [0, 1, 3, 7, 15, 1 << 63, (1 << 63) | 1, (1 << 32), (1 << 31)]
    signed = [int(np.uint64(f).astype(np.int64)) for f in dict.fromkeys(fps)]
    near = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    root = {r.node: r.root for r in components.connected_components(near).collect()}
    assert partition({f: root.get(f, f) for f in signed}) == partition(brute_components({f: f % (1 << 64) for f in signed}))


def partition(root):
    groups = defaultdict(set)
    for x, r in root.items():
        groups[r].add(x)
    return {frozenset(g) for g in groups.values()}


def test_a_large_group_gives_a_forest_of_the_same_components():
    fps = clustered(5, 3, 150)
    a, b = simhash.forest(np.array(fps, np.uint64).view(np.int64))
    root = dict(zip(a.tolist(), b.tolist()))
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    assert partition({f: root.get(f, f) for f in signed}) == partition(brute_components({f: f % (1 << 64) for f in signed}))


def test_near_duplicates(spark, make_docs, odd, empty):
    text = " ".join(f"w{i % 97}" for i in range(400))
    rows = [(10, text, "en"), (3, text.upper(), "en"), (11, text + " end", "en"), (12, "other words here now", "en"), (13, None, "en"), (9, "", "en")]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(make_docs(rows)).collect()}
    fps = {i: brute_fingerprint(t) for i, t, _ in rows}
    assert {i: int(f, 16) for i, (f, _) in got.items()} == fps
    assert {i: c for i, (_, c) in got.items()} == brute_components(fps)
    assert got[10][1] == 3 and got[13][1] == 9
    assert simhash.near_duplicates(odd).count() == 9
    assert simhash.near_duplicates(empty).count() == 0


def test_fingerprints_of_rows_without_id_link_others(spark, make_docs):
    """Only a row without an id stands between two documents."""
    base = [f"w{i}" for i in range(300)]
    texts = [" ".join(base)]
    for k in range(1, 12):  # single words more, until a chain of three links appears
        texts.append(texts[-1] + f" x{k}")
    fps = {i: brute_fingerprint(t) for i, t in enumerate(texts)}
    want = brute_components(fps)
    middle = next((m for m in fps if any(bin(fps[m] ^ fps[o]).count("1") <= 2 and fps[o] != fps[m] for o in fps if o != m)), None)
    rows = [(None if i == middle else i, t, "en") for i, t in enumerate(texts)]
    got = {r.fingerprint: r.component_id for r in simhash.near_duplicates(make_docs(rows)).collect()}
    groups = defaultdict(list)
    for i, r in want.items():
        groups[r].append(i)
    for members in groups.values():
        least = min((i for i in members if i != middle), default=None)
        assert {got[f"{fps[i]:016x}"] for i in members} == {least}


def test_ids_keep_their_digits_beside_null(spark, make_docs):
    big = (1 << 53) + 1
    rows = [(big, "some text of words", "en"), (None, "other text of words", "en"), (-big, "some text of words", "en")]
    docs = make_docs(rows)
    assert {r.doc_id for r in simhash.near_duplicates(docs).collect()} == {big, -big, None}
    assert {(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(docs).collect()} == {(big, -big), (-big, -big), (None, None)}


def test_deduplicated_keeps_one_row_of_each_text(spark, make_docs, odd):
    rows = [(1, "a", "en"), (1, "b", "en"), (0, "b", "en"), (7, "c", "en"), (7, "c", "en"), (None, "d", "en"), (None, "d", "en"), (None, "a", "en")]
    for docs in (make_docs(rows), odd, make_docs([(i % 50, f"t{i % 40}", "en") for i in range(400)])):
        have = [(r.doc_id, r.text) for r in docs.collect()]
        got = exact_dedup.deduplicated(docs)
        assert got.columns == docs.columns
        got = sorted(((r.doc_id, r.text) for r in got.collect()), key=repr)
        best = {}
        for i, t in have:
            norm = re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
            if norm not in best or (i is not None and (best[norm] is None or i < best[norm])):
                best[norm] = i
        assert sorted((re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), repr(i)) for i, t in got) == sorted((n, repr(i)) for n, i in best.items())


def test_a_hot_text_and_a_hot_node(spark, make_docs):
    """A third of the rows are one text: results are whole and no key's rows meet in a task."""
    rows = [(i, "hot" if i % 3 == 0 else f"t{i}", "en") for i in range(9000)]
    got = exact_dedup.exact_dedup(make_docs(rows)).collect()
    assert len(got) == 9000 and sum(not r.kept for r in got) == 2999
    star = spark.createDataFrame([(0, i) for i in range(1, 5000)], "a long, b long")
    roots = components.connected_components(star, few=0).collect()
    assert len(roots) == 4999 and {r.root for r in roots} == {0}


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5)]
    for few in (0, components.FEW):
        got = components.connected_components(spark.createDataFrame(edges, "a long, b long"), few).collect()
        assert {r.node: r.root for r in got} == {i: 0 for i in range(1, 41)} | {1000 + i: 1000 for i in range(1, 200)}
    assert components.connected_components(spark.createDataFrame([(7, 7)], "a long, b long")).collect() == []
