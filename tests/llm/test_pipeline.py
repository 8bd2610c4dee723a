import importlib

import pytest

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_follow_each_other(spark, sf_dir):
    from quillstream.llm import decontamination, exact_dedup, simhash
    from quillstream.llm.common import read_table, written

    docs = read_table(spark, sf_dir, "documents")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[-1] > 0.5 * kept[0]
    assert exact_dedup.exact_dedup(docs).filter("not kept").count() == 0
    assert simhash.near_duplicates(docs).filter("doc_id <> component_id").count() == 0
    assert decontamination.leaks(docs, read_table(spark, sf_dir, "benchmark")).count() == 0
    last = pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert last.count() == kept[-1] and last.filter("not parity").count() == 0


def test_run_gives_what_the_stages_give(spark, sf_dir):
    rows = pipeline.run(spark, sf_dir).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)


def test_registration():
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    assert "pipeline" in names
    assert sorted({int(n[2:].split("_")[0]) for n in names if n.startswith("op") and n[2].isdigit()}) == list(range(1, 11))
    assert set(entry.oracle_sql()) <= set(names)


def test_pipeline_edge_cases(spark, odd, empty, sf_dir):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    for docs in (odd.select(columns), empty.select(columns)):
        for name, stage in pipeline.STAGES:
            docs = stage(spark, docs, sf_dir)
        docs.collect()


def test_stages_match_brute_force(spark, sf_dir):
    """After the first stage, every stage by its definition on small whole tables."""
    import re

    from test_similar import brute_kept
    from test_texts import brute_leaks

    from quillstream.llm.common import read_table, written

    docs = written(pipeline.drop_toxic(spark, read_table(spark, sf_dir, "documents"), sf_dir), "brute")
    items = [(r.item_id, r.text) for r in read_table(spark, sf_dir, "benchmark").collect()]
    rows = {r.doc_id: r.text for r in docs.collect()}
    first = {}
    for i in sorted(rows):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[i] or ""), i)
    exact = pipeline.drop_copies(spark, docs, sf_dir)
    assert sorted(r.doc_id for r in exact.collect()) == sorted(first.values())
    near = pipeline.drop_near_copies(spark, written(exact, "brute"), sf_dir)
    kept = brute_kept([(i, rows[i], "") for i in first.values()])
    assert sorted(r.doc_id for r in near.collect()) == kept
    clean = pipeline.drop_leaks(spark, written(near, "brute"), sf_dir)
    leaks = {d for d, _ in brute_leaks([(i, rows[i]) for i in kept], items)}
    assert sorted(r.doc_id for r in clean.collect()) == [i for i in kept if i not in leaks]
