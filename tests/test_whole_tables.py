"""Queries that read every document in full."""

import duckdb
from pyspark.sql import functions as F

from quillstream.plans import registry

registry.load()


def test_audit_terms_of_all_languages_and_80_a_document(spark, tmp_path):
    terms = " 12 ".join(f"{a}{b} word" for a in "abcdefghij" for b in "abcdefghij")
    rows = [(1, terms, "en"), (2, terms, "de"), (3, terms, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["d22_audit_terms"](spark, str(tmp_path)).groupBy("doc_id").agg(F.count("*").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {1: 80, 2: 80, 3: 80}


def test_acronyms_of_each_document(spark, tmp_path):
    many = " ".join(f"A{i:02}" for i in range(60))
    rows = [(1, f"{many} {many} A59", "en"), (2, "VO2 VO2 HIT", "de"), (3, "HIT PDF PDF éAB éAB", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.QUERIES["g4_document_acronym_guide"](spark, str(tmp_path)).collect()
    first = {r.rank: (r.item, r.n) for r in got if r.doc_id == 1}
    assert len(first) == 45 and first[1] == ("A59", 3) and first[2] == ("A00", 2)
    assert [(r.doc_id, r.item, r.n) for r in got if r.doc_id != 1] == [(2, "VO2", 2)]


def test_acronyms_of_the_corpus_have_ascii_boundaries(spark, tmp_path):
    rows = [(1, "éON ONé ON OFF_ _OFF OFF", "en"), (2, "ÄVO2\u0301 VO2 VO2a x-HIT 9HIT HIT", "en"), (3, "ON ON", "de"), (4, None, "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in registry.QUERIES["g4_acronym_guide"](spark, str(tmp_path)).collect()]
    oracle = duckdb.connect()
    oracle.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == oracle.execute(registry.ORACLES["g4_acronym_guide"]).fetchall() == [("ON", 3), ("HIT", 2), ("VO2", 2)]


def test_term_candidates_are_made_where_the_texts_are(spark, tmp_path):
    """As the SQL has them, hyphens, stop words and short words too; no row of a word or an n-gram is dealt out."""
    odd = "VO2-max -Deep  learning-based a--b IT it It\tIT of deep Learning-Based\nmodel; Deep learning-based Été naïve x-y- net NET the"
    rows = [(i, f"{odd} {' '.join(f'term{chr(97 + (i * k) % 26)} word' for k in range(90))}", "en") for i in range(40)] + [(50, None, "en"), (51, "", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.QUERIES["d23_term_candidates"](spark, str(tmp_path))
    got = sorted(tuple(r) for r in df.select("doc_id", "rank", "term", "n").collect())
    oracle = duckdb.connect()
    oracle.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == sorted(oracle.execute(registry.ORACLES["d23_term_candidates"]).fetchall())
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan and "Join" not in plan


def test_term_candidates_of_repeated_keys(spark):
    from quillstream.operators import terms

    rows = [(1, "deep net"), (1, "Deep net"), (None, "alpha beta"), (None, "alpha"), (2, "alpha beta")]
    got = sorted(map(tuple, terms.candidates(spark.createDataFrame(rows, "k int, t string"), "k", "t").collect()), key=repr)
    assert [r for r in got if r[0] == 1] == [(1, 1, "Deep net", 2), (1, 2, "Deep", 2)]
    assert [r[1:] for r in got if r[0] is None] == [(1, "alpha", 2), (2, "alpha beta", 1), (3, "beta", 1)]
    assert [r[1:] for r in got if r[0] == 2] == [(1, "alpha beta", 1), (2, "alpha", 1), (3, "beta", 1)]
