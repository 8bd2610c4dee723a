"""Review units, seams, the task library, connectors: small cases and brute force."""

import base64
import io
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from quillstream.functions import inline, leftovers, responses, visible
from quillstream.operators import checks, issues, library, remote, seams
from quillstream.plans.units import marked_stub
from quillstream.sources.responses import decoded


def test_visible_text_and_terms():
    text = "# Head\n\nSee $x$ and `code` <b>bold</b> &amp; more ![i](a.png)\n\n```\nhidden\n```\n\n## References\n\n[1] gone"
    seen = visible.visible_text(text)
    assert "bold" in seen and "& more" in seen and not {"hidden", "gone", "x$", "code"} & set(seen.split())
    terms = [("force plate", "测力台"), ("force", "力"), ("VO2", "摄氧量"), ("", "x")]
    assert visible.term_matches("The Force  Plate and forces; vo2.", terms) == [("force plate", "测力台"), ("VO2", "摄氧量")]
    assert visible.missing_terms("force plate, VO2", "测力台 `摄氧量`", terms) == [("VO2", "摄氧量")]


def test_signature_ignores_layout_and_sees_content():
    same = ["## A  b\n![x](i.png) <table><tr><td>1</td></tr></table>", "A b ![y](i.png)\n<table>\n<tr><td> 1 </td></tr></table>"]
    a, b = (visible.signature(t, {"i.png": "d"}.get) for t in same)
    assert a == b and a != visible.signature(same[0], {"i.png": "e"}.get)
    assert visible.signature("<table><tr><td>1</td></tr></table>") != visible.signature("<table><tr><th>1</th></tr></table>")


def test_active_issues_match_brute_force(spark):
    rng = random.Random(1)
    texts = ["值 5", "值 6", "This Sentence Was Left in English words", "标题", "测力台 5"]
    units, edits = [], []
    for i in range(120):
        source = rng.choice(["Value 5 of force plate", "Heading Words", "Value $x$ 5"])
        kind = rng.choice(["text", "heading", "code", "formula"])
        target = rng.choice([*texts, source])
        terms = [("force plate", "测力台")] if rng.random() < 0.5 else []
        units.append((i, kind, source, f"h{i}", target, rng.choice([[], ["结构 x", "旧"], ["旧"]]), terms))
        if rng.random() < 0.5:
            edits.append((i, rng.choice([f"h{i}", "old"]), [(rng.choice(texts), rng.choice([terms, [("a", "b")]]))]))
    u = spark.createDataFrame(units, f"unit_id int, kind string, source string, source_hash string, translated string, issues array<string>, terms {issues.TERMS}")
    e = spark.createDataFrame(edits, f"unit_id int, source_hash string, history array<struct<text: string, terms: {issues.TERMS}>>")
    none = spark.createDataFrame([], "unit_id int, key string")
    got = {r.unit_id: r for r in issues.active_issues(u, e, none).collect()}

    edited = {i: (h, hist[-1]) for i, h, hist in edits}
    soft = {}
    pairs = [(i, s, edited[i][1][0] if i in edited and edited[i][0] == f"h{i}" else t) for i, _, s, _, t, *_ in units]
    protected = [(i, inline.protect(inline.normalize_inline(s)).text, inline.protect(inline.normalize_inline(t)).text) for i, s, t in pairs]
    for r in checks.with_concerns(spark.createDataFrame(protected, "i int, source string, target string")).collect():
        soft[r.i] = list(r.concerns) + leftovers.english_phrases(r.target)
    for (i, kind, source, _, _, carried, terms), (_, _, text) in zip(units, pairs, strict=True):
        want = list(carried)
        if kind not in ("code", "formula"):
            want = soft[i] + ([issues.HEADING_LEFT] if kind == "heading" and source == text else []) + [c for c in carried if "结构" in c]
            want += [issues.TERM.format(*t) for t in terms if "force plate" in source and "测力台" not in text]
            want += [issues.TERMS_CHANGED] if i in edited and edited[i][1][1] != terms else []
        assert got[i].effective == text and list(got[i].active) == list(dict.fromkeys(want)), i

    keyed = spark.createDataFrame(list(got.values()), issues.active_issues(u, e, none).schema)
    confirmed = keyed.select("unit_id", issues.confirmation_key(F.col("source"), F.col("effective"), F.col("active"), F.col("terms")).alias("key"))
    assert issues.active_issues(u, e, confirmed).filter("size(active) > 0").count() == 0


def test_table_quality_matches_brute_force(spark):
    rows = [(t, c, f"Mean Value{'x' * (c % 3)} and Peak power{t} <sup>2</sup>" if c % 4 else "平均") for t in range(5) for c in range(30)]
    df = spark.createDataFrame(rows, "table_id int, cell int, text string")
    got = {r.table_id: (r.residual_english, r.inline_artifacts) for r in issues.table_quality(df, "table_id", ["cell"], "text").collect()}
    for t in range(5):
        found = [p for x, _, text in rows if x == t for p in leftovers.english_in_cell(text, 3)]
        assert got[t] == (list(dict.fromkeys(found))[:12], ["html_script"])


def test_seams_are_taken_over_only_if_their_content_is_the_same():
    main = "# One\n\nalpha\n\nbeta\n\ngamma"
    entries = [(0, "One"), (0, "alpha"), (1, "beta"), (2, "gamma")]
    bridge = {"start": 0, "end": 2, "text": "## One\nalpha\nbeta", "entries": [{"page": 0, "text": "One"}, {"page": 0, "text": "alpha"}, {"page": 1, "text": "beta"}]}
    text, told = seams.repaired(main, entries, [bridge])
    assert text == "## One\nalpha\nbeta\n\ngamma" and told == [(0, 2, seams.VERIFIED, seams.SAME)]
    changed = bridge | {"text": "## One\nalpha!\nbeta", "entries": [{"page": 0, "text": "One"}, {"page": 1, "text": "beta"}]}
    assert seams.repaired(main, entries, [changed])[1] == [(0, 2, seams.REVIEW, seams.DIFFERENT)]
    assert seams.repaired(main + " beta", entries, [bridge])[1] == [(0, 2, seams.REVIEW, seams.NOT_FOUND)]
    assert seams.repaired(main, entries, [bridge | {"text": None}]) == (main, [(0, 2, seams.REVIEW, seams.NOT_READY)])
    assert seams.region(main, [(0, "beta"), (0, "alpha")], 0, 1) is None


def test_runs_of_tables_match_brute_force():
    rng = random.Random(7)
    for _ in range(300):
        keys = ["".join(rng.choice("ab") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 9))]
        i = rng.randrange(len(keys))
        wanted = "".join(keys[i : i + rng.randrange(1, 4)]) if rng.random() < 0.8 else "abba"
        starts = [sum(map(len, keys[:k])) for k in range(len(keys) + 1)]
        runs = [(a, b) for a in range(len(keys)) for b in range(a, len(keys)) if "".join(keys[a : b + 1]) == wanted]
        assert seams.run_of(wanted, keys, starts) == (runs[0] if len(runs) == 1 else None)


def test_parts_of_a_book(spark):
    parts = [(1, 0, 5, "a"), (1, 5, 9, "b "), (2, 0, 5, "a"), (2, 6, 9, "b"), (3, 0, 5, None), (4, 1, 5, "a")]
    got = {r.doc_id: (r.pages, r.text, r.complete) for r in seams.merged(spark.createDataFrame(parts, "doc_id int, first_page int, end_page int, text string")).collect()}
    assert got == {1: (9, "a\n\nb\n", True), 2: (9, None, False), 3: (5, None, False), 4: (5, None, False)}


def answers(*status):
    left = list(status)

    def send():
        s = left.pop(0)
        if isinstance(s, Exception):
            raise s
        return s if isinstance(s, tuple) else (s, {}, b"ok")

    return send


def test_requests_are_tried_again_within_bounds():
    waits = []
    ask = lambda *s, **k: remote.requested(answers(*s), sleep=waits.append, clock=lambda: 0.0, **k)
    assert ask(500, (429, {"Retry-After": "7"}, b""), 200) == b"ok" and waits == [1.0, 7.0]
    waits.clear()
    assert ask((503, {"retry-after": "Thu, 01 Jan 1970 00:00:30 GMT"}, b""), (503, {"retry-after": "9999"}, b""), 200) == b"ok" and waits == [30.0, 60.0]
    waits.clear()
    with pytest.raises(remote.Unavailable) as error:
        ask(403)
    assert error.value.status == 403 and not error.value.transient and not waits
    with pytest.raises(remote.Unavailable) as error:
        ask(500, 502, 503)
    assert error.value.transient and len(waits) == 2
    with pytest.raises(remote.Unavailable):
        ask(ConnectionError(), TimeoutError(), ConnectionError())
    body = io.BytesIO(b"xyz")
    body.read(1)
    seen = []
    send = answers(500, 200)
    remote.requested(lambda: (seen.append(body.read()), send())[1], sleep=waits.append, body=body)
    assert seen == [b"yz", b"yz"]


def test_chat_answers():
    sent = []

    def post(url, headers, payload):
        sent.append((url, headers, json.loads(payload)))
        return 200, {}, json.dumps(next(replies)).encode()

    choice = lambda content, reason="stop": {"choices": [{"finish_reason": reason, "message": {"content": content}}]}
    replies = iter([choice('ok ["甲", 2]'), choice([{"text": '["'}, {"text": '乙"]'}]), choice("x", "length"), choice(" "), choice("none")])
    chat = remote.Chat(post, "u", "k", "m", budget=9_000)
    assert chat(["a", "b"]) == ["甲", "2"] and chat(["a"]) == ["乙"]
    assert sent[0][1]["Authorization"] == "Bearer k" and json.loads(sent[0][2]["messages"][1]["content"]) == ["a", "b"]
    for _ in range(2):
        with pytest.raises(ValueError):
            chat(["a"])
    assert chat(["a"]) == []
    with pytest.raises(ValueError, match="budget"):
        chat(["x" * 9_000])


def test_segments_ask_again_for_suspicious_blocks_only():
    segment = "# Title\n\nFirst part 5\n\nSecond part 6"
    asked = []

    def careless(texts):
        asked.append(texts[0])
        out = marked_stub(texts)[0]
        return [out.replace("6", "7") if len(asked) == 1 else out]

    done = remote.translate_segment(segment, careless, lambda s, t: ["n"] if ("6" in s) != ("6" in t) else [])
    assert done.text == "# 译：Title\n\n译：First part 5\n\n译：Second part 6" and done.requests == 2 and not done.warnings
    assert "First" in asked[0] and "First" not in asked[1] and "Second" in asked[1]
    assert [k for k, *_ in done.pairs] == ["heading", "text", "text"]
    worse = lambda texts: [marked_stub(texts)[0] + " outside"]
    assert remote.translate_segment(segment, worse, remote.leftover) is None
    assert remote.translate_segment("数字 5", worse, remote.leftover).text == "数字 5"
    again = remote.translate_segment(segment, None, remote.leftover, cached=done.protected)
    assert again.text == done.text and again.requests == 0
    assert remote.translate_segment(segment, None, remote.leftover, cached="damaged") is None


def test_responses(spark):
    archive = io.BytesIO()
    with zipfile.ZipFile(archive, "w") as z:
        z.writestr("full.md", "# x")
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../full.md", "# x")
    image = "data:image/png;base64," + base64.b64encode(b"png").decode()
    record = {"md_content": "# d", "middle_json": {"a": 1}, "images": {"i.png": image}}
    two = json.dumps({"results": {"a": record, "b": record}}).encode()
    rows = [
        (0, archive.getvalue(), ""), (1, bad.getvalue(), "application/zip"), (2, json.dumps({"results": {"a": record}}).encode(), ""), (3, two, ""),
        (4, b'{"result": {"content": "# m"}}', ""), (5, b'{"data": {"url": "/r.zip"}}', ""), (6, b"<!DOCTYPE html>", ""), (7, b"plain", "text/plain"), (8, b"", ""), (9, b"[1]", ""),
        (10, json.dumps({"results": {"a": record | {"images": {"../i.png": image}}}}).encode(), ""), (11, None, None), (12, b"PK\x03\x04broken", ""),
    ]
    got = {r.k: r for r in decoded(spark.createDataFrame(rows, "k int, content binary, content_type string"), "k").collect()}
    kinds = "archive error document error markdown address error text error json error error error".split()
    assert [got[i].kind for i in range(13)] == kinds
    assert [f.name for f in got[2].files] == ["full.md", "result_middle.json", "images/i.png"] and bytes(got[2].files[2].content) == b"png"
    assert got[5].address == "/r.zip" and all((got[i].error is None) != (kinds[i] == "error") for i in got)
    assert responses.first({"a": {"b": 0}, "c": 2}, ["a.b", "c"]) == 2


def test_links_are_resolved(spark):
    cases = [("a/b.png", "a/b.png"), ("./a/./b.png", "a/b.png"), ("a/../b.png", "b.png"), ("../b.png", None), ("a/../../b.png", None), ("/b.png", None), ("a\\b.png", None), ("a/b/../../c.png", "c.png")]
    df = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(cases)], "i int, l string")
    assert [r.p for r in sorted(df.select("i", library.resolved(F.col("l")).alias("p")).collect())] == [y for _, y in cases]


def test_reports(spark):
    rows = [(1, "u<1>", "text", "c", 3, "a & b", "<x>", ["数字可能发生变化"]), (1, "u2", "text", "c", None, None, "", []), (2, "u3", "omission", "c", 1, "s", "", ["疑似遗漏"])]
    made = issues.report_rows(spark.createDataFrame(rows, "task int, unit_id string, kind string, chapter string, page int, source string, translated string, active array<string>"))
    failures = spark.createDataFrame([(1, False), (2, True), (3, False)], "task int, failed boolean")
    usage = spark.createDataFrame([(1, 4, 9)], "task int, requests int, tokens int")
    got = {r.task: r for r in issues.reports(made, failures, usage).collect()}
    assert [got[t].status for t in (1, 2, 3)] == ["needs_review", "partial_failed", "completed"]
    assert "u&lt;1&gt;" in got[1].html and "a &amp; b" in got[1].html and "tokens: 9" in got[1].html and "## u<1>" in got[1].markdown
    assert json.loads(got[1].json)[0]["suggestion"] == issues.ADVICE["numbers"] and json.loads(got[3].json) == []
