"""Issues of review units computed from their texts, edits guarded, documents and reports rendered.

One pass of Python over the units finds what regular expressions on whole texts must (fragments
under protection, English left over, terms); numbers and lengths are compared in the JVM. All
other steps are joins and aggregates by unit or document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html_tables as H
from ..functions import inline, leftovers
from ..functions.blocks import blocks
from ..functions.text import TOKEN, fingerprint, inline_artifacts
from ..functions.visible import READ_ONLY, UNREAD, missing_terms
from . import checks
from .texts import english_left

#: Messages of the rules (fixed values).
HEADING_LEFT, TERMS_CHANGED, TERM = "标题可能未翻译", "术语已变化，人工译文已保留", "术语待核对：{} → {}"
#: Carried issues that a new check doesn't replace: unfinished, alignment, structure (fixed values).
CARRIED = "未完成|对应|结构"
#: Refusals of an edit.
READ_ONLY_UNIT, FRAGMENTS, STRUCTURE, LEVELS, SHAPE = "read-only", "protected fragments", "structure", "heading levels", "one block"
TERMS = "array<struct<source: string, target: string>>"

_TABLE_TAG = r"(?i)</?(?:table|tr|td|th)\b"


def all_units(units: DataFrame, cells: DataFrame) -> DataFrame:
    """Units and their cells as one stream with a place (pos, cell_pos); a unit stands before its cells."""
    own = units.withColumn("cell_pos", F.lit(-1))
    return own.unionByName(cells.select(*(c for c in cells.columns)), allowMissingColumns=True)


def editable(kind: Column) -> Column:
    return ~kind.isin(*READ_ONLY, "table")


def _pass(df: DataFrame, key: str, source: str, text: str, terms: str | None) -> DataFrame:
    """Adds _s and _t (protected, normalised), _english (left over in _t) and _terms (messages)."""
    added = "_s string, _t string, _english array<string>, _terms array<string>"
    names = [c.split()[0] for c in added.split(", ")]
    wanted = F.col(terms) if terms else F.array().cast(TERMS)
    inputs = df.select(F.col(key), F.coalesce(source, F.lit("")).alias("_source"), F.coalesce(text, F.lit("")).alias("_text"), wanted.alias("_wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made: list[list] = [[], [], [], []]
            for s, t, w in zip(*(b.column(c).to_pylist() for c in ("_source", "_text", "_wanted")), strict=True):
                old, new = (inline.protect(inline.normalize_inline(x)).text for x in (s, t))
                missing = missing_terms(s, t, [(x["source"], x["target"]) for x in w or ()])
                for column, value in zip(made, (old, new, leftovers.english_phrases(new), [TERM.format(*m) for m in missing]), strict=True):
                    column.append(value)
            strings = pa.list_(pa.string())
            arrays = [pa.array(c, k) for c, k in zip(made, (pa.string(), pa.string(), strings, strings), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key), *arrays], names=[key, *names])

    return inputs.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, {added}")


def text_issues(pairs: DataFrame, key: str = "unit_id", source: str = "source", text: str = "translated", terms: str | None = None) -> DataFrame:
    """key, issues, term_issues: concerns of each pair under protection, English left over; missing terms."""
    ruled = checks.with_concerns(_pass(pairs, key, source, text, terms), "_s", "_t")
    return ruled.select(key, F.concat("concerns", "_english").alias("issues"), F.col("_terms").alias("term_issues"))


def effective(units: DataFrame, edits: DataFrame) -> DataFrame:
    """Adds effective (the last edit made on the same source, else translated) and edit_terms (null without an edit).

    edits: unit_id, source_hash, history array<struct<text, terms>>.
    """
    kept = edits.select("unit_id", F.col("source_hash").alias("_hash"), F.call_function("try_element_at", "history", F.lit(-1)).alias("_last"))
    joined = units.join(kept, "unit_id", "left")
    valid = (F.col("_hash") == F.col("source_hash")) & F.col("_last").isNotNull()
    return joined.withColumns({"effective": F.when(valid, F.col("_last.text")).otherwise(F.col("translated")), "edit_terms": F.col("_last.terms")}).drop("_hash", "_last")


def active_issues(units: DataFrame, edits: DataFrame, confirmations: DataFrame) -> DataFrame:
    """units with effective and active: the issues of the effective text that nobody confirmed.

    units: unit_id, kind, source, source_hash, translated, issues, terms. Blocks without prose keep the
    issues they carry; others are checked again, headings that equal their source are issues, and so
    are missing terms and terms that have changed since the last edit. confirmations (unit_id,
    key) hold for exactly the source, text, issues and terms that they were made on.
    """
    shown = effective(units, edits)
    fresh = text_issues(shown.filter(~F.col("kind").isin(*UNREAD)), text="effective", terms="terms").withColumnRenamed("issues", "_fresh")
    joined = shown.join(fresh, "unit_id", "left")
    heading = (F.col("kind") == "heading") & (F.col("source") == F.col("effective")) & F.col("effective").rlike("[A-Za-z]")
    none = F.array().cast("array<string>")
    checked = F.concat(
        F.coalesce("_fresh", none),
        F.when(heading, F.array(F.lit(HEADING_LEFT))).otherwise(none),
        F.filter("issues", lambda i: i.rlike(CARRIED)),
        F.coalesce("term_issues", none),
        F.when(F.col("edit_terms").isNotNull() & (F.col("edit_terms") != F.col("terms")), F.array(F.lit(TERMS_CHANGED))).otherwise(none),
    )
    listed = F.array_distinct(F.when(F.col("kind").isin(*UNREAD), F.col("issues")).otherwise(checked))
    # A generator keeps the list from being made once more wherever it is named.
    found = joined.select("*", F.explode(F.array(listed)).alias("_all")).drop("_fresh", "term_issues")
    saved = confirmations.select("unit_id", F.col("key").alias("_key"))
    holds = F.col("_key").eqNullSafe(confirmation_key(F.col("source"), F.col("effective"), F.col("_all"), F.col("terms")))
    return found.join(saved, "unit_id", "left").withColumn("active", F.when(holds, none).otherwise(F.col("_all"))).drop("_key", "_all", "edit_terms")


def confirmation_key(source: Column, text: Column, issues: Column, terms: Column) -> Column:
    return fingerprint(source, text, F.to_json(issues), F.to_json(terms))


def guarded_edits(edits: DataFrame, key: str = "unit_id") -> DataFrame:
    """edits (kind, source, text) with refusal (the first guard that fails, else null) and concerns.

    An edit must leave the protected fragments, their marks, and the heading levels as they are, and
    stay one block; a cell takes no table tags. Refused edits have no concerns.
    """

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        for s, t in zip(b.column("source").to_pylist(), b.column("text").to_pylist(), strict=True):
            old, new = inline.protect(s or ""), inline.protect(t or "")
            yield old.text, new.text, list(old.values.values()) == list(new.values.values()), len(blocks(t or ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = list(zip(*rows(b), strict=True)) or [(), (), (), ()]
            arrays = [pa.array(c, k) for c, k in zip(made, (pa.string(), pa.string(), pa.bool_(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(key), *arrays], names=[key, "_s", "_t", "_same", "_blocks"])

    kind = edits.schema[key].dataType.simpleString()
    parsed = edits.select(key, "source", "text").mapInArrow(run, f"{key} {kind}, _s string, _t string, _same boolean, _blocks int")
    joined = edits.join(parsed, key)
    levels = lambda c: F.regexp_extract_all(c, F.lit(r"(?m)^(#{1,6})\s+"), F.lit(1))
    refusal = (
        F.when(~editable(F.col("kind")), READ_ONLY_UNIT)
        .when(~F.col("_same"), FRAGMENTS)
        .when(F.size(checks.structure_violations(F.col("_s"), F.col("_t"))) > 0, STRUCTURE)
        .when(levels("source") != levels("text"), LEVELS)
        .when((F.col("_blocks") != 1) | ((F.col("kind") == "cell") & F.col("text").rlike(_TABLE_TAG)), SHAPE)
    )
    ruled = checks.with_concerns(joined.withColumn("refusal", refusal), "_s", "_t")
    kept = F.when(F.col("refusal").isNull(), F.col("concerns")).otherwise(F.array().cast("array<string>"))
    return ruled.withColumn("concerns", kept).drop("_s", "_t", "_same", "_blocks")


def cell_scores(candidates: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """candidates (cell_id, attempt, source, text) with score: English left in the cell plus missing terms.

    terms: source, target that hold for all cells (a glossary in force, small enough for every task).
    """
    wanted = [(r["source"], r["target"]) for r in terms.collect()] if terms is not None else []

    @F.pandas_udf("int")
    def score(source: pd.Series, text: pd.Series) -> pd.Series:
        left = text.str.replace(TOKEN, "", regex=True).map(lambda t: len(leftovers.english_in_cell(t)))
        lost = [len(missing_terms(s, t, wanted)) if wanted else 0 for s, t in zip(source, text, strict=True)]
        return (left + lost).astype("int32")

    return candidates.withColumn("score", score(F.coalesce("source", F.lit("")), F.coalesce("text", F.lit(""))))


def accepted(scored: DataFrame) -> DataFrame:
    """cell_id, text, attempt, score: the first valid candidate of a cell unless a later one is strictly better."""
    best = F.min_by(F.struct("text", "attempt", "score"), F.struct("score", "attempt"))
    return scored.filter("valid").groupBy("cell_id").agg(best.alias("b")).select("cell_id", "b.*")


def table_quality(cells: DataFrame, table: str, order: list[str], text: str, limit: int = 12, each: int = 3) -> DataFrame:
    """table, residual_english, inline_artifacts: what is left in the cells of each table, in their order.

    At most ``each`` phrases of a cell and ``limit`` of a table count; both lists are distinct.
    """
    place = F.struct(*order)
    marked = cells.select(F.struct(F.col(table), place.alias("at")).alias("cell"), F.coalesce(text, F.lit("")).alias("_text"))
    phrases = english_left(marked, "cell", "_text", cells=True, limit=each)

    def gathered(df: DataFrame, item: str, name: str) -> DataFrame:
        """First places of the distinct items of a table, as a list in that order."""
        first = df.groupBy(F.col(f"cell.{table}").alias(table), item).agg(F.min(F.struct("cell.at", "pos")).alias("place"))
        listed = F.transform(F.array_sort(F.collect_list(F.struct("place", item))), lambda x: x[item])
        return first.groupBy(table).agg(listed.alias(name))

    artifacts = marked.select("cell", F.posexplode(inline_artifacts(F.col("_text"))).alias("pos", "artifact"))
    tables = cells.select(table).distinct()
    found = tables.join(gathered(phrases, "phrase", "residual_english"), table, "left").join(gathered(artifacts, "artifact", "inline_artifacts"), table, "left")
    none = F.array().cast("array<string>")
    return found.select(table, F.slice(F.coalesce("residual_english", none), 1, limit).alias("residual_english"), F.coalesce("inline_artifacts", none).alias("inline_artifacts"))


def rendered(units: DataFrame, cells: DataFrame) -> DataFrame:
    """doc_id, markdown: documents from the effective texts of their units and table cells.

    units: doc_id, segment, pos, unit_id, effective. cells: unit_id, cell_pos, effective; a unit with
    cells is a table, whose cells take their texts in order.
    """
    own = cells.groupBy("unit_id").agg(F.array_sort(F.collect_list(F.struct("cell_pos", F.coalesce("effective", F.lit("")).alias("text")))).alias("c"))
    joined = units.join(own.select("unit_id", F.transform("c", lambda x: x["text"]).alias("cells")), "unit_id", "left")

    @F.pandas_udf("string")
    def table(html: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for h, new in zip(html, texts, strict=True):
            parsed = H.parse(h)
            for cell, t in zip((c for x in parsed for c in x.cells), new, strict=False):
                cell.text = t
            out.append("\n".join(map(H.render, parsed)))
        return pd.Series(out, dtype=object)

    body = F.col("effective")
    plain = joined.filter("cells is null").select("doc_id", "segment", "pos", F.coalesce(body, F.lit("")).alias("piece"))
    tables = joined.filter("cells is not null").select("doc_id", "segment", "pos", table(body, F.col("cells")).alias("piece"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("segment", "pos", "piece"))), lambda x: x["piece"])
    whole = F.regexp_replace(F.array_join(pieces, "\n\n"), r"\A\s+|\s+\z", "")
    return plain.unionByName(tables).groupBy("doc_id").agg(F.concat(whole, F.lit("\n")).alias("markdown"))


#: Advice by kind, and labels of a report (fixed values).
ADVICE = {
    "numbers": "逐项核对原文与现译的数值、单位和正负号；仅格式不同且数值一致时可确认保留。",
    "formula": "对照原 PDF 核查公式及上下标；不要删除公式中的数值或变量。",
    "omission": "对照原页确认是否为正文；在复核窗口选择“AI 改译 / 补译”生成候选，采用并保存才插入；非遗漏可记录无需恢复的依据。",
    "translation": "核对是否应译为中文及本书术语；可编辑或按需生成改译候选。",
    "review": "若是人名、机构名、缩写或变量，核对后可确认保留；普通英文应补译，可按需生成改译候选。",
}
INFORMATION = "信息"


def escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def advice(reasons: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in ADVICE.items() for x in pair))
    return F.array_join(F.array_distinct(F.transform(reasons, lambda r: F.call_function("try_element_at", table, checks.suggestion_kind(r)))), "\n")


def report_rows(issues: DataFrame) -> DataFrame:
    """issues (task, unit_id, kind, chapter, page, source, translated, active) with rank, severity, suggestion, html, markdown."""
    rank = checks.category_rank(F.col("active"), F.col("kind"))
    rows = issues.filter(F.size("active") > 0).withColumns({"rank": rank, "suggestion": advice(F.col("active"))})
    rows = rows.withColumn("severity", checks.category(F.col("rank")))
    where = F.coalesce(F.concat(F.lit("p. "), F.col("page").cast("string")), F.lit("-"))
    reason = F.array_join("active", "；")
    cell = lambda c: F.concat(F.lit("<td>"), escaped(F.coalesce(c, F.lit(""))), F.lit("</td>"))
    fields = [F.col("severity"), where, F.col("chapter"), F.col("source"), F.col("translated"), reason, F.col("suggestion")]
    html = F.concat(F.lit('<tr id="'), escaped(F.col("unit_id").cast("string")), F.lit('">'), *map(cell, fields), F.lit("</tr>"))
    lines = [F.concat(F.lit(f"- {name}: "), F.coalesce(c.cast("string"), F.lit(""))) for name, c in zip(("severity", "page", "chapter", "source", "translated", "reason", "advice"), fields, strict=True)]
    markdown = F.concat_ws("\n", F.concat(F.lit("## "), F.col("unit_id").cast("string")), F.lit(""), *lines)
    return rows.withColumns({"html": html, "markdown": markdown})


def reports(rows: DataFrame, failures: DataFrame, usage: DataFrame) -> DataFrame:
    """task, status, n_issues, html, markdown, json: a report for each task.

    failures: task, failed (whether a segment or the export failed). usage: task, requests, tokens. The
    status is the worst of the task: partial_failed, needs_review, completed. A task's report gathers
    its own issues only.
    """
    order = F.struct("rank", "unit_id", "html", "markdown", F.to_json(F.struct("unit_id", "kind", "chapter", "page", "severity", "active", "suggestion")).alias("json"))
    listed = rows.groupBy("task").agg(F.array_sort(F.collect_list(order)).alias("i"), F.count_if(F.col("severity") != INFORMATION).alias("open"))
    joined = failures.join(listed, "task", "left").join(usage, "task", "left")
    status = F.when(F.col("failed"), "partial_failed").when(F.coalesce("open", F.lit(0)) > 0, "needs_review").otherwise("completed")
    joined = joined.withColumns({"status": status, "n_issues": F.coalesce(F.size("i"), F.lit(0))})
    part = lambda name, sep: F.coalesce(F.array_join(F.transform("i", lambda x: x[name]), sep), F.lit(""))
    footer = F.concat(F.lit("requests: "), F.coalesce("requests", F.lit(0)).cast("string"), F.lit("; tokens: "), F.coalesce("tokens", F.lit(0)).cast("string"))
    head = F.concat(F.lit("status: "), "status", F.lit("; issues: "), F.col("n_issues").cast("string"))
    html = F.concat(F.lit('<!doctype html><meta charset="utf-8"><p>'), head, F.lit("</p><table>"), part("html", ""), F.lit("</table><p>"), footer, F.lit("</p>"))
    markdown = F.concat(F.lit("# "), head, F.lit("\n\n"), part("markdown", "\n\n"), F.lit("\n\n"), footer, F.lit("\n"))
    return joined.select("task", "status", "n_issues", html.alias("html"), markdown.alias("markdown"), F.concat(F.lit("["), part("json", ","), F.lit("]")).alias("json"))


def omission_units(omissions: DataFrame, units: DataFrame) -> DataFrame:
    """Omissions that have an anchor as editable units: chapter and segment of the unit they stand before."""
    anchor = units.select(F.col("unit_id").alias("insert_before"), "chapter", "segment")
    made = omissions.join(anchor, "insert_before")
    return made.select(
        "omission_id", "insert_before", F.coalesce("kind", F.lit("text")).alias("kind"), "source", F.lit("").alias("translated"),
        fingerprint(F.col("source")).alias("source_hash"), "chapter", "segment",
    )


def adopted(recovered: DataFrame, proposals: DataFrame, units: DataFrame) -> DataFrame:
    """recovered with the proposals (omission_id, text) that are new, anchored and pass the guard.

    Idempotent: what was adopted before stays as it is, and of several proposals for one omission the
    first by text counts.
    """
    one = proposals.groupBy("omission_id").agg(F.min("text").alias("text")).join(recovered, "omission_id", "left_anti")
    ready = guarded_edits(one.join(units, "omission_id"), "omission_id").filter("refusal is null")
    return recovered.unionByName(ready.select("omission_id", "insert_before", "kind", "source", F.col("text").alias("translated"), "chapter", "segment"))
