"""Parts of a parsed document put together: seams repaired, merged tables located, coverage checked."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.visible import signature

VERIFIED, REVIEW = "verified", "needs_review"
#: Why a seam was or wasn't taken over.
SAME, DIFFERENT, NOT_FOUND, NOT_READY = "same content", "content differs", "not located uniquely", "not parsed"

_HEADING = re.compile(r"#{1,6}\s+")


def region(markdown: str, entries: list[tuple[int, str]], start: int, end: int) -> tuple[int, int] | None:
    """Where the entries of the pages ``start`` to ``end`` (excluded) stand, from the first to the last.

    Null unless each entry occurs once and they come in order. A heading's marks belong to it.
    """
    texts = [t for page, t in entries if start <= page < end and t]
    spans = []
    for text in texts:
        at = markdown.find(text)
        if at < 0 or markdown.find(text, at + 1) >= 0:
            return None
        line = markdown.rfind("\n", 0, at) + 1
        spans.append((line if _HEADING.fullmatch(markdown, line, at) else at, at + len(text)))
    in_order = all(a <= b for a, b in zip(spans, spans[1:], strict=False))
    return (spans[0][0], spans[-1][1]) if spans and in_order else None


def repaired(markdown: str, entries: list[tuple[int, str]], seams: list[dict], digest_of: Callable[[str], str | None] = lambda path: None) -> tuple[str, list[tuple]]:
    """The document with the seams whose content is the same taken over, and (start, end, status, reason) of each."""
    reports = []
    for seam in seams:
        start, end = seam["start"], seam["end"]
        if not seam["text"]:
            reports.append((start, end, REVIEW, NOT_READY))
            continue
        own = [(e["page"], e["text"]) for e in seam["entries"] or ()]
        old, new = region(markdown, entries, start, end), region(seam["text"], own, start, end)
        if not (old and new):
            reports.append((start, end, REVIEW, NOT_FOUND))
            continue
        now, then = markdown[slice(*old)], seam["text"][slice(*new)]
        if signature(now, digest_of) != signature(then, digest_of):
            reports.append((start, end, REVIEW, DIFFERENT))
            continue
        markdown = markdown[: old[0]] + then + markdown[old[1] :]
        reports.append((start, end, VERIFIED, SAME))
    return markdown, reports


_ENTRIES = "array<struct<page: int, text: string>>"


def seam_repair(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, text, reports: documents (key, text, entries, seams) with verified seams taken over.

    entries: array<struct<page, text>> of the merged text. seams: array<struct<start, end, text, entries>>,
    in order, text null where the seam was not parsed. All work is within a document.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        report = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("status", pa.string()), ("reason", pa.string())])
        for b in batches:
            texts, reports = [], []
            for text, entries, seams in zip(*(b.column(c).to_pylist() for c in ("text", "entries", "seams")), strict=True):
                made, told = repaired(text or "", [(e["page"], e["text"]) for e in entries or ()], seams or [])
                texts.append(made)
                reports.append([dict(zip(("start", "end", "status", "reason"), r, strict=True)) for r in told])
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array(texts, pa.string()), pa.array(reports, pa.list_(report))], names=[key, "text", "reports"])

    kind = documents.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, text string, reports array<struct<start: int, end: int, status: string, reason: string>>"
    return documents.select(key, "text", "entries", "seams").mapInArrow(run, schema)


def merged(parts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, pages, text, complete: the texts of a document's parts in page order.

    parts: key, first_page, end_page, text (null where a part's result isn't valid). A document whose parts
    leave a gap or overlap, or lack a result, is not complete and has no text.
    """
    before = Window.partitionBy(key).orderBy("first_page", "end_page")
    follows = F.col("first_page") == F.coalesce(F.lag("end_page").over(before), F.lit(0))
    checked = parts.withColumn("_ok", follows & F.col("text").isNotNull())
    texts = F.transform(F.array_sort(F.collect_list(F.struct("first_page", F.trim("text").alias("t")))), lambda x: x["t"])
    whole = checked.groupBy(key).agg(F.max("end_page").alias("pages"), F.array_join(texts, "\n\n").alias("_text"), F.bool_and("_ok").alias("complete"))
    return whole.select(key, "pages", F.when(F.col("complete"), F.concat("_text", F.lit("\n"))).alias("text"), "complete")


def run_of(wanted: str, keys: list[str], starts: list[int]) -> tuple[int, int] | None:
    """First and last place of the only run of consecutive ``keys`` that makes up ``wanted``.

    The keys are searched as one string; a hit counts where it starts and ends between keys.
    ``starts``: where each key begins in it, and its length at the end.
    """
    whole, found, at = "".join(keys), [], -1
    while wanted and (at := whole.find(wanted, at + 1)) >= 0:
        first = bisect_left(starts, at)
        last = bisect_left(starts, at + len(wanted))
        if starts[first] == at and last < len(starts) and starts[last] == at + len(wanted):
            same = [k for k in range(first, len(keys)) if starts[k] == at]
            found += [(k, last - 1) for k in same]
            if len(found) > 1:
                return None
    return found[0] if found else None


def merged_tables(units: DataFrame, tables: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, unit_id, pages: merged tables located as unique runs of the document's parsed tables.

    units: key, unit_id, location (the location key of the whole table). tables: key, pos, page, location of
    the parsed tables in order. One search of a document's tables for each unit; a unit whose content is
    no run, or several, has no row.
    """
    listed = F.array_sort(F.collect_list(F.struct("pos", "page", F.col("location").alias("k"))))
    by_doc = tables.groupBy(key).agg(listed.alias("_tables")).select(key, F.col("_tables.page").alias("_pages"), F.col("_tables.k").alias("_keys"))
    asked = units.groupBy(key).agg(F.collect_list(F.struct("unit_id", "location")).alias("_units"))
    unit_type = units.schema["unit_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for i, (pages, keys, wanted) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_pages", "_keys", "_units")), strict=True)):
                starts = [0]
                for k in keys:
                    starts.append(starts[-1] + len(k))
                for u in wanted:
                    if hit := run_of(u["location"] or "", keys, starts):
                        rows.append((i, u["unit_id"], sorted(set(pages[hit[0] : hit[1] + 1]))))
            at, ids, found = zip(*rows, strict=True) if rows else ((), (), ())
            ids = pa.array(ids, b.schema.field("_units").type.value_type.field("unit_id").type)
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(at, pa.int64())), ids, pa.array(found, pa.list_(pa.int32()))], names=[key, "unit_id", "pages"])

    kind = tables.schema[key].dataType.simpleString()
    joined = by_doc.withColumn("_pages", F.col("_pages").cast("array<int>")).join(asked, key)
    return joined.mapInArrow(run, f"{key} {kind}, unit_id {unit_type}, pages array<int>")


def boundary_hints(*hints: DataFrame) -> DataFrame:
    """book, page, rank: boundary hints of several sources, of one page the highest rank."""
    union = hints[0]
    for h in hints[1:]:
        union = union.unionByName(h)
    return union.groupBy("book", "page").agg(F.max("rank").alias("rank"))
