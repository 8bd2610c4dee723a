"""Page parts of long documents: planning by boundaries, states of their parses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .windows import numbered

#: States of a part, the furthest last (fixed values).
STATES = ("new", "waiting-file", "uploaded", "pending", "running", "converting", "done", "failed")


def plan(boundaries: DataFrame, book: str = "book", largest: int = 200, target: int = 128, smallest: int = 64) -> DataFrame:
    """book, part_no, start, end, reason: parts of at most ``largest`` pages.

    boundaries: book, pages, page, rank (higher is better). A part ends at the boundary of the
    best rank between ``smallest`` and ``largest`` pages, of those the nearest to ``target``;
    without one, after ``target`` pages. One fold per book over its parts.
    """
    hints = F.filter(F.collect_list(F.struct("page", "rank")), lambda h: h["page"].isNotNull() & h["rank"].isNotNull())
    books = boundaries.groupBy(book).agg(F.max("pages").alias("pages"), hints.alias("hints"))
    steps = F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("pages") / smallest).cast("int")))
    start = F.expr("named_struct('at', 0, 'out', cast(array() as array<struct<start: int, end: int, reason: string>>))")

    def step(s: Column, _: Column) -> Column:
        at = s["at"]
        fits = F.filter("hints", lambda h: (h["page"] >= at + smallest) & (h["page"] <= F.least(at + largest, F.col("pages"))))
        best = F.array_max(F.transform(fits, lambda h: F.struct(h["rank"].alias("rank"), (-F.abs(h["page"] - at - target)).alias("near"), h["page"].alias("page"))))
        ends = F.col("pages") - at <= largest
        end = F.when(ends, F.col("pages")).when(best.isNotNull(), best["page"]).otherwise(F.least(at + target, F.col("pages"))).cast("int")
        reason = F.when(ends, "end").when(best.isNotNull(), F.concat(F.lit("rank "), best["rank"])).otherwise("limit")
        part = F.struct(at.alias("start"), end.alias("end"), reason.alias("reason"))
        done = at >= F.col("pages")
        return F.struct(F.when(done, at).otherwise(end).alias("at"), F.when(done, s["out"]).otherwise(F.concat(s["out"], F.array(part))).alias("out"))

    out = books.select(book, F.posexplode(F.aggregate(steps, start, step, lambda s: s["out"])).alias("part_no", "p"))
    return out.select(book, "part_no", "p.start", "p.end", "p.reason")


def split_by_size(parts: DataFrame, pages: DataFrame, limit: int, book: str = "book") -> DataFrame:
    """book, part_no, piece, start, end, bytes: parts cut so that no piece is larger than ``limit`` by measured pages.

    parts: book, part_no, start, end. pages: book, page, bytes. A piece ends before the page that would
    exceed the limit; a single larger page is a piece of its own.
    """
    inside = parts.join(pages, book).filter((F.col("page") >= F.col("start")) & (F.col("page") < F.col("end")))
    listed = inside.groupBy(book, "part_no").agg(F.array_sort(F.collect_list(F.struct("page", F.col("bytes").cast("long").alias("bytes")))).alias("p"))

    def pieces(sizes) -> list[int]:
        out, size, number = [], 0, 0
        for b in sizes:
            if size and size + b > limit:
                size, number = 0, number + 1
            size += b
            out.append(number)
        return out

    placed = listed.select(book, "part_no", "p", numbered(pieces, F.col("p.bytes")).alias("piece"))
    rows = placed.select(book, "part_no", F.explode(F.arrays_zip("p", "piece")).alias("x")).select(book, "part_no", "x.p.*", "x.piece")
    return rows.groupBy(book, "part_no", "piece").agg(F.min("page").alias("start"), (F.max("page") + 1).alias("end"), F.sum("bytes").alias("bytes"))


def rank_of(state: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, STATES)), state)


def current_state(events: DataFrame, part: str, state: str, order: list[str]) -> DataFrame:
    """part, state, poisoned: the last state; a submission whose outcome is unknown is never replayed."""
    last = F.max_by(state, F.struct(*order))
    unknown = F.bool_or(F.col(state) == "submission_unknown")
    return events.groupBy(part).agg(last.alias("state"), unknown.alias("poisoned")).withColumn("replay", ~F.col("poisoned") & (F.col("state") != "done"))
