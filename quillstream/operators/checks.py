"""Deterministic integrity checks of translations: rules, categories, suggestions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import equivalent_numbers, numbers, surplus
from ..functions.text import TOKEN, let, plain

#: Messages of the rules and names of the categories (fixed values).
NUMBERS_CHANGED = "数字可能发生变化"
UNTRANSLATED = "疑似整段未翻译"
TOO_SHORT = "译文异常短，可能漏译"
TOO_LONG = "译文异常长，可能增加内容"
EMPTY, MARKS, DAMAGED, OUTSIDE, BLANK_BLOCK, LEVELS = "empty", "marks", "damaged mark", "text outside blocks", "empty block", "heading levels"
CATEGORIES = (("完整性与结构", 0), ("数值与单位", 1), ("术语", 2), ("翻译疑点", 3), ("一般信息", 4))


def with_concerns(pairs: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """Adds ``concerns``: the soft rules that a pair of texts breaks, in their order."""
    s, t = F.col("_s"), F.col("_t")
    # Generators keep the optimizer from computing the numbers and the rules once more for
    # every place that names them, filters above included.
    staged = pairs.withColumns({"_s": plain(F.col(source)), "_t": plain(F.col(target))})
    staged = staged.select("*", F.inline(F.array(F.struct(numbers(s).alias("_ns"), numbers(t).alias("_nt")))))
    long = F.length(s) >= 120
    rules = F.array(
        F.when(~equivalent_numbers(s, t, F.col("_ns"), F.col("_nt")), F.lit(NUMBERS_CHANGED)),
        F.when((F.regexp_count(s, F.lit("[A-Za-z]{2,}")) >= 6) & ~t.rlike("[\\u4e00-\\u9fff]"), F.lit(UNTRANSLATED)),
        F.when(long & (F.length(t) < F.length(s) * F.lit(0.12)), F.lit(TOO_SHORT)),
        F.when(long & (F.length(t) > F.length(s) * 2), F.lit(TOO_LONG)),
    )
    return staged.select(*pairs.columns, F.explode(F.array(F.array_compact(rules))).alias("concerns"))


def category_rank(reasons: Column, kind: Column) -> Column:
    """Rank 0 to 4 of a set of reasons: structure, numbers, terms, doubt, information."""

    def says(*words: str) -> Column:
        return F.exists(reasons, lambda r: r.rlike("|".join(words)))

    return (
        F.when((kind == "omission") | says("遗漏", "结构", "对应", "未完成", "失败"), 0)
        .when(says("数字", "数值"), 1)
        .when(says("术语"), 2)
        .when(F.size(reasons) > 0, 3)
        .otherwise(4)
    )


def category(rank: Column) -> Column:
    out = F.lit(CATEGORIES[-1][0])
    for name, r in CATEGORIES[:-1]:
        out = F.when(rank == r, F.lit(name)).otherwise(out)
    return out


def suggestion_kind(reason: Column) -> Column:
    """Which advice a reason calls for: numbers, formula, omission, translation, review."""
    return (
        F.when(reason.contains("数字"), "numbers")
        .when(reason.rlike("公式|标记"), "formula")
        .when(reason.contains("遗漏"), "omission")
        .when(reason.rlike("未翻译|术语"), "translation")
        .otherwise("review")
    )


def issue_detail(reasons: Column, of_source: Column, of_target: Column) -> Column:
    """Reasons, and where numbers differ which are missing and which are new."""
    numeric = F.exists(reasons, lambda r: r.rlike("数字|数值"))

    def listed(label: str, rest: Column) -> Column:
        text = lambda x: F.when(F.size(x) > 0, F.concat(F.lit(label), F.array_join(x, "、")))
        return F.when(numeric, let(rest, text))

    missing = listed("原文有而现译缺少：", surplus(of_source, of_target))
    extra = listed("现译新增或不同：", surplus(of_target, of_source))
    return F.concat_ws("；", reasons, missing, extra)


def structure_violations(source: Column, target: Column) -> Column:
    """Hard rules on protected texts that a target breaks: names of the rules."""
    marks = lambda t: F.regexp_extract_all(t, F.lit(TOKEN), F.lit(0))
    block = r"(?s)\[\[\[TP_BEGIN_\d+\]\]\](.*?)\[\[\[TP_END_\d+\]\]\]"
    bodies = lambda t: F.regexp_extract_all(t, F.lit(block), F.lit(1))
    levels = lambda t: F.regexp_extract_all(t, F.lit(r"(?m)^(#{1,6})\s+"), F.lit(1))
    pairs = F.arrays_zip(bodies(source).alias("s"), bodies(target).alias("t"))
    both = F.filter(pairs, lambda p: p["s"].isNotNull() & p["t"].isNotNull())
    return F.array_compact(
        F.array(
            F.when(F.trim(target) == "", F.lit(EMPTY)),
            F.when(marks(source) != marks(target), F.lit(MARKS)),
            F.when(F.regexp_replace(target, TOKEN, "").contains("[[[TP_"), F.lit(DAMAGED)),
            F.when((F.size(bodies(source)) > 0) & F.regexp_replace(target, block, "").rlike(r"\S"), F.lit(OUTSIDE)),
            F.when(F.exists(both, lambda p: p["s"].rlike(r"\S") & ~p["t"].rlike(r"\S")), F.lit(BLANK_BLOCK)),
            F.when(F.exists(both, lambda p: levels(F.trim(p["s"])) != levels(F.trim(p["t"]))), F.lit(LEVELS)),
        )
    )
