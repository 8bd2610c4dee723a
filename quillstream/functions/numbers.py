"""Numbers and dates of a text as a multiset, and their equality across languages.

Canonical form: a date as ``date:YYYY-MM-DD``; a number without thousands commas, plus sign,
leading zeros, exponent and trailing fractional zeros (1e3 is 1000). A multiple of ten keeps its
zeros, so that it can be reconciled with a written number.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, plain

#: Names of months (fixed values).
MONTHS = (
    ("january", "jan"), ("february", "feb"), ("march", "mar"), ("april", "apr"), ("may",), ("june", "jun"), ("july", "jul"),
    ("august", "aug"), ("september", "sept", "sep"), ("october", "oct"), ("november", "nov"), ("december", "dec"),
)
SMALL = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen"
).split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
DIGITS = "零一二三四五六七八九"
#: Chinese words that a written count stands before (fixed values).
COUNTED = "届名个位次轮台路秒分钟年小时天米维阶项"

_NAMES = "|".join(sorted((n for names in MONTHS for n in names), key=len, reverse=True))
#: Pattern and the groups of year, month and day.
DATES = (
    (rf"(?i)\b(\d{{1,2}})\s+({_NAMES})\.?\s+(\d{{4}}|\d{{2}})\b", 3, 2, 1),
    (rf"(?i)\b({_NAMES})\.?\s+(\d{{1,2}}),?\s+(\d{{4}}|\d{{2}})\b", 3, 1, 2),
    (r"(?<!\d)(\d{4}|\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日", 1, 2, 3),
)
NUMBER = r"(?<![A-Za-z0-9_])[-+]?\d+(?:[.,]\d+)*(?:[eE][-+]?\d+)?[%‰]?"


def _month_number(name: Column) -> Column:
    table = F.create_map(*(F.lit(x) for i, names in enumerate(MONTHS, 1) for n in names for x in (n, i)))
    return F.coalesce(F.call_function("try_element_at", table, F.lower(name)), name.try_cast("int"))


def _dates(text: Column, pattern: str, year: int, month: int, day: int) -> Column:
    """struct(dates, rest): canonical dates, and the text without them; impossible dates stay text."""

    def group(n: int) -> Column:
        return F.regexp_extract_all(text, F.lit(pattern), F.lit(n))

    def dated(x: Column) -> Column:
        digits = F.concat_ws("-", F.lpad(x["y"], 4, "0"), _month_number(x["m"]).cast("string"), x["d"])
        return F.struct(x["all"].alias("all"), F.call_function("try_to_date", digits, F.lit("yyyy-M-d")).alias("date"))

    def outcome(made: Column) -> Column:
        good, bad = F.filter(made, lambda x: x["date"].isNotNull()), F.filter(made, lambda x: x["date"].isNull())
        return F.struct(
            F.transform(good, lambda x: F.concat(F.lit("date:"), F.date_format(x["date"], "yyyy-MM-dd"))).alias("dates"),
            F.concat(F.regexp_replace(text, pattern, " "), F.lit(" "), F.array_join(F.transform(bad, lambda x: x["all"]), " ")).alias("rest"),
        )

    found = F.arrays_zip(group(0).alias("all"), group(year).alias("y"), group(month).alias("m"), group(day).alias("d"))
    none = F.struct(F.array().cast("array<string>").alias("dates"), text.alias("rest"))
    return F.when(text.rlike(pattern), let(F.transform(found, dated), outcome)).otherwise(none)


def canonical_number(token: Column) -> Column:
    def canonical(value: Column) -> Column:
        sign = F.regexp_extract(value, "^(-?)", 1)
        whole = F.regexp_replace(F.regexp_extract(value, r"^[-+]?(\d+)(?:\.\d+)?$", 1), r"^0+(?=\d)", "")
        fraction = F.regexp_replace(F.regexp_extract(value, r"^[-+]?\d+(\.\d+)?$", 1), r"\.?0+$", "")
        return F.when(value.rlike(r"^[-+]?\d+(\.\d+)?$"), F.concat(sign, whole, fraction)).otherwise(F.lower(value))

    value = F.regexp_replace(token, "[%‰]$", "")
    # Exponents beyond what a decimal of 38 digits holds stay as written.
    long = F.when(value.rlike(r"^[-+]?\d+(\.\d+)?[eE][-+]?\d+$"), value.try_cast("decimal(38,18)").cast("string"))
    value = F.coalesce(long, value)
    bare = F.when(value.rlike(r"^[-+]?\d{1,3}(,\d{3})+(\.\d+)?$"), F.replace(value, F.lit(","), F.lit(""))).otherwise(value)
    return F.concat(let(bare, canonical), F.regexp_extract(token, "([%‰]?)$", 1))


def _plain_numbers(text: Column) -> Column:
    rest = F.regexp_replace(text, r"(?<=\d)\s+(?=[%‰])", "")
    rest = F.regexp_replace(rest, r"(?<=\d)[xX](?=\d)", "×")
    rest = F.regexp_replace(F.regexp_replace(rest, "[−﹣]", "-"), r"(?<=\d)[–—](?=\d)", "-")
    return F.transform(F.regexp_extract_all(rest, F.lit(NUMBER), F.lit(0)), canonical_number)


def numbers(text: Column) -> Column:
    """array<string>: canonical dates and numbers, repeats included."""

    def staged(rest: Column, left: tuple) -> Column:
        if not left:
            return _plain_numbers(rest)
        (pattern, *groups), *more = left
        return let(_dates(rest, pattern, *groups), lambda found: F.concat(found["dates"], staged(found["rest"], tuple(more))))

    return let(plain(text), lambda bare: staged(bare, DATES))


#: English number words below 100, one or two of them; Chinese ones before a counted word.
ENGLISH = rf"(?i)\b(?:(?:{'|'.join(TENS)})(?:[-\s]+(?:{'|'.join(SMALL[1:10])})\b)?|{'|'.join(sorted(SMALL, key=len, reverse=True))})\b"
CHINESE = rf"(?<![{DIGITS}十百千万\d])([{DIGITS[2:]}]?十[{DIGITS[1:]}]?|[{DIGITS}])(?=[{COUNTED}])"
VALUES = dict(zip([*SMALL, *TENS], [*range(20), *range(20, 100, 10)], strict=True))


def written_numbers(text: Column) -> Column:
    """array<string>: the numbers below 100 that stand written out, repeats included.

    One search for each language. "twenty-one" is 21, and 20 and 1 as well, as the words are all there.
    """
    table = F.create_map(*(F.lit(x) for pair in VALUES.items() for x in pair))

    def english(found: Column) -> Column:
        values = F.transform(F.split(F.lower(found), r"[-\s]+"), lambda w: F.call_function("try_element_at", table, w))
        return F.when(F.size(values) > 1, F.concat(values, F.array(values[0] + values[1]))).otherwise(values)

    def chinese(found: Column) -> Column:
        digit = lambda c: F.call_function("locate", c, F.lit(DIGITS)) - 1
        before, after = F.substring_index(found, "十", 1), F.substring_index(found, "十", -1)
        tens = F.when(before == "", F.lit(1)).otherwise(digit(before))
        units = F.when(after == "", F.lit(0)).otherwise(digit(after))
        return F.when(found.contains("十"), tens * 10 + units).otherwise(digit(found))

    words = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(ENGLISH), F.lit(0)), english))
    signs = F.transform(F.regexp_extract_all(text, F.lit(CHINESE), F.lit(1)), chinese)
    return F.transform(F.concat(words, signs), lambda n: n.cast("string"))


def written_count(text: Column, token: Column) -> Column:
    """How often the number below 100 stands written out in the text; 0 for other tokens."""
    return F.size(F.filter(written_numbers(text), lambda n: n == token))


#: Stands between an element and its number among equal ones.
_MARK = "\u0001"


def _numbered(items: Column) -> Column:
    """Sorted strings, equal ones told apart by their numbers from 1. Linear after the sort."""

    def runs(s: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
        ends = let(starts, lambda a: F.arrays_zip(a.alias("i"), F.concat(F.slice(a, 2, F.size(a)), F.array(F.size(s))).alias("j")))
        each = lambda r: F.transform(F.sequence(F.lit(1), r["j"] - r["i"]), lambda k: F.concat(F.get(s, r["i"]), F.lit(_MARK), k.cast("string")))
        return F.flatten(F.transform(ends, each))

    return F.when(F.size(items) > 0, let(F.array_sort(items), runs)).otherwise(F.array().cast("array<string>"))


def surplus(left: Column, right: Column) -> Column:
    """Multiset difference: the elements of ``left`` that ``right`` hasn't, each as often as it has more.

    Equal elements are numbered on both sides, so that a set difference by hash does it.
    """
    rest = F.array_except(_numbered(left), _numbered(right))
    return F.array_sort(F.transform(rest, lambda x: F.substring_index(x, _MARK, 1)))


def equivalent_numbers(source: Column, target: Column, of_source: Column, of_target: Column) -> Column:
    """Do both texts have the same numbers, counting written-out ones where they differ?

    of_source, of_target: the results of ``numbers``, as columns of their own.
    """

    def reconciled(left: Column, right: Column, other: Column) -> Column:
        return F.size(surplus(surplus(left, right), written_numbers(other))) == 0

    same = F.array_sort(of_source) == F.array_sort(of_target)
    return same | (reconciled(of_source, of_target, target) & reconciled(of_target, of_source, source))
