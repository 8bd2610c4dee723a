"""Scalar text functions as column expressions; all but ``unescaped`` stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from html import unescape

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Script characters and their raised and lowered forms (fixed values).
RAISED_FROM, RAISED_TO = "0123456789+-=()abcdefghijklmnoprstuvwxyz", "⁰¹²³⁴⁵⁶⁷⁸⁹⁺⁻⁼⁽⁾ᵃᵇᶜᵈᵉᶠᵍʰⁱʲᵏˡᵐⁿᵒᵖʳˢᵗᵘᵛʷˣʸᶻ"
LOWERED_FROM, LOWERED_TO = "0123456789+-=()aehijklmnoprstuvx", "₀₁₂₃₄₅₆₇₈₉₊₋₌₍₎ₐₑₕᵢⱼₖₗₘₙₒₚᵣₛₜᵤᵥₓ"
#: Marks that stand for protected fragments (fixed format).
TOKEN = r"\[\[\[TP_[A-Z]+_\d+\]\]\]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normalize_source(text: Column) -> Column:
    """No byte order mark, line feeds only, no blanks at line ends."""
    unix = F.regexp_replace(F.regexp_replace(text, "\ufeff", ""), "\r\n?", "\n")
    return F.regexp_replace(unix, r"[ \t]+(?=\n|\z)", "")


def normalize_abstract_heading(text: Column) -> Column:
    """A line ``Abstract ...`` becomes a level-2 heading and its body."""
    alone = F.regexp_replace(text, r"(?im)^abstract[ \t]*$", "## 摘要")
    return F.regexp_replace(alone, r"(?im)^abstract\s+(.+)$", "## 摘要\n\n$1")


def extract_title(text: Column) -> Column:
    """The first level-1 heading without formulas and characters that paths can't hold, 60 at most."""
    first = F.regexp_extract(text, r"(?m)^\s*# (.*)$", 1)
    bare = F.trim(F.regexp_replace(F.trim(first), r"\$[^$]+\$", ""))
    safe = F.substring(F.regexp_replace(bare, r'[\\{}<>:"/|?*]', ""), 1, 60)
    return F.when(F.length(safe) > 0, safe).otherwise(F.lit("translated"))


def unwrap_fence(text: Column) -> Column:
    """The inside of a text that is one fenced block."""
    whole = F.trim(text)
    inner = F.regexp_extract(whole, r"(?is)^```(?:markdown|md|text)?\s*(.*?)```$", 1)
    return F.when(whole.rlike(r"(?is)^```(?:markdown|md|text)?\s*.*?```$"), F.regexp_replace(inner, r"^\s+|\s+$", "")).otherwise(whole)


def clean_latex(text: Column) -> Column:
    """The text as it is: formulas are made readable where they are shown, not here."""
    return text


def unit_id(prefix: str, number: Column, digits: int) -> Column:
    """A running number as an identifier, as ``b000012``."""
    return F.format_string(f"{prefix}%0{digits}d", number)


def normalize_line(text: Column) -> Column:
    """One blank between words, none around, no-break spaces included."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\u00a0", " "), r"(?U)\s+", " "))


@F.pandas_udf(StringType())
def unescaped(text: pd.Series) -> pd.Series:
    """Character references of HTML resolved, all of them; in Arrow batches."""
    return text.map(unescape, na_action="ignore")


def location_key(text: Column) -> Column:
    """Text without tags, heading marks and white space, character references resolved."""
    bare = unescaped(F.regexp_replace(text, "<[^>]+>", " "))
    return F.regexp_replace(F.regexp_replace(bare, r"(?m)^#{1,6}\s+", ""), r"(?U)\s+", "")


def normalize_cell(text: Column) -> Column:
    blanks = F.regexp_replace(text, r"[ \t\r\f\x0B]+", " ")
    return F.regexp_replace(F.regexp_replace(blanks, r"\n\s*", "\n"), r"^\s+|\s+$", "")


def term_key(text: Column) -> Column:
    """Terms compare in lower case with single blanks."""
    return F.lower(F.trim(F.regexp_replace(text, r"(?U)\s+", " ")))


def plain(text: Column) -> Column:
    """No protected marks, URLs and tags."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, TOKEN, " "), r"https?://\S+|<[^>]+>", " "))


def raised(text: Column) -> Column:
    return F.translate(text, RAISED_FROM, RAISED_TO)


def lowered(text: Column) -> Column:
    return F.translate(text, LOWERED_FROM, LOWERED_TO)


def strip_math(text: Column) -> Column:
    """The inside of a formula in one of the four kinds of delimiters."""
    whole = F.trim(text)
    out = whole
    for pattern in (r"(?s)^\\\((.*)\\\)$", r"(?s)^\\\[(.*)\\\]$", r"(?s)^\$(.*)\$$", r"(?s)^\$\$(.*)\$\$$"):
        out = F.when(whole.rlike(pattern), F.trim(F.regexp_extract(whole, pattern, 1))).otherwise(out)
    return out


def estimated_tokens(text: Column) -> Column:
    """Bytes in UTF-8: on the safe side for any tokenizer."""
    return F.octet_length(text)


def needs_translation(text: Column) -> Column:
    return (F.length(F.trim(text)) >= 2) & text.rlike("[A-Za-z]{2,}")


def json_array(text: Column) -> Column:
    """The outermost array in an answer that may hold more than it."""
    return F.regexp_extract(unwrap_fence(text), r"(?s)(\[.*\])", 1)


def first_json_value(text: Column, *paths: str) -> Column:
    """The first of the dotted keys whose value isn't empty."""
    return F.coalesce(*(F.nullif(F.get_json_object(text, f"$.{p}"), F.lit("")) for p in paths))


def endpoint(base: Column, path: str) -> Column:
    """``base`` without trailing slashes and with ``path``, once."""
    bare = F.regexp_replace(F.trim(base), "/+$", "")
    return F.when(bare.endswith(path), bare).otherwise(F.concat(bare, F.lit(path)))


def strip_control(text: Column) -> Column:
    """No characters that XML can't hold."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")


def safe_stem(text: Column, size: int = 40) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r'[<>:"/\\|?*\x00-\x1F]', "_")), 1, size)


def redact(text: Column, secrets: list[str]) -> Column:
    """Bearer values and the given secrets as stars."""
    out = F.regexp_replace(text, r"(?i)(bearer\s+)\S+", "$1***")
    for secret in secrets:
        if secret:
            out = F.replace(out, F.lit(secret), F.lit("***"))
    return out


def public_links(text: Column) -> Column:
    """Relative image links of an internal document as they stand in the published one."""
    return F.regexp_replace(text, r"(!\[[^\]]*\]\()(?!https?:|/|_internal/)([^)]+\))", "$1_internal/$2")


def fingerprint(*values: Column) -> Column:
    """SHA-256 of the values as a JSON array."""
    return F.sha2(F.to_json(F.array(*(v.cast("string") for v in values))).cast("binary"), 256)


def inline_artifacts(text: Column) -> Column:
    """Names of the inline leftovers in a text: script tags, LaTeX commands, formulas."""
    return F.array_compact(
        F.array(
            F.when(text.rlike(r"(?i)<\s*/?\s*(sup|sub)\b"), F.lit("html_script")),
            F.when(text.rlike(r"\\(mathrm|operatorname|frac|dot|text|mathbf|mathit)\b"), F.lit("latex_command")),
            F.when(text.rlike(r"(?<!\\)\$(?!\$)(?:\\.|[^\n$\\])+(?<!\\)\$"), F.lit("math_span")),
        )
    )


def progress_stage(line: Column) -> Column:
    """Stage that a line of the parser's log speaks of, else null."""
    bare = F.regexp_replace(line, r"\x1b\[[0-9;]*[A-Za-z]", "")
    return (
        F.when(bare.rlike(r"(?i)Processed\s+\d+/\d+\s+pages"), "页面解析")
        .when(bare.rlike("(?i)model|loading|initialize|turbomind"), "加载模型")
        .when(bare.rlike("(?i)OCR|Processing pages|Submitting batch"), "页面解析")
        .when(bare.rlike("(?i)output|markdown|visualiz|export"), "导出解析结果")
    )


def column_need(text: Column, span: Column) -> Column:
    """Width in cm that the longest unbreakable word of a table cell asks of each column it spans."""
    words = F.regexp_extract_all(F.regexp_replace(text, "<[^>]+>", ""), F.lit(r"([A-Za-z0-9_.%+-]+|[^\x00-\x7f])"), F.lit(1))
    longest = F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(1))
    return F.least(F.lit(5.0), F.greatest(F.lit(0.9), longest * 0.14 + 0.35)) / span
