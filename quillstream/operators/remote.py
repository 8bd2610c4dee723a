"""The remote operator: translation by a service, each distinct text once, answers checked.

A translator is any callable from texts to as many texts. It is called only for distinct
texts that need it and that no former answer in the cache covers; answers join back to all
places. A batch whose answer has the wrong size is halved; a single text that fails its check
is asked again, and kept as it is if that fails too. Keys are digests of content, so that a
retried task asks for the same and the cache makes it harmless. Errors of the service itself
end the task at once: they aren't retried text by text.
"""

from __future__ import annotations

import contextlib
import json
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from email.utils import parsedate_to_datetime

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html_tables as H
from ..functions import inline, leftovers
from ..functions.blocks import blocks
from ..functions.text import fingerprint, needs_translation
from .issues import editable, guarded_edits
from .terms import within_budget
from .texts import table_cells

Translator = Callable[[list[str]], list[str]]
#: Texts and characters of one request.
ITEMS, CHARS = 32, 3_500


class ServiceError(RuntimeError):
    """Of the service, not of an answer: authentication, network, quota."""


def stub(texts: list[str]) -> list[str]:
    """A deterministic stand-in for a service."""
    return [f"译:{t}" for t in texts]


def faithful(source: str, target: str) -> bool:
    """Has an answer the numbers and the protected marks of its source?"""
    marks = lambda t: re.findall(r"\[\[\[TP_[A-Z]+_\d+\]\]\]", t)
    return bool(target.strip()) and marks(source) == marks(target) and Counter(re.findall(r"\d+", source)) == Counter(re.findall(r"\d+", target))


def resilient(texts: list[str], translate: Translator, check: Callable[[str, str], bool] = faithful) -> list[tuple[str, bool]]:
    """Answers, and whether they passed: the good are kept, the bad asked again alone, misfits halved."""
    if not texts:
        return []
    answers = translate(texts)
    if len(answers) != len(texts):
        if len(texts) == 1:
            return [(texts[0], False)]
        half = len(texts) // 2
        return resilient(texts[:half], translate, check) + resilient(texts[half:], translate, check)
    out = []
    for text, answer in zip(texts, answers, strict=True):
        if not check(text, answer):
            again = translate([text])
            answer = again[0] if len(again) == 1 and check(text, again[0]) else None
        out.append((text, False) if answer is None else (answer, True))
    return out


def packed(texts: list[str], items: int = ITEMS, chars: int = CHARS) -> Iterator[list[str]]:
    batch, size = [], 0
    for t in texts:
        if batch and (len(batch) >= items or size + len(t) > chars):
            yield batch
            batch, size = [], 0
        batch.append(t)
        size += len(t)
    if batch:
        yield batch


def translate_texts(df: DataFrame, text: str, translator: Translator = stub, cache: DataFrame | None = None, partitions: int | None = None) -> DataFrame:
    """``df`` with ``translated`` and ``ok``; texts that need no translation stay as they are.

    cache: key, translated of former answers. ``partitions`` of the distinct texts: by default as many
    as the shuffle has. How many requests run at one time is the number of cores given to the stage, not the
    number of partitions; a lost task asks for its own partition's texts again.
    """
    keyed = df.withColumn("_key", F.when(needs_translation(F.col(text)), fingerprint(F.col(text))))
    wanted = keyed.filter("_key is not null").select("_key", F.col(text).alias("_text")).dropDuplicates(["_key"])
    known = None
    if cache is not None:
        known = cache.select(F.col("key").alias("_key"), F.col("translated").alias("_answer"), F.lit(True).alias("_ok"))
        wanted = wanted.join(known, "_key", "left_anti")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            at = 0
            for batch in packed(b["_text"].tolist()):
                rows = resilient(batch, translator)
                keys = b["_key"].iloc[at : at + len(batch)].tolist()
                at += len(batch)
                yield pd.DataFrame({"_key": keys, "_answer": [a for a, _ in rows], "_ok": [o for _, o in rows]})

    dealt = wanted.repartition(partitions, "_key") if partitions else wanted
    answers = dealt.mapInPandas(ask, "_key string, _answer string, _ok boolean")
    if known is not None:
        answers = answers.unionByName(known)
    joined = keyed.join(answers, "_key", "left")
    return joined.withColumns({"translated": F.coalesce("_answer", text), "ok": F.coalesce("_ok", F.lit(True))}).drop("_key", "_answer", "_ok")


def new_cache_rows(translated: DataFrame, text: str) -> DataFrame:
    """key, translated to add to the cache; empty and failed answers never enter it."""
    good = translated.filter(F.col("ok") & needs_translation(F.col(text)) & (F.trim("translated") != ""))
    return good.select(fingerprint(F.col(text)).alias("key"), "translated").dropDuplicates(["key"])


#: Version of the cache's rows (fixed value).
CACHE_VERSION = 2


def cache_entries(answers: DataFrame) -> DataFrame:
    """key, version, text, sha256 of answers (key, text) to keep; empty ones are refused."""
    kept = answers.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    return kept.select("key", F.lit(CACHE_VERSION).alias("version"), "text", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"))


def sound_entries(cache: DataFrame) -> DataFrame:
    """key, translated of the cache's entries whose version and digest hold; others are misses."""
    digest = F.sha2(F.col("text").cast("binary"), 256)
    sound = (F.col("version") == CACHE_VERSION) & (F.trim("text") != "") & (F.col("sha256") == digest)
    return cache.filter(sound).select("key", F.col("text").alias("translated"))


def segment_results(done: DataFrame, key: str) -> DataFrame:
    """key, output_hash, status of translated segments (``translate_segments``): what a resumed job compares with."""
    status = F.when(~F.col("ok"), "failed").when(F.size("warnings") > 0, "needs_review").otherwise("completed")
    return done.select(key, F.sha2(F.col("translated").cast("binary"), 256).alias("output_hash"), status.alias("status"))


class Unavailable(ServiceError):
    """An answer of the service that says no: status, and whether a later try may succeed."""

    def __init__(self, message: str, status: int | None = None, transient: bool = False) -> None:
        super().__init__(message)
        self.status, self.transient = status, transient


#: Tries of one request, and bounds of the wait between them in seconds (fixed values).
TRIES, SHORTEST_WAIT, LONGEST_WAIT = 3, 1.0, 60.0


def wait_of(retry_after: str | None, attempt: int, now: float) -> float:
    """Seconds to wait: what the service asks for, as a number or a date, else doubling; within bounds."""
    seconds = 2.0**attempt
    if retry_after:
        try:
            seconds = float(retry_after)
        except ValueError:
            with contextlib.suppress(TypeError, ValueError, OverflowError):
                seconds = parsedate_to_datetime(retry_after).timestamp() - now
    return min(LONGEST_WAIT, max(SHORTEST_WAIT, seconds))


def requested(send: Callable[[], tuple[int, dict[str, str], bytes]], tries: int = TRIES, sleep: Callable[[float], None] = time.sleep, clock: Callable[[], float] = time.time, body=None) -> bytes:
    """The body of a successful answer to ``send`` () -> (status, headers, body).

    Lost connections, 429 and 5xx are tried again, others not. A stream ``body`` is rewound before
    every try. The wait between tries follows Retry-After.
    """
    start = body.tell() if hasattr(body, "seek") else None
    for attempt in range(tries):
        if start is not None:
            body.seek(start)
        last = attempt + 1 == tries
        try:
            status, headers, content = send()
        except (ConnectionError, TimeoutError) as error:
            if last:
                raise Unavailable("the connection was lost", transient=True) from error
            sleep(2.0**attempt)
            continue
        if 200 <= status < 300:
            return content
        transient = status == 429 or status >= 500
        if not transient or last:
            raise Unavailable(f"the service answered {status}", status, transient)
        named = {k.lower(): v for k, v in headers.items()}
        sleep(wait_of(named.get("retry-after"), attempt, clock()))
    raise ValueError("tries must be positive")


@dataclass
class Chat:
    """A translator over a chat-completion service; ``post`` (url, headers, payload) -> (status, headers, body) does the transport."""

    post: Callable[[str, dict[str, str], bytes], tuple[int, dict[str, str], bytes]]
    url: str
    key: str
    model: str
    system: str = "Translate every item of the JSON array. Answer with a JSON array of as many items."
    budget: int = 32_768
    reserve: int = 8_192
    temperature: float = 0.0

    def complete(self, user: str) -> str:
        """The answer's text. Prompts over the budget aren't sent; cut, filtered and empty answers are errors."""
        size = len((self.system + user).encode())
        if size + self.reserve > self.budget:
            raise ValueError(f"a prompt of {size} bytes is over the budget")
        messages = [{"role": "system", "content": self.system}, {"role": "user", "content": user}]
        payload = json.dumps({"model": self.model, "temperature": self.temperature, "messages": messages}, ensure_ascii=False).encode()
        headers = {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}
        choice = json.loads(requested(lambda: self.post(self.url, headers, payload)))["choices"][0]
        if choice.get("finish_reason") in ("length", "content_filter"):
            raise ValueError(f"the answer ended by {choice['finish_reason']}")
        content = choice["message"].get("content")
        if isinstance(content, list):
            content = "".join(p.get("text", "") for p in content if isinstance(p, dict))
        if not (content or "").strip():
            raise ValueError("an empty answer")
        return content

    def __call__(self, texts: list[str]) -> list[str]:
        answer = self.complete(json.dumps(texts, ensure_ascii=False))
        cut = answer[answer.find("[") : answer.rfind("]") + 1]
        items = json.loads(cut) if cut else None
        return [str(x) for x in items] if isinstance(items, list) else []


# ---------------------------------------------------------------- segments

_BLOCK = re.compile(r"\[\[\[TP_BEGIN_\d+\]\]\][\s\S]*?\[\[\[TP_END_\d+\]\]\]")
_INSIDE = re.compile(r"\[\[\[TP_BEGIN_\d+\]\]\]([\s\S]*?)\[\[\[TP_END_\d+\]\]\]")
_MARKS = re.compile(r"\[\[\[TP_[A-Z]+_\d+\]\]\]")
#: Tries of a segment; the blocks under suspicion alone are sent from the second on (fixed value).
SEGMENT_TRIES = 3


def protected_segment(segment: str) -> tuple[list[str], dict[str, str]]:
    """The blocks of a segment between begin and end marks, fragments under protection; references and code as wholes."""
    values: dict[str, str] = {}
    out = []
    for block in blocks(segment):
        begin = inline.Protected("", values).keep("BEGIN", "")
        kept = inline.Protected("", values)
        body = kept.keep(block.kind.upper(), block.text) if block.kind in ("reference", "code") else inline.protect(block.text, values).text
        out.append(f"{begin}\n{body}\n{inline.Protected('', values).keep('END', '')}")
    return out, values


def intact(source: str, target: str) -> bool:
    """Has an answer the marks of its source in order, nothing damaged, nothing outside blocks, no block emptied?"""
    if _MARKS.findall(source) != _MARKS.findall(target) or "[[[TP_" in _MARKS.sub("", target) or _BLOCK.sub("", target).strip():
        return False
    pairs = zip(_INSIDE.findall(source), _INSIDE.findall(target), strict=True)
    levels = re.compile(r"(?m)^(#{1,6})\s+")
    return all((not s.strip() or t.strip()) and levels.findall(s.strip()) == levels.findall(t.strip()) for s, t in pairs)


@dataclass
class Segment:
    """A translated segment: its text, the pairs of its blocks, what stays suspicious, the requests made."""

    text: str
    pairs: list[tuple[str, str, str]]
    warnings: list[str]
    requests: int
    protected: str


def _finished(segment: str, found: list[str], values: dict[str, str], suspicious: Callable[[str, str], list[str]], sources: list[str], requests: int) -> Segment:
    texts = [inline.restore(_INSIDE.match(b)[1].strip(), values).strip() for b in found]
    pairs = [(b.kind, b.text, t) for b, t in zip(blocks(segment), texts, strict=True)]
    warnings = [f"{i + 1}: {w}" for i, (s, t) in enumerate(zip(sources, found, strict=True)) for w in suspicious(s, t)]
    return Segment("\n\n".join(texts), pairs, warnings, requests, "\n\n".join(found))


def translate_segment(segment: str, translate: Translator | None, suspicious: Callable[[str, str], list[str]], cached: str | None = None) -> Segment | None:
    """A segment through a translator; null if no answer keeps its structure.

    A cached protected answer that is intact is taken. Else the whole segment is asked for; the blocks that
    then are suspicious are asked for once more, alone, and each is replaced only if that makes it less
    so. Without a translator a miss of the cache is null.
    """
    sources, values = protected_segment(segment)
    whole = "\n\n".join(sources)
    if cached is not None and intact(whole, cached):
        return _finished(segment, _BLOCK.findall(cached), values, suspicious, sources, 0)
    if not re.search("[A-Za-z]{2,}", _MARKS.sub("", whole)):
        return _finished(segment, sources, values, suspicious, sources, 0)
    if translate is None:
        return None
    best, requests = None, 0
    for _ in range(SEGMENT_TRIES):
        requests += 1
        answers = translate([whole])
        if len(answers) == 1 and intact(whole, answers[0]):
            best = _BLOCK.findall(answers[0])
            break
    if best is None:
        return None
    again = [i for i, (s, t) in enumerate(zip(sources, best, strict=True)) if suspicious(s, t)]
    if again and requests < SEGMENT_TRIES:
        requests += 1
        chosen = "\n\n".join(sources[i] for i in again)
        answers = translate([chosen])
        if len(answers) == 1 and intact(chosen, answers[0]):
            for i, new in zip(again, _BLOCK.findall(answers[0]), strict=True):
                if len(suspicious(sources[i], new)) < len(suspicious(sources[i], best[i])):
                    best[i] = new
    return _finished(segment, best, values, suspicious, sources, requests)


def leftover(source: str, target: str) -> list[str]:
    """What is suspicious about a block by itself: lost or new digits, English left over."""
    digits = lambda t: Counter(re.findall(r"\d+", _MARKS.sub("", t)))
    return ["numbers"] * (digits(source) != digits(target)) + leftovers.english_phrases(_MARKS.sub(" ", target))


SEGMENTS = "translated string, protected string, ok boolean, requests int, warnings array<string>, pairs array<struct<kind: string, source: string, target: string>>"


def translate_segments(df: DataFrame, key: str, text: str, translator: Translator | None = stub, cache: DataFrame | None = None, suspicious: Callable[[str, str], list[str]] = leftover, partitions: int | None = None) -> DataFrame:
    """key, translated, protected, ok, requests, warnings, pairs of every segment.

    cache: key (of the segment, ``segment_key``), protected. Without a translator only the cache answers: an
    offline recovery of alignments, misses being not ok. Segments that failed keep their text.
    """
    keyed = df.select(key, F.col(text).alias("_text"), segment_key(F.col(text)).alias("_key"))
    former = (cache if cache is not None else df.sparkSession.createDataFrame([], "key string, protected string")).select(F.col("key").alias("_key"), F.col("protected").alias("_cached"))
    joined = keyed.join(former.dropDuplicates(["_key"]), "_key", "left").drop("_key")
    joined = joined.repartition(partitions, key) if partitions else joined
    names = [key, *(c.split()[0] for c in ("translated", "protected", "ok", "requests", "warnings", "pairs"))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, segment, cached in zip(b[key], b["_text"], b["_cached"], strict=True):
                done = translate_segment(segment or "", translator, suspicious, cached if isinstance(cached, str) else None)
                if done is None:
                    rows.append((k, segment, None, False, 0 if translator is None else SEGMENT_TRIES, [], []))
                else:
                    pairs = [{"kind": a, "source": s, "target": t} for a, s, t in done.pairs]
                    rows.append((k, done.text, done.protected, True, done.requests, done.warnings, pairs))
            yield pd.DataFrame(rows, columns=names)

    return joined.mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, {SEGMENTS}")


def segment_key(text: Column) -> Column:
    return fingerprint(F.lit("segment"), text)


def translate_tables(df: DataFrame, key: str, text: str, translator: Translator = stub, cache: DataFrame | None = None, requests: int | None = None) -> DataFrame:
    """key, text, cells, changed, failures: texts whose HTML tables have translated cells.

    The cells of all texts are one table of distinct texts for the translator; answers join back by the place
    of the cell, and each text is put together again where it is.
    """
    cells = table_cells(df, key, text).select(key, "table_no", F.col("row_no"), F.col("col_no"), "cell_text")
    done = translate_texts(cells, "cell_text", translator, cache, partitions=requests)
    place = F.struct("table_no", "row_no", "col_no", F.col("translated").alias("t"))
    summed = done.groupBy(key).agg(
        F.array_sort(F.collect_list(place)).alias("_cells"), F.count("*").alias("cells"),
        F.count_if(F.col("translated") != F.col("cell_text")).alias("changed"), F.count_if(~F.col("ok")).alias("failures"),
    )
    joined = df.select(key, text).join(summed, key, "left")

    @F.pandas_udf("string")
    def put(texts: pd.Series, answers: pd.Series) -> pd.Series:
        def one(source: str, new: list[str]) -> str:
            left = iter(new)

            def table(m: re.Match) -> str:
                tables = H.parse(m[0])
                for cell in (c for t in tables for c in t.cells):
                    cell.text = inline.normalize_inline(next(left))
                return "\n" + "\n".join(map(H.render, tables)) + "\n" if tables else m[0]

            return inline.TABLE.sub(table, source)

        return pd.Series([t if a is None else one(t, list(a)) for t, a in zip(texts, answers, strict=True)], dtype=object)

    made = put(F.col(text), F.transform("_cells", lambda c: c["t"]))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return joined.select(key, F.when(F.col("_cells").isNull(), F.col(text)).otherwise(made).alias("text"), zero("cells"), zero("changed"), zero("failures"))


def candidates(asked: DataFrame, task_config: DataFrame, provider: str, model: str, translator: Translator = stub) -> DataFrame:
    """unit_id, text, ok, reason: proposals for units, which never touch the units themselves.

    asked: task, unit_id, kind, source. task_config: task, provider, model of the original job; a task made by
    another service or model gets no proposal, nor does a unit that no one may edit.
    """
    joined = asked.join(task_config.select("task", F.col("provider").alias("_p"), F.col("model").alias("_m")), "task", "left")
    same = F.col("_p").eqNullSafe(F.lit(provider)) & F.col("_m").eqNullSafe(F.lit(model))
    reason = F.when(~same, "other service or model").when(~editable(F.col("kind")), "read-only")
    judged = joined.withColumn("reason", reason)
    made = translate_segments(judged.filter("reason is null"), "unit_id", "source", translator).select("unit_id", F.col("translated").alias("_new"), "ok")
    out = judged.join(made, "unit_id", "left")
    guarded = guarded_edits(out.filter("ok").select("unit_id", "kind", "source", F.col("_new").alias("text"))).select("unit_id", "refusal")
    final = out.join(guarded, "unit_id", "left")
    why = F.coalesce("reason", F.when(~F.col("ok"), "no intact answer"), "refusal")
    return final.select("unit_id", F.when(why.isNull(), F.col("_new")).alias("text"), why.isNull().alias("ok"), why.alias("reason"))


def suggestions(candidates_of: DataFrame, contexts: DataFrame, key: str, propose: Callable[[list[str], str], list[tuple[str, str]]], budget: int = 12_000) -> DataFrame:
    """key, term, target: term pairs that a service proposes for the candidates of each key; invented terms go.

    candidates_of: key, rank, term. contexts: key, pos, snippet; the first that fit ``budget`` characters are shown.
    """
    shown = within_budget(contexts.withColumn("_size", F.length("snippet")), key, "pos", "_size", budget)
    text = shown.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "snippet"))), lambda x: x["snippet"]), "\n").alias("_text"))
    asked = candidates_of.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("_terms")).join(text, key, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for k, offered, context in zip(b[key], b["_terms"], b["_text"], strict=True):
                allowed = {t.casefold(): t for t in offered}
                rows += [(k, allowed[t.casefold()], target) for t, target in propose(list(offered), context or "") if t.casefold() in allowed and target.strip()]
            yield pd.DataFrame(rows, columns=[key, "term", "target"])

    return asked.mapInPandas(run, f"{key} {candidates_of.schema[key].dataType.simpleString()}, term string, target string").dropDuplicates([key, "term"])
