"""Markdown as typed blocks; long paragraphs in pieces that keep formulas and tags whole."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

HEADING = re.compile(r"(#{1,6})\s+(.+)")
REFERENCES = re.compile(
    r"(?i)(?:\d+(?:\.\d+)*[.)]?\s+)?(?:references|bibliography|works cited|literature cited|参考文献|參考文獻)\s*[:：]?"
)
CAPTION = re.compile(r"(?i)(?:fig(?:ure)?\.?|table|图|表)\s*\d+")
TABLE_OPENS = re.compile(r"(?i)<table\b")
FENCE = re.compile(r"`{3,}|~{3,}")
#: What is never cut: formulas, images, code, tags.
WHOLE = re.compile(r"\$\$[\s\S]*?\$\$|\$(?:\\.|[^$\n])+\$|\\\[[\s\S]*?\\\]|!\[[^\]]*\]\([^)]+\)|`[^`]+`|<[^>]+>")


class Block(NamedTuple):
    id: str
    kind: str
    text: str


def _kind(line: str) -> str:
    """Kind of the block that a stripped line opens."""
    if HEADING.fullmatch(line):
        return "heading"
    if TABLE_OPENS.match(line):
        return "table"
    if FENCE.match(line):
        return "code"
    if line.startswith(("$$", "\\[")):
        return "formula"
    if line.startswith("!["):
        return "image"
    return "caption" if CAPTION.match(line) else "text"


def _end(kind: str, lines: list[str], at: int) -> int:
    """Number of the line after the block that opens at a line."""
    first = lines[at].strip()
    if kind in ("heading", "image"):
        return at + 1
    if kind in ("text", "caption"):
        end = at + 1
        while end < len(lines) and (line := lines[end].strip()) and _kind(line) in ("text", "caption"):
            end += 1
        return end
    if kind == "table":
        closes = lambda line: "</table>" in line.lower()
        inside = first
    elif kind == "code":
        fence = FENCE.match(first)[0]
        closes = lambda line: set(line.strip()) == {fence[0]} and len(line.strip()) >= len(fence)
        inside = ""
    else:
        mark = "$$" if first.startswith("$$") else "\\]"
        closes = lambda line: mark in line
        inside = first[2:]
    if closes(inside):
        return at + 1
    return next((k + 1 for k in range(at + 1, len(lines)) if closes(lines[k])), len(lines))


def _flat(markdown: str) -> Iterator[tuple[str, str]]:
    lines, at = markdown.splitlines(), 0
    while at < len(lines):
        if not lines[at].strip():
            at += 1
            continue
        kind = _kind(lines[at].strip())
        end = _end(kind, lines, at)
        yield kind, "\n".join(lines[at:end]).strip()
        at = end


def blocks(markdown: str) -> list[Block]:
    """Blocks in order; a reference heading takes in all that follows up to its next peer."""
    grouped: list[tuple[str, list[str]]] = []
    open_level = 0
    for kind, text in _flat(markdown):
        heading = HEADING.fullmatch(text) if kind == "heading" else None
        if open_level and not (heading and len(heading[1]) <= open_level):
            grouped[-1][1].append(text)
            continue
        opens = heading and REFERENCES.fullmatch(heading[2])
        open_level = len(heading[1]) if opens else 0
        grouped.append(("reference" if opens else kind, [text]))
    out = []
    for kind, texts in grouped:
        text = "\n\n".join(texts)
        out.append(Block(f"b{len(out):06d}_{hashlib.sha256(text.encode('utf-8', 'surrogatepass')).hexdigest()[:10]}", kind, text))
    return out


def split_prose(text: str, limit: int) -> list[str]:
    """Pieces of at most ``limit`` characters where possible, cut between sentences or words only."""
    spans = [m.span() for m in WHOLE.finditer(text)]
    k, cuts = 0, []
    for gap in re.finditer(r"\s+", text):
        while k < len(spans) and spans[k][1] <= gap.start():
            k += 1
        if k == len(spans) or gap.end() <= spans[k][0]:
            cuts.append((gap.start(), gap.end()))
    atoms: list[str] = []
    sentence: list[str] = []

    def close() -> None:
        whole = text[sentence_start : last_end]
        atoms.extend([whole] if len(whole) <= limit else sentence)
        sentence.clear()

    sentence_start = at = last_end = 0
    for start, end in [*cuts, (len(text), len(text))]:
        word = text[at:start]
        last_end = start
        if word:
            sentence.append(word)
        if sentence and (start == len(text) or word.endswith((".", "!", "?", "。", "！", "？"))):
            close()
            sentence_start = end
        elif not sentence:
            sentence_start = end
        at = end
    pieces: list[list[str]] = []
    size = 0
    for atom in atoms:
        if not pieces or (pieces[-1] and size + len(atom) + 1 > limit):
            pieces.append([])
            size = 0
        pieces[-1].append(atom)
        size += len(atom) + 1
    return [" ".join(p) for p in pieces]


def segments(markdown: str, maximum: int = 10_000, minimum: int = 1_800) -> list[str]:
    """Blocks packed into segments, as ``operators.windows.packed`` does for tables of blocks."""
    out: list[list[str]] = []
    size, sticky = 0, False
    for block in blocks(markdown):
        long = block.kind == "text" and len(block.text) > maximum
        for piece in split_prose(block.text, maximum) if long else [block.text]:
            weight = 60 if block.kind in ("table", "formula", "image", "code", "reference") else len(piece)
            opens = block.kind == "heading" and piece.startswith(("# ", "## ")) and size >= minimum
            if not out or (not sticky and (size + weight > maximum or opens)):
                out.append([])
                size = 0
            out[-1].append(piece)
            size += weight + 2
            sticky = block.kind in ("image", "table")
    return ["\n\n".join(s) for s in out]
