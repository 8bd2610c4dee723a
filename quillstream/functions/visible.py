"""What a reader sees of a text, and a signature of its content that layout doesn't change."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterable
from html import unescape

from . import html_tables
from .blocks import blocks
from .inline import IMAGE

#: Kinds of blocks without readable prose; kinds that give context; kinds no reviewer edits (fixed values).
UNREAD = frozenset(("reference", "code", "formula", "image"))
PROSE = ("heading", "text", "caption")
READ_ONLY = ("reference", "code", "formula", "image", "unmapped")
#: Inline fragments without prose, marks and tags (fixed values).
HIDDEN = re.compile(r"\$\$[\s\S]*?\$\$|\$(?:\\.|[^$\n])+\$|\\\[[\s\S]*?\\\]|`[^`]*`|!\[[^\]]*\]\([^)]*\)")
MARKUP = re.compile(r"\[\[\[TP_[A-Z]+_\d+\]\]\]|<[^>]+>")
LAYOUT_TAG = re.compile(r"</?(?:table|thead|tbody|tr|td|th|html|body)\b[^>]*>", re.I)
HEADING_MARK = re.compile(r"^#{1,6}\s+", re.M)


def visible_text(text: str) -> str:
    """The prose of a text: no references, code, formulas, images, marks and tags."""
    prose = "\n".join(b.text for b in blocks(text) if b.kind not in UNREAD)
    return unescape(MARKUP.sub(" ", HIDDEN.sub(" ", prose)))


def squeezed(text: str) -> str:
    return "".join(text.split())


def signature(text: str, digest_of: Callable[[str], str | None] = lambda path: None) -> str:
    """SHA-256 of a text's characters, images by content, and the shapes and texts of its table rows.

    digest_of: the digest of the image at a path, null for one that isn't there.
    """
    rows = [
        [[c.tag, c.attrs.get("rowspan") or "1", c.attrs.get("colspan") or "1", squeezed(c.text)] for c in cells]
        for table in html_tables.tables(text)
        for _, cells in table.rows
    ]

    def image(m: re.Match) -> str:
        digest = digest_of(m[0][m[0].index("](") + 2 : -1])
        return f"IMAGE:{digest}" if digest else m[0]

    bare = HEADING_MARK.sub("", LAYOUT_TAG.sub(" ", IMAGE.sub(image, text)))
    return hashlib.sha256(json.dumps([squeezed(unescape(bare)), rows], ensure_ascii=False).encode()).hexdigest()


def term_matches(text: str, terms: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """The terms (source, target) that stand in a text: the longest at each place, as whole words, once each."""
    wanted = {" ".join(s.split()).casefold(): (s, t) for s, t in terms if s.strip()}
    if not wanted:
        return []
    longest = sorted(wanted, key=lambda k: (-len(k), k))
    # A boundary is asked for where the term has a Latin letter or digit at that end.
    ends = lambda k: (r"(?<![A-Za-z0-9_])" if re.match(r"\w", k, re.A) else "", r"(?![A-Za-z0-9_])" if re.search(r"\w$", k, re.A) else "")
    pattern = "|".join("{0}{2}{1}".format(*ends(k), re.escape(k).replace(r"\ ", r"\s+")) for k in longest)
    found = (" ".join(m[0].split()).casefold() for m in re.finditer(pattern, text, re.I))
    return [wanted[k] for k in dict.fromkeys(found) if k in wanted]


def missing_terms(source: str, translated: str, terms: Iterable[tuple[str, str]]) -> list[tuple[str, str]]:
    """Terms of the source whose set translation a reader of the translation doesn't see."""
    seen = visible_text(translated).casefold()
    return [(s, t) for s, t in term_matches(source, terms) if t.casefold() not in seen]
