"""Answers of a parsing service: archives, JSON of several forms, pages, plain text."""

from __future__ import annotations

import base64
import binascii
import io
import json
import zipfile
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from typing import Any

#: Where a document, a result's address, a task and its state may stand in an answer, the first first (fixed values).
DOCUMENT = (
    "md_content full_md markdown md content data.full_md data.markdown data.md data.content "
    "result.full_md result.markdown result.md result.content"
).split()
ADDRESS = (
    "download_url full_zip_url output_url result_url url data.download_url data.full_zip_url data.output_url data.result_url data.url "
    "result.download_url result.output_url result.result_url result.url"
).split()
SIDECARS = {"content_list": "content_list.json", "middle_json": "result_middle.json"}


class BadResponse(ValueError):
    """An answer that can't be taken as a result."""


@dataclass
class Decoded:
    """Files by name, or the address of the result, or nothing but the answer itself."""

    kind: str
    files: dict[str, bytes] = field(default_factory=dict)
    address: str | None = None


def at(data: Any, path: str) -> Any:
    """The value at a dotted path of objects, else null."""
    for key in path.split("."):
        data = data.get(key) if isinstance(data, dict) else None
    return data


def first(data: Any, paths: list[str]) -> Any:
    return next((v for v in (at(data, p) for p in paths) if v), None)


def safe_member(name: str) -> bool:
    """A relative path that stays below its root, without drive or backslash."""
    path = PurePosixPath(name)
    return bool(name.strip("/")) and not path.is_absolute() and ".." not in path.parts and not set(name) & set("\\:")


def unpacked(data: bytes) -> dict[str, bytes]:
    """The files of an archive; an unsafe name or a link spoils it whole."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            infos = [i for i in archive.infolist() if not i.is_dir()]
            for i in infos:
                if not safe_member(i.filename) or (i.external_attr >> 16) & 0o170000 == 0o120000:
                    raise BadResponse(f"unsafe archive member {i.filename!r}")
            return {i.filename: archive.read(i) for i in infos}
    except zipfile.BadZipFile as error:
        raise BadResponse("broken archive") from error


def _image(name: str, value: Any) -> bytes:
    if not safe_member(name) or "/" in name:
        raise BadResponse(f"unsafe image name {name!r}")
    if not isinstance(value, str) or ";base64," not in value:
        raise BadResponse("unsupported image encoding")
    try:
        return base64.b64decode(value.partition(";base64,")[2], validate=True)
    except binascii.Error as error:
        raise BadResponse("broken image") from error


def _single(record: dict) -> Decoded:
    """One document with its sidecars and images."""
    files = {"full.md": record["md_content"].encode()}
    for key, name in SIDECARS.items():
        value = record.get(key)
        value = json.loads(value) if isinstance(value, str) else value
        if isinstance(value, (dict, list)):
            files[name] = json.dumps(value, ensure_ascii=False).encode()
    images = record.get("images") or {}
    return Decoded("document", files | {f"images/{n}": _image(n, v) for n, v in images.items()})


def from_json(data: Any) -> Decoded:
    """A JSON answer: a document with its files, Markdown, an address, or only itself."""
    results = at(data, "results")
    if isinstance(results, dict):
        records = [r for r in results.values() if isinstance(r, dict)]
        if len(records) != 1:
            raise BadResponse(f"{len(records)} documents in the answer on one file")
        if str(records[0].get("md_content") or "").strip():
            return _single(records[0])
    text = first(data, DOCUMENT)
    if isinstance(text, str) and text.strip():
        return Decoded("markdown", {"full.md": text.encode()})
    address = first(data, ADDRESS)
    if isinstance(address, str):
        return Decoded("address", address=address)
    return Decoded("json", {"api_result.json": json.dumps(data, ensure_ascii=False, indent=2).encode()})


def decode(content: bytes, content_type: str = "") -> Decoded:
    """An answer by its type and first bytes."""
    kind = content_type.lower()
    if "zip" in kind or content.startswith(b"PK\x03\x04"):
        return Decoded("archive", unpacked(content))
    text = content.decode("utf-8", "replace")
    try:
        return from_json(json.loads(text))
    except json.JSONDecodeError:
        pass
    if "html" in kind or text.lstrip().lower().startswith(("<!doctype html", "<html")):
        raise BadResponse("a web page, not the service's answer")
    if not text.strip():
        raise BadResponse("an empty answer")
    return Decoded("text", {"full.md": content})
