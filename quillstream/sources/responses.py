"""Answers of a parsing service as rows: decoded in Arrow batches, one answer at a time."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import responses

_FILE = pa.struct([("name", pa.string()), ("sha256", pa.string()), ("content", pa.binary())])
SCHEMA = "kind string, address string, error string, files array<struct<name: string, sha256: string, content: binary>>"


def decoded(answers: DataFrame, key: str, content: str = "content", content_type: str = "content_type") -> DataFrame:
    """key, kind, address, error, files of every answer; one that can't be taken has its error and no files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):  # one at a time: an answer may be large
                body, kind = b.column(content)[i].as_py() or b"", b.column(content_type)[i].as_py() or ""
                error = None
                try:
                    made = responses.decode(body, kind)
                except (responses.BadResponse, ValueError, OSError) as problem:
                    made, error = responses.Decoded("error"), str(problem)
                files = [{"name": n, "sha256": hashlib.sha256(c).hexdigest(), "content": c} for n, c in made.files.items()]
                columns = [pa.array([made.kind]), pa.array([made.address], pa.string()), pa.array([error], pa.string()), pa.array([files], pa.list_(_FILE))]
                yield pa.RecordBatch.from_arrays([b.column(key).slice(i, 1), *columns], names=[key, "kind", "address", "error", "files"])

    return answers.select(key, content, content_type).mapInArrow(run, f"{key} {answers.schema[key].dataType.simpleString()}, {SCHEMA}")
