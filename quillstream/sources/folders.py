"""Folders of parsed documents and files of terms and usage, through Spark's readers."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Types that count as page furniture, and those that place texts (fixed values).
FURNITURE = ("header", "footer", "page_header", "page_footer", "page_number")
PLACED = ("text", "title", "paragraph", "table", "image", "equation")
#: Patterns of sidecar files, the preferred first.
SIDECARS = ("_content_list.json", "content_list.json", "_content_list_v2.json", "content_list_v2.json")
USAGE = "recorded_at timestamp, seconds double, phase string, retry boolean, glossary_chars long, usage struct<total_tokens: long>, _corrupt_record string"
GLOSSARY_STORE = "version int, entries array<struct<source: string, target: string, note: string>>, global_enabled boolean, book_enabled boolean"


def _name(path: str = "path"):
    return F.regexp_extract(path, "([^/]+)$", 1)


def markdown_documents(spark: SparkSession, root: str) -> DataFrame:
    """folder, path, text: the Markdown of every folder below ``root``.

    ``full.md`` (in any case) comes before others, then the least depth, then the name; empty files
    don't count.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(root, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).filter(F.length("text") > 0)
    folder = F.regexp_replace("path", "/[^/]+$", "")
    order = F.struct(F.lower(_name()) != "full.md", F.size(F.split("path", "/")), "path")
    chosen = files.groupBy(folder.alias("folder")).agg(F.min_by(F.struct("path", "text"), order).alias("f"))
    return chosen.select("folder", "f.*")


def glossary_csv(spark: SparkSession, path: str) -> DataFrame:
    """source, target, note of a CSV with a header; both names must be there, and no empty cells."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8")
    names = {c.lstrip("﻿").strip(): c for c in raw.columns}
    if not {"source", "target"} <= names.keys():
        raise ValueError("the CSV needs the columns source and target")
    note = F.trim(F.col(names["note"])) if "note" in names else F.lit("")
    rows = raw.select(F.trim(F.col(names["source"])).alias("source"), F.trim(F.col(names["target"])).alias("target"), F.coalesce(note, F.lit("")).alias("note"))
    bad = (F.coalesce("source", F.lit("")) == "") | (F.coalesce("target", F.lit("")) == "") | (F.length("source") > 500) | (F.length("target") > 500)
    return rows.withColumn("source", F.when(bad, F.raise_error(F.lit("a term needs a source and a target of at most 500 characters")).cast("string")).otherwise(F.col("source")))


def write_glossary_csv(entries: DataFrame, path: str) -> None:
    entries.select("source", "target", "note").write.csv(path, header=True, mode="errorifexists", encoding="UTF-8")


def glossary_store(spark: SparkSession, path: str) -> DataFrame:
    """source, target, note, layer of the stored glossaries; a damaged file is an error, not an empty glossary."""
    stored = spark.read.schema(GLOSSARY_STORE).option("mode", "FAILFAST").json(path, multiLine=True)
    layer = F.when(F.col("_metadata.file_path").rlike("/books/[0-9a-f]{64}\\.json$"), F.regexp_extract("_metadata.file_path", "([0-9a-f]{64})", 1)).otherwise("global")
    checked = F.when(F.col("version") != 1, F.raise_error(F.lit("unknown version of the glossary"))).otherwise(F.col("entries"))
    return stored.select(layer.alias("layer"), F.explode(checked).alias("e")).select("layer", "e.*")


def usage_ledger(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The usage ledger of JSON lines; a line that can't be read is a row marked incomplete."""
    reader = spark.readStream.option("maxFilesPerTrigger", 16) if stream else spark.read
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    rows = reader.text(path).filter(F.trim("value") != "").select(F.from_json("value", USAGE, options).alias("r")).select("r.*")
    return rows.select(
        "recorded_at",
        "phase",
        "seconds",
        F.coalesce("retry", F.lit(False)).alias("retry"),
        F.col("usage.total_tokens").alias("total_tokens"),
        F.col("_corrupt_record").isNotNull().alias("incomplete"),
    )


def images(spark: SparkSession, root: str) -> DataFrame:
    """path, sha256, bytes of the images below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,jpeg,gif,bmp,webp,tif,tiff}").load(root)
    return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def fingerprints(spark: SparkSession, root: str) -> DataFrame:
    """path relative to ``root``, sha256 of every file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    relative = F.regexp_replace("path", f"^(file:)?/*{root.removeprefix('file:').strip('/')}/", "")
    return files.select(relative.alias("path"), F.sha2("content", 256).alias("sha256"))


def json_nodes(spark: SparkSession, root: str, pattern: str = "*.json") -> DataFrame:
    """folder, file, pos, page, node: the typed nodes of JSON sidecars, pages inherited from above.

    Files that can't be read are skipped. In a file that is a list of lists, the outer place is
    the page. Nodes are JSON texts.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", pattern).text(root, wholetext=True)
    files = files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))

    def walk(value, page):
        if isinstance(value, list):
            for child in value:
                yield from walk(child, page)
        elif isinstance(value, dict):
            page = value.get("page_idx", page)
            if isinstance(value.get("type"), str):
                yield page if isinstance(page, int) else None, value
            for child in value.values():
                if isinstance(child, (list, dict)):
                    yield from walk(child, page)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, text in zip(b["path"], b["text"], strict=True):
                try:
                    data = json.loads(text)
                except ValueError:
                    continue
                paged = isinstance(data, list) and data and all(isinstance(p, list) for p in data)
                found = [n for i, p in enumerate(data) for n in walk(p, i)] if paged else list(walk(data, None))
                folder, _, name = path.rpartition("/")
                rows = [(folder, name, k, page, json.dumps(node, ensure_ascii=False)) for k, (page, node) in enumerate(found)]
                if rows:
                    yield pd.DataFrame(rows, columns=["folder", "file", "pos", "page", "node"]).astype({"page": "Int64"})

    return files.mapInPandas(run, "folder string, file string, pos int, page long, node string")


def block_counts(nodes: DataFrame) -> DataFrame:
    """folder, type, n: types of nodes, for the summary of a sidecar."""
    return nodes.groupBy("folder", F.lower(F.get_json_object("node", "$.type")).alias("type")).agg(F.count("*").alias("n"))


def furniture(nodes: DataFrame) -> DataFrame:
    """folder, pos, type, text, page (from 1), bbox, margin of the page furniture with a sound box."""
    content = nodes.filter(F.col("file").endswith("_content_list.json"))
    read = content.select(
        "folder",
        "pos",
        F.get_json_object("node", "$.type").alias("type"),
        F.coalesce(F.get_json_object("node", "$.text"), F.lit("")).alias("text"),
        (F.col("page") + 1).alias("page"),
        F.from_json(F.get_json_object("node", "$.bbox"), "array<double>").alias("bbox"),
    )
    box = lambda i: F.get("bbox", F.lit(i))
    sound = (F.size("bbox") == 4) & (box(0) >= 0) & (box(0) <= box(2)) & (box(2) <= 1000) & (box(1) >= 0) & (box(1) <= box(3)) & (box(3) <= 1000)
    kept = read.filter(F.col("type").isin(*FURNITURE) & F.col("page").isNotNull() & sound)
    return kept.withColumn("margin", (box(3) <= 100) | (box(1) >= 900))


def provenance(nodes: DataFrame) -> DataFrame:
    """folder, block_id, text, page, bbox of the placed texts, from the first file that has any."""
    fields = [F.get_json_object("node", f"$.{k}") for k in ("text", "table_body", "content.html")]
    paragraphs = F.expr("array_join(transform(from_json(get_json_object(node, '$.content.paragraph_content'), 'array<struct<content: string>>'), x -> x.content), '')")
    captions = F.expr("from_json(get_json_object(node, '$.table_caption'), 'array<string>')")
    texts = F.concat(F.array_compact(F.array(*fields, F.nullif(paragraphs, F.lit("")))), F.coalesce(captions, F.array().cast("array<string>")))
    rank = F.lit(len(SIDECARS))
    for i, end in reversed(list(enumerate(SIDECARS))):
        rank = F.when(F.col("file").endswith(end), F.lit(i)).otherwise(rank)
    placed = nodes.filter(F.lower(F.get_json_object("node", "$.type")).isin(*PLACED) & F.col("page").isNotNull())
    rows = placed.select(
        "folder", F.struct(rank.alias("r"), F.col("file").alias("f")).alias("rank"), "pos", F.posexplode(texts).alias("k", "text"), (F.col("page") + 1).alias("page"),
        F.from_json(F.get_json_object("node", "$.bbox"), "array<double>").alias("bbox"),
    ).filter(F.col("text").rlike(r"\S"))
    first = rows.groupBy("folder").agg(F.min("rank").alias("rank"))
    numbered = F.expr("row_number() over (partition by folder order by pos, k) - 1")
    return rows.join(first, ["folder", "rank"]).select("folder", numbered.alias("block_id"), "text", "page", "bbox")
