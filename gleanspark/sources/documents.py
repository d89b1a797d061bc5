"""Documents from inline texts and files, and strict JSON for evaluation sets."""

from __future__ import annotations

import json
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanspark.functions.text import title_of

#: Extensions that can be imported.
EXTENSIONS = (".txt", ".md", ".markdown")
DOCUMENT = "title string, source string, content string, metadata map<string,string>, import_seq bigint"


def inline(spark: SparkSession, texts: list[dict]) -> DataFrame:
    """Documents from ``{content, title?, source?}``: a missing title is derived, a missing source is ``inline``."""
    rows = [(t.get("title"), t.get("source"), t["content"], i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "given string, source string, content string, import_seq bigint")
    source = F.coalesce(F.nullif(F.trim("source"), F.lit("")), F.lit("inline"))
    return df.select(title_of(F.col("content"), F.col("given")).alias("title"), source.alias("source"), "content", F.lit(None).cast("map<string,string>").alias("metadata"), "import_seq")


def files(spark: SparkSession, path: str) -> DataFrame:
    """Documents from text and Markdown files below ``path``; another extension is an error, the source is the path, the title the name."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.col("value").alias("content"), file_path().alias("source"))
    name = F.regexp_extract("source", r"([^/]*)$", 1)
    extension = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    sound = F.when(extension.isin(*EXTENSIONS), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(F.raise_error(F.concat(F.lit("can't import "), name)).cast("string"))
    order = F.xxhash64("source").alias("import_seq")
    return df.select(sound.alias("title"), "source", "content", F.lit(None).cast("map<string,string>").alias("metadata"), order)


def file_path() -> Column:
    """The path of the file that a row was read from, as it is named there: Spark gives its URI, in which some characters are escaped."""
    return F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))


class JsonError(ValueError):
    pass


def strict_json(text: str, fields: dict) -> dict:
    """One JSON object with no other fields than ``fields`` (nested: a dict, or a list of one dict); errors name the line."""
    start = len(text) - len(text.lstrip())
    try:
        value, end = json.JSONDecoder().raw_decode(text, start)
    except json.JSONDecodeError as e:
        raise JsonError(f"line {e.lineno}: {e.msg}") from None
    if text[end:].strip():
        raise JsonError("more than one document")
    _no_others(value, fields, "")
    return value


def _no_others(value, fields, at: str) -> None:
    if isinstance(fields, list) and isinstance(value, list):
        for i, v in enumerate(value):
            _no_others(v, fields[0], f"{at}[{i}]")
    elif isinstance(fields, dict) and isinstance(value, dict):
        for k, v in value.items():
            if k not in fields:
                raise JsonError(f"unknown field {at}.{k}".replace(" .", " "))
            _no_others(v, fields[k], f"{at}.{k}")


#: Fields of a query set.
QUERY_SET = {"version": 0, "group": "", "title": "", "note": "", "queries": [{"id": "", "query": "", "kind": "", "require_lexical": False, "note": "", "expect": [{"source": "", "quote": "", "occurrence": 0, "grade": 0, "note": ""}]}]}


def query_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Queries and expectations of one strict JSON file; an unset grade is 2, the group is the file's name."""
    text = spark.read.text(path, wholetext=True).first()[0]
    value = strict_json(text, QUERY_SET)
    group = value.get("group") or PurePosixPath(path).stem
    queries = [(q["id"], q["query"], q.get("kind") or "direct", bool(q.get("require_lexical")), group, len(q.get("expect") or [])) for q in value["queries"]]
    expects = [(q["id"], i, e["source"], e["quote"], int(e.get("occurrence") or 0), int(e.get("grade") or 2)) for q in value["queries"] for i, e in enumerate(q.get("expect") or [])]
    return (
        spark.createDataFrame(queries, "query_id string, query string, kind string, require_lexical boolean, group string, n_expects int"),
        spark.createDataFrame(expects, "query_id string, expect_id int, source string, quote string, occurrence int, grade int"),
    )


def corpus(spark: SparkSession, manifest: str, root: str | None = None) -> DataFrame:
    """(source, path, sha256, chunks_at_default, content) of a manifest's files, paths being relative to ``root`` or else to it."""
    value = json.loads(spark.read.text(manifest, wholetext=True).first()[0])
    base = root or manifest.rsplit("/", 1)[0]
    rows = [(f["source"], f"{base}/{f['path']}", f["sha256"], int(f.get("chunks_at_default") or 0)) for f in value["files"]]
    listed = spark.createDataFrame(rows, "source string, path string, sha256 string, chunks_at_default int")
    texts = spark.read.text([r[1] for r in rows], wholetext=True).select(F.col("value").alias("content"), _bare(file_path()).alias("_path"))
    return listed.withColumn("_path", _bare(F.col("path"))).join(texts.dropDuplicates(["_path"]), "_path", "left").drop("_path")


def _bare(path: Column) -> Column:
    """A path without its scheme, repeated slashes and steps that stay or go back."""
    bare = F.regexp_replace(F.regexp_replace(path, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), r"/(\./)+|/{2,}", "/")
    return F.regexp_replace(bare, r"/[^/]+/\.\.(?=/)", "")
