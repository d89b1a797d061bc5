"""Small inline tables that Spark and DuckDB read alike."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_DUCK = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + value.replace("'", "''") + "'"


@dataclass(frozen=True)
class Inline:
    """Rows with a Spark schema of simple types."""

    schema: str
    rows: tuple

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.schema)

    def sql(self) -> str:
        columns = [c.split() for c in self.schema.split(", ")]
        values = ", ".join("(" + ", ".join(map(literal, r)) + ")" for r in self.rows)
        return "(SELECT " + ", ".join(f"CAST({n} AS {_DUCK[t]}) AS {n}" for n, t in columns) + f" FROM (VALUES {values}) AS v({', '.join(n for n, _ in columns)}))"


TEXTS = Inline("id bigint, text string", (
    (1, "把 parquet 写成分区表"), (2, "天气预报"), (3, "雨"), (4, "v2.75 rc"), (5, "ＸＹＺ４５６"), (6, "春天　weather"), (7, "km公里"), (8, "さくら"), (9, "风，雨雪"),
    (10, ""), (11, "  ?! "), (12, "Ｓｐａｒｋ４．１ と カタカナ、ひらがな"), (13, "it's a_b-c"), (14, "ΑΒΓ Straße ÉTÉ"), (15, None),
))

MARKDOWN = Inline("id bigint, content string", (
    (1, "intro\n# One\nfirst\n## Two\nsecond\n### Three\nthird\n## Four\nfourth\n# Five\nfifth"),
    (2, "#tag is text\n####### seven\n#  Title with  spaces  \nbody\n\n"),
    (3, "# Only\n## Headings"),
    (4, "# Code\n```\n# not a heading, yet it splits\nx = 1\n```\ntail"),
    (5, "no headings at all"),
    (6, "# 标题\n正文一。\n## 小节\n\n| a | b |\n|---|---|\n| 1 | 2 |\n"),
    (7, "### deep first\na\n# top\nb\n### deep again\nc"),
))

QUOTES = Inline("id bigint, text string, quote string, occurrence int", (
    (1, "one two one two one", "one", 1), (2, "one two one two one", "one", 2), (3, "one two one two one", "one", 3), (4, "one two one two one", "one", 4), (5, "one two one two one", "one", None),
    (6, "one two one two one", "four", 1), (7, "one two", "", 1), (8, "aaaa", "aa", 2), (9, "aaaa", "aa", 3), (10, "向量检索与向量", "向量", 2), (11, "only once", "once", None), (12, "x😀y😀", "😀", 2),
))

DOCUMENTS = Inline("import_seq bigint, title string, source string, content string", (
    (1, "a", "a.md", "first text"), (2, "b", "inline", "shared text"), (3, "c", "", "shared text"), (4, "a2", "a.md", "changed text"), (5, " ", "x.md", "blank title"), (6, "d", "d.md", "　  "),
    (7, "e", "inline", "another text"), (8, "f", None, "null source"), (9, "g", "b.md", "first text"), (10, "b again", "inline", "shared text"),
))

QUERIES = Inline("query_id string, query string, kind string, require_lexical boolean, group string, n_expects int".replace("group string", "grp string"), (
    ("q1", "alpha", "direct", True, "en", 2), ("q2", "beta", "indirect", False, "en", 1), ("q3", "gamma", "direct", True, "zh", 1), ("q4", "delta", "multi-hop", False, "zh", 2), ("q5", "epsilon", "direct", False, "norel", 0),
))

BAD_QUERIES = Inline("query_id string, query string, kind string, grp string, n_expects int", (
    ("a", "What is it", "direct", "en", 1), ("a", "other", "direct", "en", 1), ("b", " what IS it ", "direct", "en", 1), ("c", "third", "odd", "zh", 1), ("d", "fourth", "direct", "zh", 0), ("e", "fifth", "direct", "norel", 1), ("f", "sixth", "direct", "norel", 0),
))

EXPECTS = Inline("query_id string, expect_id int, source string, start_offset int, end_offset int, grade int", (
    ("q1", 0, "a.md", 100, 120, 2), ("q1", 1, "a.md", 300, 320, 1), ("q2", 0, "b.md", 0, 10, 2), ("q3", 0, "c.md", 50, 60, 2), ("q4", 0, "a.md", 10, 30, 2), ("q4", 1, "a.md", 20, 40, 1),
))

RESULTS = Inline("channel string, query_id string, rank int, source string, start_offset int, end_offset int, score double, vector_score double", (
    ("fused", "q1", 1, "a.md", 200, 250, 0.032, 0.9), ("fused", "q1", 2, "a.md", 90, 130, 0.031, 0.8), ("fused", "q1", 3, "a.md", 110, 140, 0.03, None), ("fused", "q1", 4, "b.md", 100, 120, 0.02, 0.3),
    ("fused", "q2", 1, "b.md", 10, 20, 0.016, 0.7), ("fused", "q2", 2, "b.md", 5, 5, 0.015, 0.6), ("fused", "q3", 12, "c.md", 55, 90, 0.014, 0.2), ("fused", "q4", 1, "a.md", 0, 100, 0.03, 0.95), ("fused", "q5", 1, "c.md", 0, 10, 0.033, 0.5),
    ("lexical", "q1", 1, "a.md", 90, 130, 3.2, None), ("lexical", "q1", 2, "a.md", 310, 330, 3.0, None), ("lexical", "q2", 1, "a.md", 0, 9, 1.0, None), ("lexical", "q3", 1, "c.md", 0, 10, 1.0, None),
    ("vector", "q1", 1, "a.md", 0, 10, 0.9, 0.9), ("vector", "q2", 1, "b.md", 0, 5, 0.8, 0.8), ("vector", "q3", 1, "c.md", 40, 51, 0.7, 0.7), ("vector", "q4", 3, "a.md", 35, 39, 0.6, 0.6),
))

GATE_BASE = Inline("metric string, value double", (("fused_recall", 0.49), ("fused_ndcg", 0.41), ("fused_mrr", 0.4), ("lexical_recall", 0.46), ("vector_recall", 0.43)))
GATE_NOW = Inline("metric string, value double", (("fused_recall", 0.46), ("fused_ndcg", 0.02), ("fused_mrr", 0.9), ("lexical_recall", 0.46), ("other", 0.5)))

FILES = Inline("source string, path string, sha256 string, chunks_at_default int", (
    ("a.md", "corpus/a.md", "0" * 64, 3), ("b.md", "", "f" * 64, 0), ("b.md", "corpus/b.md", "xyz", 2), (" ", "corpus/c.md", "A" * 64, 1),
))

CHUNK_COUNTS = Inline("source string, chunk_id bigint", (("a.md", 1), ("a.md", 2), ("b.md", 3), ("b.md", 4)))

METADATA = Inline("id bigint, document_id bigint, source string", ((1, 1, "a.md"), (2, 1, "old.md"), (3, 2, None), (4, 3, None), (5, 9, None)))
SOURCES = Inline("id bigint, source string", ((1, "a.md"), (2, "b.md"), (3, "")))

KEYS = Inline("id bigint, dedup_key string", ((1, "src:a.md"), (2, ""), (3, None), (4, "sha:ab")))
TITLES = Inline("id bigint, content string, title string", ((1, "# Heading one\nbody", None), (2, "plain first line\nsecond", ""), (3, "##\nx", None), (4, "x" * 70, None), (5, "anything", "Given"), (6, "  ## spaced  \n", None), (7, "", None)))
