"""Evaluation runs: a corpus is imported into a fresh store, all queries are asked of all channels, one report comes out."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from gleanspark.functions.text import tokenize
from gleanspark.operators import evaluate, fusion
from gleanspark.operators.chunking import ChunkOptions, chunk_documents
from gleanspark.operators.embed import Embedder
from gleanspark.plans import report
from gleanspark.plans.engine import Engine, Options
from gleanspark.sources.snapshots import SnapshotStore
from gleanspark.sources.staging import staged


@dataclass(frozen=True)
class EvalOptions:
    """How to evaluate; values out of range are errors, those not given are the engine's defaults."""

    top_k: int = 10
    ndcg_k: int = 10
    rrf_k: int = fusion.RRF_K
    multiplier: int = 1
    scheme: str = "bigram"
    context: int = 1
    merge: bool = False
    chunks: ChunkOptions = field(default_factory=ChunkOptions)
    ef_search: int = 100
    tolerance: float = evaluate.TOLERANCE

    def __post_init__(self):
        if self.top_k < 1 or self.ndcg_k < 1 or self.context < 0 or self.ef_search < 1 or self.tolerance < 0:
            raise ValueError("top_k, ndcg_k and ef_search must be positive, context and tolerance not negative")
        self.chunks.normal()

    def engine(self) -> Options:
        return Options(top_k=self.top_k, rrf_k=self.rrf_k, multiplier=self.multiplier, context=self.context, scheme=self.scheme, merge=self.merge, chunks=self.chunks)


def candidates(ef_search: int, top_k: int) -> int:
    """How many candidates an approximate search looks at: never fewer than it must return."""
    return max(ef_search, top_k)


class Degraded(RuntimeError):
    """The run would not measure what it is meant to."""


@dataclass
class Report:
    """Tables of one run."""

    metrics: DataFrame
    per_query: DataFrame
    gains: DataFrame
    missed: DataFrame
    bands: DataFrame
    distinct: DataFrame
    expanded: DataFrame
    required: DataFrame
    detail: DataFrame

    def overall(self) -> DataFrame:
        return evaluate.overall(self.metrics)

    def text(self) -> str:
        parts = [("metrics", self.metrics, ("channel", "group")), ("gains", self.gains, ("group",)), ("scores", self.bands, ("score_kind", "kind")), ("documents", self.distinct, ("channel",))]
        return "\n\n".join(f"{name}\n{report.table(report.rows_of(df, *order))}" for name, df, order in parts)

    def json(self) -> str:
        names = ("metrics", "per_query", "gains", "missed", "bands", "distinct", "expanded", "required")
        return report.as_json({name: report.rows_of(getattr(self, name)) for name in names})


def check_corpus(files: DataFrame) -> DataFrame:
    """What is wrong with a corpus (source, path, sha256, chunks_at_default, content): its fields, hashes that differ, chunks that differ from those recorded."""
    wrong = files.where(F.col("content").isNull() | (evaluate.fingerprint(F.coalesce("content", F.lit(""))) != F.lower("sha256"))).select("source", F.lit("other content").alias("problem"))
    numbered = files.where("content is not null").select(F.xxhash64("source").alias("id"), "source", "content")
    chunks = chunk_documents(numbered).join(numbered.select(F.col("id").alias("document_id"), "source"), "document_id")
    drift = evaluate.drift(files, chunks).select("source", F.concat(F.lit("chunks: "), F.col("recorded").cast("string"), F.lit(" recorded, "), F.col("actual").cast("string")).alias("problem"))
    return evaluate.manifest_problems(files).unionByName(wrong).unionByName(drift)


def evaluation(path: str, files: DataFrame, queries: DataFrame, expects: DataFrame, embedder: Embedder, options: EvalOptions = EvalOptions()) -> Report:
    """Imports ``files`` (source, content) into a new store at ``path`` and measures ``queries`` against ``expects``.

    ``queries``: query_id, query, group, require_lexical; ``expects``: query_id, expect_id, source, quote,
    occurrence, grade. Quotes that aren't there once, chunks without a vector and channels that fail end the run.
    """
    spark = files.sparkSession
    placed = evaluate.located(expects.join(files.select("source", F.col("content").alias("text")), "source", "left").fillna({"text": ""}))
    placed = staged(placed.drop("text"), "expects")
    if bad := placed.where("problem is not null").select("query_id", "quote", "problem").take(5):
        raise ValueError(f"quotes that can't be placed: {[tuple(b) for b in bad]}")
    engine = Engine(SnapshotStore(spark, path), embedder, options.engine())
    docs = files.select(F.col("source").alias("title"), "source", "content", F.lit(None).cast("map<string,string>").alias("metadata"), F.xxhash64("source").alias("import_seq"))
    imported = engine.import_documents(docs)
    if imported.where("warning is not null or embedded_count < chunk_count").limit(1).count():
        raise Degraded("not all chunks have a vector")
    found = engine.channels(queries.select("query_id", "query"), options.top_k)
    columns = ["query_id", "rank", "score", "source", "document_id", "ordinal", "start_offset", "end_offset"]
    tall = None
    for name, df in found.items():
        rows = df if "source" in df.columns else engine.with_chunks(df) if "key" in df.columns else with_source(engine, df)
        cosine = F.col("vector_score") if "vector_score" in rows.columns else F.lit(None).cast("double")
        rows = rows.select(F.lit(name).alias("channel"), *columns, cosine.alias("vector_score"))
        tall = rows if tall is None else tall.unionByName(rows)
    results = staged(tall, "results")
    scored = staged(evaluate.scores(results, placed, queries, options.ndcg_k), "scores")
    means = evaluate.metrics(scored)
    return Report(
        means, scored, evaluate.gains(means), evaluate.missed(results, placed), evaluate.score_bands(results, placed, queries), evaluate.distinct_sources(results, queries),
        evaluate.expanded(results.where("channel = 'fused'"), engine.chunks, placed, queries, options.context), evaluate.lexical_required(scored, queries), evaluate.detail(results, placed),
    )


def with_source(engine: Engine, merged: DataFrame) -> DataFrame:
    """Merged hits with the source of their document."""
    return merged.join(engine.store.documents().select(F.col("id").alias("document_id"), "source"), "document_id")


def shared_words(engine: Engine, queries: DataFrame, placed: DataFrame) -> DataFrame:
    """(query_id, shared): words that a query shares with the chunks over its first expectation."""
    scheme = engine.options.scheme
    chunks = engine.chunks.select("source", "start_offset", "end_offset", tokenize(F.col("content"), scheme).alias("tokens"))
    return evaluate.shared_tokens(queries.select("query_id", tokenize(F.col("query"), scheme).alias("tokens")), placed, chunks)
