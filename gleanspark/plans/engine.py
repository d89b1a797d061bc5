"""The engine: import, search and channels over a snapshot, for batches of queries."""

from __future__ import annotations

import concurrent.futures
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark import InheritableThread
from pyspark.sql import DataFrame, functions as F

from gleanspark.functions.text import blank, index_text
from gleanspark.operators import fusion, ingest, lexical, vector
from gleanspark.operators.chunking import ChunkOptions
from gleanspark.operators.embed import Embedder
from gleanspark.sources.snapshots import NotFound, Store
from gleanspark.sources.staging import staged

HINT = "Scores rank results of one query; they don't say whether it has an answer."


@dataclass(frozen=True)
class Options:
    """Defaults of the engine; values out of range are errors."""

    top_k: int = 10
    rrf_k: int = fusion.RRF_K
    multiplier: int = 1
    context: int = 1
    timeout: float = 5.0
    scheme: str = "bigram"
    k1: float = lexical.K1
    b: float = lexical.B
    merge: bool = False
    chunks: ChunkOptions = field(default_factory=ChunkOptions)

    def __post_init__(self):
        if self.timeout <= 0 or self.context < 0 or self.top_k < 0:
            raise ValueError("timeout must be positive, context and top_k not negative")
        self.chunks.normal()


class SearchError(RuntimeError):
    """Every channel failed, or none was ready in time."""


@dataclass
class Found:
    """Results, why they are less than asked for (None: they aren't), and what a reader should know of the scores."""

    results: DataFrame
    degraded: str | None
    hint: str


def collected(spark, channels: dict[str, Callable[[], DataFrame]], timeout: float) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Results of each channel, written, and for the others why there are none: what failed, or that it wasn't ready in time.

    Channels run side by side, each as jobs with a tag of its own; what isn't ready after ``timeout`` seconds is
    cancelled, so one slow channel costs no more than that.
    """
    done: dict[str, concurrent.futures.Future] = {name: concurrent.futures.Future() for name in channels}
    tags = {name: f"{name}-{uuid.uuid4().hex}" for name in channels}

    def run(name: str) -> None:
        spark.sparkContext.addJobTag(tags[name])
        try:
            done[name].set_result(staged(channels[name](), name))
        except BaseException as e:  # whatever it was, the other channel may do
            done[name].set_exception(e)

    for name in channels:
        InheritableThread(target=run, args=(name,), daemon=True).start()
    ready, late = concurrent.futures.wait(done.values(), timeout)
    results, failed = {}, {}
    for name, future in done.items():
        if future in late:
            spark.sparkContext.cancelJobsWithTag(tags[name])
            failed[name] = f"not ready after {timeout:g} s"
        elif future.exception() is not None:
            failed[name] = type(future.exception()).__name__
        else:
            results[name] = future.result()
    return results, failed


class Engine:
    """A façade over a store and an embedder. Indexes are tables written for one version; ``rebuild`` moves to the latest."""

    def __init__(self, store: Store, embedder: Embedder | None = None, options: Options = Options()):
        self.store, self.embedder, self.options = store, embedder, options
        self.rebuild()

    def _table(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A table of the store's version, written when it is first asked for."""
        derived = getattr(self.store, "derived", None)
        return derived(name, make) if derived else staged(make(), name)

    def rebuild(self) -> None:
        """Writes the indexes of the latest version, or finds them written; searches that run keep the tables they began with.

        Postings are ranged by token and carry their weights, so a search reads neither texts nor vectors: those of
        chunks only for what it returns.
        """
        try:
            self.chunks, vectors = self.store.chunks(), self.store.vectors()
        except NotFound:
            self.chunks = None
            return
        o = self.options

        def made() -> lexical.LexicalIndex:
            text = self.chunks.select(F.col("chunk_id").alias("key"), index_text(F.col("heading"), F.col("content")).alias("text"))
            return lexical.index(text, scheme=o.scheme, k1=o.k1, b=o.b)

        def ranged(df: DataFrame, by: str) -> DataFrame:
            return df.repartitionByRange(by).sortWithinPartitions(by)

        kind = f"{o.scheme}-{o.k1:g}-{o.b:g}"
        self.lexical = lexical.LexicalIndex(
            self._table(f"postings-{kind}", lambda: ranged(made().postings, "token")),
            self._table(f"vocabulary-{kind}", lambda: ranged(made().vocabulary, "token")),
            self._table(f"lengths-{kind}", lambda: ranged(made().lengths, "key")),
        )
        dim = self.embedder.dim if self.embedder else 0
        sound = vectors.where(F.size("embedding") == dim).select(F.col("chunk_id").alias("key"), F.col("embedding").alias("vector"))
        self.vectors = self._table(f"vectors-{dim}", lambda: vector.index(sound, dim))
        self.n_vectors = self.vectors.count() if self.embedder else 0

    def stats(self) -> DataFrame:
        return ingest.index_stats(self.chunks.join(self.store.vectors(), "chunk_id", "left"), self.embedder.dim if self.embedder else 0)

    def import_documents(self, docs: DataFrame) -> DataFrame:
        """Imports (title, source, content, metadata, import_seq) as one batch: (document_id, title, chunk_count, embedded_count, warning).

        Documents without text to cut aren't saved; they have no id and a warning. If embedding fails, documents and
        chunks are saved without vectors, and each has a warning.
        """
        try:
            old, old_chunks, old_vectors = self.store.documents(), self.store.chunks(), self.store.vectors()
            above = old.agg(F.max("id")).first()[0] or 0
        except NotFound:
            old = None
            above = 0
        new, chunks, empty = ingest.ingest(docs, self.options.chunks, above)
        warning = None
        bare = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
        if self.embedder is not None:
            try:
                chunks = staged(ingest.embedded(chunks, self.embedder), "embedded")
            except Exception as e:  # texts are worth keeping without vectors
                warning = f"embedding failed: {type(e).__name__}"
                chunks = bare
        else:
            chunks = bare
        new = staged(new.withColumn("created_at", F.current_timestamp()), "documents")
        vectors = chunks.where("embedding is not null").select("chunk_id", "embedding")
        plain = chunks.drop("embedding")
        counts = chunks.groupBy("document_id").agg(F.count(F.lit(1)).alias("chunk_count"), F.count("embedding").alias("embedded_count"))
        summary = new.select(F.col("id").alias("document_id"), "title").join(counts, "document_id").withColumn("warning", F.lit(warning).cast("string"))
        nothing = F.lit(0).cast("bigint")
        summary = staged(summary.unionByName(empty.select(F.lit(None).cast("bigint").alias("document_id"), "title", nothing.alias("chunk_count"), nothing.alias("embedded_count"), F.lit("there is no text to cut").alias("warning"))), "summary")
        if old is not None:
            gone = ingest.replaced(old, new)
            stay = old.join(gone.select("id"), "id", "left_anti")
            kept = old_chunks.join(gone.select(F.col("id").alias("document_id")), "document_id", "left_anti")
            vectors = old_vectors.join(kept.select("chunk_id"), "chunk_id", "left_semi").unionByName(vectors)
            new, plain = stay.unionByName(new), kept.unionByName(plain)
        self.store.save(new, plain, vectors, reset=True)
        self.rebuild()
        return summary

    def _words(self, queries: DataFrame, n: int) -> DataFrame:
        return lexical.search(self.lexical, queries, n, self.options.scheme)

    def _near(self, queries: DataFrame, n: int) -> DataFrame:
        asked = self.embedder.embed(queries, "query").select("query_id", F.col("embedding").alias("vector"))
        return vector.search(self.vectors, asked, n)

    def channels(self, queries: DataFrame, top_k: int = 0, truncate: bool = True) -> dict[str, DataFrame]:
        """lexical, vector and fused results (query_id, key, score, rank, ...) of the same queries and query vectors.

        With ``merge`` the fused list has its neighbouring hits joined before it is cut, and their chunks' columns.
        """
        o = self.options
        top_k = top_k or o.top_k
        n = fusion.depth(top_k, o.multiplier)
        words, near = staged(self._words(queries, n), "lexical"), staged(self._near(queries, n), "vector")
        fused = fusion.fuse(words, near, top_k, o.rrf_k, truncate and not o.merge)
        if o.merge:
            fused = fusion.merge_adjacent(self.with_chunks(fused))
            fused = fused.where(F.col("rank") <= top_k) if truncate else fused
        return {"lexical": words.where(F.col("rank") <= top_k), "vector": near.where(F.col("rank") <= top_k), "fused": fused}

    def search(self, queries: DataFrame, top_k: int = 0) -> Found:
        """Fused results of queries (query_id, query) with their chunks; blank queries are an error.

        Channels run side by side. If one fails or isn't ready in time, results are the other's and ``degraded`` says
        why; if both are, that is an error. Without vectors, results are lexical. With ``merge`` neighbouring hits
        are joined before the list is cut.
        """
        if queries.where(blank(F.col("query"))).limit(1).count():
            raise ValueError("a query is blank")
        o = self.options
        top_k = top_k or o.top_k
        spark = queries.sparkSession
        if self.chunks is None:
            empty = spark.createDataFrame([], "query_id string, rank int, score double, content string")
            return Found(empty, "the index is empty", "Import documents first.")
        n = fusion.depth(top_k, o.multiplier)
        channels = {"lexical": lambda: self._words(queries, n)}
        if self.n_vectors:
            channels["vector"] = lambda: self._near(queries, n)
        results, failed = collected(spark, channels, o.timeout)
        if not results:
            raise SearchError("; ".join(f"the {name} channel failed: {why}" for name, why in failed.items()))
        degraded = "; ".join(f"the {name} channel failed: {why}" for name, why in failed.items()) or (None if self.n_vectors else "there are no vectors")
        some = next(iter(results.values()))
        words, near = (results.get(name, some.limit(0)) for name in ("lexical", "vector"))
        rows = self.with_chunks(fusion.fuse(words, near, top_k, o.rrf_k, not o.merge))
        if o.merge:
            rows = fusion.merge_adjacent(rows).where(F.col("rank") <= top_k)
        return Found(rows, degraded, HINT)

    def with_chunks(self, ranked: DataFrame) -> DataFrame:
        """Ranked keys with their chunks' text, place, source and heading; never the vectors."""
        return ranked.withColumnRenamed("key", "chunk_id").join(self.chunks.select("chunk_id", "document_id", "ordinal", "start_offset", "end_offset", "content", "heading", "source"), "chunk_id")

    def context(self, hits: DataFrame) -> DataFrame:
        """(query_id, chunk_id, before, after): snippets of the nearest neighbours."""
        near = fusion.neighbors(hits, self.chunks, 1)
        side = lambda d, before: F.max(F.when(F.col("distance") == d, fusion.snippet(F.col("neighbor_content"), before)))
        return near.groupBy("query_id", "chunk_id").agg(side(-1, True).alias("before"), side(1, False).alias("after"))
