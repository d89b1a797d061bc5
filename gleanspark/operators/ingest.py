"""Import of documents: checks, content keys, replacement of what is imported again, migrations and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gleanspark.functions.text import blank, index_text
from gleanspark.operators.chunking import ChunkOptions, chunk_documents
from gleanspark.operators.embed import Embedder
from gleanspark.operators.numbering import numbered
from gleanspark.sources.staging import staged

INLINE = "inline"


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def dedup_key(source: Column, content: Column) -> Column:
    """``src:`` and the source, or ``sha:`` and the content's hash for inline or missing sources."""
    real = (F.trim(F.coalesce(source, F.lit(""))) != "") & (source != INLINE)
    return F.when(real, F.concat(F.lit("src:"), source)).otherwise(F.concat(F.lit("sha:"), content_hash(content)))


def document_problems(docs: DataFrame) -> DataFrame:
    """``docs`` with ``problem``: what is wrong with a document first, null if nothing is."""
    return docs.withColumn("problem", F.when(blank(F.col("title")), "blank title").when(blank(F.col("content")), "blank content"))


def chunk_problems(chunks: DataFrame, dim: int | None = None) -> DataFrame:
    """``chunks`` with ``problem``, checked in the order document, ordinal, offsets, content, dimension."""
    found = (
        F.when(F.coalesce("document_id", F.lit(0)) == 0, "no document").when(F.col("ordinal") < 0, "negative ordinal")
        .when((F.col("start_offset") < 0) | (F.col("end_offset") <= F.col("start_offset")), "bad offsets").when(blank(F.col("content")), "blank content")
    )
    if dim is not None:
        found = found.when(F.col("embedding").isNotNull() & (F.size("embedding") != dim), "wrong dimension")
    return chunks.withColumn("problem", found)


def latest(docs: DataFrame, order: str = "import_seq") -> DataFrame:
    """``docs`` with content_hash and dedup_key, only the last import of each key."""
    keyed = docs.withColumn("content_hash", content_hash(F.col("content"))).withColumn("dedup_key", dedup_key(F.col("source"), F.col("content")))
    w = W.partitionBy("dedup_key").orderBy(F.col(order).desc())
    return keyed.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """Documents of ``old`` whose key ``new`` has as well: they and their chunks go."""
    return old.join(new.select("dedup_key"), "dedup_key", "left_semi")


def with_ids(docs: DataFrame, above: int = 0, order: str = "import_seq") -> DataFrame:
    """``docs`` with gapless ids above ``above``, in the order of import and key."""
    return numbered(docs.drop("id"), [order, "dedup_key"], "id").withColumn("id", F.col("id") + above + 1)


def with_source(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks with their document's source, where that isn't empty."""
    return chunks.join(docs.select(F.col("id").alias("document_id"), F.nullif(F.col("source"), F.lit("")).alias("source")), "document_id", "left")


def backfill_source(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunks whose metadata lack their document's source or have another, put right, with ``changed``; a second run changes nothing."""
    sources = docs.where("source <> ''").select(F.col("id").alias("document_id"), F.col("source").alias("_source"))
    joined = chunks.join(sources, "document_id", "left")
    own = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    stale = F.col("_source").isNotNull() & ~F.try_element_at(own, F.lit("source")).eqNullSafe(F.col("_source"))
    merged = F.map_concat(F.map_filter(own, lambda k, _: k != "source"), F.create_map(F.lit("source"), F.col("_source")))
    return joined.withColumn("changed", stale).withColumn("metadata", F.when(F.col("changed"), merged).otherwise(F.col("metadata"))).drop("_source")


def migrate_keys(docs: DataFrame) -> DataFrame:
    """Documents without a key get ``legacy:<id>``; a key that two share is an error."""
    keyed = docs.withColumn("dedup_key", F.when(F.coalesce("dedup_key", F.lit("")) == "", F.concat(F.lit("legacy:"), F.col("id").cast("string"))).otherwise(F.col("dedup_key")))
    many = F.count(F.lit(1)).over(W.partitionBy("dedup_key"))
    return keyed.withColumn("dedup_key", F.when(many == 1, F.col("dedup_key")).otherwise(F.raise_error(F.concat(F.lit("two documents have the key "), F.col("dedup_key"))).cast("string")))


def metadata_json(metadata: Column) -> Column:
    """A map as JSON, an empty one as null."""
    return F.when(F.size(metadata) > 0, F.to_json(metadata))


def metadata_map(text: Column) -> Column:
    """JSON as a map, null as an empty one."""
    return F.coalesce(F.from_json(text, "map<string,string>"), F.create_map().cast("map<string,string>"))


def index_stats(chunks: DataFrame, dim: int) -> DataFrame:
    """One row: chunks, embedded, text_bytes, vector_bytes."""
    embedded = F.count_if(F.size("embedding") == dim)
    return chunks.agg(
        F.count(F.lit(1)).alias("chunks"), embedded.alias("embedded"), F.coalesce(F.sum(F.octet_length(index_text(F.col("heading"), F.col("content")))), F.lit(0)).cast("bigint").alias("text_bytes"), (embedded * dim * 4).alias("vector_bytes")
    )


#: Bits of a chunk's id that its place in the document takes.
ORDINAL_BITS = 24


def chunk_id(document_id: Column, ordinal: Column) -> Column:
    """A number for each place of each document: unique for up to 2**ORDINAL_BITS chunks of each of 2**39 documents."""
    return F.shiftleft(document_id.cast("bigint"), ORDINAL_BITS).bitwiseOR(ordinal.cast("bigint"))


def ingest(docs: DataFrame, options: ChunkOptions = ChunkOptions(), above: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sound documents (title, source, content, import_seq), deduplicated, with ids; their chunks; and those without a chunk.

    New rows are computed before anything is replaced, so a document that can't be cut never costs the old one.
    Documents and chunks come from one written table and so agree on their ids.
    """
    sound = document_problems(docs).where("problem is null").drop("problem")
    kept = staged(with_ids(latest(sound), above), "imported")
    chunks = with_source(chunk_documents(kept, options), kept).withColumn("chunk_id", chunk_id(F.col("document_id"), F.col("ordinal")))
    chunks = staged(chunks, "chunks")
    cut = chunks.select(F.col("document_id").alias("id")).distinct()
    return kept.join(cut, "id", "left_semi"), chunks, kept.join(cut, "id", "left_anti")


def embedded(chunks: DataFrame, embedder: Embedder) -> DataFrame:
    """``chunks`` with ``embedding``, that of the heading and the text."""
    return embedder.embed(chunks.withColumn("_text", index_text(F.col("heading"), F.col("content"))), "_text").drop("_text")
