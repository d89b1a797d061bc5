"""BM25: an index as plain tables, and ranked retrieval for whole batches of queries in one plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gleanspark.functions.text import tokenize

K1, B = 1.2, 0.75
#: Scores are ranked at this precision, so that the order of summation can't flip near-ties.
PLACES = 9


@dataclass(frozen=True)
class LexicalIndex:
    """postings: key, token, f, weight (what the token adds to the chunk's score); vocabulary: token, df, idf; lengths: key, dl, norm."""

    postings: DataFrame
    vocabulary: DataFrame
    lengths: DataFrame


def term_frequencies(chunks: DataFrame, key: str = "key", text: str = "text", scheme: str = "bigram") -> DataFrame:
    """(key, token, f) of the chunks' index texts."""
    return chunks.select(F.col(key), F.explode(tokenize(F.col(text), scheme)).alias("token")).groupBy(key, "token").agg(F.count(F.lit(1)).alias("f"))


def lengths(chunks: DataFrame, key: str = "key", text: str = "text", scheme: str = "bigram") -> DataFrame:
    """(key, dl): tokens of every chunk, those without any too."""
    return chunks.select(F.col(key), F.size(tokenize(F.col(text), scheme)).cast("long").alias("dl"))


def statistics(lens: DataFrame) -> DataFrame:
    """One row: n chunks and avgdl over all of them."""
    return lens.agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))


def norm(dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """Length norm; without any length it is k1."""
    return F.when(F.coalesce(avgdl, F.lit(0.0)) == 0, F.lit(float(k1))).otherwise(k1 * (1 - b + b * dl / F.nullif(avgdl, F.lit(0.0))))


def idf(n: Column, df: Column) -> Column:
    """Never negative: ln(1 + (n - df + 0.5) / (df + 0.5))."""
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def index(chunks: DataFrame, key: str = "key", text: str = "text", scheme: str = "bigram", k1: float = K1, b: float = B) -> LexicalIndex:
    """The index of ``chunks``; rebuilding one is calling this again.

    Statistics are one row and are joined by broadcast. Weights are fixed here, so that a search is a join of its
    tokens with the postings and one sum.
    """
    tf = term_frequencies(chunks, key, text, scheme)
    dl = lengths(chunks, key, text, scheme)
    stats = F.broadcast(statistics(dl))
    lens = dl.crossJoin(stats).select(key, "dl", norm(F.col("dl"), F.col("avgdl"), k1, b).alias("norm"))
    vocabulary = tf.groupBy("token").agg(F.count(F.lit(1)).alias("df")).crossJoin(stats).select("token", "df", idf(F.col("n"), F.col("df")).alias("idf"))
    postings = tf.join(vocabulary, "token").join(lens, key)
    postings = postings.select(key, "token", "f", (F.col("idf") * F.col("f") * (k1 + 1) / (F.col("f") + F.col("norm"))).alias("weight"))
    return LexicalIndex(postings, vocabulary, lens)


def ranked(scores: DataFrame, top_k: int = 10, by: str = "query_id", key: str = "key", score: str = "score") -> DataFrame:
    """Adds rank (from 1), best score first, equal ones by the key as text; at most ``top_k`` a query, all if not positive."""
    w = W.partitionBy(by).orderBy(F.round(F.col(score), PLACES).desc(), F.col(key).cast("string"))
    out = scores.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= top_k) if top_k > 0 else out


def search(idx: LexicalIndex, queries: DataFrame, top_k: int = 10, scheme: str = "bigram", key: str = "key") -> DataFrame:
    """(query_id, key, score, rank) for queries (query_id, query): each distinct token counts once, scores are positive.

    Queries of the same tokens have the same results, so one of them is searched for all.
    """
    asked = queries.select("query_id", F.array_distinct(tokenize(F.col("query"), scheme)).alias("tokens")).where(F.size("tokens") > 0)
    asked = asked.groupBy("query_id").agg(F.array_sort(F.flatten(F.collect_list("tokens"))).alias("tokens"))
    leads = asked.groupBy("tokens").agg(F.min("query_id").alias("lead"))
    terms = leads.select("lead", F.explode("tokens").alias("token"))
    scores = terms.join(idx.postings, "token").groupBy("lead", key).agg(F.sum("weight").alias("score")).where("score > 0")
    found = ranked(scores, top_k, by="lead", key=key)
    members = asked.join(leads, "tokens").select("query_id", F.col("lead").alias("_lead"))
    return found.join(members, F.col("lead").eqNullSafe(F.col("_lead"))).select("query_id", key, "score", "rank")
