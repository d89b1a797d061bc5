"""Retrieval quality: expected quotes, recall, reciprocal rank, NDCG, bands of scores, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: What a gate holds and by how much it may fall.
TOLERANCE = 0.05


def locate(text: Column, quote: Column, occurrence: Column) -> Column:
    """0-based start of the nth occurrence of ``quote`` without overlaps; null if there are fewer."""
    step = F.greatest(F.length(quote), F.lit(1))
    turns = F.sequence(F.lit(1), F.greatest(occurrence, F.lit(1)))
    # where the search stands: 0 once it has failed
    end = F.aggregate(turns, F.lit(1), lambda at, _: _next(text, quote, at, step))
    return F.when((F.length(quote) > 0) & (end > 0), end - step - 1)


def _next(text: Column, quote: Column, at: Column, step: Column) -> Column:
    found = F.position(quote, text, at)
    return F.when((at > 0) & (found > 0), found + step).otherwise(0)


def occurrences(text: Column, quote: Column) -> Column:
    """How often ``quote`` occurs without overlaps."""
    return F.when(F.length(quote) > 0, ((F.length(text) - F.length(F.replace(text, quote))) / F.length(quote)).cast("int")).otherwise(0)


def located(expects: DataFrame) -> DataFrame:
    """``expects`` (text, quote, occurrence) with start, end_ and problem: empty, not found, ambiguous (unset and found more than once)."""
    n = occurrences(F.col("text"), F.col("quote"))
    unset = F.coalesce("occurrence", F.lit(0)) <= 0
    problem = F.when(F.length("quote") == 0, "empty").when((n == 0) | (~unset & (F.col("occurrence") > n)), "not found").when(unset & (n > 1), "ambiguous")
    at = locate(F.col("text"), F.col("quote"), F.when(unset, 1).otherwise(F.col("occurrence")))
    return expects.withColumn("problem", problem).withColumn("start_offset", F.when(F.col("problem").isNull(), at)).withColumn("end_offset", F.col("start_offset") + F.length("quote"))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Half-open spans share a position; empty ones never do."""
    return F.greatest(a_start, b_start) < F.least(a_end, b_end)


def covering(results: DataFrame, expects: DataFrame) -> DataFrame:
    """(channel, query_id, expect_id, grade, rank) of results whose source is the expected one, not empty, and whose span overlaps."""
    e = expects.select("query_id", "expect_id", "grade", F.col("source").alias("_source"), F.col("start_offset").alias("_a"), F.col("end_offset").alias("_b"))
    hit = (F.col("_source") != "") & (F.col("_source") == F.col("source")) & overlaps(F.col("start_offset"), F.col("end_offset"), F.col("_a"), F.col("_b"))
    return results.join(e, "query_id").where(hit).select("channel", "query_id", "expect_id", "grade", "rank")


def scores(results: DataFrame, expects: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(channel, query_id, group, recall, rr, ndcg) for every query and channel; queries without a hit have zeros.

    An expectation is met at its first covering rank; a rank's gain is the best grade first met there. Recall and
    the reciprocal rank use all results, NDCG the first ``k``.
    """
    first = covering(results, expects).groupBy("channel", "query_id", "expect_id", "grade").agg(F.min("rank").alias("rank"))
    gain = (F.pow(F.lit(2.0), F.max("grade")) - 1).alias("gain")
    by_rank = first.groupBy("channel", "query_id", "rank").agg(F.count(F.lit(1)).alias("met"), gain)
    discount = F.log2(F.col("rank") + 1)
    got = by_rank.groupBy("channel", "query_id").agg(F.sum("met").alias("met"), F.min("rank").alias("best"), F.sum(F.when(F.col("rank") <= k, F.col("gain") / discount).otherwise(0.0)).alias("dcg"))
    w = W.partitionBy("query_id").orderBy(F.col("grade").desc(), "expect_id")
    ideal = expects.withColumn("rank", F.row_number().over(w)).groupBy("query_id").agg(
        F.count(F.lit(1)).alias("expected"), F.sum(F.when(F.col("rank") <= k, (F.pow(F.lit(2.0), F.col("grade")) - 1) / discount).otherwise(0.0)).alias("idcg")
    )
    every = queries.select("query_id", "group").crossJoin(results.select("channel").distinct())
    joined = every.join(ideal, "query_id", "left").join(got, ["channel", "query_id"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return joined.select(
        "channel", "query_id", "group", zero(F.col("met") / F.nullif(F.col("expected"), F.lit(0))).alias("recall"), zero(1 / F.col("best")).alias("rr"), zero(F.col("dcg") / F.nullif(F.col("idcg"), F.lit(0.0))).alias("ndcg")
    )


def metrics(scored: DataFrame) -> DataFrame:
    """(channel, group, n_queries, recall, mrr, ndcg): means over queries by group, and over all of them (group null)."""
    means = [F.count(F.lit(1)).alias("n_queries"), F.avg("recall").alias("recall"), F.avg("rr").alias("mrr"), F.avg("ndcg").alias("ndcg")]
    return scored.groupingSets([["channel", "group"], ["channel"]], "channel", "group").agg(*means)


def missed(results: DataFrame, expects: DataFrame, channel: str = "fused") -> DataFrame:
    """Expectations that no result of the channel covers."""
    met = covering(results.where(F.col("channel") == channel), expects).select("query_id", "expect_id").distinct()
    return expects.join(met, ["query_id", "expect_id"], "left_anti")


def detail(results: DataFrame, expects: DataFrame) -> DataFrame:
    """Results with ``relevant``."""
    met = covering(results, expects).select("channel", "query_id", "rank", F.lit(True).alias("relevant")).distinct()
    return results.join(met, ["channel", "query_id", "rank"], "left").withColumn("relevant", F.coalesce("relevant", F.lit(False)))


def score_bands(results: DataFrame, expects: DataFrame, queries: DataFrame) -> DataFrame:
    """(score_kind, kind, n, p50, p90, low, high) of fused and vector scores of relevant, irrelevant and no-answer results."""
    fused = detail(results.where("channel = 'fused'"), expects).join(queries.select("query_id", "group"), "query_id")
    kind = F.when(F.col("group") == "norel", "norel").when(F.col("relevant"), "rel").otherwise("irr")
    tall = fused.select(kind.alias("kind"), F.expr("stack(2, 'rrf', score, 'cos', coalesce(vector_score, 0D)) as (score_kind, value)"))
    return tall.groupBy("score_kind", "kind").agg(F.count(F.lit(1)).alias("n"), *quantiles("value", {"p50": 0.5, "p90": 0.9}), F.min("value").alias("low"), F.max("value").alias("high"))


def quantiles(column: str, points: dict[str, float]) -> list[Column]:
    """Nearest-rank quantiles."""
    return [F.expr(f"percentile_disc({p}) within group (order by {column})").alias(name) for name, p in points.items()]


def distinct_sources(results: DataFrame, queries: DataFrame) -> DataFrame:
    """(channel, distinct_docs): the mean number of sources in a query's results, over all queries."""
    per = results.groupBy("channel", "query_id").agg(F.count_distinct("source").alias("n"))
    total = queries.agg(F.count(F.lit(1)).alias("total"))
    return per.groupBy("channel").agg(F.sum("n").alias("n")).crossJoin(F.broadcast(total)).select("channel", (F.col("n") / F.col("total")).alias("distinct_docs"))


def gains(table: DataFrame) -> DataFrame:
    """(group, fused, best_single, better, gain) from metrics by channel: fused recall over the better single channel, lexical on a tie."""
    wide = table.groupBy("group").pivot("channel", ["lexical", "vector", "fused"]).agg(F.first("recall"))
    return wide.select("group", "fused", F.greatest("lexical", "vector").alias("best_single"), F.when(F.col("vector") > F.col("lexical"), "vector").otherwise("lexical").alias("better"), (F.col("fused") - F.greatest("lexical", "vector")).alias("gain"))


def lexical_required(scored: DataFrame, queries: DataFrame) -> DataFrame:
    """One row over the queries that require words: total, lexical_found, vector_only."""
    wide = scored.join(queries.where("require_lexical").select("query_id"), "query_id").groupBy("query_id").pivot("channel", ["lexical", "vector"]).agg(F.first("recall"))
    return wide.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("lexical") >= 1).alias("lexical_found"), F.count_if((F.col("lexical") < 1) & (F.col("vector") >= 1)).alias("vector_only"))


def gate(base: DataFrame, current: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(metric, base, current, status): fail where a metric is missing or fell by more than ``tolerance``."""
    joined = base.select("metric", F.col("value").alias("base")).join(current.select("metric", F.col("value").alias("current")), "metric", "left")
    return joined.withColumn("status", F.when(F.col("current").isNull() | (F.col("base") - F.col("current") > tolerance), "fail").otherwise("pass"))


def query_problems(queries: DataFrame) -> DataFrame:
    """(query_id, problem) of queries (query_id, query, kind, group, n_expects): repeated ids and texts, unknown kinds, missing expectations."""
    same = F.lower(F.trim("query"))
    q = queries.withColumn("_ids", F.count(F.lit(1)).over(W.partitionBy("query_id"))).withColumn("_texts", F.count(F.lit(1)).over(W.partitionBy(same)))
    found = F.array(
        F.when(F.col("_ids") > 1, "repeated id"), F.when(F.col("_texts") > 1, "repeated query"), F.when(~F.col("kind").isin("direct", "indirect", "multi-hop"), "unknown kind"),
        F.when((F.col("group") != "norel") & (F.col("n_expects") == 0), "no expectation"), F.when((F.col("group") == "norel") & (F.col("n_expects") > 0), "unexpected expectation"),
    )
    return q.select("query_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))


def fingerprint(text: Column) -> Column:
    """SHA-256 of the text with LF line ends."""
    return F.sha2(F.replace(F.replace(text, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), 256)


def manifest_problems(files: DataFrame) -> DataFrame:
    """(source, problem) of manifest rows (source, path, sha256): blank fields, bad hashes, repeated sources."""
    files = files.withColumn("_n", F.count(F.lit(1)).over(W.partitionBy("source")))
    found = F.array(
        F.when(F.trim(F.coalesce("source", F.lit(""))) == "", "blank source"), F.when(F.trim(F.coalesce("path", F.lit(""))) == "", "blank path"),
        F.when(~F.coalesce("sha256", F.lit("")).rlike("^[0-9a-fA-F]{64}$"), "bad hash"), F.when(F.col("_n") > 1, "repeated source"),
    )
    return files.select("source", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("problem"))


def drift(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source, recorded, actual) where the number of chunks differs from the recorded one; 0 recorded is not checked."""
    actual = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("actual"))
    joined = files.select("source", F.col("chunks_at_default").alias("recorded")).where("recorded > 0").join(actual, "source", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return joined.where("recorded <> actual")


def shared_tokens(queries: DataFrame, expects: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, shared): tokens that a query shares with the chunks overlapping its first located expectation."""
    first = expects.where("start_offset is not null").groupBy("query_id").agg(F.min_by(F.struct("source", "start_offset", "end_offset"), "expect_id").alias("e"))
    c = chunks.select(F.col("source").alias("_source"), F.col("start_offset").alias("_a"), F.col("end_offset").alias("_b"), "tokens")
    near = first.join(c, (F.col("e.source") == F.col("_source")) & overlaps(F.col("e.start_offset"), F.col("e.end_offset"), F.col("_a"), F.col("_b")))
    own = queries.select("query_id", F.col("tokens").alias("_own"))
    return near.join(own, "query_id").groupBy("query_id").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array_intersect("_own", "tokens"))))).alias("shared"))


def expanded(fused: DataFrame, chunks: DataFrame, expects: DataFrame, queries: DataFrame, n: int = 1) -> DataFrame:
    """(query_id, recall) of fused results together with up to ``n`` chunks before and after each, each chunk once."""
    place = chunks.select("document_id", "ordinal", "source", "start_offset", "end_offset", "chunk_id")
    w = W.partitionBy("document_id").orderBy("ordinal", "chunk_id")
    placed = place.withColumn("place", F.row_number().over(w))
    hit = fused.select("query_id", "rank", "document_id", "ordinal").join(placed.select("document_id", "ordinal", "place"), ["document_id", "ordinal"])
    near = hit.select("query_id", "rank", "document_id", F.explode(F.sequence(F.col("place") - n, F.col("place") + n)).alias("place"))
    once = near.groupBy("query_id", "document_id", "place").agg(F.min("rank").alias("rank")).join(placed, ["document_id", "place"])
    results = once.select(F.lit("expanded").alias("channel"), "query_id", "rank", "source", "start_offset", "end_offset")
    # merged hits span more than the chunk that names them
    own = fused.select(F.lit("expanded").alias("channel"), "query_id", "rank", "source", "start_offset", "end_offset")
    return scores(results.unionByName(own), expects, queries).select("query_id", "recall")


#: What a gate holds, by channel and metric.
GATED = (("fused", "recall"), ("fused", "ndcg"), ("fused", "mrr"), ("lexical", "recall"), ("vector", "recall"))


def overall(table: DataFrame) -> DataFrame:
    """(metric, value) of the means over all queries, from ``metrics``: what a gate is built of."""
    rows = [F.max(F.when(F.col("group").isNull() & (F.col("channel") == c), F.col(m))).alias(f"{c}_{m}") for c, m in GATED]
    wide = table.agg(*rows)
    return wide.select(F.explode(F.array(*(F.struct(F.lit(f"{c}_{m}").alias("metric"), F.col(f"{c}_{m}").alias("value")) for c, m in GATED))).alias("x")).select("x.*").where("value is not null")


def stamped(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """``files`` (source, path, sha256, chunks_at_default, content) with hashes and numbers of chunks as they are, and ``changed``."""
    actual = chunks.groupBy("source").agg(F.count(F.lit(1)).cast("int").alias("actual"))
    joined = files.join(actual, "source", "left").withColumn("actual", F.coalesce("actual", F.lit(0))).withColumn("hash", fingerprint(F.col("content")))
    changed = ~(F.lower("sha256").eqNullSafe(F.col("hash")) & F.col("chunks_at_default").eqNullSafe(F.col("actual")))
    return joined.select("source", "path", F.when(changed, F.col("hash")).otherwise(F.col("sha256")).alias("sha256"), F.col("actual").alias("chunks_at_default"), "content", changed.alias("changed"))
