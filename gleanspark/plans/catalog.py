"""Registered queries of the retrieval engine and their SQL.

Scores are rounded to six places after ranking at nine, so that two engines' orders of summation agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from gleanspark.functions import text as T
from gleanspark.operators import chunking, embed, evaluate, fusion, ingest, lexical, vector
from gleanspark.plans import fixtures as X
from gleanspark.plans.shipping import shipped

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = shipped(f)
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- SQL that several queries share

_CJK = r"[\p{Han}\p{Hiragana}\p{Katakana}]"
_PAIRS = "CASE WHEN length(r) = 1 THEN [r] ELSE list_transform(range(1, length(r)), lambda i: substring(r, i, 2)) END"
_SINGLE = "list_transform(range(1, length(r) + 1), lambda i: substring(r, i, 1))"
_BOTH = f"CASE WHEN length(r) = 1 THEN [r] ELSE list_concat({_SINGLE}, {_PAIRS}) END"


def sql_fold(x: str) -> str:
    return f"translate({x}, {X.literal(T.WIDE)}, {X.literal(T.NARROW)})"


def sql_tokens(x: str, scheme: str = "bigram") -> str:
    parts = {"bigram": _PAIRS, "unigram": _SINGLE, "both": _BOTH}[scheme]
    runs = f"regexp_extract_all(regexp_replace({sql_fold(f"coalesce({x}, '')")}, '({_CJK}+)', ' \\1 ', 'g'), '{_CJK}+|[\\p{{L}}\\p{{Nd}}]+')"
    return f"flatten(list_transform({runs}, lambda r: CASE WHEN regexp_matches(r, '^{_CJK}') THEN {parts} ELSE [lower(r)] END))"


def sql_index(chunks: str = "SELECT doc_id AS key, text FROM documents", scheme: str = "bigram", k1: float = 1.2, b: float = 0.75) -> str:
    """CTEs toks, tf, stats, vocab, lens and postings."""
    return f"""
    src AS ({chunks}), toks AS (SELECT key, {sql_tokens("text", scheme)} AS t FROM src),
    tf AS (SELECT key, token, count(*) AS f FROM (SELECT key, unnest(t) AS token FROM toks) GROUP BY ALL),
    dls AS (SELECT key, len(t)::BIGINT AS dl FROM toks), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dls),
    lens AS (SELECT key, dl, CASE WHEN avgdl = 0 THEN {k1} ELSE {k1} * (1 - {b} + {b} * dl / avgdl) END AS norm FROM dls, stats),
    vocab AS (SELECT token, count(*) AS df, ln(1 + (any_value(n) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf, stats GROUP BY token),
    postings AS (SELECT key, token, f, idf * f * ({k1} + 1) / (f + norm) AS weight FROM tf JOIN vocab USING (token) JOIN lens USING (key))"""


def sql_search(name: str, queries: str, top_k: int, scheme: str = "bigram") -> str:
    """CTEs for ranked lexical results of ``queries`` (query_id, query)."""
    limit = f"QUALIFY rank <= {top_k}" if top_k > 0 else ""
    return f"""
    {name}_q AS ({queries}), {name}_t AS (SELECT query_id, unnest(list_distinct({sql_tokens("query", scheme)})) AS token FROM {name}_q),
    {name}_s AS (SELECT query_id, key, sum(weight) AS score FROM {name}_t JOIN postings USING (token) GROUP BY ALL HAVING sum(weight) > 0),
    {name} AS (SELECT query_id, key, score, {sql_rank()} AS rank FROM {name}_s {limit})"""


def sql_rank(by: str = "query_id", key: str = "key") -> str:
    return f"row_number() OVER (PARTITION BY {by} ORDER BY round(score, 9) DESC, CAST({key} AS VARCHAR))::INT"


_ASKED = "SELECT item_id AS query_id, text AS query FROM benchmark"
_OUT = "SELECT query_id, key, rank, round(score, 6) AS score FROM"


def documents(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), "text")


def asked(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


# ---------------------------------------------------------------- text functions


@query(f"SELECT doc_id, len({sql_tokens('text')})::BIGINT AS n_tokens, len(list_distinct({sql_tokens('text')}))::BIGINT AS n_distinct, sha256(array_to_string({sql_tokens('text')}, ' ')) AS digest FROM documents")
def tokenize_documents(spark, sf_dir):
    tokens = table(spark, sf_dir, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"), F.sha2(F.array_join("t", " "), 256).alias("digest"))


@query("SELECT id, " + ", ".join(f"array_to_string({sql_tokens('text', s)}, '|') AS {s}" for s in T.SCHEMES) + f" FROM {X.TEXTS.sql()}")
def tokenize_cjk_schemes(spark, sf_dir):
    return X.TEXTS.frame(spark).select("id", *(F.array_join(T.tokenize(F.col("text"), s), "|").alias(s) for s in T.SCHEMES))


@query(f"SELECT id, {sql_fold('text')} AS folded FROM {X.TEXTS.sql()}")
def fold_width(spark, sf_dir):
    return X.TEXTS.frame(spark).select("id", T.fold_width(F.col("text")).alias("folded"))


_TITLE = "regexp_replace(regexp_replace(string_split(content, chr(10))[1], '^#+', ''), '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT id, CASE WHEN trim(coalesce(title, '')) <> '' THEN trim(title) WHEN l = '' THEN '未命名文档' WHEN length(l) > 60 THEN substring(l, 1, 60) || '…' ELSE l END AS title FROM (SELECT id, title, {_TITLE} AS l FROM {X.TITLES.sql()})")
def title_derivation(spark, sf_dir):
    return X.TITLES.frame(spark).select("id", T.title_of(F.col("content"), F.col("title")).alias("title"))


# ---------------------------------------------------------------- lexical retrieval


@query(f"WITH {sql_index()} SELECT key, count(*) AS tokens, sum(f)::BIGINT AS total, max(f) AS most FROM tf GROUP BY key")
def term_freq(spark, sf_dir):
    tf = lexical.term_frequencies(documents(spark, sf_dir))
    return tf.groupBy("key").agg(F.count(F.lit(1)).alias("tokens"), F.sum("f").alias("total"), F.max("f").alias("most"))


@query(f"WITH {sql_index()} SELECT token, df, round(idf, 6) AS idf FROM vocab")
def doc_freq(spark, sf_dir):
    return rounded(lexical.index(documents(spark, sf_dir)).vocabulary, "idf")


@query(f"WITH {sql_index()} SELECT n, round(avgdl, 6) AS avgdl FROM stats")
def bm25_stats(spark, sf_dir):
    return rounded(lexical.statistics(lexical.lengths(documents(spark, sf_dir))), "avgdl")


@query(f"WITH {sql_index()} SELECT key, dl, round(norm, 6) AS norm FROM lens")
def bm25_norms(spark, sf_dir):
    return rounded(lexical.index(documents(spark, sf_dir)).lengths, "norm")


@query(f"WITH {sql_index()}, {sql_search('hits', 'SELECT item_id AS query_id, text AS query FROM benchmark ORDER BY item_id LIMIT 1', 10)} {_OUT} hits")
def bm25_topk(spark, sf_dir):
    one = asked(spark, sf_dir).orderBy("query_id").limit(1)
    return rounded(lexical.search(lexical.index(documents(spark, sf_dir)), one, 10), "score")


@query(f"WITH {sql_index()}, {sql_search('hits', _ASKED, 10)} {_OUT} hits")
def bm25_batch_topk(spark, sf_dir):
    return rounded(lexical.search(lexical.index(documents(spark, sf_dir)), asked(spark, sf_dir), 10), "score")


@query(f"WITH {sql_index(scheme='unigram', k1=2.0, b=0.3)}, {sql_search('hits', _ASKED, 5, 'unigram')} {_OUT} hits")
def bm25_params(spark, sf_dir):
    idx = lexical.index(documents(spark, sf_dir), scheme="unigram", k1=2.0, b=0.3)
    return rounded(lexical.search(idx, asked(spark, sf_dir), 5, "unigram"), "score")


_SMALL = X.Inline("key bigint, text string", ((1, "向量检索入门"), (2, "检索与数据库"), (10, "same words here"), (2000, "same words here"), (3, ""), (4, None)))
_SMALL_Q = X.Inline("query_id bigint, query string", ((1, "向量检索"), (2, "检索 检索"), (3, "same words"), (4, "absent"), (5, "")))


@query(f"WITH {sql_index(f'SELECT * FROM {_SMALL.sql()}')}, {sql_search('hits', f'SELECT * FROM {_SMALL_Q.sql()}', 0)} {_OUT} hits")
def bm25_edge_cases(spark, sf_dir):
    return rounded(lexical.search(lexical.index(_SMALL.frame(spark)), _SMALL_Q.frame(spark), 0), "score")


# ---------------------------------------------------------------- vectors

_V = "SELECT vec_id AS key, embedding::DOUBLE[] AS v FROM embeddings WHERE embedding IS NOT NULL"


def sql_cosine(name: str, queries: str, top_k: int) -> str:
    return f"""
    {name}_s AS (SELECT q.key AS query_id, c.key, list_cosine_similarity(q.v, c.v) AS score FROM ({queries}) q, ({_V}) c),
    {name} AS (SELECT query_id, key, score, {sql_rank()} AS rank FROM {name}_s QUALIFY rank <= {top_k})"""


def vectors(spark, sf_dir) -> DataFrame:
    return vector.index(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").alias("vector")), 64)


def _asking(df: DataFrame) -> DataFrame:
    return df.select(F.col("key").alias("query_id"), "vector")


@query(f"SELECT key, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM ({_V})")
def vector_norms(spark, sf_dir):
    return rounded(vectors(spark, sf_dir).select("key", "norm"), "norm")


@query(f"WITH {sql_cosine('hits', f'SELECT * FROM ({_V}) WHERE key = 0', 10)} {_OUT} hits")
def cosine_topk(spark, sf_dir):
    idx = vectors(spark, sf_dir)
    return rounded(vector.search(idx, _asking(idx.where("key = 0")), 10), "score")


@query(f"WITH {sql_cosine('hits', f'SELECT * FROM ({_V}) WHERE key % 20 = 0', 10)} {_OUT} hits")
def cosine_batch_topk(spark, sf_dir):
    idx = vectors(spark, sf_dir)
    return rounded(vector.search(idx, _asking(idx.where("key % 20 = 0")), 10), "score")


_PROBES = f"SELECT key, v FROM (SELECT *, row_number() OVER (ORDER BY key) - 1 AS i, greatest(1, count(*) OVER () // 50) AS step FROM ({_V})) WHERE i % step = 0 AND i / step < 50"


@query(f"""WITH {sql_cosine('truth', _PROBES, 10)}, {sql_cosine('part', _PROBES, 5)},
    a AS (SELECT query_id, list(key) AS want FROM truth GROUP BY 1), b AS (SELECT query_id, list(key) AS got FROM part GROUP BY 1)
    SELECT query_id, len(list_intersect(got, want)) / len(want) AS overlap, list_contains(got, query_id) AS self_hit FROM a JOIN b USING (query_id)""")
def self_recall_overlap(spark, sf_dir):
    """A search that finds only the better half, held against the exact one."""
    idx = vectors(spark, sf_dir)
    q = _asking(vector.probes(idx, 50))
    return vector.overlap(vector.search(idx, q, 5), vector.search(idx, q, 10))


def sql_fnv(x: str) -> str:
    octets = f"list_transform(range(0, octet_length(encode({x}))), lambda i: ('0x' || substring(hex(encode({x})), 2 * i + 1, 2))::BIGINT)"
    return f"list_reduce(list_prepend(2166136261::BIGINT, {octets}), lambda h, o: (xor(h, o) * 16777619) % 4294967296)"


def sql_buckets(name: str, texts: str, key: str = "key", dim: int = 1024) -> str:
    """CTEs for the hash vectors' components (key, bucket, n, weight) of ``texts`` (key, text)."""
    return f"""
    {name}_t AS (SELECT {key}, unnest(CASE WHEN len(t) = 0 THEN [NULL] ELSE t END) AS token FROM (SELECT {key}, {sql_tokens("text")} AS t FROM ({texts}))),
    {name}_f AS (SELECT {key}, token, count(*) AS f FROM {name}_t GROUP BY ALL), {name}_v AS (SELECT token, {sql_fnv("token")} % {dim} AS bucket FROM (SELECT DISTINCT token FROM {name}_f WHERE token IS NOT NULL)),
    {name}_n AS (SELECT {key}, coalesce(bucket, 0)::INT AS bucket, sum(f)::BIGINT AS n FROM {name}_f LEFT JOIN {name}_v USING (token) GROUP BY ALL),
    {name} AS (SELECT {key}, bucket, n, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS weight FROM {name}_n)"""


_TEXTED = f"SELECT doc_id AS key, text FROM documents WHERE length(translate(coalesce(text, ''), {X.literal(T.SPACES)}, '')) > 0"


@query(f"WITH {sql_buckets('b', _TEXTED)} SELECT key, bucket, n, round(weight, 6) AS weight FROM b")
def hash_embed_buckets(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return rounded(embed.HashEmbedder().buckets(docs.where(~T.blank(F.col("text"))), "key"), "weight")


@query("SELECT key, CAST(h AS BIGINT) AS hash FROM (VALUES ('hello', 1335831723), ('检索', 4287181985), ('', 2166136261)) AS v(key, h)")
def fnv1a_hash(spark, sf_dir):
    return spark.createDataFrame([("hello",), ("检索",), ("",)], "key string").select("key", T.fnv1a32(F.col("key")).alias("hash"))


# ---------------------------------------------------------------- fusion

#: Two rankings of the same vectors, so that SQL can follow: by cosine, and by the words of a synthetic text.
_WORDS = "SELECT vec_id AS key, 'label ' || label || ' group ' || (vec_id % 7) AS text FROM embeddings WHERE embedding IS NOT NULL"
_WORDS_Q = "SELECT vec_id AS query_id, 'label ' || label || ' group ' || (vec_id % 7) AS query FROM embeddings WHERE embedding IS NOT NULL AND vec_id % 20 = 0"


def sql_fuse(k: int = 60, top_k: int = 10, depth: int = 10) -> str:
    limit = f"QUALIFY rank <= {top_k}" if top_k else ""
    return f"""WITH {sql_index(_WORDS)}, {sql_search('lx', _WORDS_Q, depth)}, {sql_cosine('vx', f'SELECT * FROM ({_V}) WHERE key % 20 = 0', depth)},
    both_ AS (SELECT query_id, key, lx.score AS ls, vx.score AS vs, lx.rank AS lr, vx.rank AS vr, coalesce(1.0::DOUBLE / ({k} + lx.rank), 0) + coalesce(1.0::DOUBLE / ({k} + vx.rank), 0) AS score FROM lx FULL JOIN vx USING (query_id, key)),
    fused AS (SELECT *, {sql_rank()} AS rank FROM both_ {limit})"""


def channels(spark, sf_dir, depth: int = 10) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "embeddings").where("embedding is not null")
    text = F.concat(F.lit("label "), F.col("label").cast("string"), F.lit(" group "), (F.col("vec_id") % 7).cast("string"))
    texts = rows.select(F.col("vec_id").alias("key"), text.alias("text"))
    q = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), text.alias("query"))
    idx = vectors(spark, sf_dir)
    return lexical.search(lexical.index(texts), q, depth), vector.search(idx, _asking(idx.where("key % 20 = 0")), depth)


@query(sql_fuse() + " SELECT query_id, key, rank, round(score, 6) AS score, round(coalesce(ls, 0), 6) AS lexical_score, round(coalesce(vs, 0), 6) AS vector_score, coalesce(lr, 0) AS lexical_rank, coalesce(vr, 0) AS vector_rank FROM fused")
def rrf_fuse(spark, sf_dir):
    fused = fusion.fuse(*channels(spark, sf_dir)).drop("matched_by")
    return rounded(fused, "score", "lexical_score", "vector_score")


@query(sql_fuse(top_k=0, depth=30) + " SELECT query_id, key, rank, round(score, 6) AS score FROM fused")
def search_all(spark, sf_dir):
    """As deep as three times the default in each channel, not cut after fusion."""
    n = fusion.depth(10, 3)
    return rounded(fusion.fuse(*channels(spark, sf_dir, n), truncate=False).select("query_id", "key", "rank", "score"), "score")


_SWEEP = [(k, m) for k in (10, 60) for m in (1, 4)]


@query(" UNION ALL ".join(f"SELECT * FROM ({sql_fuse(k, 10, 10 * m)} SELECT {k} AS k, {m} AS mult, count(*) AS n, round(sum(score), 6) AS total FROM fused)" for k, m in _SWEEP))
def rrf_sweep(spark, sf_dir):
    out, found = None, {m: channels(spark, sf_dir, fusion.depth(10, m)) for m in {m for _, m in _SWEEP}}
    for k, m in _SWEEP:
        fused = fusion.fuse(*found[m], 10, k)
        row = fused.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("score"), 6).alias("total")).select(F.lit(k).alias("k"), F.lit(m).alias("mult"), "n", "total")
        out = row if out is None else out.union(row)
    return out


@query(sql_fuse() + " SELECT query_id, key, CASE WHEN lr > 0 AND vr > 0 THEN 'lexical+vector' WHEN lr > 0 THEN 'lexical' ELSE 'vector' END AS matched_by, (lr > 0 AND vr > 0) IS TRUE AS by_both FROM fused")
def matched_by(spark, sf_dir):
    return fusion.fuse(*channels(spark, sf_dir)).select("query_id", "key", "matched_by", (F.col("matched_by") == "lexical+vector").alias("by_both"))


@query(f"""WITH {sql_index()}, {sql_search('lx', _ASKED, 10)}, {sql_buckets('b', _TEXTED, 'key', 256)}, {sql_buckets('q', 'SELECT item_id AS query_id, text FROM benchmark', 'query_id', 256)},
    vx_s AS (SELECT query_id, key, sum(b.weight * q.weight) AS score FROM b JOIN q USING (bucket) GROUP BY ALL), vx AS (SELECT query_id, key, score, {sql_rank()} AS rank FROM vx_s QUALIFY rank <= 10),
    both_ AS (SELECT query_id, key, lx.score AS ls, vx.score AS vs, lx.rank AS lr, vx.rank AS vr, coalesce(1.0::DOUBLE / (60 + lx.rank), 0) + coalesce(1.0::DOUBLE / (60 + vx.rank), 0) AS score FROM lx FULL JOIN vx USING (query_id, key)),
    fused AS (SELECT *, {sql_rank()} AS rank FROM both_ QUALIFY rank <= 10)
    SELECT query_id, key, rank, round(score, 6) AS score, round(coalesce(ls, 0), 6) AS lexical_score, round(coalesce(vs, 0), 6) AS vector_score, coalesce(lr, 0) AS lexical_rank, coalesce(vr, 0) AS vector_rank FROM fused""")
def hybrid_search(spark, sf_dir):
    """Words and hash vectors over whole documents, all benchmark texts as queries."""
    e = embed.HashEmbedder(256)
    docs = documents(spark, sf_dir)
    texts, q = docs.where(~T.blank(F.col("text"))), asked(spark, sf_dir)
    near = vector.search(vector.index(e.vectors(texts, "key"), e.dim), e.vectors(q, "query_id", "query"), 10)
    fused = fusion.fuse(lexical.search(lexical.index(docs), q, 10), near, 10)
    return rounded(fused.drop("matched_by"), "score", "lexical_score", "vector_score")


@query(f"WITH {sql_index()}, {sql_search('hits', _ASKED, 10)} SELECT query_id, key, rank, round(1.0::DOUBLE / (60 + rank), 6) AS score, rank AS lexical_rank, 0 AS vector_rank FROM hits")
def lexical_only_degraded(spark, sf_dir):
    words = lexical.search(lexical.index(documents(spark, sf_dir)), asked(spark, sf_dir), 10)
    return rounded(fusion.fuse(words, words.limit(0), 10).select("query_id", "key", "rank", "score", "lexical_rank", "vector_rank"), "score")


# ---------------------------------------------------------------- merging and neighbours, over conversations: a document's turns are its chunks

_TURNS = """SELECT conv_id AS document_id, turn AS ordinal, conv_id * 1000 + turn AS chunk_id, content, role AS heading, s AS start_offset, s + length(content) AS end_offset FROM (
    SELECT *, (coalesce(sum(length(content)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - least(turn, 1) * 3 * turn)::BIGINT AS s FROM (SELECT conv_id, turn, role, 'x' || coalesce(text, '') || 'yz' AS content FROM conversations))"""
_HITS = f"""SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank FROM (
    SELECT document_id % 5 AS query_id, *, ((document_id * 37 + ordinal * 11) % 101) / 101.0::DOUBLE AS score FROM ({_TURNS}) WHERE (document_id * 31 + ordinal * 17) % 5 < 3)"""


def turns(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat(F.lit("x"), F.coalesce("text", F.lit("")), F.lit("yz")).alias("content"))
    before = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("content")).over(before), F.lit(0)) - F.least(F.col("turn"), F.lit(1)) * 3 * F.col("turn")
    c = c.withColumn("start_offset", start.cast("bigint")).withColumn("end_offset", F.col("start_offset") + F.length("content"))
    return c.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("ordinal"), (F.col("conv_id") * 1000 + F.col("turn")).alias("chunk_id"), "content", F.col("role").alias("heading"), "start_offset", "end_offset")


def hits(spark, sf_dir) -> DataFrame:
    h = turns(spark, sf_dir).where("(document_id * 31 + ordinal * 17) % 5 < 3").withColumn("query_id", F.col("document_id") % 5)
    h = h.withColumn("score", ((F.col("document_id") * 37 + F.col("ordinal") * 11) % 101) / F.lit(101.0))
    return h.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")))


@query(f"""WITH h AS ({_HITS}), r AS (SELECT *, ordinal - row_number() OVER (PARTITION BY query_id, document_id ORDER BY ordinal) AS run FROM h),
    p AS (SELECT *, coalesce(max(end_offset) OVER (PARTITION BY query_id, document_id, run ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), start_offset) AS seen FROM r),
    m AS (SELECT query_id, document_id, run, min(ordinal) AS ordinal, min(start_offset) AS start_offset, max(end_offset) AS end_offset, count(*) AS merged, arg_min(heading, ordinal) AS heading, arg_min(score, rank) AS score, min(rank) AS best,
        string_agg(substring(content, greatest(seen - start_offset, 0) + 1), '' ORDER BY ordinal) AS content FROM p GROUP BY ALL)
    SELECT query_id, document_id, ordinal, start_offset, end_offset, merged, heading, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY best)::INT AS rank, sha256(content) AS digest FROM m""")
def merge_adjacent(spark, sf_dir):
    m = fusion.merge_adjacent(hits(spark, sf_dir))
    return rounded(m.withColumn("digest", F.sha2("content", 256)).drop("content"), "score")


_NEAR = f"""WITH c AS ({_TURNS}), h AS ({_HITS}), placed AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY ordinal, chunk_id) AS place FROM c),
    near AS (SELECT h.query_id, h.chunk_id, (b.place - a.place)::INT AS distance, b.chunk_id AS neighbor_id, b.ordinal AS neighbor_ordinal, b.content AS neighbor_content FROM h JOIN placed a USING (chunk_id) JOIN placed b ON a.document_id = b.document_id AND b.place BETWEEN a.place - 2 AND a.place + 2 AND b.place <> a.place)"""


@query(_NEAR + " SELECT query_id, chunk_id, distance, neighbor_id, neighbor_ordinal, neighbor_content FROM near")
def neighbors(spark, sf_dir):
    return fusion.neighbors(hits(spark, sf_dir), turns(spark, sf_dir), 2)


@query(_NEAR + """ SELECT query_id, chunk_id, max(CASE WHEN distance = -1 THEN CASE WHEN length(neighbor_content) > 40 THEN '…' || right(neighbor_content, 40) ELSE neighbor_content END END) AS before,
    max(CASE WHEN distance = 1 THEN CASE WHEN length(neighbor_content) > 40 THEN left(neighbor_content, 40) || '…' ELSE neighbor_content END END) AS after FROM near WHERE abs(distance) = 1 GROUP BY ALL""")
def context_snippets(spark, sf_dir):
    near = fusion.neighbors(hits(spark, sf_dir), turns(spark, sf_dir), 1)
    side = lambda d, before: F.max(F.when(F.col("distance") == d, fusion.snippet(F.col("neighbor_content"), before, 40)))
    return near.groupBy("query_id", "chunk_id").agg(side(-1, True).alias("before"), side(1, False).alias("after"))


@query(f"WITH h AS ({_HITS}) SELECT query_id, rank, document_id, ordinal, heading, content, round(score, 6) AS score, 'id:' || chunk_id AS stable_key, CASE WHEN heading = '' THEN content ELSE heading || chr(10) || content END AS index_text FROM h WHERE rank <= 10")
def result_projection(spark, sf_dir):
    h = hits(spark, sf_dir).where("rank <= 10")
    key = T.stable_key(F.col("chunk_id"), F.col("document_id"), F.col("ordinal"))
    return rounded(h.select("query_id", "rank", "document_id", "ordinal", "heading", "content", "score", key.alias("stable_key"), T.index_text(F.col("heading"), F.col("content")).alias("index_text")), "score")


# ---------------------------------------------------------------- import

_BLANK = f"length(translate(coalesce({{}}, ''), {X.literal(T.SPACES)}, '')) = 0"
_KEY = "CASE WHEN trim(coalesce(source, '')) <> '' AND source <> 'inline' THEN 'src:' || source ELSE 'sha:' || sha256(content) END"
_DOCS_IN = "SELECT doc_id AS import_seq, 'document ' || doc_id AS title, 'inline' AS source, text AS content FROM documents"


def imports(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("import_seq"), F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("title"), F.lit("inline").alias("source"), F.col("text").alias("content"))


@query(f"SELECT import_seq, CASE WHEN {_BLANK.format('title')} THEN 'blank title' WHEN {_BLANK.format('content')} THEN 'blank content' END AS problem FROM {X.DOCUMENTS.sql()}")
def validate_documents(spark, sf_dir):
    return ingest.document_problems(X.DOCUMENTS.frame(spark)).select("import_seq", "problem")


@query("SELECT doc_id, sha256(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS fingerprint FROM documents")
def content_fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", evaluate.fingerprint(F.col("text")).alias("fingerprint"))


@query(f"SELECT import_seq, title, {_KEY} AS dedup_key, sha256(content) AS content_hash FROM ({_DOCS_IN}) QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY import_seq DESC) = 1")
def dedup_replace(spark, sf_dir):
    return ingest.latest(imports(spark, sf_dir)).select("import_seq", "title", "dedup_key", "content_hash")


@query(f"SELECT import_seq, title, {_KEY} AS dedup_key FROM {X.DOCUMENTS.sql()} QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY import_seq DESC) = 1")
def dedup_sources(spark, sf_dir):
    return ingest.latest(X.DOCUMENTS.frame(spark)).select("import_seq", "title", "dedup_key")


@query(f"SELECT row_number() OVER (ORDER BY import_seq, dedup_key) + 1000 AS id, import_seq FROM (SELECT import_seq, {_KEY} AS dedup_key FROM ({_DOCS_IN}) QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY import_seq DESC) = 1)")
def assign_ids(spark, sf_dir):
    return ingest.with_ids(ingest.latest(imports(spark, sf_dir)), 1000).select("id", "import_seq")


@query(f"SELECT id, CASE WHEN coalesce(dedup_key, '') = '' THEN 'legacy:' || id ELSE dedup_key END AS dedup_key FROM {X.KEYS.sql()}")
def dedup_migration(spark, sf_dir):
    return ingest.migrate_keys(X.KEYS.frame(spark))


@query(f"SELECT m.id, CASE WHEN s.source <> '' THEN s.source ELSE m.source END AS source, (s.source <> '' AND m.source IS DISTINCT FROM s.source) IS TRUE AS changed FROM {X.METADATA.sql()} m LEFT JOIN {X.SOURCES.sql()} s ON m.document_id = s.id")
def backfill_source(spark, sf_dir):
    chunks = X.METADATA.frame(spark).withColumn("metadata", F.when(F.col("source").isNotNull(), F.create_map(F.lit("source"), F.col("source")))).drop("source")
    out = ingest.backfill_source(chunks, X.SOURCES.frame(spark))
    return out.select("id", F.try_element_at("metadata", F.lit("source")).alias("source"), "changed")


@query("""WITH t AS (SELECT DISTINCT sha256('hash' || chr(0) || '8' || chr(0) || text) AS cache_key, text, doc_id % 3 = 0 AS cached FROM documents),
    c AS (SELECT DISTINCT cache_key FROM t WHERE cached) SELECT DISTINCT cache_key FROM t WHERE cache_key NOT IN (SELECT cache_key FROM c)""")
def embed_cache_misses(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    cache = docs.where("doc_id % 3 = 0").select(embed.cache_key("hash", 8, F.col("text")).alias("cache_key"), F.array_repeat(F.lit(0.5), 8).cast("array<float>").alias("embedding")).dropDuplicates(["cache_key"])
    return embed.split_by_cache(docs, cache, "hash", 8)[1].select("cache_key")


@query("SELECT count(*) AS chunks, count(*) FILTER (doc_id % 2 = 0) AS embedded, sum(octet_length(encode(lang || chr(10) || text)))::BIGINT AS text_bytes, count(*) FILTER (doc_id % 2 = 0) * 32 AS vector_bytes FROM documents")
def index_stats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    vectors_ = F.when(F.col("doc_id") % 2 == 0, F.array_repeat(F.lit(0.5), 8).cast("array<float>"))
    return ingest.index_stats(docs.select(F.col("lang").alias("heading"), F.col("text").alias("content"), vectors_.alias("embedding")), 8)


@query(f"SELECT id, CASE WHEN source IS NOT NULL THEN '{{\"source\":\"' || source || '\"}}' END AS metadata_json, CASE WHEN source IS NULL THEN 0 ELSE 1 END AS entries FROM {X.METADATA.sql()}")
def metadata_codec(spark, sf_dir):
    m = F.when(F.col("source").isNotNull(), F.create_map(F.lit("source"), F.col("source"))).otherwise(F.create_map().cast("map<string,string>"))
    coded = X.METADATA.frame(spark).select("id", ingest.metadata_json(m).alias("metadata_json"))
    return coded.withColumn("entries", F.size(ingest.metadata_map(F.col("metadata_json"))))


# ---------------------------------------------------------------- chunks

_SPACE_CLASS = "[" + T.SPACES + "]"
_SECTIONS = f"""WITH l AS (SELECT id, content, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM {X.MARKDOWN.sql()}),
    o AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start, regexp_extract(line, '^(#{{1,6}})([ \\t]|$)', 1) AS mark FROM l),
    t AS (SELECT *, CASE WHEN mark <> '' THEN regexp_replace(substring(line, length(mark) + 1), '^{_SPACE_CLASS}+|{_SPACE_CLASS}+$', '', 'g') END AS title FROM o),
    v AS (SELECT *, CASE WHEN title <> '' THEN length(mark) END AS level FROM t),
    h AS (SELECT *, count(level) OVER w AS section, {", ".join(f"max(CASE WHEN level = {k} THEN n END) OVER w AS at{k}, max_by(title, CASE WHEN level = {k} THEN n END) OVER w AS t{k}" for k in range(1, 7))} FROM v WINDOW w AS (PARTITION BY id ORDER BY n)),
    c AS (SELECT *, array_to_string(list_filter([{", ".join(f"CASE WHEN at{k} > greatest(-1, {', '.join(['-1'] + [f'coalesce(at{j}, -1)' for j in range(1, k)])}) THEN t{k} END" for k in range(1, 7))}], lambda x: x IS NOT NULL), ' > ') AS heading FROM h WHERE level IS NULL)
    SELECT id, section, heading, start_offset, least(last, total)::BIGINT AS end_offset FROM (SELECT id, section, heading, min(start) AS start_offset, max(start + length(line) + 1) AS last, any_value(length(content)) AS total FROM c GROUP BY id, section, heading) WHERE start_offset < least(last, total)"""


@query(_SECTIONS)
def md_sections(spark, sf_dir):
    s = chunking.sections_of(X.MARKDOWN.frame(spark))
    return s.select("id", "section", "heading", F.col("start_offset").cast("bigint").alias("start_offset"), F.col("end_offset").cast("bigint").alias("end_offset"))


@query(f"SELECT DISTINCT id, heading FROM ({_SECTIONS}) WHERE heading <> ''")
def md_breadcrumbs(spark, sf_dir):
    """From the chunker itself; a section of blanks alone has no chunk and so no breadcrumb here."""
    return chunking.chunk_documents(X.MARKDOWN.frame(spark)).where("heading <> ''").select(F.col("document_id").alias("id"), "heading").distinct()


@query()
def chunk_documents(spark, sf_dir):
    return chunking.chunk_documents(documents(spark, sf_dir).select((F.col("key") + 1).alias("id"), F.col("text").alias("content")))


@query("SELECT 0::BIGINT AS not_slices, 0::BIGINT AS too_long, 0::BIGINT AS empty, 0::BIGINT AS gaps, 0::BIGINT AS not_ahead, 0::BIGINT AS without_chunks")
def chunk_invariants(spark, sf_dir):
    docs = documents(spark, sf_dir).select((F.col("key") + 1).alias("id"), F.col("text").alias("content"))
    options = chunking.ChunkOptions(200, 50)
    return chunking.violations(docs, chunking.chunk_documents(docs, options), options)


# ---------------------------------------------------------------- evaluation

_PARTS = "(length(text) - length(replace(text, quote, ''))) // greatest(length(quote), 1)"
_LOCATED = f"""SELECT id, problem, CASE WHEN problem IS NULL THEN list_sum(list_transform(string_split(text, quote)[1:o], lambda p: length(p)))::BIGINT + (o - 1) * length(quote) END AS start_offset FROM (
    SELECT *, CASE WHEN coalesce(occurrence, 0) <= 0 THEN 1 ELSE occurrence END AS o, CASE WHEN quote = '' THEN 'empty' WHEN {_PARTS} = 0 OR occurrence > {_PARTS} THEN 'not found' WHEN coalesce(occurrence, 0) <= 0 AND {_PARTS} > 1 THEN 'ambiguous' END AS problem FROM {X.QUOTES.sql()})"""


@query(_LOCATED)
def locate_quote(spark, sf_dir):
    return evaluate.located(X.QUOTES.frame(spark)).select("id", "problem", F.col("start_offset").cast("bigint").alias("start_offset"))


_R, _E, _Q = X.RESULTS.sql(), X.EXPECTS.sql(), X.QUERIES.sql()
_COVER = f"SELECT r.channel, r.query_id, e.expect_id, e.grade, r.rank FROM {_R} r JOIN {_E} e ON r.query_id = e.query_id AND e.source <> '' AND r.source = e.source AND greatest(r.start_offset, e.start_offset) < least(r.end_offset, e.end_offset)"
_SCORES = f"""cover AS ({_COVER}), first_ AS (SELECT channel, query_id, expect_id, grade, min(rank) AS rank FROM cover GROUP BY ALL),
    by_rank AS (SELECT channel, query_id, rank, count(*) AS met, pow(2, max(grade)) - 1 AS gain FROM first_ GROUP BY ALL),
    got AS (SELECT channel, query_id, sum(met) AS met, min(rank) AS best, sum(CASE WHEN rank <= 10 THEN gain / log2(rank + 1) ELSE 0 END) AS dcg FROM by_rank GROUP BY ALL),
    ideal AS (SELECT query_id, count(*) AS expected, sum(CASE WHEN r <= 10 THEN (pow(2, grade) - 1) / log2(r + 1) ELSE 0 END) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, expect_id) AS r FROM {_E}) GROUP BY 1),
    scores AS (SELECT channel, q.query_id, q.grp AS "group", coalesce(met / expected, 0)::DOUBLE AS recall, coalesce(1.0::DOUBLE / best, 0) AS rr, coalesce(dcg / nullif(idcg, 0), 0)::DOUBLE AS ndcg
        FROM {_Q} q CROSS JOIN (SELECT DISTINCT channel FROM {_R}) LEFT JOIN ideal USING (query_id) LEFT JOIN got USING (channel, query_id))"""


def judged(spark) -> tuple[DataFrame, DataFrame, DataFrame]:
    return X.RESULTS.frame(spark), X.EXPECTS.frame(spark), X.QUERIES.frame(spark).withColumnRenamed("grp", "group")


@query(_COVER)
def span_cover(spark, sf_dir):
    r, e, _ = judged(spark)
    return evaluate.covering(r, e)


@query(f'WITH {_SCORES} SELECT channel, query_id, "group", round(recall, 6) AS recall, round(rr, 6) AS rr, round(ndcg, 6) AS ndcg FROM scores')
def score_queries(spark, sf_dir):
    return rounded(evaluate.scores(*judged(spark)), "recall", "rr", "ndcg")


@query(f'WITH {_SCORES} SELECT channel, "group", count(*) AS n_queries, round(avg(recall), 6) AS recall, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg FROM scores GROUP BY GROUPING SETS ((channel, "group"), (channel))')
def metrics_by_group(spark, sf_dir):
    return rounded(evaluate.metrics(evaluate.scores(*judged(spark))), "recall", "mrr", "ndcg")


@query(f"""WITH cover AS ({_COVER}), f AS (SELECT CASE WHEN q.grp = 'norel' THEN 'norel' WHEN EXISTS (SELECT 1 FROM cover c WHERE c.channel = r.channel AND c.query_id = r.query_id AND c.rank = r.rank) THEN 'rel' ELSE 'irr' END AS kind, score, coalesce(vector_score, 0) AS cos FROM {_R} r JOIN {_Q} q USING (query_id) WHERE channel = 'fused'),
    t AS (SELECT 'rrf' AS score_kind, kind, score AS value FROM f UNION ALL SELECT 'cos', kind, cos FROM f)
    SELECT score_kind, kind, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.9) AS p90, min(value) AS low, max(value) AS high FROM t GROUP BY ALL""")
def score_bands(spark, sf_dir):
    return evaluate.score_bands(*judged(spark))


@query(f"SELECT channel, sum(n) / 5 AS distinct_docs FROM (SELECT channel, query_id, count(DISTINCT source) AS n FROM {_R} GROUP BY ALL) GROUP BY channel")
def distinct_docs_at_k(spark, sf_dir):
    r, _, q = judged(spark)
    return evaluate.distinct_sources(r, q)


@query(f"""WITH more AS (SELECT channel, query_id, rank, source, start_offset, end_offset FROM {_R} WHERE channel = 'fused' UNION ALL SELECT channel, query_id, rank + 100, source, end_offset, end_offset + 60 FROM {_R} WHERE channel = 'fused'),
    met AS (SELECT DISTINCT e.query_id, e.expect_id FROM more r JOIN {_E} e ON r.query_id = e.query_id AND r.source = e.source AND greatest(r.start_offset, e.start_offset) < least(r.end_offset, e.end_offset)),
    n AS (SELECT query_id, count(*) AS expected, count(m.expect_id) AS met FROM {_E} e LEFT JOIN met m USING (query_id, expect_id) GROUP BY 1) SELECT q.query_id, round(coalesce(met / expected, 0), 6) AS recall FROM {_Q} q LEFT JOIN n USING (query_id)""")
def expanded_recall(spark, sf_dir):
    """Recall of the fused results and what follows each of them, 60 characters on."""
    r, e, q = judged(spark)
    fused = r.where("channel = 'fused'")
    after = fused.withColumn("rank", F.col("rank") + 100).withColumn("start_offset", F.col("end_offset")).withColumn("end_offset", F.col("end_offset") + 60)
    return rounded(evaluate.scores(fused.union(after), e, q).select("query_id", "recall"), "recall")


@query(f"WITH cover AS ({_COVER}) SELECT query_id, expect_id FROM {_E} e WHERE NOT EXISTS (SELECT 1 FROM cover c WHERE c.channel = 'fused' AND c.query_id = e.query_id AND c.expect_id = e.expect_id)")
def missed_expects(spark, sf_dir):
    r, e, _ = judged(spark)
    return evaluate.missed(r, e).select("query_id", "expect_id")


@query(f"WITH cover AS ({_COVER}) SELECT channel, query_id, rank, EXISTS (SELECT 1 FROM cover c WHERE c.channel = r.channel AND c.query_id = r.query_id AND c.rank = r.rank) AS relevant FROM {_R} r")
def query_detail(spark, sf_dir):
    r, e, _ = judged(spark)
    return evaluate.detail(r, e).select("channel", "query_id", "rank", "relevant")


@query(f"""WITH {_SCORES}, m AS (SELECT "group", channel, avg(recall) AS recall FROM scores GROUP BY GROUPING SETS ((channel, "group"), (channel))),
    w AS (SELECT "group", max(recall) FILTER (channel = 'fused') AS f, max(recall) FILTER (channel = 'lexical') AS l, max(recall) FILTER (channel = 'vector') AS v FROM m GROUP BY 1)
    SELECT "group", round(f, 6) AS fused, round(greatest(l, v), 6) AS best_single, CASE WHEN v > l THEN 'vector' ELSE 'lexical' END AS better, round(f - greatest(l, v), 6) AS gain FROM w""")
def gain_table(spark, sf_dir):
    return rounded(evaluate.gains(evaluate.metrics(evaluate.scores(*judged(spark)))), "fused", "best_single", "gain")


@query(f"WITH {_SCORES}, w AS (SELECT s.query_id, max(recall) FILTER (channel = 'lexical') AS l, max(recall) FILTER (channel = 'vector') AS v FROM scores s JOIN {_Q} q USING (query_id) WHERE q.require_lexical GROUP BY 1) SELECT count(*) AS total, count(*) FILTER (l >= 1) AS lexical_found, count(*) FILTER (l < 1 AND v >= 1) AS vector_only FROM w")
def lexical_required(spark, sf_dir):
    r, e, q = judged(spark)
    return evaluate.lexical_required(evaluate.scores(r, e, q), q)


@query(f"SELECT b.metric, b.value AS base, c.value AS current, CASE WHEN c.value IS NULL OR b.value - c.value > 0.05 THEN 'fail' ELSE 'pass' END AS status FROM {X.GATE_BASE.sql()} b LEFT JOIN {X.GATE_NOW.sql()} c USING (metric)")
def gate_check(spark, sf_dir):
    return evaluate.gate(X.GATE_BASE.frame(spark), X.GATE_NOW.frame(spark))


@query(f"""WITH q AS (SELECT *, count(*) OVER (PARTITION BY query_id) AS ids, count(*) OVER (PARTITION BY lower(trim(query))) AS texts FROM {X.BAD_QUERIES.sql()})
    SELECT query_id, unnest(list_filter([CASE WHEN ids > 1 THEN 'repeated id' END, CASE WHEN texts > 1 THEN 'repeated query' END, CASE WHEN kind NOT IN ('direct', 'indirect', 'multi-hop') THEN 'unknown kind' END, CASE WHEN grp <> 'norel' AND n_expects = 0 THEN 'no expectation' END, CASE WHEN grp = 'norel' AND n_expects > 0 THEN 'unexpected expectation' END], lambda x: x IS NOT NULL)) AS problem FROM q""")
def dup_query_problems(spark, sf_dir):
    return evaluate.query_problems(X.BAD_QUERIES.frame(spark).withColumnRenamed("grp", "group"))


@query(f"""WITH f AS (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM {X.FILES.sql()})
    SELECT source, unnest(list_filter([CASE WHEN trim(coalesce(source, '')) = '' THEN 'blank source' END, CASE WHEN trim(coalesce(path, '')) = '' THEN 'blank path' END, CASE WHEN NOT regexp_full_match(coalesce(sha256, ''), '[0-9a-fA-F]{{64}}') THEN 'bad hash' END, CASE WHEN n > 1 THEN 'repeated source' END], lambda x: x IS NOT NULL)) AS problem FROM f""")
def manifest_problems(spark, sf_dir):
    return evaluate.manifest_problems(X.FILES.frame(spark))


@query(f"SELECT f.source, f.chunks_at_default AS recorded, coalesce(c.n, 0) AS actual FROM {X.FILES.sql()} f LEFT JOIN (SELECT source, count(*) AS n FROM {X.CHUNK_COUNTS.sql()} GROUP BY 1) c USING (source) WHERE f.chunks_at_default > 0 AND f.chunks_at_default <> coalesce(c.n, 0)")
def corpus_state(spark, sf_dir):
    return evaluate.drift(X.FILES.frame(spark), X.CHUNK_COUNTS.frame(spark))


@query(f"""WITH e AS (SELECT query_id, arg_min(struct_pack(s := start_offset, e := end_offset), expect_id) AS x FROM {_E} GROUP BY 1),
    c AS (SELECT unnest(range(0, 400, 50)) AS a), t AS (SELECT a, a + 60 AS b, {sql_tokens("'alpha ' || a || CASE WHEN a % 100 = 0 THEN ' beta' ELSE ' gamma delta' END")} AS tokens FROM c),
    n AS (SELECT e.query_id, unnest(list_intersect({sql_tokens('query')}, tokens)) AS token FROM e JOIN {_Q} q USING (query_id) JOIN t ON greatest(x.s, a) < least(x.e, b))
    SELECT e.query_id, coalesce(string_agg(DISTINCT token, ' ' ORDER BY token), '') AS shared FROM e LEFT JOIN n USING (query_id) GROUP BY 1""")
def shared_tokens(spark, sf_dir):
    _, e, q = judged(spark)
    c = spark.range(0, 400, 50).select(F.col("id").cast("int").alias("start_offset"), (F.col("id") + 60).cast("int").alias("end_offset"))
    text = F.concat(F.lit("alpha "), F.col("start_offset").cast("string"), F.when(F.col("start_offset") % 100 == 0, " beta").otherwise(" gamma delta"))
    c = c.withColumn("tokens", T.tokenize(text)).crossJoin(spark.createDataFrame([("a.md",), ("b.md",), ("c.md",)], "source string"))
    found = evaluate.shared_tokens(q.select("query_id", T.tokenize(F.col("query")).alias("tokens")), e, c)
    return found.select("query_id", F.array_join("shared", " ").alias("shared"))


@query("SELECT event_type, count(*) AS n, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, max(value) AS most FROM events GROUP BY event_type")
def latency_percentiles(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), *evaluate.quantiles("value", {"p50": 0.5, "p95": 0.95}), F.max("value").alias("most"))


# ---------------------------------------------------------------- workloads

_WORDS_32 = [a + b for a in ("ka", "lo", "mi", "ru", "te", "vo", "sa", "ne") for b in ("da", "fin", "gor", "mel")]
_PICK = "((i * 2654435761 + w * 40503) % 4294967296 // 65536) % 32"


@query(f"""WITH t AS (SELECT i AS doc, string_agg(([{", ".join(X.literal(w) for w in _WORDS_32)}])[1 + {_PICK}] || CASE WHEN w % 12 = 11 THEN '。' ELSE ' ' END, '' ORDER BY w) AS content FROM range(50) a(i), range(240) b(w) GROUP BY i)
    SELECT doc, content, substring(content, 1, 24) AS query FROM t""")
def synthetic_corpus(spark, sf_dir):
    """Documents of 240 words from a vocabulary of 32, a sentence end every twelve, and the query picked from each."""
    words = F.array(*map(F.lit, _WORDS_32))
    pick = lambda w: (F.floor(F.pmod(F.col("doc") * 2654435761 + w * 40503, F.lit(4294967296)) / 65536) % 32).cast("int")
    text = F.transform(F.sequence(F.lit(0), F.lit(239)), lambda w: F.concat(F.get(words, pick(w)), F.when(w % 12 == 11, "。").otherwise(" ")))
    docs = spark.range(50).select(F.col("id").alias("doc")).withColumn("content", F.array_join(text, ""))
    return docs.withColumn("query", F.substring("content", 1, 24))
