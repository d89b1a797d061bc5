"""Cases of single operators and of the engine as a whole."""

import pytest
from pyspark.sql import Window as W, functions as F

from gleanspark.functions import text as T
from gleanspark.operators import chunking, embed, evaluate, fusion, ingest, lexical, vector
from gleanspark.plans import evaluation, report
from gleanspark.plans.engine import Engine, Options, SearchError
from gleanspark.sources import documents, env
from gleanspark.sources.snapshots import NotFound, SnapshotStore


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


@pytest.mark.parametrize(
    ("text", "scheme", "expected"),
    [
        ("把 parquet 写成表", "bigram", "把 parquet 写成 成表"), ("雨", "both", "雨"), ("雨夹雪", "both", "雨 夹 雪 雨夹 夹雪"), ("雨夹雪", "unigram", "雨 夹 雪"),
        ("V2.75", "bigram", "v2 75"), ("ＸＹ", "odd", "xy"), ("", "bigram", ""), (None, "bigram", ""), ("km公里", "bigram", "km 公里"),
    ],
)
def test_tokens(spark, text, scheme, expected):
    df = spark.createDataFrame([(text,)], "t string").select(F.array_join(T.tokenize(F.col("t"), scheme), " "))
    assert df.first()[0] == expected


def test_bm25_ranks_and_ties(spark):
    chunks = spark.createDataFrame([(10, "same words"), (2, "same words"), (3, "other"), (4, "")], "key bigint, text string")
    q = spark.createDataFrame([(1, "same same")], "query_id bigint, query string")
    idx = lexical.index(chunks)
    assert values(lexical.search(idx, q).orderBy("rank"), "key", "rank") == [(10, 1), (2, 2)]  # equal scores: keys as text
    assert idx.lengths.count() == 4
    assert lexical.search(lexical.index(chunks.limit(0)), q).count() == 0


def test_bm25_looks_once_for_queries_of_the_same_tokens(spark):
    chunks = spark.createDataFrame([(i, f"same word {i % 3}") for i in range(30)], "key bigint, text string")
    q = spark.createDataFrame([(i, ["word same", "Same word word", "word 1", ""][i % 4]) for i in range(400)] + [(None, "word same")], "query_id bigint, query string")
    found = lexical.search(lexical.index(chunks), q, 5)
    out = found.groupBy("query_id").agg(F.collect_list(F.struct("rank", "key", "score")).alias("r")).collect()
    assert len(out) == 301
    want = {kind: sorted(lexical.search(lexical.index(chunks), spark.createDataFrame([(0, kind)], q.schema), 5).select("rank", "key", "score").collect()) for kind in ("word same", "word 1")}
    for x in out:
        assert [y[:2] for y in sorted(x.r)] == [y[:2] for y in want["word 1" if (x.query_id or 0) % 4 == 2 else "word same"]]
    # what is summed is summed for one query of each kind
    assert "Aggregate [lead" in found._jdf.queryExecution().optimizedPlan().toString()


def test_search_paths_have_no_python(spark):
    chunks = spark.createDataFrame([(1, "a b"), (2, "b c")], "key bigint, text string")
    q = spark.createDataFrame([(1, "b")], "query_id bigint, query string")
    e = embed.HashEmbedder(8)
    vectors = vector.index(e.embed(chunks).select("key", F.col("embedding").alias("vector")), 8)
    near = vector.search_sparse(e.buckets(chunks, "key"), e.buckets(q, "query_id", "query"), chunks, 1)
    assert values(near, "key", "rank") == values(vector.search(vectors, e.embed(q, "query").select("query_id", F.col("embedding").alias("vector")), 1), "key", "rank")
    plan = fusion.fuse(lexical.search(lexical.index(chunks), q, 1), near, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "WindowGroupLimit" in plan


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [-1.0, 0.0]), (4, [0.0, 0.0]), (5, None)]
    idx = vector.index(spark.createDataFrame(rows, "key bigint, vector array<float>"), 2)
    q = spark.createDataFrame([(9, [2.0, 0.0])], "query_id bigint, vector array<float>")
    assert values(vector.search(idx, q).orderBy("rank"), "key", "score") == [(1, 1.0), (2, 0.0), (3, -1.0)]
    assert values(vector.search(idx, spark.createDataFrame([(9, [0.0, 0.0])], q.schema), 2).orderBy("rank"), "key", "score") == [(1, 0.0), (2, 0.0)]
    assert vector.search(idx, q.limit(0)).count() == 0 and vector.search(idx.limit(0), q).count() == 0
    with pytest.raises(Exception, match="dimension"):
        vector.search(idx, spark.createDataFrame([(9, [1.0])], q.schema)).collect()
    with pytest.raises(Exception, match="components"):
        vector.index(spark.createDataFrame([(1, [1.0])], "key bigint, vector array<float>"), 2).collect()


def test_hash_embedder_and_remote_retries(spark):
    df = spark.createDataFrame([("b a b",), ("?!",)], "text string")
    got = [list(r.embedding) for r in embed.HashEmbedder(4).embed(df).collect()]
    assert got[1] == [1, 0, 0, 0] and abs(sum(x * x for x in got[0]) - 1) < 1e-6
    named = spark.createDataFrame([(1, "b a b"), (2, "?!")], "key bigint, text string")
    assert [pytest.approx(list(r.vector)) for r in embed.HashEmbedder(4).vectors(named, "key").orderBy("key").collect()] == got
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise OSError("busy")
        return [[1.0, 2.0]] * len(texts)

    remote = embed.RemoteEmbedder(flaky, "m", 2, pause=0.0)
    assert remote.vectors(["a", "b"]) == [[1.0, 2.0]] * 2 and calls == [2, 2]
    with pytest.raises(embed.Fatal):
        embed.RemoteEmbedder(lambda t: (_ for _ in ()).throw(embed.Fatal("no")), "m", 2).vectors(["a"])


def test_cache_embeds_each_miss_once(spark):
    texts = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "id bigint, text string")
    e = embed.HashEmbedder(4)
    empty = spark.createDataFrame([], "cache_key string, embedding array<float>")
    full, cache = embed.embed_cached(e, texts, empty)
    assert full.where("embedding is not null").count() == 3 and cache.count() == 2
    assert embed.split_by_cache(texts, cache, e.model, e.dim)[1].count() == 0


@pytest.mark.parametrize(
    ("text", "size", "overlap"),
    [("一句话。" * 60, 50, 10), ("x" * 200, 50, 10), ("a", 50, 10), ("# T\n" + "line of text\n" * 100, 90, 25), ("intro\n```\n" + "code line\n" * 30 + "```\n" + "y" * 300, 100, 20), ("word " * 300, 40, 0)],
)
def test_chunks_cover_and_advance(text, size, overlap):
    chunks = chunking.split(text, chunking.ChunkOptions(size, overlap))
    assert [c[0] for c in chunks] == list(range(len(chunks)))
    assert all(0 < b - a <= size for _, a, b, _ in chunks)
    assert all(x[1] < y[1] for x, y in zip(chunks, chunks[1:]))
    covered = {i for _, a, b, _ in chunks for i in range(a, b)}
    body = [i for s, e, _ in chunking.sections(text) for i in range(s, e) if text[i] not in T.SPACES]
    assert set(body) <= covered
    assert len(chunks) <= len(text) / (size - overlap) + 8


def test_chunks_respect_regions_and_headings():
    fence = "short intro.\n```\na = 1\nb = 2\nc = 3\n```\nend"
    assert any("```\na = 1\nb = 2\nc = 3\n```" in fence[a:b] for _, a, b, _ in chunking.split(fence, chunking.ChunkOptions(60, 10)))
    nested = "# A\n## B\none\n# C\ntwo\n#tag three"
    assert [c[3] for c in chunking.split(nested)] == ["A > B", "C"]
    assert len(chunking.split("```\n# splits all the same\n```")) == 2
    table = "| a |\n| b |\n| c |\n"
    assert chunking.protected(table, 0, len(table)) == [(0, len(table))] and not chunking.protected("| a |\n| b |\n", 0, 12)
    assert chunking.split("# only\n## headings") == [] and chunking.split("　 ") == []
    with pytest.raises(ValueError):
        chunking.ChunkOptions(10, 10).normal()


def test_located_quotes(spark):
    df = spark.createDataFrame([("aaaa", "aa", 2), ("one one", "one", None), ("x", "y", 1), ("x", "", 1)], "text string, quote string, occurrence int")
    assert values(evaluate.located(df), "start_offset", "problem") == [(2, None), (None, "ambiguous"), (None, "not found"), (None, "empty")]


def test_gains_of_one_result_over_two_grades(spark):
    e = spark.createDataFrame([("q", 0, "a", 0, 10, 2), ("q", 1, "a", 5, 15, 1)], "query_id string, expect_id int, source string, start_offset int, end_offset int, grade int")
    r = spark.createDataFrame([("fused", "q", 1, "a", 0, 20)], "channel string, query_id string, rank int, source string, start_offset int, end_offset int")
    q = spark.createDataFrame([("q", "en")], "query_id string, group string")
    row = evaluate.scores(r, e, q).first()
    assert (row.recall, row.rr, round(row.ndcg, 6)) == (1.0, 1.0, round(3 / (3 + 1 / 1.5849625007211562), 6))


def test_import_search_replace_delete(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    engine = Engine(store, embed.HashEmbedder(32), Options(chunks=chunking.ChunkOptions(40, 5)))
    queries = spark.createDataFrame([("1", "vector search")], "query_id string, query string")
    assert engine.search(queries).degraded == "the index is empty"
    docs = documents.inline(spark, [{"content": "# Search\nAbout vector search and words.", "source": "a.md"}, {"content": "Cooking with pots.\nNothing else here at all, really."}])
    assert values(docs.orderBy("import_seq"), "title", "source") == [("Search", "a.md"), ("Cooking with pots.", "inline")]
    summary = engine.import_documents(docs)
    assert summary.where("chunk_count > 0 and embedded_count = chunk_count").count() == 2
    found = engine.search(queries)
    assert found.degraded is None and found.results.orderBy("rank").first().source == "a.md"
    assert "embedding" not in found.results.columns
    engine.import_documents(documents.inline(spark, [{"content": "# Search\nChanged text about vector search.", "source": "a.md"}]))
    assert store.documents().count() == 2 and store.version() == 2
    assert engine.context(engine.search(queries).results).count() >= 0
    gone = store.documents().where("source = 'a.md'").first().id
    store.delete(gone)
    assert store.documents().count() == 1 and store.chunks().where(F.col("document_id") == gone).count() == 0
    with pytest.raises(NotFound):
        store.delete(gone)
    with pytest.raises(ValueError):
        engine.search(spark.createDataFrame([("1", "  ")], queries.schema))
    assert engine.stats().first().chunks > 0
    assert store.versions() == [1, 2, 3] and store.expire(1) == [1, 2] and store.versions() == [3]
    with pytest.raises(ValueError):
        store.save(store.documents(), store.chunks(), store.vectors())
    for blank in ("\t", "\u3000", None):
        with pytest.raises(ValueError):
            engine.search(spark.createDataFrame([("1", blank)], queries.schema))


def test_numbers_of_many_rows(spark):
    from gleanspark.operators.numbering import numbered

    rows = spark.range(1_000_000).select((F.col("id") * 7919 % 1_000_003).alias("place"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
    out = numbered(rows.repartition(7), ["place"], "n")
    count, low, high, n = out.agg(F.count(F.lit(1)), F.min("n"), F.max("n"), F.count_distinct("n")).first()
    assert (count, low, high, n) == (1_000_000, 0, 999_999, 1_000_000)
    w = W.partitionBy(F.floor(F.col("n") / 50_000)).orderBy("n")
    assert out.withColumn("before", F.lag("place").over(w)).where("place <= before").count() == 0


def test_indexes_are_written_once_and_read(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    Engine(store).import_documents(documents.inline(spark, [{"content": "some words"}, {"content": "# only a heading", "title": "empty"}]))
    engine = Engine(store)
    read = engine._words(spark.createDataFrame([("1", "words")], "query_id string, query string"), 5).inputFiles()
    assert read and all("/derived/postings-" in f for f in read)
    assert sorted(p.name for p in (tmp_path / "store").glob("data-1-*/derived/*")) == ["lengths-bigram-1.2-0.75", "postings-bigram-1.2-0.75", "vectors-0", "vocabulary-bigram-1.2-0.75"]
    assert store.documents().count() == 1


class Broken:
    model, dim = "broken", 4

    def __init__(self, ready=False, wait=0.0):
        self.ready, self.wait = ready, wait

    def embed(self, texts, text="text"):
        if self.ready:
            return embed.HashEmbedder(4).embed(texts, text)
        if self.wait:
            import time

            time.sleep(self.wait)
        raise OSError("no embedder")


def test_failures_leave_what_works(spark, tmp_path):
    q = spark.createDataFrame([("1", "words")], "query_id string, query string")
    broken = Broken()
    engine = Engine(SnapshotStore(spark, str(tmp_path / "a")), broken)
    summary = engine.import_documents(documents.inline(spark, [{"content": "some words"}, {"content": "## heading alone", "title": "t"}])).collect()
    assert {(r.chunk_count, r.embedded_count, r.warning) for r in summary} == {(1, 0, "embedding failed: OSError"), (0, 0, "there is no text to cut")}
    assert engine.search(q).degraded == "there are no vectors"
    broken.ready = True
    engine.import_documents(documents.inline(spark, [{"content": "other words"}]))
    assert engine.search(q).degraded is None
    broken.ready = False
    found = engine.search(q)
    assert found.degraded == "the vector channel failed: OSError" and found.results.count() == 2
    good, engine.lexical = engine.lexical, None
    broken.ready = True
    found = engine.search(q)
    assert found.degraded.startswith("the lexical channel failed") and found.results.where("vector_rank > 0").count() == 1
    broken.ready = False
    with pytest.raises(SearchError):
        engine.search(q)
    engine.lexical = good
    broken.wait = 60
    slow = Engine(engine.store, broken, Options(timeout=15))
    assert "not ready" in slow.search(q).degraded


def test_channels_can_merge_before_the_cut(spark, tmp_path):
    e = embed.HashEmbedder(16)
    engine = Engine(SnapshotStore(spark, str(tmp_path / "s")), e, Options(top_k=2, multiplier=3, merge=True, chunks=chunking.ChunkOptions(20, 0)))
    engine.import_documents(documents.inline(spark, [{"content": "alpha beta gamma one. alpha beta gamma two. alpha beta gamma three.", "source": "a"}, {"content": "alpha delta", "source": "b"}]))
    found = engine.channels(spark.createDataFrame([("1", "alpha")], "query_id string, query string"))
    assert found["fused"].where("merged > 1").count() == 1 and found["fused"].count() == 2 and found["lexical"].count() == 2


def test_evaluation_run(spark, tmp_path):
    files = spark.createDataFrame([("a.md", "a.md", "# One\nThe first passage is about birds.\n# Two\nThe second one is about stones."), ("b.md", "b.md", "Rivers run to the sea.")], "source string, path string, content string")
    files = files.withColumn("sha256", evaluate.fingerprint(F.col("content"))).withColumn("chunks_at_default", F.when(F.col("source") == "a.md", 2).otherwise(1))
    assert evaluation.check_corpus(files).count() == 0
    assert values(evaluation.check_corpus(files.withColumn("chunks_at_default", F.lit(7))).orderBy("source"), "problem") == [("chunks: 7 recorded, 2",), ("chunks: 7 recorded, 1",)]
    queries = spark.createDataFrame([("q1", "birds", "en", True), ("q2", "sea rivers", "en", False), ("q3", "volcano", "norel", False)], "query_id string, query string, group string, require_lexical boolean")
    expects = spark.createDataFrame([("q1", 0, "a.md", "about birds", None, 2), ("q2", 0, "b.md", "Rivers", None, 2)], "query_id string, expect_id int, source string, quote string, occurrence int, grade int")
    for merge in (False, True):
        got = evaluation.evaluation(str(tmp_path / f"s{merge}"), files, queries, expects, embed.HashEmbedder(64), evaluation.EvalOptions(merge=merge))
        means = dict(values(got.overall(), "metric", "value"))
        assert means["lexical_recall"] == means["fused_recall"] == pytest.approx(2 / 3) and set(means) == {f"{c}_{m}" for c, m in evaluate.GATED}
        assert got.missed.count() == 0 and got.required.first().lexical_found == 1
        assert {r.query_id: r.recall for r in got.expanded.collect()} == {"q1": 1.0, "q2": 1.0, "q3": 0.0}
        assert "fused" in got.text() and '"metrics"' in got.json()
        assert evaluate.gate(got.overall(), got.overall()).where("status = 'fail'").count() == 0
    with pytest.raises(evaluation.Degraded):
        evaluation.evaluation(str(tmp_path / "broken"), files, queries, expects, Broken())
    with pytest.raises(ValueError, match="placed"):
        evaluation.evaluation(str(tmp_path / "lost"), files, queries, expects.withColumn("quote", F.lit("absent")), embed.HashEmbedder(64))
    stamped = evaluate.stamped(files.withColumn("sha256", F.when(F.col("source") == "a.md", "old").otherwise(F.col("sha256"))), spark.createDataFrame([("a.md",), ("a.md",), ("b.md",)], "source string"))
    assert values(stamped.orderBy("source"), "source", "changed", "chunks_at_default") == [("a.md", True, 2), ("b.md", False, 1)]
    assert evaluation.candidates(100, 10) == 100 and evaluation.candidates(5, 10) == 10


def test_reports_and_settings(tmp_path):
    assert report.display_width("表a") == 3 and report.display_width("e\u0301") == 1
    assert report.table([{"name": "表", "n": 1.5}, {"name": "abc", "n": 2.0}]) == "name      n\n----  -----\n表    1.500\nabc   2.000"
    assert report.as_json({"a": "表<"}) == '{\n  "a": "表<"\n}'
    assert env.parse_env("# no\nexport A=1\nB = 'x y'\n\nC=\"q\"\nD=a=b # c") == {"A": "1", "B": "x y", "C": "q", "D": "a=b # c"}
    with pytest.raises(ValueError, match="line 2"):
        env.parse_env("A=1\nnonsense")
    (tmp_path / ".env").write_text("A=1\nB=2")
    own = {"A": "0"}
    assert env.load_env(str(tmp_path / ".env"), own) == {"B": "2"} and own == {"A": "0", "B": "2"} and env.load_env(str(tmp_path / "none"), own) == {}


def test_regions_behind_wide_spaces():
    fence = "\u3000```\nsome code. more code. even more code.\n\u3000```"
    assert chunking.protected(fence, 0, len(fence)) == [(0, len(fence))]
    rows = "\u3000| a |\n\u2003| b |\n\xa0| c |"
    assert chunking.protected(rows, 0, len(rows)) == [(0, len(rows))]


def test_corpus_by_whole_paths(spark, tmp_path):
    import json

    for folder, text in (("a", "first"), ("b", "second")):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "文档 r+1%.md").write_text(text)
    found = documents.files(spark, str(tmp_path / "a")).first()
    assert found.title == "文档 r+1%" and found.source.endswith("/a/文档 r+1%.md")
    entries = [{"source": f, "path": f"{f}/文档 r+1%.md", "sha256": "0" * 64} for f in ("a", "b")]
    (tmp_path / "manifest.json").write_text(json.dumps({"files": entries}))
    got = documents.corpus(spark, str(tmp_path / "manifest.json"))
    assert values(got.orderBy("source"), "source", "content") == [("a", "first"), ("b", "second")]


def test_lexical_only_without_embedder(spark, tmp_path):
    engine = Engine(SnapshotStore(spark, str(tmp_path / "s")))
    engine.import_documents(documents.inline(spark, [{"content": "some words"}]))
    found = engine.search(spark.createDataFrame([("1", "words")], "query_id string, query string"))
    assert found.degraded and found.results.first().vector_rank == 0


def test_files(spark, tmp_path):
    (tmp_path / "Note.MD").write_text("text of a note")
    assert values(documents.files(spark, str(tmp_path)), "title", "content") == [("Note", "text of a note")]
    (tmp_path / "x.pdf").write_text("no")
    with pytest.raises(Exception, match="can't import"):
        documents.files(spark, str(tmp_path)).collect()


def test_strict_json():
    assert documents.strict_json('{"version": 1, "queries": []}', documents.QUERY_SET)["version"] == 1
    for bad in ('{"other": 1}', '{"version": 1} {}', '{"version": ', '{"queries": [{"id": "a", "x": 1}]}'):
        with pytest.raises(documents.JsonError):
            documents.strict_json(bad, documents.QUERY_SET)


def test_stream_of_documents(spark, tmp_path):
    from gleanspark.streaming.imports import import_stream

    documents.inline(spark, [{"content": "first streamed text"}]).write.parquet(str(tmp_path / "in"))
    engine = Engine(SnapshotStore(spark, str(tmp_path / "store")))
    stream = spark.readStream.schema(documents.DOCUMENT).parquet(str(tmp_path / "in"))
    import_stream(engine, stream, str(tmp_path / "checkpoint")).awaitTermination(120)
    assert engine.store.documents().count() == 1


def test_ids_and_migration(spark):
    docs = spark.createDataFrame([(5, "k5"), (1, "k1"), (3, "k3")], "import_seq bigint, dedup_key string")
    assert values(ingest.with_ids(docs, 10).orderBy("id"), "id", "import_seq") == [(11, 1), (12, 3), (13, 5)]
    with pytest.raises(Exception, match="two documents"):
        ingest.migrate_keys(spark.createDataFrame([(1, "a"), (2, "a")], "id bigint, dedup_key string")).collect()
