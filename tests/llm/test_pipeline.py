"""The pipeline of all stages on a small corpus."""

import random

import pytest

import corpus_pipeline
from gleanspark.llm import registry
from test_operators import prose

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, score double"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("sf")
    r, rows, labels = random.Random(1), [], []
    passage = prose(120, 77)
    for i in range(300):
        words = prose(r.randrange(60, 200), i).split()
        toxic = i % 5 == 0
        for _ in range(5 * toxic):
            words.insert(r.randrange(len(words)), r.choice(["grumble", "grumbler", "grumbling"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, rows[1][1]), (1001, rows[2][1] + " one more word"), (1002, prose(50, 500) + " " + passage), (1003, prose(60, 501) + " " + passage), (1004, "password: verysecret1 " + prose(60, 502)), (1005, None), (1006, ""), (None, prose(60, 503))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 0.5) for i, t in rows], COLUMNS)
    df.write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path)


def test_stages(spark, folder, tmp_path):
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = seen[name] = spark.read.parquet(str(tmp_path / name))
        if name != "packing":
            assert docs.columns == before.columns
            assert docs.where("n_chars <> length(text)").count() == 0
    text = lambda name: {r.doc_id: r.text for r in seen[name].collect()}
    left = text("toxicity")
    toxic = [i for i in range(0, 300, 5)]
    assert sum(i in left for i in toxic) <= 3 and sum(i not in left for i in range(300) if i % 5) <= 3
    near = text("near_duplicates")
    assert 1000 not in near and 1001 not in near and 1 in near and 2 in near and 1005 in near and None in near
    cut = text("repeats")
    assert set(cut) == set(near) and len(cut[1002]) < 450 and len(cut[1003]) < 500 and cut[3] == near[3]
    assert "<assign>" in text("secrets")[1004]
    assert {r.doc_id for r in docs.collect()} == set(near)


def test_run_is_all_stages(spark, folder):
    assert corpus_pipeline.run(spark, folder).columns[:3] == ["doc_id", "start", "length"]
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 11))
