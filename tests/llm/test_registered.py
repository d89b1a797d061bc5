"""The registered queries on whole small tables: contract columns, extra columns with clashing names, empty tables, very long texts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gleanspark.llm import packing, pieces, registry, repeats, sharding
from test_operators import brute_links, brute_top, corpus, prose, toxic_corpus

CONTRACTS = {
    1: {"doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"}, 2: {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
    3: {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}, 4: {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"},
    5: {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"}, 6: {"doc_id", "n_shingles", "component_id"}, 7: {"page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"},
    8: {"query_id", "rank", "vec_id", "score"}, 9: {"doc_id", "held_out", "score", "predicted"}, 10: {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"},
}
NAMES = {int(n[2:].split("_")[0]): n for n in registry.QUERIES}
#: Besides the contract's columns, some that operators use for themselves.
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, _key string, key string, `_kept` int, class string, rank int"


def tables(spark, path, rows):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "x", 1, "c", 2) for i, t in rows], DOCS)
    df.repartition(3).write.parquet(f"{path}/documents.parquet")
    _, labels = toxic_corpus(200)
    spark.createDataFrame([(i, 1 - y, y, "z") for i, y in labels][: len(rows)], "doc_id bigint, quality int, toxic int, text string").write.parquet(f"{path}/labels.parquet")
    pages = [(i, None if i % 5 == 0 else f"http://{i}", t, "k") for i, t in rows if i is not None]
    spark.createDataFrame(pages, "page_id bigint, url string, html string, refers_to string").write.parquet(f"{path}/pages.parquet")
    r = random.Random(1)
    vectors = [(10 * n, [r.gauss(0, 1) for _ in range(4)] if n % 7 else None, n, "k") for n, _ in enumerate(rows)]
    spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>, label int, score string").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


ROWS = [(r[0], r[1]) for r in corpus()] + [(500, prose(200, 40) + " " + prose(60, 41)), (501, prose(70, 42) + " " + prose(60, 41))]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("sf"), ROWS)


@pytest.fixture(scope="module")
def nothing(spark, tmp_path_factory):
    return tables(spark, tmp_path_factory.mktemp("empty"), [])


@pytest.mark.parametrize("n", sorted(CONTRACTS))
def test_contract_columns_and_empty_tables(spark, folder, nothing, n):
    query = registry.QUERIES[NAMES[n]]
    out = query(spark, folder)
    assert CONTRACTS[n] <= set(out.columns)
    if n in (1, 2, 3, 4, 5, 6, 9):
        assert Counter(r[0] for r in out.select("doc_id").collect()) == Counter(i for i, _ in ROWS)
    else:
        assert out.count() > 0
    assert query(spark, nothing).count() == 0


def test_first_query_is_brute_force(spark, folder):
    data = [(i, (t or "").encode()) for i, t in ROWS]

    def covered(size):
        seen = Counter(b[i : i + size] for _, b in data for i in range(len(b) - size + 1))
        for _, b in data:
            out = np.zeros(len(b), bool)
            for a in range(len(b) - size + 1):
                if seen[b[a : a + size]] > 1:
                    out[a : a + size] = True
            yield out

    want = Counter()
    for (i, b), gone, known in zip(data, covered(400), covered(repeats.PASSAGE)):
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want[i, len(b), int(gone.sum()), int(np.diff(np.r_[0, gone.astype(int)]).clip(0).sum()), hashlib.sha256(kept).hexdigest(), int(known.sum())] += 1
    out = registry.QUERIES[NAMES[1]](spark, folder).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage_bytes")
    assert Counter(map(tuple, out.collect())) == want
    assert {i for (i, *_, known) in want if known} >= {500, 501} and all(not removed for i, _, removed, *_ in want if i in (500, 501))


def test_second_query_is_the_heaps(spark, folder):
    out = registry.QUERIES[NAMES[2]](spark, folder).collect()
    groups, loads = Counter(), [0] * 40
    for _, t in ROWS:
        groups[(t or "").encode()] += len((t or "").encode()) + sharding.OVERHEAD
    for size in sorted(groups.values(), reverse=True):
        loads[loads.index(min(loads))] += size
    got = Counter()
    for r in out:
        got[r.shard] += r.size
    assert sorted(got.values()) == sorted(x for x in loads if x)


def test_sixth_query_is_brute_force(spark, folder):
    out = registry.QUERIES[NAMES[6]](spark, folder).select("doc_id", "n_shingles", "component_id", "n_links")
    assert Counter(map(tuple, out.collect())) == Counter(brute_links(ROWS, 90, 3))


def test_eighth_query_is_brute_force(spark, folder):
    rows = [(r.vec_id, [np.floor(float(x) * 1024) for x in r.embedding]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").where("embedding is not null").collect()]
    want = brute_top(rows, [(n, r) for n, r in enumerate(rows) if r[0] % 100 == 0], 10)
    got = defaultdict(list)
    for r in registry.QUERIES[NAMES[8]](spark, folder).collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v[0]) for q, v in want.items()}


def test_tenth_query_covers_each_id_once(spark, folder):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.vocabulary())
    ids = {i: np.array([*own.encode(t or "", add_special_tokens=False).ids, packing.END], "<u4") for i, t in ROWS}
    pieces_, filled = defaultdict(list), Counter()
    for r in registry.QUERIES[NAMES[10]](spark, folder).collect():
        pieces_[r.doc_id].append((r.start, r.length))
        filled[r.sequence_id] += r.length
        if Counter(i for i, _ in ROWS)[r.doc_id] == 1:
            assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    assert max(filled.values()) <= 2048
    for i, n in Counter(i for i, _ in ROWS).items():
        if n == 1:
            assert sorted(x for a, b in pieces_[i] for x in range(a, a + b)) == list(range(len(ids[i])))


def test_very_long_texts(spark, tmp_path):
    """A text beyond all slabs and slices, twice, and once more with another end."""
    long = prose(90_000, 3)
    path = tables(spark, tmp_path, [(1, long), (2, long), (3, long[: len(long) // 2] + prose(40_000, 4))])
    n = len(long.encode())
    assert n > 2 * repeats.SLAB
    out = {r.doc_id: r for r in registry.QUERIES[NAMES[1]](spark, path).collect()}
    assert out[1].n_removed == out[2].n_removed == n and out[1].n_spans == 1
    half = len(long[: len(long) // 2].encode())
    assert half <= out[3].n_removed < half + 400 and out[3].n_spans == 1
    assert {r.doc_id: r.component_id for r in registry.QUERIES[NAMES[6]](spark, path).collect()} == {1: 1, 2: 1, 3: 3}
    model = pieces.merge_model(pieces.vocabulary())
    ids = ",".join(map(str, model.library.encode(long)))
    assert {r.ids_sha256 for r in registry.QUERIES[NAMES[4]](spark, path).where("doc_id < 3").collect()} == {hashlib.sha256(ids.encode()).hexdigest()}


def test_pipeline_of_clashing_names_and_of_nothing(spark, folder, nothing, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "packing" or docs.columns == before
    assert corpus_pipeline.run(spark, nothing).count() == 0


def test_a_narrow_row_key_is_not_used(spark):
    """Keys are 128 bits of id and text, so rows that differ don't meet by chance."""
    from gleanspark.llm.store import row_key

    df = spark.createDataFrame([(1, "a"), (11, ""), (None, "a"), (1, None), (1, "a")], "doc_id bigint, text string")
    keys = [bytes(r[0]) for r in df.select(row_key("doc_id", "text")).collect()]
    assert all(len(k) == 16 for k in keys) and len(set(keys)) == 4 and keys[0] == keys[4]
    assert df.select(F.length(row_key("doc_id", "text"))).distinct().count() == 1
