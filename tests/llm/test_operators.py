"""The corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import hashlib
import io
import json
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gleanspark.llm import jaccard, packing, pieces, quality, repeats, secrets, sharding, shingles, store, toxicity, vafile, warc

SCHEMA = "doc_id bigint, text string, lang string, key string, id int, n int, `class` string, score double"
random.seed(11)
VOCABULARY = ["alpha", "beta", "gamma", "delta", "Été", "日本", "x1", "of", "the", "##", "Epsilon,", "zeta!"]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCABULARY) + (str(r.randrange(50)) if r.random() < 0.6 else "") for _ in range(n))


def corpus():
    base, passage = prose(120, 1), prose(90, 2)
    texts = [base, base, base.replace("alpha", "ALPHA"), " ".join(base.split()[:-3]), base + " more words here", prose(300, 3) + "\n" + passage + "\n" + prose(50, 4), prose(40, 5) + " " + passage]
    texts += [None, "", " \n\t ", "one", "two words", "three plain words", "three plain words", "ab" * 700, "é" * 500, prose(3000, 6), prose(3000, 6)[:9000]]
    texts += ["line one here\n" * 30, "password = hunter22 token: abcdefgh AKIA" + "A1" * 10 + " " + "0af" * 10, "x" * 5]
    rows = [(i + 1, t, ["en", "de", None][i % 3], "k", i, 1, "c", 0.5) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[5], (None, base, "en", "k", 0, 1, "c", 0.5), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "t")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def utf8(t):
    return (t or "").encode()


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


# 1


@pytest.mark.parametrize("limit", [repeats.INDEX_BYTES, 2000, 100])
@pytest.mark.parametrize(("length", "passage"), [(400, None), (60, None), (400, 250), (90, 60)])
def test_repeats(docs, length, passage, limit):
    data = [(r[0], utf8(r[1])) for r in corpus()]

    def gone(size):
        seen = Counter(b[i : i + size] for _, b in data for i in range(len(b) - size + 1))
        for _, b in data:
            out = [False] * len(b)
            for a in range(len(b) - size + 1):
                if seen[b[a : a + size]] > 1:
                    out[a : a + size] = [True] * size
            yield out

    want = Counter()
    for (i, b), cut, known in zip(data, gone(length), gone(passage or length)):
        spans = sum(g and not (j and cut[j - 1]) for j, g in enumerate(cut))
        kept = bytes(x for x, g in zip(b, cut) if not g)
        want[i, len(b), sum(cut), spans, hashlib.sha256(kept).hexdigest(), sum(known)] += 1
    every, changed = repeats.remove_repeats(docs, length, passage=passage, index_bytes=limit)
    number = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = every.join(changed, "key", "left").select("id", "n_bytes", number("n_removed"), number("n_spans"), F.coalesce(F.sha2("kept", 256), F.lower(F.hex("digest"))).alias("sha"), number("n_passage_bytes"))
    assert bag(out, "*") == want


def test_buckets_of_one_kind_are_not_indexed(spark, monkeypatch):
    text, indexed, found = " ".join(f"w{i}x{i * 7919}" for i in range(200)), [], repeats._found
    monkeypatch.setattr(repeats, "_found", lambda pieces, *rest: indexed.append(pieces.count()) or found(pieces, *rest))
    df = spark.createDataFrame([(i, text) for i in range(3)] + [(3, text[:900] + "-" + text[1200:])], "doc_id bigint, text string")
    every, changed = repeats.remove_repeats(df, 60)
    left = {x.n_bytes: x.kept for x in every.join(changed, "key").collect()}
    assert left == {len(text): b"", len(text) - 299: text[:900].encode()[900:] + b"-"}
    assert 0 < indexed[0] < 12  # those about the cut, of some hundred kinds


def test_repeats_of_nothing(empty):
    every, changed = repeats.remove_repeats(empty)
    assert every.count() == changed.count() == 0


def test_without_repeats_keeps_rows_and_columns(docs):
    out = repeats.without_repeats(docs, 60)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("doc_id = 1 and text = ''").count() == 2


def test_run_index_matches():
    r = random.Random(5)
    strings = [bytes(r.choice(b"ab") for _ in range(r.randrange(1, 60))) for _ in range(12)]
    strings += [strings[3], b"a" * 40]
    index = repeats.RunIndex([np.frombuffer(s, np.uint8) for s in strings])
    found, long = np.concatenate(list(index.statistics(50))), Counter()
    for i, s in enumerate(strings):
        for a in range(len(s)):
            best = 0
            for j, t in enumerate(strings):
                for b in range(len(t)):
                    if (i, a) != (j, b):
                        n = 0
                        while a + n < len(s) and b + n < len(t) and s[a + n] == t[b + n]:
                            n += 1
                        best = max(best, n)
            assert found[index.starts[i] + a] == best
            long[i, a] = best >= 7
    assert {(i, x) for i, a, b in zip(*map(np.ndarray.tolist, index.matches(7))) for x in range(a, b)} == {k for k, v in long.items() if v}
    assert len(index.symbols) < index.n and index.lengths.sum() == index.n


def test_segments_partition_the_windows_in_slabs_too():
    texts = [utf8(prose(400, 77)), b"", b"short", utf8(prose(500, 78)), b"ab" * 300]
    for slab in (64, 1 << 18):
        whose, lo, n, bucket, content = repeats.segments(texts, 50, slab)
        starts = sorted((int(w), int(a) + i) for w, a, m in zip(whose, lo, n) for i in range(m))
        assert starts == [(i, a) for i, t in enumerate(texts) for a in range(len(t) - 49)]


# 2


def test_sharding(docs, empty):
    out = sharding.shard(docs, 4).collect()
    rows = corpus()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == Counter((r[0], len(utf8(r[1])) + 16, zlib.crc32(utf8(r[1]))) for r in rows)
    slots, by_crc = defaultdict(list), defaultdict(set)
    for r in out:
        slots[r.shard].append(r.slot)
        by_crc[r.text_crc32].add(r.shard)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 4
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in by_crc.values())
    # the whole result is as even as brute force makes it: groups of equal texts, largest first, to the least load
    groups, loads = Counter(), [0] * 4
    for row in rows:
        groups[utf8(row[1])] += len(utf8(row[1])) + 16
    for size in sorted(groups.values(), reverse=True):
        loads[loads.index(min(loads))] += size
    got = Counter()
    for r in out:
        got[r.shard] += r.size
    assert sorted(got.values()) == sorted(loads)
    assert sharding.shard(empty, 4).count() == 0


def loads_of(classes, shards):
    got = [0.0] * shards
    for (size, n, _), (key, some, ends) in zip(sorted(classes, reverse=True), sharding.schedule(classes, shards)):
        assert key == size and ends[-1] == n and len(some) == len(ends) <= shards
        for s, a, b in zip(some, [0, *ends], ends):
            got[s] += size * (b - a)
    return got


def test_schedule_is_the_heaps():
    import heapq

    r = random.Random(2)
    for large in ([], [(10**6, 1, 10**6)], [(50_000, 30, 50_000 * 30)]):
        classes = large + [(s, n, s * n) for s, n in {r.randrange(1, 1000): r.randrange(1, 200) for _ in range(80)}.items()]
        loads = [(0, s) for s in range(7)]
        for size, n, _ in sorted(classes, reverse=True):
            for _ in range(n):
                load, s = heapq.heappop(loads)
                heapq.heappush(loads, (load + size, s))
        assert sorted(loads_of(classes, 7)) == sorted(load for load, _ in loads)


def test_a_large_group_leaves_a_small_schedule():
    got = loads_of([(10**9, 1, 10**9), (2000, 400_000, 8 * 10**8)], 40)
    assert sorted(got)[-1] == 10**9 and max(sorted(got)[:-1]) - min(got) <= 2000


def test_size_classes(spark):
    sizes = [16, 4095, 8191, 8193, 10**6 + 7, 10**12 + 12345]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "s bigint").select(sharding.size_class(F.col("s"))).collect()]
    assert got[:3] == sizes[:3] and all(c <= s <= c * (1 + 2**-12) for c, s in zip(got, sizes))


# 3


def test_quality_counts_and_base(docs, spark, empty):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (2, None)], "doc_id bigint, quality int")
    out = quality.quality(docs, labels)
    want = Counter()
    for i, t, *_ in corpus():
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tri = Counter(zip(w, w[1:], w[2:]))
        marked = {i + k for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for k in range(3)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        dup = sum(x in lines[:j] for j, x in enumerate(lines))
        failed = len(w) < 50 or 100 * len(marked) > 50 * len(w)
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked), failed, not failed] += 1
    assert bag(out, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept") == want
    assert quality.quality(empty, labels.limit(0)).count() == 0


def test_certified_cutoffs_hold():
    assert abs(quality.upper_bound(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9
    tail = sum(math.comb(50, i) * 0.2**i * 0.8 ** (50 - i) for i in range(5))
    assert abs(quality.upper_bound(4, 50, tail) - 0.2) < 1e-9
    assert quality.certified({9: 10_000}, 9, 0.01, 0.01) == 8
    assert quality.certified({0: 500, 9: 500}, 9, 0.01, 0.01) is None and quality.certified({9: 20}, 9, 0.01, 0.01) is None
    assert quality.certified({5: 200, 9: 9_800}, 9, 0.01, 0.01) == 4


def measures(text):
    n, chars, symbols, dup, repeated, capitals, shouts, lines = quality.counts_of(text, shingles.WordHashes())
    return {"symbols": symbols / max(n, 1), "capitals": capitals / max(chars, 1), "shouts": shouts / max(n, 1), "repeats": repeated / max(n, 1), "lines": dup / max(lines, 1), "lengths": chars / max(n, 1) / 100}, n < 50 or 100 * repeated > 50 * n


def brute_kept(rows, labels, alpha=0.05, delta=0.05):
    """Every step of every stratum's way tried on every held-out good document, with binomial sums."""
    seen, tune, held = {}, [], defaultdict(list)
    truth = {}
    for i, y in labels:
        truth[i] = min(y, truth.get(i, 1))
    for i, text, lang in rows:
        m, failed = measures(text)
        levels = [min([x for x in range(quality.CUTOFFS) if m[r] > quality.STEP**-x], default=quality.CUTOFFS) for r in quality.RULES]
        seen[i] = lang, failed, levels
        if i in truth and not failed:
            (tune if zlib.crc32(str(i).encode()) % 5 < quality.TUNING else held[lang]).append((lang, truth[i] == 1, levels))
    strata = [s for s in held if sum(g for _, g, _ in held[s]) >= 20]
    cut = {}
    for s in strata:
        own = [x for x in tune if x[0] == s]
        own = own if sum(x[1] for x in own) >= quality.OWN_GOOD and sum(not x[1] for x in own) >= quality.OWN_BAD else tune
        best, value = None, None
        for step in quality.way(np.array([x[2] for x in own]), np.array([x[1] for x in own])):
            gone = lambda x: any(a >= b for a, b in zip(step, x[2]))  # noqa: B023, E731
            n, k = sum(x[1] for x in held[s]), sum(x[1] and gone(x) for x in held[s])
            if sum(math.comb(n, j) * alpha**j * (1 - alpha) ** (n - j) for j in range(k + 1)) > delta / len(strata):
                break
            now = sum((-quality.LOSS if x[1] else 1) * gone(x) for x in held[s])
            if best is None or now > value:
                best, value = step, now
        cut[s] = best
    return {i: not failed and (cut.get(lang) is None or not any(a >= b for a, b in zip(cut[lang], levels))) for i, (lang, failed, levels) in seen.items()}


def test_rules_reject_junk_and_keep_the_good(spark):
    r, rows, labels = random.Random(9), [], []
    for i in range(1400):
        lang = ["en", "en", "de", "xx"][i % 4]
        text = prose(r.randrange(40, 120), 1000 + i).replace("##", "ok")
        bad = i % 7 == 0
        if bad:
            text = [text.replace(" ", "%%% "), text.upper(), text.replace(" ", "! ")][i % 3]
        elif i % 29 == 0:
            text = text.replace("alpha", "ALPHA%")
        rows.append((i, text, lang))
        if i % 4 != 3 or i < 60:
            labels.append((i, int(not bad)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    out = {x.doc_id: x.kept for x in quality.quality(df, spark.createDataFrame(labels, "doc_id bigint, quality int")).collect()}
    assert out == brute_kept(rows, labels)
    for lang in ("en", "de"):
        own = [(i, y) for i, y in labels if rows[i][2] == lang and not measures(rows[i][1])[1]]
        assert sum(not out[i] for i, y in own if not y) >= 0.9 * sum(not y for _, y in own)
        assert sum(not out[i] for i, y in own if y) <= 0.05 * sum(y for _, y in own)
    assert all(out[i] for i in range(3, 1400, 4) if not measures(rows[i][1])[1])  # too few labels


def test_all_labels_show_how_to_tighten(spark):
    """Bad documents of a kind that is rare among 22,000 labels are learnt from, wherever their ids fall."""
    ids = spark.range(55_000).where(quality.tuning()).orderBy(F.xxhash64("id"), "id")
    late = spark.createDataFrame(ids.tail(40), "id long").select("id", F.lit(True).alias("late"))
    marked = spark.range(55_000).join(late, "id", "left").withColumn("bad", F.coalesce("late", (F.col("id") % 50 == 0) & ~quality.tuning()))
    words = " ".join(f"word{i}" for i in range(60))
    docs = marked.select(F.col("id").alias("doc_id"), F.when(F.col("bad"), words.replace(" ", "! ")).otherwise(words).alias("text"), F.lit("en").alias("lang"))
    labels = marked.select(F.col("id").alias("doc_id"), F.when(F.col("bad"), 0).otherwise(1).alias("quality"))
    out = quality.quality(docs, labels).join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    assert {(x.quality, x.kept) for x in out} == {(0, False), (1, True)}


@pytest.mark.parametrize("most", [quality.HISTOGRAM_ROWS, 0])
def test_ways_of_histograms(spark, monkeypatch, most):
    monkeypatch.setattr(quality, "HISTOGRAM_ROWS", most)
    r = random.Random(3)
    rows = [(r.choice("abc"), r.random() < 0.8, *(r.randrange(18, quality.CUTOFFS + 1) for _ in quality.RULES)) for _ in range(400)] + [("few", True, *[quality.CUTOFFS] * 6)] * 20
    got = quality.ways_of(spark.createDataFrame(rows, "stratum string, good boolean, " + ", ".join(f"{x} int" for x in quality.RULES)), ["a", "few"])
    for s, own in (("a", [x for x in rows if x[0] == "a"]), ("few", rows)):
        assert got[s] == quality.way(np.array([x[2:] for x in own]), np.array([x[1] for x in own])) != []



# 4


@pytest.fixture(scope="module")
def model():
    return pieces.merge_model(pieces.vocabulary())


def test_pieces_against_the_library(docs, model, empty):
    out = pieces.encode_pieces(docs, pieces.vocabulary(), keep=True)
    want = Counter()
    for i, t, *_ in corpus():
        ids = model.library.encode(t or "")
        text = model.library.decode(ids)
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), text] += 1
    assert bag(out, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "decoded") == want
    assert pieces.encode_pieces(empty, pieces.vocabulary()).count() == 0


def test_pieces_on_odd_texts(model):
    r = random.Random(3)
    parts = ["a", " ", "  ", "\n", "\t", "é", "▁", "😀", "中文", "​", "<s>", "<0x0A>", "\x00", "the", "ing", "²", "1", ".", "(", " aaaa"]
    for _ in range(1500):
        t = "".join(r.choice(parts) for _ in range(r.randrange(30)))
        ids, names = model.encode(t)
        assert ids == model.library.encode(t) and names == ",".join(map(str, ids))
        assert model.decode(ids) == model.library.decode(ids)
        noise = [r.randrange(300) for _ in range(r.randrange(8))]
        assert model.decode(noise) == model.library.decode(noise)
    model.check_new()


# 5


def test_secrets(docs, empty):
    assign = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    want = Counter()
    for i, t, *_ in corpus():
        t = t or ""
        found = [(m.start(), 0, m.end(), "assign") for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(found))
        want[i, *(sum(f[1] == j for f in found) for j in range(3)), hashlib.sha256(text.encode()).hexdigest(), text] += 1
    assert bag(secrets.scan_secrets(docs), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans") == want
    assert secrets.scan_secrets(empty).count() == 0


def test_trigram_queries_admit_all_matches():
    r = random.Random(4)
    rules = secrets.BASE_RULES + secrets.MORE_RULES
    index = secrets.TrigramIndex(rules)
    seeds = ["API_KEY='abcdefgh'", "apikey: zzzzzz9", "ghp_" + "a1" * 20, "xoxb-1234567890ab", "AIza" + "Q" * 35, "eyJabcdefgh1.eyJabcdefgh2.sig_nature", "-----BEGIN RSA PRIVATE KEY-----", "f" * 24, "Passwd = 'x+/=_.-'", "ſecret=abcdefgh"]
    texts = ["".join(r.choice([*seeds, " ", "日本", "token", "AKI", "-"]) for _ in range(r.randrange(6))) for _ in range(600)]
    for text, found in zip(texts, index.scan(texts)):
        want = sorted((a, n, b, rule.kind) for n, rule in enumerate(rules) for a, b in rule.spans(text))
        assert found == want
    assert secrets.trigram_query("[0-9a-f]{24,}") is True and secrets.trigram_query("ab(cd|ef)+gh") is True
    assert secrets.trigrams(secrets.trigram_query("ab(cde|fgh)+ij")) == {"cde", "fgh"}
    assert secrets.trigram_query("abcx*def") == ("and", ("tri", "abc"), ("tri", "def"))


def test_masking(docs):
    out = secrets.mask_secrets(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert out.where("text like '%hunter22%' or text like '%AKIA%'").count() == 0
    assert secrets.masked("a token=abcdefgh b", [(2, 0, 16, "assign")]) == "a <assign> b"
    other = docs.withColumnRenamed("text", "Body")
    assert secrets.mask_secrets(other, text_col="body").where("Body like '%hunter22%'").count() == 0


def test_rules_beyond_ascii():
    rule = secrets.Rule("word", "ключ=[a-z]{3}abc")
    index = secrets.TrigramIndex((rule,))
    assert [len(x) for x in index.scan(["ключ=xyzabc", "no abc", "ключ="])] == [1, 0, 0]


# 6


def brute_links(rows, percent, k):
    sets = []
    for _, t, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    links = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                top[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            low[find(i)] = min(low.get(find(i), r[0]), r[0])
    return [(r[0], len(s), low.get(find(i), r[0]), n) for i, (r, s, n) in enumerate(zip(rows, sets, links))]


@pytest.mark.parametrize(("percent", "k"), [(90, 3), (80, 5), (50, 2), (100, 3)])
def test_jaccard(spark, docs, percent, k, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 3)
    rows = corpus()
    out = jaccard.jaccard_components(docs, percent, k)
    assert bag(out, "doc_id", "n_shingles", "component_id", "n_links") == Counter(brute_links(rows, percent, k))


@pytest.mark.parametrize("compared", [4096, 2])
def test_jaccard_of_many_near_copies(spark, compared, monkeypatch):
    monkeypatch.setattr(jaccard, "COMPARED", compared)
    r, rows = random.Random(8), []
    for g in range(6):
        base = prose(150, 100 + g).split()
        for c in range(15):
            words = list(base)
            for _ in range(r.randrange(8)):
                words[r.randrange(len(words))] = f"edit{r.randrange(10**6)}"
            rows.append((g * 100 + c, " ".join(words)))
    out = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string"), 80, 5)
    assert bag(out, "doc_id", "n_shingles", "component_id", "n_links") == Counter(brute_links(rows, 80, 5))


def test_jaccard_of_nothing(empty):
    assert jaccard.jaccard_components(empty).count() == 0 and jaccard.one_per_group(empty).count() == 0


def test_one_per_group(docs):
    out = jaccard.one_per_group(docs, 80, 5)
    assert out.columns == docs.columns
    ids = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert ids[1] == 1 and not ids[2] and not ids[3] and ids[8] == 1 and ids[9] == 1  # equal rows: one; null and empty texts stay


def test_fragments_share_one_whatever_the_bitmap():
    r = np.random.default_rng(1)
    for percent in (80, 90):
        for n in (1, 3, 9, 40, 300, 2000):
            x = np.unique(r.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
            drop = int(len(x) * (100 - percent) / 100)
            y = np.delete(x, r.choice(len(x), drop, replace=False))
            bits = r.integers(0, 256, (1 << shingles.PLACES) // 8).astype(np.uint8)
            for frequent in (None, bits, np.full_like(bits, 255)):
                cut = shingles.Fragments(percent, frequent)
                if len(y) and len(y) != len(x):
                    assert np.intersect1d(cut.signatures(x), cut.signatures(y)).size


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7)]
    got = dict(tuple(r) for r in store.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 200: 100, 300: 100}


def test_near_duplicates_leave_little_on_disk(spark):
    r = random.Random(5)
    rows = []
    for i in range(60):
        words = prose(120, 7000 + i % 6).split()
        for _ in range(r.randrange(9)):
            words[r.randrange(len(words))] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    before = store.tracked(spark)
    kept = jaccard.one_per_group(df, 80, 5)
    assert {x.rpartition("/")[2].partition("-")[0] for x in store.tracked(spark) - before} == {"many"}
    sets = [shingles.shingle_set(t, 5, shingles.WordHashes()) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                label = [min(label[i], label[j]) if x in (label[i], label[j]) else x for x in label]
    assert {x.doc_id for x in kept.collect()} == set(label)


# 7


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a", "<p>x</p>", "k"), (2, "http://b", "<p>x</p>", "k"), (3, None, None, None), (4, "u", "", "k"), (5, "http://é\nx", "日本" * 4000, "k"), (6, "u", "<p>y</p>", "k"), (None, "u", "<p>x</p>", "k")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, refers_to string")
    uri = f"file://{tmp_path}/archives"
    archives = warc.write_archives(pages, uri, archive_bytes=600)
    assert archives.agg(F.sum("records")).first()[0] == len(rows)
    first, want = {}, Counter()
    for i, _, html, _ in rows:
        if i is not None:
            first.setdefault(utf8(html), i)
    for i, _, html, _ in rows:
        b = utf8(html)
        refers = first[b] if i is not None and first[b] != i else None
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if refers else "response", refers] += 1
    assert bag(warc.read_archives(archives, uri), "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to") == want
    table = store.written(warc.read_archives(archives, uri), "records")
    assert bag(warc.verified(table), "*") == bag(table, "*")
    with pytest.raises(Exception, match="without its payload"):
        warc.verified(table.withColumn("payload_digest", F.when(F.col("page_id") == 2, "x").otherwise(F.col("payload_digest")))).collect()
    large = warc.read_archives(warc.write_archives(pages, f"{uri}-2", least=9), f"{uri}-2")
    assert large.where("record_type = 'revisit'").count() == 0
    assert warc.read_archives(warc.write_archives(pages.limit(0), f"{uri}-3"), f"{uri}-3").count() == 0


def test_warc_reader_verifies():
    good = warc.record(1, "u", b"payload " * 20_000, None) + warc.record(2, "u", b"payload " * 20_000, 1)
    records = list(warc.read_records(io.BytesIO(good)))
    assert [r.headers["warc-type"] for r in records] == ["response", "revisit"] and records[0].payload == b"payload " * 20_000
    with pytest.raises(ValueError, match="cut off"):
        list(warc.read_records(io.BytesIO(good[:-5])))
    raw = zlib.decompress(warc.record(1, "u", b"abc", None), 31)

    def member(data):
        squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
        return io.BytesIO(squeeze.compress(data) + squeeze.flush())

    for bad in (raw.replace(b"abc", b"abd"), raw.replace(b"\r\n\r\nabc", b"\r\n\r\nabcd"), b"no head"):
        with pytest.raises(ValueError):
            list(warc.read_records(member(bad)))


# 8


def brute_top(rows, asks, k):
    """By the query's id, all its results as sorted lists; rows are (id, integers)."""
    out = defaultdict(list)
    for n, (q, x) in asks:
        best = sorted((-int(sum(int(a) * int(b) for a, b in zip(x, y))), i) for m, (i, y) in enumerate(rows) if m != n and len(x) == len(y))[:k]
        out[q].append([(r + 1, i, -s) for r, (s, i) in enumerate(best)])
    return {q: sorted(v) for q, v in out.items()}


@pytest.mark.parametrize("portion", [vafile.PASS_BYTES, 2000])
def test_top_k(spark, portion, monkeypatch):
    monkeypatch.setattr(vafile, "PASS_BYTES", portion)
    monkeypatch.setattr(vafile, "QUERIES", 7)
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.normal(size=8)], "k") for i in range(300)]
    rows += [(300 + i, rows[i][1], "k") for i in range(40)]  # ties
    rows += [(0, rows[0][1], "k"), (10, rows[3][1], "k")]  # a repeated row, and another row of the same id
    odd = [(400, None, "k"), (401, [1.0] * 7 + [None], "k"), (402, [float("nan")] * 8, "k"), (403, [float("inf")] * 8, "k"), (404, [], "k"), (None, [1.0] * 8, "k")]
    two = [(500, [1.0, 2.0], "k"), (501, [3.0, -1.0], "k")]
    df = spark.createDataFrame(rows + odd + two, "vec_id bigint, embedding array<float>, score string").repartition(5)
    got, sound = defaultdict(list), [(i, np.floor(np.float32(v).astype(np.float64) * 1024)) for i, v, _ in rows + two]
    for x in vafile.top_k(df, df.where("vec_id % 10 = 0"), 10).collect():
        got[x.query_id].append((x.rank, x.vec_id, x.score))
    want = brute_top(sound, [(n, row) for n, row in enumerate(sound) if row[0] % 10 == 0], 10)
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(x for one in v for x in one) for q, v in want.items()}
    few = df.where("vec_id in (1, 2)")
    assert vafile.top_k(few, few, 10).count() == 2 and vafile.top_k(df.limit(0), df.limit(0)).count() == 0


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e300, 1.0]), (1, [2.0**60, -1.0]), (2, [3e9, 5.0]), (3, [-1e9, 7.0]), (4, [0.5, 1e17])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(x.query_id, x.vec_id): x.score for x in vafile.top_k(df, df, 4).collect()}
    for i, x in rows:
        for j, y in rows:
            if i != j:
                exact = sum(int(min(a * 1024, 2.0**500) // 1) * int(min(b * 1024, 2.0**500) // 1) for a, b in zip(x, y))
                assert got[i, j] == max(-(2**63), min(2**63 - 1, exact))


def test_bounds_save_reading():
    r = np.random.default_rng(4)
    exact = np.floor(r.normal(size=(3000, 16)) * 1024)
    low, width = exact.min(0), (exact.max(0) - exact.min(0) + 1) / vafile.CELLS
    cells = np.floor((exact - low) / width).clip(0, vafile.CELLS - 1).astype(np.uint8)
    lower, upper = vafile.bounds(exact[:5], cells, low, width)
    true = exact[:5] @ exact.T
    assert (lower <= true).all() and (true <= upper).all()
    read = []
    for i in range(5):
        vafile.best_of(exact[i], np.arange(3000), upper[i], -np.inf, exact, 10, read)
    assert max(read) < 300


# 9


def toxic_corpus(n):
    r, rows, labels = random.Random(6), [], []
    for i in range(n):
        toxic = i % 6 == 0
        words = [r.choice(VOCABULARY) + r.choice("aeiou") for _ in range(r.randrange(20, 300))]
        for _ in range(4 * toxic):
            words.insert(r.randrange(len(words)), "grumble" + r.choice(["", "r", "ing", "xo"]))
        rows.append((i, " ".join(words), "en", 0.0))
        labels.append((i, int(toxic)))
    return rows, labels


def test_toxicity_on_held_out_rows(spark, docs, empty):
    rows, labels = toxic_corpus(900)
    df = spark.createDataFrame([*rows, (None, None, None, None), (10**6, "", "en", 0.0)], "doc_id bigint, text string, lang string, score double")
    marks = spark.createDataFrame([*labels, (None, 1), (3, None)], "doc_id bigint, toxic int")
    out = toxicity.score_toxicity(df, marks).collect()
    assert len(out) == 902 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in out)
    truth = dict(labels)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    # labels of held-out rows play no part
    flipped = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels], "doc_id bigint, toxic int")
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(df, flipped).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-9 for r in out)
    assert toxicity.score_toxicity(empty, marks.limit(0)).count() == 0
    assert {r.score for r in toxicity.score_toxicity(df.limit(5), marks.limit(0)).collect()} == {0.0}


def test_kneser_ney_sums_to_one(spark):
    words = [("abab", 3, 1), ("abba", 1, 0), ("cab", 2, 2), ("b", 0, 4)]
    counts = Counter()
    for w, o, t in words:
        for c, x in toxicity.grams(w):
            counts[c, x, 0] += o
            counts[c, x, 1] += t
    keys = sorted({(c, x) for c, x, _ in counts})
    df = spark.createDataFrame([(c, x, counts[c, x, 0], counts[c, x, 1]) for c, x in keys], "context string, char string, ordinary long, toxic long")
    model = {(r.context, r.char): r.llr for r in toxicity.kneser_ney(df).collect()}
    tail = lambda c: c[len(c) - min(len(c) - 1, 3) :]
    # brute force of the shared distribution, from the number of different contexts one longer
    level = {n: Counter() for n in range(4)}
    for n in (3, 2, 1, 0):
        above = {(c, x) for c, x in keys if len(c) == n + 1 or n == 3 < len(c)} | ({(c, x) for c, x in level[n + 1]} if n < 3 else set())
        for c, x in above:
            level[n][tail(c), x] += 1
    every = {x for _, x in level[0]}

    def shared(c, x):
        if c is None:
            return 1 / len(every)
        own = {y: v for (d, y), v in level[len(c)].items() if d == c}
        total, rest = sum(own.values()), shared(tail(c) if c else None, x)
        return (max(own.get(x, 0) - 0.75, 0) + 0.75 * len(own) * rest) / total

    def p(kind, c, x):
        own = {y: counts[c, y, kind] for d, y in keys if d == c and counts[c, y, kind]}
        total, rest = sum(own.values()), shared(tail(c), x)
        return rest if not total else (max(own.get(x, 0) - 0.75, 0) + 0.75 * len(own) * rest) / total

    for c, x in keys:
        assert abs(model[c, x] - math.log(p(1, c, x) / p(0, c, x))) < 1e-9
    assert abs(sum(shared("", x) for x in every) - 1) < 1e-9


def test_large_models_are_read_in_parts(spark, tmp_path, monkeypatch):
    grams = [("^ab", "c", 0.5), ("^", "a", 0.25), ("^a", None, -1.0)]
    df = spark.createDataFrame([(int(toxicity.keys_of(np.array([toxicity.CONTEXT_HASHES[c]], np.uint64), np.array([ord(x) if x else toxicity.UNSEEN], np.uint32))[0]), v) for c, x, v in grams], "key long, llr float")
    df.repartitionByRange(2, "key").sortWithinPartitions("key").write.parquet(str(tmp_path / "m"))
    for kept in (10, 0):
        monkeypatch.setattr(toxicity, "KEPT_ENTRIES", kept)
        m = toxicity.Model(str(tmp_path / "m"))
        assert (m.kept is None) == (kept == 0)
        m.learn({"abc", "q"})
        assert m.ratios[m.words["abc"]] == pytest.approx(0.25 - 1.0 + 0.5) and m.ratios[m.words["q"]] == 0


# 10


@pytest.mark.parametrize("size", [64, 2048])
def test_packing(docs, empty, size):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(packing.vocabulary())
    want = Counter()
    for i, t, *_ in corpus():
        want[i, tuple([*own.encode(t or "", add_special_tokens=False).ids, packing.END])] += 1
    out = packing.pack(docs, packing.vocabulary(), size).collect()
    sequences, total = defaultdict(list), 0
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
        total += r.length
    assert total == sum(len(ids) * n for (_, ids), n in want.items())
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= size
    pieces_of = defaultdict(list)
    for r in out:
        pieces_of[r.doc_id, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
    for (i, n), got in pieces_of.items():
        for start, length, crc in got:
            assert any(zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes()) == crc for (j, ids), _ in want.items() if j == i and len(ids) == n)
        same = sum(v for (j, ids), v in want.items() if j == i and len(ids) == n)
        assert sorted(x for a, b, _ in got for x in range(a, a + b)) == sorted(list(range(n)) * same)
    assert packing.pack(empty, packing.vocabulary(), size).count() == 0


def test_ids_are_the_librarys():
    from tokenizers import Tokenizer

    own, encoder = Tokenizer.from_file(packing.vocabulary()), packing.Encoder(packing.vocabulary())
    r = random.Random(12)
    parts = ["a", "B", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "\u2028", "\u3000", "é", "ß", "ʼ", "'s", "'LL", "don't", "1", "²", "Ⅷ", "½", "٣", "中文", "日本語", "한국", "😀", "\u200b", "\u0301", "\U0001e900", "\u1c89", "<|endoftext|>", "<|endoftext", "...", "_", "\x00", "the"]
    texts = ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(3000)] + [t or "" for _, t, *_ in corpus()]
    texts += ["".join(chr(c) for c in range(a, a + 500) if not 0xD800 <= c < 0xE000) for a in range(0, 0x3000, 500)]
    want = [np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    for at in range(0, len(texts), 300):
        assert encoder.encode(texts[at : at + 300]) == want[at : at + 300]
    assert encoder.encode([]) == []


def test_texts_of_known_chunks_are_only_looked_up(monkeypatch):
    from tokenizers import Tokenizer

    own, encoder = Tokenizer.from_file(packing.vocabulary()), packing.Encoder(packing.vocabulary())
    encoder.encode(["the garden, and Öl for the end.\nNext (one)"])
    text = "the (one) garden, the end. Öl\nNext for and end garden"
    monkeypatch.setattr(encoder, "words", lambda text: pytest.fail(f"{text!r} was split into words"))
    assert encoder.encode([text]) == [np.array(own.encode(text, add_special_tokens=False).ids, "<u4").tobytes()]


@pytest.mark.parametrize("remembered", [1, 9, 1000])
def test_chunks_are_cut_where_no_word_crosses(remembered, tmp_path):
    """White space before and after line feeds, tokens among letters and marks, and less memory than words."""
    from tokenizers import Tokenizer

    model = json.loads(Path(packing.vocabulary()).read_text(encoding="utf-8"))
    last = max(model["model"]["vocab"].values())
    model["added_tokens"] += [{**model["added_tokens"][0], "id": last + 1 + i, "content": c} for i, c in enumerate(("wor", "?!"))]
    (tmp_path / "more.json").write_text(json.dumps(model), encoding="utf-8")
    r, parts = random.Random(7), ["word", "the", "é", " ", " ", " ", "\n", "\n", "  ", "\t", "\r", "\u3000", "\x1c", "'", "'s", ".", ",", "?!", "12", "wor", "<|endoftext|>"]
    texts = ["", " ", "\n", " \n ", "\u3000", "\u3000 the\u3000\n"] + ["".join(r.choice(parts) for _ in range(r.randrange(16))) for _ in range(1500)]
    for path in (packing.vocabulary(), str(tmp_path / "more.json")):
        own, encoder = Tokenizer.from_file(path), packing.Encoder(path, remembered)
        for at in range(0, len(texts), 100):
            part = texts[at : at + 100]
            assert encoder.encode(part) == [np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in part]
            assert len(encoder) + len(encoder.older) <= max(2, remembered)


def test_cutting_stock_places_all_with_little_padding():
    r = random.Random(1)
    counts = Counter(min(2047, int(r.lognormvariate(6, 1)) + 1) for _ in range(3000))
    halved, plan = packing.cutting_stock(dict(counts), 2048)
    placed = Counter()
    for pattern, times in plan:
        assert sum(x * n for x, n in pattern.items()) <= 2048
        for x, n in pattern.items():
            placed[x] += n * times
    for x, n in halved.items():
        placed[x] += n
        placed[x - 1024] -= n
    assert +placed == +counts
    tokens = sum(x * n for x, n in counts.items())
    used = 1024 * sum(halved.values()) + sum(packing.padded(sum(x * n for x, n in p.items()), 2048) * t for p, t in plan)
    assert used <= 1.01 * tokens
