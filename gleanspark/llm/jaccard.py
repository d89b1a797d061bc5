"""Jaccard similarity join on word shingles by vertical partitioning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from gleanspark.llm.shingles import PLACES, Fragments, WordHashes, places, shingle_set
from gleanspark.llm.store import KEY, components, held, plain, remove, row_key, small, sweep, tracked, unused, written

#: Sets compared at once: a task holds two blocks of this many.
BLOCK = 256
#: Members of small candidate clusters that share a task.
BUNDLE = 1500
#: Fragments that the global order of shingles is cut into, and elements of one whose overlaps are counted at once.
FRAGMENTS, COLUMNS = 4, 4096

#: Members of a bucket that are compared with each other by bitmaps.
COMPARED = 4096
#: Rows, about, from which frequent shingles are learnt, and how many of them must have one. They only save work.
SAMPLE, OFTEN = 16_384, 3
#: Members of buckets that are compared by one task, and bitmaps for each class, about, that are sent to all tasks at once.
NEAR_ROWS, PASS = 20_000, 12
#: Rows of a batch that are handled at once.
SLICE = 1000


def _sampled(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held((), object)
        words = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                seen = [np.unique(places(shingle_set(t.as_py(), k, words))) for t in batch.column("text").slice(at, SLICE)]
                place, n = np.unique(np.concatenate(seen), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(n, pa.int64())], ["place", "n"])

    return run


def _frequent(keyed: DataFrame, k: int) -> np.ndarray:
    """A bitmap of 2**PLACES bits: the places of shingles that occur in several of about SAMPLE rows."""
    sample = keyed.where(F.pmod(F.xxhash64("key"), F.lit(max(1, keyed.count() // SAMPLE))) == 0).select("text")
    found = sample.mapInArrow(_sampled(k), "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    at = written(found.select("place"), "frequent").toPandas()["place"].to_numpy(np.int64)
    bits = np.zeros(1 << PLACES, np.uint8)
    bits[at] = 1
    return np.packbits(bits, bitorder="little")


def _sets(k: int, percent: int, frequent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held((), object)  # nothing of other stages is needed
        words, cut = WordHashes(), Fragments(percent, frequent.value)
        for batch in (b.slice(at, SLICE) for b in batches for at in range(0, b.num_rows, SLICE)):
            sizes, classes, sigs, bits = [], [], [], []
            for text in batch.column("text"):
                s = shingle_set(text.as_py(), k, words)
                sizes.append(len(s))
                classes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(cut.signatures(s).view(np.int64))
                bits.append(bitmap(s, max(64, 1 << (cut.lower(cut.class_of(len(s)) + 1)).bit_length())).tobytes() if len(sigs[-1]) else None)
            lengths = np.cumsum([0, *map(len, sigs)])
            values = np.concatenate(sigs) if sigs else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(values, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(sizes, pa.int64()), pa.array(classes, pa.binary()), pa.array(bits, pa.binary()), lists], ["id", "key", "n", "same", "bits", "sigs"])

    return run


def bitmap(s: np.ndarray, size: int) -> np.ndarray:
    """A bit for each element of a set, by its hash modulo ``size``."""
    bits = np.zeros(size, np.uint8)
    bits[(s >> np.uint64(7)).astype(np.int64) & (size - 1)] = 1
    return np.packbits(bits, bitorder="little")


def _may(percent: int):
    """Whether the bitmaps of two classes allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            may = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "n2", "bits", "bits2"))):
                width = min(len(x), len(y))
                a, b = (np.bitwise_or.reduce(np.frombuffer(z, np.uint64).reshape(-1, width // 8), 0) for z in (x, y))
                may.append(int(np.bitwise_count(a ^ b).sum()) * (100 + percent) <= (100 - percent) * (n + m))
            yield pa.RecordBatch.from_arrays([batch.column("class"), batch.column("lead"), pa.array(may, pa.bool_())], ["class", "lead", "may"])

    return run


def _near(percent: int):
    """Edges that join the members of each bucket as far as their bitmaps allow a link.

    Each bit in which two bitmaps differ is an element in which the sets differ, so too many such bits rule a link
    out, and nothing that is linked is ever told apart.
    """

    def join(top: dict[int, int], a: int, b: int) -> bool:
        a, b = _root(top, a), _root(top, b)
        if a != b:
            top[a] = b
        return a != b

    def edges(top: dict[int, int], ids: np.ndarray, sizes: np.ndarray, bits: list[bytes]) -> Iterator[tuple[int, int]]:
        ids = ids.tolist()
        width = min(map(len, bits))
        folded = np.stack([np.bitwise_or.reduce(np.frombuffer(b, np.uint8).reshape(-1, width), 0) for b in bits])
        words, label = folded.view(np.uint64), np.arange(len(ids))
        for i in range(len(ids) - 1):
            apart = np.bitwise_count(words[i + 1 :] ^ words[i]).sum(1)
            may = apart * (100 + percent) <= (100 - percent) * (sizes[i + 1 :] + sizes[i])
            for j in i + 1 + np.flatnonzero(may & (label[i + 1 :] != label[i])):
                if label[j] != label[i]:
                    label[label == label[j]] = label[i]
                    if join(top, ids[i], ids[j]):
                        yield ids[i], ids[j]

    def run(table: pa.Table) -> pa.Table:
        sig, ids, n = (table.column(c).to_numpy() for c in ("sig", "class", "n"))
        order = np.lexsort((ids, sig))
        sig, ids, n = sig[order], ids[order], n[order]
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]])
        bits, top, out = table.column("bits"), {}, []
        for a, b in zip(starts, np.r_[starts[1:], len(sig)]):
            if b - a > 1:
                # buckets that share their members add nothing to one another's edges
                out += edges(top, ids[a:b], n[a:b], [bits[i].as_py() for i in order[a:b]])
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def _root(top: dict[int, int], x: int) -> int:
    while top.get(x, x) != x:
        top[x] = x = top.get(top[x], top[x])
    return x


def _tokens(k: int):
    """Each set cut by the global order of shingles, that of their hashes, into FRAGMENTS pieces, empty ones too."""
    cuts = (np.arange(1, FRAGMENTS) * (2.0**64 / FRAGMENTS)).astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, names = WordHashes(), ("cluster", "class", "copies")
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingle_set(t.as_py(), k, words) for t in part.column("text")]
                pieces = [x.tobytes() for s in sets for x in np.split(s, np.searchsorted(s, cuts))]
                rows = pa.array(np.repeat(np.arange(len(sets)), FRAGMENTS))
                size = pa.array(np.repeat(np.array(list(map(len, sets)), np.int64), FRAGMENTS))
                fragment = pa.array(np.tile(np.arange(FRAGMENTS, dtype=np.int32), len(sets)))
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(rows) for c in names), size, fragment, pa.array(pieces, pa.binary())], [*names, "size", "fragment", "tokens"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right``: products of their incidence with what is on both sides."""
    out = np.zeros((len(left), len(right)), np.float32)
    a, b = np.concatenate(left), np.concatenate(right)
    rows_a, rows_b = np.repeat(np.arange(len(left)), [len(x) for x in left]), np.repeat(np.arange(len(right)), [len(x) for x in right])
    order = np.intersect1d(a, b)
    for start in range(0, len(order), COLUMNS):
        part, sides = order[start : start + COLUMNS], []
        for values, rows, n in ((a, rows_a, len(left)), (b, rows_b, len(right))):
            at = np.searchsorted(part, values)
            at[at == len(part)] = 0
            hit = part[at] == values
            m = np.zeros((n, len(part)), np.float32)
            m[rows[hit], at[hit]] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out.astype(np.uint32)


_SIDE = ("class", "size", "copies")
_PARTIAL = {"task": pa.int64(), "cluster": pa.int64(), "first": pa.int32(), "second": pa.int32(), **{f"{c}_{x}": pa.binary() for x in "ab" for c in _SIDE}, "counts": pa.binary()}
_PARTIAL_KINDS = "task long, cluster long, first int, second int, " + ", ".join(f"{c}_{x} binary" for x in "ab" for c in _SIDE) + ", counts binary"


def _partial(table: pa.Table) -> pa.Table:
    """Overlaps inside one fragment, of all pairs of two blocks of one cluster, or of many whole clusters: a matrix each."""
    rows = table.drop_columns(["tokens"]).to_pandas().sort_values("class", kind="stable")
    sets, out = table.column("tokens"), []
    for (cluster, first, second), g in rows.groupby(["cluster", "first", "second"], sort=False):
        sides = [g[g.block == n] for n in (first, second)]
        if all(map(len, sides)):
            counts = overlaps(*([np.frombuffer(sets[i].as_py(), np.uint64) for i in x.index] for x in sides))
            out.append((int(g.task.iloc[0]), cluster, first, second, *(x[c].to_numpy(np.int64).tobytes() for x in sides for c in _SIDE), counts.tobytes()))
    return pa.table([pa.array(c, kind) for c, kind in zip(zip(*out) if out else [()] * len(_PARTIAL), _PARTIAL.values())], list(_PARTIAL))


def _linked(percent: int):
    """Sums the fragments' overlaps for each pair: each set's links, and a spanning forest of them."""

    def pairs(a: list[np.ndarray], b: list[np.ndarray], both: np.ndarray, same: bool) -> Iterator[tuple[int, int, int]]:
        (ids_a, sizes_a, copies_a), (ids_b, sizes_b, copies_b) = a, b
        link = 100 * both >= percent * (sizes_a[:, None] + sizes_b[None, :] - both)
        if same:
            np.fill_diagonal(link, False)
        ids_a, ids_b, top = ids_a.tolist(), ids_b.tolist(), {}
        for i, j in zip(*np.nonzero(link)):
            p, q = _root(top, ids_a[i]), _root(top, ids_b[j])
            if p != q:
                top[p] = q
                yield ids_a[i], ids_b[j], 0
        for i, n in enumerate(link @ copies_b):
            if n:
                yield ids_a[i], ids_a[i], int(n)
        if not same:
            for j, n in enumerate(link.T @ copies_a):
                if n:
                    yield ids_b[j], ids_b[j], int(n)

    def run(table: pa.Table) -> pa.Table:
        keys, out = table.select(["cluster", "first", "second"]).to_pandas(), []
        for (_, first, second), g in keys.groupby(["cluster", "first", "second"], sort=False):
            value = lambda c, i=g.index[0]: np.frombuffer(table.column(c)[i].as_py(), np.int64)
            a, b = ([value(f"{c}_{x}") for c in _SIDE] for x in "ab")
            both = sum(np.frombuffer(table.column("counts")[i].as_py(), np.uint32).astype(np.int64) for i in g.index)
            out += pairs(a, b, both.reshape(len(a[0]), len(b[0])), first == second)
        a, b, n = zip(*out) if out else ((), (), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "links": pa.array(n, pa.int64())})

    return run


def jaccard_components(docs: DataFrame, percent: int = 90, k: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, n_shingles, component_id, n_links, row_key and component.

    row_key identifies the row by its id and text, component is a number of the component, null without shingles.

    A text's set holds the distinct ``k``-word shingles of its A-Z-lowered words; a text with fewer words has all
    of them as one shingle. Two rows link when 100 * |intersection| >= percent * |union|; component_id is the
    smallest id reachable by links, n_links the number of other rows linked.

    Null or wordless texts have no shingles, component_id their own id and no links. Repeated rows and equal
    texts link with each other. Rows with a null id take part and get the component's smallest id, null if none.
    An empty table gives an empty result; other columns are ignored.

    Equal sets are one class. A set is cut into enough fragments of the hash order that linked sets share a whole
    one; classes that share one, and whose bitmaps don't rule a link out, form candidate clusters. Only their sets
    are fetched. A cluster is compared in blocks of at most about BLOCK sets a side, so that no task holds more than
    two; overlaps are counted for each fragment of the global order apart, as rows of their own, and summed for each pair.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    keyed = source.select("id", row_key("id", "text").alias("key"), "text")
    id_type = source.schema["id"].dataType.simpleString()
    frequent = docs.sparkSession.sparkContext.broadcast(_frequent(keyed, k))
    every = written(keyed.mapInArrow(_sets(k, percent, frequent), f"id {id_type}, key {KEY}, n long, same binary, bits binary, sigs array<long>"), "sets")
    # equal sets are one class from here on, with a number of its own
    classes = every.where("same is not null").groupBy("same").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"), F.min("key").alias("key"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("sigs").alias("sigs"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "classes")
    # what only classes need goes as soon as they have it
    sets, every = every, written(every.select("id", "key", "n", "same"), "rows")
    remove(sets)

    pairs = classes.where(F.size("sigs") > 0).select(F.explode(F.array_distinct("sigs")).alias("sig"), "class")
    shared = written(pairs.groupBy("sig").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("lead")).where("n > 1").select("sig", "lead"), "shared")
    led = written(pairs.join(small(shared), "sig"), "members")
    remove(shared)
    full, classes = classes, written(classes.drop("sigs"), "classes")
    remove(full)
    info = classes.select("class", "n", "bits")
    stars = led.where("class <> lead").select("class", "lead").distinct()
    stars = stars.join(info, "class").join(info.select(F.col("class").alias("lead"), F.col("n").alias("n2"), F.col("bits").alias("bits2")), "lead")
    stars = written(stars.mapInArrow(_may(percent), "class long, lead long, may boolean"), "stars")
    # where a member can't be linked to its bucket's first, any two of the members may be
    apart = written(led.join(small(written(stars.where("not may").select("class", "lead"), "apart")), ["class", "lead"]).select("sig").distinct(), "buckets")
    split = written(led.join(small(apart), "sig"), "split")
    remove(led)
    # a bucket of very many is joined without a look, so that no task holds more than COMPARED of one
    wide = written(split.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > COMPARED).select("sig"), "wide")
    whole = split.join(small(wide), "sig").where("class <> lead").select(F.col("class").alias("a"), F.col("lead").alias("b"))
    split = split.join(small(wide), "sig", "left_anti").select("sig", "class")
    n_split = split.count()
    tasks = max(1, n_split // NEAR_ROWS)
    # bitmaps are sent to the buckets in passes, so that the disk holds no more of them at once than a few for each class
    passes = max(1, min(tasks, -(-n_split // (PASS * classes.count() + 1))))
    split, others = split.withColumn("task", F.pmod(F.xxhash64("sig"), F.lit(tasks))), None
    for i in range(passes):
        near = split.where(F.pmod("task", F.lit(passes)) == i).join(info, "class").groupBy("task").applyInArrow(_near(percent), "a long, b long")
        near = written(near, "near")
        others = near if others is None else others.union(near)
    stars = stars.where("may").select(F.col("class").alias("a"), F.col("lead").alias("b")).union(others).union(whole).distinct()
    clusters = components(stars)

    wanted = clusters.select(F.col("root").alias("cluster"), F.col("node").alias("class")).join(classes.select("class", "copies", "key"), "class").select("cluster", "class", "copies", "key")
    fetched = keyed.select("key", "text").join(small(written(wanted, "wanted")), "key").select("cluster", "class", "copies", "text")
    sets = written(fetched.mapInArrow(_tokens(k), "cluster long, class long, copies long, size long, fragment int, tokens binary").dropDuplicates(["class", "fragment"]), "tokens")

    whole = sets.where("fragment = 0")
    sizes = whole.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    bundles = max(1, -(-whole.count() // BUNDLE))
    parts = sets.join(sizes, "cluster").withColumn("block", F.pmod(F.xxhash64("class"), F.col("blocks")).cast("int"))
    parts = parts.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    parts = parts.withColumn("first", F.least("block", "with")).withColumn("second", F.greatest("block", "with"))
    parts = parts.withColumn("task", F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("cluster"), F.lit(bundles))).otherwise(F.xxhash64("cluster", "first", "second")))
    # overlaps are counted fragment by fragment, in tasks of their own, and then summed for each pair
    partial = parts.drop("blocks", "with").groupBy("task", "fragment").applyInArrow(_partial, _PARTIAL_KINDS)
    found = written(partial.groupBy("task").applyInArrow(_linked(percent), "a long, b long, links long"), "links")

    roots = components(found.where("a <> b"))
    links = found.where("a = b").groupBy(F.col("a").alias("class")).agg(F.sum("links").alias("links"))
    lows = roots.join(classes.select(F.col("class").alias("node"), "low"), "node").groupBy("root").agg(F.min("low").alias("reach"))
    reach = roots.join(lows, "root").select(F.col("node").alias("class"), "reach", "root")
    info = classes.select("same", "class", "low", "copies").join(reach, "class", "left").join(links, "class", "left")
    info = info.select("same", F.coalesce("root", "class").alias("component"), F.coalesce("reach", "low").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    remove(sets)
    return (
        every.select("id", "key", "n", "same")
        .join(info, "same", "left")
        .select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("key").alias("row_key"), "component")
    )


def one_per_group(docs: DataFrame, percent: int = 80, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without all but one row of each component: the row of the smallest id stays, all columns as they are.

    Rows without shingles all stay. Of equal rows one stays.
    """
    key, twice, number = unused(docs, "_key", "_twice", "_n")
    before = tracked(docs.sparkSession)
    groups = jaccard_components(docs, percent, k, id_col, text_col).where("component is not null").select(F.col(f"`{id_col}`").alias("id"), "row_key", "component")
    order = F.struct(F.col("id").isNull().alias("n"), F.col("id").alias("i"), F.col("row_key").alias("k"))
    first = groups.groupBy("component").agg(F.min(order).alias("one"), F.count(F.lit(1)).alias("rows")).where("rows > 1")
    stays = F.col("row_key") == F.col("one.k")
    many = written(groups.join(first, "component").groupBy("row_key").agg(F.max(stays).alias("stays"), F.count(F.lit(1)).alias("rows")), "many")
    # the texts may be shuffled from here on, and take the place of all that led to this table
    sweep(docs.sparkSession, before | {x for x in tracked(docs.sparkSession) if x.rpartition("/")[2].startswith("many-")})
    names = [F.col(f"`{c}`") for c in docs.columns]
    keyed = docs.withColumn(key, row_key(id_col, text_col))
    rest = keyed.join(small(many.where("not stays").select(F.col("row_key").alias(key))), key, "left_anti")
    again = many.where("stays and rows > 1").select(F.col("row_key").alias(key), F.lit(True).alias(twice))
    if not again.limit(1).count():
        return rest.select(names)
    # equal rows, of which one stays: the first of each task's, then the first of these
    marked = rest.join(small(again), key, "left")
    task = F.spark_partition_id()
    some = marked.where(F.col(twice)).withColumn(number, task)
    some = some.withColumn(number, F.row_number().over(W.partitionBy(key, number).orderBy(key))).where(F.col(number) == 1)
    single = some.withColumn(number, F.row_number().over(W.partitionBy(key).orderBy(key))).where(F.col(number) == 1)
    return marked.where(F.col(twice).isNull()).select(names).union(single.select(names))


def op6_jaccard(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"), percent=90, k=3).drop("row_key", "component")
