"""Exact top-k search by inner product with vector-approximation files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from gleanspark.llm.store import plain, written

#: Cells a component is cut into, queries scanned together, vectors of a block.
CELLS, QUERIES, VECTORS = 64, 256, 4096
#: Bytes of queries that pass over the file together; each pass sends them to all workers.
PASS_BYTES = 16 << 20
#: Products of integers below this add up exactly in doubles.
_EXACT = 2.0**53
#: Components beyond this count as it: sums of products stay finite.
_MOST = 2.0**500
_LONG = 2**63


def integers(vector: list, scale: float) -> np.ndarray:
    """floor(scale * x) of each component, as doubles: exact, whatever its size."""
    with np.errstate(over="ignore"):
        return np.floor(np.array(vector, np.float64) * scale).clip(-_MOST, _MOST)


def _blocks(scale: float, rows: int):
    """Packs vectors of one dimension into blocks: a number, ids, cell numbers, the cells' lower bounds and widths, exact vectors."""
    names = ["number", "dim", "ids", "cells", "low", "width", "exact"]
    kinds = [pa.int64(), pa.int32()] + [pa.binary()] * 5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        waiting: dict[int, tuple[list, list]] = {}

        def pack(dim: int) -> pa.RecordBatch:
            nonlocal number
            ids, vectors = waiting.pop(dim)
            exact = np.stack(vectors)
            low = exact.min(0)
            width = (exact.max(0) - low + 1) / CELLS
            cells = np.floor((exact - low) / width).clip(0, CELLS - 1).astype(np.uint8)
            values = [number, dim, np.array(ids, np.int64).tobytes(), cells.tobytes(), low.tobytes(), width.tobytes(), exact.tobytes()]
            number += 1
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for batch in batches:
            for i, v in zip(batch.column("id"), batch.column("vector")):
                x = integers(v.as_py(), scale)
                ids, vectors = waiting.setdefault(len(x), ([], []))
                ids.append(i.as_py())
                vectors.append(x)
                if len(ids) == rows:
                    yield pack(len(x))
        for dim in list(waiting):
            yield pack(dim)

    return run


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact inner products of integer rows, held in doubles; beyond 64 bits the nearest that fits."""
    most = float(np.abs(x).max(initial=0)) * float(np.abs(y).max(initial=0)) * x.shape[-1]
    if most < _EXACT:
        return (x @ y.T).astype(np.int64)
    if most < 2.0**63:
        return x.astype(np.int64) @ y.astype(np.int64).T
    exact = [[int(c) for c in row] for row in y]
    out = [[max(-_LONG, min(_LONG - 1, sum(int(a) * b for a, b in zip(row, z)))) for z in exact] for row in x]
    return np.array(out, np.int64).reshape(len(x), len(y))


def bounds(queries: np.ndarray, cells: np.ndarray, low: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of all inner products: those of the cells' lower corners, plus each cell's width where it makes them less (or more)."""
    base = (queries * width) @ cells.astype(np.float64).T + (queries @ low)[:, None]
    slack = 1e-9 * np.abs(queries) @ (np.abs(low) + CELLS * width) + 1e-6
    return base + (np.minimum(queries, 0) @ width - slack)[:, None], base + (np.maximum(queries, 0) @ width + slack)[:, None]


def best_of(query: np.ndarray, ids: np.ndarray, upper: np.ndarray, floor: float, exact: np.ndarray, k: int, read: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the vectors that may be among the k best: of upper bounds from ``floor`` on, those not below the kth score.

    Exact vectors are read in the order of their upper bounds, until the kth score is above the next bound.
    """
    candidates = np.flatnonzero(upper >= floor)
    candidates = candidates[np.argsort(-upper[candidates], kind="stable")]
    scores, at, step = np.empty(0, np.int64), 0, max(4 * k, 32)
    while at < len(candidates):
        if len(scores) >= k and np.partition(scores, -k)[-k] > upper[candidates[at]]:
            break
        scores = np.r_[scores, products(exact[candidates[at : at + step]], query[None])[:, 0]]
        at += step
    if read is not None:
        read.append(len(scores))
    found = candidates[: len(scores)]
    order = np.lexsort((ids[found], -scores))[:k]
    return found[order], scores[order]


class Pass:
    """Queries that pass over the file together: by dimension their numbers, ids and vectors."""

    def __init__(self, blocks: list[tuple[int, bytes, bytes]]):
        self.by_dim: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        self.n = 0
        for dim in sorted({b[0] for b in blocks}):
            ids = np.concatenate([np.frombuffer(b[1], np.int64) for b in blocks if b[0] == dim])
            vectors = np.concatenate([np.frombuffer(b[2], np.float64).reshape(-1, dim) for b in blocks if b[0] == dim])
            self.by_dim[dim] = np.arange(self.n, self.n + len(ids)), ids, vectors
            self.n += len(ids)


def _floors(asked, k: int):
    """Scans cells only: for each query the kth best lower bound among a task's vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries: Pass = asked.value
        top = {dim: np.full((len(own[0]), k), -np.inf) for dim, own in queries.by_dim.items()}
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                if dim not in top:
                    continue
                cells, low, width = np.frombuffer(row["cells"], np.uint8).reshape(-1, dim), np.frombuffer(row["low"]), np.frombuffer(row["width"])
                vectors = queries.by_dim[dim][2]
                for at in range(0, len(vectors), QUERIES):
                    lower, _ = bounds(vectors[at : at + QUERIES], cells, low, width)
                    both = np.concatenate([top[dim][at : at + QUERIES], lower], axis=1)
                    top[dim][at : at + QUERIES] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        for dim, (numbers, _, _) in queries.by_dim.items():
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(top[dim].min(1))], ["query", "floor"])

    return run


def _search(asked, least, k: int):
    """Scans cells and, where a bound reaches the query's floor over all vectors, reads exact ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, floors = asked.value, least.value
        for batch in batches:
            for row in batch.to_pylist():
                dim = row["dim"]
                if dim not in queries.by_dim:
                    continue
                ids, cells = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["cells"], np.uint8).reshape(-1, dim)
                low, width, exact = (np.frombuffer(row[c]) for c in ("low", "width", "exact"))
                exact = exact.reshape(-1, dim)
                numbers, own_ids, vectors = queries.by_dim[dim]
                for at in range(0, len(vectors), QUERIES):
                    _, upper = bounds(vectors[at : at + QUERIES], cells, low, width)
                    rows = []
                    for i in np.flatnonzero(upper.max(1) >= floors[numbers[at : at + QUERIES]]):
                        q = at + i
                        place, scores = best_of(vectors[q], ids, upper[i], floors[numbers[q]], exact, k)
                        own = (ids[place] == own_ids[q]) & (exact[place] == vectors[q]).all(1)
                        rows.append((np.full(len(place), numbers[q]), np.full(len(place), own_ids[q]), ids[place], scores, own))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["query", "query_id", "vec_id", "score", "own"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: float = 1024.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` best rows of ``vectors`` for each row of ``queries``: query_id, rank (from 1), vec_id, score.

    Each component x counts as floor(scale * x); the score is the integer inner product. A query's own row, one of
    the same id and vector, is no candidate; ties go to the smaller id, and with fewer than k candidates all are
    returned. Rows whose id or vector is null, or whose vector is empty or holds nulls or non-finite components,
    take no part; vectors meet those of their own dimension. Repeated rows are rows like others: each is asked for
    and found. Empty tables give an empty result; other columns are ignored. Scores beyond 64 bits become the
    nearest that fits.

    Vectors are packed into a file of blocks, which isn't shuffled again. Queries pass over it in portions of
    PASS_BYTES, sent to all workers: one scan of the cells alone gives each query a floor, which k + 1 scores reach;
    another reads exact vectors where the upper bound reaches that floor, in the order of the bounds. What is
    found is little more than k rows a query, ranked with a limit a group.
    """
    spark = vectors.sparkSession

    def usable(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
        return rows.where("id is not null and vector is not null and size(vector) > 0 and forall(vector, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))")

    spec = "number long, dim int, ids binary, cells binary, low binary, width binary, exact binary"

    def packed(df: DataFrame, rows: int) -> DataFrame:
        """Blocks as full as they can be, however many partitions the rows come in."""
        sound = written(usable(df), "sound")
        return written(sound.coalesce(max(1, -(-sound.count() // rows))).mapInArrow(_blocks(scale, rows), spec), "blocks")

    blocks, asked, out = packed(vectors, VECTORS), packed(queries, QUERIES), None
    size = asked.agg(F.sum(F.length("exact"))).first()[0] or 0
    passes = max(1, -(-size // PASS_BYTES))
    for i in range(passes):
        portion = asked.where(F.pmod(F.xxhash64("number"), F.lit(passes)) == i).select("dim", "ids", "exact").collect()
        own = Pass([(r["dim"], r["ids"], r["exact"]) for r in portion])
        # one more than is asked for: the query's own row may be among them
        sent = spark.sparkContext.broadcast(own)
        lower = blocks.select("dim", "cells", "low", "width").mapInArrow(_floors(sent, k + 1), "query long, floor double")
        floors = np.full(own.n, -np.inf)
        for r in lower.groupBy("query").agg(F.max("floor").alias("floor")).collect():
            floors[r["query"]] = r["floor"]
        least = spark.sparkContext.broadcast(floors)
        found = blocks.drop("number").mapInArrow(_search(sent, least, k + 1), "query long, query_id long, vec_id long, score long, own boolean")
        found = written(found, "found").withColumn("pass", F.lit(i))
        out = found if out is None else out.union(found)
    order = W.partitionBy("pass", "query").orderBy(F.desc("score"), "vec_id", F.desc("own"))
    ranked = out.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k + 1)
    # equal rows stand together: the first of them counts as the query's own
    first = F.min(F.when(F.col("own"), F.col("place"))).over(W.partitionBy("pass", "query"))
    ranked = ranked.withColumn("self", F.coalesce(first, F.lit(k + 2))).where(F.col("place") != F.col("self"))
    rank = (F.col("place") - (F.col("place") > F.col("self")).cast("int")).alias("rank")
    return ranked.select("query_id", rank, "vec_id", "score").where(F.col("rank") <= k)


def op8_topk(spark, sf_dir: str) -> DataFrame:
    vectors = plain(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)
