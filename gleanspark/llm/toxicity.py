"""Toxicity by class-conditional Kneser-Ney models of character sequences."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gleanspark.llm.shingles import WordHashes, mix
from gleanspark.llm.store import filesystem, held, new_path, plain, track, written

#: Characters of context at a word's start, where stems are, and inside it; what each seen sequence's count gives up for the unseen.
PREFIX, CONTEXT, DISCOUNT = 9, 4, 0.75
#: Labelled rows that calibrate the score; the counts take all the others.
CALIBRATION_ROWS = 20_000
#: Labels up to this many are sent to every executor; more are joined by a shuffle.
BROADCAST_LABELS = 4_000_000
#: Model entries that a worker keeps in memory (12 bytes each); a larger model is read again, part by part, for each BLOCK of text.
KEPT_ENTRIES = 8_000_000
#: Characters of text whose words are looked up at once, in a model that is kept and in one that isn't.
SLICE, BLOCK = 1 << 20, 64 << 20
#: Words whose ratios a worker remembers.
REMEMBERED = 450_000
#: The share of a toxic document's expressions that the toxic model gives, and the most that one expression can count.
SHARE, MOST = 0.01, 6.0
FEATURES = ["f0", "f1", "f2"]
_KINDS = ", ".join(f"{f} double" for f in FEATURES)
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def grams(word: str) -> list[tuple[str, str]]:
    """(context, character) of each character of ``word`` and of its end; the word's start is ^, its end $.

    The context is all that precedes, up to PREFIX characters, then the last CONTEXT ones.
    """
    return list(zip(contexts_of(word), f"{word}$"))


def contexts_of(word: str) -> list[str]:
    w = f"^{word}"
    return [w[:i] for i in range(1, min(PREFIX, len(w)) + 1)] + [w[i - CONTEXT : i] for i in range(PREFIX + 1, len(w) + 1)]


def _tail() -> Column:
    """The context that a context backs off to: its last characters, fewer than CONTEXT and than it has."""
    return F.right("context", F.least(F.length("context") - 1, F.lit(CONTEXT - 1)))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def out() -> pa.RecordBatch:
        names = list({**counts[0], **counts[1]})
        batch = pa.RecordBatch.from_arrays([pa.array(names), *(pa.array([c[w] for w in names], pa.int64()) for c in counts)], ["word", "ordinary", "toxic"])
        for c in counts:
            c.clear()
        return batch

    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic")):
            counts[toxic.as_py()].update(words_of(text.as_py()))
            if len(counts[0]) + len(counts[1]) > 300_000:
                yield out()
    yield out()


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total: dict[tuple[str, str], list[int]] = {}
        for word, ordinary, toxic in zip(*(batch.column(c).to_pylist() for c in ("word", "ordinary", "toxic"))):
            for g in grams(word):
                t = total.setdefault(g, [0, 0])
                t[0] += ordinary
                t[1] += toxic
        context, char = zip(*total) if total else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(context, pa.string()), pa.array(char, pa.string()), *(pa.array([t[i] for t in total.values()], pa.int64()) for i in (0, 1))], ["context", "char", "ordinary", "toxic"])


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(context, char, llr): log P(char | context) of the toxic model less that of the ordinary one.

    ``counts`` has (context, char, ordinary, toxic). Both models discount their own counts and back off to one
    shared distribution for the end of the context, estimated from the number of different contexts
    that a character follows in either class, and so on down to none. char is null for what is unseen after a
    context: there the shared probability is the same for both, and the weights of backing off remain.
    """
    lower: dict[int, DataFrame] = {}
    upper = counts.select("context", "char")
    levels = written(upper, "events")
    for n in range(CONTEXT - 1, -1, -1):
        # what backs off to contexts of n characters: all longer ones at the top, else those one longer
        above = levels.where(F.length("context") > n)
        level = above.groupBy(_tail().alias("context"), "char").agg(F.count(F.lit(1)).alias("n"))
        lower[n] = level = written(level, f"level{n}")
        levels = written(counts.where(F.length("context") == n).select("context", "char").union(level.select("context", "char")), "events") if n else level
    shared = None
    for n in range(CONTEXT):
        level = lower[n]
        whole = level.groupBy("context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        level = level.join(whole, "context")
        if shared is None:
            spread = level.groupBy().agg(F.count(F.lit(1)).alias("all")).first()["all"] or 1
            below = F.lit(1.0 / spread)
        else:
            level = level.join(shared.select(F.col("context").alias("tail"), "char", F.col("p").alias("below")), (_tail() == F.col("tail")) & (level["char"] == shared["char"])).drop("tail").drop(shared["char"])
            below = F.col("below")
        p = (F.col("n") - DISCOUNT + DISCOUNT * F.col("kinds") * below) / F.col("total")
        level = written(level.select("context", "char", p.alias("p")), f"shared{n}")
        shared = level if shared is None else shared.unionByName(level)
    whole = counts.groupBy("context").agg(*(f(c).alias(f"{c}_{name}") for c in ("ordinary", "toxic") for name, f in (("total", F.sum), ("kinds", lambda c: F.count_if(F.col(c) > 0)))))
    tails = shared.select(F.col("context").alias("tail"), F.col("char").alias("_char"), "p")
    seen = counts.join(whole, "context").join(tails, (_tail() == F.col("tail")) & (F.col("char") == F.col("_char")))

    def weight(c: str):
        return F.when(F.col(f"{c}_total") > 0, DISCOUNT * F.col(f"{c}_kinds") / F.nullif(F.col(f"{c}_total"), F.lit(0))).otherwise(1.0)

    def log_p(c: str):
        own = F.when(F.col(f"{c}_total") > 0, F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) / F.nullif(F.col(f"{c}_total"), F.lit(0))).otherwise(0.0)
        return F.log(own + weight(c) * F.col("p"))

    known = seen.select("context", "char", (log_p("toxic") - log_p("ordinary")).alias("llr"))
    unseen = whole.select("context", F.lit(None).cast("string").alias("char"), (F.log(weight("toxic")) - F.log(weight("ordinary"))).alias("llr"))
    return known.union(unseen)


class Model:
    """Looks up words' log-likelihood ratios in the sorted model files that all workers share."""

    def __init__(self, path: str):
        import pyarrow.fs as fs

        self.files, root = filesystem(path)
        self.paths = sorted(f.path for f in self.files.get_file_info(fs.FileSelector(root)) if f.path.endswith(".parquet"))
        self.forget()
        parts, n = [], 0
        for part in self.parts():
            n += len(part[0])
            if n > KEPT_ENTRIES:
                parts = None
                break
            parts.append(part)
        self.kept = parts

    def forget(self) -> None:
        self.words: dict[str, int] = {}
        #: By a word's number: its log-likelihood ratio, and what that says of the document it stands in.
        self.ratios, self.evidence = np.empty(0), np.empty(0)

    def parts(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(keys ascending, ratios) of each row group."""
        import pyarrow.parquet as pq

        for path in self.paths:
            with self.files.open_input_file(path) as f:
                groups = pq.ParquetFile(f)
                for i in range(groups.num_row_groups):
                    t = groups.read_row_group(i, columns=["key", "llr"])
                    yield t.column("key").to_numpy(), t.column("llr").to_numpy()

    def learn(self, words: set[str]) -> None:
        """Remembers the ratios of ``words``: summed over their characters, an unseen one taking its context's."""
        new = [w for w in words if w not in self.words]
        if new and len(self.words) + len(new) > REMEMBERED:
            self.forget()
            new = list(words)
        if not new:
            return
        contexts = np.fromiter((CONTEXT_HASHES[c] for w in new for c in contexts_of(w)), np.uint64)
        sizes = np.fromiter(map(len, new), np.int64, len(new)) + 1
        chars = np.frombuffer(("$".join(new) + "$").encode("utf-32-le", "surrogatepass"), np.uint32)
        full, short = keys_of(contexts, chars), keys_of(contexts, np.full(len(chars), UNSEEN, np.uint32))
        wanted, back = np.unique(np.concatenate([full, short]), return_inverse=True)
        values = np.full(len(wanted), np.nan, np.float64)
        for keys, ratios in self.kept if self.kept is not None else self.parts():
            if len(keys):
                a, b = np.searchsorted(wanted, [keys[0], keys[-1] + 1 if keys[-1] < 2**63 - 1 else keys[-1]])
                at = np.minimum(np.searchsorted(keys, wanted[a:b]), len(keys) - 1)
                values[a:b] = np.where(keys[at] == wanted[a:b], ratios[at], values[a:b])
        known, context = values[back[: len(full)]], values[back[len(full) :]]
        llr = np.where(np.isnan(known), np.where(np.isnan(context), 0.0, context), known)
        whole = np.add.reduceat(llr, np.r_[0, np.cumsum(sizes)[:-1]])
        self.words.update(zip(new, range(len(self.ratios), len(self.ratios) + len(new))))
        self.ratios = np.r_[self.ratios, whole]
        self.evidence = np.r_[self.evidence, np.log1p(SHARE * np.expm1(np.clip(whole, -20, MOST)))]

    def features(self, words: list[str]) -> tuple[float, ...]:
        """Log-likelihood ratios, normalised by length: of all expressions being toxic, for each character; of SHARE of them, for the root of their number. And its log."""
        if not words:
            return (0.0,) * len(FEATURES)
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        size = sum(map(len, words)) + len(words)
        return float(self.ratios[at].sum()) / size, float(self.evidence[at].sum()) / math.sqrt(len(words)), math.log(len(words))


#: Stands for all characters unseen after a context.
UNSEEN = 0x110000
#: Hashes of contexts, which recur in most words.
CONTEXT_HASHES = WordHashes()


def keys_of(contexts: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Keys of (hash of context, character)."""
    return mix(contexts + chars.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        contexts = np.fromiter((CONTEXT_HASHES[c] for c in batch.column("context").to_pylist()), np.uint64, batch.num_rows)
        chars = np.fromiter((UNSEEN if x is None else ord(x) for x in batch.column("char").to_pylist()), np.uint32, batch.num_rows)
        yield pa.RecordBatch.from_arrays([pa.array(keys_of(contexts, chars)), batch.column("llr").cast(pa.float32())], ["key", "llr"])


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of the batch with about ``most`` characters of text each."""
    start = size = 0
    for at, text in enumerate(batch.column("text")):
        size += len(text.as_py() or "")
        if size >= most:
            yield batch.slice(start, at + 1 - start)
            start, size = at + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _features(path: str, with_text: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held(("toxicity", path), lambda: Model(path))
        for block in (x for b in batches for x in _slices(b, BLOCK)):
            if model.kept is None:
                distinct: set[str] = set()
                for text in block.column("text"):
                    distinct.update(words_of(text.as_py()))
                model.learn(distinct)
            for part in _slices(block, SLICE):
                texts = [words_of(t.as_py()) for t in part.column("text")]
                if model.kept is not None:
                    model.learn(set().union(*texts))
                rows = list(map(model.features, texts))
                names = [c for c in part.schema.names if with_text or c != "text"]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), *(pa.array(x, pa.float64()) for x in zip(*rows))], names + FEATURES)

    return run


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, spread and weights (the last one constant) of a logistic regression, by Newton's method; classes weigh alike in the mean of their shares."""
    mean, spread = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / spread, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        gradient = z.T @ (p - y) + penalty * np.r_[w[:-1], 0]
        hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag([penalty] * (len(w) - 1) + [1e-6])
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, spread, w


def fold(id_col: str = "id"):
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(5))


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of ``docs``: its id, held_out, score (0 to 1), predicted (1 from a score of 0.5 on), then ``keep``.

    Labels are learnt only outside fold 0 of five by the CRC-32 of the id as text. Folds 2 to 4 give the counts of
    two Kneser-Ney models over the characters of words, one for each class, which share their backoff; the score
    is a logistic function of length-normalised log-likelihood ratios, calibrated on fold 1 (of which at most
    CALIBRATION_ROWS rows, those of least hash). Counts cover all labelled rows of their folds and grow with them.

    Null and empty texts have no words and get the score of none. Labels with a null id or value are left out; a
    document labelled twice is toxic if any label says so. A null id counts as empty text in the fold, is never
    labelled, and repeated rows are scored alike. Without labels of both classes every score is 0. An empty table
    gives an empty result; other columns are ignored.
    """
    spark: SparkSession = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), *(F.col(f"`{c}`").alias(f"keep_{i}") for i, c in enumerate(keep) if c != text_col))
    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{toxic_col}`").cast("int").alias("toxic")).dropna().where(fold() > 0)
    marks = written(marks.groupBy("id").agg(F.max("toxic").alias("toxic")).where("toxic in (0, 1)"), "labels")
    marks = F.broadcast(marks) if marks.count() <= BROADCAST_LABELS else marks
    marked = source.select("id", "text").join(marks, "id")

    counted = marked.where(fold() > 1).select("text", "toxic").mapInArrow(_count_words, "word string, ordinary long, toxic long")
    words = written(counted.groupBy("word").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "words")
    pairs = words.mapInArrow(_count_grams, "context string, char string, ordinary long, toxic long")
    counts = written(pairs.groupBy("context", "char").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic")), "grams")
    path = track(spark, new_path(spark, "model"))
    model = kneser_ney(counts).mapInArrow(_keys, "key long, llr float")
    model.repartitionByRange("key").sortWithinPartitions("key").write.option("compression", "zstd").parquet(path)

    calibration = marked.where(fold() == 1).select("id", "text", "toxic").mapInArrow(_features(path), f"id {source.schema['id'].dataType.simpleString()}, toxic int, {_KINDS}")
    rows = calibration.orderBy(F.xxhash64("id"), "id").limit(CALIBRATION_ROWS).select("toxic", *FEATURES).toPandas()
    with_text = text_col in keep
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema if with_text or f.name != "text")
    features = source.mapInArrow(_features(path, with_text), f"{kinds}, {_KINDS}")
    if rows["toxic"].nunique() < 2:
        score = F.lit(0.0)
    else:
        mean, spread, w = logistic(rows[FEATURES].to_numpy(), rows["toxic"].to_numpy(float))
        z = sum((F.col(f) - float(mean[i])) / float(spread[i]) * float(w[i]) for i, f in enumerate(FEATURES)) + float(w[-1])
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-700.0), F.least(F.lit(700.0), z))))
    out = features.select(F.col("id").alias(id_col), (fold() == 0).alias("held_out"), score.alias("score"), *(F.col("text" if c == text_col else f"keep_{i}").alias(c) for i, c in enumerate(keep)))
    return out.select(id_col, "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *keep)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    return score_toxicity(docs, plain(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "toxic"))
