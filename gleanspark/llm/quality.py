"""Quality rules whose cutoffs are certified on labelled documents to reject few good ones."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gleanspark.llm.shingles import WordHashes, mix
from gleanspark.llm.store import plain, written

#: Symbols that count, and the least number of words.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 50
_CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
_SPACES = b" \t\n\x0b\x0c\r"

#: What a rule measures; more is worse. Cutoffs tried are STEP ** -i of the loosest.
RULES = {
    "symbols": "n_symbols / greatest(n_words, 1)",
    "capitals": "n_capitals / greatest(word_chars, 1)",
    "shouts": "n_shouts / greatest(n_words, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "lines": "n_dup_lines / greatest(n_lines, 1)",
    "lengths": "word_chars / greatest(n_words, 1) / 100",
}
STEP, CUTOFFS = 1.25, 28
#: Rejected bad documents that outweigh one good one.
LOSS = 10
#: Of five parts of the labels, by a hash of the id, so many show how to tighten cutoffs; the others certify.
TUNING = 2
#: How many good and bad ones a stratum needs for its own way of tightening.
OWN_GOOD, OWN_BAD = 30, 8
#: Rows of the histogram of levels that the driver takes; a longer one stays where it is and is summed up for each step.
HISTOGRAM_ROWS = 100_000


def counts_of(text: str | None, words: WordHashes) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_capitals, n_shouts, n_lines."""
    b = (text or "").encode("utf-8", "surrogatepass")
    parts = b.split()
    n, repeated = len(parts), 0
    if n > 3:
        h = np.fromiter((words[w] for w in parts), np.uint64, n)
        windows = mix(mix(mix(h[:-2]) + h[1:-1]) + h[2:])
        _, kind, times = np.unique(windows, return_inverse=True, return_counts=True)
        twice = np.r_[times[kind] > 1, False, False]
        repeated = int((twice | np.r_[False, twice[:-1]] | np.r_[False, False, twice[:-2]]).sum())
    seen: set[bytes] = set()
    lines = [x for x in b.split(b"\n") if x.strip(_SPACES)]
    dup = 0
    for line in lines:
        dup += line in seen
        seen.add(line)
    less = lambda drop: len(b) - len(b.translate(None, drop))
    return n, len(text or "") - less(_SPACES), less(SYMBOLS), dup, repeated, less(_CAPITALS), b.count(b"!"), len(lines)


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_capitals", "n_shouts", "n_lines")


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in batches:
        rows = [counts_of(t.as_py(), words) for t in batch.column("text")]
        columns = [pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * len(_NAMES))]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("stratum"), *columns], ["id", "stratum", *_NAMES])


def upper_bound(failures: int, n: int, delta: float) -> float:
    """Clopper-Pearson: the rate at which so few failures among n have probability ``delta``; exact, by bisection."""
    if n == 0 or failures >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(failures + 1)]

    def tail(p: float) -> float:
        a, b = math.log(p), math.log1p(-p)
        return math.fsum(math.exp(c + i * a + (n - i) * b) for i, c in enumerate(logs))

    low, high = failures / n, 1.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if tail(min(max(middle, 1e-300), 1 - 1e-16)) > delta else (low, middle)
    return high


Marginals = Callable[[list[int]], tuple[np.ndarray, np.ndarray]]


def steps_of(marginals: Marginals) -> list[tuple[int, ...]]:
    """Cutoffs of all rules at once, from loose to ever stricter ones: each a level by rule, -1 for none.

    ``marginals`` gives for the cutoffs so far how many bad and good documents that these leave have which level, by
    rule; a level is the loosest that rejects the document, CUTOFFS stands for none. Each step tightens one rule, to
    where it rejects the most bad documents more, less LOSS times the good ones, until none is left to reject.
    """
    at, out = [-1] * len(RULES), []
    while True:
        bad, good = (x[:, :CUTOFFS].cumsum(axis=1) for x in marginals(at))
        best = None
        for r in range(len(RULES)):
            for level in range(at[r] + 1, CUTOFFS):
                gain = (bad[r, level] - LOSS * good[r, level], -level)
                if bad[r, level] and (best is None or gain > best[0]):
                    best = gain, r, level
        if best is None:
            return out
        _, r, level = best
        at[r] = level
        out.append(tuple(at))


def way(levels: np.ndarray, good: np.ndarray, times: np.ndarray | None = None) -> list[tuple[int, ...]]:
    """``steps_of`` documents with these levels by rule, each row standing for so many of them (1 unless given)."""
    times = np.ones(len(good), np.int64) if times is None else times

    def marginals(at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((2, len(RULES), CUTOFFS + 1), np.int64)
        left = (levels > np.array(at)).all(axis=1)
        for r in range(len(RULES)):
            np.add.at(out, (good[left].astype(int), r, levels[left, r]), times[left])
        return out[0], out[1]

    return steps_of(marginals)


def _summed(shown: DataFrame) -> Marginals:
    """Marginals of a histogram (good, times, levels by rule) that stays distributed."""

    def marginals(at: list[int]) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((2, len(RULES), CUTOFFS + 1), np.int64)
        left = shown.where(F.forall(F.array(*(F.col(r) > level for r, level in zip(RULES, at))), lambda x: x))
        cells = left.select("good", "times", F.posexplode(F.array(*RULES)).alias("rule", "level"))
        for x in cells.groupBy("good", "rule", "level").agg(F.sum("times").alias("n")).collect():
            out[int(x["good"]), x["rule"], x["level"]] = x["n"]
        return out[0], out[1]

    return marginals


def ways_of(shown: DataFrame, strata: list[str]) -> dict[str, list[tuple[int, ...]]]:
    """The way of each stratum by all documents of ``shown`` (stratum, good, levels by rule); one with few takes that over all strata."""
    histogram = written(shown.groupBy("stratum", "good", *RULES).agg(F.count(F.lit(1)).alias("times")), "histogram")
    own = {s: [0, 0] for s in strata}
    for x in histogram.where(F.col("stratum").isin(strata)).groupBy("stratum", "good").agg(F.sum("times").alias("n")).collect():
        own[x["stratum"]][x["good"]] = x["n"]
    if histogram.count() <= HISTOGRAM_ROWS:
        rows = histogram.toPandas()
        levels, good, whose, times = rows[list(RULES)].to_numpy(int), rows["good"].to_numpy(bool), rows["stratum"].to_numpy(), rows["times"].to_numpy(np.int64)
        of = lambda at: way(levels[at], good[at], times[at])
        one, whole = lambda s: of(whose == s), lambda: of(slice(None))
    else:
        one = lambda s: steps_of(_summed(histogram.where(F.col("stratum") == s)))
        whole = lambda: steps_of(_summed(histogram))
    few = [s for s in strata if own[s][1] < OWN_GOOD or own[s][0] < OWN_BAD]
    shared = whole() if few else []
    return {s: shared if s in few else one(s) for s in strata}


def certified(good: dict[int, int], steps: int, alpha: float, delta: float) -> int | None:
    """The last step whose rate of false rejections is certified to be at most ``alpha``; None if not even the first is.

    ``good[i]`` counts good documents that step i is the first to reject (``steps``: none does). Steps are tested in
    order until one fails, so no correction among them is needed.
    """
    n, rejected, best = sum(good.values()), 0, None
    for step in range(steps):
        rejected += good.get(step, 0)
        if upper_bound(rejected, n, delta) > alpha:
            break
        best = step
    return best


def chosen(good: dict[int, int], bad: dict[int, int], last: int | None) -> int | None:
    """The first of the certified steps at which rejected bad documents, less LOSS times the good ones, are most.

    A step before a certified one is certified as well, so this spends less of what may be rejected.
    """
    if last is None:
        return None
    best, value, most = 0, 0, -math.inf
    for step in range(last + 1):
        value += bad.get(step, 0) - LOSS * good.get(step, 0)
        if value > most:
            best, most = step, value
    return best


def level_of(measure: Column) -> Column:
    """The loosest cutoff that rejects the measure; cutoff i is STEP ** -i, CUTOFFS stands for none."""
    return F.least(F.lit(CUTOFFS), F.greatest(F.lit(0), F.ceil(-F.log(F.greatest(measure, F.lit(1e-9))) / math.log(STEP)))).cast("int")


def tuning(id_col: str = "id") -> Column:
    """Whether a label shows how to tighten cutoffs; the others certify them."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) < TUNING


def quality(docs: DataFrame, labels: DataFrame, alpha: float = 0.05, delta: float = 0.05, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang", good_col: str = "quality") -> DataFrame:
    """One row per row of ``docs``: its id, the base counts, base_failed, kept, failed_rules.

    A document fails the base with fewer than 50 words or with more than half of them in repeated 3-word windows.
    Others are kept unless a rule's measure exceeds its stratum's cutoff. With probability 1 - ``delta``, in every
    stratum at once, at most a share ``alpha`` of good documents that pass the base is rejected by the rules: some
    labels show in which order to tighten all rules' cutoffs (``way``; by stratum, or over all where a stratum has
    few); on the other, held-out labels, exact binomial bounds test these steps from the loosest on, each stratum
    with an equal share of delta (Bonferroni). Of the certified steps the one that tells labelled good and bad
    apart best is taken (``chosen``). A stratum with too few labels to certify a step rejects nothing: at the
    defaults and four strata, fewer than 86 good ones.

    Null texts have no words and fail the base. A null stratum is one of its own. Labels with a null id or value
    are left out, and a document labelled twice is good if all its labels say so. Repeated rows are judged alike;
    empty tables give an empty result; other columns are ignored. All labels of documents that pass the base count.
    Only histograms of strata, rules and levels reach the driver, that of the joint levels of all rules if it is
    short, else its sums for each step.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"), F.coalesce(F.col(f"`{stratum_col}`").cast("string"), F.lit("")).alias("stratum"))
    id_type = source.schema["id"].dataType.simpleString()
    counts = written(source.mapInArrow(_measure, f"id {id_type}, stratum string, " + ", ".join(f"{c} long" for c in _NAMES)), "counts")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))

    marks = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{good_col}`").alias("good")).dropna().groupBy("id").agg((F.min("good") == 1).alias("good"))
    marked = written(counts.where(~failed).join(marks, "id").select("id", "stratum", "good", *(level_of(F.expr(m)).alias(r) for r, m in RULES.items())), "marked")
    # fewer held-out labels can certify nothing: their bound is over alpha even without failures
    held = marked.where(~tuning())
    strata = sorted(r["stratum"] for r in held.where("good").groupBy("stratum").count().where(F.col("count") >= math.ceil(1 / alpha)).select("stratum").collect())
    ways = ways_of(marked.where(tuning()), strata)
    steps = docs.sparkSession.createDataFrame([(s, i, *step) for s, w in ways.items() for i, step in enumerate(w)], "stratum string, step int, " + ", ".join(f"at_{r} int" for r in RULES))
    # bounded by the strata that have labels: at most as many steps each as there are cutoffs
    steps = steps.groupBy("stratum").agg(F.sort_array(F.collect_list(F.struct("step", *(f"at_{r}" for r in RULES)))).alias("steps"))
    first = F.filter("steps", lambda s: F.greatest(*(s[f"at_{r}"] - F.col(r) for r in RULES)) >= 0)
    counted = held.join(steps, "stratum").select("stratum", "good", F.coalesce(F.get(first, F.lit(0))["step"], F.lit(-1)).alias("step"))
    good: dict[str, dict[int, int]] = {s: {} for s in strata}
    bad: dict[str, dict[int, int]] = {s: {} for s in strata}
    for r in counted.groupBy("stratum", "good", "step").count().collect():
        (good if r["good"] else bad)[r["stratum"]][len(ways[r["stratum"]]) if r["step"] < 0 else r["step"]] = r["count"]
    share = delta / max(1, len(strata))
    found = {s: chosen(good[s], bad[s], certified(good[s], len(ways[s]), alpha, share)) for s in strata}
    rows = [(s, *(None if i is None or ways[s][i][r] < 0 else STEP ** -ways[s][i][r] for r in range(len(RULES)))) for s, i in found.items()]
    cutoffs = docs.sparkSession.createDataFrame(rows, "stratum string, " + ", ".join(f"cut_{r} double" for r in RULES))
    if len(rows) <= 10_000:
        cutoffs = F.broadcast(cutoffs)
    judged = counts.join(cutoffs, "stratum", "left")
    wrong = F.filter(F.array(*(F.when(F.expr(m) > F.col(f"cut_{r}") * (1 + 1e-12), F.lit(r)) for r, m in RULES.items())), lambda x: x.isNotNull())
    judged = judged.withColumn("base_failed", failed).withColumn("failed_rules", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(wrong))
    return judged.select(
        F.col("id").alias(id_col), *_NAMES[:5], "base_failed", (~F.col("base_failed") & (F.size("failed_rules") == 0)).alias("kept"), F.array_join("failed_rules", ",").alias("failed_rules")
    )


def op3_quality(spark, sf_dir: str) -> DataFrame:
    docs = plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang")
    return quality(docs, plain(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id", "quality"))
