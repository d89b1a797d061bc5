"""Packing of tokenised documents into sequences by cutting-stock column generation."""

from __future__ import annotations

import contextlib
import itertools
import json
import re
import string
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleanspark.llm.store import KEY, held, plain, ranked, row_key, written

#: The token after each document.
END = 1
#: Chunks whose ids a worker remembers, and characters of a text that is held whole against the library.
REMEMBERED, CHECKED = 400_000, 20_000
#: How near to the least number of padded tokens a plan must be proven to be.
GAP = 0.002
#: How often new patterns are priced before the solution is rounded.
TURNS = 30


class Spelling(dict):
    """Characters as byte-level vocabularies spell their bytes."""

    def __init__(self, visible: dict[int, int]):
        self.visible = visible

    def __missing__(self, c: str) -> str:
        self[c] = c.encode().decode("latin-1").translate(self.visible)
        return self[c]


class Encoder(dict):
    """Ids of texts by the ``tokenizers`` library, as little-endian bytes; remembers those of ``remembered`` chunks, and asks once for each word.

    A byte-level vocabulary splits a text into words by one pattern and encodes each alone. No word goes on from a
    character that isn't white into white space, so a text is cut there into chunks, and what holds of their words
    holds for texts. The pattern's classes of characters are taken from the library too: a text with a character
    that it puts elsewhere than ``regex`` does goes to the library whole, as do all texts of files of another kind.

    Keys are what follows a space, if it has none itself; a chunk that begins with a line feed, as it is; after a
    space, any other string. The value is None where a chunk ends in white space, so that the next belongs to it,
    or if only the library can tell.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        import regex
        from tokenizers import Tokenizer

        self.own, self.remembered = Tokenizer.from_file(path), remembered
        self.older: dict[str, bytes | None] = {}
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        split, added = model["pre_tokenizer"] or {}, model["added_tokens"]
        self.by_words = split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"] and not model["normalizer"] and not model["truncation"] and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip", "normalized")) and not any(c.isspace() for t in added for c in t["content"])
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        self.added = {t["content"] for t in added}
        # fixed values: bytes that byte-level vocabularies spell as themselves; the others follow from 256 on, in order
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.spelt, self.tokenize = Spelling({b: 256 + i for i, b in enumerate(x for x in range(256) if x not in plain)}), self.own.model.tokenize
        # fixed values: the splitting pattern of byte-level vocabularies; for ASCII alone it needs no Unicode classes
        self.pattern = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
        self.ascii = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
        # where no character but ASCII digits is a number, the classes of ``re`` will do, which are faster to match
        self.plain = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")
        self.numbers: set[str] = set(map(chr, (0x1C, 0x1D, 0x1E, 0x1F)))
        self.classes = [(regex.compile(c), x) for c, x in ((r"\p{L}", "a"), (r"\p{N}", "1"), (r"[^\s\p{L}\p{N}]", "."))]
        self.white: set[str] = set()
        self.letters: set[str] = set()
        self.sound: set[str] = set()
        self.odd: set[str] = set()
        self.learn_classes(set(map(chr, range(128))))
        self.ascii_odd = frozenset(self.odd)
        self.marks = "".join(c for c in string.punctuation if c in self.sound)
        self.learn_classes({c for t in self.added for c in t} - self.sound - self.odd)
        # added tokens that may lie in letters and marks after them
        self.hidden = any(self.letters.issuperset(t.rstrip(self.marks)) for t in self.added)

    def learn_classes(self, characters: set[str]) -> None:
        for c in characters:
            ours = [bool(k.match(c)) for k, _ in self.classes]
            theirs = [len(self.own.pre_tokenizer.pre_tokenize_str(x + c)) == 1 for _, x in self.classes]
            (self.sound if theirs == ours else self.odd).add(c)
            if not any(ours):
                self.white.add(c)
            if ours[0] and theirs == ours:
                self.letters.add(c)
            if theirs != [c.isalpha(), "0" <= c <= "9", not c.isalnum() and not c.isspace()]:
                self.numbers.add(c)

    def words(self, text: str) -> list[str] | None:
        """The words of a text, None if only the library can tell."""
        if not self.by_words:
            return None
        if text.isascii():
            if self.ascii_odd and not self.ascii_odd.isdisjoint(text):
                return None
            pattern = self.ascii
        else:
            characters = set(text)
            self.learn_classes(characters - self.sound - self.odd)
            if self.odd and not self.odd.isdisjoint(characters):
                return None
            pattern = self.plain if self.numbers.isdisjoint(characters) else self.pattern
        if self.special is None or not self.special.search(text):
            return pattern.findall(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += [*pattern.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + pattern.findall(text[at:])

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.own.encode_batch_fast(texts, add_special_tokens=False)]

    def __missing__(self, key: str) -> bytes | None:
        ids = self.older.pop(key, None)
        if not ids:
            # most are letters, and marks after them
            letters = key.rstrip(self.marks)
            if not letters or not self.letters.issuperset(letters) or self.hidden and self.special.search(key):
                ids = self.learn(key)
            elif letters == key:
                ids = self.ask(" " + key)
            else:
                known, ids = letters in self, self[letters] + self[" " + key[len(letters) :]]
                if not known:  # most new words don't come again with the same marks
                    return ids
        if len(self) >= self.remembered // 2:
            self.older = self.copy()
            self.clear()
        self[key] = ids
        return ids

    def ask(self, word: str) -> bytes:
        """Asks the library's model for the ids of a word, spelt as it spells bytes."""
        spelt = self.spelt[" "] + word[1:] if word[0] == " " and word.isascii() and word[1:].isalpha() else "".join(map(self.spelt.__getitem__, word))
        return array("I", [t.id for t in self.tokenize(spelt)]).tobytes()

    def learn(self, key: str) -> bytes | None:
        text = key[1:] if key[:1] == " " else key if key[:1] == "\n" else " " + key
        words = self.words(text)
        if words is None or key[:1] != " " and text[-1] in self.white:
            return None
        if len(words) == 1:
            return self.library(words)[0] if words[0] in self.added else self.ask(words[0])
        # a first word after a space is what the chunk of this word alone is
        return b"".join([self[w[1:] if w[0] == " " and len(w) > 1 and w[1] not in self.white else " " + w] for w in words])

    def by_chunks(self, text: str) -> bytes | None:
        """Ids of a text, None if only the library can tell."""
        body = text.rstrip(" \n")
        first, *chunks = body.replace("\n", " \n").split(" ")
        with contextlib.suppress(TypeError):  # None among the bytes
            ids = self[" " + first] + b"".join(map(self.__getitem__, chunks)) + self[" " + text[len(body) :]]
            if first[-1:] not in self.white:
                return ids
        if self.words(text) is None:
            return None
        # chunks that end in white space go with the next
        run, keys = (first, []) if first[-1:] in self.white else ("", [" " + first])
        for chunk in chunks:
            part = chunk if chunk[:1] == "\n" else " " + chunk
            if part[-1] in self.white:
                run += part
            else:
                keys.append(" " + run + part if run else chunk)
                run = ""
        return b"".join(map(self.__getitem__, [*keys, " " + run + text[len(body) :]]))

    def encode(self, texts: list[str]) -> list[bytes]:
        out = list(map(self.by_chunks, texts)) if self.by_words else [None] * len(texts)
        whole = iter(self.library([t for t, ids in zip(texts, out) if ids is None]))
        out = [next(whole) if ids is None else ids for ids in out]
        # one text of each call, whichever, is held whole against the library, so that another version can't go unnoticed
        if texts:
            i = sum(map(len, texts)) % len(texts)
            if len(texts[i]) < CHECKED and self.library([texts[i]])[0] != out[i]:
                raise ValueError(f"the tokenizers library encodes {texts[i][:80]!r} otherwise")
        return out


def encoder(path: str, remembered: int = REMEMBERED) -> Encoder:
    return held(("tokenizer", path, remembered), lambda: Encoder(path, remembered))


def _pieces(path: str, size: int, remembered: int):
    half = size // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, values = [], []
                for i, ids in enumerate(encoder(path, remembered).encode([t or "" for t in part.column("text").to_pylist()])):
                    ids += END.to_bytes(4, "little")
                    for start in range(0, len(ids), 4 * size):
                        piece = ids[start : start + 4 * size]
                        # only what is longer than half a sequence may be halved
                        crc = zlib.crc32(piece), *(map(zlib.crc32, (piece[: 4 * half], piece[4 * half :])) if len(piece) > 4 * half else (0, 0))
                        rows.append(i)
                        values.append((start // 4, len(piece) // 4, *crc, len(ids) // 4))
                columns = [pa.array(x, pa.int64()) for x in (zip(*values) if values else [[]] * 6)]
                rows = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id").take(rows), part.column("key").take(rows), *columns], ["id", "key", "start", "length", "crc", "crc_first", "crc_rest", "doc_tokens"])

    return run


def padded(fill: int, size: int) -> int:
    """Length of a sequence with ``fill`` tokens: ``size``, but a power of two needs no padding."""
    return fill if fill and not fill & (fill - 1) else size


def price(duals: np.ndarray, size: int, most: int = 200) -> tuple[list[dict[int, int]], float]:
    """Patterns that gain most or lose least, of each length at most one that has it: a knapsack over fills, each fill at the cost of its padded length.

    Also the most that any pattern is worth, for its cost.
    """
    best, last = np.full(size + 1, -np.inf), np.zeros(size + 1, np.int64)
    best[0] = 0
    worth = np.flatnonzero(duals > 1e-12)
    gain = duals[worth]
    for fill in range(1, size + 1):
        k = np.searchsorted(worth, fill, "right")
        if k:
            options = best[fill - worth[:k]] + gain[:k]
            i = int(np.argmax(options))
            best[fill], last[fill] = options[i], worth[i]
    costs = np.array([padded(f, size) for f in range(size + 1)], float)
    worth_most = float((best[1:] / costs[1:]).max())
    # the best fill up to each, and with it the best pattern around one item of each length
    top = np.maximum.accumulate(best)
    at = np.maximum.accumulate(np.where(best == top, np.arange(size + 1), 0))
    found = [(gain[i] + top[size - x] - size, int(x), int(at[size - x])) for i, x in enumerate(worth)]
    found += [(best[f] - costs[f], 0, f) for f in range(1, size) if costs[f] < size and np.isfinite(best[f])]
    out, seen = [], set()
    for _, x, fill in sorted(found, reverse=True)[:most]:
        pattern: dict[int, int] = {x: 1} if x else {}
        while fill:
            pattern[int(last[fill])] = pattern.get(int(last[fill]), 0) + 1
            fill -= int(last[fill])
        key = tuple(sorted(pattern.items()))
        if key not in seen:
            seen.add(key)
            out.append(pattern)
    return out, worth_most


def cutting_stock(counts: dict[int, int], size: int, gap: float = GAP) -> tuple[dict[int, int], list[tuple[dict[int, int], int]]]:
    """How many items of each length to halve, and patterns of lengths with how often to use each.

    Every item of the histogram ``counts`` is placed once. An item longer than half of ``size`` may be cut there:
    its first half is a sequence without padding (``size`` being a power of two), its rest an item like others.

    Column generation: the restricted linear program over the columns so far is solved by the revised simplex
    method, its duals price new patterns by a knapsack dynamic program and the cuts. After every TURNS times of
    pricing the solution is rounded: patterns that need little padding are used as often as it says, rounded down, and
    what is left over is packed by fills, largest first. This goes on until no column gains or the solution stands
    still, or the rounded plan is proven to be within ``gap``, or one sequence, of the least there can be: the items'
    sum is a bound from below, as are the duals divided by the most that any column is worth, for its cost.
    """
    half = size // 2
    lengths = sorted(set(counts) | {x - half for x in counts if x > half})
    need = np.array([counts.get(x, 0) for x in lengths], float)
    at = {x: i for i, x in enumerate(lengths)}
    long = [x for x in counts if x > half]
    # each length alone, as often as it fits, is the first basis
    basis = [{x: size // x} for x in lengths]
    inverse = np.diag([1.0 / (size // x) for x in lengths])
    cost = np.array([float(padded(x * (size // x), size)) for x in lengths])
    amount, y, total = inverse @ need, cost @ inverse, sum(x * n for x, n in counts.items())

    def enter(pattern: dict[int, int]) -> bool:
        """Takes a column into the basis if it gains at the present duals."""
        nonlocal y, amount
        price_of = half if min(pattern.values()) < 0 else padded(sum(x * n for x, n in pattern.items()), size)
        where, n = [at[x] for x in pattern], np.array(list(pattern.values()), float)
        gain = float(y[where] @ n) - price_of
        if gain <= 1e-6 * size:
            return False
        step = inverse[:, where] @ n
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        out = int(np.argmin(ratio))
        if ratio[out] == np.inf:
            return False
        row = inverse[out] / step[out]
        rows, cols = np.flatnonzero(np.abs(step) > 1e-12), np.flatnonzero(row)
        inverse[np.ix_(rows, cols)] -= np.outer(step[rows], row[cols])
        inverse[out] = row
        y = y - gain * row
        amount = amount - step * ratio[out]
        amount[out] = ratio[out]
        amount = np.maximum(amount, 0)
        basis[out], cost[out] = pattern, price_of
        return True

    def rounded() -> tuple[dict[int, int], list[tuple[dict[int, int], int]]]:
        left, halved, plan = {x: counts.get(x, 0) for x in lengths}, {}, []
        for pattern, times in sorted(zip(basis, amount), key=lambda u: min(u[0].values())):  # cuts first
            fill = sum(x * n for x, n in pattern.items())
            if min(pattern.values()) > 0 and padded(fill, size) - fill > size // 128:
                continue
            times = min([int(times + 1e-6), *(left[x] // n for x, n in pattern.items() if n > 0)])
            if times:
                for x, n in pattern.items():
                    left[x] -= n * times
                if min(pattern.values()) < 0:
                    halved[max(pattern)] = times
                else:
                    plan.append((pattern, times))
        return halved, plan + _leftover(left, size, halved)

    lower, entered, value = float(total), 0, np.inf
    for turn in itertools.count(1):
        y, before = cost @ inverse, entered
        # duals near the lengths themselves, by which no pattern is worth more than it costs, price fuller patterns
        for still in (0.95, 0.7, 0.0):
            duals = np.zeros(size + 1)
            duals[lengths] = np.maximum(still * np.array(lengths) + (1 - still) * y, 0)
            columns, worth_most = price(duals, size)
            if long:
                x = max(long, key=lambda x: duals[x] - duals[x - half])
                worth_most = max(worth_most, (duals[x] - duals[x - half]) / half)
                columns += [{x: 1, x - half: -1} for x in sorted(long, key=lambda x: y[at[x - half]] - y[at[x]])[:100]]
            lower = max(lower, float(duals[lengths] @ need) / worth_most)
            entered += sum(map(enter, columns))
            if entered > before:
                break
        if entered == before or turn % TURNS == 0:
            halved, plan = rounded()
            value, last = float(cost @ amount), value
            if entered == before or value > last * (1 - 1e-6) or tokens_of(halved, plan, size) <= (1 + gap) * lower + size:
                return halved, plan


def tokens_of(halved: dict[int, int], plan: list[tuple[dict[int, int], int]], size: int) -> int:
    """Tokens of all sequences of a plan, padding included."""
    return sum(halved.values()) * (size // 2) + sum(padded(sum(x * n for x, n in pattern.items()), size) * times for pattern, times in plan)


def _leftover(left: dict[int, int], size: int, halved: dict[int, int]) -> list[tuple[dict[int, int], int]]:
    """Patterns for the items that rounding left, largest first: the fill with least padding, by dynamic programming.

    Fills that can be reached are the bits of a number; adding an item shifts them. A long item for which no good
    fill is left is halved, in ``halved``.
    """
    plan, half = [], size // 2
    left = {x: n for x, n in left.items() if n}
    while left:
        first = max(left)
        room = size - first
        reach, within, trail = 1, (1 << room + 1) - 1, []
        for x in sorted(left, reverse=True):
            n = min(left[x] - (x == first), room // x)
            if n > 0:
                trail.append((x, reach))
                while n:
                    k = (n + 1) // 2  # all numbers up to n are sums of these
                    reach |= reach << x * k & within
                    n -= k
                if reach >> room & 1:
                    break
        fills = [reach.bit_length() - 1] + [f for f in ((1 << i) - first for i in range(first.bit_length() - 1, size.bit_length())) if f >= 0 and reach >> f & 1]
        fill = min(fills, key=lambda f: (padded(first + f, size) - first - f, -f))
        if first > half and padded(first + fill, size) - first - fill > size // 64:
            left[first] -= 1
            halved[first] = halved.get(first, 0) + 1
            left[first - half] = left.get(first - half, 0) + 1
            if not left[first]:
                del left[first]
            continue
        pattern = {first: 1}
        for x, before in reversed(trail):
            while not before >> fill & 1:
                pattern[x] = pattern.get(x, 0) + 1
                fill -= x
        times = min(left[x] // n for x, n in pattern.items())
        plan.append((pattern, times))
        for x, n in pattern.items():
            left[x] -= n * times
            if not left[x]:
                del left[x]
    return plan


_PLAN = "length long, low long, high long, per long, sequence long, offset long, rest long"


def plan_rows(counts: dict[int, int], halved: dict[int, int], plan: list[tuple[dict[int, int], int]], size: int) -> tuple[list[tuple], int]:
    """Which ranks of a length go where, and the number of sequences.

    Ranks from low up to high go ``per`` to a sequence, from ``sequence`` and ``offset`` on. Where ``rest`` is not
    null the ranks are halved: first halves are sequences, the rests get ranks of their length from ``rest`` on.
    """
    half, sequence, out = size // 2, 0, []
    used: dict[int, int] = {}
    for x, n in sorted(halved.items()):
        out.append((x, 0, n, 1, sequence, 0, counts.get(x - half, 0)))
        used[x], sequence = n, sequence + n
    for pattern, times in plan:
        offset = 0
        for x, n in sorted(pattern.items(), reverse=True):
            low = used.get(x, 0)
            out.append((x, low, low + n * times, n, sequence, offset, None))
            used[x] = low + n * times
            offset += x * n
        sequence += times
    return out, sequence


def pack(docs: DataFrame, path: str, size: int = 2048, id_col: str = "doc_id", text_col: str = "text", remembered: int = REMEMBERED) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each document is its ids and the end token, cut into pieces of ``size`` and one shorter. Full pieces are
    sequences of their own; the shorter are placed, some of them halved, by the patterns of a cutting-stock plan
    over the histogram of their lengths, which has at most ``size`` - 1 rows whatever the input. A pattern takes a
    range of the ranks among pieces of a length, so places follow by arithmetic. ``size`` is a power of two.

    A worker remembers the ids of ``remembered`` chunks, of about 150 bytes each. Very long texts give as many pieces as
    they need. Null texts are empty: one piece, the end token alone. Repeated rows and null ids are documents like others; an
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    keyed = source.select("id", row_key("id", "text").alias("key"), "text")
    pieces = written(keyed.mapInArrow(_pieces(path, size, remembered), f"id {id_type}, key {KEY}, start long, length long, crc long, crc_first long, crc_rest long, doc_tokens long"), "pieces")
    short, full = pieces.where(F.col("length") < size), pieces.where(F.col("length") == size)
    counts = {r["length"]: r["count"] for r in short.groupBy("length").count().collect()}
    halved, plan = cutting_stock(counts, size) if counts else ({}, [])
    rows, packed = plan_rows(counts, halved, plan, size)
    uses = spark.createDataFrame(rows, _PLAN).groupBy("length").agg(F.collect_list(F.struct("low", "high", "per", "sequence", "offset", "rest")).alias("uses"))
    # bounded by the lengths there are, not by the input
    uses = F.broadcast(uses)

    def looked_up(pieces: DataFrame) -> DataFrame:
        found = pieces.join(uses, "length").withColumn("use", F.expr("filter(uses, u -> u.low <= rank and rank < u.high)[0]"))
        return found.withColumn("inside", F.col("rank") - F.col("use.low")).drop("uses")

    def placed(pieces: DataFrame) -> DataFrame:
        return pieces.withColumn("sequence_id", F.col("use.sequence") + F.floor(F.col("inside") / F.col("use.per")).cast("long")).withColumn("offset", F.col("use.offset") + F.pmod("inside", F.col("use.per")) * F.col("length"))

    short = looked_up(ranked(short, ["length"], ["key", "start"], "rank"))
    both = short.where("use.rest is not null")
    first = both.withColumn("length", F.lit(size // 2).cast("long")).withColumn("crc", F.col("crc_first")).withColumn("sequence_id", F.col("use.sequence") + F.col("inside")).withColumn("offset", F.lit(0).cast("long"))
    rest = both.withColumn("start", F.col("start") + size // 2).withColumn("length", F.col("length") - size // 2).withColumn("crc", F.col("crc_rest")).withColumn("rank", F.col("use.rest") + F.col("inside")).drop("use", "inside")
    full = ranked(full, ["length"], ["key", "start"], "rank").withColumn("sequence_id", F.col("rank") + packed).withColumn("offset", F.lit(0).cast("long"))
    columns = [F.col("id").alias(id_col), "start", "length", F.col("crc").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"]
    out = [x.select(columns) for x in (full, placed(short.where("use.rest is null")), first, placed(looked_up(rest)))]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op10_packing(spark, sf_dir: str) -> DataFrame:
    return pack(plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"), vocabulary(), remembered=1_200_000)
