"""Exact substring deduplication with a run-length compressed suffix index."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleanspark.llm.shingles import mix
from gleanspark.llm.store import KEY, held, plain, remove, row_key, small, unused, written

#: A window's anchor is a gram of this share of its bytes.
GRAM = 4
#: Windows handled at once, of one long text or many short ones.
SLAB = 1 << 18
#: Bytes that the pieces of one bucket may have; a bucket with more is split. Smaller buckets share indexes of about as many bytes.
INDEX_BYTES = 1 << 20
#: Symbols that an index can hold.
MOST_SYMBOLS = 1 << 21
#: A passage of more than fifty words has at least so many bytes.
PASSAGE = 250

_BASE = 0x9E3779B97F4A7C15 | 1
_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    size = 1 << max(14, (n - 1).bit_length())
    if size not in _powers:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


class Rolling:
    """64-bit hashes of any substrings of ``b``, equal for equal bytes."""

    def __init__(self, b: np.ndarray):
        up, self.down = _tables(len(b) + 1)
        self.sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_VALUES[b] * up[: len(b)], out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, size: int) -> np.ndarray:
        """The hashes of all substrings of ``size`` bytes."""
        n = len(self.sums) - size
        return mix((self.sums[size:] - self.sums[:n]) * self.down[:n])


def _least(v: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` values in a row."""
    done, out = 1, v
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


_HIGH, _LOW = np.uint64(0xFFFFFFFF00000000), np.uint64(0xFFFFFFFF)


def _placed(hashes: np.ndarray) -> np.ndarray:
    """Hashes that can be told apart by place, smaller ones first, the leftmost of equals."""
    return (hashes & _HIGH) | np.arange(len(hashes), dtype=np.uint64)


def segments(texts: list[bytes], length: int, slab: int = SLAB) -> list[np.ndarray]:
    """Cuts the starts of all ``length``-byte windows into runs with one anchor: text, first start, number, bucket, content.

    A window's anchor is its gram of least hash, the leftmost of equals, so equal windows have equal anchors at
    equal places: bucket is the anchor's hash, content that of the bytes under the run's windows.
    """
    gram = max(1, length // GRAM)
    parts: list[tuple[int, int, bytes]] = []
    for i, b in enumerate(texts):
        parts += [(i, base, b[base : base + slab + length - 1]) for base in range(0, max(0, len(b) - length + 1), slab)]
    out: list[tuple] = []
    at = 0
    while at < len(parts):
        group, total = [], 0
        while at < len(parts) and (not group or total + len(parts[at][2]) <= slab):
            group.append(parts[at])
            total += len(parts[at][2])
            at += 1
        sizes = np.fromiter((len(p[2]) for p in group), np.int64, len(group))
        ends = np.cumsum(sizes)
        r = Rolling(np.frombuffer(b"".join(p[2] for p in group), np.uint8))
        hashes = r.grams(gram)
        anchor = (_least(_placed(hashes), length - gram + 1) & _LOW).astype(np.int64)
        part = np.repeat(np.arange(len(group)), sizes)[: len(anchor)]
        inside = np.arange(len(anchor)) <= ends[part] - length
        lo = np.flatnonzero(inside & np.r_[True, (anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])])
        n, whose, place = np.add.reduceat(inside.astype(np.int64), lo), part[lo], anchor[lo]
        content = mix(r.of(lo, lo + n - 1 + length) + ((n << 32) + (place - lo)).astype(np.uint64))
        base = np.fromiter((p[1] for p in group), np.int64, len(group)) - (ends - sizes)
        text = np.fromiter((p[0] for p in group), np.int64, len(group))
        out.append((text[whose], lo + base[whose], n, hashes[place].view(np.int64), content.view(np.int64)))
    return [np.concatenate(x) for x in zip(*out)] if out else [np.empty(0, np.int64)] * 5


def suffix_array(x: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of the bytes ``x`` in order, and how many bytes each place has up to its separator; True in ``sep`` marks separators, each unlike any other, the last at the end.

    Prefix doubling; only suffixes that still share a place with another are sorted again, as numbers that hold
    their key and their place.
    """
    n = len(x)
    bits = n.bit_length()
    mask, ends = (1 << bits) - 1, np.flatnonzero(sep)
    #: Symbols from each place up to its separator.
    room = np.repeat(ends, np.diff(np.r_[-1, ends])).astype(np.int32)
    room -= np.arange(n, dtype=np.int32)
    code = np.zeros(256, np.uint8)
    code[np.unique(x[~sep])] = 1
    code = np.where(code > 0, np.cumsum(code), 0)
    step = int(code.max()).bit_length()
    width, key = 1, np.where(sep, 0, code[x]).astype(np.int64)
    while 2 * width * step + bits <= 63:
        key = (key << width * step) | np.r_[key[width:], np.zeros(width, np.int64)]
        width *= 2
    # what comes after a separator doesn't count
    blank = np.maximum(width - room, 0) * step
    key = (key >> blank << blank << bits) | np.arange(n)
    del blank
    key.sort()
    order = (key & mask).astype(np.int32)
    key >>= bits
    open_ = room >= width
    # a suffix that meets its separator has its place: after the earlier ones like it
    head = np.r_[True, (key[1:] != key[:-1]) | ~open_[order[1:]]]
    del key, open_
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n, dtype=np.int32), 0))
    left = order[~(head & np.r_[head[1:], True])].astype(np.int64)  # in order of their groups
    while len(left):
        key = (rank[left].astype(np.int64) << 2 * bits) | (rank[left + width].astype(np.int64) << bits) | left
        key.sort()
        left = key & mask
        first, second = key >> 2 * bits, (key >> bits) & mask
        new_group = np.r_[True, first[1:] != first[:-1]]
        new_head = new_group | np.r_[True, second[1:] != second[:-1]]
        i = np.arange(len(left))
        slot = first + i - np.maximum.accumulate(np.where(new_group, i, 0))
        order[slot] = left
        rank[left] = slot[np.maximum.accumulate(np.where(new_head, i, 0))]
        left = left[~(new_head & np.r_[new_head[1:], True])]
        width *= 2
    return order, room


class RunIndex:
    """Run-compressed Burrows-Wheeler transform of many strings, with the suffixes at the ends of its runs.

    Symbols and lengths of the runs are kept, and for each border between two runs the suffixes on both sides and
    how much they have in common. Nothing else outlives the building: the suffix array goes.

    In the order of suffixes the best match of a suffix is a neighbour. Inside a run, the neighbour is one place on
    from that of the suffix one byte before, and the match one byte shorter; so the samples at the ends of runs give
    the matching statistics of all places, streamed in the order of the strings.
    """

    def __init__(self, strings: list[np.ndarray]):
        ends = np.cumsum([len(s) + 1 for s in strings])
        self.starts, self.n = np.r_[0, ends[:-1]], int(ends[-1])
        if self.n > MOST_SYMBOLS:
            raise ValueError(f"an index holds {MOST_SYMBOLS} symbols, not {self.n}")
        text, sep = np.zeros(self.n + 8, np.uint8), np.zeros(self.n, bool)
        sep[ends - 1] = True
        text[: self.n][~sep] = np.concatenate(strings)
        suffixes, room = suffix_array(text[: self.n], sep)
        bwt = np.full(self.n + 1, -1, np.int16)
        bwt[1:][~sep] = text[: self.n][~sep]
        bwt = bwt[suffixes]
        tops = np.flatnonzero((bwt[1:] != bwt[:-1]) | (bwt[1:] < 0)) + 1
        #: Symbols (-1: the start of a string) and lengths of the runs.
        self.symbols, self.lengths = bwt[np.r_[0, tops]], np.diff(np.r_[0, tops, self.n])
        del bwt, tops
        tops = np.cumsum(self.lengths)[:-1]
        above, below = suffixes[tops - 1], suffixes[tops]
        del suffixes
        common = self._common(text, room, above, below)
        longest, other = np.full(self.n, -1, np.int32), np.full(self.n, -1, np.int32)
        longest[above] = common
        other[below] = common
        np.maximum(longest, other, out=longest)
        #: Samples in the order of the strings: a place, and how long it matches another one.
        self.places = np.flatnonzero(longest >= 0)
        self.values = longest[self.places].astype(np.int64)

    @staticmethod
    def _common(text: np.ndarray, room: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Lengths of the longest common prefixes of the suffixes at p and q, inside their strings."""
        most = np.minimum(room[p], room[q])
        out = np.zeros(len(p), np.int32)
        live = np.flatnonzero(most > 0)
        step = np.arange(8, dtype=np.int32)
        while len(live):
            at = out[live]
            a, b = (text[(x[live] + at)[:, None] + step].view(np.uint64).ravel() for x in (p, q))
            differ = a ^ b
            same = np.full(len(live), 8, np.int32)
            odd = np.flatnonzero(differ)
            low = differ[odd] & (~differ[odd] + np.uint64(1))
            same[odd] = np.log2(low.astype(np.float64)).astype(np.int32) >> 3
            out[live] = at + same
            live = live[(same == 8) & (out[live] < most[live])]
        return np.minimum(out, most)

    def statistics(self, block: int = 1 << 16) -> Iterator[np.ndarray]:
        """For each place, in order and in blocks, how long a string that starts there also starts at another place."""
        reach = np.maximum.accumulate(self.places + self.values) if len(self.places) else self.places
        for base in range(0, self.n, block):
            at = np.arange(base, min(base + block, self.n))
            i = np.searchsorted(self.places, at, "right") - 1
            yield np.maximum(np.where(i >= 0, reach[i], 0) - at, 0)

    def matches(self, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the string, first and last + 1 of each run of places whose matching statistic is at least ``length``."""
        long = self.values >= length
        a = self.places[long]
        b = np.maximum.accumulate(a + self.values[long] - length + 1) if len(a) else a
        fresh = np.flatnonzero(np.r_[True, a[1:] > b[:-1]]) if len(a) else np.empty(0, np.int64)
        a, b = a[fresh], b[np.r_[fresh[1:], len(b)] - 1] if len(a) else b
        whose = np.searchsorted(self.starts, a, "right") - 1
        return whose, a - self.starts[whose], b - self.starts[whose]


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


_LISTS = {"lo": pa.int32(), "n": pa.int32(), "bucket": pa.int64(), "content": pa.int64()}
_LIST_KINDS = "lo array<int>, n array<int>, bucket array<long>, content array<long>"


def _lists(whose: np.ndarray, found: list[np.ndarray], rows: int) -> list[pa.Array]:
    ends = pa.array(np.searchsorted(whose, np.arange(rows + 1)), pa.int32())
    return [pa.ListArray.from_arrays(ends, pa.array(x, kind)) for x, kind in zip(found, _LISTS.values())]


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held((), object)  # nothing of other stages is needed
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            texts = [_bytes(t.as_py()) for t in batch.column("text")]
            whose, *found = segments(texts, length)
            digests = pa.array([hashlib.sha256(b).digest() for b in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("key"), pa.array(list(map(len, texts)), pa.int64()), digests, *_lists(whose, found, len(texts))], ["id", "key", "n_bytes", "digest", *_LISTS])

    return run


def _cut_within(short: int, length: int):
    """Segments of those parts of texts that are covered throughout by repeats of ``short`` bytes: no others can hold longer repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            parts, rows, starts = [], [], []
            for row, (text, marks) in enumerate(zip(batch.column("text"), batch.column("marks"))):
                b = _bytes(text.as_py())
                for x, y in byte_spans(_pairs(marks), 1):
                    if y - 1 + short - x >= length:
                        parts.append(b[x : y - 1 + short])
                        rows.append(row)
                        starts.append(x)
            whose, lo, *found = segments(parts, length)
            lo += np.array(starts, np.int64)[whose]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("rows"), *_lists(np.array(rows, np.int64)[whose], [lo, *found], batch.num_rows)], ["key", "rows", *_LISTS])

    return run


_PIECES = {"bucket": pa.int64(), "content": pa.int64(), "copies": pa.int64(), "piece": pa.binary()}
_PARTS = _PIECES | {"home": pa.int64(), "whole": pa.int64(), "base": pa.int32()}
_PIECE_KINDS = "bucket long, content long, copies long, piece binary"
_PART_KINDS = f"{_PIECE_KINDS}, home long, whole long, base int"


def _pieces(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, wanted in zip(batch.column("text"), batch.column("wanted")):
                b = _bytes(text.as_py())
                bucket, content, copies, lo, n = wanted.values.flatten()
                piece = pa.array([b[x : x + y - 1 + length] for x, y in zip(lo.to_pylist(), n.to_pylist())], pa.binary())
                yield pa.RecordBatch.from_arrays([bucket, content, copies, piece], list(_PIECES))

    return run


def _word(x: np.ndarray) -> int:
    return int(x.view(np.int64)[0])


def _split(length: int, step: int):
    """Deals the windows of each piece by the distance to their anchor, ``step`` distances together, into pieces of their own.

    All windows of such a piece hold the bytes that the farthest two of them share, so these name its bucket.
    """
    gram = max(1, length // GRAM)

    def parts(bucket: int, content: int, copies: int, piece: bytes) -> Iterator[tuple]:
        r, n = Rolling(np.frombuffer(piece, np.uint8)), len(piece) - length + 1
        place, first = int(np.argmin(_placed(r.grams(gram)[: length - gram + 1]))), 0
        seed = np.array([bucket], np.int64).view(np.uint64)
        while first < n:
            j = (place - first) // step
            last = min(place - j * step, n - 1)
            shared = r.of(np.array([place - j * step]), np.array([place - (j + 1) * step + 1 + length]))
            form = np.array([(last - first << 32) + place - first], np.uint64)
            own = r.of(np.array([first]), np.array([last + length]))
            yield _word(mix(shared + mix(seed + np.uint64(j)))), _word(mix(own + form)), copies, piece[first : last + length], bucket, content, first
            first = last + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [x for row in zip(*(batch.column(c).to_pylist() for c in _PIECES)) for x in parts(*row)]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(_PARTS), _PARTS.values())], list(_PARTS))

    return run


_MARKS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))
_FOUND = "bucket long, content long, marks array<struct<a:int,b:int>>"


def _index(length: int):
    """Marks the starts of repeated windows in the pieces of whole buckets, as many as fit into one index."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket").combine_chunks()
        bucket, copies = (table.column(c).to_numpy() for c in ("bucket", "copies"))
        pieces = [np.frombuffer(p.as_py(), np.uint8) for p in table.column("piece")]
        ends = np.cumsum(np.fromiter((len(p) + 1 for p in pieces), np.int64, len(pieces)))
        edges = [*(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1), len(bucket)]
        found, start = [], 0
        for edge, after in zip(edges, [*edges[1:], None]):
            if after is None or ends[after - 1] - (ends[start - 1] if start else 0) > MOST_SYMBOLS:
                row, a, b = RunIndex(pieces[start:edge]).matches(length)
                found.append((row + start, a, b))
                start = edge
        many = np.flatnonzero(copies > 1)  # strings that the index stands for several times
        found.append((many, np.zeros(len(many), np.int64), np.array([len(pieces[i]) - length + 1 for i in many], np.int64)))
        row, *values = (np.concatenate(x) for x in zip(*found))
        order = np.argsort(row, kind="stable")
        rows, at = np.unique(row[order], return_index=True)
        struct = pa.StructArray.from_arrays([pa.array(v[order], pa.int32()) for v in values], ["a", "b"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[at, len(row)], pa.int32()), struct)
        return table.select(["bucket", "content"]).take(pa.array(rows)).append_column("marks", lists.cast(_MARKS))

    return run


def _shifted(marks: str, by: str):
    return F.transform(marks, lambda m: F.struct((m["a"] + F.col(by)).alias("a"), (m["b"] + F.col(by)).alias("b")))


def _found(pieces: DataFrame, length: int, index_bytes: int) -> DataFrame:
    """(home, whole, marks) of ``pieces``, a written table that has each (bucket, content) once.

    A bucket whose pieces are too many bytes for one index is split by what its windows share: half as many
    distances to the anchor go together each time, until what meets fits, or is one window.
    """
    level, homes, out = pieces, None, None
    step = length - max(1, length // GRAM) + 1
    while True:
        sizes = written(level.groupBy("bucket").agg(F.sum(F.length("piece") + 1).alias("bytes")), "sizes")
        n_large, total = sizes.agg(F.count_if(F.col("bytes") > index_bytes), F.sum("bytes")).first()
        last = not n_large or step == 1
        large = sizes.where(F.col("bytes") > index_bytes).select("bucket")
        fits = level if last else level.join(small(large), "bucket", "left_anti")
        tasks = max(1, -(-(total or 0) // index_bytes))
        found = fits.withColumn("task", F.pmod(F.xxhash64("bucket"), F.lit(tasks))).groupBy("task").applyInArrow(_index(length), _FOUND)
        if homes is None:
            found = found.select(F.col("bucket").alias("home"), F.col("content").alias("whole"), "marks")
        else:
            found = found.join(homes, ["bucket", "content"]).select("home", "whole", _shifted("marks", "base").alias("marks"))
        found = written(found, "found")
        out = found if out is None else out.union(found)
        if last:
            return out
        step = max(1, step // 2)
        parts = written(level.join(small(large), "bucket").mapInArrow(_split(length, step), _PART_KINDS), "parts")
        new = parts.select("bucket", "content", F.col("home").alias("b"), F.col("whole").alias("c"), F.col("base").alias("at"))
        if homes is None:
            homes = new.select("bucket", "content", F.col("b").alias("home"), F.col("c").alias("whole"), F.col("at").alias("base"))
        else:
            old = homes.select(F.col("bucket").alias("b"), F.col("content").alias("c"), "home", "whole", "base")
            homes = new.join(old, ["b", "c"]).select("bucket", "content", "home", "whole", (F.col("base") + F.col("at")).alias("base"))
        homes = written(homes, "homes")
        level = written(parts.groupBy("bucket", "content").agg(F.sum("copies").alias("copies"), F.first("piece").alias("piece")), "pieces")


def _hits(segments_: DataFrame) -> DataFrame:
    """(key, rows, lo, n, bucket, content, mixed) of the segments whose bucket isn't theirs alone; mixed: nor alike throughout.

    A bucket that many segments share is summed up before it is shuffled, and can be split where it is joined.
    """
    cuts = segments_.where(F.size("lo") > 0).select("key", "rows", F.explode(F.arrays_zip(*_LISTS)).alias("s")).select("key", "rows", "s.*")
    shared = written(cuts.groupBy("bucket").agg(F.sum("rows").alias("n"), (F.min("content") < F.max("content")).alias("mixed")).where("n > 1").select("bucket", "mixed"), "shared")
    return written(cuts.join(shared, "bucket"), "hits")


def _marks(hits: DataFrame, texts: DataFrame, length: int, index_bytes: int) -> DataFrame:
    """(key, marks): the starts of repeated windows in the texts (key, text).

    Where all segments of a bucket are alike each one's windows are repeated by another's, and nothing is to be sought.
    """
    alike = hits.where("not mixed").select("key", F.array(F.struct(F.col("lo").alias("a"), (F.col("lo") + F.col("n")).alias("b"))).alias("marks"))
    mixed = hits.where("mixed")
    kinds = mixed.groupBy("bucket", "content").agg(F.sum("rows").alias("copies"), F.min(F.struct("key", "lo", "n")).alias("one"))
    wanted = kinds.groupBy(F.col("one.key").alias("key")).agg(F.collect_list(F.struct("bucket", "content", "copies", "one.lo", "one.n")).alias("wanted"))
    pieces = written(texts.select("key", "text").join(wanted, "key").select("text", "wanted").mapInArrow(_pieces(length), _PIECE_KINDS), "pieces")
    found = _found(pieces, length, index_bytes)
    spans = mixed.select("key", "lo", F.col("bucket").alias("home"), F.col("content").alias("whole")).join(found, ["home", "whole"])
    # equal rows have equal spans
    marks = alike.union(spans.select("key", _shifted("marks", "lo").alias("marks"))).groupBy("key").agg(F.flatten(F.collect_set("marks")).alias("marks"))
    marks = written(marks, "marks")
    remove(pieces)
    remove(hits)
    return marks


def _marked(docs: DataFrame, lengths: tuple[int, ...], index_bytes: int) -> tuple[DataFrame, DataFrame]:
    """Digests of all rows (id, key, n_bytes, digest), and the rows with repeats (key, text, marks: starts of windows of each length)."""
    id_type = docs.schema["id"].dataType.simpleString()
    keyed = docs.select("id", row_key("id", "text").alias("key"), "text")
    every = written(keyed.mapInArrow(_cut(lengths[0]), f"id {id_type}, key {KEY}, n_bytes long, digest binary, {_LIST_KINDS}"), "segments")
    hits = _hits(every.withColumn("rows", F.lit(1).cast("long")))

    texts = keyed.select("key", "text").join(small(written(hits.select("key").distinct(), "keys")), "key").withColumn("rows", F.lit(1).cast("long"))
    twice = written(every.groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "twice")
    if twice.limit(1).count():  # equal rows are one here
        again = texts.drop("rows").join(small(twice), "key").dropDuplicates(["key"])
        texts = texts.join(small(twice.select("key")), "key", "left_anti").unionByName(again)
    texts = written(texts, "texts")
    marks = _marks(hits, texts, lengths[0], index_bytes)
    out = texts.join(marks, "key")
    for short, length in zip(lengths, lengths[1:]):
        within = written(out.mapInArrow(_cut_within(short, length), f"key {KEY}, rows long, {_LIST_KINDS}"), "segments")
        longer = _marks(_hits(within), texts, length, index_bytes).withColumnRenamed("marks", "longer")
        out = out.join(longer, "key", "left")
    return every.select("id", "key", "n_bytes", "digest"), out


def _pairs(marks: pa.ListScalar) -> list[tuple[int, int]]:
    return list(zip(*(x.to_pylist() for x in marks.values.flatten()))) if marks.is_valid else []


def byte_spans(ranges: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of the bytes under the windows that start in ``ranges``."""
    out: list[list[int]] = []
    for a, b in sorted((a, b + length - 1) for a, b in ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def _kept(lengths: tuple[int, ...], text: bool = False):
    """What is left of each text, as bytes or, without characters that a cut splits, as ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 500) for b in batches for at in range(0, b.num_rows, 500)):
            rows = []
            for whole, *marks in zip(*(batch.column(c) for c in ("text", "marks", "longer")[: 1 + len(lengths)])):
                b, found = _bytes(whole.as_py()), [byte_spans(_pairs(m), length) for m, length in zip(marks, lengths)]
                spans = found[-1]
                kept = b"".join(b[x:y] for x, y in zip([0, *(s[1] for s in spans)], [*(s[0] for s in spans), len(b)]))
                rows.append((len(b) - len(kept), len(spans), sum(y - x for x, y in found[0]), kept.decode("utf-8", "ignore") if text else kept))
            columns = zip(*rows) if rows else [()] * 4
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string() if text else pa.binary())))], ["key", "n_removed", "n_spans", "n_passage_bytes", "kept"])

    return run


def remove_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text", passage: int | None = None, index_bytes: int = INDEX_BYTES, as_text: bool = False) -> tuple[DataFrame, DataFrame]:
    """Bytes of texts under a ``length``-byte string that also starts anywhere else, and what is left without them.

    Returns two tables: one row per row of ``docs`` (id, key, n_bytes, digest: SHA-256 of the whole text), and one
    for some of the distinct (id, text), among them all from which bytes go (key, n_removed, n_spans,
    n_passage_bytes, kept: the remaining bytes, or ``as_text``). n_passage_bytes counts the bytes under ``passage``-byte strings that
    repeat, which only are counted and don't go; ``passage`` is ``length`` unless it is given, and shorter.
    Texts are UTF-8, matches never cross texts, overlaps count, and all strings are judged on the input.

    Null texts are empty; texts shorter than ``length`` keep all. Very long texts are cut into segments in slabs.
    Repeated rows are each other's repeats. Null ids are ids like others, an empty table gives empty tables, other
    columns are ignored.

    Each window of ``passage`` bytes has one anchor (a minimiser), so equal windows meet in one bucket. Windows
    whose bucket is theirs alone are unique, and all are repeats where a bucket's are of one kind. One piece of each
    other kind, with the number of its copies, goes into
    run-length indexes over whole buckets, whose matching statistics mark the windows. A bucket of more than
    ``index_bytes`` is split by the bytes that its windows share and indexed likewise, so no task holds more. Longer
    repeats are sought in the same way, in what shorter ones cover.
    """
    if passage is not None and passage > length:
        raise ValueError("passages are no longer than what goes")
    lengths = tuple(sorted({passage or length, length}))
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    every, marked = _marked(source, lengths, index_bytes)
    return every, marked.mapInArrow(_kept(lengths, as_text), f"key {KEY}, n_removed long, n_spans long, n_passage_bytes long, kept {'string' if as_text else 'binary'}")


def without_repeats(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated bytes cut from the texts; all rows and other columns stay. Characters that a cut splits go."""
    _, changed = remove_repeats(docs, length, id_col, text_col, as_text=True)
    key, kept = unused(docs, "_key", "_kept")
    changed = changed.where("n_removed > 0").select("key", "kept").toDF(key, kept)
    joined = docs.withColumn(key, row_key(id_col, text_col)).join(changed, key, "left")
    return joined.select(*(F.coalesce(F.col(kept), F.col(f"`{c}`")).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns))


def op1_repeats(spark, sf_dir: str) -> DataFrame:
    """Beside the contract's columns n_passage_bytes: passages of more than fifty words can be shorter than 400 bytes."""
    every, changed = remove_repeats(plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"), passage=PASSAGE)
    changed = changed.select("key", "n_removed", "n_spans", "n_passage_bytes", F.sha2("kept", 256).alias("sha"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return every.join(changed, "key", "left").select(
        F.col("id").alias("doc_id"), "n_bytes", count("n_removed"), count("n_spans"), F.coalesce("sha", F.lower(F.hex("digest"))).alias("kept_sha256"), count("n_passage_bytes")
    )
