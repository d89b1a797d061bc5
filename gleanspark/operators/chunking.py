"""Markdown-aware chunks with exact code-point offsets."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from gleanspark.functions.text import SPACES

#: Characters that end a sentence.
ENDS = frozenset("。！？；…\n.!?;")
_HEADING = re.compile(r"(#{1,6})(?:[ \t](.*))?$", re.DOTALL)
_BLANK = frozenset(SPACES)
CHUNKS = "document_id bigint, ordinal int, start_offset int, end_offset int, content string, heading string"


@dataclass(frozen=True)
class ChunkOptions:
    """Most code points of a chunk (0: 400) and how many of them repeat the chunk before (negative: 60)."""

    size: int = 400
    overlap: int = -1

    def normal(self) -> ChunkOptions:
        size = self.size or 400
        overlap = 60 if self.overlap < 0 else self.overlap
        if size < 1 or overlap >= size:
            raise ValueError(f"an overlap of {overlap} doesn't fit into chunks of {size}")
        return ChunkOptions(size, overlap)


def heading_of(line: str) -> tuple[int, str] | None:
    """Level and title of an ATX heading at the start of the line."""
    m = _HEADING.match(line)
    title = (m[2] or "").strip(SPACES) if m else ""
    return (len(m[1]), title) if title else None


def sections(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, breadcrumb) of what lies between headings; a heading clears those of its level and below."""
    titles: dict[int, str] = {}
    start = at = 0
    for line in text.split("\n"):
        end = at + len(line)
        if found := heading_of(line):
            if start < at:
                yield start, at, " > ".join(titles[k] for k in sorted(titles))
            level, title = found
            titles = {k: t for k, t in titles.items() if k < level} | {level: title}
            start = min(end + 1, len(text))
        at = end + 1
    if start < len(text):
        yield start, len(text), " > ".join(titles[k] for k in sorted(titles))


def protected(text: str, start: int, end: int) -> list[tuple[int, int]]:
    """Fences, to a closing line of the same mark or the section's end, and runs of three or more table rows, as (start, end)."""
    lines, at = [], start
    for line in text[start:end].split("\n"):
        lines.append((at, min(at + len(line) + 1, end), line))
        at += len(line) + 1
    out, i = [], 0
    while i < len(lines):
        bare = lines[i][2].lstrip(SPACES)
        if bare[:3] in ("```", "~~~"):
            close = next((j for j in range(i + 1, len(lines)) if _closes(lines[j][2], bare[0])), len(lines) - 1)
            out.append((lines[i][0], lines[close][1]))
            i = close + 1
        elif bare.startswith("|"):
            j = i
            while j < len(lines) and lines[j][2].lstrip(SPACES).startswith("|"):
                j += 1
            if j - i >= 3:
                out.append((lines[i][0], lines[j - 1][1]))
            i = j
        else:
            i += 1
    return out


def _closes(line: str, mark: str) -> bool:
    bare = line.strip(SPACES)
    return len(bare) >= 3 and not bare.strip(mark)


class _Section:
    """Cuts one section; offsets are those of the document."""

    def __init__(self, text: str, start: int, end: int, options: ChunkOptions):
        self.text, self.start, self.end, self.options = text, start, end, options
        self.regions = protected(text, start, end)
        self.starts = [r[0] for r in self.regions]

    def last(self, marks, low: int, high: int) -> int:
        """Just after the last of ``marks`` that lies between ``low`` and ``high``; -1 if there is none."""
        for i in range(high - 1, low - 1, -1):
            if self.text[i] in marks:
                return i + 1
        return -1

    def region_over(self, cut: int) -> tuple[int, int] | None:
        """The protected region that a cut at ``cut`` would split."""
        i = bisect.bisect_left(self.starts, cut) - 1
        return self.regions[i] if i >= 0 and cut < self.regions[i][1] else None

    def cut(self, at: int, limit: int) -> int:
        least = at + self.options.overlap + 1
        cut = self.last(ENDS, at, limit)
        cut = limit if cut < 0 else cut
        region = self.region_over(cut)
        if region:
            if region[0] > least:
                return region[0]
            line = self.last("\n", least, limit)
            return line if line > least else limit
        if cut <= least:
            again = self.last(ENDS, least, limit)
            return again if again > least else limit
        return cut

    def chunks(self) -> Iterator[tuple[int, int]]:
        at = self.start
        while True:
            while at < self.end and self.text[at] in _BLANK:
                at += 1
            if at >= self.end:
                return
            final = at + self.options.size >= self.end
            cut = end = self.end if final else self.cut(at, at + self.options.size)
            while end > at + 1 and self.text[end - 1] in _BLANK:
                end -= 1
            yield at, end
            if final:
                return
            follow = cut if cut in self.starts else end - self.options.overlap
            at = max(follow, at + 1)


def split(text: str, options: ChunkOptions = ChunkOptions()) -> list[tuple[int, int, int, str]]:
    """(ordinal, start, end, breadcrumb) of the chunks of one document."""
    options, out = options.normal(), []
    for start, end, crumb in sections(text):
        for a, b in _Section(text, start, end, options).chunks():
            out.append((len(out), a, b, crumb))
    return out


def chunk_documents(docs: DataFrame, options: ChunkOptions = ChunkOptions(), id_col: str = "id", text_col: str = "content") -> DataFrame:
    """Chunks (document_id, ordinal, start_offset, end_offset, content, heading) of documents with an id other than 0.

    Where one chunk starts depends on where the last one ended, so a document is cut by one Python pass, in Arrow
    batches and without a shuffle. Documents without a chunk (headings or white space only) give no row: see
    ``without_chunks``.
    """
    options = options.normal()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                if doc == 0:
                    raise ValueError("a document must be saved, with an id other than 0, before it is cut")
                rows += [(doc, n, a, b, text[a:b], crumb) for n, a, b, crumb in split(text, options)]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            names = [c.split()[0] for c in CHUNKS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)

    return docs.select(F.col(id_col).cast("bigint"), F.col(text_col)).mapInArrow(run, CHUNKS)


def without_chunks(docs: DataFrame, chunks: DataFrame, id_col: str = "id") -> DataFrame:
    """Documents that gave no chunk."""
    return docs.join(chunks.select(F.col("document_id").alias(id_col)).distinct(), id_col, "left_anti")


def sections_of(docs: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """(id, section, start_offset, end_offset, heading) by column functions alone: lines, running offsets, latest titles."""
    lines = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("n", "line"))
    order = W.partitionBy("id").orderBy("n")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    lines = lines.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)))
    mark = F.regexp_extract("line", r"^(#{1,6})([ \t]|$)", 1)
    title = F.regexp_replace(F.expr("substring(line, length(mark) + 1)"), f"^[{SPACES}]+|[{SPACES}]+$", "")
    lines = lines.withColumn("mark", mark).withColumn("title", F.when(F.length("mark") > 0, title))
    lines = lines.withColumn("level", F.when(F.coalesce("title", F.lit("")) != "", F.length("mark")))
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    for k in range(1, 7):
        # the latest title of level k counts if no higher heading came after it
        lines = lines.withColumn(f"at{k}", F.max(F.when(F.col("level") == k, F.col("n"))).over(so_far))
        lines = lines.withColumn(f"t{k}", F.max_by(F.col("title"), F.when(F.col("level") == k, F.col("n"))).over(so_far))
    lines = lines.withColumn("section", F.count("level").over(so_far))
    live = [F.when(F.col(f"at{k}") > F.greatest(F.lit(-1), F.lit(-1), *(F.coalesce(f"at{j}", F.lit(-1)) for j in range(1, k))), F.col(f"t{k}")) for k in range(1, 7)]
    lines = lines.withColumn("heading", F.array_join(F.filter(F.array(*live), lambda t: t.isNotNull()), " > ")).where("level is null")
    out = lines.groupBy("id", "section", "heading").agg(F.min("start").alias("start_offset"), F.max(F.col("start") + F.length("line") + 1).alias("last"))
    total = docs.select(F.col(id_col).alias("id"), F.length(text_col).alias("total"))
    out = out.join(total, "id").withColumn("end_offset", F.least("last", "total")).where("start_offset < end_offset")
    return out.select("id", "section", "start_offset", "end_offset", "heading")


def violations(docs: DataFrame, chunks: DataFrame, options: ChunkOptions = ChunkOptions(), id_col: str = "id", text_col: str = "content") -> DataFrame:
    """How often each invariant is broken (0 throughout): slices, sizes, order, progress, documents without a chunk."""
    options = options.normal()
    text = docs.select(F.col(id_col).alias("document_id"), F.col(text_col).alias("text"))
    w = W.partitionBy("document_id").orderBy("ordinal")
    c = chunks.join(text, "document_id").withColumn("prior", F.lag("start_offset").over(w)).withColumn("place", F.row_number().over(w) - 1)
    count = lambda condition: F.count_if(condition).cast("bigint")
    counts = c.agg(
        count(F.col("content") != F.expr("substring(text, start_offset + 1, end_offset - start_offset)")).alias("not_slices"), count(F.col("end_offset") - F.col("start_offset") > options.size).alias("too_long"),
        count(F.col("end_offset") <= F.col("start_offset")).alias("empty"), count(F.col("ordinal") != F.col("place")).alias("gaps"), count(F.col("start_offset") <= F.col("prior")).alias("not_ahead"),
    )
    lost = docs.where(F.col(text_col).rlike(f"[^{SPACES}]")).join(chunks.select(F.col("document_id").alias(id_col)).distinct(), id_col, "left_anti")
    return counts.crossJoin(lost.agg(F.count(F.lit(1)).alias("without_chunks")))
