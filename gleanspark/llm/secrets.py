"""Secret scans through a trigram inverted index."""

from __future__ import annotations

import hashlib
import re
import re._constants as sre
import re._parser as sre_parse
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleanspark.llm.store import plain

#: Strings that a part of a pattern may stand for before it counts as unknown.
MOST_STRINGS = 64
#: Rows that one index covers.
ROWS = 256


# A query is True (anything), ("tri", t), ("and", ...) or ("or", ...).


def _all(parts: list) -> object:
    parts = [p for p in parts if p is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", *dict.fromkeys(parts))


def _any(parts: list) -> object:
    return True if not parts or any(p is True for p in parts) else parts[0] if len(parts) == 1 else ("or", *dict.fromkeys(parts))


def _of_strings(strings: set[str]) -> object:
    """Postings are of three ASCII characters; what a string has besides is left to the pattern."""
    return _any([_all([("tri", s[i : i + 3]) for i in range(len(s) - 2) if s[i : i + 3].isascii()]) for s in sorted(strings)])


def _characters(items: list) -> set[str] | None:
    """The characters of a class, A-Z lowered; None if too many or open-ended."""
    out: set[str] = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            out.add(chr(value).lower() if value < 128 else chr(value))
        elif kind is sre.RANGE and value[1] - value[0] < MOST_STRINGS:
            out |= {chr(c).lower() if c < 128 else chr(c) for c in range(value[0], value[1] + 1)}
        else:
            return None
    return out if len(out) <= 4 else None


def _walk(nodes) -> tuple[set[str] | None, object]:
    """The strings that ``nodes`` stand for, or None, and a query that holds in every text with a match."""
    exact: set[str] | None = {""}
    run, needs = {""}, []

    def flush() -> None:
        nonlocal run
        needs.append(_of_strings(run))
        run = {""}

    for kind, value in nodes:
        strings, query = None, True
        if kind is sre.LITERAL:
            strings = {chr(value).lower() if value < 128 else chr(value)}
        elif kind is sre.IN:
            strings = _characters(value)
        elif kind is sre.SUBPATTERN:
            strings, query = _walk(value[3])
        elif kind is sre.BRANCH:
            found = [_walk(branch) for branch in value[1]]
            if all(s is not None for s, _ in found):
                strings = set().union(*(s for s, _ in found))
            query = _any([q if s is None else _all([q, _of_strings(s)]) for s, q in found])
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            low, high, body = value
            inner, of_inner = _walk(body)
            if inner is not None and high <= 1:
                strings = inner | {""} if low == 0 else inner
            elif low:
                query = _all([of_inner, _of_strings(inner) if inner else True])
                if inner is not None and low == high and low <= 8 and len(inner) ** low <= MOST_STRINGS:
                    strings = {"".join(x) for x in product(sorted(inner), repeat=low)}
        elif kind in (sre.AT, sre.ASSERT_NOT):
            strings = {""}
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = {a + b for a in run for b in strings}
            exact = None if exact is None else {a + b for a in exact for b in strings}
            if exact is not None and len(exact) > MOST_STRINGS:
                exact = None
        else:
            exact = None
            flush()
            needs.append(query if strings is None else _all([query, _of_strings(strings)]))
            if strings is not None:
                run = set(strings)
    flush()
    return exact, _all(needs)


def trigram_query(pattern: str, flags: int = 0) -> object:
    """A Boolean query of lower-case trigrams that holds in every A-Z-lowered text where ``pattern`` matches; True if none is mandatory."""
    return _walk(sre_parse.parse(pattern, flags))[1]


def trigrams(query) -> set[str]:
    return set() if query is True else {query[1]} if query[0] == "tri" else set().union(*map(trigrams, query[1:]))


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern``, leftmost first, without overlaps, of which ``group`` has ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    flags: int = re.ASCII
    compiled: re.Pattern = field(init=False, compare=False, default=None)
    query: object = field(init=False, compare=False, default=None)

    def __post_init__(self):
        object.__setattr__(self, "compiled", re.compile(self.pattern, self.flags))
        object.__setattr__(self, "query", trigram_query(self.pattern, self.flags))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.compiled.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


#: The base kinds and their patterns. Runs of at least 24 hexadecimal digits are the runs that are long enough.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, re.ASCII | re.IGNORECASE),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds, as their issuers publish them.
MORE_RULES = (
    Rule("private", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)


class TrigramIndex:
    """Postings of the trigrams that any rule's query names, over some texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.names = sorted(set().union(*(trigrams(r.query) for r in rules)))
        self.slots = np.zeros(1 << 24, np.uint16)
        for i, t in enumerate(self.names):
            a, b, c = t.encode()
            self.slots[a << 16 | b << 8 | c] = i + 1

    def postings(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Rows, ascending, in which each trigram occurs."""
        parts = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
        ends = np.cumsum([len(p) + 2 for p in parts])
        b = np.frombuffer(b"\xff\xff".join(parts) + b"\xff\xff", np.uint8).astype(np.uint32)
        slot = self.slots[(b[:-2] << 16) | (b[1:-1] << 8) | b[2:]]
        at = np.flatnonzero(slot)
        pairs = np.unique(slot[at].astype(np.int64) << 32 | np.searchsorted(ends, at, "right"))
        slots, rows = pairs >> 32, pairs & 0xFFFFFFFF
        cuts = np.searchsorted(slots, np.arange(1, len(self.names) + 2))
        return {t: rows[cuts[i] : cuts[i + 1]] for i, t in enumerate(self.names)}

    def candidates(self, query, postings: dict[str, np.ndarray], n: int) -> np.ndarray:
        if query is True:
            return np.arange(n)
        if query[0] == "tri":
            return postings[query[1]]
        parts = sorted((self.candidates(q, postings, n) for q in query[1:]), key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, str]]]:
        """For each text (start, rule's number, end, kind), ascending: postings give candidates, the patterns decide."""
        postings = self.postings(texts)
        out: list[list] = [[] for _ in texts]
        for number, rule in enumerate(self.rules):
            for row in self.candidates(rule.query, postings, len(texts)):
                out[row] += [(a, number, b, rule.kind) for a, b in rule.spans(texts[row])]
        return [sorted(x) for x in out]


def _joined(spans) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


def _scan(rules: tuple[Rule, ...], n_base: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TrigramIndex(rules)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                found = index.scan([t or "" for t in part.column("text").to_pylist()])
                base = [[s for s in spans if s[1] < n_base] for spans in found]
                counts = [pa.array([sum(s[1] == i for s in spans) for spans in base], pa.int64()) for i in range(n_base)]
                digest = pa.array([hashlib.sha256(_joined(s).encode()).hexdigest() for s in base])
                yield pa.RecordBatch.from_arrays([part.column("id"), *counts, digest, pa.array(map(_joined, found))], ["id", *(f"n_{r.kind}" for r in rules[:n_base]), "base_sha256", "spans"])

    return run


def scan_secrets(docs: DataFrame, more: tuple[Rule, ...] = MORE_RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: its id, the number of spans of each base kind, base_sha256, spans.

    spans lists ``kind:start:end`` (code points, end exclusive) of the base kinds and of ``more``, by start, then
    rule, joined by commas; base_sha256 is the digest of the base ones alone. Each batch's texts get an inverted
    index of the trigrams that the rules' queries name; a rule's pattern runs only on the texts that its query
    admits, or on all if it has no mandatory trigram.

    Null texts are empty. Rows are handled one by one: null ids, ties and repeated rows need no care, an empty
    table gives an empty result, other columns are ignored. No shuffle.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    counts = ", ".join(f"n_{r.kind} long" for r in BASE_RULES)
    return source.mapInArrow(_scan(BASE_RULES + more, len(BASE_RULES)), f"id {id_type}, {counts}, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def masked(text: str, spans: list[tuple[int, int, int, str]]) -> str:
    """``text`` with each run of overlapping spans replaced by the first one's kind in angle brackets."""
    out, at = [], 0
    for a, _, b, kind in spans:
        if a >= at:
            out += [text[at:a], f"<{kind}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _mask(rules: tuple[Rule, ...], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TrigramIndex(rules)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                at_text = part.schema.names.index(text_col)
                texts = part.column(at_text).to_pylist()
                found = index.scan([t or "" for t in texts])
                changed = pa.array([masked(t, s) if s else t for t, s in zip(texts, found)], pa.string())
                yield pa.RecordBatch.from_arrays([changed if i == at_text else c for i, c in enumerate(part.columns)], part.schema.names)

    return run


def mask_secrets(docs: DataFrame, more: tuple[Rule, ...] = MORE_RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with the secrets in its texts replaced by their kind; all rows and columns stay, null texts too."""
    own = next(c for c in docs.columns if c == text_col or c.lower() == text_col.lower())
    return docs.mapInArrow(_mask(BASE_RULES + more, own), docs.schema)


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    return scan_secrets(plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
