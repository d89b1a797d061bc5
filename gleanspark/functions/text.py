"""Column functions for mixed CJK and Latin text. All positions are Unicode code points."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SCHEMES = ("bigram", "unigram", "both")
#: Full-width forms U+FF01 to U+FF5E and the ideographic space, and what they fold to.
WIDE = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
NARROW = "".join(map(chr, range(0x21, 0x7F))) + " "
CJK = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}]"
#: Go's unicode.IsSpace.
SPACES = "\t\n\x0b\x0c\r \x85\xa0                　"


def fold_width(text: Column) -> Column:
    """Full-width ASCII forms and the ideographic space folded; nothing else is normalised."""
    return F.translate(text, WIDE, NARROW)


def scheme_or_default(scheme: str | None) -> str:
    return scheme if scheme in SCHEMES else "bigram"


def tokenize(text: Column, scheme: str | None = "bigram") -> Column:
    """Tokens in order, an empty array for null or token-less text.

    Runs of letters and decimal digits are lower-cased words. Runs of CJK characters give bigrams (a lone
    character itself), single characters, or both, characters first.
    """
    scheme = scheme_or_default(scheme)
    spaced = F.regexp_replace(fold_width(F.coalesce(text, F.lit(""))), f"({CJK}+)", " $1 ")
    runs = F.regexp_extract_all(spaced, F.lit(CJK + r"+|[\p{L}\p{Nd}]+"), F.lit(0))

    def parts(run: Column) -> Column:
        n = F.length(run)
        pairs = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(run, i, F.lit(2)))
        single = F.split(run, "")
        cjk = {"bigram": pairs, "unigram": single, "both": F.when(n == 1, single).otherwise(F.concat(single, pairs))}[scheme]
        return F.when(run.rlike(f"^{CJK}"), cjk).otherwise(F.array(F.lower(run)))

    return F.flatten(F.transform(runs, parts))


def fnv1a32(text: Column) -> Column:
    """The 32-bit FNV-1a hash of the UTF-8 bytes, as a long."""
    digits = F.hex(text.cast("binary"))
    n = F.length(digits) / 2
    octets = F.transform(F.sequence(F.lit(0), F.greatest(n.cast("int") - 1, F.lit(0))), lambda i: F.conv(F.substring(digits, 2 * i + 1, F.lit(2)), 16, 10).cast("bigint"))
    # characters of ASCII are their bytes, which needs no digits
    plain = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("bigint"))
    octets = F.when(F.length(text) == 0, F.array().cast("array<bigint>")).when(F.length(text) == F.octet_length(text), plain).otherwise(octets)
    return F.aggregate(octets, F.lit(2166136261).cast("bigint"), lambda h, b: F.pmod(h.bitwiseXOR(b) * 16777619, F.lit(1 << 32)))


def blank(text: Column) -> Column:
    """Null, empty, or white space only."""
    return F.length(F.translate(F.coalesce(text, F.lit("")), SPACES, "")) == 0


def title_of(content: Column, title: Column | None = None, longest: int = 60, untitled: str = "未命名文档") -> Column:
    """The given title, else the first line without leading #, at most ``longest`` characters and an ellipsis, else ``untitled``."""
    line = F.regexp_replace(F.regexp_replace(F.split(content, "\n")[0], "^#+", ""), f"^[{SPACES}]+|[{SPACES}]+$", "")
    short = F.when(F.length(line) > longest, F.concat(F.substring(line, 1, longest), F.lit("…"))).otherwise(line)
    found = F.when(short == "", F.lit(untitled)).otherwise(short)
    return found if title is None else F.coalesce(F.nullif(F.trim(title), F.lit("")), found)


def stable_key(chunk_id: Column, document_id: Column, ordinal: Column) -> Column:
    """The text that breaks ties: ``id:<id>``, or ``doc:<document>#<ordinal>`` for what isn't saved."""
    return F.when(chunk_id != 0, F.concat(F.lit("id:"), chunk_id.cast("string"))).otherwise(F.concat(F.lit("doc:"), document_id.cast("string"), F.lit("#"), ordinal.cast("string")))


def index_text(heading: Column, content: Column) -> Column:
    """What is indexed and embedded: heading, line end, content; content alone without a heading."""
    return F.when(F.coalesce(heading, F.lit("")) == "", content).otherwise(F.concat(heading, F.lit("\n"), content))
