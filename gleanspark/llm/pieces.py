"""SentencePiece encoding of merge-type vocabularies by a score-ordered agenda, and decoding."""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import chain
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gleanspark.llm.store import held, plain

SPACE = "▁"
#: Chunks whose ids a worker remembers.
REMEMBERED = 500_000
# types of pieces in the model file
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


_ids, _names = itemgetter(0), itemgetter(1)


class Known(dict):
    """Ids of chunks, and the same as decimals joined by commas; emptied when it holds too many."""

    def __init__(self, model: MergeModel):
        super().__init__()
        self.model = model

    def __missing__(self, chunk: str) -> tuple[tuple[int, ...], str]:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = tuple(self.model.chunk_ids(chunk))
        self.model.new[chunk] = ids
        got = ids, ",".join(map(str, ids))
        if len(chunk) < 64:
            self[chunk] = got
        return got


class MergeModel:
    """A merge-type vocabulary with byte fallback and an identity normaliser, read from a SentencePiece model file."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        normal = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or normal.precompiled_charsmap or normal.remove_extra_whitespaces or model.trainer_spec.treat_whitespace_as_suffix or any(p.type in (USER, UNUSED) for p in model.pieces):
            raise ValueError("only merge-type models with an identity normaliser and no pieces of the user's are handled")
        self.library = SentencePieceProcessor(model_file=path)
        self.prefix = SPACE if normal.add_dummy_prefix else ""
        self.escape = normal.escape_whitespaces
        self.names = [p.piece for p in model.pieces]
        self.types = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        place = {x: i for i, x in enumerate(sorted({p.score for p in model.pieces if p.type == NORMAL}, reverse=True))}
        #: Places in the order of scores, best first, equal for equal scores.
        self.ranks = {p.piece: place[p.score] for p in model.pieces if p.type == NORMAL}
        self.bytes = {int(p.piece[3:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, t in enumerate(self.types) if t == UNKNOWN)
        if any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.ids):
            raise ValueError("only models without pieces across words or lines are handled")
        letter, odd = re.compile(r"[^\W\d_]"), set()
        for p in self.ids:
            for a, b in zip(p, p[1:]):
                if SPACE not in (a, b) and bool(letter.match(a)) != bool(letter.match(b)):
                    odd |= {x for x in (a, b) if letter.match(x)}
        letters, others = rf"[^\W\d_{''.join(odd)}]", rf"(?:[\W\d_{''.join(odd)}](?<![{SPACE}\n]))"
        letter = re.compile(letters)
        apart = all(bool(letter.match(a)) == bool(letter.match(b)) for p in self.ids for a, b in zip(p, p[1:]) if SPACE not in (a, b))
        #: No merge crosses the ends of these. Where no piece has letters beside other characters, they are apart as well.
        self.chunk = re.compile(rf"\n|{SPACE}*{letters}+|{SPACE}*{others}+|{SPACE}+" if apart else f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
        self.new: dict[str, tuple[int, ...]] = {}
        self.known = Known(self)

    def merge(self, chunk: str) -> list[str]:
        """The symbols of ``chunk`` after all merges: best score first, the leftmost of equals."""
        symbols: list[str] = list(chunk)
        n = len(symbols)
        if n == 1:
            return symbols
        ranks, after, before = self.ranks, [*range(1, n), -1], [*range(-1, n - 1)]
        # an entry is a rank and a place; whether its pair is still there is seen when it comes up
        agenda = [ranks[p] << 32 | i for i, p in enumerate(map(str.__add__, symbols, symbols[1:])) if p in ranks]
        heapq.heapify(agenda)
        push, pop = heapq.heappush, heapq.heappop
        while agenda:
            entry = pop(agenda)
            left = entry & 0xFFFFFFFF
            right = after[left]
            if right < 0 or not symbols[left]:
                continue
            piece = symbols[left] + symbols[right]
            if ranks.get(piece, -1) != entry >> 32:
                continue
            symbols[left], symbols[right] = piece, ""
            follow = after[left] = after[right]
            if follow >= 0:
                before[follow] = left
                pair = piece + symbols[follow]
                if pair in ranks:
                    push(agenda, ranks[pair] << 32 | left)
            prior = before[left]
            if prior >= 0:
                pair = symbols[prior] + piece
                if pair in ranks:
                    push(agenda, ranks[pair] << 32 | prior)
        return [s for s in symbols if s]

    def chunk_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for symbol in self.merge(chunk):
            i = self.ids.get(symbol)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in symbol.encode()]
            else:
                out.append(self.unknown)
        return out

    def encode(self, text: str) -> tuple[list[int], str]:
        """Ids of ``text``, and the same as decimals joined by commas."""
        if not text:
            return [], ""
        text = self.prefix + (text.replace(" ", SPACE) if self.escape else text)
        parts = list(map(self.known.__getitem__, self.chunk.findall(text)))
        return list(chain.from_iterable(map(_ids, parts))), ",".join(map(_names, parts))

    def check_new(self) -> None:
        """Holds the chunks that were new since the last call against the library, all in one text.

        Texts are encoded chunk by chunk, so what is right for each of these is right for the texts. Each stands on
        a line of its own, where no merge can reach its neighbours.
        """
        if not self.new:
            return
        line = self.chunk_ids("\n")
        ids = [*self.chunk_ids(self.prefix)]
        for own in self.new.values():
            ids += line
            ids += own
        text = ["", *self.new]
        theirs = self.library.encode("\n".join(text))
        if theirs != ids:
            raise ValueError(f"the sentencepiece library encodes one of {list(self.new)[:20]!r} ... otherwise")
        self.new.clear()

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``: pieces joined, spaces restored, runs of byte pieces read as UTF-8, the first space dropped."""
        out: list[str] = []
        run = bytearray()
        for i in [*ids, -1]:
            kind = self.types[i] if i >= 0 else CONTROL
            if kind == BYTE:
                run.append(int(self.names[i][3:-1], 16))
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if kind == UNKNOWN:
                out.append(" ⁇ ")
            elif kind == NORMAL:
                piece = self.names[i].replace(SPACE, " ")
                out.append(piece[1:] if not out and self.prefix and piece.startswith(" ") else piece)
        return "".join(out)


def _utf8(run: bytes) -> str:
    """Bytes as text; each that belongs to no whole character becomes a replacement character."""
    out, at = [], 0
    while at < len(run):
        for width in (1, 2, 3, 4):
            try:
                out.append(run[at : at + width].decode())
                at += width
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def merge_model(path: str) -> MergeModel:
    return held(("pieces", path), lambda: MergeModel(path))


_SCHEMA = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])


def _encode(path: str, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = merge_model(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids, names = zip(*map(model.encode, texts))
                model.check_new()
                decoded = model.library.decode(list(ids), num_threads=1)
                digest = [[hashlib.sha256(x.encode()).hexdigest() for x in column] for column in (names, decoded)]
                columns = [pa.array(list(map(len, ids)), pa.int64()), pa.array(digest[0]), pa.array(digest[1])]
                if keep:
                    columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded)]
                yield pa.RecordBatch.from_arrays([part.column("id"), *columns], ["id", *_SCHEMA.names[: len(columns)]])

    return run


def encode_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """One row per row of ``docs``: its id, n_tokens, ids_sha256, decoded_sha256 and, with ``keep``, ids and decoded.

    Each whole text is encoded by merging adjacent symbols in the order of their scores; what is new in each
    Arrow batch is held against the sentencepiece library, and a difference stops the job. Null and empty texts have no ids. Rows are
    handled one by one: null ids, ties and repeated rows need no care, an empty table gives an empty result, other
    columns are ignored. No shuffle.
    """
    source = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    id_type = source.schema["id"].dataType.simpleString()
    kinds = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return source.mapInArrow(_encode(path, keep), f"id {id_type}, {kinds}").withColumnRenamed("id", id_col)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_pieces(spark, sf_dir: str) -> DataFrame:
    return encode_pieces(plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"), vocabulary())
