"""Encoding and decoding with a SentencePiece vocabulary of merge type, by a table over the prefixes of a text.

Under merges by score the encoding of a text is such that each prefix of it has exactly one token that can stand last:
the token t that ends there, with p the last token of the prefix before t, so that the merges of p's and t's characters
alone give p and t again. An automaton over the vocabulary finds all tokens that end at a place; the first one compatible
with the table's entry before it is that prefix's. The ids are read backwards from the table's end. Time and memory are
linear in a text, however long.

No piece of the vocabulary goes on from another character to the mark of a space, so a text falls into stretches
that begin at such marks; a stretch's ids are remembered, as words come again and again. A vocabulary for which this
doesn't hold is encoded in one stretch. A character that no piece holds becomes its UTF-8 bytes' pieces.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import spread, table
from loam.llm.tokens import map_texts, vocabulary_path

VOCABULARY = "piece_bpe_32k.model"
SPACE = "▁"
#: What a worker remembers: stretches of text up to a length (twice so many: those met since the last full measure, and
#: those before it), and pairs of tokens.
STRETCHES, LENGTH, PAIRS = 120_000, 64, 300_000
#: Stands before the first token and after a character without a piece: nothing that a token could merge with.
NONE = -1
#: A prefix that ends with such a character, and the empty one.
UNKNOWN = (NONE, 1)


class Pieces:
    """A vocabulary: pieces with their scores, the bytes' ids, the begin and end ids."""

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        self.begin, self.end = model.bos_id(), model.eos_id()
        self.text = [model.id_to_piece(i) for i in range(count)]
        self.byte = {int(self.text[i][3:5], 16): i for i in range(count) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte.items()}
        self.silent = {i for i in range(count) if model.is_control(i)}
        self.unknown = model.unk_id()
        special = {*self.byte_of, *self.silent, self.unknown}
        own = [i for i in range(count) if i not in special and self.text[i]]
        self.id = {self.text[i]: i for i in own}
        self.score = {self.text[i]: model.get_score(i) for i in own}
        self.apart = not any(re.search(f"[^{SPACE}]{SPACE}", piece) for piece in self.id)
        self.ends = ahocorasick.Automaton()
        for piece, i in self.id.items():
            self.ends.add_word(piece, (i, len(piece)))
        self.ends.make_automaton()
        self.courses: dict[int, tuple[list[float], list[str], list[str]] | None] = {}
        self.pairs: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def course(self, token: int) -> tuple[list[float], list[str], list[str]] | None:
        """How a piece comes about from its characters, which are merged by best score, the first of equals: the merges' scores
        in turn, and which parts stand at its left and right edge before each and at last. None for a piece that other
        merges keep from coming about."""
        if token not in self.courses:
            self.courses[token] = self._course(self.text[token])
        return self.courses[token]

    def _course(self, piece: str) -> tuple[list[float], list[str], list[str]] | None:
        parts = list(piece)
        scores, left, right = [], [parts[0]], [parts[-1]]
        while len(parts) > 1:
            unions = [self.score.get(a + b) for a, b in pairwise(parts)]
            best = max((s for s in unions if s is not None), default=None)
            if best is None:
                return None
            at = unions.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            scores.append(best)
            left.append(parts[0])
            right.append(parts[-1])
        return scores, left, right

    def compatible(self, one: int, two: int) -> bool:
        """Whether the merges of both tokens' characters give these two tokens; with ``NONE`` before it, whether a piece's own
        characters merge to it. Both run side by side by score until a merge across their border is better than either's
        next (then they don't stay apart), or all are done."""
        found = self.pairs.get(one << 32 | two)
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[one << 32 | two] = self.course(two) is not None and (one == NONE or self._apart(one, two))
        return found

    def _apart(self, one: int, two: int) -> bool:
        a, b = self.course(one), self.course(two)
        if a is None or b is None:
            return False
        i = j = 0
        while True:
            across = self.score.get(a[2][i] + b[1][j])
            first = a[0][i] if i < len(a[0]) else None
            second = b[0][j] if j < len(b[0]) else None
            # of equal scores the merge further left comes first
            if across is not None and (first is None or across > first) and (second is None or across >= second):
                return False
            if first is None and second is None:
                return True
            if second is None or (first is not None and first >= second):
                i += 1
            else:
                j += 1

    def stretch(self, text: str) -> bytes:
        """Ids of a text that is encoded for itself, as unsigned 32-bit bytes, lowest byte first.

        The table holds the automaton's own (token, length) of each prefix. Where no match ends, a character is unknown.
        """
        last: list[tuple[int, int] | None] = [UNKNOWN, *[None] * len(text)]
        pairs, compatible = self.pairs, self.compatible
        for at, value in self.ends.iter(text):
            if last[at + 1] is None:
                token, length = value
                start = at + 1 - length
                before = last[start]
                if before is None and text[start - 1] not in self.id:
                    before = last[start] = UNKNOWN
                if before is not None:
                    fits = pairs.get(before[0] << 32 | token)
                    if compatible(before[0], token) if fits is None else fits:
                        last[at + 1] = value
        ids: list[int] = []
        place = len(text)
        while place:
            value = last[place]
            if value is None and text[place - 1] in self.id:
                raise ValueError("a prefix without a last token: these pieces aren't of merge type")
            if value is None or value is UNKNOWN:
                ids.extend(self.byte[b] for b in reversed(text[place - 1].encode())) if self.byte else ids.append(self.unknown)
                place -= 1
            else:
                ids.append(value[0])
                place -= value[1]
        return array("I", reversed(ids)).tobytes()

    def encode(self, text: str) -> bytes:
        """All ids of a text with the begin and end ids, as unsigned 32-bit bytes, lowest byte first."""
        made = [self.begin.to_bytes(4, "little")]
        if text:
            marked = SPACE + text.replace(" ", SPACE)
            for part in re.findall(f"{SPACE}+[^{SPACE}]*", marked) if self.apart else [marked]:
                ids = self.known.get(part)
                if ids is None:
                    ids = self.older.get(part)
                    if ids is None:
                        ids = self.stretch(part)
                    if len(part) <= LENGTH:
                        if len(self.known) >= STRETCHES:
                            self.known, self.older = {}, self.known
                        self.known[part] = ids
                made.append(ids)
        made.append(self.end.to_bytes(4, "little"))
        return b"".join(made)

    def decode(self, ids: bytes) -> str:
        """The text of ids: pieces side by side, marks as spaces, without the one that stands before every text. Runs of byte
        pieces are read as UTF-8, a byte that belongs to no character as U+FFFD; control ids have no text."""
        made: list[str] = []
        run = bytearray()
        for i in array("I", ids):
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                made.append(spelled(bytes(run)))
                run.clear()
            if i not in self.silent:
                made.append(" ⁇ " if i == self.unknown else self.text[i])
        if run:
            made.append(spelled(bytes(run)))
        first = next((i for i, part in enumerate(made) if part), None)
        if first is not None and made[first].startswith(SPACE):
            made[first] = made[first][1:]
        return "".join(made).replace(SPACE, " ")


def spelled(data: bytes) -> str:
    """UTF-8 bytes as text, each byte that doesn't belong to a character as U+FFFD."""
    made = []
    while data:
        try:
            made.append(data.decode())
            break
        except UnicodeDecodeError as e:
            made.append(data[: e.start].decode() + "\ufffd")
            data = data[e.start + 1 :]
    return "".join(made)


_LOADED: dict[str, Pieces] = {}


def vocabulary(path: str) -> Pieces:
    """One vocabulary for each worker process and file."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids) for every row: ids with begin and end, as unsigned 32-bit bytes, lowest byte first.

    Null and empty texts have the begin and end ids alone. Repeated rows come out as often as they go in, equal texts with
    equal ids; very long texts are encoded whole; other columns are left out whatever their names; an empty table gives
    an empty table.
    """
    path = path or vocabulary_path(VOCABULARY)

    def row(doc_id: object, text: str) -> list[tuple]:
        ids = vocabulary(path).encode(text)
        return [(doc_id, len(ids) // 4, ids)]

    return map_texts(docs, row, "doc_id long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for every row: ``decoded(encoded(docs))`` in one pass, so a task has one worker with one
    vocabulary in memory."""
    path = path or vocabulary_path(VOCABULARY)

    def row(doc_id: object, text: str) -> list[tuple]:
        pieces = vocabulary(path)
        ids = pieces.encode(text)
        return [(doc_id, len(ids) // 4, ids, pieces.decode(ids))]

    return map_texts(docs, row, "doc_id long, n_tokens long, ids binary, decoded string")


def decoded(rows: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of rows as ``encoded`` gives them; null ids give an empty text."""
    path = path or vocabulary_path(VOCABULARY)
    fields = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = vocabulary(path)
            texts = [pieces.decode(ids.as_py() or b"") for ids in batch.column(2)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(texts, pa.string())], schema=fields)

    return rows.select("doc_id", "n_tokens", "ids").mapInArrow(work, "doc_id long, n_tokens long, ids binary, decoded string")


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = round_trip(spread(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
