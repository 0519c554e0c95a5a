"""Toxicity of restored texts: a noisy channel undoes leetspeak, spacing and repetition, then words are scored.

A writer who hides a word replaces letters by look-alikes, puts marks between them or repeats them. For a token that
shows such traces every character opens the ways it may have come about (a letter as it is, the letter a digit or mark
stands for, nothing at all), and the Viterbi algorithm finds the likeliest letters under a character trigram model of
all documents times the channel's costs. Runs of single letters are joined and decoded as one token.

Scores come from a logistic regression over the restored text's words and word beginnings; the words come from the
labelled rows that aren't held out, and neither labels, language, source nor doc_id enter a score.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import cut, place, spread, table, text_of
from loam.llm.learning import Logistic, SparseLogistic, sigmoid

#: Bound on the labelled rows that are fitted on; a model's size; words that a worker remembers.
SAMPLE, FEATURES, REMEMBERED = 12_000, 600, 150_000
#: A feature is looked at if it stands in so many of the sample's documents; a regression needs so many rows of each class.
LEAST, FEW = 5, 5
THRESHOLD = 0.3
#: Longer words are worked out each time they are met, so that what a worker remembers stays small.
REMEMBERED_LENGTH = 100

# What a mark may stand for.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
#: Natural logarithms of the channel: a look-alike, a mark between letters, a letter of three or more in a row or of
#: two dropped, a look-alike dropped.
SUBSTITUTED, SEPARATED, REPEATED, DOUBLED, DROPPED = -0.7, -0.3, -1.0, -5.0, -3.0
#: The other reading of a token that is mostly digits, as a number or code: a digit of ten, a change from digits to letters or back.
DIGIT, MIXED = -2.3, -2.0

#: Classes of the character model: 0 for what is no letter, 1 to 26 for a to z, 27 for other letters.
CLASSES = 28
_CLASS = np.zeros(256, np.int64)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[65:91] = np.arange(1, 27)
_CLASS[128:] = 27

_EDGES = ".,;:?\"'()[]{}<>*#%&~^|/\\=_-"
_ENDS = "".join(c for c in _EDGES if c not in LEET)
_MARKS = re.escape("".join(c for c in LEET if not c.isdigit()))
_PLAIN, _LOOKALIKE = re.compile("[a-z]"), re.compile(f"[0-9{_MARKS}]")
#: Repeats beyond what decides: a letter more than three times, a look-alike more than twice.
_LETTERS, _SAME = re.compile(r"([^\W\d_])\1{3,}"), re.compile(rf"([0-9{_MARKS}])\1{{2,}}")
_THRICE = re.compile(r"(\S)\1\1")
_TRACE = re.compile(r"(\w)\1\1|[a-z][.*_\-~']+[a-z]")
#: Amounts and signed numbers: no words, though every character of theirs is a look-alike.
_NUMBER = re.compile(r"[$€+(|!]*\d[\d.,:]*[)!+|€$]*")
#: Three or more single letters or look-alikes with separators between them, up to white space or marks before it.
_SPACED = re.compile(rf"""(?<![^\s"'(\[{{<])(?!_)[\w{_MARKS}](?:[ \t.*_~\-]++[\w{_MARKS}]){{2,}}(?=[^\w\s]*(?!\S))""")
_BETWEEN = re.compile(r"[ \t.*_~\-]+")


def char_counts(docs: DataFrame) -> DataFrame:
    """(code, n): how often each run of three character classes stands in all texts; counted by task, then added up."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CLASSES**3, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()):
                c = _CLASS[np.frombuffer(b"  " + (text.as_py() or b"") + b" ", np.uint8)]
                counts += np.bincount(c[:-2] * CLASSES**2 + c[1:-1] * CLASSES + c[2:], minlength=CLASSES**3)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["code", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(work, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def char_model(counts: Iterable[tuple[int, int]]) -> np.ndarray:
    """ln P(class | two classes before it) with interpolated smoothing, from (code, n)."""
    tri = np.zeros(CLASSES**3)
    for code, n in counts:
        tri[code] = n
    tri = tri.reshape(CLASSES, CLASSES, CLASSES)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + CLASSES)
    p2 = (bi + 5 * p1) / (bi.sum(axis=1, keepdims=True) + 5)
    return np.log((tri + 5 * p2) / (tri.sum(axis=2, keepdims=True) + 5))


def _class(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else 27 if c.isalpha() else 0


def decode(token: str, model: list) -> str:
    """The likeliest letters behind a lower-case token; model: ``char_model`` as nested lists. Linear in its length."""
    return _decoded(token, model)[0]


def as_number(token: str, model: list) -> float:
    """ln of how likely a token is as the number or code that it looks like."""
    total, a, b = 0.0, 0, 0
    for i, c in enumerate(token):
        k = _class(c)
        total += DIGIT if c.isdigit() else model[a][b][k]
        if i and c.isdigit() != token[i - 1].isdigit() and c.isalnum() and token[i - 1].isalnum():
            total += MIXED
        a, b = b, k
    return total


def _decoded(token: str, model: list) -> tuple[str, float]:
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # made: (letter, made before it)
    for i, c in enumerate(token):
        if c.isalpha():
            ways = [(c, 0.0)]
            if i and token[i - 1] == c:
                ways.append(("", REPEATED if c * 3 in token[max(0, i - 2) : i + 2] else DOUBLED))
        else:
            ways = [(x, SUBSTITUTED) for x in LEET.get(c, "")]
            if c not in LEET or not c.isdigit():  # a look-alike digit always stands for a letter
                ways.append(("", DROPPED if c in LEET else SEPARATED))
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (cost, made) in best.items():
            for letter, way in ways:
                if letter:
                    k = _class(letter)
                    state, total = (b, k), cost + way + model[a][b][k]
                else:
                    state, total = (a, b), cost + way
                if state not in new or new[state][0] < total:
                    new[state] = (total, (letter, made) if letter else made)
        best = new
    ends = [(cost + model[a][b][0], made) for (a, b), (cost, made) in best.items()]
    top = max(cost for cost, _ in ends)
    return max(_word(made) for cost, made in ends if cost == top), top


def _word(made: tuple | None) -> str:
    letters = []
    while made is not None:
        letters.append(made[0])
        made = made[1]
    return "".join(reversed(letters))


def _hidden(word: str) -> bool:
    """Whether a token shows traces of hiding and isn't mostly digits."""
    return bool(_TRACE.search(word) or (_LOOKALIKE.search(word) and (_PLAIN.search(word) or _marks_alone(word)))) and not _mostly_digits(word)


def _mostly_digits(word: str) -> bool:
    return 3 * sum(map(str.isdigit, word)) > 2 * len(word)


def _marks_alone(word: str) -> bool:
    marks = _LOOKALIKE.findall(word)
    return len(marks) >= 3 and len(set(marks)) >= 2 and not any(map(str.isalpha, word)) and not _NUMBER.fullmatch(word)


def restored(word: str, model: list) -> str:
    """A token without marks at its edges, decoded if it shows traces of hiding; one that is mostly digits, if its letters are
    likelier than the number or code that it looks like.

    Marks at its end that may stand for a letter are left to the decoder.
    """
    last = word[-1:]
    if last * 2 == word[-2:] and last not in LEET and not last.isalnum():
        word = word.rstrip(last)
    word = word.rstrip(_ENDS).lstrip(_EDGES)
    if _THRICE.search(word):
        short = _SAME.sub(r"\1\1", _LETTERS.sub(r"\1\1\1", word))
    elif word.isalpha():
        return word
    else:
        short = word
    if _hidden(short):
        return decode(short, model)
    if _mostly_digits(short):
        letters, likely = _decoded(short, model)
        if likely > as_number(short, model):
            return letters
    return word.rstrip("!+")


def restore(text: str, model: list) -> str:
    """The whole text in lower case with every token restored and spaced words joined."""
    joined = _SPACED.sub(lambda m: _BETWEEN.sub("", m[0]), text.lower())
    return re.sub(r"\S+", lambda m: restored(m[0], model) or m[0], joined)


def word_features(word: str) -> tuple[int, ...]:
    """Hashes of a restored word and of its beginnings."""
    return tuple(zlib.crc32(x.encode()) for x in ("w" + word, *(f"{n}{word[:n]}" for n in (4, 5, 7) if len(word) > n)))


@dataclass
class Words:
    """Distinct features of a text, remembering those of words already met; ``only`` limits them to the chosen."""

    model: list
    only: dict[int, int] | None = None
    known: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def _learn(self, word: str) -> tuple[int, ...]:
        found = restored(word, self.model)
        own = word_features(found) if found else ()
        if self.only is not None:
            own = tuple(self.only[f] for f in own if f in self.only)
        if len(self.known) >= REMEMBERED:
            self.known.clear()
        if len(word) <= REMEMBERED_LENGTH:
            self.known[word] = own
        return own

    def of(self, text: str) -> set[int]:
        lowered = text.lower()
        words = set(lowered.split())
        words.update(_BETWEEN.sub("", m[0]) for m in _SPACED.finditer(lowered))
        found: set[int] = set()
        for word in words:
            own = self.known.get(word)
            found.update(self._learn(word) if own is None else own)
        return found


@dataclass
class Scorer:
    chars: np.ndarray
    features: list[int]
    weights: np.ndarray
    bias: float

    def words(self) -> Words:
        return Words(self.chars.tolist(), {f: i for i, f in enumerate(self.features)})

    def score(self, words: Words, text: str) -> float:
        own = words.of(text)
        return float(sigmoid(np.array(self.bias + sum(self.weights[i] for i in own))))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int | None = FEATURES, least: int = LEAST, few: int = FEW) -> Scorer:
    """Fits on the labelled documents that aren't held out: at most ``sample`` of them, chosen by hash of id and text.

    The character model is counted over all documents. Labels of documents that aren't in ``docs`` count for nothing, and
    rows equal in id and text count once. The regression is over the ``features`` words and beginnings of the sample that
    tell the labels best, each in ``least`` of its documents or more; None takes all of these. The driver gets the character
    model's counts (a fixed number), those features and the sample's rows of them. With fewer than ``few`` labelled rows of a
    class there is no regression: every document's score is the share of toxic rows, one added to each class.
    """
    docs = docs.select("doc_id", "text")
    chars = char_model((r.code, r.n) for r in char_counts(docs).collect())
    marks = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.round(F.avg("toxic")).cast("int").alias("y")).where(~held_out(F.col("doc_id")))
    marked = docs.select("doc_id").join(marks, "doc_id").count()
    drawn = docs.withColumn("_place", place("toxic", "doc_id", text_of())).where(F.col("_place") < sample / max(marked, 1))
    known = cut(drawn.dropDuplicates(["doc_id", "_place"]).join(marks, "doc_id").select("y", "_place", F.col("text").cast("string").alias("text")))
    if known.count() > sample:
        known = known.where(F.col("_place") <= known.orderBy("_place").select("_place").limit(sample).agg(F.max("_place")).first()[0])
    known = known.select("y", "text")
    nested = chars.tolist()

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(nested)
        for batch in batches:
            per = [sorted(words.of(t.as_py() or "")) for t in batch.column(1)]
            y = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(p) for p in per])
            yield pa.RecordBatch.from_arrays([pa.array(y, pa.int32()), pa.array([f for p in per for f in p], pa.int64())], names=["y", "f"])

    sums = known.agg(F.count("*").alias("n"), F.sum("y").alias("ones")).first()
    n, ones = sums["n"], sums["ones"] or 0
    prior = float(np.log((ones + 1) / (n - ones + 1)))
    if min(ones, n - ones) < few:
        return Scorer(chars, [], np.empty(0), prior)
    per = known.mapInArrow(spread, "y int, f long").groupBy("f").agg(F.count("*").alias("df"), F.sum("y").alias("hits")).where(F.col("df") >= least)
    expected = F.col("df") * F.lit(ones / n)
    surprise = F.abs(F.col("hits") - expected) / F.sqrt(expected * F.lit(1 - ones / n))
    best = per.orderBy(F.desc(surprise), "f")
    chosen = [r.f for r in (best if features is None else best.limit(features)).select("f").collect()]  # of the sample's rows alone
    index = {f: i for i, f in enumerate(chosen)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(nested, index)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sorted(words.of(t.as_py() or "")) for t in batch.column(1)], pa.list_(pa.int32()))], names=["y", "own"])

    found = sorted((r.y, r.own) for r in known.mapInArrow(rows, "y int, own array<int>").collect())
    y = np.array([mark for mark, _ in found], float)
    if len(chosen) > FEATURES:
        model = SparseLogistic([own for _, own in found], y, len(chosen), ridge=4.0)
    else:
        x = np.zeros((len(found), len(chosen)))
        for i, (_, own) in enumerate(found):
            x[i, own] = 1
        model = Logistic(x, y, ridge=4.0)
    weights = model.beta[:-1] / model.scale
    return Scorer(chars, chosen, weights, float(model.beta[-1] - weights @ model.mean))


def scored(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``.

    A null text counts as empty; texts without words get the score of their absence; very long ones count whole. Equal texts
    get equal scores, all of them one score where no regression was fitted. A null doc_id isn't held out. Other columns
    are left out whatever their names; an empty table gives an empty table.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = scorer.words()
        for batch in batches:
            scores = [scorer.score(words, t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def restored_texts(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, restored): every whole text as the channel's decoder reads it."""
    nested = scorer.chars.tolist()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [restore(t.as_py() or "", nested) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "restored"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, "doc_id long, restored string")


def op9_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
