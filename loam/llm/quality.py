"""Quality by co-training: a classifier of the text's content and one of its page metadata teach each other.

Both views are small numeric vectors. Starting from the labelled sample, each view is fitted; in every round each looks
through all unlabelled documents for those it is sure of, and ``TEACH`` of them, good and bad in the labels' proportion,
join the other view's training rows as pseudo-labels. At last both views are calibrated on held-out folds of the labelled
rows and combined by a logistic regression over the two; every document gets the combined score. The views share no
evidence: one sees the text alone, the other language, source and stated length alone.

The classifiers are fitted on the driver, on at most ``SAMPLE`` labelled rows' vectors and on the pseudo-labels. The vectors of
all unlabelled documents are written once; each round's search for sure ones and the scoring run over all of them in tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.llm.common import cut, place, spread, table, text_of
from loam.llm.learning import Logistic, folds, sigmoid

#: Bound on the labelled rows that the classifiers are fitted on, and on the pseudo-labels that a view gives in a round.
SAMPLE, TEACH = 12_000, 500
ROUNDS = 5
#: Labelled rows without which no classifier is fitted: in all, and of each class.
LEAST, LEAST_CLASS = 12, 6
#: Log odds from which a view is sure enough to teach the other.
SURE = 2.0
#: A document is kept from this score on.
KEEP = 0.5
LANGS, SOURCES = 8, 32

_CLASSES = [
    np.isin(np.arange(256), list(chars))
    for chars in (
        b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\n\r\x0b\x0c", b".,;:'\"()-", b"!", b"?",
        b"#$%&*@^~", b"|", b"<>{}[]=+_\\/`", bytes(range(128, 256)),
    )
]


def text_view(text: str) -> list[float]:
    """Shares of character classes, and how words and lines look and repeat."""
    data = text.encode()
    size = max(len(data), 1)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    shares = [float(counts[own].sum()) / size for own in _CLASSES]
    words = data.split()
    n = max(len(words), 1)
    distinct = len(set(words))
    lines = [x for x in data.split(b"\n") if x]
    letters = max(shares[0] + shares[1] + shares[10], 1e-6)
    return [
        *shares, shares[1] / letters, np.log1p(len(words)), distinct / n, (len(data) - shares[3] * size) / n, np.log1p(max(map(len, words), default=0)),
        1 - len(set(lines)) / max(len(lines), 1), float(counts[46]) / n, float(counts[33]) / n, shares[7] * size / n, shares[8] * size / n,
        float(not words), min(len(words), 20) / 20,
    ]


def meta_view(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Language, source and stated length; nothing of the text itself."""
    marks = [0.0] * (LANGS + SOURCES)
    marks[zlib.crc32((lang or "").encode()) % LANGS] = 1.0
    marks[LANGS + zlib.crc32((source or "").encode()) % SOURCES] = 1.0
    stated = np.log1p(max(n_chars or 0, 0))
    return [*marks, float(lang is None), float(source is None), float(n_chars is None), stated, stated**2]


N_TEXT = len(text_view(""))
WIDTH = N_TEXT + len(meta_view(None, None, None))


@dataclass
class CoTrained:
    """Both views' classifiers, their calibrations and the combination; ``prior`` alone if one class only is labelled."""

    prior: float
    text: Logistic | None = None
    meta: Logistic | None = None
    text_fit: Logistic | None = None
    meta_fit: Logistic | None = None
    both: Logistic | None = None

    def scores(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated text score, metadata score and combined score of rows of features."""
        if self.both is None or not len(x):
            same = np.full(len(x), self.prior)
            return same, same, same
        a = self.text_fit.logit(self.text.logit(x[:, :N_TEXT])[:, None])
        b = self.meta_fit.logit(self.meta.logit(x[:, N_TEXT:])[:, None])
        return sigmoid(a), sigmoid(b), sigmoid(self.both.logit(np.column_stack([a, b])))


_VIEWS = (slice(0, N_TEXT), slice(N_TEXT, None))
#: (places, features, marks) that a view is sure of, for each view.
Sure = list[tuple[np.ndarray, np.ndarray, np.ndarray]]


def _kept(x: np.ndarray, places: np.ndarray, models: list[Logistic], used: list[np.ndarray], most: list[float]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(view, mark, row numbers): rows that a view is sure of and hasn't taught yet, at most ``most`` of a mark, least places first."""
    for v in (0, 1):
        logit = models[v].logit(x[:, _VIEWS[v]])
        free = ~np.isin(places, used[v])
        for mark, hit in ((0, logit < -SURE), (1, logit > SURE)):
            rows = np.flatnonzero(hit & free)
            rows = rows[np.argsort(places[rows], kind="stable")]
            yield v, mark, rows if most[mark] == np.inf else rows[: int(most[mark])]


def sure_of(pool: np.ndarray) -> Callable[[list[Logistic], list[np.ndarray], list[float]], Sure]:
    """Sure rows of an array of unlabelled rows' features."""
    places = np.arange(len(pool), dtype=float)

    def find(models: list[Logistic], used: list[np.ndarray], most: list[float]) -> Sure:
        found: list = [[], []]
        for v, mark, rows in _kept(pool, places, models, used, most):
            found[v].append((places[rows], pool[rows], np.full(len(rows), float(mark))))
        return [tuple(np.concatenate(part) for part in zip(*own, strict=True)) for own in found]

    return find


def sure_in(vectors: DataFrame) -> Callable[[list[Logistic], list[np.ndarray], list[float]], Sure]:
    """Sure rows of all unlabelled documents (place, features): each task keeps the least places, of which the least of all
    come to the driver."""
    kinds = "view int, mark int, place double, features binary"

    def find(models: list[Logistic], used: list[np.ndarray], most: list[float]) -> Sure:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[tuple[int, int], list] = {}
            for batch in batches:
                if not batch.num_rows:
                    continue
                places, x = batch.column(0).to_numpy(zero_copy_only=False), _unpacked(batch.column(1))
                for v, mark, rows in _kept(x, places, models, used, most):
                    both = held.get((v, mark), []) + [(places[i], x[i].astype(np.float32).tobytes()) for i in rows]
                    held[v, mark] = both if most[mark] == np.inf else sorted(both)[: int(most[mark])]
            rows = [(v, mark, place, data) for (v, mark), own in held.items() for place, data in own]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int32(), pa.float64(), pa.binary()), strict=True)], names=["view", "mark", "place", "features"])

        place = F.row_number().over(Window.partitionBy("view", "mark").orderBy("place", "features"))
        bound = F.when(F.col("mark") == 0, F.lit(float(most[0]))).otherwise(F.lit(float(most[1])))
        rows = vectors.mapInArrow(work, kinds).withColumn("n", place).where(F.col("n") <= bound).orderBy("view", "mark", "n").collect()
        found = []
        for v in (0, 1):
            own = [r for r in rows if r.view == v]
            x = np.array([np.frombuffer(r.features, np.float32) for r in own], float).reshape(len(own), WIDTH)
            found.append((np.array([r.place for r in own]), x, np.array([float(r.mark) for r in own])))
        return found

    return find


def co_train(x: np.ndarray, y: np.ndarray, find: Callable | np.ndarray, teach: int | None = TEACH, rounds: int = ROUNDS, least: int = LEAST, least_class: int = LEAST_CLASS) -> CoTrained:
    """x, y: labelled rows; find: ``sure_in`` a table or ``sure_of`` an array of unlabelled rows, or such an array. In each round a
    view gives the other at most ``teach`` pseudo-labels, None all that it is sure of; they weigh half a true label.

    With fewer than ``least`` labelled rows, or ``least_class`` of a class, there is no classifier, only the labels' mean.
    """
    prior = float(y.mean()) if len(y) else 0.5
    if len(y) < least or min(y.sum(), (1 - y).sum()) < least_class:
        return CoTrained(prior)
    find = sure_of(find) if isinstance(find, np.ndarray) else find
    pseudo = [(np.empty((0, x.shape[1])), np.empty(0)) for _ in _VIEWS]
    used = [np.empty(0), np.empty(0)]
    most = [np.inf, np.inf] if teach is None else [max(1, round(teach * share)) for share in (1 - prior, prior)]

    def fit(v: int, rows: np.ndarray | slice = slice(None)) -> Logistic:
        more, marks = pseudo[v]
        weight = np.concatenate([np.ones(len(y[rows])), np.full(len(marks), 0.5)])
        return Logistic(np.concatenate([x[rows][:, _VIEWS[v]], more[:, _VIEWS[v]]]), np.concatenate([y[rows], marks]), weight)

    for _ in range(rounds):
        for v, (places, more, marks) in enumerate(find([fit(0), fit(1)], used, most)):
            if len(places):
                _, first = np.unique(places, return_index=True)  # equal rows teach once
                used[v] = np.concatenate([used[v], places[first]])
                rows, old = pseudo[1 - v]
                pseudo[1 - v] = (np.concatenate([rows, more[first]]), np.concatenate([old, marks[first]]))
    fold, held = folds(len(y)), np.zeros((len(y), 2))
    for k in range(fold.max() + 1):
        for v in (0, 1):
            held[fold == k, v] = fit(v, fold != k).logit(x[fold == k][:, _VIEWS[v]])
    fits = [Logistic(held[:, [v]], y) for v in (0, 1)]
    both = Logistic(np.column_stack([f.logit(held[:, [v]]) for v, f in enumerate(fits)]), y)
    return CoTrained(prior, fit(0), fit(1), *fits, both)


_COLUMNS = ("text", "lang", "source", "n_chars")


def _inputs(docs: DataFrame) -> list:
    kinds = {"n_chars": "long"}
    return [(F.col(c) if c in docs.columns else F.lit(None)).cast(kinds.get(c, "string")).alias(f"_{c}") for c in _COLUMNS]


def _matrix(batch: pa.RecordBatch, first: int) -> np.ndarray:
    """Features of a batch whose columns from ``first`` on are the inputs."""
    text, lang, source, n = (batch.column(first + i) for i in range(4))
    rows = []
    for i in range(batch.num_rows):
        own = text[i].as_py() or ""
        rows.append(text_view(own) + meta_view(lang[i].as_py(), source[i].as_py(), n[i].as_py()))
    return np.array(rows, float).reshape(batch.num_rows, -1)


def _unpacked(column: pa.Array) -> np.ndarray:
    """Rows of features from their bytes."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).astype(float).reshape(len(column), -1)


def _vectors(docs: DataFrame) -> DataFrame:
    """(doc_id, place, features as 32-bit bytes) of rows that have a column _place: in place of texts, what is joined and read again."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, 2).astype(np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([row.tobytes() for row in x], pa.binary())], names=["doc_id", "place", "features"])

    return docs.select(F.col("doc_id").cast("long"), "_place", *_inputs(docs)).mapInArrow(work, "doc_id long, place double, features binary")


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, teach: int | None = TEACH, least: int = LEAST, least_class: int = LEAST_CLASS) -> CoTrained:
    """Co-trains on ``docs`` with ``labels`` (doc_id, quality 0 or 1; null labels count as none, repeated ones by mean).

    Labels of documents that aren't in ``docs`` count for nothing. Rows equal in id and text count once. At most ``sample``
    labelled rows' vectors, chosen by hash of id and text, and ``teach`` pseudo-labels a view and round come to the driver;
    all unlabelled documents are looked through in each round. For ``least`` and ``least_class`` see ``co_train``.
    """
    docs = docs.select("doc_id", *(c for c in _COLUMNS if c in docs.columns)).withColumn("_place", place("quality", "doc_id", text_of()))
    marks = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.round(F.avg("quality")).cast("double").alias("y"))
    vectors = cut(_vectors(docs).join(marks, "doc_id", "left").select("doc_id", "place", "y", "features"))
    marked = vectors.where("y is not null")
    share = sample / max(marked.count(), 1)
    drawn = marked.where(F.col("place") < share).dropDuplicates(["doc_id", "place"]).orderBy("place").limit(sample).collect()
    rows = sorted((r.y, *np.frombuffer(r.features, np.float32).tolist()) for r in drawn)
    table_ = np.array(rows, float).reshape(-1, WIDTH + 1)
    pool = vectors.where("y is null").select("place", "features")
    return co_train(table_[:, 1:], table_[:, 0], sure_in(pool), teach, ROUNDS, least, least_class)


def scored(docs: DataFrame, model: CoTrained) -> DataFrame:
    """(doc_id, text_score, meta_score, score, keep) for every row of ``docs``.

    Scores lie between 0 and 1, higher is better; keep is 1 from ``KEEP`` on. A null text counts as empty; null or
    missing metadata are values of their own; very long texts count whole. Equal rows get equal scores. Other columns are left
    out whatever their names; an empty table gives an empty table. Where there were fewer labels than ``fit`` asks for, by
    default 12 and 6 of each class, the score is the labels' mean and every row is kept.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, both = model.scores(_matrix(batch, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (a, b, both))], names=["doc_id", "text_score", "meta_score", "score"])

    found = docs.select(F.col("doc_id").cast("long"), *_inputs(docs)).mapInArrow(work, "doc_id long, text_score double, meta_score double, score double")
    return found.withColumn("keep", F.lit(1) if model.both is None else (F.col("score") >= KEEP).cast("int"))


def kept(docs: DataFrame, model: CoTrained, threshold: float = KEEP) -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose score reaches the threshold; all rows where no classifier could be
    fitted. A null text is judged as an empty one, repeated rows alike, other columns may have any names, and an empty
    table gives an empty table."""
    if model.both is None:
        return docs

    @F.pandas_udf("double")
    def score(text, lang, source, n_chars):  # noqa: ANN001
        import pandas as pd

        batch = pa.RecordBatch.from_arrays([pa.array(c, k, from_pandas=True) for c, k in zip((text, lang, source, n_chars), (pa.string(), pa.string(), pa.string(), pa.int64()), strict=True)], names=list(_COLUMNS))
        return pd.Series(model.scores(_matrix(batch, 0))[2])

    return docs.where(score(*_inputs(docs)) >= threshold)


def op4_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    return scored(docs, fit(docs, table(spark, sf_dir, "labels")))
