"""Toxicity by a counterfactual-regularised linear classifier.

A document's features are the words in it and their first four, five and six letters (stems,
for languages that inflect and compound). The model is logistic regression on those features
that tell the classes apart best. Where a labelled text names a group of people, a copy of it
is made in which the term is swapped for another of its kind, and the squared change of score
between the two is penalised; so the weights cannot rest on who is mentioned, and neutral
mentions of groups that occur in much abuse are not taken for abuse.

Fitting uses at most ``FIT_ROWS`` labelled documents of each class, those with the smallest
hashes of their ids, weighted so that the classes keep their shares; counts by feature are
summed by Spark, and the driver gets the chosen features of the sample only. Scoring reads
every text whole and shuffles nothing.

Rules for odd input: null texts count as empty, and a text without known features gets the
score of the bias; labels that are null are ignored, of contradicting ones toxic counts; if
one of the classes has no labels, every score is the share of toxic ones (0 without labels);
repeated rows and null ids are scored like others; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strikeline.llm.arrow_rows import mapped
from strikeline.llm.common import filled, ship
from strikeline.session import cut_lineage

FIT_ROWS = 6000
MAX_FEATURES = 1000
LEAST_TEXTS = 3
RIDGE = 0.004
COUNTERFACTUAL = 1.0
STEPS = 400
_WORD = re.compile(r"[^\W\d_]+")
_STEMS = (4, 5, 6)
#: Words of which a worker keeps the features.
_CACHE = 100_000

#: Terms for groups of people by kind; a term is swapped for the next of its list (fixed values).
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"),
    ("female", "male", "transgender"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("gay", "lesbian", "straight", "bisexual"), ("gays", "lesbians", "heterosexuals"),
    ("black", "white", "asian", "latino", "arab"),
    ("blacks", "whites", "asians", "latinos", "arabs"),
    ("immigrants", "refugees", "foreigners", "natives"),
    ("immigrant", "refugee", "foreigner", "native"),
    ("americans", "mexicans", "africans", "europeans", "chinese", "indians"),
    ("disabled", "blind", "deaf"), ("old", "young"), ("poor", "rich"),
    ("femmes", "hommes"), ("musulmans", "chrétiens", "juifs"), ("immigrés", "réfugiés"),
    ("frauen", "männer"), ("muslime", "christen", "juden"), ("flüchtlinge", "ausländer"),
    ("mujeres", "hombres"), ("musulmanes", "cristianos", "judíos"), ("inmigrantes", "refugiados"),
)
_SWAP = {t: kind[(i + 1) % len(kind)] for kind in IDENTITY_TERMS for i, t in enumerate(kind)}


def words_of(text: str) -> set[str]:
    return set(_WORD.findall(text.lower()))


def features_of_word(word: str) -> list[str]:
    """The word, and stems of it, which are marked by a hyphen."""
    return [word, *(f"{word[:n]}-" for n in _STEMS if len(word) > n)]


def features_of(words: set[str]) -> set[str]:
    return {f for w in words for f in features_of_word(w)}


def swapped(words: set[str]) -> set[str]:
    return {_SWAP.get(w, w) for w in words}


@dataclass(frozen=True)
class Model:
    weights: dict[str, float]
    bias: float
    #: The score of every text if nothing could be learned, else None.
    constant: float | None = None

    def score(self, text: str) -> float:
        if self.constant is not None:
            return self.constant
        found = features_of(words_of(text)) & self.weights.keys()
        return _sigmoid(self.bias + sum(sorted(self.weights[f] for f in found)))


def _sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-x)) if x >= 0 else math.exp(x) / (1 + math.exp(x))


def held_out(id_column: Column) -> Column:
    """Whether a row's label is kept from fitting: crc32 of the id as text divides by five."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit(""))) % 5 == 0


def training_sample(
    docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS,
    id_column: str = "doc_id", text: str = "text", label: str = "toxic",
) -> tuple[DataFrame, tuple[int, int]]:
    """Words of the sampled documents (toxic, words, swapped), one row per id, and how many labels of each
    class (0, 1) there are. The sample's ids, at most two times ``rows``, are broadcast."""
    ship(docs.sparkSession)
    known = (
        labels.where(F.col(label).isNotNull() & F.col(id_column).isNotNull())
        .where(~held_out(F.col(id_column)))
        .groupBy(F.col(id_column).alias("id")).agg(F.max(F.col(label).cast("int")).alias("toxic"))
    )
    known = cut_lineage(known)
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    chosen = [
        known.where(F.col("toxic") == y).orderBy(F.xxhash64("id"), "id").limit(rows) for y in (0, 1)
    ]
    sample = cut_lineage(chosen[0].unionByName(chosen[1]))
    texts = docs.select(F.col(id_column).alias("id"), filled(text).alias("text")).join(
        F.broadcast(sample), "id"
    )
    # of rows that repeat an id the one with the smallest hash of its text
    texts = texts.groupBy("id", "toxic").agg(
        F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    )

    def work(batch: dict[str, list]) -> dict[str, list]:
        found = [words_of(t) for t in batch["text"]]
        return {
            "toxic": batch["toxic"],
            "features": [sorted(features_of(w)) for w in found],
            "swapped": [
                sorted(features_of(swapped(w))) if w & _SWAP.keys() else None for w in found
            ],
        }

    schema = pa.schema([
        ("toxic", pa.int32()), ("features", pa.list_(pa.string())),
        ("swapped", pa.list_(pa.string())),
    ])
    return cut_lineage(texts.select("toxic", "text").mapInArrow(
        mapped(work, schema), "toxic int, features array<string>, swapped array<string>"
    )), (counts.get(0, 0), counts.get(1, 0))


def chosen_features(sample: DataFrame, most: int = MAX_FEATURES) -> list[str]:
    """Features whose shares in the classes differ most (by chi square), and all those that
    swapping changes."""
    sizes = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    counted = (
        sample.select("toxic", F.explode("features").alias("feature")).groupBy("feature")
        .agg(F.sum(F.col("toxic")).alias("c1"), F.sum(1 - F.col("toxic")).alias("c0"))
    )
    share = (F.col("c0") + F.col("c1")) / float(n0 + n1)
    gap = F.col("c1") / float(n1) - F.col("c0") / float(n0)
    chi = gap * gap / (share * (1.0 - share) + 1e-9)
    best = (
        counted.where((F.col("c0") + F.col("c1")) >= LEAST_TEXTS)
        .orderBy(chi.desc(), "feature").limit(most).select("feature")
    )
    terms = sorted(features_of(set(_SWAP)))
    named = counted.where(F.col("feature").isin(terms)).select("feature")
    return sorted({r.feature for r in best.unionByName(named).collect()})


def _sums(index: np.ndarray, starts: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sum of the weights of each row's features."""
    total = np.concatenate([[0.0], np.cumsum(w[index])])
    return total[starts[1:]] - total[starts[:-1]]


def _rows(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    starts = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)
    flat = [i for x in lists for i in x]
    return np.array(flat, np.int64), starts


def solve(
    rows: list[list[int]], toxic: list[int], pairs: list[tuple[list[int], list[int]]],
    shares: tuple[float, float], size: int, ridge: float = RIDGE,
    counterfactual: float = COUNTERFACTUAL, steps: int = STEPS,
) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated gradient descent on the sample (numbers of features).

    ``pairs``: features of a text and of its swapped copy; ``shares``: of the classes.
    """
    index, starts = _rows(rows)
    owner = np.repeat(np.arange(len(rows)), np.diff(starts))
    y = np.array(toxic, float)
    weight = np.where(y > 0, shares[1] / max(y.sum(), 1), shares[0] / max((1 - y).sum(), 1))
    left, left_at = _rows([sorted(set(a) - set(b)) for a, b in pairs])
    right, right_at = _rows([sorted(set(b) - set(a)) for a, b in pairs])
    left_of = np.repeat(np.arange(len(pairs)), np.diff(left_at))
    right_of = np.repeat(np.arange(len(pairs)), np.diff(right_at))
    w, b = np.zeros(size), math.log(shares[1] / shares[0])
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(_sums(index, starts, w) + b, -50, 50)))
        error = (p - y) * weight
        grad = np.bincount(index, error[owner], size) + ridge * w / max(len(rows), 1) ** 0.5
        if pairs:
            change = _sums(right, right_at, w) - _sums(left, left_at, w)
            scale = 2 * counterfactual / len(pairs)
            grad += scale * np.bincount(right, change[right_of], size)
            grad -= scale * np.bincount(left, change[left_of], size)
        whole = np.concatenate([grad, [error.sum()]])
        m = 0.9 * m + 0.1 * whole
        v = 0.999 * v + 0.001 * whole * whole
        rate = 0.05 * (1 - step / (steps + 1))
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def fit(
    docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, counterfactual: float = COUNTERFACTUAL,
    id_column: str = "doc_id", text: str = "text", label: str = "toxic",
) -> Model:
    sample, (n0, n1) = training_sample(docs, labels, rows, id_column, text, label)
    if not n0 or not n1 or sample.select("toxic").distinct().count() < 2:
        return Model({}, 0.0, n1 / (n0 + n1) if n1 else 0.0)
    features = chosen_features(sample)
    number = {f: i for i, f in enumerate(features)}

    def numbered(batch: dict[str, list]) -> dict[str, list]:
        def of(names: list[str] | None) -> list[int] | None:
            return None if names is None else [number[f] for f in names if f in number]

        return {
            "toxic": batch["toxic"], "features": [of(x) for x in batch["features"]],
            "swapped": [of(x) for x in batch["swapped"]],
        }

    schema = pa.schema([
        ("toxic", pa.int32()), ("features", pa.list_(pa.int32())), ("swapped", pa.list_(pa.int32())),
    ])
    known = sample.mapInArrow(
        mapped(numbered, schema), "toxic int, features array<int>, swapped array<int>"
    ).collect()  # the bounded sample, by number of chosen feature
    known.sort(key=lambda r: (r.toxic, r.features))  # the same model however rows were dealt
    w, b = solve(
        [r.features for r in known], [r.toxic for r in known],
        [(r.features, r.swapped) for r in known if r.swapped is not None],
        (n0 / (n0 + n1), n1 / (n0 + n1)), len(features), counterfactual=counterfactual,
    )
    return Model({f: float(x) for f, x in zip(features, w, strict=True) if x}, b)


def scored(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """``docs`` with a column for the score, which none of its own may be named; all columns
    but the text go through Arrow as they are."""
    ship(docs.sparkSession)
    names = docs.columns
    schema = docs.withColumn(column, F.lit(0.0)).schema
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        weights = model.weights

        def score(value: str | None) -> float:
            if model.constant is not None:
                return model.constant
            found: set[str] = set()
            for w in words_of(value or ""):
                features = known.get(w)
                if features is None:
                    features = known[w] = tuple(f for f in features_of_word(w) if f in weights)
                found.update(features)
            return _sigmoid(model.bias + sum(sorted(weights[f] for f in found)))

        for batch in batches:
            if len(known) > _CACHE:
                known.clear()
            scores = pa.array([score(x.as_py()) for x in batch.column(at)], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], [*names, column])

    return docs.mapInArrow(run, schema)


def report(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted (1 from 0.5 on)."""
    model = fit(docs, labels, id_column=id_column, text=text)
    slim = docs.select(F.col(id_column).alias("doc_id"), F.col(text).alias("text"))
    return scored(slim, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def without_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, with their own columns."""
    column = "score"
    while column in docs.columns:
        column += "_"
    return scored(docs, model, text, column).where(F.col(column) < threshold).drop(column)
