"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a short vector of transformed statistics (``FEATURES``). Per
class a mean and a covariance are estimated from Spark sums over every labelled
row; the covariance is shrunk first towards the pooled one (``towards_pooled``)
and then towards a multiple of the identity (``towards_sphere``). A score is the
difference of the two Gaussian log densities (Mahalanobis distances through
Cholesky factors kept in the model) plus the log prior odds, as a probability.

Defined cases: a null text counts as empty; an empty text has a vector like any
other and gets a score; label rows with a null id or a quality other than 0 and
1 teach nothing; a document with several label rows counts once for each; with
labelled rows of one class alone every score is the share of class 1 with one row
of either class added (near 0 or near 1), without any it is 0.5. Extra columns pass
through unless they bear an output's name, which is then replaced.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import few_at_a_time, persist_table

FEATURES = (
    "log_words", "log_word_length", "distinct_words", "top_word", "repeated_next", "upper", "digits",
    "symbols", "pipes", "exclaims", "stops", "not_ascii", "log_line_length", "repeated_lines",
)
D = len(FEATURES)
_CLASSES = np.zeros((256, 8))
for _k, _bytes in enumerate((range(65, 91), range(97, 123), range(48, 58), b"#*$%&<>@^~", b"|", b"!?", b".,;:", range(128, 256))):
    _CLASSES[list(_bytes), _k] = 1.0


def text_vector(text: str | None) -> np.ndarray:
    """The statistics of one whole text."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    n, size = len(words), max(1, len(data))
    upper, lower, digits, symbols, pipes, exclaims, stops, high = (
        np.bincount(np.frombuffer(data, np.uint8), minlength=256) @ _CLASSES if data else np.zeros(8))
    counts = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:])) if n > 1 else 0
    lines = [x for x in data.split(b"\n") if x.strip()]
    root = np.sqrt
    return np.array([
        np.log1p(n), np.log1p(size / max(1, n)), len(counts) / max(1, n) ** 0.9, root(max(counts.values(), default=0) / max(1, n)),
        root(same / max(1, n)), root(upper / max(1.0, upper + lower)), root(digits / size), root(symbols / size), root(pipes / size),
        root(exclaims / size), root(stops / max(1, n)), root(high / size), np.log1p(size / max(1, len(lines))),
        root(1 - len(set(lines)) / max(1, len(lines))),
    ])


def text_vectors(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, vector of every text, as a written table."""

    def work(batches):
        for batch in few_at_a_time(batches):
            vectors = [text_vector(x).tolist() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], [key, "vector"])

    return persist_table(docs.select(F.col(key).cast("long"), "text").mapInArrow(work, f"{key} long, vector array<double>"), "vectors")


@dataclass
class Model:
    """Means, Cholesky factors and prior odds; without ``means`` there was nothing to tell apart, and the prior is the score.

    The inverse of each factor is worked out once and kept.
    """

    centre: np.ndarray
    scale: np.ndarray
    log_odds: float = 0.0
    means: list[np.ndarray] = field(default_factory=list)
    factors: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        self.whiteners: list[np.ndarray] = []

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of ``x``."""
        if not self.means or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.log_odds)))
        if not self.whiteners:
            self.whiteners = [np.linalg.inv(f) for f in self.factors]
        z = (x - self.centre) / self.scale
        logs = []
        for mean, factor, whitener in zip(self.means, self.factors, self.whiteners):
            y = whitener @ (z - mean).T  # y'y is the Mahalanobis distance
            logs.append(-0.5 * (y * y).sum(0) - np.log(np.diag(factor)).sum())
        return 1 / (1 + np.exp(-np.clip(logs[1] - logs[0] + self.log_odds, -500, 500)))


def _moments(batches):
    """For each class in a partition: rows, sums and products of the vectors."""
    total: dict[int, np.ndarray] = {}
    upper = np.triu_indices(D)
    for frame in batches:
        for label, part in frame.groupby("label"):
            x = np.stack(part["vector"].to_numpy())
            sums = np.concatenate([[len(x)], x.sum(0), (x.T @ x)[upper]])
            total[label] = total.get(label, 0) + sums
    if total:
        yield pd.DataFrame({"label": list(total), "sums": [v.tolist() for v in total.values()]})


def fit(vectors: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality",
        towards_pooled: float = 0.1, towards_sphere: float = 0.02) -> Model:
    """Fit on every labelled row. ``vectors`` has ``key`` and ``vector``.

    Spark adds the sums up; the driver gets one row for each class.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isin(0, 1)).select(
        F.col(key).alias("_key"), F.col(label).cast("int").alias("label"))
    rows = vectors.select(F.col(key).alias("_id"), "vector").join(known, F.col("_id") == F.col("_key")).select("label", "vector")
    parts = rows.mapInPandas(_moments, "label int, sums array<double>")
    n_sums = 1 + D + D * (D + 1) // 2
    got = parts.groupBy("label").agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(n_sums)]).alias("sums")).collect()
    sums = {r["label"]: np.array(r["sums"]) for r in got}
    if len(sums) < 2:
        rows = {k: s[0] for k, s in sums.items()}
        return Model(np.zeros(D), np.ones(D), float(np.log((rows.get(1, 0) + 1) / (rows.get(0, 0) + 1))))
    upper = np.triu_indices(D)

    def parts_of(s):
        square = np.zeros((D, D))
        square[upper] = s[1 + D:]
        return s[0], s[1:1 + D] / s[0], (square + np.triu(square, 1).T) / s[0]

    n, mean, square = parts_of(sums[0] + sums[1])
    scale = np.sqrt(np.maximum(np.diag(square) - mean**2, 1e-12))
    scale[scale < 1e-5] = 1.0
    model = Model(mean, scale, float(np.log(sums[1][0] / sums[0][0])))
    each = []
    for k in (0, 1):
        n_k, mean_k, square_k = parts_of(sums[k])
        model.means.append((mean_k - mean) / scale)
        each.append((n_k, (square_k - np.outer(mean_k, mean_k)) / np.outer(scale, scale)))
    pooled = sum(n_k * c for n_k, c in each) / n
    for _, cov in each:
        cov = (1 - towards_pooled) * cov + towards_pooled * pooled
        sphere = max(np.trace(cov) / D, 1e-3) * np.eye(D)
        model.factors.append(np.linalg.cholesky((1 - towards_sphere) * cov + towards_sphere * sphere))
    return model


def scored(vectors: DataFrame, model: Model) -> DataFrame:
    """``score`` and ``predicted`` for rows with a ``vector``."""

    @F.pandas_udf("double")
    def score(vector: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(vector.to_numpy())) if len(vector) else [], dtype="float64")

    return vectors.withColumn("score", score("vector")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def held_out(key: Column) -> Column:
    """True for the third of the ids from which nothing is learned; a null id is never held out."""
    return F.coalesce(F.crc32(key.cast("string")) % 3 == 1, F.lit(False))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document; texts are read once."""
    vectors = text_vectors(docs)
    model = fit(vectors, labels.where(~held_out(F.col("doc_id"))))
    return scored(vectors, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents with a score of 0.5 or more, all columns unchanged.

    The model comes from all labelled rows that aren't held out, and only their
    vectors are written; the texts are then scored where they lie, so that they
    cross no shuffle.
    """
    taught = labels.where(~held_out(F.col("doc_id")))
    model = fit(text_vectors(docs.where(~held_out(F.col("doc_id")))), taught)

    place = docs.columns.index("text")

    def keep(batches):
        for batch in few_at_a_time(batches):
            scores = model.score(np.stack([text_vector(x) for x in batch.column(place).to_pylist()]))
            yield batch.filter(pa.array(scores >= 0.5))

    return docs.mapInArrow(keep, docs.schema)
