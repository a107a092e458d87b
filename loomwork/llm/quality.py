"""Quality scores: random Fourier features over document statistics, ridge regression, isotonic calibration.

Statistics of whole texts are standardised and mapped by cosine features that approximate a
Gaussian kernel. Each partition sums its share of the normal equations, by fold; the sums give the
ridge fit, and, with one fold taken off, the out-of-fold predictions on which the ridge
strength is chosen and the isotonic calibration is fitted.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.common import small_batches, stored
from loomwork.llm.labelled import held_out, training_labels, with_labels

SYMBOLS = re.compile(r"[^\w\s.,;:'\"()\-]")
DIGITS = re.compile(r"\d")
STATISTICS = 18
FOLDS, BINS = 5, 256
STRENGTHS = (0.1, 1.0, 10.0, 100.0)


def statistics(text: str) -> list[float]:
    """Length, shape and repetition of a whole text; an empty one has zeros."""
    words = text.split()
    n, size = len(words), len(text)
    if not n:
        return [0.0] * STATISTICS
    counts = Counter(words)
    common = [c for _, c in counts.most_common(5)]
    lines = [x for x in text.split("\n") if x.strip()]
    line_set = set(lines)
    letters = sum(map(len, words))
    symbols = len(SYMBOLS.findall(text))
    shouted = sum(1 for w in words if w.isupper() and len(w) > 1)
    upper = sum(1 for w in words if w[0].isupper())
    ended = sum(1 for w in words if w[-1] in ".,;:")
    marked = sum(1 for w in words if not w[-1].isalnum() and w[-1] not in ".,;:)\"'")
    triples = len(set(zip(words, words[1:], words[2:], strict=False)))
    twice = sum(1 for a, b in zip(words, words[1:], strict=False) if a == b)
    digits = len(DIGITS.findall(text))
    return [
        np.log1p(n),
        letters / n,
        np.log1p(len(counts)) / np.log1p(n),
        common[0] / (n + 4),
        sum(common) / (n + 4),
        triples / max(n - 2, 1) if n > 2 else 1.0,
        twice / n,
        symbols / size,
        marked / n,
        shouted / n,
        upper / n,
        ended / n,
        digits / size,
        1 - len(line_set) / max(len(lines), 1),
        np.log1p(len(lines)),
        np.log1p(n / max(len(lines), 1)),
        sum(1 for w in words if len(w) <= 3) / n,
        max(map(len, words)) / (letters / n + 10),
    ]


def statistics_of(docs: DataFrame, keep: str, schema: str) -> DataFrame:
    """keep, x (the statistics of text) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t.as_py() or "") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column(keep), pa.array(x, pa.list_(pa.float64()))], names=[keep, "x"])

    return docs.select(keep, "text").mapInArrow(run, f"{schema}, x array<double>")


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    waves: np.ndarray
    phases: np.ndarray
    weights: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -6, 6)
        waves = np.cos(z @ self.waves + self.phases) * np.sqrt(2 / len(self.phases))
        return np.hstack([waves, z, np.ones((len(z), 1))])

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.interp(self.features(x) @ self.weights, self.at, self.value)


def _pooled(blocks: list[tuple[float, float, float]]) -> np.ndarray:
    """Blocks (sum of places, good, total) with neighbours joined until their shares of good rise."""
    out: list[list[float]] = []
    for block in blocks:
        out.append(list(block))
        while len(out) > 1 and out[-2][1] * out[-1][2] >= out[-1][1] * out[-2][2]:
            last = out.pop()
            out[-1] = [a + b for a, b in zip(out[-1], last, strict=True)]
    return np.array(out)


def isotonic(at: np.ndarray, good: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators over bins: places and values of the fitted steps, which never fall.

    Each step counts half a row of each label more, so that none says never or always; steps that fall by that are pooled again."""
    blocks = [(x * n, g, n) for x, g, n in zip(at, good, total, strict=True) if n]
    if not blocks:
        return np.array([0.0]), np.array([0.5])
    x, g, n = _pooled(blocks).T
    x, g, n = _pooled(list(zip(x / n * (n + 1), g + 0.5, n + 1, strict=True))).T
    return x / n, g / n


def _sums(rows: DataFrame, model: Model, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Normal equations by fold, each partition's share summed there: gram, moment, squares."""
    width = model.waves.shape[1] + model.waves.shape[0] + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, moment = np.zeros((FOLDS, width, width)), np.zeros((FOLDS, width))
        for batch in batches:
            x = np.array(batch.column("x").to_pylist()).reshape(batch.num_rows, -1)
            y, fold = batch.column("label").to_numpy(), batch.column("fold").to_numpy()
            z = model.features(x) if len(x) else np.zeros((0, width))
            for f in range(FOLDS):
                own = z[fold == f]
                gram[f] += own.T @ own
                moment[f] += own.T @ y[fold == f]
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()]), pa.array([moment.tobytes()])], names=["gram", "moment"])

    got = rows.repartition(parts).mapInArrow(run, "gram binary, moment binary").collect()  # `parts` rows of fixed size
    gram = sum(np.frombuffer(r["gram"]).reshape(FOLDS, width, width) for r in got)
    return gram, sum(np.frombuffer(r["moment"]).reshape(FOLDS, width) for r in got)


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0, most_rows: int = 30_000, waves: int = 192, seed: int = 7) -> Model:
    """A model from at most most_rows labelled rows outside the held-out fold.

    With no labelled row every score is 0.5."""
    small_batches(spark)
    sample = with_labels(docs, training_labels(labels, "quality", modulus, remainder, most_rows))
    rows = statistics_of(sample.withColumn("label", (F.col("label") > 0).cast("int")), "label", "label int")
    rows = stored(rows.withColumn("fold", F.pmod(F.xxhash64("x"), F.lit(FOLDS)).cast("int")), "statistics")
    moments = rows.select(F.posexplode("x").alias("i", "v")).groupBy("i").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s")).orderBy("i").collect()
    rng = np.random.default_rng(seed)
    centre, scale = np.zeros(STATISTICS), np.ones(STATISTICS)
    for r in moments:
        centre[r["i"]], scale[r["i"]] = r["m"], max(r["s"], 1e-6)
    width = 1 / np.sqrt(STATISTICS)  # of the kernel, in standard deviations of a statistic: distances are about sqrt(2 * STATISTICS)
    model = Model(centre, scale, rng.normal(size=(STATISTICS, waves)) * width, rng.uniform(0, 2 * np.pi, waves), np.zeros(waves + STATISTICS + 1), np.array([0.0]), np.array([0.5]))
    if not moments:
        return model
    gram, moment = _sums(rows, model, 8)
    size = len(model.weights)
    fits = {s: [np.linalg.solve(gram.sum(0) - gram[f] + s * np.eye(size), moment.sum(0) - moment[f]) for f in range(FOLDS)] for s in STRENGTHS}
    loss = {s: sum(w @ gram[f] @ w - 2 * w @ moment[f] for f, w in enumerate(fits[s])) for s in STRENGTHS}
    best = min(STRENGTHS, key=loss.get)
    model.weights = np.linalg.solve(gram.sum(0) + best * np.eye(size), moment.sum(0))
    by_fold = np.array(fits[best])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, total = np.zeros(BINS), np.zeros(BINS)
        for batch in batches:
            if batch.num_rows:
                z = model.features(np.array(batch.column("x").to_pylist()).reshape(batch.num_rows, -1))
                p = (z * by_fold[batch.column("fold").to_numpy()]).sum(axis=1)
                at = np.clip(((p + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
                total += np.bincount(at, minlength=BINS)
                good += np.bincount(at, batch.column("label").to_numpy(), minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BINS), pa.int32()), pa.array(good), pa.array(total)], names=["bin", "good", "total"])

    bins = rows.mapInArrow(run, "bin int, good double, total double").groupBy("bin").agg(F.sum("good").alias("good"), F.sum("total").alias("total")).orderBy("bin").toPandas()
    model.at, model.value = isotonic((bins["bin"].to_numpy() + 0.5) / BINS * 2 - 0.5, bins["good"].to_numpy(), bins["total"].to_numpy())
    return model


def judged(docs: DataFrame, model: Model, modulus: int = 5, remainder: int = 0, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs, repeated rows and null ids included.

    A null text counts as empty, and both get the score of zero statistics. A null doc_id is not
    held out. Extra columns of docs are ignored; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([statistics(t.as_py() or "") for t in batch.column("text")]).reshape(batch.num_rows, STATISTICS)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x), pa.float64())], names=["doc_id", "score"])

    rows = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out(modulus, remainder).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
