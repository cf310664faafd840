"""Quality classifier: regularised quadratic discriminant on document statistics.

One pass reduces every whole text to a vector of transformed statistics. Class means and
covariances come from all labelled training rows as mergeable sums. Each covariance is shrunk
towards the pooled one and then towards its own diagonal. Scores are the logistic of the
difference of the class log densities (Mahalanobis distance by the cached Cholesky factor).

Defined cases: a null text is empty and is scored like any other; a label that is neither 0
nor 1 is ignored; a label given twice counts once, with conflicting labels both count; with a
class without training rows every score is 0.5.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import fields, map_batches, map_texts, stored, table

POOLED, DIAGONAL, FLOOR = 0.3, 0.1, 1e-4
#: Log density differences are divided by this before the logistic; the sign is unchanged.
SOFTEN = 4.0
FEATURES = 15


def statistics(text: str) -> list[float]:
    """Transformed statistics of a text: logs of sizes, square roots of shares."""
    words, lines = text.split(), [line for line in text.split("\n") if line.strip()]
    n, chars = max(len(words), 1), max(len(text), 1)
    distinct = set(words)
    letters = sum(map(len, words))
    symbols = sum(map(text.count, "#*$%&|<>"))
    pairs = len(set(zip(words, words[1:], strict=False)))
    shares = (
        len(distinct) / n,
        pairs / n,
        sum(map(str.isupper, words)) / n,
        sum(map(str.istitle, words)) / n,
        sum(map(str.isalpha, words)) / n,
        sum(len(w) <= 3 for w in words) / n,
        sum(w[-1] in ".,;:" for w in words) / n,
        symbols / chars,
        (text.count("!") + text.count("?")) / chars,
        sum(map(text.count, "0123456789")) / chars,
        1 - len(set(lines)) / max(len(lines), 1),
        text.count(" ") / chars,
    )
    return [
        float(np.log1p(len(words))),
        float(np.log(letters / n + 0.5)),
        float(np.log1p(len(words) / max(len(lines), 1))),
        *(share**0.5 for share in shares),
    ]


def describe(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, x, carry...): the statistics of every whole text."""

    def make():
        return lambda keys, texts: {"doc_id": keys, "x": list(map(statistics, texts))}

    return map_texts(docs, make, "doc_id bigint, x array<double>", carry=carry)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3, F.lit(0)) == 1


def class_sums(rows: DataFrame) -> dict[int, tuple[float, np.ndarray, np.ndarray]]:
    """Count, sum and sum of outer products per class, from (x, quality)."""
    schema = "quality int, n double, s array<double>, p array<double>"

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            sums = {}
            for batch in batches:
                points = np.array(batch.column("x").to_pylist()).reshape(-1, FEATURES)
                classes = batch.column("quality").to_numpy(False)
                for label in np.unique(classes):
                    held = points[classes == label]
                    n, s, p = sums.get(label, (0.0, 0.0, 0.0))
                    sums[label] = n + len(held), s + held.sum(0), p + held.T @ held
            for label, (n, s, p) in sums.items():
                yield {"quality": [label], "n": [n], "s": [s], "p": [p.ravel()]}

        return run

    partial = map_batches(rows.select("x", F.col("quality").cast("int")), make, schema)

    def total(column: str, size: int) -> Column:
        return F.array(*[F.sum(F.get(column, F.lit(i))) for i in range(size)])

    merged = partial.groupBy("quality").agg(
        F.sum("n").alias("n"), total("s", FEATURES).alias("s"),
        total("p", FEATURES * FEATURES).alias("p"),
    )
    return {  # two rows
        row.quality: (row.n, np.array(row.s), np.array(row.p).reshape(FEATURES, FEATURES))
        for row in merged.collect()
    }


def fit(sums: dict, pooled: float = POOLED, diagonal: float = DIAGONAL) -> list | None:
    """Per class (0, 1): mean, Cholesky factor of the shrunk covariance, log weight."""
    if not all(sums.get(label, (0,))[0] >= 2 for label in (0, 1)):
        return None
    rows = sums[0][0] + sums[1][0]
    scatter = {k: p - np.outer(s, s) / n for k, (n, s, p) in sums.items()}
    common = (scatter[0] + scatter[1]) / rows
    model = []
    for label in (0, 1):
        n, s, _ = sums[label]
        own = (1 - pooled) * scatter[label] / n + pooled * common
        own = (1 - diagonal) * own + diagonal * np.diag(np.diag(own)) + FLOOR * np.eye(FEATURES)
        factor = np.linalg.cholesky(own)
        model.append((s / n, factor, np.log(n / rows) - np.log(np.diag(factor)).sum()))
    return model


def log_density_difference(model: list, points: np.ndarray) -> np.ndarray:
    densities = []
    for mean, factor, constant in model:
        scaled = np.linalg.solve(factor, (points - mean).T)
        densities.append(constant - 0.5 * (scaled * scaled).sum(0))
    return densities[1] - densities[0]


def classify(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, held_out, score, predicted, carry...) of every document; held-out labels
    aren't used."""
    rows = stored(describe(docs, carry))
    known = labels.select("doc_id", "quality").filter("quality IN (0, 1)").distinct()
    train = rows.join(known.filter(~held_out(F.col("doc_id"))), "doc_id")
    model = fit(class_sums(train))

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                points = np.array(batch.column("x").to_pylist()).reshape(-1, FEATURES)
                score = np.full(len(points), 0.5)
                if model is not None:
                    gap = np.clip(log_density_difference(model, points) / SOFTEN, -500, 500)
                    score = 1.0 / (1.0 + np.exp(-gap))
                yield {n: batch.column(n) for n in ("doc_id", *carry)} | {"score": score}

        return run

    scored = map_batches(rows, make, "doc_id bigint, score double" + fields(rows, carry))
    return scored.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"), *carry,
    )


def quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return classify(table(spark, folder, "documents"), table(spark, folder, "labels"))
