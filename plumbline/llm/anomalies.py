"""Quality rules: fixed base rules, then an isolation forest on rule statistics.

Every document is reduced to counts in one pass over its text. There is a forest for each
group of statistics in ``GROUPS``, as rules about words and about repetition are broken by
different documents. Trees are grown on bounded samples, as the method defines them: a tree
gets ``SAMPLE`` rows, the ones with the smallest hash for its number. Samples are small because
bad documents are many and alike: in a larger one they hide each other, and the long tails of
good ones are cut off first. A short mean path over random splits marks an anomaly.

Each forest has a threshold of its own, calibrated on all labelled rows: the lowest score at
which no more than its part of ``FALSE_REJECTS`` of the rows labelled good, and a larger share
of those labelled bad than of the good ones, would go. A document goes if a forest rejects it.
Without labels nothing beyond the base rules is rejected.

Defined cases: a null or empty text has no words and fails the base; repeated rows are judged
each; an empty table gives an empty result; a null label is no label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import fields, map_batches, map_texts, stored, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
STATISTICS = (*COUNTS, "n_lines", "n_upper_words", "n_marked_words", "n_distinct_words")
FEATURES = (
    "log_words", "word_length", "symbol_share", "dup_line_share", "repeat_share",
    "upper_share", "marked_share", "distinct_share",
)
GROUPS = {
    "words": ("word_length", "symbol_share", "upper_share", "marked_share"),
    "repeats": ("log_words", "dup_line_share", "repeat_share", "distinct_share"),
}
SCORES = tuple(f"{group}_score" for group in GROUPS)
TREES, SAMPLE, BINS = 100, 32, 1000
FALSE_REJECTS = 0.002
MIN_WORDS, REPEAT_PERCENT = 50, 50


def rule_counts(text: str) -> tuple[int, ...]:
    """The STATISTICS of one text."""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    repeated = 0
    if len(words) >= 4:
        numbers: dict[str, int] = {}
        codes = np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int64)
        base = len(numbers)
        windows = codes[:-2] * base + codes[1:-1]  # below 2**63 for up to 3e9 words
        _, windows = np.unique(windows, return_inverse=True)
        windows = windows.astype(np.int64) * base + codes[2:]
        _, place, count = np.unique(windows, return_inverse=True, return_counts=True)
        again = count[place] >= 2
        covered = np.zeros(len(words), dtype=bool)
        for shift in range(3):
            covered[shift : shift + len(again)] |= again
        repeated = int(covered.sum())
    return (
        len(words),
        sum(map(len, words)),
        sum(map(text.count, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        sum(map(str.isupper, words)),
        sum(not w[-1].isalnum() for w in words),
        len(set(words)),
    )


def count_rules(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, STATISTICS..., carry...) of every whole text."""
    schema = "doc_id bigint, " + ", ".join(f"{name} bigint" for name in STATISTICS)

    def make():
        def run(keys, texts):
            rows = zip(*map(rule_counts, texts), strict=True)
            return {"doc_id": keys} | dict(zip(STATISTICS, map(list, rows), strict=True))

        return run

    return map_texts(docs, make, schema, carry=carry)


def with_features(counted: DataFrame) -> DataFrame:
    """Adds base_failed and the features: shares, so that length counts once."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.lit(100) * F.col("n_repeat_words") > F.lit(REPEAT_PERCENT) * F.col("n_words")
    )
    return counted.withColumns(
        {
            "base_failed": failed,
            "log_words": F.log1p(F.col("n_words").cast("double")),
            "word_length": F.col("word_chars") / words,
            "symbol_share": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
            "dup_line_share": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
            "repeat_share": F.col("n_repeat_words") / words,
            "upper_share": F.col("n_upper_words") / words,
            "marked_share": F.col("n_marked_words") / words,
            "distinct_share": F.col("n_distinct_words") / words,
        }
    )


def grow_tree(rows: np.ndarray, seed: int) -> tuple[list, list, list, list]:
    """One isolation tree as (feature, split, left child, path length at a leaf) lists.

    The right child follows the left one; a leaf has feature -1.
    """
    random = np.random.default_rng(seed)
    limit = int(np.ceil(np.log2(max(len(rows), 2))))
    feature, split, left, path = [-1], [0.0], [0], [0.0]
    todo = [(0, rows, 0)]
    while todo:
        node, held, depth = todo.pop()
        low, high = (held.min(0), held.max(0)) if len(held) else (np.zeros(1), np.zeros(1))
        open_to = np.flatnonzero(high > low)
        if depth >= limit or not len(open_to):
            path[node] = depth + average_path(len(held))
            continue
        chosen = int(random.choice(open_to))
        at = float(random.uniform(low[chosen], high[chosen]))
        feature[node], split[node], left[node] = chosen, at, len(feature)
        for side in (held[held[:, chosen] <= at], held[held[:, chosen] > at]):
            todo.append((len(feature), side, depth + 1))
            feature.append(-1), split.append(0.0), left.append(0), path.append(0.0)
    return feature, split, left, path


def average_path(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    if n <= 1:
        return 0.0
    return 2.0 * (np.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n if n > 2 else 1.0


def draws(rows: np.ndarray, tree: int) -> np.ndarray:
    """One number per row hash and tree; the rows with the smallest ones are the tree's."""
    mixed = rows ^ np.uint64((tree + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        mixed = (mixed ^ (mixed >> np.uint64(shift))) * np.uint64(factor)
    return mixed ^ (mixed >> np.uint64(31))


def smallest(draw: np.ndarray, points: np.ndarray, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``sample`` rows with the smallest draws, ties by their features."""
    if len(draw) <= sample:
        return draw, points
    order = np.lexsort((*points.T, draw))[:sample]
    return draw[order], points[order]


def draw_samples(rows: DataFrame, trees: int, sample: int) -> DataFrame:
    """(tree, draw, FEATURES...): what each partition offers every tree.

    A row reaches Python once, with one hash. A task holds ``trees`` * ``sample`` rows, and
    gives out no more; a row is copied only for the trees that it beats a held row of.
    """
    row = F.xxhash64("doc_id", *FEATURES).alias("row")
    columns = ", ".join(f"{name} double" for name in FEATURES)

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            width = len(FEATURES)
            held = [(np.zeros(0, np.uint64), np.zeros((0, width)))] * trees
            for batch in batches:
                hashes = batch.column("row").to_numpy().view(np.uint64)
                points = np.column_stack([batch.column(n).to_numpy(False) for n in FEATURES])
                for tree in range(trees):
                    draw, kept = held[tree]
                    fresh = draws(hashes, tree)
                    better = np.flatnonzero(
                        fresh <= draw.max() if len(draw) >= sample else np.ones(len(fresh), bool)
                    )
                    if len(better):
                        held[tree] = smallest(
                            np.concatenate([draw, fresh[better]]),
                            np.concatenate([kept, points[better]]), sample,
                        )
            for tree, (draw, kept) in enumerate(held):
                if len(draw):
                    yield {"tree": np.full(len(draw), tree), "draw": draw.view(np.int64)} | {
                        name: kept[:, i] for i, name in enumerate(FEATURES)
                    }

        return run

    return map_batches(rows.select(row, *FEATURES), make, f"tree int, draw bigint, {columns}")


def grow_forests(rows: DataFrame, trees: int = TREES, sample: int = SAMPLE) -> list[list]:
    """A forest per group, grown in tasks: a tree of each on the ``sample`` rows with the
    smallest draws for its number."""
    cut = draw_samples(rows, trees, sample)

    def grow(frame: pd.DataFrame) -> pd.DataFrame:
        number = int(frame["tree"].iloc[0])
        draw = frame["draw"].to_numpy().view(np.uint64)
        _, chosen = smallest(draw, frame[list(FEATURES)].to_numpy(), sample)
        grown = [
            (number, forest, len(chosen), *grow_tree(chosen[:, columns], number * len(GROUPS) + forest))
            for forest, columns in enumerate(group_columns())
        ]
        return pd.DataFrame(grown, columns=["tree", "forest", "rows", *names])

    names = ("feature", "split", "left", "path")
    schema = (
        "tree int, forest int, rows int, feature array<int>, split array<double>, "
        "left array<int>, path array<double>"
    )
    grown = cut.groupBy("tree").applyInPandas(grow, schema).orderBy("tree").collect()
    return [
        [(row.rows, *(np.array(row[n]) for n in names)) for row in grown if row.forest == forest]
        for forest in range(len(GROUPS))
    ]


def group_columns() -> list[list[int]]:
    """The places of every group's statistics among the FEATURES."""
    return [[FEATURES.index(name) for name in names] for names in GROUPS.values()]


def anomaly_scores(forest: list, points: np.ndarray) -> np.ndarray:
    """2 ** (-mean path / expected path): near 1 for anomalies."""
    total, expected = np.zeros(len(points)), 0.0
    for rows, feature, split, left, path in forest:
        node = np.zeros(len(points), dtype=np.int64)
        while True:
            inner = np.flatnonzero(feature[node] >= 0)
            if not len(inner):
                break
            at = node[inner]
            right = points[inner, feature[at]] > split[at]
            node[inner] = left[at] + right
        total += path[node]
        expected += max(average_path(rows), 1e-9)
    return 2.0 ** (-total / expected)


def score_rows(rows: DataFrame, forests: list[list], carry: tuple[str, ...] = ()) -> DataFrame:
    """Adds the SCORES in whole BINS; a forest is bounded by TREES * 2 * SAMPLE nodes."""
    shared = rows.sparkSession.sparkContext.broadcast(forests)
    names = ["doc_id", *COUNTS, "base_failed", *carry]
    schema = (
        "doc_id bigint, " + ", ".join(f"{n} bigint" for n in COUNTS)
        + ", base_failed boolean, " + ", ".join(f"{n} int" for n in SCORES) + fields(rows, carry)
    )

    def make():
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
            for batch in batches:
                points = np.column_stack([batch.column(n).to_numpy(False) for n in FEATURES])
                out = {n: batch.column(n) for n in names}
                for name, columns, trees in zip(SCORES, group_columns(), shared.value, strict=True):
                    score = anomaly_scores(trees, points[:, columns]) if trees else 0 * points[:, 0]
                    out[name] = np.floor(score * BINS).astype(np.int32)
                yield out

        return run

    return map_batches(rows.select(*names, *FEATURES), make, schema)


def calibrate(
    scored: DataFrame, labels: DataFrame, false_rejects: float = FALSE_REJECTS
) -> list[int]:
    """Per forest, the score bin from which a document is rejected; BINS + 1 rejects none."""
    known = labels.select("doc_id", "quality").filter("quality IN (0, 1)").distinct()
    pairs = F.posexplode(F.array(*SCORES)).alias("forest", "score")
    counts = (
        scored.filter(~F.col("base_failed")).select("doc_id", *SCORES).join(known, "doc_id")
        .select("quality", pairs).groupBy("forest", "score").agg(
            F.count_if(F.col("quality") == 1).alias("good"),
            F.count_if(F.col("quality") == 0).alias("bad"),
        )
        .collect()  # at most BINS + 1 rows for a forest
    )
    good, bad = np.zeros((2, len(GROUPS), BINS + 2))
    for row in counts:
        good[row.forest, row.score], bad[row.forest, row.score] = row.good, row.bad
    return [lowest_fit(*both, false_rejects / len(GROUPS)) for both in zip(good, bad, strict=True)]


def lowest_fit(good: np.ndarray, bad: np.ndarray, false_rejects: float) -> int:
    """The lowest score that keeps within ``false_rejects`` and separates, given both classes'
    rows per score."""
    lost, caught = np.cumsum(good[::-1])[::-1], np.cumsum(bad[::-1])[::-1]
    fits = (lost <= false_rejects * max(lost[0], 1)) & (
        caught * max(lost[0], 1) > lost * max(caught[0], 1)
    )
    return int(np.flatnonzero(fits)[0]) if fits.any() else BINS + 1


def quality_rules(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, counts, base_failed, kept, SCORES..., carry...) of every document.

    A carried column that is named like one of these, or like a statistic, is an error.
    """
    taken = {"doc_id", "text", "base_failed", "kept", *SCORES, *STATISTICS, *FEATURES}
    if taken & set(carry):
        raise ValueError(f"carried columns need other names: {sorted(taken & set(carry))}")
    rows = stored(with_features(count_rules(docs, carry)))
    forests = grow_forests(rows.filter(~F.col("base_failed")))
    scored = stored(score_rows(rows, forests, carry))
    kept = ~F.col("base_failed")
    for name, threshold in zip(SCORES, calibrate(scored, labels), strict=True):
        kept &= F.col(name) < threshold
    return scored.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), *SCORES, *carry)


def quality_rules_query(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(table(spark, folder, "documents"), table(spark, folder, "labels"))
