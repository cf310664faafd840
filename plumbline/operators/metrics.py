"""Ranking-quality metrics over judged rows, one result row per query.

``judged`` has the group columns, ``rank``, ``id`` and ``tier``. Metric positions count
judged rows only, so ``rank`` may be the place among all rows or among the judged ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.config import MetricSettings
from plumbline.functions.scalar import fixed_value
from plumbline.operators.durable import durable
from plumbline.operators.ordering import positions, running_totals, top_n, top_per_group

CUTS = (10, 50)
#: Places that the checks of a ranking's head look at.
HEAD = 100


def judge(ranking: DataFrame, gold: DataFrame) -> DataFrame:
    """Ranked rows that carry a gold tier."""
    return ranking.join(gold.select("id", "tier"), "id", "inner")


def is_relevant(tier: Column, cutoff: int) -> Column:
    return tier >= cutoff


def _gain(place: Column, tier: Column) -> Column:
    return tier.cast("double") / F.log2(place.cast("double") + F.lit(1.0))


def _cut_sums(ranked: DataFrame, by: Sequence[str], ks: Sequence[int], stem: str) -> DataFrame:
    """Discounted gain at every cut, from the rows of the longest cut."""
    sums = [
        F.coalesce(
            F.sum(F.when(F.col("_place") <= k, _gain(F.col("_place"), F.col("tier")))),
            F.lit(0.0),
        ).alias(f"{stem}{k}")
        for k in ks
    ]
    return ranked.groupBy(*by).agg(*sums)


def dcg(judged: DataFrame, by: Sequence[str], ks: Sequence[int] = CUTS) -> DataFrame:
    """Linear-gain DCG at every cut; only the first max(ks) rows per group are shuffled."""
    order = [F.col("rank").asc(), F.col("id").asc()]
    return _cut_sums(top_per_group(judged, by, order, max(ks), "_place"), by, ks, "dcg_at_")


def ideal_dcg(judged: DataFrame, by: Sequence[str], ks: Sequence[int] = CUTS) -> DataFrame:
    order = [F.col("tier").desc(), F.col("id").asc()]
    return _cut_sums(top_per_group(judged, by, order, max(ks), "_place"), by, ks, "ideal_at_")


def ndcg(judged: DataFrame, by: Sequence[str], ks: Sequence[int] = CUTS) -> DataFrame:
    """DCG over the ideal DCG of the same tiers; 0 where nothing is relevant."""
    both = dcg(judged, by, ks).join(ideal_dcg(judged, by, ks), list(by))
    ratios = [
        F.when(F.col(f"ideal_at_{k}") == 0, 0.0)
        .otherwise(F.col(f"dcg_at_{k}") / F.nullif(F.col(f"ideal_at_{k}"), F.lit(0.0)))
        .alias(f"ndcg_at_{k}")
        for k in ks
    ]
    return both.select(*by, *ratios)


def precision(judged: DataFrame, by: Sequence[str], k: int, cutoff: int) -> DataFrame:
    """Relevant share of the first k places; a short list is divided by k all the same."""
    if k <= 0:
        return judged.groupBy(*by).agg(F.lit(0.0).alias(f"precision_at_{k}"))
    order = [F.col("rank").asc(), F.col("id").asc()]
    first = top_per_group(judged, by, order, k, "_place")
    hits = F.count_if(is_relevant(F.col("tier"), cutoff))
    return first.groupBy(*by).agg((hits / F.lit(float(k))).alias(f"precision_at_{k}"))


def running_precision(judged: DataFrame, by: Sequence[str], cutoff: int) -> DataFrame:
    """Every judged row with its place, the hits so far and the precision so far."""
    counted = running_totals(
        judged,
        [F.col("rank").asc(), F.col("id").asc()],
        by,
        {"place": F.lit(1), "hits": is_relevant(F.col("tier"), cutoff).cast("int")},
    )
    return counted.withColumn("precision", F.col("hits") / F.col("place").cast("double"))


def average_precision(judged: DataFrame, by: Sequence[str], cutoff: int) -> DataFrame:
    """Mean precision at the relevant places; 0 for a query without any."""
    relevant = is_relevant(F.col("tier"), cutoff)
    return (
        running_precision(judged, by, cutoff)
        .groupBy(*by)
        .agg(
            F.coalesce(F.avg(F.when(relevant, F.col("precision"))), F.lit(0.0)).alias(
                "average_precision"
            )
        )
    )


def mean_average_precision(per_query: DataFrame) -> DataFrame:
    return per_query.agg(F.coalesce(F.avg("average_precision"), F.lit(0.0)).alias("map"))


def quality(judged: DataFrame, by: Sequence[str], settings: MetricSettings) -> DataFrame:
    """The four metrics, each rounded to six decimals, and their weighted composite."""
    cutoff = settings.relevant_tier
    parts = (
        ndcg(judged, by)
        .join(average_precision(judged, by, cutoff), list(by))
        .join(precision(judged, by, 10, cutoff), list(by))
    )
    rounded = parts.select(
        *by,
        fixed_value(F.col("ndcg_at_10")).alias("ndcg_at_10"),
        fixed_value(F.col("ndcg_at_50")).alias("ndcg_at_50"),
        fixed_value(F.col("average_precision")).alias("map"),
        fixed_value(F.col("precision_at_10")).alias("precision_at_10"),
    )
    return rounded.withColumn("composite", composite(settings))


def composite(settings: MetricSettings) -> Column:
    total = F.lit(0.0)
    for name, weight in settings.composite.items():
        total = total + F.lit(weight) * F.col(name)
    return fixed_value(total)


# --- checks on the full ranking -------------------------------------------------


def flagged_in_top(ranking: DataFrame, ks: Sequence[int] = (10, 50, 100)) -> DataFrame:
    """One row: rows with any flag among the first k, for every k."""
    flagged = F.size("flags") > 0
    return ranking.agg(
        *[F.count_if(flagged & (F.col("rank") <= k)).alias(f"flagged_in_top_{k}") for k in ks]
    )


def impossible_in_top(ranking: DataFrame, k: int = 100) -> DataFrame:
    return ranking.filter((F.col("rank") <= k) & F.col("impossible")).select("id", "rank")


def off_target_in_top(ranking: DataFrame, settings: MetricSettings, k: int = 50) -> DataFrame:
    off = (
        F.col("impossible")
        | (F.col("role_match") <= settings.off_target_role)
        | (F.size("flags") > 0)
    )
    return ranking.filter((F.col("rank") <= k) & off).select("id", "rank")


def strong_but_inactive(judged: DataFrame, settings: MetricSettings) -> DataFrame:
    strong = F.col("tier") >= settings.strong_tier
    inactive = F.col("availability") <= settings.inactive_availability
    return judged.filter(strong & inactive).select(
        "id", "tier", "rank", fixed_value(F.col("availability"), 3).alias("availability")
    )


def traps_in_top(judged: DataFrame, settings: MetricSettings) -> DataFrame:
    low = F.col("tier") <= settings.trap_tier
    return judged.filter(low & (F.col("rank") <= settings.trap_rank)).select("id", "tier", "rank")


def tier_histogram(judged: DataFrame, settings: MetricSettings) -> DataFrame:
    """Rows per tier, zero for tiers nobody has."""
    counts = judged.agg(
        *[F.count_if(F.col("tier") == t).alias(f"t{t}") for t in range(settings.max_tier + 1)]
    )
    rows = [
        F.struct(F.lit(t).alias("tier"), F.col(f"t{t}").alias("n"))
        for t in range(settings.max_tier + 1)
    ]
    return counts.select(F.inline(F.array(*rows)))


def tier_ranks(judged: DataFrame) -> DataFrame:
    """(tier, rank) pairs. Long form: a tier may hold any share of the judged rows."""
    return judged.select("tier", "rank")


def missing_from(ranking: DataFrame, gold: DataFrame, settings: MetricSettings) -> DataFrame:
    """Gold ids that are not ranked, and whether that hurts."""
    lost = gold.join(ranking.select("id"), "id", "left_anti")
    relevant = is_relevant(F.col("tier"), settings.relevant_tier)
    return lost.select("id", "tier", relevant.alias("relevant"))


def report(
    scored: DataFrame, gold: DataFrame, settings: MetricSettings, order: Sequence[Column]
) -> DataFrame:
    """One row of metrics and counts of the ranking of ``scored`` by ``order``.

    ``scored`` carries flags, impossible, role_match, availability. Only the judged rows
    and the head are put in order: metrics count the ones, checks the other. The id
    lists behind the counts are the functions above; they stay tables because their
    length follows the data.
    """
    scored = durable(scored)
    head = durable(top_n(scored, order, max(HEAD, settings.trap_rank)))
    judged = positions(judge(scored, gold), order)
    tagged = durable(judged.withColumn("query", F.lit(0)))
    metric_row = quality(tagged, ["query"], settings).drop("query")
    histogram = [
        F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in range(settings.max_tier + 1)
    ]
    traps = traps_in_top(judge(head, gold), settings).agg(
        F.count(F.lit(1)).alias("traps_in_top_50")
    )
    judged_row = tagged.agg(
        F.count(F.lit(1)).alias("judged"),
        *histogram,
        F.count_if(
            (F.col("tier") >= settings.strong_tier)
            & (F.col("availability") <= settings.inactive_availability)
        ).alias("strong_but_inactive"),
    )
    flagged = F.size("flags") > 0
    off = F.col("impossible") | (F.col("role_match") <= settings.off_target_role) | flagged
    ranked = scored.agg(F.count(F.lit(1)).alias("ranked"))
    head_row = head.agg(
        F.count_if(F.col("impossible") & (F.col("rank") <= 100)).alias("impossible_in_top_100"),
        F.count_if(flagged & (F.col("rank") <= 10)).alias("flagged_in_top_10"),
        F.count_if(flagged & (F.col("rank") <= 50)).alias("flagged_in_top_50"),
        F.count_if(flagged & (F.col("rank") <= 100)).alias("flagged_in_top_100"),
        F.count_if(off & (F.col("rank") <= 50)).alias("off_target_in_top_50"),
    )
    lost = missing_from(scored, gold, settings).agg(
        F.count(F.lit(1)).alias("missing"), F.count_if("relevant").alias("missing_relevant")
    )
    labelled = gold.agg(F.count(F.lit(1)).alias("labelled"))
    return one_row(ranked, head_row, judged_row, traps, lost, labelled, metric_row)


def one_row(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Put one-row tables side by side, as scalar subqueries of the first."""
    columns = []
    for other in others:
        packed = other.select(F.struct(*other.columns))
        columns.append((packed.scalar(), other.columns))
    wide = first
    for i, (value, _) in enumerate(columns):
        wide = wide.withColumn(f"_row{i}", value)
    return wide.select(
        *first.columns,
        *[F.col(f"_row{i}.{n}").alias(n) for i, (_, names) in enumerate(columns) for n in names],
    )
