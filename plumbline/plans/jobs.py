"""The jobs: one function per entry point, built from the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.config import Settings
from plumbline.functions.cleaning import with_json_text
from plumbline.functions.scalar import squeeze
from plumbline.functions.text import career_text, prefixed, profile_card
from plumbline.operators import enrich as enriching
from plumbline.operators import metrics, sweep
from plumbline.operators.checks import require_none, vector_violations, violation
from plumbline.operators.durable import durable
from plumbline.operators.explain import (
    accept_texts,
    facts,
    prompt_entries,
    with_fallback,
)
from plumbline.operators.membership import exclude, with_text
from plumbline.operators.ordering import positions, require_rows, top_n
from plumbline.operators.scored import order_by, score_ids, score_survivors
from plumbline.operators.shortlist import prefilter
from plumbline.operators.textindex import TextIndex
from plumbline.plans.dataset import Dataset, records
from plumbline.sources.tables import validated_rubrics

TOP_N = 100


def scored_pool(data: Dataset) -> DataFrame:
    """Survivors of the pre-filter with features and score."""
    return score_survivors(
        data.narrow, data.similarity, data.signals, data.settings,
        [F.col("source_order").asc()],
    )


def ranked_top(data: Dataset, n: int = TOP_N, key: str = "formatted") -> DataFrame:
    """The best ``n`` survivors with every column of their score.

    Stored, because texts and records are then joined to the cut, and not the cut's
    whole plan once per join.
    """
    return durable(top_n(scored_pool(data), order_by(key), n))


def ranked_output(data: Dataset, n: int = TOP_N) -> DataFrame:
    """id, rank, score, reasoning of the best ``n``: the output a run writes.

    Fails if fewer than ``n`` records pass the filter.
    """
    top = with_fallback(require_rows(ranked_top(data, n), n), data.settings.text)
    return with_text(top, data.texts, F.col("fallback")).select(
        "id", "rank", "score", squeeze(F.col("reasoning")).alias("reasoning"), "text_source"
    )


def shortlist(data: Dataset) -> DataFrame:
    titled = data.texts_pool.select("id", "profile")
    return prefilter(titled, data.similarity, data.settings.filter).select("id", "branch")


def full_ranking(data: Dataset, ids: DataFrame | None = None) -> DataFrame:
    """Every record of the shortlist (or of the given ids) at its place, by the raw score."""
    if ids is None:
        scored = score_survivors(data.narrow, data.similarity, data.signals, data.settings)
    else:
        scored = score_ids(data.narrow, data.similarity, data.signals, ids, data.settings)
    return positions(scored.drop("source_order"), order_by("raw"))


def shortlist_scores(data: Dataset) -> DataFrame:
    """(id, final, …) of the shortlist: what orders, judges and checks a ranking."""
    scored = score_survivors(data.narrow, data.similarity, data.signals, data.settings)
    return scored.select("id", "final", "flags", "impossible", "role_match", "availability")


def judged_ranking(data: Dataset) -> DataFrame:
    """(id, final, tier, rank) of the labelled records of the shortlist, alone in order."""
    judged = metrics.judge(shortlist_scores(data).select("id", "final"), data.gold)
    return positions(judged, order_by("raw"))


def evaluation(data: Dataset) -> DataFrame:
    """The report row of the full ranking against the gold tiers."""
    return metrics.report(
        shortlist_scores(data), data.gold, data.settings.metric, order_by("raw")
    )


def sweep_features(data: Dataset) -> DataFrame:
    """What a configuration needs to score a record, with the record's gold tier."""
    scored = scored_pool(data)
    labelled = scored.join(data.gold, "id", "left")
    return labelled.select(
        "id", *data.settings.score.weights, "blend", "location", "penalties", "impossible",
        "tier", (F.size("flags") > 0).alias("has_flags"),
    )


def calibration(data: Dataset, grid: Sequence[sweep.Config]) -> DataFrame:
    """One headline row per configuration, all from one scoring."""
    features = durable(sweep_features(data))
    rows = sweep.headlines(sweep.rescore(features, grid), data.settings.metric)
    names = sweep.config_table(data.spark, grid).select("config_id", "family", "label")
    # The grid is a fixed handful of rows.
    return rows.join(F.broadcast(names), "config_id")


def encoder_texts(data: Dataset, *keys: str) -> DataFrame:
    """(id, text, keys...) given to an encoder for every record."""
    vector = data.settings.vector
    text = career_text(F.col("profile"), F.col("career_history"), vector.text_chars)
    rows = records(data.documents)
    return rows.select("id", prefixed(vector.passage_prefix, text).alias("text"), *keys)


def profile_cards(data: Dataset) -> DataFrame:
    card = profile_card(F.col("profile"), F.col("career_history"), F.col("activity"))
    return data.pool.select("id", card.alias("text"))


def extract_signals(
    requested: DataFrame,
    cached: DataFrame,
    cards: DataFrame,
    reply: Callable[[str], str],
    rubric: dict,
    on_results: Callable[[DataFrame], None],
    limit: int | None = None,
    batch_size: int = 8,
    retries: int = 1,
    log: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Cache-first signal extraction: (new records, failed ids); nothing pending, no call.

    Replies that an earlier run committed to ``log`` and that never reached the cache are
    handed on first and not asked for again.
    """
    if log is not None:
        recovered = durable(exclude(enriching.answered(cards.sparkSession, log), cached))
        if not recovered.isEmpty():
            on_results(recovered)
            cached = cached.select("id").unionByName(recovered.select("id"))
    todo = durable(enriching.pending_entries(requested, cached, cards, limit))
    head = enriching.rubric_summary(rubric)
    return enriching.enrich(
        todo, enriching.through_model(reply, log), head, batch_size=batch_size,
        retries=retries, on_results=on_results,
    )


def write_explanations(
    top: DataFrame,
    pool: DataFrame,
    cached: DataFrame,
    settings: Settings,
    rubric: dict,
    ask: enriching.Ask | None = None,
    batch_size: int = 6,
) -> DataFrame:
    """New explanation rows (id, rank, text, source, attempt) of a ranked cut.

    Without ``ask`` every text is the fallback. A generated text that fails its
    checks, or could collide with an earlier one, is asked for once more.
    """
    todo = durable(facts(exclude(top, cached), pool, settings.text))
    none = todo.select("id", F.lit("").alias("text")).limit(0)
    if ask is None:
        return todo.select(
            "id", "rank", F.col("fallback").alias("text"),
            F.lit("deterministic").alias("source"), F.lit("fallback").alias("attempt"),
        )
    head = enriching.rubric_summary(rubric)
    entries = prompt_entries(todo, settings.text)
    generated = ask_texts(entries, ask, head, batch_size)
    retried, asked = none, todo.select("id").limit(0)
    index = TextIndex(pool.sparkSession, settings.text.similar_at)
    index.add(cached.select("id", "text"))
    while True:
        chosen = durable(accept_texts(todo, generated, retried, index, settings.text))
        # Retries can push aside a text that was fine before; it then gets its own retry.
        need = durable(exclude(chosen.filter("attempt <> 'generated'").select("id"), asked))
        if need.isEmpty():
            return chosen
        asked = asked.unionByName(need)
        retried = retried.unionByName(
            ask_texts(entries.join(need, "id", "left_semi"), ask, head, 1)
        )


def build_reference(
    replies: DataFrame, encoder: Callable[[Sequence[str]], object], settings: Settings
) -> DataFrame:
    """(id, rubric, ideal_text, embedding) of target descriptions read by a model.

    ``replies`` is (id, reply), one row per description. A reply that is not a usable
    rubric fails the job; the ideal text is encoded as a query, and every vector must
    have the pool's dimension.
    """
    parsed = with_json_text(replies, "reply").withColumn("record", F.try_parse_json("json"))
    checked = durable(validated_rubrics(parsed).select("id", "rubric", "ideal_text", "issues"))
    broken = checked.filter(F.coalesce(F.size("issues"), F.lit(1)) > 0)
    require_none(violation(broken, "rubric", F.col("id"), F.array_join("issues", ", ")),
                 "reference not built")
    texts = checked.select(
        "id", prefixed(settings.vector.query_prefix, F.col("ideal_text")).alias("text")
    )
    nothing = texts.select("id").limit(0)
    vectors = durable(enriching.encode_pending(texts, nothing, encoder))
    require_none(vector_violations(vectors, settings.vector.dim), "reference not built")
    return checked.drop("issues").join(vectors, "id")


def ask_texts(entries: DataFrame, ask: enriching.Ask, head: str, size: int) -> DataFrame:
    """(id, text) of one call per batch, without retries."""
    batched = enriching.batches(entries, size)
    expected = durable(batched.select("batch_id", "id"))
    requests = enriching.prompts(batched, enriching.numbered_entry(F.col("text")), head)
    return durable(enriching.parse_replies(ask(requests), expected, "text").select("id", "text"))

