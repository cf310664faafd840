"""Integrity rules and score algebra."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from plumbline.config import TERMS, IntegritySettings, ScoreSettings
from plumbline.functions import integrity as ig
from plumbline.functions import scoring as so
from plumbline.operators import sweep
from plumbline.schema import ROLE, SKILL

RULES = IntegritySettings()
SCHEMA = f"skills array<{SKILL}>, career array<{ROLE}>, years double"


def reasons(spark, skills=(), career=(), years=5.0):
    row = spark.createDataFrame([(skills, career, years)], SCHEMA)
    codes = ig.integrity_reasons(F.col("skills"), F.col("career"), F.col("years"), RULES)
    return row.select(codes).first()[0]


def skill(proficiency="expert", months=0):
    return ("x", proficiency, 1, months)


def job(months=12, start=None, end=None):
    return ("c", "t", start, end, months, None, None, None, None)


@pytest.mark.parametrize(
    ("skills", "fires"),
    [
        ([skill()], True), ([skill(" Expert ")], True), ([skill(months=1)], False),
        ([skill(months=None)], False), ([skill("advanced")], False), (None, False),
        ([skill("advanced"), skill()], True), ([skill(None)], False),
    ],
)
def test_expert_without_use(spark, skills, fires):
    assert (ig.EXPERT_ZERO in reasons(spark, skills=skills)) is fires


@pytest.mark.parametrize(
    ("months", "years", "fires"),
    [(72, 5.0, True), (71, 5.0, False), (500, None, False), (500, 0.0, False),
     (None, 5.0, False), (13, 0.05, True)],
)
def test_role_longer_than_career(spark, months, years, fires):
    assert (ig.ROLE_EXCEEDS in reasons(spark, career=[job(months)], years=years)) is fires


@pytest.mark.parametrize(
    ("career", "fires"),
    [
        ([job(-1)], True), ([job(0)], False), ([job(1, "2020-02-01", "2020-01-01")], True),
        ([job(1, "2020-01-01", "2020-01-01")], False), ([job(1, "2020-01-01", None)], False),
        ([job(1, "junk", "2020-01-01")], False), (None, False),
    ],
)
def test_impossible_timeline(spark, career, fires):
    assert (ig.TIMELINE in reasons(spark, career=career)) is fires


def test_reasons_are_sorted(spark):
    found = reasons(spark, [skill()], [job(500), job(-3)])
    assert found == sorted(found) and len(found) == 3


def features(**changed):
    row = {t: 1.0 for t in TERMS}
    row.update(availability=0.9, location=1.0, impossible=False, flags=[])
    row.update(changed)
    return row


def final(spark, **changed):
    row = features(**changed)
    kinds = ", ".join(f"{t} double" for t in (*TERMS, "availability", "location"))
    df = spark.createDataFrame([row], f"{kinds}, impossible boolean, flags array<string>")
    settings = ScoreSettings()
    fit = so.base_fit(so.contributions(settings.weights))
    score = so.final_score(fit, so.penalty_sum(F.col("flags"), settings),
                           F.col("availability"), F.col("location"), F.col("impossible"))
    return df.select(score).first()[0]


def test_perfect_record_scores_its_multipliers(spark):
    assert final(spark) == pytest.approx(0.9)
    assert final(spark, impossible=True) == 0.0


@pytest.mark.parametrize("term", TERMS)
def test_every_term_counts(spark, term):
    lost = 0.9 * ScoreSettings().weights[term]
    assert final(spark) - final(spark, **{term: 0.0}) == pytest.approx(lost)


def test_penalties(spark):
    assert final(spark, flags=["cv_primary"]) == pytest.approx(0.65 * 0.9)
    assert final(spark, flags=["cv_primary", "cv_primary"]) == pytest.approx(0.65 * 0.9)
    assert final(spark, flags=["something_else"]) == pytest.approx(0.9)
    everything = ["consulting_only", "cv_primary", "pure_research", "job_hopper"]
    assert final(spark, flags=everything) == 0.0


def test_missing_signals_fall_back_to_similarity(spark):
    df = spark.createDataFrame(
        [(0.7, None), (0.7, ("ml_engineer", "odd", 2.0, None, True, ["x"]))],
        "cosine double, signal struct<role_archetype:string,domain:string,"
        "product_vs_services:double,seniority_band_fit:double,built_ranking_or_search:boolean,"
        "disqualifier_flags:array<string>>",
    )
    columns = so.signal_features(F.col("cosine"), F.col("signal"), ScoreSettings())
    bare, known = df.select(*[c.alias(n) for n, c in columns.items()]).collect()
    assert bare.role_match == bare.domain_match == bare.career_sim == pytest.approx(0.5)
    assert (bare.product_ratio, bare.seniority_fit, bare.built_ranking) == (0.5, 0.5, 0.0)
    assert bare.flags == []
    assert (known.role_match, known.domain_match, known.product_ratio) == (1.0, 0.2, 1.0)
    assert known.built_ranking == 1.0 and known.flags == ["x"]


def test_availability_keeps_its_floor(spark):
    settings = ScoreSettings()
    low = so.availability_from_blend(F.lit(0.0), settings.availability_floor)
    high = so.availability_from_blend(F.lit(1.0), settings.availability_floor)
    row = spark.range(1).select(low, high).first()
    assert (row[0], row[1]) == (0.7, 1.0)


@pytest.mark.parametrize("term", TERMS)
def test_set_weight_keeps_the_sum_and_the_ratios(term):
    base = ScoreSettings().weights
    moved = sweep.set_weight(base, term, 0.5)
    assert sum(moved.values()) == pytest.approx(1.0) and moved[term] == pytest.approx(0.5)
    others = [t for t in TERMS if t != term]
    ratio = moved[others[0]] / base[others[0]]
    assert all(moved[t] / base[t] == pytest.approx(ratio) for t in others)


def test_set_weight_edges():
    only = {t: (1.0 if t == "career_sim" else 0.0) for t in TERMS}
    spread = sweep.set_weight(only, "career_sim", 0.4)
    assert spread["role_match"] == pytest.approx(0.1)
    with pytest.raises(ValueError):
        sweep.renormalize({t: 0.0 for t in TERMS})


def test_grid_sizes():
    base = ScoreSettings()
    assert len(sweep.floor_grid(base)) == 7
    assert len(sweep.coordinate_grid(base)) == 35
    assert len(sweep.stability_grid(base)) == 32
    assert len(sweep.ablation_grid(base)) == 7
