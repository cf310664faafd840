"""Positions, cuts, skewed groups, plan shapes and the ranked file."""

from __future__ import annotations

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from plumbline.operators import membership as mb
from plumbline.operators import metrics
from plumbline.operators import ordering as od
from plumbline.operators.durable import stored
from plumbline.operators.skew import salted_join
from plumbline.plans import jobs
from plumbline.sources import tables


def rows(spark, n=3000, parts=7):
    """One group holds a third of the rows, and many values are equal."""
    rng = random.Random(3)
    made = [
        (f"id{i:05d}", "hot" if rng.random() < 0.34 else f"g{rng.randrange(40)}",
         float(rng.randrange(50)))
        for i in range(n)
    ]
    return made, spark.createDataFrame(made, "id string, g string, v double").repartition(parts)


def order():
    return [F.col("v").desc(), F.col("id").asc()]


def ranked_by_hand(made, group=False):
    done, seen = {}, {}
    for i, g, v in sorted(made, key=lambda r: (-r[2], r[0])):
        key = g if group else ""
        seen[key] = seen.get(key, 0) + 1
        done[i] = seen[key]
    return done


@pytest.mark.parametrize("parts", [1, 16])
def test_positions(spark, parts):
    made, df = rows(spark, parts=parts)
    got = {r.id: r.rank for r in od.positions(df, order()).collect()}
    assert got == ranked_by_hand(made)


def test_positions_in_a_hot_group(spark):
    made, df = rows(spark)
    got = {r.id: r.rank for r in od.positions(df, order(), ["g"]).collect()}
    assert got == ranked_by_hand(made, group=True)


def test_positions_span_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        made, df = rows(spark)
        stamped = od._sorted_slices(df, order(), ["g"])
        hot = stamped.filter("g = 'hot'").select("_part").distinct().count()
        assert hot > 1
        got = {r.id: r.rank for r in od.positions(df, order(), ["g"]).collect()}
        assert got == ranked_by_hand(made, group=True)
        totals = od.running_totals(df, order(), ["g"], {"n": F.lit(1), "s": F.col("v")})
        last = {r.g: (r.n, r.s) for r in totals.groupBy("g").agg(
            F.max("n").alias("n"), F.max("s").alias("s")).collect()}
        for g in {m[1] for m in made}:
            mine = [m[2] for m in made if m[1] == g]
            assert last[g] == (len(mine), sum(mine))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_cuts(spark):
    made, df = rows(spark, 400)
    by_hand = ranked_by_hand(made)
    top = {r.id: r.rank for r in od.top_n(df, order(), 10).collect()}
    assert top == {i: r for i, r in by_hand.items() if r <= 10}
    grouped = ranked_by_hand(made, group=True)
    each = {r.id: r.rank for r in od.top_per_group(df, ["g"], order(), 2).collect()}
    assert each == {i: r for i, r in grouped.items() if r <= 2}
    large = od.top_n(df, order(), 1001).count()
    assert large == 400
    with pytest.raises(od.TooFewRows):
        od.require_rows(od.top_n(df, order(), 500), 500)


def test_first_and_last_per_key(spark):
    df = spark.createDataFrame(
        [("a", 2, "late"), ("a", 1, "early"), ("", 1, "x"), (None, 1, "y"), ("b", 5, "only")],
        "id string, seq int, what string",
    )
    first = {r.id: r.what for r in od.first_per_key(df, "id", [F.col("seq").asc()]).collect()}
    assert first == {"a": "early", "b": "only"}
    last = {r.id: r.what for r in od.last_per_key(df, "id", F.col("seq")).collect()}
    assert last["a"] == "late" and last["b"] == "only"


def test_salted_join_equals_plain_join(spark):
    made, df = rows(spark)
    small = df.select("g").distinct().withColumn("w", F.length("g"))
    plain = sorted(map(tuple, df.join(small, "g").select("id", "g", "w").collect()))
    split = salted_join(df, small, "g", "id", rows_per_slice=50).select("id", "g", "w")
    assert sorted(map(tuple, split.collect())) == plain
    few = small.filter("g <> 'hot'")
    left = salted_join(df, few, "g", "id", "left", rows_per_slice=50)
    assert left.count() == len(made)
    assert left.filter("w IS NULL").count() == sum(m[1] == "hot" for m in made)


def test_quantile_takes_the_lower_position(spark):
    df = spark.createDataFrame([(float(v),) for v in range(7)], "v double")
    assert od.lower_quantile(df, "v", 0.3).first()[0] == 1.0
    assert od.lower_quantile(df.limit(0), "v", 0.3).first()[0] == 0.0


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plan_shapes(spark, data):
    _, df = rows(spark, 100)
    # The input is a local table, so the plans are asserted on a stored copy.
    df = stored(df)
    assert "TakeOrderedAndProject" in plan_of(od.top_n(df, order(), 5))
    assert plan_of(od.top_per_group(df, ["g"], order(), 3)).count("WindowGroupLimit") == 2
    assert "WindowGroupLimit" in plan_of(od.first_per_key(df, "id", [F.col("v").asc()]))
    scan = plan_of(data.similarity)
    assert "Subquery" in scan and "Join" not in scan and "Cartesian" not in scan


def test_texts_do_not_travel(data):
    """No exchange below the score carries the text or the role array."""
    plan = plan_of(jobs.scored_pool(data))
    assert "Cartesian" not in plan and "BroadcastNestedLoop" not in plan
    narrow = data.narrow.columns
    assert "profile" not in narrow and "career_history" not in narrow


def test_rank_run_reads_texts_once(data):
    """Features and integrity come from one scan, and no exchange carries a text."""
    plan = jobs.scored_pool(data)._jdf.queryExecution().optimizedPlan()
    scans = [str(plan.collectLeaves().apply(i).output().mkString(","))
             for i in range(plan.collectLeaves().size())]
    assert sum("text#" in scan for scan in scans) == 1
    df = jobs.scored_pool(data)
    mode = df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    nodes = df._jdf.queryExecution().explainString(mode).split("\n\n")
    exchanges = [node for node in nodes if "Exchange" in node.strip().split("\n")[0]]
    assert exchanges and not any("text#" in node for node in exchanges)
    wide = [name for name in jobs.scored_pool(data).columns if name in ("text", "profile")]
    assert wide == []


def test_short_cuts_fail(data):
    passed = jobs.scored_pool(data).count()
    assert jobs.ranked_output(data, passed).count() == passed
    with pytest.raises(od.TooFewRows):
        jobs.ranked_output(data, passed + 1)


def test_any_contradictory_record_marks_its_id(spark):
    """First record of an id stays; a later contradictory one marks it all the same."""
    from plumbline.operators.shortlist import with_impossible

    rows = [("a", 1, False), ("a", 2, True), ("b", 1, False), ("c", 1, True), (None, 1, True),
            (None, 2, False), ("", 3, True)]
    df = spark.createDataFrame(rows, "id string, line int, contradictory boolean")
    kept = with_impossible(df, [F.col("line").asc()])
    assert sorted((r.id, r.line, r.impossible) for r in kept.collect()) == [
        ("a", 1, True), ("b", 1, False), ("c", 1, True)]
    every = [(r.id, r.line, bool(r.impossible)) for r in with_impossible(df).collect()]
    assert sorted(every, key=str) == sorted(
        [("a", 1, True), ("a", 2, True), ("b", 1, False), ("c", 1, True), (None, 1, False),
         (None, 2, False), ("", 3, True)], key=str)


def test_filter_is_pushed_to_the_scan(data):
    plan = plan_of(data.reference)
    assert "PushedFilters: [IsNotNull(vec_id), EqualTo(vec_id,0)]" in plan


def test_ranked_output_is_deterministic(spark, data, tmp_path):
    first = jobs.ranked_output(data, 30)
    tables.write_ranked(first, str(tmp_path / "a"), 30)
    tables.write_ranked(jobs.ranked_output(data, 30), str(tmp_path / "b"), 30)

    def content(name):
        (file,) = Path(tmp_path / name).glob("*.csv")
        return file.read_bytes()

    assert content("a") == content("b")
    head, *body = content("a").decode().split("\n")
    assert head == "id,rank,score,reasoning" and body[0].split(",")[1] == "1"
    with pytest.raises(od.TooFewRows):
        tables.write_ranked(jobs.ranked_output(data, 900), str(tmp_path / "c"), 900)


def test_unseen_vector_and_membership(spark):
    pool = spark.createDataFrame([("a",), ("b",)], "id string")
    sims = spark.createDataFrame([("a", 0.5)], "id string, cosine double")
    got = {r.id: (r.cosine, r.has_vector) for r in mb.with_similarity(pool, sims).collect()}
    assert got == {"a": (0.5, True), "b": (-1.0, False)}
    twice = spark.createDataFrame([("a",), ("a",)], "id string")
    marked = {r.id: r.hit for r in mb.with_membership(pool, twice, "hit").collect()}
    assert marked == {"a": True, "b": False}


def test_cached_text_wins_unless_empty(spark):
    top = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    texts = spark.createDataFrame([("a", " x  y "), ("b", " \t ")], "id string, text string")
    got = {r.id: r.reasoning for r in mb.with_text(top, texts, F.lit("own")).collect()}
    assert got == {"a": "x y", "b": "own", "c": "own"}


def judged(spark, tiers, query="q"):
    data = [(query, f"d{i}", i + 1, t) for i, t in enumerate(tiers)]
    return spark.createDataFrame(data, "query string, id string, rank int, tier int")


def test_metric_goldens(spark):
    short = metrics.dcg(judged(spark, [3, 2, 3]), ["query"], (3,)).first()
    assert short["dcg_at_3"] == pytest.approx(5.7618595, abs=1e-6)
    long = metrics.ndcg(judged(spark, [3, 2, 3, 0, 1, 2]), ["query"], (3,)).first()
    assert long["ndcg_at_3"] == pytest.approx(0.9777823, abs=1e-6)
    none = judged(spark, [0, 0])
    assert metrics.ndcg(none, ["query"], (10,)).first()["ndcg_at_10"] == 0.0
    assert metrics.average_precision(none, ["query"], 3).first()["average_precision"] == 0.0
    assert metrics.precision(judged(spark, [3, 1, 4]), ["query"], 10, 3).first()[1] == 0.2
    mixed = metrics.average_precision(judged(spark, [4, 0, 3, 0]), ["query"], 3).first()[1]
    assert mixed == pytest.approx((1 + 2 / 3) / 2)


def test_map_over_queries(spark):
    both = judged(spark, [4, 0], "a").unionByName(judged(spark, [0, 4], "b"))
    per_query = metrics.average_precision(both, ["query"], 3)
    assert metrics.mean_average_precision(per_query).first()[0] == pytest.approx(0.75)
    assert metrics.mean_average_precision(per_query.limit(0)).first()[0] == 0.0
