"""Files in, files out."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from plumbline.config import DEFAULTS, VectorSettings
from plumbline.functions import cleaning as cl
from plumbline.operators import checks
from plumbline.operators.scored import narrow_records
from plumbline.operators.shortlist import integrity_flags
from plumbline.sources import jsonl, tables

RECORD = {
    "candidate_id": "CAND_0000001",
    "profile": {"current_title": "Senior  ML engineer", "summary": "x", "country": "India",
                "years_of_experience": 6},
    "career_history": [{"company": "A", "title": "B", "start_date": "2020-01-01",
                        "end_date": None, "duration_months": 30, "description": "ranking"}],
    "skills": [{"name": "zzleak", "proficiency": "expert", "duration_months": 0}],
    "behaviour": {"recruiter_response_rate": "high", "open_to_work_flag": True,
                  "skill_assessment_scores": {"a": 1.5}},
}


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n", encoding="utf-8")
    return str(path)


def test_records(spark, tmp_path):
    good = json.dumps(RECORD)
    path = write(tmp_path / "p.jsonl", good, "", "  ", good[:-5], good + " x", "{}")
    assert jsonl.count_lines(spark, path) == 4
    kept = jsonl.read_records(spark, path, True, "candidate_id", "behaviour")
    rows = kept.orderBy("source_order").collect()
    assert [r.id for r in rows] == ["CAND_0000001", None]
    assert rows[0].activity.recruiter_response_rate is None  # wrong type: only this is lost
    assert rows[0].activity.open_to_work_flag is True
    assert rows[0].career_history[0].duration_months == 30
    assert jsonl.rejects(jsonl.lines(spark, path)).count() == 2
    with pytest.raises(jsonl.RecordLoadError):
        jsonl.read_records(spark, path)
    narrow = narrow_records(kept.filter("id IS NOT NULL"), DEFAULTS).first()
    assert narrow.is_target is False and narrow.lexical_evidence == 0.25
    flags = integrity_flags(kept, DEFAULTS.integrity).collect()
    assert [(f.id, f.reasons) for f in flags] == [("CAND_0000001", ["expert_zero_duration"])]
    later = json.loads(good)
    later["career_history"][0]["duration_months"] = -1
    path = write(tmp_path / "twice.jsonl", good, json.dumps(later))
    twice = jsonl.read_records(spark, path, True, "candidate_id", "behaviour")
    (last,) = integrity_flags(twice, DEFAULTS.integrity).collect()
    assert set(last.reasons) == {"expert_zero_duration", "impossible_timeline"}


def test_signal_log(spark, tmp_path):
    lines = [
        json.dumps({"id": "a", "role_archetype": "ML Engineer", "seniority_band_fit": "0.8"}),
        json.dumps({"id": "b", "disqualifier_flags": ["CV-primary", "nonsense", "cv_primary"]}),
        json.dumps({"id": "a", "role_archetype": "pilot", "product_vs_services": "n/a",
                    "built_ranking_or_search": "yes"}),
        json.dumps({"role_archetype": "no id"}), "[1, 2]", '{"id": "c", "dom',
    ]
    path = write(tmp_path / "log.jsonl", *lines)
    got = {r.id: r for r in jsonl.read_signals(spark, path).collect()}
    assert set(got) == {"a", "b"}
    assert got["a"].role_archetype == "swe_generic" and got["a"].product_vs_services == 0.5
    assert got["a"].built_ranking_or_search is True and got["a"].seniority_band_fit == 0.5
    assert got["b"].disqualifier_flags == ["cv_primary"]
    assert jsonl.read_signals(spark, str(tmp_path / "none")).count() == 0


def test_text_log_and_append(spark, tmp_path):
    path = str(tmp_path / "texts")
    assert jsonl.read_texts(spark, path).count() == 0
    for text, source in (("one", "odd"), ("  two  words ", "deterministic")):
        batch = spark.createDataFrame([("a", text, source)], "id string, reasoning string, "
                                      "source string")
        jsonl.append_records(batch, path)
    assert [tuple(r) for r in jsonl.read_texts(spark, path).collect()] == [
        ("a", "two words", "deterministic")]


def test_flags(spark, tmp_path):
    path = write(tmp_path / "flags.json", json.dumps(
        {"b": {"honeypot": True, "reasons": ["x"]}, "a": {"honeypot": False}}, indent=1))
    assert sorted(r.id for r in jsonl.read_flags(spark, path).collect()) == ["a", "b"]
    table = spark.createDataFrame([("z", ["x", "y"]), ("y", [])], "id string, reasons array<string>")
    jsonl.write_flags(table, str(tmp_path / "written"))
    back = jsonl.read_flags(spark, str(tmp_path / "written"))
    assert sorted(r.id for r in back.collect()) == ["y", "z"]
    assert jsonl.read_flags(spark, str(tmp_path / "none")).count() == 0
    assert jsonl.read_flags(spark, write(tmp_path / "list.json", '["a"]')).count() == 0


def test_vectors(spark, tmp_path):
    path = str(tmp_path / "v")
    good = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8])],
                                 "id string, embedding array<double>")
    tables.write_vectors(good, path, 2)
    tables.write_vectors(good.filter("id = 'a'"), path, 2)
    assert [r.id for r in tables.read_vectors(spark, path).collect()] == ["a"]
    bad = good.unionByName(spark.createDataFrame(
        [("a", [1.0, 0.0]), (None, [1.0, 0.0]), ("c", None), ("d", [1.0])],
        "id string, embedding array<double>"))
    assert {r["check"] for r in checks.vector_violations(bad, 2).collect()} == {
        "id_duplicate", "id_missing", "vector_missing", "vector_size"}
    with pytest.raises(checks.ConstraintError):
        tables.write_vectors(bad, path, 2)
    row = tables.manifest(good, VectorSettings(dim=2), "test").first()
    assert (row.n, row.min_dim, row.max_dim) == (2, 2, 2)
    tables.write_manifest(tables.manifest(good, VectorSettings(dim=2), "t"), path + "-meta")


def test_ids(spark, tmp_path):
    listed = write(tmp_path / "ids.json", json.dumps(["b", "a"], indent=1))
    assert sorted(r.id for r in tables.read_ids(spark, listed).collect()) == ["a", "b"]
    path = str(tmp_path / "ids")
    tables.write_ids(spark.createDataFrame([("b",), ("a",)], "id string"), path)
    assert sorted(r.id for r in tables.read_ids(spark, path).collect()) == ["a", "b"]


def test_reference(spark, tmp_path):
    record = {"rubric": {"role_archetypes": ["r"], "must_haves": ["m"], "nice_to_haves": ["n"],
                         "hard_disqualifiers": ["h"], "domains": [" d  e "],
                         "seniority_band": {"min_years": 5, "max_years": 9}},
              "ideal_text": "ideal", "reference_embedding": [0.6, 0.8]}
    path = write(tmp_path / "ref.json", json.dumps(record, indent=2))
    row = tables.read_reference(spark, path).first()
    assert row.embedding == [0.6, 0.8] and row.embedding_dim == 2
    assert row.rubric.domains == ["d e"] and row.rubric.seniority_band.max_years == 9.0
    for broken in ("[1]", '{"rubric": {}}', '{"reference_embedding": []}'):
        with pytest.raises(checks.ConstraintError):
            tables.read_reference(spark, write(tmp_path / "bad.json", broken))
    out = str(tmp_path / "ref-out")
    tables.write_reference(tables.read_reference(spark, path), out)
    assert spark.read.json(out).first().embedding_dim == 2
    short = spark.createDataFrame([("a", [1.0])], "id string, embedding array<double>")
    assert checks.dimension_mismatches(
        short, tables.read_reference(spark, path)).first().mismatched == 1


def test_gold(spark, tmp_path):
    metric = DEFAULTS.metric
    path = write(tmp_path / "g.csv", "candidate_id,tier,note", "a,3,\"x, y\"", "b,,", ",4,", "a,5,z",
                 "c, 0 ,")
    got = {r.id: (r.tier, r.note) for r in tables.read_gold(spark, path, metric).collect()}
    assert got == {"a": (5, "z"), "c": (0, "")}
    for row in ("a,6", "a,x", "a,3.5"):
        with pytest.raises(checks.ConstraintError):
            tables.read_gold(spark, write(tmp_path / "bad.csv", "candidate_id,tier", row), metric)
    with pytest.raises(checks.ConstraintError):
        tables.read_gold(spark, write(tmp_path / "bad.csv", "candidate_id,score", "a,1"), metric)


def test_output_file_checks(spark, tmp_path):
    good = write(tmp_path / "good.csv", "id,rank,score,reasoning", 'AB_0000001,1,0.9,"a, b"',
                 "AB_0000002,2,0.9,c")
    assert tables.header_violations(spark, good).count() == 0
    assert checks.output_violations(tables.read_output(spark, good), 2).count() == 0
    bad = write(tmp_path / "bad.csv", "id,score,rank,reasoning", "AB_0000001,1")
    kinds = {r["check"] for r in tables.header_violations(spark, bad).collect()}
    assert kinds == {"header", "column_count"}
    long = write(tmp_path / "long.csv", "id,rank,score,reasoning", "AB_0000001,1,0.9,a,b")
    assert [(r["check"], r["row"]) for r in tables.header_violations(spark, long).collect()] == [
        ("column_count", "AB_0000001")]
    blank = write(tmp_path / "blank.csv", "id,rank,score,reasoning", "AB_0000001,1,0.9,",
                  'AB_0000002,2,0.9,""', 'AB_0000003,3,0.9,"two', 'lines"')
    assert tables.header_violations(spark, blank).count() == 0
    flawed = write(tmp_path / "flawed.csv", "id,rank,score,reasoning", "AB_0000002,1,0.5,x",
                   "AB_0000001,2,0.5,x", "ab_1,03,nan?,x", "AB_0000001,9,0.7,x")
    found = {r["check"] for r in checks.output_violations(
        tables.read_output(spark, flawed), 5).collect()}
    assert found == {"row_count", "id_pattern", "id_duplicate", "rank_format", "rank_range",
                     "rank_missing", "score_format", "score_order", "tie_order"}


REPLIES = [
    ('{"a": 1}', '{"a": 1}'),
    ('```json\n{"a": 1}\n```', '{"a": 1}'),
    ('```\n[1, 2]', "[1, 2]"),
    ('Sure: {"a": "br}ace \\" {"} done', '{"a": "br}ace \\" {"}'),
    ("list [1, [2]] and {}", "[1, [2]]"),
    ("nothing here", None),
    ("{broken", None),
    (None, None),
    ("{'a': 1}", None),
]


def test_json_recovery(spark):
    rows = [(i, text) for i, (text, _) in enumerate(REPLIES)]
    df = cl.with_json_text(spark.createDataFrame(rows, "i int, t string"), "t")
    assert [r.json for r in df.orderBy("i").collect()] == [want for _, want in REPLIES]


def test_record_lists(spark):
    texts = ['[{"id": "a"}, 3]', '{"id": "a", "role_archetype": "x"}', '{"n": 1, "z": [{}, {}], '
             '"a": [1]}', '{"id": "a"}', "7"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    sizes = df.select(F.size(cl.records(F.col("t"), ["id", "role_archetype"]))).collect()
    assert [r[0] for r in sizes] == [2, 1, 2, 0, 0]


def test_score_order_meets_across_ranges(spark):
    import random

    rng = random.Random(3)
    rows = [(f"AB_{rng.randrange(400):07d}", str(rng.randrange(1, 300)), str(rng.randrange(3)))
            for _ in range(2000)]
    rows = list({row[:2]: row for row in rows}.values())  # one row for a place and an id
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        table = spark.createDataFrame(rows, "id string, rank string, score string").repartition(5)
        found = sorted((r["check"], r["row"], r["detail"]) for r in
                       checks.score_order(table).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ordered = sorted((int(rank), name, float(score)) for name, rank, score in rows)
    wanted = []
    for (_, a, s), (r, b, t) in zip(ordered, ordered[1:]):
        if s < t:
            wanted.append(("score_order", str(r), f"{s} < {t}"))
        elif s == t and a > b:
            wanted.append(("tie_order", str(r), f"{a} > {b}"))
    assert found == sorted(wanted) and len(found) > 100
    empty = table.limit(0)
    assert checks.score_order(empty).count() == 0
    assert sorted((r["check"], r["row"]) for r in checks.output_violations(empty, 2).collect()) == [
        ("rank_missing", "1"), ("rank_missing", "2"), ("row_count", "all")]


def test_review_cards(spark, tmp_path):
    from plumbline.operators import sampling

    row = dict.fromkeys(sampling.REVIEW_COLUMNS, "")
    rows = [row | {"category": "b", "rank": 2, "id": "x", "years_experience": 4.0,
                   "current_title": "a | b", "summary": "one\ntwo", "suggested_tier": 3},
            row | {"category": "a", "rank": None, "id": "y", "years_experience": None,
                   "suggested_tier": None}]
    kinds = {"rank": "bigint", "years_experience": "double", "suggested_tier": "int"}
    sheet = spark.createDataFrame(
        [tuple(r[n] for n in sampling.REVIEW_COLUMNS) for r in rows],
        ", ".join(f"{n} {kinds.get(n, 'string')}" for n in sampling.REVIEW_COLUMNS))
    path = tmp_path / "cards"
    tables.write_cards(sampling.card_lines(sampling.review_cards(sheet)), str(path))
    (part,) = path.glob("part-*")
    text = part.read_text()
    assert text.index("## a (1)") < text.index("### `y`") < text.index("## b (1)")
    assert "| Title | a \\| b |" in text and "| Years | 4.0 |" in text
    assert "> **Summary.** one\n> two" in text and text.count("Draft tier: none") == 1


def test_log_lines_are_parsed_once(spark, data):
    from plumbline.catalog import REGISTRY

    texts = ['{"a":1}', ' {"a":{"v":2}} ', '{"a":1}}', '{"a":1} {"a":2}', "{}", "[]", "null", "1",
             '"x"', "", " ", None, '{"a":1},{"a":2}', '{"a":1},"v":2', "1],[2", '{"a":1,"a":2}',
             '{"v":null}', "{", '{"a":1}]', '],["']
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    record = F.when(cl.is_json(F.col("t")), F.try_parse_json("t"))
    slow = df.withColumn("r", record).filter(cl.is_object(F.col("r"))).select("i", F.to_json("r"))
    fast = cl.object_rows(df, "t", "r").select("i", F.to_json("r"))
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.collect()))
    assert fast.count() == 4
    plan = REGISTRY["s9_signal_log"].plan(data)._jdf.queryExecution().executedPlan().toString()
    final, _, initial = plan.partition("Initial Plan")
    assert (initial or final).lower().count("parsejson") <= 2
