from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from plumbline.config import EVIDENCE_KEYWORDS
from plumbline.functions import scalar as sc
from plumbline.functions import text as tx
from plumbline.functions import vector as ve


def values(spark, rows, schema, expression):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expression).collect()]


def test_squeeze_splits_like_python(spark):
    texts = ["  a  b ", "a\tb\n", " a b ", "a\x1cb\x85c\x0bd", "", None, "é  ü"]
    got = values(spark, [(t,) for t in texts], "t string", sc.squeeze(F.col("t")))
    assert got == [" ".join((t or "").split()) for t in texts]


def test_fixed_rounds_like_python(spark):
    rng = random.Random(7)
    numbers = [rng.uniform(-2, 2) for _ in range(2000)] + [0.1234565, 0.5e-6, 1.5e-6, 0.0]
    numbers += [i / 2**7 for i in range(200)]
    got = values(spark, [(n,) for n in numbers], "x double", sc.fixed(F.col("x")))
    assert got == [f"{n:.6f}" for n in numbers]


def test_fixed_any_prints_numbers_of_any_size(spark):
    rng = random.Random(8)
    numbers = [rng.choice((-1, 1)) * 2.0 ** rng.uniform(20, 1023.9) for _ in range(200)]
    numbers += [2.0 ** rng.uniform(30, 66) for _ in range(1000)] + [2.0**n for n in range(30, 70)]
    numbers += [2.0**33 + i / 2**19 for i in range(200)] + [2.0**n - 2.0 ** (n - 53) for n in
                                                            (33, 34, 40, 52, 63, 64, 72, 1023)]
    numbers += [1e22, 1e23, 123456789012345678901.0, 1.7976931348623157e308, 0.0, 5e-7, -1.5,
                float("inf"), float("-inf"), float("nan"), 10000000000.9999995, 2.0**1023]
    got = values(spark, [(n,) for n in numbers], "x double", sc.fixed_any(F.col("x")))
    assert got == [f"{n:.6f}" for n in numbers]
    got = values(spark, [(n,) for n in numbers], "x double", sc.fixed_any(F.col("x"), 0))
    assert got == [f"{n:.0f}" for n in numbers]


def test_long_numbers_of_texts_match_sql(spark, tmp_path):
    import duckdb

    from plumbline.catalog import REGISTRY
    from plumbline.plans.dataset import Dataset

    texts = ["a 123456789012345678901 b 18446744073709551616 9007199254740993", "1" * 40 + ".5",
             "x " + "9" * 400, "17179869184.0000005 123456789012.1234567", "no", "4 4.25 0.0000015"]
    rows = [(i, t, "en", "web", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"
    ).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(
        f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    for name in ("documents", "events"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("t12_numbers", "g3_known_numbers"):
        found = REGISTRY[name].plan(Dataset(spark, str(tmp_path))).collect()
        assert sorted(map(tuple, found)) == sorted(con.execute(REGISTRY[name].sql).fetchall())


def test_general_prints_like_python(spark):
    numbers = [7.6, 5.0, 0.0, 123456.7, 999999.6, 1e10, 0.0001, 0.00001234, -2.5, 99999.95]
    got = values(spark, [(n,) for n in numbers], "x double", sc.general(F.col("x")))
    assert got == [f"{n:g}" for n in numbers]


def test_lenient_dates(spark):
    texts = ["2026-06-01", "2026-06-01T10:00", "2026-6-1", "20260601", "2026-02-30", "soon", None]
    got = values(spark, [(t,) for t in texts], "t string", sc.iso_date(F.col("t")).cast("string"))
    assert got == ["2026-06-01", "2026-06-01", None, "2026-06-01", None, None, None]


def test_recency_boundaries(spark):
    rows = [("2026-06-28",), ("2026-07-05",), ("2026-03-30",), ("2025-12-30",), ("2020-01-01",),
            ("junk",), (None,)]
    got = values(spark, rows, "d string", sc.recency_score(F.col("d"), "2026-06-28", 180))
    assert got == [1.0, 1.0, 0.5, 0.0, 0.0, 0.5, 0.5]


def test_neutral_values(spark):
    rows = [(None,), (-1.0,), (0.4,), (1.7,)]
    assert values(spark, rows, "x double", sc.unit_rate(F.col("x"))) == [0.5, 0.0, 0.4, 1.0]
    assert values(spark, rows, "x double", sc.sentinel_rate(F.col("x"))) == [0.5, 0.5, 0.4, 1.0]
    assert values(spark, rows, "x double", sc.clip01(F.col("x"))) == [None, 0.0, 0.4, 1.0]
    flags = [(True,), (False,), (None,)]
    assert values(spark, flags, "b boolean", sc.flag_score(F.col("b"), 1.0, 0.3)) == [1, 0.3, 0.5]
    days = [(0,), (90,), (400,), (None,)]
    assert values(spark, days, "d int", sc.notice_score(F.col("d"), 180)) == [1, 0.5, 0, 0.5]


def test_rescale_and_empty_window(spark):
    rows = [(0.55,), (0.70,), (0.95,)]
    got = values(spark, rows, "x double", sc.rescale(F.col("x"), 0.6, 0.8))
    assert got == pytest.approx([0.0, 0.5, 1.0])
    assert values(spark, rows, "x double", sc.rescale(F.col("x"), 0.8, 0.8)) == [0.55, 0.70, 0.95]


def test_threshold_is_inclusive(spark):
    rows = [(False, 0.725), (False, 0.7249), (True, -1.0)]
    kept = sc.passes_filter(F.col("t"), F.col("s"), 0.725)
    assert values(spark, rows, "t boolean, s double", kept) == [True, False, True]
    branch = sc.filter_branch(F.col("t"), F.col("s"), 0.725)
    assert values(spark, [(True, 0.8), (True, 0.1), (False, 0.8)], "t boolean, s double",
                  branch) == ["both", "archetype", "similarity"]


PERSON = (
    "profile struct<current_title:string,summary:string,location:string,country:string,"
    "years_of_experience:double>, career_history array<struct<company:string,title:string,"
    "start_date:string,end_date:string,duration_months:int,is_current:boolean,industry:string,"
    "company_size:string,description:string>>, activity struct<last_active_date:string,"
    "open_to_work_flag:boolean,recruiter_response_rate:double,interview_completion_rate:double,"
    "notice_period_days:int,willing_to_relocate:boolean>"
)


def person(title="ML  Engineer", summary=" Builds search ", roles=(), activity=None, years=7.6):
    return ((title, summary, "Pune", "India", years), list(roles), activity)


def role(title="Dev", company="Acme", months=12, description="did  things"):
    return (company, title, None, None, months, None, None, None, description)


def test_career_text_order_and_cap(spark):
    rows = [person(roles=[role(), role(description=""), role(description="last")]),
            (None, None, None)]
    text = tx.career_text(F.col("profile"), F.col("career_history"), None)
    assert values(spark, rows, PERSON, text) == ["ML Engineer Builds search did things last", ""]
    short = tx.career_text(F.col("profile"), F.col("career_history"), 12)
    assert values(spark, rows, PERSON, short)[0] == "ML Engineer"


def test_profile_card(spark):
    busy = ("2026-06-01", True, 0.85, None, 30, False)
    roles = [role(), role(title=None, company=" ", months=None, description=None)]
    card = tx.profile_card(F.col("profile"), F.col("career_history"), F.col("activity"))
    got = values(spark, [person(roles=roles, activity=busy), person("", None, (), None, None)],
                 PERSON, card)
    assert got[0] == (
        "Current role: ML Engineer · 7.6 yrs experience · Pune, India\n"
        "Summary: Builds search\nCareer history:\n- Dev @ Acme (12 mo): did things\n"
        "- (role) @ (company)\nAvailability signals: last_active=2026-06-01, open_to_work=True, "
        "recruiter_response_rate=0.85, notice_period_days=30, willing_to_relocate=False"
    )
    assert got[1] == "Current role: (no title) · Pune, India"


def test_card_shows_six_roles(spark):
    card = tx.profile_card(F.col("profile"), F.col("career_history"), F.col("activity"))
    text = values(spark, [person(roles=[role(title=f"r{i}") for i in range(9)])], PERSON, card)[0]
    assert "r5" in text and "r6" not in text


def test_keyword_evidence_is_substring_based(spark):
    rows = [("stores in storage",), ("Ranking with NDCG over FAISS retrieval",), ("",)]
    got = values(spark, rows, "t string", tx.keyword_evidence(F.col("t"), EVIDENCE_KEYWORDS))
    assert got == [0.25, 1.0, 0.0]


def test_cuts(spark):
    text = [("aaa bbb ccc",), ("aaabbbccc",), ("aaa",)]
    assert values(spark, text, "t string", tx.clip_text(F.col("t"), 5)) == [
        "aaa…", "aaab…", "aaa"]
    assert values(spark, text, "t string", tx.truncate_words(F.col("t"), 5)) == [
        "aaa…", "aaabb…", "aaa"]


def test_sentences_numbers_words(spark):
    rows = [("Has 7.6 years. Did 12 things! ok?",)]
    assert values(spark, rows, "t string", tx.sentence_count(F.col("t"))) == [4]
    assert values(spark, rows, "t string", tx.numbers(F.col("t"))) == [[7.6, 12.0]]
    assert values(spark, rows, "t string", tx.fingerprint(F.col("t"))) == [
        "has # years did # things ok"]


def test_readable_join(spark):
    rows = [([],), (["a"],), (["a", "b"],), (["a", "b", "c"],)]
    got = values(spark, rows, "x array<string>", tx.readable_join(F.col("x")))
    assert got == ["", "a", "a and b", "a, b and c"]


def test_vectors(spark):
    rows = [([3.0, 4.0], [1.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])]
    schema = "a array<float>, b array<float>"
    assert values(spark, rows, schema, ve.dot(F.col("a"), F.col("b"))) == [11.0, 0.0]
    unit = values(spark, rows, schema, ve.l2_normalize(F.col("a")))
    assert unit[0] == pytest.approx([0.6, 0.8]) and unit[1] == [0.0, 0.0]
