"""Enrichment with a stand-in model, and texts accepted against a sequential model."""

from __future__ import annotations

import json
import os
import re
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from plumbline.config import TextSettings
from plumbline.functions import grounding as gr
from plumbline.operators import enrich, explain
from plumbline.operators.membership import bind_expected, pending
from plumbline.operators.textindex import TextIndex
from plumbline.plans import jobs
from plumbline.sources import jsonl
from test_neardup import corpus, similar

TEXT = TextSettings()
# Workers cannot import test modules, so the helpers below travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def entries(spark, n):
    rows = [(f"c{i:02d}", f"text {i}") for i in range(n)]
    return spark.createDataFrame(rows, "id string, text string")


def asked(prompt):
    return re.findall(r"(?m)^\[\d+\] id: (\S+)", prompt)


def answer(ids):
    return json.dumps([{"id": i, "role_archetype": "ml engineer"} for i in ids])


def run(spark, reply, n=10, size=4, retries=1):
    passes = []
    found, failed = enrich.enrich(
        entries(spark, n), enrich.through_model(reply), "HEAD", batch_size=size, retries=retries,
        on_results=lambda df: passes.append(df.count()),
    )
    return sorted(r.id for r in found.collect()), [r.id for r in failed.collect()], passes


def test_all_answered(spark):
    ids, failed, passes = run(spark, lambda p: answer(asked(p)))
    assert len(ids) == 10 and failed == [] and passes == [10]


def test_missing_records_are_asked_alone(spark):
    def reply(prompt):
        ids = asked(prompt)
        return answer(ids if len(ids) == 1 else ids[1:])

    ids, failed, passes = run(spark, reply)
    assert len(ids) == 10 and failed == [] and passes == [7, 3]


def test_failures_are_listed(spark):
    def reply(prompt):
        if "c03" in prompt:
            raise RuntimeError("no service")
        return "```json\n" + answer(asked(prompt)) + "\n```"

    ids, failed, _ = run(spark, reply)
    assert failed == ["c03"] and len(ids) == 9


def test_foreign_ids_are_dropped_and_a_single_answer_is_bound(spark):
    def reply(prompt):
        ids = asked(prompt)
        return answer(["zzz"] if len(ids) == 1 else [*ids[:-1], "zzz"])

    ids, failed, _ = run(spark, reply, n=4)
    assert ids == ["c00", "c01", "c02", "c03"] and failed == []


def test_batch_size_must_be_positive(spark):
    with pytest.raises(ValueError):
        enrich.batches(entries(spark, 2), 0)


def test_batches_are_consecutive(spark):
    rows = enrich.batches(entries(spark, 10), 4).orderBy("id").collect()
    assert [r.batch_id for r in rows] == [0] * 4 + [1] * 4 + [2] * 2
    assert [r.n for r in rows] == [1, 2, 3, 4, 1, 2, 3, 4, 1, 2]


def test_cached_run_makes_no_call(spark, tmp_path):
    path = str(tmp_path / "signals")
    requested = entries(spark, 6).select("id")

    def reply(prompt):
        return answer(i for i in asked(prompt) if i != "c05")

    def once(call, limit=None):
        return jobs.extract_signals(
            requested, jsonl.read_signals(spark, path), entries(spark, 6), call, {},
            lambda df: jsonl.append_records(df, path), limit=limit, batch_size=4,
        )

    # The first run is cut short, as if it was interrupted between two batches.
    once(reply, limit=2)
    assert sorted(r.id for r in jsonl.read_signals(spark, path).collect()) == ["c00", "c01"]
    _, failed = once(reply)
    assert [r.id for r in failed.collect()] == ["c05"]
    assert pending(requested, jsonl.read_signals(spark, path)).count() == 1
    once(lambda p: answer(asked(p)))
    assert pending(requested, jsonl.read_signals(spark, path)).count() == 0

    def never(prompt):
        raise AssertionError("called")

    new, failed = once(never)
    assert new.count() == 0 and failed.count() == 0


def test_a_run_that_dies_loses_the_requests_it_was_at(spark, tmp_path):
    """Every reply is committed by itself; the next run asks for the rest only."""
    log, cache, notes = (str(tmp_path / name) for name in ("log", "cache", "notes"))
    (tmp_path / "notes").mkdir()
    pool = entries(spark, 40)

    class Killed(BaseException):
        """What ends a worker; nothing catches it."""

    def once(dies_at):
        def reply(prompt):
            ids = asked(prompt)
            if dies_at in ids:
                # The others have time to commit theirs.
                import time

                time.sleep(8)
                raise Killed
            with open(f"{notes}/{'+'.join(ids)}-{dies_at}", "w"):
                pass
            return answer(i for i in ids if i != "c09")

        return jobs.extract_signals(
            pool.select("id"), jsonl.read_signals(spark, cache), pool, reply, {},
            lambda df: jsonl.append_records(df, cache), batch_size=4, log=log,
        )

    with pytest.raises(Exception):  # noqa: B017 - whatever Spark makes of a lost worker
        once("c38")
    assert jsonl.read_signals(spark, cache).count() == 0
    kept = {r.id for r in enrich.answered(spark, log).collect()}
    before = {name for name in os.listdir(notes)}
    assert {"c00", "c01", "c20"} <= kept and not {"c36", "c37", "c38", "c39", "c09"} & kept
    found, failed = once("nothing")
    again = {i for name in set(os.listdir(notes)) - before
             for i in name.rsplit("-", 1)[0].split("+")}
    assert again == {f"c{i:02d}" for i in range(40)} - kept
    assert {r.id for r in jsonl.read_signals(spark, cache).collect()} == {
        f"c{i:02d}" for i in range(40)} - {"c09"}
    assert [r.id for r in failed.collect()] == ["c09"]


def test_units_are_made_once(spark, tmp_path):
    from plumbline.sources import commits

    def produce(key, rows):
        return f"{key} {len(list(rows))}\n".encode()

    rows = spark.createDataFrame([(i // 3, i) for i in range(30)], "unit int, i int")
    ordered = rows.repartition(4, "unit").sortWithinPartitions("unit")
    folder = str(tmp_path / "units")
    for _ in range(2):
        commits.write_units(ordered, folder, "unit", produce, ".txt")
    assert sorted(r.value for r in spark.read.text(folder).collect()) == sorted(
        f"{i} 3" for i in range(10))
    runs = [json.loads((tmp_path / "units" / name).read_text())
            for name in os.listdir(folder) if name.startswith("_run")]
    assert sorted((r["made"], r["found"]) for r in runs) == [(0, 10), (10, 0)]


def test_bind_expected(spark):
    expected = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], "batch_id int, id string")
    returned = spark.createDataFrame(
        [(1, 0, "x"), (2, 0, "b"), (2, 1, "x")], "batch_id int, seq int, id string"
    )
    got = sorted((r.batch_id, r.id) for r in bind_expected(returned, expected).collect())
    assert got == [(1, "a"), (2, "b")]


def test_encoding_resumes(spark):
    texts = entries(spark, 5)
    first = enrich.encode_pending(texts.limit(0).unionByName(texts.filter("id < 'c02'")),
                                  texts.select("id").limit(0), enrich.hashed_words(64))
    rest = enrich.encode_pending(texts, first, enrich.hashed_words(64))
    assert sorted(r.id for r in rest.collect()) == ["c02", "c03", "c04"]
    with pytest.raises(Exception, match="missing its id"):
        bad = spark.createDataFrame([(None, "x")], "id string, text string")
        enrich.encode_pending(bad, first, enrich.hashed_words(64)).collect()


def numbered_texts(spark, path, rows=600, files=6):
    spark.range(rows).select(
        F.col("id").alias("key"), F.format_string("c%03d", "id").alias("id"),
        F.concat(F.lit("text number "), F.col("id").cast("string")).alias("text"),
    ).repartitionByRange(files, "key").sortWithinPartitions("key").write.parquet(path)
    return spark.read.parquet(path)


def test_encoding_goes_on_where_it_died(spark, tmp_path):
    """Chunks are committed one by one; a second run reads and encodes the rest only."""
    texts = numbered_texts(spark, str(tmp_path / "texts"))
    folder, notes = str(tmp_path / "vectors"), tmp_path / "notes"
    notes.mkdir()
    none = texts.select("key").limit(0)
    encode = enrich.hashed_words(8)

    def encoder(dies_at, name):
        def run(batch):
            if any(text.endswith(f" {dies_at}") for text in batch):
                import time

                time.sleep(6)
                raise RuntimeError("out of memory")
            with open(f"{notes}/{name}-{batch[0].split()[-1]}", "w") as out:
                out.write("\n".join(batch))
            return encode(batch)

        return run

    def asked_of(name):
        return {line.split()[-1] for path in notes.glob(f"{name}-*")
                for line in path.read_text().splitlines()}

    with pytest.raises(Exception, match="out of memory"):
        enrich.encode_chunks(texts, none, encoder(250, "first"), folder, "key", chunk=40)
    kept = {r.key for r in enrich.read_chunks(spark, folder, "key").collect()}
    assert 400 <= len(kept) < 600 and 250 not in kept
    ranges = enrich.pending_ranges(texts, enrich.read_chunks(spark, folder, "key"), "key").collect()
    assert sum(r.rows for r in ranges) == 600 - len(kept) and all(r.gaps == 0 for r in ranges)
    left = enrich.pending_texts(texts, enrich.read_chunks(spark, folder, "key"), "key")
    plan = left._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan and "Join" not in plan and "Exchange" not in plan
    enrich.encode_chunks(texts, none, encoder(-1, "second"), folder, "key", chunk=40)
    assert {int(i) for i in asked_of("second")} == set(range(600)) - kept
    found = enrich.read_chunks(spark, folder, "key").collect()
    assert sorted(r.key for r in found) == list(range(600))
    assert enrich.pending_ranges(texts, enrich.read_chunks(spark, folder, "key"), "key").count() == 0
    rows = {r.key: r for r in found}
    assert rows[7].id == "c007" and rows[7].embedding == pytest.approx(
        [float(x) for x in encode(["text number 7"])[0]])


def test_many_ranges_are_drawn_together(spark, tmp_path):
    texts = numbered_texts(spark, str(tmp_path / "texts"), 200, 3)
    done = texts.filter("key % 3 = 0").select("key")
    ranges = enrich.pending_ranges(texts, done, "key", most=10).collect()
    assert len(ranges) <= 10 and sum(r.rows for r in ranges) == 133
    assert sum(r.gaps for r in ranges) > 0
    left = enrich.pending_texts(texts, done, "key")
    assert {r.key for r in left.collect()} == {i for i in range(200) if i % 3}


def test_rubric_summary():
    text = enrich.rubric_summary(
        {"role_archetypes": ["a", "b"], "must_haves": ["m"],
         "seniority_band": {"min_years": 5, "max_years": 9.5, "notes": "soft"}}
    )
    assert text.splitlines() == [
        "Roles that fit: a; b.", "Evidence to look for in the roles: m.",
        "Years of experience: from 5 to 9.5.", "On experience: soft"]


def test_reference_build(spark):
    from plumbline.config import Settings, VectorSettings
    from plumbline.operators.checks import ConstraintError

    rubric = {n: ["x"] for n in ("role_archetypes", "must_haves", "nice_to_haves",
                                 "hard_disqualifiers", "domains")}
    rubric["seniority_band"] = {"min_years": 5, "max_years": 9}
    good = "```json\n" + json.dumps({"rubric": rubric, "ideal_text": "a  b"}) + "\n```"
    settings = Settings(vector=VectorSettings(dim=64))

    def build(reply, dim=64):
        rows = spark.createDataFrame([("jd", reply)], "id string, reply string")
        return jobs.build_reference(rows, enrich.hashed_words(dim), settings).first()

    row = build(good)
    assert row.ideal_text == "a b" and len(row.embedding) == 64
    for broken in ("no json", json.dumps({"rubric": {}, "ideal_text": "x"})):
        with pytest.raises(ConstraintError):
            build(broken)
    with pytest.raises(ConstraintError):
        build(good, 8)


WORLD = (["pytorch", "ranking", "acme"], [6.0, 30.0])


@pytest.mark.parametrize(
    ("text", "issues"),
    [
        ("Built ranking with PyTorch over 6 years at Acme, well.", []),
        ("", ["empty reasoning"]),
        ("Too short.", ["too short (10 chars)"]),
        ("Worked with Faiss and also AWS at a large product company.",
         ["ungrounded terms: AWS, Faiss"]),
        ("Faiss starts this sentence which makes it an ordinary word.", []),
        ("has 6.4 years and a 45-day notice period as written here",
         ["ungrounded numbers: 45"]),
        ("one two three four. five six seven. eight nine ten. eleven.",
         ["too many sentences (>3)"]),
        ("An ML engineer in India with NLP depth and steady delivery.", []),
    ],
)
def test_grounding(spark, text, issues):
    row = spark.createDataFrame([(text, *WORLD)], "t string, w array<string>, n array<double>")
    found = gr.text_issues(F.col("t"), F.col("w"), F.col("n"), TEXT)
    assert row.select(found).first()[0] == issues


def test_long_text(spark):
    text = "word " * 80
    row = spark.createDataFrame([(text, *WORLD)], "t string, w array<string>, n array<double>")
    found = row.select(gr.text_issues(F.col("t"), F.col("w"), F.col("n"), TEXT)).first()[0]
    assert found == ["too long (399 chars)"]


def test_leading_terms(spark):
    df = spark.createDataFrame([(0.1, 0.3, 0.3, 0.0), (0.0, 0.0, 0.2, 0.0)],
                               "a double, b double, c double, d double")
    names = gr.leading_terms({n: F.col(n) for n in "abcd"}, 3)
    assert [r[0] for r in df.select(names).collect()] == [["b", "c", "a"], ["c"]]


@pytest.mark.parametrize("rank", [1, 11, 31, 61])
def test_fallback_texts_pass_their_own_checks(spark, rank):
    from plumbline.config import ROLE_PHRASES

    rows = [(r, f"Senior {r} Lead", 7.6) for r in ROLE_PHRASES]
    df = spark.createDataFrame(rows, "role string, title string, years double")
    gaps = gr.gap_notes(F.array(F.lit("cv_primary")), F.lit(120), F.lit(0.9), F.lit(True), TEXT)
    text = gr.fallback_text(F.lit(rank), F.col("title"), F.col("years"), F.col("role"),
                            F.lit(False), gaps)
    terms = gr.known_terms(F.col("title"))
    numbers = gr.known_numbers(F.col("title"), F.col("years"), F.lit(120), F.lit(None).cast(
        "array<struct<company:string,title:string,start_date:string,end_date:string,"
        "duration_months:int,is_current:boolean,industry:string,company_size:string,"
        "description:string>>"))
    found = df.select(text.alias("text"), gr.text_issues(text, terms, numbers, TEXT).alias("x"))
    for row in found.collect():
        assert row.x == [], row.text


def sequential(facts, generated, retried, accepted, ok):
    """Row by row in rank order, the way a single loop would decide."""
    taken, chosen = list(accepted), {}
    for i, fallback in facts:
        for attempt, text in (("generated", generated.get(i)), ("regenerated", retried.get(i)),
                              ("fallback", fallback)):
            good = attempt == "fallback" or (
                text and ok(text) and not any(similar(text, other) for other in taken))
            if good:
                chosen[i] = (attempt, text)
                taken.append(text)
                break
    return chosen


def test_acceptance_equals_the_sequential_rule(spark):
    base = "built and shipped a ranking system for search at a product company over years {}"
    chain = [base.format(w) for w in ("alpha", "alpha beta", "alpha beta gamma",
                                      "alpha beta gamma delta", "beta gamma delta epsilon zeta")]
    other = "writes retrieval code daily and owns evaluation of relevance for many teams {}"
    facts = [(f"i{n}", f"fallback text of row {n} which is long enough {w} {w}x {w}y {w}z")
             for n, w in enumerate("abcdefghijkl")]
    generated = {f"i{n}": t for n, t in enumerate(chain)}
    generated |= {"i5": other.format("one"), "i6": other.format("one two"), "i7": "short.",
                  "i8": "Mentions Kubernetes and also Terraform which nobody knows here."}
    retried = {"i1": other.format("three"), "i2": base.format("totally different words that do "
               "not overlap much with anything else written before now"), "i6": "bad.",
               "i7": other.format("one"), "i8": "a fresh sentence about databases and pipelines"}
    accepted = [other.format("zero seen before")]
    rows = [(i, n + 1, text, [], []) for n, (i, text) in enumerate(facts)]
    fact_rows = spark.createDataFrame(
        rows, "id string, rank bigint, fallback string, terms array<string>, "
        "numbers array<double>")

    def frame(texts):
        return spark.createDataFrame(list(texts.items()), "id string, text string")

    cached = spark.createDataFrame([("old", accepted[0])], "id string, text string")
    index = TextIndex(spark, TEXT.similar_at)
    index.add(cached)
    got = {
        r.id: (r.attempt, r.text)
        for r in explain.accept_texts(fact_rows, frame(generated), frame(retried), index,
                                      TEXT).collect()
    }

    def ok(text):
        return len(text) >= 30 and "Kubernetes" not in text

    expected = sequential(facts, generated, retried, accepted, ok)
    assert got == expected
    assert {a for a, _ in expected.values()} == {"generated", "regenerated", "fallback"}


def test_text_index(spark, tmp_path):
    """New texts against two additions and a folder opened again, by brute force."""
    texts = [(i, text) for i, _, text in corpus(7, 150)]
    first, second, new = texts[:60], texts[60:110], texts[110:]
    folder = str(tmp_path / "index")

    def frame(rows):
        return spark.createDataFrame(rows, "id string, text string")

    index = TextIndex(spark, 0.85, folder)
    assert index.similar_to(frame(new)).count() == 0
    index.add(frame(first))
    index.add(frame(second))
    for opened in (index, TextIndex(spark, 0.85, folder)):
        got = [(r.id, r.other) for r in opened.similar_to(frame(new)).collect()]
        wanted = {(a, b) for a, x in new for b, y in first + second if similar(x, y)}
        assert len(got) == len(set(got)) and set(got) == wanted and wanted
    ranks = [r["rank"] for r in index.table("words").collect()]
    assert len(ranks) == len(set(ranks))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tokens = spark.range(50).select(F.col("id").alias("token")).repartition(64, "token")
        plan = index.table("members").join(tokens, "token")._jdf.queryExecution()
        text = plan.executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert text.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in text
