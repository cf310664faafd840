"""The pipeline on rows that share a doc_id or have none."""

from __future__ import annotations

from collections import Counter

import corpus_pipeline


def words(start, count):
    return " ".join(f"word{start + i}" for i in range(count))


def test_rows_with_one_doc_id_are_judged_one_by_one(spark, tmp_path):
    repeats = f"{words(100, 60)} {words(200, 30)} between {words(200, 30)} {words(300, 60)}"
    rows = [(1, repeats)] * 3  # repeated rows: one stays, and loses a span
    rows += [(2, words(1000, 90)), (2, "too short")]  # one id, two texts
    rows += [(None, words(2000, 90)), (None, "short too"), (None, None)]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t or "")) for i, t in rows],
        "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id bigint, quality int").write.parquet(
        f"{tmp_path}/labels.parquet")
    held = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        held = corpus_pipeline.stored(stage(spark, held, str(tmp_path)))
    found = held.collect()
    assert Counter(r.doc_id for r in found) == {1: 1, 2: 1, None: 1}
    for row in found:
        assert row.n_chars == len(row.text)
        assert row.text in {None: rows[5][1], 2: rows[3][1]}.get(row.doc_id, row.text)
        assert row.doc_id != 1 or row.text.count("word210 ") == 1
    packed = corpus_pipeline.run(spark, str(tmp_path)).filter("piece = 0").collect()
    assert Counter(r.doc_id for r in packed) == {1: 1, 2: 1, None: 1}


def test_one_of_repeated_rows_stays(spark):
    """Rows that repeat a doc_id and its text; other texts under the id and columns that differ."""
    text = words(0, 80)
    rows = [(4, text, "fr", "s", 5), (4, text, "en", "t", 5), (4, text, "en", "s", None),
            (4, words(500, 80), "en", "s", 5), (5, text, "en", "s", 5),
            (6, None, "en", "s", 0), (6, None, "en", "s", 0), (None, "", None, None, None)]
    docs = spark.createDataFrame(
        rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    found = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert found.columns == docs.columns
    assert Counter(map(tuple, found.collect())) == Counter([rows[2], rows[3], rows[5], rows[7]])
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0
