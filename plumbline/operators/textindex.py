"""A persisted inverted index of texts that new texts are held against.

The index keeps, on shared storage, a place for every word, the ordered words of every text, and
its prefix rows bucketed by word. A new text looks up its own prefix words only: texts that are
in the index are never compared with one another, and the index side of the join is not
shuffled. Words that an addition brings get places before all others, so places never change.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import fingerprint_words
from plumbline.operators.durable import stored, work_folder
from plumbline.operators.neardup import PREFIX, prefixes, ranked_sets, verified

BUCKETS = 64
_TABLES = {
    "words": ("word string, rank bigint", "word"),
    "sets": ("id string, set bigint, n int, ranks array<bigint>", "set"),
    "members": (PREFIX, "token"),
}


class TextIndex:
    """The index in ``folder`` (a new one without), for one threshold."""

    def __init__(self, spark: SparkSession, threshold: float, folder: str | None = None):
        self.spark, self.threshold = spark, threshold
        self.folder = work_folder(spark, "texts") if folder is None else folder
        self.names = {}
        for name, (schema, key) in _TABLES.items():
            table = f"text_index_{name}_{uuid.uuid4().hex}"
            spark.sql(
                f"CREATE TABLE {table} ({schema}) USING parquet CLUSTERED BY ({key}) "
                f"INTO {BUCKETS} BUCKETS LOCATION '{self.folder}/{name}'"
            )
            self.names[name] = table

    def table(self, name: str) -> DataFrame:
        return self.spark.table(self.names[name])

    def _append(self, name: str, rows: DataFrame) -> None:
        table = self.table(name)
        # One task a bucket writes one file a bucket.
        spread = rows.select(table.columns).repartition(BUCKETS, _TABLES[name][1])
        spread.write.insertInto(self.names[name])
        self.spark.catalog.refreshTable(self.names[name])

    def _worded(self, texts: DataFrame) -> DataFrame:
        """(set, id, words) of the texts with words; numbers of other additions differ."""
        worded = texts.select("id", fingerprint_words(F.col("text")).alias("words"))
        number = F.xxhash64(F.lit(uuid.uuid4().hex), F.col("id"))
        return stored(worded.filter(F.size("words") > 0).select(number.alias("set"), "id", "words"))

    def _ranked(self, sets: DataFrame) -> DataFrame:
        """(set, n, ranks) by the places of the index; words it does not know are left out."""
        counts = sets.select(F.explode("words").alias("word")).groupBy("word").agg(
            F.count(F.lit(1)).alias("rows"))
        return stored(ranked_sets(sets, stored(counts.join(self.table("words"), "word"))))

    def add(self, texts: DataFrame) -> None:
        """Put texts (id, text) in; an id that is there already must not come again."""
        sets = self._worded(texts)
        counts = sets.select(F.explode("words").alias("word")).groupBy("word").agg(
            F.count(F.lit(1)).alias("rows"))
        fresh = counts.join(self.table("words"), "word", "left_anti")
        placed = fresh.repartitionByRange(F.desc("rows"), "word").sortWithinPartitions(
            F.desc("rows"), "word")
        lowest = self.table("words").agg(F.coalesce(F.min("rank"), F.lit(0))).scalar()
        # Rare words last here, so they come first in the order.
        number = F.monotonically_increasing_id()
        self._append("words", stored(placed.select("word", (-number).alias("down"))).select(
            "word", (lowest - F.lit(1) + F.col("down")).alias("rank")))
        ranked = self._ranked(sets)
        self._append("sets", ranked.join(sets.select("set", "id"), "set"))
        self._append("members", prefixes(ranked, self.threshold))

    def similar_to(self, texts: DataFrame) -> DataFrame:
        """(id, other): the texts (id, text) and the ids of the index that are similar to them."""
        sets = self._worded(texts)
        ranked = self._ranked(sets)
        probes = stored(prefixes(ranked, self.threshold).select(
            "token", F.col("set").alias("probe"), F.col("n").alias("size")))
        tokens = probes.groupBy("token").agg(F.count(F.lit(1)).alias("rows"))
        met = self.table("members").join(tokens.select("token"), "token", "left_semi")
        low, high = F.least("n", "size"), F.greatest("n", "size")
        pairs = stored(
            met.join(probes, "token")
            .filter(low + F.lit(1e-9) >= F.lit(self.threshold) * high)
            .select("set", F.col("probe").alias("other")).distinct()
        )
        kept = self.table("sets").join(pairs.select("set").distinct(), "set")
        both = stored(kept.select("set", "n", "ranks").unionByName(ranked))
        found = verified(pairs, both, self.threshold)
        names = sets.select(F.col("set").alias("other"), "id")
        return found.join(names, "other").join(
            kept.select("set", F.col("id").alias("_found")), "set"
        ).select("id", F.col("_found").alias("other"))
