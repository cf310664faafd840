"""Exact top-k search by inner product: a Voronoi join of queries and data.

Pivots from a bounded sample cut the vectors into cells. Per cell the summary holds the
number of vectors and the largest distance from the pivot. For a query q, a cell with pivot p
and radius r has scores between q.p - |q| r and q.p + |q| r. The lower bounds of cells with
more than k vectors together bound the k-th best score from below; a query goes only to the
cells whose upper bound reaches that. Cells are solved locally, in slices of bounded size, by
matrix products, and the best of all slices are merged.

Bounds are widened by their rounding error. Products of integers are exact in double precision
while dim * max(|x|) ** 2 < 2 ** 53, in 64-bit integers beyond that.

Defined cases: vectors that are null or hold null or non-finite components take no part;
vectors of different length are never compared; equal scores go to the smaller vec_id; rows
with one vec_id are all candidates for others, and a query row is kept once per vec_id and
vector; an empty table or a single vector gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm.common import map_batches, stored, table

SCALE, EVERY, TOP = 256, 50, 5
PIVOTS = 64
#: Vectors of a cell, and queries, that one task gets at a time.
DATA_SLICE, QUERY_SLICE = 8192, 4096
FOUND = "query_id bigint, vec_id bigint, score bigint"


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): whole components as floor(scale * x); unusable vectors are left out."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    finite = F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    usable = vectors.filter(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull())
    return usable.filter(F.coalesce(finite, F.lit(False))).select("vec_id", whole.alias("v"))


def choose_pivots(rows: DataFrame, pivots: int) -> dict[int, np.ndarray]:
    """Per vector length at most ``pivots`` vectors, those with the smallest hash."""
    size = F.size("v").alias("size")
    drawn = rows.select(size, "v", F.xxhash64("v").alias("draw")).distinct()
    ranked = Window.partitionBy("size").orderBy("draw")
    chosen = drawn.withColumn("place", F.row_number().over(ranked)).filter(
        F.col("place") <= pivots
    )
    out: dict[int, list] = {}
    for row in chosen.collect():
        out.setdefault(row.size, []).append(row.v)
    return {size: np.array(sorted(v), dtype=np.float64) for size, v in out.items()}


def _by_size(lists: list) -> dict[int, np.ndarray]:
    sizes = np.array([len(v) for v in lists], dtype=np.int64)
    return {int(size): np.flatnonzero(sizes == size) for size in np.unique(sizes)}


def assign_cells(rows: DataFrame, pivots: dict[int, np.ndarray]) -> DataFrame:
    """Adds size, cell (the nearest pivot) and the distance from it."""

    def make():
        def run(batches):
            for batch in batches:
                lists = batch.column("v").to_pylist()
                cell = np.zeros(len(lists), dtype=np.int32)
                size, far = np.zeros_like(cell), np.zeros(len(lists))
                for length, at in _by_size(lists).items():
                    size[at] = length
                    if length:
                        points = np.array([lists[i] for i in at], dtype=np.float64)
                        centres = pivots[length]
                        near = np.argmin(
                            (centres * centres).sum(1) - 2 * points @ centres.T, axis=1
                        )
                        cell[at] = near
                        far[at] = np.sqrt(((points - centres[near]) ** 2).sum(1))
                yield {
                    "vec_id": batch.column("vec_id"), "v": batch.column("v"),
                    "size": size, "cell": cell, "far": far,
                }

        return run

    schema = "vec_id bigint, v array<bigint>, size int, cell int, far double"
    return map_batches(rows.select("vec_id", "v"), make, schema)


def route(
    queries: DataFrame, pivots: dict, cells: dict[int, list[tuple[int, int, float]]], top: int
) -> DataFrame:
    """(query_id, q, size, cell) for every cell that may hold one of the best of the query.

    ``cells``: per vector length, (cell, vectors, radius).
    """

    def make():
        def run(batches):
            for batch in batches:
                lists, ids = batch.column("v").to_pylist(), batch.column("vec_id").to_pylist()
                out = {"query_id": [], "q": [], "size": [], "cell": []}
                for length, at in _by_size(lists).items():
                    points = np.array([lists[i] for i in at], dtype=np.float64)
                    number = np.array([c for c, _, _ in cells[length]])
                    held = np.array([n for _, n, _ in cells[length]])
                    radius = np.array([r for _, _, r in cells[length]])
                    norm = np.sqrt((points * points).sum(1))[:, None]
                    middle = points @ pivots[length][number].T if length else np.zeros(
                        (len(at), len(number))
                    )
                    slack = 1e-9 * (1 + np.abs(middle) + norm * (radius + 1))
                    low, high = middle - norm * radius - slack, middle + norm * radius + slack
                    order = np.argsort(-low, axis=1)
                    # The query itself may be among the first top + 1.
                    enough = np.cumsum(held[order], axis=1) >= top + 1
                    first = np.where(enough.any(1), enough.argmax(1), len(number) - 1)
                    row = np.arange(len(at))
                    bound = np.where(enough.any(1), low[row, order[row, first]], -np.inf)
                    for r, c in zip(*np.nonzero(high >= bound[:, None]), strict=True):
                        out["query_id"].append(ids[at[r]])
                        out["q"].append(lists[at[r]])
                        out["size"].append(length)
                        out["cell"].append(int(number[c]))
                yield out

        return run

    schema = "query_id bigint, q array<bigint>, size int, cell int"
    return map_batches(queries.select("vec_id", "v"), make, schema)


def copied(data: DataFrame, routed: DataFrame) -> DataFrame:
    """``data`` once for each block of queries of which one was routed to the vector's cell."""
    # A column of its own, for a cogroup of the result with the routed queries.
    asking = routed.select("size", "cell", F.col("block").alias("block")).distinct()
    return data.join(asking, ["size", "cell"])


def solve(top: int):
    """Best of one slice of data for one slice of queries."""

    def run(key, asked: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(data):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        data = data.sort_values("vec_id", kind="stable")
        points = np.array(data["v"].tolist(), dtype=np.int64).reshape(len(data), -1)
        wanted = np.array(asked["q"].tolist(), dtype=np.int64).reshape(len(asked), -1)
        largest = max(np.abs(points).max(initial=0), np.abs(wanted).max(initial=0))
        if float(largest) ** 2 * max(points.shape[1], 1) < 2.0**53:
            points, wanted = points.astype(np.float64), wanted.astype(np.float64)
        ids = data["vec_id"].to_numpy()
        frames = []
        for at in range(0, len(wanted), 256):
            scores = (wanted[at : at + 256] @ points.T).astype(np.int64)
            names = asked["query_id"].to_numpy()[at : at + 256]
            own = ids[None, :] == names[:, None]
            scores[own] = np.iinfo(np.int64).min + 1  # its negative must exist
            # Ties go to the smaller id: the data are in its order and the sort is stable.
            kept = min(top, scores.shape[1])
            edge = -np.partition(-scores, kept - 1, axis=1)[:, kept - 1 : kept]
            row, column = np.nonzero(scores >= edge)
            value = scores[row, column]
            best = np.lexsort((column, -value, row))
            row, column, value = row[best], column[best], value[best]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            keep = (place < kept) & ~own[row, column]
            frames.append(
                pd.DataFrame(
                    {"query_id": names[row[keep]], "vec_id": ids[column[keep]],
                     "score": value[keep]}
                )
            )
        return pd.concat(frames)

    return run


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    top: int = TOP,
    pivots: int = PIVOTS,
    data_slice: int = DATA_SLICE,
    query_slice: int = QUERY_SLICE,
) -> DataFrame:
    """(query_id, rank, vec_id, score) for queries and vectors given as (vec_id, v)."""
    rows = stored(vectors.select("vec_id", "v"))
    centres = choose_pivots(rows, pivots)
    data = stored(assign_cells(rows, centres))
    summary = (
        data.groupBy("size", "cell")
        .agg(F.count(F.lit(1)).alias("rows"), F.max("far").alias("radius"))
        .collect()  # at most ``pivots`` rows per vector length
    )
    cells: dict[int, list] = {}
    for row in sorted(summary):
        cells.setdefault(row["size"], []).append((row["cell"], row["rows"], row["radius"]))
    known = F.size("v").isin(*cells) if cells else F.lit(False)
    asked = queries.select("vec_id", "v").distinct().filter(known)
    total = asked.count()
    blocks = -(-max(total, 1) // query_slice)
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int").alias("block")
    count = F.create_map(
        *[F.lit(x) for s, c in cells.items() for n, held, _ in c
          for x in (f"{s} {n}", -(-held // data_slice))]
    ) if cells else F.create_map(F.lit(""), F.lit(1))
    parts = F.coalesce(
        F.element_at(count, F.concat_ws(" ", "size", "cell")), F.lit(1)
    )
    whole = stored(route(asked, centres, cells, top).select("query_id", "q", "size", "cell", block))
    routed = whole.select(
        "query_id", "q", "size", "cell", "block",
        F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"),
    )
    part = F.pmod(F.xxhash64("vec_id", F.lit(7)), parts).cast("int").alias("part")
    spread = copied(data.select("vec_id", "v", "size", "cell", part), whole)
    keys = ["size", "cell", "part", "block"]
    found = (
        routed.groupBy(*keys).cogroup(spread.groupBy(*keys)).applyInPandas(solve(top), FOUND)
    )
    best = F.slice(
        F.array_sort(
            F.collect_list(F.struct((-F.col("score")).alias("minus"), F.col("vec_id")))
        ),
        1, top,
    )
    merged = found.groupBy("query_id").agg(best.alias("best"))
    return merged.select(
        "query_id", F.posexplode("best").alias("place", "hit")
    ).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"),
        F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).alias("score"),
    )


def exact_top_k(spark: SparkSession, folder: str) -> DataFrame:
    vectors = quantised(table(spark, folder, "embeddings"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % EVERY == 0))


TOP_K_SQL = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding,
    lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding,
    lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.vec_id AS query_id, d.vec_id,
    list_sum(list_transform(list_zip(q.w, d.w), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v d ON d.vec_id <> q.vec_id WHERE q.vec_id % {EVERY} = 0),
ranked AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT
    AS rank, vec_id, score FROM pairs)
SELECT * FROM ranked WHERE rank <= {TOP}
"""
