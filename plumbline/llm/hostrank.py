"""URL filters by rules, then by trust and distrust that spread over the links of hosts.

Trust is personalised PageRank from hosts with allowed pages along the links; distrust is
the same from hosts with blocked pages against the links (a host that links to a blocked one
is suspect). Both are doubles and spread until no further host is reached and what four rounds
add is at most ``tolerance`` of the mass. A page that no rule decides gets its host's verdict:
block where the host's distrust is more than ``threshold`` times its trust by over MARGIN of
it (so the order of sums doesn't decide a tie), else allow. The scores given out are rounded
to whole units, UNIT to a fully trusted host; verdicts come from the scores before rounding,
so a host may be blocked for a distrust that shows as 0.

Links are those of ``href`` and ``src`` in the html to other hosts, with a scheme or starting
with ``//``, and one each way between a host and the nearest parent domain that itself serves
pages. Edges are distinct (host,
host) pairs; every sum is pre-aggregated before its shuffle, and adaptive execution splits
joins on a host with many pages or edges.

Defined cases: a null url, or one without ``://``, has an empty host and path, no rule, and
is allowed; a null html has no links; repeated pages are judged each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import stored, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LINK = r"""(?i)(?:href|src)\s*=\s*["']?([^"'\s>]+)"""
#: The start of a link that names a host; ``://`` further on belongs to a path or a query.
ABSOLUTE = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//"
#: Whole units of trust in one fully trusted host; 2**33 hosts fit in a bigint.
UNIT = 1 << 30
#: Rounds between two looks at what they added, and the part of a score that counts as equal.
STEPS, MARGIN = 4, 1e-9


@dataclass(frozen=True)
class Rule:
    """A rule such as ``org/``: a host and the start of a path."""

    verdict: str
    text: str

    @property
    def host(self) -> str:
        return self.text.partition("/")[0]

    @property
    def path(self) -> str:
        return "/" + self.text.partition("/")[2]


RULES = (
    Rule("allow", "org/"),
    Rule("block", "example.org/es/"),
    Rule("block", "example.org/en/1"),
    Rule("allow", "com/fr/"),
    Rule("block", "com/de/"),
)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_rule(pages: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Adds the longest fitting rule (null if none) and its verdict."""
    longest = sorted(rules, key=lambda rule: (-len(rule.text), rule.text))

    def first(value) -> Column:
        out = F
        for rule in longest:
            host = F.col("host")
            fits = ((host == rule.host) | host.endswith("." + rule.host)) & F.col(
                "path"
            ).startswith(rule.path)
            out = out.when(fits, F.lit(value(rule)))
        return out.otherwise(F.lit(None).cast("string")) if out is not F else F.lit(None)

    return pages.withColumns(
        {"rule": first(lambda r: r.text), "ruled": first(lambda r: r.verdict)}
    )


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct links (src, dst) between hosts, from (host, html)."""
    links = pages.select(
        F.col("host").alias("src"),
        F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(LINK), 1))).alias("url"),
    ).filter(F.col("url").rlike(ABSOLUTE))
    linked = links.select(
        "src", host_of(F.regexp_replace("url", ABSOLUTE, "://")).alias("dst")
    )
    hosts = pages.select("host").distinct()
    labels = F.split("host", r"\.")
    up = hosts.filter(F.size(labels) > 2).select(
        "host", F.explode(F.sequence(F.lit(2), F.size(labels) - 1)).alias("level")
    )
    up = up.select(
        "host", "level",
        F.array_join(F.slice(F.split("host", r"\."), F.col("level"), 1 << 20), ".").alias("parent"),
    )
    near = (
        up.join(hosts.select(F.col("host").alias("parent")), "parent")
        .groupBy("host").agg(F.min_by("parent", "level").alias("parent"))
    )
    family = near.select(F.col("host").alias("src"), F.col("parent").alias("dst"))
    both = family.unionByName(family.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    edges = linked.unionByName(both)
    return edges.filter("src <> '' AND dst <> '' AND src <> dst").distinct()


def spread(
    edges: DataFrame, seeds: DataFrame, damping_percent: int, tolerance: float
) -> DataFrame:
    """Personalised PageRank (kind, host, score) of seeds (kind, host, seed) over edges
    (kind, src, dst).

    score = seed + damping * sum(score / out-degree over linking hosts). Scores only grow, so
    the mass that rounds add is the difference of two totals. Ends when STEPS rounds reach no
    further host and add, for every kind, at most ``tolerance`` of its mass.
    """
    degree = edges.groupBy("kind", "src").agg(F.count(F.lit(1)).alias("degree"))
    share = F.lit(damping_percent / 100) / F.col("degree")
    out = stored(
        edges.join(degree, ["kind", "src"])
        .select("kind", F.col("src").alias("host"), "dst", share.alias("share"))
    )
    start = seeds.select("kind", "host", F.col("seed").alias("score"))
    score, before = start, {}
    while True:
        for _ in range(STEPS):
            given = out.join(score, ["kind", "host"]).select(
                "kind", F.col("dst").alias("host"), (F.col("share") * F.col("score")).alias("score")
            )
            score = (
                start.unionByName(given).groupBy("kind", "host").agg(F.sum("score").alias("score"))
            )
        score = stored(score)
        totals = score.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("mass"))
        now = {row.kind: (row.n, row.mass) for row in totals.collect()}  # one row per kind
        if all(
            kind in before and n == before[kind][0]
            and mass - before[kind][1] <= tolerance * mass
            for kind, (n, mass) in now.items()
        ):
            return score
        before = now


def judge_pages(
    pages: DataFrame,
    rules: tuple[Rule, ...] = RULES,
    damping_percent: int = 85,
    tolerance: float = 1e-6,
    threshold: float = 1.0,
) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) of every page (page_id, url, html)."""
    placed = pages.select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    judged = with_rule(placed, rules)
    edges = stored(host_edges(pages.select(host_of(F.col("url")).alias("host"), "html")))
    counts = stored(
        judged.filter("host <> ''").groupBy("host").agg(
            F.count(F.lit(1)).alias("pages"),
            F.count_if(F.col("ruled") == "allow").alias("allowed"),
            F.count_if(F.col("ruled") == "block").alias("blocked"),
        )
    )

    def seeds(kind: str, column: str) -> DataFrame:
        return counts.filter(F.col(column) > 0).select(
            F.lit(kind).alias("kind"), "host", (F.col(column) / F.col("pages")).alias("seed")
        )

    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    both = [rows.withColumn("kind", F.lit(k)) for k, rows in (("trust", edges), ("distrust", turned))]
    score = spread(
        both[0].unionByName(both[1]),
        stored(seeds("trust", "allowed").unionByName(seeds("distrust", "blocked"))),
        damping_percent, tolerance,
    )

    def of(kind: str) -> DataFrame:
        return score.filter(F.col("kind") == kind).select("host", F.col("score").alias(kind))

    hosts = stored(
        counts.select("host").join(of("trust"), "host", "left").join(of("distrust"), "host", "left")
        .na.fill(0.0, ["trust", "distrust"])
    )
    suspect = F.col("distrust") > F.lit(threshold * (1 + MARGIN)) * F.col("trust")
    found = judged.join(hosts, "host", "left")
    verdict = F.coalesce("ruled", F.when(suspect, "block").otherwise("allow"))
    return found.select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"),
        *[F.coalesce(F.round(F.col(n) * UNIT).cast("bigint"), F.lit(0)).alias(n)
          for n in ("trust", "distrust")],
    )


def url_filters(spark: SparkSession, folder: str) -> DataFrame:
    return judge_pages(table(spark, folder, "pages"))
