"""URL verdicts from rules, else from trust and distrust that spread over the host link graph.

Trust is personalised PageRank along links from hosts whose pages rules allow; distrust is the same
on reversed links from hosts whose pages rules block (a host that links to blocked hosts is
suspect). A host's seed is the share of its pages that rules allow or block. A host is blocked when
its distrust is above its trust and at least ``threshold`` times what a wholly blocked host without
links has. Rounds go on until none changes a host's score by more than a thousandth of what blocks.

Defined cases: a null url or one without ``://`` has an empty host and path, takes no part in the
graph and is allowed unless a rule fits; pages without links give no edges; links to a page's own
host are no edges; repeated rows and links add weight; equal trust and distrust allow; an empty
table gives an empty result. Only ``page_id``, ``url`` and ``html`` are read.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pelagos.storage import discard

from .common import lower_ascii, materialise, table


class Rule(NamedTuple):
    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


RULES = (
    Rule("com", "/en/", "block"),
    Rule("example.com", "/en/7", "allow"),
    Rule("net", "/de/", "allow"),
    Rule("example.net", "/de/8", "block"),
    Rule("org", "/es/", "block"),
)
DAMPING, THRESHOLD, CUT_EVERY = 0.85, 0.5, 4
#: The least change that counts, as a share of the score that blocks, and the rounds after which a graph that still changes is an error.
TOLERANCE, MOST_ROUNDS = 1e-3, 400
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*[a-z][a-z0-9+.-]*://([^/?#"'<>\s]*)"""


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, _PARTS, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def fits(rule: Rule, host: Column, path: Column) -> Column:
    return ((host == rule.host) | host.endswith(f".{rule.host}")) & path.startswith(rule.path)


def longest_rule(rules: tuple[Rule, ...], host: Column, path: Column) -> Column:
    """A struct (rule, verdict) of the longest rule that fits, by the length of host and path together, ties by name; else nulls."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        found = F.when(fits(r, host, path), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(found)
    return found


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, weight): links between different hosts, weight the link's share of all the source's links."""
    links = (
        pages.where(F.col("html").contains("://"))
        .select(host_of(F.col("url")).alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1))).alias("dst"))
        .select("src", lower_ascii(F.col("dst")).alias("dst"))
        .where("src <> '' and dst <> '' and src <> dst")
    )
    return links.groupBy("src", "dst").agg(F.count("*").alias("n"))


def spread(seeds: DataFrame, edges: DataFrame, source: str, to: str, damping: float, least: float, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(host, score): score = (1 - damping) * seed + damping * what arrives from ``source`` hosts, until no score changes by more than ``least``.

    What a round adds is what the round before added, damped and passed on along the links. Each round joins it to edges on the host and
    sums by the target with partial sums on the map side, so a host with very many links is split or summed early. Every few rounds the lineage is
    cut and the largest addition looked at; a graph that has not settled after ``most_rounds`` is an error.
    """
    out = edges.groupBy(source).agg(F.sum("n").alias("total"))
    weighted = materialise(edges.join(out, source).select(F.col(source).alias("host"), F.col(to).alias("to"), (F.col("n") / F.col("total")).alias("w")), "edges")
    base = seeds.select("host", ((1 - damping) * F.col("seed")).alias("base")).where("base > 0")
    score = added = base.select("host", F.col("base").alias("score"))
    if weighted.isEmpty():
        return score
    old = []
    for n in range(1, most_rounds + 1):
        added = weighted.join(added, "host").groupBy("to").agg((damping * F.sum(F.col("w") * F.col("score"))).alias("score")).select(F.col("to").alias("host"), "score")
        if n % CUT_EVERY:
            score = score.unionByName(added)
            continue
        added = materialise(added, "added")
        score = materialise(score.unionByName(added).groupBy("host").agg(F.sum("score").alias("score")), "score")
        discard(*old)
        old = [added, score]
        if (added.agg(F.max("score")).first()[0] or 0) <= least:
            return score
    raise RuntimeError("the scores have not settled")


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, damping: float = DAMPING, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(page_id, host, path, rule, verdict, trust, distrust) for every row of ``pages``."""
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html")
    parts = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    ruled = parts.withColumn("found", longest_rule(rules, F.col("host"), F.col("path"))).select("page_id", "host", "path", "found.rule", F.col("found.verdict").alias("said"))
    share = lambda v: F.avg(F.when(F.col("said") == v, 1.0).otherwise(0.0))
    hosts = materialise(ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("allowed"), share("block").alias("blocked")), "hosts")
    edges = materialise(host_edges(pages), "links")
    least = tolerance * threshold * (1 - damping)
    trust = spread(hosts.select("host", F.col("allowed").alias("seed")), edges, "src", "dst", damping, least)
    distrust = spread(hosts.select("host", F.col("blocked").alias("seed")), edges, "dst", "src", damping, least)
    scores = hosts.select("host").join(trust.withColumnRenamed("score", "trust"), "host", "left").join(distrust.withColumnRenamed("score", "distrust"), "host", "left").na.fill(0.0, ["trust", "distrust"])
    scores = materialise(scores, "hostscores")
    bad = (F.col("distrust") > F.col("trust")) & (F.col("distrust") >= threshold * (1 - damping))
    joined = ruled.join(scores, "host", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("said", F.when(bad, "block").otherwise("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op2_url_graph(spark, sf_dir: str) -> DataFrame:
    """A verdict for every page's url."""
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def oracle(rules: tuple[Rule, ...] = RULES, damping: float = DAMPING, threshold: float = THRESHOLD, iterations: int = 48) -> str:
    """The same in DuckDB SQL, so many rounds written out."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    case = lambda what: "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name if what == 'rule' else r.verdict}'" for r in sorted(rules, key=lambda r: (-len(r.name), r.name))) + " END"
    link = _LINK.replace("'", "''")
    sql = [
        f"p AS (SELECT page_id, coalesce({lower.format(f"regexp_extract(url, '{parts}', 1)")}, '') AS host, coalesce(regexp_extract(url, '{parts}', 2), '') AS path FROM pages)",
        f"r AS (SELECT *, {case('rule')} AS rule, {case('verdict')} AS said FROM p)",
        "h AS (SELECT host, avg(CASE WHEN said = 'allow' THEN 1.0::DOUBLE ELSE 0 END) AS allowed, avg(CASE WHEN said = 'block' THEN 1.0::DOUBLE ELSE 0 END) AS blocked FROM r WHERE host <> '' GROUP BY host)",
        f"l AS (SELECT coalesce({lower.format(f"regexp_extract(url, '{parts}', 1)")}, '') AS src, {lower.format('d.x')} AS dst FROM pages, unnest(regexp_extract_all(html, '{link}', 1)) AS d(x))",
        "e AS (SELECT src, dst, count(*) AS n FROM l WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY src, dst)",
    ]
    for name, seed, a, b in (("t", "allowed", "src", "dst"), ("d", "blocked", "dst", "src")):
        sql.append(f"{name}w AS (SELECT {a} AS host, {b} AS dest, n::DOUBLE / sum(n) OVER (PARTITION BY {a}) AS w FROM e)")
        sql.append(f"{name}0 AS (SELECT host, {1 - damping}::DOUBLE * {seed} AS score FROM h WHERE {seed} > 0)")
        for n in range(1, iterations + 1):
            sql.append(f"{name}{n} AS (SELECT host, sum(score) AS score FROM (SELECT host, score FROM {name}0 UNION ALL SELECT dest, {damping}::DOUBLE * sum(w * score) FROM {name}w JOIN {name}{n - 1} USING (host) GROUP BY dest) GROUP BY host)")
    last = iterations
    return f"WITH {', '.join(f'{x.split(" AS ", 1)[0]} AS MATERIALIZED {x.split(" AS ", 1)[1]}' for x in sql)} SELECT r.page_id, r.host, r.path, r.rule, coalesce(r.said, CASE WHEN coalesce(d.score, 0) > coalesce(t.score, 0) AND d.score >= {threshold * (1 - damping)}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict FROM r LEFT JOIN t{last} t ON r.host = t.host LEFT JOIN d{last} d ON r.host = d.host"
