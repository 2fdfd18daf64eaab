"""URL filters: rules for hosts and paths, then trust and distrust over the graph of hosts.

A rule holds for its host and all subdomains, for paths that start with its path; the longest rule
decides. Pages without a rule follow their host: trust flows from hosts that rules only allow along
their links, distrust from hosts that rules only block against the direction of links (who links
to them), both as personalised PageRank. A host whose distrust reaches ``threshold`` times that of
a lone seed, and exceeds its trust, is blocked. Links are the absolute ones in the html; links
within a host carry nothing. Edges are counted per pair of hosts before the first iteration, so
that a host with a third of all pages is one node with one row per neighbour.

Everything is DataFrame operations; ranks are written to the shared folder after each iteration.

Cases: null urls, and those without ``://``, have an empty host and path, no rule, and are
allowed. Null html has no links. Repeated pages count their links again and keep their rows. Hosts
without links have no rank and are allowed. Empty tables give empty results; extra columns of
the pages are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import table
from millrace.session import staged

DAMPING = 0.85
ITERATIONS = 8
THRESHOLD = 0.1
SETTLED = 1e-9

# (verdict, host, path): a small list that the caller states, joined as conditions.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LINK = r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, "://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """Struct of the longest rule that fits (``rule``, ``verdict``), or null."""
    case = None
    for verdict, name, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        value = F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))
        case = F.when(fits, value) if case is None else case.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if case is None else case


def host_edges(pages: DataFrame) -> DataFrame:
    """(``src``, ``dst``, ``links``) between different hosts; pages have ``host`` and ``html``."""
    links = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_LINK), 1)).alias("link"))
    target = host_of(F.when(F.col("link").startswith("//"), F.concat(F.lit("http:"), "link")).otherwise(F.col("link")))
    return links.select("src", target.alias("dst")).where("dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagated(edges: DataFrame, seeds: DataFrame, iterations: int = ITERATIONS, damping: float = DAMPING) -> DataFrame:
    """(``host``, ``trust``, ``distrust``), scaled so that a seed without links has 1 - damping.

    ``seeds`` has ``host`` and the booleans ``trusted`` and ``blocked``.
    """
    out = edges.groupBy("src").agg(F.sum("links").alias("all_out"))
    into = edges.groupBy("dst").agg(F.sum("links").alias("all_in"))
    moves = staged(
        edges.join(out, "src").select(
            F.col("src").alias("at"), F.col("dst").alias("to"), (F.col("links") / F.col("all_out")).alias("t"), F.lit(0.0).alias("d")
        ).unionByName(
            edges.join(into, "dst").select(
                F.col("dst").alias("at"), F.col("src").alias("to"), F.lit(0.0).alias("t"), (F.col("links") / F.col("all_in")).alias("d")
            )
        ),
        "moves",
    )
    start = staged(
        seeds.where("trusted <> blocked").select(
            "host", (1 - damping) * F.col("trusted").cast("double"), (1 - damping) * F.col("blocked").cast("double")
        ).toDF("host", "t0", "d0"),
        "seeds",
    )
    ranks = start.select("host", F.col("t0").alias("trust"), F.col("d0").alias("distrust"))
    for _ in range(iterations):
        flow = moves.join(ranks, moves["at"] == ranks["host"]).select(
            F.col("to").alias("host"), (damping * F.col("t") * F.col("trust")).alias("trust"), (damping * F.col("d") * F.col("distrust")).alias("distrust")
        )
        seeded = start.select("host", F.col("t0").alias("trust"), F.col("d0").alias("distrust"))
        fresh = staged(flow.unionByName(seeded).groupBy("host").agg(F.sum("trust").alias("trust"), F.sum("distrust").alias("distrust")), "ranks")
        moved = fresh.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d"), F.count("*").alias("n")).first()
        before = ranks.agg(F.sum("trust").alias("t"), F.sum("distrust").alias("d"), F.count("*").alias("n")).first()
        ranks = fresh
        if moved["n"] == before["n"] and all(abs((moved[k] or 0) - (before[k] or 0)) < SETTLED for k in "td"):
            break
    return ranks


def judged(pages: DataFrame, rules=RULES, threshold: float = THRESHOLD, id_column: str = "page_id") -> DataFrame:
    """(id, ``host``, ``path``, ``rule``, ``verdict``) of every page."""
    parsed = pages.select(F.col(id_column), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    ruled = parsed.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    by_host = F.coalesce(F.col("found.verdict"), F.lit(""))
    seeds = ruled.where("host <> ''").groupBy("host").agg(
        F.bool_or(by_host == "allow").alias("trusted"), F.bool_or(by_host == "block").alias("blocked")
    )
    ranks = propagated(staged(host_edges(parsed), "edges"), seeds)
    bad = ranks.where((F.col("distrust") >= threshold * (1 - DAMPING)) & (F.col("distrust") > F.col("trust"))).select("host", F.lit(True).alias("bad"))
    verdict = F.coalesce("found.verdict", F.when(F.col("bad"), "block"), F.lit("allow"))
    return ruled.drop("html").join(bad, "host", "left").select(id_column, "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def _rule_sql(column: int) -> str:
    whens = " ".join(
        f"WHEN (host = '{name}' OR ends_with(host, '.{name}')) AND starts_with(path, '{prefix}') THEN '{(name + prefix, verdict)[column]}'"
        for verdict, name, prefix in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    return f"CASE {whens} END"


def url_filter_sql() -> str:
    """The same verdicts in DuckDB's SQL: the iterations are written out."""
    host = f"translate(coalesce(regexp_extract(%s, '://([^/?#]*)', 1), ''), '{_UPPER}', '{_LOWER}')"
    sql = f"""WITH parsed AS (SELECT page_id, html, {host % 'url'} AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
ruled AS (SELECT *, {_rule_sql(0)} AS rule, {_rule_sql(1)} AS said FROM parsed),
links AS (SELECT host AS src, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?\\s*((?:https?:)?//[^"''\\s>]+)', 1)) AS link FROM ruled WHERE host <> ''),
edges AS (SELECT src, dst, count(*) AS links FROM (SELECT src, {host % "CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END"} AS dst FROM links) WHERE dst <> '' AND src <> dst GROUP BY ALL),
moves AS (SELECT src AS a, dst AS b, links / sum(links) OVER (PARTITION BY src) AS t, 0.0::DOUBLE AS d FROM edges
  UNION ALL SELECT dst, src, 0.0::DOUBLE, links / sum(links) OVER (PARTITION BY dst) FROM edges),
seeds AS (SELECT host, {1 - DAMPING} * bool_or(coalesce(said = 'allow', false))::INT AS t, {1 - DAMPING} * bool_or(coalesce(said = 'block', false))::INT AS d
  FROM ruled WHERE host <> '' GROUP BY host HAVING bool_or(coalesce(said = 'allow', false)) <> bool_or(coalesce(said = 'block', false))),
r0 AS (SELECT * FROM seeds),
"""
    for n in range(1, ITERATIONS + 1):
        sql += f"""r{n} AS (SELECT host, sum(t) AS t, sum(d) AS d FROM (SELECT host, t, d FROM seeds
  UNION ALL SELECT m.b, {DAMPING} * m.t * r.t, {DAMPING} * m.d * r.d FROM moves m JOIN r{n - 1} r ON m.a = r.host) GROUP BY host),
"""
    return sql.rstrip().rstrip(",") + f"""
SELECT page_id, p.host, path, rule, coalesce(said, CASE WHEN r.d >= {THRESHOLD * (1 - DAMPING)} AND r.d > r.t THEN 'block' END, 'allow') AS verdict
FROM ruled p LEFT JOIN r{ITERATIONS} r ON p.host = r.host"""


SQL = {"op4_url_filter": url_filter_sql()}
