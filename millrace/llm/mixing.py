"""Mixing sources to target weights: hierarchical token budgets and seeded token-prefixes.

Documents hang on a tree of domains, languages and sources. A node's budget is shared among its
children by weight. A child cannot give more than its tokens times ``max_epochs``; what it falls
short of goes to its siblings, by weight and up to what they hold, and only a shortage of all of
them goes up to the siblings of the parent. In closed form: order the children by capacity over
weight; ``level(j) = (budget - capacities before j) / weights from j on``; every child gets
``min(capacity, weight * max(level))``. That is two window functions over the small tree.

A leaf with tokens T and budget B gives its documents ``B div T`` times, and of one more epoch the
longest prefix, in an order seeded by the epoch, that fits the rest. Documents fall into 4,096
slices of that order by their hash; sums per slice tell which slice holds the end of the prefix,
and only within a slice are documents ordered, so that a hot source is never sorted in one task.

Tokens are the words between white space. Cases: null languages and sources are nodes of their
own; null and empty texts have no tokens and stay where their place in the order falls. Rows with
the same id are chosen together, once each. Weights of 0 or less exclude a node. Equal weights and
ties are decided by name and id. Empty tables give empty results, extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import table, words
from millrace.session import staged

LEVELS = ("domain", "lang", "source")
SLICE_DIGITS = 3
SEED = 17

# The example tree: three domains, numbered sources dealt out among them, English preferred.
DOMAINS = ("web", "books", "forums")
WEIGHTS = {
    ("web",): 5.0, ("books",): 3.0, ("forums",): 2.0,
    ("web", "en"): 4.0, ("books", "en"): 2.0, ("forums", "en"): 3.0,
    ("web", "en", "src0"): 2.0,
}


def domain_of(source: Column) -> Column:
    """Domain of a source by its number; sources without one are ``web``."""
    number = F.coalesce(F.regexp_extract(source, r"(\d+)$", 1).try_cast("int"), F.lit(0))
    return F.element_at(F.array(*map(F.lit, DOMAINS)), number % len(DOMAINS) + 1)


def light(docs: DataFrame, id_column: str, text_column: str, lang: str, source: str, domain: Column | None, seed: int) -> DataFrame:
    """What the budgets need of each row: leaf, tokens, and hashed place."""
    return docs.select(
        F.col(id_column).alias("id"),
        (domain_of(F.col(source)) if domain is None else domain).alias("domain"),
        F.col(lang).cast("string").alias("lang"),
        F.col(source).cast("string").alias("source"),
        F.size(words(F.col(text_column))).cast("long").alias("n_tokens"),
    )


def weighted(nodes: DataFrame, weights: dict[tuple, float], depth: int) -> DataFrame:
    """The weight of each node at a depth; 1 unless stated. The table of weights is a parameter."""
    stated = [(w, k) for k, w in weights.items() if len(k) == depth]
    weight = F.lit(1.0)
    for value, path in stated:
        same = F.lit(True)
        for name, part in zip(LEVELS, path, strict=False):
            same = same & F.col(name).eqNullSafe(F.lit(part))
        weight = F.when(same, F.lit(float(value))).otherwise(weight)
    return nodes.withColumn("weight", F.greatest(weight, F.lit(0.0)))


def budgets(leaves: DataFrame, weights: dict[tuple, float], share: float, max_epochs: int) -> DataFrame:
    """Leaves (``domain``, ``lang``, ``source``, ``tokens``) with their ``budget`` in whole tokens.

    The root's budget is ``share`` of all tokens.
    """
    level = leaves
    for depth in (1, 2, 3):  # capacities of subtrees: nodes of weight 0 have none
        level = weighted(level, weights, depth).where("weight > 0").drop("weight")
    caps = [level.withColumn("cap", F.col("tokens") * F.lit(max_epochs))]
    for depth in (2, 1):
        caps.append(caps[-1].groupBy(*LEVELS[:depth]).agg(F.sum("cap").alias("cap")))
    caps.reverse()
    whole = leaves.agg((F.sum("tokens") * F.lit(float(share))).alias("budget"))
    parents, result = whole, None
    for depth in (1, 2, 3):
        keys = list(LEVELS[: depth - 1])
        nodes = weighted(caps[depth - 1], weights, depth)
        if keys:
            above = parents.select(*(F.col(k).alias(f"_{k}") for k in keys), "budget")
            nodes = nodes.join(above, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*(f"_{k}" for k in keys))
        else:
            nodes = nodes.withColumn("budget", whole.scalar())
        siblings = Window.partitionBy(*keys)
        order = siblings.orderBy(F.col("cap") / F.col("weight"), LEVELS[depth - 1])
        before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        onward = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
        nodes = nodes.withColumn("level", (F.col("budget") - before) / onward)
        parents = result = nodes.withColumn(
            "budget", F.least(F.col("cap").cast("double"), F.col("weight") * F.max("level").over(siblings))
        ).select(*LEVELS[:depth], "budget")
    return result.select(*LEVELS, F.floor(F.col("budget") + 1e-6).alias("budget"))


def choose(rows: DataFrame, weights: dict[tuple, float], share: float, max_epochs: int, seed: int) -> DataFrame:
    """Rows of :func:`light` with ``copies``: how often the mixture holds each."""
    leaves = staged(rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")), "leaves")
    named = staged(
        budgets(leaves, weights, share, max_epochs).select(*(F.col(k).alias(f"_{k}") for k in LEVELS), "budget"), "budgets"
    )
    match = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in LEVELS]
    gone = [f"_{k}" for k in LEVELS]
    plan = leaves.join(named, match, "left").drop(*gone).select(
        *LEVELS, F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).alias("epochs"),
        F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).alias("rest"), F.col("budget").isNotNull().alias("wanted"),
    )
    # The last epoch of a leaf has its own order: the number of the epoch is part of the seed.
    plan = staged(plan, "plan")
    joined = rows.join(plan.select(*(F.col(k).alias(f"_{k}") for k in LEVELS), "epochs", "rest", "wanted"), match).drop(*gone)
    place = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("epochs").cast("string"), F.col("id").cast("string")).cast("binary"))
    placed = staged(joined.withColumn("place", place).withColumn("slice", F.substring("place", 1, SLICE_DIGITS)), "placed")
    sums = placed.groupBy(*LEVELS, "slice").agg(F.sum("n_tokens").alias("slice_tokens"))
    running = F.sum("slice_tokens").over(Window.partitionBy(*LEVELS).orderBy("slice"))
    cuts = sums.withColumn("upto", running).select(
        *(F.col(k).alias(f"_{k}") for k in LEVELS), F.col("slice").alias("_slice"), (F.col("upto") - F.col("slice_tokens")).alias("before")
    )
    cut = placed.join(cuts, [*match, F.col("slice") == F.col("_slice")]).drop(*gone, "_slice")
    within = F.sum("n_tokens").over(Window.partitionBy(*LEVELS, "slice").orderBy("place", "id"))
    fits = F.col("wanted") & (F.col("before") + within <= F.col("rest"))
    return cut.select(
        "id", *LEVELS, "n_tokens", (F.when(F.col("wanted"), F.col("epochs")).otherwise(0) + fits.cast("long")).alias("copies")
    )


def mixture(
    docs: DataFrame, weights: dict[tuple, float] = WEIGHTS, share: float = 0.5, max_epochs: int = 3, seed: int = SEED,
    id_column: str = "doc_id", text_column: str = "text", lang: str = "lang", source: str = "source", domain: Column | None = None,
) -> DataFrame:
    """(id, ``domain``, ``lang``, ``source``, ``n_tokens``, ``copies``) of every row.

    ``share`` of all tokens is the size of the mixture; ``max_epochs`` bounds how often a document
    repeats.
    """
    rows = staged(light(docs, id_column, text_column, lang, source, domain, seed), "light")
    return choose(rows, weights, share, max_epochs, seed).withColumnRenamed("id", id_column)


def mixed_documents(docs: DataFrame, share: float = 0.9, weights: dict[tuple, float] = WEIGHTS, id_column: str = "doc_id") -> DataFrame:
    """The documents of a mixture without repetition, with all their columns."""
    found = mixture(docs, weights, share, 1, id_column=id_column).where("copies > 0").select(F.col(id_column).alias("_kept")).distinct()
    return docs.join(found, docs[id_column].eqNullSafe(found["_kept"]), "left_semi")


def op9_mixing(spark, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"))


def _when(weights: dict[tuple, float], depth: int) -> str:
    rules = " ".join(
        "WHEN " + " AND ".join(f"{n} IS NOT DISTINCT FROM '{v}'" for n, v in zip(LEVELS, path, strict=False)) + f" THEN {w}::DOUBLE"
        for path, w in weights.items() if len(path) == depth
    )
    return f"CASE {rules} ELSE 1.0::DOUBLE END" if rules else "1.0::DOUBLE"


def mixture_sql(source_table: str = "documents", weights: dict[tuple, float] = WEIGHTS, share: float = 0.5, max_epochs: int = 3, seed: int = SEED) -> str:
    """The same mixture in DuckDB's SQL, for tests."""
    domains = ", ".join(f"'{d}'" for d in DOMAINS)
    sql = f"""WITH light AS (
  SELECT doc_id AS id,
    list_extract([{domains}], (coalesce(try_cast(regexp_extract(source, '(\\d+)$', 1) AS INT), 0) % {len(DOMAINS)}) + 1) AS domain,
    lang, source,
    CASE WHEN trim(coalesce(text, ''), E' \\t\\n\\x0b\\x0c\\r') = '' THEN 0
      ELSE len(regexp_split_to_array(trim(text, E' \\t\\n\\x0b\\x0c\\r'), '[\\x20\\x09-\\x0D]+')) END AS n_tokens
  FROM {source_table}),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM light GROUP BY ALL),
cap3 AS (SELECT domain, lang, source, tokens * {max_epochs} AS cap, {_when(weights, 3)} AS weight FROM leaves),
cap2 AS (SELECT domain, lang, sum(cap) AS cap, {_when(weights, 2)} AS weight FROM cap3 GROUP BY domain, lang),
cap1 AS (SELECT domain, sum(cap) AS cap, {_when(weights, 1)} AS weight FROM cap2 GROUP BY domain),
"""
    above = "(SELECT sum(tokens) * %s::DOUBLE AS budget FROM leaves)" % share
    for depth in (1, 2, 3):
        keys = list(LEVELS[: depth - 1])
        on = " AND ".join(f"n.{k} IS NOT DISTINCT FROM p.{k}" for k in keys) or "true"
        part = f"PARTITION BY {', '.join(keys)}" if keys else ""
        sql += f"""lev{depth} AS (SELECT n.*, p.budget, (p.budget - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM cap{depth} n JOIN {above} p ON {on}
  WINDOW o AS ({part.replace(', ', ', n.').replace('BY ', 'BY n.') if part else ''} ORDER BY cap / weight, n.{LEVELS[depth - 1]})),
b{depth} AS (SELECT {', '.join(LEVELS[:depth])}, least(cap::DOUBLE, weight * max(level) OVER ({part})) AS budget FROM lev{depth}),
"""
        above = f"b{depth}"
    return sql + f"""plan AS (SELECT l.*, floor(b.budget + 1e-6)::BIGINT AS budget FROM leaves l JOIN b3 b
  ON l.domain IS NOT DISTINCT FROM b.domain AND l.lang IS NOT DISTINCT FROM b.lang AND l.source IS NOT DISTINCT FROM b.source),
placed AS (SELECT d.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE 0 END AS rest
  FROM light d JOIN plan p ON d.domain IS NOT DISTINCT FROM p.domain AND d.lang IS NOT DISTINCT FROM p.lang AND d.source IS NOT DISTINCT FROM p.source)
SELECT id AS doc_id, domain, lang, source, n_tokens::BIGINT AS n_tokens,
  (epochs + CASE WHEN sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws('|', '{seed}', epochs::VARCHAR, id::VARCHAR)), id) <= rest THEN 1 ELSE 0 END)::BIGINT AS copies
FROM placed"""


SQL = {"op9_mixing": mixture_sql()}
