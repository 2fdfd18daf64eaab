"""Quality rules: a learned decision list over text statistics, all in DataFrame operations.

Sequential covering: a rule is a conjunction of thresholds on features, grown condition by condition
with the highest information gain for low quality on two thirds of the labelled rows, then pruned
from its end on the last third; rows that it covers leave, and the next rule is learnt on the rest.
It ends when a pruned rule is right in fewer than ``min_precision`` of the held-back rows that it
covers, or after ``max_rules``. Thresholds come from quantiles of the labelled rows. Every step is
one aggregate that returns counts per feature and bin, so that nothing but these few numbers
reaches the driver. The list becomes one ``CASE WHEN``: the first rule that holds rejects a text.

Cases: null texts count as empty: no words, all statistics 0. Very long texts are read whole.
Null labels are left out; a label that repeats for a document counts each time. Without labels of
both kinds the list is empty and only the base rule rejects. Ties in gain go to the first feature
and lowest threshold. Repeated rows are judged alike; extra columns pass through, except for those
with the names of the statistics, which they replace. Empty tables give empty results.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import table, words
from millrace.session import staged

WINDOW = 3
MAX_RULES, MAX_CONDITIONS, BINS = 6, 3, 16
MIN_PRECISION = 0.85
MIN_COVERED = 3
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(split: Column) -> Column:
    """Words in windows of three words that are found twice or more in the text.

    Windows are sorted with their positions; equal neighbours are repeats. Every repeated window
    then adds the words that the one before it, by position, does not cover.
    """
    n = F.array_size(split)
    windows = F.when(n < WINDOW, F.array().cast("array<string>")).otherwise(
        F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.concat_ws(" ", F.get(split, i), F.get(split, i + 1), F.get(split, i + 2)))
    )
    return F.transform(F.array(windows), _covered)[0]


def _covered(windows: Column) -> Column:
    def words_of(placed: Column) -> Column:
        def same(k: Column, other: Column) -> Column:
            return F.coalesce(F.get(placed, k)["w"] == F.get(placed, other)["w"], F.lit(False))

        repeated = F.filter(placed, lambda x, k: same(k, k - 1) | same(k, k + 1))
        return F.transform(F.array(F.array_sort(F.transform(repeated, lambda x: x["i"]))), _length)[0]

    def _length(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    placed = F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i"))))
    # Most texts repeat nothing: a set of the windows tells, without sorting.
    return F.when(F.array_size(F.array_distinct(windows)) == F.array_size(windows), F.lit(0).cast("long")).otherwise(
        F.transform(F.array(placed), words_of)[0]
    )


def statistics(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """``docs`` with the five statistics and ``base_failed``."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    kept = [c for c in docs.columns if c.lower() not in {*STATISTICS, "base_failed", "_split", "_lines"}]
    prepared = docs.select(*kept, text.alias("_whole"), words(text).alias("_split"), lines.alias("_lines"))
    found = prepared.select(
        *kept,
        F.array_size("_split").cast("long").alias("n_words"),
        F.length(F.array_join("_split", "")).cast("long").alias("word_chars"),
        (F.length("_whole") - F.length(F.regexp_replace("_whole", r"[#*$%&|<>]+", ""))).cast("long").alias("n_symbols"),
        (F.array_size("_lines") - F.array_size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("_split")).alias("n_repeat_words"),
    )
    return found.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def features() -> dict[str, Column]:
    """What conditions are about: shares that depend neither on the length of a text nor on the
    word lengths of its language."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbols_per_word": F.col("n_symbols") / n,
        "repeated_share": F.col("n_repeat_words") / n,
        "dup_lines_per_100_words": 100 * F.col("n_dup_lines") / n,
        "symbols_per_letter": F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self) -> Column:
        value = features()[self.feature]
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


def all_of(rule: tuple[Condition, ...]) -> Column:
    held = F.lit(True)
    for condition in rule:
        held = held & condition.holds()
    return held


def verdict(rules: list[tuple[Condition, ...]]) -> Column:
    """The list as one ordered conditional: true to keep."""
    case = None
    for rule in rules:
        case = F.when(all_of(rule), False) if case is None else case.when(all_of(rule), False)
    return F.lit(True) if case is None else case.otherwise(True)


def number(rules: list[tuple[Condition, ...]]) -> Column:
    """Which rule rejects a text, from 1; null if none does."""
    case = F.lit(None).cast("int")
    for k, rule in reversed(list(enumerate(rules, 1))):
        case = F.when(all_of(rule), F.lit(k)).otherwise(case)
    return case


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else -math.inf


def learn(
    labelled: DataFrame, label_column: str = "quality", max_rules: int = MAX_RULES, max_conditions: int = MAX_CONDITIONS,
    bins: int = BINS, min_precision: float = MIN_PRECISION,
) -> list[tuple[Condition, ...]]:
    """Decision list for low quality (label 0) from rows with the statistics and a label.

    ``labelled`` may have an id column ``doc_id``, which deals rows to growing and pruning; it is
    no input of a condition.
    """
    names = list(features())
    deal = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(3)) if "doc_id" in labelled.columns else F.pmod(F.xxhash64(*STATISTICS), F.lit(3))
    rows = labelled.where(F.col(label_column).isin(0, 1)).select(
        *STATISTICS, (F.col(label_column) == 0).alias("bad"), (deal < 2).alias("grow")
    )
    edges = rows.agg(
        *(F.percentile_approx(features()[f], [k / bins for k in range(1, bins)], 1000).alias(f) for f in names),
        F.count_if("bad").alias("_bad"), F.count_if(~F.col("bad")).alias("_good"),
    ).first()
    if not edges["_bad"] or not edges["_good"]:
        return []
    cuts = {f: sorted({float(x) for x in edges[f]}) for f in names}
    # The bins of all features, once: from here on conditions are comparisons of small numbers.
    def bin_of(f: str) -> Column:
        return sum(((features()[f] > c).cast("int") for c in cuts[f]), F.lit(0))

    binned = staged(
        rows.groupBy("bad", "grow", *(bin_of(f).alias(f"b{k}") for k, f in enumerate(names))).agg(F.count("*").alias("n")), "bins"
    )

    def binned_rule(rule: tuple[Condition, ...]) -> Column:
        held = F.lit(True)
        for c in rule:
            b, at = F.col(f"b{names.index(c.feature)}"), cuts[c.feature].index(c.threshold)
            held = held & ((b > at) if c.above else (b <= at))
        return held

    def counts(left: DataFrame) -> dict[tuple[int, int, bool], int]:
        """Rows by feature, bin and class."""
        stacked = left.select(
            F.explode(F.array(*(F.struct(F.lit(k).alias("f"), F.col(f"b{k}").alias("b")) for k in range(len(names))))).alias("x"), "bad", "n"
        )
        return {(r["f"], r["b"], r["bad"]): r["n"] for r in stacked.groupBy("x.f", "x.b", "bad").agg(F.sum("n").alias("n")).collect()}

    rules, open_rows = [], binned
    for _ in range(max_rules):
        rule: tuple[Condition, ...] = ()
        while len(rule) < max_conditions:
            seen = counts(open_rows.where("grow").where(binned_rule(rule)))
            p0 = sum(v for (f, _, bad), v in seen.items() if f == 0 and bad)
            n0 = sum(v for (f, _, bad), v in seen.items() if f == 0 and not bad)
            if not p0 or not n0:
                break
            best = (0.0, None)
            for k, f in enumerate(names):
                for at, c in enumerate(cuts[f]):
                    p = sum(v for (g, b, bad), v in seen.items() if g == k and bad and b > at)
                    n = sum(v for (g, b, bad), v in seen.items() if g == k and not bad and b > at)
                    for above, a, z in ((True, p, n), (False, p0 - p, n0 - n)):
                        if a + z >= MIN_COVERED and _gain(a, z, p0, n0) > best[0] + 1e-9:
                            best = (_gain(a, z, p0, n0), Condition(f, above, c))
            if best[1] is None:
                break
            rule += (best[1],)
        if not rule:
            break
        # Prune from the end: the prefix with the best balance of held-back rows, the shorter on ties.
        ends = range(1, len(rule) + 1)
        held = open_rows.where("not grow").agg(
            *(F.coalesce(F.sum(F.when(binned_rule(rule[:k]) & (F.col("bad") == bad), F.col("n"))), F.lit(0)).alias(f"c{k}_{int(bad)}") for k in ends for bad in (True, False))
        ).first()
        def worth(k: int, held=held) -> float:
            p, n = held[f"c{k}_1"], held[f"c{k}_0"]
            return (p - n) / (p + n) if p + n else -1.0

        best_end = max(ends, key=lambda k: (round(worth(k), 9), -k))
        rule = rule[:best_end]
        if (worth(best_end) + 1) / 2 < min_precision:
            break
        rules.append(rule)
        open_rows = open_rows.where(~binned_rule(rule))
    return rules


def judged(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality") -> DataFrame:
    """``docs`` without the text, with statistics, ``base_failed``, ``kept`` and the number of the rule."""
    measured = staged(statistics(docs, text_column).drop(text_column), "quality")
    known = labels.select(F.col(id_column).alias("_id"), F.col(label_column).alias("_label"))
    labelled = measured.join(known, measured[id_column] == known["_id"]).select(F.col("_id").alias("doc_id"), *STATISTICS, "_label")
    rules = learn(labelled, "_label")
    return measured.withColumns({"kept": ~F.col("base_failed") & verdict(rules), "rule": number(rules)})


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, table(spark, sf_dir, "labels")).select("doc_id", *STATISTICS, "base_failed", "kept", "rule")
