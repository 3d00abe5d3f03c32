"""Quality rules: a decision list of threshold conjunctions learned by sequential covering.

Text statistics are computed inside each row with higher-order functions, so whole texts never leave their row. On
labelled rows the statistics are binned once; each step of the learner is one small aggregate over that table. A rule
grows by the condition with the best information gain on two thirds of the rows and is pruned on the last third; rows that
it covers leave, and the next rule grows. The result is an ordered list of rules that becomes one Spark CASE expression.
Only DataFrame functions are used.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANK_RUN, BLANKS, stored, table

SYMBOLS = "[#*$%&|<>]"
STATISTICS = ("words", "word_length", "symbols", "dup_lines", "repeats", "upper", "stops", "digits", "distinct", "line_words")
#: Labelled rows that the learner sees at most: those of least hash. It bounds the learner's tables, not what is filtered.
MAX_LABELLED = 8_000
BINS = 24
#: A rule stays if this share of what it covers in the pruning rows is junk, and it covers so many of them.
LEAST_PRECISION, LEAST_COVER = 0.9, 4


@dataclass(frozen=True)
class Condition:
    statistic: str
    above: bool
    threshold: float

    def column(self) -> Column:
        return F.col(self.statistic) > self.threshold if self.above else F.col(self.statistic) <= self.threshold

    def __str__(self) -> str:
        return f"{self.statistic} {'>' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _both(rule: Rule) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def repeated_words(hashes: Column) -> Column:
    """Of an array of word hashes: how many words lie in a 3-word window that is found twice or more."""
    n = F.size(hashes)
    pairs = F.zip_with(F.slice(hashes, 1, n - 2), F.slice(hashes, 2, n - 2), lambda a, b: F.xxhash64(a, b))
    windows = F.zip_with(pairs, F.slice(hashes, 3, n - 2), lambda a, b: F.xxhash64(a, b))
    return F.when(n >= 3, windows).otherwise(F.array().cast("array<bigint>"))


def with_statistics(docs: DataFrame, wanted: tuple[str, ...] = STATISTICS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and the wanted STATISTICS.

    Null text has no words, and an empty or null text fails the base rules (n_words < 50). Ties, repeated rows and null
    ids are rows like any others. Only the id and the text of docs are read.
    """
    t = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    t = t.withColumn("trimmed", F.btrim("t", F.lit(BLANKS)))
    t = t.withColumn("w", F.when(F.col("trimmed") != "", F.split("trimmed", BLANK_RUN)).otherwise(F.array().cast("array<string>")))
    t = t.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    t = t.select(
        "doc_id", F.size("w").cast("long").alias("n_words"), F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        F.size("lines").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("t", F.lit("[A-Z]")).alias("n_upper"), F.regexp_count("t", F.lit("[.,;:!?]")).alias("n_stops"),
        F.regexp_count("t", F.lit("[0-9]")).alias("n_digits"), F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    t = t.withColumn("windows", repeated_words(F.col("h"))).withColumn("n_distinct", F.size(F.array_distinct("h")))
    # places of the windows that occur again: sorted by hash, equal windows are neighbours
    t = t.withColumn(
        "order",
        F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))),
    )
    m = F.size("order")
    nothing = F.array(F.struct(F.lit(None).cast("long").alias("x"), F.lit(None).cast("int").alias("i")))
    again = F.zip_with(
        F.zip_with("order", F.concat(nothing, F.slice("order", 1, m - 1)), lambda a, b: F.struct(a["i"].alias("i"), a["x"].alias("x"), a["x"].eqNullSafe(b["x"]).alias("same"))),
        F.concat(F.slice("order", 2, m - 1), nothing),
        lambda a, b: F.when(a["same"] | a["x"].eqNullSafe(b["x"]), a["i"]),
    )
    t = t.withColumn("places", F.when(F.col("order").isNotNull(), F.sort_array(F.filter(again, lambda i: i.isNotNull()))))
    steps = F.zip_with("places", F.slice(F.col("places"), 2, F.size("places")), lambda a, b: F.least(F.lit(3), F.coalesce(b - a, F.lit(3))))
    t = t.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0), lambda s, x: s + x), F.lit(0)).cast("long"))
    words = F.greatest(F.col("n_words"), F.lit(1))
    t = t.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        ((F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.col("n_words").cast("double").alias("words"), (F.col("word_chars") / words).alias("word_length"),
        (F.col("n_symbols") / words).alias("symbols"), (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_lines"),
        (F.col("n_repeat_words") / words).alias("repeats"), (F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1))).alias("upper"),
        (F.col("n_stops") / words).alias("stops"), (F.col("n_digits") / words).alias("digits"), (F.col("n_distinct") / words).alias("distinct"),
        (F.col("n_words") / F.greatest(F.col("n_lines"), F.lit(1))).alias("line_words"),
    )
    # a row's own one-row table: a caller's filter on a statistic can't be pushed below it, where it would compute all anew
    counts = [c for c in t.columns if c not in STATISTICS or c in wanted]
    return t.select(F.inline(F.array(F.struct(*counts))))


def labelled_statistics(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """Statistics and `junk` of at most MAX_LABELLED labelled documents, stored in the shared folder."""
    picked = (
        labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("label_id"))
        .agg((F.min(label_col) == 0).alias("junk")).orderBy(F.xxhash64("label_id"), "label_id").limit(MAX_LABELLED)
    )
    rows = docs.select(F.col(id_col).alias("doc_id"), "text").join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))  # MAX_LABELLED rows
    stats = with_statistics(rows)
    part = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(3))
    known = stats.join(F.broadcast(picked), F.col("doc_id") == F.col("label_id"))
    return stored(known.where(~F.col("base_failed")).select("junk", (part == 2).alias("prune"), *STATISTICS), "quality").coalesce(2)


def learn_rules(known: DataFrame) -> list[Rule]:
    """Ordered junk rules from rows of `junk`, `prune` and the STATISTICS. No labelled rows: no rules."""
    cuts = known.agg(*[F.percentile(s, F.array(*[F.lit(i / BINS) for i in range(1, BINS)])).alias(s) for s in STATISTICS]).first()
    cuts = {s: sorted(set(cuts[s] or [])) for s in STATISTICS}
    # also cuts among the junk alone: junk of one kind is rare, and quantiles of all rows miss it
    rare = known.where("junk").agg(*[F.percentile(s, F.array(*[F.lit(i / BINS) for i in range(1, BINS)])).alias(s) for s in STATISTICS]).first()
    cuts = {s: sorted({*cuts[s], *(rare[s] or [])}) for s in STATISTICS}
    if not any(cuts.values()):
        return []
    # the bin of a value: how many cuts lie below it
    def bin_of(s: str) -> Column:
        return F.size(F.filter(F.array(*[F.lit(c) for c in cuts[s]]).cast("array<double>"), lambda c: c < F.col(s)))

    of = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), bin_of(s).alias("bin")) for k, s in enumerate(STATISTICS)])).alias("b")
    rules: list[Rule] = []
    while True:  # a rule covers rows that no rule before it did, so there are at most as many as rows
        rest = known
        for r in rules:
            rest = rest.where(~_both(r))
        rule = prune(rest.where("prune"), grow(rest.where("not prune"), cuts, of))
        if not rule:
            break
        rules.append(rule)
    return rules


def grow(rows: DataFrame, cuts: dict[str, list[float]], of: Column) -> Rule:
    rule: Rule = ()
    while True:  # each condition leaves fewer rows that aren't junk
        counts: dict[int, dict[int, list[int]]] = {}
        seen = rows.where(_both(rule)).select("junk", of).groupBy("b.k", "b.bin").agg(F.count_if("junk").alias("p"), F.count_if(~F.col("junk")).alias("n"))
        for k, b, p, n in seen.collect():  # bins, not rows
            counts.setdefault(k, {})[b] = [p, n]
        if not counts:
            break
        p0, n0 = map(sum, zip(*counts[0].values(), strict=True))
        if not n0 or not p0:
            break
        before, best, best_gain = math.log2(p0 / (p0 + n0)), None, 0.0
        for k, s in enumerate(STATISTICS):
            p = n = 0
            for b, cut in enumerate(cuts[s]):  # bins 0..b are those of values <= cuts[b]
                dp, dn = counts[k].get(b, (0, 0))
                p, n = p + dp, n + dn
                for above, x, y in ((False, p, n), (True, p0 - p, n0 - n)):
                    if x and y < n0 and (gain := x * (math.log2(x / (x + y)) - before)) > best_gain * (1 + 1e-9):
                        best, best_gain = Condition(s, above, cut), gain
        if best is None:
            break
        rule = (*rule, best)
    return rule


def prune(rows: DataFrame, rule: Rule) -> Rule:
    """The leading conditions of rule that do best on rows; nothing if none is precise enough."""
    if not rule:
        return ()
    sums = [F.count_if(_both(rule[: i + 1]) & kind).alias(f"{name}{i}") for i in range(len(rule)) for name, kind in (("p", F.col("junk")), ("n", ~F.col("junk")))]
    got = rows.agg(*sums).first()
    best, most = (), -1.0
    for i in range(len(rule)):
        p, n = got[f"p{i}"], got[f"n{i}"]
        if p + n >= LEAST_COVER and p / (p + n) >= LEAST_PRECISION and (p - n) / (p + n) > most + 1e-9:
            best, most = rule[: i + 1], (p - n) / (p + n)
    return best


def verdict(rules: list[Rule]) -> Column:
    """The rules in order as one conditional expression: the number of the first that holds, 0 if none does."""
    out = F
    for i, r in enumerate(rules, 1):
        out = out.when(_both(r), F.lit(i))
    return out.otherwise(F.lit(0)) if rules else F.lit(0)


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id") -> DataFrame:
    """Counts, base_failed, rule (0: none, else its place in the list) and kept for every row of docs.

    id_col may be a struct: it comes back as it is, so a caller can have whole rows with their own verdicts.
    """
    used = {c.statistic for r in rules for c in r}
    judged = with_statistics(docs, tuple(s for s in STATISTICS if s in used), id_col).withColumn("rule", verdict(rules))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("rule") == 0)).alias("kept"), "rule",
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, learn_rules(labelled_statistics(docs, table(spark, sf_dir, "labels"))))
