"""Constraints as counts of the rows that break them. As in a database a check passes on null and null keys never clash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def checks(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """(rule, violations) of boolean rules, in one pass."""
    one = df.agg(*[F.count_if(~r).alias(k) for k, r in rules.items()])
    return one.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, rules)), F.array(*rules))).alias("rule", "violations"))


def unique(df: DataFrame, rule: str, *keys: str) -> DataFrame:
    whole = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    return df.where(whole).groupBy(*keys).count().agg(F.lit(rule).alias("rule"), F.count_if(F.col("count") > 1).alias("violations")).select("rule", "violations")


def references(df: DataFrame, rule: str, key: str | tuple[str, ...], other: DataFrame, other_key: str | tuple[str, ...]) -> DataFrame:
    """Rows whose key, of one column or several, is no key of the other table. A key with a null in any column refers to nothing and passes."""
    own, others = (key,) if isinstance(key, str) else key, (other_key,) if isinstance(other_key, str) else other_key
    known = other.select(*[F.col(o).alias(f"_{i}") for i, o in enumerate(others)]).distinct()
    named = df.select(*[F.col(k).alias(f"_{i}") for i, k in enumerate(own)]).na.drop("any")
    lost = named.join(known, known.columns, "left_anti")
    return lost.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations")


def one_active(df: DataFrame, rule: str, *keys: str) -> DataFrame:
    """At most one active row of each key; without keys, of the whole table."""
    active = df.where("active").withColumn("_all", F.lit(1))
    return unique(active, rule, *(keys or ("_all",)))


def provenance() -> dict[str, Column]:
    """What a document version must hold for its kind of source, for checks()."""
    kind = F.col("source_kind")
    pdf = (F.col("variant") == "base") & F.col("source_url").isNotNull() & F.col("source_sha256").isNotNull()
    return {"portfolio_pdf": (kind != "portfolio_pdf") | pdf, "n8n_parent": (kind != "n8n") | F.col("parent_id").isNotNull()}


def deep_scores() -> dict[str, Column]:
    """What a score of the deep stage must hold, for checks(). A status that is missing or null breaks its rule instead of passing."""
    other = F.col("stage") != "deep"
    inputs = F.col("resume_version_id").isNotNull() & F.col("profile_version_id").isNotNull() & F.col("research_id").isNotNull()
    status = F.coalesce(F.get_json_object("location_eligibility", "$.status").isin("eligible", "ineligible", "unclear"), F.lit(False))
    return {"deep_inputs": other | inputs, "deep_location": other | (F.col("location_eligibility").isNotNull() & status), "rank": F.col("rank").between(1, 3)}
