"""Sync of fetched documents into content versions and source state, for a whole batch of sources at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import tokens as T

SOURCE = ["variant", "source_kind", "source_url"]


@dataclass
class Synced:
    """decisions: a row for each fetch. versions and state: the tables after the batch."""

    decisions: DataFrame
    versions: DataFrame
    state: DataFrame


def decide(fetches: DataFrame, versions: DataFrame, base: str = "base") -> DataFrame:
    """Adds `status` and `activates` to fetches: id, variant, source_kind, source_url, http_status, complete, content_hash.

    not_modified for a 304, failed for any other status than 200, incomplete below the completeness gate. Content that a
    version has is unchanged, or a provenance_conflict if that version is of another variant or kind; new content is
    inserted by the fetch of least id, and the batch's others with that content are judged against it. The first base
    version activates, and only where no base version exists at all, active or not.
    """
    known = versions.groupBy("content_hash").agg(F.min(F.struct("variant", "source_kind")).alias("held"))  # the hash is unique
    usable = (F.col("http_status") == 200) & F.coalesce("complete", F.lit(False)) & F.col("content_hash").isNotNull()
    t = fetches.withColumn("usable", F.coalesce(usable, F.lit(False))).join(known, "content_hash", "left")
    # the least fetch of each content, combined before the shuffle; a content of very many fetches is a skewed side of the join alone
    owners = fetches.where(usable).groupBy("content_hash").agg(F.min(F.struct("id", "variant", "source_kind")).alias("owner"))
    t = t.join(owners, "content_hash", "left").withColumn("owner", F.when(F.col("usable"), F.col("owner")))
    inserts = F.col("usable") & F.col("held").isNull() & (F.col("owner.id") == F.col("id"))
    against = F.coalesce("held", F.struct("owner.variant", "owner.source_kind"))
    same = against["variant"].eqNullSafe(F.col("variant")) & against["source_kind"].eqNullSafe(F.col("source_kind"))
    t = t.withColumn(
        "status",
        F.when(F.col("http_status") == 304, "not_modified").when(F.coalesce(F.col("http_status") != 200, F.lit(True)), "failed").when(~F.col("usable"), "incomplete")
        .when(inserts, "inserted").when(same, "unchanged").otherwise("provenance_conflict"),
    )
    has_base = versions.where(F.col("variant") == base).agg((F.count("*") > 0).alias("has_base"))
    firsts = t.where((F.col("status") == "inserted") & (F.col("variant") == base)).agg(F.min("id").alias("first_base"))
    t = t.join(F.broadcast(has_base), F.lit(True)).join(F.broadcast(firsts), F.lit(True))  # one row each
    activates = ~F.col("has_base") & (F.col("id") == F.col("first_base")) & (F.col("status") == "inserted")
    return t.withColumn("activates", F.coalesce(activates, F.lit(False))).drop("usable", "held", "owner", "has_base", "first_base")


def sync(fetches: DataFrame, versions: DataFrame, state: DataFrame, validators: tuple[str, ...] = ("etag", "last_modified"), base: str = "base") -> Synced:
    """Decide each fetch, add the versions it inserts and bring the state of its source up to date.

    versions: content_hash, variant, source_kind, active. state: the SOURCE columns, raw_sha256 and the validators; a source
    has one fetch in a batch. A 304 replaces the validators that it returned, a usable 200 all of them and the hash of the
    bytes, even by null; other fetches leave the state as it is. `raw_changed` says whether the bytes differ from those known.
    """
    decided = decide(fetches, versions, base)
    old = state.select(*SOURCE, *[F.col(c).alias(f"old_{c}") for c in (*validators, "raw_sha256")])
    same_source = decided[SOURCE[0]].eqNullSafe(old[SOURCE[0]]) & decided[SOURCE[1]].eqNullSafe(old[SOURCE[1]]) & decided[SOURCE[2]].eqNullSafe(old[SOURCE[2]])
    joined = decided.join(old, same_source, "left").drop(*[old[c] for c in SOURCE])
    stored = F.col("status").isin("inserted", "unchanged")
    joined = joined.withColumn("raw_changed", stored & ~F.col("raw_sha256").eqNullSafe(F.col("old_raw_sha256")))
    touched = joined.where(stored | (F.col("status") == "not_modified")).select(
        *SOURCE, F.when(stored, F.col("raw_sha256")).otherwise(F.col("old_raw_sha256")).alias("raw_sha256"),
        *[F.when(stored, F.col(v)).otherwise(F.coalesce(v, f"old_{v}")).alias(v) for v in validators],
    )
    rest = state.join(touched.select(*SOURCE), SOURCE, "left_anti").select(*SOURCE, "raw_sha256", *validators)
    fresh = decided.where("status = 'inserted'").select("content_hash", "variant", "source_kind", F.col("activates").alias("active"))
    return Synced(joined.drop(*[f"old_{c}" for c in (*validators, "raw_sha256")]), versions.select(*fresh.columns).unionByName(fresh), rest.unionByName(touched))


def page_gate(pages: DataFrame, letters: int = 500, words: int = 75) -> DataFrame:
    """(document_id, pages, page, letters, tokens, gate) of each document of pages: document_id, page, text.

    gate: page_no_letters if a page has neither letter nor number (`page` is the first one's place, from 0, if pages are numbered without gaps), else
    too_few_letters, too_few_tokens or complete. Pages are normalised and counted one by one and the counts added up: tokens never
    cross the blank line between pages, so the document need not be joined for it. A null text is a page without letters.
    """
    md = C.markdown_lines(F.coalesce("text", F.lit("")))
    each = pages.select("document_id", "page", md.alias("md"))
    each = each.select("document_id", "page", F.length(F.regexp_replace("md", r"[^\p{L}\p{N}]", "")).cast("long").alias("letters"), F.size(T.tokens(F.col("md"))).cast("long").alias("tokens"))
    sums = each.groupBy("document_id").agg(
        F.count("*").alias("pages"), F.min(F.when(F.col("letters") == 0, F.col("page"))).alias("bare"), F.min("page").alias("least"), F.sum("letters").alias("letters"), F.sum("tokens").alias("tokens")
    )
    gate = (
        F.when(F.col("bare").isNotNull(), "page_no_letters").when(F.col("letters") < letters, "too_few_letters").when(F.col("tokens") < words, "too_few_tokens").otherwise("complete")
    )
    return sums.select("document_id", "pages", (F.col("bare") - F.col("least")).alias("page"), "letters", "tokens", gate.alias("gate"))


def joined(pages: DataFrame) -> DataFrame:
    """(document_id, content_md, content_hash): normalised pages in order, one empty line between them, one LF at the end.

    A document is one row here; it came as one HTTP body, which payloads.BODY_BYTES bounds.
    """
    md = F.rtrim(C.markdown_lines(F.coalesce("text", F.lit(""))), F.lit("\n"))
    each = pages.select("document_id", "page", md.alias("md")).groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", "md"))).alias("p"))
    out = each.select("document_id", F.concat(F.array_join(F.col("p.md"), "\n\n"), F.lit("\n")).alias("content_md"))
    return out.withColumn("content_hash", F.sha2("content_md", 256))
