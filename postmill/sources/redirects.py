"""Redirects over recorded responses: chains of at most three hops that stay where they may."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scopes import let

# fixed values: the statuses that redirect, and how many hops a fetch may take
REDIRECTS, MOST_HOPS = (301, 302, 303, 307, 308), 3

_PARTS = r"^(?i:https)://(?:([^/?#@]*)@)?([^/?#:@\[\]]+|\[[0-9A-Fa-f:.]+\])(:[0-9]*)?(/[^?#]*)?(\?[^#]*)?(?:#.*)?\z"


def parts(url: Column) -> Column:
    """struct(host, port, user, path, query) of an https URL without white space or control characters; null for anything else."""
    piece = lambda i: F.regexp_extract(url, _PARTS, i)
    plain = url.rlike(_PARTS) & ~url.rlike(r"(?U)[\s\x00-\x1f\x7f]") & ~url.contains("\\")
    whole = F.struct(F.lower(piece(2)).alias("host"), piece(3).alias("port"), url.rlike(r"^(?i:https)://[^/?#]*@").alias("user"), F.when(piece(4) == "", "/").otherwise(piece(4)).alias("path"), F.substring(piece(5), 2, 1 << 30).alias("query"))
    return F.when(plain, whole)


def resolved(base: Column, location: Column) -> Column:
    """The absolute form of a Location: of a URL, of one without scheme, of a path, of a query alone, or beside the base's last segment."""
    origin = F.regexp_extract(base, r"^([A-Za-z]+://[^/?#]*)", 1)
    here = F.regexp_extract(base, r"^([^?#]*)", 1)
    beside = F.when(here == origin, F.concat(origin, F.lit("/"))).otherwise(F.regexp_replace(here, r"[^/]*\z", ""))
    return (
        F.when(location.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), location).when(location.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z]+:)", 1), location))
        .when(location.startswith("/"), F.concat(origin, location)).when(location.startswith("?"), F.concat(here, location)).otherwise(F.concat(beside, location))
    )


def same_parameters(a: Column, b: Column) -> Column:
    """Equality of query strings as multisets of parameters."""
    bag = lambda q: F.array_sort(F.filter(F.split(q, "&"), lambda x: x != ""))
    return bag(a) == bag(b)


def allowed(start: Column, target: Column, exact: Column) -> Column:
    """True if a hop may go there: https, the start's host, no user part, no port but 443; with `exact` also its path and its parameters, each as often."""
    def safe(to: Column, of: Column) -> Column:
        there = (to["host"] == of["host"]) & ~to["user"] & to["port"].isin("", ":443") & ~to["path"].rlike(r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|\z)")
        return there & (~exact | ((to["path"] == of["path"]) & same_parameters(to["query"], of["query"])))

    return F.coalesce(let(parts(target), lambda to: let(parts(start), lambda of: safe(to, of))), F.lit(False))


def follow(starts: DataFrame, responses: DataFrame) -> DataFrame:
    """(fetch_id, url, status, hops, outcome) of each start: where its chain ended.

    starts: fetch_id, url, exact. responses: url (once each), status, location. Outcomes: final (a status that doesn't redirect),
    no_location, unsafe (a hop that isn't allowed from the start), too_many (a redirect after MOST_HOPS), not_recorded. Null
    URLs are not recorded. The hops are a fixed number of joins on the URL, so a URL that very many chains share is a skewed
    side that adaptive execution splits.
    """
    r = responses.select(F.col("url").alias("at"), "status", "location")
    open_ = starts.select("fetch_id", F.col("url").alias("start"), "exact", F.col("url").alias("here"), F.lit(0).alias("hops"))
    done = None
    for hop in range(MOST_HOPS + 1):
        met = open_.join(r, F.col("here") == F.col("at"), "left").drop("at")
        to = resolved(F.col("here"), F.col("location"))
        outcome = (
            F.when(F.col("status").isNull(), "not_recorded").when(~F.col("status").isin(*REDIRECTS), "final").when(F.coalesce(F.trim("location"), F.lit("")) == "", "no_location")
            .when(~allowed(F.col("start"), to, F.col("exact")), "unsafe").when(F.lit(hop == MOST_HOPS), "too_many")
        )
        met = met.withColumn("outcome", outcome).withColumn("to", to)
        ended = met.where("outcome is not null").select("fetch_id", F.col("here").alias("url"), "status", "hops", "outcome")
        done = ended if done is None else done.unionByName(ended)
        open_ = met.where("outcome is null").select("fetch_id", "start", "exact", F.col("to").alias("here"), (F.col("hops") + 1).alias("hops"))
    return done
