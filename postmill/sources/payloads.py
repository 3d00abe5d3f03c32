"""Recorded payloads: envelopes, pages and URLs of posting boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the limits of a body, a page and a listing
BODY_BYTES, PAGE_ROWS, MOST_PAGES = 10 << 20, 100, 100


def envelope(body: Column) -> Column:
    """ok, or why a JSON body is no object with the list `jobs` of the length that meta.total states."""
    jobs = F.get_json_object(body, "$.jobs")
    total = F.get_json_object(body, "$.meta.total")
    return (
        F.when(F.octet_length(body) > BODY_BYTES, "too_large").when(F.json_object_keys(body).isNull(), "not_an_object").when(jobs.isNull() | ~jobs.startswith("["), "no_jobs")
        .when(total.isNotNull() & ~total.rlike(r"^\d+$"), "bad_total").when(total.isNotNull() & (total.cast("int") != F.json_array_length(jobs)), "total_differs")
        .otherwise("ok")
    )


def leading_pages(pages: DataFrame, key: str, order: str, good: str) -> DataFrame:
    """Pages before the first bad one, which ends the listing; at most MOST_PAGES count. listings.paged() has the rules of board two."""
    w = Window.partitionBy(key).orderBy(order)
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    out = pages.withColumn("_ok", F.min(F.col(good)).over(so_far)).withColumn("_page", F.row_number().over(w))
    return out.where(F.col("_ok") & (F.col("_page") <= MOST_PAGES)).drop("_ok", "_page")


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def public_url(url: Column) -> Column:
    """http or https, a host, no user part, and a port that is a number up to 65535 if there is one."""
    port = F.regexp_extract(url, r"^[^/]*//(?:\[[^\]/]*\]|[^/?#:]*):(\d+)", 1)
    return F.coalesce(url.rlike(r"^(?i)https?://(\[[0-9a-f:.]+\]|[^/@\s?#:\[\]]+)(:\d*)?([/?#]\S*)?$") & ((port == "") | (port.try_cast("int") <= 65535)), F.lit(False))


# fixed values: hosts and paths of both boards' URLs, with the region that the second board's hosts stand for
BOARD_ONE = (
    ("boards.greenhouse.io", "{token}"), ("boards.greenhouse.io", "{token}/jobs"), ("boards.greenhouse.io", "{token}/jobs/{id}"), ("job-boards.greenhouse.io", "{token}"),
    ("job-boards.greenhouse.io", "{token}/jobs"), ("job-boards.greenhouse.io", "{token}/jobs/{id}"), ("boards-api.greenhouse.io", "v1/boards/{token}/jobs"), ("boards-api.greenhouse.io", "v1/boards/{token}/jobs/{id}"),
)
BOARD_ONE_EMBED = ("boards.greenhouse.io", "embed/job_board", "for=")
BOARD_TWO_PATHS = {"jobs": ("{token}", "{token}/{id}", "{token}/{id}/apply"), "api": ("v0/postings/{token}", "v0/postings/{token}/{id}")}
BOARD_TWO_REGIONS = {"": "lever.co", "eu": "eu.lever.co"}


def _cut(url: Column) -> Column:
    """struct(host, path, query) of an https URL, path the segments without a last empty one; null for any other, or one with a second `?`."""
    ahead, after = F.split_part(url, F.lit("#"), F.lit(1)), F.regexp_extract(url, "(?s)#(.*)", 1)
    query = F.regexp_extract(ahead, r"(?s)\?(.*)", 1)
    parts = F.split(F.substring(F.split_part(ahead, F.lit("?"), F.lit(1)), 9, 1 << 30), "/")
    path = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1 - F.when(F.element_at(parts, -1) == "", 1).otherwise(0), F.lit(0)))
    plain = url.startswith("https://") & ~query.contains("?") & ~after.rlike(r"[?\s]")
    return F.when(plain, F.struct(F.get(parts, 0).alias("host"), path.alias("path"), query.alias("query")))


def endpoint_token(token: Column) -> Column:
    return F.coalesce(token.rlike(r"^[A-Za-z0-9][A-Za-z0-9_-]{0,127}\z"), F.lit(False))


def _token_at(cut: Column, host: str, form: str, steps_up: str) -> Column:
    """The token of a URL whose host and path have the form; an id is any segment that doesn't step to another one."""
    names, path = form.split("/"), cut["path"]
    fits = (cut["host"] == host) & (F.size(path) == len(names))
    for i, name in enumerate(names):
        here = F.get(path, i)
        fits &= endpoint_token(here) if name == "{token}" else (here != "") & ~here.rlike(steps_up) if name == "{id}" else here == name
    return F.when(fits, F.get(path, names.index("{token}")))


def board_token(url: Column) -> Column:
    """The token of board one that a board, listing or embed URL names, else null."""
    cut = _cut(url)
    host, form, key = BOARD_ONE_EMBED
    asked = F.regexp_replace(F.split_part(cut["query"], F.lit("&"), F.lit(1)), f"^{key}", "")
    embed = F.when((cut["host"] == host) & (F.array_join(cut["path"], "/") == form) & cut["query"].startswith(key) & endpoint_token(asked), asked)
    return F.coalesce(*[_token_at(cut, h, f, r"^(?:\.|\.\.|(?i:%2e|%2e%2e))\z") for h, f in BOARD_ONE], embed)


def board_two_endpoint(url: Column) -> Column:
    """struct(token, region) of the second board's endpoint that a board, listing, form or API URL names, else null."""
    cut = _cut(F.when(~url.rlike(r"\s"), url))
    found = [F.when(t.isNotNull(), F.struct(t.alias("token"), F.lit(r).alias("region"))) for r, of in BOARD_TWO_REGIONS.items() for kind, forms in BOARD_TWO_PATHS.items() for f in forms for t in [_token_at(cut, f"{kind}.{of}", f, r"^(?i:\.|%2e){1,2}\z")]]
    return F.coalesce(*found)
