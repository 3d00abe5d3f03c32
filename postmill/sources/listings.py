"""Rows of two posting boards, from recorded JSON bodies to one listing shape.

Bodies are parsed once into variants and read by path, so a field of another JSON type counts as missing. A body that is no
JSON, or an object that names a key twice, has no rows. Board one sends an object with the list `jobs`, board two a list.
All steps are columns over exploded rows; only HTML is converted in Python, in Arrow batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import canonical as C
from ..functions import markup
from ..functions.scopes import let
from . import payloads

# fixed values: what the boards send
ORIGINS = {"global": "jobs.lever.co", "eu": "jobs.eu.lever.co"}
WORKPLACES = ("unspecified", "on-site", "remote", "hybrid")
LOCATION = "array<struct<label: string, country_code: string, region: string, city: string, workplace_type: string>>"
#: A listing of either board; `valid` says that no required field was missing or wrong.
LISTING = ("external_id", "title", "locations", "description_md", "posting_url", "apply_url", "source_published_at", "source_updated_at", "department", "raw")


def kind(v: Column, path: str) -> Column:
    """The type of what lies at the path: null if nothing does, VOID for a JSON null."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def string(v: Column, path: str) -> Column:
    return F.when(kind(v, path) == "STRING", F.try_variant_get(v, path, "string"))


def array(v: Column, path: str) -> Column:
    return F.when(kind(v, path).startswith("ARRAY"), F.try_variant_get(v, path, "array<variant>"))


def whole(v: Column, path: str) -> Column:
    """An integer's digits: neither a boolean nor a number with a point or exponent."""
    return F.when(kind(v, path).rlike(r"^(BIGINT|DECIMAL\((19|2\d|3\d),0\))$"), F.try_variant_get(v, path, "string"))


def filled(text: Column) -> Column:
    """The text without white space at its ends, null if nothing is left."""
    return F.nullif(C.stripped(text), F.lit(""))


def _week_date(year: Column, week: Column, day: Column) -> Column:
    """The date of an ISO week's day; null where the year has no such week or the week no such day."""
    fourth = F.make_date(year.try_cast("int"), F.lit(1), F.lit(4))  # in week 1, always
    date = F.date_add(fourth, (week.try_cast("int") - 1) * 7 + day.try_cast("int") - 1 - F.weekday(fourth))
    sound = day.rlike("^[1-7]$") & (F.extract(F.lit("YEAROFWEEK"), date) == year.try_cast("int")) & (F.extract(F.lit("WEEK"), date) == week.try_cast("int"))
    return F.when(sound, date)


def moment(text: Column) -> Column:
    """A timestamp from ISO 8601 with an offset or Z; null without one. Dates are calendar or week dates, basic or extended; fractions are cut to microseconds."""
    form = r"^(?:(\d{4})-?(\d{2})-?(\d{2})|(\d{4})-?W(\d{2})(?:-?(\d))?)[^\d](\d{2})(?::?(\d{2}))?(?::?(\d{2}))?(?:[.,](\d{1,6})\d*)?(Z|[+-]\d{2})(?::?(\d{2}))?$"

    def read(t: Column) -> Column:
        part = lambda i, other="00": F.coalesce(F.nullif(F.regexp_extract(t, form, i), F.lit("")), F.lit(other))
        zone = F.when(part(11) == "Z", "+00:00").otherwise(F.concat(part(11), F.lit(":"), part(12)))
        of_week = _week_date(part(4, ""), part(5, ""), part(6, "1")).cast("string")
        date = F.when(part(4, "") != "", of_week).otherwise(F.concat_ws("-", part(1), part(2), part(3)))
        iso = F.concat(date, F.lit("T"), part(7), F.lit(":"), part(8), F.lit(":"), part(9), F.lit("."), part(10, "0"), zone)
        return F.when(t.rlike(form), F.try_to_timestamp(iso))

    return let(C.stripped(text), read)


def places(labels: Column, country: Column, workplace: Column) -> Column:
    none = F.lit(None).cast("string")
    return F.transform(labels, lambda x: F.struct(x.alias("label"), country.alias("country_code"), none.alias("region"), none.alias("city"), workplace.alias("workplace_type"))).cast(LOCATION)


def envelope(body: Column) -> Column:
    """True if board one's body is whole: an object, `jobs` a list, `meta` null or an object whose `total`, if it is there, is the list's length."""
    v = F.try_parse_json(body)
    jobs, total = array(v, "$.jobs"), whole(v, "$.meta.total")
    meta = F.coalesce(kind(v, "$.meta"), F.lit("VOID"))
    agrees = kind(v, "$.meta.total").isNull() | F.coalesce(total == F.size(jobs).cast("string"), F.lit(False))
    whole_ = jobs.isNotNull() & ((meta == "VOID") | (meta.startswith("OBJECT") & agrees))
    return F.coalesce((F.octet_length(body) <= payloads.BODY_BYTES) & whole_, F.lit(False))


def board_one(bodies: DataFrame) -> DataFrame:
    """(fetch_id, place, valid, the listing) of each element of `jobs`; bodies: fetch_id, body. Bodies that are not whole give no rows."""
    rows = bodies.where(envelope(F.col("body"))).select("fetch_id", F.posexplode(F.try_variant_get(F.try_parse_json("body"), "$.jobs", "array<variant>")).alias("place", "row"))
    row, no = F.col("row"), F.lit(None).cast("string")
    number, label = whole(row, "$.id"), filled(string(row, "$.location.name"))
    departments = F.transform(array(row, "$.departments"), lambda d: filled(string(d, "$.name")))
    url = string(row, "$.absolute_url")
    rows = rows.select(
        "fetch_id", "place", F.when(~number.rlike("^-|^0$"), number).alias("external_id"), filled(string(row, "$.title")).alias("title"),
        places(F.filter(F.array(label), lambda x: x.isNotNull()), no, no).alias("locations"), string(row, "$.content").alias("content"), F.when(payloads.public_url(url), url).alias("posting_url"),
        moment(string(row, "$.first_published")).alias("source_published_at"), moment(string(row, "$.updated_at")).alias("source_updated_at"),
        F.try_element_at(F.filter(departments, lambda d: d.isNotNull()), F.lit(1)).alias("department"), F.to_json(row).alias("raw"),
    )
    needed = F.col("external_id").isNotNull() & F.col("title").isNotNull() & F.col("content").isNotNull() & F.col("posting_url").isNotNull()
    rows = rows.withColumn("description_md", C.block(markup.markdown(markup.unescaped("content")))).withColumn("apply_url", F.col("posting_url"))
    return rows.select("fetch_id", "place", needed.alias("valid"), *LISTING)


def hosted_url(url: Column, token: Column, external_id: Column, region: Column) -> Column:
    """True for an https URL of the region's origin whose path begins with the board's token and, percent-decoded once and strictly, the listing's id."""
    form = r"^(?i:https)://(?::?@)?([^/?#@:\[\]]+)(?::(0*443)?)?/([^/?#]*)/([^/?#]*)(?:[/?#].*)?\z"
    segment = F.regexp_extract(url, form, 4)
    origin = F.create_map(*[F.lit(x) for kv in ORIGINS.items() for x in kv])[region]
    # a plus stays a plus; bytes that are no UTF-8 decode to a mark that no id holds
    decoded = F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B")))
    clean = ~url.rlike(r"(?U)[\s\x1c-\x1f]|\p{Cc}") & ~segment.rlike(r"%(?![0-9a-fA-F]{2})") & ~decoded.rlike(r"[/\\�]|\p{Cc}")
    return F.coalesce(url.rlike(form) & clean & (F.lower(F.regexp_extract(url, form, 1)) == origin) & (F.regexp_extract(url, form, 3) == token) & (decoded == external_id), F.lit(False))


def board_two(bodies: DataFrame) -> DataFrame:
    """(fetch_id, place, valid, the listing) of each element of a body; bodies: fetch_id, body, token, region."""
    parsed = bodies.withColumn("v", F.try_parse_json("body"))
    rows = parsed.select("fetch_id", "token", "region", F.posexplode(array(F.col("v"), "$")).alias("place", "row"))
    row, lists = F.col("row"), array(F.col("row"), "$.lists")
    labels = F.transform(array(row, "$.categories.allLocations"), lambda x: string(x, "$"))
    labels = F.when(F.forall(labels, lambda x: x.isNotNull()), F.array_distinct(F.filter(F.transform(labels, C.stripped), lambda x: x != "")))
    other = F.filter(F.array(filled(string(row, "$.categories.location"))), lambda x: x.isNotNull())
    labels = F.when(F.size(labels) > 0, labels).otherwise(other)
    country, workplace = string(row, "$.country"), string(row, "$.workplaceType")
    missing = lambda path: F.coalesce(kind(row, path), F.lit("VOID")) == "VOID"
    headings = F.transform(lists, lambda x: F.regexp_replace(F.btrim(string(x, "$.text"), F.lit(" \t")), r"[ \t]+", " "))
    bodies_ = F.transform(lists, lambda x: F.concat(F.lit("<ul>"), string(x, "$.content"), F.lit("</ul>")))
    listed = lists.isNotNull() & F.forall(headings, lambda h: h.isNotNull()) & F.forall(bodies_, lambda b: b.isNotNull())
    rows = rows.select(
        "fetch_id", "token", "region", "place", filled(string(row, "$.id")).alias("external_id"), filled(string(row, "$.text")).alias("title"), string(row, "$.hostedUrl").alias("hosted"), string(row, "$.applyUrl").alias("apply"),
        string(row, "$.description").alias("description"), F.coalesce(headings, F.array().cast("array<string>")).alias("headings"), bodies_.alias("bodies"), string(row, "$.additional").alias("additional"),
        ((missing("$.lists") | listed) & (missing("$.additional") | string(row, "$.additional").isNotNull())).alias("shaped"),
        places(labels, F.when(country.rlike(r"^[A-Z]{2}\z"), country), F.when(workplace.isin(*WORKPLACES), workplace)).alias("locations"),
        filled(string(row, "$.categories.department")).alias("department"), F.to_json(row).alias("raw"),
    )
    # description, lists and addition go to Python as one array
    parts = F.concat(F.array("description", "additional"), F.coalesce("bodies", F.array().cast("array<string>")))
    rows = rows.withColumn("md", F.transform(markup.markdown_all(parts), C.block))
    both = lambda h, m: F.filter(F.array(F.when(h != "", F.concat(F.lit("## "), h)), m), lambda x: x.isNotNull() & (x != ""))
    sections = F.transform(F.zip_with("headings", F.slice("md", F.lit(3), F.size("headings")), both), lambda x: C.block(F.array_join(x, "\n\n")))
    blocks = F.filter(F.concat(F.slice("md", 1, 1), sections, F.slice("md", 2, 1)), lambda x: x.isNotNull() & (x != ""))
    url = lambda u: F.when(hosted_url(F.col(u), F.col("token"), F.col("external_id"), F.col("region")), F.col(u))
    none = F.lit(None).cast("timestamp")
    rows = rows.select(
        "fetch_id", "place", "external_id", "title", "locations", F.when(F.col("description").isNotNull() & F.col("shaped"), C.block(F.array_join(blocks, "\n\n"))).alias("description_md"),
        url("hosted").alias("posting_url"), url("apply").alias("apply_url"), none.alias("source_published_at"), none.alias("source_updated_at"), "department", "raw",
    )
    needed = ("external_id", "title", "description_md", "posting_url", "apply_url")
    valid = F.lit(True)
    for c in needed:
        valid = valid & F.col(c).isNotNull()
    return rows.select("fetch_id", "place", valid.alias("valid"), *LISTING)


def paged(pages: DataFrame) -> DataFrame:
    """Adds `kept` (the page's rows count) and `last` (a short page, which ends the listing) to board two's pages.

    pages: fetch_id, page (from 0), http_status, body. Pages count until the first bad one: status other than 200, no list,
    too many rows, a body beyond the byte limit alone or with those before, a page or an id that was there before. What
    follows a short or bad page does not count.
    """
    by_page = Window.partitionBy("fetch_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    rows = array(F.try_parse_json("body"), "$")
    p = pages.withColumn("n", F.size(rows)).withColumn("size", F.octet_length("body")).withColumn("print", F.sha2(F.to_json(F.try_parse_json("body")), 256))
    ids = pages.select("fetch_id", "page", F.explode(rows).alias("row")).select("fetch_id", "page", filled(string(F.col("row"), "$.id")).alias("id")).where("id is not null")
    again = ids.groupBy("fetch_id", "id").agg(F.array_sort(F.collect_list("page")).alias("at"))  # pages are few: an id is on at most MOST_PAGES of a sane fetch
    again = again.select("fetch_id", F.get("at", 1).alias("page")).where("page is not null").distinct().withColumn("twice", F.lit(True))
    p = p.join(again, ["fetch_id", "page"], "left")
    same = F.row_number().over(Window.partitionBy("fetch_id", "print").orderBy("page")) > 1
    good = (F.col("http_status") == 200) & (F.col("n") >= 0) & (F.col("n") <= payloads.PAGE_ROWS) & (F.sum("size").over(by_page) <= payloads.BODY_BYTES) & ~same & F.col("twice").isNull()
    p = p.withColumn("good", F.coalesce(good, F.lit(False)) & (F.col("page") == F.row_number().over(Window.partitionBy("fetch_id").orderBy("page")) - 1))
    short = F.col("n") < payloads.PAGE_ROWS
    before = Window.partitionBy("fetch_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("ended", F.coalesce(F.max(short).over(before), F.lit(False))).withColumn("so_far", F.min("good").over(by_page))
    kept = F.col("so_far") & ~F.col("ended") & (F.col("page") < payloads.MOST_PAGES)
    return p.select(*pages.columns, kept.alias("kept"), (kept & short).alias("last"))


def completeness(fetches: DataFrame, whole_: Column, rows: DataFrame) -> DataFrame:
    """(fetch_id, complete, n_rows): whole_ of the fetch, and no row of it was invalid."""
    counts = rows.groupBy("fetch_id").agg(F.count_if("valid").alias("n_rows"), F.bool_and("valid").alias("clean"))
    ended = fetches.groupBy("fetch_id").agg(F.bool_or(whole_).alias("ended")).join(counts, "fetch_id", "left")
    return ended.select("fetch_id", (F.col("ended") & F.coalesce("clean", F.lit(True))).alias("complete"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"))
