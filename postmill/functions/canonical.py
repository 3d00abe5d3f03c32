"""Canonical text and content hashes, as column expressions."""

from __future__ import annotations

import re
import sys
import unicodedata
from datetime import datetime, timedelta, timezone
from email.utils import parsedate_to_datetime
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

#: White space as Unicode text functions see it: Java's Unicode class and the four separators that it leaves out.
SPACES = r"(?U)[\s\x1c-\x1f]+"


def _composed(x: str | None) -> str | None:
    return x if x is None or x.isascii() else unicodedata.normalize("NFKC", x)


def _foreign(text: Column) -> Column:
    """The text if it has a character beyond ASCII, else null: only such texts are sent to Python."""
    return F.when(text.rlike(r"[^\x00-\x7f]"), text)


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(_composed)


def nfkc(text: Column) -> Column:
    """Compatibility composition; Spark has no such function, and ASCII needs none."""
    return F.coalesce(_nfkc(_foreign(text)), text)


@F.pandas_udf(ArrayType(StringType()))
def nfkc_all(texts: pd.Series) -> pd.Series:
    """nfkc() of each element: the lambdas of Spark's array functions can't call Python."""
    return texts.map(lambda xs: None if xs is None else [_composed(x) for x in xs])


@F.pandas_udf(StringType())
def _casefold(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else x.casefold())


def casefold(text: Column) -> Column:
    return F.coalesce(_casefold(_foreign(text)), F.lower(text))


def _one_line(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, SPACES, " "))


def stripped(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def inline(text: Column) -> Column:
    """One composed line: runs of white space become one space, none at the ends."""
    return _one_line(nfkc(text))


def block(text: Column) -> Column:
    """Block text: LF line ends, no blanks at line ends, no empty lines at the edges, two empty lines in a row at most."""
    bare = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"(?md)[ \t]+$", "")  # d: LF alone ends a line
    return F.regexp_replace(F.btrim(bare, F.lit("\n")), r"\n{4,}", "\n\n\n")


def description(text: Column) -> Column:
    """Composed block text."""
    return block(nfkc(text))


def title_norm(text: Column) -> Column:
    """Folded title."""
    return casefold(inline(text))


def canonical_json(**fields: Column) -> Column:
    """A JSON object with sorted keys and no blanks; nulls are kept."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


def locations(labels: Column) -> Column:
    """Distinct non-blank places in code point order."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(nfkc_all(labels), _one_line), lambda x: x != "")))


LOCATION_FIELDS = ("label", "country_code", "region", "city", "workplace_type")


def five_field_locations(places: Column) -> Column:
    """Distinct locations of five composed one-line fields, in code point order of the fields, where null counts as empty.

    Blank fields become null. The result is null if a label is blank: such a listing is invalid. Fields of the structs are
    in alphabetical order, as the canonical JSON has them.
    """
    # lambdas can't call Python, so each field is composed as an array of its own
    composed = F.arrays_zip(*[nfkc_all(places[f]) for f in LOCATION_FIELDS])
    rows = F.transform(composed, lambda z: F.array(*[F.nullif(_one_line(z[str(i)]), F.lit("")) for i in range(len(LOCATION_FIELDS))]))
    ordered = F.transform(rows, lambda r: F.struct(F.transform(r, lambda x: F.coalesce(x, F.lit(""))).alias("order"), r.alias("r")))
    names = sorted(LOCATION_FIELDS)
    out = F.transform(F.array_distinct(F.array_sort(ordered)), lambda o: F.struct(*[F.get(o["r"], LOCATION_FIELDS.index(f)).alias(f) for f in names]))
    return F.when(F.forall(out, lambda p: p["label"].isNotNull()), out)


def content_json(title: Column, text: Column, places: Column) -> Column:
    """The canonical JSON that a version's hash is taken of; places: five_field_locations() or plain labels."""
    return canonical_json(description_md=description(text), locations=places, title=title_norm(title))


def content_hash(title: Column, text: Column, places: Column) -> Column:
    return F.sha2(content_json(title, text, places), 256)


@cache
def _deleted() -> dict[int, None]:
    """Control and format characters, all but tab and LF."""
    return {c: None for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)) in ("Cc", "Cf") and chr(c) not in "\t\n"}


_BLANKS, _MARK, _NUMBER = re.compile(r"[^\S\n]+"), re.compile(r"[-*+•·–—] (?=\S)"), re.compile(r"(\d+)[.)] (?=\S)")


def _markdown(text: str | None) -> str | None:
    if text is None:
        return None
    t = _composed(text.replace("\r\n", "\n").replace("\r", "\n"))
    blocks: list[list[str]] = []  # the lines that make up each output line; an empty one for a blank line
    for line in _BLANKS.sub(" ", t.translate(_deleted())).split("\n"):
        line = line.strip(" ")
        if not line:
            if blocks and blocks[-1]:
                blocks.append([])
            continue
        mark, number = _MARK.match(line), _NUMBER.match(line)
        if mark:
            line = "- " + line[mark.end() :]
        elif number:
            line = f"{number[1]}. {line[number.end() :]}"
        if mark or number or not blocks or not blocks[-1] or blocks[-1][-1].endswith((".", ":", ";", "?", "!")):
            blocks.append([line])
        else:
            blocks[-1].append(line)
    if blocks and not blocks[-1]:
        blocks.pop()
    return "\n".join(map(" ".join, blocks)) + "\n"


@F.pandas_udf(StringType())
def markdown_lines(text: pd.Series) -> pd.Series:
    """Composed plain Markdown of extracted pages, one LF at the end: no control or format characters, white space runs and
    blank runs single, list marks unified, and a wrapped line joined to the one before unless that ends a sentence or the
    line is a list item."""
    return text.map(_markdown)


def rfc3339(ts: Column) -> Column:
    """The time in UTC with microseconds, whatever the session's zone."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def http_date(ts: Column) -> Column:
    """The time as an HTTP date, in GMT and whole seconds."""
    return F.date_format(F.to_utc_timestamp(ts, F.current_timezone()), "EEE, dd MMM yyyy HH:mm:ss 'GMT'")


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _mail_micros(text: str | None) -> int | None:
    try:
        at = parsedate_to_datetime(text) if text is not None else None
    except (TypeError, ValueError, OverflowError):
        return None
    if at is None:
        return None
    return ((at if at.tzinfo else at.replace(tzinfo=timezone.utc)) - _EPOCH) // timedelta(microseconds=1)


@F.pandas_udf(LongType())
def _date_micros(text: pd.Series) -> pd.Series:
    return pd.Series([_mail_micros(x) for x in text], dtype="Int64")


def parse_http_date(text: Column) -> Column:
    """The time of a date header in any form that mail dates take; without a zone it is UTC, anything else is null."""
    return F.timestamp_micros(_date_micros(text))


def validator_flags(etag: Column, last_modified: Column) -> Column:
    """Which validators a response returned; a date that can't be parsed counts as none."""
    return F.struct(etag.isNotNull().alias("etag"), parse_http_date(last_modified).isNotNull().alias("last_modified"))


def masked_url(url: Column) -> Column:
    """A connection URL without its password."""
    return F.regexp_replace(url, r"(://[^:@/]*):[^@/]*@", "$1:***@")
