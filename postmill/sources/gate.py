"""The gate that recorded responses with a document pass: the first of several failures wins, and bodies aren't read whole for it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical as C
from . import payloads

# fixed values: how a document begins, and its media type
SIGNATURE, MEDIA_TYPE = b"%PDF-", "application/pdf"


def header(headers: Column, name: str) -> Column:
    """A header's value, whatever the case of its name; the first if names differ in case only."""
    named = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name)
    return F.get(F.transform(named, lambda e: e["value"]), F.lit(0))


def gate(status: Column, headers: Column, length: Column, head: Column, most: int = payloads.BODY_BYTES) -> Column:
    """struct(outcome, reason, byte_count, etag, last_modified) of a response.

    headers: a map of strings. length, head: the body's bytes and its first ones; a null length is an empty body. Outcomes:
    ok, not_modified (a 304), rejected with a reason: another status than 200, another media type (parameters don't count),
    a declared length that is no number or beyond `most`, a body beyond it, none at all, one that begins otherwise.
    Validators are those of accepted and unchanged responses.
    """
    media = F.lower(F.btrim(F.split_part(F.coalesce(header(headers, "content-type"), F.lit("")), F.lit(";"), F.lit(1))))
    declared = header(headers, "content-length")
    number = F.regexp_replace(F.when(declared.rlike(r"^\s*[+-]?[0-9]+(?:_[0-9]+)*\s*\z"), F.btrim(declared)), "_", "")
    # a number of many digits is beyond any limit
    far = number.rlike(r"^\+?0*[1-9][0-9]{18,}\z") | (number.try_cast("bigint") > most)
    size = F.coalesce(length, F.lit(0))
    reason = (
        F.when(status != 200, "non_200_status").when(media != MEDIA_TYPE, "wrong_media_type").when(declared.isNotNull() & number.isNull(), "invalid_content_length")
        .when(F.coalesce(far, F.lit(False)), "content_length_exceeds_limit").when(size > most, "streamed_overflow").when(size == 0, "empty_body")
        .when(F.coalesce(F.substring(head, 1, len(SIGNATURE)) != F.lit(SIGNATURE), F.lit(True)), "missing_pdf_signature")
    )
    outcome = F.when(status == 304, "not_modified").when(F.coalesce(status, F.lit(0)) != 200, "rejected").when(reason.isNull(), "ok").otherwise("rejected")
    counted = F.when(reason == "content_length_exceeds_limit", number.try_cast("bigint")).when(reason.isin("streamed_overflow", "empty_body", "missing_pdf_signature") | (outcome == "ok"), size)
    taken = outcome != "rejected"
    said = F.when(outcome == "rejected", F.concat(F.lit("fetcher."), F.coalesce(reason, F.lit("non_200_status"))))
    return F.struct(
        outcome.alias("outcome"), said.alias("reason"), F.when(status == 200, counted).alias("byte_count"),
        F.when(taken, header(headers, "etag")).alias("etag"), F.when(taken, header(headers, "last-modified")).alias("last_modified"),
    )


def flags(gated: Column) -> Column:
    """Which validators an accepted or unchanged response returned."""
    return C.validator_flags(gated["etag"], gated["last_modified"])


def recorded_bodies(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, head) of the files below a folder: lengths come from the listing, and of a body its first bytes alone are read.

    Spark lists no empty files: a response whose file is missing has an empty body, as gate() takes a null length.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for uri in batch.column("path").to_pylist():
                fs, at = arrow_fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file:///") else uri)
                with fs.open_input_file(at) as f:
                    found.append(f.read(len(SIGNATURE)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], ["path", "length", "head"])

    return files.mapInArrow(heads, "path string, length long, head binary")
