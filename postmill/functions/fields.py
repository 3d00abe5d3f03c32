"""Searched fields with positions: folded tokens with their places in the source, segments, gaps, and phrases found in one pass.

A text's folding (compatibility composition by base character and its marks, case folding, four apostrophes as one) changes
lengths, so every folded character keeps the place of its base character in the source. Spark has no such function; both
functions here run in Arrow batches, and what they return is arrays that column expressions work on.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from itertools import pairwise
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

# fixed values: the marks that end a segment, and the characters that count as an apostrophe
TERMINATORS, APOSTROPHES = ".!?。！？", "’‘ʼ＇"

_BOUNDARY, _ENDS = re.compile(rf"\n(?:[^\S\n]*\n)+|[{TERMINATORS}]+"), re.compile(f"[{TERMINATORS}]")
_PARAGRAPH, _WORD = re.compile(r"\n[^\S\n]*\n"), re.compile(r"[^\W_]+(?:'[^\W_]+)*")
#: Kinds of gaps with the mark that stands for each in a field's marked text.
MARKS = {"whitespace": " ", "comma": " , ", "semicolon": " ; ", "slash": " / ", "other": " | ", "sentence": " . ", "paragraph": " . "}


class Token(NamedTuple):
    """A folded token, the number of its segment, and where it begins and ends in the source."""

    value: str
    segment: int
    start: int
    end: int


@cache
def _marks() -> str:
    """All combining marks, as a set of a pattern."""
    return "".join(chr(c) for c in range(sys.maxunicode + 1) if unicodedata.combining(chr(c)))


@cache
def _mark() -> re.Pattern[str]:
    return re.compile(f"[{_marks()}]")


@cache
def _clusters() -> re.Pattern[str]:
    """A base character and the marks after it; marks without a base are passed over."""
    return re.compile(f"[^{_marks()}][{_marks()}]*", re.DOTALL)


_SAME = str.maketrans(dict.fromkeys(APOSTROPHES, "'"))


@lru_cache(maxsize=100_000)
def _fold(cluster: str) -> str:
    folded = unicodedata.normalize("NFKC", cluster).casefold()
    return "'" if folded in tuple(APOSTROPHES) else folded


def folded(text: str) -> tuple[str, list[int] | None]:
    """The folded text, and the place of each of its characters in the source; None if nothing has moved."""
    if text.isascii():
        return text.lower(), None
    if unicodedata.is_normalized("NFKC", text) and not _mark().search(text):  # every character is its own base and composed
        out = text.casefold().translate(_SAME)
        # folding only lengthens: where the length is the same, nothing has moved
        return out, None if len(out) == len(text) else [i for i, c in enumerate(text) for _ in c.casefold()]
    out, places = [], []
    for found in _clusters().finditer(text):
        piece = _fold(found[0])
        out.append(piece)
        places += [found.start()] * len(piece)
    return "".join(out), places


def unified(text: str) -> str:
    """The source that positions count in: LF line ends."""
    return text.replace("\r\n", "\n").replace("\r", "\n")


def segments(source: str) -> Iterator[tuple[int, int]]:
    """Where the non-blank segments begin and end."""
    at = 0
    for end in [*_BOUNDARY.finditer(source), None]:
        stop = end.start() if end else len(source)
        if source[at:stop].strip():
            yield at, stop
        at = end.end() if end else stop


def tokens(source: str) -> list[Token]:
    out = []
    for n, (lo, hi) in enumerate(segments(source)):
        text, places = folded(source[lo:hi])
        for w in _WORD.finditer(text):
            first, last = (places[w.start()], places[w.end() - 1]) if places else (w.start(), w.end() - 1)
            out.append(Token(w[0].replace("'", ""), n, lo + first, lo + last + 1))
    return out


@lru_cache(maxsize=100_000)
def gap(between: str) -> str:
    """The kind of what lies between two tokens of one segment."""
    if _PARAGRAPH.search(between):
        return "paragraph"
    if _ENDS.search(between):
        return "sentence"
    for kind, marks in (("comma", ","), ("semicolon", ";"), ("slash", "/\\")):
        if any(m in between for m in marks):
            return kind
    return "whitespace" if not between.strip() else "other"


def gaps(source: str, of: list[Token]) -> list[str | None]:
    """The kind of the gap after each token, null after the last; tokens of two segments have the end of one between them."""
    kinds = [gap(source[a.end:b.start]) for a, b in pairwise(of)]
    return [*("sentence" if a.segment != b.segment and k != "paragraph" else k for k, (a, b) in zip(kinds, pairwise(of), strict=True)), None][: len(of)]


def marked(source: str, of: list[Token]) -> str:
    """Tokens with one mark between: a blank, or the kind of gap among , ; / | and . for the end of a segment."""
    return "".join(x for t, k in zip(of, gaps(source, of), strict=True) for x in (t.value, MARKS[k] if k else ""))


@dataclass(frozen=True)
class Wanted:
    """A class of phrases, the kinds of fields that they are looked for in, and whether one span in a field is enough."""

    name: str
    phrases: tuple[str, ...]
    kinds: tuple[str, ...] = ()
    once: bool = False


@lru_cache(maxsize=64)
def _automaton(wanted: tuple[Wanted, ...]):
    """(numbers of the phrases' tokens, automaton over these numbers): a phrase's value is its length and its classes."""
    import ahocorasick

    numbers: dict[str, int] = {}
    of: dict[tuple[int, ...], set[int]] = {}
    for c, w in enumerate(wanted):
        for p in w.phrases:
            key = tuple(numbers.setdefault(t.value, len(numbers) + 1) for t in tokens(unified(p)))
            if key:
                of.setdefault(key, set()).add(c)
    machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for key, classes in of.items():
        machine.add_word(key, (len(key), sorted(classes)))
    machine.make_automaton()
    return numbers, machine if of else None


def spans(of: list[Token], kind: str, wanted: tuple[Wanted, ...]) -> list[tuple[int, int, int]]:
    """(class, first token, token after the last) of every phrase in a field, whether or not it reaches over segments."""
    numbers, machine = _automaton(wanted)
    if machine is None or not of:
        return []
    out, done = [], set()
    for last, (length, classes) in machine.iter(tuple(numbers.get(t.value, 0) for t in of)):
        first = last - length + 1
        for c in classes:
            if c not in done and (not wanted[c].kinds or kind in wanted[c].kinds):
                out.append((c, first, last + 1))
                if wanted[c].once:
                    done.add(c)
    return out


#: Bytes of text that a task turns into Python objects at once: what is made of a slice becomes Arrow arrays before the next.
SLICE = 1 << 20


def _slices(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[tuple[list, ...]]:
    """The batches' columns in slices of rows, of bounded bytes in their texts or of one row."""
    for columns in batches:
        sizes = [pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns if pa.types.is_string(c.type) or pa.types.is_large_string(c.type)]
        upto, at, n = np.cumsum(sum(sizes)), 0, len(columns[0])
        while at < n:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, side="right")))
            yield tuple(c.slice(at, end - at).to_pylist() for c in columns)
            at = end


FIELD = "struct<kind:string,ordinal:int,words:string,marked:string>"
SPAN = "struct<of:int,field:int,first:int,after:int,segment:int,start:int,end:int,whole:boolean>"
_FIELDS = pa.list_(pa.struct([("kind", pa.string()), ("ordinal", pa.int32()), ("words", pa.string()), ("marked", pa.string())]))
_SPANS = pa.list_(pa.struct([(c, pa.int32()) for c in ("of", "field", "first", "after", "segment", "start", "end")] + [("whole", pa.bool_())]))


def searched(title: Column, description: Column, labels: Column, wanted: tuple[Wanted, ...]) -> Column:
    """struct(fields, spans) of a listing: title, description and each location label are fields of their own.

    `words` are a field's tokens with blanks around each, `marked` the same with gaps; a span has the number of its class,
    of its field, its first token and the one after its last, the segment where it begins and whether it ends there (`whole`),
    and its place in the source. A null title counts
    as empty; a null description or label is no field (labels keep their ordinals).
    """

    @arrow_udf(f"struct<fields:array<{FIELD}>,spans:array<{SPAN}>>")
    def search(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for titles, texts, labelled in _slices(batches):
            all_fields, all_spans = [], []
            for t, d, ls in zip(titles, texts, labelled, strict=True):
                sources = [("title", 0, t or "")] + [("description", 0, d)] * (d is not None) + [("location", i, x) for i, x in enumerate(ls or ()) if x is not None]
                fields, found = [], []
                for n, (kind, ordinal, text) in enumerate(sources):
                    source = unified(text)
                    of = tokens(source)
                    fields.append({"kind": kind, "ordinal": ordinal, "words": f" {' '.join(x.value for x in of)} ", "marked": marked(source, of)})
                    found += [{"of": c, "field": n, "first": a, "after": b, "segment": of[a].segment, "start": of[a].start, "end": of[b - 1].end, "whole": of[a].segment == of[b - 1].segment} for c, a, b in spans(of, kind, wanted)]
                all_fields.append(fields)
                all_spans.append(found)
            yield pa.StructArray.from_arrays([pa.array(all_fields, _FIELDS), pa.array(all_spans, _SPANS)], ["fields", "spans"])

    return search(title, description, labels)


_TOKENS = ArrayType(StructType().add("segment", IntegerType()).add("token", StringType()).add("start", IntegerType()).add("end", IntegerType()).add("gap", StringType()))


_ROWS = pa.list_(pa.struct([("segment", pa.int32()), ("token", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("gap", pa.string())]))


@arrow_udf(_TOKENS)
def token_rows(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """A text's tokens in order, each with its segment, its place in the source, and the kind of gap after it (null at the end)."""
    for (some,) in _slices((x,) for x in texts):
        out = []
        for x in some:
            source = unified(x or "")
            of = tokens(source)
            out.append([{"segment": t.segment, "token": t.value, "start": t.start, "end": t.end, "gap": g} for t, g in zip(of, gaps(source, of), strict=True)])
        yield pa.array(out, _ROWS)


@arrow_udf(StringType())
def _fold_all(text: pa.Array) -> pa.Array:
    return pa.array([None if x is None else folded(x)[0] for x in text.to_pylist()], pa.string())


def fold(text: Column) -> Column:
    """The folded text; texts of ASCII alone never leave the JVM."""
    return F.coalesce(_fold_all(F.when(text.rlike(r"[^\x00-\x7f]"), text)), F.lower(text))


@arrow_udf(StringType())
def marked_text(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """marked() of each text; null counts as empty."""
    for (some,) in _slices((x,) for x in texts):
        yield pa.array([marked(source, tokens(source)) for source in (unified(x or "") for x in some)], pa.string())


def token_table(rows: DataFrame, key: str, kind: str, text: Column, ordinal: int = 0) -> DataFrame:
    """(key, field, ordinal, place, segment, token, start, end, gap): one row for each token of a field, in order of place."""
    t = rows.select(key, F.posexplode(token_rows(text)).alias("place", "t"))
    return t.select(key, F.lit(kind).alias("field"), F.lit(ordinal).alias("ordinal"), "place", "t.*")
