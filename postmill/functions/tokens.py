"""Tokens, segments and phrases, as higher-order array expressions over one row's text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fields

TOKEN = r"[\p{L}\p{N}]+(?:'[\p{L}\p{N}]+)*"
#: Paragraph breaks first, then runs of sentence marks.
BOUNDARY = r"\n(?:[^\S\n]*\n)+|[.!?。！？]+"


def tokens(text: Column) -> Column:
    """Folded runs of letters and digits; inner apostrophes are taken out."""
    return words(fields.fold(text))


def words(folded: Column) -> Column:
    """The tokens of a text that is folded already."""
    return F.transform(F.regexp_extract_all(folded, F.lit(TOKEN), F.lit(0)), lambda t: F.replace(t, F.lit("'"), F.lit("")))


def segments(text: Column) -> Column:
    """Non-blank parts between boundaries, in order."""
    return F.filter(F.split(F.regexp_replace(text, r"\r\n?", "\n"), BOUNDARY), lambda s: F.btrim(F.regexp_replace(s, r"\s+", " ")) != "")


def padded(words: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def has_phrase(words: Column, phrase: str) -> Column:
    """True if the words of phrase follow each other in the array of words."""
    return F.contains(padded(words), F.lit(f" {phrase} "))


def any_phrase(words: Column, phrases: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | has_phrase(words, p)
    return out


def segments_with(text: Column, phrase: str) -> Column:
    """Numbers of the segments that hold the phrase, among those with tokens."""
    parts = F.split(fields.marked_text(text), r" \. ")
    return F.filter(F.transform(parts, lambda s, i: F.when(F.contains(F.concat(F.lit(" "), F.regexp_replace(s, " [,;/|] ", " "), F.lit(" ")), F.lit(f" {phrase} ")), i)), lambda i: i.isNotNull())


def same_segment(text: Column, one: str, two: str) -> Column:
    return F.arrays_overlap(segments_with(text, one), segments_with(text, two))


def places(words: Column, phrase: str) -> Column:
    """First places of the phrase among the words."""
    want = phrase.split()
    last = F.size(words) - len(want) + 1
    spots = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    hit = lambda i: F.array_join(F.slice(words, i, len(want)), " ") == phrase
    return F.filter(spots, hit)


def near(words: Column, one: str, two: str, reach: int) -> Column:
    """True if the phrases begin at most `reach` words apart. Both lists of places are made once, not once for each pair."""
    around = F.flatten(F.transform(places(words, one), lambda a: F.sequence(a - reach, a + reach)))
    return F.arrays_overlap(around, places(words, two))


def unsuppressed(words: Column, phrase: str, longer: tuple[str, ...]) -> Column:
    """Places of the phrase that no place of a longer phrase contains."""
    out, want = places(words, phrase), phrase.split()
    for p in longer:
        has = p.split()
        at = [i for i in range(len(has) - len(want) + 1) if has[i : i + len(want)] == want]
        if at:
            out = F.array_except(out, F.flatten(_shifted(places(words, p), at)))
    return out


def _shifted(spots: Column, by: list[int]) -> Column:
    return F.transform(spots, lambda b: F.array(*[b + i for i in by]))


def gap(between: Column) -> Column:
    """The kind of what lies between two tokens."""
    return (
        F.when(between.rlike(r"\n[^\S\n]*\n"), "paragraph").when(between.rlike(r"[.!?。！？]"), "sentence").when(between.contains(","), "comma")
        .when(between.contains(";"), "semicolon").when(between.rlike(r"[/\\]"), "slash").when(between.rlike(r"^\s+$"), "whitespace").otherwise("other")
    )
