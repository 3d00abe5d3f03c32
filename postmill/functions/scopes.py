"""Lists of named regions after a phrase such as `remote in`, found by one pattern over a field's marked text (fields.marked)."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A gap within a segment, as the marked text has it.
GAP = r"(?: | [,;/|] )"
def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once: an expression that occurs twice in lambdas would be computed twice."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _words(phrases: tuple[str, ...]) -> str:
    longest_first = sorted(phrases, key=lambda p: (-len(p.split()), p))
    return "(?:" + "|".join(GAP.join(map(re.escape, p.split())) for p in longest_first) + ")"


def broad_scope(marked: Column, broad: tuple[str, ...], after: tuple[str, ...]) -> Column:
    """True if a broad region follows one of the prefixes `after`, with one connector between or none, all in one segment."""
    if not broad or not after:
        return F.lit(False)
    return F.coalesce(marked, F.lit("")).rlike(rf"(?:^| ){_words(after)}(?:{GAP}(?:in|within|across|throughout|from))?{GAP}{_words(broad)}(?: |$)")


def named_scopes(marked: Column, inside: tuple[str, ...], outside: tuple[str, ...], after: tuple[str, ...]) -> Column:
    """struct(included, excluded): whether a list names a region of `inside`; whether lists name only regions of `outside`.

    A list follows one of the prefixes `after` in the same segment. Items are separated by a comma, semicolon or slash, with `and`
    or `or` or without, or by `and` or `or` alone; anything else after an item in the segment voids the whole list. Of each
    prefix the first list that holds counts. Null text and no regions: neither.
    """
    if not after or not inside and not outside:
        return F.struct(F.lit(False).alias("included"), F.lit(False).alias("excluded"))
    item, ands = _words((*inside, *outside)), "(?:and|or)"
    separator = rf"(?: [,;/] (?:{ands} )?| {ands} )"
    end = rf"(?=$| \.|(?: | [,;/] ){ands}(?:$| [.,;/|]))"
    found = rf"(?<=^| ){_words(after)}{GAP}{item}(?:{separator}{item})*{end}"
    prefix = lambda x: F.regexp_replace(F.regexp_extract(x, rf"^{_words(after)}", 0), r" [,;/|] ", " ")
    whole = lambda phrases: rf"(?:^| ){_words(phrases)}(?: |$)"

    def of_firsts(lists: Column) -> Column:
        named = F.transform(lists, lambda x: F.regexp_replace(x, rf"^{_words(after)}{GAP}", ""))
        has = lambda phrases: F.exists(named, lambda x: x.rlike(whole(phrases))) if phrases else F.lit(False)
        return let(has(inside), lambda included: F.struct(included.alias("included"), (has(outside) & ~included).alias("excluded")))

    firsts = lambda lists, prefixes: F.filter(lists, lambda x, i: F.array_position(prefixes, F.get(prefixes, i)) == i + 1)
    found = F.regexp_extract_all(F.coalesce(marked, F.lit("")), F.lit(found), F.lit(0))
    return let(found, lambda lists: let(F.transform(lists, prefix), lambda prefixes: let(firsts(lists, prefixes), of_firsts)))
