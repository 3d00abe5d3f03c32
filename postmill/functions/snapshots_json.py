"""JSON snapshots: strict parsing and the canonical text of nested values."""

from __future__ import annotations

import json
from typing import Any

import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType, StructType

#: Levels of nesting that a snapshot may have.
MOST_DEPTH = 100


class Refused(ValueError):
    """Why a text is no snapshot."""


def _once(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise Refused("doubled_key")
    return out


def _constant(_: str) -> None:
    raise Refused("not_finite")


def _float(text: str) -> float:
    value = float(text)
    if value in (float("inf"), float("-inf")):
        raise Refused("not_finite")
    return value


def _depth(value: Any) -> int:
    """The levels of a value, without recursion."""
    level, deepest = [value], 0
    while level:
        nested = [v for v in level if isinstance(v, (list, dict))]
        deepest += bool(nested)
        level = [x for v in nested for x in (v.values() if isinstance(v, dict) else v)]
    return deepest


def snapshot(text: str) -> Any:
    """The value of a JSON text; Refused says why there is none."""
    try:
        value = json.loads(text, object_pairs_hook=_once, parse_constant=_constant, parse_float=_float)
    except Refused:
        raise
    except RecursionError:
        raise Refused("too_deep") from None
    except ValueError:
        raise Refused("not_json") from None
    if _depth(value) > MOST_DEPTH:
        raise Refused("too_deep")
    return value


def canonical_text(value: Any) -> str:
    """Keys in code point order at all depths, no blanks, characters as they are."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


@arrow_udf(StructType().add("canonical", StringType()).add("problem", StringType()))
def canonical(text: pa.Array) -> pa.Array:
    """struct(canonical, problem) of each JSON text: its canonical text, or why it is no snapshot (a null text is neither).

    Problems: not_json (half of a character pair counts as such), not_finite, doubled_key, too_deep.
    """
    texts: list[str | None] = []
    problems: list[str | None] = []
    for x in text.to_pylist():
        out = problem = None
        if x is not None:
            try:
                out = canonical_text(snapshot(x))
                out.encode()
            except Refused as why:
                out, problem = None, str(why)
            except UnicodeEncodeError:
                out, problem = None, "not_json"
        texts.append(out)
        problems.append(problem)
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(problems, pa.string())], ["canonical", "problem"])
