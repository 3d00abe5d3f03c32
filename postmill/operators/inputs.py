"""What an evaluation was made of: the mutable state with its action facts, the payload, and their four hashes."""

from __future__ import annotations

import hashlib
import re
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import StringType

from ..functions import canonical as C
from ..functions.snapshots_json import Refused, canonical_text, snapshot

SCHEMA_VERSION = 1


def mutable_states(postings: DataFrame, actions: DataFrame) -> DataFrame:
    """(posting_id, mutable_state, mutable_state_hash): canonical JSON of what may change beside a listing's version.

    postings: posting_id, current_version_id, closed_at, company_blocked, first_seen_at, source_published_at. actions: posting_id,
    digest_item_id (once each), score_posting_version_id, state. A listing's actions are those of its readers, so they are
    few; they are listed by item. The hash is that of the text, so it needs them together.
    """
    fact = F.struct("digest_item_id", "posting_id", "score_posting_version_id", "state")
    listed = actions.groupBy(F.col("posting_id").alias("of")).agg(F.array_sort(F.collect_list(fact)).alias("action_state"))
    p = postings.join(listed, F.col("posting_id") == F.col("of"), "left")
    none = F.array().cast(listed.schema["action_state"].dataType)
    state = C.canonical_json(
        action_state=F.coalesce("action_state", none), closed_at=C.rfc3339(F.col("closed_at")), company_blocked=F.col("company_blocked"), current_version_id=F.col("current_version_id"),
        first_seen_at=C.rfc3339(F.col("first_seen_at")), source_published_at=C.rfc3339(F.col("source_published_at")),
    )
    return p.select("posting_id", state.alias("mutable_state")).withColumn("mutable_state_hash", F.sha2("mutable_state", 256))


def payloads(postings: DataFrame, actions: DataFrame, as_of: Column, policy: dict, policy_version: str) -> DataFrame:
    """(posting_id, payload, mutable_state_hash, policy_manifest_hash, posting_version_content_hash, input_hash).

    postings: as mutable_states() has them, with content_hash. The payload is canonical JSON that holds the policy and the
    mutable state whole; the input's hash is that of the payload.
    """
    states = mutable_states(postings, actions)
    manifest = F.lit(canonical_text(policy))
    p = postings.select("posting_id", F.col("current_version_id").alias("version"), "content_hash").join(states, "posting_id").withColumn("policy_manifest_hash", F.sha2(manifest, 256))
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    parts = {
        "evaluation_as_of": text(C.rfc3339(as_of)), "mutable_state": F.col("mutable_state"), "mutable_state_hash": text(F.col("mutable_state_hash")), "policy_manifest": manifest, "policy_manifest_hash": text(F.col("policy_manifest_hash")),
        "policy_version": F.lit(canonical_text(policy_version)), "posting_id": F.col("posting_id").cast("string"), "posting_version_content_hash": text(F.col("content_hash")), "posting_version_id": F.col("version").cast("string"),
        "schema_version": F.lit(str(SCHEMA_VERSION)),
    }
    payload = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), parts[k]) for k in sorted(parts)]), F.lit("}"))
    p = p.withColumn("payload", payload).withColumn("input_hash", F.sha2("payload", 256))
    return p.select("posting_id", "payload", "mutable_state_hash", "policy_manifest_hash", F.col("content_hash").alias("posting_version_content_hash"), "input_hash")


# fixed values: the keys of a payload, of its mutable state and of an action, and the states of actions
PAYLOAD_KEYS = "evaluation_as_of mutable_state mutable_state_hash policy_manifest policy_manifest_hash policy_version posting_id posting_version_content_hash posting_version_id schema_version".split()
STATE_KEYS = "action_state closed_at company_blocked current_version_id first_seen_at source_published_at".split()
ACTION_KEYS = "digest_item_id posting_id score_posting_version_id state".split()
ACTION_STATES = ("skipped", "applied", "expired")

_HASH = re.compile(r"[0-9a-f]{64}\Z")


def _id(x: Any) -> bool:
    return type(x) is int and x > 0


def _shaped(x: Any, keys: list[str]) -> bool:
    return isinstance(x, dict) and sorted(x) == keys


def shape_problem(payload: Any) -> str | None:
    """The first way in which a parsed payload isn't one: its keys, ids, texts, hashes, state, actions, or a hash that isn't its part's."""
    if not _shaped(payload, PAYLOAD_KEYS):
        return "keys"
    if not (_id(payload["posting_id"]) and _id(payload["posting_version_id"])):
        return "ids"
    if payload["schema_version"] != SCHEMA_VERSION or not isinstance(payload["evaluation_as_of"], str) or not isinstance(payload["policy_version"], str) or not isinstance(payload["policy_manifest"], dict):
        return "texts"
    if not all(isinstance(payload[k], str) and _HASH.match(payload[k]) for k in PAYLOAD_KEYS if k.endswith("_hash")):
        return "hashes"
    state = payload["mutable_state"]
    if not _shaped(state, STATE_KEYS) or not _id(state["current_version_id"]) or not isinstance(state["company_blocked"], bool) or not isinstance(state["first_seen_at"], str):
        return "state"
    if not all(state[k] is None or isinstance(state[k], str) for k in ("closed_at", "source_published_at")):
        return "state"
    actions = state["action_state"]
    sound = lambda a: _shaped(a, ACTION_KEYS) and all(_id(a[k]) for k in ACTION_KEYS[:3]) and a["state"] in ACTION_STATES
    if not isinstance(actions, list) or not all(map(sound, actions)):
        return "actions"
    items = [a["digest_item_id"] for a in actions]
    if items != sorted(set(items)):
        return "action_order"
    for part in ("mutable_state", "policy_manifest"):
        if hashlib.sha256(canonical_text(payload[part]).encode()).hexdigest() != payload[f"{part}_hash"]:
            return f"{part}_hash"
    return None


@arrow_udf(StringType())
def payload_problem(text: pa.Array) -> pa.Array:
    """Why a stored payload is none: no snapshot, no canonical text, or the first problem of its shape; null for a sound one. A null text is no snapshot."""

    def problem(x: str | None) -> str | None:
        try:
            value = snapshot(x or "")
        except Refused as why:
            return str(why)
        return shape_problem(value) or (None if canonical_text(value) == x else "not_canonical")

    return pa.array([problem(x) for x in text.to_pylist()], pa.string())
