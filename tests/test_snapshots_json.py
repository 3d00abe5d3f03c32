"""JSON snapshots and input payloads."""

import hashlib
import json

from pyspark.sql import functions as F

from postmill.functions import snapshots_json
from postmill.operators import inputs


def test_canonical_text_and_hash():
    value = {"z": "last", "a": {"d": "x", "c": [1, 2], "б": 2, "г": 1}, "m": None, "t": True, "s": "café"}
    text = snapshots_json.canonical_text(snapshots_json.snapshot(json.dumps(value)))
    assert text == '{"a":{"c":[1,2],"d":"x","б":2,"г":1},"m":null,"s":"café","t":true,"z":"last"}'
    assert hashlib.sha256(text.encode()).hexdigest() == "e8cd063df400603dff20fc869bcb13c42d583156687799858b7def88f0ac7788"


def test_what_is_no_snapshot(spark):
    cases = {
        "": (None, "not_json"), "{": (None, "not_json"), "[1,]": (None, "not_json"), "[Infinity]": (None, "not_finite"), "[-Infinity, NaN]": (None, "not_finite"), "1e999": (None, "not_finite"), '{"a":1,"b":{"c":1,"c":1}}': (None, "doubled_key"),
        "[" * 101 + "]" * 101: (None, "too_deep"), "[" * 100_000: (None, "too_deep"), "[" * 100 + "]" * 100: ("[" * 100 + "]" * 100, None), '"\\ud800"': (None, "not_json"), '{"b": 1.50, "a": [true, null]}': ('{"a":[true,null],"b":1.5}', None),
        " 12 ": ("12", None), '"\\u00e9\\n"': ('"é\\n"', None), None: (None, None),
    }
    rows = spark.createDataFrame([(t,) for t in cases], "t string").select("t", snapshots_json.canonical(F.col("t")).alias("s"))
    assert {r["t"]: tuple(r["s"]) for r in rows.collect()} == cases


def test_payloads_are_canonical(spark):
    at = F.lit("2024-02-03 04:05:06.7").cast("timestamp")
    postings = spark.createDataFrame([(1, 5, True), (2, 6, None)], "posting_id long, current_version_id long, company_blocked boolean").select("*", F.when(F.col("posting_id") == 1, at).alias("closed_at"), at.alias("first_seen_at"), F.lit(None).cast("timestamp").alias("source_published_at"), F.lit("h" * 64).alias("content_hash"))
    actions = spark.createDataFrame([(1, 30, 5, "applied"), (1, 4, 5, "skipped"), (9, 1, 1, "skipped")], "posting_id long, digest_item_id long, score_posting_version_id long, state string")
    got = {r["posting_id"]: r for r in inputs.payloads(postings, actions, at, {"b": "é", "a": 1}, 'v"1').collect()}
    assert set(got) == {1, 2}
    for r in got.values():
        value = json.loads(r["payload"])
        assert snapshots_json.canonical_text(value) == r["payload"] and r["input_hash"] == hashlib.sha256(r["payload"].encode()).hexdigest()
        assert value["mutable_state_hash"] == hashlib.sha256(snapshots_json.canonical_text(value["mutable_state"]).encode()).hexdigest() == r["mutable_state_hash"]
        assert value["policy_version"] == 'v"1' and value["evaluation_as_of"] == "2024-02-03T04:05:06.700000Z" and value["policy_manifest_hash"] == r["policy_manifest_hash"]
    assert [a["digest_item_id"] for a in json.loads(got[1]["payload"])["mutable_state"]["action_state"]] == [4, 30] and json.loads(got[2]["payload"])["mutable_state"]["action_state"] == []


def test_shapes_of_payloads(spark):
    action = {"digest_item_id": 4, "posting_id": 1, "score_posting_version_id": 5, "state": "skipped"}
    state = {"action_state": [action, action | {"digest_item_id": 9}], "closed_at": None, "company_blocked": False, "current_version_id": 5, "first_seen_at": "t", "source_published_at": "t"}
    digest = lambda x: hashlib.sha256(snapshots_json.canonical_text(x).encode()).hexdigest()

    def payload(of=None, **other):
        s = state | (of or {})
        base = {"evaluation_as_of": "t", "mutable_state": s, "mutable_state_hash": digest(s), "policy_manifest": {"a": 1}, "policy_manifest_hash": digest({"a": 1}), "policy_version": "v", "posting_id": 1, "posting_version_content_hash": "0" * 64, "posting_version_id": 5, "schema_version": 1}
        return base | other

    cases = [
        (payload(), None), (payload({"action_state": []}), None), ([], "keys"), (payload(more=1), "keys"), (payload(posting_id=True), "ids"), (payload(posting_version_id=0), "ids"), (payload(schema_version=2), "texts"), (payload(policy_manifest=[]), "texts"),
        (payload(posting_version_content_hash="A" * 64), "hashes"), (payload({"company_blocked": 0}), "state"), (payload({"closed_at": 1}), "state"), (payload({"current_version_id": "5"}), "state"), (payload({"action_state": [action | {"state": "x"}]}), "actions"),
        (payload({"action_state": [action, action]}), "action_order"), (payload({"action_state": [action | {"digest_item_id": 9}, action]}), "action_order"), (payload(mutable_state_hash="0" * 64), "mutable_state_hash"), (payload(policy_manifest={"a": 2}), "policy_manifest_hash"),
    ]
    assert [inputs.shape_problem(p) for p, _ in cases] == [want for _, want in cases]
    texts = [snapshots_json.canonical_text(payload()), json.dumps(payload()), "{", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", inputs.payload_problem(F.col("t")).alias("p"))
    assert {r["i"]: r["p"] for r in rows.collect()} == {0: None, 1: "not_canonical", 2: "not_json", 3: "not_json"}
