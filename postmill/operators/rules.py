"""The nine eligibility rules over listings, from a policy that is data.

Every rule is evaluated for every listing; none stops the others. A listing is eligible if no rule rejects it, and
`unknown` never rejects. Title, description and location labels are fields, searched once for all phrases of the policy;
rules compare the spans that were found, and only fields that hold a phrase of a template are matched against its pattern.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import asdict, dataclass, field
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scopes
from ..functions.fields import Wanted, searched
from . import runs

# fixed values: the rules and their order
# and what an outcome rests on; where a status has several, the rule itself says which
RULES = ("title", "seniority", "discipline", "remote", "geography", "clearance", "stale", "actioned", "company")

EVIDENCE = {
    "title": {"pass": ("allowed_title_match",), "reject": ("allowed_title_absent",)},
    "seniority": {"pass": ("excluded_seniority_absent",), "reject": ("excluded_seniority_match",)},
    "discipline": {"pass": ("excluded_discipline_absent",), "reject": ("excluded_discipline_match",)},
    "remote": {"pass": ("remote_permitted",), "reject": ("attendance_required",), "unknown": ("remote_arrangement_unresolved",)},
    "geography": {"pass": ("us_not_excluded",), "reject": ("remote_scope_excludes_us",), "unknown": ("remote_geography_unresolved",)},
    "clearance": {"pass": ("active_clearance_not_required",), "reject": ("active_clearance_required",), "unknown": ("clearance_not_stated", "clearance_ambiguous")},
    "stale": {"pass": ("within_45_days",), "reject": ("older_than_45_days",)},
    "actioned": {"pass": ("no_qualifying_action",), "reject": ("prior_skipped", "prior_applied", "current_version_expired")},
    "company": {"pass": ("company_not_blocked",), "reject": ("company_blocked",)},
}


@dataclass(frozen=True)
class Policy:
    """Phrases are lower-case words with single blanks."""

    titles: tuple[str, ...]
    low_seniority: tuple[str, ...] = ()
    wrong_disciplines: tuple[str, ...] = ()
    discipline_pairs: tuple[tuple[str, str], ...] = ()
    remote: tuple[str, ...] = ("remote",)
    not_remote: tuple[str, ...] = ("hybrid", "on site", "onsite")
    remote_denied: tuple[str, ...] = ("not remote", "no remote")
    included_regions: tuple[str, ...] = ()
    excluded_regions: tuple[str, ...] = ()
    broad: tuple[str, ...] = ()
    named_inside: tuple[str, ...] = ()
    named_outside: tuple[str, ...] = ()
    #: The phrases that a list of named regions, and a broad region, may follow; those that begin with `remote` also make a remote scope.
    list_after: tuple[str, ...] = ()
    broad_after: tuple[str, ...] = ()
    included_codes: tuple[str, ...] = ("US",)
    clearance: tuple[str, ...] = ("security clearance",)
    #: Phrases before a clearance that oblige, that say it is absent, and that speak of obtaining it.
    clearance_obliged: tuple[str, ...] = ("must have", "requires")
    clearance_absent: tuple[str, ...] = ("without",)
    clearance_obtain: tuple[str, ...] = ("able to obtain",)
    max_age_days: int = 45
    notes: dict = field(default_factory=dict)

    def digest(self) -> str:
        """SHA-256 of the canonical JSON: any change of the policy changes it."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def wanted(p: Policy) -> tuple[Wanted, ...]:
    """The classes of phrases that the rules look for; where the rule asks only for presence, one span a field is enough."""
    named = [
        Wanted("titles", p.titles, ("title",), True), Wanted("low_seniority", p.low_seniority, ("title",), True), Wanted("wrong_disciplines", p.wrong_disciplines, ("title",), True),
        Wanted("remote", p.remote), Wanted("not_remote", p.not_remote, once=True), Wanted("remote_denied", p.remote_denied), Wanted("included", p.included_regions), Wanted("excluded", p.excluded_regions),
        Wanted("list_after", p.list_after, once=True), Wanted("broad_after", p.broad_after, once=True), Wanted("broad", p.broad, once=True), Wanted("clearance", p.clearance, once=True),
        Wanted("day", ("day", "days")), Wanted("number", tuple(NUMBERS)), Wanted("weekly", WEEKLY), Wanted("office", OFFICE), Wanted("home", ("home office",)), Wanted("called", (*OBLIGED, *PRESENT)),
    ]
    return (*named, *[Wanted(f"pair{i}{side}", (x,), ("title", "description")) for i, pair in enumerate(p.discipline_pairs) for side, x in zip("ab", pair, strict=True)])


class Found:
    """Columns over the array of spans, by the name of a class."""

    def __init__(self, spans: Column, classes: tuple[Wanted, ...]) -> None:
        self.spans, self.number = spans, {w.name: i for i, w in enumerate(classes)}

    def any(self, name: str) -> Column:
        return F.exists(self.spans, lambda s: s["of"] == self.number[name])

    def of(self, name: str) -> Column:
        return F.filter(self.spans, lambda s: s["of"] == self.number[name])

    def independent(self, name: str, longer: str) -> Column:
        """True if a span of the class lies inside none of the longer phrases of its field."""
        inside = lambda s, x: (x["field"] == s["field"]) & (x["first"] <= s["first"]) & (s["after"] <= x["after"])
        return scopes.let(self.of(longer), lambda around: F.exists(self.of(name), lambda s: ~F.exists(around, lambda x: inside(s, x))))

    def together(self, one: str, two: str) -> Column:
        """True if a segment holds a phrase of both classes as a whole."""
        return scopes.let(self.of(two), lambda others: F.exists(self.of(one), lambda a: a["whole"] & F.exists(others, lambda b: b["whole"] & _beside(a, b))))


def _beside(a: Column, b: Column) -> Column:
    return (a["field"] == b["field"]) & (a["segment"] == b["segment"])


def scoped(fields: Column, found: Found, p: Policy) -> Column:
    """struct(remote, listed, others, broad): a scope after `remote`; lists that include, lists that name others only, and a broad region, after any prefix.

    Only listings with a span of a prefix are matched. Lists count for each field.
    """
    each = lambda after: F.transform(fields, lambda f: scopes.named_scopes(f["marked"], p.named_inside, p.named_outside, after))
    broad = lambda after: F.exists(fields, lambda f: scopes.broad_scope(f["marked"], p.broad, after))
    none = F.array().cast("array<struct<included:boolean,excluded:boolean>>")
    lists = lambda after: F.when(found.any("list_after"), each(after)).otherwise(none)
    wide = lambda after: F.when(found.any("broad_after") & found.any("broad"), broad(after)).otherwise(F.lit(False))
    any_ = lambda of, x: F.exists(of, lambda n: n[x])
    remote = scopes.let(lists(_remote(p.list_after)), lambda of: any_(of, "included") | any_(of, "excluded")) | wide(_remote(p.broad_after))
    listed = scopes.let(lists(p.list_after), lambda of: F.struct(any_(of, "included").alias("included"), any_(of, "excluded").alias("excluded")))
    return scopes.let(listed, lambda x: F.struct(remote.alias("remote"), x["included"].alias("listed"), (x["excluded"] & ~x["included"]).alias("others"), wide(p.broad_after).alias("broad")))


def _remote(phrases: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(x for x in phrases if x.split()[0] == "remote")


# fixed values: the words by which days in an office each week are asked for
NUMBERS = "1 2 3 4 5 6 7 one two three four five six seven".split()
OBLIGED = "required must expected attendance".split()
WEEKLY = ("per week", "a week", "each week", "weekly")
OFFICE = ("office", "in office", "in the office", "onsite", "on site")
PRESENT = ("report to the office", "report onsite", "report on site")


def weekly_attendance(found: Found) -> Column:
    """True if a segment asks for a number of days in an office each week.

    Beside the word day or days, in the same segment: a number within two words, a weekly phrase that begins within four, an
    office phrase within eight (`home office` is none), and anywhere in the segment an obligation or a phrase of presence.
    """
    near = lambda d, s, reach: _beside(d, s) & (F.abs(s["first"] - d["first"]) <= reach)
    at_home = lambda s: (s["after"] - s["first"] == 1) & F.exists(found.of("home"), lambda h: (h["field"] == s["field"]) & (h["after"] == s["after"]))
    asks = F.exists(
        found.of("day"),
        lambda d: F.exists(found.of("number"), lambda s: near(d, s, 2)) & F.exists(found.of("weekly"), lambda s: s["whole"] & near(d, s, 4))
        & F.exists(found.of("office"), lambda s: near(d, s, 8) & ~at_home(s)) & F.exists(found.of("called"), lambda s: s["whole"] & _beside(d, s)),
    )
    return F.when(found.any("day") & found.any("weekly") & found.any("office"), asks).otherwise(F.lit(False))


def remote_rule(found: Found, scope: Column, workplace: Column) -> Column:
    """The first that holds: attendance rejects; a denial beside an independent positive is unknown; a denial rejects; a positive or a scoped remote passes; else unknown."""
    place = F.lower(F.coalesce(workplace, F.lit("")))
    # a positive inside a denial is no positive of its own
    own = found.independent("remote", "remote_denied") | (place == "remote")
    return (
        F.when(place.isin("hybrid", "on-site", "onsite") | found.any("not_remote") | weekly_attendance(found), "reject").when(found.any("remote_denied") & own, "unknown")
        .when(found.any("remote_denied"), "reject").when(own | scope["remote"], "pass").otherwise("unknown")
    )


def geography_rule(found: Found, scope: Column, codes: Column, remote: Column, p: Policy) -> Column:
    """Rejects only where the remote rule passed: an exclusion, or codes none of which is included, with nothing that includes.

    A broad scope passes unless a phrase excludes, whatever the codes. An inclusion inside an exclusion is none. Scopes
    count for each field; over all fields an inclusion outweighs the lists that name others only.
    """
    excluded = found.any("excluded")
    inside = F.exists(codes, lambda c: F.upper(c).isin(*p.included_codes)) | found.independent("included", "excluded") | scope["listed"]
    outside = excluded | F.exists(codes, lambda c: c.rlike("^[A-Za-z]{2}$") & ~F.upper(c).isin(*p.included_codes)) | scope["others"]
    sides = F.struct(inside.alias("inside"), outside.alias("outside"))
    decide = lambda x: F.when(x["inside"] & x["outside"], "unknown").when(x["inside"] | (scope["broad"] & ~excluded), "pass").when(x["outside"] & (remote == "pass"), "reject").otherwise("unknown")
    return scopes.let(sides, decide)


def clearance_rule(fields: Column, found: Found, p: Policy) -> Column:
    """(status, evidence). Obligations reject, waivers pass, both together are unknown; an obligation inside a waiver is none.

    Obligations: an obliging phrase, an article or none, and a clearance; or a clearance that `is required`. Waivers: one that is
    preferred or not required; `no` or a phrase of absence before one that is required; `does not require` one; a phrase of
    obtaining one. Each is one pattern over a field's words, and what a waiver would contain is excluded by looking around.
    """
    if not p.clearance:
        return F.struct(F.lit("unknown").alias("status"), F.lit("clearance_not_stated").alias("evidence"))
    some = lambda xs: "(?:" + "|".join(map(re.escape, sorted(xs, key=len, reverse=True))) + ")"
    # fixed values: the templates' words
    what, article, required = some(p.clearance), " (?:(?:a|an|the) )?", " (?:is )?required(?= )"
    refuse = "does not require"
    absent = [x for x in p.clearance_absent if x != refuse]
    waivers = [f" {what} (?:is )?(?:preferred|not required)(?= )", f" no {what}{required}", f" {refuse}{article}{what}(?= )"]
    waivers += [f" {some(absent)}{article}{what}{required}"] if absent else []
    waivers += [f" {some(p.clearance_obtain)}{article}{what}(?= )"] if p.clearance_obtain else []
    must = []
    for c in map(re.escape, p.clearance):
        # a phrase may lie inside a longer one: what the longer one has before and after it belongs to a waiver too
        lead = "|".join(q[: -len(c)].rstrip("\\ ") for q in map(re.escape, p.clearance) if q.endswith("\\ " + c))
        tail = "|".join(q[len(c) :] for q in map(re.escape, p.clearance) if q.startswith(c + "\\ "))
        lead, tail = f"(?: (?:{lead}))?" if lead else "", f"(?:{tail})?" if tail else ""
        for x in p.clearance_obliged:
            inside = lambda longer: [y[: -len(x)].strip() for y in longer if y == x or y.endswith(" " + x)]  # noqa: B023, E731
            always, if_required = inside((refuse, *p.clearance_obtain)), inside(absent)
            free = "".join(f"(?<! {re.escape(y)})" if y else "(?!)" for y in always)
            form = f"{free} {re.escape(x)}{article}{c}(?= )"
            needs = "".join(f"(?<! {re.escape(y)})" if y else "(?!)" for y in if_required)
            must.append(f"(?:{form}(?!{tail}{required})|{needs}{form})" if if_required else form)
        behind = f"(?<! no{lead})" + (f"(?<! {some(absent)}(?: (?:a|an|the))?{lead})" if absent else "")
        must.append(f"{behind} {c}{required}")
    holds = lambda patterns: F.exists(fields, lambda f: f["words"].rlike("|".join(patterns)))
    said = lambda status, i=0: F.struct(F.lit(status).alias("status"), F.lit(EVIDENCE["clearance"][status][i]).alias("evidence"))
    both = lambda x: F.when(x["must"] & x["waived"], said("unknown", 1)).when(x["must"], said("reject")).when(x["waived"], said("pass")).otherwise(said("unknown"))
    return F.when(found.any("clearance"), scopes.let(F.struct(holds(must).alias("must"), holds(waivers).alias("waived")), both)).otherwise(said("unknown"))


def evaluate(listings: DataFrame, policy: Policy, as_of: Column) -> DataFrame:
    """posting_id, eligible, rejections, unknowns, outcomes (nine of rule, status, evidence, in order), error, policy_hash.

    listings: posting_id, title, description, country_codes, workplace, published_at, first_seen_at, action,
    company_blocked, and `labels`, an array of location labels, if there are any. A date after as_of is an invalid input:
    `error` says so and eligible is null.
    """
    classes = wanted(policy)
    labels = F.col("labels") if "labels" in listings.columns else F.lit(None).cast("array<string>")
    t = listings.withColumn("search", searched(F.col("title"), F.col("description"), labels, classes)).withColumn("fields", F.col("search.fields")).withColumn("spans", F.col("search.spans"))
    fields, hits = F.col("fields"), Found(F.col("spans"), classes)
    verdict = lambda bad, good="pass": F.when(bad, "reject").otherwise(good)
    pairs = reduce(or_, [hits.together(f"pair{i}a", f"pair{i}b") for i in range(len(policy.discipline_pairs))], F.lit(False))
    t = t.withColumn("scope", scoped(fields, hits, policy)).withColumn("remote", remote_rule(hits, F.col("scope"), F.col("workplace"))).withColumn("clearance", clearance_rule(fields, hits, policy))
    age = runs.staleness(F.col("published_at"), F.col("first_seen_at"), as_of, policy.max_age_days)
    found = {
        "title": verdict(~hits.any("titles")), "seniority": verdict(hits.any("low_seniority")), "discipline": verdict(hits.any("wrong_disciplines") | pairs), "remote": F.col("remote"),
        "geography": geography_rule(hits, F.col("scope"), F.coalesce("country_codes", F.array().cast("array<string>")), F.col("remote"), policy), "clearance": F.col("clearance.status"),
        "stale": age, "actioned": verdict(F.coalesce(F.col("action") != "none", F.lit(False))), "company": verdict(F.coalesce("company_blocked", F.lit(False))),
    }
    named_by = {"clearance": F.col("clearance.evidence")}
    prior = F.get(F.array(*map(F.lit, EVIDENCE["actioned"]["reject"])), F.array_position(F.array(*map(F.lit, ("skipped", "applied", "expired"))), F.col("action")).cast("int") - 1)
    for r in RULES[:-3] + RULES[-1:]:
        if r != "clearance":
            named_by[r] = F.create_map(*[F.lit(x) for st, e in EVIDENCE[r].items() for x in (st, e[0])])[found[r]]
    named_by["stale"] = F.when(found["stale"] == "pass", EVIDENCE["stale"]["pass"][0]).when(found["stale"] == "reject", EVIDENCE["stale"]["reject"][0])
    named_by["actioned"] = F.when(found["actioned"] == "reject", prior).otherwise(EVIDENCE["actioned"]["pass"][0])
    t = t.select("posting_id", F.array(*[F.struct(F.lit(r).alias("rule"), found[r].alias("status"), named_by[r].alias("evidence")) for r in RULES]).alias("outcomes"))
    named = lambda s: F.transform(F.filter("outcomes", lambda o: o["status"] == s), lambda o: o["rule"])
    error = F.when(F.size(named("invalid")) > 0, "invalid_date")
    return t.select(
        "posting_id", F.when(error.isNull(), F.size(named("reject")) == 0).alias("eligible"), named("reject").alias("rejections"), named("unknown").alias("unknowns"), "outcomes",
        error.alias("error"), F.lit(policy.digest()).alias("policy_hash"),
    )
