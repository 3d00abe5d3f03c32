"""Toxicity by a weighted finite-state pattern grammar.

Six small transducers, each a table of states and symbols, are composed once into one machine: a lexical one rewrites each
word as a symbol (INSULT or THREAT with a weight, TARGET whom it is aimed at, NEGATION, REPORT of others' speech, END of
a clause, or nothing); those of target, negation and report remember how far back such a word lies or whether there was
one; those of insult and threat hold a hit until a target can no longer follow it. A state of the composed machine is a
state of each. Where a hit is settled, the machine emits the pattern that its state names: aimed, plain, negated or
reported. A clause's match is the heaviest weight of each pattern in it, and a text is scored by its clauses: for each
pattern the sum over clauses and the heaviest one.

The insult and threat vocabulary, by word stems, is learned from one part of the labelled rows, the weights of the
patterns by logistic regression on another part. Nothing but the text enters a score. A hit with no other word of the
grammar in its clause matches the plain pattern; how much that says is learned like the other weights.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

#: Labelled rows used at most, those of least hash, which also bounds the lexicon; the score from which a text counts as toxic.
MAX_LABELLED, THRESHOLD = 30_000, 0.3
#: REACH: words over which a target or negation before a hit acts on it; AFTER: words within which a target may follow it.
STEM, LEAST_DOCS, LEAST_ODDS, REACH, AFTER = 5, 3, 2.5, 4, 2
# fixed values: closed word classes of the four languages
TARGETS = "you your youre he she they them him her u du dich dir ihr euch er sie tu te toi vous il elle ils elles usted ustedes tú ti él ella ellos vosotros".split()
NEGATIONS = "not no never neither nor isnt arent wasnt dont doesnt nicht kein keine keinen nie niemals ne pas jamais aucun aucune ni nunca jamás tampoco ningún ninguna".split()
REPORTS = "said says say told wrote writes called claims claimed quoted according sagte sagt schrieb nannte behauptet laut dit disait écrit appelé selon dijo dice escribió llamó según".split()
THREATS = "kill hurt destroy beat punch shoot stab burn töten schlagen verletzen vernichten tuer frapper blesser détruire matar golpear herir destruir".split()
NOTHING, TARGET, NEGATION, REPORT, INSULT, THREAT, END = range(7)
PATTERNS = tuple(f"{k}_{s}" for k in ("insult", "threat") for s in ("plain", "aimed", "negated", "reported"))
MARKS = ".,;:!?\"'()[]{}#*$%&|<>-_~`“”„«»¿¡"
END_MARKS = ".!?;"


class Mark(NamedTuple):
    """What passes from one transducer to the next: a word's symbol, what lies before it, and the pattern that it settles."""

    word: int
    target: bool = False
    negation: bool = False
    report: bool = False
    found: int | None = None


#: next state and what is written, by state and what is read; state 0 is a clause's begin.
Table = dict[int, dict[Mark, tuple[int, Mark]]]


def since(symbol: int, reach: int, name: str, alphabet: set[Mark]) -> Table:
    """Writes whether the symbol lies at most `reach` words back; the state is how many words ago it was, 0 if farther or never."""
    back = lambda s, x: 1 if x == symbol else 0 if x == END or not 0 < s < reach else s + 1
    return {s: {m: (back(s, m.word), m._replace(**{name: s > 0})) for m in alphabet} for s in range(reach + 1)}


def seen(symbol: int, name: str, alphabet: set[Mark]) -> Table:
    """Writes whether the clause has had the symbol, which is also the state."""
    return {s: {m: (int(m.word == symbol or (s == 1 and m.word != END)), m._replace(**{name: s == 1})) for m in alphabet} for s in range(2)}


def settling(symbol: int, patterns: int, alphabet: set[Mark]) -> Table:
    """Holds a hit of the symbol until a target can no longer follow it, then writes its pattern, numbered from `patterns` on.

    State 0 holds nothing, 1 + AFTER * mode + words since a hit. A hit is settled AFTER words later, by the next hit or when
    the clause ends: as reported or negated by what lay before it, else as aimed if a target came before or since.
    """

    def step(s: int, m: Mark) -> tuple[int, Mark]:
        if s:
            mode, age = divmod(s - 1, AFTER)
            mode = 1 if m.word == TARGET and mode == 0 else mode
            if m.word in (INSULT, THREAT, END) or age + 1 >= AFTER:
                s, m = 0, m._replace(found=patterns + mode)
            else:
                s = 1 + AFTER * mode + age + 1
        if m.word == symbol:
            s = 1 + AFTER * (3 if m.report else 2 if m.negation else 1 if m.target else 0)
        return s, m

    return {s: {m: step(s, m) for m in alphabet} for s in range(1 + 4 * AFTER)}


def written(table: Table) -> set[Mark]:
    return {out for row in table.values() for _, out in row.values()}


def compose(first: Table, second: Table) -> Table:
    """The transducer that reads what the first reads and writes what the second makes of the first's writing."""
    states, order, out = {(0, 0): 0}, [(0, 0)], {}
    for a, b in order:  # grows while it is read
        row = out[len(out)] = {}
        for m, (a2, between) in first[a].items():
            b2, last = second[b][between]
            if (a2, b2) not in states:
                states[a2, b2] = len(order)
                order.append((a2, b2))
            row[m] = states[a2, b2], last
    return out


def machine() -> tuple[list[list[int]], list[list[tuple[int, ...]]]]:
    """The composed machine: next[state][symbol] and the patterns emitted there, state 0 at a clause's begin."""
    whole = since(TARGET, REACH, "target", {Mark(x) for x in range(7)})
    for step in (
        lambda marks: since(NEGATION, REACH, "negation", marks), lambda marks: seen(REPORT, "report", marks),
        lambda marks: settling(INSULT, 0, marks), lambda marks: settling(THREAT, 4, marks),
    ):
        whole = compose(whole, step(written(whole)))
    rows = [[row[Mark(x)] for x in range(7)] for row in whole.values()]
    return [[s for s, _ in row] for row in rows], [[() if m.found is None else (m.found,) for _, m in row] for row in rows]


NEXT, EMITTED = machine()


class Lexicon(dict):
    """The lexical transducer: words to (symbol, weight, whether the clause ends there), remembered until a bound."""

    def __init__(self, stems: dict[str, float]):
        super().__init__()
        self.stems = stems
        self.closed = {w: k for k, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS)) for w in ws}

    def __missing__(self, word: str) -> tuple[int, float, bool]:
        if len(self) > 400_000:
            self.clear()
        bare = word.strip(MARKS)
        tail = word[len(word.rstrip(MARKS)) :]
        weight = max(self.stems.get(bare, 0.0), self.stems.get(bare[:STEM] + "*", 0.0))
        symbol = INSULT if weight > 0 else self.closed.get(bare.replace("'", ""), NOTHING)
        out = self[word] = (symbol, weight if weight > 0 else 1.0, any(m in tail for m in END_MARKS))
        return out


def clauses(text: str | None, lexicon: Lexicon) -> list[dict[int, float]]:
    """The matched clauses of text: for each the patterns that the machine emitted in it, with the heaviest weight of each."""
    words = (text or "").lower().replace("\n", " . ").split()
    symbols = [lexicon[w] for w in words]
    if not any(INSULT <= s[0] for s in symbols):
        return []
    out: list[dict[int, float]] = []
    found: dict[int, float] = {}
    state, held = 0, 0.0
    for symbol, weight, ends in [*symbols, (NOTHING, 0.0, True)]:
        for x in (symbol, END) if ends else (symbol,):
            for k in EMITTED[state][x]:
                found[k] = max(found.get(k, 0.0), held)
            if x == INSULT or x == THREAT:
                held = weight
            state = NEXT[state][x]
        if ends and found:
            out.append(found)
            found = {}
    return out


def emissions(text: str | None, lexicon: Lexicon) -> np.ndarray:
    """For each pattern the sum of its clauses' weights, by logarithm, and the heaviest clause; last, whether any matched."""
    out = np.zeros(2 * len(PATTERNS) + 1)
    for match in clauses(text, lexicon):
        for k, weight in match.items():
            out[k] += weight
            out[len(PATTERNS) + k] = max(out[len(PATTERNS) + k], weight)
        out[-1] = 1.0
    out[: len(PATTERNS)] = np.log1p(out[: len(PATTERNS)])
    return out


def part(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(4))


def learned_stems(texts: DataFrame) -> dict[str, float]:
    """Stems and words that toxic texts hold far oftener than others, with their log odds; from (text, toxic)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stems, toxic = [], []
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = {w.strip(MARKS) for w in (text or "").lower().split()}
                own = {w for w in words if w} | {w[:STEM] + "*" for w in words if len(w) >= STEM}
                stems += own
                toxic += [y] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array(toxic, pa.int64())], ["stem", "toxic"])

    counts = texts.mapInArrow(emit, "stem string, toxic long").groupBy("stem").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    total = texts.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    if not total["n"] or not total["t"]:
        return {}
    base = math.log((total["t"] + 1) / (total["n"] - total["t"] + 1))
    odds = F.log((F.col("t") + 0.1) / (F.col("n") - F.col("t") + 0.1)) - base
    best = counts.where(F.col("t") >= LEAST_DOCS).withColumn("odds", odds).where((F.col("odds") >= LEAST_ODDS) & (F.col("t") >= 0.8 * F.col("n")))
    return {r["stem"]: r["odds"] for r in best.collect()}  # of MAX_LABELLED rows


def fitted(x: np.ndarray, y: np.ndarray, ridge: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton steps, halved until they lower the loss (whole ones may run away); the last weight is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    loss = lambda w: float(np.sum(np.logaddexp(0, x @ w) - y * (x @ w)) + ridge / 2 * w @ w)
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        grade = x.T @ (p - y) + ridge * w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), grade)
        part, before = 1.0, loss(w)
        while part > 1e-9 and loss(w - part * step) > before - 1e-4 * part * float(grade @ step):
            part /= 2
        if part <= 1e-9 or float(grade @ step) < 1e-10:
            break
        w = w - part * step
    return w


class Grammar:
    """A lexicon and the weights of its patterns; learned once, sent to the tasks."""

    def __init__(self, stems: dict[str, float], weights: np.ndarray):
        self.stems, self.weights = stems, weights

    @classmethod
    def learn(cls, docs: DataFrame, labels: DataFrame) -> Grammar:
        """From the labelled rows whose part is not 2: stems from parts 0 and 1, pattern weights from part 3."""
        known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (part(F.col("doc_id")) != 2))
        known = known.groupBy(F.col("doc_id").alias("of")).agg(F.max("toxic").cast("long").alias("toxic")).orderBy(F.xxhash64("of"), "of").limit(MAX_LABELLED)
        rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("of"))  # MAX_LABELLED rows
        rows = stored(rows.select("text", "toxic", part(F.col("doc_id")).alias("part")), "toxic")
        stems = learned_stems(rows.where("part < 2").select("text", "toxic"))
        found = rows.where("part = 3").select("text", "toxic").mapInArrow(_emitted(stems), "toxic long, x array<double>").toArrow()
        y = found.column("toxic").to_numpy().astype(float)
        x = np.array(found.column("x").to_pylist(), dtype=float).reshape(len(y), 2 * len(PATTERNS) + 1)
        return cls(stems, fitted(x, y) if len(y) else np.append(np.zeros(2 * len(PATTERNS) + 1), -3.0))

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, score) for every row; null and empty texts get the score of a text without any pattern.

        Rows of one id are scored each by its own text, equal texts alike; texts of any length are read whole; other columns
        are not read. An empty table gives an empty result.
        """
        sent = docs.sparkSession.sparkContext.broadcast((self.stems, self.weights))

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            stems, w = sent.value
            lexicon = Lexicon(stems)
            for batch in batches:
                x = np.array([emissions(t.as_py(), lexicon) for t in batch.column(1)]).reshape(-1, len(w) - 1)
                score = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

        return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_col).mapInArrow(emit, "doc_id long, score double")


def _emitted(stems: dict[str, float]):
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(stems)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([emissions(t.as_py(), lexicon).tolist() for t in batch.column(0)], pa.list_(pa.float64()))], ["toxic", "x"])

    return emit


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = Grammar.learn(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", (part(F.col("doc_id")) == 2).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
