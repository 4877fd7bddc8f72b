"""Toxicity: a weighted finite-state grammar of clauses, with weights learned from labels.

Words become symbols (insult, threat, target, negation, report) and a clause runs through five small
transducers, tables of their own that are composed into one: an insult emits its learned weight,
with or without a target, more beside one, less after a negation or inside reported speech; a threat
emits only beside a target, on either side. What counts is the matched clause; a document's features
are its best clause and its total, and a logistic curve fitted on the training rows turns them into
a score.

Insults are learned as whole words and as word beginnings, so that inflected forms match. The
training sample is the ``max_rows`` labelled rows with the smallest hash of id (documented bound);
only its words are counted. Scoring reads every text whole.

Defined cases: null and empty texts have no clause and get the score of a text without matches.
Labels that are null or without a text are left out, repeated label rows count each. Without
positive labels only the seed words have weight. Other columns are not read; a null id is never
held out.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.session import stage

# Small cue lists in the corpus's four languages.
TARGETS = frozenset("you your yours he she him her they them these those people du dich ihr euch "
                    "sie vous tu toi ils elles usted ustedes ellos tú".split())
NEGATIONS = frozenset("not never no nor isn aren nobody nicht kein keine nie pas jamais ni nunca "
                      "nada".split())
REPORTS = frozenset("said says wrote writes called calls quoted claimed reported sagte schrieb "
                    "dit écrit dijo escribió".split())
THREATS = frozenset("kill murder strangle stab shoot töten umbringen tuer matar".split())
# Beginnings of their inflected forms.
THREAT_STARTS = tuple("kill murder strangl stabb shoot töte getötet umbring umzubring umgebracht "
                      "tuer tué matar".split())
SEEDS = frozenset("idiot moron stupid scum worthless pathetic trash loser disgusting".split())

_WORD = re.compile(r"[^\W\d_]+")
_CLAUSE = re.compile(r"[.!?;:\n]+")
PREFIXES = (4, 5, 6)

OTHER, INSULT, TARGET, THREAT, NEGATION, REPORT = SYMBOLS = range(6)
REACH = 3  # words


def _within_reach(of: int) -> list[list[int]]:
    """Table of a transducer that counts down the words that its last symbol still reaches."""
    return [[REACH if s == of else max(left - 1, 0) for s in SYMBOLS] for left in range(REACH + 1)]


# Next state by state and symbol.
NEGATION_TABLE = _within_reach(NEGATION)
TARGET_TABLE = _within_reach(TARGET)
THREAT_TABLE = _within_reach(THREAT)
REPORT_TABLE = [[int(reported or s == REPORT) for s in SYMBOLS] for reported in (0, 1)]
# State 1: an insult waits for a target. Read after the target transducer, whose output (a target
# reaches this word) picks the table.
INSULT_TABLES = [[[1 - near if s == INSULT else 0 if s == TARGET else waits for s in SYMBOLS]
                  for waits in (0, 1)] for near in (0, 1)]


def _composed() -> list[list[tuple[int, float, float, float, float]]]:
    """Next state and output of the five transducers at once. Output: factor of an insult's weight,
    factor kept for a target to come, share of the kept weight paid out, weight of a threat."""
    states = list(product(range(REACH + 1), (0, 1), range(REACH + 1), range(REACH + 1), (0, 1)))
    number = {state: k for k, state in enumerate(states)}
    table = []
    for negated, reported, target, threat, waits in states:
        damp = (0.5 if negated else 1.0) * (0.5 if reported else 1.0)
        row = []
        for s in SYMBOLS:
            near = int(target > 0)
            after = (NEGATION_TABLE[negated][s], REPORT_TABLE[reported][s], TARGET_TABLE[target][s],
                     THREAT_TABLE[threat][s], INSULT_TABLES[near][waits][s])
            meets = (s == TARGET and threat > 0) or (s == THREAT and target > 0)
            row.append((number[after], damp * (1.25 if near else 1.0), 0.25 * damp,
                        float(s == TARGET and waits), 4.0 * damp if meets else 0.0))
        table.append(row)
    return table


COMPOSED = _composed()


@dataclass(frozen=True)
class Training:
    max_rows: int = 20_000
    max_patterns: int = 5_000
    min_support: int = 3
    support_share: float = 0.005
    min_weight: float = 3.0
    seed_weight: float = 5.0


@dataclass
class Grammar:
    """Weights by whole word and by word beginning, and the score curve."""

    words: dict[str, float]
    starts: dict[str, float]
    curve: list[float] = field(default_factory=lambda: [-4.0, 1.0, 0.5])

    def weight(self, word: str) -> float:
        best = self.words.get(word, 0.0)
        for k in PREFIXES:
            if len(word) >= k:
                best = max(best, self.starts.get(word[:k], 0.0))
        return best

    def symbol(self, word: str) -> int:
        if self.weight(word):
            return INSULT
        if word in TARGETS:
            return TARGET
        if word in THREATS or word.startswith(THREAT_STARTS):
            return THREAT
        return NEGATION if word in NEGATIONS else REPORT if word in REPORTS else OTHER

    def clause(self, words: list[str], symbols: dict[str, int] | None = None) -> float:
        """Weight emitted by one clause; ``symbols`` may name the symbols of its words."""
        state, total, kept = 0, 0.0, 0.0
        for word in words:
            symbol = self.symbol(word) if symbols is None else symbols[word]
            state, own, keep, paid, fixed = COMPOSED[state][symbol]
            total += paid * kept + fixed
            if symbol == INSULT:
                weight = self.weight(word)
                total += own * weight
                kept = keep * weight
        return total

    def features(self, text: str | None) -> tuple[float, float]:
        """Best clause and total of a text."""
        low = (text or "").lower()
        symbols = {w: self.symbol(w) for w in set(_WORD.findall(low))}
        if not {INSULT, THREAT} & set(symbols.values()):
            return 0.0, 0.0
        clauses = [self.clause(_WORD.findall(c), symbols) for c in _CLAUSE.split(low)]
        return max(clauses), sum(clauses)

    def score(self, best: np.ndarray, total: np.ndarray) -> np.ndarray:
        a, b, c = self.curve
        return 1 / (1 + np.exp(-(a + b * np.minimum(best, 20.0) + c * np.log1p(total))))


def held_out(id_col: str):
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(key.cast("binary")) % 4 == 2


def _patterns(text: str | None) -> set[str]:
    found = set(_WORD.findall((text or "").lower()))
    return found | {w[:k] + "*" for w in found for k in PREFIXES if len(w) >= k}


def _pattern_counts(texts: DataFrame, only: frozenset | None) -> DataFrame:
    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found = _patterns(text)
                seen.update(found if only is None else only & found)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
            ["p", "n"])

    return texts.select("t").mapInArrow(count, "p string, n long").groupBy("p").agg(
        F.sum("n").alias("n"))


def _fit(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Ridge logistic regression by Newton steps, on weights that balance little."""
    z = np.c_[np.ones(len(x)), np.minimum(x[:, 0], 20.0), np.log1p(x[:, 1])]
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 0.1 * np.eye(3),
                               z.T @ (y - p) - 0.1 * w)
        w = w + np.clip(step, -2, 2)
    return w.tolist()


def train(docs: DataFrame, labels: DataFrame, setting: Training = Training(),
          id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Grammar:
    """Weights and curve from labelled rows that are not held out."""
    known = labels.filter(F.col(label_col).isNotNull() & ~held_out(id_col)).select(
        F.col(id_col).alias("of"), (F.col(label_col) > 0).alias("y"))
    known = known.orderBy(F.xxhash64("of"), "of").limit(setting.max_rows)
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).join(
        known, F.col("i") == F.col("of")).select("t", "y").filter("t is not null")
    rows = stage(rows, "toxic-rows")
    sizes = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n_pos, n_neg = sizes.get(True, 0), sizes.get(False, 0)
    words, starts = dict.fromkeys(SEEDS, setting.seed_weight), {}
    if n_pos and n_neg:
        least = max(setting.min_support, int(setting.support_share * n_pos))
        # Candidates are bounded: the most frequent patterns of toxic rows.
        top = _pattern_counts(rows.filter("y"), None).filter(F.col("n") >= least).orderBy(
            F.desc("n"), "p").limit(10 * setting.max_patterns).collect()
        pos = {r.p: r.n for r in top}
        neg = Counter({r.p: r.n for r in _pattern_counts(
            rows.filter("not y"), frozenset(pos)).collect()})
        weight = {p: float(np.log((a + 0.5) / (n_pos + 1)) - np.log((neg[p] + 0.5) / (n_neg + 1)))
                  for p, a in pos.items()}
        for seed in SEEDS:
            if seed in weight:
                words[seed] = max(weight[seed], 0.0)
        chosen = sorted((p for p in weight if weight[p] >= setting.min_weight
                         and pos[p] > 4 * neg[p]),
                        key=lambda p: (-weight[p], p))[: setting.max_patterns]
        for p in chosen:
            if p.endswith("*"):
                starts[p[:-1]] = weight[p]
            else:
                words[p] = weight[p]
    grammar = Grammar(words, starts)
    if n_pos and n_neg:
        seen = _featured(rows, grammar, ["y"]).select("y", "best", "total").toPandas()
        grammar.curve = _fit(seen[["best", "total"]].to_numpy(), seen["y"].to_numpy(float))
    return grammar


def _featured(rows: DataFrame, grammar: Grammar, carry: list[str]) -> DataFrame:
    def run(batches):
        for batch in batches:
            found = [grammar.features(t) for t in batch.column("t").to_pylist()]
            best, total = np.array(found, float).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in carry], pa.array(best), pa.array(total),
                 pa.array(grammar.score(best, total))], [*carry, "best", "total", "score"])

    schema = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, f"{schema}, best double, total double, score double")


def score(docs: DataFrame, grammar: Grammar, threshold: float = 0.3, id_col: str = "doc_id",
          text_col: str = "text") -> DataFrame:
    """id, held_out, score, predicted, best_clause, total."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("t"))
    return _featured(rows, grammar, ["id"]).select(
        F.col("id").alias(id_col), held_out("id").alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
        F.col("best").alias("best_clause"), "total")
