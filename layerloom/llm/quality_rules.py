"""Quality rules: a learned decision list of threshold conjunctions over text statistics.

Method: sequential covering. Labelled rows are split into a growing and a pruning part. From each statistic a rule for
rejected texts is grown: the condition with the highest information gain is added until no accepted text of the growing
part is covered; then it is cut back to the prefix that does best on the pruning part. The rule that rejects most, with
each wrongly rejected text counted COST times, joins the ordered list; the texts that it covers are set aside and the
next rule is grown. The list becomes one ordered chain of Spark conditional expressions.

Defined cases: a null or empty text has no words and fails the base rules; without labelled rows of both kinds the list
is empty and rejects nothing; rows without id get a result like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from layerloom.llm._stats import RATIOS, labelled_ratios, ratios, with_counts

#: Labelled rows to learn from, at most.
SAMPLE = 20_000
#: So many rejected texts must a rule find for each accepted one that it rejects too.
COST = 25
MOST_RULES, MOST_CONDITIONS, THRESHOLDS = 12, 4, 48
LEAST_ROWS = 4

Condition = tuple[str, str, float]


@dataclass(frozen=True)
class Rule:
    """Rejects a text if all conditions (statistic, '<=' or '>', threshold) hold."""

    conditions: tuple[Condition, ...]

    def __str__(self) -> str:
        return " and ".join(f"{s} {op} {t:.4g}" for s, op, t in self.conditions)


def _covers(x: np.ndarray, conditions: tuple[Condition, ...] | list[Condition]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, op, t in conditions:
        column = x[:, RATIOS.index(name)]
        out &= column <= t if op == "<=" else column > t
    return out


def _candidates(x: np.ndarray) -> list[Condition]:
    out = []
    for k, name in enumerate(RATIOS):
        values = np.unique(x[:, k])
        middles = (values[1:] + values[:-1]) / 2
        if len(middles) > THRESHOLDS:
            middles = np.unique(middles[np.linspace(0, len(middles) - 1, THRESHOLDS).astype(int)])
        out += [(name, op, float(t)) for t in middles for op in ("<=", ">")]
    return out


def _grow(x: np.ndarray, bad: np.ndarray, first: str) -> list[Condition]:
    rule: list[Condition] = []
    covered = np.ones(len(x), bool)
    while len(rule) < MOST_CONDITIONS and (covered & ~bad).any():
        p0, n0 = (covered & bad).sum(), (covered & ~bad).sum()
        best, gain = None, 1e-9
        for c in _candidates(x[covered]):
            if not rule and c[0] != first:
                continue
            hit = covered & _covers(x, [c])
            p, n = (hit & bad).sum(), (hit & ~bad).sum()
            if p and (g := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > gain:
                best, gain = c, g
        if best is None:
            break
        rule.append(best)
        covered &= _covers(x, [best])
    return rule


def _worth(x: np.ndarray, bad: np.ndarray, rule: list[Condition]) -> float:
    hit = _covers(x, rule)
    p, n = (hit & bad).sum(), (hit & ~bad).sum()
    return (p - n) / (p + n) if p + n else -1.0


def learn(x: np.ndarray, good: np.ndarray) -> list[Rule]:
    """The decision list for rows of RATIOS and labels (1: accepted)."""
    bad = good == 0
    pruning = np.arange(len(x)) % 3 == 0
    rules: list[Rule] = []
    left = np.ones(len(x), bool)
    while len(rules) < MOST_RULES:
        grow, prune = left & ~pruning, left & pruning
        if not (grow & bad).any() or not (grow & ~bad).any():
            break
        found: list[tuple[float, list[Condition]]] = []
        for name in RATIOS:
            if grown := _grow(x[grow], bad[grow], name):
                kept = max((grown[: k + 1] for k in range(len(grown))), key=lambda r: (_worth(x[prune], bad[prune], r), -len(r)))
                hit = _covers(x, kept) & left
                found.append(((hit & bad).sum() - COST * (hit & ~bad).sum(), kept))
        value, kept = max(found, default=(0, []), key=lambda f: (f[0], -len(f[1])))
        if value < LEAST_ROWS:
            break
        rules.append(Rule(tuple(kept)))
        left &= ~_covers(x, kept)
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one ordered conditional expression: the number of the first rule that rejects, or 0."""
    out, columns = F.lit(0), ratios()
    for number, rule in reversed(list(enumerate(rules, 1))):
        holds = F.lit(True)
        for name, op, t in rule.conditions:
            holds = holds & (columns[name] <= F.lit(t) if op == "<=" else columns[name] > F.lit(t))
        out = F.when(holds, F.lit(number)).otherwise(out)
    return out


def quality_rules(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id, n_words, the base counts, base_failed, rule (first that rejects, or 0), kept."""
    counted = with_counts(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = counted.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), verdict(rules).alias("rule"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def learn_from(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> list[Rule]:
    x, y = labelled_ratios(docs, labels, "quality", limit)
    return learn(x, y)
