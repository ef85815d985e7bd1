"""Quality classifier: a sparse ensemble of rules, compiled into one Spark column.

Statistics of whole texts are Spark columns.  On a bounded sample of labelled rows shallow trees are
boosted; every path from a root to a node is a rule, a conjunction of comparisons; a logistic
model with an L1 penalty keeps few of them.  Scoring is then a plain projection: no Python, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE_ROWS = 8000  # labelled rows that the model is fitted on, at most
SYMBOLS = "#$%&*|<>{}[]=_~^@\\/+"


def text_stats(text: Column) -> dict[str, Column]:
    """Statistics of a whole text, each finite for every text; null counts as empty."""
    t = F.coalesce(text, F.lit(""))
    n = F.greatest(F.length(t), F.lit(1)).cast("double")
    without = lambda chars: F.length(t) - F.length(F.translate(t, chars, ""))
    only = lambda cls: F.length(F.regexp_replace(t, f"[^{cls}]+", ""))
    words, lines = F.split(F.trim(t), r"\s+"), F.split(t, "\n")
    n_words, letters = F.size(words).cast("double"), only(r"\p{L}")
    return {
        "n_chars": F.length(t).cast("double"),
        "letters": letters / n,
        "upper": only(r"\p{Lu}") / F.greatest(letters, F.lit(1)),
        "digits": only("0-9") / n,
        "symbols": without(SYMBOLS) / n,
        "bars": without("|") / n,
        "bangs": without("!?") / n,
        "stops": without(".,;:") / n_words,
        "word_length": n / n_words,
        "line_words": n_words / F.size(lines),
        "fresh_words": F.size(F.array_distinct(words)) / n_words,
        "fresh_lines": F.size(F.array_distinct(lines)) / F.size(lines),
    }


@dataclass(frozen=True)
class Rule:
    """A conjunction: (statistic, is it above, threshold) for each part."""

    parts: tuple[tuple[str, bool, float], ...]

    def column(self, stats: dict[str, Column]) -> Column:
        out = F.lit(True)
        for name, above, cut in self.parts:
            out = out & (stats[name] > cut if above else stats[name] <= cut)
        return out

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for name, above, cut in self.parts:
            out &= (x[name] > cut) == above
        return out


def _best_split(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, least: int):
    """(gain, feature, threshold) of the best cut among 32 quantiles of each feature."""
    best = (1e-6, None, None)
    g, h = grad[rows].sum(), hess[rows].sum()
    for f in range(x.shape[1]):
        v = x[rows, f]
        cuts = np.unique(np.quantile(v, np.linspace(0, 1, 34)[1:-1]))
        if len(cuts) < 1:
            continue
        place = np.searchsorted(cuts, v, "left")
        n = np.cumsum(np.bincount(place, minlength=len(cuts) + 1))[:-1]
        gl = np.cumsum(np.bincount(place, grad[rows], len(cuts) + 1))[:-1]
        hl = np.cumsum(np.bincount(place, hess[rows], len(cuts) + 1))[:-1]
        gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
        gain[(n < least) | (len(rows) - n < least)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], f, float(cuts[k]))
    return best


def tree_rules(x: np.ndarray, y: np.ndarray, names: list[str], trees: int, depth: int, rate: float = 0.3) -> list[Rule]:
    """Every path of boosted trees as a rule, without repeats, in order of growth."""
    margin, found = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    least = max(5, len(y) // 400)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = y - p, p * (1 - p)
        todo = [(np.arange(len(y)), ())]
        while todo:
            rows, path = todo.pop()
            _, f, cut = _best_split(x, grad, hess, rows, least) if len(path) < depth else (0, None, None)
            if f is None:
                margin[rows] += rate * grad[rows].sum() / (hess[rows].sum() + 1)
                continue
            above = x[rows, f] > cut
            for side in (False, True):
                branch = (*path, (names[f], side, cut))
                found.setdefault(frozenset(branch), Rule(branch))
                todo.append((rows[above == side], branch))
    return list(found.values())


def lasso_logistic(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights of a logistic model, by accelerated proximal steps."""
    n, k = x.shape
    w, b = np.zeros(k), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    step = 4 * n / (np.linalg.norm(np.column_stack((np.ones(n), x)), 2) ** 2 + 1e-9)
    v, c, t = w.copy(), b, 1.0
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(c + x @ v))) - y
        moved = v - step * (x.T @ r) / n
        new, new_b = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0), c - step * r.mean()
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / t_next * (new - w), new_b + (t - 1) / t_next * (new_b - b)
        w, b, t = new, new_b, t_next
    return b, w


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, stats: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(stats), weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit_rules(
    x: dict[str, np.ndarray], y: np.ndarray, trees: int = 30, depth: int = 3, penalty: float = 2e-3
) -> RuleModel:
    """The model of labelled statistics; without both labels present, a constant score."""
    if len(y) == 0 or y.min() == y.max():
        return RuleModel(0.0 if len(y) == 0 else float(np.log((y.mean() + 0.05) / (1.05 - y.mean()))), ())
    names = list(x)
    rules = tree_rules(np.column_stack([x[n] for n in names]), y, names, trees, depth)
    if not rules:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), ())
    holds = np.column_stack([r.holds(x) for r in rules]).astype(np.float64)
    b, w = lasso_logistic(holds, y, penalty)
    return RuleModel(b, tuple((r, float(v)) for r, v in zip(rules, w, strict=True) if v))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning: the checksum of its id is a multiple of five."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def learn_quality(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> RuleModel:
    """A model of ``labels.quality`` from at most ``rows`` labelled rows that are not held out.

    The sample is in order of a hash of the id, so it is the same in every run.  It is bounded, and
    that bound is what lets it be broadcast to the scan of the texts.
    """
    marked = labels.filter("quality is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    sample = marked.select("doc_id", F.col("quality").cast("int").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    stats = text_stats(F.col("text"))
    seen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("doc_id", "y", *(c.alias(k) for k, c in stats.items()))
    table = seen.groupBy("doc_id", "y").agg(F.min(F.struct(*stats)).alias("s")).select("doc_id", "y", "s.*").toPandas()
    table = table.sort_values(["doc_id", "y"])
    return fit_rules({k: table[k].to_numpy(np.float64) for k in stats}, table["y"].to_numpy(np.float64))


def score_quality(docs: DataFrame, model: RuleModel, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; null and empty texts get a score, too.

    Statistics are computed once per row, below the rules.  Repeated rows are scored alike, an empty table
    gives no row, further columns of any name are ignored.
    """
    stats = text_stats(F.col("text"))
    rows = docs.select(F.col("doc_id").cast("long"), F.struct(*(c.alias(k) for k, c in stats.items())).alias("s"))
    held = {k: F.col(f"s.{k}") for k in stats}
    scored = rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), model.score(held).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))
