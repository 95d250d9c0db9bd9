"""Quality classifier: a sparse rule ensemble compiled into Spark column expressions.

Statistics of the text are column expressions. On a bounded sample of labelled rows boosted shallow trees are grown
over them; every path from a root is a conjunctive rule; a logistic model with a lasso penalty weighs the rules, and
those with a weight are compiled into one column. Nothing but the text enters a score.

Null text counts as empty; a null doc_id is not held out and never learnt from; several labels of one document count
as the highest; without labels of both kinds every score is the smoothed share of label 1; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

SAMPLE_ROWS, TREES, DEPTH, BINS, RATE, THRESHOLD, FOLDS, SEED = 20_000, 40, 3, 32, 0.3, 0.3, 5, 7
PENALTIES = (3e-2, 1e-2, 3e-3, 1e-3, 3e-4)


def statistics(text: Column) -> dict[str, Column]:
    """Whole-text statistics; shares are per character or per word, so long and short texts compare."""
    t = F.coalesce(text, F.lit(""))
    words, lines = F.filter(F.split(t, r"\s+"), lambda w: w != ""), F.split(t, "\n")
    n, n_words = F.greatest(F.length(t), F.lit(1)), F.greatest(F.size(words), F.lit(1))
    return {
        "log_words": F.log1p(F.size(words)),
        "word_length": F.length(t) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "repeats_per_root": (n_words - F.size(F.array_distinct(words))) / F.sqrt(n_words),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_length": F.log1p(F.length(t) / F.size(lines)),
        "upper": F.regexp_count(t, F.lit(r"\p{Lu}")) / n,
        "signs": F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s]")) / n,
        "sign_runs": F.regexp_count(t, F.lit(r"[^\p{L}\p{N}\s]{2,}")) / n_words,
        "lone_signs": F.regexp_count(t, F.lit(r"\s[^\p{L}\p{N}\s]+(?=\s)")) / n_words,
        "digits": F.regexp_count(t, F.lit(r"\p{N}")) / n,
        "full_stops": F.regexp_count(t, F.lit(r"[.!?](?:\s|$)")) / n_words,
    }


NAMES = (
    "log_words", "word_length", "distinct_words", "repeats_per_root", "distinct_lines", "line_length", "upper", "signs", "sign_runs", "lone_signs", "digits", "full_stops",
)

Condition = tuple[int, bool, float]  # statistic, whether it is above, threshold
Rule = tuple[Condition, ...]


@dataclass
class RuleModel:
    intercept: float
    rules: list[tuple[float, Rule]] = field(default_factory=list)

    def column(self, stats: dict[str, Column]) -> Column:
        """The score between 0 and 1 as one expression over the statistics' columns."""
        total = F.lit(float(self.intercept))
        for weight, rule in self.rules:
            holds = F.lit(True)
            for k, above, at in rule:
                holds = holds & ((stats[NAMES[k]] > at) if above else (stats[NAMES[k]] <= at))
            total = total + F.when(holds, F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for weight, rule in self.rules:
            total += weight * holds(rule, x)
        return 1 / (1 + np.exp(-total))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, at in rule:
        out &= (x[:, k] > at) if above else (x[:, k] <= at)
    return out


def _split(bins: np.ndarray, cuts: list[np.ndarray], rows: np.ndarray, grad: np.ndarray, hess: np.ndarray):
    """The statistic and cut of the largest gain, from histograms of gradients."""
    best, found = 1e-6, None
    total_g, total_h = grad[rows].sum(), hess[rows].sum()
    for k, edges in enumerate(cuts):
        g = np.cumsum(np.bincount(bins[rows, k], grad[rows], len(edges) + 1))[:-1]
        h = np.cumsum(np.bincount(bins[rows, k], hess[rows], len(edges) + 1))[:-1]
        ok = (h > 1) & (total_h - h > 1)
        gain = np.where(ok, g**2 / (h + 1) + (total_g - g) ** 2 / (total_h - h + 1) - total_g**2 / (total_h + 1), 0)
        if len(gain) and gain.max() > best:
            best, found = gain.max(), (k, int(np.argmax(gain)))
    return found


def grow_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list[Rule]:
    """The paths of boosted trees, each grown on a random half of the rows."""
    draw = np.random.default_rng(seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    bins = np.stack([np.searchsorted(c, x[:, k], side="left") for k, c in enumerate(cuts)], axis=1)
    rules: dict[Rule, None] = {}
    score = np.zeros(len(y))
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, np.maximum(p * (1 - p), 1e-6)
        half = draw.random(len(y)) < 0.5
        todo = [(np.arange(len(y)), ())]
        while todo:
            rows, path = todo.pop()
            seen = rows[half[rows]]
            cut = _split(bins, cuts, seen, grad, hess) if len(path) < depth and len(seen) else None
            if cut is None:
                score[rows] += RATE * grad[seen].sum() / (hess[seen].sum() + 1)
                continue
            k, at = cut
            above = bins[rows, k] > at
            for side in (False, True):
                rule = (*path, (k, side, float(cuts[k][at])))
                rules[rule] = None
                todo.append((rows[above == side], rule))
    return list(rules)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float, steps: int = 300) -> tuple[float, np.ndarray]:
    """Intercept (not penalised) and weights, by accelerated proximal gradient steps."""
    n, m = z.shape
    step = 4 / (np.linalg.norm(np.hstack([z, np.ones((n, 1))]), 2) ** 2 / n)
    w = v = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(z @ v[:-1] + v[-1])))
        u = v - step * np.append(z.T @ (p - y), (p - y).sum()) / n
        u[:-1] = np.sign(u[:-1]) * np.maximum(np.abs(u[:-1]) - step * penalty, 0)
        t_next = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = u + (t - 1) / t_next * (u - w), u, t_next
    return float(w[-1]), w[:-1]


def fit(x: np.ndarray, y: np.ndarray, seed: int = SEED) -> RuleModel:
    """The model of the labelled rows; a fifth of them chooses the penalty."""
    if len(y) < 20 or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))))
    rules, masks = [], {}
    for rule in grow_rules(x, y, seed=seed):
        mask = holds(rule, x)
        if 5 <= mask.sum() <= len(y) - 5 and masks.setdefault(mask.tobytes(), rule) is rule:
            rules.append(rule)
    if not rules:
        return RuleModel(float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1))))
    z = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float64)
    aside = np.random.default_rng(seed).random(len(y)) < 0.2
    losses = {}
    for penalty in PENALTIES:
        b, w = lasso_logistic(z[~aside], y[~aside], penalty)
        p = np.clip(1 / (1 + np.exp(-(z[aside] @ w + b))), 1e-6, 1 - 1e-6)
        losses[penalty] = -np.mean(y[aside] * np.log(p) + (1 - y[aside]) * np.log(1 - p))
    least = min(losses.values())
    b, w = lasso_logistic(z, y, max(p for p, loss in losses.items() if loss <= least * 1.02 + 1e-6))
    return RuleModel(b, [(float(c), r) for c, r in zip(w, rules) if abs(c) > 1e-4])


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    """Learn from at most `sample_rows` labelled rows outside the held-out fold, drawn by a hash of the id."""
    known = labels.select(labels["doc_id"].alias("_id"), labels[label_col].cast("int").alias("_y"))
    known = known.where(F.col("_id").isNotNull() & F.col("_y").isNotNull() & ~held_out(F.col("_id")))
    known = known.groupBy("_id").agg(F.max("_y").alias("_y")).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"))
    rows = rows.join(F.broadcast(known), F.col("doc_id") == F.col("_id"))  # at most sample_rows rows of 12 bytes
    stats = statistics(F.col("text"))
    rows = rows.select("_id", "_y", *(stats[c].cast("double").alias(c) for c in NAMES))
    # of rows that repeat an id the one with the least statistics, whatever order they come in
    one = rows.groupBy("_id", "_y").agg(F.min(F.struct(*NAMES)).alias("s"))
    got = one.select("_id", "_y", "s.*").toPandas().sort_values("_id")  # at most sample_rows rows
    return fit(got[list(NAMES)].to_numpy(np.float64), (got["_y"].to_numpy() > 0).astype(np.float64))


def with_score(docs: DataFrame, model: RuleModel, name: str = "score") -> DataFrame:
    """docs with a score column; the statistics are computed once per row and dropped."""
    own = {c: fresh(docs, f"stat_{c}") for c in NAMES}
    wide = docs.select("*", *(x.cast("double").alias(own[c]) for c, x in statistics(docs["text"]).items()))
    return wide.select(*docs.columns, model.column({c: wide[own[c]] for c in NAMES}).alias(name))


def score(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    rows = with_score(docs.select("doc_id", "text"), train(docs, labels, sample_rows=sample_rows))
    return rows.select("doc_id", held_out(rows["doc_id"]).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The rows of docs that the classifier does not reject, with their columns."""
    name = fresh(docs, "quality_score")
    scored = with_score(docs, train(docs, labels, sample_rows=sample_rows), name)
    return scored.where(scored[name] >= threshold).select(*docs.columns)
