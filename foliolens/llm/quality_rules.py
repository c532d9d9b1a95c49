"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics.

Boosted shallow trees propose rules (each path from a root to a node is a conjunction of
thresholds on statistics), an L1-penalised logistic regression keeps few of them, and
the kept rules become one Spark column expression. Statistics and score are DataFrame
functions only; the driver fits on a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolens.llm.common import free_name, hash_fraction, held_out

#: Bound of the sample of labelled documents that the classifier is fitted on.
FIT_ROWS = 6000
#: Trees and their depth: what rules are proposed from.
TREES, DEPTH = 24, 3

#: Statistics of a text, in the order of the matrix that rules are learnt from.
STATISTICS = (
    "n_words", "mean_word", "distinct_words", "short_words", "letters", "symbol_runs", "capital_runs",
    "bars", "numbers", "marks", "echoes", "line_words", "distinct_lines", "longest_word",
)


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of whole texts as columns; a null text counts as empty, an empty one gives zeros.

    Rates are per word; no pattern can backtrack over more than a word.
    """
    t = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(t, r"\s+"), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: x != "")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    chars = F.greatest(F.length(t), F.lit(1)).cast("double")
    counted = lambda p: F.regexp_count(t, F.lit(p)) / n
    return {
        "n_words": F.size(words).cast("double"),
        "mean_word": F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / n,
        "distinct_words": F.size(F.array_distinct(words)) / n,
        "short_words": F.size(F.filter(words, lambda w: F.length(w) <= 3)) / n,
        "letters": F.length(F.regexp_replace(t, r"[^\p{L}]+", "")) / chars,
        "symbol_runs": counted(r"[^\p{L}\p{N}\s]{2,}+"),
        "capital_runs": counted(r"\p{Lu}{2,}+"),
        "bars": counted(r"[|]"),
        "numbers": counted(r"\p{N}++"),
        "marks": counted(r"[.!?](?=\s|$)"),
        "echoes": counted(r"\b(\p{L}++)(?=\s\1\b)"),
        "line_words": F.size(words) / F.greatest(F.size(lines), F.lit(1)),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1)),
        "longest_word": F.coalesce(F.array_max(F.transform(words, lambda w: F.length(w))), F.lit(0)).cast("double"),
    }


def with_statistics(docs: DataFrame, text: str = "text", names: tuple[str, ...] = STATISTICS, into: str = "_statistics") -> DataFrame:
    """Add a struct column of the named statistics; it replaces one of that name."""
    all_ = statistics(F.col(text))
    return docs.withColumn(into, F.struct(*[all_[k].cast("double").alias(k) for k in names]))


@dataclass(frozen=True)
class Rule:
    """A conjunction: all of (statistic, is at most, threshold), where False stands for above."""

    parts: tuple[tuple[str, bool, float], ...]

    def column(self, of: str = "_statistics") -> Column:
        out = None
        for name, below, cut in self.parts:
            c = F.col(f"{of}.{name}")
            c = c <= F.lit(cut) if below else c > F.lit(cut)
            out = c if out is None else out & c
        return out

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for name, below, cut in self.parts:
            v = x[:, STATISTICS.index(name)]
            out &= v <= cut if below else v > cut
        return out

    def __str__(self) -> str:
        return " and ".join(f"{n} {'<=' if below else '>'} {c:g}" for n, below, c in self.parts)


@dataclass
class RuleEnsemble:
    """intercept + weights of the rules that hold, through a logistic curve."""

    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def used(self) -> tuple[str, ...]:
        """The statistics that the rules ask for (one at least), in their order."""
        asked = {name for rule, _ in self.rules for name, _, _ in rule.parts}
        return tuple(k for k in STATISTICS if k in asked) or STATISTICS[:1]

    def score(self, of: str = "_statistics") -> Column:
        total = F.lit(float(self.intercept))
        for rule, weight in self.rules:
            total = total + F.when(rule.column(of), F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def score_rows(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * rule.holds(x)
        return 1 / (1 + np.exp(-z))


def _grow(x: np.ndarray, cuts: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray,
          parts: tuple, depth: int, least: int, found: list[tuple], out: np.ndarray) -> None:
    """Grow one regression tree by second-order gain; every path is added to ``found``."""
    g, h = grad[rows].sum(), hess[rows].sum()
    out[rows] = -g / (h + 1.0)
    if depth == 0 or len(rows) < 2 * least:
        return
    best = (1e-6, None, None)
    for j, edges in enumerate(cuts):
        if not len(edges):
            continue
        at = np.searchsorted(edges, x[rows, j], side="left")  # x <= edges[k] goes left of cut k
        gs = np.bincount(at, grad[rows], len(edges) + 1).cumsum()[:-1]
        hs = np.bincount(at, hess[rows], len(edges) + 1).cumsum()[:-1]
        ns = np.bincount(at, minlength=len(edges) + 1).cumsum()[:-1]
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
        gain[(ns < least) | (len(rows) - ns < least)] = 0
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (gain[k], j, float(edges[k]))
    if best[1] is None:
        return
    _, j, cut = best
    left = x[rows, j] <= cut
    for below, side in ((True, rows[left]), (False, rows[~left])):
        path = (*parts, (STATISTICS[j], below, cut))
        found.append(path)
        _grow(x, cuts, grad, hess, side, path, depth - 1, least, found, out)


def propose_rules(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> list[Rule]:
    """Conjunctions from the paths of boosted trees, in the order found, each once."""
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0.01, 0.99, 64))) for j in range(x.shape[1])]
    z, least, found = np.zeros(len(y)), max(3, len(y) // 400), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        step = np.zeros(len(y))
        _grow(x, cuts, p - y, np.maximum(p * (1 - p), 1e-6), np.arange(len(y)), (), depth, least, found, step)
        z += 0.4 * step
    return [Rule(p) for p in dict.fromkeys(tuple(sorted(set(p))) for p in found)]


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> tuple[float, np.ndarray]:
    """Accelerated proximal gradient for logistic loss plus ``penalty`` times the sum of absolute weights."""
    n = len(y)
    full = np.hstack((np.ones((n, 1)), a))
    v = np.ones(full.shape[1])
    for _ in range(30):  # largest eigenvalue, for the step
        v = full.T @ (full @ v)
        v /= np.linalg.norm(v) or 1
    step = 4 * n / max(np.linalg.norm(full @ v) ** 2, 1e-9)
    w = look = np.zeros(full.shape[1])
    t = 1.0
    for _ in range(rounds):
        grad = full.T @ (1 / (1 + np.exp(-(full @ look))) - y) / n
        new = look - step * grad
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        look, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleEnsemble:
    """Fit the ensemble; the penalty is the largest of a path that comes near the best on every fourth row.

    Few rows give few rules, as each side of a cut holds three at least; below four rows the
    penalty is judged on all. Without rows every score is 0.5, of one class alone its rate
    (held to 0.001 to 0.999).
    """
    if len(y) == 0:
        return RuleEnsemble(0.0)
    rate = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    if y.min() == y.max():
        return RuleEnsemble(float(np.log(rate / (1 - rate))))
    rules = propose_rules(x, y)
    a = np.stack([r.holds(x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
    test = np.arange(len(y)) % 4 == 3
    learn = ~test
    if not test.any():
        test = learn
    path = []
    for penalty in (0.02, 0.008, 0.003, 0.001):
        b, w = lasso_logistic(a[learn], y[learn], penalty)
        p = np.clip(1 / (1 + np.exp(-(a[test] @ w + b))), 1e-9, 1 - 1e-9)
        path.append((float(-(y[test] * np.log(p) + (1 - y[test]) * np.log(1 - p)).mean()), penalty))
    best = min(path)[0]
    penalty = next(p for loss, p in path if loss <= 1.02 * best + 1e-4)
    b, w = lasso_logistic(a, y, penalty)
    keep = [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-4]
    return RuleEnsemble(b, keep)


def fit_quality(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, text: str = "text",
                doc_id: str = "doc_id", label: str = "quality") -> RuleEnsemble:
    """Fit on about ``fit_rows`` labelled documents that aren't held out.

    The sample is drawn from the labels by a hash of the id, so it has a proven bound and
    is broadcast to the documents. Null ids and labels teach nothing. An id counts once:
    with 1 if more than half of its labels are above 0.5, and with the smallest statistics
    (compared in their order) of the rows that repeat it, reduced before the shuffle.
    Without labelled documents every score is 0.5. Other columns are not read.
    """
    rows = labels.select(F.col(doc_id).alias("i"), F.col(label).cast("double").alias("y")).where(
        F.col("i").isNotNull() & F.col("y").isNotNull() & ~held_out(F.col("i")))
    rows = rows.groupBy("i").agg((F.avg((F.col("y") > 0.5).cast("double")) > 0.5).cast("double").alias("y"))
    n = rows.count()
    drawn = rows.where(hash_fraction(F.col("i"), F.lit(1)) < F.lit(min(1.0, fit_rows / max(n, 1))))
    joined = docs.select(F.col(doc_id).alias("i"), F.col(text).alias("t")).join(F.broadcast(drawn), "i")
    once = with_statistics(joined, "t").groupBy("i", "y").agg(F.min("_statistics").alias("s"))
    got = once.select("i", "y", "s.*").orderBy("i").toPandas()
    return fit_rules(got[list(STATISTICS)].to_numpy(float), got["y"].to_numpy(float))


def with_quality(docs: DataFrame, model: RuleEnsemble, text: str = "text", score: str = "score") -> DataFrame:
    """Add the score (0 to 1, higher: better) of each whole text; a column of that name is replaced.

    Null texts count as empty; rows that repeat get the same score; other columns stay as they are.
    """
    into = free_name(docs, "_statistics")
    return with_statistics(docs, text, model.used(), into).withColumn(score, model.score(into)).drop(into)
