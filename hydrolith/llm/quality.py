"""Quality classifier: a sparse ensemble of rules over text statistics, compiled into column expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hydrolith.llm.common import labelled_sample, labelled_texts, remainder

#: Most labelled documents that the rules are fitted on, picked by hash of the id.
MAX_TRAIN_DOCS = 12000


STATISTICS = ("log_chars", "chars_per_word", "upper", "digits", "marks", "distinct_words", "lines_per_word", "distinct_lines")


def once(value: Column, use) -> Column:
    """use(value), with value computed once a row: as the element of an array that a lambda goes over, it is not inlined."""
    return F.element_at(F.transform(F.array(value), use), 1)


def text_statistics(text: Column) -> Column:
    """Struct of general statistics of a whole text, STATISTICS, from built-in expressions; a null text is an empty one."""
    t = F.coalesce(text.cast("string"), F.lit(""))
    pieces = F.struct(t.alias("text"), F.split(t, r"[ \t-\r]+").alias("words"), F.split(t, "\n").alias("lines"))

    def measured(p: Column) -> Column:
        length, n_words, n_lines = F.length(p["text"]).cast("double"), F.size(p["words"]).cast("double"), F.size(p["lines"]).cast("double")
        share = lambda pattern: F.regexp_count(p["text"], F.lit(pattern)) / F.greatest(length, F.lit(1.0))
        values = (F.log1p(length), length / n_words, share(r"\p{Lu}"), share(r"\p{N}"), share(r"[^\p{L}\p{N}\s]"), F.size(F.array_distinct(p["words"])) / n_words, n_lines / n_words, F.size(F.array_distinct(p["lines"])) / n_lines)
        return F.struct(*[v.cast("double").alias(n) for n, v in zip(STATISTICS, values, strict=True)])

    return once(pieces, measured)


@dataclass(frozen=True)
class Rule:
    """All of (statistic, True for >, threshold) hold."""

    terms: tuple[tuple[str, bool, float], ...]

    def column(self, of: Column) -> Column:
        """Whether the rule holds for a struct of statistics."""
        out = F.lit(True)
        for name, above, at in self.terms:
            value = of[name]
            out = out & ((value > at) if above else (value <= at))
        return out

    def holds(self, values: dict[str, np.ndarray]) -> np.ndarray:
        out = None
        for name, above, at in self.terms:
            here = values[name] > at if above else values[name] <= at
            out = here if out is None else out & here
        return out


@dataclass
class RuleEnsemble:
    """Logistic model over rules; rules of weight zero are gone."""

    rules: list[Rule] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def margin(self, of: Column) -> Column:
        out = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            out = out + F.when(rule.column(of), F.lit(float(weight))).otherwise(F.lit(0.0))
        return out


def _grow(x: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray, depth: int, terms: tuple, least: int, update: np.ndarray, out: list) -> None:
    """Split `rows` by the best gain over all binned statistics; each node but the root is a rule."""
    g, h = grad[rows].sum(), hess[rows].sum()
    best = (1e-6, -1, -1)
    if depth:
        for j, cut in enumerate(edges):
            if not len(cut):
                continue
            left_g = np.cumsum(np.bincount(x[rows, j], grad[rows], len(cut) + 1))[:-1]
            left_h = np.cumsum(np.bincount(x[rows, j], hess[rows], len(cut) + 1))[:-1]
            left_n = np.cumsum(np.bincount(x[rows, j], minlength=len(cut) + 1))[:-1]
            gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
            gain[(left_n < least) | (len(rows) - left_n < least)] = -1
            if gain.max() > best[0]:
                best = (gain.max(), j, int(gain.argmax()))
    if best[1] < 0:
        update[rows] = -0.3 * g / (h + 1)
        return
    _, j, k = best
    for above in (False, True):
        part = rows[(x[rows, j] > k) == above]
        out.append((*terms, (j, above, k)))
        _grow(x, edges, grad, hess, part, depth - 1, out[-1], least, update, out)


def tree_rules(values: dict[str, np.ndarray], labels: np.ndarray, trees: int = 30, depth: int = 3, bins: int = 32, seed: int = 11) -> list[Rule]:
    """Rules that are the paths of boosted trees, each tree grown on half of the rows."""
    names = list(values)
    edges = [np.unique(np.quantile(values[n], np.linspace(0, 1, bins + 1)[1:-1])) for n in names]
    edges = [e[(e < values[n].max())] for e, n in zip(edges, names, strict=True)]
    x = np.stack([np.searchsorted(e, values[n], side="left") for e, n in zip(edges, names, strict=True)], axis=1)
    margin = np.zeros(len(labels))
    rng, found = np.random.default_rng(seed), {}
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        rows = np.flatnonzero(rng.random(len(labels)) < 0.5)
        update, out = np.zeros(len(labels)), []
        _grow(x, edges, p - labels, p * (1 - p), rows, depth, (), max(5, len(labels) // 1000), update, out)
        margin += update
        for path in out:
            bounds: dict[tuple[int, bool], int] = {}
            for j, above, k in path:
                old = bounds.get((j, above), k)
                bounds[j, above] = max(old, k) if above else min(old, k)
            rule = Rule(tuple((names[j], above, float(edges[j][k])) for (j, above), k in sorted(bounds.items())))
            found.setdefault(rule, None)
    return list(found)


def lasso_logistic(x: np.ndarray, labels: np.ndarray, penalty: float = 0.002, steps: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic regression, by accelerated proximal gradient."""
    n = len(labels)
    x = x.astype(np.float32)
    v = np.ones(x.shape[1], np.float32)
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= max(np.linalg.norm(v), 1e-12)
    rate = 1 / (0.25 * (float(v @ (x.T @ (x @ v))) / n + 1) + 1e-9)
    w, b = np.zeros(x.shape[1]), 0.0
    y_w, y_b, t = w.copy(), b, 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(x @ y_w.astype(np.float32) + y_b)))
        grad = x.T @ (p - labels).astype(np.float32) / n
        new_w = y_w - rate * grad
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - rate * penalty, 0)
        new_b = y_b - rate * float((p - labels).mean())
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y_w, y_b = new_w + (t - 1) / t_new * (new_w - w), new_b + (t - 1) / t_new * (new_b - b)
        w, b, t = new_w, new_b, t_new
    return w, b


def fit_rules(values: dict[str, np.ndarray], labels: np.ndarray, penalty: float = 0.002) -> RuleEnsemble:
    """The lasso over the trees' rules. The intercept alone, the log odds of the share of ones kept from 0.01 to 0.99, where
    there are no labels, labels of one class only, or no tree finds a split (few rows, or statistics that are all alike)."""
    rules = tree_rules(values, labels) if len(labels) > 1 and labels.min() < labels.max() else []
    if not rules:
        share = float(np.clip(labels.mean() if len(labels) else 0.5, 0.01, 0.99))
        return RuleEnsemble(intercept=float(np.log(share / (1 - share))))
    w, b = lasso_logistic(np.stack([r.holds(values) for r in rules], axis=1), labels, penalty)
    keep = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble([rules[k] for k in keep], [float(w[k]) for k in keep], b)


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", label_id_col: str = "doc_id", max_train_docs: int = MAX_TRAIN_DOCS) -> RuleEnsemble:
    """Fit on a sample of at most max_train_docs labelled documents; no label of the held-out fifth is read.

    Statistics reach the driver, one row a document: rows that share an id count once, by their smallest text. Null ids
    and null labels are left out; too few labels give the intercept alone, see fit_rules. Other columns are not read.
    """
    rows = labelled_texts(docs, labelled_sample(labels, label_col, label_id_col, max_train_docs), id_col, text_col)
    got = rows.select("doc_id", "label", text_statistics(F.col("text")).alias("s")).select("doc_id", "label", "s.*").orderBy("doc_id").toArrow()
    return fit_rules({n: got[n].to_numpy() for n in STATISTICS}, got["label"].to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """docs with (score, predicted); one projection, no shuffle and no Python.

    All rows stay, and all columns but those of docs that are named score or predicted, which the new ones replace.
    Null and empty texts are scored by their zero statistics; whole texts are read, however long.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    score = once(text_statistics(F.col(f"`{text_col}`")), lambda s: F.lit(1.0) / (F.lit(1.0) + F.exp(-model.margin(s))))
    return docs.select(*kept, score.alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of docs; other columns are not read.

    Null and empty texts are scored by their zero statistics, repeated rows each, whole texts however long; a null id is
    held out. Without labels every score is 0.5. An empty table gives an empty result.
    """
    narrow = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    scored = score_quality(narrow, fit_quality(narrow, labels))
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")
