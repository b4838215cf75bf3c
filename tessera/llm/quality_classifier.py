"""Operator 8, quality classifier: a sparse rule ensemble.

Boosted trees over statistics of the text give rules: each path from the root is a conjunction of
bounds. Lasso logistic regression weighs the rules and drops most of them. What is left is compiled
into one Spark column expression over the statistics.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import blocks, owner, prefix_hash, span_hash, sum_by, table, word_spans
from tessera.llm.quality_rules import word_statistics
from tessera.llm.training import held_out, labelled
from tessera.llm.trees import Leaf, Split, boost, sigmoid
from tessera.runtime import ship

NAMES = ("log_words", "word_bytes", "symbols", "pipes", "capitals", "exclamations", "stops", "digits", "dup_lines", "repeats", "distinct", "stutter", "lines", "ratio")


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


_KINDS = {"symbols": _mask("#*$%&<>~^_=+{}[]\\@"), "pipes": _mask("|"), "exclamations": _mask("!"), "stops": _mask(".,;:?"), "digits": _mask("0123456789"), "lines": _mask("\n")}
_UPPER, _LETTERS = _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")


def statistics(data: np.ndarray, offs: np.ndarray, z: zstandard.ZstdCompressor) -> np.ndarray:
    """A row of NAMES for each text of a block; a text without words has zeros for what is a share of words."""
    n = len(offs) - 1
    count = lambda mask: np.diff(np.searchsorted(np.flatnonzero(mask[data]), offs))
    base = word_statistics(data, offs)
    start, end, firsts = word_spans(data, offs)
    who, words = owner(firsts), np.maximum(base["n_words"], 1)
    h = span_hash(prefix_hash(data, fold=True), start, end)
    out = {"log_words": np.log1p(base["n_words"]), "word_bytes": sum_by(end - start, who, n) / words}
    out |= {k: count(mask) / words for k, mask in _KINDS.items()}
    out["capitals"] = count(_UPPER) / np.maximum(count(_LETTERS), 1)
    out["dup_lines"] = base["n_dup_lines"] / np.maximum(count(_KINDS["lines"]) + 1, 1)
    out["repeats"] = base["n_repeat_words"] / words
    order = np.lexsort((h, who))
    new = np.r_[True, (h[order][1:] != h[order][:-1]) | (who[order][1:] != who[order][:-1])] if len(h) else np.zeros(0, bool)
    out["distinct"] = np.bincount(who[order[new]], minlength=n) / words
    again = (h[1:] == h[:-1]) & (who[1:] == who[:-1])
    out["stutter"] = np.bincount(who[1:][again], minlength=n) / words
    raw = data.tobytes()
    out["ratio"] = np.array([(b - a) / len(z.compress(raw[a:b])) for a, b in zip(offs[:-1], offs[1:])])
    return np.stack([np.asarray(out[k], float) for k in NAMES], axis=1)


def with_statistics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of docs, and an array `__x` of the text's statistics."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=3)
        for b in batches:
            for lo, hi, data, offs in blocks(b.column("__text")):
                x = statistics(data, offs, z)
                xs = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in keep), xs], names=[*keep, "__x"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*(F.col(f"`{c}`") for c in keep), F.col("text").alias("__text")).mapInArrow(run, f"{kinds}, __x array<double>")


Rule = tuple[tuple[int, float, float], ...]  # (feature, over, up to) of each bound


def paths(tree: Leaf | Split, bounds: dict[int, tuple[float, float]] | None = None) -> Iterator[Rule]:
    """The conjunction that leads to each node but the root."""
    bounds = bounds or {}
    if bounds:
        yield tuple((f, lo, hi) for f, (lo, hi) in sorted(bounds.items()))
    if isinstance(tree, Split):
        lo, hi = bounds.get(tree.feature, (-np.inf, np.inf))
        yield from paths(tree.left, bounds | {tree.feature: (lo, min(hi, tree.at))})
        yield from paths(tree.right, bounds | {tree.feature: (max(lo, tree.at), hi)})


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    return np.logical_and.reduce([(x[:, f] > lo) & (x[:, f] <= hi) for f, lo, hi in rule])


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """Intercept and weights by accelerated proximal gradient; the intercept isn't penalised."""
    n, k = r.shape
    a = np.hstack([np.ones((n, 1)), r])
    step = 4 * n / max(np.linalg.norm(a, 2) ** 2, 1e-9)
    share = (y.sum() + 1) / (n + 2)
    w = np.r_[np.log(share / (1 - share)), np.zeros(k)]
    v, t = w.copy(), 1.0
    for _ in range(rounds):
        new = v - step * (a.T @ (sigmoid(a @ v) - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    return float(w[0]), w[1:]


@dataclass(frozen=True)
class RuleEnsemble:
    intercept: float
    rules: tuple[tuple[float, Rule], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.intercept + sum((w * holds(r, x) for w, r in self.rules), np.zeros(len(x))))

    def column(self, x: str = "__x") -> Column:
        """The score as an expression over the array of statistics."""
        total = F.lit(self.intercept)
        for w, rule in self.rules:
            bounds = [c for f, lo, hi in rule for c in ([F.col(x)[f] > lo] if lo > -np.inf else []) + ([F.col(x)[f] <= hi] if hi < np.inf else [])]
            held = bounds[0]
            for c in bounds[1:]:
                held = held & c
            total = total + F.when(held, w).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))

    def explain(self) -> list[str]:
        say = lambda f, lo, hi: f"{NAMES[f]} in ({lo:.4g}, {hi:.4g}]"
        return [f"{w:+.3f} if " + " and ".join(say(*b) for b in r) for w, r in sorted(self.rules, key=lambda x: -abs(x[0]))]


def fit_rules(x: np.ndarray, y: np.ndarray, rounds: int = 30, depth: int = 3, penalty: float = 1e-3, seed: int = 8) -> RuleEnsemble:
    """A rule ensemble; without rows or with one label, the smoothed share of label 1."""
    made = sorted({r for t in boost(x, y, rounds, depth, 0.3, 0.5, seed).trees for r in paths(t)})
    if not made:
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleEnsemble(float(np.log(share / (1 - share))), ())
    held = np.stack([holds(r, x) for r in made], axis=1).astype(float)
    intercept, weights = lasso_logistic(held, y, penalty)
    return RuleEnsemble(intercept, tuple((float(w), r) for w, r in zip(weights, made) if w))


def fit(docs: DataFrame, labels: DataFrame) -> RuleEnsemble:
    """Learns `labels.quality` from a bounded sample of labelled rows outside the held-out fold."""
    rows = with_statistics(labelled(docs, labels, "quality"), ["doc_id", "label"]).collect()
    rows.sort(key=lambda r: (r["doc_id"], r["__x"]))
    return fit_rules(np.array([r["__x"] for r in rows]).reshape(-1, len(NAMES)), np.array([r["label"] for r in rows]))


def score_quality(docs: DataFrame, labels: DataFrame, keep: list[str], threshold: float = 0.3) -> DataFrame:
    """Columns `keep` of docs, score (0 to 1, higher: better) and predicted (1 if score >= threshold).

    Every row of docs (doc_id, text) is scored by its text alone, a null one as an empty one. No
    usable labels give a constant score of 0.5, labels of one kind the smoothed share of label 1.
    An empty table gives no rows.
    """
    ship(docs.sparkSession)
    model = fit(docs, labels)
    scored = with_statistics(docs, keep).withColumn("__score", model.column())
    return scored.select(*(F.col(f"`{c}`") for c in keep), F.col("__score").alias("score"), (F.col("__score") >= threshold).cast("int").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of `documents`, learned outside the held-out fold; see score_quality."""
    out = score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")
