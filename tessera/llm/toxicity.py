"""Operator 6, toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Words are compared as they are and in a skeleton that undoes obfuscation: letters and digits only,
digits and signs that stand for letters put back, runs of one letter as one. Besides a fixed
lexicon there is a learned one: words far more common in documents labelled 1.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import blocks, owner, prefix_hash, span_hash, sum_by, table, word_spans
from tessera.llm.training import held_out, labelled
from tessera.llm.trees import Boosted, boost, isotonic, sigmoid
from tessera.runtime import ship

LEXICON = tuple(
    "trash pathetic idiot idiots worthless disgusting stupid clown loser losers scum moron morons dumb fool ugly hate garbage jerk vermin filth creep imbecile "
    "dummkopf arschloch trottel idioten abschaum connard salaud imbécile crétin ordure idiota estúpido imbécil basura asqueroso".split()
)
SECOND_PERSON = tuple("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta vous votre tú ti usted ustedes vosotros".split())
NAMES = ("lexicon", "log_hits", "obfuscated", "learned", "learned_most", "proximity", "second_person", "capitals", "exclamations", "stops", "marks_inside", "digits_inside", "log_words")
LEARNED = 200

_SKELETON = np.zeros(256, np.uint8)  # 0: left out
_SKELETON[97:123] = np.arange(97, 123)
_SKELETON[65:91] = np.arange(97, 123)
_SKELETON[128:] = np.arange(128, 256)
for _from, _to in zip("0134578@$!", "oieastbasi"):
    _SKELETON[ord(_from)] = ord(_to)
_SIGN = np.zeros(256, bool)
_SIGN[list(b"@$!")] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


@dataclass(frozen=True)
class Words:
    """Words of a block: the text each is of, the hash of its core as it is and of its skeleton."""

    who: np.ndarray
    counts: np.ndarray
    plain: np.ndarray
    skeleton: np.ndarray
    marks: np.ndarray  # other signs within the core
    digits: np.ndarray
    start: np.ndarray
    end: np.ndarray


def words_of(data: np.ndarray, offs: np.ndarray) -> Words:
    """The core of a word goes from its first to its last letter or digit; a word without any is none."""
    start, end, firsts = word_spans(data, offs)
    solid = np.flatnonzero(_PLAIN[data] | _DIGIT[data])
    a, b = np.searchsorted(solid, start), np.searchsorted(solid, end)
    some = b > a
    start, end = solid[a[some]], solid[b[some] - 1] + 1
    who = owner(firsts)[some]
    kept = _SKELETON[data]
    sign = _SIGN[data]
    first = np.zeros(len(data) + 1, bool)
    first[start] = True
    last = np.zeros(len(data) + 1, bool)
    last[end - 1] = True
    used = kept > 0
    squeezed = np.zeros(len(data), bool)  # same letter as the one kept before it in this word
    at = np.flatnonzero(used)
    begin = np.searchsorted(at, start)
    opens = np.zeros(len(at) + 1, bool)
    opens[begin] = True
    squeezed[at[1:]] = (kept[at[1:]] == kept[at[:-1]]) & ~opens[1:-1] & (kept[at[1:]] < 128)
    used &= ~squeezed
    at = np.flatnonzero(used)
    c = prefix_hash(kept[at], fold=False)
    skeleton = span_hash(c, np.searchsorted(at, start), np.searchsorted(at, end))
    plain = span_hash(prefix_hash(data, fold=True), start, end)
    total = lambda mask: np.diff(np.r_[0, np.cumsum(mask)][np.stack([start, end])], axis=0)[0]
    return Words(who, np.bincount(who, minlength=len(offs) - 1), plain, skeleton, total(~_PLAIN[data] & ~_DIGIT[data] | sign), total(_DIGIT[data]), start, end)


@cache
def hashes(words: tuple[str, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Plain and skeleton hashes of some words."""
    found = [words_of(d, o) for _, _, d, o in blocks(pa.array([" ".join(words)], pa.string()))]
    return np.unique(found[0].plain), np.unique(found[0].skeleton)


def features(data: np.ndarray, offs: np.ndarray, learned: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """A row of NAMES for each text; a text without words has zeros. learned: sorted skeleton hashes, weights."""
    n = len(offs) - 1
    w = words_of(data, offs)
    words = np.maximum(w.counts, 1)
    plain, skeleton = hashes(LEXICON)
    is_plain, is_hit = np.isin(w.plain, plain), np.isin(w.skeleton, skeleton)
    you = np.isin(w.plain, hashes(SECOND_PERSON)[0])
    place = np.searchsorted(learned[0], w.skeleton).clip(0, max(len(learned[0]) - 1, 0))
    weight = np.where(learned[0][place] == w.skeleton, learned[1][place], 0.0) if len(learned[0]) else np.zeros(len(w.who))
    hits = sum_by(is_hit, w.who, n)
    at = np.flatnonzero(is_hit)
    near = np.full(len(at), 1e9)
    spots = np.flatnonzero(you)
    if len(spots):
        for side in (-1, 0):
            k = (np.searchsorted(spots, at) + side).clip(0, len(spots) - 1)
            near = np.minimum(near, np.where(w.who[spots[k]] == w.who[at], np.abs(spots[k] - at), 1e9))
    most = np.zeros(n)
    np.maximum.at(most, w.who, weight)
    count = lambda mask: np.diff(np.searchsorted(np.flatnonzero(mask[data]), offs))
    marks = lambda chars: np.isin(np.arange(256), list(chars.encode()))
    out = {
        "lexicon": hits / words, "log_hits": np.log1p(hits), "obfuscated": sum_by(is_hit & ~is_plain, w.who, n) / words,
        "learned": np.bincount(w.who, weight, n) / words, "learned_most": most, "proximity": np.bincount(w.who[at], np.exp(-near / 5), n) / np.maximum(hits, 1),
        "second_person": sum_by(you, w.who, n) / words, "capitals": count(_CAPITAL) / np.maximum(count(_PLAIN), 1), "exclamations": count(marks("!")) / words,
        "stops": count(marks(".,;:?")) / words, "marks_inside": sum_by(w.marks > 0, w.who, n) / words, "digits_inside": sum_by((w.digits > 0) & (w.digits < w.end - w.start), w.who, n) / words,
        "log_words": np.log1p(w.counts),
    }
    return np.stack([np.asarray(out[k], float) for k in NAMES], axis=1)


def learn_lexicon(train: DataFrame, most: int = LEARNED, least_share: float = 0.03) -> tuple[np.ndarray, np.ndarray]:
    """Skeleton hashes of words that are far more common in documents with label 1, and their log odds.

    A word must be in `least_share` of those documents, and in 8 at least, and four times as often
    as in the others. At most `most` words, those with the greatest log odds.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in blocks(b.column("text")):
                w = words_of(data, offs)
                label = np.asarray(b.column("label"))[lo:hi]
                order = np.lexsort((w.skeleton, w.who))
                s, who = w.skeleton[order], w.who[order]
                new = np.r_[True, (s[1:] != s[:-1]) | (who[1:] != who[:-1])] if len(s) else np.zeros(0, bool)
                value, inverse = np.unique(s[new], return_inverse=True)
                ones = np.bincount(inverse, label[who[new]], len(value))
                every = np.bincount(inverse, minlength=len(value))
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(ones.astype(np.int64)), pa.array(every.astype(np.int64))], names=["word", "ones", "every"])

    ones, every = train.agg(F.sum("label"), F.count(F.lit(1))).first()
    ones, zeros = int(ones or 0), int(every) - int(ones or 0)
    counts = train.select("text", "label").mapInArrow(run, "word long, ones long, every long").groupBy("word").agg(F.sum("ones").alias("ones"), F.sum("every").alias("every"))
    odds = F.log(((F.col("ones") + 0.5) / (ones + 1)) / ((F.col("every") - F.col("ones") + 0.5) / (zeros + 1)))
    found = counts.where(F.col("ones") >= max(8, least_share * ones)).withColumn("odds", odds).where(F.col("odds") >= float(np.log(4)))
    rows = sorted((r["word"] & (1 << 64) - 1, r["odds"]) for r in found.orderBy(F.desc("odds"), "word").limit(most).collect())
    return np.array([w for w, _ in rows], np.uint64), np.array([o for _, o in rows], float)


@dataclass(frozen=True)
class ToxicityModel:
    learned: tuple[np.ndarray, np.ndarray]
    trees: Boosted
    knots: tuple[np.ndarray, np.ndarray]

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.trees.raw(x)
        return np.interp(raw, *self.knots).clip(0, 1) if len(self.knots[0]) else sigmoid(raw)


def _feature_rows(docs: DataFrame, keep: list[str], learned: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in blocks(b.column("text")):
                x = features(data, offs, learned)
                xs = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1) * len(NAMES), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in keep), xs], names=[*keep, "x"])

    kinds = ", ".join(f"{c} {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select("text", *keep).mapInArrow(run, f"{kinds}, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, rounds: int = 80, depth: int = 3, rate: float = 0.1, folds: int = 3) -> ToxicityModel:
    """Learns `labels.toxic` from a bounded sample of labelled rows outside the held-out fold.

    The calibration sees scores of trees that were fitted on the other folds of the sample.
    """
    train = labelled(docs, labels, "toxic")
    learned = learn_lexicon(train)
    rows = sorted(_feature_rows(train, ["doc_id", "label"], learned).collect(), key=lambda r: (r["doc_id"], r["x"]))
    x, y = np.array([r["x"] for r in rows]).reshape(-1, len(NAMES)), np.array([r["label"] for r in rows], float)
    trees = boost(x, y, rounds, depth, rate, 0.7, 6)
    knots = (np.zeros(0), np.zeros(0))
    if trees.trees and len(y) >= 10 * folds:
        fold, raw = np.random.default_rng(6).integers(0, folds, len(y)), np.zeros(len(y))
        for k in range(folds):
            raw[fold == k] = boost(x[fold != k], y[fold != k], rounds, depth, rate, 0.7, 6).raw(x[fold == k])
        knots = isotonic(raw, y)
    return ToxicityModel(learned, trees, knots)


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: likelier toxic), predicted (1 if score >= threshold).

    Every row of docs (doc_id, text) is scored by its whole text alone, a null one as an empty one.
    No usable labels give a constant score of 0.5. An empty table gives no rows.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, data, offs in blocks(b.column("text")):
                score = model.value.score(features(data, offs, model.value.learned))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every whole text of `documents`, learned outside the held-out fold; see score_toxicity."""
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
