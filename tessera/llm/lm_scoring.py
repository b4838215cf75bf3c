"""Operator 9, LM scoring: a log-bilinear model trained by noise-contrastive estimation in numpy.

The model predicts a token's class from the classes of the two tokens before it: the context
vectors, scaled per position, add up to a prediction whose products with the classes' vectors, plus
biases, are the logits. Each of the most frequent tokens, as many as make up a share COVER of the
training tokens, is a class of its own; the others share classes by their last two bytes, within
which a token has its smoothed share. So every token has a normalised probability and the products
stay small.

1. Documents are dealt to trainers of about TRAINER bytes by a hash of id and text, in a fixed order,
   and packed (see packs.py); counts of all distinct tokens are gathered by hash bucket: a pack sends
   each of its distinct tokens once and gets the corpus counts back.
2. Each trainer's texts become classes once, in a row of its own. In each round every trainer runs NCE
   over its training texts from common parameters; over the rounds every position of every training
   text is an example once. Tasks add their trainers' parameters up as fixed-point numbers and send
   one array each, so the average doesn't depend on the order or on which task has which trainer.
3. Texts are scored: logits of a trainer's distinct contexts by batched matrix products.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import buffers, cut, free_shuffles, mix, owner, prefix_hash, span_hash, table, word_spans
from tessera.llm.packs import PACK, bucket_count, bucketwise
from tessera.llm.trees import sigmoid
from tessera.runtime import ship

TOP = 512  # classes of single tokens at least, the end among them
COVER = 0.5  # share of the training tokens that classes of single tokens make up, however many these are
MOST_TOP = 1 << 15  # and at most: what the model's size may be; tokens beyond are in shared classes
SHARED = 192  # classes of all others
TRAINER = 1 << 22  # bytes of text of a trainer
MOST_TASKS = 20_000  # tasks that deal trainers out; with more trainers a task has several, one after another
FIXED = 1 << 20  # parameters are added up in units of 1 / FIXED
DIMENSIONS = 24
ROUNDS = 2
NOISE = 64  # noise classes of a minibatch
BATCH = 4096
RATE = 0.08
FOLDS = 10
SMOOTH = 0.1
END = np.uint64(0xE0D0E0D0E0D0E0D1)


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % FOLDS == 0


@dataclass(frozen=True)
class Tokens:
    """Tokens of a pack, each text's end included, by way of its distinct ones."""

    doc: np.ndarray  # text of each token
    inverse: np.ndarray  # which distinct token it is
    value: np.ndarray  # hash of each distinct token, rising
    shared: np.ndarray  # the shared class it would be in
    n_docs: int
    train: np.ndarray  # of each text
    ids: list


def deal(docs: DataFrame) -> tuple[DataFrame, int]:
    """(trainer, pack, ids, offs, texts of each pack, how many trainers). Which text is in which pack, and where, depends on the rows alone."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    trainers = max(1, math.ceil((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) / TRAINER))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, now, n, size, parts, ids = zstandard.ZstdCompressor(level=3), None, 0, 0, [], []

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal n, size, parts, ids
            if parts:
                offs = np.r_[0, np.cumsum(np.concatenate([k for _, k in parts]))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([now], pa.int64()), pa.array([now << 20 | n], pa.int64()), pa.array([[x for i in ids for x in i.to_pylist()]], pa.list_(pa.int64())),
                     pa.array([offs.tolist()], pa.list_(pa.int64())), pa.array([z.compress(b"".join(d for d, _ in parts))], pa.binary())],
                    names=["trainer", "pack", "ids", "offs", "texts"],
                )
                n, size, parts, ids = n + 1, 0, [], []

        for b in batches:
            data, offs = buffers(b.column("text"))
            who = np.asarray(b.column("trainer"))
            ends, lo = np.r_[np.flatnonzero(who[1:] != who[:-1]) + 1, len(who)], 0
            for end in ends:
                if now != who[lo]:
                    yield from flush()
                    now, n = int(who[lo]), 0
                while lo < end:
                    hi = min(int(end), int(np.searchsorted(offs, offs[lo] + PACK - size, "left")))
                    hi = max(lo + 1, hi)
                    parts.append((data[offs[lo] : offs[hi]].tobytes(), np.diff(offs[lo : hi + 1])))
                    ids.append(b.column("doc_id").slice(lo, hi - lo))
                    size += int(offs[hi] - offs[lo])
                    lo = hi
                    if size >= PACK:
                        yield from flush()
        yield from flush()

    dealt = rows.withColumn("trainer", F.pmod(F.xxhash64("doc_id", "text"), F.lit(trainers)))
    dealt = dealt.repartition(min(trainers, MOST_TASKS), "trainer").sortWithinPartitions("trainer", "doc_id", "text")
    return dealt.mapInArrow(run, "trainer long, pack long, ids array<long>, offs array<long>, texts binary"), trainers


def tokens_of(r: dict) -> Tokens:
    keys, offs = r["ids"], np.array(r["offs"], np.int64)
    data = np.frombuffer(zstandard.decompress(r["texts"]) if offs[-1] else b"", np.uint8)
    start, end, firsts = word_spans(data, offs)
    n = len(offs) - 1
    h = span_hash(prefix_hash(data, fold=True), start, end) if len(start) else np.zeros(0, np.uint64)
    who = owner(firsts)
    every, doc = np.full(len(h) + n, END, np.uint64), np.zeros(len(h) + n, np.int64)
    last = np.zeros(len(h) + n, np.int64)  # where the word ends
    at = np.arange(len(h)) + who
    every[at], doc[at], last[at] = h, who, end
    doc[firsts[1:] + np.arange(n)] = np.arange(n)
    value, index, inverse = np.unique(every, return_index=True, return_inverse=True)
    e = last[index]
    tail = data[np.maximum(e - 1, 0)].astype(np.uint64) * np.uint64(256) + data[np.maximum(e - 2, 0)] if len(data) else np.zeros(len(e), np.uint64)
    shared = (mix(tail) % np.uint64(SHARED)).astype(np.int64)
    return Tokens(doc, inverse.ravel(), value, shared, n, np.array([not is_held_out(x) for x in keys], bool), keys)


def _packs(batches: Iterable[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def _by_bucket(value: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, bucket of each group, edges) of distinct tokens by bucket."""
    bucket = ((value >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.r_[True, bucket[order][1:] != bucket[order][:-1], True]) if len(order) else np.zeros(1, np.int64)
    return order, bucket[order][edges[:-1]], edges


@dataclass
class Model:
    """r: context vectors (the last for what is before a text), c: scales by position, q and bias: of predicted classes."""

    r: np.ndarray
    c: np.ndarray
    q: np.ndarray
    bias: np.ndarray

    @classmethod
    def start(cls, share: np.ndarray, seed: int = 9) -> Model:
        rng, n = np.random.default_rng(seed), len(share)
        vectors = lambda k: rng.normal(0, 0.1, (k, DIMENSIONS)).astype(np.float32)
        return cls(vectors(n + 1), np.ones((2, DIMENSIONS), np.float32), vectors(n), np.log(share).astype(np.float32))

    def parts(self) -> list[np.ndarray]:
        return [self.r, self.c, self.q, self.bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.parts()])

    def like(self, flat: np.ndarray) -> Model:
        cuts = np.cumsum([x.size for x in self.parts()])[:-1]
        return Model(*(x.reshape(y.shape).astype(np.float32) for x, y in zip(np.split(flat, cuts), self.parts())))

    def predicted(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return self.c[0] * self.r[one] + self.c[1] * self.r[two]

    def log_normaliser(self, one: np.ndarray, two: np.ndarray, step: int = 256) -> np.ndarray:
        """log of the sum of all classes' exponentials, for each context."""
        out = np.empty(len(one))
        sides = np.vstack([self.q.T, self.bias])
        for lo in range(0, len(one), step):
            p = self.predicted(one[lo : lo + step], two[lo : lo + step])
            logits = np.column_stack([p, np.ones(len(p), np.float32)]) @ sides
            with np.errstate(over="ignore"):
                total = np.exp(logits).sum(axis=1)
            out[lo : lo + step] = np.log(total, where=total > 0, out=np.zeros_like(total))
            far = np.flatnonzero(~((total > 1e-25) & (total < 1e25)))  # out of the range of floats, or near
            if len(far):
                top = logits[far].max(axis=1, keepdims=True)
                out[lo + far] = top[:, 0] + np.log(np.exp(logits[far] - top).sum(axis=1))
        return out

    def log_probability(self, target: np.ndarray, one: np.ndarray, two: np.ndarray, step: int = 1 << 16) -> np.ndarray:
        """Natural log of each target class's probability after its context."""
        key, inverse = np.unique(one.astype(np.int64) * len(self.r) + two, return_inverse=True)
        z = self.log_normaliser(key // len(self.r), key % len(self.r))
        out = self.bias[target].astype(np.float64) - z[inverse.ravel()]
        for lo in range(0, len(target), step):
            s = slice(lo, lo + step)
            out[s] += np.einsum("ij,ij->i", self.predicted(one[s], two[s]), self.q[target[s]])
        return out


def _add(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(at, kind="stable")
    first = np.flatnonzero(np.r_[True, at[order][1:] != at[order][:-1]])
    to[at[order][first]] += np.add.reduceat(rows[order], first, axis=0)


class Trainer:
    """NCE with AdaGrad. A minibatch shares its noise; noise and bias start from the classes' shares."""

    def __init__(self, model: Model, share: np.ndarray, seed: int):
        self.model = model.like(model.flat().copy())
        self.squares = [np.full(x.shape, 1e-3, np.float32) for x in self.model.parts()]
        self.log_noise = np.log(NOISE * share).astype(np.float32)
        self.noise, self.rng = np.cumsum(share), np.random.default_rng(seed)
        self.examples = 0

    def batch(self, target: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
        m, n = self.model, len(target)
        drawn = np.searchsorted(self.noise, self.rng.random(NOISE) * self.noise[-1]).clip(0, len(m.q) - 1)
        p = m.predicted(one, two)
        good = sigmoid(np.einsum("ij,ij->i", p, m.q[target]) + m.bias[target] - self.log_noise[target]) - 1
        bad = sigmoid(p @ m.q[drawn].T + m.bias[drawn] - self.log_noise[drawn])
        d = good[:, None] * m.q[target] + bad @ m.q[drawn]  # gradient of the prediction
        grads = [np.zeros_like(x) for x in m.parts()]
        _add(grads[0], one, d * m.c[0])
        _add(grads[0], two, d * m.c[1])
        grads[1][0], grads[1][1] = (d * m.r[one]).sum(axis=0), (d * m.r[two]).sum(axis=0)
        _add(grads[2], target, good[:, None] * p)
        np.add.at(grads[2], drawn, bad.T @ p)
        grads[3] += np.bincount(target, good, len(m.bias)).astype(np.float32)
        np.add.at(grads[3], drawn, bad.sum(axis=0).astype(np.float32))
        for x, g, s in zip(m.parts(), grads, self.squares):
            g /= np.sqrt(n)
            s += g * g
            x -= RATE * g / np.sqrt(s)
        self.examples += n


@dataclass(frozen=True)
class Vocabulary:
    """Hashes of the tokens with a class of their own, rising, and counts of the shared classes."""

    top: np.ndarray
    shared_tokens: np.ndarray  # training tokens of each shared class
    shared_distinct: np.ndarray
    share: np.ndarray  # smoothed share of every class
    tokens: int
    distinct: int

    def classes(self, t: Tokens) -> np.ndarray:
        """Class of each distinct token of a pack."""
        at = np.searchsorted(self.top, t.value).clip(0, len(self.top) - 1)
        return np.where(self.top[at] == t.value, at, len(self.top) + t.shared)

    def contexts(self, cls: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(class before, class before that) of each token; before a text there is a class of its own."""
        none = len(self.share)
        one, two = np.full(len(cls), none, cls.dtype), np.full(len(cls), none, cls.dtype)
        same = doc[1:] == doc[:-1]
        one[1:] = np.where(same, cls[:-1], none)
        two[2:] = np.where(same[1:] & same[:-1], cls[:-2], none)
        return one, two


def _counted(packs: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(answers, totals): counts that go back to packs, and what each bucket adds to the vocabulary."""

    def send(batches):
        z, kinds = zstandard.ZstdCompressor(level=1), pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("n", pa.int32()), ("blob", pa.binary())])
        for r in _packs(batches):
            t = tokens_of(r)
            own = np.bincount(t.inverse[t.train[t.doc]], minlength=len(t.value)).astype("<u4")
            order, bucket, edges = _by_bucket(t.value, buckets)
            rows = []
            for w, lo, hi in zip(bucket, edges[:-1], edges[1:]):
                at = order[lo:hi]
                blob = t.value[at].astype("<u8").tobytes() + z.compress(own[at].tobytes() + t.shared[at].astype("<u2").tobytes())
                rows.append({"bucket": int(w), "pack": r["pack"], "n": int(hi - lo), "blob": blob})
            yield pa.RecordBatch.from_pylist(rows, kinds)

    def add(bucket, rows):
        z = zstandard.ZstdCompressor(level=1)
        value = np.concatenate([np.frombuffer(r["blob"][: 8 * r["n"]], "<u8") for r in rows])
        rest = [zstandard.decompress(r["blob"][8 * r["n"] :]) for r in rows]
        own = np.concatenate([np.frombuffer(x[: 4 * r["n"]], "<u4") for x, r in zip(rest, rows)]).astype(np.float64)
        shared = np.concatenate([np.frombuffer(x[4 * r["n"] :], "<u2") for x, r in zip(rest, rows)])
        distinct, index, inverse = np.unique(value, return_index=True, return_inverse=True)
        total = np.bincount(inverse.ravel(), own, len(distinct)).astype(np.int64)
        edge = np.cumsum([0, *(r["n"] for r in rows)])
        sent = total[inverse.ravel()]
        out = [{"pack": r["pack"], "bucket": bucket, "blob": z.compress(sent[a:b].astype("<i8").tobytes())} for r, a, b in zip(rows, edge[:-1], edge[1:])]
        known, cls = total > 0, shared[index]
        sums = np.stack([np.bincount(cls[known], total[known], SHARED), np.bincount(cls[known], minlength=SHARED)]).astype("<i8")
        words = np.stack([distinct[known].view(np.int64), total[known], cls[known].astype(np.int64)]).astype("<i8")
        out.append({"pack": None, "bucket": bucket, "blob": sums.tobytes() + z.compress(words.tobytes())})
        yield pa.RecordBatch.from_pylist(out, pa.schema([("pack", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())]))

    sent = packs.mapInArrow(send, "bucket int, pack long, n int, blob binary")
    dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "pack")
    added = cut(dealt.mapInArrow(lambda it: bucketwise(it, add), "pack long, bucket int, blob binary"), "counts")
    return added.where("pack IS NOT NULL"), added.where("pack IS NULL")


def _own_classes(counts: list[tuple[int, int]]) -> int:
    """How many of the most frequent tokens make up COVER of all, or TOP; counts: (n, tokens that occur n times)."""
    left, size = COVER * sum(n * words for n, words in counts), 1  # the end may be rare
    for n, words in sorted(counts, reverse=True):
        take = min(words, max(0, math.ceil(left / n)))
        left, size = left - take * n, size + take
    return max(TOP, size)


def _vocabulary(totals: DataFrame) -> Vocabulary:
    """Adds the buckets' sums up in the plan; the driver gets one row per shared class and per count, and the most frequent tokens."""

    def sums(batches):
        for b in batches:
            for blob in b.column("blob").to_pylist():
                x = np.frombuffer(blob[: 16 * SHARED], "<i8").reshape(2, SHARED)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(SHARED)), pa.array(x[0]), pa.array(x[1])], names=["cls", "tokens", "distinct"])

    def tops(batches):
        for b in batches:
            for blob in b.column("blob").to_pylist():
                x = np.frombuffer(zstandard.decompress(blob[16 * SHARED :]), "<i8").reshape(3, -1)
                yield pa.RecordBatch.from_arrays([pa.array(y) for y in x], names=["token", "n", "cls"])

    by_class = {r["cls"]: r for r in totals.mapInArrow(sums, "cls long, tokens long, distinct long").groupBy("cls").agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).collect()}
    words = totals.mapInArrow(tops, "token long, n long, cls long")
    size = min(MOST_TOP, _own_classes([(r["n"], r["words"]) for r in words.groupBy("n").agg(F.count(F.lit(1)).alias("words")).collect()]))
    top = words.orderBy(F.col("token") != int(END.astype(np.int64)), F.desc("n"), "token").limit(size).collect()
    tokens = np.array([by_class[k]["tokens"] if k in by_class else 0 for k in range(SHARED)], float)
    distinct = np.array([by_class[k]["distinct"] if k in by_class else 0 for k in range(SHARED)], float)
    everything = int(tokens.sum()), int(distinct.sum())
    for r in top:
        tokens[r["cls"]] -= r["n"]
        distinct[r["cls"]] -= 1
    found = {r["token"] & (1 << 64) - 1: r["n"] for r in top} or {int(END): 0}
    values = np.array(sorted(found), np.uint64)
    counts = np.r_[[found[int(v)] + SMOOTH for v in values], tokens + SMOOTH * (distinct + 1)]
    return Vocabulary(values, tokens, distinct, counts / counts.sum(), *everything)


def examples(train: np.ndarray, doc: np.ndarray, k: int, rounds: int) -> np.ndarray:
    """Positions of a trainer's training texts that round k takes: all of them over the rounds, each once."""
    return np.flatnonzero(train[doc])[k::rounds]


_ENCODED = pa.schema([("trainer", pa.int64()), ("ids", pa.list_(pa.int64())), ("tokens", pa.list_(pa.int32())), ("known", pa.list_(pa.int32())), ("base", pa.list_(pa.float64())), ("inside", pa.list_(pa.float64())), ("classes", pa.binary())])


def encoded(packs: DataFrame, answers: DataFrame, vocabulary: Vocabulary, buckets: int, trainers: int) -> DataFrame:
    """A row per trainer: its texts' ids, numbers of tokens and of known ones, base scores, logs of shares within classes, and all classes.

    A pack meets the counts that its buckets sent, which are sorted to come before it.
    """
    sent = packs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, z, now = sent.value, zstandard.ZstdCompressor(level=1), None
        base_total = v.tokens + SMOOTH * (v.distinct + 1)
        held: dict[str, list] = {}
        said: dict[int, bytes] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                row = {c: np.concatenate(x) if c != "ids" else [i for k in x for i in k] for c, x in held.items()}
                row["classes"] = z.compress(row["classes"].astype("<u4").tobytes())
                yield pa.RecordBatch.from_pylist([{"trainer": now} | row], _ENCODED)
                held.clear()

        for r in _packs(batches):
            if r["trainer"] != now:
                yield from flush()
                now = r["trainer"]
            if r["texts"] is None:
                said[r["bucket"]] = r["blob"]
                continue
            t = tokens_of(r)
            order, bucket, edges = _by_bucket(t.value, buckets)
            count = np.zeros(len(t.value), np.int64)
            for w, lo, hi in zip(bucket, edges[:-1], edges[1:]):
                count[order[lo:hi]] = np.frombuffer(zstandard.decompress(said[int(w)]), "<i8")
            said.clear()
            own = v.classes(t)
            inside = np.zeros(len(own))  # log of the token's share of its class
            shared = own >= len(v.top)
            c = own[shared] - len(v.top)
            inside[shared] = np.log((count[shared] + SMOOTH) / (v.shared_tokens[c] + SMOOTH * (v.shared_distinct[c] + 1)))
            total = lambda x: np.bincount(t.doc, x[t.inverse], t.n_docs)  # noqa: B023, E731
            sums = (np.bincount(t.doc, minlength=t.n_docs).astype(np.int32), total(count > 0).astype(np.int32), total(np.log10((count + SMOOTH) / base_total)), total(inside))
            for name, x in zip(("ids", "tokens", "known", "base", "inside", "classes"), (t.ids, *sums, own[t.inverse])):
                held.setdefault(name, []).append(x)
        yield from flush()

    none = lambda kind: F.lit(None).cast(kind)
    asked = packs.select("trainer", "pack", "ids", "offs", "texts", none("int").alias("bucket"), none("binary").alias("blob"))
    told = answers.select(F.shiftright("pack", 20).alias("trainer"), "pack", none("array<long>"), none("array<long>"), none("binary"), "bucket", "blob")
    dealt = asked.union(told).repartition(min(trainers, MOST_TASKS), "trainer").sortWithinPartitions("trainer", "pack", F.col("bucket").asc_nulls_last())
    return dealt.mapInArrow(run, "trainer long, ids array<long>, tokens array<int>, known array<int>, base array<double>, inside array<double>, classes binary")


def _texts(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """(class, text) of each token of a trainer."""
    cls = np.frombuffer(zstandard.decompress(r["classes"]), "<u4").astype(np.int32)
    return cls, np.repeat(np.arange(len(r["tokens"]), dtype=np.int32), r["tokens"])


def _total(blobs: Iterable[bytes]) -> np.ndarray | None:
    out = None
    for x in blobs:
        x = np.frombuffer(x, "<i8").reshape(2, -1)
        out = x.copy() if out is None else out + x
    return out


def _fixed(flat: np.ndarray, n: int) -> np.ndarray:
    """n times the parameters, and n, as two halves of whole numbers of 1 / FIXED each: their sums are exact for any number of trainers."""
    x = np.append(np.rint(np.clip(flat.astype(np.float64), -1024, 1024) * FIXED), FIXED).astype(np.int64) * n
    return np.stack([x >> 24, x & ((1 << 24) - 1)])


def train(texts: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS) -> Model:
    """NCE by all trainers; parameters are averaged after each round, by examples."""
    spark, model = texts.sparkSession, Model.start(vocabulary.share)
    for k in range(rounds):
        sent = spark.sparkContext.broadcast((model, vocabulary))

        def run(batches: Iterable[pa.RecordBatch], k=k, sent=sent) -> Iterator[pa.RecordBatch]:
            model, vocabulary = sent.value
            total = None
            for r in _packs(batches):
                trainer = Trainer(model, vocabulary.share, [9, k, r["trainer"]])
                cls, doc = _texts(r)
                one, two = vocabulary.contexts(cls, doc)
                own = np.array([not is_held_out(x) for x in r["ids"]], bool)
                at = trainer.rng.permutation(examples(own, doc, k, rounds))
                for lo in range(0, len(at), BATCH):
                    trainer.batch(*(x[at[lo : lo + BATCH]] for x in (cls, one, two)))
                if trainer.examples:
                    x = _fixed(trainer.model.flat(), trainer.examples)
                    total = x if total is None else total + x
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["sums"])

        def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = _total(x for b in batches for x in b.column("sums").to_pylist())
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array([total.astype("<i8").tobytes()], pa.binary())], names=["sums"])

        trained = texts.select("trainer", "ids", "tokens", "classes").mapInArrow(run, "sums binary")
        added = trained.repartition(16).mapInArrow(add, "sums binary").repartition(1).mapInArrow(add, "sums binary")
        total = _total(r["sums"] for r in added.collect())
        if total is None:
            break
        flat = total[0].astype(np.float64) * (1 << 24) + total[1]
        model = model.like(flat[:-1] / flat[-1])
    return model


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row of docs (doc_id, text).

    Learned from the rows that aren't held out (crc32 of doc_id as text, mod 10, is not 0; a row
    without doc_id isn't held out). Tokens are words, A-Z lower-cased, then an end per text; a null
    text has only that. base_score is the smoothed unigram model's log10 probability, score the
    model's. Without training rows both are those of models that know no token. Repeated rows count
    as often; of tokens as frequent as the last that gets a class of its own, those with the least
    hashes do. The same rows give the same scores in whatever order and partitions they come. Other
    columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    ship(spark)
    packs, trainers = deal(docs)
    packs = cut(packs, "packs")
    buckets = bucket_count(packs)
    answers, totals = _counted(packs, buckets)
    vocabulary = _vocabulary(totals)
    free_shuffles(spark)
    texts = cut(encoded(packs, answers, vocabulary, buckets, trainers), "encoded")
    free_shuffles(spark)
    sent = spark.sparkContext.broadcast((train(texts, vocabulary), vocabulary))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, v = sent.value
        for r in _packs(batches):
            cls, doc = _texts(r)
            n = len(r["ids"])
            score = np.bincount(doc, model.log_probability(cls, *v.contexts(cls, doc)), n)
            cols = [
                pa.array(r["ids"], pa.int64()), pa.array([is_held_out(x) for x in r["ids"]]), pa.array(r["tokens"], pa.int64()), pa.array(r["known"], pa.int64()),
                pa.array(np.full(n, v.tokens, np.int64)), pa.array(r["base"], pa.float64()), pa.array((score + np.array(r["inside"])) / np.log(10)),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return texts.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every whole text of `documents` by a model of those that aren't held out; see score_texts."""
    return score_texts(table(spark, sf_dir, "documents"))
