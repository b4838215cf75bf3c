"""Operator 2, benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

1. Document frequencies of all n-grams of the benchmark are counted over all documents.
2. Seeds of an item are its rare n-grams, and of every `spread` n-grams in a row the rarest one,
   so a passage that very many documents copied keeps its seeds.
3. Where a document has a seed, the item is aligned with the words around it. A pair whose local
   alignment reaches `least` of a perfect one is contaminated.

Texts aren't shuffled. Seeds are broadcast; a benchmark of more than SLICE n-grams is worked off in
slices of its items, each with a scan of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import blocks, buffers, gram_hash, mix, owner, prefix_hash, span_hash, table, word_spans
from tessera.runtime import ship

NGRAM = 3
SPREAD = 3
#: An n-gram is rare in so many documents, or this share of them if that is more.
RARE, RARE_SHARE = 20, 1e-4
SLICE = 4_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: An n-gram that so many items share is a seed of an item only if the item has no other.
SHARED_ITEMS = 1000
_LETTER = np.zeros(256, bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def folded(texts: pa.Array) -> pa.Array:
    """Case-folded by Unicode's rules."""
    return pa.array(["" if t is None else t.casefold() for t in texts.to_pylist()], pa.large_string())


def _marks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of letters, bytes of characters that are tokens by themselves).

    By the first bytes of their UTF-8: Thai and Lao (E0 B8 to BB), Burmese (E1 80 to 82), Khmer (E1 9E, 9F),
    kana, ideographs and their kin (E2 BA to E9 BF, EF A4 to AB, F0 A0 to B1). Punctuation of these
    scripts and of General Punctuation (E2 80, E3 80 80 to 83, EF BC and BD other than letters and digits) is none.
    """
    solid, alone = _LETTER[data], np.zeros(len(data), bool)
    if len(data) < 3:
        return solid, alone
    lead = np.flatnonzero(data[:-2] >= 0xE0)
    if not len(lead):
        return solid, alone
    a, b, c = (data[lead + k].astype(np.int32) for k in range(3))
    two = (a << 8) | b
    single = ((two >= 0xE0B8) & (two <= 0xE0BB)) | ((two >= 0xE180) & (two <= 0xE182)) | (two == 0xE19E) | (two == 0xE19F)
    single |= ((two >= 0xE2BA) & (two <= 0xE9BF)) | ((two >= 0xEFA4) & (two <= 0xEFAB)) | ((two >= 0xF0A0) & (two <= 0xF0B1))
    wide = (two == 0xEFBC) & (((c >= 0x90) & (c <= 0x99)) | ((c >= 0xA1) & (c <= 0xBA))) | (two == 0xEFBD) & (((c >= 0x81) & (c <= 0x9A)) | (c >= 0xA6))
    mark = (two == 0xE280) | ((two == 0xE380) & (c <= 0x83)) | ((two == 0xE380) & (c >= 0x88) & (c <= 0x9F)) | (((two == 0xEFBC) | (two == 0xEFBD)) & ~wide)
    size = np.where(a >= 0xF0, 4, 3)
    for k in range(4):
        own = (size > k) & (lead + k < len(data))
        alone[lead[own & single & ~mark] + k] = True
        solid[lead[own & mark] + k] = False
    return solid, alone


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters and digits, and where each text's begin.

    In scripts that are written without spaces each character is a token.
    """
    solid, alone = _marks(data)
    start, end, firsts = word_spans(data, offs, solid, alone)
    return span_hash(prefix_hash(data, fold=False), start, end), firsts


def grams_of(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` tokens in a row, apart from those of other sizes."""
    return gram_hash(h, size) if size == NGRAM else mix(gram_hash(h, size) ^ np.uint64(size))


class Lookup:
    """Finds values of a fixed set in an array; a bitmap turns most others away first."""

    def __init__(self, values: np.ndarray, sizes: Sequence[int] = (NGRAM,)):
        self.values, self.sizes = np.unique(values), tuple(sizes)
        self.map = np.zeros(1 << 20, bool)
        self.map[(self.values >> np.uint64(44)).astype(np.int64)] = True

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in x, which value) of those found."""
        at = np.flatnonzero(self.map[(x >> np.uint64(44)).astype(np.int64)])
        which = np.searchsorted(self.values, x[at])
        which[which == len(self.values)] = 0
        ok = self.values[which] == x[at] if len(self.values) else np.zeros(len(at), bool)
        return at[ok], which[ok]


def _hits(data: np.ndarray, offs: np.ndarray, lookup: Lookup) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes and firsts of a block; place, document and value of each n-gram that is looked for."""
    h, firsts = tokens(data, offs)
    who, parts = owner(firsts), []
    for size in lookup.sizes:
        at, which = lookup.find(grams_of(h, size))
        whole = who[at] == who[at + size - 1]
        parts.append((at[whole], which[whole]))
    at, which = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2
    return h, firsts, at, who[at], which


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Best local alignment: (score, start, end) within words; ties go to the first end."""
    n = len(words)
    step = -GAP * np.arange(n + 1)
    row, best, end = np.zeros(n + 1, np.int64), 0, 0
    origin = np.arange(n + 1)
    start = 0
    for w in item:
        diagonal = row[:-1] + np.where(words == w, MATCH, MISMATCH)
        up = row[1:] + GAP
        cell = np.r_[0, np.maximum(0, np.maximum(diagonal, up))]
        came = np.r_[0, np.where(cell[1:] == 0, np.arange(1, n + 1), np.where(diagonal >= up, origin[:-1], origin[1:]))]
        reach = np.maximum.accumulate(cell + step)  # a gap in the item: the best so far to the left, less its length
        left = reach - step
        source = np.maximum.accumulate(np.where(cell + step == reach, np.arange(n + 1), 0))
        row, origin = left, np.where(left > cell, came[source], came)
        if (top := int(row.max())) > best:
            end = int(row.argmax())
            best, start = top, int(origin[end])
    return best, start, end


def needed(m: int, least: float) -> float:
    """Score that makes an item of m tokens a match: a share of the perfect one, and six tokens or all."""
    return max(least * MATCH * m, MATCH * min(m, 6))


def _item_seeds(items: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[int, ...]]:
    """(n-gram, item, place) of every n-gram of the items, and their sizes. An item of fewer tokens is one n-gram, the whole of it."""
    sizes = [min(NGRAM, len(h)) for h in items]
    grams = [grams_of(h, n) if n else h for h, n in zip(items, sizes)]
    return (
        np.concatenate(grams) if grams else np.zeros(0, np.uint64),
        np.repeat(np.arange(len(items)), [len(g) for g in grams]),
        np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.zeros(0, np.int64),
        tuple(sorted(set(sizes) - {0})),
    )


def rare(item: np.ndarray, frequency: np.ndarray, limit: float, shared: np.ndarray | None = None, short: np.ndarray | None = None) -> np.ndarray:
    """Which n-grams are seeds, given each one's item, document frequency and whether very many items share it.

    In order. Shared ones are seeds only of items that have no other; the one n-gram of a short item
    is a seed only if it is rare.
    """
    shared = np.zeros(len(item), bool) if shared is None else shared
    short = np.zeros(len(item), bool) if short is None else short
    keep = (frequency <= limit) & ~shared
    begin = np.flatnonzero(np.r_[True, item[1:] != item[:-1]]) if len(item) else np.zeros(0, np.int64)
    for a, b in zip(begin, np.r_[begin[1:], len(item)]):
        if short[a]:
            keep[a] = frequency[a] <= limit
            continue
        only = shared[a:b].all()
        f = frequency[a:b] if only else np.where(shared[a:b], np.iinfo(np.int64).max, frequency[a:b])
        for k in range(max(1, b - a - SPREAD + 1)):
            best = a + k + int(np.argmin(f[k : k + SPREAD]))
            keep[best] |= only or not shared[best]
    return keep


def _documents_with(docs: DataFrame, grams: np.ndarray, sizes: Sequence[int]) -> dict[int, int]:
    """In how many documents each n-gram occurs, a row each for those that occur."""
    lookup = docs.sparkSession.sparkContext.broadcast(Lookup(grams, sizes))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values = lookup.value.values
        counts = np.zeros(len(values), np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                for lo, hi, data, offs in blocks(folded(b.column("text").slice(at, 512))):
                    _, _, _, who, which = _hits(data, offs, lookup.value)
                    pairs = np.unique(who.astype(np.int64) * len(values) + which)
                    counts += np.bincount(pairs % max(1, len(values)), minlength=len(values))
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(values[some].view(np.int64)), pa.array(counts[some])], names=["gram", "n"])

    counted = docs.select("text").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return {r["gram"] & (1 << 64) - 1: r["n"] for r in counted.collect()}


@dataclass(frozen=True)
class Seeds:
    """What tasks need: seeds, where those of each value begin, their items and places, distinct items, and the ids of each."""

    lookup: Lookup
    edges: np.ndarray
    item: np.ndarray
    place: np.ndarray
    items: list[np.ndarray]
    names: list[list]

    def found(self, texts: pa.Array, least: float) -> list[tuple]:
        """(row, item, score, first token, tokens) of each row that holds a copy of a distinct item."""
        out = []
        for lo, hi, data, offs in blocks(folded(texts)):
            h, firsts, where, who, which = _hits(data, offs, self.lookup)
            n = self.edges[which + 1] - self.edges[which]  # items with that seed
            seed = np.repeat(self.edges[which], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who, where = np.repeat(who, n), np.repeat(where, n)
            out += [(lo + r[0], *r[1:]) for r in _aligned(h, firsts, who, where - self.place[seed], self.item[seed], self.items, least)]
        return out


def _tokenised(rows: list) -> tuple[list[np.ndarray], list[list]]:
    """Distinct token sequences, and the item_ids of each."""
    data, offs = buffers(folded(pa.array([r["text"] for r in rows], pa.string())))
    h, firsts = tokens(data, offs)
    own: dict[bytes, list] = {}
    for r, a, b in zip(rows, firsts[:-1], firsts[1:]):
        own.setdefault(h[a:b].tobytes(), []).append(r["item_id"])
    return [np.frombuffer(k, np.uint64) for k in own], list(own.values())


def _seeds(docs: DataFrame, benchmark: DataFrame, slice_ngrams: int) -> Iterator[Seeds]:
    """The seeds of each slice of the benchmark, with frequencies over all of docs."""
    items = benchmark.select("item_id", "text")
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, math.ceil(size / slice_ngrams))  # an n-gram begins at every character at most
    n_docs = docs.count()
    for k in range(slices):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == k).collect()
        own, names = _tokenised(rows)
        grams, item, place, sizes = _item_seeds(own)
        counts = _documents_with(docs, grams, sizes) if len(grams) else {}
        value, inverse = np.unique(grams, return_inverse=True)
        share = np.bincount(inverse.ravel(), minlength=len(value))[inverse.ravel()]
        short = np.array([len(h) < NGRAM for h in own], bool)[item]
        keep = rare(item, np.array([counts.get(int(g), 0) for g in grams], np.int64), max(RARE, RARE_SHARE * n_docs), share > SHARED_ITEMS, short)
        order = np.flatnonzero(keep)[np.argsort(grams[keep], kind="stable")]
        lookup = Lookup(grams[order], sizes)
        edges = np.searchsorted(grams[order], lookup.values)
        yield Seeds(lookup, np.r_[edges, len(order)], item[order], place[order], own, names)


def _in_parts(batches: Iterable[pa.RecordBatch], work: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, 512):
            yield from work(b.slice(at, 512))


def contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, slice_ngrams: int = SLICE) -> DataFrame:
    """Pairs of a document (doc_id, text) and a benchmark item (item_id, text) that it holds a copy of.

    Columns: doc_id, item_id, score (1 for a whole copy), first_token and n_tokens (where in the
    document). Tokens are runs of letters and digits, case-folded; in scripts written without spaces
    (ideographs, kana, Thai, Lao, Khmer, Burmese) each character is one. Null or empty texts match
    nothing. An item of one or two tokens matches where its whole sequence occurs, if no more
    documents have it than a rare n-gram may; a commoner one is no sign of a copy and matches nothing.
    Items with equal tokens are aligned once. An n-gram that over SHARED_ITEMS items of a slice have
    seeds only items that have no other. Repeated rows give repeated pairs, rows without id pairs with
    a null id, texts of any length are searched whole. Other columns are ignored; empty tables give no
    rows.
    """
    ship(docs.sparkSession)
    kind, out = docs.schema["doc_id"].dataType.simpleString(), None
    for seeds in _seeds(docs, benchmark, slice_ngrams):
        sent = docs.sparkSession.sparkContext.broadcast(seeds)

        def pairs(b: pa.RecordBatch, sent=sent) -> Iterator[pa.RecordBatch]:
            rows = [(r, name, *rest) for r, i, *rest in sent.value.found(b.column("text"), least) for name in sent.value.names[i]]
            if rows:
                row, *rest = zip(*rows)
                kinds = [pa.int64(), pa.float64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), *(pa.array(x, t) for x, t in zip(rest, kinds))], names=["doc_id", "item_id", "score", "first_token", "n_tokens"])

        found = docs.select("doc_id", "text").mapInArrow(lambda it, pairs=pairs: _in_parts(it, pairs), f"doc_id {kind}, item_id long, score double, first_token long, n_tokens long")
        out = found if out is None else out.union(found)
    return out


def without_contaminated(docs: DataFrame, benchmark: DataFrame, least: float = 0.5, slice_ngrams: int = SLICE) -> DataFrame:
    """The rows of docs, all columns as they are, that hold no copy of a benchmark item; see `contaminated`.

    Each row is judged by its own text, so rows without doc_id or with the same doc_id are told apart.
    Nothing is shuffled.
    """
    ship(docs.sparkSession)
    out = docs
    for seeds in _seeds(docs, benchmark, slice_ngrams):
        sent = docs.sparkSession.sparkContext.broadcast(seeds)

        def clean(b: pa.RecordBatch, sent=sent) -> Iterator[pa.RecordBatch]:
            keep = np.ones(b.num_rows, bool)
            keep[[r[0] for r in sent.value.found(b.column("text"), least)]] = False
            yield b.filter(pa.array(keep))

        out = out.mapInArrow(lambda it, clean=clean: _in_parts(it, clean), docs.schema)
    return out


def _aligned(h: np.ndarray, firsts: np.ndarray, who: np.ndarray, diagonal: np.ndarray, item: np.ndarray, items: list[np.ndarray], least: float) -> list[tuple]:
    """Best alignment of each document and item with a seed in common, if it is good enough."""
    order = np.lexsort((diagonal, item, who))
    who, item, diagonal = who[order], item[order], diagonal[order]
    new = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (item[1:] != item[:-1])]) if len(who) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(new, np.r_[new[1:], len(who)]):
        doc, name, words = int(who[a]), int(item[a]), items[item[a]]
        m, best = len(words), (0, 0, 0)
        slack, where = m // 2 + 4, diagonal[a:b]
        for group in np.split(where, np.flatnonzero(np.diff(where) > m) + 1):  # seeds that lie far apart are aligned by themselves
            lo, hi = max(firsts[doc], group[0] - slack), min(firsts[doc + 1], group[-1] + m + slack)
            score, start, end = align(words, h[lo:hi])
            if score > best[0]:
                best = (score, int(lo - firsts[doc]) + start, end - start)
        if best[0] >= needed(m, least):
            rows.append((doc, name, best[0] / (MATCH * m), best[1], best[2]))
    return rows


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds a copy of, over both whole tables; see contaminated."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
