"""Operator 10, suffix-array dedup: bytes covered by a long string that starts in an earlier document.

Sorting every suffix of the corpus would shuffle many times its size. A sparse suffix array does the
same job: each window of `length` bytes has an anchor, the place of its least 24-byte hash, which
depends on the window's bytes alone, so equal windows have equal anchors. Windows in a row with the
same anchor are a segment (about 14 windows).

1. Documents are packed into compressed packs of a few MB, in the shared folder.
2. Per pack, each distinct segment goes to the bucket of its anchor as two hashes and its least
   doc_id: 14 bytes. Copies within a pack are one entry, so a hot passage costs an entry per pack.
3. A bucket finds segments that an earlier document has whole, and anchors whose segments differ.
4. Of the latter, packs send the bytes. In each bucket deep-shallow sorting orders the suffixes that
   begin at their windows; runs of equal windows give those that an earlier document has.
5. Spans go back to the packs, which cut them from the texts.

An anchor whose segments differ in very many documents (at the edges of a passage that they share)
would send them all to one bucket. Packs report anchors with many segments; those that enough packs
report are heavy, and each of their windows counts as a segment of its own, in a bucket by its own
hash. The list of heavy anchors is bounded by its rule, whatever the input.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, free_shuffles, mix, powers, prefix_hash, span_hash, table
from tessera.llm.packs import LAST, bucket_count, bucketwise, pack, unpack
from tessera.llm.suffix_sort import sort_suffixes
from tessera.runtime import ship

LENGTH = 50
ANCHOR = 24
#: A pack reports an anchor with so many different segments or one for every HEAVY_DOCS of its documents, and
#: an anchor is heavy if HEAVY_PACKS of the packs report it. A pack of 4 MB has under 400,000 segments, so it
#: reports fewer than 6,250 anchors and there are fewer than 625,000 heavy ones (5 MB).
HEAVY_SEGMENTS, HEAVY_DOCS, HEAVY_PACKS = 64, 32, 0.01
_PLACE = np.uint64((1 << 24) - 1)
_FORTY = np.uint64((1 << 40) - 1)


# --- anchors and segments ----------------------------------------------------------------------


def segments(data: np.ndarray, offs: np.ndarray, length: int = LENGTH, anchor: int = ANCHOR) -> tuple[np.ndarray, ...]:
    """(first window, last window, anchor hash, segment hash) of each segment; windows are whole within a text."""
    parts = []
    lo, n = 0, len(offs) - 1
    while lo < n:  # some texts at a time, as in blocks()
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + (1 << 20), "right")) - 1)
        own = data[offs[lo] : offs[hi]]
        parts.append([x + offs[lo] if k < 2 else x for k, x in enumerate(_segments(own, offs[lo : hi + 1] - offs[lo], length, anchor))])
        lo = hi
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2


def _segments(data: np.ndarray, offs: np.ndarray, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    n = len(data) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2
    c = prefix_hash(data, fold=False)
    h = mix((c[anchor:] - c[:-anchor]) * powers(len(c))[1][: len(c) - anchor])
    width, step = length - anchor + 1, 1 << 17
    at = np.empty(n, np.int64)
    for lo in range(0, n, step):
        hi = min(n, lo + step)
        v = (h[lo : hi + width - 1] & ~_PLACE) | np.arange(hi - lo + width - 1, dtype=np.uint64)
        done = 1
        while done < width:  # least of `done` values in a row, doubling
            more = min(done, width - done)
            v = np.minimum(v[:-more], v[more:])
            done += more
        at[lo:hi] = (v & _PLACE).astype(np.int64) + lo
    long_enough = np.diff(offs) >= length
    edge = np.zeros(len(data) + 1, np.int8)
    edge[offs[:-1][long_enough]] += 1
    edge[offs[1:][long_enough] - length + 1] -= 1
    whole = np.cumsum(edge[:n], dtype=np.int8).astype(bool)
    change = at[1:] != at[:-1]
    first = np.flatnonzero(whole & np.r_[True, change | ~whole[:-1]])
    last = np.flatnonzero(whole & np.r_[change | ~whole[1:], True])
    return first, last, h[at[first]], span_hash(c, first, last + length)


def window_hash(data: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """Hash of the bytes of each window."""
    weights = mix(np.arange(1, length + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.zeros(len(start), np.uint64)
    for k in range(length):
        out += mix(data[start + k].astype(np.uint64) + np.uint64(1)) * weights[k]
    return mix(out)


def by_window(data: np.ndarray, first: np.ndarray, last: np.ndarray, key: np.ndarray, seg: np.ndarray, heavy: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """The segments, those of heavy anchors (sorted hashes) replaced by one for each window."""
    if not len(heavy):
        return first, last, key, seg
    at = np.searchsorted(heavy, key).clip(0, len(heavy) - 1)
    hot = heavy[at] == key
    n = (last - first + 1)[hot]
    start = np.repeat(first[hot], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    h = window_hash(data, start, length)
    return np.r_[first[~hot], start], np.r_[last[~hot], start], np.r_[key[~hot], h], np.r_[seg[~hot], h >> np.uint64(24)]


def heavy_anchors(packs: DataFrame, length: int, anchor: int, most: int = HEAVY_SEGMENTS) -> np.ndarray:
    """Sorted hashes of anchors that would gather very many different segments."""

    def report(batches):
        for b in batches:
            for k in range(b.num_rows):
                ids, offs, data = unpack(b, k)
                _, _, key, seg = segments(data, offs, length, anchor)
                key = np.sort(key[np.unique(mix(key * np.uint64(0x9FB21C651E98DF25) + seg), return_index=True)[1]])
                new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                many = np.diff(np.r_[new, len(key)]) >= max(most, len(ids) / HEAVY_DOCS)
                yield pa.RecordBatch.from_arrays([pa.array(key[new[many]].view(np.int64))], names=["anchor"])

    least = max(1, HEAVY_PACKS * packs.count())
    found = packs.select("ids", "offs", "texts").mapInArrow(report, "anchor long").groupBy("anchor").count().where(F.col("count") >= least).collect()
    return np.sort(np.array([r["anchor"] for r in found], np.int64).view(np.uint64))


class Entries:
    """The distinct segments of a pack, by bucket, with the occurrence in the least document."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, ids: np.ndarray, buckets: int, length: int, anchor: int, heavy: np.ndarray):
        self.first, self.last, key, seg = by_window(data, *segments(data, offs, length, anchor), heavy, length)
        self.doc = np.searchsorted(offs, self.first, "right") - 1
        which = mix(key * np.uint64(0x9FB21C651E98DF25) + seg)
        bucket = ((key >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
        self.order = np.lexsort((ids[self.doc], which, bucket))
        w = which[self.order]
        new = np.r_[True, w[1:] != w[:-1]] if len(w) else np.zeros(0, bool)
        self.of = np.cumsum(new) - 1  # entry of each occurrence, in order
        self.rep = self.order[new]  # occurrence that stands for each entry
        self.bucket = bucket[self.rep]
        self.key, self.seg, self.least = key[self.rep] & _FORTY, seg[self.rep] & _FORTY, ids[self.doc[self.rep]]
        self.edges = np.flatnonzero(np.r_[True, self.bucket[1:] != self.bucket[:-1], True]) if len(w) else np.zeros(1, np.int64)

    def by_bucket(self) -> Iterator[tuple[int, int, int]]:
        for a, b in zip(self.edges[:-1], self.edges[1:]):
            yield int(self.bucket[a]), int(a), int(b)


def _five(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _from_five(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = raw.reshape(-1, 5)
    return out.view("<u8").ravel().astype(np.uint64)


def _message(e: Entries, a: int, b: int, z: zstandard.ZstdCompressor) -> bytes:
    return _five(e.key[a:b]) + _five(e.seg[a:b]) + z.compress(e.least[a:b].astype("<i8").tobytes())


def _judge(messages: list[tuple[int, bytes]]) -> Iterator[tuple[int, np.ndarray]]:
    """Per message of one bucket: 1 where an earlier document has the segment, 2 where other segments share the anchor."""
    counts, keys, segs, docs = [], [], [], []
    for n, blob in messages:
        raw = np.frombuffer(blob, np.uint8)
        counts.append(n)
        keys.append(_from_five(raw[: 5 * n]))
        segs.append(_from_five(raw[5 * n : 10 * n]))
        docs.append(np.frombuffer(zstandard.decompress(blob[10 * n :]), "<i8"))
    key, seg, doc = map(np.concatenate, (keys, segs, docs))
    flags = np.zeros(len(key), np.uint8)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    order = order[np.r_[False, same] | np.r_[same, False]] if len(order) else order
    if len(order):
        order = order[np.lexsort((doc[order], seg[order], key[order]))]
        k, s, d = key[order], seg[order], doc[order]
        new_key = np.r_[True, k[1:] != k[:-1]]
        new_seg = new_key | np.r_[True, s[1:] != s[:-1]]
        first = d == d[np.flatnonzero(new_seg)[np.cumsum(new_seg) - 1]]
        flags[order] = ~first
        begins = np.flatnonzero(new_key)
        n_segs = np.add.reduceat(new_seg.astype(np.int64), begins)
        least, most = np.minimum.reduceat(d, begins), np.maximum.reduceat(np.where(new_seg, d, np.iinfo(np.int64).min), begins)
        open_ = ((n_segs > 1) & (most > least))[np.cumsum(new_key) - 1]
        flags[order[first & open_]] = 2
    at = 0
    for k, n in enumerate(counts):
        yield k, flags[at : at + n]
        at += n


def _merged(first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans, as spans that don't touch."""
    if not len(first):
        return first, end
    order = np.argsort(first, kind="stable")
    first, end = first[order], np.maximum.accumulate(end[order])
    new = np.r_[True, first[1:] > end[:-1]]
    return first[new], end[np.r_[new[1:], True]]


def _spans_blob(first: np.ndarray, end: np.ndarray) -> bytes:
    return np.stack([first, end]).astype("<i8").tobytes()


def _spans_of(blobs: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found = [np.frombuffer(x, "<i8").reshape(2, -1) for x in blobs]
    first, end = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
    return _merged(first, end)


def repeated_spans(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, heavy_segments: int = HEAVY_SEGMENTS) -> tuple[DataFrame, DataFrame]:
    """(packs, spans): the packs of docs, and blobs of the spans to cut from each (pack, spans); see `cut_repeats`."""
    spark = docs.sparkSession
    ship(spark)
    packs = cut(pack(docs), "packs")
    buckets = bucket_count(packs)
    heavy = spark.sparkContext.broadcast(heavy_anchors(packs, length, anchor, heavy_segments))

    def send(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            for k in range(b.num_rows):
                ids, offs, data = unpack(b, k)
                e = Entries(data, offs, ids, buckets, length, anchor, heavy.value)
                rows = [{"bucket": w, "pack": b.column("pack")[k].as_py(), "n": hi - lo, "blob": _message(e, lo, hi, z)} for w, lo, hi in e.by_bucket()]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("n", pa.int32()), ("blob", pa.binary())]))

    def judge(bucket, rows):
        found = [(r["pack"], bucket, np.packbits(np.stack([flags & 1, flags >> 1])).tobytes()) for r, (_, flags) in zip(rows, _judge([(r["n"], r["blob"]) for r in rows])) if flags.any()]
        if found:
            yield pa.RecordBatch.from_pylist([dict(zip(("pack", "bucket", "flags"), x)) for x in found], pa.schema([("pack", pa.int64()), ("bucket", pa.int32()), ("flags", pa.binary())]))

    sent = packs.select("pack", "ids", "offs", "texts").mapInArrow(send, "bucket int, pack long, n int, blob binary")
    dealt = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket", "pack")
    flags = cut(dealt.mapInArrow(lambda it: bucketwise(it, judge), "pack long, bucket int, flags binary"), "flags")
    free_shuffles(spark)

    def settle(batches):
        out = pa.schema([("pack", pa.int64()), ("bucket", pa.int32()), ("first", pa.binary()), ("last", pa.binary()), ("doc", pa.binary()), ("blob", pa.binary())])
        for b in batches:
            for k in range(b.num_rows):
                ids, offs, data = unpack(b, k)
                e = Entries(data, offs, ids, buckets, length, anchor, heavy.value)
                said = np.zeros((2, len(e.rep)), np.uint8)
                answers = {x["bucket"]: x["flags"] for x in b.column("answers")[k].as_py() or ()}
                for w, lo, hi in e.by_bucket():
                    if w in answers:
                        said[:, lo:hi] = np.unpackbits(np.frombuffer(answers[w], np.uint8), count=2 * (hi - lo)).reshape(2, -1)
                gone = (said[0][e.of] == 1) | (ids[e.doc[e.order]] > e.least[e.of])
                hit = e.order[gone]
                name = b.column("pack")[k].as_py()
                rows = [{"pack": name, "bucket": -1, "blob": _spans_blob(*_merged(e.first[hit], e.last[hit] + length))}] if len(hit) else []
                asked_ = (said[1][e.of] == 1) & (ids[e.doc[e.order]] == e.least[e.of])
                own, own_bucket = e.order[asked_], e.bucket[e.of[asked_]]
                for w in np.unique(own_bucket):
                    at = own[own_bucket == w]
                    first, last = e.first[at], e.last[at]
                    text = b"".join(data[x : y + length].tobytes() for x, y in zip(first, last))
                    rows.append({"pack": name, "bucket": int(w), "first": first.astype("<i8").tobytes(), "last": last.astype("<i8").tobytes(), "doc": ids[e.doc[at]].astype("<i8").tobytes(), "blob": text})
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, out)

    def order(bucket, rows):
        firsts, lasts, docs_ = (np.concatenate([np.frombuffer(r[c], "<i8") for r in rows]) for c in ("first", "last", "doc"))
        data = np.frombuffer(b"".join(r["blob"] for r in rows), np.uint8)
        windows = lasts - firsts + 1
        begins = np.r_[0, np.cumsum(windows + length - 1)][:-1]
        which = np.repeat(np.arange(len(windows)), windows)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
        hit = np.zeros(len(which), bool)
        by, group = sort_suffixes(data, begins[which] + nth, length)
        if len(by):
            doc = docs_[which[by]]
            runs = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            least = np.minimum.reduceat(doc, runs)
            hit[by] = doc > np.repeat(least, np.diff(np.r_[runs, len(by)]))
        owner = np.repeat(np.arange(len(rows)), [len(r["first"]) // 8 for r in rows])[which]
        start = firsts[which] + nth
        start, owner = start[hit], owner[hit]
        edge = np.searchsorted(owner, np.arange(len(rows) + 1))
        out = [{"pack": r["pack"], "spans": _spans_blob(*_merged(start[a:b], start[a:b] + length))} for r, a, b in zip(rows, edge[:-1], edge[1:]) if b > a]
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("pack", pa.int64()), ("spans", pa.binary())]))

    answers = flags.groupBy("pack").agg(F.collect_list(F.struct("bucket", "flags")).alias("answers"))
    asked = packs.select("pack", "ids", "offs", "texts").join(answers, "pack", "left")
    settled = cut(asked.mapInArrow(settle, "pack long, bucket int, first binary, last binary, doc binary, blob binary"), "settled")
    free_shuffles(spark)
    open_ = settled.where("bucket >= 0").repartition(buckets, "bucket").sortWithinPartitions("bucket", "pack")
    ordered = open_.mapInArrow(lambda it: bucketwise(it, order), "pack long, spans binary")
    spans = cut(settled.where("bucket = -1").select("pack", F.col("blob").alias("spans")).union(ordered), "spans")
    free_shuffles(spark)
    return packs, spans


def _cut_pack(data: np.ndarray, offs: np.ndarray, first: np.ndarray, end: np.ndarray) -> Iterator[tuple[bytes, list[tuple[int, int]]]]:
    """(text, spans within it) of each text of a pack. Spans lie within one text each once they are split."""
    raw = data.tobytes()
    at = np.searchsorted(end, offs[:-1], "right")
    for k, (a, b) in enumerate(zip(offs[:-1], offs[1:])):
        own, j = [], int(at[k])
        while j < len(first) and first[j] < b:
            own.append((max(int(first[j]), int(a)) - int(a), min(int(end[j]), int(b)) - int(a)))
            j += 1
        yield raw[a:b], own


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def whole_characters(text: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans less the bytes of characters that they cover in part."""
    inner = lambda i: i < len(text) and text[i] & 0xC0 == 0x80
    out = []
    for a, b in spans:
        while a < b and inner(a):
            a += 1
        while a < b and inner(b):
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def _answered(packs: DataFrame, spans: DataFrame) -> DataFrame:
    return packs.join(spans.groupBy("pack").agg(F.collect_list("spans").alias("spans")), "pack", "left")


def digest_repeats(docs: DataFrame, length: int = LENGTH, heavy_segments: int = HEAVY_SEGMENTS) -> DataFrame:
    """A row per document (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Removed is each byte covered by a string of `length` bytes that also starts in a document with a
    smaller doc_id, judged on the texts as given. A null text is empty. A row without doc_id counts
    as later than all others. Rows that share a doc_id are none smaller than the other, so neither
    loses what both have. An empty table gives no rows; other columns are ignored.
    """

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                ids, offs, data = unpack(b, k)
                rows = []
                for key, (text, own) in zip(ids.tolist(), _cut_pack(data, offs, *_spans_of(b.column("spans")[k].as_py() or ()))):
                    removed = sum(y - x for x, y in own)
                    rows.append((None if key == LAST else key, len(text), removed, len(own), hashlib.sha256(_without(text, own)).hexdigest()))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), [pa.int64()] * 4 + [pa.string()])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    packs, spans = repeated_spans(docs.select("doc_id", "text"), length, heavy_segments=heavy_segments)
    return _answered(packs.select("pack", "ids", "offs", "texts"), spans).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents with repeats cut from their texts, and `removed_bytes`.

    As `digest_repeats`, but a character of which only some bytes repeat stays whole. All columns of
    docs are returned as they were; a null text stays null.
    """
    rest = [c for c in docs.columns if c != "text"]

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                _, offs, data = unpack(b, k)
                texts, removed = [], []
                for text, own in _cut_pack(data, offs, *_spans_of(b.column("spans")[k].as_py() or ())):
                    own = whole_characters(text, own)
                    removed.append(sum(y - x for x, y in own))
                    texts.append(_without(text, own).decode("utf-8", "replace"))
                rows = b.column("rows").slice(k, 1).flatten()
                yield pa.RecordBatch.from_arrays([rows, pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["row", "text", "removed_bytes"])

    marked = docs.withColumn("__null_text", F.col("text").isNull())
    packs, spans = repeated_spans(marked, length)
    kind = packs.schema["rows"].dataType.elementType.simpleString()
    out = _answered(packs.select("pack", "offs", "texts", F.col("ids"), "rows"), spans).mapInArrow(run, f"row {kind}, text string, removed_bytes long")
    text = F.when(~F.col("row.__null_text"), F.col("text")).alias("text")
    return out.select(*(text if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns), "removed_bytes")


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every text of `documents` without its repeats of 50 bytes or more; see digest_repeats."""
    return digest_repeats(table(spark, sf_dir, "documents"))
