"""Substring dedup by relative Lempel-Ziv parsing against everything that comes earlier.

The reference of a document is all text before it: documents with a smaller ``doc_id``, and its own earlier words. The
reference's blocks are indexed by content: every run of windows (``WINDOW`` consecutive words) that shares a minimizer, the
smallest hash of the ``GRAM``-word pieces within, goes to the bucket of that minimizer, so equal windows meet wherever they
stand. A bucket finds each window's first occurrence in the whole reference; later ones become matches that point back to it.

Each document is then parsed greedily (``parse``): matches that run in step with the same source are joined across buckets; at each
place the match that reaches farthest becomes a factor of ``WINDOW`` words or more, and the parse goes on behind it. Windows that straddle
a factor's end belong to no factor: they are looked up one by one, so a word is removed exactly if some window that covers it starts
earlier elsewhere.

Repeats inside a block of documents are settled where they are read and never shuffled, so a window that stands in every
document costs each block one entry. Null text has no words. A null ``doc_id`` comes after all others. Rows that repeat a ``doc_id`` count
as one document; equal rows get equal results. An empty table gives no rows. A text is taken whole, in memory linear in its length. Columns
other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.words import BASE, batches, hashes_of, mixed, raw_texts, rolling, tidy

WINDOW, GRAM = 20, 10
#: Text bytes of a block, which bound a worker's memory; and of the corpus for each bucket.
BLOCK_BYTES, BUCKET_BYTES = 5 << 20, 3 << 20
LAST = np.iinfo(np.int64).max
FACTOR = [("doc_id", pa.int64()), ("start", pa.int32()), ("windows", pa.int32()), ("source_doc", pa.int64()), ("source_start", pa.int32())]


def _pack(*arrays: np.ndarray) -> bytes:
    raw = [np.array([len(a) for a in arrays], "<u4").tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _unpack(blob: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    sizes, at, out = np.frombuffer(raw, "<u4", len(kinds)), 4 * len(kinds), []
    for n, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return out


#: Minimizer, doc_id (differences), start and length of each run of windows; 48 bits of each window's hash.
RUNS = ("<u8", "<i8", "<i4", "u1", "<u4", "<u2")
LOCAL = ("<i8", "<i4", "<i4", "<i8", "<i4")


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, by doubling."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _in_step(doc: np.ndarray, pos: np.ndarray, sdoc: np.ndarray, spos: np.ndarray) -> list[np.ndarray]:
    """Joins windows (ordered by document and place) into factors where copy and source go on in step."""
    if not len(doc):
        return [doc, pos, pos, sdoc, spos]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (sdoc[1:] != sdoc[:-1]) | (spos[1:] != spos[:-1] + 1)]
    first = np.flatnonzero(new)
    return [doc[first], pos[first], np.diff(np.r_[first, len(doc)]), sdoc[first], spos[first]]


def _later(keys: np.ndarray, doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows in order of document and place: the first window with the same key, and which windows are no repeats."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    lead = np.r_[True, ranked[1:] != ranked[:-1]]
    first = np.empty(len(keys), np.int64)
    first[order] = order[np.flatnonzero(lead)[np.cumsum(lead) - 1]] if len(keys) else 0
    return first, (doc[first] == doc) & (pos[first] == pos)


def _index_block(rows: pa.Table, buckets: int, number: int) -> Iterator[tuple[int, bool, bytes]]:
    ids = rows.column("doc_key").to_numpy()
    texts = raw_texts(rows.column("text").combine_chunks())
    by_id = np.argsort(ids, kind="stable")
    hashes, lengths = [], []
    for i in by_id.tolist():
        h = hashes_of(texts[i].split())
        if len(h) >= WINDOW:
            hashes.append(h)
            lengths.append((ids[i], len(h)))
    if not hashes:
        return
    words = np.concatenate(hashes)
    del hashes, texts
    docs, sizes = np.array([x for x, _ in lengths], np.int64), np.array([n for _, n in lengths], np.int64)
    begin = np.cumsum(sizes) - sizes
    inner = np.ones(len(words), bool)  # starts of windows within one document
    for k in range(1, WINDOW):
        inner[begin + sizes - k] = False
    at = np.flatnonzero(inner)
    whole = rolling(words, WINDOW)[at]
    anchor = sliding_min(rolling(words, GRAM), WINDOW - GRAM + 1)[at]
    which = np.repeat(np.arange(len(docs)), sizes - WINDOW + 1)
    doc, pos = docs[which], (at - begin[which]).astype(np.int32)
    first, lead = _later(whole, doc, pos)
    rest = np.flatnonzero(~lead)
    if len(rest):
        source = first[rest]
        found = _in_step(doc[rest], pos[rest], doc[source], pos[source])
        yield number % buckets, True, _pack(*(x.astype(k) for x, k in zip(found, LOCAL, strict=True)))
    keep = np.flatnonzero(lead & (first == np.arange(len(first))))
    doc, pos, anchor, whole = doc[keep], pos[keep], anchor[keep], whole[keep]
    new = np.r_[True, (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1) | (anchor[1:] != anchor[:-1])]
    run = np.flatnonzero(new)
    size = np.diff(np.r_[run, len(doc)])
    bucket = (mixed(anchor[run]) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        runs = order[edges[b] : edges[b + 1]]
        n = size[runs]
        windows = np.repeat(run[runs] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(int(n.sum()))
        h = whole[windows]
        yield b, False, _pack(anchor[run[runs]], np.diff(doc[run[runs]], prepend=0), pos[run[runs]], n.astype(np.uint8), (h >> np.uint64(32)).astype("<u4"), (h >> np.uint64(16)).astype("<u2"))


def _indexed(buckets: int):
    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, rows in enumerate(batches(it, BLOCK_BYTES)):
            found = list(_index_block(rows, buckets, hash(rows.column("doc_key")[0].as_py()) + number))
            for at in range(0, len(found), 64):
                part = found[at : at + 64]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int32()), pa.array([x[1] for x in part], pa.bool_()), pa.array([x[2] for x in part], pa.binary())], ["bucket", "local", "blob"])

    return apply


def _matched(group: pa.Table) -> pa.Table:
    """Factors of all windows of a bucket that stand elsewhere before."""
    out, parts = [], []
    for local, blob in zip(group.column("local").to_pylist(), group.column("blob"), strict=True):
        if local:
            out.append(_unpack(blob.as_py(), LOCAL))
        else:
            anchor, steps, start, n, high, low = _unpack(blob.as_py(), RUNS)
            parts.append((anchor, np.cumsum(steps), start, n.astype(np.int64), (high.astype(np.uint64) << np.uint64(16)) | low))
    if parts:
        anchor, doc, start, n, h = (np.concatenate(x) for x in zip(*parts, strict=True))
        offset = np.cumsum(n) - n
        order = np.lexsort((start, doc))
        anchor, doc, start, n, offset = anchor[order], doc[order], start[order], n[order], offset[order]
        inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        keys = mixed(np.repeat(anchor, n) * np.uint64(BASE) + h[np.repeat(offset, n) + inside])
        doc, pos = np.repeat(doc, n), (np.repeat(start, n) + inside).astype(np.int32)
        first, lead = _later(keys, doc, pos)
        rest = np.flatnonzero(~lead)
        # minimizers scatter a document's windows over buckets; within one, runs are in order of document and place
        out.append(_in_step(doc[rest], pos[rest], doc[first[rest]], pos[first[rest]]))
    columns = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0)] * len(FACTOR)
    return pa.Table.from_arrays([pa.array(c.astype(t.to_pandas_dtype()), t) for c, (_, t) in zip(columns, FACTOR, strict=True)], [k for k, _ in FACTOR])


def factors(docs: DataFrame) -> DataFrame:
    """Matches: (doc_id, start, windows, source_doc, source_start): words start .. start + windows + WINDOW - 2 repeat the source's."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias("doc_key"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    buckets = max(16, -(-int(total) // BUCKET_BYTES))
    indexed = rows.mapInArrow(tidy(_indexed(buckets)), "bucket int, local boolean, blob binary")
    return indexed.groupBy("bucket").applyInArrow(_matched, "doc_id long, start int, windows int, source_doc long, source_start int")


def joined(start: np.ndarray, windows: np.ndarray, source_doc: np.ndarray, source_start: np.ndarray) -> list[np.ndarray]:
    """Matches joined where copy and source go on in step, by start."""
    order = np.lexsort((start, source_start - start, source_doc))
    start, windows, source_doc, source_start = (x[order].astype(np.int64) for x in (start, windows, source_doc, source_start))
    shift, end = source_start - start, start + windows
    new = np.r_[True, (source_doc[1:] != source_doc[:-1]) | (shift[1:] != shift[:-1]) | (start[1:] > end[:-1])]
    first = np.flatnonzero(new)
    found = [start[first], np.maximum.reduceat(end, first) - start[first], source_doc[first], source_start[first]]
    by_start = np.lexsort((-found[1], found[0]))
    return [x[by_start] for x in found]


def parse(n_words: int, start: np.ndarray, windows: np.ndarray, source_doc: np.ndarray, source_start: np.ndarray) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
    """Greedy parse of one document: its factors (start, words, source document, start there), and which words they cover,
    with the windows that straddle factors' ends."""
    covered = np.zeros(n_words, bool)
    factors: list[tuple[int, int, int, int]] = []
    if not len(start):
        return factors, covered
    start, windows, source_doc, source_start = (x.tolist() for x in joined(start, windows, source_doc, source_start))
    place, at, best = 0, 0, -1  # best: of the matches that start no later than the place, the one that reaches farthest
    while True:
        while at < len(start) and start[at] <= place:
            if best < 0 or start[at] + windows[at] > start[best] + windows[best]:
                best = at
            at += 1
        if best < 0 or start[best] + windows[best] <= place:
            if at == len(start):
                break
            place = start[at]
            continue
        last = start[best] + windows[best]  # behind the factor's last whole window
        end = last + WINDOW - 1
        if end > n_words:  # another text of the same doc_id
            best, place = -1, place + 1
            continue
        factors.append((place, end - place, source_doc[best], source_start[best] + place - start[best]))
        covered[place:end] = True
        # windows that straddle the factor's end
        k = at
        while k < len(start) and start[k] < end:
            k += 1
        for m in range(max(0, min(best, at)), k):
            lo, hi = max(start[m], last), min(start[m] + windows[m], end)
            if lo < hi and hi + WINDOW - 1 <= n_words:
                covered[lo : hi + WINDOW - 1] = True
        place = end
    return factors, covered


MATCH = ("start", "windows", "source_doc", "source_start")


def _parsed(batch: pa.RecordBatch) -> Iterator[tuple[list[bytes], list[tuple[int, int, int, int]], np.ndarray]]:
    for raw, matches in zip(raw_texts(batch.column("text")), batch.column("matches"), strict=True):
        words = raw.split()
        found = matches.values
        columns = [np.empty(0, np.int64)] * 4 if found is None else [found.field(k).to_numpy(zero_copy_only=False) for k in MATCH]
        yield words, *parse(len(words), *columns)


def _kept(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in it:
        for batch in (whole.slice(at, 1000) for at in range(0, whole.num_rows, 1000)):
            total, removed, digests, texts = [], [], [], []
            for words, _, gone in _parsed(batch):
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if gone.any() else words)
                total.append(len(words))
                removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept)
            columns = [batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests), pa.array(texts, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])


def _factors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "words", "source_doc", "source_start"]
    for batch in it:
        rows = [(doc, *f) for doc, (_, factors, _) in zip(batch.column("doc_id").to_pylist(), _parsed(batch), strict=True) for f in factors]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(5)], names)


def with_matches(docs: DataFrame) -> DataFrame:
    """(doc_id, text, matches) of every document."""
    found = factors(docs).groupBy("doc_id").agg(F.collect_list(F.struct(*MATCH)).alias("matches")).withColumnRenamed("doc_id", "__key")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.join(found, F.coalesce(F.col("doc_id"), F.lit(int(LAST))) == F.col("__key"), "left").select("doc_id", "text", "matches")


def factorised(docs: DataFrame) -> DataFrame:
    """The parse itself: (doc_id, start, words, source_doc, source_start) of every factor."""
    return with_matches(docs).mapInArrow(tidy(_factors), "doc_id long, start long, words long, source_doc long, source_start long")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """Per document: n_words, n_removed, the kept words joined by single spaces, and their SHA-256."""
    return with_matches(docs).mapInArrow(tidy(_kept), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
