"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

A document's set holds its distinct shingles. The sketch has ``BANDS * ROWS`` coordinates: in round i every
element is hashed to one bin with a value in [i, i+1), and after as many rounds as coordinates, round by round one bin takes every element; so
each coordinate fills, values of earlier rounds win, and few rounds do for large sets. Two sets agree on a
coordinate with the probability of their similarity, with the concentration of independent minima.

Documents with equal sets form a class. Classes that share a band's coordinates are candidates. Candidates are first compared
with a few pivots of their buckets, in rounds, each followed by connected components; then every pair that still shares a
bucket across components is compared. Pairs are listed within small buckets only; crowds are compared in the cells of a grid, which report
links alone, and nothing is compared within a component.
All links rest on whole shingle sets.

Null, empty and wordless texts have the empty set and link with nothing. Repeated rows are copies of each other. Rows that share a
``doc_id`` but not their text, and rows without one, are documents of their own: their classes get node ids below -2**62. A component's id is
its smallest ``doc_id``, null if it has none; ``group_id`` tells apart components that share one. An empty table gives no rows; long texts are
taken whole, in memory linear in their length; columns other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.components import components
from scriptorium.llm.words import BASE, batches, hashes_of, mixed, raw_texts, rolling, tidy
from scriptorium.session import discard, materialize

SHINGLE = 5
#: 40 bands of 6: a pair at similarity 0.75 shares no band with probability 4e-4, one at 0.8 with 5e-6.
BANDS, ROWS = 40, 6
#: (element, round) pairs hashed at a time; more rounds than needed never change a filled bin.
AT_ONCE = 1600
#: Ids whose list may be broadcast (8 bytes each); beyond it the texts are gathered by a shuffled join.
BROADCAST_IDS = 1_000_000
#: Stands for a null doc_id: after all others.
LAST = (1 << 63) - 1
#: Members above which a bucket that still holds several components is compared in cells of about CELL members a side.
WIDE_BUCKET, CELL = 32, 256


def shingle_set(text: bytes, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a whole text; ASCII letters are lower-cased."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(rolling(hashes_of(words), min(width, len(words))))


_SEEDS = mixed(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(BASE))


def sketch(elements: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Fast similarity sketch of a non-empty set: ``size`` coordinates, each the smallest (round, hash) in its bin."""
    found = np.full(size, np.iinfo(np.uint64).max)
    at, empty = 0, True
    while at < 2 * size and empty:
        rounds = np.arange(at, min(2 * size, at + max(1, AT_ONCE // len(elements))))
        h = mixed(elements[None, :] ^ _SEEDS[rounds][:, None])
        bins = np.where((rounds < size)[:, None], (h >> np.uint64(40)) % np.uint64(size), (rounds % size).astype(np.uint64)[:, None])
        np.minimum.at(found, bins.ravel().astype(np.intp), ((rounds.astype(np.uint64)[:, None] << np.uint64(40)) | (h & np.uint64((1 << 40) - 1))).ravel())
        empty = bool((found == np.iinfo(np.uint64).max).any())
        at = int(rounds[-1]) + 1
    return found


def band_keys(coordinates: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    rows = coordinates.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * np.uint64(BASE) + rows[:, k])
    return key.view(np.int64)


def _sketches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches(it, 1 << 20):
        sizes, ones, twos, keys = [], [], [], []
        for text in raw_texts(rows.column("text").combine_chunks()):
            elements = shingle_set(text)
            sizes.append(len(elements))
            with np.errstate(over="ignore"):
                ones.append(int(mixed(elements).sum(dtype=np.uint64).view(np.int64)))
                twos.append(int(np.bitwise_xor.reduce(mixed(elements * np.uint64(BASE))).view(np.int64)))
            keys.append(band_keys(sketch(elements)) if len(elements) else np.empty(0, np.int64))
        offsets = np.cumsum([0, *map(len, keys)])
        arrays = [rows.column("doc_id").combine_chunks(), rows.column("text_print").combine_chunks(), pa.array(sizes, pa.int64()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([*keys, np.empty(0, np.int64)])))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_print", "n_shingles", "print_a", "print_b", "keys"])


def _verify(percent: int):
    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for batch in it:
            keep = []
            for a, b, x, y in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                sets = []
                for i, text in ((a, x), (b, y)):
                    if i not in known:
                        if len(known) > 256:
                            known.clear()
                        known[i] = shingle_set((text or "").encode())
                    sets.append(known[i])
                common = len(np.intersect1d(*sets, assume_unique=True))
                keep.append(common > 0 and 100 * common >= percent * (len(sets[0]) + len(sets[1]) - common))
            yield batch.select(["a", "b"]).append_column("linked", pa.array(keep, pa.bool_()))

    return apply


def _verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(a, b, linked) of each pair, by whole sets."""
    left = texts.select(F.col("id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("id").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    return materialize(joined.mapInArrow(tidy(_verify(percent)), "a long, b long, linked boolean"), "verified")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """labels (id, comp) after links between ids: components of the contracted graph."""
    ends = labels.select(F.col("id").alias("a"), F.col("comp").alias("ca"))
    ends_b = labels.select(F.col("id").alias("b"), F.col("comp").alias("cb"))
    contracted = links.join(ends, "a").join(ends_b, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    found = components(contracted).select(F.col("id").alias("comp"), F.col("component").alias("to"))
    return materialize(labels.join(found, "comp", "left").select("id", F.coalesce("to", "comp").alias("comp")), "labels")


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, id, comp) in buckets that still hold more than one component."""
    now = members.join(labels, "id").select("key", "id", "comp")
    spread = now.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    return materialize(now.join(spread, "key", "left_semi"), "buckets")


def _cell_links(percent: int):
    """Links between the minority and the rest in one cell of a crowd's grid; for each minority member one a component will do."""

    def apply(cell: pa.Table) -> pa.Table:
        ids, comps, minor = (cell.column(c).to_numpy() for c in ("id", "comp", "minor"))
        sets = [shingle_set(t) for t in raw_texts(cell.column("text").combine_chunks())]
        rest = np.flatnonzero(~minor)
        out: list[tuple[int, int]] = []
        if len(rest) and minor.any():
            owner = np.repeat(np.arange(len(rest)), [len(sets[i]) for i in rest])
            values = np.concatenate([sets[i] for i in rest])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            sizes = np.array([len(sets[i]) for i in rest])
            for m in np.flatnonzero(minor).tolist():
                lo, hi = np.searchsorted(values, sets[m], "left"), np.searchsorted(values, sets[m], "right")
                n = hi - lo
                at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                common = np.bincount(owner[at], minlength=len(rest))
                linked = (common > 0) & (100 * common >= percent * (len(sets[m]) + sizes - common)) & (comps[rest] != comps[m])
                found = rest[linked]
                _, first = np.unique(comps[found], return_index=True)
                out += [(min(ids[m], ids[i]), max(ids[m], ids[i])) for i in found[first].tolist()]
        return pa.table({"a": pa.array([int(x[0]) for x in out], pa.int64()), "b": pa.array([int(x[1]) for x in out], pa.int64())})

    return apply


def _crowd_links(crowd: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links between components inside wide buckets, without listing pairs.

    Members that share wide buckets, directly or through others, form a crowd. All but its largest component are compared with the
    whole crowd, in cells of a grid of hashed parts of both sides, so that a cell stays small whatever the crowd's size.
    """
    spans = crowd.groupBy("key").agg(F.min("id").alias("b"))
    crowds = components(crowd.join(spans, "key").select(F.col("id").alias("a"), "b")).withColumnRenamed("component", "crowd")
    rows = materialize(crowd.select("id", "comp").distinct().join(crowds, "id"), "crowds")
    sizes = rows.groupBy("crowd", "comp").agg(F.count(F.lit(1)).alias("n"))
    sizes = sizes.groupBy("crowd").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("all"))
    parts = lambda n: F.ceil(n / CELL).cast("int")
    sizes = sizes.select("crowd", F.col("top.comp").alias("main"), parts(F.col("all")).alias("columns"), parts(F.col("all") - F.col("top.n")).alias("lines")).where("lines > 0")
    placed = rows.join(sizes, "crowd")
    h = F.xxhash64("id", F.lit(11))
    whole = placed.withColumn("j", F.pmod(h, "columns")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("lines") - 1))).select("crowd", F.col("i").cast("long").alias("i"), "j", "id", "comp", F.lit(False).alias("minor"))
    some = placed.where("comp <> main").withColumn("i", F.pmod(h, "lines")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("columns") - 1))).select("crowd", "i", F.col("j").cast("long").alias("j"), "id", "comp", F.lit(True).alias("minor"))
    cells = whole.union(some).join(texts, "id").select("crowd", "i", "j", "id", "comp", "minor", "text")
    return cells.groupBy("crowd", "i", "j").applyInArrow(_cell_links(percent), "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, pivot_rounds: int = 3) -> DataFrame:
    """Per document: n_shingles, component_id (smallest doc_id reachable over links), kept, group_id and a hash of the text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_print", F.xxhash64("text"))
    slim = materialize(rows.mapInArrow(tidy(_sketches), "doc_id long, text_print long, n_shingles long, print_a long, print_b long, keys array<long>"), "sketches")
    named = slim.where("n_shingles > 0")
    prints = ["n_shingles", "print_a", "print_b"]
    # a class is a node; its id is that of its first document, unless another class has the same one, or it has none
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc_id"), "text_print"))
    classes = named.groupBy(*prints).agg(first.alias("x"), F.first("keys").alias("keys")).select(*prints, F.col("x.doc_id").alias("rep"), F.col("x.text_print").alias("rep_print"), "keys")
    classes = materialize(classes, "classes")
    taken = classes.groupBy("rep").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("rep").union(classes.where(F.col("rep") == LAST).select("rep")).distinct()
    clash = materialize(classes.select(*prints, "rep").join(F.broadcast(taken) if taken.count() <= BROADCAST_IDS else taken, "rep", "left_semi"), "clash")
    if clash.limit(1).count():
        apart = (-(1 << 62) - F.pmod(F.xxhash64(*prints), F.lit(1 << 61))).alias("own")
        classes = materialize(classes.join(clash.select(*prints, apart), prints, "left").select(*prints, "rep", "rep_print", "keys", F.coalesce("own", "rep").alias("id")), "nodes")
    else:
        classes = classes.withColumn("id", F.col("rep"))
    exploded = classes.select("id", F.explode("keys").alias("key"))
    shared = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    members = materialize(exploded.join(shared, "key"), "members")
    some = materialize(members.select("id").distinct(), "ids")
    wanted = classes.select("id", F.col("rep").alias("__rep"), "rep_print").join(some, "id")
    if some.count() <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    texts = rows.join(wanted, (F.coalesce("doc_id", F.lit(LAST)) == F.col("__rep")) & (F.col("text_print") == F.col("rep_print"))).select("id", "text")
    texts = materialize(texts, "texts").dropDuplicates(["id"])  # equal rows only: one text a node
    labels = some.select("id", F.col("id").alias("comp"))

    buckets, tested = members, None
    for r in range(pivot_rounds):
        buckets = _open_buckets(members, labels)
        turn = F.col("id") if r == 0 else F.xxhash64("id", F.lit(r))
        pivots = buckets.groupBy("key").agg(F.min(F.struct(turn.alias("t"), F.col("id").alias("p"), F.col("comp").alias("pc"))).alias("x")).select("key", "x.p", "x.pc")
        pairs = buckets.join(pivots, "key").where("comp <> pc").groupBy("id", "pc").agg(F.min("p").alias("p")).select(F.least("id", "p").alias("a"), F.greatest("id", "p").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        checked = _verified(pairs, texts, percent)
        discard(buckets)
        tested = checked.select("a", "b") if tested is None else tested.union(checked.select("a", "b"))
        links = checked.where("linked").select("a", "b")
        if not links.limit(1).count():
            break
        labels = _merged(labels, links)
    buckets = _open_buckets(members, labels)
    wide = buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > WIDE_BUCKET).select("key")
    narrow = buckets.join(wide, "key", "left_anti")
    x, y = narrow.alias("x"), narrow.alias("y")
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.comp") != F.col("y.comp"))
    rest = x.join(y, apart).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    if tested is not None:
        rest = rest.join(tested, ["a", "b"], "left_anti")
    links = _verified(rest.distinct(), texts, percent).where("linked").select("a", "b")
    crowd = materialize(buckets.join(wide, "key", "left_semi"), "crowd")
    if crowd.limit(1).count():
        links = materialize(links.union(_crowd_links(crowd, texts, percent)), "links")
    if links.limit(1).count():
        labels = _merged(labels, links)

    moved = materialize(labels.where("id <> comp"), "moved")
    nodes = classes.select(*prints, "rep", "id").join(moved, "id", "left").select(*prints, "rep", F.coalesce("comp", "id").alias("group_id"))
    nodes = materialize(nodes, "components")
    # the node ids of clashing classes order otherwise than their documents' do
    odd = nodes.where(F.col("group_id") <= -(1 << 62)).groupBy("group_id").agg(F.min("rep").alias("least"))
    named = nodes.join(odd, "group_id", "left").select(*prints, "group_id", F.coalesce("least", "group_id").alias("component_id"))
    out = slim.select("doc_id", "text_print", *prints).join(named, prints, "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).when(F.col("component_id") != LAST, F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.when(~alone, F.col("group_id")).alias("group_id"), "text_print")
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "group_id", "text_print")
