"""Approximate nearest neighbours: an NN-descent graph built in rounds of joins, searched greedily.

Vectors that are equal form a class, which is one node. Every node starts with random neighbours. In a round, each node joins its
neighbours and a sample of the nodes that it neighbours with their vectors, compares these with one another (neighbours of neighbours) where at
least one is new, and proposes to each the best it met; each node then keeps the ``DEGREE`` nearest it knows. Rounds end when few lists change.
A search is greedy over the graph: a query holds the ``BEAM`` nearest nodes that it met, expands the nearest
unexpanded ones in steps of ``STEP``, and ends when all are expanded. Steps of all queries are joins too. The nearest nodes found are
scored exactly, in double precision on the original vectors, with all members of their classes that can matter.

In-links are sampled to about ``DEGREE`` for each node, as in the original method, so a hub costs no more than others.
Vectors that are null, empty, zero or hold null or non-finite components take no part; vectors are compared with those of their own
length. Ties go to the smaller id. Of the vectors of one id the smallest counts. A descent or a search that does not settle raises an
error. An empty table gives no rows; columns other than the id and the vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import discard, materialize, reclaim_driver

DEGREE, PROPOSALS, MAX_ROUNDS, SETTLED = 20, 4, 40, 0.01
BEAM, STEP, MAX_STEPS = 400, 64, 200
#: Classes in a part that numbers its own.
PART_ROWS = 200_000
#: Nodes of a beam that are scored exactly for each neighbour asked for.
MARGIN = 5


def valid_vectors(df: DataFrame, key: str, vector: str) -> DataFrame:
    """(vec_id, v): usable vectors, as doubles."""
    v = F.col(vector).cast("array<double>")
    rows = df.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and size(v) > 0")
    rows = rows.where("not exists(v, x -> x is null or isnan(x) or abs(x) = double('infinity')) and exists(v, x -> x <> 0)")
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def _unit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        if batch.num_rows:
            v = batch.column("v").flatten().to_numpy().reshape(batch.num_rows, -1)
            v = v / np.abs(v).max(1, keepdims=True)
            u = (v / np.sqrt((v * v).sum(1, keepdims=True))).astype(np.float32)
            yield batch.drop_columns("v").append_column("u", pa.array([x.tobytes() for x in u], pa.binary()))


def nodes_of(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vec_id, idx) of every row, and (idx, u) of every class of equal vectors; idx is dense from 0."""
    prints = rows.select("vec_id", "v", F.xxhash64("v").alias("pa"), F.xxhash64("v", F.lit(7)).alias("pb"))
    classes = prints.groupBy("pa", "pb").agg(F.min("vec_id").alias("rep"))
    parts = max(64, -(-rows.count() // PART_ROWS))
    classes = materialize(classes.withColumn("part", F.pmod("pa", F.lit(parts))), "classes")
    counts = classes.groupBy("part").count()
    offsets = counts.select("part", (F.sum("count").over(Window.orderBy("part")) - F.col("count")).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("rep")) - 1
    dense = classes.withColumn("place", place).join(F.broadcast(offsets), "part").select("pa", "pb", "rep", (F.col("offset") + F.col("place")).cast("int").alias("idx"))
    dense = materialize(dense, "dense")
    members = materialize(prints.select("vec_id", "pa", "pb").join(dense.select("pa", "pb", "idx"), ["pa", "pb"]).select("vec_id", "idx"), "members")
    reps = rows.join(dense.select(F.col("rep").alias("vec_id"), "idx"), "vec_id").select("idx", "v")
    return members, materialize(reps.mapInArrow(_unit, "idx int, u binary"), "nodes")


def _lists(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, pa.Array]:
    """Offsets and flat values of a list column."""
    x = batch.column(column)
    offsets = x.offsets.to_numpy()
    return offsets - offsets[0], x.flatten()


def _matrix(column: pa.Array) -> np.ndarray:
    """Vectors packed in a binary column."""
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float32).reshape(len(column), -1)


def _local_join(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Proposals (idx, nbr, sim) from comparing each node's candidates with one another."""
    for batch in (whole.slice(at, 512) for whole in it for at in range(0, whole.num_rows, 512)):
        offsets, flat = _lists(batch, "near")
        if not len(flat):
            continue
        ids, fresh, floor = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("cand", "fresh", "floor"))
        u = _matrix(flat.field("u"))
        sizes = np.diff(offsets)
        for lo in range(0, len(sizes), 256):
            n = sizes[lo : lo + 256]
            width = int(n.max())
            if width < 2:
                continue
            at = offsets[lo : lo + len(n)][:, None] + np.minimum(np.arange(width), np.maximum(n - 1, 0)[:, None])
            real = np.arange(width) < n[:, None]
            x = u[at]
            sim = x @ x.transpose(0, 2, 1)
            c, f = ids[at], fresh[at]
            useful = real[:, :, None] & real[:, None, :] & (f[:, :, None] | f[:, None, :]) & (c[:, :, None] != c[:, None, :])
            sim = np.where(useful & (sim > floor[at][:, :, None]), sim, -2.0)
            best = np.argpartition(-sim, min(PROPOSALS, width - 1), axis=2)[:, :, :PROPOSALS]
            value = np.take_along_axis(sim, best, 2)
            i, j, k = np.nonzero(value > -1.5)
            yield pa.RecordBatch.from_arrays([pa.array(c[i, j], pa.int32()), pa.array(c[i, best[i, j, k]], pa.int32()), pa.array(value[i, j, k], pa.float32())], ["idx", "nbr", "sim"])


def _keep_nearest(degree: int):
    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            offsets, flat = _lists(batch, "known")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            nbr, sim, fresh = (flat.field(k).to_numpy(zero_copy_only=False) for k in ("nbr", "sim", "fresh"))
            order = np.lexsort((fresh, nbr, owner))
            first = np.r_[True, (owner[order][1:] != owner[order][:-1]) | (nbr[order][1:] != nbr[order][:-1])][: len(order)]
            order = order[first]
            order = order[np.lexsort((nbr[order], -sim[order], owner[order]))]
            o = owner[order]
            rank = np.arange(len(o)) - np.searchsorted(o, o)
            order = order[rank < degree]
            cuts = pa.array(np.searchsorted(owner[order], np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(cuts, pa.array(x[order], t)) for x, t in ((nbr, pa.int32()), (sim, pa.float32()), (fresh, pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("idx"), *lists], ["idx", "nbrs", "sims", "freshs"])

    return apply


def _edges(state: DataFrame) -> DataFrame:
    pairs = F.explode(F.arrays_zip("nbrs", "sims", "freshs"))
    return state.select("idx", pairs.alias("e")).select("idx", F.col("e.nbrs").alias("nbr"), F.col("e.sims").alias("sim"), F.col("e.freshs").alias("fresh"))


def _sampled_in_links(edges: DataFrame, degree: int, turn: int) -> DataFrame:
    """About ``degree`` of each node's in-links, by hash: (nbr, idx, fresh)."""
    counts = edges.groupBy("nbr").agg(F.count(F.lit(1)).alias("n"))
    chance = F.pmod(F.xxhash64("idx", "nbr", F.lit(turn)), F.lit(1 << 30)) / float(1 << 30)
    return edges.join(counts, "nbr").where(chance * F.col("n") < degree).select("nbr", "idx", "fresh")


def descend(nodes: DataFrame, n: int, degree: int = DEGREE, rounds: int = MAX_ROUNDS) -> DataFrame:
    """(idx, nbrs, sims, freshs): the neighbour graph of NN-descent."""
    if n - 1 <= degree:
        others = F.expr(f"transform(sequence(1, {max(n - 1, 1)}), j -> cast((idx + j) % {max(n, 1)} as int))")
    else:
        others = F.expr(f"array_distinct(transform(sequence(1, {degree}), j -> cast(pmod(xxhash64(idx, j), {n}) as int)))")
    start = nodes.select("idx", F.explode(others).alias("nbr")).where("idx <> nbr")
    known = start.select("idx", F.struct("nbr", F.lit(-1.5).cast("float").alias("sim"), F.lit(True).alias("fresh")).alias("k"))
    schema = "idx int, nbrs array<int>, sims array<float>, freshs array<boolean>"
    state = materialize(known.groupBy("idx").agg(F.collect_list("k").alias("known")).mapInArrow(_keep_nearest(degree), schema), "graph")
    for turn in range(rounds):
        edges = _edges(state)
        out = edges.select(F.col("idx").alias("node"), F.col("nbr").alias("cand"), "fresh")
        back = _sampled_in_links(edges, degree, turn).select(F.col("nbr").alias("node"), F.col("idx").alias("cand"), "fresh")
        floor = F.when(F.size("sims") < degree, F.lit(-1.5).cast("float")).otherwise(F.array_min("sims"))
        described = nodes.join(state.select("idx", floor.alias("floor")), "idx", "left").select(F.col("idx").alias("cand"), "u", F.coalesce("floor", F.lit(-1.5).cast("float")).alias("floor"))
        near = out.union(back).groupBy("node", "cand").agg(F.max("fresh").alias("fresh")).join(described, "cand")
        near = near.groupBy("node").agg(F.collect_list(F.struct("cand", "fresh", "floor", "u")).alias("near"), F.max("fresh").alias("any")).where("any").select("near")
        proposed = near.mapInArrow(_local_join, "idx int, nbr int, sim float").groupBy("idx", "nbr").agg(F.max("sim").alias("sim"))
        all_known = edges.select("idx", "nbr", "sim", F.lit(False).alias("fresh")).union(proposed.select("idx", "nbr", "sim", F.lit(True).alias("fresh")))
        grouped = all_known.groupBy("idx").agg(F.collect_list(F.struct("nbr", "sim", "fresh")).alias("known"))
        following = materialize(grouped.mapInArrow(_keep_nearest(degree), schema), "graph")
        changed = following.agg(F.sum(F.size(F.filter("freshs", lambda x: x)))).first()[0] or 0
        discard(state)
        reclaim_driver(nodes.sparkSession)
        state = following
        if changed <= SETTLED * n * degree:
            return state
    raise RuntimeError("the neighbour graph did not settle")


def _widen(beam: int, step: int):
    """Score the fresh nodes of each query, keep the nearest, and choose those to expand next."""

    def apply(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["q", "qu", "ids", "sims", "done", "seen", "front"]
        for batch in it:
            rows = []
            for row_at in range(batch.num_rows):
                q, qu, ids, sims, done, seen = (batch.column(k)[row_at] for k in names[:6])
                query = np.frombuffer(qu.as_py(), np.float32)
                old = [np.asarray(x.values.to_numpy(zero_copy_only=False)) for x in (ids, sims, done)]
                met = np.asarray(seen.values.to_numpy())
                fresh = batch.column("fresh")[row_at].values
                if fresh is not None and len(fresh):
                    new = fresh.field("cand").to_numpy()
                    score = _matrix(fresh.field("u")) @ query
                    old = [np.r_[old[0], new], np.r_[old[1], score], np.r_[old[2], np.zeros(len(new), bool)]]
                    met = np.r_[met, new]
                order = np.lexsort((old[0], -old[1]))[:beam]
                i, s, d = (x[order] for x in old)
                pick = np.flatnonzero(~d)[:step]
                d[pick] = True
                rows.append((q.as_py(), qu.as_py(), i, s, d, met, i[pick]))
            kinds = [pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    return apply


def _unseen(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        out_q, out_c = [], []
        for q, seen, near in zip(batch.column("q").to_pylist(), batch.column("seen"), batch.column("near"), strict=True):
            found = np.setdiff1d(near.values.to_numpy(), seen.values.to_numpy())
            out_q.append(np.full(len(found), q, np.int32))
            out_c.append(found)
        if out_q:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_q), pa.int32()), pa.array(np.concatenate(out_c), pa.int32())], ["q", "cand"])


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, beam: int = BEAM, step: int = STEP, max_steps: int = MAX_STEPS) -> DataFrame:
    """(q, ids, sims): the nearest nodes that greedy search meets from each query node (q: idx), itself included."""
    edges = _edges(graph)
    both = edges.select("idx", "nbr").union(_sampled_in_links(edges, DEGREE, 99).select(F.col("nbr").alias("idx"), F.col("idx").alias("nbr"))).distinct()
    links = materialize(both.groupBy("idx").agg(F.collect_list("nbr").alias("nbrs")), "links")
    state_schema = "q int, qu binary, ids array<int>, sims array<float>, done array<boolean>, seen array<int>, front array<int>"
    begin = nodes.join(queries.select(F.col("q").alias("idx")).distinct(), "idx").select(F.col("idx").alias("q"), F.col("u").alias("qu"))
    empty = begin.select("q", "qu", F.expr("cast(array() as array<int>) ids"), F.expr("cast(array() as array<float>) sims"), F.expr("cast(array() as array<boolean>) done"), F.expr("cast(array() as array<int>) seen"), F.array(F.struct(F.col("q").alias("cand"), F.col("qu").alias("u"))).alias("fresh"))
    state = materialize(empty.mapInArrow(_widen(beam, step), state_schema), "beams")
    for _ in range(max_steps):
        front = state.select("q", F.explode("front").alias("idx"))
        near = front.join(links, "idx").select("q", F.explode("nbrs").alias("cand")).groupBy("q").agg(F.collect_set("cand").alias("near"))
        unseen = state.select("q", "seen").join(near, "q").mapInArrow(_unseen, "q int, cand int")
        fresh = unseen.join(nodes.withColumnRenamed("idx", "cand"), "cand").groupBy("q").agg(F.collect_list(F.struct("cand", "u")).alias("fresh"))
        following = state.drop("front").join(fresh, "q", "left").withColumn("fresh", F.coalesce("fresh", F.expr("cast(array() as array<struct<cand:int,u:binary>>)")))
        following = materialize(following.mapInArrow(_widen(beam, step), state_schema), "beams")
        discard(state)
        reclaim_driver(nodes.sparkSession)
        state = following
        if not state.where(F.size("front") > 0).limit(1).count():
            return state.select("q", "ids", "sims")
    raise RuntimeError("the search did not settle")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two double arrays, summed in the order of components."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 5, every: int = 50, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found of each query: rows whose id ``every`` divides.

    Vectors are compared with those of their own length.
    """
    rows = materialize(valid_vectors(df, key, vector), "vectors")
    lengths = sorted(r["n"] for r in rows.select(F.size("v").alias("n")).distinct().collect()) or [0]
    return reduce(DataFrame.union, [_nearest(rows.where(F.size("v") == n) if len(lengths) > 1 else rows, k, every, beam) for n in lengths])


def _nearest(rows: DataFrame, k: int, every: int, beam: int) -> DataFrame:
    """The search among vectors of one length."""
    members, nodes = nodes_of(rows)
    graph = descend(nodes, nodes.count())
    asked = members.where(F.pmod("vec_id", F.lit(every)) == 0)
    found = search(nodes, graph, asked.select(F.col("idx").alias("q")), beam)
    top = found.select("q", F.explode(F.slice("ids", 1, k * MARGIN + 1)).alias("idx")).union(found.select("q", F.col("q").alias("idx"))).distinct()
    # of a class, only the k + 1 smallest ids can appear; two levels keep a huge class off one task
    salted = Window.partitionBy("idx", F.pmod(F.xxhash64("vec_id"), F.lit(64))).orderBy("vec_id")
    small = members.withColumn("n", F.row_number().over(salted)).where(F.col("n") <= k + 1)
    small = small.withColumn("n", F.row_number().over(Window.partitionBy("idx").orderBy("vec_id"))).where(F.col("n") <= k + 1).select("idx", "vec_id")
    pairs = asked.select(F.col("vec_id").alias("query_id"), F.col("idx").alias("q")).join(top, "q").join(small, "idx").where("query_id <> vec_id").select("query_id", "vec_id")
    a, b = rows.select(F.col("vec_id").alias("query_id"), F.col("v").alias("va")), rows.select("vec_id", F.col("v").alias("vb"))
    scored = pairs.join(a, "query_id").join(b, "vec_id").select("query_id", "vec_id", cosine(F.col("va"), F.col("vb")).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
