"""Distances between dense vectors, and exact k-nearest neighbours for a stated set of queries."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.profiles import r6


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def doubles(vectors: DataFrame) -> DataFrame:
    return vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


#: Queries up to which they are broadcast; beyond it the same pairs are made from blocks of both sides.
BROADCAST_QUERIES = 10_000
#: Bytes of a block of vectors, and pairs that a kernel holds at once.
BLOCK_BYTES, PAIRS_AT_ONCE = 1 << 18, 1 << 15
#: Candidates that a task holds before it keeps the nearest of each query.
HELD = 400_000


def blocks(rows: DataFrame) -> DataFrame:
    """(ids, labels, dim, data): vectors of one length, component by component; those that are null or hold a null have no data and ``dim`` -1."""

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            v = batch.column("v")
            size = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False).copy()
            if v.flatten().null_count:
                size[[i for i, x in enumerate(v.to_pylist()) if x is not None and None in x]] = -1
            for dim in np.unique(size).tolist():
                at, step = np.flatnonzero(size == dim), max(1, BLOCK_BYTES // (8 * max(dim, 1)))
                for some in (pa.array(at[i : i + step]) for i in range(0, len(at), step)):
                    data = None if dim < 0 else v.take(some).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).T.tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([batch.column(c).take(some).to_pylist()], pa.list_(batch.column(c).type)) for c in ("vec_id", "label")] + [pa.array([dim], pa.int32()), pa.array([data], pa.binary())], ["ids", "labels", "dim", "data"])

    kinds = [rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    return rows.mapInArrow(pack, f"ids array<{kinds[0]}>, labels array<{kinds[1]}>, dim int, data binary")


def block_pairs(vectors: DataFrame, every: int = 50) -> DataFrame:
    """JOI-03: blocks of a stated set of queries (ids that ``every`` divides) beside blocks of all vectors; few queries are the broadcast side.

    All pairs are quadratic in number; they are never rows here, but are made within a pair of blocks by the kernel that reads them.
    """
    rows = doubles(vectors).where("vec_id is not null")
    asked = rows.where(F.col("vec_id") % every == 0)
    n = asked.count()
    asked = blocks(asked.repartition(max(1, -(-n // 1000)))).select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "labels", "dim", "data")])
    asked = F.broadcast(asked) if n <= BROADCAST_QUERIES else asked.hint("shuffle_replicate_nl")
    return blocks(rows).repartition(4 * vectors.sparkSession.sparkContext.defaultParallelism).join(asked, how="cross")


def rounded(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """Rounded as the checking SQL rounds doubles: the scaled double itself, halves away from zero."""
    with np.errstate(invalid="ignore"):
        y = x * 10.0**digits
        whole = np.trunc(y)
        out = (whole + np.copysign(np.abs(y - whole) >= 0.5, y)) / 10.0**digits
    return np.where(np.isfinite(y), out, x)


def unpacked(row: dict) -> Iterator[tuple[np.ndarray | None, np.ndarray | None, slice]]:
    """Both matrices of a pair of blocks (component, vector), for as many queries at once as a kernel may hold; none where lengths differ."""
    nq, nv = len(row["q_ids"]), len(row["ids"])
    same = row["dim"] == row["q_dim"] >= 0
    v = np.frombuffer(row["data"]).reshape(row["dim"], nv) if same else None
    q = np.frombuffer(row["q_data"]).reshape(row["dim"], nq) if same else None
    step = max(1, PAIRS_AT_ONCE // nv)
    for i in range(0, nq, step):
        yield (q[:, i : i + step] if same else None), v, slice(i, min(i + step, nq))


def measured_pairs(vectors: DataFrame, kernel: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], *names: str, every: int = 50) -> DataFrame:
    """(query_id, vec_id, names): what ``kernel`` makes of matrices of queries and vectors, for every pair; null where a vector is missing or lengths differ."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                ids, asked = np.array(row["ids"]), np.array(row["q_ids"])
                for q, v, part in unpacked(row):
                    with np.errstate(all="ignore"):
                        out = kernel(q, v) if q is not None else [None] * len(names)
                    keep = asked[part][:, None] != ids[None, :]
                    pairs = [np.broadcast_to(asked[part][:, None], keep.shape)[keep], np.broadcast_to(ids, keep.shape)[keep]]
                    values = [pa.nulls(int(keep.sum()), pa.float64()) if x is None else pa.array(rounded(x[keep])) for x in out]
                    yield pa.RecordBatch.from_arrays([pa.array(p, batch.schema.field("ids").type.value_type) for p in pairs] + values, ["query_id", "vec_id", *names])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return block_pairs(vectors, every).mapInArrow(run, f"query_id {kind}, vec_id {kind}, {', '.join(f'{n} double' for n in names)}")


def added(terms: Iterable[np.ndarray]) -> np.ndarray:
    """Arrays added one after the other, as the sum over a vector's components is."""
    out = None
    for x in terms:
        out = 0.0 + x if out is None else np.add(out, x, out=out)
    return out


def _distances(q: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    if not len(v):
        return [np.zeros((q.shape[1], v.shape[1])) for _ in range(3)]
    dots, ones, squares = (np.zeros((q.shape[1], v.shape[1])) for _ in range(3))
    work = np.empty_like(dots)
    for a, b in zip(q[:, :, None], v[:, None, :], strict=True):
        dots += np.multiply(a, b, out=work)
        np.subtract(a, b, out=work)
        np.abs(work, out=work)  # its square is the difference's
        ones += work
        squares += np.multiply(work, work, out=work)
    norms = np.sqrt(added(x * x for x in q))[:, None] * np.sqrt(added(x * x for x in v))[None, :]
    return [np.where(norms < 1e-12, 0.0, np.clip(dots / norms, -1.0, 1.0)), ones, np.sqrt(squares)]


def distances(vectors: DataFrame) -> DataFrame:
    """DST-01, 02: cosine, Manhattan and Euclid of each query to every vector."""
    return measured_pairs(vectors, _distances, "cosine", "manhattan", "euclidean")


def distributed(kernel: Callable[[np.ndarray, np.ndarray], list[np.ndarray]]) -> Callable[[np.ndarray, np.ndarray], list[np.ndarray]]:
    """A kernel over distributions, made of vectors; not a number where a vector's components are all 0."""

    def run(q: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
        sizes = [added(np.abs(x)) for x in (q, v)]
        void = (sizes[0] == 0)[:, None] | (sizes[1] == 0)[None, :]
        return [np.where(void, np.nan, x) for x in kernel(np.abs(q) / sizes[0], np.abs(v) / sizes[1])]

    return run


def _divergences(p: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    left, right, chi = (np.zeros((p.shape[1], w.shape[1])) for _ in range(3))
    for x, y in zip(p[:, :, None], w[:, None, :], strict=True):
        both = x + y
        half = both / 2
        for a, out in ((x, left), (y, right)):
            term = np.divide(a, half)
            np.log(term, out=term)
            term *= a
            if not a.min() > 1e-10:
                term = np.where(a > 1e-10, term, np.where(np.isnan(a), a, 0.0))
            out += term
        term = x - y
        term *= term
        term /= both
        chi += term if both.min() >= 1e-10 else np.where(both < 1e-10, 0.0, term)
    return [0.5 * left + 0.5 * right, chi]


def divergences(vectors: DataFrame) -> DataFrame:
    """DST-03: Jensen-Shannon with natural logarithms and chi-square of the vectors as distributions."""
    return measured_pairs(vectors, distributed(_divergences), "jsd", "chi2")


def _kullback(p: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    out = np.zeros((p.shape[1], w.shape[1]))
    for x, y in zip(p[:, :, None], w[:, None, :], strict=True):
        term = np.divide(x, y)
        np.log(term, out=term)
        term *= x
        if not (x.min() > 1e-10 and y.min() > 1e-10):
            term = np.where(x <= 1e-10, 0.0, np.where(y <= 1e-10, np.inf, term))
        out += term
    return [out]


def kullback(vectors: DataFrame) -> DataFrame:
    """DST-03: Kullback-Leibler divergence of the vectors as distributions, infinite where the second vanishes and the first does not."""
    return measured_pairs(vectors, distributed(_kullback), "kl")


def _candidates(q: np.ndarray, v: np.ndarray, apart: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs that may be among the k nearest of a query in a block: places of query and vector, and the rounded distance.

    A matrix product bounds the squared distances; the exact one, its components added in order, is made of those only that the bound leaves,
    with all that rounding may make equal to the k-th.
    """
    a, b = (q * q).sum(0), (v * v).sum(0)
    near = a[:, None] + b[None, :] - 2.0 * (q.T @ v)
    slack = 1e-14 * (len(q) + 8) * (a[:, None] + b[None, :])
    near[~apart] = np.inf
    last = np.partition(near + slack, min(k, near.shape[1]) - 1, axis=1)[:, min(k, near.shape[1]) - 1]
    limit = (np.sqrt(np.maximum(last, 0.0)) * (1 + 1e-12) + 2e-6) ** 2
    i, j = np.nonzero(apart & ~(near - slack > limit[:, None]))
    d = np.zeros(len(i))
    for x, y in zip(q, v, strict=True):
        t = x[i] - y[j]
        d += t * t
    return i, j, rounded(np.sqrt(d))


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """JOI-04: the k nearest by Euclid of each query; ties by id. A task keeps k candidates a query of all its blocks."""

    def best(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        asked, ids = rows.column("query_id").to_numpy(), rows.column("vec_id").to_numpy()
        missing = rows.column("d").is_null().to_numpy(zero_copy_only=False)
        order = np.lexsort((ids, rows.column("d").fill_null(np.inf).to_numpy(), missing, asked))
        held = asked[order]
        first = np.flatnonzero(np.r_[True, held[1:] != held[:-1]])
        rank = np.arange(len(held)) - np.repeat(first, np.diff(np.r_[first, len(held)]))
        return rows.take(pa.array(order[rank < k]))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, bound = 0, HELD
        for batch in it:
            id_kind, label_kind = (batch.schema.field(c).type.value_type for c in ("ids", "labels"))
            for row in (batch.slice(r, 1).to_pylist()[0] for r in range(batch.num_rows)):
                ids, asked = np.array(row["ids"]), np.array(row["q_ids"])
                for q, v, part in unpacked(row):
                    apart = asked[part][:, None] != ids[None, :]
                    if q is None:
                        order = np.argsort(ids, kind="stable")[: 2 * k]  # without a distance, the least ids
                        i, j = (x.ravel() for x in np.meshgrid(np.arange(len(apart)), order, indexing="ij"))
                        i, j = i[apart[i, j]], j[apart[i, j]]
                        d = pa.nulls(len(i), pa.float64())
                    else:
                        with np.errstate(all="ignore"):
                            i, j, d = _candidates(q, v, apart, k)
                        d = pa.array(d)
                    i = i + part.start
                    labels = [pa.array(x, label_kind).take(pa.array(at)) for x, at in ((row["q_labels"], i), (row["labels"], j))]
                    held.append(pa.RecordBatch.from_arrays([pa.array(asked[i], id_kind), labels[0], pa.array(ids[j], id_kind), labels[1], d], ["query_id", "query_label", "vec_id", "label", "d"]))
                    size += len(i)
                if size > bound:
                    held = [best(held)]
                    size = held[0].num_rows
                    bound = max(HELD, 2 * size)
        if size:
            yield best(held)

    kinds = [vectors.schema[c].dataType.simpleString() for c in ("vec_id", "label")]
    found = block_pairs(vectors, every).mapInArrow(run, f"query_id {kinds[0]}, query_label {kinds[1]}, vec_id {kinds[0]}, label {kinds[1]}, d double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.asc_nulls_last("d"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def knn_labels(vectors: DataFrame) -> DataFrame:
    """ML-03: label of each query by votes weighted 1 / (d + 1e-10); ties by the smaller label."""
    votes = nearest(vectors).groupBy("query_id", "query_label", "label").agg(F.round(F.sum(1.0 / (F.col("d") + 1e-10)), 5).alias("w"))
    best = votes.groupBy("query_id", "query_label").agg(F.min(F.struct((-F.col("w")).alias("m"), "label")).alias("x"))
    return best.select("query_id", F.col("query_label").alias("actual"), F.col("x.label").alias("predicted"))


def component_stats(vectors: DataFrame) -> DataFrame:
    """AGG-06: mean and population deviation of each component."""
    rows = doubles(vectors).select(F.posexplode("v").alias("component", "x"))
    return rows.groupBy("component").agg(r6(F.avg("x")).alias("mean"), r6(F.greatest(F.stddev_pop("x"), F.lit(1e-10))).alias("sd"))


def centroids(vectors: DataFrame) -> DataFrame:
    """RES-03: mean vector of each label, in long form."""
    rows = doubles(vectors).select("label", F.posexplode("v").alias("component", "x"))
    return rows.groupBy("label", "component").agg(r6(F.avg("x")).alias("mean"))
