"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only.

Each source is a queue of its documents in shuffled order, played up to ``max_repeats`` times. A
document's virtual finish time is its source's cumulative size divided by the source's weight. Serving
in order of virtual finish time and stopping at the budget gives every source its weighted share;
a source that runs dry leaves its share to the others by weight. The virtual time at which the total budget is
spent follows in closed form from the sources' sums: one number, at which the order of all plays is truncated without a global
running sum.

A play that straddles the cut is taken whole if at least half of it lies before, so a
source's taken words miss its target by half a document at most. Null text has size 0; null
``source`` is a source of its own, ordered last. Ties in the shuffled order go by ``doc_id``, then by a hash of the row. Repeated rows are
separate documents. An empty table gives an empty mix. Only the number of a text's words enters, whatever its length. Further columns
stay as they are; names that begin with two underscores are reserved.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import materialize

#: ASCII white space separates words.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows a bucket of one source's shuffled order should hold.
BUCKET_ROWS = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], budget: float, max_repeats: int) -> DataFrame:
    """Per source: weight, size, target, and the virtual time of the cut, which all share. Works on one row per source.

    A source is full at virtual time cap / weight. With the sources in that order, the budget's
    virtual time lies where the capped sum of all first reaches the budget.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("weight", F.element_at(cycle, (F.row_number().over(by_name) - 1) % len(weights) + 1))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(max_repeats))).withColumn("full_at", F.col("cap") / F.col("weight"))
    upto = Window.orderBy("full_at")  # a range frame: sources that are full together count together
    every = Window.partitionBy()
    per = per.withColumn("caps_upto", F.sum("cap").over(upto)).withColumn("open_weight", F.sum("weight").over(every) - F.sum("weight").over(upto))
    per = per.withColumn("budget", F.sum("source_size").over(every) * F.lit(float(budget)))
    filled = F.col("caps_upto") + F.col("full_at") * F.col("open_weight")
    per = per.withColumn("done", filled <= F.col("budget"))
    spent = F.coalesce(F.sum(F.when(F.col("done"), F.col("cap"))).over(every), F.lit(0.0))
    open_ = F.sum(F.when(~F.col("done"), F.col("weight"))).over(every)
    per = per.withColumn("cut", (F.col("budget") - spent) / open_)
    target = F.when(F.col("done") | F.col("cut").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("cut") * F.col("weight")))
    return per.select("source", "source_size", "weight", target.alias("target"), F.coalesce("cut", F.lit(float("inf"))).alias("cut"))


def schedule(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), budget: float = 1.5, max_repeats: int = 2, seed: int = 17) -> DataFrame:
    """Per document: size, its source's size and target, its virtual finish time (first play), copies and words taken.

    The running sum of a source goes over buckets of its shuffled order, so that a source with any share
    of all rows spreads over many tasks.
    """
    narrow = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row_print(docs).alias("row_print")), "sizes")
    n = narrow.count()
    buckets = max(128, -(-n // BUCKET_ROWS))
    hashed = narrow.withColumn("h", F.xxhash64("doc_id", F.lit(seed))).withColumn("bucket", F.pmod(F.shiftrightunsigned("h", 20), F.lit(buckets)))
    sums = hashed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    before = F.sum("bucket_size").over(Window.partitionBy("source").orderBy("bucket")) - F.col("bucket_size")
    targets = source_targets(sums.select("source", F.col("bucket_size").alias("size")), weights, budget, max_repeats)
    offsets = sums.withColumn("before", before).alias("a").join(targets.alias("t"), F.col("a.source").eqNullSafe(F.col("t.source")))
    offsets = offsets.select(F.col("a.source").alias("o_source"), F.col("bucket").alias("o_bucket"), "before", "source_size", "weight", "target", "cut")
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size", "row_print").rowsBetween(Window.unboundedPreceding, 0))
    placed = hashed.withColumn("inside", inside)
    placed = placed.join(offsets, placed["source"].eqNullSafe(offsets["o_source"]) & (placed["bucket"] == offsets["o_bucket"]))
    finish = F.col("before") + F.col("inside")
    placed = placed.withColumn("finish", finish).withColumn("virtual_finish", finish / F.col("weight"))
    middle = lambda k: (F.col("finish") + k * F.col("source_size") - F.col("size") / 2.0) / F.col("weight")
    copies = sum(((middle(k) <= F.col("cut")).cast("int") for k in range(max_repeats)), F.lit(0))
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(0))
    placed = placed.withColumn("copies", copies).withColumn("taken", (F.col("size") * F.col("copies")).cast("long"))
    return placed.select("doc_id", "source", "size", "source_size", "weight", "target", "virtual_finish", "copies", "taken", "row_print")


def row_print(docs: DataFrame) -> Column:
    """A hash of a whole row: rows with the same one and the same ``doc_id`` are repeats of each other."""
    values = [F.to_json(f.name) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema.fields]
    return F.xxhash64(*values, *[v.isNull() for v in values])


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """The mixed stream: every taken document as often as it is taken, range-sorted by virtual finish time.

    Rows find their place in the schedule by their hash. Repeated rows have one place each: one of them is joined with all those places.
    """
    key = ["__id", "__print"]
    plan = schedule(docs, **options).select(F.col("doc_id").alias("__id"), F.col("row_print").alias("__print"), F.col("copies").alias("__copies"), F.col("virtual_finish").alias("__first"), (F.col("source_size") / F.col("weight")).alias("__round"))
    plan = materialize(plan, "schedule")
    per = plan.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), *[F.max(c).alias(c) for c in ("__copies", "__first", "__round")])

    def at(rows: DataFrame, places: DataFrame, how: str = "inner") -> DataFrame:
        return rows.join(places, rows["doc_id"].eqNullSafe(places["__id"]) & (rows["__own"] == places["__print"]), how)

    rows = docs.withColumn("__own", row_print(docs))
    joined = at(rows, per.where("__n = 1 and __copies > 0").drop("__n"))
    again = materialize(per.where("__n > 1").select(*key), "repeated")
    if again.limit(1).count():
        places = plan.where("__copies > 0")
        places = places.join(again.select(F.col("__id").alias("i"), F.col("__print").alias("p")), F.col("__id").eqNullSafe(F.col("i")) & (F.col("__print") == F.col("p")), "left_semi")
        one = at(rows, again, "left_semi").dropDuplicates(["doc_id", "__own"])
        joined = joined.unionByName(at(one, places))
    played = joined.withColumn("__play", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1)))
    played = played.withColumn("__finish", F.col("__first") + F.col("__play") * F.col("__round"))
    return played.repartitionByRange(F.col("__finish"), F.col("__own")).sortWithinPartitions("__finish", "__own").select(*docs.columns)
