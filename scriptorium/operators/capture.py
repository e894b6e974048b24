"""Writing-process events. The ``events`` table stands in: a user is a session; click types, purchase pastes, signup saves,
error undoes, view is a change of focus; value counts characters."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from scriptorium.operators.profiles import pearson, r6


def in_order() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def millis(ts: str = "ts") -> F.Column:
    return F.unix_millis(F.col(ts).cast("timestamp"))


def session_rollup(events: DataFrame) -> DataFrame:
    """STR-01: events by type, typed and pasted characters, paste ratio and duration of each session."""
    chars = lambda kind: F.coalesce(F.sum(F.when(F.col("event_type") == kind, F.floor("value"))), F.lit(0))
    kinds = [F.count_if(F.col("event_type") == k).alias(n) for k, n in (("click", "keystrokes"), ("purchase", "pastes"), ("signup", "saves"), ("error", "undos"), ("view", "focus"))]
    per = events.groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), *kinds, chars("click").alias("typed"), chars("purchase").alias("pasted"), (F.max(millis()) - F.min(millis())).alias("duration_ms"))
    return per.withColumn("paste_ratio", r6(F.when(F.col("typed") + F.col("pasted") == 0, 0.0).otherwise(F.col("pasted") / (F.col("typed") + F.col("pasted")))))


def keystroke_gaps(events: DataFrame) -> DataFrame:
    """WIN-04: time since the session's keystroke before, -1 for its first."""
    keys = events.where("event_type = 'click'")
    return keys.select("user_id", "event_id", F.coalesce(millis() - F.lag(millis()).over(in_order()), F.lit(-1)).alias("gap_ms"))


def timing(events: DataFrame, cap_ms: int = 86_400_000, least: int = 5) -> DataFrame:
    """STR-02, AGG-07: gaps within (0, cap): mean, upper median, population deviation and its ratio to the mean."""
    gaps = keystroke_gaps(events).where((F.col("gap_ms") > 0) & (F.col("gap_ms") < cap_ms))
    per = gaps.groupBy("user_id").agg(F.count(F.lit(1)).alias("gaps"), F.avg("gap_ms").alias("m"), F.sort_array(F.collect_list("gap_ms")).alias("all"), F.stddev_pop("gap_ms").alias("s")).where(F.col("gaps") >= least)
    return per.select("user_id", "gaps", r6(F.col("m")).alias("mean_ms"), F.element_at("all", F.expr("cast(gaps div 2 + 1 as int)")).alias("median_ms"), r6(F.col("s")).alias("sd_ms"), r6(F.col("s") / F.col("m")).alias("cv"))


def flags(events: DataFrame) -> DataFrame:
    """STR-04: process flags of each session."""
    s = session_rollup(events)
    rules = [("high_paste_ratio", F.col("paste_ratio") > 0.5), ("very_high_paste_ratio", F.col("paste_ratio") > 0.8), ("fast_typing", F.col("typed") * 60000.0 / F.greatest("duration_ms", F.lit(1)) > 800), ("no_revision", F.col("undos") == 0), ("no_saves", F.col("saves") == 0)]
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules]), lambda x: x.isNotNull())
    return s.select("user_id", F.explode(found).alias("flag"))


def classify_edits(events: DataFrame) -> DataFrame:
    """STR-08: inserts by size: over 200 characters a paste, over 1 a batch."""
    n = F.floor("value")
    kind = F.when(n > 200, "paste").when(n > 1, "batch").otherwise("keystroke")
    return events.groupBy("user_id", kind.alias("edit")).agg(F.count(F.lit(1)).alias("n"))


def runs(events: DataFrame) -> DataFrame:
    """WIN-05: blocks of equal consecutive event types."""
    changed = F.coalesce((F.col("event_type") != F.lag("event_type").over(in_order())).cast("int"), F.lit(1))
    rows = events.withColumn("changed", changed).withColumn("block", F.sum("changed").over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "block", "event_type").agg(F.count(F.lit(1)).alias("n"))


def bursts(events: DataFrame, gap_ms: int = 7_200_000) -> DataFrame:
    """WIN-06: clusters of events with no gap over the limit; the batch form of a session window."""
    late = F.coalesce((millis() - F.lag(millis()).over(in_order()) > gap_ms).cast("int"), F.lit(1))
    rows = events.withColumn("late", late).withColumn("burst", F.sum("late").over(in_order().rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "burst").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("began"), F.max("ts").alias("ended"))


def hourly(events: DataFrame) -> DataFrame:
    """Tumbling windows of an hour: the batch form of the streaming roll-up."""
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("value")).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def _snapshots(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(user_id, old, new) of events sorted by user and event: sums of the values before and after, in order; null where there are none."""
    user, begun, sums = None, False, [None, None]
    for batch in it:
        done: list[tuple] = []
        for who, late, value in zip(*(batch.column(c).to_pylist() for c in ("user_id", "late", "value")), strict=True):
            if who != user or not begun:
                if begun:
                    done.append((user, *sums))
                user, begun, sums = who, True, [None, None]
            if value is not None:
                sums[late] = value if sums[late] is None else sums[late] + value
        yield _sums(done, batch.schema.field("user_id").type)
        kind = batch.schema.field("user_id").type
    if begun:
        yield _sums([(user, *sums)], kind)


def _sums(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((kind, pa.float64(), pa.float64()))], ["user_id", "old", "new"])


def snapshot_diff(events: DataFrame) -> DataFrame:
    """STR-05, JOI-06: full outer comparison of two snapshots: each user's total before and from 16 January on.

    Values are added in the events' order: a total that is a whole number falls to either side of it with the order of its terms. A task streams
    over its sorted events, so that it holds two totals, however many events a user has.
    """
    late = F.col("ts") >= F.lit("2024-01-16").cast("timestamp")
    rows = events.where("ts is not null").select("user_id", "event_id", late.alias("late"), F.col("value").cast("double").alias("value"))
    rows = rows.repartition("user_id").sortWithinPartitions("user_id", "event_id").drop("event_id")
    totals = rows.mapInArrow(_snapshots, f"user_id {events.schema['user_id'].dataType.simpleString()}, old double, new double")
    both = totals.select("user_id", F.floor("old").alias("old"), F.floor("new").alias("new"))
    kind = F.when(F.col("old").isNull(), F.when(F.col("new") > 5000, "paste").otherwise("new")).when(F.col("new").isNull(), "deleted").when(F.col("new") - F.col("old") > 2000, "paste").when(F.col("new") > F.col("old"), "grown").when(F.col("new") < F.col("old"), "delete").otherwise("same")
    return both.select("user_id", "old", "new", kind.alias("change"))


def metering(events: DataFrame, quota: int = 60) -> DataFrame:
    """AGG-23, 24: use per tenant and month, against a quota."""
    per = events.groupBy("user_id", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("used"))
    return per.withColumn("over", F.col("used") > quota).withColumn("pct", r6(F.least(100.0 * F.col("used") / quota, F.lit(100.0))))


def top_events(events: DataFrame, keep: int = 3) -> DataFrame:
    """WIN-03: the largest events of each session."""
    rank = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("value"), "event_id"))
    return events.withColumn("rank", rank).where(F.col("rank") <= keep).select("user_id", "rank", "event_id", "value")


def correlations(events: DataFrame) -> DataFrame:
    """AGG-08, 09, 10: Pearson's r, Spearman's rho with average ranks, and slope of value over order in each session."""
    by = Window.partitionBy("user_id")
    rows = events.select("user_id", "value", F.row_number().over(in_order()).cast("double").alias("x"), (F.rank().over(by.orderBy("value")) + (F.count(F.lit(1)).over(Window.partitionBy("user_id", "value")) - 1) / 2.0).alias("r"))
    per = rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), pearson("x", "value").alias("p"), F.sum(F.pow(F.col("x") - F.col("r"), 2)).alias("d"), F.regr_slope("value", "x").alias("m")).where("n >= 3")
    return per.select("user_id", r6(F.coalesce("p", F.lit(0.0))).alias("pearson"), r6(1 - 6 * F.col("d") / (F.col("n") * (F.col("n") * F.col("n") - 1))).alias("spearman"), r6(F.col("m")).alias("slope"))


def dominant(events: DataFrame) -> DataFrame:
    """AGG-12: the most frequent event type of each session; ties by name."""
    n = events.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "event_type")).alias("x"))
    return best.select("user_id", F.col("x.event_type").alias("event_type"), (-F.col("x.m")).alias("n"))


def confidence(events: DataFrame) -> DataFrame:
    """STR-06: additive confidence of a session's capture, at most 1."""
    s = session_rollup(events)
    parts = [F.when(F.col("events") >= 50, 0.4).otherwise(0.2), F.when(F.col("duration_ms") >= 3_600_000, 0.3).otherwise(0.1), F.when(F.col("undos") > 0, 0.2).otherwise(0.0), F.when(F.col("saves") > 0, 0.1).otherwise(0.0)]
    return s.select("user_id", r6(F.least(reduce(lambda a, b: a + b, parts), F.lit(1.0))).alias("confidence"))
