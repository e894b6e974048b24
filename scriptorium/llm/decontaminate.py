"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

A text's template replaces names (every capitalised word, at a sentence's start too), numbers and units by typed placeholders and drops case
and punctuation, word for word, so that a template's words stay aligned with the text's. All windows of the benchmark's templates meet, by
hash, all windows of the documents' templates; benchmark windows with fewer than ``LITERAL`` words besides the placeholders, as in a table of numbers,
meet only if their values are the same, by the item's first such window. Each candidate alignment of a document with an item, and its neighbours up to ``SLACK`` words away, is then
compared word by word. Alignments that lie close together are one occurrence, and its agreeing words, over all runs and shifts, are summed:
an item copied with words changed, inserted or left out here and there is found by its share of agreeing words. The values that fill the
item's slots must map to the document's consistently: a question asked again with other numbers is caught, a chance mixture of numbers is
not. In a run they all must; in the sum, a value that goes another way than its like does not count.

Most agreeing words must be literal, unless the slots hold the item's own values. Items under ``SHORT`` words must be repeated whole, with their
own values. Null and empty texts match nothing. Rows are told apart by ``doc_id`` (which may be null) and text; repeated rows are judged alike.
An empty benchmark flags nothing, and of equally good places the first is reported. Long texts are taken whole. Columns other than those named
are not read; ``decontaminated`` returns them as they are.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.session import materialize

WINDOW = 8
#: Shorter items must be repeated whole.
SHORT = 11
#: A run of so many words is evidence by itself; shorter ones if together they cover so much of the item.
LONG_RUN, SHARE = 13, 0.6
#: Words of a run that counts in the sum; words by which alignments around a candidate are tried.
PART, SLACK = 3, 4
#: Literal words of a window that is looked up by its template.
LITERAL = 3
#: Rows of the benchmark's window table (16 bytes each), and of candidates, up to which they are broadcast; and bytes of its texts.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 16 << 20
#: Stands for a null doc_id.
NO_ID = -(1 << 63)
NUMBER, NAME, UNIT = "\u0001", "\u0002", "\u0003"
SLOT = f"[{NUMBER}-{UNIT}]"
UNITS = "kilometers|kilometres|meters|metres|miles|feet|inches|km|cm|mm|kilograms|grams|kg|mg|pounds|ounces|liters|litres|ml|hours|minutes|seconds|days|weeks|months|years|dollars|euros|cents|percent|degrees"


def _spaced(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def template_text(text: Column) -> Column:
    """The template, one word for each white-space word of the text (a word of punctuation alone becomes empty)."""
    x = F.regexp_replace(_spaced(text), r"(?<![\p{L}\p{M}'’])\p{Lu}\p{Ll}+", NAME)
    x = F.regexp_replace(x, r"[0-9]+(?:[.,:/-][0-9]+)*", NUMBER)
    x = F.regexp_replace(x, rf"(?<={NUMBER} ?)(?:{UNITS})\b", UNIT)
    return F.regexp_replace(F.lower(x), r"[^\p{L}\p{M}\x01-\x03 ]+", "")


def _templates(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, F.split(template_text(F.col("text")), " ").alias("words"), F.split(_spaced(F.col("text")), " ").alias("values"))


def _exploded(df: DataFrame, keys: list[str], hashes: list[str]) -> DataFrame:
    """(keys, at, h) of arrays of hashes by their first word."""
    return df.select(*keys, F.explode(F.array(*map(F.expr, hashes))).alias("hashes")).select(*keys, F.posexplode("hashes").alias("nth", "h")).select(*keys, (F.col("nth") + 1).alias("at"), "h")


def _hashes(n: int, one: str) -> str:
    # short texts give empty arrays: a filter on their size would compute the templates twice
    return f"if(size(words) >= {n}, transform(sequence(1, size(words) - {n - 1}), i -> {one}), cast(array() as array<bigint>))"


def _by_template(n: int) -> str:
    return f"xxhash64(slice(words, i, {n}))"


def _by_value(n: int) -> str:
    return f"xxhash64(slice(values, i, {n}), 1)"


def _item_windows(items: DataFrame, sizes: list[int]) -> DataFrame:
    """(item_id, item_at, h, plain): all windows of the items; those with too few literal words go by their values, and are not plain."""
    parts = []
    for n in sizes:
        few = f"size(filter(slice(words, i, {n}), w -> w > '{UNIT}')) < {min(LITERAL, n)}"
        some = items.where(F.col("n") >= n if n == WINDOW else F.col("n") == n)
        made = _exploded(some, ["item_id"], [_hashes(n, f"if({few}, {_by_value(n)}, {_by_template(n)})")])
        flags = some.select("item_id", F.posexplode(F.expr(_hashes(n, f"if({few}, 0L, 1L)"))).alias("nth", "plain")).select("item_id", (F.col("nth") + 1).alias("at"), (F.col("plain") == 1).alias("plain"))
        parts.append(made.join(flags, ["item_id", "at"]))
    ends = reduce(DataFrame.union, parts).groupBy("item_id", "h").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.first("plain").alias("plain"))
    return ends.select("item_id", "h", "plain", F.explode(F.array_distinct(F.array("first", "last"))).alias("item_at"))


def _small(df: DataFrame, bound: int = BROADCAST_ROWS) -> DataFrame:
    return F.broadcast(df) if df.count() <= bound else df


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("text").alias("copy"), "text")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and benchmark item that it repeats: where, how much, and whether its slots were refilled."""
    best = F.max(F.struct("run_words", (-F.col("start_word")).alias("minus_start"), "item_words", "slots", "refilled"))
    hits = _hits(docs, benchmark).groupBy(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "item_id").agg(best.alias("x"))
    return hits.select("doc_id", "item_id", (-F.col("x.minus_start")).alias("start_word"), "x.run_words", "x.item_words", "x.slots", "x.refilled")


def _hits(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """As ``contaminated``, for each text apart: doc_id (NO_ID for null) and copy, a hash of the text, tell them apart."""
    rows, key = _rows(docs), ["doc_id", "copy"]
    items = benchmark.select("item_id", "text").where(F.col("item_id").isNotNull() & (_spaced(F.col("text")) != ""))
    items = materialize(_templates(items, "item_id").withColumn("n", F.size("words")), "items")
    short = [r["n"] for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect()]  # under WINDOW rows
    sizes = [WINDOW, *short]
    index = materialize(_item_windows(items, sizes), "item-windows")
    hashes = [_hashes(n, _by_template(n)) for n in sizes]
    if index.where("not plain").limit(1).count():
        hashes += [_hashes(n, _by_value(n)) for n in sizes]
    seen = _exploded(_templates(rows, *key), key, hashes)
    found = seen.join(_small(index.drop("plain")), "h").select(*key, "item_id", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    found = materialize(found, "candidates")
    some = _small(found.select(*key).distinct())
    # candidates of one item that lie close together are one occurrence
    ordered = Window.partitionBy(*key, "item_id").orderBy("shift")
    far = F.coalesce(F.col("shift") - F.lag("shift").over(ordered) > F.greatest(F.lit(2 * SLACK), F.col("n") / 2), F.lit(False))
    groups = found.join(_small(items.select("item_id", "n"), 50_000), "item_id").withColumn("far", far.cast("int"))
    groups = groups.withColumn("place", F.sum("far").over(ordered)).groupBy(*key, "item_id", "place").agg(F.collect_set("shift").alias("seeds"))
    shifts = F.expr(f"array_distinct(flatten(transform(seeds, s -> sequence(s - {SLACK}, s + {SLACK}))))")
    again = _templates(rows.join(some, key, "left_semi"), *key).join(groups.select(*key, "item_id", "place", shifts.alias("shifts")), key)
    theirs = items.select("item_id", "n", F.col("words").alias("item_words"), F.col("values").alias("item_values"))
    size = items.agg(F.sum(F.expr("aggregate(values, 16L, (a, v) -> a + 2 * octet_length(v) + 32)"))).first()[0] or 0
    again = again.join(F.broadcast(theirs) if size <= BROADCAST_BYTES else theirs, "item_id")
    same = "i <= n and coalesce(get(words, i + s - 1) = get(item_words, i - 1), false)"
    longer = f"if(i - a.start >= least({PART}, n), concat(a.runs, array(named_struct('first', a.start, 'len', i - a.start, 'shift', s))), a.runs)"
    runs = f"aggregate(sequence(1, n + 1), named_struct('start', 1, 'runs', cast(array() as array<struct<first: int, len: int, shift: int>>)), (a, i) -> if({same}, a, named_struct('start', i + 1, 'runs', {longer})), a -> a.runs)"
    again = again.withColumn("r", F.explode(F.expr(f"flatten(transform(shifts, s -> {runs}))")))
    bare = "lower(regexp_replace({}, '[.,;:!?]+$', ''))"
    pair = f"named_struct('at', i, 'word', item_words[i - 1], 'theirs', {bare.format('item_values[i - 1]')}, 'ours', {bare.format('values[i + r.shift - 1]')})"
    again = again.select("doc_id", "copy", "item_id", "place", "n", "r", F.expr(f"transform(sequence(r.first, r.first + r.len - 1), i -> {pair})").alias("run"))
    again = again.withColumn("slots", F.expr(f"array_distinct(transform(filter(run, x -> x.word rlike '{SLOT}'), x -> named_struct('theirs', x.theirs, 'ours', x.ours)))"))
    count = lambda test: F.expr(f"size(filter(run, x -> {test}))")
    consistent = F.size("slots") == F.size(F.expr("array_distinct(transform(slots, s -> s.theirs))"))
    alone = ((F.col("r.len") >= LONG_RUN) | (F.col("r.len") >= SHARE * F.col("n"))) & consistent
    own = ~F.expr("exists(slots, s -> s.theirs <> s.ours)") & (2 * count("x.word <> ''") >= F.col("r.len"))
    alone = alone & (own | (2 * count("x.word rlike '\\\\p{L}'") >= F.col("r.len"))) & ((F.col("n") >= SHORT) | (own & (F.col("r.len") == F.col("n"))))
    # each word of the item by the longest run that holds it
    where = ["doc_id", "copy", "item_id", "place"]
    words = again.select(*where, "n", "r", alone.alias("alone"), F.explode("run").alias("x"))
    best = F.max(F.struct("r.len", (-F.col("r.shift")).alias("minus"), "x.word", "x.theirs", "x.ours")).alias("b")
    words = words.groupBy(*where, "n", "x.at").agg(best, F.max("alone").alias("alone"))
    words = words.select(*where, "n", "alone", (F.col("at") - F.col("b.minus") - 1).alias("doc_at"), "b.word", "b.theirs", "b.ours", F.col("b.word").rlike(SLOT).alias("slot"))
    words = words.withColumn("votes", F.count("*").over(Window.partitionBy(*where, "slot", "theirs", "ours")))
    first = F.first("ours").over(Window.partitionBy(*where, "slot", "theirs").orderBy(F.desc("votes"), "ours"))
    words = words.withColumn("agrees", ~F.col("slot") | (F.col("ours") == first))
    yes = lambda test: F.count_if(F.col("agrees") & test)
    sums = words.groupBy(*where, "n").agg(F.max("alone").alias("alone"), yes(F.lit(True)).cast("int").alias("agreed"), yes(F.col("word").rlike(r"\p{L}")).alias("literal"), yes(F.col("word") != "").alias("filled"), yes(F.col("slot") & (F.col("theirs") != F.col("ours"))).alias("changed"), F.min(F.when(F.col("agrees"), F.col("doc_at"))).alias("start"), F.size(F.collect_set(F.when(F.col("agrees") & F.col("slot"), F.struct("theirs", "ours")))).alias("slots"))
    own = (F.col("changed") == 0) & (2 * F.col("filled") >= F.col("agreed"))
    summed = (F.col("n") >= SHORT) & (F.col("agreed") >= SHARE * F.col("n")) & (own | (2 * F.col("literal") >= F.col("agreed")))
    best = F.max(F.struct(F.col("agreed").alias("run_words"), (-F.col("start")).alias("minus_start"), F.col("n").alias("item_words"), "slots", (F.col("changed") > 0).alias("refilled")))
    hits = sums.where(F.col("alone") | summed).groupBy(*key, "item_id").agg(best.alias("x"))
    return hits.select(*key, "item_id", (-F.col("x.minus_start")).alias("start_word"), "x.run_words", "x.item_words", "x.slots", "x.refilled")


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that repeat no benchmark item; all columns stay."""
    flagged = materialize(_hits(docs, benchmark).select(F.col("doc_id").alias("__id"), F.col("copy").alias("__copy")).distinct(), "flagged")
    same = (F.coalesce(docs["doc_id"].cast("long"), F.lit(NO_ID)) == F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__copy"))
    return docs.join(_small(flagged), same, "left_anti").select(*docs.columns)
