"""Mixing sources to target weights by exponential-key sampling.

Every document draws the key E / w (E exponential, from a hash of its id; w its quality weight); taking keys
in rising order is weighted sampling without replacement. A source's target is met by complete epochs
first, then by documents in key order up to the budget of the last, fractional epoch.

A source may hold a third of all rows, so no task orders a whole source: keys are cut into buckets (rising
with the key, about ``BUCKET_ROWS`` rows each), buckets are summed before the shuffle, and running sums over
buckets tell which single bucket of a source the budget ends in; only that one is ordered row by row. A source's budget
so becomes one key, the last that is taken, and rows meet one small row a source: no text is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wristwave.llm.common import WORD_GAP, fresh_name, materialise, split_rows

WEIGHTS = (5, 2, 1)
MOST = 3
BUCKET_ROWS = 4096
#: Tables of one row a source are broadcast up to this many sources.
SOURCES = 10_000


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) from 52 bits of a digest of the key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null"))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def targets(totals: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, total) to (source, total, target).

    Sources in code point order (null last) weigh ``weights`` in turn and share all of the totals; a target above
    ``most`` times its total stops there and the excess is shared again by weight. In order of total / weight the
    stopped sources come first, so running sums give the final level at once. One task sees one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = totals.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1))
    fill = Window.orderBy(F.col("total") / F.col("w"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    after = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    level = (F.sum("total").over(everything) - F.coalesce(F.sum(most * F.col("total")).over(before), F.lit(0))) / F.sum("w").over(after)
    leveled = ranked.withColumn("level", level).withColumn("open", F.col("level") * F.col("w") <= most * F.col("total"))
    final = F.min(F.when(F.col("open"), F.struct(F.col("total") / F.col("w"), F.col("source").isNull(), "source", "level"))).over(everything)["level"]
    goal = F.least((most * F.col("total")).cast("double"), F.coalesce(final * F.col("w"), (most * F.col("total")).cast("double")))
    return leveled.select("source", "total", goal.alias("target"))


def mix(docs: DataFrame, size: Column, weight: Column, key: str = "doc_id", source: str = "source", seed: int = 11, weights=WEIGHTS, most: int = MOST, out: str = "mix") -> DataFrame:
    """The table with a struct ``out`` of size, source_size, target, epochs, part.

    The mix takes a document ``epochs`` times whole and then its first ``part`` words: part is its size if the
    fractional epoch takes it, less for the one document of a source that the budget ends in, else 0.
    Null sizes count 0, null or non-positive weights count 1, a null source is a source. Rows without a key draw by
    their place in the table; rows of equal keys and sizes are ordered by it. Needs every row once: repeated rows are documents of
    their own. A column called like ``out`` is replaced; other columns are not looked at and never moved.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == out.lower()])
    mark, row = fresh_name(docs, "mix_mark"), F.monotonically_increasing_id()
    w = F.when(weight > 0, weight).otherwise(1.0)
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("place "), row.cast("string")))
    # 1 - exp(-E / w) with E = -log(1 - uniform): rises with the key and lies in (0, 1)
    u = 1 - F.pow(1 - uniform(name, seed), 1 / w)
    fields = {"u": u, "key": F.col(key), "size": F.coalesce(size, F.lit(0)).cast("long"), "row": row, "source": F.col(source)}
    stored = materialise(docs.withColumn(mark, F.struct(*[c.alias(k) for k, c in fields.items()])), "mix_rows")
    rows = stored.select(f"{mark}.*")
    totals = materialise(rows.groupBy("source").agg(F.sum("size").alias("total"), F.count(F.lit(1)).alias("rows")), "mix_totals")
    goals = targets(totals.select("source", "total"), weights, most)
    plan = goals.join(totals.select(F.col("source").alias("s"), "rows"), F.col("source").eqNullSafe(F.col("s"))).drop("source")
    epochs = F.when(F.col("total") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("total")))).otherwise(0).cast("long")
    plan = plan.withColumn("epochs", epochs).withColumn("budget", F.when(F.col("epochs") >= most, F.lit(0)).otherwise(F.round(F.col("target") - F.col("epochs") * F.col("total"))).cast("long"))
    plan = materialise(plan.withColumn("buckets", F.ceil(F.col("rows") / BUCKET_ROWS)).drop("rows"), "mix_plan")
    at = F.least(F.col("buckets") - 1, F.floor(F.col("u") * F.col("buckets")))
    keyed = rows.join(_small(plan), F.col("source").eqNullSafe(F.col("s"))).withColumn("at", at)
    # the bucket that the budget of a source ends in, and the words before it
    run = Window.partitionBy("s").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sums = keyed.groupBy("s", "at").agg(F.sum("size").alias("in"), F.max("budget").alias("most")).withColumn("before", F.coalesce(F.sum("in").over(run), F.lit(0)))
    ends = sums.filter(F.col("before") + F.col("in") > F.col("most")).groupBy("s").agg(F.min(F.struct("at", "before")).alias("end"))
    ends = materialise(ends.select(F.col("s").alias("es"), "end.*").withColumnRenamed("at", "end_at"), "mix_ends")
    # the row of that bucket that it ends in
    place = F.struct("u", "key", "size", "row")
    inside = Window.partitionBy("s").orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    edge = keyed.join(_small(ends), F.col("s").eqNullSafe(F.col("es")) & (F.col("at") == F.col("end_at")))
    edge = edge.withColumn("room", F.col("budget") - F.col("before") - F.coalesce(F.sum("size").over(inside), F.lit(0)))
    last = edge.filter(F.col("size") > F.col("room")).groupBy("es").agg(F.min(F.struct(place.alias("place"), "room")).alias("last"))
    plan = plan.join(last, F.col("s").eqNullSafe(F.col("es")), "left").select("s", F.struct("total", "target", "epochs", "last").alias("plan"))
    known, to = fresh_name(docs, "mix_source"), fresh_name(docs, "mix_plan")
    plan = materialise(plan.select(F.col("s").alias(known), F.col("plan").alias(to)), "mix_decided")
    met = stored.join(_small(plan), F.col(f"{mark}.source").eqNullSafe(F.col(known)))
    here, end = F.struct(*[F.col(f"{mark}.{c}").alias(c) for c in ("u", "key", "size", "row")]), F.col(f"{to}.last.place")
    part = F.when(end.isNull() | (here < end), F.col(f"{mark}.size")).when(F.col(f"{mark}.row") == end["row"], F.col(f"{to}.last.room")).otherwise(0).cast("long")
    told = {"size": F.col(f"{mark}.size"), "source_size": F.col(f"{to}.total"), "target": F.col(f"{to}.target"), "epochs": F.col(f"{to}.epochs"), "part": part}
    return met.select(*docs.columns, F.struct(*[c.alias(k) for k, c in told.items()]).alias(out))


def _small(plan: DataFrame) -> DataFrame:
    """A table of one row a source, marked for a broadcast if there are few sources."""
    return F.broadcast(plan) if plan.limit(SOURCES + 1).count() <= SOURCES else plan


def quality_weight(docs: DataFrame, labels: DataFrame, key: str = "doc_id", weight: str = "weight") -> DataFrame:
    """The table with a weight: 2 for documents labelled good, 0.5 for bad, 1 without a label. Of repeated labels the best counts.

    Only rows whose key may have a label meet the labels; the others stay where they are.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() == weight.lower()])
    lk, lw = fresh_name(docs, "label_key"), fresh_name(docs, "label_weight")
    best = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast(docs.schema[key].dataType).alias(lk)).agg(F.max("quality").alias(lw))
    best = materialise(best.withColumn(lw, F.when(F.col(lw) >= 1, 2.0).when(F.col(lw) <= 0, 0.5).otherwise(1.0)), "mix_labels")
    may, rest = split_rows(docs, best.select(F.xxhash64(lk).alias("h")), F.col(key))
    told = may.join(best, may[key] == best[lk], "left").withColumn(weight, F.coalesce(lw, F.lit(1.0))).drop(lk, lw)
    return told.unionByName(rest.withColumn(weight, F.lit(1.0)))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, or all of it."""
    lead = F.when(text.rlike(f"^{WORD_GAP}"), 1).otherwise(0)
    parts = F.split(text, WORD_GAP, (n + 1 + lead).cast("int"))
    rest = F.when(F.size(parts) == n + 1 + lead, F.length(F.element_at(parts, -1))).otherwise(0)
    return F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - rest), f"{WORD_GAP}$", "")
