"""Global orders without a single-partition window: numbering, prefix sums, neighbours, as-of lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.plans.tables import written

#: Rows of one bucket of a dense order. Buckets are carried on in buckets of buckets, so the one window over all has a row for 2^32 rows.
BUCKET = 1 << 16
_PART = 33  # monotonically_increasing_id(): the partition above these bits, the row in it below


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def numbered(df: DataFrame, order: list[str], name: str = "row_id") -> DataFrame:
    """df, written, with 0-based positions in the given order: range partitions, sorted inside, and one offset for each."""
    dealt = df.repartitionByRange(partitions(df), *order).sortWithinPartitions(*order)
    dealt = written(dealt.withColumn("_numbered_i", F.monotonically_increasing_id()))
    part = F.shiftright("_numbered_i", _PART)
    sizes = sorted((r["_numbered_p"], r["count"]) for r in dealt.groupBy(part.alias("_numbered_p")).count().collect())  # one row for each partition
    offsets, at = [], 0
    for p, n in sizes:
        offsets.append((p, at))
        at += n
    shift = df.sparkSession.createDataFrame(offsets or [(0, 0)], "_numbered_p long, _numbered_at long")
    inside = F.col("_numbered_i").bitwiseAND(F.lit((1 << _PART) - 1))
    out = dealt.withColumn("_numbered_p", part).join(F.broadcast(shift), "_numbered_p").withColumn(name, (F.col("_numbered_at") + inside).cast("long")).drop("_numbered_p", "_numbered_i", "_numbered_at")
    out._written_at = dealt._written_at
    return out


def _sum(c: str, w) -> Column:
    return F.coalesce(F.sum(c).over(w), F.lit(0))


def _last(c: str, w) -> Column:
    return F.last(c, True).over(w)


def _carried(edges: DataFrame, names: list[str], take) -> DataFrame:
    """edges has one row for each bucket _b; the result has, in the same columns, what the buckets before it add up to (take is _sum) or leave (_last)."""
    d = edges.withColumn("_bb", F.expr(f"_b div {BUCKET}"))
    before = lambda *by: Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("_bb").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    d = d.select("_b", "_bb", *(take(n, before("_bb")).alias(f"_in_{n}") for n in names), *(take(n, whole).alias(n) for n in names))
    top = d.groupBy("_bb").agg(*(F.first(n).alias(n) for n in names)).withColumnRenamed("_bb", "_b")
    top = top.select(F.col("_b").alias("_bb"), *(take(n, before()).alias(f"_up_{n}") for n in names))
    both = (lambda n: F.col(f"_in_{n}") + F.col(f"_up_{n}")) if take is _sum else (lambda n: F.coalesce(f"_in_{n}", f"_up_{n}"))
    return d.join(top, "_bb").select("_b", *(both(n).alias(n) for n in names))


def prefix_sums(df: DataFrame, key: str, sums: dict[str, Column]) -> DataFrame:
    """Exclusive running sums along a dense 0-based key: inside buckets, plus the sums of the buckets before."""
    d = df.withColumn("_b", F.expr(f"{key} div {BUCKET}")).withColumns({f"_v_{n}": c.cast("long") for n, c in sums.items()})
    within = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    totals = _carried(d.groupBy("_b").agg(*(F.sum(f"_v_{n}").alias(f"_o_{n}") for n in sums)), [f"_o_{n}" for n in sums], _sum)
    d = d.withColumns({f"_w_{n}": _sum(f"_v_{n}", within) for n in sums}).join(totals, "_b")
    return d.withColumns({n: (F.col(f"_w_{n}") + F.col(f"_o_{n}")).cast("long") for n in sums}).drop("_b", *(f"_{x}_{n}" for n in sums for x in "vwo"))


def beside(df: DataFrame, key: str, cols: dict[str, str], step: int = -1) -> DataFrame:
    """The columns of the row before (step -1) or after (1) each row of a dense key, null at the end: inside buckets, and from the edge of the next."""
    d = df.withColumn("_b", F.expr(f"{key} div {BUCKET}"))
    edge = d.groupBy("_b").agg(*((F.max_by if step < 0 else F.min_by)(c, key).alias(f"_e_{n}") for n, c in cols.items()))
    w = Window.partitionBy("_b").orderBy(key)
    near = F.lag if step < 0 else F.lead
    at_edge = F.row_number().over(w) == 1 if step < 0 else F.lead(key).over(w).isNull()
    d = d.withColumns({f"_n_{n}": near(c).over(w) for n, c in cols.items()} | {"_at_edge": at_edge})
    d = d.join(edge.withColumn("_b", F.col("_b") - step), "_b", "left")
    return d.withColumns({n: F.when(F.col("_at_edge"), F.col(f"_e_{n}")).otherwise(F.col(f"_n_{n}")) for n in cols}).drop("_b", "_at_edge", *(f"_{x}_{n}" for n in cols for x in "en"))


def stretches(df: DataFrame, key: str, groups: dict[str, list[str]]) -> DataFrame:
    """df, written, with for each name of groups: the key at which the stretch of rows with equal columns begins (name), and whether it has more than this row (name_more)."""
    d = df.withColumns({f"_g_{n}": F.struct(*cols) for n, cols in groups.items()})
    d = beside(d, key, {f"_p_{n}": f"_g_{n}" for n in groups})
    d = beside(d, key, {f"_q_{n}": f"_g_{n}" for n in groups}, 1)
    own = lambda n, x: F.coalesce(F.col(f"_{x}_{n}") != F.col(f"_g_{n}"), F.lit(True))
    d = d.withColumn("_b", F.expr(f"{key} div {BUCKET}"))
    upto = Window.partitionBy("_b").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({f"{n}_more": ~(own(n, "p") & own(n, "q")) for n in groups} | {n: F.last(F.when(own(n, "p"), F.col(key)), True).over(upto) for n in groups})
    d = written(d.drop(*(f"_{x}_{n}" for n in groups for x in "gpq")))
    left = _carried(d.groupBy("_b").agg(*(F.max(n).alias(f"_l_{n}") for n in groups)), [f"_l_{n}" for n in groups], _last)
    out = d.join(left, "_b").withColumns({n: F.coalesce(n, f"_l_{n}") for n in groups}).drop("_b", *(f"_l_{n}" for n in groups))
    out._written_at = d._written_at
    return out


def islands(df: DataFrame, key: str, value: str, alone: Column) -> DataFrame:
    """Runs of equal values (nulls are equal) along a dense 0-based key: run_id, value, start, len. Rows for which alone holds are runs of their own."""
    d = beside(df.select(key, value), key, {"_before": value})
    d = d.withColumn("_new", (alone | (F.col(key) == 0) | ~F.col("_before").eqNullSafe(F.col(value))).cast("int"))
    d = prefix_sums(d, key, {"_runs": F.col("_new")}).withColumn("run_id", F.col("_runs") + F.col("_new") - 1)
    return d.groupBy("run_id").agg(F.first(value).alias(value), F.min(key).alias("start"), F.count("*").alias("len"))


def as_of(probes: DataFrame, key: str, table: DataFrame, table_key: str, value: str, by: int = BUCKET) -> DataFrame:
    """probes with the value of the last table row at or before key (null if none); table keys are distinct.

    Rows are dealt to buckets of the key; a bucket without a start of its own takes what the buckets before left.
    """
    both = probes.select(F.col(key).alias("_k"), F.lit(1).alias("_probe"), F.struct(*probes.columns).alias("_row"), F.lit(None).cast(table.schema[value].dataType).alias("_v")).unionByName(
        table.select(F.col(table_key).alias("_k"), F.lit(0).alias("_probe"), F.lit(None).cast(probes.select(F.struct(*probes.columns)).schema[0].dataType).alias("_row"), F.col(value).alias("_v"))
    )
    both = both.withColumn("_b", F.expr(f"_k div {by}"))
    left = _carried(both.groupBy("_b").agg(F.max_by("_v", F.when(F.col("_probe") == 0, F.col("_k"))).alias("_left")), ["_left"], _last)
    here = F.last("_v", True).over(Window.partitionBy("_b").orderBy("_k", "_probe").rowsBetween(Window.unboundedPreceding, 0))
    return both.withColumn("_h", here).join(left, "_b").where("_probe = 1").select("_row.*", F.coalesce("_h", "_left").alias(value))


def range_join(left: DataFrame, lo: str, hi: str, right: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Pairs whose closed intervals [lo, hi] and [start, end] overlap.

    Both sides go to bins, and a pair counts in its first common bin. The bins of the right side are of its interval's own
    length class (width times a power of 4), so an interval goes to five bins at most however long it is; the left side goes to
    the bins of every class that the right side has.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log(4.0, (F.col(end) - F.col(start) + 1) / width))).cast("int")
    right = right.where(f"{start} <= {end}").withColumn("_level", level)
    levels = sorted(r[0] for r in right.select("_level").distinct().collect())  # at most 32 classes
    if not levels:
        levels = [0]
    left = left.where(f"{lo} <= {hi}").withColumn("_level", F.explode(F.array(*map(F.lit, levels))))
    size = f"({width} * cast(shiftleft(1L, 2 * _level) as bigint))"
    bins = lambda a, b: F.explode(F.sequence(F.expr(f"{a} div {size}"), F.expr(f"{b} div {size}")))
    joined = left.withColumn("_bin", bins(lo, hi)).join(right.withColumn("_bin", bins(start, end)).hint("merge"), ["_level", "_bin"])
    return joined.where(f"{start} <= {hi} and {end} >= {lo} and _bin = greatest({lo} div {size}, {start} div {size})").drop("_bin", "_level")
