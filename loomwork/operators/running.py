"""Numbers and running sums in an order over all rows or within keys, without a window that holds them all.

Rows are dealt into ranges of the order, as many as there are shuffle partitions, sorted there, and written once to the
shared folder with their place. What goes from range to range is one row a range. The order's columns must tell
rows apart where a key is hot, so that its rows spread over ranges; rows equal in all of them have any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.sources.shared import small, stored

#: The bits of monotonically_increasing_id that count within a partition.
_BITS = 33


def in_ranges(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows, written, with _at: ascending in the order (nulls first); its upper bits number the range, the lower ones rows in it."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranges")


def span() -> Column:
    """The range of a row of in_ranges."""
    return F.shiftright("_at", _BITS)


def _ahead(sums: DataFrame, name: str) -> DataFrame:
    """_span, _ahead: the sum of `name` over the ranges before; a row a range."""
    before = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_span", F.coalesce(F.sum(name).over(before), F.lit(0)).alias("_ahead"))


def running_total(rows: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """rows with `name`: the sum of value over the rows before, in the order of `order`."""
    placed = in_ranges(rows.withColumn("_added", value), order).withColumn("_span", span())
    offsets = _ahead(placed.groupBy("_span").agg(F.sum("_added").alias("_sum")), "_sum")
    inside = Window.partitionBy("_span").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    summed = placed.withColumn("_inside", F.coalesce(F.sum("_added").over(inside), F.lit(0)))
    return summed.join(F.broadcast(offsets), "_span").withColumn(name, F.col("_ahead") + F.col("_inside")).drop("_span", "_ahead", "_inside", "_at", "_added")


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with `name`: 1, 2, ... in the order of `order`. Only counts of ranges are summed, no rows."""
    placed = in_ranges(rows, order).withColumn("_span", span())
    offsets = _ahead(placed.groupBy("_span").agg(F.count("*").alias("_n")), "_n")
    inside = F.col("_at") - F.shiftleft("_span", _BITS)
    return placed.join(F.broadcast(offsets), "_span").withColumn(name, F.col("_ahead") + inside + 1).drop("_span", "_ahead", "_at")


def numbered_within(rows: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """rows with `name`: 1, 2, ... within each key (nulls are one) in the order of `order`.

    A row's number is its number over all rows less the number of those before its key, so a key's rows never meet in one task."""
    all_numbers = numbered(rows, [key, *order], "_number")
    first = small(all_numbers.groupBy(F.col(key).alias("_key")).agg(F.min("_number").alias("_first")))
    joined = all_numbers.join(first, F.col(key).eqNullSafe(F.col("_key")))
    return joined.withColumn(name, F.col("_number") - F.col("_first") + 1).drop("_number", "_first", "_key")


def medians(rows: DataFrame, values: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """by, and the exact median of each column of `values` as double; nulls do not count, a group without any has null.

    Equal values are counted first. Their counts are summed in the order of group and value, in ranges; the values at
    the middle are those whose stretch of numbers holds it, so no task has all of a group's values."""
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("name"), F.col(v).cast("double").alias("value")) for v in values)))
    long = rows.select(*by, each.alias("_x")).select(*by, F.col("_x.name").alias("_name"), F.col("_x.value").alias("_value"))
    group = [*by, "_name"]
    counted = running_total(long.filter("_value is not null").groupBy(*group, "_value").agg(F.count("*").alias("_n")), [*group, "_value"], F.col("_n"), "_before")
    counted = stored(counted, "counts")
    sizes = counted.groupBy(*(F.col(c).alias(f"_of{c}") for c in group)).agg(F.min("_before").alias("_start"), F.sum("_n").alias("_total"))
    joined = counted.join(small(sizes), [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in group])
    first = F.col("_before") - F.col("_start")
    holds = lambda place: (first < place) & (place <= first + F.col("_n"))
    low, high = F.floor((F.col("_total") + 1) / 2), F.floor(F.col("_total") / 2) + 1
    middle = joined.filter(holds(low) | holds(high)).groupBy(*group).agg(((F.min("_value") + F.max("_value")) / 2).alias("_median"))
    wide = middle.groupBy(*(F.col(c).alias(f"_of{c}") for c in by)).agg(*(F.max(F.when(F.col("_name") == v, F.col("_median"))).alias(v) for v in values))
    if not by:
        return wide
    there = rows.select(*by).distinct()
    return there.join(wide, [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in by], "left").drop(*(f"_of{c}" for c in by))
