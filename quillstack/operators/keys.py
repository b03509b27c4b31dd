"""Row keys: each message gets the first free key from its own on, however many share a second.

Keys are found as cars find places along a street.  In order of base key and id, the i-th message gets
``i + max over j <= i of (base_j - j)``.  The order is a sort by ranges; what one range hands to the next is
two numbers, its rows and its furthest place, so no task holds more than a range and no range fills up: what
does not fit goes on into the following one.  Keys that are taken are left out by counting free keys
instead of keys.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Writes a frame under a name and reads it back, so that later steps see the same partitions.
Write = Callable[[DataFrame, str], DataFrame]


def _part() -> Column:
    """The range of a row; the other bits of its number count within the range."""
    return F.shiftright("__at", 33)


def _local() -> Column:
    return F.col("__at").bitwiseAND((1 << 33) - 1)


def _ranges(rows: DataFrame, order: list[Column], write: Write, *facts: Column) -> tuple[DataFrame, list]:
    """``rows`` sorted by ranges, numbered within each, and ``facts`` of each range in order."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    parts = write(parts, "ranges")
    return parts, parts.groupBy(_part().alias("p")).agg(F.count("*").alias("n"), *facts).orderBy("p").collect()  # one row a range


def _carried(parts: DataFrame, carried: list[tuple[int, ...]], *names: str) -> DataFrame:
    small = parts.sparkSession.createDataFrame(carried, "__p long, " + ", ".join(f"{n} long" for n in names))
    return parts.join(F.broadcast(small), _part() == F.col("__p")).drop("__p")


def _so_far(what: Column) -> Column:
    return what.over(W.partitionBy(_part()).orderBy("__at"))


def running_sum(rows: DataFrame, value: Column, order: list[Column], name: str, write: Write) -> DataFrame:
    """``rows`` with the sum of ``value`` over all rows up to each, in the order given."""
    parts, facts = _ranges(rows.withColumn("__value", value.cast("long")), order, write, F.sum("__value").alias("sum"))
    before, carried = 0, []
    for f in facts:
        carried.append((f["p"], before))
        before += f["sum"]
    return _carried(parts, carried, "__before").withColumn(name, F.col("__before") + _so_far(F.sum("__value"))).drop("__at", "__value", "__before")


def parked(rows: DataFrame, base: Column, order: list[Column], write: Write) -> tuple[DataFrame, tuple[int, int] | None]:
    """``rows`` with a ``slot`` of their own each: ``base``, or the first that those before in ``order`` leave free; bases rise in that order.

    Also the least and the greatest slot, if there are rows.
    """
    parts, facts = _ranges(rows.withColumn("__base", base), order, write, F.max(F.col("__base") - _local()).alias("far"), F.min("__base").alias("least"))
    start, far, carried = 0, -(1 << 62), []
    for f in facts:
        carried.append((f["p"], start, far))
        far = max(far, f["far"] - start)
        start += f["n"]
    placed = _carried(parts, carried, "__start", "__far")
    furthest = F.greatest("__far", _so_far(F.max(F.col("__base") - _local())) - F.col("__start"))
    ends = (facts[0]["least"], far + start - 1) if facts else None
    return placed.withColumn("slot", furthest + F.col("__start") + _local()).drop("__at", "__base", "__start", "__far"), ends


def allocate(rows: DataFrame, base: Column, write: Write, taken: DataFrame | None = None) -> DataFrame:
    """``rows(message_id, ...)`` with a ``rowid`` each, no two alike and none among those of ``taken(rowid)``."""
    placed, ends = parked(rows, base, [base, F.col("message_id")], write)
    placed = write(placed.withColumnRenamed("slot", "rowid"), "keys")
    if taken is None or ends is None:
        return placed
    taken = taken.select("rowid").filter(F.col("rowid") >= ends[0])
    if not taken.filter(F.col("rowid") <= ends[1]).join(placed, "rowid", "left_semi").limit(1).count():
        return placed
    # Some are taken: the same among the free keys only, each of which is its number among them.
    street = rows.withColumn("__at_key", base).withColumn("__taken", F.lit(0)).unionByName(taken.select(F.col("rowid").alias("__at_key"), F.lit(1).alias("__taken")), allowMissingColumns=True)
    counted = running_sum(street, F.col("__taken"), [F.col("__at_key"), F.col("__taken"), F.col("message_id")], "__passed", write)
    fresh, _ = parked(counted.filter("__taken = 0"), F.col("__at_key") - F.col("__passed"), [F.col("__at_key"), F.col("message_id")], write)
    fresh = fresh.drop("__taken", "__at_key", "__passed")
    ends = counted.filter("__taken = 1").select((F.col("__at_key") - F.col("__passed") + 1).alias("slot"), F.lit(1).alias("__taken"))
    back = running_sum(fresh.withColumn("__taken", F.lit(0)).unionByName(ends, allowMissingColumns=True), F.col("__taken"), [F.col("slot"), F.desc("__taken"), F.col("message_id")], "__passed", write)
    return write(back.filter("__taken = 0").withColumn("rowid", F.col("slot") + F.col("__passed")).drop("slot", "__passed", "__taken"), "keys")
