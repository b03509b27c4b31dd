"""Mixing sources to target weights by entropy balancing.

Targets: the sources in order of code points, null last, have the weights 5, 2, 1, 5, ... and share all words by
them; a target ends at ``MOST`` times its source's size, and what is above is shared anew by weight, until none is
above.  That is ``min(MOST * size, weight * level)``, and the level is found by a few sums over the sources.

Rates: of all rates between 0 and ``MOST`` with which a source's expected words come to its target, those of least
relative entropy to "each document once" are ``min(MOST, exp(tilt * size))`` with one tilt a source, the root of
the gradient of a convex dual.  Newton's method finds all tilts at once: each iteration is one aggregation, by
source, of gradient and curvature over the sizes that occur, kept within brackets that always hold the root.

Copies: sizes are gone through from the largest to the least, each rounded so that the words taken so far come
nearest to those expected so far; what a source of few documents is then off by is made up by exchanging single
copies of two sizes.  Which documents
of one size get the copy more is decided by a hash of ``doc_id``: the copies are dealt out over buckets of some
thousand documents in proportion, exactly, and in a bucket to the least hashes.  So a size that a third of
all documents have is in no one task.  All sums are of whole or decimal numbers: the order of rows changes nothing.

What goes from documents to the sums is one row a source and size: at most sqrt(2 w) sizes for w words, which
is also what the rounding of one source holds.

Defined results: a null text has size 0, and nothing is taken of it; null sources are one source, the last; rows
alike in ``doc_id`` (null included) and source and size are documents each, and which of them has the copy more is
not told apart; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import discard, materialize

WEIGHTS, MOST = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"
#: Documents of one size that are ranked together, about; alike rows that are put out at once; iterations and exchanges at most.
BUCKET, REPEAT, ROUNDS, SETTLE = 4096, 1 << 16, 200, 50
_WIDE = "decimal(38,0)"


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df``, whose rows differ in ``order``, with the place of each row in it, from 0: sorted by ranges, without a single task for all."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    parts = materialize(parts, "numbered")
    part = F.shiftright("__at", 33)
    sizes = {r["p"]: r["n"] for r in parts.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    starts, upto = [], 0
    for p in sorted(sizes):
        starts.append((p, upto))
        upto += sizes[p]
    starts = df.sparkSession.createDataFrame(starts, "__p long, __start long")
    return parts.join(F.broadcast(starts), part == F.col("__p")).withColumn(name, F.col("__at").bitwiseAND((1 << 33) - 1) + F.col("__start")).drop("__at", "__p", "__start")


def water_level(sources: DataFrame) -> Fraction:
    """What a weight of 1 gets, from ``(weight, words)`` of each source."""
    total, weights = sources.agg(F.sum("words"), F.sum("weight")).first()
    level = Fraction(total or 0, weights or 1)
    while True:
        full = F.expr(f"cast({MOST} * words as {_WIDE}) * {level.denominator} <= cast(weight as {_WIDE}) * {level.numerator}")
        row = sources.agg(F.sum(F.when(full, MOST * F.col("words")).otherwise(0)).alias("full"), F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("left")).first()
        if not row["left"]:
            return level
        after = Fraction(total - row["full"], row["left"])
        if after == level:
            return level
        level = after


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources(source, words)`` with ``place``, ``weight`` and ``target``."""
    placed = numbered(sources, "place", F.col("source").isNull(), F.col("source"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    placed = materialize(placed.withColumn("weight", weight), "sources")
    level = water_level(placed)
    share = F.element_at(F.create_map(*(F.lit(x) for w in sorted(set(weights)) for x in (w, float(w * level)))), F.col("weight"))
    return placed.withColumn("target", F.least(share, (MOST * F.col("words")).cast("double")))


def _rate(tilt: str) -> str:
    """Rounded, so that a last bit more or less is no other rate."""
    return f"round(least({MOST}d, exp(least({tilt} * size / mean, 2d))), 9)"


def tilts(classes: DataFrame, sources: DataFrame) -> DataFrame:
    """``(place, mean, tilt)`` of each source with words; ``classes(place, size, docs)`` with sizes above 0."""
    facts = classes.groupBy("place").agg((F.sum(F.col("size") * F.col("docs")) / F.sum("docs")).alias("mean"), F.min("size").alias("least"))
    state = sources.join(facts, "place").select("place", "mean", "words", "target", (F.col("target") / F.col("words")).alias("ratio"), (F.col("least") / F.col("mean")).alias("x"))
    # At these ends the words are at most, and at least, the target.
    low = F.when(F.col("ratio") < 1, F.log("ratio") / F.col("x")).otherwise(0.0)
    high = F.when(F.col("ratio") > 1, F.lit(math.log(MOST)) / F.col("x")).otherwise(0.0)
    full = F.col("target") >= MOST * F.col("words")
    # A little beyond the end where rates reach the bound, so that rounding cannot leave one below it.
    state = state.select("place", "mean", "target", F.when(full, high * (1 + 1e-9)).otherwise(0.0).alias("tilt"), low.alias("low"), high.alias("high"), F.lit(float("inf")).alias("gap"), full.alias("done"))
    state = materialize(state, "tilts")
    for _ in range(ROUNDS):
        if not state.filter("not done").limit(1).count():
            break
        rates = classes.join(state.filter("not done").drop("done"), "place").withColumn("r", F.expr(_rate("tilt")))
        words, inner = "cast(size * docs * r as decimal(38,6))", f"r < {MOST}"
        sums = rates.groupBy("place").agg(F.expr(f"cast(sum({words}) as double)").alias("words"), F.expr(f"cast(sum(if({inner}, cast(size * docs * r * size / mean as decimal(38,6)), 0)) as double)").alias("curve"))
        at = state.join(sums, "place", "left").withColumn("over", F.col("words") - F.col("target"))
        at = at.withColumn("low", F.expr("if(over < 0, tilt, low)")).withColumn("high", F.expr("if(over > 0, tilt, high)"))
        at = at.withColumn("newton", F.expr("if(curve > 0 and abs(over) <= gap / 2, tilt - over / curve, null)"))
        move = F.expr("case when newton > low and newton < high then newton else (low + high) / 2 end")
        ended = F.expr("abs(over) <= greatest(0.5d, 1e-9 * target) or high - low <= 1e-14 * greatest(abs(low), abs(high))")
        at = at.withColumn("end", F.coalesce(ended, F.lit(True)))
        after = materialize(at.select("place", "mean", "target", F.when(F.col("done") | F.col("end"), F.col("tilt")).otherwise(move).alias("tilt"), "low", "high", F.coalesce(F.abs("over"), "gap").alias("gap"), (F.col("done") | F.col("end")).alias("done")), "tilts")
        discard(state)
        state = after
    return state.select("place", "mean", "tilt")


def _settle(sizes: np.ndarray, copies: np.ndarray, most: np.ndarray, left: float) -> np.ndarray:
    """Brings the words that are ``left`` towards 0 by a copy more of one size, one less of another, or both, as often as that helps."""
    for _ in range(SETTLE):
        more, less = np.append(0, sizes[copies < most][::-1]), np.append(0, sizes[copies > 0][::-1])  # ascending, as ``sizes`` descends
        at = np.searchsorted(less, more - left)
        near = np.stack([less[np.clip(at - 1, 0, None)], less[np.clip(at, None, len(less) - 1)]])
        off = np.abs(left - (more - near))
        side, i = np.unravel_index(off.argmin(), off.shape)
        if off[side, i] >= abs(left):
            break
        up, down = more[i], near[side, i]
        copies = copies + ((sizes == up) & (up > 0)) - ((sizes == down) & (down > 0))
        left -= up - down
    return copies


def _round(frame: pd.DataFrame) -> pd.DataFrame:
    """Copies of each size of one source, from the largest size on."""
    frame = frame.sort_values("size", ascending=False)
    wanted, taken, out = 0.0, 0, []
    for size, docs, rate in zip(frame["size"].tolist(), frame["docs"].tolist(), frame["rate"].tolist()):
        wanted += size * docs * rate
        copies = min(max(math.floor((wanted - taken) / size + 0.5), 0), MOST * docs)
        taken += copies * size
        out.append(copies)
    copies = _settle(frame["size"].to_numpy(), np.array(out, np.int64), MOST * frame["docs"].to_numpy(), frame["target"].iloc[0] - taken)
    return frame.assign(copies=copies)[["place", "size", "docs", "copies"]]


def _alike(rows: DataFrame) -> DataFrame:
    """Each row as often as its ``times`` says, in pieces that fit into memory."""
    pieces = rows.withColumn("__piece", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(times - 1) div {REPEAT}"))))
    left = F.least(F.lit(REPEAT).cast("long"), F.col("times") - F.col("__piece") * REPEAT).cast("int")
    return pieces.withColumn("__one", F.explode(F.array_repeat(F.lit(1), left))).drop("__piece", "__one", "times")


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``(doc_id, source, size, source_size, target, rate, copies, taken)`` of every document."""
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    docs = documents.select("doc_id", F.col("source").cast("string").alias("source"), size.alias("size"))
    docs = materialize(docs.groupBy("doc_id", "source", "size").agg(F.count("*").alias("times")), "sized")
    classes = docs.groupBy("source", "size").agg(F.sum("times").alias("docs"))
    sources = classes.groupBy("source").agg(F.sum(F.col("size") * F.col("docs")).alias("words"))
    sources = materialize(with_targets(sources, weights), "targets")
    known = sources.select(F.col("source").alias("__source"), "place")
    by_source = lambda df: df.join(known, df["source"].eqNullSafe(known["__source"])).drop("__source", "source")
    classes = materialize(by_source(classes), "classes")
    filled = classes.filter("size > 0")
    rated = filled.join(tilts(filled, sources), "place").join(sources.select("place", "target"), "place")
    rated = rated.select("place", "target", "size", "docs", F.expr(_rate("tilt")).alias("rate"))
    rated = materialize(rated, "rates")
    copies = rated.groupBy("place").applyInPandas(_round, "place long, size long, docs long, copies long")
    copies = copies.join(rated.drop("docs", "target"), ["place", "size"])
    plan = classes.join(copies.drop("docs"), ["place", "size"], "left").na.fill(0, ["copies"])
    plan = materialize(plan.select("place", "size", "docs", "rate", F.expr("copies div docs").alias("least"), F.expr("copies % docs").alias("more")), "copies")
    # Buckets of documents of one size: how many of each get the copy more.
    buckets = max(1, (docs.agg(F.sum("times")).first()[0] or 0) // BUCKET)
    hashed = by_source(docs).withColumn("hash", F.xxhash64("doc_id")).withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    each = hashed.groupBy("place", "size", "bucket").agg(F.sum("times").alias("held"))
    upto = F.sum("held").over(W.partitionBy("place", "size").orderBy("bucket"))
    dealt = each.withColumn("upto", upto).join(plan, ["place", "size"])
    part = lambda n: f"cast(cast({n} as {_WIDE}) * more div docs as long)"
    dealt = dealt.select("place", "size", "bucket", "rate", "least", F.expr(f"{part('upto')} - {part('upto - held')}").alias("more"))
    ranked = hashed.join(dealt, ["place", "size", "bucket"])
    before = F.sum("times").over(W.partitionBy("place", "size", "bucket").orderBy("hash", "doc_id").rowsBetween(W.unboundedPreceding, -1))
    ranked = ranked.withColumn("more", F.greatest(F.lit(0).cast("long"), F.least("times", F.col("more") - F.coalesce(before, F.lit(0).cast("long")))))
    either = F.array(F.struct((F.col("least") + 1).alias("copies"), F.col("more").alias("times")), F.struct(F.col("least").alias("copies"), (F.col("times") - F.col("more")).alias("times")))
    rows = ranked.select("doc_id", "place", "size", "rate", F.explode(either).alias("x")).select("doc_id", "place", "size", "rate", "x.copies", "x.times").filter("times > 0")
    out = _alike(rows).join(sources, "place")
    return out.select("doc_id", "source", "size", F.col("words").alias("source_size"), "target", F.coalesce("rate", F.lit(0.0)).alias("rate"), "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")
