"""Hard negatives by a block matrix product in two dimensions.

Rows are dealt out to blocks of about ``ROWS`` (anchors of about ``ANCHORS``), each of rows whose labels share a
hash, and blocks are cut into panels of ``WIDTH`` dimensions.  Every cell of the grid (anchor block, row block,
dimensions) gets its two panels by an equi-join and multiplies them to a partial tile of long scores.  The partial
tiles of a block pair are shuffled together and added, and each whole tile is reduced at once to what can still be
among the first: no more than a few rows an anchor leave it.  Tiles with equal label hashes come first and give each
anchor its positives; then the others (and those whose hash several labels share) give the negatives within the
score window of each positive.  So a pair of blocks is multiplied once, but for the few with mixed labels.

Blocks have the same size whatever label a row has: a label with a third of all rows is more blocks, no larger ones.
The grid grows with anchors times rows, as the scores do; that is the question that is asked.

Scores are inner products of ``floor(scale * x)``, exact.  Where a sum could leave 62 bits, panels hold all
dimensions, products are made of Python's integers, and scores beyond a long are held to its ends.

Defined results: rows with a null id or label, a null vector, or a null or non-finite component (before or after
scaling) take no part; of rows with one id the least by label, then vector, counts; a vector that is shorter than
another counts as filled up with zeros, an empty one as zeros; an anchor without positives has no rows; empty tables
give an empty result; other columns are ignored.  Labels are whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_batch_rows, discard, materialize
from .topk import _usable, inner

ROWS, ANCHORS, WIDTH, LABELS = 1024, 256, 32, 64
#: Tiles that go to Python at once: 2 MB each, at the sizes above.
TILES = 4
POSITIVES, NEGATIVES, SCALE, LEAST = 5, 5, 256.0, 80

_PANEL = "block long, chunk int, hash int, ids array<long>, labels array<long>, cells binary"
_TILE = "a long, r long, chunk int, a_ids array<long>, a_labels array<long>, r_ids array<long>, r_labels array<long>, w_anchor array<long>, w_positive array<long>, w_score array<long>, tile binary"


def _longs(column: pa.Array, i: int) -> np.ndarray | None:
    return column[i].values.to_numpy() if column[i].is_valid else None


def _panels(rows: DataFrame, scale: float, kind: str, width: int) -> DataFrame:
    """Panels of blocks: ``rows(block, hash, id, label, vector)``; ids and labels, by id, stand in the first panel of a block."""

    def emit(block: int, hashed: int, ids: list, labels: list, parts: list) -> Iterator[pa.RecordBatch]:
        length = max(1, *(len(p) for p in parts))
        whole = np.zeros((len(parts), length), kind)
        for row, p in zip(whole, parts):
            row[: len(p)] = p
        for c, at in enumerate(range(0, length, width)):
            own = [ids, labels] if not c else [None, None]
            cells = np.ascontiguousarray(whole[:, at : at + width]).tobytes()
            yield pa.RecordBatch.from_pylist([{"block": block, "chunk": c, "hash": hashed, "ids": own[0], "labels": own[1], "cells": cells}], schema)

    longs = pa.list_(pa.int64())
    schema = pa.schema([("block", pa.int64()), ("chunk", pa.int32()), ("hash", pa.int32()), ("ids", longs), ("labels", longs), ("cells", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, labels, parts = None, [], [], []
        for b in batches:
            vectors = b.column(4)
            for i, key in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                if key != at:
                    if ids:
                        yield from emit(*at, ids, labels, parts)
                    at, ids, labels, parts = key, [], [], []
                ids.append(b.column(2)[i].as_py())
                labels.append(b.column(3)[i].as_py())
                parts.append(np.floor(scale * vectors[i].values.to_numpy()))
        if ids:
            yield from emit(*at, ids, labels, parts)

    return rows.repartition("block").sortWithinPartitions("block", "id").select("block", "hash", "id", "label", "vector").mapInArrow(run, _PANEL)


def _product(cells: DataFrame, kind: str) -> DataFrame:
    """Partial tiles of pairs of panels."""
    longs = pa.list_(pa.int64())
    names = ["a", "r", "chunk", "a_ids", "a_labels", "r_ids", "r_labels", "w_anchor", "w_positive", "w_score", "tile"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, right, sizes = b.column(10), b.column(11), zip(b.column(12).to_pylist(), b.column(13).to_pylist())
            for i, (n, m) in enumerate(sizes):
                x = np.frombuffer(left[i].as_buffer(), kind).reshape(n, -1)
                y = np.frombuffer(right[i].as_buffer(), kind).reshape(m, -1)
                width = min(x.shape[1], y.shape[1])  # beyond the shorter, zeros
                tile = inner(x[:, :width].astype(float), y[:, :width].astype(float))
                row = b.slice(i, 1)
                columns = [row.column(k).cast(longs) if k in range(3, 10) else row.column(k) for k in range(10)]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([tile.tobytes()], pa.binary())], names)

    return cells.mapInArrow(run, _TILE)


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """``(first panels' row, whole tile)`` of each pair of blocks, from rows sorted by pair and chunk."""
    first, total = None, None
    for b in batches:
        for i in range(b.num_rows):
            tile = np.frombuffer(b.column(10)[i].as_buffer(), np.int64)
            if b.column(2)[i].as_py() == 0:
                if first is not None:
                    yield first, total
                first, total = b.slice(i, 1), tile.copy()
            else:
                total += tile
    if first is not None:
        yield first, total


def _ordered(row: pa.RecordBatch, tile: np.ndarray):
    """``(anchors, their labels, scores, ids and labels of the rows)``, each anchor's rows by score, then id."""
    anchors, a_labels, ids, labels = (_longs(row.column(k), 0) for k in range(3, 7))
    scores = tile.reshape(len(anchors), len(ids))
    order = np.argsort(~scores, axis=1, kind="stable")  # rows come by id
    return anchors, a_labels, np.take_along_axis(scores, order, 1), ids[order], labels[order]


def _batch(schema: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], [x.split()[0] for x in schema.split(", ")])


def _first_positives(tiles: DataFrame, k: int) -> DataFrame:
    schema = "a long, anchor_id long, positive_id long, positive_score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, tile in _tiles(batches):
            anchors, own, scores, ids, labels = _ordered(row, tile)
            fit = (labels == own[:, None]) & (ids != anchors[:, None])
            i, j = np.nonzero(fit & (fit.cumsum(axis=1) <= k))
            yield _batch(schema, np.full(len(i), row.column(0)[0].as_py()), anchors[i], ids[i, j], scores[i, j])

    return tiles.mapInArrow(run, schema)


def _first_negatives(tiles: DataFrame, k: int, least: int) -> DataFrame:
    schema = "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, tile in _tiles(batches):
            windows = [_longs(row.column(c), 0) for c in (7, 8, 9)]
            if windows[0] is None:
                continue
            anchors, own, scores, ids, labels = _ordered(row, tile)
            place = {int(x): i for i, x in enumerate(anchors)}
            found = []
            for anchor, positive, score in zip(*(w.tolist() for w in windows)):
                i = place[anchor]
                lowest = -((-least * score) // 100)  # Python's integers: 100 n >= least * score
                if lowest > score:
                    continue
                start, end = np.searchsorted(~scores[i], ~score, "left"), np.searchsorted(~scores[i], ~lowest, "right")
                at = start + np.flatnonzero(labels[i, start:end] != own[i])[:k]
                found += [(anchor, positive, n, score, s) for n, s in zip(ids[i, at].tolist(), scores[i, at].tolist())]
            if found:
                yield _batch(schema, *zip(*found))

    return tiles.mapInArrow(run, schema)


def mine(vectors: DataFrame, anchors: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, scale: float = SCALE, least: int = LEAST, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    ``anchors`` is a condition on the column ``id``.  An anchor's positives are its best ``positives`` other rows of its
    label; a positive's negatives the best ``negatives`` rows of other labels that score at most as it does, and at
    least ``least`` percent of that.
    """
    spark = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), vector.alias("vector"))
    rows = rows.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & _usable(F.col("vector"), scale))
    rows = rows.groupBy("id").agg(F.min(F.struct("label", "vector")).alias("x")).select("id", "x.label", "x.vector", anchors.alias("anchor"))
    rows = materialize(rows.withColumn("hash", F.pmod(F.xxhash64("label"), F.lit(LABELS)).cast("int")), "vectors")
    facts = rows.groupBy("hash").agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors"), (F.min("label") != F.max("label")).alias("mixed"), F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x * scale) + 1))).alias("most"), F.max(F.size("vector")).alias("length"))
    facts = facts.orderBy("hash").collect()  # LABELS rows at most
    most, length = max((f["most"] for f in facts), default=0.0), max((f["length"] for f in facts), default=0)
    exact = most * most * length < 1 << 62
    width = WIDTH if exact else max(length, 1)
    kind = next((k for k, bits in (("<i2", 15), ("<i4", 31)) if most < 1 << bits), "<f8")

    def blocks(count: str, size: int) -> dict[int, tuple[int, int]]:
        """First block and number of blocks of each hash."""
        out, start = {}, 0
        for f in facts:
            out[f["hash"]] = start, -(-f[count] // size)
            start += out[f["hash"]][1]
        return out

    row_blocks, anchor_blocks = blocks("n", ROWS), blocks("anchors", ANCHORS)
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not any(n for _, n in anchor_blocks.values()):
        return spark.createDataFrame([], schema)
    of = lambda table, k: F.element_at(F.create_map(*(F.lit(x) for h, v in table.items() for x in (h, v[k]))), F.col("hash"))
    block = lambda table: (of(table, 0) + F.pmod(F.xxhash64("id"), of(table, 1))).alias("block")
    columns = ["hash", "id", "label", "vector"]
    with arrow_batch_rows(spark, ROWS):
        r_panels = materialize(_panels(rows.select(block(row_blocks), *columns), scale, kind, width), "row-panels")
        a_panels = materialize(_panels(rows.filter("anchor").select(block(anchor_blocks), *columns), scale, kind, width), "anchor-panels")
    discard(rows)
    mixed = [f["hash"] for f in facts if f["mixed"]]
    all_rows, all_anchors = (sum(n for _, n in t.values()) for t in (row_blocks, anchor_blocks))

    def others(table: dict, every: int, same: bool) -> Column:
        """Numbers of the blocks that a panel meets: those of its hash, or the others too."""
        own = F.when(of(table, 1) > 0, F.sequence(of(table, 0).cast("long"), (of(table, 0) + of(table, 1) - 1).cast("long"))).otherwise(F.array().cast("array<long>"))
        if same:
            return own
        rest = F.filter(F.sequence(F.lit(0).cast("long"), F.lit(every - 1).cast("long")), lambda i: (i < of(table, 0)) | (i >= of(table, 0) + of(table, 1)))
        return F.when(F.col("hash").isin(mixed), F.concat(rest, own)).otherwise(rest) if mixed else rest

    def tiles(same: bool, windows: DataFrame | None) -> DataFrame:
        a = a_panels
        if windows is None:
            a = a.select("*", *(F.lit(None).cast("array<long>").alias(c) for c in ("w_anchor", "w_positive", "w_score")))
        else:
            a = a.join(windows, ["block", "chunk"], "left")
        a = a.withColumnRenamed("block", "a").withColumn("r", F.explode(others(row_blocks, all_rows, same))).drop("hash")
        r = r_panels.withColumnRenamed("block", "r").withColumn("a", F.explode(others(anchor_blocks, all_anchors, same))).drop("hash")
        sizes = lambda p, table: p.filter("chunk = 0").select(F.col("block"), F.size("ids").alias(table))
        a = a.join(sizes(a_panels, "a_n"), F.col("a") == F.col("block")).drop("block")
        r = r.join(sizes(r_panels, "r_n"), F.col("r") == F.col("block")).drop("block")
        left = a.select("a", "r", "chunk", F.col("ids").alias("a_ids"), F.col("labels").alias("a_labels"), "w_anchor", "w_positive", "w_score", F.col("cells").alias("a_cells"), "a_n")
        right = r.select("a", "r", "chunk", F.col("ids").alias("r_ids"), F.col("labels").alias("r_labels"), F.col("cells").alias("r_cells"), "r_n")
        cells = left.join(right, ["a", "r", "chunk"])
        names = ["a", "r", "chunk", "a_ids", "a_labels", "r_ids", "r_labels", "w_anchor", "w_positive", "w_score", "a_cells", "r_cells", "a_n", "r_n"]
        return _product(cells.select(*names), kind).repartition("a", "r").sortWithinPartitions("a", "r", "chunk")

    def best(rows: DataFrame, by: list[str], id_: str, score: str, k: int) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc(score), id_))).filter(F.col("rank") <= k)

    with arrow_batch_rows(spark, TILES):
        found = best(_first_positives(tiles(True, None), positives), ["anchor_id"], "positive_id", "positive_score", positives)
        found = materialize(found, "positives")
        pairs = found.groupBy("a").agg(F.collect_list(F.struct("anchor_id", "positive_id", "positive_score")).alias("w"))  # of one block of anchors
        pairs = pairs.select(F.col("a").alias("block"), F.lit(0).alias("chunk"), F.col("w.anchor_id").alias("w_anchor"), F.col("w.positive_id").alias("w_positive"), F.col("w.positive_score").alias("w_score"))
        result = best(_first_negatives(tiles(False, pairs), negatives, least), ["anchor_id", "positive_id"], "negative_id", "negative_score", negatives)
        result = materialize(result.select(*(x.split()[0] for x in schema.split(", "))), "negatives")
    for table in (r_panels, a_panels, found):
        discard(table)
    return result


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(vectors.withColumn("label", label), F.col("id") % 100 == 0)
