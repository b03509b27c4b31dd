"""URL filters: host and path rules first, then a character language-model ratio.

A rule decides for the URLs it fits.  Those URLs also teach two variable-order Markov models, one of
allowed and one of blocked URLs: a byte is predicted from the longest kept context of at most five
bytes, smoothed by Witten-Bell interpolation with all shorter ones, and a context is kept from
``min_context`` occurrences on.  Every other URL is allowed if the mean over its bytes of the
difference of log-likelihoods reaches a threshold.  It is calibrated on the URLs that the rules decide,
each scored by models that have seen no URL of its host: hosts fall into two halves by their hash, each
half is scored by models of the other one, and the threshold is where the sum of both error rates is
least.  The models that judge are built from both halves.

The models are built from the counts of all six-byte grams of URLs under a rule.  They are never in one
place: the grams of all URLs, also of those to be judged, are dealt out by their second and third last
bytes, so that all contexts of two bytes and more lie in one task, and shorter ones (65,536 two-byte
grams at most) are broadcast.  This gives a table of every gram with its differences of log-likelihoods,
and URLs pass through that table in broadcast blocks of about ``block_grams``, ``HELD`` blocks a pass.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
judged by the models (null as the empty text); an empty URL has ratio 0; without URLs of both kinds
to learn from, ratios are 0 and the threshold is 0, so what no rule blocks is allowed; where a half of
the hosts has one kind only, the threshold is set on the URLs that the models were built from; repeated rows
each keep a row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .charlm import HELD, Counter, SortedHashes, each, grouped, passes
from .common import blocks, discard, materialize, utf8_views
from .grams import LOWER, U

ORDER = 5  #: bytes of the longest context
LOW = 2  #: orders that are broadcast
#: Grams of a broadcast block, and of a task that builds models.
BLOCK_GRAMS, TASK_GRAMS = 1 << 19, 1 << 18
STEPS = 2000  #: of the score histogram that sets the threshold, from -10 to 10 nats
ALLOW, BLOCK = "allow", "block"
UPPER, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str


#: The rules of the registered query.
RULES = [
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, SMALL)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(rules: list[Rule], host: Column, path: Column) -> Column:
    """Struct ``(rule, verdict)`` of the longest fitting rule; null without one."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for r in sorted(rules, key=lambda r: len(r.host + r.path)):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        out = F.when(fits, F.struct(F.lit(r.host + r.path).alias("rule"), F.lit(r.verdict).alias("verdict"))).otherwise(out)
    return out


def byte_grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(grams, url of each)``: every byte, A-Z lower-cased, with the five before it; zeros before a URL's start."""
    offsets = offsets - offsets[0]
    wide = LOWER[raw].astype(U)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(raw)) - offsets[:-1][owner] if len(raw) else np.empty(0, np.int64)
    out = wide.copy()
    for back in range(1, ORDER + 1):
        earlier = np.zeros(len(wide), U)
        earlier[back:] = wide[: max(len(wide) - back, 0)]
        earlier[at < back] = 0
        out |= earlier << U(8 * back)
    return out, owner


class Markov:
    """A variable-order model; context and gram tables by order.

    With ``below``, the lowest orders are taken from there, and keys need to be whole for the others only.
    """

    def __init__(self, keys: np.ndarray, counts: np.ndarray, min_context: int, orders: int = ORDER + 1, below: Markov | None = None):
        self.contexts, self.grams = (list(below.contexts), list(below.grams)) if below else ([], [])
        keys, counts = keys[counts > 0], counts[counts > 0]
        for order in range(len(self.contexts), orders):
            k, n, _ = grouped(keys & U((1 << 8 * (order + 1)) - 1), counts)
            stem, total, kinds = grouped(k >> U(8), n)
            kept = total >= min_context
            table = SortedHashes(stem[kept])
            self.contexts.append((table, total[kept][table.order], kinds[kept][table.order]))
            k, n = k[np.isin(k >> U(8), stem[kept])], n[np.isin(k >> U(8), stem[kept])]
            table = SortedHashes(k)
            self.grams.append((table, n[table.order]))

    def log_likelihood(self, keys: np.ndarray) -> np.ndarray:
        p = np.full(len(keys), 1 / 256)
        for order in range(ORDER + 1):
            table, total, kinds = self.contexts[order]
            gram = keys & U((1 << 8 * (order + 1)) - 1)
            c, known = table.find(gram >> U(8))
            if known.any():
                table, n = self.grams[order]
                g, seen = table.find(gram)
                count = np.where(seen, n[g] if len(n) else 0.0, 0.0)
                p = np.where(known, (count + kinds[c] * p) / (total[c] + kinds[c]), p)
        return np.log(p)


class Ratio(NamedTuple):
    differences: DataFrame  #: ``(gram, whole, without0, without1, block)`` of every gram: by models of all URLs, and of one half of the hosts
    blocks: int
    threshold: float


MODELS = ("whole", "without0", "without1")


def _counts(rows: DataFrame) -> DataFrame:
    """``(gram, allow0, allow1, block0, block1)`` of every gram of ``rows(url, label)``; a null label counts as none of these."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter()
        for b in batches:
            raw, offsets = utf8_views(b.column(0))
            labels = np.array([v or "" for v in b.column(1).to_pylist()], object)
            for start, end in blocks(offsets):
                keys, owner = byte_grams(raw[offsets[start] : offsets[end]], offsets[start : end + 1])
                mine = labels[start:end][owner]
                for label in set(labels[start:end].tolist()):
                    counter.add(label, keys[mine == label])
        for label in counter.parts:
            keys, n = counter.total(label)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))], ["label", "gram", "n"])

    n = lambda label: F.sum(F.when(F.col("label") == label, F.col("n")).otherwise(0)).alias(label)
    return rows.select("url", "label").mapInArrow(count, "label string, gram long, n long").groupBy("gram").agg(*(n(f"{v}{half}") for v in (ALLOW, BLOCK) for half in "01"))


def _differences(counts: DataFrame, min_context: int) -> DataFrame:
    """``(gram, whole, without0, without1)``: log-likelihood if allowed less that if blocked, of every gram of ``counts``, by each model."""
    numbers = [c for c in counts.columns if c != "gram"]
    short = counts.groupBy(F.col("gram").bitwiseAND(F.lit((1 << 8 * LOW) - 1)).alias("gram")).agg(*(F.sum(c).alias(c) for c in numbers))

    def models(table: pa.Table, **more) -> list[tuple[Markov, Markov]]:
        keys, n = table["gram"].to_numpy().view(U), {c: table[c].to_numpy().astype(float) for c in numbers}
        below = more.pop("below", [(None, None)] * len(MODELS))
        halves = [("0", "1"), ("1",), ("0",)]  # of which each model is built
        return [tuple(Markov(keys, sum(n[f"{v}{h}"] for h in half), min_context, below=low, **more) for v, low in zip((ALLOW, BLOCK), lows)) for half, lows in zip(halves, below)]

    shared = counts.sparkSession.sparkContext.broadcast(models(short.toArrow(), orders=LOW))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            table = pa.Table.from_batches(parts)
            pairs = models(table, below=shared.value)
            for b in table.select(["gram"]).to_batches(1 << 16):
                keys = b.column(0).to_numpy().view(U)
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(allowed.log_likelihood(keys) - blocked.log_likelihood(keys)) for allowed, blocked in pairs)], ["gram", *MODELS])

    context = F.shiftright("gram", 8).bitwiseAND(F.lit((1 << 8 * LOW) - 1))
    schema = "gram long, " + ", ".join(f"{m} double" for m in MODELS)
    return counts.repartition(math.ceil(counts.count() / TASK_GRAMS) or 1, context).mapInArrow(run, schema)


def train(labelled: DataFrame, others: DataFrame | None = None, block_grams: int = BLOCK_GRAMS, min_context: int = 4) -> Ratio | None:
    """Models and threshold from all rows of ``labelled(url, verdict)``, for these and for ``others(url)``; None if one of the two kinds is missing."""
    half = F.pmod(F.xxhash64(host_and_path(F.col("url"))[0]), F.lit(2)).cast("int")
    rows = labelled.select("url", "verdict", half.alias("half"))
    kinds = {(r["verdict"], r["half"]) for r in rows.select("verdict", "half").distinct().collect()}  # four rows
    if {v for v, _ in kinds} != {ALLOW, BLOCK}:
        return None
    named = rows.select("url", F.concat("verdict", "half").alias("label"))
    if others is not None:
        named = named.unionByName(others.select("url", F.lit(None).cast("string").alias("label")))
    counts = materialize(_counts(named), "url-grams")
    parts = math.ceil(counts.count() / block_grams) or 1
    differences = _differences(counts, min_context).withColumn("block", F.pmod(F.xxhash64("gram"), F.lit(parts)))
    models = Ratio(materialize(differences, "url-differences"), parts, 0.0)
    discard(counts)
    apart = len(kinds) == 4
    step = F.least(F.greatest(F.floor((F.col("ratio") + 10) * (STEPS / 20)), F.lit(0)), F.lit(STEPS - 1)).cast("int")
    scored = _scored(rows, models, F.col("half") + 1 if apart else F.lit(0))
    hist = scored.groupBy(step.alias("step"), "verdict").agg(F.count("*").alias("n")).collect()  # 2 * STEPS rows at most
    by = {v: np.bincount([r["step"] for r in hist if r["verdict"] == v], [r["n"] for r in hist if r["verdict"] == v], STEPS) for v in (ALLOW, BLOCK)}
    missed = np.append(0, np.cumsum(by[ALLOW])) / max(by[ALLOW].sum(), 1)  # allowed URLs below each edge
    passed = 1 - np.append(0, np.cumsum(by[BLOCK])) / max(by[BLOCK].sum(), 1)
    error, edges = missed + passed, np.arange(STEPS + 1) * (20 / STEPS) - 10
    best = np.flatnonzero(error <= error.min() + 1e-12)
    return models._replace(threshold=float(edges[best].mean()))


def _pack(table: pa.Table) -> tuple[SortedHashes, np.ndarray]:
    hashes = SortedHashes(table["gram"].to_numpy().view(U))
    return hashes, np.stack([table[m].to_numpy()[hashes.order] for m in MODELS])


def _scored(df: DataFrame, models: Ratio, model: Column | None = None, held: int = HELD) -> DataFrame:
    """``df(url, ...)`` with ``ratio``, by the model of that number (0: of all URLs)."""
    chosen = (F.lit(0) if model is None else model).cast("int")
    df = df.withColumns({"__model": chosen, "ratio": F.lit(0.0)})
    at, schema = df.columns.index("url"), ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    for shared, last in passes(models.differences, models.blocks, _pack, held):

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                ratio, which = b.column(b.num_columns - 1).to_numpy().copy(), b.column(b.num_columns - 2).to_numpy()
                raw, offsets = utf8_views(b.column(at))
                for hashes, differ in each(shared):
                    for start, end in blocks(offsets, 1 << 18):
                        keys, owner = byte_grams(raw[offsets[start] : offsets[end]], offsets[start : end + 1])
                        where, there = hashes.find(keys)
                        if len(hashes.hashes):
                            found = np.where(there, differ[which[start:end][owner], where], 0.0)
                            ratio[start:end] += np.bincount(owner, found, end - start) / np.maximum(np.diff(offsets[start : end + 1]), 1)
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(ratio)], b.schema.names)

        df = df.mapInArrow(run, schema)
        if not last:
            df = materialize(df, "url-sums")
    return df.drop("__model")


def judge(pages: DataFrame, rules: list[Rule] = RULES, block_grams: int = BLOCK_GRAMS, min_context: int = 4, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(id, host, path, rule, verdict, ratio)`` for every row of ``pages``; ratio is null where a rule decides."""
    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    rows = pages.select(F.col(id_col).alias("id"), F.coalesce(url, F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", longest_rule(rules, F.col("host"), F.col("path"))).select("id", "url", "host", "path", "fit.rule", "fit.verdict")
    ruled, rest = rows.filter("rule is not null"), rows.filter("rule is null")
    models = train(ruled.select("url", "verdict"), rest.select("url"), block_grams, min_context)
    judged = rest.drop("verdict").withColumn("ratio", F.lit(0.0)) if models is None else _scored(rest.drop("verdict"), models)
    judged = judged.withColumn("verdict", F.when(F.col("ratio") >= (models.threshold if models else 0.0), ALLOW).otherwise(BLOCK))
    out = ruled.withColumn("ratio", F.lit(None).cast("double")).unionByName(judged)
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "ratio")


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
