"""MinHash near-duplicates by an inverted join over signature coordinates.

A document is the set of its five-word shingles.  Equal sets form a class at once, by digest; all
that follows works on classes, so copies never multiply.  A class is posted under each pair of
coordinate and value of its signature.  Classes that agree in at least ``matches`` of ``coordinates``
values share one among the ``coordinates - matches + 1`` rarest values of each, so only this prefix
is posted (values that occur once come first and post nothing); the rest of the lists is skipped and
the full count of collisions is taken from the two signatures.  With 48 coordinates and 28 matches a
pair at similarity 0.85 is missed with a probability below 1e-5.

Lists are merged in two steps.  First the members of each list are paired with two of them only, the
least by each of two hashes, and the links confirmed on full sets give components.  Then lists whose
members already lie in one component are done; in the others every pair across components is
counted, in blocks of members.  So a large group of near copies makes rows in proportion to its
members, and no pair of classes that could still join two components is left out.

Full sets are built again from the texts, for candidate classes only: their documents are picked out
by a bitmap of fixed size (``BITMAP_BITS``), which lets some others pass, and then joined by digest.

Defined results: a document without words, or null, has the empty set, is linked with nothing and
is kept; one with fewer than five words has its whole word sequence as its only shingle; rows with
equal ids and different texts are different members, and the component is named by the least id in
it; a null id is greater than any other; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_batch_rows, blocks, materialize, utf8_views
from .components import components
from .grams import NON_SPACE, U, mix, shingles, words

K, COORDINATES, MATCHES = 5, 48, 28
BITMAP_BITS = 24


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """``(hashes, bounds by document)``; a document's hashes are distinct and sorted."""
    w = words(raw, offsets, NON_SPACE)
    grams, at = shingles(w.hashes, w.doc, k)
    counts = np.diff(w.bounds)
    cuts = np.searchsorted(at, w.bounds)
    sets, docs = [], len(offsets) - 1
    short = {d: _whole(w.hashes[w.bounds[d] : w.bounds[d + 1]]) for d in np.flatnonzero((counts > 0) & (counts < k))}
    for d in range(docs):
        sets.append(short[d] if d in short else np.unique(grams[cuts[d] : cuts[d + 1]]))
    return (np.concatenate(sets) if sets else np.empty(0, U)), np.cumsum([0, *map(len, sets)])


def _whole(hashes: np.ndarray) -> np.ndarray:
    n = len(hashes)
    return shingles(hashes, np.zeros(n, np.int64), n)[0]


def _hash_family(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=U))
    return seeds[:n] | U(1), seeds[n:]


def signatures(sets: np.ndarray, bounds: np.ndarray, coordinates: int = COORDINATES) -> np.ndarray:
    """One row of 32-bit minima for each document; only rows of documents with shingles mean anything."""
    out = np.zeros((len(bounds) - 1, coordinates), np.int32)
    full = bounds[1:] > bounds[:-1]
    if full.any():
        multiply, add = _hash_family(coordinates)
        starts = bounds[:-1][full]
        for j in range(coordinates):
            h = sets * multiply[j]
            h += add[j]
            h ^= h >> U(32)
            h *= U(0x9FB21C651E98DF25)
            out[full, j] = np.minimum.reduceat((h >> U(32)).astype(np.uint32), starts).view(np.int32)
    return out


def _digests(sets: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    return [hashlib.sha256(sets[a:b].tobytes()).digest()[:16] if b > a else None for a, b in zip(bounds[:-1], bounds[1:])]


def _sketch(docs: DataFrame, coordinates: int) -> DataFrame:
    """``(id, cls, n, sig)`` of ``docs(id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = utf8_views(b.column(1))
            for start, end in blocks(offsets):
                sets, bounds = shingle_sets(raw[offsets[start] : offsets[end]], offsets[start : end + 1])
                sig = signatures(sets, bounds, coordinates)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, coordinates, dtype=np.int32)), pa.array(sig.ravel()))
                columns = [b.column(0)[start:end], pa.array(_digests(sets, bounds), pa.binary()), pa.array(np.diff(bounds)), lists]
                yield pa.RecordBatch.from_arrays(columns, ["id", "cls", "n", "sig"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, cls binary, n long, sig array<int>")


def _full_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``(cls, shingles)`` of ``classes(cls, rep)``, from the texts of ``docs(id, text)``."""
    bit = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << BITMAP_BITS))
    word = lambda b: F.shiftright(b, 5).cast("int")
    mask = lambda b: F.expr("shiftleft(1L, cast(b & 31 as int))")
    bitmap = classes.select(bit("rep").alias("b")).select(word(F.col("b")).alias("w"), mask("b").alias("m")).groupBy("w").agg(F.bit_or("m").alias("m"))
    marked = docs.withColumn("b", bit("id")).withColumn("w", word(F.col("b")))
    # At most 2 ** (BITMAP_BITS - 5) rows of two numbers.
    passed = marked.join(F.broadcast(bitmap), "w").filter((F.col("m").bitwiseAND(mask("b"))) != 0).select("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, offsets = utf8_views(b.column(0))
            for start, end in blocks(offsets):
                sets, bounds = shingle_sets(raw[offsets[start] : offsets[end]], offsets[start : end + 1])
                full = [sets[x:y].tobytes() for x, y in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([pa.array(_digests(sets, bounds), pa.binary()), pa.array(full, pa.binary())], ["cls", "shingles"])

    return passed.mapInArrow(run, "cls binary, shingles binary").join(classes.select("cls"), "cls", "left_semi").groupBy("cls").agg(F.first("shingles").alias("shingles"))


def _collisions(pairs: DataFrame, classes: DataFrame, matches: int, percent: int) -> DataFrame:
    """Pairs ``(a, b)`` whose sizes allow the similarity and whose signatures agree often enough."""
    left = classes.select(F.col("cls").alias("a"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    right = classes.select(F.col("cls").alias("b"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    both = pairs.join(left, "a").join(right, "b").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                sa, sb = (b.column(i).flatten().to_numpy().reshape(b.num_rows, -1) for i in (2, 3))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array((sa == sb).sum(axis=1) >= matches))

    return both.select("a", "b", "sa", "sb").mapInArrow(run, "a binary, b binary")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs that reach the similarity on their full sets."""
    left = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("xa"))
    right = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("xb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                at = np.minimum(np.searchsorted(q, p), len(q) - 1)
                common = int((q[at] == p).sum())
                good.append(100 * common >= percent * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "xa", "xb").mapInArrow(run, "a binary, b binary")


def _postings(classes: DataFrame, coordinates: int, matches: int) -> DataFrame:
    """``(cls, keys)``: the prefix of each class, its rarest values, but for those that occur once."""
    posted = classes.select("cls", F.posexplode("sig").alias("at", "value")).select("cls", (F.col("value").cast("long") * 64 + F.col("at")).alias("key"))
    often = posted.groupBy("key").agg(F.count("*").alias("posts")).filter("posts > 1")
    shared = posted.join(often, "key").groupBy("cls").agg(F.sort_array(F.collect_list(F.struct("posts", "key"))).alias("keys"))  # coordinates at most
    shared = shared.filter(F.size("keys") >= matches)
    return shared.select("cls", F.transform(F.slice("keys", F.lit(1), F.size("keys") - matches + 1), lambda k: k["key"]).alias("keys"))


class _Block:
    """Members of one block of a list, as arrays."""

    def __init__(self, members: pa.StructArray):
        field = {f.name: members.field(i) for i, f in enumerate(members.type)}
        self.cls, self.component = field["cls"].to_pylist(), field["component"].to_pylist()
        self.n = field["n"].to_numpy()
        self.sig = field["sig"].flatten().to_numpy().reshape(len(self.n), -1)
        self.keys = field["keys"].flatten().to_numpy()
        self.owner = np.repeat(np.arange(len(self.n)), field["keys"].value_lengths().to_numpy())
        self.sets = [np.frombuffer(x.as_buffer(), U) for x in field["shingles"]] if "shingles" in field else None


def _survivors(a: _Block, b: _Block, key: int, matches: int, percent: int) -> np.ndarray:
    """Which pairs of two blocks are still to be confirmed.

    They lie in different components, their sizes allow the similarity, their signatures agree often
    enough, and no list of a smaller key holds both: that list counts the pair.
    """
    names = {c: i for i, c in enumerate({*a.component, *b.component})}
    out = np.array([names[c] for c in a.component])[:, None] != np.array([names[c] for c in b.component])[None, :]
    if a is b:
        out &= np.tri(len(a.n), dtype=bool, k=-1).T
    out &= 100 * np.minimum(a.n[:, None], b.n[None, :]) >= percent * np.maximum(a.n[:, None], b.n[None, :])
    if out.any():
        agree = np.zeros(out.shape, np.uint8)
        for j in range(a.sig.shape[1]):
            agree += a.sig[:, j][:, None] == b.sig[:, j][None, :]
        out &= agree >= matches
    if out.any():
        smaller = np.unique(np.intersect1d(a.keys[a.keys < key], b.keys[b.keys < key]))
        if len(smaller):
            held = []
            for x in (a, b):
                at = np.minimum(np.searchsorted(smaller, x.keys), len(smaller) - 1)
                there = smaller[at] == x.keys
                m = np.zeros((len(x.n), len(smaller)), np.float32)
                m[x.owner[there], at[there]] = 1
                held.append(m)
            out &= held[0] @ held[1].T == 0
    return out


def _joining_links(a: _Block, b: _Block, pairs: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of the pairs that reach the similarity on full sets, enough to join all that they join."""
    shared = np.intersect1d(np.unique(np.concatenate(a.sets)), np.unique(np.concatenate(b.sets)), assume_unique=True)
    common = np.zeros(pairs.shape, np.float32)
    for lo in range(0, len(shared), 8192):
        part, sides = shared[lo : lo + 8192], []
        for x in (a, b):
            flat = np.concatenate(x.sets)
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            there = part[at] == flat
            m = np.zeros((len(x.sets), len(part)), np.float32)
            m[np.repeat(np.arange(len(x.sets)), x.n)[there], at[there]] = 1
            sides.append(m)
        common += sides[0] @ sides[1].T
    linked = pairs & (100 * common.astype(np.int64) >= percent * (a.n[:, None] + b.n[None, :] - common.astype(np.int64)))
    root: dict[bytes, bytes] = {}

    def find(x: bytes) -> bytes:
        while (up := root.get(x, x)) != x:
            root[x] = x = root.get(up, up)
        return x

    out = []
    for i, j in zip(*np.nonzero(linked)):
        x, y = find(a.component[i]), find(b.component[j])
        if x != y:
            root[y] = x
            out.append((i, j))
    return out


SHORT = 16  #: members of a list whose pairs are simply listed
MEMBERS = 512  #: of a block, about
BATCH = 4  #: pairs of blocks that are brought to Python at once


def _blocks_of(members: DataFrame, columns: list[str], left: DataFrame | None = None) -> DataFrame:
    """``(key, i, j, a, b)`` with the members of two blocks of a list; ``b`` is null where both are one.

    ``members`` has ``key``, ``block`` and ``blocks``; ``left`` names the ``(key, i, j)`` that are wanted, or else all are.
    """
    rows = members.groupBy("key", "block", "blocks").agg(F.collect_list(F.struct(*columns)).alias("a"))
    if left is None:
        rows = rows.select("key", F.col("block").alias("i"), "a", F.explode(F.sequence("block", F.col("blocks") - 1)).alias("j"))
    else:
        rows = rows.withColumnRenamed("block", "i").join(left, ["key", "i"]).select("key", "i", "a", "j")
    other = members.filter("blocks > 1").groupBy("key", F.col("block").alias("j")).agg(F.collect_list(F.struct(*columns)).alias("b"))
    alone = rows.filter("i = j").select("key", "i", "j", "a", F.lit(None).cast(other.schema["b"].dataType).alias("b"))
    return alone.unionByName(rows.filter("i <> j").join(other, ["key", "j"]))


def _across(open_lists: DataFrame, named: DataFrame, classes: DataFrame, prefixes: DataFrame, sets: DataFrame, tested: DataFrame, matches: int, percent: int) -> DataFrame:
    """Links between the components that meet in ``open_lists(key, posts)``.

    Pairs of short lists are listed.  Those of longer ones are counted block by block.  Where few survive they are confirmed one by one; where many do
    (a large group of texts that are near copies of some and not of others) the full sets are brought
    to the block, and only links that join components leave it.  A member goes to each of the other blocks
    of its list, so the rows that are made are members times blocks by two at most, and not pairs.
    """
    short = named.join(open_lists.filter(F.col("posts") <= SHORT).select("key"), "key")
    other = short.select("key", F.col("cls").alias("cls2"), F.col("component").alias("component2"))
    pairs = _pair("cls", "cls2", short.join(other, "key").filter("component < component2"))  # SHORT / 2 for a member at most
    long = open_lists.filter(F.col("posts") > SHORT)
    size = F.ceil(F.col("posts") / MEMBERS).cast("int")
    members = named.join(long.withColumn("blocks", size), "key").withColumn("block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    described = members.join(classes.select("cls", "n", "sig"), "cls").join(prefixes, "cls")
    described = materialize(described.select("key", "block", "blocks", "cls", "component", "n", "sig", "keys"), "open-members")
    columns = ["cls", "component", "n", "sig", "keys"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                key, i, j = (batch.column(c)[r].as_py() for c in range(3))
                a = _Block(batch.column(3)[r].values)
                b = _Block(batch.column(4)[r].values) if batch.column(4)[r].is_valid else a
                at = _survivors(a, b, key, matches, percent)
                if at.sum() > 2 * (len(a.n) + len(b.n)):
                    rows.append({"key": key, "i": i, "j": j})
                else:
                    rows += [{"a": a.cls[x], "b": b.cls[y]} for x, y in zip(*np.nonzero(at))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("a", pa.binary()), ("b", pa.binary()), ("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32())]))

    with arrow_batch_rows(open_lists.sparkSession, BATCH):
        counted = materialize(_blocks_of(described, columns).mapInArrow(count, "a binary, b binary, key long, i int, j int"), "open-pairs")
    few = _pair("a", "b", counted.filter("a is not null")).union(pairs).distinct().join(tested, ["a", "b"], "left_anti")
    few = _collisions(few, classes, matches, percent)
    crowded = counted.filter("a is null").select("key", "i", "j")
    wanted = crowded.select("key", F.explode(F.array("i", "j")).alias("block")).distinct()
    crowd = described.join(wanted, ["key", "block"], "left_semi").join(sets, "cls")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                a = _Block(batch.column(3)[r].values)
                b = _Block(batch.column(4)[r].values) if batch.column(4)[r].is_valid else a
                found = _joining_links(a, b, _survivors(a, b, batch.column(0)[r].as_py(), matches, percent), percent)
                yield pa.RecordBatch.from_arrays([pa.array([a.cls[x] for x, _ in found], pa.binary()), pa.array([b.cls[y] for _, y in found], pa.binary())], ["a", "b"])

    with arrow_batch_rows(open_lists.sparkSession, 1):  # with their full sets, blocks are large
        many = materialize(_blocks_of(crowd, [*columns, "shingles"], crowded).mapInArrow(link, "a binary, b binary"), "crowd-links")
    return _confirm(few, sets, percent).unionByName(many)


def merge_lists(prefixes: DataFrame, classes: DataFrame, sets: DataFrame, matches: int, percent: int) -> DataFrame:
    """``(node, component)`` of the classes that are linked.

    ``prefixes(cls, keys)`` says in which lists a class stands; pairs that share a list, agree in
    ``matches`` values of ``classes(cls, n, sig)`` and reach ``percent`` on ``sets(cls, shingles)`` are linked.
    """
    postings = prefixes.select("cls", F.explode("keys").alias("key"))
    order = [F.col("cls"), F.xxhash64("cls")]
    heads = postings.groupBy("key").agg(*(F.min_by("cls", o).alias(f"h{i}") for i, o in enumerate(order)), F.count("*").alias("posts")).filter("posts > 1")
    starred = postings.join(heads, "key").select("cls", F.explode(F.array(*(f"h{i}" for i in range(len(order))))).alias("head"))
    tested = materialize(_pair("cls", "head", starred).filter("a <> b").distinct(), "star-pairs")
    links = materialize(_confirm(_collisions(tested, classes, matches, percent), sets, percent), "links")
    found = materialize(components(links), "components")

    named = postings.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", F.coalesce("component", "cls").alias("component"))
    named = materialize(named, "labelled-postings")
    open_lists = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("posts")).filter("lo <> hi").select("key", "posts")
    more = materialize(_across(open_lists, named, classes, prefixes, sets, tested, matches, percent), "links")
    return components(found.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))


def near_duplicates(
    docs: DataFrame, percent: int = 85, coordinates: int = COORDINATES, matches: int = MATCHES, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n_shingles, component_id, kept)`` for every row of ``docs``."""
    if coordinates > 64:
        raise ValueError("at most 64 coordinates")
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = materialize(_sketch(docs, coordinates), "sketches")
    classes = materialize(rows.filter("cls is not null").groupBy("cls").agg(F.min("id").alias("rep"), F.first("n").alias("n"), F.first("sig").alias("sig")), "classes")
    prefixes = materialize(_postings(classes, coordinates, matches), "postings")
    sets = materialize(_full_sets(docs, classes.join(prefixes, "cls", "left_semi").select("cls", "rep")), "sets")

    joined = merge_lists(prefixes, classes, sets, matches, percent)
    named = classes.select("cls", "rep").join(joined.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "rep", F.coalesce("component", "cls").alias("component"))
    named = materialize(named, "named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("cls", "component_id")
    out = rows.select("id", "n", "cls").join(named, "cls", "left").withColumn("component_id", F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("component_id").eqNullSafe(F.col("id")).alias("kept"))


def _pair(a: str, b: str, df: DataFrame) -> DataFrame:
    return df.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
