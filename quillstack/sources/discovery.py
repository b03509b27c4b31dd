"""Finding mail containers and choosing a reader for each, without opening any."""

from __future__ import annotations

import glob
import os
import re
import shutil
from fnmatch import translate
from functools import reduce
from importlib import import_module
from types import ModuleType

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = (".pst", ".ost", ".msg")
GUIDANCE = "no reader is installed for this container: stores need libpff (pypff) or the readpst program, messages need extract-msg"


def optional_module(name: str) -> ModuleType | None:
    """A module that may be missing; None if it is, or fails to load."""
    try:
        return import_module(name)
    except Exception:
        return None


def _units(folder: str, recursive: bool) -> set[str]:
    """Containers of a folder.  A folder that holds ``.msg`` files is one unit by itself."""
    found: set[str] = set()
    for top, below, names in os.walk(folder):
        kinds = [os.path.splitext(n)[1].lower() for n in names]
        if ".msg" in kinds:
            found.add(top)
        found.update(os.path.join(top, n) for n, k in zip(names, kinds) if k in (".pst", ".ost"))
        if not recursive:
            below.clear()
    return found


def discover(paths: list[str], recursive: bool = False) -> list[str]:
    """Sorted absolute paths of the containers that files, folders and glob patterns name."""
    found: set[str] = set()
    for path in paths:
        for hit in glob.glob(path, recursive=recursive) if glob.has_magic(path) else [path]:
            if os.path.isdir(hit):
                found |= _units(hit, recursive)
            elif os.path.isfile(hit) and os.path.splitext(hit)[1].lower() in EXTENSIONS:
                found.add(hit)
    return sorted(os.path.abspath(x) for x in found)


def choose_reader(path: str, has=optional_module, which=shutil.which) -> str | None:
    """The first reader that is there: for stores libpff, then the readpst program; for messages extract-msg."""
    if os.path.splitext(path)[1].lower() in (".pst", ".ost"):
        return "libpff" if has("pypff") else "readpst" if which("readpst") else None
    return "extract_msg" if has("extract_msg") else None


def readers_here() -> dict[str, bool]:
    """Which readers this machine has."""
    return {"libpff": bool(optional_module("pypff")), "readpst": bool(shutil.which("readpst")), "extract_msg": bool(optional_module("extract_msg"))}


def reader_of(path: Column, there: dict[str, bool]) -> Column:
    """The same choice for a column of paths, where ``there`` says which readers there are; null for other files too."""
    kind = F.lower(F.regexp_extract(path, r"(\.[^./\\]*)$", 1))
    store = next((F.lit(r) for r in ("libpff", "readpst") if there.get(r)), F.lit(None).cast("string"))
    message = F.lit("extract_msg" if there.get("extract_msg") else None).cast("string")
    return F.when(kind.isin(".pst", ".ost"), store).when(kind == ".msg", message)


LISTED = "path string, modificationTime timestamp, length long, content binary"


def containers(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """``(path, size, mtime)`` of the same containers as ``discover``, on any file system.

    Spark's file source lists the folders, with tasks where there are many, and reads no file; what is a container
    follows from paths alone.  A folder of ``.msg`` files has the bytes of all that is below it, and the latest change.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    tops, alone = [], []
    for path in paths:  # as many as a user names
        base, deep, tail = path.partition("**")
        p = jvm.org.apache.hadoop.fs.Path(base.rstrip("/") or "/" if deep else path)
        fs = p.getFileSystem(conf)
        for f in fs.globStatus(p) or []:
            place = f.getPath().toString()
            (tops if f.isDirectory() else alone).append((place, recursive, tail.lstrip("/") if deep else None))
    found = []
    literal = lambda place: re.sub(r"([\[\]{}*?\\])", r"\\\1", place)
    read = lambda places: spark.read.format("binaryFile").schema(LISTED).option("recursiveFileLookup", "true").load(list(map(literal, places))).select("path", F.col("length").alias("size"), (F.unix_millis("modificationTime") / 1000).alias("mtime"))
    kind, parent = F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1)), F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    if alone:
        found.append(read([p for p, *_ in alone]).filter(kind.isin(*EXTENSIONS)))
    for top, deep, pattern in tops:
        files = read([top]).withColumn("kind", kind).withColumn("parent", parent)
        if pattern is not None:  # names below, at any depth
            found.append(files.filter(kind.isin(*EXTENSIONS) & F.regexp_extract("path", "([^/]*)$", 1).rlike(f"^{translate(pattern)}")).select("path", "size", "mtime"))
            continue
        here = F.lit(True) if deep else F.col("parent") == top.rstrip("/")
        found.append(files.filter(here & kind.isin(".pst", ".ost")).select("path", "size", "mtime"))
        units = files.filter(here & (kind == ".msg")).select(F.col("parent").alias("unit")).distinct()
        # Each file counts for every folder above it that is a unit.
        names = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(names) - 1), lambda n: F.array_join(F.slice(names, F.lit(1), n), "/"))
        inside = files.select(F.explode(above).alias("unit"), "size", "mtime").join(units, "unit")
        found.append(inside.groupBy(F.col("unit").alias("path")).agg(F.sum("size").alias("size"), F.max("mtime").alias("mtime")))
    if not found:
        return spark.createDataFrame([], "path string, size long, mtime double")
    every = reduce(DataFrame.unionByName, found).withColumn("path", F.regexp_replace("path", "^file:/+", "/"))
    return every.groupBy("path").agg(F.max("size").alias("size"), F.max("mtime").alias("mtime"))


def plan(spark: SparkSession, paths: list[str], recursive: bool = False) -> DataFrame:
    """``(path, size, mtime, reader)`` of the containers that ``paths`` name; the reader is null where none is installed."""
    here = readers_here()
    folder = F.lit("extract_msg" if here["extract_msg"] else None).cast("string")
    kind = F.lower(F.regexp_extract("path", r"(\.[^./\\]*)$", 1))
    return containers(spark, paths, recursive).withColumn("reader", F.when(kind.isin(*EXTENSIONS), reader_of(F.col("path"), here)).otherwise(folder))
