"""From raw documents to token ids: five stages over the ``documents`` table.

1. language ID: documents that no language model explains go;
2. near-duplicates: of each group of near copies (similarity 0.8 or more) the document with the least id stays;
3. decontamination: documents that share ten words in a row with a benchmark item go;
4. secrets: what a rule finds is replaced in the text, and ``n_chars`` follows;
5. encoding: the four best segmentations, and the ids of the best.

Each stage takes all rows that its predecessor kept and, but for the last, returns the same columns.
A null text is no language's and goes in the first stage.  Rows equal in id and text are one document
from the second stage on.  An empty table passes through as an empty table.

The first three stages hand only texts to Python and get decisions back, by a digest of the text; the
documents themselves stay in Spark.  What goes is written as a table of digests and anti-joined: Spark
broadcasts that table if its size allows, and shuffles both sides otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.llm import decontaminate, langid, minhash_join, secrets, sentencepiece_nbest
from quillstack.llm.common import arrow_batch_rows, kept_path, materialize, quoted

#: Rows with their texts that go to Python at once.
BATCH_ROWS = 2000

#: Of near copies: the similarity in percent, and the collisions of 48 at which a pair at it is missed with a probability below 1e-5.
NEAR, NEAR_MATCHES = 80, 25


def _digest(docs: DataFrame) -> Column:
    """16 bytes of the text's SHA-256; null counts as empty."""
    return F.substring(F.unhex(F.sha2(F.coalesce(docs["text"], F.lit("")), 256)), 1, 16)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` but for those whose text is in ``gone(digest)``."""
    gone = materialize(gone.distinct(), "gone")
    return docs.join(gone, _digest(docs) == gone["digest"], "left_anti")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    with arrow_batch_rows(spark, BATCH_ROWS):
        judged = langid.identify(docs, _digest(docs).alias("digest"))
        return _without(docs, judged.filter("rejected").select("digest"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    member = F.struct(docs["doc_id"].isNull().alias("last"), docs["doc_id"], _digest(docs).alias("digest"))
    with arrow_batch_rows(spark, BATCH_ROWS):
        found = minhash_join.near_duplicates(docs.select(member.alias("member"), docs["text"]), NEAR, matches=NEAR_MATCHES, id_col="member")
        found = found.groupBy("member").agg(F.first("kept").alias("kept"), F.count("*").alias("copies")).filter("not kept or copies > 1")
        found = materialize(found.select("member.doc_id", "member.digest", "kept"), "decided")
    same = lambda other: docs["doc_id"].eqNullSafe(other["doc_id"]) & (_digest(docs) == other["digest"])
    # Rows equal in id and text are rare: only they are brought together.
    several = found.filter("kept")
    columns = [docs[quoted(c)] for c in docs.columns]
    several = docs.join(several, same(several)).select(several["doc_id"].alias("__id"), several["digest"].alias("__digest"), F.struct(*columns).alias("__doc"))
    one = several.groupBy("__id", "__digest").agg(F.first("__doc").alias("__doc")).select("__doc.*")
    # What goes grows with the input, so both sides are always shuffled: a hot key can be split, and plans are alike at every size.
    return docs.join(found.hint("merge"), same(found), "left_anti").unionByName(one)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    with arrow_batch_rows(spark, BATCH_ROWS):
        judged = decontaminate.decontaminate(docs.select(_digest(docs).alias("digest"), docs["text"]), items, id_col="digest")
        return _without(docs, judged.filter("contaminated").select("digest"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = secrets.redact_documents(docs, kept_path(spark, "secret-ledger"))
    n = F.coalesce(F.length(clean["text"]), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", n)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns but the text, then those of the encoding; of columns with one name the encoding's stay."""
    import public_tokenizers

    names = [c for c in docs.columns if c != "text" and c not in sentencepiece_nbest.COLUMNS]
    columns = [docs[quoted(c)].alias(f"__{i}") for i, c in enumerate(names)]  # for Python, names without dots
    model = public_tokenizers.path("piece_bpe_32k.model")
    encoded = sentencepiece_nbest.encode(docs, model, sentencepiece_nbest.N_BEST, *columns, with_ids=True, entries=50_000, forget=True)
    return encoded.toDF(*names, *sentencepiece_nbest.COLUMNS)


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scans),
    ("SentencePiece encoding and decoding", sentencepiece),
]

#: The first two stages and the last are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k + 1}")
    return docs
