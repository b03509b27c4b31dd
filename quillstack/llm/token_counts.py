"""Token counts through a digest cache.

Every content is named by the SHA-256 of its normalised form.  Stored counts are joined by
``(content digest, tokenizer digest)``; only distinct contents without a stored count are encoded,
and what they give is appended to the cache.

The normal form turns null into the empty text and changes nothing else: the tokenizers covered
here tell apart texts that differ in any character, so any further folding would change counts.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows each keep their own
output row; an empty table gives an empty result; columns other than the two named ones are ignored;
a null id is carried along as it is.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import kept_path, materialize, path_exists

CACHE_SCHEMA = "digest string, tokenizer string, n_tokens long"
_RUNS = re.compile(" +[^ ]*")
_INNER_SPACE = re.compile("[^▁]▁")


def tokenizer_digest(model_path: str) -> str:
    """Names the model's bytes, the library's version and the encoding options."""
    with open(model_path, "rb") as f:
        model = hashlib.sha256(f.read()).hexdigest()
    return hashlib.sha256(f"{model}|sentencepiece {sentencepiece.__version__}|plain".encode()).hexdigest()


class _Counts(dict):
    """Tokens by chunk; a miss is encoded.  Long chunks are not kept, and a full table starts anew."""

    def __init__(self, model: sentencepiece.SentencePieceProcessor, entries: int):
        self.model, self.entries = model, entries

    def __missing__(self, chunk: str) -> int:
        # An empty chunk is a space that ends the text: the library leaves the bare space piece.
        n = len(self.model.encode(chunk, num_threads=1)) if chunk else 1
        if len(chunk) <= 64:
            if len(self) >= self.entries:
                self.clear()
            self[chunk] = n
        return n


@cache
def counter(model_path: str) -> TokenCounter:
    """One counter for each process; tasks that follow one another in a worker share it."""
    return TokenCounter(model_path)


class TokenCounter:
    """The library's token count of a text.

    Where the model's normaliser is the identity and no piece holds a space after another character,
    no merge crosses from a word into the next space; then the counts of the space-led chunks add up
    to the text's, and a table of chunks replaces most of the encoding.  Any other model encodes
    whole texts.
    """

    def __init__(self, model_path: str, entries: int = 200_000):
        from sentencepiece import sentencepiece_model_pb2

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        self.by_chunk = (
            norm.name == "identity"
            and not norm.precompiled_charsmap
            and norm.add_dummy_prefix
            and norm.escape_whitespaces
            and not norm.remove_extra_whitespaces
            and not any(_INNER_SPACE.search(p.piece) for p in proto.pieces)
            and any(p.piece == "▁" for p in proto.pieces)
        )
        self.counts = _Counts(self.model, entries)

    def count(self, text: str) -> int:
        if not text:
            return 0
        if not self.by_chunk:
            return len(self.model.encode(text, num_threads=1))
        text = text.replace("▁", " ")
        if "  " in text or text[0] == " ":
            chunks = [x[1:] for x in _RUNS.findall(f" {text}")]
        else:
            chunks = text.split(" ")
        return sum(map(self.counts.__getitem__, chunks))


def count_tokens(
    docs: DataFrame,
    model_path: str,
    cache_path: str,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``(id_col, n_bytes, n_tokens, over_limit)`` for every row of ``docs``; new counts go to ``cache_path``.

    Two writers that append the same content at once store the same count twice; readers group by
    digest, so that does no harm.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer_digest(model_path)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    content = docs.select(F.col(id_col), text.alias("__text")).withColumn("__digest", F.sha2("__text", 256))

    stored = spark.createDataFrame([], CACHE_SCHEMA)
    if path_exists(spark, cache_path):
        stored = spark.read.schema(CACHE_SCHEMA).parquet(cache_path)
        unknown = content.join(stored.filter(F.col("tokenizer") == tokenizer), F.col("__digest") == F.col("digest"), "left_anti")
    else:
        unknown = content
    misses = unknown.groupBy("__digest").agg(F.first("__text").alias("__text"))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(model_path).count
        for b in batches:
            digests, texts = b.columns
            n = [count(x.as_py()) for x in texts]
            yield pa.RecordBatch.from_arrays([digests, pa.array([tokenizer] * len(n), pa.string()), pa.array(n, pa.int64())], ["digest", "tokenizer", "n_tokens"])

    misses.mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    counts = (
        spark.read.schema(CACHE_SCHEMA).parquet(cache_path).filter(F.col("tokenizer") == tokenizer).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    )
    # Written first, so that the join has a shuffle on either side and a content with very many rows can be split.
    counts = materialize(counts, "token-counts-by-digest")
    rows = content.select(id_col, "__digest", F.octet_length("__text").cast("long").alias("n_bytes"))
    return rows.join(counts, F.col("__digest") == F.col("digest")).select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return count_tokens(docs, public_tokenizers.path("piece_bpe_32k.model"), kept_path(spark, "token-counts"))
