"""Registered queries of the mail engine and their SQL, over a ``mails`` view of the ``documents`` table.

The view is a fixed mapping that both engines can express.  It goes through the engine's own store: the
first query of a session over a folder upserts the view into a store in the shared folder, with its
exact folding, keys and index, and all queries read that.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import decode as D
from .functions import mime as M
from .functions import text as X
from .model import HIT_COLUMNS, MAILS_SCHEMA
from .operators import export, indexed, keys, rank, search, store
from .operators.normalize import normalize
from .plans.query_language import Term, parse
from .shared import shared_root
from .sources import discovery, mailbox

Query = Callable[[SparkSession, str], DataFrame]
NOW = datetime(2024, 2, 10, 12, tzinfo=timezone.utc)

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


# The view -----------------------------------------------------------------------------------------


def mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``mails`` view, without search columns."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    i, text = F.col("doc_id"), F.col("text")
    body = (
        F.when(i % 3 == 0, F.concat(text, F.lit("\n-----Original Message-----\nlicense "), text))
        .when(i % 3 == 1, F.concat(F.lit("> license quoted\n"), text))
        .otherwise(text)
    )
    date, name = F.lit(1704067200) + i * 3600, F.concat(F.lit("doc-"), i)
    return d.select(
        X.row_key(date, name).alias("rowid"),
        name.alias("message_id"),
        F.concat("source", F.lit(".pst")).alias("file_path"),
        F.concat("lang", F.lit("/"), "source").alias("folder_path"),
        F.concat("source", F.lit("@corp.example")).alias("from_addr"),
        F.concat(F.lit("team"), i % 7, F.lit("@corp.example")).alias("to_addr"),
        F.when(i % 5 == 0, F.concat(F.lit("cc"), i % 3, F.lit("@corp.example"))).otherwise("").alias("cc_addr"),
        date.alias("date_utc"),
        F.split_part(text, F.lit("\n"), F.lit(1)).alias("subject"),
        X.snippet(body).alias("snippet"),
        (i % 4 == 0).alias("has_attachment"),
        F.when(i % 4 == 0, F.array(F.concat(F.lit("file"), i, F.lit(".pdf")))).otherwise(F.array().cast("array<string>")).alias("attachment_names"),
        F.col("n_chars").alias("size_bytes"),
        body.alias("body"),
    )


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view as the rows that normalisation makes."""
    locator = F.to_json(F.struct(F.lit("eml").alias("reader"), F.col("message_id").alias("index")))
    more = {"raw_body_b64": F.lit(None).cast("string"), "decode_status": F.lit("ok"), "indexed_at": F.lit(0).cast("long"), "locator_json": locator}
    return mails(spark, sf_dir).withColumns(more).select(*MAILS_SCHEMA.fieldNames())


_stores: dict[tuple[str, str], store.MailStore] = {}


def _new_store(spark: SparkSession) -> store.MailStore:
    return store.MailStore(spark, f"{shared_root(spark)}/quillstack/mails-{uuid.uuid4().hex}")


def stored(spark: SparkSession, sf_dir: str) -> store.MailStore:
    """The session's store of the view; written once."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stores:
        made = _new_store(spark)
        made.upsert(records(spark, sf_dir))
        _stores[key] = made
    return _stores[key]


def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).mails()


_FOLD = "replace(lower({}), 'ß', 'ss')"
_KEEP = "array_to_string(list_filter(string_split(regexp_replace(body, '(?ims)^[ \\t]*-{{2,}}[ \\t]*(Original Message|원본 메시지)[ \\t]*-{{2,}}.*\\z', ''), chr(10)), lambda line: NOT regexp_matches(line, '^[ \\t]*[>|]')), chr(10))".replace("{{", "{").replace("}}", "}")
_KEY = "((date_utc << 20) | (CAST('0x' || substr(sha256(message_id), 1, 6) AS BIGINT) & 1048575))"

#: The view in SQL: ``m`` as above, ``s`` with the search columns.
VIEW = f"""
WITH v AS (
  SELECT 'doc-' || doc_id AS message_id, source || '.pst' AS file_path, lang || '/' || source AS folder_path, source || '@corp.example' AS from_addr,
         'team' || (doc_id % 7) || '@corp.example' AS to_addr, CASE WHEN doc_id % 5 = 0 THEN 'cc' || (doc_id % 3) || '@corp.example' ELSE '' END AS cc_addr,
         1704067200 + doc_id * 3600 AS date_utc, split_part(text, chr(10), 1) AS subject, doc_id % 4 = 0 AS has_attachment,
         CASE WHEN doc_id % 4 = 0 THEN 'file' || doc_id || '.pdf' ELSE '' END AS attachments, n_chars AS size_bytes,
         CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || '-----Original Message-----' || chr(10) || 'license ' || text
              WHEN doc_id % 3 = 1 THEN '> license quoted' || chr(10) || text ELSE text END AS body
  FROM documents),
m AS (SELECT *, {_KEY} AS rowid, substr(body, 1, 300) AS snippet FROM v),
f AS (SELECT *, {_FOLD.format("subject")} AS f_subject, {_FOLD.format(_KEEP)} AS f_body, {_FOLD.format("from_addr")} AS f_from, {_FOLD.format("to_addr")} AS f_to,
             {_FOLD.format("cc_addr")} AS f_cc, {_FOLD.format("attachments")} AS f_attachments FROM m),
s AS (SELECT *, f_subject || ' ' || chr(10) || ' ' || f_body || ' ' || chr(10) || ' ' || f_from || ' ' || chr(10) || ' ' || f_to || ' ' || chr(10) || ' ' || f_cc || ' ' || chr(10) || ' ' || f_attachments AS f_all FROM f)
"""
_HITS = "rowid, message_id, file_path, folder_path, from_addr, to_addr, date_utc, subject, snippet, has_attachment, attachments AS attachment_names"


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _hits(found: DataFrame, *more: str | Column) -> DataFrame:
    """Hits with the attachment list as text."""
    return found.select(*(X.attachment_text(F.col(c)).alias(c) if c == "attachment_names" else c for c in HIT_COLUMNS), *more)


# Filters: all messages of a query -----------------------------------------------------------------


def _register_search(name: str, raw: str, where: str, **options) -> None:
    whole = options.get("whole_word", False)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        index = stored(spark, sf_dir).snapshot() if options.get("indexed") else None
        return _hits(search.matches(prepared(spark, sf_dir), parse(raw, NOW), whole, options.get("below"), options.get("folders"), index))

    query(name, f"{VIEW} SELECT {_HITS} FROM s WHERE {where}")(run)


def _day(n: int) -> int:
    return 1704067200 + n * 86400


@query("search_indexed_rare", f"{VIEW} SELECT {_HITS} FROM s WHERE contains(f_attachments, 'file48') AND contains(f_from, 'src8')")
def _indexed_rare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Looked up however small the store is."""
    now, q = stored(spark, sf_dir).snapshot(), parse("filename:file48 from:src8", NOW)
    return _hits(indexed.narrowed(search.matches(now.mails(), q), now, q, worth=0))


for _name, _raw, _where, _options in [
    ("search_bare", "license", "contains(f_all, 'license')", {}),
    ("search_and", "license the", "contains(f_all, 'license') AND contains(f_all, 'the')", {}),
    ("search_and_keyword", "license AND tion", "contains(f_all, 'license') AND contains(f_all, 'tion')", {}),
    ("search_or_pair", "license OR ueci", "contains(f_all, 'license') OR contains(f_all, 'ueci')", {}),
    ("search_or_degraded", "license OR folder:en tion", "contains(f_all, 'license') AND contains(f_all, 'tion') AND contains(lower(folder_path), 'en')", {}),
    ("search_not", "the NOT license", "contains(f_all, 'the') AND NOT contains(f_all, 'license')", {}),
    ("search_minus", "the -tion", "contains(f_all, 'the') AND NOT contains(f_all, 'tion')", {}),
    ("search_minus_field", "license -from:src1", "contains(f_all, 'license') AND NOT contains(f_from, 'src1')", {}),
    ("search_phrase", '"of the"', "contains(f_all, 'of the')", {}),
    ("search_field_subject", "subject:the", "contains(f_subject, 'the')", {}),
    ("search_field_body", "body:license", "contains(f_body, 'license')", {}),
    ("search_field_from", "from:src1", "contains(f_from, 'src1')", {}),
    ("search_field_to", "받는사람:team3", "contains(f_to, 'team3')", {}),
    ("search_field_cc", "cc:cc2", "contains(f_cc, 'cc2')", {}),
    ("search_field_attachments", "filename:file12", "contains(f_attachments, 'file12')", {}),
    ("search_field_phrase", 'subject:"of the"', "contains(f_subject, 'of the')", {}),
    ("search_indexed", "license tion", "contains(f_all, 'license') AND contains(f_all, 'tion')", {"indexed": True}),
    ("search_indexed_field", "from:src1 body:license NOT error", "contains(f_from, 'src1') AND contains(f_body, 'license') AND NOT contains(f_all, 'error')", {"indexed": True}),
    ("search_unknown_prefix", "note:x", "contains(f_all, 'note:x')", {}),
    ("search_single_char", "q", "contains(f_all, 'q')", {}),
    ("search_non_indexable", "é", "contains(f_all, 'é')", {}),
    ("search_case_folded", "LICENSE THE", "contains(f_all, 'license') AND contains(f_all, 'the')", {}),
    ("search_whole_word", "con", "contains(f_all, 'con') AND regexp_matches(f_all, '(^|[^0-9a-z_])con($|[^0-9a-z_])')", {"whole_word": True}),
    ("filter_has_attachment", "has:attachment", "has_attachment", {}),
    ("filter_no_attachment", "hasattachment:no", "NOT has_attachment", {}),
    ("filter_folder_union", "folder:en/src1 folder:FR", "contains(lower(folder_path), 'en/src1') OR contains(lower(folder_path), 'fr')", {}),
    ("filter_folder_exact_set", "", "folder_path IN ('en/src1', 'de/src2')", {"folders": ["en/src1", "de/src2"]}),
    ("filter_file", "file:SRC3.pst", "contains(lower(file_path), 'src3.pst')", {}),
    ("filter_date_year", "date:2024", f"date_utc >= {_day(0)} AND date_utc < {_day(366)}", {}),
    ("filter_date_month", "date:2024-01", f"date_utc >= {_day(0)} AND date_utc < {_day(31)}", {}),
    ("filter_date_day", "received:2024-01-15", f"date_utc >= {_day(14)} AND date_utc < {_day(15)}", {}),
    ("filter_date_range", "date:2024-01-03..2024-01-10", f"date_utc >= {_day(2)} AND date_utc < {_day(10)}", {}),
    ("filter_date_relative", "newer_than:30d", f"date_utc >= {_day(10) + 43200}", {}),
    ("filter_date_named", "date:lastweek", f"date_utc >= {_day(28)} AND date_utc < {_day(35)}", {}),
    ("filter_before_after", "after:2024-01-05 before:2024-01-20", f"date_utc >= {_day(4)} AND date_utc < {_day(19)}", {}),
    ("filter_size_over", "messagesize:>2KB", "size_bytes > 2048", {}),
    ("filter_size_at_most", "크기:<=500B", "size_bytes <= 500", {}),
    ("filter_size_default", "messagesize:1.5KB", "size_bytes >= 1536", {}),
    ("filter_keyset", "", f"rowid < {_day(20) << 20}", {"below": _day(20) << 20}),
    (
        "search_combined",
        "the tion NOT license has:attachment after:2024-01-03 before:2024-02-05 folder:en OR folder:fr messagesize:>=300B",
        f"contains(f_all, 'the') AND contains(f_all, 'tion') AND NOT contains(f_all, 'license') AND has_attachment AND date_utc >= {_day(2)} AND date_utc < {_day(35)} AND (contains(lower(folder_path), 'en') OR contains(lower(folder_path), 'fr')) AND size_bytes >= 300",
        {},
    ),
]:
    _register_search(_name, _raw, _where, **_options)


# Top-k and ranking --------------------------------------------------------------------------------


def _page(spark: SparkSession, sf_dir: str, raw: str, **options) -> DataFrame:
    """A page of 20 as the command line has it."""
    now = stored(spark, sf_dir).snapshot()
    return _hits(search.search(now.mails(), raw, 20, now=NOW, index=now, **options).hits)


@query("search_topk_date", f"{VIEW} SELECT {_HITS} FROM s WHERE contains(f_all, 'the') ORDER BY rowid DESC, message_id LIMIT 20")
def _topk_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, "the")


@query("search_page_keyset", f"{VIEW} SELECT {_HITS} FROM s WHERE contains(f_all, 'the') AND rowid < {_day(25) << 20} ORDER BY rowid DESC, message_id LIMIT 20")
def _page_keyset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page(spark, sf_dir, "the", below=_day(25) << 20)


def _grams_sql(column: str) -> str:
    """Number of bigrams of a folded column."""
    return f"(length(regexp_replace({column}, '[^0-9a-z가-힣ㄱ-ㆎ]+', '', 'g')) - len(regexp_extract_all({column}, '[0-9a-z가-힣ㄱ-ㆎ]+')))"


_FIELDS = ["f_subject", "f_body", "f_from", "f_to", "f_cc", "f_attachments"]
_LENGTH = " + ".join(map(_grams_sql, _FIELDS))


def _tf_sql(gram: str, columns: list[str]) -> str:
    return "(" + " + ".join(f"(length({c}) - length(replace({c}, '{gram}', ''))) // 2" for c in columns) + ")"


def _bm25_sql(grams: list[tuple[str, list[str], str]]) -> str:
    """``t`` with the score of every message; grams come with their columns and the column that decides whether they are there."""
    distinct = list(dict.fromkeys((g, tuple(c), d) for g, c, d in grams))
    dfs = ", ".join(f"count(*) FILTER (contains({d}, '{g}')) AS df{i}" for i, (g, _, d) in enumerate(distinct))
    idf = lambda i: f"(CASE WHEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5)) ELSE 1e-6 END)"
    part = lambda i, g, c: f"{sum((x, tuple(y), z) == distinct[i] for x, y, z in grams)} * {idf(i)} * {_tf_sql(g, list(c))} * 2.2 / ({_tf_sql(g, list(c))} + 1.2 * (0.25 + 0.75 * n_grams / avgdl))"
    return f""", l AS (SELECT *, {_LENGTH} AS n_grams FROM s), c AS (SELECT count(*) AS n, avg(n_grams) AS avgdl, {dfs} FROM l),
t AS (SELECT l.*, -({" + ".join(part(i, g, c) for i, (g, c, _) in enumerate(distinct))}) AS score FROM l, c)"""


_ROUNDED = "CAST(round(score * 1e9) AS BIGINT) AS score9"


def _register_ranked(name: str, raw: str, grams: list[tuple[str, list[str], str]], where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        table, q = prepared(spark, sf_dir), parse(raw, NOW)
        stats = rank.stats_from_index(stored(spark, sf_dir).snapshot(), rank.query_grams(q))
        scored = search.matches(table, q).withColumn("score", rank.score(rank.query_grams(q), stats))
        return scored.select("message_id", F.round(F.col("score") * 1e9).cast("long").alias("score9"))

    query(name, f"{VIEW}{_bm25_sql(grams)} SELECT message_id, {_ROUNDED} FROM t WHERE {where}")(run)


_register_ranked("search_relevance_bm25", "con", [("co", _FIELDS, "f_all"), ("on", _FIELDS, "f_all")], "contains(f_all, 'con')")
_register_ranked("search_relevance_field", "subject:con", [("co", ["f_subject"], "f_subject"), ("on", ["f_subject"], "f_subject")], "contains(f_subject, 'con')")
_register_ranked("search_relevance_repeated", "con con", [("co", _FIELDS, "f_all"), ("on", _FIELDS, "f_all")] * 2, "contains(f_all, 'con')")


@query(
    "search_relevance_topk",
    f"{VIEW}{_bm25_sql([(g, _FIELDS, 'f_all') for g in ('li', 'ic', 'ce', 'en', 'ns', 'se')])}, k AS (SELECT message_id, rowid, {_ROUNDED}, row_number() OVER (ORDER BY round(score * 1e9), rowid DESC) AS place FROM t WHERE contains(f_all, 'license')) SELECT message_id, score9, place FROM k WHERE place <= 20",
)
def _relevance_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    now, q = stored(spark, sf_dir).snapshot(), parse("license", NOW)
    whole = search.matches(now.all_rows(), q)
    found = indexed.best(whole, now, q, 40, [F.asc("score"), *search.newest_first()], ["message_id", "rowid"])
    page = spark.createDataFrame(found.rows, "message_id string, rowid long, score double")
    page = page.withColumn("score9", F.round(F.col("score") * 1e9).cast("long"))
    order = W.orderBy("score9", F.desc("rowid"))  # a page of 40 rows
    return page.withColumn("place", F.row_number().over(order).cast("long")).filter("place <= 20").select("message_id", "score9", "place")


@query("bm25_stats", f"{VIEW}, l AS (SELECT *, {_LENGTH} AS n_grams FROM s) SELECT count(*) AS n, CAST(sum(n_grams) AS BIGINT) AS total, count(*) FILTER (contains(f_all, 'co')) AS df_co, count(*) FILTER (contains(f_subject, 'on')) AS df_subject_on FROM l")
def _bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = prepared(spark, sf_dir)
    stats = rank.stats_frame(table, [("co", None), ("on", "subject")])
    total = table.agg(F.sum("n_grams").alias("total"))
    return stats.crossJoin(F.broadcast(total)).select("n", "total", F.col("df0").alias("df_co"), F.col("df1").alias("df_subject_on"))  # one row by one row


def _all_grams_sql(fields: dict[str, str]) -> str:
    """``g`` with every gram occurrence of the named fields."""
    texts = " UNION ALL ".join(f"SELECT rowid, '{name}' AS field, {column} AS x FROM s" for name, column in fields.items())
    return f"g AS (SELECT rowid, field, substr(t, i, 2) AS gram FROM (SELECT rowid, field, t, unnest(range(1, length(t))) AS i FROM (SELECT rowid, field, unnest(string_split_regex(x, '[^0-9a-z가-힣ㄱ-ㆎ]+')) AS t FROM ({texts}))))"


_FIELD_NAMES = dict(zip(["subject", "body", "from", "to", "cc", "attachments"], _FIELDS))


@query("bigram_frequencies", f"{VIEW}, {_all_grams_sql({'body': 'f_body'})} SELECT gram, count(DISTINCT rowid) AS messages, count(*) AS occurrences FROM g GROUP BY gram")
def _bigram_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).snapshot().dictionary().filter("field = 'body'").select("gram", "messages", "occurrences")


@query("bigram_postings", f"{VIEW}, {_all_grams_sql(_FIELD_NAMES)} SELECT gram, field, rowid, count(*) AS tf FROM g GROUP BY gram, field, rowid")
def _bigram_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).postings().select("gram", "field", "rowid", "tf")


@query("index_candidates", f"{VIEW} SELECT rowid FROM s WHERE contains(f_all, 'co') AND contains(f_all, 'on') AND contains(f_body, 'nd') AND contains(f_subject, 'th')")
def _index_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed.candidates(stored(spark, sf_dir).snapshot(), [("co", None), ("on", None), ("nd", "body"), ("th", "subject")])


# Diagnosis and counts -----------------------------------------------------------------------------


@query(
    "diagnose_zero_hit",
    f"""{VIEW}, c AS (SELECT unnest(['license', 'nowhere-found', 'body:the', 'folder:xx', 'hasattachment:yes', 'date']) AS label,
  unnest([count(*) FILTER (contains(f_all, 'license')), count(*) FILTER (contains(f_all, 'nowhere-found')), count(*) FILTER (contains(f_body, 'the')),
          count(*) FILTER (contains(lower(folder_path), 'xx')), count(*) FILTER (has_attachment), count(*) FILTER (date_utc >= {_day(3)})]) AS n FROM s)
SELECT label, least(n, 1000) AS n, CASE WHEN n >= 1000 THEN '1000+건' ELSE n || '건' END AS count, n = 0 AS culprit FROM c""",
)
def _diagnose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.diagnosis_frame(prepared(spark, sf_dir), parse("license nowhere-found body:the folder:xx has:attachment after:2024-01-04", NOW))


@query("diagnose_capped_counts", f"{VIEW} SELECT least(count(*) FILTER (contains(f_all, 'the')), 100) AS the, least(count(*) FILTER (contains(f_all, 'license')), 100) AS license FROM s")
def _capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = prepared(spark, sf_dir)
    counts = {w: search.capped_count(search.matches(table, parse(w, NOW)), 100) for w in ("the", "license")}
    return spark.createDataFrame([tuple(counts.values())], ", ".join(f"{w} long" for w in counts))


@query("false_positive_rate", f"{VIEW} SELECT count(*) FILTER (contains(f_all, 'co') AND contains(f_all, 'on') AND contains(f_all, 'nd')) AS candidates, count(*) FILTER (contains(f_all, 'cond')) AS truth FROM s")
def _false_positives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.false_positives(prepared(spark, sf_dir), Term("cond"))


@query("whole_word_removed", f"{VIEW} SELECT count(*) AS matched, count(*) FILTER (NOT regexp_matches(f_all, '(^|[^0-9a-z_])con($|[^0-9a-z_])')) AS removed FROM s WHERE contains(f_all, 'con')")
def _whole_word_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.removed_by_whole_word(prepared(spark, sf_dir), parse("con", NOW))


# Lookups ------------------------------------------------------------------------------------------


@query("list_folders", f"{VIEW} SELECT DISTINCT folder_path FROM m WHERE folder_path <> ''")
def _folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.list_folders(prepared(spark, sf_dir))


@query("get_full", f"{VIEW} SELECT rowid, message_id, folder_path, from_addr, to_addr, cc_addr, date_utc, subject, body, size_bytes FROM m WHERE message_id = 'doc-42'")
def _get_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(spark, sf_dir).snapshot().get("doc-42").select("rowid", "message_id", "folder_path", "from_addr", "to_addr", "cc_addr", "date_utc", "subject", "body", "size_bytes")


@query("lookup_by_keys", f"{VIEW} SELECT message_id, rowid FROM m WHERE message_id IN (SELECT 'doc-' || doc_id FROM labels WHERE toxic = 1)")
def _by_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.read.parquet(f"{sf_dir}/labels.parquet").filter("toxic = 1").select(F.concat(F.lit("doc-"), "doc_id").alias("message_id"))
    return stored(spark, sf_dir).snapshot().lookup(keys).select("message_id", "rowid")


# Projections --------------------------------------------------------------------------------------


def _projection(name: str, sql: str, columns: Callable[[], list[Column]]) -> None:
    query(name, f"{VIEW} SELECT message_id, {sql} FROM s")(lambda spark, sf_dir: prepared(spark, sf_dir).select("message_id", *columns()))


_projection("strip_quoted_reply", "f_body AS body", lambda: [F.col("f_body").alias("body")])
_projection("row_key", "rowid", lambda: [F.col("rowid")])
_projection("snippet", "snippet", lambda: [F.col("snippet")])
_projection("searchable_text", "sha256(f_all) AS digest", lambda: [F.sha2("f_all", 256).alias("digest")])
_projection("attachment_join_split", "attachments AS joined, len(list_filter(string_split(attachments, '; '), lambda x: x <> '')) AS n", lambda: [X.attachment_text(F.col("attachment_names")).alias("joined"), F.size(X.split_attachments(X.attachment_text(F.col("attachment_names")))).cast("long").alias("n")])
_projection("message_id_hash", "substr(sha256(subject || '|' || strftime(make_timestamp(date_utc * 1000000), '%Y-%m-%dT%H:%M:%S+00:00') || '|' || from_addr), 1, 32) AS made", lambda: [X.message_id(F.lit(""), F.col("subject"), F.col("date_utc"), F.col("from_addr")).alias("made")])
_projection("message_id_header", "message_id || '@x' AS own", lambda: [X.message_id(F.concat(F.lit(" <"), "message_id", F.lit("@x> ")), F.col("subject"), F.col("date_utc"), F.col("from_addr")).alias("own")])
_projection("gram_count", f"CAST({_LENGTH} AS BIGINT) AS n_grams", lambda: [F.col("n_grams")])
_projection("highlight", "regexp_replace(subject, '(?i)(the|on)', '<em>\\1</em>', 'g') AS marked", lambda: [X.highlight(F.col("subject"), ["the", "on", "x"]).alias("marked")])
_projection("display_times", "strftime(make_timestamp(date_utc * 1000000), '%Y-%m-%d') AS day, strftime(make_timestamp(date_utc * 1000000), '%m-%d %H:%M') AS short, strftime(make_timestamp(date_utc * 1000000), '%Y-%m-%d %H:%M:%S') AS long", lambda: [X.day(F.col("date_utc")).alias("day"), X.short_time(F.col("date_utc")).alias("short"), X.full_time(F.col("date_utc")).alias("long")])
_projection("size_text", "CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' ELSE format('{:.1f} KB', size_bytes / 1024.0) END AS size", lambda: [X.size_text(F.col("size_bytes")).alias("size")])
_projection("raw_preview", "base64(encode(substr(subject, 1, 0) || message_id)) AS preview, strlen(message_id) > 5 AS cut", lambda: [D.preview(F.encode("message_id", "UTF-8")).alias("preview"), D.preview_cut(F.encode("message_id", "UTF-8"), 5).alias("cut")])


@query("locator_json", f"""{VIEW} SELECT message_id, '{{"reader":"eml","index":"' || message_id || '"}}' AS locator FROM m""")
def _locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared(spark, sf_dir).select("message_id", F.col("locator_json").alias("locator"))


@query(
    "search_page_more",
    f"{VIEW}, c AS (SELECT count(*) FILTER (contains(f_all, 'license')) AS license, count(*) FILTER (contains(f_all, 'the')) AS the, count(*) FILTER (contains(f_attachments, 'file48.pdf')) AS one FROM s) SELECT unnest(['license', 'the', 'filename:file48.pdf']) AS query, unnest([least(license, 20), least(the, 20), least(one, 20)]) AS shown, unnest([license > 20, the > 20, one > 20]) AS more FROM c",
)
def _page_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = stored(spark, sf_dir).snapshot()
    pages = {raw: search.search(now.mails(), raw, 20, now=NOW, index=now) for raw in ("license", "the", "filename:file48.pdf")}
    return spark.createDataFrame([(raw, p.hits.count(), p.more_available) for raw, p in pages.items()], "query string, shown long, more boolean")


@query("gram_prefix", f"{VIEW}, {_all_grams_sql(dict(zip(['subject', 'body', 'from', 'to', 'cc', 'attachments'], _FIELDS)))} SELECT gram, count(DISTINCT rowid) AS messages FROM g WHERE gram LIKE 'q%' GROUP BY gram")
def _gram_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dictionary by the beginning of a gram."""
    return stored(spark, sf_dir).snapshot().dictionary().filter(F.col("gram").startswith("q") & (F.col("field") == "")).select("gram", "messages")


@query("highlight_hits", f"{VIEW} SELECT message_id, sha256(regexp_replace(body, '(?i)(license|tion)', '<em>\\1</em>', 'g')) AS digest FROM s WHERE contains(f_all, 'license') AND contains(f_body, 'tion') AND contains(f_from, 'src')")
def _highlight_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, q = stored(spark, sf_dir).snapshot(), parse("license body:tion from:src", NOW)
    return search.highlighted(search.matches(now.mails(), q, index=now), q).select("message_id", F.sha2("highlighted", 256).alias("digest"))


@query("row_key_order", f"{VIEW} SELECT count(*) AS pairs, count(*) FILTER (rowid > before) AS rising FROM (SELECT rowid, lag(rowid) OVER (ORDER BY date_utc) AS before FROM m) WHERE before IS NOT NULL")
def _key_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Each message against the one an hour before it, by an equi-join instead of a global window.
    m = mails(spark, sf_dir).select("rowid", "date_utc")
    before = m.select(F.col("rowid").alias("before"), (F.col("date_utc") + 3600).alias("date_utc"))
    return m.join(before, "date_utc").agg(F.count("*").alias("pairs"), F.count_if(F.col("rowid") > F.col("before")).alias("rising"))


def _drafts(spark: SparkSession) -> keys.Write:
    return _new_store(spark)._drafts(f"{shared_root(spark)}/quillstack/keys-{uuid.uuid4().hex}")


@query(
    "key_collisions",
    """WITH k AS (SELECT doc_id // 4 * 3 + 5 AS base, 'doc-' || doc_id AS message_id FROM documents), n AS (SELECT *, row_number() OVER (ORDER BY base, message_id) AS n FROM k)
SELECT message_id, CAST(n + max(base - n) OVER (ORDER BY base, message_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS rowid FROM n""",
)
def _key_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("message_id"))
    return keys.allocate(d, F.floor(F.col("doc_id") / 4) * 3 + 5, _drafts(spark)).select("message_id", "rowid")


@query(
    "keys_beside_taken",
    """WITH RECURSIVE free AS (SELECT x, row_number() OVER (ORDER BY x) AS f FROM (SELECT unnest(range(0, (SELECT 8 * max(doc_id) + 20 FROM documents))) AS x) WHERE x % 5 NOT IN (1, 2)),
k AS (SELECT 'doc-' || doc_id AS message_id, doc_id // 4 * 3 AS base FROM documents), p AS (SELECT message_id, base, (SELECT min(f) FROM free WHERE x >= base) AS f FROM k),
n AS (SELECT *, row_number() OVER (ORDER BY base, message_id) AS n FROM p), s AS (SELECT message_id, n + max(f - n) OVER (ORDER BY base, message_id ROWS UNBOUNDED PRECEDING) AS f FROM n)
SELECT message_id, CAST(x AS BIGINT) AS rowid FROM s JOIN free USING (f)""",
)
def _keys_beside_taken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two keys of any five are taken."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.concat(F.lit("doc-"), "doc_id").alias("message_id"))
    every = d.select(F.explode(F.array(*(F.col("doc_id") * 2 * 5 + i for i in (1, 2, 6, 7)))).alias("rowid"))
    return keys.allocate(d, F.floor(F.col("doc_id") / 4) * 3, _drafts(spark), every).select("message_id", "rowid")


# Store --------------------------------------------------------------------------------------------


def _updates(table: DataFrame) -> DataFrame:
    """Changed copies of every third message twice, and as many new ones."""
    number = F.substring("message_id", 5, 20).cast("long")
    changed = table.filter(number % 3 == 0)
    twice = changed.withColumn("file_path", F.lit("a.pst")).withColumn("subject", F.lit("old")).unionByName(changed.withColumn("file_path", F.lit("b.pst")).withColumn("subject", F.lit("new")))
    return twice.unionByName(table.filter(number % 3 == 1).withColumn("message_id", F.concat("message_id", F.lit("-new"))))


_upserted: dict[tuple[str, str], tuple[store.MailStore, store.UpsertCounts]] = {}


def _after_upsert(spark: SparkSession, sf_dir: str) -> tuple[store.MailStore, store.UpsertCounts]:
    """A store of the view into which ``_updates`` were put; written once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _upserted:
        table, made = records(spark, sf_dir), _new_store(spark)
        made.upsert(table)
        _upserted[key] = made, made.upsert(_updates(table))
    return _upserted[key]


@query(
    "upsert_last_wins",
    f"{VIEW} SELECT message_id, CASE WHEN doc % 3 = 0 THEN 'new' ELSE subject END AS subject, CASE WHEN doc % 3 = 0 THEN 'b.pst' ELSE file_path END AS file_path FROM (SELECT *, CAST(substr(message_id, 5) AS BIGINT) AS doc FROM m) UNION ALL SELECT message_id || '-new', subject, file_path FROM m WHERE CAST(substr(message_id, 5) AS BIGINT) % 3 = 1",
)
def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _after_upsert(spark, sf_dir)[0].mails().select("message_id", "subject", "file_path")


@query("upsert_counts", "SELECT count(*) FILTER (doc_id % 3 = 1) AS inserted, count(*) FILTER (doc_id % 3 = 0) AS updated FROM documents")
def _upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _after_upsert(spark, sf_dir)[1]
    return spark.createDataFrame([(counts.inserted, counts.updated)], "inserted long, updated long")


@query("upserted_keys", "SELECT 0 AS equal_keys, CAST(count(*) AS BIGINT) + count(*) FILTER (doc_id % 3 = 1) AS messages FROM documents")
def _upserted_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _after_upsert(spark, sf_dir)[0].mails()
    return table.groupBy("rowid").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).cast("int").alias("equal_keys"), F.sum("n").alias("messages"))


def _containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.groupBy(F.concat("source", F.lit(".pst")).alias("path")).agg(F.sum("n_chars").alias("size"), F.count("*").cast("double").alias("mtime"), F.min("doc_id").alias("first"))


_CONTAINERS = "c AS (SELECT source || '.pst' AS path, CAST(sum(n_chars) AS BIGINT) AS size, CAST(count(*) AS DOUBLE) AS mtime, min(doc_id) AS first FROM documents GROUP BY source)"


@query("incremental_skip", f"WITH {_CONTAINERS} SELECT path, size FROM c WHERE NOT (first % 4 = 0 OR first % 4 = 1)")
def _incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a store's state log leaves to do: new, changed and failed containers."""
    plan, state = _containers(spark, sf_dir), _new_store(spark).state()
    for half in (0, 1):  # the second records replace the first
        for r in plan.toLocalIterator():
            status = ("WRITING", "FAILED" if r["first"] % 4 == 3 else "COMPLETED")[half]
            state.set(r["path"], status, r["size"] + (r["first"] % 4 == 2), r["mtime"] + 0.5)
        state.save()
    return store.pending(plan, state.frame()).select("path", "size")


@query("ingest_summary", f"WITH {_CONTAINERS} SELECT CASE WHEN first % 4 = 3 THEN 'FAILED' ELSE 'COMPLETED' END AS status, count(*) AS files, CAST(sum(mtime) AS BIGINT) AS mails FROM c GROUP BY 1")
def _summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = _new_store(spark).state()
    for r in _containers(spark, sf_dir).toLocalIterator():
        state.set(r["path"], "FAILED" if r["first"] % 4 == 3 else "COMPLETED", r["size"], r["mtime"], int(r["mtime"]))
    state.save()
    return store.summary(state.frame())


@query("recent_errors", "SELECT 'doc-' || doc_id AS file_path, n_chars AS ts FROM documents ORDER BY n_chars DESC, file_path, lang LIMIT 500")
def _recent_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written to a store's error log, in two batches, and read back."""
    d, log = spark.read.parquet(f"{sf_dir}/documents.parquet"), _new_store(spark)
    rows = d.select(F.concat(F.lit("doc-"), "doc_id").alias("file_path"), F.lit("").alias("folder_path"), F.lit("ValueError").alias("error_type"), F.col("lang").alias("error"), F.col("n_chars").alias("ts"))
    for half in (0, 1):
        log.log_errors(rows.filter(F.col("ts") % 2 == half))
    return log.recent_errors().select("file_path", "ts")


@query("export_rows", f"{VIEW} SELECT message_id, CAST(has_attachment AS INTEGER) AS has_attachment, attachments AS attachment_names, body FROM m")
def _export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.flat(prepared(spark, sf_dir), ["message_id", "has_attachment", "attachment_names", "body"])


@query("hit_csv_rows", f"{VIEW} SELECT strftime(make_timestamp(date_utc * 1000000), '%Y-%m-%d') AS date, from_addr, subject, folder_path, attachments AS attachment_names, message_id FROM s WHERE contains(f_all, 'license')")
def _hit_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.hit_rows(search.matches(prepared(spark, sf_dir), parse("license", NOW)))


@query("fold_exact", f"SELECT doc_id, sha256({_FOLD.format('text')}) AS digest FROM documents")
def _fold_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.sha2(X.fold("text"), 256).alias("digest"))


# Parsers: inputs made of the tables, in the encodings and layouts that containers have -----------------


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")


@query(
    "decode_chain",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ok' WHEN 1 THEN 'fallback' ELSE 'failed' END AS status,
  sha256(CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN '계약서 ' || doc_id WHEN 2 THEN 'ÿþAB' || chr(128) || chr(129) || doc_id ELSE '' END) AS digest FROM documents""",
)
def _decode_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UTF-8, CP949, bytes of no charset, and no bytes."""
    number, kind = F.encode(F.col("doc_id").cast("string"), "UTF-8"), F.col("doc_id") % 4
    raw = lambda text, charset: F.lit(text.encode(charset))
    body = F.when(kind == 0, F.encode("text", "UTF-8")).when(kind == 1, F.concat(raw("계약서 ", "cp949"), number)).when(kind == 2, F.concat(raw("ÿþAB\x80\x81", "latin-1"), number))
    return _documents(spark, sf_dir).withColumn("d", D.decode(body)).select("doc_id", "d.status", F.sha2("d.text", 256).alias("digest"))


@query("inflate_bodies", "SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END) AS digest FROM documents")
def _inflate_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed texts, damaged ones, and bytes that are none."""

    @F.pandas_udf("binary")
    def packed(text: pd.Series) -> pd.Series:
        return text.map(lambda t: zlib.compress(t.encode()))

    whole, kind = packed("text"), F.col("doc_id") % 3
    body = F.when(kind == 0, whole).when(kind == 1, F.substring(whole, F.lit(1), F.octet_length(whole) - 3)).otherwise(F.encode("text", "UTF-8"))
    return _documents(spark, sf_dir).withColumn("body", body).select("doc_id", F.sha2(D.inflate(F.col("body")), 256).alias("digest"))


@query(
    "address_lists",
    """SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Kim, Y <y' || doc_id || '@corp.kr>; ' || source || '@corp.com' WHEN 1 THEN 'a' || doc_id || '@x.org; B <' || source || '@x.org>'
  WHEN 2 THEN '김영수 <' || source || '@corp.co.kr>' ELSE '' END AS addresses FROM documents""",
)
def _address_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    listed = (
        F.when(i % 5 == 0, F.concat(F.lit('"Kim, Y" <y'), i, F.lit("@corp.kr>; "), "source", F.lit("@corp.com")))
        .when(i % 5 == 1, F.concat(F.lit("a"), i, F.lit("@x.org, B <"), "source", F.lit("@x.org>")))
        .when(i % 5 == 2, F.concat(F.lit("김영수 <"), "source", F.lit("@corp.co.kr>")))
        .when(i % 5 == 3, F.lit(""))
    )
    return _documents(spark, sf_dir).select("doc_id", X.addresses(listed).alias("addresses"))


@query(
    "header_blocks",
    """SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'number ' || doc_id || ' of ' || lang WHEN 1 THEN 'first ' || source END AS subject, CASE WHEN doc_id % 3 = 0 THEN source || '@x.org' END AS sender,
  CASE WHEN doc_id % 3 = 0 THEN 1704067200 + doc_id * 3600 ELSE 0 END AS seconds FROM documents""",
)
def _header_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folded subject and a date with its zone; repeated names, a line without a colon and no date; nothing."""
    i = F.col("doc_id")
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200 + 9 * 3600) + i * 3600), "EEE, dd MMM yyyy HH:mm:ss")
    block = F.when(i % 3 == 0, F.concat(F.lit("Subject: number "), i, F.lit("\r\n of "), "lang", F.lit("\r\nFrom: "), "source", F.lit("@x.org\r\nDate: "), stamp, F.lit(" +0900")))
    block = block.when(i % 3 == 1, F.concat(F.lit("SUBJECT: first "), "source", F.lit("\nsubject: second\nno colon here\nDate: yesterday")))
    read = _documents(spark, sf_dir).withColumn("h", M.headers(block))
    return read.select("doc_id", F.col("h")["subject"].alias("subject"), F.col("h")["from"].alias("sender"), M.header_epoch(F.col("h")["date"]).alias("seconds"))


def _parsed(rows: DataFrame, schema: str, of: Callable[[dict], tuple]) -> DataFrame:
    """Messages of ``rows(id, input)`` through the parser of message files."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for f in frames:
            yield pd.DataFrame([(i, *of(M.raw_record(bytes(x), "f", "d", ""))) for i, x in zip(f["id"], f["input"])], columns=names)

    return rows.mapInPandas(run, schema)


@query(
    "mime_parts",
    """SELECT page_id AS id, CASE WHEN page_id % 3 = 2 THEN 't' || page_id ELSE '계약서 ' || page_id END AS subject, CASE page_id % 3 WHEN 0 THEN 'plain ' || page_id WHEN 1 THEN 'line' || chr(13) || chr(10) || page_id ELSE '' END AS plain,
  CASE WHEN page_id % 3 <> 1 THEN sha256(html) END AS html, CASE WHEN page_id % 3 = 0 THEN 'a' || page_id || '.txt; b c.pdf' ELSE '' END AS attachments FROM pages""",
)
def _mime_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as mails: with parts and attachments, as plain text, and as HTML alone."""
    i, part = F.col("page_id"), "\n--=_B\nContent-Type: "
    subject = F.concat(F.lit("Subject: =?utf-8?b?"), F.base64(F.encode(F.concat(F.lit("계약서 "), i), "UTF-8")), F.lit("?=\n"))
    html = F.concat(F.lit("text/html\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.encode("html", "UTF-8")))
    parts = [subject, F.lit("MIME-Version: 1.0\nContent-Type: multipart/mixed; boundary=\"=_B\"\n"), F.lit(part + "text/plain; charset=utf-8\n\nplain "), i, F.lit(part), html]
    parts += [F.lit(part + "text/plain\nContent-Disposition: attachment; filename=a"), i, F.lit(".txt\nContent-Transfer-Encoding: base64\n\naGVsbG8="), F.lit(part + "application/pdf\nContent-Disposition: inline; filename=\"b c.pdf\"\n\nx\n--=_B--\n")]
    mail = F.when(i % 3 == 0, F.concat(*parts)).when(i % 3 == 1, F.concat(subject, F.lit("\nline\r\n"), i)).otherwise(F.concat(F.lit("Subject: t"), i, F.lit("\nContent-Type: "), html))
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet").select(i.alias("id"), F.encode(mail, "UTF-8").alias("input"))
    digest = lambda raw: None if raw is None else hashlib.sha256(raw).hexdigest()
    return _parsed(rows, "id long, subject string, plain string, html string, attachments string", lambda r: (r["headers"].get("subject"), r["body_bytes"].decode(), digest(r["html_bytes"]), "; ".join(r["attachment_names"])))


@query(
    "reader_choice",
    """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'libpff' WHEN 1 THEN 'libpff' WHEN 2 THEN 'extract_msg' END AS with_all, CASE WHEN doc_id % 4 < 2 THEN 'readpst' END AS with_readpst, CAST(NULL AS VARCHAR) AS with_none FROM documents""",
)
def _reader_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat("source", F.lit("/box"), "doc_id", F.element_at(F.array(*map(F.lit, (".PST", ".ost", ".msg", ".txt"))), (F.col("doc_id") % 4 + 1).cast("int")))
    with_ = lambda *there: discovery.reader_of(path, {x: x in there for x in ("libpff", "readpst", "extract_msg")})
    return _documents(spark, sf_dir).select("doc_id", with_("libpff", "readpst", "extract_msg").alias("with_all"), with_("readpst").alias("with_readpst"), with_().alias("with_none"))


@query("address_normalize", f"{VIEW} SELECT message_id, 'Team, A <' || to_addr || '>' || CASE WHEN cc_addr <> '' THEN '; ' || cc_addr ELSE '' END AS to_addr FROM m")
def _addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mails(spark, sf_dir).select("message_id", X.addresses(F.concat(F.lit('"Team, A" <'), "to_addr", F.lit(">; "), "cc_addr")).alias("to_addr"))


@query("rfc2822_date", "SELECT doc_id, 1704067200 + doc_id * 3600 AS date_utc FROM documents")
def _dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 3600), "EEE, dd MMM yyyy HH:mm:ss")
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", M.header_epoch(F.concat(stamp, F.lit(" +0000"))).alias("date_utc"))


@query("eml_export", f"{VIEW} SELECT message_id || '-' || rowid || '.eml' AS id, from_addr AS sender, to_addr AS receiver, date_utc AS seconds, sha256(rtrim(body, chr(10))) AS body FROM m")
def _eml(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = export.eml_rows(mails(spark, sf_dir)).select(F.col("name").alias("id"), F.col("content").alias("input"))
    back = _parsed(
        files,
        "id string, sender string, receiver string, seconds long, text string",
        lambda r: (r["headers"]["from"], r["headers"]["to"], M.epoch(None, r["headers"]["date"]), r["body_bytes"].decode().replace("\r\n", "\n")),
    )
    return back.select("id", "sender", "receiver", "seconds", F.sha2(F.rtrim("text", F.lit("\n")), 256).alias("body"))


@query("eml_files", f"{VIEW} SELECT message_id, from_addr, to_addr, cc_addr, date_utc, subject, sha256(rtrim(body, chr(10))) AS body FROM m")
def _eml_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages as files, read and normalised again."""
    folder = f"{shared_root(spark)}/quillstack/eml-{uuid.uuid4().hex}"
    export.write_eml(prepared(spark, sf_dir), folder)
    back = normalize(mailbox.read_eml(spark, folder), now=0)
    body = F.sha2(F.rtrim(F.replace("body", F.lit("\r\n"), F.lit("\n")), F.lit("\n")), 256)
    return back.select("message_id", "from_addr", "to_addr", "cc_addr", "date_utc", "subject", body.alias("body"))


@query("csv_export", f"{VIEW}, o AS (SELECT *, row_number() OVER (ORDER BY rowid DESC) AS place FROM m) SELECT message_id, CAST(has_attachment AS INTEGER) AS has_attachment, attachments AS attachment_names, sha256(body) AS body FROM o")
def _csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All messages, newest first, in one CSV file, read again."""
    path = f"{shared_root(spark)}/quillstack/export-{uuid.uuid4().hex}.csv"
    columns = ["message_id", "has_attachment", "attachment_names", "body"]
    export.write_csv_file(prepared(spark, sf_dir).orderBy(*search.newest_first()), path, columns)
    back = spark.read.options(header=True, multiLine=True, escape='"').csv(path)
    return back.select("message_id", F.col("has_attachment").cast("int"), F.coalesce("attachment_names", F.lit("")).alias("attachment_names"), F.sha2("body", 256).alias("body"))


@query("result_rows_json", f"{VIEW} SELECT message_id, subject, has_attachment FROM s WHERE contains(f_all, 'license')")
def _json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.hits(search.matches(prepared(spark, sf_dir), parse("license", NOW)))
    return export.json_rows(found).select(F.from_json("value", "message_id string, subject string, has_attachment boolean").alias("r")).select("r.*")
