"""The pN_ queries over the campaign and document tables, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.llm import components, language, leakage, names, packing, pii, sentences, sketchjoin, urlcopies
from quernstone.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    pairs = names.spelling_pairs(table(spark, root, "campaigns", "organizer"), "organizer")
    return pairs.select(F.col("a").alias("organizer_a"), F.col("b").alias("organizer_b"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "campaigns", "ingest_seq", "title", "description")
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))
    pairs = sketchjoin.near_duplicate_pairs(rows, "ingest_seq", text, run=3, threshold=0.5, min_words=80)
    return pairs.select(F.col("a").alias("ingest_seq_a"), F.col("b").alias("ingest_seq_b"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "campaigns", "ingest_seq", "url")
    members = urlcopies.formatting_copies(rows, "ingest_seq", urlcopies.canonical_url(F.col("url")))
    return members.where("first <> id").select(F.col("first").alias("first_seq"), F.col("id").alias("copy_seq"))


def p4_pages(spark: SparkSession, root: str) -> DataFrame:
    return urlcopies.page_counts(table(spark, root, "campaigns", "ingest_seq", "url"), "ingest_seq", "url")


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "campaigns", "ingest_seq", "description")
    given = names.given_names(table(spark, root, "campaigns", "organizer"), "organizer")
    return pii.personal_items(rows, "description", "ingest_seq", given=given).select("ingest_seq", "pii_kind", "pii_text").distinct()


def p5_redacted(spark: SparkSession, root: str) -> DataFrame:
    given = names.given_names(table(spark, root, "campaigns", "organizer"), "organizer")
    return pii.redacted(table(spark, root, "campaigns", "ingest_seq", "description"), "description", "ingest_seq", given=given)


def _declared(spark: SparkSession, root: str) -> tuple[DataFrame, language.Model]:
    """Descriptions with the language that their platform declares, and the model for them."""
    platforms = table(spark, root, "platforms", "platform", "main_lang").groupBy("platform").agg(F.min("main_lang").alias("main_lang"))
    rows = table(spark, root, "campaigns", "ingest_seq", "platform", "description").where(F.trim("description") != "")
    declared = rows.join(platforms, "platform", "left")
    labelled = table(spark, root, "documents", "doc_id", "text", "lang").unionByName(declared.select(F.col("ingest_seq").alias("doc_id"), F.col("description").alias("text"), F.col("main_lang").alias("lang")))
    return declared, language.fitted_on(labelled, "doc_id", "text", "lang")


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    rows, model = _declared(spark, root)
    return language.misdeclared(rows, "description", F.col("main_lang"), model, "ingest_seq").select("ingest_seq", "seg_no", "lang")


def p6_passages(spark: SparkSession, root: str) -> DataFrame:
    rows, model = _declared(spark, root)
    return language.passages(rows, F.col("description"), model, "ingest_seq", "main_lang")


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    flags = table(spark, root, "detector_d_flags", "url", "cluster_id")
    ties = flags.select("url", components.whole_number(F.col("cluster_id")).alias("tie"))
    groups = components.connected_groups(ties, "url", "tie")
    return groups.where("group_size > 1").select(F.col("group").alias("group_url"), F.col("item").alias("url"))


def p8_pack(spark: SparkSession, root: str) -> DataFrame:
    sizes = packing.token_counts(table(spark, root, "documents", "doc_id", "text"), "doc_id", "text")
    return packing.pack(sizes, table(spark, root, "containers"))


def p9_found(spark: SparkSession, root: str) -> DataFrame:
    docs, items = table(spark, root, "documents", "doc_id", "text"), table(spark, root, "eval_items", "item_id", "text")
    return leakage.leaked_items(docs, "doc_id", "text", items, "item_id", "text").select("doc_id", "item_id")


def p9_clean(spark: SparkSession, root: str) -> DataFrame:
    docs, items = table(spark, root, "documents", "doc_id", "text"), table(spark, root, "eval_items", "item_id", "text")
    leaks = leakage.leaked_items(docs, "doc_id", "text", items, "item_id", "text")
    return leakage.without_leaks(table(spark, root, "documents", "doc_id", "source", "n_chars"), "doc_id", leaks)


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    found = sentences.sentences(table(spark, root, "documents", "doc_id", "text"), "doc_id", "text")
    return found.select(F.col("id").alias("doc_id"), "start_pos", "end_pos")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_pages": p4_pages,
    "p5_found": p5_found,
    "p5_redacted": p5_redacted,
    "p6_found": p6_found,
    "p6_passages": p6_passages,
    "p7_found": p7_found,
    "p8_pack": p8_pack,
    "p9_found": p9_found,
    "p9_clean": p9_clean,
    "p10_found": p10_found,
}

#: Ties between urls are spelled out as pairs and closed recursively, which only small groups allow.
_P7 = r"""
WITH RECURSIVE tied AS (
  SELECT DISTINCT url, CAST(try_cast(trim(cluster_id, E' \t\n\r') AS DOUBLE) AS HUGEINT) AS c
  FROM detector_d_flags
  WHERE url IS NOT NULL AND regexp_full_match(trim(cluster_id, E' \t\n\r'), '[+-]?[0-9]+(\.0*)?')
), near AS (
  SELECT DISTINCT a.url AS u, b.url AS v FROM tied a JOIN tied b USING (c)
), reach(u, v) AS (
  SELECT u, v FROM near UNION SELECT r.u, n.v FROM reach r JOIN near n ON r.v = n.u
), least AS (
  SELECT u, min(v) AS g, count(*) AS n FROM reach GROUP BY u
)
SELECT g AS group_url, u AS url FROM least WHERE n > 1
"""

#: The same page, by the same definition, in DuckDB's functions.
_PAGE = r"""
WITH cut AS (
  SELECT ingest_seq, url, regexp_replace(regexp_replace(url, '^[\s<>\[\](){}"''`]+|[\s<>\[\](){}"''`]+$', '', 'g'), '^([a-zA-Z][a-zA-Z0-9+.-]*:/+|/+)', '') AS x
  FROM campaigns WHERE ingest_seq IS NOT NULL AND url IS NOT NULL
), parts AS (
  SELECT ingest_seq, url,
    regexp_replace(regexp_replace(lower(regexp_extract(x, '^[^/?#]*', 0)), '^www\.', ''), '[.,;]*(:(80|443)?)?[.,;]*$', '') AS host,
    replace(regexp_extract(x, '^[^/?#]*([^?]*)', 1), '+', ' ') AS path,
    replace(regexp_extract(x, '\?(.*)$', 1), '+', ' ') AS query
  FROM cut
), canon AS (
  SELECT ingest_seq, url, host || '/' || trim(regexp_replace(lower(url_decode(path)), '[^\p{L}\p{M}\p{N}]+', ' ', 'g')) || '?' ||
    array_to_string(list_sort(list_filter(list_transform(regexp_split_to_array(query, '[&;?]'),
      lambda p: trim(regexp_replace(lower(url_decode(p)), '[^\p{L}\p{M}\p{N}]+', ' ', 'g'))), lambda p: p <> '')), '&') AS page
  FROM parts
), firsts AS (
  SELECT ingest_seq, url, min(ingest_seq) OVER (PARTITION BY page) AS first_seq, count(*) OVER (PARTITION BY page) AS n_copies FROM canon
)
"""

#: Every run of twelve words of a document that is one of an item.
_LEAKS = r"""
WITH runs_of_items AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 11], ' ') AS run
  FROM (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE item_id IS NOT NULL AND text IS NOT NULL) x, unnest(range(1, len(w) - 10)) AS t(i)
), runs_of_docs AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS run
  FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) x, unnest(range(1, len(w) - 10)) AS t(i)
), leaks AS (
  SELECT DISTINCT doc_id, item_id FROM runs_of_docs JOIN runs_of_items USING (run)
)
"""

#: Every pair that shares a run of three words, counted out.
_NEAR = r"""
WITH words AS (
  SELECT ingest_seq, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(description, '')), '[\p{L}\p{N}]+') AS w FROM campaigns WHERE ingest_seq IS NOT NULL
), runs AS (
  SELECT DISTINCT ingest_seq, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS run FROM (SELECT * FROM words WHERE len(w) >= 80) x, unnest(range(1, len(w) - 1)) AS t(i)
), sizes AS (
  SELECT ingest_seq, count(*) AS n FROM runs GROUP BY ingest_seq
), met AS (
  SELECT a.ingest_seq AS a, b.ingest_seq AS b, count(*) AS shared FROM runs a JOIN runs b ON a.run = b.run AND a.ingest_seq < b.ingest_seq GROUP BY a.ingest_seq, b.ingest_seq
)
SELECT a AS ingest_seq_a, b AS ingest_seq_b FROM met JOIN sizes x ON x.ingest_seq = a JOIN sizes y ON y.ingest_seq = b WHERE 2 * shared >= x.n + y.n - shared
"""

SQL: dict[str, str] = {
    "p2_found": _NEAR,
    "p4_found": _PAGE + "SELECT first_seq, ingest_seq AS copy_seq FROM firsts WHERE ingest_seq <> first_seq",
    "p4_pages": _PAGE + "SELECT first_seq, url, n_copies FROM firsts WHERE ingest_seq = first_seq",
    "p7_found": _P7,
    "p9_found": _LEAKS + "SELECT doc_id, item_id FROM leaks",
    "p9_clean": _LEAKS + "SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM leaks) OR doc_id IS NULL",
}
