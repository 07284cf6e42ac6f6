"""Queries over names, handles, urls and times as people write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import social as S
from quernstone.functions import vectorized as V
from quernstone.operators import fuzzy
from quernstone.operators import identity as I
from quernstone.plans import links
from quernstone.plans.base import HOST, Registry, sql_of
from quernstone.sources.tables import table

query = Registry()


@query()
def fuzzy_names(spark: SparkSession, root: str) -> DataFrame:
    """No SQL: DuckDB has no ratio by insertions and deletions; tested against brute force on a fixture."""
    return fuzzy.similar_names(table(spark, root, "campaigns", "organizer"), "organizer", 90.0).withColumn("ratio", F.round("ratio", 4))


@query()
def checksum_validators(spark: SparkSession, root: str) -> DataFrame:
    """Handles by the checksum they satisfy; tested on known addresses."""
    rows = table(spark, root, "contacts", "payment_handles").select(F.explode("payment_handles").alias("handle"))
    return rows.groupBy("handle").agg(F.count(F.lit(1)).alias("n_rows")).select("handle", V.checksum_kind("handle").alias("kind"), "n_rows")


@query(
    r"""
    SELECT trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(organizer)), '[^\x00-\x7F]', '', 'g'), '[^a-z0-9 ''-]', ' ', 'g'), '\s+', ' ', 'g')) AS folded, count(*) AS n_spellings
    FROM (SELECT DISTINCT organizer FROM campaigns WHERE organizer IS NOT NULL) GROUP BY 1
    """
)
def names_folded(spark: SparkSession, root: str) -> DataFrame:
    names = table(spark, root, "campaigns", "organizer").where("organizer IS NOT NULL").distinct()
    return names.select(V.ascii_folded("organizer").alias("folded")).groupBy("folded").agg(F.count(F.lit(1)).alias("n_spellings"))


@query(
    r"""
    SELECT ingest_seq, CAST(epoch(coalesce(CASE WHEN regexp_matches(trim(created_date), '^\d{4}-\d{2}-\d{2}') THEN try_cast(regexp_replace(trim(created_date), 'Z$', '+00:00') AS TIMESTAMPTZ)::TIMESTAMP END,
      try_strptime(trim(created_date), '%d/%m/%Y'), try_strptime(trim(created_date), '%m/%d/%Y'))) AS BIGINT) AS created FROM campaigns
    """
)
def dates_parsed(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "campaigns", "ingest_seq", "created_date").select("ingest_seq", F.unix_timestamp(S.parsed_time(F.col("created_date"))).alias("created"))


_HINTS = " ".join(f"WHEN regexp_matches(n, '{p}') THEN '{k}'" for k, p in S.ORGANIZATION_HINTS)


@query(f"SELECT CASE {_HINTS} END AS hint, count(*) AS n_names FROM (SELECT DISTINCT lower(organizer) AS n FROM campaigns WHERE organizer IS NOT NULL) GROUP BY 1")
def organization_hints(spark: SparkSession, root: str) -> DataFrame:
    names = table(spark, root, "campaigns", "organizer").where("organizer IS NOT NULL").select(F.lower("organizer").alias("n")).distinct()
    return names.groupBy(S.organization_hint(F.col("n")).alias("hint")).agg(F.count(F.lit(1)).alias("n_names"))


@query(
    f"""
    WITH u AS (SELECT url FROM campaigns UNION ALL SELECT unnest(urls) FROM contacts), h AS (SELECT url, {sql_of(HOST, "url")} AS host FROM u)
    SELECT CASE WHEN host = '' THEN NULL WHEN host IN (SELECT host FROM platforms) THEN 'own' WHEN regexp_matches(url, '{S.DOCUMENT}') THEN 'document'
      WHEN regexp_matches(url, '^(?i)(?:https?://)?(?:www\\.)?(?:youtube\\.com|youtu\\.be|vimeo\\.com)/') THEN 'video'
      WHEN split_part(host, '.', 1) IN ({", ".join(repr(k) for k in S.PLATFORM_BY_LABEL)}) THEN 'social' ELSE 'external' END AS kind, count(*) AS n_rows
    FROM h GROUP BY 1
    """
)
def url_kinds(spark: SparkSession, root: str) -> DataFrame:
    # One row per platform, whose number is fixed.
    own = [r.host for r in table(spark, root, "platforms", "host").where("host IS NOT NULL").collect()]
    urls = table(spark, root, "campaigns", "url").unionByName(table(spark, root, "contacts", "urls").select(F.explode("urls").alias("url")))
    return urls.groupBy(S.url_kind(F.col("url"), own).alias("kind")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    r"""
    WITH p AS (SELECT unnest(phones) AS p FROM contacts), d AS (SELECT p, trim(p) AS t, regexp_replace(p, '[^0-9]', '', 'g') AS d FROM p WHERE p IS NOT NULL),
    f AS (SELECT p, CASE WHEN starts_with(t, '+') THEN d WHEN starts_with(d, '00') THEN substr(d, 3, 30) ELSE '1' || regexp_replace(d, '^0+', '') END AS full_number FROM d)
    SELECT p AS phone, CASE WHEN length(full_number) BETWEEN 8 AND 15 THEN '+' || full_number END AS e164, count(*) AS n_rows FROM f GROUP BY ALL
    """
)
def phones_international(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "contacts", "phones").select(F.explode("phones").alias("phone")).where("phone IS NOT NULL").groupBy("phone").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.select("phone", S.international(F.col("phone"), F.lit("1")).alias("e164"), "n_rows")


@query()
def nearest_cues(spark: SparkSession, root: str) -> DataFrame:
    """Which word stands closest to every number of four or more digits; tested against brute force on a fixture."""
    rows = table(spark, root, "campaigns", "ingest_seq", "description")
    return fuzzy.nearest_word(rows, "ingest_seq", F.col("description"), r"\d{4,}", {"call": r"(?i)call|tel|ring", "write": r"(?i)write|letters", "number": r"(?i)number|passport"}, 60)


_REPLAY = f"""
  {links._TIES}, {links._BUCKETS.strip()}, owners AS (SELECT url, min(organizer) AS organizer FROM campaigns GROUP BY url),
  coherent AS (SELECT signal, value FROM capped LEFT JOIN owners ON item = url GROUP BY signal, value HAVING signal <> 'domain' OR count(DISTINCT organizer) <= 2),
  kept AS (SELECT c.* FROM capped c JOIN coherent USING (signal, value)),
  inside AS (
    SELECT DISTINCT t.cluster || '|' || a.item AS a, u.cluster || '|' || b.item AS b FROM kept a JOIN kept b ON a.signal = b.signal AND a.value = b.value AND a.item <> b.item
    JOIN ties t ON t.url = a.item JOIN ties u ON u.url = b.item AND t.cluster = u.cluster
  ), reach(a, b) AS (SELECT a, a FROM inside UNION SELECT r.a, n.b FROM reach r JOIN inside n ON r.b = n.a)
"""


@query(f"WITH RECURSIVE {_REPLAY} SELECT a AS node, min(b) AS component FROM reach GROUP BY a")
def gate_replay(spark: SparkSession, root: str) -> DataFrame:
    """Clusters taken apart again: members stay together only through values that few owners share."""
    capped = I.capped(links._buckets(spark, root))
    owners = table(spark, root, "campaigns", "url", "organizer").groupBy("url").agg(F.min("organizer").alias("organizer"))
    spread = capped.join(owners, F.col("item") == F.col("url"), "left").groupBy("signal", "value").agg(F.countDistinct("organizer").alias("n_owners"))
    kept = capped.join(spread.where("signal <> 'domain' OR n_owners <= 2").select("signal", "value"), ["signal", "value"], "left_semi")
    ties = links._clusters(spark, root)
    placed = kept.join(ties, F.col("item") == F.col("url")).select("signal", F.concat_ws("|", "cluster", "value").alias("value"), F.concat_ws("|", "cluster", "item").alias("item"))
    return I.components(I.pair_edges(placed).select("src", "dst"))


@query(
    r"""
    WITH t AS (SELECT DISTINCT regexp_extract(url, '^[^?#]*', 0) AS bare FROM takedown_status WHERE url IS NOT NULL)
    SELECT c.ingest_seq, t.bare FROM campaigns c JOIN t ON regexp_extract(c.url, '^[^?#]*', 0) = t.bare
    """
)
def bare_lookup(spark: SparkSession, root: str) -> DataFrame:
    from quernstone.functions.url import without_query

    known = table(spark, root, "takedown_status", "url").where("url IS NOT NULL").select(without_query(F.col("url")).alias("bare")).distinct()
    return table(spark, root, "campaigns", "ingest_seq", "url").select("ingest_seq", without_query(F.col("url")).alias("bare")).join(known, "bare").select("ingest_seq", "bare")


QUERIES, SQL = query.queries, query.sql
