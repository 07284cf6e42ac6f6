"""Queries over pages: url variants, hosts, deduplication, lookup, merging, sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import url as U
from quernstone.operators import records as R
from quernstone.plans.base import BARE, HOST, NO_WWW, NORMALIZED_URL, PRESENT, Registry, sql_of
from quernstone.sources.tables import table

query = Registry()

#: Stand-ins for hosts that many pages share and for our own platforms.
SHARED_HOSTS = ["spotnest.example", "kindraise.example", "sharedhost.example"]
#: Answers that end a conversation about a page.
TAKEN_DOWN = "taken_down"

_HOSTS = """
  SELECT ingest_seq, url, {bare} AS b FROM campaigns
""".format(bare=sql_of(BARE, "url"))


@query(
    f"""
    WITH scored AS (
      SELECT ingest_seq, url, {sql_of(NORMALIZED_URL, "url")} AS norm,
        {" + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in ("platform", "title", "description", "organizer", "organizer_url", "location", "goal_amount", "raised_amount", "created_date"))} AS score
      FROM campaigns
    )
    SELECT ingest_seq, url, norm, CAST(score AS INT) AS score FROM (
      SELECT *, row_number() OVER (PARTITION BY norm ORDER BY score DESC, url, ingest_seq) AS r FROM scored
    ) WHERE r = 1
    """
)
def url_dedupe(spark: SparkSession, root: str) -> DataFrame:
    columns = ("platform", "title", "description", "organizer", "organizer_url", "location", "goal_amount", "raised_amount", "created_date")
    rows = table(spark, root, "campaigns", "ingest_seq", "url", *columns)
    scored = rows.select("ingest_seq", "url", U.normalize_url(F.col("url")).alias("norm"), R.filled(rows, "ingest_seq", "url").alias("score"))
    return R.best_per_key(scored, F.col("norm"), -F.col("score"), F.col("url"), F.col("ingest_seq"))


@query(
    f"""
    SELECT ingest_seq,
      regexp_replace(regexp_replace(b, '^www\\.', ''), '/+$', '') AS norm,
      {NO_WWW.format("regexp_extract(b, '^[^/?:]*', 0)")} AS detector,
      regexp_replace(regexp_extract(b, '^[^/?#]*', 0), '^\\.+|\\.+$', '', 'g') AS lookup,
      {sql_of(HOST, "url")} AS enriched,
      CASE WHEN contains({sql_of(HOST, "url")}, '.') AND length({sql_of(HOST, "url")}) >= 4 THEN {sql_of(HOST, "url")} END AS full_host,
      regexp_replace({NO_WWW.format("regexp_extract(b, '^[^/?#]*', 0)")}, '^\\.+|\\.+$', '', 'g') AS href,
      {NO_WWW.format("lower(regexp_extract(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1))")} AS parsed
    FROM ({_HOSTS})
    """
)
def host_variants(spark: SparkSession, root: str) -> DataFrame:
    u = F.col("url")
    return table(spark, root, "campaigns", "ingest_seq", "url").select(
        "ingest_seq",
        U.normalize_url(u).alias("norm"),
        U.host_detector(u).alias("detector"),
        U.host_lookup(u).alias("lookup"),
        U.host_enriched(u).alias("enriched"),
        U.host_full(u).alias("full_host"),
        U.host_href(u).alias("href"),
        U.host_parsed(u).alias("parsed"),
    )


@query(
    f"""
    WITH h AS (SELECT ingest_seq, {sql_of(HOST, "url")} AS host FROM campaigns), s AS (
      SELECT ingest_seq, host, unnest(CASE WHEN len(string_split(host, '.')) >= 2
        THEN list_transform(range(1, len(string_split(host, '.'))), lambda i: array_to_string(list_slice(string_split(host, '.'), i, len(string_split(host, '.'))), '.')) ELSE [host] END) AS suffix
      FROM h
    )
    SELECT ingest_seq, bool_or(suffix IN ('spotnest.example', 'kindraise.example', 'sharedhost.example')) AS is_shared, CAST(count(*) AS BIGINT) AS n_suffixes FROM s GROUP BY ingest_seq
    """
)
def host_suffix_infra(spark: SparkSession, root: str) -> DataFrame:
    host = U.host_enriched(F.col("url"))
    return table(spark, root, "campaigns", "ingest_seq", "url").select("ingest_seq", U.under_any(host, SHARED_HOSTS).alias("is_shared"), F.size(U.host_suffixes(host)).cast("long").alias("n_suffixes"))


@query(
    f"""
    WITH h AS (SELECT array_to_string(list_slice(string_split({sql_of(HOST, "url")}, '.'), -2, -1), '.') AS root, platform FROM campaigns)
    SELECT root, count(*) AS n_rows, count(DISTINCT platform) AS n_platforms FROM h GROUP BY root
    """
)
def root_counts(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "campaigns", "url", "platform").select(U.registrable_root(U.host_enriched(F.col("url"))).alias("root"), "platform")
    return rows.groupBy("root").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("platform").alias("n_platforms"))


_DOMAINS = """
  SELECT nullif(regexp_replace(regexp_replace(lower(trim(coalesce(domain, ''))), '^www\\.', ''), '^\\.+|\\.+$', '', 'g'), '') AS domain,
    checked_at, vt_malicious, vt_suspicious, vt_status FROM domain_verdicts
"""


@query(
    f"""
    SELECT domain, regexp_matches(domain, '^(?i)[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?(?:\\.[a-z0-9](?:[a-z0-9-]{{0,61}}[a-z0-9])?)+$')
      AND regexp_matches(domain, '(?i)\\.[a-z]{{2,24}}$') AND regexp_matches(domain, '(?i)[a-z]') AS is_valid, count(*) AS n_rows
    FROM ({_DOMAINS}) WHERE domain IS NOT NULL GROUP BY ALL
    """
)
def domain_validity(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "domain_verdicts", "domain").select(U.canonical_domain(F.col("domain")).alias("domain")).where("domain IS NOT NULL")
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("n_rows")).select("domain", U.valid_domain(F.col("domain")).alias("is_valid"), "n_rows")


@query(
    """
    WITH q AS (SELECT ingest_seq, url, regexp_extract(url, '^[^?#]*', 0) AS bare, regexp_extract(url, '\\?([^#]*)', 1) AS query FROM campaigns)
    SELECT ingest_seq, CASE WHEN query = '' THEN bare ELSE bare || coalesce('?' || nullif(array_to_string(list_filter(string_split(query, '&'),
      lambda p: lower(string_split(p, '=')[1]) NOT IN ('src', 'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'ref', 'ref_', 'referrer', 'referer', 'mc_cid', 'mc_eid', 'share', 'shared', 'via', 'from')), '&'), ''), '') END AS kept
    FROM q
    """
)
def tracking_stripped(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "campaigns", "ingest_seq", "url").select("ingest_seq", U.without_tracking(F.col("url")).alias("kept"))


@query(
    """
    WITH probes AS (
      SELECT ingest_seq, unnest(['?utm_source=mail', '/', '']) AS tail, url FROM campaigns WHERE url IS NOT NULL
    ), stored AS (
      SELECT url AS form, min(flag) AS flag FROM detector_d_flags WHERE url IS NOT NULL GROUP BY url
    ), forms AS (
      SELECT ingest_seq, tail, url || tail AS u FROM probes
    ), bare AS (
      SELECT *, regexp_extract(u, '^[^?#]*', 0) AS b, regexp_extract(u, '\\?([^#]*)', 1) AS q FROM forms
    ), four AS (
      SELECT ingest_seq, tail, [u, CASE WHEN q = '' THEN b ELSE b || coalesce('?' || nullif(array_to_string(list_filter(string_split(q, '&'),
        lambda p: lower(string_split(p, '=')[1]) NOT IN ('src', 'utm_source', 'utm_medium', 'utm_campaign', 'utm_term', 'utm_content', 'fbclid', 'gclid', 'ref', 'ref_', 'referrer', 'referer', 'mc_cid', 'mc_eid', 'share', 'shared', 'via', 'from')), '&'), ''), '') END,
        b, CASE WHEN ends_with(b, '/') THEN regexp_replace(b, '/+$', '') ELSE b || '/' END] AS f FROM bare
    ), eight AS (
      SELECT ingest_seq, tail, list_concat(f, list_transform(f, lambda u: CASE WHEN regexp_matches(u, '^(?i)[a-z]+://www\\.') THEN regexp_replace(u, '^(?i)([a-z]+://)www\\.', '\\1') ELSE regexp_replace(u, '^([A-Za-z]+://)', '\\1www.') END)) AS f FROM four
    ), tried AS (
      SELECT ingest_seq, tail, unnest(f) AS form, unnest(range(len(f))) AS rank FROM eight
    )
    SELECT ingest_seq || tail AS probe, arg_min(form, rank) AS form, arg_min(flag, rank) AS flag FROM tried JOIN stored USING (form) GROUP BY 1
    """
)
def url_lookup(spark: SparkSession, root: str) -> DataFrame:
    tails = F.array(F.lit("?utm_source=mail"), F.lit("/"), F.lit(""))
    probes = table(spark, root, "campaigns", "ingest_seq", "url").where("url IS NOT NULL").withColumn("tail", F.explode(tails))
    probes = probes.select(F.concat(F.col("ingest_seq").cast("string"), "tail").alias("probe"), F.concat("url", "tail").alias("u"))
    stored = table(spark, root, "detector_d_flags", "url", "flag").where("url IS NOT NULL").groupBy("url").agg(F.min("flag").alias("flag"))
    return R.ranked_lookup(probes, "probe", U.candidate_forms(F.col("u")), stored, "url", ["flag"]).select("probe", "form", "flag")


@query(
    """
    SELECT url, title, organizer, ingest_seq FROM (
      SELECT *, row_number() OVER (PARTITION BY url ORDER BY ingest_seq DESC) AS r FROM campaigns WHERE url IS NOT NULL
    ) WHERE r = 1
    """
)
def last_wins(spark: SparkSession, root: str) -> DataFrame:
    return R.last_wins(table(spark, root, "campaigns", "url", "title", "organizer", "ingest_seq"), "url", "ingest_seq")


@query("SELECT DISTINCT c.url FROM campaigns c WHERE c.url IS NOT NULL AND NOT EXISTS (SELECT 1 FROM takedown_status t WHERE t.url = c.url)")
def resume_antijoin(spark: SparkSession, root: str) -> DataFrame:
    wanted = table(spark, root, "campaigns", "url").where("url IS NOT NULL").distinct()
    return R.pending(wanted, table(spark, root, "takedown_status", "url"), "url")


@query("SELECT DISTINCT url FROM campaigns WHERE url IN (SELECT url FROM contacts)")
def known_contacts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "campaigns", "url").join(table(spark, root, "contacts", "url"), "url", "left_semi").distinct()


@query(
    """
    WITH old AS (SELECT url, arg_max_null(title, ingest_seq) AS title, arg_max_null(location, ingest_seq) AS location FROM campaigns WHERE ingest_seq % 2 = 0 AND url IS NOT NULL GROUP BY url),
    new AS (SELECT url, arg_max_null(title, ingest_seq) AS title, arg_max_null(organizer, ingest_seq) AS organizer FROM campaigns WHERE ingest_seq % 2 = 1 AND url IS NOT NULL GROUP BY url)
    SELECT coalesce(n.url, o.url) AS url, coalesce(n.title, o.title) AS title, o.location, n.organizer FROM old o FULL JOIN new n ON o.url = n.url
    """
)
def merge_upsert(spark: SparkSession, root: str) -> DataFrame:
    # The two loads to merge are told apart by the parity of their sequence number; all rows take part.
    rows = table(spark, root, "campaigns", "url", "title", "location", "organizer", "ingest_seq").where("url IS NOT NULL")
    last = lambda df, *c: df.groupBy("url").agg(*[F.max_by(x, "ingest_seq").alias(x) for x in c])
    stored = last(rows.where("ingest_seq % 2 = 0"), "title", "location")
    incoming = last(rows.where("ingest_seq % 2 = 1"), "title", "organizer")
    return R.merged(stored, incoming, "url")


@query(
    f"""
    WITH c AS (SELECT platform, count(*) AS n FROM campaigns GROUP BY platform),
    top AS (SELECT platform FROM c ORDER BY n DESC, platform NULLS FIRST LIMIT 5)
    SELECT CASE WHEN EXISTS (SELECT 1 FROM top WHERE top.platform IS NOT DISTINCT FROM c.platform) THEN coalesce(platform, '(none)') ELSE 'Other' END AS name, CAST(sum(n) AS BIGINT) AS n_rows
    FROM c GROUP BY 1
    """
)
def top_other(spark: SparkSession, root: str) -> DataFrame:
    return R.top_and_other(table(spark, root, "campaigns", "platform"), "platform", 5)


@query(
    """
    WITH sizes AS (SELECT platform, count(*) AS size, sum(count(*)) OVER () AS total FROM campaigns GROUP BY platform),
    shares AS (SELECT *, CAST(round_even(size * 200.0 / total, 0) AS BIGINT) AS share FROM sizes),
    planned AS (
      SELECT platform, CASE WHEN total <= 200 THEN size ELSE share + CASE WHEN row_number() OVER (ORDER BY size DESC, coalesce(platform, '') DESC) = 1 THEN 200 - CAST(sum(share) OVER () AS BIGINT) ELSE 0 END END AS take FROM shares
    ), placed AS (
      SELECT platform, ingest_seq, row_number() OVER (PARTITION BY platform ORDER BY CAST('0x' || substr(md5('42:' || ingest_seq), 1, 15) AS BIGINT), ingest_seq) AS r FROM campaigns
    )
    SELECT x.platform, x.ingest_seq FROM placed x JOIN planned p ON x.platform IS NOT DISTINCT FROM p.platform WHERE x.r <= p.take
    """
)
def stratified_alloc(spark: SparkSession, root: str) -> DataFrame:
    return R.stratified_sample(table(spark, root, "campaigns", "platform", "ingest_seq"), "platform", "ingest_seq", 200, 42)


@query(
    """
    WITH placed AS (SELECT item_id, row_number() OVER (ORDER BY md5('42:' || item_id), item_id) - 1 AS place FROM (SELECT DISTINCT item_id FROM eval_items)),
    teams AS (SELECT row_number() OVER (ORDER BY a, b, c) - 1 AS t, a, b, c FROM (VALUES ('w1'), ('w2'), ('w3'), ('w4'), ('w5'), ('w6')) x(a) JOIN (VALUES ('w1'), ('w2'), ('w3'), ('w4'), ('w5'), ('w6')) y(b) ON a < b JOIN (VALUES ('w1'), ('w2'), ('w3'), ('w4'), ('w5'), ('w6')) z(c) ON b < c)
    SELECT item_id, unnest([a, b, c]) AS worker FROM placed JOIN teams ON place % 20 = t
    """
)
def assignment(spark: SparkSession, root: str) -> DataFrame:
    return R.balanced_assignment(table(spark, root, "eval_items", "item_id"), "item_id", [f"w{i}" for i in range(1, 7)], 3, 42)


@query(
    f"""
    WITH parsed AS (SELECT url, {sql_of(PRESENT, "category")} AS category, checked_at FROM takedown_status WHERE url IS NOT NULL),
    tidy AS (SELECT url, regexp_replace(lower(category), '[\\s_-]+', '_', 'g') AS category, checked_at FROM parsed),
    firsts AS (SELECT url, arg_min(category, checked_at) AS was, arg_max(category, checked_at) AS now FROM (SELECT url, checked_at, min(category) AS category FROM tidy WHERE checked_at IS NOT NULL AND category IS NOT NULL GROUP BY url, checked_at) GROUP BY url)
    SELECT was, now, count(*) AS n_rows FROM firsts GROUP BY was, now
    """
)
def status_changes(spark: SparkSession, root: str) -> DataFrame:
    from quernstone.functions.text import present

    category = F.regexp_replace(F.lower(present(F.col("category"))), r"[\s_-]+", "_")
    rows = table(spark, root, "takedown_status", "url", "category", "checked_at").select("url", category.alias("category"), "checked_at").where("url IS NOT NULL AND category IS NOT NULL AND checked_at IS NOT NULL")
    rows = rows.groupBy("url", "checked_at").agg(F.min("category").alias("category"))
    ends = rows.groupBy("url").agg(F.min_by("category", "checked_at").alias("was"), F.max_by("category", "checked_at").alias("now"))
    return R.changes(ends.select("url", "was"), ends.select("url", F.col("now").alias("was")), "url", "was")


@query(
    """
    WITH a AS (SELECT DISTINCT url FROM contacts WHERE ok), b AS (SELECT DISTINCT url FROM takedown_status), c AS (SELECT DISTINCT url FROM detector_d_flags WHERE flag = 1)
    SELECT 'union' AS part, count(*) AS n_rows FROM (SELECT * FROM a UNION SELECT * FROM b UNION SELECT * FROM c)
    UNION ALL SELECT 'shared', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM c)
    UNION ALL SELECT 'only_contacts', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM c)
    UNION ALL SELECT 'only_flagged', count(*) FROM (SELECT * FROM c EXCEPT SELECT * FROM a)
    """
)
def set_parts(spark: SparkSession, root: str) -> DataFrame:
    a = table(spark, root, "contacts", "url", "ok").where("ok").select("url").distinct()
    b = table(spark, root, "takedown_status", "url").distinct()
    c = table(spark, root, "detector_d_flags", "url", "flag").where("flag = 1").select("url").distinct()
    parts = {"union": a.union(b).union(c).distinct(), "shared": a.intersect(c), "only_contacts": a.subtract(c), "only_flagged": c.subtract(a)}
    counted = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("part"), "n_rows") for name, df in parts.items()]
    out = counted[0]
    for more in counted[1:]:
        out = out.unionByName(more)
    return out


@query(
    """
    SELECT column_name, n_present, (SELECT count(*) FROM campaigns) AS n_rows FROM (
      SELECT unnest(['url', 'platform', 'title', 'description', 'organizer', 'organizer_url', 'location', 'goal_amount', 'raised_amount', 'scrape_timestamp']) AS column_name,
        unnest([count(url), count(platform), count(title), count(description), count(organizer), count(organizer_url), count(location), count(goal_amount), count(raised_amount), count(scrape_timestamp)]) AS n_present
      FROM campaigns
    )
    """
)
def column_completeness(spark: SparkSession, root: str) -> DataFrame:
    return R.completeness(table(spark, root, "campaigns", "url", "platform", "title", "description", "organizer", "organizer_url", "location", "goal_amount", "raised_amount", "scrape_timestamp"))


QUERIES, SQL = query.queries, query.sql
