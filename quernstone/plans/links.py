"""Queries over contacts and verdicts: keys, buckets, links, components, reputation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import contact as C
from quernstone.functions import text as T
from quernstone.functions import url as U
from quernstone.operators import identity as I
from quernstone.operators import records as R
from quernstone.plans.base import HOST, Registry, sql_of
from quernstone.sources.tables import table

query = Registry()

_EMAIL_KEY = """
  CASE WHEN contains(e, '@') AND name <> '' THEN name || '@' || CASE WHEN host IN ('gmail.com', 'googlemail.com') THEN 'gmail.com' ELSE host END END
"""
_EMAIL_PARTS = """
  SELECT url, e, split_part(split_part(e, '@', 1), '+', 1) AS untagged, split_part(e, '@', 1) AS local, regexp_extract(e, '^[^@]*@(.*)$', 1) AS host
  FROM (SELECT url, lower(trim(unnest(emails))) AS e FROM contacts)
"""
_PHONES = """
  SELECT url, p, regexp_replace(coalesce(p, ''), '[^0-9]', '', 'g') AS d FROM (SELECT url, unnest(phones) AS p FROM contacts)
"""
_PHONE_KEY = """
  CASE WHEN length(d) BETWEEN 7 AND 15 AND NOT (length(d) - length(regexp_replace(d, '^0+', '')) >= 3 AND length(d) - length(regexp_replace(d, '^0+', '')) >= length(d) // 2) THEN d END
"""


def _each(spark: SparkSession, root: str, column: str) -> DataFrame:
    return table(spark, root, "contacts", "url", column).select("url", F.explode(column).alias("x"))


@query(
    f"""
    SELECT DISTINCT e AS email, {_EMAIL_KEY.replace("name", "batch")} AS email_key, {_EMAIL_KEY.replace("name", "live")} AS live_key,
      regexp_matches(e, '^[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z]{{2,}}$') AND e NOT IN ('[email protected]', '[email redacted]', '[email]', '(email)', 'email', 'e-mail', 'your email', 'via email', 'your email address', 'me', 'us', 'info@', 'contact@', 'admin@',
        '[redacted]', '(redacted)', 'example@example.com', 'your_email_here', 'name@example.com', 'test@test.com', 'user@example.com', 'you@example.com') AS is_valid,
      CASE WHEN contains(e, '@') AND contains(string_split(e, '@')[-1], '.') THEN string_split(e, '@')[-1] END AS domain
    FROM (
      SELECT *, CASE WHEN host IN ('gmail.com', 'googlemail.com') THEN replace(untagged, '.', '') ELSE untagged END AS batch,
        CASE WHEN host IN ('gmail.com', 'googlemail.com') THEN replace(untagged, '.', '') ELSE local END AS live
      FROM ({_EMAIL_PARTS}) WHERE e IS NOT NULL
    )
    """
)
def email_keys(spark: SparkSession, root: str) -> DataFrame:
    e = F.col("email")
    rows = _each(spark, root, "emails").select(F.lower(F.trim("x")).alias("email")).where("email IS NOT NULL").distinct()
    return rows.select("email", C.email_key(e).alias("email_key"), C.email_key_live(e).alias("live_key"), C.valid_email(e).alias("is_valid"), U.email_domain(e).alias("domain"))


@query(f"SELECT p AS phone, d AS digits, {_PHONE_KEY} AS phone_key, count(*) AS n_rows FROM ({_PHONES}) WHERE p IS NOT NULL GROUP BY ALL")
def phone_keys(spark: SparkSession, root: str) -> DataFrame:
    rows = _each(spark, root, "phones").where("x IS NOT NULL").groupBy(F.col("x").alias("phone")).agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.select("phone", C.phone_digits(F.col("phone")).alias("digits"), C.phone_key(F.col("phone")).alias("phone_key"), "n_rows")


_HANDLES = r"""
  SELECT url, h, regexp_matches(h, '^(?i)\$?\d+(?:[.,]\d{1,2})?\s*(?:usd|eur|gbp|\$)?$') OR regexp_matches(h, '^(?i)(?:www\.)?[\w.-]+\.(?:org|com|net|io|co|us)/?$') OR regexp_matches(h, '^[A-Z]{3,4}$') OR h = '' AS is_noise, CASE
      WHEN regexp_matches(h, '^(?i)\$?\d+(?:[.,]\d{1,2})?\s*(?:usd|eur|gbp|\$)?$') OR regexp_matches(h, '^(?i)(?:www\.)?[\w.-]+\.(?:org|com|net|io|co|us)/?$') OR regexp_matches(h, '^[A-Z]{3,4}$') THEN NULL
      WHEN regexp_matches(h, '^(?:bc1[ac-hj-np-z02-9]{8,87}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})$') THEN 'BTC'
      WHEN regexp_matches(h, '^0x[a-fA-F0-9]{40}$') THEN 'ETH'
      WHEN regexp_matches(h, '^[A-Z]{2}\d{2}[A-Z0-9]{4,30}$') THEN 'IBAN'
      WHEN regexp_matches(h, '^(?i)(?:https?://)?(?:www\.)?paypal\.me/[\w\-.]+/?$') THEN 'PayPal.me'
      WHEN regexp_matches(h, '^\$[A-Z]\w{2,20}$') THEN 'CashApp'
      WHEN regexp_matches(h, '^@[\w.-]{3,30}$') THEN 'Venmo' END AS kind
  FROM (SELECT url, trim(unnest(payment_handles)) AS h FROM contacts)
"""


@query(f"SELECT kind, count(*) AS n_rows, count(DISTINCT h) AS n_handles FROM ({_HANDLES}) WHERE h IS NOT NULL GROUP BY kind")
def handle_kinds(spark: SparkSession, root: str) -> DataFrame:
    rows = _each(spark, root, "payment_handles").select(F.trim("x").alias("h")).where("h IS NOT NULL")
    return rows.select("h", C.handle_kind(F.col("h")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("h").alias("n_handles"))


@query(
    f"""
    WITH h AS (SELECT DISTINCT url, h FROM ({_HANDLES}) WHERE NOT is_noise AND url IS NOT NULL), n AS (SELECT h, count(*) AS n FROM h GROUP BY h)
    SELECT url, CAST(max(n) AS BIGINT) AS max_reuse, string_agg(CASE WHEN n >= 2 THEN h || ':' || n END, ';' ORDER BY h) AS reused FROM h JOIN n USING (h) GROUP BY url
    """
)
def wallet_reuse(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "contacts", "url", "payment_handles").select("url", F.explode("payment_handles").alias("x")).select("url", F.trim("x").alias("h"))
    rows = rows.where(F.col("url").isNotNull() & ~C.is_noise(F.col("h"))).distinct()
    counts = rows.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    reused = F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") >= 2, F.concat("h", F.lit(":"), F.col("n").cast("string"))))), ";")
    return rows.join(counts, "h").groupBy("url").agg(F.max("n").alias("max_reuse"), F.nullif(reused, F.lit("")).alias("reused"))


@query(
    """
    SELECT CAST(count(*) AS BIGINT) AS n_rows, count(*) FILTER (WHERE ok) AS n_ok, count(*) FILTER (WHERE len(emails) > 0) AS n_emails, count(*) FILTER (WHERE len(phones) > 0) AS n_phones,
      count(*) FILTER (WHERE len(payment_handles) > 0) AS n_handles, count(*) FILTER (WHERE len(social_handles) > 0) AS n_social, count(*) FILTER (WHERE len(urls) > 0) AS n_urls, count(*) FILTER (WHERE len(names) > 0) AS n_names
    FROM contacts
    """
)
def contact_coverage(spark: SparkSession, root: str) -> DataFrame:
    has = lambda c: F.count_if(F.size(c) > 0)
    return table(spark, root, "contacts").agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if("ok").alias("n_ok"),
        has("emails").alias("n_emails"),
        has("phones").alias("n_phones"),
        has("payment_handles").alias("n_handles"),
        has("social_handles").alias("n_social"),
        has("urls").alias("n_urls"),
        has("names").alias("n_names"),
    )


@query(
    """
    WITH x AS (SELECT row_number() OVER () AS r, url, emails FROM contacts), k AS (
      SELECT r, url, trim(e) AS e, i FROM (SELECT r, url, unnest(emails) AS e, unnest(range(len(emails))) AS i FROM x) WHERE trim(e) <> ''
    ), f AS (SELECT r, url, e, i FROM (SELECT *, row_number() OVER (PARTITION BY r, lower(e) ORDER BY i) AS n FROM k) WHERE n = 1)
    SELECT url, list, count(*) AS n_rows FROM (SELECT r, url, string_agg(e, ';' ORDER BY i) AS list FROM f GROUP BY r, url) GROUP BY url, list
    """
)
def emails_once(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "contacts", "url", "emails").select("url", F.array_join(T.distinct_ignoring_case(F.col("emails")), ";").alias("list"))
    return rows.where("list <> ''").groupBy("url", "list").agg(F.count(F.lit(1)).alias("n_rows"))


def _signals() -> dict[str, Column]:
    return {
        "email": F.transform("emails", C.email_key),
        "phone": F.transform("phones", C.phone_key),
        "payment": F.transform("payment_handles", lambda h: F.when(~C.is_noise(h), F.lower(F.trim(h)))),
        "domain": F.transform("urls", lambda u: U.registrable_root(U.host_enriched(u))),
    }


def _buckets(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "contacts", "url", "emails", "phones", "payment_handles", "urls")
    return I.buckets(rows, "url", _signals())


_BUCKETS = f"""
  emails_of AS (
    SELECT url, {_EMAIL_KEY.replace("name", "batch")} AS v FROM (SELECT *, CASE WHEN host IN ('gmail.com', 'googlemail.com') THEN replace(untagged, '.', '') ELSE untagged END AS batch FROM ({_EMAIL_PARTS}))
  ), buckets AS (
    SELECT DISTINCT signal, v AS value, url AS item FROM (
      SELECT 'email' AS signal, v, url FROM emails_of
      UNION ALL SELECT 'phone', {_PHONE_KEY}, url FROM ({_PHONES})
      UNION ALL SELECT 'payment', CASE WHEN NOT is_noise THEN lower(h) END, url FROM ({_HANDLES})
      UNION ALL SELECT 'domain', array_to_string(list_slice(string_split({sql_of(HOST, "u")}, '.'), -2, -1), '.'), url FROM (SELECT url, unnest(urls) AS u FROM contacts)
    ) WHERE v <> '' AND url IS NOT NULL
  ), sizes AS (
    SELECT signal, value, count(*) AS n FROM buckets GROUP BY signal, value
  ), capped AS (
    SELECT b.* FROM buckets b JOIN sizes s USING (signal, value) WHERE s.n BETWEEN 2 AND 10
  ), edges AS (
    SELECT a.item AS src, b.item AS dst, count(*) AS weight, string_agg(DISTINCT a.signal, ';' ORDER BY a.signal) AS signals
    FROM capped a JOIN capped b ON a.signal = b.signal AND a.value = b.value AND a.item < b.item GROUP BY a.item, b.item
  )
"""


@query(f"WITH {_BUCKETS} SELECT signal, n AS bucket_size, count(*) AS n_buckets FROM sizes GROUP BY signal, n")
def bucket_sizes(spark: SparkSession, root: str) -> DataFrame:
    sizes = _buckets(spark, root).groupBy("signal", "value").agg(F.count(F.lit(1)).alias("bucket_size"))
    return sizes.groupBy("signal", "bucket_size").agg(F.count(F.lit(1)).alias("n_buckets"))


@query(f"WITH {_BUCKETS} SELECT signal, value, item FROM capped")
def share_cap(spark: SparkSession, root: str) -> DataFrame:
    return I.capped(_buckets(spark, root))


@query(f"WITH {_BUCKETS} SELECT src, dst, weight, signals FROM edges")
def pair_edges(spark: SparkSession, root: str) -> DataFrame:
    return I.pair_edges(I.capped(_buckets(spark, root)))


@query(
    f"""
    WITH {_BUCKETS} SELECT a.item, a.signal, count(DISTINCT a.value) AS n_values, count(DISTINCT b.item) AS n_others
    FROM capped a JOIN capped b ON a.signal = b.signal AND a.value = b.value AND a.item <> b.item GROUP BY a.item, a.signal
    """
)
def cross_links(spark: SparkSession, root: str) -> DataFrame:
    return I.shared_with_others(I.capped(_buckets(spark, root)))


@query(
    f"""
    WITH RECURSIVE {_BUCKETS}, near AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
    reach(a, b) AS (SELECT a, a FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a)
    SELECT a AS node, min(b) AS component FROM reach GROUP BY a
    """
)
def components(spark: SparkSession, root: str) -> DataFrame:
    return I.components(pair_edges(spark, root).select("src", "dst"))


@query(
    f"""
    WITH RECURSIVE {_BUCKETS}, near AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges),
    reach(a, b) AS (SELECT a, a FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON r.b = n.a),
    parts AS (SELECT a AS node, min(b) AS component FROM reach GROUP BY a),
    platforms AS (SELECT url, min(platform) AS platform FROM campaigns GROUP BY url)
    SELECT component, count(DISTINCT node) AS n_items, count(DISTINCT platform) AS n_parts FROM parts LEFT JOIN platforms ON node = url GROUP BY component HAVING count(DISTINCT platform) <= 6
    """
)
def cluster_filter(spark: SparkSession, root: str) -> DataFrame:
    parts = components(spark, root)
    platforms = table(spark, root, "campaigns", "url", "platform").groupBy("url").agg(F.min("platform").alias("platform"))
    members = parts.join(platforms, F.col("node") == F.col("url"), "left")
    return I.cluster_report(members, "component", "node", "platform").where("n_parts <= 6")


@query()
def louvain(spark: SparkSession, root: str) -> DataFrame:
    return I.communities(pair_edges(spark, root))


@query(
    f"""
    WITH {_BUCKETS}, owners AS (SELECT url, min(organizer) AS organizer, min(platform) AS platform FROM campaigns GROUP BY url)
    SELECT value, count(DISTINCT item) AS n_items, count(DISTINCT organizer) AS n_owners, count(*) FILTER (WHERE organizer IS NULL) AS n_unowned, count(DISTINCT platform) AS n_parts
    FROM buckets LEFT JOIN owners ON item = url WHERE signal = 'domain' GROUP BY value
    """
)
def domain_coherence(spark: SparkSession, root: str) -> DataFrame:
    owners = table(spark, root, "campaigns", "url", "organizer", "platform").groupBy("url").agg(F.min("organizer").alias("organizer"), F.min("platform").alias("platform"))
    rows = _buckets(spark, root).where("signal = 'domain'").join(owners, F.col("item") == F.col("url"), "left")
    return I.coherence(rows, "value", "item", "organizer", "platform")


_VERDICTS = """
  verdicts AS (
    SELECT domain, checked_at, vt_malicious, vt_suspicious, vt_status FROM (
      SELECT *, row_number() OVER (PARTITION BY domain ORDER BY checked_at DESC NULLS LAST, coalesce(vt_malicious, -1) DESC, coalesce(vt_suspicious, -1) DESC, coalesce(vt_status, '') DESC) AS r FROM (
        SELECT nullif(regexp_replace(regexp_replace(lower(trim(coalesce(domain, ''))), '^www\\.', ''), '^\\.+|\\.+$', '', 'g'), '') AS domain, checked_at, vt_malicious, vt_suspicious, vt_status FROM domain_verdicts
      ) WHERE domain IS NOT NULL
    ) WHERE r = 1
  )
"""


def _latest_verdicts(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "domain_verdicts", "domain", "checked_at", "vt_malicious", "vt_suspicious", "vt_status").withColumn("domain", U.canonical_domain(F.col("domain"))).where("domain IS NOT NULL")
    newest = F.struct(F.coalesce("checked_at", F.lit("")), F.coalesce("vt_malicious", F.lit(-1)), F.coalesce("vt_suspicious", F.lit(-1)), F.coalesce("vt_status", F.lit("")))
    best = rows.groupBy("domain").agg(F.max_by(F.struct("checked_at", "vt_malicious", "vt_suspicious", "vt_status"), newest).alias("v"))
    return best.select("domain", "v.*")


@query(f"WITH {_VERDICTS} SELECT domain, checked_at, vt_malicious, vt_suspicious, vt_status FROM verdicts")
def latest_verdicts(spark: SparkSession, root: str) -> DataFrame:
    return _latest_verdicts(spark, root)


_CITED = f"""
  cited AS (SELECT DISTINCT url, {sql_of(HOST, "u")} AS domain FROM (SELECT url, unnest(urls) AS u FROM contacts) WHERE url IS NOT NULL),
  checked AS (SELECT c.url, c.domain, v.domain IS NOT NULL AS is_known, coalesce(vt_malicious, 0) + coalesce(vt_suspicious, 0) AS hits FROM cited c LEFT JOIN verdicts v USING (domain) WHERE c.domain <> '')
"""


@query(
    f"""
    WITH {_VERDICTS}, {_CITED}
    SELECT url, CAST(max(hits) AS INT) AS max_hits, bool_or(hits >= 1) AS any_hit, bool_or(hits >= 2) AS any_two, count(*) AS n_domains, count(*) FILTER (WHERE is_known) AS n_known FROM checked GROUP BY url
    """
)
def reputation_max(spark: SparkSession, root: str) -> DataFrame:
    cited = table(spark, root, "contacts", "url", "urls").where("url IS NOT NULL").select("url", F.explode("urls").alias("u")).select("url", U.host_enriched(F.col("u")).alias("domain")).where("domain <> ''").distinct()
    verdicts = _latest_verdicts(spark, root)
    hits = F.coalesce("vt_malicious", F.lit(0)) + F.coalesce("vt_suspicious", F.lit(0))
    checked = cited.join(verdicts.select("domain", "vt_malicious", "vt_suspicious", F.lit(True).alias("is_known")), "domain", "left").withColumn("hits", hits)
    return checked.groupBy("url").agg(
        F.max("hits").alias("max_hits"), F.bool_or(F.col("hits") >= 1).alias("any_hit"), F.bool_or(F.col("hits") >= 2).alias("any_two"), F.count(F.lit(1)).alias("n_domains"), F.count_if("is_known").alias("n_known")
    )


@query(
    f"""
    WITH {_CITED.replace("checked AS", "ignored AS").split("ignored AS")[0].rstrip().rstrip(",")}
    SELECT domain, count(*) AS n_pages, list_aggregate(list_slice(list_sort(list(url)), 1, 3), 'string_agg', ';') AS first_pages FROM cited WHERE domain <> '' GROUP BY domain
    """
)
def domain_stats(spark: SparkSession, root: str) -> DataFrame:
    cited = table(spark, root, "contacts", "url", "urls").where("url IS NOT NULL").select("url", F.explode("urls").alias("u")).select("url", U.host_enriched(F.col("u")).alias("domain")).where("domain <> ''").distinct()
    counts = cited.groupBy("domain").agg(F.count(F.lit(1)).alias("n_pages"))
    # Three pages a domain: the rank limit is applied before the shuffle, so no domain's pages are ever gathered.
    from pyspark.sql import Window

    firsts = cited.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy("url"))).where("r <= 3")
    listed = firsts.groupBy("domain").agg(F.array_join(F.array_sort(F.collect_list("url")), ";").alias("first_pages"))
    return counts.join(listed, "domain")


_TIES = r"""
  ties AS (
    SELECT DISTINCT url, CAST(try_cast(trim(cluster_id, E' \t\n\r') AS DOUBLE) AS BIGINT) AS cluster FROM detector_d_flags WHERE url IS NOT NULL AND regexp_full_match(trim(cluster_id, E' \t\n\r'), '[0-9]+(\.0*)?')
  )
"""


def _clusters(spark: SparkSession, root: str) -> DataFrame:
    text = F.regexp_replace("cluster_id", r"^\s+|\s+$", "")
    number = F.when(text.rlike(r"^[0-9]+(\.0*)?$"), text.try_cast("double").cast("long"))
    return table(spark, root, "detector_d_flags", "url", "cluster_id").select("url", number.alias("cluster")).where("url IS NOT NULL AND cluster IS NOT NULL").distinct()


@query(
    f"""
    WITH {_TIES}, met AS (SELECT a.cluster, a.url, b.url AS sibling FROM ties a JOIN ties b ON a.cluster = b.cluster AND a.url <> b.url)
    SELECT cluster, url, sibling, CAST(place AS INT) AS place FROM (SELECT *, row_number() OVER (PARTITION BY cluster, url ORDER BY sibling) AS place FROM met) WHERE place <= 3
    """
)
def sibling_lookup(spark: SparkSession, root: str) -> DataFrame:
    return R.siblings(_clusters(spark, root), "cluster", "url", 3).select("cluster", "url", "sibling", "place")


@query(
    f"""
    WITH {_TIES}, owners AS (SELECT url, min(platform) AS platform FROM campaigns GROUP BY url)
    SELECT cluster, count(DISTINCT t.url) AS n_items, count(DISTINCT platform) AS n_parts FROM ties t LEFT JOIN owners o ON t.url = o.url GROUP BY cluster
    """
)
def cluster_sizes(spark: SparkSession, root: str) -> DataFrame:
    owners = table(spark, root, "campaigns", "url", "platform").groupBy("url").agg(F.min("platform").alias("platform"))
    return I.cluster_report(_clusters(spark, root).join(owners, "url", "left"), "cluster", "url", "platform")


@query(
    r"""
    WITH s AS (SELECT DISTINCT url, unnest(string_split(fired_signals, ';')) AS s FROM detector_d_flags WHERE fired_signals <> '')
    SELECT regexp_replace(s, '^[CD]\.[0-9]+_', '') AS signal, count(DISTINCT url) AS n_urls FROM s WHERE s <> '' GROUP BY 1
    """
)
def signal_counts(spark: SparkSession, root: str) -> DataFrame:
    # Both generations of signal names mean the same signal.
    rows = table(spark, root, "detector_d_flags", "url", "fired_signals").select("url", F.explode(F.split("fired_signals", ";")).alias("s")).where("s <> ''")
    return rows.select(F.regexp_replace("s", r"^[CD]\.[0-9]+_", "").alias("signal"), "url").groupBy("signal").agg(F.countDistinct("url").alias("n_urls"))


QUERIES, SQL = query.queries, query.sql
