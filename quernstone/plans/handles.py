"""Queries that parse, class, move and audit handles and links.

The tables hold few of the forms that people type, so each query also takes the
rows of WRITTEN, one per rule; the SQL takes the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernstone.functions import url as U
from quernstone.operators import handles as H
from quernstone.plans.base import Registry
from quernstone.plans.pages import SHARED_HOSTS
from quernstone.sources.tables import table

query = Registry()

#: Handles and links as they are typed, one or more for each rule.
WRITTEN = (
    "", "@", "@a b", "@Facebook", "@@jo.doe ", "nohost", "ex ample.com/x", "https://www.facebook.com/jo.doe?x=1", "m.facebook.com/jo.doe", "facebook.com/events/12", "fb.com/",
    "https://LinkedIn.com/in/jo-doe/", "linkedin.com/company/", "linkedin.com/jo", "youtube.com/channel/UC123/videos", "youtube.com/c/", "https://youtube.com/@jo", "https://t.me/jo_doe", "wa.me/4915550123",
    "instagr.am/jo#x", "x.com/jo/status/1", "tiktok.com/@TikTok@momwith", "facebook.com/facebook.com", "youtube.com/www.site.org", "instagram.com/j", "twitter.com/intent/tweet", "patreon.com/jo",
    "https://linktr.ee/jo", "unknown.com/jo", "github.com/jo", "reddit.com/user/jo", "telegram.me/jo", "https://paypal.me/jo", "https://www.paypal.com/donate?id=1", "https://cash.app/$jo",
    "https://ko-fi.com/jo", "https://vimeo.com/1", "https://www.bbc.co.uk/news/1", "https://de.wikipedia.org/wiki/X", "https://raw.githubusercontent.com/a/b", "https://bbb.org/x",
    "https://sharedhost.example/jo", "https://jo.example.org/plan.pdf", "https://jo.example.org/a.docx?dl=1", "https://spotnest.example/c/1", "https://sub.kindraise.example/", "facebook.com/a b", "medium.com/@jo/post",
)


def _values(texts) -> str:
    return "(VALUES " + ", ".join("('" + t.replace("'", "''") + "')" for t in texts) + ")"


_LINKS = f"links AS (SELECT DISTINCT v FROM (SELECT unnest(social_handles) AS v FROM contacts UNION ALL SELECT unnest(urls) FROM contacts UNION ALL SELECT organizer_url FROM campaigns UNION ALL SELECT * FROM {_values(WRITTEN)} w(v)) WHERE v IS NOT NULL)"


def _links(spark: SparkSession, root: str) -> DataFrame:
    contacts = table(spark, root, "contacts", "social_handles", "urls")
    parts = [contacts.select(F.explode("social_handles").alias("v")), contacts.select(F.explode("urls").alias("v")), table(spark, root, "campaigns", "organizer_url").select(F.col("organizer_url").alias("v"))]
    rows = spark.createDataFrame([(w,) for w in WRITTEN], "v string")
    for part in parts:
        rows = rows.unionByName(part)
    return rows.where("v IS NOT NULL").distinct()


def _case(value: str, pairs: dict[str, str]) -> str:
    return f"CASE {value} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + " END"


def _in(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _sql_host(v: str) -> str:
    return f"trim(regexp_extract(regexp_replace(regexp_replace(lower(trim({v})), '^https?://', ''), '^www\\.', ''), '^[^/?#]*', 0), '.')"


_PARSED = rf"""
  {_LINKS}, cut AS (
    SELECT v, trim(v, E' \t\n\r') AS raw FROM links
  ), parts AS (
    SELECT v, raw, trim(ltrim(raw, '@')) AS bare, regexp_replace(regexp_replace(raw, '^(?i)https?://', ''), '^(?i)www\.', '') AS rest FROM cut
  ), paths AS (
    SELECT *, lower(rtrim(regexp_extract(rest, '^[^/?#]*', 0), '.')) AS host, trim(regexp_extract(rest, '^[^/]*/([^?#]*)', 1)) AS path FROM parts
  ), named AS (
    SELECT *, {_case("split_part(host, '.', 1)", H.PLATFORM_BY_LABEL)} AS known, CASE {" ".join(f"WHEN starts_with(lower(path), '{p}') THEN '{p.rstrip('/')}'" for p in H.NON_PROFILE_PREFIXES)} END AS prefix,
      rtrim(ltrim(ltrim(path, '/'), '@'), '/') AS name FROM paths
  ), segments AS (
    SELECT *, split_part(name, '/', 1) AS one, split_part(name, '/', 2) AS two FROM named
  ), kinds AS (
    SELECT *, CASE {" ".join(f"WHEN known = '{p}' AND one IN {_in(s)} THEN '{p}'" for p, s in H.KEPT_SEGMENTS.items())} END AS kept FROM segments
  ), users AS (
    SELECT *, CASE WHEN kept IS NOT NULL THEN one || '/' || two WHEN known = 'youtube' THEN ltrim(one, '@') ELSE one END AS u FROM kinds
  ), firm AS (
    SELECT *, CASE WHEN regexp_matches(u, '^[^@]+@.') THEN split_part(substr(u, strpos(u, '@') + 1), '/', 1) ELSE u END AS id FROM users
  ), judged AS (
    SELECT *, CASE WHEN raw = '' THEN 'empty' WHEN raw[1] = '@' AND (length(bare) < 2 OR regexp_matches(bare, '\s')) THEN 'bare_at_invalid'
      WHEN raw[1] = '@' AND lower(bare) IN {_in(H.SELF_REFERENTIAL)} THEN 'bare_at_is_platform_name' WHEN raw[1] = '@' THEN NULL
      WHEN NOT contains(host, '.') OR NOT regexp_full_match(host, '[\p{{L}}\p{{N}}_.\-]+') THEN 'no_valid_host' WHEN known IS NOT NULL AND prefix IS NOT NULL THEN 'non_profile_path:' || prefix
      WHEN kept IS NOT NULL AND two = '' THEN kept || '_no_id_after_prefix' WHEN id = '' THEN 'no_user_id' WHEN regexp_matches(id, '\s') THEN 'whitespace_in_user_id'
      WHEN lower(id) IN {_in(H.SELF_REFERENTIAL)} THEN 'self_referential' WHEN regexp_matches(id, '(?i){H.DOMAIN_ENDING}') THEN 'user_id_looks_like_domain' WHEN length(id) < 2 THEN 'user_id_too_short' END AS drop_reason
    FROM firm
  ), handles AS (
    SELECT v, CASE WHEN drop_reason IS NOT NULL THEN NULL WHEN raw[1] = '@' THEN 'unknown' ELSE coalesce(known, 'unknown') END AS platform,
      CASE WHEN drop_reason IS NOT NULL THEN NULL WHEN raw[1] = '@' THEN bare ELSE id END AS user_id,
      CASE WHEN drop_reason IS NOT NULL OR raw[1] = '@' THEN NULL WHEN known IS NOT NULL THEN 'https://' || {_case("known", H.CANONICAL_HOST)} || '/' || id ELSE 'https://' || host || '/' || path END AS profile, drop_reason
    FROM judged
  )"""

_RECLASSED = rf"""
  {_PARSED}, hosted AS (
    SELECT *, CASE WHEN platform = 'unknown' AND profile IS NOT NULL THEN trim(lower(regexp_extract(regexp_replace(profile, '^https?://', ''), '^[^/]*', 0)), '.') END AS h FROM handles
  ), acted AS (
    SELECT *, {_case("split_part(h, '.', 1)", H.EXTRA_BY_LABEL)} AS extra FROM hosted
  ), second AS (
    SELECT *, CASE WHEN h IN {_in(H.FACEBOOK_HOSTS)} THEN 'fb_subdomain_normalized' WHEN h = 'unknown.com' THEN 'demoted_unknown_com' WHEN extra IS NOT NULL THEN 'reclassified' ELSE 'no_change' END AS action FROM acted
  ), reclassed AS (
    SELECT v, CASE action WHEN 'fb_subdomain_normalized' THEN 'facebook' WHEN 'reclassified' THEN extra ELSE platform END AS platform, user_id,
      CASE action WHEN 'fb_subdomain_normalized' THEN 'https://facebook.com/' || user_id WHEN 'demoted_unknown_com' THEN NULL
        WHEN 'reclassified' THEN 'https://' || {_case("extra", H.EXTRA_HOST)} || '/' || user_id ELSE profile END AS profile, drop_reason, action
    FROM second
  )"""


@query(f"WITH {_PARSED} SELECT * FROM handles")
def handles_parsed(spark: SparkSession, root: str) -> DataFrame:
    return H.parsed_handles(_links(spark, root), "v")


@query(f"WITH {_RECLASSED} SELECT * FROM reclassed")
def handles_reclassified(spark: SparkSession, root: str) -> DataFrame:
    return H.reclassified_handles(handles_parsed(spark, root))


@query(f"WITH {_PARSED} SELECT coalesce(drop_reason, 'kept') AS outcome, platform, count(*) AS n_values, min(v) AS example FROM handles GROUP BY ALL")
def handle_audit(spark: SparkSession, root: str) -> DataFrame:
    """How many written handles were kept or dropped, by reason and platform, each with an example."""
    return handles_parsed(spark, root).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome"), "platform").agg(F.count(F.lit(1)).alias("n_values"), F.min("v").alias("example"))


@query(
    f"""
    WITH {_RECLASSED}
    SELECT r.v, p.platform AS platform_before, r.platform AS platform_after, p.profile AS profile_before, r.profile AS profile_after, r.action FROM reclassed r JOIN handles p USING (v) WHERE r.action <> 'no_change'
    """
)
def reclassification_audit(spark: SparkSession, root: str) -> DataFrame:
    """Only the handles that the second look changed, as they were and as they are."""
    before = handles_parsed(spark, root).select("*", F.col("platform").alias("platform_before"), F.col("profile").alias("profile_before"))
    changed = F.when(F.col("action") != "no_change", F.struct("v", "platform_before", "platform", "profile_before", "profile", "action"))
    # Exploding a list of one or none keeps the filter above the parsing, which would otherwise be copied into it.
    kept = H.reclassified_handles(before).select(F.explode(F.filter(F.array(changed), lambda c: c.isNotNull())).alias("c")).select("c.*")
    return kept.select("v", "platform_before", F.col("platform").alias("platform_after"), "profile_before", F.col("profile").alias("profile_after"), "action")


@query(
    f"""
    WITH {_RECLASSED} SELECT v, CASE WHEN drop_reason IS NOT NULL THEN 'dropped' WHEN action IN ('reclassified', 'fb_subdomain_normalized') THEN 'replaced' WHEN platform = 'unknown' THEN 'unknown' ELSE 'kept' END AS lineage,
      coalesce(profile, user_id, v) AS shown FROM reclassed
    """
)
def handle_lineage(spark: SparkSession, root: str) -> DataFrame:
    """What became of every written handle: dropped, replaced, unknown or kept."""
    replaced = F.col("action").isin("reclassified", "fb_subdomain_normalized")
    status = F.when(F.col("drop_reason").isNotNull(), "dropped").when(replaced, "replaced").when(F.col("platform") == "unknown", "unknown").otherwise("kept")
    return handles_reclassified(spark, root).select("v", status.alias("lineage"), F.coalesce("profile", "user_id", "v").alias("shown"))


_OF_HOST = "CASE " + " ".join(f"WHEN h = '{d}' OR h LIKE '%.{d}' THEN '{d}'" for d in H.PLATFORM_BY_HOST) + " END"


@query(
    rf"""
    WITH {_LINKS}, hosts AS (SELECT v, CASE WHEN contains(h, '.') THEN h END AS h FROM (SELECT v, {_sql_host("v")} AS h FROM links)), known AS (SELECT v, h, {_OF_HOST} AS d FROM hosts),
    placed AS (SELECT *, {_case("d", H.PLATFORM_BY_HOST)} AS p FROM known)
    SELECT v, CASE WHEN p IS NOT NULL THEN 'social_handle' WHEN h IS NOT NULL THEN 'domain' END AS kind, p AS platform,
      nullif(CASE p {" ".join(f"WHEN '{p}' THEN trim(regexp_extract(v, '(?i){pattern}', 1))" for p, pattern in H.USER_IN_LINK.items())} END, '') AS user_id, coalesce(d, h) AS host
    FROM placed
    """
)
def link_classes(spark: SparkSession, root: str) -> DataFrame:
    return H.classified_links(_links(spark, root), "v")


_OWN = "EXISTS (SELECT 1 FROM platforms o WHERE o.host IS NOT NULL AND (h = o.host OR ends_with(h, '.' || o.host)))"


def _any_under(domains) -> str:
    return "(" + " OR ".join(f"h = '{d}' OR h LIKE '%.{d}'" for d in domains) + ")"


@query(
    rf"""
    WITH {_LINKS}, hosts AS (SELECT v, {_sql_host("v")} AS h FROM links)
    SELECT v, CASE WHEN NOT contains(h, '.') THEN NULL WHEN {_OWN} THEN 'self_platform' WHEN regexp_matches(v, '{H.DOCUMENT_ENDING}') THEN 'document'
      {" ".join(f"WHEN {_any_under(d)} THEN '{kind}'" for kind, d in H.HOST_KINDS.items())} WHEN {_any_under(SHARED_HOSTS)} THEN 'shared_infra' ELSE 'external' END AS category
    FROM hosts
    """
)
def url_categories(spark: SparkSession, root: str) -> DataFrame:
    own = [r.host for r in table(spark, root, "platforms", "host").where("host IS NOT NULL").collect()]  # one row per platform, whose number is fixed
    return _links(spark, root).select("v", H.url_category(F.col("v"), own, SHARED_HOSTS).alias("category"))


_PAYS = "CASE " + " ".join(f"WHEN h = '{d}' OR h LIKE '%.{d}' THEN '{k}'" for d, k in H.PAYMENT_HOSTS.items()) + " END"
#: One more contact, with every written link.
_PAID = f"(SELECT url, urls, payment_handles FROM contacts UNION ALL SELECT 'written', {'[' + ', '.join(repr(w) for w in WRITTEN) + ']'}, ['cash:$jo'])"


@query(
    rf"""
    WITH c AS (SELECT row_number() OVER () AS r, url, urls, payment_handles FROM {_PAID}), e AS (
      SELECT r, unnest(urls) AS u, unnest(range(len(urls))) AS i FROM c
    ), k AS (
      SELECT r, u, i, {_PAYS} AS kind FROM (SELECT *, {_sql_host("u")} AS h FROM e)
    ), g AS (
      SELECT r, list(u ORDER BY i) FILTER (WHERE kind IS NULL) AS kept, list(kind || ':' || u ORDER BY i) FILTER (WHERE kind IS NOT NULL) AS moved FROM k GROUP BY r
    )
    SELECT url, array_to_string(coalesce(kept, []), ' ') AS kept, array_to_string(list_concat(coalesce(payment_handles, []), coalesce(moved, [])), ' ') AS handles, count(*) AS n_rows FROM c LEFT JOIN g USING (r) GROUP BY ALL
    """
)
def payments_moved(spark: SparkSession, root: str) -> DataFrame:
    """Payment links moved from a contact's links to its payment handles."""
    rows = table(spark, root, "contacts", "url", "urls", "payment_handles").unionByName(spark.createDataFrame([("written", list(WRITTEN), ["cash:$jo"])], "url string, urls array<string>, payment_handles array<string>"))
    moved = H.moved_payments(rows, "urls", "payment_handles")
    return moved.groupBy("url", F.array_join("urls", " ").alias("kept"), F.array_join("payment_handles", " ").alias("handles")).agg(F.count(F.lit(1)).alias("n_rows"))


_HOSTNAME = r"(?:[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?\.)+[a-z]{2,63}"


@query(
    rf"""
    WITH {_LINKS}, h AS (SELECT v, rtrim(trim(regexp_extract(regexp_replace(regexp_replace(lower(trim(v, E' \t\n\r')), '^https?://', ''), '^www\.', ''), '^[^/?#]*', 0)), '.') AS h FROM links)
    SELECT v, h AS host, length(h) BETWEEN 1 AND 253 AND regexp_full_match(h, '{_HOSTNAME}') AS is_host,
      h = '' OR NOT contains(h, '.') OR {_OWN} OR {_any_under(SHARED_HOSTS)} OR h IN {_in(("gmail.com", "mail.com", "patreon.com", "paypal.com", "paypal.me", "cash.app", "linktr.ee"))} AS is_junk FROM h
    """
)
def junk_hosts(spark: SparkSession, root: str) -> DataFrame:
    """Whether a link's host is a well-formed host name, and whether it tells nothing of who runs the page."""
    own = [r.host for r in table(spark, root, "platforms", "host").where("host IS NOT NULL").collect()]  # one row per platform, whose number is fixed
    rows = _links(spark, root).select("v", U.host_checked(F.col("v")).alias("host"))
    return rows.select("v", "host", U.valid_hostname(F.col("host")).alias("is_host"), U.tells_nothing(F.col("host"), own + SHARED_HOSTS, ["gmail.com", "mail.com", "patreon.com", "paypal.com", "paypal.me", "cash.app", "linktr.ee"]).alias("is_junk"))


QUERIES, SQL = query.queries, query.sql
