"""Queries that find, align, nest, merge and audit records, and read what stands in text and markup.

Where the tables lack a form, a query also takes literal rows, and so does its SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import markup as M
from quernstone.functions import url as U
from quernstone.functions import vectorized as V
from quernstone.operators import records as R
from quernstone.plans.base import HOST, NORMALIZED_URL, Registry, sql_of
from quernstone.plans.handles import _in, _values
from quernstone.plans.pages import SHARED_HOSTS
from quernstone.sources.tables import table

query = Registry()


def _with(spark: SparkSession, df: DataFrame, texts) -> DataFrame:
    """The one text column of ``df`` and literal texts, each different text once, nulls left out."""
    return df.toDF("v").unionByName(spark.createDataFrame([(t,) for t in texts], "v string")).where("v IS NOT NULL").distinct()


@query("SELECT ingest_seq, platform, donors_count FROM campaigns WHERE donors_count >= 50 AND platform IS NOT NULL ORDER BY donors_count DESC, ingest_seq LIMIT 100")
def find_campaigns(spark: SparkSession, root: str) -> DataFrame:
    """Filter, projection, order and limit; the limit is the feature."""
    rows = table(spark, root, "campaigns", "ingest_seq", "platform", "donors_count").where("donors_count >= 50 AND platform IS NOT NULL")
    return rows.orderBy(F.desc("donors_count"), "ingest_seq").limit(100)


@query("SELECT campaign_status AS value, count(*) AS n_rows, min(ingest_seq) AS first_row FROM campaigns GROUP BY campaign_status")
def distinct_statuses(spark: SparkSession, root: str) -> DataFrame:
    """The distinct values of a field, how many rows have each, and the first row that does."""
    return table(spark, root, "campaigns", "ingest_seq", "campaign_status").groupBy(F.col("campaign_status").alias("value")).agg(F.count(F.lit(1)).alias("n_rows"), F.min("ingest_seq").alias("first_row"))


_SCORED = ("url", "platform", "title", "description", "organizer", "organizer_url", "location", "goal_amount", "raised_amount", "created_date")


@query(
    f"""
    WITH s AS (SELECT ingest_seq, url, {sql_of(NORMALIZED_URL, "url")} AS norm, {" + ".join(f"CAST({c} IS NOT NULL AS INT)" for c in _SCORED)} AS score FROM campaigns)
    SELECT ingest_seq, url, norm FROM (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY score DESC, url, ingest_seq) AS r FROM s) WHERE r = 1 ORDER BY ingest_seq
    """
)
def dedupe_in_order(spark: SparkSession, root: str) -> DataFrame:
    """The fullest row of every page, in load order again."""
    rows = table(spark, root, "campaigns", "ingest_seq", *_SCORED)
    score = sum((F.col(c).isNotNull().cast("int") for c in _SCORED[1:]), F.col(_SCORED[0]).isNotNull().cast("int"))
    rows = rows.select("ingest_seq", "url", U.normalize_url(F.col("url")).alias("norm"), score.alias("score"))
    first = rows.groupBy("norm").agg(F.min(F.struct(-F.col("score"), F.coalesce("url", F.lit("￿")), "ingest_seq", "url")).alias("b"))
    return first.select("b.ingest_seq", "b.url", "norm").orderBy("ingest_seq")


@query(
    """
    WITH p AS (SELECT platform, count(*) AS n_rows, round(avg(CASE WHEN organizer IS NULL THEN 1.0 ELSE 0.0 END), 6) AS rate FROM campaigns GROUP BY platform)
    SELECT platform, n_rows, rate, CAST(row_number() OVER (ORDER BY rate DESC, n_rows, platform NULLS LAST) AS INT) AS place FROM p
    """
)
def sorted_platforms(spark: SparkSession, root: str) -> DataFrame:
    """Platforms by share of rows without organizer (falling), then size (rising), then name (nulls last); one row per platform is ordered, not the campaigns."""
    rows = table(spark, root, "campaigns", "platform", "organizer").groupBy("platform").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg(F.when(F.col("organizer").isNull(), 1.0).otherwise(0.0)), 6).alias("rate"))
    return rows.withColumn("place", F.row_number().over(Window.orderBy(F.desc("rate"), "n_rows", F.asc_nulls_last("platform"))))


@query(
    """
    SELECT source, category, platform, count(*) AS n_rows FROM (
      SELECT 'takedown' AS source, category, NULL AS platform FROM takedown_status UNION ALL SELECT 'campaign', NULL, platform FROM campaigns
    ) GROUP BY ALL
    """
)
def aligned_rows(spark: SparkSession, root: str) -> DataFrame:
    """Rows of tables with different columns, one after the other, what a table lacks being null."""
    first = table(spark, root, "takedown_status", "category").withColumn("source", F.lit("takedown"))
    second = table(spark, root, "campaigns", "platform").withColumn("source", F.lit("campaign"))
    return first.unionByName(second, allowMissingColumns=True).groupBy("source", "category", "platform").agg(F.count(F.lit(1)).alias("n_rows"))


#: Names as old records hold them.
NAMES = ("{'name': 'A. Bé Doe', 'country': None}", "{\"name\": \"Jo  Doe\"}", "nan", "N/A", "ab", "  The  O'Neil Fund ", "{'name': 'nan'}", "")

_NAME = r"regexp_extract(trim(v), '[''\"]name[''\"]\s*:\s*[''\"](.+?)[''\"]\s*[,}]', 1)"


@query(
    f"""
    WITH w AS (SELECT DISTINCT v FROM (SELECT organizer AS v FROM campaigns UNION ALL SELECT * FROM {_values(NAMES)} x(v)) WHERE v IS NOT NULL),
    p AS (SELECT v, CASE WHEN starts_with(trim(v), '{{') AND {_NAME} <> '' THEN {_NAME} ELSE trim(v) END AS plain FROM w),
    k AS (SELECT v, plain, regexp_replace(regexp_replace(trim(lower(plain)), '[^a-z0-9\\s]', '', 'g'), '\\s+', ' ', 'g') AS key FROM p)
    SELECT v, CASE WHEN lower(trim(plain)) NOT IN ('', 'nan', 'none', 'null', 'n/a', 'na') AND length(key) >= 3 THEN key END AS key FROM k
    """
)
def legacy_name_keys(spark: SparkSession, root: str) -> DataFrame:
    return _with(spark, table(spark, root, "campaigns", "organizer"), NAMES).select("v", M.legacy_name_key(F.col("v")).alias("key"))


#: Texts of fundraising widgets.
WIDGETS = (
    "US$1,250.50 raised of US$5,000 goal - 31 Donors", "€ 20 raised of 400 goal", "£3,000 Donated So Far by 1 donor", "$10 raised of $20 goal", "ca$7 raised of ca$9 goal", "₹1,00,000 Donated so far", "12 donors", "raised of goal",
)
_SIGNS = "CASE upper(s) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in M.CURRENCY_OF_SIGN.items()) + " END"


def _sql_number(pattern: str, i: int) -> str:
    return f"try_cast(nullif(replace(regexp_extract(v, '{pattern}', {i}), ',', ''), '') AS DOUBLE)"


@query(
    f"""
    WITH w AS (SELECT DISTINCT v FROM (SELECT description AS v FROM campaigns UNION ALL SELECT * FROM {_values(WIDGETS)} x(v)) WHERE v IS NOT NULL),
    f AS (SELECT v, regexp_matches(v, '{M.RAISED_OF_GOAL}') AS whole FROM w),
    g AS (SELECT *, CASE WHEN whole THEN regexp_extract(v, '{M.RAISED_OF_GOAL}', 1) ELSE regexp_extract(v, '{M.DONATED}', 1) END AS s FROM f)
    SELECT md5(v) AS text_md5, {_sql_number(M.RAISED_OF_GOAL, 3)} AS goal, CASE WHEN whole THEN {_sql_number(M.RAISED_OF_GOAL, 2)} ELSE {_sql_number(M.DONATED, 2)} END AS raised, {_SIGNS} AS currency,
      try_cast(nullif(regexp_extract(v, '{M.DONORS}', 1), '') AS INT) AS donors FROM g
    """
)
def widget_amounts(spark: SparkSession, root: str) -> DataFrame:
    """What the descriptions, and the literal texts, say was asked for and given."""
    rows = _with(spark, table(spark, root, "campaigns", "description"), WIDGETS)
    return rows.select(F.md5("v").alias("text_md5"), M.widget_amounts(F.col("v")).alias("w")).select("text_md5", "w.*")


@query("SELECT ingest_seq, substr(description, 1, 500) AS head, substr(description, greatest(length(description) - 99, 1), 100) AS tail, substr(description, 101, 50) AS middle FROM campaigns")
def truncated_texts(spark: SparkSession, root: str) -> DataFrame:
    """The first 500, the last 100 and 50 inner characters of every text; cutting is the feature."""
    d = F.col("description")
    return table(spark, root, "campaigns", "ingest_seq", "description").select(
        "ingest_seq", F.substring(d, 1, 500).alias("head"), F.substring(d, F.greatest(F.length(d) - 99, F.lit(1)), F.lit(100)).alias("tail"), F.substring(d, 101, 50).alias("middle")
    )


@query(
    r"""
    WITH f AS (SELECT ingest_seq, description, regexp_extract(organizer, '[\p{L}]{3,}', 0) AS word FROM campaigns WHERE description IS NOT NULL AND organizer IS NOT NULL),
    p AS (SELECT *, CASE WHEN word = '' THEN 0 ELSE strpos(lower(description), lower(word)) END AS pos FROM f)
    SELECT ingest_seq, word, CASE WHEN pos > 0 THEN trim(translate(substr(description, greatest(pos - 60, 1), length(word) + 60 + least(pos - 1, 60)), chr(10) || chr(13), '  ')) ELSE '' END AS snippet FROM p
    """
)
def snippets(spark: SparkSession, root: str) -> DataFrame:
    """What stands around the organizer's first word in the description."""
    rows = table(spark, root, "campaigns", "ingest_seq", "description", "organizer").where("description IS NOT NULL AND organizer IS NOT NULL")
    rows = rows.withColumn("word", F.regexp_extract("organizer", r"[\p{L}]{3,}", 0))
    return rows.select("ingest_seq", "word", M.snippet(F.col("description"), F.col("word")).alias("snippet"))


@query(
    rf"""
    WITH d AS (SELECT ingest_seq, description AS t, regexp_extract_all(description, '{M.EMAIL}') AS f, regexp_split_to_array(description, '{M.EMAIL}') AS gaps FROM campaigns WHERE description IS NOT NULL),
    e AS (SELECT ingest_seq, t, f, gaps, unnest(range(1, len(f) + 1)) AS i FROM d),
    p AS (SELECT *, 1 + list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda g: length(g))), 0) AS pos FROM e)
    SELECT ingest_seq, f[i] AS found, CAST(pos AS INT) AS place, substr(t, CAST(greatest(pos - 80, 1) AS BIGINT), CAST(length(f[i]) + 120 + least(pos - 1, 80) AS BIGINT)) AS context FROM p
    """
)
def contact_contexts(spark: SparkSession, root: str) -> DataFrame:
    """Every mail address of a description with its place and what stands around it."""
    rows = table(spark, root, "campaigns", "ingest_seq", "description").select("ingest_seq", F.explode(M.contexts(F.col("description"), M.EMAIL)).alias("c"))
    return rows.select("ingest_seq", "c.found", "c.place", "c.context")


@query(
    """
    WITH texts AS (SELECT url, arg_max(coalesce(title, '') || ' ' || coalesce(description, ''), ingest_seq) AS t FROM campaigns WHERE url IS NOT NULL GROUP BY url),
    h AS (SELECT DISTINCT url, h FROM (SELECT url, unnest(list_concat(coalesce(payment_handles, []), coalesce(social_handles, []))) AS h FROM contacts WHERE url IS NOT NULL) WHERE h IS NOT NULL),
    p AS (SELECT url, h, lower(coalesce(t, '')) AS low, lower(ltrim(h, '@')) AS core FROM h LEFT JOIN texts USING (url)),
    q AS (SELECT *, strpos(low, core) AS pos FROM p)
    SELECT url, h AS handle, CASE WHEN starts_with(h, '@') THEN pos = 0 OR contains(substr(low, greatest(pos - 100, 1), length(core) + 100 + least(pos - 1, 100)), 'insta') ELSE strpos(low, lower(h)) = 0 END AS is_invented FROM q
    """
)
def invented_handles(spark: SparkSession, root: str) -> DataFrame:
    """Which extracted handles do not stand in their page's text, or stand there as a name of another network."""
    text = F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("description", F.lit("")))
    texts = table(spark, root, "campaigns", "url", "title", "description", "ingest_seq").where("url IS NOT NULL").groupBy("url").agg(F.max_by(text, "ingest_seq").alias("t"))
    empty = F.array().cast("array<string>")
    both = F.concat(F.coalesce("payment_handles", empty), F.coalesce("social_handles", empty))
    handles = table(spark, root, "contacts", "url", "payment_handles", "social_handles").where("url IS NOT NULL").select("url", F.explode(both).alias("handle")).where("handle IS NOT NULL").distinct()
    return handles.join(texts, "url", "left").select("url", "handle", M.invented(F.col("handle"), F.col("t")).alias("is_invented"))


#: Pages as they come from the web.
PAGES = (
    '<html><head><meta property="og:description" content="Help Jo"></head><body>x</body></html>', "<body><main class='a'>Main <b>text</b> mail a@b.example.org</main><article>no</article></body>",
    "<body>\n<article>Only\nthis</article> <a href=\"https://www.Jo.example.org/x?y=1\">l</a></body>", '<BODY id="b">Body <a class="c" href=\'http://spotnest.example/c\'>p</a> <a href="/rel">r</a></BODY>', "no markup", "",
)


def _sql_part(tag: str) -> str:
    return rf"nullif(trim(regexp_replace(regexp_replace(regexp_extract(v, '(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), '')"


@query(
    rf"""
    WITH w AS (SELECT DISTINCT v FROM (SELECT '<body><main>' || title || '</main></body>' AS v FROM campaigns WHERE title IS NOT NULL AND NOT regexp_matches(title, '[&<>]') UNION ALL SELECT * FROM {_values(PAGES)} x(v))),
    m AS (SELECT v, regexp_extract(v, '(?is)<meta[^>]*property=["'']og:description["''][^>]*>', 0) AS meta, list_transform(regexp_extract_all(v, '(?i)<a\s[^>]*?href=["''](https?://[^"'']+)["'']', 1), lambda u: {sql_of(HOST, "u")}) AS hosts FROM w)
    SELECT md5(v) AS page_md5, coalesce(nullif(regexp_extract(meta, '(?is)content=["'']([^"'']*)["'']', 1), ''), {_sql_part("main")}, {_sql_part("article")}, {_sql_part("body")}, '') AS description,
      array_to_string(regexp_extract_all(v, '{M.EMAIL}'), ' ') AS emails, array_to_string(list_filter(hosts, lambda h: NOT (h IN {_in(SHARED_HOSTS)})), ' ') AS hosts FROM m
    """
)
def page_entities(spark: SparkSession, root: str) -> DataFrame:
    """A page's own description, the mail addresses in it and the hosts it links to, shared ones left out."""
    titles = table(spark, root, "campaigns", "title").where("title IS NOT NULL AND NOT title RLIKE '[&<>]'").select(F.concat(F.lit("<body><main>"), "title", F.lit("</main></body>")))
    rows = _with(spark, titles, PAGES)
    hosts = F.filter(F.transform(M.link_targets(F.col("v")), U.host_enriched), lambda h: ~U.under_any(h, SHARED_HOSTS))
    return rows.select(
        F.md5("v").alias("page_md5"), M.page_description(F.col("v")).alias("description"), F.array_join(F.regexp_extract_all("v", F.lit(f"({M.EMAIL})"), 1), " ").alias("emails"), F.array_join(hosts, " ").alias("hosts")
    )


_LAST = "SELECT url, arg_max(platform, ingest_seq) AS platform, max(ingest_seq) AS last_seq FROM campaigns WHERE url IS NOT NULL AND platform IS NOT NULL GROUP BY url"


@query(
    f"""
    WITH c AS ({_LAST}), m AS (SELECT url, sum(len(emails)) AS n_emails FROM contacts WHERE url IS NOT NULL GROUP BY url),
    f AS (SELECT url, string_agg(DISTINCT cluster_id || ':' || coalesce(fired_signals, ''), '|' ORDER BY cluster_id || ':' || coalesce(fired_signals, '')) AS flags FROM detector_d_flags WHERE url IS NOT NULL AND cluster_id IS NOT NULL GROUP BY url),
    t AS (SELECT url, max(checked_at) AS checked_at, arg_max_null(category, checked_at) AS category FROM (SELECT url, checked_at, max(category) AS category FROM takedown_status WHERE url IS NOT NULL AND checked_at IS NOT NULL GROUP BY url, checked_at) GROUP BY url)
    SELECT c.url, platform, last_seq, CAST(coalesce(n_emails, 0) AS BIGINT) AS n_emails, coalesce(flags, '') AS flags, category FROM c LEFT JOIN m USING (url) LEFT JOIN f USING (url) LEFT JOIN t USING (url)
    """
)
def nested_pages(spark: SparkSession, root: str) -> DataFrame:
    """One record per page, with its contacts, its flags as a sorted list and its last check, shown flat."""
    pages = R.nested_record(
        table(spark, root, "campaigns", "url", "platform", "ingest_seq").where("platform IS NOT NULL").groupBy("url").agg(F.max_by("platform", "ingest_seq").alias("platform"), F.max("ingest_seq").alias("last_seq")),
        "url",
        {
            "contacts": table(spark, root, "contacts", "url", F.size("emails").alias("n")).where("n >= 0"),
            "flags": table(spark, root, "detector_d_flags", "url", F.concat("cluster_id", F.lit(":"), F.coalesce("fired_signals", F.lit(""))).alias("flag")).where("flag IS NOT NULL").distinct(),
            "checks": table(spark, root, "takedown_status", "checked_at", "category", "url").where("checked_at IS NOT NULL"),
        },
    )
    emails = F.aggregate("contacts", F.lit(0).cast("long"), lambda s, c: s + c["n"])
    last = F.array_max(F.transform("checks", lambda c: F.struct(c["checked_at"].alias("checked_at"), c["category"].alias("category"))))
    return pages.select("url", "platform", "last_seq", emails.alias("n_emails"), F.array_join(F.transform("flags", lambda f: f["flag"]), "|").alias("flags"), last["category"].alias("category"))


#: Hosts that two literal pages name, so that verdicts join them.
_NAMED = "SELECT DISTINCT lower(trim(domain)) AS domain FROM domain_verdicts WHERE domain IS NOT NULL"


@query(
    f"""
    WITH worst AS (SELECT lower(trim(domain)) AS domain, max(coalesce(vt_malicious, 0) + coalesce(vt_suspicious, 0)) AS hits FROM domain_verdicts WHERE domain IS NOT NULL GROUP BY 1),
    named AS (SELECT 'page-' || length(domain) AS url, domain FROM ({_NAMED}) UNION SELECT 'page-' || length(domain), 'spotnest.example' FROM ({_NAMED})
      UNION SELECT url, {sql_of(HOST, "u")} FROM (SELECT url, unnest(urls) AS u FROM contacts WHERE url IS NOT NULL) WHERE u IS NOT NULL)
    SELECT url, count(*) AS n_domains, count(*) FILTER (WHERE hits >= 1) AS n_bad, count(*) FILTER (WHERE hits >= 1 AND length(domain) <= 23) AS n_bad_kept, max(hits) AS most_hits FROM named LEFT JOIN worst USING (domain) GROUP BY url
    """
)
def reputation_totals(spark: SparkSession, root: str) -> DataFrame:
    """Bad verdicts per page, over all its domains and over those that are no shared ones; pages named after the lengths of the verdicts' domains stand beside the contacts, so that verdicts join."""
    verdicts = table(spark, root, "domain_verdicts", "domain", "vt_malicious", "vt_suspicious").where("domain IS NOT NULL").withColumn("domain", F.lower(F.trim("domain")))
    hits = F.coalesce("vt_malicious", F.lit(0)) + F.coalesce("vt_suspicious", F.lit(0))
    worst = verdicts.groupBy("domain").agg(F.max(hits).alias("hits"))
    page = F.concat(F.lit("page-"), F.length("domain").cast("string"))
    cited = table(spark, root, "contacts", "url", "urls").where("url IS NOT NULL").select("url", F.explode("urls").alias("u")).where("u IS NOT NULL").select("url", U.host_enriched(F.col("u")).alias("domain"))
    named = worst.select(page.alias("url"), F.explode(F.array("domain", F.lit("spotnest.example"))).alias("domain")).unionByName(cited).distinct()
    return R.verdict_totals(named, "url", "domain", worst, F.length("domain") > 23)


@query(
    """
    WITH v AS (SELECT url, 'email' AS kind, lower(trim(unnest(emails))) AS value FROM contacts WHERE url IS NOT NULL UNION ALL SELECT url, 'phone', lower(trim(unnest(phones))) FROM contacts WHERE url IS NOT NULL),
    c AS (SELECT url, arg_max(platform, ingest_seq) AS platform, arg_max(organizer, ingest_seq) AS organizer FROM campaigns WHERE url IS NOT NULL GROUP BY url),
    g AS (SELECT kind, value, count(DISTINCT v.url) AS n_pages, count(DISTINCT platform) AS n_platforms, count(DISTINCT organizer) AS n_organizers FROM v LEFT JOIN c USING (url) WHERE value IS NOT NULL GROUP BY kind, value)
    SELECT *, CAST(rank() OVER (PARTITION BY kind ORDER BY n_pages DESC, n_platforms DESC, n_organizers DESC) AS INT) AS place FROM g WHERE n_pages >= 2
    """
)
def recurrence_ranked(spark: SparkSession, root: str) -> DataFrame:
    """Contacts met on several pages, ranked by pages, platforms and organizers."""
    contacts = table(spark, root, "contacts", "url", "emails", "phones").where("url IS NOT NULL")
    values = lambda kind, c: contacts.select("url", F.lit(kind).alias("kind"), F.explode(c).alias("x")).select("url", "kind", F.lower(F.trim("x")).alias("value"))
    owners = table(spark, root, "campaigns", "url", "platform", "organizer", "ingest_seq").where("url IS NOT NULL").groupBy("url").agg(F.max_by("platform", "ingest_seq").alias("platform"), F.max_by("organizer", "ingest_seq").alias("organizer"))
    met = values("email", "emails").unionByName(values("phone", "phones")).where("value IS NOT NULL").join(owners, "url", "left")
    counts = met.groupBy("kind", "value").agg(F.count_distinct("url").alias("n_pages"), F.count_distinct("platform").alias("n_platforms"), F.count_distinct("organizer").alias("n_organizers")).where("n_pages >= 2")
    # Many values tie, so ranks are those of the few different states, numbered among themselves.
    states = counts.groupBy("kind", "n_pages", "n_platforms", "n_organizers").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("kind").orderBy(F.desc("n_pages"), F.desc("n_platforms"), F.desc("n_organizers")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = states.withColumn("place", (before + 1).cast("int")).drop("n")
    return counts.join(placed, ["kind", "n_pages", "n_platforms", "n_organizers"]).select("kind", "value", "n_pages", "n_platforms", "n_organizers", "place")


@query(
    """
    SELECT url, array_to_string(list_filter(coalesce(urls, []), lambda u: NOT contains(u, 'a')), ' ') AS kept, array_to_string(coalesce(urls, []), ' ') AS restored, count(*) AS n_rows FROM contacts GROUP BY ALL
    """
)
def backed_up_links(spark: SparkSession, root: str) -> DataFrame:
    """A field rewritten twice with one backup of what it was first, and restored from it."""
    rows = table(spark, root, "contacts", "url", "urls").withColumn("urls", F.coalesce("urls", F.array().cast("array<string>")))
    once = R.rewritten(rows, "urls", lambda c: F.filter(c, lambda u: ~u.contains("a")))
    twice = R.rewritten(once, "urls", lambda c: F.filter(c, lambda u: ~u.contains("a")))
    return twice.groupBy("url", F.array_join("urls", " ").alias("kept"), F.array_join("urls_raw", " ").alias("restored")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    """
    WITH s AS (SELECT url, arg_max(title, ingest_seq) AS title, arg_max(location, ingest_seq) AS location FROM campaigns WHERE ingest_seq % 2 = 0 AND url IS NOT NULL GROUP BY url),
    r AS (SELECT url, arg_max(location, ingest_seq) AS location, arg_max(end_date, ingest_seq) AS end_date FROM campaigns WHERE ingest_seq % 2 = 1 AND url IS NOT NULL GROUP BY url)
    SELECT s.url, title, coalesce(r.location, s.location) AS location, r.end_date FROM s LEFT JOIN r ON s.url = r.url
    """
)
def enriched_pages(spark: SparkSession, root: str) -> DataFrame:
    """Fields of a second scrape put over the first where they are present, only for pages that are known; the two are told apart by the parity of their sequence number."""
    rows = table(spark, root, "campaigns", "url", "title", "location", "end_date", "ingest_seq").where("url IS NOT NULL")
    # max_by passes over nulls in the order alone, so the last present value needs its own filter.
    last = lambda df, *c: df.groupBy("url").agg(*[F.max_by(x, F.when(F.col(x).isNotNull(), F.col("ingest_seq"))).alias(x) for x in c])
    known = last(rows.where("ingest_seq % 2 = 0"), "title", "location")
    rich = last(rows.where("ingest_seq % 2 = 1"), "location", "end_date")
    return R.merged(known, rich.join(known, "url", "left_semi"), "url").select("url", "title", "location", "end_date")


@query(
    """
    WITH n AS (SELECT lower(trim(domain)) AS domain, max(vt_malicious) AS vt_malicious, count(*) AS n_lookups FROM domain_verdicts WHERE domain IS NOT NULL GROUP BY 1),
    old AS (SELECT domain FROM n WHERE length(domain) % 2 = 0)
    SELECT n.domain, vt_malicious, n_lookups, CASE WHEN old.domain IS NULL THEN 'appended' ELSE 'kept' END AS outcome FROM n LEFT JOIN old USING (domain)
    """
)
def merged_verdicts(spark: SparkSession, root: str) -> DataFrame:
    """Verdicts from outside folded into the cache: domains that it has (those of even length stand for it) stay, others are appended."""
    rows = table(spark, root, "domain_verdicts", "domain", "vt_malicious").where("domain IS NOT NULL").withColumn("domain", F.lower(F.trim("domain")))
    folded = rows.groupBy("domain").agg(F.max("vt_malicious").alias("vt_malicious"), F.count(F.lit(1)).alias("n_lookups"))
    cache = folded.where(F.length("domain") % 2 == 0)
    return cache.withColumn("outcome", F.lit("kept")).unionByName(R.pending(folded, cache, "domain").withColumn("outcome", F.lit("appended")))


@query(
    f"""
    WITH h AS (SELECT {sql_of(HOST, "u")} AS host, url FROM (SELECT url, unnest(urls) AS u FROM contacts WHERE url IS NOT NULL) WHERE u IS NOT NULL),
    q AS (SELECT host, count(DISTINCT url) AS n_pages, min(url) AS example FROM h WHERE host <> '' GROUP BY host)
    SELECT *, host IN (SELECT lower(trim(domain)) FROM domain_verdicts WHERE domain IS NOT NULL) AS is_known FROM q ORDER BY is_known, n_pages DESC, host
    """
)
def domain_queue(spark: SparkSession, root: str) -> DataFrame:
    """The domains still to be looked up first, then by pages that name them, then by name."""
    cited = table(spark, root, "contacts", "url", "urls").where("url IS NOT NULL").select("url", F.explode("urls").alias("u")).where("u IS NOT NULL").select("url", U.host_enriched(F.col("u")).alias("host")).where("host <> ''")
    known = table(spark, root, "domain_verdicts", "domain").where("domain IS NOT NULL").select(F.lower(F.trim("domain")).alias("host")).distinct().withColumn("is_known", F.lit(True))
    queue = cited.groupBy("host").agg(F.count_distinct("url").alias("n_pages"), F.min("url").alias("example"))
    return queue.join(known, "host", "left").select("host", "n_pages", "example", F.coalesce("is_known", F.lit(False)).alias("is_known")).orderBy("is_known", F.desc("n_pages"), "host")


#: Account numbers, some with an error, of countries with different lengths.
ACCOUNTS = (
    "DE89370400440532013000", "GB82 WEST 1234 5698 7654 32", "BR1800360305000010009795493C1", "AE070331234567890123456", "SA0380000000608010167519", "PK36SCBL0000001123456702", "FR1420041010050500013M02606",
    "DE89370400440532013001", "GB82WEST123456987654", "XX89370400440532013000", "not an account",
)
_LENGTHS = "CASE substr(a, 1, 2) " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in V.IBAN_LENGTHS.items()) + " ELSE -1 END"


@query(
    rf"""
    WITH w AS (SELECT DISTINCT v FROM (SELECT unnest(payment_handles) AS v FROM contacts UNION ALL SELECT * FROM {_values(ACCOUNTS)} x(v)) WHERE v IS NOT NULL), n AS (SELECT v, replace(upper(trim(v)), ' ', '') AS a FROM w),
    d AS (SELECT v, a, list_transform(regexp_extract_all(substr(a, 5) || substr(a, 1, 4), '.'), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END) AS digits FROM n)
    SELECT v, regexp_full_match(a, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+') AND length(a) = {_LENGTHS} AND list_reduce(list_prepend(0, digits), lambda s, x: (s * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1 AS is_account FROM d
    """
)
def account_numbers(spark: SparkSession, root: str) -> DataFrame:
    """Which payment handles are account numbers of the right length and checksum."""
    rows = _with(spark, table(spark, root, "contacts", "payment_handles").select(F.explode("payment_handles")), ACCOUNTS)
    return rows.select("v", F.coalesce(V.checksum_kind("v") == "iban", F.lit(False)).alias("is_account"))


#: Numbers as people write them.
PHONES = ("0049 30 901820", "+44 20 7946 0958", "030 901820", "06 12 34 56 78", "1 (212) 555-0100", "12345", "5511987654321", "000")
_FULL = "|".join(f"{code}[0-9]{{{lo},{hi}}}" for code, lo, hi in sorted(set(M.NUMBERING.values())))
_REGIONS = ("DE", "FR", "US")


@query(
    rf"""
    WITH w AS (SELECT DISTINCT v FROM (SELECT unnest(phones) AS v FROM contacts UNION ALL SELECT * FROM {_values(PHONES)} x(v)) WHERE v IS NOT NULL), d AS (SELECT v, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM w),
    n AS (SELECT v, d, ltrim(d, '0') AS n, CASE WHEN starts_with(d, '00') AND length(d) >= 10 AND regexp_full_match(substr(d, 3, 30), '{_FULL}') THEN substr(d, 3, 30) WHEN regexp_full_match(d, '{_FULL}') THEN d END AS whole FROM d)
    SELECT v, CASE WHEN length(d) >= 7 THEN '+' || coalesce(whole, CASE {" ".join(f"WHEN length(n) BETWEEN {M.NUMBERING[r][1]} AND {M.NUMBERING[r][2]} THEN '{M.NUMBERING[r][0]}' || n" for r in _REGIONS)} END) END AS e164 FROM n
    """
)
def phones_e164(spark: SparkSession, root: str) -> DataFrame:
    rows = _with(spark, table(spark, root, "contacts", "phones").select(F.explode("phones")), PHONES)
    return rows.select("v", M.e164(F.col("v"), F.array(*[F.lit(r) for r in _REGIONS])).alias("e164"))


@query(
    f"""
    WITH c AS ({_LAST}), o AS (SELECT url, arg_max(organizer, ingest_seq) AS organizer FROM campaigns WHERE url IS NOT NULL AND platform IS NOT NULL GROUP BY url),
    m AS (SELECT url, sum(coalesce(len(emails), 0)) AS n_emails, sum(coalesce(len(phones), 0)) AS n_phones FROM contacts WHERE url IS NOT NULL GROUP BY url), n AS (SELECT organizer, count(*) AS n FROM o WHERE organizer IS NOT NULL GROUP BY organizer),
    f AS (SELECT url, count(DISTINCT cluster_id) AS n_clusters, max(coalesce(flag, 0)) AS flag FROM detector_d_flags WHERE url IS NOT NULL GROUP BY url)
    SELECT c.url, platform, CAST(coalesce(n_emails, 0) AS BIGINT) AS n_emails, CAST(coalesce(n_phones, 0) AS BIGINT) AS n_phones, coalesce(n_clusters, 0) AS n_clusters, coalesce(flag, 0) AS flag, coalesce(n - 1, 0) AS n_siblings
    FROM c JOIN o USING (url) LEFT JOIN n USING (organizer) LEFT JOIN m ON m.url = c.url LEFT JOIN f ON f.url = c.url
    """
)
def page_reports(spark: SparkSession, root: str) -> DataFrame:
    """What is known of every page in one row: contacts, clusters, flag, and how many pages its organizer has besides."""
    rows = table(spark, root, "campaigns", "url", "platform", "organizer", "ingest_seq").where("url IS NOT NULL AND platform IS NOT NULL")
    pages = rows.groupBy("url").agg(F.max_by("platform", "ingest_seq").alias("platform"), F.max_by("organizer", F.when(F.col("organizer").isNotNull(), F.col("ingest_seq"))).alias("organizer"))
    owned = pages.where("organizer IS NOT NULL").groupBy("organizer").agg(F.count(F.lit(1)).alias("n"))
    size = lambda c: F.sum(F.greatest(F.size(c), F.lit(0))).alias(f"n_{c}")
    contacts = table(spark, root, "contacts", "url", "emails", "phones").where("url IS NOT NULL").groupBy("url").agg(size("emails"), size("phones"))
    flags = table(spark, root, "detector_d_flags", "url", "cluster_id", "flag").where("url IS NOT NULL").groupBy("url").agg(F.count_distinct("cluster_id").alias("n_clusters"), F.max(F.coalesce("flag", F.lit(0))).alias("flag"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    known = R.hot_side_join(pages, owned, "organizer").join(contacts, "url", "left").join(flags, "url", "left")
    return known.select("url", "platform", zero("n_emails"), zero("n_phones"), zero("n_clusters"), zero("flag"), F.coalesce(F.col("n") - 1, F.lit(0)).alias("n_siblings"))


QUERIES, SQL = query.queries, query.sql
