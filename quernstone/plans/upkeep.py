"""Queries that tag, repair, merge and audit nested records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import contact as C
from quernstone.functions import nested as N
from quernstone.functions import text as T
from quernstone.functions import url as U
from quernstone.operators import fuzzy
from quernstone.operators import identity as I
from quernstone.operators import records as R
from quernstone.plans import links, reports
from quernstone.plans.base import AMOUNT, HOST, PRESENT, Registry, sql_of
from quernstone.sources.tables import table

query = Registry()

#: Mail hosts that anyone can have an address at, as the tables have them.
OPEN_MAIL = ["mail.example.com", "post.example.com"]
#: How platform texts begin.
PLATFORM_TEXT = ["this page is run by", "powered by", "all rights reserved"]
#: Dollars for one unit (fixed values of the report; an unknown currency counts as dollars).
RATES = {"USD": 1.0, "EUR": 1.1, "GBP": 1.25, "CAD": 0.75, "AUD": 0.65, "CHF": 1.1, "BRL": 0.2}


@query("SELECT url, count(*) AS n_rows FROM contacts WHERE url IS NOT NULL GROUP BY url HAVING count(*) > 1")
def key_violations(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "contacts", "url").where("url IS NOT NULL").groupBy("url").agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


@query(
    """
    WITH wanted AS (SELECT DISTINCT url FROM takedown_status)
    SELECT url, bool_or(coalesce(description_word_count, 0) >= 100) AS is_long, CAST(count(*) AS BIGINT) AS n_rows FROM campaigns WHERE url IN (SELECT url FROM wanted) GROUP BY url
    """
)
def exact_selection(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "campaigns", "url", "description_word_count").join(table(spark, root, "takedown_status", "url"), "url", "left_semi")
    return rows.groupBy("url").agg(F.bool_or(F.coalesce("description_word_count", F.lit(0)) >= 100).alias("is_long"), F.count(F.lit(1)).alias("n_rows"))


@query(
    """
    WITH e AS (SELECT url, lower(trim(unnest(emails))) AS e, unnest(range(len(emails))) AS i FROM contacts WHERE url IS NOT NULL)
    SELECT url, count(*) FILTER (WHERE split_part(e, '@', 2) IN ('mail.example.com', 'post.example.com')) AS n_open, bool_or(split_part(e, '@', 2) IN ('mail.example.com', 'post.example.com')) AS has_open,
      min(e) FILTER (WHERE split_part(e, '@', 2) IN ('mail.example.com', 'post.example.com')) AS first_open
    FROM e WHERE e IS NOT NULL GROUP BY url
    """
)
def open_mail(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "contacts", "url", "emails").where("url IS NOT NULL").select("url", F.explode("emails").alias("x")).select("url", F.lower(F.trim("x")).alias("e")).where("e IS NOT NULL")
    is_open = F.split_part("e", F.lit("@"), F.lit(2)).isin(*OPEN_MAIL)
    return e.groupBy("url").agg(F.count_if(is_open).alias("n_open"), F.bool_or(is_open).alias("has_open"), F.min(F.when(is_open, F.col("e"))).alias("first_open"))


_RATES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in RATES.items())


@query(
    f"""
    WITH m AS (SELECT platform, {sql_of(AMOUNT, "raised_amount")} * CASE upper(trim(currency)) {_RATES} ELSE 1.0 END AS usd FROM campaigns)
    SELECT platform, round(median(usd), 4) AS median_usd, round(max(usd), 4) AS max_usd, round(sum(usd), 2) AS total_usd, count(*) AS n_rows FROM m WHERE usd IS NOT NULL AND platform IS DISTINCT FROM 'SpotNest' GROUP BY platform
    """
)
def usd_summary(spark: SparkSession, root: str) -> DataFrame:
    rates = F.create_map(*[F.lit(x) for pair in RATES.items() for x in pair])
    rows = table(spark, root, "campaigns", "platform", "raised_amount", "currency")
    usd = T.amount(F.col("raised_amount")) * F.coalesce(rates[F.upper(F.trim("currency"))], F.lit(1.0))
    rows = rows.select("platform", usd.alias("usd")).where(F.col("usd").isNotNull() & ~F.col("platform").eqNullSafe("SpotNest"))
    return rows.groupBy("platform").agg(
        F.round(F.median("usd"), 4).alias("median_usd"), F.round(F.max("usd"), 4).alias("max_usd"), F.round(F.sum("usd"), 2).alias("total_usd"), F.count(F.lit(1)).alias("n_rows")
    )


@query(
    """
    SELECT url, CAST(i AS INT) AS place, e AS email, p AS phone FROM (
      SELECT url, unnest(range(greatest(coalesce(len(emails), 0), coalesce(len(phones), 0)))) AS i, emails, phones FROM contacts WHERE url IS NOT NULL
    ) x, LATERAL (SELECT emails[i + 1] AS e, phones[i + 1] AS p) y
    """
)
def zipped_arrays(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "contacts", "url", "emails", "phones").where("url IS NOT NULL")
    # A null list is as an empty one: the other side is padded with nulls.
    side = lambda c: F.coalesce(c, F.array().cast("array<string>")).alias(c)
    return rows.select("url", side("emails"), side("phones")).select("url", F.posexplode(F.arrays_zip("emails", "phones")).alias("place", "z")).select("url", "place", F.col("z.emails").alias("email"), F.col("z.phones").alias("phone"))


@query(
    f"""
    WITH c AS (SELECT row_number() OVER () AS r, url, urls FROM contacts WHERE url IS NOT NULL), d AS (
      SELECT r, url, {sql_of(HOST, "u")} AS host FROM (SELECT r, url, unnest(urls) AS u FROM c)
    ), own AS (SELECT host FROM platforms)
    SELECT url, count(*) FILTER (WHERE host IN (SELECT host FROM own)) AS n_own, count(*) FILTER (WHERE host NOT IN (SELECT host FROM own)) AS n_other FROM d WHERE host <> '' GROUP BY url
    """
)
def own_platform_tags(spark: SparkSession, root: str) -> DataFrame:
    own = [r.host for r in table(spark, root, "platforms", "host").where("host IS NOT NULL").collect()]  # one row per platform, whose number is fixed
    hosts = F.transform("urls", U.host_enriched)
    tags = N.tagged(F.filter(hosts, lambda h: h != ""), "is_own", lambda h: h.isin(*own))
    rows = table(spark, root, "contacts", "url", "urls").where("url IS NOT NULL AND size(urls) > 0").select("url", tags.alias("t")).where("size(t) > 0")
    count = lambda own_: F.size(F.filter("t", lambda x: x["is_own"] == F.lit(own_)))
    return rows.groupBy("url").agg(F.sum(count(True)).alias("n_own"), F.sum(count(False)).alias("n_other"))


@query(
    f"""
    WITH {links._VERDICTS}, {links._CITED} SELECT domain, count(DISTINCT url) AS n_demoted FROM checked WHERE hits >= 1 AND domain IN (SELECT domain FROM checked GROUP BY domain HAVING count(DISTINCT url) >= 2) GROUP BY domain
    """
)
def demotions(spark: SparkSession, root: str) -> DataFrame:
    """Bad verdicts that stop counting because the domain is shared, per domain."""
    cited = table(spark, root, "contacts", "url", "urls").where("url IS NOT NULL").select("url", F.explode("urls").alias("u")).select("url", U.host_enriched(F.col("u")).alias("domain")).where("domain <> ''").distinct()
    hits = F.coalesce("vt_malicious", F.lit(0)) + F.coalesce("vt_suspicious", F.lit(0))
    bad = links._latest_verdicts(spark, root).where(hits >= 1).select("domain")
    return cited.join(bad, "domain", "left_semi").groupBy("domain").agg(F.count(F.lit(1)).alias("n_demoted")).where("n_demoted >= 2")


@query(
    """
    WITH c AS (SELECT url, organizer, platform FROM campaigns WHERE url IS NOT NULL), e AS (SELECT DISTINCT url, regexp_replace(unnest(phones), '[^0-9]', '', 'g') AS value FROM contacts)
    SELECT value, count(DISTINCT e.url) AS n_urls, count(DISTINCT platform) AS n_platforms, count(DISTINCT organizer) AS n_organizers FROM e LEFT JOIN c ON e.url = c.url WHERE value <> '' GROUP BY value HAVING count(DISTINCT e.url) > 1
    """
)
def recurrence(spark: SparkSession, root: str) -> DataFrame:
    phones = table(spark, root, "contacts", "url", "phones").select("url", F.explode("phones").alias("x")).select("url", C.phone_digits(F.col("x")).alias("value")).where("value <> ''").distinct()
    pages = table(spark, root, "campaigns", "url", "organizer", "platform").where("url IS NOT NULL")
    return phones.join(pages, "url", "left").groupBy("value").agg(F.countDistinct("url").alias("n_urls"), F.countDistinct("platform").alias("n_platforms"), F.countDistinct("organizer").alias("n_organizers")).where("n_urls > 1")


@query(
    r"""
    WITH s AS (SELECT try_cast(trim(cluster_id, E' \t\n\r') AS DOUBLE) AS c, fired_signals FROM detector_d_flags WHERE regexp_full_match(trim(cluster_id, E' \t\n\r'), '[0-9]+(\.0*)?'))
    SELECT CAST(c AS BIGINT) AS cluster, bool_or(regexp_matches(coalesce(fired_signals, ''), '[CD]\.[0-9]+_(email|phone|payment)')) AS has_hard, bool_or(regexp_matches(coalesce(fired_signals, ''), '[CD]\.[0-9]+_name')) AS has_name, count(*) AS n_rows FROM s GROUP BY 1
    """
)
def cluster_evidence(spark: SparkSession, root: str) -> DataFrame:
    text = F.regexp_replace("cluster_id", r"^\s+|\s+$", "")
    number = F.when(text.rlike(r"^[0-9]+(\.0*)?$"), text.try_cast("double").cast("long"))
    fired = F.coalesce("fired_signals", F.lit(""))
    rows = table(spark, root, "detector_d_flags", "cluster_id", "fired_signals").select(number.alias("cluster"), fired.alias("fired")).where("cluster IS NOT NULL")
    return rows.groupBy("cluster").agg(F.bool_or(F.col("fired").rlike(r"[CD]\.[0-9]+_(email|phone|payment)")).alias("has_hard"), F.bool_or(F.col("fired").rlike(r"[CD]\.[0-9]+_name")).alias("has_name"), F.count(F.lit(1)).alias("n_rows"))


@query(
    f"""
    WITH {links._BUCKETS} SELECT signal, value, n AS n_items FROM sizes WHERE n >= 5
    """
)
def skip_list(spark: SparkSession, root: str) -> DataFrame:
    """Values so common that they identify nobody."""
    return links._buckets(spark, root).groupBy("signal", "value").agg(F.count(F.lit(1)).alias("n_items")).where("n_items >= 5")


@query()
def legacy_clusters(spark: SparkSession, root: str) -> DataFrame:
    """Groups of names linked by shared contacts' pages or by likeness; tested by its parts."""
    pages = table(spark, root, "campaigns", "url", "organizer")
    owners = pages.where("url IS NOT NULL AND trim(organizer) <> ''").groupBy("url").agg(F.min(F.trim("organizer")).alias("organizer"))
    # All names of a bucket are linked to its least one: the groups are those that its pairs make.
    held = links.share_cap(spark, root).join(owners.withColumnRenamed("url", "item"), "item").groupBy("signal", "value").agg(F.collect_set("organizer").alias("names")).where("size(names) > 1")
    shared = held.select(F.explode("names").alias("src"), F.array_min("names").alias("dst"))
    alike = fuzzy.linked_names(pages, "organizer", 90.0)
    return I.joined(shared.unionByName(alike), label="legacy")


@query(
    f"""
    WITH t AS (SELECT ingest_seq, {sql_of(PRESENT, "title")} AS t FROM campaigns)
    SELECT ingest_seq, length(trim(coalesce(t, ''))) < 4 OR starts_with(lower(coalesce(t, '')), 'this page is run by') OR starts_with(lower(coalesce(t, '')), 'powered by') OR starts_with(lower(coalesce(t, '')), 'all rights reserved') AS is_boilerplate FROM t
    """
)
def boilerplate_titles(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "campaigns", "ingest_seq", "title").select("ingest_seq", N.boilerplate(T.present(F.col("title")), PLATFORM_TEXT).alias("is_boilerplate"))


@query(
    """
    WITH c AS (SELECT url, max(description) AS d FROM campaigns WHERE url IS NOT NULL GROUP BY url), k AS (SELECT DISTINCT url, unnest(names) AS n FROM contacts WHERE url IS NOT NULL)
    SELECT k.url, count(*) FILTER (WHERE contains(lower(d), lower(trim(n)))) AS n_literal, count(*) AS n_names FROM k JOIN c ON k.url = c.url WHERE trim(n) <> '' GROUP BY k.url
    """
)
def literal_names(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "campaigns", "url", "description").where("url IS NOT NULL").groupBy("url").agg(F.max("description").alias("d"))
    said = table(spark, root, "contacts", "url", "names").where("url IS NOT NULL").select("url", F.explode("names").alias("n")).where("trim(n) <> ''").distinct()
    met = said.join(pages, "url").select("url", F.size(N.found_in(F.array("n"), F.col("d"))).alias("hit"))
    return met.groupBy("url").agg(F.count_if(F.col("hit") > 0).alias("n_literal"), F.count(F.lit(1)).alias("n_names"))


@query(
    """
    SELECT vt_status, CASE WHEN vt_status IS NULL THEN 'failed' WHEN vt_status IN ('200', 'ok') THEN 'known' WHEN vt_status IN ('404', 'not_found') THEN 'unknown' ELSE 'other' END AS outcome, count(*) AS n_rows,
      CAST(coalesce(sum(vt_malicious), 0) AS BIGINT) AS n_malicious FROM domain_verdicts GROUP BY vt_status
    """
)
def verdict_outcomes(spark: SparkSession, root: str) -> DataFrame:
    s = F.col("vt_status")
    outcome = F.when(s.isNull(), F.lit("failed")).when(s.isin("200", "ok"), F.lit("known")).when(s.isin("404", "not_found"), F.lit("unknown")).otherwise(F.lit("other"))
    rows = table(spark, root, "domain_verdicts", "vt_status", "vt_malicious").groupBy("vt_status").agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum("vt_malicious"), F.lit(0)).alias("n_malicious"))
    return rows.select("vt_status", outcome.alias("outcome"), "n_rows", "n_malicious")


@query(
    """
    WITH o AS (SELECT platform, count(*) AS n FROM campaigns WHERE platform IS NOT NULL GROUP BY platform)
    SELECT platform, n AS n_rows, CAST(row_number() OVER (ORDER BY n DESC, platform) AS INT) AS number FROM o
    """
)
def numbered_groups(spark: SparkSession, root: str) -> DataFrame:
    counts = table(spark, root, "campaigns", "platform").where("platform IS NOT NULL").groupBy("platform").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("number", F.row_number().over(Window.orderBy(F.desc("n_rows"), "platform")))


@query(
    """
    WITH seen AS (SELECT url, title, organizer, count(*) AS n_rows FROM campaigns GROUP BY url, title, organizer) SELECT count(*) AS n_distinct, CAST(sum(n_rows) AS BIGINT) AS n_all, count(*) FILTER (WHERE n_rows > 1) AS n_repeated FROM seen
    """
)
def seen_once(spark: SparkSession, root: str) -> DataFrame:
    seen = table(spark, root, "campaigns", "url", "title", "organizer").groupBy("url", "title", "organizer").agg(F.count(F.lit(1)).alias("n_rows"))
    return seen.agg(F.count(F.lit(1)).alias("n_distinct"), F.sum("n_rows").alias("n_all"), F.count_if(F.col("n_rows") > 1).alias("n_repeated"))


@query(
    f"""
    WITH {reports._VOTES}, said AS (
      SELECT url, a + b + c AS score, concat_ws(', ', CASE WHEN a = 1 THEN 'linked to other pages' END, CASE WHEN b = 1 THEN 'names a payment handle' END, CASE WHEN c = 1 THEN 'taken down' END) AS s FROM votes
    )
    SELECT url, score, CASE WHEN s = '' THEN '' ELSE s || '.' END AS evidence FROM said
    """
)
def evidence_sentences(spark: SparkSession, root: str) -> DataFrame:
    votes = reports._votes(spark, root)
    text = N.sentence((F.col("a") == 1, F.lit("linked to other pages")), (F.col("b") == 1, F.lit("names a payment handle")), (F.col("c") == 1, F.lit("taken down")))
    return votes.select("url", (F.col("a") + F.col("b") + F.col("c")).alias("score"), text.alias("evidence"))


@query(
    """
    WITH e AS (SELECT embedding, label FROM embeddings), m AS (SELECT label, count(*) AS n FROM e GROUP BY label)
    SELECT label, n AS n_rows, n * (n - 1) // 2 AS n_pairs FROM m ORDER BY n DESC, label NULLS LAST LIMIT 5
    """
)
def top_labels(spark: SparkSession, root: str) -> DataFrame:
    counts = table(spark, root, "embeddings", "label").groupBy("label").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.orderBy(F.desc("n_rows"), F.asc_nulls_last("label")).limit(5).select("label", "n_rows", (F.col("n_rows") * (F.col("n_rows") - 1) / 2).cast("long").alias("n_pairs"))


_RECOUNT = rf"""
  {links._TIES}, told AS (
    SELECT CAST(try_cast(trim(cluster_id, E' \t\n\r') AS DOUBLE) AS BIGINT) AS cluster, max(cluster_size) AS told FROM detector_d_flags WHERE regexp_full_match(trim(cluster_id, E' \t\n\r'), '[0-9]+(\.0*)?') GROUP BY 1
  ), counted AS (SELECT cluster, count(DISTINCT url) AS n FROM ties GROUP BY cluster)
"""


@query(f"WITH {_RECOUNT} SELECT CASE WHEN told IS NULL THEN 'untold' WHEN told = n THEN 'right' WHEN told > n THEN 'too large' ELSE 'too small' END AS verdict, count(*) AS n_clusters FROM told LEFT JOIN counted USING (cluster) GROUP BY 1")
def recounted_clusters(spark: SparkSession, root: str) -> DataFrame:
    """The sizes that the writer told against the members there are."""
    text = F.regexp_replace("cluster_id", r"^\s+|\s+$", "")
    number = F.when(text.rlike(r"^[0-9]+(\.0*)?$"), text.try_cast("double").cast("long"))
    told = table(spark, root, "detector_d_flags", "cluster_id", "cluster_size").select(number.alias("cluster"), "cluster_size").where("cluster IS NOT NULL").groupBy("cluster").agg(F.max("cluster_size").alias("told"))
    counted = links._clusters(spark, root).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    verdict = F.when(F.col("told").isNull(), F.lit("untold")).when(F.col("told") == F.col("n"), F.lit("right")).when(F.col("told") > F.col("n"), F.lit("too large")).otherwise(F.lit("too small"))
    return told.join(counted, "cluster", "left").groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n_clusters"))


@query(
    f"""
    WITH {links._TIES}, e AS (
      SELECT t.cluster, count(DISTINCT t.url) AS n, count(DISTINCT platform) AS p, bool_or(regexp_matches(coalesce(fired_signals, ''), '_(email|phone|payment)')) AS hard
      FROM ties t JOIN detector_d_flags d ON d.url = t.url LEFT JOIN (SELECT url, min(platform) AS platform FROM campaigns GROUP BY url) c ON c.url = t.url GROUP BY t.cluster
    )
    SELECT count(*) AS n_clusters, count(*) FILTER (WHERE hard) AS by_signal, count(*) FILTER (WHERE hard OR p >= 2) AS by_signal_or_platforms, count(*) FILTER (WHERE hard OR p >= 2 OR n >= 3) AS by_any FROM e
    """
)
def gate_sweep(spark: SparkSession, root: str) -> DataFrame:
    """How many clusters stand under each rule of evidence, all rules in one pass."""
    fired = table(spark, root, "detector_d_flags", "url", "fired_signals").where("url IS NOT NULL").groupBy("url").agg(F.bool_or(F.coalesce("fired_signals", F.lit("")).rlike("_(email|phone|payment)")).alias("hard"))
    pages = table(spark, root, "campaigns", "url", "platform").groupBy("url").agg(F.min("platform").alias("platform"))
    members = links._clusters(spark, root).join(fired, "url").join(pages, "url", "left")
    each = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("platform").alias("p"), F.bool_or("hard").alias("hard"))
    hard, wide, large = F.col("hard"), F.col("p") >= 2, F.col("n") >= 3
    return each.agg(F.count(F.lit(1)).alias("n_clusters"), F.count_if(hard).alias("by_signal"), F.count_if(hard | wide).alias("by_signal_or_platforms"), F.count_if(hard | wide | large).alias("by_any"))


@query(f"WITH {reports._VOTES} SELECT round(sum(a * b) / sum(b), 6) AS a_given_b, round(sum(c * b) / sum(b), 6) AS c_given_b, round(sum(a * c) / sum(c), 6) AS a_given_c FROM votes")
def independence_shares(spark: SparkSession, root: str) -> DataFrame:
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    share = lambda x, of: F.round(F.sum(x * of) / F.sum(of), 6)
    return reports._votes(spark, root).agg(share(a, b).alias("a_given_b"), share(c, b).alias("c_given_b"), share(a, c).alias("a_given_c"))


@query(
    """
    WITH e AS (SELECT DISTINCT url, lower(trim(unnest(emails))) AS form, 1 AS rank FROM contacts), u AS (SELECT DISTINCT url, url AS form, 0 AS rank FROM contacts),
    known AS (SELECT url AS form, min(flag) AS flag FROM detector_d_flags WHERE url IS NOT NULL GROUP BY url UNION ALL SELECT lower(trim(m)), min(0) FROM (SELECT unnest(emails) AS m FROM contacts WHERE ok) WHERE trim(m) <> '' GROUP BY lower(trim(m))),
    met AS (SELECT x.url, rank, form, flag FROM (SELECT * FROM u UNION ALL SELECT * FROM e) x JOIN known USING (form) WHERE x.url IS NOT NULL)
    SELECT url, arg_min(form, (rank, form)) AS form, arg_min(flag, (rank, form)) AS flag FROM met GROUP BY url
    """
)
def ranked_attachment(spark: SparkSession, root: str) -> DataFrame:
    """Each page's first key that is known: its own url, then its mail addresses."""
    rows = table(spark, root, "contacts", "url", "emails", "ok").where("url IS NOT NULL")
    mails = rows.select("url", F.explode("emails").alias("m")).select("url", F.lower(F.trim("m")).alias("form"), F.lit(1).alias("rank")).distinct()
    probes = rows.select("url", F.col("url").alias("form"), F.lit(0).alias("rank")).distinct().unionByName(mails)
    flagged = table(spark, root, "detector_d_flags", "url", "flag").where("url IS NOT NULL").groupBy(F.col("url").alias("form")).agg(F.min("flag").alias("flag"))
    ok_mails = table(spark, root, "contacts", "emails", "ok").where("ok").select(F.explode("emails").alias("m")).select(F.lower(F.trim("m")).alias("form")).where("form <> ''").distinct()
    known = flagged.unionByName(ok_mails.select("form", F.lit(0).alias("flag")))
    best = probes.join(known, "form").groupBy("url").agg(F.min(F.struct("rank", "form", "flag")).alias("b"))
    return best.select("url", "b.form", "b.flag")


@query(
    """
    WITH n AS (SELECT platform, upper(trim(currency)) AS c, count(*) AS n FROM campaigns WHERE trim(currency) <> '' GROUP BY ALL)
    SELECT platform, string_agg(c, ';' ORDER BY n DESC, c) AS currencies FROM n GROUP BY platform
    """
)
def region_candidates(spark: SparkSession, root: str) -> DataFrame:
    """The currencies of a platform, the most frequent first: the order in which a number's region is guessed."""
    counts = table(spark, root, "campaigns", "platform", "currency").where("trim(currency) <> ''").groupBy("platform", F.upper(F.trim("currency")).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    # Currencies are few; a platform's list holds each once.
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "c")))
    return counts.groupBy("platform").agg(F.array_join(F.transform(ordered, lambda x: x["c"]), ";").alias("currencies"))


@query(
    r"""
    WITH m AS (SELECT ingest_seq, unnest(regexp_extract_all(description, '[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+')) AS e FROM campaigns)
    SELECT lower(e) AS email, count(DISTINCT ingest_seq) AS n_rows FROM m GROUP BY 1
    """
)
def swept_emails(spark: SparkSession, root: str) -> DataFrame:
    pattern = r"[A-Za-z0-9._+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
    hits = table(spark, root, "campaigns", "ingest_seq", "description").select("ingest_seq", F.explode(F.regexp_extract_all("description", F.lit(pattern), F.lit(0))).alias("e"))
    return hits.groupBy(F.lower("e").alias("email")).agg(F.countDistinct("ingest_seq").alias("n_rows"))


QUERIES, SQL = query.queries, query.sql
