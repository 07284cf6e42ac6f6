"""Queries that report: counts, rates, votes, distributions, vectors, and the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernstone.functions import text as T
from quernstone.operators import identity as I
from quernstone.operators import records as R
from quernstone.plans.base import AMOUNT, PRESENT, Registry, sql_of
from quernstone.sources.tables import table

query = Registry()

_MONEY = f"SELECT ingest_seq, platform, {sql_of(AMOUNT, 'goal_amount')} AS goal, {sql_of(AMOUNT, 'raised_amount')} AS raised, donors_count FROM campaigns"


def _money(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "campaigns", "ingest_seq", "platform", "goal_amount", "raised_amount", "donors_count")
    return rows.select("ingest_seq", "platform", T.amount(F.col("goal_amount")).alias("goal"), T.amount(F.col("raised_amount")).alias("raised"), "donors_count")


@query(f"SELECT ingest_seq, goal, raised FROM ({_MONEY})")
def amount_parse(spark: SparkSession, root: str) -> DataFrame:
    return _money(spark, root).select("ingest_seq", "goal", "raised")


@query(
    f"""
    SELECT platform, round(median(goal), 4) AS median_goal, round(max(raised), 4) AS max_raised, round(avg(least(raised / goal, 10)), 6) AS mean_capped_ratio,
      count(*) FILTER (WHERE goal % 1000 = 0) AS n_round_goals, count(*) FILTER (WHERE raised >= goal) AS n_reached, count(*) AS n_rows
    FROM ({_MONEY}) WHERE goal > 0 AND raised IS NOT NULL GROUP BY platform
    """
)
def behaviour_metrics(spark: SparkSession, root: str) -> DataFrame:
    rows = _money(spark, root).where("goal > 0 AND raised IS NOT NULL")
    return rows.groupBy("platform").agg(
        F.round(F.median("goal"), 4).alias("median_goal"),
        F.round(F.max("raised"), 4).alias("max_raised"),
        F.round(F.avg(F.least(F.col("raised") / F.col("goal"), F.lit(10.0))), 6).alias("mean_capped_ratio"),
        F.count_if(F.col("goal") % 1000 == 0).alias("n_round_goals"),
        F.count_if(F.col("raised") >= F.col("goal")).alias("n_reached"),
        F.count(F.lit(1)).alias("n_rows"),
    )


@query(
    f"""
    WITH m AS ({_MONEY}), credible AS (SELECT platform FROM m WHERE raised IS NOT NULL AND platform IS NOT NULL GROUP BY platform HAVING median(raised) >= 100 AND count(*) >= 20)
    SELECT platform, count(*) AS n_rows, round(sum(raised), 2) AS total_raised FROM m WHERE platform IN (SELECT platform FROM credible) GROUP BY platform
    """
)
def credible_groups(spark: SparkSession, root: str) -> DataFrame:
    rows = _money(spark, root).where("platform IS NOT NULL")
    credible = rows.where("raised IS NOT NULL").groupBy("platform").agg(F.median("raised").alias("m"), F.count(F.lit(1)).alias("n")).where("m >= 100 AND n >= 20").select("platform")
    return rows.join(credible, "platform", "left_semi").groupBy("platform").agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("raised"), 2).alias("total_raised"))


@query("SELECT donors_count, count(*) AS n_rows, CAST(sum(count(*)) OVER (ORDER BY donors_count) AS BIGINT) AS n_up_to FROM campaigns WHERE donors_count IS NOT NULL GROUP BY donors_count")
def donor_distribution(spark: SparkSession, root: str) -> DataFrame:
    """Cumulative counts over distinct values: the values are few, so the one running sum is over a small aggregate."""
    counts = table(spark, root, "campaigns", "donors_count").where("donors_count IS NOT NULL").groupBy("donors_count").agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.withColumn("n_up_to", F.sum("n_rows").over(Window.orderBy("donors_count")))


@query(
    """
    SELECT lang, CAST(len(q) AS INT) AS n_quantiles, round(q[1], 4) AS p0, round(q[2], 4) AS p25, round(q[3], 4) AS p50, round(q[4], 4) AS p75, round(q[5], 4) AS p90, round(q[6], 4) AS p100
    FROM (SELECT lang, quantile_cont(CAST(n_chars AS DOUBLE), [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]) AS q FROM documents GROUP BY lang)
    """
)
def length_percentiles(spark: SparkSession, root: str) -> DataFrame:
    points = (0.0, 0.25, 0.5, 0.75, 0.9, 1.0)
    q = table(spark, root, "documents", "lang", "n_chars").groupBy("lang").agg(F.percentile("n_chars", F.array(*[F.lit(p) for p in points])).alias("q"))
    return q.select("lang", F.size("q").alias("n_quantiles"), *[F.round(F.col("q")[i], 4).alias(f"p{int(p * 100)}") for i, p in enumerate(points)])


@query("SELECT CASE WHEN n_chars < 100 THEN '0-99' WHEN n_chars < 1000 THEN '100-999' WHEN n_chars < 10000 THEN '1000-9999' ELSE '10000+' END AS bin, count(*) AS n_rows FROM documents WHERE n_chars IS NOT NULL GROUP BY 1")
def length_histogram(spark: SparkSession, root: str) -> DataFrame:
    n = F.col("n_chars")
    bin_ = F.when(n < 100, F.lit("0-99")).when(n < 1000, F.lit("100-999")).when(n < 10000, F.lit("1000-9999")).otherwise(F.lit("10000+"))
    return table(spark, root, "documents", "n_chars").where("n_chars IS NOT NULL").groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    """
    SELECT CAST(regexp_extract(created_date, '(19|20)[0-9]{2}', 0) AS INT) AS year, count(*) AS n_rows FROM campaigns WHERE regexp_matches(created_date, '(19|20)[0-9]{2}') GROUP BY 1
    """
)
def year_histogram(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "campaigns", "created_date").where(F.col("created_date").rlike("(19|20)[0-9]{2}"))
    return rows.groupBy(F.regexp_extract("created_date", "(19|20)[0-9]{2}", 0).cast("int").alias("year")).agg(F.count(F.lit(1)).alias("n_rows"))


_VOTES = """
  votes AS (
    SELECT c.url, min(platform) AS platform,
      CAST(coalesce(bool_or(d.flag = 1), false) AS INT) AS a, CAST(coalesce(bool_or(k.has), false) AS INT) AS b, CAST(coalesce(bool_or(t.gone), false) AS INT) AS c
    FROM campaigns c
    LEFT JOIN (SELECT url, max(flag) AS flag FROM detector_d_flags GROUP BY url) d ON c.url = d.url
    LEFT JOIN (SELECT url, bool_or(len(payment_handles) > 0) AS has FROM contacts GROUP BY url) k ON c.url = k.url
    LEFT JOIN (SELECT url, bool_or(regexp_matches(lower(category), 'taken|removed|404|gone')) AS gone FROM takedown_status GROUP BY url) t ON c.url = t.url
    WHERE c.url IS NOT NULL GROUP BY c.url
  )
"""


def _votes(spark: SparkSession, root: str) -> DataFrame:
    """Three yes/no signals per page, missing ones counting as no: flagged, names a payment handle, gone."""
    flagged = table(spark, root, "detector_d_flags", "url", "flag").groupBy("url").agg((F.max("flag") == 1).alias("flagged"))
    handles = table(spark, root, "contacts", "url", "payment_handles").groupBy("url").agg(F.bool_or(F.size("payment_handles") > 0).alias("has"))
    gone = table(spark, root, "takedown_status", "url", "category").groupBy("url").agg(F.bool_or(F.lower("category").rlike("taken|removed|404|gone")).alias("gone"))
    pages = table(spark, root, "campaigns", "url", "platform").where("url IS NOT NULL").groupBy("url").agg(F.min("platform").alias("platform"))
    joined = pages.join(flagged, "url", "left").join(handles, "url", "left").join(gone, "url", "left")
    vote = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return joined.select("url", "platform", vote(F.col("flagged")).alias("a"), vote(F.col("has")).alias("b"), vote(F.col("gone")).alias("c"))


@query(f"WITH {_VOTES} SELECT a + b + c AS score, CASE WHEN a + b + c >= 2 THEN 'high' WHEN a + b + c = 1 THEN 'some' ELSE 'none' END AS tier, count(*) AS n_rows FROM votes GROUP BY ALL")
def vote_tiers(spark: SparkSession, root: str) -> DataFrame:
    score = F.col("a") + F.col("b") + F.col("c")
    rows = _votes(spark, root).select(score.alias("score"))
    tier = F.when(F.col("score") >= 2, F.lit("high")).when(F.col("score") == 1, F.lit("some")).otherwise(F.lit("none"))
    return rows.groupBy("score").agg(F.count(F.lit(1)).alias("n_rows")).select("score", tier.alias("tier"), "n_rows")


@query(f"WITH {_VOTES} SELECT CAST(sum(a * b) AS BIGINT) AS ab, CAST(sum(a * c) AS BIGINT) AS ac, CAST(sum(b * c) AS BIGINT) AS bc, CAST(sum(a) AS BIGINT) AS a, CAST(sum(b) AS BIGINT) AS b, CAST(sum(c) AS BIGINT) AS c FROM votes")
def pairwise(spark: SparkSession, root: str) -> DataFrame:
    total = lambda x, name: F.sum(x).alias(name)
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return _votes(spark, root).agg(total(a * b, "ab"), total(a * c, "ac"), total(b * c, "bc"), total(a, "a"), total(b, "b"), total(c, "c"))


@query(f"WITH {_VOTES} SELECT CASE WHEN a = 1 THEN 'A' ELSE '' END || CASE WHEN b = 1 THEN 'B' ELSE '' END || CASE WHEN c = 1 THEN 'C' ELSE '' END AS fired, count(*) AS n_rows FROM votes GROUP BY 1")
def composition(spark: SparkSession, root: str) -> DataFrame:
    letter = lambda c: F.when(F.col(c) == 1, F.lit(c.upper())).otherwise(F.lit(""))
    return _votes(spark, root).groupBy(F.concat(letter("a"), letter("b"), letter("c")).alias("fired")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(f"WITH {_VOTES} SELECT count(*) FILTER (WHERE b + c >= 2) AS without_a, count(*) FILTER (WHERE a + c >= 2) AS without_b, count(*) FILTER (WHERE a + b >= 2) AS without_c, count(*) FILTER (WHERE a + b + c >= 2) AS with_all FROM votes")
def leave_one_out(spark: SparkSession, root: str) -> DataFrame:
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    left = lambda score, name: F.count_if(score >= 2).alias(name)
    return _votes(spark, root).agg(left(b + c, "without_a"), left(a + c, "without_b"), left(a + b, "without_c"), left(a + b + c, "with_all"))


@query(f"WITH {_VOTES} SELECT least AS least, count(*) FILTER (WHERE a + b + c >= least) AS n_rows FROM votes, (VALUES (1), (2), (3)) t(least) GROUP BY least")
def threshold_sweep(spark: SparkSession, root: str) -> DataFrame:
    score = F.col("a") + F.col("b") + F.col("c")
    one = _votes(spark, root).agg(*[F.count_if(score >= n).alias(f"n{n}") for n in (1, 2, 3)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(n).alias("least"), F.col(f"n{n}").alias("n_rows")) for n in (1, 2, 3)])))


@query(
    f"""
    WITH {_VOTES} SELECT platform, count(*) AS n_rows, count(*) FILTER (WHERE a + b + c >= 2) AS n_high, count(*) FILTER (WHERE a + b + c = 1) AS n_some,
      round(100.0 * count(*) FILTER (WHERE a + b + c >= 2) / count(*), 4) AS rate FROM votes GROUP BY platform
    """
)
def platform_table(spark: SparkSession, root: str) -> DataFrame:
    score = F.col("a") + F.col("b") + F.col("c")
    high = F.count_if(score >= 2)
    return _votes(spark, root).groupBy("platform").agg(F.count(F.lit(1)).alias("n_rows"), high.alias("n_high"), F.count_if(score == 1).alias("n_some"), F.round(100.0 * high / F.count(F.lit(1)), 4).alias("rate"))


@query(
    """
    SELECT c.platform, count(*) AS n_checked, count(*) FILTER (WHERE regexp_matches(lower(t.category), 'live|active|up')) AS n_live, count(*) FILTER (WHERE t.category IS NULL) AS n_unknown
    FROM takedown_status t LEFT JOIN (SELECT url, min(platform) AS platform FROM campaigns GROUP BY url) c ON t.url = c.url GROUP BY c.platform
    """
)
def reachability(spark: SparkSession, root: str) -> DataFrame:
    pages = table(spark, root, "campaigns", "url", "platform").groupBy("url").agg(F.min("platform").alias("platform"))
    rows = table(spark, root, "takedown_status", "url", "category").join(pages, "url", "left")
    return rows.groupBy("platform").agg(F.count(F.lit(1)).alias("n_checked"), F.count_if(F.lower("category").rlike("live|active|up")).alias("n_live"), F.count_if(F.col("category").isNull()).alias("n_unknown"))


_HTML = "trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(description, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&'), '[\\s\\x{A0}]+', ' ', 'g'))"


@query(f"SELECT ingest_seq, md5({_HTML}) AS clean_hash, CAST(length({_HTML}) AS INT) AS clean_length FROM campaigns WHERE description IS NOT NULL")
def html_stripped(spark: SparkSession, root: str) -> DataFrame:
    clean = T.without_html(F.col("description"))
    return table(spark, root, "campaigns", "ingest_seq", "description").where("description IS NOT NULL").select("ingest_seq", F.md5(clean).alias("clean_hash"), F.length(clean).alias("clean_length"))


_EMERGENCY = T.EMERGENCY.replace("'", "''")
_DEADLINE = T.DEADLINE.replace("'", "''")
_PLAIN = "replace(replace(replace(replace(replace(replace(replace(regexp_replace(description, '<[^>]+>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&apos;', ''''), '&amp;', '&')"


@query(
    f"""
    WITH t AS (SELECT ingest_seq, {_PLAIN} AS t FROM campaigns WHERE description IS NOT NULL)
    SELECT ingest_seq, CAST(length(t) AS INT) AS char_count,
      CASE WHEN len(regexp_extract_all(t, '\\p{{L}}')) > 0 THEN round_even(len(regexp_extract_all(t, '\\p{{Lu}}')) / len(regexp_extract_all(t, '\\p{{L}}')), 4) ELSE 0.0 END AS uppercase_ratio,
      CAST(len(regexp_extract_all(t, '!')) AS INT) AS exclamation_count, CAST(len(regexp_extract_all(t, '{_EMERGENCY}')) AS INT) AS emergency_keyword_count, CAST(len(regexp_extract_all(t, '{_DEADLINE}')) AS INT) AS deadline_keyword_count
    FROM t
    """
)
def text_features(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "campaigns", "ingest_seq", "description").where("description IS NOT NULL").select("ingest_seq", T.text_features(F.col("description")).alias("f")).select("ingest_seq", "f.*")


@query()
def pattern_hits(spark: SparkSession, root: str) -> DataFrame:
    """No SQL: one of the wordings needs a look-behind, which DuckDB's patterns lack; tested on a fixture."""
    text = F.concat_ws("\n", "title", "description")
    return table(spark, root, "campaigns", "ingest_seq", "title", "description").select("ingest_seq", T.wording_hits(text).alias("n_hits"))


@query()
def style_vectors(spark: SparkSession, root: str) -> DataFrame:
    """Length and first entries of every style vector; tested against a plain version on a fixture."""
    v = table(spark, root, "campaigns", "ingest_seq", "description").select("ingest_seq", T.style_vector(F.col("description")).alias("v")).where("v IS NOT NULL")
    return v.select("ingest_seq", F.size("v").alias("n"), *[F.round(F.col("v")[i], 6).alias(f"v{i}") for i in range(4)])


@query(
    """
    WITH w AS (SELECT organizer, list_sort(list_filter(regexp_extract_all(lower(organizer), '[\\p{L}\\p{M}\\p{N}_]+'), lambda x: length(x) >= 2)) AS w FROM (SELECT DISTINCT organizer FROM campaigns WHERE organizer IS NOT NULL))
    SELECT CASE WHEN len(w) >= 2 THEN array_to_string(w, ' ') END AS name_key, count(*) AS n_spellings FROM w GROUP BY 1
    """
)
def name_token_key(spark: SparkSession, root: str) -> DataFrame:
    names = table(spark, root, "campaigns", "organizer").where("organizer IS NOT NULL").distinct()
    return names.groupBy(T.token_key(F.col("organizer")).alias("name_key")).agg(F.count(F.lit(1)).alias("n_spellings"))


@query("SELECT substr(sha256('pepper' || url), 1, 12) AS pseudonym, count(*) AS n_rows FROM campaigns WHERE url IS NOT NULL GROUP BY 1")
def pseudonyms(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "campaigns", "url").where("url IS NOT NULL")
    return rows.groupBy(T.pseudonym(F.col("url"), "pepper").alias("pseudonym")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    """
    WITH d AS (SELECT ingest_seq, greatest(date_sub('day', scrape_timestamp, ingested_at), 0) AS late_days FROM campaigns WHERE scrape_timestamp IS NOT NULL)
    SELECT CAST(late_days AS BIGINT) AS late_days, count(*) AS n_rows FROM d GROUP BY 1
    """
)
def lateness(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "campaigns", "scrape_timestamp", "ingested_at").where("scrape_timestamp IS NOT NULL")
    return rows.groupBy(T.whole_days(F.col("scrape_timestamp"), F.col("ingested_at")).alias("late_days")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    f"""
    WITH t AS (SELECT platform, {sql_of(PRESENT, "description")} AS d, coalesce(description_word_count, 0) AS wc, url FROM campaigns),
    s AS (SELECT *, wc >= 100 AS one FROM t)
    SELECT CASE WHEN one THEN 1 WHEN platform IS DISTINCT FROM 'SpotNest' AND platform IS DISTINCT FROM 'KindRaise' AND wc >= 50 THEN 2 WHEN platform = 'KindRaise' AND length(d) >= 150 AND NOT contains(url, '/blog/') THEN 3 END AS stage, count(*) AS n_rows
    FROM s GROUP BY 1
    """
)
def corpus_rule_filter(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "campaigns", "platform", "description", "description_word_count", "url")
    words, name = F.coalesce("description_word_count", F.lit(0)), F.coalesce("platform", F.lit(""))
    stage = F.when(words >= 100, 1).when(~name.isin("SpotNest", "KindRaise") & (words >= 50), 2).when((name == "KindRaise") & (F.length(T.present(F.col("description"))) >= 150) & ~F.col("url").contains("/blog/"), 3)
    return rows.groupBy(stage.alias("stage")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    """
    WITH u AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), n AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) AS v FROM u)
    SELECT a.label, count(DISTINCT a.vec_id) AS n_items, round(avg(list_dot_product(a.v, b.v)), 6) AS mean_cosine FROM n a JOIN n b ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY a.label
    """
)
def mean_cosine(spark: SparkSession, root: str) -> DataFrame:
    return I.mean_cosine(table(spark, root, "embeddings", "label", "embedding"), "label", "embedding", 64).withColumn("mean_cosine", F.round("mean_cosine", 6))


@query("SELECT user_id, time_bucket(INTERVAL '1 minute', ts) AS minute, count(*) AS n_events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def rate_windows(spark: SparkSession, root: str) -> DataFrame:
    rows = table(spark, root, "events", "user_id", "ts", "value")
    return rows.groupBy("user_id", F.window("ts", "60 seconds").alias("w")).agg(F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 4).alias("total")).select("user_id", F.col("w.start").alias("minute"), "n_events", "total")


@query(
    """
    SELECT c_custkey, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total, count(DISTINCT o_orderpriority) AS n_priorities, CASE WHEN count(*) >= 3 THEN round(count(DISTINCT o_orderpriority) / count(*), 4) END AS diversity
    FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey
    """
)
def giver_aggregates(spark: SparkSession, root: str) -> DataFrame:
    orders = table(spark, root, "orders", "o_custkey", "o_totalprice", "o_orderpriority")
    known = table(spark, root, "customer", "c_custkey")
    n, kinds = F.count(F.lit(1)), F.countDistinct("o_orderpriority")
    return orders.join(known, F.col("o_custkey") == F.col("c_custkey")).groupBy("c_custkey").agg(
        n.alias("n_orders"), F.round(F.sum("o_totalprice"), 2).alias("total"), kinds.alias("n_priorities"), F.when(n >= 3, F.round(kinds / n, 4)).alias("diversity")
    )


QUERIES, SQL = query.queries, query.sql
