"""Profiles and links as people and extractors write them: parsed, classed, moved to where they belong.

Handles are parsed step by step in columns of a DataFrame, so an expression that
several later ones need is written once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quernstone.functions.social import PLATFORM_BY_LABEL
from quernstone.functions.text import let

# The host under which a platform's profiles are written.
CANONICAL_HOST = {
    "facebook": "facebook.com", "instagram": "instagram.com", "twitter": "twitter.com", "telegram": "t.me", "whatsapp": "wa.me", "tiktok": "tiktok.com", "youtube": "youtube.com",
    "linkedin": "linkedin.com", "pinterest": "pinterest.com", "snapchat": "snapchat.com", "discord": "discord.com", "reddit": "reddit.com", "github": "github.com", "medium": "medium.com",
    "vimeo": "vimeo.com", "mastodon": "mastodon.social", "threads": "threads.net", "bluesky": "bsky.app",
}
# Beginnings of paths that lead to no profile, in order.
NON_PROFILE_PREFIXES = (
    "events/", "groups/", "joinchat/", "watch", "video", "playlist", "live/", "marketplace/", "gaming/", "stories/", "reel/", "p/", "explore/", "hashtag/", "share/", "intent/", "search",
)
# Platform names that stand where a user's name should.
SELF_REFERENTIAL = (
    "facebook", "fb", "facebook com", "instagram", "insta", "twitter", "x", "telegram", "whatsapp", "wa", "tiktok", "tik tok", "youtube", "yt", "linkedin", "pinterest", "pin", "snapchat", "snap",
    "discord", "reddit", "github", "mastodon", "threads", "bluesky", "bsky", "vimeo", "medium", "facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "tiktok.com", "linkedin.com",
    "snapchat.com", "discord.com", "reddit.com", "medium.com", "vimeo.com", "github.com", "pinterest.com",
)
# Fixed value: the end of a user's name that is a domain.
DOMAIN_ENDING = r"\.(?:com|org|net|de|co\.uk|io|me|app|gg|tv|info|biz|edu|gov|lu|fr|it|ca|au|us|uk|in|es|nl|se|ch|at|be|jp|cn|br|ru|pl)$"
# Path segments that stay with the name that follows them.
KEPT_SEGMENTS = {"linkedin": ("in", "company", "school", "showcase"), "youtube": ("c", "channel", "user")}
# Further platforms by label, and their hosts.
EXTRA_BY_LABEL = {
    "patreon": "patreon", "tumblr": "tumblr", "soundcloud": "soundcloud", "twitch": "twitch", "skype": "skype", "viber": "viber", "wechat": "wechat", "wordpress": "wordpress", "blogspot": "blogspot",
    "blogger": "blogspot", "mixcloud": "mixcloud", "bandcamp": "bandcamp", "spotify": "spotify", "polarsteps": "polarsteps", "strava": "strava", "etsy": "etsy", "linktr": "linktree",
    "dropbox": "dropbox", "revolut": "revolut", "tumbler": "tumblr",
}
EXTRA_HOST = {
    "patreon": "patreon.com", "tumblr": "tumblr.com", "soundcloud": "soundcloud.com", "twitch": "twitch.tv", "skype": "skype.com", "viber": "viber.com", "wechat": "wechat.com",
    "wordpress": "wordpress.com", "blogspot": "blogspot.com", "mixcloud": "mixcloud.com", "bandcamp": "bandcamp.com", "spotify": "spotify.com", "polarsteps": "polarsteps.com",
    "strava": "strava.com", "etsy": "etsy.com", "linktree": "linktr.ee", "dropbox": "dropbox.com", "revolut": "revolut.me",
}
FACEBOOK_HOSTS = ("m.facebook.com", "web.facebook.com", "l.facebook.com", "mobile.facebook.com", "free.facebook.com")
# Platform by host, for links found in a page.
PLATFORM_BY_HOST = {
    "linkedin.com": "linkedin", "facebook.com": "facebook", "fb.com": "facebook", "fb.me": "facebook", "twitter.com": "twitter", "x.com": "twitter", "instagram.com": "instagram",
    "tiktok.com": "tiktok", "youtube.com": "youtube", "youtu.be": "youtube", "t.me": "telegram", "telegram.me": "telegram", "wa.me": "whatsapp", "snapchat.com": "snapchat",
    "pinterest.com": "pinterest", "threads.net": "threads", "bsky.app": "bluesky", "github.com": "github", "patreon.com": "patreon", "twitch.tv": "twitch", "tumblr.com": "tumblr",
    "reddit.com": "reddit",
}
# Where a link names its user.
USER_IN_LINK = {
    "linkedin": r"linkedin\.com/(?:in|company)/([^/?#]+)",
    "twitter": r"(?:twitter|x)\.com/([^/?#]+)",
    "instagram": r"instagram\.com/([^/?#]+)",
    "tiktok": r"tiktok\.com/@?([^/?#]+)",
    "facebook": r"(?:facebook|fb)\.(?:com|me)/([^/?#]+)",
    "youtube": r"(?:youtube\.com/(?:c|user|channel|@)|youtu\.be/)([^/?#]+)",
    "telegram": r"(?:t|telegram)\.me/([^/?#]+)",
    "github": r"github\.com/([^/?#]+)",
    "reddit": r"reddit\.com/(?:u|user)/([^/?#]+)",
}
# Payment service by host, in order.
PAYMENT_HOSTS = {
    "paypal.me": "paypal", "paypal.com": "paypal", "venmo.com": "venmo", "cash.app": "cashapp", "cashapp.com": "cashapp", "patreon.com": "patreon", "ko-fi.com": "kofi",
    "buymeacoffee.com": "buymeacoffee", "wise.com": "wise", "revolut.me": "revolut", "revolut.com": "revolut", "gcash.com": "gcash", "payoneer.com": "payoneer",
}
# Kinds of hosts that pages link to, in the order in which they are tried.
HOST_KINDS = {
    "payment": ("paypal.me", "paypal.com", "venmo.com", "cash.app", "wise.com", "patreon.com", "buymeacoffee.com", "ko-fi.com", "donorbox.org", "givebutter.com"),
    "video": ("youtube.com", "youtu.be", "vimeo.com", "twitch.tv", "dailymotion.com", "rumble.com"),
    "news": (
        "nytimes.com", "bbc.com", "bbc.co.uk", "theguardian.com", "guardian.co.uk", "washingtonpost.com", "reuters.com", "ap.org", "apnews.com", "npr.org", "dw.com", "lemonde.fr", "spiegel.de",
        "faz.net", "sueddeutsche.de", "cnn.com", "bloomberg.com", "ft.com", "wsj.com", "vox.com", "theatlantic.com", "propublica.org", "axios.com", "semafor.com", "nbcnews.com", "cbsnews.com",
        "abcnews.go.com", "usatoday.com", "huffpost.com", "salon.com", "slate.com", "newyorker.com", "economist.com", "time.com", "newsweek.com", "forbes.com", "thehill.com",
    ),
    "wiki": ("wikipedia.org", "en.wikipedia.org", "de.wikipedia.org", "fr.wikipedia.org", "es.wikipedia.org", "it.wikipedia.org", "wikimedia.org"),
    "code": ("github.com", "gitlab.com", "bitbucket.org", "sourceforge.net", "raw.githubusercontent.com"),
    "charity_registry": ("guidestar.org", "charity-commission.gov.uk", "bbb.org", "charitynavigator.org", "candid.org", "givewell.org", "everyaction.com"),
}
DOCUMENT_ENDING = r"(?i)\.(?:pdf|docx?|xlsx?|pptx?|odt|ods|odp|rtf|txt|csv)(?:$|\?)"


def _mapped(value: Column, pairs: dict[str, str]) -> Column:
    """``pairs`` looked up, null for what is not there."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), value)


def _one_of(words) -> str:
    """A pattern of the words, the first that fits winning."""
    return "(" + "|".join(w.replace(".", r"\.") for w in words) + ")"


def _parent(host: Column, domains) -> Column:
    """The one of ``domains`` that is the host or a parent of it; empty for none."""
    return F.regexp_extract(host, rf"(?:^|\.){_one_of(domains)}$", 1)


def _first(cases: list[tuple[Column, Column]]) -> Column:
    """The value of the first case that holds; null where none does."""
    found = F.when(F.lit(False), F.lit(None).cast("string"))
    for holds, value in cases:
        found = found.when(holds, value)
    return found


def link_host(url: Column) -> Column:
    """The host of a link in lower case, without scheme, ``www.`` and outer dots."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(url)), "^https?://", ""), r"^www\.", "")
    return F.regexp_replace(F.regexp_extract(bare, "^[^/?#]*", 0), r"^\.+|\.+$", "")


def parsed_handles(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``platform``, ``user_id``, ``profile`` (url) and ``drop_reason`` of the handle in column ``text``.

    A kept handle has no reason, a dropped one nothing else. A bare ``@name`` is of
    platform ``unknown`` and has no profile. Null handles are dropped as ``empty``.
    The result's columns may not be in ``df``; names starting with ``__`` are used inside.
    """
    raw = F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"^\s+|\s+$", ""))
    x = df.withColumn("__raw", raw)
    x = x.withColumn("__bare", F.trim(F.regexp_replace("__raw", "^@+", ""))).withColumn("__rest", F.regexp_replace(F.regexp_replace("__raw", "(?i)^https?://", ""), r"(?i)^www\.", ""))
    x = x.withColumn("__host", F.lower(F.regexp_replace(F.regexp_extract("__rest", "^[^/?#]*", 0), r"\.+$", "")))
    x = x.withColumn("__path", F.trim(F.regexp_extract("__rest", "^[^/]*/([^?#]*)", 1)))
    x = x.withColumn("__known", _mapped(F.substring_index("__host", ".", 1), PLATFORM_BY_LABEL))
    x = x.withColumn("__prefix", F.regexp_replace(F.regexp_extract(F.lower("__path"), "^" + _one_of(NON_PROFILE_PREFIXES), 1), "/$", ""))
    # The name: all of the path without its outer signs, then its first segment, or two where the first only tells the kind.
    x = x.withColumn("__name", F.regexp_replace(F.regexp_replace(F.regexp_replace("__path", "^/+", ""), "^@+", ""), "/+$", ""))
    x = x.withColumn("__one", F.substring_index("__name", "/", 1)).withColumn("__two", F.regexp_extract("__name", "^[^/]*/([^/]+)", 1))
    kept = _first([((F.col("__known") == p) & F.col("__one").isin(*s), F.lit(p)) for p, s in KEPT_SEGMENTS.items()])
    x = x.withColumn("__kept", kept)
    name = F.when(F.col("__kept").isNotNull(), F.concat("__one", F.lit("/"), "__two")).when(F.col("__known") == "youtube", F.regexp_replace("__one", "^@+", "")).otherwise(F.col("__one"))
    x = x.withColumn("__user", name)
    after = F.substring_index(F.regexp_extract("__user", "^[^@]+@(.+)$", 1), "/", 1)
    x = x.withColumn("__user", F.when(after != "", after).otherwise(F.col("__user")))
    is_bare = F.col("__raw").startswith("@")
    has_space = lambda c: F.col(c).rlike(r"\s")
    reason = _first(
        [
            (F.col("__raw") == "", F.lit("empty")),
            (is_bare & ((F.length("__bare") < 2) | has_space("__bare")), F.lit("bare_at_invalid")),
            (is_bare & F.lower("__bare").isin(*SELF_REFERENTIAL), F.lit("bare_at_is_platform_name")),
            (is_bare, F.lit(None).cast("string")),
            (~F.col("__host").contains(".") | ~F.col("__host").rlike(r"^[\p{L}\p{N}_.\-]+$"), F.lit("no_valid_host")),
            (F.col("__known").isNotNull() & (F.col("__prefix") != ""), F.concat(F.lit("non_profile_path:"), "__prefix")),
            (F.col("__kept").isNotNull() & (F.col("__two") == ""), F.concat("__kept", F.lit("_no_id_after_prefix"))),
            (F.col("__user") == "", F.lit("no_user_id")),
            (has_space("__user"), F.lit("whitespace_in_user_id")),
            (F.lower("__user").isin(*SELF_REFERENTIAL), F.lit("self_referential")),
            (F.col("__user").rlike("(?i)" + DOMAIN_ENDING), F.lit("user_id_looks_like_domain")),
            (F.length("__user") < 2, F.lit("user_id_too_short")),
        ]
    )
    x = x.withColumn("drop_reason", reason)
    is_kept = F.col("drop_reason").isNull()
    of_known = F.concat(F.lit("https://"), _mapped(F.col("__known"), CANONICAL_HOST), F.lit("/"), "__user")
    as_met = F.concat(F.lit("https://"), "__host", F.lit("/"), "__path")
    return x.select(
        *df.columns,
        F.when(is_kept, F.when(is_bare, F.lit("unknown")).otherwise(F.coalesce("__known", F.lit("unknown")))).alias("platform"),
        F.when(is_kept, F.when(is_bare, F.col("__bare")).otherwise(F.col("__user"))).alias("user_id"),
        F.when(is_kept & ~is_bare, F.coalesce(of_known, as_met)).alias("profile"),
        "drop_reason",
    )


def reclassified_handles(df: DataFrame) -> DataFrame:
    """Rows of :func:`parsed_handles` with a second look at what has no known platform, and what was done as ``action``."""
    host = F.regexp_replace(F.lower(F.regexp_extract(F.regexp_replace("profile", "(?i)^https?://", ""), "^[^/]*", 0)), r"^\.+|\.+$", "")
    x = df.withColumn("__host", F.when((F.col("platform") == "unknown") & F.col("profile").isNotNull(), host))
    x = x.withColumn("__extra", _mapped(F.substring_index("__host", ".", 1), EXTRA_BY_LABEL))
    action = _first(
        [
            (F.col("__host").isin(*FACEBOOK_HOSTS) & F.col("user_id").isNotNull(), F.lit("fb_subdomain_normalized")),
            (F.col("__host") == "unknown.com", F.lit("demoted_unknown_com")),
            (F.col("__extra").isNotNull() & F.col("user_id").isNotNull(), F.lit("reclassified")),
        ]
    )
    x = x.withColumn("action", F.coalesce(action, F.lit("no_change")))
    as_extra = F.concat(F.lit("https://"), _mapped(F.col("__extra"), EXTRA_HOST), F.lit("/"), "user_id")
    new = {
        "platform": F.when(F.col("action") == "fb_subdomain_normalized", F.lit("facebook")).when(F.col("action") == "reclassified", F.col("__extra")).otherwise(F.col("platform")),
        "profile": F.when(F.col("action") == "fb_subdomain_normalized", F.concat(F.lit("https://facebook.com/"), "user_id"))
        .when(F.col("action") == "demoted_unknown_com", F.lit(None).cast("string"))
        .when(F.col("action") == "reclassified", as_extra)
        .otherwise(F.col("profile")),
    }
    return x.select(*[new.get(c, F.col(c)).alias(c) for c in df.columns], "action")


def classified_links(df: DataFrame, url: str) -> DataFrame:
    """``df`` with ``kind`` (``social_handle`` or ``domain``), ``platform``, ``user_id`` and ``host`` of a link; all null without a host of two labels."""
    x = df.withColumn("__h", link_host(F.col(url)))
    x = x.withColumn("__h", F.when(F.col("__h").contains("."), F.col("__h")))
    x = x.withColumn("__of", F.nullif(_parent(F.col("__h"), PLATFORM_BY_HOST), F.lit("")))
    x = x.withColumn("__p", _mapped(F.col("__of"), PLATFORM_BY_HOST))
    user = _first([(F.col("__p") == p, F.trim(F.regexp_extract(F.col(url), "(?i)" + pattern, 1))) for p, pattern in USER_IN_LINK.items()])
    return x.select(
        *df.columns,
        F.when(F.col("__p").isNotNull(), F.lit("social_handle")).when(F.col("__h").isNotNull(), F.lit("domain")).alias("kind"),
        F.col("__p").alias("platform"),
        F.nullif(user, F.lit("")).alias("user_id"),
        F.coalesce("__of", "__h").alias("host"),
    )


def url_category(url: Column, own_hosts: list[str], infrastructure: list[str]) -> Column:
    """What a url leads to, the first that fits: own platform, document, the HOST_KINDS, shared infrastructure, else external; null without a host."""

    def of(host: Column) -> Column:
        cases = [
            (~host.contains("."), F.lit(None).cast("string")),
            (_parent(host, own_hosts) != "", F.lit("self_platform")),
            (url.rlike(DOCUMENT_ENDING), F.lit("document")),
            *[(_parent(host, domains) != "", F.lit(kind)) for kind, domains in HOST_KINDS.items()],
            (_parent(host, infrastructure) != "", F.lit("shared_infra")),
            (F.lit(True), F.lit("external")),
        ]
        return _first(cases)

    return F.when(url.isNotNull(), let(link_host(url), of))


def payment_kind(host: Column) -> Column:
    """The payment service that a host belongs to; null for none."""
    return _mapped(_parent(host, PAYMENT_HOSTS), PAYMENT_HOSTS)


def moved_payments(df: DataFrame, urls: str, handles: str) -> DataFrame:
    """``df`` with the payment links of array ``urls`` moved to the end of array ``handles`` as ``kind:url``, each once; null arrays count as empty."""
    empty = F.array().cast("array<string>")
    links, held = F.coalesce(F.col(urls), empty), F.coalesce(F.col(handles), empty)
    kind = lambda u: payment_kind(link_host(u))
    moved = F.transform(F.filter(links, lambda u: kind(u).isNotNull()), lambda u: F.concat(kind(u), F.lit(":"), u))
    return df.withColumns({urls: F.filter(links, lambda u: kind(u).isNull()), handles: F.concat(held, F.array_except(moved, held))})
