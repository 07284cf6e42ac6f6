"""Urls and hosts as column expressions.

Sources disagree on what a host is; each reading keeps its own name here, because
joins must use the one their other side was made with.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that name no page.
TRACKING_PARAMETERS = ("src", "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "ref", "ref_", "referrer", "referer", "mc_cid", "mc_eid", "share", "shared", "via", "from")


def _bare(url: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(url, F.lit(""))), r"^\s+|\s+\z", ""), r"^https?://", "")


def _without_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def _until(text: Column, marks: str) -> Column:
    return F.regexp_extract(text, rf"^[^{marks}]*", 0)


def _without_dots(host: Column) -> Column:
    return F.regexp_replace(host, r"^\.+|\.+$", "")


def normalize_url(url: Column) -> Column:
    """Lower case, trimmed, without scheme, leading ``www.`` and trailing slashes; null becomes empty."""
    return F.regexp_replace(_without_www(_bare(url)), r"/+\z", "")


def host_detector(url: Column) -> Column:
    """Cut at slash, query or port, ``www.`` dropped; a fragment or trailing dot stays."""
    return _without_www(_until(_bare(url), "/?:"))


def host_lookup(url: Column) -> Column:
    """Cut at slash, query or fragment, outer dots dropped; ``www.`` and port stay."""
    return _without_dots(_until(_bare(url), "/?#"))


def host_enriched(url: Column) -> Column:
    """As :func:`host_lookup`, without ``www.``; leading dots stay."""
    return F.regexp_replace(_without_www(_until(_bare(url), "/?#")), r"\.+$", "")


def host_full(url: Column) -> Column:
    """As :func:`host_enriched`, null unless it has a dot and four characters."""
    h = host_enriched(url)
    return F.when(h.contains(".") & (F.length(h) >= 4), h)


def host_href(url: Column) -> Column:
    """As :func:`host_lookup`, without ``www.``."""
    return _without_dots(_without_www(_until(_bare(url), "/?#")))


def host_parsed(url: Column) -> Column:
    """The host a url parser finds (no port, no user), lower case, without ``www.``; empty where there is none."""
    return _without_www(F.lower(F.coalesce(F.regexp_extract(F.trim(url), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))))


def canonical_domain(domain: Column) -> Column:
    """Lower case, without ``www.`` and outer dots; null if nothing is left."""
    d = _without_dots(F.regexp_replace(F.lower(F.trim(F.coalesce(domain, F.lit("")))), r"^www\.", ""))
    return F.when(d != "", d)


def registrable_root(host: Column) -> Column:
    """The last two labels; a host of one label is its own root."""
    return F.substring_index(host, ".", -2)


def host_suffixes(host: Column) -> Column:
    """The host and all its parents of at least two labels, the longest first."""
    labels = F.split(host, r"\.")
    n = F.size(labels)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.array_join(F.slice(labels, i, n), "."))).otherwise(F.array(host))


def under_any(host: Column, domains: list[str]) -> Column:
    """Whether the host or a parent of it (of at least two labels) is among ``domains``."""
    return F.arrays_overlap(host_suffixes(F.coalesce(host, F.lit(""))), F.array(*[F.lit(d) for d in domains]))


def email_domain(email: Column) -> Column:
    """What follows the last ``@``, lower case; null unless it has a dot."""
    d = F.lower(F.trim(F.substring_index(email, "@", -1)))
    return F.when(email.contains("@") & d.contains("."), d)


def valid_domain(domain: Column) -> Column:
    """Labels of letters, digits and inner hyphens, an alphabetic last label, and a letter somewhere."""
    label = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    return F.coalesce(domain.rlike(rf"(?i)^{label}(?:\.{label})+$") & domain.rlike(r"(?i)\.[a-z]{2,24}$") & domain.rlike("(?i)[a-z]"), F.lit(False))


def without_query(url: Column) -> Column:
    """The url up to its query or fragment."""
    return F.regexp_extract(url, r"^[^?#]*", 0)


def without_tracking(url: Column) -> Column:
    """The url without tracking parameters and fragment; other parameters keep their order and writing."""
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: ~F.lower(F.substring_index(p, "=", 1)).isin(*TRACKING_PARAMETERS))
    rest = F.array_join(kept, "&")
    return F.when(query == "", without_query(url)).otherwise(F.when(rest == "", without_query(url)).otherwise(F.concat(without_query(url), F.lit("?"), rest)))


def candidate_forms(url: Column) -> Column:
    """The forms under which a page may be stored, best first: as given, without tracking, bare, slash toggled, each with ``www.`` toggled."""
    bare = without_query(url)
    slash = F.when(bare.endswith("/"), F.regexp_replace(bare, r"/+$", "")).otherwise(F.concat(bare, F.lit("/")))
    forms = F.array(url, without_tracking(url), bare, slash)
    other = F.transform(forms, lambda u: F.when(u.rlike(r"(?i)^[a-z]+://www\."), F.regexp_replace(u, r"(?i)^([a-z]+://)www\.", "$1")).otherwise(F.regexp_replace(u, r"^([A-Za-z]+://)", "$1www.")))
    return F.array_distinct(F.concat(forms, other))


def host_checked(url: Column) -> Column:
    """As :func:`host_lookup`, without ``www.``, trimmed again after the cut; null for null."""
    h = _without_www(_bare(url))
    return F.when(url.isNotNull(), F.regexp_replace(F.trim(_until(h, "/?#")), r"\.+$", ""))


def valid_hostname(host: Column) -> Column:
    """Two or more labels of letters, digits and inner hyphens, the last of letters, at most 253 characters in all."""
    label = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    return F.coalesce(F.length(host).between(1, 253) & host.rlike(rf"^(?:{label}\.)+[a-z]{{2,63}}$"), F.lit(False))


def tells_nothing(host: Column, shared: list[str], providers: list[str]) -> Column:
    """Whether a host identifies nobody: none at all, one label, under a shared host, or a provider's own."""
    h = F.coalesce(host, F.lit(""))
    return ~h.contains(".") | under_any(h, shared) | h.isin(*providers)
