"""Emails, phone numbers and payment handles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that extraction returns in place of an email.
EMAIL_PLACEHOLDERS = (
    "[email protected]", "[email redacted]", "[email]", "(email)", "email", "e-mail", "your email", "via email", "your email address", "me", "us", "info@", "contact@", "admin@",
    "[redacted]", "(redacted)", "example@example.com", "your_email_here", "name@example.com", "test@test.com", "user@example.com", "you@example.com",
)

# Formats of payment handles, and of what is mistaken for one.
HANDLE_FORMATS = {
    "BTC": r"^(?:bc1[ac-hj-np-z02-9]{8,87}|[13][a-km-zA-HJ-NP-Z1-9]{25,34})$",
    "ETH": r"^0x[a-fA-F0-9]{40}$",
    "IBAN": r"^[A-Z]{2}\d{2}[A-Z0-9]{4,30}$",
    "PayPal.me": r"(?i)^(?:https?://)?(?:www\.)?paypal\.me/[\w\-.]+/?$",
    "CashApp": r"^\$[A-Z]\w{2,20}$",
    "Venmo": r"^@[\w.-]{3,30}$",
}
NOT_HANDLES = (r"(?i)^\$?\d+(?:[.,]\d{1,2})?\s*(?:usd|eur|gbp|\$)?$", r"(?i)^(?:www\.)?[\w.-]+\.(?:org|com|net|io|co|us)/?$", r"^[A-Z]{3,4}$")


def _tidy(x: Column) -> Column:
    return F.lower(F.trim(F.coalesce(x, F.lit(""))))


def valid_email(email: Column) -> Column:
    """Shaped like an address and no placeholder."""
    e = _tidy(email)
    return e.rlike(r"^[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}$") & ~e.isin(*EMAIL_PLACEHOLDERS)


def lookup_email(email: Column) -> Column:
    """Short and well-formed enough for a reputation lookup."""
    return F.coalesce((F.length(email) <= 254) & email.rlike(r"(?i)^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}$"), F.lit(False))


def _email_key(email: Column, tags_everywhere: bool) -> Column:
    e = _tidy(email)
    local, host = F.substring_index(e, "@", 1), F.regexp_extract(e, r"^[^@]*@(.*)$", 1)
    untagged = F.substring_index(local, "+", 1)
    google = host.isin("gmail.com", "googlemail.com")
    name = F.when(google, F.replace(untagged, F.lit("."), F.lit(""))).otherwise(untagged if tags_everywhere else local)
    return F.when(e.contains("@") & (name != ""), F.concat(name, F.lit("@"), F.when(google, F.lit("gmail.com")).otherwise(host)))


def email_key(email: Column) -> Column:
    """Key of a mailbox: ``+tag`` dropped; at Gmail also dots and the second host name. Null without a local part."""
    return _email_key(email, True)


def email_key_live(email: Column) -> Column:
    """As :func:`email_key`, but other hosts keep their ``+tag``."""
    return _email_key(email, False)


def phone_digits(phone: Column) -> Column:
    return F.regexp_replace(F.coalesce(phone, F.lit("")), r"[^0-9]", "")


def phone_key(phone: Column) -> Column:
    """The digits of a plausible number: 7 to 15, not mostly leading zeros; else null."""
    d = phone_digits(phone)
    zeros = F.length(d) - F.length(F.regexp_replace(d, "^0+", ""))
    return F.when(F.length(d).between(7, 15) & ~((zeros >= 3) & (zeros >= F.floor(F.length(d) / 2))), d)


def is_noise(handle: Column) -> Column:
    """Whether a handle is blank, a sum of money, a bare domain or a currency code; null is noise."""
    h = F.trim(F.coalesce(handle, F.lit("")))
    noise = h == ""
    for pattern in NOT_HANDLES:
        noise = noise | h.rlike(pattern)
    return noise


def handle_kind(handle: Column) -> Column:
    """Which payment system a handle belongs to; null for anything else."""
    h = F.trim(F.coalesce(handle, F.lit("")))
    kind = F.when(F.lit(False), F.lit(None).cast("string"))
    for pattern in NOT_HANDLES:
        kind = kind.when(h.rlike(pattern), F.lit(None).cast("string"))
    for name, pattern in HANDLE_FORMATS.items():
        kind = kind.when(h.rlike(pattern), F.lit(name))
    return kind


def payment_key(kind: Column, value: Column) -> Column:
    """``kind:value`` in lower case, without leading signs."""
    v = F.regexp_replace(_tidy(value), r"^[@$]+", "")
    return F.when((kind != "") & (v != ""), F.concat(kind, F.lit(":"), v))
