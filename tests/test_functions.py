"""Column functions on hand-made rows."""

from __future__ import annotations

import math
import re

import pytest
from pyspark.sql import functions as F

from quernstone.functions import contact as C
from quernstone.functions import text as T
from quernstone.functions import url as U


def each(spark, function, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in df.select("i", function(F.col("v")).alias("o")).orderBy("i").collect()]


URLS = ["https://www.Example.com/a/", "HTTP://example.com:8080/a?q=1#f", "example.com#f", "www.example.com.", None, ""]


@pytest.mark.parametrize(
    "function, wanted",
    [
        (U.normalize_url, ["example.com/a", "example.com:8080/a?q=1#f", "example.com#f", "example.com.", "", ""]),
        (U.host_detector, ["example.com", "example.com", "example.com#f", "example.com.", "", ""]),
        (U.host_lookup, ["www.example.com", "example.com:8080", "example.com", "www.example.com", "", ""]),
        (U.host_enriched, ["example.com", "example.com:8080", "example.com", "example.com", "", ""]),
        (U.host_full, ["example.com", "example.com:8080", "example.com", "example.com", None, None]),
        (U.host_parsed, ["example.com", "example.com", "", "", "", ""]),
    ],
)
def test_hosts_differ_where_their_sources_do(spark, function, wanted):
    assert each(spark, function, URLS) == wanted


def test_suffixes_and_membership(spark):
    assert each(spark, U.host_suffixes, ["a.b.c.d", "b.c", "c"]) == [["a.b.c.d", "b.c.d", "c.d"], ["b.c"], ["c"]]
    assert each(spark, lambda c: U.under_any(c, ["example.com"]), ["example.com", "x.y.example.com", "notexample.com", None]) == [True, True, False, False]


def test_candidate_forms(spark):
    (forms,) = each(spark, U.candidate_forms, ["https://a.com/x?utm_source=m&id=1#f"])
    assert forms == [
        "https://a.com/x?utm_source=m&id=1#f", "https://a.com/x?id=1", "https://a.com/x", "https://a.com/x/",
        "https://www.a.com/x?utm_source=m&id=1#f", "https://www.a.com/x?id=1", "https://www.a.com/x", "https://www.a.com/x/",
    ]


def test_valid_domains(spark):
    assert each(spark, U.valid_domain, ["a.com", "a-b.co.uk", "-a.com", "0918.912.3095", "a", None, "x" * 64 + ".com"]) == [True, True, False, False, False, False, False]


def test_email_keys(spark):
    emails = ["A.b+x@Gmail.com", "ab@googlemail.com", "a.b+x@host.org", "+x@host.org", "nobody", None, "x@y@z.com"]
    assert each(spark, C.email_key, emails) == ["ab@gmail.com", "ab@gmail.com", "a.b@host.org", None, None, None, "x@y@z.com"]
    assert each(spark, C.email_key_live, emails)[2] == "a.b+x@host.org"
    assert each(spark, C.valid_email, ["a@b.co", "test@test.com", "[email]", "a@b", None]) == [True, False, False, False, False]


def test_phone_keys(spark):
    assert each(spark, C.phone_key, ["555-0100", "12345", "+1 (555) 010-0100", "1234567890123456", "000012", "0001234567", None]) == ["5550100", None, "15550100100", None, None, "0001234567", None]
    assert each(spark, C.phone_key, ["0000123", "00001234567"]) == [None, "00001234567"]


def test_handle_kinds(spark):
    handles = ["$50.00", "example.com", "USD", "$Cash_tag", "@some.one", "paypal.me/abc", "0x" + "a" * 40, "GB29NWBK60161331926819", "1BoatSLRHtKNngkdXEeobR76b53LETtpyT", "", None]
    assert each(spark, C.handle_kind, handles) == [None, None, None, "CashApp", "Venmo", "PayPal.me", "ETH", "IBAN", "BTC", None, None]


def test_amounts(spark):
    texts = ["1,234.50", "$5", "1.234,50 EUR", "12.345", "1 234", "", "n/a", "abc", None, "€ 1’000.5", "7,5", "-3.20", "1,234,567"]
    assert each(spark, T.amount, texts) == [1234.5, 5.0, 1234.5, 12345.0, 1234.0, None, None, None, None, 1000.5, 7.5, -3.2, 1234567.0]


def test_wordings_count_once(spark):
    texts = ["Send it by Western Union or western union", "my venmo @abc_d thanks", "wire transfer to GB29NWBK60161331926819", "mail@venmo.com", None]
    assert each(spark, T.wording_hits, texts) == [1, 1, 2, 0, 0]


def test_html(spark):
    assert each(spark, T.without_html, ["<p>a &amp;lt; b</p>\n<br>c&nbsp;d", None]) == ["a &lt; b c d", None]
    assert each(spark, T.with_link_targets, ['see <a class="x" href="https://a.com/b">us</a> or <a href="/c">here</a>']) == ["see us [https://a.com/b] or here"]


def test_style_vector_matches_a_plain_one(spark):
    text = "We need help. I and my sister lost it! Why us? They took the house... Please give to the poor and the old, for this is that they want in a time of need it seems with you."
    words = re.findall(r"\w+", text.lower())
    parts = [s for s in re.split(r"[.!?]+\s+", text) if s.split()]
    first, third = (sum(w in x for w in words) for x in (T.FIRST_PERSON, T.THIRD_PERSON))
    raw = [
        sum(len(s.split()) for s in parts) / len(parts), len(set(words)) / len(words), text.count("!") / len(text), text.count("...") / len(text), text.count("?") / len(text),
        sum(c.isupper() for c in text) / len(text), first / (first + third), *[words.count(w) / len(words) for w in T.STYLE_WORDS],
    ]
    norm = math.sqrt(sum(x * x for x in raw))
    got, short = each(spark, T.style_vector, [text, "too short"])
    assert short is None and got == pytest.approx([x / norm for x in raw])


def test_lists_and_keys(spark):
    assert each(spark, T.distinct_ignoring_case, [["A", "a ", "b", "", "B", "c"], [], None], "array<string>") == [["A", "b", "c"], [], None]
    assert each(spark, T.token_key, ["Bob de la Cruz", "B. Cruz", "Cruz Cruz", None]) == ["bob cruz de la", None, "cruz cruz", None]
    assert each(spark, T.answer, ["Yes", " no", "maybe", None]) == ["yes", "no", "unclear", "unclear"]
