import random
import urllib.parse
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from nearby_engine.functions import classify, dates, geo, markup, text, urls


def column(spark, values, build, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.o for r in rows.select("i", build(F.col("v")).alias("o")).orderBy("i").collect()]


def test_resolve_agrees_with_the_standard_library(spark):
    bases = ["https://a.example/x/y/z?q=1#f", "http://b.example", "https://c.example/dir/", "https://d.example/p"]
    links = ["/r", "r", "../r", "./r", ".", "..", "?z", "#g", "//h/p", "mailto:a@b", "http://k/l", "r/../s", "../../../t", "/a/./b/../c", "x/y/../../z/.", "a//b"]
    for base in bases:
        mine = column(spark, links, lambda c: urls.resolve(c, F.lit(base)))
        assert mine == [urllib.parse.urljoin(base, link) for link in links], base


def test_casefold_agrees_with_the_standard_library(spark):
    values = ["Straße", "ΣΊΣΥΦΟΣ", "ﬁne", "İstanbul", "ŉ", "Ω Kelvin K", "ꭰᎠ", "plain", "ẞ", "ͅ"]
    assert column(spark, values, text.casefold) == [v.casefold() for v in values]


def test_normalized_name(spark):
    values = ["  Acme,  Labs & Söhne_2 (India) ", "***", "GROẞE Firma", "東京 株式会社", None]
    assert column(spark, values, text.normalized_name) == ["acme labs söhne_2 india", "", "grosse firma", "東京 株式会社", None]


def test_excerpt_cuts_and_decodes(spark):
    long = "<p>" + "ab " * 200 + "</p>"
    out = column(spark, ["<b>A&nbsp;&amp; B</b>\n c", "<br>", None, long, "x" * 300], text.clean_excerpt)
    assert out[0] == "A & B c" and out[1] is None and out[2] is None
    assert out[3].endswith("ab...") and len(out[3]) <= 303
    assert out[4] == "x" * 300


def test_trigram_similarity(spark):
    names = ["nova robotics", "nova robotic", "zzz", ""]
    out = column(spark, names, lambda c: text.trigram_similarity(c, "nova robotics"))
    assert out[0] == 1.0 and 0.8 <= out[1] < 1.0 and out[2] == 0.0 and out[3] == 0.0
    assert sorted(text.trigrams_of("ab c")) == sorted(["  a", " ab", "ab ", "  c", " c "])


ROLES = [
    ("Lead Android Developer", [], "software"),
    ("Embedded Engineer", [], "software"),
    ("Systems Engineer", [], "infrastructure"),
    ("Embedded Systems Engineer", [], "software"),
    ("Cloud Architect", ["Sales"], "infrastructure"),
    ("Solutions Architect", ["Inside Sales"], "product_engineering"),
    ("Hardware Engineer", ["Engineering"], "software"),
    ("Hardware Engineer", ["Gardens"], ""),
    ("Coordinator", ["Marketing"], ""),
    ("Coordinator", ["Deep Learning"], "data"),
    ("Mining Engineer", ["Software"], ""),
    ("Tier 2 Support", [], "technical_support"),
    ("Head of Data", [], "engineering_leadership"),
    ("", [], ""),
    (None, None, ""),
]


def test_roles(spark):
    rows = spark.createDataFrame([(i, t, c) for i, (t, c, _) in enumerate(ROLES)], "i int, t string, c array<string>")
    found = classify.with_role(rows, "t", "c").orderBy("i").collect()
    assert [r.role.classification for r in found] == [w for *_, w in ROLES]
    assert all(r.role.is_technical == bool(w) for r, (*_, w) in zip(found, ROLES))
    assert found[10].role.reasons == ["negative_rule:non_technical_engineer:mining engineer"]
    assert found[8].role.reasons == ["negative_rule_category:marketing:marketing"]
    assert found[13].role.reasons == ["no_technical_rules_matched"]


def test_recency_boundaries(spark):
    now = datetime(2026, 9, 27)
    ages = [timedelta(days=14), timedelta(days=14, seconds=1), timedelta(days=14, hours=23), timedelta(days=15), timedelta(days=-1)]
    rows = spark.createDataFrame([(i, now - a) for i, a in enumerate(ages)], "i int, p timestamp")
    as_of = F.lit("2026-09-27").cast("timestamp")
    out = rows.select(
        classify.publication_state(F.col("p"), F.col("p"), as_of).alias("a"),
        classify.publication_state(F.col("p"), F.col("p"), as_of, F.lit(False)).alias("b"),
        classify.page_publication_state(F.col("p"), as_of).alias("c"),
    ).collect()
    recent, stale, seen = "posted_recently", "stale", "observed_recently"
    assert [r.a for r in out] == [recent, stale, stale, stale, recent]
    assert [r.b for r in out] == [seen, stale, stale, stale, seen]
    assert [r.c for r in out] == [recent, recent, recent, stale, recent]
    none = F.lit(None).cast("timestamp")
    assert rows.select(classify.publication_state(none, none, as_of).alias("x")).first().x == seen


PUBLIC = {
    "https://www.shop.example:443/x?y#z": True, "http://8.8.4.4/": True, "http://[2606:4700::1]/": True,
    "ftp://a.example": False, "http://u:p@a.example": False, "https://localhost:1": False, "http://x.localhost": False,
    "http://127.9.9.9": False, "http://[::1]:80": False, "http://0.0.0.0": False, "http://0": False,
    "http://10.1.2.3": False, "http://172.20.0.1": False, "http://192.168.9.9:90": False, "http://169.254.0.9": False,
    "http://[fe80::7]": False, "http://[fd00::7]": False, "http://[::ffff:10.0.0.9]": False, "http://[2002:0a00:0009::]": False,
    "http://2130706433": False, "http://0x7f000001": False, "http://100.64.0.1": False, "http://224.0.0.1": False,
    "http://[64:ff9b::7f00:1]": False, "": False, "http://": False, "javascript:alert(1)": False,
}


def test_public_urls(spark):
    assert column(spark, list(PUBLIC), urls.is_public_url) == list(PUBLIC.values())


def test_site_policy(spark):
    cases = {
        "https://acme.example/": True, "https://www.acme.example/about-us": True, "https://acme.example/en/careers": True,
        "https://acme.example/products": False, "https://acme.example/login/jobs": False, "https://acme.example/jobs?next=cart": False,
        "https://sub.acme.example/jobs": False, "mailto:a@acme.example": False, "https://acme.example/index.html": True,
    }
    out = column(spark, list(cases), lambda c: urls.is_allowed_on_site(c, F.lit("WWW.acme.example")))
    assert out == list(cases.values())


def test_dates(spark):
    values = ["2026-01-02T03:04:05Z", "2026-01-02 03:04:05", "2026-01-02", "2026-01-02T03:04:05+05:30", "1767323045000", "1767323045", "soon", "", None]
    shown = column(spark, values, lambda c: dates.iso_z(dates.epoch_or_iso(c)))
    moment = "2026-01-02T03:04:05Z"
    assert shown == [moment, moment, "2026-01-02T00:00:00Z", "2026-01-01T21:34:05Z", moment, moment, None, None, None]
    seconds = [0, 42, 75, 60, 3600, 3900, 3661, -5]
    texts = ["0s", "42s", "1m 15s", "1m", "1h", "1h 5m", "1h 1m 1s", "0s"]
    assert column(spark, seconds, dates.duration_text, "long") == texts


def test_box_never_cuts_the_circle(spark):
    dice = random.Random(7)
    centers = [(12.9, 77.6), (89.99, 10.0), (-89.9, -170.0), (0.0, 179.99), (60.0, -179.99), (45.0, 0.0)]
    points = [(dice.uniform(-90, 90), dice.uniform(-180, 180)) for _ in range(300)]
    for lat, lng in centers:
        near = [(max(-90.0, min(90.0, lat + dice.gauss(0, 0.3))), (lng + dice.gauss(0, 0.5) + 180) % 360 - 180) for _ in range(300)]
        rows = spark.createDataFrame(points + near, "a double, b double")
        a, b = F.col("a"), F.col("b")
        inside = geo.distance_m(a, b, lat, lng) <= 50_000.0
        boxed = geo.in_box(a, b, lat, lng, 50_000.0)
        assert rows.filter(inside & ~boxed).count() == 0


def test_close_points_share_touching_cells(spark):
    dice = random.Random(3)
    rows = []
    for _ in range(400):
        lat, lng = dice.choice([(dice.uniform(-90, 90), dice.uniform(-180, 180)), (89.9999, dice.uniform(-180, 180)), (dice.uniform(-5, 5), 179.9999)])
        rows.append((lat, lng, max(-90.0, min(90.0, lat + dice.gauss(0, 0.003))), (lng + dice.gauss(0, 0.003) + 180) % 360 - 180))
    pairs = spark.createDataFrame(rows, "a double, b double, c double, d double")
    close = pairs.filter(geo.distance_m(F.col("a"), F.col("b"), F.col("c"), F.col("d")) <= 500.0)
    here, there = geo.sphere_cell(F.col("a"), F.col("b"), 500.5), geo.sphere_cell(F.col("c"), F.col("d"), 500.5)
    assert close.count() > 50
    assert close.filter(~F.array_contains(geo.touching_cells(here), there)).count() == 0


SHELLS = [
    ('<html><body><div id="root"></div><script>x()</script></body></html>', True),
    ('<app-root></app-root>', True),
    ('<noscript>Please enable JavaScript</noscript><div>hi</div>', True),
    ('<div id="root">' + "text " * 60 + "</div>", False),
    ("<p>short</p>", False),
    ("", False),
]


def test_script_shells(spark):
    assert column(spark, [p for p, _ in SHELLS], markup.needs_script_engine) == [w for _, w in SHELLS]


@pytest.mark.parametrize("scopes,expected", [(["GLOBAL", " IN ", "", "EMEA", "IN"], [("global", "GLOBAL"), ("country", "IN"), ("region", "EMEA")]), ([], [])])
def test_scopes(spark, scopes, expected):
    row = spark.createDataFrame([(scopes,)], "s array<string>").select(classify.remote_scopes(F.col("s")).alias("o")).first()
    assert [(s.scope_type, s.scope_code) for s in row.o] == expected
