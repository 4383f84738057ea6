import json

from pyspark.sql import functions as F

from nearby_engine.operators.crawl import walk
from nearby_engine.sources import boards, directory, osm, registry, site, structured
from nearby_engine.sources.evidence import to_batches

AS_OF = "2026-09-27 00:00:00"


def payloads(spark, pages):
    rows = [(t, p, json.dumps(body) if not isinstance(body, str) else body) for t, p, body in pages]
    return spark.createDataFrame(rows, "token string, page int, payload string")


def listed(spark, *tokens):
    return spark.createDataFrame([(t, None, f"{t}.example") for t in tokens], "token string, company_name string, company_domain string")


def test_all_landed_board_pages_are_read(spark):
    dev = lambda i: {"id": i, "title": "Backend Developer", "updated_at": "2026-09-20T00:00:00Z", "location": {"name": "Remote"}}
    pages = payloads(spark, [
        ("a", 1, {"jobs": [dev(1), {"id": 2, "title": "Account Executive"}]}), ("a", 2, {"jobs": [dev(1)]}), ("a", 3, {"jobs": [dev(9)]}),
        ("b", 1, [dev(1)]), ("b", 2, "oops"), ("c", 1, {"jobs": []}), ("d", 11, {"jobs": [dev(5)]}),
    ])
    found = boards.greenhouse_jobs(pages, listed(spark, *"abcd"), AS_OF).collect()
    assert sorted((r.page, r.source_job_id) for r in found) == [("a", "1"), ("a", "9"), ("b", "1"), ("d", "5")]
    assert {(r.work_arrangement, r.publication_state, r.company_name) for r in found if r.page == "a"} == {("remote", "posted_recently", "a")}
    assert boards.greenhouse_companies(listed(spark, *"abcd")).count() == 4


def test_lever_dates_and_categories(spark):
    base = {"text": "Data Engineer", "categories": {"team": "Data", "location": "Pune", "workplaceType": "on-site"}}
    pages = payloads(spark, [("s", 1, [
        {**base, "id": "a", "createdAt": 1789948800000}, {**base, "id": "b", "createdAt": 1789948800}, {**base, "id": "c", "createdAt": "2026-09-21T00:00:00Z"},
        {**base, "id": "d"}, {"id": "e", "text": "Accountant", "categories": {}},
    ])])
    found = {r.source_job_id: r for r in boards.lever_jobs(pages, listed(spark, "s"), AS_OF).collect()}
    assert set(found) == set("abcd")
    assert {found[k].posted_at for k in "abc"} == {"2026-09-21T00:00:00Z"} and found["d"].posted_at is None
    assert found["d"].publication_state == "observed_recently" and found["a"].work_arrangement == "in_office"


def test_map_elements(spark):
    extract = {"elements": [
        {"type": "node", "id": 1, "lat": 12.97, "lon": 77.59, "tags": {"name": "Node Co", "office": "it", "website": "www.Node.example/x"}},
        {"type": "way", "id": 2, "center": {"lat": 12.98, "lon": 77.6}, "tags": {"brand": "Way Co", "office": "company", "addr:city": "Pune", "addr:street": "M G"}},
        {"type": "node", "id": 3, "lat": 12.97, "lon": 77.59, "tags": {"office": "it"}}, {"type": "node", "id": 4, "tags": {"name": "No point", "office": "it"}},
    ]}
    elements = osm.elements_of(spark.createDataFrame([(json.dumps(extract),)], "payload string"))
    found = {r.name: r for r in osm.osm_companies(osm.candidates(elements, 12.97, 77.59, 15)).collect()}
    assert set(found) == {"Node Co", "Way Co"}
    assert found["Node Co"].domain == "node.example" and found["Way Co"].address == "M G, Pune" and found["Way Co"].lat == 12.98
    assert osm.candidates(elements, None, None).count() == 0 and osm.candidates(elements, 0, 0, 1).count() == 0


def test_structured_data(spark):
    def script(body, kind="application/ld+json"):
        return f'<script type="{kind}">{body if isinstance(body, str) else json.dumps(body)}</script>'

    html = "<html>" + script("{bad") + script({"@type": "Organization", "name": "Acme", "url": "/home", "geo": {"latitude": "91", "longitude": 1}}) + script(
        {"@graph": [{"@type": ["Thing", "https://schema.org/JobPosting"], "title": "Remote Dev", "hiringOrganization": "Acme", "jobLocation": [{"address": "Pune"}], "datePosted": "2026-09-20"}]},
        "application/ld+json; charset=utf-8",
    ) + script({"@type": ["Organization", "JobPosting"], "title": "Skipped with its nameless company"}) + script({"@type": "JobPosting", "title": 5}) + "</html>"
    entities = structured.page_entities(spark.createDataFrame([("https://www.acme.example/p", html), ("https://b.example/", "<p></p>")], "url string, html string"))
    companies = structured.structured_companies(entities).collect()
    jobs = structured.structured_jobs(entities, AS_OF).collect()
    assert [(c.name, c.evidence_url, c.domain, c.lat) for c in companies] == [("Acme", "https://www.acme.example/home", "acme.example", None)]
    assert [(j.title, j.company_name, j.location_raw, j.work_arrangement, j.publication_state) for j in jobs] == [("Remote Dev", "Acme", "Pune", "remote", "posted_recently")]


def test_directory_selectors(spark):
    card = '<div class="card x" data-id="{0}"><h3 class="t">{1}</h3><p><a class="d" href="/co/{0}">more</a></p></div>'
    pages = [("d", 1, "https://dir.example/1", card.format(1, "One &amp; Co") + card.format(2, " ")), ("d", 2, "https://dir.example/2", "<p>none</p>"), ("d", 3, "https://dir.example/3", card.format(3, "Late"))]
    selectors = {"card": ".card", "name": "h3.t::text", "source_record_id": "::attr(data-id)", "detail_url": "css:p a.d::attr(href)"}
    frame = spark.createDataFrame(pages, "directory_id string, page int, url string, html string")
    cards = directory.page_cards(frame, selectors)
    details = spark.createDataFrame([("https://dir.example/co/1", '<i class="lat">12.5</i><i class="lng">200</i><b>New Road</b>')], "url string, html string")
    found = directory.directory_companies(cards, details, {"lat": ".lat::text", "lng": ".lng::text", "address": "b::text"}).collect()
    assert sorted((r.name, r.source_record_id, r.address, r.lat, r.lng, r.evidence_url) for r in found) == [
        ("Late", "3", "", None, None, "https://dir.example/co/3"), ("One & Co", "1", "New Road", 12.5, None, "https://dir.example/co/1"),
    ]


def test_walk_keeps_breadth_first_order_to_the_end(spark):
    home = "https://s.example/"
    link = lambda n: f'<a href="{n}">x</a>'
    pages = [(home, link("/jobs/1") + link("/jobs/2") + link("/cart") + link("https://other.example/jobs"))]
    pages += [(f"https://s.example/jobs/{i}", link(f"/jobs/{i}a") + link(f"/jobs/{i}b") + link("/jobs/1")) for i in (1, 2)]
    pages += [("https://s.example/jobs/1a", link("/jobs/too-deep"))]
    frame = spark.createDataFrame(pages, "url string, html string")
    seeds = spark.createDataFrame([(home,), ("https://lone.example/",)], "seed string")
    seen = [(r.url.removeprefix(home), r.depth, r.visit) for r in walk(seeds, frame).filter(F.col("seed") == home).orderBy("visit").collect()]
    assert seen == [("", 0, 1), ("jobs/1", 1, 2), ("jobs/2", 1, 3), ("jobs/1a", 2, 4), ("jobs/1b", 2, 5), ("jobs/2a", 2, 6), ("jobs/2b", 2, 7), ("jobs/too-deep", 3, 8)]
    assert walk(seeds, frame, max_depth=2).filter(F.col("seed") == home).count() == 7
    few = walk(seeds, frame, max_pages=4).filter(F.col("seed") == home)
    assert few.count() == 4 and few.agg(F.max("visit")).first()[0] == 4
    maps = spark.createDataFrame([(home, "<urlset><url><loc>https://s.example/team</loc></url><url><loc>https://x.example/team</loc></url></urlset>")], "seed string, xml string")
    first = walk(seeds, frame, maps).filter((F.col("seed") == home) & (F.col("visit") == 2)).first()
    assert first.url == "https://s.example/team"


def test_stages_and_registry(spark, tmp_path):
    page = '<html><head><title>Acme - home</title></head><a href="https://jobs.lever.co/acme">jobs</a></html>'
    pages = spark.createDataFrame([("https://acme.example", page)], "url string, html string")
    candidates = spark.createDataFrame([("run1", "www.acme.example", "Acme Known", 1)], "discovery_job_id string, domain string, name string, seq int")
    posted = payloads(spark, [("acme", 1, [{"id": "j", "text": "Backend Developer", "categories": {}}])])
    configured = spark.createDataFrame([], registry.BOARD_FIELDS)
    found = registry.gather(candidates, pages, configured, {"lever": posted}, F.lit(AS_OF).cast("timestamp"))
    assert [c.name for c in found.site_rows[0].collect()] == ["Acme"]
    assert [(t.provider, t.token, t.company_name) for t in found.targets.collect()] == [("lever", "acme", "Acme Known")]
    assert [j.company_name for j in found.board_rows["lever"][1].collect()] == ["Acme Known"]

    (tmp_path / "pages" / "tok").mkdir(parents=True)
    (tmp_path / "boards.json").write_text(json.dumps({"provider": "greenhouse", "token": "tok", "company_domain": "tok.example"}))
    (tmp_path / "pages" / "tok" / "1.json").write_text(json.dumps({"jobs": [{"id": 7, "title": "Data Engineer"}]}))
    batches = registry.ADAPTERS["greenhouse"](spark, str(tmp_path), F.lit(AS_OF).cast("timestamp"))
    row = batches.collect()
    assert sum(len(b.companies) for b in row) == 1 and sum(len(b.jobs) for b in row) == 1
    assert {b.source_family for b in row} == {"job_ats"}


def test_homepage_fallback_only_without_structured_company(spark):
    with_data = '<title>X</title><script type="application/ld+json">{"@type":"Organization","name":"Named"}</script>'
    plain = '<title>Shop | City</title><address>1 Road <br> Pune</address><a href="tel:+91 7">c</a>'
    pages = spark.createDataFrame(
        [("https://a.example/", with_data, 0, 1), ("https://b.example/", plain, 0, 1), ("https://b.example/about", plain, 1, 2)],
        "url string, html string, depth int, visit int",
    )
    found = sorted((r.name, r.address, r.phone) for r in site.site_companies(pages).collect())
    assert found == [("Named", "", None), ("Shop", "1 Road Pune", "+91 7")]


def test_records_are_made_once_and_packed(spark):
    """Page sizes and batches are read from the records as written, not made from the pages twice."""
    companies = spark.range(120).select(
        F.lit("p").alias("page"), F.concat(F.lit("N"), F.col("id").cast("string")).alias("name"), *[F.lit(None).cast(k).alias(n) for n, k in (
            ("source_record_id", "string"), ("evidence_url", "string"), ("domain", "string"), ("address", "string"), ("lat", "double"), ("lng", "double"),
            ("phone", "string"), ("metadata", "string"))],
    ).withColumn("content_hash", F.sha2(F.concat(F.lit("made"), "name"), 256))
    packed = to_batches(companies, registry.no_rows(spark, "job"), "s", "f", F.lit("r"), F.current_timestamp())
    assert "made" not in packed._jdf.queryExecution().executedPlan().toString()
    assert packed.agg(F.sum(F.size("companies"))).first()[0] == 120
