"""Registered queries: radius search, clusters and per-company reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearby_engine.functions import geo, text
from nearby_engine.operators import clusters, offices, search, text_index
from nearby_engine.plans.catalog import CATALOG, register, sql_distance, sql_similarity
from nearby_engine.plans.views import AS_OF, CENTER, RADIUS_M, derive, search_tables, with_views
from nearby_engine.session import fresh_folder

LAT, LNG = CENTER
SINCE = f"TIMESTAMP '{AS_OF}' - INTERVAL 14 DAY"
FROM_CENTER = sql_distance(f"{LAT}e0", f"{LNG}e0", "lat", "lng")
JOB_FROM_CENTER = sql_distance(f"{LAT}e0", f"{LNG}e0", "latitude", "longitude")
VIEWPORT = (77.45, 12.85, 77.75, 13.05)

TRUSTED = f"""is_active AND posted_at IS NOT NULL AND posted_at >= {SINCE}
  AND (publication_state = 'posted_recently'
    OR (posted_at_confidence > 0 AND publication_state NOT IN ('observed_recently', 'stale')))"""

HIRING = f"""hiring AS (SELECT company_id, count(*) AS n, string_agg(DISTINCT work_arrangement, ',' ORDER BY work_arrangement) AS kinds
  FROM v_jobs WHERE {TRUSTED} GROUP BY company_id)"""


def _found(extra: str = "") -> str:
    return f"""found AS (SELECT o.*, c.name, c.normalized_name, c.domain, c.industry, c.employee_count, {FROM_CENTER} AS d
  FROM v_locations o JOIN v_companies c ON c.id = o.company_id
  WHERE o.presence_type <> 'job_location_only' {extra}), near AS (SELECT * FROM found WHERE d <= {RADIUS_M})"""


def _matches(query: str, name: str = "c.name", normalized: str = "c.normalized_name") -> str:
    return f"({name} ILIKE '%{query}%' OR {sql_similarity(normalized, repr(query))} >= 0.3)"


OFFICE_PAGE = """SELECT o.company_id, o.name, o.domain, o.industry, o.employee_count, o.id AS location_id, o.label,
  o.address, o.city, o.lat, o.lng, o.confidence, round(o.d, 2) AS distance_m, o.presence_type,
  coalesce(h.n, 0) AS recent_technical_job_count, coalesce(h.kinds, '') AS arrangements, o.verified
  FROM near o LEFT JOIN hiring h ON h.company_id = o.company_id ORDER BY o.d, o.id"""


def _shown(page: DataFrame) -> DataFrame:
    return page.withColumns(
        {"distance_m": F.round("distance_m", 2), "arrangements": F.array_join("arrangements", ",")}
    )


@register(
    "office_search",
    with_views(["companies", "locations", "jobs"], f", {HIRING}, {_found()} {OFFICE_PAGE} LIMIT 50"),
)
def office_search(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(search.search_offices(search_tables(spark, folder), LAT, LNG, RADIUS_M, AS_OF))


FILTERED = "AND o.confidence >= 0.2 AND c.industry ILIKE '%u%i%' AND " + _matches("nova robo")


@register(
    "office_search_filtered",
    with_views(
        ["companies", "locations", "jobs"], f", {HIRING}, {_found(FILTERED)} {OFFICE_PAGE} LIMIT 20 OFFSET 1"
    ),
)
def office_search_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(
        search.search_offices(
            search_tables(spark, folder), LAT, LNG, RADIUS_M, AS_OF,
            min_confidence=0.2, industry="u%i", query="nova robo", limit=20, offset=1,
        )
    )


def _indexed(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The search tables with postings of company names and job titles, written as an index is."""
    t = search_tables(spark, folder)
    for name, rows, similar_by, held_by in (
        (search.COMPANY_POSTINGS, t["companies"], "normalized_name", "name"), (search.JOB_POSTINGS, t["jobs"], "normalized_title", "title"),
    ):
        path = fresh_folder(spark, name)
        text_index.write_postings(text_index.postings(rows, "id", similar_by, held_by), path)
        t[name] = text_index.read_postings(spark, path, dict(rows.dtypes)["id"])
    return t


@register("office_search_by_postings", CATALOG["office_search_filtered"].sql)
def office_search_by_postings(spark: SparkSession, folder: str) -> DataFrame:
    return _shown(
        search.search_offices(
            _indexed(spark, folder), LAT, LNG, RADIUS_M, AS_OF,
            min_confidence=0.2, industry="u%i", query="nova robo", limit=20, offset=1,
        )
    )


@register(
    "office_count",
    with_views(
        ["companies", "locations"],
        f", {_found()}, {_found(FILTERED).replace('found AS', 'found2 AS').replace('near AS', 'near2 AS').replace('FROM found ', 'FROM found2 ')}"
        " SELECT 'all' AS scope, count(*) AS total FROM near UNION ALL SELECT 'filtered', count(*) FROM near2",
    ),
)
def office_count(spark: SparkSession, folder: str) -> DataFrame:
    t = search_tables(spark, folder)
    every = search.count_offices(t, LAT, LNG, RADIUS_M)
    some = search.count_offices(t, LAT, LNG, RADIUS_M, min_confidence=0.2, industry="u%i", query="nova robo")
    return every.select(F.lit("all").alias("scope"), "total").unionByName(
        some.select(F.lit("filtered").alias("scope"), "total")
    )


SEARCHABLE = f"""is_active AND work_arrangement <> 'remote' AND publication_state = 'posted_recently'
  AND posted_at IS NOT NULL AND posted_at >= {SINCE} AND posted_at_confidence > 0"""

NEAREST = f"""located AS (SELECT *, {JOB_FROM_CENTER} AS d FROM v_job_locations
  WHERE is_active AND latitude IS NOT NULL AND longitude IS NOT NULL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY d, ordinal) AS rn FROM located WHERE d <= {RADIUS_M}),
nearest AS (SELECT * FROM ranked WHERE rn = 1)"""

JOB_PAGE = """SELECT j.id, j.company_id, c.name AS company_name, c.domain AS company_domain, j.title, j.normalized_title,
  j.canonical_url, j.source, j.source_family, n.location_raw, n.latitude AS lat, n.longitude AS lng,
  round(n.d, 2) AS distance_m, j.work_arrangement, j.publication_state,
  strftime(j.posted_at, '%Y-%m-%d') AS posted_on, j.posted_at_confidence
  FROM v_jobs j JOIN nearest n ON n.job_id = j.id JOIN v_companies c ON c.id = j.company_id"""

JOB_COLUMNS = [
    "id", "company_id", "company_name", "company_domain", "title", "normalized_title", "canonical_url", "source",
    "source_family", "location_raw", "lat", "lng", "distance_m", "work_arrangement", "publication_state",
    "posted_on", "posted_at_confidence",
]


def _job_page(page: DataFrame) -> DataFrame:
    return page.withColumns(
        {"distance_m": F.round("distance_m", 2), "posted_on": F.date_format("posted_at", "yyyy-MM-dd")}
    ).select(JOB_COLUMNS)


@register(
    "job_search",
    with_views(
        ["companies", "jobs", "job_locations"],
        f", {NEAREST} {JOB_PAGE} WHERE {SEARCHABLE.replace('is_active', 'j.is_active')} ORDER BY n.d, j.posted_at DESC, j.id LIMIT 100",
    ),
)
def job_search(spark: SparkSession, folder: str) -> DataFrame:
    return _job_page(search.search_jobs(search_tables(spark, folder), LAT, LNG, RADIUS_M, AS_OF, limit=100))


JOB_QUERY = (
    f"{SEARCHABLE.replace('is_active', 'j.is_active')} AND j.work_arrangement = 'in_office' "
    f"AND (j.title ILIKE '%engineer%' OR {sql_similarity('j.normalized_title', repr('engineer'))} >= 0.3 OR c.name ILIKE '%engineer%')"
)


@register(
    "job_search_filtered",
    with_views(
        ["companies", "jobs", "job_locations"],
        f", {NEAREST} {JOB_PAGE} WHERE {JOB_QUERY} ORDER BY n.d, j.posted_at DESC, j.id LIMIT 30 OFFSET 3",
    ),
)
def job_search_filtered(spark: SparkSession, folder: str) -> DataFrame:
    return _job_page(
        search.search_jobs(
            search_tables(spark, folder), LAT, LNG, RADIUS_M, AS_OF,
            query="engineer", arrangement="in_office", limit=30, offset=3,
        )
    )


@register("job_search_by_postings", CATALOG["job_search_filtered"].sql)
def job_search_by_postings(spark: SparkSession, folder: str) -> DataFrame:
    return _job_page(
        search.search_jobs(
            _indexed(spark, folder), LAT, LNG, RADIUS_M, AS_OF,
            query="engineer", arrangement="in_office", limit=30, offset=3,
        )
    )


@register(
    "job_count",
    with_views(
        ["companies", "jobs", "job_locations"],
        f", {NEAREST} SELECT count(*) AS total FROM v_jobs j JOIN v_companies c ON c.id = j.company_id "
        f"WHERE {SEARCHABLE} AND EXISTS (SELECT 1 FROM located l WHERE l.job_id = j.id AND l.d <= {RADIUS_M})",
    ),
)
def job_count(spark: SparkSession, folder: str) -> DataFrame:
    return search.count_jobs(search_tables(spark, folder), LAT, LNG, RADIUS_M, AS_OF)


@register(
    "company_jobs",
    with_views(
        ["jobs", "job_locations"],
        f""", first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ordinal, location_raw) AS rn
        FROM v_job_locations WHERE is_active) WHERE rn = 1)
        SELECT j.id, j.company_id, j.title, coalesce(f.location_raw, '') AS location_raw, f.latitude AS lat,
        f.longitude AS lng, strftime(coalesce(j.posted_at, j.last_seen_at), '%Y-%m-%d') AS shown_on
        FROM v_jobs j LEFT JOIN first f ON f.job_id = j.id
        WHERE j.is_active AND coalesce(j.posted_at, j.last_seen_at) >= {SINCE}""",
    ),
)
def company_jobs(spark: SparkSession, folder: str) -> DataFrame:
    since = F.lit(AS_OF).cast("timestamp") - F.make_dt_interval(F.lit(14))
    found = search.company_jobs(search_tables(spark, folder), since=since)
    shown = F.date_format(F.coalesce("posted_at", "last_seen_at"), "yyyy-MM-dd")
    return found.select("id", "company_id", "title", "location_raw", "lat", "lng", shown.alias("shown_on"))


@register(
    "company_hiring",
    with_views(["jobs"], f", {HIRING} SELECT company_id, n AS recent_technical_job_count, kinds AS arrangements FROM hiring"),
)
def company_hiring(spark: SparkSession, folder: str) -> DataFrame:
    hiring = search.company_hiring(search_tables(spark, folder)["jobs"], AS_OF)
    return hiring.withColumn("arrangements", F.array_join("arrangements", ","))


@register(
    "company_offices",
    with_views(
        ["companies", "locations"],
        " SELECT c.id AS company_id, c.name, o.id AS location_id, o.label, o.address, o.city, o.lat, o.lng, "
        "o.confidence, o.presence_type, o.verified FROM v_companies c JOIN v_locations o ON o.company_id = c.id",
    ),
)
def company_offices(spark: SparkSession, folder: str) -> DataFrame:
    t = search_tables(spark, folder)
    places = search.company_offices(t).withColumnRenamed("id", "location_id")
    return t["companies"].select(F.col("id").alias("company_id"), "name").join(places, "company_id")


@register(
    "company_sightings",
    with_views(
        ["sightings"],
        " SELECT id, company_id, source, source_url, strftime(scraped_at, '%Y-%m-%d %H:%M:%S') AS scraped_at, metadata "
        "FROM v_sightings",
    ),
)
def company_sightings(spark: SparkSession, folder: str) -> DataFrame:
    found = search.company_sightings(search_tables(spark, folder))
    return found.withColumn("scraped_at", F.date_format("scraped_at", "yyyy-MM-dd HH:mm:ss"))


@register(
    "company_sources",
    with_views(
        ["sightings"],
        " SELECT company_id, lower(source) AS source, count(*) AS sightings, "
        "arg_max(source_url, (scraped_at, -id)) FILTER (WHERE source_url IS NOT NULL) AS first_url "
        "FROM v_sightings GROUP BY company_id, lower(source)",
    ),
)
def company_sources(spark: SparkSession, folder: str) -> DataFrame:
    return search.company_sources(search_tables(spark, folder)["sightings"])


@register(
    "company_first_last_seen",
    with_views(
        ["sightings"],
        " SELECT company_id, strftime(min(scraped_at), '%Y-%m-%d %H:%M:%S') AS first_seen, "
        "strftime(max(scraped_at), '%Y-%m-%d %H:%M:%S') AS last_seen FROM v_sightings GROUP BY company_id",
    ),
)
def company_first_last_seen(spark: SparkSession, folder: str) -> DataFrame:
    shown = "yyyy-MM-dd HH:mm:ss"
    return search_tables(spark, folder)["sightings"].groupBy("company_id").agg(
        F.date_format(F.min("scraped_at"), shown).alias("first_seen"),
        F.date_format(F.max("scraped_at"), shown).alias("last_seen"),
    )


def _cells(zoom: int) -> tuple[str, str]:
    size = f"(40075016.68557849e0 / {float(1 << zoom)}e0)"
    x = f"floor(radians(lng) * 6378137.0e0 / {size})"
    y = f"floor(ln(tan(pi() / 4 + radians(greatest(least(lat, 85.05112878e0), -85.05112878e0)) / 2)) * 6378137.0e0 / {size})"
    return x, y


def _grid_sql(zoom: int, extra: str = "") -> str:
    x, y = _cells(zoom)
    west, south, east, north = VIEWPORT
    box = f"AND lng BETWEEN {west} AND {east} AND lat BETWEEN {south} AND {north} {extra}"
    return f""", {_found(box)}, grouped AS (SELECT {x} AS cell_x, {y} AS cell_y, count(*) AS n, avg(lat) AS lat, avg(lng) AS lng,
  min(lng) AS west, min(lat) AS south, max(lng) AS east, max(lat) AS north FROM near GROUP BY 1, 2),
  numbered AS (SELECT *, row_number() OVER (ORDER BY n DESC, cell_x, cell_y) - 1 AS cluster_id FROM grouped)"""


@register(
    "cluster_grid",
    with_views(
        ["companies", "locations"],
        _grid_sql(14)
        + " SELECT cluster_id, n AS count, round(lat, 6) AS lat, round(lng, 6) AS lng, west, south, east, north FROM numbered",
    ),
)
def cluster_grid(spark: SparkSession, folder: str) -> DataFrame:
    cells = clusters.cluster_grid(search_tables(spark, folder), LAT, LNG, RADIUS_M, *VIEWPORT, zoom=14)
    return cells.withColumns({"lat": F.round("lat", 6), "lng": F.round("lng", 6)})


@register(
    "cluster_grid_query",
    with_views(
        ["companies", "locations"],
        _grid_sql(12, "AND " + _matches("cedar pay"))
        + " SELECT cluster_id, n AS count, round(lat, 6) AS lat, round(lng, 6) AS lng FROM numbered",
    ),
)
def cluster_grid_query(spark: SparkSession, folder: str) -> DataFrame:
    cells = clusters.cluster_grid(
        search_tables(spark, folder), LAT, LNG, RADIUS_M, *VIEWPORT, zoom=12, query="cedar pay"
    )
    return cells.select("cluster_id", "count", F.round("lat", 6).alias("lat"), F.round("lng", 6).alias("lng"))


@register(
    "cluster_grid_totals",
    with_views(
        ["companies", "locations"],
        _grid_sql(13) + " SELECT count(*) AS cluster_count, CAST(sum(n) AS BIGINT) AS total_points FROM numbered",
    ),
)
def cluster_grid_totals(spark: SparkSession, folder: str) -> DataFrame:
    cells = clusters.cluster_grid(search_tables(spark, folder), LAT, LNG, RADIUS_M, *VIEWPORT, zoom=13)
    return clusters.cluster_totals(cells)


@register("cluster_kmeans")
def cluster_kmeans(spark: SparkSession, folder: str) -> DataFrame:
    return clusters.cluster_kmeans(search_tables(spark, folder), LAT, LNG, RADIUS_M, k=20)


@register(
    "cluster_kmeans_totals",
    with_views(
        ["companies", "locations"],
        f", {_found()} SELECT least(20, count(DISTINCT (lat, lng))) AS cluster_count, count(*) AS total_points, "
        "round(avg(lat), 6) AS mean_lat, round(avg(lng), 6) AS mean_lng FROM near",
    ),
)
def cluster_kmeans_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Whatever the assignment, counts add up and centroids weigh out to the overall mean."""
    found = clusters.cluster_kmeans(search_tables(spark, folder), LAT, LNG, RADIUS_M, k=20)
    total = F.sum("count")
    return found.agg(
        F.count("*").alias("cluster_count"), total.alias("total_points"),
        F.round(F.sum(F.col("lat") * F.col("count")) / total, 6).alias("mean_lat"),
        F.round(F.sum(F.col("lng") * F.col("count")) / total, 6).alias("mean_lng"),
    )


@register(
    "map_cells",
    with_views(
        ["locations"],
        f" SELECT id, CAST({_cells(15)[0]} AS BIGINT) AS cell_x, CAST({_cells(15)[1]} AS BIGINT) AS cell_y, "
        f"round({FROM_CENTER}, 2) AS distance_m FROM v_locations",
    ),
)
def map_cells(spark: SparkSession, folder: str) -> DataFrame:
    places = search_tables(spark, folder)["locations"]
    lat, lng = F.col("lat"), F.col("lng")
    return places.select(
        "id", geo.mercator_cell_x(lng, 15).alias("cell_x"), geo.mercator_cell_y(lat, 15).alias("cell_y"),
        F.round(geo.distance_m(lat, lng, LAT, LNG), 2).alias("distance_m"),
    )


FAR = """SELECT id, 8.0e0 + CAST((id * 7919) % 2201 AS DOUBLE) / 100.0e0 AS lat,
  72.0e0 + CAST((id * 104729) % 1501 AS DOUBLE) / 100.0e0 AS lng FROM ({inner})"""


def _nearest_sql() -> str:
    cities = ", ".join(
        f"({i}, '{name}', {lat}e0, {lng}e0)" for i, (name, lat, lng) in enumerate(search.CITY_PRESETS)
    )
    return f"""SELECT p.id, arg_min(c.name, (sqrt(pow(p.lat - c.lat, 2) + pow(p.lng - c.lng, 2)), c.i)) AS nearest_city
      FROM ({FAR.format(inner='SELECT c_custkey AS id FROM customer')}) p, (VALUES {cities}) c(i, name, lat, lng) GROUP BY p.id"""


@register("nearest_city", _nearest_sql())
def nearest_city(spark: SparkSession, folder: str) -> DataFrame:
    points = derive(spark, folder, FAR.format(inner="SELECT c_custkey AS id FROM {customer}"))
    return search.nearest_preset(points).select("id", "nearest_city")


@register(
    "trigram_similarity",
    with_views(
        ["companies"],
        f" SELECT id, round({sql_similarity('normalized_name', repr('Harbor Analytics'))}, 6) AS to_query, "
        f"round({sql_similarity('normalized_name', 'industry')}, 6) AS to_industry FROM v_companies",
    ),
)
def trigram_similarity(spark: SparkSession, folder: str) -> DataFrame:
    name = F.col("normalized_name")
    return search_tables(spark, folder)["companies"].select(
        "id", F.round(text.trigram_similarity(name, "Harbor Analytics"), 6).alias("to_query"),
        F.round(text.trigram_similarity(name, F.col("industry")), 6).alias("to_industry"),
    )


# Evidence points a short way off the first office of the order's customer.
MENTION_POINTS = """SELECT o_orderkey AS id, o_custkey AS company_id,
  12.9716e0 + CAST((o_custkey * 7919) % 2001 - 1000 AS DOUBLE) / 5000.0e0 + CAST((o_orderkey * 13) % 21 - 10 AS DOUBLE) / 1500.0e0 AS lat,
  77.5946e0 + CAST((o_custkey * 104729) % 2001 - 1000 AS DOUBLE) / 5000.0e0 + CAST((o_orderkey * 17) % 21 - 10 AS DOUBLE) / 1500.0e0 AS lng
  FROM {orders}"""


@register(
    "office_match_by_distance",
    with_views(
        ["locations"],
        f""", m AS ({MENTION_POINTS.format(orders='orders')}),
        pairs AS (SELECT m.id, o.id AS location_id, o.verified, o.confidence FROM m JOIN v_locations o ON o.company_id = m.company_id
          WHERE o.presence_type <> 'job_location_only' AND {sql_distance('m.lat', 'm.lng', 'o.lat', 'o.lng')} <= 500)
        SELECT id, location_id FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY verified DESC, confidence DESC, location_id) AS rn
          FROM pairs) WHERE rn = 1""",
    ),
)
def office_match_by_distance(spark: SparkSession, folder: str) -> DataFrame:
    points = derive(spark, folder, MENTION_POINTS)
    return offices.match_by_distance(points, search_tables(spark, folder)["locations"])
