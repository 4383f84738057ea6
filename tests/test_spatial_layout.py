"""Space codes, and what a search in a circle reads of rows that are stored in their order."""

import glob
import random

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from nearby_engine.functions.geo import code_ranges, in_box, in_codes, in_radius, space_code
from nearby_engine.operators.search import in_circle
from nearby_engine.sources.tables import empty_tables, read_tables, stored_rows, write_tables

CIRCLES = [(12.97, 77.59, 15_000), (0.0, 180.0, 40_000), (10.0, -179.95, 30_000), (89.9, 10.0, 50_000), (-90.0, 0.0, 1_000), (51.5, -0.1, 500), (20.0, 60.0, 3_000_000)]


def _code(lat, lng):
    x, y = min(65535, int((lng + 180) / 360 * 65536)), min(65535, int((lat + 90) / 180 * 65536))
    return sum((x >> i & 1) << 2 * i | (y >> i & 1) << 2 * i + 1 for i in range(16))


def _points(spark, n=20_000):
    dice = random.Random(9)
    rows = [(dice.uniform(-90, 90), dice.uniform(-180, 180)) for _ in range(n)] + [(90.0, 180.0), (-90.0, -180.0), (None, 1.0), (1.0, None), (float("nan"), 1.0)]
    for lat, lng, radius in CIRCLES:
        spread = radius / 100_000
        rows += [(max(-90.0, min(90.0, lat + dice.uniform(-spread, spread))), (lng + dice.uniform(-spread, spread) + 180) % 360 - 180) for _ in range(300)]
    return spark.createDataFrame(rows, "lat double, lng double")


def test_codes_interleave_the_two_coordinates(spark):
    for r in _points(spark, 2000).withColumn("cell", space_code(F.col("lat"), F.col("lng"))).collect():
        whole = r.lat is not None and r.lng is not None and r.lat == r.lat
        assert r.cell == (_code(r.lat, r.lng) if whole else None)


def test_ranges_hold_every_point_of_a_circle(spark):
    points = _points(spark).withColumn("cell", space_code(F.col("lat"), F.col("lng"))).cache()
    for lat, lng, radius in CIRCLES:
        ranges = code_ranges(lat, lng, radius)
        assert len(ranges) <= 40 and all(a <= b for a, b in ranges)
        inside = in_radius(F.col("lat"), F.col("lng"), lat, lng, radius)
        assert points.filter(inside).count() > 0
        assert points.filter(inside & ~F.coalesce(in_codes(F.col("cell"), lat, lng, radius), F.lit(False))).count() == 0
        assert points.filter(inside & ~in_box(F.col("lat"), F.col("lng"), lat, lng, radius)).count() == 0
        assert in_circle(points, "lat", "lng", lat, lng, radius).count() == points.filter(inside).count()


def test_a_circle_reads_a_small_share_of_the_row_groups(spark, tmp_path):
    """Not a belt of latitude: places of one country, stored by their code, in small row groups."""
    dice = random.Random(1)
    rows = [(f"l{i}", f"c{i % 900}", dice.uniform(8, 32), dice.uniform(69, 92), "confirmed_office") for i in range(60_000)]
    given = spark.createDataFrame(rows, "id string, company_id string, lat double, lng double, presence_type string")
    locations = empty_tables(spark)["locations"].unionByName(given, allowMissingColumns=True)
    spark.conf.set("parquet.block.row.count.limit", "500")
    root = str(tmp_path)
    stored = stored_rows("locations", locations)
    stored.repartitionByRange(8, "cell").sortWithinPartitions("cell").write.option("parquet.block.row.count.limit", "500").parquet(f"{root}/places")
    groups = [g.row_group(i) for f in glob.glob(f"{root}/places/*.parquet") for g in [pq.ParquetFile(f).metadata] for i in range(g.num_row_groups)]
    column = lambda group, name: next(group.column(i).statistics for i in range(group.num_columns) if group.column(i).path_in_schema == name)
    ranges = code_ranges(12.97, 77.59, 15_000)
    read = [g for g in groups if any(column(g, "cell").min <= b and column(g, "cell").max >= a for a, b in ranges)]
    belt = [g for g in groups if column(g, "lat").min <= 13.11 and column(g, "lat").max >= 12.83]
    assert len(groups) > 60 and len(read) <= 4 < len(belt) or len(groups) <= 8 and len(read) <= 2


def test_stored_tables_give_their_codes_on_request(spark, tmp_path):
    root = str(tmp_path)
    assert "cell" in read_tables(spark, root, cells=True)["locations"].columns
    given = spark.createDataFrame([("l", "c", 12.97, 77.59, "x")], "id string, company_id string, lat double, lng double, presence_type string")
    tables = empty_tables(spark)
    write_tables(spark, tables | {"locations": tables["locations"].unionByName(given, allowMissingColumns=True)}, root, "one")
    assert read_tables(spark, root)["locations"].columns == tables["locations"].columns
    held = read_tables(spark, root, cells=True)["locations"]
    assert held.first().cell == _code(12.97, 77.59)
    found = in_circle(held, "lat", "lng", 12.97, 77.59, 1000)
    assert found.count() == 1 and "PushedFilters" in found._jdf.queryExecution().executedPlan().toString() and "cell" in found._jdf.queryExecution().executedPlan().toString().split("PushedFilters")[1]
