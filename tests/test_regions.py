"""Region boxes of all sizes against a plain loop, hot cells, and cached tiles."""

import random

from pyspark.sql import functions as F

from terralog.operators import geo, joins
from tests.conftest import rows


def inside(lat, lon, box):
    _, south, west, north, east = box
    if lat is None or lon is None:
        return False
    wide = lambda x: (x + 180) % 360 - 180
    lon, west, east = wide(lon), wide(west), wide(east)
    return south <= lat <= north and (west <= lon <= east if west <= east else lon >= west or lon <= east)


BOXES = [("tiny", 48.10, 11.50, 48.11, 11.51), ("city", 48.0, 11.3, 48.3, 11.8), ("large", 20.0, -30.0, 80.0, 30.0), ("date line", -20.0, 170.0, -10.0, -170.0), ("south", -90.0, -120.0, -60.0, -60.0), ("point", 10.0, 10.0, 10.0, 10.0)]
NAMES = "name string, south double, west double, north double, east double"


def fixes(seed=1, n=600):
    r = random.Random(seed)
    out = [(k, r.uniform(-90, 90), r.uniform(-180, 180)) for k in range(n)]
    out += [(n + k, r.uniform(47.99, 48.31), r.uniform(11.29, 11.81)) for k in range(n)] + [(2 * n + k, r.uniform(48.095, 48.115), r.uniform(11.495, 11.515)) for k in range(n)]
    return out + [(9001, 10.0, 10.0), (9002, None, 1.0), (9003, 1.0, None), (9004, -15.0, 180.0), (9005, -15.0, -180.0), (9006, 48.10, 371.505), (9007, 90.0, 0.0), (9008, -90.0, -100.0)]


def test_boxes_of_all_sizes(spark):
    data, regions = fixes(), spark.createDataFrame(BOXES, NAMES)
    df = spark.createDataFrame(data, "id bigint, lat double, lon double").repartition(3)
    assert rows(joins.in_region(df, regions).select("id")) == sorted((k,) for k, lat, lon in data if any(inside(lat, lon, b) for b in BOXES))
    got = rows(joins.in_region(df, regions, "inner").select("id", "_r_name"))
    assert got == sorted((k, b[0]) for k, lat, lon in data for b in BOXES if inside(lat, lon, b))
    assert len({name for _, name in got}) == len(BOXES)


def test_a_box_has_few_cells(spark):
    boxes = BOXES + [(f"b{k}", -80.0, -170.0, -80.0 + e, -170.0 + e * 2) for k, e in enumerate((0.001, 0.01, 0.07, 0.5, 1.9, 2.1, 15.0, 33.0, 160.0))]
    regions = spark.createDataFrame(boxes, NAMES)
    cells = [joins.region_cells(regions, s).filter("_r_salt = 0").groupBy("_r_name").count() for s in joins.CELL_SIZES]
    counted = [r for c in cells for r in c.collect()]
    assert sorted(r[0] for r in counted) == sorted(b[0] for b in boxes)  # each in one size
    assert max(r[1] for r in counted) <= 17 * 17 + 17


def test_no_key_holds_a_city(spark):
    """All fixes in one cell of each size: the largest join key holds about a sixteenth of them."""
    df = spark.range(20_000).select(F.col("id"), (F.lit(48.1) + F.rand(1) / 1000).alias("lat"), (F.lit(11.5) + F.rand(2) / 1000).alias("lon"))
    placed = joins.position_cells(df)
    for k in range(len(joins.CELL_SIZES)):
        assert placed.groupBy("_salt", f"_row{k}", f"_column{k}").count().agg(F.max("count")).first()[0] < 20_000 / 10
    assert joins.in_region(df, spark.createDataFrame(BOXES, NAMES)).count() == df.filter("lat between 48 and 48.3").count() == 20_000


def test_the_newest_cached_row_of_a_tile_counts(spark):
    key = list(joins.TILE_KEY)
    tile = ("p", "l", "static", 3, 1, 2)
    cached = spark.createDataFrame([(*tile, 10, 5), (*tile, 7, 9), (*tile, 3, 1)], "provider string, layer string, date string, z int, x int, y int, bytes bigint, stored_ns bigint").repartition(3)
    wanted = spark.createDataFrame([tile, ("p", "l", "static", 3, 1, 4)], cached.select(*key).schema)
    assert [(r.y, r.is_cached, r.bytes) for r in joins.tile_hits(wanted, cached, newest=["stored_ns"]).orderBy("y").collect()] == [(2, True, 7), (4, False, None)]
    assert joins.tile_hits(wanted, cached).orderBy("y").first().bytes == 10


def test_tile_records_are_told_apart_before_they_get_their_texts(spark):
    r = random.Random(4)
    data = [(1, s, 1_700_000_000_000_000_000 + s % 3 * 86_400_000_000_000, r.choice([10.0, 47.5, -33.0]), r.choice([-100.0, 11.0]), 0.0) for s in range(300)]
    requests = geo.tile_requests(spark.createDataFrame(data, "session_id int, seq int, stamp_ns bigint, lat double, lon double, alt double"))
    got = geo.tile_records(requests)
    want = {}
    for q in requests.collect():
        record = q["id"], q["provider"], q["layer"], q["kind"], q["date"], q["z"], q["x"], q["y"], *q["bounds"], q["path"], q["source"], q["p"]["recordable"], q["p"]["attribution"]
        assert want.setdefault(q["id"], record) == record
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.values(), key=repr) and len(want) > 5
    # what is aggregated next to the scan is hashed: sorting wide rows there held all requests of a file in one task
    aggregates = [line for line in got._jdf.queryExecution().executedPlan().toString().split("\n") if "Aggregate" in line]
    assert "HashAggregate" in aggregates[-1] and "Sort" not in aggregates[-1]
