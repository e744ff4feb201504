"""Positions: origin, georeference, odometry, frames, tiles and providers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.dimensions import PROVIDERS, REGIONS, provider_array
from terralog.functions import geodesy, tiles
from terralog.functions.binary import base64_text
from terralog.functions.numeric import finite_or, is_finite
from terralog.operators.joins import asof_join, asof_rows
from terralog.operators.ordered import BUCKET_NS, OrderedRows, quantile_of, ranked_values

MAX_ORIGIN_ACCURACY_M = 25.0


ORIGIN_FIX = ("stamp_ns", "seq", "lat", "lon", "alt", "hacc")
POSE_AT_FIX = ("pose_ns", "mx", "my", "mz")


def _good_origin(fix: dict[str, Column], pose_ns: Column, max_accuracy: float) -> Column:
    acc = fix["hacc"]
    usable = geodesy.usable_fix(fix["lat"], fix["lon"], fix["alt"])
    return usable & is_finite(acc) & (acc >= 0) & (acc <= F.lit(max_accuracy)) & pose_ns.isNotNull()


def first_origin(fixes: DataFrame, key: Sequence[str] = ("session_id",), max_accuracy: float = MAX_ORIGIN_ACCURACY_M) -> DataFrame:
    """Per session the first fix that may be its origin (``fixes`` carry the latest pose as ``pose_ns, mx, my, mz``)."""
    chosen = F.min_by(F.struct(*ORIGIN_FIX, *POSE_AT_FIX), F.struct("stamp_ns", "seq"))
    good = _good_origin({c: F.col(c) for c in ORIGIN_FIX}, F.col("pose_ns"), max_accuracy)
    return fixes.filter(good).groupBy(*key).agg(chosen.alias("origin"))


def _poses_for_fixes(poses: DataFrame, key: Sequence[str]) -> DataFrame:
    return poses.select(*key, F.col("stamp_ns").alias("pose_ns"), F.col("x").alias("mx"), F.col("y").alias("my"), F.col("z").alias("mz"), "seq")


def with_pose(fixes: DataFrame, poses: DataFrame, key: Sequence[str] = ("session_id",)) -> DataFrame:
    """Latest pose at each fix as ``pose_ns, mx, my, mz``."""
    renamed = _poses_for_fixes(poses, key)
    return asof_join(fixes, renamed, key, "stamp_ns", "pose_ns", list(POSE_AT_FIX), left_tie=["seq"], right_tie=["seq"])


def georeference(
    fixes: DataFrame, poses: DataFrame, key: Sequence[str] = ("session_id",), max_accuracy: float = MAX_ORIGIN_ACCURACY_M, limit: int | None = None,
    width: int | None = BUCKET_NS,
) -> DataFrame:
    """Local position of every fix.

    The session's origin is its first usable fix that is accurate enough and has a pose; fixes before it, and unusable
    ones, stay with a ``reason`` and no position.  The latest pose and the first origin are carried along the same
    ordered rows, spread by time as in ``asof_join``.
    """
    rows = asof_rows(fixes, _poses_for_fixes(poses, key), key, "stamp_ns", "pose_ns", list(POSE_AT_FIX), left_tie=["seq"], right_tie=["seq"], limit=limit, width=width)
    fix, pose = {c: F.col(f"_left.{c}") for c in ORIGIN_FIX}, F.col("_match")
    candidate = F.struct(*[c.alias(n) for n, c in fix.items()], *[pose[c].alias(c) for c in POSE_AT_FIX])
    good = (F.col("_side") == 1) & _good_origin(fix, pose["pose_ns"], max_accuracy)
    carried = rows.first_seen("origin", F.when(good, candidate)).result().filter(F.col("_side") == 1)
    left_cols = [c for c in fixes.columns if c not in key]
    joined = carried.select(*key, *[F.col(f"_left.{c}").alias(c) for c in left_cols], F.col("_match.pose_ns").alias("pose_ns"), "origin")
    o = F.col("origin")
    usable = geodesy.usable_fix(F.col("lat"), F.col("lon"), F.col("alt"))
    enu = geodesy.to_enu(
        geodesy.to_ecef(F.col("lat"), F.col("lon"), F.col("alt")), geodesy.to_ecef(o["lat"], o["lon"], o["alt"]), o["lat"], o["lon"]
    )
    at = F.struct(o["mx"].alias("x"), o["my"].alias("y"), o["mz"].alias("z"))
    reason = (
        F.when(o.isNotNull(), F.lit(None).cast("string"))
        .when(F.col("pose_ns").isNull(), F.lit("waiting_for_arkit_map_pose"))
        .otherwise(F.lit("waiting_for_accurate_gps_origin"))
    )
    placed = joined.withColumn("established", o.isNotNull()).withColumn("reason", reason)
    placed = placed.withColumn("enu", F.when(F.col("established") & usable, enu))
    return placed.withColumn("map", F.when(F.col("enu").isNotNull(), geodesy.enu_to_map(F.col("enu"), at)))


# --- odometry and frames -----------------------------------------------------------------------------------------------


def _conjugate(q: dict[str, Column]) -> dict[str, Column]:
    norm = q["x"] * q["x"] + q["y"] * q["y"] + q["z"] * q["z"] + q["w"] * q["w"]
    return {"x": -q["x"] / norm, "y": -q["y"] / norm, "z": -q["z"] / norm, "w": q["w"] / norm}


def _multiply(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    return {
        "x": a["w"] * b["x"] + a["x"] * b["w"] + a["y"] * b["z"] - a["z"] * b["y"],
        "y": a["w"] * b["y"] - a["x"] * b["z"] + a["y"] * b["w"] + a["z"] * b["x"],
        "z": a["w"] * b["z"] + a["x"] * b["y"] - a["y"] * b["x"] + a["z"] * b["w"],
        "w": a["w"] * b["w"] - a["x"] * b["x"] - a["y"] * b["y"] - a["z"] * b["z"],
    }


def _cross(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    return {"x": a["y"] * b["z"] - a["z"] * b["y"], "y": a["z"] * b["x"] - a["x"] * b["z"], "z": a["x"] * b["y"] - a["y"] * b["x"]}


def _vector(values: dict[str, Column]) -> Column:
    return F.struct(*[v.alias(c) for c, v in values.items()])


def _parts(name: str, axes: str = "xyz") -> dict[str, Column]:
    return {c: F.col(f"{name}.{c}") for c in axes}


def odometry_twist(poses: DataFrame, key: Sequence[str] = ("session_id",), width: int | None = BUCKET_NS) -> DataFrame:
    """Body-frame linear (vx, vy, vz) and angular (wx, wy, wz) velocity from the pose before; 0 on the first row and
    where less than 0.1 ms has passed.

    Each step is its own column, so that no later formula repeats an earlier one and the code stays small enough to
    compile.
    """
    rows = OrderedRows(poses, key, ["stamp_ns", "seq"], width=width).previous("_b", "stamp_ns", "x", "y", "z", "qx", "qy", "qz", "qw").result()
    q = {c: F.col(f"q{c}") for c in "xyzw"}
    before = {c: F.col(f"_b.q{c}") for c in "xyzw"}
    rows = rows.withColumn("_dt", (F.col("stamp_ns") - F.col("_b.stamp_ns")) / F.lit(1e9))
    dt = F.col("_dt")
    # turn since the row before, and the way back from the world to the body
    rows = rows.withColumns({"_turn": _vector(_multiply(q, _conjugate(before))), "_body": _vector(_conjugate(q))})
    w = F.least(F.greatest(F.col("_turn.w"), F.lit(-1.0)), F.lit(1.0))
    rows = rows.withColumns({"_sine": F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - w * w)), "_double": F.lit(2.0) * F.acos(w)})
    angle = F.when(F.col("_double") > F.pi(), F.col("_double") - F.lit(2.0) * F.pi()).otherwise(F.col("_double"))
    rows = rows.withColumn("_rate", F.when(F.col("_sine") > F.lit(1e-6), angle / F.col("_sine") / dt).otherwise(F.lit(0.0)))
    rows = rows.withColumns(
        {
            "_v": _vector({c: (F.col(c) - F.col(f"_b.{c}")) / dt for c in "xyz"}),
            "_w": _vector({c: F.col(f"_turn.{c}") * F.col("_rate") for c in "xyz"}),
        }
    )
    # v turned by the unit quaternion: v + 2w(u x v) + 2u x (u x v)
    body = _parts("_body", "xyzw")
    rows = rows.withColumns({f"_t{n}": _vector(_cross(body, _parts(n))) for n in ("_v", "_w")})
    usable = F.col("_b").isNotNull() & (dt > F.lit(1e-4))
    out = {}
    for name, vector in (("v", "_v"), ("w", "_w")):
        v, first = _parts(vector), _parts(f"_t{vector}")
        second = _cross(body, first)
        for c in "xyz":
            turned = v[c] + F.lit(2.0) * body["w"] * first[c] + F.lit(2.0) * second[c]
            out[f"{name}{c}"] = F.when(usable, turned).otherwise(F.lit(0.0))
    return rows.withColumns(out).drop("_b", "_dt", "_turn", "_body", "_sine", "_double", "_rate", "_v", "_w", "_t_v", "_t_w")


def tf_rows(poses: DataFrame, origins: DataFrame, key: Sequence[str] = ("session_id",)) -> DataFrame:
    """Frame edges per pose: earth to map first where the session has an origin by then, then map-odom, odom-base, base-camera.

    ``origins`` is one row per session (``first_origin``).
    """
    def edge(parent: str, child: str, t: Sequence[Column], r: Sequence[Column]) -> Column:
        values = [finite_or(v, 0.0).alias(n) for n, v in zip(("tx", "ty", "tz", "qx", "qy", "qz"), [*t, *r[:3]])]
        return F.struct(F.lit(parent).alias("parent"), F.lit(child).alias("child"), *values, finite_or(r[3], 1.0).alias("qw"))

    zero, one = F.lit(0.0), F.lit(1.0)
    none = ([zero] * 3, [zero, zero, zero, one])
    o = F.col("origin")
    earth = geodesy.earth_to_map(
        o["lat"], o["lon"], geodesy.to_ecef(o["lat"], o["lon"], o["alt"]), F.struct(o["mx"].alias("x"), o["my"].alias("y"), o["mz"].alias("z"))
    )
    # the frame is computed once per session, not per pose
    frames = origins.select(*key, o["stamp_ns"].alias("_since"), earth.alias("_frame"))
    joined = poses.join(frames, list(key), "left").withColumn("_earth", F.when(F.col("_since") <= F.col("stamp_ns"), F.col("_frame")))
    e = F.col("_earth")
    chain = F.array(
        edge("map", "odom", *none),
        edge("odom", "base_link", [F.col(c) for c in "xyz"], [F.col(f"q{c}") for c in "xyzw"]),
        edge("base_link", "iphone_camera", *none),
    )
    rotation = e["rotation"]
    first = F.array(edge("earth", "map", [e["tx"], e["ty"], e["tz"]], [rotation[f"q{c}"] for c in "xyzw"]))
    edges = F.when(e.isNotNull(), F.concat(first, chain)).otherwise(chain)
    return joined.select(*key, "stamp_ns", "seq", F.posexplode(edges).alias("position", "_e")).select(*key, "stamp_ns", "seq", "position", "_e.*")


# --- tiles and providers -----------------------------------------------------------------------------------------------


def providers_at(fixes: DataFrame, providers: Sequence[dict] = PROVIDERS, regions: Sequence[tuple] = REGIONS) -> DataFrame:
    """(fix, provider ``p``) pairs where the provider covers the fix: global ones everywhere, others inside one of their
    boxes.  The providers are a constant array, so this is a projection without a shuffle."""
    return fixes.select("*", F.explode(_covering(providers, regions)).alias("p"))


def _covering(providers: Sequence[dict], regions: Sequence[tuple]) -> Column:
    def covers(p: Column) -> Column:
        inside = F.exists(
            p["boxes"], lambda b: tiles.region_contains(F.col("lat"), F.col("lon"), b["south"], b["west"], b["north"], b["east"])
        )
        return p["is_global"] | inside

    return F.filter(provider_array(providers, regions), covers)


def dem_candidates(
    fixes: DataFrame, providers: Sequence[dict] = PROVIDERS, regions: Sequence[tuple] = REGIONS, fix_key: Sequence[str] = ("session_id", "seq")
) -> DataFrame:
    """Elevation providers per fix in the order to try: regional ones that cover it, then global; distinct by kind, name, layer."""
    dem = F.filter(_covering(providers, regions), lambda p: p["kind"] == "dem")
    tried = F.transform(
        F.array_sort(F.transform(dem, lambda p: F.struct(p["is_global"], p["position"], p["kind"], p["name"], p["layer"]))),
        lambda c: F.struct(c["kind"].alias("kind"), c["name"].alias("name"), c["layer"].alias("layer")),
    )
    return fixes.select(*fix_key, F.posexplode(F.array_distinct(tried)).alias("position", "c")).select(*fix_key, "position", "c.*")


def first_success(attempts: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per tile request: the first candidate that loaded, else an error that names all in the order tried.

    ``attempts`` has ``position, name, success, error``; a request has a handful of candidates.
    """
    tried = F.array_sort(F.collect_list(F.struct("position", "name")))
    out = attempts.groupBy(*key).agg(
        F.min_by("name", F.when(F.col("success"), F.col("position"))).alias("loaded"),
        F.transform(tried, lambda t: t["name"]).alias("tried"),
        F.max_by("error", "position").alias("_error"),
    )
    text = F.concat(F.lit("GeoTile fetch failed for "), F.array_join("tried", ", "), F.lit(": "), F.coalesce("_error", F.lit("")))
    return out.withColumn("error", F.when(F.col("loaded").isNull(), text)).drop("_error")


def tile_requests(fixes: DataFrame, providers: Sequence[dict] = PROVIDERS, regions: Sequence[tuple] = REGIONS) -> DataFrame:
    """The tile each covering provider would serve for each fix: key, date, bounds, pixel, request text, cache path, id.

    Requests whose text is null (a needed date is missing) are kept; the caller decides.
    """
    p = F.col("p")
    rows = providers_at(fixes, providers, regions)
    rows = rows.withColumn("key", tiles.tile_key(F.col("lat"), F.col("lon"), p["zoom"]))
    rows = rows.withColumn("date", tiles.tile_date(F.col("stamp_ns"), p["date_offset_days"]))
    key = F.col("key")
    return rows.select(
        *fixes.columns,
        p["kind"].alias("kind"), p["name"].alias("provider"), p["layer"].alias("layer"), F.coalesce("date", F.lit("static")).alias("date"),
        key["z"].alias("z"), key["x"].alias("x"), key["y"].alias("y"), "key", p.alias("p"),
        tiles.tile_pixel(F.col("lat"), F.col("lon"), key, p["tile_size"]).alias("pixel"), *_tile_text(p, key, F.col("date")),
    )


def _tile_text(p: Column, key: Column, date: Column) -> list[Column]:
    """Bounds, request text, cache path and id of a provider's tile; ``date`` is null where the provider has none."""
    return [
        tiles.tile_bounds(key).alias("bounds"),
        tiles.tile_source(p["template"], key, date).alias("source"),
        tiles.tile_cache_path(p["name"], p["layer"], date, key, p["extension"]).alias("path"),
        tiles.tile_id(p["kind"], p["name"], p["layer"], date, key).alias("id"),
    ]


def tile_records(requests: DataFrame) -> DataFrame:
    """Cached-tile table: one record per tile id.

    Tiles are told apart by provider, date and key first, as numbers and a date that are hashed before the shuffle; only what is left
    gets its texts.  The providers are those that occur in the requests.
    """
    providers = requests.select("p").distinct().withColumn("_name", F.xxhash64("p"))
    tiles_of = requests.select(F.xxhash64("p").alias("_name"), "date", "z", "x", "y").distinct()
    named = tiles_of.join(providers, "_name").withColumn("key", F.struct("z", "x", "y"))
    p, date = F.col("p"), F.nullif(F.col("date"), F.lit("static"))
    records = named.select(p["name"].alias("provider"), p["layer"].alias("layer"), p["kind"].alias("kind"), "date", "z", "x", "y", "p", *_tile_text(p, F.col("key"), date))
    flat = records.select(
        "id", "provider", "layer", "kind", "date", "z", "x", "y", "bounds.*", "path", "source", F.col("p.recordable").alias("recordable"),
        F.col("p.attribution").alias("attribution"),
    )
    rest = [c for c in flat.columns if c != "id"]
    return flat.groupBy("id").agg(F.min(F.struct(*rest)).alias("_r")).select("id", "_r.*")


def tile_message(requests: DataFrame, data: str | None = None) -> DataFrame:
    """Flat metadata row per fix and tile; with ``data`` (a bytes column) the raster form with encoding and base64 text."""
    p = F.col("p")
    bounds = F.to_json(F.struct("bounds.east", "bounds.north", "bounds.south", "bounds.west"))
    pixel = F.struct(
        F.col("pixel.px").alias("x"), F.col("pixel.py").alias("y"), p["tile_size"].alias("width"), p["tile_size"].alias("height"),
        F.lit("upper_left").alias("origin"), F.lit("pixels").alias("units"),
    )
    device = F.to_json(F.struct(F.col("alt").alias("altitude"), F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), pixel.alias("pixel")))
    policy = F.to_json(
        F.struct(
            p["policy_url"].alias("attribution_url"), p["credential"].alias("credential_requirement"), p["recordable"].alias("recordable_by_default"),
            (p["credential"] != "none").alias("requires_credentials"), F.lit(False).alias("transient_cache_only"),
        )
    )
    columns = [
        "session_id", "stamp_ns", "seq", "provider", "layer", "kind", p["crs"].alias("crs"), F.col("z").alias("zoom"), F.col("x").alias("tile_x"),
        F.col("y").alias("tile_y"), bounds.alias("bounds"), device.alias("device_location"), F.col("pixel.px").alias("device_pixel_x"),
        F.col("pixel.py").alias("device_pixel_y"), p["tile_size"].alias("tile_width"), p["tile_size"].alias("tile_height"),
        F.lit("upper_left").alias("pixel_origin"), F.lit("pixels").alias("pixel_units"), p["format"].alias("format"), p["mime"].alias("mime_type"),
        F.col("source").alias("source_url"), p["attribution"].alias("attribution"), p["license"].alias("license"), policy.alias("source_policy"),
        F.when(F.col("date") != "static", F.col("date")).alias("time"),
    ]
    if data is not None:
        columns += [p["encoding"].alias("encoding"), base64_text(F.col(data)).alias("data")]
    return requests.select(*columns)


def alignment_residuals(fixes: DataFrame, poses: DataFrame, key: Sequence[str] = ("session_id",)) -> DataFrame:
    """Distance between the position a fix gives and the pose at that time: number, mean and 95th percentile per session."""
    placed = georeference(fixes, poses, key).filter(F.col("map").isNotNull())
    renamed = poses.select(*key, F.col("stamp_ns").alias("_p_ns"), F.col("x").alias("_px"), F.col("y").alias("_py"), F.col("z").alias("_pz"), "seq")
    both = asof_join(placed, renamed, key, "stamp_ns", "_p_ns", ["_px", "_py", "_pz"], left_tie=["seq"], right_tie=["seq"])
    distance = F.sqrt(
        F.pow(F.col("map.x") - F.col("_px"), 2) + F.pow(F.col("map.y") - F.col("_py"), 2) + F.pow(F.col("map.z") - F.col("_pz"), 2)
    )
    ranked = ranked_values(both.withColumn("_d", distance).select(*key, "_d"), key, "_d")
    return ranked.groupBy(*key).agg(
        F.sum("n").alias("fixes"), (F.sum(F.col("_d") * F.col("n")) / F.sum("n")).alias("mean_m"), quantile_of("_d", "0.95").alias("p95_m")
    )
