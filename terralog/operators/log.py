"""The message log: decode, rename, retype, select, type, merge and summarise."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terralog.functions.names import rewrite_topic, rewrite_type
from terralog.functions.numeric import let, with_once
from terralog.functions.stamps import duration_ns, join_stamp
from terralog.operators.ordered import join_same
from terralog.schemas import MESSAGE_FIELDS

# --- envelopes ---------------------------------------------------------------------------------------------------------


def _is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.lit(False))


def _envelope_error(parsed: Column) -> Column:
    """Null for a usable envelope, else what is wrong with it.  ``parsed`` is the payload as a variant."""
    op = F.try_variant_get(parsed, "$.op", "variant")
    name = F.coalesce(F.try_variant_get(parsed, "$.op", "string"), F.to_json(op))
    return (
        F.when(parsed.isNull(), F.lit("payload is not JSON"))
        .when(~_is_object(parsed), F.lit("payload is not an object"))
        .when(op.isNotNull() & ~F.is_variant_null(op) & (name != "publish"), F.concat(F.lit("unsupported op "), name))
        .when(~_is_object(F.try_variant_get(parsed, "$.msg", "variant")), F.lit("payload has no object msg"))
    )


def decode_envelope(df: DataFrame, mode: str = "permissive", legacy_root: str = "/legacy", root: str = "/mapping") -> DataFrame:
    """Add ``topic`` (payload's own, else the record's), ``msg`` (JSON text) and ``stamp_ns`` from ``data``.

    ``strict`` stops at the first bad row; ``permissive`` keeps only good rows, see ``envelope_rejects`` for the rest.
    The payload is parsed once to a variant, and all fields are read from that.
    """
    parsed = with_once(df, "_v", F.try_parse_json("data"))
    v = F.col("_v")
    if mode == "strict":
        error = _envelope_error(v)
        good = parsed.filter(F.when(error.isNotNull(), F.raise_error(error).cast("boolean")).otherwise(F.lit(True)))
    else:
        good = parsed.filter(_envelope_error(v).isNull())
    own = F.try_variant_get(v, "$.topic", "string")
    topic = F.when(own.isNotNull() & (own != ""), own).otherwise(F.col("topic"))

    def stamp(path: str) -> Column:
        return join_stamp(F.try_variant_get(v, f"{path}.stamp.sec", "bigint"), F.try_variant_get(v, f"{path}.stamp.nanosec", "bigint"))

    return good.withColumns(
        {
            "topic": rewrite_topic(topic, legacy_root, root),
            "msg": F.get_json_object("data", "$.msg"),
            "stamp_ns": F.coalesce(stamp("$.msg.header"), stamp("$.msg.transforms[0].header"), F.col("stamp_ns").cast("bigint")),
        }
    ).drop("_v")


def envelope_rejects(df: DataFrame) -> DataFrame:
    """The rows that do not decode, with ``error``."""
    parsed = with_once(df, "_v", F.try_parse_json("data"))
    return parsed.withColumn("error", _envelope_error(F.col("_v"))).filter(F.col("error").isNotNull()).drop("_v")


def rewrite_names(df: DataFrame, legacy_root: str, root: str, legacy_package: str, package: str) -> DataFrame:
    return df.withColumns(
        {"topic": rewrite_topic(F.col("topic"), legacy_root, root), "type": rewrite_type(F.col("type"), legacy_package, package)}
    )


def override_types(df: DataFrame, overrides: Mapping[str, str] | DataFrame) -> DataFrame:
    """Replace the type of the named topics; a mapping becomes an expression, a table is joined."""
    if isinstance(overrides, DataFrame):
        table = overrides.select("topic", F.col("type").alias("_type"))
        return df.join(table, "topic", "left").withColumn("type", F.coalesce("_type", "type")).drop("_type")
    picked = F.lit(None).cast("string")
    for topic, type_ in overrides.items():
        picked = F.when(F.col("topic") == topic, F.lit(type_)).otherwise(picked)
    return df.withColumn("type", F.coalesce(picked, F.col("type")))


def parse_overrides(values: Sequence[str], legacy: tuple[str, str] = ("/legacy", "legacy_msgs"), current: tuple[str, str] = ("/mapping", "mapping_msgs"), spark: SparkSession | None = None) -> DataFrame:
    """``TOPIC=TYPE`` texts as a table of normalised names; a text without ``=`` is an error, the last of equals wins."""
    for value in values:
        if "=" not in value:
            raise ValueError(f"expected TOPIC=TYPE, got {value!r}")
    spark = spark or SparkSession.active()
    raw = spark.createDataFrame(list(enumerate(values)), "pos int, value string")
    parts = F.split("value", "=", 2)
    named = raw.select(
        "pos",
        rewrite_topic(F.trim(parts[0]), legacy[0], current[0]).alias("topic"),
        rewrite_type(F.trim(parts[1]), legacy[1], current[1]).alias("type"),
    )
    return named.groupBy("topic").agg(F.max_by("type", "pos").alias("type"))


def select_topics(df: DataFrame, topics: Sequence[str]) -> DataFrame:
    """Keep the chosen topics; on the stored column this prunes partitions, so use it before and after decoding."""
    return df.filter(F.col("topic").isin(*topics))


def topic_list(
    spark: SparkSession, default: Sequence[str], optional: Sequence[str] = (), files: Sequence[str] = (), extra: Sequence[str] = ()
) -> DataFrame:
    """(position, topic): defaults, optional ones, files (``#`` starts a comment) and extras; the first of equals stays."""
    given = spark.createDataFrame(
        [(0, i, t) for i, t in enumerate([*default, *optional])] + [(2, i, t) for i, t in enumerate(extra)] or [],
        "part int, pos bigint, topic string",
    )
    if files:
        text = spark.read.text(list(files), wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
        order = F.create_map(*[x for i, f in enumerate(files) for x in (F.lit(f.rsplit("/", 1)[-1]), F.lit(i))])
        lines = text.select(order[F.regexp_extract("file", "[^/]+$", 0)].alias("f"), F.posexplode(F.split("value", "\r?\n")))
        clean = lines.select("f", "pos", F.trim(F.substring_index("col", "#", 1)).alias("topic")).filter("topic <> ''")
        bad = F.raise_error(F.concat(F.lit("topic must start with '/': "), F.col("topic")))
        checked = clean.withColumn("topic", F.when(F.startswith("topic", F.lit("/")), F.col("topic")).otherwise(bad))
        given = given.unionByName(checked.select(F.lit(1).alias("part"), (F.col("f") * F.lit(1 << 40) + F.col("pos")).alias("pos"), "topic"))
    first = given.groupBy("topic").agg(F.min(F.struct("part", "pos")).alias("position"))
    return first.select("position", "topic").orderBy("position")


# --- typed messages ----------------------------------------------------------------------------------------------------

# Fixed ranges of the integer types (lowest, highest).
_RANGES = {
    "byte": (0, 255), "char": (0, 255), "octet": (0, 255), "uint8": (0, 255), "int8": (-128, 127), "uint16": (0, 65_535), "int16": (-32_768, 32_767),
    "uint32": (0, 2**32 - 1), "int32": (-(2**31), 2**31 - 1), "uint64": (0, 2**64 - 1), "int64": (-(2**63), 2**63 - 1),
}
_FLOATS = {"float", "double", "float32", "float64"}
_BYTES = {"byte", "octet", "uint8", "char"}


def _sequence(kind) -> tuple[str, int | None] | None:
    """(element, length if it is fixed) of a list of plain values, declared ``sequence<x>`` or ``x[n]``."""
    if not isinstance(kind, str):
        return None
    if kind.startswith("sequence<"):
        return kind[9:-1], None
    name, _, size = kind.partition("[")
    return (name, int(size[:-1])) if size else None


def _is_bytes(kind) -> bool:
    listed = _sequence(kind)
    return listed is not None and listed[0] in _BYTES


def _plain_type(kind: str) -> str:
    if kind in ("string", "bool"):
        return {"string": "string", "bool": "boolean"}[kind]
    return "double" if kind in _FLOATS else "decimal(20,0)" if kind == "uint64" else "bigint"


def _typed(kind) -> str:
    if isinstance(kind, (tuple, list)):
        inner = "struct<" + ",".join(f"`{n}`:{_typed(k)}" for n, k in kind) + ">"
        return f"array<{inner}>" if isinstance(kind, list) else inner
    if _is_bytes(kind):
        return "binary"
    return f"array<{_plain_type(_sequence(kind)[0])}>" if _sequence(kind) else _plain_type(kind)


def message_type(name: str, fields: Mapping[str, tuple] = MESSAGE_FIELDS) -> T.DataType:
    """The type of ``message`` for one message type, as ``hydrate`` gives it."""
    return T.DataType.fromDDL(_typed(fields[name]))


def _primitive(raw: Column, kind: str) -> tuple[Column, Column]:
    """(value, failed) of one leaf; a missing field takes the type's default, an integer must be in its range."""
    if kind == "string":
        return F.coalesce(raw, F.lit("")), F.lit(False)
    if kind == "bool":
        text = F.lower(raw)
        number = raw.try_cast("double")
        return F.coalesce(text.isin("1", "true", "yes", "on") | F.coalesce(number != 0, F.lit(False)), F.lit(False)), F.lit(False)
    if kind in _FLOATS:
        value = raw.try_cast("double")
        return F.coalesce(value, F.lit(0.0)), raw.isNotNull() & value.isNull()
    target = "decimal(20,0)" if kind == "uint64" else "bigint"
    words = F.when(raw == "true", F.lit("1")).when(raw == "false", F.lit("0")).otherwise(raw)
    value = F.coalesce(words.try_cast(target), words.try_cast("double").try_cast("decimal(38,6)").try_cast(target))
    low, high = (F.lit(str(n)).cast(target) for n in _RANGES[kind])
    return F.coalesce(value, F.lit(0).cast(target)), raw.isNotNull() & F.coalesce(~value.between(low, high), F.lit(True))


def _text(node: Column) -> Column:
    return F.try_variant_get(node, "$", "string")


def _both(value: Column, bad: Column) -> Column:
    return F.struct(value.alias("value"), F.coalesce(bad, F.lit(True)).alias("bad"))


def _bytes_read(node: Column) -> Column:
    """Base64 text or a list of numbers."""
    numbers = F.try_variant_get(node, "$", "array<int>")
    hexes = F.array_join(F.transform(numbers, lambda n: F.lpad(F.hex(n), 2, "0")), "")
    # a list is no text, and the text of one is no base64
    value = F.coalesce(F.when(numbers.isNotNull() & ~F.exists(numbers, lambda n: n.isNull()), F.unhex(hexes)), F.try_to_binary(_text(node), F.lit("base64")))
    return let(value, lambda v: _both(F.coalesce(v, F.lit(b"")), node.isNotNull() & v.isNull()))


def _plain_read(node: Column, kind: str) -> Column:
    """One leaf.  A null number fails; a null text or bool is like a missing one."""
    null = F.lit(False) if kind in ("string", "bool") else F.coalesce(F.is_variant_null(node), F.lit(False))

    def body(raw: Column) -> Column:
        value, failed = _primitive(raw, kind)
        return _both(value, failed | null)

    return let(_text(node), body)


def _list_read(node: Column, read: Callable[[Column], Column], length: int | None, typed: str) -> Column:
    """A list of what ``read`` makes of its items; a missing one is empty, or of defaults if its length is fixed."""
    items = F.try_variant_get(node, "$", "array<variant>")
    missing = F.array_repeat(F.lit(None).cast("variant"), length or 0)
    made = F.transform(F.coalesce(items, missing), read)

    def body(parts: Column) -> Column:
        bad = F.exists(parts, lambda p: p["bad"]) | (node.isNotNull() & items.isNull())
        if length is not None:
            bad = bad | (F.size(parts) != length)
        return _both(F.transform(parts, lambda p: p["value"]).cast(typed), bad)

    return let(made, body)


def _read(node: Column, kind) -> Column:
    """(value, bad) of a declared kind from one JSON node, a variant: its shape, its leaves and its faults in one pass.

    An object is opened once to a struct of its declared fields' nodes, and each is read from there.  A node that is there
    and not of the declared kind is bad; a missing field takes its type's default.
    """
    if isinstance(kind, tuple):
        opened = F.try_variant_get(node, "$", "struct<" + ",".join(f"`{n}`:variant" for n, _ in kind) + ">")

        def fields(s: Column) -> Column:
            parts = F.struct(*[_read(s[n], k).alias(n) for n, k in kind])

            def both(p: Column) -> Column:
                bad = node.isNotNull() & s.isNull()
                for n, _ in kind:
                    bad = bad | p[n]["bad"]
                return _both(F.struct(*[p[n]["value"].alias(n) for n, _ in kind]), bad)

            return let(parts, both)

        return let(opened, fields)
    if isinstance(kind, list):
        # an item that is null is no object
        return _list_read(node, lambda e: let(_read(e, tuple(kind)), lambda p: _both(p["value"], p["bad"] | e.isNull() | F.is_variant_null(e))), None, _typed(kind))
    if _is_bytes(kind):
        return _bytes_read(node)
    listed = _sequence(kind)
    if listed:
        return _list_read(node, lambda e: _plain_read(e, listed[0]), listed[1], _typed(kind))
    return _plain_read(node, kind)


def hydrate(df: DataFrame, message_type: str, fields: Mapping[str, tuple] = MESSAGE_FIELDS) -> DataFrame:
    """``message``: the declared fields of ``msg`` only, coerced to their types; ``_failed`` marks rows that cannot be.

    Missing fields take defaults.  A nested value that is not an object, a sequence that is not a list, a null number, a
    list of another length than a fixed one, and an integer out of range fail the row.  The text is parsed once.
    """
    if message_type not in fields:
        raise KeyError(f"no schema for {message_type}")
    parsed = with_once(df, "_tree", F.try_parse_json("msg"))
    read = with_once(parsed, "_read", _read(F.col("_tree"), fields[message_type]))
    failed = F.col("_tree").isNull() | F.col("_read.bad")
    return read.withColumns({"message": F.col("_read.value"), "_failed": F.coalesce(failed, F.lit(True))}).drop("_read", "_tree")


def hydrate_good(df: DataFrame, message_type: str) -> DataFrame:
    return hydrate(df, message_type).filter(~F.col("_failed")).drop("_failed")


def hydrate_rejects(df: DataFrame, message_type: str) -> DataFrame:
    return hydrate(df, message_type).filter("_failed").drop("message", "_failed")


# --- conversion --------------------------------------------------------------------------------------------------------


def convert(
    messages: DataFrame, types: Sequence[str], topics: DataFrame | None = None, overrides: Mapping[str, str] | DataFrame | None = None,
    mode: str = "skip", legacy: tuple[str, str] = ("/legacy", "legacy_msgs"), current: tuple[str, str] = ("/mapping", "mapping_msgs"),
    fields: Mapping[str, tuple] = MESSAGE_FIELDS,
) -> DataFrame:
    """A whole log converted in one pass: its own columns with renamed ``topic``, ``type`` and ``stamp_ns``, the typed
    fields as JSON text in ``message``, and ``reason``, which is null for what converts.

    Names are rewritten, types overridden, topics chosen (by table, before and after a payload names its own), types
    checked against ``types``, payloads decoded once and hydrated by their type.  ``skip`` keeps the rows that do not
    convert, with their reason and no message; ``fail`` stops at the first one.  ``converted`` and ``rejected`` part them.
    """
    named = rewrite_names(messages, legacy[0], current[0], legacy[1], current[1])
    named = override_types(named, overrides) if overrides is not None else named

    def chosen(df: DataFrame) -> DataFrame:
        return df if topics is None else df.join(topics.select("topic"), "topic", "left_semi")

    parsed = with_once(chosen(named), "_v", F.try_parse_json("data"))
    v = F.col("_v")
    own = F.try_variant_get(v, "$.topic", "string")

    def stamp(path: str) -> Column:
        return join_stamp(F.try_variant_get(v, f"{path}.stamp.sec", "bigint"), F.try_variant_get(v, f"{path}.stamp.nanosec", "bigint"))

    decoded = chosen(
        parsed.withColumns(
            {
                "_error": F.when(F.col("type").isin(*types), _envelope_error(v)).otherwise(F.concat(F.lit("no schema for "), F.coalesce("type", F.lit("null")))),
                "topic": F.when(own.isNotNull() & (own != ""), rewrite_topic(own, legacy[0], current[0])).otherwise(F.col("topic")),
                "stamp_ns": F.coalesce(stamp("$.msg.header"), stamp("$.msg.transforms[0].header"), F.col("stamp_ns").cast("bigint")),
                "_msg": F.try_variant_get(v, "$.msg", "variant"),
            }
        ).drop("_v")
    )
    message = F.lit(None).cast("string")
    for name in types:
        mine = F.col("_error").isNull() & (F.col("type") == name)
        text = let(_read(F.col("_msg"), fields[name]), lambda p: F.when(~p["bad"], F.to_json(p["value"])))
        message = F.when(mine, text).otherwise(message)
    out = with_once(decoded, "message", message)
    reason = F.coalesce("_error", F.when(F.col("message").isNull(), F.concat(F.lit("fields do not fit "), "type")))
    told = out.withColumn("reason", reason).drop("_error", "_msg")
    if mode == "fail":
        return told.filter(F.when(F.col("reason").isNotNull(), F.raise_error(F.concat("topic", F.lit(": "), "reason")).cast("boolean")).otherwise(F.lit(True)))
    return told


def converted(rows: DataFrame) -> DataFrame:
    return rows.filter("reason is null").drop("reason")


def rejected(rows: DataFrame) -> DataFrame:
    """How many rows of each topic did not convert, by reason."""
    return rows.filter("reason is not null").groupBy("topic", "reason").agg(F.count("*").alias("messages"))


# --- merge and summaries -----------------------------------------------------------------------------------------------


def merge_chunks(df: DataFrame) -> DataFrame:
    """One stream over all chunks in time order; equal stamps keep chunk and row order."""
    return df.orderBy("stamp_ns", "chunk", "row_id")


def union_bags(*bags: DataFrame) -> DataFrame:
    """All inputs as one log with ``bag`` as input position."""
    rows = bags[0].withColumn("bag", F.lit(0))
    for position, other in enumerate(bags[1:], 1):
        rows = rows.unionByName(other.withColumn("bag", F.lit(position)), allowMissingColumns=True)
    return rows


def final_topic_types(df: DataFrame, order: Sequence[str] = ("bag", "chunk")) -> DataFrame:
    """Type per topic; where inputs disagree the later definition wins."""
    return df.groupBy("topic").agg(F.max_by("type", F.struct(*order)).alias("type"))


def inspect(df: DataFrame, known_types: DataFrame | None = None, selected: Sequence[str] | None = None) -> DataFrame:
    """Dry run: messages and chunks per topic with its type and what conversion would do; payloads are not read."""
    counts = df.groupBy("topic").agg(
        F.max_by("type", "chunk").alias("type"), F.count("*").alias("messages"), F.count_distinct("chunk").alias("chunks")
    )
    wanted = F.col("topic").isin(*selected) if selected else F.lit(True)
    if known_types is None:
        return counts.withColumn("action", F.when(wanted, "convert").otherwise("skip"))
    known = known_types.select("type").distinct().withColumn("_known", F.lit(True))
    marked = counts.join(known, "type", "left")
    return marked.withColumn("action", F.when(wanted & F.col("_known"), "convert").otherwise("skip")).drop("_known")


def bag_files(df: DataFrame) -> DataFrame:
    """Per chunk: count, first and last *written* stamp (not the extremes), duration."""
    files = df.groupBy("session_id", "chunk").agg(
        F.count("*").alias("messages"), F.min_by("stamp_ns", "row_id").alias("start_ns"), F.max_by("stamp_ns", "row_id").alias("end_ns")
    )
    return files.withColumn("duration_ns", duration_ns(F.col("start_ns"), F.col("end_ns")))


def bag_topics(df: DataFrame) -> DataFrame:
    return df.groupBy("session_id", "topic").agg(F.count("*").alias("messages"))


def bag_summary(df: DataFrame) -> DataFrame:
    """Per session: messages, topics and files, first start, last end, duration not below zero.

    The per-file step is the first aggregation, so a session in one hot group is reduced to its files before the second.
    """
    files = bag_files(df).groupBy("session_id").agg(
        F.sum("messages").alias("messages"), F.count("*").alias("files"), F.min("start_ns").alias("start_ns"), F.max("end_ns").alias("end_ns")
    )
    return files.withColumn("duration_ns", duration_ns(F.col("start_ns"), F.col("end_ns")))


def session_preview(df: DataFrame, camera_topics: Sequence[str]) -> DataFrame:
    """Per session: count, its topics in name order, time range, payload of the first camera message.

    The counts read no payload; pictures come from a scan that the camera filter reaches.
    """
    counts = df.groupBy("session_id").agg(
        F.count("*").alias("messages"),
        F.array_sort(F.collect_set("topic")).alias("topics"),
        F.min("stamp_ns").alias("start_ns"),
        F.max("stamp_ns").alias("end_ns"),
    )
    pictures = first_image(df, camera_topics).select("session_id", F.col("data").alias("first_image"))
    return join_same(counts, pictures, ["session_id"])


def first_image(df: DataFrame, camera_topics: Sequence[str]) -> DataFrame:
    """Earliest camera row per session; the filter reaches the scan."""
    camera = df.filter(F.col("topic").isin(*camera_topics))
    return camera.groupBy("session_id").agg(F.min_by(F.struct("stamp_ns", "row_id", "topic", "data"), F.struct("stamp_ns", "chunk", "row_id")).alias("_f")).select("session_id", "_f.*")


def jpeg_payload(df: DataFrame) -> DataFrame:
    """Camera rows in a JPEG format, payload as bytes."""
    wanted = df.filter(F.lower("format").rlike("jpeg|jpg"))
    return wanted.withColumn("image", F.try_to_binary("data", F.lit("base64"))).filter(F.col("image").isNotNull())


def topic_rates(df: DataFrame) -> DataFrame:
    """Per session and topic: messages, elapsed seconds, messages per second and megabit per second (3 decimals)."""
    sums = df.groupBy("session_id", "topic").agg(
        F.count("*").alias("messages"), F.sum("bytes").alias("bytes"), F.min("stamp_ns").alias("_a"), F.max("stamp_ns").alias("_b")
    )
    elapsed = (F.col("_b") - F.col("_a")) / F.lit(1e9)

    def per_second(value: Column) -> Column:
        return F.when(elapsed > 0, F.round(value / elapsed, 3)).otherwise(F.lit(0.0))

    return sums.select(
        "session_id", "topic", "messages", "bytes", elapsed.alias("elapsed_s"), per_second(F.col("messages")).alias("rate_hz"),
        per_second(F.col("bytes") * 8 / F.lit(1e6)).alias("mbps"),
    )


def topic_ids(df: DataFrame, order: Sequence[str] = ("row_id",)) -> DataFrame:
    """Dense topic id per session in first-seen order, one row per chunk the topic appears in.

    The log is reduced to (session, chunk, topic) first, so the numbering window only sees that small table.
    """
    seen = df.groupBy("session_id", "chunk", "topic").agg(F.min(F.struct(*order)).alias("_first"))
    topics = seen.groupBy("session_id", "topic").agg(F.min("_first").alias("_first"))
    numbered = topics.withColumn("topic_id", F.row_number().over(Window.partitionBy("session_id").orderBy("_first", "topic")).cast("bigint"))
    return seen.join(numbered.select("session_id", "topic", "topic_id"), ["session_id", "topic"]).select("session_id", "chunk", "topic_id", "topic")


def recent_sessions(df: DataFrame, stamp: str = "start_ns") -> DataFrame:
    return df.orderBy(F.col(stamp).desc_nulls_last(), "session_id")


def ordered_by_name(df: DataFrame, *names: str) -> DataFrame:
    return df.orderBy(*names)


# --- sets --------------------------------------------------------------------------------------------------------------


def ordered_distinct(df: DataFrame, col: str, order: Sequence[str]) -> DataFrame:
    """Each value once, at its first position."""
    return df.groupBy(col).agg(F.min(F.struct(*order)).alias("position")).orderBy("position")


def missing_topics(required: Sequence[str], df: DataFrame) -> DataFrame:
    """(session, topic) pairs that are required but not in the log: one aggregation, no join."""
    wanted = F.array(*[F.lit(t) for t in required])
    seen = F.collect_set(F.when(F.col("topic").isin(*required), F.col("topic")))
    return df.groupBy("session_id").agg(seen.alias("_seen")).select("session_id", F.explode(F.array_except(wanted, "_seen")).alias("topic"))
