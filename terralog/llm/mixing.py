"""Mixing sources to target weights: exact quotas split down a tree of shards, then disjoint blocks in permuted order.

DataFrame and SQL functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terralog.session import freeze

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2  # times that a word may be taken
BLOCK_WORDS = 1024
SHARDS = 32
SPAN = 1 << 12  # blocks that one row of the block list stands for


def _placed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(row, doc_id, source, size, start): documents by source and id, with the words of the source before each.

    Rows are range-partitioned in this order, so a hot source lies on many tasks; the running sum is taken inside a
    task, and one row per task and source carries the sums across.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    sized = docs.select(
        F.col(id_col).cast("bigint").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("size"), F.xxhash64(text).alias("tie"),
    )
    order = ["source", "doc_id", "size", "tie"]
    ranged = freeze(sized.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("row", F.monotonically_increasing_id()))
    part = F.shiftright("row", 33)
    within = Window.partitionBy("part", "source").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    local = ranged.withColumn("part", part).withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    sums = ranged.groupBy(part.alias("_part"), F.col("source").alias("_source")).agg(F.sum("size").alias("_size"))
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.select("_part", "_source", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    joined = local.join(carried, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    return joined.select("row", "doc_id", "source", "size", (F.col("inside") + F.col("_before")).alias("start"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, number, source_size, target) of ``sizes`` (source, source_size): weighted shares of ``share`` of all words.

    Sources weigh ``weights`` in turn by code point, null last.  A target stops at ``most`` times its source, and the
    excess goes to the others by weight.  Sources sorted by limit over weight stop in this order, so the level at which
    the rest meets its words follows from running sums; one row per source takes part.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("number", F.row_number().over(ordered).cast("bigint") - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    limited = numbered.withColumns({"weight": weight.cast("bigint"), "limit": F.col("source_size") * most})
    rising = Window.orderBy(F.col("limit") / F.col("weight"), "number").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stopped, weighed = F.coalesce(F.sum("limit").over(rising), F.lit(0)), F.coalesce(F.sum("weight").over(rising), F.lit(0))
    level = (F.sum("source_size").over(whole) * F.lit(float(share)) - stopped) / (F.sum("weight").over(whole) - weighed)
    levels = limited.withColumn("level", level)
    found = F.min_by("level", F.when(F.col("level") <= F.col("limit") / F.col("weight"), F.struct(F.col("limit") / F.col("weight"), F.col("number")))).over(whole)
    target = F.least(F.col("limit").cast("double"), F.coalesce(F.col("found"), F.lit(float("inf"))) * F.col("weight"))
    return levels.withColumn("found", found).select("source", "number", "source_size", target.alias("target"))


def _uniform(*parts: str) -> str:
    """SQL: a number in (0, 1) that depends on the parts."""
    return f"((pmod(xxhash64({', '.join(parts)}), 9007199254740992L) + 0.5D) / 9007199254740992D)"


def _draw(of: str, marked: str, taken: str, u: str) -> str:
    """SQL: how many marked ones are among ``taken`` drawn from ``of`` (hypergeometric), by inversion at ``u``.

    Weights of neighbouring counts have a simple ratio, so they are summed from below over eight standard deviations to
    both sides of the mean (all of the range, where that is smaller), outside of which lies less than a rounding error.
    """
    n, k, m = (f"CAST({x} AS DOUBLE)" for x in (of, marked, taken))
    safe = f"greatest({n}, 1D)"
    mean = f"({m} * {k} / {safe})"
    spread = f"(8D * sqrt(greatest(0D, {mean} * ({n} - {k}) / {safe} * ({n} - {m}) / greatest({n} - 1D, 1D))) + 8D)"
    low = f"greatest(0L, {taken} + {marked} - {of}, CAST(floor({mean} - {spread}) AS BIGINT))"
    high = f"least({marked}, {taken}, CAST(ceil({mean} + {spread}) AS BIGINT))"
    ratio = f"(({k} - x) * ({m} - x) / ((x + 1D) * ({n} - {k} - {m} + x + 1D)))"
    total = f"aggregate(sequence({low}, {high}), named_struct('w', 1D, 't', 0D), (a, x) -> named_struct('w', a.w * {ratio}, 't', a.t + a.w), a -> a.t)"
    start = f"named_struct('w', 1D, 't', 0D, 'at', -1L, 'goal', {u} * {total})"
    step = f"named_struct('w', a.w * {ratio}, 't', a.t + a.w, 'at', if(a.at < 0L AND a.t + a.w >= a.goal, x, a.at), 'goal', a.goal)"
    return f"aggregate(sequence({low}, {high}), {start}, (a, x) -> {step}, a -> if(a.at < 0L, {high}, a.at))"


def shard_quotas(tickets: DataFrame, shards: int = SHARDS, seed: int = 0) -> DataFrame:
    """(shard, number, quota) of ``tickets`` (number 0, 1, ..., tickets): how many of each source every shard gets.

    The tree's root holds the tickets of all sources and is split into halves until a node is one shard.  A left half of
    m tickets gets a multivariate hypergeometric draw: source by source, the share of what is left to draw.  The right
    half gets the rest, so quotas add up exactly, and shards differ by one ticket in all.  A node is one row with a
    number per source, and the tree has as many leaves as shards, whatever the size of the sources.
    """
    nodes = tickets.agg(F.transform(F.sort_array(F.collect_list(F.struct("number", "tickets"))), lambda x: x["tickets"]).alias("quotas"))
    nodes = nodes.select(F.lit(0).cast("bigint").alias("low"), F.lit(shards).cast("bigint").alias("wide"), F.coalesce("quotas", F.array().cast("array<bigint>")).alias("quotas"))
    all_of = "aggregate(quotas, 0L, (s, x) -> s + x)"
    draw = _draw("s.of", "q", "s.m", _uniform(f"{int(seed)}L", "low", "wide", "s.i"))
    fold = (
        f"aggregate(quotas, named_struct('of', {all_of}, 'm', {all_of} * (wide div 2) div wide, 'i', 0L, 'got', CAST(array() AS ARRAY<BIGINT>), 'x', 0L), "
        f"(s, q) -> transform(array({draw}), d -> named_struct('of', s.of - q, 'm', s.m - d, 'i', s.i + 1L, 'got', concat(s.got, array(d)), 'x', d))[0], s -> s.got)"
    )
    for _ in range(max(0, (shards - 1).bit_length())):
        halves = nodes.withColumn("left", F.when(F.col("wide") > 1, F.expr(fold)))
        left = F.struct("low", F.expr("wide div 2").alias("wide"), F.col("left").alias("quotas"))
        right = F.struct(F.expr("low + wide div 2").alias("low"), F.expr("wide - wide div 2").alias("wide"), F.zip_with("quotas", "left", lambda q, x: q - x).alias("quotas"))
        alone = F.struct("low", "wide", "quotas")
        nodes = halves.select(F.explode(F.when(F.col("wide") > 1, F.array(left, right)).otherwise(F.array(alone))).alias("node")).select("node.*")
    return nodes.select(F.col("low").alias("shard"), F.posexplode("quotas").alias("number", "quota")).select("shard", F.col("number").cast("bigint").alias("number"), "quota")


def _blocks(sources: DataFrame, block_words: int) -> DataFrame:
    """(number, epoch, block, want): the blocks of the epochs from which words are taken; want: words of the epoch.

    Long lists are made in two steps with a shuffle between, so no task lists the blocks of a source alone.
    """
    count = F.ceil(F.col("source_size") / block_words).cast("bigint")
    some = sources.filter("words > 0").withColumn("count", count)
    epochs = some.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.when(F.col("words") > F.col("source_size"), 1).otherwise(0))))
    want = F.when(F.col("epoch") == 0, F.least("words", "source_size")).otherwise(F.col("words") - F.col("source_size"))
    spans = epochs.withColumn("want", want).withColumn("span", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("count") - 1) / SPAN))))
    spread = spans.repartition("number", "epoch", "span")
    blocks = F.sequence(F.col("span") * SPAN, F.least((F.col("span") + 1) * SPAN, F.col("count")) - 1)
    return spread.select("number", "epoch", F.explode(blocks).alias("block"), "want", "count")


def _ranked(blocks: DataFrame, seed: int) -> DataFrame:
    """Adds ``place``: the block's position in its source's and epoch's permutation, by the MD5 of seed, source, epoch and block.

    The last block of a source may be shorter, and comes last.  The order is a global sort by range; the first position
    of every (source, epoch) is subtracted.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "number", "epoch", "block").cast("binary"))
    order = ["number", "epoch", "last", "key", "block"]
    ranged = blocks.withColumns({"last": F.col("block") == F.col("count") - 1, "key": key}).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = freeze(ranged.select("number", "epoch", "block", "want").withColumn("mono", F.monotonically_increasing_id()))
    part = F.shiftright("mono", 33)
    counts = rows.groupBy(part.alias("_part"), F.col("number").alias("_number"), F.col("epoch").alias("_epoch")).agg(F.count("*").alias("n"), F.min("mono").alias("first"))
    before = Window.partitionBy("_number", "_epoch").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_part", "_number", "_epoch", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    joined = rows.withColumn("part", part).join(bases, [F.col("part") == F.col("_part"), F.col("number") == F.col("_number"), F.col("epoch") == F.col("_epoch")])
    return joined.select("number", "epoch", "block", "want", (F.col("mono") - F.col("first") + F.col("base")).alias("place"))


def _tickets(words: Column, source_size: Column, block_words: int) -> Column:
    return F.ceil(F.least(words, source_size) / block_words) + F.ceil(F.greatest(words - source_size, F.lit(0)) / block_words)


def mixed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS,
    share: float = SHARE, shards: int = SHARDS, block_words: int = BLOCK_WORDS, seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(documents, draws).  Documents: row, doc_id, source, size, source_size, target, one row per row of ``docs``.  Draws: row,
    doc_id, from, words (the words ``from`` to ``from + words`` of the document), shard, slot (the block's place in its shard), epoch.

    The words of a source, by id, are a line that is cut into blocks.  A source's target is drawn block by block in a
    permuted order: all blocks once if the target is as large, then others a second time, and the last one only as far
    as the target goes, so the words taken are the target rounded.  How many blocks each shard gets of each source is
    decided first (``shard_quotas``); a shard then takes the next so many of the source's order, disjoint from all other
    shards, and sorts its blocks by a hash.

    A null text has no words; a null source is a source of its own, the last; rows that share an id or all columns are
    rows of their own; an empty table gives empty ones.  Documents without words are never drawn.  All depends on the
    rows and the seed only, so reruns agree.  The rows of sources meet in one task, the rows of documents and blocks
    never do: a source that holds most words is spread by range.
    """
    placed = freeze(_placed(docs, id_col, text_col, source_col))
    sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
    words = F.floor(F.col("target") + 0.5).cast("bigint")
    sources = freeze(source_targets(sizes, weights, share).withColumn("words", F.least(words, F.col("source_size") * MOST)))
    quotas = shard_quotas(sources.select("number", _tickets(F.col("words"), F.col("source_size"), block_words).cast("bigint").alias("tickets")), shards, seed)
    ends = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    runs = quotas.withColumn("end", F.sum("quota").over(ends)).groupBy("number").agg(F.sort_array(F.collect_list(F.struct("end", "shard", "quota"))).alias("runs"))

    ranked = _ranked(_blocks(sources, block_words), seed).withColumnRenamed("number", "_number")
    per_source = runs.join(sources.select(F.col("number").alias("_n"), F.ceil(F.col("source_size") / block_words).alias("count")), F.col("number") == F.col("_n")).drop("_n")
    drawn = (
        ranked.filter(F.col("place") * block_words < F.col("want"))
        .join(per_source, F.col("_number") == F.col("number"))
        .withColumn("ticket", F.col("epoch") * F.col("count") + F.col("place"))
        .withColumn("shard", F.expr("filter(runs, r -> r.end > ticket AND r.quota > 0)[0].shard"))
        .select("number", "epoch", "block", "shard", F.least(F.lit(block_words), F.col("want") - F.col("place") * block_words).alias("most"))
    )
    shuffled = Window.partitionBy("shard").orderBy(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("slot"), "number", "epoch", "block").cast("binary")), "number", "epoch", "block")
    drawn = drawn.withColumn("slot", F.row_number().over(shuffled).cast("bigint") - 1)

    named = sources.select(F.col("source").alias("_source"), F.col("number"), "source_size", "target", "words")
    found = placed.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("_source")))  # a row per source
    first, last = F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)
    pieces = found.filter("size > 0 AND words > 0").select("row", "doc_id", "size", "start", "number", F.explode(F.sequence(first, last)).alias("block"))
    at, end = F.greatest(F.col("start"), F.col("block") * block_words), F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.col("most"))
    draws = (
        pieces.join(drawn, ["number", "block"])
        .withColumns({"from": at - F.col("start"), "words": end - at})
        .filter("words > 0")
        .select("row", "doc_id", "from", "words", "shard", "slot", "epoch")
    )
    return found.select("row", "doc_id", "source", "size", "source_size", "target"), draws


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken (words drawn, repeats counted), one row per document."""
    documents, draws = mixed(docs, **options)
    taken = draws.groupBy(F.col("row").alias("_row")).agg(F.sum("words").alias("taken"))
    joined = documents.join(taken, F.col("row") == F.col("_row"), "left")
    return joined.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))
