"""Token-id files compressed by Re-Pair grammars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terralog.llm.byte_bpe import TEXT_BYTES, encoder
from terralog.llm.common import batches, texts_of
from terralog.session import scratch_path

#: Ids that share one grammar; a longer document is a block of its own.
BLOCK_IDS = 1 << 20
#: Rounds of replacement, rules per round, and uses that a rule must save.
ROUNDS, RULES, LEAST_USES = 4, 4096, 8

_HASH_BITS = 18
_ODD = np.uint64(0x9E3779B97F4A7C15)  # 2**64 divided by the golden ratio

FILE_SCHEMA = (
    "part int, block int, ids_before bigint, base bigint, doc_ids array<bigint>, doc_lengths array<bigint>, "
    "symbols binary, rules binary, expansions binary"
)


def _round(symbols: np.ndarray, next_symbol: int) -> tuple[np.ndarray, np.ndarray]:
    """Replace the most frequent pairs once, from left to right; returns the shorter symbols and the pairs."""
    keys = symbols[:-1].astype(np.uint64) << np.uint64(32) | symbols[1:]
    bins = ((keys * _ODD) >> np.uint64(64 - _HASH_BITS)).astype(np.int64)
    named = np.zeros(1 << _HASH_BITS, np.uint64)
    named[bins] = keys  # one pair per bin is a candidate; its count is exact
    at = np.flatnonzero(named[bins] == keys)
    bins = bins[at]
    counts = np.bincount(bins, minlength=1 << _HASH_BITS)
    best = np.flatnonzero(counts >= LEAST_USES)
    best = best[np.argsort(-counts[best], kind="stable")[:RULES]]
    if not len(best):
        return symbols, np.zeros((0, 2), np.uint32)
    rule_of = np.full(1 << _HASH_BITS, -1, np.int32)
    rule_of[best] = np.arange(len(best))
    rule = rule_of[bins]
    used = np.flatnonzero(rule >= 0)
    at, rule = at[used], rule[used]
    starts = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    odd = np.repeat(starts & 1 == 1, np.diff(starts, append=len(at)))
    odd[1::2] ^= True
    alone = np.flatnonzero(~odd)  # pairs must not overlap: every other one of a run, from its first on
    at = at[alone]
    out = symbols.copy()
    out[at] = next_symbol + rule[alone]
    keep = np.ones(len(out), bool)
    keep[at + 1] = False
    pairs = named[best]
    return out[keep], np.stack([pairs >> np.uint64(32), pairs & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32)


def compress(ids: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """(base, symbols, rules, expansion length of each rule): symbol base + k stands for the pair in rule k."""
    base = int(ids.max(initial=0)) + 1
    symbols, rules, lengths = ids.astype(np.uint32), np.zeros((0, 2), np.uint32), np.zeros(0, np.int64)
    for _ in range(ROUNDS):
        symbols, new = _round(symbols, base + len(rules)) if len(symbols) > 1 else (symbols, rules[:0])
        if not len(new):
            break
        lengths = np.concatenate([lengths, _lengths(new[:, 0], base, lengths) + _lengths(new[:, 1], base, lengths)])
        rules = np.concatenate([rules, new])
    return base, symbols, rules, lengths


def _lengths(symbols: np.ndarray, base: int, rule_lengths: np.ndarray) -> np.ndarray:
    table = np.append(rule_lengths, 1)  # the last place is that of plain ids
    return table[np.where(symbols >= base, symbols.astype(np.int64) - base, len(rule_lengths))]


def _flat(base: int, rules: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids that each rule stands for, one after the other, and where each begins.

    A rule is written from its two symbols; rules that hold no rule that is still open are written together.
    """
    starts = np.cumsum(lengths) - lengths
    flat, done = np.empty(int(lengths.sum()), np.uint32), np.zeros(len(rules) + 1, bool)
    done[-1] = True  # plain ids
    inner = np.where(rules >= base, rules.astype(np.int64) - base, len(rules))
    left = np.arange(len(rules))
    while len(left):
        ready = left[done[inner[left]].all(axis=1)]
        for side, shift in ((0, 0), (1, _lengths(rules[ready, 0], base, lengths))):
            symbols, at = rules[ready, side], starts[ready] + shift
            _write(flat, at, symbols, base, flat, starts, lengths)
        done[ready] = True
        left = left[~done[left]]
    return flat, starts


def _write(out: np.ndarray, at: np.ndarray, symbols: np.ndarray, base: int, flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
    """Write what each symbol stands for to its place: plain ids themselves, rules from ``flat``."""
    plain = symbols < base
    out[at[plain]] = symbols[plain]
    rule = symbols[~plain].astype(np.int64) - base
    size = lengths[rule]
    before = np.cumsum(size) - size
    every = np.arange(int(size.sum()))
    out[np.repeat(at[~plain] - before, size) + every] = flat[np.repeat(starts[rule] - before, size) + every]


def expand(symbols: np.ndarray, base: int, rules: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids that the symbols stand for: each rule is written out once, and then copied wherever it stands."""
    flat, starts = _flat(base, rules, lengths)
    sizes = _lengths(symbols, base, lengths)
    out = np.empty(int(sizes.sum()), np.uint32)
    _write(out, np.cumsum(sizes) - sizes, symbols, base, flat, starts, lengths)
    return out


def ids_between(base: int, symbols: np.ndarray, rules: np.ndarray, lengths: np.ndarray, start: int, stop: int) -> np.ndarray:
    """Random access: ids ``start`` to ``stop`` of a block, with only the symbols that cover them expanded."""
    if stop <= start:
        return np.zeros(0, np.uint32)
    ends = np.cumsum(_lengths(symbols, base, lengths))
    first, last = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left")
    before = int(ends[first - 1]) if first else 0
    return expand(symbols[first : last + 1], base, rules, lengths)[start - before : stop - before]


def write_token_files(docs: DataFrame, tokenizer: str, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text, append id 0, and write blocks of ids in ascending id order, each with its grammar.

    Texts are range-partitioned by id, so one file holds one range; a row is a block: document ids and lengths, start in
    the file, symbols, rules, and the rules' expansion lengths.  A null text is empty, a null id comes first, and rows
    that repeat an id follow in the order of their texts.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer).encode, TaskContext.get().partitionId()
        keys, tokens, held, block, before = [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            base, symbols, rules, lengths = compress(np.frombuffer(b"".join(tokens), "<u4"))
            values = [part, block, before, base, keys, [len(t) // 4 for t in tokens], symbols.astype("<u4").tobytes(), rules.astype("<u4").tobytes(), lengths.astype("<i8").tobytes()]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.binary()]
            names = [f.split()[0] for f in FILE_SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for rows in batches(parts, TEXT_BYTES):
            for key, found in zip(rows.column("id").to_pylist(), encode(rows.column("body").to_pylist())):
                size = len(found) // 4 + 1
                if keys and held + size > BLOCK_IDS:
                    yield row()
                    keys, tokens, held, block, before = [], [], 0, block + 1, before + held
                keys.append(key)
                tokens.append(found + b"\0\0\0\0")
                held += size
        if keys:
            yield row()

    plain = texts_of(docs.withColumn(id_col, F.col(id_col).cast("bigint")), id_col, text_col)
    ordered = plain.repartitionByRange("id").sortWithinPartitions("id", "body")
    ordered.mapInArrow(run, FILE_SCHEMA).write.parquet(path)


def read_token_files(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """One row per document: id, start (ids of all documents before it), ids (little-endian unsigned 32-bit)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            for row in rows.to_pylist():
                rules = np.frombuffer(row["rules"], "<u4").reshape(-1, 2)
                ids = expand(np.frombuffer(row["symbols"], "<u4"), row["base"], rules, np.frombuffer(row["expansions"], "<i8")).tobytes()
                ends = np.cumsum(row["doc_lengths"])
                starts = ends - row["doc_lengths"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts + row["file_start"] + row["ids_before"], pa.int64()),
                     pa.array([ids[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())], pa.binary())],
                    [id_col, "start", "ids"],
                )

    blocks = spark.read.schema(FILE_SCHEMA).parquet(path)
    sizes = blocks.groupBy("part").agg(F.sum(F.aggregate("doc_lengths", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("_ids"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("_ids").over(before), F.lit(0)).cast("bigint").alias("file_start"))
    placed = blocks.join(F.broadcast(starts), "part")  # one row per file
    return placed.mapInArrow(run, f"{id_col} bigint, start bigint, ids binary")


def token_file_digest(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the files to the shared folder, read them back, and describe each document's ids."""
    path = scratch_path(docs.sparkSession, "token-files")
    write_token_files(docs, tokenizer, path, id_col, text_col)
    return read_token_files(docs.sparkSession, path, id_col).select(
        id_col, "start", F.expr("octet_length(ids) div 4").cast("bigint").alias("n_tokens"), F.crc32("ids").cast("bigint").alias("ids_crc32")
    )
