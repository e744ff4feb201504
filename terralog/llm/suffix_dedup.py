"""Repeated byte strings found by a difference-cover sample and bucket-wise sorting of suffixes.

Positions whose remainder lies in a difference cover are the sample.  For any two equal windows there is a shift, below
the cover's period, at which both meet the sample, so only suffixes near sample suffixes with an equal head can repeat.
The work goes through buckets of hash ranges, one at a time in a task, and each bucket's order is found by sorting:

1. heads of sample suffixes: tells which are tied (ranks of the cover sample);
2. tied sample suffixes with the whole context that any window over them needs: a long tie with an earlier one settles
   all windows of that sample position at once;
3. the windows near tied samples that are left: the first of each kind stays.

Only keys travel, one for each distinct value of a block, and one bit per key comes back.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralog.llm.common import batches, texts_of
from terralog.session import freeze, scratch_path

WINDOW = 100
# A difference cover of period 57 (every remainder is the difference of two members).
PERIOD = 57
COVER = (0, 1, 3, 13, 32, 36, 43, 52)

#: Text bytes of a block (a longer document is a block alone), of a text bucket, and per bucket of keys.
BLOCK_BYTES, TEXT_BUCKET_BYTES, KEY_BUCKET_BYTES = 4 << 20, 32 << 20, 16 << 20
#: Spark's own bound on buckets of a table.
MOST_BUCKETS = 100_000

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that they have inverses modulo 2**64
_U = np.uint64


@cache
def _letters(which: int) -> np.ndarray:
    return np.random.default_rng(7 + which).integers(1, 1 << 63, 256, dtype=np.uint64)


_powers_of: dict[int, np.ndarray] = {}


def _powers(base: int, size: int) -> np.ndarray:
    if base not in _powers_of or len(_powers_of[base]) < size:
        steps = np.full(max(size, BLOCK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        _powers_of[base] = np.cumprod(steps)
    return _powers_of[base][:size]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


class Block:
    """Consecutive documents, their sample positions, and hashes of any of their strings."""

    def __init__(self, data: bytes, lengths: list[int], window: int = WINDOW):
        self.window = window
        self.bytes = np.frombuffer(data, np.uint8)
        self.lengths = np.asarray(lengths, np.int64)
        self.ends = np.cumsum(self.lengths)
        self.starts = self.ends - self.lengths
        period = np.zeros(PERIOD, bool)
        period[list(COVER)] = True
        covered = np.tile(period, int(self.lengths.max(initial=0)) // PERIOD + 1)
        self.sample = np.flatnonzero(self._ahead(covered, self.head))
        self._sums: dict[int, np.ndarray] = {}

    @property
    def head(self) -> int:
        """What two equal windows share from their common sample position on, at least."""
        return self.window - PERIOD + 1

    def _ahead(self, like: np.ndarray, size: int) -> np.ndarray:
        """Per document the beginning of ``like``, but nothing where fewer than ``size`` bytes follow."""
        short = np.zeros(size - 1, bool)
        return np.concatenate([short[:0], *(p for n in self.lengths.tolist() for p in (like[: max(0, n - size + 1)], short[:n]))])

    def whole(self) -> np.ndarray:
        """Where a window begins that its document holds."""
        return self._ahead(np.ones(int(self.lengths.max(initial=0)), bool), self.window)

    def hashes(self, which: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        base = _BASES[which]
        if which not in self._sums:
            sums = np.zeros(len(self.bytes) + 1, np.uint64)
            np.multiply(_letters(which)[self.bytes], _powers(base, len(self.bytes)), out=sums[1:])
            self._sums[which] = np.cumsum(sums, out=sums)
        sums = self._sums[which]
        back = _powers(pow(base, -1, 1 << 64), len(self.bytes) + 1)
        return (sums[stop] - sums[start]) * back[start]

    def head_keys(self) -> np.ndarray:
        return _mixed(self.hashes(0, self.sample, self.sample + self.head))

    def contexts(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, last + 1) byte that windows over a sample position can hold, within the document."""
        doc = np.searchsorted(self.ends, at, "right")
        return np.maximum(at - (PERIOD - 1), self.starts[doc]), np.minimum(at + self.window, self.ends[doc])

    def keys(self, start: np.ndarray, stop: np.ndarray, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        length = (stop - start).astype(np.uint64) * _U(1 << 32) + shift.astype(np.uint64)
        return tuple(_mixed(self.hashes(k, start, stop) + _mixed(length + _U(k + 1))) for k in (0, 1))

    def marked(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Bytes from first to last (both included) of any pair; both ascend."""
        steps = np.zeros(len(self.bytes) + 1, np.int8)
        if len(first):
            apart = first[1:] > last[:-1] + 1
            steps[first[np.append(True, apart)]] = 1
            steps[last[np.append(apart, True)] + 1] = -1
        return np.cumsum(steps[:-1], dtype=np.int8).view(bool)


def _order(first: np.ndarray, second: np.ndarray | None = None) -> np.ndarray:
    """Places of the keys in order of the first word; equal keys are together, by place.

    The leading bits in which keys of this range can differ and the place are sorted as one word; where different keys
    share these bits, whole keys are sorted.
    """
    if not len(first):
        return np.zeros(0, np.int64)
    least = first.min()
    spread = (first - least) << _U(64 - max(1, int(first.max() - least).bit_length()))
    low = _U((1 << int(len(first)).bit_length()) - 1)
    order = (np.sort((spread & ~low) | np.arange(len(first), dtype=np.uint64)) & low).astype(np.int64)
    a = spread[order]
    mixed = ((a[1:] ^ a[:-1]) <= low) & (a[1:] != a[:-1])
    if second is not None:
        b = second[order]
        mixed |= (a[1:] == a[:-1]) & (b[1:] != b[:-1])
    if mixed.any():
        return np.argsort(first, kind="stable") if second is None else np.lexsort((second, first))
    return order


def _same_as_before(a: np.ndarray, b: np.ndarray | None) -> np.ndarray:
    """Whether each key but the first equals the one before it."""
    return a[1:] == a[:-1] if b is None else (a[1:] == a[:-1]) & (b[1:] == b[:-1])


class Keys:
    """Distinct keys of a block in order of value, so that buckets (ranges of the first word) lie together."""

    def __init__(self, first: np.ndarray, second: np.ndarray | None, new: np.ndarray, buckets: int):
        self.first, self.second = first[new], second[new] if second is not None else None
        self.bucket = ((self.first >> _U(32)) * _U(buckets) >> _U(32)).astype(np.int64)

    def rows(self, block: int, width: int) -> pa.RecordBatch:
        """One row per bucket: the keys in ``width`` bytes each."""
        cuts = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        if width == 4:
            raw = (self.first >> _U(8)).astype("<u4")
        else:
            raw = np.empty(len(self.first), [("a", "<u8"), ("b", f"<u{width - 8}")])
            raw["a"], raw["b"] = self.first, self.second.astype(f"<u{width - 8}")
        parts = [p.tobytes() for p in np.split(raw, cuts[1:])] if len(cuts) else []
        return pa.RecordBatch.from_arrays(
            [pa.array([block] * len(cuts), pa.int64()), pa.array(self.bucket[cuts], pa.int32()), pa.array(parts, pa.binary())], ["block", "bucket", "keys"]
        )

    def told(self, answers: list[dict] | None) -> np.ndarray:
        """The bit of each distinct key, from the answers of all buckets."""
        out = np.zeros(len(self.first), bool)
        starts = np.flatnonzero(np.diff(self.bucket, prepend=-1))
        sizes = np.diff(starts, append=len(out))
        spans = {int(self.bucket[s]): (int(s), int(n)) for s, n in zip(starts, sizes)}
        for answer in answers or ():
            start, n = spans[answer["bucket"]]
            out[start : start + n] = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=n).astype(bool)
        return out


class Heads(Keys):
    """Head keys of a block; which keys stand more than once is known, but not where they stand."""

    def __init__(self, keys: np.ndarray, buckets: int):
        self.keys, ordered = keys, np.sort(keys)
        new = np.append(True, ordered[1:] != ordered[:-1])[: len(keys)]
        super().__init__(ordered, None, new, buckets)
        self.again = np.diff(np.flatnonzero(new), append=len(keys)) > 1

    def tied(self, answers: list[dict] | None) -> np.ndarray:
        """Which of the keys, as they stand, occur elsewhere.  A table of leading bits sorts out most of the others."""
        known = self.first[self.told(answers) | self.again]
        table = np.zeros(1 << 20, bool)
        table[(known >> _U(44)).astype(np.int64)] = True
        maybe = np.flatnonzero(table[(self.keys >> _U(44)).astype(np.int64)])
        keys = self.keys[maybe]
        at = np.searchsorted(known, keys)
        return maybe[known[np.minimum(at, len(known) - 1)] == keys] if len(known) else maybe


class Distinct(Keys):
    """Keys of a block, and where each stands first."""

    def __init__(self, first: np.ndarray, second: np.ndarray, buckets: int):
        order = _order(first, second)
        a, b = first[order], second[order]
        new = np.append(True, ~_same_as_before(a, b))[: len(a)]
        super().__init__(a, b, new, buckets)
        self.leader = order[new]  # the earliest of its kind


def _bucket_sorter(width: int, earlier_only: bool) -> Callable[[pa.Table], pa.Table]:
    """Sorts one bucket: which keys does an earlier block have (or, else, any other block)?"""

    def sort(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        blobs = table["keys"].to_pylist()
        sizes = [len(b) // width for b in blobs]
        joined = b"".join(blobs)
        if width == 4:
            a, b = np.frombuffer(joined, "<u4").astype(np.uint64) << _U(32), None
        else:
            raw = np.frombuffer(joined, [("a", "<u8"), ("b", f"<u{width - 8}")])
            a, b = np.ascontiguousarray(raw["a"]), np.ascontiguousarray(raw["b"])
        order = _order(a, b)
        same = _same_as_before(a[order], b[order] if b is not None else None)
        again = np.concatenate([[False], same])
        if not earlier_only:
            again[:-1] |= same
        flags = np.empty(len(again), bool)
        flags[order] = again
        bits = [np.packbits(f).tobytes() for f in np.split(flags, np.cumsum(sizes)[:-1])]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "bits": pa.array(bits, pa.binary())})

    return sort


class Rounds:
    """What a block knows after each round; every method can be run again from the text and the answers so far."""

    def __init__(self, row: dict, buckets: int, window: int):
        self.block, self.buckets = Block(row["data"], row["lengths"], window), buckets
        self.number = row["block"]
        self.answers = {k: row.get(f"answers{k}") for k in (1, 2, 3)}

    def heads(self) -> Heads:
        return Heads(self.block.head_keys(), self.buckets)

    def tied(self) -> np.ndarray:
        return self.block.sample[self.heads().tied(self.answers[1])]

    def ties(self, tied: np.ndarray) -> Distinct:
        start, stop = self.block.contexts(tied)
        return Distinct(*self.block.keys(start, stop, tied - start), self.buckets)

    def left(self) -> tuple[np.ndarray, np.ndarray]:
        """(windows that round 2 has settled as repeated, positions of windows that are still open)."""
        tied = self.tied()
        ties = self.ties(tied)
        later = np.ones(len(tied), bool)
        later[ties.leader] = ties.told(self.answers[2])
        block = self.block
        start, _ = block.contexts(tied)
        whole = block.whole()
        settled = block.marked(start[later], tied[later]) & whole
        return settled, np.flatnonzero(block.marked(start, tied) & whole & ~settled)

    def windows(self, at: np.ndarray) -> Distinct:
        return Distinct(*self.block.keys(at, at + self.block.window, np.zeros(len(at), np.int64)), 2 * self.buckets)

    def removed(self) -> np.ndarray:
        """Bytes covered by repeated windows."""
        settled, at = self.left()
        windows = self.windows(at)
        later = np.ones(len(at), bool)
        later[windows.leader] = windows.told(self.answers[3])
        settled[at[later]] = True
        first = np.flatnonzero(settled)
        return self.block.marked(first, first + self.block.window - 1)


def text_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, int]:
    """(blocks of consecutive documents in id order, total bytes): a table in the shared folder, bucketed by block."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, data, held = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            values = [[number], [ids], [[len(d) for d in data]], [b"".join(data)]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["block", "ids", "lengths", "data"])

        for rows in batches(parts):
            for key, text in zip(rows.column("id").to_pylist(), rows.column("body").to_pylist()):
                raw = text.encode()
                if ids and held + len(raw) > block_bytes:
                    yield row()
                    number, ids, data, held = number + 1, [], [], 0
                ids.append(key)
                data.append(raw)
                held += len(raw)
        if ids:
            yield row()

    spark = docs.sparkSession
    plain = texts_of(docs.withColumn(id_col, F.col(id_col).cast("bigint")), id_col, text_col)
    total = plain.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]
    ranged = plain.repartitionByRange("id").sortWithinPartitions("id", "body")
    blocks = ranged.mapInArrow(cut, "block bigint, ids array<bigint>, lengths array<bigint>, data binary")
    name = f"text_blocks_{uuid.uuid4().hex}"
    buckets = min(MOST_BUCKETS, max(1, -(-total // TEXT_BUCKET_BYTES)))
    writer = blocks.write.format("parquet").option("compression", "zstd").option("path", scratch_path(spark, "blocks"))
    writer.bucketBy(buckets, "block").saveAsTable(name)
    return spark.table(name), total


def repeated_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, bucket_bytes: int = KEY_BUCKET_BYTES
) -> DataFrame:
    """One row per document: id, n_bytes, spans ([start, stop) byte ranges that are removed), kept (bytes that remain).

    A byte goes if a string of ``window`` bytes over it also starts earlier: in a document of smaller id, or earlier in
    the same one.  ``window`` must exceed ``PERIOD``.  All strings are judged on the input.

    A null or empty text has no bytes; a text shorter than the window keeps all.  A null id comes before all others;
    rows that repeat an id follow in the order of their texts, so a repeated row repeats the first.  Equality is that of
    two independent hashes, of 128 bits for contexts and of 96 bits for windows.
    """
    if window <= PERIOD:
        raise ValueError(f"windows must be longer than {PERIOD} bytes")
    blocks, total = text_blocks(docs, id_col, text_col, block_bytes)
    buckets = max(1, -(-total // bucket_bytes))

    def asked(rows: DataFrame, keys_of, width: int, earlier_only: bool) -> DataFrame:
        def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in parts:
                for k in range(part.num_rows):
                    row = part.slice(k, 1).to_pylist()[0]
                    yield keys_of(Rounds(row, buckets, window)).rows(row["block"], width)

        sent = rows.mapInArrow(run, "block bigint, bucket int, keys binary")
        back = sent.groupBy("bucket").applyInArrow(_bucket_sorter(width, earlier_only), "block bigint, bucket int, bits binary")
        return freeze(back.groupBy("block").agg(F.collect_list(F.struct("bucket", "bits")).alias("answers")))

    def with_answers(rows: DataFrame, answers: DataFrame, k: int) -> DataFrame:
        return rows.join(answers.withColumnRenamed("answers", f"answers{k}").hint("shuffle_hash"), "block", "left")

    read = blocks
    read = with_answers(read, asked(read, lambda r: r.heads(), 4, False), 1)
    read = with_answers(read, asked(read, lambda r: r.ties(r.tied()), 16, True), 2)
    read = with_answers(read, asked(read, lambda r: r.windows(r.left()[1]), 12, True), 3)

    def cut_out(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                row = part.slice(k, 1).to_pylist()[0]
                rounds = Rounds(row, buckets, window)
                gone, block = rounds.removed(), rounds.block
                spans, kept = [], []
                for a, b in zip(block.starts.tolist(), block.ends.tolist()):
                    edges = np.flatnonzero(np.diff(gone[a:b].astype(np.int8), prepend=0, append=0))
                    spans.append(edges.reshape(-1, 2).tolist())
                    kept.append(block.bytes[a:b][~gone[a:b]].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["ids"], pa.int64()), pa.array(block.lengths, pa.int64()), pa.array(spans, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary())],
                    [id_col, "n_bytes", "spans", "kept"],
                )

    return read.mapInArrow(cut_out, f"{id_col} bigint, n_bytes bigint, spans array<array<bigint>>, kept binary")
