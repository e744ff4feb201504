"""Cost-balanced packing of token ids into sequences."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralog.llm.byte_bpe import TEXT_BYTES, encoder
from terralog.llm.common import batches, texts_of

#: Model width for which the quadratic share of a token's cost is estimated.
WIDTH = 4096
#: Tokens that are packed together; a task holds one such block at a time.
BLOCK_TOKENS = 1 << 22

ID_BYTES = 4
_END = (0).to_bytes(ID_BYTES, "little")


def attention_cost(length: int, width: int = WIDTH) -> float:
    """Linear plus quadratic cost of a piece: per token the dense layers, and attention over the piece's own tokens."""
    return length + length * length / (6 * width)


def capacities(tokens: int, most: int) -> list[int]:
    """Full sequences for the tokens, and for the rest the powers of two that sum to it, which take no padding."""
    rest = tokens % most
    return [most] * (tokens // most) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(lengths: list[int], most: int, width: int = WIDTH) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Pieces (item, start, length, sequence, offset) of all items, and the number of sequences.

    Items in descending length go to the sequence of lowest cost that has room; where it has too little, the item is
    cut and its rest goes on to the next lowest.  An item of a whole sequence or more first fills sequences alone.
    """
    pieces, rests, at = [], [], 0
    for item, length in enumerate(lengths):
        for start in range(0, length - most + 1, most):
            pieces.append((item, start, most, at, 0))
            at += 1
        if length % most:
            rests.append((length % most, item, length - length % most))
    rooms = capacities(sum(r[0] for r in rests), most)
    filled = [0] * len(rooms)
    heap = [(0.0, k) for k in range(len(rooms))]
    for length, item, start in sorted(rests, key=lambda r: (-r[0], r[1])):
        while length:
            cost, k = heapq.heappop(heap)
            part = min(length, rooms[k] - filled[k])
            pieces.append((item, start, part, at + k, filled[k]))
            filled[k] += part
            if filled[k] < rooms[k]:
                heapq.heappush(heap, (cost + attention_cost(part, width), k))
            length, start = length - part, start + part
    return pieces, at + len(rooms)


def packed_pieces(docs: DataFrame, tokenizer: str, most: int = 1024, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A document's ids are those of its whole text, then id 0.  Each task packs its documents block by block, so no row
    moves between tasks and a block's size does not depend on the table.  Sequences are filled to ``most`` tokens; what
    remains of a block fills sequences of powers of two, so there is no padding.  ``sequence_id`` is unique in the table
    and does not change when a task runs again.

    A null or empty text has the end id alone.  Repeated rows are packed as often as they occur.  No rows give no
    sequences.  Other columns are not read.
    """

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, first = encoder(tokenizer).encode, TaskContext.get().partitionId() << 36
        ids, tokens, held = [], [], 0

        def packed() -> pa.RecordBatch:
            nonlocal first
            pieces, used = pack([len(t) // ID_BYTES for t in tokens], most, width)
            item, start, length, sequence, offset = zip(*pieces)
            columns = [
                pa.array([ids[i] for i in item], pa.int64()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array([tokens[i][ID_BYTES * s : ID_BYTES * (s + n)] for i, s, n in zip(item, start, length)], pa.binary()),
                pa.array([len(tokens[i]) // ID_BYTES for i in item], pa.int64()),
                pa.array([first + s for s in sequence], pa.int64()), pa.array(offset, pa.int64()),
            ]
            first += used
            return pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        for rows in batches(parts, TEXT_BYTES):
            for key, found in zip(rows.column("id").to_pylist(), encode(rows.column("body").to_pylist())):
                ids.append(key)
                tokens.append(found + _END)
                held += len(tokens[-1]) // ID_BYTES
                if held >= BLOCK_TOKENS:
                    yield packed()
                    ids, tokens, held = [], [], 0
        if ids:
            yield packed()
        encoder(tokenizer).forget()

    plain = texts_of(docs.withColumn(id_col, F.col(id_col).cast("bigint")), id_col, text_col)
    schema = "id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint"
    return plain.mapInArrow(run, schema).withColumnRenamed("id", id_col)
