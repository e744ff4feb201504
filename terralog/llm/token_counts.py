"""Token counts from distinct pre-tokens."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terralog.llm.common import batches, texts_of

#: Pre-tokens that are counted ahead and sent to all tasks: at most so many, of at most so many bytes (32 MB in all).
COMMON, COMMON_BYTES = 500_000, 64
#: A pre-token is a candidate for these once a task has met it so often in one stretch of texts.
OFTEN = 4
#: Distinct pre-tokens that a task counts before it hands them on.
STRETCH = 1 << 19

_SPACED = re.compile(" +[^ ]*")
_loaded: dict[str, PieceCounter] = {}


class PieceCounter:
    """Counts pieces of a sentencepiece model, one pre-token at a time."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        self.model = SentencePieceProcessor(model_file=path)
        #: Texts split before spaces as long as no piece has a space after another character.
        self.cut = not any("▁" in self.model.id_to_piece(k).lstrip("▁") for k in range(self.model.vocab_size()))
        self.cut = self.cut and self.model.encode("  a  b ", out_type=str)[-1] == "▁" and self.model.encode(" ﬁ", out_type=str)[-1] == "ﬁ"
        self.lead = len(self.model.encode("a"))

    def pre_tokens(self, text: str) -> list[str]:
        """Spaces and what follows up to the next space; the model puts one space before the text itself."""
        if not text:
            return []
        if not self.cut:
            return [text]
        full = " " + text.replace("▁", " ")
        return _SPACED.findall(full) if "  " in full or full[-1] == " " else [f" {w}" for w in full[1:].split(" ")]

    def count(self, pre_tokens: list[str]) -> list[int]:
        if not self.cut:
            return [len(x) for x in self.model.encode(pre_tokens, num_threads=1)]
        return [len(x) - self.lead for x in self.model.encode([f"a{p}" for p in pre_tokens], num_threads=1)]


def counter(path: str) -> PieceCounter:
    """The worker's counter for a model file."""
    if path not in _loaded:
        _loaded[path] = PieceCounter(path)
    return _loaded[path]


def _short(pre_token: str) -> bool:
    return len(pre_token) <= COMMON_BYTES and len(pre_token.encode()) <= COMMON_BYTES


def common_pre_tokens(plain: DataFrame, model: str) -> DataFrame:
    """(word, pieces): the most frequent pre-tokens of the table, each counted once."""

    def stretches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = counter(model).pre_tokens, Counter()

        def told() -> pa.RecordBatch:
            often = [(w, n) for w, n in seen.items() if n >= OFTEN and _short(w)]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], ["word", "n"])

        for rows in batches(parts):
            for text in rows.column("body").to_pylist():
                seen.update(split(text))
            if len(seen) > STRETCH:
                yield told()
                seen = Counter()
        yield told()

    def counted(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in parts:
            words = rows.column("word")
            yield pa.RecordBatch.from_arrays([words, pa.array(counter(model).count(words.to_pylist()), pa.int32())], ["word", "pieces"])

    often = plain.select("body").mapInArrow(stretches, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    best = often.orderBy(F.desc("n"), "word").limit(COMMON)
    return best.select("word").mapInArrow(counted, "word string, pieces int")


def token_counts(docs: DataFrame, model: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, n_bytes, n_tokens (of the whole text), over_limit (n_tokens > limit).

    The pieces of a pre-token are counted once and multiplied by how often a document has it; ids never exist.  The most
    frequent pre-tokens are counted first and sent to every task (bounded by ``COMMON`` and ``COMMON_BYTES``); the other
    (document, pre-token, frequency) rows are shuffled by pre-token, so that each is counted once where it meets, and
    summed per document.  No hot pre-token is left for this shuffle: what is frequent is common, and one of more than
    ``COMMON_BYTES`` is counted once in each batch that has it.

    A null or empty text has no tokens.  Repeated rows stay rows of their own.  Other columns are not read.
    """
    spark = docs.sparkSession
    plain = texts_of(docs.withColumn(id_col, F.col(id_col).cast("bigint")), id_col, text_col)
    table = common_pre_tokens(plain, model).toArrow()
    shared = spark.sparkContext.broadcast((table["word"].to_pylist(), table["pieces"].to_pylist()))

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model)
        known = dict(zip(*shared.value))
        for rows in batches(parts):
            places, texts = rows.column("place").to_pylist(), rows.column("body").to_pylist()
            at, words, times, sums, long = [], [], [], [], []
            for place, text in zip(places, texts):
                total = 0
                for word, n in Counter(own.pre_tokens(text)).items():
                    pieces = known.get(word)
                    if pieces is not None:
                        total += pieces * n
                    elif _short(word):
                        at.append(place)
                        words.append(word)
                        times.append(n)
                    else:
                        long.append((len(sums), word, n))
                sums.append(total)
            distinct = list({w for _, w, _ in long})
            pieces_of = dict(zip(distinct, own.count(distinct))) if distinct else {}
            for k, word, n in long:
                sums[k] += pieces_of[word] * n
            yield pa.RecordBatch.from_arrays(
                [pa.array(places + at, pa.int64()), pa.array(rows.column("id").to_pylist() + [None] * len(at), pa.int64()),
                 pa.array([len(t.encode()) for t in texts] + [None] * len(at), pa.int64()),
                 pa.array(sums + times, pa.int64()), pa.array([None] * len(sums) + words, pa.string())],
                ["place", "id", "n_bytes", "n", "word"],
            )

    def met(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str, int] = {}
        for rows in parts:
            words = rows.column("word").to_pylist()
            new = [w for w in dict.fromkeys(words) if w is not None and w not in last]
            found = last | dict(zip(new, counter(model).count(new))) if new else last
            sums = [n if w is None else found[w] * n for w, n in zip(words, rows.column("n").to_pylist())]
            last = {words[-1]: found[words[-1]]} if words and words[-1] is not None else {}
            yield rows.set_column(rows.schema.get_field_index("n"), "n", pa.array(sums, pa.int64())).drop_columns(["word"])

    rows = plain.withColumn("place", F.monotonically_increasing_id()).mapInArrow(split, "place bigint, id bigint, n_bytes bigint, n bigint, word string")
    dealt = rows.withColumn("_meet", F.when(F.col("word").isNull(), F.xxhash64("place")).otherwise(F.xxhash64("word"))).repartition("_meet").drop("_meet")
    sums = dealt.sortWithinPartitions("word").mapInArrow(met, "place bigint, id bigint, n_bytes bigint, n bigint")
    total = F.sum("n").cast("bigint")
    return sums.groupBy("place").agg(F.max("id").alias(id_col), F.max("n_bytes").alias("n_bytes"), total.alias("n_tokens"), (total > limit).alias("over_limit")).drop("place")
