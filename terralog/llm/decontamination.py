"""Benchmark decontamination with an FM-index per shard of documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terralog.llm.common import batches, texts_of
from terralog.llm.fm_index import FMIndex
from terralog.session import freeze

WINDOW = 13
#: Words of one shard's index, and benchmark words that are searched in one pass over the documents.
SHARD_WORDS, PASS_WORDS = 1 << 18, 1 << 22

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8: digits, letters of A to Z in lower case, and everything beyond ASCII."""
    return text.encode().translate(_LOWER).split()


class Phrases:
    """Test phrases: every ``window`` consecutive words of an item, or the whole of a shorter item."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, words in items if words})
        place = {name: k for k, name in enumerate(self.names)}
        found: dict[tuple[int, ...], set[int]] = {}
        for name, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 2) for w in words]  # 0 ends a text, 1 parts runs
            size = min(window, len(ids))
            for start in range(len(ids) - size + 1 if ids else 0):
                found.setdefault(tuple(ids[start : start + size]), set()).add(place[name])
        phrases = sorted(found)
        self.lengths = np.array([len(p) for p in phrases], np.int64)
        self.words = np.array([[0] * (window - len(p)) + list(p) for p in phrases], np.int32).reshape(len(phrases), window)
        self.items = [sorted(found[p]) for p in phrases]
        self.shortest = int(self.lengths.min(initial=window))

    def known_runs(self, words: list[bytes]) -> tuple[list[np.ndarray], list[int]]:
        """Runs of consecutive benchmark words that are long enough to hold a phrase, with their word positions.

        No phrase holds a word from outside the benchmark, so nothing else can be part of an occurrence.
        """
        get = self.vocabulary.get
        ids = np.array([0, *[get(w, 0) for w in words], 0], np.int32)
        edges = np.flatnonzero(np.diff(ids > 0))
        starts, stops = edges[::2], edges[1::2]
        long = stops - starts >= self.shortest
        return [ids[a + 1 : b + 1] for a, b in zip(starts[long], stops[long])], starts[long].tolist()


def shard_spans(phrases: Phrases, shard: list[tuple[list[np.ndarray], list[int]]]) -> list[tuple[list[list[int]], list[int]]]:
    """Per document of a shard: (merged spans [start, stop) in words, items that occur), from one index over all runs."""
    out: list[tuple[list[list[int]], list[int]]] = [([], []) for _ in shard]
    runs = [(run, doc, start) for doc, (found, starts) in enumerate(shard) for run, start in zip(found, starts)]
    if not runs:
        return out
    text = np.concatenate([part for run, _, _ in runs for part in (run, [1])])
    index = FMIndex(text)
    phrase, at = index.locate(*index.search(phrases.words, phrases.lengths))
    if not len(at):
        return out
    begins = np.concatenate([[0], np.cumsum([len(run) + 1 for run, _, _ in runs])[:-1]])
    place = np.searchsorted(begins, at, "right") - 1
    doc = np.array([d for _, d, _ in runs])[place]
    start = np.array([s for _, _, s in runs])[place] + at - begins[place]
    order = np.lexsort((start, doc))
    for d, a, n, p in zip(doc[order].tolist(), start[order].tolist(), phrases.lengths[phrase[order]].tolist(), phrase[order].tolist()):
        spans = out[d][0]
        if spans and a <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], a + n)
        else:
            spans.append([a, a + n])
        out[d][1].append(p)
    return [(spans, sorted({i for p in set(found) for i in phrases.items[p]})) for spans, found in out]


def _passes(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> list[Phrases]:
    """The query set in blocks of at most ``PASS_WORDS`` words, one at least."""
    blocks, held, size = [], [], 0
    for name, text in benchmark.select(F.col(item_col).cast("string"), F.coalesce(F.col(text_col), F.lit(""))).toLocalIterator():
        words = words_of(text)
        if held and size + len(words) > PASS_WORDS:
            blocks.append(Phrases(held, window))
            held, size = [], 0
        held.append((name or "", words))
        size += len(words)
    return [*blocks, Phrases(held, window)]


def contaminated_spans(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """One row per document: id, n_words, spans (merged [start, stop) word ranges to remove), items (names that occur).

    The documents of a task are cut into shards of at most ``SHARD_WORDS`` indexed words (a longer document is a shard
    alone).  A shard's FM-index is searched backwards for all phrases together through wavelet-matrix ranks; occurrences
    are located by sampled suffix positions, and overlapping ones are merged.  The benchmark is a stated query set: it
    is sent to the tasks in blocks of ``PASS_WORDS`` words, each one pass over the documents.

    Null or empty texts have no words; an item without words has no phrase; a null item name is the empty name.
    Repeated rows stay rows of their own; items that repeat a name count once.
    """
    plain = texts_of(docs.withColumn(id_col, F.col(id_col).cast("bigint")), id_col, text_col).withColumn("place", F.monotonically_increasing_id())
    blocks = _passes(benchmark, item_col, item_text_col, window)
    if len(blocks) > 1:
        plain = freeze(plain)  # all passes must see the same places
    sc, found = docs.sparkSession.sparkContext, None
    schema = "place bigint, id bigint, n_words bigint, spans array<array<bigint>>, items array<string>"
    for block in blocks:
        search = plain.select("place", "id", "body").mapInArrow(_searcher(sc.broadcast(block), shard_words), schema)
        found = search if found is None else found.unionByName(search)
    if len(blocks) > 1:
        found = found.groupBy("place").agg(
            F.first("id").alias("id"), F.first("n_words").alias("n_words"), _merged(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        )
    named = found.select("place", F.col("id").alias(id_col), "n_words", "spans", F.array_sort("items").alias("items"))
    return named.drop("place")


def _merged(spans: Column) -> Column:
    """Spans of several passes as disjoint ones in order."""
    empty = F.array().cast("array<array<bigint>>")

    def add(done: Column, span: Column) -> Column:
        last = F.element_at(done, -1)
        joined = F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.array(last[0], F.greatest(last[1], span[1]))))
        return F.when((F.size(done) > 0) & (span[0] <= F.get(last, F.lit(1))), joined).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), empty, add)


def _searcher(shared, shard_words: int):
    def search(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases: Phrases = shared.value
        heads, shard, held = [], [], 0

        def told() -> pa.RecordBatch:
            found = shard_spans(phrases, shard)
            place, ids, words = zip(*heads)
            return pa.RecordBatch.from_arrays(
                [pa.array(place, pa.int64()), pa.array(ids, pa.int64()), pa.array(words, pa.int64()),
                 pa.array([spans for spans, _ in found], pa.list_(pa.list_(pa.int64()))),
                 pa.array([[phrases.names[i] for i in items] for _, items in found], pa.list_(pa.string()))],
                ["place", "id", "n_words", "spans", "items"],
            )

        for rows in batches(parts):
            for place, key, text in zip(rows.column("place").to_pylist(), rows.column("id").to_pylist(), rows.column("body").to_pylist()):
                words = words_of(text)
                runs = phrases.known_runs(words)
                size = sum(len(r) + 1 for r in runs[0])
                if heads and (held + size > shard_words or len(heads) >= shard_words):
                    yield told()
                    heads, shard, held = [], [], 0
                heads.append((place, key, len(words)))
                shard.append(runs)
                held += size
        if heads:
            yield told()

    return search


def _hits() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s[1] - s[0])


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the document's words lie in occurrences."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row of ``contaminated_spans``: id, n_words, n_hit, n_items, items_sha256 (sorted names, comma-joined), contaminated."""
    return spans.select(
        id_col, "n_words", _hits().alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", is_contaminated(F.col("n_hit"), F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The digest of every document's contaminated spans."""
    return digest(contaminated_spans(docs, benchmark, window))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents that ``contamination`` does not call contaminated, with all their columns.

    Rows are told apart by their place, so null or repeated ids do no harm; they are written once with it, since a row's
    place may differ when a plan runs again.
    """
    placed = freeze(docs.select(*[F.col(c).alias(f"_c_{c}") for c in docs.columns]).withColumn("_place", F.monotonically_increasing_id()))
    asked = placed.select(F.col("_place").alias("doc_id"), F.col("_c_text").alias("text"))
    marked = contamination(asked, benchmark, window).filter("contaminated").select(F.col("doc_id").alias("_place"))
    return placed.join(marked, "_place", "left_anti").select(*[F.col(f"_c_{c}").alias(c) for c in docs.columns])
