"""Shards, decontamination, classifiers and the pipeline."""

import random
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as driver
import corpus_pipeline
from terralog.llm import decontamination, fm_index, hilbert, labelled, quality, queries, simhash, toxicity
from tests.llm import helpers as H

FOLDER = "/root/testdata/sf0.001"


def test_curve_visits_neighbours():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        mask = (1 << bits) - 1
        cells = {hilbert.curve_index(p, bits): p for c in range(1 << dims * bits) for p in [[c >> bits * k & mask for k in range(dims)]]}
        assert sorted(cells) == list(range(1 << dims * bits))
        assert all(sum(abs(a - b) for a, b in zip(cells[k], cells[k + 1])) == 1 for k in range(len(cells) - 1))


def test_shards(spark):
    rows = H.doc_rows(H.odd_texts() * 9) + [(None, "no id", None, None, None), (4, "a", "en", "src1", 1)]
    got = hilbert.hilbert_shards(H.documents(spark, rows, 6), 40).collect()
    texts = {r[0]: r[1] or "" for r in rows}
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None and r.doc_id != 4:
            raw = texts[r.doc_id].encode()
            assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "rows", None)
    counts = [sum(1 for r in got if r.shard == s) for s in range(40)]
    assert max(counts) - min(counts) <= 1
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    ordered = sorted(got, key=lambda r: (r.shard, r.slot))
    assert [r.curve for r in ordered] == sorted(r.curve for r in got)
    assert hilbert.hilbert_shards(H.documents(spark, [])).collect() == []


def test_fm_index():
    r = random.Random(1)
    for _ in range(150):
        text = [r.randint(1, 4) for _ in range(r.randint(1, 60))]
        phrases = [[r.randint(1, 9 if r.random() < 0.1 else 4) for _ in range(r.randint(1, 4))] for _ in range(20)]
        index = fm_index.FMIndex(np.array(text))
        low, high = index.search(np.array([[0] * (4 - len(p)) + p for p in phrases]), np.array([len(p) for p in phrases]))
        found, at = index.locate(low, high)
        want = sorted((k, i) for k, p in enumerate(phrases) for i in range(len(text) - len(p) + 1) if text[i : i + len(p)] == p)
        assert sorted(zip(found.tolist(), at.tolist())) == want


def items_and_rows():
    r = random.Random(6)
    pick = lambda n: " ".join(r.choices(H.PROSE, k=n))
    items = [(k, pick(n)) for k, n in enumerate([30, 25, 13, 14, 5, 1, 0])] + [(7, None), (8, "Größe  GROẞE größe"), (0, pick(20)), (None, pick(15))]
    items = [i for i in items if i[0] is not None]
    texts = H.odd_texts() + [pick(200) for _ in range(10)] + [f"{pick(40)} {items[k % 4][1].upper()} {pick(40)}" for k in range(12)] + [items[0][1]] * 5
    texts += [f"zzz {items[1][1]} yyy {items[2][1]}", " ".join(f"w{k}" for k in range(600)) + " " + items[0][1], "größe, groẞe; größe"]
    return items, H.doc_rows(texts)


@pytest.mark.parametrize("shard_words, pass_words", [(1 << 18, 1 << 22), (50, 40)])
def test_decontamination_against_brute_force(spark, monkeypatch, shard_words, pass_words):
    items, rows = items_and_rows()
    monkeypatch.setattr(decontamination, "PASS_WORDS", pass_words)
    benchmark = spark.createDataFrame(items, "item_id bigint, text string")
    found = decontamination.contaminated_spans(H.documents(spark, rows), benchmark, shard_words=shard_words)
    got = {r.doc_id: tuple(r)[1:] for r in decontamination.digest(found).collect()}
    assert got == {r[0]: H.contaminated(r[1], items) for r in rows}
    kept = decontamination.drop_contaminated(H.documents(spark, rows), benchmark)
    assert sorted(r.doc_id for r in kept.collect()) == [r[0] for r in rows if not H.contaminated(r[1], items)[4]]


def test_decontamination_of_empty_tables(spark):
    items, rows = items_and_rows()
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.contamination(H.documents(spark, []), spark.createDataFrame(items, none.schema)).collect() == []
    assert all(not r.contaminated and r.n_items == 0 for r in decontamination.contamination(H.documents(spark, rows), none).collect())


def test_folds(spark):
    got = spark.range(200).select("id", labelled.in_fold(F.col("id"), 5, 0).alias("a"), labelled.in_fold(F.lit(None).cast("bigint"), 5, 0).alias("b")).collect()
    assert all(r.a == (zlib.crc32(str(r.id).encode()) % 5 == 0) and r.b is False for r in got)


def accuracy(spark, query, label, folder="/root/testdata/sf0.01"):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = query(spark, folder)
    assert scored.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert scored.filter("score is null or score < 0 or score > 1 or isnan(score)").isEmpty()
    return scored.filter("held_out").join(labels, "doc_id").select("predicted", label, "score").collect()


def test_quality_on_held_out_rows(spark):
    got = accuracy(spark, queries.op9_quality, "quality")
    assert sum(r.predicted == r.quality for r in got) >= 0.95 * len(got)


def test_quality_fit_holds_its_matrix_once():
    """The driver fits from Arrow lists: no Python object per term, and no second matrix."""
    r = random.Random(8)
    rows = [quality.terms_of(" ".join(r.choices(H.PROSE, k=r.randint(0, 300)))) for _ in range(2000)]
    labels = [k % 3 % 2 for k in range(len(rows))]
    table = pa.table({"columns": pa.array([list(f) for f in rows], pa.list_(pa.int32())), "counts": pa.array([list(f.values()) for f in rows], pa.list_(pa.float64()))})
    table = pa.concat_tables([table.slice(0, 700), table.slice(700)])
    want = quality.matrix_of(rows)
    tracemalloc.start()
    matrix = quality.matrix_of_table(table)
    same = all((matrix[k : k + 100] == want[k : k + 100]).all() for k in range(0, len(rows), 100))
    space = quality.fit_space(matrix, labels, {0: 20_000, 1: 5000})
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert same and peak < 1.6 * want.nbytes
    assert space.voters.shape == (len(rows), quality.LATENT) and np.allclose(np.linalg.norm(space.voters, axis=1), 1, atol=1e-3)


def test_toxicity_on_held_out_rows(spark):
    got = accuracy(spark, queries.op8_toxicity, "toxic", "/root/testdata/sf0.1")
    assert sum(r.predicted == r.toxic for r in got) >= 0.95 * len(got)
    assert sum(r.predicted and r.toxic for r in got) >= 0.75 * sum(r.toxic for r in got)
    assert sum(r.predicted and not r.toxic for r in got) <= 0.02 * len(got)


def test_counterfactuals_lower_false_positives(spark):
    """An identity term stands in most bad training rows; neutral mentions must not be called toxic for it."""
    r = random.Random(2)
    words = [f"word{k}" for k in range(300)]
    rows = []
    for k in range(600):
        bad = k % 3 == 0
        text = r.choices(words, k=20) + (["vile"] if bad and r.random() < 0.7 else []) + (["muslim"] if bad or r.random() < 0.02 else [])
        r.shuffle(text)
        rows.append((k, " ".join(text), int(bad)))
    sample = spark.createDataFrame(rows, "id bigint, body string, label int")
    plain, fair = toxicity.train(sample, penalty=0.0), toxicity.train(sample, penalty=50.0)
    neutral = [" ".join([*r.choices(words, k=15), "muslim", "families"]) for _ in range(50)]
    assert abs(fair.weights["muslim"] - fair.weights["christian"]) < 0.5 * abs(plain.weights["muslim"] - plain.weights["christian"])
    assert sum(fair.score(t) >= 0.5 for t in neutral) < sum(plain.score(t) >= 0.5 for t in neutral)
    assert fair.score("word1 vile word2 vile") > 0.5


@pytest.mark.parametrize("score, label", [(toxicity.toxicity_scores, "toxic"), (quality.quality_scores, "quality")])
def test_classifiers_without_rows_or_labels(spark, score, label):
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert score(H.documents(spark, []), none, label).collect() == []
    assert score(H.documents(spark, H.doc_rows(H.odd_texts())), none, label).count() == len(H.odd_texts())
    some = spark.createDataFrame([(7, 1, 1), (7, 0, 0), (8, None, None), (None, 1, 1), (9, 0, 0)], none.schema)
    docs = H.documents(spark, H.doc_rows(H.odd_texts())).withColumns({c: F.lit(1) for c in ("label", "id", "score")})
    assert score(docs, some, label).count() == len(H.odd_texts())


def test_pipeline_against_plain_loops(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = {r.doc_id: r.text for r in corpus_pipeline.quality(spark, docs, FOLDER).collect()}
    scores = {r.doc_id: r.predicted for r in queries.op9_quality(spark, FOLDER).collect()}
    assert set(kept) == {k for k, v in scores.items() if v == 1}
    groups = H.exact_groups(list(kept.items()))
    kept = {k: kept[k] for k, _, _ in groups.values()}
    shingled, first = {k: set(simhash.shingles(t, 5)) or {""} for k, t in kept.items()}, []
    for k in sorted(kept):  # no kept text of smaller id shares 0.8 of the five-word shingles
        if not any(5 * len(shingled[k] & shingled[j]) >= 4 * len(shingled[k] | shingled[j]) for j in first):
            first.append(k)
    kept = {k: kept[k] for k in first}
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    kept = {k: t for k, t in kept.items() if not H.contaminated(t, items)[4]}
    pieces = corpus_pipeline.run(spark, FOLDER).collect()
    ids = dict(zip(kept, H.token_ids(list(kept.values()))))
    assert {p.doc_id for p in pieces} == set(kept)
    assert all(p.ids == H.packed(ids[p.doc_id][p.start : p.start + p.length]) and p.ids_crc32 == zlib.crc32(p.ids) for p in pieces)
    assert sum(p.length for p in pieces) == sum(map(len, ids.values()))


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_on_odd_and_empty_tables(spark, name, stage):
    for rows in ([], H.doc_rows(H.odd_texts()) + [(None, None, None, None, None), (2, "a", "en", "s", 1)]):
        docs = H.documents(spark, rows).withColumn("_place", F.lit(1))
        out = stage(spark, docs, FOLDER)
        out.collect()
        assert name == "packing" or out.columns == docs.columns


def test_all_are_registered():
    names = set(driver.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "decontamination", "packing"]
