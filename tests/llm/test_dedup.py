"""Exact, near and byte-string dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralog.llm import common, exact_dedup, simhash, suffix_dedup
from tests.llm import helpers as H


def grown_texts(seed=1, n=60):
    """Odd texts, copies, near copies, a hot text and shared passages."""
    r = random.Random(seed)
    base = [" ".join(r.choices(H.PROSE, k=r.randint(1, 80))) for _ in range(n)]
    near = [b.replace("fox", "cat", 1) for b in base[:20]]
    spaced = [b.replace(" ", "  ", 2) for b in base[:10]]
    passage = " ".join(r.choices(H.PROSE, k=60))
    shared = [f"{r.random()} {passage} {r.random()}" for _ in range(8)]
    texts = H.odd_texts() + base + near + spaced + shared + [base[0]] * 40
    r.shuffle(texts)
    return texts


def test_exact_against_brute_force(spark):
    rows = H.doc_rows(grown_texts())
    groups = H.exact_groups(rows)
    got = {r.doc_id: r for r in exact_dedup.exact_dedup(H.documents(spark, rows, 7)).collect()}
    assert len(got) == len(rows)
    for doc_id, text, *_ in rows:
        keep, size, sha = groups[H.normalised(text)]
        r = got[doc_id]
        assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, size, keep == doc_id, sha)


def test_exact_repeated_rows_and_null_ids(spark):
    rows = [(5, "same text", "en", "s", 1), (5, "same text", "en", "s", 1), (None, "same text", "en", "s", 1), (7, "other", "en", "s", 1)]
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(H.documents(spark, rows)).collect()), key=repr)
    assert sorted(g[3] for g in got) == [False, False, True, True]
    assert {g[1] for g in got} == {5, 7} and (None, 5, 3, False) in got


def test_exact_hot_text_spans_ranges(spark):
    rows = H.doc_rows(["hot " * 500] * 600 + [f"cold {k} " * 300 for k in range(200)])
    docs = H.documents(spark, rows, 4)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        parts = exact_dedup.content_runs(docs).filter(F.col("_id") < 600).select("_part").distinct().count()
        kept = exact_dedup.drop_copies(docs)
        assert parts > 1
        assert sorted(r.doc_id for r in kept.collect()) == [0, *range(600, 800)]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_exact_keeps_all_columns_and_clashing_names(spark):
    rows = [(1, "a b", "x", True), (2, "a  b", "y", False), (3, None, None, None), (4, "", "z", True)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _id string, kept boolean")
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]
    assert exact_dedup.exact_dedup(docs).count() == 4


@pytest.mark.parametrize("operator", [exact_dedup.exact_dedup, exact_dedup.drop_copies, simhash.near_groups, simhash.drop_near_copies, suffix_dedup.repeated_bytes])
def test_empty_table(spark, operator):
    assert operator(H.documents(spark, [])).collect() == []


def test_fingerprints(spark):
    for text in grown_texts(3):
        text = text or ""
        assert simhash.fingerprint(text) & (1 << 64) - 1 == H.simhash(text), text[:60]


def test_near_groups_against_brute_force(spark):
    rows = H.doc_rows(grown_texts(2))
    prints = {r[0]: H.simhash(r[1]) for r in rows}
    roots = H.linked(prints)
    got = {r.doc_id: r for r in simhash.near_groups(H.documents(spark, rows)).collect()}
    assert {k: (f"{prints[k]:016x}", roots[k]) for k in prints} == {k: (r.fingerprint, r.component_id) for k, r in got.items()}
    kept = simhash.drop_near_copies(H.documents(spark, rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(k for k in roots if roots[k] == k) and kept.columns == H.documents(spark, rows).columns


def test_ball_links_find_every_pair(spark):
    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(60)]
    prints = set(base)
    for b in base:
        for _ in range(4):
            prints.add(b ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 3))))
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    links = simhash.ball_links(spark.createDataFrame([(p,) for p in signed], "fp bigint"))
    roots = {x.node: x.root for x in simhash.components(links).collect()}
    want = H.linked({p: p & (1 << 64) - 1 for p in signed})
    groups = lambda of: {frozenset(k for k in signed if of(k) == of(g)) for g in signed}
    assert groups(lambda k: roots.get(k, k)) == groups(lambda k: want[k])


def test_components_of_a_long_chain(spark):
    links = spark.range(400).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = simhash.components(links).collect()
    assert len(found) == 401 and {r.root for r in found} == {0}


@pytest.mark.parametrize("links, tables", [([], 1), ([(5, 1), (1, 6), (7, 1), (9, 8), (4, 4)], 1), ([(5, 1), (5, 2), (2, 9), (8, 7)], 3)])
def test_components_stop_at_stars(spark, monkeypatch, links, tables):
    """Links that are stars already are written once; no further round finds that out."""
    made, freeze = [], common.freeze
    monkeypatch.setattr(common, "freeze", lambda df: made.append(1) or freeze(df))
    got = {r.node: r.root for r in common.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    joined = {k: {k} for pair in links for k in pair if pair[0] != pair[1]}
    for x, y in links * len(links):
        if x != y:
            joined[x] = joined[y] = joined[x] | joined[y]
    assert got == {k: min(of) for k, of in joined.items()} and len(made) == tables


@pytest.mark.parametrize("block_bytes, bucket_bytes", [(1 << 22, 1 << 24), (700, 3000)])
def test_repeated_bytes_against_brute_force(spark, block_bytes, bucket_bytes):
    rows = H.doc_rows(grown_texts(5, 40)) + [(None, "null id " * 40, "en", "s", 1), (3, "null id " * 40, "en", "s", 1)]
    got = suffix_dedup.repeated_bytes(H.documents(spark, rows, 5), block_bytes=block_bytes, bucket_bytes=bucket_bytes).collect()
    mine = sorted(((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got), key=repr)
    assert mine == sorted(H.without_repeats(rows), key=repr)
    assert any(m[2] for m in mine)


def test_a_block_holds_no_words_per_byte():
    block = suffix_dedup.Block(b"ab" * 50_000, [60_000, 0, 20, 39_980])
    assert sum(v.nbytes for v in vars(block).values() if isinstance(v, np.ndarray)) < 3 * len(block.bytes)
    place = np.concatenate([np.arange(n) for n in block.lengths])
    left = np.repeat(block.ends, block.lengths) - np.arange(len(block.bytes))
    assert block.sample.tolist() == np.flatnonzero(np.isin(place % suffix_dedup.PERIOD, suffix_dedup.COVER) & (left >= block.head)).tolist()
    assert (block.whole() == (left >= block.window)).all()
    start, stop = block.contexts(block.sample)
    assert (start == block.sample - np.minimum(suffix_dedup.PERIOD - 1, place[block.sample])).all()
    assert (stop == block.sample + np.minimum(block.window, left[block.sample])).all()


@pytest.mark.parametrize("most", [3, 1 << 40, (1 << 64) - 1])
@pytest.mark.parametrize("paired", [False, True])
def test_keys_are_ordered_whole(most, paired):
    r = np.random.default_rng(3)
    kinds = r.integers(0, most, 300, dtype=np.uint64)
    first = np.concatenate([r.choice(kinds, 2000), kinds + np.uint64(1)])  # neighbours differ in the last bit only
    second = r.integers(0, 2, len(first), dtype=np.uint64) if paired else None
    order = suffix_dedup._order(first, second)
    keys = [(int(first[k]), int(second[k]) if paired else 0) for k in order]
    assert [k[0] for k in keys] == sorted(first.tolist()) and sorted(order.tolist()) == list(range(len(first)))
    runs = [k for k, before in zip(keys, [None, *keys]) if k != before]
    assert len(runs) == len(set(keys)) and all(a < b for a, b, x, y in zip(order, order[1:], keys, keys[1:]) if x == y)
    assert suffix_dedup._order(first[:0]).tolist() == []
    heads = suffix_dedup.Heads(first, 1)
    counts = np.unique(first, return_counts=True)
    assert heads.tied(None).tolist() == np.flatnonzero(np.isin(first, counts[0][counts[1] > 1])).tolist()


def test_cover_has_all_differences():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))
    with pytest.raises(ValueError):
        suffix_dedup.repeated_bytes(None, window=suffix_dedup.PERIOD)
