"""Mixes: targets, quotas, draws."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from terralog.llm import mixing as M
from tests.llm import helpers as H


def targets(sizes):
    """Excess over twice a source's size is reshared by weight, round by round."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    total, stopped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in stopped)
        free = [s for s in names if s not in stopped]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        above = {s for s in free if share[s] > 2 * sizes[s]}
        if not above:
            return {s: float(2 * sizes[s]) if s in stopped else share[s] for s in names}
        stopped |= above


def docs_of(spark):
    r = random.Random(8)
    texts = H.odd_texts() + [" ".join(r.choices(H.PROSE, k=r.randrange(1, 60))) for _ in range(200)]
    rows = [(k, t, "en", r.choice(["a", "a", "a", "b", "Z", "é", "", None]), 0) for k, t in enumerate(texts)]
    rows += [(5, "same id", "en", "b", 0)] * 3 + [(None, "no id", "en", "only", 0), (900, " ".join(H.PROSE * 300), "en", "b", 0), (901, None, "en", "empty", 0)]
    return rows, spark.createDataFrame(rows, H.DOC_SCHEMA).repartition(4)


def test_targets(spark):
    r = random.Random(1)
    for _ in range(5):
        sizes = {s: r.choice([0, 1, 10, 500, 10**9]) for s in ["a", "b", "B", "ä", "漢", "😀", None, "", "aa"][: r.randrange(1, 10)]}
        got = M.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
        want = targets(sizes)
        assert {x.source: x.target for x in got} == pytest.approx(want)
        assert sum(x.target for x in got) == pytest.approx(1.5 * sum(sizes.values()))


def test_mix(spark):
    rows, docs = docs_of(spark)
    docs = docs.withColumns({c: F.lit(1) for c in ("row", "start", "number", "block", "taken")})
    documents, draws = M.mixed(docs, block_words=16, shards=5)
    documents, draws = documents.collect(), draws.collect()
    words = lambda t: len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", t or "")])
    assert Counter((d.doc_id, d.source, d.size) for d in documents) == Counter((x[0], x[3], words(x[1])) for x in rows)
    sizes, of = Counter(), {d.row: d for d in documents}
    for x in rows:
        sizes[x[3]] += words(x[1])
    taken, seen = Counter(), Counter()
    for d in draws:
        assert d["from"] >= 0 and d.words > 0 and d["from"] + d.words <= of[d.row].size
        taken[of[d.row].source] += d.words
        seen.update((d.row, w) for w in range(d["from"], d["from"] + d.words))
    for source, target in targets(sizes).items():
        assert abs(taken[source] - target) <= 0.5 + 1e-6
    assert max(seen.values()) == 2
    slots = {(d.shard, d.slot) for d in draws}
    for shard in range(5):
        mine = sorted(s for k, s in slots if k == shard)
        assert mine == list(range(len(mine)))
    per = Counter(k for k, _ in slots)
    assert max(per.values()) - min(per.values()) <= 1 and len(per) == 5
    assert {d.epoch for d in draws} == {0, 1}


def test_reruns_agree(spark):
    _, docs = docs_of(spark)
    one = sorted(map(repr, M.taken_words(docs, block_words=16).collect()))
    assert one == sorted(map(repr, M.taken_words(docs.repartition(7).orderBy("text"), block_words=16).collect()))
    assert one != sorted(map(repr, M.taken_words(docs, block_words=16, seed=1).collect()))


def test_quotas_are_hypergeometric(spark):
    """Two sources of 12 and 8 tickets over two shards: the mean and spread of the draw over many seeds."""
    tickets = spark.createDataFrame([(0, 12), (1, 8)], "number bigint, tickets bigint")
    plans = [M.shard_quotas(tickets, 2, seed).withColumn("seed", F.lit(seed)) for seed in range(150)]
    whole = plans[0]
    for p in plans[1:]:
        whole = whole.unionByName(p)
    got = [r.quota for r in whole.filter("shard = 0 AND number = 0").collect()]
    mean = sum(got) / len(got)
    spread = sum((x - mean) ** 2 for x in got) / len(got)
    assert abs(mean - 6) < 0.4 and 0.8 < spread < 1.8  # 6 and 10 * 0.6 * 0.4 * 10 / 19 = 1.26


def test_quotas_add_up(spark):
    r = random.Random(3)
    for shards in (1, 2, 3, 7, 32):
        tickets = [(k, r.choice([0, 1, 5, 1000, 200_000])) for k in range(9)]
        got = M.shard_quotas(spark.createDataFrame(tickets, "number bigint, tickets bigint"), shards, 4).collect()
        total, rows = Counter(), Counter()
        for q in got:
            assert q.quota >= 0
            total[q.number] += q.quota
            rows[q.shard] += q.quota
        assert all(total[k] == n for k, n in tickets) and set(rows) == set(range(shards))
        assert max(rows.values()) - min(rows.values()) <= 1


def test_empty_and_wordless(spark):
    assert M.taken_words(H.documents(spark, [])).collect() == []
    got = M.taken_words(H.documents(spark, H.doc_rows([None, " ", ""]))).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 3


def test_native(spark):
    """Nothing of the plan runs in Python."""
    plan = M.taken_words(docs_of(spark)[1])._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
