"""Numbers as text against Python's formatting, which is C's; exact quantiles against sorted lists; folds of streams
against plain loops."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terralog.functions.numeric import fixed
from terralog.operators import points, telemetry
from terralog.streaming import stateful


@pytest.mark.parametrize("digits", [1, 4, 6])
def test_fixed_is_exact(spark, digits):
    r = random.Random(digits)
    values = [-7641256.8436125, 7641256.8436125, 0.0078125, 0.0234375, 0.25, 0.75, -0.0, -1e-9, 0.0, 999999.9999999, 0.9999995, 1.5e9 + 0.1234565, 3e15 + 0.5, 1e15]
    values += [r.uniform(-1, 1) * 10 ** r.randint(-9, 12) for _ in range(500)] + [(2 * r.randrange(10**9) + 1) / 2 / 10**digits for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(values)), "i int, v double").repartition(2)
    got = {x["i"]: x["t"] for x in df.select("i", fixed(F.col("v"), digits).alias("t")).collect()}
    assert [got[i] for i in range(len(values))] == [f"%.{digits}f" % v for v in values]


def test_quantiles_are_exact(spark):
    r = random.Random(5)
    # more distinct values than an approximate quantile keeps
    trips = {1: [r.expovariate(0.01) for _ in range(60_001)], 2: [float(r.randrange(3)) for _ in range(1000)], 3: [-5.0, 0.0, 1e-300, math.inf]}
    data = [(k, True, v) for k, values in trips.items() for v in values] + [(1, False, 9e9), (4, False, 1.0)]
    df = spark.createDataFrame(data, "session_id int, success boolean, rtt_ms double").repartition(6)
    full = df.withColumns({"payload_bytes": F.lit(8.0), "message_count": F.lit(1), "elapsed_ms": F.lit(2.0)})
    got = {x["session_id"]: x for x in telemetry.probe_summary(full).collect()}
    for k, values in trips.items():
        values = sorted(values)
        assert got[k]["rtt_ms"] == [values[math.ceil(len(values) * p / 100) - 1] for p in (50, 95)]
    assert got[4]["rtt_ms"] is None and got[1]["failures"] == 1 and got[1]["probes"] == 60_002


class _Seen:
    """Map state that counts its calls."""

    def __init__(self):
        self.keys, self.calls = set(), 0

    def containsKey(self, key):
        self.calls += 1
        return key in self.keys

    def updateValue(self, key, value):
        self.calls += 1
        self.keys.add(key)

    def clear(self):
        self.calls += 1
        self.keys.clear()


def test_resets_inside_a_batch_do_not_touch_the_state():
    seen = _Seen()
    part = stateful._Published(["seq"], "key_text", ["seq", "key_text"])
    part.seen, told, want = seen, [], []
    held = set()
    for batch in range(3):
        data = [(s, s % 5 == 4, None if s % 5 == 4 else "abc"[s * 7 % 3]) for s in range(batch * 1002, batch * 1002 + 1002)]
        for s, is_reset, k in data:
            held, new = (set(), False) if is_reset else (held | {k}, k not in held)
            want += [s] if new else []
        told += [s for out in part.handleInputRows(("s",), iter([pd.DataFrame(data, columns=["seq", "is_reset", "key_text"])]), None) for s in out["seq"]]
    assert sorted(told) == want and seen.keys == {(k,) for k in held}
    assert seen.calls <= 3 * (3 + 1 + 3)  # looked up, forgotten, told: not once per reset


def test_fused_observations_follow_the_rule():
    r = np.random.default_rng(3)
    values, towards = r.uniform(-9, 9, (200, 6)), r.uniform(-1, 1, (200, 3))
    towards[5], towards[90] = 0.0, np.inf
    ways = points.units(towards)
    unit = lambda v: v / np.sqrt(v @ v) if np.isfinite(v).all() and v @ v > 1e-12 else np.array([0.0, 1.0, 0.0])
    assert np.allclose(ways, [unit(v) for v in towards], rtol=1e-14, atol=0)
    mean, normal = values[0], ways[0]
    for n in range(1, 200):
        w = min(n, points.FUSION_CAP)
        mean, normal = (mean * w + values[n]) / (w + 1), unit(normal * w + ways[n])
    state = points.fold_observations((0, None, None), values[:70].tolist(), ways[:70].tolist())
    n, means, way = points.fold_observations(state, values[70:].tolist(), ways[70:].tolist())
    assert n == 200 and np.allclose(means, mean, rtol=1e-12) and np.allclose(way, normal, rtol=1e-12)
