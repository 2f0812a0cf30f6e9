"""The multipliers of the mix against bisection in plain Python, up to the cap and down to nothing."""

import math
import random

from pyspark.sql import functions as F

from sylva.llm import mixing

MOST = 3.0


def taken(lam, mean, sizes):
    return sum(n * x * min(MOST, math.exp(min(50.0, lam * x / mean))) for x, n in sizes)


def by_bisection(target, mean, sizes):
    low, high = -1e9, 1e9
    for _ in range(300):
        middle = (low + high) / 2
        low, high = (middle, high) if taken(middle, mean, sizes) < target else (low, middle)
    return high


def histograms():
    rng = random.Random(11)
    out = [({100_000: 3, 10: 57}, 2.9985), ({5: 10}, 1.0), ({7: 3}, 0.2)]
    for k in range(200):
        sizes = {int(10 ** rng.uniform(0, 5)): rng.randint(1, 200) for _ in range(rng.randint(1, 30))}
        out.append((sizes, (10 ** rng.uniform(-5, 0), rng.uniform(0.5, 2.9), MOST * (1 - 10 ** rng.uniform(-4, -1)))[k % 3]))
    return out


def test_every_feasible_target_is_met(spark):
    """Sources of a few texts up to 10,000 times as long as the others, targets up to 0.9999 of the cap."""
    rows, sources, want = [], [], {}
    for sid, (sizes, share) in enumerate(histograms()):
        total, n = sum(x * k for x, k in sizes.items()), sum(sizes.values())
        rows += [(sid, x, k) for x, k in sizes.items()]
        sources.append((sid, total, n, share * total))
        want[sid] = by_bisection(share * total, total / n, sizes.items())
    solved = mixing.solve(spark.createDataFrame(rows, "sid int, size long, n long"), spark.createDataFrame(sources, "sid int, source_size long, n long, target double"))
    got = {r["sid"]: r for r in solved.collect()}
    assert got.keys() == want.keys()
    for sid, (sizes, share) in enumerate(histograms()):
        target = share * sum(x * k for x, k in sizes.items())
        assert abs(taken(got[sid]["lam"], got[sid]["mean"], sizes.items()) - target) <= 1e-6 * target + 1e-3
        if share < 2.99:
            assert math.isclose(got[sid]["lam"], want[sid], rel_tol=1e-4, abs_tol=1e-6)


def test_a_mix_near_the_cap(spark):
    """Few long and many short texts, targets at 0.9995 of the cap: copies come near the target and never pass the cap."""
    text = F.array_join(F.array_repeat(F.lit("w"), F.col("k").cast("int")), " ")
    sizes = [(3, 100_000, "a"), (57, 10, "a"), (1, 240_990, "b")]
    rows = [(k, s) for n, k, s in sizes for _ in range(n)]
    docs = spark.createDataFrame(rows, "k long, source string").withColumns({"doc_id": F.monotonically_increasing_id(), "text": text})
    got = mixing.mix(docs, ["doc_id", "source"]).collect()
    by = {s: [r for r in got if r["source"] == s] for s in ("a", "b")}
    for own in by.values():
        assert all(0 <= r["copies"] <= 3 for r in own)
        assert abs(sum(r["copies"] * r["size"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
