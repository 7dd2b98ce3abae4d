"""Sequential rules against plain loops: merged members, matches to a key, ranks by counting."""

import random
import time

import pytest
from pyspark.sql import functions as F

from spandrel.operators import checks, greedy, takeoff

MEMBERS = "page long, section string, seq long, x0 double, y0 double, x1 double, y1 double, evidence array<string>"


def members(n, spread, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(2), rng.choice("AB"), i, *[round(rng.uniform(-spread, spread), 1) for _ in range(4)], [f"e{i}"] if i % 7 else None) for i in range(n)]
    return rows + [(0, "A", n, None, 1.0, 2.0, 3.0, ["x"])]


def merged(rows, reach=2.0):
    kept = {}
    for r in sorted(rows, key=lambda r: r[2]):
        group = kept.setdefault(r[:2], [])
        at = r[3:7]
        hit = next((k for k in group if None not in at and None not in k[0] and all(abs(a - b) <= reach for a, b in zip(at, k[0], strict=True))), None)
        if hit:
            hit[2] += 1
            hit[3] += r[7] or []
        else:
            group.append([at, r[2], 0, list(r[7] or [])])
    return sorted((*g, k[1], k[2], k[3]) for g, ks in kept.items() for k in ks)


@pytest.mark.parametrize("spread", [2, 6, 300])
def test_members_merge_as_the_sequential_rule_says(spark, spread):
    rows = members(300, spread, spread)
    df = spark.createDataFrame(rows, MEMBERS).orderBy(F.rand(2))
    got = sorted((r.page, r.section, r.seq, r.n_merged, list(r.evidence)) for r in takeoff.merge_same_members(df).collect())
    assert got == merged(rows)
    plain = takeoff.merge_same_members(df.drop("evidence"))
    assert sorted((r.page, r.section, r.seq, r.n_merged) for r in plain.collect()) == [m[:4] for m in merged(rows)]
    assert takeoff.merge_same_members(df.limit(0)).count() == 0


def matched(predicted, truth):
    out = []
    for key in {r[:2] for r in predicted + truth}:
        free = sorted((s, x) for *k, s, x in truth if tuple(k) == key)
        some = bool(free)
        for *_, seq, length in sorted(r for r in predicted if r[:2] == key):
            if not free:
                out.append((*key, seq, None, "duplicate" if some else "false_positive", None))
                continue
            error = [abs(length - x) / x if x else float("inf") for _, x in free]
            k = error.index(min(error))
            out.append((*key, seq, free.pop(k)[0], "match", error[k]))
        out += [(*key, None, s, "missed", None) for s, _ in free]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_matches_follow_the_sequential_rule(spark, seed):
    rng = random.Random(seed)
    side = lambda n: [(rng.choice("ab"), rng.choice("xyz"), i, float(rng.choice([0, 12, 24, rng.randrange(1, 400)]))) for i in range(n)]
    predicted, truth = side(200), side(150 if seed % 2 else 260)
    kind = "level string, section string, seq long, length_in double"
    got = checks.match_to_key(spark.createDataFrame(predicted + [("c", "x", 1, 5.0)], kind), spark.createDataFrame(truth + [("d", "x", 1, 5.0)], kind)).collect()
    assert sorted(map(tuple, got), key=str) == matched(predicted + [("c", "x", 1, 5.0)], truth + [("d", "x", 1, 5.0)])


def test_one_large_group_takes_a_linear_time():
    rng = random.Random(1)
    start, rule = time.perf_counter(), greedy.NearestFree()
    for i in range(200_000):
        rule.add(("a", "x", 0, i, float(rng.randrange(1, 50_000))))
    kinds = [rule.add(("a", "x", 1, i, float(rng.randrange(1, 50_000))))[0][4] for i in range(220_000)]
    first = greedy.FirstWithin(2.0, 4)
    for i in range(50_000):
        first.add((0, "A", "0", i, *[rng.uniform(0, 8) for _ in range(4)]))
    assert kinds.count("match") == 200_000 and time.perf_counter() - start < 60


@pytest.mark.parametrize("few", [2, 4096])
def test_ranks_by_counting(spark, few):
    rng = random.Random(few)
    values = [round(rng.choice([rng.random(), rng.random() ** 9, 0.5]), 3) for _ in range(500)] + [float("inf")] * 3
    df = spark.createDataFrame([(v,) for v in values], "v double")
    ranks = [0, 1, 250, 499, 500, 502]
    assert checks.nth(df, ranks, few=few) == [sorted(values)[r] for r in ranks]


@pytest.mark.parametrize("spread", [4, 40])
def test_few_kept_members_are_looked_at_themselves_and_many_by_cell(spread):
    rng = random.Random(spread)
    rows = [(0, "A", "1", i, *[round(rng.uniform(-spread, spread), 1) for _ in range(4)]) for i in range(600)]
    rule, plain = greedy.FirstWithin(2.0, 4), []
    for r in rows:
        first = next((s for s, at in plain if all(abs(a - b) <= 2.0 for a, b in zip(r[4:], at, strict=True))), None)
        if first is None:
            plain.append((r[3], r[4:]))
        assert rule.add(r) == [(0, "A", r[3], r[3] if first is None else first)]
        assert len(rule.order) > 82 or not rule.kept
    assert (len(plain) > 82) == (spread == 40)
