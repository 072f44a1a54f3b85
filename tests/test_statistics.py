import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from peptaflow.operators import statistics as st
from peptaflow.operators import windows as w
from peptaflow.operators.joins import contained, point_in_interval


@pytest.fixture(scope="module")
def sample(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([1.0, 2.0, 2.5, rng.random() * 5]) + (i % 3 == 0), int(i % 3 == 0)) for i in range(200)]
    return rows, spark.createDataFrame(rows, "id long, x double, y int").repartition(5)


def test_u_is_the_pair_count(sample):
    rows, df = sample
    r = st.mwu_summary(df, "x", F.col("y") == 1).first()
    pos, neg = [x for _, x, y in rows if y], [x for _, x, y in rows if not y]
    assert r["u1"] == sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    a = st.auroc(df, F.col("x"), F.col("y")).first()["auroc"]
    assert abs(a - r["u1"] / len(pos) / len(neg)) < 1e-12


def test_exact_p_value_by_enumeration(spark):
    values = [0.3, 1.1, 1.9, 2.2, 3.7, 4.0, 5.5]
    df = spark.createDataFrame([(v, int(i in (4, 5, 6))) for i, v in enumerate(values)], "x double, y int")
    t = st.mwu_test(df, "x", F.col("y") == 1)
    us = [sum(a > b for a in c for b in values if b not in c) for c in itertools.combinations(values, 3)]
    assert t["u1"] == 12 and abs(t["p"] - 2 * sum(u >= 12 for u in us) / len(us)) < 1e-12


def test_average_precision(sample):
    rows, df = sample
    got = st.average_precision(df, F.col("x"), F.col("y")).first()[0]
    total, tp, seen, ap = sum(y for *_, y in rows), 0, 0, 0.0
    for _, g in itertools.groupby(sorted(rows, key=lambda r: -r[1]), key=lambda r: r[1]):
        g = list(g)
        k = sum(y for *_, y in g)
        tp, seen = tp + k, seen + len(g)
        ap += k / total * tp / seen
    assert abs(got - ap) < 1e-12


def test_adjusted_p_values(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.8]
    df = spark.createDataFrame(list(enumerate(p)), "id long, p double")
    q = {r["id"]: r["q"] for r in st.bh_adjust(df, "p", ["id"]).collect()}
    assert [round(q[i], 6) for i in range(5)] == [0.025, 0.05, 0.05, 0.025, 0.8]


def test_tails():
    assert abs(st.normal_sf(1.959963985) - 0.025) < 1e-9
    assert abs(st.student_sf(2.228138852, 10) - 0.025) < 1e-8
    assert abs(st.student_sf(0.5, 3) - 0.325724) < 1e-5
    assert abs(st.student_sf(-0.5, 3) - 0.674276) < 1e-5
    assert st.fisher_z_p(0.5, 3) == 1.0 and st.fisher_z_p(1.0, 10) == 0.0


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_running_values_do_not_depend_on_partitions(spark, sample, partitions):
    rows, df = sample
    got = {r["id"]: (r["s"], r["n"], r["m"]) for r in w.running(df, ["x", "id"], {"s": ("sum", F.col("id")), "n": ("count", F.lit(1)), "m": ("max", F.col("id"))}, partitions).collect()}
    s = m = 0
    for n, (i, *_) in enumerate(sorted(rows, key=lambda r: (r[1], r[0])), 1):
        s, m = s + i, max(m, i)
        assert got[i] == (s, n, m)


def test_rank_puts_missing_last(spark):
    df = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, None), (4, 0.9), (5, 0.5)], "id long, p double")
    assert {r["id"]: r["Rank"] for r in w.rank_first(df, F.col("p"), ["id"]).collect()} == {4: 1, 1: 2, 5: 3, 2: 4, 3: 5}


def test_interval_joins_equal_brute_force(spark):
    rng = random.Random(0)
    points = [(i, rng.uniform(0, 1000)) for i in range(200)] + [(900, None)]
    spans = [(i, a := rng.uniform(0, 1000), a + rng.uniform(0, 120)) for i in range(100)] + [(900, None, 3.0), (901, 5.0, 1.0)]
    p = spark.createDataFrame(points, "p long, at double")
    s = spark.createDataFrame(spans, "s long, lo double, hi double")
    got = {(r["p"], r["s"]) for r in point_in_interval(p, s, "at", "lo", "hi", 37.0).collect()}
    assert got == {(i, j) for i, x in points for j, a, b in spans if None not in (x, a, b) and a <= x <= b}
    wide = p.withColumn("end", F.col("at") + 15)
    got = {(r["p"], r["s"]) for r in contained(wide, s, "at", "end", "lo", "hi", 37.0).collect()}
    assert got == {(i, j) for i, x in points for j, a, b in spans if None not in (x, a, b) and a < x and x + 15 < b}


def test_folds_keep_groups_together(spark):
    df = spark.createDataFrame([(g,) for g in range(20) for _ in range(g + 1)], "g long")
    rows = st.group_folds(df, "g", 4).collect()
    assert len(rows) == 20 and {r["fold"] for r in rows} == {0, 1, 2, 3}
    load = [sum(r["n"] for r in rows if r["fold"] == f) for f in range(4)]
    assert max(load) - min(load) <= 20


def test_greedy_folds_need_no_list_of_groups():
    rng = random.Random(6)
    for _ in range(300):
        folds, load, want = rng.randint(1, 6), [0] * 6, []
        sizes = sorted((rng.choice([1, 2, 3, 7, 50, 400]) for _ in range(rng.randint(0, 120))), reverse=True)
        for n in sizes:
            at = min(range(folds), key=lambda i: (load[i], i))
            load[at] += n
            want.append(at)
        runs = st._greedy({n: sizes.count(n) for n in sizes}, folds) + [(len(sizes), [])]
        assert [cycle[(r - start) % len(cycle)] for (start, cycle), (end, _) in zip(runs, runs[1:], strict=False) for r in range(start, end)] == want
    assert len(st._greedy({3: 10**12, 1: 10**12}, 5)) <= 10


def test_folds_are_greedy_for_every_group(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(None if g == 3 else g,) for g in range(60) for _ in range(rng.choice([1, 1, 2, 5, 30]))], "g long")
    rows = sorted(st.group_folds(df, "g", 3).collect(), key=lambda r: (-r["n"], r["g"] is not None, r["g"]))
    load = [0] * 3
    assert len(rows) == 60
    for r in rows:
        at = min(range(3), key=lambda i: (load[i], i))
        load[at] += r["n"]
        assert r["fold"] == at


def test_encoding(spark):
    df = spark.createDataFrame([("a", 1), ("a", 0), ("a", 0), ("b", 1), ("b", 1), ("c", None)], "c string, y int")
    enc = {r["c"]: r["encoded"] for r in st.woe(df, "c", F.col("y")).collect()}
    npc = 2 / 3
    assert abs(enc["a"] - 2 / (3 + 1 + npc)) < 1e-12 and abs(enc["b"] - 3 / (2 + 1 + npc)) < 1e-12 and "c" not in enc


def test_effect_table_falls():
    t = st.effect_table(0.3, 0.05)
    assert len(t) == 21 and t == sorted(t) and math.isclose(t[0], st.normal_sf(6.0))
