import itertools
import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from weftlink.operators import context, decide, maps, model, world
from weftlink.sources import tables


def brute(ps, lam):
    """Expected F0.5 of each prefix, by enumeration."""
    w = [math.exp(-lam), math.exp(-lam) * lam]
    w.append(1 - sum(w))
    out = []
    for k in range(len(ps) + 1):
        e = 0.0
        for truth in itertools.product((0, 1), repeat=len(ps)):
            pr = math.prod(p if t else 1 - p for p, t in zip(ps, truth))
            for j, wj in enumerate(w):
                g, tp = sum(truth) + j, sum(truth[:k])
                e += pr * wj * ((1.0 if g == 0 and k == 0 else 0.0) if tp == 0 else 1.25 * tp / (k + 0.25 * g))
        out.append(e)
    return out


@pytest.fixture(scope="module")
def expected(spark):
    def f(rows):
        df = spark.createDataFrame(rows, "i int, ps array<double>, lam double")
        return {r["i"]: r["e"] for r in df.select("i", decide.expected_f(F.col("ps"), F.col("lam")).alias("e")).collect()}

    return f


def test_expected_f_known(expected):
    e = expected([(0, [0.02, 0.01], 0.0), (1, [0.99, 0.98, 0.1], 0.0)])
    assert max(range(3), key=e[0].__getitem__) == 0 and abs(e[0][0] - 0.9702) < 1e-9
    assert max(range(4), key=e[1].__getitem__) == 2 and abs(e[1][2] - 0.97766) < 1e-4


def test_expected_f_brute(expected):
    import random

    rng = random.Random(5)
    rows = [(i, sorted((rng.random() for _ in range(rng.randint(1, 4))), reverse=True), lam) for i, lam in enumerate([0.0, 0.05, 0.4, 1.3] * 8)]
    got = expected(rows)
    for i, ps, lam in rows:
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[i], brute(ps, lam), strict=True))
    few, more = expected([(0, [0.62, 0.41, 0.18], 0.0), (1, [0.62, 0.41, 0.18], 0.5)]).values()
    assert max(range(4), key=more.__getitem__) >= max(range(4), key=few.__getitem__)


def test_by_expected_f(spark):
    x = spark.createDataFrame([(1, 10, 0.99), (1, 11, 0.98), (1, 12, 0.1), (2, 20, 0.02), (2, 21, 0.01)], "s1 int, qid int, p double")
    assert sorted((r["s1"], r["qid"]) for r in decide.by_expected_f(x).collect()) == [(1, 10), (1, 11)]
    assert decide.by_expected_f(x.limit(0)).count() == 0


def test_macro_f05(spark):
    truth = spark.createDataFrame([(1, 47), (1, 812)], "s1 int, qid int")
    pred = spark.createDataFrame([(1, 47), (1, 193), (1, 812), (1, 812)], "s1 int, qid int")
    one = spark.createDataFrame([(1,)], "s1 int")
    assert decide.macro_f05(pred, truth, one).first()["f05"] == round(0.7142857, 6)
    pred = spark.createDataFrame([(3, 9)], "s1 int, qid int")
    three = spark.createDataFrame([(1,), (2,), (3,)], "s1 int")
    assert decide.macro_f05(pred, truth, three).first()["f05"] == round(1 / 3, 6)


def test_odds(spark):
    assert decide.parse_odds("0.5") == 0.5 and decide.parse_odds("") == decide.parse_odds(None) == 1.0
    assert decide.parse_odds("US:0.5,France:0.3,*:0.5") == {"US": 0.5, "France": 0.3, "*": 0.5}
    r = spark.range(1).select(decide.shrink_odds(F.lit(0.5), 0.35).alias("a"), decide.shrink_odds(F.lit(0.5), {"X": 0.35}, F.lit("Y")).alias("b")).first()
    assert round(r["a"], 4) == 0.2593 and r["b"] == 0.5
    assert abs(model.miss_odds(0.98) - 0.02 / 0.98) < 1e-12 and abs(model.decoy_prior(0.4, 0.4) - 1) < 1e-12


def test_argmax_ties(spark):
    x = spark.createDataFrame([(1, 7, 0.5), (1, 3, 0.5), (2, 9, 0.1)], "qid int, s1 int, p double")
    assert sorted(tuple(r) for r in decide.argmax(x).select("qid", "s1").collect()) == [(1, 3), (2, 9)]


def test_siblings_agree_when_empty(spark):
    pairs = spark.createDataFrame([(10, 1, 0.9), (11, 1, 0.8)], "qid int, s1 int, p double")
    rec = lambda rows: spark.createDataFrame(rows, "id int, ad_hn string, nm_cmp string, ad string")
    out = {r["qid"]: r for r in context.siblings(pairs, rec([(10, "", "a", ""), (11, "", "a", "x")]), rec([(1, "", "a", "")])).collect()}
    assert out[10]["sib_hn_same"] == -1 and out[10]["sib_hn_eq_s"] == 1 and out[10]["sib_nm_same"] == 1 and out[11]["sib_ad_same"] == 0


def test_calibrate_unseen_label(spark):
    x = spark.createDataFrame([(0.5, "a"), (0.5, "b"), (0.0, "b"), (1.0, "b")], "p double, country string")
    maps_ = {None: [(0.0, 0.1), (1.0, 0.9)], "a": [(0.2, 0.0), (0.8, 1.0)]}
    assert [round(r["p"], 6) for r in model.calibrate(x, maps_, {"a": 0.5}).collect()] == [round(0.25 / 0.75, 6), 0.5, 0.1, 0.9]


def test_learned_maps(spark):
    pairs = spark.createDataFrame([("ram traders", "राम traders"), ("ram shop", "राम shop"), ("x y", "राम")], "n1 string, n2 string")
    assert [tuple(r) for r in maps.indic_words(pairs).collect()] == [("राम", "ram")]
    sub = spark.createDataFrame([("US", ["a", "ave"], ["a", "aveue"])] * 3 + [("US", ["q"], ["st"])] * 3, "country string, a1 array<string>, a2 array<string>")
    held = spark.createDataFrame([("US", "ave")], "country string, item string")
    assert [tuple(r) for r in maps.substitutions(sub, held, least=3).collect()] == [("US", "aveue", "ave")]


def test_world_shares(spark):
    refs = spark.range(1000).select("id", F.lit("a").alias("country"))
    w = world.World(kept={"a": 0.3}, decoys={"a": 0.5})
    kept = world.kept(refs, w)
    assert 240 < kept.count() < 360 and kept.count() + world.dropped(refs, w).count() == 1000
    queries = spark.range(10_000, 12_000).select("id", F.lit("a").alias("country"))
    truth = spark.range(10_000, 12_000).select(F.col("id").alias("qid"), ((F.col("id") - 10_000) % 1000).alias("s1"))
    n_true = truth.join(kept.select(F.col("id").alias("s1")), "s1", "left_semi").count()
    assert abs(world.select_queries(queries, truth, kept, w).count() - 2 * n_true) < 0.15 * n_true


def test_tsv(spark, tmp_path):
    path = str(tmp_path / "r")
    x = spark.createDataFrame([("S2-1", 'a "quoted" name', "", "US"), ("S2-2", "b", "x", "FR")], tables.RECORD)
    x_schema = x.toDF(*tables.RECORD)
    tables.write_tsv(x_schema, path)
    back = tables.read_tsv(spark, path)
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in x_schema.collect())
    assert tables.checked(back, 2).count() == 2
    with pytest.raises(ValueError):
        tables.checked(back.union(back), 2)
    tables.save_config(spark, {"tau": 0.7}, str(tmp_path / "c"))
    assert tables.load_config(spark, str(tmp_path / "c")) == {"tau": 0.7}


@settings(max_examples=20, deadline=None)
@given(st.lists(st.floats(0.01, 0.99), min_size=1, max_size=4))
def test_brute_sums(ps):
    assert all(-1e-9 <= e <= 1 + 1e-9 for e in brute(sorted(ps, reverse=True), 0.3))
