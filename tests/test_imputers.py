"""What every imputer must hold to, and brute-force checks of the exact ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gapfill.operators.ampute import PatternConfig, ampute, introduce_missing
from gapfill.operators.encode import categories
from gapfill.operators.impute import chained
from gapfill.operators.impute.chained import MICEImputer, MissForestImputer, XGBoostImputer, evidence_ridge, mix
from gapfill.operators.impute.knn import KNNImputer
from gapfill.operators.impute.neural import AdversarialNet, DAEImputer, DenoisingNet, GAINImputer, Layout, VAEImputer, VariationalNet
from gapfill.operators.impute.statistical import StatisticalImputer, column_medians, column_modes
from gapfill.streaming.progress import streamed_fit


@pytest.fixture(scope="module")
def data(spark):
    """Two correlated numbers and two categories, each with gaps of its own."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        z = rng.normal()
        rows.append((i, float(z + rng.normal(0, 0.2)), float(3 * z + rng.normal(0, 0.2)), "pos" if z > 0 else "neg", "xyz"[i % 3]))
    true = spark.createDataFrame(rows, "id int, a double, b double, s string, t string")
    pats = [PatternConfig(["a"]), PatternConfig(["b"]), PatternConfig(["s"]), PatternConfig(["t"])]
    return ampute(true, "id", 0.4, pats, seed=1).persist()


COLUMNS = ["a", "b", "s", "t"]
IMPUTERS = {
    "mean": StatisticalImputer(), "median": StatisticalImputer("median"), "approx": StatisticalImputer("median", approx=True),
    "knn": KNNImputer(), "knn_distance": KNNImputer(weights="distance"), "knn_ordinal": KNNImputer(categorical_encoder="ordinal"),
    "knn_boxes": KNNImputer(max_broadcast_bytes=0, box_rows=40),
    "mice": MICEImputer(max_iter=2), "mice_det": MICEImputer(max_iter=3, sample_posterior=False),
    "mice_ordinal": MICEImputer(max_iter=2, categorical_encoder="ordinal"), "mice_all": MICEImputer(max_iter=1, skip_complete=False),
    "forest": MissForestImputer(n_estimators=3, max_iter=1, max_depth=4), "boost": XGBoostImputer(n_estimators=2, max_iter=1),
    "forest_dummies": MissForestImputer(n_estimators=2, max_iter=1, max_depth=3, dummy_regression=True),
    "dae": DAEImputer(rounds=2, local_epochs=2, hidden_dim=16, latent_dim=8), "vae": VAEImputer(rounds=2, local_epochs=2, hidden_dim=16, latent_dim=4),
    "dae_mask": DAEImputer(rounds=2, local_epochs=1, hidden_dim=8, latent_dim=4, corruption="mask", validation_split=0.2, early_stopping_patience=1),
    "gain": GAINImputer(rounds=2, local_epochs=2, hidden_dim=16),
}


@pytest.mark.parametrize("name", IMPUTERS)
def test_invariants(data, name):
    table = data.select("id", *COLUMNS)
    model = IMPUTERS[name].fit(table, "id")
    out = model.transform(table)
    assert out.columns == table.columns
    j = out.select("id", *[F.col(c).alias(f"f_{c}") for c in COLUMNS]).join(table, "id")
    row = j.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(f"f_{c}").isNull()).alias(f"null_{c}") for c in COLUMNS],
                *[F.count_if(F.col(c).isNotNull() & (F.col(c) != F.col(f"f_{c}"))).alias(f"chg_{c}") for c in COLUMNS]).first()
    assert row["n"] == 240
    assert all(row[f"null_{c}"] == 0 and row[f"chg_{c}"] == 0 for c in COLUMNS)
    known = {r["s"] for r in out.select("s").distinct().collect()}
    assert known == {"pos", "neg"}


def test_contract(spark, data):
    table = data.select("id", *COLUMNS)
    model = StatisticalImputer().fit(table, "id")
    with pytest.raises(ValueError):
        model.transform(table.select("id", "b", "a", "s", "t"))
    with pytest.raises(ValueError):
        MICEImputer().fit(table.na.drop(), "id")
    with pytest.warns(UserWarning):
        StatisticalImputer().fit(table.na.drop(), "id")
    imp = KNNImputer(n_neighbors=3)
    assert imp.get_params()["n_neighbors"] == 3 and imp.set_params(weights="distance").weights == "distance"
    with pytest.raises(ValueError):
        imp.set_params(nonsense=1)
    with pytest.raises(ValueError):
        KNNImputer(weights="nonsense")


def test_single_missing_category_keeps_its_row(spark):
    """Two categories, one missing: only that one is guessed."""
    rows = [(i, "u" if i % 2 else "v", "p" if i % 2 else "q") for i in range(20)] + [(20, None, "p"), (21, "v", None)]
    df = spark.createDataFrame(rows, "id int, s string, t string")
    for imp in (KNNImputer(n_neighbors=3), MICEImputer(max_iter=1, sample_posterior=False)):
        got = {r["id"]: (r["s"], r["t"]) for r in imp.fit_transform(df, "id").where("id >= 20").collect()}
        assert got == {20: ("u", "p"), 21: ("v", "q")}


def test_empty_column_stays_empty(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, None, None), (3, 3.0, None)], "id int, a double, e double")
    for imp in (StatisticalImputer(), KNNImputer(), MICEImputer(max_iter=1)):
        model = imp.fit(df, "id")
        assert model.empty_columns == ["e"]
        got = model.transform(df)
        assert got.where("a is null").count() == 0 and got.where("e is not null").count() == 0


def test_integers(spark):
    df = spark.createDataFrame([(1, 1), (2, None), (3, 4)], "id int, n int")
    assert StatisticalImputer().fit_transform(df, "id").orderBy("id").collect()[1]["n"] == 2.5
    out = StatisticalImputer(round_integers=True).fit_transform(df, "id")
    assert out.schema["n"].dataType.simpleString() == "int"


def test_median_and_mode(spark):
    rng = np.random.default_rng(5)
    v = np.concatenate([np.zeros(400), rng.normal(size=801)])
    df = spark.createDataFrame([(float(x), "b" if x > 0 else "a") for x in v] + [(None, None)], "x double, s string")
    assert column_medians(df, ["x"])["x"] == np.median(v)
    even = df.limit(400).unionByName(spark.createDataFrame([(5.0, "c")] * 400, "x double, s string"))
    assert column_medians(even, ["x"])["x"] == 2.5
    tie = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), (None,)], "s string")
    assert column_modes(tie, ["s"]) == {"s": "a"}


def brute_knn(rows, target, k, weights):
    """rows: list of lists with None; unscaled, gap-aware distances, ties by position."""
    x = np.array(rows, dtype=float)
    out = x[:, target].copy()
    for i in np.flatnonzero(np.isnan(x[:, target])):
        cand = []
        for j in np.flatnonzero(~np.isnan(x[:, target])):
            both = ~np.isnan(x[i]) & ~np.isnan(x[j])
            if both.any():
                cand.append((float(np.sum((x[i, both] - x[j, both]) ** 2)) * x.shape[1] / both.sum(), j))
        cand = sorted(cand)[:k]
        if not cand:
            out[i] = np.nanmean(x[:, target])
            continue
        d, v = np.sqrt([c[0] for c in cand]), x[[c[1] for c in cand], target]
        if weights == "uniform":
            out[i] = v.mean()
        elif (d == 0).any():
            out[i] = v[d == 0].mean()
        else:
            out[i] = np.average(v, weights=1 / d)
    return out


@pytest.mark.parametrize("weights", ["uniform", "distance"])
@pytest.mark.parametrize("boxes", [False, True])
def test_knn_brute_force(spark, weights, boxes):
    rng = np.random.default_rng(7)
    x = np.round(rng.normal(size=(260, 3)), 1)
    x[:90, :] = [0.5, 0.0, 1.0]  # a third of the rows are copies
    x[90:120, 2] = 1e3
    x[rng.random(x.shape) < 0.2] = np.nan
    rows = [[None if np.isnan(v) else float(v) for v in r] for r in x]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, a double, b double, c double")
    extra = dict(max_broadcast_bytes=0, box_rows=25) if boxes else {}
    got = KNNImputer(n_neighbors=4, weights=weights, **extra).fit_transform(df, "id").orderBy("id").toPandas()
    for j, c in enumerate("abc"):
        np.testing.assert_allclose(got[c].to_numpy(float), brute_knn(rows, j, 4, weights), atol=1e-9)


def test_knn_unseen_rows_and_high_cardinality_ordinal(spark):
    base = spark.range(400).select("id", F.format_string("v%04d", "id").alias("s"), F.col("id").cast("double").alias("x"))
    fit = base.withColumn("s", F.when(F.col("id") % 10 > 0, F.col("s")))
    model = KNNImputer(n_neighbors=2, categorical_encoder="ordinal").fit(fit, "id")
    out = model.transform(fit)
    assert out.where("s is null").count() == 0
    got = {r["id"]: r["s"] for r in out.where("id in (100, 101)").collect()}
    assert got[101] == "v0101" and got[100] in ("v0099", "v0100", "v0101")


def test_evidence_ridge_recovers_the_line():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 2))
    y = x @ [2.0, -1.0] + rng.normal(0, 0.1, 500)
    xc, yc = x - x.mean(0), y - y.mean()
    coef, noise, _ = evidence_ridge(500, xc.T @ xc, xc.T @ yc, yc @ yc)
    assert np.allclose(coef, [2, -1], atol=0.02) and abs(noise - 0.01) < 0.003


def test_posterior_noise_is_uniform_and_repeatable():
    h = np.arange(100000, dtype=np.uint64)
    u = mix(h, 3)
    assert abs(u.mean() - 0.5) < 0.01 and abs(u.var() - 1 / 12) < 0.002 and np.array_equal(u, mix(h, 3)) and not np.array_equal(u, mix(h, 4))


def test_chain_beats_the_mean_and_converges(data):
    table = data.select("id", "a", "b")
    model = MICEImputer(sample_posterior=False).fit(table, "id")
    out = model.transform(table).select("id", F.col("b").alias("f"))
    gap = F.col("b__missing")
    err = data.join(out, "id").agg(F.avg(F.when(gap, (F.col("f") - F.col("b__true")) ** 2)), F.avg(F.when(gap, F.col("b__true") ** 2))).first()
    assert err[0] < 0.3 * err[1]
    changes = [c for _, c in model.history]
    assert changes == sorted(changes, reverse=True) and model.n_rounds < 10


def test_gradients():
    class Prep:
        numeric, categorical, vocab = ["a", "b", "c"], ["k"], {"k": ["x", "y", "z"]}
    layout, rng = Layout(Prep), np.random.default_rng(0)
    num, cat, seen = rng.standard_normal((16, 3)), rng.integers(1, 4, (16, 1)), (rng.random((16, 4)) < 0.7).astype(float)
    p = dict(hidden_dim=7, latent_dim=4, noise_level=0.2, dropout=0.0, corruption="swap", noise_categorical=True, kl_weight=0.7, alpha=3.0, hint_rate=0.9)
    for cls in (DenoisingNet, VariationalNet, AdversarialNet):
        net = cls(layout, p)
        w = net.start(np.random.default_rng(1))
        run = lambda v: list(net.gradients(v, num, cat, seen, np.random.default_rng(5)))  # noqa: B023, E731
        for part, (where, g, _) in enumerate(run(w)):
            for i in rng.choice(where.stop - where.start, 25, replace=False):
                up, down = w.copy(), w.copy()
                up[where.start + i] += 1e-6
                down[where.start + i] -= 1e-6
                assert abs((run(up)[part][2] - run(down)[part][2]) / 2e-6 - g[i]) < 1e-5


def test_streamed_fit(data):
    table = data.select("id", *COLUMNS)
    *steps, model = streamed_fit(VAEImputer(rounds=3, local_epochs=1, hidden_dim=8, latent_dim=2), table, "id")
    assert [s.step for s in steps] == [1, 2, 3] and model.transform(table).where("a is null").count() == 0


def test_fitted_model_runs_on_a_stream(spark, data, tmp_path):
    table = data.select("id", *COLUMNS)
    model = StatisticalImputer().fit(table, "id")
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(table.schema).parquet(str(tmp_path / "in"))
    q = model.transform(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).start(str(tmp_path / "out"))
    q.processAllAvailable()
    q.stop()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == 240 and out.where("a is null or s is null").count() == 0


def test_injection(spark):
    df = spark.range(4000).select("id", (F.col("id") % 100).cast("double").alias("x"), F.concat(F.lit("k"), F.col("id") % 3).alias("s"), F.rand(1).alias("y"))
    df = df.persist()
    miss, mask = introduce_missing(df, "id", 0.3, [PatternConfig(["y"], "MAR", weights={"x": 1.0})], seed=0)
    j = mask.join(df, "id").groupBy("y__missing").agg(F.avg("x").alias("m"), F.count(F.lit(1)).alias("n")).collect()
    got = {r["y__missing"]: r for r in j}
    assert abs(got[True]["n"] / 4000 - 0.3) < 0.02 and got[True]["m"] - got[False]["m"] > 10
    assert miss.where("y is null").count() == got[True]["n"] and miss.where("x is null or s is null").count() == 0
    _, mcar = introduce_missing(df, "id", 0.3, [PatternConfig(["y"])], seed=0)
    j = {r["y__missing"]: r["m"] for r in mcar.join(df, "id").groupBy("y__missing").agg(F.avg("x").alias("m")).collect()}
    assert abs(j[True] - j[False]) < 3
    _, again = introduce_missing(df.repartition(11), "id", 0.3, [PatternConfig(["y"])], seed=0)
    assert mcar.exceptAll(again).count() == 0
    rate = introduce_missing(df, "id", 0.5)[0]
    assert abs(rate.where("x is null or s is null or y is null").count() / 4000 - 0.5) < 0.03
    assert rate.where("x is null and s is null and y is null").count() == 0
    with pytest.raises(ValueError, match="y"):
        introduce_missing(miss, "id")


@pytest.mark.parametrize("shape", ["sigmoid-right", "sigmoid-left", "sigmoid-mid", "sigmoid-tail"])
def test_shapes_meet_the_rate(spark, shape):
    df = spark.range(5000).select("id", F.randn(2).alias("x")).persist()
    for mechanism, weights in (("MNAR", None), ("MAR+MNAR", {"x": -2.0})):
        p = PatternConfig(["x"], mechanism, weights=weights, score_to_probability_func=shape)
        got = ampute(df, "id", 0.25, [p]).agg(F.avg(F.col("x__missing").cast("int"))).first()[0]
        assert abs(got - 0.25) < 0.02


def test_bad_patterns():
    for kw in (dict(incomplete_vars=[]), dict(incomplete_vars=["a"], mechanism="X"), dict(incomplete_vars=["a"], mechanism="MAR+MNAR"),
               dict(incomplete_vars=["a"], score_to_probability_func="?"), dict(incomplete_vars=["a"], freq=0)):
        with pytest.raises(ValueError):
            PatternConfig(**kw)
    assert PatternConfig(["a"], "MNAR", 0.3).to_dict() == {"incomplete_vars": ["a"], "mechanism": "MNAR", "freq": 0.3, "score_to_probability_func": "sigmoid-right"}


def test_many_categories(spark):
    """More categories than fit a literal list: codes and votes go through joined tables."""
    base = spark.range(900).select("id", F.format_string("v%03d", F.col("id") % 300).alias("s"), (F.col("id") % 300).cast("double").alias("x"))
    fit = base.withColumn("s", F.when(F.col("id") % 10 > 0, F.col("s"))).persist()
    for imp in (KNNImputer(n_neighbors=2), MICEImputer(max_iter=1, sample_posterior=False, categorical_encoder="ordinal")):
        out = imp.fit_transform(fit, "id").withColumnRenamed("s", "f").join(base.select("id", "s"), "id")
        row = out.agg(F.count(F.lit(1)), F.count_if(F.col("f").isNull()), F.count_if((F.col("id") % 10 > 0) & (F.col("f") != F.col("s")))).first()
        assert tuple(row) == (900, 0, 0)
    # the bound is a parameter now, no longer 255
    with pytest.raises(ValueError, match="categories"):
        categories(fit, "s", 255)


def test_one_column_table_falls_back_to_the_mean(spark):
    df = spark.createDataFrame([(1, 1.0), (2, None), (3, 4.0)], "id int, x double")
    for imp in (KNNImputer(), KNNImputer(max_broadcast_bytes=0)):
        assert imp.fit_transform(df, "id").orderBy("id").collect()[1]["x"] == 2.5


def test_checkpoint_folder_is_required_on_a_cluster(spark, monkeypatch):
    from types import SimpleNamespace
    from gapfill.frames import checkpoint_dir
    conf = SimpleNamespace(get=lambda name, default: None)
    cluster = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_dir(cluster)
    conf.get = lambda name, default: "hdfs:///shared"
    assert checkpoint_dir(cluster) == "hdfs:///shared"


@pytest.mark.parametrize("ridge", [True, False])
def test_pattern_algebra_equals_the_replay(spark, ridge):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(300, 4)) @ rng.normal(size=(4, 4)) + 5
    x[rng.random((300, 4)) < 0.25] = np.nan
    cats = [None if rng.random() < 0.2 else "uvw"[int(k)] for k in rng.integers(0, 3, 300)]
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], c) for i, (r, c) in enumerate(zip(x, cats))]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, d double, k string").repartition(5).persist()
    options = dict(max_iter=4, sample_posterior=False, ridge=ridge, tol=0.0)
    one = MICEImputer(**options).fit(df, "id")
    # limits that limit nothing take the other way
    two = MICEImputer(**options, min_value=-1e300, max_value=1e300).fit(df, "id")
    assert one.linear and not two.linear and len(one.steps) == len(two.steps) and one.n_rounds == two.n_rounds == 4
    for s, t in zip(one.steps, two.steps):
        assert (s.round, s.column) == (t.round, t.column) and np.allclose(s.coef, t.coef, atol=1e-6) and np.isclose(s.intercept, t.intercept)
    assert [r for r, _ in one.history] == [r for r, _ in two.history][:len(one.history)]
    assert np.allclose([c for _, c in one.history], [c for _, c in two.history][:len(one.history)], atol=1e-6)
    a, b = ({r["id"]: r for r in m.transform(df).collect()} for m in (one, two))
    assert all(a[i]["k"] == b[i]["k"] and np.allclose([a[i][c] for c in "abcd"], [b[i][c] for c in "abcd"], atol=1e-6) for i in a)
    # a pattern that was not there while fitting
    new = spark.createDataFrame([(1, None, None, None, 1.0, None), (2, 1.0, 2.0, 3.0, 4.0, "u")], df.schema)
    assert one.transform(new).where("a IS NULL OR k IS NULL").count() == 0


def test_too_many_patterns_fall_back(spark, monkeypatch):
    df = spark.createDataFrame([(i, None if i % 3 == 0 else float(i), None if i % 5 == 0 else 2.0 * i, 1.0 * i * i) for i in range(200)], "id int, a double, b double, c double")
    many = MICEImputer(max_iter=2, sample_posterior=False, tol=0.0).fit_transform(df, "id").orderBy("id").collect()
    monkeypatch.setattr(chained, "PATTERN_BYTES", 1)
    few = MICEImputer(max_iter=2, sample_posterior=False, tol=0.0).fit_transform(df, "id").orderBy("id").collect()
    assert all(np.allclose(list(x)[1:], list(y)[1:]) for x, y in zip(many, few))


@pytest.mark.parametrize("encoder", ["onehot", "ordinal"])
def test_knn_boxes_when_comparing_all_is_much_work(spark, monkeypatch, encoder):
    from gapfill.operators.impute import knn
    rows = [(i, None if i % 4 == 0 else float(i * 7 % 31), None if i % 5 == 0 else "abc"[i % 3], None if i % 7 == 0 else i / 3) for i in range(120)]
    rows += [(200 + i, None, None, None) for i in range(8)] + [(300 + i, None, "b", 2.0) for i in range(8)]
    df = spark.createDataFrame(rows, "id int, a double, b string, c double")
    fill = lambda: sorted(map(tuple, KNNImputer(3, categorical_encoder=encoder, box_rows=20).fit_transform(df, "id").collect()))
    want = fill()
    monkeypatch.setattr(knn, "MAX_PAIRS", 10)
    monkeypatch.setattr(knn.KNNModel, "_by_broadcast", None)
    got = fill()
    assert [(r[0], r[2]) for r in got] == [(r[0], r[2]) for r in want]
    for x, y in zip(got, want):
        assert x[1] == pytest.approx(y[1]) and x[3] == pytest.approx(y[3])


def test_knn_rows_with_nothing_observed_are_not_compared(spark, monkeypatch):
    from gapfill.operators.impute import knn
    df = spark.createDataFrame([(i, None if i % 2 else 1.0 * i, None if i % 2 else 2.0 * i) for i in range(40)], "id int, a double, b double")
    monkeypatch.setattr(knn, "MAX_PAIRS", 0)
    monkeypatch.setattr(knn.KNNModel, "_by_boxes", None)
    out = KNNImputer(3).fit_transform(df, "id").where("id % 2 = 1").collect()
    assert len(out) == 20 and all(r["a"] == 19.0 and r["b"] == 38.0 for r in out)


def test_network_shares_follow_the_rows(data, monkeypatch):
    """More rows, more shares; a gradient that nobody asks for is not computed, and training is in single precision."""
    from gapfill.operators.impute import neural
    seen = []
    run = neural.DAEImputer._round

    def watched(self, frame, net, layout, p, state, r):
        seen.append(frame.rdd.getNumPartitions())
        return run(self, frame, net, layout, p, state, r)
    monkeypatch.setattr(neural.DAEImputer, "_round", watched)
    monkeypatch.setattr(neural, "SHARE_ROWS", 10)
    table = data.select("id", *COLUMNS)
    DAEImputer(rounds=1, local_epochs=1, hidden_dim=8, latent_dim=2).fit(table, "id")
    assert seen == [max(neural.SHARES, -(-table.count() // 10))]
    net, x, rng = neural.Layers([3, 5, 2]), np.ones((4, 3), np.float32), np.random.default_rng(1)
    w = net.start(rng).astype(np.float32)
    out, tape = net.forward(w, x, 0.1, rng)
    flat, dx = net.backward(w, tape, np.ones_like(out))
    assert out.dtype == flat.dtype == dx.dtype == np.float32
    some, none = net.backward(w, tape, np.ones_like(out), inputs=False)
    assert none is None and np.array_equal(some, flat)
    none, same = net.backward(w, tape, np.ones_like(out), weights=False)
    assert none is None and np.array_equal(same, dx)


def test_adversarial_step_runs_each_network_no_more_than_needed(monkeypatch):
    """One pass of the generator and two of the discriminator make a step; Adam moves the weights as its formula says."""
    from types import SimpleNamespace

    from gapfill.operators.impute import neural
    layout = Layout(SimpleNamespace(numeric=["a", "b"], categorical=["s"], vocab={"s": ["x", "y"]}))
    p = GAINImputer(hidden_dim=4).get_params()
    net, rng = AdversarialNet(layout, p), np.random.default_rng(2)
    w, x = net.start(rng).astype(np.float32), rng.normal(size=(8, 2)).astype(np.float32)
    ran, forward = [], neural.Layers.forward
    monkeypatch.setattr(neural.Layers, "forward", lambda self, *a, **k: ran.append(self) or forward(self, *a, **k))
    for _ in net.gradients(w, x, rng.integers(1, 3, (8, 1)), np.ones((8, 3), np.float32), rng):
        pass
    assert [n is net.gen for n in ran] == [True, False, False]
    m, v, w, start = rng.normal(size=5), rng.random(5), rng.normal(size=5), 3
    adam, want = neural.Adam(m, v, start, 1e-2), w.copy()
    for t in range(start + 1, start + 4):
        g = rng.normal(size=5)
        adam.step(w, g)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        want -= 1e-2 * m / (1 - 0.9**t) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(w, want) and np.allclose(adam.m, m) and np.allclose(adam.v, v)


def test_knn_boxes_with_repeated_and_missing_keys(spark):
    """Other rows of one key must not lend each other neighbours, nor multiply beyond what the join by key does."""
    rows = [(i % 50, None if i % 4 == 0 else float(i * 7 % 31), None if i % 4 == 1 else i / 3) for i in range(100)]
    rows += [(None, None, 3.0), (None, 4.0, None), (None, 2.0, 1.0)]
    df = spark.createDataFrame(rows, "id int, a double, b double")
    fills = [sorted((tuple(r) for r in KNNImputer(3, box_rows=20, **way).fit_transform(df, "id").collect()), key=str) for way in ({}, {"max_broadcast_bytes": 0})]
    assert len(fills[0]) == len(fills[1])
    for x, y in zip(*fills):
        assert x[0] == y[0] and x[1:] == pytest.approx(y[1:])
