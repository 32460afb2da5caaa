"""Kernel machines and softmax boosting against plain numpy, and saved models."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tablewright.operators import boosting, kernel, models
from tablewright.operators.train import load_model, predict, save_model, train_model


def frame(spark, x, y):
    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"]).repartition(4)


# ----------------------------------------------------------------- kernels --

def test_map_approximates_the_radial_kernel():
    x = np.random.default_rng(0).normal(size=(40, 3))
    z = kernel.mapped(x, *kernel.directions(3, 4000, 0.4, 7))
    far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    assert np.abs(z @ z.T - np.exp(-0.4 * far)).max() < 0.08
    again = kernel.directions(3, 4000, 0.4, 7)
    assert (again[0] == kernel.directions(3, 4000, 0.4, 7)[0]).all()


def test_feature_stage_saves_and_loads(spark, tmp_dir):
    x = np.random.default_rng(1).normal(size=(20, 2))
    df = frame(spark, x, range(20))
    stage = kernel.FourierFeatures(width=2, components=16, gamma=0.5, seed=3)
    PipelineModel([stage]).write().save(f"{tmp_dir}/map")
    loaded = PipelineModel.load(f"{tmp_dir}/map")
    rows = [r for m in (stage, loaded) for r in [m.transform(df).orderBy("label").select("kernel_features").collect()]]
    want = kernel.mapped(x, *kernel.directions(2, 16, 0.5, 3))
    assert rows[0] == rows[1] and np.allclose([r[0].toArray() for r in rows[0]], want)
    assert stage.transform(df.limit(0)).collect() == []


def test_scale_gamma(spark):
    x = np.random.default_rng(2).normal(size=(50, 4)) * [1, 2, 3, 4] + 1
    assert kernel.scale_gamma(frame(spark, x, x[:, 0])) == pytest.approx(1 / (4 * x.var()))
    assert kernel.scale_gamma(frame(spark, np.ones((5, 2)), range(5))) == 0.5


def rings(n, seed=0):
    rng = np.random.default_rng(seed)
    inner = np.arange(n) % 2 == 0
    angle, r = rng.uniform(0, 2 * np.pi, n), np.where(inner, 1.0, 2.0) + 0.1 * rng.normal(size=n)
    return [(int(i), float(r[i] * np.cos(angle[i])), float(r[i] * np.sin(angle[i])), "in" if inner[i] else "out") for i in range(n)]


def test_svc_separates_rings_and_round_trips(spark, tmp_dir):
    df = spark.createDataFrame(rings(600), "id long, a double, b double, ring string")
    svc = train_model(df, ["a", "b"], "ring", "SVC", "classification", {"n_components": 100}, key_cols=["id"])
    line = train_model(df, ["a", "b"], "ring", "LogisticRegression", "classification", key_cols=["id"])
    assert svc.metrics["accuracy"] >= 0.95 and line.metrics["accuracy"] < 0.7
    assert svc.importance == []
    save_model(svc, f"{tmp_dir}/svc")
    before = predict(svc, df).orderBy("id").collect()
    assert predict(load_model(spark, f"{tmp_dir}/svc"), df).orderBy("id").collect() == before


def test_svc_of_three_classes(spark):
    rows = [(i, a, b, ring + ("1" if ring == "out" and a > 0 else "")) for i, a, b, ring in rings(450, 1)]
    df = spark.createDataFrame(rows, "id long, a double, b double, ring string")
    got = train_model(df, ["a", "b"], "ring", "SVC", "classification", {"n_components": 100, "gamma": 0.5}, key_cols=["id"])
    assert got.metrics["accuracy"] >= 0.9


def test_tube_loss_is_flat_inside_and_linear_outside():
    r = np.array([-3.0, -0.11, -0.1, 0.0, 0.05, 0.1, 0.3, 2.0])
    loss, slope = kernel.tube_loss(r, 0.1, 1e-6)
    assert np.allclose(loss, np.maximum(0, np.abs(r) - 0.1), atol=1e-6)
    assert slope.tolist() == [-1, -1, 0, 0, 0, 0, 1, 1]
    h = 1e-6
    steep = (kernel.tube_loss(r + h, 0.1, 0.5)[0] - kernel.tube_loss(r - h, 0.1, 0.5)[0]) / (2 * h)
    assert np.allclose(kernel.tube_loss(r, 0.1, 0.5)[1], steep, atol=1e-5)


def plain_svr(x, y, turn, phases, reg, epsilon):
    """The same objective by many small smoothed steps, and its value."""
    z = np.column_stack([kernel.mapped(x, turn, phases), np.ones(len(x))])

    def objective(w):
        return 0.5 * reg * w[:-1] @ w[:-1] + np.maximum(0, np.abs(z @ w - y) - epsilon).mean()

    def smooth(w, width):
        loss, slope = kernel.tube_loss(z @ w - y, epsilon, width)
        return 0.5 * reg * w[:-1] @ w[:-1] + loss.mean(), reg * np.append(w[:-1], 0) + z.T @ slope / len(y)

    w = np.zeros(z.shape[1])
    for width in (1, 0.1, 0.01, 0.001):
        w = kernel.minimise(lambda v: smooth(v, width), w, 2000, 1e-10)[0]
    return objective, objective(w)


def test_svr_reaches_the_minimum_of_the_tube_loss(spark, tmp_dir):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    y = 50 + np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] ** 2
    df = frame(spark, x, y)
    model = kernel.EpsilonSVR(components=60, regParam=1 / 400, gamma=0.5).fit(df)
    objective, best = plain_svr(x, y, *kernel.directions(2, 60, 0.5, 42), 1 / 400, 0.1)
    mine = objective(np.append(model.getOrDefault("weights"), model.getOrDefault("intercept")))
    assert mine <= 1.02 * best
    PipelineModel([model]).write().save(f"{tmp_dir}/svr")
    both = PipelineModel.load(f"{tmp_dir}/svr").transform(model.transform(df).withColumnRenamed("prediction", "before"))
    assert both.where("before != prediction").isEmpty() and both.count() == 400


def test_svr_needs_few_passes_over_the_rows(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 2))
    df = frame(spark, x, np.sin(2 * x[:, 0]) + 0.5 * x[:, 1] ** 2)
    passes, loss = [], kernel._loss
    monkeypatch.setattr(kernel, "_loss", lambda *args: passes.append(1) or loss(*args))
    by_newton = kernel.EpsilonSVR(components=40, regParam=1 / 600, gamma=0.5).fit(df)
    assert len(passes) <= 45
    monkeypatch.setattr(kernel, "MOST_CURVED", 39)  # as for many components: gradients only
    by_gradient = kernel.EpsilonSVR(components=40, regParam=1 / 600, gamma=0.5, maxIter=200).fit(df)
    a, b = ([r.prediction for r in m.transform(df).collect()] for m in (by_newton, by_gradient))
    assert np.allclose(a, b, atol=0.05)


def test_newton_meets_the_exact_minimum_of_a_square():
    h, at = np.array([[3.0, 1.0], [1.0, 2.0]]), np.array([1.0, -2.0])

    def along(w, back):
        ends = [w + (1 - share) * back - at for share in kernel.SHARES]
        return np.array([0.5 * e @ h @ e for e in ends]), h @ (w - at), h

    point, value, calls = kernel.newton(along, np.zeros(2), 50)
    assert np.allclose(point, at) and value < 1e-12 and calls <= 3


def test_svr_does_not_move_for_residuals_inside_the_tube(spark):
    x = np.linspace(-1, 1, 60)[:, None]
    y = 3 + 0.09 * np.sign(np.sin(50 * x[:, 0]))  # all within epsilon of a constant
    model = kernel.EpsilonSVR(components=20, regParam=1 / 60, gamma=1.0).fit(frame(spark, x, y))
    assert np.abs(model.getOrDefault("weights")).max() < 1e-6
    assert abs(model.getOrDefault("intercept") - 3) <= 0.11


def test_svr_as_registry_model(spark, tmp_dir):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), "xyz"[i % 3], float(np.sin(3 * a) + i % 3)) for i, a in enumerate(rng.uniform(-1, 1, 500))]
    df = spark.createDataFrame(rows, "id long, a double, kind string, y double")
    got = train_model(df, ["a", "kind"], "y", "SVR", "regression", {"n_components": 100}, key_cols=["id"])
    assert got.metrics["r2"] > 0.95
    save_model(got, f"{tmp_dir}/m")
    assert predict(load_model(spark, f"{tmp_dir}/m"), df).exceptAll(predict(got, df)).isEmpty()


# ---------------------------------------------------------------- boosting --

def overlapping(n=1500, seed=3):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, 3, n)
    centres = np.array([[0, 0], [1.6, 0.4], [0.5, 1.7]])
    return centres[label] + 0.8 * rng.normal(size=(n, 2)), label


def log_loss(p, y):
    return -np.log(np.maximum(p[np.arange(len(y)), y], 1e-12)).mean()


def test_softmax_boosting_beats_one_vs_rest(spark):
    x, y = overlapping()
    test_x, test_y = overlapping(1500, 9)
    df, held = frame(spark, x, y), frame(spark, test_x, test_y).cache()
    model = boosting.SoftmaxBoosting(classes=3, maxIter=15, stepSize=0.3).fit(df)
    losses = model.getOrDefault("losses")
    assert len(losses) == 16 and all(b < a for a, b in zip(losses, losses[1:]))
    p = boosting.softmax(model.scores(x))
    assert log_loss(p, y) == pytest.approx(losses[-1], rel=1e-9)
    got = model.transform(held).select(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    rest = OneVsRest(classifier=GBTClassifier(maxIter=15, maxDepth=3, stepSize=0.3, seed=1)).fit(df)
    other = np.array([[1 / (1 + np.exp(-2 * m.predictRaw(Vectors.dense(v))[1])) for m in rest.models] for v in test_x[:300]])
    other /= other.sum(axis=1, keepdims=True)
    shared = boosting.softmax(model.scores(test_x[:300]))
    assert log_loss(shared, test_y[:300]) < log_loss(other, test_y[:300])
    assert got > 0.7 and abs(model.featureImportances.toArray().sum() - 1) < 1e-9


def plain_round(x, y, k, cuts):
    """One round of depth 1 by brute force: per class the best cut and values."""
    p = np.tile(np.bincount(y, minlength=k) / len(y), (len(y), 1))
    out = []
    for j in range(k):
        r = (y == j) - p[:, j]
        best = max(((r[left].sum() ** 2 / left.sum() + r[~left].sum() ** 2 / (~left).sum() - r.sum() ** 2 / len(r)), -f, -c, f, c)
                   for f in range(x.shape[1]) for c in cuts[f] for left in [x[:, f] <= c] if 0 < left.sum() < len(r))
        f, c = best[3:]
        out.append((f, c, [(k - 1) / k * r[s].sum() / (np.abs(r[s]) * (1 - np.abs(r[s]))).sum()
                           for s in (x[:, f] <= c, x[:, f] > c)]))
    return out


def test_first_trees_match_brute_force(spark):
    x, y = overlapping(300)
    df = frame(spark, x, y)
    model = boosting.SoftmaxBoosting(classes=3, maxIter=1, maxDepth=1, stepSize=1.0).fit(df)
    cuts = boosting._cuts(spark.createDataFrame([([float(v) for v in a], int(b)) for a, b in zip(x, y)], "x array<double>, y int"), 2)
    for tree, (f, c, values) in zip(model.rounds()[0], plain_round(x, y, 3, cuts)):
        assert (tree.feature[0], tree.cut[0]) == (f, c)
        assert np.allclose(tree.value[1:], values)


def test_boosting_model_saves_and_holds_odd_features(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(boosting, "RENEW", 2)
    x, y = overlapping(200)
    x = np.column_stack([x, np.ones(200), np.where(np.arange(200) % 7 == 0, np.nan, x[:, 0])])
    df = frame(spark, x, y)
    model = boosting.SoftmaxBoosting(classes=3, maxIter=5).fit(df)
    assert model.featureImportances[2] == 0
    PipelineModel([model]).write().save(f"{tmp_dir}/b")
    loaded = PipelineModel.load(f"{tmp_dir}/b")
    assert loaded.transform(df).exceptAll(model.transform(df)).isEmpty()
    want = model.scores(x).argmax(axis=1)
    assert sorted(r[0] for r in model.transform(df).select("prediction").collect()) == sorted(want.tolist())
    with pytest.raises(ValueError, match="no row"):
        boosting.SoftmaxBoosting(classes=3).fit(df.limit(0))


def test_gradient_boosting_of_three_classes_is_joint():
    assert isinstance(models.build_estimator("GradientBoostingClassifier", "classification", {}, 10, 3), boosting.SoftmaxBoosting)
    assert isinstance(models.build_estimator("GradientBoostingClassifier", "classification", {}, 10, 2), GBTClassifier)
