"""What the learners of many passes keep of the rows, and that they reach the
minimum all the same."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tablewright.operators import boosting, kernel
from tablewright.operators.train import load_model, predict, save_model, train_model


def frame(spark, x, y):
    return spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"]).repartition(4)


def three_rings(n=900, seed=1):
    rng = np.random.default_rng(seed)
    y = np.arange(n) % 3
    angle, r = rng.uniform(0, 2 * np.pi, n), y + 0.5 + 0.3 * rng.normal(size=n)
    return np.column_stack([r * np.cos(angle), r * np.sin(angle)]), y


# ----------------------------------------------------------------- kernels --

def plain_hinge(x, y, turn, phases, reg):
    """The least mean hinge loss of sides -1 and 1, by many small smoothed steps."""
    z = np.column_stack([kernel.mapped(x, turn, phases), np.ones(len(x))])

    def objective(w):
        return 0.5 * reg * w[:-1] @ w[:-1] + np.maximum(0, 1 - y * (z @ w)).mean()

    def smooth(w, width):
        over = np.maximum(0, 1 - y * (z @ w))
        corner = np.minimum(over, width)
        return (0.5 * reg * w[:-1] @ w[:-1] + (corner * (over - corner / 2) / width).mean(),
                reg * np.append(w[:-1], 0) - z.T @ (y * corner / width) / len(y))

    w = np.zeros(z.shape[1])
    for width in (2, 0.2, 0.02, 0.002):
        w = kernel.minimise(lambda v: smooth(v, width), w, 2000, 1e-10)[0]
    return objective, objective(w)


def test_svc_reaches_the_minimum_of_the_hinge_loss_of_every_class(spark, tmp_dir, monkeypatch):
    x, y = three_rings()
    df = frame(spark, x, y)
    passes, loss = [], kernel._loss
    monkeypatch.setattr(kernel, "_loss", lambda *args: passes.append(len(args[2])) or loss(*args))
    model = kernel.KernelSVC(classes=3, components=50, regParam=1 / 900, gamma=0.5).fit(df)
    assert max(passes) == 3 and len(passes) <= 60  # the classes share the passes
    machines = np.array(model.getOrDefault("machines")).reshape(3, -1)
    turn, phases = kernel.directions(2, 50, 0.5, 42)
    for j in range(3):
        objective, best = plain_hinge(x, np.where(y == j, 1, -1), turn, phases, 1 / 900)
        assert objective(machines[j]) <= 1.02 * best
    PipelineModel([model]).write().save(f"{tmp_dir}/svc")
    both = PipelineModel.load(f"{tmp_dir}/svc").transform(model.transform(df).withColumnRenamed("prediction", "before"))
    want = (np.column_stack([kernel.mapped(x, turn, phases), np.ones(900)]) @ machines.T).argmax(axis=1)
    assert both.where("before != prediction").isEmpty()
    assert both.where("before = 1").count() == pytest.approx((want == 1).sum(), abs=2)
    monkeypatch.setattr(kernel, "MOST_CURVED", 49)  # as for many components: gradients only
    by_gradient = kernel.KernelSVC(classes=3, components=50, regParam=1 / 900, gamma=0.5, maxIter=300).fit(df)
    same = by_gradient.transform(model.transform(df).withColumnRenamed("prediction", "other"))
    assert same.where("other != prediction").count() <= 20


def test_kernel_learners_keep_rows_and_no_mapped_features(spark, monkeypatch):
    """Memory and disk of a fit are those of the prepared rows, however many components."""
    x, y = three_rings()
    kept, packed = [], kernel.packed

    def seen(*args):
        blocks = packed(*args)
        kept.append(blocks.select(F.sum(F.length("x") + F.length("y"))).first()[0])
        return blocks

    def mapped(*_):
        raise AssertionError("Mapped rows as a column.")

    monkeypatch.setattr(kernel, "packed", seen)
    monkeypatch.setattr(kernel.FourierFeatures, "_transform", mapped)
    df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, ((a, b), c) in enumerate(zip(x, y))],
                               "id long, a double, b double, y int")
    svc = train_model(df, ["a", "b"], "y", "SVC", "classification", {"n_components": 80}, key_cols=["id"])
    svr = train_model(df, ["a", "b"], "y", "SVR", "regression", {"n_components": 80}, key_cols=["id"])
    assert kept == [720 * 3 * 8] * 2
    assert svc.metrics["accuracy"] > 0.6 and svr.metrics["r2"] > 0.5


def test_both_models_of_the_kernel_query_share_the_prepared_rows(spark, monkeypatch):
    import __spark_entry__ as entry
    from tablewright.plans import registered
    made, prepare = [], registered.trainer.prepare_training
    monkeypatch.setattr(registered.trainer, "prepare_training", lambda *args, **more: made.append(prepare(*args, **more)) or made[-1])
    got = entry.queries()["kernel_classifier"](spark, "/root/testdata/sf0.001").first()
    assert len(made) == 1 and not made[0].cached.is_cached
    assert got["n_rows"] > 0


def test_a_pass_is_a_task_per_core_over_whole_blocks(spark):
    """A pass costs its rows, not the tasks of the shuffle that dealt them."""
    x, y = three_rings()
    blocks = kernel.packed(frame(spark, x, y).repartition(60), "features", "label")
    assert blocks.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    got = [(np.frombuffer(r.x).reshape(-1, 2), np.frombuffer(r.y)) for r in blocks.collect()]
    both = np.column_stack([np.vstack([a for a, _ in got]), np.concatenate([b for _, b in got])])
    assert sorted(map(tuple, both)) == sorted(map(tuple, np.column_stack([x, y])))


def test_rows_far_out_are_mapped_as_alone():
    to = kernel.Map(*kernel.directions(2, 30, 0.5, 1))
    x = np.random.default_rng(0).normal(size=(50, 2))
    far = np.vstack([x, [[1e7, -3e6]], x])
    got = to(far) * to.scale
    want = np.column_stack([kernel.mapped(far, *kernel.directions(2, 30, 0.5, 1)), np.ones(101)])
    assert np.abs(got - want).max() < 1e-5 and (to(far)[:50] == to(far)[51:]).all()
    assert to(x[:0]).shape == (0, 31)


# ---------------------------------------------------------------- boosting --

def test_sums_by_bins_grow_the_trees_of_the_rows(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.column_stack([rng.normal(size=700), rng.integers(0, 5, 700), np.where(np.arange(700) % 9, rng.normal(size=700), np.nan)])
    y = x[:, 0] ** 2 + x[:, 1] + np.nan_to_num(x[:, 2])
    df = frame(spark, x, y)
    classes = df.withColumn("label", (F.col("label") > 1).cast("double") + (F.col("label") > 4).cast("double"))
    sizes, renewed = [], boosting._renewed

    def seen(state):
        got = renewed(state)
        sizes.append(got[0].count())
        return got

    monkeypatch.setattr(boosting, "_renewed", seen)
    monkeypatch.setattr(boosting, "RENEW", 3)
    for fit, rows in ((boosting.SquareBoosting(maxIter=7, stepSize=0.3), df),
                      (boosting.SoftmaxBoosting(classes=3, maxIter=4, stepSize=0.3), classes)):
        monkeypatch.setattr(boosting, "MOST_SUMS", 1 << 20)
        by_sums = fit.fit(rows)
        monkeypatch.setattr(boosting, "MOST_SUMS", 0)
        by_rows = fit.fit(rows)
        for a, b in zip(by_sums.rounds(), by_rows.rounds()):
            for t, u in zip(a, b):
                assert (t.feature == u.feature).all() and (t.cut == u.cut).all() and np.allclose(t.value, u.value)
        assert np.allclose(by_sums.getOrDefault("losses"), by_rows.getOrDefault("losses"))
        assert np.allclose(by_sums.featureImportances.toArray(), by_rows.featureImportances.toArray())
    # few and small tables: sums of at most 32 * 5 * 32 bins, and no more of them than rows
    assert sizes[:3] == [sizes[0]] * 3 and sizes[3:6] == [700] * 3 and sizes[0] < 700


def test_many_rows_are_few_sums(spark, monkeypatch):
    """What the passes of a fit read does not grow with the rows."""
    sizes, renewed = [], boosting._renewed
    monkeypatch.setattr(boosting, "_renewed", lambda state: sizes.append(state.count()) or renewed(state))
    rows = spark.range(60_000).selectExpr("id", "rand(1) as a", "rand(2) as b", "a * a + sin(6 * b) as y")
    got = train_model(rows, ["a", "b"], "y", "GradientBoostingRegressor", "regression", {"n_estimators": 12}, key_cols=["id"])
    assert max(sizes) <= 32 * 32 and got.metrics["r2"] > 0.8


def test_square_boosting_matches_mllib(spark, tmp_dir):
    """The rounds, importances and predictions of GBTRegressor, whose cuts differ a little."""
    rng = np.random.default_rng(3)
    x = np.column_stack([rng.integers(0, 20, 2000), rng.integers(0, 12, 2000), rng.integers(0, 3, 2000)]).astype(float)
    y = 1000 + x[:, 0] ** 2 / 40 - 3 * x[:, 1] + 0.1 * rng.normal(size=2000)
    df = frame(spark, x, y)
    mine = boosting.SquareBoosting(maxIter=8, stepSize=0.2).fit(df)
    theirs = GBTRegressor(maxIter=8, stepSize=0.2, maxDepth=3, seed=1).fit(df)
    p = theirs.transform(mine.transform(df).withColumnRenamed("prediction", "mine"))
    off, spread = p.select(F.max(F.abs(F.col("mine") - F.col("prediction"))), F.stddev("label")).first()
    assert off < 1e-6 * spread
    assert np.allclose(mine.featureImportances.toArray(), theirs.featureImportances.toArray(), atol=1e-9)
    losses = mine.getOrDefault("losses")
    assert len(losses) == 9 and all(b < a for a, b in zip(losses, losses[1:]))
    assert losses[0] == pytest.approx(y.var()) and losses[-1] == pytest.approx(((mine.scores(x)[:, 0] - y) ** 2).mean())
    PipelineModel([mine]).write().save(f"{tmp_dir}/b")
    assert PipelineModel.load(f"{tmp_dir}/b").transform(df).exceptAll(mine.transform(df)).isEmpty()


def test_square_boosting_of_equal_targets_and_no_rows(spark, tmp_dir):
    x = np.arange(30.0)[:, None]
    model = boosting.SquareBoosting(maxIter=3).fit(frame(spark, x, np.full(30, 7.5)))
    assert {r.prediction for r in model.transform(frame(spark, x, x[:, 0])).collect()} == {7.5}
    assert model.featureImportances.toArray().tolist() == [0.0]
    with pytest.raises(ValueError, match="no row"):
        boosting.SquareBoosting().fit(frame(spark, x, x[:, 0]).limit(0))
    df = spark.createDataFrame([(i, float(i % 13), "xyz"[i % 3], float(i % 13 + i % 3)) for i in range(300)],
                               "id long, a double, kind string, y double")
    got = train_model(df, ["a", "kind"], "y", "GradientBoostingRegressor", "regression", {"n_estimators": 30}, key_cols=["id"])
    save_model(got, f"{tmp_dir}/m")
    assert got.metrics["r2"] > 0.95 and len(got.importance) == 4
    assert predict(load_model(spark, f"{tmp_dir}/m"), df).exceptAll(predict(got, df)).isEmpty()
