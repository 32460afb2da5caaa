import hashlib
import math
import uuid

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.operators import evaluate, incremental, models, prepare, select
from tablewright.operators import train as trainer


def test_exact_medians(spark):
    df = spark.createDataFrame([(1.0, 5.0), (2.0, None), (4.0, 5.0), (10.0, float("nan"))], "a double, b double")
    assert select.exact_medians(df, ["a", "b"]) == {"a": 3.0, "b": 5.0}


def test_exact_order_stats_multi_level(spark):
    # 50,000 spread values plus a hot value holding a third of the rows
    df = spark.range(0, 75000).select(
        F.when(F.col("id") % 3 == 0, F.lit(7.0)).otherwise(F.sin(F.col("id")) * 1e6).alias("x"))
    vals = np.sort(np.array([r.x for r in df.collect()]))
    for k in (1, 10, 37500, 37501, 74999, 75000):
        assert select.exact_ranks(df, lambda n: [k])[1]["x", k] == vals[k - 1]
    assert select.exact_median(df, "x") == float(np.median(vals))


def test_exact_ranks_of_steep_values(spark):
    # values over 600 decades, infinities, and two of them nearly equal
    df = spark.range(0, 20001).select(
        F.when(F.col("id") == 0, F.lit(float("inf"))).when(F.col("id") == 1, F.lit(float("-inf")))
         .otherwise(F.pow(F.lit(10.0), F.col("id") % 600 - 300) * (1 + F.col("id") / 1e9)).alias("x"))
    vals = sorted(r.x for r in df.collect())
    for k in (1, 2, 9999, 10001, 20000, 20001):
        assert select.exact_ranks(df, lambda n: [k])[1]["x", k] == vals[k - 1]
    with pytest.raises(ValueError, match="infinity"):
        prepare.fit_preprocessor(df, ["x"])


def test_exact_ranks_of_few_values(spark, monkeypatch):
    # neighbouring values that meet at the wanted rank: a balanced 0/1 column, 1 to 50 around 25 and 26
    guess, made = F.percentile_approx, []

    def limited(*args):
        made.append(1)
        assert len(made) < 60, "the brackets do not shrink"
        return guess(*args)

    monkeypatch.setattr(select.F, "percentile_approx", limited)
    df = spark.range(0, 20000).selectExpr("id % 2 as flag", "id % 50 + 1 as quantity", "id % 4 div 3 as quarter")
    assert select.exact_medians(df, df.columns) == {"flag": 0.5, "quantity": 25.5, "quarter": 0.0}
    made.clear()
    ranks = select.exact_ranks(df.select("flag"), lambda n: [1, 10000, 10001, 20000])[1]
    assert [ranks["flag", k] for k in (1, 10000, 10001, 20000)] == [0, 0, 1, 1]


def _jobs(spark, fn):
    """Number of jobs that ``fn`` runs."""
    group = f"count-{uuid.uuid4()}"
    spark.sparkContext.setJobGroup(group, group)
    fn()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setJobGroup("tests", "tests")
    return n


def test_preprocessing_jobs_do_not_grow_with_columns(spark):
    wide = spark.range(0, 200).select(*[(F.col("id") * (i + 1) % 17).cast("double").alias(f"x{i}") for i in range(10)],
                                      *[(F.col("id") % (i + 2)).cast("string").alias(f"c{i}") for i in range(10)])
    few = _jobs(spark, lambda: prepare.fit_preprocessor(wide, ["x3", "c3"]))
    many = _jobs(spark, lambda: prepare.fit_preprocessor(wide, wide.columns))
    assert many <= few + 2  # a rank may need one more round of two jobs


def test_odd_feature_names(spark):
    df = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, None)], "`l.tax` double, `kind of` string")
    prep = prepare.fit_preprocessor(df, ["l.tax", "kind of"])
    assert prep.feature_names() == ["l.tax", "kind of_a", "kind of_b"]
    assert prep.transform(df).select("features").count() == 3


@pytest.mark.parametrize("rows", [[(i % 2, "x") for i in range(100)], [(7, "x")] * 50])
def test_split_sizes_are_exact_with_repeated_rows(spark, rows):
    df = spark.createDataFrame(rows, "k int, y string").repartition(3)
    out = prepare.holdout_split(df, ["k", "y"])
    assert out.where("split = 'test'").count() == math.ceil(0.2 * len(rows)) and out.count() == len(rows)
    both = spark.createDataFrame([(0, "a")] * 50 + [(0, "b")] * 30, "k int, y string")
    got = prepare.stratified_split(both, ["k"], "y").where("split = 'test'").groupBy("y").count().collect()
    assert {r["y"]: r["count"] for r in got} == {"a": 10, "b": 6}


def test_tied_keys_split_by_content(spark):
    df = spark.createDataFrame([(1, float(i)) for i in range(40)], "k int, v double")
    one = {r.v for r in prepare.holdout_split(df.repartition(2), "k").where("split = 'test'").collect()}
    two = {r.v for r in prepare.holdout_split(df.repartition(7), "k").where("split = 'test'").collect()}
    assert len(one) == 8 and one == two


def test_split_hash_tells_keys_apart(spark):
    df = spark.createDataFrame([("a|b", "c"), ("a", "b|c"), ("a", None), ("a", ""), ("a\\", "|")], "x string, y string")
    assert df.select(prepare.split_hash(["x", "y"])).distinct().count() == 5


def test_kth_hash_exact_counts(spark):
    df = spark.range(0, 5000).withColumn("g", F.when(F.col("id") < 4000, "hot").otherwise("cold"))
    for test_size in (0.2, 0.33):
        out = prepare.holdout_split(df, "id", test_size)
        assert out.where("split = 'test'").count() == math.ceil(test_size * 5000)
    strat = prepare.stratified_split(df, "id", "g")
    counts = {r.g: r["count"] for r in strat.where("split = 'test'").groupBy("g").count().collect()}
    assert counts == {"hot": 800, "cold": 200}


def test_stratify_rule_fallbacks(spark):
    one = spark.createDataFrame([(i, "a") for i in range(10)], "k int, y string")
    assert not prepare.stratify_rule(one, "y", "classification").stratified
    single = spark.createDataFrame([(i, "a" if i else "b") for i in range(10)], "k int, y string")
    assert not prepare.stratify_rule(single, "y", "classification").stratified
    many = spark.createDataFrame([(i, str(i % 5)) for i in range(10)], "k int, y string")
    assert not prepare.stratify_rule(many, "y", "classification").stratified  # 2 test rows < 5 classes
    assert prepare.stratified_split(many, "k", "y").where("split='test'").count() == 2


def test_task_type(spark):
    df = spark.createDataFrame([(i % 20, i % 21, True, "t") for i in range(100)],
                               "a int, b int, c boolean, d string")
    assert prepare.infer_task_type(df, "a") == "classification"
    assert prepare.infer_task_type(df, "b") == "regression"
    assert prepare.infer_task_type(df, "c") == "classification"
    assert prepare.infer_task_type(df, "d") == "classification"


def test_preprocessor_impute_scale_onehot(spark):
    train = spark.createDataFrame([(1.0, "b"), (2.0, "a"), (4.0, "b"), (10.0, None), (None, "a")],
                                  "x double, c string")
    prep = prepare.fit_preprocessor(train, ["x", "c"])
    assert prep.medians["x"] == 3.0
    assert prep.modes["c"] == "a"            # tie a/b → smallest
    filled = [1.0, 2.0, 4.0, 10.0, 3.0]
    assert prep.means["x"] == pytest.approx(np.mean(filled))
    assert prep.scales["x"] == pytest.approx(np.std(filled))
    assert prep.feature_names() == ["x", "c_a", "c_b"]
    new = spark.createDataFrame([(None, "zzz"), (3.0, None), (3.0, " n/a ")], "x double, c string")
    rows = prep.transform(new).select(vector_to_array("features").alias("v")).collect()
    assert rows[0].v[1:] == [0.0, 0.0]        # unseen category → zeros
    assert rows[1].v[1:] == [1.0, 0.0]        # null is imputed with the mode before encoding
    assert rows[2].v[1:] == [1.0, 0.0]        # so is an NA spelling
    assert rows[0].v[0] == pytest.approx((3.0 - np.mean(filled)) / np.std(filled))


def test_constant_column_scale(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    assert prepare.fit_preprocessor(df, ["x"]).scales["x"] == 1.0


def test_classification_metrics_weighted(spark):
    y = ["a", "a", "b", "b", "b", "c"]
    p = ["a", "b", "b", "b", "c", "c"]
    df = spark.createDataFrame(list(zip(y, p)), "y string, p string")
    m = evaluate.metrics_dict(evaluate.classification_metrics(df, "y", "p"))
    # hand-computed weighted scores
    prec = {"a": 1.0, "b": 2 / 3, "c": 0.5}
    rec = {"a": 0.5, "b": 2 / 3, "c": 1.0}
    sup = {"a": 2, "b": 3, "c": 1}
    f1 = {c: 2 * prec[c] * rec[c] / (prec[c] + rec[c]) for c in sup}
    assert m["accuracy"] == pytest.approx(4 / 6)
    assert m["precision"] == pytest.approx(sum(prec[c] * sup[c] for c in sup) / 6)
    assert m["recall"] == pytest.approx(sum(rec[c] * sup[c] for c in sup) / 6)
    assert m["f1"] == pytest.approx(sum(f1[c] * sup[c] for c in sup) / 6)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.5), (2.0, 2.0), (3.0, 2.0)], "y double, p double")
    m = evaluate.metrics_dict(evaluate.regression_metrics(df, "y", "p"))
    assert m["mae"] == pytest.approx(0.5)
    assert m["rmse"] == pytest.approx(math.sqrt((0.25 + 0 + 1) / 3))
    assert m["r2"] == pytest.approx(1 - 1.25 / 2.0)
    const = spark.createDataFrame([(1.0, 1.0), (1.0, 1.0)], "y double, p double")
    assert evaluate.metrics_dict(evaluate.regression_metrics(const, "y", "p"))["r2"] == 1.0


@pytest.fixture(scope="module")
def lines(spark):
    return spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")


FEATS = ["l_quantity", "l_extendedprice", "l_discount", "l_linestatus"]


def test_train_predict_round_trip(spark, lines, tmp_dir):
    m = trainer.train_model(lines, FEATS, "l_returnflag", "RandomForestClassifier", "classification",
                            {"n_estimators": 5, "max_depth": 4}, key_cols=["l_orderkey", "l_linenumber"])
    assert set(m.metrics) == {"accuracy", "precision", "recall", "f1"}
    assert all(v >= 0 for _, v in m.importance)
    assert [n for n, _ in m.importance][:3] == ["l_quantity", "l_extendedprice", "l_discount"]
    pred = trainer.predict(m, lines)
    assert pred.count() == lines.count()
    assert pred.columns == lines.columns + ["l_returnflag Prediction"]
    trainer.save_model(m, f"{tmp_dir}/m")
    back = trainer.load_model(spark, f"{tmp_dir}/m")
    a = pred.select("l_orderkey", "l_linenumber", "l_returnflag Prediction")
    b = trainer.predict(back, lines).select("l_orderkey", "l_linenumber", "l_returnflag Prediction")
    assert a.exceptAll(b).count() == 0
    with pytest.raises(ValueError):
        trainer.predict(m, lines.drop("l_discount"))


@pytest.mark.parametrize("name", ["GradientBoostingClassifier", "LogisticRegression", "SVC"])
def test_other_classifiers(spark, lines, name):
    params = {"n_estimators": 5} if "Gradient" in name else {}
    m = trainer.train_model(lines, FEATS, "l_returnflag", name, "classification", params,
                            key_cols=["l_orderkey", "l_linenumber"])
    assert 0 <= m.metrics["accuracy"] <= 1
    assert len(m.importance) == (0 if name == "SVC" else 5)
    if "Gradient" in name:  # three classes are boosted together
        shared = m.pipeline.stages[-2].featureImportances.toArray()
        assert [v for _, v in m.importance] == pytest.approx(list(shared))
    assert m.top_importances(spark, 2).count() == min(2, len(m.importance))


@pytest.mark.parametrize("name", ["RandomForestRegressor", "GradientBoostingRegressor", "SVR"])
def test_regressors(spark, lines, name):
    params = {"n_estimators": 5, "max_depth": 4} if "Forest" in name else {"n_estimators": 5} if "Gradient" in name else {}
    m = trainer.train_model(lines, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", name,
                            "regression", params, key_cols=["l_orderkey", "l_linenumber"])
    assert set(m.metrics) == {"mae", "rmse", "r2"}
    assert len(m.importance) == (0 if name == "SVR" else 3)


def test_empty_evaluation_rows_fall_back_to_the_split(spark, lines):
    feats = ["l_quantity", "l_discount", "l_tax"]
    m = trainer.train_model(lines, feats, "l_extendedprice", "SGDRegressor", "regression",
                            key_cols=["l_orderkey", "l_linenumber"], eval_df=lines.where("false"))
    assert m.eval_rows.count() == math.ceil(0.2 * lines.count()) and m.metrics["mae"] > 0
    again = trainer.continue_training(m, lines, feats, "l_extendedprice", eval_df=lines.where("false"))
    assert again.scored_on_training_rows and again.metrics["mae"] > 0
    other = trainer.train_model(lines, feats, "l_extendedprice", "SGDRegressor", "regression",
                                key_cols=["l_orderkey", "l_linenumber"], eval_df=lines.where("l_linenumber = 1"))
    assert other.sgd.n_seen == lines.count()


def test_incremental_weights_do_not_depend_on_the_layout(spark, lines):
    feats = ["l_quantity", "l_discount", "l_tax"]

    def weights(df):
        m = trainer.train_model(df, feats, "l_extendedprice", "SGDRegressor", "regression",
                                key_cols=["l_orderkey", "l_linenumber"])
        return trainer.continue_training(m, df.where("l_linenumber > 3"), feats, "l_extendedprice").sgd

    a, b = weights(lines.coalesce(1)), weights(lines.repartition(7))
    # means and deviations are floating-point sums, so the last digits may differ
    assert a.coef[0] == pytest.approx(b.coef[0]) and a.intercept == pytest.approx(b.intercept) and a.n_seen == b.n_seen


def test_shards_are_averaged_by_rows(spark, lines):
    from pyspark.ml.feature import VectorAssembler
    rows = spark.range(0, 8000).select(F.sin("id").alias("a"), F.cos(F.col("id") * 7).alias("b"))
    data = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(
        rows.withColumn("__label", 3 * F.col("a") + 5))
    for shard_rows in (1000, 10_000):
        state = incremental.sgd_pass(incremental.new_state("regression", 2), data, shard_rows=shard_rows)
        assert state.n_seen == 8000 and state.passes == 1
        assert state.coef[0][0] > 1 and abs(state.coef[0][1]) < 0.2 and state.intercept[0] > 2


def test_unknown_parameters_are_refused(spark, lines):
    for name, params in (("SVC", {"rff_components": 10}), ("RandomForestClassifier", {"depth": 3})):
        with pytest.raises(ValueError, match="takes"):
            models.build_estimator(name, "classification", params, 10)
    with pytest.raises(ValueError, match="takes"):
        trainer.train_model(lines, ["l_tax"], "l_extendedprice", "SGDRegressor", "regression", {"eta": 1},
                            key_cols=["l_orderkey", "l_linenumber"])
    assert models.build_estimator("RandomForestRegressor", "regression", {}, 10).getFeatureSubsetStrategy() == "all"


def test_model_guards():
    with pytest.raises(ValueError):
        models.build_estimator("GradientBoostingClassifier", "classification", {"learning_rate": 2.0}, 10)
    with pytest.raises(ValueError):
        models.build_estimator("SVR", "classification", {}, 10)
    with pytest.warns(UserWarning):
        models.build_estimator("RandomForestClassifier", "classification", {"max_depth": 0}, 10)
    assert models.model_options("regression") == ["RandomForestRegressor", "GradientBoostingRegressor",
                                                  "SVR", "SGDRegressor"]
    assert models.is_incremental("SGDClassifier") and not models.is_incremental("SVC")


def test_incremental_continue(spark, lines):
    feats = ["l_quantity", "l_discount", "l_tax"]
    first = lines.where("l_linenumber <= 4")
    second = lines.where("l_linenumber > 4")
    m = trainer.train_model(first, feats, "l_extendedprice", "SGDRegressor", "regression",
                            key_cols=["l_orderkey", "l_linenumber"])
    assert m.incremental and m.sgd.passes == 1
    assert trainer.can_continue(m, feats, "l_extendedprice", "SGDRegressor", "regression")
    assert not trainer.can_continue(m, list(reversed(feats)), "l_extendedprice", "SGDRegressor", "regression")
    m2 = trainer.continue_training(m, second, feats, "l_extendedprice")
    assert m2.sgd.passes == 2 and m2.sgd.n_seen > m.sgd.n_seen and m2.scored_on_training_rows
    # a pass over no rows leaves the weights unchanged
    data = m.prep.transform(first.where("false")).withColumn("__label", F.col("l_extendedprice"))
    same = incremental.sgd_pass(m.sgd, data)
    assert same.coef == m.sgd.coef
    with pytest.raises(ValueError):
        trainer.continue_training(m, second.where("false"), feats, "l_extendedprice")


def test_incremental_classifier_new_label(spark, lines):
    first = lines.where("l_returnflag != 'R'")
    m = trainer.train_model(first, FEATS, "l_returnflag", "SGDClassifier", "classification",
                            key_cols=["l_orderkey", "l_linenumber"])
    assert m.sgd.classes == ["A", "N"] and len(m.sgd.coef) == 1
    with pytest.raises(ValueError):
        trainer.continue_training(m, lines, FEATS, "l_returnflag")
    pred = trainer.predict(m, lines)
    assert {r[0] for r in pred.select("l_returnflag Prediction").distinct().collect()} <= {"A", "N"}


def test_loaded_incremental_model_cannot_continue(spark, lines, tmp_dir):
    feats = ["l_quantity", "l_discount", "l_tax"]
    m = trainer.train_model(lines, feats, "l_extendedprice", "SGDRegressor", "regression",
                            key_cols=["l_orderkey", "l_linenumber"])
    trainer.save_model(m, f"{tmp_dir}/sgd")
    back = trainer.load_model(spark, f"{tmp_dir}/sgd")
    assert back.features == feats and not back.continuable
    assert trainer.predict(back, lines).count() == lines.count()
    assert not trainer.can_continue(back, feats, "l_extendedprice", "SGDRegressor", "regression")
    with pytest.raises(ValueError):
        trainer.continue_training(back, lines, feats, "l_extendedprice")


def test_model_list():
    ml = trainer.ModelList()
    a = trainer.TrainedModel("SVC", "classification", ["x"], "y")
    assert ml.add(a) == "SVC" and ml.add(a) == "SVC_2" and ml.active == "SVC_2"
    assert ml.names() == ["SVC", "SVC_2"]
    ml.select("SVC")
    ml.delete("SVC")
    assert ml.active == "SVC_2" and ml.get() is a
    with pytest.raises(ValueError):
        ml.select("nope")


def test_kth_with_hot_duplicate_hash(spark):
    # a third of the rows share one key (same hash); the rest are unique
    df = spark.range(0, 3000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    hashed = df.withColumn("__h", prepare.split_hash(["k"])).withColumn("__g", F.lit(0))
    vals = sorted(r["__h"] for r in hashed.collect())
    for k in (1, 500, 1000, 1500, 3000):
        kdf = spark.createDataFrame([(0, k)], "__g int, __k long")
        thr = select.kth_hash_per_group(hashed, "__h", ["__g"], kdf).first()["__thr"]
        assert thr == vals[k - 1]


def test_sparse_pass_equals_dense_steps():
    rng = np.random.default_rng(1)
    dense = rng.normal(size=(90, 7)) * (rng.random((90, 7)) < 0.4)
    import pyarrow as pa
    mixed = [(np.flatnonzero(r).tolist(), r[r != 0].tolist()) if i % 3 else (None, r.tolist()) for i, r in enumerate(dense)]
    rows = incremental.Rows.of(pa.array([m[0] for m in mixed], pa.list_(pa.int32())),
                               pa.array([m[1] for m in mixed], pa.list_(pa.float64())))
    w = rng.normal(size=(2, 7))
    assert np.allclose(rows.times(w), dense @ w.T) and np.allclose(rows.part(10, 33).times(w), dense[10:33] @ w.T)
    for task, ys in (("regression", dense @ w[0]), ("classification", ["abc"[i % 3] for i in range(90)])):
        state = incremental.new_state(task, 7, None if task == "regression" else list("abc"), 0.01)
        import dataclasses
        at = incremental._Pass(dataclasses.asdict(state), np.array(state.coef))
        y = at.targets(ys)
        at.step(rows, y)
        coef, bias, t = np.array(state.coef), np.array(state.intercept), 1.0
        for lo in range(0, 90, incremental.BATCH):  # the same steps on whole rows
            xb, yb = dense[lo:lo + incremental.BATCH], y[lo:lo + incremental.BATCH]
            p, m = xb @ coef.T + bias, len(xb)
            eta = 1 / (0.01 * (at.t0 + t - 1)) if task == "classification" else state.eta0 / t ** state.power_t
            loss = np.where(p * yb <= 1, -yb, 0.0) if task == "classification" else p - yb
            rate = eta / (1 + eta * ((xb * xb).sum() + m))
            coef = coef * max(0.0, 1 - rate * 0.01 * m) - rate * loss.T @ xb
            bias, t = bias - rate * loss.sum(axis=0), t + m
        assert np.allclose(at.weights(), coef) and np.allclose(at.bias, bias) and at.t == t


def test_text_feature_of_very_many_values(spark):
    n = 60_000  # a category each for 20,000 of them; a dense row would be 160 KB
    df = spark.range(n).selectExpr("id", "concat('c', id % 20000) as kind", "cast(id % 7 as double) as x",
                                   "3 * (id % 7) + 1 as y", "if(id % 7 > 3, 'hi', 'lo') as big")
    got = trainer.train_model(df, ["x", "kind"], "y", "SGDRegressor", "regression", key_cols=["id"])
    assert len(got.sgd.coef[0]) > 15_000 and got.metrics["r2"] > 0.9
    assert trainer.predict(got, df).where("`y Prediction` is null").isEmpty()
    hit = trainer.train_model(df, ["x", "kind"], "big", "SGDClassifier", "classification", key_cols=["id"])
    assert hit.metrics["accuracy"] > 0.9


@pytest.mark.parametrize("most", [10_000, 0])
def test_kth_hash_gathers_no_group(spark, monkeypatch, most):
    """Rows meet the groups' state by broadcast, or, where groups are many, by
    group and prefix: never by the group alone."""
    from pyspark.sql import functions as F
    from tablewright.operators import select
    rows = spark.range(6000).selectExpr("id % 3 as g", "md5(cast(id as string)) as h")
    monkeypatch.setattr(select, "BROADCAST_CLASSES", most)
    monkeypatch.setattr(select, "PREFIX_DIGITS", 1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plans, cut = [], select.cut_lineage

    def kept(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(select, "cut_lineage", kept)
    try:
        k = rows.groupBy("g").agg(F.lit(700).cast("long").alias("__k"))
        got = {r["g"]: (r["__thr"], r["__ties"], r["__need"])
               for r in select.kth_hash_per_group(rows, "h", ["g"], k).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    by_group = {}
    for r in rows.collect():
        by_group.setdefault(r["g"], []).append(r["h"])
    assert got == {g: (sorted(hs)[699], 1, 1) for g, hs in by_group.items()}
    assert len(plans) > 3
    for plan in plans[2:]:
        if most:
            assert "SortMergeJoin" not in plan
        else:
            joins = [line for line in plan.splitlines() if "SortMergeJoin" in line]
            assert joins and all("substring" in line for line in joins)


def test_split_sorts_no_row_and_escapes_keys(spark, monkeypatch):
    """The pass over all rows hashes its counts; text aggregates sort them."""
    rows = spark.range(5000).select("id", F.col("id").cast("string").alias("t"), (F.col("id") % 3).alias("g"))
    plans, cut = [], select.cut_lineage

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(df)

    monkeypatch.setattr(select, "cut_lineage", seen)
    hashed = rows.withColumn("h", prepare.split_hash(["t"]))
    k = spark.createDataFrame([(0, 300), (1, 1), (2, 1666)], "g long, __k long")
    got = {r["g"]: r for r in select.kth_hash_per_group(hashed, "h", ["g"], k).collect()}
    first_pass = plans[1]
    assert "SortAggregate" not in first_pass and "HashAggregate" in first_pass
    for g, kth in ((0, 300), (1, 1), (2, 1666)):
        want = sorted(hashlib.md5(f"{i}|42".encode()).hexdigest() for i in range(g, 5000, 3))[kth - 1]
        assert (got[g]["__thr"], got[g]["__ties"], got[g]["__need"]) == (want, 1, 1)
    odd = spark.createDataFrame([("a|b\\", None)], "x string, y string").select(prepare.split_hash(["x", "y"])).first()[0]
    assert odd == hashlib.md5("a\\|b\\\\|\\N|42".encode()).hexdigest()


def test_models_share_one_preparation(spark, monkeypatch):
    df = spark.range(400).select("id", (F.col("id") % 7).cast("double").alias("a"),
                                 F.when(F.col("id") % 7 > 3, "x").otherwise("y").alias("y"))
    calls, fitted = [], trainer.fit_preprocessor
    monkeypatch.setattr(trainer, "fit_preprocessor", lambda *a: calls.append(a) or fitted(*a))
    both = trainer.prepare_training(df, ["a"], "y", "classification", ["id"])
    got = [trainer.train_model(df, ["a"], "y", name, "classification", params, key_cols=["id"], prepared=both)
           for name, params in (("RandomForestClassifier", {"n_estimators": 3, "max_depth": 3}), ("SGDClassifier", {}))]
    assert len(calls) == 1 and both.cached.is_cached
    alone = trainer.train_model(df, ["a"], "y", "RandomForestClassifier", "classification",
                                {"n_estimators": 3, "max_depth": 3}, key_cols=["id"])
    assert alone.metrics == got[0].metrics and alone.importance == got[0].importance
    with pytest.raises(ValueError, match="prepared for"):
        trainer.train_model(df, ["id"], "y", "SGDClassifier", "classification", prepared=both)
    both.release()
    assert not both.cached.is_cached
