import os

from pyspark.sql import functions as F

from tablewright import streaming
from tablewright.operators import aggregate as agg
from tablewright.operators import clean
from tablewright.operators import train as trainer


def test_clean_stream_matches_batch(spark, tmp_dir):
    src = os.path.join(tmp_dir, "in")
    batch = spark.createDataFrame([(i, f"s{i % 3}", float(i)) for i in range(50)], "k long, s string, v double")
    batch.repartition(4).write.parquet(src)
    steps = [lambda df: clean.combine_columns(df, "code", "k", "s", "-", 3, 0),
             lambda df: agg.binary_flag(df, "v", 25, "big"),
             lambda df: clean.drop_bad_rows(df, ["s", "v"], 0.5)]
    stream = streaming.read_stream(spark, src, batch.schema, max_files_per_trigger=1)
    out = os.path.join(tmp_dir, "out")
    streaming.clean_stream(stream, steps, out, os.path.join(tmp_dir, "ckpt"))
    got = spark.read.parquet(out)
    expected = streaming.apply_steps(spark.read.parquet(src), steps)
    assert got.count() == expected.count() == 49
    assert got.exceptAll(expected.select(*got.columns)).count() == 0


def test_train_on_stream(spark, tmp_dir):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    feats = ["l_quantity", "l_discount", "l_tax"]
    first = lines.where("l_linenumber <= 3")
    model = trainer.train_model(first, feats, "l_extendedprice", "SGDRegressor", "regression",
                                key_cols=["l_orderkey", "l_linenumber"])
    src = os.path.join(tmp_dir, "lines")
    lines.where("l_linenumber > 3").repartition(3).write.parquet(src)
    stream = streaming.read_stream(spark, src, lines.schema, max_files_per_trigger=1)
    _, holder = streaming.train_on_stream(stream, model, os.path.join(tmp_dir, "models"),
                                          os.path.join(tmp_dir, "ckpt2"))
    assert len(holder["batches"]) == 3
    assert holder["model"].sgd.passes == model.sgd.passes + 3
    saved = sorted(os.listdir(os.path.join(tmp_dir, "models")))
    assert saved == [f"batch={b}" for b in sorted(holder["batches"])]
    assert trainer.predict(holder["model"], lines).where(F.col("l_extendedprice Prediction").isNull()).count() == 0


def test_restarted_training_goes_on(spark, tmp_dir):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    feats = ["l_quantity", "l_discount", "l_tax"]
    model = trainer.train_model(lines.where("l_linenumber = 1"), feats, "l_extendedprice", "SGDRegressor", "regression",
                                key_cols=["l_orderkey", "l_linenumber"])
    src, models = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "models")

    def run():
        stream = streaming.read_stream(spark, src, lines.schema)
        return streaming.train_on_stream(stream, model, models, os.path.join(tmp_dir, "ckpt"))[1]

    lines.where("l_linenumber = 2").write.parquet(src)
    first = run()
    seen = model.sgd.n_seen + lines.where("l_linenumber = 2").count()
    assert first["model"].sgd.n_seen == seen
    lines.where("l_linenumber = 3").write.mode("append").parquet(src)
    second = run()
    seen += lines.where("l_linenumber = 3").count()
    assert second["model"].sgd.n_seen == seen and len(second["batches"]) == 2
    # a batch whose model was saved whole is not counted again; one without its mark is
    assert run()["model"].sgd.n_seen == seen
    assert streaming.stream.finished_batches(spark, models) == second["batches"]
