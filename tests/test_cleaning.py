import pytest
from pyspark.sql import functions as F

from holdfast.operators import clean, encode, profile, serve
from holdfast.operators.order_stats import numbered


def test_promotion_needs_strictly_more_than_the_threshold(spark):
    at = spark.createDataFrame([(str(i) if i < 4 else "x",) for i in range(5)], "a string")
    above = spark.createDataFrame([(str(i) if i < 5 else "x",) for i in range(6)], "a string")
    assert clean.promotable(at) == []
    assert clean.promotable(above) == ["a"]


def test_imputation_of_empty_columns_and_mode_ties(spark):
    df = spark.createDataFrame([(None, None, "b"), (None, None, "a"), (float("nan"), None, None)], "n double, t string, u string")
    assert encode.median_impute_fit(df, ["n"]) == {"n": 0.0}
    assert encode.mode_impute_fit(df, ["t", "u"]) == {"t": "Unknown", "u": "a"}


def test_preparation_handles_unseen_null_and_constant(spark):
    train = spark.createDataFrame(
        [(1.0, "5", "a", "k", 7), (3.0, "6", "b", "k", 7), (None, "7", "c", "k", 7), (5.0, "x", None, "k", 7), (5.0, "8", "c", "k", 7), (5.0, "9", "c", "k", 7)],
        "n double, s string, t string, one string, const int",
    )
    prep = encode.fit_preparation(train)
    assert prep.features == ["n", "s", "const", "t_b", "t_c"]
    assert prep.text_fill["t"] == "c" and prep.numeric_fill["n"] == 5.0 and prep.numeric_fill["s"] == 7.0
    new = spark.createDataFrame([(None, "bad", "zzz", "k", 7), (3.0, "6", None, "q", 7)], train.schema)
    raw = [r.asDict() for r in prep.transform(new, scale=False).collect()]
    assert raw[0] == {"n": 5.0, "s": 7.0, "const": 7.0, "t_b": 0.0, "t_c": 0.0}
    assert raw[1] == {"n": 3.0, "s": 6.0, "const": 7.0, "t_b": 0.0, "t_c": 1.0}
    assert all(r["const"] == 0.0 for r in prep.transform(new).collect())
    again = encode.Preparation.from_json(prep.to_json())
    assert again.transform(new).collect() == prep.transform(new).collect()
    missing = prep.transform(new.drop("s", "t"), scale=False).first().asDict()
    assert missing["s"] == 7.0 and missing["t_c"] == 1.0


def test_standardised_columns_have_unit_population_deviation(spark):
    df = spark.range(100).select((F.col("id") * 3.0).alias("x"))
    scaled = encode.standardize_columns(df, profile.moments(df, ["x"]))
    row = scaled.agg(F.avg("x"), F.stddev_pop("x")).first()
    assert abs(row[0]) < 1e-9 and abs(row[1] - 1) < 1e-9


def test_levels_guard(spark):
    df = spark.range(20).select(F.col("id").cast("string").alias("t"))
    with pytest.raises(ValueError):
        profile.levels(df, ["t"], max_levels=10)


def test_alignment_and_quarantine(spark):
    df = spark.createDataFrame([("1.5", True), ("x", False)], "a string, b boolean")
    assert [tuple(r) for r in clean.align_features(df, ["b", "zz", "a"]).collect()] == [(1.0, 0.0, 1.5), (0.0, 0.0, 0.0)]
    assert [r["error"] for r in clean.quarantine(df, ["a"]).collect()] == [None, "not a number: a"]


def test_defaults_fill_nulls_and_missing_columns(spark):
    df = spark.createDataFrame([(None,), (2.0,)], "Age double")
    rows = serve.feat_banking(df).collect()
    assert rows[0]["Age"] == 35.0 and rows[1]["Age"] == 2.0 and rows[0]["Gender_Male"] == 1.0 and rows[0]["Geography_Spain"] == 0.0


def test_telecom_features_without_service_columns(spark):
    df = spark.createDataFrame([("No", 3.0)], "InternetService string, tenure double")
    row = serve.feat_telecom(df).first().asDict()
    assert len(row) == 30 and row["TechSupport_No internet service"] == 1.0 and row["total_services"] == 0.0 and row["MultipleLines"] == 1.0


def test_serving_features_agree_with_generic_encoding(spark, base):
    """Train and serve must not differ: dummies of both paths are equal on the same rows."""
    from holdfast.sources import views

    df = views.accounts(spark, base)
    served = serve.feat_telecom(df.withColumn("TotalCharges", F.lit(1.0)), keep=["customerID"])
    cols = ["InternetService", "Contract"]
    generic = encode.onehot_encode(df.select("customerID", *cols), profile.levels(df, cols))
    names = [c for c in generic.columns if c != "customerID"]
    picked = served.select("customerID", *[f"`{n}`" for n in names])
    assert picked.exceptAll(generic.select(picked.columns)).isEmpty()


def test_find_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, Churn_Probability int, Churn_Prediction int")
    assert clean.find_prob_column(df) == "Churn_Probability"
    assert clean.find_churn_column(df) == "Churn_Prediction"
    assert clean.find_prob_column(df.select("a")) is None


def test_upload_without_target_is_refused(spark, tmp_path):
    from holdfast.sources import readers

    path = str(tmp_path / "up.csv")
    with open(path, "w") as f:
        f.write("a,b\n1,x\n")
    with pytest.raises(ValueError, match="Churn"):
        readers.read_training_upload(spark, path, "Churn")


def test_bulk_upload_quarantines_bad_lines(spark, tmp_path):
    from holdfast.sources import readers

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("id,tenure\n1,5\n2,oops\n3,7\n")
    good, bad = readers.read_bulk_upload(spark, str(tmp_path / "in"), "id int, tenure int")
    assert sorted(r["id"] for r in good.collect()) == [1, 3]
    lines = bad.collect()
    assert [r["line"] for r in lines] == ["2,oops"] and lines[0]["source_file"].endswith("a.csv")


def test_wide_text_column_becomes_a_sparse_vector(spark):
    df = spark.range(60_000).select(
        "id", (F.col("id") % 2).cast("double").alias("label"), (F.col("id") % 7).cast("double").alias("x"),
        F.when(F.col("id") % 11 == 0, None).otherwise(F.concat(F.lit("c"), F.lpad((F.col("id") * 7919 % 50_000).cast("string"), 5, "0"))).alias("city"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"),
    )
    prep = encode.fit_preparation(df, target="label", drop=["id"], max_levels=1000)
    levels = sorted({r["city"] for r in df.select("city").distinct().collect()} - {None})
    assert prep.wide == {"city": len(levels)} and prep.features == ["x", "kind_b", "city_levels"]
    sample = df.filter("id % 997 = 0").unionByName(spark.createDataFrame([(-1, 0.0, 1.0, "never seen", "a")], df.schema))
    for r in prep.transform(sample.withColumn("was", F.col("city")), keep=["id", "was"]).collect():
        place = levels.index(r["was"] or prep.text_fill["city"]) if r["was"] != "never seen" else 0
        v = r["city_levels"]
        assert v.size == len(levels) - 1 and v.indices.tolist() == ([place - 1] if place else []) and v.numNonzeros() == (place > 0)
    again = encode.Preparation.from_json(prep.to_json())
    assert again.transform(sample, keep=["id"]).count() == sample.count()


def test_numbered_counts_on_over_parts(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("v"), F.when(F.col("id") % 10 < 7, "hot").otherwise(F.col("id").cast("string")).alias("g")).repartition(7)
    by_group: dict = {}
    for r in numbered(df, ["v"], by=["g"]).collect():
        by_group.setdefault(r["g"], []).append((r["v"], r["number"]))
    assert all([n for _, n in sorted(rows)] == list(range(len(rows))) for rows in by_group.values())
    assert [r["number"] for r in numbered(df, ["v"]).orderBy("v").collect()] == list(range(1000))
