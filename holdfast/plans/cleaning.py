"""Column maintenance, imputation, encoding, scaling and serving features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import TELECOM
from ..functions import text
from ..functions.text import ref
from ..operators import clean, encode, profile, serve
from ..operators.order_stats import medians
from ..sources import views
from . import oracle_views as V
from .registry import query

ID = "customerID"


@query("drop_columns", f"""WITH {V.ACCOUNTS} SELECT gender, tenure, "Contract", "Churn", count(*) AS n FROM accounts GROUP BY ALL""")
def drop_columns(spark: SparkSession, base: str) -> DataFrame:
    part = views.accounts(spark, base).select(ID, "gender", "tenure", "Contract", "Churn")
    rest = clean.drop_columns(part, [*TELECOM.drop_cols, "RowNumber"])
    return rest.groupBy(*rest.columns).agg(F.count("*").alias("n"))


@query("coerce_numeric", f"""WITH {V.ACCOUNTS} SELECT "customerID", round(total_num, 6) AS "TotalCharges" FROM accounts""")
def coerce_numeric(spark: SparkSession, base: str) -> DataFrame:
    df = clean.coerce_numeric(views.accounts(spark, base).select(ID, "TotalCharges"), ["TotalCharges"])
    return df.withColumn("TotalCharges", F.round("TotalCharges", 6))


@query(
    "promote_numeric",
    f"""WITH {V.ACCOUNTS}, c AS (SELECT count(total_num) AS ok, count(*) AS n FROM accounts)
    SELECT 'TotalCharges' AS "column", ok AS parsed, n AS total, ok > n * 0.8 AS promoted FROM c
    UNION ALL SELECT 'Contract', 0, n, false FROM c UNION ALL SELECT 'PaymentMethod', 0, n, false FROM c""",
)
def promote_numeric(spark: SparkSession, base: str) -> DataFrame:
    df = views.accounts(spark, base).select("TotalCharges", "Contract", "PaymentMethod")
    shares = clean.parse_shares(df, df.columns)
    promoted = clean.promote_numeric(df)
    kinds = {f.name: f.dataType.simpleString() == "double" for f in promoted.schema}
    rows = [(c, ok, n, kinds[c]) for c, (ok, n) in shares.items()]
    return spark.createDataFrame(rows, "column string, parsed bigint, total bigint, promoted boolean")


@query("map_target", f"""WITH {V.ACCOUNTS} SELECT "customerID", CASE "Churn" WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS "Churn" FROM accounts""")
def map_target(spark: SparkSession, base: str) -> DataFrame:
    return clean.map_target(views.accounts(spark, base).select(ID, "Churn"), "Churn", TELECOM.target_map)


_PAID = """CASE "PaymentMethod" WHEN 'Electronic check' THEN 1 WHEN 'Mailed check' THEN 0 END"""


@query("drop_null_target", f"""WITH {V.ACCOUNTS} SELECT * FROM (SELECT "customerID", {_PAID} AS target FROM accounts) t WHERE target IS NOT NULL""")
def drop_null_target(spark: SparkSession, base: str) -> DataFrame:
    df = views.accounts(spark, base).select(ID, F.col("PaymentMethod").alias("target"))
    return clean.drop_null_target(clean.map_target(df, "target", {"Electronic check": 1, "Mailed check": 0}), "target")


@query(
    "drop_any_null",
    f"""WITH {V.SHOPPERS} SELECT "CustomerID", "WarehouseToHome", "HourSpendOnApp" FROM shoppers
    WHERE "WarehouseToHome" IS NOT NULL AND "HourSpendOnApp" IS NOT NULL""",
)
def drop_any_null(spark: SparkSession, base: str) -> DataFrame:
    return clean.drop_any_null(views.shoppers(spark, base).select("CustomerID", "WarehouseToHome", "HourSpendOnApp"))


@query("split_xy", f"""WITH {V.CLIENTS} SELECT "CustomerId", "Age", "Balance", "Exited"::DOUBLE AS label FROM clients""")
def split_xy(spark: SparkSession, base: str) -> DataFrame:
    df = views.clients(spark, base).select("CustomerId", "Age", "Balance", "Exited")
    return clean.split_xy(df, "Exited", keep=["CustomerId"])


@query(
    "map_encode",
    f"""WITH {V.ACCOUNTS} SELECT "customerID", CASE gender WHEN 'Male' THEN 1 ELSE 0 END AS gender, CASE "Partner" WHEN 'Yes' THEN 1 ELSE 0 END AS "Partner",
      CASE "Dependents" WHEN 'Yes' THEN 1 ELSE 0 END AS "Dependents", CASE "PhoneService" WHEN 'Yes' THEN 1 ELSE 0 END AS "PhoneService",
      CASE "PaperlessBilling" WHEN 'Yes' THEN 1 ELSE 0 END AS "PaperlessBilling",
      CASE "MultipleLines" WHEN 'No phone service' THEN 0 WHEN 'No' THEN 1 WHEN 'Yes' THEN 2 END AS "MultipleLines" FROM accounts""",
)
def map_encode(spark: SparkSession, base: str) -> DataFrame:
    return clean.map_encode(views.accounts(spark, base).select(ID, *clean.TELECOM_MAPS))


@query(
    "cast_all_double",
    f"""WITH {V.ACCOUNTS} SELECT "customerID", tenure::DOUBLE AS tenure, "SeniorCitizen"::DOUBLE AS "SeniorCitizen",
      round(coalesce(total_num, 0), 6) AS "TotalCharges", 0.0::DOUBLE AS "Contract" FROM accounts""",
)
def cast_all_double(spark: SparkSession, base: str) -> DataFrame:
    df = views.accounts(spark, base).select(ID, "tenure", "SeniorCitizen", "TotalCharges", "Contract")
    return clean.cast_all_double(df, keep=[ID]).withColumn("TotalCharges", F.round("TotalCharges", 6))


@query(
    "align_features",
    f"""WITH {V.CLIENTS} SELECT "CustomerId", "Balance", "Age", 0.0::DOUBLE AS "Geography_Spain", "NumOfProducts"::DOUBLE AS "NumOfProducts" FROM clients""",
)
def align_features(spark: SparkSession, base: str) -> DataFrame:
    return clean.align_features(views.clients(spark, base), ["Balance", "Age", "Geography_Spain", "NumOfProducts"], keep=["CustomerId"])


@query(
    "apply_defaults",
    f"""WITH {V.SHOPPERS} SELECT "CustomerID", coalesce("WarehouseToHome", 20) AS "WarehouseToHome", coalesce("HourSpendOnApp", 3) AS "HourSpendOnApp",
      'telecom' AS channel FROM shoppers""",
)
def apply_defaults(spark: SparkSession, base: str) -> DataFrame:
    df = views.shoppers(spark, base).select("CustomerID", "WarehouseToHome", "HourSpendOnApp")
    return clean.apply_defaults(df, {"WarehouseToHome": 20.0, "HourSpendOnApp": 3.0, "channel": "telecom"})


@query("derive_total", f"""WITH {V.ACCOUNTS} SELECT "customerID", round("MonthlyCharges" * tenure, 6) AS total FROM accounts""")
def derive_total(spark: SparkSession, base: str) -> DataFrame:
    df = views.accounts(spark, base)
    return df.select(ID, F.round(serve.derive_total(F.col("MonthlyCharges"), F.col("tenure")), 6).alias("total"))


@query(
    "find_prob_column",
    f"""WITH {V.PREDICTIONS} SELECT 'churn_probability' AS found, count(*) AS n, round(max(churn_probability), 6) AS largest FROM predictions""",
)
def find_prob_column(spark: SparkSession, base: str) -> DataFrame:
    log = views.predictions(spark, base)
    name = clean.find_prob_column(log)
    return log.agg(F.lit(name).alias("found"), F.count("*").alias("n"), F.round(F.max(ref(name)), 6).alias("largest"))


@query(
    "find_churn_column",
    f"""WITH {V.ACCOUNTS} SELECT 'Churn' AS found, count(*) FILTER ("Churn" = 'Yes') AS churners FROM accounts""",
)
def find_churn_column(spark: SparkSession, base: str) -> DataFrame:
    df = views.accounts(spark, base).withColumn("Churn_Probability", F.lit(0.5)).select(ID, "Churn_Probability", "Churn")
    name = clean.find_churn_column(df)
    return df.agg(F.lit(name).alias("found"), F.count_if(text.flag_by_pattern(ref(name))).alias("churners"))


@query("select_existing", f"""WITH {V.PREDICTIONS} SELECT date, time, tenure, prediction, risk_level FROM predictions""")
def select_existing(spark: SparkSession, base: str) -> DataFrame:
    return clean.select_existing(views.predictions(spark, base), ["date", "time", "tenure", "absent", "prediction", "risk_level"])


@query("rename_export", f"""WITH {V.SHOPPERS} SELECT "CustomerID", "Tenure", "Churn" AS "Churned" FROM shoppers""")
def rename_export(spark: SparkSession, base: str) -> DataFrame:
    return clean.rename_export(views.shoppers(spark, base).select("CustomerID", "Tenure", "Churn"), {"Churn": "Churned"})


@query(
    "median_impute_fit",
    f"""WITH {V.ACCOUNTS}, {V.SHOPPERS}
    SELECT 'TotalCharges' AS "column", round(median(total_num), 6) AS median FROM accounts
    UNION ALL SELECT 'tenure', round(median(tenure), 6) FROM accounts
    UNION ALL SELECT 'WarehouseToHome', round(median("WarehouseToHome"), 6) FROM shoppers""",
)
def median_impute_fit(spark: SparkSession, base: str) -> DataFrame:
    acc = clean.coerce_numeric(views.accounts(spark, base), ["TotalCharges"])
    found = medians(acc, ["TotalCharges", "tenure"]) | medians(views.shoppers(spark, base), ["WarehouseToHome"])
    return spark.createDataFrame([(c, round(m, 6)) for c, m in found.items()], "column string, median double")


@query(
    "mode_impute_fit",
    f"""WITH {V.ACCOUNTS}, c AS (SELECT 'PaymentMethod' AS "column", "PaymentMethod" AS value FROM accounts UNION ALL SELECT 'Contract', "Contract" FROM accounts
        UNION ALL SELECT 'gender', gender FROM accounts),
      n AS (SELECT "column", value, row_number() OVER (PARTITION BY "column" ORDER BY count(*) DESC, value) AS r FROM c WHERE value IS NOT NULL GROUP BY 1, 2)
    SELECT "column", value AS mode FROM n WHERE r = 1""",
)
def mode_impute_fit(spark: SparkSession, base: str) -> DataFrame:
    found = encode.mode_impute_fit(views.accounts(spark, base), ["PaymentMethod", "Contract", "gender"])
    return spark.createDataFrame(list(found.items()), "column string, mode string")


@query(
    "fill_na",
    f"""WITH {V.ACCOUNTS}, s AS (SELECT median(total_num) AS m FROM accounts),
      p AS (SELECT "PaymentMethod" AS v FROM accounts WHERE v IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, v LIMIT 1)
    SELECT "customerID", round(coalesce(total_num, s.m), 6) AS "TotalCharges", coalesce("PaymentMethod", p.v) AS "PaymentMethod" FROM accounts, s, p""",
)
def fill_na(spark: SparkSession, base: str) -> DataFrame:
    df = clean.coerce_numeric(views.accounts(spark, base), ["TotalCharges"]).select(ID, "TotalCharges", "PaymentMethod")
    stats = encode.median_impute_fit(df, ["TotalCharges"]) | encode.mode_impute_fit(df, ["PaymentMethod"])
    return encode.fill_na(df, stats).withColumn("TotalCharges", F.round("TotalCharges", 6))


@query(
    "standardize_fit",
    f"""WITH {V.ACCOUNTS} SELECT 'tenure' AS "column", round(avg(tenure), 6) AS mean, round(stddev_pop(tenure), 6) AS std FROM accounts
    UNION ALL SELECT 'MonthlyCharges', round(avg("MonthlyCharges"), 6), round(stddev_pop("MonthlyCharges"), 6) FROM accounts
    UNION ALL SELECT 'TotalCharges', round(avg(total_num), 6), round(stddev_pop(total_num), 6) FROM accounts""",
)
def standardize_fit(spark: SparkSession, base: str) -> DataFrame:
    df = clean.coerce_numeric(views.accounts(spark, base), ["TotalCharges"])
    found = profile.moments(df, ["tenure", "MonthlyCharges", "TotalCharges"])
    return spark.createDataFrame([(c, round(m, 6), round(s, 6)) for c, (m, s) in found.items()], "column string, mean double, std double")


@query(
    "standardize",
    f"""WITH {V.ACCOUNTS}, s AS (SELECT avg(tenure) AS m1, stddev_pop(tenure) AS s1, avg("MonthlyCharges") AS m2, stddev_pop("MonthlyCharges") AS s2 FROM accounts)
    SELECT "customerID", round((tenure - m1) / s1, 6) AS tenure, round(("MonthlyCharges" - m2) / s2, 6) AS "MonthlyCharges" FROM accounts, s""",
)
def standardize(spark: SparkSession, base: str) -> DataFrame:
    df = views.accounts(spark, base).select(ID, "tenure", "MonthlyCharges")
    cols = ["tenure", "MonthlyCharges"]
    scaled = encode.standardize_columns(df, profile.moments(df, cols))
    return scaled.withColumns({c: F.round(c, 6) for c in cols})


@query(
    "join_stats_broadcast",
    f"""WITH {V.CLIENTS}, s AS (SELECT avg("Balance") AS m, stddev_pop("Balance") AS s FROM clients)
    SELECT "CustomerId", round(("Balance" - m) / s, 6) AS balance_z FROM clients, s""",
)
def join_stats_broadcast(spark: SparkSession, base: str) -> DataFrame:
    df = views.clients(spark, base)
    mean, std = profile.moments(df, ["Balance"])["Balance"]
    return df.select("CustomerId", F.round(encode.standardize(F.col("Balance"), mean, std), 6).alias("balance_z"))


@query(
    "levels_fit",
    f"""WITH {V.ACCOUNTS} SELECT 'Contract' AS "column", string_agg(DISTINCT "Contract", ';' ORDER BY "Contract") AS levels FROM accounts
    UNION ALL SELECT 'InternetService', string_agg(DISTINCT "InternetService", ';' ORDER BY "InternetService") FROM accounts
    UNION ALL SELECT 'PaymentMethod', string_agg(DISTINCT "PaymentMethod", ';' ORDER BY "PaymentMethod") FROM accounts""",
)
def levels_fit(spark: SparkSession, base: str) -> DataFrame:
    found = profile.levels(views.accounts(spark, base), ["Contract", "InternetService", "PaymentMethod"])
    return spark.createDataFrame([(c, ";".join(v)) for c, v in found.items()], "column string, levels string")


@query(
    "levels_wide",
    f"""WITH {V.ACCOUNTS}, l AS (SELECT DISTINCT "customerID" AS value FROM accounts) SELECT 'customerID' AS "column", value, row_number() OVER (ORDER BY value) - 1 AS index FROM l""",
)
def levels_wide(spark: SparkSession, base: str) -> DataFrame:
    """The index of a column with a level per account, which stays a table."""
    return encode.level_index(views.accounts(spark, base), [ID]).select("column", "value", "index")


@query(
    "onehot_wide",
    f"""WITH {V.ACCOUNTS}, l AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS i, count(*) OVER () AS k FROM (SELECT DISTINCT "customerID" AS value FROM accounts))
    SELECT "customerID", k - 1 AS size, CASE WHEN i > 0 THEN i - 1 ELSE -1 END AS place FROM accounts JOIN l ON value = "customerID\"""",
)
def onehot_wide(spark: SparkSession, base: str) -> DataFrame:
    """Sparse vectors of that column: their size, and the place of the one in them."""
    df = views.accounts(spark, base).select(ID)
    index = encode.level_index(df, [ID])
    vectors = encode.sparse_onehot(df, index, {ID: index.count()})
    shown = F.udf(lambda v: (v.size, int(v.indices[0]) if len(v.indices) else -1), "size bigint, place bigint")
    return vectors.select(ID, shown(f"{ID}_levels").alias("v")).select(ID, "v.size", "v.place")


@query(
    "onehot_encode",
    f"""WITH {V.ACCOUNTS} SELECT "customerID", ("InternetService" = 'Fiber optic')::INTEGER::DOUBLE AS "InternetService_Fiber optic",
      ("InternetService" = 'No')::INTEGER::DOUBLE AS "InternetService_No", ("Contract" = 'One year')::INTEGER::DOUBLE AS "Contract_One year",
      ("Contract" = 'Two year')::INTEGER::DOUBLE AS "Contract_Two year", coalesce("PaymentMethod" = 'Credit card (automatic)', false)::INTEGER::DOUBLE AS "PaymentMethod_Credit card (automatic)",
      coalesce("PaymentMethod" = 'Electronic check', false)::INTEGER::DOUBLE AS "PaymentMethod_Electronic check",
      coalesce("PaymentMethod" = 'Mailed check', false)::INTEGER::DOUBLE AS "PaymentMethod_Mailed check" FROM accounts""",
)
def onehot_encode(spark: SparkSession, base: str) -> DataFrame:
    df = views.accounts(spark, base).select(ID, "InternetService", "Contract", "PaymentMethod")
    return encode.onehot_encode(df, profile.levels(df, ["InternetService", "Contract", "PaymentMethod"]))


_SIX = ("OnlineSecurity", "OnlineBackup", "DeviceProtection", "TechSupport", "StreamingTV", "StreamingMovies")


@query(
    "total_services",
    f"""WITH {V.ACCOUNTS} SELECT "customerID", ({" + ".join(f'''("{s}" = 'Yes')::INTEGER''' for s in _SIX)})::DOUBLE AS total_services FROM accounts""",
)
def total_services(spark: SparkSession, base: str) -> DataFrame:
    df = views.accounts(spark, base).select(ID, *_SIX)
    return encode.add_total_services(encode.onehot_encode(df, profile.levels(df, list(_SIX)))).select(ID, "total_services")


_NOT_ID = [c for c in ("tenure", "MonthlyCharges", "TotalCharges", "InternetService_Fiber optic", "InternetService_No", "Contract_One year", "Contract_Two year")]


@query(
    "fitted_preparation",
    f"""WITH {V.ACCOUNTS}, m AS (SELECT median(total_num) AS t FROM accounts),
      x AS (SELECT "customerID", tenure::DOUBLE AS a, "MonthlyCharges" AS b, coalesce(total_num, t) AS c, ("InternetService" = 'Fiber optic')::INTEGER AS d,
        ("InternetService" = 'No')::INTEGER AS e, ("Contract" = 'One year')::INTEGER AS f, ("Contract" = 'Two year')::INTEGER AS g FROM accounts, m)
    SELECT "customerID", {", ".join(f'round(({k} - avg({k}) OVER ()) / stddev_pop({k}) OVER (), 6) AS "{n}"' for k, n in zip("abcdefg", _NOT_ID))} FROM x""",
)
def fitted_preparation(spark: SparkSession, base: str) -> DataFrame:
    df = views.accounts(spark, base).select(ID, "tenure", "MonthlyCharges", "TotalCharges", "InternetService", "Contract", "Churn")
    prep = encode.fit_preparation(df, target="Churn", drop=[ID])
    return prep.transform(df, keep=[ID]).withColumns({c: F.round(ref(c), 6) for c in prep.features})


def _flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


@query(
    "feat_telecom",
    f"""WITH {V.ACCOUNTS} SELECT "customerID", {_flag("gender = 'Male'")} AS gender, "SeniorCitizen"::DOUBLE AS "SeniorCitizen", {_flag('''"Partner" = 'Yes' ''')} AS "Partner",
      {_flag('''"Dependents" = 'Yes' ''')} AS "Dependents", tenure::DOUBLE AS tenure, {_flag('''"PhoneService" = 'Yes' ''')} AS "PhoneService",
      CASE "MultipleLines" WHEN 'No' THEN 1.0::DOUBLE WHEN 'Yes' THEN 2.0::DOUBLE ELSE 0.0::DOUBLE END AS "MultipleLines", {_flag('''"PaperlessBilling" = 'Yes' ''')} AS "PaperlessBilling",
      "MonthlyCharges", round("MonthlyCharges" * tenure, 6) AS "TotalCharges", {_flag('''"InternetService" = 'Fiber optic' ''')} AS "InternetService_Fiber optic",
      {_flag('''"InternetService" = 'No' ''')} AS "InternetService_No", {_flag('''"Contract" = 'One year' ''')} AS "Contract_One year", {_flag('''"Contract" = 'Two year' ''')} AS "Contract_Two year",
      {_flag('''coalesce("PaymentMethod", 'Electronic check') = 'Electronic check' ''')} AS "PaymentMethod_Electronic check", {_flag('''"PaymentMethod" = 'Mailed check' ''')} AS "PaymentMethod_Mailed check",
      {_flag('''"PaymentMethod" = 'Credit card (automatic)' ''')} AS "PaymentMethod_Credit card (automatic)",
      {", ".join(_flag(f'''"{s}" = '{v}' ''') + f' AS "{s}_{v}"' for s in _SIX for v in ("No internet service", "Yes"))},
      ({" + ".join(f'''("{s}" = 'Yes')::INTEGER''' for s in _SIX)})::DOUBLE AS total_services FROM accounts""",
)
def feat_telecom(spark: SparkSession, base: str) -> DataFrame:
    df = views.accounts(spark, base)
    df = df.withColumn("TotalCharges", F.round(serve.derive_total(F.col("MonthlyCharges"), F.col("tenure")), 6))
    return serve.feat_telecom(df, keep=[ID])


@query(
    "feat_banking",
    f"""WITH {V.CLIENTS}, r AS (SELECT *, CASE "Geography" WHEN 'ASIA' THEN 'Spain' WHEN 'EUROPE' THEN 'Germany' ELSE 'France' END AS g FROM clients)
    SELECT "CustomerId", "CreditScore", "Age", "Tenure", "Balance", "NumOfProducts"::DOUBLE AS "NumOfProducts", "HasCrCard"::DOUBLE AS "HasCrCard",
      "IsActiveMember"::DOUBLE AS "IsActiveMember", "EstimatedSalary", {_flag("g = 'Germany'")} AS "Geography_Germany", {_flag("g = 'Spain'")} AS "Geography_Spain",
      {_flag('''"Gender" = 'Male' ''')} AS "Gender_Male" FROM r""",
)
def feat_banking(spark: SparkSession, base: str) -> DataFrame:
    country = F.when(F.col("Geography") == "ASIA", "Spain").when(F.col("Geography") == "EUROPE", "Germany").otherwise("France")
    return serve.feat_banking(views.clients(spark, base).withColumn("Geography", country), keep=["CustomerId"])


@query(
    "feat_ecommerce",
    f"""WITH {V.SHOPPERS} SELECT "CustomerID", "Tenure", "CityTier"::DOUBLE AS "CityTier", coalesce("WarehouseToHome", 20) AS "WarehouseToHome",
      coalesce("HourSpendOnApp", 3) AS "HourSpendOnApp", "NumberOfDeviceRegistered"::DOUBLE AS "NumberOfDeviceRegistered", "SatisfactionScore"::DOUBLE AS "SatisfactionScore",
      "NumberOfAddress"::DOUBLE AS "NumberOfAddress", "Complain"::DOUBLE AS "Complain", "OrderAmountHikeFromlastYear", "CouponUsed", "OrderCount", "DaySinceLastOrder", "CashbackAmount",
      {", ".join(_flag(f"\"{f}\" = '{v}'") + f' AS "{f}_{v}"' for f, vs in serve.ECOMMERCE_LEVELS.items() for v in vs)} FROM shoppers""",
)
def feat_ecommerce(spark: SparkSession, base: str) -> DataFrame:
    return serve.feat_ecommerce(views.shoppers(spark, base), keep=["CustomerID"])
