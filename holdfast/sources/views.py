"""Tables of the shapes the operators expect, derived from a star schema with an event log.

Only column expressions and joins whose strategy is left to the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.risk import risk_label
from ..functions.hashing import uniform
from ..functions.text import format_percent


def table(spark: SparkSession, base: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{base}/{name}.parquet")


def _yes_no(condition: Column) -> Column:
    return F.when(condition, F.lit("Yes")).otherwise(F.lit("No"))


def _pick(number: Column, *levels: str) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in levels]), (F.pmod(number, F.lit(len(levels))) + 1).cast("int"))


def accounts(spark: SparkSession, base: str) -> DataFrame:
    """Telecom-shaped subscribers: one per order line."""
    line = table(spark, base, "lineitem").alias("l")
    order = table(spark, base, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").alias("o")
    j = line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
    monthly = F.col("l_extendedprice") / F.lit(1000.0)
    internet = (
        F.when((F.col("l_linestatus") == "O") & (F.col("l_tax") < 0.03), "No").when(F.col("l_linestatus") == "O", "Fiber optic").otherwise("DSL")
    )
    offline = F.col("InternetService") == "No"

    def service(condition: Column) -> Column:
        return F.when(offline, F.lit("No internet service")).otherwise(_yes_no(condition))

    part, supp, number = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    return (
        j.withColumn("InternetService", internet)
        .withColumn("MonthlyCharges", monthly)
        .select(
            F.concat_ws("|", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("customerID"),
            F.when(part % 2 == 0, "Male").otherwise("Female").alias("gender"),
            F.when(supp % 5 == 0, 1).otherwise(0).alias("SeniorCitizen"),
            _yes_no(F.col("o_custkey") % 2 == 0).alias("Partner"),
            _yes_no(F.col("o_custkey") % 3 == 0).alias("Dependents"),
            F.col("l_quantity").cast("int").alias("tenure"),
            _yes_no(number != 7).alias("PhoneService"),
            F.when(number == 7, "No phone service").otherwise(_yes_no(number % 2 == 0)).alias("MultipleLines"),
            "InternetService",
            service(part % 3 == 0).alias("OnlineSecurity"),
            service(supp % 2 == 0).alias("OnlineBackup"),
            service(part % 5 == 0).alias("DeviceProtection"),
            service(part % 4 == 0).alias("TechSupport"),
            service(number % 2 == 1).alias("StreamingTV"),
            service(number % 3 == 0).alias("StreamingMovies"),
            F.when(F.col("l_returnflag") == "N", "Month-to-month")
            .when(F.col("l_returnflag") == "A", "One year")
            .when(F.col("l_returnflag") == "R", "Two year")
            .alias("Contract"),
            _yes_no(F.col("l_discount") >= 0.05).alias("PaperlessBilling"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "Electronic check")
            .when(F.col("o_orderpriority") == "2-HIGH", "Mailed check")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "Bank transfer (automatic)")
            .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "Credit card (automatic)")
            .alias("PaymentMethod"),
            "MonthlyCharges",
            F.when(F.col("l_discount") == 0, F.lit(" "))
            .otherwise((F.col("MonthlyCharges") * F.col("l_quantity")).cast("string"))
            .alias("TotalCharges"),
            _yes_no(F.col("o_orderstatus") == "F").alias("Churn"),
        )
    )


def clients(spark: SparkSession, base: str) -> DataFrame:
    """Banking-shaped clients: customers with at least one order."""
    orders = table(spark, base, "orders")
    per_customer = orders.groupBy("o_custkey").agg(
        F.count_distinct("o_orderpriority").cast("int").alias("NumOfProducts"),
        F.count("*").alias("n_orders"),
        F.sum("o_totalprice").alias("spend"),
        F.min("o_orderdate").alias("first_order"),
        F.max("o_orderdate").alias("last_order"),
    )
    latest = orders.agg(F.max("o_orderdate")).scalar()
    nation = table(spark, base, "nation")
    region = table(spark, base, "region")
    key = F.col("c_custkey")
    return (
        table(spark, base, "customer")
        .join(per_customer, F.col("c_custkey") == F.col("o_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select(
            key.alias("CustomerId"),
            F.col("c_name").alias("Surname"),
            (F.lit(350) + key % 500).cast("double").alias("CreditScore"),
            F.col("r_name").alias("Geography"),
            F.when(F.col("c_nationkey") % 2 == 0, "Male").otherwise("Female").alias("Gender"),
            (F.lit(18) + (key * 7) % 70).cast("double").alias("Age"),
            F.datediff("last_order", "first_order").cast("double").alias("Tenure"),
            F.col("c_acctbal").alias("Balance"),
            "NumOfProducts",
            F.when(F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE"), 1).otherwise(0).alias("HasCrCard"),
            F.when(F.col("n_orders") >= 10, 1).otherwise(0).alias("IsActiveMember"),
            F.round("spend", 2).alias("EstimatedSalary"),
            F.when(F.datediff(latest, "last_order") > 332, 1).otherwise(0).alias("Exited"),
            F.col("c_mktsegment").alias("Segment"),
        )
    )


def shoppers(spark: SparkSession, base: str) -> DataFrame:
    """E-commerce-shaped shoppers: one per user of the event log."""
    events = table(spark, base, "events")
    bought = F.col("event_type") == "purchase"
    per_user = events.groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.count_if(bought).alias("purchases"),
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count_if(F.col("event_type") == "signup").alias("coupons"),
        F.coalesce(F.sum(F.when(bought, F.col("value"))), F.lit(0.0)).alias("bought"),
        F.min("ts").alias("first_seen"),
        F.max("ts").alias("last_seen"),
        F.max(F.when(bought, F.col("ts"))).alias("last_purchase"),
    )
    latest = events.agg(F.max("ts")).scalar()
    u = F.col("user_id")
    return per_user.select(
        u.alias("CustomerID"),
        F.datediff("last_seen", "first_seen").cast("double").alias("Tenure"),
        _pick(u, "Mobile Phone", "Computer", "Phone").alias("PreferredLoginDevice"),
        (u % 3 + 1).cast("int").alias("CityTier"),
        F.when(u % 11 != 0, (u % 96 + 5).cast("double")).alias("WarehouseToHome"),
        _pick(u, "Debit Card", "UPI", "Credit Card", "Cash on Delivery", "E wallet", "CC").alias("PreferredPaymentMode"),
        F.when(u % 2 == 0, "Male").otherwise("Female").alias("Gender"),
        F.when(u % 13 != 0, (u % 7).cast("double")).alias("HourSpendOnApp"),
        (u % 6 + 1).cast("int").alias("NumberOfDeviceRegistered"),
        _pick(u, "Laptop & Accessory", "Mobile", "Mobile Phone", "Others", "Fashion", "Grocery", "Others").alias("PreferedOrderCat"),
        (u % 5 + 1).cast("int").alias("SatisfactionScore"),
        _pick(u, "Single", "Married", "Divorced", "Married").alias("MaritalStatus"),
        (u % 10 + 1).cast("int").alias("NumberOfAddress"),
        F.when(F.col("errors") * 5 > F.col("n"), 1).otherwise(0).alias("Complain"),
        (u % 16 + 11).cast("double").alias("OrderAmountHikeFromlastYear"),
        F.col("coupons").cast("double").alias("CouponUsed"),
        F.col("purchases").cast("double").alias("OrderCount"),
        F.datediff(latest, "last_seen").cast("double").alias("DaySinceLastOrder"),
        F.round("bought", 2).alias("CashbackAmount"),
        F.when(F.coalesce(F.datediff(latest, "last_purchase"), F.lit(999)) > 1, 1).otherwise(0).alias("Churn"),
    )


def predictions(spark: SparkSession, base: str) -> DataFrame:
    return predictions_of(table(spark, base, "events"))


def predictions_of(events: DataFrame) -> DataFrame:
    """Prediction log: one entry per event.  Also works on a stream of events."""
    prob = F.least(F.col("value") / F.lit(200.0), F.lit(1.0))
    e = F.col("event_id")
    return events.withColumn("p", prob).select(
        e.alias("id"),
        "user_id",
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("username"),
        F.col("ts").alias("created_at"),
        F.date_format("ts", "yyyy-MM-dd").alias("date"),
        F.date_format("ts", "HH:mm").alias("time"),
        F.concat((e % 72 + 1).cast("string"), F.lit(" months")).alias("tenure"),
        F.concat(F.lit("$"), (e % 103 + 18).cast("string")).alias("monthly_charges"),
        _pick(e, "Month-to-month", "One year", "Two year").alias("contract"),
        _pick(e, "DSL", "Fiber optic", "No", "DSL").alias("internet"),
        F.col("p").alias("churn_probability"),
        format_percent(F.col("p"), 2).alias("probability_text"),
        F.when(F.col("p") > 0.5, "CHURN").otherwise("STAY").alias("prediction"),
        risk_label(F.col("p")).alias("risk_level"),
    )


def users(spark: SparkSession, base: str) -> DataFrame:
    events = table(spark, base, "events")
    name = F.concat(F.lit("user_"), F.col("user_id").cast("string"))
    return events.groupBy("user_id").agg(F.min("ts").alias("created_at"), F.max("ts").alias("last_login")).select(
        F.col("user_id").alias("id"),
        F.concat(F.lit("User "), F.col("user_id").cast("string")).alias("full_name"),
        F.concat(name, F.lit("@example.org")).alias("email"),
        name.alias("username"),
        F.when(F.col("user_id") == 0, "admin").otherwise("user").alias("role"),
        "created_at",
        "last_login",
    )


def scores(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select("doc_id", "n_chars")
    labels = table(spark, base, "labels").select("doc_id", "quality")
    return docs.join(labels, "doc_id").select(
        F.col("doc_id").alias("id"), F.col("n_chars").cast("double").alias("score"), F.col("quality").alias("label")
    )


def predictions_by_model(spark: SparkSession, base: str) -> DataFrame:
    """Three score transforms stand for three models; long form without a second scan."""
    s = scores(spark, base)
    length = F.col("score") / (F.col("score") + F.lit(1000.0))
    noise = uniform(F.col("id").cast("string"), 7)
    wide = s.select("id", "label", length.alias("length"), noise.alias("noise"), ((length + noise) / F.lit(2.0)).alias("blend"))
    return wide.unpivot(["id", "label"], ["length", "noise", "blend"], "model", "score").withColumn(
        "pred", F.when(F.col("score") > 0.5, 1).otherwise(0)
    )
