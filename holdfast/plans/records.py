"""Prediction history, users, alerts and revenue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import parse_money
from ..operators import daily, history, revenue
from ..session import scratch_path
from ..sources import accounts, versions, views
from . import oracle_views as V
from .dashboards import ALL_VIEWS, stacked
from .registry import query

_AT = "strftime(created_at, '%Y-%m-%d %H:%M:%S')"


def _stamp(name: str = "created_at"):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


@query(
    "snk_append_prediction",
    f"""WITH {V.ACCOUNTS}, {V.RULE_SCORE} SELECT "customerID", score::DOUBLE AS churn_probability, printf('%.2f', score::DOUBLE * 100) || '%' AS probability_text,
      CASE WHEN score > 0.5 THEN 'CHURN' ELSE 'STAY' END AS prediction,
      CASE WHEN score > 0.65 THEN 'High Risk' WHEN score > 0.4 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_level, '2024-02-01' AS date, '10:30' AS time FROM scored""",
)
def snk_append_prediction(spark: SparkSession, base: str) -> DataFrame:
    from ..functions.rules import rule_score
    from ..sources.writers import append_log

    df = views.accounts(spark, base)
    scored = df.select("customerID", rule_score(df.columns).cast("double").alias("p")).withColumn("pred", F.col("p") > 0.5)
    entries = history.log_entries(scored, "p", "pred", ["customerID"], now=F.lit("2024-02-01 10:30:00").cast("timestamp_ntz"))
    path = scratch_path(spark, "log")
    append_log(entries, path)
    return spark.read.parquet(path).select(
        "customerID", "churn_probability", "probability_text", "prediction", "risk_level", F.col("date").cast("string").alias("date"), "time"
    )


@query(
    "filter_user",
    f"""WITH {V.PREDICTIONS} SELECT id, username, {_AT} AS created_at FROM predictions WHERE user_id = 7""",
)
def filter_user(spark: SparkSession, base: str) -> DataFrame:
    return history.filter_user(views.predictions(spark, base), 7).select("id", "username", _stamp())


@query(
    "filter_history",
    f"""WITH {V.PREDICTIONS} SELECT id, date, time, prediction, risk_level FROM predictions WHERE prediction = 'CHURN' AND risk_level = 'High Risk'""",
)
def filter_history(spark: SparkSession, base: str) -> DataFrame:
    return history.filter_history(views.predictions(spark, base), "CHURN", "High Risk").select("id", "date", "time", "prediction", "risk_level")


@query(
    "order_recent",
    f"""WITH {V.PREDICTIONS} SELECT id, user_id, {_AT} AS created_at FROM predictions ORDER BY predictions.created_at DESC, id DESC""",
)
def order_recent(spark: SparkSession, base: str) -> DataFrame:
    return history.order_recent(views.predictions(spark, base)).select("id", "user_id", _stamp())


@query(
    "history_summary",
    f"""WITH {V.PREDICTIONS} SELECT user_id, count(*) AS total, count(*) FILTER (prediction = 'CHURN') AS churn, count(*) FILTER (prediction = 'STAY') AS stay,
      count(*) FILTER (risk_level = 'High Risk') AS high_risk FROM predictions GROUP BY 1""",
)
def history_summary(spark: SparkSession, base: str) -> DataFrame:
    return history.history_summary(views.predictions(spark, base))


@query(
    "history_summary_daily",
    f"""WITH {V.PREDICTIONS} SELECT user_id, count(*) AS total, count(*) FILTER (prediction = 'CHURN') AS churn, count(*) FILTER (prediction = 'STAY') AS stay,
      count(*) FILTER (risk_level = 'High Risk') AS high_risk FROM predictions GROUP BY 1""",
)
def history_summary_daily(spark: SparkSession, base: str) -> DataFrame:
    """The same from stored parts of each day."""
    path = scratch_path(spark, "day-counts")
    parts = daily.day_counts(views.predictions(spark, base).withColumn("date", F.date_format("created_at", "yyyy-MM-dd")))
    daily.store_days(parts, path)
    return daily.total_counts(daily.stored_days(spark, path, parts.schema))


@query(
    "describe_daily",
    f"""WITH {V.PREDICTIONS}, c AS (SELECT churn_probability AS p, replace(replace(monthly_charges, '$', ''), ',', '')::DOUBLE AS m FROM predictions)
    SELECT 'churn_probability' AS "column", count(p) AS n, round(avg(p), 9) AS mean, min(p) AS low, max(p) AS high, true AS near FROM c
    UNION ALL SELECT 'monthly_charges', count(m), round(avg(m), 9), min(m), max(m), true FROM c""",
)
def describe_daily(spark: SparkSession, base: str) -> DataFrame:
    """Statistics merged from the sketches of each day; `near` says whether the median's rank is within 1 %."""
    columns = ["churn_probability", "monthly_charges"]
    log = views.predictions(spark, base).withColumn("date", F.date_format("created_at", "yyyy-MM-dd")).withColumn("monthly_charges", parse_money(F.col("monthly_charges")))
    path = scratch_path(spark, "day-sketches")
    parts = daily.day_sketches(log, columns)
    daily.store_days(parts, path)
    found = daily.total_stats(daily.stored_days(spark, path, parts.schema))
    values = log.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("p")).select("p.*")
    ranks = values.join(F.broadcast(found.select("column", "q50")), "column").groupBy("column").agg(
        F.avg((F.col("value") < F.col("q50")).cast("double")).alias("below"), F.avg((F.col("value") <= F.col("q50")).cast("double")).alias("upto")
    )
    near = (F.col("below") <= 0.51) & (F.col("upto") >= 0.49)
    return found.join(ranks, "column").select("column", "n", F.round("mean", 9).alias("mean"), "low", "high", near.alias("near"))


@query(
    "admin_summary",
    f"""WITH {V.PREDICTIONS}, {V.USERS} SELECT (SELECT count(*) FROM users) AS users, count(*) AS predictions, count(*) FILTER (prediction = 'CHURN') AS churn,
      count(*) FILTER (prediction <> 'CHURN') AS stay FROM predictions""",
)
def admin_summary(spark: SparkSession, base: str) -> DataFrame:
    return history.admin_summary(views.users(spark, base), views.predictions(spark, base))


@query("src_users", f"WITH {V.USERS} SELECT id, full_name, email, username, role, {_AT} AS created_at FROM users")
def src_users(spark: SparkSession, base: str) -> DataFrame:
    return views.users(spark, base).select("id", "full_name", "email", "username", "role", _stamp())


@query("src_predictions", f"WITH {V.PREDICTIONS} SELECT id, user_id, tenure, monthly_charges, contract, internet, probability_text, prediction, risk_level FROM predictions")
def src_predictions(spark: SparkSession, base: str) -> DataFrame:
    return views.predictions(spark, base).select(
        "id", "user_id", "tenure", "monthly_charges", "contract", "internet", "probability_text", "prediction", "risk_level"
    )


@query(
    "join_user_predictions",
    f"""WITH {V.PREDICTIONS}, {V.USERS} SELECT u.id AS user_id, u.email AS user_email, coalesce(p.id, -1) AS id, p.prediction FROM users u
    LEFT JOIN predictions p ON p.user_id = u.id""",
)
def join_user_predictions(spark: SparkSession, base: str) -> DataFrame:
    joined = history.join_user_predictions(views.users(spark, base), views.predictions(spark, base))
    return joined.select("user_id", "user_email", F.coalesce("id", F.lit(-1)).alias("id"), "prediction")


def _deleted(spark: SparkSession, base: str) -> DataFrame:
    """Users whose log holds no high-risk entry."""
    high = F.count_if(F.col("risk_level") == "High Risk")
    return views.predictions(spark, base).groupBy("user_id").agg(high.alias("h")).filter("h < 4").select("user_id")


@query(
    "cascade_delete",
    f"""WITH {V.PREDICTIONS}, {V.USERS}, d AS (SELECT user_id FROM predictions GROUP BY 1 HAVING count(*) FILTER (risk_level = 'High Risk') < 4)
    SELECT 'users' AS "table", id, id AS user_id FROM users WHERE id NOT IN (SELECT user_id FROM d)
    UNION ALL SELECT 'predictions', id, user_id FROM predictions WHERE user_id NOT IN (SELECT user_id FROM d)""",
)
def cascade_delete(spark: SparkSession, base: str) -> DataFrame:
    users, log = history.cascade_delete(views.users(spark, base), views.predictions(spark, base), _deleted(spark, base))
    left = users.select(F.lit("users").alias("table"), "id", F.col("id").alias("user_id"))
    return left.unionByName(log.select(F.lit("predictions").alias("table"), "id", "user_id"))


@query(
    "delete_users_stored",
    f"""WITH {V.PREDICTIONS}, {V.USERS}, d AS (SELECT user_id FROM predictions GROUP BY 1 HAVING count(*) FILTER (risk_level = 'High Risk') < 4)
    SELECT 2 AS version, 'users' AS "table", id, id AS user_id FROM users WHERE id NOT IN (SELECT user_id FROM d)
    UNION ALL SELECT 2, 'predictions', id, user_id FROM predictions WHERE user_id NOT IN (SELECT user_id FROM d)
    UNION ALL SELECT 1, 'users', id, id FROM users UNION ALL SELECT 1, 'predictions', id, user_id FROM predictions""",
)
def delete_users_stored(spark: SparkSession, base: str) -> DataFrame:
    """Users and log as stored before and after a delete that commits both tables."""
    root = scratch_path(spark, "accounts")
    accounts.create(spark, root, views.users(spark, base), views.predictions(spark, base))
    accounts.delete_users(spark, root, _deleted(spark, base))
    out = None
    for version in versions.versions(spark, root):
        for name, user in ((accounts.USERS, "id"), (accounts.LOG, "user_id")):
            rows = versions.read(spark, root, name, version)
            rows = rows.select(F.lit(version).alias("version"), F.lit(name).alias("table"), "id", F.col(user).alias("user_id"))
            out = rows if out is None else out.unionByName(rows)
    return out


@query(
    "touch_last_login",
    f"""WITH {V.USERS}, l AS (SELECT user_id, max(ts) AS at FROM events WHERE event_type = 'signup' GROUP BY 1)
    SELECT id, strftime(greatest(u.created_at, l.at), '%Y-%m-%d %H:%M:%S') AS last_login FROM users u LEFT JOIN l ON l.user_id = u.id""",
)
def touch_last_login(spark: SparkSession, base: str) -> DataFrame:
    fresh = views.users(spark, base).withColumn("last_login", F.col("created_at"))
    logins = views.table(spark, base, "events").filter(F.col("event_type") == "signup")
    return history.touch_last_login(fresh, logins).select("id", _stamp("last_login"))


@query(
    "insert_if_unique",
    f"""WITH RECURSIVE e AS (SELECT event_id AS seq, 'user_' || (event_id % 997) AS username, 'mail_' || event_id || '@example.org' AS email,
        ('user_' || (event_id % 997)) IN (SELECT 'user_' || user_id FROM events WHERE user_id % 2 = 0) AS taken FROM events)
    SELECT min(seq) AS seq, username FROM e WHERE NOT taken GROUP BY username""",
)
def insert_if_unique(spark: SparkSession, base: str) -> DataFrame:
    """Registrations from the event log: many rows per username, one email each."""
    events = views.table(spark, base, "events").select(F.col("event_id").alias("seq"))
    batch = events.select(
        "seq",
        F.concat(F.lit("user_"), (F.col("seq") % 997).cast("string")).alias("username"),
        F.concat(F.lit("mail_"), F.col("seq").cast("string"), F.lit("@example.org")).alias("email"),
    )
    existing = views.users(spark, base).filter(F.col("id") % 2 == 0).select("username", "email")
    return history.insert_if_unique(existing, batch, "seq").select("seq", "username")


@query("filter_alerts", f"WITH {V.PREDICTIONS} SELECT id, user_id, churn_probability FROM predictions WHERE churn_probability >= 0.75")
def filter_alerts(spark: SparkSession, base: str) -> DataFrame:
    return history.filter_alerts(views.predictions(spark, base), "churn_probability", 0.75).select("id", "user_id", "churn_probability")


@query(
    "alert_digest",
    f"""WITH {V.PREDICTIONS} SELECT count(*) AS critical, 0.75::DOUBLE AS threshold, count(*) || ' customers at or above 75% churn probability' AS message
    FROM predictions WHERE churn_probability >= 0.75""",
)
def alert_digest(spark: SparkSession, base: str) -> DataFrame:
    return history.alert_digest(views.predictions(spark, base), "churn_probability", 0.75)


_FLAG = """CASE WHEN "Churn" = 'Yes' THEN 1 ELSE 0 END"""
_IMPACT = f"""stacked AS (SELECT 'telecom' AS industry, {_FLAG} AS churn FROM accounts
    UNION ALL SELECT 'banking', "Exited" FROM clients UNION ALL SELECT 'ecommerce', "Churn" FROM shoppers),
  par(industry, monthly, lifetime, cost, success_rate) AS (VALUES ('telecom', 65::DOUBLE, 24, 25::DOUBLE, 30), ('banking', 150, 36, 25, 30), ('ecommerce', 45, 18, 25, 30)),
  b AS (SELECT industry, count(*) AS n, count(*) FILTER (churn = 1) AS c FROM stacked GROUP BY 1),
  i AS (SELECT industry, n AS total_customers, c AS predicted_churners, monthly, lifetime, cost, success_rate, c * 100.0::DOUBLE / n AS churn_rate_pct, monthly * lifetime AS ltv,
      c * monthly AS monthly_loss, c * monthly * 12 AS annual_loss, c * monthly * lifetime AS lifetime_loss, (c * success_rate) // 100 AS customers_saved,
      ((c * success_rate) // 100) * monthly * lifetime AS revenue_saved, c * cost AS retention_spend FROM b JOIN par USING (industry)),
  impact AS (SELECT *, revenue_saved - retention_spend AS net_benefit,
      CASE WHEN retention_spend > 0 THEN (revenue_saved - retention_spend) / retention_spend * 100 ELSE 0 END AS roi_pct FROM i)"""


def impact(spark: SparkSession, base: str) -> DataFrame:
    return revenue.revenue_impact(stacked(spark, base), "churn", revenue.parameter_table(spark))


@query(
    "revenue_impact",
    f"{ALL_VIEWS}, {_IMPACT} SELECT * REPLACE (round(churn_rate_pct, 6) AS churn_rate_pct, round(roi_pct, 6) AS roi_pct) FROM impact",
)
def revenue_impact(spark: SparkSession, base: str) -> DataFrame:
    return impact(spark, base).withColumns({c: F.round(c, 6) for c in ("churn_rate_pct", "roi_pct")})


@query(
    "projection_12m",
    f"""{ALL_VIEWS}, {_IMPACT} SELECT industry, m::INTEGER AS month, monthly_loss * m AS cumulative_loss, round(revenue_saved * (m / 12.0::DOUBLE), 6) AS cumulative_saved
    FROM impact, range(1, 13) t(m)""",
)
def projection_12m(spark: SparkSession, base: str) -> DataFrame:
    return revenue.projection_12m(impact(spark, base)).withColumn("cumulative_saved", F.round("cumulative_saved", 6))


def _money(column: str) -> str:
    return f"'$' || format('{{:,}}', round_even({column}, 0)::BIGINT)"


@query(
    "melt_kpis",
    f"""{ALL_VIEWS}, {_IMPACT} UNPIVOT (SELECT industry, total_customers::VARCHAR AS "Total customers", predicted_churners::VARCHAR AS "Predicted churners",
      printf('%.1f', churn_rate_pct) || '%' AS "Churn rate", {_money("monthly_loss")} AS "Monthly loss", {_money("annual_loss")} AS "Annual loss",
      {_money("lifetime_loss")} AS "Lifetime loss", customers_saved::VARCHAR AS "Customers saved", {_money("revenue_saved")} AS "Revenue saved",
      {_money("retention_spend")} AS "Campaign cost", {_money("net_benefit")} AS "Net benefit", printf('%.0f', roi_pct) || '%' AS "ROI" FROM impact)
    ON COLUMNS(* EXCLUDE industry) INTO NAME metric VALUE value""",
)
def melt_kpis(spark: SparkSession, base: str) -> DataFrame:
    return revenue.melt_kpis(impact(spark, base))


def _count(column: str) -> str:
    return f"format('{{:,}}', {column}::BIGINT)"


@query(
    "exec_summary",
    f"""{ALL_VIEWS}, {_IMPACT} SELECT industry, concat_ws(chr(10), 'Industry: ' || industry,
      'At risk: ' || {_count("predicted_churners")} || ' of ' || {_count("total_customers")} || ' (' || printf('%.1f', churn_rate_pct) || '%)',
      'Loss per month: ' || {_money("monthly_loss")}, 'Loss per year: ' || {_money("annual_loss")}, 'Lifetime loss: ' || {_money("lifetime_loss")},
      'Can be saved: ' || {_count("customers_saved")} || ' customers, ' || {_money("revenue_saved")}, 'Campaign: ' || {_money("retention_spend")},
      'Net benefit: ' || {_money("net_benefit")} || ', return ' || printf('%.0f', roi_pct) || '%',
      'Advice: ' || CASE WHEN net_benefit > 0 THEN 'Start the retention campaign: it earns more than it costs.' ELSE 'Lower the cost per customer before starting a campaign.' END
    ) AS summary FROM impact""",
)
def exec_summary(spark: SparkSession, base: str) -> DataFrame:
    return revenue.exec_summary(impact(spark, base))
