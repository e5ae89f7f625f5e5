"""The views of ``sources.views`` written a second time, as ANSI SQL for the checking engine."""

ACCOUNTS = """
accounts AS (
  SELECT concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS "customerID",
    CASE WHEN l_partkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS gender,
    CASE WHEN l_suppkey % 5 = 0 THEN 1 ELSE 0 END AS "SeniorCitizen",
    CASE WHEN o_custkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS "Partner",
    CASE WHEN o_custkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS "Dependents",
    l_quantity::INTEGER AS tenure,
    CASE WHEN l_linenumber <> 7 THEN 'Yes' ELSE 'No' END AS "PhoneService",
    CASE WHEN l_linenumber = 7 THEN 'No phone service' WHEN l_linenumber % 2 = 0 THEN 'Yes' ELSE 'No' END AS "MultipleLines",
    net AS "InternetService",
    CASE WHEN net = 'No' THEN 'No internet service' WHEN l_partkey % 3 = 0 THEN 'Yes' ELSE 'No' END AS "OnlineSecurity",
    CASE WHEN net = 'No' THEN 'No internet service' WHEN l_suppkey % 2 = 0 THEN 'Yes' ELSE 'No' END AS "OnlineBackup",
    CASE WHEN net = 'No' THEN 'No internet service' WHEN l_partkey % 5 = 0 THEN 'Yes' ELSE 'No' END AS "DeviceProtection",
    CASE WHEN net = 'No' THEN 'No internet service' WHEN l_partkey % 4 = 0 THEN 'Yes' ELSE 'No' END AS "TechSupport",
    CASE WHEN net = 'No' THEN 'No internet service' WHEN l_linenumber % 2 = 1 THEN 'Yes' ELSE 'No' END AS "StreamingTV",
    CASE WHEN net = 'No' THEN 'No internet service' WHEN l_linenumber % 3 = 0 THEN 'Yes' ELSE 'No' END AS "StreamingMovies",
    CASE l_returnflag WHEN 'N' THEN 'Month-to-month' WHEN 'A' THEN 'One year' WHEN 'R' THEN 'Two year' END AS "Contract",
    CASE WHEN l_discount >= 0.05 THEN 'Yes' ELSE 'No' END AS "PaperlessBilling",
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Electronic check' WHEN '2-HIGH' THEN 'Mailed check'
      WHEN '3-MEDIUM' THEN 'Bank transfer (automatic)' WHEN '4-NOT SPECIFIED' THEN 'Credit card (automatic)' END AS "PaymentMethod",
    l_extendedprice / 1000.0::DOUBLE AS "MonthlyCharges",
    CASE WHEN l_discount = 0 THEN NULL ELSE l_extendedprice / 1000.0::DOUBLE * l_quantity END AS total_num,
    CASE WHEN o_orderstatus = 'F' THEN 'Yes' ELSE 'No' END AS "Churn"
  FROM (SELECT *, CASE WHEN l_linestatus = 'O' AND l_tax < 0.03 THEN 'No'
                       WHEN l_linestatus = 'O' THEN 'Fiber optic' ELSE 'DSL' END AS net FROM lineitem) l
  JOIN orders ON l_orderkey = o_orderkey)"""

CLIENTS = """
clients AS (
  SELECT c_custkey AS "CustomerId", c_name AS "Surname", (350 + c_custkey % 500)::DOUBLE AS "CreditScore",
    r_name AS "Geography", CASE WHEN c_nationkey % 2 = 0 THEN 'Male' ELSE 'Female' END AS "Gender",
    (18 + (c_custkey * 7) % 70)::DOUBLE AS "Age", date_diff('day', f, t)::DOUBLE AS "Tenure", c_acctbal AS "Balance",
    np::INTEGER AS "NumOfProducts", CASE WHEN c_mktsegment IN ('BUILDING', 'AUTOMOBILE') THEN 1 ELSE 0 END AS "HasCrCard",
    CASE WHEN n >= 10 THEN 1 ELSE 0 END AS "IsActiveMember", round(s, 2) AS "EstimatedSalary",
    CASE WHEN date_diff('day', t, (SELECT max(o_orderdate) FROM orders)) > 332 THEN 1 ELSE 0 END AS "Exited",
    c_mktsegment AS "Segment"
  FROM customer
  JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) np, count(*) n, sum(o_totalprice) s,
               min(o_orderdate) f, max(o_orderdate) t FROM orders GROUP BY 1) a ON o_custkey = c_custkey
  JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)"""

SHOPPERS = """
shoppers AS (
  SELECT user_id AS "CustomerID", date_diff('day', f, t)::DOUBLE AS "Tenure",
    (['Mobile Phone', 'Computer', 'Phone'])[user_id % 3 + 1] AS "PreferredLoginDevice",
    (user_id % 3 + 1)::INTEGER AS "CityTier",
    CASE WHEN user_id % 11 <> 0 THEN (user_id % 96 + 5)::DOUBLE END AS "WarehouseToHome",
    (['Debit Card', 'UPI', 'Credit Card', 'Cash on Delivery', 'E wallet', 'CC'])[user_id % 6 + 1] AS "PreferredPaymentMode",
    CASE WHEN user_id % 2 = 0 THEN 'Male' ELSE 'Female' END AS "Gender",
    CASE WHEN user_id % 13 <> 0 THEN (user_id % 7)::DOUBLE END AS "HourSpendOnApp",
    (user_id % 6 + 1)::INTEGER AS "NumberOfDeviceRegistered",
    (['Laptop & Accessory', 'Mobile', 'Mobile Phone', 'Others', 'Fashion', 'Grocery', 'Others'])[user_id % 7 + 1] AS "PreferedOrderCat",
    (user_id % 5 + 1)::INTEGER AS "SatisfactionScore",
    (['Single', 'Married', 'Divorced', 'Married'])[user_id % 4 + 1] AS "MaritalStatus",
    (user_id % 10 + 1)::INTEGER AS "NumberOfAddress",
    CASE WHEN e * 5 > n THEN 1 ELSE 0 END AS "Complain",
    (user_id % 16 + 11)::DOUBLE AS "OrderAmountHikeFromlastYear", c::DOUBLE AS "CouponUsed", p::DOUBLE AS "OrderCount",
    date_diff('day', t, (SELECT max(ts) FROM events))::DOUBLE AS "DaySinceLastOrder", round(b, 2) AS "CashbackAmount",
    CASE WHEN coalesce(date_diff('day', lp, (SELECT max(ts) FROM events)), 999) > 1 THEN 1 ELSE 0 END AS "Churn"
  FROM (SELECT user_id, count(*) n, count(*) FILTER (event_type = 'purchase') p, count(*) FILTER (event_type = 'error') e,
               count(*) FILTER (event_type = 'signup') c, coalesce(sum(value) FILTER (event_type = 'purchase'), 0) b,
               min(ts) f, max(ts) t, max(ts) FILTER (event_type = 'purchase') lp FROM events GROUP BY 1) g)"""

PREDICTIONS = """
predictions AS (
  SELECT event_id AS id, user_id, 'user_' || user_id AS username, ts AS created_at,
    strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H:%M') AS time,
    (event_id % 72 + 1) || ' months' AS tenure, '$' || (event_id % 103 + 18) AS monthly_charges,
    (['Month-to-month', 'One year', 'Two year'])[event_id % 3 + 1] AS contract,
    (['DSL', 'Fiber optic', 'No', 'DSL'])[event_id % 4 + 1] AS internet,
    p AS churn_probability, printf('%.2f', p * 100) || '%' AS probability_text,
    CASE WHEN p > 0.5 THEN 'CHURN' ELSE 'STAY' END AS prediction,
    CASE WHEN p > 0.65 THEN 'High Risk' WHEN p > 0.4 THEN 'Medium Risk' ELSE 'Low Risk' END AS risk_level
  FROM (SELECT *, least(value / 200.0::DOUBLE, 1.0::DOUBLE) AS p FROM events) e)"""

USERS = """
users AS (
  SELECT user_id AS id, 'User ' || user_id AS full_name, 'user_' || user_id || '@example.org' AS email,
    'user_' || user_id AS username, CASE WHEN user_id = 0 THEN 'admin' ELSE 'user' END AS role,
    min(ts) AS created_at, max(ts) AS last_login
  FROM events GROUP BY user_id)"""

SCORES = """
scores AS (
  SELECT d.doc_id AS id, n_chars::DOUBLE AS score, quality AS label FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""

BY_MODEL = (
    SCORES
    + """,
raw_models AS (
  SELECT id, label, score / (score + 1000.0::DOUBLE) AS length,
    ('0x' || substr(md5(id || '|7'), 1, 8))::UBIGINT / 4294967296.0::DOUBLE AS noise FROM scores),
by_model AS (
  SELECT 'length' AS model, id, label, length AS score FROM raw_models
  UNION ALL SELECT 'noise', id, label, noise FROM raw_models
  UNION ALL SELECT 'blend', id, label, (length + noise) / 2.0::DOUBLE FROM raw_models),
predictions_by_model AS (SELECT *, CASE WHEN score > 0.5 THEN 1 ELSE 0 END AS pred FROM by_model)"""
)

RULE_SCORE = """
scored AS (
  SELECT *, least(0.97, greatest(0.03, 0.35
      + CASE "Contract" WHEN 'Month-to-month' THEN 0.25 WHEN 'Two year' THEN -0.20 ELSE 0.00 END
      + CASE WHEN tenure < 6 THEN 0.20 WHEN tenure > 36 THEN -0.15 ELSE 0.00 END
      + CASE WHEN "MonthlyCharges" > 80 THEN 0.10 WHEN "MonthlyCharges" < 40 THEN -0.10 ELSE 0.00 END
      + CASE WHEN "InternetService" = 'Fiber optic' THEN 0.08 ELSE 0.00 END))::DECIMAL(4,2) AS score
  FROM accounts)"""
