"""Prediction log, users and alerts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import RISK_LABELS
from ..functions.risk import prediction_text, risk_label
from ..functions.text import format_percent, ref
from ..session import materialised

# Columns of the log shown to a user.
HISTORY_COLUMNS = ("date", "time", "tenure", "monthly_charges", "contract", "internet", "churn_probability", "prediction", "risk_level")


def log_entries(
    df: DataFrame, prob: str, pred: str, columns: Sequence[str] = (), risk: Column | None = None, now: Column | None = None
) -> DataFrame:
    """Scored rows in the shape of the prediction log; numbers stay numbers beside their text."""
    stamp = F.current_timestamp() if now is None else now
    p = ref(prob).cast("double")
    return df.select(
        *[ref(c) for c in columns],
        stamp.alias("created_at"),
        F.date_format(stamp, "yyyy-MM-dd").alias("date"),
        F.date_format(stamp, "HH:mm").alias("time"),
        p.alias("churn_probability"),
        format_percent(p, 2).alias("probability_text"),
        prediction_text(ref(pred), "CHURN", "STAY").alias("prediction"),
        (risk_label(p) if risk is None else risk).alias("risk_level"),
    )


def filter_user(log: DataFrame, user_id: int) -> DataFrame:
    return log.filter(F.col("user_id") == F.lit(user_id))


def filter_history(log: DataFrame, prediction: str = "All", risk: str = "All") -> DataFrame:
    out = log
    if prediction != "All":
        out = out.filter(F.col("prediction") == prediction)
    if risk != "All" and "risk_level" in log.columns:
        out = out.filter(F.col("risk_level") == risk)
    return out


def order_recent(df: DataFrame, at: str = "created_at", tie: str = "id", n: int | None = None) -> DataFrame:
    """Newest first; with `n` a top-k plan, otherwise a range-partitioned sort."""
    out = df.orderBy(ref(at).desc(), ref(tie).desc())
    return out if n is None else out.limit(n)


def history_summary(log: DataFrame, by: Sequence[str] = ("user_id",), high: str = RISK_LABELS[0]) -> DataFrame:
    return log.groupBy(*[ref(b) for b in by]).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("prediction") == "CHURN").alias("churn"),
        F.count_if(F.col("prediction") == "STAY").alias("stay"),
        F.count_if(F.col("risk_level") == high).alias("high_risk"),
    )


def admin_summary(users: DataFrame, log: DataFrame) -> DataFrame:
    """Both tables are reduced to one row; the user count joins as a scalar subquery."""
    n_users = users.agg(F.count("*")).scalar()
    churn = F.count_if(F.col("prediction") == "CHURN")
    per_log = log.agg(F.count("*").alias("predictions"), churn.alias("churn"), (F.count("*") - churn).alias("stay"))
    return per_log.select(n_users.alias("users"), "predictions", "churn", "stay")


def join_user_predictions(users: DataFrame, log: DataFrame, key: str = "user_id", user_key: str = "id") -> DataFrame:
    """Every prediction with its user, and every user without one.

    Written as an inner join plus the unmatched users: in the inner join the optimizer may split a user
    who owns much of the log, which an outer join with the log on its inner side would forbid.
    """
    named = users.select(ref(user_key).alias(key), *[ref(c).alias(f"user_{c}") for c in users.columns if c not in (user_key, key)])
    rest = [c for c in log.columns if c != key]
    matched = log.join(named, key).select(key, *[c for c in named.columns if c != key], *[ref(c) for c in rest])
    active = log.select(ref(key)).distinct()
    idle = named.join(active, key, "left_anti")
    return matched.unionByName(idle, allowMissingColumns=True)


def cascade_delete(users: DataFrame, log: DataFrame, deleted: DataFrame, user_key: str = "id", key: str = "user_id") -> tuple[DataFrame, DataFrame]:
    """Both tables without the deleted users; `sources.accounts` commits them together."""
    gone = deleted.select(ref(deleted.columns[0]).alias("__gone")).distinct()
    keep_users = users.join(gone, ref(user_key) == F.col("__gone"), "left_anti")
    keep_log = log.join(gone, ref(key) == F.col("__gone"), "left_anti")
    return keep_users, keep_log


def touch_last_login(users: DataFrame, logins: DataFrame, user_key: str = "id", login_key: str = "user_id", at: str = "ts") -> DataFrame:
    latest = logins.groupBy(ref(login_key).alias("__id")).agg(F.max(ref(at)).alias("__at"))
    joined = users.join(latest, ref(user_key) == F.col("__id"), "left")
    return joined.withColumn("last_login", F.greatest(F.col("last_login"), F.col("__at"))).drop("__id", "__at")


#: Registrations that one task tries in order.
IN_ORDER = 100_000


def insert_if_unique(existing: DataFrame, batch: DataFrame, seq: str, keys: Sequence[str] = ("username", "email"), in_order: int = IN_ORDER) -> DataFrame:
    """Accepted registrations of a batch, as if its rows were tried one by one in `seq` order (numbers, each once).

    A row is refused when any of its keys is taken, by the table or by a row accepted before it; a null key is never taken.
    Rows that conflict directly or over others form a component, and components don't touch each other: each one of at most
    `in_order` rows is tried in order by one task.  In larger ones a round accepts the rows that come first for all their keys,
    found with partial aggregation, so a key shared by many rows is cheap, and then tries the `in_order` rows that come first of
    what is left, which nothing later can change.  So a long chain takes a round per `in_order` rows, not one per link.
    """
    open_rows = batch
    for k in keys:
        taken = existing.select(ref(k)).distinct()
        open_rows = open_rows.join(taken, k, "left_anti")
    open_rows = materialised(open_rows.select(*batch.columns), "open")
    accepted: list[DataFrame] = []
    while not open_rows.isEmpty():
        if open_rows.count() <= in_order:
            accepted.append(tried_in_order(open_rows.withColumn("__c", F.lit(0).cast("bigint")), seq, keys))
            break
        of = conflicts(open_rows, keys)
        sizes = of.groupBy("__c").agg(F.count("*").alias("__n"))
        sized = materialised(of.join(sizes, "__c"), "components")
        accepted.append(tried_in_order(sized.filter(F.col("__n") <= in_order).drop("__n"), seq, keys))
        large = materialised(sized.filter(F.col("__n") > in_order).drop("__n"), "large")
        winners = materialised(firsts_of(large, seq, keys), "firsts")
        left = without(large, winners, seq, keys)
        place = F.row_number().over(Window.partitionBy("__c").orderBy(ref(seq)))
        first = materialised(left.withColumn("__n", place).filter(F.col("__n") <= in_order).drop("__n"), "first")
        tried = tried_in_order(first, seq, keys)
        accepted += [winners, tried]
        open_rows = materialised(without(left.join(first.select(ref(seq)), seq, "left_anti"), tried, seq, keys).select(*batch.columns), "open")
    out = batch.limit(0)
    for part in accepted:
        out = out.unionByName(part.select(*batch.columns))
    return out


def without(rows: DataFrame, winners: DataFrame, seq: str, keys: Sequence[str]) -> DataFrame:
    """`rows` without the winners and all that share a key with one."""
    out = rows.join(winners.select(ref(seq)), seq, "left_anti")
    for k in keys:
        out = out.join(winners.select(ref(k)).distinct(), k, "left_anti")
    return out


def firsts_of(rows: DataFrame, seq: str, keys: Sequence[str]) -> DataFrame:
    """The rows that come first for all their keys; the one with the smallest seq always does."""
    out = rows
    for k in keys:
        first = rows.filter(ref(k).isNotNull()).groupBy(ref(k)).agg(F.min(ref(seq)).alias("__first"))
        out = out.join(first, k, "left").filter(F.col("__first").isNull() | (F.col("__first") == ref(seq))).drop("__first")
    return out.select(*rows.columns)


def conflicts(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """`rows` with the component they conflict in (`__c`): rows are joined by every key that they share.

    Key values are the vertices and rows the edges, so a key of very many rows is one vertex.
    """
    named = [F.when(ref(k).isNotNull(), F.xxhash64(F.lit(i), ref(k).cast("string"))) for i, k in enumerate(keys)]
    marked = rows.withColumn("__keys", F.array_compact(F.array(*named)))
    ends = F.explode(F.slice("__keys", 2, len(keys))).alias("b")
    labels = connected(marked.filter(F.size("__keys") > 1).select(F.get("__keys", F.lit(0)).alias("a"), ends))
    head = marked.withColumn("__k", F.get("__keys", F.lit(0))).join(labels, F.col("__k") == F.col("node"), "left")
    # a row without any key conflicts with none
    alone = F.coalesce("label", "__k", F.xxhash64(F.lit("alone"), *[ref(c) for c in rows.columns]))
    return head.withColumn("__c", alone).drop("__keys", "__k", "node", "label")


def connected(edges: DataFrame) -> DataFrame:
    """(node, label) of the components of (a, b): every node moves to its least neighbour, edges follow, until none is left."""
    labels: DataFrame | None = None
    edges = materialised(edges.filter("a != b").distinct(), "edges")
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = materialised(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "step")
        if labels is None:
            labels = step
        else:
            to = step.select(F.col("node").alias("label"), F.col("label").alias("to"))
            labels = materialised(labels.join(to, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")
        ends = [step.select(F.col("node").alias(c), F.col("label").alias(f"{c}_to")) for c in ("a", "b")]
        moved = edges.join(ends[0], "a").join(ends[1], "b").filter("a_to != b_to")
        edges = materialised(moved.select(F.least("a_to", "b_to").alias("a"), F.greatest("a_to", "b_to").alias("b")).distinct(), "edges")
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def tried_in_order(rows: DataFrame, seq: str, keys: Sequence[str]) -> DataFrame:
    """The accepted rows of each component (`__c`), each tried in order by one task."""
    keys = list(keys)

    def accept(component):
        component = component.sort_by(seq)
        values = [component.column(k).to_pylist() for k in keys]
        taken: list[set] = [set() for _ in keys]
        keep = []
        for row in zip(*values):
            free = all(v not in t for v, t in zip(row, taken))
            keep.append(free)
            if free:
                for v, t in zip(row, taken):
                    if v is not None:
                        t.add(v)
        import pyarrow as pa

        return component.filter(pa.array(keep, pa.bool_()))

    return materialised(rows.groupBy("__c").applyInArrow(accept, rows.schema).drop("__c"), "accepted")


def filter_alerts(df: DataFrame, prob: str, threshold: float = 0.75) -> DataFrame:
    return df.filter(ref(prob) >= F.lit(threshold))


def alert_digest(df: DataFrame, prob: str, threshold: float = 0.75, by: Sequence[str] = ()) -> DataFrame:
    """How many customers stand at or above the threshold, with a line for the team."""
    hits = df.groupBy(*[ref(b) for b in by]).agg(F.count_if(ref(prob) >= F.lit(threshold)).alias("critical"))
    line = F.concat(
        F.col("critical").cast("string"), F.lit(" customers at or above "), format_percent(F.lit(threshold), 0), F.lit(" churn probability")
    )
    return hits.withColumn("threshold", F.lit(threshold)).withColumn("message", line)


def newest_per_user(log: DataFrame, n: int = 5) -> DataFrame:
    """The n most recent entries of every user; ranks are limited before the shuffle."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    return log.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n).drop("rn")
