"""Stored users and their prediction log: changes that are committed as one version of both tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import history
from . import versions

USERS, LOG = "users", "predictions"


def create(spark: SparkSession, root: str, users: DataFrame, log: DataFrame) -> int:
    return versions.commit(spark, root, {USERS: users, LOG: log})


def delete_users(spark: SparkSession, root: str, deleted: DataFrame, user_key: str = "id", key: str = "user_id") -> int:
    """Delete users with their log entries: both tables change in one commit."""
    base = versions.versions(spark, root)[-1]
    users, log = (versions.read(spark, root, t, base) for t in (USERS, LOG))
    users, log = history.cascade_delete(users, log, deleted, user_key, key)
    return versions.commit(spark, root, {USERS: users, LOG: log}, base)


def record_logins(spark: SparkSession, root: str, logins: DataFrame, user_key: str = "id", login_key: str = "user_id", at: str = "ts") -> int:
    """Take over the latest login of every user; the log stays as it is."""
    base = versions.versions(spark, root)[-1]
    users = history.touch_last_login(versions.read(spark, root, USERS, base), logins, user_key, login_key, at)
    return versions.commit(spark, root, {USERS: users}, base)


def register(spark: SparkSession, root: str, batch: DataFrame, seq: str, user_key: str = "id") -> int:
    """Add the registrations of a batch whose name and address are free; `seq` gives their order and becomes their id."""
    base = versions.versions(spark, root)[-1]
    users = versions.read(spark, root, USERS, base)
    fresh = history.insert_if_unique(users, batch, seq).withColumnRenamed(seq, user_key)
    return versions.commit(spark, root, {USERS: users.unionByName(fresh, allowMissingColumns=True)}, base)
