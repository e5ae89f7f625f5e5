import pytest

from holdfast.sources import accounts, versions


def tables(spark, root):
    users = {(r["id"], r["last_login"]) for r in versions.read(spark, root, "users").collect()}
    return users, {(r["id"], r["user_id"]) for r in versions.read(spark, root, "predictions").collect()}


@pytest.fixture()
def root(spark, tmp_path):
    root = str(tmp_path / "accounts")
    users = spark.createDataFrame([(1, "a", "a@x", None), (2, "b", "b@x", 5), (3, "c", "c@x", None)], "id int, username string, email string, last_login int")
    assert accounts.create(spark, root, users, spark.createDataFrame([(10, 1), (11, 2), (12, 2)], "id int, user_id int")) == 1
    return root


def test_delete_and_login(spark, root):
    assert accounts.delete_users(spark, root, spark.createDataFrame([(2,), (9,)], "user_id int")) == 2
    assert tables(spark, root) == ({(1, None), (3, None)}, {(10, 1)})
    assert accounts.record_logins(spark, root, spark.createDataFrame([(1, 3), (1, 7), (2, 4)], "user_id int, ts int")) == 3
    assert tables(spark, root) == ({(1, 7), (3, None)}, {(10, 1)})
    # the first version can be read still
    assert versions.read(spark, root, "predictions", 1).count() == 3


def test_register(spark, root):
    batch = spark.createDataFrame([(20, "d", "d@x"), (21, "d", "e@x"), (22, "a", "f@x"), (23, "g", "g@x")], "seq int, username string, email string")
    accounts.register(spark, root, batch, "seq")
    assert {r["id"] for r in versions.read(spark, root, "users").collect()} == {1, 2, 3, 20, 23}


def test_failure_between_the_writes_leaves_the_old_state(spark, root, monkeypatch):
    before = tables(spark, root)
    writer = type(spark.range(0).write)
    real, calls = writer.parquet, []

    def failing(self, path, *args, **more):
        calls.append(path)
        if "/predictions/" in path:
            raise OSError("disk gone")
        return real(self, path, *args, **more)

    monkeypatch.setattr(writer, "parquet", failing)
    with pytest.raises(OSError, match="disk gone"):
        accounts.delete_users(spark, root, spark.createDataFrame([(2,)], "user_id int"))
    monkeypatch.undo()
    # users had been written already
    assert any("/users/" in c for c in calls) and tables(spark, root) == before and versions.versions(spark, root) == [1]
    accounts.delete_users(spark, root, spark.createDataFrame([(2,)], "user_id int"))
    assert tables(spark, root) == ({(1, None), (3, None)}, {(10, 1)})
    # what the failed commit left is deleted, the last version is not
    gone = versions.drop_old(spark, root, keep=1)
    assert len([g for g in gone if g.startswith("users/")]) == 2 and tables(spark, root) == ({(1, None), (3, None)}, {(10, 1)})


def test_second_commit_on_one_base_fails(spark, root):
    rows = spark.createDataFrame([(1, 1)], "id int, user_id int")
    assert versions.commit(spark, root, {"predictions": rows}, base=1) == 2
    with pytest.raises(versions.Conflict):
        versions.commit(spark, root, {"predictions": rows.limit(0)}, base=1)
    assert versions.read(spark, root, "predictions").count() == 1


def test_nothing_committed(spark, tmp_path):
    assert versions.versions(spark, str(tmp_path / "none")) == [] and versions.manifest(spark, str(tmp_path / "none")) == {}
    with pytest.raises(KeyError):
        versions.read(spark, str(tmp_path / "none"), "users")
