import pytest

from factloom.functions import storage


def test_small_files_are_replaced_whole(spark, tmp_path):
    path = f"file:{tmp_path}/deep/er/manifest.json"
    assert storage.read_text(spark, path) is None
    for text in ("one", "zwei é 😀", ""):
        storage.write_text(spark, path, text)
        assert storage.read_text(spark, path) == text
    assert [p.name for p in (tmp_path / "deep/er").iterdir() if not p.name.startswith(".")] == ["manifest.json"]
    storage.delete(spark, f"file:{tmp_path}/deep")
    assert storage.read_text(spark, path) is None


def test_stored_tables_end_lineage_and_can_go(spark):
    df = storage.materialize(spark.range(5).selectExpr("id", "id % 2 as odd"), "test")
    assert "Range" not in df._jdf.queryExecution().executedPlan().toString() and df.count() == 5
    storage.discard(df, None)
    assert storage.read_text(spark, df.stored_at + "/_SUCCESS") is None
    assert storage.is_local(spark)


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda name, default=None: default)

        class sparkContext:
            master = "spark://somewhere:7077"

    with pytest.raises(ValueError):
        storage.shared_dir(Session)
    assert not storage.is_local(Session)
