"""Missing-input guard (A2) and CSV round trip (A1/A3), also through paths with a scheme."""
import tempfile

import pytest

from apptflow.sources import adapters
from apptflow.sources.io import MissingInput, read_csv, read_csv_checked, table, write_csv


def test_missing_table_raises(spark):
    with pytest.raises(MissingInput):
        table(spark, "/nonexistent-dir", "orders")


def test_missing_csv_raises(spark):
    with pytest.raises(MissingInput):
        read_csv(spark, "/nonexistent-dir/x.csv", "a INT")


def test_csv_roundtrip_keeps_nulls(spark, sf_small):
    a = adapters.appointment(spark, sf_small).select("patient_id", "delay_reason").orderBy("patient_id").limit(50)
    path = tempfile.mkdtemp(prefix="apptflow-csv-", dir="/tmp") + "/out"
    write_csv(a, path)
    back = read_csv(spark, path, "patient_id BIGINT, delay_reason STRING")
    assert sorted(map(tuple, back.collect()), key=lambda r: r[0]) == sorted(map(tuple, a.collect()), key=lambda r: r[0])


def test_missing_csv_uri_raises(spark):
    with pytest.raises(MissingInput):
        read_csv(spark, "file:///nonexistent-dir/x.csv", "a INT")


def test_shared_folder_as_uri(spark, sf_small, tmp_path, monkeypatch):
    """csv_roundtrip and tree_nodes with spark.checkpoint.dir=file:///..."""
    from apptflow import session
    from apptflow.plans.registry import queries
    for module in ("apptflow.plans.q_core", "apptflow.operators.models"):
        monkeypatch.setattr(f"{module}.ensure_checkpoint_dir", lambda s: f"file://{tmp_path}")
    assert queries()["csv_roundtrip"](spark, sf_small).count() > 0
    nodes = queries()["tree_nodes"](spark, sf_small)
    assert nodes.filter("depth = 0").count() == 1
    assert session.ensure_checkpoint_dir(spark)


def test_checkpoint_folder_must_be_set_on_a_cluster():
    from types import SimpleNamespace
    from apptflow.session import ensure_checkpoint_dir
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda k, d=None: None), sparkContext=SimpleNamespace(
        master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(cluster)


def test_changed_files_are_read_again(spark, sf_small, tmp_path):
    """No query result outlives its call."""
    from apptflow.plans.registry import queries
    spark.read.parquet(f"{sf_small}/customer.parquet").write.parquet(f"{tmp_path}/customer.parquet")
    orders = spark.read.parquet(f"{sf_small}/orders.parquet")
    for n in (200, 100):
        orders.limit(n).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
        assert queries()["padded_id"](spark, str(tmp_path)).count() == n


def test_checked_csv(spark, tmp_path):
    """Good and rejected rows are the lines; 'None' and blanks are null, padded identifiers numbers."""
    lines = ["id,name,n", "  0007 , Ann ,1", "8,None,2", "x,Bob,3", "9,Cy", "10,Di,4,5", '11,"a, b",6', "12,,7", "", "13, ,"]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    good, rejected = read_csv_checked(spark, f"file://{tmp_path}/a.csv", "id BIGINT, name STRING, n INT")
    assert sorted(map(tuple, good.collect())) == [(7, "Ann", 1), (8, None, 2), (11, "a, b", 6), (12, None, 7), (13, None, None)]
    assert sorted(r["line"] for r in rejected.collect()) == ["10,Di,4,5", "9,Cy", "x,Bob,3"]
    with pytest.raises(MissingInput):
        read_csv_checked(spark, "file:///nonexistent-dir/x.csv", "a INT")
