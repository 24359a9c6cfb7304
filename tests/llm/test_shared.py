import pyarrow as pa
import pytest

from tapeworks.llm import shared


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        get = staticmethod(lambda name: None)

    class Context:
        master, applicationId = "spark://host:7077", "app"
        getConf = staticmethod(lambda: Conf)
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError):
        shared.shared_dir(Session)


def test_slices_are_bounded_by_rows_and_bytes(monkeypatch):
    monkeypatch.setattr(shared, "SLICE_BYTES", 1000)
    texts = ["x" * n for n in (10, 20, 900, 5000, 1, 1, 600, 600, 3)]
    plain = pa.record_batch([pa.array(range(9)), pa.array(texts)], ["i", "t"])
    nested = pa.record_batch([pa.StructArray.from_arrays([pa.array(texts)], ["t"])], ["row"])
    for batch, column in ((plain, lambda b: b.column(1)), (nested, lambda b: b.column(0).flatten()[0])):
        parts = list(shared.row_slices(iter([batch.slice(1), batch]), 4))
        assert [x for p in parts for x in column(p).to_pylist()] == [*texts[1:], *texts]
        assert all(p.num_rows <= 4 and (p.num_rows == 1 or sum(map(len, column(p).to_pylist())) <= 1000) for p in parts)


def test_tables_are_written_once_and_removed(spark):
    table = shared.materialize(spark.range(5), "five")
    assert table.written_to.startswith(shared.shared_dir(spark)) and table.count() == 5
    place = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
    store = place.getFileSystem(spark._jsc.hadoopConfiguration())
    assert store.exists(place)
    shared.discard(table)
    assert not store.exists(place)
