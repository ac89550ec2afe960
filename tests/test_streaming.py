from residua.streaming import ingest
from tests.test_sources import CIF


def test_files_arrive_in_batches(spark, tmp_path):
    src, out, cp = (tmp_path / x for x in ("in", "out", "cp"))
    src.mkdir()
    for k, name in enumerate(("1ABC", "2ABC")):
        (src / f"{name}.cif").write_text(CIF.replace("1ABC", name))
        q = ingest.ingest(ingest.file_stream(spark, str(src)), str(out), str(cp))
        q.awaitTermination(120)
        assert ingest.latest(spark, str(out), "atoms").select("entry_id").distinct().count() == k + 1
    assert ingest.latest(spark, str(out), "atoms").count() == 6
