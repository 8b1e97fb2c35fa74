import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_contract():
    q, o = entry.queries(), entry.oracle_sql()
    assert q and set(o) <= set(q)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
def test_flagship(spark):
    assert entry.entry(spark).count() == 50


def test_command_line(spark, tmp_path, capsys):
    from kinweave.__main__ import main

    rows = [(i, str(i), a, "PERSON", str(i), b, "PERSON", "FRIEND", "s", None) for i, (a, b) in enumerate([("Ann", "Bob"), ("Bob", "Cid"), ("Cid", "Dee")])]
    fields = "ingest_seq long, source_id string, source_name string, source_type string, target_id string, target_name string, target_type string, relation_type string, source_data string, evidence string"
    spark.createDataFrame(rows, fields).write.parquet(str(tmp_path / "rel"))
    assert main(["build", str(tmp_path / "rel"), str(tmp_path / "out")]) == 0
    assert main(["search", str(tmp_path / "out"), "ann"]) == 0 and main(["path", str(tmp_path / "out"), "Ann", "Dee"]) == 0 and main([]) == 2
    said = capsys.readouterr().out
    assert "Ann" in said and "[ann, bob, cid, dee]" in said
