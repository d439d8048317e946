import pytest

from tastegrid import cli


def test_commands(spark, data, tmp_path):
    cli.main(["run", "p4_found", "--data", data, "--out", str(tmp_path / "q")], spark)
    assert spark.read.parquet(str(tmp_path / "q")).columns == ["quote_id", "grams", "usd_cents"]
    (tmp_path / "a.json").write_text('[{"k": 1}, {"k": 2}]')
    cli.main(["to-csv", str(tmp_path / "a.json"), "--out", str(tmp_path / "c")], spark)
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2


@pytest.mark.parametrize("wrong", [["run", "none"], ["run", "p4_found", "--data", "/no/such", "--out", "x"], ["to-csv", "a", "--out", "b", "--files", "0"], []])
def test_refused(wrong):
    with pytest.raises(SystemExit):
        cli.main(wrong)
