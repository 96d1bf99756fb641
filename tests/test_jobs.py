"""The stage commands, one after the other, over the smallest given tables."""
import pathlib

from workload import jobs

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    out = str(tmp_path)
    for stage in ("features", "chart", "univariate", "train", "validate", "records", "cases", "score"):
        jobs.STAGES[stage](spark, SF, out)
        assert list((tmp_path / stage).rglob("part-*")), stage
    report = "".join(p.read_text() for p in pathlib.Path(out, "validate/report").glob("part-*"))
    assert report.startswith("Validation") and "Score PSI" in report
    assert spark.read.json(f"{out}/score/json").count() == 150
