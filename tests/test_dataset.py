"""The whole run over one CSV."""

import os

import pytest

from cleansheet.plans import dataset
from cleansheet.sources.csv_files import CsvError

TEXT = "Name , Amount\n a,\"1,000\"\n a,\"1,000\"\nb,2\n,3\n"


def test_run_and_report(spark, csv, tmp_path):
    path, out = csv(TEXT, "sales.csv"), str(tmp_path / "out")
    run = dataset.run_dataset(spark, path, out)
    assert (run.before.rows, run.after.rows, run.cleaning.successful) == (4, 3, True)
    assert run.after.quality_score == 10.0 and run.after.name == "sales_cleaned.csv"
    rows = dataset.report_rows(spark, run).orderBy("position").collect()
    got = {(r["section"], r["field"]): r["value"] for r in rows}
    assert got["before", "repeated rows"] == "1" and got["after", "missing cells"] == "0"
    assert got["cleaning", "columns renamed"] == "Name  to name,  Amount to amount"
    assert got["output", "file"] == "sales_cleaned.csv"


def test_output_names_do_not_collide(spark, csv, tmp_path):
    path, out = csv(TEXT, "sales.csv"), str(tmp_path / "out")
    first = dataset.clean_csv(spark, path, out, keep_order=True).report.output
    second = dataset.clean_csv(spark, path, out).report.output
    assert first.endswith("/sales_cleaned.csv") and os.path.basename(second).startswith("sales_cleaned_2")


def test_profile_of_a_folder(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"part{i}.csv").write_text("a,b\n1,x\n")
    assert dataset.profile_csv(spark, str(tmp_path)).rows == 3


@pytest.mark.parametrize("path", ["", "  "])
def test_no_path(spark, path):
    with pytest.raises(CsvError, match="no CSV path"):
        dataset.profile_csv(spark, path)
