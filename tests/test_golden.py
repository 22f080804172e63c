"""One untidy dataset through profile, clean and profile again."""

import glob

import pytest

from cleansheet.operators.dedup import ROW_ORDER
from cleansheet.plans.cleaning import clean_dataset, report_row
from cleansheet.plans.profiling import profile_dataset
from cleansheet.sources.csv_files import read_for_cleaning, read_for_profile, stored, write_csv

# A dataset with every kind of dirt; what is expected of it follows from the stage rules.
HARD = """Shop Name,Opened On,Takings [EUR],Staff,Open Sundays?,Town,Remark,Spare,Chain,Rent
 Lark ,2023/03/05,"2,400",4,yes, Graz ,new,,Q,900
LARK,05-03-2023,2400,4,Yes,Graz,new,,Q,1100
Finch,Mar 7 2023,1800,2,NO,Linz,N/A,,Q,"1,250"
Wren,,"2,100",NULL,no,linz ,  far   out ,,Q,1300
Kite,2023-03-09,-,3,Yes,Wien,NA,,Q,NA
Rook,2023/14/01,5550000,1,YES,Wien,odd takings,,Q,"2,000"
 Swift ,2023-04-02,700,2,No,Bern,    wide     gap   ,,Q,800
Dove,2023-04-02,700,2,No,Bern,close to it,,Q,850
 Swift ,2023-04-02,700,2,No,Bern,    wide     gap   ,,Q,800
,,,,,,,,Q, 
"""

TIDY = """shop_name,opened_on,takings_eur,staff,open_sundays,town,remark,rent
Lark,2023/03/05,2400,4.0,Yes,Graz,new,900
LARK,05-03-2023,2400,4.0,Yes,Graz,new,1100
Finch,Mar 7 2023,1800,2.0,No,Linz,new,1250
Wren,2023-04-02,2100,2.0,No,linz,far out,1300
Kite,2023-03-09,700,3.0,Yes,Wien,new,1250
Rook,2023/14/01,5550000,1.0,Yes,Wien,odd takings,2000
Swift,2023-04-02,700,2.0,No,Bern,wide gap,800
Dove,2023-04-02,700,2.0,No,Bern,close to it,850
Dove,2023-04-02,700,2.0,No,Bern,new,1250
"""


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("golden") / "hard.csv"
    path.write_text(HARD)
    return stored(read_for_cleaning(spark, str(path)))


@pytest.fixture(scope="module")
def cleaned(table):
    return clean_dataset(table.rows, kinds=table.kinds)


def test_kinds(table):
    assert table.kinds["Staff"] == table.kinds["Spare"] == "float64"
    assert {k for c, k in table.kinds.items() if c not in ("Staff", "Spare")} == {"text"}
    assert table.encoding == "utf-8-sig"


def test_profile_before(table):
    p = profile_dataset(table.rows, "hard", kinds=table.kinds)
    assert (p.rows, p.columns, p.total_missing, p.duplicate_rows, p.quality_score) == (10, 10, 22, 1, 8.2)
    staff = p.numeric["Staff"]
    assert staff["n_values"] == 8 and staff["mean"] == 2.5 and staff["std"] == pytest.approx((8 / 7) ** 0.5)
    assert [staff[k] for k in ("min", "p25", "p50", "p75", "max")] == [1, 2, 2, 3.25, 4]
    assert p.numeric["Spare"]["n_values"] == 0 and p.numeric["Spare"]["mean"] is None
    assert sorted(p.inconsistent) == ["Rent", "Takings [EUR]"]
    assert {c: s["unique"] for c, s in p.texts.items()} == {
        "Shop Name": 8, "Opened On": 6, "Takings [EUR]": 7, "Open Sundays?": 6, "Town": 6, "Remark": 5, "Chain": 1, "Rent": 8,
    }
    assert p.recommendations[0] == "1 repeated row(s) can be dropped"
    assert sum(r.endswith("have no value") for r in p.recommendations) == 9
    assert [r for r in p.recommendations if "white space" in r] == [
        f"`{c}` has values with outer white space" for c in ("Shop Name", "Town", "Remark", "Rent")
    ]
    assert len(p.recommendations) == 14


def test_report(spark, cleaned):
    r = cleaned.report
    assert (r.rows_before, r.rows_after, r.columns_before, r.columns_after) == (10, 9, 10, 8)
    assert (r.duplicates_removed, r.empty_rows_removed, len(r.renamed), r.tokens_normalized) == (1, 0, 10, 2)
    assert r.columns_removed == ["spare", "chain"] and r.columns_converted == ["takings_eur", "rent"]
    assert r.filled == {
        "shop_name": 1, "opened_on": 2, "takings_eur": 2, "staff": 2, "open_sundays": 1, "town": 1, "remark": 3, "rent": 2,
    }
    assert r.outliers == {"takings_eur": (1, -1850.0, 4950.0), "rent": (1, 375.0, 1775.0)}
    assert r.total_changes == 15
    row = report_row(spark, r).first()
    assert row["outlier_summary"]["rent"]["count"] == 1 and not row["cleaning_successful"]


def test_written_file(spark, cleaned, tmp_path):
    out = str(tmp_path / "out")
    write_csv(cleaned.rows.coalesce(1), out, order=ROW_ORDER)
    (part,) = glob.glob(f"{out}/part-*")
    assert open(part, encoding="utf-8").read() == "﻿" + TIDY
    after = profile_dataset(read_for_profile(spark, out).rows, "after")
    assert (after.rows, after.columns, after.total_missing, after.duplicate_rows) == (9, 8, 0, 0)
    assert after.quality_score == 10.0


def test_same_result_in_any_partitioning(table, cleaned):
    expected = sorted(map(tuple, cleaned.data.collect()), key=str)
    for n in (1, 7):
        again = clean_dataset(table.rows.repartition(n), kinds=table.kinds)
        assert sorted(map(tuple, again.data.collect()), key=str) == expected
        assert again.report == cleaned.report
