"""Many uploads in one plan against runs of one dataset each."""

import csv
import glob
import random

import pytest
from pyspark.sql import functions as F

from cleansheet.plans.dataset import run_dataset
from cleansheet.plans.uploads import file_name, run_uploads
from cleansheet.sources.csv_files import CsvError
from cleansheet.streaming import uploads

RNG = random.Random(11)
FILES = {
    "plain.csv": "n,t\n1,x\n1,x\n2,y\n",
    "gaps.csv": "id,price,note,flag\n1,10.5,a,True\n2,,b,\n3,7.25,-,False\n4,1e3, a ,True\n4,1e3, a ,True\n",
    "types.csv": 'Big,Wide,Day,When,Yes/No\n9223372036854775808,"1,200",2024-01-05,Jan 5 2024,yes\n'
                 '9223372036854775809,"3,400",2024-02-05,Feb 15 2024, NO\n9223372036854775810,x,soon,n,Yes\n' * 1
                 + "".join(f'{9223372036854775811 + i},"{i},500",2024-03-{i + 1:02d},Mar {i + 1} 2024,no\n' for i in range(27)),
    "constant.csv": "a,b,c\n1,x,\n2,x,\n3,x,\n",
    "all_same.csv": "a\n5\n5\n",
    "empty_rows.csv": "a,b\n1,2\n,\n,\n3,4\n",
    "span.csv": 'id,note\r\n1,"two\r\nlines"\r\n2,"say ""hi"", you"\r\n2,"say ""hi"", you"\r\n',
    "twice.csv": "a,A,a ,\n1,2,3,4\n5,6,7,8\n",
    "short.csv": "a,b,c\n1\n2,x\n3,y,z\n",
    "dates.csv": "d,e\n13/01/2024,01/02/2024\n02/03/2024,13/01/2024\n05/06/2024,02/03/2024\n",
    "spaces.csv": "name,v\n a  b ,1\nc\t d,2\n,3\nc\t d,4\n",
    "mixed.csv": "v\n1\n2\nthree\n4\nNULL\n",
    "bools.csv": "f,g\ntrue,1\n,2\nFALSE,3\ntrue,4\n",
    "random.csv": "k,w,x\n" + "".join(
        f"{RNG.randint(1, 30)},{RNG.choice(['a', 'B ', '', '-', 'N/A', '7'])},{RNG.choice(['1.5', '2', '', 'inf', '-0'])}\n"
        for _ in range(200)),
    "with space é.csv": "a,b\n1,x\n2,y\n",
}
BAD = {
    "nothing.csv": (b"", "empty"), "head.csv": (b"a,b\n", "no data rows"), "long.csv": (b"a,b\n1,2,3\n", "more cells"),
    "latin.csv": (b"a\n\xe9\n", "not_text"), "open.csv": (b'a,b\n1,"x\n2,y\n', "never closed"),
}


def parsed(folder):
    text = "".join(open(f, encoding="utf-8-sig", newline="").read() for f in sorted(glob.glob(f"{folder}/part-*")))
    return list(csv.reader(text.splitlines(keepends=True)))


@pytest.fixture(scope="module")
def inbox(tmp_path_factory):
    folder = tmp_path_factory.mktemp("inbox")
    for name, text in FILES.items():
        (folder / name).write_bytes(text.encode())
    for name, (content, _) in BAD.items():
        (folder / name).write_bytes(content)
    return folder


@pytest.fixture(scope="module")
def together(spark, inbox, tmp_path_factory):
    out = tmp_path_factory.mktemp("out")
    paths = [f"file:{inbox}/{n}" for n in [*FILES, *BAD]]
    return paths, {o.path: o for o in run_uploads(spark, paths, str(out / "all"))}, out / "all"


@pytest.mark.parametrize("name", list(FILES))
def test_same_as_one_by_one(spark, inbox, together, tmp_path, name):
    paths, outcomes, out = together
    path = f"file:{inbox}/{name}"
    got = outcomes[path]
    try:
        run = run_dataset(spark, path, str(tmp_path))
    except CsvError as problem:
        assert got.error == str(problem)
        return
    assert got.error is None
    assert got.summary == (
        f"rows {run.before.rows} -> {run.after.rows}, quality {run.before.quality_score} -> {run.after.quality_score}, "
        f"changes {run.cleaning.total_changes}")
    mine = parsed(glob.escape(f"{out}/file={file_name(paths.index(path), path)}").replace("%", "%25"))
    single = parsed(glob.escape(run.cleaning.output.removeprefix("file:")))
    assert mine[0] == single[0] and sorted(mine[1:]) == sorted(single[1:])


@pytest.mark.parametrize("name", list(BAD))
def test_unusable_files(inbox, together, name):
    assert BAD[name][1] in together[1][f"file:{inbox}/{name}"].error


def jobs_of(spark, call):
    """How many Spark jobs a call runs."""
    group = f"jobs-{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    call()
    found = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return found


def test_jobs_do_not_grow_with_files(spark, tmp_path):
    """Past 32 paths, Spark lists the files of each read in a job of its own; nothing else is added."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        counts = []
        for n in (3, 30, 90):
            folder = tmp_path / f"in{n}"
            folder.mkdir()
            for i in range(n):
                (folder / f"{i}.csv").write_text(f"n,t,d\n{i},x,2024-01-0{i % 9 + 1}\n{i + 1},,2024-01-02\n{i},x,2024-01-0{i % 9 + 1}\n")
            paths = [f"file:{folder}/{i}.csv" for i in range(n)]
            counts.append(jobs_of(spark, lambda: run_uploads(spark, paths, str(tmp_path / f"out{n}"))))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert counts[0] == counts[1] > 0 and counts[2] <= counts[1] + 2


def test_large_files_are_run_by_themselves(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    (inbox / "a.csv").write_text("n,t\n" + "".join(f"{i},x{i}\n" for i in range(100)))
    (inbox / "b.csv").write_text("n,t\n1,x\n2,y\n")
    places = [str(tmp_path / p) for p in ("log", "offsets", "cleaned")]
    uploads.run_available(spark, str(inbox), *places, large_file=100)
    log = uploads.read_history(spark, places[0]).orderBy("input_text").select("output_text", F.col("success")).collect()
    assert [r["output_text"].split(",")[0] for r in log] == ["rows 100 -> 100", "rows 2 -> 2"]
