import csv
import io
import random

import pytest
from pyspark.sql import functions as F

import plumbline as pb
from plumbline.sources import csv_files, csv_records, sinks
from plumbline.sources.csv_files import layout_table


def test_banner_line_is_skipped(spark, put):
    path = put('# sample file\nID,Name,Age\n1,"a, b",22\n2,c,29\n')
    got = pb.read_csv(spark, path)
    assert got.columns == ["ID", "Name", "Age"] and [tuple(r) for r in got.orderBy("ID").collect()] == [(1, "a, b", 22), (2, "c", 29)]
    assert layout_table(spark, path).first()["banner"] == "# sample file"


def test_corrupt_files_raise(spark, put):
    for i, text in enumerate(("", "junk\na,b,c,d,e\n1,2,3\n1,2,3,4,5\n1,2\n", "a,b\n1,2\n3,4\n" + "5,6\n" * 30 + "1,2,3,4\n")):
        with pytest.raises(pb.ScanError):
            pb.read_csv(spark, put(text, f"bad{i}.csv"))
    with pytest.raises(pb.ScanError):
        pb.read_csv(spark, "/tmp/no-such-file.csv")


def test_headerless_file_keeps_repeated_values(spark, put):
    got = pb.read_csv(spark, put("5,5\n1,2\n"))
    assert got.columns == ["column_0", "column_1"] and sorted(tuple(r) for r in got.collect()) == [(1, 2), (5, 5)]


def test_missing_tokens_and_types(spark, put):
    got = pb.read_csv(spark, put("i,f,b,s,m\n1,NA,True,x,1d\nnan,2.5,False,NaN,2\n,3,true,#N/A,3\n"))
    assert [f.dataType.simpleString() for f in got.schema.fields] == ["bigint", "double", "boolean", "string", "string"]
    assert [r["s"] for r in got.collect()] == ["x", None, None]


def test_latin1_file(spark, put):
    got = pb.read_csv(spark, put("name,n\nCafé,1\nZoé,2\n".encode("latin-1")))
    assert [r["name"] for r in got.orderBy("n").collect()] == ["Café", "Zoé"]


def test_latin1_file_with_banner(spark, put):
    got = pb.read_csv(spark, put("# café\nname,n,m\nCafé,1,0\nZoé,2,0\n".encode("latin-1")))
    assert [r["name"] for r in got.orderBy("n").collect()] == ["Café", "Zoé"]


def test_extra_leading_field_becomes_an_index(spark, put):
    got = pb.read_csv(spark, put("a,b\nr1,1,2\nr2,3,4\n"))
    assert [tuple(r) for r in got.orderBy("a").collect()] == [("r1", 1, 2), ("r2", 3, 4)]


def test_header_only_repeated_names_and_guards(spark, put):
    assert pb.read_csv(spark, put("A,B\n", "h.csv")).count() == 0
    assert pb.read_csv(spark, put("id,val,val\n1,2,3\n", "d.csv")).columns == ["id", "val", "val.1"]
    with pytest.raises(pb.ScanError):
        pb.read_csv(spark, put("a,b,c\n1,2,3\n", "w.csv"), max_columns=2)
    with pytest.raises(pb.ScanError):
        pb.read_csv(spark, put("a\nx\ny\n", "r.csv"), max_rows=1)


def test_quoted_line_breaks_need_multiline(spark, put):
    got = pb.read_csv(spark, put('a,b\n"x\ny",1\n"p ""q""",2\n'), multiline=True)
    assert [r["a"] for r in got.orderBy("b").collect()] == ["x\ny", 'p "q"']


def test_written_table_reads_back(spark, churners, tmp_path):
    for fmt in ("csv", "parquet"):
        path = str(tmp_path / fmt)
        sinks.write_table(churners, path, fmt)
        assert sinks.round_trip_check(churners, path, fmt).first()["same"]


def test_headerless_lines_in_parallel_files(spark, tmp_path):
    from suite.queries import _lines

    path = str(tmp_path / "out")
    df = spark.range(60).selectExpr("id + 100 AS a", "id * 2 AS b", "id / 4 AS c").repartition(3)
    _lines(df, path, [])
    assert len(list((tmp_path / "out").glob("part-*"))) == 3
    assert sorted(tuple(r) for r in pb.read_csv(spark, path).collect()) == sorted(tuple(r) for r in df.collect())


@pytest.fixture
def small_splits(spark):
    """Splits of 900 bytes, so that records, cells and quotes cross their borders."""
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.set(f"spark.sql.files.{name}", "900")
    yield
    for name in ("maxPartitionBytes", "openCostInBytes"):
        spark.conf.unset(f"spark.sql.files.{name}")


def messy_table(seed, n=120):
    rng = random.Random(seed)
    cell = lambda: "".join(rng.choice(["a", "b", ",", '"', "\n", "\r\n", " ", "é", "x" * 9]) for _ in range(rng.randrange(7)))
    return [[str(i), "z" + cell(), "y" + cell(), ("q\n" * 900 + "q") if i % 40 == 7 else "w"] for i in range(n)]


@pytest.mark.parametrize("end, banner", [("\n", ""), ("\r\n", "# made by hand")])
def test_records_over_many_splits(spark, small_splits, put, tmp_path, end, banner):
    """Two files with line breaks in cells, cells longer than splits, CRLF and a banner: equal to csv.reader."""
    want = []
    for k in (1, 2):
        rows = messy_table(k)
        text = io.StringIO()
        csv.writer(text, lineterminator=end).writerows([["id", "a", "b", "c"], *rows])
        put((banner + end if banner else "") + text.getvalue(), f"f{k}.csv")
        want += rows
    path = str(tmp_path / "*.csv")
    lines = csv_records.raw_lines(spark, path)
    assert lines.select("file", "start").distinct().count() > 8 and lines.rdd.getNumPartitions() > 8
    cut = csv_records.records(spark, path)
    assert cut.count() == len(want) + 2 + 2 * bool(banner)
    got = pb.read_csv(spark, path)
    assert sorted([str(r["id"]), r["a"], r["b"], r["c"]] for r in got.collect()) == sorted(want)


def test_states_without_broadcast(spark, small_splits, put, monkeypatch):
    rows = messy_table(3)
    text = io.StringIO()
    csv.writer(text, lineterminator="\n").writerows(rows)
    path = put(text.getvalue())
    want = sorted(bytes(r["record"]) for r in csv_records.records(spark, path).collect())
    monkeypatch.setattr(csv_records, "SENT_SPLITS", 0)
    assert sorted(bytes(r["record"]) for r in csv_records.records(spark, path).collect()) == want and len(want) == len(rows)


def test_stray_and_unclosed_quotes(spark, put):
    got = pb.read_csv(spark, put('a,b\n5" pipe,1\nx,2\n"y\nz",3\n'))
    assert sorted((r["a"], r["b"]) for r in got.collect()) == [('5" pipe', 1), ("x", 2), ("y\nz", 3)]
    cut = csv_records.records(spark, put('a,b\n"open,1\nx,2\n', "open.csv"))
    assert sorted(bytes(r["record"]) for r in cut.collect()) == [b'"open,1\nx,2', b"a,b"]


def test_layout_of_every_file(spark, put, tmp_path):
    put("id,a,b\n" + "1,x,y\n" * 200 + "1,x\n" * 3, "ragged.csv")
    put("# note\nid,a,b\n1,x,y\n", "banner.csv")
    put("junk\n1,2,3,4,5\n1,2,3\n1,2,3,4,5\n", "malformed.csv")
    put("id,a,b\n" + '1,"x,z",y\n' * 30 + "\n  \n", "plain.csv")
    put("id,a\n1,x\n", "disagrees.csv")
    put("id,a,b\n", "header_plain.csv")
    path = str(tmp_path / "*.csv")
    for rows in (csv_records.line_records(spark, path), csv_records.records(spark, path)):
        got = {r["file"]: (r["records"], r["width"], r["ragged"], r["finding"]) for r in csv_records.layout_report(rows).collect()}
        assert got == {"ragged.csv": (204, 3, 3, "ragged"), "banner.csv": (3, 3, 0, "banner"), "malformed.csv": (4, 5, 1, "malformed"),
                       "plain.csv": (31, 3, 0, "plain"), "disagrees.csv": (2, 2, 0, "disagrees"), "header_plain.csv": (1, 3, 0, "plain")}


def test_files_that_disagree_raise(spark, put, tmp_path):
    put("id,a\n1,x\n", "one.csv")
    put("id,b\n2,y\n", "two.csv")
    with pytest.raises(pb.ScanError, match="head lines"):
        pb.read_csv(spark, str(tmp_path / "*.csv"))
    put("id,a\n" + "1,x\n" * 50, "late.csv")
    put("junk\n" + "id,a\n" * 30 + "1,2,3\n" * 40, "late_junk.csv")  # the first lines alone look like two fields
    assert {r["finding"] for r in csv_records.layout_report(csv_records.line_records(spark, str(tmp_path / "late*.csv"))).collect()} == {
        "plain", "malformed"}


def test_layout_neither_sorts_nor_moves_records(spark, put, tmp_path, monkeypatch):
    """What is joined with all records is sent to the tasks, so that no task gathers a file; the exact way stays for many files."""
    put("id,a,b\n" + "1,x,y\n" * 50 + "1,x\n", "one.csv")
    put("\n  \n# note\nid,a,b\n1,x,y\n", "two.csv")
    rows = csv_records.line_records(spark, str(tmp_path / "*.csv"))
    plans = []
    keep = csv_records.staged
    monkeypatch.setattr(csv_records, "staged", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or keep(df))
    want = sorted(tuple(r) for r in csv_records.file_layouts(rows).collect())
    assert plans and not any("SortMergeJoin" in p for p in plans)
    assert sorted((r[1], r[7], r[8]) for r in want) == [(3, b"# note", b"id,a,b"), (52, b"id,a,b", b"1,x,y")]
    monkeypatch.setattr(csv_records, "SENT_SPLITS", 0)
    assert sorted(tuple(r) for r in csv_records.file_layouts(rows).collect()) == want


def test_types_of_many_columns_in_one_pass(spark, monkeypatch):
    """Whole numbers, texts with a dot and suffixes as before, over more columns than one batch had; decimals are not cast to bigint."""
    cells = {"i": ["1", " 2 ", "-3"], "f": ["1", "2.", ".5"], "x": ["1", "2d", "3"], "b": ["True", "false", "TRUE"], "s": ["d", "1.5f", "7"],
             "gap": [None, "NA", "4"], "none": ["", "NA", None]}
    names = [f"{k}{n}" for n in range(8) for k in cells]
    table = [tuple(cells[n.rstrip("01234567")][i] for n in names) + (None,) for i in range(3)]
    df = spark.createDataFrame(table, ", ".join(f"{n} string" for n in (*names, "_extra")))
    jobs = []
    run = type(df).agg
    monkeypatch.setattr(type(df), "agg", lambda self, *a: jobs.append(1) or run(self, *a))
    kinds, total, surplus = csv_files.infer_types(df, names)
    want = {"i": "bigint", "f": "double", "x": "string", "b": "boolean", "s": "string", "gap": "bigint", "none": "double"}
    assert kinds == {n: want[n.rstrip("01234567")] for n in names} and (total, surplus) == (3, 0) and len(jobs) == 0
    assert csv_files.infer_types(df.limit(0), ["i0"]) == ({"i0": "double"}, 0, 0)
    assert "contains" in str(csv_files._as_bigint(F.col("c"))).lower()


def test_lines_are_taken_in_small_slices(monkeypatch):
    """All values in order, few bytes at once, a longer one alone at most with its neighbours' slice."""
    import pyarrow as pa

    monkeypatch.setattr(csv_records, "SLICE_BYTES", 100)
    values = [b"x" * (i % 30) for i in range(500)] + [b"y" * 900, b"", None, b"z"]
    slices = list(csv_records._slices(pa.array(values, pa.binary())))
    assert [v for s in slices for v in s] == values and max(len(s) for s in slices) < 60 and len(slices) > 60
    assert [v for s in csv_records._slices(pa.array([], pa.binary())) for v in s] == []
