"""Files and grids."""

import json
import random
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from recordloom.config import Settings
from recordloom.plans.run import run
from recordloom.sources import delimited, grid, json_records, lookups


def test_encodings_layouts_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿prénom,nom,nom\nZoé,x, nan \n".encode())
    (tmp_path / "b.csv").write_bytes("prénom,note\nZoé,€5\n".encode("cp1252"))
    (tmp_path / "c.csv").write_bytes('id,text\n1,"two\nlines, and ""quotes"""\n2,None\n'.encode())
    found = {r["path"][-5:]: r for r in delimited.inspect_files(spark, str(tmp_path)).collect()}
    assert [found[k]["encoding"] for k in ("a.csv", "b.csv", "c.csv")] == ["utf-8", "cp1252", "utf-8"]
    assert [found[k]["splittable"] for k in ("a.csv", "b.csv", "c.csv")] == [True, True, False]
    a = delimited.read_csv_text(spark, str(tmp_path / "a.csv"))
    assert a.columns == ["prénom", "nom", "nom.1"] and [tuple(r) for r in a.collect()] == [("Zoé", "x", "nan")]
    b = delimited.read_csv_text(spark, str(tmp_path / "b.csv"))
    assert [tuple(r) for r in b.collect()] == [("Zoé", "€5")]
    c = delimited.read_csv_text(spark, str(tmp_path / "c.csv"))
    assert [tuple(r) for r in c.collect()] == [("1", 'two\nlines, and "quotes"'), ("2", "")]


def read(spark, path, **how):
    return [tuple(r) for r in delimited.read_csv_text(spark, str(path), **how).collect()]


def test_no_projection_hides_a_record_with_more_fields(spark, tmp_path):
    path = tmp_path / "extra.csv"
    for text in ("name,email\nAli,a@x.dz\nB,b@x.dz,EXTRA\n", 'name,email\n"A\nli",a@x.dz\nB,b@x.dz,\n', 'name,email\n5" x,6" y,"z"\n'):
        path.write_text(text)
        rows = delimited.read_csv_text(spark, str(path))
        for plan in (rows, rows.select("email"), rows.groupBy().count(), rows.select(F.lit(1))):
            with pytest.raises(Exception, match="more fields than the 2 headers"):
                plan.collect()
        with pytest.raises(Exception, match="more fields than the 2 headers"):
            rows.count()
    path.write_text('name,email,tel\nAli\n"B ""b"", x",,\n')
    assert read(spark, path) == [("Ali", "", ""), ('B "b", x', "", "")]


def test_quotes_inside_cells_do_not_join_lines(spark, tmp_path):
    """A quote that does not start a cell is an ordinary character, and the file stays in pieces."""
    path = tmp_path / "inch.csv"
    path.write_text("size,note\n" + "".join(f'{i}" pipe,n{i}\n' if i % 1_000 == 0 else f"{i},n{i}\n" for i in range(100_000)))
    with several_pieces(spark, 100_000):
        rows = delimited.read_csv_text(spark, str(path))
        assert rows.rdd.getNumPartitions() > 4 and rows.count() == 100_000
        assert rows.where("note = 'n2000'").first()["size"] == '2000" pipe'


@contextmanager
def several_pieces(spark, size):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in old:
            spark.conf.set(k, str(size))
        yield
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_records_over_lines_and_pieces_of_a_file(spark, tmp_path):
    """Cells with breaks of all kinds, read in pieces of any size, equal what Python's own reader finds, in order."""
    rnd = random.Random(3)
    cells = ["plain", "two\nlines", "dos\r\nbreak", 'a "quoted", word', "", "\n\n", "é€", "x" * 70, 'mid"quote', "tail\r"]
    rows = [[rnd.choice(cells) for _ in range(3)] for _ in range(40)]

    def written(cell):
        return cell if cell in ("plain", "", 'mid"quote', "é€") else '"' + cell.replace('"', '""') + '"'

    for end, mark in (("\n", ""), ("\r\n", "\ufeff")):
        text = mark + end + '"first\nheader",b,c' + end + "".join(",".join(map(written, r)) + end + (end if i % 7 == 0 else "") for i, r in enumerate(rows))
        path = tmp_path / f"folder {len(end)}"
        path.mkdir()
        (path / "with space, é 100%.csv").write_bytes(text.encode())
        want = [tuple(c.strip() for c in r) for r in rows if any(map(written, r))]
        for size in (90, 1_000_000):
            with several_pieces(spark, size):
                found = delimited.read_csv_text(spark, str(path), with_origin=True)
                assert found.columns[:3] == ["first\nheader", "b", "c"]
                got = sorted((tuple(r) for r in found.collect()), key=lambda r: r[3:])
            assert [g[:3] for g in got] == want


def test_a_cell_that_is_never_closed_is_an_error(spark, tmp_path):
    (tmp_path / "open.csv").write_text('a,b\n1,"x\n2,y\n')
    with pytest.raises(ValueError, match="not closed"):
        delimited.read_csv_text(spark, str(tmp_path / "open.csv"))


def test_json_shapes(spark, tmp_path):
    (tmp_path / "list.json").write_text(json.dumps([{"a": 1, "m": {"x": "y"}}, {"a": None, "m": {"x": "z"}}]))
    rows = json_records.read_json_records(spark, str(tmp_path / "list.json")).collect()
    assert [(r["a"], r["m"]["x"]) for r in rows] == [("1", "y"), ("", "z")]
    (tmp_path / "cols.json").write_text(json.dumps({"a": {"0": "p", "1": "q"}, "b": {"0": "r", "1": "s"}}))
    rows = json_records.read_json_records(spark, str(tmp_path / "cols.json")).collect()
    assert sorted(tuple(r) for r in rows) == [("p", "r"), ("q", "s")]


def test_an_object_of_many_columns_needs_no_schema_of_rows(spark, tmp_path):
    n = 20_000
    path = tmp_path / "cols.json"
    path.write_text(json.dumps({"name": {str(i): f" n{i}" for i in range(n)}, "email": {str(i): None if i % 2 else i for i in range(n)},
                                "more": {str(n): {"x": 1}}}))
    rows = json_records.read_json_records(spark, str(path))
    assert rows.columns == ["name", "email", "more"]
    got = [tuple(r) for r in rows.collect()]
    assert got == [(f"n{i}", "" if i % 2 else str(i), "") for i in range(n)] + [("", "", '{"x":1}')]
    (tmp_path / "one.json").write_text('{"a": {"x": 1}, "b": 2}')
    assert json_records.read_json_records(spark, str(tmp_path / "one.json")).first()["b"] == "2"


def test_grid_to_rows_of_a_run(spark):
    def cells(*texts):
        return [(t, "1") for t in texts] + [("", "2147483647")]

    grid_ = spark.createDataFrame([
        (1, 1, "1", cells("First Name", "surname", "E-Mail", "")), (1, 2, "1", cells("Ali", "Ben", "ali@x.dz", "1")), (1, 3, "2", cells("Sara", "K")),
        (2, 5, "1", cells("E-Mail", "E-Mail")), (2, 6, "1", cells("b@x.dz", "c@x.dz")), (3, 1, "1", cells(""))],
        "sheet_id int, row_no int, row_repeat string, cells array<struct<text:string,repeat:string>>")
    rows = grid.grid_rows(grid_).orderBy("row_id")
    assert sorted(rows.columns) == sorted(["row_id", "First Name", "surname", "E-Mail", "Unnamed: 3", "E-Mail.1"])
    found = [(r["row_id"], r["First Name"], r["E-Mail"], r["E-Mail.1"], r["Unnamed: 3"]) for r in rows.collect()]
    assert found == [(0, "Ali", "ali@x.dz", None, "1"), (1, "Sara", "", None, ""), (2, "Sara", "", None, ""), (3, None, "b@x.dz", "c@x.dz", None)]
    clean = run(rows.where("row_id < 2"), Settings(email_domain="x.org", forest_trees=0)).clean
    assert sorted(r["name"] for r in clean.collect()) == ["Ali Ben", "Sara K"]
    assert grid.grid_rows(grid_.where("sheet_id = 3")).count() == 0


def test_lookup_files(spark, tmp_path):
    (tmp_path / "l.json").write_text(json.dumps({"Math": ["m", "both"], "Art": {"aliases": ["both"]}, "k": "Value", "n": None}))
    got = lookups.as_dict(lookups.load_lookup(spark, str(tmp_path / "l.json")), 100)
    assert got == {"math": "Math", "m": "Math", "both": "Art", "art": "Art", "k": "Value", "value": "Value", "n": "n"}
    assert lookups.load_lookup(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "bad.json").write_text("{oops")
    assert lookups.load_lookup(spark, str(tmp_path / "bad.json")).count() == 0
    (tmp_path / "f.json").write_text(json.dumps({"FIELD_ALIASES": {"email": ["mail"], "x": 3}}))
    rows = lookups.load_field_aliases(spark, str(tmp_path / "f.json")).collect()
    assert {r["field"]: r["aliases"] for r in rows} == {"email": ["mail"], "x": []}


def test_grid(spark):
    def cells(*texts):
        return [(t, "1") for t in texts]

    rows = [(1, 1, "2", cells("")), (1, 2, "1", cells(" h1 ", "h2", "")), (1, 3, "2", cells("a", "b")), (1, 4, "1500", cells("")),
            (1, 5, "1", cells("c", "d", "e")), (1, 6, "1500", cells("")), (1, 7, "500", cells("", "")), (1, 8, "1", cells("lost"))]
    df = spark.createDataFrame(rows, "sheet_id int, row_no int, row_repeat string, cells array<struct<text:string,repeat:string>>")
    out = grid.read_grid(df, 5_000, 2_000, 100_000).orderBy("row_no", "copy_no", "position").collect()
    table = {}
    for r in out:
        table.setdefault((r["row_no"], r["copy_no"]), []).append((r["header"], r["value"]))
    assert list(table) == [(3, 1), (3, 2), (5, 1)]
    assert table[(3, 1)] == [("h1", "a"), ("h2", "b"), ("", "")] and table[(5, 1)][2] == ("", "e")


def test_a_grid_loses_nothing_by_default(spark):
    """More rows, repeats and blanks than any customary limit."""
    def cells(*texts):
        return [(t, "1") for t in texts]

    rows = [(1, 1, "1", cells("h")), (1, 2, "100000", cells("a")), (1, 3, "2001", cells("")), (1, 4, "5001", cells("b")), (1, 5, "1", [("c", "5001")])]
    df = spark.createDataFrame(rows, "sheet_id int, row_no int, row_repeat string, cells array<struct<text:string,repeat:string>>")
    seen = grid.cap_rows(grid.drop_blank_rows(grid.normal_rows(df))).selectExpr("count(*) as n", "max(size(cells)) as wide").first()
    assert (seen["n"], seen["wide"]) == (1 + 100_000 + 5_001 + 1, 5_001)
    cut = grid.cut_report(df, 5_000, 2_000, 4_000).first()
    assert (cut["rows"], cut["kept"]) == (105_003, 4_000)


def test_limits_of_a_grid_put_only_numbers_in_order(spark, monkeypatch):
    """Against a plain reading of random sheets; cells never travel with a running sum."""
    draw = random.Random(7)
    rows = []
    for sheet in range(12):
        for row_no in draw.sample(range(1_000), draw.randint(1, 60)):
            texts = [draw.choice(["", "", None, "x"]) for _ in range(draw.randint(0, 3))] if draw.random() < 0.7 else None
            rows.append((sheet, row_no, draw.choice(["1", "2", "9", "0", "many", None]), texts and [(t, draw.choice(["1", "3", "-1"])) for t in texts]))
    df = spark.createDataFrame(rows, "sheet_id int, row_no int, row_repeat string, cells array<struct<text:string,repeat:string>>")
    carried, running_sum = [], grid.running_sum
    monkeypatch.setattr(grid, "running_sum", lambda rows, *args, **named: carried.append(rows.columns) or running_sum(rows, *args, **named))
    repeat, blank_run, cap = 5, 6, 8
    kept, capped, report = [], [], []
    for sheet in range(12):
        whole = left = run = 0
        began = ended = False
        for _, row_no, times, cells in sorted((r for r in rows if r[0] == sheet), key=lambda r: r[1]):
            n = int(times) if times in ("1", "2", "9") else 1
            if not any(text for text, _ in cells or []):
                run += min(n, repeat) if began else 0
                ended = ended or run >= blank_run
                continue
            began, run, whole = True, 0, whole + n
            if not ended:
                kept.append((sheet, row_no, min(n, repeat)))
                capped += [(sheet, row_no, i + 1) for i in range(max(0, min(min(n, repeat), cap - left)))]
                left += min(n, repeat)
        report += [(sheet, whole, min(left, cap))] if whole else []
    found = grid.drop_blank_rows(grid.normal_rows(df, repeat), blank_run)
    assert sorted(tuple(r) for r in found.select("sheet_id", "row_no", "repeat").collect()) == kept
    assert sorted(tuple(r) for r in grid.cap_rows(found, cap).select("sheet_id", "row_no", "copy_no").collect()) == capped
    assert sorted(tuple(r) for r in grid.cut_report(df, repeat, blank_run, cap).collect()) == report
    assert len(kept) < sum(1 for r in rows if any(text for text, _ in r[3] or [])) and len(carried) == 3
    assert not any("cells" in columns for columns in carried)


def test_a_table_of_a_grid_reads_it_once_and_sums_numbers(spark, tmp_path):
    """Repeats, short rows, marks for nothing and a repeated first row; the grid itself is in no later plan."""
    rows = [(1, 1, "1", [("", "4")]), (1, 2, "3", [(" a ", "1"), ("b", "2"), ("", "x")]), (1, 3, "2", [("nan", "1"), (" 1 ", "2")]),
            (1, 4, "1", [(" v", "0")]), (2, 7, "1", [("b", "1"), ("", "1"), ("z", "1")]), (2, 9, "many", [("", "2"), ("None", "1")]), (3, 1, "1", [("a", "1")])]
    df = spark.createDataFrame(rows, "sheet_id int, row_no int, row_repeat string, cells array<struct<text: string, repeat: string>>")
    df.write.parquet(str(tmp_path / "grid"))
    table = grid.grid_table(spark.read.parquet(str(tmp_path / "grid")))
    assert table.columns == ["sheet_id", "row_no", "copy_no", "a", "b", "b.1", "Unnamed: 1", "z"]
    assert sorted((tuple(r) for r in table.collect()), key=str) == [
        (1, 2, 2, "a", "b", "b", None, None), (1, 2, 3, "a", "b", "b", None, None), (1, 3, 1, "", "1", "1", None, None),
        (1, 3, 2, "", "1", "1", None, None), (1, 4, 1, "v", "", "", None, None), (2, 9, 1, None, "", None, "", "")]
    assert not any(str(tmp_path) in file for file in table.inputFiles())


def test_csv_loses_no_column_and_no_field(spark, tmp_path):
    (tmp_path / "blank.csv").write_text("\n\nname,email\nAli,a@x.dz\n")
    (tmp_path / "broken.csv").write_text('"full\nname",email\nAli,a@x.dz\nZoé,"z\n@x.dz"\n')
    (tmp_path / "extra.csv").write_text("name,email\nAli,a@x.dz\nZoé,z@x.dz,EXTRA\n")
    (tmp_path / "short.csv").write_text("name,email\nAli\n")
    read = lambda name: delimited.read_csv_text(spark, str(tmp_path / name))
    assert read("blank.csv").columns == ["name", "email"] and [tuple(r) for r in read("blank.csv").collect()] == [("Ali", "a@x.dz")]
    assert read("broken.csv").columns == ["full\nname", "email"]
    assert [tuple(r) for r in read("broken.csv").collect()] == [("Ali", "a@x.dz"), ("Zoé", "z\n@x.dz")]
    assert [tuple(r) for r in read("short.csv").collect()] == [("Ali", "")]
    with pytest.raises(Exception, match="more fields than the 2 headers"):
        read("extra.csv").collect()


def test_aliases_of_a_long_entry_stay_apart(spark):
    entries = spark.createDataFrame([("A", json.dumps([f"a{i}" for i in range(100_001)]), 0), ("B", '["b"]', 1)], "key string, value string, ord int")
    assert lookups.flatten_lookup(entries).selectExpr("count(distinct ord) = count(*) as apart").first()["apart"]


def test_a_table_of_many_layouts_takes_one_pass(spark):
    cell = lambda text: (text, "1")
    rows = []
    for sheet in range(6):
        rows.append((sheet, 1, "1", [cell(f"h{sheet}"), cell("Same" if sheet % 2 else "same")]))
        rows.append((sheet, 2, "1", [cell(f"v{sheet}"), cell(f"s{sheet}")]))
    df = spark.createDataFrame(rows, "sheet_id int, row_no int, row_repeat string, cells array<struct<text: string, repeat: string>>")
    table = grid.grid_table(df)
    assert table.columns == ["sheet_id", "row_no", "copy_no", "h0", "same", "h1", "h2", "h3", "h4", "h5"]
    found = {row["sheet_id"]: row.asDict() for row in table.collect()}
    assert all(found[i]["same"] == f"s{i}" and found[i][f"h{i}"] == f"v{i}" for i in range(6))
    assert found[0]["h1"] is None
    # One reading of the rows, however many layouts there are.
    assert "Union" not in table._jdf.queryExecution().optimizedPlan().toString()
