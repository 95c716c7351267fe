import random

import pytest

from relata.operators.changes import apply_changes
from relata.operators.filters import to_ast
from relata.functions.types import fits_type
from relata.operators.aggregates import key_conflicts
from relata.catalog import Catalog, SchemaDef
from relata.plans.ingest import FieldSpec, ImportSpec, run_import
from relata.sources.stage import StageError, stage_csv, stage_file
from pyspark.sql import functions as F


def staged(spark, tmp_path, text, **kw):
    path = tmp_path / "f.csv"
    path.write_text(text)
    return [tuple(r) for r in stage_csv(spark, str(path), **kw).orderBy("id_import").collect()]


def test_lines_with_other_numbers_of_cells_are_refused(spark, tmp_path):
    for bad in ("a,b\n1,x\n2,y,EXTRA\n", "a,b\n1,x\n2\n"):
        with pytest.raises(StageError, match="lines 2 "):
            staged(spark, tmp_path, bad)
    assert staged(spark, tmp_path, 'a,b\n1,"x, ""y"""\n2,\n') == [(1, "1", 'x, "y"'), (2, "2", None)]


def test_quoted_line_breaks_are_read(spark, tmp_path):
    assert staged(spark, tmp_path, 'a,b\n1,"x\ny"\n2,z\n') == [(1, "1", "x\ny"), (2, "2", "z")]
    assert staged(spark, tmp_path, 'a,b\n\n1,"x\n\n\ny,"",z"\n\n"2\n",z\n') == [(1, "1", 'x\n\n\ny,",z'), (2, "2\n", "z")]


def random_file(rnd, n):
    rows, text = [], "a;b;c\n"
    for _ in range(n):
        row = ["".join(rnd.choice(['"', ";", "\n", "x", "\u00e9", " ", "\n\n"]) for _ in range(rnd.randrange(6))) for _ in range(2)] + ["end"]
        text += ";".join('"' + c.replace('"', '""') + '"' if rnd.random() < 0.7 or set(c) & set('";\n ') else c for c in row) + "\n" * rnd.choice([1, 1, 2])
        rows.append(tuple(c or None for c in row))
    return rows, text


def test_multiline_files_are_split_over_tasks(spark, tmp_path):
    rnd = random.Random(9)
    files = {}
    (tmp_path / "many.csv").mkdir()
    for name in ("0", "1", "2"):
        files[name], text = random_file(rnd, 300)
        (tmp_path / "many.csv" / f"{name}.csv").write_text(text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("150", "1000", old):  # splits within records, and one split a file
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            df = stage_csv(spark, str(tmp_path / "many.csv"))
            assert size == old or spark.read.text(str(tmp_path / "many.csv")).rdd.getNumPartitions() > 3
            got = [tuple(r) for r in df.orderBy("id_import").collect()]
            assert [r[0] for r in got] == list(range(1, 901))
            assert [r[1:] for r in got] == files["0"] + files["1"] + files["2"], size
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_bad_records_are_error_rows(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text('a,b\n1,x\n2\n3,"y\nz"\n4,u,v\n5,w\n')
    s = stage_file(spark, str(path))
    assert sorted((r.id_import, r.a, r.b) for r in s.rows.collect()) == [(1, "1", "x"), (3, "3", "y\nz"), (5, "5", "w")]
    assert sorted((r.error_code, r.lines, r.msg) for r in s.errors.collect()) == [
        ("ERR_IMPORT_DATA_LINE_CELLS", [2], "2"), ("ERR_IMPORT_DATA_LINE_CELLS", [4], "4,u,v")]
    path.write_text('a,b\n1,x\n2,"y\n3,z\n')  # a quote that nothing closes costs its own line
    s = stage_file(spark, str(path))
    assert sorted((r.id_import, r.a, r.b) for r in s.rows.collect()) == [(1, "1", "x"), (3, "3", "z")]
    assert [(r.error_code, r.lines) for r in s.errors.collect()] == [("ERR_IMPORT_DATA_QUOTE", [2])]
    for name, text, code in (("f.xml", "a,b\n", "FILE_TYPE_NOT_FOUND"), ("none.csv", None, "FILE_NOT_FOUND"), ("e.csv", "", "DATA_EMPTY"),
                             ("d.csv", "a b\n1 2\n", "DELIMITER_NOT_FOUND")):
        if text is not None:
            (tmp_path / name).write_text(text)
        (row,) = stage_file(spark, str(tmp_path / name)).errors.collect()
        assert code in row.error_code


def test_an_import_reports_bad_records(spark, tmp_path):
    frame = spark.createDataFrame([], "id long, code string, name string")
    cat = Catalog(spark, lambda t: frame)
    cat.add(SchemaDef("t", "t", "id", unique=["code"]))
    spec = ImportSpec("t", unique=["code"], fields={"code": FieldSpec("string"), "name": FieldSpec("string")})
    path = tmp_path / "f.csv"
    path.write_text("code;name\na;x\nb\n")
    r = run_import(cat, spec, stage_file(spark, str(path)))
    assert (r.status, r.last_step, r.res["nb_data"], r.res["nb_bad"]) == ("ERROR", "data_table", 1, 1)
    assert [(e.error_code, e.lines) for e in r.errors.collect()] == [("ERR_IMPORT_DATA_LINE_CELLS", [2])]
    r = run_import(cat, spec, stage_file(spark, str(tmp_path / "none.csv")))
    assert r.status == "ERROR" and r.errors.first().error_code == "ERR_IMPORT_DATA_FILE_NOT_FOUND"
    path.write_text("code;name\na;x\nb;y\n")
    steps = str(tmp_path / "steps")
    for resumed in (0, 12):
        r = run_import(cat, spec, stage_file(spark, str(path)), steps=steps)
        assert (r.status, r.res["nb_insert"], len(r.resumed)) == ("DONE", 2, resumed)


def test_two_changes_of_one_key_give_one_row(spark):
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    changes = spark.createDataFrame([(1, "x", "update"), (1, "y", "update"), (2, "z", "update"), (2, None, "delete"), (3, "n", "insert")],
                                    "k long, v string, op string")
    assert sorted(tuple(r) for r in apply_changes(table, changes, ["k"]).collect()) == [(1, "y"), (3, "n")]


def test_value_forms_are_strict(spark):
    rows = [("integer", "12d", False), ("number", "1f", False), ("number", "-1.5e3", True), ("date", "2020", False), ("date", "2020-01", False),
            ("date", "2020-02-30", False), ("date", "2020-02-29", True), ("datetime", "2020-01-01 10:00", True), ("integer", " 7 ", True)]
    for kind, value, want in rows:
        assert spark.range(1).select(fits_type(F.lit(value), kind)).first()[0] is want, (kind, value)


def test_conflicts_of_null_keys_list_their_lines(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, None, "b"), (3, "k", "c")], "id_import long, key string, v string")
    (row,) = key_conflicts(df, ["key"], ["v"]).collect()
    assert row.key is None and row.nb_lines == 2 and row.lines


def test_whole_number_lists_are_pushed_down(spark, cat, capsys):
    from relata.plans.list_query import ListQuery

    ListQuery(cat, "order", fields=["o_orderkey"], filters="o_orderkey in 1;2;3").build().explain()
    assert "In(o_orderkey" in capsys.readouterr().out.replace("PushedFilters: [", "")
    assert to_ast("a = 1,!,b = 2") == ("and", ("atom", {"field": "a", "type": "=", "value": "1"}), ("not", ("atom", {"field": "b", "type": "=", "value": "2"})))
