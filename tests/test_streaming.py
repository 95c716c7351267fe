import os
import shutil

import pytest

from relata.catalog import Catalog, Relation, SchemaDef
from relata.plans.ingest import ChildSpec, FieldSpec, ImportSpec, run_import
from relata.sources import fs
from relata.sources.stage import stage_csv
from relata.streaming import inbox as inbox_module
from relata.streaming.inbox import commit_run, current, manifests, process_file, start_inbox, store

from conftest import FIXTURES


def test_inbox_imports_each_file_once(spark, tmp_path):
    inbox, state = tmp_path / "inbox", tmp_path / "state"
    inbox.mkdir()
    initial = spark.createDataFrame([], "id_type long, type_code string, type_name string, type_desc string")
    cat = Catalog(spark, lambda t: initial)
    cat.add(SchemaDef("linear_type", "linear_type", "id_type", unique=["type_code"]))
    spec = ImportSpec("linear_type", unique=["type_code"], fields={
        "type_code": FieldSpec("string"), "type_name": FieldSpec("string"), "type_desc": FieldSpec("string")})
    shutil.copy(os.path.join(FIXTURES, "import", "linear_type.csv"), inbox / "a.csv")
    runs = []
    start_inbox(spark, str(inbox), str(state), cat, spec, initial, on_run=runs.append)
    assert [r["status"] for r in runs] == ["DONE"] and runs[0]["res"]["nb_insert"] == 2
    # a second file with the same rows: imported once, all unchanged
    shutil.copy(os.path.join(FIXTURES, "import", "linear_type.csv"), inbox / "b.csv")
    start_inbox(spark, str(inbox), str(state), cat, spec, initial, on_run=runs.append)
    assert len(runs) == 2 and runs[1]["res"]["nb_unchanged"] == 2 and runs[1]["res"]["nb_insert"] == 0
    log = spark.read.parquet(str(state / "runs"))
    assert sorted(r.status for r in log.collect()) == ["DONE", "DONE", "PROCESSING", "PROCESSING"]


# ---------------------------------------------------------------- links and children of earlier files
@pytest.fixture()
def sites(spark):
    frames = {
        "site": spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, code string"),
        "tag": spark.createDataFrame([(i, f"t{i}") for i in range(1, 6)], "id_tag long, tag string"),
        "visit": spark.createDataFrame([], "id_visit long, id_site long, note string")}
    cat = Catalog(spark, lambda t: frames[t])
    cat.add(SchemaDef("site", "site", "id", unique=["code"], relations={"visits": Relation("visits", "1-n", "visit", "id", "id_site")}))
    cat.add(SchemaDef("tag", "tag", "id_tag", unique=["tag"]))
    cat.add(SchemaDef("visit", "visit", "id_visit"))
    spec = ImportSpec("site", unique=["code"], fields={"code": FieldSpec("string", required=True), "tags": FieldSpec(nn="tag")},
                      children={"visits": ChildSpec("visit", "id_site", {"note": FieldSpec("string")})})
    return cat, spec, frames["site"]


FILES = ["code;tags;visits.note\na;t1,t2;first\n", "code;tags;visits.note\nb;t3;second\n", "code;tags;visits.note\nd;t4;third\na;t2,t5;\n"]


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_three_files_keep_links_and_children(spark, tmp_path, sites):
    cat, spec, initial = sites
    inbox, state = tmp_path / "inbox", str(tmp_path / "state")
    inbox.mkdir()
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    for i, text in enumerate(FILES):
        (inbox / f"{i}.csv").write_text(text)
        start_inbox(spark, str(inbox), state, cat, spec, initial)
    table, links, children = store(spark, state)
    assert rows(table, "id", "code") == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    assert rows(links["tags"], "__pk", "__link") == [(1, 2), (1, 5), (2, 3), (4, 4)]
    assert rows(children["visits"], "id_site", "note") == [(1, "first"), (2, "second"), (4, "third")]
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == cached  # every run was released


def test_a_run_killed_between_two_writes_leaves_the_store(spark, tmp_path, sites, monkeypatch):
    cat, spec, initial = sites
    state = str(tmp_path / "state")
    paths = []
    for i, text in enumerate(FILES[:2]):
        paths.append(str(tmp_path / f"{i}.csv"))
        open(paths[-1], "w").write(text)
    process_file(spark, cat, spec, paths[0], state, 0, initial)
    before = current(spark, state)

    def lost(*_):
        raise OSError("disk full")

    monkeypatch.setattr(fs, "write_text", lost)
    with pytest.raises(OSError):  # links, children and table are written, the manifest is not: the batch fails
        process_file(spark, cat, spec, paths[1], state, 1, initial)
    monkeypatch.undo()
    assert current(spark, state) == before and manifests(spark, state) == [0]
    assert process_file(spark, cat, spec, paths[1], state, 1, initial)["status"] == "DONE"
    assert rows(store(spark, state)[1]["tags"], "__pk", "__link") == [(1, 1), (1, 2), (2, 3)]
    # replayed once more: nothing is done twice
    monkeypatch.setattr(inbox_module, "run_import", lost)
    assert process_file(spark, cat, spec, paths[1], state, 1, initial)["status"] == "DONE"


def test_bad_file_is_recorded_other_failures_are_raised(spark, tmp_path, sites, monkeypatch):
    cat, spec, initial = sites
    state, bad = str(tmp_path / "state"), tmp_path / "bad.csv"
    bad.write_text("only one column\nx\n")
    assert process_file(spark, cat, spec, str(bad), state, 0, initial)["status"] == "ERROR"
    assert manifests(spark, state) == []

    def broken(*_, **__):
        raise RuntimeError("executor lost")

    monkeypatch.setattr(inbox_module, "run_import", broken)
    bad.write_text(FILES[0])
    with pytest.raises(RuntimeError):
        process_file(spark, cat, spec, str(bad), state, 1, initial)


# ---------------------------------------------------------------- resume
def test_import_resumes_after_the_last_good_step(spark, tmp_path, sites):
    cat, spec, initial = sites
    path, steps = tmp_path / "a.csv", str(tmp_path / "steps")
    path.write_text(FILES[2])
    spec.target_step = "raw_view"
    first = run_import(cat, spec, stage_csv(spark, str(path)), steps=steps)
    assert (first.status, first.resumed) == ("PENDING", [])
    path.write_text("code;tags;visits.note\n")  # the source is not read again
    spec.target_step = None
    r = run_import(cat, spec, spark.createDataFrame([], "id_import long, code string"), steps=steps)
    assert r.status == "DONE" and r.resumed == ["init", "data_table", "mapping_view", "pre_check", "raw_view"]
    assert (r.res["nb_data"], r.res["nb_process"], r.res["nb_insert"]) == (2, 2, 1)
    assert rows(r.links["tags"], "__pk", "__link") == [(1, 2), (1, 5), (4, 4)]
    # a run that is complete gives the same result from its steps
    again = run_import(cat, spec, spark.createDataFrame([], "id_import long, code string"), steps=steps)
    assert again.status == "DONE" and len(again.resumed) == len(r.steps) and again.res == r.res
    assert rows(again.table, "id", "code") == rows(r.table, "id", "code")
    # another definition does not take these steps
    spec.fields["code"] = FieldSpec("string")
    assert run_import(cat, spec, spark.createDataFrame([], "id_import long, code string"), steps=steps).status == "ERROR"


def test_a_step_with_errors_is_not_logged(spark, tmp_path, sites):
    cat, spec, initial = sites
    path, steps = tmp_path / "a.csv", str(tmp_path / "steps")
    path.write_text("code;tags\na;t9\n")
    for resumed in ([], ["init", "data_table", "mapping_view", "pre_check", "raw_view", "import_view", "relations_view"]):
        r = run_import(cat, spec, stage_csv(spark, str(path)), steps=steps)
        assert (r.status, r.last_step, r.resumed) == ("ERROR", "post_check", resumed)
        assert [e.value for e in r.errors.collect()] == ["t9"]


def test_commit_keeps_parts_that_a_run_does_not_touch(spark, tmp_path, sites):
    cat, spec, initial = sites
    state = str(tmp_path / "state")
    path = tmp_path / "a.csv"
    path.write_text(FILES[0])
    first = commit_run(spark, state, 0, run_import(cat, spec, stage_csv(spark, str(path))))
    path.write_text("code\nz\n")
    r = run_import(cat, spec, stage_csv(spark, str(path), delimiter=";"), target=store(spark, state)[0])
    assert commit_run(spark, state, 1, r)["links"] == first["links"]
