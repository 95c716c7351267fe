"""Feature loads: inline rows and files, defaults, copies, nested records, errors row by row."""

import json

import pytest

from relata.catalog import Catalog, Relation, SchemaDef
from relata.plans.ingest import ChildSpec, FieldSpec, ImportSpec, load_features
from relata.sources.stage import StageError, feature_frame


@pytest.fixture()
def objects(spark):
    frames = {
        "org": spark.createDataFrame([(1, "N"), (2, "S")], "id_org long, name string"),
        "site": spark.createDataFrame([(1, "old", 1, 1, 5)], "id long, code string, owner long, manager long, height int"),
        "actor": spark.createDataFrame([], "id_actor long, id_site long, id_org long")}
    cat = Catalog(spark, lambda t: frames[t])
    cat.add(SchemaDef("org", "org", "id_org", unique=["name"]))
    cat.add(SchemaDef("site", "site", "id", unique=["code"], relations={"actors": Relation("actors", "1-n", "actor", "id", "id_site")}))
    cat.add(SchemaDef("actor", "actor", "id_actor"))
    specs = {
        "org": ImportSpec("org", unique=["name"], fields={"name": FieldSpec("string", required=True)}),
        "site": ImportSpec("site", unique=["code"], fields={
            "code": FieldSpec("string", required=True), "owner": FieldSpec(ref="org", ref_unique=["name"]), "manager": FieldSpec("integer"),
            "height": FieldSpec("integer")},
            children={"actors": ChildSpec("actor", "id_site", {"id_org": FieldSpec(ref="org", ref_unique=["name"], required=True)})})}
    return cat, specs


ROWS = [
    {"code": "old", "owner": "S", "height": 7},  # update; manager is copied from owner
    {"code": "a", "owner": "W", "unknown": 1, "actors": [{"id_org": "N"}, {"id_org": "W"}]},  # W comes with the group before
    {"code": "b", "owner": "nobody", "height": "tall"},  # two errors
    {"code": "c", "actors": [{"id_org": "nobody"}]},
    {"height": 3},
    {"height": 4},
    {"code": "d", "owner": "N", "manager": 2},
    {"code": "e", "owner": "N", "manager": 2},
    {"code": "d", "owner": "S", "manager": None},  # the last row of a key counts
]


def check(out):
    r = out["site"]
    assert r.status == "DONE", r.errors.collect()
    assert sorted((e.id_import, e.error_code, e.key, e.value) for e in r.row_errors.collect()) == [
        (3, "ERR_IMPORT_INVALID_VALUE_FOR_TYPE", "height", "tall"), (3, "ERR_IMPORT_UNRESOLVED", "owner", "nobody"), (4, "ERR_IMPORT_UNRESOLVED", "actors.id_org", "nobody"),
        (5, "ERR_IMPORT_REQUIRED", "code", None),
        (6, "ERR_IMPORT_REQUIRED", "code", None)]
    org = {x.name: x.id_org for x in out["org"].table.collect()}
    assert sorted((x.code, x.owner, x.manager, x.height) for x in r.table.collect()) == [
        ("a", org["W"], org["W"], 9), ("d", org["S"], org["S"], 9), ("e", org["N"], 2, 9), ("old", org["S"], org["S"], 7)]
    site = {x.code: x.id for x in r.table.collect()}
    assert sorted((x.id_site, x.id_org) for x in r.children["actors"].collect()) == sorted([(site["a"], org["N"]), (site["a"], org["W"])])


def test_inline_rows_and_files_give_the_same(spark, objects, tmp_path):
    cat, specs = objects
    orgs = {"code": "org", "keys": ["name"], "items": [["W"]]}
    site = {"code": "site", "defaults": {"height": 9}, "copy": {"owner": ["manager"]}, "dependencies": ["org"]}
    check(load_features(cat, [{**site, "items": ROWS}, orgs], specs))
    (tmp_path / "sites.jsonl").write_text("\n".join(json.dumps(r) for r in ROWS) + "\n\n")
    (tmp_path / "orgs.jsonl").write_text('["W"]\n')
    cat.set_frame("org", spark.createDataFrame([(1, "N"), (2, "S")], "id_org long, name string"))
    cat.set_frame("site", spark.createDataFrame([(1, "old", 1, 1, 5)], "id long, code string, owner long, manager long, height int"))
    files = [{**site, "file": str(tmp_path / "sites.jsonl")}, {**orgs, "items": None, "file": str(tmp_path / "orgs.jsonl")}]
    check(load_features(cat, files, specs))


def test_rows_that_do_not_fit_are_errors_of_their_own(spark, tmp_path):
    path = tmp_path / "f.jsonl"
    path.write_text('["1", "x"]\n["2"]\n\n{"a": 3, "b": [1, 2]}\n{"a": \n"text"\n[4, null]\n')
    s = feature_frame(spark, {"keys": ["a", "b"], "file": str(path), "defaults": {"b": "none", "c": "z"}})
    assert sorted((r.id_import, r.a, r.b, r.c) for r in s.rows.collect()) == [(1, "1", "x", "z"), (3, "3", "[1,2]", "z"), (6, "4", "none", "z")]
    assert sorted((r.lines[0], r.error_code) for r in s.errors.collect()) == [
        (2, "ERR_FEATURE_ROW_LENGTH"), (4, "ERR_FEATURE_ROW_FORM"), (5, "ERR_FEATURE_ROW_FORM")]
    assert feature_frame(spark, {"file": str(tmp_path / "none.jsonl")}).fault.code == "ERR_IMPORT_DATA_FILE_NOT_FOUND"


def test_a_missing_file_ends_the_load(objects, tmp_path):
    cat, specs = objects
    with pytest.raises(StageError):
        load_features(cat, [{"code": "org", "file": str(tmp_path / "none.jsonl")}], specs)
