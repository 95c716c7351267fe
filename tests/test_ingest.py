"""Import pipeline on small delimited files (shapes of the reference's import fixtures)."""

import os

import pytest
from pyspark.sql import functions as F

from relata.catalog import Catalog, Relation, SchemaDef
from relata.operators.geo import GEOM_DDL
from relata.plans.ingest import ChildSpec, FieldSpec, ImportSpec, MappingError, map_fields, run_import
from relata.sources.stage import StageError, stage_csv

from conftest import FIXTURES

D = os.path.join(FIXTURES, "import")


@pytest.fixture(scope="module")
def fx(spark):
    frames = {
        "site": spark.createDataFrame([], f"id_site long, uuid_site string, site_name string, geom {GEOM_DDL}"),
        "actor": spark.createDataFrame([], "id_actor long, id_site long, id_organism long, id_type int"),
        "organism": spark.createDataFrame([(1, "North roads office"), (2, "River board")], "id_organism long, org_name string"),
        "nomenclature": spark.createDataFrame(
            [(1, "material", "CON", "Concrete"), (2, "material", "STE", "Steel"), (3, "material", "WOO", "Wood"),
             (4, "actor_type", "OWN", "Owner"), (5, "actor_type", "OPE", "Operator"), (6, "area_type", "DIST", "District")],
            "id_nomenclature int, type string, cd_nomenclature string, label string"),
        "area": spark.createDataFrame([], f"id_area long, id_type int, area_name string, area_code string, geom {GEOM_DDL}"),
        "linear_type": spark.createDataFrame([], "id_type long, type_code string, type_name string, type_desc string"),
    }
    cat = Catalog(spark, lambda t: frames[t])
    cat.add(SchemaDef("site", "site", "id_site", unique=["uuid_site"], label="site_name", geometry="geom",
                      relations={"actors": Relation("actors", "1-n", "actor", "id_site", "id_site")}))
    cat.add(SchemaDef("actor", "actor", "id_actor", relations={
        "site": Relation("site", "n-1", "site", "id_site", "id_site"),
        "organism": Relation("organism", "n-1", "organism", "id_organism", "id_organism")}))
    cat.add(SchemaDef("organism", "organism", "id_organism", unique=["org_name"], label="org_name"))
    cat.add(SchemaDef("nomenclature", "nomenclature", "id_nomenclature", unique=["type", "cd_nomenclature"], bounded=True))
    cat.add(SchemaDef("area", "area", "id_area", unique=["id_type", "area_code"], geometry="geom"))
    cat.add(SchemaDef("linear_type", "linear_type", "id_type", unique=["type_code"]))
    return cat, frames


def site_spec(**kw):
    return ImportSpec(
        "site", unique=["uuid_site"],
        fields={
            "uuid_site": FieldSpec("uuid", default_uuid=True),
            "site_name": FieldSpec("string", required=True),
            "geom": FieldSpec("geometry", srid=4326),
            "materials": FieldSpec(nn="nomenclature", code_type="material"),
        },
        children={"actors": ChildSpec("actor", "id_site", {
            "id_organism": FieldSpec(ref="organism", ref_unique=["org_name"], required=True),
            "id_type": FieldSpec(code_type="actor_type", required=True),
        })},
        **kw,
    )


def counts(r, keys=("nb_data", "nb_insert", "nb_update", "nb_unchanged")):
    return tuple(r.res.get(k) for k in keys)


def run(spark, fx, name, spec=None, **kw):
    cat, _ = fx
    return run_import(cat, spec or site_spec(), stage_csv(spark, os.path.join(D, name)), **kw)


def test_simple(spark, fx):
    r = run(spark, fx, "site_simple.csv")
    assert r.status == "DONE", r.errors.collect()
    assert counts(r) == (1, 1, 0, 0)
    row = r.table.first()
    assert row.uuid_site == "0a1b2c3d-0000-4000-8000-000000000001" and row.geom.kind == "POINT"


def test_generated_uuid(spark, fx):
    r = run(spark, fx, "site_generated_uuid.csv")
    assert counts(r) == (1, 1, 0, 0)
    assert r.table.first().uuid_site is not None


def test_missing_uuid_column(spark, fx):
    r = run(spark, fx, "site_missing_uuid.csv")
    assert counts(r, ("nb_data", "nb_raw", "nb_process", "nb_insert", "nb_update")) == (2, 2, 2, 2, 0)
    assert r.table.select("uuid_site").distinct().count() == 2


def test_xy_point(spark, fx):
    r = run(spark, fx, "site_xy.csv")
    assert counts(r) == (1, 1, 0, 0)
    g = r.table.first().geom
    assert (g.bbox.xmin, g.bbox.ymin) == (5.95, 45.58)


def test_update_only_list_changed(spark, fx):
    r1 = run(spark, fx, "site_update_1.csv")
    assert counts(r1) == (1, 1, 0, 0)
    r2 = run(spark, fx, "site_update_2.csv", target=r1.table, links=r1.links)
    assert counts(r2) == (1, 0, 1, 0)
    codes = sorted(x["__link"] for x in r2.links["materials"].collect())
    assert codes == [1, 2]
    # invariant: the same file again changes nothing
    r3 = run(spark, fx, "site_update_2.csv", target=r2.table, links=r2.links)
    assert counts(r3) == (1, 0, 0, 1)


def test_children(spark, fx):
    r = run(spark, fx, "site_actors.csv")
    assert r.status == "DONE", r.errors.collect()
    assert counts(r, ("nb_data", "nb_raw", "nb_process", "nb_insert", "nb_update")) == (2, 2, 1, 1, 0)
    kids = r.children["actors"].collect()
    assert len(kids) == 2 and {k.id_organism for k in kids} == {1, 2}
    assert {k.id_site for k in kids} == {r.table.first().id_site}


def test_error_invalid_type(spark, fx):
    r = run(spark, fx, "site_err_type.csv")
    assert r.status == "ERROR" and r.last_step == "pre_check"
    e = r.errors.collect()
    assert [(x.error_code, x.key) for x in e] == [("ERR_IMPORT_INVALID_VALUE_FOR_TYPE", "geom")]


def test_error_required_child(spark, fx):
    r = run(spark, fx, "site_err_required.csv")
    assert r.status == "ERROR"
    e = r.errors.collect()
    assert ("ERR_IMPORT_REQUIRED", "actors.id_organism") in [(x.error_code, x.key) for x in e]


def test_error_unresolved_child_codes(spark, fx):
    r = run(spark, fx, "site_err_unresolved.csv")
    assert r.status == "ERROR"
    e = [x for x in r.errors.collect() if x.error_code == "ERR_IMPORT_UNRESOLVED"]
    assert [(x.value, x.nb_lines) for x in sorted(e, key=lambda x: -x.nb_lines)] == [("holder", 2), ("tenant", 1)]
    assert "OPE" in e[0].valid_values


def area_spec(**kw):
    return ImportSpec("area", unique=["id_type", "area_code"], fields={
        "id_type": FieldSpec(code_type="area_type", required=True),
        "area_name": FieldSpec("string"), "area_code": FieldSpec("string"),
        "geom": FieldSpec("geometry", srid=4326)}, **kw)


def test_area_quoted_wkt_and_blank_header(spark, fx):
    staged = stage_csv(spark, os.path.join(D, "area.csv"))
    assert "area_code" in staged.columns
    cat, _ = fx
    r = run_import(cat, area_spec(), staged)
    assert counts(r) == (2, 2, 0, 0), r.errors.collect()
    assert {x.geom.kind for x in r.table.collect()} == {"POLYGON"}


def test_area_srid_option(spark, fx):
    r = run(spark, fx, "area_l93.csv", spec=area_spec(srid=2154, skip_check_on=[]))
    assert counts(r) == (1, 1, 0, 0), r.errors.collect()
    g = r.table.first().geom
    assert g.srid == 4326 and 4.0 < g.bbox.xmin < 8.0 and 44.0 < g.bbox.ymin < 47.0


def test_semicolon_plain(spark, fx):
    spec = ImportSpec("linear_type", unique=["type_code"], fields={
        "type_code": FieldSpec("string"), "type_name": FieldSpec("string"), "type_desc": FieldSpec("string")})
    r = run(spark, fx, "linear_type.csv", spec=spec)
    assert counts(r) == (2, 2, 0, 0)
    assert sorted(x.id_type for x in r.table.collect()) == [1, 2]


def test_stage_errors(spark, tmp_path):
    with pytest.raises(StageError) as e:
        stage_csv(spark, str(tmp_path / "none.csv"))
    assert e.value.code == "ERR_IMPORT_DATA_FILE_NOT_FOUND"
    p = tmp_path / "nodelim.csv"
    p.write_text("single\nvalue\n")
    with pytest.raises(StageError) as e:
        stage_csv(spark, str(p))
    assert e.value.code == "ERR_IMPORT_CSV_FILE_DELIMITER_NOT_FOUND"


def test_line_ids_in_file_order(spark):
    df = stage_csv(spark, os.path.join(D, "site_err_unresolved.csv"))
    assert [(r.id_import, r.site_name) for r in df.orderBy("id_import").collect()] == [
        (1, "Site one"), (2, "Site two"), (3, "Site three")]


def test_mapping(spark):
    df = spark.createDataFrame([(1, "a", "b")], "id_import long, x string, y string")
    out = map_fields(df, {"kind": "'RTE'", "name": "x", "full": "CONCAT(x, '-', y)", "flag": True, "extra": ["x", "y"],
                          "ignored": "no_such_column"}, {"name": {"a": "A"}})
    r = out.first()
    assert (r.kind, r.name, r.full, r.flag, r.extra) == ("RTE", "A", "a-b", True, '{"x":"a","y":"b"}')
    assert "ignored" not in out.columns and "y" in out.columns
    with pytest.raises(MappingError):
        map_fields(df, {"bad": "(SELECT 1); DROP TABLE t"})
    with pytest.raises(MappingError):
        map_fields(df, {"bad": "CONCAT(x, 'DELETE FROM t')"})


def test_line_ids_many_splits(spark, tmp_path):
    p = tmp_path / "many.csv"
    with open(p, "w") as f:
        f.write("a;b\n")
        for i in range(3000):
            f.write(f"{i};text {i}\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = stage_csv(spark, str(p))
        assert df.rdd.getNumPartitions() > 5
        bad = df.filter(F.col("id_import") != F.col("a").cast("long") + 1).count()
        assert bad == 0 and df.count() == 3000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_feature_load_dependencies(spark, fx):
    from relata.plans.ingest import load_features

    cat, frames = fx
    groups = [
        {"code": "actor", "keys": ["id_site", "id_organism", "id_type"], "items": [["0a1b2c3d-0000-4000-8000-00000000000f", "River board", "OWN"]],
         "dependencies": ["site"]},
        {"code": "site", "keys": ["uuid_site", "site_name"], "items": [["0a1b2c3d-0000-4000-8000-00000000000f", "Feature site"]],
         "defaults": {"geom": "POINT(5 45)"}},
    ]
    specs = {
        "site": ImportSpec("site", unique=["uuid_site"], fields={
            "uuid_site": FieldSpec("uuid"), "site_name": FieldSpec("string"), "geom": FieldSpec("geometry", srid=4326)}),
        "actor": ImportSpec("actor", unique=["id_site", "id_organism"], fields={
            "id_site": FieldSpec(ref="site", ref_unique=["uuid_site"]), "id_organism": FieldSpec(ref="organism", ref_unique=["org_name"]),
            "id_type": FieldSpec(code_type="actor_type")}),
    }
    try:
        out = load_features(cat, groups, specs)
        assert list(out) == ["site", "actor"]
        assert out["site"].res["nb_insert"] == 1 and out["actor"].status == "DONE", out["actor"].errors.collect()
        a = out["actor"].table.first()
        assert (a.id_organism, a.id_type) == (2, 4) and a.id_site == out["site"].table.first().id_site
    finally:
        cat.set_frame("site", frames["site"])
        cat.set_frame("actor", frames["actor"])


def test_multi_geometry_wrap(spark, fx):
    cat, _ = fx
    spec = area_spec()
    spec.fields["geom"] = FieldSpec("geometry", srid=4326, geometry_type="multipolygon")
    r = run_import(cat, spec, stage_csv(spark, os.path.join(D, "area.csv")))
    assert {x.geom.kind for x in r.table.collect()} == {"MULTIPOLYGON"}


def test_preview_stops_after_count(spark, fx):
    r = run(spark, fx, "site_missing_uuid.csv", spec=site_spec(target_step="count"))
    assert r.status == "DONE" and r.last_step == "count" and r.table is None
    assert counts(r, ("nb_process", "nb_insert", "nb_update", "nb_unchanged")) == (2, 2, 0, 0)


def test_links_are_compared_in_tasks_of_bounded_size(spark, monkeypatch):
    """The comparison of links is dealt by the number of links, not by what AQE makes of their size."""
    from conftest import SF_SMALL
    from relata.plans import ingest
    from relata.queries import _order_parts_import
    from relata.sources.tables import load_table

    monkeypatch.setattr(ingest, "LINK_ROWS", 1000)
    r = _order_parts_import(spark, SF_SMALL)
    pairs = {(x.l_orderkey, x.l_partkey) for x in load_table(spark, SF_SMALL, "lineitem").select("l_orderkey", "l_partkey").collect()}
    last = {}
    for o, p in pairs:
        last.setdefault(o, []).append(p)
    dropped = {(o, max(ps)) for o, ps in last.items() if o % 5 == 0 and len(ps) > 1}
    tasks = 1 + (2 * len(pairs) - len(dropped)) // 1000
    plan = r.frames["diff_parts"]._jdf.queryExecution().analyzed().toString()
    assert f", {tasks}" in "".join(x for x in plan.splitlines() if "RepartitionByExpression" in x)
    links = r.links["parts"].collect()
    assert {(x["__pk"], x["__link"]) for x in links} == pairs - dropped and len(links) == len(pairs - dropped)
    r.release()


def test_keys_alone_are_not_searched_for_conflicts(spark):
    """Lines that hold nothing beside their key cannot differ: nothing is grouped; with another column they are."""
    from relata.plans.ingest import conflict_errors

    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "x"), (4, None, "x")], "id_import long, k string, v string")
    spec = ImportSpec("site", unique=["k"], fields={"k": FieldSpec("string"), "v": FieldSpec("string")})
    alone = conflict_errors(df, spec, ["k"])
    assert "Aggregate" not in alone._jdf.queryExecution().optimizedPlan().toString() and alone.collect() == []
    assert [(r.value, r.nb_lines, r.lines) for r in conflict_errors(df, spec, ["k", "v"]).collect()] == [("a", 2, [1, 2])]
    assert alone.schema.names == conflict_errors(df, spec, ["k", "v"]).schema.names
