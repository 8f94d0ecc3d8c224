from datetime import date

import pytest

from tidemark.plans.catalog import Catalog, CatalogError, DropBehavior, FkAction, FkMatch, KeyType, make_name
from tidemark.sources.snapshots import SnapshotTable
from tidemark.streaming.merge_stream import merge_batches

D = date.fromisoformat
UNITS = "id int, code string, name string, note string, valid_from date, valid_until date"


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame([(1, "A", "one", "n", D("2024-01-01"), D("2025-01-01")), (2, "B", "two", "n", D("2024-01-01"), D("9999-12-31"))], UNITS)


def catalog(units):
    c = Catalog()
    c.add_era("unit", units, ephemeral=["note"])
    c.add_unique_key("unit", ["id"], KeyType.PRIMARY)
    c.add_unique_key("unit", ["code"])
    return c


def test_eras_are_checked(spark, units):
    c = catalog(units)
    for bad in (dict(name="Bad Name"), dict(valid_from="nope"), dict(valid_to="name"), dict(name="v2", ephemeral=["valid_from"]), dict()):
        with pytest.raises((CatalogError, TypeError)):
            c.add_era("unit", units, **bad)
    empty = spark.createDataFrame([(1, "A", "x", "n", D("2024-01-01"), D("2024-01-01"))], UNITS)
    with pytest.raises(CatalogError, match="without a period"):
        c.add_era("other", empty)
    with pytest.raises(CatalogError, match="depend"):
        c.drop_era("unit")
    c.set_ephemeral("unit", [], units)
    c.drop_era("unit", behavior=DropBehavior.CASCADE)
    assert not c.eras and not c.unique_keys


def test_keys_and_dependencies(units):
    c = catalog(units)
    with pytest.raises(CatalogError):
        c.add_unique_key("unit", ["name"], KeyType.PREDICATED)
    with pytest.raises(CatalogError):
        c.add_unique_key("unit", ["name"], KeyType.PRIMARY)
    with pytest.raises(CatalogError):
        c.add_unique_key("unit", ["name"], KeyType.EXCLUSIVE, exclusive_columns=["other"])
    c.add_era("child", units)
    with pytest.raises(CatalogError):
        c.add_foreign_key("child", ["name"], "unit", ["name"])
    with pytest.raises(CatalogError):
        c.add_foreign_key("child", ["id"], "unit", ["id"], on_delete="cascade")
    fk = c.add_foreign_key("child", ["id"], "unit", ["id"], match=FkMatch.FULL, on_delete=FkAction.RESTRICT)
    assert fk.kind == "temporal_to_temporal" and c.add_foreign_key("log", ["id"], "unit", ["id"]).kind == "regular_to_temporal"
    with pytest.raises(CatalogError, match="depend"):
        c.drop_unique_key("unit_id_valid")
    for column in ("id", "note", "valid_from", "code"):
        with pytest.raises(CatalogError):
            c.check_drop_column("unit", column)
    c.check_drop_column("unit", "name")
    with pytest.raises(CatalogError, match="refer"):
        c.drop_table("unit")
    c.rename_column("unit", "code", "key")
    assert ["key"] in [k.columns for k in c.unique_keys]
    c.add_system_versioning("unit", ["note"])
    c.set_excluded_columns("unit", [])
    c.add_view("unit", "current")
    assert Catalog.from_json(c.to_json()).to_json() == c.to_json()
    c.drop_unique_key("unit_id_valid", DropBehavior.CASCADE)
    assert not c.foreign_keys
    assert len(make_name("x" * 80, suffix="valid").encode()) <= 63 and make_name("x" * 80, suffix="valid").endswith("_valid")


def test_validation_and_suspension(spark, units):
    c = catalog(units)
    c.add_era("child", units)
    c.add_foreign_key("child", ["id"], "unit", ["id"])
    child = spark.createDataFrame([(1, "A", "x", "n", D("2024-06-01"), D("2026-01-01"))], UNITS)
    with pytest.raises(CatalogError, match="child_id_valid"):
        c.validate({"unit": units, "child": child})
    c.disable_checks("child")
    c.validate({"unit": units, "child": child})
    c.enable_checks("child")
    c.validate({"unit": units, "child": units})
    assert c.eras_frame(spark).count() == 2


def test_predicates_owners_and_what_is_kept(spark, units):
    c = catalog(units)
    c.add_unique_key("unit", ["note"], KeyType.PREDICATED, predicate="name = 'name''s' and note is not null", name="noted")
    c.rename_column("unit", "name", "label")
    assert [k.predicate for k in c.unique_keys if k.name == "noted"] == ["label = 'name''s' and note is not null"]
    with pytest.raises(CatalogError, match="noted"):
        c.check_drop_column("unit", "label")
    c.disable_checks("unit")
    assert Catalog.from_json(c.to_json()).suspended == {"unit"}
    own = catalog(units)
    moved = units.unionByName(spark.createDataFrame([(99, "A", "x", "n", D("2030-01-01"), D("2031-01-01"))], UNITS))
    broken = {n for n, rows in own.violations({"unit": moved}).items() if not rows.isEmpty()}
    assert {n for n in broken if n.endswith("_one_owner")} == {n for n in own.violations({"unit": moved}) if n.endswith("_one_owner")} != set()
    own.validate({"unit": units})


def test_merge_uses_what_is_known(spark, units):
    source = spark.createDataFrame([(1, None, "A", "new", "m", D("2024-06-01"), D("2024-07-01"))], "row_id int, " + UNITS)
    merged = catalog(units).merge("unit", units, source)
    assert merged.spec.identity == ("id",) and merged.spec.natural_keys == (("code",),) and merged.spec.ephemeral == ("note",)
    assert merged.target_after.where("id = 1").count() == 3


def test_snapshots_and_streaming_merge(spark, units, tmp_path):
    table = SnapshotTable(spark, f"file://{tmp_path}/unit")
    assert not table.exists()
    table.write(units)
    schema = "row_id int, " + UNITS
    for k in range(2):
        rows = [(k, 1, "A", f"v{k}", "n", D(f"2024-0{k + 2}-01"), D(f"2024-0{k + 3}-01"))]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    told = []
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    merge_batches(stream, table, f"{tmp_path}/checkpoint", on_feedback=lambda n, f: told.extend(r["status"] for r in f.collect()), identity=["id"]).awaitTermination()
    assert told == ["APPLIED"] * 2 and table.version() == 3
    assert sorted(r["name"] for r in table.read().where("id = 1").collect()) == ["one", "one", "v0", "v1"]
    assert table.read(1).count() == 2


def test_a_batch_that_is_run_again_is_not_merged_twice(spark, units, tmp_path):
    import shutil

    table = SnapshotTable(spark, f"file://{tmp_path}/unit")
    table.write(units)
    schema = "row_id int, " + UNITS
    spark.createDataFrame([(1, None, "Z", "found", "n", D("2024-02-01"), D("2024-03-01"))], schema).coalesce(1).write.parquet(f"{tmp_path}/in")

    def start():
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        merge_batches(stream, table, f"{tmp_path}/checkpoint", identity=["id"], generated_identity="id").awaitTermination()

    start()
    held, version = table.read().count(), table.version()
    for name in ("0", ".0.crc"):  # the batch's commit is lost, the table has it
        shutil.move(f"{tmp_path}/checkpoint/commits/{name}", f"{tmp_path}/{name}.lost")
    start()
    assert (table.read().count(), table.version()) == (held, version) and table.last_batch(f"{tmp_path}/checkpoint") == 0
