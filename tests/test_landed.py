"""Landed feeds as data sources, in batches and as a stream."""

import json

import pytest

from tessera.sources import landed


def land(path, provider, host, name, rows):
    folder = path / provider / host
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))


@pytest.fixture
def path(spark, tmp_path):
    landed.register(spark)
    land(tmp_path, "umi", "b1.umi", "1.json", [{"items": [{"item": "a", "MaterialName": "Oro", "GroupName": "Marble Slab", "url": "u"}, {"item": "b", "MaterialName": "Verde"}]}, {"lots": [{"item": "a", "Qty": 2, "length": 100.0, "wide": 50.0}, {"item": "a", "Qty": 3, "length": 110.0, "wide": 60.0}]}])
    land(tmp_path, "umi", "b2.umi", "1.json", [{"items": [{"item": "a", "MaterialName": "Other name"}, {"item": "c", "MaterialName": "Nero", "GroupName": "Remnants"}]}, "", "   "])
    land(tmp_path, "slabware", "t.slabware", "p1.json", [{"Bundles": [{"id": 1, "nomeMaterial": "Taj", "nomeEspessura": "2 cm", "qtdChapas": 4, "averageSize": "120' x 70''"}, {"id": 2, "nomeMaterial": "Oro", "averageSize": "120 x 70"}]}])
    land(tmp_path, "slabware", "t.slabware", "p2.json", [{"Bundles": [{"id": 1, "nomeMaterial": "Taj", "nomeEspessura": "2 cm", "qtdChapas": 4, "averageSize": "120' x 70''"}]}])
    land(tmp_path, "stonetrash", "x", "1.json", [{"id": "a-1_b", "title": "Oro", "status": "ListedForSale", "qtyUnitsAvailable": 3}, {"id": "2", "title": " "}])
    land(tmp_path, "unbuilt", "x", "1.json", [{"data": [{"id": "1", "title": "Oro", "category_path": "Slabs/x", "quantity": 2}, {"id": "2", "title": "Sink", "category_path": "Sinks"}]}])
    land(tmp_path, "iblocky", "x", "1.json", [{"form": "SLAB", "commesse": [{"id": "1", "material": "Oro", "petroDesc": "marmo", "isActive": True}, {"id": "2", "material": "Off", "isActive": False}]}])
    land(tmp_path, "genericfeed", "shop", "1.json", [{"url": "/p/1", "html": '<script type="application/ld+json">{"@type":"Product","name":"Oro"}</script>'}])
    land(tmp_path, "slabcloud", "x", "1.json", [{"Name": "Oro", "Thickness": "2cm"}, {"Name": "ORO ", "Thickness": "3cm"}, {"Name": "Nero"}])
    land(tmp_path, "stoneprofits", "x", "1.json", [{"id": "7", "name": "Oro"}])
    return tmp_path


def test_seven_providers(spark, path):
    of = lambda name, *c: sorted((tuple(r) for r in landed.materials(spark, name, str(path)).select(*c).collect()), key=repr)
    assert of("Umi ", "item_id", "item_name", "available_slabs", "avg_length", "product_form") == [("a", "Oro", 5, 105.0, "SLAB"), ("b", "Verde", 0, None, "SLAB"), ("c", "Nero", 0, None, "REMNANT")]
    assert of("slabware", "item_id", "available_slabs", "avg_length") == [("1", 4, 120.0), ("2", 0, None)]
    assert of("stonetrash", "item_id", "available_slabs") == [("a-1_b", 3)]
    assert of("unbuilt", "item_id", "available_slabs") == [("1", 2)] and of("iblocky", "item_id", "product_form") == [("1", "SLAB")]
    assert of("genericfeed", "page_id", "name") == [("shop//p/1", "Oro")] and of("slabcloud", "item_name", "thickness") == [("Nero", None), ("Oro", "2cm")]
    assert of(None, "item_id", "item_name") == [("7", "Oro")]
    with pytest.raises(KeyError):
        landed.materials(spark, "nobody", str(path))
    assert landed.documents(spark, "umi", str(path / "nowhere")).count() == 0


def test_files_of_other_hosts_are_not_opened(spark, path):
    (path / "umi" / "b2.umi" / "1.json").chmod(0)
    docs = landed.documents(spark, "umi", str(path))
    assert docs.where("host = 'b1.umi' and nth >= 1").count() == 1 and docs.where("host in ('b1.umi', 'z')").count() == 2
    reader = landed._Reader(str(path), "umi")
    from pyspark.sql.datasource import EqualTo, GreaterThan

    left = list(reader.pushFilters([EqualTo(("host",), "b1.umi"), GreaterThan(("nth",), 0)]))
    assert len(left) == 1 and [p.host for p in reader.partitions()] == ["b1.umi"]


def test_stream(spark, path, tmp_path):
    def follow():
        out = spark.readStream.format("tessera.umi").load(str(path))
        out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
        return sorted((r.host, r.file, r.nth) for r in spark.read.schema(landed.SCHEMA).parquet(f"{tmp_path}/out").collect())

    assert follow() == [("b1.umi", "1.json", 0), ("b1.umi", "1.json", 1), ("b2.umi", "1.json", 0)]
    land(path, "umi", "b2.umi", "2.json", [{"items": []}, {"items": []}])
    land(path, "umi", "b3.umi", "1.json", [{"items": []}])
    assert follow() == [("b1.umi", "1.json", 0), ("b1.umi", "1.json", 1), ("b2.umi", "1.json", 0), ("b2.umi", "2.json", 0), ("b2.umi", "2.json", 1), ("b3.umi", "1.json", 0)]
    assert len(follow()) == 6
