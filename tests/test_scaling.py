"""Names that many rows have, short rows with long work, and expressions that are made once."""

import re

import pytest
from pyspark.sql import functions as F

from terralume.functions import geometry as geo
from terralume.operators import confront, drift, identity, locate, spatial
from terralume.queries import roles


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_names_asked_for_go_to_the_layers(spark):
    specs = spark.createDataFrame([("d1", "nome um", "nome um", 0, True), ("d1", "dois", "dois", 0, False), ("d2", "dois", "dois", 0, True)], "dataset string, campo string, alias string, ordem int, obrigatorio boolean")
    layers = spark.createDataFrame([(i, ["NOME UM", "Dois"][: 1 + i % 2]) for i in range(40)], "layer long, campos array<string>")
    fields, headers = identity.matched_fields(layers, specs), identity.classify_headers(layers.withColumnRenamed("layer", "arquivo"), specs)
    patterns = specs.select("dataset", F.col("campo").alias("padrao"))
    names = identity.name_hits(spark.createDataFrame([(f"arq dois {i}",) for i in range(40)], "arquivo string"), patterns)
    assert "SortMergeJoin" not in _plan(fields) and "SortMergeJoin" not in _plan(names)
    assert "BroadcastHashJoin [h#" in _plan(headers)
    assert fields.count() == 20 * 1 + 20 * 3 and names.count() == 80
    assert {(r["status"], r["dataset"]) for r in headers.collect()} == {("CLASSIFICADO", "d1")}


def test_truncated_and_repeated_names_match_once(spark):
    specs = spark.createDataFrame([("d", "c1", "municipio", 0, True), ("d", "c1", "municipio_nome", 1, False), ("d", "c2", "area", 0, False)], "dataset string, campo string, alias string, ordem int, obrigatorio boolean")
    layers = spark.createDataFrame([(1, ["municipi", "MUNICIPIO", "are"]), (1, ["Municipio"]), (2, ["municipio_", "area", "area"])], "layer long, campos array<string>")
    got = sorted(tuple(r) for r in identity.matched_fields(layers, specs).collect())
    assert got == [(1, "d", "c1"), (2, "d", "c1"), (2, "d", "c2")]


def test_short_rows_of_one_file_are_dealt_over_cores(spark, tmp_path):
    rows = spark.range(100).select(F.col("id").alias("p_partkey"), F.lit("a").alias("p_name"), F.lit("b").alias("p_brand"), F.lit("c").alias("p_type"), F.lit(3).alias("p_size"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    units = roles.units_layer(spark, str(tmp_path))
    assert units.count() == 100 and units.select(F.spark_partition_id()).distinct().count() >= 4


def test_coordinates_of_a_ring_are_read_once(spark):
    text = spark.createDataFrame([(" 0,0 0,0,5 1,0 1,1 ",), ("0,0 1,1",), (None,)], "t string")
    rings = text.select(geo.kml_ring(F.col("t")).alias("r"))
    assert rings._jdf.queryExecution().optimizedPlan().toString().count("split(trim(") == 1
    assert [r["r"] and [(p["x"], p["y"]) for p in r["r"]] for r in rings.collect()] == [[(0, 0), (1, 0), (1, 1), (0, 0)], None, None]


def _boxes(spark, rows, names):
    made = spark.createDataFrame(rows, f"{names}, x0 double, y0 double, x1 double, y1 double")
    return made.withColumn("geometry", geo.box_geometry(*map(F.col, ("x0", "y0", "x1", "y1")))).drop("x0", "y0", "x1", "y1")


def test_fine_objects_enter_one_level_of_few_coarse_ones():
    fine, coarse = spatial._cell_rows({1: 1_000_000}, {3: 400, 4: 100, 5: 20, 6: 5})
    assert len(fine[1]) == 1 and all(rows == fine[1] for rows in coarse.values())
    fine, _ = spatial._cell_rows({1: 100}, {3: 4_000_000, 6: 1_000_000})
    assert len(fine[1]) == 2


def test_levels_of_both_sides_meet_in_one_cell_row_each():
    many = {n: 16 ** (9 - n) for n in range(10)}
    for left, right in ((many, many), ({0: 10**6, 2: 50, 5: 7}, many), (many, {1: 5, 3: 10**5, 8: 1}), ({9: 3}, {0: 10**9})):
        a, b = spatial._cell_rows(left, right)
        assert all(len(a[i] & b[j]) == 1 for i in left for j in right)


def test_siblings_are_paired_within_their_property(spark, monkeypatch):
    props = _boxes(spark, [("P", 0.0, 0.0, 4.0, 4.0), ("Q", 0.0, 0.0, 4.0, 4.0), ("R", 5.0, 5.0, 6.0, 6.0)], "cod_imovel string")
    rows = [(i, "PQ"[i % 2], f"n{i}", 0.1 * i, 0.0, 0.1 * i + 0.25, 1.0) for i in range(12)]
    rows += [(20, "R", "n20", 5.5, 5.5, 6.5, 6.0), (21, "R", "n21", 5.5, 5.5, 6.5, 6.0), (21, "R", "n21", 5.5, 5.5, 6.5, 6.0), (22, "X", "n22", 0.0, 0.0, 1.0, 1.0)]
    plots = _boxes(spark, rows, "plot long, cod_imovel string, nome string")
    refs = _boxes(spark, [("E", 5.9, 5.9, 9.0, 9.0), ("E", 0.0, 3.0, 1.0, 4.0)], "rotulo string")

    def warned():
        found = confront.plot_warnings(plots, confront.Indexed.of(props), refs)
        return found, {r["plot"]: r["avisos"] for r in found.collect()}

    found, got = warned()
    assert got == {i: sorted(f"Polígono: n{j}" for j in (i - 2, i + 2) if 0 <= j < 12) for i in range(12)} | {
        20: ["E", "Fora do limite do CAR", "Polígono: n21"], 21: ["E", "Fora do limite do CAR", "Polígono: n20"],
    }
    # Only the references are met by cells: `a` of plots is not paired with `a` of all other plots.
    assert found._jdf.queryExecution().optimizedPlan().toString().count("explode(sequence") <= 4
    monkeypatch.setattr(confront, "SIBLINGS", 2)
    assert warned()[1] == got


def test_views_and_properties_meet_without_written_pairs(spark):
    props = _boxes(spark, [(f"P{i % 3}", float(i), 0.0, i + 0.5, 0.5) for i in range(6)], "cod_imovel string")
    views = spark.createDataFrame([(1, 0.5, 0.5, 2.0, 3.0, "p1"), (2, 0.1, 0.1, 0.2, 0.2, None)], "v long, west double, south double, east double, north double, excluded string")
    found = locate.by_view(views, props, "v")
    assert sorted((r["v"], r["cod_imovel"], r["ordem"]) for r in found.collect()) == [(1, "P0", 1), (1, "P2", 2), (2, "P0", 1)]
    assert not any("/pairs-" in f for f in found.inputFiles())


def test_field_tables_are_read_once(spark, tmp_path):
    fields = "layer string, nome string, tipo string, largura int, precisao int, posicao int"
    old = spark.createDataFrame([("l", "area", "Real", 1, 0, 0), (None, "x", "Real", 1, 0, 0)], fields)
    new = spark.createDataFrame([("l", "areas", "Integer", 1, 0, 0), (None, "x", "Real", 1, 0, 0)], fields)
    for name, df in (("old", old), ("new", new)):
        df.write.parquet(f"{tmp_path}/{name}")
    found = drift.field_changes(*[spark.read.parquet(f"{tmp_path}/{name}") for name in ("old", "new")])
    assert {(r["layer"], r["tipo"], r["de"], r["para"]) for r in found.collect()} == {("l", "POSSIBLE_FIELD_RENAMED", "area", "areas"), (None, "FIELD_REMOVED", "x", None)}
    assert not any(f"{tmp_path}" in f for f in found.inputFiles())


def test_tiles_of_one_key_are_dealt_over_tasks(spark):
    pieces = _boxes(spark, [(1, 0.01 * i, 0.0, 0.01 * i + 0.02, 0.01) for i in range(200)] + [(1, 0.0, 0.0, 0.02, 0.01), (None, 0.0, 0.0, 1.0, 1.0)], "a long")
    found = spatial.union_areas(pieces, ["a"])
    whole = _boxes(spark, [(1, 0.0, 0.0, 2.01, 0.01)], "a long").select(geo.area_m2(F.col("geometry"))).first()[0]
    assert [(r["a"], r["area_unica_m2"]) for r in found.collect()] == [(1, pytest.approx(whole, rel=1e-9))]
    assert re.search(r"hashpartitioning\(a#\d+L?, tx#\d+L, ty#\d+L, \d+\), REPARTITION_BY_NUM", _plan(found))


def test_pairs_are_clipped_and_edges_made_once(spark):
    side = spatial.valid_shapes(spatial.with_shape(_boxes(spark, [(1, 0.0, 0.0, 1.0, 1.0), (2, 0.5, 0.5, 2.0, 2.0)], "k long")))
    pairs = spark.createDataFrame([(r["shape"], r["shape"]) for r in side.select("shape").collect()], "a binary, b binary")
    clipped = spatial.intersection_shapes(pairs, side, side).select("a", F.explode("geometry.parts").alias("part"))
    # The heights of the slabs stand in the plan once for each time that a pair is clipped.
    assert clipped._jdf.queryExecution().optimizedPlan().toString().count("array_distinct(") == 1
    assert clipped.count() == 2


def test_shape_is_hashed_once_where_a_join_asks_for_it(spark):
    rows = _boxes(spark, [(i, float(i), 0.0, i + 1.0, 1.0) for i in range(3)], "k long").unionByName(_boxes(spark, [(9, None, 0.0, 1.0, 1.0)], "k long").withColumn("geometry", F.lit(None).cast("struct<srid:int,kind:string,parts:array<array<array<struct<x:double,y:double>>>>>")))
    shaped = spatial.with_shape(rows)
    joined = shaped.select("shape", "k").join(shaped.groupBy("shape").agg(F.count("k").alias("n")), "shape")
    assert sorted((r["k"], r["n"]) for r in joined.collect()) == [(0, 1), (1, 1), (2, 1)] and shaped.count() == 4
    asked = shaped.where("shape is not null").select("shape", "k")
    assert asked._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(") == 2
