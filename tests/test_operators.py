import pytest
from pyspark.sql import functions as F

from terralume.sources import delimited
from terralume.operators import alerts, conform, confront, credit, drift, identity, publish, quality, status
from terralume.specs import Dataset, parse_fields


def test_state_merge_keeps_other_states(spark):
    old = spark.createDataFrame([("PA-ANTIGO", 1), ("MT-MANTER", 2)], "cod string, v int")
    new = spark.createDataFrame([("PA-NOVO", 3)], "cod string, v int")
    got = {r["cod"] for r in publish.merge_state(old, new, "cod", "PA").collect()}
    assert got == {"MT-MANTER", "PA-NOVO"}


def test_border_rows_are_replaced(spark):
    old = spark.createDataFrame([("PE-VELHO", 1), ("AL-DIVISA", 5), ("AL-MANTER", 10)], "cod string, v int")
    new = spark.createDataFrame([("PE-NOVO", 2), ("AL-DIVISA", 99)], "cod string, v int")
    merged = publish.merge_state(old, new, "cod", "PE")
    assert {tuple(r) for r in merged.collect()} == {("AL-MANTER", 10), ("PE-NOVO", 2), ("AL-DIVISA", 99)}
    again = publish.merge_state(merged, new, "cod", "PE")
    assert {tuple(r) for r in again.collect()} == {tuple(r) for r in merged.collect()}


def test_state_gate(spark):
    rows = [("PE-1",), ("AL-2",)]
    gate = lambda r, uf: quality.state_gate(spark.createDataFrame(r, "c string"), "c", uf).first()
    assert gate(rows, "PE")["decisao"] == "ACEITO"
    assert gate(rows, "PE")["ufs_extras"] == "AL"
    assert gate(rows, "BA")["decisao"] == "UF_AUSENTE"
    assert gate(rows + [(None,)], "PE")["decisao"] == "CODIGO_FORA_PADRAO"
    assert gate(rows + [("ZZ-3",)], "PE")["registros_fora_padrao"] == 1


def test_reduction_needs_matching_confirmation(spark):
    old, new = spark.range(10), spark.range(7)
    decision = publish.compare_counts(old, new)
    assert not publish.may_publish(decision)
    assert not publish.may_publish(decision, 9)
    assert publish.may_publish(decision, 10)
    assert publish.may_publish(publish.compare_counts(new, old))


def test_second_writer_of_a_version_is_refused(spark, tmp_path, monkeypatch):
    root, other = str(tmp_path / "loja"), spark.newSession()
    publish.publish_tables(spark, root, {"t": spark.range(3), "u": spark.range(1)}, 1)
    held = publish.read_tables(spark, root)
    # The other session commits between this writer's last look and its rename.
    take = publish._take_place

    def late(session, folder, target):
        monkeypatch.setattr(publish, "_take_place", take)
        publish.publish_tables(other, root, {"t": other.range(20)}, 2)
        take(session, folder, target)

    monkeypatch.setattr(publish, "_take_place", late)
    with pytest.raises(publish.CommitRefused):
        publish.publish_tables(spark, root, {"t": spark.range(99)}, 2)
    assert publish.read_table(spark, root, "t").count() == 20
    assert publish.current_version(other, root, "t") == 2 and publish.current_version(other, root, "u") == 1
    assert held["t"].count() == 3 and publish.read_tables(spark, root, 1)["t"].count() == 3
    with pytest.raises(publish.CommitRefused):
        publish.publish_tables(spark, root, {"t": spark.range(7)}, 1)
    with pytest.raises(ValueError):
        publish.read_table(spark, root, "v")


def test_versions_follow_the_manifest(spark, tmp_path):
    root = str(tmp_path / "store")
    publish.publish_tables(spark, root, {"t": spark.range(3)}, 1)
    spark.range(9).write.parquet(f"{root}/t/version=2")
    assert publish.read_table(spark, root, "t").count() == 3
    publish.publish_tables(spark, root, {"t": spark.range(5)}, 3)
    assert publish.read_table(spark, root, "t").count() == 5


def test_years_replace_only_their_partition(spark, tmp_path):
    path = str(tmp_path / "y")
    df = spark.createDataFrame([(1, 2020), (2, 2021)], "v int, ano int")
    publish.write_partitions(df, path, ["ano"])
    publish.write_partitions(spark.createDataFrame([(9, 2021)], "v int, ano int"), path, ["ano"])
    assert {tuple(r) for r in spark.read.parquet(path).collect()} == {(1, 2020), (9, 2021)}


def test_key_quality_ratio(spark):
    rows = [(str(i),) for i in range(99)] + [("",)]
    row = quality.key_quality(spark.createDataFrame(rows, "k string"), "k").first()
    assert (row["registros_validos"], row["registros_sem_chave"], row["publicar"]) == (99, 1, True)
    bad = quality.key_quality(spark.createDataFrame([("1",), ("x",)], "k string"), "k").first()
    assert bad["publicar"] is False


def test_start_year_rules():
    assert quality.start_date() == "2019-08-01"
    assert quality.start_date(2021) == "2021-01-01"
    with pytest.raises(ValueError):
        quality.start_date(2018)


def test_state_check_of_operations(spark):
    df = spark.createDataFrame([("a", "PE"), ("b", "BA"), ("c", "")], "id string, uf string")
    got = {r["id"]: r["validacao_uf"] for r in credit.check_state(df, F.lit("pe"), F.col("uf")).collect()}
    assert got == {"a": "VALIDADA", "c": "SEM_VALIDACAO"}


def test_points_join_wkt_only_when_one_year_matches(spark):
    cols = "cod_imovel string, ref_bacen string, nu_ordem string, indice string, ano int, id int, area double"
    wkt = spark.createDataFrame([("P", "1", "1", "1", 2020, 1, None), ("P", "2", "1", "1", 2020, 2, 1.0), ("P", "2", "1", "1", 2021, 3, 2.0)], cols)
    pts = spark.createDataFrame([("P", "1", "1", "1", None, 4, 7.0), ("P", "2", "1", "1", None, 5, 8.0)], cols)
    merged = {r["plot"]: (r["origem"], r["area"]) for r in credit.merge_plot_sources(wkt, pts, ["area"]).collect()}
    assert merged == {
        "1:1:2020:1": ("WKT", 7.0), "2:1:2020:1": ("WKT", 1.0), "2:1:2021:1": ("WKT", 2.0), "2:1::1": ("COORDENADAS", 8.0),
    }


def test_three_valued_alert_state(spark):
    df = spark.createDataFrame([("prodes", False, 0), ("prodes", True, 0), ("prodes", True, 2), ("ibama", True, 1)], "l string, d boolean, n int")
    got = [r["s"] for r in df.select(alerts.alert_state(F.col("l"), F.col("d"), F.col("n")).alias("s")).collect()]
    assert got == ["nao_verificado", "ok", "alerta", "atencao"]


def test_sorted_values(spark):
    df = spark.range(1).select(alerts.sorted_values(F.array(*map(F.lit, ["10", "9", "b", "A", "", "9 "]))).alias("v"))
    assert df.first()["v"] == ["9", "10", "A", "b"]


def test_embargo_status_order(spark):
    c = lambda v: F.lit(v).cast("string")
    cases = [(("S", "S", "", "x", ""), "CANCELADO"), (("", "", "desembargo total", "x", ""), "DESEMBARGADO"), (("n", "n", "", "vigente", ""), "ATIVO"), (("", "S", "", "x", ""), "DESEMBARGADO"), (("", "", "", "", ""), "A_VERIFICAR"), (("", "", "", "vigente", "excluído"), "A_VERIFICAR")]
    for args, want in cases:
        assert spark.range(1).select(alerts.embargo_status(*map(c, args)).alias("s")).first()["s"] == want


FIELDS = "layer string, nome string, tipo string, largura int, precisao int, posicao int"


def changes(spark, old, new, aliases=None):
    a, b = spark.createDataFrame(old, FIELDS), spark.createDataFrame(new, FIELDS)
    return {(r["tipo"], r["de"], r["para"]) for r in drift.field_changes(a, b, aliases).collect()}


def test_drift_precision_spelling_and_type(spark):
    old = [("l", "MOD_FISCAL", "Real", 10, 2, 0), ("l", "nome", "String", 50, 0, 1), ("l", "n", "Integer", 5, 0, 2)]
    new = [("l", "MOD_FISCAL", "Real", 33, 31, 0), ("l", "NOME", "String", 80, 0, 1), ("l", "n", "String", 5, 0, 2)]
    assert changes(spark, old, new) == {
        ("NUMERIC_PRECISION_CHANGED", "MOD_FISCAL", "MOD_FISCAL"), ("FIELD_SPELLING_CHANGED", "nome", "NOME"), ("FIELD_TYPE_CHANGED", "n", "n"),
    }


def test_drift_renames(spark):
    old = [("l", "num_area", "Real", 1, 1, 0), ("l", "municipio", "String", 1, 1, 1), ("l", "velho", "String", 1, 1, 2)]
    new = [("l", "area_ha", "Real", 1, 1, 0), ("l", "municipios", "String", 1, 1, 1), ("l", "xyz", "String", 1, 1, 7)]
    aliases = spark.createDataFrame([("area", "num_area"), ("area", "area_ha")], "campo string, nome string")
    assert changes(spark, old, new, aliases) == {
        ("FIELD_RENAMED", "num_area", "area_ha"), ("POSSIBLE_FIELD_RENAMED", "municipio", "municipios"),
        ("FIELD_REMOVED", "velho", None), ("FIELD_ADDED", None, "xyz"),
    }


def test_drift_takes_fields_in_order_of_names(spark):
    """The first removed field takes the best added one; ties go to the first name; the second gets the next."""
    old = [("l", "area_b", "Real", 1, 1, 5), ("l", "area_a", "Real", 1, 1, 5), ("l", "area_c", "String", 1, 1, 5)]
    new = [("l", "area_y", "Integer", 1, 1, 5), ("l", "area_x", "Real", 1, 1, 5), ("n", "solo", "Real", 1, 1, 0)]
    assert changes(spark, old, new) == {
        ("POSSIBLE_FIELD_RENAMED", "area_a", "area_x"), ("POSSIBLE_FIELD_RENAMED", "area_b", "area_y"), ("FIELD_REMOVED", "area_c", None),
    }


def test_drift_alias_order_and_repeated_names(spark):
    old = [("l", "uf", "String", 1, 1, 0), ("l", "UF", "Integer", 1, 1, 1), ("l", "estado", "String", 1, 1, 2)]
    new = [("l", "uf", "Integer", 1, 1, 0), ("l", "sigla", "String", 1, 1, 2)]
    aliases = spark.createDataFrame([("uf", "estado", 0), ("uf", "sigla", 1), ("uf", "uf", 2)], "campo string, nome string, ordem int")
    assert changes(spark, old, new, aliases) == {("FIELD_SPELLING_CHANGED", "UF", "uf"), ("FIELD_RENAMED", "estado", "sigla")}


def identity_tables(spark):
    specs = spark.createDataFrame(
        [("app", "cod", "cod_imovel", 0, True), ("app", "tipo", "tipo_app", 0, False), ("app", "area", "num_area", 0, False),
         ("rl", "cod", "cod_imovel", 0, True), ("rl", "sit", "situacao_rl", 0, False)],
        "dataset string, campo string, alias string, ordem int, obrigatorio boolean",
    )
    profiles = spark.createDataFrame(
        [("app", ["polygon"], ["APP"], ["tipo_app"]), ("rl", ["polygon"], ["RESERVA_LEGAL"], ["situacao_rl"])],
        "dataset string, familias array<string>, tokens array<string>, sinais array<string>",
    )
    layers = spark.createDataFrame(
        [("a", "APP_2024", "MultiPolygon", ["COD_IMOVEL", "TIPO_APP", "NUM_AREA"], "s1"),
         ("b", "reserva legal", "Polygon", ["COD_IMOVEL", "TIPO_APP"], "s2"), ("c", "APP", "Point", ["COD_IMOVEL"], "s3")],
        "layer string, nome string, geometria string, campos array<string>, assinatura string",
    )
    return layers, specs, profiles


def test_layer_scores_and_decisions(spark):
    layers, specs, profiles = identity_tables(spark)
    scores = identity.score_layers(layers, specs, profiles)
    got = {(r["layer"], r["dataset"]): r["pontos"] for r in scores.collect()}
    assert got[("a", "app")] == 3 + 3 + 3 + 1 + 3
    assert got[("b", "rl")] == 3 + 3 + 1 + 0 + 3
    wanted = layers.select("layer", F.lit("app").alias("dataset"))
    history = layers.select("layer", F.lit(False).alias("exato"), F.lit(False).alias("compativel"))
    done = {r["layer"]: (r["status"], r["dataset_sugerido"]) for r in identity.decide_identity(scores, wanted, history).collect()}
    assert done["a"] == ("CONFIRMADO", None)
    assert done["c"] == ("INCOMPATIVEL", None)


def test_file_names_need_structure(spark):
    files = spark.createDataFrame([("RESERVA_LEGAL_PE.zip",), ("dados.zip",)], "arquivo string")
    patterns = spark.createDataFrame([("rl", "*reserva_legal*"), ("app", "app")], "dataset string, padrao string")
    hits = identity.name_hits(files, patterns)
    cols = "arquivo string, dataset string, historico boolean, estrutura int, mapeados int"
    eligible = spark.createDataFrame([("RESERVA_LEGAL_PE.zip", "app", False, 9, 3), ("dados.zip", "app", False, 9, 3), ("dados.zip", "rl", False, 8, 2)], cols)
    got = {r["arquivo"]: (r["status"], r["dataset"]) for r in identity.classify_files(hits, eligible, files).collect()}
    assert got == {"RESERVA_LEGAL_PE.zip": ("NOME_NAO_CONFIRMADO", None), "dados.zip": ("AMBIGUO", None)}


def test_canonical_projection(spark):
    dataset = Dataset("x", parse_fields("cod:text! ← COD_IMOVEL; area:numeric ← num_area; falta:integer"), fixed={"bioma": "PAMPA"})
    raw = spark.createDataFrame([("PE-1", "1,5")], "COD_IMOVEL string, NUM_AREA string")
    row = conform.canonical(raw, dataset, "SICAR").first()
    assert (row["cod"], float(row["area"]), row["falta"], row["bioma"]) == ("PE-1", 1.5, None, "PAMPA")
    with pytest.raises(ValueError):
        conform.canonical(raw.drop("COD_IMOVEL"), dataset, "SICAR")


def test_batch_status_rules(spark):
    items = spark.createDataFrame(
        [(1, "CONCLUIDO", 100), (1, "FALHOU", 40), (2, "PROCESSANDO", 10), (3, "CONCLUIDO", 100)], "lote_id int, status string, progresso int"
    )
    done = status.batch_status(F.lit("IMPORTACAO"), F.lit(False), F.lit(False), F.lit(0))
    got = {r["lote_id"]: (r["s"], r["p"]) for r in status.batch_counts(items).select("lote_id", done.alias("s"), status.batch_progress().alias("p")).collect()}
    assert got == {1: ("CONCLUIDO_COM_PENDENCIAS", 70), 2: ("PROCESSANDO", 10), 3: ("CONCLUIDO", 100)}


def test_bow_tie_meets_a_covering_box(spark):
    from terralume.functions import geometry as geo

    p = geo.point
    lit = lambda x, y: p(F.lit(float(x)), F.lit(float(y)))
    bow = F.array(lit(-50, -10), lit(-49, -9), lit(-49, -10), lit(-50, -9), lit(-50, -10))
    box = geo.box_geometry(*map(F.lit, (-51.0, -11.0, -48.0, -8.0)))
    one = spark.range(1)
    properties = one.select(F.lit("A").alias("cod_imovel"), geo.geometry(F.array(F.array(bow))).alias("geometry"))
    layer = spark.range(3).select(F.col("id").alias("fid"), box.alias("geometry"))
    result = confront.external_layer(confront.Indexed.of(properties), layer, "fid", limit=2)
    records = result.records.collect()
    assert [round(r["percentual_car"], 6) for r in records] == [100.0, 100.0]
    assert 600_000 < records[0]["area_sobreposta_ha"] < 620_000
    counts = result.counts.first()
    assert (counts["quantidade"], counts["truncada"]) == (3, True)


def test_cells_of_levels_that_exist(spark):
    from terralume.operators import spatial

    box = F.struct(*[F.lit(v).alias(n) for n, v in (("xmin", 0.0), ("ymin", 0.0), ("xmax", 1e-5), ("ymax", 1e-5))])
    tiny = spark.range(1).select(F.col("id").alias("k"), box.alias("box"))
    assert spatial._levels(tiny, "box") == [0]
    assert spatial._cells(tiny, "k", "box", 1, [0]).count() == 1
    assert spatial._cells(tiny, "k", "box", 1, [3]).count() == 1
    assert spatial._cells(tiny, "k", "box", 2, []).count() == 0


def test_file_report_limits_and_columns(spark, tmp_path):
    import gzip

    (tmp_path / "a.csv").write_bytes("\ufeff#REF; Ordem \r\n1;2\r\n".encode())
    (tmp_path / "b.csv.gz").write_bytes(gzip.compress(b""))
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(b"ref_bacen;x\n" + b"a" * 100_000 + b"\n"))
    (tmp_path / "d.csv").write_bytes(b'"ORDEM";"ref bacen"\n' + b"1;2\n" * 100)
    required = {"REF": ["ref_bacen"], "ORDEM": []}
    rows = delimited.file_report(spark, str(tmp_path), ";", required, max_bytes=400, max_expanded=100_000, max_ratio=100.0).collect()
    got = {r["arquivo"].rsplit("/", 1)[1]: (r["expandido"], r["faltantes"], r["motivos"]) for r in rows}
    assert got == {
        "a.csv": (19, [], []),
        "b.csv.gz": (0, ["REF", "ORDEM"], ["VAZIO", "COLUNAS"]),
        "c.csv.gz": (100_013, ["ORDEM"], ["EXPANDIDO", "TAXA", "COLUNAS"]),
        "d.csv": (420, [], ["TAMANHO"]),
    }
    assert {r["arquivo"].rsplit("/", 1)[1]: r["taxa"] for r in rows}["d.csv"] == 1.0


def _box_rows(spark, rows, names):
    from terralume.functions import geometry as geo

    made = spark.createDataFrame(rows, f"{names}, x0 double, y0 double, x1 double, y1 double")
    return made.withColumn("geometry", geo.box_geometry(*map(F.col, ("x0", "y0", "x1", "y1")))).drop("x0", "y0", "x1", "y1")


def test_occurrences_beyond_the_length_of_a_list_count(spark, monkeypatch):
    """More old and large alerts than a ranked list holds, of one shape and of many, hide no later ones."""
    from terralume.functions import geometry as geo
    from terralume.queries import q_credit

    old = [(i, 2010, "1-URGENT", "desmatamento", -50.0, -10.0, -49.0, -9.5 + (i % 40) / 100) for i in range(2100)]
    new = [(5000 + i, 2019 + i % 2, "3-MEDIUM", "QUEIMADA", -50.0, -10.0, -49.99, -9.99) for i in range(2050)]
    later = [(9000, 2024, "5-LOW", "", -50.0, -10.0, -49.98, -9.99)]
    layer = _box_rows(spark, old + new + later, "fid long, year int, class_name string, main_class string")
    places = [("A", -51.0, -11.0, -48.0, -8.0), ("B", -50.0, -10.0, -49.985, -9.0), ("C", 0.0, 0.0, 1.0, 1.0)]
    properties = _box_rows(spark, places, "cod_imovel string")
    monkeypatch.setattr(q_credit.roles, "properties", lambda *_: properties)
    monkeypatch.setattr(q_credit.roles, "alerts_layer", lambda *_: layer)
    got = {r["cod_imovel"]: r for r in q_credit.alert_occurrences(spark, "").collect()}
    for code in "AB":
        assert (got[code]["quantidade"], got[code]["anos"], got[code]["tipos"]) == (2051, "2019,2020,2024", "5-LOW,QUEIMADA")
    one = _box_rows(spark, [("a", -50.0, -10.0, -49.99, -9.99)], "k string").select(geo.area_m2(F.col("geometry")).alias("m")).first()["m"]
    assert got["A"]["area_soma_ocorrencias_ha"] == pytest.approx(2052 * one / 10000, abs=2e-3)
    assert got["B"]["area_soma_ocorrencias_ha"] == pytest.approx(2051.5 * one / 10000, abs=2e-3)
    assert (got["C"]["quantidade"], got["C"]["cobertura_status"]) == (0, "COBERTURA_NAO_CONFIRMADA")


def test_groups_of_overlaps_tell_what_all_records_tell(spark):
    """Copies of shapes, keys that repeat and missing values on both sides."""
    places = [("A", 0.0, 0.0, 2.0, 2.0), ("A", 0.0, 0.0, 2.0, 2.0), ("A", 1.0, 1.0, 3.0, 3.0), ("B", 0.0, 0.0, 2.0, 2.0), ("C", 9.0, 9.0, 9.5, 9.5)]
    properties = _box_rows(spark, [*places, (None, 0.0, 0.0, 1.0, 1.0)], "cod_imovel string")
    spots = [(i % 13, None if i % 5 == 0 else 2015 + i % 9, "X" if i % 3 else None, "queimada" if i % 2 else None, (i % 4) / 2, 0.5, (i % 4) / 2 + 1, 1.5) for i in range(40)]
    layer = _box_rows(spark, [*spots, (None, 2020, "X", None, 0.0, 0.0, 1.0, 1.0)], "fid long, year int, class_name string, main_class string")
    values = ["year", "class_name", "main_class"]
    result = confront.external_layer(confront.Indexed.of(properties), layer, "fid", limit=10_000, values=values)
    records = result.records.join(layer.drop("geometry"), "fid").withColumn("tipo_prodes", F.lit(""))
    groups = result.groups.withColumn("tipo_prodes", F.lit(""))
    for restrict in (False, True):
        want = {r["cod_imovel"]: r for r in alerts.alert_occurrences(records, restrict=restrict).collect()}
        got = {r["cod_imovel"]: r for r in alerts.alert_occurrences(groups, restrict=restrict, copies="quantidade").collect()}
        assert got.keys() == want.keys() == {"A", "B", None}
        for code, row in want.items():
            assert [got[code][c] for c in ("quantidade", "anos", "tipos")] == [row[c] for c in ("quantidade", "anos", "tipos")]
            assert got[code]["area_soma_ocorrencias_ha"] == pytest.approx(row["area_soma_ocorrencias_ha"], rel=1e-9)
