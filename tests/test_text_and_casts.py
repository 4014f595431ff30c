from datetime import date

from pyspark.sql import functions as F

from terralume.functions import casts, hashing, text as tx
from terralume.operators import quality
from terralume.sources import delimited


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def values(spark, rows, fn):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r["v"] for r in df.select("i", fn(F.col("t")).alias("v")).orderBy("i").collect()]


def test_numbers(spark):
    got = values(spark, ["1,5", "-2.25", "1.234,56", "abc", "", None], casts.to_numeric)
    assert [float(v) if v is not None else None for v in got] == [1.5, -2.25, None, None, None, None]
    assert values(spark, ["12", "+3", "1.0", "99999999999"], casts.to_integer) == [12, 3, None, None]
    assert values(spark, ["2020", "01/02/2021", "2022-03-04", "22"], casts.to_year) == [2020, 2021, 2022, None]


def test_strict_dates(spark):
    rows = ["2024-02-29", "29/02/2023", "1.3.2020", "2020/1/5 10:00", "--", "0000-00-00", "x"]
    want = [date(2024, 2, 29), None, date(2020, 3, 1), date(2020, 1, 5), None, None, None]
    assert values(spark, rows, casts.to_strict_date) == want


def test_flexible_dates_follow_the_dominant_order(spark):
    rows = ["13/01/2020"] * 4 + ["03/04/2020", "01/25/2021", "5/032019", "31/02/2020"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, d string")
    got = [r["d_date"] for r in quality.with_flexible_dates(df, ["d"]).orderBy("i").collect()]
    assert got[4:] == [date(2020, 4, 3), date(2021, 1, 25), date(2019, 3, 5), None]


def test_ambiguous_without_dominance_is_null(spark):
    df = spark.createDataFrame([("13/01/2020",), ("01/13/2020",), ("03/04/2020",)], "d string")
    rows = {r["d"]: r["d_date"] for r in quality.with_flexible_dates(df, ["d"]).collect()}
    assert rows["03/04/2020"] is None


def test_dominance_rule(spark):
    pairs = [(235, 1, "DMY"), (1, 235, "MDY"), (5, 4, None), (0, 0, None), (2, 0, "DMY")]
    for dmy, mdy, want in pairs:
        assert one(spark, casts.dominant_order(F.lit(dmy), F.lit(mdy))) == want


def test_credit_values(spark):
    assert values(spark, ["10,0", "10.5", "1e2", "NaN"], lambda c: casts.credit_value(c, "integer")) == [10, None, 100, None]
    got = values(spark, ["1 234,5", "1.234,5", "Infinity"], lambda c: casts.credit_value(c, "numeric").cast("double"))
    assert got == [1234.5, None, None]
    days = values(spark, ["2020-01-02", "02/01/2020", "20200102", "02-01-2020", "2020.01.02"], lambda c: casts.credit_value(c, "date"))
    assert days == [date(2020, 1, 2)] * 4 + [None]


def test_names_and_codes(spark):
    assert values(spark, ["Área Total (ha)", "ção__x"], tx.normal_name) == ["area_total_ha", "cao_x"]
    assert tx.normal_name_text("Área Total (ha)") == "area_total_ha"
    long = "x" * 60
    assert values(spark, [long], tx.identifier)[0] == tx.identifier_text(long)
    code = "PE-2614105-9C74D4EF908C4BF4A177617BDC9C3D86"
    assert values(spark, [code.replace("-", " "), "PE-1"], tx.property_code) == [code, None]
    assert values(spark, ["1881095.0", " 7 ", "x", "-3", "007"], tx.integer_key) == ["1881095", "7", "", "-3", "7"]
    assert values(spark, ["529.982.247-25", "111.111.111-11", "529.982.247-24"], tx.cpf_valid) == [True, False, False]
    assert values(spark, ["INATIVO", "Ativa", "AT", "Suspenso"], lambda c: tx.property_status(c, F.lit(""))) == ["Inativo", "Ativo", "Ativo", "Suspenso"]
    assert values(spark, ["1", "12345"], lambda c: tx.padded_code(c, 4)) == ["0001", "12345"]
    text = f"codigo {code.lower().replace('-', '–')} e {code[:12]} {code[12:]}"
    assert values(spark, [text], tx.codes_in_text) == [[code]]


def test_bad_utf8_is_counted(spark):
    raw = F.unhex(F.lit("41C3"))
    row = one(spark, tx.repair_utf8(raw))
    assert (row["text"], row["replaced"]) == ("A?", 1)


def test_keyed_hash_is_hmac(spark):
    import hashlib
    import hmac

    want = hmac.new(b"k", b"login|ana", hashlib.sha256).hexdigest()
    assert one(spark, hashing.keyed_hash(F.lit("login"), F.lit("ana"), "k")) == want


def test_dataset_fingerprint_ignores_order_and_sees_copies(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "k int, v string")
    b = a.orderBy(F.col("k").desc())
    c = a.distinct()
    get = lambda df: hashing.dataset_fingerprint(df, ["k", "v"]).first()
    assert get(a) == get(b)
    assert get(a)["sha256"] != get(c)["sha256"]
    assert get(a)["registros"] == 3


def test_format_detection():
    fmt = delimited.detect_format("﻿REF_BACEN;NU,ORDEM;obs\n".encode(), ["ref_bacen"])
    assert (fmt.delimiter, fmt.encoding, fmt.headers[0]) == (";", "utf-8-sig", "ref_bacen")
    assert delimited.detect_format("a;é\n".encode("latin-1")).encoding == "cp1252"
    assert delimited.unique_headers(["A", "a", "", "_id"]) == ("a", "a_2", "campo_3", "id")
    assert delimited.alias_matches("nome_proje", "nome_projeto")
    assert not delimited.alias_matches("nome", "nome_projeto")


def test_year_of_name(spark):
    rows = ["SICOR_2012_2020.csv", "x20201.csv", "arquivo"]
    assert values(spark, rows, delimited.year_of_name) == [2020, None, None]


def test_head_is_read_as_bytes(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_bytes("código;nome\n1;São\n".encode("latin-1"))
    head = delimited.read_head(spark, str(path))
    assert delimited.detect_format(head).encoding == "cp1252"
    assert head.startswith("código;nome".encode("latin-1"))
    fmt = delimited.detect_format(head, ["codigo"])
    rows = delimited.read_delimited(spark, str(path), fmt).collect()
    assert [(r["codigo"], r["nome"]) for r in rows] == [("1", "São")]


def test_wide_and_short_rows(spark, tmp_path):
    path = tmp_path / "SICOR_2020.csv"
    path.write_text('a;b;c\n1;2\n1;2;3;4\n"x;""y";2;3;4;"5;6"\n')
    fmt = delimited.detect_format(delimited.read_head(spark, str(path)))
    df = delimited.read_delimited(spark, str(path), fmt)
    assert {(r["a"], r["c"], r["_excesso"], r["_ano_arquivo"]) for r in df.collect()} == {
        ("1", "", None, 2020), ("1", "3", "4", 2020), ('x;"y', "3", '4;"5;6"', 2020),
    }
    assert delimited.too_wide(df).count() == 2


def test_late_accents_in_any_file(spark, tmp_path):
    lines = "codigo;nome\n" + "1;Goias\n" * 3000
    (tmp_path / "a.csv").write_bytes(lines.encode() + "2;Goiás\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes(lines.encode() + "3;Goiás – sul\n".encode())
    fmt = delimited.detect_format(delimited.read_head(spark, str(tmp_path)))
    rows = delimited.read_delimited(spark, str(tmp_path), fmt).where("codigo <> '1'").collect()
    assert {(r["codigo"], r["nome"]) for r in rows} == {("2", "Goiás"), ("3", "Goiás – sul")}


def test_strict_files_are_checked_each(spark, tmp_path):
    import pytest

    header = ";".join(delimited.OPERATIONS_HEADER)
    row = ";".join("x" for _ in delimited.OPERATIONS_HEADER)
    folder = tmp_path / "ok"
    folder.mkdir()
    (folder / "a.csv").write_text(f"{header}\n{row}\n")
    assert delimited.read_operations(spark, str(folder)).count() == 1
    (folder / "b.csv").write_bytes(f"{header}\n{row}\n".replace("x;x", "é;x", 1).encode("latin-1"))
    with pytest.raises(Exception, match="UTF-8"):
        delimited.read_operations(spark, str(folder)).collect()
    other = tmp_path / "other"
    other.mkdir()
    (other / "a.csv").write_text(f"{header}\n{row}\n")
    (other / "b.csv").write_text(f"{header.replace('CD_ESTADO', 'UF')}\n{row}\n")
    with pytest.raises(Exception):
        delimited.read_operations(spark, str(other)).collect()


def test_operations_header_must_match(spark, tmp_path):
    import pytest

    path = tmp_path / "SICOR_OPERACAO_BASICA_ESTADO_2020.csv"
    path.write_text("a;b\n1;2\n")
    with pytest.raises(ValueError):
        delimited.read_operations(spark, str(path))
