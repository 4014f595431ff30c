"""Quoted fields over line ends, read in splits of a few bytes, against the csv module."""

import csv
import io
import random

import pytest

from terralume.sources import delimited, records


@pytest.fixture
def small_splits(spark):
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "150")
    spark.conf.set(names[1], "1")
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def field(rng):
    words = ["ação", "x", 'a"b', "linha\nfim", ";", "", "\r\n", '"', "\n\n", "5"]
    value = "".join(rng.choice(words) for _ in range(rng.randrange(4)))
    plain = not any(c in value for c in ';"\n\r')
    return value if plain and rng.random() < 0.7 else '"' + value.replace('"', '""') + '"'


def test_records_of_many_splits(small_splits, tmp_path):
    spark, rng = small_splits, random.Random(6)
    want = set()
    for f in range(4):
        end = "\r\n" if f % 2 else "\n"
        rows = [[field(rng) for _ in range(rng.choice([3, 3, 3, 2, 5]))] for _ in range(40)]
        text = "a;b;c" + end + "".join(";".join(r) + end for r in rows)
        (tmp_path / f"dados_201{f + 3}.csv").write_bytes(text.encode())
        reader = csv.reader(io.StringIO(text, newline=""), delimiter=";")
        next(reader)
        for number, row in enumerate(reader, start=2):
            kept = (row + [""] * 3)[:3]
            extra = next(iter(csv.reader(io.StringIO(";".join(rows[number - 2][3:]), newline=""), delimiter=";")), [""]) if len(row) > 3 else None
            want.add((*kept, number, None if extra is None else tuple(extra), f"dados_201{f + 3}.csv", 2013 + f))
    fmt = delimited.Format("utf-8", ";", ("a", "b", "c"), ("a", "b", "c"))
    got = set()
    for r in records.read_quoted(spark, str(tmp_path), fmt).collect():
        extra = r["_excesso"]
        rest = None if extra is None else tuple(next(iter(csv.reader(io.StringIO(extra, newline=""), delimiter=";")), [""]))
        got.add((r["a"], r["b"], r["c"], r["_numero_linha"], rest, r["_arquivo_origem"], r["_ano_arquivo"]))
    assert got == want


def test_lines_and_numbers(small_splits, tmp_path):
    spark = small_splits
    text = 'h;i\n1;"a\n\nb"\n\n5" tubo;z\n"x\r\ny";w\r\n"aberto;fim\n' + "resto\n" * 40
    (tmp_path / "f.csv").write_bytes(text.encode())
    (tmp_path / "vazio.csv").write_bytes(b"")
    read = lambda most: {r["numero"]: (r["linha"], r["linhas"], r["bruto"]) for r in records.read_records(spark, str(tmp_path), most_bytes=most).collect()}
    got = read(1000)
    assert {n: (a, b, bytes(x).decode()) for n, (a, b, x) in got.items()} == {
        1: (1, 1, "h;i"),
        2: (2, 3, '1;"a\n\nb"'),
        3: (5, 1, ""),
        4: (6, 1, '5" tubo;z'),
        5: (7, 2, '"x\r\ny";w'),
        6: (9, 41, '"aberto;fim\n' + "resto\n" * 39 + "resto"),
    }
    assert read(100)[6] == (9, 41, None) and read(100)[5] == got[5]
    fmt = delimited.Format("utf-8", ";", ("h", "i"), ("h", "i"))
    rows = {r["_numero_linha"]: (r["h"], r["i"], r["_linha_arquivo"]) for r in records.read_quoted(spark, str(tmp_path), fmt, 100).collect()}
    assert rows == {2: ("1", "a\n\nb", 2), 3: ("", "", 5), 4: ('5" tubo', "z", 6), 5: ("x\r\ny", "w", 7), 6: (None, None, 9)}


def test_states_fold_from_both_sides():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(50):
        maps = rng.integers(0, 4, 30)
        for before in (0, 1):
            states, s = [], before
            for m in maps:
                states.append(s)
                s = (m >> s) & 1
            got, end = records._states(maps, before)
            assert list(got) == states and end == s
