import csv
import io

from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veyra.operators.split_values import Grammar, split_cells

G = Grammar(["IBAN / financial", "Full name"])


def items(s):
    return [v for v, _ in G.parse(s)]


def test_alternatives():
    assert items('"Umut ""Umu"" G" / UMUT | x') == ['Umut "Umu" G', "UMUT", "x"]
    assert items('Vildan "Vil" D') == ['Vildan "Vil" D']
    assert items("Email / IBAN / financial / City") == ["Email", "IBAN / financial", "City"]
    assert items("Phone (0(598) 254/45, 09);b") == ["Phone (0(598) 254/45, 09)", "b"]
    assert items(' ,, "Kav, Öm"\t;x\n') == ["Kav, Öm", "x"]
    assert items("•a • b•") == ["a", "b"]
    assert items(None) == items("") == items("   ;|, ") == []


def test_backtracking_on_bad_quotes():
    assert G.parse('a; "b, c') == [("a", ""), ("b", "malformed_quote"), ("c", "")]
    assert G.parse('"a"b;c') == [('"a"b', ""), ("c", "")]
    assert G.parse("(a;b") == [("(a", ""), ("b", "")]


def test_long_cells_are_linear():
    assert len(items(";".join("x" * 20 for _ in range(20_000)))) == 20_000
    assert len(items("(" * 20_000)) == 1
    assert len(items('"' * 20_001)) <= 2


@given(st.lists(st.text(alphabet='ab ,;|/"', min_size=1, max_size=8).map(str.strip).filter(bool), min_size=1, max_size=6), st.sampled_from([";", "|", ",", " / "]))
def test_quoted_round_trip(values, sep):
    line = sep.join('"' + v.replace('"', '""') + '"' for v in values)
    assert items(line) == [v.strip() for v in values]


def test_equals_csv_reader():
    values = ["a b", "c, d", 'e "f"']
    buf = io.StringIO()
    csv.writer(buf).writerow(values)
    assert items(buf.getvalue()) == values


def test_frames(spark):
    df = spark.createDataFrame([("k1", ["a;b", None, " ", "c"], 1), ("k2", None, 2), ("k3", [], 3), ("k1", ["a;b", None, " ", "c"], 1)], "case_id string, cells array<string>, pos int")
    got = split_cells(df, F.lit("f"), "case_id", "cells").orderBy("rec_key", "pos").collect()
    assert [(r["rec_key"], r["pos"], r["item"]) for r in got] == [("k1", p, i) for p, i in ((1, "a"), (1, "a"), (2, "b"), (2, "b"), (3, "c"), (3, "c"))]
    one = spark.createDataFrame([(1, "x|y"), (2, None)], "id long, t string")
    assert [(r["rec_key"], r["pos"], r["item"]) for r in split_cells(one, F.lit("t"), "id", "t").collect()] == [("1", 1, "x"), ("1", 2, "y")]
    assert split_cells(one.limit(0), F.lit("t"), "id", "t").count() == 0
