import pytest
from pyspark.sql import functions as F

from veyra.functions import ident


def ev(spark, f, value, schema="s string"):
    return spark.createDataFrame([(value,)], schema).select(f(F.col("s")).alias("x")).first()["x"]


@pytest.mark.parametrize("s", ["+90 532 123 45 67", "0532 123 45 67", "0090 532 123 4567", "5321234567"])
def test_phone_forms(spark, s):
    assert ev(spark, ident.phone_formats, s) == ["+90 532 123 45 67", "+905321234567", "05321234567", "0532 123 45 67", "532-123-4567", "(532) 123 45 67", "532 123 45 67"]
    assert ev(spark, ident.phone_key, s) == "5321234567"


def test_foreign_phone(spark):
    assert ev(spark, ident.phone_formats, "+1 415 555 0100") == ["+1 415 555 0100", "+14155550100"]
    assert ev(spark, ident.phone_formats, None) is None or ev(spark, ident.phone_formats, None) == [None]


@pytest.mark.parametrize("s,ok", [("10000000146", True), ("10000000147", False), ("01000000014", False), ("1000000014", False), ("100000001466", False), ("1000000014a", False), (None, False)])
def test_identity_number(spark, s, ok):
    assert ev(spark, ident.tckn_valid, s) is ok


@pytest.mark.parametrize("s,ok", [("TR33 0006 1005 1978 6457 8413 26", True), ("GB82WEST12345698765432", True), ("TR330006100519786457841327", False), ("tr330006100519786457841326", True), ("", False), (None, False)])
def test_iban(spark, s, ok):
    assert ev(spark, ident.iban_valid, s) is ok


def test_values(spark):
    assert ev(spark, lambda c: ident.valid_value("phones", c), "+90 5xx xxx xx xx") is False
    assert ev(spark, lambda c: ident.valid_value("emails", c), "not-an-email") is False
    assert ev(spark, lambda c: ident.valid_value("emails", c), "a@b.example") is True
    assert ev(spark, ident.split_list, " a ;; b;") == ["a", "b"]
    assert [ev(spark, ident.parse_bool, x) for x in ("Evet", "YES", "no", None)] == [True, True, False, False]
    assert [str(ev(spark, ident.parse_date, x)) for x in ("1985-03-15", "15.03.1985", "15/03/1985", "15-03-1985", "x")] == ["1985-03-15"] * 4 + ["None"]
    assert ev(spark, ident.safe_case_id, "../a b/ç") == "a_b"
    with pytest.raises(Exception, match="no usable case id"):
        ev(spark, ident.safe_case_id, "...")


def test_names(spark):
    df = spark.createDataFrame([("Işıl Ak", ["ISIL AK", " ", None, "I. Ak"]), ("B C", None)], "n string, v array<string>")
    assert [r["x"] for r in df.select(ident.distinct_names(F.col("n"), F.col("v")).alias("x")).collect()] == [["Işıl Ak", "I. Ak"], ["B C"]]
    assert ev(spark, ident.bare_username, " @@ada ") == "ada"
