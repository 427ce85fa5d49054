"""Tables of scalar cases."""

import datetime

import pytest
from pyspark.sql import functions as F

from tabulon.functions import labels, numbers, text


def values(spark, f, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, t string")
    return [r.v for r in df.select("i", f(F.col("t")).alias("v")).orderBy("i").collect()]


def test_parse_number(spark):
    cases = {"1 234,56": 1234.56, "1,234.56": 1234.56, "1.234,56": 1234.56, "1234.56": 1234.56, "0": 0.0, "1,234": None, "29.09.2026": None, "SKU-12": None, "": None, "NaN": None, "1 234,56 KZT": 1234.56, "12 34": None, None: None, "-5,5": -5.5, "5,": None, "+1.234.567,8": 1234567.8, "1 234 567": 1234567.0, "₽ 7": 7.0}
    assert values(spark, numbers.parse_number, list(cases)) == list(cases.values())


def test_numeric_quote(spark):
    cases = {"14,204": 14.204, "48 600,0000": 48600.0, "1 68 117 934,30": 168117934.30, "1,234.56": 1234.56, "SKU-12": None, "NaN": None, "1,234": 1.234, "-1,2345": None, "": None}
    assert values(spark, numbers.numeric_quote, list(cases)) == list(cases.values())


def test_matrix_number(spark):
    assert values(spark, numbers.matrix_number, ["1 2 3,45", "12 34.50", "1 2", None]) == [123.45, 1234.5, None, None]


@pytest.mark.parametrize(("said", "role"), [("Кол-во", "quantity"), ("Quantity", "quantity"), ("Количество товара", "quantity"), ("Стоимость единицы", "unitPrice"), ("Unit cost", "unitPrice"), ("Стоимость 1 ед.", "unitPrice"), ("Общая сумма", "lineTotal")])
def test_roles(spark, said, role):
    assert labels.classify(spark.createDataFrame([(said,)], "label string")).first().role == role


def test_normalize_label(spark):
    assert values(spark, text.normalize_label, ["Цена / ед.:", "Объём—работ", None, "a_b  c"]) == ["цена ед", "объем работ", "", "a_b c"]


def test_dates_currency_confidence(spark):
    assert values(spark, lambda c: text.calendar_date(c), ["28/02/2027", "31.02.2027", "x", None]) == [datetime.date(2027, 2, 28), None, None, None]
    assert values(spark, text.currency_code, ["12 ₽", "тенге", "USD", "none"]) == ["RUB", "KZT", "USD", None]
    df = spark.createDataFrame([(True, True, False, True), (False, False, True, None), (True, False, False, False)], "n boolean, t boolean, m boolean, a boolean")
    assert [r.v for r in df.select(text.confidence(df.n, df.t, df.m, df.a).alias("v")).collect()] == [990, 760, 740]


def test_spreadsheet_guard(spark):
    assert values(spark, text.spreadsheet_safe, ['=1+"a"', " -x", "ok", '"']) == ['"\'=1+""a"""', "\"' -x\"", '"ok"', '""""']


def test_labels_have_no_compatibility_forms(spark):
    from pyspark.sql import functions as F

    from tabulon.functions.text import normalize_label

    df = spark.createDataFrame([("Ｐｒｉｃｅ　１",), ("ﬁnal oﬀer",), ("Цена за ед.",)], "t string")
    assert [r[0] for r in df.select(normalize_label(F.col("t"))).collect()] == ["price 1", "final offer", "цена за ед"]
