import datetime as dt

import pytest
from pyspark.sql import functions as F

from labspark.functions import text, values


def apply(spark, schema, inputs, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {schema}")
    return [r.out for r in df.select("i", expression(F.col("v")).alias("out")).orderBy("i").collect()]


def test_clean_specimen(spark):
    cases = {
        "": "unknown", "  UNK ": "unknown", "Open wound, left ear": "opened wound", "a bited wound": "bite wound",
        "(x)": "", "heart valve": "heavalve", "ear. swab": "ea swab", "Rt. Ear (deep)": "ear", "skin/ear": "skin",
        "urine at 5pm": "urine", "pus or fluid": "pus", "left ear": "ear", "l.ear": "ear", "\tEar\n": "ear",
        "swab @ neck": "swab", "right lt. paw": "paw",
    }
    assert apply(spark, "string", list(cases), text.clean_specimen) == list(cases.values())
    assert apply(spark, "string", [None], text.clean_specimen) == [None]


def test_text_helpers(spark):
    assert apply(spark, "string", [" a b ", " x ", "   ", None], text.first_token) == ["a", "x", None, None]
    assert apply(spark, "string", ["", " \t", "x", None], text.is_blank) == [True, True, False, True]
    assert apply(spark, "string", ["NA", "nan", "007", "", None], text.missing_to_null) == [None, None, "007", None, None]
    assert apply(spark, "string", ["['a', 'b c']", "[]", "oops"], text.parse_list) == [["a", "b c"], [], None]
    assert apply(spark, "string", ["a/b"], text.file_safe) == ["a_b"]


def test_symbols_round_trip(spark):
    symbols = list(values.SYMBOLS)
    names = apply(spark, "string", symbols, values.symbol_to_name)
    assert names == ["POS", "NEG", "S", "I", "R"]
    assert apply(spark, "string", names, values.name_to_symbol) == symbols


def test_parse_date(spark):
    """Month first; day first only where the first number is no month."""
    same = ["2020-03-04", " 2020-3-4 10:20:30", "2020-03-04T10:20:30.123", "03/04/2020", "3/4/2020", "2020/03/04", "20200304", "Mar 4, 2020",
            "March 4, 2020", " 4-Mar-2020 ", "04 Mar 2020", "3-4-2020 10:20"]
    assert apply(spark, "string", same, values.parse_date) == [dt.date(2020, 3, 4)] * len(same)
    late = ["25/12/2020", "12/25/2020", "25-12-2020", "Dec 25, 2020"]
    assert apply(spark, "string", late, values.parse_date) == [dt.date(2020, 12, 25)] * 4
    bad = ["soon", "", None, "13/13/2020", "2020-02-30", "2020-01-01 25:00", "4 March"]
    assert apply(spark, "string", bad, values.parse_date) == [None] * len(bad)


def test_elapsed_keeps_days(spark):
    df = spark.createDataFrame([(dt.datetime(2021, 1, 1, 0, 0, 5), dt.datetime(2021, 1, 3, 0, 0, 1))], "a timestamp, b timestamp")
    assert df.select(values.elapsed_seconds(F.col("a"), F.col("b"))).first()[0] == 2 * 86400 - 4


def test_display_time(spark):
    got = apply(spark, "timestamp", [dt.datetime(2021, 1, 2, 3, 4, 5), None], values.display_time)
    assert got == ["02-Jan-2021 03:04:05", "-"]


def test_rounding(spark):
    assert apply(spark, "array<double>", [[0.5, 1.5, -0.5, 2.4]], values.round_vector) == [[0, 2, 0, 2]]
    df = spark.createDataFrame([([0.0, 2.0], [4.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(values.interpolate(F.col("a"), F.col("b"), F.lit(0.25))).first()[0] == [1.0, 1.5]


def test_normalise_results(spark):
    got = apply(spark, "map<string,string>", [{" Amikacin ": "pos", "CEFA": "neg", "x": "s"}, {}], values.normalise_results)
    assert got == [{"S/I/R_amikacin": "+", "S/I/R_cefa": "-", "S/I/R_x": "S"}, {}]
    twice = apply(spark, "map<string,string>", [{"a": "r", "A ": "s"}], values.normalise_results)[0]
    assert list(twice) == ["S/I/R_a"]


@pytest.mark.parametrize("top,bottom,want", [(1, 2, 0.5), (3, 0, 0.0)])
def test_safe_ratio(spark, top, bottom, want):
    df = spark.createDataFrame([(top, bottom)], "a int, b int")
    assert df.select(values.safe_ratio(F.col("a"), F.col("b"))).first()[0] == want
