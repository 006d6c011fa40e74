import datetime
import decimal

import pytest

from labspark.sources.inference import inferred
from labspark.sources.tables import read_csv


@pytest.mark.parametrize(
    "cells,kind",
    [
        (["1", "-20", "+3", None], "bigint"),
        (["1", "007"], "string"),
        (["0", "00"], "string"),
        (["1", "2.50"], "double"),
        (["1e5", "2"], "double"),
        (["1234567890123456789"], "decimal(19,0)"),
        (["123456789012345678.25", "1"], "decimal(20,2)"),
        (["1" * 39], "string"),
        (["true", "False"], "boolean"),
        (["true", "1"], "string"),
        (["2020-02-29", None], "date"),
        (["2020-02-30"], "string"),
        (["2020-02-29", "2020-02-29 10:11:12.5"], "timestamp"),
        (["2020-02-29", "20200229"], "string"),
        (["a", "1"], "string"),
        ([None, None], "string"),
        ([], "string"),
        ([""], "string"),
    ],
)
def test_least_type(spark, cells, kind):
    df = spark.createDataFrame([(c,) for c in cells], "`a.b` string")
    got = inferred(df)
    assert got.dtypes == [("a.b", kind)]
    assert got.count() == len(cells)


def test_values_keep_their_digits(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,code,n,flag,day,"a,b"\n1,007,123456789012345678.25,True,2020-01-02,NA\n2,010,-3.5,false,,x\n')
    got = read_csv(spark, str(tmp_path), line_no="line", typed=True, keep_text=["id"])
    assert dict(got.dtypes) == {"id": "string", "code": "string", "n": "decimal(20,2)", "flag": "boolean", "day": "date", "a,b": "string", "line": "bigint"}
    assert [tuple(r) for r in got.orderBy("line").collect()] == [
        ("1", "007", decimal.Decimal("123456789012345678.25"), True, datetime.date(2020, 1, 2), None, 2),
        ("2", "010", decimal.Decimal("-3.50"), False, None, "x", 3),
    ]


def test_malformed_records_stay_text(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,2\n3\n4,5,6\n7,8\n")
    got = read_csv(spark, str(tmp_path), malformed="bad", typed=True)
    assert dict(got.dtypes)["bad"] == "string" and dict(got.dtypes)["a"] == "bigint"
    assert sorted(r.bad or "" for r in got.collect()) == ["", "", "3", "4,5,6"]


def test_each_column_is_told_by_one_expression_of_fixed_size(spark, monkeypatch):
    """The plan does not grow with the columns: a pattern stands in it once, not once per column and use."""
    from labspark.sources import inference

    seen, real = [], inference.kind
    monkeypatch.setattr(inference, "kind", lambda cell: seen.append(cell) or real(cell))
    df = spark.createDataFrame([("1", "-1.25", "x", None, "+2.5e3"), ("20", "7", "2020-01-01", None, "1E-2")], "a string, b string, c string, d string, e string")
    found = inference.cells(df, df.columns)
    assert len(seen) == 1
    assert [(c.whole, c.fraction, c.exponent, c.type()) for c in found.values()] == [
        (2, 0, False, "bigint"), (1, 2, False, "double"), (0, 0, False, "string"), (0, 0, False, "string"), (1, 1, True, "double")
    ]
