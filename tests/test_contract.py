"""CSV scans by column name: against pandas, and rows that break the contract."""

import gzip
import io as streams
import pathlib

import pandas as pd
import pytest

from riskframe.operators import evaluate
from riskframe.sources import contract, io

KINDS = "id long, age double, w int, name string"


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()

    def make(**files):
        for name, text in files.items():
            (tmp_path / "in" / f"{name}.csv").write_text(text)
        return str(tmp_path / "in")
    return make


def rows(df):
    return sorted((tuple(None if v != v else v for v in r) for r in df.collect()), key=repr)


def test_names_decide_as_in_pandas(spark, folder):
    texts = {"a": 'id,age,w,name\n1,3.5,10,x\n2,,,"a, b"\n', "b": "name,w,id,other\ny,7,11,zz\n,8,12,q\n", "c": "w,id\n1,21\n"}
    got = io.read_csv(spark, folder(**texts), KINDS)
    want = pd.concat(pd.read_csv(streams.StringIO(t)) for t in texts.values())
    want = [tuple(None if pd.isna(v) else v for v in r) for r in want[["id", "age", "w", "name"]].itertuples(index=False)]
    assert rows(got) == sorted(want, key=repr)


def test_types_are_inferred_per_header_and_stacked(spark, folder):
    path = folder(a="x,y\n1,a\n2,b\n", b="y,x\nc,2.5\n", c="x,z\nlong,5\n")
    df = io.read_csv_glob(spark, path + "/*.csv")
    assert dict(df.dtypes)["x"] == "string" and rows(df.select("y", "z")) == sorted(
        [("a", None), ("b", None), ("c", None), (None, 5)], key=repr)


def test_broken_rows_are_kept_apart_with_reasons(spark, folder, tmp_path):
    path = folder(a='id,age,w,name\n1,3.5,10,ok\n2,old,1,n\n3,1.0,2.5,n\n4,1,2,n,extra\n5,1\n,1,1,n\n6,2e1,3.0,ok\n7,1e400,99999999999,n\n',
                  b="", c="id,age,w,name\n", d="w,age\n1,2\n")
    found = contract.scan(spark, path, KINDS, required=["id"], with_source=True)
    assert rows(found.rows.drop("source_file")) == sorted([(1, 3.5, 10, "ok"), (6, 20.0, 3, "ok")], key=repr)
    reasons = sorted((r.record.split(",")[0], tuple(r.reasons)) for r in found.quarantine.collect())
    assert reasons == sorted([("2", ("age: not double",)), ("3", ("w: not int",)), ("4", ("fields",)), ("5", ("fields",)),
                              ("", ("id: missing",)), ("7", ("w: not int",)), ("1", ("id: missing",))])
    counts = {r.reason: r.rows for r in contract.write_quarantine(found, str(tmp_path / "bad")).collect()}
    assert counts == {"fields": 2, "age: not double": 1, "w: not int": 2, "id: missing": 2}
    assert {(r.header, r.files, tuple(r.missing)) for r in found.headers.collect()} == {
        ("id,age,w,name", 2, ()), ("w,age", 1, ("id", "name"))}
    assert contract.scan(spark, path, KINDS, keep_broken=True).rows.count() == 9
    # counting alone must find the same broken rows
    assert found.rows.select("id").count() == 2 and found.quarantine.count() == 7


def test_header_names(spark, folder):
    assert contract.header_names('﻿a,"b ""c"", d",a,,a\r\n') == ("a", 'b "c", d', "a.1", "Unnamed: 3", "a.2")
    path = folder(a="a,A,a.b,`q`\n1,2,3,4\n")
    got = contract.scan(spark, path, "`a.b` int, A int, a int, `q` int", with_row_seq=True)
    assert [tuple(r)[:3] for r in got.rows.collect()] == [(3, 2, 1)]
    assert contract.scan(spark, folder(z="x\n"), "y int").headers.count() == 2


def test_gzip_and_order(spark, folder):
    path = folder(a="id,w\n3,1\n1,2\n2,3\n")
    pathlib.Path(path, "b.csv.gz").write_bytes(gzip.compress(b"w,id\n9,8\n"))
    df = io.read_csv(spark, path, "id long, w int", with_row_seq=True)
    assert [r.id for r in df.orderBy("row_seq").collect()] == [3, 1, 2, 8]


def test_rows_without_a_label_are_no_negatives(spark):
    df = spark.createDataFrame([(1.0, 0.9), (0.0, 0.2), (None, 0.95), (None, 0.99), (1.0, None)], "y double, p double")
    areas = evaluate.curve_areas(df, "y", "p").head()
    assert areas.roc_auc == 1.0 and areas.pr_auc == 1.0
