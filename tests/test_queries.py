"""Queries against their SQL, on rows that the driver's tables don't have."""

import duckdb
import pytest

import __spark_entry__

ODD = {
    "no tokens": [(1, "a b a"), (2, ""), (3, None), (4, " \n "), (5, "b")],
    "carriage returns": [(1, "a\r\nb\r\na"), (2, "x\ry z\r"), (3, "a b")],
    "other blanks": [(1, "a\tb c\x0bd \x85  　 \x00k"), (2, "a\tb")],
    "more tokens than entries": [(i, " ".join(f"w{(i * 7 + j) % 700}\r" for j in range(30))) for i in range(100)],
    "no tokens at all": [(1, ""), (2, " ")],
    "no rows": [],
}


@pytest.mark.parametrize("rows", ODD.values(), ids=ODD)
def test_apply_vocabulary_array(spark, tmp_path, rows):
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1).write.parquet(path)
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS SELECT * FROM '{path}/*.parquet'")
        want = db.execute(__spark_entry__.oracle_sql()["apply_vocabulary_array"]).fetchall()
    got = __spark_entry__.queries()["apply_vocabulary_array"](spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("ids", "string")]
    assert sorted(map(tuple, got.collect())) == sorted(want)
