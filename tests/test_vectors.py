"""Vector literals at ties of the eighth decimal, at large, signed and non-finite components: as in SQL and as Python prints them."""

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tessera.functions import columns as C
from tessera.plans import more

NAN = np.float32("nan")
ODD = [
    [0.103515625] * 64,
    [k / 512 for k in range(-63, 65, 2)],
    [k / 1024 for k in range(64)],
    [3.4e38, -1e22, 2.0**60 + 2.0**40, 16777217.0] * 16,
    [0.0, -0.0, 1e-12, -1e-12, 5e-9, -5e-9, 1.5e-8, 1e-45] * 8,
    [float("inf"), float("-inf"), 0.25, -0.25] * 16,
    [float(NAN), float(-NAN), 1 / 512, -1 / 512] * 16,
    [None, 0.103515625] * 32,
    [None] * 64,
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Each odd vector under ids of every remainder by 6."""
    path = tmp_path_factory.mktemp("vectors")
    rows = {"vec_id": pa.array(range(6 * len(ODD)), pa.int64()), "embedding": pa.array([v for v in ODD for _ in range(6)], pa.list_(pa.float32())), "label": pa.array([0] * 6 * len(ODD), pa.int32())}
    pq.write_table(pa.table(rows), path / "embeddings.parquet")
    return str(path)


def compare(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    got, want = more.queries()[name](spark, folder).collect(), con.execute(more.oracle_sql()[name]).fetchall()
    assert len(got) == 6 * len(ODD)
    assert sorted(map(tuple, got)) == sorted(want)


def test_literals_of_odd_vectors(spark, folder):
    compare(spark, folder, "vector_literals")


def test_literals_of_doubles(spark):
    values = [0.103515625, 1.000000005, 5e-9, 1e23, -123456789012345678.0, 0.1]
    df = spark.createDataFrame([(1, values), (2, values[::-1])], "k int, v array<double>")
    got = [r[0] for r in df.orderBy("k").select(C.vector_literal(F.col("v"), len(values))).collect()]
    assert got == ["[" + ",".join(f"{x:.8f}" for x in v) + "]" for v in (values, values[::-1])]


def test_literal_of_another_length(spark):
    for v in ([1.0], None, []):
        with pytest.raises(Exception, match="not of length 2"):
            spark.createDataFrame([(v,)], "v array<float>").select(C.vector_literal(F.col("v"), 2)).collect()


def test_store_of_odd_vectors(spark, folder):
    """A third of the vectors is replaced by its negatives: ties of both signs."""
    compare(spark, folder, "vector_store")
