"""Declared table schemas agree with the files (names and types), at every scale."""

import pytest
from pyspark.sql.types import StructType

from vigil.sources import tables as T

SCALES = ["/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"]


@pytest.mark.parametrize("name", sorted(T.SCHEMAS))
def test_declared_schema_matches_files(spark, name):
    declared = StructType.fromDDL(T.SCHEMAS[name])
    for sf in SCALES:
        inferred = spark.read.parquet(T.table_path(sf, name)).schema
        assert [(f.name, f.dataType) for f in inferred] == [(f.name, f.dataType) for f in declared], (sf, name)


def test_declared_read_prunes_columns(spark):
    df = T.read_table(spark, SCALES[0], "events", ["event_id", "ts"])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in plan
