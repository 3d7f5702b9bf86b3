"""The hotel model mapped from the driver tables is itself clean: every
declared NOT NULL column filled, every key unique, every reference resolved
(sf0.01, the scale of the driver's cross-engine check)."""

from __future__ import annotations

import pytest
from pyspark.sql.types import StringType

from innsight.operators import quality
from innsight.sources.derived import TEXT_KEYS, hotel_tables
from innsight.sources.schemas import TABLES, schema

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def mapped(spark):
    return hotel_tables(spark, SF)


def test_every_mapped_table_has_its_declared_shape(mapped):
    def shape(st):  # names and types; nullability is Spark's own inference
        return [(f.name, StringType() if f.name in TEXT_KEYS else f.dataType) for f in st.fields]

    for name in mapped:
        assert shape(mapped[name].schema) == shape(schema(name)), name
    assert set(mapped) <= set(TABLES)


def test_mapping_is_clean(mapped):
    assert quality.null_report(mapped).where("null_rows > 0").collect() == []
    assert quality.key_report(mapped).where("duplicate_keys > 0").collect() == []
    assert quality.orphan_report(mapped).where("orphan_rows > 0").collect() == []


def test_mapping_row_counts_follow_the_driver(spark, mapped):
    src = {n: spark.read.parquet(f"{SF}/{n}.parquet").count() for n in ("region", "orders", "lineitem", "part")}
    assert mapped["hotel"].count() == src["region"]
    assert mapped["reservation"].count() == src["orders"]
    assert mapped["charge"].count() == src["lineitem"]
    assert mapped["room"].count() == src["part"]
