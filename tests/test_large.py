"""Queries against their SQL on keys and tables as they are at larger scales."""

import datetime

import pyarrow as pa
import pyarrow.parquet as pq

from tests.compare import duck, spark_rows
from tidemark import catalog
from tidemark.functions import values as V


def test_sizes_of_orders_beyond_a_terabyte(spark, tmp_path):
    keys = [0, 1, 31, 32, 320, 1023, 1024, 32767, 32768, 327_680, 1_048_575, 1_048_576, 1_579_616, 8_999_999]
    days = [datetime.datetime(1995, 1, 1) + datetime.timedelta(hours=7 * k % 50_000) for k in keys]
    pq.write_table(pa.table({"o_orderkey": pa.array(keys, pa.int64()), "o_orderdate": pa.array(days, pa.timestamp("us"))}), tmp_path / "orders.parquet")
    found = spark_rows(catalog.queries()["words_of_orders"](spark, str(tmp_path)))
    assert found == duck(catalog.oracle_sql()["words_of_orders"], str(tmp_path))
    assert {r[found[0].index("size")].split()[-1] for r in found[1]} == set(V.BYTE_UNITS[:4])
