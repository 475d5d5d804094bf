import datetime as dt
import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    scratch = tempfile.mkdtemp(prefix="tidemark-test-")
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.warehouse.dir", os.path.join(scratch, "warehouse"))
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    from tidemark.session import checkpoint_dir
    checkpoint_dir(s)
    yield s


def ts(s: str) -> dt.datetime:
    """'YYYY-MM-DD[ hh:mm:ss]' -> naive datetime."""
    return dt.datetime.fromisoformat(s)


ORDERS_SCHEMA = "user_id long, order_id long, amount double, ts timestamp_ntz"
SALES_SCHEMA = "artist string, company string, price double, date timestamp_ntz, category_size string, size double"
