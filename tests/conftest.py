import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

SF001 = "/root/testdata/sf0.001"
SF01 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from quarry import get_spark
    s = get_spark("local[4]", 4, driver_memory="8g")
    # tiny buckets, so every K1 / K3 path with several buckets is exercised
    s.conf.set("spark.quarry.rowsPerBucket", "64")
    yield s


@pytest.fixture(scope="session")
def events(spark):
    return spark.read.parquet(f"{SF001}/events.parquet")


@pytest.fixture(scope="session")
def part(spark):
    return spark.read.parquet(f"{SF01}/part.parquet")
