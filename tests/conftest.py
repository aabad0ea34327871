import datetime as dt
import os
import sys
from decimal import Decimal
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"  # for Spark's Python workers


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


TRADES = [
    (1, "alpha", "north", Decimal("12.50"), 4, 0.5, dt.date(2025, 1, 3)),
    (2, "alpha", "south", Decimal("7.25"), 10, None, dt.date(2025, 2, 3)),
    (3, "beta", "north", None, 3, 0.25, None),
    (4, "beta", None, Decimal("100.00"), -2, -1.5, dt.date(2025, 4, 3)),
    (5, None, "north", Decimal("0.05"), 0, 8.0, dt.date(2025, 5, 3)),
]


@pytest.fixture(scope="session")
def engine(spark):
    from tallyspark.engine import Engine
    from tallyspark.queries import Samples
    from tallyspark.sources.catalog import Catalog
    from tallyspark.whatif.plugin import WhatIfPlugin
    from tallyspark.whatif.scenarios import MemoryStore

    catalog = Catalog(spark)
    frame = spark.createDataFrame(TRADES, "id int, book string, zone string, price decimal(10,2), qty int, yield double, day date")
    catalog.register_frame("trades", frame, key_columns=["id"], version="v1", editable=["price", "qty", "yield"])
    keyless = spark.createDataFrame([(3.0,), (1.0,), (2.0,), (float("nan"),)], "v double").coalesce(1)
    catalog.register_frame("loose", keyless, version="v1")
    return Engine(spark, catalog, [Samples(), WhatIfPlugin(MemoryStore())])


@pytest.fixture
def rows(engine):
    def run(query, dataset="trades", **more):
        return engine.run({"dataset": dataset, "query": query, **more}).to_records(decimals="str")

    return run
