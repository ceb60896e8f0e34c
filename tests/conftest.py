import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from footfall.session import configure  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="warehouse-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield configure(session)
    session.stop()


@pytest.fixture
def views(spark):
    """Make page views from (visitor, time, page view) rows with all stored dimensions."""
    from pyspark.sql import functions as F

    from footfall import schemas

    def make(rows, **columns):
        df = spark.createDataFrame(rows, "daily_visitor_id string, t string, page_view_id string")
        df = df.select("daily_visitor_id", "page_view_id", F.col("t").cast("timestamp").alias("event_timestamp"))
        df = df.withColumns({"event_date": F.to_date("event_timestamp"), "event_type": F.lit("pageview")})
        kinds = {p.split()[0]: p.split()[1] for p in schemas.INCOMING.split(",")}
        for name in schemas.STORED_DIMS:
            if name not in df.columns:
                df = df.withColumn(name, F.lit(columns.get(name)).cast(kinds[name]))
        if "domain_name" not in columns:
            df = df.withColumn("domain_name", F.lit("a.example"))
        return df

    return make
