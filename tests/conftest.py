import os
import sys
from datetime import datetime, timedelta

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = (SparkSession.builder.master("local[8]").appName("tests").config("spark.ui.enabled", "false")
               .config("spark.driver.memory", "6g").config("spark.sql.shuffle.partitions", "4").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    from trafficlens.session import prepare

    yield prepare(session)
    session.stop()


@pytest.fixture(scope="session")
def data():
    return DATA


@pytest.fixture()
def make_log(spark):
    """Request log from (offset in seconds, user, endpoint[, overrides]) tuples."""
    from trafficlens.schema import REQUEST_LOG
    from trafficlens.sources.request_log import normalise

    start = datetime(2024, 1, 1)

    def build(rows):
        out = []
        for i, (offset, user, endpoint, *rest) in enumerate(rows):
            row = dict(request_id=i, timestamp=start + timedelta(seconds=offset), user_id=user, ip="10.0.0.1",
                       endpoint=endpoint, method="GET", status_code=200, response_time=10.0, user_agent="a",
                       traffic_type="normal", is_bot=0, is_attack=0)
            row.update(rest[0] if rest else {})
            out.append(tuple(row[f.name] for f in REQUEST_LOG.fields))
        return normalise(spark.createDataFrame(out, REQUEST_LOG))

    return build
