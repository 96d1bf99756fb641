import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import SparkSession

from erisk.session import configure


@pytest.fixture(scope="session")
def spark():
    session = (configure(SparkSession.builder.master("local[4]").appName("erisk-tests"))
               .config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false")
               .config("spark.driver.extraJavaOptions", "-XX:TieredStopAtLevel=1")   # short runs: less compiling
               .config("spark.driver.memory", "6g").getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
