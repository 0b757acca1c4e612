import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    from tessera.session import tune
    s = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false").config("spark.checkpoint.dir", shared).config("spark.driver.memory", "6g").config("spark.sql.codegen.cache.maxEntries", "1000").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    return tune(s)
