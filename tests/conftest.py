import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC").config("spark.driver.host", "127.0.0.1").config("spark.sql.warehouse.dir", "/tmp/seekwell-test-warehouse").getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


GREETING = "Hello"
FILES = {
    "h.bat": '#!/bin/sh\necho "Hello World!"\n',
    "h.sh": '#!/bin/sh\necho "Hello World!"\n',
    "h.java": "\n".join(["module demo.words.;", "", "record shape Hello -- shows on Hello World! greeting", "[ begin one inner part (with no names )", '  [ Console.showing.to("Hello World!");', "  ]", "]", ""]),
    "h.txt": GREETING,
    "empty.txt": "",
    "emptyline.txt": "\n",
}


@pytest.fixture(scope="session")
def files(spark):
    return spark.createDataFrame(list(FILES.items()), "key string, text string").cache()


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())
