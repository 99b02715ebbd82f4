from __future__ import annotations

import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("wordmine-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoints")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def corpus(spark):
    """A function that makes a corpus from texts."""

    def make(*texts: str, partitions: int = 2):
        rows = list(enumerate(texts))
        df = spark.createDataFrame(rows, "doc_id bigint, text string")
        return df.repartition(partitions)

    return make


@pytest.fixture
def words(spark):
    """A function that makes a word list."""

    def make(*items: str):
        return spark.createDataFrame([(w,) for w in items], "word string")

    return make
