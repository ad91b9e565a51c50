import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SMOKE


POST_COLUMNS = (
    "id",
    "general",
    "character",
    "copyright",
    "rating",
    "score",
    "image_width",
    "image_height",
    "created_at",
)


@pytest.fixture(scope="session")
def make_posts(spark):
    from tagloom.schemas import POSTS

    def make(*rows):
        full = []
        for i, row in enumerate(rows):
            post = {
                "id": i,
                "general": "1girl, blue hair",
                "character": "bbb",
                "copyright": "aaa",
                "rating": "g",
                "score": 10,
                "image_width": 896,
                "image_height": 1152,
                "created_at": "2021-05-01T00:00:00.000-05:00",
            } | row
            full.append(tuple(post[c] for c in POST_COLUMNS))
        return spark.createDataFrame(full, POSTS)

    return make
