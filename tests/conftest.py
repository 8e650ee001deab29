import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from doppel.session import DEFAULT_CONF
    b = (SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "8")
         .config("spark.driver.memory", "6g"))
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    s = b.getOrCreate()
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="doppel-test-ckpt-"))
    yield s


PERSON_SCHEMA = ("person_id bigint, campus_id int, first_name string, last_name string, email string, "
                 "street string, city string")


def persons_df(spark, rows):
    return spark.createDataFrame(rows, PERSON_SCHEMA)
