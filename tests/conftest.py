import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from memaudit import get_spark
    scratch = tempfile.mkdtemp(prefix="memaudit-tests-")
    s = get_spark("local[*]", 8, app_name="memaudit-tests",
                  extra={"spark.checkpoint.dir": os.path.join(scratch, "ckpt"),
                         "spark.local.dir": os.path.join(scratch, "local")})
    yield s


@pytest.fixture()
def tmpdir_path():
    return tempfile.mkdtemp(prefix="memaudit-t-")


def one(spark, col, value, schema="x string"):
    """Evaluate a Column expression on a single-row frame."""
    return spark.createDataFrame([(value,)], schema).select(col.alias("r")).first()["r"]
