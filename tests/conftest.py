import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from docassay.session import session

    spark = session("local[4]", 4, spark__driver__memory="4g", spark__ui__showConsoleProgress="false", spark__checkpoint__dir=f"file://{tmp_path_factory.mktemp('shared')}")
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
