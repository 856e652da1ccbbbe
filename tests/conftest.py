import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from linecdc.session import get_spark

    s = get_spark("local[4]", app="linecdc-tests", shuffle_partitions=4)
    yield s


def lines_df(spark, files: dict, version: int = 2):
    """{file_name: [line, ...]} -> lines(file_name, version, line_number, line)."""
    rows = [(f, version, i + 1, x) for f, ls in files.items() for i, x in enumerate(ls)]
    return spark.createDataFrame(rows, "file_name string, version long, line_number int, line string")
