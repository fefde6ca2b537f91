import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def edge_docs(spark):
    import edge

    return edge.documents(spark)


@pytest.fixture(scope="session")
def no_docs(spark):
    import edge

    return edge.documents(spark, [])
