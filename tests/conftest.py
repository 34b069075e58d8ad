import io
import os
import sys
from contextlib import redirect_stdout

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dunwright.session import local_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


def explain(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.fixture(scope="session")
def spark():
    return local_session(app="tests")


@pytest.fixture(scope="session")
def scored(spark):
    from dunwright.operators.ordering import materialize
    from dunwright.plans.registry import Tables

    return materialize(Tables(spark, SMALL).scored)
