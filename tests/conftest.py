import os
import sys
from dataclasses import replace

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tools"))

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from shelfline.session import build_session

    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("OFF")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def registered():
    """The settings of the registered series queries."""
    from shelfline import series_catalog

    return series_catalog.CONFIG


@pytest.fixture(scope="session", autouse=True)
def small_ensemble(registered):
    """Tests train the small ensemble; the registered queries train the published one."""
    from shelfline import series_catalog
    from shelfline.config import quick_ensemble

    series_catalog.CONFIG = replace(registered, ensemble=quick_ensemble())
    yield
    series_catalog.CONFIG = registered


@pytest.fixture(scope="session")
def tables(spark):
    from shelfline.sources import ParquetTestbed

    return ParquetTestbed(spark, SMALL)


@pytest.fixture(scope="session")
def space(tables):
    from shelfline.series_catalog import workspace

    return workspace(tables)
