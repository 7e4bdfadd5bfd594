import pytest

from haulmetrics.session import build_session


@pytest.fixture(scope="session")
def spark():
    session = build_session("local[4]", spark_sql_shuffle_partitions="8", spark_ui_enabled="false", spark_driver_memory="4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()
