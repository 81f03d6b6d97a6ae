import pytest

from tickloom.session import session


@pytest.fixture(scope="session")
def spark():
    spark = session("tests", "local[4]", **{"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.sql.ansi.enabled": "true"})
    spark.sparkContext.setLogLevel("ERROR")
    yield spark
    spark.stop()
