import pytest

from groundline.session import session


@pytest.fixture(scope="session")
def spark():
    return session(4, "4g", spark__sql__shuffle__partitions="4", spark__default__parallelism="4", spark__sql__streaming__stateStore__providerClass="org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
