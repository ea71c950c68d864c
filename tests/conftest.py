import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

from ledgerlens.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "tests",
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "4",
            "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared")),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "4g",
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def txns(spark):
    """Build transaction rows from overrides of one complete sample row."""
    from ledgerlens.schema import transaction_schema
    from pyspark.sql import types as T

    text = {"string": "x1", "double": 40.0, "boolean": True}
    sample = {f.name: text[f.dataType.simpleString()] for f in transaction_schema().fields}
    sample |= {
        "accountNumber": "77",
        "customerId": "c77",
        "merchantName": "kiosk",
        "transactionDateTime": "2019-03-14T02:10:00",
        "transactionAmount": 32.0,
        "creditLimit": 900.0,
        "availableMoney": 610.0,
        "currentBalance": 290.0,
        "acqCountry": "CAN",
        "merchantCountryCode": "CAN",
        "posEntryMode": "09",
        "currentExpDate": "2023-06-01",
        "accountOpenDate": "2012-05-20",
        "dateOfLastAddressChange": "2018-11-11",
        "cardCVV": "918",
        "enteredCVV": "918",
        "isFraud": False,
    }
    schema = transaction_schema()
    keyed = T.StructType([T.StructField("row_key", T.LongType()), *schema.fields])

    def make(*overrides):
        rows = [
            tuple([i] + [{**sample, **o}[f.name] for f in schema.fields]) for i, o in enumerate(overrides)
        ]
        return spark.createDataFrame(rows, keyed)

    return make
