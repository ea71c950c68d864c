import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import features as feat
from ledgerlens.functions import quality, scalars
from ledgerlens.schema import TRANSACTION_FIELDS, coerce, sanitize_columns
from ledgerlens.sources import readers


def test_validation_keeps_the_one_good_row(txns):
    rows = txns(
        {"transactionAmount": 100.0},
        {"transactionAmount": -10.0},
        {"accountNumber": None},
        {"merchantName": None},
        {"transactionDateTime": None},
    )
    kept = quality.validate(rows).collect()
    assert [r.transactionAmount for r in kept] == [100.0]
    reasons = {r.row_key: list(r.reject_reasons) for r in quality.rejects(rows).collect()}
    assert reasons[1] == ["amount not positive"] and reasons[2] == ["accountNumber missing"]
    assert set(reasons) == {1, 2, 3, 4}


def test_absent_required_columns_reject_everything(spark):
    df = spark.createDataFrame([("m",)], "merchantName string")
    assert quality.validate(df).count() == 0


def test_flags_and_time_features(txns):
    row = feat.amount_ratio(
        feat.account_age(feat.temporal(feat.risk_flags(txns({"enteredCVV": "999", "merchantCountryCode": "US"}))))
    ).first()
    assert (row.txn_hour, row.is_night_txn, row.cvv_mismatch, row.cross_border) == (2, 1, 1, 1)
    assert row.account_age_days > 0 and row.utilization > 0


def test_edge_values(txns):
    rows = txns(
        {"creditLimit": 0.0, "acqCountry": None, "merchantCountryCode": None, "cardCVV": None, "accountOpenDate": "2019-04-01"}
    )
    row = feat.amount_ratio(feat.account_age(feat.risk_flags(rows))).first()
    assert (row.utilization, row.amount_to_limit_ratio, row.cross_border, row.cvv_mismatch) == (0.0, 0.0, 0, 0)
    assert row.account_age_days == 0


def test_days_are_elapsed_not_calendar(txns):
    row = feat.account_age(txns({"transactionDateTime": "2016-01-02 00:01:00", "accountOpenDate": "2016-01-01 23:59:00"})).first()
    assert row.account_age_days == 0


@pytest.mark.parametrize(
    "text, expected",
    [("2016-08-01T23:45:00", "2016-08-01 23:45:00"), ("06/2020", "2020-06-01 00:00:00"), ("7/4/2019", "2019-07-04 00:00:00"), ("not-a-date", None)],
)
def test_time_forms(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(scalars.to_time(F.col("t")).cast("string")).first()[0]
    assert got == expected


def test_coerce_adds_drops_and_orders(spark):
    df = spark.createDataFrame([("Yes", "12.5", "x")], "isFraud string, transactionAmount string, other string")
    out = coerce(df)
    assert out.columns == list(TRANSACTION_FIELDS)
    assert (out.first().isFraud, out.first().transactionAmount, out.first().accountNumber) == (True, 12.5, None)


def test_sanitize_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a", "b", "c"]).toDF("", "Unnamed: 0", "c")
    assert sanitize_columns(df).columns == ["row_id", "row_id_2", "c"]


def test_bucket_edges(spark):
    df = spark.createDataFrame([(v,) for v in (-1, 0, 30, 31, 1095, 1096, None)], "v int")
    got = [r[0] for r in df.select(scalars.account_age_bucket(F.col("v"))).collect()]
    assert got == [None, "0-30 days", "0-30 days", "31-90 days", "2-3 years", "3+ years", None]


def test_low_threshold_band_is_critical(spark):
    df = spark.createDataFrame([(0.4,), (0.6,), (0.1,)], "p double")
    assert [r[0] for r in df.select(scalars.risk_band(F.col("p"), 0.3)).collect()] == ["critical", "critical", "normal"]


def test_csv_and_jsonl_readers(spark, tmp_path):
    (tmp_path / "t.csv").write_text(
        "isFraud,accountNumber,transactionAmount,posEntryMode\nFalse,a,1.0,05\nFalse,NA,x,\nTrue,c,3.0,9\n"
    )
    rows = readers.read_transactions(spark, str(tmp_path / "t.csv")).collect()
    assert [r.isFraud for r in rows] == [False, False, True]
    assert (rows[0].posEntryMode, rows[1].accountNumber, rows[1].transactionAmount) == ("05", None, None)
    (tmp_path / "t.jsonl").write_text('{"accountNumber": "a", "cardPresent": true}\n\n{"accountNumber": ""}\n')
    rows = readers.read_transactions(spark, str(tmp_path / "t.jsonl")).collect()
    assert [(r.accountNumber, r.cardPresent) for r in rows] == [("a", True), ("", None)]
    (tmp_path / "bad.jsonl").write_text('{"accountNumber": \n')
    with pytest.raises(Exception, match="FAILFAST|Malformed|malformed"):
        readers.read_transactions(spark, str(tmp_path / "bad.jsonl")).collect()


def test_payload_lists_and_rejects(spark):
    df = spark.createDataFrame([('[{"accountNumber":"a"},{"accountNumber":"b"}]',), ("nonsense",)], "value string")
    assert [r.accountNumber for r in readers.from_records(df).collect()] == ["a", "b"]
    assert readers.payload_rejects(df).count() == 1
