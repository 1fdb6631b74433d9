import hashlib
import hmac
import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from paysift import schemas
from paysift.functions import payments as P
from paysift.operators import features as FE
from paysift.operators import layers as LA
from paysift.operators import quality as Q
from paysift.sources import ingest as S
from paysift.streaming import cards


def one(spark, column, **values):
    kinds = {str: "string", float: "double", int: "long"}
    schema = ", ".join(f"{k} {kinds.get(type(v), 'string')}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize("key", ["13926|315|gmail.com", "", "é漢"])
@pytest.mark.parametrize("salt", ["s", "x" * 64, "y" * 100])
def test_token_is_hmac(spark, key, salt):
    assert one(spark, P.card_token(F.col("k"), salt), k=key) == hmac.new(salt.encode(), key.encode(), hashlib.sha256).hexdigest()[:32]


def test_token_of_null(spark):
    assert one(spark, P.card_token(F.lit(None).cast("string"), "s")) is None


@pytest.mark.parametrize("identifier", [0, 1, 2987000, 10**15])
def test_fraction(spark, identifier):
    assert one(spark, P.fraction(F.col("i"), 42), i=identifier) == int.from_bytes(hashlib.sha256(f"42:{identifier}".encode()).digest()[:8], "big") / 2**64


def test_card_key(spark):
    key = P.card_key(F.col("a"), F.col("b"), F.col("c"))
    assert one(spark, key, a=13926.0, b=315.5, c="gmail.com") == "13926|315.5|gmail.com"
    assert one(spark, key, a=float("nan"), b=None, c=" ") == "unknown|unknown|unknown"


def test_time(spark):
    assert P.parse_epoch("2023-01-01T00:00:00Z") == P.parse_epoch("2023-01-01") == P.EPOCH
    assert one(spark, P.transaction_dt(P.event_time(F.col("s"))), s=86_400) == 86_400
    assert one(spark, P.span_days(F.col("a"), F.col("b")), a=0, b=129_600) == 1.5


@pytest.mark.parametrize("amount, band", [(0.0, "small"), (50.0, "moderate"), (250.0, "large"), (1000.0, "very large"), (5000.0, "exceptional")])
def test_bands(spark, amount, band):
    assert one(spark, P.amount_band(F.col("a")), a=amount) == band


@pytest.mark.parametrize("score, made", [(0.9, "block"), (0.5, "review"), (0.49, "allow")])
def test_decide(spark, score, made):
    assert one(spark, P.decide(F.col("s"), 0.5, 0.9), s=score) == made


def _payments(spark, rows):
    return spark.createDataFrame(rows, "transaction_id long, event_time timestamp, card_token string, amount double, device_info string, r_emaildomain string")


def _at(second):
    return datetime.fromtimestamp(1_685_620_800 + second, timezone.utc)


def test_features_by_hand(spark):
    rows = [(1, _at(0), "c", 10.0, None, "a"), (2, _at(600), "c", 30.0, "d", "a"), (3, _at(601), "c", 20.0, "d", "b"), (4, _at(86_400), "c", 5.0, "e", None), (5, _at(0), "x", 1.0, "d", "a")]
    for build in (FE.add_card_features, FE.add_card_features_by_day):
        got = {r.transaction_id: r for r in build(_payments(spark, rows)).collect()}
        assert [got[i].card_txn_count_10m for i in (1, 2, 3, 4)] == [1, 2, 2, 1]
        assert [got[i].card_txn_count_24h for i in (1, 2, 3, 4)] == [1, 2, 3, 4]
        assert [got[i].card_amount_sum_24h for i in (1, 2, 3, 4)] == [10, 40, 60, 65]
        assert [got[i].seconds_since_card_last_txn for i in (1, 2, 3, 4)] == [-1, 600, 1, 85_799]
        assert [got[i].card_amount_avg_lifetime for i in (1, 2, 3, 4)] == [0, 10, 20, 20]
        assert [got[i].amount_to_card_avg_ratio for i in (1, 2, 3, 4)] == [1, 3, 1, 0.25]
        assert [got[i].card_new_device for i in (1, 2, 3, 4, 5)] == [0, 1, 0, 1, 0]
        assert [got[i].card_new_email_domain for i in (1, 2, 3, 4)] == [0, 0, 1, 0]
        assert [got[i].card_distinct_devices for i in (1, 2, 3, 4)] == [0, 0, 1, 1]
        assert [got[i].card_is_new for i in (1, 2, 5)] == [1, 0, 1]
        assert got[1].hour_of_day == 12 and got[1].day_of_week == 3 and got[1].is_night == 0


def test_later_payments_change_nothing(spark):
    rows = [(i, _at(i * 700), f"c{i % 3}", float(i + 1), f"d{i % 4}", "a") for i in range(40)]
    early = {r.transaction_id: r for r in FE.add_card_features(_payments(spark, rows[:25])).collect()}
    late = {r.transaction_id: r for r in FE.add_card_features(_payments(spark, rows)).collect()}
    assert all(early[i] == late[i] for i in early)


def test_same_second(spark):
    got = {r.transaction_id: r for r in FE.add_card_features(_payments(spark, [(1, _at(5), "c", 1.0, None, None), (2, _at(5), "c", 2.0, None, None)])).collect()}
    assert [got[i].card_txn_count_10m for i in (1, 2)] == [2, 2] and [got[i].card_txn_count_lifetime for i in (1, 2)] == [0, 1]


def _message(spark, bodies):
    rows = [(None, json.dumps(b).encode() if isinstance(b, dict) else b, "t", i % 3, i, _at(0)) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, schemas.MESSAGE)


def _event(i, amount=5.0, **more):
    return {"transaction_id": i, "event_time": "2023-06-01T12:00:00Z", "transaction_dt": 1, "card_key": "k", "amount": amount, "product_cd": "W"} | more


def test_bronze_and_silver(spark):
    bronze = S.parse_payment_events(_message(spark, [_event(1), b"{bad", b"", {"amount": 1}, _event(2, 0.0), _event(1, 9.0), _event(3, counts={"C1": 2.0})]))
    assert sorted(r.transaction_id for r in bronze.collect()) == [1, 1, 2, 3]
    silver = LA.to_silver(bronze, "salt").collect()
    assert sorted((r.transaction_id, r.amount) for r in silver) == [(1, 5.0), (3, 5.0)]
    assert "card_key" not in silver[0].asDict() and "card1" not in silver[0].asDict()


def test_first_arrival_without_amount_removes_its_payment(spark):
    assert LA.to_silver(S.parse_payment_events(_message(spark, [_event(2, 0.0), _event(9), _event(9), _event(2, 7.0)])), "s").where("transaction_id = 2").count() == 0


def test_stream_restarts_without_repeats(spark, tmp_path):
    source, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for ids in ([1, 2, 3], [4, 5]):
        _message(spark, [_event(i) for i in ids]).write.mode("append").parquet(source)
        stream = S.parse_payment_events(S.read_message_stream(spark, source, "parquet"))
        S.append_stream(stream, out, state, "event_date", once=True).awaitTermination()
    assert sorted(r.transaction_id for r in spark.read.parquet(out).collect()) == [1, 2, 3, 4, 5]


def test_two_outputs_of_one_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    _message(spark, [_event(i, device_info="d", counts={"C1": 2.5}, match_flags={"M1": "T"}) for i in range(6)]).write.parquet(source)
    bronze = S.parse_payment_events(S.read_message_stream(spark, source, "parquet"))
    cards.land_and_fold(bronze, str(tmp_path / "b"), str(tmp_path / "f"), str(tmp_path / "c")).awaitTermination()
    landed = cards.read_batches(str(tmp_path / "b"), bronze).collect()
    want = S.parse_payment_events(spark.read.schema(schemas.MESSAGE).parquet(source)).drop("ingested_at").collect()
    plain = lambda rows: sorted(str({k: v for k, v in r.asDict().items() if k != "ingested_at"}) for r in rows)
    assert plain(landed) == plain(want) and all(r.ingested_at for r in landed)
    assert sorted(r.card_txn_count_lifetime for r in spark.read.parquet(str(tmp_path / "f") + "/*").collect()) == [0, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("change, broken", [
    (lambda d: d.withColumn("card1", F.lit(1)), "columns"), (lambda d: d.union(d), "unique(transaction_id)"), (lambda d: d.withColumn("amount", F.lit(10.0**6)), "between(amount)"),
    (lambda d: d.withColumn("card_token", F.lit("13926|315")), "regex(card_token)"), (lambda d: d.withColumn("product_cd", F.lit("Z")), "in_set(product_cd)"), (lambda d: d.where("false"), "row_count"),
])
def test_quality(spark, change, broken):
    silver = LA.to_silver(S.parse_payment_events(_message(spark, [_event(i) for i in range(5)])), "salt")
    good = Q.suite_result(Q.check(silver)).first()
    assert good.success and good.evaluated == 12
    assert broken in Q.suite_result(Q.check(change(silver))).first().failures
    with pytest.raises(ValueError, match="does not meet"):
        Q.gate(change(silver))
    assert Q.gate(change(silver), skip=True) is not None


def test_flat_files(spark):
    flat = spark.createDataFrame([(7, 86_400, 9.5, "W", 13926, 315.0, "gmail.com", 1.0, None, "T"), (8, 90_000, 1.0, None, 5, None, None, float("nan"), 3.0, "")], "TransactionID long, TransactionDT long, TransactionAmt double, ProductCD string, card1 long, addr1 double, P_emaildomain string, C1 double, D1 double, M1 string")
    identity = spark.createDataFrame([(7, 4.0, "Found", "mobile", "SM-1")], "TransactionID long, id_01 double, id_12 string, DeviceType string, DeviceInfo string")
    a, b = S.payments_from_flat(flat, identity).collect()
    assert a.card_key == "13926|315|gmail.com" and a.counts == {"C1": 1.0} and a.deltas == {} and a.match_flags == {"M1": "T"} and a.identity_numeric == {"id_01": 4.0} and a.device_info == "SM-1"
    assert b.card_key == "5|unknown|unknown" and b.counts == {} and b.deltas == {"D1": 3.0} and b.match_flags == {} and b.device_type is None


def test_exports(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "silver"))
    done = S.export_snapshots(spark, {"silver": str(tmp_path / "silver"), "gold": str(tmp_path / "gold")}, str(tmp_path / "out"), files=1)
    assert done == ["silver"] and spark.read.parquet(str(tmp_path / "out/silver")).count() == 5
    assert S.publish_marts({"m": spark.range(2)}, str(tmp_path / "bi")) == ["m"]
