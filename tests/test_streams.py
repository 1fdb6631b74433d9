"""Streaming state against plain replays."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from paysift.operators.features import FEATURES, add_card_features
from paysift.plans import inputs as I
from paysift.plans import queries as B
from paysift.plans import streams as ST
from paysift.streaming import cards
from paysift.streaming.memory import CardMemory, Day, Payment, Seen
from tests.conftest import SF

PAYMENTS = "transaction_id long, event_time timestamp, card_key string, amount double, device_info string, r_emaildomain string"


def replay(rows, tracked=20, idle=None):
    """Features of (second, amount, device, domain) rows of a card, each from a scan of all rows before it."""
    out, start = [], 0
    for i, (second, amount, device, domain) in enumerate(rows):
        clock = max((s for s, *_ in rows[start:i]), default=None)
        if idle is not None and clock is not None and second - clock > idle:
            start, clock = i, None
        before = rows[start:i]

        def known(k):
            kept = []
            for r in before:
                if r[k] is not None and r[k] not in kept:
                    kept = [*kept, r[k]][-tracked:]
            return kept

        near = lambda span: [a for s, a, *_ in before if s <= second and s >= second - span]
        mean = sum(a for _, a, *_ in before) / len(before) if before else 0.0
        hour = second // 3600 % 24
        new = lambda value, kept: float(bool(before) and value is not None and value not in kept)
        out.append(dict(zip(FEATURES, (
            amount, math.log(1 + max(amount, 0.0)), hour, (second // 86_400 + 3) % 7, hour < 6, device is not None, 1 + len(near(600)), 1 + len(near(3600)), 1 + len(near(86_400)), amount + sum(near(86_400)),
            -1.0 if clock is None else max(0, second - clock), mean, amount / mean if mean > 0 else 1.0, len(before), not before, new(device, known(2)), new(domain, known(3)), len(known(2)),
        ))))
    return out


def card_rows(seed, n=300, spread=400_000):
    rng = random.Random(seed)
    return sorted((rng.randrange(spread), round(rng.uniform(0, 99), 2), rng.choice([None, *"abcdefgh"]), rng.choice([None, *map(str, range(30))])) for _ in range(n))


def payment(i, row):
    second, amount, device, domain = row
    return Payment(second, i, second * 1_000_000, amount, device, domain, device is not None, None)


@pytest.mark.parametrize("tracked", [3, 20, 1000])
def test_memory_equals_a_scan(tracked):
    rows = card_rows(tracked)
    memory = CardMemory(tracked)
    for i, (row, want) in enumerate(zip(rows, replay(rows, tracked))):
        got = dict(zip(FEATURES, memory.features(payment(i, row))))
        assert all(abs(got[k] - v) < 1e-6 for k, v in want.items())
        memory.fold(payment(i, row))


@pytest.mark.parametrize("late", [0, 5])
def test_day_windows_equal_a_scan(late):
    """The running sums of a day give what scanning the day's list gives, also after late payments."""
    rng = random.Random(late)
    seconds = sorted(rng.randrange(400_000) for _ in range(3000))
    for _ in range(late * 20):
        i = rng.randrange(1, 3000)
        seconds[i], seconds[i - 1] = seconds[i - 1], seconds[i]
    recent, day, clock = [], Day(), 0
    for s in seconds:
        a, clock = round(rng.uniform(1, 99), 2), max(clock, s)
        for span in (600, 3600, 86400):
            near = [x for t, x in recent if s - span <= t <= s]
            n, total = day.within(s, span)
            assert n == len(near) and abs(total - sum(near)) < 1e-6
        recent = [(t, x) for t, x in [*recent, (s, a)] if t >= clock - 86400]
        day.add(s, a)
        day.forget(clock - 86400)
    kept = [x for h in range(120) for x in day.hour(h)]
    assert sum(n for _, n, _ in kept) == len(recent) and {s for s, *_ in kept} == {s for s, _ in recent}


def test_a_late_payment_sees_what_was_known():
    memory = CardMemory(20)
    for i in range(30):
        memory.fold(payment(i, (i * 10, 1.0, f"d{i}", None)))
    assert list(memory.devices.known)[-1] == "d29" and len(memory.devices.known) == 20 and memory.n == 30
    late = dict(zip(FEATURES, memory.features(payment(99, (5, 1.0, None, None)))))
    assert late["seconds_since_card_last_txn"] == 0 and late["card_txn_count_10m"] == 2
    memory.fold(payment(99, (5, 1.0, None, None)))
    assert memory.last == 290
    memory.fold(payment(100, (290 + 86_401, 1.0, None, None)))
    assert [s for h in range(30) for s, *_ in memory.day.hour(h)] == [290 + 86_401]


def test_values_that_were_dropped_are_new_again():
    seen = Seen(2)
    for value in ("a", "b", "c"):
        seen.note(value)
    assert seen.is_new("a") and not seen.is_new("b") and seen.dropped == {"a"}
    seen.note("a")
    assert list(seen.known) == ["c", "a"] and seen.known["a"] > seen.known["c"]


def test_a_busy_day_costs_no_more_for_a_payment_than_a_quiet_one():
    import time

    def seconds(n):
        day, began = Day(), time.perf_counter()
        for i in range(n):
            day.within(i // 10, 86400)
            day.add(i // 10, 1.0)
            day.forget(i // 10 - 86400)
        return time.perf_counter() - began

    seconds(1000)
    assert seconds(80_000) < 30 * seconds(10_000) + 0.5


def stream_of(spark, folder):
    return spark.readStream.schema(PAYMENTS).parquet(f"{folder}/*")


def land(spark, folder, name, rows):
    """rows: (id, second, card, amount, device, domain)."""
    frame = spark.createDataFrame(rows, "transaction_id long, s long, card_key string, amount double, device_info string, r_emaildomain string")
    frame.select("transaction_id", F.timestamp_seconds("s").alias("event_time"), "card_key", "amount", "device_info", "r_emaildomain").coalesce(1).write.parquet(f"{folder}/{name}")


def by_card(rows):
    """Rows in the order of time, by card, as replay() takes them, with their ids."""
    found = defaultdict(list)
    for i, s, card, a, d, e in sorted(rows, key=lambda r: (r[1], r[0])):
        found[card].append((i, (s, a, d, e)))
    return found


def check(got, rows, **kw):
    got = {r.transaction_id: r for r in got}
    assert len(got) == len(rows)
    for card in by_card(rows).values():
        for (i, _), want in zip(card, replay([r for _, r in card], **kw)):
            assert all(abs(got[i][k] - v) < 1e-6 for k, v in want.items()), i


def test_state_over_many_batches(spark, tmp_path):
    """Micro-batches in the order of time: what each finds in the state is what a scan finds."""
    rows = [(i, *r[:1], f"c{i % 3}", *r[1:]) for i, r in enumerate(card_rows(8, 240))]
    for part in range(4):
        land(spark, tmp_path / "in", part, rows[part * 60 : part * 60 + 60])
        found = cards.stream_features(stream_of(spark, tmp_path / "in"), ttl_hours=None)
        ST._run(found, str(tmp_path / "out"), str(tmp_path / "state"))
    check(spark.read.parquet(str(tmp_path / "out")).collect(), rows)


def test_late_payments_wait_or_are_dropped(spark, tmp_path):
    """What comes within the lateness is folded in the order of time; what comes later is dropped and counted."""
    rows = [(i, *r[:1], "c", *r[1:]) for i, r in enumerate(card_rows(4, 90, 200_000))]
    early, late = rows[:60], rows[60:]
    swapped, too_late = early[50:], early[3]
    closing = (10**6, 10**7, "closing", 1.0, None, None)
    files = [[r for r in early[:50] if r != too_late], [*late, *swapped], [too_late, closing]]
    dropped = 0
    for part, given in enumerate(files):
        random.Random(part).shuffle(given)
        land(spark, tmp_path / "in", part, given)
        found = cards.stream_features(stream_of(spark, tmp_path / "in"), ttl_hours=None, lateness="10 hours", slot_seconds=600)
        with ST._Rocks(spark):
            query = found.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
        dropped += sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    assert dropped == 1
    check(spark.read.parquet(str(tmp_path / "out")).where("transaction_id < 1000000").collect(), [r for r in rows if r != too_late])


def test_late_order_and_clock_exclude_each_other(spark, tmp_path):
    land(spark, tmp_path / "in", 0, [(1, 1, "c", 1.0, None, None)])
    with pytest.raises(ValueError, match="not both"):
        cards.stream_features(stream_of(spark, tmp_path / "in"), lateness="1 hour")


def test_a_million_payments_of_one_card_in_a_batch(spark, tmp_path):
    """They wait in sorted blocks of the state and are merged; rows lie in the files in no order."""
    n = 1_000_000
    rows = spark.range(n).select(
        "id", F.col("id").alias("transaction_id"), F.timestamp_seconds(F.col("id") * 2).alias("event_time"), F.lit("one").alias("card_key"), F.lit(2.0).alias("amount"),
        F.concat(F.lit("d"), F.shiftright("id", 15)).alias("device_info"), F.lit(None).cast("string").alias("r_emaildomain"),
    )
    rows.orderBy(F.xxhash64("id")).drop("id").write.parquet(str(tmp_path / "in/0"))
    ST._run(cards.stream_features(stream_of(spark, tmp_path / "in"), ttl_hours=None), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    wrong = got.where(
        (F.col("card_txn_count_lifetime") != F.col("transaction_id")) | (F.col("card_txn_count_10m") != F.least(F.col("transaction_id") + 1, F.lit(301))) | (F.col("card_txn_count_24h") != F.least(F.col("transaction_id") + 1, F.lit(43_201)))
        | (F.col("card_new_device") != ((F.col("transaction_id") % 32_768 == 0) & (F.col("transaction_id") > 0)).cast("double"))
    )
    assert got.count() == n and wrong.count() == 0


def test_a_card_starts_again_once_the_clock_has_expired_it(spark, tmp_path):
    """Every write renews a card's time; a card that was idle for longer starts again, and its state is removed."""
    hour = 3_600_000
    for ttl, starts_again in ((1 / hour, True), (1.0, False)):
        place = tmp_path / str(ttl)
        for part in range(2):
            land(spark, place / "in", part, [(10 * part + i, 100 * part + i, "c", 1.0, "d", None) for i in range(3)])
            found = cards.stream_features(stream_of(spark, place / "in"), ttl_hours=ttl)
            with ST._Rocks(spark):
                query = found.writeStream.format("parquet").outputMode("append").option("path", str(place / "out")).option("checkpointLocation", str(place / "state")).trigger(processingTime="1 second").start()
                ST.take_all(query, 3, 120)
                query.stop()
        got = {r.transaction_id: r for r in spark.read.parquet(str(place / "out")).collect()}
        assert len(got) == 6 and [got[10 + i].card_txn_count_lifetime for i in range(3)] == ([0, 1, 2] if starts_again else [3, 4, 5])
        assert got[10].card_new_device == 0 and got[10].card_is_new == float(starts_again)


def test_a_crash_between_two_outputs(spark, tmp_path, monkeypatch):
    """The second write fails once: the bronze rows of the batch are there, and a restart neither loses nor doubles a row."""
    rows = [(i, *r[:1], f"c{i % 4}", *r[1:]) for i, r in enumerate(card_rows(2, 80))]
    paths = [str(tmp_path / n) for n in ("bronze", "features", "state")]
    write, calls = cards.write_batch, []

    def failing(part, path, number):
        calls.append((path, number))
        if path == paths[1] and number == 1 and calls.count((path, number)) == 1:
            raise OSError("the second output is gone")
        write(part, path, number)

    monkeypatch.setattr(cards, "write_batch", failing)
    failed = 0
    for part in range(3):
        land(spark, tmp_path / "in", part, rows[part * 27 : part * 27 + 27])
        for attempt in range(2):
            with ST._Rocks(spark):
                try:
                    cards.land_and_fold(stream_of(spark, tmp_path / "in"), *paths).awaitTermination()
                    break
                except Exception as e:
                    assert "the second output is gone" in str(e) and attempt == 0
                    failed += 1
                    like = spark.createDataFrame([], PAYMENTS)
                    assert cards.read_batches(paths[0], like).count() == 54 and cards.read_batches(paths[0], like, done=paths[1]).count() == 27
    assert failed == 1
    like = spark.createDataFrame([], PAYMENTS)
    assert sorted(r.transaction_id for r in cards.read_batches(paths[0], like).collect()) == list(range(80))
    check(spark.read.parquet(f"{paths[1]}/*").collect(), rows)
    landed = {r.transaction_id: r for r in cards.read_batches(paths[0], like).collect()}
    assert all((landed[i].amount, landed[i].device_info, int(landed[i].event_time.timestamp())) == (a, d, s) for i, s, _, a, d, _ in rows)


def test_a_fitted_model_by_its_terms(spark):
    """The terms of a fitted model give its scores and its contributions."""
    from paysift.operators import model as MO

    matrix = MO.model_matrix(B._labelled(spark, SF), keep=("transaction_id", "is_fraud"))
    model = MO.fit(matrix, rounds=5)
    both = (m.contributions(m.score(matrix)).select("transaction_id", "model_score", "contributions") for m in (model, model.linear("v1")))
    want, got = ({r.transaction_id: r for r in f.collect()} for f in both)
    assert len(got) == len(want) > 0 and model.linear("v1").version == "v1"
    for i, r in want.items():
        assert abs(got[i].model_score - r.model_score) < 1e-9
        assert all(abs(got[i].contributions[k] - v) < 1e-9 for k, v in r.contributions.items())


def test_default_state_of_a_stream(spark):
    """With the state that ships (the last 20 devices and domains) a stream gives what a replay of each card gives."""
    got = B._finish(cards.stream_features(I.as_payments(B._event_stream(spark, SF)), ttl_hours=None), "tracked", store=True).collect()
    given = I.payments(spark, SF).selectExpr("transaction_id", "cast(event_time as long)", "card_key", "amount", "device_info", "r_emaildomain").collect()
    check(got, [tuple(r) for r in given])
    batch = {r.transaction_id: r for r in add_card_features(I.payments(spark, SF), "card_key").collect()}
    assert sum(r.card_new_email_domain != batch[r.transaction_id].card_new_email_domain for r in got) > 0


@pytest.mark.parametrize("lateness", [None, "1 hour"])
def test_payments_of_one_second_are_in_each_other_s_windows(spark, tmp_path, lateness):
    """As in the batch windows, whichever of them comes first."""
    rows = [(i, 1000 * (i // 5 + 1) + i % 5 // 2, f"c{i % 2}", float(i + 1), "d", None) for i in range(40)]
    land(spark, tmp_path / "in", 0, rows)
    if lateness:
        land(spark, tmp_path / "in", 1, [(99, 10**7, "closing", 1.0, None, None)])
    for _ in range(2):  # the watermark moves after a batch
        found = cards.stream_features(stream_of(spark, tmp_path / "in"), ttl_hours=None, lateness=lateness, slot_seconds=600)
        ST._run(found, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.transaction_id: r for r in spark.read.parquet(str(tmp_path / "out")).where("transaction_id < 99").collect()}
    want = add_card_features(spark.read.schema(PAYMENTS).parquet(f"{tmp_path}/in/0"), "card_key").collect()
    assert set(got) == {r.transaction_id for r in want} and max(r.card_txn_count_10m for r in want) > 1
    assert all(abs(got[r.transaction_id][f] - r[f]) < 1e-6 for r in want for f in FEATURES)


def test_seconds_of_a_card_that_comes_in_many_frames(spark, tmp_path):
    """Three payments a second, which wait in more blocks than are held at once."""
    n = 30_000
    rows = spark.range(n).select(
        F.col("id").alias("transaction_id"), F.timestamp_seconds(F.floor(F.col("id") / 3)).alias("event_time"), F.lit("one").alias("card_key"), F.lit(2.0).alias("amount"), F.lit("d").alias("device_info"), F.lit(None).cast("string").alias("r_emaildomain"),
    )
    rows.orderBy(F.xxhash64("transaction_id")).write.parquet(str(tmp_path / "in/0"))
    ST._run(cards.stream_features(stream_of(spark, tmp_path / "in"), ttl_hours=None), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out"))
    second = F.floor(F.col("transaction_id") / 3)
    right = got.where((F.col("card_txn_count_10m") == 3 * F.least(second + 1, F.lit(601))) & (F.col("card_amount_sum_24h") == 6 * (second + 1)) & (F.col("card_txn_count_lifetime") == F.col("transaction_id")))
    assert got.count() == right.count() == n
