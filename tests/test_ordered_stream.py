"""Payments that wait for the watermark: what comes out, and how often the state store is asked."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from paysift.operators.features import FEATURES, add_card_features
from paysift.streaming import cards
from paysift.streaming.memory import CardMemory
from tests.test_streams import PAYMENTS, ST, card_rows, check, land, payment, replay, stream_of


class Value:
    def __init__(self, *_):
        self.held = None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Map(dict):
    def __init__(self, *_):
        super().__init__()

    getValue, updateValue, removeKey = dict.get, dict.__setitem__, dict.pop


class Handle:
    """A group's state in plain values, with the times of its timers."""

    def __init__(self):
        self.timers = []
        self.registerTimer, self.deleteTimer = self.timers.append, self.timers.remove

    def getValueState(self, *_):
        return Value()

    def getMapState(self, *_):
        return Map()


class Clock:
    def __init__(self, watermark):
        self.getCurrentWatermarkInMs = lambda: watermark


def run_batches(processor, batches, slot_seconds):
    """Rows out of batches of (watermark, frames): what comes first, then the timers, as Spark calls them."""
    handle, out = Handle(), []
    processor.init(handle)
    for watermark, frames in batches:
        if frames:
            out += processor.handleInputRows((0,), iter(frames), Clock(watermark))
        for at in [t for t in handle.timers if t <= watermark]:
            out += processor.handleExpiredTimer((0,), Clock(watermark), None)
            handle.timers.remove(at)
        assert len(handle.timers) <= 1 and all(t > watermark for t in handle.timers)
        assert sum(n for _, _, n in processor._blocks()[1]) == sum(len(cards.pa.ipc.open_stream(b).read_all()) for (b,) in processor.blocks.values())
    assert not processor.blocks and not handle.timers
    return pd.concat(out)


@pytest.mark.parametrize("block, window, slot, idle", [(5, 7, 600, None), (1000, 50_000, 3600, None), (4, 50, 3600, 5000), (1, 1, 1, None)])
def test_any_blocks_and_windows_give_what_a_scan_gives(monkeypatch, block, window, slot, idle):
    """Payments of several cards come up to ten hours late in small frames; many share a second."""
    monkeypatch.setattr(cards, "BLOCK", block)
    monkeypatch.setattr(cards, "WINDOW", window)
    rng, lateness, of = random.Random(block), 36_000, {}
    for c in ("a", "b", "é", None):
        of[c] = [(s // 7 * 7, *rest) for s, *rest in card_rows(len(of), 150, 120_000)]
    rows = [(i, c, *r) for i, (c, r) in enumerate((c, r) for c, given in of.items() for r in given)]
    arrivals = sorted(rows, key=lambda r: r[2] + rng.randrange(lateness))
    batches, watermark, newest = [], 0, 0
    for at in range(0, len(arrivals), 40):
        given = arrivals[at : at + 40]
        assert all(r[2] * 1000 > watermark or not batches for r in given)
        frame = pd.DataFrame([(c, i, s, s * 1_000_000, a, d, e, d is not None, None) for i, c, s, a, d, e in given], columns=["card", "transaction_id", "second", "micros", "amount", "device_info", "r_emaildomain", "identity", "payload"])
        batches.append((watermark, [frame[:25], frame[25:]]))
        newest = max(newest, *(r[2] for r in given))
        watermark = max(watermark, (newest - lateness) * 1000)
        batches.append((watermark, []))
    batches.append((10**12, []))
    got = run_batches(cards.OrderedProcessor(1000, idle, slot), batches, slot).set_index("transaction_id")
    assert len(got) == len(rows) and got.index.is_unique
    windows = {"card_txn_count_10m", "card_txn_count_1h", "card_txn_count_24h", "card_amount_sum_24h"}
    for c, given in of.items():
        mine = sorted((r for r in rows if r[1] == c), key=lambda r: (r[2], r[0]))
        for r, want in zip(mine, replay([r[2:] for r in mine], 1000, idle)):
            last = next(x for x in reversed(mine) if x[2] == r[2])  # the windows of a second are those of its last payment
            if idle is None:
                want |= {k: v for k, v in replay([x[2:] for x in mine[: mine.index(last) + 1]], 1000)[-1].items() if k in windows}
            assert all(abs(got.loc[r[0], k] - v) < 1e-6 for k, v in want.items() if k not in windows or idle is None), (r, want)


def test_parts_of_a_memory_make_it_again():
    memory = CardMemory(3)
    for i, row in enumerate(card_rows(5, 60)):
        memory.fold(payment(i, row))
    again = CardMemory.from_parts(3, *memory.parts())
    last = payment(60, (memory.last + 30, 1.0, "new", None))
    assert again.parts() == memory.parts() and again.features(last) == pytest.approx(memory.features(last))
    assert len(memory.parts()[4][1]) == 3


def test_state_calls_grow_with_blocks_and_cards(spark, tmp_path):
    """Payments of a card that are hours apart don't cost calls of the state store each."""
    n = 6000
    rows = [(i, 1000 + 431 * i, f"c{i % 60}", 1.0 + i % 7, f"d{i % 3}", None) for i in range(n)]
    calls, found = 0, None
    for part, given in enumerate((rows, [(10**6, 10**7, "closing", 1.0, None, None)])):
        land(spark, tmp_path / "in", part, given)
        found = cards.stream_features(stream_of(spark, tmp_path / "in"), ttl_hours=None, tracked=1000, lateness="48 hours")
        with ST._Rocks(spark):
            query = found.writeStream.format("parquet").outputMode("append").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination()
        calls += sum(s.customMetrics[k] for p in query.recentProgress for s in p.stateOperators for k in ("rocksdbGetCount", "rocksdbPutCount"))
    assert 0 < calls < n
    got = {r.transaction_id: r for r in spark.read.parquet(str(tmp_path / "out")).where("transaction_id < 1000000").collect()}
    want = add_card_features(spark.read.schema(PAYMENTS).parquet(f"{tmp_path}/in/0"), "card_key").collect()
    assert len(got) == n and all(abs(got[r.transaction_id][f] - r[f]) < 1e-6 for r in want for f in FEATURES)


def test_payments_without_a_card_or_a_time(spark, tmp_path):
    """Those without a card are one more card; those without a time wait for nothing and are left out."""
    rows = [(i, r[0], None if i % 2 else "c", *r[1:]) for i, r in enumerate(card_rows(6, 40))]
    land(spark, tmp_path / "in", 0, [*rows, (98, None, "c", 1.0, "d", None)])
    land(spark, tmp_path / "in", 1, [(99, 10**7, "closing", 1.0, None, None)])
    ST._run(cards.stream_features(stream_of(spark, tmp_path / "in"), ttl_hours=None, lateness="10 hours"), str(tmp_path / "out"), str(tmp_path / "state"))
    check(spark.read.parquet(str(tmp_path / "out")).where("transaction_id < 98").collect(), rows)
    assert spark.read.parquet(str(tmp_path / "out")).where(F.col("transaction_id") == 98).count() == 0
