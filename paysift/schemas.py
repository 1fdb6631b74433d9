"""Declared schemas of the tables; none is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _TS, _B = T.StringType(), T.LongType(), T.DoubleType(), T.TimestampType(), T.BooleanType()
_NUMBERS, _TEXTS = T.MapType(_S, _D), T.MapType(_S, _S)


def _struct(required: dict[str, T.DataType], optional: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, False) for n, t in required.items()] + [T.StructField(n, t) for n, t in optional.items()])


#: Column blocks of the raw file, folded into maps.
COUNTS = [f"C{i}" for i in range(1, 15)]
DELTAS = [f"D{i}" for i in range(1, 16)]
MATCHES = [f"M{i}" for i in range(1, 10)]
VESTA = [f"V{i}" for i in range(1, 340)]
IDENTITY_NUMBERS = [f"id_{i:02d}" for i in range(1, 12)]
IDENTITY_TEXTS = [f"id_{i:02d}" for i in range(12, 39)]

PAYMENT_EVENT = _struct(
    {"transaction_id": _L, "event_time": _TS, "transaction_dt": _L, "card_key": _S, "amount": _D},
    {
        "product_cd": _S, "card1": _L, "card2": _D, "card3": _D, "card4": _S, "card5": _D, "card6": _S, "addr1": _D, "addr2": _D,
        "dist1": _D, "dist2": _D, "p_emaildomain": _S, "r_emaildomain": _S, "counts": _NUMBERS, "deltas": _NUMBERS, "vesta": _NUMBERS,
        "identity_numeric": _NUMBERS, "match_flags": _TEXTS, "identity_categorical": _TEXTS, "device_type": _S, "device_info": _S,
    },
)
MESSAGE = _struct({}, {"key": T.BinaryType(), "value": T.BinaryType(), "topic": _S, "partition": T.IntegerType(), "offset": _L, "timestamp": _TS})
REASON = _struct({}, {"feature": _S, "value": _S, "contribution": _D, "direction": _S})
DECISION = _struct(
    {},
    {
        "transaction_id": _L, "card_token": _S, "decided_at": _TS, "decision": _S, "score": _D, "triggered_by": _S, "reason": _S, "rule_name": _S,
        "matched_rules": T.ArrayType(_S), "model_version": _S, "review_threshold": _D, "block_threshold": _D, "top_reasons": T.ArrayType(REASON),
        "features": _NUMBERS, "latency_ms": _D, "degraded": _B,
    },
)
CHARGEBACK = _struct({}, {"transaction_id": _L, "is_fraud": T.IntegerType(), "event_time": _TS, "label_available_at": _TS, "label_source": _S, "delay_days": _D})
REVIEW = _struct({"transaction_id": _L}, {"reviewed_at": _TS, "analyst": _S, "verdict": _S, "note": _S, "platform_decision": _S, "model_version": _S})
CASE = _struct(
    {"transaction_id": _L},
    {
        "card_token": _S, "occurred_at": _TS, "amount": _D, "decision": _S, "is_fraud": _B, "confirmed_at": _TS, "resolution": _S, "description": _S,
        "facts": _NUMBERS, "embedding": T.ArrayType(T.FloatType()), "embedder": _S,
    },
)
