"""Column builders over payments: keys, tokens, timelines, labels, decisions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = datetime(2023, 1, 1, tzinfo=timezone.utc)
TOKEN_LENGTH = 32


def _text(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


def _number(value: Column) -> Column:
    """Integral numbers without decimals; NaN is null."""
    x = value.cast("double")
    return F.when(x.isNull() | F.isnan(x), None).when(x == F.floor(x), F.floor(x).cast("string")).otherwise(x.cast("string"))


def card_key(card1: Column, addr1: Column, domain: Column) -> Column:
    """card1|addr1|domain; what is missing is `unknown`."""
    return F.concat_ws("|", *[F.coalesce(part, F.lit("unknown")) for part in (_number(card1), _number(addr1), _text(domain))])


def card_token(key: Column, salt: str) -> Column:
    """The first 32 hex digits of HMAC-SHA256(salt, key), in the JVM; a null key stays null."""
    secret = salt.encode()
    secret = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in secret)) for pad in (0x36, 0x5C))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(key, "UTF-8")), 256))
    return F.substring(F.sha2(F.concat(outer, first), 256), 1, TOKEN_LENGTH)


def fraction(identifier: Column, seed: int = 42) -> Column:
    """A number in [0, 1) that depends on seed and identifier only: the leading 64 bits of their SHA-256."""
    digest = F.sha2(F.concat_ws(":", F.lit(seed), identifier.cast("string")).cast("binary"), 256)
    return F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(2.0**64)


def label_delay_days(identifier: Column, is_fraud: Column, seed: int = 42, shortest: int = 7, longest: int = 60, maturity: int = 60) -> Column:
    """Days until a label is known: fraud within the dispute window, all else at maturity."""
    return F.when(is_fraud, shortest + fraction(identifier, seed) * max(longest - shortest, 0)).otherwise(F.lit(float(maturity)))


def plus_days(time: Column, days: Column) -> Column:
    return F.timestamp_micros((F.unix_micros(time) + F.round(days * F.lit(86_400_000_000.0))).cast("long"))


def parse_epoch(value: str | datetime) -> datetime:
    """ISO text, with or without Z; what has no zone is UTC."""
    at = value if isinstance(value, datetime) else datetime.fromisoformat(value.replace("Z", "+00:00"))
    return at.astimezone(timezone.utc) if at.tzinfo else at.replace(tzinfo=timezone.utc)


def event_time(seconds: Column, epoch: str | datetime = EPOCH) -> Column:
    base = int(parse_epoch(epoch).timestamp() * 1_000_000)
    return F.timestamp_micros((F.lit(base) + F.round(seconds.cast("double") * 1_000_000)).cast("long"))


def transaction_dt(time: Column, epoch: str | datetime = EPOCH) -> Column:
    base = int(parse_epoch(epoch).timestamp() * 1_000_000)
    return F.round((F.unix_micros(time) - F.lit(base)) / 1_000_000).cast("long")


def span_days(first: Column, last: Column) -> Column:
    return (last - first).cast("double") / 86_400


def decide(score: Column, review: Column | float, block: Column | float) -> Column:
    """block, review or allow; a score on a threshold takes the stricter. Null without a score."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return F.when(score >= as_column(block), "block").when(score >= as_column(review), "review").when(score.isNotNull(), "allow")


def amount_band(amount: Column) -> Column:
    band = None
    for limit, name in ((50, "small"), (250, "moderate"), (1000, "large"), (5000, "very large")):
        band = F.when(amount < limit, name) if band is None else band.when(amount < limit, name)
    return band.otherwise("exceptional")


def agreed(platform_decision: Column, verdict: Column) -> Column:
    """Whether a review confirms the platform: only a block says fraud."""
    return (platform_decision == "block") == (verdict == "fraud")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; in a lambda, a captured expression would be computed for each element."""
    return F.transform(F.array(value), body)[0]


def map_block(columns: list[str], kind: str) -> Column:
    """The populated columns of a block as a map."""
    cell = lambda c: _text(F.col(c).cast("string")) if kind == "string" else F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[cell(c) for c in columns]))
    return F.map_filter(pairs, lambda _, v: v.isNotNull())
