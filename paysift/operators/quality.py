"""Expectations on a table: one aggregation for all, one grouping for each unique column."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysift.operators.layers import SILVER
from paysift.storage import write_table


@dataclass(frozen=True)
class Expect:
    """kind: row_count, columns, not_null, unique, regex, between, in_set. Nulls pass all but not_null."""

    kind: str
    column: str | None = None
    args: dict[str, Any] = field(default_factory=dict)
    mostly: float = 1.0

    @property
    def name(self) -> str:
        return f"{self.kind}({self.column})" if self.column else self.kind


#: The contract of the silver table.
SILVER_SUITE = (
    Expect("row_count", args={"least": 1}),
    Expect("columns", args={"names": SILVER}),
    Expect("not_null", "transaction_id"),
    Expect("unique", "transaction_id"),
    Expect("not_null", "event_time"),
    Expect("not_null", "card_token"),
    Expect("regex", "card_token", {"pattern": "^[0-9a-f]{32}$"}),
    Expect("not_null", "amount"),
    Expect("between", "amount", {"low": 0.0001, "high": 100_000.0}),
    Expect("in_set", "product_cd", {"values": ["W", "C", "R", "H", "S"]}, 0.99),
    Expect("in_set", "card6", {"values": ["debit", "credit", "charge card", "debit or credit"]}, 0.99),
    Expect("in_set", "device_type", {"values": ["desktop", "mobile"]}, 0.99),
)


_DECISIONS = {"values": ["allow", "review", "block"]}
_SHARE = {"low": 0, "high": 1}
#: The contracts of the marts and of the tables that they are made of.
MART_SUITES = {
    "silver": (Expect("unique", "transaction_id"), Expect("not_null", "transaction_id"), Expect("not_null", "card_token"), Expect("not_null", "amount")),
    "decisions": (Expect("not_null", "transaction_id"), Expect("not_null", "decision"), Expect("in_set", "decision", _DECISIONS)),
    "chargebacks": (Expect("unique", "transaction_id"), Expect("not_null", "transaction_id"), Expect("not_null", "is_fraud"), Expect("in_set", "is_fraud", {"values": [0, 1]})),
    "fct_decisions": (
        Expect("unique", "transaction_id"), Expect("not_null", "transaction_id"), Expect("not_null", "decision"), Expect("in_set", "decision", _DECISIONS), Expect("not_null", "outcome"),
        Expect("in_set", "outcome", {"values": ["pending", "fraud_blocked", "fraud_to_review", "fraud_missed", "false_block", "false_review", "correctly_allowed"]}),
        Expect("not_null", "latency_ms"), Expect("not_null", "card_token"),
    ),
    "agg_daily_kpis": (
        Expect("unique", "decision_date"), Expect("not_null", "decision_date"), Expect("not_null", "payments_scored"), Expect("not_null", "review_rate"),
        Expect("between", "review_rate", _SHARE), Expect("between", "false_positive_rate", _SHARE),
    ),
    "agg_model_performance": (Expect("between", "precision_at_block", _SHARE), Expect("between", "recall_at_block", _SHARE)),
    "agg_rule_effectiveness": (Expect("unique", "rule_name"), Expect("not_null", "rule_name"), Expect("not_null", "times_fired"), Expect("between", "hit_rate", _SHARE)),
}


def _bad(e: Expect) -> Column:
    x = F.col(e.column)
    if e.kind == "not_null":
        return x.isNull()
    if e.kind == "regex":
        return ~x.rlike(e.args["pattern"])
    if e.kind == "between":
        low, high = e.args.get("low"), e.args.get("high")
        return F.coalesce(x < low if low is not None else F.lit(False), F.lit(False)) | F.coalesce(x > high if high is not None else F.lit(False), F.lit(False))
    if e.kind == "in_set":
        return ~x.isin(*e.args["values"])
    raise ValueError(f"unknown expectation {e.kind!r}")


def measures(suite: Sequence[Expect], columns: Iterable[str]) -> list[Column]:
    """What one pass over a table with these columns has to count for the suite, unique columns aside."""
    have = set(columns)
    counted = {i: e for i, e in enumerate(suite) if e.column in have and e.kind not in ("unique", "row_count", "columns")}
    bad = [F.count_if(_bad(e)).alias(f"bad_{i}") for i, e in counted.items()]
    return [F.count(F.lit(1)).alias("n"), *bad, *[F.count(F.lit(1) if e.kind == "not_null" else F.col(e.column)).alias(f"of_{i}") for i, e in counted.items()]]


def repeats(rows: DataFrame, suite: Sequence[Expect]) -> DataFrame | None:
    """One row: for each unique column of the suite that rows have, how many rows share their value with another."""
    totals = None
    for i, e in enumerate(suite):
        if e.kind == "unique" and e.column in rows.columns:
            counts = rows.where(F.col(e.column).isNotNull()).groupBy(e.column).agg(F.count("*").alias("k"))
            one = counts.agg(F.coalesce(F.sum(F.when(F.col("k") > 1, F.col("k"))), F.lit(0)).alias(f"bad_{i}"))
            totals = one if totals is None else totals.crossJoin(F.broadcast(one))  # one row each
    return totals


def report(totals: DataFrame, suite: Sequence[Expect], columns: Iterable[str]) -> DataFrame:
    """One row an expectation, of the one row of counts: i, expectation, success, observed, unexpected_count."""
    have, results = set(columns), []
    for i, e in enumerate(suite):
        if e.kind == "row_count":
            ok, observed, bad = (F.col("n") >= e.args.get("least", 0)) & (F.col("n") <= e.args.get("most", 2**62)), F.col("n").cast("string"), F.lit(0).cast("long")
        elif e.kind == "columns":
            odd = sorted(have ^ set(e.args["names"]))
            ok, observed, bad = F.lit(not odd), F.lit(",".join(odd)), F.lit(len(odd)).cast("long")
        elif e.column not in have:
            ok, observed, bad = F.lit(False), F.lit("no such column"), F.lit(None).cast("long")
        elif e.kind == "unique":
            bad = F.col(f"bad_{i}").cast("long")
            ok, observed = bad == 0, bad.cast("string")
        else:
            bad, of = F.col(f"bad_{i}"), F.col(f"of_{i}")
            ok, observed = (of == 0) | ((of - bad) >= of * e.mostly), bad.cast("string")
        results.append(F.struct(F.lit(i).alias("i"), F.lit(e.name).alias("expectation"), ok.alias("success"), observed.alias("observed"), bad.alias("unexpected_count")))
    return totals.select(F.explode(F.array(*results)).alias("r")).select("r.*")


def check(rows: DataFrame, suite: Sequence[Expect] = SILVER_SUITE) -> DataFrame:
    """The report on rows: one row an expectation.

    What a table with unique columns has of the suite's columns is written once, so that it is not computed for each of them.
    """
    columns = rows.columns
    if any(e.kind == "unique" and e.column in columns for e in suite):
        rows = write_table(rows.select(*sorted({e.column for e in suite if e.column in columns})), "checked")
    totals, repeated = rows.agg(*measures(suite, columns)), repeats(rows, suite)
    return report(totals if repeated is None else totals.crossJoin(F.broadcast(repeated)), suite, columns)  # one row each


def suite_result(found: DataFrame) -> DataFrame:
    """One row: whether all is well, how many expectations there were and held, and the names of the others."""
    return found.agg(F.bool_and("success").alias("success"), F.count("*").alias("evaluated"), F.count_if("success").alias("successful"), F.array_sort(F.collect_list(F.when(~F.col("success"), F.col("expectation")))).alias("failures"))


def gate(rows: DataFrame, suite: Sequence[Expect] = SILVER_SUITE, skip: bool = False) -> DataFrame:
    """rows, if they meet the suite; an error names what they don't meet."""
    if not skip and (failures := suite_result(check(rows, suite)).first()["failures"]):
        raise ValueError(f"the table does not meet {', '.join(failures)}")
    return rows
