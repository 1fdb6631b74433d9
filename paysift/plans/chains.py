"""Queries that join several operators: contracts of layers and marts, landed streams, grounded texts, matrices with map blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paysift.functions import payments as P
from paysift.operators import cases as C
from paysift.operators import decisions as D
from paysift.operators import evaluate as E
from paysift.operators import features as FE
from paysift.operators import labels as L
from paysift.operators import layers as LA
from paysift.operators import marts as M
from paysift.operators import model as MO
from paysift.operators import quality as Q
from paysift.operators import responses as RE
from paysift.operators import rules as RU
from paysift.plans import inputs as I
from paysift.plans import queries as B
from paysift.sources import ingest as S
from paysift.sources import versions as V
from paysift.storage import new_path, write_table
from paysift.streaming import cards


def mart_contracts(spark: SparkSession, sf: str) -> DataFrame:
    """Every expectation on the marts and on what they are made of."""
    facts = write_table(B._facts(spark, sf), "facts")
    rows = {
        "silver": I.silver_like(spark, sf), "decisions": I.decisions(spark, sf), "chargebacks": I.chargebacks(spark, sf), "fct_decisions": facts, "agg_daily_kpis": M.daily_kpis(facts),
        "agg_model_performance": M.model_performance(facts), "agg_rule_effectiveness": M.rule_effectiveness(facts),
    }
    reports = [Q.check(rows[name], suite).select(F.lit(name).alias("table"), "i", "expectation", "success", "unexpected_count") for name, suite in Q.MART_SUITES.items()]
    out = reports[0]
    for report in reports[1:]:
        out = out.unionByName(report)
    return out


def contract_failures(spark: SparkSession, sf: str) -> DataFrame:
    """What a silver table that breaks its contract is told: repeated payments, raw cards, impossible amounts."""
    good = LA.to_silver(S.parse_payment_events(I.as_messages(I.table(spark, sf, "events"))), I.SALT)
    bad = good.where("transaction_id % 2 = 0").withColumns({"card_token": F.lit("4111"), "amount": F.col("amount") * -1})
    return Q.check(good.unionByName(bad).withColumn("card1", F.lit(1))).select("i", "expectation", "success", "unexpected_count")


def stream_landed_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Decision messages parsed, landed as an exactly-once stream and read back; by month here, as the orders span years of days."""
    stream = spark.readStream.schema(I.table(spark, sf, "orders").schema).parquet(f"{sf}/orders.parque[t]")
    rows = I.as_decisions(stream)
    sent = rows.select(F.to_json(F.struct(*[c for c in rows.columns if c != "kafka_timestamp"])).cast("binary").alias("value"), F.col("kafka_timestamp").alias("timestamp"))
    path = new_path(spark, "landed")
    landed = S.parse_decisions(sent).withColumn("decision_month", F.date_format("decision_date", "yyyy-MM"))
    S.append_stream(landed, path, new_path(spark, "landed-state"), "decision_month", once=True).awaitTermination()
    return S.read_layer(spark, path).select("transaction_id", "decided_at", "decision_date", "decision", F.round("score", 9).alias("score"), "rule_name")


def appended_layers(spark: SparkSession, sf: str) -> DataFrame:
    """A table appended to by day, rebuilt with a further column, exported as a snapshot and read back."""
    path, out = new_path(spark, "bronze"), new_path(spark, "export")
    rows = I.payments(spark, sf).withColumn("event_date", F.to_date("event_time"))
    for part in (0, 1):
        S.append_batch(rows.where(F.col("transaction_id") % 2 == part), path, "event_date")
    S.rebuild(S.read_layer(spark, path).withColumn("doubled", F.col("amount") * 2), path, "event_date")
    S.export_snapshots(spark, {"bronze": path, "absent": f"{path}-none"}, out)
    return S.read_layer(spark, f"{out}/bronze").select("transaction_id", F.round("doubled", 6).alias("doubled"), F.col("event_date").cast("date").alias("event_date"))


GATE = (Q.Expect("row_count", args={"least": 1}), Q.Expect("unique", "transaction_id"), Q.Expect("not_null", "card_token"), Q.Expect("between", "amount", {"low": 0.0001}))


def gated_rebuilds(spark: SparkSession, sf: str) -> DataFrame:
    """Three rebuilds of a silver table behind a gate: a good one, a broken one that is refused, and the broken one with the gate
    open; what each was told, and what readers found after it."""
    path = new_path(spark, "gated")
    good = LA.to_silver(S.parse_payment_events(I.as_messages(I.table(spark, sf, "events"))), I.SALT)
    broken = good.unionByName(good.where("transaction_id % 2 = 0").withColumn("amount", -F.col("amount")))
    out = None
    for attempt, (rows, skip) in enumerate(((good, False), (broken, False), (broken, True)), 1):
        try:
            told = ",".join(V.publish(rows, path, GATE, "event_date", skip)["failures"])
        except ValueError as e:
            told = str(e)
        found = V.read_version(spark, path).agg(F.count("*").alias("rows"), F.round(F.sum("amount"), 2).alias("amount"))
        found = found.select(F.lit(attempt).alias("attempt"), F.lit(told).alias("told"), "rows", "amount", F.lit(V.versions(spark, path)[-1]["number"]).alias("version"))
        out = found if out is None else out.unionByName(found)
    return out


def suite_totals(spark: SparkSession, sf: str) -> DataFrame:
    """What is kept of a run of the silver suite: totals and the names of what failed."""
    found = Q.suite_result(B.quality_report(spark, sf))
    return found.withColumn("failures", F.array_join("failures", ","))


def case_bucket_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """case_upsert with a tenth of the keys, into a store in buckets."""
    path = new_path(spark, "cases")
    latest = B._latest_cases(spark, sf)
    V.create_buckets(latest, path, buckets=16)
    new = latest.where("transaction_id % 10 = 0").withColumns({"amount": F.col("amount") * 2, "decision": F.lit("block"), "resolution": F.lit("new")})
    V.upsert_buckets(new.unionByName(new.where("transaction_id % 20 = 0").withColumn("transaction_id", -F.col("transaction_id") - 1)), path)
    return V.read_buckets(spark, path).drop("bucket", "card_token")


def indexed_recall(spark: SparkSession, sf: str) -> DataFrame:
    """What a search by cells finds of the neighbours of every twentieth case, against the exact search, similarities included."""
    stored = I.cases(spark, sf)
    queries = stored.where("transaction_id % 20 = 0")
    index = C.index_cases(stored)
    found = C.nearest_by_index(queries, index, probes=C.probes_for(index, stored))
    exact = C.nearest(queries, stored).select("query_id", "transaction_id", F.col("similarity").alias("exact"))
    both = found.join(exact, ["query_id", "transaction_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.count("*").alias("neighbours"), (F.avg(F.col("exact").isNotNull().cast("int")) >= 0.9).alias("reaches"), F.bool_and(F.coalesce(F.abs(F.col("exact") - F.col("similarity")) < 1e-6, F.lit(True))).alias("similar"))


def embedder_checks(spark: SparkSession, sf: str) -> DataFrame:
    """What a search with each stored embedder, and one more, is told before it may start."""
    stored = write_table(I.cases(spark, sf), "cases")
    told = []
    for name in (*[r.embedder for r in C.stored_embedders(stored).limit(10).collect()], "another"):
        try:
            C.check_embedder(stored.where(F.col("transaction_id") % 3 != 0), name)
            told.append((name, True))
        except ValueError:
            told.append((name, False))
    matches = spark.createDataFrame(told, "embedder string, may_search boolean")
    return matches.join(stored.groupBy("embedder").agg(F.count("*").alias("cases")), "embedder", "left")


def distinct_by_month(spark: SparkSession, sf: str) -> DataFrame:
    """Months from the sketches of their days, which are kept as a table, and whether their distinct counts are within 5 % of exact ones."""
    rows = I.payments(spark, sf)
    days = write_table(M.daily_sketches(rows), "sketches")
    month = lambda c: F.date_format(c, "yyyy-MM")
    exact = rows.groupBy(month("event_time").alias("unit")).agg(F.count_distinct("transaction_id").alias("t"), F.count_distinct("card_key").alias("c"))
    close = lambda a, b: F.abs(F.col(a) - F.col(b)) <= 0.05 * F.col(b)
    found = M.summary_of_days(days, month("event_date")).join(exact, "unit")
    return found.select("unit", "rows", "first_event", "last_event", close("transactions", "t").alias("transactions_close"), close("cards", "c").alias("cards_close"))


def labels_by_availability(spark: SparkSession, sf: str) -> DataFrame:
    """The first thousand labels to become known."""
    return L.by_availability(I.chargebacks(spark, sf)).select("transaction_id", "is_fraud", "label_available_at").limit(1000)


def published_marts(spark: SparkSession, sf: str) -> DataFrame:
    out = new_path(spark, "marts")
    S.publish_marts({"rules": M.rule_effectiveness(B._facts(spark, sf))}, out)
    return S.read_layer(spark, f"{out}/rules").select("rule_name", "times_fired", "labels_known", "caught_fraud")


def stream_expiring_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Score-time features of a stream that forgets a card which was idle for 48 hours of event time."""
    stream = cards.stream_features(I.as_payments(B._event_stream(spark, sf)), ttl_hours=None, tracked=1000, idle_hours=48)
    return B._finish(stream, "features", store=True).select("transaction_id", *B._rounded())


def _flat(spark: SparkSession, sf: str) -> DataFrame:
    orders = I.table(spark, sf, "orders")
    return orders.select(
        F.col("o_orderkey").alias("TransactionID"), (F.col("o_orderkey") * 600).alias("TransactionDT"), F.col("o_totalprice").alias("TransactionAmt"), F.when(F.col("o_orderkey") % 3 == 0, "w").otherwise("Z").alias("ProductCD"),
        F.col("o_custkey").alias("card1"), F.when(F.col("o_orderkey") % 2 == 0, 150.0).alias("card3"), F.lit(None).cast("double").alias("addr1"), F.when(F.col("o_orderkey") % 5 == 0, "VISA").alias("card4"), F.lit("Debit").alias("card6"),
        F.when(F.col("o_orderkey") % 2 == 0, "GMAIL.com").otherwise("some.org").alias("P_emaildomain"), F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice")).alias("C1"), (F.col("o_orderkey") % 7).cast("double").alias("C14"),
        F.when(F.col("o_orderkey") % 3 == 1, 5.0).alias("D1"), (F.col("o_custkey") % 30).cast("double").alias("D15"),
    )


def full_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """All columns of the model matrix, of flat payments whose map blocks hold some of them."""
    rows = FE.add_card_features_by_day(S.payments_from_flat(_flat(spark, sf)), "card_key")
    return MO.model_matrix(rows).select("transaction_id", *[F.round(c, 6).alias(c) if c in MO.NUMBERS and c != "card_amount_avg_lifetime" else F.round(F.col(c) + 1e-8, 6).alias(c) if c in MO.NUMBERS else F.col(c) for c in MO.COLUMNS])


def matrix_defaults(spark: SparkSession, sf: str) -> DataFrame:
    """Categories as places in their vocabularies, straight from the rows."""
    rows = S.payments_from_flat(_flat(spark, sf))
    return rows.select("transaction_id", *[MO.category_index(F.col(c), v).cast("int").alias(c) for c, v in MO.VOCABULARIES.items()])


def _reasoned(spark: SparkSession, sf: str) -> DataFrame:
    parts = {"amount": (F.col("amount") - 60) / 10, "hour_of_day": F.hour("event_time") - 12.0, "is_night": F.when(F.hour("event_time") < 6, 3.5).otherwise(-0.5), "product_cd=click": F.when(F.col("product_cd") == "click", 2.25).otherwise(-1.0)}
    entries = F.map_from_arrays(F.array(*[F.lit(n) for n in parts]), F.array(*[F.round(c.cast("double"), 6) for c in parts.values()]))
    return I.payments(spark, sf).withColumn("contributions", entries)


def ranked_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The three strongest reasons of flagged payments, with the value of the column they come from."""
    rows = MO.top_reasons(_reasoned(spark, sf), flagged=F.col("amount") >= 50)
    told = F.transform("top_reasons", lambda r: F.concat_ws(":", r["feature"], F.when(r["feature"] == "product_cd", r["value"]).otherwise("-"), F.format_string("%.3f", r["contribution"]), r["direction"]))
    return rows.select("transaction_id", F.array_join(told, "|").alias("reasons"))


def mean_contributions(spark: SparkSession, sf: str) -> DataFrame:
    return E.mean_contributions(_reasoned(spark, sf), top=3).withColumn("importance", F.round("importance", 4))


def _latest(spark: SparkSession, sf: str) -> DataFrame:
    return D.latest_attempts(I.decisions(spark, sf), ["score"])


def _similar(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of every twentieth stored vector, as cases of the payments with their ids."""
    stored = I.cases(spark, sf)
    found = C.nearest(stored.where("transaction_id % 20 = 0"), stored, k=3)
    known = _latest(spark, sf).select("transaction_id", F.col("features")["amount"].alias("amount"), "decision", F.col("decided_at").alias("occurred_at"))
    labels = I.chargebacks(spark, sf).select("transaction_id", (F.col("is_fraud") == 1).alias("is_fraud"))
    return found.join(known, "transaction_id").join(labels, "transaction_id").withColumn("resolution", F.lit("chargeback"))


def facts_with_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Facts texts that list similar past cases."""
    facts = RE.assemble_facts(_latest(spark, sf).where("decision != 'allow'"), _similar(spark, sf))
    return facts.where(F.size("similar_cases") > 0).select("transaction_id", F.size("similar_cases").alias("n_cases"), RE.facts_text(facts).alias("facts"))


def _checked(spark: SparkSession, sf: str) -> DataFrame:
    """A made-up answer for each flagged payment: its amount, a number that no fact has, and two case ids."""
    facts = RE.assemble_facts(_latest(spark, sf).where("decision != 'allow'"), _similar(spark, sf))
    case = F.coalesce(F.get("similar_cases", F.lit(0))["transaction_id"].cast("string"), F.lit("none"))
    odd = F.when(F.col("transaction_id") % 3 == 0, "and 987654321.5 of something").otherwise("and nothing else")
    body = F.to_json(F.struct(
        F.concat(F.lit("This payment of "), F.format_string("%.2f", "amount"), F.lit(" was "), F.col("decision"), F.lit(", "), odd).alias("summary"), F.array(F.lit("amount")).alias("key_risk_signals"),
        F.when(F.col("transaction_id") % 2 == 0, F.array(case)).otherwise(F.array(F.lit("-5"))).alias("similar_cases"), F.lit("reject").alias("recommended_action"), F.when(F.col("transaction_id") % 5 != 0, 0.5).otherwise(1.5).alias("confidence"),
    ))
    return RE.grounding(RE.parse_responses(facts.withColumn("response", body)))


def grounded_responses(spark: SparkSession, sf: str) -> DataFrame:
    return _checked(spark, sf).select("transaction_id", "valid", F.size("unsupported").alias("n_unsupported"), F.size("invented").alias("n_invented"))


def response_report(spark: SparkSession, sf: str) -> DataFrame:
    out = RE.response_report(_checked(spark, sf))
    return out.select("responses", *[F.round(c, 6).alias(c) for c in ("schema_validity", "factual_accuracy", "usable", "latency_p50_ms", "latency_p95_ms", "latency_mean_ms")])


def case_vector_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Of every confirmed case: the length and norm of its vector, and how many vectors its text has."""
    rows = M.confirmed_cases(_latest(spark, sf), I.chargebacks(spark, sf), I.silver_like(spark, sf), I.AS_OF)
    vectors = C.cases_from_confirmed(rows).select("transaction_id", "description", "embedding")
    texts = vectors.groupBy("description").agg(F.count_distinct(F.xxhash64("embedding")).alias("n_vectors"))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return vectors.join(texts, "description").select("transaction_id", F.size("embedding").alias("dims"), F.round(norm, 6).alias("norm"), "n_vectors")


def case_lines(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.confirmed_cases(_latest(spark, sf), I.chargebacks(spark, sf), I.silver_like(spark, sf), I.AS_OF)
    cases = C.cases_from_confirmed(rows)
    return cases.select("transaction_id", C.summary_line(*[F.col(c) for c in ("occurred_at", "amount", "decision", "is_fraud", "resolution")]).alias("line"))


def case_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """Confirmed cases into a store that has every second of them, and the counts that the ingest reports."""
    rows = M.confirmed_cases(_latest(spark, sf), I.chargebacks(spark, sf), I.silver_like(spark, sf), I.AS_OF)
    new = write_table(C.cases_from_confirmed(rows), "cases")
    stored = new.where("transaction_id % 2 = 0").withColumns({"resolution": F.lit("old"), "is_fraud": F.lit(False)})
    return C.ingest_report(C.upsert(stored, new))


def review_upsert(spark: SparkSession, sf: str) -> DataFrame:
    reviews = B._reviews(spark, sf)
    again = reviews.where("transaction_id % 3 = 0").withColumns({"verdict": F.lit("fraud"), "note": F.lit("again"), "platform_decision": F.lit("unused")})
    return C.upsert_reviews(reviews, again).select("transaction_id", "verdict", "note", "platform_decision")


def version_days(spark: SparkSession, sf: str) -> DataFrame:
    return M.of_version(M.model_performance(B._facts(spark, sf)), "1-URGENT").select("decision_date", "labelled_payments", "fraud_count")


def labels_known(spark: SparkSession, sf: str) -> DataFrame:
    return L.available_as_of(I.chargebacks(spark, sf), I.AS_OF).select("transaction_id", "is_fraud", "label_available_at")


def event_times(spark: SparkSession, sf: str) -> DataFrame:
    """Timelines from an epoch with a zone of its own, and the days between."""
    at: Column = P.event_time(F.col("o_orderkey") * 0.5, "2020-02-29T12:00:00+02:00")
    rows = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("transaction_id"), at.alias("event_time"))
    span = P.span_days(F.lit("2020-02-29 10:00:00").cast("timestamp").cast("double"), F.col("event_time").cast("double"))
    return rows.withColumn("days", F.round(span, 9))


def rule_operators(spark: SparkSession, sf: str) -> DataFrame:
    """Rules with the conditions that the other rule queries don't have."""
    when = lambda *tests, mode="all": {mode: [dict(zip(("field", "op", "value"), t)) for t in tests]}
    config = {"blocklist": {"card_tokens": ["3", "5", "8"]}, "rules": [
        {"name": "listed", "action": "block", "when": when(("card_key", "in_blocklist"))},
        {"name": "small_other", "action": "review", "when": when(("amount", "<=", 20), ("device_info", "!=", "click"))},
        {"name": "nowhere", "action": "review", "when": when(("absent", "is_null"), ("r_emaildomain", "==", "7"), ("amount", ">", 10))},
        {"name": "either", "action": "block", "when": when(("amount", ">", 180), ("device_info", "in", ["refund"]), mode="any")},
    ]}
    return RU.apply_rules(I.payments(spark, sf), config).select("transaction_id", "rule_action", "rule_name", F.concat_ws(",", "matched_rules").alias("matched"))


def early_labels_found(spark: SparkSession, sf: str) -> DataFrame:
    """What the check of early labels finds where every label is shown at once."""
    shown = B._facts(spark, sf).withColumn("is_confirmed_fraud", F.col("decision") == "block")
    return D.early_labels(shown, I.AS_OF).select("transaction_id", "label_available_at", "is_confirmed_fraud")


def tuned_costs(spark: SparkSession, sf: str) -> DataFrame:
    """All that tuning reports of the pair it chooses."""
    out = E.tune_thresholds(B._scored(spark, sf).withColumn("amount", F.col("amount") / 10_000))
    rates = ("review_threshold", "block_threshold", "review_rate", "block_rate", "cost_reduction")
    return out.select(*[F.round(c, 6).alias(c) for c in rates], *[F.round(c, 3).alias(c) for c in ("missed_fraud_cost", "review_cost", "false_block_cost", "expected_cost", "baseline_cost")])


QUERIES = {f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", None) == __name__ and not f.__name__.startswith("_")}
