"""A query for each operator over the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paysift.functions import payments as P
from paysift.operators import boosting as BO
from paysift.operators import cases as C
from paysift.operators import decisions as D
from paysift.operators import drift as DR
from paysift.operators import evaluate as E
from paysift.operators import features as FE
from paysift.operators import labels as L
from paysift.operators import layers as LA
from paysift.operators import marts as M
from paysift.operators import model as MO
from paysift.operators import quality as Q
from paysift.operators import ranking as R
from paysift.operators import responses as RE
from paysift.operators import rules as RU
from paysift.plans import inputs as I
from paysift.sources import ingest as S
from paysift.storage import new_path, write_table
from paysift.streaming import cards

Query = Callable[[SparkSession, str], DataFrame]


def _rounded() -> list[Column]:
    """Features to six places. Means of cents often end in a 5 at the seventh: the shift keeps sums taken in another
    order from rounding another way."""
    return [F.round(F.col(c) + 1e-8 if c == "card_amount_avg_lifetime" else F.col(c), 6).alias(c) for c in FE.FEATURES]


def card_features(spark: SparkSession, sf: str) -> DataFrame:
    return FE.add_card_features(I.payments(spark, sf), "card_key").select("transaction_id", *_rounded())


def card_features_by_day(spark: SparkSession, sf: str) -> DataFrame:
    return FE.add_card_features_by_day(I.payments(spark, sf), "card_key").select("transaction_id", *_rounded())


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    return spark.readStream.schema(I.table(spark, sf, "events").schema).parquet(f"{sf}/events.parque[t]")


def _finish(rows: DataFrame, name: str, store: bool = False) -> DataFrame:
    """Runs a stream of what is there to its end and reads what it wrote."""
    spark = rows.sparkSession
    out, key = new_path(spark, name), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    if store:
        spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        query = rows.writeStream.format("parquet").outputMode("append").option("path", out).option("checkpointLocation", new_path(spark, f"{name}-state")).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if store:
            spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.schema(rows.schema).parquet(out)


def stream_card_features(spark: SparkSession, sf: str) -> DataFrame:
    stream = cards.stream_features(I.as_payments(_event_stream(spark, sf)), ttl_hours=None, tracked=1000)
    return _finish(stream, "features", store=True).select("transaction_id", *_rounded())


def stream_bronze(spark: SparkSession, sf: str) -> DataFrame:
    bronze = _finish(S.parse_payment_events(I.as_messages(_event_stream(spark, sf))), "bronze")
    return bronze.select("transaction_id", "kafka_partition", "kafka_offset", "event_date", "card_key", F.round("amount", 6).alias("amount"))


def stream_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """Rules on score-time features, without a model, in one streaming query."""
    features = cards.stream_features(I.as_payments(_event_stream(spark, sf)), ttl_hours=None, tracked=1000)
    made = cards.decide_stream(features, _RULES, 0.6, 0.95)
    return _finish(made.select("transaction_id", "decision", "triggered_by", "rule_name", "degraded"), "decisions", store=True)


def stream_kpis(spark: SparkSession, sf: str) -> DataFrame:
    """Days that the watermark has closed."""
    stream = spark.readStream.schema(I.table(spark, sf, "orders").schema).parquet(f"{sf}/orders.parque[t]")
    return _finish(cards.kpi_stream(I.as_decisions(stream)), "kpis")


def parsed_decisions(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.decisions(spark, sf)
    sent = rows.select(F.lit(None).cast("binary").alias("key"), F.to_json(F.struct(*[c for c in rows.columns if c != "kafka_timestamp"])).cast("binary").alias("value"), F.col("kafka_timestamp").alias("timestamp"))
    return S.parse_decisions(sent).select("transaction_id", "decided_at", "decision_date", "decision", F.round("score", 9).alias("score"), F.size("matched_rules").alias("n_rules"), F.col("features")["amount"].alias("amount"))


def prediction_drift(spark: SparkSession, sf: str) -> DataFrame:
    out = DR.prediction_drift(R.window_split(D.latest_attempts(I.decisions(spark, sf)).select("transaction_id", "decided_at", "score"), time="decided_at"))
    return out.withColumn("drifted_columns", F.array_join("drifted_columns", ","))


def card_day_states(spark: SparkSession, sf: str) -> DataFrame:
    """The state of each card with its last 24 hours, as the stream keeps it, to JSON and back. Payments of a second are
    one entry, so no card has more than 86,401."""
    rows = I.payments(spark, sf).withColumn("second", F.col("event_time").cast("long"))
    cards_ = rows.groupBy("card_key").agg(F.count("*").alias("n"), F.sum("amount").alias("total"), F.max("second").alias("last"), F.array_sort(F.collect_set("device_info")).alias("devices"), F.array_sort(F.collect_set("r_emaildomain")).alias("domains"))
    seconds = rows.groupBy("card_key", "second").agg(F.sum("amount").alias("amount"))
    near = seconds.join(cards_.select("card_key", "last"), "card_key").where(F.col("second") >= F.col("last") - FE.DAY)
    recent = near.groupBy("card_key").agg(F.array_sort(F.collect_list(F.struct("second", "amount"))).alias("recent"))
    state = F.struct("n", "total", "last", "recent", "devices", "domains")
    back = cards.decode_state(cards.encode_state(state))
    states = cards_.join(recent, "card_key").select("card_key", back.alias("s"))
    return states.select("card_key", "s.n", F.round("s.total", 2).alias("total"), F.size("s.recent").alias("n_recent"), F.array_join("s.devices", ",").alias("devices"))


def silver_first_arrivals(spark: SparkSession, sf: str) -> DataFrame:
    bronze = S.parse_payment_events(I.as_messages(I.table(spark, sf, "events")))
    return LA.to_silver(bronze, I.SALT).select("transaction_id", "event_time", "event_date", "transaction_dt", "card_token", F.round("amount", 6).alias("amount"), "product_cd", "r_emaildomain", "device_info")


def gold(spark: SparkSession, sf: str) -> DataFrame:
    bronze = S.parse_payment_events(I.as_messages(I.table(spark, sf, "events")))
    rows = LA.to_gold(LA.to_silver(bronze, I.SALT))
    return rows.select(*LA.KEYS, *_rounded(), *LA.PASSTHROUGH)


def quality_report(spark: SparkSession, sf: str) -> DataFrame:
    bronze = S.parse_payment_events(I.as_messages(I.table(spark, sf, "events")))
    return Q.check(LA.to_silver(bronze, I.SALT))


def bronze_summary(spark: SparkSession, sf: str) -> DataFrame:
    return M.bronze_summary(I.payments(spark, sf))


def rows_per_day(spark: SparkSession, sf: str) -> DataFrame:
    return M.rows_per_day(I.payments(spark, sf))


def most_recent(spark: SparkSession, sf: str) -> DataFrame:
    return M.most_recent(I.payments(spark, sf), 20).select("transaction_id", "event_time", "card_key", "amount")


def payments_from_flat(spark: SparkSession, sf: str) -> DataFrame:
    orders, customers = I.table(spark, sf, "orders"), I.table(spark, sf, "customer")
    flat = orders.select(
        F.col("o_orderkey").alias("TransactionID"), (F.col("o_orderkey") * 60).alias("TransactionDT"), F.col("o_totalprice").alias("TransactionAmt"), F.col("o_orderstatus").alias("ProductCD"), F.col("o_custkey").alias("card1"),
        F.when(F.col("o_custkey") % 3 != 0, (F.col("o_custkey") % 100).cast("double")).alias("addr1"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise(" ").alias("P_emaildomain"),
        F.when(F.col("o_orderkey") % 4 == 0, F.col("o_totalprice")).alias("C1"), (F.col("o_orderkey") % 7).cast("double").alias("C2"),
    )
    identity = orders.where("o_orderkey % 3 = 0").join(customers, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("TransactionID"), F.col("c_mktsegment").alias("DeviceType"), F.col("c_name").alias("DeviceInfo"))
    events = S.payments_from_flat(flat, identity)
    return events.select("transaction_id", "event_time", "transaction_dt", "card_key", "amount", "product_cd", "p_emaildomain", "device_type", "device_info", F.size("counts").alias("n_counts"), F.try_element_at("counts", F.lit("C1")).alias("c1"), F.try_element_at("counts", F.lit("C2")).alias("c2"))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    out = S.to_messages(I.payments(spark, sf))
    field = lambda n: F.get_json_object("value", f"$.{n}")
    return out.select("key", field("transaction_id").cast("long").alias("transaction_id"), field("amount").cast("double").alias("amount"), field("device_info").alias("device_info"))


def label_table(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.chargebacks(spark, sf).select("transaction_id", "is_fraud", "event_time")
    return L.label_table(rows).select("transaction_id", "is_fraud", F.round("delay_days", 9).alias("delay_days"), F.date_trunc("second", "label_available_at").alias("known_second"), "label_source")


def label_summary(spark: SparkSession, sf: str) -> DataFrame:
    return L.label_summary(I.chargebacks(spark, sf), I.AS_OF)


def _training(spark: SparkSession, sf: str, policy: str) -> DataFrame:
    return L.training_set(I.silver_like(spark, sf), I.chargebacks(spark, sf), I.AS_OF, policy)


def training_set(spark: SparkSession, sf: str) -> DataFrame:
    return _training(spark, sf, L.EXCLUDE).select("transaction_id", "amount", "is_fraud", "label_available_at", "label_is_assumed")


def training_set_assumed(spark: SparkSession, sf: str) -> DataFrame:
    return _training(spark, sf, L.ASSUME_LEGITIMATE).select("transaction_id", "amount", "is_fraud", "label_available_at", "label_is_assumed")


def training_summary(spark: SparkSession, sf: str) -> DataFrame:
    return L.training_summary(_training(spark, sf, L.ASSUME_LEGITIMATE)).withColumn("fraud_rate", F.round("fraud_rate", 9))


def _facts(spark: SparkSession, sf: str) -> DataFrame:
    staged = D.staged_decisions(I.decisions(spark, sf)).drop("features", "top_reasons")
    return D.fact_decisions(staged, LA.staged_payments(I.silver_like(spark, sf)), LA.staged_chargebacks(I.chargebacks(spark, sf)), I.AS_OF)


def fact_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return _facts(spark, sf).select("transaction_id", "decided_at", "decision", "rule_name", "amount", "label_available_at", "is_confirmed_fraud", "label_is_known", "was_flagged", "outcome")


def _money(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.round(c, 2) for c, kind in rows.dtypes if kind == "double" and ("value" in c or "cost" in c)})


def daily_kpis(spark: SparkSession, sf: str) -> DataFrame:
    return _money(M.daily_kpis(_facts(spark, sf)))


def model_performance(spark: SparkSession, sf: str) -> DataFrame:
    return _money(M.model_performance(_facts(spark, sf)))


def rule_effectiveness(spark: SparkSession, sf: str) -> DataFrame:
    return _money(M.rule_effectiveness(_facts(spark, sf)))


def latest_day(spark: SparkSession, sf: str) -> DataFrame:
    return M.latest_day(M.daily_kpis(_facts(spark, sf))).select("decision_date", "payments_scored", "blocked")


def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    reviewed = I.table(spark, sf, "orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("transaction_id"))
    return M.review_queue(_facts(spark, sf), reviewed).select("transaction_id", "decided_at", "decision")


def flagged_known(spark: SparkSession, sf: str) -> DataFrame:
    return M.flagged_known(D.latest_attempts(I.decisions(spark, sf)), I.chargebacks(spark, sf), I.AS_OF).select("transaction_id", "decision", "is_fraud")


def confirmed_cases(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.confirmed_cases(D.latest_attempts(I.decisions(spark, sf)), I.chargebacks(spark, sf), I.silver_like(spark, sf), I.AS_OF)
    return rows.select("transaction_id", "decided_at", "decision", "is_fraud", "product_cd")


def case_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.confirmed_cases(D.latest_attempts(I.decisions(spark, sf)), I.chargebacks(spark, sf), I.silver_like(spark, sf), I.AS_OF)
    return C.cases_from_confirmed(rows).select("transaction_id", "description", "is_fraud")


def case_vectors(spark: SparkSession, sf: str) -> DataFrame:
    rows = M.confirmed_cases(D.latest_attempts(I.decisions(spark, sf)), I.chargebacks(spark, sf), I.silver_like(spark, sf), I.AS_OF)
    texts = C.cases_from_confirmed(rows).select("description").distinct()
    return texts.withColumn("embedding", C.embed(F.col("description")))


def latest_features(spark: SparkSession, sf: str) -> DataFrame:
    return M.latest_features(I.decisions(spark, sf)).select("transaction_id", F.try_element_at("features", F.lit("amount")).alias("amount"))


def decision_detail(spark: SparkSession, sf: str) -> DataFrame:
    return M.decision_detail(_facts(spark, sf), I.chargebacks(spark, sf), 7).select("transaction_id", "decision", "outcome", "label")


def latency_report(spark: SparkSession, sf: str) -> DataFrame:
    out = M.latency_report(I.decisions(spark, sf))
    return out.select("requests", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99", "mean", "max")], "allow", "review", "block")


def early_labels(spark: SparkSession, sf: str) -> DataFrame:
    return D.early_labels(_facts(spark, sf), I.AS_OF)


def unexplained_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return D.unexplained(_facts(spark, sf)).select("transaction_id", "decision", "triggered_by")


_RULES = {"rules": [
    {"name": "velocity", "action": "review", "when": {"all": [{"field": "card_txn_count_24h", "op": ">=", "value": 8}]}},
    {"name": "new_card", "action": "review", "when": {"all": [{"field": "card_is_new", "op": "==", "value": 1.0}, {"field": "amount", "op": ">", "value": 50}]}},
    {"name": "large", "action": "block", "when": {"any": [{"field": "amount", "op": ">=", "value": 200}, {"field": "absent", "op": "not_null"}]}},
    {"name": "kinds", "action": "review", "when": {"all": [{"field": "device_info", "op": "in", "value": ["purchase", "refund"]}, {"field": "r_emaildomain", "op": "not_in", "value": ["1", "2", "3"]}, {"field": "amount", "op": "<", "value": 5}]}},
]}


def _ruled(spark: SparkSession, sf: str) -> DataFrame:
    return RU.apply_rules(FE.add_card_features_by_day(I.payments(spark, sf), "card_key"), _RULES)


def rules(spark: SparkSession, sf: str) -> DataFrame:
    return _ruled(spark, sf).select("transaction_id", "rule_action", "rule_name", F.concat_ws(",", "matched_rules").alias("matched"))


def blocklisted(spark: SparkSession, sf: str) -> DataFrame:
    cards_ = I.payments(spark, sf).where("amount > 250").select("card_key")
    return RU.blocklisted(I.payments(spark, sf), cards_, "card_key").select("transaction_id", "on_blocklist")


def combined_decisions(spark: SparkSession, sf: str) -> DataFrame:
    scored = _ruled(spark, sf).withColumn("model_score", P.fraction(F.col("transaction_id"), I.FRAUD_SEED))
    made = D.combine(scored, 0.6, 0.95, "v1").withColumn("card_token", F.col("card_key"))
    return D.audit(made, FE.FEATURES, decided_at=F.col("event_time")).select("transaction_id", "decision", F.round("score", 12).alias("score"), "triggered_by", "rule_name", F.size("features").alias("n_features"), "degraded")


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    labels = I.chargebacks(spark, sf).select("transaction_id", "is_fraud")
    fraction = P.fraction(F.col("o_orderkey"), I.FRAUD_SEED)
    orders = I.table(spark, sf, "orders").select(F.col("o_orderkey").alias("transaction_id"), F.col("o_totalprice").alias("amount"), F.col("o_orderdate").cast("timestamp").alias("event_time"), F.floor(fraction * 7000).alias("s"))
    return orders.join(labels, "transaction_id").withColumn("score", (F.col("s") + 3000 * F.col("is_fraud")) / 10_000.0).drop("s")


def ranking_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return R.ranking_metrics(_scored(spark, sf)).select(F.round("pr_auc", 6).alias("pr_auc"), F.round("roc_auc", 6).alias("roc_auc"))


def evaluate_model(spark: SparkSession, sf: str) -> DataFrame:
    out = E.evaluate_model(_scored(spark, sf), 0.5, 0.8)
    keep = ["fraud_rate", "precision_at_block", "recall_at_block", "false_positive_rate", "recall_including_review", "allow_rate", "review_rate", "block_rate", "fraud_value_caught_share", "pr_auc", "roc_auc"]
    return out.select("rows", "fraud_count", *[F.round(c, 6).alias(c) for c in keep], *[F.round(c, 1).alias(c) for c in ("fraud_value_total", "fraud_value_blocked", "fraud_value_missed", "legitimate_value_blocked", "expected_cost")])


def expected_cost(spark: SparkSession, sf: str) -> DataFrame:
    return E.expected_cost(_scored(spark, sf), 0.5, 0.8).select(*[F.round(c, 1).alias(c) for c in ("missed_fraud_cost", "review_cost", "false_block_cost", "expected_cost")])


def _tuned(spark: SparkSession, sf: str, **given: int) -> DataFrame:
    out = E.tune_thresholds(_scored(spark, sf).withColumn("amount", F.col("amount") / 10_000), **given)
    return out.select(*[F.round(c, 6).alias(c) for c in ("review_threshold", "block_threshold")], F.round("expected_cost", 3).alias("expected_cost"), F.round("baseline_cost", 3).alias("baseline_cost"))


def tuned_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return _tuned(spark, sf)


def class_weight(spark: SparkSession, sf: str) -> DataFrame:
    return E.class_weight(I.chargebacks(spark, sf)).select(F.round("positive_weight", 9).alias("positive_weight"))


def time_split(spark: SparkSession, sf: str) -> DataFrame:
    return R.time_split(I.payments(spark, sf)).select("transaction_id", "part")


def split_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return R.split_boundaries(R.time_split(I.payments(spark, sf)))


def promotions(spark: SparkSession, sf: str) -> DataFrame:
    month = F.date_format(F.col("o_orderdate").cast("timestamp"), "yyyy-MM").alias("version")
    runs = I.table(spark, sf, "orders").groupBy(month).agg(F.round(F.avg("o_totalprice"), 2).alias("pr_auc"))
    return E.promotions(runs)


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    return R.window_split(I.payments(spark, sf).withColumn("day_of_week", F.weekday("event_time")))


def drift_distances(spark: SparkSession, sf: str) -> DataFrame:
    out = DR.numeric_distances(_windows(spark, sf), ["amount", "transaction_dt"])
    return out.select("column", "n_reference", "n_current", "distinct", F.round("ks", 6).alias("ks"), F.round(F.col("wasserstein") / F.col("deviation"), 6).alias("scaled_distance"))


def drift_categories(spark: SparkSession, sf: str) -> DataFrame:
    out = DR.category_distances(_windows(spark, sf), ["device_info", "day_of_week"])
    return out.select("column", "n_reference", "n_current", "distinct", F.round("js", 6).alias("js"), F.round("chi2", 4).alias("chi2"))


def drift_report(spark: SparkSession, sf: str) -> DataFrame:
    return DR.drift(_windows(spark, sf), ["amount", "transaction_dt", "device_info", "day_of_week"])[0].withColumn("value", F.round("value", 6))


def nearest_cases(spark: SparkSession, sf: str) -> DataFrame:
    stored = I.cases(spark, sf)
    found = C.nearest(stored.where("transaction_id % 20 = 0"), stored)
    return found.withColumn("similarity", F.round("similarity", 6))


def nearest_cases_all(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours of every case; nearest_cases has those of every id that 20 divides."""
    stored = I.cases(spark, sf)
    return C.nearest(stored, stored).withColumn("similarity", F.round("similarity", 6))


def retrieval_precision(spark: SparkSession, sf: str) -> DataFrame:
    stored = I.cases(spark, sf)
    out = C.retrieval_precision(C.nearest(stored.where("transaction_id % 20 = 0"), stored), stored)
    return out.withColumn("precision", F.round("precision", 6))


def retrieval_precision_all(spark: SparkSession, sf: str) -> DataFrame:
    stored = I.cases(spark, sf)
    return C.retrieval_precision(C.nearest(stored, stored), stored).withColumn("precision", F.round("precision", 6))


def stored_embedders(spark: SparkSession, sf: str) -> DataFrame:
    return C.stored_embedders(I.cases(spark, sf))


def _latest_cases(spark: SparkSession, sf: str) -> DataFrame:
    rows = D.latest_attempts(I.decisions(spark, sf))
    return rows.select("transaction_id", "card_token", F.col("features")["amount"].alias("amount"), "decision", F.lit("old").alias("resolution"))


def case_upsert(spark: SparkSession, sf: str) -> DataFrame:
    latest = _latest_cases(spark, sf)
    new = latest.where("transaction_id % 3 = 0").withColumns({"amount": F.col("amount") * 2, "decision": F.lit("block"), "resolution": F.lit("new")})
    extra = new.where("transaction_id % 2 = 0").withColumn("transaction_id", -F.col("transaction_id") - 1)
    return C.upsert(latest, new.unionByName(extra)).drop("card_token")


def _reviews(spark: SparkSession, sf: str, part: str = "true") -> DataFrame:
    rows = D.latest_attempts(I.decisions(spark, sf)).where(part)
    return rows.select("transaction_id", F.col("decided_at").alias("reviewed_at"), F.lit("a").alias("analyst"), F.when(F.col("transaction_id") % 8 == 0, "fraud").otherwise("legitimate").alias("verdict"), F.lit("").alias("note"), F.col("decision").alias("platform_decision"), "model_version")


def _agreement(reviews: DataFrame) -> DataFrame:
    return C.agreement_rate(reviews).select(F.round("agreement_rate", 9).alias("agreement_rate"))


def agreement_rate(spark: SparkSession, sf: str) -> DataFrame:
    return _agreement(_reviews(spark, sf))


def _feedback(spark: SparkSession, sf: str, reviews: DataFrame) -> DataFrame:
    facts = D.latest_attempts(I.decisions(spark, sf)).select("transaction_id", "card_token", F.col("decided_at").alias("occurred_at"), F.col("features")["amount"].alias("amount"), "features")
    return C.cases_from_reviews(reviews, facts).select("transaction_id", "is_fraud", "decision", "resolution", "description")


def review_feedback(spark: SparkSession, sf: str) -> DataFrame:
    return _feedback(spark, sf, _reviews(spark, sf))


def recent_reviews(spark: SparkSession, sf: str) -> DataFrame:
    return C.recent_reviews(_reviews(spark, sf)).select("transaction_id", "reviewed_at", "verdict")


def numbers_in_texts(spark: SparkSession, sf: str) -> DataFrame:
    rows = I.table(spark, sf, "conversations").select("conv_id", "turn", RE.numbers_in(F.col("text")).alias("numbers"))
    return rows.select("conv_id", "turn", F.size("numbers").alias("n"), F.round(F.aggregate("numbers", F.lit(0.0), lambda s, x: s + x), 2).alias("total"))


def ungrounded_numbers(spark: SparkSession, sf: str) -> DataFrame:
    supported = F.array(F.col("conv_id").cast("double"), F.col("turn").cast("double"), F.lit(100.0))
    rows = I.table(spark, sf, "conversations").select("conv_id", "turn", RE.unsupported_numbers(F.col("text"), supported).alias("odd"))
    return rows.select("conv_id", "turn", F.size("odd").alias("n_unsupported"))


def response_checks(spark: SparkSession, sf: str) -> DataFrame:
    talk = I.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    body = F.to_json(F.struct(F.col("text").alias("summary"), F.array(F.lit(" a "), F.lit("")).alias("key_risk_signals"), F.array(F.col("turn").cast("string")).alias("similar_cases"), F.lit("Investigate further").alias("recommended_action"), (F.col("turn") / 4).alias("confidence")))
    fenced = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Here it is: "), body, F.lit(" ."))).otherwise(body)
    return RE.parse_responses(talk.withColumn("response", fenced)).select("conv_id", "turn", "valid", "error")


def facts_texts(spark: SparkSession, sf: str) -> DataFrame:
    latest = D.latest_attempts(I.decisions(spark, sf)).where(F.col("decision") != "allow")
    return (facts := RE.assemble_facts(latest)).select("transaction_id", RE.facts_text(facts).alias("facts"))


def model_matrix(spark: SparkSession, sf: str) -> DataFrame:
    rows = FE.add_card_features_by_day(I.payments(spark, sf), "card_key")
    out = MO.model_matrix(rows.withColumn("device_type", F.when(F.col("product_cd") == "click", "Mobile").when(F.col("product_cd") != "view", F.col("product_cd"))))
    return out.select("transaction_id", F.round("amount", 6).alias("amount"), "card_is_new", "C1", "device_type", "r_emaildomain", "p_emaildomain")


def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    rows = FE.add_card_features_by_day(I.payments(spark, sf), "card_key")
    return rows.join(I.chargebacks(spark, sf).select("transaction_id", "is_fraud"), "transaction_id")


def _labelled_once(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled payments as a table, as a fit goes over its rows many times and their features are windows over all payments."""
    return write_table(_labelled(spark, sf), "labelled")


def trained_model(spark: SparkSession, sf: str) -> DataFrame:
    """Trained, tuned and tested on the labels of the payments that have one."""
    rows = _labelled_once(spark, sf)
    return MO.train_and_test(rows)[2].select("rows", "fraud_count", "pr_auc", "roc_auc", "expected_cost", "baseline_cost")


def boosted_model(spark: SparkSession, sf: str) -> DataFrame:
    """What is certain of boosted trees that are grown, stopped, tuned and tested on the labelled payments: the newest part and its cost."""
    return BO.train_and_test(_labelled_once(spark, sf))[2].select("rows", "fraud_count", F.round("baseline_cost", 4).alias("baseline_cost"))


def boosted_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the parts that boosted trees give each input of each labelled payment add up to its logit."""
    matrix = MO.model_matrix(write_table(R.time_split(_labelled_once(spark, sf)), "parts"), keep=("transaction_id", "is_fraud", "part")).where("part <> 'test'")
    model, _ = BO.fit(matrix.where("part = 'train'"), matrix.where("part = 'validation'"), BO.Settings(rounds=8))
    scored = model.contributions(model.score(matrix))
    total = F.aggregate(F.map_values("contributions"), F.lit(model.expected()), lambda a, x: a + x)
    return scored.select("transaction_id", F.size("contributions").alias("n_inputs"), (F.abs(total - F.log(F.col("model_score") / (1 - F.col("model_score")))) < 1e-6).alias("adds_up"))


def explained_decisions(spark: SparkSession, sf: str) -> DataFrame:
    rows = _labelled_once(spark, sf)
    matrix = MO.model_matrix(rows, keep=("transaction_id", "is_fraud"))
    model = MO.fit(matrix)
    scored = model.contributions(model.score(matrix))
    return MO.top_reasons(scored, flagged=F.col("model_score") >= 0.5).select("transaction_id", "model_score", "top_reasons")


QUERIES: dict[str, Query] = {
    f.__name__: f for f in list(globals().values()) if callable(f) and getattr(f, "__module__", None) == __name__ and not f.__name__.startswith("_")
}

from paysift.plans import chains, streams  # noqa: E402

QUERIES |= chains.QUERIES | streams.QUERIES
