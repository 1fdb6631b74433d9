"""Generated summaries checked against the facts they were given."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paysift.functions.payments import let
from paysift.operators.cases import summary_line
from paysift.operators.ranking import group_quantiles

ACTIONS = ("approve", "reject", "investigate_further")
NUMBER = r"-?\d[\d,]*\.?\d*"
RESPONSE = "summary string, key_risk_signals array<string>, similar_cases array<string>, recommended_action string, confidence double"
#: Features that a facts text names, with their labels.
NARRATIVE = {
    "amount": "payment amount",
    "card_txn_count_10m": "payments on this card in the last 10 minutes",
    "card_txn_count_24h": "payments on this card in the last 24 hours",
    "card_amount_sum_24h": "total charged to this card in 24 hours",
    "amount_to_card_avg_ratio": "multiple of this card's average payment",
    "card_amount_avg_lifetime": "this card's average payment",
    "seconds_since_card_last_txn": "seconds since the previous payment",
    "card_is_new": "first payment ever seen on this card (1 = yes)",
    "card_new_device": "device never seen on this card before (1 = yes)",
    "card_new_email_domain": "recipient email domain new for this card (1 = yes)",
    "is_night": "made between midnight and 6am (1 = yes)",
}


#: Headings of a facts text.
HEADINGS = {
    "head": "PAYMENT UNDER REVIEW",
    "facts": "\nBEHAVIOURAL FACTS",
    "reasons": "\nWHAT DROVE THE SCORE (from the model, strongest first)",
    "cases": "\nSIMILAR PAST CASES (already confirmed)",
    "no_cases": "\nSIMILAR PAST CASES: none found.",
}


def numbers_in(text: Column) -> Column:
    """Every number in a text, as a reader sees them: 1,234.50 or -3.2."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(NUMBER), F.lit(0))
    return F.filter(F.transform(found, lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")), lambda x: x.isNotNull())


def supported_numbers(facts: DataFrame) -> Column:
    """Numbers that a facts row (see assemble_facts) supports."""
    doubles = lambda c: F.array(c.cast("double"))
    cases = F.coalesce(F.col("similar_cases"), F.array().cast(facts.schema["similar_cases"].dataType))
    reasons = F.coalesce(F.col("top_reasons"), F.array().cast(facts.schema["top_reasons"].dataType))
    parts = [
        *[doubles(F.col(c)) for c in ("amount", "review_threshold", "block_threshold", "score", "transaction_id")], F.coalesce(F.map_values("features"), F.array().cast("array<double>")),
        F.transform(reasons, lambda r: r["contribution"]), F.transform(cases, lambda c: c["amount"]), F.transform(cases, lambda c: c["transaction_id"].cast("double")),
        F.transform(cases, lambda c: c["similarity"]), doubles(F.size(cases)),
    ]
    return F.array_distinct(F.filter(F.concat(*parts), lambda x: x.isNotNull()))


def unsupported_numbers(text: Column, supported: Column, tolerance: float = 0.01) -> Column:
    """Numbers of a text that no supported number explains: up to tolerance, or rounded to 2 or 0 places.

    Whole numbers up to 10 are taken for prose.
    """
    close = lambda x, s: (F.abs(x - s) <= tolerance) | (F.bround(x, 2) == F.bround(s, 2)) | (F.bround(x, 2) == F.bround(s)) | (F.bround(x) == F.bround(s, 2)) | (F.bround(x) == F.bround(s))
    odd = lambda known: F.filter(numbers_in(text), lambda x: ~((x == F.floor(x)) & (F.abs(x) <= 10)) & ~F.exists(known, lambda s: close(x, s)))
    return let(supported, odd)


def assemble_facts(decisions: DataFrame, similar: DataFrame | None = None) -> DataFrame:
    """One facts row a decision: the audit record, its amount, and similar cases in the order of rank.

    similar: query_id, rank, transaction_id, similarity, amount, decision, is_fraud, occurred_at, resolution.
    """
    kind = "array<struct<rank:int,transaction_id:bigint,similarity:double,amount:double,decision:string,is_fraud:boolean,occurred_at:timestamp,resolution:string>>"
    rows = decisions.withColumn("amount", F.coalesce(F.try_element_at("features", F.lit("amount")), F.lit(0.0)))
    if similar is None:
        return rows.withColumn("similar_cases", F.array().cast(kind))
    fields = ["rank", "transaction_id", "similarity", "amount", "decision", "is_fraud", "occurred_at", "resolution"]
    lists = similar.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).cast(kind).alias("similar_cases"))
    return rows.join(lists, rows.transaction_id == lists.query_id, "left").drop("query_id").withColumn("similar_cases", F.coalesce("similar_cases", F.array().cast(kind)))


def _plain(x: Column) -> Column:
    return F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(F.format_string("%.2f", x))


def facts_text(facts: DataFrame) -> Column:
    """The facts of a row as text, for a prompt or a reader."""
    line = lambda label, value: F.concat(F.lit(f"- {label}: "), value)
    rule = F.concat(F.col("triggered_by"), F.coalesce(F.concat(F.lit(" (rule: "), F.col("rule_name"), F.lit(")")), F.lit("")))
    head = [F.lit(HEADINGS["head"]), line("transaction id", F.col("transaction_id").cast("string")), line("amount", F.format_string("%.2f", "amount")), line("decision", F.col("decision")), line("decided by", rule)]
    head.append(F.when(F.col("score").isNotNull(), F.format_string("- model score: %.4f (review at %.4f, block at %.4f)", "score", "review_threshold", "block_threshold")))
    feature = lambda name: F.try_element_at("features", F.lit(name))
    known = [F.when(feature(n).isNotNull(), line(label, _plain(feature(n)))) for n, label in NARRATIVE.items()]
    reasons = F.transform("top_reasons", lambda r: F.format_string("- %s = %s (contribution %+.3f)", r["feature"], r["value"], r["contribution"]))
    drove = F.when(F.size("top_reasons") > 0, F.concat_ws("\n", F.lit(HEADINGS["reasons"]), F.array_join(reasons, "\n")))
    near = lambda c: F.when(c["similarity"] != 0, F.format_string(", similarity %.2f", c["similarity"])).otherwise("")
    cases = F.transform("similar_cases", lambda c: F.concat(F.format_string("- id %d: ", c["transaction_id"]), summary_line(c["occurred_at"], c["amount"], c["decision"], c["is_fraud"], c["resolution"]), near(c)))
    past = F.when(F.size("similar_cases") > 0, F.concat_ws("\n", F.lit(HEADINGS["cases"]), F.array_join(cases, "\n"))).otherwise(HEADINGS["no_cases"])
    return F.concat_ws("\n", *head, F.lit(HEADINGS["facts"]), *known, drove, past)


def parse_responses(responses: DataFrame, text: str = "response") -> DataFrame:
    """responses with parsed, valid and error: the JSON object of a text, or of its outermost braces, held to the contract."""
    raw = F.coalesce(F.col(text), F.lit(""))
    direct = F.when(F.try_parse_json(raw).isNotNull() & F.trim(raw).startswith("{"), raw)
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    body = F.coalesce(direct, F.when(F.try_parse_json(inner).isNotNull(), inner))
    clean = lambda a: F.filter(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.length(x) > 0)
    rows = responses.withColumn("_body", body).withColumn("_p", F.from_json("_body", RESPONSE))
    action = F.replace(F.lower(F.trim(F.col("_p.recommended_action"))), F.lit(" "), F.lit("_"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    error = (
        F.when(F.col("_body").isNull() | F.col("_p").isNull(), "no JSON object")
        .when(~F.coalesce(F.length("_p.summary").between(20, 1200), F.lit(False)), "summary")
        .when(size("_p.key_risk_signals") > 5, "key_risk_signals").when(size("_p.similar_cases") > 10, "similar_cases")
        .when(~F.coalesce(action.isin(*ACTIONS), F.lit(False)), "recommended_action").when(~F.coalesce(F.col("_p.confidence").between(0, 1), F.lit(False)), "confidence")
    )
    parsed = F.struct(
        F.col("_p.summary").alias("summary"), clean(F.col("_p.key_risk_signals")).alias("key_risk_signals"), clean(F.col("_p.similar_cases")).alias("similar_cases"), action.alias("recommended_action"), F.col("_p.confidence").alias("confidence")
    )
    return rows.withColumn("error", error).withColumn("valid", F.col("error").isNull()).withColumn("parsed", F.when(F.col("valid"), parsed)).drop("_body", "_p")


def grounding(parsed: DataFrame) -> DataFrame:
    """parsed responses joined with facts, with unsupported (numbers) and invented (case ids, repeats kept)."""
    text = F.concat_ws(" ", F.col("parsed.summary"), F.array_join("parsed.key_risk_signals", " "))
    offered = F.transform("similar_cases", lambda c: c["transaction_id"].cast("string"))
    return parsed.withColumn("unsupported", F.when(F.col("valid"), unsupported_numbers(text, supported_numbers(parsed)))).withColumn("invented", F.when(F.col("valid"), F.filter("parsed.similar_cases", lambda c: ~F.array_contains(offered, F.trim(c)))))


def response_report(checked: DataFrame, latency: str = "latency_ms", examples: int = 10) -> DataFrame:
    """One row over checked responses: shares valid, accurate and usable, latencies, examples of what is wrong.

    p95 is the exclusive quantile: at place 0.95 * (n + 1), within the first and the last value.
    """
    grounded = F.col("valid") & (F.size("unsupported") == 0) & (F.size("invented") == 0)
    n = F.col("n")
    share = F.when(n > 1, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (0.95 * (n + 1) - 1) / (n - 1)))).otherwise(0.0)
    latencies = group_quantiles(checked, [], latency, [0.5, share]).select(*[F.get("quantiles", F.lit(i)).alias(f"latency_{p}_ms") for i, p in enumerate(("p50", "p95"))])
    ratio = lambda a, b: F.when(b > 0, a / b)
    bad = lambda c: F.slice(F.array_sort(F.collect_set(F.when(F.size(c) > 0, F.to_json(F.col(c))))), 1, examples)
    figures = checked.agg(
        F.count("*").alias("responses"), ratio(F.count_if("valid"), F.count("*")).alias("schema_validity"), ratio(F.count_if(grounded), F.count_if("valid")).alias("factual_accuracy"),
        ratio(F.count_if(grounded), F.count("*")).alias("usable"), F.avg(latency).alias("latency_mean_ms"),
        bad("unsupported").alias("unsupported_examples"), bad("invented").alias("invented_examples"),
    )
    at = figures.columns.index("latency_mean_ms")
    return figures.join(F.broadcast(latencies), F.lit(True), "left").select(*figures.columns[:at], *latencies.columns, *figures.columns[at:])  # one row each
