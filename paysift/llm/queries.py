"""The queries of the training-data operators, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paysift.llm import langid, quality, toxicity
from paysift.llm.common import table
from paysift.llm.decontaminate import matches
from paysift.llm.html import main_text
from paysift.llm.mixing import mix
from paysift.llm.pivots import top_products
from paysift.llm.ranked import search
from paysift.llm.runs import collapse_runs, planted_period
from paysift.llm.simhash import near_duplicates
from paysift.llm.substring import dedup_substrings
from paysift.llm.token_files import Encoding, read_tokens, write_tokens
from paysift.llm.warc import archive_pages, digests


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.predict(docs, langid.fit(docs))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", "held_out", "score", "predicted", F.size("segments").alias("n_segments"))


def op5_warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(archive_pages(table(spark, sf_dir, "pages")))


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op8_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_qda(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers  # here, so that the other queries don't need the vocabulary files

    encoding = Encoding.from_file(public_tokenizers.path("word_bpe_49k.json"), end_id=1, by_words=True)
    found = read_tokens(write_tokens(table(spark, sf_dir, "documents"), encoding))
    return found.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = collapse_runs(table(spark, sf_dir, "documents"), rewrite=planted_period, carry=["doc_id"])
    line = lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string"))
    lines = F.concat_ws("", F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    best = F.col("strongest")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), best.start.alias("start"), best.length.alias("length"), best.period.alias("period"),
        F.expr("(1000 * strongest.length) div strongest.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed_text", 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), ':' || md5(coalesce(text, '')))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][place % 3 + 1]::DOUBLE AS weight FROM s),
r AS (SELECT *, source_size / weight AS ratio, sum(source_size) OVER () AS total, sum(weight) OVER () AS weights,
             coalesce(sum(source_size) OVER f, 0) AS full_size, coalesce(sum(weight) OVER f, 0) AS full_weight
      FROM w WINDOW f AS (ORDER BY source_size / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, (1.5 * total - 2 * full_size)::DOUBLE / (weights - full_weight) AS level FROM r),
lev AS (SELECT max(level) AS level, max(ratio) AS ratio FROM (SELECT level, ratio FROM l WHERE level <= 2 * ratio ORDER BY ratio, place LIMIT 1)),
t AS (SELECT source, source_size, CASE WHEN lev.ratio IS NULL OR l.ratio < lev.ratio THEN 2.0::DOUBLE * source_size
                                       ELSE least(2.0::DOUBLE * source_size, lev.level * weight) END AS target FROM l, lev),
p AS (SELECT d.*, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size * size
            + greatest(0, least(size, budget - budget // source_size * source_size - before)) END AS BIGINT) AS taken
FROM p
"""
OP3_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, s, array_to_string(w[s:s + 12], ' ') AS win
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS s FROM d WHERE len(w) >= 13)),
rep AS (SELECT doc_id, s FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY win) AS lo FROM win) WHERE lo < doc_id),
gone AS (SELECT DISTINCT doc_id, s + i AS p FROM rep, range(0, 13) AS t(i)),
cut AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
k AS (SELECT d.doc_id, w, coalesce(ps, []) AS ps FROM d LEFT JOIN cut USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed,
       sha256(coalesce(array_to_string([w[i] for i in range(1, len(w) + 1) if NOT list_contains(ps, i)], ' '), '')) AS kept_sha256
FROM k
"""


OP5_SQL = """
WITH p AS (SELECT page_id, sha256(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS lo FROM p GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id > lo THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id > lo THEN lo END AS refers_to
FROM p JOIN f USING (payload_digest)
"""
OP6_SQL = """
WITH v AS (SELECT DISTINCT vec_id, [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
_FOLD = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_FOLD} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS n FROM (SELECT item_id, {_FOLD} AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM b)),
sizes AS (SELECT DISTINCT n FROM b),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, item_id, s, n FROM dw JOIN bw USING (n, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""
OP11_SQL = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_FOLD} AS w FROM documents),
s AS (SELECT count(*) AS docs, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
q AS (SELECT DISTINCT item_id, unnest({_FOLD}) AS term FROM benchmark),
v AS (SELECT DISTINCT term FROM q),
tf AS (SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM d) SEMI JOIN v USING (term) GROUP BY ALL),
df AS (SELECT term, CAST(count(*) AS BIGINT) AS df FROM tf GROUP BY term),
p AS (SELECT r, doc_id, tf.term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT)
             * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // total))) AS part FROM tf JOIN df USING (term), s),
e AS (SELECT item_id, r, doc_id, CAST(sum(part) AS BIGINT) AS score FROM p JOIN q USING (term) GROUP BY item_id, r, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM e WHERE score > 0) WHERE rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    found = {"op2_source_mixing": OP2_SQL, "op3_substring_dedup": OP3_SQL, "op5_warc_round_trip": OP5_SQL, "op6_exact_top_k": OP6_SQL, "op8_benchmark_decontamination": OP8_SQL, "op11_ranked_search": OP11_SQL}
    return {name: sql.strip() for name, sql in found.items()}
