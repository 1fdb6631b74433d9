"""Figures that do not depend on how rows are dealt to tasks."""

import random

from paysift.operators import ranking


def average_precision(rows):
    """The mean precision at each positive, rows of a score together."""
    scores = sorted({s for s, _ in rows}, reverse=True)
    positives, seen, total = sum(y for _, y in rows), 0, 0.0
    for score in scores:
        at = [y for s, y in rows if s == score]
        seen += len(at)
        total += sum(at) * sum(y for s, y in rows if s >= score) / seen
    return total / positives


def test_pr_auc_is_the_same_to_the_last_bit_however_rows_are_dealt(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(200) / 7, int(rng.random() < 0.4)) for _ in range(600)]
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    found = set()
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (1, 2, 3, 4, 5, 7, 11, 16):
            spark.conf.set("spark.sql.shuffle.partitions", str(parts))
            figures = ranking.ranking_metrics(spark.createDataFrame(rows, "score double, is_fraud int").repartition(parts)).first()
            found.add((figures.pr_auc, figures.roc_auc))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(found) == 1 and abs(found.pop()[0] - average_precision(rows)) < 1e-12
