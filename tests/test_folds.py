"""Folds and rolling windows follow the table's own number of rows."""

from pyspark.sql import functions as F

from tidemark.plans import inputs, registry


def test_fold_assignment_reaches_the_last_bar(spark):
    d = "/root/testdata/sf0.01"
    n, last = inputs.panel(spark, d).agg(F.count("*"), F.max("ts")).first()
    got = registry.queries()["joi_fold_assignment"](spark, d).where("part = 'test'").agg(F.sum("rows"), F.max("last_ts")).first()
    assert n > 690 and got[0] == 5 * (n // 6) and got[1] == last


def test_rolling_edge_follows_the_rows(spark, sf_dir):
    p = inputs.predictions(spark, sf_dir)
    n = p.where("signal = 'rsi'").count()
    size = min(180, max(30, n // 20))
    got = registry.queries()["win_rolling_edge"](spark, sf_dir).where("signal = 'rsi' and rolling_incremental_net_edge is not null").count()
    assert size != 34 and got == max(0, n - max(15, size // 3) + 1)
