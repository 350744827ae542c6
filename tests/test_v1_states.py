"""The first generation's regimes are latent states fitted on each fold's training rows."""

from pyspark.sql import functions as F

from tidemark.functions import indicators as I
from tidemark.operators import splits, states
from tidemark.plans import first_generation, inputs
from tidemark.sources.saved import Run, save


def test_regimes_are_filtered_states_of_the_training_rows(spark):
    with Run(spark) as run:
        frame = save(I.feature_frame(inputs.panel(spark, "/root/testdata/sf0.01")), "features")
        pred = save(first_generation.predictions(frame, first_generation.Config()), "predictions")
        one = pred.select(F.abs(F.col("state_p_range") + F.col("state_p_trend") + F.col("state_p_stress") - 1).alias("off"), "regime_probability").agg(F.max("off"), F.min("regime_probability")).first()
        assert one[0] < 1e-9 and one[1] >= 1 / 3
        assert first_generation.regimes(pred).where("mean_filtered_probability is null").isEmpty()
        rows = I.complete_rows(frame, [*I.COMBINED, "future_return"])
        parts = splits.assign(rows, splits.fold_table(spark, rows.count(), 5, 1)).where("fold = 5")
        want = {r["ts"]: r["state_label"] for r in states.fold_states(parts, ["fold"], first_generation.STATE_STARTS).collect()}
        got = {r["ts"]: r["regime"] for r in pred.where("fold = 5 and signal = 'rsi'").collect()}
        assert got and all(want[t] == label for t, label in got.items())
        run.drop()
