"""Operators that SQL does not express, against cases worked by hand or sequential code."""

import numpy as np
from pyspark.sql import functions as F

from pelagos.operators import service, summaries


def test_replay_passes_by_what_does_not_follow(spark):
    log = [
        (1, 1, "reviewing", None, None),
        (1, 2, "closed_false_alarm", None, None),  # lacks a reason
        (1, 3, "closed_false_alarm", "Rain_Cell", ""),
        (1, 4, "reviewing", None, " "),  # reopening lacks a note
        (1, 5, "reviewing", None, "again"),
        (2, 2, "closed_unexplained", None, "seen"),
        (2, 1, "closed_unexplained", None, None),  # lacks a note; stands first by its order
        (2, 3, "closed_explained", "VMS fleet", None),  # a closed lead must be reopened
        (3, 1, None, None, None),
        (3, 2, "closed_explained", "other", None),  # other lacks a note
        (3, 3, "closed_explained", "weather or sea clutter", None),
    ]
    frame = spark.createDataFrame(log, "lead long, n long, to_state string, reason string, note string")
    got = {tuple(r) for r in service.replay(frame, "lead", "n").collect()}
    assert got == {(1, "reviewing", 3), (2, "closed_unexplained", 1), (3, "closed_explained", 1)}
    assert service.replay(frame.limit(0), "lead", "n").count() == 0


def test_bootstrap_interval_holds_the_share_and_has_the_known_width(spark):
    n, share = 4000, 0.25
    frame = spark.range(n).select(F.col("id").alias("k"), (F.col("id") % 4 == 0).alias("hit"), F.lit(2.0).alias("w"))
    one = summaries.bootstrap_share(frame, "k", F.col("hit"), F.col("w"), 400, 5).first()
    assert one["share"] == share and one["low"] < share < one["high"]
    width = 2 * 1.96 * np.sqrt(share * (1 - share) / n)
    assert abs((one["high"] - one["low"]) / width - 1) < 0.2
    assert one == summaries.bootstrap_share(frame.repartition(7), "k", F.col("hit"), F.col("w"), 400, 5).first()
    other = summaries.bootstrap_share(frame, "k", F.col("hit"), F.col("w"), 400, 6).first()
    assert (other["low"], other["high"]) != (one["low"], one["high"])
