"""Histories, checkpoints and study sequences."""

import pytest
from pyspark.sql import functions as F

from tally.operators import clean, history, studies


def test_early_stopping_equal_loss_resets(spark):
    h = spark.createDataFrame([("r", e, v) for e, v in enumerate([1.0, 1.0, 1.0, 2.0, 2.0], 1)],
                              "run string, epoch int, loss double")
    r = history.early_stopping(h, "run", "epoch", "loss", patience=2).first()
    assert r.stop_epoch == 5 and r.best_epoch == 3


def test_early_stopping_nan_becomes_best(spark):
    h = spark.createDataFrame([("r", 1, 1.0), ("r", 2, float("nan")), ("r", 3, 5.0), ("r", 4, 6.0)],
                              "run string, epoch int, loss double")
    r = history.early_stopping(h, "run", "epoch", "loss", patience=2).first()
    assert r.best_epoch == 3 and r.stop_epoch is None


def test_early_stopping_count_variant(spark):
    h = spark.createDataFrame([("r", 1, 0.5), ("r", 2, 0.5), ("r", 3, 0.4)], "run string, epoch int, f1 double")
    r = history.early_stopping(h, "run", "epoch", "f1", patience=2, mode="max", tie="count").first()
    assert r.stop_epoch == 3 and r.best_epoch == 1


def test_checkpoint_epoch_zero_sorts_last(spark):
    df = spark.createDataFrame([("model_epoch_0.pth",), ("model_epoch3.pth",), ("best_epoch_9.pth",),
                                ("final.pth",)], "name string")
    rows = {r.name: (r.epoch, r.is_best, r.sort_epoch) for r in clean.parse_checkpoint_name(df).collect()}
    assert rows["model_epoch_0.pth"] == (0, False, 999)
    assert rows["model_epoch3.pth"] == (3, False, 3)
    assert rows["best_epoch_9.pth"] == (None, True, 999)
    assert rows["final.pth"] == (None, False, 999)


def test_pad_truncates_long_study(spark):
    seq = spark.createDataFrame([(1, p, p % 2) for p in range(70)] + [(2, 0, 1)], "study_id long, pos int, label int")
    rows = {r.study_id: r for r in studies.pad_sequences(seq, 60).collect()}
    assert rows[1].n_real == 60 and len(rows[1].labels) == 60 and rows[1].padding_mask.count(True) == 0
    assert rows[2].n_real == 1 and rows[2].loss_mask[:2] == [1.0, 0.0] and rows[2].padding_mask[1] is True


def test_order_slices_ties_by_slice_id(spark):
    sl = spark.createDataFrame([(1, 5, 2.0), (1, 3, 2.0), (1, 9, 1.0)], "study_id long, slice_id long, z_pos double")
    got = sorted((r.pos, r.slice_id) for r in studies.order_slices(sl).collect())
    assert got == [(0, 9), (1, 3), (2, 5)]


def test_merge_history_keeps_first_longest(spark):
    c = spark.createDataFrame([("r", "v1", 1, 5), ("r", "v1", 2, 10), ("r", "v2", 1, 8), ("r", "v2", 2, 10)],
                              "run string, version string, epoch int, n int")
    rows = {(r.version, r.epoch): (r.taken, r.is_final)
            for r in history.merge_history(c, "run", ["version", "epoch"], "n").collect()}
    assert rows[("v1", 2)] == (True, True) and rows[("v2", 2)] == (False, False)


def test_early_stopping_delta_moves_best_only_on_enough_gain(spark):
    # losses 1.0, 0.95 (gain .05 < delta .1: counts), 0.85 (gain .15 >= .1: new best), 0.84, 0.83
    h = spark.createDataFrame([("r", e, v) for e, v in enumerate([1.0, 0.95, 0.85, 0.84, 0.83], 1)],
                              "run string, epoch int, loss double")
    r = history.early_stopping(h, "run", "epoch", "loss", patience=2, delta=0.1).first()
    assert r.best_epoch == 3 and r.stop_epoch == 5
