"""Written steps: where they go and when they are deleted."""

from __future__ import annotations

import os
import time

import pytest

from basketry.llm import scratch as W
from basketry.session import ensure_checkpoint_dir


def folder(spark):
    return ensure_checkpoint_dir(spark).removeprefix("file:")


def named(spark):
    return [t.name for t in spark.catalog.listTables() if t.name.startswith("some_")]


def test_bucketed_tables_go_with_their_block(spark):
    before = set(os.listdir(folder(spark)))
    rows = spark.range(100).selectExpr("id", "id % 7 as k")
    with W.bucketed(rows, ["k", "id"], "some") as table:
        own = set(os.listdir(folder(spark))) - before
        assert len(own) == 1 and table.count() == 100  # in the shared folder, not in the warehouse
        assert len(named(spark)) == 1
    assert set(os.listdir(folder(spark))) == before and not named(spark)
    with pytest.raises(ZeroDivisionError), W.bucketed(rows, "k", "some"):
        1 / 0
    assert set(os.listdir(folder(spark))) == before
    assert not named(spark)


def test_steps_are_deleted_at_the_end(spark):
    before = set(os.listdir(folder(spark)))
    kept = W.new_folder(spark, "result")
    with W.steps(spark):
        step = W.stored(spark.range(10), "one")
        W.stored(step, "two").write.parquet(kept)
        assert len(set(os.listdir(folder(spark))) - before) == 3
    assert set(os.listdir(folder(spark))) - before == {os.path.basename(kept)}
    assert spark.read.parquet(kept).count() == 10


def test_a_step_stored_within_a_block_goes_with_it(spark):
    before = set(os.listdir(folder(spark)))
    with pytest.raises(ZeroDivisionError), W.stored_within(spark.range(10), "one") as step:
        assert step.count() == 10 and len(set(os.listdir(folder(spark))) - before) == 1
        1 / 0
    assert set(os.listdir(folder(spark))) == before


@pytest.mark.parametrize("own", [None, "false"])
def test_shuffle_files_go_with_the_write(spark, own):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        found = set()
        while files.hasNext():
            name = files.next().getName()
            found |= {name} if name.endswith(".data") and name.startswith("shuffle_") else set()
        return found

    if own:
        spark.conf.set(W.SHUFFLES_GO, own)
    setting, before = spark.conf.get(W.SHUFFLES_GO, None), shuffled()
    with W.shuffles_freed(spark):
        kept = W.stored(spark.range(1000).selectExpr("id", "id % 7 AS k").groupBy("k").count(), "counts")
        end = time.time() + 20
        while shuffled() - before and time.time() < end:
            time.sleep(0.1)
        assert not shuffled() - before and kept.count() == 7
    assert spark.conf.get(W.SHUFFLES_GO, None) == setting
    if own:
        spark.conf.unset(W.SHUFFLES_GO)
