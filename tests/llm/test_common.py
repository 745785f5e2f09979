"""Batches between the JVM and Python are bounded, and what operators return doesn't depend on their size."""

import numpy as np
import pytest

from kinfold.llm import common, lines, minhash, suffixes, toxicity

CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@pytest.fixture
def conf(spark):
    before = spark.conf.get(CONF)
    yield spark.conf
    spark.conf.set(CONF, before)


@pytest.mark.parametrize("given, kept", [("64m", common.BATCH_BYTES), ("1000", 1000), ("1g", common.BATCH_BYTES)])
def test_batches_are_bounded_and_smaller_settings_stay(spark, conf, given, kept):
    conf.set(CONF, given)
    common.small_batches(spark)
    assert spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch() == kept


@pytest.mark.parametrize("given, kept", [("10485760b", common.BROADCAST_BYTES), ("256k", 256 * 1024), ("-1", -1), ("1g", common.BROADCAST_BYTES)])
def test_broadcasts_are_bounded_and_smaller_settings_stay(spark, given, kept):
    names = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = [spark.conf.get(x, None) for x in names]
    try:
        for x in names:
            spark.conf.set(x, given)
        common.stored(spark, spark.range(1), "one")
        assert spark._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold() == kept
        assert spark.conf.get(names[1]) == (str(kept) if kept == common.BROADCAST_BYTES else given)
    finally:
        for x, v in zip(names, before):
            spark.conf.unset(x) if v is None else spark.conf.set(x, v)


def test_slices_come_whole_though_memory_is_released():
    assert list(common.slices(np.array([0, 3, 3, 900, 901]), 10)) == [(0, 2), (2, 3), (3, 4)]
    assert list(common.slices(np.array([0]), 10)) == []


def test_results_do_not_depend_on_batches(spark, conf):
    long = " ".join(f"word{k}" for k in range(300))
    texts = [None, "", "a short one", long, long + " end", "x\n" + long, "you awful skunk", long.replace("word7", "w")] * 3
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).persist()
    labels = spark.createDataFrame([(k, int(k % 8 == 6)) for k in range(len(texts))], "doc_id long, toxic int")

    def results():
        near = minhash.near_duplicates(spark, docs).orderBy("doc_id").collect()
        cut = suffixes.cut_repeats(spark, docs).orderBy("doc_id").collect()
        gone = sorted(map(tuple, lines.repeated_lines(spark, docs).collect()), key=str)
        scores = toxicity.score(docs, toxicity.fit(spark, docs, labels)).orderBy("doc_id").collect()
        return near, cut, gone, scores

    conf.set(CONF, str(common.BATCH_BYTES))
    whole = results()
    conf.set(CONF, "100")
    assert results() == whole
