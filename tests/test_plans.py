"""The physical plans are the ones that hold at scale."""

import pytest

from shotgrove.operators import examples as E
from shotgrove.operators import labels as LB
from shotgrove.plans.catalog import QUERIES
from shotgrove.plans.inputs import quality_examples
from shotgrove.tasks import label_table


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["kshot_train", "kshot_dev", "knn_exact", "knn_ivf", "bm25_topk"])
def test_ranked_windows_are_trimmed_before_the_shuffle(spark, folder, name):
    assert "WindowGroupLimit" in plan(QUERIES[name](spark, folder))


def test_sampling_reads_no_texts(spark, folder):
    scans = [line for line in plan(QUERIES["kshot_train"](spark, folder)).splitlines() if "ReadSchema" in line]
    assert scans and not any("text" in line.split("ReadSchema")[1] for line in scans)


def test_prompts_stay_in_the_jvm(spark, folder):
    for name in ("render_prompt", "encode_features", "truncate_head"):
        assert "Python" not in plan(QUERIES[name](spark, folder)) and "Arrow" not in plan(QUERIES[name](spark, folder))


def test_label_lists_are_broadcast(spark, folder):
    examples = quality_examples(spark, folder)
    assert "BroadcastHashJoin" in plan(LB.label_ids(examples, label_table(spark)))


def test_filters_reach_the_scan(spark, folder):
    pairs = E.adjacent_pairs(spark.read.parquet(f"{folder}/conversations.parquet")).where("conv_id = 3")
    assert plan(pairs).count("EqualTo(conv_id,3)") == 2
