"""Plans: filters and columns reach the scan, and hot paths stay in the JVM."""

import pytest

from loomwright.plans import catalog

JVM = ["rouge_pairs", "rouge_macro", "rank_by_rouge2", "ranking_agreement", "tokenize_counts", "strip_lines", "latex_escape", "tournament_rank", "isotropy", "mean_pool", "reward_baseline", "best_so_far", "token_truncate_pad", "hash_sample", "train_eval_split", "resume_anti_join", "path_filter"]


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", JVM)
def test_no_python(spark, sf, name):
    p = plan(catalog.QUERIES[name](spark, sf))
    assert "Python" not in p and "Pandas" not in p and "Arrow" not in p
    assert "CartesianProduct" not in p


def test_filters_and_columns_reach_the_scan(spark, sf):
    p = plan(catalog.QUERIES["dataset_slice"](spark, sf))
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,10), LessThan(doc_id,500)]" in p
    assert "ReadSchema: struct<doc_id:bigint,n_chars:bigint>" in p
    p = plan(catalog.QUERIES["resume_anti_join"](spark, sf))
    assert "text" not in p


def test_sample_is_a_top_k(spark, sf):
    assert "TakeOrderedAndProject" in plan(catalog.QUERIES["hash_sample"](spark, sf))
