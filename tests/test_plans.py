"""Plans that must hold at scale: pruning, pushdown, group limits, no products."""

import os

import pytest
import __spark_entry__ as entry
from lexloom.operators import profile, store
from lexloom.session import durable
from lexloom.sources import corpus

SF = "/root/testdata/sf0.001"


def plan_of(frame, mode="formatted"):
    explained = frame.sparkSession._jvm.PythonSQLUtils.explainString(
        frame._jdf.queryExecution(), mode
    )
    return explained


@pytest.fixture(scope="module")
def code(spark):
    rows = [(n, "Go", f"{n}.go", f"text {n % 7}", f"h{n % 7}", 6) for n in range(50)]
    frame = spark.createDataFrame(
        rows, "id long, language string, url string, content string, hash string, size long"
    )
    return durable(frame, "code")


def test_language_filter_and_columns_reach_the_scan(code):
    plan = plan_of(corpus.corpus_frame(code, "Go"))
    assert "EqualTo(language,Go)" in plan
    assert "ReadSchema: struct<language:string,content:string>" in plan


def test_totals_read_two_columns(code):
    plan = plan_of(store.bytes_by_language(code, code.select("language").distinct()))
    assert "content" not in plan and "ReadSchema: struct<language:string,size:bigint>" in plan


def test_dedup_limits_copies_before_the_shuffle(code):
    plan = plan_of(store.first_arrivals(code), "simple")
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_top_tokens_are_limited_before_the_shuffle(code):
    rows = profile.token_rows(
        profile.tokenise(code.withColumnRenamed("id", "doc_id"), generic=True)
    )
    plan = plan_of(profile.top_tokens(profile.token_frequency(rows)), "simple")
    assert plan.count("WindowGroupLimit") == 2
    # Counting happens on both sides of its shuffle.
    assert plan.count("HashAggregate") == 2


def test_tokeniser_is_in_the_plan_once(code):
    rows = profile.token_rows(
        profile.tokenise(code.withColumnRenamed("id", "doc_id"), generic=True)
    )
    optimised = rows._jdf.queryExecution().optimizedPlan().toString()
    assert optimised.count("regexp_extract_all") == 1


def test_small_inputs_are_spread_and_large_ones_left_alone(spark, code):
    files = code.withColumnRenamed("id", "doc_id").coalesce(1)
    cores = spark.sparkContext.defaultParallelism
    assert corpus.spread(files).rdd.getNumPartitions() == 3 * cores
    assert corpus.spread(spark.range(9, numPartitions=cores), "id").rdd.getNumPartitions() == cores


def test_pruning_shuffles_files_not_tokens(spark, code):
    from lexloom.operators import frames

    tokenised = profile.tokenise(code.withColumnRenamed("id", "doc_id"), generic=True)
    words = durable(profile.vocabulary(profile.token_rows(tokenised)), "words")
    plan = plan_of(frames.pruned(tokenised, words), "simple")
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("BroadcastHashJoin") == 1


def test_masking_neither_shuffles_nor_sorts(code):
    from lexloom.operators.declared import masked_tokens

    tokenised = profile.tokenise(code.withColumnRenamed("id", "doc_id"))
    plan = plan_of(masked_tokens(tokenised), "simple")
    assert "Exchange" not in plan and "Sort" not in plan and "Window" not in plan


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are absent")
@pytest.mark.parametrize("name", sorted(set(entry.queries()) - {"e10_continue_prompts"}))
def test_no_products_and_no_row_udfs(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF), "simple")
    for costly in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert costly not in plan
