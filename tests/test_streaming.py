from neargrid.operators import requests, search
from neargrid.plans.queries import fraud_requests, query_vectors, references, stream_requests
from neargrid.streaming.scorer import score_stream

SF = "/root/testdata/sf0.001"


def test_any_text_is_an_id(spark, tmp_path):
    f = fraud_requests(spark, SF)
    good = [r.body for r in requests.request_json(f.where("is_query").limit(4)).collect()]
    ids = ["a-1", "b-1", "no digits", "ü"]
    bodies = [b.replace(b[: b.index(",")], '{"id":"' + i + '"', 1) for b, i in zip(good, ids)]
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(b,) for b in bodies], "body string").write.text(inbox)
    index = search.build_index(references(f))
    score_stream(stream_requests(spark, inbox, 9), index, out, str(tmp_path / "state")).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == sorted(ids)


def test_lower_bounds_sort_nothing(spark):
    f = fraud_requests(spark, SF)
    index = search.build_index(references(f))
    q = search.as_queries(query_vectors(f), "request_id")
    plan = search.with_bounds(q, index)._jdf.queryExecution().executedPlan().toString()
    assert "Sort [" not in plan and "rangepartitioning" not in plan and plan.count("collect_list") == 0


def test_rejects_are_written_beside_decisions(spark, tmp_path):
    f = fraud_requests(spark, SF)
    good = [r.body for r in requests.request_json(f.where("is_query").limit(3)).collect()]
    bad = {'{"transaction":': "json", good[0] + "x": "json", "{}": "fields", good[0].replace('"id":"tx-', '"id":"' + "x" * 2100 + '-'): "size"}
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(b,) for b in [*good, *bad]], "body string").repartition(2).write.text(inbox)
    score_stream(stream_requests(spark, inbox, 1), search.build_index(references(f)), out, str(tmp_path / "state")).awaitTermination()
    assert spark.read.parquet(out).count() == len(good)
    assert {r.body: r.reason for r in spark.read.parquet(f"{out}-rejects").collect()} == bad
