"""A model's contexts beyond those that are broadcast count as well."""

from loomwright.llm import queries, urls

from .test_phrases_search_urls import brute_models, url_rows


def test_contexts_beyond_the_broadcast_ones_count(spark):
    rows = url_rows()
    frame = spark.createDataFrame(rows, "page_id long, url string").repartition(3)
    whole = urls.UrlFilter(spark, frame, queries.URL_RULES)
    few = urls.UrlFilter(spark, frame, queries.URL_RULES, contexts=20)
    assert whole.gains is None and few.gains.count() > 20 and len(few.accepted.contexts) == 20
    assert sorted(map(tuple, few.judged().drop("difference").collect()), key=repr) == brute_models(rows, queries.URL_RULES)
    near = lambda f: sorted(((r.page_id or -1, r.host, r.path, round(r.difference, 9)) for r in f.judged().collect()))
    assert near(few) == near(whole)
