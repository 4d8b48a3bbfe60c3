import gc

import pytest

from pressmill.functions import htmltree
from pressmill.operators import extract
from pressmill.session import TEXT_BATCH_ROWS
from pressmill.sources import html_results

PAGE = "<html><body><div>" + "<p>" + "A paragraph of some length, with commas, and more. " * 3 + "</p>" * 1 + "</div></body></html>"
KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("walk", [htmltree.content_html, extract.harvest_one, lambda x: html_results.parse_result_page("google", x)])
def test_a_page_leaves_no_tree_behind(walk):
    page = PAGE.replace("<p>", "<p><b>x</b>" * 50)
    gc.collect()
    gc.disable()
    try:
        for _ in range(20):
            walk(page)
        assert gc.collect() < 200
    finally:
        gc.enable()


@pytest.mark.parametrize("build", [
    lambda r: extract.rejected(r), lambda r: extract.harvest_tags(r),
    lambda r: html_results.parse_html_results(r.selectExpr("url", "'google' AS engine", "payload"))])
def test_pages_go_to_python_in_small_batches(spark, build):
    r = spark.createDataFrame([("u", "u", 200, "text/html", PAGE)], "url string, final_url string, status int, content_type string, payload string")
    before = spark.conf.get(KEY)
    spark.conf.set(KEY, "10000")
    try:
        build(r).collect()
        assert int(spark.conf.get(KEY)) <= TEXT_BATCH_ROWS
    finally:
        spark.conf.set(KEY, before)
