from quarterlight.plans import queries


def test_the_whole_page_is_judged(spark, tmp_path):
    long = "<p>a long text that anybody can read</p>"
    pages = [(1, f"<html><script>x</script><h1 class=a>Hi</h1>{long}"), (2, f"<h1><b>Hi</b></h1>{long}"), (3, "<h1>A clean heading of a page</h1><p>" + "�" * 60 + "</p>"), (4, "<script>var text = 'not a text of the page'</script>")]
    spark.createDataFrame(pages, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert {r.health: r.n for r in queries.page_text_health(spark, str(tmp_path)).collect()} == {"ok": 2, "garbled": 1, "empty": 1}
