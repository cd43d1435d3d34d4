"""Queries against their SQL on small made tables, for the findings of round 4."""

from test_findings_r03 import same_as_sql


def test_titles_with_entities_that_the_sql_leaves(spark, tmp_path):
    heads = ["token = &quot;6c2c&quot;", "b", "c", "it&#39;s &copy; &nbsp;&#x41;", "e", "f", "&amp;quot; &amp;lt; &AMP; &lt &lt;&gt;"]
    got = same_as_sql(spark, tmp_path, "s7_markdown_titles", pages=[{"page_id": i, "url": "https://x.org/a", "html": f"<html><head><title>t</title></head><body><article><h1>{h}</h1><p>p</p></article></body></html>"} for i, h in enumerate(heads)])
    assert dict(got)[0] == heads[0]
