"""Character references of pages: read as browsers do, or only those that are named and whole."""

from gleanspark import catalog
from gleanspark.sources.html import element_rows

PAGE = """<html><head><title>A&amp</title></head><body><nav><a href="/a?b=1&amp;c=2">x</a></nav><h1>B &amp;lt; &lt;b&gt; &quot;c&#x27; &am</h1>
<script>if (a && b) c = "&amp;&lt;";</script></body></html>"""


def _texts(references):
    rows = {r["tag"]: r for r in element_rows(PAGE, references=references)}
    return rows["title"]["text"], rows["h1"]["text"], rows["script"]["text"], rows["a"]["href"]


def test_named_references_only_are_read_where_they_are_whole():
    script, href = 'if (a && b) c = "&amp;&lt;";', "/a?b=1&c=2"
    assert _texts(None) == ("A&", "B &lt; <b> \"c' &am", script, href)
    assert _texts(("&lt;", "&gt;", "&amp;")) == ("A&amp", "B &lt; <b> &quot;c&#x27; &am", script, href)
    assert _texts(()) == ("A&amp", "B &amp;lt; &lt;b&gt; &quot;c&#x27; &am", script, href)


def _pages(spark, tmp_path, *headings):
    html = '<html><head><title>{0}</title></head><body><nav><a href="/">All of it</a></nav><article><h1>{0}</h1><p>Nothing much is said of it here, nor of anything else.</p></article></body></html>'
    rows = [(i, "https://p.example/", html.format(h)) for i, h in enumerate(headings)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    return str(tmp_path)


def _equals_its_sql(spark, sf_dir, name):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf_dir}/pages.parquet/*.parquet'")
    theirs = db.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in theirs.description]
    return sorted(map(tuple, catalog.queries()[name](spark, sf_dir).select(*names).collect()), key=str) == sorted(theirs.fetchall(), key=str)


def test_page_titles_equal_their_sql_where_references_are_cut(spark, tmp_path):
    assert _equals_its_sql(spark, _pages(spark, tmp_path, "this and&amp", "a token = &quot;0b9", "x &lt; y &amp;amp; z &am", "no reference"), "page_titles_and_links")


def test_observations_of_pages_equal_their_sql_where_references_are_cut(spark, tmp_path):
    assert _equals_its_sql(spark, _pages(spark, tmp_path, "this heading ends in a cut one and&amp", "a token is here = &quot;0b9 and &#x27;", "x &lt; y &amp;amp; z and so on &am"), "observations_of_pages")
