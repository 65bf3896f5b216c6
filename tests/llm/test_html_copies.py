"""Hosts whose pages are copies of one page keep their article."""

from fennwick.llm import html_extract

PAGE = "<html><body><nav>Menu</nav><p>Visit {}</p><article><h1>Title</h1><p>{}</p></article></body></html>"
STORY = "A long story about a lighthouse and its keeper."


def test_copied_pages_keep_their_article(spark):
    rows = [(i, f"http://same.example/{i}", PAGE.format(1, STORY)) for i in range(10)]
    rows += [(i, f"http://count.example/{i}", PAGE.format(i, STORY)) for i in range(10, 20)]
    rows += [(i, f"http://mixed.example/{i}", PAGE.format(1, STORY)) for i in range(20, 60)] + [(60, "http://mixed.example/o", PAGE.format(2, "Another story."))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages).collect()}
    assert all(got[i] == f"Title {STORY}" for i in range(60)) and got[60] == "Title Another story."
