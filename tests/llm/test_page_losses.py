"""Pages whose text was lost: markup signs in raw text, and the word hidden in values of attributes."""

import pytest
from test_page_operators import BODIES, page

from roadpoints.llm import html_extract

MORE = {
    101: ("<article><p>one<script>for(i=0;i<n;i++){a('x')}</script><p>two</article>", "one two"),
    102: ("<article><p>one<script><!-- old browsers\nf()</script><p>two<style>a{} /* <b */</style><p>three</article>", "one two three"),
    103: ("<article><p>one<SCRIPT>if(a<b && c>'\"</p>'){}</SCRIPT ><p>two<textarea>x <y z=\"</textarea><p>three<title>a <b</title> end</article>", "one two three end"),
    104: ("<article><p>one<script>s = '</scripts>' + \"<![CDATA[\" </script><p>two</article>", "one two"),
    105: ("<article><div style=\"overflow:hidden\"><p>one</div><div class=\"overflow hidden\"><p>two</div><div title=\"hidden gems\"><p>three</div><p data-note='aria-hidden=\"true\"'>four</article>", "one two three four"),
    106: ("<article data-hidden=1 style='x-display:none-such'><p>one<p aria-hidden=false>two<p title='style=\"display:none\"'>three</article>", "one two three"),
    107: ("<article><p>one<p hidden>a<p HIDDEN=\"\">b<p class=x hidden=hidden>c<p aria-hidden = 'true'>d<p style=\"color:red; Display : None\">e<div style=display:none><p>f</div><p>two</article>", "one two"),
    108: ("<article><p>one<script>never <closed", "one"),
}


@pytest.fixture(scope="module")
def model(spark):
    rows = [(k, f"http://h{k}.example.com/{k}", page(b)) for k, (b, _) in {**BODIES, **MORE}.items()]
    return html_extract.fit(spark.createDataFrame(rows, "page_id long, url string, html string"))


@pytest.mark.parametrize("k", sorted({**BODIES, **MORE}))
def test_text_is_whole(model, k):
    body, want = {**BODIES, **MORE}[k]
    assert html_extract.main_text(page(body), model) == want
