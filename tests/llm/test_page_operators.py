"""The operators on pages against brute force on small tables."""

import hashlib
import io
import random

import duckdb
import pytest

from roadpoints.llm import html_extract, url_filter, warc


def page(body):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style></head><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav>{body}<footer>&copy; foot</footer></body></html>"


BODIES = {
    1: ("<article><h1>Head &amp; line</h1><p>One\n  two<br>three</p><p><b>bold <i>in</i>ner<p>last</article>", "Head & line One two three bold inner last"),
    2: ("<div class=\"ad\">buy</div><article><p>text one<div class=ad>buy</div><section id=comments><article class=comment><p>reader says</article></section><p>text two<script>x('</p>')</script></article>", "text one text two"),
    3: ("<main><div><h2>T</h2><p>Hello <a href=x>link</a> world.</p><aside>side</aside><ul><li>one<li>two</ul><form><input>Search<button>Go</button></form></div></main>", "T Hello link world. one two"),
    4: ("<article><p>cut &am", "cut &am"),
    5: ("<article><p>a &lt;b&gt; &#233;&#x4e2d; &quot;q&quot;</p><!-- <p>no</p> --><p hidden>gone</p><p>1 &lt; 2</p></article>", 'a <b> é中 "q" 1 < 2'),
    6: ("<article></article>", ""),
    7: ("<main><h2>List</h2><ul>" + "<li>item" * 40 + "</ul><table><tr><td>a<td>b</table></main>", "List" + " item" * 40 + " a b"),
}


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(k, f"http://h{k}.example.com/{k}", page(b)) for k, (b, _) in BODIES.items()]
    rows += [(50, None, None), (51, "http://e.example.com", ""), (52, "x", "plain text only"), (53, "x", "<<<>>> </ <a"), (54, "x", "<article><p>" + "long word " * 30000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_main_text(spark, pages):
    model = html_extract.fit(pages)
    got = {r["page_id"]: r["text"] for r in html_extract.extract(pages.selectExpr("*", "1 as text", "2 as n"), model).collect()}
    for k, (_, want) in BODIES.items():
        assert got[k] == want
    assert got[50] == got[51] == "" and got[52] == "plain text only" and got[54] == ("long word " * 30000).strip()


def test_marginals_are_exact(pages):
    """Sum-product on a tree equals the sum over all labellings."""
    import itertools
    import math
    model = html_extract.Model({"article:tag=p|1": 5, "article:tag=p|0": 2, "top:tag=p|0": 3, "top:tag=div|0": 4, "edge=plain,0|0": 9, "edge=plain,0|1": 1, "edge=plain,1|1": 6, "edge=plain,1|0": 2})
    nodes, _ = html_extract.parse("<div><p>aa<p>b</div><article><p>ccc</article><ul><li>x</ul>")
    zero = (0.0, 0.0)
    weight = [0.0] * len(nodes)
    total = 0.0
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        s = sum(model.unary.get(f, zero)[labels[k]] for k, n in enumerate(nodes) for f in html_extract.features(n))
        s += sum(model.unary.get(f"edge={n.kind},{labels[n.parent]}", zero)[labels[k]] for k, n in enumerate(nodes) if n.parent >= 0)
        total += math.exp(s)
        for k, y in enumerate(labels):
            weight[k] += y * math.exp(s)
    assert all(abs(a - b / total) < 1e-9 for a, b in zip(model.marginals(nodes), weight))


def test_held_out_pages(spark):
    """Fitted on one part of the labelled pages, the labels of the others are found."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = html_extract.fit(df.where("page_id % 2 = 0"))
    right = all_ = 0
    for r in df.where("page_id % 2 = 1").collect():
        nodes, _ = html_extract.parse(r["html"])
        labels = html_extract.labelled(nodes)
        right += sum((p > 0.5) == y for p, y in zip(model.marginals(nodes), labels))
        all_ += len(labels)
    assert right == all_ > 1000


def test_empty_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html_extract.extract(none, html_extract.fit(none)).collect() == []
    assert url_filter.judge(none, url_filter.listed_urls(none)).collect() == []
    assert warc.archive(none).collect() == []


URLS = ["http://a.org/x", "https://Example.ORG/es/1", "http://x.example.org/en/12", "http://x.example.org/en/2", "http://notexample.org/es/", "http://a.com/fr/", "http://a.com/fr", "http://a.com/de/x?y#z", "http://com/de/",
        "http://spam-a.net/1.html", "http://www.spam-a.net/1", "http://spam-a.net/1/?q", "http://b.net?x/de/", "http://b.net#://c", "no url", "", None, "a://b://c/de/", "http://spam.org/es/", "http://org", "http:///x", "HTTP://B.NET/x\ny"]


def test_url_rules(spark):
    rows = [(k, u) for k, u in enumerate(URLS)] + [(0, URLS[0])]
    df = spark.createDataFrame(rows, "page_id long, url string").selectExpr("*", "1 as host", "2 as rule", "3 as filter")
    got = sorted((tuple(r[c] for c in ("page_id", "host", "path", "rule", "verdict")) for r in url_filter.judge(df, url_filter.listed_urls(df)).collect()), key=str)
    want = []
    for k, u in rows:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.index(c) for c in "/?#" if c in rest] + [len(rest)])
            host, path = rest[:cut].lower(), rest[cut:]
            path = path[:min([path.index(c) for c in "?#" if c in path] + [len(path)])]
        fits = [(len(r), r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        rule, verdict = max(fits)[1:] if fits else (None, "block" if any(w in host for w in url_filter.LISTED_WORDS) else "allow")
        want.append((k, host, path, rule, verdict))
    assert got == sorted(want, key=str)


def test_bloom_filter_never_misses(spark):
    """False positives go on to the join and are removed there; a listed URL always passes."""
    listed = spark.createDataFrame([(f"a{k}.example.net/{k}",) for k in range(3000)] + [(None,)], "url string")
    pages = spark.createDataFrame([(k, f"http://a{k}.example.net/{k}") for k in range(6000)], "page_id long, url string")
    got = {r["page_id"] for r in url_filter.judge(pages, listed).where("listed").collect()}
    assert got == set(range(3000))


def test_url_filter_sql(spark):
    con = duckdb.connect()
    con.execute("create view pages as select * from '/root/testdata/sf0.001/pages.parquet'")
    cur = con.execute(url_filter.SQL)
    cols = [d[0] for d in cur.description]
    want = sorted(map(str, (tuple(r) for r in cur.fetchall())))
    assert sorted(str(tuple(r[c] for c in cols)) for r in url_filter.op8(spark, "/root/testdata/sf0.001").collect()) == want


def test_warc(spark):
    big, other = "<p>" + "same é " * 400, "<p>" + "else " * 400
    rows = [(1, "http://www.b.example.com/z", big), (2, "http://a.example.com/y?q", big), (3, "http://a.example.com/y", "small"), (4, "http://c.example.com/", "small"), (5, None, None), (6, "http://a.example.com/y", big),
            (7, "odd \r\nurl: \u20ac", ""), (-3, "http://a.example.com/n", other), (9, "http://a.example.com/y", other), (9, "http://a.example.com/y", other), (10, "x", "a" * 1000), (11, "x", "a" * 1000), (12, "x", "a" * 999), (13, "x", "a" * 999)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as k", "3 as seq")
    got = warc.archive(df.repartition(3)).collect()
    order = [(r["urlkey"].encode(), r["captured"], r["page_id"]) for r in got]
    assert order == sorted(order) and len(got) == len(rows)
    top = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if len(b) >= 1000:
            top[b] = max(top.get(b, i), i)
    want = []
    for i, _, h in rows:
        b = (h or "").encode()
        first = top.get(b, i)
        want.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if first == i else "revisit", None if first == i else first))
    assert sorted((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == sorted(want)


def test_records_round_trip():
    data = warc.record(5, "http://x/", "2020-01-01T00:00:00Z", "é\r\n\r\nx".encode(), None) + warc.record(-2, None, "2020-01-01T00:00:00Z", b"", 5)
    (_, n, head, payload), (offset, _, head2, payload2) = warc.read(io.BytesIO(data))
    assert payload == "é\r\n\r\nx".encode() and offset == n and payload2 == b"" and head2["WARC-Type"] == "revisit"
    assert warc._page(head["WARC-Record-ID"]) == 5 and warc._page(head2["WARC-Record-ID"]) == -2
    with pytest.raises(ValueError):
        list(warc.read(io.BytesIO(data[:-3])))


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(30))) for _ in range(k)]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_warc_of_equal_and_missing_ids(spark):
    """Every row has a record with its own payload, whatever its page_id."""
    x, y = "x" * 1000, "y" * 1000
    rows = [(5, "u", x), (5, "u", y), (9, "u", x), (None, "u", x), (None, "v", "z" * 1000), (None, None, None), (None, "v", "z" * 1000)]
    got = warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    digest = {t: hashlib.sha1(t.encode()).hexdigest() for t in (x, y, "z" * 1000, "")}
    want = [(5, digest[x], "revisit", 9), (5, digest[y], "response", None), (9, digest[x], "response", None), (None, digest[x], "revisit", 9),
            (None, digest["z" * 1000], "response", None), (None, digest[""], "response", None), (None, digest["z" * 1000], "response", None)]
    assert sorted(((r["page_id"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == sorted(want, key=str)
