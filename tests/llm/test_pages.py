"""HTML extraction and revisits on hosts and urls of many kinds, with a literal version of the template."""

from __future__ import annotations

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from flowlens.llm import html_text, queries, warc

from .test_operators import SF_DIR, extracted


def shared(k: int) -> str:
    return f"<html><body><article><p>own line {k}</p><p>{'one long shared paragraph ' * 20}</p></article></body></html>"


@pytest.mark.parametrize("n", [2, 9, 10, 2000])
def test_a_page_gives_the_same_text_on_a_host_of_any_size(spark, n):
    notice = [("http://h.com/x", f"<body><div class='article'><p>{'text of page ' * 9} {k}</p><p>Read our terms.</p></div></body>") for k in range(n)]
    got = extracted(spark, [("http://a.com/x", shared(k)) for k in range(n)] + notice)
    assert got[0] == "own line 0\n\n" + ("one long shared paragraph " * 20).strip()
    assert got[n] == ("text of page " * 9 + " 0").replace("  ", " ")


def test_a_layout_of_two_pages_stays_one_as_its_host_grows(spark):
    odd = [("http://a.com/o", f"<body><div id='main'><p>odd page {k} has this text</p></div><div id='foot'><p>foot</p></div></body>") for k in range(2)]
    for n in (0, 30, 2500):
        others = [("http://a.com/p", f"<body><section><p>page {k}</p></section></body>") for k in range(n)]
        assert extracted(spark, odd + others)[:2] == [f"odd page {k} has this text" for k in range(2)]


@pytest.mark.parametrize("depth", [0, 1, 3, 5, 40])
def test_links_however_deep(depth):
    page = html_text.Page(f"<div><a href='/x'>{'<span>' * depth}twelve chars{'</span>' * depth}</a><p>rest</p></div>")
    assert [(text, linked) for _, text, linked, _ in page.blocks] == [("twelve chars", 12), ("rest", 0)]
    assert [b[2] for b in html_text.Page("<p><a name=top>an anchor").blocks] == [0]


def literal_texts(rows):
    """All pages' texts from each host's occurrence vectors, as sets of pages."""
    by_host = defaultdict(list)
    for page_id, host, html in rows:
        by_host[host].append((page_id, html, html_text.Page(html)))
    for pages in by_host.values():
        whole = [(i, html, p) for i, html, p in pages if len(p.ids) > 1]
        on, once, texts_of = defaultdict(list), defaultdict(int), defaultdict(set)
        up, chars, links, marked, framed = {}, defaultdict(int), defaultdict(int), set(), defaultdict(list)
        for _, html, p in whole:
            own = defaultdict(list)
            for node, text, linked, _ in p.blocks:
                chars[p.ids[node]] += len(text)
                links[p.ids[node]] += linked
                own[node].append(text)
            for node, n in enumerate(p.counts):
                token = p.ids[node]
                on[token].append(html)
                once[token] += n == 1
                texts_of[token].add("\n".join(own[node]))
                up[token] = p.ids[p.up[node]]
                if node in p.marked:
                    marked.add(token)
            frames = p.frames()
            for frame, text in {(p.ids[frames[node]], html_text._text_key(p.ids[node], text)) for node, text, *_ in p.blocks}:
                framed[frame, text].append(html)
        several = len({html for _, html, _ in whole}) > 1
        supported = {t for t, pages_of in on.items() if not several or len(set(pages_of)) > 1}
        slots = {t for t in supported if once[t] * 2 > len(on[t])}
        sums = defaultdict(lambda: [0, 0, True])
        for token in on:
            if chars[token]:
                slot = token
                while slot not in slots and slot != 0:
                    slot = up[slot]
                varies = len(set(on[token])) > 1 and len(texts_of[token]) == 1
                sums[slot] = [sums[slot][0] + chars[token], sums[slot][1] + links[token], sums[slot][2] and varies]
        template = html_text.Template(None)
        template.slots = {t: not fixed and c > 2 * l for t, (c, l, fixed) in sums.items()}
        template.confirmed = marked & supported if several else None
        template.texts = {text for (frame, text), pages_of in framed.items() if len(set(pages_of)) > 1 and len(set(on[frame])) > 1 and len(pages_of) * 10 >= len(on[frame]) * 9}
        for page_id, _, p in pages:
            yield page_id, html_text.main_text(p, template)


def odd_pages():
    body = lambda k, x: f"<body><nav><a href=/>menu</a></nav><div class=c{k % 3}><p>{x}</p><div class=comment><p>said {k}</p></div><p>same end</p></div><footer>foot</footer></body>"
    rows = [(f"http://{host}.org/{k}", body(k, f"page {k} of {host} " * (k + 1))) for host in "ab" for k in range(7)]
    return rows + [("http://a.org/", None), (None, body(1, "no url")), ("http://a.org/e", ""), ("no host", "just text"), rows[3], rows[3]]


def test_texts_of_all_pages_against_a_literal_template(spark):
    table = queries.table(spark, SF_DIR, "pages").select("page_id", "url", "html")
    more = spark.createDataFrame([(100_000 + k, *x) for k, x in enumerate(odd_pages())], "page_id long, url string, html string")
    pages = table.unionByName(more)
    want = dict(literal_texts(pages.select("page_id", html_text.host_of(F.col("url")), "html").collect()))
    got = {r["page_id"]: r["text"] for r in html_text.extract(pages).collect()}
    assert got == want and sum(map(bool, want.values())) > 50


def test_templates_that_travel_to_their_pages(spark, monkeypatch):
    pages = spark.createDataFrame([(k, *x) for k, x in enumerate(odd_pages())], "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("salt", F.lit(1))
    want = sorted(map(repr, map(tuple, html_text.extract(pages).collect())))
    monkeypatch.setattr(html_text, "SENT_BYTES", -1)
    for hot in (1000, 1, 2):
        monkeypatch.setattr(html_text, "HOT", hot)
        assert sorted(map(repr, map(tuple, html_text.extract(pages).collect()))) == want
    assert html_text.extract(pages.limit(0)).count() == 0


def test_each_outcome_of_a_revisit_has_rows(spark):
    found = queries.op7_warc_revisits(spark, SF_DIR).groupBy("outcome").agg(F.count("*").alias("n"), F.count_if(F.floor(F.col("record_id") / 3) != F.floor(F.col("response_id") / 3)).alias("other")).collect()
    assert {r["outcome"] for r in found} == {"resolved", "validators differ", "no earlier response"}
    assert all(r["other"] > 0 for r in found if r["outcome"] != "no earlier response")  # another capture of the address


def test_urls_that_cannot_be_parsed_meet_their_equals_only(spark):
    urls = ["foo", " foo\n", "bar/baz", "mailto:x@y", "//a.com/x", "h2c+x://k.com/p", "a.com/q?z=1", "b.com/q?z=1", "http:///p", "http://foo", "HTTPS://WWW.Foo:443/#x", "http://foo:/", "ftp://foo", "", "?z=1", "http://a.com/p?b=2&a=1&utm_x=3#f", "https://www.a.com:443/p//?a=1&b=2", None]
    rows = [(k, u, 10, 200, {"etag": "x"}) for k, u in enumerate(urls)] + [(100 + k, u, 20, 304, {"etag": "x"}) for k, u in enumerate(urls)]
    table = spark.createDataFrame(rows, "record_id long, url string, ts long, status int, headers map<string,string>")
    got = {r["record_id"] - 100: (r["outcome"], r["response_id"]) for r in warc.resolve_revisits(table).collect()}
    same = {0: 1, 1: 1, 9: 11, 10: 11, 11: 11, 15: 16, 16: 16}
    assert got == {k: ("no earlier response", None) if u is None else ("resolved", same.get(k, k)) for k, u in enumerate(urls)}
