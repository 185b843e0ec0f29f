"""Pages and licences: shapes of real pages against expected text, graphs and texts against the DuckDB forms."""

import random
import textwrap
from collections import Counter

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import html, licenses, urls

ARTICLE = "<h1>A title of it</h1><p>" + "Some words of the story here. " * 12 + "</p><p>Short.</p><p>" + "More words follow in this one. " * 15 + "</p>"
TEXT = "A title of it\n" + ("Some words of the story here. " * 12).strip() + "\nShort.\n" + ("More words follow in this one. " * 15).strip()
SIDE = "Words beside it. " * 30
SHAPES = {
    "a layout named after its sidebar": '<body><nav><a href=1>x</a></nav><div class="content has-sidebar">{}</div><footer>me</footer>',
    "no comments": '<div id="main" class="no-comments">{}</div>',
    "a name that is half about search": '<div class="search-landing">{}</div><div class="ad">Buy now</div>',
    "an article in a layout named sidebar": '<div class="sidebar-layout"><article>{}</article><div class="sidebar">' + SIDE + "</div></div>",
    "a main element in a widget": '<div class="widget"><main>{}</main></div>',
    "unclosed button": "<article><button class=x>{}</article>",
    "closed button": "<article>{}<button>Share it</button></article>",
    "unclosed title": "<title>Site<article>{}</article>",
    "unclosed title in a head": "<head><title>Site</head><body><article>{}</article>",
    "unclosed script": "<article><script>var x = 1;{}</article>",
    "script with markup": '<article><script>var x="<p>no</p>";</script>{}</article>',
    "style and comments": "<style>p{{x:1}}</style><!-- <p>no</p> --><article>{}</article><!-- open <p>no",
    "comments in articles": '<article>{}</article><section class="comments"><article><p>' + SIDE + "</p></article></section>",
    "comments in the article": '<article>{}<div id="disqus_comments"><p>' + SIDE + "</p></div></article>",
    "no article": '<div><a href=1>Home</a> <a href=2>News</a></div><div>{}</div><div class="cookie-notice">We use cookies to do things.</div><div id=footer>c me</div>',
    "a form around it all": "<form id=f>{}</form>",
    "a form beside it": "<form action=/s><label>Find</label><input name=q></form><main>{}</main><aside><p>" + SIDE + "</p></aside>",
    "roles": '<div role="navigation">' + SIDE + '</div><div role="main">{}</div><div role="complementary">' + SIDE + "</div>",
    "hidden": '<article>{}<p hidden>Not seen.</p><div style="display: none">Nor this one.</div></article>',
    "a value with the word hidden": '<article data-x="a hidden b">{}</article>',
    "an id on the body": '<body class="sidebar-open"><article>{}</article></body>',
    "deep": "<div>" * 20_000 + "<article>{}</article>" + "</div>" * 20_000,
    "deep and named": '<div class="search content">' * 10_000 + "{}",
    "many unclosed selects": "<article>{}</article><aside>" + "<select><option>x" * 5_000,
}


@pytest.mark.parametrize("name", SHAPES)
def test_shapes(name):
    assert html.main_text(SHAPES[name].format(ARTICLE)) == TEXT


def test_pages_without_an_article():
    for page in ("", "<p", "<nav><a href=1>Home</a></nav>", '<div class="ad">Buy this now, it is good.</div>', '<div class="comments"><p>' + SIDE + "</p></div>", "<script>" + SIDE):
        assert html.main_text(page) == ""


def test_html_tables(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert html.extract(none).count() == 0 and urls.judge(none).count() == 0
    long = "<article>" + "<p>" + "word " * 400_000 + "</p></article>"
    rows = spark.createDataFrame([(1, None, long), (1, None, long)], "page_id long, url string, html string").withColumn("n_chars", F.lit("clash"))
    assert [(r["page_id"], r["n_chars"]) for r in html.extract(rows).collect()] == [(1, 5 * 400_000 - 1)] * 2


def _both(spark, rows, schema, name, judge, sql):
    frame = spark.createDataFrame(rows, schema)
    got = Counter(tuple(r) for r in judge(frame).collect())
    with duckdb.connect() as c:
        c.register(name, pd.DataFrame(rows, columns=frame.columns).astype({frame.columns[0]: "Int64"}))
        want = Counter(c.execute(sql).fetchall())
    assert got == want
    return got


def test_urls_over_host_graphs(spark):
    link = lambda hosts: "".join(f'<a href="https://{h}/p">t</a>' for h in hosts)
    rows = [(1, "https://a.org/x", link(["b.org"])), (2, "https://b.org/x", link(["a.org"])), (3, "https://b.org/", link(["evil.net"])), (4, "https://evil.net/fr/2", "")]
    rows += [(10 + i, f"https://c{i}.org/", link([f"c{i + 1}.org" if i < 4 else "evil.net"])) for i in range(5)]
    rng = random.Random(3)
    hosts = [f"h{i}." + rng.choice(["org", "net", "com", "example.com"]) for i in range(30)]
    for i in range(200):
        host = hosts[0] if i % 3 == 0 else rng.choice(hosts)
        rows.append((100 + i, f"https://{host}/" + rng.choice(["es/", "fr/", "en/", "x"]) + str(i), link(rng.sample(hosts, rng.randint(0, 3)))))
    rows += [(None, None, None), (7, "no", link(["evil.net"])), (7, "no", None), (8, "http://", None)]
    got = _both(spark, rows, "page_id long, url string, html string", "pages", urls.judge, urls.duckdb())
    assert {r[4] for r in got if r[3] is None and r[1]} == {"allow", "block"}  # by the walk alone


def test_urls_equal_rules(spark):
    rules = [("allow", "a.org/x"), ("block", "a.org/x"), ("allow", "org/")]
    rows = [(1, "https://a.org/xy", ""), (1, "https://a.org/xy", ""), (2, "https://b.a.org/y", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit(1)).withColumn("verdict", F.lit("clash"))
    assert sorted(tuple(r)[3:] for r in urls.judge(pages, rules).collect()) == [("a.org/x", "block")] * 2 + [("org/", "allow")]


def test_licences_by_version_and_shape(spark):
    said = {}
    for i, x in licenses.SENTENCES:
        said.setdefault(i, []).append(x)
    rows = [
        (1, "x"), (2, None), (3, ""), (4, "Note. This work is licensed under the GNU General Public License, version 2."), (5, "Licensed under the Apache License, Version 1.1."),
        (6, "Licensed under CC BY-NC 2.0."), (7, "\n".join(textwrap.wrap(said["gpl-notice"][1], 50))), (8, "Licensed under CC BY-\nNC 4.0."), (9, said["mit-grant"][0] + "\n" + said["as-is"][0] + "\n" + said["mit-notice-kept"][0]),
        (10, "\n".join(said[i][0] for i in ("mit-grant", "rights", "mit-notice-kept", "as-is"))), (11, "All  rights" + " " * 900 + "reserved"), (11, "All  rights" + " " * 900 + "reserved"), (12, "public  domain. This work is dedicated to the public  domain!"),
        (13, "1. " + said["bsd-use"][0] + "\n  1. " + said["bsd-source"][0] + "\n  2. " + said["bsd-binary"][0]), (14, "word " * 300_000 + "\nAll rights reserved.\n" + "word " * 300_000), (None, "All rights reserved."),
    ]
    got = _both(spark, rows, "doc_id long, text string", "documents", licenses.scan, licenses.duckdb())
    found = {r[0]: r[3] for r in got}
    assert found == {1: "", 2: "", 3: "", 4: "GPL-2.0", 5: "", 6: "", 7: "GPL-3.0", 8: "CC-BY-NC-4.0", 9: "", 10: "MIT,Proprietary", 11: "Proprietary", 12: "CC0-1.0", 13: "BSD-2-Clause", 14: "Proprietary", None: "Proprietary"}
