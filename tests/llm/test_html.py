import random
import time

from factloom.llm import html


def page(title, body, menu="Home"):
    return f'<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/">{menu}</a></li></ul></nav><!-- c --><div class="ad">Buy</div><article><h1>{title}</h1><p><b>{body}<br><p>two &amp; &lt;three&gt;</p><div class="comments"><p>nice</p></div></article><footer>&copy; x</footer></body></html>'


def test_main_text():
    assert html.main_text(page("T", "one\n  more"), set()) == "T\none more\ntwo & <three>"
    assert html.main_text("<p>a<p>b <i>c</i>d", set()) == "a\nb cd"
    assert html.main_text('<header>x</header><div id="cookie-notice">y</div><p title="a>b">z</p><form>q</form>', set()) == "z"
    assert html.main_text("a < b & c <", set()) == "a < b & c <"
    assert html.main_text("<script>never ends", set()) == "" and html.main_text("<p><!-- open", set()) == ""
    assert html.main_text("<article>x<li>1<li>2</article><p>out", set()) == "x\n1\n2"
    assert html.main_text("<div hidden>no</div><p aria-hidden='true'>no</p>yes", set()) == "yes"


def test_long_pages():
    assert html.main_text("<p>" * 50_000 + "x", set()) == "x"
    assert len(html.main_text("<p>word</p>" * 50_000, set())) == 50_000 * 5 - 1


def test_classes_nest():
    laid = html.nested([(1, "outer", 0.0, False), (2, "outer", 10.0, False), (3, "inner", 3.0, False), (4, "inner", 5.0, True)])
    assert {t: d for t, _, d, _ in laid} == {1: 0, 2: 0, 3: 1, 4: 1} and (4, 1, 1, True) in laid


def test_template_text_is_left_out(spark, tmp_path):
    rows = [(i, f"http://a.org/{i}", page(f"Title {i}", f"body {i} Home").replace("<h1>", "<p>Always here</p><h1>")) for i in range(12)]
    rows += [(50, "http://b.org/", page("Lone", "body")), (51, None, None), (52, "odd", ""), (None, "http://b.org/x", "<p>x"), (50, "http://b.org/", page("Lone", "body"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as text", "3 as constants")
    df.write.parquet(f"{tmp_path}/pages.parquet")
    got = html.op4_template_text(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    texts = {r["page_id"]: r["text"] for r in got}
    assert texts[3] == "Title 3\nbody 3 Home\ntwo & <three>" or texts[3] == "Title 3\nbody 3 Home"
    assert texts[50] == "Lone\nbody\ntwo & <three>" and texts[51] == "" and texts[52] == "" and texts[None] == "x"
    assert html.extracted(df.limit(0)).count() == 0


def test_copies_of_a_page_have_one_vote(spark):
    same = page("Copied", "the one body")
    rows = [(i, f"http://c.org/{i}", same) for i in range(12)]
    rows += [(100 + i, f"http://d.org/{i}", same) for i in range(95)] + [(200 + i, f"http://d.org/x{i}", page(f"Other {i}", f"body {i}")) for i in range(8)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    texts = {r["page_id"]: r["text"] for r in html.extracted(df).collect()}
    assert {texts[i] for i in [*range(12), *range(100, 195)]} == {"Copied\nthe one body\ntwo & <three>"}
    seen = html.occurrences(df.selectExpr("split(url, '/')[2] as host", "html")).where("token = -1").collect()
    assert {r["host"]: r["pages"] for r in seen} == {"c.org": 1, "d.org": 9}


def shuffled_pages(seed, n=9):
    r = random.Random(seed)
    out = []
    for i in range(n):
        items = "".join(f"<li>{r.choice('xyz')}" for _ in range(r.randint(0, 4)))
        box = f"<div class=w{r.randrange(2)}><i>box</i><b>{i % 4}</b></div>" if r.random() < 0.6 else ""
        out.append(f"<body><div class=top>Site</div><ul>{items}</ul>{box}<section><p>{r.choice(['same', f'body {i}'])}</p></section><small>end</small></body>")
    return out + out[:3]


def test_classes_against_brute_force(spark):
    for seed in range(3):
        sites = {h: shuffled_pages(10 * seed + k) for k, h in enumerate(("a", "b"))} | {"one": ["<p>x"] * 3}
        df = spark.createDataFrame([(h, p) for h, ps in sites.items() for p in ps], "host string, html string").repartition(3)
        got = {r["host"]: html.unpacked(bytes(r["template"])) for r in html.templates(df).collect()}
        assert set(got) == {"a", "b"}
        for host, template in got.items():
            pages, places = sorted(set(sites[host])), {}
            for k, page in enumerate(pages):
                for at, (path, tag, text, _, _) in enumerate(html.read(page)):
                    if tag is not None or html.tidy(text):
                        places.setdefault(html.node_key(path, tag, text if tag is not None else html.tidy(text)), [[] for _ in pages])[k].append(at)
            mean = {t: sum(map(sum, v)) / sum(map(len, v)) for t, v in places.items()}
            by = {}
            for t, v in places.items():
                by.setdefault(tuple(map(len, v)), []).append(t)
            want = {frozenset(v): sorted(v, key=lambda t: (mean[t], t)) for k, v in by.items() if len(v) > 1 and sum(map(bool, k)) > 1 and sum(map(bool, k)) >= html.SUPPORT * len(pages)}
            classes = {}
            for t, (k, rank, size, _, _) in template.items():
                classes.setdefault(k, {})[rank] = t
                assert 0 <= rank < size
            assert {frozenset(c.values()) for c in classes.values()} == set(want)
            orders = {k: [c[i] for i in range(len(c))] for k, c in classes.items()}
            assert all([mean[t] for t in o] == sorted(mean[t] for t in o) for o in orders.values())

            def inside(k, j):
                """The slot of class j in which class k stands, or None."""
                low, high = mean[orders[k][0]], mean[orders[k][-1]]
                return next((i for i, (a, b) in enumerate(zip(orders[j], orders[j][1:])) if mean[a] < low and high <= mean[b]), None)

            def depth(k):
                return max((depth(j) + 1 for j in orders if j != k and inside(k, j) is not None), default=0)

            for k, o in orders.items():
                _, _, _, outer, slot = template[o[0]]
                assert (outer == -1) == (depth(k) == 0)
                if outer >= 0:
                    assert inside(k, outer) == slot and depth(outer) + 1 == depth(k)
            for page in pages:
                keys = [html.node_key(path, tag, text if tag is not None else html.tidy(text)) for path, tag, text, _, _ in html.read(page)]
                ranks = lambda k: [template[x][1] for x in keys if x in template and template[x][0] == k]
                for k in html.holding(keys, template):
                    assert ranks(k) == list(range(len(orders[k]))) * (len(ranks(k)) // len(orders[k]))
                for k in orders:
                    if template[orders[k][0]][3] == -1 and ranks(k) and ranks(k) == list(range(len(orders[k]))) * (len(ranks(k)) // len(orders[k])):
                        assert k in html.holding(keys, template)


def test_slots_without_marks(spark):
    rows = [(i, f"http://e.org/{i}", f"<div>Our site</div><div><h2>Head {i}</h2><p>text {i} of this page, long enough</div><div>All rights reserved</div>") for i in range(3)]
    lines = [f"line {k} of a text that two pages share" for k in range(9)]
    rows += [(10 + i, f"http://f.org/{i}", "".join(f"<p>{x}" for x in [*lines, f"last {i}"])) for i in range(2)]
    rows += [(20 + i, f"http://g.org/{i}", f"<article><h1>One title</h1><p>same</p><p>other {i}</p></article><div>foot</div>") for i in range(2)]
    texts = {r["page_id"]: r["text"] for r in html.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [texts[i] for i in range(3)] == [f"Head {i}\ntext {i} of this page, long enough" for i in range(3)]
    assert [texts[10 + i] for i in range(2)] == ["\n".join([*lines, f"last {i}"]) for i in range(2)]
    assert [texts[20 + i] for i in range(2)] == [f"One title\nsame\nother {i}" for i in range(2)]


def test_pages_meet_templates_by_a_join_too(spark, monkeypatch):
    rows = [(i, f"http://e.org/{i}", page(f"Title {i}", f"body {i}")) for i in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(tuple, html.extracted(df).collect()))
    monkeypatch.setattr(html, "BROADCAST_TOKENS", 0)
    assert sorted(map(tuple, html.extracted(df).collect())) == want


def test_broken_markup_stays_linear():
    n = 200_000
    for text in ("<a " * n, "<div>" * n + "</x>" * n, "<b>" * n + "<p>" * n, "<i>" * n + "<li></li>" * n, "<!" * n, "<!-- " * n, "<a \"x>y\" " * n + '"', "</" * n, "<" * n, "<a b='" * n, "<title>" * n, "<td>" * n + "</tr>" * n, "<![CDATA[" * n):
        began = time.process_time()
        html.main_text(text, None)
        assert time.process_time() - began < 20, text[:20]
    assert html.main_text('<a "x>y" z', None) == 'y" z' and html.main_text("x <a y", None) == "x <a y" and html.main_text("<p>a</q>b", None) == "ab"
