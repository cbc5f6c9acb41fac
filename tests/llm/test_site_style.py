import math
import random

import pytest

from quillgraph.llm import site_style as style

SCHEMA = "page_id long, url string, html string"


def words(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def site(host, n, seed, container="article"):
    """Pages of one template: marked and unmarked boilerplate around articles of their own. -> rows, wanted texts."""
    rng = random.Random(seed)
    rows, want = [], {}
    adverts = ["Buy one of these today for less", "Our partner sells shoes and hats"]
    for i in range(n):
        paragraphs = [words(rng, rng.randint(5, 60)) for _ in range(rng.randint(1, 6))]
        body = f"<h1>{words(rng, 4)}</h1>"
        want[i] = body[4:-5] + " " + " ".join(paragraphs)
        body += "".join(f"<p>{p.replace(' ', '  ' + chr(10), 1)}" for p in paragraphs)
        body = f"<{container}>{body}</{container}>"
        html = (
            f"<html><head><title>{words(rng, 3)}</title><script>if (a < b) {{ x('</p>') }}</script></head><body>"
            f"<header><h2>The {host} paper</h2></header><nav><a href='/'>Home</a></nav><div class='top-strip'>Read by many since 1990</div>"
            f"<div class='cookie-notice'>We use cookies {i}</div>{body}<div class=box>{rng.choice(adverts)}</div>"
            f"<section id='comments'><p>{words(rng, 9)}</p></section><div class='fine'>All rights are kept</div><footer>{words(rng, 5)}</footer></body></html>"
        )
        rows.append((i, f"https://{host}/p/{i}", html))
    return rows, want


def texts(spark, rows, schema=SCHEMA):
    got = style.site_texts(spark.createDataFrame(rows, schema))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    return {r.page_id: r.text for r in got.collect() if r.n_chars == len(r.text)}


def test_templates_go_and_articles_stay(spark):
    rows, want = site("news.example.org", 60, 1)
    assert texts(spark, rows) == want
    # no article element: only the tree can tell what repeats
    rows, want = site("plain.example.org", 60, 2, container="div")
    assert texts(spark, rows) == want


def test_few_pages_and_copies_lose_nothing(spark):
    rows, want = site("small.example.org", 3, 3)
    rows += [(100 + i, u.replace("small", "copies"), h) for i, (_, u, h) in enumerate(rows[:1] * 40)]
    got = texts(spark, rows)
    assert {i: got[i] for i in want} == want and all(got[100 + i] == want[0] for i in range(40))
    # a third of a site are copies of one article, and near copies of another
    rows, want = site("third.example.org", 60, 4)
    rows += [(100 + i, rows[0][1], rows[0][2]) for i in range(20)] + [(200 + i, rows[1][1], rows[1][2].replace("</h1>", f" x{i}</h1>")) for i in range(25)]
    got = texts(spark, rows)
    assert {i: got[i] for i in want} == want and {got[100 + i] for i in range(20)} == {want[0]} and all(want[1][-30:] in got[200 + i] for i in range(25))


def brute_removals(pages):
    """The tree's figures by plain loops."""
    sites = {}
    for site_, html in pages:
        page = style.parse(html)
        key = tuple(dict.fromkeys((b.path, b.text) for b in page.blocks))
        sites.setdefault(site_, {})[key] = page
    out = {}
    for site_, found in sites.items():
        on, texts_, orders, inside = {}, {}, {}, set()
        for page in found.values():
            for path in {b.path[:i] for b in page.blocks for i in range(1, len(b.path) + 1)}:
                on[path] = on.get(path, 0) + 1
            for key in {(b.path, b.text) for b in page.blocks}:
                texts_[key] = texts_.get(key, 0) + 1
            for key in {o for o in page.orders}:
                orders[key] = orders.get(key, 0) + 1
            inside |= {b.path[:i] for b in page.blocks if b.inside for i in range(1, len(b.path) + 1)}
        entropy = {k: math.log(c) / math.log(max(on[k[0]], style.LEAST_PAGES)) for k, c in texts_.items()}
        gone = set()
        for path, m in on.items():
            if m < style.LEAST_PAGES:
                continue
            below = [(len(t) * c, entropy[p, t]) for (p, t), c in texts_.items() if p[: len(path)] == path]
            content = 1 - sum(w * e for w, e in below) / sum(w for w, _ in below)
            shapes = [c / m for (p, _), c in orders.items() if p == path]
            presented = -sum(x * math.log(x) for x in shapes) / math.log(m) + (math.log(m) * (1 - sum(shapes)) / math.log(m) if shapes else 0)
            if path not in inside and content * (style.PRESENTATION * presented * bool(shapes) + 1 - style.PRESENTATION) <= style.LOW:
                gone.add((path, None))
            for (p, t), e in entropy.items():
                if p == path and 1 - e <= (style.LOW_INSIDE if path in inside else style.LOW_TEXT) and texts_[p, t] > 1:
                    gone.add((p, t))
        if gone:
            out[site_] = {(style._path_number(p), 0 if t is None else style._number(t)) for p, t in gone}
    return out


def test_tree_against_plain_loops(spark):
    pages = []
    for n, host, container in ((30, "a.example", "article"), (12, "b.example", "div"), (5, "c.example", "div")):
        pages += [(host, h) for _, _, h in site(host, n, n, container)[0]]
    pages += [("b.example", h) for _, h in pages[30:34]]
    got = style.removals(spark.createDataFrame(pages, "host string, html string").repartition(4)).collect()
    got = {r.host: {(x.path, x.feature) for x in r.removed} for r in got}
    assert got == brute_removals(pages) and len(got) == 2


def test_shuffled_removals_give_the_same(spark, monkeypatch):
    rows, want = site("far.example.org", 20, 8, container="div")
    monkeypatch.setattr(style, "BROADCAST_BYTES", -1)
    assert texts(spark, rows) == want


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        ("<p>a<p>b<br>c<b>d</b>e", "a b cde"),
        ("<article><p>1 &lt; 2 &amp;amp; 3&nbsp;&#52;&copy 5 &nosuch; &am</article>", "1 < 2 &amp; 3 4© 5 &nosuch; &am"),
        ("<article>a<!-- <p>no</p> --><p title='x>y'>b</p><p title=\"</p>\">c</article>d", "a b c"),
        ("<article><header><h1>Title</h1><p>By someone</p></header><p>text</p><footer>f</footer></article>", "Title text"),
        ("<main><p>m</p><article>x</article><article class='comment'>no</article></main>", "x"),
        ("<main><p>m</p><aside>no</aside></main><p>out</p>", "m"),
        ("<div class='has-sidebar'><p>kept</p></div><div class='sidebar'><p>gone</p></div>", "kept"),
        ("<div class='siteHeader'>gone</div><div class='page-header'>gone</div><p>kept", "kept"),
        ("<ul><li><a href=/>Home</a><li><a href=/x>More</a></ul><p>some text with <a href=y>one</a> link", "some text with one link"),
        ("<article><p>it's <i>a</i><script>var a='<p>';</script> b</p><style>p{}</style></article", "it's a b"),
        ("<p>x <form>gone<input></form>y<select><option>1<option>2</select><p hidden>z", "x y z"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("<div role=navigation>gone</div><p>a < b and b > c</p></section></b>", "a < b and b > c"),
        ("<article><p>cut off in a ta<a href='x", "cut off in a ta"),
        ("<h1>" + "long " * 40000, ("long " * 40000).strip()),
        ("<div>" * 30000 + "deep" + "<b>" * 30000 + "er", "deeper"),
    ],
)
def test_markup(html, want):
    assert style.main_text(html or "", set()) == want


def test_nulls_repeats_and_further_columns(spark):
    rows = [(1, None, "<p>a"), (1, None, "<p>a"), (None, "no address", None), (2, "", ""), (3, "HTTPS://User@Host.example:80/x?y", "<p>b")]
    got = style.site_texts(spark.createDataFrame([(*r, "h", 1) for r in rows], f"{SCHEMA}, host string, text int"))
    assert sorted((r.page_id or 0, r.text) for r in got.collect()) == [(0, ""), (1, "a"), (1, "a"), (2, ""), (3, "b")]
    assert spark.createDataFrame([(rows[4][1],)], "u string").select(style.host("u").alias("h")).first().h == "host.example"
    assert texts(spark, []) == {}
