"""Main text of pages whose parts are known, and the parser on broken markup."""

import random
import time

import pytest

from turfspark.llm import catalog, markup, wrapper

SCHEMA = "page_id long, url string, html string, text string, host int"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(999)) for _ in range(n))


def texts(spark, rows, slices=3):
    frame = spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA).repartition(slices)
    found = wrapper.main_text(frame)
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    out = {}
    for r in found.collect():
        assert r.n_chars == len(r.text)
        out.setdefault(r.page_id, []).append(r.text)
    assert sum(map(len, out.values())) == len(rows)
    return out


def test_slots_and_template_without_names(spark, monkeypatch):
    """No tag or name tells the parts: constant nodes go, varying ones stay; trees are aligned in several rounds."""
    monkeypatch.setattr(wrapper, "FAN", 2)
    rng = random.Random(1)
    rows, want = [], {}
    for i in range(60):
        body = [prose(rng, rng.randrange(3, 30)) for _ in range(rng.randrange(1, 6))]
        extra = "<div>Only now: a fair offer</div>" if i % 3 == 0 else ""
        tail = "<section><div>All rights with us</div></section>" if i % 2 else ""
        links = "".join(f'<div><a href="/{k}">{prose(rng, 2)}</a></div>' for k in range(rng.randrange(2)))
        blocks = "".join(f"<p>{b}</p>" for b in body)
        rows.append((i, f"http://one.example/{i}", f"<div>Our &amp; site</div>{extra}<div><h2>{body[0].split()[0]}</h2>{blocks}</div>{links}{tail}"))
        want[i] = [" ".join([body[0].split()[0], *body])]
    assert texts(spark, rows) == want


def test_named_parts_vary(spark):
    """Menus, adverts, forms, comments and notices vary as articles do; a host's third of all pages makes no difference."""
    rng = random.Random(2)
    rows, want = [], {}
    for i in range(200):
        host = "big.example" if i < 70 else f"h{i % 9}.example"
        head, body = prose(rng, 3), [prose(rng, 8) for _ in range(3)]
        rows.append((i, f"https://user@{host.upper()}:80/{i}", (
            f"<!DOCTYPE html><head><title>{prose(rng, 2)}</title><script>if (a<b) {{ '<p>no</p>' }}</script><style>p{{}}</style></head>"
            f"<body class='with-sidebar'><header>{prose(rng, 4)}</header><nav><ul><li><a href=x>{prose(rng, 1)}</a></li></ul></nav>"
            f"<div class='cookie-notice'>{prose(rng, 5)}</div><div id=sidebar><p>{prose(rng, 20)}</p></div><form>{prose(rng, 3)}<input></form>"
            f"<div class='layout header'><article class='post-{i}'><h1>{head}</h1><p>{body[0]}<span class=ad>{prose(rng, 2)}</span>"
            f"<p>{body[1]}<div class='ad'>{prose(rng, 6)}</div><ul><li>{body[2]}</ul><div class='comments'><p>{prose(rng, 9)}</div></article></div>"
            f"<aside>{prose(rng, 9)}</aside><!-- {prose(rng, 3)} --><footer>&copy; {prose(rng, 2)}</footer>"
        )))
        want[i] = [" ".join([head, *body])]
    assert texts(spark, rows, 7) == want


def test_few_pages_copies_and_nulls(spark):
    page = "<nav>menu</nav><article><h1>Title</h1><p>One&nbsp;text&#33; a<b>b</b>c</article>"
    moved = [(20 + k, "http://c.example/", f"<div>{k} extra</div>{page}") for k in range(5)]
    rows = [(1, "http://a.example", page), (2, None, page), (2, "no address", page), (None, None, None), (3, "http://a.example", "")]
    rows += [(10 + k, "http://b.example/", page) for k in range(6)] + moved
    found = texts(spark, rows)
    text = "Title One text! abc"
    assert found[None] == [""] and found[3] == [""]
    assert all(found[k] == [text] * len(found[k]) for k in found if k not in (None, 3))
    assert len(found[2]) == 2
    empty = wrapper.main_text(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns == ["page_id", "url", "text", "n_chars"]


def test_very_long_page_and_many_shapes(spark):
    rng = random.Random(3)
    long = [prose(rng, 5) for _ in range(60_000)]
    rows = [(0, "http://l.example", "<article>" + "".join(f"<p>{x}<h3>{x}</h3>" for x in long) + "</article>")]
    want = {0: [" ".join(f"{x} {x}" for x in long)]}
    for i in range(1, 150):
        inner = prose(rng, 6)
        rows.append((i, "http://l.example", "".join(f"<div class=c{chr(97 + rng.randrange(26))}>" for _ in range(5)) + f"<article><p>{inner}</p></article>"))
        want[i] = [inner]
    assert texts(spark, rows) == want


def blocks(source):
    return [t for _, t, _ in markup.read(source).pieces]


@pytest.mark.parametrize("source, want", [
    ("a<br>b<p>c</p>d", ["a b", "c", "d"]),
    ("<p>a<p>b<b>c</p>d", ["a", "bc", "d"]),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", ["a", "b", "c", "d"]),
    ("<table><tr><td>a<td>b<tr><td>c</div></table>d", ["a", "b", "c", "d"]),
    ("1 < 2 &lt; 3 &amp;lt; &unknown; &#x41;", ["1 < 2 < 3 &lt; &unknown; A"]),
    ("a<!-- x > y -->b<!doctype x>c<![CDATA[d]]>e", ["abce"]),
    ("a<script>'</p>'</SCRIPT >b<style>x", ["ab"]),
    ("<p title='a > b'>c</p><p x=\"d>e</p><p>f</p>", ["c", "e", "f"]),
    ("a <a href=x>b", ["a b"]),
    ("<div>a</p></section>b</div>c", ["a", "b", "c"]),
    ("a<textarea>b</textarea>c<a<b>d", ["ac", "d"]),
    ("", []), ("<", ["<"]), ("<p", []), ("</p>", []), ("&", ["&"]),
])
def test_parser(source, want):
    assert blocks(source) == want


def test_parser_time_is_linear():
    for part in ("<a ", '<a "', "<!--", "<", "&", "<div>", "</p>", "<p>x", "<div>x<span class=ad>", "<b>", "<div><p>", "<div></p>"):
        started = time.time()
        page = markup.read(part * (400_000 // len(part)))
        assert time.time() - started < 10 and len(page.labels) <= 2 * markup.DEEP + 5


def test_alignment_against_all_matchings():
    """Weight of a matching against the best of all order-keeping ones."""
    rng = random.Random(4)

    def tree(n):
        return [[-1, "body", False, None, None, 0, 0, 0]] + [
            [rng.randrange(k), rng.choice(["p", "div", "div class=a", "ul"]), False, h := rng.randrange(3), h, 1, 1, 0] for k in range(1, n)
        ]

    def best(one, other, m):
        below = wrapper._children(one), wrapper._children(other)

        def pair(a, b):
            own = m.alike(a, b)
            return own and own + forest(tuple(below[0][a]), tuple(below[1][b]))

        def forest(left, right):
            if not left or not right:
                return 0
            return max(forest(left[1:], right), forest(left, right[1:]), pair(left[0], right[0]) + forest(left[1:], right[1:]))

        return forest(tuple(below[0][0]), tuple(below[1][0]))

    for _ in range(150):
        one, other = tree(rng.randrange(1, 9)), tree(rng.randrange(1, 9))
        m = wrapper._Matching(one, other)
        assert sum(m.alike(a, b) for b, a in m.pairs.items() if b) == best(one, other, m)
        whole = wrapper.aligned(one, other)
        assert sum(n[5] for n in whole) == sum(n[5] for n in one) + sum(n[5] for n in other)


def test_query(spark, tmp_path):
    rows = [(k, "http://a.example", f"<nav>x{k}</nav><article><p>text {k}</article>") for k in range(5)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = catalog.QUERIES["op11_html_extraction"](spark, str(tmp_path)).collect()
    assert {(r.page_id, r.text) for r in found} == {(k, f"text {k}") for k in range(5)}


def test_very_many_children_are_matched_like_few():
    """A page of 4,900 pairs of children: the one node that moved doesn't hide the others."""

    def page(labels):
        return [[-1, "html", False, None, None, 1, 0, 0], *([0, name, False, None, None, 1, 5, 0] for name in labels)]

    for n in (20, 70, 600):
        moved = wrapper._Matching(page(["p"] * n + ["div"]), page(["div"] + ["p"] * n)).pairs
        assert moved == {0: 0, **{k + 1: k for k in range(1, n + 1)}}
