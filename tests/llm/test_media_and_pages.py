"""Matroska round trips and damage; main text of pages."""

import hashlib
import random
import re
import time
import zlib

import pytest

from framewake.llm import media, wrapper
from framewake.llm.queries import queries

from .helpers import documents, empty


def test_payload_comes_back_whole(spark):
    docs = documents(spark)
    got = media.text_media(docs).collect()
    want = []
    for r in docs.collect():
        raw = (r.text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        want.append((r.doc_id or -1, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert len({r.media_sha256 for r in got if r.payload_sha256 == got[0].payload_sha256}) == 1
    assert media.text_media(empty(spark)).count() == 0


@pytest.mark.parametrize("lacing", [0, 1, 2, 3])
@pytest.mark.parametrize("unknown", [False, True])
def test_all_lacings_and_unknown_sizes(lacing, unknown):
    frames = [bytes([k]) * n for k, n in enumerate([300, 300, 300] if lacing == 2 else [255, 1, 700] if lacing else [77])]
    block = media.vint(3) + (-5).to_bytes(2, "big", signed=True) + bytes([lacing << 1]) + media.laced(frames, lacing)
    group = media.element(media.BLOCK_GROUP, media.element(media.BLOCK, block) + media.number(media.REFERENCE, 1))
    wrap = (lambda i, b: i.to_bytes(4, "big") + b"\x01" + b"\xff" * 7 + b) if unknown else media.element
    cluster = wrap(media.CLUSTER, media.number(media.TIMESTAMP, 1000) + group)
    data = media.element(media.EBML, b"") + wrap(media.SEGMENT, media.element(0xEC, b"void") + cluster + cluster)
    m = media.parse(data)
    assert [data[p[3] : p[3] + p[4]] for p in m.packets] == frames * 2
    assert {p[1] for p in m.packets} == {995_000_000} and {p[0] for p in m.packets} == {3} and not any(p[5] for p in m.packets)
    assert [p[2] for p in m.packets] == [0] * len(frames) + [1] * len(frames)


def test_cues_point_at_clusters():
    data = media.write_audio(bytes(range(256)) * 400)
    m = media.parse(data)
    assert len(m.cues) == len(m.clusters) > 3
    assert all(data[at : at + 4] == b"\x1f\x43\xb6\x75" for _, _, at in m.cues)
    assert [p[1] for p in m.packets] == sorted(p[1] for p in m.packets)


def test_damage_is_an_error_row(spark):
    good = media.write_audio(b"x" * 3000)
    random.seed(4)
    rows = [(0, None), (1, b""), (2, b"text"), (3, good), (4, good[:200])] + [(k, bytes(random.choice(good) if random.random() < 0.05 else b for b in good)) for k in range(5, 60)]
    df = spark.createDataFrame(rows, "kept long, data binary")
    got = media.packet_table(df, "kept", "data").collect()
    assert sum(r.n_bytes for r in got if r.kept == 3) == 3000
    assert all(r.error for r in got if r.kept in (0, 1, 2, 4)) and {r.kept for r in got} >= {0, 1, 2, 3, 4}


PAGE = "<!DOCTYPE html><html><head><title>t{0}</title><script>if(a<b){{'</p>'}}</script></head><body><nav><a href=/>menu {0}</a></nav><div class='ad'>buy {0}</div>{1}<footer>&copy; {0}</footer></body></html>"


def test_blocks_of_the_article():
    body = "<article><h1>Head &amp; line</h1><p><b>one<br>two</b>\n  three<p>four &lt;five&gt;<ul><li>six<li>seven</ul><aside>no</aside><form>no</form><section class=comments>no</section></article>"
    pages = [PAGE.format(k, body.replace("four", f"four{k}")) for k in range(5)]
    assert wrapper.extract(pages)[2] == "Head & line\n\none two three\n\nfour2 <five>\n\nsix\n\nseven"


def test_pages_without_an_article_take_the_varying_part():
    pages = [PAGE.format(k, f"<div id=page><div class=promo>x</div><div class=body><p>text of page {k} that goes on</p><p>more {k} of it</p></div><div>same for all</div></div>") for k in range(6)]
    assert wrapper.extract(pages)[3] == "text of page 3 that goes on\n\nmore 3 of it"


def test_no_part_of_a_split_text_is_lost():
    lead, body = "<div class=lead><p>lead {0} of some length</p></div>", "<div class=body><p>{0} " + "body text that goes on " * 4 + "</p><p>{0} end</p></div>"
    split = f"<div id=content>{lead}{body}</div><div><a href=/x>link {{0}}</a></div><div>same for all</div>"
    for n in (1, 6):
        got = wrapper.extract([PAGE.format(k, split.format(k)) for k in range(n)])[n - 1]
        assert got.startswith(f"lead {n - 1} of some length\n\n{n - 1} body text") and f"{n - 1} end" in got and "link" not in got
    two = "<article><h2>one {0}</h2><p>short {0}</p></article><p>between</p><article><p>{0} " + "long text " * 9 + "</p><article>inner {0}</article></article>"
    got = wrapper.extract([PAGE.format(k, two.format(k)) for k in range(3)])[1]
    assert got == "one 1\n\nshort 1\n\n1 " + ("long text " * 9).strip() + "\n\ninner 1"


def test_template_is_found_beside_other_pages():
    part = "<article>{1}<p>own {0}</p><div class=box><p>Read <b>our</b> terms</p><p>All rights reserved</p></div></article>"
    pages = [PAGE.format(k, part.format(k, "<div class=late>Same line on most</div>" if k else "")) for k in range(12)]
    pages.insert(3, "<html><body><h1>Error 500</h1></body></html>")  # another layout, and a first page that lacks a node
    got = wrapper.extract(pages)
    assert got[5] == "own 4" and got[0] == "own 0" and got[3] == "Error 500"
    twins = [PAGE.format(k, f"<article><p>own {k}</p>{'<h2>the same on two</h2>' if k in (4, 7) else ''}</article>") for k in range(12)]
    assert wrapper.extract(twins)[4] == "own 4\n\nthe same on two"


def test_long_lists_are_aligned_exactly():
    kinds = ["<p>{}</p>", "<h2>{}</h2>", "<ul><li>{}</li></ul>", "<pre>{}</pre>"]
    rows = [kinds[i * i % 7 % 4] for i in range(90)]
    def tree(rows):
        root = wrapper.parse("".join(rows))
        wrapper._sizes(root)
        return root
    a, b = tree(rows), tree(["<table><tr><td>x</td></tr></table>", *rows[:50], "<dl><dt>new</dt></dl>", *rows[50:], "<dl></dl>"])
    assert wrapper.match(a, b, []) == a.size
    c = tree(["<h6>a</h6>", *rows[:50], "<h5>b</h5>", *rows[50:], "<h4>c</h4>"])
    assert wrapper.match(c, b, []) == a.size


def test_equal_pages_count_once_toward_the_bounds(spark):
    body = "<article><p>own {0}</p><div>the same on all</div></article>"
    rows = [(1, "http://a/x", PAGE.format(0, body.format(0)))] * 150 + [(k, f"http://a/{k}", PAGE.format(k, body.format(k))) for k in range(2, 14)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.text for r in wrapper.main_text(df, block_pages=1000).collect()} == {f"own {k}" for k in (0, *range(2, 14))}


def test_simple_tree_matching_is_the_largest_mapping():
    def tree(spec):
        node = wrapper.Node(spec[0])
        node.children = [tree(c) for c in spec[1:]]
        wrapper._sizes(node)
        return node

    def brute(a, b):
        if a.kind != b.kind:
            return 0
        x, y = a.nodes(), b.nodes()
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x)):
            for j in range(len(y)):
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + brute(x[i], y[j]))
        return 1 + best[-1][-1]

    random.seed(6)

    def grow(depth):
        return (random.choice("ab"), *[grow(depth - 1) for _ in range(random.randint(0, 3) if depth else 0)])

    for _ in range(300):
        a, b = tree(("r", *[grow(2) for _ in range(3)])), tree(("r", *[grow(2) for _ in range(3)]))
        pairs = []
        n = wrapper.match(a, b, pairs)
        assert n == len(pairs) == brute(a, b)


def test_odd_markup_never_raises():
    random.seed(7)
    bits = ["<p", ">", "</p>", "<b>", "<br/>", "<div class='a", "'", '"', "&amp", "&#x41;", "&bogus;", "text", "<!--", "-->", "<script>", "</script>", "<td>", "</table>", "<li>", "\x00", "</", "<"]
    pages = ["".join(random.choice(bits) for _ in range(40)) for _ in range(500)]
    assert len(wrapper.extract(pages)) == 500


def test_markup_of_any_depth_and_without_end_is_read(spark):
    for tag in ("div", "span", "b", "ul><li"):
        opened, closed = f"<{tag}>" * 100_000, "".join(f"</{t}>" for t in reversed(tag.split("><"))) * 100_000
        got = wrapper.extract([f"<article><p>first</p>{opened}deep &amp; down{closed}<p>last</p></article>"])[0]
        assert got.split("\n\n") == ["first", "deep & down", "last"]
    steps = "".join(f"<div>{k}" for k in range(2000)) + "".join(f"</div>after {k}" for k in range(2000))
    assert wrapper.extract([steps])[0].split("\n\n") == [str(k) for k in range(2000)] + [f"after {k}" for k in range(2000)]
    began = time.process_time()
    wrapper.extract(["<a b='" * 200_000, '<p title="x>text' * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<!" * 100_000, "<x " * 100_000, "</p><p" * 100_000])
    assert time.process_time() - began < 60


def test_class_words_inside_an_article_drop_no_text():
    kept = ["<div class='ad-hoc'>one {0}</div>", "<div class='menu item'>two {0}</div>", "<span class='share-price'>three {0}</span>", "<section class='notice-period'><p>four {0}</p></section>", "<h2 class=widget>five {0}</h2>", "<p class=related>six {0}</p>", "<p>Read more below</p>"]
    gone = ["<div class='ad'>x {0}</div>", "<div class='ad-banner large'>x {0}</div>", "<section id=comments><p>x {0}</p></section>", "<div class='share-buttons'>x</div>", "<aside>x</aside>", "<form>x</form>"]
    for n in (1, 3, 12):
        # what the classes leave open stands on one page of the block alone
        pages = [PAGE.format(k, "<article><p>own {0}</p>{1}</article>".format(k, "".join(gone).format(k) + ("".join(kept).format(k) if k == 0 else "<p>Read more below</p>"))) for k in range(n)]
        got = wrapper.extract(pages)
        assert got[0] == "own 0\n\none 0\n\ntwo 0\n\nthree 0\n\nfour 0\n\nfive 0\n\nsix 0\n\nRead more below"
        assert got[1:] == [f"own {k}\n\nRead more below" for k in range(1, n)]
    # a region at the same place of all pages is what its class says
    slots = [PAGE.format(k, f"<article><p>own {k}</p><div class='ad zone-x7'>buy {k}</div></article>") for k in range(6)]
    assert wrapper.extract(slots) == [f"own {k}" for k in range(6)]


def test_the_wrapper_decides_where_no_element_names_the_text():
    page = "<html><body><div class=top><p>Daily paper of the town</p></div><div class=mid><div class=x><p>{0} story begins with this {0}</p><p>and goes on {0} for long</p></div><div class=y><p>Ask the editors any time you like</p></div></div></body></html>"
    pages = [page.format(f"w{k}") for k in range(10)]
    block, alone = wrapper.extract(pages), [wrapper.extract([p])[0] for p in pages]
    assert block == [f"w{k} story begins with this w{k}\n\nand goes on w{k} for long" for k in range(10)]
    assert all("Daily paper" in a or "Ask the editors" in a for a in alone) and all(a != b for a, b in zip(alone, block, strict=True))


def test_pages_table(spark):
    df = spark.createDataFrame([(1, "http://a/x", None, "z"), (2, None, "<p>x", "z"), (3, "http://a/x", "", "z"), (None, "not a url", "plain", "z"), (3, "http://a/x", "<p>same", "z"), (3, "http://a/x", "<p>same", "z")], "page_id long, url string, html string, host string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in wrapper.main_text(df).collect())
    assert got == [(0, "plain", 5), (1, "", 0), (2, "x", 1), (3, "", 0), (3, "same", 4), (3, "same", 4)]
    assert wrapper.main_text(df.limit(0)).count() == 0


def test_all_pages_give_their_article(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.page_id: r.text for r in queries()["op10_html_extraction"](spark, sf).collect()}
    import html

    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"</?b>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?p>|</?h1>", article)]
        assert got[r.page_id] == "\n\n".join(p for p in parts if p)
