import random
import time

import pytest

from takeline.llm import html_text as H
from takeline.llm import url_filters as U

URLS = [None, "", "nothing", "http://Example.NET/en/x", "https://a.example.net/EN/", "http://net/", "http://net", "x://foo.org/fr/?q", "x://foo.org?fr/", "http://xnet/", "http://blog.adult-x.example.com/en/#a", "http://myadult.example.com/de/1", "http://a.b.example.com/de", "a://b://c.net/q", "http://adult.org/en/"]


def brute(url):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    k = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:k]), rest[k:]
    path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for h, p, v in (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")):
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    if best:
        return host, path, *best
    import re

    parts = [p for p in host.split(".")]
    bad = any(re.search(rf"(^|[.-]){re.escape('-'.join(r.tokens))}([.-]|$)", host) for r in U.WORD_RULES)
    return host, path, None, "block" if bad and parts else "allow"


def test_urls(spark):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(URLS + URLS)], "page_id long, url string")
    rules = U.SITE_RULES + U.WORD_RULES
    for limit in (U.SEND_RULES, 1):
        got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(U.with_parts(df), rules, send_rules=limit).collect()}
        assert got == {i: brute(u) for i, u in enumerate(URLS + URLS)}
    assert U.judge(U.with_parts(df.limit(0)), rules).count() == 0


def test_rules_from_a_table(spark):
    """A table of rules, sent or joined, hot tokens split or not, judges as the tuple does."""
    rng = random.Random(4)
    hosts = ["www.tracker.com", "www.casino.net", "cdn.adult-x.org", "blog.example.com", "www.example.net", "doubleclick.www.com", "malware.example.org"]
    urls = [f"http://{rng.choice(hosts)}/{rng.choice(['', 'en/', 'fr/', 'de/'])}{i}" for i in range(300)] + URLS
    pages = U.with_parts(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).repartition(5)
    rules = U.SITE_RULES + U.WORD_RULES + tuple(U.word_rule(f"bad{i}") for i in range(50)) + (U.word_rule("www", "allow"),)
    table = U.rules_table(spark, rules).repartition(3)
    judged = lambda *a, **k: {r["page_id"]: (r["rule"], r["verdict"]) for r in U.judge(pages, *a, **k).collect()}
    want = judged(rules)
    assert want == judged(table) == judged(table, send_rules=3) == judged(table, send_rules=3, hot_urls=20) == judged(table, send_rules=3, hot_urls=1)
    assert len({v for _, v in want.values()}) == 2 and {r for r, _ in want.values()} >= {None, "net/", "org/fr/"}
    none = spark.createDataFrame([("x", [], "block", 1, None)], U.RULES)
    for send in (10, 0):
        with pytest.raises(Exception, match="no literal token"):
            U.judge(pages, none, send_rules=send).collect()


def test_rarest_token():
    rules = (U.word_rule("ads-track"), U.word_rule("adult"))
    assert set(U.rarest_index(rules, {"ads": 9, "track": 2, "adult": 5})) == {"track", "adult"}


def test_judge_replaces_clashing_columns(spark):
    df = U.with_parts(spark.createDataFrame([(i, u) for i, u in enumerate(URLS)], "page_id long, url string")).selectExpr("*", "1 rule", "2 verdict", "3 best", "4 name", "5 token", "6 regex")
    for limit in (10**6, 1):
        out = U.judge(df, U.SITE_RULES + U.WORD_RULES, send_rules=limit)
        assert len(set(out.columns)) == len(out.columns) and out.where("best = 3 and name = 4 and token = 5 and regex = 6 and verdict in ('allow', 'block')").count() == len(URLS)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="</p><article>x</article>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Menu one</a><li>Menu two</ul></nav><div class="cookie-notice">We use cookies</div>
<article><h1>Head&amp;line</h1><p>First <b>bold</b> para&nbsp;graph with   some\n length to it, indeed a long one.<br>More<p>Short.
<div class=ad>Buy</div><ul><li>Item 1<li>Item 2</ul><form>Sign <input name=q> up</form><blockquote>Quote &lt;x&gt;</blockquote>
<section class="comments"><p>Reader says hi</p></section></article><aside>Side</aside><!-- c --><footer>&copy; F</footer></body></html>"""


def test_html():
    assert H.main_text(PAGE).split("\n") == ["Head&line", "First bold para graph with some length to it, indeed a long one. More", "Short.", "Item 1", "Item 2", "Quote <x>"]
    assert [H.main_text(x) for x in (None, "", "<p></p>", "<nav>a</nav>", "plain")] == ["", "", "", "", "plain"]
    body = "<div><p>" + "</p><p>".join(f"Sentence number {i} is long enough to be content." for i in range(5)) + "</p></div>"
    assert len(H.main_text("<div class=menu>a b</div>" + body).split("\n")) == 5


def test_html_layouts():
    assert H.main_text("<body class='has-sidebar no-ads'><main><header><h1>T</h1></header><p>a b</p><div id=comments><p>x</p></div></main></body>") == "T\na b"
    assert H.main_text("<section class=related><article><p>Teaser</p></article></section><article><p>Long enough main text of the page.</p></article>") == "Long enough main text of the page."
    assert H.main_text("<div role=navigation>x</div><div style='display: none'>y</div><p hidden>z</p><article><table><tr><td>1<td>2</table>tail") == "1\n2\ntail"


def test_html_boilerplate_in_blocks():
    """Boilerplate elements that are no blocks leave nothing in the block around them."""
    assert H.main_text("<article><p>a</p><script>var x=1;</script><style>p{}</style><noscript>on</noscript><p>b</p></article>") == "a\nb"
    assert H.main_text("<article><p>text<button>Share</button>more <span class=ad>Buy <b>now</b></span>of<script>y()</script> it<textarea>t</textarea></p></article>") == "text more of it"
    for tag in ("iframe", "svg", "template", "canvas", "audio", "video", "object", "select"):
        assert H.main_text(f"<article><p>one</p><{tag}>gone</{tag}>two<p>three <{tag}>gone</{tag}></p></article>") == "one\ntwo\nthree"
    assert H.main_text("<div>a <span hidden>x</span><a class=share>s</a>b<i style='display:none'>y</i></div><p>c <span class=ad>open<p>d") == "a b\nc\nd"


LONG = "A long paragraph of the main text that has many words and few tags, number {}, and goes on for quite a while."


def test_html_clusters():
    """Without article and main, a region's short blocks are returned too, between and after the long ones."""
    long = [LONG.format(i) for i in range(4)]
    items = [f"Item {i}" for i in range(20)]
    listed = "<ul>" + "".join(f"<li><a href=x><b>{x}</b></a></li>" for x in items) + "</ul>"
    links = "<div>" + "".join(f"<div><a href=x><b>Link {i}</b></a></div>" for i in range(30)) + "</div>"
    text = f"<div><h2>Head</h2><p>{long[0]}</p><p>{long[1]}</p>{listed}<p>{long[2]}</p><p>{long[3]}</p><div><p>Yes.</p></div><p>No.</p></div>"
    want = ["Head", *long[:2], *items, *long[2:], "Yes.", "No."]
    got = H.main_text(f"<body>{links}{text}{links}</body>").split("\n")
    assert [x for x in got if not x.startswith("Link")] == want and len(got) < len(want) + 10
    assert H.main_text(f"<body><div>{text}</div></body>").split("\n") == want
    flat = "<body>" + "".join(f"<div>{x}</div>" for x in want) + "</body>"
    assert H.main_text(flat).split("\n") == want
    assert H.main_text("<body><div><div>" + "</div></div><div><div>".join([*long, "Short end."]) + "</div></div></body>").split("\n") == [*long, "Short end."]


def test_html_names():
    """Only whole names are boilerplate; a name that hints at it is settled by the ratios."""
    for name in ("id='notice-of-tender'", "class='share-price'", "class='menu-of-the-day'", "class='has-sidebar no-ads'"):
        assert H.main_text(f"<article {name}><p>{LONG}</p><p>Short.</p></article>") == f"{LONG}\nShort."
        assert H.main_text(f"<article><p>{LONG}</p><div {name}><p>{LONG} Again.</p><p>x</p></div></article>") == f"{LONG}\n{LONG} Again.\nx"
    for name in ("class='cookie-banner'", "class='post sidebar-left'", "id=siteFooter", "class='comment'", "class='share-buttons'", "class=ad2"):
        assert H.main_text(f"<article><p>{LONG}</p><div {name}><p>{LONG} Again.</p></div></article>") == LONG
    links = "".join(f"<a href=x><b>{i}</b></a><br><i></i><i></i>" for i in range(9))
    assert H.main_text(f"<article><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p><div class='share-this-story'>{links}</div></article>") == "\n".join([LONG] * 3)
    assert H.main_text(f"<article class='comment'><p>{LONG}</p></article><article class='menu-article'><p>{LONG}!</p></article>") == LONG + "!"


def page(rng, container):
    """A page with blocks of known text in ``container`` and boilerplate among and around them: ``(html, text)``."""
    vocabulary = [f"w{k}" for k in range(50)] + ["&amp;", "&lt;b&gt;", "caf&eacute;"]
    plain = {"&amp;": "&", "&lt;b&gt;": "<b>", "caf&eacute;": "caf\u00e9"}
    def words(n):
        return [rng.choice(vocabulary) for _ in range(n)]
    bad = ["<nav><ul><li><a href=x>{}</a><li>{}</ul></nav>", "<aside><p>{} {}</p></aside>", "<div class='ad-slot'>{}<p>{}</div>", "<form><p>{}<input name=q> {}</form>", "<script>var t='</p> {} {}';</script>", "<style>.a{{}} /* {} {} */</style>", "<section id='comments'><p>{}</p><p>{}</p></section>", "<div role=search>{} {}</div>", "<footer>{} {}</footer>", "<div class='cookie-notice banner'>{}<br>{}</div>", "<!-- {} {} -->"]
    def noise():
        return rng.choice(bad).format(" ".join(words(rng.randrange(1, 40))), " ".join(words(3)))
    blocks, want = [], []
    for _ in range(rng.randrange(1, 15)):
        text = words(rng.choice([1, 2, 5, 30, 80]))
        shown = " ".join(plain.get(w, w) for w in text)
        cut = rng.randrange(len(text))
        inline = rng.choice(["{} {}", "<b>{}</b> {}", "{} <a href='/x'>{}</a>", "{}<br>{}", "{}\n \t{}", "<span class=c>{} </span>{}", "{} <span class=ad>buy now</span> {}"])
        body = inline.format(" ".join(text[:cut]), " ".join(text[cut:]))
        blocks.append(rng.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<ul><li>{}</ul>", "<div>{}</div>", "<blockquote>{}</blockquote>", "<table><tr><td>{}</table>", "<section><div><p>{}</div></section>"]).format(body))
        want.append(shown)
        if rng.random() < 0.4:
            blocks.append(noise())
    top, end = "".join(noise() for _ in range(rng.randrange(4))), "".join(noise() for _ in range(rng.randrange(4)))
    return f"<!DOCTYPE html><html><head><title>T</title></head><body>{top}<{container}>{''.join(blocks)}</{container}>{end}</body></html>", "\n".join(want)


@pytest.mark.parametrize("container", ["article", "main", "div"])
def test_html_generated(container):
    """Pages whose main text is known: it comes back to the character."""
    rng = random.Random(5)
    for _ in range(300):
        html, want = page(rng, container)
        if container == "div":  # boilerplate around it shows that the element is not the page
            html = html.replace("<body>", "<body><nav>Menu</nav>")
        if container != "div" or max(map(len, want.split("\n"))) > 100:
            assert H.main_text(html) == want, html


def test_html_text_outside_regions():
    """Main text beside ``article`` and ``main`` is kept, and cards lose to it."""
    long = [LONG.format(i) for i in range(4)]
    paragraphs = lambda xs: "".join(f"<p>{x}</p>" for x in xs)
    teaser = "<article class='card'><h3>Another story</h3><p>What it is about in a few words.</p></article>"
    assert H.main_text(f"<div>{paragraphs(long[:3])}</div>{teaser}{teaser}") == "\n".join(long[:3])
    assert H.main_text(f"{teaser}<div>{paragraphs(long[:3])}</div>") == "\n".join(long[:3])
    assert H.main_text(f"<main>{paragraphs(long)}</main>{teaser}{teaser}") == "\n".join(long)
    assert H.main_text(f"<main>{paragraphs(long[:1])}</main><div>{paragraphs(long[1:])}<p>End.</p></div>") == "\n".join([*long, "End."])
    assert H.main_text(f"<article>{paragraphs(long[:1])}</article><div>{paragraphs(long[1:])}</div>") == "\n".join(long)
    assert H.main_text(f"<article>{paragraphs(long[:3])}<p>Short.</p></article><div><p>A line of the site.</p></div>") == "\n".join([*long[:3], "Short."])
    index = "".join(f"<article><h2>Post {i}</h2><p>{x}</p></article>" for i, x in enumerate(long))
    assert H.main_text(index).split("\n") == [y for i, x in enumerate(long) for y in (f"Post {i}", x)]


def test_html_page_wide_form():
    """A form around the page is its layout; its controls and labels go.  Other forms go whole."""
    body = f"<nav><a href=x>Menu</a></nav><div><h1>Head</h1><p>{LONG}</p><label>Name</label><select><option>a<option>b</select><input name=q><button>Go</button><p>End.</p></div>"
    want = f"Head\n{LONG}\nEnd."
    assert H.main_text(f"<body><form id=aspnetForm>{body}</form></body>") == want
    assert H.main_text(f"<body><form><p>{LONG}</p><textarea>x</textarea></form></body>") == LONG
    assert H.main_text(f"<body><div><p>{LONG}</p><form><p>{LONG} {LONG}</p><input></form><p>End.</p></div></body>") == f"{LONG}\nEnd."
    assert H.main_text(f"<article><p>{LONG}</p><form><label>Mail</label><p>Send us your mail.</p></form></article>") == LONG


def test_html_comments():
    """Whatever stands beside the word, comments go, unless they hold most of the page's text."""
    said = "".join(f"<div class='user-comment-{i}'><p>{LONG} I say {i}</p></div>" for i in range(2))
    for name in ("blog-comments", "comments-of-readers", "post-replies", "my-disqus-thread"):
        assert H.main_text(f"<article><p>{LONG}</p><p>{LONG}!</p><p>{LONG}?</p><section class='{name}'>{said}</section></article>") == f"{LONG}\n{LONG}!\n{LONG}?"
        assert H.main_text(f"<div><div><p>{LONG}</p><p>{LONG}!</p><p>{LONG}?</p></div><div id='{name}'>{said}</div></div>") == f"{LONG}\n{LONG}!\n{LONG}?"
    assert H.main_text(f"<article><p>{LONG}</p><p>{LONG}!</p><p>{LONG}?</p><ol>{said}</ol></article>") == f"{LONG}\n{LONG}!\n{LONG}?"
    assert H.main_text(f"<div class='comment-on-the-law'><p>{LONG}</p><p>End.</p></div>") == f"{LONG}\nEnd."


@pytest.mark.parametrize("end", ["<!-- never closed <p>after</p>", "<!-- x", "<p class='never", "<p", "</", "</p", "<?php echo", "<!DOCTYPE"])
def test_html_unfinished_markup(end):
    """Markup that the page breaks off is no text; a sign that starts none is."""
    assert H.main_text(f"<article><p>{LONG}</p><p>1 < 2 &amp; 3</p>{end}") in (f"{LONG}\n1 < 2 & 3", f"{LONG}\n1 < 2 & 3\n</")
    assert H.main_text("<p>a <") == "a <" and H.main_text("<p>a &lt;b") == "a <b"


def split_page(rng):
    """A page whose text stands in several of ``article``, ``main`` and ``div``, with cards, comments and maybe a form around all: ``(html, text)``."""
    words = lambda n: " ".join(f"w{rng.randrange(60)}" for _ in range(n))
    want, parts = [], []
    for k in range(rng.randrange(2, 5)):
        blocks = [words(rng.randrange(40, 90)) for _ in range(rng.randrange(2, 4))]
        blocks.insert(rng.randrange(1, len(blocks) + 1), words(rng.randrange(1, 4)))
        want += blocks
        tag = rng.choice(["article", "main", "div", "div"]) if k else "div"
        parts.append(f"<{tag}>" + "".join(rng.choice(["<p>{}</p>", "<div>{}</div>", "<blockquote><p>{}</blockquote>"]).format(x) for x in blocks) + f"</{tag}>")
        if rng.random() < 0.5:
            kind = rng.choice(["user-comment-12", "blog-comments", "comment-by-a-reader"])
            parts.append(f"<div class='{kind}'><p>{words(rng.randrange(5, 25))}</p></div>")
    cards = "".join(f"<article class='{rng.choice(['card', 'story-teaser', ''])}'><h3>{words(4)}</h3><p>{words(rng.randrange(4, 10))}</p></article>" for _ in range(rng.randrange(2, 5)))
    parts.insert(rng.choice([0, len(parts)]), rng.choice(["", cards]))
    body = f"<nav><ul><li>{words(2)}<li>{words(2)}</ul></nav>{''.join(parts)}<footer>{words(20)}</footer>"
    if rng.random() < 0.4:
        body = f"<form action=x>{body}<label>{words(2)}</label><button>{words(1)}</button></form>"
    return f"<html><body>{body}</body></html>", "\n".join(want)


def test_html_generated_splits():
    rng = random.Random(11)
    for _ in range(400):
        html, want = split_page(rng)
        assert H.main_text(html) == want, html


@pytest.mark.parametrize("part", ["<font>x<br></i>", "<div>x", "<article>y", "<p>a<b>", "<ul><li>x", "</p></div>z", "<section class='share-it'><i>q", "<article>some words</article>", "<div><div>some words in a line</div></div>", "<form>x", "<p class='a-comment-b'>y"])
def test_html_is_linear(part):
    """A megabyte of broken nesting takes seconds, not hours."""
    html = part * (1_000_000 // len(part))
    start = time.perf_counter()
    H.main_text(html)
    assert time.perf_counter() - start < 10


def test_html_frame(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "clash"), (2, None, None, None), (1, "u", PAGE, "clash")], "page_id long, url string, html string, text string")
    got = H.extract(df).orderBy("page_id").collect()
    assert [r["page_id"] for r in got] == [1, 1, 2] and got[2]["text"] == "" and got[0]["n_chars"] == len(got[0]["text"])
    assert H.extract(df.limit(0)).count() == 0
