"""Operator 13: main texts of hand-made pages, of hosts with templates of their own, and of odd tables."""

import random
import re
import time

from tessera.llm.containers import parse
from tessera.llm.main_text import chosen, main_texts, text_of, votes, winners, with_host

PAGES = "page_id long, url string, html string, host string, text int"


def alone(html):
    page = parse(html)
    return text_of(page, chosen(page, ()))


def prose(rng, n=4):
    return [" ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(rng.randrange(15, 40))).capitalize() + "." for _ in range(n)]


def test_article_without_what_surrounds_it():
    body = "<header><h1>Site</h1></header><nav><a href=/>Home</a></nav><div class='cookie-notice'>We use cookies on this site, all of them, always.</div><article><header><h1>Title</h1></header><p>One <b>bo</b>ld &amp; caf&eacute;<br>line.<p>Two\n\t lines&nbsp;here.<div class=ad>Buy now</div><form>Mail <input></form><ul><li>First<li>Second</ul><section class='comments'><p>Great article, thank you so very much.</p></section></article><aside>More</aside><footer>&copy; me</footer>"
    assert alone(f"<html><head><title>T</title><style>p{{}}</style></head><body>{body}</body></html>") == "Title One bold & café line. Two lines here. First Second"


def test_blocks_and_mistakes_in_mark_up():
    assert alone("<p>One<p>Two<div>three</div> four") == "One Two three four"
    assert alone("<div><b><p>in bold</p> still</b> here</div>") == "in bold still here"
    assert alone("<p>a < b & c &lt; d</p>") == "a < b & c < d"
    assert alone("<p title='a > b'>text</p><!-- <p>no</p> --><script>var a = '</p><p>no';</script>") == "text"
    assert alone("<article><p>kept</article></div></p><!-- open") == "kept"
    assert alone("<article><table><tr><td>one<td>two<tr><td>three</table></article>") == "one two three"
    assert alone("plain text &#x41;&#66;") == "plain text AB"
    assert alone("") == alone("<nav><a>x</a></nav>") == alone("<!-- -->") == ""


def test_a_menu_that_nothing_names_and_a_list_of_links_within_an_article():
    menu = "<ul><li><a href=a>One thing</a></li><li><a href=b>Another</a></li><li><a href=c>Third</a></li></ul>"
    text = "A sentence that is long enough to count as prose, with some words more."
    assert alone(f"<body><div>{menu}</div><div><p>{text}</p></div></body>") == text
    assert alone(f"<body>{menu}<p>{text}</p></body>") == text
    assert alone(f"<article><p>{text}</p>{menu}</article>") == f"{text} One thing Another Third"


def template(kind, rng, k):
    title, paragraphs = f"Title {k}", prose(rng)
    inner = f"<h1>{title}</h1>" + "".join(f"<p>{p}</p>" for p in paragraphs)
    menu = "<ul class='top'>" + "".join(f"<li><a href='/{i}'>Link {i} to a page</a></li>" for i in range(6)) + "</ul>"
    comments = "<div class='comment-list'>" + "".join(f"<div class='comment'><p>{p}</p></div>" for p in prose(rng, rng.randrange(0, 12))) + "</div>"
    page = {
        0: f"<body>{menu}<div id='wrap'><div class='story post-{k}'>{inner}</div>{comments}<div class='sidebar'><p>{prose(rng)[0]}</p></div></div><div id='footer'><p>All rights reserved</p></div></body>",
        1: f"<body><header>Site</header><main><section>{inner}</section></main>{comments}<footer>F</footer></body>",
        2: f"<body><table><tr><td>{menu}</td><td>{inner}</td></tr></table><div class='copyright'>C</div></body>",
        3: f"<body><article class='p{k}'>{inner}{comments}</article><aside><p>{prose(rng)[0]}</p></aside></body>",
    }[kind]
    return f"<html><head><title>{title}</title></head>{page}</html>", " ".join([title, *paragraphs])


def test_hosts_with_templates_of_their_own(spark):
    rng, rows, want = random.Random(1), [], {}
    for k in range(160):
        html, want[k] = template(k % 4, rng, k)
        rows.append((k, f"https://User@H{k % 4}.example:80/{k}", html, "clash", 1))
    found = main_texts(spark.createDataFrame(rows, PAGES).repartition(6))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    got = found.collect()
    assert {r["page_id"]: r["text"] for r in got} == want
    assert all(r["n_chars"] == len(r["text"]) for r in got)


def test_consensus_mends_a_page_that_would_choose_wrongly(spark):
    rng = random.Random(2)
    layout = "<body><div class=box><div class=lead>{}</div><div class=extra>{}</div></div></body>"
    rows = [(k, f"http://h.example/{k}", layout.format("".join(f"<p>{p}</p>" for p in prose(rng, 8)), "<a href=x>one of the links</a>"), "", 0) for k in range(30)]
    extra = "<p>" + "A long remark of the site's owner that stands beside one short article. " * 5 + "</p>"
    odd = layout.format("<p>The article is short, but it's one.</p>", extra)
    rows.append((99, "http://h.example/99", odd, "", 0))
    assert "remark" in alone(odd)
    pages = spark.createDataFrame(rows, PAGES)
    assert [r["paths"] for r in winners(votes(with_host(pages))).collect()] == [["body>div.box>div.lead"]]
    assert main_texts(pages).where("page_id = 99").first()["text"] == "The article is short, but it's one."


def test_votes_are_added_up_and_small_shares_lose(spark):
    rows = [("h", "a", 90), ("h", "b", 6), ("h", "c", 4), ("g", "x", 1)]
    got = {r["host"]: r["paths"] for r in winners(spark.createDataFrame(rows, "host string, path string, votes long")).collect()}
    assert got == {"h": ["a", "b"], "g": ["x"]}


def test_odd_tables(spark):
    rows = [(1, None, "<p>No host.</p>", "", 0), (1, None, "<p>No host.</p>", "", 0), (None, "relative/url", None, "", 0), (2, "http://x/", "", "", 0), (3, "http://x/", "<div>" * 5000 + "deep" + "</div>" * 5000, "", 0), (4, "http://x/", "<article>" + "<p>word word word</p>" * 20_000 + "</article>", "", 0)]
    got = {(r["page_id"], r["text"][:20], r["n_chars"]) for r in main_texts(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {(1, "No host.", 8), (None, "", 0), (2, "", 0), (3, "deep", 4), (4, "word word word word w", 299_999)} or (4, "word word word word ", 299_999) in got
    assert main_texts(spark.createDataFrame([], PAGES)).count() == 0


def test_parsing_takes_time_in_proportion():
    for html in ("<div>" * 60_000, "<a href='" * 2_000, "<b><p>" * 20_000, "<ul><li><a>x" * 5_000, "&" * 200_000, "<!-" * 60_000):
        began = time.perf_counter()
        parse(html)
        assert time.perf_counter() - began < 5


def test_nothing_of_a_plain_article_is_lost():
    rng = random.Random(4)
    for k in range(50):
        paragraphs = prose(rng, rng.randrange(1, 30))
        html = "".join(rng.choice(["<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<blockquote>{}</blockquote>", "<ul><li>{}</li></ul>", "<div>{}</div>"]).format(p.replace(" ", "<br>\n", 1)) for p in paragraphs)
        assert re.sub(r"\s+", " ", alone(f"<body><nav>x</nav><article>{html}</article></body>")) == " ".join(paragraphs)
