"""Main text of pages, and maximal conversations."""

import random

import numpy as np

from textquarry.llm.chat_format import maximal_conversations, rendered
from textquarry.llm.html_extraction import main_text, shared
from textquarry.llm.html_lines import page_lines

PAGE = """<html><head><title>T</title></head><body class="has-sidebar"><header>Site</header>
<div id="cookie-notice">We use <b>cookies</b></div><main><article class="post"><h1>Ti&amp;tle</h1>
<p>One<br>two <i>th</i>ree&nbsp; four</p><aside>side</aside><p class="ad">buy<p>Next &lt;b&gt; a < b
</p><ul><li>x<li>y</ul><form><p>mail</p></form><section class="comments"><article class="comment">
bad</article></section><script>if(a<b)"</p>"</script><table><tr><td>c1<td>c2</table></article>
</main><footer>F</footer></body>"""


def test_article_lines():
    lines = [t for _, t in page_lines(PAGE)]
    assert lines == ["Ti&tle", "One two three four", "Next <b> a < b", "x", "y", "c1", "c2"]
    assert page_lines("") == [] and page_lines('<p title="a>b">x<!-- open <p>q') == [(0, "x")]


def test_shared_is_a_longest_common_subsequence():
    draw = random.Random(3)
    for _ in range(300):
        a, b = ([draw.randrange(5) for _ in range(draw.randrange(15))] for _ in "ab")
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = shared(np.array(a, int), np.array(b, int))
        rest = iter(b)
        assert found.sum() == best[-1][-1]
        assert all(any(x == y for y in rest) for x, f in zip(a, found) if f)


def test_pages_without_an_article_lose_what_near_pages_share(spark):
    def page(body):
        return f"<p>Top<p>Menu line<p>{body}<p>Bottom"

    rows = [
        (1, "http://a.example/x/1", page("first")),
        (2, "http://a.example/x/2", page("second")),
        (3, "http://b.example/x/1", page("alone")),
        (4, "http://c.example/1", page("copy")),
        (5, "http://c.example/2", page("copy")),
        (6, None, page("no url")),
        (7, "http://[bad", None),
        (8, "http://a.example/art", "<nav>Menu line</nav><article><p>Top<p>own</article>"),
        (9, "http://d.example/1", ""),
        (9, "http://d.example/1", ""),
        (None, "", "<p>x"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages = pages.selectExpr("*", "1 AS row", "'h' AS host", "'l' AS lines")
    for n in (1, 5):
        found = main_text(pages.repartition(n)).collect()
        assert len(found) == len(rows) and all(r.n_chars == len(r.text) for r in found)
        got = {r.page_id: r.text for r in found}
        whole = page("{}").replace("<p>", "\n").strip()
        assert got[1] == "first" and got[2] == "second"
        assert got[3] == whole.format("alone") and got[6] == whole.format("no url")
        assert got[4] == got[5] == whole.format("copy")
        assert got[8] == "Top\nown" and got[7] == got[9] == "" and got[None] == "x"
    assert main_text(pages.where("false")).count() == 0


def test_articles_lose_what_all_near_pages_share(spark):
    def page(k, *body, top="Site menu"):
        body = "".join(f"<p>{line}</p>" for line in (f"Title {k}", *body))
        return f"<nav><p>{top}</p></nav><article>{body}<p>Read our letter</p></article><p>Bottom"

    rows = [(k, f"http://a.example/{k:03}", page(k, f"one {k}", f"two {k}")) for k in range(30)]
    # Copies of a text are no template, and a host of few pages tells too little.
    rows += [(k, f"http://b.example/{k:03}", page(k, "copy", "more of it")) for k in range(40, 55)]
    rows += [(k, f"http://c.example/{k}", page(k, "own", f"two {k}")) for k in range(60, 70)]
    # Lines that the markup names are aligned too: they are template where they stand loose.
    rows += [(80, "http://d.example/1", page(80)), (81, "http://d.example/2", "Site menu<p>words")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    for n in (1, 7):
        got = {r.page_id: r.text for r in main_text(pages.repartition(n)).collect()}
        assert len(got) == len(rows)
        assert all(got[k] == f"Title {k}\none {k}\ntwo {k}" for k in range(30))
        copied = "copy\nmore of it\nRead our letter"
        assert all(got[k] == f"Title {k}\n{copied}" for k in range(40, 55))
        assert all(got[k] == f"Title {k}\nown\ntwo {k}\nRead our letter" for k in range(60, 70))
        assert got[80] == "Title 80\nRead our letter" and got[81] == "words"


def test_named_lines_stand_beside_the_others():
    lines = page_lines('<p>a <span class="ad">buy <b>x</b></span> b</p><nav>m<p>n</nav>c', True)
    assert lines == [(-1, "buy x"), (0, "a b"), (-1, "m"), (-1, "n"), (0, "c")]


def test_maximal_conversations(spark):
    draw = random.Random(4)
    talks = {}
    for k in range(40):
        text = [f"t{draw.randrange(2)}" for _ in range(draw.randrange(1, 7))]
        talks[k] = [("user" if i % 2 == 0 else "assistant", t) for i, t in enumerate(text)]
    talks[40] = [("user", f"t{i}") for i in range(3000)]  # holds most rows
    talks[41] = talks[40][:2500]
    rows = [(k, i, r, t) for k, turns in talks.items() for i, (r, t) in enumerate(turns)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = turns.selectExpr("*", "'c' AS part", "'c' AS pos", "'c' AS h1")
    want = {}
    for k, own in talks.items():
        longer = any(o[: len(own)] == own and len(o) > len(own) for o in talks.values())
        same = [j for j, o in talks.items() if o == own]
        if not longer and k == min(same):
            want[k] = ("".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in own), len(same))
    found = {}
    for r in maximal_conversations(turns.repartition(6)).orderBy("conv_id", "pos").collect():
        text, _ = found.get(r.conv_id, ("", 0))
        assert r.start == len(text) and r.trained == (r.role == "assistant")
        found[r.conv_id] = (text + r.piece, r.copies)
    assert found == want


def test_awkward_turns(spark):
    rows = [(None, 1, None, None), (None, None, "user", "x"), (1, 1, "user", "a"),
            (1, 1, "user", "a"), (2, 5, "user", "a"), (3, 0, "system", "")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = sorted((r.conv_id or 0, r.pos, r.role) for r in maximal_conversations(turns).collect())
    assert got == [(0, 1, "user"), (0, 2, "user"), (1, 1, "user"), (1, 2, "user"), (3, 1, "system")]
    assert maximal_conversations(turns.where("false")).count() == 0
    piece = turns.limit(1).select(rendered(turns["role"], turns["text"])).columns
    assert len(piece) == 1
