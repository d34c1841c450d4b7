"""Main text of hand-made pages, and repeated stretches against a count of all windows."""

import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from aisleframe.llm import extract

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{a:b}</style><script>var t="</p>"</script></head>
<body><header>Logo</header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <p>no</p> --><div class="side-bar ad">Buy</div>
<main id=content><h1>A &amp; B&nbsp;&copy;</h1><p>One
 two<br>three <b>four</b><p>five &lt;b&gt; 3 < 4<aside>Aside</aside><form><label>Name</label><input></form>
<div class='cookie notice'><p>We use cookies</p></div><table><tr><td>x<td>y<tr><td>z</table>
<section class="reader-comments"><article class="comment"><p>First!</p></article></section><p hidden>no</p>
<script type="x">if (a < b) {}</SCRIPT>tail</main><footer>&copy; me</footer>"""


def text_of(page):
    return "\n".join(t for z, t in extract.blocks(page) if z == "main")


def test_blocks_of_a_page():
    assert text_of(PAGE) == "A & B ©\nOne two three four\nfive <b> 3 < 4\nx y\nz\ntail"
    assert text_of("<nav><article><p>a</p></article>") == "a"
    assert text_of("<article><p>a<script>never closed <p>b") == "a"
    assert text_of("<article>a<!-- open") == "a"
    assert text_of("<ARTICLE><P CLASS=x>a</ARTICLE>b") == "a"
    assert extract.blocks("") == [] and extract.blocks("< < >") == [("open", "< < >")]
    assert text_of("<article>" + "<div>" * 20_000 + "x") == "x"


def test_repeated_stretches_equal_a_count_of_windows():
    rng = random.Random(2)
    for _ in range(60):
        pages = [[rng.randrange(4) for _ in range(rng.randrange(0, 30))] for _ in range(8)]
        for p in pages[:5]:
            p[3:3] = [9, 8, 7, 6, 5]
        run, least = rng.choice([(3, 2), (4, 3), (5, 2)])
        seen = {}
        for k, p in enumerate(pages):
            for a in range(len(p) - run + 1):
                seen.setdefault(tuple(p[a : a + run]), set()).add(k)
        want = []
        for p in pages:
            mask = [False] * len(p)
            for a in range(len(p) - run + 1):
                if len(seen[tuple(p[a : a + run])]) >= least:
                    mask[a : a + run] = [True] * run
            want += mask
        flat = np.array([w for p in pages for w in p])
        at = np.repeat(np.arange(8), [len(p) for p in pages])
        assert extract.repeated(flat, at, run, least).tolist() == want


def test_pages_of_any_kind(spark):
    menu = "<div>" + " ".join(f"menu{k}" for k in range(12)) + "</div>"
    rows = [(k, f"http://h.org/{k}", f"<body>{menu}<div>own text {k} here</div></body>", k) for k in range(6)]
    rows += [(10, "http://h.org/a", f"{menu}<article><p>marked</p></article>", 0), (11, None, None, 0),
             (12, "http://h.org/b", "", 0), (None, "x", "<p>" + "long " * 100_000, 0), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text long")
    for shard in (extract.SHARD_TOKENS, 10):
        got = {(r.page_id, r.url): r.text for r in extract.main_text(df, shard).collect()}
        assert len(got) == 10
        assert got[10, "http://h.org/a"] == "marked" and got[11, None] == "" and got[12, "http://h.org/b"] == ""
        assert len(got[None, "x"].split()) == 100_000
        if shard > 10:
            assert all(got[k, f"http://h.org/{k}"] == f"own text {k} here" for k in range(6))
    assert extract.main_text(df.limit(0)).count() == 0


def unmarked(n, parts):
    """Rows of a host whose pages hold their own words and those of ``parts`` with the page's number."""
    out = []
    for k in range(n):
        own = " ".join(f"own{k}x{j}" for j in range(20))
        more = "".join(f"<div>{' '.join(f'{name}{j}' for j in range(12))}</div>" for name, on in parts.items() if on(k))
        out.append((k, f"http://h.org/{k}", f"<body>{more}<div>{own}</div></body>"))
    return out


def test_texts_are_equal_for_every_size_of_the_arrays(spark):
    parts = {"menu": lambda k: True, "some": lambda k: k % 20 == 0, "three": lambda k: k in (5, 50, 95),
             "two": lambda k: k in (6, 60)}
    df = spark.createDataFrame(unmarked(100, parts), "page_id bigint, url string, html string")
    want = {}
    for k in range(100):
        own = " ".join(f"own{k}x{j}" for j in range(20))
        want[k] = (" ".join(f"two{j}" for j in range(12)) + "\n") * (k in (6, 60)) + own
    for shard in (extract.SHARD_TOKENS, 1000, 100, 10):
        assert {r.page_id: r.text for r in extract.main_text(df, shard).collect()} == want, shard


def test_equal_pages_count_once(spark):
    body = "<div>" + " ".join(f"article{j}" for j in range(30)) + "</div>"
    foot = "<footer>" + " ".join(f"foot{j}" for j in range(12)) + "</footer>"
    rows = [(1, "http://h.org/a", body + foot), (1, "http://h.org/a", body + foot), (2, "http://h.org/b", body + foot),
            (3, "http://h.org/c", foot + "<p>one</p>"), (4, "http://h.org/d", foot + "<p>two</p>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    whole = " ".join(f"article{j}" for j in range(30))
    for shard in (extract.SHARD_TOKENS, 10):
        got = sorted((r.page_id, r.text) for r in extract.main_text(df, shard).collect())
        assert got == [(1, whole), (1, whole), (2, whole), (3, "one"), (4, "two")]


def test_the_arrays_alone_on_pages_without_marks(spark):
    """With article marks taken out of the given pages the arrays add no word and lose almost none; what
    marks and class names tell beyond that is counted."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    bare = pages.withColumn("html", F.regexp_replace("html", r"(</?)article\b", "$1div"))
    blind = bare.withColumn("html", F.regexp_replace("html", r'\s(class|id|role)="[^"]*"', ""))
    want, got, worst = ({r.page_id: Counter(r.text.split()) for r in extract.main_text(p).collect()} for p in (pages, bare, blind))
    total = sum(sum(w.values()) for w in want.values())
    lost = sum(sum((want[k] - got[k]).values()) for k in want)
    assert not any(got[k] - want[k] for k in want) and lost <= 0.002 * total
    added = sum(sum((worst[k] - want[k]).values()) for k in want)
    assert 0 < added < 0.05 * total


def test_the_arrays_decide_beside_marked_articles_too(spark):
    """Open blocks of pages with an article: own ones stay in page order, those that pages share go, as do chrome
    and runs that are too short to be judged. Article blocks stay though pages share them."""
    menu, line = (" ".join(f"{w}{j}" for j in range(12)) for w in ("menu", "line"))
    lead = {k: " ".join(f"lead{k}x{j}" for j in range(9)) for k in range(5)}
    rows = [(k, f"http://h.org/{k}", f"<div>{menu}</div><div>{lead[k]}</div><p>short {k}</p><article><p>{line}</p><p>own {k}</p>"
             f"</article><footer>{lead[k]} foot</footer>") for k in range(5)]
    rows.append((9, "http://g.org/", f"<article><p>{line}</p></article>"))
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    for shard in (extract.SHARD_TOKENS, 10):
        got = {r.page_id: r.text for r in extract.main_text(df, shard).collect()}
        assert got == {9: line} | {k: f"{lead[k]}\n{line}\nown {k}" for k in range(5)}
