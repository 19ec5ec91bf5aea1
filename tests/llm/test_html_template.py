import html
import re
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from pulsegrid.llm import html_template as H

from .test_packing import SF


def plain(page):
    """Main text of the given tables' pages by their known form: headings and paragraphs of the one article."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", x))).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
    return "\n\n".join(x for x in parts if x)


def texts(spark, rows):
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit("h"), "text": F.lit(1), "path": F.lit(None)}).repartition(3)
    got = H.extract_text(df)
    assert got.columns == ["page_id", "url", "text"]
    return {(r.page_id, r.url): r.text for r in got.collect()}


def test_query_against_known_form(spark):
    for sf in (SF, SF.replace("0.001", "0.01")):
        rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
        got = {r.page_id: r for r in H.op11_query(spark, sf).collect()}
        assert len(got) == len(rows)
        for r in rows:
            assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(plain(r.html)) and got[r.page_id].url == r.url


def brute_classes(pages):
    """Equivalence classes with whole occurrence vectors in place of sums and marks: how many classes there are of each size."""
    vectors = defaultdict(lambda: [0] * len(pages))
    for i, page in enumerate(pages):
        paths, blocks = H.parse(page)
        for path, n in {**paths, "": 1}.items():
            vectors[path, None][i] = n
        for (path, text), n in Counter((b.path, b.text) for b in blocks).items():
            vectors[path, text][i] = n
    element = {p: v for (p, t), v in vectors.items() if t is None and 2 * sum(n > 0 for n in v) >= len(pages)}
    up = lambda p: [p[:i] for i in range(len(p), -1, -1) if i == len(p) or p[i : i + 1] == "/"]
    slot = lambda p, v: next((a for a in up(p) if a in element and element[a] != v), None)
    out = Counter()
    for (path, text), v in vectors.items():
        if text is None and path in element:
            out[slot(path, v), tuple(v)] += 1
        elif text is not None and 0 not in v:
            host = next((a for a in up(path) if element.get(a) == v), None)
            out[path if host is None else slot(host, v), tuple(v)] += 1
    return Counter(out.values())


def site(n, notice="Sign up for our letter now", articles=True, menu=3):
    """Pages of one host: menu, advert, notice inside the article, comments, footer; each with its own paragraphs."""
    out = []
    for i in range(n):
        own = "".join(f"<p>Paragraph {i} {j} of this story, with words of its own {i * 31 + j}." for j in range(2 + i % 3))
        body = f"<h2>Story {i}</h2>{own}<p>{notice}</p><ul class=tags><li>tag {i}<li>tag {i + 1}</ul>"
        inner = f"<article>{body}</article>" if articles else f"<div class=story>{body}</div>"
        links = "".join(f'<li><a href="/{k}">Menu {i} {k}</a></li>' for k in range(menu))
        out.append(
            f'<html><head><title>Story {i}</title></head><body class="has-sidebar"><header><h1>Site</h1></header><ul class="main-menu">{links}</ul>'
            f'<div class="ad-box">Buy {i}</div><div id="cookie-notice">We use cookies {i}</div><div class="wrap with-sidebar">{inner}'
            f'<section id="comments"><article class="comment"><p>Reader {i} says a lot of things that are longer than the story itself, on and on.</p></article></section></div>'
            f"<aside><p>Elsewhere {i}</p></aside><form><label>Mail</label><input></form><footer>&copy; {i}</footer><script>var x = '<p>no</p>';</script></body></html>"
        )
    return out


def story(i, notice=None):
    return "\n\n".join([f"Story {i}", *(f"Paragraph {i} {j} of this story, with words of its own {i * 31 + j}." for j in range(2 + i % 3)), *([notice] if notice else []), f"tag {i}", f"tag {i + 1}"])


def test_template_text_goes_and_slots_stay(spark):
    for articles in (True, False):
        rows = [(i, f"https://a.example/{i}", p) for i, p in enumerate(site(8, articles=articles))]
        rows += [(100 + i, f"https://few.example/{i}", p) for i, p in enumerate(site(2, articles=articles))]  # too few pages to tell
        got = texts(spark, rows)
        for i in range(8):
            assert got[i, f"https://a.example/{i}"] == story(i)
        for i in range(2):
            assert got[100 + i, f"https://few.example/{i}"] == story(i, "Sign up for our letter now")


def test_copies_on_one_host_keep_their_text(spark):
    page = site(1)[0]
    near = page.replace("Story 0", "Story zero")
    rows = [(i, "http://copies.example/a", page if i % 2 else near) for i in range(40)]
    got = H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    for r in got.collect():
        assert r.text == story(0, "Sign up for our letter now").replace("Story 0", "Story 0" if r.page_id % 2 else "Story zero")


def test_vectors_in_spark_are_those_of_whole_tables(spark):
    pages = site(9) + site(4, articles=False)
    rows = [(i, "http://x.example/", p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    tokens = df.mapInArrow(H._role_batches, H._ROLE_SQL).groupBy("role", "path", "is_text").agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"), F.bit_xor("mark").alias("mark"), F.sum("mass").alias("mass"))
    roles = [H.Role(**r.asDict()) for r in tokens.collect()]
    got = Counter(len(m) for _, m in H.nested_classes(roles, len(pages)))
    assert got == brute_classes(pages)
    assert H.deduce(roles, len(pages)).content.endswith("/article")


def test_defined_cases(spark):
    rows = [
        (1, "http://a.example/", None), (2, "http://b.example/", ""), (3, None, "<p>no host"), (3, None, "<p>no host"), (None, "http://[bad", "<p>x &amp; y</p>"),
        (4, "http://c.example/", "<div>" * 5000 + "deep"), (5, "http://d.example/", "<p>" + "long word " * 50_000), (6, "http://e.example/", "<nav>only menu</nav>"),
        (7, "http://f.example/", "<p>cut in the <b midd"), (8, "http://g.example/", "a < b > c <!-- never closed"), (9, "http://h.example/", "<script>never closed <p>x"),
    ]
    got = texts(spark, rows)
    assert got == {
        (1, "http://a.example/"): "", (2, "http://b.example/"): "", (3, None): "no host", (None, "http://[bad"): "x & y", (4, "http://c.example/"): "deep",
        (5, "http://d.example/"): ("long word " * 50_000).strip(), (6, "http://e.example/"): "", (7, "http://f.example/"): "cut in the", (8, "http://g.example/"): "a < b > c", (9, "http://h.example/"): "",
    }
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert H.extract_text(none).count() == 0


def test_blocks_of_broken_markup():
    one = lambda p: H.extract(p, None)
    assert one("<body><div id=top>Menu <a href=x>a</a></div><table><tr><td><p>First paragraph, long enough.<p>Second one,\n\there.</table>") == "First paragraph, long enough.\n\nSecond one, here."
    assert one('<main><h1>A<h2>B</h1>c<br>d<b>e</b>&nbsp;f<a title="<p>">g</a></main>') == "A\n\nB\n\nc de fg"
    assert one("<article><header><h1>T</h1></header><p>x<footer>f</footer><div hidden>h</div><div class=share>s</div></article>") == "T\n\nx"
