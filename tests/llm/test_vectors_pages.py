"""Vector searches and page extraction against brute force; queries and pipeline end to end."""

import html
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docassay.llm import covertree, mih, mincut

from .conftest import SF


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(700, 16)).astype(np.float32)
    x[100:200] = x[100]  # a third of a task's rows may be equal
    rows = [(k, v.tolist(), k) for k, v in enumerate(x)]
    rows += [(1000, None, 0), (1050, [], 0), (1100, [None] * 16, 0), (1150, [float("nan")] * 16, 0), (1200, [float("inf")] + [0.0] * 15, 0), (1250, [0.0] * 16, 0), (None, [1.0] * 16, 0), (1300, [1.0, 2.0], 0), (1301, [2.0, 1.0], 0), (50, x[50].tolist(), 0)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, vec_score int").repartition(5)


def clean_rows(df, zero):
    out = []
    for r in df.collect():
        e = r["embedding"]
        if r["vec_id"] is not None and e and all(v is not None and np.isfinite(v) for v in e) and (zero or any(e)):
            out.append((r["vec_id"], np.array(e, dtype=np.float64)))
    return out


def brute(rows, score):
    out = set()
    for q, x in {i: v for i, v in rows}.items():
        if q % 50 == 0:
            near = sorted((-score(x, y), i) for i, y in rows if i != q and len(y) == len(x))[:5]
            out |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(near)}
    return out


def test_exact_top_k(vectors):
    rows = [(i, np.floor(256 * v)) for i, v in clean_rows(vectors, True)]
    got = {tuple(r) for r in covertree.top_k(vectors).collect()}
    # Rows that repeat a vec_id are candidates as often as they occur.
    assert got == brute(rows, lambda x, y: int(x @ y))
    assert covertree.top_k(vectors.limit(0)).count() == 0


def test_a_query_row_repeated_within_a_task(spark):
    x = np.random.default_rng(8).normal(size=(60, 8)).astype(np.float32)
    x[0] *= 10  # the query's own rows have the highest products
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(0, x[0].tolist())] * 6
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").coalesce(1)
    cosine = lambda a, b: float((a * b).sum() / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum())))
    whole = [(i, np.floor(256 * v)) for i, v in clean_rows(df, True)]
    assert {tuple(r) for r in covertree.top_k(df).collect()} == brute(whole, lambda a, b: int(a @ b))
    chunk = pa.table({"vec_id": pa.array([0]), "v": pa.array([x[0].astype(float).tolist()])})
    block = pa.table({"vec_id": pa.array([i for i, _ in rows]), "v": pa.array([v for _, v in rows], pa.list_(pa.float64()))})
    want = {i for q, _, i, _ in brute(clean_rows(df, False), cosine) if q == 0}
    for model in (None, mih.Model(x.astype(float))):  # without codes, and with a ball that must grow beyond the own rows
        (best,) = mih.look(5, model, 8)(mih.index(model, 8)(block), chunk)
        assert set(best.id[0].tolist()) == want


def test_queries_that_share_a_vec_id_are_two(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (0, [0.0, 1.0]), (1, [0.9, 0.1]), (2, [0.1, 0.9]), (3, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    for found in (covertree.top_k(df, 2), mih.nearest(df, 2)):
        assert sorted((r["rank"], r["vec_id"]) for r in found.collect()) == [(1, 1), (1, 2), (2, 3), (2, 3)]


def test_whole_numbers_beyond_floating_point(spark):
    rows = [(0, [1.0e6, 1.0]), (1, [1.0e6, 0.25]), (2, [1.0e6, 0.5]), (50, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in covertree.top_k(df).collect()}
    big = int(256 * 1.0e6)
    assert got[0, 1] == (2, big * big + 256 * 128) and got[0, 2] == (1, big * big + 256 * 64)


def test_cover_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(0)
    x = np.floor(np.repeat(rng.normal(size=(20, 8)) * 1000, 100, axis=0) + rng.normal(size=(2000, 8)) * 3)
    root, order = covertree.build(x, 32)
    assert sorted(order.tolist()) == list(range(2000))

    def check(n):
        inside = x[order[n.a : n.b]]
        assert (np.linalg.norm(inside - n.center, axis=1) <= n.radius + 1e-6).all()
        assert not n.children or (n.children[0].a, n.children[-1].b) == (n.a, n.b)
        for c in n.children:
            check(c)
            assert c.level <= n.level and c.most <= n.most
        nets = [c.center for c in n.children if (c.center != n.center).any() and c.radius < n.radius / covertree.RATIO + 1e-6]
        reach = min(covertree.RATIO ** (n.level - 1), n.radius / covertree.RATIO) if n.children else 0
        if len(n.children) < covertree.FANOUT:
            assert all(np.linalg.norm(a - b) > reach for k, a in enumerate(nets) for b in nets[:k])  # separation

    check(root)
    q = x[::100]
    q_root, q_order = covertree.build(q, 4)
    best = covertree.Best(np.arange(len(q))[q_order] + 10_000, 5, np.int64)
    scored = covertree.dual_search(best, q[q_order], q_root, x[order], np.arange(2000)[order], root, True)
    leaves = lambda n: sum(map(leaves, n.children)) if n.children else 1
    assert scored < 0.5 * leaves(q_root) * leaves(root)
    want = np.sort(q[q_order] @ x.T, axis=1)[:, ::-1][:, :5]
    assert (best.score == want).all()


def test_nearest_neighbours_recall(vectors):
    rows = clean_rows(vectors, False)
    want = brute(rows, lambda x, y: float((x * y).sum() / (np.sqrt((x * x).sum()) * np.sqrt((y * y).sum()))))
    got = {tuple(r) for r in mih.nearest(vectors).collect()}
    hits = {(q, i) for q, _, i, _ in want} & {(q, i) for q, _, i, _ in got}
    assert len(hits) >= 0.9 * len(want) and len(got) == len(want)
    assert mih.nearest(vectors.limit(0)).count() == 0


def test_recall_and_scores_on_the_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = clean_rows(df, False)
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    got = mih.nearest(df).toPandas()
    hits = total = 0
    for q, part in got.groupby("query_id"):
        (at,) = np.flatnonzero(ids == q)
        cosine = unit @ unit[at]
        cosine[at] = -2
        best = set(ids[np.lexsort((ids, -cosine))[:5]].tolist())
        hits, total = hits + len(best & {*part.vec_id}), total + len(best)
        for r in part.itertuples():
            y = x[np.flatnonzero(ids == r.vec_id)[0]]
            assert abs(r.score - float((y * x[at]).sum() / (np.sqrt((y * y).sum()) * np.sqrt((x[at] ** 2).sum())))) < 1e-12
        assert part.sort_values("rank").score.is_monotonic_decreasing
    assert total == 5 * (ids % 50 == 0).sum() and hits >= 0.9 * total


def test_pigeonhole_probing_finds_the_whole_ball():
    rng = np.random.default_rng(1)
    code = rng.integers(0, 1 << 63, (5000, 2)).astype(np.uint64)
    index = mih.Index(code, 64)
    for radius in (0, 7, 20, 45):
        for q in (code[3], np.array([12345, 7], np.uint64)):
            want = np.flatnonzero(np.bitwise_count(code ^ q).sum(axis=1) <= radius)
            assert index.ball(q, radius).tolist() == want.tolist()


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="home"><header id="top"><h1>Site</h1><a href=x>Home</a></header>
<div id="cookie-notice">We use cookies. Accept them please now.</div><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="post-content"><h2>Title of it</h2><p>First para with &amp; some &nbsp; words, and a <a href=q>link</a>.<p>Second para is here; it
continues for a while.<div class="ad-slot">Buy now!</div><p>Third <i>para</i>graph text is here as well, ok.</p><ul><li>point one</li><li>point two</li></ul></div>
<section id=comments><h3>Comments</h3><p>I really like this article so much, thanks for it.</p></section><aside>Related: <a href=1>foo</a></aside>
<form>Your name <input><button>Send</button></form><footer>(c) 2020</footer></body>"""


def test_main_text_of_a_page_without_article():
    want = "Title of it First para with & some words, and a link. Second para is here; it continues for a while. Third paragraph text is here as well, ok. point one point two"
    assert mincut.main_text(PAGE, mincut.BASE) == want


def test_attributes_by_exact_name_formulas_and_unclosed_elements():
    text = lambda page: mincut.main_text(page, mincut.BASE)
    page = lambda inner: f"<article><p>Some words come first.</p>{inner}</article>"
    for attrs in ('href="/blog/hidden-costs"', 'data-title="The hidden cost of rent"', 'data-id="share-3"', 'data-testid="comment-body"', 'href="?class=menu"', "data-x='a style=display:none'", "data-hidden", 'id="a" id="menu"'):
        assert text(page(f"<div {attrs}>This is kept.</div>")) == "Some words come first. This is kept.", attrs
    for attrs in ("hidden", "HIDDEN", "class=x hidden", 'aria-hidden="true"', "style = 'display: none'", 'class="menu"', "ID=comments", 'data-a="1"class="menu"'):
        assert text(page(f"<div {attrs}>This goes.</div>")) == "Some words come first.", attrs
    math = "<math><semantics><mrow><mi>x</mi><mo>+</mo><mn>1</mn></mrow><annotation encoding='application/x-tex'>x+1</annotation></semantics></math>"
    assert text(page(f"<p>Let {math} be.</p>")) == text(page(f'<p>Let <span>{math}</span><span aria-hidden="true">x+1</span> be.</p>')) == "Some words come first. Let x+1 be."
    assert text(page("<p>One <svg><p>two <svg>three.</p>")) == "Some words come first. One two three."
    assert text(page("<p>One.</p><script>two")) == "Some words come first. One."


def test_names_are_evidence_and_not_verdicts():
    text = lambda page: mincut.main_text(page, mincut.BASE)
    assert text("<p>Just one plain paragraph.</p>") == text("Just one plain paragraph.") == "Just one plain paragraph."
    for attrs in ('class="social-history"', 'id="post-comment-on-life"', 'class="menu-of-the-day"'):
        assert text(f"<article><p>Some words come first.</p><p {attrs}>The town grew by the river, and it traded.</p></article>") == "Some words come first. The town grew by the river, and it traded."
    for attrs in ('id="comments"', 'class="comment-list"', 'class="box adSlot"', 'class="cookie-notice"', 'role="complementary"'):
        assert text(f"<article><p>Some words come first.</p><div {attrs}>I like it a lot.</div></article>") == "Some words come first.", attrs


def test_the_cut_decides_where_blocks_are_in_doubt(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    model = mincut.fit(pages)
    plain = [re.sub("<(/?)article>", r"<\1div>", r["html"]) for r in pages.collect()]
    signs = right = changed = 0
    for r, page in zip(pages.collect(), plain, strict=True):
        a = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", a))).split())
        blocks, unary, side = mincut.labels(page, model)
        changed += sum((u > 0) != s for u, s in zip(unary, side, strict=True))
        right += want == " ".join(b.text for b, s in zip(blocks, side, strict=True) if s)
        signs += want == " ".join(b.text for b, u in zip(blocks, unary, strict=True) if u > 0)
    assert changed > 0 and right > signs and right == len(plain)


def test_long_pages_take_seconds():
    rng = np.random.default_rng(6)
    n = 60_000
    links = [(k, k + 1, 1.5) for k in range(n - 1)] + [(k, k + 9, 0.8) for k in range(0, n - 9, 7)]
    for unary in (rng.normal(size=n) / 20, np.linspace(-0.1, 0.1, n), np.full(n, 0.3) * np.where(np.arange(n) < n // 2, 1, -1)):
        began = time.monotonic()
        assert len(mincut.minimum_cut(unary.tolist(), links)) == n
        assert time.monotonic() - began < 30
    assert len(mincut.main_text("".join(f"<p>Words of line {k} go on for a while, and more of them come after these.</p><li>x" for k in range(30_000)), mincut.BASE)) > 100_000


def test_fit_without_marked_pages_is_the_prior(spark):
    pages = spark.createDataFrame([(1, "u", "<p>one</p>"), (2, None, None)], "page_id bigint, url string, html string")
    assert mincut.fit(pages) == mincut.BASE == mincut.fit(pages.limit(0))


def test_minimum_cut_equals_enumeration():
    rng = np.random.default_rng(3)
    for _ in range(400):
        n = int(rng.integers(1, 10))
        unary = (rng.normal(size=n) * rng.choice([0.2, 1])).round(2).tolist()
        links = [(a, b, float(rng.random().__round__(2))) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(s, unary=unary, links=links):
            return sum(-u if x and u < 0 else u if not x and u > 0 else 0 for u, x in zip(unary, s, strict=True)) + sum(w for a, b, w in links if s[a] != s[b])

        least = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert abs(cost(mincut.minimum_cut(unary, links)) - least) < 1e-6


def test_pages_of_the_tables(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    odd = spark.createDataFrame([(9001, "u", None), (9002, "u", ""), (9003, None, "<"), (9004, "u", "<div>" * 30_000 + "x"), (9005, "u", "<p" + " a='" * 2000)], "page_id bigint, url string, html string")
    weights = mincut.fit(pages)
    got = {r["page_id"]: r for r in mincut.extract(pages.unionByName(odd).withColumn("text", F.lit("clash")), weights).collect()}
    for r in pages.collect():
        a = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", a))).split())
        assert (got[r["page_id"]]["text"], got[r["page_id"]]["n_chars"]) == (want, len(want))
    assert got[9001]["text"] == got[9002]["text"] == ""
    assert mincut.extract(pages.limit(0), mincut.fit(pages.limit(0))).count() == 0


def test_queries_and_pipeline(spark):
    import __spark_entry__
    import corpus_pipeline

    from docassay.llm import queries

    names = queries.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, SF)
        assert docs.columns == before.columns, name
    out = __spark_entry__.queries()["pipeline"](spark, SF).collect()
    assert 0 < len({r["doc_id"] for r in out}) <= n and all(r["n_tokens"] == len(r["ids"]) for r in out)
