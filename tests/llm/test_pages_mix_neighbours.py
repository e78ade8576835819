"""Pages, mixing, neighbours and the pipeline."""

import html
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from limbwise.llm import bpe, extract, mixing, neighbours
from limbwise.llm.words import word_array, word_count
from tests.llm.cases import ROWS, crowded, docs, words

SF = "/root/testdata/sf0.001"


def test_template_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r["page_id"]: r["text"] for r in extract.extract(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:h1|p)>", article)]
        assert got[r["page_id"]] == "\n".join(x for x in blocks if x)


def test_other_pages():
    page = ("<html><head><title>T</title></head><body><header><a href=/>Home</a> Site</header><div class='cookie-notice'>We use cookies</div>"
            "<div id=sidebar>Side bar text goes here</div><main><article><header><h1>Title &amp; x</h1></header><p>One<br>two  three"
            "<div class=advert>BUY</div><p>Four <a href=x>link</a>&nbsp;five</p><form>Name <input> email</form><ul><li>a<li>b</ul></article>"
            "<section class=comments><article><p>First!</p></article></section></main><footer>c</footer>")
    assert extract.main_text(page) == "Title & x\nOne two three\nFour link five\na\nb"
    plain = ("<body><div><a href=1>Home</a><a href=2>About</a></div><div><p>A long paragraph with far more than sixty characters is what makes the sum surge.</p>"
             "<p>Then it goes on.</p></div><div><a>x</a></div><div><a>y</a></div><div><a>z</a></div><div>short end</div></body>")
    assert extract.main_text(plain).split("\n")[:2] == ["A long paragraph with far more than sixty characters is what makes the sum surge.", "Then it goes on."]
    assert [extract.main_text(x) for x in (None, "", "<p", "<!-- x", "<script>var a")] == ["", "", "", "", ""]
    assert extract.main_text("<article><p>" + "word " * 50_000 + "</article>") == ("word " * 50_000).strip()


def test_names_that_hold_role_words():
    long = "A paragraph of the article with more than sixty characters in it, so that the sum surges."
    article = f"<article><p>{long}</p></article>"
    for page in (f'<div class="layout has-sidebar">{article}</div>', f'<div class="no-sidebar">{article}</div>', f'<div class="sidebar">{article}</div>',
                 f'<form id=aspnet>{article}</form>', article.replace("<article", '<article class="post comments-open"'), article.replace("<article", "<article class=widget"),
                 f"<div class=widget><p>{long}</p></div><div><a>few words</a></div>", f"<div class=menu><p>{long}</p></div><footer>Imprint</footer>", f"<article><div class=search><p>{long}</p></div></article>",
                 f"{article}<footer class=site-footer>f</footer><div class=related><article><p>{long} again and again</p></article></div>",
                 f"<main>{article}<div id=comments><article>{long * 9}</article></div></main>"):
        assert extract.main_text(page) == long, page
    head = f'<article><header class="entry-header"><h1>Headline</h1></header><div class=header>Lead</div><p>{long}</p><div class="site_footer">f</div></article>'
    assert extract.main_text(head) == f"Headline\nLead\n{long}"
    assert extract.main_text(f'<p>{long}</p><div style="display:none">hidden {long}</div><div class="ad-slot-3">buy</div>') == long


def test_short_articles_and_runs_stay():
    long = "A paragraph of the article with more than sixty characters in it, so that the sum surges. " * 6
    short = "A short piece that has its own words, more than sixty characters of them here."
    gap = "<div><a href=1>x</a></div>" * 3
    teasers = "<article><a href=2>Read the story of the year</a> now</article>"
    assert extract.main_text(f"<article>{long}</article><article>{short}</article>{teasers}") == f"{long.strip()}\n{short}"
    assert extract.main_text(f"<div>{long}</div>{gap}<div>{short}</div>") == f"{long.strip()}\n{short}"
    assert extract.main_text(teasers) == "Read the story of the year now"


def test_page_rows(spark):
    frame = spark.createDataFrame([(1, "u", None, "t"), (None, None, "<article>hi</article>", "t"), (1, "u", "", "t")], "page_id bigint, url string, html string, text string")
    assert Counter((r["page_id"], r["text"], r["n_chars"]) for r in extract.extract(frame).collect()) == Counter([(1, "", 0), (None, "hi", 2), (1, "", 0)])
    assert extract.extract(frame.limit(0)).count() == 0


def water(sizes):
    """Targets by the stated rule, step by step."""
    names = sorted([k for k in sizes if k is not None], key=lambda x: x.encode()) + [k for k in sizes if k is None]
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(names)}
    target, left, free = dict.fromkeys(names, 0.0), float(sum(sizes.values())), set(names)
    while left > 1e-9 and free:
        total = sum(weight[k] for k in free)
        for k in free:
            target[k] += left * weight[k] / total
        left = 0.0
        for k in list(free):
            if target[k] >= 3 * sizes[k]:
                left += target[k] - 3 * sizes[k]
                target[k] = 3.0 * sizes[k]
                free.discard(k)
    return target


def check_mix(frame, near):
    rows = [r.asDict() for r in mixing.taken(frame).collect()]
    by_id = {r["doc_id"]: r["source"] for r in frame.collect()}
    sizes = Counter()
    for r in frame.collect():
        sizes[r["source"]] += len(words(r["text"]))
    target, got = water(sizes), Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["source_size"] == sizes[by_id[r["doc_id"]]]
        assert abs(r["target"] - target[by_id[r["doc_id"]]]) < 1e-6 * max(1, r["target"])
        got[by_id[r["doc_id"]]] += r["taken"]
    for k, t in target.items():
        assert abs(got[k] - t) <= near * t + mixing.BLOCK
    key = lambda r: (str(r["doc_id"]), r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, (r.asDict() for r in mixing.taken(frame).collect())))
    return rows


def test_mix(spark):
    check_mix(spark.read.parquet(f"{SF}/documents.parquet"), 0.05)
    text = " ".join(str(i) for i in range(700))
    check_mix(docs(spark, [(i, text, "en", s, 0) for i, s in enumerate(["a"] * 30 + ["b"] * 2 + ["é"] + [None] * 3 + ["c"] * 9)]), 0.05)


def test_mixed_documents_hold_the_taken_words(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["taken"] for r in mixing.taken(frame).collect()}
    own = {r["doc_id"]: Counter(words(r["text"])) for r in frame.collect()}
    got = Counter()
    for r in mixing.mixed_documents(frame).collect():
        got[r["doc_id"]] += len(words(r["text"]))
        assert not Counter(words(r["text"])) - own[r["doc_id"]] and r["n_chars"] == len(r["text"])
    assert got == Counter({k: n for k, n in rows.items() if n})


def test_permutations(spark):
    for n in (1, 2, 7, 100, 129):
        out = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("bigint"), F.lit("s"), F.lit(0)).alias("p")).collect()
        assert sorted(r["p"] for r in out) == list(range(n))
    assert [r["p"] for r in out] != list(range(129))


def test_mix_odd_rows(spark):
    assert len(check_mix(docs(spark, [r for r in ROWS if r[0] not in (9, None)]), 0.3)) == len(ROWS) - 3
    frame = crowded(spark)
    assert mixing.taken(frame).count() == len(ROWS)
    assert mixing.mixed_documents(frame).columns == frame.columns
    assert mixing.taken(docs(spark, [])).count() == 0
    assert {r["taken"] for r in mixing.taken(docs(spark, [(1, None, "en", "a", 0), (2, "", "en", None, 0)])).collect()} == {0}
    plan = mixing.taken(docs(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def brute(rows, k=20):
    out = {}
    vectors = {i: np.array(v, np.float64) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and np.any(v)}
    for q in [i for i in vectors if i % 20 == 0]:
        scored = sorted(((-(vectors[q] * v).sum(), i) for i, v in vectors.items() if i != q))
        out[q] = [i for _, i in scored[:k]]
    return out


def test_neighbours(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in frame.collect()]
    want, vectors, got = brute(rows), dict(rows), {}
    for r in neighbours.query(spark, "/root/testdata/sf0.01").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
        assert abs(r["score"] - np.dot(np.array(vectors[r["query_id"]], float), np.array(vectors[r["vec_id"]], float))) < 1e-12
    assert got.keys() == want.keys() and all([n for n, _ in sorted(v)] == list(range(1, 21)) for v in got.values())
    assert np.mean([len({i for _, i in got[q]} & set(want[q])) / 20 for q in want]) >= 0.9


def test_neighbours_with_copies_and_odd_rows(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 0.5]) for i in range(0, 300)] + [(i, rng.normal(size=3).tolist()) for i in range(300, 420)]
    rows += [(500, None), (520, [0.0, 0.0, 0.0]), (540, [float("nan"), 1.0, 1.0]), (560, [None, 1.0, 1.0]), (None, [1.0, 1.0, 1.0]), (580, []), (600, [float("inf"), 1.0, 0.0]), (300, rows[300][1])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    frame = frame.withColumn("key", F.lit(1)).withColumn("v", F.lit(2))
    got = {}
    for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = r["vec_id"]
    want = brute([(i, np.float32(v).tolist() if v and None not in v else v) for i, v in rows])
    assert got.keys() == want.keys()
    for q in range(0, 300, 20):
        assert [got[q][n] for n in range(1, 21)] == want[q]     # copies: the smaller ids first, never the query's own
    few = neighbours.nearest(frame.where("vec_id in (0, 20, 301)"), F.col("vec_id") % 20 == 0)
    assert few.count() == 4
    assert neighbours.nearest(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_ties_go_to_the_smaller_id(spark):
    """Different vectors that tie with each other, in one block and across leaves."""
    import pyarrow as pa
    rng = np.random.default_rng(8)
    rows = [(0, [1.0] + [0.0] * 15)] + [(i, [0.5, *rng.choice([-1.0, 1.0], 15).tolist()]) for i in range(1, 400)]
    got = {}
    for r in neighbours.nearest(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0).collect():
        got[r["rank"]] = (r["vec_id"], r["score"])
    assert got == {n: (n, 0.5) for n in range(1, 21)}
    asking = pa.table({"q": ["a"], "qv": [rows[0][1]], "leaves": [[0]]})
    held = pa.table({"key": [str(i) for i in range(300, 0, -1)], "v": [[0.5, *rng.normal(size=15).tolist()] for _ in range(300)], "first": list(range(300, 0, -1)), "leaf": [0] * 300})
    assert sorted(neighbours._best(asking, held)["first"].to_pylist()) == list(range(1, 22))


def test_pipeline(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    columns = frame.columns
    for at, (name, stage) in enumerate(corpus_pipeline.STAGES):
        frame = stage(spark, frame, SF)
        assert at == len(corpus_pipeline.STAGES) - 1 or frame.columns == columns
        frame = spark.createDataFrame(frame.collect(), frame.schema)
    from tokenizers import Tokenizer

    out = frame.collect()
    assert out and all(len(r["token_ids"]) == 4 * r["n_tokens"] for r in out)
    ran = corpus_pipeline.run(spark, SF).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in ran) == Counter((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in out)
    assert Tokenizer.from_str(bpe.tokenizer_json()).decode(np.frombuffer(bytes(out[0]["token_ids"]), "<u4").tolist())


def test_pipeline_takes_odd_rows(spark):
    frame = docs(spark)
    for _, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, SF)
        frame = spark.createDataFrame(frame.collect(), frame.schema)
    empty = docs(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_words_without_a_pattern(spark):
    """Words and their number as bytes.split() has them, for every white space; the usual text is split at blanks only."""
    texts = ["", " ", "a", "\n\n a  b\nc \n", "tab\there", "v\x0bf\x0cr\rn\n", "no\u00a0break\u2003space\x1cx\x85y", "ä\n\nö ü", None, "a\r\nb"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    for text, found, n in frame.select("text", word_array(F.col("text")), word_count(F.col("text"))).collect():
        assert [w.encode() for w in found] == words(text) and n == len(words(text))
    assert "regexp_replace" not in frame.select(word_count(F.col("text")))._jdf.queryExecution().optimizedPlan().toString()
