"""Operators 11 to 13 against the library itself, brute force over pairs of words and plain sums over terms."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from limbwise.llm import bpe, divergence, tokencount, variants
from limbwise.llm.bpe import tokenizer_json
from tests.llm.cases import ROWS, crowded, docs


def library_counts(texts):
    import json

    from tokenizers import Tokenizer
    model = Tokenizer.from_str(tokenizer_json())
    model.no_truncation()
    model.no_padding()
    assert json.loads(tokenizer_json())["added_tokens"]
    return [len(model.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_pieces_add_up():
    from tokenizers import Tokenizer
    rng, model, pieces = random.Random(3), Tokenizer.from_str(tokenizer_json()), tokencount.cutter(tokenizer_json())
    parts = ["a", "B", "'s", "'", "!", "é", "é", "́", " ", "\n", " ", "\x07", "9", "²", "İ", "Σ", "ß", "中", "\U0001F600", "<|endoftext|>", "<|", "|>", "<|startoftext|>", "endoftext", "-", "_"]
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(14)))
        found = pieces(text.encode())
        assert sum(len(model.encode(p.decode(), add_special_tokens=False).ids) for p in found) == len(model.encode(text, add_special_tokens=False).ids), text
    assert pieces(b"it's a<|endoftext|>b!") == [b"it", b"'s", b"a", b"b", b"!", b"<|endoftext|>"]


@pytest.mark.parametrize("hot", [0, 40, tokencount.HOT])
def test_token_counts_equal_the_library(spark, hot):
    got = sorted(map(tuple, tokencount.count_tokens(crowded(spark), tokenizer_json(), 100, hot).collect()), key=repr)
    want = sorted(((r[0], len((r[1] or "").encode()), n, n > 100) for r, n in zip(ROWS, library_counts([r[1] for r in ROWS]))), key=repr)
    assert got == want


def test_postings_flushed_often(spark, monkeypatch):
    rows = [(i, f"word{i % 7} tail{i} {'x' * 300} it's", "en", "a", 1) for i in range(200)]
    monkeypatch.setattr(tokencount, "HELD", 50)
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.count_tokens(docs(spark, rows), tokenizer_json(), hot=2).collect()}
    assert got == dict(zip(range(200), library_counts([r[1] for r in rows])))


def test_other_tokenizers_take_whole_texts():
    import json
    spec = json.loads(tokenizer_json())
    spec["normalizer"] = None
    assert tokencount.cutter(json.dumps(spec))(b"two words") == [b"two words"]


def test_token_counts_of_an_empty_table(spark):
    assert tokencount.count_tokens(docs(spark, []), tokenizer_json()).count() == 0


def brute_words(rows, shortest=5, least=3):
    n = Counter()
    for doc, text, *_ in rows:
        low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= shortest:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= least}


def is_near(a, b):
    """Does one inserted, deleted or replaced letter turn a into b."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute_variants(n, ratio=2):
    near = {w: [v for v in n if is_near(w, v)] for w in n}
    form = {}
    for w, found in near.items():
        best = min(found, key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= ratio * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def test_variants_equal_brute_force(spark, monkeypatch):
    rng = random.Random(11)
    n = {}
    for _ in range(700):
        n["".join(rng.choice("abé") for _ in range(rng.randrange(5, 9)))] = rng.choice([3, 3, 4, 6, 9, 12, 25, 50, 100])
    n |= {"a" * k: 3 * 2 ** (k - 5) for k in range(5, 15)} | {"zzzzz": 7, "q" * 3000: 5, "q" * 3001: 11, "aaaaÿa": 3}
    table = spark.createDataFrame(list(n.items()), "word string, n bigint")
    for letters in (variants.PART_LETTERS, 300):
        monkeypatch.setattr(variants, "PART_LETTERS", letters)
        assert set(map(tuple, variants.variants(table).select("word", "form", "root", "n", "n_near", "form_n").collect())) == brute_variants(n)


def test_runs_are_counted_whole(spark):
    rows = ROWS + [(20 + i, f"Corção CORÇÃO word{i}word overlap-overlap× " + "Long" * 50_000, "en", None, 1) for i in range(120)]
    want = brute_words(rows)
    assert len(want) > 5
    for least, frame in ((3, docs(spark, rows)), (1, docs(spark, rows).withColumn("word", F.lit("w")).withColumn("n", F.lit("n")))):
        assert {r["word"]: r["n"] for r in variants.run_counts(frame).where(f"n >= {least}").collect()} == brute_words(rows, least=least)


def test_variants_of_empty_tables(spark):
    assert variants.variants(variants.run_counts(docs(spark, []))).count() == 0
    assert variants.variants(variants.run_counts(docs(spark, [(1, None, None, None, None), (None, "", None, None, 0)]))).count() == 0


def brute_divergence(rows, least=3, top=200):
    count, found, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        count[lang, source].update(terms)
        found[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, d in found[lang].items() if d >= least]
        own = {s: {t: count[lang, s][t] for t in kept} for g, s in groups if g == lang}
        own[None] = {t: sum(c[t] for s, c in own.items()) for t in kept}
        p = {s: {t: 1 + 10 ** 9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in own.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            if s is None:
                continue
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o not in (s, None)]
            terms = [(f(p[s][t], p[None][t]), t) for t in kept if own[s][t] and p[s][t] > p[None][t]]
            for part, items in (("pair", pairs), ("term", terms)):
                for rank, (value, item) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:top if part == "term" else None], 1):
                    out.add((lang, s, part, item, value, rank))
    return out


COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def test_divergence_equals_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefghé中" for b in "stuvwxyz"]
    rows = ROWS + [(100 + i, " ".join(rng.choice(words[:10 + i % 70]) for _ in range(rng.randrange(60))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "d", "lone" * (i % 3)]), 1) for i in range(150)]
    want = brute_divergence(rows)
    for block, width in ((divergence.BLOCK, divergence.SLICE), (8, 2), (1, 1)):
        monkeypatch.setattr(divergence, "SLICE", width)
        assert set(map(tuple, divergence.divergences(docs(spark, rows), block=block).select(*COLUMNS).collect())) == want
    few = divergence.divergences(docs(spark, rows), top=3).where("part = 'term'").agg(F.max("rank")).first()[0]
    assert few == 3
    assert set(map(tuple, divergence.divergences(crowded(spark)).select(*COLUMNS).collect())) == brute_divergence(ROWS)


def test_divergence_of_odd_tables(spark):
    assert divergence.divergences(docs(spark, [])).count() == 0
    rows = [(1, None, None, None, 0), (2, "", "", "x", 0)]
    assert set(map(tuple, divergence.divergences(docs(spark, rows)).select(*COLUMNS).collect())) == {("", "", "pair", "x", 0, 1), ("", "x", "pair", "", 0, 1)}


def test_shares_are_exact():
    rng = random.Random(2)
    total = [rng.randrange(1, 10 ** rng.randrange(1, 15)) for _ in range(300)]
    count = [rng.randrange(t + 1) for t in total]
    got = divergence.share(np.array(count), np.array(total), np.int64(1000))
    assert got.tolist() == [1 + 10 ** 9 * (c + 1) // (t + 1000) for c, t in zip(count, total)]


def test_equal_subtrees_are_one_node():
    counts = np.array([[0, 0, 0, 0, 1, 0, 1, 0], [1, 0, 1, 0, 0, 0, 0, 0]])
    values, levels, top = divergence.consed(counts)
    assert [len(left) for left, _ in levels] == [2, 2, 2] and len(set(top.tolist())) == 2


def test_every_row_of_a_large_batch_keeps_its_own_ids(spark):
    texts = [f"text {i} of many" if i % 7 else None for i in range(700)]
    frame = docs(spark, [(i, t, "en", "a", 1) for i, t in enumerate(texts)]).coalesce(1)
    coder = bpe.ChunkCoder(tokenizer_json())
    got = {r["doc_id"]: bytes(r["token_ids"]) for r in bpe.encode_documents(frame, tokenizer_json()).collect()}
    assert got == {i: coder.whole(t or "")[0] for i, t in enumerate(texts)}
