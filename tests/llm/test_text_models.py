"""Tokens, language models, languages and the classifier."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from limbwise.llm import bpe, classify, langid, ppm
from tests.llm.cases import ROWS, crowded, docs

SF = "/root/testdata/sf0.001"
ODD = ["  a <|endoftext|> b ", "é é ́x", "", "x", "it's they're 'so 'llama we'll, he'd' 's 's", "a b  c", " \n\t",
       "''s ''' <|startoftext|><|endoftext|>x", "1234 a1b2 3.4", "don't-stop I'VE", "Ⅷ ² ½ a²", "ΑΣ ΣΑΣ. İI", "a\x00b\x85c \x1c d", "THE The ÉE É", None]


def test_bpe_equals_the_library(spark):
    from tokenizers import Tokenizer

    text = bpe.tokenizer_json()
    plain = Tokenizer.from_str(text)
    texts = ODD + [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    for coder in (bpe.ChunkCoder(text), bpe.ChunkCoder(text, bits=0, most_chunks=50, most_pieces=200)):
        for one, (ids, n, decoded) in zip(texts, coder.encode(texts)):
            want = plain.encode(one or "", add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want and n == len(want)
            assert decoded == plain.decode(want, skip_special_tokens=False)


def test_bpe_cuts_do_not_depend_on_earlier_texts():
    from tokenizers import Tokenizer

    text = bpe.tokenizer_json()
    plain = Tokenizer.from_str(text)
    pairs = [("się, a", "dogs’, a"), ("был, a", "дом», a"), ("она, a", "20°, a"), ("é. a", "©. a"), ("é. a", "e\u0301. a"), ("a, b", "İ, b"), ("a, b", "a\x01, b"),
             ("x <|im_start|> y", "x <|endoftext|> y"), ("x t|> a", "a<|startoftext|>b"), ("a< b", "a<\u0338 b"), ("क, a", "\u0958, a")]
    pick = np.random.default_rng(8)
    letters = list("aZé9’»°,.'<|> \n\x01\x85\u0301\u0338İक़") + ["<|endoftext|>", "'s", "  "]
    mixed = ["".join(pick.choice(letters, 40)) for _ in range(400)]
    for bits in (0, 5):
        coder = bpe.ChunkCoder(text, bits=bits)
        coder.most_joins = 50
        for one in [t for pair in pairs for t in pair] + mixed:
            ids, n, decoded = coder.encode([one])[0]
            want = plain.encode(one, add_special_tokens=False).ids
            assert np.frombuffer(ids, "<u4").tolist() == want and n == len(want), one
            assert decoded == plain.decode(want, skip_special_tokens=False)


def test_bpe_joins_and_other_tokenizers():
    import json

    from tokenizers import Tokenizer

    text = bpe.tokenizer_json()
    coder, one = bpe.ChunkCoder(text, bits=0), "some words \n stand here, and more"
    want = coder.encode([one])
    assert len(coder.joins) == 5 and all(coder.joins.values()) and b"words \n stand" in coder.joins
    coder.joins[b"words \n stand"] = False     # a join that disagrees: the text is encoded whole
    assert coder.encode([one]) == want == [coder.whole(one)]
    other = json.loads(text)
    other["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"[^,]+|,"}     # words that cross white space and marks
    coder, plain = bpe.ChunkCoder(json.dumps(other), bits=0), Tokenizer.from_str(json.dumps(other))
    for (ids, n, decoded), one in zip(coder.encode(["a b. c, d", None]), ["a b. c, d", ""]):
        wanted = plain.encode(one, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == wanted and n == len(wanted) and decoded == plain.decode(wanted, skip_special_tokens=False)


def test_bpe_rows(spark):
    out = bpe.digests(bpe.encode_documents(crowded(spark), bpe.tokenizer_json())).collect()
    assert len(out) == len(ROWS)
    empty = [r for r in out if r["doc_id"] in (2, 3, 4)]
    assert {(r["n_tokens"], r["ids_sha256"][:8], r["decoded_sha256"][:8]) for r in empty} == {(0, "e3b0c442", "e3b0c442")}
    assert bpe.encode_documents(docs(spark, []), bpe.tokenizer_json()).count() == 0


def plain_ppm(train, asked):
    """Probability by dictionaries, one context after the other."""
    follow = defaultdict(Counter)
    pad = b"\n" * ppm.ORDER
    for data in train:
        s = pad + data
        for k in range(ppm.ORDER, len(s)):
            for order in range(ppm.ORDER + 1):
                follow[s[k - order:k]][s[k]] += 1
    out = []
    for data in asked:
        s, total = pad + data, 0.0
        for k in range(ppm.ORDER, len(s)):
            ruled = set()
            for order in range(ppm.ORDER, -1, -1):
                known = {b: c for b, c in follow.get(s[k - order:k], {}).items()}
                n = sum(c for b, c in known.items() if b not in ruled)
                if not n:
                    continue
                if s[k] in known:
                    total += math.log10((known[s[k]] - ppm.DISCOUNT) / n)
                    break
                total += math.log10(ppm.DISCOUNT * len(set(known) - ruled) / n)
                ruled = set(known)
            else:
                total -= math.log10(256 - len(ruled))
        out.append(total)
    return out


def check_scores(frame):
    rows, got = frame.collect(), ppm.score(frame).collect()
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    train = [ppm.stream(r["text"]) for r in rows if not held(r["doc_id"])]
    counts = Counter(w for _, found in train for w in found)
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for r, p in zip(rows, plain_ppm([d for d, _ in train], [ppm.stream(r["text"])[0] for r in rows])):
        found = ppm.stream(r["text"])[1]
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in found)
        want[str(r["doc_id"]), held(r["doc_id"]), len(found), sum(counts[w] > 0 for w in found), n, f"{base:.6f}", f"{p:.2f}"] += 1
    have = Counter((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], f"{r['base_score']:.6f}", f"{r['score']:.2f}") for r in got)
    close = lambda a, b: a[:6] == b[:6] and abs(float(a[6]) - float(b[6])) < 0.02 + 1e-5 * abs(float(b[6]))
    assert len(have) == len(want) and all(close(a, b) for a, b in zip(sorted(have), sorted(want)))


def test_ppm_equals_brute_force(spark):
    check_scores(spark.read.parquet(f"{SF}/documents.parquet").where(F.length("text") < 1500))


def test_ppm_odd_rows(spark):
    check_scores(docs(spark, [r for r in ROWS if r[0] != 5]))
    assert ppm.score(crowded(spark)).count() == len(ROWS)
    assert ppm.score(docs(spark, [])).count() == 0


def test_ppm_blocks_do_not_change_scores(spark, monkeypatch):
    frame = spark.read.parquet(f"{SF}/documents.parquet")
    one = {r["doc_id"]: r["score"] for r in ppm.score(frame).collect()}
    monkeypatch.setattr(ppm, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(ppm, "BUCKET_BYTES", 20_000)
    many = {r["doc_id"]: r["score"] for r in ppm.score(frame).collect()}
    assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-6 * abs(one[k]) for k in one)


def test_automaton_knows_all_substrings():
    rng = np.random.default_rng(4)
    found = rng.integers(0, 4, 300)
    table = langid.automaton(found, 603)
    inside = {tuple(found[i:i + n]) for n in range(1, 7) for i in range(300 - n + 1)}
    for n in range(1, 7):
        for one in rng.integers(0, 4, (200, n)):
            state = 1
            for s in one:
                state = state and int(table[state, s])
            assert bool(state) == (tuple(one) in inside)


def test_phrases_are_greedy_longest_matches():
    samples = {"a": ["der hund und die katze", "hundert katzen"], "b": ["le chat et le chien sont la"]}
    model = langid.build(samples)
    parser, letters = langid.Parser(model), langid.Letters()
    texts = ["die hunde und der kater", "le chien et la chatte", "zzz", "der der der der " * 40]
    coded = [langid.symbols(langid.with_blanks(langid.code_points(t), letters), parser.table) for t in texts]
    got = parser.phrases(coded)
    for at, lang in enumerate(model.langs):
        whole = np.concatenate([np.append(langid.symbols(langid.with_blanks(langid.code_points(t), letters), parser.table), 0 * 0 + parser.table[32]) for t in samples[lang]])
        inside = {tuple(whole[i:j]) for i in range(len(whole)) for j in range(i + 1, len(whole) + 1)}
        for x, n in zip(coded, got[:, at]):
            want = 0
            for lo in range(0, len(x), langid.PIECE):
                piece, k = x[lo:lo + langid.PIECE], 0
                while k < len(piece):
                    step = 1
                    while k + step < len(piece) and tuple(piece[k:k + step + 1]) in inside:
                        step += 1
                    want, k = want + 1, k + step
            assert abs(int(n) - want) <= len(x) // langid.PIECE + 1


def test_languages_of_many_scripts():
    """Two languages a script, alike in their code points modulo 8, beside Latin ones that fill the frequent symbols."""
    rng = np.random.default_rng(6)
    scripts = {"latin": [*range(97, 123), *range(0xE0, 0xF7)], "cyrillic": range(0x430, 0x450), "greek": range(0x3B1, 0x3CA), "hebrew": range(0x5D0, 0x5EB),
               "thai": range(0xE01, 0xE2F), "deva": range(0x905, 0x93A), "han": range(0x4E00, 0x4E00 + 1600), "far": range(0x20000, 0x20000 + 300)}
    words = {}
    for name, codes in scripts.items():
        own = ["".join(map(chr, rng.choice(list(codes), rng.integers(2, 7)))) for _ in range(400)]
        own = [w for w in own if w.isalpha()]
        # the second language has the words of the first with every letter 8 places on
        words[name + "1"] = own
        words[name + "2"] = ["".join(chr(codes[(list(codes).index(ord(c)) + 8) % len(codes)]) for c in w) for w in own]
        words[name + "2"] = [w for w in words[name + "2"] if w.isalpha()]
    text = lambda lang, n: " ".join(rng.choice(words[lang], n))
    parser = langid.Parser(langid.build({k: [text(k, 1500)] for k in words}))
    for lang in words:
        assert {got for got, _ in parser.score([text(lang, 12) for _ in range(20)])} == {lang}
    han = [langid.symbols(langid.with_blanks(langid.code_points(text("han1", 60)), parser.letters), parser.table) for _ in range(5)]
    at = parser.model.langs.index("han1")
    whole = parser.model.samples[at]
    assert len(whole.keys) and all(int(n) < len(x) for x, n in zip(han, parser.phrases(han)[:, at]))


def test_rare_symbols_are_longest_matches_too():
    rng = np.random.default_rng(3)
    text = "".join(map(chr, rng.integers(0x4E00, 0x4E00 + 150, 3000)))
    parser, letters = langid.Parser(langid.build({"x": [text]})), langid.Letters()
    asked = [text[at:at + 5] + "\u3400" + text[at + 40:at + 60] for at in range(0, 2800, 97)]
    coded = [langid.symbols(langid.with_blanks(langid.code_points(t), letters), parser.table) for t in asked]
    for one, n in zip(asked, parser.phrases(coded)[:, 0]):
        want, k = 0, 0
        while k < len(one):
            step = 1
            while k + step < len(one) and one[k:k + step + 1] in text:
                step += 1
            want, k = want + 1, k + step
        assert abs(int(n) - want) <= 1


def test_all_languages_are_learned(spark):
    rng = np.random.default_rng(12)
    own = {f"l{i:03d}": ["".join(map(chr, rng.integers(97, 123, 6))) for _ in range(12)] for i in range(205)}
    # the first 200 languages have more rows
    rows = [(k * 10 + n, " ".join(rng.choice(words, 20)), lang, "a", 1) for k, (lang, words) in enumerate(own.items()) for n in range(4 if k < 200 else 3)]
    model = langid.learn(docs(spark, rows))
    assert len(model.langs) == 205
    assert [got for got, _ in langid.Parser(model).score([" ".join(words[:9]) for words in own.values()])] == list(own)


def test_every_picked_row_gives_its_share():
    long, short = " ".join(["haus"] * 30_000 + ["ende"] * 30_000), ["maus", "vogel", "fisch" * 300]
    found = "".join(map(chr, langid.sampled([long, *short], 4000, langid.Letters())))
    assert 3900 < len(found) <= 4000 and all(t in found for t in ("maus", "vogel", "fisch" * 200, "haus haus", "ende ende"))
    assert langid.shares([10, 5000, 100, 5000], 1110) == [10, 500, 100, 500] and langid.shares([5, 5], 100) == [5, 5]


def test_languages_held_out(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.identify(frame, langid.learn(frame)).join(frame.select("doc_id", "lang"), "doc_id").where(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4 == 2)
    hits = [r["lang"] == r["lang_pred"] for r in out.collect()]
    assert len(hits) > 100 and np.mean(hits) > 0.95


def test_language_odd_rows(spark):
    out = {(r["doc_id"], r["lang_pred"]) for r in langid.identify(crowded(spark), langid.learn(crowded(spark))).collect()}
    assert {(2, "und"), (3, "und"), (4, "und")} <= out and (9, "de") in out
    assert langid.identify(docs(spark, []), langid.learn(docs(spark, []))).count() == 0
    nothing = docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(nothing, langid.learn(nothing)).collect()} == {"und"}


def test_gradients():
    rng = np.random.default_rng(9)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (10, 200, 64, 129, 700)] + [b""]
    y = np.array([0, 1, 1, 0, 1, 1], np.float32)
    model = classify.Model(rng.normal(0, 0.5, (classify.WIDTH, 256, classify.FILTERS)).astype(np.float64), rng.normal(0, 0.1, classify.FILTERS),
                           rng.normal(0, 1, classify.FILTERS), rng.normal(0, 1, classify.FILTERS), 0.3)

    def loss(m):
        p = classify.probabilities(texts, m)
        return float(-np.mean(np.log(np.where(y == 1, p, 1 - p))))
    grads = classify._gradients(texts, y, model)
    for part, name in enumerate(("tables", "bias", "mean", "top")):
        flat = grads[part].ravel()
        for at in np.argsort(-np.abs(flat))[:4]:
            def moved(d):
                new = getattr(model, name).copy()
                new.ravel()[at] += d
                return loss(model._replace(**{name: new}))
            assert abs((moved(1e-3) - moved(-1e-3)) / 2e-3 - flat[at]) < 2e-3 + 0.05 * abs(flat[at])


def test_classifier_held_out(spark):
    frame, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    out = classify.score(frame, classify.learn(frame, labels)).join(labels, "doc_id").where(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 4 == 2).toPandas()
    good, bad = out[out.quality == 1].score.to_numpy(), out[out.quality == 0].score.to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.85


def test_classifier_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, 0), (6, 1, 0), (9, None, 0), (None, 1, 0), (11, 0, 0), (6, 1, 0)], "doc_id bigint, quality int, toxic int")
    out = classify.score(crowded(spark), classify.learn(crowded(spark), labels)).collect()
    assert len(out) == len(ROWS) and all(0 <= r["score"] <= 1 for r in out)
    one = classify.learn(docs(spark), labels.where("quality = 1"))
    assert all(r["score"] > 0.5 for r in classify.score(docs(spark), one).collect())
    assert {r["score"] for r in classify.score(docs(spark), classify.learn(docs(spark), labels.limit(0))).collect()} == {0.5}
    assert classify.score(docs(spark, []), one).count() == 0


def plain_score(text, model):
    """The classifier written out position by position."""
    n = -(-len(text) // classify.BLOCK)
    if not n:
        return 1 / (1 + np.exp(-model.intercept))
    padded = text + bytes(n * classify.BLOCK + classify.WIDTH - len(text))
    act = np.array([[sum(float(model.tables[k][padded[p + k]][f]) for k in range(classify.WIDTH)) for f in range(classify.FILTERS)] for p in range(n * classify.BLOCK)]).reshape(n, -1, classify.FILTERS)
    chunks = np.array([np.maximum(act[b:b + 2].reshape(-1, classify.FILTERS).max(0) + model.bias, 0) for b in range(n)])
    mean, top = chunks.mean(0), chunks.max(0)
    return 1 / (1 + np.exp(-(mean @ model.mean + top @ model.top + model.intercept)))


def test_scores_equal_a_plain_convolution_in_any_company():
    rng = np.random.default_rng(4)
    model = classify.Model(rng.normal(0, 0.3, (classify.WIDTH, 256, classify.FILTERS)), rng.normal(0, 0.1, classify.FILTERS),
                           rng.normal(0, 0.3, classify.FILTERS), rng.normal(0, 0.3, classify.FILTERS), -0.2)
    texts = [bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 60, 61, 63, 64, 65, 128, 300, 1000)] + [b"same", b"same", b"\0" * 64]
    want = [plain_score(t, model) for t in texts]
    assert np.allclose(classify.probabilities(texts, model), want, atol=1e-9)
    for order in (list(range(len(texts)))[::-1], rng.permutation(len(texts)).tolist()):
        for step in (1, 3, len(texts)):
            got = np.concatenate([classify.probabilities([texts[i] for i in order[lo:lo + step]], model) for lo in range(0, len(order), step)])
            assert np.allclose(got, [want[i] for i in order], atol=1e-12)


def test_sample_is_the_same_in_any_order(spark):
    rows = [(i, f"text number {i} " * (1 + i % 9), "en", "a", 1) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(8, 0)] * 50, "doc_id bigint, quality int")
    a, b = classify.learn(docs(spark, rows), labels, 40), classify.learn(docs(spark, rows[::-1] + rows[:20]).repartition(5), labels.repartition(7), 40)
    assert all(np.array_equal(x, y) for x, y in zip(a, b))
