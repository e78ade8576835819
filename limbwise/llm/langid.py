"""Language identification by cross-parsing entropy (operator 8).

For each language a bounded sample of labelled text becomes a suffix automaton. A text is
parsed greedily into the longest phrases that occur in the sample; a language explains the
text by so many phrases, each costing log2 of the sample's length in bits. The language with
the fewest bits per symbol wins; ties go to the smaller name. Texts are cut into
pieces of ``PIECE`` symbols, each beginning a new phrase, so that an automaton walks all pieces
of a batch one symbol at a time as arrays.

Symbols: lower-cased letters; any run of other characters is one blank. Every symbol of the samples has its own
number. In each language the ``DENSE`` most frequent ones are columns of a table, the transitions by others are looked
up in a sorted array, so large scripts cost no wide tables. A symbol that a sample does not hold is a phrase by itself.

Sample: all languages; of each, ``rows`` rows by hash of the id and ``most_symbols`` symbols of them, fewer where the tables of
all languages would pass ``TABLE_BYTES``. Each picked row gives an equal share of the symbols, in spans spread over its text; what short
rows leave goes to the others. Everything else reads whole texts.

Null text or a text without a letter: ``und``, score 0. No labelled row at all: ``und``
for every text. Null ids are never trained on. Repeated rows get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limbwise.llm.words import crc_mod
from limbwise.sources.workspace import cut

PIECE = 192
#: Of the tables of all languages, and of a symbol in them at most (two states); symbols in a row that a sample takes from a text
TABLE_BYTES, SYMBOL_BYTES, SPAN = 200_000_000, 256, 50
#: Columns of a table: the most frequent symbols of the language, its other symbols (looked up), symbols it does not have
DENSE, OTHER, NONE, ALPHABET = 62, 62, 63, 64
FOUND = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])


class Sample(NamedTuple):
    """The automaton of a language. Its symbols are numbered by falling frequency."""

    symbols: np.ndarray        # number in the language -> number over all
    table: np.ndarray          # (state, column) -> state; 0 none, 1 the root
    root: np.ndarray           # number in the language -> state
    keys: np.ndarray           # sorted: state * symbols + number in the language, for numbers from DENSE on
    to: np.ndarray             # states to these
    bits: float                # of a phrase


class Model(NamedTuple):
    langs: list[str]
    own: dict[int, int]        # code point -> number over all, from 1
    samples: list[Sample]


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


class Letters:
    """Is a code point a letter; a table below 65536, asked for the rest."""

    def __init__(self):
        self.low = np.fromiter((chr(i).isalpha() for i in range(65536)), bool, 65536)

    def __call__(self, codes: np.ndarray) -> np.ndarray:
        out = self.low[np.minimum(codes, 65535)]
        for at in np.flatnonzero(codes > 65535):
            out[at] = chr(int(codes[at])).isalpha()
        return out


def with_blanks(codes: np.ndarray, letters: Letters) -> np.ndarray:
    """Code points with each run of other characters replaced by one 32."""
    is_letter = letters(codes)
    codes = np.where(is_letter, codes, np.uint32(32))
    keep = is_letter.copy()
    if len(keep):
        keep[0] = True
        keep[1:] |= is_letter[:-1]
    return codes[keep]


def symbols(codes: np.ndarray, table: np.ndarray) -> np.ndarray:
    return table[codes]


def symbol_table(own: dict[int, int]) -> np.ndarray:
    """Code point -> number over all; 0 where no sample holds it."""
    table = np.zeros(0x110000, np.int32)
    for code, at in own.items():
        table[code] = at
    return table


def transitions(found: np.ndarray) -> list[dict[int, int]]:
    """Suffix automaton: symbol -> state, by state; the root is 1, 0 is none."""
    go: list[dict[int, int]] = [{}, {}]
    link, length, last = [0, 0], [0, 0], 1
    for s in found.tolist():
        new = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(1)
        p = last
        while p and s not in go[p]:
            go[p][s] = new
            p = link[p]
        if p:
            q = go[p][s]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(go)
                go.append(dict(go[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p and go[p].get(s) == q:
                    go[p][s] = twin
                    p = link[p]
        last = new
    return go


def tabled(go: list[dict[int, int]], states: int) -> np.ndarray:
    """(state, symbol) -> state of the ``DENSE`` first symbols."""
    out = np.zeros((states, ALPHABET), np.uint16 if states <= 65536 else np.uint32)
    for state, edges in enumerate(go):
        for s, to in edges.items():
            if s < DENSE:
                out[state, s] = to
    return out


def automaton(found: np.ndarray, states: int) -> np.ndarray:
    """Suffix automaton of the ``DENSE`` first symbols as a table (state, symbol) -> state."""
    return tabled(transitions(found), states)


def sample(found: np.ndarray) -> Sample:
    """The automaton of a language whose text is given as numbers over all."""
    distinct, inverse, counts = np.unique(found, return_inverse=True, return_counts=True)
    order = np.argsort(-counts, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    go = transitions(rank[inverse])
    other = sorted((state * len(order) + s, to) for state, edges in enumerate(go) for s, to in edges.items() if s >= DENSE)
    keys, to = np.array(other, np.int64).reshape(-1, 2).T
    root = np.array([go[1][s] for s in range(len(order))], np.int64)
    return Sample(distinct[order], tabled(go, len(go)), root, keys, to, float(np.log2(len(found) + 2)))


def spread(codes: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` symbols of a text, in spans spread evenly over it."""
    if len(codes) <= most:
        return codes
    n = max(1, most // SPAN)
    at = np.linspace(0, len(codes) - most // n, n).astype(int)
    return np.concatenate([codes[i:i + most // n] for i in at.tolist()])


def shares(lengths: list[int], most: int) -> list[int]:
    """What each text gives so that all together give ``most``: equal shares, or the whole text where that is shorter."""
    out, left = [0] * len(lengths), most
    for done, i in enumerate(sorted(range(len(lengths)), key=lambda i: lengths[i])):
        out[i] = min(lengths[i], left // (len(lengths) - done))
        left -= out[i]
    return out


def sampled(texts: list[str], most: int, letters: Letters) -> np.ndarray:
    """Symbols of a language's texts, a blank after each text."""
    found = [with_blanks(code_points(t), letters) for t in texts]
    give = shares([len(x) + 1 for x in found], most)
    return np.concatenate([np.append(spread(x, n - 1), np.uint32(32)) for x, n in zip(found, give) if n] or [np.array([32], np.uint32)])


def build(samples: dict[str, list[str]], most_symbols: int = 24_000) -> Model:
    letters, langs = Letters(), sorted(samples)
    texts = {k: sampled(samples[k], most_symbols, letters) for k in langs}
    own = {code: i for i, code in enumerate(sorted({c for x in texts.values() for c in np.unique(x).tolist()}), 1)}
    table = symbol_table(own)
    return Model(langs, own, [sample(symbols(texts[k], table)) for k in langs])


class Parser:
    """Counts the phrases of texts in every language of a model."""

    def __init__(self, model: Model):
        self.model, self.letters = model, Letters()
        self.table = symbol_table(model.own)
        self.bits = np.array([x.bits for x in model.samples])

    def walk(self, one: Sample, grid: np.ndarray, lives: list[int]) -> np.ndarray:
        """Phrases of the pieces in one language; piece k is column k, and the first ``lives[step]`` pieces are longer than ``step``."""
        column = np.full(len(self.model.own) + 1, NONE, np.int64)
        number, root = np.zeros((2, len(column)), np.int64)
        number[one.symbols] = np.arange(len(one.symbols))
        column[one.symbols] = np.minimum(number[one.symbols], OTHER)
        root[one.symbols] = one.root
        flat, state, count = one.table.reshape(-1), np.ones(grid.shape[1], np.int64), np.ones(grid.shape[1], np.int32)
        for step, live in enumerate(lives):
            g = grid[step, :live]
            at = column[g]
            now = flat[state[:live] * ALPHABET + at].astype(np.int64)
            if len(one.keys):
                lane = np.flatnonzero(at == OTHER)
                asked = state[lane] * len(one.symbols) + number[g[lane]]
                place = np.minimum(np.searchsorted(one.keys, asked), len(one.keys) - 1)
                now[lane] = np.where(one.keys[place] == asked, one.to[place], 0)
            lane = np.flatnonzero(now == 0)
            if len(lane):
                count[lane] += state[lane] != 1
                again = root[g[lane]]
                now[lane] = np.where(again == 0, 1, again)
                count[lane] += again == 0
            state[:live] = now
        return count

    def phrases(self, found: list[np.ndarray]) -> np.ndarray:
        """(text, language) -> phrases of the texts given as symbols."""
        pieces = np.array([-(-len(x) // PIECE) for x in found])
        grid = np.full((int(pieces.sum()), PIECE), -1, np.int32)
        flat, at = grid.reshape(-1), 0
        for x, n in zip(found, pieces.tolist()):
            flat[at:at + len(x)] = x
            at += n * PIECE
        length = (grid >= 0).sum(1)
        order = np.argsort(-length, kind="stable")
        grid, length = np.ascontiguousarray(grid[order].T), length[order]
        lives = np.searchsorted(-length, -np.arange(int(length.max(initial=0))), "left").tolist()
        owner = np.repeat(np.arange(len(found)), pieces)[order]
        return np.stack([np.bincount(owner, self.walk(one, grid, lives), len(found)) for one in self.model.samples], 1)

    def score(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [("und", 0.0)] * len(texts)
        asked, found = [], []
        for i, text in enumerate(texts):
            if text and len(self.model.langs):
                codes = with_blanks(code_points(text), self.letters)
                if len(codes) > 1 or self.letters(codes).any():
                    asked.append(i)
                    found.append(symbols(codes, self.table))
        if not asked:
            return out
        counts = self.phrases(found)
        for i, x, row in zip(asked, found, counts):
            bits = row * self.bits / len(x)
            best = int(np.argmin(bits))
            weight = np.exp2(-(bits - bits[best]) * min(len(x), 200))
            out[i] = (self.model.langs[best], float(1 / weight.sum()))
        return out


def learn(docs: DataFrame, rows: int = 48, most_symbols: int = 24_000) -> Model:
    """Fit on a bounded sample of labelled rows whose id's crc32 modulo 4 is not 2."""
    train = docs.where((crc_mod(F.col("doc_id"), 4) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = cut(train.select("lang", "doc_id").distinct().withColumn("_at", F.row_number().over(by_hash)).where(F.col("_at") <= rows), "language-rows")
    langs = ids.select("lang").distinct().count()
    most = max(1, min(most_symbols, TABLE_BYTES // (SYMBOL_BYTES * max(langs, 1))))

    @F.pandas_udf(T.StringType())
    def part(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        letters = Letters()
        for texts in batches:
            yield texts.map(lambda t: spread(with_blanks(code_points(t), letters), most).tobytes().decode("utf-32-le"))
    # one text of each id; rows * most symbols a language reach the driver at most
    picked = (train.select("lang", "doc_id", "text").join(ids, ["lang", "doc_id"]).select("lang", "_at", part("text").alias("part"))
              .groupBy("lang", "_at").agg(F.min("part").alias("part")))
    samples: dict[str, list[str]] = {}
    for row in sorted(picked.collect(), key=lambda r: (r["lang"], r["_at"])):
        samples.setdefault(row["lang"], []).append(row["part"])
    return build(samples, most)


def identified(text: Column, model, rows: int = 400) -> Column:
    """Struct of ``lang_pred`` and ``score``; ``model`` is a broadcast ``Model``."""

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = Parser(model.value)
        for texts in batches:
            out = []
            for at in range(0, len(texts), rows):
                out.extend(parser.score(texts.iloc[at:at + rows].tolist()))
            yield pd.DataFrame(out, columns=FOUND.names)
    return run(text)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", identified(F.col("text"), shared).alias("l")).select("doc_id", "l.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs)).select(
        "doc_id", F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
