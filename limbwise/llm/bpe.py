"""BPE encoding and decoding with reuse of content-defined chunks (operator 5).

A text is cut after words chosen by a rolling hash of the bytes before the white space, so
equal passages fall into equal chunks wherever they stand. A chunk that the task has met before is taken from a
bounded table; a new one is assembled from pieces (letters up to a mark, or marks), and each distinct piece is
encoded and decoded once. Pieces are cut where no word of the tokenizer can cross: at ASCII white space, and between an
ASCII letter or digit and an ASCII mark outside the contents of special tokens. (Nothing composes with the ASCII
character before it, and no alternative of the split pattern has white space, or a mark after a letter or digit.) That rests on the
tokenizer's normalizer and pattern, so they are compared with the known ones; texts of another tokenizer are encoded
whole. Where two chunks meet, the pieces on both sides are re-encoded as one text, once for each distinct pair of
pieces, and compared; a text with a join that disagrees is encoded whole. Ids and decoded text equal
those of the tokenizers library for the whole text.

Reuse stays within a task: sending chunks to where their ids are kept would shuffle every text twice.

Null text is encoded as empty: no ids, empty decoded text. A table is emptied when it is full, so
memory does not grow with the input.
"""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limbwise.llm.words import give_back

ENCODED = T.StructType([T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()),
                        T.StructField("decoded", T.StringType())])
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: ASCII letters and digits; ASCII marks. Controls and bytes above ASCII are neither
_ALNUM, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[[i for i in range(33, 127) if chr(i).isalnum()]] = True
_MARK[[i for i in range(33, 127) if not chr(i).isalnum()]] = True
#: What the rule of cuts is proved for
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_GEAR = np.random.default_rng(5).integers(0, 1 << 32, 256, dtype=np.uint64)
WINDOW = 6


def rolled(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rolling hash of the ``WINDOW`` bytes before each offset."""
    out = np.zeros(len(at), np.uint64)
    for back in range(1, WINDOW + 1):
        out += np.where(at >= back, _GEAR[raw[np.maximum(at - back, 0)]], np.uint64(0)) << np.uint64(back)
    return out >> np.uint64(24)


def known_cuts(tokenizer: dict) -> bool:
    """Is the rule of cuts proved for this tokenizer."""
    split, *after = (tokenizer.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    added = tokenizer.get("added_tokens") or []
    return ((tokenizer.get("normalizer") or {}).get("normalizers") == _NORMALIZERS
            and split.get("type") == "Split" and split.get("pattern") == {"Regex": _PATTERN} and split.get("behavior") == "Removed" and bool(split.get("invert"))
            and [a.get("type") for a in after] == ["ByteLevel"] and not after[0].get("add_prefix_space") and after[0].get("use_regex") is False
            and not tokenizer.get("decoder") and tokenizer["model"].get("end_of_word_suffix") == "</w>" and not tokenizer["model"].get("dropout")
            and not any(a["normalized"] or a["single_word"] or a["lstrip"] or a["rstrip"] or _SPACE[list(a["content"].encode())].any() for a in added))


class ChunkCoder:
    """Encodes texts. ``pieces`` maps bytes to (32-bit little-endian ids, decoded text); ``chunks`` has besides them the bytes up to the
    end of the chunk's first piece and of its last piece, each with ids; ``joins`` tells whether a last piece and the bytes after it agree."""

    def __init__(self, tokenizer: str, bits: int = 5, most_chunks: int = 40_000, most_pieces: int = 600_000, most_joins: int = 100_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        names = self.tokenizer.get_vocab()
        self.names = [self.tokenizer.id_to_token(i) or "" for i in range(max(names.values()) + 1)]
        self.ends = [n.endswith("</w>") for n in self.names]
        self.mask, self.most_chunks, self.most_pieces, self.most_joins = np.uint64((1 << bits) - 1), most_chunks, most_pieces, most_joins
        spec = json.loads(tokenizer)
        self.cuts = known_cuts(spec)
        self.special = [a["content"].encode() for a in spec.get("added_tokens") or []]
        self.chunks: dict[bytes, tuple[bytes, str, bytes, bytes, bytes, bytes]] = {}
        self.pieces: dict[bytes, tuple[bytes, str]] = {}
        self.joins: dict[bytes, bool] = {}

    def chunk_ends(self, data: bytes) -> list[int]:
        raw = np.frombuffer(data, np.uint8)
        space = _SPACE[raw]
        cut = np.flatnonzero(space[1:] & ~space[:-1]) + 1
        cut = cut[rolled(raw, cut) & self.mask == 0]
        return [0, *cut.tolist(), len(data)]

    def piece_spans(self, data: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pieces of a text."""
        raw = np.frombuffer(data, np.uint8)
        word = ~_SPACE[raw]
        start = word.copy()
        start[1:] &= ~word[:-1]
        inner = np.zeros(len(raw), bool)
        inner[1:] = _MARK[raw[1:]] & _ALNUM[raw[:-1]]
        for content in self.special:
            at = data.find(content)
            while at >= 0:
                inner[at + 1:at + len(content)] = False
                at = data.find(content, at + 1)
        end = word & ~np.concatenate((word[1:], [False]))
        return np.flatnonzero(start | inner), np.sort(np.concatenate((np.flatnonzero(end) + 1, np.flatnonzero(inner))))

    def keep(self, piece: bytes, ids: list[int]) -> None:
        self.pieces[piece] = (array("I", ids).tobytes(), " ".join([self.names[i] for i in ids]))

    def learn(self, new: list[bytes]) -> None:
        """Encode pieces. A piece of letters alone ends in one word end, so many are encoded as one
        text; the tokenizer ignores case, so such a piece may share the entry of its lower-case form."""
        letters, rest, low, pieces = {}, [], [], self.pieces
        for piece in new:
            text = piece.decode("utf-8", "surrogatepass")
            if not text.isalpha():
                rest.append((piece, text))
                continue
            plain = piece.lower()
            if plain != piece:
                low.append((piece, plain))
            if plain not in pieces:
                letters[plain] = plain.decode("utf-8", "surrogatepass")
        todo = list(letters.items())
        for lo in range(0, len(todo), 64):
            group = todo[lo:lo + 64]
            ids = self.tokenizer.encode(" ".join([t for _, t in group]), add_special_tokens=False).ids
            ends = [i for i, x in enumerate(ids, 1) if self.ends[x]]
            if len(ends) != len(group):
                rest.extend(group)
                continue
            at = 0
            for (piece, _), end in zip(group, ends):
                self.keep(piece, ids[at:end])
                at = end
        if rest:
            for (piece, _), one in zip(rest, self.tokenizer.encode_batch([t for _, t in rest], add_special_tokens=False)):
                self.keep(piece, one.ids)
        for piece, plain in low:
            pieces[piece] = pieces[plain]

    def assemble(self, new: list[bytes]) -> None:
        """Encode new chunks from their pieces, all in one pass over their bytes."""
        data = b"\n".join(new)
        starts, ends = self.piece_spans(data)
        found = [data[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        missing = list(dict.fromkeys(p for p in found if p not in self.pieces))
        if len(self.pieces) + len(missing) > self.most_pieces:
            self.pieces.clear()
            missing = list(dict.fromkeys(found))
        self.learn(missing)
        parts = [self.pieces[p] for p in found]
        if len(self.chunks) + len(new) > self.most_chunks:
            self.chunks.clear()
        offsets = np.cumsum([0] + [len(c) + 1 for c in new])
        firsts = np.searchsorted(starts, offsets).tolist()
        for chunk, a, b in zip(new, firsts, firsts[1:]):
            own = parts[a:b]
            sides = (chunk[:chunk.index(found[a]) + len(found[a])], own[0][0], found[b - 1], own[-1][0]) if own else (b"",) * 4
            self.chunks[chunk] = (b"".join([p[0] for p in own]), " ".join([p[1] for p in own if p[0]]), *sides)

    def joined(self, split: list[list[bytes]]) -> list[bool]:
        """Do all joins of chunks agree, by text; the pieces around each new join are re-encoded."""
        asked, new = [], {}
        for chunks in split:
            parts = [self.chunks[c] for c in chunks]
            asked.append(keys := [])
            for left, right in zip(parts, parts[1:]):
                if left[4] and right[2]:
                    keys.append(key := left[4] + right[2])
                    if key not in self.joins:
                        new[key] = left[5] + right[3]
        for key, one in zip(new, self.tokenizer.encode_batch([k.decode("utf-8", "surrogatepass") for k in new], add_special_tokens=False)):
            self.joins[key] = array("I", one.ids).tobytes() == new[key]
        agreed = [all([self.joins[k] for k in keys]) for keys in asked]
        if len(self.joins) > self.most_joins:
            self.joins.clear()
        return agreed

    def whole(self, text: str) -> tuple[bytes, int, str]:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return array("I", ids).tobytes(), len(ids), self.tokenizer.decode(ids, skip_special_tokens=False)

    def encode(self, texts: list[str | None]) -> list[tuple[bytes, int, str]]:
        if not self.cuts:
            return [self.whole(text or "") for text in texts]
        split = []
        for text in texts:
            data = (text or "").encode("utf-8", "surrogatepass")
            ends = self.chunk_ends(data) if data else [0]
            split.append([data[a:b] for a, b in zip(ends, ends[1:])])
        new = dict.fromkeys(c for chunks in split for c in chunks if c not in self.chunks)
        if len(self.chunks) + len(new) > self.most_chunks:
            self.chunks.clear()
            new = dict.fromkeys(c for chunks in split for c in chunks)
        if new:
            self.assemble(list(new))
        agreed = self.joined(split)
        out = []
        for text, chunks, good in zip(texts, split, agreed):
            parts = [self.chunks[c] for c in chunks]
            if not good:
                out.append(self.whole(text or ""))
                continue
            ids = b"".join([p[0] for p in parts])
            out.append((ids, len(ids) // 4, " ".join([p[1] for p in parts if p[0]])))
        return out


def encoded(text: Column, tokenizer: str, bits: int = 5, rows: int = 256) -> Column:
    """Struct of ``token_ids``, ``n_tokens`` and ``decoded``; ``tokenizer`` is the JSON of one."""

    @F.pandas_udf(ENCODED)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = ChunkCoder(tokenizer, bits)
        for texts in batches:
            for at in range(0, len(texts), rows):
                yield pd.DataFrame(coder.encode(texts.iloc[at:at + rows].tolist()), columns=ENCODED.names)
            texts = None
        coder = None
        give_back()
    return run(text)


def tokenizer_json(path: str | None = None) -> str:
    """The tokenizer file's text; a few MB, sent with the task. ``path`` defaults to the installed public one."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``doc_id`` with its ids, their number and the text decoded from them."""
    return docs.select("doc_id", encoded(F.col("text"), tokenizer).alias("e")).select("doc_id", "e.*")


def digests(coded: DataFrame) -> DataFrame:
    return coded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"),
                        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_json()))
