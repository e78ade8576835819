"""Words, hashes and typed inputs shared by the operators.

A word is a longest run of characters other than space, tab, line feed, vertical tab, form
feed and carriage return; ``bytes.split()`` splits on exactly these six.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_array(text: Column) -> Column:
    """Words of a text in the JVM; a null text has none. Without tabs and the like it is split at blanks, which needs no pattern."""
    text = F.coalesce(text, F.lit(""))
    rare = F.lit(False)
    for c in "\t\x0b\x0c\r":
        rare = rare | F.contains(text, F.lit(c))
    return F.array_remove(F.when(rare, F.split(text, GAP)).otherwise(F.split(F.replace(text, F.lit("\n"), F.lit(" ")), " ")), "")


def word_count(text: Column) -> Column:
    """Number of words of a text."""
    return F.size(word_array(text)).cast("bigint")


def crc_mod(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % by


class HashCache(dict):
    """word -> 64-bit hash, computed once per word; emptied when it holds ``most`` words."""

    def __init__(self, most: int = 1_000_000, make: Callable[[bytes], int] | None = None):
        import xxhash

        super().__init__()
        self.most, self.make = most, make or xxhash.xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.make(word)
        return value

    def of(self, found: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def give_back() -> None:
    """Freed memory goes back to the system: a worker stays with its executor after the task, beside the next stages."""
    for pool in (pa.default_memory_pool(), pa.system_memory_pool()):
        pool.release_unused()


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names that the frame does not have yet, one for each of ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out
