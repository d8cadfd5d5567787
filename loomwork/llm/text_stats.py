"""Exact counts over one text, shared by the quality operators. Texts are UTF-8 bytes."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

from loomwork.llm.shared import utf8

SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
SYMBOLS = b"#*$%&|<>"
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def histogram(text: bytes) -> np.ndarray:
    """How often each byte occurs; a block at a time, as bincount widens its input."""
    found = np.zeros(256, dtype=np.int64)
    for at in range(0, len(text), 1 << 20):
        found += np.bincount(np.frombuffer(text, np.uint8, min(1 << 20, len(text) - at), at), minlength=256)
    return found


def word_ids(words: list[bytes]) -> np.ndarray:
    """An id for each word, equal for equal words and less than the number of words."""
    first: dict[bytes, int] = {}
    return np.fromiter(map(first.setdefault, words, count()), dtype=np.int64, count=len(words))


def repeated_words(ids: np.ndarray, width: int = 3) -> int:
    """Words inside windows of ``width`` words that occur twice or more, the first occurrence included."""
    if len(ids) < width + 1:
        return 0
    code, bound = ids, len(ids)
    for k in range(1, width):
        if bound * len(ids) >= 1 << 63:  # codes that would overflow are numbered anew
            code, bound = np.unique(code, return_inverse=True)[1], len(ids)
        code, bound = code[:-1] * len(ids) + ids[k:], bound * len(ids)
    order = np.argsort(code, kind="stable")
    same = code[order][1:] == code[order][:-1]
    twice = np.zeros(len(code), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(ids), dtype=bool)
    for k in range(width):
        covered[k : k + len(code)] |= twice
    return int(covered.sum())


def duplicate_lines(text: bytes) -> int:
    """Lines that hold a word and equal an earlier line."""
    seen: set[bytes] = set()
    found = 0
    for line in text.split(b"\n"):
        if line in seen:
            found += 1
        elif line.strip(SPACES):
            seen.add(line)
    return found


def stats_of(text: bytes) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of one text."""
    words, bytes_of = text.split(), histogram(text)
    chars = int(bytes_of.sum() - bytes_of[0x80:0xC0].sum() - bytes_of[list(SPACES)].sum())
    return len(words), chars, int(bytes_of[list(SYMBOLS)].sum()), duplicate_lines(text), repeated_words(word_ids(words))


def text_stats(text: Column) -> Column:
    """Struct of ``STATS`` (longs) of a text column; null is the empty text."""

    @arrow_udf(", ".join(f"{n} long" for n in STATS))
    def of(texts: pa.Array) -> pa.Array:
        found = np.array([stats_of(t) for t in utf8(texts)], dtype=np.int64).reshape(-1, len(STATS))
        return pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(len(STATS))], names=list(STATS))

    return of(text)
