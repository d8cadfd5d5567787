"""BPE encoding by a trie of distinct words that shares the work of common prefixes, and decoding.

The encoding of a prefix of a word is known by its last token alone: the token
t that ends there, fits in front of it the last token of what precedes t, and
no other does. So the state of a trie node is its last token, found from the
states of its ancestors; words that share a prefix share its states, which are
computed once, depth first. A word's tokens are read off backwards, from its
end to the root. Whether two tokens fit is decided once for each pair, by
merging their joined bytes.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from loomwork.llm.shared import pick

#: Pre-tokens of byte-level BPE (fixed value of the file format).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct words, and bytes of words and their ids, that a task remembers before it starts a new trie; results are the same.
MEMORY_WORDS, MEMORY_BYTES = 400_000, 32_000_000
#: Token pairs whose fit a task remembers.
MEMORY_PAIRS = 400_000


def byte_letters() -> dict[str, int]:
    """The printable character that byte-level vocabularies write for each byte, inverted."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Vocabulary:
    """Tokens, merge ranks and added tokens of a byte-level BPE file in the tokenizers library's JSON."""

    def __init__(self, text: str) -> None:
        made = json.loads(text)
        kind = (made.get("pre_tokenizer") or {}).get("type"), made["model"].get("type"), made.get("normalizer")
        if kind != ("ByteLevel", "BPE", None) or made["pre_tokenizer"].get("add_prefix_space") or made["model"].get("ignore_merges"):
            raise ValueError(f"not a plain byte-level BPE: {kind}")
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = made["model"]["vocab"]
        self.added = {t["content"]: t["id"] for t in made.get("added_tokens", [])}
        self.ids = {as_bytes(s): i for s, i in vocab.items() if s not in self.added}
        self.bytes_of = {i: b for b, i in self.ids.items()} | {i: s.encode() for s, i in self.added.items()}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in made["model"]["merges"]]
        self.ranks: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, (a, b) in enumerate(pairs):
            self.ranks[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.longest = max(map(len, self.ids))
        self.words = regex.compile(PATTERN)
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            return cls(f.read())

    def merge(self, word: bytes) -> list[int]:
        """Plain BPE of one word: the pair of least rank merges first, the leftmost of equals. A heap over a linked list."""
        ids = [self.ids[word[k : k + 1]] for k in range(len(word))]
        after, before = [*range(1, len(ids)), -1], [*range(-1, len(ids) - 1)]
        heap = [(*self.ranks[p], k, *p) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.ranks]
        heapq.heapify(heap)
        heap.sort(key=lambda x: (x[0], x[2]))
        while heap:
            _, made, k, a, b = heapq.heappop(heap)
            j = after[k]
            if j < 0 or ids[k] != a or ids[j] != b:
                continue
            ids[k], ids[j] = made, -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for left, right in ((before[k], k), (k, after[k])):
                if left >= 0 and right >= 0 and (p := (ids[left], ids[right])) in self.ranks:
                    heapq.heappush(heap, (*self.ranks[p], left, *p))
        return [i for i in ids if i >= 0]


class TrieEncoder:
    """Encodings of the words met so far, from one depth-first walk of each batch's trie of last-token states."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        # Finds the tokens that end at each place of a word, longest first. One character stands for one byte.
        self.endings = ahocorasick.Automaton()
        for token, i in vocabulary.ids.items():
            self.endings.add_word(token.decode("latin-1"), (len(token), i))
        self.endings.make_automaton()
        self.packed = {i: i.to_bytes(4, "little") for i in vocabulary.bytes_of}
        self.fits: dict[tuple[int, int], bool] = {}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = {}
        self.held = 0

    def fit(self, pair: tuple[int, int]) -> bool:
        """Whether the joined bytes of two tokens, or with -1 in front those of one, merge to just these tokens."""
        if len(self.fits) > MEMORY_PAIRS:
            self.fits.clear()
        a, b = pair
        ids = [b] if a < 0 else [a, b]
        found = self.fits[pair] = self.v.merge(b"".join(self.v.bytes_of[i] for i in ids)) == ids
        return found

    def learn(self, words: Iterable[str]) -> None:
        """Encode distinct words. In sorted order a depth-first walk of their trie is a walk from word to word:
        states of the prefix shared with the last word stay, those below it are dropped and new ones computed."""
        path, last, size, fits = b"", [], [], self.fits  # last[d], size[d]: id and length of the last token of path[: d + 1]
        for word in sorted(w.encode() for w in words):
            have, most = 0, min(len(path), len(word))
            while have < most and path[have] == word[have]:
                have += 1
            del last[have:], size[have:]
            for d, (n, i) in self.endings.iter(word.decode("latin-1")):
                if d == have:  # still without a state: of the tokens that end here the one that fits what its start leaves
                    pair = (last[d - n] if n <= d else -1, i)
                    ok = fits.get(pair)
                    if self.fit(pair) if ok is None else ok:
                        last.append(i)
                        size.append(n)
                        have += 1
            if have != len(word):
                raise ValueError("no token fits: the vocabulary lacks a byte")
            path, ids, d = word, [], len(word) - 1
            while d >= 0:
                ids.append(self.packed[last[d]])
                d -= size[d]
            ids.reverse()
            self.known[word.decode()] = b"".join(ids)
            self.held += len(word) + 4 * len(ids)

    def remember(self, words: set[str]) -> None:
        """See to it that the words are among those known; if memory is full, they alone are."""
        new = words.difference(self.known)
        if len(self.known) + len(new) > MEMORY_WORDS or self.held > MEMORY_BYTES:
            self.forget()
            new = words
        self.learn(new)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; the texts' new words go through one trie."""
        v, split = self.v, []
        for text in texts:
            pieces = v.split.split(text) if v.split else [text]
            split.append([(p, None) if p in v.added else (p, v.words.findall(p)) for p in pieces])
        self.remember({w for pieces in split for _, found in pieces for w in found or ()})
        known = self.known.__getitem__
        return [b"".join(self.packed[v.added[p]] if found is None else b"".join(map(known, found)) for p, found in pieces) for pieces in split]


def in_blocks(texts: pa.Array, characters: int = 2_000_000) -> Iterator[list[str]]:
    """The texts in lists of about so many characters, each text whole; null is the empty text."""
    block, held = [], 0
    for value in texts:
        block.append(value.as_py() or "")
        held += len(block[-1])
        if held >= characters:
            yield block
            block, held = [], 0
    yield block


def decode(ids: np.ndarray, vocabulary: Vocabulary) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD, as the library's decoder writes them."""
    return b"".join(map(vocabulary.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_made: dict[int, TrieEncoder] = {}


def encoder_of(vocabulary_text) -> TrieEncoder:
    """One encoder for each worker process and vocabulary."""
    key = vocabulary_text.value
    if (at := hash(key)) not in _made:
        _made.clear()
        _made[at] = TrieEncoder(Vocabulary(key))
    return _made[at]


def encoded(text: Column, vocabulary_text) -> Column:
    """Binary column of little-endian unsigned 32-bit ids; null is the empty text. Takes a broadcast of the file's text."""

    @arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        encoder = encoder_of(vocabulary_text)
        return pa.array([ids for block in in_blocks(texts) for ids in encoder.encode(block)], pa.binary())

    return of(text)


def decoded(ids: Column, vocabulary_text) -> Column:
    """String column decoded from a column of ids as encoded() makes them."""

    @arrow_udf("string")
    def of(values: pa.Array) -> pa.Array:
        v = encoder_of(vocabulary_text).v
        return pa.array([decode(np.frombuffer(x.as_py() or b"", dtype="<u4"), v) for x in values], pa.string())

    return of(ids)


def send_vocabulary(spark, path: str):
    """Broadcast of a tokenizer file's text: 1 to 2 MB, whatever the corpus."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs`` (doc_id, text; no other column is read).

    Each text is encoded and its ids are decoded again in the same task, with
    no shuffle. Null is the empty text; very long texts are encoded whole;
    repeated rows come back as often; an empty table gives no row.
    """
    sent = send_vocabulary(docs.sparkSession, path)

    @arrow_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def digests(texts: pa.Array) -> pa.Array:
        encoder = encoder_of(sent)
        n, of_ids, of_text = [], [], []
        for ids in (ids for block in in_blocks(texts) for ids in encoder.encode(block)):
            n.append(len(ids) // 4)
            of_ids.append(hashlib.sha256(ids).hexdigest())
            of_text.append(hashlib.sha256(decode(np.frombuffer(ids, dtype="<u4"), encoder.v).encode()).hexdigest())
        return pa.StructArray.from_arrays([pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

    return pick(docs, "doc_id", "text").select("doc_id", digests(F.col("text")).alias("d")).select("doc_id", "d.*")
