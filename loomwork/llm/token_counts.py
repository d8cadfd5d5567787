"""Edit-aware token counts: a segment tree of pre-tokens for each document, updated where edits touch it.

Leaves are runs of pre-tokens with their characters and tokens; inner nodes
are sums. Pre-tokens do not depend on what stands before their start, and on
two characters beyond their end at most. So an edit is counted by splitting
anew from the last leaf that ends two characters before it, up to the first
old leaf boundary after it that is a boundary still; the leaves between take
the new pre-tokens, and the sums above them are updated. Edits of one text are
applied in one walk, which copies the text once. Strings of special tokens are
ordinary text here.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.bpe import TrieEncoder, encoder_of, in_blocks, send_vocabulary
from loomwork.llm.shared import pick

#: Pre-tokens in a leaf when a tree is built, and from which its tree is built anew.
LEAF, CROWDED = 32, 256
#: Characters beyond its end that a pre-token may depend on.
CONTEXT = 2

EDITS = "array<struct<start:int,stop:int,text:string>>"


class Counter:
    """Token counts of pre-tokens, from the shared trie encoder's memory."""

    def __init__(self, encoder: TrieEncoder) -> None:
        self.encoder, self.finditer, self.findall = encoder, encoder.v.words.finditer, encoder.v.words.findall

    def learn(self, words: Sequence[Sequence[str]]) -> None:
        self.encoder.remember({w for part in words for w in part})

    def count(self, words: Sequence[str]) -> np.ndarray:
        return np.fromiter(map(len, map(self.encoder.known.__getitem__, words)), dtype=np.int64, count=len(words)) // 4


@dataclass
class Tree:
    """``sums[1]`` is the root, ``sums[size + k]`` leaf k: rows of (characters, tokens, pre-tokens)."""

    size: int
    leaves: int
    sums: np.ndarray

    @classmethod
    def of(cls, rows: np.ndarray) -> Tree:
        size = 1 << max(len(rows) - 1, 0).bit_length()
        sums = np.zeros((2 * size, 3), dtype=np.int64)
        sums[size : size + len(rows)] = rows
        level = size
        while level > 1:
            sums[level // 2 : level] = sums[level : 2 * level].reshape(-1, 2, 3).sum(axis=1)
            level //= 2
        return cls(size, max(len(rows), 1), sums)

    @classmethod
    def build(cls, words: Sequence[str], tokens: np.ndarray) -> Tree:
        if not len(words):
            return cls.of(np.zeros((1, 3), dtype=np.int64))
        cuts = np.arange(0, len(words), LEAF)
        chars = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        return cls.of(np.stack([np.add.reduceat(chars, cuts), np.add.reduceat(tokens, cuts), np.diff(np.append(cuts, len(words)))], axis=1))

    def packed(self) -> bytes:
        """Its leaves; the sums above them follow."""
        return self.sums[self.size : self.size + self.leaves].astype("<i8").tobytes()

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        return cls.of(np.frombuffer(data, dtype="<i8").reshape(-1, 3))

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, place: int) -> tuple[int, int]:
        """(leaf, characters before it) of the first leaf that ends after ``place``; the last leaf if none does."""
        if place >= self.chars:
            return self.leaves - 1, self.chars - int(self.sums[self.size + self.leaves - 1, 0])
        node, before = 1, 0
        while node < self.size:
            node *= 2
            if place >= before + self.sums[node, 0]:
                before += int(self.sums[node, 0])
                node += 1
        return node - self.size, before

    def put(self, leaf: int, row: Sequence[int]) -> None:
        node = self.size + leaf
        change = np.array(row, dtype=np.int64) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


def build_tree(text: str, counter: Counter) -> Tree:
    words = counter.findall(text)
    counter.learn([words])
    return Tree.build(words, counter.count(words))


class Walk:
    """The edited text of a region, read from the old text and its edits piece by piece, so that no edit copies the text.

    ``buffer`` begins at the old place ``at``; it holds all edits that end by
    ``upto`` and the old text up to there.
    """

    def __init__(self, text: str, edits: Sequence[tuple[int, int, str]], at: int, edit: int) -> None:
        self.text, self.edits, self.at, self.edit, self.upto, self.buffer = text, edits, at, edit, at, ""
        self.passed, self.shift = edit, 0  # edits that end by the last boundary asked for, and what they add

    def fill(self, upto: int) -> None:
        pieces = [self.buffer]
        while self.edit < len(self.edits) and (self.edits[self.edit][0] < upto or self.edits[self.edit][1] <= upto):
            start, stop, new = self.edits[self.edit]
            pieces += self.text[self.upto : start], new
            self.upto, self.edit = stop, self.edit + 1
        if upto > self.upto:
            pieces.append(self.text[self.upto : upto])
            self.upto = min(upto, len(self.text))
        self.buffer = "".join(pieces)

    @property
    def whole(self) -> bool:
        return self.upto >= len(self.text) and self.edit == len(self.edits)

    def boundary(self, old: int) -> int:
        """Where an old place is in the buffer; places are asked for in order."""
        while self.passed < len(self.edits) and self.edits[self.passed][1] <= old:
            start, stop, new = self.edits[self.passed]
            self.shift += len(new) - (stop - start)
            self.passed += 1
        return old - self.at + self.shift

    def calm(self, old: int) -> bool:
        """No edit reaches over an old place that boundary() was just asked for, or changes what its pre-token may depend on."""
        return self.passed == len(self.edits) or self.edits[self.passed][0] >= old + CONTEXT


def edit_all(tree: Tree, text: str, edits: Sequence[tuple[int, int, str]], counter: Counter) -> tuple[Tree, str, int]:
    """(tree, text, characters split anew) after all ``edits`` (start, stop, new) at places of ``text``, which do not overlap, at once; the tree given is changed or replaced.

    One walk over the edits, in time linear in the text and the edits, however
    many there are: between edits that are far apart nothing is looked at, and
    the window of a region grows until old and new boundaries meet.
    """
    edits = sorted(edits, key=lambda e: (e[0], e[1]))
    reach = 0
    for start, stop, _ in edits:
        if not reach <= start <= stop <= len(text):
            raise ValueError(f"no such place, or one of another edit: {start} to {stop} of {len(text)}")
        reach = stop
    if not edits:
        return tree, text, 0
    lengths = tree.sums[tree.size : tree.size + tree.leaves, 0]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    regions: list[tuple[int, int, list[str]]] = []
    work, edit = 0, 0
    while edit < len(edits):
        first = max(int(np.searchsorted(starts, edits[edit][0] - CONTEXT, "right")) - 1, 0)
        walk, last, words, place, step = Walk(text, edits, int(starts[first]), edit), first, [], 0, 64
        met = False
        while not met:
            walk.fill(max(walk.upto, int(ends[last])) + step)
            step *= 2
            rest = place
            for m in counter.finditer(walk.buffer, rest):
                if m.end() + CONTEXT > len(walk.buffer) and not walk.whole:
                    break
                words.append(m.group())
                place = m.end()
                while (at := walk.boundary(int(ends[last]))) < place and last + 1 < tree.leaves:
                    last += 1
                if at == place and walk.calm(int(ends[last])):
                    met = True
                    break
            if walk.whole and not met and place == len(walk.buffer):
                last, met = tree.leaves - 1, True
                walk.boundary(len(text))
        regions.append((first, last, words))
        work, edit = work + place, walk.passed
    counter.learn([w for _, _, w in regions])
    rows, done, put = [], 0, []
    old = tree.sums[tree.size : tree.size + tree.leaves].copy()
    for first, last, words in regions:
        tokens, room = counter.count(words), last - first + 1
        if len(words) <= CROWDED * room:
            cuts = [len(words) * k // room for k in range(room + 1)]
            made = np.array([(sum(map(len, words[a:b])), int(tokens[a:b].sum()), b - a) for a, b in zip(cuts, cuts[1:], strict=False)], dtype=np.int64)
        else:
            middle = Tree.build(words, tokens)
            made = middle.sums[middle.size : middle.size + middle.leaves]
        rows += old[done:first], made
        put.append((first, made, room))
        done = last + 1
    if all(len(made) == room for _, made, room in put) and 8 * sum(room for _, _, room in put) < tree.leaves:
        for first, made, _ in put:  # few leaves: only the sums above them
            for k, row in enumerate(made):
                tree.put(first + k, row)
    else:
        tree = Tree.of(np.concatenate([*rows, old[done:]]))
    pieces, upto = [], 0
    for start, stop, new in edits:
        pieces += text[upto:start], new
        upto = stop
    return tree, "".join([*pieces, text[upto:]]), work


def edit_tree(tree: Tree, text: str, start: int, stop: int, new: str, counter: Counter) -> tuple[Tree, str, int]:
    """(tree, text, characters split anew) after text[start:stop] becomes ``new``; the tree given is changed or replaced."""
    return edit_all(tree, text, [(start, stop, new)], counter)


def at_once(edits: Sequence[tuple[int, int, str]]) -> Iterator[list[tuple[int, int, str]]]:
    """Edits that apply one after the other, in lists that may be applied at once: each stands before the one ahead of it in its list."""
    run: list[tuple[int, int, str]] = []
    for e in edits:
        if run and e[1] > run[-1][0]:
            yield run
            run = []
        run.append(e)
    if run:
        yield run


def trees(text: Column, vocabulary_text) -> Column:
    """Packed trees of a text column; null is the empty text."""

    @F.arrow_udf("binary")
    def of(texts: pa.Array) -> pa.Array:
        counter, out = Counter(encoder_of(vocabulary_text)), []
        for block in in_blocks(texts):
            words = [counter.findall(t) for t in block]
            counter.learn(words)
            out += [Tree.build(w, counter.count(w)).packed() for w in words]
        return pa.array(out, pa.binary())

    return of(text)


UPDATED = "n_tokens_before long, n_tokens long, n_chars long, n_edits int, recounted_chars long, text string, tree binary"


def updated(text: Column, tree: Column, edits: Column, vocabulary_text) -> Column:
    """``UPDATED`` struct after edits, applied in order, each at places of the text the ones before it left.

    Edits that each stand before the one ahead of them are applied at once; a
    text is copied once for each such run of them.
    """

    @F.arrow_udf(UPDATED)
    def of(texts: pa.Array, packed: pa.Array, changes: pa.Array) -> pa.Array:
        counter, rows = Counter(encoder_of(vocabulary_text)), []
        for value, data, todo in zip(texts, packed, changes, strict=True):
            now, t = value.as_py() or "", Tree.unpacked(data.as_py())
            before, work, todo = t.tokens, 0, todo.as_py() or []
            for run in at_once([(e["start"], e["stop"], e["text"] or "") for e in todo]):
                t, now, n = edit_all(t, now, run, counter)
                work += n
            rows.append((before, t.tokens, t.chars, len(todo), work, now, t.packed()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.binary())
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[f.split(" ")[0] for f in UPDATED.split(", ")])

    return of(text, tree, edits)


#: Parts of a mail address, the one before the @ from its end.
MAIL_NAME, MAIL_HOST = re.compile(r"[\w.+-]+"), re.compile(r"@[\w-]+(?:\.[\w-]+)+")
#: What telephone numbers are made of, in runs that have room for one; one begins at a digit, + or (, ends at a digit and has 9 characters or more.
PHONE_PARTS, PHONE_LENGTH = re.compile(r"\+?[\d ().-]{8,}"), 9
KEY, KEY_LENGTH = re.compile(r"(?<!\w)\w{32,}"), 32


def scrub_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that replace mail addresses, telephone numbers and long keys, the last place first, so that the places of the others stay true.

    Of overlapping finds the one that starts first stays, of these the longer.
    Time is linear in the text: between two @ all is looked at once from either
    side, and a run of digits and separators is trimmed, not searched.
    """
    found: list[tuple[int, int, str]] = []
    last, place = 0, text.find("@")
    while place >= 0:
        name, host = MAIL_NAME.match(text[last:place][::-1]), MAIL_HOST.match(text, place)
        if name and host:
            found.append((place - len(name[0]), host.end(), "<email>"))
        last, place = place + 1, text.find("@", place + 1)
    for m in PHONE_PARTS.finditer(text):
        number = m[0].rstrip(" ().-+")
        start = m.end() - len(m[0].lstrip(" ).-"))
        if m.start() + len(number) - start >= PHONE_LENGTH:
            found.append((start, m.start() + len(number), "<phone>"))
    if max(map(len, text.split()), default=0) >= KEY_LENGTH:
        found += [(m.start(), m.end(), "<key>") for m in KEY.finditer(text)]
    kept: list[tuple[int, int, str]] = []
    for e in sorted(found, key=lambda e: (e[0], -e[1])):
        if not kept or e[0] >= kept[-1][1]:
            kept.append(e)
    return kept[::-1]


def scrubbing(text: Column) -> Column:
    """``EDITS`` column of what scrub_edits() finds; null has none."""

    @F.arrow_udf(EDITS)
    def of(texts: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string())]))
        return pa.array([[{"start": a, "stop": b, "text": c} for a, b, c in scrub_edits(v.as_py() or "")] for v in texts], kind)

    return of(text)


COUNTED = "n_tokens_before long, n_tokens long, n_edits int, n_chars long, recounted_chars long, text_sha256 string"


def count_scrubbed(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ``COUNTED`` of every row of ``docs`` (doc_id, text) after scrubbing; text_sha256 is of the scrubbed text.

    Trees are built, edits found and counts updated in one pass without a
    shuffle. Null is the empty text; very long texts are counted whole, in
    linear time however many edits they take; an empty table gives no row;
    repeated rows come back as often; other columns are not read.
    """
    sent = send_vocabulary(docs.sparkSession, path)

    @F.arrow_udf(COUNTED)
    def of(texts: pa.Array) -> pa.Array:
        counter, rows = Counter(encoder_of(sent)), []
        for block in in_blocks(texts):
            words = [counter.findall(t) for t in block]
            counter.learn(words)
            known = counter.encoder.known.__getitem__
            # Only a text with edits needs a tree; trees are made before any edit, as what they count may be forgotten then.
            found = [scrub_edits(now) for now in block]
            built = [Tree.build(w, counter.count(w)) if edits else sum(map(len, map(known, w))) // 4 for w, edits in zip(words, found, strict=True)]
            for now, edits, made in zip(block, found, built, strict=True):
                if edits:
                    before = made.tokens
                    tree, now, work = edit_all(made, now, edits, counter)
                    after, chars = tree.tokens, tree.chars
                else:
                    before, after, chars, work = made, made, len(now), 0
                rows.append((before, after, len(edits), chars, work, hashlib.sha256(now.encode()).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        return pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=[f.split(" ")[0] for f in COUNTED.split(", ")])

    return pick(docs, "doc_id", "text").select("doc_id", of(F.col("text")).alias("c")).select("doc_id", "c.*")
