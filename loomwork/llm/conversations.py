"""Conversation structure repair: cheapest edits by a Viterbi search whose survivors emit what they agree on.

A conversation is repaired when its role initials read ``(s?(ua)+)?``. Rows are
kept, given another role, or deleted, and empty turns are inserted; the state
after a row says what may follow: 0 (nothing yet), s, u or a. The best path to
each state (its survivor) is a branch of a tree of backpointers. A node counts
the references to it; branches that no survivor needs are freed, and once all
survivors share an ancestor, the edits up to it are emitted and dropped.

Paths to states after the same row end in an edit of that row, so of two of
them neither is the beginning of the other, and the order of their audits
settles all ties that follow. It is kept as a rank of each survivor, renewed
with every row: equal costs are decided by their complete audits.

Rows are range-partitioned in order, so a conversation may span tasks. A task
searches a conversation in blocks: the first block from every state it may be
entered in, and what a block does (costs, ranks and exits by entry) is a few
numbers, from which the way through all blocks is found.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from loomwork.llm.shared import materialize, pick

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows without agreement after which a block is closed, so that what a task holds stays bounded.
UNRESOLVED = 10_000
#: States by number, and the number of states.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
BLANK = r"[^\x20\x09-\x0D]"
KEY = ("conv_id", "turn", "role", "digest")


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``conversations`` with faults by crc32(``conv_id:turn``) % 20: 0 drops the row, 1 empties its text, 2 removes its ``.!?``, 3 repeats it, 4 makes its role user.

    Null roles and texts are one space, as null ids and turns are in the hashed text.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = pick(conversations, "conv_id", "turn", "role", "text").withColumn("fault", fault).filter("fault != 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate(blank("text"), ".!?", "")).otherwise(blank("text"))
    made = rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(blank("role")).alias("role"), text.alias("text"), "fault")
    return made.withColumn("copy", F.explode(F.expr("sequence(1, if(fault = 3, 2, 1))"))).drop("fault", "copy")


def faults(rows: DataFrame) -> DataFrame:
    """``KEY`` columns, n, fault of each distinct row (conv_id, turn, role, text): n rows are equal; digest is the text's SHA-256.

    ``fault`` is of the first of them: blank, duplicate (its role and text
    stand at a lesser turn of the conversation), truncated or none. Texts are
    not shuffled; equal rows are counted before they are, and the first place
    of a text is a minimum, so neither a hot row nor a hot text makes a large task.
    """
    text = F.col("text")
    last = F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*+\z", 1)
    told = rows.select("conv_id", "turn", "role", F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), F.when(last == "", "blank").when(~last.isin(".", "!", "?"), "truncated").otherwise("none").alias("own"))
    each = materialize(told.groupBy(*KEY).agg(F.count("*").alias("n"), F.max("own").alias("own")), "conversation-rows")
    place = F.struct(F.col("turn").isNotNull().alias("there"), "turn")
    first = each.groupBy("conv_id", "role", "digest").agg(F.min(place).alias("first"))
    same = F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("e.role") == F.col("f.role")) & (F.col("e.digest") == F.col("f.digest"))
    fault = F.when(F.col("own") == "blank", "blank").when(~F.col("turn").eqNullSafe(F.col("first.turn")), "duplicate").otherwise(F.col("own"))
    joined = each.alias("e").join(first.alias("f"), same).select(*[F.col(f"e.{k}") for k in KEY], "n", "own", "first")
    return joined.select(*KEY, "n", fault.alias("fault"))


class Node:
    """The edit of one row: ``before`` (initials inserted ahead of it), ``edit``, ``role`` it has then."""

    __slots__ = ("before", "edit", "parent", "refs", "role", "row")

    def __init__(self, parent: Node | None, row: tuple | None, before: str, edit: str, role: str) -> None:
        self.parent, self.row, self.before, self.edit, self.role, self.refs = parent, row, before, edit, role, 0
        if parent is not None:
            parent.refs += 1


def options(state: int, initial: str, fault: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(state after, cost, inserted before, edit, role given) of one row's edits that may be part of a cheapest way.

    One insert may precede what is not a deletion: two would only come back to
    where they began, and an insert ahead of a deletion may as well follow it.
    """
    yield state, DELETE, "", "D", ""
    if fault in ("blank", "duplicate"):
        return
    more = TRUNCATED * (fault == "truncated")
    for at, cost, before in ((state, more, ""), (ASSISTANT if state == USER else USER, more + INSERT, "a" if state == USER else "u")):
        after = ASSISTANT if at == USER else USER
        if at == NOTHING and initial == "s":
            yield SYSTEM, cost, before, "K", ""
        elif initial == ("a" if at == USER else "u"):
            yield after, cost, before, "K", ""
        yield after, cost + REROLE, before, "R", ROLES[after]


@dataclass
class Survivor:
    cost: int
    rank: int
    tip: Node


def dominated(found: dict[int, Survivor]) -> list[int]:
    """States whose survivors no end can make the best: another is there from which all that follows costs as little, and less by more than the change costs."""
    gone = []
    a, u, s = found.get(ASSISTANT), found.get(USER), found.get(SYSTEM)
    better = lambda x, y, extra: x.cost + extra < y.cost or (x.cost + extra == y.cost and x.rank < y.rank)
    if a and s and better(a, s, 0):
        gone.append(SYSTEM)
    if a and u:
        if better(a, u, INSERT):
            gone.append(USER)
        elif better(u, a, INSERT):
            gone.append(ASSISTANT)
    n = found.get(NOTHING)
    if n and any(x and x.cost + extra < n.cost for x, extra in ((a, DELETE), (s, DELETE + 2 * INSERT))):
        gone.append(NOTHING)
    return gone


class Search:
    """Survivors of one block from one entry state."""

    def __init__(self, entry: int) -> None:
        self.root = Node(None, None, "", "", "")
        self.found = {entry: Survivor(0, 0, self.root)}
        self.root.refs = 1  # of the survivor
        self.unresolved = 0

    def feed(self, row: tuple, initial: str, fault: str) -> None:
        best: dict[int, tuple] = {}
        for state, x in self.found.items():
            for after, cost, before, edit, role in options(state, initial, fault):
                key = (x.cost + cost, x.rank, "I" * len(before) + edit)
                if after not in best or key < best[after][0]:
                    best[after] = key, state, before, edit, role
        nodes = {after: Node(self.found[state].tip, row, before, edit, role) for after, (_, state, before, edit, role) in best.items()}
        ranks = {after: k for k, after in enumerate(sorted(best, key=lambda q: best[q][0][1:]))}
        before = list(self.found.values())
        self.found = {after: Survivor(best[after][0][0], ranks[after], node) for after, node in nodes.items()}
        for x in self.found.values():
            x.tip.refs += 1
        for x in before:
            release(x.tip)
        for state in dominated(self.found):
            release(self.found.pop(state).tip)
        self.unresolved += 1

    def settled(self) -> list[Node]:
        """Edits that all survivors share, in order; they leave the tree. The root is above what is left."""
        tips, out = {x.tip for x in self.found.values()}, []
        if len(tips) == 1:  # one survivor: its whole way
            node = tips.pop()
            while node is not self.root:
                out.append(node)
                node = node.parent
            out.reverse()
            if out:
                self.root = out[-1]
                self.root.parent = None
            self.unresolved = 0
        return out

    def shared(self) -> list[Node]:
        """As settled(), for several survivors: walks up from the tips to where they meet."""
        tips = {x.tip for x in self.found.values()}
        if len(tips) == 1:
            return self.settled()
        while len(tips) > 1:  # all tips are as deep: each node is one row
            tips = {t.parent for t in tips}
        meet, out = tips.pop(), []
        node = meet
        while node is not self.root:
            out.append(node)
            node = node.parent
        out.reverse()
        if out:
            self.root, self.root.parent = meet, None
            self.unresolved -= len(out)
        return out

    def way(self, state: int) -> list[Node]:
        node, out = self.found[state].tip, []
        while node is not self.root:
            out.append(node)
            node = node.parent
        return out[::-1]


def release(node: Node | None) -> None:
    """One reference less; a node without any is freed, and so on upwards."""
    while node is not None:
        node.refs -= 1
        if node.refs:
            return
        above, node.parent = node.parent, None
        node = above


#: Appended to a way that ends in a state; nothing may stand alone, a system row may not.
ENDS = {NOTHING: "", SYSTEM: "ua", USER: "a", ASSISTANT: ""}


def arrow_schema(ddl: str) -> pa.Schema:
    return to_arrow_schema(T.StructType.fromDDL(ddl))


#: kind: ``edit`` (of a row, for one entry of a block or where its entry is known, and one exit or all), ``block`` (cost and rank of an exit), ``pair``
#: (illegal neighbours inside), or ``way`` of a conversation inside one task and block: its cost, illegal neighbours as n, and before, what is inserted at its end.
FOUND = "kind string, conv_id {id}, part int, block int, entry int, exit int, turn {turn}, role string, digest binary, n long, before string, edit string, given string, cost long, rank int, first string, last string"


def search(rows: DataFrame) -> DataFrame:
    """``FOUND`` rows of all conversations of ``rows`` (``KEY``, n, fault): edits by entry and exit of blocks, and what the blocks do.

    Blocks are numbered by (part, block) in a conversation's order. Each task
    holds one block's unresolved edits.
    """
    schema = FOUND.format(id=rows.schema["conv_id"].dataType.simpleString(), turn=rows.schema["turn"].dataType.simpleString())
    names = [f.split(" ")[0] for f in schema.split(", ")]
    ordered = rows.select(*KEY, "n", "fault")
    order = [F.asc_nulls_first(k) for k in KEY]
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out = TaskContext.get().partitionId(), []
        none, searches, block, fresh = object(), {}, 0, False
        first = last = None
        illegal = 0

        def row(kind: str, **values) -> None:
            out.append({"kind": kind, "conv_id": conv, "part": part, "block": block, **values})

        def edits(nodes: list[Node], entry: int, leave: int | None) -> None:
            for x in nodes:
                turn, role, digest, n = x.row
                row("edit", entry=entry, exit=leave, turn=turn, role=role, digest=digest, n=n, before=x.before, edit=x.edit, given=x.role)

        def lead(entry: int) -> int | None:
            """A conversation that begins in this task is entered with nothing there."""
            return None if fresh and not block else entry

        def close() -> None:
            for entry, s in searches.items():
                edits(s.shared(), lead(entry), None)
                for state, x in s.found.items():
                    edits(s.way(state), entry, state)
                    row("block", entry=entry, exit=state, cost=x.cost, rank=x.rank)

        def leave(more: bool) -> None:
            if conv is none:
                return
            if more and fresh and not block:
                s = searches[NOTHING]
                state = min(s.found, key=lambda q: (s.found[q].cost + INSERT * len(ENDS[q]), s.found[q].rank))
                edits(s.way(state), None, None)
                row("way", cost=s.found[state].cost + INSERT * len(ENDS[state]), n=illegal, before=ENDS[state])
            else:
                close()
                row("pair", cost=illegal, first=first, last=last)

        conv = none
        at_start = True
        for batch in batches:
            for values in zip(*(batch[c].to_pylist() for c in (*KEY, "n", "fault")), strict=True):
                now, turn, role, digest, n, fault = values
                if conv is none or now != conv:
                    leave(True)
                    # Only a task's first conversation may have begun in another one.
                    searches = {e: Search(e) for e in (range(4) if at_start else (NOTHING,))}
                    conv, block, fresh, first, last, illegal, at_start = now, 0, not at_start, None, None, 0, False
                initial = role[:1]
                first = initial if last is None else first
                illegal += (last is not None and last + initial not in ("su", "ua", "au")) + (n - 1)  # equal rows follow one another
                last = initial
                for entry, s in searches.items():
                    s.feed((turn, role, digest, n), initial, fault)
                    if len(s.found) == 1 or s.unresolved % 64 == 0:
                        edits(s.shared(), lead(entry), None)
                    if n > 1:
                        for x in s.found.values():
                            x.cost += DELETE * (n - 1)
                if any(s.unresolved >= UNRESOLVED for s in searches.values()):
                    close()
                    exits = sorted({q for s in searches.values() for q in s.found})
                    searches, block = {q: Search(q) for q in exits}, block + 1
                if len(out) >= 5_000:
                    yield pa.RecordBatch.from_pylist(out, arrow)
                    out.clear()
        leave(False)
        yield pa.RecordBatch.from_pylist(out, arrow)

    dealt = ordered.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(dealt.mapInArrow(run, schema).select(*names), "conversation-search")


def ways(found: DataFrame) -> DataFrame:
    """conv_id, part, block, entry, exit of the blocks on each conversation's cheapest way, and its cost, illegal and after (inserted at its end).

    These are conversations that a task's rows begin or end with, or of several
    blocks. A group holds one conversation's blocks: as many as it has tasks,
    and one more for every ``UNRESOLVED`` rows without agreement.
    """
    kind = found.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, part int, block int, entry int, exit int, cost long, illegal long, after string"
    arrow = arrow_schema(schema)

    def choose(rows: pa.Table) -> pa.Table:
        parts = sorted(rows.to_pylist(), key=lambda r: (r["part"], r["block"], r["kind"] == "pair"))
        held: dict[int, tuple] = {NOTHING: (0, (), None)}  # state: cost, rank, way as linked pairs
        steps: dict[tuple, list] = {}
        illegal, last = 0, None
        for r in parts:
            if r["kind"] == "block":
                steps.setdefault((r["part"], r["block"]), []).append(r)
            else:
                illegal += r["cost"] + (last is not None and last + r["first"] not in ("su", "ua", "au"))
                last = r["last"]
        for (part, block), of in steps.items():
            best: dict[int, tuple] = {}
            for r in of:
                if r["entry"] in held:
                    cost, rank, way = held[r["entry"]]
                    key = (cost + r["cost"], (rank, r["rank"]))
                    if r["exit"] not in best or key < best[r["exit"]][0]:
                        best[r["exit"]] = key, ((part, block, r["entry"], r["exit"]), way)
            order = {q: k for k, q in enumerate(sorted(best, key=lambda q: best[q][0][1]))}
            held = {q: (key[0], order[q], way) for q, (key, way) in best.items()}
        state = min(held, key=lambda q: (held[q][0] + INSERT * len(ENDS[q]), held[q][1]))
        cost, _, way = held[state]
        chosen = []
        while way:
            chosen.append(way[0])
            way = way[1]
        facts = {"conv_id": parts[0]["conv_id"], "cost": cost + INSERT * len(ENDS[state]), "illegal": illegal, "after": ENDS[state]}
        made = [dict(zip(("part", "block", "entry", "exit"), c, strict=True)) | {"conv_id": facts["conv_id"]} for c in chosen]
        made[0] |= facts  # the last block tells the whole
        return pa.Table.from_pylist(made, arrow)

    return found.filter("kind in ('block', 'pair')").select("kind", "conv_id", "part", "block", "entry", "exit", "cost", "rank", "first", "last").groupBy("conv_id").applyInArrow(choose, schema)


def repairs(each: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits, conversations): ``KEY``, n, before, edit, given of each distinct row of ``each`` (of faults()); conv_id, cost, illegal, after.

    ``before`` and ``after`` are initials of inserted empty turns. Of n equal
    rows the first has the edit, the others are deleted.
    """
    found = search(each)
    way = materialize(ways(found), "conversation-ways")
    e, w = found.filter("kind = 'edit' and entry is not null").alias("e"), way.select("conv_id", "part", "block", "entry", F.col("exit").alias("left")).alias("w")
    same = F.col("e.conv_id").eqNullSafe(F.col("w.conv_id")) & (F.col("e.part") == F.col("w.part")) & (F.col("e.block") == F.col("w.block")) & (F.col("e.entry") == F.col("w.entry"))
    told = ["n", "before", "edit", "given"]
    edits = e.join(w, same).filter("e.exit is null or e.exit = left").select(*[F.col(f"e.{k}") for k in KEY], *told)
    whole = found.filter("kind = 'way'").select("conv_id", "cost", F.col("n").alias("illegal"), F.col("before").alias("after"))
    return edits.unionByName(found.filter("kind = 'edit' and entry is null").select(*KEY, *told)), whole.unionByName(way.filter("cost is not null").select("conv_id", "cost", "illegal", "after"))


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, turn, place, role, text of the repaired conversations of ``rows`` (conv_id, turn, role, text); inserted turns have a null turn.

    ``place`` orders a conversation's rows: (turn, role, digest) of the row an
    insert stands before, then 0 for inserts and 1 for the row.
    """
    edits, whole = repairs(faults(rows))
    texts = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256))).groupBy(*KEY).agg(F.first("text").alias("text"))
    same = F.col("e.conv_id").eqNullSafe(F.col("t.conv_id")) & F.col("e.turn").eqNullSafe(F.col("t.turn")) & (F.col("e.role") == F.col("t.role")) & (F.col("e.digest") == F.col("t.digest"))
    kept = edits.filter("edit != 'D'").alias("e").join(texts.alias("t"), same).select("e.conv_id", "e.turn", "e.role", "e.digest", "before", "given", "text")
    name = lambda initial: F.when(initial == "u", "user").otherwise("assistant")
    own = F.struct(F.struct(F.col("turn").isNotNull().alias("there"), "turn", "role", "digest", F.lit(1).alias("part")).alias("place"), F.col("turn").alias("turn"), F.when(F.col("given") == "", F.col("role")).otherwise(F.col("given")).alias("role"), F.col("text").alias("text"))
    put = F.struct(F.struct(F.col("turn").isNotNull().alias("there"), "turn", "role", "digest", F.lit(0).alias("part")).alias("place"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), name(F.col("before")).alias("role"), F.lit("").alias("text"))
    inside = kept.select("conv_id", F.explode(F.when(F.col("before") == "", F.array(own)).otherwise(F.array(put, own))).alias("r")).select("conv_id", "r.*")
    ends = whole.filter("after != ''").select("conv_id", F.posexplode(F.split("after", "")).alias("k", "c")).filter("c != ''")
    place = F.struct(F.lit(None).cast("boolean").alias("there"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), (2 + F.col("k")).alias("part"))
    after = ends.select("conv_id", place.alias("place"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), name(F.col("c")).alias("role"), F.lit("").alias("text"))
    return inside.unionByName(after).select("conv_id", "turn", "place", "role", "text")


def digests(rows: DataFrame, edits: DataFrame, whole: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256: edits and texts of a conversation meet in its order, a row at a time, and go into its SHA-256.

    Of all texts this is the only shuffle. A SHA-256 is made from the first
    byte to the last, so one task reads a conversation, holding a text and the audit.
    """
    key = rows.schema["conv_id"].dataType.simpleString()
    texts = rows.select("conv_id", "turn", "role", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("n"), F.lit("").alias("before"), F.lit("").alias("edit"), F.lit("").alias("given"), "text")
    told = edits.select(*KEY, F.lit(0).alias("kind"), "n", "before", "edit", "given", F.lit("").alias("text"))
    # What is inserted at the end comes first in the order, as what is known of the conversation.
    ends = whole.select("conv_id", F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(-1).alias("kind"), F.lit(0).cast("long").alias("n"), F.col("after").alias("before"), F.lit("").alias("edit"), F.lit("").alias("given"), F.lit("").alias("text"))
    order = [F.asc("conv_id"), F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("digest"), F.asc("kind")]
    schema = f"conv_id {key}, audit string, repaired_sha256 string"
    arrow = arrow_schema(schema)

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = object()
        conv, sha, audit, lines, after, pending, out = none, None, bytearray(), 0, "", None, []

        def line(role: str, text: str) -> None:
            nonlocal lines
            sha.update((("\n" if lines else "") + role + ":").encode())
            sha.update(text.encode())
            lines += 1

        def finish() -> None:
            for c in after:
                audit.extend(b"I")
                line("user" if c == "u" else "assistant", "")
            out.append({"conv_id": conv, "audit": audit.decode(), "repaired_sha256": sha.hexdigest()})

        for batch in batches:
            for now, role, kind, n, before, edit, given, text in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "kind", "n", "before", "edit", "given", "text")), strict=True):
                if conv is none or now != conv:
                    if conv is not none:
                        finish()
                    conv, sha, audit, lines, after, pending = now, hashlib.sha256(), bytearray(), 0, "", None
                if kind == -1:
                    after = before
                elif kind == 0:
                    for c in before:
                        line("user" if c == "u" else "assistant", "")
                    audit.extend(b"I" * len(before) + edit.encode() + b"D" * (n - 1))
                    pending = None if edit == "D" else given or role
                elif pending is not None:  # the first of equal texts
                    line(pending, text)
                    pending = None
            if len(out) >= 1_000:
                yield pa.RecordBatch.from_pylist(out, arrow)
                out.clear()
        if conv is not none:
            finish()
        yield pa.RecordBatch.from_pylist(out, arrow)

    every = texts.unionByName(told).unionByName(ends)
    return every.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(walk, schema)


def audited(conversations: DataFrame, rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conv_id of ``conversations`` for its rows in ``rows`` (conv_id, turn, role, text, no null role or text).

    Rows stand by turn, null first; ties by role, then by SHA-256 of the text,
    so that equal rows are neighbours. The first fault of a row counts: blank,
    duplicate (same role and text before it), truncated. Null conv_id is a
    conversation of its own; one without rows has zeros, an empty audit and
    the hash of an empty text; empty and very long texts are rows as any;
    an empty table gives no row; other columns are not read.
    """
    each = materialize(faults(rows), "conversation-faults")
    edits, whole = repairs(each)
    zero = lambda c, kind: F.lit(None).cast(kind).alias(c)
    counted = each.groupBy("conv_id").agg(
        F.sum(F.when(F.col("fault") == "blank", F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("fault") == "duplicate", F.col("n")).when(F.col("fault") == "blank", 0).otherwise(F.col("n") - 1)).alias("duplicate"),
        F.sum(F.when(F.col("fault") == "truncated", 1).otherwise(0)).alias("truncated"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).cast("long").alias("gaps"),
    )
    facts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    texts = ["audit", "repaired_sha256"]
    full = lambda df: df.select("conv_id", *[F.col(c) if c in df.columns else zero(c, "string" if c in texts else "long") for c in facts + texts])
    every = full(pick(conversations, "conv_id").distinct())
    for df in (counted, whole, digests(rows, edits, whole)):
        every = every.unionByName(full(df))
    made = every.groupBy("conv_id").agg(*[F.coalesce(F.max(c), F.lit(0)).cast("long").alias(c) for c in facts], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
    return made
