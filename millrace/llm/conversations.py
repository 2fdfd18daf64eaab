"""Conversation repair: the cheapest audit of edits that makes the roles of a conversation alternate.

The roles of a repaired conversation are an optional system turn and then user and assistant turns in
pairs, or nothing. Edits are Keep (free), Rerole to user or assistant (2), Delete (3; blank and repeated
rows must go) and Insert of an empty user or assistant turn (2); a truncated row that stays adds 1. The
audit is the string of their initials; among the cheapest the least in ASCII order is taken.

A dynamic program goes through the rows with the best audit for each state of the role pattern. Audits
are linked nodes that share their prefixes; a node knows its ancestors at distances of powers of two and
a rolling hash of its whole string. Audits of equal cost are compared at the end of their longest
common prefix, which is searched downwards through the ancestors; equal hashes are then verified node
by node up to the first shared node, so that a collision cannot change a result.

Rows are dealt out by ranges of (conversation, turn), so that a conversation of any length is spread over
many tasks. A task turns each stretch of at most ``STRETCH`` rows into a table: the best audit from
each state at its start to each state at its end. Tables of one conversation are then chained in order. Only
places, digests and role initials travel until audits are known; then the rows meet their audit in
turn order, one row in memory at a time. The result holds the whole audit of a conversation in one value,
and a digest of its text is made in one pass by its nature.

Cases: null roles and texts are one space; an empty role has a space as its initial. Rows without
conversation id form one conversation. Rows of one turn, and those without turn, which come first, are
ordered by the SHA-256 of role and text; equal rows are repeats of the first. A conversation without
rows has an empty audit. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from millrace.llm.common import SPACE_CHARACTERS, column, table
from millrace.session import staged

STRETCH = 4096
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1

# States of the role pattern: nothing yet, after the system turn, after a user, after an assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
# Where an inserted or changed turn leads: its role follows from the state.
ADDED = (USER, USER, ASSISTANT, USER)
ROLES = ("user", "user", "assistant", "user")
LEGAL = {"su", "ua", "au"}

_BASE, _PRIME = 0x1F3D5B79A2C4E687, (1 << 61) - 1


class Node:
    """The last edit of an audit, with its ancestors 1, 2, 4... edits before, and the hash of all edits so far."""

    __slots__ = ("edit", "depth", "hash", "up")

    def __init__(self, parent: Node | None, edit: str):
        self.edit = edit
        if parent is None:
            self.depth, self.hash, self.up = 0, 0, ()
            return
        self.depth = parent.depth + 1
        self.hash = (parent.hash * _BASE + ord(edit)) % _PRIME
        up = [parent]
        while len(up) <= len(up[-1].up):
            up.append(up[-1].up[len(up) - 1])
        self.up = tuple(up)

    def at(self, depth: int) -> Node:
        """The ancestor of this depth."""
        node = self
        while node.depth > depth:
            node = node.up[min((node.depth - depth).bit_length(), len(node.up)) - 1]
        return node

    def spelled(self) -> str:
        edits, node = [], self
        while node.up:
            edits.append(node.edit)
            node = node.up[0]
        return "".join(reversed(edits))


def same(a: Node, b: Node) -> bool:
    """Whether two audits of equal depth and hash are equal indeed."""
    while a is not b:
        if a.edit != b.edit:
            return False
        a, b = a.up[0], b.up[0]
    return True


def precedes(a: Node, b: Node) -> bool:
    """Whether audit ``a`` comes before ``b`` in ASCII order."""
    depth = min(a.depth, b.depth)
    x, y = a.at(depth), b.at(depth)
    if x.hash == y.hash:
        return a.depth < b.depth if same(x, y) else a.spelled() < b.spelled()
    for j in reversed(range(len(x.up))):
        if j < len(x.up) and x.up[j].hash != y.up[j].hash:
            x, y = x.up[j], y.up[j]
    if not same(x.up[0], y.up[0]):
        return a.spelled() < b.spelled()
    return x.edit < y.edit


Best = dict[int, tuple[int, Node]]


def offer(best: Best, state: int, cost: int, parent: Node, edit: str) -> bool:
    """Take an audit into ``best`` if it is cheaper, or as cheap and first in order."""
    held = best.get(state)
    if held is not None and held[0] < cost:
        return False
    node = Node(parent, edit)
    if held is not None and held[0] == cost and not precedes(node, held[1]):
        return False
    best[state] = (cost, node)
    return True


def inserted(best: Best) -> Best:
    """``best`` after any insertions that help; a chain has two at most, since a third returns to a state."""
    for _ in range(2):
        for state, (cost, node) in list(best.items()):
            offer(best, ADDED[state], cost + INSERT, node, "I")
    return best


def step(best: Best, initial: str, must_go: bool, truncated: bool) -> Best:
    """``best`` after one more row."""
    after: Best = {}
    left = TRUNCATED if truncated else 0
    for state, (cost, node) in best.items():
        offer(after, state, cost + DELETE, node, "D")
        if not must_go:
            kept = KEPT.get((state, initial))
            if kept is not None:
                offer(after, kept, cost + left, node, "K")
            offer(after, ADDED[state], cost + left + REROLE, node, "R")
    return inserted(after)


class Stretch:
    """Consecutive rows of a conversation: counts, and the best audits from each start to each end."""

    def __init__(self, conversation, starts, before: Stretch | None = None):
        self.conversation = conversation
        self.best = {s: inserted({s: (0, Node(None, ""))}) for s in starts}
        self.rows = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.low = self.high = None
        self.latest = before.latest if before else None

    def add(self, turn, digest, initial, blank, cut, again) -> None:
        duplicate = not blank and (again or self.latest == (turn, digest))
        truncated = cut and not blank and not duplicate
        self.latest = (turn, digest)
        self.rows += 1
        self.blank += blank
        self.duplicate += duplicate
        self.truncated += truncated
        if self.last is None:
            self.first = initial
        else:
            self.illegal += self.last + initial not in LEGAL
        self.last = initial
        if turn is not None:
            self.turns += turn != self.high
            self.low = turn if self.low is None else self.low
            self.high = turn
        for s, best in self.best.items():
            self.best[s] = step(best, initial, blank or duplicate, truncated)

    def row(self, place: int) -> dict:
        ways = [
            {"start": s, "end": e, "cost": cost, "audit": node.spelled()}
            for s, best in self.best.items() for e, (cost, node) in best.items()
        ]
        plain = ("conversation", "blank", "duplicate", "truncated", "illegal", "turns", "first", "last", "low", "high")
        return {name: getattr(self, name) for name in plain} | {"place": place, "ways": ways}


class Link:
    """The audit of a table, after those of the tables before it."""

    __slots__ = ("before", "audit")

    def __init__(self, before: Link | None, audit: str):
        self.before, self.audit = before, audit

    def spelled(self, until: Link | None = None) -> str:
        parts, link = [], self
        while link is not until:
            parts.append(link.audit)
            link = link.before
        return "".join(reversed(parts))


def first_of(a: Link, b: Link) -> Link:
    """The first in order of two chains of as many tables; what they share is not spelled."""
    x, y = a, b
    while x is not y:
        x, y = x.before, y.before
    return a if a.spelled(x) <= b.spelled(x) else b


class Chain:
    """A conversation from its tables, in order."""

    def __init__(self, conversation):
        self.conversation = conversation
        self.best: dict[int, tuple[int, Link | None]] = {START: (0, None)}
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)
        self.last = self.low = self.high = None

    def add(self, part: dict) -> None:
        after: dict[int, tuple[int, Link | None]] = {}
        for way in part["ways"]:
            held = self.best.get(way["start"])
            if held is None:
                continue
            cost, link = held[0] + way["cost"], Link(held[1], way["audit"])
            known = after.get(way["end"])
            if known is None or cost < known[0]:
                after[way["end"]] = (cost, link)
            elif cost == known[0]:
                after[way["end"]] = (cost, first_of(link, known[1]))
        self.best = after
        for name in self.counts:
            self.counts[name] += part[name]
        if part["low"] is not None:
            self.counts["turns"] -= part["low"] == self.high
            self.low = part["low"] if self.low is None else self.low
            self.high = part["high"]
        if part["first"] is not None:
            if self.last is not None:
                self.counts["illegal"] += self.last + part["first"] not in LEGAL
            self.last = part["last"]

    def row(self) -> dict:
        ends = [self.best[s] for s in (START, ASSISTANT) if s in self.best]
        least = min(cost for cost, _ in ends)
        audit = min(link.spelled() if link else "" for cost, link in ends if cost == least)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.counts["turns"]
        counts = {name: n for name, n in self.counts.items() if name != "turns"}
        return {"conversation": self.conversation, "gaps": gaps, **counts, "cost": least, "audit": audit}


WAYS = "array<struct<start: int, end: int, cost: bigint, audit: string>>"
COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint"


def in_batches(rows: Iterator[dict], schema: pa.Schema, size: int = 1000) -> Iterator[pa.RecordBatch]:
    while held := list(islice(rows, size)):
        yield pa.RecordBatch.from_pylist(held, schema)


def values_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def normal_rows(conversations: DataFrame, conv_column: str, turn_column: str, role_column: str, text_column: str) -> DataFrame:
    """(``conversation``, ``turn``, ``role``, ``text``) without null roles and texts."""
    space = lambda name: F.coalesce(column(name), F.lit(" "))
    return conversations.select(
        column(conv_column).alias("conversation"), column(turn_column).cast("bigint").alias("turn"),
        space(role_column).alias("role"), space(text_column).alias("text"),
    )


def digest_of(role: Column, text: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", F.char_length(role), role, text), 256))


def light_rows(rows: DataFrame) -> DataFrame:
    """(``conversation``, ``turn``, ``digest``, ``initial``, ``blank``, ``cut``) without texts."""
    bare = F.rtrim(F.col("text"), F.lit(SPACE_CHARACTERS))
    return rows.select(
        "conversation", "turn", digest_of(F.col("role"), F.col("text")).alias("digest"),
        F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1)).alias("initial"),
        (bare == "").alias("blank"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )


def stretch_tables(light: DataFrame, heads: DataFrame) -> DataFrame:
    """The table of each stretch, from rows in ranges of conversation and turn.

    A row repeats an earlier one if its role and text were seen at an earlier turn; those of one turn
    stand next to each other. ``heads`` has each conversation once and marks its beginning.
    """
    kind = dict(light.dtypes)["conversation"]
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    seen = light.groupBy("conversation", "digest").agg(F.count("*").alias("n"), F.min(place).alias("seen")).where("n > 1")
    repeated = staged(seen.select(F.col("conversation").alias("c"), F.col("digest").alias("d"), "seen"), "repeated")
    marked = light.join(repeated, F.col("conversation").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    again = F.coalesce(place > F.col("seen"), F.lit(False)).alias("again")
    rows = marked.select("conversation", F.lit(1).alias("kind"), "turn", "digest", "initial", "blank", "cut", again)
    keys = ("conversation", "kind", "turn", "digest")
    both = rows.unionByName(heads.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    ordered = both.repartitionByRange(*keys).sortWithinPartitions(*keys)
    spec = f"conversation {kind}, place bigint, {COUNTS}, turns bigint, first string, last string, low bigint, high bigint, ways {WAYS}"
    schema = to_arrow_schema(StructType.fromDDL(spec))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        place, stretch = TaskContext.get().partitionId() << 32, None
        for conversation, kind, *row in values_of(batches):
            if kind == 0 or stretch is None or stretch.rows == STRETCH:
                if stretch is not None:
                    place += 1
                    yield stretch.row(place)
                # Where a task begins within a conversation, and in further parts of a long one, any state may be the start.
                stretch = Stretch(conversation, (START,) if kind == 0 else STATES, stretch if kind else None)
            if kind:
                stretch.add(*row)
        if stretch is not None:
            yield stretch.row(place + 1)

    return ordered.mapInArrow(lambda batches: in_batches(found(batches), schema, 100), spec)


def audits(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """(``conversation``, ``gaps``, counts, ``cost``, ``audit``) of each conversation of ``heads``; rows are normal."""
    tables = stretch_tables(staged(light_rows(rows), "rows"), heads)
    names = tables.columns
    spec = f"conversation {dict(tables.dtypes)['conversation']}, gaps bigint, {COUNTS}, cost bigint, audit string"
    schema = to_arrow_schema(StructType.fromDDL(spec))

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        chain = None
        for values in values_of(batches):
            part = dict(zip(names, values, strict=True))
            if chain is None or chain.conversation != part["conversation"]:
                if chain is not None:
                    yield chain.row()
                chain = Chain(part["conversation"])
            chain.add(part)
        if chain is not None:
            yield chain.row()

    in_order = tables.repartition("conversation").sortWithinPartitions("conversation", "place")
    return in_order.mapInArrow(lambda batches: in_batches(chained(batches), schema), spec)


class Replay:
    """Applies an audit to the rows of its conversation as they go past."""

    def __init__(self, conversation, audit: str):
        self.conversation, self.audit = conversation, audit
        self.at, self.state = 0, START

    def insertions(self) -> Iterator[tuple]:
        """The turns to insert before the next row, or after the last."""
        while self.audit[self.at : self.at + 1] == "I":
            yield "I", None, ROLES[self.state], ""
            self.state = ADDED[self.state]
            self.at += 1

    def row(self, turn, role: str, text: str) -> Iterator[tuple]:
        yield from self.insertions()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            yield edit, turn, ROLES[self.state], text
            self.state = ADDED[self.state]
        elif edit == "K":
            yield edit, turn, role, text
            self.state = KEPT[self.state, role[:1]]


def replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """A conversation alone where it begins, then its repaired turns (conversation, edit, turn, role, text)."""
    replay = None
    for conversation, kind, audit, turn, _, role, text in values_of(batches):
        if kind == 0:
            if replay is not None:
                yield from ((replay.conversation, *turn) for turn in replay.insertions())
            replay = Replay(conversation, audit)
            yield (conversation,)
        else:
            yield from ((conversation, *turn) for turn in replay.row(turn, role, text))
    if replay is not None:
        yield from ((replay.conversation, *turn) for turn in replay.insertions())


def in_turn_order(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """Each conversation's audit, then its rows."""
    keys = ("conversation", "kind", "turn", "digest")
    heads = audited.select("conversation", F.lit(0).alias("kind"), "audit")
    texts = rows.select("conversation", F.lit(1).alias("kind"), "turn", digest_of(F.col("role"), F.col("text")).alias("digest"), "role", "text")
    both = heads.unionByName(texts, allowMissingColumns=True)
    return both.repartition("conversation").sortWithinPartitions(*keys)


def repaired_turns(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(``conversation``, ``place``, ``edit``, ``turn``, ``role``, ``text``) of all repaired conversations; places count from 1."""
    spec = f"conversation {dict(rows.dtypes)['conversation']}, place bigint, edit string, turn bigint, role string, text string"
    schema = to_arrow_schema(StructType.fromDDL(spec))

    def turns(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        place = 0
        for event in replayed(batches):
            place = place + 1 if len(event) > 1 else 0
            if place:
                yield dict(zip(schema.names, (event[0], place, *event[1:]), strict=True))

    return in_turn_order(rows, audited).mapInArrow(lambda batches: in_batches(turns(batches), schema, 100), spec)


def repaired_digests(rows: DataFrame, audited: DataFrame) -> DataFrame:
    """(``conversation``, ``repaired_sha256``) over ``role:text`` of the repaired turns, one on a line."""
    spec = f"conversation {dict(rows.dtypes)['conversation']}, repaired_sha256 string"
    schema = to_arrow_schema(StructType.fromDDL(spec))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        conversation, digest, empty = None, None, True
        for event in replayed(batches):
            if len(event) == 1:
                if digest is not None:
                    yield {"conversation": conversation, "repaired_sha256": digest.hexdigest()}
                conversation, digest, empty = event[0], hashlib.sha256(), True
            else:
                digest.update(f"{'' if empty else chr(10)}{event[3]}:{event[4]}".encode("utf-8", "surrogatepass"))
                empty = False
        if digest is not None:
            yield {"conversation": conversation, "repaired_sha256": digest.hexdigest()}

    return in_turn_order(rows, audited).mapInArrow(lambda batches: in_batches(digests(batches), schema), spec)


def repair(
    conversations: DataFrame, conv_column: str = "conv_id", turn_column: str = "turn", role_column: str = "role", text_column: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """The audits of all conversations, and their repaired turns."""
    rows = normal_rows(conversations, conv_column, turn_column, role_column, text_column)
    audited = staged(audits(rows, rows.select("conversation").distinct()), "audits")
    return audited, repaired_turns(rows, audited)


def damaged(rows: DataFrame) -> DataFrame:
    """Normal rows with faults by the checksum of ``conversation:turn``: lost, emptied, cut, repeated or given to the user."""
    part = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    marked = rows.withColumn("fault", F.crc32(F.concat_ws(":", part("conversation"), part("turn"))) % 20)
    fault = F.col("fault")
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return marked.where(fault != 0).select(
        "conversation", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.explode(copies).alias("copy"),
    ).drop("copy")


def op11_conversations(spark, sf_dir: str) -> DataFrame:
    rows = normal_rows(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    broken = damaged(rows)
    audited = staged(audits(broken, rows.select("conversation").distinct()), "audits")
    digests = repaired_digests(broken, audited).withColumnRenamed("conversation", "c")
    found = audited.join(digests, F.col("conversation").eqNullSafe(F.col("c"))).drop("c")
    return found.withColumnRenamed("conversation", "conv_id")


# The checksum takes eight shifts for each character of the key; the recursion goes through the rows of all
# conversations side by side. An insertion leads to state 2, or from there to 3.
SQL = {
    "op11_conversations": r"""
WITH RECURSIVE keyed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
           coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k
    FROM conversations
), marked AS (
    SELECT *, xor(list_reduce(
        list_concat([4294967295], list_transform(range(0, 8 * length(k)),
            lambda i: CASE WHEN i % 8 = 0 THEN CAST(ascii(substr(k, CAST(i // 8 + 1 AS BIGINT), 1)) AS BIGINT) ELSE 0 END)),
        lambda a, x: xor(xor(a, x) >> 1, CASE WHEN xor(a, x) & 1 = 1 THEN 3988292384 ELSE 0 END)), 4294967295) % 20 AS fault
    FROM keyed
), broken AS (
    SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
           CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
           unnest(CASE WHEN fault = 3 THEN [0, 1] ELSE [0] END) AS copy
    FROM marked WHERE fault <> 0
), placed AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || ':' || text), copy) AS n,
           CASE WHEN role = '' THEN ' ' ELSE substr(role, 1, 1) END AS i,
           rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
    FROM broken
), seen AS (
    SELECT *, lag(i) OVER (PARTITION BY conv_id ORDER BY n) AS before,
           CASE WHEN bare = '' THEN 'blank'
                WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
                WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS kind
    FROM placed
), counts AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (kind = 'blank') AS blank, count(*) FILTER (kind = 'duplicate') AS duplicate,
           count(*) FILTER (kind = 'truncated') AS truncated,
           count(*) FILTER (before || i NOT IN ('su', 'ua', 'au')) AS illegal
    FROM seen GROUP BY conv_id
), walk AS (
    SELECT c.conv_id, 0 AS n, s.state, {'cost': s.cost, 'audit': s.audit, 'out': CAST(s.out AS VARCHAR[])} AS best
    FROM (SELECT DISTINCT conv_id FROM conversations) c,
         (VALUES (0, 0, '', []), (2, 2, 'I', ['user:']), (3, 4, 'II', ['user:', 'assistant:'])) s(state, cost, audit, out)
    UNION ALL
    SELECT conv_id, n, state, min(best) FROM (
        SELECT conv_id, n, a.way.state AS state, {'cost': e.cost + a.way.cost, 'audit': e.audit || a.way.audit, 'out': list_concat(e.out, a.way.out)} AS best
        FROM (
            SELECT conv_id, n, unnest(edits, recursive := true) FROM (
                SELECT w.conv_id, r.n AS n, list_concat(
                    [{'state': w.state, 'cost': w.best.cost + 3, 'audit': w.best.audit || 'D', 'out': w.best.out}],
                    CASE WHEN r.kind IN ('blank', 'duplicate') THEN [] ELSE
                        [{'state': CASE WHEN w.state = 2 THEN 3 ELSE 2 END,
                          'cost': w.best.cost + 2 + CASE WHEN r.kind = 'truncated' THEN 1 ELSE 0 END, 'audit': w.best.audit || 'R',
                          'out': list_append(w.best.out, CASE WHEN w.state = 2 THEN 'assistant:' ELSE 'user:' END || r.text)}] END,
                    CASE WHEN r.kind IN ('blank', 'duplicate') OR (w.state::VARCHAR || r.i) NOT IN ('0s', '0u', '1u', '2a', '3u') THEN [] ELSE
                        [{'state': CASE r.i WHEN 's' THEN 1 WHEN 'u' THEN 2 ELSE 3 END,
                          'cost': w.best.cost + CASE WHEN r.kind = 'truncated' THEN 1 ELSE 0 END, 'audit': w.best.audit || 'K',
                          'out': list_append(w.best.out, r.role || ':' || r.text)}] END) AS edits
                FROM walk w JOIN seen r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.n = w.n + 1
            )
        ) e, LATERAL (SELECT unnest(list_concat(
            [{'state': e.state, 'cost': 0, 'audit': '', 'out': CAST([] AS VARCHAR[])}],
            CASE WHEN e.state = 2 THEN [{'state': 3, 'cost': 2, 'audit': 'I', 'out': ['assistant:']}]
            ELSE [{'state': 2, 'cost': 2, 'audit': 'I', 'out': ['user:']}, {'state': 3, 'cost': 4, 'audit': 'II', 'out': ['user:', 'assistant:']}] END)) AS way) a
    ) GROUP BY conv_id, n, state
), ended AS (
    SELECT w.conv_id, min(w.best) AS best
    FROM walk w JOIN (SELECT conv_id, max(n) AS n FROM walk GROUP BY conv_id) l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.n = w.n
    WHERE w.state IN (0, 3) GROUP BY w.conv_id
)
SELECT e.conv_id, coalesce(c.gaps, 0) AS gaps, coalesce(c.blank, 0) AS blank, coalesce(c.duplicate, 0) AS duplicate,
       coalesce(c.truncated, 0) AS truncated, coalesce(c.illegal, 0) AS illegal, CAST(e.best.cost AS BIGINT) AS cost,
       e.best.audit AS audit, sha256(coalesce(array_to_string(e.best.out, chr(10)), '')) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id
""",
}
