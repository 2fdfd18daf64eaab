"""Conversation repair against enumeration and a plain program over strings; long, hot, null and tied rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from millrace.llm import conversations
from millrace.llm.common import prepare

PATTERN = re.compile(r"(s?(ua)+)?")
SPACES = " \t\n\x0b\x0c\r"
KEYS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def faults(rows):
    """(initial, must go, truncated) of each row, and the counts."""
    seen, found = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACES)
        kind = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        found.append((role[:1] or " ", kind))
    return found


def enumerated(marked):
    """The least (cost, audit) among all sequences of edits with up to two insertions at each place."""
    best = None
    for edits in itertools.product("KRD", repeat=len(marked)):
        if any(e != "D" and k in ("blank", "duplicate") for e, (_, k) in zip(edits, marked, strict=True)):
            continue
        for gaps in itertools.product(range(3), repeat=len(marked) + 1):
            cost = 2 * sum(gaps) + sum({"K": 0, "R": 2, "D": 3}[e] + (e != "D" and k == "truncated") for e, (_, k) in zip(edits, marked, strict=True))
            audit = "".join("I" * g + e for g, e in zip(gaps, [*edits, ""], strict=True))
            if best is not None and (cost, audit) >= best:
                continue
            slots = [[*["ua"] * gaps[0]]]
            for g, e, (initial, _) in zip(gaps[1:], edits, marked, strict=True):
                slots.append((["ua"] if e == "R" else [initial] if e == "K" else []) + ["ua"] * g)
            if any(PATTERN.fullmatch("".join(w)) for w in itertools.product(*itertools.chain(*slots))):
                best = (cost, audit)
    return best


def by_strings(marked):
    """The same for long conversations: the least (cost, audit, roles) of each state."""
    kept = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    added = {"": "u", "s": "u", "u": "a", "a": "u"}

    def insertions(best):
        for _ in range(3):
            for s, (cost, audit) in list(best.items()):
                way = (cost + 2, audit + "I")
                best[added[s]] = min(best.get(added[s], way), way)
        return best

    best = insertions({"": (0, "")})
    for initial, kind in marked:
        after = {}
        for s, (cost, audit) in best.items():
            ways = [(s, cost + 3, "D")]
            if kind not in ("blank", "duplicate"):
                extra = kind == "truncated"
                ways.append((added[s], cost + 2 + extra, "R"))
                if (s, initial) in kept:
                    ways.append((kept[s, initial], cost + extra, "K"))
            for t, c, e in ways:
                after[t] = min(after.get(t, (c, audit + e)), (c, audit + e))
        best = insertions(after)
    return min(best[s] for s in ("", "a") if s in best)


def repaired(rows, audit):
    state, out, left = "", [], iter(rows)
    for edit in audit:
        row = next(left) if edit != "I" else None
        if edit == "D":
            continue
        role = row[1] if edit == "K" else "assistant" if state == "u" else "user"
        state = role[0]
        out.append(f"{role}:{row[2] if row else ''}")
    return out


def in_order(rows):
    digest = lambda role, text: hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1], r[2])))


def wanted(rows, best):
    """What the query returns for one conversation's rows after damage, in order."""
    rows = in_order(rows)
    marked = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    cost, audit = best(marked)
    kinds = [k for _, k in marked]
    initials = [i for i, _ in marked]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, "blank": kinds.count("blank"),
        "duplicate": kinds.count("duplicate"), "truncated": kinds.count("truncated"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), "cost": cost, "audit": audit,
        "repaired_sha256": hashlib.sha256("\n".join(repaired(rows, audit)).encode()).hexdigest(),
    }


def damage(conversation, rows):
    out = []
    part = lambda x: " " if x is None else str(x)
    for turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{part(conversation)}:{part(turn)}".encode()) % 20
        if fault == 0:
            continue
        text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
        out += [(turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def talks(seed, number, longest):
    rng = random.Random(seed)
    text = lambda: rng.choice(["One.", "Two!", "cut", "", None, " \t\n", "É?", "One. ", "\x1c", "Three?\n"]) if rng.random() < 0.6 else f"{rng.random()}."
    role = lambda n: rng.choice(["user", "assistant", "system", "tool", None, "unknown"]) if rng.random() < 0.3 else ("user", "assistant")[n % 2]
    out = {}
    for c in range(number):
        turns = [t + (rng.randrange(5) if rng.random() < 0.1 else 0) if rng.random() < 0.95 else None for t in range(rng.randint(1, longest))]
        out[c if c != 3 else None] = [(t, role(n), text()) for n, t in enumerate(turns)]
    return out


def table(spark, found):
    rows = [(c, t, r, x, "e", 1, 2) for c, rows in found.items() for t, r, x in rows]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string, audit string, kind int, `a.b` int")


def answers(result):
    return {r["conv_id"]: {k: r[k] for k in KEYS} for r in result.collect()}


def test_query_equals_enumeration(spark, tmp_path):
    prepare(spark)
    found = talks(1, 60, 4) | talks(2, 3, 3)
    table(spark, found).write.parquet(str(tmp_path / "conversations.parquet"))
    result = answers(conversations.op11_conversations(spark, str(tmp_path)))
    assert result == {c: wanted(damage(c, rows), enumerated) for c, rows in found.items()}


@pytest.mark.parametrize("stretch", [3, 4096])
def test_long_conversations_in_stretches(spark, tmp_path, monkeypatch, stretch):
    """One conversation holds most rows: ranges and stretches cut it anywhere."""
    monkeypatch.setattr(conversations, "STRETCH", stretch)
    found = talks(7, 30, 12)
    rng = random.Random(9)
    found[5] = [(rng.randrange(700), rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b.", "c", f"{n}."])) for n in range(1500)]
    found[6] = [(None, "user", "same.")] * 300
    table(spark, found).repartition(6).write.parquet(str(tmp_path / "conversations.parquet"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        result = answers(conversations.op11_conversations(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert result == {c: wanted(damage(c, rows), by_strings) for c, rows in found.items()}


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "user", "cut"), (1, 3, "user", "U."), (1, 3, "user", "U."), (2, 5, "tool", "")]
    audited, turns = conversations.repair(spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string"))
    assert {r.conversation: (r.audit, r.cost, r.gaps) for r in audited.collect()} == {1: ("KIKKRD", 2 + 1 + 2 + 3, 0), 2: ("D", 3, 0)}
    assert [tuple(r)[1:] for r in turns.orderBy("place").collect()] == [
        (1, "K", 0, "system", "S."), (2, "I", None, "user", ""), (3, "K", 1, "assistant", "A."),
        (4, "K", 2, "user", "cut"), (5, "R", 3, "assistant", "U."),
    ]


def test_common_prefixes_are_found(monkeypatch):
    """Any two audits that share a prefix, and any hash, even one on which all audits collide."""
    rng = random.Random(3)
    for prime in (conversations._PRIME, 5, 1):
        monkeypatch.setattr(conversations, "_PRIME", prime)
        nodes = [conversations.Node(None, "")]
        for _ in range(400):
            nodes.append(conversations.Node(rng.choice(nodes[-30:]), rng.choice("DIKR")))
        for _ in range(2000):
            a, b = rng.choice(nodes), rng.choice(nodes)
            assert conversations.precedes(a, b) == (a.spelled() < b.spelled())
            assert a.at(a.depth // 2).spelled() == a.spelled()[: a.depth // 2]


def test_empty_table(spark):
    none = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    audited, turns = conversations.repair(none)
    assert audited.count() == turns.count() == 0
