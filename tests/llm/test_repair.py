"""Conversation repair against an exhaustive search over edits, and large conversations against small ones."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from reportloom.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")
BLANK = re.compile(r"[\x20\x09-\x0D]*")


def faults(rows):
    """(blank, duplicate, truncated) of each row, the first that holds."""
    out, seen = [], set()
    for _, role, text in rows:
        blank, again = bool(BLANK.fullmatch(text)), (role, text) in seen
        seen.add((role, text))
        out.append((blank, again and not blank, not blank and not again and text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?"))
    return out


def plain_repair(rows):
    """All sequences of edits that don't cost more than deleting every row; the cheapest, ASCII-least one."""
    found, kinds, best = [], faults(rows), [4 * len(rows)]

    def go(i, made, cost, audit, told):
        if cost > best[0]:
            return
        if i == len(rows) and GOOD.fullmatch(made):
            best[0] = cost
            found.append((cost, audit, told))
        if len(audit) < 3 * len(rows) + 2:
            for role in ("user", "assistant"):
                if not made.endswith(role[0]):
                    go(i, made + role[0], cost + 3, audit + "I", [*told, f"{role}:"])
        if i < len(rows):
            _, role, text = rows[i]
            blank, again, cut = kinds[i]
            go(i + 1, made, cost + 4, audit + "D", told)
            if not blank and not again:
                if role[:1] in ("s", "u", "a"):
                    go(i + 1, made + role[:1], cost + 3 * cut, audit + "K", [*told, f"{role}:{text}"])
                for other in ("user", "assistant"):
                    go(i + 1, made + other[0], cost + 3 + 3 * cut, audit + "R", [*told, f"{other}:{text}"])

    go(0, "", 0, "", [])
    return min(found)


def plain_result(rows):
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    kinds = faults(rows)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, told = plain_repair(rows)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(sum(k[j] for k in kinds) for j in range(3)), illegal, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest())


def random_conversation(rng, n, texts=("Yes.", "No!", "cut", "", " \t", "é?", None)):
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, ""]
    return [(rng.choice([None, *range(6)]), rng.choice(roles), rng.choice(texts)) for _ in range(n)]


def result(df):
    return {r["conv_id"]: tuple(r)[1:] for r in df.collect()}


@pytest.fixture(scope="module")
def conversations():
    rng = random.Random(5)
    many = {i: random_conversation(rng, i % 5, [f"{w}{k}" for w in ("a.", "b", "!") for k in ("", ".")] + ["", None]) for i in range(150)}
    return {k: v for k, v in many.items() if v} | {None: [(0, "user", "hi."), (1, "assistant", "yes.")], 900: [(None, "user", "x.")] * 3}


def table(spark, conversations):
    return spark.createDataFrame([(c, *r) for c, rows in conversations.items() for r in rows], SCHEMA).repartition(4)


def test_cheapest_ascii_least_edits(spark, conversations):
    got = result(repair.repair(table(spark, conversations)))
    assert got == {c: plain_result(rows) for c, rows in conversations.items()}
    assert len({r[6] for r in got.values()}) > 40


@pytest.mark.parametrize(("rows", "size"), [(1, 1 << 20), (2, 1 << 20), (3, 1 << 20), (1000, 4)])
def test_large_conversations_give_the_same(spark, conversations, rows, size):
    got = result(repair.repair(table(spark, conversations), most_rows=rows, most_bytes=size))
    assert got == {c: plain_result(rows) for c, rows in conversations.items()}


def test_one_long_conversation_in_chunks(spark):
    rng = random.Random(8)
    rows = {1: [(k, *random_conversation(rng, 1, ["so.", "and", "", f"{k}!", f"{k}?", f"{k}."])[0][1:]) for k in range(700)], 2: [(0, "user", "a.")], 3: [(None, "assistant", "same")] * 400}
    whole, cut = (result(repair.repair(table(spark, rows), most_rows=n)) for n in (1000, 37))
    assert whole == cut and set(whole[1][6]) == set("DIKR") and whole[3][2] == 399


def test_rows_that_are_not_alive_only_name_their_conversation(spark):
    df = spark.createDataFrame([(1, 0, "user", "a."), (1, 1, "assistant", "b."), (2, 0, "user", "x."), (2, 1, "user", "y")], SCHEMA)
    for most in (1000, 1):
        got = result(repair.repair(df, alive=F.col("conv_id") == 1, most_rows=most))
        assert got[2] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) and got[1][5:7] == (0, "KK")


def test_empty_table_long_text_and_clashing_columns(spark):
    assert repair.repair(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "word " * 400_000 + "."
    df = spark.createDataFrame([(1, 0, "user", long, "g", 1, True), (1, 1, "assistant", long, "g", 1, True)], f"{SCHEMA}, g string, at long, blank boolean")
    for size in (1 << 30, 1 << 10):
        got = result(repair.repair(df, most_bytes=size))
        assert got[1][5:] == (0, "KK", hashlib.sha256(f"user:{long}\nassistant:{long}".encode()).hexdigest())


def test_table_is_made_lazily_and_stays_small():
    rng, table = random.Random(2), repair.Table()
    for _ in range(200):
        reads = [rng.randrange(9) for _ in range(50)]
        behind, costs = table.scan(reads, repair.END)
        pieces, end = table.trace(reads, behind, repair.START)
        spent = sum({"D": 4, "I": 3, "R": 3, "K": 0}[e] for e in "".join(pieces) + repair.TAILS[end])
        spent += sum(3 for r, p in zip(reads, pieces, strict=True) if r != repair.MUST_GO and r & 1 and "D" not in p)
        assert spent == costs[repair.START]
    assert len(table.vectors) < 60
