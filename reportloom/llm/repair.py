"""Conversation structure repair by lazy weighted determinisation.

A repaired conversation's role initials are ``(s?(ua)+)?``. Edits: Keep costs 0, Rerole to user or assistant 3, Delete 4, Insert
of an empty user or assistant turn 3; a truncated row that stays adds 3; blank rows and repeats must go. Of all cheapest edits
those whose initials (D, I, K, R) come first in ASCII are made.

Method. What a row may become is a small weighted automaton over four states (start, after s, after u, after a). Scanned from the
last row to the first, the costs to go from each state form a vector. Vectors that differ by a constant behave alike, so the
vector less its least entry is a state of the determinised automaton, made when it is first met, with its arcs in a transition
table (``Table.arcs``: next vector and the constant). A row then costs one look-up; the constants add up to the cost. The audit goes
back against the scan, from the first row to the last, along arcs that are tight (what they cost and what is to go make up the
vector's entry), and takes the ASCII-least of these; its steps are cached by (vector, symbol, state) too.

Plan. Conversations of up to ``ROWS`` rows and ``BYTES`` bytes, all but odd ones, are dealt by their id once, and each is
repaired in one pass. A larger one is never gathered: its rows are range-sorted, numbered and cut into chunks of ``ROWS`` rows.
Repeats are found by the least number of each (role, text); each chunk gives a matrix of costs between entry and exit state, which are
scans of the same table from four unit vectors; a pass over the chunks' matrices (a row a chunk) gives each chunk's vector at its
end; each chunk is traced from all four entry states at once, and a pass over the chunks' ends picks the right one. Only
the digest is sequential, as SHA-256 is: the repaired lines of such a conversation stream through one task in order, a batch at a
time, with the state of the hash as the only memory. An audit is one text, as the result asks.

Defined results: a null role or text counts as one space; rows stand by turn (null first), then role, then text, so repeated rows
are adjacent; null ids are one conversation; rows that aren't ``alive`` only name their conversation; without rows
all counts are 0, the audit is empty and the digest that of an empty text; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_type, discard, lean, numbered, written

#: Rows and bytes of a conversation that one task repairs at once; also the rows of a larger one's chunk.
ROWS, BYTES = 1000, 8 << 20
_OUT = 4096
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
_FAR = 1 << 40
#: The state after a turn of this initial, by the state before.
_STEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: The turn that may be made (inserted, or by another role) in each state.
_MADE = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
#: What is to go after the last row: nothing, or turns to insert.
END = (0, 2 * INSERT, INSERT, 0)
TAILS = ("", "II", "I", "")
MUST_GO, _INITIALS = 8, "sua"


def symbol(initial: str, must_go: bool, truncated: bool) -> int:
    """What the automaton reads of a row: its initial (s, u, a or another), whether it is truncated, or that it must go."""
    return MUST_GO if must_go else 2 * (_INITIALS.find(initial) if initial in _INITIALS and initial else 3) + truncated


class Table:
    """The determinised automaton, as far as it was met."""

    def __init__(self):
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.arcs: dict[tuple[int, int], tuple[int, int]] = {}
        self.steps: dict[tuple[int, int, int], tuple[str, int]] = {}

    def state(self, vector: tuple[int, ...]) -> tuple[int, int]:
        """The number of a vector less its least entry, and that entry."""
        least = min(vector)
        key = tuple(min(x - least, _FAR) for x in vector)
        if key not in self.number:
            self.number[key] = len(self.vectors)
            self.vectors.append(key)
        return self.number[key], least

    def _edits(self, read: int, q: int) -> list[tuple[str, int, int]]:
        """(edit, cost, next state) of the edits of a row in state q, in ASCII order."""
        out = [("D", DELETE, q)]
        if read != MUST_GO:
            cut = CUT * (read & 1)
            initial = _INITIALS[read >> 1] if read >> 1 < 3 else ""
            if q in _STEP.get(initial, ()):
                out.append(("K", KEEP + cut, _STEP[initial][q]))
            out.append(("R", REROLE + cut, _MADE[q]))
        return out

    def _before(self, after: tuple[int, ...], read: int) -> tuple[int, ...]:
        """What is to go before a row, from what is to go after it: its edits, and turns inserted before it."""
        row = [min(cost + after[to] for _, cost, to in self._edits(read, q)) for q in range(4)]
        user, assistant = min(row[USER], INSERT + row[ASSISTANT]), min(row[ASSISTANT], INSERT + row[USER])
        return min(row[START], INSERT + user), min(row[SYSTEM], INSERT + user), user, assistant

    def arc(self, at: int, read: int) -> tuple[int, int]:
        """The state before a row and the constant that it adds; from the table, once it is there."""
        found = self.arcs.get((at, read))
        if found is None:
            found = self.arcs[at, read] = self.state(self._before(self.vectors[at], read))
        return found

    def scan(self, reads: list[int], after: tuple[int, ...]) -> tuple[list[int], tuple[int, ...]]:
        """The states behind each row, and what is to go before the first, from what is to go after the last."""
        at, total = self.state(after)
        behind = [0] * len(reads)
        for k in range(len(reads) - 1, -1, -1):
            behind[k] = at
            at, more = self.arc(at, reads[k])
            total += more
        return behind, tuple(min(total + x, _FAR) for x in self.vectors[at])

    def step(self, behind: int, read: int, q: int) -> tuple[str, int]:
        """The ASCII-least tight edits, inserted turns and then the row's own, and the state that they lead to."""
        found = self.steps.get((behind, read, q))
        if found is None:
            after, done, at = self.vectors[behind], "", q
            before = self._before(after, read)
            while True:
                tight = {e: to for e, cost, to in self._edits(read, at) if cost + after[to] == before[at]}
                if "D" not in tight and INSERT + before[_MADE[at]] == before[at]:
                    done, at = done + "I", _MADE[at]
                    continue
                edit = min(tight)
                found = self.steps[behind, read, q] = done + edit, tight[edit]
                break
        return found

    def trace(self, reads: list[int], behind: list[int], q: int) -> tuple[list[str], int]:
        """Each row's edits from entry state q on, and the state at the end."""
        out = []
        for read, at in zip(reads, behind, strict=True):
            piece, q = self.step(at, read, q)
            out.append(piece)
        return out, q


def lines(piece: str, q: int, role: str, text: str) -> tuple[list[str], int]:
    """The repaired lines that a row's edits make in state q, and the next state."""
    out = []
    for edit in piece:
        if edit == "K":
            q = _STEP[role[:1]][q]
            out.append(f"{role}:{text}")
        elif edit != "D":
            q = _MADE[q]
            out.append(f"{NAMES[q]}:{text if edit == 'R' else ''}")
    return out, q


class Counts:
    """What is counted in rows that stand in order."""

    def __init__(self):
        self.first = self.last = None  # initials
        self.low = self.high = None  # turns
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, initial: str, blank: bool, duplicate: bool, truncated: bool) -> None:
        self.merge_ends(initial, initial, turn, turn, int(turn is not None))
        self.blank += blank
        self.duplicate += duplicate and not blank
        self.truncated += truncated and not duplicate and not blank

    def merge_ends(self, first, last, low, high, turns) -> None:
        """Takes on rows that follow: their first and last initial, least and greatest turn, and number of turns."""
        self.illegal += self.last is not None and self.last + first not in ("su", "ua", "au")
        self.first, self.last = (first if self.last is None else self.first), last
        if low is not None:
            self.turns += turns - (self.high == low)
            self.low, self.high = (low if self.low is None else self.low), high

    @property
    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


_RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
_NONE = dict(gaps=0, blank=0, duplicate=0, truncated=0, illegal=0, cost=0, audit="", repaired_sha256=hashlib.sha256().hexdigest())


def _counted(made: Counts) -> dict:
    return dict(gaps=made.gaps, blank=made.blank, duplicate=made.duplicate, truncated=made.truncated, illegal=made.illegal)


def _conversation(rows: list[dict], table: Table) -> dict:
    """The result of one conversation whose rows stand in order."""
    made, seen, reads = Counts(), set(), []
    for r in rows:
        again = (r["role"], r["text"]) in seen
        seen.add((r["role"], r["text"]))
        made.add(r["turn"], r["role"][:1], r["blank"], again, r["truncated"])
        reads.append(symbol(r["role"][:1], r["blank"] or again, r["truncated"]))
    behind, costs = table.scan(reads, END)
    pieces, end = table.trace(reads, behind, START)
    told, q = [], START
    for r, piece in zip(rows, pieces, strict=True):
        some, q = lines(piece, q, r["role"], r["text"])
        told += some
    told += lines(TAILS[end], q, "", "")[0]
    return dict(**_counted(made), cost=costs[START], audit="".join(pieces) + TAILS[end], repaired_sha256=hashlib.sha256("\n".join(told).encode()).hexdigest())


def _runs(batches: Iterator[pa.RecordBatch], *key: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """The rows of each run of equal keys; a run is read before the next."""
    from itertools import groupby

    rows = (r for batch in batches for r in batch.to_pylist())
    yield from groupby(rows, key=lambda r: tuple(r[c] for c in key))


def _mapped(df: DataFrame, make, schema: str) -> DataFrame:
    """``make`` (batches to dicts) over each partition, as rows of the schema."""
    kind = arrow_type(schema)

    def run(batches):
        out = []
        for row in make(batches):
            out.append(row)
            if len(out) >= _OUT or len(row.get("line", "")) > 1 << 16:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return df.mapInArrow(lean(run), schema)


def repair(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", alive: Column | None = None, most_rows: int = ROWS, most_bytes: int = BYTES) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation."""
    told = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    g = F.coalesce(F.concat(F.lit("x"), F.col(f"`{conv_id}`").cast("string")), F.lit(""))
    trimmed = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    rows = rows.select(g.alias("g"), F.col(f"`{conv_id}`").alias("conv"), F.col(f"`{turn}`").cast("long").alias("turn"), told(role).alias("role"), told(text).alias("text"), (F.lit(True) if alive is None else F.coalesce(alive, F.lit(False))).alias("alive"))
    rows = rows.withColumn("blank", trimmed == "").withColumn("truncated", (trimmed != "") & ~F.substring(trimmed, -1, 1).isin(".", "!", "?"))
    id_type = rows.schema["conv"].dataType.simpleString()
    result = f"conv {id_type}, {_RESULT}"

    size = rows.groupBy("g").agg(F.first("conv").alias("conv"), F.count("*").alias("_rows"), F.sum(F.octet_length("role") + F.octet_length("text")).alias("_bytes"))
    large = written(size.filter((F.col("_rows") > most_rows) | (F.col("_bytes") > most_bytes)).select("g", "conv"), "large")
    some = not large.isEmpty()

    def whole(batches):
        table = Table()
        for _, found in _runs(batches, "g"):
            found = list(found)
            held = [r for r in found if r["alive"]]
            yield {"conv": found[0]["conv"], **(_conversation(held, table) if held else _NONE)}

    ordinary = rows.join(large.select("g"), "g", "left_anti") if some else rows
    out = _mapped(ordinary.repartition("g").sortWithinPartitions("g", "turn", "role", "text"), whole, result)
    if some:
        parts = _large(rows.filter("alive").join(large.select("g"), "g", "left_semi").drop("alive", "conv"), most_rows)
        named = large.join(parts, "g", "left")
        out = out.unionByName(named.select("conv", *(F.coalesce(c, F.lit(v).cast(parts.schema[c].dataType)).alias(c) for c, v in _NONE.items())))
    return out.withColumnRenamed("conv", conv_id)


def _large(rows: DataFrame, chunk: int) -> DataFrame:
    """The results (g, ...) of conversations that no task holds whole."""
    ranked = numbered(rows, "g", ["turn", "role", "text"], "turns")
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    at = written(ranked.select("g", F.col("_index").alias("at"), F.expr(f"_index div {chunk}").alias("chunk"), "turn", "role", "text", "blank", "truncated", said.alias("said")), "numbered")
    discard(*ranked.scratch_tables)
    # joined by the number, which is a row's own, not by what was said, which may be one for all rows
    first = at.groupBy("g", "said").agg(F.min("at").alias("at")).select("g", "at", F.lit(True).alias("first"))
    marks = at.join(first, ["g", "at"], "left").select("g", "at", "chunk", "turn", F.substring("role", 1, 1).alias("initial"), "blank", F.col("first").isNull().alias("duplicate"), "truncated")
    marks = written(marks, "marks")
    dealt = lambda df: df.repartition("g", "chunk").sortWithinPartitions("g", "chunk", "at")
    read = lambda r: symbol(r["initial"], r["blank"] or r["duplicate"], r["truncated"])

    def summed(batches):
        table = Table()
        for (g, k), found in _runs(batches, "g", "chunk"):
            made, reads = Counts(), []
            for r in found:
                made.add(r["turn"], r["initial"], r["blank"], r["duplicate"], r["truncated"])
                reads.append(read(r))
            ways = [table.scan(reads, tuple(0 if x == q else _FAR for x in range(4)))[1] for q in range(4)]
            yield dict(g=g, chunk=k, ways=[x for way in ways for x in way], first=made.first, last=made.last, low=made.low, high=made.high, turns=made.turns, blank=made.blank, duplicate=made.duplicate, truncated=made.truncated, illegal=made.illegal)

    sums = "g string, chunk long, ways array<long>, first string, last string, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long"
    parts = written(_mapped(dealt(marks), summed, sums), "chunks")

    def ends(batches):
        for (g,), found in _runs(batches, "g"):
            vector = END
            for r in found:  # from the last chunk to the first
                yield dict(g=g, chunk=r["chunk"], vector=list(vector))
                vector = tuple(min(r["ways"][4 * q + p] + vector[q] for q in range(4)) for p in range(4))

    after = written(_mapped(parts.repartition("g").sortWithinPartitions("g", F.desc("chunk")), ends, "g string, chunk long, vector array<long>"), "ends")

    def traced(batches):
        table = Table()
        for (g, k), found in _runs(batches, "g", "chunk"):
            found = list(found)
            reads = [read(r) for r in found]
            behind, costs = table.scan(reads, tuple(found[0]["vector"]))
            ways = [table.trace(reads, behind, q) for q in range(4)]
            yield dict(g=g, chunk=k, costs=list(costs), pieces=["".join(w) for w, _ in ways], to=[q for _, q in ways])

    # a chunk's vector, and later its edits, come with its first row alone
    on_first = lambda df, extra, name: df.join(extra.withColumn("at", F.col("chunk") * chunk).drop("chunk"), ["g", "at"], "left").select(*df.columns, name)
    ways = written(_mapped(dealt(on_first(marks, after, "vector")), traced, "g string, chunk long, costs array<long>, pieces array<string>, to array<long>"), "traces")

    def picked(batches):
        for (g,), found in _runs(batches, "g"):
            q = START
            for r in found:
                yield dict(g=g, chunk=r["chunk"], q=q, piece=r["pieces"][q], cost=r["costs"][q] if r["chunk"] == 0 else None, to=(q := r["to"][q]))

    chosen = written(_mapped(ways.repartition("g").sortWithinPartitions("g", "chunk"), picked, "g string, chunk long, q long, piece string, cost long, to long"), "chosen")

    def told(batches):
        for (g, _), found in _runs(batches, "g", "chunk"):
            piece, q, at = "", START, 0
            for r in found:
                if r["mark"] is not None:
                    piece, q, at = r["mark"]["piece"], r["mark"]["q"], 0
                begin = at
                while piece[at] == "I":
                    at += 1
                at += 1
                some, q = lines(piece[begin:at], q, r["role"], r["text"])
                if some:
                    yield dict(g=g, at=r["at"], line="\n".join(some))

    marked = chosen.select("g", "chunk", F.struct("piece", "q").alias("mark"))
    repaired = _mapped(dealt(on_first(at.select("g", "at", "chunk", "role", "text"), marked, "mark")), told, "g string, at long, line string")
    last = chosen.groupBy("g").agg(F.max_by("to", "chunk").alias("to"), F.max("chunk").alias("chunk"))
    tails = last.select("g", ((F.col("chunk") + 1) * chunk).alias("at"), F.when(F.col("to") == USER, f"{NAMES[ASSISTANT]}:").when(F.col("to") == SYSTEM, f"{NAMES[USER]}:\n{NAMES[ASSISTANT]}:").alias("line")).filter("line is not null")

    def hashed(batches):
        for (g,), found in _runs(batches, "g"):
            state, glue = hashlib.sha256(), b""
            for r in found:
                state.update(glue + r["line"].encode())
                glue = b"\n"
            yield dict(g=g, repaired_sha256=state.hexdigest())

    digests = _mapped(repaired.unionByName(tails).repartition("g").sortWithinPartitions("g", "at"), hashed, "g string, repaired_sha256 string")

    def totals(batches):
        for (g,), found in _runs(batches, "g"):
            made, cost, audit, q = Counts(), 0, [], START
            for r in found:
                made.merge_ends(r["first"], r["last"], r["low"], r["high"], r["turns"])
                for name in ("blank", "duplicate", "truncated", "illegal"):
                    setattr(made, name, getattr(made, name) + r[name])
                cost, q = cost + (r["cost"] or 0), r["to"]
                audit.append(r["piece"])
            yield dict(g=g, **_counted(made), cost=cost, audit="".join(audit) + TAILS[q])

    all_parts = parts.join(chosen, ["g", "chunk"]).select("g", "chunk", "first", "last", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "piece", "cost", "to")
    counted = _mapped(all_parts.repartition("g").sortWithinPartitions("g", "chunk"), totals, f"g string, {_RESULT.removesuffix(', repaired_sha256 string')}")
    return counted.join(digests, "g", "left")
