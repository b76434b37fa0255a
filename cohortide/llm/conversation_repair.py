"""Repair of conversations: the lightest edits that make the roles follow ``(s?(ua)+)?``.

An item is (rows read, state); the state says what may follow: nothing yet, after a system, a user or
an assistant row. Deductions lead from item to item: keep, rerole or delete the next row, or insert an
empty one. Their weights are (cost, audit), added and appended, so a conclusion never weighs less than
its premise, and Knuth's agenda may settle items in the order of their weight until the goal is
settled. Rows are of 16 types for this purpose, and equal sequences of types are derived once.

A stretch of many rows is cut into blocks. A block's lightest derivations from every state to every
state are deductions themselves, and the same agenda runs over blocks (and blocks of blocks).

Spark's part: rows are dealt by range of (conversation, turn, role, text), so a conversation of a
third of all rows is spread over as many tasks. A task repairs the conversations that lie wholly
inside its range. Those that touch its edges, or are longer than ``HELD`` rows, are set aside; their
blocks are derived apart, joined by conversation, and the texts streamed past the hash in order. Of
such a conversation one task only sees weights and audits (a few bytes a row), and the stream, which
it does not hold, since one SHA-256 covers all its text.

Cases: a null role or text counts as one space. Null turns come first; rows of one turn follow by role,
then text (by code point). A null conversation id is a conversation. An empty role fits nowhere. Rows
that repeat are duplicates of the first. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cohortide.llm.storage import materialize
from cohortide.llm.words import job_settings

#: Rows of one conversation that a task holds at a time.
HELD = 4096
BLOCK = 64
_PLACES = 40  # bits of a row's place in its part

# States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant.
START, GOALS = 0, (0, 3)
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: The role that may be inserted, or given to a row, in each state, and the state after it.
WANTS = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
INITIALS = "sua"
SPACE = " \t\n\x0b\x0c\r"


def row_type(initial: int, must_go, truncated) -> int:
    """One number for what the edits of a row depend on; ``initial`` is 3 for any other letter."""
    return initial + 4 * bool(must_go) + 8 * bool(truncated)


def _edits(kind: int) -> list[list[tuple]]:
    initial, must_go, truncated = kind % 4, kind & 4, kind >> 3
    out = []
    for state in range(4):
        own = [(3, "D", state)]
        if not must_go:
            after = KEEPS.get((state, INITIALS[initial])) if initial < 3 else None
            if after is not None:
                own.append((truncated, "K", after))
            own.append((2 + truncated, "R", WANTS[state][1]))
        out.append(own)
    return out


EDITS = [_edits(kind) for kind in range(16)]
INSERTS = [[(2, "I", WANTS[state][1])] for state in range(4)]
NO_INSERTS = [[], [], [], []]


def agenda(steps: list, inserts: list, entry: int, goals=None) -> dict[int, tuple[int, str]]:
    """Lightest (cost, audit) from ``entry`` before the first step to each state after the last.

    ``steps[i][state]`` lists the deductions (cost, audit, state) over step i. With ``goals`` the
    agenda ends as soon as one of them is settled.
    """
    last, found, settled, queue = len(steps), {}, set(), [(0, "", 0, entry)]
    while queue:
        cost, audit, i, state = heappop(queue)
        if (i, state) in settled:
            continue
        settled.add((i, state))
        if i == last:
            found[state] = (cost, audit)
            if goals and state in goals or len(found) == 4:
                break
        else:
            for more, edit, to in steps[i][state]:
                if (i + 1, to) not in settled:
                    heappush(queue, (cost + more, audit + edit, i + 1, to))
        for more, edit, to in inserts[state]:
            if (i, to) not in settled:
                heappush(queue, (cost + more, audit + edit, i, to))
    return found


@lru_cache(maxsize=1 << 14)
def block_derivations(kinds: bytes) -> tuple:
    """For each entry state the deductions (cost, audit, exit state) over a block of rows."""
    steps = [EDITS[k] for k in kinds]
    return tuple(tuple((c, a, to) for to, (c, a) in agenda(steps, INSERTS, entry).items())
                 for entry in range(4))


def join_blocks(blocks: list) -> list:
    """Derivations over consecutive blocks as those of one."""
    while len(blocks) > 1:
        blocks = [
            own[0] if len(own) == 1 else
            tuple(tuple((c, a, to) for to, (c, a) in agenda(own, NO_INSERTS, entry).items())
                  for entry in range(4))
            for own in (blocks[i:i + BLOCK] for i in range(0, len(blocks), BLOCK))]
    return blocks[0]


def derivations(kinds: bytes) -> tuple:
    """The same over any number of rows, at least one."""
    return join_blocks([block_derivations(kinds[i:i + BLOCK]) for i in range(0, len(kinds), BLOCK)])


@lru_cache(maxsize=1 << 14)
def _short(kinds: bytes) -> tuple[int, str]:
    found = agenda([EDITS[k] for k in kinds], INSERTS, START, GOALS)
    return min(found[g] for g in GOALS if g in found)


def lightest(kinds: bytes) -> tuple[int, str]:
    """Cost and audit of the lightest repair of a whole conversation."""
    if len(kinds) <= BLOCK:
        return _short(kinds)
    return min((c, a) for c, a, to in derivations(kinds)[START] if to in GOALS)


class Replay:
    """The repaired (role, text) rows that an audit's edits make of a conversation's rows, one by one."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def inserted(self) -> list[tuple[str, str]]:
        """Empty rows that come before the next row, or at the end."""
        out = []
        while self.audit[self.at:self.at + 1] == "I":
            want, self.state = WANTS[self.state]
            out.append((want, ""))
            self.at += 1
        return out

    def add(self, role: str, text: str) -> list[tuple[str, str]]:
        out = self.inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "R":
            want, self.state = WANTS[self.state]
            out.append((want, text))
        elif edit == "K":
            self.state = KEEPS[self.state, role[:1]]
            out.append((role, text))
        return out


class Hash:
    """SHA-256 of ``role:text`` lines that come a few at a time."""

    def __init__(self):
        self.hash, self.between = hashlib.sha256(), b""

    def add(self, lines) -> None:
        for role, text in lines:
            self.hash.update(self.between + f"{role}:{text}".encode())
            self.between = b"\n"


# --- rows ---------------------------------------------------------------------------------------

def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with the faults that crc32 of ``conv_id:turn`` deals."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    k = F.crc32(key.cast("binary")) % 20
    text = F.coalesce("text", F.lit(" "))
    out = conversations.where(k != 0).select(
        "conv_id", "turn",
        F.when(k == 4, "user").otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(k == 1, "").when(k == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(k == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("copy"))
    return out.drop("copy")


def typed(rows: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Rows with nulls filled and what the faults of a row alone are."""
    named = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
                        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    first = F.left("role", F.lit(1))
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return named.select("*", initial.alias("initial"), (last == "").alias("blank"),
                        (~last.isin(".", "!", "?")).alias("truncated"))


_ROW = ("conv_id", "turn", "role", "text", "initial", "blank", "truncated")
_DIGEST = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
_MIXED = pa.schema([
    ("place", pa.int64()), ("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()),
    ("text", pa.string()), ("initial", pa.int32()), ("blank", pa.bool_()), ("truncated", pa.bool_()),
    ("done", pa.struct([*[(c, pa.int64()) for c in _DIGEST[:6]], *[(c, pa.string()) for c in _DIGEST[6:]]]))])
_MIXED_SCHEMA = ("place long, conv_id long, turn long, role string, text string, initial int, "
                 "blank boolean, truncated boolean, done struct<gaps: long, blank: long, duplicate: long, "
                 "truncated: long, illegal: long, cost: long, audit: string, repaired_sha256: string>")
_LEGAL = {(0, 1), (1, 2), (2, 1)}


def gap_count(turns) -> int:
    own = {t for t in turns if t is not None}
    return max(own) - min(own) + 1 - len(own) if own else 0


def repair_rows(rows: list[tuple]) -> dict:
    """What is returned of one conversation; ``rows`` have the fields of ``_ROW`` in order."""
    seen, kinds, counts = set(), bytearray(), [0, 0, 0]
    for _, _, role, text, initial, blank, truncated in rows:
        again = (role, text) in seen
        seen.add((role, text))
        fault = 0 if blank else 1 if again else 2 if truncated else None
        if fault is not None:
            counts[fault] += 1
        kinds.append(row_type(initial, blank or again, truncated))
    initials = [r[4] for r in rows]
    illegal = sum(p not in _LEGAL for p in zip(initials, initials[1:]))
    cost, audit = lightest(bytes(kinds))
    replay, digest = Replay(audit), Hash()
    for row in rows:
        digest.add(replay.add(row[2], row[3]))
    digest.add(replay.inserted())
    return dict(zip(_DIGEST, (gap_count(r[1] for r in rows), *counts, illegal, cost, audit,
                              digest.hash.hexdigest())))


def repair_inside(held: int):
    """Over the sorted rows of a part: conversations wholly inside it repaired, all others as they came."""

    def run(batches):
        from pyspark import TaskContext

        place = TaskContext.get().partitionId() << _PLACES
        stretch, current, at_edge, out = [], None, True, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in _ROW)):
                place += 1
                if row[0] != current or place & ((1 << _PLACES) - 1) == 1:
                    if stretch:  # neither the first nor the last of the part
                        out.append({"conv_id": current, "done": repair_rows([r[1] for r in stretch])})
                        stretch = []
                    at_edge, current = place & ((1 << _PLACES) - 1) == 1, row[0]
                if at_edge:
                    out.append({"place": place, **dict(zip(_ROW, row))})
                else:
                    stretch.append((place, row))
                    if len(stretch) > held:
                        out += [{"place": p, **dict(zip(_ROW, r))} for p, r in stretch]
                        stretch, at_edge = [], True
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_MIXED)
                out = []
        out = [{"place": p, **dict(zip(_ROW, r))} for p, r in stretch]
        yield pa.RecordBatch.from_pylist(out, schema=_MIXED)

    return run


# --- conversations over several parts -----------------------------------------------------------

_BLOCK_SCHEMA = ("conv_id long, place long, duplicate long, blank long, truncated long, illegal long, "
                 "first int, last int, low long, high long, turns long, first_turn long, last_turn long, "
                 "costs array<long>, audits array<string>, ends array<int>")


def summed_block(table: pa.Table) -> pa.Table:
    """One row for the rows of a conversation in one block: counts, edges and derivations."""
    rows = sorted(zip(*(table.column(c).to_pylist() for c in (
        "place", "conv_id", "turn", "initial", "blank", "truncated", "again"))))
    kinds, counts, turns = bytearray(), [0, 0, 0], [r[2] for r in rows]
    for _, _, _, initial, blank, truncated, again in rows:
        fault = 0 if blank else 1 if again else 2 if truncated else None
        if fault is not None:
            counts[fault] += 1
        kinds.append(row_type(initial, blank or again, truncated))
    initials = [r[3] for r in rows]
    known = [t for t in turns if t is not None]
    ways = [(4 * entry + to, c, a) for entry, own in enumerate(derivations(bytes(kinds))) for c, a, to in own]
    return pa.table({
        "conv_id": pa.array([rows[0][1]], pa.int64()), "place": pa.array([rows[0][0]], pa.int64()),
        "duplicate": pa.array([counts[1]], pa.int64()), "blank": pa.array([counts[0]], pa.int64()),
        "truncated": pa.array([counts[2]], pa.int64()),
        "illegal": pa.array([sum(p not in _LEGAL for p in zip(initials, initials[1:]))], pa.int64()),
        "first": pa.array([initials[0]], pa.int32()), "last": pa.array([initials[-1]], pa.int32()),
        "low": pa.array([min(known, default=None)], pa.int64()),
        "high": pa.array([max(known, default=None)], pa.int64()),
        "turns": pa.array([len(set(known))], pa.int64()),
        "first_turn": pa.array([turns[0]], pa.int64()), "last_turn": pa.array([turns[-1]], pa.int64()),
        "costs": pa.array([[w[1] for w in ways]], pa.list_(pa.int64())),
        "audits": pa.array([[w[2] for w in ways]], pa.list_(pa.string())),
        "ends": pa.array([[w[0] for w in ways]], pa.list_(pa.int32()))})


_JOINED_SCHEMA = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, "
                  "cost long, audit string")


def joined_blocks(table: pa.Table) -> pa.Table:
    """The lightest repair of a conversation from its blocks."""
    blocks = sorted(table.to_pylist(), key=lambda r: r["place"])
    ways = []
    for b in blocks:
        own = [[], [], [], []]
        for end, cost, audit in zip(b["ends"], b["costs"], b["audits"]):
            own[end // 4].append((cost, audit, end % 4))
        ways.append(own)
    cost, audit = min((c, a) for c, a, to in join_blocks(ways)[START] if to in GOALS)
    pairs = list(zip(blocks, blocks[1:]))
    illegal = sum(b["illegal"] for b in blocks) + sum((x["last"], y["first"]) not in _LEGAL for x, y in pairs)
    gaps, known = 0, [b for b in blocks if b["turns"]]
    if known:
        again = sum(x["last_turn"] == y["first_turn"] for x, y in zip(known, known[1:]))
        turns = sum(b["turns"] for b in known) - again
        gaps = max(b["high"] for b in known) - min(b["low"] for b in known) + 1 - turns
    sums = {c: sum(b[c] for b in blocks) for c in ("blank", "duplicate", "truncated")}
    row = {"conv_id": blocks[0]["conv_id"], "gaps": gaps, **sums, "illegal": illegal, "cost": cost, "audit": audit}
    return pa.table({c: pa.array([v], pa.string() if c == "audit" else pa.int64()) for c, v in row.items()})


_TURN = pa.schema([("conv_id", pa.int64()), ("number", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_HASH = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])


def replayed(turns: bool):
    """Over rows of conversations in order, each led by a row with its audit: repaired rows, or their
    hash. A conversation streams by and is not held."""

    def run(batches):
        current, replay, digest, number, out = None, None, None, 0, []

        def take(lines):
            nonlocal number
            if not turns:
                digest.add(lines)
                return
            for role, text in lines:
                out.append((current, number, role, text))
                number += 1

        def end():
            if replay is not None:
                take(replay.inserted())
                if not turns:
                    out.append((current, digest.hash.hexdigest()))

        def batch_of(rows):
            schema = _TURN if turns else _HASH
            cols = list(zip(*rows)) or [()] * len(schema)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

        for batch in batches:
            for conv_id, audit, role, text in zip(*(batch.column(c).to_pylist() for c in (
                    "conv_id", "audit", "role", "text"))):
                if audit is not None:
                    end()
                    current, replay, digest, number = conv_id, Replay(audit), Hash(), 0
                else:
                    take(replay.add(role, text))
            yield batch_of(out)
            out.clear()
        end()
        yield batch_of(out)

    return run


def replay(rows: DataFrame, repairs: DataFrame, order, turns: bool) -> DataFrame:
    """``replayed`` over ``rows`` in that order within each conversation of ``repairs``."""
    lead = repairs.select("conv_id", "audit", *[F.lit(None).cast(t).alias(c) for c, t in rows.dtypes
                                                if c != "conv_id"])
    own = rows.withColumn("audit", F.lit(None).cast("string"))
    schema = "conv_id long, number long, role string, text string" if turns else "conv_id long, repaired_sha256 string"
    return (lead.unionByName(own).repartition("conv_id")
            .sortWithinPartitions("conv_id", F.col("audit").isNull(), *order)
            .mapInArrow(replayed(turns), schema))


def repair_spread(rows: DataFrame) -> DataFrame:
    """Repairs of the conversations that are not inside one part, from their rows with places."""
    same = [F.xxhash64(F.lit(s), "role", "text").alias(f"same{s}") for s in (1, 2)]
    small = rows.select("conv_id", "place", "turn", "initial", "blank", "truncated", *same)
    firsts = small.groupBy("conv_id", "same1", "same2").agg(F.min("place").alias("first_place"))
    faults = (small.join(firsts.select("first_place"), F.col("place") == F.col("first_place"), "left")
              .withColumn("again", F.col("first_place").isNull()))
    blocks = faults.groupBy("conv_id", F.floor(F.col("place") / HELD).alias("block")).applyInArrow(
        summed_block, _BLOCK_SCHEMA)
    joined = materialize(blocks.groupBy("conv_id").applyInArrow(joined_blocks, _JOINED_SCHEMA), "repairs")
    hashes = replay(rows.select("conv_id", "place", "role", "text"), joined, ["place"], turns=False)
    named = hashes.withColumnRenamed("conv_id", "hash_id")
    return joined.join(named, F.col("conv_id").eqNullSafe(F.col("hash_id"))).select("conv_id", *_DIGEST)


def repair(rows: DataFrame, held: int = HELD, conv_id: str = "conv_id", turn: str = "turn",
           role: str = "role", text: str = "text") -> DataFrame:
    """Faults, cost, audit and hash of the repaired form of every conversation in ``rows``."""
    job_settings(rows.sparkSession)
    own = typed(rows, conv_id, turn, role, text)
    key = ("conv_id", "turn", "role")
    parts = (own.repartitionByRange(*key, F.left("text", F.lit(64))).sortWithinPartitions(*key, "text")
             .mapInArrow(repair_inside(held), _MIXED_SCHEMA))
    parts = materialize(parts, "conversations")
    inside = parts.where("done is not null").select("conv_id", *[f"done.{c}" for c in _DIGEST])
    return inside.unionByName(repair_spread(parts.where("done is null").drop("done")))


def repaired_turns(rows: DataFrame, repairs: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
                   role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations themselves: conv_id, number (from 0), role and text."""
    own = typed(rows, conv_id, turn, role, text).select("conv_id", "turn", "role", "text")
    return replay(own, repairs, ["turn", "role", "text"], turns=True)


def repair_all(conversations: DataFrame, rows: DataFrame, **how) -> DataFrame:
    """``repair`` of ``rows``, and a row of zeros for each conversation that has none left there."""
    found = repair(rows, **how).withColumnRenamed("conv_id", "found_id")
    ids = conversations.select(F.col("conv_id").cast("long")).distinct()
    empty = {"audit": F.lit(""), "repaired_sha256": F.lit(hashlib.sha256(b"").hexdigest())}
    return ids.join(found, F.col("conv_id").eqNullSafe(F.col("found_id")), "left").select(
        "conv_id", *[F.coalesce(c, empty.get(c, F.lit(0).cast("long"))).alias(c) for c in _DIGEST])
