"""Repair of the turn structure of conversations by shortest paths.

A conversation's turns, in order, are a layered graph: a node is (turns taken so far, state of the grammar
``(s?(ua)+)?`` over role initials), an arc is an edit of one turn or the insertion of one. All costs are small
integers, so distances to the end come from Dial's bucket queue: nodes wait in a ring of buckets by distance, no
heap. Distances are recorded, and a walk from the start along tight arcs (those that lose nothing), always the
one with the least letter, spells the cheapest audit that comes first in ASCII order: every letter leads to one
state only, so the least letter never has to be taken back.

A conversation may hold any share of all rows. Turns are dealt by ranges of (conversation, turn, role, digest) and cut
into blocks of at most ``BLOCK_ROWS`` rows or ``BLOCK_BYTES`` of text. One block alone is solved where it stands. Of
longer conversations each block is summed up as the distances between its four entry and four exit states (Dial
again), a pass over these small tables gives each block its distances to the end, a second one the state in
which the walk enters it, and then all blocks are walked side by side.

Rows: nulls of role and text are one space. Turns are taken with null turns first; rows of one turn by role, then by the
SHA-256 of role and text. Rows with equal conv_id, turn, role and text follow each other, all but the first being
duplicates. A null conv_id is a conversation of its own. Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm.shared import look_up, stage, table

BLOCK_ROWS, BLOCK_BYTES = 4096, 8 << 20
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5  # what edits and an undeleted truncated turn cost
NEVER = 1 << 60
RING = 32  # buckets: more than any arc's cost and any spread of distances between exit states
BLANKS = " \t\n\x0b\x0c\r"

# States of (s?(ua)+)?: nothing yet, after s, after u, after a. NEXT[state][initial], initials: 1 s, 2 u, 3 a, 0 others.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
NEXT = [[None, AFTER_S, AFTER_U, None], [None, None, AFTER_U, None], [None, None, None, AFTER_A], [None, None, AFTER_U, None]]
ROLES = [("user", AFTER_U) if NEXT[q][2] else ("assistant", AFTER_A) for q in range(4)]  # the one role that may be put in
CLOSING = [0, 2 * INSERT, INSERT, 0]  # distance to the end after the last turn
GOOD, GONE, CUT = range(3)  # a turn that may stay, must go, costs more to keep


def _edits(code: int) -> list[tuple[int, str, int, int]]:
    """(state, letter, next state, cost) of the edits that use up a turn of this code (initial * 3 + condition)."""
    initial, condition = divmod(code, 3)
    out = [(q, "D", q, DELETE) for q in range(4)]
    if condition != GONE:
        more = TRUNCATED if condition == CUT else 0
        out += [(q, "K", NEXT[q][initial], KEEP + more) for q in range(4) if NEXT[q][initial] is not None]
        out += [(q, "R", ROLES[q][1], REROLE + more) for q in range(4)]
    return out


FORWARD = [[sorted((e[1:] for e in _edits(c) if e[0] == q)) for q in range(4)] for c in range(12)]
BACK = [[[(e[0], e[3]) for e in _edits(c) if e[2] == q] for q in range(4)] for c in range(12)]
INSERT_BACK = [[p for p in range(4) if ROLES[p][1] == q] for q in range(4)]


def distances(codes: bytes, exits: list[int], upto_start: bool = False) -> list[int]:
    """Distance from node (i, state), at 4 * i + state, to the end of the block, where a state is ``exits[state]`` away.

    ``upto_start``: nothing farther from the end than the very first node is needed.
    """
    last = 4 * len(codes)
    known = [NEVER] * (last + 4)
    ring: list[list[int]] = [[] for _ in range(RING)]
    at, waiting = min(exits), 0
    for q, d in enumerate(exits):
        if d < NEVER:
            known[last + q] = d
            ring[d % RING].append(last + q)
            waiting += 1
    while waiting and not (upto_start and at > known[0]):
        bucket = ring[at % RING]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if known[node] != at:
                continue  # it was reached on a shorter way
            layer, q = node >> 2, node & 3
            if layer < len(codes):
                for p in INSERT_BACK[q]:
                    if at + INSERT < known[4 * layer + p]:
                        known[4 * layer + p] = at + INSERT
                        ring[(at + INSERT) % RING].append(4 * layer + p)
                        waiting += 1
            if layer:
                before = 4 * (layer - 1)
                for p, cost in BACK[codes[layer - 1]][q]:
                    if at + cost < known[before + p]:
                        known[before + p] = at + cost
                        ring[(at + cost) % RING].append(before + p)
                        waiting += 1
        at += 1
    return known


def walk(codes: bytes, known: list[int], entry: int) -> tuple[str, int]:
    """The least audit of a block along tight arcs, and the state in which it leaves the block."""
    q, i, said = entry, 0, []
    while i < len(codes):
        left = known[4 * i + q]
        role_state = ROLES[q][1]
        for letter, to, cost in FORWARD[codes[i]][q]:
            if letter > "I" and left == INSERT + known[4 * i + role_state]:
                said.append("I")
                q = role_state
                break
            if left == cost + known[4 * i + 4 + to]:
                said.append(letter)
                q, i = to, i + 1
                break
        else:
            said.append("I")
            q = role_state
    return "".join(said), q


def close(state: int) -> str:
    """What must be put in after the last turn."""
    return "I" * (CLOSING[state] // INSERT)


# --- turns and blocks ---------------------------------------------------------------------------------------


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after damage by crc32 of ``conv_id:turn`` (nulls: one space) modulo 20.

    0 drops the row (copies 0), 1 empties its text, 2 takes out ``.!?``, 3 repeats it, 4 makes it a user's.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"), copies.alias("copies"))


def _turns(rows: DataFrame) -> DataFrame:
    """Rows with a condition before duplicates, and rows (kind 0) that mark what was said in an earlier turn."""
    rows = rows.withColumn("digest", F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256))
    there = rows.where("copies > 0").select("conv_id", "turn", "role", "digest").distinct()
    key = F.concat_ws(":", F.coalesce(F.length(F.col("conv_id").cast("string")).cast("string"), F.lit("-")), F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "digest")
    there = there.withColumn("key", key)
    first = stage(there.groupBy("key").agg(F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("bare"), F.count(F.lit(1)).alias("size")).where("size > 1"), "said-again")
    seen = look_up(there, first, "key", "size", "turn").where("size is not null and turn is not null and (bare or turn > least)")
    marks = seen.select("conv_id", "turn", "role", "digest", F.lit(0).alias("kind"), F.lit("").alias("text"), F.lit(0).alias("copies"), F.lit(0).alias("fault"))
    bare = F.rtrim("text", F.lit(BLANKS))
    fault = F.when(bare == "", 1).when(F.right(bare, F.lit(1)).isin(".", "!", "?"), 0).otherwise(2)
    return rows.select("conv_id", "turn", "role", "digest", F.lit(1).alias("kind"), "text", "copies", fault.alias("fault")).unionAll(marks)


@dataclass
class _Block:
    """Turns of one conversation that stand side by side, with what is counted over them."""

    conv: object
    order: int
    fresh: bool  # no turn of the conversation stands before it, for certain
    codes: bytearray = field(default_factory=bytearray)
    roles: list = field(default_factory=list)
    texts: list = field(default_factory=list)
    size: int = 0
    faults: list = field(default_factory=lambda: [0, 0, 0])
    illegal: int = 0
    turns: list = field(default_factory=list)  # distinct ones, in order

    def row(self, whole: bool) -> dict:
        blank, duplicate, truncated = self.faults
        return {
            "conv_id": self.conv, "order": self.order, "whole": whole, "codes": bytes(self.codes), "roles": self.roles, "texts": self.texts, "blank": blank, "duplicate": duplicate, "truncated": truncated,
            "illegal": self.illegal, "first_turn": self.turns[0] if self.turns else None, "last_turn": self.turns[-1] if self.turns else None, "n_turns": len(self.turns),
        }


_BLOCK = "order long, whole boolean, codes binary, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, first_turn long, last_turn long, n_turns long"
_LEGAL = {(1, 2), (2, 3), (3, 2)}


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def _arrow(conv: pa.DataType, *fields: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([("conv_id", conv), *fields])


_LONG, _TEXTS = pa.int64(), pa.list_(pa.string())
_BLOCK_FIELDS = [("order", _LONG), ("whole", pa.bool_()), ("codes", pa.binary()), ("roles", _TEXTS), ("texts", _TEXTS)] + [(c, _LONG) for c in ("blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "n_turns")]


def _blocks(most_rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of sorted turns. A block is whole if its conversation begins and ends in it, inside this partition."""
    base, made, block, mark, last, schema = TaskContext.get().partitionId() << 33, 0, None, None, None, None
    names = ("conv_id", "turn", "role", "digest", "kind", "text", "copies", "fault")
    for batch in batches:
        schema = schema or _arrow(batch.schema.field("conv_id").type, *_BLOCK_FIELDS)
        done, held = [], 0
        for conv, turn, role, digest, kind, text, copies, fault in zip(*(batch.column(n).to_pylist() for n in names), strict=True):
            if block is None or conv != block.conv:
                if block is not None:
                    done.append(block.row(whole=block.fresh))
                block, made, last, mark = _Block(conv, base + made, fresh=block is not None), made + 1, None, None
            elif len(block.codes) >= most_rows or block.size >= BLOCK_BYTES:
                done.append(block.row(whole=False))
                block, made = _Block(conv, base + made, fresh=False), made + 1
            if kind == 0:
                mark = (turn, digest)
                continue
            for _ in range(copies):
                again = mark == (turn, digest) or last == (turn, digest)
                last = (turn, digest)
                what = 0 if fault == 1 else 1 if again else 2 if fault == 2 else None
                if what is not None:
                    block.faults[what] += 1
                initial = {"s": 1, "u": 2, "a": 3}.get(role[:1], 0)
                if block.codes:
                    block.illegal += (block.codes[-1] // 3, initial) not in _LEGAL
                block.codes.append(initial * 3 + (GOOD if what is None else CUT if what == 2 else GONE))
                block.roles.append(role)
                block.texts.append("" if what in (0, 1) else text)  # such a turn never stays
                block.size += len(text)
                held += len(text)
                if turn is not None and block.turns[-1:] != [turn]:
                    block.turns.append(turn)
            if len(done) >= 256 or held >= BLOCK_BYTES:
                yield _batch(done, schema)
                done, held = [], 0
        if done:
            yield _batch(done, schema)
    if block is not None:
        yield _batch([block.row(whole=False)], schema)


# --- passes over the blocks of conversations of several blocks ------------------------------------------------


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distances from each entry state (row) to each exit state of a block."""
    for batch in batches:
        out = []
        for codes in batch.column("codes").to_pylist():
            ways = [distances(codes, [0 if q == to else NEVER for q in range(4)]) for to in range(4)]
            out.append([min(ways[to][q], NEVER) for q in range(4) for to in range(4)])
        yield pa.record_batch([batch.column("conv_id"), batch.column("order"), pa.array(out, pa.list_(_LONG))], names=["conv_id", "order", "ways"])


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from the last to the first: how far each exit state is from the conversation's end."""
    conv, ahead, any_yet = None, CLOSING, False
    for batch in batches:
        out = []
        for c, ways in zip(batch.column("conv_id").to_pylist(), batch.column("ways").to_pylist(), strict=True):
            if not any_yet or c != conv:
                conv, ahead, any_yet = c, CLOSING, True
            out.append(ahead)
            ahead = [min(min(ways[4 * q + to] + ahead[to] for to in range(4)), NEVER) for q in range(4)]
        yield pa.record_batch([batch.column("conv_id"), batch.column("order"), pa.array(out, pa.list_(_LONG))], names=["conv_id", "order", "exits"])


def _turnstiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exit state of a block's walk for each entry state."""
    for batch in batches:
        out = []
        for codes, exits in zip(batch.column("codes").to_pylist(), batch.column("exits").to_pylist(), strict=True):
            known = distances(codes, exits)
            out.append([walk(codes, known, q)[1] for q in range(4)])
        yield pa.record_batch([batch.column("conv_id"), batch.column("order"), batch.column("exits"), pa.array(out, pa.list_(_LONG))], names=["conv_id", "order", "exits", "leads"])


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks from the first to the last: the state in which the walk enters each; the last one's walk is closed."""
    held, state = None, START
    for batch in batches:
        orders, exits, entries, ends = [], [], [], []

        def give(closing: bool):
            orders.append(held[1])
            exits.append(held[2])
            entries.append(held[3])
            ends.append(closing)

        for conv, order, ahead, leads in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "order", "exits", "leads")), strict=True):
            if held is not None:
                give(held[0] != conv)
            if held is None or held[0] != conv:
                state = START
            held = (conv, order, ahead, state)
            state = leads[state]
        if orders:
            yield _placed(orders, exits, entries, ends)
    if held is not None:
        yield _placed([held[1]], [held[2]], [held[3]], [True])


def _placed(orders, exits, entries, ends) -> pa.RecordBatch:
    return pa.record_batch([pa.array(orders, _LONG), pa.array(exits, pa.list_(_LONG)), pa.array(entries, pa.int32()), pa.array(ends, pa.bool_())], names=["order", "exits", "entry", "closes"])


_PIECE = "order long, whole boolean, audit string, cost long, kept_roles array<string>, kept_texts array<string>, {counts}, first_initial int, last_initial int, first_turn long, last_turn long, n_turns long"
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_PIECE_FIELDS = [("order", _LONG), ("whole", pa.bool_()), ("audit", pa.string()), ("cost", _LONG), ("kept_roles", _TEXTS), ("kept_texts", _TEXTS), *((c, _LONG) for c in _COUNTS), ("first_initial", pa.int32()), ("last_initial", pa.int32())] + [(c, _LONG) for c in ("first_turn", "last_turn", "n_turns")]


def _repaired(audit: str, entry: int, roles: list[str], texts: list[str], codes: bytes) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits."""
    q, i, new_roles, new_texts = entry, 0, [], []
    for letter in audit:
        if letter == "D":
            i += 1
        elif letter == "K":
            new_roles.append(roles[i])
            new_texts.append(texts[i])
            q, i = NEXT[q][codes[i] // 3], i + 1
        else:
            role, q = ROLES[q]
            new_roles.append(role)
            new_texts.append("" if letter == "I" else texts[i])
            i += letter == "R"
    return new_roles, new_texts


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The walk of every block, from its entry state to its exit, and what it makes of the turns."""
    for batch in batches:
        schema = _arrow(batch.schema.field("conv_id").type, *_PIECE_FIELDS)
        out = []
        for row in batch.to_pylist():
            codes, entry = row["codes"], row["entry"]
            known = distances(codes, row["exits"], upto_start=entry == START)
            audit, state = walk(codes, known, entry)
            cost = known[entry] - row["exits"][state]
            if row["closes"]:
                audit, cost = audit + close(state), cost + CLOSING[state]
            roles, texts = _repaired(audit, entry, row["roles"], row["texts"], codes)
            out.append({n: row[n] for n in ("conv_id", "order", "whole", *_COUNTS, "first_turn", "last_turn", "n_turns")} | {"audit": audit, "cost": cost, "kept_roles": roles, "kept_texts": texts, "first_initial": codes[0] // 3 if codes else None, "last_initial": codes[-1] // 3 if codes else None})
        yield _batch(out, schema)


def repair(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Pieces of repaired conversations, from rows (conv_id, turn, role, text, copies).

    (conv_id, order, whole, audit, cost, kept_roles, kept_texts, counts...): one row for each block of a conversation, in
    ``order``; audits and turns of its rows follow each other. ``copies`` says how often a row stands there (0: not).
    """
    kind = rows.schema["conv_id"].dataType.simpleString()
    keys = ("conv_id", "turn", "role", "digest")
    dealt = _turns(rows).repartitionByRange(*keys).sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest", "kind")
    blocks = stage(dealt.mapInArrow(partial(_blocks, block_rows), f"conv_id {kind}, {_BLOCK}"), "turn-blocks")
    alone = blocks.where("whole").withColumns({"exits": F.array(*map(F.lit, CLOSING)).cast("array<bigint>"), "entry": F.lit(START), "closes": F.lit(True)})
    rest = blocks.where("not whole")
    codes = rest.select("conv_id", "order", "codes")

    def scan(table: DataFrame, run, schema: str, order) -> DataFrame:
        return table.repartition("conv_id").sortWithinPartitions("conv_id", order).mapInArrow(run, schema)

    ways = codes.mapInArrow(_matrices, f"conv_id {kind}, order long, ways array<bigint>")
    exits = scan(ways, _exits, f"conv_id {kind}, order long, exits array<bigint>", F.desc("order"))
    leads = codes.join(exits.select("order", "exits"), "order").mapInArrow(_turnstiles, f"conv_id {kind}, order long, exits array<bigint>, leads array<bigint>")
    entries = scan(leads, _entries, "order long, exits array<bigint>, entry int, closes boolean", F.asc("order"))
    placed = rest.join(entries, "order").select(*alone.columns)
    return alone.unionAll(placed).mapInArrow(_pieces, f"conv_id {kind}, {_PIECE.format(counts=', '.join(f'{c} long' for c in _COUNTS))}")


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation from its pieces in order; the hash goes on from piece to piece."""
    names = ("gaps", *_COUNTS, "cost")
    held, schema = None, None

    def close_row():
        first, last, distinct = held["turns"]
        gaps = 0 if first is None else min(last - first + 1 - distinct, (1 << 63) - 1)
        return {"conv_id": held["conv_id"], "gaps": gaps, **{n: held[n] for n in names[1:]}, "audit": "".join(held["audit"]), "repaired_sha256": held["hash"].hexdigest()}

    for batch in batches:
        schema = schema or _arrow(batch.schema.field("conv_id").type, *((n, _LONG) for n in names), ("audit", pa.string()), ("repaired_sha256", pa.string()))
        out = []
        for row in batch.to_pylist():
            if held is None or row["conv_id"] != held["conv_id"]:
                if held is not None:
                    out.append(close_row())
                held = {"conv_id": row["conv_id"], **dict.fromkeys(names, 0), "audit": [], "hash": hashlib.sha256(), "any": False, "turns": (None, None, 0), "initial": None}
            for n in (*_COUNTS, "cost"):
                held[n] += row[n]
            if row["first_initial"] is not None:
                held["illegal"] += held["initial"] is not None and (held["initial"], row["first_initial"]) not in _LEGAL
                held["initial"] = row["last_initial"]
            if row["n_turns"]:
                first, last, distinct = held["turns"]
                held["turns"] = (row["first_turn"] if first is None else first, row["last_turn"], distinct + row["n_turns"] - (last is not None and last == row["first_turn"]))
            held["audit"].append(row["audit"])
            for role, text in zip(row["kept_roles"], row["kept_texts"], strict=True):
                held["hash"].update((("\n" if held["any"] else "") + f"{role}:{text}").encode())
                held["any"] = True
        if out:
            yield _batch(out, schema)
    if held is not None:
        yield _batch([close_row()], schema)


def report(pieces: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of repaired conversations.

    gaps over 2^63 - 1 are given as that.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, gaps long, {', '.join(f'{c} long' for c in _COUNTS)}, cost long, audit string, repaired_sha256 string"
    several = pieces.where("not whole").repartition("conv_id").sortWithinPartitions("conv_id", "order")
    return pieces.where("whole").mapInArrow(_report, schema).unionAll(several.mapInArrow(_report, schema))


def repaired_turns(pieces: DataFrame) -> DataFrame:
    """(conv_id, order, at, role, text): the turns of repaired conversations, by order, then at."""
    return pieces.select("conv_id", "order", F.posexplode(F.arrays_zip("kept_roles", "kept_texts")).alias("at", "kept")).select("conv_id", "order", "at", F.col("kept.kept_roles").alias("role"), F.col("kept.kept_texts").alias("text"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage: faults, the cheapest edits and what they make of it."""
    return report(stage(repair(damage(table(spark, sf_dir, "conversations"))), "repaired-pieces"))


SQL = r"""
WITH RECURSIVE
steps AS (
  SELECT list(v ORDER BY i) AS t
  FROM (SELECT i, list_reduce([i::UBIGINT] || range(8)::UBIGINT[], lambda c, j: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) AS r(i))
),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS chars
  FROM conversations
),
kinds AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce([4294967295::UBIGINT] || list_transform(chars, lambda x: ord(x)::UBIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::BIGINT + 1])), 4294967295::UBIGINT) % 20 AS kind
  FROM named, steps
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, copy
  FROM kinds, range(2) AS c(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i, substr(role, 1, 1) AS initial,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 AS again
  FROM damaged
),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN again THEN 'duplicate'
    WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault,
    lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM ranked
),
coded AS (
  SELECT *, CASE WHEN fault IN ('blank', 'duplicate') THEN 1000000000 WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more FROM judged
),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id
),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': ''} AS e, {'c': 1000000000::BIGINT, 'a': ''} AS s, {'c': 5::BIGINT, 'a': 'I'} AS u, {'c': 10::BIGINT, 'a': 'II'} AS a
  FROM counted
  UNION ALL
  SELECT conv_id, i, e, s, u, list_min([a, {'c': u.c + 5, 'a': u.a || 'I'}]) AS a
  FROM (
    SELECT conv_id, i, e, s, list_min([u, {'c': e.c + 5, 'a': e.a || 'I'}, {'c': s.c + 5, 'a': s.a || 'I'}, {'c': a.c + 5, 'a': a.a || 'I'}]) AS u, a
    FROM (
      SELECT w.conv_id, r.i, {'c': w.e.c + 2, 'a': w.e.a || 'D'} AS e,
        list_min([{'c': w.s.c + 2, 'a': w.s.a || 'D'}, {'c': w.e.c + more + if(initial = 's', 0, 1000000000), 'a': w.e.a || 'K'}]) AS s,
        list_min([{'c': w.u.c + 2, 'a': w.u.a || 'D'}, {'c': w.e.c + more + if(initial = 'u', 0, 1), 'a': w.e.a || if(initial = 'u', 'K', 'R')},
          {'c': w.s.c + more + if(initial = 'u', 0, 1), 'a': w.s.a || if(initial = 'u', 'K', 'R')}, {'c': w.a.c + more + if(initial = 'u', 0, 1), 'a': w.a.a || if(initial = 'u', 'K', 'R')}]) AS u,
        list_min([{'c': w.a.c + 2, 'a': w.a.a || 'D'}, {'c': w.u.c + more + if(initial = 'a', 0, 1), 'a': w.u.a || if(initial = 'a', 'K', 'R')}]) AS a
      FROM ways w JOIN coded r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.i = w.i + 1
    )
  )
),
best AS (
  SELECT w.conv_id, list_min([w.e, w.a]) AS way FROM ways w JOIN counted c ON c.conv_id IS NOT DISTINCT FROM w.conv_id AND c.n = w.i
),
letters AS (
  SELECT conv_id, j, way.a[j] AS letter, length(replace(way.a[1:j], 'I', '')) AS i, length(replace(way.a[1:j], 'D', '')) AS o FROM best, range(1, length(way.a) + 1) AS x(j)
),
kept AS (
  SELECT l.conv_id, l.j, l.o, l.letter, r.role, r.text, max(l.letter = 'K' AND l.o = 1 AND r.initial = 's') OVER (PARTITION BY l.conv_id) AS system
  FROM letters l LEFT JOIN judged r ON r.conv_id IS NOT DISTINCT FROM l.conv_id AND r.i = l.i AND l.letter <> 'I' WHERE l.letter <> 'D'
),
said AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - system::BIGINT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS whole
  FROM kept GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(way.c, 0)::BIGINT AS cost, coalesce(way.a, '') AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN said x ON x.conv_id IS NOT DISTINCT FROM o.conv_id
"""
