"""Repair of the structure of conversations by a time-major tensor program.

A conversation shall have roles that read ``(s?(ua)+)?`` by their initials. States
are what stands last in the repaired conversation: nothing, system, user, assistant.
Conversations of one length form a bucket; per turn the costs of all states of all
its conversations are updated at once, from the last turn to the first. The costs
are kept, and the cheapest edits are traced forward for all conversations together,
the ASCII-least of equally cheap ones first.

One shuffle brings the rows of a conversation together, sorted. Conversations wait
for a batch as long as they are short; one that grows beyond ``LONG_ROWS`` rows or
``LONG_CHARS`` characters is taken row by row, with the best path into each state
and the running digest of its repaired text (``_Long``). So texts are never held
beyond that bound; a digest of one text can only be made by one task. What grows
with a long conversation is 4 bytes of back pointers and one 16-byte digest a row,
less than a task would need for the audit and the turns themselves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphline.llm.encode import text_slices

SPACE = " \t\n\x0b\x0c\r"
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
INITIALS = {"s": 0, "u": 1, "a": 2}
#: State after a user or assistant turn was put behind a state.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: State after a turn of the initial s, u, a or another was kept behind a state; -1: not allowed.
KEEP = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: What is still to be paid at the end, by inserted turns.
END = np.array([0, 10, 5, 0])
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NEVER = 1 << 40
BLANK, DUPLICATE, CUT = 1, 2, 3
LONG_ROWS, LONG_CHARS, BATCH_ROWS, BATCH_CHARS = 1024, 4 << 20, 1 << 15, 8 << 20

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, repaired string"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): each row as often as ``copies`` says, damaged by the checksum of its conversation and turn.

    Nulls count as one space, but null conversations and turns stay null. A dropped row stays with no copies.
    """
    space = F.lit(" ")
    said = lambda name: F.coalesce(F.col(name).cast("string"), space)
    hit = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20
    text = F.when(hit == 1, "").when(hit == 2, F.translate(said("text"), ".!?", "")).otherwise(said("text"))
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.when(hit == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"),
        F.when(hit == 0, 0).when(hit == 3, 2).otherwise(1).alias("copies"),
    )


def repair(rows: DataFrame, texts: bool = False) -> DataFrame:
    """One row for each conv_id of ``rows`` (conv_id, turn, role, text, copies), as ``damaged`` gives them.

    Columns: conv_id; gaps, blank, duplicate, truncated and illegal (what was wrong),
    cost and audit (the cheapest edits), repaired_sha256 (of the repaired ``role:text``,
    newline-joined), and repaired, that text itself, where ``texts`` is set.

    Rows of one turn stand by role, then by text; null turns first; rows without
    conv_id are one conversation. An empty text is blank, an empty role has no initial
    and is never kept. A conversation without copies has zeros, an empty audit and the
    digest of the empty text. An empty table gives an empty result, further columns
    are ignored. Very long texts or conversations cost time, not memory, unless
    ``texts`` asks for the whole of them.
    """
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    facts: list[Column] = [(bare == "").alias("blank"), F.substring(bare, -1, 1).isin(".", "!", "?").alias("closed")]
    picked = rows.select("conv_id", "turn", "role", "text", F.col("copies").cast("int").alias("copies"), *facts)
    together = picked.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    found = together.mapInArrow(lambda parts: _repaired(parts, texts), RESULT)
    return found if texts else found.drop("repaired")


class _Conversation:
    """Facts of a conversation, gathered row by row; its rows too until it is long."""

    def __init__(self, conv_id: int | None, whole: bool = False):
        self.whole, self.conv_id, self.faults, self.illegal, self.seen = whole, conv_id, [0, 0, 0, 0], 0, set()
        self.low = self.high = None
        self.turns, self.chars, self.last, self.rows, self.long = 0, 0, None, [], None

    def add(self, turn: int | None, role: str, text: str, blank: bool, closed: bool) -> None:
        if turn is not None and turn != self.high:  # rows come by turn
            self.turns, self.high = self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        initial = role[:1]
        if self.last is not None and self.last + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.last = initial
        fault = BLANK if blank else 0
        if not blank:
            key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
            fault = DUPLICATE if key in self.seen else 0 if closed else CUT
            self.seen.add(key)
        self.faults[fault] += 1
        row = role, text, INITIALS.get(initial, 3), fault
        if self.long is not None:
            self.long.add(*row)
            return
        self.rows.append(row)
        self.chars += len(text)
        if not self.whole and (len(self.rows) > LONG_ROWS or self.chars > LONG_CHARS):
            self.long = _Long()
            for held in self.rows:
                self.long.add(*held)
            self.rows = []

    def result(self, cost: int, audit: str, digest: str, repaired: str | None) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, self.faults[BLANK], self.faults[DUPLICATE], self.faults[CUT], self.illegal, cost, audit, digest, repaired


class _Long:
    """The cheapest, ASCII-least way into each state, with the digest of what it has written."""

    ACTIONS = sorted("I" * k + edit for k in range(3) for edit in "DKR")

    def __init__(self):
        # state: cost, rank among the ways by ASCII, digest, whether anything was written
        self.ways = {NOTHING: (0, 0, hashlib.sha256(), False)}
        self.back = {state: bytearray() for state in range(4)}

    def add(self, role: str, text: str, initial: int, fault: int) -> None:
        found: dict[int, tuple] = {}
        for state, (cost, rank, _, _) in self.ways.items():
            at = state
            for inserts in range(3):
                base = cost + INSERT * inserts
                choices = [(base + DELETE, "D", at)]
                if fault not in (BLANK, DUPLICATE):
                    more = TRUNCATED if fault == CUT else 0
                    choices.append((base + REROLE + more, "R", int(NEXT[at])))
                    if KEEP[at, initial] >= 0:
                        choices.append((base + more, "K", int(KEEP[at, initial])))
                for price, edit, to in choices:
                    way = price, rank, self.ACTIONS.index("I" * inserts + edit), state
                    if to not in found or way < found[to]:
                        found[to] = way
                at = int(NEXT[at])
        order = {to: k for k, to in enumerate(sorted(found, key=lambda to: found[to][1:3]))}
        ways = {}
        for to, (price, _, action, state) in found.items():
            _, _, digest, begun = self.ways[state]
            digest = digest.copy()
            for piece in self._written(self.ACTIONS[action], state, role, text):
                digest.update((("\n" if begun else "") + piece).encode("utf-8", "surrogatepass"))
                begun = True
            ways[to] = price, order[to], digest, begun
        for state in range(4):
            self.back[state].append(found[state][3] * 9 + found[state][2] if state in found else 255)
        self.ways = ways

    @staticmethod
    def _written(action: str, state: int, role: str, text: str) -> Iterator[str]:
        for edit in action:
            if edit in "IR":
                state = int(NEXT[state])
                yield f"{NAMES[state]}:{text if edit == 'R' else ''}"
            elif edit == "K":
                yield f"{role}:{text}"

    def result(self) -> tuple[int, str, str]:
        state = min(self.ways, key=lambda s: (self.ways[s][0] + END[s], self.ways[s][1]))
        cost, _, digest, begun = self.ways[state]
        inserts = int(END[state]) // INSERT
        for piece in self._written("I" * inserts, state, "", ""):
            digest.update((("\n" if begun else "") + piece).encode())
            begun = True
        audit, at = ["I" * inserts], state
        for k in range(len(self.back[0]) - 1, -1, -1):
            at, action = divmod(self.back[at][k], 9)
            audit.append(self.ACTIONS[action])
        return int(cost + END[state]), "".join(reversed(audit)), digest.hexdigest()


def trace(initial: np.ndarray, fault: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Costs, edits and states of a bucket from ``initial`` and ``fault``, both (turns, conversations).

    Edits are ASCII codes, three places a turn (two inserts at most, then the turn's
    own edit), 0 where there is none; states are those after each edit.
    """
    turns, many = initial.shape
    one = np.arange(many)
    back = np.empty((turns + 1, many, 4), np.int64)
    back[turns] = END
    free = (fault != BLANK) & (fault != DUPLICATE)
    more = np.where(fault == CUT, TRUNCATED, 0)
    for t in range(turns - 1, -1, -1):
        after = back[t + 1]
        target = KEEP[:, initial[t]].T
        keep = np.where((target >= 0) & free[t, :, None], after[one[:, None], np.maximum(target, 0)] + more[t, :, None], NEVER)
        rerole = np.where(free[t, :, None], after[:, NEXT] + REROLE + more[t, :, None], NEVER)
        edit = np.minimum(np.minimum(after + DELETE, keep), rerole)
        back[t] = np.minimum(edit, np.minimum(edit[:, NEXT] + INSERT, edit[:, NEXT[NEXT]] + 2 * INSERT))
    edits, states = np.zeros((3 * (turns + 1), many), np.uint8), np.zeros((3 * (turns + 1), many), np.int8)
    state = np.full(many, NOTHING)
    for t in range(turns + 1):
        delete = np.zeros(many, bool)
        for k in range(2):
            now = back[t, one, state]
            if t < turns:
                delete = back[t + 1, one, state] + DELETE == now
            insert = ~delete & (back[t, one, NEXT[state]] + INSERT == now)
            state = np.where(insert, NEXT[state], state)
            edits[3 * t + k], states[3 * t + k] = np.where(insert, ord("I"), 0), state
        if t < turns:
            now, after = back[t, one, state], back[t + 1]
            delete = after[one, state] + DELETE == now
            target = KEEP[state, initial[t]]
            keep = ~delete & free[t] & (target >= 0) & (after[one, np.maximum(target, 0)] + more[t] == now)
            state = np.where(delete, state, np.where(keep, target, NEXT[state]))
            edits[3 * t + 2], states[3 * t + 2] = np.where(delete, ord("D"), np.where(keep, ord("K"), ord("R"))), state
    return back[0, :, NOTHING], edits, states


def _traced(held: list[_Conversation], texts: bool) -> Iterator[tuple]:
    """Results of conversations that are held whole, bucket by bucket."""
    buckets: dict[int, list[_Conversation]] = {}
    for one in held:
        buckets.setdefault(len(one.rows), []).append(one)
    for length, bucket in buckets.items():
        facts = np.array([[row[2:] for row in one.rows] for one in bucket], np.int64).reshape(len(bucket), length, 2)
        cost, edits, states = trace(facts[:, :, 0].T, facts[:, :, 1].T)
        edits, states = np.ascontiguousarray(edits.T), states.T
        for c, one in enumerate(bucket):
            pieces, turn = [], iter(one.rows)
            for at in np.flatnonzero(edits[c]):
                edit = chr(edits[c, at])
                role, text = ("", "") if edit == "I" else next(turn)[:2]
                if edit in "IR":
                    role = NAMES[int(states[c, at])]
                if edit != "D":
                    pieces.append(f"{role}:{text}")
            whole = "\n".join(pieces)
            audit = edits[c].tobytes().replace(b"\0", b"").decode()
            yield one.result(int(cost[c]), audit, hashlib.sha256(whole.encode("utf-8", "surrogatepass")).hexdigest(), whole if texts else None)


def _conversations(parts: Iterable[pa.RecordBatch], whole: bool) -> Iterator[_Conversation]:
    """Conversations of sorted rows, one after another; ``whole``: all their rows are kept."""
    one = None
    for batch in parts:
        for a, b, texts in text_slices(batch.column(3), 1 << 20):
            columns = [batch.column(k).slice(a, b - a).to_pylist() for k in (0, 1, 2, 4, 5, 6)]
            for conv_id, turn, role, copies, blank, closed, text in zip(*columns, texts, strict=True):
                if one is None or one.conv_id != conv_id:
                    if one is not None:
                        yield one
                    one = _Conversation(conv_id, whole)
                for _ in range(copies):
                    one.add(turn, role, text, blank, closed)
    if one is not None:
        yield one


def _repaired(parts: Iterator[pa.RecordBatch], texts: bool) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(name, pa.string() if kind == "string" else pa.int64()) for name, kind in (c.split(" ") for c in RESULT.split(", "))])
    flush = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
    held: list[_Conversation] = []
    rows = chars = 0
    for one in _conversations(parts, texts):
        if one.long is not None:
            yield flush([one.result(*one.long.result(), None)])
            continue
        held.append(one)
        rows, chars = rows + len(one.rows) + 1, chars + one.chars
        if rows >= BATCH_ROWS or chars >= BATCH_CHARS:
            yield flush(list(_traced(held, texts)))
            held, rows, chars = [], 0, 0
    if held:
        yield flush(list(_traced(held, texts)))
