"""Repair of the order of roles in conversations at least cost, by block tables after the Four Russians.

Each row of a conversation has a symbol: it must go (blank or a duplicate of an earlier row), or it is a system, user, assistant
or other row, truncated or not. What is left must read system? (user assistant)+, or nothing. An edit keeps a row, gives
it another role, deletes it, or inserts an empty row. The cost to finish from each of the four states of that language is a
vector; less its last entry it is one of a few dozen, whatever came after. For each of them and each block of
``BLOCK`` symbols, a table holds the vector in front of the block and the cost added: it is made by rule, once per worker.

Rows are sorted by ranges of (conversation, turn), and a conversation is a sequence of runs of at most ``RUN_ROWS`` rows.
Blocks are
looked up from the end, for every vector that can stand there, so a run becomes a small map, and the maps of a conversation are
put together from its last run to its first. Then each run expands its blocks backward from the vector at its end and
traces its edits for each state that it can be entered in; going forward once over the runs says which of them it was. At each
step the trace takes the ASCII-least edit among the cheapest, which leads to the least audit, since an edit and a state leave
no choice of the next state.

A conversation of any length is thus split over tasks; only the few numbers of each run are put together per conversation. The
report also gives the SHA-256 of the repaired conversation, which can't be computed in parts: there, the runs of one conversation
pass through one task, one at a time.

Null roles and texts are one space; a null conversation is one of its own. Rows are taken by turn, nulls first, then by role and text.
Repeated rows are duplicates. The initial of a role decides what it is. A conversation of which no rows are left has costs of
zero and an empty audit. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.session import stored

DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
ROLES = "sua"
LEGAL_PAIRS = {"su", "ua", "au"}
NAMES = {"u": "user", "a": "assistant"}
# States: nothing yet, after system, after user, after assistant.
NEXT_TURN = (2, 2, 3, 2)
TURN_ROLE = "uuau"
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
END_COSTS = (0, 2 * INSERT, INSERT, 0)
MUST_GO, SYMBOLS, PAD = 0, 9, 9
BLOCK = 3
BLANKS = " \t\n\v\f\r"
SENTENCE_ENDS = ".!?"
RUN_ROWS = 512
RUN_CHARS = 32_768
SORT_CHARS = 64


def symbol_of(initial: str, truncated: bool) -> int:
    kind = ROLES.find(initial) if initial else -1
    return 1 + 2 * (kind if kind >= 0 else len(ROLES)) + truncated


def edits_before(after: tuple[int, ...], symbol: int) -> tuple[list[int], list[tuple[str, int]]]:
    """Cost from each state in front of a row, given that behind it, and for each state the least edit and the state it leads to.

    An insertion stays in front of the row.
    """
    kind, extra = divmod(symbol - 1, 2)
    cost, edit = [], []
    for state in range(4):
        ways = [(DELETE + after[state], "D", state)]
        if symbol != MUST_GO:
            kept = KEEPS.get((state, ROLES[kind])) if kind < len(ROLES) else None
            if kept is not None:
                ways.append((TRUNCATED * extra + after[kept], "K", kept))
            ways.append((REROLE + TRUNCATED * extra + after[NEXT_TURN[state]], "R", NEXT_TURN[state]))
        best = min(ways)
        cost.append(best[0])
        edit.append(best[1:])
    for _ in range(2):
        for state in range(4):
            way = (INSERT + cost[NEXT_TURN[state]], "I", NEXT_TURN[state])
            if way[:2] < (cost[state], edit[state][0]):
                cost[state], edit[state] = way[0], way[1:]
    return cost, edit


class Tables:
    """All normalised vectors, and for each vector behind it the vector in front of a symbol or block, with the cost added."""

    def __init__(self):
        known, vectors, rows = {END_COSTS: 0}, [END_COSTS], []
        while len(rows) < len(vectors):
            row = []
            for symbol in range(SYMBOLS):
                cost, edit = edits_before(vectors[len(rows)], symbol)
                vector = tuple(c - cost[3] for c in cost)
                if vector not in known:
                    known[vector] = len(vectors)
                    vectors.append(vector)
                row.append((known[vector], cost[3], [self._until_row(edit, state) for state in range(4)]))
            rows.append(row)
        n = len(vectors)
        self.vectors = vectors
        self.edits = [[entry[2] for entry in row] for row in rows]
        self.one = np.array([[entry[0] for entry in row] + [i] for i, row in enumerate(rows)])
        one_cost = np.array([[entry[1] for entry in row] + [0] for row in rows])
        # block number: its symbols as digits, the first one leading
        self.next, self.cost = np.arange(n)[:, None], np.zeros((n, 1), dtype=np.int64)
        for _ in range(BLOCK):
            # another symbol in front
            self.cost = (self.cost[:, None, :] + one_cost[self.next].transpose(0, 2, 1)).reshape(n, -1)
            self.next = self.one[self.next].transpose(0, 2, 1).reshape(n, -1)

    @staticmethod
    def _until_row(edit: list[tuple[str, int]], state: int) -> tuple[str, int]:
        """Edits from a state until the row is used up."""
        letters = ""
        while True:
            letter, state = edit[state]
            letters += letter
            if letter != "I":
                return letters, state

    @staticmethod
    def blocks(symbols: bytes) -> np.ndarray:
        padded = np.full(-(-len(symbols) // BLOCK) * BLOCK, PAD, dtype=np.int64)
        padded[: len(symbols)] = np.frombuffer(symbols, dtype=np.uint8)
        return padded.reshape(-1, BLOCK) @ (PAD + 1) ** np.arange(BLOCK - 1, -1, -1)

    def run_map(self, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
        """For each vector behind a run, the vector in front of it and the cost added."""
        at, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), dtype=np.int64)
        for block in self.blocks(symbols)[::-1].tolist():
            cost += self.cost[at, block]
            at = self.next[at, block]
        return at, cost

    def trace(self, symbols: bytes, behind: int) -> list[tuple[str, int]]:
        """Edits of a run and the state it is left in, for each state it can be entered in; ``behind`` is the vector at its end."""
        ends = [behind]
        blocks = self.blocks(symbols).tolist()
        for block in reversed(blocks):
            ends.append(int(self.next[ends[-1], block]))
        ends.reverse()  # now in front of each block, and behind the last
        found = [([], state) for state in range(4)]
        for b in range(len(blocks)):
            inside, at = symbols[b * BLOCK : (b + 1) * BLOCK], ends[b + 1]
            rows = []
            for symbol in reversed(inside):
                rows.append(self.edits[at][symbol])
                at = int(self.one[at, symbol])
            for row in reversed(rows):
                for n, (letters, state) in enumerate(found):
                    more, state = row[state]
                    letters.append(more)
                    found[n] = (letters, state)
        return [("".join(letters), state) for letters, state in found]


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def finish(state: int) -> str:
    """Insertions behind the last row."""
    return "I" * (END_COSTS[state] // INSERT)


def turns_of(audit: str, roles: list[str], texts: list[str], state: int) -> list[tuple[str, str, str]]:
    """Edit, role and text of each repaired turn of a run that is entered in a state."""
    made, row = [], 0
    for letter in audit:
        if letter == "I":
            made.append(("I", NAMES[TURN_ROLE[state]], ""))
        elif letter == "R":
            made.append(("R", NAMES[TURN_ROLE[state]], texts[row]))
        elif letter == "K":
            made.append(("K", roles[row], texts[row]))
        if letter == "K":
            state = KEEPS[state, roles[row][0]]
        elif letter != "D":
            state = NEXT_TURN[state]
        row += letter != "I"
    return made


_RUN = (
    "conv string, part long, run long, symbols binary, digests array<binary>, blank long, duplicate long, truncated long, illegal long, "
    "first_initial string, last_initial string, low long, high long, first_turn long, last_turn long, turns long, roles array<string>, texts array<string>"
)


class _Run:
    """Rows of one conversation that follow each other."""

    def __init__(self, conv: str | None, part: int, run: int, seen: set):
        self.conv, self.part, self.run, self.seen = conv, part, run, seen
        self.symbols, self.digests, self.roles, self.texts, self.initials, self.turns = bytearray(), [], [], [], [], []
        self.blank = self.duplicate = self.truncated = self.chars = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        ended = text.rstrip(BLANKS)
        digest, symbol = None, MUST_GO
        if not ended:
            self.blank += 1
        else:
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            if digest in self.seen:
                digest = None
                self.duplicate += 1
            else:
                self.seen.add(digest)
                cut = ended[-1] not in SENTENCE_ENDS
                self.truncated += cut
                symbol = symbol_of(role[:1], cut)
        self.symbols.append(symbol)
        self.digests.append(digest)
        self.initials.append(role[:1])
        self.turns.append(turn)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def row(self) -> tuple:
        known = [t for t in self.turns if t is not None]
        illegal = sum(a + b not in LEGAL_PAIRS for a, b in zip(self.initials, self.initials[1:], strict=False))
        return (
            self.conv, self.part, self.run, bytes(self.symbols), self.digests, self.blank, self.duplicate, self.truncated, illegal,
            self.initials[0], self.initials[-1], min(known, default=None), max(known, default=None), self.turns[0], self.turns[-1],
            len(set(known)), self.roles, self.texts,
        )


def _arrow(schema: str) -> pa.Schema:
    plain = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}
    plain |= {f"array<{k}>": pa.list_(t) for k, t in plain.items()}
    return pa.schema([(name, plain[kind]) for name, kind in (field.split(" ") for field in schema.split(", "))])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)


def _in_batches(rows: Iterator[tuple], schema: str, weight=lambda row: 1, most: int = 2000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of at most some weight, or of one row."""
    kind, held, total = _arrow(schema), [], 0
    for row in rows:
        held.append(row)
        total += weight(row)
        if total >= most:
            yield _batch(held, kind)
            held, total = [], 0
    if held:
        yield _batch(held, kind)


def _rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows of Arrow batches, a few at a time as Python objects."""
    for whole in batches:
        for batch in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _runs(rows: DataFrame) -> DataFrame:
    """One row per run, in the order of (part, run); duplicates are known within a part."""
    filled = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), *filled)
    # a start of the text keeps the ranges' bounds short; it sorts like the text
    key = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role")]
    dealt = rows.repartitionByRange(*key, F.substring("text", 1, SORT_CHARS)).sortWithinPartitions(*key, "text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def made() -> Iterator[tuple]:
            run, n = None, 0
            for conv, turn, role, text in _rows_of(batches):
                same = run is not None and conv == run.conv
                if not same or len(run.symbols) >= RUN_ROWS or run.chars >= RUN_CHARS:
                    if run is not None:
                        yield run.row()
                    run = _Run(conv, part, n, run.seen if same else set())
                    n += 1
                run.add(turn, role, text)
            if run is not None:
                yield run.row()

        return _in_batches(made(), _RUN, weight=lambda row: len(row[3]))

    return stored(dealt.withColumn("conv_id", F.col("conv_id").cast("string")).mapInArrow(cut, _RUN), "conversation-runs")


def _later_duplicates(runs: DataFrame) -> DataFrame:
    """part, run, places: rows that stand in an earlier part of their conversation too. Most conversations lie in one part."""
    # an empty struct key would not do: a null conversation is one, so its name is tagged
    conv = F.coalesce(F.concat(F.lit("="), "conv"), F.lit("")).alias("conv")
    split = runs.groupBy(conv).agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high").select("conv")
    rows = runs.select(conv, "part", "run", "digests").join(split, "conv", "left_semi")
    rows = rows.select("conv", "part", "run", F.posexplode("digests").alias("place", "digest")).where("digest is not null")
    rows = stored(rows, "conversation-digests")
    # a digest occurs once per part, so even one that is everywhere has few rows
    first = rows.groupBy("conv", "digest").agg(F.min("part").alias("first"))
    later = rows.join(first, ["conv", "digest"]).where("part > first")
    return later.groupBy("part", "run").agg(F.collect_list("place").alias("places"))


def _per_conversation(df: DataFrame, make, schema: str, forward: bool = True) -> DataFrame:
    """``make(rows)`` over the runs of whole conversations, in order or against it; rows start with conv, part, run."""
    order = ["conv", "part", "run"] if forward else ["conv", F.desc("part"), F.desc("run")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(make(_rows_of(batches)), schema, weight=lambda row: 1)

    return df.repartition("conv").sortWithinPartitions(*order).mapInArrow(work, schema)


def _marked(runs: DataFrame) -> DataFrame:
    """Runs without texts: symbols with all duplicates, counts, and the run's map of vectors."""
    schema = "conv string, part long, run long, symbols binary, duplicate long, truncated long, map_next binary, map_cost binary"
    rows = runs.select("conv", "part", "run", "symbols", "duplicate", "truncated").join(_later_duplicates(runs), ["part", "run"], "left")
    rows = rows.select("conv", "part", "run", "symbols", "duplicate", "truncated", "places")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = tables()

        def made() -> Iterator[tuple]:
            for conv, part, run, symbols, duplicate, truncated, places in _rows_of(batches):
                if places:
                    symbols = bytearray(symbols)
                    for place in places:
                        truncated -= (symbols[place] - 1) % 2
                        symbols[place] = MUST_GO
                    duplicate, symbols = duplicate + len(places), bytes(symbols)
                to, cost = known.run_map(symbols)
                yield conv, part, run, symbols, duplicate, truncated, to.astype(np.int64).tobytes(), cost.tobytes()

        return _in_batches(made(), schema)

    return stored(rows.mapInArrow(mark, schema), "conversation-marks")


def _ends(marked: DataFrame) -> DataFrame:
    """For each run the vector behind it, whether it is the last, and the least cost of the conversation from it on."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        known, first, before = tables(), True, None
        for conv, part, run, to, cost in rows:
            last = first or conv != before
            if last:
                at, total = 0, 0
            behind = at
            total += int(np.frombuffer(cost, dtype=np.int64)[at])
            at = int(np.frombuffer(to, dtype=np.int64)[at])
            yield part, run, behind, last, total + known.vectors[at][0]
            first, before = False, conv

    return _per_conversation(marked.select("conv", "part", "run", "map_next", "map_cost"), fold, "part long, run long, behind long, last boolean, cost long", forward=False)


def _traced(marked: DataFrame) -> DataFrame:
    """For each run the edits and the state left, by the state entered; insertions at the end of a conversation belong to its last run."""
    schema = "conv string, part long, run long, cost long, audits array<string>, exits array<long>"
    rows = marked.select("conv", "part", "run", "symbols").join(stored(_ends(marked), "conversation-ends"), ["part", "run"])
    rows = rows.select("conv", "part", "run", "symbols", "behind", "last", "cost")

    def trace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for conv, part, run, symbols, behind, last, cost in _rows_of(batches):
                found = tables().trace(symbols, behind)
                yield conv, part, run, cost, [a + finish(s) if last else a for a, s in found], [s for _, s in found]

        return _in_batches(made(), schema, weight=lambda row: len(row[4][0]), most=200_000)

    return stored(rows.mapInArrow(trace, schema), "conversation-traces")


def _entered(traced: DataFrame) -> DataFrame:
    """For each run the state it is entered in and the number of repaired turns before it."""

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        first, before = True, None
        for conv, part, run, turns, exits in rows:
            if first or conv != before:
                state, made = 0, 0
            yield part, run, state, made
            made += turns[state]
            state, first, before = exits[state], False, conv

    left = F.transform("audits", lambda a: F.length(F.translate(a, "D", "")).cast("long"))
    return _per_conversation(traced.select("conv", "part", "run", left.alias("left"), "exits"), fold, "part long, run long, state long, made long")


def repaired_runs(rows: DataFrame) -> DataFrame:
    """The runs of all conversations with their audit, cost (of the conversation, in its first run) and repaired turns (edit, role, text)."""
    runs = _runs(rows)
    marked = _marked(runs)
    traced = _traced(marked)
    chosen = traced.join(_entered(traced), ["part", "run"])
    chosen = chosen.select("part", "run", "cost", "state", "made", F.element_at("audits", (F.col("state") + 1).cast("int")).alias("audit"))
    both = runs.drop("symbols", "digests", "duplicate", "truncated").join(marked.select("part", "run", "duplicate", "truncated"), ["part", "run"]).join(chosen, ["part", "run"])
    return both.withColumn("edited", _turns("audit", "roles", "texts", "state")).drop("roles", "texts", "state")


def _turns(*columns: str):
    """Edits, roles and texts of the repaired turns as three arrays."""

    @F.pandas_udf("struct<edits:array<string>,roles:array<string>,texts:array<string>>")
    def of(audit: pd.Series, roles: pd.Series, texts: pd.Series, state: pd.Series) -> pd.DataFrame:
        made = [turns_of(*row) for row in zip(audit, roles, texts, state, strict=True)]
        return pd.DataFrame({name: [[t[i] for t in turns] for turns in made] for i, name in enumerate(("edits", "roles", "texts"))})

    return of(*columns)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """The repaired conversations: conv_id, turn (from 0 on), role, text, edit (K kept, R given another role, I inserted)."""
    runs = repaired_runs(rows)
    placed = runs.select("conv", "made", F.posexplode(F.arrays_zip(*[F.col(f"edited.{c}").alias(c) for c in ("edits", "roles", "texts")])).alias("place", "t"))
    kind = rows.schema["conv_id"].dataType.simpleString()
    return placed.select(F.col("conv").cast(kind).alias("conv_id"), (F.col("made") + F.col("place")).alias("turn"), F.col("t.roles").alias("role"), F.col("t.texts").alias("text"), F.col("t.edits").alias("edit"))


_REPORT = "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    columns = [
        "conv", "part", "run", "blank", "duplicate", "truncated", "illegal", "first_initial", "last_initial", "low", "high", "first_turn",
        "last_turn", "turns", "cost", "audit", F.col("edited.roles").alias("roles"), F.col("edited.texts").alias("texts"),
    ]

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        now = None
        for conv, _, _, blank, duplicate, truncated, illegal, initial, last_initial, low, high, turn, last_turn, turns, cost, audit, roles, texts in rows:
            if now is None or now.conv != conv:
                if now is not None:
                    yield now.row()
                now = _Report(conv, cost)
            elif now.initial + initial not in LEGAL_PAIRS:
                illegal += 1
            if turn is not None and turn == now.turn:
                turns -= 1
            now.counts += (blank, duplicate, truncated, illegal)
            now.low = low if now.low is None else now.low
            now.high = now.high if high is None else high
            now.turns += turns
            now.initial, now.turn = last_initial, last_turn
            now.audit.append(audit)
            for role, text in zip(roles, texts, strict=True):
                now.digest.update(f"{now.between}{role}:{text}".encode())
                now.between = "\n"
        if now is not None:
            yield now.row()

    kind = rows.schema["conv_id"].dataType.simpleString()
    found = _per_conversation(repaired_runs(rows).select(*columns), fold, _REPORT)
    return found.select(F.col("conv").cast(kind).alias("conv_id"), *[c for c in found.columns if c != "conv"])


class _Report:
    """What is known of a conversation so far."""

    def __init__(self, conv: str | None, cost: int):
        self.conv, self.cost, self.between, self.audit, self.digest = conv, cost, "", [], hashlib.sha256()
        self.counts = np.zeros(4, dtype=np.int64)
        self.low = self.high = self.initial = self.turn = None
        self.turns = 0

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, *self.counts.tolist(), self.cost, "".join(self.audit), self.digest.hexdigest())


def report_all(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """The report with a row for every conversation of a table, also those of which ``rows`` has nothing left."""
    every = conversations.select(F.col("conv_id").alias("id")).distinct()
    found = every.join(repair_report(rows), F.col("id").eqNullSafe(F.col("conv_id")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256")
    return found.select(F.col("id").alias("conv_id"), *counts, *empty)
