"""Cheapest repair of conversations: one integer a choice, compared as integers alone."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shoalgrid.llm.store import written

#: Costs of the edits; an undeleted truncated row adds TRUNCATED. Keep costs nothing.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: Bits of an audit letter, the letters in ASCII order (0 is the padding at the end), and letters a row can take: two insertions and its own.
BITS, LETTERS, ROW_LETTERS = 3, " DIKR", 3
DROPPED, INSERTED, KEPT, REROLED = 1, 2, 3, 4
#: States of ``(s?(ua)+)?``: nothing yet, after s, after u, after a. It may end in the first and the last.
STATES = 4
START, SYSTEM, USER, ASSISTANT = range(STATES)
MOVES = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
#: A conversation goes to several segments, of up to so many rows or characters each, where it is longer or runs on into the next partition.
SEGMENT_ROWS, SEGMENT_CHARS = 256, 1 << 18
#: A message that many turns of a conversation repeat is dealt to so many tasks.
SALTS = 16


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows after the damage, equal ones as one row with their number ``n``; a conversation's dropped rows are one row of n = 0."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(kind == 4, "user").otherwise(blank("role"))
    there = lambda c: F.when(kind != 0, c)
    rows = conversations.select(
        "conv_id", there(F.col("turn")).alias("turn"), there(role).alias("role"), there(text).alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("n")
    )
    return rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))


def _with_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` with ``again``: whether an earlier turn of the conversation has the same role and text.

    Only messages of two or more turns are joined back, one row each with their first turn, dealt by salt.
    """
    order = lambda c: F.struct(F.col(c).isNotNull().alias("there"), F.col(c).alias("turn"))
    rows = rows.withColumn("h", F.sha2(F.col("text").cast("binary"), 256)).withColumn("at", order("turn"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("turn"), F.lit(SALTS)))
    firsts = rows.filter("n > 0").groupBy("conv_id", "role", "h").agg(F.min("at").alias("first"), F.count("*").alias("turns")).filter("turns > 1")
    firsts = firsts.select(*(F.col(c).alias(f"_{c}") for c in ("conv_id", "role", "h")), "first", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).alias("_salt"))
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("role") == F.col("_role")) & (F.col("h") == F.col("_h")) & (F.col("salt") == F.col("_salt"))
    joined = rows.join(firsts.hint("merge"), same, "left")
    return joined.select("conv_id", "turn", "role", "text", "n", F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("again"))


def fault(again: Column | str = "again", text: Column | str = "text") -> Column:
    """A row's first fault: ``b``\\ lank, ``d``\\ uplicate, ``t``\\ runcated, or ``g``\\ ood."""
    again, text = (F.col(x) if isinstance(x, str) else x for x in (again, text))
    last = F.right(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    return F.when(last == "", "b").when(again, "d").when(~last.isin(".", "!", "?"), "t").otherwise("g")


# --- scalars: cost in the digits above, letters from the left below, zeros behind them ---


def _one(cost: int, letters: list[int], width: int) -> int:
    value = cost
    for k in range(width):
        value = value << BITS | (letters[k] if k < len(letters) else 0)
    return value


def _count(value: int, width: int) -> int:
    """Letters in ``value``: its digits without the zeros at the end."""
    digits = value & ((1 << BITS * width) - 1)
    return width - ((digits & -digits).bit_length() - 1) // BITS if digits else 0


def _after(left: int, count: int, left_width: int, right: int, right_width: int) -> int:
    """The scalar of ``left``'s edits (``count`` letters) and then ``right``'s."""
    low, shift = right & ((1 << BITS * right_width) - 1), BITS * (left_width - count)
    return (left << BITS * right_width) + ((right >> BITS * right_width) << BITS * (left_width + right_width)) + (low << shift)


@lru_cache(maxsize=None)
def _row_edges(initial: str, flaw: str) -> tuple:
    """(state before, state after, scalar, letters) of insertions and then a row's own edit, the least of each pair of states."""
    least: dict = {}

    def note(start: int, end: int, cost: int, letters: list[int]) -> None:
        value = _one(cost, letters, ROW_LETTERS)
        if value < least.get((start, end), (value + 1,))[0]:
            least[start, end] = value, len(letters)

    for start in range(STATES):
        for mid, cost, letters in _insertions(start):
            note(start, mid, cost + DELETE, [*letters, DROPPED])
            if flaw in "gt":
                more = cost + (TRUNCATED if flaw == "t" else 0)
                for role, end in MOVES[mid].items():
                    if role == initial:
                        note(start, end, more, [*letters, KEPT])
                    if role != "s":
                        note(start, end, more + REROLE, [*letters, REROLED])
    return tuple((s, e, v, k) for (s, e), (v, k) in least.items())


@lru_cache(maxsize=None)
def _insertions(start: int) -> tuple:
    """(state, cost, letters) that none, one or two insertions reach; a third only repeats a state at a higher cost."""
    out, state = [(start, 0, ())], start
    for k in (1, 2):
        state = ASSISTANT if state == USER else USER
        out.append((state, INSERT * k, (INSERTED,) * k))
    return tuple(out)


@lru_cache(maxsize=None)
def _ends() -> list:
    """By state: the scalar of the insertions, in ROW_LETTERS digits, that end a conversation."""
    return [min(_one(c, list(x), ROW_LETTERS) for e, c, x in _insertions(s) if e in (START, ASSISTANT)) for s in range(STATES)]


def _fold(rows: list, after: list, width: int) -> tuple[list, int]:
    """Scalars by state before ``rows``, (initial, flaw) pairs, given those by state ``after`` them (None: out of reach).

    From the last row to the first; a row's edges and the integers' minimum decide each state.
    """
    for initial, flaw in reversed(rows):
        before: list = [None] * STATES
        for start, end, edge, count in _row_edges(initial, flaw):
            if after[end] is not None:
                value = _after(edge, count, ROW_LETTERS, after[end], width)
                if before[start] is None or value < before[start]:
                    before[start] = value
        after, width = before, width + ROW_LETTERS
    return after, width


def _read(value: int, width: int) -> tuple[int, str]:
    """(cost, audit) of a scalar."""
    count, digits = _count(value, width), (value & ((1 << BITS * width) - 1)) >> BITS * (width - _count(value, width))
    return value >> BITS * width, "".join(LETTERS[int(c)] for c in (f"{digits:o}".zfill(count) if count else ""))


def cheapest(rows: list) -> tuple[int, str]:
    """(cost, audit) of the cheapest edits of a whole conversation of (initial, flaw) rows."""
    values, width = _fold(rows, _ends(), ROW_LETTERS)
    return _read(values[START], width)


def segment_table(rows: list) -> tuple[list, int]:
    """Scalars by state before and after ``rows``, in a list by (before, after), and their width."""
    table, width = [[None] * STATES for _ in range(STATES)], 0
    for end in range(STATES):
        values, width = _fold(rows, [0 if k == end else None for k in range(STATES)], 0)
        for start in range(STATES):
            table[start][end] = values[start]
    return table, width


def _product(left: tuple, right: tuple) -> tuple:
    """Scalars of two neighbouring segments' edits: the minimum over the state between them."""
    (x, wx), (y, wy) = left, right
    out: list = [[None] * STATES for _ in range(STATES)]
    for start in range(STATES):
        for mid in range(STATES):
            if x[start][mid] is not None:
                count = _count(x[start][mid], wx)
                for end in range(STATES):
                    if y[mid][end] is not None:
                        value = _after(x[start][mid], count, wx, y[mid][end], wy)
                        if out[start][end] is None or value < out[start][end]:
                            out[start][end] = value
    return out, wx + wy


def cheapest_of_segments(tables: list) -> tuple[int, str]:
    """(cost, audit) of a conversation given its segments' tables in order, multiplied in pairs, pairs of pairs and so on."""
    while len(tables) > 1:
        tables = [_product(*tables[k : k + 2]) if k + 1 < len(tables) else tables[k] for k in range(0, len(tables), 2)]
    (table, width), ends = tables[0], _ends()
    found = [_after(table[START][s], _count(table[START][s], width), width, ends[s], ROW_LETTERS) for s in range(STATES) if table[START][s] is not None]
    return _read(min(found), width + ROW_LETTERS)


# --- repaired texts ---


def _repaired(rows: Iterator, audit: str, state: int) -> tuple[list[bytes], int]:
    """Lines ``role:text`` that the edits leave of (role, text) rows, and the state after them."""
    lines = []
    for letter in audit:
        if letter == "D":
            next(rows)
            continue
        role, text = (None, "") if letter == "I" else next(rows)
        if letter != "K":
            role = "assistant" if state == USER else "user"
        state = MOVES[state][role[:1]]
        lines.append(f"{role}:{text}".encode())
    return lines, state


class _Run:
    """Rows of one conversation as they come by in order: faults, adjacent roles, turns, and what a segment holds."""

    def __init__(self, conv):
        self.conv = conv
        self.clear()

    def clear(self) -> None:
        self.rows, self.chars, self.faults, self.texts = 0, 0, [], []
        self.low = self.high = None
        self.turns, self.last_turn = 0, None
        self.illegal = 0

    def add(self, turn, role: str, text: str, flaw: str, copies: int) -> None:
        if turn is not None:
            self.low, self.high = turn if self.low is None else self.low, turn
            if turn != self.last_turn:
                self.turns, self.last_turn = self.turns + 1, turn
        for k in range(copies):
            initial = role[:1]
            if self.faults and self.faults[-1][0] + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.faults.append((initial, flaw if k == 0 or flaw == "b" else "d"))
            self.texts.append((role, text))
        self.rows += copies
        self.chars += copies * len(text)

    def counts(self) -> list[int]:
        return [sum(f == k for _, f in self.faults) for k in "bdt"]


SEGMENTS = (
    "conv_id {id}, whole boolean, part long, seq long, low {turn}, high {turn}, turns long, first string, last string, "
    "blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string, "
    "rows long, table array<binary>, width long, texts binary"
)


def _segments(rows: DataFrame, id_kind: str, turn_kind: str) -> DataFrame:
    """A row for each conversation that lies within its partition and isn't long, done; otherwise one for each of its segments.

    Rows are sorted over all partitions by conversation, turn, role and text, so only conversations at the edges of
    partitions, and long ones, have segments; a very long one is in many partitions.
    """
    n = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    line = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    line = line.select("conv_id", "turn", "role", "text", "n", fault().alias("flaw"))

    def run(batches: Iterator) -> Iterator:
        import hashlib
        import pickle

        import pyarrow as pa
        from pyspark import TaskContext

        names = [x.split()[0] for x in SEGMENTS.split(", ")]
        part, seq, out = TaskContext.get().partitionId(), 0, []

        def done(r: _Run) -> list:
            cost, audit = cheapest(r.faults)
            lines, _ = _repaired(iter(r.texts), audit, START)
            return [r.conv, True, part, 0, r.low, r.high, r.turns, None, None, *r.counts(), r.illegal, cost, audit, hashlib.sha256(b"\n".join(lines)).hexdigest(), r.rows, None, None, None]

        def piece(r: _Run) -> list:
            table, width = segment_table(r.faults)
            flat = [b"" if v is None else v.to_bytes((v.bit_length() + 8) // 8, "big") for line in table for v in line]
            ends = (r.faults[0][0], r.faults[-1][0]) if r.faults else (None, None)
            return [r.conv, False, part, seq, r.low, r.high, r.turns, *ends, *r.counts(), r.illegal, None, None, None, r.rows, flat, width, pickle.dumps(r.texts)]

        def flush() -> pa.RecordBatch:
            types = [conv_type, pa.bool_(), pa.int64(), pa.int64(), turn_type, turn_type, pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.int64(), pa.list_(pa.binary()), pa.int64(), pa.binary()]
            got = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)
            out.clear()
            return got

        now, edge, weight = None, True, 0  # the first conversation of a partition may have begun before it
        for batch in batches:
            conv_type, turn_type = batch.schema.field(0).type, batch.schema.field(1).type
            for at in range(0, batch.num_rows, 500):
                columns = [c.to_pylist() for c in batch.slice(at, 500).columns]
                for conv, turn, role, text, copies, flaw in zip(*columns):
                    if now is None or now.conv != conv:
                        if now is not None:
                            out.append(piece(now) if edge else done(now))
                            seq, edge = seq + 1, False
                        now = _Run(conv)
                    while copies:
                        if now.rows >= SEGMENT_ROWS or now.chars >= SEGMENT_CHARS:
                            out.append(piece(now))
                            seq, edge = seq + 1, True
                            now.clear()
                        # A row repeated many times goes to several segments; all but its first copy are duplicates.
                        some = min(copies, SEGMENT_ROWS)
                        now.add(turn, role, text, flaw, some)
                        copies, flaw = copies - some, flaw if flaw == "b" else "d"
                    weight += len(text or "")
                    if len(out) >= 500 or weight > 1 << 24 and out:
                        yield flush()
                        weight = 0
        if now is not None:
            out.append(piece(now))
        if out:
            yield flush()

    return line.mapInArrow(run, SEGMENTS.format(id=id_kind, turn=turn_kind))


def _table(flat: list) -> list:
    values = [int.from_bytes(v, "big") if v else None for v in flat]
    return [values[k : k + STATES] for k in range(0, STATES * STATES, STATES)]


def _pieces(segments: list) -> tuple[int, str, list]:
    """(cost, audit, (state before, part of the audit) by segment) of a conversation's segments."""
    tables = [(_table(x["table"]), x["width"]) for x in segments]
    cost, audit = cheapest_of_segments(tables)
    out, state, at = [], START, 0
    for k, (x, (table, width)) in enumerate(zip(segments, tables)):
        begin, rows = at, 0
        while rows < x["rows"]:
            rows += audit[at] != "I"
            at += 1
        piece = audit[begin:at]
        out.append((state, piece if k + 1 < len(segments) else audit[begin:]))
        # Letters tell the roles, so one state alone has this part of the audit.
        state = next(e for e in range(STATES) if table[state][e] is not None and _read(table[state][e], width)[1] == piece)
    return cost, audit, out


def _chosen(segments: DataFrame) -> DataFrame:
    """(part, seq) of each segment with its state before and part of the audit; a conversation's first one has the conversation's figures."""
    small = segments.drop("texts", "whole", "cost", "audit", "repaired_sha256")
    small = small.repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")
    figures = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def result(line: list) -> pa.RecordBatch:
            cost, audit, pieces = _pieces(line)
            real = [x for x in line if x["rows"]]
            illegal = sum(x["illegal"] for x in real) + sum(x["last"] + y["first"] not in ("su", "ua", "au") for x, y in zip(real, real[1:]))
            timed = [x for x in real if x["low"] is not None]
            turns = sum(x["turns"] for x in timed) - sum(x["high"] == y["low"] for x, y in zip(timed, timed[1:]))
            gaps = timed[-1]["high"] - timed[0]["low"] + 1 - turns if timed else 0
            head = [gaps, *(sum(x[k] for x in real) for k in ("blank", "duplicate", "truncated")), illegal, cost]
            columns = {"part": [x["part"] for x in line], "seq": [x["seq"] for x in line], "state": [s for s, _ in pieces], "piece": [p for _, p in pieces]}
            rest = [None] * (len(line) - 1)
            kinds = {"piece": pa.string(), "audit": pa.string()}
            columns |= {k: [v, *rest] for k, v in zip((*figures, "audit"), (*head, audit))}
            return pa.RecordBatch.from_arrays([pa.array(v, kinds.get(k, pa.int64())) for k, v in columns.items()], names=list(columns))

        line, now = [], None
        for batch in batches:
            for x in batch.to_pylist():
                if line and x["conv_id"] != now:
                    yield result(line)
                    line = []
                now = x["conv_id"]
                line.append(x)
        if line:
            yield result(line)

    return small.mapInArrow(run, "part long, seq long, state long, piece string, " + ", ".join(f"{k} long" for k in figures) + ", audit string")


def _lines(segments: DataFrame) -> DataFrame:
    """Segments with ``texts`` and their part of the audit, to the same rows with the repaired ``lines`` (null: none left)."""

    def run(batches: Iterator) -> Iterator:
        import pickle

        import pyarrow as pa

        for batch in batches:
            names = batch.schema.names
            texts, pieces, states = (batch.column(names.index(k)) for k in ("texts", "piece", "state"))
            lines = [_repaired(iter(pickle.loads(t.as_py())), p.as_py(), s.as_py())[0] for t, p, s in zip(texts, pieces, states)]
            kept = [k for k, n in enumerate(names) if n not in ("texts", "piece", "state")]
            columns = [batch.column(k) for k in kept] + [pa.array([b"\n".join(x) if x else None for x in lines], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[*(names[k] for k in kept), "lines"])

    kept = segments.drop("texts", "piece", "state")
    return segments.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema) + ", lines binary")


def _hashed(lines: DataFrame) -> DataFrame:
    """One row a conversation: the figures of its first segment, and the hash of all its lines, a segment at a time."""
    out = ["conv_id", *(c for c in lines.columns if c not in ("conv_id", "part", "seq", "lines"))]
    line = lines.select(*out, "part", "seq", "lines").repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq")

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        head = digest = None
        begun = False

        def result() -> pa.RecordBatch:
            columns = [*head.columns, pa.array([digest.hexdigest()])]
            return pa.RecordBatch.from_arrays(columns, names=[*head.schema.names, "repaired_sha256"])

        for batch in batches:
            ids, texts = batch.column(0), batch.column(batch.num_columns - 1)
            for k in range(batch.num_rows):
                if head is None or ids[k].as_py() != head.column(0)[0].as_py():
                    if head is not None:
                        yield result()
                    head, digest, begun = batch.slice(k, 1).select(out), hashlib.sha256(), False
                if texts[k].is_valid:
                    digest.update(b"\n" * begun + texts[k].as_py())
                    begun = True
        if head is not None:
            yield result()

    return line.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in lines.select(out).schema) + ", repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost (longs), audit and repaired_sha256 of every conv_id of the damaged table.

    A conversation's rows are sorted by turn (nulls first), then by role and text; equal rows count as often as they
    come. Insertions, deletions, new roles and what is kept are paths through the states of ``(s?(ua)+)?``; one integer
    a path has its cost above fixed-width letters from the left with zeros behind, so a suffix takes a letter in
    front by a shift, and the smallest integer is the cheapest edits and of these the least audit. Segments of a
    long conversation give such integers for each pair of states, which multiply in any grouping, so its rows are
    in many tasks; only its letters, and then the hash of its repaired lines a segment at a time, are in one.

    Nulls in conv_id are a conversation of their own; null turns are first and count in no gap; null roles and texts are a
    space; roles with other initials are deleted or replaced like others; a conversation without rows after the
    damage has zeros and an empty audit; other columns are ignored; no rows give none.
    """
    kinds = {f.name: f.dataType.simpleString() for f in conversations.schema}
    rows = written(_with_repeats(written(damaged(conversations), "damaged")), "turns")
    found = written(_segments(rows, kinds["conv_id"], kinds["turn"]), "segments", batch_rows=1000)
    figures = ["blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("long").alias("gaps")
    whole = found.filter("whole").select("conv_id", gaps, *figures)
    segments = found.filter("not whole")
    chosen = written(_chosen(segments), "chosen")
    lines = segments.select("conv_id", "part", "seq", "texts").join(chosen, ["part", "seq"])
    lines = written(_lines(lines), "lines", batch_rows=64)
    hashed = written(_hashed(lines), "hashed", batch_rows=64)
    return whole.unionByName(hashed.select("conv_id", "gaps", *figures))
