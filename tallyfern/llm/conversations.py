"""Conversation structure repair (operator 12): damage, faults and the cheapest edits.

The rows of a conversation pass a machine of four states (nothing yet, after a system,
a user, an assistant row).  A row is kept, given another role or deleted, and empty
rows are inserted; the edits' costs give the least cost from each (row, state) node to
the end.  Among the arcs that keep this least cost, the audit (the edits' initials) is
made least by prefix doubling: nodes are ranked by their least audits of one letter,
then of two, four and so on, each rank being that of a pair of earlier ranks, and the
pointers to the node after so many letters are doubled alike.  From a node an audit
letter leads to one node only (a row that changes its role or is inserted can have but
one role there), so a least audit belongs to one path.

Rows are dealt by range of (conversation, turn) and each task streams its sorted part.
A conversation that lies whole inside a part, which nearly all do, is repaired there.
The first and last of a part, and any of over ``OPEN_ROWS`` rows, go on in pieces of at
most ``OPEN_ROWS`` rows: each piece gives a matrix of costs from entry to exit state,
128 bytes; these are combined by conversation, and the pieces, each with its costs
after it and its entry state, are then repaired apart.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyfern.llm.batches import bound_batches
from tallyfern.sources.tables import cut_lineage

OPEN_ROWS = 1 << 16
OPEN_BYTES = 64 << 20
#: Rows of whole conversations that are repaired together.
TOGETHER = 1 << 14

# What the remainders of a row's hash do to it, and the costs of edits.
REMAINDERS = 20
DROPPED, EMPTIED, UNENDED, REPEATED, MADE_USER = range(5)
COST_REROLE, COST_DELETE, COST_INSERT, COST_TRUNCATED = 2, 3, 2, 1
BLANK_OUT = r"[^\x20\x09-\x0D]"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"

# States: nothing yet, after a system, a user, an assistant row; where each role leads.
NONE, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 40
#: The one role a rerole or an insert can have in each state, as the state it leads to.
OTHER = np.array([USER, USER, ASSISTANT, USER])
#: By role initial (none of them, s, u, a) and state: where keeping the row leads, or -1.
KEPT = np.array([[-1, -1, -1, -1], [SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1]])
LETTERS = np.frombuffer(b"DIKR", np.uint8)
DELETE, INSERT, KEEP, REROLE = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
ACCEPT = np.array([0, FAR, FAR, 0], np.int64)


def damaged(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The rows after damage: ``conv``, ``turn``, ``role``, ``text``, ``mark`` (digest of
    role and text) and ``gone`` (a dropped row, kept only to name its conversation).

    Nulls of role and text, and in the hashed ``conv_id:turn``, are one blank.
    """
    key = F.concat_ws(
        ":", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" ")) for c in (conv, turn)]
    )
    fate = F.crc32(key.cast("binary")) % REMAINDERS
    said = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(" "))
    by = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(" "))
    return (
        conversations.select(
            F.col(f"`{conv}`").alias("conv"),
            F.col(f"`{turn}`").alias("turn"),
            F.when(fate == MADE_USER, F.lit("user")).otherwise(by).alias("role"),
            F.when(fate.isin(DROPPED, EMPTIED), F.lit(""))
            .when(fate == UNENDED, F.translate(said, ".!?", ""))
            .otherwise(said)
            .alias("text"),
            (fate == DROPPED).alias("gone"),
            F.when(fate == REPEATED, F.sequence(F.lit(0), F.lit(1)))
            .otherwise(F.array(F.lit(0)))
            .alias("copies"),
        )
        .withColumn("mark", F.unhex(F.md5(F.concat_ws(":", F.length("role"), "role", "text"))))
        .select("conv", "turn", "role", "text", "mark", "gone", F.explode("copies").alias("copy"))
        .drop("copy")
    )


def _facts(rows: DataFrame) -> DataFrame:
    """Each row's role initial and faults as one number: initial + 4 blank + 8 truncated."""
    initial = F.substring("role", 1, 1)
    code = F.when(initial == "s", 1).when(initial == "u", 2).when(initial == "a", 3).otherwise(0)
    blank = ~F.col("text").rlike(BLANK_OUT)
    truncated = ~F.col("text").rlike(ENDED)
    return rows.withColumn(
        "code", (code + F.when(blank, 4).otherwise(0) + F.when(truncated, 8).otherwise(0)).cast("int")
    )


class _Nodes:
    """The (row, state) nodes of several runs of rows, with costs, arcs and audits.

    ``lengths`` are the runs' rows, ``code`` initials and faults of all rows, ``doomed``
    the rows that must go, ``after`` the costs of the four states after each run.  A run
    has a layer of four nodes before each row and one after the last.
    """

    def __init__(self, lengths: np.ndarray, code: np.ndarray, doomed: np.ndarray, after: np.ndarray, closed: bool):
        self.lengths = lengths
        self.starts = np.cumsum(lengths + 1) - (lengths + 1)  # first layer of each run
        self.rows = np.cumsum(lengths) - lengths  # first row of each run
        self.initial, self.late = code & 3, ((code >> 3) & 1) * COST_TRUNCATED
        self.doomed, self.closed = doomed, closed
        self.cost = self._costs(after)

    def _stepped(self, behind: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Costs before each of the rows from the costs behind it, without inserts."""
        best = behind + COST_DELETE
        free = ~self.doomed[row]
        late = self.late[row]
        reroled = behind[:, OTHER] + (COST_REROLE + late)[:, None]
        to = KEPT[self.initial[row]]
        kept = np.where(to >= 0, np.take_along_axis(behind, np.maximum(to, 0), 1), FAR) + late[:, None]
        return np.where(free[:, None], np.minimum(best, np.minimum(reroled, kept)), best)

    @staticmethod
    def _inserted(cost: np.ndarray) -> np.ndarray:
        """Costs with inserts before: two in a row reach every state that is reached at all."""
        once = np.minimum(cost, cost[:, OTHER] + COST_INSERT)
        return np.minimum(once, once[:, OTHER] + COST_INSERT)

    def _costs(self, after: np.ndarray) -> np.ndarray:
        cost = np.zeros((int((self.lengths + 1).sum()), 4), np.int64)
        ends = self.starts + self.lengths
        # An open run leaves the inserts behind its last row to the run after it.
        cost[ends] = self._inserted(after) if self.closed else after
        order = np.argsort(-self.lengths, kind="stable")
        sizes = -self.lengths[order]
        for back in range(1, int(self.lengths.max(initial=0)) + 1):
            live = order[: np.searchsorted(sizes, -back, side="right")]
            layer = ends[live] - back
            row = self.rows[live] + self.lengths[live] - back
            cost[layer] = self._inserted(self._stepped(cost[layer + 1], row))
        return np.minimum(cost, FAR)

    def arcs(self) -> np.ndarray:
        """By node and letter: the node that an optimal arc leads to, or -1."""
        layers, flat = len(self.cost), self.cost.ravel()
        ends = np.zeros(layers, bool)
        ends[self.starts + self.lengths] = True
        inner = np.nonzero(~ends)[0]
        to = np.full((layers, 4, 4), -1)

        def offer(kind: int, at: np.ndarray, target: np.ndarray, cost, allowed) -> None:
            fits = allowed & (flat[target] + cost == self.cost[at]) & (self.cost[at] < FAR)
            to[at, :, kind] = np.where(fits, target, -1)

        below = (inner[:, None] + 1) * 4
        free = ~self.doomed[:, None]
        late = self.late[:, None]
        kept = KEPT[self.initial]
        every = np.arange(layers) if self.closed else inner
        offer(DELETE, inner, below + np.arange(4)[None, :], COST_DELETE, True)
        offer(INSERT, every, every[:, None] * 4 + OTHER[None, :], COST_INSERT, True)
        offer(KEEP, inner, below + np.maximum(kept, 0), late, free & (kept >= 0))
        offer(REROLE, inner, below + OTHER[None, :], COST_REROLE + late, free)
        return to.reshape(-1, 4)

    def paths(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The least paths from each run's ``entry`` state: their nodes run after run, their
        letters (-1 at the end of a path), and the number of nodes of each run."""
        arcs = self.arcs()
        n, own = len(arcs), np.arange(len(arcs))

        def least(rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Each node's letter and next node: the least letter, then the least rank there."""
            worth = np.where(arcs >= 0, np.arange(4)[None, :] * (n + 1) + rank[arcs], 4 * (n + 1))
            letter = worth.argmin(1)
            ended = arcs.max(1) < 0
            return np.where(ended, -1, letter), np.where(ended, own, arcs[own, letter])

        letter, to = least(np.zeros(n, np.int64))
        rank, pointers = letter + 1, [to]
        longest = 3 * int(self.lengths.max(initial=0)) + 4  # a row's letter and two inserts before it
        while 1 << (len(pointers) - 1) < longest:
            # Audits twice as long: the rank of a pair of ranks.
            pair = rank * (int(rank.max(initial=0)) + 1) + rank[pointers[-1]]
            rank = np.unique(pair, return_inverse=True)[1]
            pointers.append(pointers[-1][pointers[-1]])
        letter, pointers[0] = least(rank)
        nodes = (self.starts * 4 + entry)[:, None]
        for step in reversed(pointers):
            # Nodes at multiples of 2^(k+1) letters become those at multiples of 2^k.
            nodes = np.stack([nodes, step[nodes]], 2).reshape(len(nodes), -1)
        fresh = np.ones(nodes.shape, bool)
        fresh[:, 1:] = nodes[:, 1:] != nodes[:, :-1]
        return nodes[fresh], letter[nodes[fresh]], fresh.sum(1)


def _matrix(length: int, code: np.ndarray, doomed: np.ndarray) -> np.ndarray:
    """Least costs from each entry state of an open run to each exit state."""
    lengths = np.full(4, length)
    after = np.where(np.eye(4, dtype=bool), 0, FAR).astype(np.int64)
    run = _Nodes(lengths, np.tile(code, 4), np.tile(doomed, 4), after, closed=False)
    return run.cost[run.starts].T.copy()


def _script(
    run: _Nodes, entry: np.ndarray, roles: list[str], texts: list[str]
) -> tuple[list[bytes], list[list[str]], np.ndarray]:
    """Of each run: the audit, the repaired rows as ``role:text``, the exit state."""
    nodes, letters, sizes = run.paths(entry)
    row_of = np.zeros(len(run.cost), np.int64)
    inner = np.ones(len(run.cost), bool)
    inner[run.starts + run.lengths] = False
    row_of[inner] = np.arange(int(run.lengths.sum()))
    rows = row_of[nodes >> 2].tolist()
    states, kinds = (nodes & 3).tolist(), letters.tolist()
    audits, repaired, exits, at = [], [], [], 0
    for size in sizes.tolist():
        said = []
        for i in range(at, at + size - 1):
            kind = kinds[i]
            if kind == KEEP:
                said.append(f"{roles[rows[i]]}:{texts[rows[i]]}")
            elif kind == REROLE:
                said.append(f"{ROLES[states[i + 1]]}:{texts[rows[i]]}")
            elif kind == INSERT:
                said.append(f"{ROLES[states[i + 1]]}:")
        audits.append(LETTERS[letters[at : at + size - 1]].tobytes())
        repaired.append(said)
        exits.append(states[at + size - 1])
        at += size
    return audits, repaired, np.array(exits)


def _broken(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Whether initials may not follow each other: neither su, ua nor au."""
    return ~(((second == 2) & ((first == 1) | (first == 3))) | ((first == 2) & (second == 3)))


def _first_seen(marks: list[bytes]) -> np.ndarray:
    seen: set[bytes] = set()
    return np.array([not (m in seen or seen.add(m)) for m in marks], bool)


def _span(turns: list) -> tuple[int | None, int | None, int]:
    known = [t for t in turns if t is not None]
    return (known[0], known[-1], len(set(known))) if known else (None, None, 0)


def _whole(spans: list[tuple]) -> int:
    """Turns missing between the first and last."""
    known = [s for s in spans if s[0] is not None]
    if not known:
        return 0
    distinct = sum(s[2] for s in known) - sum(a[1] == b[0] for a, b in zip(known, known[1:]))
    return min(known[-1][1] - known[0][0] + 1 - distinct, (1 << 63) - 1)


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
OPEN = "piece long, part int, row int, turn string, role string, text string, mark binary, code int"


def _fields(text: str) -> list[T.StructField]:
    """``name type`` pairs parted by commas."""
    kinds = {"long": T.LongType(), "int": T.IntegerType(), "string": T.StringType(), "binary": T.BinaryType(),
             "longs": T.ArrayType(T.LongType()), "ints": T.ArrayType(T.IntegerType())}
    return [T.StructField(n, kinds[k]) for n, k in (x.split() for x in text.split(","))]


class _Part:
    """One task's sorted rows: whole conversations are repaired, the others passed on."""

    def __init__(self, number: int):
        self.number = number
        self.done: list[tuple] = []
        self.waiting: list[tuple] = []  # whole conversations not yet repaired
        self.waiting_rows = 0

    def repair(self) -> None:
        """Repair what waits, runs of like length together."""
        alike: dict[int, list] = {}
        for r in self.waiting:
            alike.setdefault(len(r[1]).bit_length(), []).append(r)
        self.waiting, self.waiting_rows = [], 0
        for runs in alike.values():
            self._repair(runs)

    def _repair(self, runs: list[tuple]) -> None:
        lengths = np.array([len(r[1]) for r in runs], np.int64)
        rows = [x for r in runs for x in r[1]]
        code = np.array([x[4] for x in rows], np.int64)
        fresh = np.concatenate([_first_seen([x[3] for x in r[1]]) for r in runs]).astype(bool)
        blank = (code & 4) > 0
        run = _Nodes(lengths, code, blank | ~fresh, np.tile(ACCEPT, (len(runs), 1)), closed=True)
        costs = run.cost[run.starts, NONE].tolist()
        audits, repaired, _ = _script(
            run, np.zeros(len(runs), np.int64), [x[1] for x in rows], [x[2] for x in rows]
        )
        broken = np.zeros(len(rows) + 1, np.int64)
        if len(rows) > 1:
            broken[1:-1] = _broken(code[:-1] & 3, code[1:] & 3)
        at = 0
        for i, (conv, own) in enumerate(runs):
            here = slice(at, at + len(own))
            b, d, t = blank[here], ~fresh[here], (code[here] & 8) > 0
            self.done.append(
                (conv, _whole([_span([x[0] for x in own])]), int(b.sum()), int((d & ~b).sum()),
                 int((t & ~b & ~d).sum()), int(broken[at + 1 : at + len(own)].sum()), costs[i],
                 audits[i].decode(), hashlib.sha256("\n".join(repaired[i]).encode()).hexdigest())
            )
            at += len(own)


def repair(
    conversations: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    open_rows: int = OPEN_ROWS,
) -> DataFrame:
    """One row per conversation of the table after damage: ``conv``, ``gaps``, ``blank``,
    ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256``.

    Rows are taken by turn, nulls first, then by role and by the digest of role and
    text; repeated rows follow each other and all but the first are duplicates.  A null
    conversation id is a conversation of its own; a null or empty role has no legal
    initial; a very long text is one row as any other; extra columns are ignored; a conversation without
    rows after damage has zeros, no audit and the digest of nothing; an empty table gives
    none.  Gaps above the largest long are that long.
    """
    spark = conversations.sparkSession
    bound_batches(spark)
    rows = _facts(damaged(conversations, conv, turn, role, text))
    key, when = conversations.schema[conv].dataType, conversations.schema[turn].dataType
    if not isinstance(when, T.IntegralType):
        raise ValueError("turns are whole numbers")
    order = ["conv", "turn", "role", "mark"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.select("conv", "turn", "role", "text", "mark", "code", "gone")
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    schema = T.StructType(
        [T.StructField("conv", key), T.StructField("whole", T.BooleanType())]
        + _fields(f"{RESULT}, {OPEN}")
    )
    streamed = cut_lineage(dealt.mapInArrow(_stream(schema, open_rows), schema))
    names = [f.name for f in _fields(RESULT)]
    finished = streamed.where("whole").select("conv", *names)
    opened = streamed.where("NOT whole").select("conv", *schema.names[2 + len(names) :])
    made = finished.unionByName(_repair_open(opened, key)).withColumnRenamed("conv", conv)
    return made


def _stream(schema: T.StructType, open_rows: int):
    """The map over one task's sorted rows; see the module's text."""
    arrow = to_arrow_schema(schema)
    n_result = len(_fields(RESULT))
    blank_result = [None] * n_result

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = _Part(TaskContext.get().partitionId())
        started, current, held, size = False, None, [], 0
        opening, first = True, True  # the first conversation of a part is open
        n_open = part_no = part_rows = part_bytes = 0
        out: list[tuple] = []

        def pass_on() -> None:
            nonlocal n_open, part_no, part_rows, part_bytes, held, size
            for x in held:
                if part_rows >= open_rows or part_bytes >= OPEN_BYTES:
                    part_no, part_rows, part_bytes = part_no + 1, 0, 0
                turn = None if x[0] is None else str(x[0])
                out.append((current, False, *blank_result, part.number, part_no, n_open, turn, *x[1:]))
                n_open, part_rows, part_bytes = n_open + 1, part_rows + 1, part_bytes + len(x[2])
            if not n_open:  # nothing but dropped rows: the conversation's name must go on
                out.append((current, False, *blank_result, part.number, 0, 0, None, "", "", b"", -1))
                n_open = 1
            held, size = [], 0

        def table(data: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*data))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, arrow)], names=arrow.names
            )

        def emit(force: bool = False) -> Iterator[pa.RecordBatch]:
            if force or part.waiting_rows >= TOGETHER:
                part.repair()
            if part.done and (force or len(part.done) >= 1024):
                rest = [None] * (len(arrow) - 2 - n_result)
                yield table([(x[0], True, *x[1:], *rest) for x in part.done])
                part.done = []
            if out and (force or len(out) >= 1024):
                yield table(out)
                out.clear()

        for batch in batches:
            for c, turn, role, text, mark, code, gone in zip(*[x.to_pylist() for x in batch.columns]):
                if not started or c != current:
                    if started:
                        if opening:
                            pass_on()
                        else:
                            part.waiting.append((current, held))
                            part.waiting_rows += len(held) + 1
                            held, size = [], 0
                        first = False
                    started, current, opening = True, c, first
                    n_open = part_no = part_rows = part_bytes = 0
                if not gone:
                    held.append((turn, role, text, mark, code))
                    size += len(text)
                    if opening or len(held) >= open_rows or size >= OPEN_BYTES:
                        opening = True
                        pass_on()
            yield from emit()
        if started:
            pass_on()  # the last may go on in the next part
        yield from emit(force=True)

    return run


def _chunk(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Codes and whether a row must go, of one piece's rows in order (placeholders left out)."""
    code = frame["code"].to_numpy(np.int64)
    return code, ((code & 4) > 0) | ~frame["fresh"].to_numpy(bool)


def _repair_open(rows: DataFrame, key: T.DataType) -> DataFrame:
    """Conversations in pieces: costs combined by conversation, pieces repaired apart."""
    place = F.struct("piece", "row")
    firsts = (
        rows.where("code >= 0").groupBy("conv", "mark").agg(F.min(place).alias("place"))
        .select(F.col("conv").alias("_conv"), "place.piece", "place.row", F.lit(True).alias("fresh"))
    )
    same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("o.piece") == F.col("f.piece")) & (F.col("o.row") == F.col("f.row"))
    marked = cut_lineage(
        rows.drop("mark").alias("o").join(firsts.alias("f"), same, "left")
        .select("conv", "o.piece", "part", "o.row", "turn", "role", "text", "code",
                F.coalesce("fresh", F.lit(False)).alias("fresh"))
    )
    conv = T.StructField("conv", key)
    piece = [conv, T.StructField("piece", T.LongType()), T.StructField("part", T.IntegerType())]
    by = ["conv", "piece", "part"]

    summary = T.StructType(
        piece
        + _fields(
            "n long, blank long, duplicate long, truncated long, illegal long, first int, last int, "
            "low string, high string, distinct long, costs longs"
        )
    )

    def head(frame: pd.DataFrame) -> list:
        at = frame.iloc[0]
        return [None if pd.isna(at["conv"]) else at["conv"], at["piece"], at["part"]]

    def measured(frame: pd.DataFrame) -> pd.DataFrame:
        top = head(frame)
        frame = frame[frame["code"] >= 0].sort_values("row")
        code, doomed = _chunk(frame)
        blank, late = (code & 4) > 0, (code & 8) > 0
        repeat = doomed & ~blank
        low, high, distinct = _span([None if t is None else int(t) for t in frame["turn"]])
        broken = int(_broken(code[:-1] & 3, code[1:] & 3).sum())
        ends = [int(code[0] & 3), int(code[-1] & 3)] if len(code) else [-1, -1]
        costs = _matrix(len(code), code, doomed).ravel().tolist()
        row = [*top, len(code), int(blank.sum()), int(repeat.sum()), int((late & ~doomed).sum()), broken, *ends,
               low if low is None else str(low), high if high is None else str(high), distinct, costs]
        return pd.DataFrame([row], columns=summary.names, dtype=object)

    measures = cut_lineage(
        marked.select(*by, "row", "turn", "code", "fresh").groupBy(*by).applyInPandas(measured, summary)
    )

    known = T.StructType(piece + _fields("entry int, after longs"))

    def combined(frame: pd.DataFrame) -> pd.DataFrame:
        """Costs after each piece, from the last back; then entry states, from the first on."""
        frame = frame.sort_values(["piece", "part"])
        mats = [np.array(m, np.int64).reshape(4, 4) for m in frame["costs"]]
        after = [_Nodes._inserted(ACCEPT[None, :])[0]]
        for m in reversed(mats[1:]):
            after.append(np.minimum((m + after[-1][None, :]).min(1), FAR))
        after.reverse()
        rows = [[*r[:3], None, a.tolist()] for r, a in zip(frame[by].itertuples(index=False), after)]
        return pd.DataFrame(rows, columns=known.names, dtype=object)

    behind = cut_lineage(
        measures.select(*by, "costs").groupBy("conv").applyInPandas(combined, known).drop("entry")
    )

    def with_pieces(left: DataFrame, right: DataFrame) -> DataFrame:
        """Rows with the facts of their piece; the pieces are a row for 65,536 or for a task."""
        names = [c for c in right.columns if c not in by]
        other = right.select(*[F.col(c).alias(f"_{c}") for c in by], *names)
        same = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("piece") == F.col("_piece")) & (F.col("part") == F.col("_part"))
        return left.join(other, same).drop(*[f"_{c}" for c in by])

    ways = T.StructType(piece + _fields("exits ints"))

    def run_of(frame: pd.DataFrame, copies: int) -> _Nodes:
        code, doomed = _chunk(frame)
        after = np.tile(np.array(frame.attrs["after"], np.int64), (copies, 1))
        return _Nodes(np.full(copies, len(code)), np.tile(code, copies), np.tile(doomed, copies), after, closed=False)

    def exits(frame: pd.DataFrame) -> pd.DataFrame:
        top, after = head(frame), frame.iloc[0]["after"]
        frame = frame[frame["code"] >= 0].sort_values("row")
        frame.attrs["after"] = after
        run = run_of(frame, 4)
        nodes, _, sizes = run.paths(np.arange(4))
        out = (nodes[np.cumsum(sizes) - 1] & 3).tolist()
        return pd.DataFrame([[*top, out]], columns=ways.names, dtype=object)

    narrow = with_pieces(marked.select(*by, "row", "code", "fresh"), behind)
    leads = cut_lineage(narrow.groupBy(*by).applyInPandas(exits, ways))

    entered = T.StructType(piece + _fields("entry int"))

    def chained(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["piece", "part"])
        rows, state = [], NONE
        for r, out in zip(frame[by].itertuples(index=False), frame["exits"]):
            rows.append([*r, state])
            state = int(out[state])
        return pd.DataFrame(rows, columns=entered.names, dtype=object)

    entries = leads.groupBy("conv").applyInPandas(chained, entered)
    given = cut_lineage(with_pieces(behind, entries))

    told = T.StructType(piece + _fields("audit string, rows long, repaired string"))

    def scripted(frame: pd.DataFrame) -> pd.DataFrame:
        top, at = head(frame), frame.iloc[0]
        frame = frame[frame["code"] >= 0].sort_values("row")
        frame.attrs["after"] = at["after"]
        run = run_of(frame, 1)
        entry = np.array([int(at["entry"])])
        audits, repaired, _ = _script(run, entry, frame["role"].tolist(), frame["text"].tolist())
        row = [*top, audits[0].decode(), len(repaired[0]), "\n".join(repaired[0])]
        return pd.DataFrame([row], columns=told.names, dtype=object)

    scripts = cut_lineage(
        with_pieces(marked.select(*by, "row", "role", "text", "code", "fresh"), given)
        .groupBy(*by)
        .applyInPandas(scripted, told)
    )
    total = T.StructType([conv, *_fields("gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, rows long, repaired string")])

    def totals(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["piece", "part"])
        own = frame[frame["n"] > 0]
        spans = [
            (None, None, 0) if a is None else (int(a), int(b), int(d))
            for a, b, d in zip(own["low"], own["high"], own["distinct"])
        ]
        met = _broken(own["last"].to_numpy(int)[:-1], own["first"].to_numpy(int)[1:]).sum()
        cost, state = np.array([0, FAR, FAR, FAR], np.int64), NONE
        for m, out in zip(frame["costs"], frame["exits"]):
            cost = np.minimum((cost[:, None] + np.array(m, np.int64).reshape(4, 4)).min(0), FAR)
            state = int(out[state])
        end = _Nodes(np.array([0]), np.zeros(0, np.int64), np.zeros(0, bool), ACCEPT[None, :], closed=True)
        audits, repaired, _ = _script(end, np.array([state]), [], [])
        least = int((cost + end.cost[0]).min())
        value = frame.iloc[0]["conv"]
        row = [None if pd.isna(value) else value, _whole(spans), *[int(own[c].sum()) for c in ("blank", "duplicate", "truncated")],
               int(own["illegal"].sum() + met), least, audits[0].decode(), len(repaired[0]), "\n".join(repaired[0])]
        return pd.DataFrame([row], columns=total.names, dtype=object)

    summed = with_pieces(measures, leads).groupBy("conv").applyInPandas(totals, total)
    ends = summed.select("conv", "audit", "rows", "repaired")
    last = ends.withColumn("piece", F.lit((1 << 63) - 1)).withColumn("part", F.lit(0))
    spoken = scripts.unionByName(last)
    digests = _digests(spoken.select("conv", "piece", "part", "rows", "repaired"), key)
    audits = spoken.groupBy("conv").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("piece", "part", "audit"))), lambda x: x["audit"]), ""
        ).alias("audit")
    )
    result = summed.drop("audit", "rows", "repaired")
    for more in (audits, digests):
        other = more.withColumnRenamed("conv", "_conv")
        result = result.join(other, F.col("conv").eqNullSafe(F.col("_conv"))).drop("_conv")
    return result


def _digests(spoken: DataFrame, key: T.DataType) -> DataFrame:
    """The digest of each conversation's repaired rows, piece after piece in one stream:
    a digest is sequential, but no more than a batch of pieces is in memory."""
    schema = T.StructType([T.StructField("conv", key), T.StructField("repaired_sha256", T.StringType())])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest, any_rows = None, None, False
        done: list[tuple] = []
        for batch in batches:
            for conv, rows, repaired in zip(*[c.to_pylist() for c in batch.columns]):
                if digest is None or conv != current:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest, any_rows = conv, hashlib.sha256(), False
                if rows:
                    digest.update((b"\n" if any_rows else b"") + repaired.encode())
                    any_rows = True
        if digest is not None:
            done.append((current, digest.hexdigest()))
        if done:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*done), arrow)], names=arrow.names
            )

    ordered = spoken.repartition("conv").sortWithinPartitions("conv", "piece", "part")
    return ordered.select("conv", "rows", "repaired").mapInArrow(run, schema)
