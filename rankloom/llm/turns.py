"""Operator 12: repair of the structure of conversations, by cost and then by the least audit.

A conversation's rows stand by turn (nulls first; ties by role, then by a hash of role and text). A repair gives its rows' role
initials the form `(s?(ua)+)?` by edits: Keep (0), Rerole to user or assistant (1), Delete (2; blank and
duplicate rows must go), Insert of an empty user or assistant row (5); a truncated row that stays costs 5 more. A node is a place before a row and a
state of that form; the least cost to the end of all nodes comes from a walk from the last row to the first.
Arcs on which that cost is reached lie on cheapest paths. Their nodes are ranked by the first 1, 2, 4, 8... initials of
their least path: a rank of twice the length is the rank of the pair of a node's rank and that of the node its pointer leads to, and
pointers are doubled with it. A node takes the arc of the least initial and target rank; the path from the start is then read through the doubled pointers.

Rows are dealt by range of conversation and turn, so one conversation may fill many partitions. Only the
first and the last conversation of a partition can go on in another: such fragments, two a partition at most, hand on their cost
matrices (minimum of sums), then the states that their cheapest paths join, and are solved with both ends known. Their texts meet
in one task as a stream in order, as SHA-256 needs, and none of it is held.

Defined results: a null role or text counts as one space, a null conv_id is a conversation of its own; repeated rows are duplicates; other
columns than conv_id, turn, role and text are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankloom.llm.common import reliable

DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
#: States of the form: nothing yet, system alone, after user, after assistant. Where a user or assistant row leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])
FAR = 1 << 40
#: A row's kind: its initial (s, u, a, another), 4 if it must go, 8 if it is truncated. Where it leads from each state if it is kept; -1 if it can't be.
KEPT = np.array([[SYSTEM, -1, -1, -1], [USER, USER, -1, USER], [-1, -1, ASSISTANT, -1], [-1] * 4])
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
#: Rows solved together; bytes of text handed on in one piece.
ROWS, PIECE = 1 << 16, 1 << 20
BLANKS = " \t\n\x0b\x0c\r"


def _ways(kind: np.ndarray, later: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cost of deleting, keeping and reroling rows of these kinds in each state, given the costs after them."""
    more = np.where(kind & 8, TRUNCATED, 0)[:, None] + np.where(kind & 4, FAR, 0)[:, None]
    to = KEPT[kind & 3]
    keep = np.where(to < 0, FAR, np.take_along_axis(later, np.maximum(to, 0), 1)) + more
    return later + DELETE, keep, later[:, NEXT] + REROLE + more


def _inserted(cost: np.ndarray) -> np.ndarray:
    """Costs of the same places where rows may be inserted first."""
    out = cost.copy()
    out[:, USER] = np.minimum(cost[:, USER], INSERT + cost[:, ASSISTANT])
    out[:, ASSISTANT] = np.minimum(cost[:, ASSISTANT], INSERT + cost[:, USER])
    out[:, :2] = np.minimum(cost[:, :2], INSERT + out[:, USER : USER + 1])
    return out


#: Costs after the last row of a conversation.
END = _inserted(np.array([[0, FAR, FAR, 0]]))[0]


def _costs(kind: np.ndarray, at: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Costs to the end before each row and after the last row of each fragment (its given costs); a fragment has a node row more than rows."""
    size, n = np.diff(at), len(at) - 1
    cost = np.empty((len(kind) + n, 4), np.int64)
    ends = at[1:] + np.arange(n)
    cost[ends] = last
    order = np.argsort(-size, kind="stable")
    ends, fragment, waiting = ends[order], order, size[order]
    for back in range(1, int(size.max(initial=0)) + 1):
        live = int(np.searchsorted(-waiting, -back, "right"))
        node = ends[:live] - back
        cost[node] = _inserted(np.minimum.reduce(_ways(kind[node - fragment[:live]], cost[node + 1])))
    return cost


class Paths:
    """The least cheapest path from each node of some fragments. final: which fragments end their conversation."""

    def __init__(self, kind: np.ndarray, at: np.ndarray, last: np.ndarray, final: np.ndarray) -> None:
        self.at, n = at, len(at) - 1
        cost = _costs(kind, at, last)
        nodes, state = len(cost), np.arange(4)
        ends = at[1:] + np.arange(n)
        row = np.ones(nodes, bool)
        row[ends] = False
        self.rows = np.flatnonzero(row)
        arcs = np.full((4, nodes, 4), -1)  # where each initial leads on an optimal arc
        delete, keep, rerole = _ways(kind, cost[self.rows + 1])
        own, after = cost[self.rows], (self.rows + 1)[:, None] * 4
        arcs[0, self.rows] = np.where(own == delete, after + state, -1)
        arcs[2, self.rows] = np.where(own == keep, after + np.maximum(KEPT[kind & 3], 0), -1)
        arcs[3, self.rows] = np.where(own == rerole, after + NEXT, -1)
        may = row.copy()
        may[ends[final]] = True
        arcs[1] = np.where((cost == INSERT + cost[:, NEXT]) & may[:, None], np.arange(nodes)[:, None] * 4 + NEXT, -1)
        self.label, self.pointer = self._ranked(arcs.reshape(4, -1))

    @staticmethod
    def _choose(arcs: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each node's arc of the least initial (0 without arcs) and rank of its target, and where it leads."""
        n = arcs.shape[1]
        weight = np.where(arcs < 0, np.int64(5) * (n + 1), np.arange(1, 5)[:, None] * (n + 1) + rank[arcs])
        best = weight.argmin(0)
        none = (arcs < 0).all(0)
        return np.where(none, 0, best + 1), np.where(none, np.arange(n), arcs[best, np.arange(n)])

    def _ranked(self, arcs: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        # No initial has two optimal arcs from a node, so a prefix is spelt on one path and each doubling is exact.
        label, to = self._choose(arcs, np.zeros(arcs.shape[1], np.int64))
        rank, pointer = label, to
        while (pointer != pointer[pointer]).any():
            _, rank = np.unique(rank * (int(rank.max()) + 1) + rank[pointer], return_inverse=True)
            pointer = pointer[pointer]
        _, rank = np.unique(rank * (int(rank.max(initial=0)) + 1) + rank[pointer], return_inverse=True)
        label, to = self._choose(arcs, rank)
        levels, self.length = [to], (label > 0).astype(np.int64)
        while (levels[-1] != levels[-1][levels[-1]]).any():
            self.length = self.length + self.length[levels[-1]]
            levels.append(levels[-1][levels[-1]])
        self.length = self.length + self.length[levels[-1]]
        return label, levels

    def end(self, node: np.ndarray) -> np.ndarray:
        """Where paths from nodes end."""
        return self.pointer[-1][self.pointer[-1][node]]

    def steps(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes of the paths from each fragment's entry state, and where each fragment's begin (with the end as a last entry)."""
        first = (self.at[:-1] + np.arange(len(self.at) - 1)) * 4 + entry
        at = np.concatenate([[0], np.cumsum(self.length[first])])
        node = np.repeat(first, np.diff(at))
        step = np.arange(at[-1]) - np.repeat(at[:-1], np.diff(at))
        for k, to in enumerate(self.pointer):
            node = np.where(step >> k & 1, to[node], node)
        return node, at


def marked(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """The rows with what the repair needs of them (kind, blank, dup, trunc), dealt by range and in order, numbered by partition. gone: rows that only say that there is such a conversation."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role").alias("role"), text("text").alias("text"), (F.lit(False) if gone is None else gone).alias("gone"))
    rows = rows.withColumns({"h": F.xxhash64("role", "text"), "g": F.xxhash64("text", "role"), "no": F.monotonically_increasing_id()})
    blank = F.rtrim(F.col("text"), F.lit(BLANKS)) == ""
    order = F.struct("turn", "no")
    first = rows.filter(~blank & ~F.col("gone")).groupBy("conv_id", "h", "g").agg(F.min(order).alias("first"), F.count("*").alias("n")).filter("n > 1")
    first = first.select(F.col("conv_id").alias("of"), F.col("h").alias("fh"), F.col("g").alias("fg"), "first")
    rows = rows.join(first, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("fh")) & (F.col("g") == F.col("fg")), "left")
    dup = F.col("first").isNotNull() & ~order.eqNullSafe(F.col("first")) & ~blank
    short = ~F.right(F.rtrim(F.col("text"), F.lit(BLANKS)), F.lit(1)).isin(".", "!", "?")
    initial = F.left("role", F.lit(1))
    rows = rows.withColumns({"blank": blank, "dup": dup, "trunc": ~blank & ~dup & short})
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3) + F.when(F.col("blank") | F.col("dup"), 4).otherwise(0) + F.when(F.col("trunc"), 8).otherwise(0)
    key = ["conv_id", "turn", "role", "h", "no"]
    dealt = rows.withColumn("kind", kind).repartitionByRange(*key).sortWithinPartitions(*key)
    return reliable(dealt.select(F.spark_partition_id().alias("pid"), "conv_id", "turn", "role", "text", "gone", "blank", "dup", "trunc", "kind"))


class Rows:
    """Fragments of a partition, as batches of whole ones: columns, where each begins, and each one's given ends."""

    def __init__(self, batches: Iterator[pa.RecordBatch], columns: list[str]) -> None:
        self.batches, self.columns = batches, columns

    def __iter__(self):
        held: dict[str, list] = {c: [] for c in self.columns}
        starts: list[int] = []
        for batch in self.batches:
            if not batch.num_rows:
                continue
            new = {c: batch.column(c).to_pylist() for c in self.columns}
            conv, before = new["conv_id"], len(held["conv_id"])
            for i, c in enumerate(conv):
                if (before + i == 0) or c != (conv[i - 1] if i else held["conv_id"][-1]):
                    starts.append(before + i)
            for c in self.columns:
                held[c] += new[c]
            if len(held["conv_id"]) >= ROWS and len(starts) > 1:
                cut = starts[-1]
                yield {c: v[:cut] for c, v in held.items()}, np.array(starts)
                held, starts = {c: v[cut:] for c, v in held.items()}, [0]
        if starts:
            yield held, np.array([*starts, len(held["conv_id"])])


def _present(held: dict, at: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """Without the rows that are gone; fragments may be empty then. The third: each fragment's first row as it was."""
    here = ~np.array(held["gone"], bool)
    kept = np.flatnonzero(here).tolist()
    return {c: [v[i] for i in kept] for c, v in held.items()}, np.concatenate([[0], np.cumsum(here)])[at], at[:-1]


def _counts(held: dict, a: int, b: int) -> dict:
    """What a fragment's rows say but for edits; joined() puts such things together."""
    turns = [t for t in held["turn"][a:b] if t is not None]
    initials = [r[:1] for r in held["role"][a:b]]
    wrong = sum(x + y not in ("su", "ua", "au") for x, y in zip(initials, initials[1:], strict=False))
    return {"least": turns[0] if turns else None, "most": turns[-1] if turns else None, "turns": len(set(turns)), "illegal": wrong, "initial": initials[0] if initials else None, "ending": initials[-1] if initials else None} | {k: sum(held[c][a:b]) for k, c in (("blank", "blank"), ("duplicate", "dup"), ("truncated", "trunc"))}


def joined(x: dict, y: dict) -> dict:
    """The counts of two fragments, y after x."""
    out = {k: x[k] + y[k] for k in ("turns", "illegal", "blank", "duplicate", "truncated")}
    out["turns"] -= x["most"] is not None and x["most"] == y["least"]
    out["illegal"] += x["ending"] is not None and y["initial"] is not None and x["ending"] + y["initial"] not in ("su", "ua", "au")
    out |= {k: x[k] if x[k] is not None else y[k] for k in ("least", "initial")}
    return out | {k: y[k] if y[k] is not None else x[k] for k in ("most", "ending")}


def _result(c: dict) -> dict:
    gaps = 0 if c["least"] is None else c["most"] - c["least"] + 1 - c["turns"]
    return {"gaps": gaps} | {k: c[k] for k in ("blank", "duplicate", "truncated", "illegal")}


COUNTS = "least bigint, most bigint, turns bigint, illegal bigint, initial string, ending string, blank bigint, duplicate bigint, truncated bigint"
_COUNTS = pa.struct([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in COUNTS.split(", "))])
RESULT = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_RESULT = pa.schema([(n, pa.string() if t == "string" else pa.int64()) for n, t in (x.split() for x in RESULT.split(", "))])
_SOLVED = pa.schema([*_RESULT, ("pid", pa.int32()), ("part", pa.int32()), ("counts", _COUNTS), ("lines", pa.binary())])
SOLVED = f"{RESULT}, pid int, part int, counts struct<{COUNTS.replace(' ', ':').replace(',:', ',')}>, lines binary"


def _matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each fragment, the least cost from every state before it to every state after it."""
    for held, at in Rows(batches, ["pid", "conv_id", "gone", "kind"]):
        own, to, first = _present(held, at)
        kind = np.array(own["kind"], np.int64)
        by_end = []
        for state in range(4):
            last = np.full((len(at) - 1, 4), FAR)
            last[:, state] = 0
            by_end.append(_costs(kind, to, last)[to[:-1] + np.arange(len(at) - 1)])
        matrix = np.minimum(np.stack(by_end, axis=2), FAR).reshape(len(at) - 1, 16)
        yield pa.RecordBatch.from_pydict({"pid": pa.array([held["pid"][i] for i in first], pa.int32()), "conv_id": pa.array([held["conv_id"][i] for i in first], pa.int64()), "matrix": pa.array(matrix.tolist(), pa.list_(pa.int64()))})


def _last_costs(group: pd.DataFrame) -> pd.DataFrame:
    """The costs after each fragment of one conversation, from the last one to the first."""
    group = group.sort_values("pid", ascending=False)
    cost, out = END, []
    for k, matrix in enumerate(group["matrix"]):
        out.append((cost.tolist(), k == 0))
        cost = np.minimum(FAR, (np.array(list(matrix)).reshape(4, 4) + cost).min(1))
    return group.assign(last=[x for x, _ in out], final=[x for _, x in out])[["pid", "conv_id", "last", "final"]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Where the path from each state before a fragment leaves it."""
    for held, at in Rows(batches, ["pid", "conv_id", "gone", "kind", "last", "final"]):
        own, to, first = _present(held, at)
        last, final = np.array([held["last"][i] for i in first], np.int64), np.array([held["final"][i] for i in first], bool)
        paths = Paths(np.array(own["kind"], np.int64), to, last, final)
        begin = (to[:-1] + np.arange(len(first)))[:, None] * 4 + np.arange(4)
        yield pa.RecordBatch.from_pydict({"pid": pa.array([held["pid"][i] for i in first], pa.int32()), "conv_id": pa.array([held["conv_id"][i] for i in first], pa.int64()), "last": pa.array(last.tolist(), pa.list_(pa.int64())), "final": pa.array(final), "to": pa.array((paths.end(begin.ravel()) % 4).reshape(-1, 4).tolist(), pa.list_(pa.int64()))})


def _entries(group: pd.DataFrame) -> pd.DataFrame:
    """The state before each fragment of one conversation."""
    group = group.sort_values("pid")
    state, out = START, []
    for to in group["to"]:
        out.append(state)
        state = int(to[state])
    return group.assign(entry=out)[["pid", "conv_id", "last", "final", "entry"]]


_ROWS = ["pid", "conv_id", "turn", "role", "text", "gone", "blank", "dup", "trunc", "kind", "last", "final", "entry"]


def _solved(batches: Iterator[pa.RecordBatch]):
    """Of each fragment: its rows' lists, where it begins and ends in them, its first row as it was, whether it is a whole conversation, its cost, and its steps (initial, row or None, role)."""
    names = ("user", "assistant")
    for held, at in Rows(batches, _ROWS):
        own, to, first = _present(held, at)
        whole = [held["entry"][i] is None for i in first]
        last = np.array([END if held["last"][i] is None else held["last"][i] for i in first], np.int64)
        final = np.array([w or held["final"][i] for w, i in zip(whole, first, strict=True)], bool)
        entry = np.array([held["entry"][i] or 0 for i in first], np.int64)
        kind = np.array(own["kind"], np.int64)
        paths = Paths(kind, to, last, final)
        cost = _costs(kind, to, last)[to[:-1] + np.arange(len(first)), entry]
        node, cuts = paths.steps(entry)
        label = paths.label[node]
        role = NEXT[node % 4] - USER
        row = node // 4 - np.repeat(np.arange(len(first)), np.diff(cuts))
        for f, i in enumerate(first):
            a, b = cuts[f], cuts[f + 1]
            steps = [("\0DIKR"[x], None if x == 2 else r, own["role"][r] if x == 3 else names[y]) for x, r, y in zip(label[a:b].tolist(), row[a:b].tolist(), role[a:b].tolist(), strict=True)]
            yield own, int(to[f]), int(to[f + 1]), {c: held[c][i] for c in ("pid", "conv_id")}, whole[f], int(cost[f]), steps


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of whole conversations; of the others, pieces of repaired lines with each fragment's counts and audit at its first."""
    out: list[dict] = []
    size = 0
    for own, a, b, who, whole, cost, steps in _solved(batches):
        lines = [f"{role}:{'' if row is None else own['text'][row]}" for x, row, role in steps if x != "D"]
        audit, counts = "".join(x for x, _, _ in steps), _counts(own, a, b)
        if whole:
            out.append(who | _result(counts) | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()})
            size += 200 + len(audit)
        else:
            pieces, piece, held = [], [], 0
            for line in lines:
                piece.append(line)
                held += len(line)
                if held > PIECE:
                    pieces, piece, held = [*pieces, piece], [], 0
            for k, part in enumerate([*pieces, piece]):
                out.append(who | {"part": k, "lines": "\n".join(part).encode() if part else None} | ({"counts": counts, "cost": cost, "audit": audit} if not k else {}))
                size += sum(map(len, part)) + 200
        if size > PIECE:
            yield pa.RecordBatch.from_pylist(out, _SOLVED)
            out, size = [], 0
    if out:
        yield pa.RecordBatch.from_pylist(out, _SOLVED)


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of conversations from their pieces in order; of the text only the running hash is kept."""
    now = None
    for batch in batches:
        for r in batch.to_pylist():
            if now is None or now["conv_id"] != r["conv_id"]:
                if now is not None:
                    yield _closed(now)
                now = {"conv_id": r["conv_id"], "counts": None, "audit": [], "cost": r["cost"], "hash": hashlib.sha256(), "any": False}
            if r["counts"] is not None:
                now["counts"] = r["counts"] if now["counts"] is None else joined(now["counts"], r["counts"])
                now["audit"].append(r["audit"])
            if r["lines"] is not None:
                now["hash"].update((b"\n" if now["any"] else b"") + r["lines"])
                now["any"] = True
    if now is not None:
        yield _closed(now)


def _closed(now: dict) -> pa.RecordBatch:
    row = {"conv_id": now["conv_id"], "cost": now["cost"], "audit": "".join(now["audit"]), "repaired_sha256": now["hash"].hexdigest()}
    return pa.RecordBatch.from_pylist([row | _result(now["counts"])], _RESULT)


def _with_ends(dealt: DataFrame) -> DataFrame:
    """The dealt rows with last, final and entry where their conversation lies in several partitions."""
    edges = dealt.groupBy("pid").agg(F.min(F.struct("conv_id")).alias("low"), F.max(F.struct("conv_id")).alias("high"))
    edges = edges.select("pid", F.explode(F.array_distinct(F.array("low", "high"))).alias("c")).select("pid", F.col("c.conv_id").alias("conv_id"))
    several = edges.groupBy("conv_id").agg(F.collect_list("pid").alias("pids")).filter(F.size("pids") > 1).select("conv_id", F.explode("pids").alias("pid"))
    # Two rows a partition at most.
    several = reliable(several)

    def of(ends: DataFrame, how: str) -> DataFrame:
        ends = ends.withColumnsRenamed({"pid": "of_pid", "conv_id": "of_conv"})
        both = (F.col("pid") == F.col("of_pid")) & F.col("conv_id").eqNullSafe(F.col("of_conv"))
        return dealt.join(F.broadcast(ends), both, how).drop("of_pid", "of_conv")

    matrices = of(several, "left_semi").select("pid", "conv_id", "gone", "kind").mapInArrow(_matrix, "pid int, conv_id bigint, matrix array<bigint>")
    last = reliable(matrices.groupBy("conv_id").applyInPandas(_last_costs, "pid int, conv_id bigint, last array<bigint>, final boolean"))
    links = of(last, "inner").select("pid", "conv_id", "gone", "kind", "last", "final").mapInArrow(_links, "pid int, conv_id bigint, last array<bigint>, final boolean, to array<bigint>")
    entries = reliable(links.groupBy("conv_id").applyInPandas(_entries, "pid int, conv_id bigint, last array<bigint>, final boolean, entry int"))
    return of(entries, "left").select(*_ROWS)


def repairs(rows: DataFrame, gone: Column | None = None) -> DataFrame:
    """A row a conversation: gaps between its turns, blank, duplicate and truncated rows, illegal neighbours, the least cost, its least audit, and the SHA-256 of the repaired rows (role:text, joined by newlines)."""
    solved = reliable(_with_ends(marked(rows, gone)).mapInArrow(_finish, SOLVED))
    names = [x.split()[0] for x in RESULT.split(", ")]
    pieces = solved.filter(F.col("part").isNotNull()).repartition("conv_id").sortWithinPartitions("conv_id", "pid", "part")
    return solved.filter(F.col("part").isNull()).select(*names).unionByName(pieces.mapInArrow(_stream, RESULT))


def repaired(rows: DataFrame) -> DataFrame:
    """The rows that stay, by conversation: conv_id, part and place (their order), edit (K, R or I), role and text."""
    kinds = {"conv_id": pa.int64(), "part": pa.int32(), "place": pa.int32(), "edit": pa.string(), "role": pa.string(), "text": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, _, _, who, _, _, steps in _solved(batches):
            out = [{"conv_id": who["conv_id"], "part": who["pid"], "place": k, "edit": x, "role": role, "text": "" if row is None else own["text"][row]} for k, (x, row, role) in enumerate(steps) if x != "D"]
            yield pa.RecordBatch.from_pylist(out, pa.schema(kinds))

    return _with_ends(marked(rows)).mapInArrow(run, "conv_id bigint, part int, place int, edit string, role string, text string")


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage; gone says which rows it drops."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    made = F.when(d == 1, "").when(d == 2, F.translate(text("text"), ".!?", "")).otherwise(text("text"))
    rows = rows.select("conv_id", "turn", F.when(d == 4, "user").otherwise(text("role")).alias("role"), made.alias("text"), (d == 0).alias("gone"), F.when(d == 3, 2).otherwise(1).alias("copies"))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies", "copy")


def op12_repaired_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults and cheapest repair of every conversation after the contract's damage."""
    return repairs(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")), F.col("gone"))


QUERIES = {"op12_repaired_conversations": op12_repaired_conversations}
SQL: dict[str, str] = {}
