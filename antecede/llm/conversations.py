"""Repair of conversation structure: cheapest edits by block tables (Four Russians), traced back without ties."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from antecede.llm.store import stored

BLANKS = " \t\n\x0b\f\r"

#: States of the answer ``(s?(ua)+)?``: nothing yet, after s, after u, after a. States 0 and 3 may end.
STATES = 4
ENDS = (0, 6, 3, 0)
#: The state after a user or assistant turn, the only one that may follow each state.
NEXT = (2, 2, 3, 2)
REROLE, DELETE, INSERT, CUT = 3, 4, 3, 3
BIG = 1 << 40

#: A symbol is twice the role's place here, plus one if the row is truncated; MUST is a row that has to go.
ROLES = "sua?"
MUST = 8
SYMBOLS = 9
#: Symbols of one block; the tables hold 9 ** BLOCK rows.
BLOCK = 3
#: Rows of one chunk; a conversation of any length is solved chunk by chunk.
CHUNK_BITS = 12


def _keep(state: int, role: int) -> int | None:
    """The state after keeping a row of a role, if it may stand there."""
    if role == 0:
        return 1 if state == 0 else None
    return NEXT[state] if ROLES[role] == ("a" if state == 2 else "u") else None


def step(after: tuple[int, ...], symbol: int) -> tuple[int, ...]:
    """Cheapest costs before a row, by state, from those after it; inserts may stand before the row."""
    costs = [DELETE + after[q] for q in range(STATES)]
    if symbol != MUST:
        role, cut = divmod(symbol, 2)
        for q in range(STATES):
            kept = _keep(q, role)
            best = REROLE + after[NEXT[q]] if kept is None else min(after[kept], REROLE + after[NEXT[q]])
            costs[q] = min(costs[q], CUT * cut + best)
    c2, c3 = min(costs[2], INSERT + costs[3]), min(costs[3], INSERT + costs[2])
    return tuple(min(BIG, c) for c in (min(costs[0], INSERT + c2), min(costs[1], INSERT + c2), c2, c3))


def _normal(vector: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    least = min(vector)
    return tuple(BIG if v >= BIG else v - least for v in vector), least


class Tables:
    """Normalised cost vectors that rows can lead to, and what every block of BLOCK symbols makes of each: another vector and an offset.

    The first vector is that after the last row; the next ones hold one state each and give a chunk's costs from state to state.
    """

    def __init__(self) -> None:
        starts = [ENDS] + [tuple(0 if q == j else BIG for q in range(STATES)) for j in range(STATES)]
        self.vectors = list(starts)
        self.number = {v: k for k, v in enumerate(self.vectors)}
        rows: list[list[tuple[int, int]]] = []
        for vector in self.vectors:  # grows until no symbol makes a new one
            row = []
            for symbol in range(SYMBOLS):
                new, offset = _normal(step(vector, symbol))
                if new not in self.number:
                    self.number[new] = len(self.vectors)
                    self.vectors.append(new)
                row.append((self.number[new], offset))
            rows.append(row)
        single = np.array(rows, np.int64).transpose(2, 1, 0)  # (vector or offset, symbol, vector before)
        to, cost = single[0], single[1]
        self.to, self.cost = [to], [cost]
        self.expanded: dict[tuple[int, int, int, int], tuple[tuple[str, ...], int]] = {}  # at most blocks x vectors x states
        for _ in range(BLOCK - 1):
            inner, spent = self.to[-1], self.cost[-1]  # the later symbols of the block are processed first
            self.to.append(to[:, inner].reshape(-1, to.shape[1]))
            self.cost.append((cost[:, inner] + spent).reshape(-1, to.shape[1]))

    def blocks(self, symbols: np.ndarray) -> list[tuple[int, int]]:
        """(size, code) of the blocks of a row of symbols; what does not fill a block comes first, one by one."""
        odd = len(symbols) % BLOCK
        full = symbols[odd:].reshape(-1, BLOCK) @ (SYMBOLS ** np.arange(BLOCK - 1, -1, -1))
        return [(1, int(s)) for s in symbols[:odd]] + [(BLOCK, int(c)) for c in full]

    def backward(self, blocks: list[tuple[int, int]], vector: int) -> tuple[list[int], int]:
        """(vector after each block, with the one before the first in front; offset of the latter), by look-up."""
        seen, cost = [vector], 0
        for size, code in reversed(blocks):
            cost += int(self.cost[size - 1][code, vector])
            vector = int(self.to[size - 1][code, vector])
            seen.append(vector)
        return seen[::-1], cost

    def expand(self, size: int, code: int, after: int, state: int) -> tuple[tuple[str, ...], int]:
        """(plan of each row, state after) of one block: its costs are computed backward again, the least edits taken forward.

        A plan holds u and a for inserted turns, then D, K, or U and A for a new role. At every place the edit of least initial
        that keeps to the cheapest cost is taken (D, I, K, R), so the edits' initials are the least among all cheapest ones.
        """
        symbols = [code // SYMBOLS ** k % SYMBOLS for k in range(size - 1, -1, -1)]
        costs = [self.vectors[after]]
        for symbol in reversed(symbols):
            costs.append(step(costs[-1], symbol))
        costs.reverse()
        plans = []
        for symbol, now, then in zip(symbols, costs, costs[1:]):
            plan, role, cut = "", symbol // 2, CUT * (symbol % 2)
            while True:
                if DELETE + then[state] == now[state]:
                    plan += "D"
                    break
                if INSERT + now[NEXT[state]] == now[state]:
                    plan += "a" if state == 2 else "u"
                    state = NEXT[state]
                    continue
                kept = _keep(state, role)
                if kept is not None and cut + then[kept] == now[state]:
                    plan += "K"
                    state = kept
                else:
                    plan += "A" if state == 2 else "U"
                    state = NEXT[state]
                break
            plans.append(plan)
        return tuple(plans), state

    def forward(self, blocks: list[tuple[int, int]], vectors: list[int], state: int) -> tuple[list[str], int]:
        plans: list[str] = []
        for (size, code), after in zip(blocks, vectors[1:]):
            key = (size, code, after, state)
            if key not in self.expanded:
                self.expanded[key] = self.expand(*key)
            part, state = self.expanded[key]
            plans += part
        return plans, state


def ending(state: int) -> str:
    """Turns to insert after the last row."""
    return {0: "", 1: "ua", 2: "a", 3: ""}[state]


def initials(plan: str) -> str:
    return plan.translate(str.maketrans("uaUA", "IIRR"))


# --- rows ------------------------------------------------------------------------------------------

KEY = ["conv", "turn", "role", "h1", "h2"]


def faults(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, h1, h2, copies, symbol, blank, truncated, repeats): one row for all rows that are equal, with the text's 128-bit hash.

    ``repeats`` counts the rows of it that repeat an earlier role and text; blank rows are no repeats.
    """
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    narrow = rows.select("conv", "turn", "role", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"),
                         (F.length(bare) == 0).alias("blank"), (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("cut"))
    equal = narrow.groupBy(*KEY).agg(F.count(F.lit(1)).alias("copies"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    turn = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))
    text = ["conv", "role", "h1", "h2"]
    again = equal.groupBy(*text).agg(F.min(turn).alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    again = again.select(*[F.col(c).alias(f"_{c}") for c in text], "first")
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in text]
    marked = equal.join(again, on, "left").withColumn("later", F.col("first").isNotNull() & (F.col("first.turn").eqNullSafe(F.col("turn")) == F.lit(False)))
    repeats = F.when(F.col("blank"), 0).otherwise(F.col("copies") - F.when(F.col("later"), 0).otherwise(1))
    place = F.when(F.col("role").startswith("s"), 0).when(F.col("role").startswith("u"), 1).when(F.col("role").startswith("a"), 2).otherwise(3)
    truncated = ~F.col("blank") & ~F.col("later") & F.col("cut")
    symbol = F.when(F.col("blank") | F.col("later"), MUST).otherwise(2 * place + truncated.cast("int"))
    return marked.select(*KEY, "copies", symbol.cast("int").alias("symbol"), place.alias("place"), F.when(F.col("blank"), F.col("copies")).otherwise(0).alias("blank"),
                         truncated.cast("long").alias("truncated"), repeats.cast("long").alias("repeats"))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows of :func:`faults` with ``pos``, ascending by conversation and turn. One conversation may lie in many partitions."""
    spread = rows.repartitionByRange(*KEY).sortWithinPartitions(*KEY)
    return stored(spread.withColumn("pos", F.monotonically_increasing_id()), "turns")


# --- chunks ----------------------------------------------------------------------------------------

PIECE = ("chunk bigint, first bigint, open boolean, cost bigint, costs array<bigint>, ranks array<int>, low bigint, high bigint, turns bigint, "
         "from_turn bigint, to_turn bigint, from_place int, to_place int, blank bigint, truncated bigint, repeats bigint, illegal bigint")
FOLDED = "chunk bigint, first bigint, vector array<bigint>, state int, last boolean"
PLANS = "turn bigint, role string, h1 bigint, h2 bigint, plan string"
SUMMARY = "gaps bigint, blank bigint, repeats bigint, truncated bigint, illegal bigint, cost bigint"
LEGAL = {(0, 1), (1, 2), (2, 1)}


def _pieces(chunk: pa.Table) -> Iterator[tuple[int, int]]:
    """Row ranges of the conversations in a chunk sorted by pos."""
    ids = chunk.column("conv").combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
    yield from zip(cuts, cuts[1:])


def _costs(t: Tables, blocks: list[tuple[int, int]], spare: int) -> tuple[list[int], list[int]]:
    """A chunk's least costs from state to state, without inserts after its last row, and the order of the edits' initials per first state.

    No list of initials here begins another, as each ends with an edit of the last row; so their order holds whatever follows.
    """
    costs, ranks = [], []
    back = [t.backward(blocks, 1 + j) for j in range(STATES)]
    for q in range(STATES):
        lists = []
        for j, (vectors, offset) in enumerate(back):
            cost = t.vectors[vectors[0]][q]
            costs.append(BIG if cost >= BIG else cost + offset + spare)
            lists.append((initials("".join(t.forward(blocks, vectors, q)[0])) if cost < BIG else "~", j))
        order = {j: k for k, (_, j) in enumerate(sorted(lists))}
        ranks += [order[j] for j in range(STATES)]
    return costs, ranks


def _solve(t: Tables, chunk: pa.Table) -> pa.Table:
    """One row per conversation of the chunk; the first and the last may go on in other chunks and are open."""
    chunk = chunk.sort_by("pos")
    ranges = list(_pieces(chunk))
    column = {c: chunk.column(c).to_numpy() for c in ("pos", "symbol", "place", "copies", "blank", "truncated", "repeats")}
    turns = chunk.column("turn").to_pylist()
    out = []
    for k, (a, b) in enumerate(ranges):
        blocks = t.blocks(column["symbol"][a:b])
        spare = DELETE * int((column["copies"][a:b] - 1).sum())
        opened = k in (0, len(ranges) - 1)
        vectors, offset = t.backward(blocks, 0)
        costs, ranks = _costs(t, blocks, spare) if opened else (None, None)
        known = [x for x in turns[a:b] if x is not None]
        place = column["place"][a:b]
        legal = sum((x, y) in LEGAL for x, y in zip(place[:-1].tolist(), place[1:].tolist()))
        out.append({
            "conv": chunk.column("conv")[a].as_py(), "chunk": int(column["pos"][a]) >> CHUNK_BITS, "first": int(column["pos"][a]), "open": opened,
            "cost": t.vectors[vectors[0]][0] + offset + spare, "costs": costs, "ranks": ranks, "low": min(known, default=None),
            "high": max(known, default=None), "turns": len(set(known)), "from_turn": turns[a], "to_turn": turns[b - 1], "from_place": int(place[0]),
            "to_place": int(place[-1]), "illegal": int(column["copies"][a:b].sum()) - 1 - legal,
            **{c: int(column[c][a:b].sum()) for c in ("blank", "truncated", "repeats")}})
    return pa.Table.from_pylist(out, _schema(chunk.schema.field("conv").type, PIECE))


def _schema(conv: pa.DataType, ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    return pa.schema([("conv", conv), *((n, kinds[k]) for n, k in (x.split() for x in ddl.split(", ")))])


def _fold(pieces: pa.Table) -> pa.Table:
    """The cost vector after each open piece of one conversation and the state before it: backward through the costs, then forward."""
    rows = pieces.sort_by("first").to_pylist()
    vector = list(ENDS)
    for row in reversed(rows):
        row["vector"] = list(_normal(tuple(vector))[0])
        row["last"] = row is rows[-1]
        costs = [min(min(BIG, row["costs"][STATES * q + j] + vector[j]) for j in range(STATES)) for q in range(STATES)]
        vector = costs
    row_state = 0
    for row in rows:
        row["state"] = row_state
        reach = [(row["costs"][STATES * row_state + j] + row["vector"][j], row["ranks"][STATES * row_state + j], j) for j in range(STATES)]
        row_state = min(reach)[2]
    return pa.Table.from_pylist(rows, _schema(pieces.schema.field("conv").type, FOLDED))


def _summary(pieces: pa.Table) -> pa.Table:
    """Counts and cost of one conversation from its pieces."""
    rows = pieces.sort_by("first").to_pylist()
    total = {c: sum(r[c] for r in rows) for c in ("blank", "truncated", "repeats", "illegal", "turns")}
    for a, b in zip(rows, rows[1:]):
        total["turns"] -= a["to_turn"] is not None and a["to_turn"] == b["from_turn"]
        total["illegal"] += (a["to_place"], b["from_place"]) not in LEGAL
    low = min((r["low"] for r in rows if r["low"] is not None), default=None)
    high = max((r["high"] for r in rows if r["high"] is not None), default=None)
    total["gaps"] = 0 if low is None else high - low + 1 - total["turns"]
    cost = list(ENDS)
    for r in reversed(rows):
        cost = [r["cost"]] if r["costs"] is None else [min(min(BIG, r["costs"][STATES * q + j] + cost[j]) for j in range(STATES)) for q in range(STATES)]
    return pa.Table.from_pylist([{"conv": rows[0]["conv"], "cost": cost[0], **total}], _schema(pieces.schema.field("conv").type, SUMMARY))


def _trace(t: Tables, chunk: pa.Table, folded: pa.Table) -> pa.Table:
    """The plan of every row of a chunk: its edits, inserted turns before and after it included."""
    chunk = chunk.sort_by("pos")
    known = {r["first"]: r for r in folded.to_pylist()}
    pos, symbol, copies = (chunk.column(c).to_numpy() for c in ("pos", "symbol", "copies"))
    plans: list[str] = []
    for a, b in _pieces(chunk):
        blocks = t.blocks(symbol[a:b])
        row = known.get(int(pos[a]), {"vector": ENDS, "state": 0, "last": True})
        vectors, _ = t.backward(blocks, t.number[tuple(row["vector"])])
        part, state = t.forward(blocks, vectors, row["state"])
        part = [p + "D" * int(c - 1) for p, c in zip(part, copies[a:b])]
        part[-1] += ending(state) if row["last"] else ""
        plans += part
    return chunk.select(KEY).append_column("plan", pa.array(plans, pa.string()))


# --- conversations ----------------------------------------------------------------------------------

DONE = "audit string, repaired_sha256 string, repaired_turns bigint, gaps bigint, blank bigint, repeats bigint, truncated bigint, illegal bigint, cost bigint"


def _read(kind: pa.DataType):
    names = [x.split()[0] for x in DONE.split(", ")]
    counts = ("gaps", "blank", "repeats", "truncated", "illegal", "cost")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by conversation; of equal turns the plan comes before its texts. Only one batch and the edits of one conversation are held."""
        none = object()
        conv, audit, digest, lines, plan, numbers = none, [], hashlib.sha256(), 0, "", dict.fromkeys(counts, 0)
        out: list[dict] = []

        def closed() -> dict:
            return {"conv": conv, "audit": "".join(audit), "repaired_sha256": digest.hexdigest(), "repaired_turns": lines, **numbers}

        schema = _schema(kind, DONE)
        for batch in batches:
            for row in batch.to_pylist():
                if conv is none or row["conv"] != conv:
                    if conv is not none:
                        out.append(closed())
                    conv, audit, digest, lines, plan, numbers = row["conv"], [], hashlib.sha256(), 0, "", dict.fromkeys(counts, 0)
                if row["part"] == 0:
                    numbers = {c: row[c] for c in counts}
                elif row["part"] == 2:
                    plan = row["plan"]
                    audit.append(initials(plan))
                elif plan:  # of equal rows only the first can stay
                    for edit in plan:
                        if edit != "D":
                            role = {"u": "user", "U": "user", "a": "assistant", "A": "assistant", "K": row["role"]}[edit]
                            text = "" if edit in "ua" else row["text"]
                            digest.update(f"{chr(10) if lines else ''}{role}:{text}".encode())
                            lines += 1
                    plan = ""
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if conv is not none:
            yield pa.RecordBatch.from_pylist([closed()], schema)

    return run, names


def repair(rows: DataFrame, ids: DataFrame | None = None, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, repaired_turns) of every conversation.

    Rows are taken by turn, unknown turns first, then by role and by a hash of the text. A row's first fault counts: blank, duplicate (role and
    text seen earlier in the conversation), truncated (does not end with . ! or ?). ``audit`` are the initials of the cheapest edits (Keep 0,
    Rerole 3, Delete 4, Insert 3, a kept or reroled truncated row 3 more; blank and duplicate rows have to go) after which the roles'
    initials read ``(s?(ua)+)?``; of equally cheap ones the least in ASCII. A NULL role or text counts as one space. ``ids`` (one column)
    names conversations to return even without rows: counts 0, no edits. A NULL conversation is one of its own. Other columns are not read.

    Every row becomes one of nine symbols. Tables hold what each block of three symbols makes of each normalised cost vector, and
    blocks are processed by look-up, backward; forward, each block is expanded again from the vector after it. Long conversations
    are cut into chunks of rows, solved side by side: a chunk gives its least costs from state to state, which are folded. Equal rows are counted
    before they move. Texts move once, for the digest, which reads a conversation as a sorted stream, as SHA-256 has to.
    """
    flat = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"))
    named = rows.schema[conv].dataType.simpleString()
    t = Tables()
    turns = in_order(faults(flat)).withColumn("chunk", F.shiftright("pos", CHUNK_BITS))
    symbols = turns.select("chunk", "pos", *KEY, "symbol", "copies")
    solved = stored(turns.groupBy("chunk").applyInArrow(lambda chunk: _solve(t, chunk), f"conv {named}, {PIECE}"), "pieces")
    folded = solved.where("open").select("conv", "first", "chunk", "costs", "ranks").groupBy("conv").applyInArrow(_fold, f"conv {named}, {FOLDED}")
    plans = symbols.groupBy("chunk").cogroup(folded.groupBy("chunk")).applyInArrow(lambda chunk, ends: _trace(t, chunk, ends), f"conv {named}, {PLANS}")
    closed = solved.where("NOT open").select("conv", F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.col("high") - F.col("low") + 1 - F.col("turns")).alias("gaps"),
                                             "blank", "repeats", "truncated", "illegal", "cost")
    summed = solved.where("open").groupBy("conv").applyInArrow(_summary, f"conv {named}, {SUMMARY}")

    parts = [closed.withColumn("part", F.lit(0)), summed.withColumn("part", F.lit(0)), plans.withColumn("part", F.lit(2)),
             flat.select("*", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"), F.lit(3).alias("part"))]
    if ids is not None:
        parts.append(ids.select(F.col(ids.columns[0]).alias("conv")).distinct().withColumn("part", F.lit(1)))
    all_rows = parts[0]
    for part in parts[1:]:
        all_rows = all_rows.unionByName(part, allowMissingColumns=True)
    order = ["conv", F.col("part") > 1, *KEY[1:], "part"]
    run, names = _read(_arrow_type(rows, conv))
    done = all_rows.repartition("conv").sortWithinPartitions(*order).mapInArrow(run, f"conv {named}, {DONE}")
    return done.select(F.col("conv").alias("id"), "gaps", "blank", F.col("repeats").alias("duplicate"), "truncated", "illegal", "cost", "audit", "repaired_sha256", "repaired_turns")


def _arrow_type(rows: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[column].dataType)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with planted faults, by the checksum of ``conv:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes . ! ? out of it,
    3 repeats it, 4 makes its role user. NULLs count as one space."""

    def known(c: str) -> Column:
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(known(conv), F.lit(":"), known(turn)).cast("binary")), F.lit(20))
    marked = rows.select(F.col(conv), F.col(turn), known(role).alias("_role"), known(text).alias("_text"), kind.alias("_kind")).where("_kind <> 0")
    new_text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("_text", "[.!?]", "")).otherwise(F.col("_text"))
    twice = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))
    return marked.select(conv, turn, F.when(F.col("_kind") == 4, "user").otherwise(F.col("_role")).alias(role), new_text.alias(text), twice.alias("_copy")).drop("_copy")
