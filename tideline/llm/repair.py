"""Conversations brought back to the shape system? (user assistant)+ by the cheapest edits, through a suffix-shared automaton.

A conversation's rows, in order of turn, become a signature: one symbol a row for its role and fault. Signatures are minimised from the end: sorted by their
reversed text, those that end alike are neighbours, and what they share is a path of nodes that is walked once. A node has, for each state of the grammar, the cost that is
still to come and the first letters of the best audit with the state that they lead to. Nodes whose costs (relative to their least), letters and order of
audits agree are one node of the minimal automaton, of which there are a few dozen whatever the table; so a node that is new costs one lookup. Each distinct signature is repaired once and then joined to all
conversations that have it.

Edits and costs: K keeps a row (0), R gives it the role that is due (3), D deletes it (4; a must for blank rows and duplicates), I inserts an empty row of the role that is due (3). A truncated
row that stays costs 3 more. Of equally cheap audits the one least in ASCII order is taken.

Faults, the first that holds: blank (nothing but ASCII blanks), duplicate (role and text seen earlier in the conversation), truncated (the last character that isn't
blank is none of .!?). Nulls of role and text count as one space. Rows of one turn go by role, then text; a null turn comes first; rows without a conversation (null conv_id) are one
conversation. Repeated rows are duplicates. A very long conversation is one stream of rows in one task, as its hash and its audit are of the whole: it is
never gathered (a byte a row for the signature). An empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm._common import cut, small_batches, table

#: Costs of edits, the surcharge of a truncated row that stays.
REROLE, DELETE, INSERT, STAYS_TRUNCATED = 3, 4, 3, 3
#: States of the grammar: nothing yet, after system, after user, after assistant. What role is due next (system may come first besides), and where it leads.
START, SYSTEM, USER, ASSISTANT = range(4)
DUE = {START: "u", SYSTEM: "u", USER: "a", ASSISTANT: "u"}
NEXT = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: Role initials that the grammar knows, pairs of neighbours that are legal, full names of roles that edits give, blanks.
INITIALS, LEGAL, NAMES = "sua", ("su", "ua", "au"), {"u": "user", "a": "assistant"}
BLANKS = "\\x20\\x09-\\x0D"
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


class Automaton:
    """Nodes of the minimal automaton, made as they are met: costs and ranks of the four states' best audits, and steps by symbol.

    A symbol is s, u, a or o (another role), in capitals if truncated, or x for a row that must go.
    """

    def __init__(self):
        self.costs: list[tuple[int, ...]] = []
        self.ranks: list[tuple[int, ...]] = []
        self.number: dict[tuple, int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int, tuple[tuple[str, int], ...]]] = {}
        # the end: nothing is left to do at START and after a reply, and rows are missing otherwise
        self.end, self.end_cost, self.end_moves = self._node([(0, "", 0), None, None, (0, "", 0)], [0] * 4)

    def _node(self, direct: list, ranks) -> tuple[int, int, tuple[tuple[str, int], ...]]:
        """The node of four states' direct choices (cost, letters, next state), each after up to two inserted rows: its number, least cost, and moves."""
        best = []
        for q in range(4):
            options, at = [], q
            for k in range(3):
                if direct[at] is not None:
                    options += [(c + k * INSERT, "I" * k + letters, ranks[to], to) for c, letters, to in ([direct[at]] if isinstance(direct[at], tuple) else direct[at])]
                at = NEXT[DUE[at]]
            best.append(min(options))
        least = min(b[0] for b in best)
        order = sorted({b[1:3] for b in best})
        moves = tuple((b[1], b[3]) for b in best)
        key = (tuple(b[0] - least for b in best), tuple(order.index(b[1:3]) for b in best))
        if key not in self.number:
            self.number[key] = len(self.costs)
            self.costs.append(key[0])
            self.ranks.append(key[1])
        return self.number[key], least, moves

    def step(self, node: int, symbol: str) -> tuple[int, int, tuple[tuple[str, int], ...]]:
        """The node that `symbol` before `node` makes, what it adds to the least cost, and for each state its letters and the state at `node`."""
        found = self.steps.get((node, symbol))
        if found is None:
            costs, choices = self.costs[node], []
            for q in range(4):
                ways = [(DELETE + costs[q], "D", q)]
                if symbol != "x":
                    role, extra = symbol.lower(), STAYS_TRUNCATED if symbol.isupper() else 0
                    if role == DUE[q] or (q == START and role == "s"):
                        ways.append((extra + costs[NEXT[role]], "K", NEXT[role]))
                    ways.append((extra + REROLE + costs[NEXT[DUE[q]]], "R", NEXT[DUE[q]]))
                choices.append(ways)
            found = self.steps[node, symbol] = self._node(choices, self.ranks[node])
        return found


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Signatures in order of their reversed text: each with its least cost and best audit. The path of nodes of what neighbours share stays."""
    auto, before = Automaton(), ""
    path = [(auto.end, auto.end_cost, auto.end_moves)]  # node, least cost so far, moves; one for each suffix, the shortest first
    for batch in batches:
        found = []
        for signature in batch.column("signature").to_pylist():
            back = signature[::-1]
            shared = 0
            for x, y in zip(back, before):
                if x != y:
                    break
                shared += 1
            del path[shared + 1 :]
            for symbol in back[shared:]:
                node, cost, _ = path[-1]
                node, more, moves = auto.step(node, symbol)
                path.append((node, cost + more, moves))
            before, state, letters = back, START, []
            for _, _, moves in reversed(path):
                part, state = moves[state]
                letters.append(part)
            node, cost, _ = path[-1]
            found.append((signature, cost + auto.costs[node][START], "".join(letters)))
        if found:
            yield pa.record_batch([pa.array([f[0] for f in found]), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found])], ["signature", "cost", "audit"])


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone of rows damaged by crc32(`conv_id:turn`) % 20; dropped rows stay as rows without role and text that are `gone`."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(one("conv_id"), F.lit(":"), one("turn")), "UTF-8")) % 20
    rows = conversations.select("conv_id", "turn", one("role").alias("role"), one("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).when(F.col("kind") != 0, F.col("text"))
    role = F.when(F.col("kind") == 4, "user").when(F.col("kind") != 0, F.col("role"))
    again = F.explode(F.array_repeat(F.col("kind"), F.when(F.col("kind") == 3, 2).otherwise(1)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), again.alias("kind")).select("conv_id", "turn", "role", "text", (F.col("kind") == 0).alias("gone"))


def _faults(rows: DataFrame) -> DataFrame:
    """conv_id, symbol, blank, duplicate, truncated, illegal, turn, fresh (a turn not seen before) of rows in order; symbol is empty for rows that are gone."""
    rows = rows.repartition("conv_id")  # both windows and the signatures keep to it
    order = [F.asc_nulls_first("turn"), "role", "text", "duplicate"]  # of equal rows of a turn the first isn't a duplicate
    earlier = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy("turn")) > 1
    blank = ~F.col("text").rlike(f"[^{BLANKS}]")
    open_end = ~F.col("text").rlike(f"[.!?][{BLANKS}]*\\z")
    initial = F.substring("role", 1, 1)
    d = rows.withColumn("blank", blank).withColumn("duplicate", ~F.col("blank") & earlier).withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & open_end).withColumn("initial", initial)
    whole = Window.partitionBy("conv_id", "gone").orderBy(*order)
    before = lambda c: F.lag(c).over(whole)
    illegal = before("initial").isNotNull() & ~F.concat(before("initial"), "initial").isin(*LEGAL)
    fresh = F.col("turn").isNotNull() & ~F.coalesce(before("turn") == F.col("turn"), F.lit(False))
    known = F.when(F.col("initial").isin(*INITIALS), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("gone"), "").when(F.col("blank") | F.col("duplicate"), "x").when(F.col("truncated"), F.upper(known)).otherwise(known)
    flag = lambda c: (F.coalesce(c, F.lit(False)) & ~F.col("gone")).cast("long")
    d = d.withColumn("illegal", illegal).withColumn("fresh", fresh).withColumn("symbol", symbol)
    return d.sortWithinPartitions("conv_id", "gone", *order).select("conv_id", "symbol", F.when(~F.col("gone"), F.col("turn")).alias("turn"), *[flag(F.col(c)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "fresh")])


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation: its counts and its signature."""
    flags = ("blank", "duplicate", "truncated", "illegal", "fresh")
    names = ["conv_id", *COUNTS, "signature"]
    open_id, held = None, None

    def ready(done: list) -> pa.RecordBatch:
        return pa.record_batch([pa.array([d[k] for d in done], pa.string() if k == len(names) - 1 else pa.int64()) for k in range(len(names))], names)

    def closed(conv, state) -> tuple:
        symbols, lo, hi, sums = state
        gaps = hi - lo + 1 - sums[4] if lo is not None else 0
        return conv, gaps, sums[0], sums[1], sums[2], sums[3], symbols.decode()

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("conv_id", "symbol", "turn", *flags)]
        done = []
        for conv, symbol, turn, *marks in zip(*columns):
            if held is None or conv != open_id:
                if held is not None:
                    done.append(closed(open_id, held))
                open_id, held = conv, [bytearray(), None, None, [0] * 5]
            held[0] += symbol.encode()
            if turn is not None:
                held[1] = turn if held[1] is None else min(held[1], turn)
                held[2] = turn if held[2] is None else max(held[2], turn)
            for k, m in enumerate(marks):
                held[3][k] += m
        if done:
            yield ready(done)
    if held is not None:
        yield ready([closed(open_id, held)])


def audits(rows: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation of `rows` (conv_id, turn, role, text, gone)."""
    small_batches(rows.sparkSession)
    found = cut(_faults(rows).mapInArrow(_signatures, "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", signature string"))
    distinct = found.select("signature").distinct().orderBy(F.reverse("signature"))
    repaired = distinct.mapInArrow(_repairs, "signature string, cost long, audit string")
    return found.join(repaired, "signature").drop("signature")


def _edited(messages: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str]]:
    """(role, text) of a conversation after its audit's edits."""
    state = START
    for letter in audit:
        if letter == "I":
            role, text, initial = NAMES[DUE[state]], "", DUE[state]
        else:
            role, text = next(messages)
            if letter == "D":
                continue
            initial = role[:1] if letter == "K" else DUE[state]
            role = role if letter == "K" else NAMES[DUE[state]]
        yield role, text
        state = NEXT[initial]


def _rebuilt(carried: list[str], schema: pa.Schema, digest: bool):
    """Rows sorted by conversation, its audit before its messages: one row with the hash of the repaired conversation, or its messages."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                yield from part.to_pylist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every = rows(batches)
        now = next(every, None)
        out: list[dict] = []
        size = 0
        while now is not None:
            head, now = now, None

            def messages() -> Iterator[tuple[str, str]]:
                nonlocal now
                for row in every:
                    if row["audit"] is not None:
                        now = row
                        return
                    yield row["role"], row["text"]

            of_this = messages()
            fixed = {c: head[c] for c in carried}
            hashed, n = hashlib.sha256(), 0
            for role, text in _edited(of_this, head["audit"]):
                if digest:
                    hashed.update(((("\n" if n else "") + role) + ":" + text).encode())
                else:
                    out.append({"conv_id": head["conv_id"], "position": n, "role": role, "text": text})
                    size += len(text) + 50
                n += 1
                if size > 1 << 22:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
            for _ in of_this:
                raise RuntimeError("an audit ended before its conversation")
            if digest:
                out.append(fixed | {"repaired_sha256": hashed.hexdigest()})
                size += len(head["audit"]) + 200
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def repaired(rows: DataFrame, found: DataFrame, digest: bool = False) -> DataFrame:
    """The messages (conv_id, position, role, text) of `rows` after the edits of `found` (as `audits` gives it); or, with `digest`, `found` with repaired_sha256, of `role:text` joined by line feeds."""
    carried = found.columns
    none: list[Column] = [F.lit(None).cast(found.schema[c].dataType).alias(c) for c in carried if c != "conv_id"]
    heads = found.select(*carried, *[F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"))])
    body = rows.where("not gone").select("conv_id", *none, "turn", "role", "text")
    both = heads.unionByName(body).repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), F.asc_nulls_first("turn"), "role", "text").drop("turn")
    strings = ("audit", "role", "text", "repaired_sha256")
    names = [*carried, "repaired_sha256"] if digest else ["conv_id", "position", "role", "text"]
    arrow = pa.schema([(c, pa.string() if c in strings else pa.int64()) for c in names])
    return both.mapInArrow(_rebuilt(carried, arrow, digest), ", ".join(f"{c} {'string' if c in strings else 'long'}" for c in names))


def op13_conversation_repair(spark, sf_dir: str) -> DataFrame:
    """Nulls count as one space, a null conv_id is a conversation; ties of a turn go by role, then text; every original conversation has a row, an empty table none."""
    small_batches(spark)
    rows = damage(table(spark, sf_dir, "conversations"))
    return repaired(rows, audits(rows), digest=True)
