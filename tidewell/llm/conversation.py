"""Repair of conversations whose turns are broken, by error-correcting Earley parsing.

A sound conversation is an optional system turn, then user and assistant in turns.
``GRAMMAR`` says so over the initials of roles, and error productions make every
sequence of rows parse: a row may be deleted (D, cost 3; blank rows and repeats
must be), take the role user or assistant (R, 2) or stay (K, 0), and an empty user
or assistant turn may be inserted anywhere (I, 2); a truncated row that is not
deleted costs 1 more.  Items of the chart keep the least (cost, audit), the audit
being the edits' initials in order, and the least complete item is the repair:
the cheapest one, of equally cheap ones the one with the least audit.

Conversations are sorted by range over all tasks, so that a long one is spread
over many, and parsed in blocks of at most ``BLOCK`` rows and about ``BLOCK_BYTES``
characters.  The grammar is left-recursive, so all that a column passes on to the
next row are its kernel items, those with something recognised.  A block whose conversation may have begun elsewhere is
parsed once from each kernel item, and blocks are put together by adding costs and
audits.  Only these summaries of a conversation meet in one place, where they
become its audit; its texts pass block by block.

Order of rows: turn (nulls first), then role and text; equal rows stand together.
Null roles and texts are one space, and so are null ids and turns in the key of
`damaged`.  A null conv_id is a conversation of its own.  Every row's first fault
counts: blank, duplicate (role and text occurred earlier in the conversation), truncated.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import bounded_batches, stored
from .textbuf import frugal, frugal_group

SPACE = " \t\n\x0b\x0c\r"
ENDS = ".!?"
KEEP, DELETE, REROLE, INSERT, TRUNCATED = 0, 3, 2, 2, 1
BLOCK, BLOCK_BYTES = 1024, 1 << 20

#: Left-recursive, with initials of roles as terminals.
GRAMMAR = {"Talk": [(), ("Turns",)], "Turns": [("Head", "u", "a")], "Head": [(), ("s",), ("Turns",)]}
INSERTED = {"u": "user", "a": "assistant"}

Value = tuple[int, str]
Item = tuple[str, tuple[str, ...], int]
START: Item = ("Turns", ("Head", "u", "a"), 0)
#: Items with something recognised: nothing yet, after the system turn, after a user, after an assistant.
KERNEL: list[Item] = [START, ("Head", ("s",), 1), ("Turns", ("Head", "u", "a"), 2), ("Turns", ("Head", "u", "a"), 3)]


def _put(column: dict[Item, Value], item: Item, value: Value, todo: list[Item]) -> None:
    if item not in column or value < column[item]:
        column[item] = value
        todo.append(item)


def closed(kernel: dict[Item, Value]) -> dict[Item, Value]:
    """A column of the chart: its kernel items and all that prediction, completion and insertion make of them.

    All items begin at the first row, so a completed one goes on in whatever was predicted there.
    """
    column: dict[Item, Value] = {}
    todo: list[Item] = []
    for item, value in kernel.items():
        _put(column, item, value, todo)
    while todo:
        item = todo.pop()
        left, right, dot = item
        value = column[item]
        if dot == len(right):  # complete
            for parent, rules in GRAMMAR.items():
                for rule in rules:
                    if rule[:1] == (left,):
                        _put(column, (parent, rule, 1), value, todo)
        elif right[dot] in GRAMMAR:  # predict
            for rule in GRAMMAR[right[dot]]:
                # a symbol that begins with a nonterminal waits for that to complete
                if not rule or rule[0] not in GRAMMAR:
                    _put(column, (right[dot], rule, 0), value, todo)
        elif right[dot] in INSERTED:
            _put(column, (left, right, dot + 1), (value[0] + INSERT, value[1] + "I"), todo)
    return column


def scanned(column: dict[Item, Value], initial: str, forced: bool, truncated: bool, times: int = 1) -> dict[Item, Value]:
    """Kernel of the next column after one row (and `times` - 1 copies of it, which must go)."""
    out: dict[Item, Value] = {}
    gone = 3 * (times - 1), "D" * (times - 1)
    more = TRUNCATED * truncated

    def put(item: Item, value: Value, cost: int, edit: str) -> None:
        new = (value[0] + cost + gone[0], value[1] + edit + gone[1])
        if item not in out or new < out[item]:
            out[item] = new

    for item, value in column.items():
        left, right, dot = item
        if item in KERNEL:
            put(item, value, DELETE, "D")
        if forced or dot == len(right) or right[dot] in GRAMMAR:
            continue
        after = (left, right, dot + 1)
        if right[dot] == initial:
            put(after, value, KEEP + more, "K")
        if right[dot] in INSERTED:
            put(after, value, REROLE + more, "R")
    return out


def parsed(rows: list[tuple], seed: Item = START) -> dict[Item, Value]:
    """Least (cost, audit) of every kernel item after some rows (initial, forced, truncated, times), from one of them on."""
    column = closed({seed: (0, "")})
    for row in rows:
        column = closed(scanned(column, *row))
    return {item: column[item] for item in KERNEL if item in column}


def least(column: dict[Item, Value]) -> tuple[Value, Item] | None:
    """The complete item's value: nothing at all, or turns up to an assistant."""
    return min(((column[item], item) for item in (KERNEL[0], KERNEL[3]) if item in column), default=None)


def joined(before: dict[Item, Value], block: dict[Item, dict[Item, Value]]) -> tuple[dict[Item, Value], dict[Item, Item]]:
    """Values after one more block, parsed from each kernel item, and the item that each came by."""
    out: dict[Item, Value] = {}
    by: dict[Item, Item] = {}
    for seed, (cost, audit) in before.items():
        for item, (c, a) in block.get(seed, {}).items():
            value = (cost + c, audit + a)
            if item not in out or value < out[item]:
                out[item], by[item] = value, seed
    return out, by


def edited(roles: list[str], texts: list[str], times: list[int], audit: str, after: Item = START) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of all rows that an audit makes of the given ones, deleted rows left out; `after` is what came before."""
    state = KERNEL.index(after)
    row = 0
    copies = times[0] if times else 0
    for edit in audit:
        if edit != "D":
            due = "a" if state == 2 else "u"
            if edit == "I":
                yield edit, INSERTED[due], ""
            else:
                yield edit, INSERTED[due] if edit == "R" else roles[row], texts[row]
            state = 1 if edit == "K" and state == 0 and roles[row][:1] == "s" else 2 if due == "u" else 3
        if edit != "I":
            copies -= 1
            if not copies:
                row += 1
                copies = times[row] if row < len(times) else 0


# ---- rows, blocks and conversations ----


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times of conversations with faults put in by a checksum of `conv_id:turn`; equal rows are one row."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")), F.lit(20))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    return rows.where("kind != 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("times"))


def with_faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, times, blank, duplicate (the row as a whole; its copies are), truncated; equal rows are one row."""
    mark = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    rows = rows.withColumn("mark", mark)
    bare = F.btrim("text", F.lit(SPACE))
    # which rows occurred at an earlier turn is found without the texts
    seen = rows.where(bare != "").select("conv_id", "mark", "turn").distinct()
    first = seen.groupBy(F.col("conv_id").alias("c"), F.col("mark").alias("m")).agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = seen.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("mark") == F.col("m"))).where(~F.col("turn").eqNullSafe(F.col("first.turn")))
    none = F.lit(None).cast("string")
    told = later.select("conv_id", "turn", none.alias("role"), none.alias("text"), F.lit(0).cast("long").alias("times"), "mark", F.lit(True).alias("duplicate"))
    both = rows.select("conv_id", "turn", "role", "text", "times", "mark", F.lit(False).alias("duplicate")).unionByName(told)
    out = both.groupBy("conv_id", "turn", "mark").agg(F.first("role", True).alias("role"), F.first("text", True).alias("text"), F.sum("times").alias("times"), F.max("duplicate").alias("duplicate"))
    return out.select("conv_id", "turn", "role", "text", "times", (bare == "").alias("blank"), "duplicate", (~F.right(bare, F.lit(1)).isin(*ENDS)).alias("truncated"))


_VALUE = "struct<seed: int, item: int, cost: long, audit: string>"
_PIECE = f"conv_id long, block long, whole boolean, roles array<string>, texts array<string>, times array<long>, chart array<{_VALUE}>, first_turn long, last_turn long, turns long, blank long, duplicate long, truncated long, illegal long, head string, tail string, sha string"
_PIECE_PA = pa.schema(
    [("conv_id", pa.int64()), ("block", pa.int64()), ("whole", pa.bool_()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("times", pa.list_(pa.int64()))]
    + [("chart", pa.list_(pa.struct([("seed", pa.int32()), ("item", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))]
    + [(c, pa.int64()) for c in ("first_turn", "last_turn", "turns", "blank", "duplicate", "truncated", "illegal")]
    + [("head", pa.string()), ("tail", pa.string()), ("sha", pa.string())]
)
LEGAL = {"su", "ua", "au"}


def _piece(conv, block: int, whole: bool, rows: list[tuple], opens: bool, texts: bool) -> dict:
    """A block's summary; rows are (turn, role, text, times, blank, duplicate, truncated).

    A whole conversation has its repair's value and digest, and its rows only if `texts`.
    """
    tokens, illegal, before = [], 0, None
    blank = duplicate = truncated = 0
    for _, role, _, times, b, d, t in rows:
        initial, t = role[:1], t and not b and not d
        tokens.append((initial, b or d, t, times))
        blank += times * b
        duplicate += (times - 1 + d) * (not b)
        truncated += t
        illegal += (before is not None and before + initial not in LEGAL) + times - 1
        before = initial
    columns = {"roles": [r[1] for r in rows], "texts": [r[2] for r in rows], "times": [r[3] for r in rows]}
    chart, sha = {s: parsed(tokens, s) for s in ([START] if opens else KERNEL)}, None
    if whole:
        (cost, audit), item = least(chart[START])
        chart = {START: {item: (cost, audit)}}
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in edited(*columns.values(), audit)).encode()).hexdigest()
    turns = [r[0] for r in rows if r[0] is not None]
    return {
        "conv_id": conv, "block": block, "whole": whole, **(columns if texts or not whole else {}),
        "chart": [{"seed": KERNEL.index(s), "item": KERNEL.index(i), "cost": v[0], "audit": v[1]} for s, c in chart.items() for i, v in c.items()],
        "first_turn": min(turns, default=None), "last_turn": max(turns, default=None), "turns": len(set(turns)),
        "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal, "head": rows[0][1][:1], "tail": before, "sha": sha,
    }


def blocks(rows: DataFrame, texts: bool = True, limit: int = BLOCK) -> DataFrame:
    """Blocks of rows in order, each with its chart: from the start, or from every kernel item where it may not be the conversation's first.

    Without `texts`, conversations that are one block are kept as their summary.
    """

    def run(batches):
        at, held, size, number, opens, edge = None, [], 0, 0, False, True

        def made(whole: bool):
            nonlocal number, held, size, opens
            number += 1
            out = _piece(at[0], base | number, whole and opens, held, opens, texts)
            held, size, opens = [], 0, False
            return out

        base = 0
        for batch in batches:
            base, out = batch.column(0)[0].as_py() << 32 if len(batch) else base, []
            for _, conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (conv,) != at:
                    if at is not None:
                        out.append(made(True))
                        edge = False
                    # the first conversation of a task may have begun in the task before
                    at, opens = (conv,), not edge
                elif len(held) == limit or size > BLOCK_BYTES:
                    out.append(made(False))
                held.append(tuple(row))
                size += len(row[2])
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=_PIECE_PA)
        if held:
            # the last one may go on in the next task
            yield pa.RecordBatch.from_pylist([made(False)], schema=_PIECE_PA)

    order = ["conv_id", "turn", "role", "text"]
    spread = rows.repartitionByRange("conv_id", "turn", "role", F.left("text", F.lit(64))).sortWithinPartitions(*order)
    names = ["conv_id", "turn", "role", "text", "times", "blank", "duplicate", "truncated"]
    return stored(spread.select(F.spark_partition_id().cast("long").alias("p"), *names).mapInArrow(frugal(run), _PIECE), "talk-blocks")


_CHOICE = "conv_id long, block long, after int, audit string, cost long, first_turn long, last_turn long, turns long, illegal long"
_CHOICE_PA = pa.schema([(c.split()[0], {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}[c.split()[1]]) for c in _CHOICE.split(", ")])


def _chart(values: list[dict]) -> dict[Item, dict[Item, Value]]:
    out: dict[Item, dict[Item, Value]] = {}
    for v in values:
        out.setdefault(KERNEL[v["seed"]], {})[KERNEL[v["item"]]] = (v["cost"], v["audit"])
    return out


def _chosen(pieces: list[dict]) -> Iterator[dict]:
    """Of one conversation's blocks, in order and without texts: each block's edits and what came before it."""
    column, path = {START: (0, "")}, []
    for p in pieces:
        column, by = joined(column, _chart(p["chart"]))
        path.append(by)
    _, item = least(column)
    chosen = []
    for p, by in zip(reversed(pieces), reversed(path)):
        seed = by[item]
        cost, audit = _chart(p["chart"])[seed][item]
        chosen.append({**p, "after": KERNEL.index(seed), "cost": cost, "audit": audit})
        item = seed
    tail, turn = None, None
    for p in reversed(chosen):
        # pairs of rows and equal turns on both sides of a block's edge
        p["illegal"] += tail is not None and tail + p["head"] not in LEGAL
        p["turns"] -= turn is not None and p["first_turn"] == turn
        tail, turn = p["tail"], p["last_turn"] if p["last_turn"] is not None else turn
        yield {c: p[c] for c in _CHOICE_PA.names}


def edits(pieces: DataFrame) -> DataFrame:
    """Blocks with after (the kernel item before them), audit and cost as they are in the cheapest repair of the whole conversation."""
    light = pieces.drop("roles", "texts", "times", "blank", "duplicate", "truncated", "sha")

    def alone(batches):
        for batch in batches:
            rows = [next(_chosen([p])) for p in batch.to_pylist()]
            yield pa.RecordBatch.from_pylist(rows, schema=_CHOICE_PA)

    def together(key, table: pa.Table) -> pa.Table:
        rows = list(_chosen(sorted(table.to_pylist(), key=lambda p: p["block"])))
        return pa.Table.from_pylist(rows, schema=_CHOICE_PA)

    chosen = light.where("whole").mapInArrow(frugal(alone), _CHOICE)
    # a conversation on an edge of a task, or longer than a block
    return chosen.unionByName(light.where("not whole").groupBy("conv_id").applyInArrow(frugal_group(together), _CHOICE))


_EDITED = "conv_id long, block long, edits array<struct<edit: string, role: string, text: string>>"


def repaired(pieces: DataFrame, chosen: DataFrame) -> DataFrame:
    """conv_id, block, edits (edit, role, text; what is deleted left out): in the order of blocks these are the repaired conversations."""
    both = pieces.select("conv_id", "block", "roles", "texts", "times").join(chosen.select("block", "after", "audit"), "block")
    kind = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("edits", pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])))])

    def run(batches):
        for batch in batches:
            rows = []
            for p in batch.to_pylist():
                made = [{"edit": e, "role": r, "text": t} for e, r, t in edited(p["roles"], p["texts"], p["times"], p["audit"], KERNEL[p["after"]])]
                rows.append({"conv_id": p["conv_id"], "block": p["block"], "edits": made})
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return both.select("conv_id", "block", "roles", "texts", "times", "after", "audit").mapInArrow(frugal(run), _EDITED)


def _digested(lines: DataFrame) -> DataFrame:
    """conv_id, sha: digest of all `role:text` lines of a conversation, which pass in order and are never held."""

    def run(batches):
        at, sha, any_line = None, None, False
        for batch in batches:
            out = []
            for conv, made in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if (conv,) != at:
                    if at is not None:
                        out.append((at[0], sha.hexdigest()))
                    at, sha, any_line = (conv,), hashlib.sha256(), False
                for e in made:
                    sha.update(f"{chr(10) if any_line else ''}{e['role']}:{e['text']}".encode())
                    any_line = True
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([s for _, s in out])], ["conv_id", "sha"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int64()), pa.array([sha.hexdigest()])], ["conv_id", "sha"])

    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(frugal(run), "conv_id long, sha string")


def repair(conversations: DataFrame, broken: bool = False, limit: int = BLOCK) -> DataFrame:
    """One row a conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    With `broken`, faults are put in first (`damaged`); conversations that lose all rows by it stay.
    Blocks have `limit` rows at most.
    """
    bounded_batches(conversations.sparkSession)
    rows = damaged(conversations) if broken else conversations.select("conv_id", "turn", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")], F.lit(1).cast("long").alias("times"))
    pieces = blocks(with_faults(rows), False, limit)
    chosen = stored(edits(pieces), "talk-edits")
    faults = pieces.groupBy("conv_id").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    told = chosen.groupBy("conv_id").agg(
        F.coalesce(F.max("last_turn") - F.min("first_turn") + 1 - F.sum("turns"), F.lit(0)).alias("gaps"),
        F.sum("illegal").alias("illegal"),
        F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "audit"))), lambda b: b["audit"]), "").alias("audit"),
    )
    split = pieces.where("not whole")
    shas = pieces.where("whole").select("conv_id", "sha").unionByName(_digested(repaired(split, chosen)))
    out = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    for part in (faults, told, shas):
        named = part.withColumnRenamed("conv_id", "c")
        out = out.join(named, F.col("conv_id").eqNullSafe(F.col("c")), "left").drop("c")
    numbers = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
