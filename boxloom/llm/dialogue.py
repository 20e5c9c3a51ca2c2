"""Repair of conversations: the cheapest edits that make the roles of a conversation take turns.

Rows of a conversation stand in the order of their turn (nulls first; rows of an equal turn in the
order of an MD5 of role and text, so copies are neighbours). A row is kept, given the other role,
or deleted, and rows without text may be inserted anywhere, so that the role initials read
`(s?(ua)+)?`. Iterative deepening A* finds the answer: depth first in the ASCII order of the edits
D, I, K, R under rising cost bounds, with a table of the largest budget with which each state has
been entered; the first accepting path is the cheapest one, and of those the ASCII-least.

A conversation of any length is cut into segments of a fixed number of rows. A segment is searched
once for every state in which it may begin and end; what a segment yields then is a small matrix
of costs and of the order of its paths, and matrices are chained level by level. Inserted rows
belong to the row after them, those at the end to the last segment, so no path of a segment is the
beginning of another one, and the first segment in which two paths differ decides their order.

Only the SHA-256 of a repaired conversation is one chain of bytes: the sorted rows of a
conversation stream through one task that holds one batch of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from boxloom.llm.common import arrow, stored

SEGMENT = 128  # rows that are searched at once
FAN = 256  # segments, or groups of segments, that are chained at once
SPACES = " \t\n\x0b\x0c\r"  # fixed: [\x20\x09-\x0D]

# states between two rows: nothing yet, after a system row, after a user row, after an assistant row; the end
START, SYSTEM, USER, ASSISTANT, END = range(5)
INITIALS = "sua"  # other initials are of class 3
FINE, TRUNCATED, BLANK, DUPLICATE = range(4)
FIRST_CODE = 65  # a row is one character: its fault times four plus the class of its initial, from here on

_KEEP = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
_TURN = (USER, USER, ASSISTANT, USER)  # the state after a row of the role that may come next
_LEGAL = {(0, 1), (1, 2), (2, 1)}
UNREACHED = 1 << 60


def code(initial: str, fault: int) -> str:
    return chr(FIRST_CODE + 4 * fault + (INITIALS.index(initial) if initial and initial in INITIALS else 3))


@lru_cache(maxsize=100_000)
def cheapest(rows: str, entry: int = START, end: int = END) -> tuple[int, str] | None:
    """(cost, script) of the cheapest edits of `rows` from state `entry` to `end`, the ASCII-least of them.

    The script has D and K for deleted and kept rows, U and A for rows given the role user or
    assistant, u and a for inserted ones. Rows are inserted behind the last row only if `end` is
    END, which an empty conversation and one that ends on an assistant row reach. None if there is
    no such path.
    """
    n = len(rows)
    kinds = [(ord(c) - FIRST_CODE) % 4 for c in rows]
    faults = [(ord(c) - FIRST_CODE) // 4 for c in rows]
    # What the rest costs at least: its deletions, its truncated rows, and two for every two of a chain of
    # neighbours that cannot stay as they are. An edit mends two neighbourhoods only if both are of the row
    # it changes, and none makes the sum over the chains smaller by more than two. Behind the last row
    # stands the end, if it must be reached.
    after = [-1] * (n + 1)  # next row that may stay
    fixed = [0] * (n + 1)
    chain, rest = [0] * (n + 1), [0] * (n + 1)  # wrong neighbourhoods in a row from here on, and what those behind them cost
    for i in range(n - 1, -1, -1):
        gone = faults[i] >= BLANK
        after[i] = after[i + 1] if gone else i
        fixed[i] = fixed[i + 1] + (3 if gone else faults[i])
        behind = after[i + 1]
        if not gone and (end == END and kinds[i] != 2 if behind < 0 else (kinds[i], kinds[behind]) not in _LEGAL):
            chain[i], rest[i] = 1 + chain[behind], rest[behind]
        elif not gone:
            rest[i] = rest[behind] + (chain[behind] + 1) // 2 * 2

    system = [UNREACHED] * (n + 1)  # all rows from here on deleted but one system row
    for i in range(n - 1, -1, -1):
        system[i] = min(3 + system[i + 1], faults[i] + 3 * (n - i - 1) if kinds[i] == 0 and faults[i] < BLANK else UNREACHED)

    def least(i: int, state: int) -> int:
        if end <= SYSTEM and state != START:  # before a user row there is nothing or a system row, so the rest goes
            return 3 * (n - i) if state == end else UNREACHED
        if end <= SYSTEM:
            return 3 * (n - i) if end == START else system[i]
        j = after[i]
        if j < 0:
            return fixed[i] + 2 * (end == END and state in (SYSTEM, USER))
        return fixed[i] + rest[j] + (chain[j] + ((state, kinds[j]) not in _KEEP) + 1) // 2 * 2

    def moves(i: int, state: int):
        """(edit, cost, next row, next state) in ASCII order of D, I, K, R."""
        turned = _TURN[state]
        name = "u" if turned == USER else "a"
        if i < n:
            yield "D", 3, i + 1, state
        if i < n or end == END:
            yield name, 2, i, turned
        if i < n and faults[i] < BLANK:
            kept = _KEEP.get((state, kinds[i]))
            if kept is not None:
                yield "K", faults[i], i + 1, kept
            yield name.upper(), 2 + faults[i], i + 1, turned

    bound = least(0, entry)
    while bound < UNREACHED:
        over = UNREACHED
        entered = [-1] * (4 * (n + 1))
        entered[entry] = bound
        script: list[str] = []
        path = [(0, entry, bound, moves(0, entry))]
        while path:
            i, state, budget, edits = path[-1]
            if i == n and (state == end or end == END and state in (START, ASSISTANT)):
                return bound - budget, "".join(script)
            for edit, cost, j, to in edits:
                left = budget - cost
                need = least(j, to)
                if left < need:
                    over = min(over, bound - left + need)
                elif left > entered[4 * j + to]:
                    entered[4 * j + to] = left
                    script.append(edit)
                    path.append((j, to, left, moves(j, to)))
                    break
            else:
                path.pop()
                if script:
                    script.pop()
        bound = over
    return None


def searched(rows: str, first: bool, last: bool) -> tuple[list[int], list[int], list[str | None]]:
    """Costs, path ranks and scripts of a segment, at place entry * 5 + end; ranks order the scripts of an entry."""
    costs, ranks, scripts = [UNREACHED] * 20, [-1] * 20, [None] * 20
    for entry in ([START] if first else range(4)):
        found = []
        for end in ([END] if last else range(4)):
            if got := cheapest(rows, entry, end):
                costs[entry * 5 + end], scripts[entry * 5 + end] = got
                found.append((audit_of(got[1]), end))
        for rank, (_, end) in enumerate(sorted(found)):
            ranks[entry * 5 + end] = rank
    return costs, ranks, scripts


def audit_of(script: str) -> str:
    return script.translate(str.maketrans("uaUA", "IIRR"))


@dataclass(slots=True)
class Node:
    costs: list[int]
    ranks: list[int]


def route(nodes: list[Node], entry: int, end: int) -> list[tuple[int, int]] | None:
    """(entry, end) of every node on the cheapest way through `nodes`, the first by rank where costs are equal."""
    rest = [UNREACHED] * 5
    rest[end] = 0
    below = [rest]
    for node in reversed(nodes):
        rest = [min(node.costs[s * 5 + t] + rest[t] for t in range(5)) for s in range(4)] + [UNREACHED]
        below.append([min(x, UNREACHED) for x in rest])
        rest = below[-1]
    below.reverse()
    if below[0][entry] >= UNREACHED:
        return None
    out = []
    for k, node in enumerate(nodes):
        best = [t for t in range(5) if below[k + 1][t] < UNREACHED and node.costs[entry * 5 + t] + below[k + 1][t] == below[k][entry]]
        chosen = min(best, key=lambda t: node.ranks[entry * 5 + t])
        out.append((entry, chosen))
        entry = chosen
    return out


def chained(nodes: list[Node]) -> Node:
    """One node for a row of them."""
    costs, ranks = [UNREACHED] * 20, [-1] * 20
    for entry in range(4):
        found = []
        for end in range(5):
            if way := route(nodes, entry, end):
                costs[entry * 5 + end] = sum(n.costs[s * 5 + t] for n, (s, t) in zip(nodes, way))
                found.append(([n.ranks[s * 5 + t] for n, (s, t) in zip(nodes, way)], end))
        for rank, (_, end) in enumerate(sorted(found)):
            ranks[entry * 5 + end] = rank
    return Node(costs, ranks)


def _letter(fault: Column, initial: Column) -> Column:
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return F.char(F.lit(FIRST_CODE) + 4 * fault + kind)


def ordered_rows(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, uid, fp, initial, blank, cut), written; uid rises with the order of the rows.

    Rows are dealt out by ranges of (conv, turn, fp) and sorted, so a number that rises inside each
    range and from range to range is at hand without a window over a conversation.
    """
    said, by = F.coalesce(F.col(text), F.lit(" ")), F.coalesce(F.col(role), F.lit(" "))
    shaped = rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), by.alias("role"), said.alias("text"))
    end = F.rtrim("text", F.lit(SPACES))
    # the length of the role parts the two texts
    shaped = shaped.select("*", F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")).alias("fp"),
                           F.substring("role", 1, 1).alias("initial"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    keys = [F.asc_nulls_first("conv"), F.asc_nulls_first("turn"), F.asc("fp")]
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = shaped.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, *keys, F.asc("salt")).drop("salt").sortWithinPartitions(*keys)
    return stored(dealt.withColumn("uid", F.monotonically_increasing_id()), "rows")


def _segments(rows: DataFrame, segment: int) -> DataFrame:
    """(conv, seg, last, codes, uids): the rows of every segment in order; behind the first segment also the row before it."""
    part = F.shiftright("uid", 33)
    spans = rows.groupBy("conv", part.alias("part")).agg(F.min("uid").alias("lo"), F.count(F.lit(1)).alias("n"))
    of = Window.partitionBy("conv")
    spans = spans.select(F.col("conv").alias("c"), F.col("part").alias("p"), F.sum("n").over(of).alias("total"),
                         (F.sum("n").over(of.orderBy("part")) - F.col("n") - F.col("lo")).alias("shift"))
    firsts = rows.where("NOT blank").groupBy("conv", "fp").agg(F.min("uid").alias("first")).select("first")
    numbered = (rows.select("conv", "uid", "blank", "cut", "initial").join(spans, F.col("conv").eqNullSafe(F.col("c")) & (part == F.col("p")))
                .join(firsts, F.col("uid") == F.col("first"), "left"))
    fault = F.when(F.col("blank"), BLANK).when(F.col("first").isNull(), DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(FINE)
    numbered = numbered.select("conv", "uid", "total", (F.col("uid") + F.col("shift")).alias("at"), _letter(fault, F.col("initial")).alias("code"))
    own = F.floor(F.col("at") / segment)
    last_of_own = ((F.col("at") + 1) % segment == 0) & (F.col("at") + 1 < F.col("total"))
    dealt = numbered.withColumn("seg", F.explode(F.when(last_of_own, F.array(own, own + 1)).otherwise(F.array(own))))
    held = dealt.groupBy("conv", "seg").agg(F.array_sort(F.collect_list(F.struct("uid", "code"))).alias("rows"), F.max("total").alias("total"))
    return held.select("conv", "seg", (F.col("seg") == F.floor((F.col("total") - 1) / segment)).alias("last"),
                       F.array_join("rows.code", "").alias("codes"), F.col("rows.uid").alias("uids"))


_NODE = "costs array<bigint>, ranks array<int>"


def _batch(kinds: list[T.StructField], columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, to_arrow_type(k.dataType)) for c, k in zip(columns, kinds)], [k.name for k in kinds])


def _mapped(df: DataFrame, schema: T.StructType, one) -> DataFrame:
    """Rows of `one(*values)` for every row of `df`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, len(whole), 512):
                part = whole.slice(start, 512)
                rows = [r for values in zip(*[c.to_pylist() for c in part.columns]) for r in one(*values)]
                yield _batch(schema.fields, list(map(list, zip(*rows))) if rows else [[] for _ in schema.fields])

    return arrow(df, run, schema)


def _fields(conv: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv", conv), *T.StructType.fromDDL(rest).fields])


def _search_segment(conv, seg, last, codes, uids):
    before, rows = (codes[0], codes[1:]) if seg else ("", codes)
    kinds = [(ord(c) - FIRST_CODE) % 4 for c in codes]
    faults = [(ord(c) - FIRST_CODE) // 4 for c in rows]
    illegal = sum(pair not in _LEGAL for pair in zip(kinds, kinds[1:]))
    costs, ranks, scripts = searched(rows, not seg, last)
    yield (conv, seg, last, uids[1:] if seg else uids, costs, ranks, scripts,
           faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal)


def _choices(nodes: DataFrame, kind: T.DataType, fan: int) -> DataFrame:
    """(conv, at, entry, end) for every node (conv, at, costs, ranks) of conversations of several segments."""
    levels = [nodes]
    together = lambda df: df.groupBy("conv", F.floor(F.col("at") / fan).alias("up")).agg(F.array_sort(F.collect_list(F.struct("at", "costs", "ranks"))).alias("nodes"))
    made = lambda held: [Node(x["costs"], x["ranks"]) for x in held]

    def up(conv, at, held):
        node = chained(made(held))
        yield conv, at, node.costs, node.ranks

    def down(conv, held, entry, end):
        for x, (a, b) in zip(held, route(made(held), entry, end)):
            yield conv, x["at"], a, b

    most = (nodes.agg(F.max("at")).first()[0] or 0) + 1
    while most > 1:
        levels.append(stored(_mapped(together(levels[-1]), _fields(kind, f"at bigint, {_NODE}"), up), "chain"))
        most = -(-most // fan)
    chosen = levels[-1].select("conv", "at", F.lit(START).alias("entry"), F.lit(END).alias("end"))
    for level in reversed(levels[:-1]):
        above = chosen.select(F.col("conv").alias("c"), F.col("at").alias("u"), "entry", "end")
        pairs = together(level).join(above, F.col("conv").eqNullSafe(F.col("c")) & (F.col("up") == F.col("u")))
        chosen = stored(_mapped(pairs.select("conv", "nodes", "entry", "end"), _fields(kind, "at bigint, entry int, end int"), down), "chosen")
    return chosen


@dataclass
class Repair:
    """`edits`: (conv, uid, script) a row, the script of the rows inserted before it, of itself, and of those at the
    end. `rows`: the rows before the repair. `counts`: (conv, blank, duplicate, truncated, illegal, cost)."""

    rows: DataFrame
    edits: DataFrame
    counts: DataFrame

    def lines(self) -> DataFrame:
        """(conv, uid, at, role, text, edit) of the repaired conversations, in the order of uid and at."""
        each = self._joined().select("conv", "uid", "role", "text", F.posexplode(F.split("script", "")).alias("at", "e")).where("e <> '' AND e <> 'D'")
        given = F.when(F.lower("e") == "u", "user").when(F.lower("e") == "a", "assistant").otherwise(F.col("role"))
        return each.select("conv", "uid", "at", given.alias("role"), F.when(F.col("e").isin("u", "a"), "").otherwise(F.col("text")).alias("text"),
                           F.translate("e", "uaUA", "IIRR").alias("edit"))

    def _joined(self) -> DataFrame:
        return self.edits.select(F.col("uid").alias("u"), "script").join(self.rows.select("conv", "uid", "role", "text"), F.col("u") == F.col("uid")).drop("u")

    def digests(self) -> DataFrame:
        """(conv, audit, repaired_sha256): the edits of a conversation and the hash of its repaired `role:text` lines."""
        kind = self.rows.schema["conv"].dataType
        schema = _fields(kind, "audit string, repaired_sha256 string")
        parts = int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        sorted_rows = self._joined().select("conv", "uid", "script", "role", "text").repartition(parts, "conv").sortWithinPartitions("conv", "uid")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, audit, digest, empty = None, [], None, True
            done: list[tuple] = []
            for batch in batches:
                convs, scripts = batch.column(0).to_pylist(), batch.column(2).to_pylist()
                for i, (conv, script) in enumerate(zip(convs, scripts)):
                    if digest is None or conv != held:
                        if digest is not None:
                            done.append((held, "".join(audit), digest.hexdigest()))
                        held, audit, digest, empty = conv, [], hashlib.sha256(), True
                    audit.append(audit_of(script))
                    for e in script:
                        if e == "D":
                            continue
                        role = "user" if e in "uU" else "assistant" if e in "aA" else batch.column(3)[i].as_py()
                        digest.update(f"{'' if empty else chr(10)}{role}:".encode("utf-8", "surrogatepass"))
                        if e in "KUA":
                            digest.update(batch.column(4)[i].as_py().encode("utf-8", "surrogatepass"))
                        empty = False
                if done:
                    yield _batch(schema.fields, list(map(list, zip(*done))))
                    done = []
            if digest is not None:
                yield _batch(schema.fields, [[held], ["".join(audit)], [digest.hexdigest()]])

        return arrow(sorted_rows, run, schema)


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           segment: int = SEGMENT, fan: int = FAN) -> Repair:
    """The cheapest repair of every conversation of `rows`.

    Null roles and texts are one space, so such a text is blank and such a role none of the three;
    a null `conv` is a conversation of its own; null turns come first; repeated rows are duplicates.
    Other columns play no part. An empty table has no conversations. The audit of a conversation is
    one string, so a conversation may have 2^31 rows at most.
    """
    kind = rows.schema[conv].dataType
    table = ordered_rows(rows, conv, turn, role, text)
    found = stored(_mapped(_segments(table, segment), _fields(kind, f"seg bigint, last boolean, uids array<bigint>, {_NODE}, scripts array<string>, blank bigint, duplicate bigint, truncated bigint, illegal bigint"), _search_segment), "segments")
    alone = (F.col("seg") == 0) & F.col("last")
    ways = _choices(found.where(~alone).select("conv", F.col("seg").alias("at"), "costs", "ranks"), kind, fan)
    ways = ways.select(F.col("conv").alias("c"), F.col("at").alias("s"), (F.col("entry") * 5 + F.col("end") + 1).alias("place"))
    placed = found.where(alone).withColumn("place", F.lit(END + 1)).unionByName(
        found.where(~alone).join(ways, F.col("conv").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s"))).drop("c", "s"))
    chosen = placed.select("conv", "uids", "blank", "duplicate", "truncated", "illegal", F.element_at("scripts", F.col("place")).alias("script"),
                           F.element_at("costs", F.col("place")).alias("cost"))
    # the script of a row is what stands before it and its own edit; the last row of all also has what is inserted behind it
    each = F.regexp_extract_all("script", F.lit("[ua]*[DKUA](?:[ua]+$)?"), 0)
    edits = chosen.select("conv", F.explode(F.arrays_zip(F.col("uids").alias("uid"), each.alias("script"))).alias("e")).select("conv", "e.uid", "e.script")
    counts = chosen.groupBy("conv").agg(*[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")])
    return Repair(table, edits, counts)


def damage(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with the faults of the contract, told by a CRC-32 of `conv:turn`; nulls are one space."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    way = F.crc32(key.cast("binary")) % 20
    said, by = F.coalesce(F.col(text), blank), F.coalesce(F.col(role), blank)
    said = F.when(way == 1, "").when(way == 2, F.translate(said, ".!?", "")).otherwise(said)
    copies = F.when(way == 0, 0).when(way == 3, 2).otherwise(1)
    return rows.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), F.when(way == 4, "user").otherwise(by).alias("role"), said.alias("text"),
                       F.explode(F.array_repeat(F.lit(0), copies)).alias("copy")).drop("copy")


def damaged_repairs(conversations: DataFrame, segment: int = SEGMENT, fan: int = FAN) -> DataFrame:
    """One row of the contract for every conv_id of `conversations`, damaged first."""
    done = repair(damage(conversations), "conv", "turn", "role", "text", segment, fan)
    by_turn = done.rows.groupBy("conv", "turn").agg(F.count(F.lit(1)).alias("n"))
    wide = F.max("turn").cast("decimal(20,0)") - F.min("turn").cast("decimal(20,0)") + 1 - F.count("turn")
    most = F.lit((1 << 63) - 1).cast("decimal(20,0)")
    gaps = by_turn.groupBy("conv").agg(F.coalesce(F.when(wide > most, most).otherwise(wide).cast("bigint"), F.lit(0)).alias("gaps"))
    out = conversations.select("conv_id").distinct()
    for i, part in enumerate((gaps, done.counts, done.digests())):
        out = out.join(part.withColumnRenamed("conv", f"c{i}"), F.col("conv_id").eqNullSafe(F.col(f"c{i}")), "left").drop(f"c{i}")
    longs = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return out.select("conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in longs],
                      F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
