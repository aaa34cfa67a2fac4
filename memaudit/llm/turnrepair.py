"""Repair of the structure of conversations by Wagner-Fischer alignment with an alternating grammar.

The roles of a repaired conversation read ``(s?(ua)+)?`` by their first letters. A row is kept (0), given the role user or
assistant (3) or deleted (4; blank and duplicate rows must be); an empty turn is inserted for 3; a truncated row that stays costs
3 more. Of the cheapest repairs the one whose audit (the edits' initials D, I, K, R in order) is least in ASCII is taken.

* Rows are pre-aggregated to distinct (conversation, turn, role, text) with their number, so copies never travel. A row's
  repeat under a later turn is found by a join with the first turn of each (conversation, role, text digest).
* The rows are range-partitioned by conversation, turn, role and text, which spreads one huge conversation over many tasks, and cut
  there into blocks of at most ``BLOCK`` rows and ``BLOCK_BYTES`` of text. What a grammar string has read before a block is one of
  four phases (nothing, s, u, a). For every phase before and after, the block's rows are aligned to each feasible length of the
  alternating string between the two: costs to the end of a string that ends in u or in a are filled into one table by what is
  left of it, in Ukkonen's bands: a string that is longer or shorter than the rows by more than the incumbent cost pays for is
  not filled in. The incumbent is the cost of a greedy repair, then the best length's so far. Each cheapest length is traced
  back, and the least audit is kept.
* The blocks of a conversation, in order, are joined phase by phase (a cost and an audit for each of at most four phases), and the
  repaired text is hashed on the way; a task holds one block and the open audits.

Defined results: null values are one space, but null turns are no turns for ``gaps`` and come first; rows of equal turn stand in the
order of role and text; the first letter of a role decides what it is in the grammar; a null conversation id is a conversation;
a conversation without rows has zeros and an empty audit; texts are read whole; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: ``[^\\x20\\x09-\\x0D]``: a visible character.
BLANK = "\x20\x09\x0a\x0b\x0c\x0d"
KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
BLOCK, BLOCK_BYTES = 64, 4 << 20
NONE, SYSTEM, USER, ASSISTANT = range(4)
FAR = 1 << 60
ROLE = {"u": "user", "a": "assistant"}


# --- rows ---------------------------------------------------------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) after the damage that the contract plants; dropped rows have no copies."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.pmod(F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))), F.lit(20))
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(said("text"), "[.!?]", "")).otherwise(said("text"))
    return rows.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(said("role")).alias("role"), text.alias("text"),
                       F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"))


def judged(rows: DataFrame) -> DataFrame:
    """Distinct rows with their number, what is wrong with the first of them (``fault``), and the text's digest."""
    alike = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    at = F.struct(F.col("turn").isNotNull().alias("numbered"), F.col("turn"))
    first = (alike.where(F.col("copies") > 0).groupBy(F.col("conv_id").alias("of"), F.col("role").alias("by"), F.col("digest").alias("said"))
             .agg(F.min(at).alias("first")))
    here = alike["conv_id"].eqNullSafe(first["of"]) & (alike["role"] == first["by"]) & (alike["digest"] == first["said"])
    visible = F.rtrim(F.col("text"), F.lit(BLANK))
    end = F.substring(visible, -1, 1)
    fault = (F.when(visible == "", "blank").when(at != F.col("first"), "duplicate")
             .when(~end.isin(".", "!", "?"), "truncated"))
    return alike.join(first, here, "left").select("conv_id", "turn", "role", "text", "copies", fault.alias("fault"))


# --- one block ----------------------------------------------------------------------------------------------

def _greedy(rows: list[tuple[str, str | None]], phase: int, last: int) -> int:
    """The cost of one repair from ``phase`` to ``last``: put in the turn that lacks before a row, rerole a row that is neither."""
    cost = 0
    for letter, fault in rows:
        if fault in ("blank", "duplicate"):
            cost += DELETE
            continue
        cost += CUT if fault else 0
        if phase == NONE and letter == "s":
            phase = SYSTEM
            continue
        due = ASSISTANT if phase == USER else USER
        phase = {"u": USER, "a": ASSISTANT}.get(letter, due)
        cost += REROLE if letter not in ("u", "a") else KEEP if phase == due else INSERT
    if phase != last:
        cost += INSERT if phase == USER or last == USER else 2 * INSERT
    return cost


class _Table:
    """Least costs of aligning the rows from the ``i``-th on with the last ``r`` turns of an alternating string that ends in ``end``.

    ``E[i][r - low(i)]``, filled for the band of r that ``budget`` pays for. With ``lead`` an s stands before those turns."""

    def __init__(self, rows: list[tuple[str, str | None]], end: str, budget: int):
        self.rows, self.end, n = rows, end, len(rows)
        more, less = budget // INSERT, budget // DELETE
        self.low = [max(0, n - i - less) for i in range(n + 1)]
        self.high = [n - i + more for i in range(n + 1)]
        other = "u" if end == "a" else "a"
        self.cost: list[list[int]] = [[]] * n + [[INSERT * r for r in range(self.high[n] + 1)]]
        for i in range(n - 1, -1, -1):
            letter, fault = rows[i]
            must, cut = fault in ("blank", "duplicate"), CUT if fault else 0
            below, under, row = self.cost[i + 1], self.low[i + 1], []
            step = {x: cut + (KEEP if letter == x else REROLE) for x in "ua"}
            for r in range(self.low[i], self.high[i] + 1):
                best = FAR
                if 0 <= r - under < len(below):
                    best = DELETE + below[r - under]
                if not must and 0 < r and 0 <= r - 1 - under < len(below):
                    best = min(best, step[end if r % 2 else other] + below[r - 1 - under])
                if row and r:
                    best = min(best, INSERT + row[-1])
                row.append(best)
            self.cost[i] = row
        # an s before the string stands on a kept s row; the rows before that one are deleted
        self.lead: dict[int, list[int]] = {}

    def at(self, i: int, r: int) -> int:
        k = r - self.low[i]
        return self.cost[i][k] if 0 <= k < len(self.cost[i]) else FAR

    def lead_costs(self, r: int) -> list[int]:
        """For each i the cost of aligning the rows from i on with an s and ``r`` turns."""
        if r not in self.lead:
            out = [FAR] * (len(self.rows) + 1)
            for i in range(len(self.rows) - 1, -1, -1):
                letter, fault = self.rows[i]
                out[i] = DELETE + out[i + 1]
                if letter == "s" and fault in (None, "truncated"):
                    out[i] = min(out[i], (CUT if fault else 0) + self.at(i + 1, r))
            self.lead[r] = out
        return self.lead[r]

    def trace(self, r: int, lead: bool = False) -> str:
        """The least audit among those of least cost."""
        out, i, n = [], 0, len(self.rows)
        other = "u" if self.end == "a" else "a"
        while lead:
            costs = self.lead_costs(r)
            if costs[i] == DELETE + costs[i + 1]:
                out.append("D")
            else:
                out.append("K")
                lead = False
            i += 1
        while i < n or r:
            now = self.at(i, r)
            if i < n and now == DELETE + self.at(i + 1, r):
                out.append("D")
                i += 1
            elif r and now == INSERT + self.at(i, r - 1):
                out.append("I")
                r -= 1
            else:
                out.append("K" if self.rows[i][0] == (self.end if r % 2 else other) else "R")
                i, r = i + 1, r - 1
        return "".join(out)


@lru_cache(maxsize=4096)  # most blocks are a few sound turns in one of a few orders
def align(rows: tuple[tuple[str, str | None], ...]) -> dict[tuple[int, int], tuple[int, str]]:
    """{(phase before, phase after): (cost, audit)} of the cheapest repairs of rows (first letter of the role, fault)."""
    n = len(rows)
    gone = (DELETE * n, "D" * n)
    paths = {(p, p): gone for p in range(4)}
    incumbent = {(p, q): _greedy(rows, p, q) for p in range(4) for q in (USER, ASSISTANT)}
    for q, end in ((USER, "u"), (ASSISTANT, "a")):
        table = _Table(rows, end, max(incumbent[p, q] for p in range(4)))
        for p in range(4):
            best = paths.get((p, q), (FAR, ""))
            cost = min(best[0], incumbent[p, q])
            # after a user turn an assistant turn comes; the length's parity follows from the first and the last turn
            odd = (p == USER) == (q == ASSISTANT)
            for lead in ([False, True] if p == NONE else [False]):
                for r in range(1 if odd else 2, n + cost // INSERT + 1, 2):
                    if DELETE * (n - r - lead) > cost or INSERT * (r + lead - n) > cost:
                        continue
                    found = table.lead_costs(r)[0] if lead else table.at(0, r)
                    if found < FAR and found <= cost:
                        cost = found
                        best = min(best, (found, table.trace(r, lead)))
            paths[p, q] = best
    # an s alone, or s rows before anything else was read
    table = _Table(rows, "a", DELETE * n)
    if table.lead_costs(0)[0] < FAR:
        paths[NONE, SYSTEM] = (table.lead_costs(0)[0], table.trace(0, True))
    return paths


def _with_copies(audit: str, copies: list[int]) -> str:
    """The audit with the copies of each row deleted after it; that is the least place for them."""
    if max(copies) == 1:
        return audit
    left = iter(copies)
    return "".join(edit if edit == "I" else edit + "D" * (next(left) - 1) for edit in audit)


def repaired(rows: list[dict], audit: str, phase: int) -> list[str]:
    """The turns ``role:text`` that an audit makes of a block's rows (role, text, copies) after ``phase``."""
    out, at, copy = [], 0, 0
    for edit in audit:
        row = rows[at] if at < len(rows) else None
        if edit == "I" or edit != "D" and not (edit == "K" and phase == NONE and row["role"][:1] == "s"):
            phase = ASSISTANT if phase == USER else USER
        elif edit != "D":
            phase = SYSTEM
        role = ROLE["a" if phase == ASSISTANT else "u"]
        if edit == "I":
            out.append(role + ":")
            continue
        if edit != "D":
            out.append((row["role"] if edit == "K" else role) + ":" + row["text"])
        copy += 1
        if copy == row["copies"]:
            at, copy = at + 1, 0
    return out


# --- blocks of a partition ----------------------------------------------------------------------------------

BLOCKS = """at struct<numbered: boolean, turn: bigint, role: string, text: string>, rows array<struct<role: string, text: string, copies: bigint>>,
    paths array<struct<before: int, after: int, cost: bigint, audit: string>>, turns bigint, first_turn bigint, last_turn bigint,
    blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_letter string, last_letter string"""
REPAIRS = """gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string,
    n_rows bigint, n_blocks bigint"""
LEGAL = {"su", "ua", "au"}


def _by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, its rows as tuples of the other columns), one after the other; rows come in order."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
    return ((conv, (row[1:] for row in part)) for conv, part in groupby(rows, lambda row: row[0]))


def _batches(rows: Iterator[dict], schema: pa.Schema, most: int = 256) -> Iterator[pa.RecordBatch]:
    """Rows as record batches; a batch is cut after ``BLOCK_BYTES`` of text."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(r["text"]) for r in row.get("rows", ()))
        if len(held) == most or size > BLOCK_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema=schema)


def _cut(rows: Iterator[tuple], size: int) -> Iterator[list[tuple]]:
    """Rows (turn, role, text, copies, fault) that were not dropped, in blocks."""
    held, chars = [], 0
    for row in rows:
        if row[3]:
            held.append(row)
            chars += len(row[2])
        if len(held) == size or chars > BLOCK_BYTES:
            yield held
            held, chars = [], 0
    if held:
        yield held


def _block(conv, rows: list[tuple]) -> dict:
    """What the join of a conversation's blocks needs; copies after the first are duplicates, or blank like it."""
    count = {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, _, _, copies, fault in rows:
        count["blank" if fault == "blank" else "duplicate"] += copies - 1
        if fault:
            count[fault] += 1
    letters, copies = [r[1][:1] for r in rows], [r[3] for r in rows]
    turns = [t for t, _ in groupby(r[0] for r in rows if r[0] is not None)]
    # a role after itself is never legal
    illegal = sum(copies) - len(rows) + sum(a + b not in LEGAL for a, b in zip(letters, letters[1:]))
    more = DELETE * (sum(copies) - len(rows))
    paths = [{"before": p, "after": q, "cost": cost + more, "audit": _with_copies(audit, copies)}
             for (p, q), (cost, audit) in align(tuple(zip(letters, (r[4] for r in rows)))).items() if cost < FAR]
    turn, role, text, _, _ = rows[0]
    return {"conv_id": conv, "at": {"numbered": turn is not None, "turn": turn, "role": role, "text": text}, "rows": [{"role": r[1], "text": r[2], "copies": r[3]} for r in rows],
            "paths": paths, "turns": len(turns), "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, **count,
            "illegal": illegal, "first_letter": letters[0], "last_letter": letters[-1]}


class _Open:
    """The cheapest repair of the blocks so far that ends in one phase; ``audit`` goes on from what is settled for all phases."""

    def __init__(self, cost: int, audit: str, sha, begun: bool):
        self.cost, self.audit, self.sha, self.begun = cost, audit, sha, begun

    def after(self, path: dict, rows: list[dict], settled: bool) -> "_Open":
        sha, turns = self.sha.copy(), repaired(rows, path["audit"], path["before"])
        for i, turn in enumerate(turns):
            sha.update(("\n" if self.begun or i else "").encode() + turn.encode())
        return _Open(self.cost + path["cost"], path["audit"] if settled else self.audit + path["audit"], sha, self.begun or bool(turns))


def _join(conv, blocks: Iterator[tuple]) -> dict:
    """One conversation from its blocks in order."""
    open_, settled = {NONE: _Open(0, "", hashlib.sha256(), False)}, []
    total = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
    n_rows = n_blocks = turns = 0
    first = last = letter = None
    for _, rows, paths, n_turns, first_turn, last_turn, blank, duplicate, truncated, illegal, first_letter, last_letter in blocks:
        if not rows:
            continue
        n_blocks += 1
        n_rows += sum(r["copies"] for r in rows)
        turns += n_turns - (n_turns > 0 and last == first_turn)
        first, last = first_turn if first is None else first, last if last_turn is None else last_turn
        illegal += letter is not None and letter + first_letter not in LEGAL
        letter = last_letter
        for key, more in zip(total, (blank, duplicate, truncated, illegal)):
            total[key] += more
        best: dict[int, dict] = {}
        for path in paths:
            if path["before"] in open_:
                rank = lambda p: (open_[p["before"]].cost + p["cost"], open_[p["before"]].audit + p["audit"])
                if path["after"] not in best or rank(path) < rank(best[path["after"]]):
                    best[path["after"]] = path
        parents = {path["before"] for path in best.values()}
        if len(parents) == 1:  # what all open repairs share can no longer change
            settled.append(open_[parents.pop()].audit)
            parents = set()
        open_ = {phase: open_[path["before"]].after(path, rows, not parents) for phase, path in best.items()}
    end = min((open_[p] for p in (NONE, ASSISTANT) if p in open_), key=lambda o: (o.cost, o.audit))
    return {"conv_id": conv, "gaps": last - first + 1 - turns if turns else 0, **total, "cost": end.cost, "audit": "".join(settled) + end.audit,
            "repaired_sha256": end.sha.hexdigest(), "n_rows": n_rows, "n_blocks": n_blocks}


def repair(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row per conversation of ``judged`` rows, dropped ones included."""
    conv = [T.StructField("conv_id", rows.schema["conv_id"].dataType)]
    blocks_schema, out_schema = (T.StructType(conv + T._parse_datatype_string(s).fields) for s in (BLOCKS, REPAIRS))
    blocks_arrow, out_arrow = to_arrow_schema(blocks_schema), to_arrow_schema(out_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def blocks():
            for conv_id, part in _by_conversation(batches):
                yield {"conv_id": conv_id, "rows": []}  # a conversation may have lost all its rows
                for held in _cut(part, block):
                    yield _block(conv_id, held)
        yield from _batches(blocks(), blocks_arrow)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((_join(conv_id, part) for conv_id, part in _by_conversation(batches)), out_arrow)

    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    dealt = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", "copies", "fault")
    blocks = dealt.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, blocks_schema)
    return blocks.repartition("conv_id").sortWithinPartitions("conv_id", F.col("at").asc_nulls_first()).mapInArrow(join, out_schema)
