"""Repair of the order of turns in conversations, by parsing with a weighted grammar of edits.

The repaired roles must spell a word of a regular language, given by an automaton over role initials. Its grammar in
Chomsky normal form has a symbol ``X[p, q]`` for what leads from state ``p`` to state ``q``, the rules
``X[p, q] -> X[p, r] X[r, q]``, and for each turn the rules of its edits. An insertion takes no turn; so that every span
still begins and ends at turns, insertions are closed into the cells of single turns, on both sides.

A cell of a span holds, for each symbol, the least ``(cost, audit, roles)``. Cells are combined bottom-up by the length of
their spans. Every derivation of a span can be split after any of its turns, since ``r`` ranges over all states,
so all splits of a span give the same cell and one of them is enough: spans of 1, 2, 4, ... turns, a number of
combinations that is linear in the number of turns. Least audits combine to least audits: two audits of one span and one
cost differ within their common length, because an audit that continues another with insertions costs more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortlens.llm.common import pick
from cohortlens.session import materialize

# Costs of edits, the language ``(s?(ua)+)?`` of repaired role initials, roles an edit can give.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
MOVES = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, START, ACCEPT = range(4), 0, (0, 3)
ROLES = {"u": "user", "a": "assistant"}
LEGAL = ("su", "ua", "au")
# The six white-space characters of ASCII, and marks that end a sentence.
BLANKS, STOPS = " \t\n\x0b\x0c\r", ".!?"
# Kinds of turns: initial of the role (x: any other), a capital if truncated; d: has to go.
INITIALS = "suax"
# Turns up to which a whole conversation's result is remembered by its kinds, and how many of them.
SHORT, REMEMBERED = 24, 50_000

Cell = dict[tuple[int, int], tuple[int, str, str]]


# --- the grammar -----------------------------------------------------------------------------


def better(cell: Cell, symbol: tuple[int, int], value: tuple[int, str, str]) -> None:
    if symbol not in cell or value < cell[symbol]:
        cell[symbol] = value


def join(left: Cell, right: Cell) -> Cell:
    """The cell of a span from those of its two halves."""
    out: Cell = {}
    for p in STATES:
        for q in STATES:
            ways = [(r, left[p, r], right[r, q]) for r in STATES if (p, r) in left and (r, q) in right]
            if ways:
                least = min(a[0] + b[0] for _, a, b in ways)
                out[p, q] = min((least, a[1] + b[1], a[2] + b[2]) for _, a, b in ways if a[0] + b[0] == least)
    return out


def insertions() -> Cell:
    """The closure of insertions: the cell of a span without turns."""
    cell: Cell = {(p, p): (0, "", "") for p in STATES}
    for _ in STATES:  # no shortest way passes a state twice
        for (p, r), (cost, audit, roles) in list(cell.items()):
            for letter in ROLES:
                if (r, letter) in MOVES:
                    better(cell, (p, MOVES[r, letter]), (cost + INSERT, audit + "I", roles + letter))
    return cell


EMPTY = insertions()


def turn(kind: str) -> Cell:
    """The cell of one turn: its edits, with insertions before and after."""
    cell: Cell = {(p, p): (DELETE, "D", "") for p in STATES}
    if kind != "d":
        initial, more = kind.lower(), TRUNCATED if kind.isupper() else 0
        for (p, letter), q in MOVES.items():
            if letter == initial:
                better(cell, (p, q), (KEEP + more, "K", letter))
            if letter in ROLES:
                better(cell, (p, q), (REROLE + more, "R", letter))
    return join(join(EMPTY, cell), EMPTY)


TURNS = {kind: turn(kind) for kind in (*INITIALS, *INITIALS.upper(), "d")}


def parse(kinds: str) -> Cell:
    """The cell of a whole conversation, from spans of 1, 2, 4, ... turns."""
    cells = [TURNS[k] for k in kinds] or [EMPTY]
    while len(cells) > 1:
        cells = [join(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def repair(kinds: str) -> tuple[int, str, str]:
    """Cost, audit (initials of the edits in order) and role initials of the cheapest repair; of equal costs the least audit."""
    return _remembered(kinds) if len(kinds) <= SHORT else cheapest(parse(kinds))


@lru_cache(REMEMBERED)
def _remembered(kinds: str) -> tuple[int, str, str]:
    return cheapest(parse(kinds))


def cheapest(cell: Cell) -> tuple[int, str, str]:
    return min(cell[START, q] for q in ACCEPT if (START, q) in cell)


# --- jobs ------------------------------------------------------------------------------------


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, turn, role, text, copy)``: rows after damage that follows the CRC-32 of ``conv:turn`` modulo 20.

    0 drops a row, 1 empties its text, 2 removes the marks of :data:`STOPS`, 3 repeats it (``copy`` 0 and 1), 4 makes it
    the user's. A null role or text is one blank, and so is a null within ``conv:turn``.
    """
    blank = F.lit(" ")
    rows = pick(rows, conv=conv, turn=turn, role=role, text=text)
    name = F.concat(F.coalesce(F.col("conv").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.withColumn("damage", F.crc32(name) % 20).where("damage <> 0")
    own_role, own_text = F.coalesce("role", blank), F.coalesce("text", blank)
    return rows.select(
        "conv", "turn", F.when(F.col("damage") == 4, "user").otherwise(own_role).alias("role"),
        F.when(F.col("damage") == 1, "").when(F.col("damage") == 2, F.translate(own_text, STOPS, "")).otherwise(own_text).alias("text"),
        F.explode(F.when(F.col("damage") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def _digest(rows: DataFrame) -> DataFrame:
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    """Whole conversations in one task each, their rows in order; rows of one turn by role, digest of the text and copy."""
    order = ["conv", *first, F.col("turn").asc_nulls_first(), "role", "digest", "copy"]
    return rows.repartition("conv").sortWithinPartitions(*order)


def faults(rows: DataFrame) -> DataFrame:
    """``(conv, turn, role, digest, copy, kind, fault)``: the first fault of each row of ``(conv, turn, role, text, copy)``.

    1 blank (nothing but white space), 2 duplicate (role and text stood earlier in the conversation), 3 truncated (the last
    character that is not white space does not end a sentence), 0 none. ``kind`` is the initial's place in
    :data:`INITIALS`. Repeats are found by role and text, so that the rows of a conversation need not meet; blank rows,
    all alike, are spread.
    """
    rows = _digest(rows).withColumn("end", F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1)))
    rows = rows.withColumn("spread", F.when(F.col("end") == "", F.xxhash64("turn")).otherwise(0)).drop("text")
    alike = Window.partitionBy("conv", "role", "digest", "spread").orderBy(F.col("turn").asc_nulls_first(), "copy")
    fault = (
        F.when(F.col("end") == "", 1).when(F.row_number().over(alike) > 1, 2).when(~F.col("end").isin(*STOPS), 3).otherwise(0)
    )
    initial = F.array_position(F.array(*map(F.lit, INITIALS[:3])), F.substring("role", 1, 1))
    return rows.select(
        "conv", "turn", "role", "digest", "copy", F.when(initial > 0, initial - 1).otherwise(3).cast("int").alias("kind"), fault.cast("int").alias("fault")
    )


def parsed(rows: DataFrame) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, roles)`` of each conversation in ``(conv, turn, role, text, copy)``.

    A conversation is read in order as a stream, and one byte of each row is kept until its end.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    ordered = _in_order(faults(rows)).select("conv", "turn", (F.col("kind") * 4 + F.col("fault")).cast("byte").alias("code"))
    schema = f"conv {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, roles string"
    legal = np.zeros((4, 4), dtype=bool)
    for pair in LEGAL:
        legal[INITIALS.index(pair[0]), INITIALS.index(pair[1])] = True
    letters = [("d" if fault in (1, 2) else initial.upper() if fault == 3 else initial) for initial in INITIALS for fault in range(4)]
    letters = bytes.maketrans(bytes(range(16)), "".join(letters).encode())

    def told(conv, codes: bytes, gaps: int) -> tuple:
        code = np.frombuffer(codes, np.uint8)
        counts, initial = np.bincount(code % 4, minlength=4), code // 4
        cost, audit, roles = repair(codes.translate(letters).decode())
        return conv, gaps, int(counts[1]), int(counts[2]), int(counts[3]), int((~legal[initial[:-1], initial[1:]]).sum()), cost, audit, roles

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [batch_type, *[pa.int64()] * 6, pa.string(), pa.string()]

        def made(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        # The conversation that goes on: its key, codes so far, least, greatest and number of different turns.
        key, held, low, high, distinct = None, [], None, None, 0
        for batch in batches:
            done = []
            convs, code = batch.column(0), batch.column(2).to_numpy().astype(np.uint8)
            starts = _starts(convs)
            turns = batch.column(1).to_pylist()
            for at, stop in zip(starts, [*starts[1:], batch.num_rows]):
                own = convs[at].as_py()
                if held and own != key:
                    done.append(told(key, b"".join(held), high - low + 1 - distinct if distinct else 0))
                    held, low, high, distinct = [], None, None, 0
                key = own
                held.append(code[at:stop].tobytes())
                for t in turns[at:stop]:  # ascending, nulls first
                    if t is not None and t != high:
                        low, high, distinct = (t if distinct == 0 else low), t, distinct + 1
            if done:
                yield made(done)
        if held:
            yield made([told(key, b"".join(held), high - low + 1 - distinct if distinct else 0)])

    names = [part.split()[0] for part in schema.split(", ")]
    batch_type = _arrow_type(rows, "conv")
    return ordered.mapInArrow(run, schema)


def _arrow_type(rows: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(rows.schema[column].dataType)


def _starts(keys: pa.Array) -> list[int]:
    """Where runs of equal keys begin (nulls are equal)."""
    codes = keys.dictionary_encode("encode").indices.to_numpy()
    return np.flatnonzero(np.append(True, codes[1:] != codes[:-1])).tolist() if len(codes) else []


def repaired(rows: DataFrame, results: DataFrame) -> DataFrame:
    """``(conv, place, role, text)``: the turns of the repaired conversations, ``place`` counting from 0."""
    kind = rows.schema["conv"].dataType.simpleString()
    conv_type = _arrow_type(rows, "conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _turns(batches):
            if part:
                conv, place, role, text = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array(conv, conv_type), pa.array(place, pa.int64()), pa.array(role), pa.array(text)], names=["conv", "place", "role", "text"])

    return _beside(rows, results).mapInArrow(run, f"conv {kind}, place long, role string, text string")


def repaired_hashes(rows: DataFrame, results: DataFrame) -> DataFrame:
    """``(conv, repaired_sha256)``: SHA-256 of the repaired turns as ``role:text``, one to a line.

    A hash takes its text in order, so a conversation is one task's stream, of which it holds a batch of rows.
    """
    kind = rows.schema["conv"].dataType.simpleString()
    conv_type = _arrow_type(rows, "conv")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes: dict = {}  # of the conversation that goes on, and those that ended within a batch
        for part in _turns(batches):
            for conv, place, role, text in part:
                if place == 0:
                    hashes[conv] = hashlib.sha256()
                hashes[conv].update((("\n" if place else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            last = part[-1][0] if part else None
            done = [(c, h.hexdigest()) for c, h in hashes.items() if part and c != last]
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], conv_type), pa.array([h for _, h in done])], names=["conv", "repaired_sha256"])
                hashes = {c: h for c, h in hashes.items() if c == last}
        if hashes:
            yield pa.RecordBatch.from_arrays([pa.array(list(hashes), conv_type), pa.array([h.hexdigest() for h in hashes.values()])], names=["conv", "repaired_sha256"])

    return _beside(rows, results).mapInArrow(run, f"conv {kind}, repaired_sha256 string")


def _beside(rows: DataFrame, results: DataFrame) -> DataFrame:
    """Rows of each conversation in order, after a row with its audit and roles."""
    types = dict(rows.dtypes)
    heads = results.select(
        "conv", F.lit(None).cast(types["turn"]).alias("turn"), F.col("audit").alias("role"), F.col("roles").alias("text"), F.lit(0).alias("copy"), F.lit(0).alias("body")
    )
    both = heads.unionByName(rows.withColumn("body", F.lit(1)))
    return _in_order(_digest(both), "body").select("conv", "body", "role", "text")


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Repaired turns ``(conv, place, role, text)`` of each batch of :func:`_beside`; inserted turns come before the next row's or at the end."""
    key, audit, roles, at, place = None, "", "", 0, 0

    def inserted() -> Iterator[tuple]:
        nonlocal at, place
        while at < len(audit) and audit[at] == "I":
            yield key, place, ROLES[roles[place]], ""
            at, place = at + 1, place + 1

    for batch in batches:
        out: list[tuple] = []
        for conv, body, role, text in zip(*[batch.column(i).to_pylist() for i in range(4)]):
            if not body:
                key, audit, roles, at, place = conv, role, text, 0, 0
            else:
                edit = audit[at]
                at += 1
                if edit != "D":
                    out.append((key, place, role if edit == "K" else ROLES[roles[place]], text))
                    place += 1
            out += inserted()
        yield out


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)`` of every conversation, after :func:`damaged`.

    Rows of a conversation stand by turn, nulls first; rows of one turn by role, then digest of the text. ``gaps`` is the greatest less the
    least turn plus 1 less the number of different turns, 0 without turns; ``illegal`` counts neighbours whose role
    initials are not among :data:`LEGAL`. A row keeps its role at no cost, gets another for :data:`REROLE`, goes for
    :data:`DELETE` (blank and duplicate rows must), and a turn without text can be inserted anywhere for
    :data:`INSERT`; a truncated row that stays adds :data:`TRUNCATED`. A conversation without rows after damage has zeros, an empty
    audit and the hash of nothing. A null key is a conversation like any other; an empty table gives an empty result.
    """
    hurt = damaged(rows, conv, turn, role, text)
    found, every = parsed(hurt), pick(rows, key=conv).distinct()

    def count(name: str) -> Column:
        return F.coalesce(name, F.lit(0)).cast("long").alias(name)

    # Read twice, so worked out once.
    results = materialize(every.join(found, F.col("key").eqNullSafe(F.col("conv")), "left").select(
        F.col("key").alias("conv"), *[count(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("roles", F.lit("")).alias("roles"),
    ), "repairs")
    hashes = repaired_hashes(hurt, results).withColumnRenamed("conv", "__conv")
    out = results.drop("roles").join(hashes, F.col("conv").eqNullSafe(F.col("__conv")), "left").drop("__conv")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(nothing))).withColumnRenamed("conv", conv)
