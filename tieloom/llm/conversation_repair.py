"""Repair of conversation structure at least cost.

Rows of a conversation get their first fault: blank, duplicate of an earlier row, or truncated. The
edits Keep (0), Rerole (2), Delete (3) and Insert (2) turn the rows into a sequence of roles
``(s?(ua)+)?``. They are arcs of a lattice: a node is a place between rows with what has been read
so far (nothing, a system turn, a user turn, an assistant turn), costs are small integers.

Cheapest edits come from the auction algorithm for shortest paths (``settle``). Every node has a
price, at first 0, never above its distance to the end. A path grows from an origin: if the price of
its last node is below the least cost-plus-price of its arcs, the price rises to it and the path
contracts by that node, else the path extends along an arc that attains it. A path that reaches
the end, or a node that an earlier path settled, has tight arcs only, so its prices are distances.
Origins are taken from the last place to the first, so the work is linear. The converged prices
are a dual solution: an arc is on a cheapest path just if it is tight, and following the tight arc of
the least letter at each node traces the least of all cheapest edits (``trace``). Edits of one node
have different letters and lead to known nodes, so the letters determine the repair.

A conversation of any length is cut: rows have global positions, and every ``SEGMENT`` positions
begin a segment. For a conversation of several segments, each gives the distances from its entry
states to its exit states; these 4 x 4 tables are folded from the last segment to the first, which
gives the prices at all cuts; each segment is then traced from every entry state, and the entry
states follow from the first segment on. Only one byte of a row takes part in this. The digest of
the repaired text, one hash over a whole conversation, reads its rows as a sorted stream, and the
audit is one value of a result row: both are the result as defined, not a choice.

Null ids are one conversation; other nulls count as one space, null turns come first, and rows of one
turn are ordered by role and text as they were before the damage. Repeated rows are duplicates.
A conversation without rows has cost 0, an empty audit and the digest of nothing. Texts may be empty or of any
length. Further columns are ignored, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tieloom.llm.positions import SPACE, placed
from tieloom.staging import staged

SEGMENT = 4_096

# States: what the roles read so far end with.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_INSERTED = {NOTHING: ("u", USER), SYSTEM: ("u", USER), USER: ("a", ASSISTANT), ASSISTANT: ("u", USER)}
_KEPT = {("s", NOTHING): SYSTEM, ("u", NOTHING): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
_LEGAL = {"su", "ua", "au"}
#: Role initials of the codes of rows: kept as they are, truncated, to be deleted.
PLAIN, TRUNCATED, DOOMED = "osua", "OSUA", "0123"
_INITIAL = {code: initial for codes in (PLAIN, TRUNCATED, DOOMED) for code, initial in zip(codes, PLAIN, strict=True)}
FAR = 1 << 60

Arc = tuple[str, int, int, int]


def _arcs(code: str, state: int, inserting: bool = True) -> list[Arc]:
    """Letter, cost, step in rows and next state, by letter. ``code`` is empty behind the last row."""
    role, next_state = _INSERTED[state]
    out = []
    if code:
        out.append(("D", 3, 1, state))
    if inserting:
        out.append(("I", 2, 0, next_state))
    if code and code not in DOOMED:
        more = int(code in TRUNCATED)
        kept = _KEPT.get((_INITIAL[code], state))
        if kept is not None:
            out.append(("K", more, 1, kept))
        out.append(("R", 2 + more, 1, next_state))
    return out


_ARCS = {code: [_arcs(code, state) for state in range(4)] for code in PLAIN + TRUNCATED + DOOMED}
_LAST = [_arcs("", state) for state in range(4)]
_CUT = [_arcs("", state, inserting=False) for state in range(4)]


def settle(codes: str, exits: list[int], last: bool) -> list[int]:
    """Prices of all nodes, four a place: their distances to the end, given the prices behind it.

    ``last`` tells whether turns may be inserted behind the last row; elsewhere they are inserted
    before a row. ``FAR`` is the price of a node that has no way to the end.
    """
    n = len(codes)
    arcs = [arc for code in codes for arc in _ARCS[code]] + (_LAST if last else _CUT)
    price = [0] * (4 * (n + 1))
    settled = [False] * (4 * (n + 1))
    if not last and exits[USER] == exits[ASSISTANT] == FAR:  # no way back from these states: prices would rise for ever
        for node in range(4 * (n + 1)):
            if node & 3 >= USER:
                price[node], settled[node] = FAR, True
    for origin in range(4 * n + 3, -1, -1):
        if settled[origin]:
            continue
        path = [origin]
        while path:
            node = path[-1]
            place = node & ~3
            best, target = (exits[node - place], -1) if place == 4 * n else (FAR, -1)
            for _, cost, step, state in arcs[node]:
                to = place + 4 * step + state
                if cost + price[to] < best:
                    best, target = cost + price[to], to
            if price[node] < best:
                price[node] = best
                if best == FAR:
                    settled[node] = True
                    path.pop()
                elif len(path) > 1:
                    path.pop()
            elif target < 0 or settled[target]:
                for passed in path:
                    settled[passed] = True
                path = []
            else:
                path.append(target)
    return price


def trace(codes: str, exits: list[int], last: bool, price: list[int], entry: int) -> tuple[str, int, int]:
    """Letters of the least of the cheapest edits from an entry state, their cost and the exit state."""
    n, place, state, cost, letters = len(codes), 0, entry, 0, []
    while True:
        node = 4 * place + state
        rows = _ARCS[codes[place]] if place < n else _LAST if last else _CUT
        for letter, paid, step, following in rows[state]:
            if price[node] == paid + price[4 * (place + step) + following]:
                letters.append(letter)
                place, state, cost = place + step, following, cost + paid
                break
        else:
            return "".join(letters), cost, state


def distances(codes: str) -> list[int]:
    """From each entry state to each exit state of a segment that others follow, row by row."""
    columns = []
    for end in range(4):
        exits = [FAR] * 4
        exits[end] = 0
        columns.append(settle(codes, exits, False)[:4])
    return [columns[end][start] for start in range(4) for end in range(4)]


def edits(codes: str, letters: str, entry: int) -> list[list]:
    """Per row: roles inserted before it, its letter, its new role if any, roles inserted behind it."""
    state, before, out = entry, [], []
    for letter in letters:
        role, following = _INSERTED[state]
        role = "user" if role == "u" else "assistant"
        if letter == "I":
            before.append(role)
            state = following
            continue
        if letter == "K":
            state = _KEPT[_INITIAL[codes[len(out)]], state]
        elif letter == "R":
            state = following
        out.append([before, letter, role if letter == "R" else "", []])
        before = []
    out[-1][3] = before
    return out


def damaged(turns: DataFrame, kind: Column) -> DataFrame:
    """``turns`` (``conv_id, turn, role, text``) after a damage of the given ``kind`` per row.

    0 drops a row, 1 empties its text, 2 removes its ends of sentences, 3 repeats it, 4 makes it a user's;
    other kinds and null leave it. Nulls of role and text become one space. ``was_role`` and ``was_text`` order rows
    of one turn.
    """
    text = F.col("was_text")
    return (
        turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("was_role"), F.coalesce("text", F.lit(" ")).alias("was_text"), F.coalesce(kind, F.lit(-1)).alias("kind"))
        .where("kind != 0")
        .select(
            "conv_id", "turn", "was_role", "was_text",
            F.when(F.col("kind") == 4, "user").otherwise(F.col("was_role")).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))).alias("copy"),
        )
    )


def _id_key() -> Column:
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit(""))


def faults(rows: DataFrame) -> DataFrame:
    """Rows in order, with their position ``at`` and flags ``blank``, ``duplicate``, ``truncated``.

    The first of equal rows is found by a grouping that combines in the tasks that read; the rows of a
    digest that occurs once take no part in the join that follows.
    """
    rows = rows.withColumn("ck", _id_key())
    rows = placed(rows, "ck", "turn", "was_role", "was_text", "copy", drop=("was_role", "was_text", "copy"), name="turns")
    same = F.sha2(F.concat(F.length("ck").cast("string"), F.lit(":"), F.col("ck"), F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256)
    rows = rows.withColumns(
        {
            "same": same,
            "blank": ~F.col("text").rlike(f"[^{SPACE}]"),
            "open": ~F.col("text").rlike(f"[.!?][{SPACE}]*+\\z"),
            "initial": F.substring("role", 1, 1),
        }
    )
    first = rows.groupBy("same").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    return (
        rows.join(first, "same", "left")
        .withColumn("duplicate", ~F.col("blank") & later)
        .withColumn("truncated", ~F.col("blank") & ~F.col("duplicate") & F.col("open"))
        .drop("same", "first", "open")
    )


def _segments(flagged: DataFrame) -> DataFrame:
    """``ck, seg, first, codes, before, lo, hi``: codes of a conversation's rows in a segment, the initial before
    them, and the first and last segment of the conversation."""
    place = F.when(F.col("initial") == "", 1).otherwise(F.expr("locate(initial, 'sua')") + 1)
    codes = F.when(F.col("blank") | F.col("duplicate"), F.lit(DOOMED)).when(F.col("truncated"), F.lit(TRUNCATED)).otherwise(F.lit(PLAIN))
    seg = F.floor(F.col("at") / SEGMENT)
    own = flagged.select("ck", "at", F.substring(codes, place.cast("int"), F.lit(1)).alias("code"), seg.alias("seg"))
    # the last row of a segment is shown to the next, for the pair across the cut
    shown = own.select("ck", "at", "code", F.explode(F.when(F.col("at") % SEGMENT == SEGMENT - 1, F.array("seg", F.col("seg") + 1)).otherwise(F.array("seg"))).alias("seg"))
    mine = F.floor(F.col("at") / SEGMENT) == F.col("seg")
    listed = F.array_sort(F.collect_list(F.when(mine, F.struct("at", "code"))))
    grouped = (
        shown.groupBy("ck", "seg")
        .agg(F.min(F.when(mine, F.col("at"))).alias("first"), F.array_join(F.transform(listed, lambda r: r["code"]), "").alias("codes"), F.max(F.when(~mine, F.col("code"))).alias("before"))
        .where("first IS NOT NULL")
    )
    written = staged(grouped, "segments")
    return written.join(written.groupBy("ck").agg(F.min("seg").alias("lo"), F.max("seg").alias("hi")), "ck")


def _price_cuts(parts: DataFrame) -> DataFrame:
    """``exits``, the prices behind each segment, for conversations of several segments."""

    def tables(batches):
        for batch in batches:
            found = [distances(c.as_py()) for c in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int64()))], ["ck", "seg", "tables"])

    def fold(batches):
        current, exits = None, None
        for batch in batches:
            out = []
            for ck, table in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if ck != current:
                    current, exits = ck, [0, 4, 2, 0]  # what turns inserted behind the last row cost
                out.append(exits)
                exits = [min(min(FAR, table[4 * s + e] + exits[e]) for e in range(4)) for s in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.list_(pa.int64()))], ["ck", "seg", "exits"])

    made = parts.select("ck", "seg", "codes").mapInArrow(tables, "ck string, seg long, tables array<bigint>")
    return made.repartition("ck").sortWithinPartitions("ck", F.col("seg").desc()).mapInArrow(fold, "ck string, seg long, exits array<bigint>")


def _traced(parts: DataFrame) -> DataFrame:
    """Per segment and entry state, the letters, their cost and the exit state."""

    def run(batches):
        for batch in batches:
            out, illegal = [], []
            for codes, before, is_first, is_last, exits in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                exits = [0, FAR, FAR, 0] if is_last else exits
                price = settle(codes, exits, is_last)
                entries = [NOTHING] if is_first else range(4)
                out.append([dict(zip(("audit", "cost", "exit"), trace(codes, exits, is_last, price, e), strict=True)) for e in entries])
                roles = "".join(_INITIAL[c] for c in (before or "") + codes)
                illegal.append(sum(roles[i : i + 2] not in _LEGAL for i in range(len(roles) - 1)))
            kind = pa.list_(pa.struct([("audit", pa.string()), ("cost", pa.int64()), ("exit", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, kind), pa.array(illegal, pa.int64())], ["ck", "seg", "ways", "illegal"])

    return parts.select("ck", "seg", "codes", "before", (F.col("seg") == F.col("lo")).alias("is_first"), (F.col("seg") == F.col("hi")).alias("is_last"), "exits").mapInArrow(
        run, "ck string, seg long, ways array<struct<audit string, cost bigint, exit bigint>>, illegal long"
    )


def _entered(traced: DataFrame) -> DataFrame:
    """``entry`` of each segment of conversations of several segments."""

    def run(batches):
        current, state = None, NOTHING
        for batch in batches:
            out = []
            for ck, ends in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if ck != current:
                    current, state = ck, NOTHING
                out.append(state)
                state = ends[state]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], ["ck", "seg", "entry"])

    ends = traced.select("ck", "seg", F.transform("ways", lambda w: w["exit"]).alias("ends"))
    return ends.repartition("ck").sortWithinPartitions("ck", "seg").mapInArrow(run, "ck string, seg long, entry int")


def _edited(segments: DataFrame) -> DataFrame:
    """``at, inserted, letter, as_role, behind`` per row."""

    def run(batches):
        for batch in batches:
            out = ([], [], [], [], [])
            for first, codes, letters, entry in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for k, item in enumerate(edits(codes, letters, entry)):
                    for column, value in zip(out, (first + k, *item), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.list_(pa.string()), pa.string(), pa.string(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["at", "inserted", "letter", "as_role", "behind"])

    return segments.select("first", "codes", "audit", "entry").mapInArrow(run, "at long, inserted array<string>, letter string, as_role string, behind array<string>")


def _digests(lines: DataFrame) -> DataFrame:
    """``ck, repaired_sha256`` of lines (``ck, at, part, line``), joined by line ends in their order."""

    def run(batches):
        current, digest = None, None
        for batch in batches:
            done = []
            for ck, line in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if ck != current:
                    if digest is not None:
                        done.append((current, digest.hexdigest()))
                    current, digest = ck, hashlib.sha256(line.as_py().encode())
                else:
                    digest.update(b"\n" + line.as_py().encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*done, strict=True)], ["ck", "repaired_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([digest.hexdigest()])], ["ck", "repaired_sha256"])

    ordered = lines.repartition("ck").sortWithinPartitions("ck", "at", "part").select("ck", "line")
    return ordered.mapInArrow(run, "ck string, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repairs conversations (``conv_id, turn, role, text, was_role, was_text, copy``).

    The first table has a row per conversation: ``ck`` (a key of its id), ``gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256``. The second has the repaired turns: ``ck, at, part, role,
    text``, ordered by ``at`` and ``part``.
    """
    flagged = staged(faults(rows), "flagged")
    parts = staged(_segments(flagged), "parts")
    many = parts.where("lo < hi")
    cuts = _price_cuts(many)
    traced = staged(_traced(parts.join(cuts, ["ck", "seg"], "left")), "traced")
    chosen = parts.join(traced, ["ck", "seg"]).join(_entered(traced.join(many.select("ck", "seg"), ["ck", "seg"], "left_semi")), ["ck", "seg"], "left")
    chosen = chosen.withColumn("entry", F.coalesce("entry", F.lit(NOTHING))).withColumn("way", F.get("ways", F.col("entry")))
    chosen = staged(chosen.select("ck", "seg", "first", "codes", "entry", "illegal", "way.audit", "way.cost"), "chosen")

    empty = lambda roles: F.transform(roles, lambda r: F.struct(r.alias("role"), F.lit("").alias("text")))
    role = F.when(F.col("as_role") != "", F.col("as_role")).otherwise(F.col("role"))
    own = F.when(F.col("letter") == "D", F.array().cast("array<struct<role:string,text:string>>")).otherwise(F.array(F.struct(role.alias("role"), "text")))
    repaired = (
        flagged.select("ck", "at", "role", "text").join(_edited(chosen), "at")
        .select("ck", "at", F.posexplode(F.concat(empty("inserted"), own, empty("behind"))).alias("part", "turn")).select("ck", "at", "part", "turn.*")
    )

    counts = flagged.groupBy("ck").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        *[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")],
    )
    plans = chosen.groupBy("ck").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg", "audit"))), lambda s: s["audit"]), "").alias("audit"),
    )
    digests = _digests(repaired.select("ck", "at", "part", F.concat("role", F.lit(":"), "text").alias("line")))
    return counts.join(plans, "ck").join(digests, "ck", "left"), repaired


def damage_and_repair(turns: DataFrame, kind: Column) -> DataFrame:
    """``conv_id`` of every conversation of ``turns`` with the figures of its repair after damage."""
    turns = turns.select("conv_id", "turn", "role", "text")
    found, _ = repair(damaged(turns, kind))
    ids = turns.select("conv_id").distinct().withColumn("ck", _id_key())
    numbers = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return ids.join(found, "ck", "left").select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
