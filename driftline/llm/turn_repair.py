"""Conversation structure repair: cheapest edits by a Viterbi search that emits edits once all survivors share them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from driftline.llm._tables import Scratch

# Costs of edits, and what an undeleted truncated row adds.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
#: States of the roles so far: none, a system row, ends with user, ends with assistant.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: The state after the next user or assistant row; the pattern allows no other one.
AFTER = {EMPTY: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
#: States that the roles of a repaired conversation may end in, and inserts that lead there.
CLOSING = {EMPTY: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}
LEGAL = ("su", "ua", "au")
GOOD = "ok"
FORCED = ("blank", "duplicate")

_EDITS = "conv_id {id}, part int, step long, edit string, turn {turn}, role string, row_key string, fault string, illegal boolean, new_turn boolean, cost long"
_TRANSFERS = "conv_id {id}, part int, costs array<long>, ranks array<int>, last_initial string, last_turn {turn}"
_ENTRIES = "conv_id {id}, part int, start int, end int, is_last boolean, prev_initial string, prev_turn {turn}"


def _moves(initial: str, fault: str) -> list[list[tuple[int, str, tuple[int, ...], int]]]:
    """For each state the ways over one row: cost, letters, states of the inserts before the row, state after it."""
    late = TRUNCATED if fault == "truncated" else 0
    found: list[list[tuple[int, str, tuple[int, ...], int]]] = []
    for state in range(4):
        ways = [(DELETE, "D", (), state)]
        inserts: tuple[int, ...] = ()
        while fault not in FORCED:
            at, paid, letters = (inserts or (state,))[-1], INSERT * len(inserts), "I" * len(inserts)
            ways.append((paid + REROLE + late, letters + "R", inserts, AFTER[at]))
            kept = SYSTEM if initial == "s" and at == EMPTY else AFTER[at] if initial == {USER: "u", ASSISTANT: "a"}[AFTER[at]] else None
            if kept is not None:
                ways.append((paid + late, letters + "K", inserts, kept))
            if len(inserts) == (2 if state < USER else 1):
                break  # one more would only come back to a state that costs less
            inserts = (*inserts, AFTER[at])
        found.append(ways)
    return found


class _Edit:
    """A node of the tree of backpointers; `kids` and `held` are the references to it."""

    __slots__ = ("parent", "letter", "state", "row", "kids", "held")

    def __init__(self, parent: _Edit | None, letter: str, state: int, row: tuple | None):
        self.parent, self.letter, self.state, self.row, self.kids, self.held = parent, letter, state, row, [], False
        if parent is not None:
            parent.kids.append(self)


class Search:
    """The Viterbi search over the rows of one conversation, or of one piece of it that starts in state `start`.

    A survivor is the best way into a state: least cost, then least letters in ASCII. Ways into one state never start
    with one another, so letters are compared in full by the first that differs; survivors are kept in that order (their
    rank), so a tie of any length takes one comparison. Nodes that no survivor needs are released at once; the path that
    all survivors share is given out and forgotten, so what is held is the part that is still open. Where the last row
    decides a tie over the first one (rows of one role: K or D, by the parity of their number), all stays open: what is
    held then is bounded by the range that the piece lies in.
    """

    _known: dict[tuple[str, str], list] = {}

    def __init__(self, start: int = EMPTY):
        self.root = _Edit(None, "", start, None)
        self.root.held = True
        self.ways: dict[int, tuple[int, int, _Edit]] = {start: (0, 0, self.root)}

    def _move(self, best: dict[int, tuple], row: tuple | None) -> None:
        """Replaces the survivors by the ways in `best`: state -> (cost, rank, letters, inserts, node before)."""
        old, ranked = [w[2] for w in self.ways.values()], sorted(best, key=lambda z: best[z][1:3])
        self.ways = {}
        for rank, state in enumerate(ranked):
            cost, _, letters, inserts, node = best[state]
            for at in inserts:
                node = _Edit(node, "I", at, None)
            if row is not None:
                node = _Edit(node, letters[-1], state, row)
            self.ways[state] = (cost, rank, node)
        for node in old:
            node.held = False
        for _, _, node in self.ways.values():
            node.held = True
        for node in old:
            while not node.held and not node.kids and node.parent is not None:
                node.parent.kids.remove(node)
                node = node.parent

    def push(self, row: tuple, initial: str, fault: str) -> Iterator[_Edit]:
        """Takes one row; gives the edits that no later row can change."""
        moves = self._known.get((initial, fault))
        if moves is None:
            moves = self._known[initial, fault] = _moves(initial, fault)
        best: dict[int, tuple] = {}
        for state, (cost, rank, node) in self.ways.items():
            for paid, letters, inserts, after in moves[state]:
                way = (cost + paid, rank, letters, inserts, node)
                if after not in best or way[:3] < best[after][:3]:
                    best[after] = way
        # what can follow no row, or a system row, can follow an assistant row too; at most a system row is deleted then
        rival = best.get(ASSISTANT)
        if rival and EMPTY in best and rival[0] + DELETE < best[EMPTY][0]:
            del best[EMPTY]
        if rival and SYSTEM in best and rival[:3] < best[SYSTEM][:3]:
            del best[SYSTEM]
        self._move(best, row)
        return self._settled()

    def finish(self, end: int | None = None, closes: bool = True) -> Iterator[_Edit]:
        """The edits that are left, of the best way or of the one into state `end`; `closes`: with the last inserts."""
        ends = {z: (cost + (INSERT * len(CLOSING[z]) if closes else 0), rank, "I" * len(CLOSING[z]) if closes else "", CLOSING[z] if closes else (), node) for z, (cost, rank, node) in self.ways.items() if end in (None, z)}
        state = min(ends, key=lambda z: ends[z][:3])
        self._move({state: ends[state]}, None)
        node = self.ways[state][2]
        node.held = False
        return self._settled()

    def _settled(self) -> Iterator[_Edit]:
        while not self.root.held and len(self.root.kids) == 1:
            self.root = self.root.kids[0]
            self.root.parent = None
            yield self.root


def _initial(role: str) -> str:
    return role[:1] if role[:1] in ("s", "u", "a") else ""


def _narrow(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows with a null role or text as one space, the MD5 of the text and a key of all four columns."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    named = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).withColumn("digest", F.md5("text"))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    return named.withColumn("row_key", F.md5(F.concat_ws(":", *parts, F.md5("role"), "digest")))


def turn_faults(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The distinct rows without their texts: conv_id, turn, role, digest, row_key, copies, and `fault` of the first copy.

    The first that holds: blank (no `[^\\x20\\x09-\\x0D]`), duplicate (role and text stand in an earlier row), truncated (the
    last such character is none of `.!?`), else ok. Copies after the first are blank or duplicate. Equal rows are counted
    before they are shuffled, and the first of a role and text is a least value, so no group is put together.
    """
    named = _narrow(rows, id_col, turn_col, role_col, text_col)
    blank, ends = ~F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    keys = ["conv_id", "turn", "role", "digest", "row_key", "blank", "ends"]
    distinct = named.withColumn("blank", blank).withColumn("ends", ends).groupBy(*keys).agg(F.count("*").alias("copies"))
    first = distinct.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn", "row_key"))["row_key"].alias("row_key")).select("row_key", F.lit(True).alias("is_first"))
    fault = F.when(F.col("blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(~F.col("ends"), "truncated").otherwise(GOOD)
    return distinct.join(first, "row_key", "left").select("conv_id", "turn", "role", "digest", "row_key", "copies", fault.alias("fault"))


def _pieces(rows: DataFrame) -> DataFrame:
    return rows.repartition("conv_id", "part").sortWithinPartitions("conv_id", "part", "turn", "role", "digest")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(values, field.type) for values, field in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _groups(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """(conversation, part) and its rows, one after the other, from sorted batches; a group may span batches."""

    def flat() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in names], strict=True)

    source = flat()
    row = next(source, None)
    while row is not None:
        key = row[:2]

        def own(key: tuple = key) -> Iterator[tuple]:
            nonlocal row
            while row is not None and row[:2] == key:
                now, row = row, next(source, None)
                yield now

        mine = own()
        yield key, mine
        for _ in mine:
            pass


_ROW = ["conv_id", "part", "turn", "role", "row_key", "copies", "fault"]


def _faults_of(copies: int, fault: str) -> Iterator[str]:
    yield fault
    for _ in range(copies - 1):
        yield "blank" if fault == "blank" else "duplicate"


def _transfer(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """What a piece does to each state it may start in: cost and rank of the best way into each state."""
    for (conv, part), rows in _groups(batches, _ROW):
        searches, last, turn = [Search(s) for s in range(4)], None, None
        for _, _, turn, role, _, copies, fault in rows:
            last = _initial(role)
            for f in _faults_of(copies, fault):
                for s in searches:
                    for _ in s.push((), last, f):
                        pass
        none = (None, None, None)
        costs, ranks = ([s.ways.get(z, none)[k] for s in searches for z in range(4)] for k in (0, 1))
        yield _batch([(conv, part, costs, ranks, last, turn)], schema)


def _chain(pieces: list[dict]) -> list[tuple]:
    """The best way through the pieces of one conversation: where each starts and ends. One row a piece comes in."""
    pieces = sorted(pieces, key=lambda p: p["part"])
    # state -> (cost, rank, states after each piece)
    ways: dict[int, tuple[int, int, tuple]] = {EMPTY: (0, 0, ())}
    for piece in pieces:
        best: dict[int, tuple] = {}
        for state, (cost, rank, path) in ways.items():
            for after in range(4):
                paid, own = piece["costs"][4 * state + after], piece["ranks"][4 * state + after]
                if paid is not None:
                    way = (cost + paid, (rank, own), (path, after))
                    if after not in best or way[:2] < best[after][:2]:
                        best[after] = way
        order = sorted(best, key=lambda z: best[z][1])
        ways = {z: (best[z][0], k, best[z][2]) for k, z in enumerate(order)}
    last = min(ways, key=lambda z: (ways[z][0] + INSERT * len(CLOSING[z]), ways[z][1]))
    ends, path = [], ways[last][2]
    while path:
        path, state = path
        ends.append(state)
    out, before = [], {"last_initial": None, "last_turn": None}
    for k, (piece, end) in enumerate(zip(pieces, reversed(ends), strict=True)):
        out.append((piece["conv_id"], piece["part"], out[-1][3] if out else EMPTY, end, k == len(pieces) - 1, before["last_initial"], before["last_turn"]))
        before = piece
    return out


def _edit(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The edits of each piece, in order."""
    out: list[tuple] = []
    for (conv, part), rows in _groups(batches, [*_ROW, "start", "end", "is_last", "prev_initial", "prev_turn"]):
        search, step = None, 0

        def told(edits: Iterator[_Edit], conv: object = conv, part: int = part) -> Iterator[tuple]:
            nonlocal step
            for e in edits:
                step += 1
                if e.row is None:
                    yield (conv, part, step, "I", None, NAMES[e.state], None, None, False, False, INSERT)
                else:
                    turn, role, key, fault, illegal, new_turn = e.row
                    late = TRUNCATED if fault == "truncated" and e.letter != "D" else 0
                    paid = {"K": 0, "R": REROLE, "D": DELETE}[e.letter] + late
                    name = None if e.letter == "D" else NAMES[e.state] if e.letter == "R" else role
                    yield (conv, part, step, e.letter, turn, name, key, fault, illegal, new_turn, paid)

        for _, _, turn, role, key, copies, fault, start, end, is_last, before, turn_before in rows:
            initial = _initial(role)
            if search is None:
                search, ending, closes = Search(int(start)), end, is_last
                initial_before, last_turn = before, turn_before
            for f in _faults_of(copies, fault):
                illegal = initial_before is not None and initial_before + initial not in LEGAL
                fresh = turn is not None and turn != last_turn
                initial_before, last_turn = initial, turn
                out.extend(told(search.push((turn, role, key, f, illegal, fresh), initial, f)))
            if len(out) >= 10_000:
                yield _batch(out, schema)
                out = []
        out.extend(told(search.finish(None if ending is None else int(ending), bool(closes))))
    if out:
        yield _batch(out, schema)


def repair_edits(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The cheapest edits that give each conversation roles `(s?(ua)+)?`, one row an edit, in order of part and step.

    Columns: conv_id, part, step, edit (K keep, R rerole, D delete, I insert), turn, role (of the repaired row; null for
    D), text (likewise; '' for I), fault and illegal (of the row: whether it may not follow the one before it), new_turn,
    cost. Of edits that cost the same those whose letters are least in ASCII are taken.

    Rows are in order of turn (nulls first), then role, then the MD5 of the text. Only keys and faults are ordered,
    by ranges of all rows; a conversation that spans ranges is searched in pieces, from all four states, and the pieces
    are joined by one row each. Texts come in by key afterwards. A null role or text is one space; rows without a
    conversation are one conversation. An empty table gives none. Other columns are left out.
    """
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession)
    kinds = {"id": rows.schema[id_col].dataType.simpleString(), "turn": rows.schema[turn_col].dataType.simpleString()}
    shapes = {name: T.StructType.fromDDL(text.format(**kinds)) for name, text in (("transfers", _TRANSFERS), ("entries", _ENTRIES), ("edits", _EDITS))}
    arrow = {name: to_arrow_schema(shape) for name, shape in shapes.items()}
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    faults = turn_faults(rows, id_col, turn_col, role_col, text_col)
    ranged = scratch.write("ranged", faults.repartitionByRange(parts, "conv_id", "turn", "role", "digest").withColumn("part", F.spark_partition_id()))
    # a boundary of ranges cuts one conversation at most, so there are fewer cut ones than ranges
    cut = ranged.groupBy("conv_id").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select(F.col("conv_id").alias("cut_id"))
    of_cut = ranged.join(F.broadcast(cut), F.col("conv_id").eqNullSafe(F.col("cut_id"))).drop("cut_id")
    moved = _pieces(of_cut).mapInArrow(lambda batches: _transfer(batches, arrow["transfers"]), shapes["transfers"])
    entries = scratch.write("entries", moved.groupBy("conv_id").applyInArrow(lambda pieces: pa.Table.from_batches([_batch(_chain(pieces.to_pylist()), arrow["entries"])]), shapes["entries"]))
    keyed = F.broadcast(entries.withColumnsRenamed({"conv_id": "e_id", "part": "e_part"}))
    entered = ranged.join(keyed, F.col("conv_id").eqNullSafe(F.col("e_id")) & (F.col("part") == F.col("e_part")), "left")
    whole = entered.withColumn("start", F.coalesce("start", F.lit(EMPTY))).withColumn("is_last", F.coalesce("is_last", F.lit(True)))
    edits = scratch.write("edits", _pieces(whole.drop("e_id", "e_part")).mapInArrow(lambda batches: _edit(batches, arrow["edits"]), shapes["edits"]))
    texts = _narrow(rows, id_col, turn_col, role_col, text_col).groupBy("row_key").agg(F.first("text").alias("text"))
    spoken = edits.where("edit in ('K', 'R')").join(texts, "row_key")
    others = edits.where("edit in ('D', 'I')").withColumn("text", F.when(F.col("edit") == "I", ""))
    return spoken.unionByName(others).drop("row_key")


def repaired_turns(rows: DataFrame, **columns: str) -> DataFrame:
    """The rows of the repaired conversations: conv_id, part and step (their order), role, text."""
    return repair_edits(rows, **columns).where("edit != 'D'").select("conv_id", "part", "step", "role", "text")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of conversations damaged by crc32(`conv_id:turn`) % 20; a null counts as one space.

    0 drops the row, 1 empties its text, 2 takes its `[.!?]` away, 3 repeats it, 4 sets its role to user.
    """
    conv, turn = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    key = F.concat(conv, F.lit(":"), turn)
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    hit = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("hit")).where("hit != 0")
    changed = hit.withColumn("text", F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")))
    changed = changed.withColumn("role", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")))
    return changed.withColumn("hit", F.explode(F.sequence(F.lit(1), F.when(F.col("hit") == 3, 2).otherwise(1)))).drop("hit")


def repair_report(rows: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row for each conv_id of `conversations`: faults of its `rows`, cost and letters of the edits, and the SHA-256 of
    the repaired `role:text`, joined by line feeds. A conversation without rows has zeros, no letters and no text.

    The digest needs the repaired text of a conversation as one string; nothing else here does.
    """
    edits = repair_edits(rows)
    ids = conversations.select("conv_id").distinct().select("conv_id", *[F.lit(None).cast(edits.schema[c].dataType).alias(c) for c in edits.columns if c != "conv_id"])
    one = F.struct("part", "step", "edit", "role", "text")
    of = lambda fault: F.count(F.when(F.col("fault") == fault, 1)).alias(fault)
    span = F.max("turn") - F.min("turn") + 1 - F.count(F.when(F.col("new_turn"), 1))
    per = edits.unionByName(ids).groupBy("conv_id").agg(
        F.coalesce(span, F.lit(0)).cast("long").alias("gaps"), of("blank"), of("duplicate"), of("truncated"), F.count(F.when(F.col("illegal"), 1)).alias("illegal"),
        F.coalesce(F.sum("cost"), F.lit(0)).alias("cost"), F.array_sort(F.collect_list(F.when(F.col("edit").isNotNull(), one))).alias("edits"),
    )
    lines = F.transform(F.filter("edits", lambda e: e["edit"] != "D"), lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    return per.withColumn("audit", F.array_join(F.transform("edits", lambda e: e["edit"]), "")).withColumn("repaired_sha256", F.sha2(F.array_join(lines, "\n"), 256)).drop("edits")


SQL = r"""
WITH RECURSIVE tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, 3988292384 * (c & 1))) AS v FROM range(256) r(i))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
h AS (SELECT k.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda x: ord(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS hit FROM k, tab),
d AS (
  SELECT conv_id, turn, CASE WHEN hit = 4 THEN 'user' ELSE role END AS role, CASE hit WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM h, range(2) n(i) WHERE hit <> 0 AND i < CASE WHEN hit = 3 THEN 2 ELSE 1 END),
n AS MATERIALIZED (
  SELECT *, left(role, 1) AS r, row_number() OVER w AS i, lag(left(role, 1)) OVER w || left(role, 1) AS pair
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))),
o AS MATERIALIZED (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE 'ok' END AS fault FROM n),
v AS (
  SELECT conv_id, 0::BIGINT AS i, {'c': 0::BIGINT, 'a': '', 't': ''} AS v0, {'c': 1000000000::BIGINT, 'a': '', 't': ''} AS v1, {'c': 1000000000::BIGINT, 'a': '', 't': ''} AS v2, {'c': 1000000000::BIGINT, 'a': '', 't': ''} AS v3
  FROM (SELECT DISTINCT conv_id FROM o)
  UNION ALL
  SELECT conv_id, i,
    {'c': v0.c + 2, 'a': v0.a || 'D', 't': v0.t},
    list_min([{'c': v1.c + 2, 'a': v1.a || 'D', 't': v1.t}, {'c': v0.c + free + CASE WHEN r = 's' THEN 0 ELSE 1000000000 END, 'a': v0.a || 'K', 't': v0.t || own}]),
    list_min([{'c': v2.c + 2, 'a': v2.a || 'D', 't': v2.t}]
      || list_transform([v0, v1, x3], lambda s: {'c': s.c + free + 1, 'a': s.a || 'R', 't': s.t || chr(10) || 'user:' || text})
      || list_transform([v0, v1, x3], lambda s: {'c': s.c + free + CASE WHEN r = 'u' THEN 0 ELSE 1000000000 END, 'a': s.a || 'K', 't': s.t || own})),
    list_min([{'c': v3.c + 2, 'a': v3.a || 'D', 't': v3.t}, {'c': x2.c + free + 1, 'a': x2.a || 'R', 't': x2.t || chr(10) || 'assistant:' || text},
      {'c': x2.c + free + CASE WHEN r = 'a' THEN 0 ELSE 1000000000 END, 'a': x2.a || 'K', 't': x2.t || own}])
  FROM (
    SELECT *, list_min([v3, {'c': x2.c + 5, 'a': x2.a || 'I', 't': x2.t || chr(10) || 'assistant:'}]) AS x3 FROM (
      SELECT v.conv_id, o.i, o.r, o.text, chr(10) || o.role || ':' || o.text AS own, CASE o.fault WHEN 'ok' THEN 0 WHEN 'truncated' THEN 5 ELSE 1000000000 END AS free, v0, v1, v2, v3,
        list_min([v2] || list_transform([v0, v1, v3], lambda s: {'c': s.c + 5, 'a': s.a || 'I', 't': s.t || chr(10) || 'user:'})) AS x2
      FROM v JOIN o ON v.conv_id IS NOT DISTINCT FROM o.conv_id AND o.i = v.i + 1))),
e AS (
  SELECT conv_id, list_min([v0, v3, {'c': x2.c + 5, 'a': x2.a || 'I', 't': x2.t || chr(10) || 'assistant:'}]) AS b FROM (
    SELECT *, list_min([v2] || list_transform([v0, v1], lambda s: {'c': s.c + 5, 'a': s.a || 'I', 't': s.t || chr(10) || 'user:'})) AS x2
    FROM v JOIN (SELECT conv_id AS n_id, max(i) AS n FROM o GROUP BY 1) m ON v.conv_id IS NOT DISTINCT FROM n_id AND i = n)),
f AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM o GROUP BY 1)
SELECT a.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.c, 0)::BIGINT AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN f ON a.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN e ON a.conv_id IS NOT DISTINCT FROM e.conv_id
"""
