"""Operator 12, conversation structure repair by a run-length dynamic program.

Each row of a conversation is a symbol: its role's initial (s, u, a or another) and whether
its text is cut off, or one symbol for a row that must go (blank or a duplicate). A repaired
conversation is empty or ``s?(ua)+`` by its initials. Four states say what has been given out:
nothing, an s, a u, an a. A symbol's transition is a 4 x 4 matrix over (min, +):
insertions before the row, then the cheapest of keep (0), rerole (3), delete (4); keeping
or reroling a cut-off row costs 3 more. Equal consecutive symbols are one run, which is
advanced by the binary powers of its matrix, cached. Costs to the end are known before
every row then, and the choices are unrolled forwards: at each place the ASCII-least edit
that is still cheapest (each edit leads to one state, so that is the least audit).

Conversations are not grouped. Rows are range partitioned on (conversation, turn, role, text)
and cut into segments of neighbouring rows of one conversation, bounded in rows and
bytes. A conversation inside one partition's segment is repaired at once. Of those that go
on beyond a segment, three small tables are made: texts that an earlier segment already had,
by first segment; costs to the end at each segment's end, backwards over the segments'
matrices; the state at each segment's start, forwards over what a segment makes of each of
the four states. Then their segments are repaired apart too. ``repair`` gives pieces, one a
segment, with their repaired rows; ``summary`` folds a conversation's pieces in order, in a
stream: its hash is sequential by nature, its memory is one piece.

Edge cases. Null role or text: one space (so a null text is blank). Null turn: before all
turns. Null conversation: a conversation of its own. Rows of equal turn: by role, the first 64
characters of the text, then the text's hash; equal rows are duplicates of the first. Other
roles (or an empty one) can only be reroled or deleted. Empty table: no rows. Extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, written

#: Bounds of a segment.
SEGMENT_ROWS, SEGMENT_BYTES = 1024, 1 << 20
#: Costs of the edits, and of a cut-off row that stays.
RETAG, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
FAR = 1 << 50  # no way

#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Where each initial leads.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: The only user or assistant that each state can take, by insertion or rerole.
GIVEN = ("user", "user", "assistant", "user")
STEP = tuple(NEXT[i][GIVEN[i][0]] for i in range(4))
MUST_GO = "-"
BLANK = " \t\n\x0b\x0c\r"


def times(a: tuple, b: tuple) -> tuple:
    """Product of two matrices over (min, +)."""
    return tuple(tuple(min(x + b[k][j] for k, x in enumerate(row)) for j in range(4)) for row in a)


def apply(a: tuple, v: tuple) -> tuple:
    return tuple(min(x + v[k] for k, x in enumerate(row)) for row in a)


ONE = tuple(tuple(0 if i == j else FAR for j in range(4)) for i in range(4))


def _insertions() -> tuple:
    once = tuple(tuple(0 if i == j else INSERT if j == STEP[i] else FAR for j in range(4)) for i in range(4))
    return times(times(once, once), times(once, once))


INSERTED = _insertions()
#: Cost to the end where no row is left.
END = apply(INSERTED, (0, FAR, FAR, 0))


@lru_cache(maxsize=None)
def transition(symbol: str) -> tuple:
    """Matrix of one row: insertions before it, then its own edit. A symbol is MUST_GO, or an
    initial with "!" behind it if the row is cut off."""
    row = [[FAR] * 4 for _ in range(4)]
    late = CUT_OFF if symbol.endswith("!") else 0
    for i in range(4):
        row[i][i] = DELETE
        if symbol != MUST_GO:
            row[i][STEP[i]] = min(row[i][STEP[i]], RETAG + late)
            if symbol[0] in NEXT[i]:
                j = NEXT[i][symbol[0]]
                row[i][j] = min(row[i][j], late)
    return times(INSERTED, tuple(map(tuple, row)))


@lru_cache(maxsize=None)
def binary_power(symbol: str, k: int) -> tuple:
    """Matrix of 2^k rows of one symbol."""
    if k == 0:
        return transition(symbol)
    half = binary_power(symbol, k - 1)
    return times(half, half)


def run_lengths(symbols: list[str]) -> list[tuple[str, int]]:
    return [(s, sum(1 for _ in same)) for s, same in groupby(symbols)]


def matrix(symbols: list[str]) -> tuple:
    """Matrix of all symbols in order."""
    out = ONE
    for symbol, n in run_lengths(symbols):
        for k in range(n.bit_length()):
            if n >> k & 1:
                out = times(out, binary_power(symbol, k))
    return out


def before(symbol: str, n: int, v: tuple) -> tuple:
    """Costs to the end before ``n`` rows of one symbol, from those after them."""
    for k in range(n.bit_length()):
        if n >> k & 1:
            v = apply(binary_power(symbol, k), v)
    return v


def unroll(symbols: list[str], start: int, after: tuple, last: bool) -> tuple[str, int, int]:
    """(audit, cost, state at the end) of the rows from state ``start``, given the costs to
    the end ``after`` them. ``last``: no row follows, so what is missing is inserted."""
    runs = run_lengths(symbols)
    ends = [after]  # costs after each run, from the back
    for symbol, n in reversed(runs[1:]):
        ends.append(before(symbol, n, ends[-1]))
    edits, cost, i = [], 0, start
    for (symbol, n), end in zip(runs, reversed(ends)):
        late = CUT_OFF if symbol.endswith("!") else 0
        vs = [end]
        for _ in range(n):
            vs.append(apply(transition(symbol), vs[-1]))
        for k in range(n, 0, -1):
            now, then = vs[k], vs[k - 1]
            while now[i] != DELETE + then[i] and now[i] == INSERT + now[STEP[i]]:
                edits.append("I")
                cost, i = cost + INSERT, STEP[i]
            if now[i] == DELETE + then[i]:
                edits.append("D")
                cost += DELETE
            elif symbol[0] in NEXT[i] and now[i] == late + then[NEXT[i][symbol[0]]]:
                edits.append("K")
                cost, i = cost + late, NEXT[i][symbol[0]]
            else:
                edits.append("R")
                cost, i = cost + RETAG + late, STEP[i]
    while last and END[i]:
        edits.append("I")
        cost, i = cost + INSERT, STEP[i]
    return "".join(edits), cost, i


def symbol_of(role: str, bare: str) -> str:
    """Symbol of a row that stays: ``bare`` is its text without white space at the ends."""
    initial = role[:1] if role[:1] in ("s", "u", "a") else "?"
    return initial if bare[-1] in ".!?" else initial + "!"


def digest(role: str, text: str) -> bytes:
    return hashlib.md5(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass")).digest()


def faults(roles: list[str], texts: list[str], earlier: set[bytes]) -> tuple[list[str], int, int, int, list[bytes]]:
    """(symbols, blank, duplicate, truncated, new digests) of a segment's rows;
    ``earlier``: digests of rows in segments before."""
    seen, symbols, blank, duplicate = set(earlier), [], 0, 0
    for role, text in zip(roles, texts):
        bare = text.strip(BLANK)
        d = digest(role, text) if bare else None
        if not bare or d in seen:
            blank, duplicate = blank + (not bare), duplicate + bool(bare)
            symbols.append(MUST_GO)
        else:
            seen.add(d)
            symbols.append(symbol_of(role, bare))
    return symbols, blank, duplicate, sum(s.endswith("!") for s in symbols), sorted(seen - earlier)


def repaired_rows(audit: str, roles: list[str], texts: list[str], start: int) -> list[dict]:
    """The rows after the edits of ``audit``."""
    out, i, k = [], start, 0
    for edit in audit:
        role, text = (GIVEN[i], "") if edit == "I" else (roles[k], texts[k])
        k += edit != "I"
        if edit != "D":
            role = GIVEN[i] if edit == "R" else role
            out.append({"role": role, "text": text})
            i = NEXT[i][role[0]]
    return out


SEGMENT = "conv_id long, part long, seg long, open boolean, turns array<long>, roles array<string>, texts array<string>"
AT = ["part", "seg"]


def _mapped(df: DataFrame, work, schema: str) -> DataFrame:
    """``df.mapInArrow`` row by row: ``work(rows)``, an iterator of dicts to one of dicts."""
    out = T._parse_datatype_string(schema)

    def run(batches):
        import pyarrow as pa

        types, held = arrow_schema(out), []
        for row in work(r for b in batches for k in range(0, b.num_rows, 256) for r in b.slice(k, 256).to_pylist()):
            held.append(row)
            if len(held) >= 256:
                yield pa.RecordBatch.from_pylist(held, schema=types)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=types)

    return df.mapInArrow(run, out)


def segments(conversations: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Bounded pieces of neighbouring rows of one conversation, written once. ``open``: the
    conversation may go on in another segment. (part, seg) follows the order of rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"),
        F.substring(text, 1, 64).alias("head"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("salt"))
    order = ["conv_id", "turn", "role", "head", "hash"]
    dealt = rows.repartitionByRange(*order, "salt").sortWithinPartitions(*order).select("conv_id", "turn", "role", "text")

    def cut(rows):
        from pyspark import TaskContext

        part, seg, size, now, first = TaskContext.get().partitionId(), 0, 0, None, True

        def closed(more: bool):
            return {**now, "part": part, "seg": seg, "open": more}

        for r in rows:
            same = now is not None and r["conv_id"] == now["conv_id"]
            if now is not None and (not same or len(now["turns"]) >= segment_rows or size >= SEGMENT_BYTES):
                yield closed(first or same)
                seg, size, first = seg + 1, 0, same  # what follows a cut is open too
                now = None
            now = now or {"conv_id": r["conv_id"], "turns": [], "roles": [], "texts": []}
            now["turns"].append(r["turn"])
            now["roles"].append(r["role"])
            now["texts"].append(r["text"])
            size += len(r["text"]) + len(r["role"])
        if now is not None:
            yield closed(True)

    return written(_mapped(dealt, cut, SEGMENT), "segments")


def _scanned(df: DataFrame, key: str, order: list, step, schema: str) -> DataFrame:
    """``step(rows of one key in order)`` over a table with one small row a segment."""

    def work(rows):
        for _, same in groupby(rows, lambda r: r[key]):
            yield from step(same)

    return _mapped(df.repartition(key).sortWithinPartitions(key, *order), work, schema)


def _joined(open_: DataFrame) -> DataFrame:
    """(part, seg, earlier, start, after, last) of the open segments: all that a segment needs
    to know of the others of its conversation."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key")

    def make_digests(rows):
        for r in rows:
            yield {**r, "digests": faults(r["roles"], r["texts"], set())[4]}

    digests = written(_mapped(open_.select(key, *AT, "roles", "texts"), make_digests,
                              "key string, part long, seg long, digests array<binary>"), "digests")
    each = digests.select("key", *AT, F.explode("digests").alias("d"))
    first = each.groupBy("key", "d").agg(F.min(F.struct(*AT)).alias("f"), F.count(F.lit(1)).alias("n")).where("n > 1")
    again = each.join(first, ["key", "d"]).where((F.col("part") != F.col("f.part")) | (F.col("seg") != F.col("f.seg")))
    again = written(again.groupBy(*AT).agg(F.collect_list("d").alias("earlier")), "earlier")  # one segment's rows at most

    def make_matrices(rows):
        for r in rows:
            symbols = faults(r["roles"], r["texts"], set(r["earlier"] or ()))[0]
            yield {**r, "symbols": symbols, "m": [x for row in matrix(symbols) for x in row]}

    own = written(_mapped(open_.select(key, *AT, "roles", "texts").join(again, AT, "left"), make_matrices,
                          "key string, part long, seg long, symbols array<string>, m array<long>"), "matrices")

    def backwards(rows):
        after, last = END, True
        for r in rows:
            yield {**r, "after": list(after), "last": last}
            m = r["m"]
            after, last = apply([m[k:k + 4] for k in range(0, 16, 4)], after), False

    ends = _scanned(own.select("key", *AT, "m"), "key", [F.desc("part"), F.desc("seg")], backwards,
                    "key string, part long, seg long, after array<long>, last boolean")
    ends = written(ends, "ends")

    def make_states(rows):
        for r in rows:
            yield {**r, "to": [unroll(r["symbols"], i, tuple(r["after"]), False)[2] for i in range(4)]}

    states = _mapped(own.select("key", *AT, "symbols").join(ends.drop("key"), AT), make_states,
                     "key string, part long, seg long, to array<int>")

    def forwards(rows):
        start = 0
        for r in rows:
            yield {**r, "start": start}
            start = r["to"][start]

    starts = _scanned(states, "key", AT, forwards, "part long, seg long, start int")
    return starts.join(ends.drop("key"), AT).join(again, AT, "left")


PIECE = ("conv_id long, part long, seg long, open boolean, first_turn long, last_turn long, turns long, first_initial string, "
         "last_initial string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
         "repaired array<struct<role:string,text:string>>")


def _illegal(a: str, b: str) -> bool:
    return a + b not in ("su", "ua", "au")


def repair(conversations: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """Pieces of all conversations of (conv_id, turn, role, text): of each its faults, the
    cheapest edits (``audit``), their cost and the repaired rows. Pieces of a conversation follow
    each other by (part, seg); one that is not ``open`` is a whole conversation."""
    cut = segments(conversations, segment_rows)

    def make_pieces(rows):
        for r in rows:
            roles, texts, start = r["roles"], r["texts"], r["start"] or 0
            after, last = (tuple(r["after"]), r["last"]) if r["after"] else (END, True)
            symbols, blank, duplicate, truncated, _ = faults(roles, texts, set(r["earlier"] or ()))
            audit, cost, _ = unroll(symbols, start, after, last)
            known = [t for t in r["turns"] if t is not None]
            yield {"conv_id": r["conv_id"], "part": r["part"], "seg": r["seg"], "open": r["open"],
                   "first_turn": known[0] if known else None, "last_turn": known[-1] if known else None, "turns": len(set(known)),
                   "first_initial": roles[0][:1], "last_initial": roles[-1][:1], "blank": blank, "duplicate": duplicate,
                   "truncated": truncated, "illegal": sum(_illegal(a[:1], b[:1]) for a, b in zip(roles, roles[1:])),
                   "cost": cost, "audit": audit, "repaired": repaired_rows(audit, roles, texts, start)}

    none = {"start": "int", "after": "array<long>", "last": "boolean", "earlier": "array<binary>"}
    whole = cut.where(~F.col("open")).withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    open_ = cut.where("open")
    parts = open_.join(_joined(open_), AT).select(*whole.columns)
    return _mapped(whole, make_pieces, PIECE).unionByName(_mapped(parts, make_pieces, PIECE))


SUMMARY = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")
ADDED = ("blank", "duplicate", "truncated", "illegal", "cost")


def summary(pieces: DataFrame) -> DataFrame:
    """One row a conversation from its pieces; rows of the repaired conversation go to SHA-256
    as ``role:text``, one a line."""

    def folded(rows):
        for conv, same in groupby(rows, lambda r: r["conv_id"]):
            out = dict.fromkeys(ADDED, 0)
            sha, some, audit, initial = hashlib.sha256(), False, [], None
            low = high = None
            turns = 0
            for r in same:
                for name in ADDED:
                    out[name] += r[name]
                if initial is not None:
                    out["illegal"] += _illegal(initial, r["first_initial"])
                initial = r["last_initial"]
                if r["turns"]:
                    turns += r["turns"] - (r["first_turn"] == high)
                    low, high = r["first_turn"] if low is None else low, r["last_turn"]
                audit.append(r["audit"])
                for row in r["repaired"]:
                    line = f"{row['role']}:{row['text']}"
                    sha.update(((("\n" if some else "") + line)).encode("utf-8", "surrogatepass"))
                    some = True
            yield {"conv_id": conv, **out, "gaps": high - low + 1 - turns if turns else 0, "audit": "".join(audit),
                   "repaired_sha256": sha.hexdigest()}

    pieces = written(pieces, "pieces")
    parts = pieces.where("open").repartition("conv_id").sortWithinPartitions("conv_id", *AT)
    return _mapped(pieces.where(~F.col("open")), folded, SUMMARY).unionByName(_mapped(parts, folded, SUMMARY))


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the damage by crc32(``conv_id:turn``) mod 20: 0 drops a
    row, 1 empties its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes its role user."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn"))) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                space("role").alias("role"), space("text").alias("text"), code.alias("code"))
    text = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("code") == 0, 0).when(F.col("code") == 3, 2).otherwise(1)
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(F.array_repeat(F.lit(0), copies))).drop("col")


def repaired_after_damage(conversations: DataFrame, segment_rows: int = SEGMENT_ROWS) -> DataFrame:
    """``summary`` of every conversation after the damage; one without rows: zeros, no edits."""
    found = summary(repair(damaged(conversations), segment_rows)).withColumnRenamed("conv_id", "id")
    every = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    zero = {c: F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", *ADDED)}
    return out.select("conv_id", *zero.values(), F.coalesce("audit", F.lit("")).alias("audit"),
                      F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
