"""Conversation repair: the cheapest edits that make a conversation alternate, found by Four-Russians block tables.

Rows are `conv_id, turn, role, text`; a conversation is read by turn, nulls first, then by role and text where turns are equal.
Wanted is `(s?(ua)+)?` over the first letters of the roles. Edits: Keep costs 0, Rerole to user or assistant 3, Delete 4, Insert an
empty user or assistant turn 3. Blank and repeated rows must go; a truncated row that stays adds 3. Of the cheapest edits
those whose letters are least in ASCII are taken.

Method. A row is one of nine symbols, and the cost of finishing from each of the four states of the pattern is a vector.
Less its minimum, such a vector is one of few (`Tables` finds all that can occur), so for every block of `BLOCK` symbols
and every vector to its right the vector to its left is looked up, not computed. Costs run from the end of a conversation
to its start, a block a step; each block is then expanded backward, symbol by symbol, and followed from its left, where
the letter to prefer among equally cheap ones is known.

Scale. Equal rows are counted before any shuffle. Rows are dealt by range in order of conversation and turn, so a conversation
of any length spreads over as many tasks as its rows fill. One that lies within a task, and within `PIECE` rows, is finished
there. The others leave pieces: a piece yields the matrix of its costs (the same tables, from four unit vectors), the
matrices are folded from the right, one small row a piece, and the pieces are then followed from the left as a stream.
That last step of one long conversation is sequential, as its SHA-256 is, and holds one piece at a time.

Defined cases. Nulls in role or text are one space; a null conv_id is a conversation; a null turn comes first and has no part in gaps;
empty and white texts are blank; very long texts are moved whole; rows equal in turn, role and text repeat one another. A conversation
without rows has zeros, an empty audit and the digest of nothing. Empty tables give empty results. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telewatch.sources.tables import materialise

KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3
BLOCK = 4  # symbols a block: 9 ** 4 blocks for each vector
PIECE, PIECE_CHARS = 4096, 4 << 20  # what a task holds of a conversation, in rows and in characters
SPACE = " \t\n\x0b\x0c\r"
START, SYSTEM, USER, ASSISTANT = range(4)
NEEDS = (USER, USER, ASSISTANT, USER)  # the state that an inserted or reroled turn leads to
ENTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
INITIALS = "sua "  # the last stands for any other
SYMBOLS = 1 + 2 * len(INITIALS)  # 0: must go; else 1 + 2 * initial + truncated
NEVER = 1 << 40


def symbol(role: str, blank_or_repeated: bool, truncated: bool) -> int:
    if blank_or_repeated:
        return 0
    at = INITIALS.find(role[:1]) if role[:1] in ("s", "u", "a") else 3
    return 1 + 2 * at + truncated


def _closed(v: list[int]) -> tuple[int, ...]:
    """`v` with insertions: from a state on to the state that an inserted turn leads to."""
    for _ in range(3):
        v = [min(c, INSERT + v[NEEDS[s]]) for s, c in enumerate(v)]
    return tuple(min(c, NEVER) for c in v)


def _options(v: tuple[int, ...], x: int, s: int) -> Iterator[tuple[str, int, int]]:
    """Letter, cost and next state of what can be done with symbol x in state s, before costs v."""
    yield "D", DELETE + v[s], s
    if x:
        added = CUT_OFF * ((x - 1) % 2)
        kept = ENTER.get((s, INITIALS[(x - 1) // 2]))
        if kept is not None:
            yield "K", KEEP + added + v[kept], kept
        yield "R", REROLE + added + v[NEEDS[s]], NEEDS[s]


def _step(v: tuple[int, ...], x: int) -> tuple[int, ...]:
    return _closed([min(c for _, c, _ in _options(v, x, s)) for s in range(4)])


def _normal(v: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    low = min(v)
    return tuple(c - low if c < NEVER else NEVER for c in v), low


class Tables:
    """All normalised vectors, and the tables over them for one symbol and for blocks of symbols."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        starts = [_closed([0, NEVER, NEVER, 0])] + [_closed([0 if s == j else NEVER for s in range(4)]) for j in range(4)]
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        for v in starts:
            self._add(_normal(v)[0])
        self.start = [self.number[_normal(v)[0]] for v in starts]  # the accepting end, then one for each state
        to, cost, at = [], [], 0
        while at < len(self.vectors):  # grows while new vectors appear; their entries differ by few edits, so soon none do
            found = [_normal(_step(self.vectors[at], x)) for x in range(SYMBOLS)]
            to.append([self._add(v) for v, _ in found])
            cost.append([c for _, c in found])
            at += 1
        one, more = np.array(to, np.int32), np.array(cost, np.int64)
        to_block, cost_block = one, more
        for _ in range(block - 1):  # a further symbol on the left
            cost_block = (more[to_block] + cost_block[:, :, None]).transpose(0, 2, 1).reshape(len(one), -1)
            to_block = one[to_block].transpose(0, 2, 1).reshape(len(one), -1)
        self.one, self.one_cost = to, cost
        self.many, self.many_cost = to_block.tolist(), cost_block.tolist()
        self.follow = cache(self._follow)

    def _add(self, v: tuple[int, ...]) -> int:
        if v not in self.number:
            self.number[v] = len(self.vectors)
            self.vectors.append(v)
        return self.number[v]

    def _codes(self, symbols: bytes) -> tuple[list[int], int]:
        """Numbers of the whole blocks, and how many symbols they cover."""
        whole = len(symbols) - len(symbols) % self.block
        digits = np.frombuffer(symbols, np.uint8)[:whole].reshape(-1, self.block).astype(np.int64)
        return (digits @ (SYMBOLS ** np.arange(self.block - 1, -1, -1))).tolist(), whole

    def back(self, symbols: bytes, right: int) -> tuple[list[int], int, int]:
        """The vector to the right of each block, that to the left of all, and the cost on the way. The last, short block is done by symbols."""
        codes, whole = self._codes(symbols)
        v, total = right, 0
        for x in reversed(symbols[whole:]):
            total += self.one_cost[v][x]
            v = self.one[v][x]
        borders = [right] if whole < len(symbols) else []
        for code in reversed(codes):
            borders.append(v)
            total += self.many_cost[v][code]
            v = self.many[v][code]
        return borders[::-1], v, total

    def matrix(self, symbols: bytes) -> list[int]:
        """Cost from each state at the left to each at the right, row by row."""
        columns = []
        for j in range(4):
            _, v, total = self.back(symbols, self.start[1 + j])
            columns.append([c + total if c < NEVER else NEVER for c in self.vectors[v]])
        return [columns[j][s] for s in range(4) for j in range(4)]

    def _follow(self, right: int, x: int, state: int) -> tuple[str, int]:
        """Letters up to and with that of symbol x, the ASCII-least of the cheapest, and the state after it."""
        v, left, letters = self.vectors[right], _step(self.vectors[right], x), ""
        while True:
            best = {letter: after for letter, c, after in _options(v, x, state) if c == left[state]}
            if left[NEEDS[state]] + INSERT == left[state]:
                best["I"] = NEEDS[state]
            letter = min(best)
            letters, state = letters + letter, best[letter]
            if letter != "I":
                return letters, state

    def trace(self, symbols: bytes, right: int, state: int) -> tuple[list[str], int]:
        """The letters for each symbol, from `state` on."""
        borders, _, _ = self.back(symbols, right)
        out = []
        for k, border in enumerate(borders):
            inner = symbols[k * self.block:(k + 1) * self.block]
            vs = [border]  # the block expanded backward
            for x in reversed(inner[1:]):
                vs.append(self.one[vs[-1]][x])
            for x, v in zip(inner, reversed(vs)):
                letters, state = self.follow(v, x, state)
                out.append(letters)
        return out, state


@cache
def tables(block: int = BLOCK) -> Tables:
    return Tables(block)


CLOSING = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}  # what is inserted at the end


class Trail:
    """What is known of one conversation so far, from its start."""

    def __init__(self, messages: bool):
        self.digest, self.any, self.audit, self.state = hashlib.sha256(), False, [], START
        self.cost = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.initial = None
        self.messages: list[dict] | None = [] if messages else None

    def _say(self, role: str, text: str) -> None:
        if self.messages is not None:
            self.messages.append({"role": role, "text": text})
        self.digest.update((("\n" if self.any else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.any = True

    def _inserted(self, n: int) -> None:
        for _ in range(n):
            self.state = NEEDS[self.state]
            self.cost += INSERT
            self._say(ROLE[self.state], "")

    def add(self, rows: list[tuple], symbols: bytes, right: int) -> None:
        """Rows (turn, role, text, number of equal ones, whether seen before) with the vector to the right of them."""
        letters, _ = tables().trace(symbols, right, self.state)
        for (turn, role, text, n, seen), x, what in zip(rows, symbols, letters):
            if turn is not None and turn != self.last:
                self.first, self.last, self.turns = turn if self.first is None else self.first, turn, self.turns + 1
            bare = text.strip(SPACE)
            cut = bool(bare) and bare[-1] not in ".!?"
            self.blank += 0 if bare else n
            self.duplicate += n - 1 + seen if bare else 0
            self.truncated += int(cut and not seen)
            pair = None if self.initial is None else self.initial + role[:1]
            self.illegal += int(pair is not None and pair not in ("su", "ua", "au")) + n - 1
            self.initial = role[:1]
            self._inserted(len(what) - 1)
            kind = what[-1]
            if kind == "D":
                self.cost += DELETE
            else:
                self.state = ENTER[self.state, role[:1]] if kind == "K" else NEEDS[self.state]
                self.cost += CUT_OFF * cut + (REROLE if kind == "R" else 0)
                self._say(role if kind == "K" else ROLE[self.state], text)
            self.cost += DELETE * (n - 1)
            self.audit.append(what + "D" * (n - 1))

    def result(self) -> dict:
        closing = CLOSING[self.state]
        self._inserted(len(closing))
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        out = {"gaps": (gaps + 2 ** 63) % 2 ** 64 - 2 ** 63, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
               "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit) + closing}
        return out | ({"repaired_sha256": self.digest.hexdigest()} if self.messages is None else {"messages": self.messages})


def _symbols(rows: list[tuple]) -> bytes:
    out = bytearray()
    for _, role, text, _, seen in rows:
        bare = text.strip(SPACE)
        out.append(symbol(role, not bare or seen, bool(bare) and bare[-1] not in ".!?"))
    return bytes(out)


RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
NAMES = [c.split()[0] for c in RESULT.split(", ")]


def _kind(messages: bool) -> str:
    return "messages array<struct<role:string,text:string>>" if messages else "repaired_sha256 string"


def _batch(out: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(out, schema=schema)


def _arrow(conv: pa.DataType, messages: bool, *more: tuple) -> pa.Schema:
    last = ("messages", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))) if messages else ("repaired_sha256", pa.string())
    return pa.schema([("conv_id", conv), *[(n, pa.string() if n == "audit" else pa.int64()) for n in NAMES], last, *more])


def _pieces(messages: bool, piece: int):
    """One pass over rows in order: whole conversations are finished; those that may go on elsewhere leave their rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, schema, out, size = TaskContext.get().partitionId(), None, [], 0
        key, rows, chars, cut, first, begun = None, [], 0, 0, True, False

        def leave() -> dict:
            return {"conv_id": key, "part": part, "piece": cut, "rows": [{"turn": t, "role": r, "text": x, "n": n} for t, r, x, n in rows]}

        def done(last: bool) -> dict:
            if first or last or cut:
                return leave()
            seen: set[tuple[str, str]] = set()
            marked = []
            for t, r, x, n in rows:
                marked.append((t, r, x, n, (r, x) in seen))
                seen.add((r, x))
            trail, symbols = Trail(messages), _symbols(marked)
            trail.add(marked, symbols, tables().start[0])
            return {"conv_id": key} | trail.result()

        for batch in batches:
            if schema is None:
                row = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64())])
                schema = _arrow(batch.schema.field("conv_id").type, messages, ("part", pa.int64()), ("piece", pa.int64()), ("rows", pa.list_(row)))
            for r in batch.to_pylist():
                if begun and r["conv_id"] != key:
                    out.append(done(False))
                    size += chars
                    first, rows, chars, cut = False, [], 0, 0
                if len(rows) >= piece or chars > PIECE_CHARS:
                    out.append(leave())
                    size += chars
                    rows, chars, cut = [], 0, cut + 1
                key, begun = r["conv_id"], True
                if r["n"]:  # a row that only says that the conversation exists has none
                    rows.append((r["turn"], r["role"], r["text"], r["n"]))
                    chars += len(r["text"])
                if len(out) >= 256 or size > PIECE_CHARS:
                    yield _batch(out, schema)
                    out, size = [], 0
        if begun:
            out.append(done(True))
            yield _batch(out, schema)

    return run


def _marked(record: dict) -> list[tuple]:
    again = set(record["again"] or ())
    return [(r["turn"], r["role"], r["text"], r["n"], k in again) for k, r in enumerate(record["rows"])]


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [{"key": r["key"], "part": r["part"], "piece": r["piece"], "matrix": tables().matrix(_symbols(_marked(r)))} for r in batch.to_pylist()]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("part", pa.int64()), ("piece", pa.int64()), ("matrix", pa.list_(pa.int64()))]))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of the vector to the right of each piece, from pieces in falling order."""
    key, v = None, 0
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if r["key"] != key:
                key, v = r["key"], tables().start[0]
            out.append({"key": key, "part": r["part"], "piece": r["piece"], "right": v})
            at, m = tables().vectors[v], r["matrix"]
            left = tuple(min(min(m[4 * s + j] + at[j] for j in range(4)), NEVER) for s in range(4))
            v = tables().number[_normal(left)[0]]
        yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("key", pa.string()), ("part", pa.int64()), ("piece", pa.int64()), ("right", pa.int64())]))


def _followed(messages: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, conv, trail, schema = None, None, None, None
        for batch in batches:
            schema = schema or _arrow(batch.schema.field("conv_id").type, messages)
            for r in batch.to_pylist():
                if trail is not None and r["key"] != key:
                    yield _batch([{"conv_id": conv} | trail.result()], schema)
                    trail = None
                trail = trail or Trail(messages)
                key, conv, rows = r["key"], r["conv_id"], _marked(r)
                trail.add(rows, _symbols(rows), r["right"])
        if trail is not None:
            yield _batch([{"conv_id": conv} | trail.result()], schema)

    return run


def repair(df: DataFrame, messages: bool = False, piece: int = PIECE) -> DataFrame:
    """One row per conversation: faults, cost, audit, and the digest of the repaired `role:text` lines, or with `messages` the repaired turns.

    Faults: `gaps` (turns missing between the least and the greatest), `blank`, `duplicate` (role and text came earlier), `truncated`
    (the last character that is not white is none of .!?), each row's first fault counting, and `illegal` (neighbouring roles not
    system-user, user-assistant or assistant-user, before the repair). A column `n`, if there, says how often a row stands
    there; 0 only makes the conversation known.
    """
    spark = df.sparkSession
    one = F.lit(" ")
    conv_type = df.schema["conv_id"].dataType.simpleString()
    rows = df.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), one).alias("role"),
        F.coalesce(F.col("text").cast("string"), one).alias("text"), (F.col("n") if "n" in df.columns else F.lit(1)).cast("long").alias("n"))
    counted = materialise(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n")), "conversation_rows")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = counted.repartitionByRange(tasks, "conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    row = "rows array<struct<turn:long,role:string,text:string,n:long>>"
    schema = f"conv_id {conv_type}, {RESULT}, {_kind(messages)}"
    found = materialise(dealt.mapInArrow(_pieces(messages, piece), f"{schema}, part long, piece long, {row}"), "conversation_pieces")
    columns = ["conv_id", *NAMES, "messages" if messages else "repaired_sha256"]
    whole = found.where("part IS NULL").select(*columns)
    key = F.when(F.col("conv_id").isNull(), "null").otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    cut = found.where("part IS NOT NULL").select(key.alias("key"), "conv_id", "part", "piece", "rows")
    # rows of cut conversations that came earlier: the first of each role and text, found by counting, joined back
    at = ["key", "part", "piece"]
    light = cut.select(*at, F.posexplode("rows").alias("pos", "r")).select(
        *at, "pos", F.md5(F.concat_ws("\n", F.col("r.role"), F.col("r.text"))).alias("said"))
    first = light.groupBy("key", "said").agg(F.min(F.struct("part", "piece", "pos")).alias("first"))
    later = light.join(first, ["key", "said"]).where(F.struct("part", "piece", "pos") > F.col("first"))
    marks = later.groupBy(*at).agg(F.collect_list("pos").alias("again"))  # at most a piece's rows
    pieces = materialise(cut.join(marks, at, "left"), "conversation_marks")
    matrices = pieces.mapInArrow(_matrices, "key string, part long, piece long, matrix array<long>")
    falling = matrices.repartition(tasks, "key").sortWithinPartitions("key", F.desc("part"), F.desc("piece"))
    rights = falling.mapInArrow(_folded, "key string, part long, piece long, right long")
    rising = pieces.join(rights, at).repartition(tasks, "key").sortWithinPartitions(*at)
    return whole.unionByName(rising.mapInArrow(_followed(messages), schema))


def damage(df: DataFrame) -> DataFrame:
    """Rows to repair, made from whole ones by a hash of conversation and turn: of twenty, one is dropped (n = 0), one emptied, one loses
    its sentence marks, one is repeated, and one becomes the user's. Nulls of role and text are one space, also in the hashed text."""
    named = F.concat(*[F.coalesce(F.col(c).cast("string"), F.lit(" ")) if c != ":" else F.lit(":") for c in ("conv_id", ":", "turn")])
    hit = F.crc32(named.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    gone = hit == 0
    return df.select(
        "conv_id", F.when(~gone, F.col("turn").cast("long")).alias("turn"),
        F.when(gone, "").when(hit == 4, "user").otherwise(role).alias("role"),
        F.when(gone | (hit == 1), "").when(hit == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(gone, 0).when(hit == 3, 2).otherwise(1).cast("long").alias("n"))
