"""Conversation structure repair by a parallel Viterbi search whose chunks are stitched by rank convergence.

A conversation is repaired by the cheapest edits that make its role initials match `(s?(ua)+)?`. What an edit costs from a row
on depends on the row and on one of four states: nothing yet, after s, after u, after a. A chunk of rows maps the cost vector
behind it to the one before it by a min-plus product, and such products soon lose rank: vectors that started differently come to
differ by a constant only. So all chunks start at once, from a speculative vector; fix-up passes rerun a chunk from its
successor's vector until the new vectors differ from the old ones by a constant. The stitched costs then give the edits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from landq.llm.common import small_batches, spool

#: Rows (without their repeats) in a chunk, and fix-up passes before chunks that keep their rank are solved by whole matrices.
CHUNK, PASSES = 1 << 16, 4
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. The state behind an inserted or reroled row, by the state before it.
TURN = (2, 2, 3, 2)
#: The state behind a kept row, by (state, role): 0 s, 1 u, 2 a, 3 another.
FITS = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (3, 1): 2, (2, 2): 3}
INFINITE = 1 << 40
Vector = tuple[int, ...]


def closed(v: list[int]) -> Vector:
    """Costs where rows may also be inserted first."""
    two, three = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return min(v[0], INSERT + two), min(v[1], INSERT + two), two, three


#: The costs behind the last row, also the speculative vector of a chunk.
LAST = closed([0, INFINITE, INFINITE, 0])


def options(code: int, state: int) -> Iterator[tuple[str, int, int]]:
    """(initial, cost, next state) of the edits that consume a row. Code: 3 * role + 0 sound, 1 truncated, 2 to be deleted."""
    role, fault = divmod(code, 3)
    yield "D", DELETE, state
    if fault < 2:
        more = TRUNCATED if fault else 0
        if (state, role) in FITS:
            yield "K", KEEP + more, FITS[state, role]
        yield "R", REROLE + more, TURN[state]


@lru_cache(1 << 16)
def step(v: Vector, code: int) -> Vector:
    """The costs before a row from those behind it, less their least."""
    out = closed([min(c + v[t] for _, c, t in options(code, s)) for s in range(4)])
    low = min(out)
    return tuple(x - low for x in out)


@lru_cache(1 << 16)
def choose(v: Vector, code: int, state: int) -> tuple[str, int, int]:
    """The least initials of the cheapest edits up to and with this row, their cost, and the state behind it. v: costs behind it."""
    before = closed([min(c + v[t] for _, c, t in options(code, s)) for s in range(4)])
    done, cost = "", 0
    while True:
        fit = {e: (c, t) for e, c, t in options(code, state) if c + v[t] == before[state]}
        if INSERT + before[TURN[state]] == before[state]:
            fit["I"] = INSERT, TURN[state]
        edit = min(fit)
        done, cost, state = done + edit, cost + fit[edit][0], fit[edit][1]
        if edit != "I":
            return done, cost, state


def backward(codes: bytes, v: Vector) -> Vector:
    """The vector before a chunk from the one behind it, both less their least."""
    for code in reversed(codes):
        v = step(v, code)
    return v


def rerun(codes: bytes, old: Vector, new: Vector, start: Vector) -> tuple[Vector, bool]:
    """The chunk's vector when it ends with `new`: as before (`start`) from the row on where both differ by a constant."""
    for code in reversed(codes):
        if old == new:
            return start, True
        old, new = step(old, code), step(new, code)
    return new, old == new


def trace(codes: bytes, copies: list[int], v: Vector, state: int) -> tuple[list[str], int, int]:
    """Edits of a chunk's rows, their cost, and the state behind the chunk. Copies behind a row are deleted."""
    behind = [v]
    for code in reversed(codes[1:]):
        behind.append(step(behind[-1], code))
    edits, cost = [], 0
    for code, n in zip(codes, copies):
        done, c, state = choose(behind.pop(), code, state)
        edits.append(done + "D" * (n - 1))
        cost += c + DELETE * (n - 1)
    return edits, cost, state


def damage(rows: DataFrame, kind: Column) -> DataFrame:
    """conv_id, turn, role, text, copies (0: dropped) after the damage that `kind` (0 to 4, others none) does to each row.

    0 drops it, 1 empties its text, 2 removes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    A null role or text is one space.
    """
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    return rows.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("bigint").alias("copies"))


def planted(rows: DataFrame) -> DataFrame:
    """`rows` damaged by crc32 of `conv_id:turn` modulo 20, null parts as one space."""
    part = [F.coalesce(F.col(c).cast("bigint").cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    return damage(rows, F.crc32(F.concat(part[0], F.lit(":"), part[1])) % 20)


ORDER = ["conv_id", "turn", "role", "digest"]
CHUNKS = ("conv_id bigint, turn bigint, role string, digest string, part int, piece bigint, codes binary, copies array<bigint>, start array<bigint>, "
          "blank bigint, duplicate bigint, truncated bigint, illegal bigint, first_role int, last_role int, lo bigint, hi bigint, turns bigint")


def graded(rows: DataFrame) -> DataFrame:
    """One row for each different row of a turn: ORDER, initial (0 s, 1 u, 2 a, 3 other), blank, truncated, duplicate, copies.

    Equal rows of a turn are counted before the shuffle; the first turn of an equal role and text is a grouped minimum that joins
    back by the turn too, so neither a repeated row nor a phrase said in every turn lands in one task.
    """
    text, initial = F.col("text"), F.substring("role", 1, 1)
    whole = rows.filter("copies > 0").select(
        "conv_id", "turn", "role", F.md5(F.encode(text, "utf-8")).alias("digest"),
        F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3).alias("initial"),
        (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("truncated"), "copies")
    once = whole.groupBy(*ORDER, "initial", "blank", "truncated").agg(F.sum("copies").alias("copies"))
    first = once.groupBy("conv_id", "role", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first")).select("conv_id", "role", "digest", "first.turn")
    left, right = once.alias("l"), first.withColumn("is_first", F.lit(True)).alias("r")
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ORDER]
    rest = left.join(right, same[0] & same[1] & same[2] & same[3], "left").select("l.*", F.col("is_first").isNull().alias("duplicate"))
    gone = rows.filter("copies = 0").select("conv_id").distinct().select(
        "conv_id", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit(3).alias("initial"),
        F.lit(False).alias("blank"), F.lit(False).alias("truncated"), F.lit(0).cast("bigint").alias("copies"), F.lit(False).alias("duplicate"))
    return rest.unionByName(gone)


def chunked(rows: DataFrame, size: int) -> DataFrame:
    """The graded rows in order, cut into chunks of a conversation with their codes, counts and speculative vectors.

    Rows are dealt by ranges of their whole order, so a long conversation spreads over tasks and a task holds one chunk at a time.
    """
    names = [*ORDER, "initial", "blank", "truncated", "duplicate", "copies"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, piece, done, now = TaskContext.get().partitionId(), 0, [], None

        def close() -> None:
            nonlocal piece
            codes = bytes(now["codes"])
            done.append((*now["key"], part, piece, codes, now["copies"], list(backward(codes, LAST)), *now["counts"], *now["ends"],
                         now["lo"], now["hi"], now["turns"]))
            piece += 1

        def out() -> pa.RecordBatch:
            rows_ = [dict(zip(SCHEMA.names, r)) for r in done]
            done.clear()
            return pa.RecordBatch.from_pylist(rows_, SCHEMA)

        for batch in batches:
            for conv, turn, role, digest, initial, blank, truncated, duplicate, n in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or now["key"][0] != conv or len(now["codes"]) >= size:
                    if now is not None:
                        close()
                    now = {"key": (conv, turn, role, digest), "codes": bytearray(), "copies": [], "counts": [0, 0, 0, 0], "ends": [None, None],
                           "lo": None, "hi": None, "turns": 0}
                if not n:
                    continue
                now["codes"].append(3 * initial + (2 if blank or duplicate else 1 if truncated else 0))
                now["copies"].append(n)
                counts, ends = now["counts"], now["ends"]
                if blank:
                    counts[0] += n
                else:
                    counts[1] += n if duplicate else n - 1
                    counts[2] += bool(truncated and not duplicate)
                counts[3] += n - 1 + (ends[1] is not None and (ends[1], initial) not in LEGAL)
                ends[:] = initial if ends[0] is None else ends[0], initial
                if turn is not None and turn != now["hi"]:
                    now["lo"], now["hi"], now["turns"] = turn if now["lo"] is None else now["lo"], turn, now["turns"] + 1
            if len(done) >= 256:
                yield out()
        if now is not None:
            close()
        if done:
            yield out()

    ordered = rows.select(*names).repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return ordered.mapInArrow(work, CHUNKS)


LEGAL = {(0, 1), (1, 2), (2, 1)}
SCHEMA = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("digest", pa.string()), ("part", pa.int32()),
                    ("piece", pa.int64()), ("codes", pa.binary()), ("copies", pa.list_(pa.int64())), ("start", pa.list_(pa.int64())),
                    *[(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")], ("first_role", pa.int32()), ("last_role", pa.int32()),
                    ("lo", pa.int64()), ("hi", pa.int64()), ("turns", pa.int64())])
AT = ["part", "piece"]


def per_row(df: DataFrame, call, schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """`call` on each row's values (column by column), its tuple as the new row."""
    names = [f.strip().split()[0] for f in schema.split(",")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [call(*r) for r in zip(*[c.to_pylist() for c in batch.columns])]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return df.mapInArrow(work, schema)


def per_conversation(df: DataFrame, call, schema: str, kinds: list[pa.DataType], forward: bool) -> DataFrame:
    """`call` on the rows of each conversation's chunks in order (or against it); it yields tuples. Rows are a few numbers a chunk."""
    names = [f.strip().split()[0] for f in schema.split(",")]

    def work(table: pa.Table) -> pa.Table:
        order = "ascending" if forward else "descending"
        table = table.sort_by([(c, order) for c in AT])
        rows = list(call(zip(*[table.column(i).to_pylist() for i in range(1, table.num_columns)])))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    return df.groupBy("conv_id").applyInArrow(work, schema)


LONGS = pa.list_(pa.int64())


def converge(chunks: DataFrame, passes: int) -> DataFrame:
    """part, piece, used: for each chunk the true vector behind it, less its least.

    In a pass every chunk whose successor's vector is not the one it used runs again from that. Chunks that are still open after
    `passes` passes keep their rank (a long run of one role does); these conversations are solved by the whole matrices of their
    chunks, folded over a few numbers a chunk.
    """
    last = F.array(*[F.lit(x).cast("bigint") for x in LAST])
    least = F.array_min("next")
    vectors = chunks.select("conv_id", *AT, last.alias("used"), "start")
    several = Window.partitionBy("conv_id").orderBy(*AT)

    def opened(some: DataFrame) -> DataFrame:
        behind = some.withColumn("next", F.coalesce(F.lead("start").over(several), last))
        return behind.withColumn("next", F.transform("next", lambda x: x - least)).filter(F.col("next") != F.col("used"))

    def again(part: int, piece: int, codes: bytes, used: list[int], new: list[int], start: list[int]) -> tuple:
        return part, piece, new, list(rerun(codes, tuple(used), tuple(new), tuple(start))[0])

    for turn in range(passes + 1):
        open_ = spool(opened(vectors), "open-chunks")
        if open_.isEmpty():
            return vectors.select(*AT, "used")
        if turn == passes:
            break
        mended = per_row(chunks.select(*AT, "codes").join(open_, AT).select(*AT, "codes", "used", "next", "start"), again,
                         "part int, piece bigint, new_used array<bigint>, new_start array<bigint>", [pa.int32(), pa.int64(), LONGS, LONGS])
        vectors = spool(vectors.join(mended, AT, "left").select(
            "conv_id", *AT, F.coalesce("new_used", "used").alias("used"), F.coalesce("new_start", "start").alias("start")), "chunk-vectors")

    def matrix(conv: int, part: int, piece: int, codes: bytes) -> tuple:
        rows = []
        for j in range(4):
            v, add = closed([0 if s == j else INFINITE for s in range(4)]), 0
            for code in reversed(codes):
                out = closed([min(c + v[t] for _, c, t in options(code, s)) for s in range(4)])
                low = min(out)
                v, add = tuple(min(x - low, INFINITE) for x in out), add + low
            rows += [x + add for x in v]
        return conv, part, piece, rows

    def fold(rows: Iterator[tuple]) -> Iterator[tuple]:
        v = LAST
        for part, piece, m in rows:
            yield part, piece, list(v)
            new = [min(m[4 * j + s] + v[j] for j in range(4)) for s in range(4)]
            v = tuple(x - min(new) for x in new)

    hard = chunks.select("conv_id", *AT, "codes").join(open_.select("conv_id").distinct().withColumnRenamed("conv_id", "hard"),
                                                     F.col("conv_id").eqNullSafe(F.col("hard")), "left_semi")
    whole = per_row(hard, matrix, "conv_id bigint, part int, piece bigint, costs array<bigint>", [pa.int64(), pa.int32(), pa.int64(), LONGS])
    solved = per_conversation(whole, fold, "part int, piece bigint, solved array<bigint>", [pa.int32(), pa.int64(), LONGS], False)
    return vectors.join(solved, AT, "left").select(*AT, F.coalesce("solved", "used").alias("used"))


def traced(chunks: DataFrame, ends: DataFrame) -> DataFrame:
    """The chunks with `audit` (their edits), `cost`, and counts that see the chunk before them. ends: part, piece, used."""
    here = Window.partitionBy("conv_id").orderBy(*AT)
    ready = chunks.join(ends, AT)
    long_ = chunks.groupBy("conv_id").count().filter("count > 1").select(F.col("conv_id").alias("long_id"))

    def states(conv: int, part: int, piece: int, codes: bytes, copies: list[int], used: list[int]) -> tuple:
        return conv, part, piece, [trace(codes, copies, tuple(used), s)[2] for s in range(4)]

    def follow(rows: Iterator[tuple]) -> Iterator[tuple]:
        state = 0
        for part, piece, to in rows:
            yield part, piece, state
            state = to[state]

    some = ready.join(long_, F.col("conv_id").eqNullSafe(F.col("long_id")), "left_semi").select("conv_id", *AT, "codes", "copies", "used")
    begin = per_conversation(per_row(some, states, "conv_id bigint, part int, piece bigint, ends array<bigint>",
                                     [pa.int64(), pa.int32(), pa.int64(), LONGS]),
                             follow, "part int, piece bigint, state int", [pa.int32(), pa.int64(), pa.int32()], True)
    borders = chunks.select("conv_id", *AT, "first_role", "last_role", "lo", "hi").withColumns({
        "before": F.last("last_role", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1)),
        "turn_before": F.last("hi", ignorenulls=True).over(here.rowsBetween(Window.unboundedPreceding, -1)),
        "is_last": F.lead("part").over(here).isNull()})
    legal = F.concat_ws(",", "before", "first_role").isin([f"{a},{b}" for a, b in sorted(LEGAL)])
    borders = borders.select(*AT, "is_last", F.coalesce(F.col("before").isNotNull() & F.col("first_role").isNotNull() & ~legal, F.lit(False))
                             .cast("bigint").alias("clash"), F.coalesce(F.col("lo") == F.col("turn_before"), F.lit(False)).cast("bigint").alias("again"))

    def edits(part: int, piece: int, codes: bytes, copies: list[int], used: list[int], state: int, is_last: bool) -> tuple:
        done, cost, state = trace(codes, copies, tuple(used), state)
        while is_last and state in (1, 2):
            state, cost = TURN[state], cost + INSERT
            done.append("I")
        return part, piece, "".join(done), cost

    joined = ready.join(begin, AT, "left").join(borders, AT)
    audits = per_row(joined.select(*AT, "codes", "copies", "used", F.coalesce("state", F.lit(0)), "is_last"), edits,
                     "part int, piece bigint, audit string, cost bigint", [pa.int32(), pa.int64(), pa.string(), pa.int64()])
    return chunks.drop("codes", "copies", "start").join(audits, AT).join(borders, AT).select(
        *ORDER, *AT, "audit", "blank", "duplicate", "truncated", (F.col("illegal") + F.col("clash")).alias("illegal"), "cost", "lo", "hi",
        (F.col("turns") - F.col("again")).alias("turns"))


REPORT = ("conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, "
          "repaired_sha256 string")


def applied(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The edits applied to the texts in order, and what each conversation comes to.

    A conversation's digest is one sequential hash, so its rows pass one task, sorted (spilling if need be) and one at a time.
    """
    counts = ["blank", "duplicate", "truncated", "illegal", "cost", "turns"]
    texts = rows.filter("copies > 0").select("conv_id", "turn", "role", F.md5(F.encode("text", "utf-8")).alias("digest"), F.lit(1).alias("kind"),
                                             "text", "copies")
    both = audits.withColumn("kind", F.lit(0)).unionByName(texts, allowMissingColumns=True)
    stream = both.select("conv_id", "kind", "role", "text", "copies", "audit", *counts, "lo", "hi", "turn", "digest", *AT).repartition(
        "conv_id").sortWithinPartitions(*ORDER, "kind", *AT).drop("turn", "digest", *AT)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        now = None

        def insert(edit: str) -> None:
            now["state"] = TURN[now["state"]]
            line(("user" if now["state"] == 2 else "assistant") + ":")

        def line(text: str) -> None:
            now["hash"].update(("\n" if now["some"] else "").encode() + text.encode("utf-8"))
            now["some"] = True

        def edit() -> str:
            while now["at"] >= len(now["pieces"][now["piece"]]):
                now["piece"], now["at"] = now["piece"] + 1, 0
            now["at"] += 1
            return now["pieces"][now["piece"]][now["at"] - 1]

        def close() -> None:
            rest = "".join(now["pieces"][now["piece"]:])[now["at"]:] if now["pieces"] else ""
            for e in rest:
                insert(e)
            total = dict(zip(counts, now["counts"]))
            turns, lo, hi = total.pop("turns"), now["lo"], now["hi"]
            done.append({"conv_id": now["conv"], "gaps": 0 if lo is None else hi - lo + 1 - turns, **total, "audit": "".join(now["pieces"]),
                         "repaired_sha256": now["hash"].hexdigest()})

        def out() -> pa.RecordBatch:
            names = [f.strip().split() for f in REPORT.split(",")]
            batch = pa.RecordBatch.from_arrays([pa.array([r[n] for r in done], pa.string() if k == "string" else pa.int64()) for n, k in names],
                                               [n for n, _ in names])
            done.clear()
            return batch

        for batch in batches:
            for conv, kind, role, text, copies, audit, *numbers, lo, hi in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or now["conv"] != conv:
                    if now is not None:
                        close()
                    now = {"conv": conv, "state": 0, "hash": hashlib.sha256(), "some": False, "pieces": [], "piece": 0, "at": 0,
                           "counts": [0] * len(counts), "lo": None, "hi": None}
                if kind == 0:
                    now["pieces"].append(audit)
                    now["counts"] = [a + b for a, b in zip(now["counts"], numbers)]
                    if lo is not None:
                        now["lo"], now["hi"] = lo if now["lo"] is None else min(now["lo"], lo), hi
                    continue
                for _ in range(copies):
                    e = edit()
                    while e == "I":
                        insert(e)
                        e = edit()
                    if e == "K":
                        now["state"] = FITS[now["state"], "sua".index(role[0])]
                        line(f"{role}:{text}")
                    elif e == "R":
                        now["state"] = TURN[now["state"]]
                        line(("user:" if now["state"] == 2 else "assistant:") + text)
            if len(done) >= 4096:
                yield out()
        if now is not None:
            close()
        if done:
            yield out()

    return stream.mapInArrow(work, REPORT)


def repair(rows: DataFrame, chunk: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """One row for each conversation (conv_id, null too) of `rows` (conv_id, turn, role, text, copies as `damage` gives them).

    gaps: missing turns between the least and the greatest. blank, duplicate, truncated: rows by their first fault (only white space;
    role and text seen earlier; last other character not one of .!?). illegal: neighbours whose role initials are not su, ua, au.
    cost, audit: the cheapest edits and their initials (Keep, Rerole, Delete, Insert), the ASCII-least among equal ones.
    repaired_sha256: hash of the repaired `role:text` lines. Rows go by turn, nulls first, those of one turn by role and then by
    the text's MD5; equal rows of a turn are neighbours. A role that starts with neither s, u nor a (the empty one too) fits nowhere
    and is reroled or deleted. A conversation without rows has zeros, an empty audit and the hash of nothing. An audit is one
    string, so a conversation holds less than 2^31 edits. Other columns are not read.
    """
    small_batches(rows.sparkSession)
    chunks = spool(chunked(graded(rows), chunk), "chunks")
    return applied(rows, traced(chunks, spool(converge(chunks, passes), "chunk-ends")))
