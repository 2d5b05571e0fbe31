"""The graph of near-duplicate vectors, hard negatives and conversation repair against plain versions."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from landq.llm import dialogs, negatives, queries, vector_graph

FOLDER = "/root/testdata/sf0.001"
VECTOR = [0.3, -1.2, 0.8, 0.1, -0.4]
NAN = float("nan")
ODD = [(0, 1, VECTOR), (0, 1, VECTOR), (10, 1, [-c for c in VECTOR]), (1, 1, VECTOR), (2, 2, [2 * c for c in VECTOR]), (3, 2, [0.9 * c for c in VECTOR]),
       (4, None, VECTOR), (5, 2, None), (6, 2, [NAN] * 5), (7, 2, [None] * 5), (8, 2, [float("inf")] * 5), (20, 3, []), (21, 3, []), (30, 5, [1.0]),
       (None, 1, VECTOR), (31, 5, [0.5, 0.5]), (40, 6, [0.0] * 5), (41, 6, [1.0] * 5), (52, 9, [1e-40])]


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<float>").withColumns({"x": F.lit("mine"), "unit": F.lit(1), "n": F.lit(0)})


def floats(embedding):
    """The components as they are read back from the table; None where the vector takes no part."""
    if embedding is None or any(c is None or not math.isfinite(c) for c in embedding):
        return None
    return [float(np.float32(c)) for c in embedding]


def linked(rows, limit=0.95):
    """vec_id -> (links, component, kept), by all cosines."""
    good = {}
    for i, _, e in rows:
        x = floats(e)
        if i is not None and x and any(x) and (i not in good or x < good[i]):
            good[i] = x
    ids = sorted(good)
    m = np.zeros((len(ids), max([len(x) for x in good.values()], default=0)))
    for at, i in enumerate(ids):
        m[at, :len(good[i])] = good[i]
    m /= np.abs(m).max(axis=1, keepdims=True) if len(ids) else 1
    m /= np.linalg.norm(m, axis=1, keepdims=True) if len(ids) else 1
    near, out = m @ m.T >= limit, {i: (0, i, True) for i, _, _ in rows}
    for start in range(len(ids)):
        reach, edge = {start}, [start]
        while edge:
            edge = [int(j) for j in set(np.flatnonzero(near[edge].any(axis=0)).tolist()) - reach]
            reach |= set(edge)
        out[ids[start]] = (int(near[start].sum()) - 1, ids[min(reach)], min(reach) == start)
    return out


def test_graph_odd_rows(spark):
    got = vector_graph.near_duplicate_vectors(vectors_of(spark, ODD)).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == linked(ODD)
    assert len(got) == len({i for i, _, _ in ODD})
    assert vector_graph.near_duplicate_vectors(vectors_of(spark, [])).count() == 0


@pytest.mark.parametrize("shard", [2048, 60])
def test_graph_recall(spark, shard):
    """A group of near copies with a third of all rows, exact copies among them, beside smaller groups and single vectors."""
    rng = np.random.default_rng(3)
    heart, copies = rng.normal(size=24), rng.normal(size=(20, 24))
    rows = []
    for i in range(900):
        x = heart + 0.13 * rng.normal(size=24) if i % 3 == 0 else copies[i % 20] + 0.1 * rng.normal(size=24) if i % 3 == 1 else rng.normal(size=24)
        rows.append((i, 0, [float(c) for c in (heart if i % 30 == 0 else x)]))
    got = {r.vec_id: r for r in vector_graph.near_duplicate_vectors(vectors_of(spark, rows), shard=shard).collect()}
    want = linked(rows)
    assert all(got[i].n_links <= n for i, (n, _, _) in want.items())
    assert sum(r.n_links for r in got.values()) >= 0.95 * sum(n for n, _, _ in want.values()) and got[0].recall >= 0.95
    assert sum((got[i].component_id, got[i].kept) == w[1:] for i, w in want.items()) >= 0.99 * len(rows)


def test_graph_cut_by_hash(spark, monkeypatch):
    monkeypatch.setattr(vector_graph, "LEVELS", 0)
    rng = np.random.default_rng(5)
    heart = rng.normal(size=8)
    rows = [(i, 0, [float(c) for c in heart + 0.01 * rng.normal(size=8)]) for i in range(150)]
    got = vector_graph.near_duplicate_vectors(vectors_of(spark, rows), shard=40).collect()
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == linked(rows)


def mined(rows, anchor):
    good = {}
    for i, label, e in rows:
        x = floats(e)
        if i is not None and label is not None and x is not None:
            row = (label, [math.floor(256 * c) for c in x])
            good[i] = min(good.get(i, row), row)
    out = set()
    for a, (label, x) in good.items():
        if not anchor(a):
            continue
        scores = sorted((-sum(p * q for p, q in zip(x, y)), i, other) for i, (other, y) in good.items() if i != a)
        for s, p, _ in [s for s in scores if s[2] == label][:5]:
            hits = [h for h in scores if h[2] != label and 80 * -s <= 100 * -h[0] <= 100 * -s][:5]
            out |= {(a, p, rank, i, -s, -h) for rank, (h, i, _) in enumerate(hits, 1)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    if small:
        for name, value in (("LEAST_SHARD", 40), ("SHARD", 60), ("BLOCK", 16), ("BATCH", 8)):
            monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(2)
    some = [(i, int(rng.integers(0, 3)) if i % 3 else 0, [float(c) for c in rng.normal(size=12) / 3]) for i in range(400)]
    ties = [(i, i % 3, [float(c) for c in rng.integers(-1, 2, size=3)]) for i in range(200)]
    for rows, step in ((some, 7), (ties, 3), (ODD, 10), ([], 1)):
        table = negatives.usable(vectors_of(spark, rows), F.col("label"))
        got = [tuple(r) for r in negatives.hard_negatives(table, F.col("vec_id") % step == 0).collect()]
        assert len(got) == len(set(got)) and set(got) == mined(rows, lambda i: i % step == 0)


def repaired(rows):
    """conv_id -> report columns, by the plain search that keeps the least (cost, audit) of all suffixes."""
    out, next_role, names = {}, {"": "u", "s": "u", "u": "a", "a": "u"}, {"u": "user", "a": "assistant"}
    for conv in {r[0] for r in rows}:
        turns = []
        for c, turn, role, text in rows:
            if c == conv:
                role, text = " " if role is None else role, " " if text is None else text
                kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if turn is None else turn}".encode()) % 20
                text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
                turns += [(turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in turns:
            body = text.strip(" \t\n\v\f\r")
            faults.append("b" if not body else "d" if (role, text) in seen else "" if body[-1] in ".!?" else "t")
            seen.add((role, text))
        best = {"": (0, "", ()), "a": (0, "", ()), "u": (5, "I", ("assistant:",)), "s": (10, "II", ("user:", "assistant:"))}
        for (_, role, text), fault in reversed(list(zip(turns, faults))):
            new = {}
            for s in best:
                ways = [(best[s][0] + 2, "D" + best[s][1], best[s][2])]
                if fault in ("", "t"):
                    more, n, first = 5 * (fault == "t"), next_role[s], role[:1]
                    ways.append((best[n][0] + 1 + more, "R" + best[n][1], (names[n] + ":" + text, *best[n][2])))
                    if first and (first == n or (s == "" and first == "s")):
                        ways.append((best[first][0] + more, "K" + best[first][1], (role + ":" + text, *best[first][2])))
                new[s] = min(ways)
            for _ in range(3):
                for s in new:
                    cost, audit, lines = new[next_role[s]]
                    new[s] = min(new[s], (cost + 5, "I" + audit, (names[next_role[s]] + ":", *lines)))
            best = new
        cost, audit, lines = best[""]
        known, initials = {t for t, _, _ in turns if t is not None}, [r[:1] or "?" for _, r, _ in turns]
        out[conv] = (max(known) - min(known) + 1 - len(known) if known else 0, *[faults.count(f) for f in "bdt"],
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def check_repair(spark, rows, **settings):
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({"copies": F.lit("x"), "part": F.lit(1)})
    got = [tuple(r) for r in dialogs.repair(dialogs.planted(table), **settings).collect()]
    assert len(got) == len({r[0] for r in got}) and {r[0]: r[1:] for r in got} == repaired(rows)


def test_repair_whole_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = queries.op13_rank_viterbi(spark, FOLDER).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == repaired(rows)


def test_repair_odd_rows(spark):
    rnd = random.Random(5)
    texts = [None, "", "  ", "hi.", "go", "x! ", "why?", "é日本。", "long " * 50000, *[f"m{i}." for i in range(40)]]
    rows = [(rnd.choice([None, 0, 1, 2]), rnd.choice([None, *range(30)]), rnd.choice(["user", "assistant"] * 3 + ["system", "", None, "tool"]),
             rnd.choice(texts)) for _ in range(300)]
    check_repair(spark, rows)
    check_repair(spark, [])
    check_repair(spark, [(9, 4, "user", "a."), (0, 0, "user", None)])


def test_repair_by_chunks(spark):
    """Chunks that converge, and chunks of one role, whose vectors keep their rank, beyond the passes: solved by whole matrices."""
    alike = [(1, i, "user", f"m{i}.") for i in range(120)]
    normal = [(2, i, "assistant" if i % 2 else "user", f"m{i}.") for i in range(120)]
    check_repair(spark, alike + normal + alike[:50], chunk=7, passes=1)
    check_repair(spark, alike + normal, chunk=20, passes=20)


def test_rank_converges():
    """Rows that alternate: a rerun from another vector meets the old one within the chunk."""
    codes = bytes([3, 6] * 50)
    assert dialogs.rerun(codes, dialogs.LAST, (5, 0, 7, 3), dialogs.backward(codes, dialogs.LAST))[1]
