"""Ratios of dossier values: fixed results, bounds ahead of Python, and the same verdicts with and without them."""

import random
from difflib import SequenceMatcher
from itertools import combinations

from pyspark.sql import functions as F

from landq import dims
from landq.operators import crossdoc

#: Lowest ratios worked out by hand: blocks found longest first, twice their length to the length of both texts.
GOLDEN = [(["abcd", "bcde"], 0.75), (["ramesh kumar", "ramesh kumaar"], 0.96), (["12/4", "12/5"], 0.75), (["abc", "xyz"], 0.0),
          (["ab", "ba"], 0.5), (["asha", "asha devi", "a devi"], 0.2), (["రమేష్", "రమేశ్"], 0.8)]


def test_golden_ratios(spark):
    df = spark.createDataFrame([(t,) for t, _ in GOLDEN] + [(None,)], "texts array<string>")
    got = [r[0] for r in df.select(crossdoc.lowest_similarity(F.col("texts"))).collect()]
    assert got[-1] is None
    assert all(abs(a - b) < 1e-12 for a, (_, b) in zip(got, GOLDEN)), got


def test_bounds_are_above_the_ratio(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("abc \U0001F600్") for _ in range(rng.randrange(1, 14))) for _ in range(40)] + [""]
    pairs = [(a, b) for a, b in combinations(texts, 2) if a or b]
    df = spark.createDataFrame(pairs, "a string, b string").select(
        "a", "b", crossdoc.lengths_bound(F.col("a"), F.col("b")).alias("long"), crossdoc.similarity_bound(F.col("a"), F.col("b")).alias("same"))
    for r in df.collect():
        matcher = SequenceMatcher(None, r.a, r.b)
        assert (r.long, r.same) == (matcher.real_quick_ratio(), matcher.quick_ratio())
        assert r.long >= r.same >= matcher.ratio()


def test_verdicts_do_not_depend_on_the_bounds(spark):
    rng = random.Random(5)
    names = ["Asha Devi", "Asha Dewi", "Ravi Kumar", "ravi  kumar", "Ravi Kumarr", "12/4", "12/4A", dims.NOT_FOUND, dims.NO_DOCUMENT, "", "Meena"]
    rows = [(str(i), rng.choice(["land_area", "owner_name", "village"]), *[rng.choice(names) for _ in dims.DOSSIER_BUCKETS]) for i in range(600)]
    matrix = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in ["dossier", "field_key", *dims.DOSSIER_BUCKETS]))
    exact, quick = (crossdoc.evaluate_fields(matrix, exact=e) for e in (True, False))
    shown = ["dossier", "field_key", "status", "notes"]
    assert sorted(exact.select(*shown).collect()) == sorted(quick.select(*shown).collect())
    all_rows, few = (d.where("similarity is not null").count() for d in (exact, quick))
    assert 0 < few < all_rows / 2  # rows that reach Python
