"""Keys of word sets: exact at every threshold, and few."""

import random
from itertools import combinations

import pytest

from landq.operators import similarity


def variants(rng, vocabulary, sizes, changes):
    """Texts of random words, each followed by near copies with words changed, added or left out."""
    out = []
    for n in sizes:
        base = rng.sample(vocabulary, n)
        out.append(base)
        for _ in range(changes):
            copy = [w for w in base if rng.random() > 0.06] + rng.sample(vocabulary, max(1, n // 15))
            out.append(copy)
    return [" ".join(words) for words in out]


def frame(spark, texts):
    return spark.createDataFrame([(i, None, t) for i, t in enumerate(texts)], "doc_id bigint, land_record_id bigint, ocr_raw_text string")


@pytest.mark.parametrize("threshold", [0.5, 0.7, 0.85, 0.95])
def test_similar_texts_at_any_threshold(spark, threshold):
    rng = random.Random(11)
    vocabulary = [f"ordinary{i:03d}" for i in range(90)]
    texts = variants(rng, vocabulary, [1, 2, 3, 5, 6, 7, 7, 8, 9, 12, 15, 16, 20, 30, 50, 80], 5)
    sets = [set(t.split()) for t in texts]
    want = {k for (i, a), (j, b) in combinations(enumerate(sets), 2) if len(a & b) / len(a | b) > threshold for k in (i, j)}
    assert {r.doc_id for r in similarity.similar_texts(frame(spark, texts), threshold=threshold, min_chars=0, full=2).collect()} == want


def test_longer_keys_do_not_multiply(spark, monkeypatch):
    """Keys of a set are fewer than its words at every length, so what is written stays in proportion to the texts."""
    rng = random.Random(12)
    vocabulary = [f"ordinary{i:03d}" for i in range(150)]
    texts = [" ".join(rng.sample(vocabulary, 100)) for _ in range(300)]
    rows, write = [], similarity.written

    def counted(df, name):
        out = write(df, name)
        rows.append(out.count())
        return out
    monkeypatch.setattr(similarity, "written", counted)
    assert similarity.similar_texts(frame(spark, texts), full=4).count() == 0
    assert sum(rows) < 5 * sum(len(t.split()) for t in texts)
