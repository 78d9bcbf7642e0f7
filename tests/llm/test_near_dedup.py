import random
from itertools import combinations

import numpy as np
import pytest

from sentryspark.llm import near_dedup as nd


def brute(texts: dict[int, str | None], n_words: int, percent: int = 80) -> dict[int, tuple[int, int]]:
    sets = {}
    for k, text in texts.items():
        words = "".join(c.lower() if c.isascii() else c for c in text or "").replace("\xa0", "N").split()
        width = min(n_words, len(words)) or 1
        sets[k] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if words else set()
    root = {k: k for k in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((top(a), top(b)))
            root[y] = x
    return {k: (len(sets[k]), top(k)) for k in texts}


def family(rng: random.Random, n: int, edits: int, size: int = 120) -> list[str]:
    words = [f"w{i}" for i in range(3000)]
    base = [rng.choice(words) for _ in range(size)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(size)] = rng.choice(words)
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("edits", [6, 14])
def test_equals_brute_force(spark, edits):
    rng = random.Random(edits)
    texts = family(rng, 60, edits) + family(rng, 40, edits, 40) + ["", None, "one", "ONE", "one two", "one  two\n", "a b c a b c", "Ä b", "ä b"]
    texts += [" ".join(rng.choice("the of and to in".split()) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    docs = dict(enumerate(texts))
    frame = spark.createDataFrame([(k, t, "x", 1) for k, t in docs.items()], "doc_id long, text string, digest string, id int").repartition(5)
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(frame, n_words=2).collect()}
    assert found == brute(docs, 2)


def test_blocks_and_hot_keys(spark, monkeypatch):
    """Small blocks need the grid, and without broadcasts hot keys are dealt out."""
    from sentryspark.llm import common

    monkeypatch.setattr(nd, "BLOCK_MEMBERS", 4)
    monkeypatch.setattr(nd, "BLOCK_SHINGLES", 600)
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    texts = family(random.Random(3), 80, 16)
    docs = dict(enumerate(texts + texts[:1] * 20 + texts[5:6] * 3 + ["", None] * 3))
    frame = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nd.near_duplicates(frame, n_words=2).collect()}
    assert found == brute(docs, 2)


def test_edges(spark):
    kind = "doc_id long, text string"
    assert nd.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    rows = nd.near_duplicates(spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "a b"), (3, "a b"), (2, "a b"), (5, None)], kind)).collect()
    assert sorted((str(r["doc_id"]), str(r["component_id"]), r["kept"]) for r in rows) == [("2", "2", True), ("3", "2", False), ("3", "2", False), ("5", "5", True), ("None", "None", True), ("None", "None", True)]
    kept = nd.without_near_duplicates(spark.createDataFrame([(1, "a b", 7, 1, 1), (2, "a b", 8, 1, 1), (3, "", 9, 1, 1)], "doc_id long, text string, _x int, gone int, Gone_ int"))
    assert kept.columns == ["doc_id", "text", "_x", "gone", "Gone_"]
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 3]


def test_long_text(spark):
    long = " ".join(f"t{i % 7919}" for i in range(60_000))
    rows = nd.near_duplicates(spark.createDataFrame([(1, long), (2, long + " end"), (3, "short")], "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in rows) == [(1, 1), (2, 1), (3, 3)]


def test_estimate_follows_the_similarity():
    rng = np.random.default_rng(5)
    universe = rng.integers(0, 1 << 62, 4000, dtype=np.uint64)
    for share in (0.0, 0.3, 0.6, 0.9):
        a, b = universe[:1000], np.concatenate([universe[: int(1000 * share)], universe[2000 : 3000 - int(1000 * share)]])
        true = int(1000 * share) / (2000 - int(1000 * share))
        bits = [nd.planes(nd.minima(x)).view(np.uint64) for x in (a, b)]
        assert abs(nd.estimates(bits[0], np.array(bits[1:]))[0] - true) < 0.2
