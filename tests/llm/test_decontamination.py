"""Small benchmark items beside large ones: found whichever way their shingles are looked for, and without sending all others."""

import random

import pytest

from sentryspark.llm import decontamination as D


def shingles(text, n=5):
    w = text.split()
    return {" ".join(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


@pytest.mark.parametrize("bits", [20, 6, 7])
def test_small_items_equal_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(D, "SIEVE_BITS", bits)
    rng = random.Random(2)
    words = [f"w{k}" for k in range(400)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    items = [text(n) for n in (1, 3, 5, 6, 8, 12, 12, 13, 40, 200)]
    docs = [f"{text(rng.randrange(300))} {rng.choice(items)} {text(rng.randrange(900))}" for _ in range(60)] + items + [text(200), "", None]
    docs = docs + [" ".join(x.split()[:-1]) for x in items]  # all but one shingle
    frames = [spark.createDataFrame(list(enumerate(x)), f"{name} long, text string") for name, x in (("doc_id", docs), ("item_id", items))]
    found = {(r["doc_id"], r["item_id"], r["n_shared"]) for r in D.contaminated(*frames).collect()}
    expected = set()
    for k, d in enumerate(docs):
        own = shingles(d or "")
        for m, item in enumerate(items):
            shared = len(own & shingles(item))
            if shared / len(shingles(item)) >= 0.8:
                expected.add((k, m, shared))
    assert found == expected and len(found) > 40


def test_small_items_send_few_hashes_more(spark):
    rng = random.Random(3)
    docs = spark.createDataFrame([(k, " ".join(rng.choices([f"w{x}" for x in range(5000)], k=600))) for k in range(20)], "id long, text string").select("id", D.words("text").alias("w"))
    few, sets = D.document_minima(docs, 5, []), [r["set"] for r in D._shingles(docs, D._hash, 5).collect()]
    hashes = lambda xs: spark.createDataFrame([(x,) for x in xs], "hash long")
    assert D.sieve(hashes([])) == []
    own, minima = {x for own in sets for x in own[::9]}, few.count()
    longs = D.sieve(hashes(sorted(own)))
    assert len(longs) & (len(longs) - 1) == 0 and sum(x.bit_count() if x >= 0 else (x & ((1 << 64) - 1)).bit_count() for x in longs) <= len(own)
    assert all(longs[(x % (64 * len(longs))) >> 6] >> (x % 64) & 1 for x in own)
    some = D.document_minima(docs, 5, longs)
    sent = [(r["doc_id"], r["hash"]) for r in some.collect()]
    assert len(sent) == len(set(sent)) and own <= {x for _, x in sent}
    assert sorted(map(str, some.where("least").drop("least").collect())) == sorted(map(str, few.drop("least").collect()))
    assert len(sent) <= minima + len(own) + 0.05 * 20 * 596
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "as array<bigint>" not in plan  # that of words(); the sieve's is evaluated once, not once a shingle
    assert D.document_minima(docs, 5, [-1]).count() == 20 * 596  # a full sieve lets everything through


def test_many_small_items(spark, monkeypatch):
    """More small items than a sieve has room for are all found."""
    monkeypatch.setattr(D, "SIEVE_BITS", 8)
    items = [(k, f"a{k} b{k} c{k} d{k} e{k} f{k}") for k in range(1000)]
    docs = [(k, f"before it {' '.join(t for _, t in items[5 * k : 5 * k + 5])} and " + " ".join(f"x{k}y{m}" for m in range(300))) for k in range(200)]
    found = D.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(k // 5, k) for k in range(1000)]
