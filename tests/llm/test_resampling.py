"""Importance resampling against a plain computation, chunks against whole texts, and odd input."""

import hashlib
import math
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sentryspark.llm import resampling as R

SCHEMA = "doc_id long, text string, rank string, row string, weight string"


def plain(docs, target, max_words, bins, min_words, percent):
    words = lambda t: [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    runs = lambda w: [" ".join(w[i : i + n]) for n in range(1, max_words + 1) for i in range(len(w) - n + 1)]
    of = lambda x: zlib.crc32(x.encode()) % bins
    feats = [[of(x) for x in runs(words(t))] for _, t in docs]
    theirs = [of(x) for t in target for x in runs(words(t))]
    count = lambda xs: {k: xs.count(k) for k in set(xs)}
    s, t = count([x for f in feats for x in f]), count(theirs)
    gain = [math.floor(1000 * math.log((t.get(k, 0) + 1) * (sum(s.values()) + bins) / ((s.get(k, 0) + 1) * (sum(t.values()) + bins)))) for k in range(bins)]
    out = []
    for (num, text), f in zip(docs, feats, strict=True):
        w = sum(gain[x] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if num is None else num}".encode()).hexdigest()[:8], 16)
        out.append([num, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words(text))])
    able = sorted((x for x in out if x[5] >= min_words), key=lambda x: (-x[3], -1 if x[0] is None else x[0]))
    for k, x in enumerate(able[: percent * len(able) // 100]):
        x[4] = k + 1
    return sorted((tuple(x[:5]) for x in out), key=repr)


def found(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=repr)


@pytest.mark.parametrize("max_words", [1, 2, 3])
@pytest.mark.parametrize("points", [5, 1 << 16])
def test_equals_plain(spark, max_words, points):
    texts = [None, "", "...", "One two, THREE four-five", "one one one two", "élan vital and élan vital", "x" * 300 + " y " * 40, "deux trois, quatre", "one two three four five six seven"]
    docs = [(k, t) for k, t in enumerate(texts * 4)] + [(None, "one two three"), (3, "one two three")]
    frame = spark.createDataFrame([(num, t, "a", "b", "c") for num, t in docs], SCHEMA)
    target = ["one two", None, "vital four"]
    got = R.resampled(frame, spark.createDataFrame([(x,) for x in target], "text string"), max_words=max_words, bins=50, min_words=2, percent=50, points=points)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert found(got) == plain(docs, target, max_words, 50, 2, 50)


def test_empty_tables(spark):
    docs, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "text string")
    assert R.resampled(docs, target).count() == 0
    some = spark.createDataFrame([(1, "a b c", "", "", "")], SCHEMA)
    assert found(R.resampled(some, target, bins=10, min_words=1)) == plain([(1, "a b c")], [], 1, 10, 1, 10)


def test_long_text_is_dealt_out(spark):
    text = " ".join(f"w{k % 977}" for k in range(60_000))
    docs = spark.createDataFrame([(1, text, "", "", ""), (2, "w1 w2", "", "", "")], SCHEMA)
    short, long = R.chunked(docs, max_words=2, points=1000)
    assert short.count() == 1
    assert long.count() > 250 and long.agg({"owned": "sum"}).first()[0] == 60_000
    assert found(R.resampled(docs, docs, max_words=2, min_words=1, percent=100, points=1000)) == plain([(1, text), (2, "w1 w2")], [text, "w1 w2"], 2, R.BUCKETS, 1, 100)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aB9 é.-\n", max_size=80), st.integers(1, 12), st.integers(1, 4))
def test_chunks_own_each_run_once(text, points, max_words):
    words = R.words_of(text)
    parts = [run for chunk, owned in R.chunks_of(text, points, max_words - 1) for run in R.runs_of(R.words_of(chunk), owned, max_words)]
    assert sorted(parts) == sorted(R.runs_of(words, len(words), max_words))
