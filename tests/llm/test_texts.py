"""Exact dedup, line dedup, byte-level BPE, token counts and packing against brute force and the libraries."""

import base64
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sentryspark.llm import byte_bpe, exact_dedup, line_dedup, packing, token_counts

P = pytest.importorskip("public_tokenizers")
KIND = "doc_id long, text string, id string, key string, lang string"
TEXTS = [
    "", None, " ", "a", "A b", "a  b\n\nc", "a b\tc", "the same line of text, long enough\nother\nThe Same Line of text, long enough  ", "  the same line of text, long enough\n\n\n", "x\nthe same line of text, long enough",
    "naïve façade 日本語テキスト 😀👩‍👩‍👧 \x00\x7f﻿", "<|endoftext|> <s> [INST] ▁ ▁▁", "0123456789 12.5e-7 don't I'll WE'VE", "\r\n\r\n   \t\v\f\r x", "аналог данных الْعَرَبِيَّة हिन्दी ไทย", "é" * 50, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "word " * 3000, "z" * 5000,
    "def f(x):\n    return x**2  # square\n", "l'été où ça va?", "　全角　スペース", "a b c", "🏳️‍🌈" * 20,
]


def sha(data: str | bytes) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    alphabet = ["the ", "of ", " ", "\n", "é", "ß", "日", "😀", "a", "Z", "9", "-", "'s", "\t", "▁", " ", "  ", "Ab", ".", ","]
    texts = TEXTS + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(200)]
    rows = [(k, t, "clash", "clash", "en") for k, t in enumerate(texts)] + [(3, "a", "x", "x", "en"), (None, "a", "x", "x", "en"), (None, None, "x", "x", None)]
    return spark.createDataFrame(rows, KIND).repartition(6).cache(), rows


def test_exact_dedup(docs):
    frame, rows = docs
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for doc, text, *_ in rows:
        groups.setdefault(norm(text), []).append(doc)
    expected = sorted((str(d), str(min((x for x in groups[norm(t)] if x is not None), default=None)), len(groups[norm(t)]), sha(norm(t))) for d, t, *_ in rows)
    found = exact_dedup.exact_duplicates(frame).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["text_sha256"]) for r in found) == expected
    assert sum(r["kept"] for r in found) == len(groups)
    for x in ("text_key", "gone_id", "_id", "_sha", "_key"):
        frame = frame.withColumn(x, F.lit("clash"))
    kept = exact_dedup.without_duplicates(frame)
    assert kept.columns == frame.columns
    assert sorted(norm(r["text"]) for r in kept.collect()) == sorted(groups)


def test_exact_dedup_of_many_copies(spark):
    rows = [(k, "copy" if k % 3 else f"own {k}") for k in range(3000)]
    found = exact_dedup.exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(40)).where("kept").collect()
    assert len(found) == 1001 and {r["doc_id"] for r in found if r["group_size"] > 1} == {1}
    assert exact_dedup.exact_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_exact_dedup_when_parallelism_changes(spark, monkeypatch):
    docs = spark.createDataFrame([(k, "copy") for k in range(40)], "doc_id long, text string").repartition(8)
    name, runs = "spark.sql.files.minPartitionNum", exact_dedup.digest_runs

    def later(*args):
        spark.conf.set(name, 8)
        return runs(*args)

    monkeypatch.setattr(exact_dedup, "digest_runs", later)
    spark.conf.set(name, 1)
    try:
        found = exact_dedup.exact_duplicates(docs, fan_in=2).collect()
    finally:
        spark.conf.unset(name)
    assert len(found) == 40 and [r["doc_id"] for r in found if r["kept"]] == [0] and {r["group_size"] for r in found} == {40}


@pytest.mark.parametrize("chunk, block, fan_in", [(1, 1, 2), (3, 2, 3), (256, 64, 8)])
def test_merge_of_chunked_runs(spark, monkeypatch, chunk, block, fan_in):
    monkeypatch.setattr(exact_dedup, "CHUNK", chunk)
    monkeypatch.setattr(exact_dedup, "BLOCK", block)
    rng = random.Random(chunk)
    # digests that two texts share, digests at both ends of the range, checks that end in zeros, and null ids
    texts = [(d, bytes([x]) * 30 + b"\0\0") for d in [-(1 << 63), -5, 0, 7, 8, 9, (1 << 63) - 1] for x in (0, 1, 255)]
    own = [(rng.randrange(2), rng.randrange(7), *rng.choice(texts), rng.choice([None, *range(50)]), row) for row in range(600)]
    order = lambda e: (*e[:4], e[4] is None, e[4] or 0, e[5])
    names = ["shard", "run", "digest", "sha", "keep_id", "keep_row", "n"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    columns = zip(*sorted(((*e, 1) for e in own), key=order), strict=True)
    run = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    batches = list(exact_dedup._run_of_entries(run.slice(at, 50) for at in range(0, len(own), 50)))
    left = 7
    while left > 1:
        left = -(-left // fan_in)
        rows = sorted((r | {"run": r["run"] // fan_in} for b in batches for r in b.to_pylist()), key=lambda r: (r["shard"], r["run"], r["head"]))
        chunks = pa.RecordBatch.from_pylist(rows, batches[0].schema)
        batches = list(exact_dedup._run_of_chunks([chunks.slice(0, 0), chunks]))
        assert max(len(r["digests"]) for b in batches for r in b.to_pylist()) <= chunk
    held = np.concatenate([exact_dedup._unpacked(b) for b in batches])
    expected = {}
    for shard, _, digest, check, id_, row in sorted(own, key=lambda e: (*e[2:4], e[4] is None, e[4] or 0, e[5])):
        least, n = expected.get((shard, digest, check), ((id_, row), 0))
        expected[shard, digest, check] = least, n + 1
    raw = np.ascontiguousarray(held["sha"]).tobytes()
    found = {(e["shard"].item(), e["digest"].item(), raw[32 * k : 32 * k + 32]): ((None if e["absent"] else e["id"].item(), e["row"].item()), e["n"].item()) for k, e in enumerate(held)}
    assert len(held) == len(found) and found == expected
    chunks = spark.createDataFrame([tuple(r.values()) for b in batches for r in b.to_pylist()], exact_dedup._RUN)
    repeated = [(r["digest"], bytes(r["sha"]), r["keep_id"], r["n"]) for r in exact_dedup.repeated(chunks).collect()]
    assert sorted(repeated, key=str) == sorted(((d, s, i, n) for (_, d, s), ((i, _), n) in expected.items() if n > 1), key=str)


def test_merge_rounds_sort_no_entries(spark):
    runs = spark.createDataFrame([], exact_dedup._RUN)
    plan = exact_dedup.merge_round(runs, 8, 4)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Sort [") == 1 and "Sort [shard" in plan and "head" in plan.split("Sort [")[1].split("]")[0]


def test_exact_dedup_without_broadcasts(docs, monkeypatch):
    from sentryspark.llm import common

    expected = sorted(map(str, exact_dedup.exact_duplicates(docs[0]).collect()))
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 1)
    assert sorted(map(str, exact_dedup.exact_duplicates(docs[0]).collect())) == expected


@pytest.mark.parametrize("by_list", [False, True])
def test_line_dedup(docs, by_list, monkeypatch):
    from sentryspark.llm import common

    if by_list:
        monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
        monkeypatch.setattr(common, "HOT_ROWS", 1)
    frame, rows = docs
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(" \t\n\v\f\r"))
    holders = {}
    for doc, text, *_ in rows:
        if doc is not None:
            for k in {key(x) for x in (text or "").split("\n")}:
                holders.setdefault(k, set()).add(doc)
    gone = {k: max(v) for k, v in holders.items() if len(k) >= 20 and len(v) >= 3}
    expected = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        left = [x for x in lines if doc is None or key(x) not in gone or gone[key(x)] == doc]
        expected.append((str(doc), len(lines), len(lines) - len(left), "\n".join(left)))
    assert gone
    found = line_dedup.without_repeated_lines(frame).collect()
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in found) == sorted(expected)
    assert line_dedup.without_repeated_lines(frame.limit(0)).count() == 0


def test_line_runs(spark):
    frame = lambda *rows: spark.createDataFrame([(i, k.encode()) for i, k in rows], "id long, key binary")
    runs = line_dedup.LineRuns(spark, fan_in=2)
    for n in range(5):
        runs.add(frame((n, "common"), (n, f"own{n}"), (n, f"pair{n // 2}")))
    assert [len(x) for x in runs.levels] == [1, 0, 1]
    assert sorted(bytes(r["key"]) for r in runs.unseen(frame((9, "common"), (9, "own3"), (9, "new"))).collect()) == [b"new"]
    entries = [bytes(r["key"]) for run in runs.runs() for r in spark.table(run).collect()]
    assert len(entries) == len(set(entries)) == 9
    with line_dedup._sorted_scans(spark):
        plan = runs._merged(runs.runs())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    assert [(bytes(r["key"]), r["n_docs"], r["max_id"]) for r in runs.repeated(3).collect()] == [(b"common", 5, 4)]
    runs.close()


def test_byte_bpe_is_the_library(docs):
    import tiktoken

    frame, rows = docs
    path = P.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = [library.encode_ordinary(t or "") for _, t, *_ in rows]
    expected = sorted((str(d), len(ids), sha(",".join(map(str, ids))), sha(t or "")) for (d, t, *_), ids in zip(rows, own, strict=True))
    found = byte_bpe.round_trips(frame, path, P.PATTERN, keep=("lang",)).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in found) == expected
    ids = byte_bpe.encoded(frame.where("doc_id = 10"), path, P.PATTERN)
    assert bytes(byte_bpe.decoded(ids, path, P.PATTERN).first()["bytes"]) == TEXTS[10].encode()


@pytest.mark.parametrize("name", ["exact", "line", "bpe", "counts", "packing", "language", "leaks"])
def test_empty_tables_and_very_long_texts(spark, name):
    from sentryspark.llm import decontamination, language_id

    bpe, pieces = P.path("byte_bpe_50k.tiktoken"), P.path("piece_bpe_32k.model")
    model = language_id.fit(spark.createDataFrame([(k, "word other", "en") for k in range(4)], "doc_id long, text string, lang string"))
    items = spark.createDataFrame([(1, "a rare line of seven words indeed here")], "item_id long, text string")
    run = {
        "exact": exact_dedup.exact_duplicates, "line": line_dedup.without_repeated_lines, "bpe": lambda d: byte_bpe.round_trips(d, bpe, P.PATTERN), "counts": lambda d: token_counts.token_counts(d, pieces, budgets=(10,)),
        "packing": lambda d: packing.packed(d, bpe, P.PATTERN, 50256, row_tokens=1 << 16), "language": lambda d: language_id.identified(d, model), "leaks": lambda d: decontamination.contaminated(d, items),
    }[name]
    kind = "doc_id long, text string"
    assert run(spark.createDataFrame([], kind)).count() == 0
    long = "word other\n" * 180_000 + "a rare line of seven words indeed here\n"
    found = run(spark.createDataFrame([(1, long), (2, long), (3, long), (4, None)], kind)).collect()
    expected = {"packing": None, "leaks": 3}.get(name, 4)
    assert expected is None or len(found) == expected
    if name == "line":
        assert {r["doc_id"]: r["n_dropped"] for r in found} == {1: 1, 2: 1, 3: 0, 4: 0}


def test_kept_columns_may_have_any_name(spark):
    docs = spark.createDataFrame([(1, "a", 7, "x")], "doc_id long, text string, id int, kept0 string")
    path = P.path("byte_bpe_50k.tiktoken")
    assert byte_bpe.round_trips(docs, path, P.PATTERN, keep=("id", "kept0")).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "id", "kept0"]
    with pytest.raises(ValueError, match="doc_id"):
        byte_bpe.round_trips(docs, path, P.PATTERN, keep=("doc_id",))


def test_perfect_hash():
    keys = [f"k{i}".encode() for i in range(5000)]
    table = byte_bpe.MinimalPerfectHash(keys)
    assert sorted(map(table.slot, keys)) == list(range(5000))


def test_token_counts_are_the_library(docs):
    import sentencepiece

    frame, rows = docs
    path = P.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    expected = sorted((str(d), len((t or "").encode()), len(library.encode(t or ""))) for d, t, *_ in rows)
    for budgets in ((), (40,)):  # by totals, and by tables of prefixes
        found = token_counts.token_counts(frame, path, budgets=budgets).collect()
        assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"]) for r in found) == expected
        if budgets:
            texts = {d: t or "" for d, t, *_ in rows if d is not None and d > 3}
            whole = lambda text, k: len(library.encode(text[:k])) <= 40
            assert all(whole(texts[r["doc_id"]], r["fits"][0]) for r in found if r["doc_id"] in texts)
            assert all(r["fits"][0] == max(k for k in range(len(t) + 1) if whole(t, k)) for r in found if (t := texts.get(r["doc_id"])) is not None and len(t) < 400)


def test_every_prefix_counts():
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), token_counts.PrefixCounter(path)
    for text in ("The quick brown fox — 3.5 naïve 日本 don't", "  two  spaces\nline", "a", "", "unbelievable😀!?"):
        table = own.prefixes(text)
        assert table.all() == [len(library.encode(text[:k])) for k in range(len(text) + 1)]
        assert table.truncate(3) == max(k for k in range(len(text) + 1) if len(library.encode(text[:k])) <= 3)


def test_packing_loses_nothing(docs):
    import tiktoken

    frame, rows = docs
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = packing.packed(frame.where("doc_id is not null and id = 'clash'"), path, P.PATTERN, 50256, row_tokens=64, shard_rows=8).collect()
    texts = {}
    for row in found:
        ids, positions = np.frombuffer(row["ids"], "<u2"), np.frombuffer(row["position_ids"], "<u4")
        assert len(ids) == len(positions) == 64 and row["cu_seqlens"][-1] == row["n_tokens"] <= 64 and (ids[row["n_tokens"] :] == 50256).all()
        assert [s["start"] for s in row["segments"]] == row["cu_seqlens"][:-1]
        for s in row["segments"]:
            part = slice(s["start"], s["start"] + s["length"])
            assert positions[part].tolist() == list(range(s["length"]))
            texts.setdefault(s["doc_id"], {})[s["piece"]] = ids[part].tolist()
    joined = {d: [x for k in sorted(p) for x in p[k]] for d, p in texts.items()}
    assert joined == {d: [*library.encode_ordinary(t or ""), 50256] for d, t, i, *_ in rows if d is not None and i == "clash"}


def test_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(30):
        sizes = [rng.randint(1, 40) for _ in range(rng.randint(1, 80))]
        rooms, expected = [], []
        for k in sorted(range(len(sizes)), key=lambda k: -sizes[k]):
            fits = [r for r in rooms if r >= sizes[k]]
            if fits:
                rooms.remove(min(fits))
                rooms.append(min(fits) - sizes[k])
            else:
                rooms.append(40 - sizes[k])
            expected.append(k)
        rows = packing.best_fit_decreasing(sizes, 40)
        assert sorted(k for r in rows for k in r) == sorted(expected)
        assert sorted(40 - sum(sizes[k] for k in r) for r in rows) == sorted(rooms)
