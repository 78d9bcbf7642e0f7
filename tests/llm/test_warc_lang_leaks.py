"""WARC round trips, language ID on held-out rows and spans, decontamination against brute force."""

import base64
import hashlib
import io
import random
import re
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentryspark.llm import decontamination, language_id, warc
from tests.conftest import SMALL

# -- WARC -------------------------------------------------------------------


def test_archives_round_trip(spark, tmp_path):
    pages = [(1, "http://a/", "x"), (2, "http://b/ c\nd", "x"), (3, None, None), (4, "http://d/", ""), (5, "u", "é日😀" * 1000), (6, "u", "WARC/1.1\r\n\r\n"), (None, "u", "x"), (7, "u", "y"), (7, "u", "y"), (8, "u", "\r\n\r\n\x00\x00")]
    frame = spark.createDataFrame([(*p, "clash", "clash") for p in pages], "page_id long, url string, html string, digest string, id string").repartition(3)
    warc.write_archives(frame, str(tmp_path / "w"))
    found = warc.read_archives(spark, str(tmp_path / "w")).where("record_type <> 'warcinfo'").collect()
    sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
    expected = []
    for num, _, html in pages:
        body = (html or "").encode()
        keeper = max(n for n, _, h in pages if n is not None and (h or "") == (html or ""))
        expected.append((str(num), len(body), sha(body), "response" if num == keeper else "revisit", None if num == keeper else keeper, body if num == keeper else None))
    assert sorted(map(str, ((str(r["page_id"]), r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"]) if r["payload"] is not None else None) for r in found))) == sorted(map(str, expected))
    assert {r["url"] for r in found if r["page_id"] == 2} == {"http://b/%20c%0Ad"} and {r["url"] for r in found if r["page_id"] == 3} == {"about:blank"}


def test_empty_table(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "e"))
    assert warc.read_archives(spark, str(tmp_path / "e")).count() == 0


def test_hot_payload_without_broadcast(spark, tmp_path, monkeypatch):
    from sentryspark.llm import common

    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(common, "HOT_ROWS", 2)
    frame = spark.createDataFrame([(k, "u", "same" if k % 3 else f"own {k}") for k in range(60)], "page_id long, url string, html string")
    warc.write_archives(frame, str(tmp_path / "w"))
    found = {r["page_id"]: r["refers_to"] for r in warc.read_archives(spark, str(tmp_path / "w")).where("page_id is not null").collect()}
    assert found == {k: 59 if k % 3 and k != 59 else None for k in range(60)}


@pytest.mark.parametrize("chunk", [1, 7, 1 << 16])
def test_foreign_records_read_piece_by_piece(spark, tmp_path, monkeypatch, chunk):
    monkeypatch.setattr(warc, "CHUNK", chunk)

    def record(kind, block, *lines):
        return "\r\n".join(["WARC/1.0", f"WARC-Type: {kind}", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"

    rows = [
        record("warcinfo", b"software: other\r\n"), record("request", b"GET / HTTP/1.1\r\n\r\n", "WARC-Target-URI: http://a/"), record("response", b"HTTP/1.1 200 OK\r\n\r\nbody\r\n\r\nmore", "WARC-Target-URI: http://a/", "WARC-Record-ID: <urn:uuid:1>"),
        record("resource", b"plain"), record("metadata", b""), record("response", b"HTTP/1.1 200 OK\r\n\r\n" + b"x" * 3_000_000 if chunk > 7 else b"no head"),
    ]
    data = b"\0\0".join(map(warc.member, rows)) + b"\0"
    found = [warc._row(x) for x in warc.records(io.BytesIO(data))]
    assert [r[1] for r in found] == ["warcinfo", "request", "response", "resource", "metadata", "response"]
    assert [r[6] for r in found[:5]] == [None, None, b"body\r\n\r\nmore", b"plain", None] and found[2][4] == warc.sha1_base32(b"body\r\n\r\nmore") and found[2][5] == 12
    assert found[0][2] is None and found[2][2] == "http://a/" and found[2][0] is None
    for bad in (data[:-3], data + b"\x1f\x8b", data + b"junk"):
        with pytest.raises((ValueError, zlib.error)):
            list(warc.records(io.BytesIO(bad)))
    (tmp_path / "x.warc").write_bytes(data)
    assert warc.read_archives(spark, str(tmp_path / "x.warc")).count() == 6


def test_archives_begin_with_their_description(spark, tmp_path):
    warc.write_archives(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"), str(tmp_path / "w"))
    assert [r["record_type"] for r in warc.read_archives(spark, str(tmp_path / "w")).collect()] == ["warcinfo", "response"]


def test_damage_is_noticed():
    good = warc.record(1, "u", b"payload")
    for bad in (good.replace(b"payload", b"paylOad"), good[:-1], b"nothing", good.replace(b"Content-Length: ", b"Content-Length: 1", 1)):
        with pytest.raises((ValueError, KeyError)):
            warc.parse(bad)
    whole = warc.member(good)
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(io.BytesIO(whole[:-9])))


# -- language ID ------------------------------------------------------------


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.language_id_query(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang", "text"), "doc_id").where("held_out and lang is not null and lang_pred <> 'und'")
    right, n, worst, best = found.selectExpr("count_if(lang = lang_pred)", "count(*)", "min(score)", "max(score)").first()
    assert n > 100 and right / n > 0.97 and 0 <= worst <= best <= 1


def test_accuracy_of_each_language_and_of_short_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("lang is not null")
    from pyspark.sql import functions as F

    model = language_id.fitted_on(docs)
    rows = docs.where(language_id.held_out()).select("doc_id", "lang", "text", F.substring("text", 1, 60).alias("head")).collect()
    for what, least in (("text", 0.93), ("head", 0.8)):
        predicted = language_id.labelled_texts(model, [r[what] or "" for r in rows])[0]
        for lang in model.languages:
            own = [p == lang for p, r in zip(predicted, rows, strict=True) if r["lang"] == lang and p != "und"]
            assert len(own) > 10 and sum(own) / len(own) > least, (what, lang)


def test_letters_of_every_plane(spark):
    model = language_id.fit(spark.createDataFrame([(k, "the of and", "en") for k in range(4)], "doc_id long, text string, lang string"))
    odd = ["".join(map(chr, range(at, at + 20))) for at in (0x17000, 0x18B00, 0x1BC00, 0x1E900, 0x31350)]  # Tangut, Khitan, Duployan, Adlam, Han
    assert language_id.labelled_texts(model, odd)[0] == ["en"] * 5
    assert not any((language_id.letters()[0][ord(c)] > 0) != c.isalpha() for c in map(chr, [*range(0x41, 0xD800), *range(0xE000, 0x40000, 3)]))
    many = spark.createDataFrame([(k, "the", f"l{k}") for k in range(language_id.MAX_LANGUAGES + 1)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(many)


def test_best_path_equals_plain_viterbi():
    rng = np.random.default_rng(2)
    lengths = np.array([0, 1, 63, 64, 65, 200, 0, 7])
    scores = rng.normal(0, 6, (int(lengths.sum()), 3)).astype(np.float32)
    found, at = language_id.best_paths(scores, lengths, 8.0), 0
    for n in lengths:
        own = scores[at : at + n]
        if n:
            value, back = own[0].copy(), []
            for row in own[1:]:
                ways = value[:, None] - 8.0 * (1 - np.eye(3))
                back.append(ways.argmax(axis=0))
                value = row + ways.max(axis=0)
            total = lambda path, own=own: sum(own[k][x] for k, x in enumerate(path)) - 8.0 * sum(a != b for a, b in zip(path, path[1:], strict=False))
            assert total(found[at : at + n].tolist()) == pytest.approx(float(value.max()), abs=1e-2)
        at += n


def test_spans_and_odd_texts(spark):
    rng = random.Random(3)
    latin, greek = ["the", "of", "and", "that", "with"], ["και", "το", "της", "είναι"]
    rows = [(k, " ".join(rng.choice(latin if k % 2 else greek) for _ in range(30)), "en" if k % 2 else "el", "clash") for k in range(100)]
    kind = "doc_id long, text string, lang string, id string"
    model = language_id.fit(spark.createDataFrame(rows, kind))
    mixed = " ".join(latin * 6) + ". " + " ".join(greek * 6)
    texts = [(1, mixed), (2, None), (3, ""), (4, "123 !? \n"), (5, "ภาษาไทย"), (None, "the of and"), (7, "και το " * 100_000)]
    found = {r["doc_id"]: r for r in language_id.identified(spark.createDataFrame(texts, "doc_id long, text string"), model, spans=True).collect()}
    assert [found[k]["lang_pred"] for k in (2, 3, 4)] == ["und"] * 3 and found[None]["lang_pred"] == "en" and found[7]["lang_pred"] == "el"
    spans = [(s["lang"], mixed[s["start"] : s["end"]]) for s in found[1]["spans"]]
    assert [x for x, _ in spans] == ["en", "el"] and spans[1][1].startswith("και") and spans[0][1].endswith("with")
    assert found[5]["score"] == 0
    frame = spark.createDataFrame([(*t, "en", "x") for t in texts], kind)
    kept = language_id.of_known_language(frame, model)
    assert kept.columns == frame.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "7", "None"]
    empty = language_id.fit(spark.createDataFrame([], kind))
    assert [r["lang_pred"] for r in language_id.identified(frame.where("doc_id = 1"), empty).collect()] == ["und"]


def test_gibberish_and_unlearned_languages_go(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    finnish = "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä."
    turkish = "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler."
    gibberish = " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(40))
    planted = [finnish, turkish, gibberish, gibberish.upper(), base64.b64encode(rng.randbytes(300)).decode()]
    clean = [r["text"] for r in docs.where("n_chars > 500").groupBy("lang").agg(F.min_by("text", "doc_id").alias("text")).orderBy("lang").collect()]
    clean += ["\n".join(clean), clean[0][:12], clean[0].upper()]
    frame = docs.unionByName(spark.createDataFrame([(10**6 + k, t, None, "x", len(t)) for k, t in enumerate(planted + clean)], docs.schema))
    model = language_id.fitted_on(docs)
    assert len(model.languages) == 4
    assert all(s > 0.2 for s in language_id.labelled_texts(model, planted)[1])  # the share of letters sees nothing
    gone = sorted(r["doc_id"] for r in frame.join(language_id.of_known_language(frame, model), "doc_id", "left_anti").collect())
    assert gone == [10**6 + k for k in range(len(planted))]


# -- decontamination --------------------------------------------------------


def shingle_set(text):
    words = [w for w in re.split(r"[^\w]+|_+", (text or "").lower()) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_containment_equals_brute_force(spark):
    rng = random.Random(8)
    vocabulary = [f"v{i}" for i in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {k: say(rng.choice([1, 3, 5, 6, 8, 12, 40, 90])) for k in range(40)} | {98: [], 99: say(30)}
    docs = {}
    for k in range(150):
        words = say(rng.choice([0, 4, 30, 300, 3000]))
        if k % 3 == 0:
            item = list(items[rng.randrange(40)])
            if k % 2 and len(item) > 20:
                item[rng.randrange(len(item))] = "changed"
            at = rng.randint(0, len(words))
            words[at:at] = item
        docs[k] = words
    docs[500] = list(items[3])
    item_rows = [(k, " ".join(w).upper() if k % 2 else ", ".join(w), "clash") for k, w in items.items()] + [(97, None, "x"), (None, "v1 v2 v3 v4 v5 v6", "x")]
    doc_rows = [(k, " ".join(w), "clash", 1) for k, w in docs.items()] + [(600, None, "x", 1), (None, " ".join(items[5]), "x", 1), (500, " ".join(items[4]), "x", 1)]
    found = decontamination.contaminated(spark.createDataFrame(doc_rows, "doc_id long, text string, item_id string, hash int"), spark.createDataFrame(item_rows, "item_id long, text string, doc_id string"))
    sets, theirs = {}, {}
    for rows, into in ((doc_rows, sets), (item_rows, theirs)):
        for num, text, *_ in rows:
            if num is not None:
                into[num] = into.get(num, set()) | shingle_set(text)
    expected = sorted((d, i, len(sets[d] & theirs[i]), len(theirs[i])) for d, i in product(sets, theirs) if theirs[i] and len(sets[d] & theirs[i]) >= 0.8 * len(theirs[i]))
    assert len(expected) > 30
    assert sorted((r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in found.collect()) == expected
    frame = spark.createDataFrame(doc_rows, "doc_id long, text string, item_id string, hash int")
    kept = decontamination.without_leaks(frame, spark.createDataFrame(item_rows, "item_id long, text string, doc_id string"))
    assert kept.columns == frame.columns
    clashing = frame.withColumn("leaking", frame["hash"])
    assert decontamination.without_leaks(clashing, spark.createDataFrame(item_rows, "item_id long, text string, doc_id string")).columns == clashing.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r[0]) for r in doc_rows if r[0] not in {e[0] for e in expected})


def test_recall_just_above_the_threshold(spark):
    """Items of 9 to 30 shingles, of which a long document holds 80 to 85 percent."""
    rng, rows, items = random.Random(21), [], []
    say = lambda n: [f"w{rng.randrange(40_000)}" for _ in range(n)]
    for k in range(300):
        item = say(rng.randint(9, 30) + 4)
        n = len(item) - 4
        cut = n - -(-n * 8 // 10)  # shingles that may be lost
        part = item[: len(item) - cut] if k % 2 else item[cut:]
        items.append((k, " ".join(item)))
        rows.append((k, " ".join(say(rng.randint(50, 1500)) + part + say(rng.randint(50, 1500)))))
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert found == {(k, k) for k in range(300)}


def test_decontamination_of_nothing(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    some = spark.createDataFrame([(1, "a b c d e f")], docs)
    assert decontamination.contaminated(some, spark.createDataFrame([], items)).count() == 0
    assert decontamination.contaminated(spark.createDataFrame([], docs), spark.createDataFrame([(1, "a b c d e f")], items)).count() == 0


# -- pipeline ---------------------------------------------------------------


def test_pipeline_stages(spark):
    import corpus_pipeline as cp
    from sentryspark.llm.near_dedup import shingles
    from sentryspark.llm.common import stored

    docs = before = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in cp.STAGES[:-1]:
        docs = stored(stage(spark, docs, SMALL), f"test-{name}")
        assert docs.columns == before.columns
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "language_id":
            assert all(t is None or not any(c.isalpha() for c in t) for k, t in rows.items() if k not in kept)
        elif name == "exact_dedup":
            first = {}
            for k in sorted(rows):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", rows[k]), k)
            assert sorted(kept) == sorted(first.values())
        elif name == "near_dedup":
            sets = {k: set(shingles(t, 5).tolist()) for k, t in rows.items()}
            close = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
            root = {k: k for k in rows}
            for a in sorted(rows):
                for b in sorted(rows):
                    if a < b and root[a] != root[b] and sets[a] and sets[b] and close(a, b):
                        x, y = sorted((root[a], root[b]))
                        root = {k: x if v == y else v for k, v in root.items()}
            assert sorted(kept) == sorted(k for k, v in root.items() if k == v)
        else:
            items = [shingle_set(r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
            assert sorted(kept) == sorted(k for k, t in rows.items() if not any(i and len(shingle_set(t) & i) >= 0.8 * len(i) for i in items))
        rows = kept
    last = cp.STAGES[-1][1](spark, docs, SMALL).collect()
    assert {r["doc_id"]: r["decoded_sha256"] for r in last} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in rows.items()}
    assert cp.run(spark, SMALL).count() == len(rows)


def test_language_model_learns_from_every_row(spark):
    """A word is only in rows that a draw of 2,000 by the ids' hash would have left out."""
    ids = spark.range(3000).select(F.col("id").alias("doc_id"), F.pmod(F.xxhash64("id"), F.lit(1_000_000)).alias("place"))
    own = ids.select("doc_id", F.when(F.col("place") < 666_667, "mnolk").otherwise("pqrst").alias("text"), F.lit("xx").alias("lang"))
    other = spark.range(3000, 3010).select(F.col("id").alias("doc_id"), F.lit("pqrst" + " vwxyz" * 10).alias("text"), F.lit("yy").alias("lang"))
    model = language_id.fit(own.unionByName(other))
    assert language_id.labelled_texts(model, ["pqrst pqrst", "vwxyz"])[0] == ["xx", "yy"]
