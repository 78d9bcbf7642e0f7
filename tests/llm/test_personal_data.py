"""Bootstrapped personal data: strict forms against the contract's patterns, the scoring against a plain loop, planted unseen identifiers, odd input."""

import hashlib
import math
import random
import re
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st

from sentryspark.llm import personal_data as P

SCHEMA = "doc_id long, text string, row string, found string, kind string, score string"


def by_contract(text):
    luhn = lambda d: sum(sum(divmod(int(x) * (1 + k % 2), 10)) for k, x in enumerate(reversed(d))) % 10 == 0
    digits = lambda x: re.sub("[^0-9]", "", x)
    forms = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda x: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda x: all(int(p) <= 255 for p in x.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda x: 16 <= len(digits(x)) <= 19 and luhn(digits(x))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda x: 8 <= len(digits(x)) <= 15),
    }
    return [(k, m.start(), m.end()) for k, (form, good) in forms.items() for m in re.finditer(form, text) if good(m[0])]


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet=st.sampled_from("a@.-+ 0127()%é"), max_size=60))
def test_strict_forms_of_noise(text):
    assert P.base_spans(text) == by_contract(text)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a@b.c", "x@y", "1.2.3.4", "256.1.1.1", "4111111111111111", "4111 1111-1111 1111", "+1 (743) 555-3824", "+1", " ", ".", "@", "é", "0", "4111111111111112", "00001.2.3.4"]), max_size=12))
def test_strict_forms_of_parts(parts):
    text = "".join(parts)
    base = P.base_spans(text)
    assert base == by_contract(text)
    loose = P.loose_spans(text, base)
    taken = sorted([(a, b) for _, a, b in base] + [(a, b) for a, b, _ in loose], key=lambda x: x[0])
    for a, b, _ in loose:
        assert sum(a < y and x < b for x, y in taken) == 1  # only itself


def plain(docs, rounds, accepted, trusted):
    """(doc, found) by loops over all occurrences."""
    seen, edges, known = [], defaultdict(set), {}
    for num, text in docs:
        text = text or ""
        base = P.base_spans(text)
        for a, b, kinds, seed in [(a, b, (k,), True) for k, a, b in base] + [(a, b, k, False) for a, b, k in P.loose_spans(text, base)]:
            for kind in kinds:
                name = (kind, P.normal_form(kind, text[a:b]))
                if seed:
                    known[name] = 1.0
                else:
                    seen.append((num, a, b, name))
                for pattern in P.contexts(text, a, b):
                    edges[pattern].add(name)
    for _ in range(rounds):
        misses = defaultdict(lambda: 1.0)
        for names in edges.values():
            whole = sum(x in known for x in names)
            for kind in P.KINDS:
                pos, unknown = (sum(x[0] == kind and (x in known) == y for x in names) for y in (True, False))
                if pos:
                    n = whole + P.UNKNOWN_WEIGHT * unknown
                    share, z = pos / n, P.CAUTION
                    low = round((share + z * z / (2 * n) - z * math.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9)
                    if low >= trusted:
                        for x in names:
                            if x[0] == kind and x not in known:
                                misses[x] *= 1 - low
        new = {x: round(1 - v, 6) for x, v in misses.items() if round(1 - v, 6) >= accepted}
        if not new:
            break
        known |= new
    best = {}
    for num, a, b, name in seen:
        if name in known:
            mine = (known[name], -P.KINDS.index(name[0]))
            best[num, a, b] = max(best.get((num, a, b), (0, 0)), mine)
    return {(num, P.KINDS[-k], a, b, round(score, 5)) for (num, a, b), (score, k) in best.items()}


def corpus():
    rng = random.Random(5)
    filler = "red blue green house tree river stone cloud bread water".split()
    some = lambda: " ".join(rng.choices(filler, k=rng.randrange(3, 9)))
    phone = lambda: f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(10000):04}"
    docs = []
    for k in range(60):
        docs.append(f"{some()} please call me at {phone()} today {some()}")
        docs.append(f"{some()} write to {rng.choice('abcd')}{k}@mail.example.com for more {some()}")
        docs.append(f"{some()} from host {rng.randrange(256)}.{rng.randrange(256)}.1.{k} with {some()} {phone()} {some()}")
    docs += [f"{some()} please call me at 0{rng.randrange(100, 999)} {rng.randrange(1000, 9999)} {k:03} today {some()}" for k in range(9)]  # unseen, in the pattern of phones
    docs += [f"{some()} write to user{k} at corp dot example dot org for more {some()}" for k in range(5)]
    docs += [f"{some()} write to root{k}@localhost for more {some()}" for k in range(5)]
    docs += [f"{some()} order number {rng.randrange(10**8, 10**9)} is ready {some()}" for k in range(20)]  # no identifiers
    docs += [f"{some()} met me at noon.Then {some()} fe80::1:{k:x}:2 {some()}" for k in range(5)]
    docs += [docs[0]] * 30
    return [(k, text) for k, text in enumerate(docs)]


def spans(frame):
    return {(r["doc_id"], x["kind"], x["start"], x["end"], round(x["score"], 5)) for r in frame.collect() for x in r["found"]}


def test_equals_plain_and_finds_unseen(spark):
    docs = corpus()
    frame = spark.createDataFrame([(k, t, "", "", "", "") for k, t in docs], SCHEMA).repartition(3)
    got = P.personal_data(frame).cache()
    found = spans(got)
    assert found == plain(docs, P.ROUNDS, P.ACCEPTED, P.TRUSTED)
    texts = dict(docs)
    words = [(kind, texts[num][a:b]) for num, kind, a, b, _ in found]
    assert sum(kind == "phone" and text.startswith("0") for kind, text in words) == 9
    assert sum(kind == "email" and " at " in text for kind, text in words) == 5 and sum("localhost" in text for _, text in words) == 5
    assert not any("order" in texts[num] for num, *_ in found) and len(found) == 19
    for r in got.collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in by_contract(texts[r["doc_id"]]))
        assert r["base"] == base and r["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        more = [(x["kind"], x["start"], x["end"]) for x in r["found"]]
        both = by_contract(texts[r["doc_id"]]) + more
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(both, key=lambda x: (P.KINDS.index(x[0]), x[1])))
        assert [r[f"n_{k}"] for k in P.KINDS] == [sum(x[0] == k for x in by_contract(texts[r["doc_id"]])) for k in P.KINDS] and r["n_found"] == len(more)


def test_shuffled_joins_give_the_same(spark, monkeypatch):
    docs = corpus()
    frame = spark.createDataFrame([(k, t, "", "", "", "") for k, t in docs], SCHEMA)
    expected = spans(P.personal_data(frame))
    monkeypatch.setattr("sentryspark.llm.common.BROADCAST_BYTES", 0)
    monkeypatch.setattr("sentryspark.llm.common.HOT_ROWS", 3)
    assert spans(P.personal_data(frame)) == expected


def test_known_identifier_in_a_loose_form(spark):
    docs = [(1, "card 4111111111111111 here"), (2, "twice 4111111111111111 4111111111111111 there"), (3, "not 4111111111111112 4111111111111113 there"), (4, "digits in hex a4111111111111111b")]
    got = P.personal_data(spark.createDataFrame([(k, t, "", "", "", "") for k, t in docs], SCHEMA))
    assert {(x[0], x[1], x[2], x[3]) for x in spans(got)} == {(2, "card", 6, 22), (2, "card", 23, 39)}


def test_odd_rows(spark):
    long = "a" * 300_000 + "@" * 50 + "1" * 100_000 + " 1.2.3.4 " + "+1" + " " * 50_000
    rows = [(None, None), (1, ""), (1, "x@y.zz"), (1, "x@y.zz"), (2, long), (3, "mail é x@y.zz")]
    got = P.personal_data(spark.createDataFrame([(k, t, "", "", "", "") for k, t in rows], SCHEMA))
    assert sorted((r["doc_id"] or 0, r["spans"]) for r in got.collect()) == [(0, ""), (1, ""), (1, "email:0:6"), (1, "email:0:6"), (2, f"ip:{300_000 + 50 + 100_000 + 1}:{300_000 + 50 + 100_000 + 8}"), (3, "email:7:13")]
    assert P.personal_data(spark.createDataFrame([], SCHEMA)).count() == 0
