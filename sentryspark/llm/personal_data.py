"""Personal data by bootstrapped contextual extraction.

Strict forms of e-mail addresses, IP addresses, card and phone numbers are the seeds. The words around a seed make lexical patterns; looser
forms of the same kinds, such as numbers in local notation or addresses with the sign spelt out, are candidates. Patterns and instances
(distinct identifiers) make a graph, which Spark scores in rounds: a pattern is trusted for a kind if enough distinct known instances
of that kind stand in it and few of other kinds, a candidate is accepted if trusted patterns of its kind agree on it, and
accepted candidates count as known in the next round. A candidate that is a known identifier already is found, too.

Texts are read once: a row keeps its seeds, its candidates and hashes of their patterns, which are small beside the text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentryspark.llm.common import discarded, load, matched, stored, text_slices

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone")
#: A candidate is accepted from this score on, a pattern takes part from this one on.
ACCEPTED = 0.8
TRUSTED = 0.7
#: How much an instance that isn't known counts against a pattern, beside one of another kind.
UNKNOWN_WEIGHT = 0.1
#: Standard deviations by which a pattern's share of known instances is taken lower, as small numbers prove little.
CAUTION = 1.96
ROUNDS = 5
#: Code points before and after an identifier in which its context is looked for.
CONTEXT_POINTS = 48
BATCH_POINTS = 4 << 20

# The forms of the contract.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile(r"[0-9]")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_SIGN, _WORD = r"(?:\s?[\[({]\s?(?:at|AT|@)\s?[\])}]\s?|@)", r"\s(?:at|AT)\s"
_AT = f"(?:{_SIGN}|{_WORD})"
_DOT = r"(?:\s?[\[({]\s?(?:dot|DOT|\.)\s?[\])}]\s?|\.|\s(?:dot|DOT)\s)"
#: Looser forms. Sides are bounded, so that a look from any place is short.
_HOST = r"[A-Za-z0-9-]{1,63}"
LOOSE_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}}(?:{_SIGN}{_HOST}(?:{_DOT}{_HOST}){{0,4}}|{_WORD}{_HOST}(?:{_DOT}{_HOST}){{1,4}})(?![A-Za-z0-9@-])")
LOOSE_NUMBER = re.compile(r"(?<![0-9A-Za-z_])[+(]{0,2}[0-9](?:[\x20()./-]{0,2}[0-9])++(?![0-9A-Za-z_])")
LOOSE_V6 = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]*:[0-9A-Fa-f]*:)[0-9A-Fa-f:]{6,39}(?![0-9A-Za-z:.])")
#: What a text has that holds such a form.
_HINTS = ((LOOSE_EMAIL, re.compile(r"@|\b(?:at|AT)\b")), (LOOSE_V6, re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]*:|::")), (LOOSE_NUMBER, re.compile(r"[0-9]")))
_TOKEN = re.compile(r"[^\W\d_]+|[^\w\s]")
_EMAIL_NOISE = re.compile(r"[\s\[\](){}]")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(d * 2 - 9 * (d > 4) for d in map(int, digits[-2::-2]))
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As leftmost search would find them; each sign is looked at once, however long a run before it is."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
        done = found.end() if found else at + 1
        at = text.find("@", done)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the strict forms, in order of kind and place."""
    out = [("email", a, b) for a, b in emails(text)]
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 8 <= sum(x.isdigit() for x in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def normal_form(kind: str, text: str) -> str:
    """What is the same for all spellings of an identifier."""
    if kind == "email":
        low = re.sub(_AT, "@", text, count=1).lower()
        return _EMAIL_NOISE.sub("", re.sub(_DOT.replace("DOT", "dot"), ".", low))
    if kind == "ip":
        return text.lower()
    return re.sub(r"[^0-9]", "", text)


def loose_spans(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[int, int, tuple[str, ...]]]:
    """(start, end, kinds that it may be) of looser forms that touch no strict one and not each other."""
    held = sorted((a, b) for _, a, b in taken)
    out: list[tuple[int, int, tuple[str, ...]]] = []

    def gaps() -> Iterator[tuple[int, int]]:
        at = 0
        for a, b in sorted(held):
            if a > at:
                yield at, a
            at = max(at, b)
        if at < len(text):
            yield at, len(text)

    for pattern, hint in _HINTS:
        if not hint.search(text):
            continue
        own = []
        for a, b in gaps():
            for m in pattern.finditer(text, a, b):
                if pattern is not LOOSE_NUMBER:
                    own.append((m.start(), m.end(), ("email",) if pattern is LOOSE_EMAIL else ("ip",)))
                    continue
                for start, end in _numbers(text, m.start(), m.end()):
                    n = sum(x.isdigit() for x in text[start:end])
                    kinds = (("card",) if 13 <= n <= 19 else ()) + (("phone",) if 7 <= n <= 15 else ())
                    if kinds:
                        own.append((start, end, kinds))
        out += own
        held += [(a, b) for a, b, _ in own]
    return sorted(out)


def _numbers(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """A run of digit groups, or its parts between spaces if it has more digits than any identifier."""
    if sum(x.isdigit() for x in text[start:end]) <= 19:
        yield start, end
        return
    for m in re.finditer(r"[0-9(+][0-9()./+-]*", text[start:end]):
        yield start + m.start(), start + m.end()


def contexts(text: str, start: int, end: int) -> list[str]:
    """The patterns that an identifier stands in: two or three tokens before it, and one before with one after. Digits are no part of them."""
    before = [x.lower() for x in _TOKEN.findall(text, max(0, start - CONTEXT_POINTS), start)][-3:]
    after = [x.lower() for x in _TOKEN.findall(text, end, end + CONTEXT_POINTS)][:1]
    made = [before[-2:] + ["_"] if len(before) >= 2 else [], before + ["_"] if len(before) == 3 else [], before[-1:] + ["_"] + after if before and after else []]
    return [" ".join(x) for x in made if any(t[0].isalpha() for t in x if t != "_")]


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


_CANDIDATE = "struct<start:int,end:int,seed:boolean,options:array<struct<kind:int,instance:bigint>>,patterns:array<bigint>>"
_OUT = f"row long, id long, {', '.join(f'n_{x} long' for x in KINDS)}, base_sha256 string, base string, found array<{_CANDIDATE}>"
_ARROW = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("options", pa.list_(pa.struct([("kind", pa.int32()), ("instance", pa.int64())]))), ("patterns", pa.list_(pa.int64()))]))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for part in text_slices(whole, "text", BATCH_POINTS):
            counts, digests, bases, found = [[] for _ in KINDS], [], [], []
            for text in part.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                for to, kind in zip(counts, KINDS, strict=True):
                    to.append(sum(x[0] == kind for x in base))
                bases.append(",".join(f"{k}:{a}:{b}" for k, a, b in base))
                digests.append(hashlib.sha256(bases[-1].encode()).hexdigest())
                both = [(a, b, True, (k,)) for k, a, b in base] + [(a, b, False, kinds) for a, b, kinds in loose_spans(text, base)]
                found.append([
                    {"start": a, "end": b, "seed": seed, "patterns": [_hash(x) for x in contexts(text, a, b)], "options": [{"kind": KINDS.index(k), "instance": _hash(f"{k} {normal_form(k, text[a:b])}")} for k in kinds]}
                    for a, b, seed, kinds in both
                ])
            yield pa.record_batch(
                [part.column("row"), part.column("id"), *(pa.array(x, pa.int64()) for x in counts), pa.array(digests, pa.string()), pa.array(bases, pa.string()), pa.array(found, _ARROW)],
                ["row", "id", *(f"n_{x}" for x in KINDS), "base_sha256", "base", "found"],
            )


def read(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The stored table of what is in each row of docs: strict spans, and occurrences of both sorts with their patterns."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    return stored(rows.mapInArrow(_read, _OUT), "identifiers")


def edges(found: DataFrame) -> DataFrame:
    """The stored graph (pattern, kind, instance, seed): each pattern with the distinct identifiers in it; seed says that one is a strict form anywhere."""
    each = found.select(F.explode("found").alias("x")).select("x.patterns", F.explode("x.options").alias("o"), "x.seed").select(F.explode("patterns").alias("pattern"), "o.kind", "o.instance", "seed")
    return stored(each.groupBy("pattern", "kind", "instance").agg(F.max("seed").alias("seed")), "graph")


def trusted_patterns(graph: DataFrame, trusted: float) -> DataFrame:
    """(pattern, kind, score) of the patterns that are trusted, from edges with `known`.

    The score is the lower end of the interval for the share of known instances of the kind among those known at all and, with
    a small weight, unknown ones that could be of the kind: it is low for few instances and for patterns in which other kinds stand.
    """
    pos = [F.count_if(F.col("known") & (F.col("kind") == k)).alias(f"p{k}") for k in range(len(KINDS))]
    open_ = [F.count_if(~F.col("known") & (F.col("kind") == k)).alias(f"u{k}") for k in range(len(KINDS))]
    sums = graph.groupBy("pattern").agg(*pos, *open_).where(" + ".join(f"p{k}" for k in range(len(KINDS))) + " > 0")
    whole = sum((F.col(f"p{k}") for k in range(1, len(KINDS))), F.col("p0"))
    each = sums.select("pattern", whole.alias("whole"), F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"p{k}").alias("p"), F.col(f"u{k}").alias("u")) for k in range(len(KINDS))))).alias("x"))
    n = F.col("whole") + UNKNOWN_WEIGHT * F.col("x.u")
    share, z2 = F.col("x.p") / n, CAUTION * CAUTION
    low = (share + z2 / (2 * n) - CAUTION * F.sqrt(share * (1 - share) / n + z2 / (4 * n * n))) / (1 + z2 / n)
    return each.where("x.p > 0").select("pattern", "x.kind", F.round(low, 9).alias("score")).where(F.col("score") >= trusted)


def accepted_instances(graph: DataFrame, rounds: int = ROUNDS, accepted: float = ACCEPTED, trusted: float = TRUSTED) -> DataFrame:
    """The stored table (kind, instance, score) of candidates that are identifiers: those that are seeds elsewhere, and what trusted patterns agree on.

    A candidate's score is the chance that not all of its trusted patterns err. Rounds end when nothing new is accepted, or after
    `rounds`.
    """
    seeds = graph.groupBy("kind", "instance").agg(F.max("seed").alias("seed"))
    known = stored(seeds.where("seed").select("kind", "instance", F.lit(1.0).alias("score")), "known-identifiers")
    number = known.count()
    for _ in range(rounds):
        marked = matched(graph, known.withColumn("known", F.lit(True)).drop("score"), ["kind", "instance"], "pattern", number, 64).withColumn("known", F.coalesce("known", F.lit(False)))
        marked = stored(marked.select("pattern", "kind", "instance", "known"), "marked-graph")
        best = stored(trusted_patterns(marked, trusted), "patterns")
        agreed = matched(marked.where(~F.col("known")), best, ["pattern", "kind"], "instance", width=64, how="inner")
        new = agreed.groupBy("kind", "instance").agg(F.round(1 - F.exp(F.sum(F.log(1 - F.col("score")))), 6).alias("score")).where(F.col("score") >= accepted)
        new = stored(new, "accepted")
        more, before = new.count(), known
        if more:
            known, number = stored(before.unionByName(new), "known-identifiers"), number + more
            discarded(before)
        discarded(marked, best, new)
        if not more:
            break
    return known


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS, accepted: float = ACCEPTED, trusted: float = TRUSTED) -> DataFrame:
    """A row for each row of docs: id_col, the numbers of strict spans by kind, base_sha256 and base, the list of these, n_found and found (kind, start, end, score), spans.

    A span is kind:start:end in code points, end exclusive. Strict spans always stay; what the patterns find touches none of them. A candidate that two kinds
    claim is of that with the higher score, then of that listed first. Null and empty texts have no spans. Rows repeating an id or with a null
    one are judged each by itself; repeated texts count once for a pattern, as only distinct identifiers do. An empty table gives no rows. Very
    long texts are read whole. Only the columns named are read.
    """
    rows = read(docs, id_col, text_col)
    known = accepted_instances(edges(rows), rounds, accepted, trusted)
    loose = rows.select("row", F.explode("found").alias("x")).where("not x.seed").select("row", "x.start", "x.end", F.explode("x.options").alias("o")).select("row", "start", "end", "o.kind", "o.instance")
    hits = matched(loose, known, ["kind", "instance"], "row", width=64, how="inner")
    # one kind a place, then one list a row, which is no longer than the row's own candidates
    best = hits.groupBy("row", "start", "end").agg(F.max(F.struct("score", (-F.col("kind")).alias("first"))).alias("b"))
    lists = best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct((-F.col("b.first")).alias("kind"), "start", "end", "b.score"))).alias("more"))
    name = F.get(F.array(*(F.lit(x) for x in KINDS)), F.col("kind"))
    out = rows.join(lists, "row", "left")
    more = F.coalesce("more", F.array().cast("array<struct<kind:int,start:int,end:int,score:double>>"))
    named = lambda x: F.get(F.array(*(F.lit(k) for k in KINDS)), x["kind"])
    strict = F.transform(F.filter("found", lambda x: x["seed"]), lambda x: F.struct(F.get(x["options"], F.lit(0))["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    every = F.sort_array(F.concat(strict, F.transform(more, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))))
    return out.select(
        F.col("id").alias(id_col), *(f"n_{x}" for x in KINDS), "base_sha256", "base", F.size(more).cast("long").alias("n_found"),
        F.transform(more, lambda x: F.struct(named(x).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score"))).alias("found"),
        F.array_join(F.transform(every, lambda x: F.concat_ws(":", named(x), x["start"].cast("string"), x["end"].cast("string"))), ",").alias("spans"),
    )


def personal_data_query(spark, sf_dir: str) -> DataFrame:
    out = personal_data(load(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", *(f"n_{x}" for x in KINDS), "base_sha256", "n_found", "spans")
