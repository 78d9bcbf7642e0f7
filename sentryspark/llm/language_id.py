"""Language ID: script ranges narrow the candidates, Viterbi over per-word scores labels spans.

A word is a run of letters of one script. Its candidates are the languages that were seen
with that script; its score for a language is the sum of log probabilities of its letter trigrams. A path
through the words of a text pays a penalty for every switch of language; the best path gives
the spans, and the language with most letters on it is the text's. All of it is numpy over
many texts at once: trigrams are hashed from code points, and paths are found over blocks of
words whose transfer matrices are then chained.

The model is fitted in Spark on all labelled rows: its table has FEATURES cells for each language, however many rows there are.
How well a text fits at all is the mean log probability of its trigrams on the best path, less what is usual for
the path's languages; the model's cut lies halfway between what nearly all labelled rows reach, each judged by the half
of the rows that it isn't in, and the worst fit there is.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells of the trigram table.
FEATURES = 1 << 15
#: Languages that a model may have: it then has 26 MB, and its tables of counts have 13 million rows at most.
MAX_LANGUAGES = 200
#: Log-probability units that a switch of language costs, and the share of a language's letters that makes a script its own.
PENALTY = 8.0
SCRIPT_SHARE = 0.01
#: Texts with a lower score fit no learned language. One that mixes four languages still has 0.25 for its first.
MIN_SCORE = 0.2
#: No word fits worse than this a letter, so that a key or an address beside prose doesn't outweigh it; a text counts as if it had PRIOR usual letters more.
FLOOR = -3.0
PRIOR = 20
#: The share of labelled rows that may fall below what the cut is set from.
REJECTED = 0.001
#: Code points worked on at once, and words in a block of the path search.
SLICE = 1 << 18
BLOCK = 64

#: First code points of script ranges, by the Unicode block table.
SCRIPTS = [
    ("latin", 0x0041), ("greek", 0x0370), ("cyrillic", 0x0400), ("armenian", 0x0530), ("hebrew", 0x0590), ("arabic", 0x0600), ("other", 0x0700),
    ("devanagari", 0x0900), ("bengali", 0x0980), ("other", 0x0A00), ("tamil", 0x0B80), ("other", 0x0C00), ("thai", 0x0E00), ("other", 0x0E80), ("georgian", 0x10A0),
    ("hangul", 0x1100), ("other", 0x1200), ("latin", 0x1D00), ("greek", 0x1F00), ("latin", 0x2000), ("kana", 0x3040), ("other", 0x3100), ("han", 0x3400),
    ("other", 0xA000), ("latin", 0xA720), ("other", 0xA800), ("hangul", 0xAC00), ("han", 0xF900), ("latin", 0xFB00), ("arabic", 0xFB50), ("latin", 0xFE70), ("kana", 0xFF66), ("other", 0xFFA0), ("han", 0x20000), ("other", 0x30000),
]
SCRIPT_NAMES = sorted({name for name, _ in SCRIPTS})


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: 1 + its script's place in SCRIPT_NAMES, or 0 if it is no letter; and its lower-case form."""
    script, lower = np.zeros(0x110000, np.uint8), np.arange(0x110000, dtype=np.uint32)
    starts, kinds = np.array([at for _, at in SCRIPTS]), [SCRIPT_NAMES.index(name) + 1 for name, _ in SCRIPTS]
    for i in range(0x41, 0x110000):
        c = chr(i)
        if unicodedata.category(c)[0] == "L":
            script[i] = kinds[int(np.searchsorted(starts, i, "right")) - 1]
            if len(low := c.lower()) == 1:
                lower[i] = ord(low)
    return script, lower


@dataclass
class Words:
    """Words of a slice: where each starts and ends, its script, and the trigram cells of all of them, one for each letter."""

    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    cells: np.ndarray
    first: np.ndarray


def words_of(codes: np.ndarray) -> Words:
    script_of, lower_of = letters()
    script = script_of[codes]
    change = np.flatnonzero(np.diff(script, prepend=np.uint8(0), append=np.uint8(0)))
    start, end = change[:-1], change[1:]
    real = script[start] > 0 if len(start) else np.zeros(0, bool)
    start, end = start[real], end[real]
    at = np.flatnonzero(script)
    low = lower_of[codes[at]]
    first = np.cumsum(np.concatenate([[0], (end - start)[:-1]])) if len(start) else np.zeros(0, np.int64)
    before, after = np.empty_like(low), np.empty_like(low)
    before[1:], after[:-1] = low[:-1], low[1:]
    if len(first):
        before[first] = 2
        after[np.concatenate([first[1:] - 1, [len(low) - 1]])] = 3
    cells = (before * np.uint32(0x9E3779B1)) ^ (low * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
    cells = ((cells ^ (cells >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)
    return Words(start, end, script[start] if len(start) else np.zeros(0, np.uint8), cells & np.uint32(FEATURES - 1), first)


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def slices_of(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Code points of consecutive texts, at most about SLICE at once: codes, then each part's text, its start in the slice and in the text.

    A longer text comes in several slices, cut between words where it can be; a line break parts two texts.
    """
    held, owners, starts, offsets, size = [], [], [], [], 0
    gap = np.array([10], np.uint32)
    for number, text in enumerate(texts):
        codes, at = codes_of(text), 0
        while True:
            stop = len(codes)
            if stop - at > SLICE:
                stop = at + SLICE
                blank = np.flatnonzero(letters()[0][codes[stop - 4096 : stop]] == 0)
                stop = stop - 4096 + int(blank[-1]) + 1 if len(blank) else stop
            part = codes[at:stop]
            if size and size + len(part) > SLICE:
                yield np.concatenate(held), np.array(owners), np.array(starts), np.array(offsets)
                held, owners, starts, offsets, size = [], [], [], [], 0
            owners.append(number)
            starts.append(size)
            offsets.append(at)
            held += [part, gap]
            size += len(part) + 1
            at = stop
            if at >= len(codes):
                break
    if held:
        yield np.concatenate(held), np.array(owners), np.array(starts), np.array(offsets)


@dataclass
class Model:
    languages: list[str]
    #: Log probabilities, FEATURES x languages.
    grams: np.ndarray
    #: Whether a language is a candidate for words of a script, scripts + 1 x languages.
    candidates: np.ndarray
    #: What a letter of each language's own texts has on average, and the fit below which a text is of no learned language.
    typical: np.ndarray
    cut: float = -np.inf

    def sums(self, words: Words) -> np.ndarray:
        """Words x languages: log probabilities."""
        return np.add.reduceat(self.grams[words.cells], words.first, axis=0) if len(words.first) else np.zeros((0, len(self.languages)), np.float32)

    def scores(self, words: Words, sums: np.ndarray) -> np.ndarray:
        """Words x languages; languages that a word's script rules out fall behind the worst of the others by the penalty."""
        if not len(words.first):
            return sums
        allowed = self.candidates[words.script]
        known = allowed.any(axis=1, keepdims=True)
        floor = np.where(allowed, sums, np.inf).min(axis=1, keepdims=True) - PENALTY
        sums = np.where(known, np.where(allowed, sums, floor), 0).astype(np.float32)
        return sums - sums.max(axis=1, keepdims=True)


def best_paths(scores: np.ndarray, lengths: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The language of every word on the best path of its text; lengths: words of each text, one after another in scores."""
    n_langs = scores.shape[1]
    blocks = -(-lengths // BLOCK)
    if not blocks.sum():
        return np.zeros(0, np.int64)
    first_block = np.concatenate([[0], np.cumsum(blocks)[:-1]])
    first_word = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    place = np.arange(len(scores)) - np.repeat(first_word - first_block * BLOCK, lengths)
    padded = np.zeros((int(blocks.sum()) * BLOCK, n_langs), np.float32)
    padded[place] = scores
    steps = padded.reshape(-1, BLOCK, n_langs).transpose(1, 0, 2)
    leave = np.where(np.eye(n_langs, dtype=bool), 0, -penalty).astype(np.float32)
    # the best way through each block from the language before it to its last one
    through = steps[0][:, None, :] + leave
    for step in steps[1:]:
        through = step[:, None, :] + np.maximum(through, through.max(axis=2, keepdims=True) - penalty)
    # chain the blocks of each text, all texts at once
    order = np.argsort(-blocks, kind="stable")
    counts, heads = blocks[order], first_block[order]
    entered = np.zeros((len(padded) // BLOCK, n_langs), np.int64)
    value = np.zeros((len(order), n_langs), np.float32)
    for k in range(int(counts[0])):
        live = int(np.searchsorted(-counts, -k, "left"))
        ways = value[:live, :, None] + through[heads[:live] + k]  # at k = 0 all start alike, so no switch is paid
        entered[heads[:live] + k] = ways.argmax(axis=1)
        value[:live] = ways.max(axis=1)
    start, last = np.zeros(len(entered), np.int64), np.zeros(len(entered), np.int64)
    now = value.argmax(axis=1)
    for k in range(int(counts[0]) - 1, -1, -1):
        live = int(np.searchsorted(-counts, -k, "left"))
        at = heads[:live] + k
        last[at] = now[:live]
        start[at] = now[:live] = entered[at, now[:live]]
    # within each block, from its known start to its known end
    value = steps[0] + leave[start]
    stays, tops = np.zeros((BLOCK, len(start), n_langs), bool), np.zeros((BLOCK, len(start)), np.int64)
    for k in range(1, BLOCK):
        tops[k] = value.argmax(axis=1)
        switch = value.max(axis=1, keepdims=True) - penalty
        stays[k] = value >= switch
        value = steps[k] + np.maximum(value, switch)
    path, rows = np.zeros((len(start), BLOCK), np.int64), np.arange(len(start))
    path[:, -1] = now = last
    for k in range(BLOCK - 1, 0, -1):
        now = np.where(stays[k][rows, now], now, tops[k])
        path[:, k - 1] = now
    return path.reshape(-1)[place]


def _counted(languages: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = np.zeros((2, len(languages), FEATURES), np.int64)
        scripts = np.zeros((2, len(languages), len(SCRIPT_NAMES) + 1), np.int64)
        for batch in batches:
            langs, texts, halves = (batch.column(c).to_pylist() for c in ("lang", "text", "half"))
            for half in (0, 1):
                for k, name in enumerate(languages):
                    for codes, *_ in slices_of([t for t, x, h in zip(texts, langs, halves, strict=True) if x == name and h == half]):
                        words = words_of(codes)
                        grams[half, k] += np.bincount(words.cells, minlength=FEATURES)
                        scripts[half, k] += np.bincount(words.script, words.end - words.start, len(SCRIPT_NAMES) + 1).astype(np.int64)
        for table, kind in ((grams, 0), (scripts, 1)):
            half, lang, cell = np.nonzero(table)
            ints = [pa.array(x, pa.int32()) for x in (np.full(len(lang), kind), half, lang, cell)]
            yield pa.record_batch([*ints, pa.array(table[half, lang, cell], pa.int64())], ["kind", "half", "lang", "cell", "n"])

    return run


def _model(languages: list[str], grams: np.ndarray, scripts: np.ndarray) -> Model:
    smooth = grams + 0.5
    logs = np.log(smooth / smooth.sum(axis=0))
    typical = (grams * logs).sum(axis=0) / np.maximum(grams.sum(axis=0), 1)
    return Model(languages, logs.astype(np.float32), scripts >= np.maximum(1, SCRIPT_SHARE * scripts.sum(axis=0)), typical)


def _cut(halved: DataFrame, halves: list[Model]) -> float:
    """Halfway from the fit that all but REJECTED of the rows reach, by the model of the half that they aren't in, to FLOOR. The driver gets a histogram."""
    shared = halved.sparkSession.sparkContext.broadcast(halves)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, halves = batch.column("text").to_pylist(), batch.column("half").to_pylist()
            for half in (0, 1):
                for langs, _, _, fits in labelled_in_parts(shared.value[1 - half], [t for t, h in zip(texts, halves, strict=True) if h == half]):
                    yield pa.record_batch([pa.array([round(100 * f) for x, f in zip(langs, fits, strict=True) if x != "und"], pa.int32())], ["fit"])

    table = halved.mapInArrow(run, "fit int").groupBy("fit").count().orderBy("fit").toPandas()
    if not len(table):
        return -np.inf
    below = table["count"].cumsum().to_numpy()
    return (float(table["fit"].to_numpy()[int(np.searchsorted(below, REJECTED * below[-1], "right"))]) / 100 + FLOOR) / 2


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on all rows, which are read three times: store them if they are dear to make; null texts and languages are left out.

    What reaches the driver: a count for each language, the model's table by halves of the rows, and a histogram of fits. More than
    MAX_LANGUAGES languages raise ValueError. An empty table gives a model without languages.
    """
    own = labelled.select(labelled[id_col].alias("id"), labelled[text_col].alias("text"), labelled[lang_col].cast("string").alias("lang")).where("lang is not null and text is not null")
    counts = own.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    languages = [r["lang"] for r in counts]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not languages:
        return Model([], np.zeros((FEATURES, 0), np.float32), np.zeros((len(SCRIPT_NAMES) + 1, 0), bool), np.zeros(0))
    half = F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)).cast("int").alias("half")
    halved = own.select("text", "lang", half)
    table = halved.mapInArrow(_counted(languages), "kind int, half int, lang int, cell int, n long").groupBy("kind", "half", "lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    grams = np.zeros((2, FEATURES, len(languages)))
    scripts = np.zeros((2, len(SCRIPT_NAMES) + 1, len(languages)))
    for kind, into in ((0, grams), (1, scripts)):
        part = table[table["kind"] == kind]
        into[part["half"].to_numpy(), part["cell"].to_numpy(), part["lang"].to_numpy()] = part["n"].to_numpy()
    model = _model(languages, grams.sum(axis=0), scripts.sum(axis=0))
    model.cut = _cut(halved, [_model(languages, grams[k], scripts[k]) for k in (0, 1)])
    return model


def labelled_texts(model: Model, texts: list[str], spans: bool = False) -> tuple[list[str], list[float], list[list[dict]], list[float]]:
    """Language and score of each text, its spans (first and past-the-last code point, language), and its fit.

    The fit is over letters of scripts that the path's languages were seen with: log probability a letter less what is typical.
    """
    n, n_langs = len(texts), len(model.languages)
    if not n_langs:
        return ["und"] * n, [0.0] * n, [[] for _ in texts], [0.0] * n
    owner, scores, sizes, bounds, known, excess = [], [], [], [], [], []
    for codes, numbers, starts, offsets in slices_of(texts):
        words = words_of(codes)
        which = np.searchsorted(starts, words.start, "right") - 1
        owner.append(numbers[which])
        sums = model.sums(words)
        scores.append(model.scores(words, sums))
        sizes.append(words.end - words.start)
        excess.append(np.maximum(sums / sizes[-1][:, None] - model.typical, FLOOR) * sizes[-1][:, None])
        known.append(model.candidates[words.script].astype(np.float32))
        base = offsets[which] - starts[which]
        bounds.append((words.start + base, words.end + base))
    letters_of = np.zeros((n, n_langs))
    backed = np.zeros((n, n_langs))
    total, fit = np.zeros(n), np.zeros(n)
    found: list[list[dict]] = [[] for _ in texts]
    if owner:
        owner, sizes = np.concatenate(owner), np.concatenate(sizes)
        lengths = np.bincount(owner, minlength=n)
        path = best_paths(np.concatenate(scores), lengths)
        fits = np.concatenate(known)[np.arange(len(path)), path] if len(path) else np.zeros(0)
        np.add.at(letters_of, (owner, path), sizes)
        np.add.at(backed, (owner, path), sizes * fits)
        total = np.bincount(owner, sizes, n)
        fit = np.bincount(owner, np.concatenate(excess)[np.arange(len(path)), path] * fits, n) / (np.bincount(owner, sizes * fits, n) + PRIOR)
        if spans and len(path):
            begins, ends = np.concatenate([b for b, _ in bounds]), np.concatenate([e for _, e in bounds])
            new = np.concatenate([[True], (owner[1:] != owner[:-1]) | (path[1:] != path[:-1])])
            at = np.flatnonzero(new)
            for a, b in zip(at, np.concatenate([at[1:], [len(path)]]), strict=True):
                found[owner[a]].append({"start": int(begins[a]), "end": int(ends[b - 1]), "lang": model.languages[path[a]]})
    best = letters_of.argmax(axis=1)
    langs = [model.languages[k] if t else "und" for k, t in zip(best, total, strict=True)]
    score = np.where(total > 0, backed[np.arange(n), best] / np.maximum(total, 1), 0.0)
    return langs, np.round(score, 6).tolist(), found, fit.tolist()


def labelled_in_parts(model: Model, texts: list[str], spans: bool = False) -> Iterator[tuple[list[str], list[float], list[list[dict]], list[float]]]:
    """labelled_texts() of consecutive texts, about SLICE code points at a time, so that memory doesn't grow with the batch."""
    start = size = 0
    for k, text in enumerate(texts):
        size += len(text)
        if size >= SLICE or k == len(texts) - 1:
            yield labelled_texts(model, texts[start : k + 1], spans)
            start, size = k + 1, 0


def identified(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """One row for each row of docs: id_col, lang_pred, score, spans (array of start, end, lang; empty unless asked for).

    lang_pred is `und`, with score 0, for null texts, texts without letters, or a model without
    languages. The score is the share of the text's letters in words that the best path gives to
    lang_pred and whose script that language was seen with. Ties go to the first language in
    order. Rows are judged one by one; only the two columns named are read. No shuffle. Very long texts are worked on in
    slices and have one path; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind, at = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())])), 0
            for langs, scores, found, _ in labelled_in_parts(shared.value, [x or "" for x in batch.column("text").to_pylist()], spans):
                yield pa.record_batch([batch.column("id").slice(at, len(langs)), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(found, kind)], ["id", "lang_pred", "score", "spans"])
                at += len(langs)

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(run, "id long, lang_pred string, score double, spans array<struct<start:long,end:long,lang:string>>").withColumnRenamed("id", id_col)


def of_known_language(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """The rows of docs, with all their columns, whose text has a language by `model`, a score of min_score or more and no fit below the model's cut.

    Null texts and texts without letters go, so do gibberish and unlearned languages in a learned script; repeats and null ids are judged like other rows. No shuffle.
    """
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start = 0
            for langs, scores, _, fits in labelled_in_parts(shared.value, [x or "" for x in batch.column(at).to_pylist()]):
                yield batch.slice(start, len(langs)).filter(pa.array([x != "und" and s >= min_score and f >= shared.value.cut for x, s, f in zip(langs, scores, fits, strict=True)], pa.bool_()))
                start += len(langs)

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id"):
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(4)) == 2


def fitted_on(docs: DataFrame) -> Model:
    """The model of documents that aren't held out."""
    return fit(docs.select("doc_id", "text", "lang").where(~F.coalesce(held_out(), F.lit(False))))


def language_id_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identified(docs.select("doc_id", "text"), fitted_on(docs))
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")
