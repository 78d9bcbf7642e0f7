"""Token counts by prefix dynamic programming.

Of a byte-pair tokenisation, the last token of every prefix decides the whole: a token may
follow the last token of the prefix before it only if the two, joined and tokenised alone, come
out as the same two. So the table (last token, count) for prefix i follows from those of shorter
prefixes, and each prefix gets its exact count in one pass. Pieces never cross from a letter to a
following space mark, so a text's table is that of its units (space marks and what follows)
laid end to end; units repeat, and their tables are kept in a bounded cache on each worker. A table answers how much of a text fits a
budget; that need not be where the text reaches it, as a further character can also merge tokens.
"""

from __future__ import annotations

from bisect import bisect_right
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
PUNCTUATION = "\n\t!\"#$%&'()*+,-./:;<=>?@[\\]^`{|}~"
#: Tables of units and verdicts on pairs that a worker keeps; it starts anew when one is full.
CACHE_UNITS = 1_000_000
CACHE_PAIRS = 1_000_000
#: Tables of all prefixes of units that a worker keeps.
CACHE_TABLES = 300_000
LIMIT = 4096


class PrefixCounter:
    """Exact token counts of every prefix, for a sentencepiece BPE model with byte fallback."""

    def __init__(self, model_path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.score: dict[str, float] = {}
        for i in range(model.vocab_size()):
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
                self.score[model.id_to_piece(i)] = model.get_score(i)
        self.longest = max(map(len, self.score), default=1)
        #: Pieces by number, without those that merging never reaches; and every beginning of a piece.
        self.pieces = [x for x in self.score if len(self.merged(x)) == 1]
        self.number = {x: i for i, x in enumerate(self.pieces)}
        self.heads = {x[:i] for x in self.pieces for i in range(1, len(x) + 1)}
        self.whole = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        if any(re.search(f"[^{MARK}]{MARK}", x) for x in self.score):
            raise ValueError("pieces of this model cross word boundaries")
        #: Boundaries that no piece spans: before punctuation that no piece has after a letter or digit.
        spanned = {x for piece in self.score for a, x in zip(piece, piece[1:]) if a.isalnum()}
        self.cut = re.compile(r"(?<=[^\W_])(?=[" + re.escape("".join(sorted(set(PUNCTUATION) - spanned))) + "])")
        self._units: dict[str, tuple[int, ...]] = {}
        self._totals: dict[str, int] = {}
        self._parts: dict[str, int] = {}
        self._pairs: dict[tuple[int, int], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Tokens of a short string by merging the best-scored pair again and again: the definition that the table relies on."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda i: (self.score.get(parts[i] + parts[i + 1], -1e300), -i))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def _fits(self, pair: tuple[int, int]) -> bool:
        """Whether two pieces, by number, come out as they are when their text is tokenised alone."""
        if len(self._pairs) >= CACHE_PAIRS:
            self._pairs.clear()
        a, b = self.pieces[pair[0]], self.pieces[pair[1]]
        found = self._pairs[pair] = self.merged(a + b) == [a, b]
        return found

    def table(self, unit: str) -> tuple[int, ...]:
        """Counts of unit[:1], unit[:2], ... unit."""
        number, heads, pairs, size = self.number, self.heads, self._pairs, len(unit)
        ends: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]  # of each end, the pieces that end there: start and number
        last, counts = [-1] * (size + 1), [0] * (size + 1)
        for start in range(size):
            if start:
                for at, piece in ends[start]:  # the longest first
                    if at == 0:
                        break
                    pair = last[at], piece
                    fits = pairs.get(pair)
                    if fits or fits is None and (last[at] < 0 or self._fits(pair)):
                        break
                else:
                    at, piece = start - 1, -1  # a character that is no piece: bytes
                last[start] = piece
                counts[start] = counts[at] + (1 if piece >= 0 else len(unit[at:start].encode()))
            for end in range(start + 1, min(size, start + self.longest) + 1):
                text = unit[start:end]
                if text not in heads:
                    break
                piece = number.get(text)
                if piece is not None:
                    ends[end].append((start, piece))
        for at, piece in ends[size]:
            if at == 0 or last[at] < 0 or pairs.get((last[at], piece)) or (last[at], piece) not in pairs and self._fits((last[at], piece)):
                counts[size] = counts[at] + 1
                break
        else:
            counts[size] = counts[size - 1] + len(unit[-1].encode())
        return tuple(counts[1:])

    @staticmethod
    def marked(text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""

    def totals(self, units: list[str]) -> list[int]:
        """Tokens of each unit."""
        known = self._totals
        new = {x for x in units if x not in known}
        if len(known) + len(new) > CACHE_UNITS:
            known.clear()
            new = set(units)
        for unit in new:
            known[unit] = sum(map(self._part, self.cut.split(unit)))
        return list(map(known.__getitem__, units))

    def unit_table(self, unit: str) -> tuple[int, ...]:
        """table() of a unit, kept."""
        got = self._units.get(unit)
        if got is None:
            if len(self._units) >= CACHE_TABLES:
                self._units.clear()
            got = self._units[unit] = self.table(unit)
        return got

    def units_of(self, text: str) -> list[str]:
        return self.whole.findall(self.marked(text))

    def count(self, text: str) -> int:
        """Tokens of the whole text."""
        return sum(self.totals(self.units_of(text)))

    def _part(self, part: str) -> int:
        got = self._parts.get(part)
        if got is None:
            if len(self._parts) >= CACHE_UNITS:
                self._parts.clear()
            got = self._parts[part] = self.table(part)[-1]
        return got

    def prefixes(self, text: str) -> PrefixTable:
        """The stored table of a text, for questions about its prefixes: counts before each unit, and the tables of units, which texts share."""
        units = self.units_of(text)
        return PrefixTable(self, units, self.totals(units))


class PrefixTable:
    """Counts of every prefix of one text, answered from stored tables without tokenising again."""

    def __init__(self, counter: PrefixCounter, units: list[str], totals: list[int]):
        self.units, self._table = units, counter.unit_table
        self.starts, self.befores = list(accumulate(map(len, units), initial=0)), list(accumulate(totals, initial=0))
        #: The dummy mark before the text has no character of its own.
        self.length, self.total = max(0, self.starts.pop() - 1), self.befores.pop()

    def count(self, n_chars: int) -> int:
        """Tokens of text[:n_chars]."""
        if n_chars <= 0 or not self.starts:
            return 0
        at = min(n_chars, self.length)  # position in the marked text of the last character
        k = bisect_right(self.starts, at) - 1
        return self.befores[k] + self._table(self.units[k])[at - self.starts[k]]

    def all(self) -> list[int]:
        """Counts of text[:0], text[:1], ... text."""
        flat = [b + x for b, unit in zip(self.befores, self.units, strict=True) for x in self._table(unit)]
        return [0, *flat[1:]]

    def truncate(self, budget: int) -> int:
        """Characters of the longest prefix with at most `budget` tokens: a search over units, then a look at one of them or two."""
        for k in range(bisect_right(self.befores, budget - 1) - 1, -1, -1):
            fit = [i for i, n in enumerate(self._table(self.units[k])) if self.befores[k] + n <= budget]
            if fit:
                return self.starts[k] + fit[-1]  # the dummy mark takes the first place
        return 0


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(model_path: str) -> PrefixCounter:
    if model_path not in _COUNTERS:
        _COUNTERS[model_path] = PrefixCounter(model_path)
    return _COUNTERS[model_path]


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", budgets: tuple[int, ...] = ()) -> DataFrame:
    """One row for each row of docs: id_col, n_bytes, n_tokens, and fits: for each of budgets, the characters of the longest prefix within it.

    Null and empty texts have 0 bytes and tokens. Rows are judged one by one, so repeats, ties and
    null ids stay as they are; only the two columns named are read. An empty table gives no rows. No shuffle. Very long texts are counted whole;
    their table of prefixes has a number for each unit beside the tables of units, which texts share and which are built when a question needs them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(model_path)
        for batch in batches:
            sizes, tokens, fits = [], [], []
            for value in batch.column("text"):
                text = value.as_py() or ""
                sizes.append(len(text.encode()))
                table = own.prefixes(text)
                tokens.append(table.total)
                fits.append([table.truncate(x) if x < table.total else len(text) for x in budgets])
            yield pa.record_batch([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(fits, pa.list_(pa.int64()))], ["id", "n_bytes", "n_tokens", "fits"])

    return docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).mapInArrow(run, "id long, n_bytes long, n_tokens long, fits array<long>").withColumnRenamed("id", id_col)


def token_counts_query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"), budgets=(LIMIT,))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"), F.get("fits", F.lit(0)).alias("chars_in_limit"))
