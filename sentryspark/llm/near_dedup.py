"""Near-duplicate detection by b-bit MinHash, every link confirmed on the full shingle sets.

Texts with equal shingle sets form a class, and one row stands for each class from there on. A class has HASHES
minima; BANDS groups of them are its band keys, and the low BITS bits of each are packed into bit planes.

1. Candidates share a band key (a bucket). Within a bucket, bit counts over the planes estimate each pair's similarity,
   corrected for chance collisions of the low bits. Pairs that aren't far below the threshold connect their texts
   into families; a text that is linked with another is in its family.
2. The full sets are then sent to their family, each once as a rule, and pairs of a family that are close by their planes
   are compared exactly. Components over these links are the result.

Both steps are the same search. Members of a bucket or family meet in blocks of bounded size, with the smallest
id in all of them. A block gives back a star over each of its components, never its pairs. Where a bucket or
family has several blocks and still falls into more than one component, a grid of blocks compares the members outside
its largest component with all of them. So every candidate counts, whatever the size of a group is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentryspark.llm.common import discarded, fits, fresh, joined, sized, stored

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 80
HASHES = 128
#: Two sets with a similarity of 0.8 share none of 32 bands of 4 rows once in 20 million cases.
BANDS = 32
BITS = 4
#: Standard deviations by which an estimate may fall short of the threshold.
SLACK = 5.0
#: Members in a block of a bucket, and shingles in a block of a family: the members that ask make up a quarter of it in the grid.
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 1 << 18
#: Words whose hashes a worker keeps; it starts anew when the table is full.
CACHE_WORDS = 60_000
#: Shingles whose hashes are computed at once, and those of a batch of sets.
CHUNK = 4096
BATCH = 1 << 19

_MASK = (1 << 64) - 1
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = _WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, n_words: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles: of A-Z-lower-cased words between white space; of fewer words, the whole sequence is one."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    codes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(n_words, len(words))
    out = np.full(len(words) - width + 1, width, np.uint64)
    for k in range(width):
        out = out * _ODD + codes[k : len(codes) - width + 1 + k]
    return np.unique(_mixed(out))


_PERMUTE = np.random.Generator(np.random.PCG64(20260117)).integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD


def minima(own: np.ndarray) -> np.ndarray:
    """HASHES minima of a set, 32 bits each."""
    least = np.full(HASHES, _MASK, np.uint64)
    for at in range(0, len(own), CHUNK):
        np.minimum(least, (own[at : at + CHUNK, None] * _PERMUTE).min(axis=0), out=least)
    return (least >> np.uint64(32)).astype(np.uint32)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key for each band, different bands having different keys."""
    key = _SEEDS.copy()
    for row in least.reshape(BANDS, -1).T:
        key = _mixed(key ^ row.astype(np.uint64))
    return key.view(np.int64)


def planes(least: np.ndarray) -> np.ndarray:
    """The low BITS bits of the minima, packed: bit planes of HASHES / 64 longs each."""
    bits = (least[None, :] >> np.arange(BITS, dtype=np.uint32)[:, None]) & np.uint32(1)
    return np.packbits(bits.astype(np.uint8), axis=1).view(np.int64).reshape(-1)


def floor(threshold: float) -> float:
    """The smallest estimate for which a pair is looked at: SLACK standard deviations below the threshold."""
    chance = 2.0**-BITS
    seen = chance + (1 - chance) * threshold
    return threshold - SLACK * (seen * (1 - seen) / HASHES) ** 0.5 / (1 - chance)


def estimates(own: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Collision-corrected similarities of one text's bit planes and those of others."""
    apart = np.bitwise_count(np.bitwise_or.reduce((others ^ own).reshape(-1, BITS, HASHES // 64), axis=1)).sum(axis=1)
    chance = 2.0**-BITS
    return (1 - apart / HASHES - chance) / (1 - chance)


_SIGNED = "id long, n long, digest binary, bands array<long>, planes array<long>"


def _signed(n_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands, packed = [], [], [], []
            for text in batch.column("text"):
                own = shingles(text.as_py(), n_words)
                sizes.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
                least = minima(own) if len(own) else None
                bands.append(None if least is None else band_keys(least))
                packed.append(None if least is None else planes(least))
            longs = pa.list_(pa.int64())
            yield pa.record_batch([batch.column("id"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, longs), pa.array(packed, longs)], ["id", "n", "digest", "bands", "planes"])

    return run


_TO = "to array<struct<part:long,ask:boolean>>"


def _with_sets(n_words: int):
    """Rows (id, text, key, label, to) with the text's set and planes in place of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = size = 0
            sets: list[np.ndarray] = []
            for k, text in enumerate(batch.column("text")):
                sets.append(shingles(text.as_py(), n_words))
                size += len(sets[-1])
                if size >= BATCH or k == batch.num_rows - 1:
                    longs, part = pa.list_(pa.int64()), batch.slice(at, len(sets))
                    packed = [planes(minima(x)) if len(x) else None for x in sets]
                    yield pa.record_batch([*(part.column(c) for c in ("id", "key", "label", "to")), pa.array(list(map(len, sets)), pa.int64()), pa.array(packed, longs), pa.array([x.view(np.int64) for x in sets], longs)], ["id", "key", "label", "to", "n", "planes", "set"])
                    at, size, sets = k + 1, 0, []

    return run


def _rows_of(column) -> Iterator[np.ndarray]:
    """The arrays of a list column, without copying."""
    values, ends = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    for a, b in zip(ends[:-1], ends[1:], strict=True):
        yield values[a:b]


def components_of(labels: np.ndarray, asks: np.ndarray, n: np.ndarray, bits: np.ndarray, sets: list[np.ndarray] | None, percent: int) -> np.ndarray:
    """The component of each row, equal labels being connected to begin with: pairs of which one asks are compared, unless they are connected already.

    Without sets, pairs are connected by their estimate; with them, pairs with such an estimate are connected by their sets.
    """
    _, comp = np.unique(labels, return_inverse=True)
    least = floor(percent / 100)
    if sets is not None:
        starts = np.concatenate([[0], np.cumsum(n)])
        values, codes = np.unique(np.concatenate(sets), return_inverse=True)
        mark = np.zeros(len(values), np.int32)
    for k in np.flatnonzero(asks).tolist():
        near = (comp != comp[k]) & (100 * np.minimum(n, n[k]) >= percent * np.maximum(n, n[k]))
        near[:k] &= ~asks[:k]  # these have asked for k
        found = np.flatnonzero(near)
        if len(found):
            found = found[estimates(bits[k], bits[found]) >= least]
        if sets is not None and len(found):
            own = codes[starts[k] : starts[k + 1]]
            mark[own] = 1
            theirs = mark[np.concatenate([codes[starts[m] : starts[m + 1]] for m in found])]
            shared = np.add.reduceat(theirs, np.concatenate([[0], np.cumsum(n[found])[:-1]])).astype(np.int64)
            mark[own] = 0
            found = found[100 * shared >= percent * (n[found] + n[k] - shared)]
        if len(found):
            comp[np.isin(comp, comp[found])] = comp[k]
    return comp


def star(labels: np.ndarray, comp: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges that connect the labels of each component with the smallest of them, which is often the same in other buckets: so they repeat."""
    order = np.lexsort((labels, comp))
    for rows in np.split(order, np.flatnonzero(np.diff(comp[order])) + 1):
        nodes = np.unique(labels[rows]).tolist()
        for node in nodes[1:]:
            yield node, nodes[0]


def _connected(percent: int, exact: bool):
    """Rows sorted by (key, part), a block each: stars (a, b) over the components of every block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held = None, []

        def out() -> pa.RecordBatch:
            labels, asks, n = (np.array([row[k] for row in held], kind) for k, kind in ((0, np.int64), (1, bool), (2, np.int64)))
            found = list(star(labels, components_of(labels, asks, n, np.array([row[3] for row in held]), [row[4] for row in held] if exact else None, percent)))
            return pa.record_batch([pa.array([x for x, _ in found], pa.int64()), pa.array([x for _, x in found], pa.int64())], ["a", "b"])

        for batch in batches:
            columns = [batch.column(x).to_pylist() for x in ("key", "part", "label", "ask", "n")]
            sets = _rows_of(batch.column("set")) if exact else (None for _ in range(batch.num_rows))
            for key, part, label, ask, n, bits, own in zip(*columns, _rows_of(batch.column("planes")), sets, strict=True):
                if (key, part) != block:
                    if len(held) > 1:
                        yield out()
                    block, held = (key, part), []
                held.append((label, ask, n, bits.copy(), own.copy() if exact else None))
        if len(held) > 1:
            yield out()

    return run


def _blocks(payload: DataFrame, percent: int, exact: bool) -> DataFrame:
    """Edges (a, b) from rows (key, label, to, n, planes, and set if exact), each sent to the parts of its key that `to` names."""
    rows = payload.select("key", "label", F.explode("to").alias("at"), "n", "planes", *(["set"] if exact else [])).select("key", "at.part", "at.ask", "label", "n", "planes", *(["set"] if exact else []))
    return rows.repartition("key", "part").sortWithinPartitions("key", "part").mapInArrow(_connected(percent, exact), "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, label) for every end of links (a, b): the smallest id that is reachable. Each step is stored and replaces the one before.

    Labels spread over links, and a label takes the label of its own id. Both joins have hot keys, the centres of stars and the labels of large components.
    """
    edges = stored(links.select(F.col("a").alias("id"), F.col("b").alias("to")).union(links.select("b", "a")).distinct(), "near-edges")
    degrees = stored(edges.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.least(F.min("to"), F.first("id")).alias("label")), "near-degrees")
    labels = stored(degrees.select("id", "label"), "near-labels")
    total, n_edges = labels.count(), edges.count()
    small = fits(total, 64)
    centres = degrees.select(F.col("id").alias("to"), "n")
    while True:
        theirs = labels.withColumnRenamed("id", "to")
        around = edges.join(F.broadcast(theirs), "to") if small else joined(edges, theirs, "to", "id", centres, n_edges, "inner")
        least = stored(around.select("id", "label").union(labels.select("id", "label")).groupBy("id").agg(F.min("label").alias("label")), "near-least")
        # a label's own label is at most as large
        sizes = least.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
        further = labels.select(F.col("id").alias("label"), F.col("label").alias("further"))
        jumped = least.join(F.broadcast(further), "label", "left") if small else joined(least, further, "label", "id", sizes, total)
        new = stored(jumped.select("id", F.least("label", "further").alias("label")), "near-labels")
        changed = new.join(labels.withColumnRenamed("label", "was"), "id").where("label <> was").limit(1).count()
        discarded(labels, least)
        labels = new
        if not changed:
            discarded(edges, degrees)
            return labels


def _searched(members: DataFrame, payload: Callable[[DataFrame], DataFrame], percent: int, block: int, exact: bool) -> DataFrame:
    """(id, label) of the ids that are connected with others, from stored members (key, anchor, parts, id, weight).

    payload gives rows (id, key, label, to) what blocks compare. A block has a weight of `block`, about.
    """
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    all_parts = F.transform(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda p: F.struct(p.alias("part"), F.lit(True).alias("ask")))
    to = F.when(F.col("id") == F.col("anchor"), all_parts).otherwise(F.array(F.struct(part.alias("part"), F.lit(True).alias("ask"))))
    edges = stored(_blocks(payload(members.select("id", "key", F.col("id").alias("label"), to.alias("to"))), percent, exact), "near-stars")
    labels = components(edges)
    wide = members.where("parts > 1")
    if not wide.limit(1).count():
        discarded(edges)
        return labels
    at = stored(wide.withColumn("part", part).join(labels, "id", "left").select("key", "part", "parts", "id", "weight", F.coalesce("label", "id").alias("label")), "near-wide")
    mixed = at.groupBy("key", "label", "parts").agg(F.sum("weight").alias("w")).groupBy("key", "parts").agg(F.max(F.struct("w", "label")).alias("top"), F.count(F.lit(1)).alias("labels"), F.sum("w").alias("all")).where("labels > 1")
    mixed = mixed.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("top.label").alias("most"), "all", (F.col("all") - F.col("top.w")).alias("asking"))
    grid = at.join(mixed, ["key", "part"]).withColumn("rows", F.ceil(4 * F.col("asking") / block)).withColumn("cols", F.ceil(F.col("all") / block))
    grid = stored(grid.select("key", "id", "label", "most", "rows", "cols"), "near-grid")
    if grid.limit(1).count():
        row, col = F.pmod(F.xxhash64("id", F.lit("row")), F.col("rows")), F.pmod(F.xxhash64("id", F.lit("col")), F.col("cols"))
        place = lambda p, ask: F.struct(p.alias("part"), F.lit(ask).alias("ask"))
        among = F.transform(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1), lambda r: place(r * F.col("cols") + col, False))
        asking = F.transform(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1), lambda c: place(row * F.col("cols") + c, True))
        to = F.when(F.col("label") == F.col("most"), among).otherwise(F.concat(among, asking))
        more = stored(_blocks(payload(grid.select("id", "key", "label", to.alias("to"))), percent, exact), "near-stars")
        discarded(labels)
        labels = components(edges.union(more))
        discarded(more)
    discarded(edges, at, grid)
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row for each row of docs: id_col, n_shingles, component_id, kept.

    Two texts are linked if 100 * |A and B| >= percent * |A or B| for their sets of n_words-word
    shingles; component_id is the smallest id reachable over links. Words are what white space parts, A-Z
    lower-cased. Fewer words than a shingle has are one shingle; null texts and texts without words have no shingles and
    are linked with nothing. Rows repeating an id are one document that has all its rows' links. Rows
    with a null id are linked with nothing, have a null component and stay. An empty table gives no
    rows; only the two columns named are read. Very long texts are read whole; a task holds the sets of a block, or of one text if that is
    larger. Links are complete but for the chance given at BANDS.
    """
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text"))
    signed = stored(texts.mapInArrow(_signed(n_words), _SIGNED), "near-signed")
    usable = signed.where("id is not null and n > 0")
    classes = stored(usable.groupBy("digest").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1"), "near-classes")
    known, total = classes.count(), signed.count()

    def classed(rows: DataFrame, right: DataFrame) -> DataFrame:
        return rows.join(F.broadcast(right), "digest", "left") if fits(known) else joined(rows, right, "digest", "id", classes.select("digest", "n"), total)

    reps = stored(classed(usable, classes.select("digest", "rep")).where("rep is null or rep = id").select("id", "n", "bands", "planes"), "near-reps")
    keys = reps.select("id", F.explode("bands").alias("bucket"))
    shared = stored(keys.groupBy("bucket").agg(F.min("id").alias("anchor"), F.max("id").alias("most"), F.count(F.lit(1)).alias("n")).where("anchor <> most"), "near-buckets")
    one = F.lit(1).cast("long")
    # both members of a bucket of two are known, and two texts often share several
    twos = shared.where("n = 2").select("anchor", "most").distinct().select(F.xxhash64("anchor", "most").alias("key"), "anchor", one.alias("parts"), F.explode(F.array("anchor", "most")).alias("id"), one.alias("weight"))
    wider = shared.where("n > 2")
    blocked = wider.select("bucket", "anchor", F.ceil(F.col("n") / BLOCK_MEMBERS).alias("blocks"))
    many = keys.join(F.broadcast(blocked), "bucket") if fits(wider.count(), 64) else joined(keys, blocked, "bucket", "id", wider.select("bucket", "n"), total * BANDS, "inner")
    members = stored(twos.union(many.select(F.col("bucket").alias("key"), "anchor", F.col("blocks").alias("parts"), "id", one.alias("weight"))), "near-members")
    bits = reps.select("id", "n", "planes")
    families = _searched(members, lambda rows: rows.join(bits, "id"), percent, BLOCK_MEMBERS, False)
    discarded(shared, members)

    own = stored(families.join(reps.select("id", "n"), "id").groupBy("id", "label").agg(F.sum("n").alias("weight")), "near-weights")
    sizes = stored(own.groupBy("label").agg(F.sum("weight").alias("all"), F.count(F.lit(1)).alias("n")), "near-families")
    parted = sizes.select("label", F.ceil(F.col("all") / BLOCK_SHINGLES).alias("parts"))
    few, n_families = own.count(), sizes.count()
    parted = own.join(F.broadcast(parted), "label") if fits(n_families, 64) else joined(own, parted, "label", "id", sizes.select("label", "n"), few, "inner")
    members = stored(parted.select(F.col("label").alias("key"), F.col("label").alias("anchor"), "parts", "id", "weight"), "near-members")
    with_text = lambda rows: texts.join(sized(rows, few), "id").select("id", "text", "key", "label", "to").mapInArrow(_with_sets(n_words), f"id long, key long, label long, {_TO}, n long, planes array<long>, set array<long>").where("n > 0")
    labels = _searched(members, with_text, percent, BLOCK_SHINGLES, True)
    discarded(families, own, sizes, members, reps)

    ends = labels.withColumnRenamed("id", "rep")
    copies = classes.join(sized(ends), "rep", "left").select("digest", F.coalesce("label", "rep").alias("copied"))
    out = classed(signed.select("id", "n", "digest"), copies).join(sized(labels, width=64), "id", "left")
    component = F.when(F.col("n") > 0, F.coalesce("copied", "label", "id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_words: int = SHINGLE_WORDS, percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """The rows of docs whose component they stand for, with all their columns; rows with a null id stay, and so do rows that repeat an id."""
    name = fresh(docs, "gone")
    gone = stored(near_duplicates(docs, id_col, text_col, n_words, percent).where(~F.col("kept")).select(F.col(id_col).alias(name)).distinct(), "near-gone")
    return docs.join(sized(gone, width=64), docs[id_col].cast("long") == gone[name], "left_anti")


def near_dedup_query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), n_words=2)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE w END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, far) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.far = e.a),
c AS (SELECT doc_id, min(far) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""
