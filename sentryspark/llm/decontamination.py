"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame functions only.

A text's set is its distinct shingles of five words. A short test item inside a long document
has a tiny Jaccard similarity to it, so signatures grow with the set: documents are partitioned
by size class c (the set has at most 2^(c-1) shingles), and a document of class c keeps the minimal
hash of each of 2^c bins, bins being hash prefixes of c bits. A shared shingle is its bin's minimum
in the document with a probability of at least 0.78, whatever the sizes are. An item's minima for
all classes are one short list: a shingle that is the minimum of its bin stays so in all finer
ones, so each carries the first class from which it counts. Documents and items that agree in
enough bins are candidates; these are then verified on the exact shingles. Of the smallest items, all
shingles count: a document sends those of its shingles, too, that pass a sieve of theirs. The corpus is shingled once for all items.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sentryspark.llm.common import fresh, sized, stored

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
#: Items of up to so many shingles are hit by any shingle of a document: the few minima shared with them could be missed.
SMALL_ITEM = 8
#: A document's other shingles pass a sieve of the small items' hashes: 64 bits for each hash, at most 2^SIEVE_BITS (128 KB). A fuller sieve sends more of them, and none that count are lost.
SIEVE_BITS = 20
#: What parts two words, after lower-casing.
GAPS = r"[^\p{L}\p{N}]+"


def once(column) -> F.Column:
    """The same value by way of a generator, which evaluates it once a row: a plain column would be inlined where it is used, also within lambdas."""
    return F.explode(F.array(column))


def words(text) -> F.Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), GAPS), "")


def _shingles(rows: DataFrame, make, n_words: int) -> DataFrame:
    """(id, set): the distinct shingles in order of column w, as make() gives them; shorter texts have their whole sequence as the only one."""
    n = F.size("w")
    rows = rows.select("id", once(F.col("w")).alias("w"))
    many = F.transform(F.sequence(F.lit(1), n - (n_words - 1)), lambda i: make(F.slice("w", i, n_words)))
    return rows.where(n > 0).select("id", once(F.sort_array(F.array_distinct(F.when(n >= n_words, many).otherwise(F.array(make(F.col("w"))))))).alias("set"))


def _hash(part) -> F.Column:
    return F.xxhash64(part)


def _string(part) -> F.Column:
    return F.array_join(part, " ")


def item_minima(items: DataFrame, n_words: int) -> DataFrame:
    """(item_id, hash, first_class, n_item): a row for each shingle of an item."""
    own = _shingles(items, _hash, n_words)
    at = own.select("id", F.size("set").alias("n_item"), "set", F.posexplode("set").alias("i", "hash"))
    before = F.when(F.col("i") > 0, F.get("set", F.col("i") - 1))
    first = F.coalesce(F.lit(65) - F.length(F.bin(F.col("hash").bitwiseXOR(before))), F.lit(0))
    return at.select(F.col("id").alias("item_id"), "hash", first.cast("int").alias("first_class"), "n_item")


def sieve(hashes: DataFrame) -> list[int]:
    """The bits of a sieve of distinct hashes, in longs; none without hashes. Spark sets the bits, and the driver gets 16,384 longs at most."""
    n = hashes.count()
    if not n:
        return []
    bits = 1 << min(SIEVE_BITS, (64 * n - 1).bit_length())
    out = [0] * (bits // 64)
    place = F.expr(f"cast(shiftrightunsigned(hash & {bits - 1}L, 6) as int)")
    for row in hashes.groupBy(place.alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(hash & 63L as int)))").alias("long")).collect():
        out[row["at"]] = row["long"]
    return out


def document_minima(docs: DataFrame, n_words: int, small: list[int]) -> DataFrame:
    """(doc_id, class, hash, least): the minimal hash of each bin of each document, and those of its hashes that pass the sieve `small`. least says whether they are minimal."""
    own = _shingles(docs, _hash, n_words)
    own = own.withColumn("class", (F.ceil(F.log2(F.size("set"))) + 1).cast("int"))
    least = "i = 0 or shiftrightunsigned(x, 64 - class) <> shiftrightunsigned(get(set, i - 1), 64 - class)"
    if not small:
        minima = own.select(F.col("id").alias("doc_id"), "class", F.expr(f"filter(set, (x, i) -> {least})").alias("minima"))
        return minima.select("doc_id", "class", F.explode("minima").alias("hash"), F.lit(True).alias("least"))
    longs = f"cast(split('{','.join(map(str, small))}', ',') as array<bigint>)"  # one literal, which the optimizer evaluates
    passes = f"getbit(get({longs}, cast(shiftrightunsigned(m.hash & {64 * len(small) - 1}L, 6) as int)), cast(m.hash & 63L as int)) = 1"
    marked = F.expr(f"filter(transform(set, (x, i) -> struct(x as hash, {least} as least)), m -> m.least or {passes})")
    return own.select(F.col("id").alias("doc_id"), "class", F.explode(marked).alias("one")).select("doc_id", "class", "one.hash", "one.least")


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    n_words: int = SHINGLE_WORDS, containment: float = CONTAINMENT,
) -> DataFrame:
    """A row for each document and item of whose shingles it holds the share `containment` or more: id_col, item_id, n_shared, n_item, containment.

    Words are runs of letters and digits, lower-cased. Null and empty texts have no shingles and
    match nothing; an item of fewer words than a shingle matches documents of just these words.
    Rows repeating an id are one document or item, with the shingles of all its rows; rows with a null id are
    left out, as they can't be named. Only the columns named are read. Empty tables give no rows. Very long texts are shingled whole, as one row.
    """
    own = docs.select(docs[id_col].cast("long").alias("id"), words(docs[text_col]).alias("w")).where("id is not null")
    wanted = stored(items.select(items[item_id_col].cast("long").alias("id"), words(items[item_text_col]).alias("w")).where("id is not null"), "items")
    minima = stored(item_minima(wanted, n_words), "item-minima")
    known = minima.count()
    small = sieve(minima.where(F.col("n_item") <= SMALL_ITEM).select("hash").distinct())
    counts = (F.col("least") & (F.col("class") >= F.col("first_class"))) | (F.col("n_item") <= SMALL_ITEM)
    hits = document_minima(own, n_words, small).join(sized(minima, known, 64), "hash").where(counts).select("doc_id", "item_id", "hash", "n_item")
    enough = F.greatest(F.lit(1), F.floor(F.col("n_item") / 5) - 1)
    pairs = stored(hits.groupBy("doc_id", "item_id").agg(F.count_distinct("hash").alias("n"), F.min("n_item").alias("n_item")).where(F.col("n") >= enough).select("doc_id", "item_id"), "leak-pairs")
    suspects = stored(pairs.select(F.col("doc_id").alias("id")).distinct(), "leak-suspects")

    exact = stored(_shingles(wanted, _string, n_words).select(F.col("id").alias("item_id"), F.explode("set").alias("shingle")).distinct(), "item-shingles")
    longest = exact.agg(F.coalesce(F.max(F.octet_length("shingle")), F.lit(0))).first()[0]
    sizes = exact.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_item"))
    texts = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].alias("text")).join(sized(suspects), "id", "left_semi")
    theirs = _shingles(texts.select("id", words(F.col("text")).alias("w")), _string, n_words).select(F.col("id").alias("doc_id"), F.explode("set").alias("shingle"))
    shared = theirs.join(sized(exact, known, 64 + longest), "shingle").groupBy("doc_id", "item_id").agg(F.count_distinct("shingle").alias("n_shared"))
    found = shared.join(sized(pairs), ["doc_id", "item_id"], "left_semi").join(sized(stored(sizes, "item-sizes")), "item_id")
    share = F.col("n_shared") / F.col("n_item")
    return found.where(share >= containment).select(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_id_col), "n_shared", "n_item", share.alias("containment"))


def without_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of docs that hold no item, with all their columns, whatever these are called; rows with a null id stay."""
    name = fresh(docs, "leaking")
    leaks = stored(contaminated(docs, items, id_col).select(F.col(id_col).alias(name)).distinct(), "leaks")
    return docs.join(sized(leaks, width=64), docs[id_col].cast("long") == leaks[name], "left_anti")


def decontamination_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))


_SETS = r"""
  SELECT DISTINCT id, CASE WHEN len(w) >= 5 THEN array_to_string(w[i:i + 4], ' ') ELSE array_to_string(w, ' ') END AS shingle
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
        FROM (SELECT {id} AS id, list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) > 0)
"""
ORACLE = (
    "WITH d AS (" + _SETS.replace("{id}", "doc_id").replace("{table}", "documents") + "), b AS (" + _SETS.replace("{id}", "item_id").replace("{table}", "benchmark") + "),"
    """ n AS (SELECT id, count(*) AS n_item FROM b GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, count(*) AS n_shared, any_value(n_item) AS n_item, count(*) / any_value(n_item) AS containment
FROM d JOIN b ON d.shingle = b.shingle JOIN n ON n.id = b.id GROUP BY d.id, b.id HAVING count(*) / any_value(n_item) >= 0.8"""
)
