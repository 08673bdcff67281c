"""Benchmark decontamination by a prefix-filtered set join, in DataFrame and SQL functions only.

Items and documents are cut into words, an item's windows are its runs of ``window`` words (an item with fewer words
is one window). A window's tokens are its shingles of ``shingle`` words. Tokens are ordered by how many times they
stand in the corpus, counted over all documents; since a window must be contained whole, its necessary prefix is its
one rarest token. Documents meet items on these prefix tokens only; the token's place in the window gives where the
window would begin, places that don't fit between the document's ends are dropped, and the words from there are
compared with the window's. A document with candidates is laid out in chunks of ``chunk_words`` words for that, each with the
words that a window from its last place reaches, so no row holds all candidates of a long document.

Documents are cut into tokens once: the places of item tokens are written, and give the counts as well as the places of
prefix tokens. Before a place is hashed and made a row, its first two words are looked up in a bitmap of those that item
tokens begin with (``first_words``), which has no false negatives; the driver sees the bitmap's words only, 16,384 at
most. Tokens of the items, and the keys of documents with candidates, are broadcast if there are at most
``broadcast_rows`` of them (a row is 30 bytes or so) and, for what the items bring, at most ``broadcast_bytes`` of words
and ids in all windows; beyond that the same joins are left to Spark's shuffles.

Defined results: null texts have no words; items without words are never found; null item ids are left out of lists
and counts but their windows still hit; items and documents that repeat count once per id, respectively per row
content. A document without words has no hit. Empty tables give no rows, or rows without hits. Texts of any length are
cut into words whole; a row must fit in a task's memory with its words. Only the id and text columns are read, others
may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.llm.common import shared_table, table, whole_text

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BITMAP_BITS = 1 << 20


def words_of(text: Column) -> Column:
    """Words in order: runs of digits, letters and non-ASCII characters, A to Z in lower case."""
    return F.filter(F.split(F.translate(text, UPPER, LOWER), GAPS), lambda w: w != "")


def shingle_hashes(words: Column, length: int) -> Column:
    """The hash of the ``length`` words at each place; shorter at the end, where no shingle of that length is."""
    return F.transform(words, lambda w, i: F.xxhash64(F.lit(length), w, *[F.get(words, i + t) for t in range(1, length)]))


def item_windows(items: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    """(window_key, win, item_ids): distinct windows with the items that have them."""
    words = items.select(F.col(id_col).alias("item_id"), words_of(whole_text(text_col)).alias("w")).where("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    return (
        words.select("item_id", "w", F.explode(starts).alias("start"))
        .select("item_id", F.slice("w", F.col("start"), F.lit(window)).alias("win"))
        .groupBy("win")
        .agg(F.collect_set("item_id").alias("item_ids"))
        .withColumn("window_key", F.xxhash64("win"))
    )


def beginning(words: Column, place: Column, length: int) -> Column:
    """The hash of the first two of the ``length`` words at a place, or of the one."""
    return F.xxhash64(*[F.get(words, place + t) for t in range(min(2, length))])


def first_words(tokens: DataFrame, length: int) -> Column:
    """A literal bitmap over what the windows' tokens of one length begin with, eight bits or more for each of them as long as
    that is within ``BITMAP_BITS``."""
    begins = tokens.where(F.col("length") == length).select(beginning(F.col("win"), F.col("offset"), length).alias("h")).distinct()
    bits = 1 << 10
    n = begins.count()
    while bits < min(8 * n, BITMAP_BITS):
        bits *= 2
    at = F.pmod("h", F.lit(bits)).alias("at")
    rows = begins.select(at).select(F.shiftright("at", 6).alias("k"), F.expr("shiftleft(1L, cast(at % 64 as int))").alias("bit")).groupBy("k").agg(F.bit_or("bit").alias("v")).collect()
    held = [0] * (bits // 64)
    for row in rows:  # at most bits / 64
        held[row.k] = row.v
    return F.split(F.lit(",".join(map(str, held))), ",").cast("array<long>")


def is_first(bitmap: Column, words: Column, place: Column, length: int) -> Column:
    """Whether the bitmap may hold what the ``length`` words at a place begin with."""
    at = F.pmod(beginning(words, place, length), F.size(bitmap).cast("long") * 64)
    return F.call_function("bit_get", F.get(bitmap, F.shiftright(at, 6).cast("int")), at.bitwiseAND(63).cast("int")) == 1


def token_places(rows: DataFrame, tokens: DataFrame, lengths: list[int]) -> DataFrame:
    """A row (doc_id, row_key, n_words, place from 0, token) for the shingles of each length that may be among ``tokens``."""
    words = F.col("words")

    def of_length(n: int) -> DataFrame:
        bitmap = first_words(tokens, n)
        places = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        near = F.filter(places, lambda i: is_first(bitmap, words, i, n))
        token = lambda i: F.xxhash64(F.lit(n), *[F.get(words, i + t) for t in range(n)])
        found = F.explode(F.transform(near, lambda i: F.struct(i.alias("place"), token(i).alias("token")))).alias("at")
        return rows.select("doc_id", "row_key", "n_words", found).select("doc_id", "row_key", "n_words", "at.place", "at.token")

    parts = [of_length(n) for n in lengths]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    window: int = 13,
    shingle: int = 5,
    least_share: int = 20,
    broadcast_rows: int = 1_000_000,
    broadcast_bytes: int = 64 << 20,
    chunk_words: int = 4096,
) -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0 and least_share * n_hit >= n_words), item_ids, row_key."""
    cut = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    cut = cut.select("doc_id", F.xxhash64("text").alias("row_key"), words_of(F.col("text")).alias("words"))
    cut = shared_table(cut.withColumn("n_words", F.size("words").cast("long")), "document-words")
    windows = shared_table(item_windows(items, item_id_col, item_text_col, window), "item-windows")
    ids = F.transform("item_ids", lambda i: i.cast("string"))
    held = F.octet_length(F.array_join("win", ",")) + F.octet_length(F.array_join(ids, ",")) + 16 * (F.size("win") + F.size("item_ids"))
    n_windows, n_bytes = windows.agg(F.count(F.lit(1)), F.coalesce(F.sum(held.cast("long")), F.lit(0))).first()
    small = F.broadcast if n_windows * window <= broadcast_rows and n_bytes <= broadcast_bytes else (lambda df: df)
    # At most `shingle` different lengths: items shorter than a shingle are tokens as a whole.
    lengths = [r[0] for r in windows.select(F.least(F.size("win"), F.lit(shingle)).alias("n")).distinct().orderBy("n").collect()]
    length = F.least(F.size("win"), F.lit(shingle))
    placed = [
        windows.where(length == n).select("window_key", "win", F.lit(n).alias("length"), F.posexplode(F.slice(shingle_hashes(F.col("win"), n), F.lit(1), F.size("win") - n + 1)).alias("offset", "token"))
        for n in lengths
    ]
    n_words, none = cut.select("doc_id", "row_key", "n_words"), F.array().cast("array<string>")
    if not placed:
        return _verdicts(n_words.withColumn("n_hit", F.lit(0).cast("long")).withColumn("items", none), least_share)
    tokens = placed[0]
    for part in placed[1:]:
        tokens = tokens.union(part)
    tokens = shared_table(tokens, "item-tokens")
    vocabulary = tokens.select("token").distinct()
    found = token_places(cut, tokens, lengths).join(small(vocabulary), "token")
    found = shared_table(found.select("doc_id", "row_key", "n_words", "place", "token"), "token-places")
    counts = found.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    # The rarest token of a window; one that no document has rules the window out.
    ranked = tokens.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    prefix = ranked.groupBy("window_key", "win").agg(F.min(F.struct("n", "token", "offset")).alias("least")).where("least.n > 0")
    prefix = shared_table(prefix.select("window_key", "win", F.col("least.token").alias("token"), F.col("least.offset").alias("offset"), F.size("win").alias("length")), "prefix-tokens")
    begin, key, chunk = F.col("place") - F.col("offset"), ["doc_id", "row_key"], F.floor(F.col("begin") / chunk_words).cast("int").alias("chunk")
    candidates = (
        found.join(small(prefix), "token")
        .where((begin >= 0) & (begin + F.col("length") <= F.col("n_words")))
        .select(*key, begin.alias("begin"), "length", "window_key")
        .groupBy(*key, chunk)
        .agg(F.collect_set(F.struct("begin", "length", "window_key")).alias("candidates"))
    )
    candidates = shared_table(candidates, "candidates")
    keys = candidates.select("row_key").distinct()
    keys = F.broadcast(keys) if candidates.count() <= broadcast_rows else keys
    words = cut.join(keys, "row_key", "left_semi").select(*key, "words", F.explode(F.sequence(F.lit(0), F.floor((F.col("n_words") - 1) / chunk_words).cast("int"))).alias("chunk"))
    words = words.select(*key, "chunk", F.slice("words", F.col("chunk") * chunk_words + 1, chunk_words + window).alias("words")).dropDuplicates([*key, "chunk"]).alias("w")
    on = (F.col("w.row_key") == F.col("c.row_key")) & F.col("w.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("w.chunk") == F.col("c.chunk"))
    there = lambda c: F.slice("words", c["begin"] - F.col("w.chunk") * chunk_words + 1, c["length"])
    like = F.filter("candidates", lambda c: F.xxhash64(there(c)) == c["window_key"])
    hits = words.join(candidates.alias("c"), on).select("w.doc_id", "w.row_key", "w.chunk", "words", F.explode(like).alias("h"))
    hits = hits.select(*key, F.col("h.begin").alias("begin"), (F.col("h.begin") + F.col("h.length")).alias("end"), F.col("h.window_key").alias("window_key"), F.slice("words", F.col("h.begin") - F.col("chunk") * chunk_words + 1, F.col("h.length")).alias("win"))
    hits = shared_table(hits.join(small(windows.select("window_key", "win")), ["window_key", "win"], "left_semi"), "hits")
    # Words in the union of a row's hit spans: each span adds what reaches beyond those before it.
    earlier = Window.partitionBy(*key).orderBy("begin", "end").rowsBetween(Window.unboundedPreceding, -1)
    beyond = F.greatest(F.lit(0), F.col("end") - F.greatest("begin", F.coalesce(F.max("end").over(earlier), F.lit(0))))
    spans = hits.select(*key, beyond.cast("long").alias("n")).groupBy(*key).agg(F.sum("n").alias("n_hit"))
    named = (
        hits.select(*key, "window_key", "win").distinct()
        .join(small(windows.select("window_key", "win", "item_ids")), ["window_key", "win"])
        .select(*key, F.explode("item_ids").alias("item"))
        .groupBy(*key).agg(F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"))
    )
    marked = shared_table(spans.alias("s").join(named.alias("m"), (F.col("s.row_key") == F.col("m.row_key")) & F.col("s.doc_id").eqNullSafe(F.col("m.doc_id")), "left").select("s.doc_id", "s.row_key", "n_hit", "items"), "marked")
    on = (F.col("d.row_key") == F.col("f.row_key")) & F.col("d.doc_id").eqNullSafe(F.col("f.doc_id"))
    rows = n_words.alias("d").join(marked.alias("f"), on, "left").select("d.doc_id", "d.row_key", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", none).alias("items"))
    return _verdicts(rows, least_share)


def _verdicts(rows: DataFrame, least_share: int) -> DataFrame:
    return rows.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.lit(least_share) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        F.col("items").alias("item_ids"), "row_key",
    )


def without_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` that aren't contaminated, with all their columns."""
    bad = contamination(docs, items, id_col, text_col, **settings).where("contaminated").select(F.col("doc_id").alias("bad_id"), F.col("row_key").alias("bad_key")).distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("own_id"), F.xxhash64(whole_text(text_col)).alias("own_key"))
    same = F.col("own_id").eqNullSafe(F.col("bad_id")) & (F.col("own_key") == F.col("bad_key"))
    return rows.join(shared_table(bad, "contaminated"), same, "left_anti").select("row.*")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages in ``documents``."""
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


OP7_SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM documents
), bw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, w[s : s + 12] AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS s FROM bw WHERE len(w) > 0)
), lens AS (
  SELECT DISTINCT len(win) AS n FROM win
), runs AS (
  SELECT doc_id, n, s, w[s : s + n - 1] AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, lens WHERE len(w) >= n)
), hit AS (
  SELECT doc_id, s, n, item_id FROM runs JOIN win USING (win)
), places AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hit)) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""
