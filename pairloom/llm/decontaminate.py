"""Benchmark passages in documents by a prefix-filtered set join.

Every item gives windows of ``window`` consecutive words; a shorter item is one window. Containment
must be whole, so of a window's words, ordered by rarity in the corpus, the necessary prefix is the
rarest one: a document without it cannot hold the window. Documents are joined on that word alone;
its offset in the window bounds where the window may lie in the document, the two lengths bound
whether it fits, and the words in place are compared last, inside the join condition.

Where a benchmark has too many windows for a broadcast, words are joined with the distinct pairs of
offset and length that their windows have, which gives the passages a window could be; passages and
windows then meet by all their words, so that no frequent word gathers rows. A row of that join
carries the words around a place, not the text.

Everything is DataFrame operations. Null texts have no words. Rows with equal id and text get equal
results. Windows of an item with null id count as hits, but the item is not listed.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pairloom.llm.words import alnum_words, is_small, small
from pairloom.storage import materialise

WINDOW = 10


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct ``item``, ``words`` (array) over all items."""
    words = items.select(
        F.col("item_id").cast("string").alias("item"), alnum_words(F.col("text")).alias("ws")
    ).where(F.size("ws") > 0)
    last = F.greatest(F.size("ws") - window, F.lit(0))
    return (
        words.select("item", "ws", F.explode(F.sequence(F.lit(0), last)).alias("at"))
        .select("item", F.slice("ws", F.col("at") + 1, window).alias("words"))
        .distinct()
    )


def rarest_word(windows: DataFrame, tokens: DataFrame) -> DataFrame:
    """``word``, ``offset`` and ``words`` of each distinct window: its first word by rising count.

    ``tokens`` has one row with ``word`` for each word of the corpus; only words of windows are
    counted. Equal counts are ordered by the word, repeated words by position.
    """
    each = windows.select("words").distinct()
    vocabulary = materialise(each.select(F.explode("words").alias("word")).distinct())
    counts = tokens.join(small(vocabulary), "word", "left_semi").groupBy("word").agg(
        F.count(F.lit(1)).alias("n")
    )
    placed = each.select("words", F.posexplode("words").alias("offset", "word"))
    # As many counts as distinct words of items: usually a broadcast, so frequent words are not dealt out.
    ranked = placed.join(small(materialise(counts)), "word", "left").select(
        "words", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word", "offset").alias("r")
    )
    first = ranked.groupBy("words").agg(F.min("r").alias("r"))
    return first.select("r.word", "r.offset", "words")


def _key(docs: DataFrame) -> list[Column]:
    return [F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("text_hash")]


def occurrences(docs: DataFrame, windows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``text_hash``, ``start`` and ``words`` of every window found in a document.

    ``window`` is the length of the longest of ``windows``.
    """
    words = docs.select(*_key(docs), alnum_words(F.col("text")).alias("ws"))
    tokens = words.select(F.explode("ws").alias("word"))
    prefix = materialise(rarest_word(windows, tokens).withColumnRenamed("word", "token"))
    placed = words.select("doc_id", "text_hash", "ws", F.posexplode("ws").alias("pos", "word"))
    if not is_small(prefix):
        return _occurrences_of_many(placed, prefix, window)
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.size("words") <= F.size("ws"))
    # slice() counts from 1 and must not see a start below that.
    same = F.slice("ws", F.greatest(start, F.lit(0)) + 1, F.size("words")) == F.col("words")
    return placed.join(F.broadcast(prefix), (F.col("word") == F.col("token")) & fits & same).select(
        "doc_id", "text_hash", start.alias("start"), "words"
    )


def _occurrences_of_many(placed: DataFrame, prefix: DataFrame, window: int) -> DataFrame:
    """The same for a ``prefix`` that is too large to send: by the passages its words may lie in."""
    steps = materialise(prefix.select("token", "offset", F.size("words").alias("len")).distinct())
    sent = is_small(steps)
    first = F.lit(0) if sent else F.greatest(F.col("pos") - (window - 1), F.lit(0))
    # Words that are joined where they lie may look at the text; those that are shuffled take a slice.
    near = F.col("ws") if sent else F.slice("ws", first + 1, 2 * window - 1)
    around = placed.select(
        "doc_id", "text_hash", "word", "pos", first.alias("first"), near.alias("near"), F.size("ws").alias("n")
    )
    start = F.col("pos") - F.col("offset")
    fits = (start >= 0) & (start + F.col("len") <= F.col("n"))
    passages = around.join(
        F.broadcast(steps) if sent else steps, (F.col("word") == F.col("token")) & fits
    ).select(
        "doc_id",
        "text_hash",
        start.alias("start"),
        F.slice("near", F.greatest(start - F.col("first"), F.lit(0)) + 1, F.col("len")).alias("passage"),
        F.col("word").alias("by"),
        F.col("offset").alias("by_offset"),
    )
    # A window has one rarest word, so a passage meets it once.
    met = (
        (F.col("passage") == F.col("words")) & (F.col("by") == F.col("token")) & (F.col("by_offset") == F.col("offset"))
    )
    return passages.join(prefix, met).select("doc_id", "text_hash", "start", "words")


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``,
    besides ``doc_id`` and ``text_hash``."""
    windows = materialise(item_windows(items, window))
    found = materialise(occurrences(docs, windows, window))
    key = ["doc_id", "text_hash"]
    spans = found.groupBy(*key, "start").agg(F.max(F.size("words")).alias("len"))
    ordered = Window.partitionBy(*key).orderBy("start")
    covered = F.max(F.col("start") + F.col("len")).over(
        ordered.rowsBetween(Window.unboundedPreceding, -1)
    )
    end = F.col("start") + F.col("len")
    fresh = F.greatest(end - F.greatest(F.coalesce(covered, F.lit(0)), F.col("start")), F.lit(0))
    hits = spans.select(*key, fresh.alias("fresh")).groupBy(*key).agg(F.sum("fresh").alias("n_hit"))
    listed = (
        found.select(*key, "words")
        .distinct()
        .join(windows.where("item is not null"), "words")
        .groupBy(*key)
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    sides = []
    for name, part in (("h", hits), ("i", listed)):
        sides.append(part.select(F.col("doc_id").alias(f"{name}_id"), F.col("text_hash").alias(f"{name}_hash"), part.columns[-1]))
    out = docs.select(*_key(docs), F.size(alnum_words(F.col("text"))).cast("long").alias("n_words"))
    for name, side in zip("hi", sides, strict=True):
        out = out.join(
            side,
            F.col("doc_id").eqNullSafe(F.col(f"{name}_id")) & (F.col("text_hash") == F.col(f"{name}_hash")),
            "left",
        )
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        "doc_id",
        "text_hash",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any benchmark window, with all their columns."""
    found = occurrences(docs, materialise(item_windows(items, window)), window)
    hit = materialise(
        found.select(F.col("doc_id").alias("_hit_id"), F.col("text_hash").alias("_hit_hash")).distinct()
    )
    same = docs["doc_id"].eqNullSafe(hit["_hit_id"]) & (F.xxhash64(docs["text"]) == hit["_hit_hash"])
    return docs.join(small(hit), same, "left_anti")
