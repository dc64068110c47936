"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

An item's windows of words must occur whole in a document, so each window needs
only one prefix token: its rarest word by corpus frequency.  Document words join
that token, the token's place bounds where the window can start and end, and the
stretch there is compared with the window word by word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.plans.staging import Stage

#: Windows (of at most ``window`` words), and pairs of item and window, that are sent to every task; more are joined by a shuffle.
MOST_BROADCAST = 100_000
# The bytes that separate words, and the letters lowered.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text with A-Z lowered; null has none."""
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.array_remove(F.split(F.coalesce(plain, F.lit("")), SEPARATORS), "")


def item_windows(items: DataFrame, window: int) -> DataFrame:
    """item, word list and length of each distinct window of each item with words."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text").cast("string")).alias("w")).where("size(w) > 0")
    starts = F.expr(f"sequence(0, greatest(size(w) - {window}, 0))")
    w = w.select("item", "w", F.explode(starts).alias("s"))
    return w.select("item", F.expr(f"slice(w, s + 1, {window})").alias("seq")).distinct()


def contaminated_documents(docs: DataFrame, items: DataFrame, window: int = 10) -> DataFrame:
    """Words of ``docs(doc_id, text)`` inside occurrences of windows of ``items(item_id, text)``.

    A window is ``window`` consecutive words of an item; a shorter item is one
    window.  Returns doc_id, n_words, n_hit, n_items, items_sha256 and contaminated.

    Null and empty texts have no words and no hits.  Items without words have no
    window; an item without item_id marks words but is no counted item.  Every row
    of docs, repeated or with a null doc_id, gets the result of its own text.
    Without documents there are no rows; without items nothing is hit.
    """
    stage = Stage(docs.sparkSession, "decontaminate")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    owned = stage.put(item_windows(items, window), "owned")
    windows = stage.put(owned.select("seq").distinct().withColumn("wid", F.monotonically_increasing_id()), "windows")
    small, small_owned = windows.count() <= MOST_BROADCAST, owned.count() <= MOST_BROADCAST
    sent = F.broadcast if small else lambda df: df

    tokens = windows.select("wid", "seq", F.posexplode("seq").alias("off", "token"))
    distinct = tokens.select("token").distinct()
    seen = docs.select(F.explode(words(F.col("text"))).alias("token")).join(sent(distinct), "token")
    frequency = seen.groupBy("token").agg(F.count("*").alias("n"))
    ranked = tokens.join(frequency, "token")  # a window with a token that no document has can't occur
    all_there = ranked.groupBy("wid").agg(F.count("*").alias("known"), F.min(F.struct("n", "off", "token")).alias("rarest"))
    prefix = windows.join(all_there, "wid").where("known = size(seq)")
    prefix = stage.put(prefix.selectExpr("wid", "seq", "rarest.token token", "rarest.off off"), "prefix")

    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), words(F.col("text")).alias("w"))
    places = keyed.select("doc_id", "h", "w", F.posexplode("w").alias("pos", "token"))
    bounded = "pos >= off and pos - off + size(seq) <= size(w)"
    if small:
        verified = F.expr(f"case when {bounded} then slice(w, pos - off + 1, size(seq)) = seq else false end")
        hits = places.join(F.broadcast(prefix), "token").where(verified)
    else:
        found = places.withColumn("size_w", F.size("w")).drop("w").join(prefix, "token").where(bounded.replace("size(w)", "size_w"))
        hits = _rejoined(found, keyed).where("slice(w, pos - off + 1, size(seq)) = seq")
    hits = stage.put(hits.selectExpr("doc_id", "h", "pos - off start", "pos - off + size(seq) stop", "wid").distinct(), "hits")

    doc = ["doc_id", "h"]
    before = Window.partitionBy(*doc).orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.select(*doc, "start", "stop").distinct()
    covered = F.greatest(F.lit(0), F.col("stop") - F.greatest(F.col("start"), F.coalesce(F.max("stop").over(before), F.lit(0))))
    n_hit = spans.withColumn("c", covered).groupBy(*doc).agg(F.sum("c").alias("n_hit"))
    ids = windows.join(owned, "seq").select("wid", "item").where("item is not null")
    per_item = hits.select(*doc, "wid").distinct().join(F.broadcast(ids) if small_owned else ids, "wid").select(*doc, "item").distinct()
    listed = per_item.groupBy(*doc).agg(F.count("*").alias("n_items"), F.concat_ws(",", F.sort_array(F.collect_list("item"))).alias("items"))
    found = n_hit.join(listed, [n_hit["doc_id"].eqNullSafe(listed["doc_id"]), n_hit["h"].eqNullSafe(listed["h"])], "left")
    found = found.select(n_hit["doc_id"].alias("d"), n_hit["h"].alias("g"), "n_hit", "n_items", "items")

    base = docs.select("doc_id", F.xxhash64("text").alias("h"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(found, [base["doc_id"].eqNullSafe(found["d"]), base["h"] == found["g"]], "left")
    return out.select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def _rejoined(found: DataFrame, keyed: DataFrame) -> DataFrame:
    """Candidates with their document's words, for the path without a broadcast."""
    own = keyed.selectExpr("doc_id d", "h g", "w").dropDuplicates(["d", "g"])
    return found.join(own, [found["doc_id"].eqNullSafe(own["d"]), found["h"] == own["g"]])
