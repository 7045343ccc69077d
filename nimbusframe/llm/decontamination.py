"""Operator 9: benchmark decontamination with spaced seeds, in DataFrame functions only.

Words are lower-cased runs of non-white-space, hashed once. Each fixed mask reads some
positions of a window and ignores the others, so a substituted word at an ignored
position does not hide a match. Hashes of masked windows of the documents are joined with
those of the benchmark items. Around a hit, document and item are laid side by side: the
window, REACH words wider on both sides where both have them, must agree in at least
LEAST words and a share of SHARE of those compared.

The benchmark side is broadcast only if its texts together have at most BROADCAST_WORDS words (each
gives a row of at most some 200 bytes for each mask); beyond that the seeds are joined by a shuffle, and the word hashes are fetched for hit documents only.

Items of fewer than LEAST words are found as they are, by the hash of all their words: anywhere in a document if
they have WITHIN words or more; shorter ones must be the whole document, as such phrases stand in many texts.

Defined cases: null and empty texts on either side have no windows. Any other overlap is of at
least LEAST words. Rows repeated with id and text give one result row and are all removed by
``without_benchmark``, which judges by text and so handles null ids too; repeated items count once, the same
text under several ids is reported under each. Columns other than the id and the text play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nimbusframe.llm.common import saved, table

#: Parameters. In a mask 1 reads a position and 0 ignores it.
MASKS, REACH, LEAST, SHARE, WITHIN, BROADCAST_WORDS = ("110110101", "11100100101"), 2, 10, 0.7, 5, 400_000
WHITE_SPACE = "\t\n\x0b\x0c\r "


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text; empty without words."""
    bare = F.trim(F.lower(text), F.lit(WHITE_SPACE))
    return F.when(F.length(bare) > 0, F.transform(F.split(bare, "[\\x20\\x09-\\x0D]+"), lambda w: F.xxhash64(w))).otherwise(F.array().cast("array<long>"))


def seeds(hashes: Column, mask: str, number: int) -> Column:
    """Hash of the masked window at every position, in order."""
    read = [k for k, c in enumerate(mask) if c == "1"]
    last = F.size(hashes) - len(mask)
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in read], F.lit(number)))


def text_key(text: Column) -> tuple[Column, Column]:
    """128 bits that stand for a text."""
    return F.xxhash64(text).alias("key_a"), F.xxhash64(F.lit("second"), text).alias("key_b")


def item_seeds(items: DataFrame, masks: list[str]) -> DataFrame:
    """One row for each window of each mask of the items: item_id, mask, seed, and ``near``, the words around
    the window, of which ``lead`` come before it. A row is of bounded size however long the item. Masks after the first ones take short items whole."""
    parts = []
    for k, m in enumerate(masks):
        own = items if k < len(MASKS) else items.where(F.size("h") == len(m))
        parts.append(own.select("item_id", "h", F.posexplode(seeds(F.col("h"), m, k)).alias("item_pos", "seed"), F.lit(k).alias("mask"), F.lit(len(m)).alias("span")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    lead = F.least(F.col("item_pos"), F.lit(REACH))
    return out.select("item_id", "mask", "span", "seed", lead.alias("lead"), F.slice("h", F.col("item_pos") - lead + 1, lead + F.col("span") + REACH).alias("near"))


def document_windows(h: Column, mask: str, number: int) -> Column:
    """Seeds of a document for one mask; very short items have to be the whole document."""
    own = seeds(h, mask, number)
    return F.when(F.size(h) == len(mask), own).otherwise(F.array().cast("array<long>")) if number >= len(MASKS) and len(mask) < WITHIN else own


def document_seeds(rows: DataFrame, keep: list[str], masks: list[str]) -> DataFrame:
    """One row for each window: ``keep``, at and seed, in one pass; the masks' windows are lined up end to end."""
    return rows.select(*keep, F.posexplode(F.concat(*[document_windows(F.col("h"), m, k) for k, m in enumerate(masks)])).alias("at", "seed"))


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Verified overlaps: key_a, key_b, doc_id, item_id, n_matched, n_compared, doc_start, doc_end (in words).

    One row for each document, item and alignment-best window.
    """
    words = benchmark.where(F.col("text").isNotNull()).select("item_id", word_hashes(F.col("text")).alias("h")).distinct()
    size, short = words.agg(F.sum(F.size("h")), F.collect_set(F.when(F.size("h").between(1, LEAST - 1), F.size("h")))).first()  # fewer than LEAST numbers
    masks = [*MASKS, *("1" * k for k in sorted(short))]
    items = item_seeds(words, masks)
    small = (size or 0) <= BROADCAST_WORDS
    hashed = docs.where(F.col("text").isNotNull()).select("doc_id", *text_key(F.col("text")), word_hashes(F.col("text")).alias("h"))
    ids = ["doc_id", "key_a", "key_b"]
    if small:
        hits = document_seeds(hashed, [*ids, "h"], masks).join(F.broadcast(items), "seed")
    else:
        narrow = document_seeds(hashed, ids, masks).join(items, "seed")
        hits = narrow.join(hashed.select("key_a", "key_b", "h").dropDuplicates(["key_a", "key_b"]), ["key_a", "key_b"])
    # Where the window stands in the document: the masks' windows come one mask after the other.
    n, before, start = F.size("h"), F.lit(0), F.lit(None).cast("int")
    for k, m in enumerate(masks):
        start = F.when(F.col("mask") == k, F.col("at") - before).otherwise(start)
        before = before + (F.greatest(n - len(m) + 1, F.lit(0)) if k < len(MASKS) or len(m) >= WITHIN else (n == len(m)).cast("int"))
    hits = hits.withColumn("pos", start)
    hits = hits.withColumn("whole", F.col("mask") >= len(MASKS))
    low = F.greatest(-F.lit(REACH), -F.col("pos"), -F.col("lead"))
    high = F.least(F.col("span") + REACH, n - F.col("pos"), F.size("near") - F.col("lead")) - 1
    hits = hits.withColumn("low", low).withColumn("high", high)
    matched = F.aggregate(F.sequence("low", "high"), F.lit(0), lambda s, k: s + (F.get("h", F.col("pos") + k) == F.get("near", F.col("lead") + k)).cast("int"))
    hits = hits.select(*ids, "item_id", "whole", "span", matched.alias("n_matched"), (F.col("high") - F.col("low") + 1).alias("n_compared"), (F.col("pos") + F.col("low")).alias("doc_start"), (F.col("pos") + F.col("high") + 1).alias("doc_end"))
    least = F.when(F.col("whole"), F.col("span")).otherwise(F.lit(LEAST))
    good = hits.where((F.col("n_matched") >= least) & (F.col("n_matched") >= SHARE * F.col("n_compared")))
    return good.groupBy(*ids, "item_id").agg(
        F.max("n_matched").alias("n_matched"), F.max_by("n_compared", F.struct("n_matched", "doc_start")).alias("n_compared"),
        F.min("doc_start").alias("doc_start"), F.max("doc_end").alias("doc_end"), F.count("*").alias("n_windows"),
    )


def without_benchmark(docs: DataFrame, benchmark: DataFrame, most: int = 2_000_000) -> DataFrame:
    """The documents whose text overlaps no benchmark item, with all their columns."""
    found = saved(overlaps(docs, benchmark).select("key_a", "key_b").distinct())
    a, b = text_key(F.col("text"))
    keyed = docs.select("*", F.when(F.col("text").isNotNull(), a).alias("__key_a"), F.when(F.col("text").isNotNull(), b).alias("__key_b"))
    side = F.broadcast(found) if found.count() <= most else found  # 16 bytes a row
    return keyed.join(side, (F.col("__key_a") == side["key_a"]) & (F.col("__key_b") == side["key_b"]), "left_anti").select(*docs.columns)


def op9_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_matched", "n_compared", "doc_start", "doc_end", "n_windows")
