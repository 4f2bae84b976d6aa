"""Document fingerprints by one-permutation MinHash, in DataFrame functions only.

Shingles are hashed once. The upper bits of a hash name its bin, and each bin keeps its least hash. Empty bins borrow from a
filled bin that a hash of (empty bin, filled bin) chooses, the same for all documents (optimal densification). Only the low-order
bits of each bin's hash are kept, and likeness is corrected for bits that agree by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import parts_for, text_bytes

BINS, BITS = 128, 8
SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
COARSE = 1000


def let(value: Column, body) -> Column:
    """body(value) with value computed once, whatever the optimiser does to projections."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shingle_hashes(text: Column, words: int = 5) -> Column:
    """array<bigint>: hashes of all runs of `words` words of the text (A-Z as a-z); of the whole sequence if it is shorter."""

    def of(w: Column) -> Column:
        return (
            F.when(F.size(w) == 0, F.expr("cast(array() as array<bigint>)"))
            .when(F.size(w) < words, F.array(F.xxhash64(F.lit(0), w)))
            .otherwise(F.transform(F.sequence(F.lit(0), F.size(w) - words), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(words)))))
        )

    split = F.filter(F.split(F.translate(text, UPPER, LOWER), SPACE), lambda x: x != "")
    return let(F.transform(split, lambda x: F.xxhash64(x)), of)


def bin_of(h: Column) -> Column:
    """The bin of a hash, from -BINS/2: its upper bits."""
    return F.shiftright(h, 64 - (BINS.bit_length() - 1)).cast("int")


def packed_bins(hashes: Column) -> Column:
    """array<tinyint> of the bins' low-order bits, BINS long; empty for an empty set."""

    def first_of_bin(s: Column) -> Column:
        return F.filter(s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(s, i - 1))))

    def dense(least: Column) -> Column:
        low = lambda h: h.bitwiseAND(F.lit((1 << BITS) - 1))
        borrowed = lambda b: low(F.array_min(F.transform(least, lambda h: F.xxhash64(b, bin_of(h)).bitwiseAND(F.lit(-(1 << BITS))).bitwiseOR(low(h)))))
        none = F.expr("cast(array() as array<bigint>)")
        gap = lambda low_bin, high_bin: F.when(low_bin > high_bin, none).otherwise(F.transform(F.sequence(low_bin, high_bin), borrowed))
        # the filled bins in order, each after the empty ones before it
        own = F.transform(least, lambda h, i: F.concat(gap(F.coalesce(bin_of(F.get(least, i - 1)), F.lit(-BINS // 2 - 1)) + 1, bin_of(h) - 1), F.array(low(h))))
        every = F.concat(F.flatten(own), gap(bin_of(F.get(least, F.size(least) - 1)) + 1, F.lit(BINS // 2 - 1)))
        return F.when(F.size(least) == 0, F.expr("cast(array() as array<tinyint>)")).otherwise(F.transform(every, lambda v: (v - F.lit(128)).cast("tinyint")))

    return let(let(F.sort_array(hashes), first_of_bin), dense)


def fingerprint_text(packed: Column) -> Column:
    """The packed bins as hexadecimal text; zeros for an empty set."""
    joined = F.lower(F.array_join(F.transform(packed, lambda v: F.substring(F.hex(v.cast("int") + 384), 2, 2)), ""))
    return F.when(F.size(packed) == 0, F.lit("0" * (BINS * BITS // 4))).otherwise(joined)


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the sets behind two packed fingerprints, without what agrees by chance.

    Equal fingerprints: 1. An empty set and another: 0."""
    by_chance = 2.0**-BITS
    same = F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x) / BINS
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), (same - by_chance) / (1 - by_chance)))


def id_buckets(docs: DataFrame, n: int) -> Column:
    """A bucket number that ascends with doc_id: up to COARSE buckets of about equal counts, each in equal widths."""
    coarse = min(n, COARSE)
    fine = -(-n // coarse)
    cuts = docs.agg(F.percentile_approx("doc_id", [k / coarse for k in range(1, coarse)] + [1.0], 100_000).alias("c"), F.min("doc_id").alias("least")).first()
    if cuts["least"] is None:
        return F.lit(0).cast("long")
    bounds = F.array(*(F.lit(x).cast("long") for x in [cuts["least"], *sorted(set(cuts["c"]))]))

    def place(k: Column) -> Column:
        low, high = F.get(bounds, k), F.get(bounds, k + 1)
        return F.least(F.lit(fine - 1), F.floor((F.col("doc_id") - low) * fine / F.greatest(F.lit(1), high - low))).cast("long") + k.cast("long") * fine

    # bucket k holds bounds[k] <= doc_id < bounds[k + 1]; the last one holds its upper bound too
    below = F.least(F.size(F.filter(bounds, lambda x: x <= F.col("doc_id"))) - 1, F.size(bounds) - 2)
    return F.coalesce(let(F.greatest(F.lit(0), below), place), F.lit(-1).cast("long"))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint each document and its edited text, whose last quarter comes from the next document's beginning.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Next: by ascending doc_id,
    then text; after the last comes the first. Null text is empty; a text without words has the empty set. Rows without
    doc_id come first. Equal rows follow each other. Other columns are not read. An empty table gives no rows.

    Texts are shuffled once, by a bucket of doc_id that holds a few MB; the first row of each bucket is added to the one before."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n_bytes = text_bytes(docs)
    n = min(parts_for(n_bytes, 2 << 20), COARSE * COARSE)
    docs = docs.withColumn("bucket", id_buckets(docs, n))
    lead = F.min_by("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    firsts = docs.groupBy("bucket").agg(lead.alias("first_id"))
    order = Window.orderBy("bucket")  # of at most one row a bucket
    before = firsts.select("first_id", F.coalesce(F.lag("bucket").over(order), F.max("bucket").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("goes_to"))
    extra = docs.join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("first_id"))).groupBy("goes_to").agg(F.min("text").alias("text"))  # as many rows as buckets, which n bounds
    extra = extra.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("goes_to").alias("bucket"), F.lit(1).alias("extra"))
    rows = docs.withColumn("extra", F.lit(0)).unionByName(extra).withColumn("bins", packed_bins(shingle_hashes(F.col("text"))))
    rows = rows.repartition(parts_for(n_bytes, 24 << 20), "bucket")
    by_id = Window.partitionBy("bucket").orderBy("extra", "doc_id", "text")
    rows = rows.withColumns({"next_text": F.lead("text").over(by_id), "next_bins": F.lead("bins").over(by_id)}).where("extra = 0")
    n_chars = F.length("text")
    quarter = F.floor(n_chars / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n_chars - quarter), F.substring("next_text", F.lit(1), quarter)))
    rows = rows.withColumn("edited_bins", packed_bins(shingle_hashes(F.col("edited"))))
    return rows.select(
        "doc_id",
        n_chars.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint_text(F.col("bins")).alias("fingerprint"),
        fingerprint_text(F.col("edited_bins")).alias("edited_fingerprint"),
        likeness(F.col("bins"), F.col("edited_bins")).alias("near_edited"),
        likeness(F.col("bins"), F.col("next_bins")).alias("near_next"),
    )
