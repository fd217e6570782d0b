"""Mixing sources to target weights by capped water-filling, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.llm.common import WORD, join_same, saved

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
#: Documents of a source are dealt to buckets by so many first digits of their seeded hash: 16^3 of them, and the one that matters to as many again.
BUCKET_DIGITS = (3, 6)


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target) for `sizes` (source, source_size: one row for each source).

    Sources by code point, null last, weigh `weights`, repeating, and share the sum of all sizes. A
    target stops at max_epochs times its source's size; the excess goes to the others by weight until no
    target is above. The water level is found in closed form: with sources in order of cap over
    weight, the first n are at their cap for the smallest n at which the rest stay below theirs. Running
    sums are whole numbers, so the order of addition is of no account. One row for each source goes
    through the windows.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    filled = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto, every = filled.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    level = (
        sizes.withColumn("w", weight.cast("long"))
        .withColumns({"cap": max_epochs * F.col("source_size"), "ratio": max_epochs * F.col("source_size") / F.col("w")})
        .withColumns({"rest": F.sum("source_size").over(every) - F.sum("cap").over(upto) + F.col("cap"), "rest_w": F.sum("w").over(every) - F.sum("w").over(upto) + F.col("w")})
        # a source is below its cap if, with all sources before it at their caps, its share of the rest is
        .withColumn("below", F.col("rest") * F.col("w") < F.col("cap") * F.col("rest_w"))
        .withColumn("first", F.min(F.when(F.col("below"), F.struct("ratio", F.col("source").isNull().alias("none"), "source", "rest", "rest_w"))).over(every))
    )
    at_cap = F.col("first").isNull() | (F.struct("ratio", F.col("source").isNull().alias("none"), "source") < F.struct("first.ratio", "first.none", "first.source"))
    share = (F.col("first.rest") * F.col("w")).cast("double") / F.col("first.rest_w").cast("double")
    return level.select("source", "source_size", F.when(at_cap, F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, key: str = "doc_id", weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix-1") -> DataFrame:
    """(key, source, size, source_size, target, copies, taken), one row for each row of `docs` (key, source, text).

    size: words of the whole text. Each document is taken floor(target / source_size) times. The fractional
    repetition takes further documents, whole and once each, in the order of md5(seed, key) within the source, as
    long as the words before them are fewer than the fraction's; so a source misses its target by less
    than one document. Running sums go over hash buckets first, over smaller ones in the one bucket where the fraction ends,
    and over documents only in the one of these, so no window holds a whole source; and documents meet the cuts bucket by bucket.

    Null text: size 0. A null source is a source. Empty texts have size 0 and take 0 words. Rows with the
    same key and source share their hash, and are taken or left together. A source without words
    has target 0 and no copies. An empty table gives no rows. Reruns agree.
    """
    hashed = F.md5(F.concat(F.lit(f"{seed}|"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    slim = saved(docs.select(F.col(key), F.col("source"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("size"), hashed.alias("h")).fillna(0, ["size"]), "sizes")
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = saved(
        targets(sizes, weights, max_epochs)
        .withColumn("whole", F.coalesce(F.floor(F.col("target") / F.nullif("source_size", F.lit(0))), F.lit(0)))
        .withColumn("more", F.col("target") - F.col("whole") * F.col("source_size")),
        "targets",
    )
    upto = lambda order: Window.partitionBy("source").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    bucket = lambda digits: F.substring("h", 1, digits)
    first = slim.groupBy("source", bucket(BUCKET_DIGITS[0]).alias("bucket")).agg(F.sum("size").alias("words"))
    cut, inside, rows, buckets = goal, goal.select("source", F.lit(0).cast("long").alias("before"), "more"), slim, first
    for digits in BUCKET_DIGITS:
        if digits != BUCKET_DIGITS[0]:
            buckets = rows.groupBy("source", bucket(digits).alias("bucket")).agg(F.sum("size").alias("words"))
        buckets = join_same(buckets, inside, ["source"]).withColumn("before", F.col("before") + F.sum("words").over(upto("bucket")) - F.col("words"))
        whole_buckets = buckets.where(F.col("before") + F.col("words") <= F.col("more")).groupBy("source").agg(F.max("bucket").alias(f"last_{digits}"))
        cut = join_same(cut, whole_buckets, ["source"], "left")
        split = buckets.where((F.col("before") < F.col("more")) & (F.col("before") + F.col("words") > F.col("more")))
        inside = saved(split.select("source", "bucket", "before", "more"), "split-buckets")
        rows = join_same(rows.withColumn("bucket", bucket(digits)), inside.select("source", "bucket"), ["source", "bucket"]).drop("bucket")
        inside = inside.drop("bucket")
    by_hash = join_same(rows.groupBy("source", "h").agg(F.sum("size").alias("words")), inside, ["source"])
    last = by_hash.where(F.col("words") > 0).withColumn("at", F.col("before") + F.sum("words").over(upto("h")) - F.col("words"))
    last = last.where("at + words / 2 <= more").groupBy("source").agg(F.max("h").alias("last_h"))
    cut = join_same(join_same(first.select("source", "bucket"), cut, ["source"]), last, ["source"], "left")
    extra = F.coalesce(F.col("h") <= F.col("last_h"), F.lit(False))
    for digits in BUCKET_DIGITS:
        extra |= F.coalesce(bucket(digits) <= F.col(f"last_{digits}"), F.lit(False))
    copies = F.col("whole") + F.when(extra & (F.col("more") > 0), 1).otherwise(0)
    joined = join_same(slim.withColumn("bucket", bucket(BUCKET_DIGITS[0])), cut, ["source", "bucket"]).select(key, "source", "size", "source_size", "target", copies.alias("copies"))
    return joined.withColumn("taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame, key: str = "doc_id", weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = "mix-1") -> DataFrame:
    """The rows of `docs`, each as often as mix() takes it: none, one or several times. Columns are those of docs.

    Texts without words, which take nothing of the mix, follow their source's copies as well.
    """
    copies = mix(docs, key, weights, max_epochs, seed).select(F.col(key).alias("k"), "source", "copies").distinct().where("copies > 0")
    rows = docs.select(F.col(key).alias("k"), "source", F.struct(*docs.columns).alias("doc"))
    return join_same(rows, copies, ["k", "source"]).select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")
