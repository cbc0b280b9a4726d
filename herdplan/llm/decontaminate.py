"""Benchmark decontamination by spaced-seed hashing, in DataFrame functions only.

A mask looks at some of a run of words and ignores the others; the words looked
at are hashed. Runs of training texts and of benchmark items with an equal hash
are joined, so one substituted word under an ignored position, or between two
runs, hides nothing. Every hit is verified on its diagonal: in the stretch of up
to 13 words of the item around the hit, three of four words must be equal at
their places. Words are runs of letters and digits, in lower case. Items below
the longest mask, from ``least_words`` words on, are too short to be told from
other text by a share of their words: all of an item, in order, must be there,
which a mask of its length without ignored places finds.

Runs of documents meet the item table inside one task: it is broadcast below
BROADCAST_BYTES, by a sum, and the words of a document are at hand when a
hit is verified. A larger benchmark is joined by a shuffle of hashes alone, and
hits fetch the words afterwards, by numbers of rows and of distinct item texts.

Defined results: null or empty texts hold nothing; equal items are one, the least
item_id names them; repeated rows and null ids are grouped by id; nothing but
key and item columns is returned, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialised, prepare, table

#: 1: looked at, 0: ignored. Any single substitution in four words or more
#: between two others leaves a run of the first mask whole.
MASKS = ("111011", "1101011")
STRETCH, SHARE = 13, 0.75
#: Bytes of the runs of items, and rows of contaminated documents, sent to all tasks at most.
BROADCAST_BYTES, BROADCAST_ROWS = 64 << 20, 1_000_000
#: Parts of the documents of one hash, and of one item, beyond that.
SPLIT = 16


def word_hashes(text: Column) -> Column:
    """Hashes of the words of a text, in order."""
    found = F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")
    return F.transform(found, lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, words: str, masks: tuple[str, ...] = MASKS) -> DataFrame:
    """``rows``, once for each run of their ``words`` under each mask, with the
    run's first word _at and the hash _seed of the words looked at."""

    def under(mask: str) -> Column:
        looked = [F.get(words, F.col("_at") + i) for i, c in enumerate(mask) if c == "1"]
        return F.when(F.col("_at") <= F.size(words) - len(mask), F.xxhash64(F.lit(int("1" + mask, 2)), *looked))

    least = min(map(len, masks))
    placed = rows.withColumn("_at", F.explode(F.when(F.size(words) >= least, F.sequence(F.lit(0), F.size(words) - least))))
    hashed = placed.select("*", *[under(m).alias(f"_seed{k}") for k, m in enumerate(masks)])
    each = F.stack(F.lit(len(masks)), *[F.col(f"_seed{k}") for k in range(len(masks))]).alias("_seed")
    return hashed.select(*placed.columns, each).where(F.col("_seed").isNotNull())


def item_runs(items: DataFrame, masks: tuple[str, ...]) -> tuple[DataFrame, tuple[str, ...]]:
    """(written rows of the items, one for each run, with its first word _q and
    its hash _seed; the masks that find them: more where items are short)."""
    longest = max(map(len, masks))
    short = items.select(F.size("_iw").alias("n")).where(F.col("n") < longest).distinct().orderBy("n").collect()  # fewer than ``longest`` rows
    whole = tuple("1" * r["n"] for r in short)
    own = seeds(items.where(F.size("_iw") >= longest), "_iw", masks)
    for mask in whole:
        own = own.unionByName(seeds(items.where(F.size("_iw") == len(mask)), "_iw", (mask,)))
    return materialised(own.withColumnRenamed("_at", "_q")), masks + whole


def equal_words(item: Column, words: Column, first: Column, start: Column, n: Column) -> Column:
    """How many of the item's words first .. first + n - 1 stand in the text,
    whose word ``start`` is under the item's word 0."""
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, j: a + F.coalesce(F.when(start + first + j >= 0, (F.get(item, first + j) == F.get(words, start + first + j)).cast("int")), F.lit(0)))


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", masks: tuple[str, ...] = MASKS, stretch: int = STRETCH, share: float = SHARE, least_words: int = 1, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Rows (key, item, item_words, equal_words, start_word): the documents that
    hold an item's passage, with their best alignment to it."""
    prepare(docs.sparkSession)
    longest = max(map(len, masks))
    items = benchmark.select(F.col(item).alias("_item"), word_hashes(F.col(text)).alias("_iw")).where(F.size("_iw") >= max(1, least_words)).groupBy("_iw").agg(F.min("_item").alias("_item"))
    items = materialised(items.withColumn("_no", F.monotonically_increasing_id()))
    run, masks = item_runs(items, masks)
    own = docs.select(F.col(key).alias("_key"), word_hashes(F.col(text)).alias("_w"))
    start, low = F.col("_at") - F.col("_q"), F.greatest(F.col("_start"), F.lit(0))
    # of the document's words only those under the item go on: hits stay small rows
    under = F.slice("_w", low + 1, F.least(F.col("_start") + F.col("_size"), F.size("_w")) - low).alias("_under")
    run = run.withColumn("_size", F.size("_iw"))
    if (run.agg(F.sum(8 * (F.col("_size") + 8))).first()[0] or 0) <= broadcast_bytes:
        hits = seeds(own, "_w", masks).join(F.broadcast(run), "_seed").withColumn("_start", start).withColumn("_under", under)
    else:
        # a phrase that many documents hold is split: the item's rows are few, so they are sent to every part
        parts = F.array(*[F.lit(i) for i in range(SPLIT)])
        own = materialised(own.withColumn("_row", F.monotonically_increasing_id()))
        narrow = seeds(own, "_w", masks).select("_row", "_seed", "_at", F.pmod(F.xxhash64("_row"), F.lit(SPLIT)).cast("int").alias("_part"))
        places = run.select("_no", "_q", "_size", "_seed", F.explode(parts).alias("_part"))
        found = narrow.join(places, ["_seed", "_part"]).select("_row", "_part", "_no", "_q", "_size", start.alias("_start")).distinct()
        by_row = found.groupBy("_row").agg(F.collect_list(F.struct("_part", "_no", "_q", "_size", "_start")).alias("_hits"))
        hits = own.join(by_row, "_row").select("_key", "_w", F.inline("_hits")).select("_key", "_part", "_no", "_q", "_start", under)
        hits = hits.join(items.withColumn("_part", F.explode(parts)), ["_no", "_part"])
    hits = hits.select("_key", "_item", "_iw", "_q", "_start", "_under", F.size("_iw").alias("_size"), F.least("_start", F.lit(0)).alias("_shift"))
    size = F.col("_size")
    width = F.least(size, F.lit(stretch))
    first = F.greatest(F.lit(0), F.least(F.col("_q") - (stretch - longest) // 2, size - width))
    near = equal_words(F.col("_iw"), F.col("_under"), first, F.col("_shift"), width)
    every = equal_words(F.col("_iw"), F.col("_under"), F.lit(0), F.col("_shift"), size)
    good = F.when(near >= F.ceil(width * share), F.array(F.struct(every.alias("_equal"))))
    scored = hits.select("_key", "_item", "_start", "_size", F.inline(good))
    best = scored.groupBy("_key", "_item").agg(F.max("_size").alias("item_words"), F.max(F.struct("_equal", (-F.col("_start")).alias("_back"))).alias("_best"))
    return best.select(F.col("_key").alias(key), F.col("_item").alias(item), F.col("item_words").cast("long").alias("item_words"), F.col("_best._equal").cast("long").alias("equal_words"), (-F.col("_best._back")).cast("long").alias("start_word"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the rows whose key holds a passage of the benchmark;
    options as for contaminated()."""
    found = materialised(contaminated(docs, benchmark, key, **options).select(F.col(key).alias("__gone")).distinct())
    few = found.count() <= BROADCAST_ROWS
    return docs.join(F.broadcast(found) if few else found, docs[key].eqNullSafe(found["__gone"]), "left_anti")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents that hold a passage of ``benchmark``, with the item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
