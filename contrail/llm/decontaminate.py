"""Benchmark decontamination by spaced seeds.

A seed is a fixed mask over neighbouring words: positions marked 1 must agree, positions marked 0 are ignored, so a
substituted word inside a seed does not hide the passage. The seeds of the benchmark items and of every position of
every document are hashed and joined; each hit fixes an alignment (the document position at which the item would
start), and the alignment is verified word by word: the densest window of words around the hit must agree in most places.
Only DataFrame functions are used.

Words are runs of characters other than [\x20\x09-\x0D], lower-cased. An item is found if some window of WINDOW words of
it, or the whole item if that is shorter, agrees in SHARE of its places. That is word for word up to four words. The seeds
lose none of these: every way to put the allowed substitutions into a window leaves a seed intact (a test tries them all).
All items that have words are looked for; least_words leaves out those with fewer. Items with equal words are looked for once.

Defined cases: null or empty texts and items have no words and no hits. Rows that repeat a doc_id are reported as one
document, found if any of them is; decontaminate judges each row by itself, also rows without a doc_id. Items that share an
item_id are one item to the report. Of equal alignments the first is given. Very long texts are read whole. Other columns,
whatever their names, are ignored, and stay as they are in decontaminate. Empty tables give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm._spark import documents, packed, settle

#: Each starts with two checked words, which serve as a first filter. The first two are for items of WINDOW words or more,
#: the others for shorter ones, which take disjoint places, one for each substitution allowed and one more: of three words,
#: or of two where there is no room for that.
MASKS, SHORT_MASK, PAIR_MASK = ("1101101", "11001011"), "111", "11"
#: An alignment counts if a window of at least WINDOW words (the whole item if that is shorter) agrees in SHARE of its places.
WINDOW, SHARE = 13, 0.8
#: Items of fewer words are not looked for.
LEAST_ITEM_WORDS = 1
#: Seeds of so many rows (three longs each), and items of so many words in all, are broadcast to the documents; larger
#: tables are joined by a shuffle.
BROADCAST_SEEDS, BROADCAST_WORDS = 2_000_000, 4_000_000


def needed(width: int, window: int = WINDOW, share: float = SHARE) -> int:
    """Places that must agree in a window of that many words."""
    return -int(-round(width * share * 1000) // 1000)


def seed_of(width: int, window: int = WINDOW, share: float = SHARE) -> str:
    """The mask of items of that many words, fewer than window; empty where substitutions leave no two words together."""
    blocks = width - needed(width, window, share) + 1
    return next((m for m in (SHORT_MASK, PAIR_MASK) if blocks * len(m) <= width), "")


def _words(text: str) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _hashed(text: str) -> Column:
    return F.transform(_words(text), lambda w: F.xxhash64(w))


def _seed(words: Column, at: Column, mask: int, bits: str) -> Column:
    """Hash of the checked words of a mask laid at a word position, null where it overruns the end."""
    care = [F.get(words, at + j) for j, c in enumerate(bits) if c == "1"]
    return F.when(at + len(bits) <= F.size(words), F.xxhash64(F.lit(mask), *care))


def _with_pairs(df: DataFrame, words: str) -> DataFrame:
    """One row per word position (at) with the hash of the two words that start there (pair)."""
    rest = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, 1, rest), F.slice(words, 2, rest), lambda a, b: F.xxhash64(a, b))
    # The outer form keeps Spark from computing the array a second time to filter empty ones; null pairs never join.
    return df.withColumn("pairs", pairs).select(*df.columns, F.posexplode_outer("pairs").alias("at", "pair"))


def _with_seeds(df: DataFrame, words: str, masks: tuple[str, ...], taken=None) -> DataFrame:
    """One row per seed; taken(mask, at) tells which places of a mask are used."""
    made = [_seed(F.col(words), F.col("at"), m, bits) for m, bits in enumerate(masks)]
    made = F.array(*[F.when(taken(bits, F.col("at")), x) if taken else x for bits, x in zip(masks, made, strict=True)])
    return df.withColumn("seeds", made).select(*df.columns, F.explode_outer("seeds").alias("seed")).filter(F.col("seed").isNotNull())


def seed_places(window: int = WINDOW, share: float = SHARE):
    """taken(mask, at) for items: the long masks everywhere in long items, short ones at disjoint places of short items."""
    n = F.size("item")
    blocks = F.create_map(*[F.lit(x) for w in range(1, window) for x in (w, w - needed(w, window, share) + 1)])

    def taken(bits: str, at: Column) -> Column:
        if bits not in (SHORT_MASK, PAIR_MASK):
            return n >= window
        own = [w for w in range(1, window) if seed_of(w, window, share) == bits]
        return n.isin(own) & (at % len(bits) == 0) & (at < len(bits) * F.element_at(blocks, n))

    return taken


def _verified(words: Column, item: Column, shift: Column, window: int) -> tuple[Column, Column]:
    """(matches, length) of the best window of an alignment: item[t] against words[shift + t]."""
    same = F.transform(item, lambda w, t: F.when((shift + t >= 0) & (F.get(words, shift + t) == w), 1).otherwise(0))
    width = F.least(F.size(item), F.lit(window))
    total = F.aggregate(same, F.lit(0), lambda a, x: a + x)
    best = F.array_max(F.transform(F.sequence(F.lit(0), F.size(item) - width), lambda i: F.aggregate(F.slice(same, i + 1, width), F.lit(0), lambda a, x: a + x)))
    return total, best


def _found(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    masks: tuple[str, ...] = MASKS, window: int = WINDOW, share: float = SHARE, least_words: int = LEAST_ITEM_WORDS, broadcast_seeds: int = BROADCAST_SEEDS, broadcast_words: int = BROADCAST_WORDS,
) -> DataFrame:
    """The alignments that count, of each row of docs: doc_id, text_key (a hash of the text, which tells rows of one doc_id
    apart), item_id, shift, matched, best, item_words."""
    named_items = benchmark.select(F.col(item_col).alias("item_id"), _hashed(item_text_col).alias("item")).filter(F.size("item") >= max(1, least_words))
    items = settle(named_items.groupBy("item").agg(F.min("item_id").alias("item_id"), F.collect_set("item_id").alias("item_ids"), F.max(F.col("item_id").isNull()).alias("unnamed")).withColumn("item_key", F.monotonically_increasing_id()))
    # A set has no null; items without an id are one to the report.
    none = F.array(F.lit(None).cast(items.schema["item_id"].dataType))
    ids = F.when(F.col("unnamed"), F.concat("item_ids", none)).otherwise(F.col("item_ids"))
    items = items.select("item_key", "item", ids.alias("item_ids"))
    sizes = items.agg(F.sum(F.size("item").cast("long")), F.min(F.size("item"))).first()
    short = [w for w in range(1, window) if sizes[0] and sizes[1] <= w]
    masks = (*masks, *(m for m in (SHORT_MASK, PAIR_MASK) if any(seed_of(w, window, share) == m for w in short)))
    # Items too short for any mask are found by each of their words.
    brief = [w for w in short if not seed_of(w, window, share)]
    seeds = _with_seeds(_with_pairs(items, "item"), "item", masks, seed_places(window, share)).select("pair", "seed", "item_key", F.col("at").alias("item_at"))
    seeds = settle(seeds)
    d = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_key"), _hashed(text_col).alias("words"))
    shift = (F.col("at") - F.col("item_at")).alias("shift")
    spread = _with_pairs(d, "words")
    own = ("doc_id", "text_key")
    if seeds.count() <= broadcast_seeds:
        # Both joins filter rows in the stage that scans the documents; no text and no position is shuffled.
        near = _with_seeds(spread.join(F.broadcast(seeds.select("pair").distinct()), "pair", "left_semi"), "words", masks)
        hits = near.join(F.broadcast(seeds.drop("pair")), "seed").select(*own, "item_key", "words", shift)
    else:
        thin = _with_seeds(spread, "words", masks).select(*own, "at", "seed").join(seeds.select("seed", "item_key", "item_at"), "seed")
        thin = settle(thin.select(*own, "item_key", shift).distinct())
        named = thin.select(*own).distinct().withColumnsRenamed({c: f"_{c}" for c in own})
        same = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_key") == F.col("_text_key"))
        texts = d.join(named, same, "left_semi").groupBy(*own).agg(F.first("words").alias("words")).withColumnsRenamed({c: f"_{c}" for c in own})
        hits = thin.join(texts, same).select(*own, "item_key", "words", "shift")
    if brief:
        word = d.select(*own, "words", F.posexplode("words").alias("at", "word"))
        least = items.filter(F.size("item").isin(brief)).select("item_key", F.posexplode("item").alias("item_at", "word"))
        hits = hits.unionByName(word.join(least, "word").select(*own, "item_key", "words", shift))
    hits = hits.join(F.broadcast(items) if (sizes[0] or 0) <= broadcast_words else items, "item_key")
    total, best = _verified(F.col("words"), F.col("item"), F.col("shift"), window)
    checked = hits.select(*own, "item_ids", "shift", total.alias("matched"), best.alias("best"), F.size("item").alias("item_words"))
    need = F.element_at(F.array(*[F.lit(needed(w, window, share)) for w in range(1, window + 1)]), F.least(F.col("item_words"), F.lit(window)))
    return checked.filter(F.col("best") >= need).select(*own, F.explode("item_ids").alias("item_id"), "shift", "matched", "best", "item_words")


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, first_word, matched_words, item_words, window_matches) for each document and benchmark item it
    contains; first_word is where the item would start in the document (negative if its head is missing). Of several
    alignments the one with most matches is given, the first on a tie. Options: those of _found, such as masks, window,
    share and least_words."""
    return _found(docs, benchmark, **options).groupBy("doc_id", "item_id").agg(
        F.max_by("shift", F.struct("matched", -F.col("shift"))).alias("first_word"), F.max("matched").alias("matched_words"), F.max("item_words").alias("item_words"), F.max("best").alias("window_matches")
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs that contain no benchmark passage, with all their columns."""
    bad = _found(docs, benchmark, **options).select(F.col("doc_id").alias("_bad"), F.col("text_key").alias("_bad_text")).distinct()
    rows = packed(docs, _id=options.get("id_col", "doc_id"), _text=options.get("text_col", "text"))
    return rows.join(bad, F.col("_id").eqNullSafe(F.col("_bad")) & (F.xxhash64("_text") == F.col("_bad_text")), "left_anti").select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
