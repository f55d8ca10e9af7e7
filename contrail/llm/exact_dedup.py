"""Exact deduplication by deterministic block naming.

A text is cut into fixed-size blocks. Distinct blocks are sorted and numbered, so equal blocks, and only they, share an
integer name; then the names of adjacent pairs are named in the same way, level by level, until one name is left. Two
texts are equal exactly if they end at the same level with the same name: names are never hashes, so nothing can
collide. Only DataFrame functions are used.

Defined cases: a null text counts as empty; empty texts are one group. Rows that repeat a doc_id with an equal text are
members of the group like any other, and one of them stays. A null doc_id sorts after all others. Other columns,
whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contrail.llm._spark import documents, settle

WHITE = r"[\x20\x09-\x0D]+"
#: Characters in a block.
BLOCK = 2048
#: The most frequent values, so many at most, get their names by a broadcast table; their rows would all meet in a task.
HOT_VALUES, HOT_COPIES = 512, 500


def name_values(values: DataFrame, rows: DataFrame, cols: list[str]) -> DataFrame:
    """rows with a long `name`, equal for two rows exactly if they agree in cols (none null). values holds at least the
    values that rows have. Values are counted with map-side combining, sorted and numbered; the names of the most frequent
    ones, a bounded number, are broadcast, so no task gathers the rows of a frequent value."""
    counted = values.groupBy(*cols).agg(F.count(F.lit(1)).alias("copies"))
    # The filter keeps the counts in this branch too, so both branches read one shuffle of the values.
    numbered = counted.filter("copies > 0").sortWithinPartitions(*cols).withColumn("number", F.monotonically_increasing_id())
    hot = counted.filter(F.col("copies") >= HOT_COPIES).orderBy(F.desc("copies"), *cols).limit(HOT_VALUES)
    hot = hot.withColumn("hot_number", F.monotonically_increasing_id()).select(*cols, "hot_number")
    # Two name spaces: even names are of frequent values, odd ones of the rest.
    tagged = rows.join(F.broadcast(hot), cols, "left")
    rest = tagged.filter(F.col("hot_number").isNull()).drop("hot_number").join(numbered.drop("copies"), cols)
    return (
        tagged.filter(F.col("hot_number").isNotNull()).withColumn("name", F.col("hot_number") * 2).drop("hot_number", *cols)
        .unionByName(rest.withColumn("name", F.col("number") * 2 + 1).drop("number", *cols))
    )


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(row_key, doc_id, text_sha256, level, name) for each row of docs; (level, name) is the identity of its text."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE, " ")
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text")).withColumn("n", F.greatest(F.ceil(F.length("text") / block), F.lit(1)).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substr("text", i * block + 1, F.lit(block)))
    values = base.select(F.explode(cut).alias("value"))
    rows = (
        base.select(F.monotonically_increasing_id().alias("row_key"), "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha"), "n", cut.alias("cut"))
        .select("row_key", "doc_id", "sha", "n", F.posexplode("cut").alias("at", "value"))
        .select("row_key", "n", "at", "value", F.when(F.col("at") == 0, F.struct("doc_id", "sha")).alias("head"))
    )
    named = settle(name_values(values, rows, ["value"]))
    heads = named.filter("at = 0").select("row_key", "head.doc_id", F.col("head.sha").alias("text_sha256"))
    ended, live, level = [named.filter("n = 1").select("row_key", F.lit(0).alias("level"), "name")], named.select("row_key", "n", "at", "name"), 0
    most = named.agg(F.max("n")).first()[0] or 1
    while most > 1:
        level, most = level + 1, (most + 1) // 2
        half = F.floor(F.col("at") / 2).cast("int")
        pairs = (
            live.filter("n > 1").groupBy("row_key", half.alias("at"))
            .agg(F.max("n").alias("n"), F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"), F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"))
            .withColumn("n", F.ceil(F.col("n") / 2).cast("int"))
        )
        pairs = settle(pairs)
        live = settle(name_values(pairs.select("left", "right"), pairs, ["left", "right"]))
        ended.append(live.filter("n = 1").select("row_key", F.lit(level).alias("level"), "name"))
    return heads.join(reduce(DataFrame.unionByName, ended), "row_key")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, keep_id (smallest doc_id with an equal text), group_size, kept, text_sha256."""
    found = settle(identities(docs, id_col, text_col, block))
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    groups = found.groupBy("level", "name").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))
    return found.join(groups, ["level", "name"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row_key") == F.col("first.row_key")).alias("kept"), "text_sha256"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g USING (t)
"""
