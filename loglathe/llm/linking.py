"""Linking rows that share keys, without pairs of all rows of a key, and the connected groups of the links."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglathe import session

LEADER_ROUNDS = 2
LAST_LINKS = 1 << 20  # links (of 16 bytes) that one task contracts to the end
BIG_KEY = 128  # rows of a key up to which their pairs are written out


def stored(df: DataFrame, name: str = "step", **options: str) -> DataFrame:
    """Write the rows to the shared folder and read them back: the lineage ends there, whatever executor is lost.

    The driver's garbage is collected around it, so that Spark removes the shuffle files of finished steps: what a write
    has just left may still be held by its last events, and goes before the next one. `options` are those of the writer.
    """
    spark = df.sparkSession
    path = session.run_folder(spark, name)
    spark.sparkContext._jvm.System.gc()
    df.write.options(**options).parquet(path)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for table in tables:
        for path in {file.rpartition("/")[0] for file in table.inputFiles()}:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every id of the links (a, b), and the smallest that it reaches."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at.reshape(2, -1)
    low = np.arange(len(ids))
    while len(i):
        np.minimum.at(low, np.maximum(i, j), np.minimum(i, j))  # from root to smaller root
        while np.any(low[low] != low):
            low = low[low]
        i, j = low[i], low[j]
        apart = i != j
        i, j = i[apart], j[apart]
    return ids, ids[low]


def _rest(edges: DataFrame) -> DataFrame:
    """(id, up): every id of few links and the smallest that it reaches, by one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        parts += [(batch.column("a").to_numpy(), batch.column("b").to_numpy()) for batch in batches]
        ids, up = _smallest(*map(np.concatenate, zip(*parts)))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(up)], names=["id", "up"])

    return edges.repartition(1).mapInArrow(run, "id long, up long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in `links` (a, b): the smallest id that it reaches.

    Each round moves every id to the neighbour of least random rank and contracts the links to what is left of them. With
    random ranks the number of ids falls by a constant factor per round, whatever the shape of the group; an id with very
    many links is aggregated before the shuffle. What is left of whole-number ids is contracted by one task as soon as it is
    no more than LAST_LINKS, which does not grow with the input.
    """
    edges = stored(links.select("a", "b").where("a <> b").distinct(), "edges")
    whole = all(edges.schema[c].dataType == T.LongType() for c in ("a", "b"))
    labels, turn = None, 0
    while True:
        count = edges.count()
        last = whole and count <= LAST_LINKS
        if labels is not None and not count:
            break
        turn += 1

        def rank(c: str):
            return F.struct(F.xxhash64(c, F.lit(turn)).alias("r"), F.col(c).alias("id"))

        if last:
            up = _rest(edges)
        else:
            both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            up = (
                both.groupBy("a")
                .agg(F.min(rank("b")).alias("least"))
                .select(F.col("a").alias("id"), F.least(F.col("least"), rank("a"))["id"].alias("up"))
            )
        if last and labels is None:
            found = stored(up.withColumnRenamed("up", "component"), "components")
            discard(edges)
            return found
        up = stored(up, "up")
        if not last:
            a = up.select(F.col("id").alias("a"), F.col("up").alias("_a"))
            b = up.select(F.col("id").alias("b"), F.col("up").alias("_b"))
            contracted = stored(
                edges.join(a, "a").join(b, "b").where("_a <> _b").select(
                    F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")
                ).distinct(),
                "edges",
            )
        if labels is None:  # in the first round every id is its own root
            moved = up.withColumnRenamed("up", "root")
            discard(edges)
        else:
            to = up.select(F.col("id").alias("root"), "up")
            moved = stored(
                labels.join(to, "root", "left").select("id", F.coalesce("up", "root").alias("root")), "labels"
            )
            discard(edges, up, labels)
        labels = moved
        if last:
            break
        edges = contracted
    least = labels.groupBy("root").agg(F.min("id").alias("component"))
    found = stored(labels.join(least, "root").select("id", "component"), "components")
    discard(labels, *([] if last else [edges]))
    return found


Refine = Callable[[DataFrame], DataFrame]
Verify = Callable[[DataFrame], DataFrame]


def link_groups(
    keys: DataFrame, refine: Refine, verify: Verify, families: Verify | None = None, rounds: int = LEADER_ROUNDS
) -> DataFrame:
    """Links (a, b) whose groups are those of all links between rows that share a key.

    `keys` has key, id and info (a struct). `refine` takes pairs (a, x, b, y), one per shared key, with the infos of both
    sides, and returns (a, b, score) of those that may link; `verify` gets pairs (deal, a, b) and returns those pairs (a, b)
    that do. Pairs with one `deal` share many of their rows, and all b of one deal are few beside its a.

    In the first rounds every row is compared only with one leader of its keys, so that a key with very many rows costs
    one comparison per row. At the end, pairs of rows of one key that are still in different groups are all compared: of
    each key only the rows outside its largest group, with all others. No pair that could join two groups is left out.

    With `families`, keys of more than BIG_KEY rows make no pairs: the rows that such keys connect are one family, and
    `families` gets (id, family) and returns all links inside each.
    """
    links = None
    marked = keys.withColumn("group", F.col("id"))
    for turn in range(rounds):
        top = (
            marked.groupBy("key")
            .agg(
                F.min(F.struct(F.xxhash64("id", F.lit(turn)).alias("r"), "id", "info", "group")).alias("top"),
                F.min("group").alias("_low"),
                F.max("group").alias("_high"),
            )
            .where("_low < _high")
        )
        pairs = (
            marked.join(top, "key")
            .where("group <> top.group")
            .select(F.col("id").alias("a"), F.col("info").alias("x"), F.col("top.id").alias("b"), F.col("top.info").alias("y"))
        )
        best = refine(pairs).groupBy("a").agg(F.max(F.struct("score", "b")).alias("best"))
        pairs = stored(best.select(F.col("best.b").alias("deal"), "a", F.col("best.b").alias("b")), "pairs")
        found = verify(pairs)
        extended = stored(found if links is None else links.union(found), "links")
        group = components(extended).withColumnRenamed("component", "group")
        again = keys.join(group, "id", "left").withColumn("group", F.coalesce("group", "id"))
        again = stored(again.select("key", "id", "info", "group"), "marked")
        discard(pairs, found, *([links, marked, groups] if turn else []))
        links, marked, groups = extended, again, group
    counts = marked.groupBy("key", "group").agg(F.count("*").alias("n"))
    largest = (
        counts.groupBy("key")
        .agg(F.max(F.struct("n", "group")).alias("most"), F.count("*").alias("groups"), F.sum("n").alias("rows"))
        .where("groups > 1")
        .select("key", F.col("most.group").alias("main"), "rows")
    )
    if families is not None:
        largest = stored(largest, "mixed")
        big = marked.join(largest.where(F.col("rows") > BIG_KEY), "key")
        hubs = big.groupBy("key").agg(F.min("id").alias("b"))
        family = components(big.join(hubs, "key").select(F.col("id").alias("a"), "b"))
        inside = families(family.select("id", F.col("component").alias("family")))
        links = stored(links.union(inside), "links")
        largest = largest.where(F.col("rows") <= BIG_KEY)
    rest = marked.join(largest, "key").where("group <> main")
    others = marked.select("key", F.col("id").alias("b"), F.col("info").alias("y"), F.col("group").alias("other"))
    pairs = (
        rest.join(others, "key")
        .where("group <> other and (other = main or id < b)")
        .select(F.col("id").alias("a"), F.col("info").alias("x"), "b", "y")
    )
    swap = F.col("a") > F.col("b")
    pairs = pairs.select(
        F.least("a", "b").alias("a"),
        F.when(swap, F.col("y")).otherwise(F.col("x")).alias("x"),
        F.greatest("a", "b").alias("b"),
        F.when(swap, F.col("x")).otherwise(F.col("y")).alias("y"),
    )
    # the side of the larger group are the candidates, and all who look into this group share them
    sizes = groups.groupBy("group").agg(F.count("*").alias("size"))
    sized = groups.join(sizes, "group")
    sides = refine(pairs).select("a", "b")
    for c in ("a", "b"):
        side = sized.select(F.col("id").alias(c), F.struct("size", "group").alias(f"_{c}"))
        sides = sides.join(side, c, "left").withColumn(f"_{c}", F.coalesce(f"_{c}", F.struct(F.lit(1).cast("long").alias("size"), F.col(c).alias("group"))))
    swap = F.col("_a") < F.col("_b")
    dealt = sides.select(
        F.greatest("_a", "_b")["group"].alias("deal"),
        F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"),
        F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"),
    )
    found = verify(stored(dealt, "pairs"))
    everything = stored(links.union(found), "links")
    discard(links, found, marked, groups)
    return everything
