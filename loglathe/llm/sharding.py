"""Sharding by a permutation-filled lookup table.

The table has a prime number of slots. Each shard has its own order of preference over all slots (a start and a step, both
from a hash of its name), and the shards take turns: the next shard claims the first slot of its order that is still free,
until the table is full. So slots are shared evenly, and when a shard is added or lost few other slots change hands. A row
is placed by one hash of its key and one look into the table, which is broadcast: it has `slots` rows, a parameter with a
checked bound.

Only DataFrame functions touch the rows; the fill is a loop over the bounded table.

Cases: a null key is placed like the empty text. Rows with equal keys go to one shard; with `spread` > 1 a key's rows go to
up to so many shards (by a second column), so that a key with a third of all rows does not fill one shard. Extra columns
pass unchanged; one named like an output is replaced. Shard names must be distinct. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 65_537  # prime
MAX_SLOTS = 1_000_003  # bound of the broadcast table: 16 bytes a row


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def preference(name: str, slots: int) -> tuple[int, int]:
    """Start and step of a shard's order; with a prime number of slots every step visits all of them."""
    digest = hashlib.md5(name.encode()).hexdigest()
    return int(digest[:15], 16) % slots, int(digest[15:30], 16) % (slots - 1) + 1


def lookup_table(shards: Sequence[str], slots: int = SLOTS) -> list[int]:
    """Number of the shard that holds each slot."""
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shard names must be distinct, and there must be one")
    if not _is_prime(slots) or not len(shards) < slots <= MAX_SLOTS:
        raise ValueError(f"slots must be a prime above the number of shards, at most {MAX_SLOTS}")
    orders = [preference(name, slots) for name in shards]
    tried = [0] * len(shards)
    table = [-1] * slots
    free = slots
    while free:
        for shard, (start, step) in enumerate(orders):
            slot = (start + tried[shard] * step) % slots
            while table[slot] >= 0:
                tried[shard] += 1
                slot = (start + tried[shard] * step) % slots
            table[slot] = shard
            tried[shard] += 1
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key: the first 60 bits of its MD5 modulo the number of slots."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(slots)).cast("int")


def table_frame(spark, shards: Sequence[str], slots: int = SLOTS) -> DataFrame:
    """The table as rows (slot, shard), without rows of Python: a list of numbers that Spark takes apart itself."""
    numbers = ",".join(map(str, lookup_table(shards, slots)))
    names = F.array(*[F.lit(s) for s in shards])
    return (
        spark.range(1)
        .select(F.posexplode(F.split(F.lit(numbers), ",")).alias("slot", "_n"))
        .select("slot", F.element_at(names, F.col("_n").cast("int") + 1).alias("shard"))
    )


def place(
    docs: DataFrame,
    shards: Sequence[str],
    key: str = "doc_id",
    slots: int = SLOTS,
    spread: int = 1,
    spread_by: str | None = None,
) -> DataFrame:
    """The rows with the `slot` and `shard` of their key."""
    kept = docs.drop("slot", "shard")
    text = F.coalesce(kept[key].cast("string"), F.lit(""))
    if spread > 1:
        part = F.pmod(F.xxhash64(kept[spread_by or key]), F.lit(spread))
        text = F.when(part > 0, F.concat_ws("#", text, part.cast("string"))).otherwise(text)
    placed = kept.withColumn("slot", slot_of(text, slots))
    return placed.join(F.broadcast(table_frame(docs.sparkSession, shards, slots)), "slot").select(
        *kept.columns, "slot", "shard"
    )
