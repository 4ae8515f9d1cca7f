"""Sharding by a permutation-filled lookup table.

Each shard has a preference order over the slots of a prime-sized table, (offset + j * skip) mod size, from two hashes
of its name. Shards take turns claiming the first free slot of their order (a shard of weight w claims w a turn), so
all hold nearly the same number of slots, and few slots change hands when a shard comes or goes. A key's hash names
its slot and the slot its shard. The table has `size` rows whatever the data (SIZE by default, 65,537 at most), which
bounds the broadcast. Filling it is a sequential rule over that many slots and runs on the driver; placement is DataFrame expressions
and a broadcast hash join, without a shuffle of the rows.

Defined results: a null key column counts as a value of its own; repeated rows go to the same shard; an empty table
gives no rows. Columns named slot or shard in the input are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A prime, at least a hundred slots for each of 40 shards.
SIZE = 4099
MAX_SIZE = 65537


def _hash(name: str, salt: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{salt}:{name}".encode()).digest()[:8], "big")


def _prime(n: int) -> bool:
    return n > 1 and all(n % i for i in range(2, int(n**0.5) + 1))


def lookup(shards: dict[str, int], size: int = SIZE) -> list[str]:
    """The shard of each slot. shards: names and their weights."""
    if not _prime(size) or size > MAX_SIZE:
        raise ValueError(f"size must be a prime of at most {MAX_SIZE}")
    if not shards or len(shards) > size or min(shards.values()) < 1:
        raise ValueError("there must be from 1 to size shards, of weights from 1")
    names = sorted(shards)
    start = {n: _hash(n, "offset") % size for n in names}
    skip = {n: _hash(n, "skip") % (size - 1) + 1 for n in names}
    taken: list[str | None] = [None] * size
    filled = 0
    while True:
        for name in names:
            for _ in range(shards[name]):
                slot = start[name]
                while taken[slot] is not None:
                    slot = (slot + skip[name]) % size
                taken[slot] = name
                start[name] = (slot + skip[name]) % size
                filled += 1
                if filled == size:
                    return taken


def placement(spark: SparkSession, shards: dict[str, int], size: int = SIZE) -> DataFrame:
    """(slot, shard): size rows."""
    return spark.createDataFrame(list(enumerate(lookup(shards, size))), "slot int, shard string")


def assign(docs: DataFrame, keys: list[str], shards: dict[str, int], size: int = SIZE) -> DataFrame:
    """docs with slot and shard added."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("slot", "shard")])
    parts = [x for k in keys for x in (F.col(k).isNull(), F.col(k).cast("string"))]
    slot = F.pmod(F.xxhash64(*parts), F.lit(size)).cast("int")
    return docs.withColumn("slot", slot).join(F.broadcast(placement(docs.sparkSession, shards, size)), "slot")
