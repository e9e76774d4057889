"""Shard placement through a permutation-filled lookup table of prime size.

Each shard has a preference order over the table's slots, offset + j * skip modulo the prime. Shards take turns
claiming their next free slot until the table is full, so that slot counts differ by one at most, and adding or removing a
shard moves few slots. A document's slot is the hash of its doc_id modulo the prime; the table is broadcast
(its size is the prime, a parameter with a checked bound) and placing a row is one probe. Only doc_id is read.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Prime, about a thousand times the number of shards.
TABLE_SIZE = 65537
SHARDS = 64
#: The lookup table is broadcast; no larger table is accepted.
MOST_SLOTS = 5_000_011


def _number(text: str) -> int:
    return int.from_bytes(hashlib.md5(text.encode()).digest()[:8], "big")


def fill_table(names: list[str], size: int = TABLE_SIZE) -> list[int]:
    """Slot -> index of its shard in names."""
    if not names or len(set(names)) != len(names):
        raise ValueError("shards need distinct names, one at least")
    if size < len(names) or size > MOST_SLOTS or any(size % p == 0 for p in range(2, int(size**0.5) + 1)):
        raise ValueError(f"size must be a prime from the number of shards to {MOST_SLOTS}")
    at = [_number(f"offset:{x}") % size for x in names]
    skip = [_number(f"skip:{x}") % (size - 1) + 1 if size > 2 else 1 for x in names]
    table = [-1] * size
    left = size
    while left:
        for i in range(len(names)):
            while table[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            table[at[i]] = i
            left -= 1
            if not left:
                break
    return table


def place(docs: DataFrame, names: list[str] | None = None, size: int = TABLE_SIZE) -> DataFrame:
    """documents -> their columns, slot int and shard string; one row for each row given.

    A null doc_id hashes as an empty string. Repeated rows go to one shard. A column named slot or shard is what an earlier placement left and is
    replaced; all others are kept. Texts are not read, whatever their length; an empty table gives an empty result.
    """
    names = names or [f"shard-{i:03d}" for i in range(SHARDS)]
    spark = docs.sparkSession
    lookup = spark.createDataFrame([(s, names[i]) for s, i in enumerate(fill_table(names, size))], "slot int, shard string")
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    slot = (F.conv(F.substring(key, 1, 12), 16, 10).cast("long") % size).cast("int")
    return docs.drop("slot", "shard").withColumn("slot", slot).join(F.broadcast(lookup), "slot").select(*[c for c in docs.columns if c not in ("slot", "shard")], "slot", "shard")
