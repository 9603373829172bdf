"""Filling fixed-capacity containers with texts.

Sizes are tokens of a public tokenizer. Items are spread over shards by a hash, and each shard is packed on its own: a
shard holds thousands of containers, so its few last ones cost next to no room, and only ids and sizes are shuffled.

Within a shard (large-item matching): an item above the capacity is cut into full pieces and a rest. Of items above a
third of the capacity at most two fit in a container; from the largest down, each is matched with the largest other
large item that still fits. Smaller items follow from the largest down, each into the fullest container that has room.
Both steps work on counts by size, so a shard takes time in proportion to its items.

Defined results: null texts are no items, empty texts are items of size 0 and take no room, ties go by id, repeated rows
are one item; no item is left out.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of the rank files.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def encoder(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: str, vocabulary: str = VOCABULARY) -> Column:
    """A column with the number of tokens of the column ``text``."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary).encode_ordinary
        for texts in batches:
            yield pd.Series([None if t is None else len(encode(t)) for t in texts], dtype="Int64")

    return count(F.col(text))


class Gaps:
    """Open containers by the room left in them."""

    def __init__(self):
        self.by_room: dict[int, list[int]] = {}
        self.rooms: list[int] = []

    def add(self, room: int, bin_no: int) -> None:
        if room not in self.by_room:
            self.by_room[room] = []
            insort(self.rooms, room)
        self.by_room[room].append(bin_no)

    def take(self, size: int) -> tuple[int, int] | None:
        """(room, container) of the fullest container with room for ``size``."""
        i = bisect_left(self.rooms, size)
        if i == len(self.rooms):
            return None
        room = self.rooms[i]
        bin_no = self.by_room[room].pop()
        if not self.by_room[room]:
            del self.by_room[room], self.rooms[i]
        return room, bin_no


def pack(sizes: list[int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """(item, part, first token, tokens, container) for items of the given sizes."""
    out: list[tuple[int, int, int, int, int]] = []
    gaps = Gaps()
    bins = 0
    rests = []
    for k, size in enumerate(sizes):
        part = 0
        while size - part * capacity > capacity:
            out.append((k, part, part * capacity, capacity, bins))
            bins += 1
            part += 1
        rests.append((size - part * capacity, k, part))
    large: dict[int, list[tuple[int, int]]] = {}
    small = []
    for size, k, part in rests:
        if 3 * size > capacity:
            large.setdefault(size, []).append((k, part))
        else:
            small.append((size, k, part))
    for same in large.values():
        same.reverse()
    order = sorted(large)

    def pop(i: int) -> tuple[int, int, int]:
        size = order[i]
        k, part = large[size].pop()
        if not large[size]:
            del order[i]
        return size, k, part

    while order:
        size, k, part = pop(len(order) - 1)
        out.append((k, part, part * capacity, size, bins))
        room = capacity - size
        mate = bisect_right(order, room) - 1
        if mate >= 0:
            size, k, part = pop(mate)
            out.append((k, part, part * capacity, size, bins))
            room -= size
        gaps.add(room, bins)
        bins += 1
    for size, k, part in sorted(small, key=lambda x: (-x[0], x[1])):
        room, bin_no = gaps.take(size) or (capacity, bins)
        bins += bin_no == bins
        out.append((k, part, part * capacity, size, bin_no))
        gaps.add(room - size, bin_no)
    return out


def pack_items(df: DataFrame, item_id: str, text: str, capacity: int = 2048, vocabulary: str = VOCABULARY, shard_items: int = 20_000) -> DataFrame:
    """(item_id, part_no, token_start, n_tokens, shard, bin_no): the container of every item or part of an oversized one."""
    shards = max(1, -(-df.count() // shard_items))
    kind = df.schema[item_id].dataType.simpleString()
    sizes = df.where(F.col(text).isNotNull()).select(F.col(item_id).alias("item"), token_count(text, vocabulary).alias("size"))
    sizes = sizes.distinct().withColumn("shard", F.pmod(F.xxhash64("item", F.lit(11)), F.lit(shards)).cast("int"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["item", "size"], kind="stable")
        ids, shard = pdf["item"].tolist(), int(pdf["shard"].iloc[0])
        rows = [(ids[k], part, at, n, shard, b) for k, part, at, n, b in pack(pdf["size"].tolist(), capacity)]
        return pd.DataFrame(rows, columns=["item_id", "part_no", "token_start", "n_tokens", "shard", "bin_no"])

    return sizes.groupBy("shard").applyInPandas(fill, f"item_id {kind}, part_no int, token_start long, n_tokens long, shard int, bin_no long")


def fill_rates(bins: DataFrame, capacity: int = 2048) -> DataFrame:
    """Containers, tokens and the used share of the room in each shard."""
    each = bins.groupBy("shard", "bin_no").agg(F.sum("n_tokens").alias("used"))
    return each.groupBy("shard").agg(
        F.count("*").alias("n_bins"),
        F.sum("used").alias("n_tokens"),
        F.max("used").alias("fullest"),
        F.round(F.sum("used") / (F.count("*") * capacity), 6).alias("fill"),
    )
