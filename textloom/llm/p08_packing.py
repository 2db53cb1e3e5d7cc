"""Filling fixed-capacity containers with documents.

Sizes are tokens of a public tokenizer. A document that alone exceeds the capacity gives
full containers and a rest; every other document stays whole. Items are spread by hash over
shards of about ``SHARD_CONTAINERS`` containers' worth of tokens, and each shard is packed
by itself with best-two-fit: a container is filled greedily with the largest items that
fit, then its smallest item gives way to two unpacked items if those fill the gap more
tightly. What each shard leaves badly filled (under ``GOOD`` of the capacity) is taken
apart and packed once more across shards. A shard's size is bounded by its share of tokens,
whatever the number of documents.

Defined results: NULL and empty texts have size 0 and get a place in some container; a
document id delivered twice is packed once, with its larger size.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.p01_token_budget import TOKENIZER, encoder
from textloom.session import cut

CAPACITY = 2048
SHARD_CONTAINERS = 1500
GOOD = 0.985


def best_two_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Positions of ``sizes`` (none over the capacity) by container."""
    stock: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        stock.setdefault(s, []).append(i)
    order = sorted(stock)  # the sizes still in stock

    def take(size: int) -> int:
        items = stock[size]
        i = items.pop()
        if not items:
            del stock[size]
            order.pop(bisect_right(order, size) - 1)
        return i

    def put(size: int, i: int) -> None:
        if size not in stock:
            stock[size] = []
            order.insert(bisect_right(order, size), size)
        stock[size].append(i)

    out = []
    while order:
        room, held = capacity, []
        while order and order[0] <= room:
            size = order[bisect_right(order, room) - 1]
            held.append((size, take(size)))
            room -= size
        if room and len(held) > 1 and order:
            small, spare = held[-1]
            gap = room + small
            best, pair = small, None
            hi = bisect_right(order, gap) - 1
            for k in range(hi, -1, -1):
                a = order[k]
                if 2 * a < best:
                    break
                j = bisect_right(order, min(a, gap - a)) - 1
                if j < 0:
                    continue
                b = order[j]
                if b == a and len(stock[a]) < 2:
                    j -= 1
                    if j < 0:
                        continue
                    b = order[j]
                if a + b > best:
                    best, pair = a + b, (a, b)
                    if best == gap:
                        break
            if pair:
                held[-1:] = [(s, take(s)) for s in pair]
                put(small, spare)
        out.append([i for _, i in held])
    return out


def _sizes(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "tokens"])

    return run


def document_sizes(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, tokens) of every document."""
    return documents.filter("doc_id is not null").select("doc_id", "text").mapInArrow(_sizes(tokenizer), "doc_id long, tokens long").groupBy("doc_id").agg(F.max("tokens").alias("tokens"))


PACKED = "doc_id long, piece int, tokens long, shard int, container int, used long"


def _pack(capacity: int):
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("doc_id", "ascending"), ("piece", "ascending")])
        sizes = part.column("tokens").to_pylist()
        number, used = [0] * len(sizes), [0] * len(sizes)
        for k, held in enumerate(best_two_fit(sizes, capacity)):
            total = sum(sizes[i] for i in held)
            for i in held:
                number[i], used[i] = k, total
        return part.select(["doc_id", "piece", "tokens", "shard"]).append_column("container", pa.array(number, pa.int32())).append_column("used", pa.array(used, pa.int64()))

    return run


def _shards(items: DataFrame, capacity: int, seed: int) -> DataFrame:
    total = items.agg(F.coalesce(F.sum(F.greatest("tokens", F.lit(1))), F.lit(0)).alias("s")).first().s
    n = max(1, -(-total // (capacity * SHARD_CONTAINERS)))
    return items.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "piece"), F.lit(n)).cast("int"))


def packed(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, piece, tokens, container_id): every document whole, or its pieces of at most ``capacity`` tokens.

    Piece k of a document is its tokens from k * capacity on.
    """
    sizes = document_sizes(documents, tokenizer)
    count = F.greatest(F.lit(1), F.ceil(F.col("tokens") / capacity)).cast("int")
    items = cut(
        sizes.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0), count - 1)).alias("piece")).select("doc_id", "piece", F.least(F.lit(capacity), F.col("tokens") - F.col("piece") * F.lit(capacity)).cast("long").alias("tokens"))
    )
    first = cut(_shards(items, capacity, 1).groupBy("shard").applyInArrow(_pack(capacity), PACKED))
    good = first.filter(F.col("used") >= GOOD * capacity)
    rest = first.filter(F.col("used") < GOOD * capacity).select("doc_id", "piece", "tokens")
    again = _shards(rest, capacity, 2).groupBy("shard").applyInArrow(_pack(capacity), PACKED)
    named = lambda df, turn: df.select("doc_id", "piece", "tokens", ((F.col("shard").cast("long") * 2 + turn) * 4_000_000 + F.col("container")).alias("container_id"))
    return named(good, 0).unionByName(named(again, 1))


def containers(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str = TOKENIZER) -> DataFrame:
    """(container_id, items, used, free) of every container."""
    return packed(documents, capacity, tokenizer).groupBy("container_id").agg(F.count("*").alias("items"), F.sum("tokens").alias("used")).withColumn("free", F.lit(capacity) - F.col("used"))
