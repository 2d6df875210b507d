"""Problem 6: filling fixed-capacity containers with items (vector bin packing by dot products).

An item has three sizes: tokens, segments (one) and loss-bearing tokens. A container has a limit for each. A container
is filled by taking, again and again, the item that fits and whose sizes have the largest weighted dot product with
the room that is left; so what is scarce in a container is matched with items that need it least. Items are dealt at
random to shards of bounded size, which are packed independently.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.schemas import extended
from ledgerloom.llm.splitting import full_cuts
from ledgerloom.llm.tokens import places, token_count, token_ids, vocabulary_path
from ledgerloom.session import staged

#: Tokens and items dealt to a shard on average, at most; a shard leaves one container or two half empty.
SHARD_TOKENS, SHARD_ITEMS = 1 << 23, 1 << 18


@dataclass(frozen=True)
class Limit:
    """A kind of container: its capacity in tokens, segments and loss-bearing tokens."""

    limit_id: int
    max_tokens: int
    max_segments: int
    max_loss: int

    @classmethod
    def of(cls, limit_id: int, max_tokens: int, max_segments: int | None = None, max_loss: int | None = None) -> Limit:
        """Without further limits: a segment for each 8 tokens, and every token may bear loss."""
        return cls(limit_id, max_tokens, max_segments or max(1, max_tokens // 8), max_loss if max_loss is not None else max_tokens)


def pack(tokens: np.ndarray, loss: np.ndarray, limit: Limit) -> tuple[np.ndarray, np.ndarray]:
    """The container and the slot of each item.

    Items of equal sizes are one class, so the work for a choice grows with the distinct sizes, which the capacity
    bounds, not with the items. Of equal products the class with more tokens wins. An item that fits into no empty
    container raises an error; it has to be split first.
    """
    if len(tokens) and (tokens.max() > limit.max_tokens or loss.max() > limit.max_loss or limit.max_segments < 1):
        raise ValueError("an item exceeds a whole container")
    container, slot = np.full(len(tokens), -1, dtype=np.int64), np.zeros(len(tokens), dtype=np.int32)
    order = np.lexsort((loss, tokens))
    pairs = np.stack([tokens[order], loss[order]], axis=1)
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = np.any(pairs[1:] != pairs[:-1], axis=1)
    begin = np.flatnonzero(fresh)
    left = np.diff(np.append(begin, len(order)))
    size, bears = pairs[begin, 0], pairs[begin, 1]
    next_item = begin.copy()
    caps = np.array([limit.max_tokens, limit.max_loss, limit.max_segments], dtype=float)
    weight = np.array([tokens.sum(), loss.sum(), len(tokens)]) / np.maximum(caps, 1)
    weight = weight / max(weight.sum(), 1e-12)
    by_tokens, by_loss = weight[0] * size / caps[0], weight[1] * bears / max(caps[1], 1)
    number = -1
    placed = 0
    while placed < len(order):
        number += 1
        room, room_loss, room_segments = limit.max_tokens, limit.max_loss, limit.max_segments
        at = 0
        while room_segments:
            high = np.searchsorted(size, room, side="right")
            if not high:
                break
            product = by_tokens[:high] * (room / caps[0]) + by_loss[:high] * (room_loss / max(caps[1], 1))
            product = np.where(bears[:high] <= room_loss, product, -1.0)
            best = high - 1 - int(np.argmax(product[::-1]))
            if product[best] < 0:
                break
            item = order[next_item[best]]
            container[item], slot[item] = number, at
            room, room_loss, room_segments, at = room - int(size[best]), room_loss - int(bears[best]), room_segments - 1, at + 1
            placed += 1
            next_item[best] += 1
            left[best] -= 1
            if not left[best]:
                keep = np.arange(len(left)) != best
                left, size, bears, next_item, by_tokens, by_loss = (x[keep] for x in (left, size, bears, next_item, by_tokens, by_loss))
    return container, slot


def prompt_tokens(text: str, path: str) -> int:
    """Tokens of the heading line, which bear no loss; a text of one line has no heading."""
    end = text.find("\n")
    return token_count(text[:end], path) if end > 0 else 0


def text_items(df: DataFrame, key: str, text: str, limits: list[Limit], path: str | None = None) -> DataFrame:
    """Items ``limit_id, key, piece_no, char_start, char_end, tokens, loss_tokens`` of the texts for each limit.

    A text is one item unless it alone exceeds a container (in tokens or loss-bearing tokens); then it is cut at
    natural boundaries into parts that nearly fill a container, without overlap. Null and empty texts are no items. Each text is tokenized once.
    """
    path = path or vocabulary_path()
    names = ["limit_id", "piece_no", "char_start", "char_end", "tokens", "loss_tokens"]
    schema = extended(df.select(key).schema, ", ".join(f"{name} int" for name in names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, cells = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if not t:
                    continue
                ids = token_ids(t, path)
                n, at = len(ids), None
                head = min(n, prompt_tokens(t, path))
                for limit in limits:
                    most = min(limit.max_tokens, limit.max_loss)
                    if n <= limit.max_tokens and n - head <= limit.max_loss:
                        rows.append(i)
                        cells.append((limit.limit_id, 0, 0, len(t), n, n - head))
                        continue
                    at = at or places(t, path, ids)
                    first = 0
                    for no, end in enumerate([*full_cuts(at, most), n]):
                        rows.append(i)
                        cells.append((limit.limit_id, no, int(at.char[first]), int(at.char[end]), end - first, end - max(first, min(head, end))))
                        first = end
            columns = np.array(cells, dtype=np.int32).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), *[pa.array(columns[:, j]) for j in range(len(names))]], [key, *names])

    return df.select(key, df[text].alias("__text")).mapInArrow(run, schema)


def packed(items: DataFrame, key: str, limits: list[Limit], shard_tokens: int = SHARD_TOKENS, seed: int = 11) -> DataFrame:
    """The items with ``container_id`` and ``slot``; containers are numbered within a limit.

    Shards are made by a hash of the item, so one source or key with most rows spreads evenly; their number follows
    the tokens and the items, so a shard stays bounded. An empty table gives no container. Repeated rows are placed each.
    """
    items = staged(items, "items")
    totals = items.groupBy("limit_id").agg(F.sum("tokens").alias("t"), F.count(F.lit(1)).alias("n")).collect()
    shards = {r["limit_id"]: max(1, -(-r["t"] // shard_tokens), -(-r["n"] // SHARD_ITEMS)) for r in totals}
    by_id = {x.limit_id: x for x in limits}
    count = F.lit(1)
    for k, n in shards.items():
        count = F.when(F.col("limit_id") == k, F.lit(n)).otherwise(count)
    dealt = items.withColumn("shard", F.pmod(F.xxhash64(F.col(key).cast("string"), "piece_no", F.lit(seed)), count).cast("int"))
    names = [key, "piece_no", "char_start", "char_end", "tokens", "loss_tokens"]
    schema = extended(items.select("limit_id", *names).schema, "container_id bigint, slot int")

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values([key, "piece_no"], kind="stable", ignore_index=True)
        limit = by_id[int(group["limit_id"].iloc[0])]
        where, slot = pack(group["tokens"].to_numpy(), group["loss_tokens"].to_numpy(), limit)
        return group.assign(container_id=(int(group["shard"].iloc[0]) << 32) + where, slot=slot)[[f.name for f in schema]]

    return dealt.groupBy("limit_id", "shard").applyInPandas(run, schema)


def with_text(contents: DataFrame, df: DataFrame, key: str, text: str) -> DataFrame:
    """Contents with the column ``text``: the part of the text that lies in the slot.

    Texts travel once for this join, not through the packing. Keys must be unique in ``df``, a key it lacks gives null.
    """
    texts = df.select(F.col(key), F.col(text).alias("__text"))
    part = F.substring(F.col("__text"), F.col("char_start") + 1, F.col("char_end") - F.col("char_start"))
    return contents.join(texts, key, "left").withColumn("text", part).drop("__text")


def fill_report(contents: DataFrame, limits: list[Limit]) -> DataFrame:
    """For each limit: containers, items, tokens, the share of the room that is used, and the most in one container."""
    size = F.lit(None)
    for x in limits:
        size = F.when(F.col("limit_id") == x.limit_id, F.lit(x.max_tokens)).otherwise(size)
    each = contents.groupBy("limit_id", "container_id").agg(F.sum("tokens").alias("t"), F.sum("loss_tokens").alias("l"), F.count(F.lit(1)).alias("s"))
    return (
        each.withColumn("room", size.cast("bigint"))
        .groupBy("limit_id")
        .agg(F.count(F.lit(1)).alias("containers"), F.sum("s").alias("items"), F.sum("t").alias("tokens"), F.round(F.sum("t") / F.sum("room"), 6).alias("used_share"), F.max("t").alias("most_tokens"), F.max("l").alias("most_loss"), F.max("s").alias("most_segments"))
    )
