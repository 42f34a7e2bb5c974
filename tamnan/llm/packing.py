"""Items of varying length packed into containers of one capacity.

Linear grouping: the large items of a shard are sorted and cut into ``GROUPS`` groups of equal
cardinality; each is rounded up to the largest of its group, so few sizes remain.  Configurations of
those sizes are found one after another by a bounded knapsack and applied as often as they fit; the
actual items are substituted, and small items go where they fit best.

Shards of about ``SHARD`` items are drawn by hash, so no group of equal sizes ever meets in one task
and a shard's loss is at most a container or two.

Defined cases: an item larger than the capacity becomes full containers and a rest (the only items
split); null and empty texts have 0 tokens and share the first container of their shard; repeated
items are packed each.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamnan.functions.cluster import cut_lineage

SHARD = 8192
#: Most tasks that shards are spread over; more shards only make each task's list longer, not its memory.
TASKS = 20_000
GROUPS = 400
#: An item below this part of the capacity is small.
SMALL = 6
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[str, object] = {}


def encoder(path: str):
    """The byte-level BPE tokenizer of a ranks file, loaded once a worker."""
    if path not in _ENCODERS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(documents: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens) of every document."""
    source = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.col("key").isNotNull())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        e = encoder(path)
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "n_tokens": np.array([len(e.encode_ordinary(t)) if t else 0 for t in b["text"].tolist()], dtype=np.int32)})

    return source.mapInPandas(run, "key bigint, n_tokens int").withColumnRenamed("key", key)


def _configuration(sizes: list[int], left: list[int], capacity: int, first: int) -> list[int]:
    """How often each size goes into one container that holds ``first``, filled as far as the remaining counts allow."""
    room = capacity - sizes[first]
    reach = np.full(room + 1, -1, dtype=np.int64)  # the size that completed a sum
    reach[0] = -2
    for j in range(first, len(sizes)):
        s, n = sizes[j], left[j] - (j == first)
        for _ in range(min(n, room // s if s else 0)):
            new = (reach[s:] == -1) & (reach[: room + 1 - s] != -1)
            if not new.any():
                break
            reach[s:][new] = j
        if reach[room] != -1:
            break
    total = int(np.flatnonzero(reach != -1)[-1])
    use = [0] * len(sizes)
    use[first] = 1
    while total:
        j = int(reach[total])
        if use[j] >= left[j]:  # more than there are: stop here, the room stays for small items
            break
        use[j] += 1
        total -= sizes[j]
    return use


def pack(sizes: np.ndarray, capacity: int, groups: int = GROUPS) -> np.ndarray:
    """Container number of each item; all ``sizes`` are at most ``capacity``."""
    n = len(sizes)
    container = np.zeros(n, dtype=np.int64)
    if not n:
        return container
    order = np.argsort(-sizes, kind="stable")
    large = order[sizes[order] * SMALL > capacity]
    small = order[sizes[order] * SMALL <= capacity]
    rooms: list[int] = []
    if len(large):
        parts = [p for p in np.array_split(large, min(groups, len(large))) if len(p)]
        merged: dict[int, list[int]] = defaultdict(list)
        for p in parts:
            merged[int(sizes[p[0]])] += p.tolist()
        rounded = sorted(merged, reverse=True)
        queue = [merged[s] for s in rounded]
        left = [len(q) for q in queue]
        for first in range(len(rounded)):
            while left[first]:
                use = _configuration(rounded, left, capacity, first)
                times = min(left[j] // u for j, u in enumerate(use) if u)
                for _ in range(times):
                    used = 0
                    for j, u in enumerate(use):
                        for _ in range(u):
                            i = queue[j].pop()
                            container[i] = len(rooms)
                            used += int(sizes[i])
                    rooms.append(capacity - used)
                for j, u in enumerate(use):
                    left[j] -= u * times
    free = sorted((room, c) for c, room in enumerate(rooms))
    for i in small.tolist():
        s = int(sizes[i])
        at = bisect_left(free, (s, -1))
        if at == len(free):
            free.append((capacity, len(rooms)))
            rooms.append(capacity)
            at = len(free) - 1
        room, c = free.pop(at)
        container[i] = c
        insort(free, (room - s, c))
    return container


def pack_documents(counts: DataFrame, capacity: int, key: str = "doc_id") -> DataFrame:
    """(key, piece, container_id, tokens): ``counts`` is (key, n_tokens)."""
    if capacity <= 0:
        raise ValueError(f"capacity {capacity}")
    sized = cut_lineage(counts.select(F.col(key).cast("bigint").alias("key"), F.coalesce("n_tokens", F.lit(0)).alias("n")))
    shards = max(1, -(-sized.count() // SHARD))
    # by number of tasks, which adaptive execution doesn't merge: the rows are small and the work on them isn't
    sharded = sized.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(shards))).repartition(min(shards, TASKS), "shard")

    def run(k: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["n", "key"], ascending=[False, True], kind="stable")
        n = rows["n"].to_numpy(dtype=np.int64)
        full = n // capacity - ((n % capacity == 0) & (n > 0))
        rest = n - full * capacity
        base = int(k[0]) << 32
        inner = pack(rest, capacity)
        start = int(inner.max()) + 1 if len(inner) else 0
        keys = rows["key"].to_numpy()
        again = np.repeat(np.arange(len(keys)), full)
        piece = np.arange(len(again)) - np.repeat(np.cumsum(full) - full, full)
        return pd.DataFrame(
            {
                "key": np.concatenate([keys, keys[again]]),
                "piece": np.concatenate([full, piece]).astype(np.int32),
                "container_id": base + np.concatenate([inner, start + np.arange(len(again))]),
                "tokens": np.concatenate([rest, np.full(len(again), capacity)]).astype(np.int32),
            }
        )

    return sharded.groupBy("shard").applyInPandas(run, "key bigint, piece int, container_id bigint, tokens int").withColumnRenamed("key", key)
