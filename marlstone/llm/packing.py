"""Problem 6: containers of fixed capacity, filled by optimal length buckets.

A driver-side plan is made from the histogram of item sizes, which has at most ``capacity`` bins whatever the corpus. Dynamic
programming chooses the bucket boundaries with the least padding, exactly. Batches with a token budget of one capacity form inside a
bucket, from the largest down; the room that a batch leaves is topped up from smaller buckets, as items of more than half a
capacity would otherwise leave the rest of their container empty. Items get their place from their rank in their bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marlstone.llm.tokens import TOKENIZER, token_counts
from marlstone.session import cut

BUCKETS = 128
_ROWS_A_SALT = 50_000


class Plan(NamedTuple):
    """bounds: upper ends of the buckets. For each run of equal batches: bucket, first rank, items a batch, first container."""

    bounds: np.ndarray
    bucket: np.ndarray
    first_rank: np.ndarray
    per_batch: np.ndarray
    first_container: np.ndarray
    containers: int


def _best_cuts(best: np.ndarray, ends: np.ndarray, count: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every j the least of best[i] + the padding of the sizes behind i up to j raised to ends[j], over i < j, and the i.

    The smallest best i never falls as j grows, so the middle j of a stretch splits its candidates between its halves: all
    stretches of one level are scanned together, in about 2 m steps a level.
    """
    m = len(ends)
    lower, pick = np.full(m, np.inf), np.full(m, -1, dtype=np.int64)
    lo, hi = np.array([1]), np.array([m - 1])  # stretches of j, both ends included
    first, last = np.array([0]), np.array([m - 2])  # their candidates
    while len(lo):
        mid = (lo + hi) // 2
        to = np.minimum(last, mid - 1)
        n = to - first + 1
        at = np.repeat(np.cumsum(n) - n, n)
        i = np.arange(n.sum()) - at + np.repeat(first, n)
        j = np.repeat(mid, n)
        total = best[i] + ends[j] * (count[j + 1] - count[i + 1]) - (weight[j + 1] - weight[i + 1])
        least = np.minimum.reduceat(total, np.cumsum(n) - n)
        hit = np.flatnonzero(total == np.repeat(least, n))
        owner = np.searchsorted(np.cumsum(n), hit, "right")
        chosen = i[hit[np.unique(owner, return_index=True)[1]]]
        lower[mid], pick[mid] = least, chosen
        left, right = lo < mid, mid < hi
        lo, hi, first, last = (np.concatenate(x) for x in ((lo[left], mid[right] + 1), (mid[left] - 1, hi[right]), (first[left], chosen[right]), (chosen[left], last[right])))
    return lower, pick


def optimal_bounds(sizes: np.ndarray, counts: np.ndarray, capacity: int, buckets: int = BUCKETS) -> np.ndarray:
    """Upper ends of at most ``buckets`` buckets that minimise the padding when every size is raised to its upper end.

    ``counts[k]`` items have size ``sizes[k]`` (ascending). The last end is always the capacity, so every size has a bucket.
    """
    ends = np.unique(np.maximum(sizes, 1)).astype(np.int64)
    if not len(ends) or ends[-1] != capacity:
        ends = np.append(ends, capacity)
    if len(ends) <= buckets:
        return ends
    at = np.searchsorted(ends, np.maximum(sizes, 1))
    own = np.bincount(at, counts, len(ends))
    count, weight = np.concatenate([[0], np.cumsum(own)]), np.concatenate([[0], np.cumsum(own * ends)])
    best = ends * count[1:] - weight[1:]
    cuts = []
    for _ in range(buckets - 1):
        lower, pick = _best_cuts(best, ends, count, weight)
        cuts.append(np.where(lower < best, pick, -1))
        best = np.minimum(lower, best)
    chosen, j = [len(ends) - 1], len(ends) - 1
    for layer in reversed(cuts):
        if layer[j] >= 0:
            j = int(layer[j])
            chosen.append(j)
    return ends[chosen[::-1]]


def make_plan(sizes: np.ndarray, counts: np.ndarray, capacity: int, buckets: int = BUCKETS) -> Plan:
    """Bucket boundaries and runs of equal batches for ``counts[k]`` items of size ``sizes[k]``, 0 to capacity."""
    bounds = optimal_bounds(sizes, counts.astype(float), capacity, buckets)
    left = np.bincount(np.searchsorted(bounds, sizes), counts, len(bounds)).astype(np.int64)
    used = np.zeros_like(left)
    runs: list[tuple[int, int, int, int]] = []
    containers, b = 0, len(bounds) - 1
    while b >= 0:
        if not left[b]:
            b -= 1
            continue
        room, take = capacity, {}
        k = b
        while k >= 0:
            n = int(min(room // bounds[k], left[k]))
            if n:
                take[k] = n
                room -= n * int(bounds[k])
            k = min(k - 1, int(np.searchsorted(bounds, room, "right")) - 1)
        times = int(min(left[k] // n for k, n in take.items()))
        for k, n in take.items():
            runs.append((k, int(used[k]), n, containers))
            used[k] += n * times
            left[k] -= n * times
        containers += times
    runs.sort()
    bucket, first_rank, per_batch, first_container = (np.array(x, dtype=np.int64) for x in zip(*runs, strict=True)) if runs else [np.zeros(0, np.int64)] * 4
    return Plan(bounds, bucket, first_rank, per_batch, first_container, containers)


def _items(counts: DataFrame, packs: list[tuple[str, int]], key: str) -> DataFrame:
    """The pieces of every document for every pack: whole if it fits, else full pieces and the rest."""
    n, cap = F.col("n_tokens"), F.col("capacity")
    parts = F.greatest(F.ceil(n / cap).cast("int"), F.lit(1))
    return (
        counts.select(key, n, F.explode(F.array(*(F.struct(F.lit(name).alias("pack_name"), F.lit(size).cast("long").alias("capacity")) for name, size in packs))).alias("p"))
        .select("p.pack_name", "p.capacity", key, n)
        .select("pack_name", "capacity", key, n, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part_no"))
        .withColumn("first_token", F.col("part_no") * cap)
        .withColumn("size", F.least(n - F.col("first_token"), cap))
    )


def pack_documents(documents: DataFrame, pack_sizes: DataFrame, key: str = "doc_id", text: str = "text", buckets: int = BUCKETS, tokenizer: str = TOKENIZER) -> DataFrame:
    """``pack_name, container_id, doc_id, part_no, first_token, n_tokens``: every document once for every pack.

    A document of up to capacity_tokens tokens lies whole in one container (part_no 0); a longer one fills containers of its
    own, and its rest is an item like any other. Null and empty texts are items of 0 tokens. Repeated rows count once. Packs
    whose name or capacity is null or whose capacity is below 1 are left out; empty tables give no rows. The packs become
    literals of the plan; the driver holds the sizes that occur and their counts, whatever the capacity.
    """
    spark = documents.sparkSession
    rows = pack_sizes.select("pack_name", F.col("capacity_tokens").cast("long").alias("capacity")).filter("pack_name is not null and capacity >= 1").groupBy("pack_name").agg(F.max("capacity").alias("capacity")).collect()
    if not rows:
        return spark.createDataFrame([], f"pack_name string, container_id bigint, {key} bigint, part_no int, first_token bigint, n_tokens bigint")
    counts = cut(token_counts(documents, key, text, tokenizer))
    items = _items(counts, [tuple(r) for r in rows], key)
    seen = items.groupBy("pack_name", "size").agg(F.count(F.lit(1)).alias("n")).orderBy("pack_name", "size").toPandas()
    plans = {r.pack_name: make_plan(own["size"].to_numpy(np.int64), own["n"].to_numpy(np.int64), r.capacity) for r in rows for own in [seen[seen["pack_name"] == r.pack_name]]}
    salts = max(1, -(-int(seen["n"].max() if len(seen) else 1) // _ROWS_A_SALT))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bucket of each item."""
        for batch in batches:
            names, size = batch.column("pack_name").to_pylist(), batch.column("size").to_numpy()
            out = np.zeros(len(size), dtype=np.int32)
            at = np.array(names, dtype=object)
            for name in set(names):
                out[at == name] = np.searchsorted(plans[name].bounds, size[at == name])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], names=[*batch.schema.names, "bucket"])

    def contain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The container of each item from its rank in its bucket."""
        for batch in batches:
            names = np.array(batch.column("pack_name").to_pylist(), dtype=object)
            bucket, rank = batch.column("bucket").to_numpy(), batch.column("rank").to_numpy()
            out = np.zeros(len(rank), dtype=np.int64)
            for name in set(names.tolist()):
                p, mine = plans[name], names == name
                shift = np.int64(1) << 44  # ranks stay below; one sorted key for bucket and rank
                run = np.searchsorted(p.bucket * shift + p.first_rank, bucket[mine].astype(np.int64) * shift + rank[mine], "right") - 1
                out[mine] = p.first_container[run] + (rank[mine] - p.first_rank[run]) // p.per_batch[run]
            keep = ["pack_name", key, "part_no", "first_token", "size"]
            yield pa.RecordBatch.from_arrays([batch.column("pack_name"), pa.array(out), *(batch.column(c) for c in keep[1:])], names=["pack_name", "container_id", key, "part_no", "first_token", "n_tokens"])

    base = items.select("pack_name", key, "part_no", "first_token", "size")
    placed = base.mapInArrow(place, f"pack_name string, {key} bigint, part_no int, first_token bigint, size bigint, bucket int")
    placed = placed.withColumn("_salt", F.pmod(F.xxhash64(key, "part_no"), F.lit(salts)).cast("int"))
    group = ["pack_name", "bucket", "_salt"]
    offsets = placed.groupBy(*group).count().withColumn("_from", F.sum("count").over(Window.partitionBy("pack_name", "bucket").orderBy("_salt")) - F.col("count")).drop("count")
    ranked = placed.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(key, "part_no"))).join(offsets, group)
    ranked = ranked.select("pack_name", key, "part_no", "first_token", "size", "bucket", (F.col("_from") + F.col("_n") - 1).alias("rank"))
    return ranked.mapInArrow(contain, f"pack_name string, container_id bigint, {key} bigint, part_no int, first_token bigint, n_tokens bigint")


def container_fill(packed: DataFrame, pack_sizes: DataFrame) -> DataFrame:
    """``pack_name, containers, least, items, tokens, fullest, fill``: the containers used, the number that no packing can
    undercut (that of the tokens by the capacity), and the share of all room that is used."""
    packs = pack_sizes.groupBy("pack_name").agg(F.max("capacity_tokens").alias("capacity"))
    used = packed.groupBy("pack_name", "container_id").agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("tokens"))
    totals = used.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"))
    return totals.join(packs, "pack_name").select("pack_name", "containers", F.ceil(F.col("tokens") / F.col("capacity")).alias("least"), "items", "tokens", "fullest", (F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("fill"))
