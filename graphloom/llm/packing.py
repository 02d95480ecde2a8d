"""Documents put into containers of a few fixed sizes with little space left unused.

Pieces are dealt to blocks by a hash of their document and place; a block is packed on its own. Each new container is planned for every
permitted size: the largest remaining item opens it and best fit fills it from the remaining sizes. The size that leaves
the least of itself unused is opened, and in the end every container is downsized to the smallest size that holds its
contents. Blocks are large, so what their last containers leave unused doesn't matter.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import materialise, ship

#: Items of one block, about.
BLOCK = 50_000
RESULT = (
    "bin bigint, container string, capacity int, used int, doc_id bigint, piece int, start int, tokens int, offset int"
)


class Stock:
    """Counts of the remaining items by size, with the largest one that still fits found at once."""

    def __init__(self, sizes: Sequence[int]) -> None:
        self.count: dict[int, int] = {}
        for s in sizes:
            self.count[s] = self.count.get(s, 0) + 1
        self.sizes = sorted(self.count)

    def fill(self, capacity: int) -> list[tuple[int, int]]:
        """Sizes and how many of each best fit puts into an empty container, the largest first; nothing is taken out."""
        out: list[tuple[int, int]] = []
        room, hi = capacity, len(self.sizes)
        while room > 0:
            hi = bisect_right(self.sizes, room, 0, hi)
            if not hi:
                break
            size = self.sizes[hi - 1]
            n = min(self.count[size], room // size)
            out.append((size, n))
            room -= n * size
            hi -= 1
        return self._closer(out, room)

    def _closer(self, out: list[tuple[int, int]], room: int) -> list[tuple[int, int]]:
        """One of the last item exchanged for a larger one, or for two, if that leaves less room."""
        if not room or not out:
            return out
        used = dict(out)
        free = lambda s: self.count.get(s, 0) - used.get(s, 0)
        best, change = room, None
        for size, _ in out[-2:]:
            space = room + size
            at = k = bisect_right(self.sizes, space)
            # the largest item that is free
            while k and (a := self.sizes[k - 1]) > size:
                if free(a) >= 1:
                    if space - a < best:
                        best, change = space - a, (size, (a,))
                    break
                k -= 1
            # two items whose sizes add up to the space
            low, high = 0, at - 1
            while low <= high and best:
                a, b = self.sizes[low], self.sizes[high]
                if a + b > space:
                    high -= 1
                    continue
                if free(a) >= 1 + (a == b) and free(b) >= 1 and space - a - b < best:
                    best, change = space - a - b, (size, (a, b))
                low += 1
        if change:
            used[change[0]] -= 1
            for a in change[1]:
                used[a] = used.get(a, 0) + 1
            return sorted(((s, n) for s, n in used.items() if n), reverse=True)
        return out

    def take(self, plan: list[tuple[int, int]], times: int = 1) -> None:
        for size, n in plan:
            self.count[size] -= n * times
            if not self.count[size]:
                del self.count[size]
                del self.sizes[bisect_left(self.sizes, size)]


def pack(sizes: Sequence[int], capacities: Sequence[int]) -> list[tuple[int, list[tuple[int, int]]]]:
    """Containers as (capacity, sizes and counts) for items that all fit the largest of the sorted ``capacities``."""
    stock, out = Stock([s for s in sizes if s > 0]), []
    while stock.sizes:
        largest = stock.sizes[-1]
        plans = []
        for c in capacities:
            if c < largest:
                continue
            plan = stock.fill(c)
            used = sum(s * n for s, n in plan)
            # what is unused once the container is downsized to its contents
            fit = capacities[bisect_left(capacities, used)]
            plans.append(((fit - used) / fit, -fit, plan))
        waste, size, plan = min(plans, key=lambda p: p[:2])
        times = min(stock.count[s] // n for s, n in plan)
        stock.take(plan, times)
        out += [(-size, plan)] * times
    return out


def _packer(names: list[str], capacities: list[int], out: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        blocks: dict[int, list[tuple[np.ndarray, ...]]] = {}
        for b in batches:
            cols = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
            for block in np.unique(cols[0]):
                at = cols[0] == block
                blocks.setdefault(int(block), []).append(tuple(c[at] for c in cols[1:]))
        for block, parts in sorted(blocks.items()):
            doc, piece, start, tokens = (np.concatenate(c) for c in zip(*parts, strict=True))
            order = np.lexsort((piece, doc, tokens))
            doc, piece, start, tokens = doc[order], piece[order], start[order], tokens[order]
            # items of one size lie together and are dealt in order
            values, first = np.unique(tokens, return_index=True)
            next_ = dict(zip(values.tolist(), first.tolist(), strict=True))
            empty = int(first[1] if len(first) > 1 else len(tokens)) if len(values) and values[0] == 0 else 0
            bins = pack(tokens.tolist(), capacities)
            if empty and not bins:
                bins = [(capacities[0], [])]
            index, bin_, capacity, used, offset = [], [], [], [], []
            for n, (size, plan) in enumerate(bins):
                full = sum(s * k for s, k in plan)
                if n == 0 and empty:
                    # documents without tokens take no room
                    index += range(empty)
                    bin_ += [n] * empty
                    capacity += [size] * empty
                    used += [full] * empty
                    offset += [0] * empty
                at = 0
                for s, k in plan:
                    i = next_[s]
                    next_[s] = i + k
                    index += range(i, i + k)
                    bin_ += [n] * k
                    capacity += [size] * k
                    used += [full] * k
                    offset += range(at, at + s * k, s)
                    at += s * k
            name = {c: x for x, c in zip(names, capacities, strict=True)}
            for a in range(0, len(index), 100_000):
                i = np.array(index[a : a + 100_000], np.int64)
                c = capacity[a : a + 100_000]
                columns = [
                    (np.array(bin_[a : a + 100_000], np.int64) + (block << 32)), [name[x] for x in c], c, used[a : a + 100_000],
                    doc[i], piece[i], start[i], tokens[i], offset[a : a + 100_000],
                ]
                yield pa.RecordBatch.from_arrays([pa.array(x).cast(f.type) for x, f in zip(columns, out, strict=True)], schema=out)

    return run


def pack_documents(sizes: DataFrame, containers: Sequence[tuple[str, int]], block: int = BLOCK) -> DataFrame:
    """One row per piece of a document (doc_id, tokens): its container, and where in it the piece lies.

    A document is one piece unless it alone exceeds the largest container; then its pieces fill containers of that size
    and the rest is packed like any other. Documents with null or no tokens take no room. Of containers of one size the
    first name counts. An empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    by_size: dict[int, str] = {}
    for name, c in sorted(containers, key=lambda x: (x[1], x[0])):
        by_size.setdefault(int(c), name)
    capacities, names = sorted(by_size), [by_size[c] for c in sorted(by_size)]
    if not capacities or capacities[0] <= 0:
        raise ValueError("containers need a positive capacity")
    ship(sizes.sparkSession)
    sizes = materialise(sizes.select(F.col("doc_id").cast("bigint"), F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens")), "sizes")
    most = F.lit(capacities[-1]).cast("bigint")
    last = F.when(F.col("tokens") > 0, F.floor((F.col("tokens") - 1) / most)).otherwise(F.lit(0))
    pieces = sizes.select("doc_id", "tokens", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("piece")).select(
        "doc_id",
        F.col("piece").cast("int"),
        (F.col("piece") * most).alias("start"),
        F.least(most, F.col("tokens") - F.col("piece") * most).alias("tokens"),
    )
    # pieces of one document go to different blocks, so however long it is it doesn't fill one
    n = max(1, round((sizes.agg(F.sum(last + 1)).first()[0] or 0) / block))
    dealt = pieces.select(F.pmod(F.xxhash64("doc_id", "piece"), F.lit(n)).alias("block"), "doc_id", "piece", "start", "tokens")
    kind = _parse_datatype_string(RESULT)
    return dealt.repartition(n, "block").mapInArrow(_packer(names, capacities, to_arrow_schema(kind)), kind)
