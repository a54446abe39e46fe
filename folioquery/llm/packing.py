"""Problem 7: filling fixed-capacity containers (context windows) with texts of varying length.

Bounded-space online packing: each partition keeps a fixed number of open windows; an item goes into the fullest window
that still holds it (best fit); when none does, the fullest window is emitted and a new one opened. What is open at the end
of a partition is merged in a second step, 64 partitions at a time, by best fit over the leftover windows, fullest first.
Only an item larger than a container is divided: into full containers and a remainder, which is packed like any item.

Defined results: null and empty texts are in no container; a blank text is an item; repeated texts and repeated ids are items
of their own; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import RANK_FILE, TOKENIZER_DIR, encoder, texts_of

CAPACITY = 2048
OPEN_WINDOWS = 64
MERGE_FAN_IN = 64
#: Windows in one batch of the merge.
MERGED_ROWS = 256


class Packer:
    """Best fit into at most `limit` open windows; an item is (size, payload)."""

    def __init__(self, capacity: int, limit: int) -> None:
        self.capacity, self.limit = capacity, limit
        self.free: list[tuple[int, int]] = []  # (free room, window number), ascending
        self.items: dict[int, list] = {}
        self.opened = 0

    def add(self, size: int, payload) -> tuple[int, list] | None:
        """Place an item; returns the window that was emitted to make room, if any, as (fill, payloads)."""
        out = None
        at = bisect_left(self.free, (size, -1))
        if at < len(self.free):
            room, window = self.free.pop(at)
        else:
            if len(self.free) >= self.limit:
                room, window = self.free.pop(0)
                out = (self.capacity - room, self.items.pop(window))
            room, window = self.capacity, self.opened
            self.opened += 1
            self.items[window] = []
        self.items[window].append(payload)
        if room == size:
            full = (self.capacity, self.items.pop(window))
            if out is None:
                return full
            # Both the fullest window and a new, exactly filled one are done: keep the latter as a window without room.
            self.items[window] = full[1]
            insort(self.free, (0, window))
            return out
        insort(self.free, (room - size, window))
        return out

    def rest(self) -> list[tuple[int, list]]:
        out = [(self.capacity - room, self.items[window]) for room, window in self.free]
        self.free, self.items = [], {}
        return out


_WINDOW = pa.schema([("route", pa.int64()), ("open", pa.bool_()), ("fill", pa.int32()), ("first", pa.int64()), ("items", pa.list_(pa.struct([("doc_id", pa.int64()), ("part", pa.int32()), ("start_token", pa.int32()), ("n_tokens", pa.int32())])))])
_WINDOW_DDL = "route bigint, open boolean, fill int, first bigint, items array<struct<doc_id:bigint,part:int,start_token:int,n_tokens:int>>"


def _rows(windows: list[tuple[bool, int, list[tuple[int, int, int, int]]]], route: int, serial: int, firsts: list[int] | None = None) -> pa.RecordBatch:
    """Windows as one batch, numbered from `serial` or as `firsts` says; closed ones are spread over the partitions, open ones go to their group's."""
    sizes = np.zeros(len(windows) + 1, dtype=np.int32)
    np.cumsum([len(w[2]) for w in windows], out=sizes[1:])
    flat = list(chain.from_iterable(w[2] for w in windows))
    item = pa.StructArray.from_arrays([pa.array([x[k] for x in flat], type=kind) for k, kind in enumerate((pa.int64(), pa.int32(), pa.int32(), pa.int32()))], names=["doc_id", "part", "start_token", "n_tokens"])
    return pa.RecordBatch.from_arrays(
        [
            pa.array([-1 - route if is_open else serial + i for i, (is_open, _, _) in enumerate(windows)], type=pa.int64()),
            pa.array([w[0] for w in windows], type=pa.bool_()),
            pa.array([w[1] for w in windows], type=pa.int32()),
            pa.array(firsts or [serial + i for i in range(len(windows))], type=pa.int64()),
            pa.ListArray.from_arrays(sizes, item),
        ],
        schema=_WINDOW,
    )


def pack_texts(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    open_windows: int = OPEN_WINDOWS,
    tokenizer_dir: str = TOKENIZER_DIR,
    rank_file: str = RANK_FILE,
) -> DataFrame:
    """(container_id, fill, doc_id, part, start_token, n_tokens): every non-empty text exactly once.

    Texts are read and sized where they lie; only the windows (ids and numbers, no text) are shuffled, once. An item of a
    divided text has part 0, 1, ... and start_token where it begins; others have part 0 and start_token 0. The
    result depends on how the input is split, not on the order in which tasks end, so a lost executor's work is redone alike.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_dir, rank_file)
        here = TaskContext.get().partitionId()
        packer, serial, route = Packer(capacity, open_windows), here << 33, here // MERGE_FAN_IN
        for batch in batches:
            texts, done = texts_of(batch.column(1)), []
            words = enc.words(texts)
            size = {w: len(enc.memo[w]) for w in set(chain.from_iterable(words))}
            for doc, own in zip(batch.column(0).to_pylist(), words):
                left, start, part = sum(map(size.__getitem__, own)), 0, 0
                whole = left <= capacity
                while left > capacity or (left == capacity and not whole):
                    done.append((False, capacity, [(doc, part, start, capacity)]))
                    left, start, part = left - capacity, start + capacity, part + 1
                if left and (out := packer.add(left, (doc, part, start, left))):
                    done.append((False, *out))
            if done:
                yield _rows(done, route, serial)
                serial += len(done)
        if rest := packer.rest():
            yield _rows([(f < capacity, f, items) for f, items in rest], route, serial)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, list] = {}
        for batch in batches:
            is_open = np.asarray(batch.column(1).to_numpy(zero_copy_only=False), dtype=bool)
            if (~is_open).any():
                yield batch.filter(pa.array(~is_open))
            if is_open.any():
                for row in batch.filter(pa.array(is_open)).to_pylist():
                    opened.setdefault(row["route"], []).append((row["fill"], row["first"], row["items"]))
        for route in sorted(opened):
            group = sorted(opened[route], key=lambda w: (-w[0], w[1]))
            packer, done = Packer(capacity, len(group) + 1), []
            for size, first, items in group:
                if out := packer.add(size, (first, items)):
                    done.append(out)
            ready = done + packer.rest()
            for i in range(0, len(ready), MERGED_ROWS):
                own = ready[i : i + MERGED_ROWS]
                yield _rows([(False, f, [tuple(x.values()) for _, items in parts for x in items]) for f, parts in own], route, 0, [min(first for first, _ in parts) for _, parts in own])

    windows = df.select(F.col(id_col).cast("bigint"), F.col(text_col).cast("binary")).where(F.length(text_col) > 0).mapInArrow(fill, _WINDOW_DDL)
    merged = windows.repartition("route").mapInArrow(merge, _WINDOW_DDL)
    return merged.select(F.col("first").alias("container_id"), "fill", F.inline("items")).select("container_id", "fill", F.col("doc_id").alias(id_col), "part", "start_token", "n_tokens")


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, items, tokens, the containers no packing can do without, and the share of room that is used."""
    whole = packed.agg(F.count_distinct("container_id").alias("containers"), F.count("*").alias("items"), F.sum("n_tokens").alias("tokens"))
    return whole.select("containers", "items", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"), (F.col("tokens") / (F.col("containers") * capacity)).alias("used"))


def coverage(packed: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """(id, whole, sound): whether the pieces of each text follow one another without gap or overlap; whether all their containers hold what they say
    and no more than the capacity, and only a text larger than a container is divided."""
    fills = packed.groupBy("container_id").agg(((F.sum("n_tokens") == F.max("fill")) & (F.max("fill") <= capacity)).alias("held"))
    pieces = F.array_sort(F.collect_list(F.struct("part", "start_token", "n_tokens")))
    texts = packed.join(fills, "container_id").groupBy(id_col).agg(pieces.alias("p"), F.bool_and("held").alias("held"), F.sum("n_tokens").alias("tokens"))
    ends = F.transform("p", lambda x: x["start_token"] + x["n_tokens"])
    follow = F.forall(F.zip_with(F.transform("p", lambda x: x["start_token"]), F.concat(F.array(F.lit(0)), F.slice(ends, 1, F.size("p") - 1)), lambda a, b: a == b), lambda x: x)
    return texts.select(id_col, follow.alias("whole"), (F.col("held") & ((F.size("p") == 1) | (F.col("tokens") > capacity))).alias("sound"))
