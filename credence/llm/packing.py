"""Best-fit packing by a configuration linear program.

Token sequences of bounded length are packed into as few windows as possible. What the
plan needs is the histogram of lengths, at most one number per length, so the plan is made
on the driver at a cost that does not depend on the number of documents:

1. the linear program over configurations (multisets of lengths that fit a window) is
   solved by multiplicative weights. A round prices each length at its size times a weight
   that falls exponentially with the share of its demand that is met, solves the knapsack
   over the capacity by dynamic programming, and takes up every configuration of a length
   with the best of what the rest of the window holds, as long as it is nearly tight. Any
   prices bound the optimum from below: the worth of the demand over that of the best
   configuration. Rounds go on until what is taken and what is left are within GAP of the
   bound, or no configuration is nearly tight (where lengths do not fill windows);
2. the solution is rounded: whole parts first, then one more window of the configurations
   with the largest rests, as long as the demand has them; best fit packs what is left, on
   counts: windows with equal content are one entry with a multiplicity;
3. best fit alone is planned too, and the plan with fewer windows is used.

A configuration with its multiplicity claims a range of ranks of each of its lengths.
Pieces get their rank within their length from counts per block, so no length, however
frequent, is numbered in one task, and each piece finds its window by binary search in
the plan, which is as large as the set of configurations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from credence.llm.common import documents, materialize
from credence.llm.tokens import json_encoder

WINDOW = 2048
END_ID = 0
#: Rows numbered together within a length.
BLOCK_ROWS = 1000
#: The program is solved when its solution is at most this share above the lower bound.
GAP = 0.001
#: How fast a length's weight falls with the share of its demand that is met.
RATE = 0.03
#: The largest share of a length's demand that one configuration meets in a round.
STEP = 0.3
#: Configurations are taken up if they are within this share of tight under the best prices.
NEAR_TIGHT = 0.0005


# ---------------------------------------------------------------- the plan, on counts


def knapsack(value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: the best worth within each capacity, and the length taken last there.

    value[l] is the worth of length l (index 0 unused); lengths of no worth are not used.
    Where the last length is 0 the best is that of one less capacity.
    """
    lengths = np.flatnonzero(value[: capacity + 1] > 0)
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int32)
    worth = value[lengths]
    until = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := until[c]:
            total = best[c - lengths[:k]] + worth[:k]
            if total[j := int(total.argmax())] > best[c]:
                best[c], last[c] = total[j], lengths[j]
    return best, last


def content(last: np.ndarray, capacity: int) -> dict[int, int]:
    """Length -> copies of the best configuration within a capacity."""
    copies: dict[int, int] = {}
    c = capacity
    while c > 0:
        if l := int(last[c]):
            copies[l] = copies.get(l, 0) + 1
        c -= l or 1
    return copies


def fractional_solution(demand: np.ndarray, capacity: int, gap: float = GAP) -> tuple[dict[tuple, float], float]:
    """Configurations with fractional multiplicities that meet the demand, never more of it; a lower bound.

    Only configurations that are nearly tight under the prices of the best bound are taken
    up, as an optimal solution has no others. Each step meets STEP of some demand or all
    that is left of it, and a round without a step is the last, so rounds come to an end.
    """
    sizes = np.flatnonzero(demand)
    left, found, bound, taken = demand.astype(float), {}, 0.0, 0.0
    prices, volume = np.zeros(len(demand)), np.arange(len(demand)) / capacity
    # any fit leaves windows half full at worst
    while len(live := sizes[left[sizes] > 1e-9]) and taken + 2 * (volume @ left) + 1 > (1 + gap) * bound:
        met = 1 - left[live] / demand[live]
        value = np.zeros(len(demand))
        value[live] = live * np.exp(-RATE * (met - met.min()))
        best, last = knapsack(value, capacity)
        if (own := float(value @ demand) / best[capacity]) > bound:
            bound, prices = own, value / best[capacity]
        before = taken
        # the best first, then those of each length, by how far it lags behind
        for length in [0, *live[np.argsort(met, kind="stable")].tolist()]:
            if length and left[length] <= 1e-9:
                continue
            config = content(last, capacity - length)
            if length:
                config[length] = config.get(length, 0) + 1
            step = min(min(left[l], STEP * demand[l]) / n for l, n in config.items())
            if step <= 1e-9 or sum(prices[l] * n for l, n in config.items()) < 1 - NEAR_TIGHT:
                continue
            key = tuple(sorted(config.items(), reverse=True))
            found[key] = found.get(key, 0.0) + step
            taken += step
            for l, n in config.items():
                left[l] -= n * step
        if taken == before:
            break
    return found, bound


def rounded(found: dict[tuple, float], demand: np.ndarray) -> list[tuple[list[tuple[int, int]], int]]:
    """Whole multiplicities of the solution's configurations; `demand` is lowered by what they meet."""
    times: dict[tuple, int] = {}

    def take(config: tuple, most: int) -> None:
        if n := min(most, *(int(demand[l]) // k for l, k in config)):
            times[config] = times.get(config, 0) + n
            for l, k in config:
                demand[l] -= n * k

    for config, amount in sorted(found.items(), key=lambda e: (-e[1], e[0])):
        take(config, int(amount + 1e-9))
    for config, amount in sorted(found.items(), key=lambda e: (-(e[1] % 1), e[0])):
        take(config, 1)
    return [(list(config), n) for config, n in times.items()]


def best_fit(demand: np.ndarray, capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best fit, longest first, on counts: equal windows are one entry with a multiplicity."""
    open_windows: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    for length in np.flatnonzero(demand)[::-1].tolist():
        left = int(demand[length])
        for room in sorted(r for r in open_windows if r >= length):
            if not left:
                break
            each = room // length
            for config, times in open_windows.pop(room):
                full = min(times, left // each)
                rest = left - full * each if full < times else 0
                tail = min(rest, each - 1) if full < times and rest < each else 0
                for copies, n in ((each, full), (tail, 1 if tail else 0), (0, times - full - (1 if tail else 0))):
                    if n:
                        packed = [*config, (length, copies)] if copies else config
                        open_windows.setdefault(room - copies * length, []).append((packed, n))
                left -= full * each + tail
        if left:
            each = capacity // length
            if full := left // each:
                open_windows.setdefault(capacity - each * length, []).append(([(length, each)], full))
            if tail := left % each:
                open_windows.setdefault(capacity - tail * length, []).append(([(length, tail)], 1))
    return [entry for entries in open_windows.values() for entry in entries]


@dataclass
class Plan:
    """For each length, ascending rank ranges: entry k holds ranks first[k] to first[k+1]."""

    first: dict[int, np.ndarray]
    copies: dict[int, np.ndarray]
    window: dict[int, np.ndarray]
    offset: dict[int, np.ndarray]
    n_windows: int
    #: Windows that come from the linear program, and its lower bound on all.
    from_program: int
    bound: float

    def place(self, length: int, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and offset of the pieces of one length with these ranks from 0."""
        k = np.searchsorted(self.first[length], ranks, side="right") - 1
        into = ranks - self.first[length][k]
        copies = self.copies[length][k]
        return self.window[length][k] + into // copies, self.offset[length][k] + into % copies * length


def make_plan(demand: np.ndarray, capacity: int, gap: float = GAP) -> Plan:
    """The windows for demand[l] pieces of each length l <= capacity."""
    demand = np.asarray(demand, np.int64)
    found, bound = fractional_solution(demand, capacity, gap)
    left = demand.copy()
    entries = rounded(found, left)
    from_program = sum(times for _, times in entries)
    entries += best_fit(left, capacity)
    alone = best_fit(demand, capacity)
    if sum(times for _, times in alone) < sum(times for _, times in entries):
        entries, from_program = alone, 0
    parts: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    window = 0
    for config, times in entries:
        offset = 0
        for length, n in config:
            parts.setdefault(length, []).append((ranks.get(length, 0), n, window, offset))
            ranks[length] = ranks.get(length, 0) + n * times
            offset += n * length
        window += times
    columns = {l: np.array(rows, np.int64).T for l, rows in parts.items()}
    return Plan(*({l: c[k] for l, c in columns.items()} for k in range(4)), window, from_program, bound)


# ---------------------------------------------------------------- pieces


def cut(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first of several may be short."""
    first = n % window or min(n, window)
    return [(0, first)] + [(s, window) for s in range(first, n, window)] if n else []


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *,
                 window: int = WINDOW, end_id: int = END_ID, added_tokens: bool = True) -> DataFrame:
    """One row per piece: id, piece, start, length and the ids as little-endian unsigned 32-bit numbers."""
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = json_encoder(tokenizer, added_tokens)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                rows = []
                part = batch.slice(at, 64)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = np.array([*encode(text or ""), end_id], "<u4")
                    rows += [(key, k, start, length, ids[start : start + length].tobytes()) for k, (start, length) in enumerate(cut(len(ids), window))]
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                                 names=["id", "piece", "start", "length", "ids"])

    return source.mapInArrow(pieces, "id bigint, piece int, start bigint, length bigint, ids binary")


def pack(pieces: DataFrame, *, window: int = WINDOW, gap: float = GAP, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """`pieces` (any columns, with `length` from 1 to window) plus sequence_id and offset.

    Whole windows are sequences of their own. Of equal lengths any may take any place.
    Columns of the names sequence_id and offset are not allowed.
    """
    clash = {"sequence_id", "offset"} & {c.lower() for c in pieces.columns}
    if clash:
        raise ValueError(f"The pieces have columns that packing adds: {sorted(clash)}")
    rows = materialize(pieces.select(F.struct(*[F.col(f"`{c}`") for c in pieces.columns]).alias("record"), F.col("length").cast("long").alias("length"),
                                     F.monotonically_increasing_id().alias("row")), "pieces")
    whole = rows.filter(F.col("length") == window)
    short = rows.filter(F.col("length") < window)
    demand = np.zeros(window + 1, np.int64)
    for r in short.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per length
        demand[r["length"]] = r["n"]
    # a frequent length has more blocks than a rare one
    blocks = F.get(F.lit(np.maximum(1, -(-demand // block_rows)).tolist()), F.col("length").cast("int"))
    short = short.withColumn("block", F.pmod(F.xxhash64("row"), blocks).cast("int"))
    counts = short.groupBy("length", "block").agg(F.count(F.lit(1)).alias("n"))
    plan = make_plan(demand, window, gap)
    offsets = counts.withColumn(
        "before", F.sum("n").over(Window.partitionBy("length").orderBy("block")) - F.col("n")).drop("n")
    ranked = (short.withColumn("within", F.row_number().over(Window.partitionBy("length", "block").orderBy("row")) - 1)
              .join(offsets, ["length", "block"])
              .withColumn("rank", F.col("within") + F.col("before")))

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        lengths, ranks = length.to_numpy(), rank.to_numpy()
        out = np.zeros((len(lengths), 2), np.int64)
        for one in np.unique(lengths):
            own = lengths == one
            out[own, 0], out[own, 1] = plan.place(int(one), ranks[own])
        return pd.DataFrame(out, columns=["sequence_id", "offset"])

    placed = ranked.select("record", place("length", "rank").alias("p")).select("record.*", "p.sequence_id", "p.offset")
    alone = whole.select("record.*", (-1 - F.col("row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return placed.unionByName(alone)


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *,
                   window: int = WINDOW, end_id: int = END_ID, added_tokens: bool = True) -> DataFrame:
    """Tokenize, cut and pack: one row per piece of each document, with its ids.

    A null or empty text is the end token alone. The offsets of a sequence have no gaps.
    Rows that repeat an id are documents of their own; only id and text are read.
    """
    pieces = token_pieces(docs, tokenizer, id_col, text_col, window=window, end_id=end_id, added_tokens=added_tokens)
    packed = pack(pieces, window=window)
    return packed.withColumnRenamed("id", id_col)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, starts): the windows' ids put together, and where their pieces begin."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("parts")).select(
        "sequence_id", F.aggregate("parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"), F.col("parts.offset").alias("starts"))


def op6_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")
