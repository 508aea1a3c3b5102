"""Greedy bursts: windows of a fixed length, each opened by the first event that sees enough others, none overlapping another.

Time is cut into slots as wide as the window. No window spans an empty slot, so a key's runs of filled slots (islands) are
walked apart, and islands of too few events are dropped before anything but counts is shuffled. An island of up to
``limit`` events is streamed by one task, which holds the events of one window. A larger one, a flood without a pause, is cut
into blocks by time:

1. A block's list of its first ``threshold`` events (or distinct values) is joined with the lists of the blocks behind it, so
   that each block knows what its last windows see beyond it.
2. Backwards through a block, the list of the first ``threshold`` events (values) from each event on tells whether the event can
   open a burst. Those that can are followed to the time at which the walk would leave the block.
3. The leaving times are nodes: each leads to a later block, and there to the next leaving time. Pointer jumping over
   these nodes finds those that the walk from the island's first event really meets, in rounds that grow with the logarithm of the blocks.
4. Every block that the walk enters is walked from there, and its events join the burst they lie in.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrylog.plans.lineage import cut
from quarrylog.plans.ordered import HOT, RANGE, in_ranges
from quarrylog.plans.scratch import Scratch

SECOND = 1_000_000
#: Before any time.
START = -(2**62)


def _walk(n_keys: int, threshold: int, window: int, distinct: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams rows sorted by key and time; holds the events of one window of one key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: deque = deque()
        users: Counter = Counter()
        out: list[tuple] = []
        key: tuple | None = None

        def shut() -> None:
            """The first window is complete: a burst, or its first event goes."""
            if (len(users) if distinct else len(held)) >= threshold:
                members = sorted(users) if distinct else None
                out.append((*key[:n_keys], held[0][0], held[0][1], len(users) if distinct else len(held), held[-1][0], sorted({x[2] for x in held if x[2]}), members))
                held.clear(), users.clear()
            else:
                user = held.popleft()[3]
                users[user] -= 1
                if not users[user]:
                    del users[user]

        def made() -> pa.RecordBatch:
            kinds = [*[pa.string()] * n_keys, pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.string())]
            columns = list(zip(*out, strict=True)) or [()] * len(kinds)
            names = [*[f"k{k}" for k in range(n_keys)], "t", "line_no", "n", "end", "seen", "members"]
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for *new, t, line_no, source, user in zip(*columns, strict=True):
                if (new := tuple(new)) != key:
                    while held:
                        shut()
                    key = new
                while held and t - held[0][0] > window:
                    shut()
                held.append((t, line_no, source, user))
                users[user] += 1
            yield made()
            out.clear()
        while held:
            shut()
        yield made()

    return run


def _sorted(table: pa.Table) -> tuple[np.ndarray, list | None]:
    """Times and values (None where the table has none) in the order of time, then line."""
    table = table.sort_by([("t", "ascending"), ("line_no", "ascending")])
    return table["t"].to_numpy(), table["value"].to_pylist() if "value" in table.column_names else None


def _first(times: list, values: list | None, more: list[tuple], k: int) -> list[tuple]:
    """The first ``k`` (time, value) of a block, each value once, and then of ``more``, which comes behind it; without values, of events."""
    found: list[tuple] = []
    seen = set()
    for t, v in [*zip(times, values if values is not None else [None] * len(times), strict=True), *more]:
        if len(found) == k:
            break
        if values is None or v not in seen:
            seen.add(v)
            found.append((t, v))
    return found


def _reach(times: np.ndarray, values: list | None, more: list[tuple], k: int) -> np.ndarray:
    """For each event of a block the time at which its window has ``k`` events (distinct values); beyond all times if never."""
    never = 2**62
    if values is None:
        after = np.r_[times, np.array([t for t, _ in more], dtype=np.int64), np.full(k, never)]
        return after[k - 1 : k - 1 + len(times)]
    out = np.full(len(times), never)
    ahead = list(more)  # the first k values from here on, by their first time
    for i in range(len(times) - 1, -1, -1):
        t, v = int(times[i]), values[i]
        at = next((j for j, x in enumerate(ahead) if x[1] == v), None)
        if at is not None:
            del ahead[at]
        ahead.insert(0, (t, v))
        del ahead[k:]
        if len(ahead) == k:
            out[i] = ahead[-1][0]
    return out


def _lists(pairs: list[tuple]) -> tuple[list, list]:
    return [t for t, _ in pairs], [v for _, v in pairs]


def _large_bursts(rows: DataFrame, total: int, threshold: int, window: int, distinct: bool, size: int) -> DataFrame:
    """(g, t, line_no, n, end, seen, members) of islands g; rows: (g, t, line_no, source, value), ``total`` of them."""
    k = threshold
    steps = Scratch(rows.sparkSession)
    rows = in_ranges(rows, ["g"], ["t", "line_no"], total, size)
    block = ["g", "block"]
    narrow = rows.select(*block, "t", "line_no", *["value"] * distinct)
    lists = "times array<long>, values array<string>"
    schema = pa.schema([("g", pa.int64()), ("block", pa.int32()), ("times", pa.list_(pa.int64())), ("values", pa.list_(pa.string()))])

    def firsts(key: tuple, table: pa.Table) -> pa.Table:
        times, values = _sorted(table)
        if values is not None:
            codes = np.unique(pa.array(values).dictionary_encode().indices.to_numpy(), return_index=True)[1]
            at = np.sort(codes)[:k]
            times, values = times[at], [values[i] for i in at]
        return pa.Table.from_pylist([dict(zip(schema.names, (*(x.as_py() for x in key), *_lists(_first(times[:k].tolist(), None if values is None else values[:k], [], k))), strict=True))], schema=schema)

    def behind(key: tuple, table: pa.Table) -> pa.Table:
        """What lies behind each block of an island: k entries a block."""
        out, ahead = [], []
        for r in sorted(table.to_pylist(), key=lambda r: -r["block"]):
            out.append(r | dict(zip(("times", "values"), _lists(ahead), strict=True)))
            ahead = _first(r["times"], r["values"] if distinct else None, ahead, k)
        return pa.Table.from_pylist(out, schema=schema)

    summary = narrow.groupBy(*block).applyInArrow(firsts, f"g long, block int, {lists}")
    carried = steps.put(summary.groupBy("g").applyInArrow(behind, f"g long, block int, {lists}"))

    def openers(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        """Times of a block's events that can open a burst, and for each the time to which the walk from there keeps within the block."""
        times, values = _sorted(left)
        more = list(zip(right["times"][0].as_py(), right["values"][0].as_py(), strict=True))
        open_at = times[_reach(times, values, more, k) - times <= window]
        after = np.searchsorted(open_at, open_at + window, side="right")
        leaves = open_at + window
        for i in range(len(open_at) - 1, -1, -1):
            if after[i] < len(open_at):
                leaves[i] = leaves[after[i]]
        g, b = (x.as_py() for x in key)
        found = [(g, b, open_at.tolist(), leaves.tolist())] if len(open_at) else []
        kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        return pa.table([pa.array(list(c), type=t) for c, t in zip(zip(*found, strict=True) if found else [()] * 4, kinds, strict=True)], names=["g", "block", "open_at", "leaves"])

    opened = steps.put(narrow.groupBy(*block).cogroup(carried.groupBy(*block)).applyInArrow(openers, "g long, block int, open_at array<long>, leaves array<long>"))
    # a row for each block: shuffled rows over size, and one more for each island
    last = opened.select(*block, F.element_at("open_at", -1).alias("last")).orderBy(*block).collect()
    ends: dict[int, tuple[list, list]] = {}
    for r in last:
        b, t = ends.setdefault(r["g"], ([], []))
        b.append(r["block"]), t.append(r["last"])
    deepest = max((len(b) for b, _ in ends.values()), default=0)

    def land(g: int, times: np.ndarray) -> np.ndarray:
        """The block of the first opener after each time; -1 if there is none."""
        blocks, lasts = (np.array(x, dtype=np.int64) for x in ends[g])
        at = np.searchsorted(lasts, times, side="right")
        return np.where(at < len(blocks), blocks[np.minimum(at, len(blocks) - 1)], -1)

    def landed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, first, leaves in zip(*(batch.column(c).to_pylist() for c in ("g", "first", "leaves")), strict=True):
                times = np.unique(np.array(leaves + [START] * first, dtype=np.int64))
                to = land(g, times)
                ok = to >= 0
                yield pa.RecordBatch.from_arrays([pa.array(np.full(ok.sum(), g)), pa.array(to[ok].astype(np.int32)), pa.array(times[ok])], names=["g", "block", "node"])

    least = {g: b[0] for g, (b, _) in ends.items()}
    roots = rows.sparkSession.createDataFrame(sorted(least.items()), "g long, block int").withColumn("first", F.lit(True))
    nodes = opened.join(F.broadcast(roots), block, "left").select("g", F.coalesce("first", F.lit(False)).alias("first"), "leaves")
    nodes = nodes.mapInArrow(landed, "g long, block int, node long").distinct()

    def follow(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        node = left["node"].to_numpy()  # none in a block that no walk may enter
        open_at, leaves = (np.array(right[c][0].as_py(), dtype=np.int64) for c in ("open_at", "leaves"))
        return left.append_column("next", pa.array(leaves[np.searchsorted(open_at, node, side="right")]))

    nodes = steps.put(nodes.groupBy(*block).cogroup(opened.groupBy(*block)).applyInArrow(follow, "g long, block int, node long, next long"))
    jumps = [nodes.select("g", "node", "next")]
    while 2 ** len(jumps) <= deepest:
        a, b = jumps[-1], jumps[-1].select("g", F.col("node").alias("next"), F.col("next").alias("far"))
        jumps.append(steps.put(a.join(b, ["g", "next"]).select("g", "node", F.col("far").alias("next"))))
    met = nodes.where(F.col("node") == START).select("g", "node")
    for jump in reversed(jumps):
        met = steps.put(met.unionByName(met.join(jump, ["g", "node"]).select("g", F.col("next").alias("node"))).distinct())
    entered = nodes.join(met, ["g", "node"], "left_semi").select(*block, "node")

    def walk(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        open_at = np.array(right["open_at"][0].as_py(), dtype=np.int64)
        starts, at = [], np.searchsorted(open_at, left["node"][0].as_py(), side="right") if len(left) else len(open_at)
        while at < len(open_at):
            starts.append(int(open_at[at]))
            at = np.searchsorted(open_at, starts[-1] + window, side="right")
        g, b = (x.as_py() for x in key)
        return pa.table({"g": pa.array([g] * len(starts), type=pa.int64()), "block": pa.array([b] * len(starts), type=pa.int32()), "t": pa.array(starts, type=pa.int64())})

    starts = steps.put(entered.groupBy(*block).cogroup(opened.groupBy(*block)).applyInArrow(walk, "g long, block int, t long"))
    # the last burst that opened before a block may still hold its first events
    before = Window.partitionBy("g").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    still = carried.select(*block).join(starts.groupBy(*block).agg(F.max("t").alias("t")), block, "left")
    still = still.select(*block, F.max("t").over(before).alias("t")).where("t is not null")
    marks = starts.unionByName(still).select(*block, "t", F.lit(None).cast("long").alias("line_no"), F.lit(None).cast("string").alias("source"), F.lit(None).cast("string").alias("value"), F.col("t").alias("start"))
    both = rows.select(*block, "t", "line_no", "source", "value", F.lit(None).cast("long").alias("start")).unionByName(marks)
    order = Window.partitionBy(*block).orderBy("t", F.col("start").isNull(), "line_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("of", F.last("start", ignorenulls=True).over(order)).where(F.col("start").isNull() & (F.col("t") <= F.col("of") + window))
    members = F.array_sort(F.collect_set("value")) if distinct else F.lit(None).cast("array<string>")
    out = both.groupBy("g", F.col("of").alias("t")).agg(
        F.min(F.struct("t", "line_no"))["line_no"].alias("line_no"), F.count("*").alias("events"), F.max("t").alias("end"), F.array_sort(F.collect_set(F.nullif("source", F.lit("")))).alias("seen"), members.alias("members"),
    )
    return out.select("g", "t", "line_no", (F.size("members") if distinct else F.col("events")).cast("int").alias("n"), "end", "seen", "members")


def greedy_bursts(df: DataFrame, keys: list[str], threshold: int, window_s: int, distinct: str | None = None, limit: int = HOT, size: int = RANGE) -> DataFrame:
    """``(*keys, timestamp, line_no, n, end, seen, members)``: non-overlapping bursts of ``threshold`` events, or distinct values of a column.

    From the first event whose window holds enough of them; the next search starts after that window. members lists the distinct
    values. Islands of over ``limit`` events are walked in blocks of about ``size`` events, none of them by one task. ``df`` has
    timestamp, line_no (which tells events of one time apart) and source.
    """
    window = window_s * SECOND
    t = F.unix_micros(F.col("timestamp").cast("timestamp"))
    value = F.col(distinct) if distinct else F.lit("")
    df = df.select(*keys, t.alias("t"), F.floor(t / max(1, window)).alias("slot"), "line_no", "source", value.alias("__value"))
    slots = df.groupBy(*keys, "slot").agg(F.count("*").alias("n"))
    slots = slots.withColumn("island", F.col("slot") - F.row_number().over(Window.partitionBy(*keys).orderBy("slot")))
    slots = slots.withColumn("n", F.sum("n").over(Window.partitionBy(*keys, "island"))).where(F.col("n") >= threshold)
    large = None
    if df.count() > limit:
        slots = cut(slots)
        islands = slots.where(F.col("n") > limit).select(*keys, "island", "n").distinct()
        islands = cut(islands.withColumn("g", F.row_number().over(Window.orderBy(*keys, "island")).cast("long")))  # at most a row for each limit events
        if total := islands.agg(F.sum("n")).first()[0]:
            wide = slots.where(F.col("n") > limit).select(*keys, "slot", "island").join(F.broadcast(islands.drop("n")), [*keys, "island"])
            flood = df.join(wide, [*keys, "slot"]).select("g", "t", "line_no", "source", F.col("__value").alias("value"))
            large = _large_bursts(flood, total, threshold, window, bool(distinct), size).join(F.broadcast(islands.drop("n", "island")), "g")
            slots = slots.where(F.col("n") <= limit)
    rows = df.join(slots.drop("n"), [*keys, "slot"]).select(*keys, "island", "t", "line_no", "source", "__value")
    rows = rows.repartition(*keys, "island").sortWithinPartitions(*keys, "island", "t", "line_no")
    schema = ", ".join([*[f"k{k} string" for k in range(len(keys))], "t long, line_no long, n int, end long, seen array<string>, members array<string>"])
    found = rows.mapInArrow(_walk(len(keys), threshold, window, bool(distinct)), schema).withColumnsRenamed({f"k{k}": c for k, c in enumerate(keys)})
    if large is not None:
        found = found.unionByName(large.select(*found.columns))
    at = lambda c: F.timestamp_micros(c).cast("timestamp_ntz")
    return found.select(*keys, at("t").alias("timestamp"), "n", "line_no", "members", at("end").alias("end"), "seen")
