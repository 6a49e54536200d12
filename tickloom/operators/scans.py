"""Scans whose state depends on all rows before, cut into parts so that one symbol's history is spread over tasks.

Exponential means compose: a block of rows is an affine map of the state before it. Trades that may not overlap, and cooldowns, are
paths along pointers, followed within blocks and doubled between them. CUSUM sums forget: a run from nothing and one from the
true state are soon the same, so blocks run at once and only the part before that is done again.
"""

from __future__ import annotations

from math import ceil, log1p

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stage import staged
from ..functions.timeops import chunk_of, from_micros, micros, numbered_by_day, ordered, upto_now
from .joins import asof

#: Rows of a block.
BLOCK = 1 << 16


def ewm(rows: DataFrame, value: str, span: int, by: str = "symbol", order: str = "bar", most_rows: int = BLOCK) -> DataFrame:
    """(key, order, ewm_mean, ewm_std): exponentially weighted without adjustment; the deviation is unbiased, NULL at first.

    As in pandas with adjust=False: a missing value repeats the last result and ages what came before it; before any value the
    result is NULL. ``order`` is a timestamp, distinct within a key.

    A row's weights within its block are sums over a window; what came before the block is a map of blocks: (decay, weight, mean,
    variance, squared weights), composed over as many blocks as a double can tell from nothing. No Python, and no window
    holds more than a block's rows, or a row for each block.
    """
    a = 2 / (span + 1)
    decay = -log1p(-a) if a < 1 else 100.0
    size = max(1, min(most_rows, int(60 / decay)))
    back = 6 + ceil(180 / (decay * size))
    slim = rows.select(by, order, F.col(value).cast("double").alias("_x")).withColumn("_x", F.when(~F.isnan("_x"), F.col("_x")))
    placed = staged(numbered_by_day(slim, "_place", by, order, order).withColumn("_block", F.floor(F.col("_place") / size)), "placed")
    seen = F.when(F.col("_x").isNotNull(), F.col("_place"))
    last = placed.groupBy(by, "_block").agg(F.max(seen).alias("_last"))
    before = last.select(by, "_block", F.last("_last", ignorenulls=True).over(ordered(by, "_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_known"))
    inside = ordered([by, "_block"], "_place")
    d = placed.join(before, [by, "_block"], "left")
    d = d.withColumn("_prev", F.coalesce(F.last(seen, ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("_known")))
    old = F.pow(F.lit(1 - a), F.col("_place") - F.col("_prev"))
    known, first = F.col("_x").isNotNull(), F.col("_prev").isNull()
    # what the row leaves of the state before it (as a logarithm, less than nothing), and what it adds
    d = d.withColumn("_fade", F.when(known & ~first, (F.col("_place") - F.col("_prev")) * decay + F.log(old + a)).otherwise(0.0)).withColumn("_new", F.when(known, F.when(first, 1.0).otherwise(a / (old + a))))
    d = d.withColumn("_head", known & (F.count("_x").over(inside.rowsBetween(Window.unboundedPreceding, -1)) == 0))
    w = upto_now(inside)
    d = d.withColumn("_base", F.first("_x", ignorenulls=True).over(w)).withColumn("_in", F.coalesce(F.sum(F.when(F.col("_head"), F.col("_fade"))).over(w), F.lit(0.0))).withColumn("_e", F.sum(F.when(F.col("_head"), 0.0).otherwise(F.col("_fade"))).over(w))
    grown, off = F.exp("_e"), F.col("_x") - F.col("_base")
    term = lambda x, k=1: F.exp(-k * F.col("_e")) * F.coalesce(F.sum(x * (grown if k == 1 else grown * grown)).over(w), F.lit(0.0))
    d = d.withColumns({"_w": term(F.col("_new")), "_m": term(F.col("_new") * off), "_q": term(F.col("_new") * off * off), "_s": term(F.col("_new") * F.col("_new"), 2), "_d": F.exp(-(F.col("_e") + F.col("_in")))})
    own = F.struct(F.col("_d").alias("d"), F.col("_w").alias("w"), (F.col("_base") + F.col("_m") / F.col("_w")).alias("m"), F.greatest(F.lit(0.0), F.col("_q") / F.col("_w") - F.pow(F.col("_m") / F.col("_w"), 2)).alias("v"), F.col("_s").alias("s"))
    maps = d.where(F.col("_w") > 0).groupBy(by, "_block").agg(F.max_by(own, "_place").alias("_map"))
    carried = maps.select(by, "_block", "_map").withColumn("_maps", F.collect_list("_map").over(ordered(by, "_block").rowsBetween(-back + 1, 0))).select(by, "_block", F.aggregate("_maps", _nothing(), _after).alias("_state"))
    state = F.last("_state", ignorenulls=True).over(ordered(by, "_block").rowsBetween(Window.unboundedPreceding, -1))
    carry = last.select(by, "_block").join(carried, [by, "_block"], "left").select(by, "_block", state.alias("_carry"))
    both = _after(F.coalesce("_carry", _nothing()), F.when(F.col("_w") > 0, own).otherwise(F.struct(F.lit(1.0).alias("d"), F.lit(0.0).alias("w"), F.lit(0.0).alias("m"), F.lit(0.0).alias("v"), F.lit(0.0).alias("s"))))
    out = d.join(carry, [by, "_block"], "left").withColumn("_now", both)
    some, left = F.col("_now.w") > 0, 1 - F.col("_now.s")
    return out.select(by, order, F.when(some, F.col("_now.m")).alias("ewm_mean"), F.when(some & (left > 0), F.sqrt(F.col("_now.v") / left)).alias("ewm_std"))


def _nothing() -> Column:
    zero = F.lit(0.0)
    return F.struct(zero.alias("w"), zero.alias("m"), zero.alias("v"), zero.alias("s"))


def _after(state: Column, block: Column) -> Column:
    """The state (weight, mean, variance, squared weights) after a block's map of it."""
    old = state["w"] * block["d"]
    w = old + block["w"]
    share = lambda x, y: F.coalesce((old * x + block["w"] * y) / F.nullif(w, F.lit(0.0)), F.lit(0.0))
    m = share(state["m"], block["m"])
    v = share(state["v"] + (state["m"] - m) * (state["m"] - m), block["v"] + (block["m"] - m) * (block["m"] - m))
    return F.struct(w.alias("w"), m.alias("m"), v.alias("v"), (state["s"] * block["d"] * block["d"] + block["s"]).alias("s"))


def _following(placed: DataFrame, by: str, at: Column, wanted: Column, chunk_seconds: int) -> DataFrame:
    """(key, _place, _next): the place of the first row, after each, whose time ``at`` (microseconds) is ``wanted`` or later."""
    rows = placed.select(by, "_place", at.alias("_at"), wanted.alias("_want"))
    left = rows.where("_want is not null").select(by, "_place", from_micros(F.col("_want") - 1).alias("_upto"))
    right = rows.select(F.col(by), from_micros(F.col("_at")).alias("_ts"), F.col("_place").alias("_p"))
    found = asof(left, right, by, "_upto", "_ts", "_p", chunk_seconds=chunk_seconds)
    return found.select(by, "_place", F.greatest(F.coalesce(F.col("_p"), F.lit(-1)) + 1, F.col("_place") + 1).alias("_next"))


def reached(links: DataFrame, by: str, block_rows: int = BLOCK) -> DataFrame:
    """(key, _place) of the places on each key's path from place 0 along ``_next``, which is always greater, or past the end.

    Each block of places finds where a path that comes in at each of its places goes out; between blocks, pointers from where
    paths come in are doubled until all of the first one's path is known; then each block walks from its one entrance.
    """
    kind = links.schema[by].dataType.simpleString()
    rows = links.select(by, "_place", "_next", F.floor(F.col("_place") / block_rows).alias("_block"))

    def through(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_place")
        start, to = int(f["_place"].iloc[0]), f["_next"].tolist()
        for i in range(len(to) - 1, -1, -1):
            if to[i] - start < len(to):
                to[i] = to[int(to[i]) - start]
        return pd.DataFrame({by: f[by], "_place": f["_place"], "_out": to})

    def walk(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("_place")
        start, to, at = int(f["_place"].iloc[0]), f["_next"].tolist(), int(f["_enter"].iloc[0])
        on = []
        while at - start < len(to):
            on.append(at)
            at = int(to[at - start])
        return pd.DataFrame({by: f[by].iloc[0], "_place": on})

    first = rows.where("_place = 0").select(by, F.col("_place").alias("_enter"))
    last = rows.agg(F.max("_block")).first()[0]
    if last:
        out = staged(rows.groupBy(by, "_block").applyInPandas(through, f"{by} {kind}, _place long, _out long"), "paths")
        doors = out.select(by, F.col("_out").alias("_place")).union(first.select(by, "_enter")).distinct()
        doors = staged(doors.join(out, [by, "_place"]), "doors")
        jump = staged(doors.join(doors.select(by, F.col("_place").alias("_out")), [by, "_out"], "left_semi").select(by, "_place", "_out"), "doors")  # none leads past the end
        path, span = first, 1
        while span <= last:  # a path goes through no more doors than there are blocks
            far = jump.select(by, F.col("_place").alias("_enter"), F.col("_out").alias("_to"))
            path = staged(path.union(path.join(far, [by, "_enter"]).select(by, "_to")).distinct(), "path")
            jump = staged(jump.join(jump.select(by, F.col("_place").alias("_out"), F.col("_out").alias("_to")), [by, "_out"]).select(by, "_place", F.col("_to").alias("_out")), "doors")
            span *= 2
        first = path
    enter = first.withColumn("_block", F.floor(F.col("_enter") / block_rows))
    return rows.join(enter, [by, "_block"]).groupBy(by, "_block").applyInPandas(walk, f"{by} {kind}, _place long")


def cooldown(candidates: DataFrame, rows_apart: int, by: str = "symbol", position: str = "position", block_rows: int = BLOCK) -> DataFrame:
    """Candidates taken greedily in order: each at least ``rows_apart`` positions after the last that was taken.

    Positions are whole numbers, distinct within a key.
    """
    at = F.col(position).cast("long")
    placed = staged(numbered_by_day(candidates.withColumn("_at", from_micros(at)), "_place", by, "_at", position, 1).drop("_at"), "candidates")
    links = _following(placed, by, at, at + rows_apart, 1)
    return placed.join(reached(links, by, block_rows), [by, "_place"]).select(*candidates.columns)


def nonoverlapping(trades: DataFrame, by: str = "symbol", start: str = "entry_ts", end: str = "exit_ts", tie: str = "event_id", block_rows: int = BLOCK) -> DataFrame:
    """Trades taken greedily in order of entry: none enters before the one last taken has left. After one that never leaves (its
    end is NULL) none is taken."""
    placed = staged(numbered_by_day(trades, "_place", by, start, tie), "trades")
    links = _following(placed, by, micros(F.col(start)), micros(F.col(end)), 86_400)
    ends = placed.where(F.col(end).isNull()).select(by, "_place", F.lit((1 << 62)).cast("long").alias("_next"))
    return placed.join(reached(links.unionByName(ends), by, block_rows), [by, "_place"]).select(*trades.columns)


def cusum(rows: DataFrame, k: float, by: str = "symbol", order: str = "bar", change: str = "ret", sigma: str = "sigma", block_seconds: int = 86_400) -> DataFrame:
    """Symmetric CUSUM events: (key, t0, side, threshold, sigma). Both sums start anew after an event.

    Rows without a change are passed over, and one without a sigma is no event. Each block of ``block_seconds`` runs from zero;
    one that another state comes into runs again beside that run until the two agree, and only if they never do is what comes
    out of it another, for the next block to look at. Rounds end when no block's state is news to the next.
    """
    kind, at = rows.schema[by].dataType.simpleString(), rows.schema[order].dataType.simpleString()
    slim = staged(rows.select(by, order, F.col(change).cast("double").alias("_r"), F.col(sigma).cast("double").alias("_s"), chunk_of(F.col(order), block_seconds).alias("_block")).where("_r is not null and not isnan(_r)"), "changes")
    cells = f"{by} {kind}, _block long, _event boolean, t0 {at}, side int, threshold double, sigma double, _up double, _down double"

    def run(f: pd.DataFrame) -> pd.DataFrame:
        """Events and, last, the state that goes out, and until when the block went another way than from zero (``t0``; NULL if
        it never came back, or came from zero)."""
        f = f.sort_values(order, kind="stable")
        again = "_up" in f.columns
        up, down = (float(f["_up"].iloc[0]), float(f["_down"].iloc[0])) if again else (0.0, 0.0)
        zero_up = zero_down = 0.0
        out, same = [], None
        for t, r, s in zip(f[order], f["_r"].tolist(), f["_s"].tolist(), strict=True):
            h = k * s if s is not None and s == s else float("inf")
            up, down = max(0.0, up + r), min(0.0, down + r)
            if up > h or down < -h:
                out.append((True, t, 1 if up > h else -1, h, s, None, None))
                up = down = 0.0
            if again:
                zero_up, zero_down = max(0.0, zero_up + r), min(0.0, zero_down + r)
                if zero_up > h or zero_down < -h:
                    zero_up = zero_down = 0.0
                if up == zero_up and down == zero_down:
                    same = t
                    break
        out.append((False, same, None, None, None, None if same is not None else up, None if same is not None else down))
        told = pd.DataFrame(out, columns=["_event", "t0", "side", "threshold", "sigma", "_up", "_down"]).astype({"side": "Int32"})
        told.insert(0, "_block", f["_block"].iloc[0])
        told.insert(0, by, f[by].iloc[0])
        return told

    first = staged(slim.groupBy(by, "_block").applyInPandas(run, cells), "runs")
    base = first.where("not _event").select(by, "_block", F.col("_up").alias("_zero_up"), F.col("_down").alias("_zero_down"))
    ends = base.select("*", F.lit(0.0).alias("_up"), F.lit(0.0).alias("_down"), F.col("_zero_up").alias("_out_up"), F.col("_zero_down").alias("_out_down"), F.lit(0).alias("_round"))
    redone, turn = None, 0
    while True:
        w = ordered(by, "_block")
        come = ends.withColumns({c: F.coalesce(F.lag(o).over(w), F.lit(0.0)) for c, o in (("_in_up", "_out_up"), ("_in_down", "_out_down"))})
        come = staged(come, "ends")
        news = come.where("_in_up <> _up or _in_down <> _down").select(by, "_block", F.col("_in_up").alias("_up"), F.col("_in_down").alias("_down"))
        if news.isEmpty():
            break
        turn += 1
        again = staged(slim.join(news, [by, "_block"]).groupBy(by, "_block").applyInPandas(run, cells).withColumn("_round", F.lit(turn)), "runs")
        redone = again if redone is None else redone.unionByName(again)
        out = again.where("not _event").select(by, "_block", F.lit(True).alias("_new"), F.col("_up").alias("_new_up"), F.col("_down").alias("_new_down"))
        j = come.join(out, [by, "_block"], "left")
        pick = lambda new, old: F.when(F.col("_new"), new).otherwise(F.col(old))
        ends = j.select(by, "_block", "_zero_up", "_zero_down", pick(F.col("_in_up"), "_up").alias("_up"), pick(F.col("_in_down"), "_down").alias("_down"), pick(F.coalesce("_new_up", "_zero_up"), "_out_up").alias("_out_up"), pick(F.coalesce("_new_down", "_zero_down"), "_out_down").alias("_out_down"), pick(F.lit(turn), "_round").alias("_round"))
    events = [by, "t0", "side", "threshold", "sigma"]
    if redone is None:
        return first.where("_event").select(*events)
    valid = redone.join(come.where("_round > 0").select(by, "_block", "_round"), [by, "_block", "_round"])
    until = valid.where("not _event").select(by, "_block", F.lit(True).alias("_again"), F.col("t0").alias("_until"))
    kept = first.where("_event").join(until, [by, "_block"], "left").where("_again is null or t0 > _until")
    return kept.select(*events).unionByName(valid.where("_event").select(*events))
