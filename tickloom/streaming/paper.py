"""Paper trading of a stream: one state a symbol, moved on by book and trade rows, exits emitted as they happen."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MINUTE = 60_000_000
EVENTS = "symbol string, ts timestamp, seq long, kind string, bid double, ask double, bid_size double, ask_size double, price double, qty double"
EXITS = "symbol string, trade_id long, side string, entry_ts timestamp, entry_price double, exit_ts timestamp, exit_price double, qty double, notional double, pnl_gross double, pnl_net double, fees double, hold_minutes double, entry_reasons string, exit_reason string, equity_after double"


@dataclass
class Rules:
    balance: float = 1000.0
    return_over: float = 0.001
    imbalance_over: float = 0.1
    take_profit: float = 0.003
    stop_loss: float = 0.003
    hold_minutes: int = 30
    wait_minutes: int = 0
    share: float = 0.1
    fee_bps: float = 0.0
    long: bool = True
    short: bool = True
    #: Books as the source of these rules does: the notional isn't taken from cash on entry but is given back on exit.
    compat: bool = False


@dataclass
class Account:
    """What is kept between batches, as JSON."""

    cash: float
    mid: float | None = None
    imbalance: float | None = None
    minute: int | None = None
    last_close: float | None = None
    acted: int | None = None
    trades: int = 0
    open: dict = field(default_factory=dict)

    def equity(self, rules: Rules) -> float:
        if not self.open or self.mid is None:
            return self.cash
        sign = 1 if self.open["side"] == "long" else -1
        gain = sign * (self.mid - self.open["price"]) * self.open["qty"]
        return self.cash + self.open["notional"] + gain


def on_event(a: Account, rules: Rules, e) -> dict | None:
    """Moves the account on by one row; an exit if there is one."""
    us = e.ts.value // 1000
    if e.kind == "book":
        a.mid = (e.bid + e.ask) / 2
        if e.bid_size + e.ask_size > 0:
            a.imbalance = (e.bid_size - e.ask_size) / (e.bid_size + e.ask_size)
        return None
    minute, out = us // MINUTE, None
    if a.minute is None:
        a.minute = minute
    elif minute > a.minute:  # minutes without trades collapse; trades of an older minute change nothing
        out = on_close(a, rules, (a.minute + 1) * MINUTE)
        a.minute = minute
    if a.mid is None:
        a.mid = e.price
    return out


def on_close(a: Account, rules: Rules, us: int) -> dict | None:
    if a.mid is None:
        return None
    before, a.last_close = a.last_close, a.mid
    if before is None:
        return None
    if a.open:
        return leave(a, rules, us)
    enter(a, rules, us, a.mid / before - 1)
    return None


def enter(a: Account, rules: Rules, us: int, change: float) -> None:
    if a.acted is not None and us < a.acted + rules.wait_minutes * MINUTE or a.imbalance is None or not a.mid or a.mid <= 0:
        return
    if rules.long and change > rules.return_over and a.imbalance > rules.imbalance_over:
        side, why = "long", "ret_1m_gt_thr|obi_gt_thr"
    elif rules.short and change < -rules.return_over and a.imbalance < -rules.imbalance_over:
        side, why = "short", "ret_1m_lt_neg_thr|obi_lt_neg_thr"
    else:
        return
    notional = max(0.0, min(a.cash * rules.share, a.cash))
    if notional <= 0:
        return
    a.cash -= notional * rules.fee_bps / 1e4 + (0 if rules.compat else notional)
    a.open, a.acted = {"side": side, "us": us, "price": a.mid, "qty": notional / a.mid, "notional": notional, "why": why}, us


def leave(a: Account, rules: Rules, us: int) -> dict | None:
    p, sign = a.open, 1 if a.open["side"] == "long" else -1
    moved = sign * (a.mid - p["price"]) / p["price"]
    held = (us - p["us"]) / MINUTE
    why = "take_profit" if moved >= rules.take_profit - 1e-12 else "stop_loss" if moved <= -rules.stop_loss + 1e-12 else "time_exit" if held >= rules.hold_minutes else None
    if why is None:
        return None
    gross = sign * (a.mid - p["price"]) * p["qty"]
    last_leg, first_leg = p["qty"] * a.mid * rules.fee_bps / 1e4, p["notional"] * rules.fee_bps / 1e4
    a.cash += p["notional"] + gross - last_leg - (first_leg if rules.compat else 0)
    a.trades, a.open, a.acted = a.trades + 1, {}, us
    return {"trade_id": a.trades, "side": p["side"], "entry_ts": pd.Timestamp(p["us"], unit="us"), "entry_price": p["price"], "exit_ts": pd.Timestamp(us, unit="us"), "exit_price": a.mid, "qty": p["qty"], "notional": p["notional"], "pnl_gross": gross, "pnl_net": gross - first_leg - last_leg, "fees": first_leg + last_leg, "hold_minutes": held, "entry_reasons": p["why"], "exit_reason": why, "equity_after": a.cash}


def paper_trades(events: DataFrame, rules: Rules | None = None) -> DataFrame:
    """Exits (EXITS) of a stream of EVENTS, of kind ``book`` or ``trade``; rows of a batch go in order of (ts, seq)."""
    rules = rules or Rules()
    names = [c.split()[0] for c in EXITS.split(", ")]

    def run(key, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        a = Account(**json.loads(state.get[0])) if state.exists else Account(rules.balance)
        rows = pd.concat(list(frames)).sort_values(["ts", "seq"], kind="stable")
        out = [{"symbol": key[0], **x} for e in rows.itertuples(index=False) if (x := on_event(a, rules, e))]
        state.update((json.dumps(asdict(a)),))
        yield pd.DataFrame(out, columns=names)

    return events.groupBy("symbol").applyInPandasWithState(run, EXITS, "account string", "append", "NoTimeout")


def decoded(messages: DataFrame, venue: str) -> DataFrame:
    """Rows of EVENTS from JSON messages (value, seq) of ``binance`` (trade, bookTicker) or ``okx`` (trades, books5)."""
    number = lambda c: F.col(c).try_cast("double")
    if venue == "binance":
        # a map, as the names of the fields differ in case only
        d = messages.select("seq", F.from_json("value", "data map<string,string>")["data"].alias("d"))
        get, n = lambda k: F.col("d")[k], lambda k: F.col("d")[k].try_cast("double")
        kind = F.when(get("p").isNotNull() & get("q").isNotNull(), "trade").when(get("b").isNotNull() & get("a").isNotNull(), "book")
        rows = d.select(get("s").alias("symbol"), F.timestamp_millis(F.coalesce(get("T"), get("E")).try_cast("long")).alias("ts"), "seq", kind.alias("kind"), n("b").alias("bid"), n("a").alias("ask"), n("B").alias("bid_size"), n("A").alias("ask_size"), n("p").alias("price"), n("q").alias("qty"))
    elif venue == "okx":
        j = messages.select("seq", F.from_json("value", "arg struct<channel:string,instId:string>, data array<struct<ts:string,px:string,sz:string,bids:array<array<string>>,asks:array<array<string>>>>").alias("j")).select("seq", "j.arg.*", F.explode("j.data").alias("d"))
        top = lambda side, k: F.get(F.get(f"d.{side}", F.lit(0)), F.lit(k)).try_cast("double")
        kind = F.when(F.col("channel") == "trades", "trade").when(F.col("channel") == "books5", "book")
        rows = j.select(F.col("instId").alias("symbol"), F.timestamp_millis(F.col("d.ts").try_cast("long")).alias("ts"), "seq", kind.alias("kind"), top("bids", 0).alias("bid"), top("asks", 0).alias("ask"), top("bids", 1).alias("bid_size"), top("asks", 1).alias("ask_size"), number("d.px").alias("price"), number("d.sz").alias("qty"))
    else:
        raise ValueError(f"unknown venue {venue!r}")
    return rows.where("kind is not null and ts is not null")
