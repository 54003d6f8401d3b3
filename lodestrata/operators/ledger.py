"""Daily ledger of rebalanced books: one strategy a group, as each day's trades depend on the account before.

The account is units, marks and equity; what margin takes and the cash that is left follow from them. A day is three
steps: ``accrue`` the day's gains, ``call`` margin, ``rebalance``. Scale comes from many strategies.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

LEDGER = "position double, value double, trade double, commission double, funding double, pnl double, cash double, margin double, equity double, margin_call boolean, reduced boolean"

COLUMNS = [c.split()[0] for c in LEDGER.split(", ")]

#: Sold beyond a margin call's shortfall, and the share of affordable margin that a reduced book takes.
CALL_EXCESS, AFFORDABLE = 1.05, 0.95


@dataclass(frozen=True)
class Rules:
    """``band`` is absolute (weights, half of it on either side, never across zero, traded to its edge unless ``to_target``)
    or ``relative`` to the target and then traded to the target. Unless ``compound``, sizes follow at most ``cash``."""

    cash: float = 10_000.0
    margin: float = 0.05
    fee: float = 0.0
    band: float = 0.0
    relative: bool = False
    to_target: bool = False
    compound: bool = False
    least: float = 0.0
    lots: dict[str, float] = field(default_factory=dict)


@dataclass(frozen=True)
class Account:
    units: np.ndarray
    marks: np.ndarray
    equity: float


def accrue(a: Account, price: np.ndarray, rate: np.ndarray) -> tuple[Account, np.ndarray, np.ndarray]:
    """Marks yesterday's units at today's prices (a missing one stays at its mark); funding is paid on today's value."""
    marks = np.where(np.isnan(price), a.marks, price)
    value = np.where(a.units == 0, 0.0, a.units * marks)
    funding = value * np.nan_to_num(rate)
    pnl = value - np.where(a.units == 0, 0.0, a.units * a.marks) + funding
    return Account(a.units, marks, a.equity + pnl.sum()), pnl, funding


def gross(units: np.ndarray, marks: np.ndarray) -> float:
    return float(np.abs(np.where(units == 0, 0.0, units * marks)).sum())


def call(a: Account, r: Rules) -> tuple[Account, np.ndarray, float]:
    """Equity below the margin of what is held: a share of everything is sold, somewhat more than the shortfall's."""
    need = r.margin * gross(a.units, a.marks)
    if need <= 0 or a.equity >= need:
        return a, np.zeros_like(a.units), 0.0
    sold = a.units * min(1.0, CALL_EXCESS * (need - a.equity) / need)
    fee = r.fee * gross(sold, a.marks)
    return replace(a, units=a.units - sold, equity=a.equity - fee), sold, fee


def wanted(units: np.ndarray, marks: np.ndarray, weight: np.ndarray, capital: float, r: Rules) -> np.ndarray:
    """Units after the band; a target of zero or none closes, and so does a price that isn't positive."""
    w = np.nan_to_num(weight)
    ok = (w != 0) & (marks > 0)
    unit = np.divide(capital, marks, out=np.zeros_like(marks), where=ok)
    held = np.divide(units, unit, out=np.zeros_like(units), where=unit != 0)
    if r.relative:
        low = high = w
        stays = np.abs(held - w) < r.band * np.abs(w)
    else:
        low, high = w - r.band / 2, w + r.band / 2
        low, high = np.where(w > 0, np.maximum(low, 0), low), np.where(w < 0, np.minimum(high, 0), high)
        stays = (held >= low) & (held <= high)
    goal = w if r.relative or r.to_target else np.clip(held, low, high)
    return np.where(ok, np.where(stays, units, goal * unit), 0.0)


def orderly(units: np.ndarray, goal: np.ndarray, price: np.ndarray, lot: np.ndarray, r: Rules) -> np.ndarray:
    """Whole lots towards zero, and no order below the least value unless it closes."""
    if r.lots:
        whole = np.trunc(np.round(np.divide(goal, lot, out=np.zeros_like(goal), where=lot > 0), 8)) * lot
        goal = np.where(lot > 0, whole, goal)
    small = np.abs((goal - units) * np.nan_to_num(price)) < r.least
    return np.where(small & (goal != 0), units, goal)


def rebalance(a: Account, weight: np.ndarray, fill: np.ndarray, gone: np.ndarray, lot: np.ndarray, need: float, r: Rules) -> tuple[Account, np.ndarray, np.ndarray, bool]:
    """Trades to the wanted units; if cash would end below ``need``, the book shrinks to what margin affords."""
    capital = a.equity if r.compound else min(r.cash, a.equity)
    goal = np.zeros_like(a.units) if capital <= 0 else np.where(gone, 0.0, wanted(a.units, a.marks, weight, capital, r))
    goal = orderly(a.units, goal, fill, lot, r)

    def settle(goal):
        trade = goal - a.units
        moved = trade != 0
        fees = r.fee * np.abs(np.where(moved, trade * fill, 0.0))
        return trade, fees, a.equity - fees.sum() + np.where(moved, trade * (a.marks - fill), 0.0).sum()

    trade, fees, equity = settle(goal)
    size = gross(goal, a.marks)
    reduced = size > 0 and equity - r.margin * size < need
    if reduced:
        goal = orderly(a.units, goal * (max(0.0, AFFORDABLE * equity / r.margin) / size), fill, lot, r)
        trade, fees, equity = settle(goal)
    return Account(goal, a.marks, equity), trade, fees, reduced


def run_ledger(prices: pd.DataFrame, weights: pd.DataFrame, rates: pd.DataFrame, fills: pd.DataFrame, r: Rules) -> pd.DataFrame:
    """Long ledger of one strategy; frames of dates by assets, alike in shape."""
    names = list(prices.columns)
    lot = np.array([float(r.lots.get(n, 0.0)) for n in names])
    if ((weights.fillna(0) != 0) & prices.isna()).to_numpy().any():
        raise ValueError("a target without a price")
    account, out = Account(np.zeros(len(names)), np.full(len(names), np.nan), r.cash), []
    for date, price, weight, rate, fill in zip(prices.index, *(f.to_numpy(float) for f in (prices, weights, rates, fills)), strict=True):
        gone = np.isnan(price) & (account.units != 0)
        account, pnl, funding = accrue(account, price, rate)
        account, sold, _ = call(account, r)
        need = r.margin * gross(account.units, account.marks)
        fill = np.where(np.isnan(fill) | gone, account.marks, fill)  # a price that ended leaves at the last one
        account, trade, fees, reduced = rebalance(account, weight, fill, gone, lot, need, r)
        fees = fees + r.fee * np.abs(np.where(sold != 0, sold * account.marks, 0.0))
        margin = r.margin * gross(account.units, account.marks)
        value = np.where(account.units == 0, 0.0, account.units * account.marks)
        out.append(np.broadcast_arrays(account.units, value, trade - sold, fees, funding, pnl, account.equity - margin, margin, account.equity, (sold != 0).any(), reduced))
    columns = [np.concatenate(c) for c in zip(*out, strict=True)]
    return pd.DataFrame({"date": np.repeat(prices.index, len(names)), "asset": np.tile(names, len(prices)), **dict(zip(COLUMNS, columns, strict=True))})


def backtest(panel: DataFrame, key: str, rules: Rules | None = None, fill: str = "close") -> DataFrame:
    """``key, date, asset`` and the ledger of ``panel`` (key, date, asset, close, weight, funding).

    Equity changes by pnl, less commissions (those of margin calls too), less what fills at ``fill`` lose against the close.
    A price that ends closes its position at the last one; a target without a price is an error. Repeated rows of a date and
    asset are one too.
    """
    rules = rules or Rules()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        wide = (pdf.pivot(index="date", columns="asset", values=v).sort_index() for v in ("close", "weight", "funding", "_fill"))
        return run_ledger(*wide, rules).assign(**{key: pdf[key].iloc[0]})[names]

    names = [key, "date", "asset", *COLUMNS]
    rows = panel.select(key, "date", "asset", "close", "weight", "funding", panel[fill].alias("_fill"))
    return rows.groupBy(key).applyInPandas(run, f"{key} {dict(panel.dtypes)[key]}, date date, asset string, {LEDGER}")
