"""Linear-Gaussian state-space models over many series of any length.

A filter's step maps the state's distribution after one row to that after the next, and such maps compose: a row is an element
(A, b, C, eta, J), the state given the one before has mean A x + b and covariance C, and (eta, J) is what the row's
observation says about the state before. A stretch's rows compose to one element, a key's stretches to what enters each, so a
long series is filtered by many tasks at once and short ones by the batch. Elements are stacks of small matrices in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scan

Element = tuple[np.ndarray, ...]


@dataclass(frozen=True)
class Model:
    """x' = transition x + noise of ``state_cov``, y = observation x + noise of ``obs_cov``; the prior is of a key's first row."""

    transition: np.ndarray
    observation: np.ndarray
    state_cov: np.ndarray
    obs_cov: np.ndarray
    initial_state: np.ndarray
    initial_cov: np.ndarray

    def __post_init__(self):
        for name in self.__dataclass_fields__:
            v = np.asarray(getattr(self, name), float)
            object.__setattr__(self, name, v.reshape(-1) if name == "initial_state" else np.atleast_2d(v))
        n, k = len(self.transition), len(self.observation)
        shapes = {"transition": (n, n), "observation": (k, n), "state_cov": (n, n), "obs_cov": (k, k), "initial_state": (n,), "initial_cov": (n, n)}
        for name, shape in shapes.items():
            if getattr(self, name).shape != shape:
                raise ValueError(f"{name} has the shape {getattr(self, name).shape}, not {shape}")


def _t(x: np.ndarray) -> np.ndarray:
    return np.swapaxes(x, -1, -2)


def _apply(m: np.ndarray, v: np.ndarray) -> np.ndarray:
    return (m @ v[..., None])[..., 0]


def _seen(model: Model, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Observations, their matrices and noise: missing ones see nothing and have noise of their own."""
    m = np.isfinite(y)
    noise = model.obs_cov * (m[:, :, None] & m[:, None, :]) + np.eye(y.shape[1]) * ~m[:, :, None]
    return np.where(m, y, 0.0), model.observation * m[:, :, None], noise


def _updated(model: Model, mean: np.ndarray, cov: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Predicted states after seeing ``y``."""
    v, h, noise = _seen(model, y)
    gain = _t(np.linalg.solve(h @ cov @ _t(h) + noise, h @ cov))
    return mean + _apply(gain, v - _apply(h, mean)), cov - gain @ h @ cov


def _elements(model: Model, y: np.ndarray) -> Element:
    v, h, noise = _seen(model, y)
    f, q = model.transition, model.state_cov
    s = h @ q @ _t(h) + noise
    gain = _t(np.linalg.solve(s, h @ q))
    back = _t(np.linalg.solve(s, h @ f))
    rest = np.eye(len(f)) - gain @ h
    return rest @ f, _apply(gain, v), rest @ q, _apply(back, v), back @ h @ f


def _known(mean: np.ndarray, cov: np.ndarray) -> Element:
    """States that don't depend on what was before."""
    return np.zeros_like(cov), mean, cov, np.zeros_like(mean), np.zeros_like(cov)


def _then(one: Element, two: Element) -> Element:
    """``one``, then ``two``."""
    a1, b1, c1, e1, j1 = one
    a2, b2, c2, e2, j2 = two
    inner = np.linalg.inv(np.eye(a1.shape[-1]) + c1 @ j2)
    d, back = a2 @ inner, _t(a1) @ _t(inner)
    c, j = d @ c1 @ _t(a2) + c2, back @ j2 @ a1 + j1
    return d @ a1, _apply(d, b1 + _apply(c1, e2)) + b2, (c + _t(c)) / 2, _apply(back, e2 - _apply(j2, b1)) + e1, (j + _t(j)) / 2


def _pick(e: Element, i) -> Element:
    return tuple(x[i] for x in e)


def _prefixes(e: Element, first: np.ndarray) -> Element:
    """Each row's element composed with those before it in its segment, by doubling."""
    n = len(first)
    reach = np.arange(n) - np.maximum.accumulate(np.where(first, np.arange(n), 0))
    e, step = tuple(x.copy() for x in e), 1
    while step < n and (go := np.flatnonzero(reach >= step)).size:
        for x, v in zip(e, _then(_pick(e, go - step), _pick(e, go)), strict=True):
            x[go] = v
        step *= 2
    return e


def _wide(e: Element) -> np.ndarray:
    return np.concatenate([x.reshape(len(x), -1) for x in e], axis=1)


def _narrow(flat: np.ndarray, n: int) -> Element:
    at = np.cumsum([n * n, n, n * n, n])
    parts = np.split(np.asarray(flat, float).reshape(len(flat), -1), at, axis=1)
    return tuple(p.reshape(-1, n) if p.shape[1] == n and i in (1, 3) else p.reshape(-1, n, n) for i, p in enumerate(parts))


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _lists(values: np.ndarray) -> pa.Array:
    values = values.reshape(len(values), -1)
    ends = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.reshape(-1)))


def _unlist(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places that hold a list, and the lists, stacked."""
    there = np.flatnonzero(~column.is_null().to_numpy(zero_copy_only=False))
    return there, np.array(column.take(pa.array(there)).to_pylist(), float)


def kalman_filter(df: DataFrame, keys: list[str], order: list[str], values: list[str], model: Model, tasks: int | None = None) -> DataFrame:
    """``df`` with ``state`` and ``state_cov``: mean and covariance (row by row) of the state after the row's observation.

    ``values`` are the columns observed, numbers; null and NaN ones say nothing, the others of the row still count. Rows of a
    key come in ``order``, rows that tie in an order that is fixed once; null keys are one key. Columns of ``df`` named
    ``state`` and ``state_cov`` are replaced.
    """
    if len(values) != len(model.observation):
        raise ValueError(f"{len(values)} columns for {len(model.observation)} observations")
    n, names = len(model.transition), [f"_y{i}" for i in range(len(values))]
    df = df.withColumns({y: F.col(c).cast("double") for y, c in zip(names, values, strict=True)}).drop("state", "state_cov")
    rows = scan.stretches(df, keys, order, tasks)
    kinds, kept = dict(rows.dtypes), [c for c in df.columns if c not in names]
    listed = "".join(f"`{k}` {kinds[k]}, " for k in keys)

    def observed(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([_column(batch, y).to_numpy(zero_copy_only=False).astype(float) for y in names], axis=1)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """``batch, first``: whether rows begin a key or a stretch."""
        last: tuple | None = None
        for batch in batches:
            if batch.num_rows:
                head, tail = (tuple(_column(batch, k)[i].as_py() for k in [*keys, "_part"]) for i in (0, batch.num_rows - 1))
                yield batch, np.concatenate([[head != last], ~scan._same_as_above(batch, [*keys, "_part"])])
                last = tail

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for the first and last key of a stretch, as only they go on: its first observation, the element of its other rows."""
        held, carry, before = None, None, -1

        def edges(made: pa.RecordBatch, after: int) -> pa.RecordBatch:
            p = np.concatenate([[before], _column(made, "_part").to_numpy(), [after]])
            return made.filter(pa.array((p[1:-1] != p[:-2]) | (p[1:-1] != p[2:])))

        for batch, first in segments(batches):
            y = observed(batch)
            e = _elements(model, y)
            for x, still in zip(e, (np.eye(n), 0.0, 0.0, 0.0, 0.0), strict=True):
                x[first] = still  # a stretch's first row is kept apart, as it may be the key's first
            if not first[0]:
                for x, v in zip(e, _then(_pick(carry[0], [0]), _pick(e, [0])), strict=True):
                    x[0] = v[0]
            e = _prefixes(e, first)
            begins = y[np.maximum.accumulate(np.where(first, np.arange(len(y)), 0))]
            if not first[0]:
                begins[: np.argmax(first) if first.any() else len(first)] = carry[1]
            carry = _pick(e, [-1]), begins[-1]
            ends = np.flatnonzero(np.append(first[1:], True))
            out = [_column(batch, k).take(pa.array(ends)) for k in [*keys, "_part"]]
            made = pa.RecordBatch.from_arrays([*out, _lists(begins[ends]), _lists(_wide(_pick(e, ends)))], names=[*keys, "_part", "_begin", "_rest"])
            if held is not None:
                held = held.slice(0, held.num_rows - (not first[0]))  # its last key goes on here
                if held.num_rows:
                    yield edges(held, _column(made, "_part")[0].as_py())
                    before = _column(held, "_part")[-1].as_py()
            held = made
        if held is not None:
            yield edges(held, -1)

    def entering(pdf: pd.DataFrame) -> pd.DataFrame:
        """The state that enters each stretch of one key but its first; a row for a stretch."""
        pdf = pdf.sort_values("_part")
        out, state = [], None
        for begin, rest in zip(pdf["_begin"], pdf["_rest"], strict=True):
            y = np.asarray(begin, float)[None]
            out.append(None if state is None else np.concatenate([x.reshape(-1) for x in state[1:3]]))
            if state is None:
                state = _known(*_updated(model, model.initial_state[None], model.initial_cov[None], y))
            else:
                state = _then(state, _elements(model, y))
            state = _then(state, _narrow(np.asarray(rest, float)[None], n))
        return pdf[[*keys, "_part"]].assign(_enter=out)

    by_part = lambda x: x.repartition("_part").sortWithinPartitions("_part", "_at")
    held = by_part(rows.select(*keys, "_part", *names, "_at")).mapInArrow(summed, f"{listed}_part int, _begin array<double>, _rest array<double>")
    # only keys that go on from stretch to stretch: two a stretch at most
    held = held.withColumn("_n", F.count("*").over(Window.partitionBy(*keys))).where("_n > 1").drop("_n")
    enters = held.groupBy(*keys).applyInPandas(entering, f"{listed}_part int, _enter array<double>")
    enters = enters.withColumnsRenamed({k: f"_key{j}" for j, k in enumerate(keys)} | {"_part": "_p"})
    same = F.col("_part") == F.col("_p")
    for j, k in enumerate(keys):
        same &= F.col(k).eqNullSafe(F.col(f"_key{j}"))
    ready = rows.join(F.broadcast(enters), same, "left").drop("_p", *[f"_key{j}" for j in range(len(keys))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: Element | None = None
        for batch, first in segments(batches):
            y = observed(batch)
            e = _elements(model, y)
            begins = np.flatnonzero(first)
            if begins.size:
                prior = (np.repeat(x[None], begins.size, axis=0) for x in (model.initial_state, model.initial_cov))
                states = [x.copy() for x in _updated(model, *prior, y[begins])]
                there, enter = _unlist(_column(batch, "_enter").take(pa.array(begins)))
                if there.size:
                    came = _known(enter[:, :n], enter[:, n:].reshape(-1, n, n))
                    for x, v in zip(states, _then(came, _pick(e, begins[there]))[1:3], strict=True):
                        x[there] = v
                for x, v in zip(e, _known(*states), strict=True):
                    x[begins] = v
            if not first[0]:
                for x, v in zip(e, _then(carry, _pick(e, [0])), strict=True):
                    x[0] = v[0]
            e = _prefixes(e, first)
            carry = _pick(e, [-1])
            yield pa.RecordBatch.from_arrays([*[_column(batch, c) for c in kept], _lists(e[1]), _lists(e[2])], names=[*kept, "state", "state_cov"])

    schema = "".join(f"`{c}` {kinds[c]}, " for c in kept) + "state array<double>, state_cov array<double>"
    return by_part(ready).mapInArrow(run, schema)


def steady_gain(model: Model, rounds: int = 10_000, tolerance: float = 1e-12) -> np.ndarray:
    """The gain that the filter's gains tend to: the covariance recursion from the prior until it stays within ``tolerance``."""
    none = np.zeros((1, len(model.observation)))
    f, h, p = model.transition, model.observation, model.initial_cov
    for _ in range(rounds):
        _, after = _updated(model, np.zeros((1, len(f))), p[None], none)
        new = f @ after[0] @ f.T + model.state_cov
        done = np.abs(new - p).max() < tolerance
        p = new
        if done:
            break
    return np.linalg.solve(h @ p @ h.T + model.obs_cov, h @ p).T
