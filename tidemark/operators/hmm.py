"""Hidden Markov recursions over ordered rows: filter, smoother, Viterbi, also with time-varying transitions.

Input: one row per step with ``t_idx``, ``ll`` (array of log likelihoods per state) and the session keys.
With ``trans`` a column of row-major transition matrices is used: the one at step t leads from t to t + 1.

State bins of discrete states have a transition that is the product of a discrete matrix, which may change in
time, and fixed blocks between the bins of each two states (``Blocks``).  Rows then carry the discrete
matrix only, blocks are applied one by one, and those with equal rows (jumps to anywhere) as one number.

A recursion is sequential in time, but its steps are linear maps (max-plus maps for Viterbi), and those
compose.  So a session is cut into chunks of time; each chunk becomes one S x S operator (first pass, all
chunks in parallel); the operators of a session are folded to give each chunk its incoming messages (one row
a chunk); and each chunk is then run with its messages (second pass, parallel).  No task holds more than one
chunk, or the operators of one session.  For more than SCAN_STATES states an S x S operator costs more than it
saves: the messages are then carried along a session's ordered rows, once from either end, by a task that holds
a record batch and one vector, and its chunks (of at most CELLS values) are again run in parallel.  Viterbi
carries the scores from the end; each chunk then tells where a path leaves it for each state of entry.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

CHUNK = 4096
SCAN_STATES = 32
#: Steps x states of a chunk above SCAN_STATES.
CELLS = 4_000_000
EPS = 1e-15


class Blocks:
    """Transitions between state bins: ``discrete[a, b]`` times the block of ``continuous`` from the bins of a to those of b.

    ``states`` tells the discrete state of each bin; ``discrete`` is given here or, by time, in the rows.
    """

    def __init__(self, continuous: np.ndarray, states: Sequence[int], discrete: np.ndarray | None = None):
        self.states, self.continuous = np.asarray(states), np.asarray(continuous, float)
        self.names = np.unique(self.states)
        if not np.array_equal(self.states, np.sort(self.states)) or not np.array_equal(self.names, np.arange(len(self.names))):
            raise ValueError("state bins must lie in the order of their states, 0 to n - 1")
        ends = np.searchsorted(self.states, np.arange(len(self.names) + 1))
        self.spans = [slice(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        self.discrete = None if discrete is None else np.asarray(discrete, float)
        self.parts = {}
        for a, i in enumerate(self.spans):
            for b, j in enumerate(self.spans):
                part = self.continuous[i, j]
                self.parts[a, b] = part[0] if len(part) and (part == part[0]).all() else part

    def step(self, discrete: np.ndarray | None = None) -> "Step":
        return Step(self, self.discrete if discrete is None else np.asarray(discrete, float).reshape(len(self.names), -1))


class Step:
    """One transition matrix of Blocks, never written out: what the recursions ask of a matrix."""

    __array_ufunc__ = None  # so that arrays leave the product to this class
    ndim = 2

    def __init__(self, blocks: Blocks, discrete: np.ndarray):
        self.blocks, self.discrete = blocks, discrete

    def __rmatmul__(self, x: np.ndarray) -> np.ndarray:
        """``x @ self`` of a vector or of rows."""
        out, spans = np.zeros_like(x), self.blocks.spans
        for (a, b), part in self.blocks.parts.items():
            share = self.discrete[a, b]
            if share:
                mine = x[..., spans[a]]
                out[..., spans[b]] += share * (mine.sum(axis=-1)[..., None] * part if part.ndim == 1 else mine @ part)
        return out

    def __matmul__(self, g: np.ndarray) -> np.ndarray:
        out, spans = np.zeros_like(g), self.blocks.spans
        for (a, b), part in self.blocks.parts.items():
            if self.discrete[a, b]:
                out[spans[a]] += self.discrete[a, b] * (part @ g[spans[b]])
        return out

    def sum(self, axis: int) -> np.ndarray:
        return self @ np.ones(len(self.blocks.states))

    def best(self, h: np.ndarray) -> np.ndarray:
        """For each bin the largest log transition plus ``h`` of the bin led to."""
        out, spans = np.full(len(h), -np.inf), self.blocks.spans
        for (a, b), part in self.blocks.parts.items():
            found = (_log(part) + h[spans[b]]).max(axis=-1) + _log(self.discrete[a, b])
            out[spans[a]] = np.maximum(out[spans[a]], found)
        return out

    def __getitem__(self, state) -> np.ndarray:
        """Rows of the matrix."""
        b = self.blocks
        return b.continuous[state] * self.discrete[b.states[state]][..., b.states]


class Steps:
    """The transitions of successive rows, by their discrete matrices."""

    ndim = 3

    def __init__(self, blocks: Blocks, discrete: np.ndarray):
        self.blocks, self.discrete = blocks, discrete

    def __getitem__(self, k):
        return Steps(self.blocks, self.discrete[k]) if isinstance(k, slice) else self.blocks.step(self.discrete[k])


def _best(a, h: np.ndarray) -> np.ndarray:
    """Max-plus product of a transition and scores."""
    return a.best(h) if isinstance(a, Step) else (_log(a) + h[None, :]).max(axis=1)


def _dense(a) -> np.ndarray:
    return a[np.arange(len(a.blocks.states))] if isinstance(a, Step) else a


def condition_on(p: np.ndarray, ll: np.ndarray) -> tuple[np.ndarray, float]:
    """Posterior and log normaliser of a prior and log likelihoods; the guard keeps impossible rows at zero."""
    top = ll.max()
    top = top if np.isfinite(top) else 0.0
    u = p * np.exp(ll - top)
    total = u.sum()
    with np.errstate(divide="ignore"):
        return u / (total + EPS), float(np.log(total) + top)


def _ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.divide(x, y, out=np.zeros_like(x), where=y != 0)


def filter_array(pi: np.ndarray, ll: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(filtered, predicted, log normalisers); trans is (S, S) or (T, S, S)."""
    filtered, predicted, norms = np.empty_like(ll), np.empty_like(ll), np.empty(len(ll))
    p = pi
    for k in range(len(ll)):
        predicted[k] = p
        filtered[k], norms[k] = condition_on(p, ll[k])
        p = filtered[k] @ (trans if trans.ndim == 2 else trans[k])
    return filtered, predicted, norms


def smooth_array(filtered: np.ndarray, trans: np.ndarray, after: np.ndarray | None = None) -> np.ndarray:
    """Smoothed posteriors; ``after`` is that of the step behind the last row, None at the session's end."""
    out = np.empty_like(filtered)
    nxt = after
    for k in range(len(filtered) - 1, -1, -1):
        if nxt is None:
            out[k] = filtered[k]
        else:
            a = trans if trans.ndim == 2 else trans[k]
            u = filtered[k] * (a @ _ratio(nxt, filtered[k] @ a))
            total = u.sum()
            out[k] = u / total if total > 0 else u
        nxt = out[k]
    return out


def viterbi_array(pi: np.ndarray, ll: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Most likely states; ties go to the lowest."""
    back, _ = _backward_max(ll, trans, np.zeros(ll.shape[1]))
    with np.errstate(divide="ignore"):
        state = int(np.argmax(np.log(pi) + ll[0] + back[0]))
    return _walk(state, ll, trans, back)


def _log(x):
    with np.errstate(divide="ignore"):
        return np.log(x)


def _backward_max(ll: np.ndarray, trans: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of the best continuation from each state at each step; ``last`` holds at the last step."""
    back = np.empty_like(ll)
    back[-1] = last
    fixed = _log(trans) if isinstance(trans, np.ndarray) and trans.ndim == 2 else None
    for k in range(len(ll) - 2, -1, -1):
        h = back[k + 1] + ll[k + 1]
        back[k] = (fixed + h[None, :]).max(axis=1) if fixed is not None else _best(trans if trans.ndim == 2 else trans[k], h)
    return back, back[0] + ll[0]


def _walk(state: int, ll: np.ndarray, trans: np.ndarray, back: np.ndarray) -> np.ndarray:
    path = np.empty(len(ll), np.int64)
    path[0] = state
    for k in range(1, len(ll)):
        a = trans if trans.ndim == 2 else trans[k - 1]
        state = int(np.argmax(_log(a[state]) + ll[k] + back[k]))
        path[k] = state
    return path


# --- chunk operators --------------------------------------------------------------------------

def _operator(ll: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Product of diag(exp ll_t) A_t over a chunk: rows of sum 1 and their log scales."""
    n = ll.shape[1]
    m, scale = np.eye(n), np.zeros(n)
    for k in range(len(ll)):
        a = trans if trans.ndim == 2 else trans[k]
        top = ll[k].max()
        top = top if np.isfinite(top) else 0.0
        m = (m * np.exp(ll[k] - top)) @ a
        total = m.sum(axis=1)
        with np.errstate(divide="ignore"):
            scale += top + np.log(total)
        m = _ratio(m, np.repeat(total[:, None], n, axis=1))
    return m, scale


def _max_operator(ll: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Max-plus product over a chunk: best score of going from a state at its start to one after its end."""
    n = ll.shape[1]
    m = np.where(np.eye(n, dtype=bool), 0.0, -np.inf)
    for k in range(len(ll)):
        a = _log(_dense(trans if trans.ndim == 2 else trans[k]))
        m = ((m + ll[k][None, :])[:, :, None] + a[None]).max(axis=1)
    return m


def _push(p: np.ndarray, m: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Predicted state probabilities behind a chunk."""
    with np.errstate(divide="ignore"):
        w = np.log(p) + scale
    top = w.max()
    out = np.exp(w - top) @ m if np.isfinite(top) else np.zeros_like(p)
    return out / out.sum() if out.sum() > 0 else out


def _pull(g: np.ndarray, m: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Likelihood message before a chunk from the one behind it, up to a factor."""
    with np.errstate(divide="ignore"):
        w = np.log(m @ g) + scale
    top = w.max()
    return np.exp(w - top) if np.isfinite(top) else np.zeros_like(g)


def _read(pdf: pd.DataFrame, fixed: np.ndarray | Blocks | None, trans: str | None):
    ll = np.stack(pdf["ll"].to_list()).astype(float)
    n = ll.shape[1]
    if isinstance(fixed, Blocks):
        return ll, fixed.step() if trans is None else Steps(fixed, np.stack(pdf[trans].to_list()).astype(float))
    return ll, fixed if trans is None else np.stack(pdf[trans].to_list()).astype(float).reshape(-1, n, n)


def _fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


_ARRAY = T.ArrayType(T.DoubleType(), False)


def _messages(df: DataFrame, pi: np.ndarray, fixed, keys: list[str], trans: str | None) -> DataFrame:
    """(keys, chunk, fwd, bwd): what reaches each chunk from before and from behind (null at the end)."""
    schema = T.StructType([*_fields(df, keys), T.StructField("chunk", T.LongType()), T.StructField("m", _ARRAY), T.StructField("scale", _ARRAY)])

    def operators(pdf: pd.DataFrame) -> pd.DataFrame:
        ll, a = _read(pdf.sort_values("t_idx"), fixed, trans)
        m, scale = _operator(ll, a)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "chunk": [pdf["chunk"].iloc[0]], "m": [m.ravel()], "scale": [scale]})

    ops = df.groupBy(*keys, "chunk").applyInPandas(operators, schema)
    out = T.StructType([*_fields(df, keys), T.StructField("chunk", T.LongType()), T.StructField("fwd", _ARRAY), T.StructField("bwd", _ARRAY)])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        n = len(pi)
        ms, scales = [x.reshape(n, n) for x in pdf["m"]], list(pdf["scale"])
        fwd, p = [], pi
        for m, s in zip(ms, scales, strict=True):
            fwd.append(p)
            p = _push(p, m, s)
        bwd, g = [None] * len(ms), None
        for k in range(len(ms) - 1, 0, -1):
            g = _pull(np.ones(n) if g is None else g, ms[k], scales[k])
            bwd[k - 1] = g
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(ms) for k in keys}, "chunk": pdf["chunk"].to_numpy(), "fwd": fwd, "bwd": bwd})

    return ops.groupBy(*keys).applyInPandas(fold, out) if keys else ops.groupBy(F.col("chunk") * 0).applyInPandas(fold, out)


def _given(transition) -> np.ndarray | Blocks | None:
    return transition if transition is None or isinstance(transition, Blocks) else np.asarray(transition, float)


def _carry(rows: DataFrame, keys: list[str], name: str, fixed: np.ndarray | Blocks | None, trans: str | None, start: np.ndarray | None, step, down: bool) -> DataFrame:
    """(keys, chunk, ``name``): the vector that reaches each chunk along its session; null where none does.

    ``step(vector, ll, transition)`` takes the vector over one row; ``down`` goes from the last row to the first.
    """
    schema = T.StructType([*_fields(rows, keys), T.StructField("chunk", T.LongType()), T.StructField(name, T.ArrayType(T.DoubleType()))])

    def run(batches):
        session = chunk = vector = None
        for batch in batches:
            if not batch.num_rows:
                continue
            n = len(batch.column("ll")[0])
            ll = batch.column("ll").flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            if not trans:
                each = [fixed.step() if isinstance(fixed, Blocks) else fixed] * len(ll)
            else:
                each = batch.column(trans).flatten().to_numpy(zero_copy_only=False).reshape(len(ll), -1)
                each = Steps(fixed, each) if isinstance(fixed, Blocks) else each.reshape(-1, n, n)
            mine = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True)) if keys else [()] * batch.num_rows
            out = []
            for k, c in enumerate(batch.column("chunk").to_pylist()):
                if mine[k] != session:
                    session, chunk, vector = mine[k], None, start
                if c != chunk:
                    chunk = c
                    out.append((*session, c, None if vector is None else vector.tolist()))
                vector = step(vector, ll[k], each[k])
            kinds = [*(batch.schema.field(k).type for k in keys), pa.int64(), pa.list_(pa.float64())]
            columns = zip(*out, strict=True) if out else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[*keys, "chunk", name])

    at = F.col("t_idx").desc() if down else F.col("t_idx")
    placed = rows.repartition(*keys) if keys else rows.repartition(1)
    return placed.sortWithinPartitions(*keys, at).mapInArrow(run, schema)


def _carried(df: DataFrame, pi: np.ndarray, fixed, keys: list[str], trans: str | None) -> DataFrame:
    """As _messages, without operators."""
    def ahead(p, ll, a):
        return condition_on(p, ll)[0] @ a

    def behind(g, ll, a):
        top = ll.max()
        out = np.exp(ll - (top if np.isfinite(top) else 0.0)) * (a.sum(axis=1) if g is None else a @ g)
        return out / out.max() if out.max() > 0 else out

    fwd = _carry(df, keys, "fwd", fixed, trans, pi, ahead, False)
    bwd = _carry(df, keys, "bwd", fixed, trans, None, behind, True)
    none = F.lit(None).cast("array<double>")
    both = fwd.withColumn("bwd", none).unionByName(bwd.withColumn("fwd", none))
    return both.groupBy(*keys, "chunk").agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("fwd", "bwd")))


def _chunked(df: DataFrame, keys: list[str], trans: str | None, chunk: int, n: int) -> DataFrame:
    size = max(1, min(chunk, CELLS // n)) if n > SCAN_STATES else chunk
    return df.select(*keys, "t_idx", "ll", *([trans] if trans else [])).withColumn("chunk", F.floor(F.col("t_idx") / size).cast("long"))


def decode(df: DataFrame, initial: Sequence[float], transition: Sequence[Sequence[float]] | Blocks | None = None, keys: Sequence[str] = (), trans: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``df``'s keys and t_idx with filtered, predicted, smoothed (arrays) and log_norm.

    The log likelihood of a session is the sum of its log_norm.
    """
    keys, pi = list(keys), np.asarray(initial, float)
    fixed = _given(transition)
    rows = _chunked(df, keys, trans, chunk, len(pi))
    schema = T.StructType([*_fields(df, keys), df.schema["t_idx"], *(T.StructField(n, _ARRAY) for n in ("filtered", "predicted", "smoothed")), T.StructField("log_norm", T.DoubleType())])

    def result(pdf, f, p, s, norm):
        return pd.DataFrame({**{k: pdf[k] for k in keys}, "t_idx": pdf["t_idx"], "filtered": list(f), "predicted": list(p), "smoothed": list(s), "log_norm": norm})

    messages = (_carried if len(pi) > SCAN_STATES else _messages)(rows, pi, fixed, keys, trans)

    def run(key, pdf: pd.DataFrame, msg: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t_idx")
        ll, a = _read(pdf, fixed, trans)
        f, p, norm = filter_array(np.asarray(msg["fwd"].iloc[0]), ll, a)
        g = msg["bwd"].iloc[0]
        after = None
        if g is not None:
            behind = f[-1] @ (a if a.ndim == 2 else a[-1])
            after = behind * np.asarray(g)
            after = after / after.sum() if after.sum() > 0 else after
        return result(pdf, f, p, smooth_array(f, a, after), norm)

    return rows.groupBy(*keys, "chunk").cogroup(messages.groupBy(*keys, "chunk")).applyInPandas(run, schema)


def viterbi(df: DataFrame, initial: Sequence[float], transition: Sequence[Sequence[float]] | Blocks | None = None, keys: Sequence[str] = (), trans: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """``df``'s keys and t_idx with ``state``, the most likely sequence of each session."""
    keys, pi = list(keys), np.asarray(initial, float)
    fixed = _given(transition)
    rows = _chunked(df, keys, trans, chunk, len(pi))
    schema = T.StructType([*_fields(df, keys), df.schema["t_idx"], T.StructField("state", T.LongType())])
    picked = T.StructType([*_fields(df, keys), T.StructField("chunk", T.LongType()), T.StructField("enter", T.LongType()), T.StructField("tail", _ARRAY)])

    def run(key, pdf: pd.DataFrame, msg: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t_idx")
        ll, a = _read(pdf, fixed, trans)
        back, _ = _backward_max(ll, a, np.asarray(msg["tail"].iloc[0]))
        return pd.DataFrame({**{k: pdf[k] for k in keys}, "t_idx": pdf["t_idx"], "state": _walk(int(msg["enter"].iloc[0]), ll, a, back)})

    if len(pi) > SCAN_STATES:
        def best(head, ll, a):  # score from each state at a row on, its own likelihood included
            return ll if head is None else ll + _best(a, head)

        heads = _carry(rows, keys, "head", fixed, trans, None, best, True)
        ways = T.StructType([*_fields(df, keys), T.StructField("chunk", T.LongType()), T.StructField("start", _ARRAY), T.StructField("leave", T.ArrayType(T.LongType(), False)), T.StructField("tail", _ARRAY)])

        def links(key, pdf: pd.DataFrame, msg: pd.DataFrame) -> pd.DataFrame:
            ll, a = _read(pdf.sort_values("t_idx"), fixed, trans)
            head = msg["head"].iloc[0]
            tail = np.zeros(ll.shape[1]) if head is None else _best(a if a.ndim == 2 else a[-1], np.asarray(head))
            back, start = _backward_max(ll, a, tail)
            state = np.arange(ll.shape[1])
            for k in range(1, len(ll) + (head is not None)):
                kinds, which = np.unique(state, return_inverse=True)
                ahead = ll[k] + back[k] if k < len(ll) else np.asarray(head)
                state = (_log((a if a.ndim == 2 else a[k - 1])[kinds]) + ahead).argmax(axis=1)[which]
            return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "chunk": [pdf["chunk"].iloc[0]], "start": [start], "leave": [state], "tail": [tail]})

        def follow(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("chunk")
            state, enter = int(np.argmax(_log(pi) + pdf["start"].iloc[0])), []
            for leave in pdf["leave"]:
                enter.append(state)
                state = int(leave[state])
            return pd.DataFrame({**{k: pdf[k] for k in keys}, "chunk": pdf["chunk"], "enter": enter, "tail": pdf["tail"]})

        linked = rows.groupBy(*keys, "chunk").cogroup(heads.groupBy(*keys, "chunk")).applyInPandas(links, ways)
        chosen = linked.groupBy(*(keys or [F.col("chunk") * 0])).applyInPandas(follow, picked)
        return rows.groupBy(*keys, "chunk").cogroup(chosen.groupBy(*keys, "chunk")).applyInPandas(run, schema)

    # First pass: each chunk's best score from a state at its start to each state at its last row.
    ends = T.StructType([*_fields(df, keys), T.StructField("chunk", T.LongType()), T.StructField("score", _ARRAY), T.StructField("link", _ARRAY), T.StructField("head", _ARRAY)])

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        ll, a = _read(pdf.sort_values("t_idx"), fixed, trans)
        inner = _max_operator(ll[:-1], a if a.ndim == 2 else a[:-1]) + ll[-1][None, :]
        link = _log(_dense(a if a.ndim == 2 else a[-1]))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "chunk": [pdf["chunk"].iloc[0]], "score": [inner.ravel()], "link": [link.ravel()], "head": [ll[0]]})

    ops = rows.groupBy(*keys, "chunk").applyInPandas(score, ends)

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("chunk")
        n = len(pi)
        inner, link = [x.reshape(n, n) for x in pdf["score"]], [x.reshape(n, n) for x in pdf["link"]]
        tails, start = [np.zeros(n)], None
        for k in range(len(inner) - 1, -1, -1):  # start: best score from each state at the chunk's first row on
            start = (inner[k] + tails[0][None, :]).max(axis=1)
            if k:
                tails.insert(0, (link[k - 1] + start[None, :]).max(axis=1))
        state, enter = int(np.argmax(_log(pi) + start)), []
        for k in range(len(inner)):
            enter.append(state)
            if k + 1 < len(inner):
                best = inner[k][state] + tails[k]
                last = int(np.argmax(best))
                head = (inner[k + 1] + tails[k + 1][None, :]).max(axis=1)
                state = int(np.argmax(link[k][last] + head))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(inner) for k in keys}, "chunk": pdf["chunk"].to_numpy(), "enter": enter, "tail": tails})

    chosen = (ops.groupBy(*keys) if keys else ops.groupBy(F.col("chunk") * 0)).applyInPandas(fold, picked)
    return rows.groupBy(*keys, "chunk").cogroup(chosen.groupBy(*keys, "chunk")).applyInPandas(run, schema)


def log_likelihood(decoded: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return decoded.groupBy(*keys).agg(F.sum("log_norm").alias("log_likelihood"))


def converged(now: float, before: float, tolerance: float = 1e-4) -> tuple[bool, bool]:
    """(converged, not decreasing) of two log likelihoods."""
    delta = now - before
    average = (abs(now) + abs(before) + np.finfo(float).eps) / 2
    return abs(delta) / average < tolerance, delta >= -1e-3


def by_state(df: DataFrame, column: str, keys: Sequence[str] = (), names: Sequence[str] | None = None) -> DataFrame:
    """(keys, t_idx, state, p): an array column as rows."""
    rows = df.select(*keys, "t_idx", F.posexplode(column).alias("state", "p"))
    return rows if names is None else rows.withColumn("state", F.element_at(F.array(*map(F.lit, names)), F.col("state") + 1))


def marginal(df: DataFrame, column: str, state_of_bin: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Probabilities of discrete states from those of their bins: (keys, t_idx, state, p)."""
    owner = F.array(*(F.lit(int(s)) for s in state_of_bin))
    rows = df.select(*keys, "t_idx", F.posexplode(column).alias("bin", "p"))
    return rows.groupBy(*keys, "t_idx", F.element_at(owner, F.col("bin") + 1).cast("long").alias("state")).agg(F.sum("p").alias("p"))
