"""Secret scans by patterns and a linear-chain conditional random field.

The patterns give the base spans. The field tags every token of a text as
begin of a secret, inside one, or outside, from the token's shape, the words
and shapes around it and features of the whole file; the best tag sequence is
decoded by Viterbi's recursion, over blocks of tokens at once. It learns from
the values in the base spans, half of the time with all words hidden, so that
shape and surroundings each have to tell. Tokens outside the base spans made
like secrets may be secrets that the patterns miss: their tags are
summed out, not taken as outside. The field's spans are added to the base
ones."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanalign.llm.common import cut, uniform
from spanalign.llm.textops import LOWER, SPACE, raw, run_hashes, runs, slices

KINDS = ("assign", "access", "hex")
#: The kind of the spans that the field adds, and their least length in code points.
ADDED, LEAST = "secret", 8
#: Documents that the field is fitted on, and windows of them (a third around secrets at least where there are as many), about, at most.
FIT_DOCS, FIT_WINDOWS = 20_000, 6_000
#: Tokens on each side of a window's middle; steps of the fit and windows in each.
SIDE, FIT_STEPS, BATCH = 12, 400, 256
#: A token's tag is unknown outside the base spans if at least this share of the tokens made like it is in one.
LIKE_SECRETS = 0.25
#: Added to the outside score of every token: secrets are rarer in texts than in the windows.
CAUTION = 2.0
#: A longer text is decoded in sections of about this many bytes, cut at white space.
SECTION = 1 << 22
OUT, BEGIN, INSIDE = 0, 1, 2
NEVER = -1e9

# fixed values: the contract's patterns
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
LEAST_OF = {"assign": 12, "access": 18, "hex": 16}

HEX = np.zeros(256, dtype=bool)
HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
#: Classes of bytes: 0 white space, 1 lower, 2 upper, 3 digit, 4 beyond ASCII, 5 any other (a token of its own).
CLASS = np.full(256, 5, dtype=np.uint8)
CLASS[SPACE] = 0
CLASS[0x61:0x7B], CLASS[0x41:0x5B], CLASS[0x30:0x3A], CLASS[0x80:] = 1, 2, 3, 4
#: Upper bounds of the length steps.
STEPS = np.array([1, 2, 3, 4, 6, 8, 11, 15, 19, 31, 63])
IDENTITIES = 1 << 13
#: Size of each feature's table; those of words come first.
TABLES = {"word": IDENTITIES, "word-1": IDENTITIES, "word-2": IDENTITIES, "word-3": IDENTITIES, "word+1": IDENTITIES, "shape": 512, "shape-1": 512, "shape+1": 512, "mixed": 64, "gaps": 8, "file": 256, "made": 64}
MADE = len(TABLES) - 1
HIDDEN = 5  # features that are hidden in half of the windows


def holders(low: bytes, needles: tuple[bytes, ...], offsets: np.ndarray) -> set[int]:
    """Numbers of the texts in which one of the needles begins."""
    out = set()
    for needle in needles:
        at = low.find(needle)
        while at >= 0:
            i = int(np.searchsorted(offsets, at, side="right")) - 1
            out.add(i)
            at = low.find(needle, int(offsets[i + 1]))
    return out


def base(data: np.ndarray, offsets: np.ndarray) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, int]]]:
    """The base spans (start, kind, end) of each text, sorted, and the spans of
    the secret values themselves; in bytes of ``data``."""
    n = len(offsets) - 1
    spans, values = [[] for _ in range(n)], []
    starts, ends, of = runs(HEX[data], offsets)
    for i in np.flatnonzero(ends - starts >= LEAST_OF["hex"]).tolist():
        spans[of[i]].append((int(starts[i]), 2, int(ends[i])))
        values.append((int(starts[i]), int(ends[i])))
    text, low = data.tobytes(), LOWER[data].tobytes()
    for i in holders(low, WORDS, offsets):
        for m in ASSIGN.finditer(text[offsets[i] : offsets[i + 1]]):
            if len(m[2]) >= LEAST_OF["assign"]:
                spans[i].append((int(offsets[i]) + m.start(), 0, int(offsets[i]) + m.end()))
                values.append((int(offsets[i]) + m.start(2), int(offsets[i]) + m.end(2)))
    for i in holders(text, (b"AKIA",), offsets):
        for m in ACCESS.finditer(text[offsets[i] : offsets[i + 1]]):
            if len(m[0]) >= LEAST_OF["access"]:
                spans[i].append((int(offsets[i]) + m.start(), 1, int(offsets[i]) + m.end()))
                values.append((int(offsets[i]) + m.start(), int(offsets[i]) + m.end()))
    return [sorted(s) for s in spans], values


class Tokens:
    """The tokens of some texts: runs of letters and digits, and every other
    character that isn't white space; ``x`` has their features."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        kind = CLASS[data]
        word, other = (kind > 0) & (kind < 5), kind == 5
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        begin, end = other | word, other | word
        begin[1:] &= ~(word[1:] & word[:-1]) | edge[1:-1]
        end[:-1] &= ~(word[1:] & word[:-1]) | edge[1:-1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        n = len(self.starts)
        doc = np.searchsorted(offsets, self.starts, side="right") - 1
        size = self.ends - self.starts
        # chains: the texts, and the sections of long ones
        gap = np.append(True, self.starts[1:] != self.ends[:-1])[:n]
        section = (self.starts - offsets[doc]) // SECTION
        self.first = np.append(True, doc[1:] != doc[:-1])[:n]
        for i in np.flatnonzero(np.append(False, (section[1:] != section[:-1]) & ~self.first[1:])):
            while i < n and not gap[i]:
                i += 1
            if i < n:
                self.first[i] = True
        self.doc, self.gap = doc, gap | self.first
        # what the bytes of each token are
        total = lambda on: np.append(0, np.cumsum(on, dtype=np.int32))
        of = lambda c: c[self.ends] - c[self.starts]
        digit, punct = total(kind == 3), total(other)
        digits = of(digit)
        step = np.searchsorted(STEPS, size)
        made = sum((of(total(kind == k)) > 0).astype(np.int64) << (k - 1) for k in (1, 2, 4)) + ((digits > 0).astype(np.int64) << 2)
        made = np.where(made > 15, 15, made)
        alone = other[self.starts]
        shape = 1 + np.where(alone, 256 + (data[self.starts] & 127).astype(np.int64), made * 12 + step)
        change = np.zeros(len(data), dtype=bool)
        change[1:] = (kind[1:] != kind[:-1]) & word[1:] & word[:-1]
        switches = total(change)
        switches = np.searchsorted([0, 1, 2, 4, 7], switches[self.ends] - switches[np.minimum(self.starts + 1, len(data))])
        share = np.minimum(digits * 6 // np.maximum(size, 1), 5)
        mixed = 1 + np.where(alone, 0, switches * 6 + share)
        h = run_hashes(LOWER[data], self.starts, self.ends)
        word_id = 1 + (h % np.uint64(IDENTITIES - 2)).astype(np.int64)
        word_id = np.where(size > 16, IDENTITIES - 1, word_id)  # long tokens are told by their shape only
        length = np.maximum(np.diff(offsets), 1)
        part = lambda c, bounds: np.searchsorted(bounds, (c[offsets[1:]] - c[offsets[:-1]]) / length)
        newlines = total(data == 10)
        file = (part(digit, [0.005, 0.02, 0.1]) * 4 + part(punct, [0.02, 0.06, 0.15])) * 4 + part(newlines, [0.0005, 0.01, 0.03])
        sort = np.where(alone, 0, 1 + (digits > 0) + (size > 11))
        after = np.append(self.gap[1:], True)[:n]
        newline = np.zeros(n, dtype=bool)
        newline[1:] = newlines[self.starts[1:]] > newlines[self.ends[:-1]]
        self.x = np.zeros((len(TABLES), n), dtype=np.int32)
        chain = np.cumsum(self.first)
        for row, (values, shift) in enumerate([(word_id, 0), (word_id, 1), (word_id, 2), (word_id, 3), (word_id, -1), (shape, 0), (shape, 1), (shape, -1)]):
            self.x[row] = shifted(values, chain, shift)
        self.x[8] = mixed
        self.x[9] = self.gap + 2 * newline + 4 * after
        self.x[10] = file[doc] * 4 + sort if n else 0
        self.x[MADE] = 1 + np.where(alone, 32, made * 2 + (size > 11))  # the kinds of characters, and whether many

    def tags(self, values: list[tuple[int, int]]) -> np.ndarray:
        """Tags by the given spans of bytes."""
        out = np.zeros(len(self.starts), dtype=np.int8)
        for a, b in sorted(values):
            i, j = np.searchsorted(self.ends, a, side="right"), np.searchsorted(self.starts, b)
            new = out[i:j] == OUT
            out[i:j] = np.where(new, INSIDE, out[i:j])
            if j > i and new[0] and (i == 0 or out[i - 1] == OUT or self.gap[i]):
                out[i] = BEGIN
        return out


def shifted(values: np.ndarray, chain: np.ndarray, by: int) -> np.ndarray:
    """Each token's value of the token ``by`` places before it in its chain, or 0."""
    out = np.zeros_like(values)
    n = len(values)
    if by >= 0:
        out[by:] = np.where(chain[by:] == chain[: n - by], values[: n - by], 0)[: max(0, n - by)]
    else:
        out[:by] = np.where(chain[:by] == chain[-by:], values[-by:], 0)
    return out


def unary(x: np.ndarray, weights: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((x.shape[1], 3))
    for row, w in zip(x, weights, strict=True):
        out += np.take(w, row, axis=0)
    return out


def passes_of(u: np.ndarray, step: np.ndarray, start: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log sums of all tag sequences (windows), each token's tag probabilities
    and the expected number of each step from tag to tag."""
    m, t, _ = u.shape
    add = lambda z, axis: (top := z.max(axis=axis, keepdims=True)).squeeze(axis) + np.log(np.exp(z - top).sum(axis=axis))
    alpha, beta = np.zeros((t, m, 3)), np.zeros((t, m, 3))
    alpha[0] = start + u[:, 0]
    for i in range(1, t):
        on = mask[:, i, None]
        alpha[i] = np.where(on, add(alpha[i - 1][:, :, None] + step, 1) + u[:, i], alpha[i - 1])
    for i in range(t - 2, -1, -1):
        on = mask[:, i + 1, None]
        beta[i] = np.where(on, add(step + (u[:, i + 1] + beta[i + 1])[:, None, :], 2), beta[i + 1])
    z = add(alpha[-1], 1)
    p = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2) * mask[..., None]
    flow = np.zeros((3, 3))
    for i in range(1, t):
        on = mask[:, i]
        flow += np.exp(alpha[i - 1][on][:, :, None] + step + (u[:, i] + beta[i])[on][:, None, :] - z[on][:, None, None]).sum(axis=0)
    return z, p, flow


def gradient(x: np.ndarray, y: np.ndarray, gap: np.ndarray, mask: np.ndarray, weights: list[np.ndarray], trans: np.ndarray, start: np.ndarray) -> tuple[float, list[np.ndarray], np.ndarray, np.ndarray]:
    """Negative log likelihood of the tags ``y`` (windows x tokens; -1: not
    known, all are summed) and its gradient, by forward and backward sums."""
    k, m, t = x.shape
    u = unary(x.reshape(k, -1), weights).reshape(m, t, 3)
    u[..., INSIDE] = np.where(gap, NEVER, u[..., INSIDE])
    step = trans.copy()
    step[OUT, INSIDE] = NEVER
    z, p, flow = passes_of(u, step, start, mask)
    known = (y[..., None] < 0) | (y[..., None] == np.arange(3))
    gold_z, gold, gold_flow = passes_of(np.where(known, u, 2 * NEVER), step, start, mask)
    diff = (p - gold).reshape(-1, 3)
    grads = [np.stack([np.bincount(row, weights=diff[:, c], minlength=len(w)) for c in range(3)], axis=1) for row, w in zip(x.reshape(k, -1), weights, strict=True)]
    flow -= gold_flow
    flow[OUT, INSIDE] = 0.0
    return float((z - gold_z).sum()), grads, flow, (p[:, 0] - gold[:, 0]).sum(axis=0)


def windows(docs: DataFrame, fit_docs: int, fit_windows: int) -> tuple[list, np.ndarray]:
    """Windows of tokens (features, tags, gaps) of about ``fit_docs`` documents
    at most: around each base secret, around a token with a digit and around
    any token of each text; and the share of the tokens made alike that is in
    base secrets."""
    n = docs.count()
    sampled = docs if n <= fit_docs else docs.filter(uniform("doc_id", seed=13) < fit_docs / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, offsets = raw(b.column("text"))
            tokens = Tokens(data, offsets)
            spans, values = base(data, offsets)
            y = tokens.tags(values)
            m = len(y)
            begins = np.flatnonzero(y == BEGIN)
            # one token of each text, and one with a digit where there is one, chosen by hash
            pick = tokens.x[1].astype(np.int64) * 7919 + tokens.x[3] * 31 + tokens.x[5]
            order = np.lexsort((pick * 2654435761 % 1000003, tokens.doc))
            any_one = order[np.append(True, tokens.doc[order][1:] != tokens.doc[order][:-1])[:m]] if m else order
            digits = order[(tokens.x[10] % 4 >= 2)[order] & (y[order] == OUT)]
            digit_one = digits[np.append(True, tokens.doc[digits][1:] != tokens.doc[digits][:-1])] if len(digits) else digits
            chain = np.cumsum(tokens.first)
            rows = []
            for i in [*begins.tolist(), *any_one.tolist(), *digit_one.tolist()]:
                a, z = max(0, i - SIDE), min(m, i + SIDE + 1)
                own = np.flatnonzero(chain[a:z] == chain[i]) + a
                rows.append((bool((y[own] > 0).any()), tokens.x[:, own].ravel().tolist(), y[own].tolist(), tokens.gap[own].tolist()))
            for i in np.unique(tokens.x[MADE]).tolist():  # how many there are, and how many in secrets
                own = tokens.x[MADE] == i
                rows.append((None, [i, int(own.sum()), int((own & (y > 0)).sum())], None, None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.list_(pa.bool_())))], ["secret", "x", "y", "gap"])

    made = cut(sampled.select("text").mapInArrow(run, "secret boolean, x array<int>, y array<tinyint>, gap array<boolean>"), "windows")
    share_of = np.zeros(TABLES["made"])
    shape = made.filter("secret is null").select(F.col("x")[0].alias("s"), F.col("x")[1].alias("n"), F.col("x")[2].alias("k"))
    for r in shape.groupBy("s").agg((F.sum("k") / F.sum("n")).alias("share")).collect():
        share_of[r["s"]] = r["share"]
    rows = cut(made.filter("secret is not null").distinct(), "distinct-windows")
    held, all_ = rows.agg(F.count_if("secret"), F.count("*")).first()
    with_, rest = min(held, fit_windows // 2), 0
    rest = fit_windows - with_
    share = F.when(F.col("secret"), with_ / max(1, held)).otherwise(min(1.0, rest / max(1, all_ - held)))
    return rows.filter(uniform("x", "y", seed=14) < share).orderBy("secret", "y", "x", "gap").collect(), share_of


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_windows: int = FIT_WINDOWS, steps: int = FIT_STEPS) -> dict | None:
    """The field's weights; None where the sample has no base secret."""
    rows, share_of = windows(docs, fit_docs, fit_windows)
    if not any(r["secret"] for r in rows):
        return None
    t = max(len(r["y"]) for r in rows)
    x, y = np.zeros((len(TABLES), len(rows), t), dtype=np.int32), np.zeros((len(rows), t), dtype=np.int64)
    gap, mask = np.zeros((len(rows), t), dtype=bool), np.zeros((len(rows), t), dtype=bool)
    for i, r in enumerate(rows):
        n = len(r["y"])
        x[:, i, :n] = np.array(r["x"], dtype=np.int32).reshape(len(TABLES), n)
        y[i, :n], gap[i, :n], mask[i, :n] = r["y"], r["gap"], True
        if y[i, 0] == INSIDE:  # a window that begins inside a secret
            y[i, 0] = BEGIN
    y = np.where((y == OUT) & (share_of[x[MADE]] >= LIKE_SECRETS), -1, y)
    hidden = x.copy()
    hidden[:HIDDEN] = 0
    x, y, gap, mask = np.concatenate([x, hidden], axis=1), np.tile(y, (2, 1)), np.tile(gap, (2, 1)), np.tile(mask, (2, 1))
    weights, trans, start = [np.zeros((n, 3)) for n in TABLES.values()], np.zeros((3, 3)), np.zeros(3)
    start[INSIDE] = NEVER
    params = [*weights, trans, start]
    square = [np.full(p.shape, 1e-6) for p in params]
    rng = np.random.default_rng(1)
    for _ in range(steps):
        some = rng.choice(len(y), min(BATCH, len(y)), replace=False)
        _, grads, flow, first = gradient(x[:, some], y[some], gap[some], mask[some], weights, trans, start)
        first[INSIDE] = 0.0
        for p, g, s in zip(params, [*grads, flow, first], square, strict=True):
            g = g + 0.002 * np.where(p > NEVER / 2, p, 0)
            s += g * g
            p -= 0.3 * g / np.sqrt(s)
    return {"weights": [w.astype(np.float32) for w in weights], "trans": trans, "start": start}


def viterbi(u: np.ndarray, trans: np.ndarray, start: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The best tags of chains that stand one after the other (``first`` marks
    where each begins): blocks of tokens are run through at once for every tag
    that may come before them, then the blocks are joined."""
    n = len(u)
    if not n:
        return np.zeros(0, dtype=np.int8)
    t = max(1, int(np.sqrt(n) / 2))
    c = -(-n // t)
    pad = c * t - n
    u = np.ascontiguousarray(np.concatenate([u, np.zeros((pad, 3))]).reshape(c, t, 3).transpose(1, 2, 0))
    first = np.concatenate([first, np.ones(pad, dtype=bool)]).reshape(c, t).T
    heads = [np.flatnonzero(f) for f in first]

    def step(v: list[np.ndarray], i: int, back: np.ndarray | None = None) -> list[np.ndarray]:
        """Scores (..., blocks) of the three tags after token i of each block."""
        out = []
        for cur in range(3):
            a, b, z = (v[k] + trans[k, cur] for k in range(3))
            best = np.maximum(np.maximum(a, b), z)
            if len(heads[i]):
                best[..., heads[i]] = np.maximum(np.maximum(v[0], v[1]), v[2])[..., heads[i]] + start[cur]
            if back is not None:
                back[cur] = np.where(a == best, 0, np.where(b == best, 1, 2))
                h = heads[i]
                back[cur, h] = np.argmax([x[h] for x in v], axis=0) if len(h) else 0
            out.append(best + u[i, cur])
        return out

    through = [np.where(np.arange(3)[:, None] == k, np.zeros((3, c)), NEVER) for k in range(3)]
    for i in range(t):
        through = step(through, i)
    passed, enter = np.stack(through, axis=-1).transpose(1, 0, 2), np.zeros((c + 1, 3))  # block, tag before, tag at its end
    for b in range(c):
        v = (enter[b][:, None] + passed[b]).max(axis=0)
        enter[b + 1] = v - v.max()
    v, back = list(enter[:c].T), np.zeros((t, 3, c), dtype=np.int8)
    for i in range(t):
        v = step(v, i, back[i])
    # the way back from each tag at a block's end, then the blocks' ends from the last
    way, now, block = np.zeros((t, 3, c), dtype=np.int8), np.repeat(np.arange(3)[:, None], c, axis=1), np.arange(c)
    for i in range(t - 1, -1, -1):
        way[i] = now
        now = back[i][now, block]
    ends = np.zeros(c, dtype=np.int64)
    ends[-1] = np.argmax([x[-1] for x in v])
    for b in range(c - 1, 0, -1):
        ends[b - 1] = now[ends[b], b]
    return way[:, ends, block].T.reshape(-1)[:n]


def tagged(tokens: Tokens, model: dict, caution: float = CAUTION) -> np.ndarray:
    u = unary(tokens.x, model["weights"])
    u[:, OUT] += caution
    u[tokens.gap, INSIDE] = NEVER
    trans = model["trans"].copy()
    trans[OUT, INSIDE] = NEVER
    return viterbi(u, trans, model["start"], tokens.first)


def found(texts: pa.Array, model: dict | None) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text as (kind, start, end) in code
    points, by start, then kind."""
    data, offsets = raw(texts)
    spans, _ = base(data, offsets)
    every = [list(s) for s in spans]
    if model and len(data):
        tokens = Tokens(data, offsets)
        tag = tagged(tokens, model)
        begins = np.flatnonzero(tag == BEGIN)
        outside = np.append(np.flatnonzero(tag != INSIDE), len(tag))
        last = outside[np.searchsorted(outside, begins, side="right")] - 1
        for a, b, d in zip(tokens.starts[begins].tolist(), tokens.ends[last].tolist(), tokens.doc[begins].tolist(), strict=True):
            if not any(s < b and a < e for s, _, e in spans[d]):
                every[d].append((a, len(KINDS), b))
    point = np.append(0, np.cumsum((data & 0xC0) != 0x80, dtype=np.int64))
    names = (*KINDS, ADDED)
    out = []
    for d, at in enumerate(offsets[:-1].tolist()):
        own = sorted((int(point[a] - point[at]), k, int(point[b] - point[at])) for a, k, b in every[d])
        all_ = [(names[k], a, b) for a, k, b in own if k < len(KINDS) or b - a >= LEAST]
        out.append(([s for s in all_ if s[0] != ADDED], all_))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def scan(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex`` (base spans), ``base`` and ``spans``
    (kind:start:end, comma-joined; code points, end exclusive) for each row of
    ``docs(doc_id, text)``.

    Base spans are whole matches; the field's spans (``secret``) have at least
    LEAST characters and overlap no base span. Null text as empty; whole
    texts, in time that follows their length; repeated rows stay rows; other
    columns are not used; no rows give no rows, and without any base secret in
    the fitted sample the field adds none."""
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = found(b.column("text"), model)
            n = [pa.array([sum(x[0] == k for x in s) for s, _ in got], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *n, pa.array([joined(s) for s, _ in got], pa.string()), pa.array([joined(s) for _, s in got], pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")
