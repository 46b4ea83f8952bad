"""Personal data by patterns and a skip-chain conditional random field.

The patterns give the base spans. The field labels the tokens with a digit or
an at sign: each has potentials from its shape and surroundings, neighbours
share a chain potential, and equal or similar tokens of a document, however
far apart, share a skip potential; loopy message passing carries a label from
where the patterns are sure to the tokens that they miss. Its spans are added
to the base ones."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanalign.llm.common import cut, uniform
from spanalign.llm.textops import slices

KINDS = ("email", "ip", "card", "phone")
#: Documents that the field is fitted on (by id hash), and kinds of tokens read from them, about, at most.
FIT_DOCS, FIT_TOKENS = 20_000, 200_000
#: Rounds of message passing, and the share of the new message kept in each.
ROUNDS, DAMPING = 8, 0.7
#: A token gets a kind if the belief in it is at least this.
SURE = 0.5
#: Tokens inferred together, about, and edges whose messages are computed at once. A text of more tokens is inferred in
#: windows; each window has the hubs of the keys in it.
WINDOW, EDGES = 1 << 15, 1 << 15

# The contract's patterns, in forms that read each run of characters once.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]++)\.([0-9]++)\.([0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Digits with what sets them, as in a token with letters around them.
RUN = re.compile(r"[0-9+(][0-9().,/+-]*[0-9]")
TOKEN = re.compile(r"[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (d * 2 - 9 if d > 4 else d * 2)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: an address starts where the run of local characters
    before its at sign starts, or where the last address ended."""
    out, last = [], 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        a = m.start()
        while a > last and text[a - 1] in LOCALS:
            a -= 1
        if a < m.start():
            out.append((a, m.end()))
            last = m.end()
    return out


def base(text: str) -> list[tuple[str, int, int]]:
    """The contract's base spans by kind, then start."""
    out = [("email", *m) for m in emails(text)]
    # a leading run of digits may be long; its value is compared without reading it as a number
    small = lambda s: len(s.lstrip("0")) <= 3 and int(s.lstrip("0") or 0) <= 255
    for m in IP.finditer(text):
        if small(text[m.start() : m.start(1) - 1]) and all(map(small, m.groups())):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
            out.append(("phone", *m.span()))
    return out


def shape(token: str) -> list[str]:
    """What a token looks like, without its values."""
    core = token.strip(".,;:!?\"'()[]<>")
    digits = sum("0" <= c <= "9" for c in core)
    form = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", core))[:12]
    runs = "-".join(str(min(len(r), 9)) for r in re.findall(r"[0-9]+", core)[:5])
    return [f"form {form}", f"runs {runs}", f"digits {min(digits, 20)}", "at" if "@" in core else "no at", "letters" if re.search(r"[^\W\d_]", core) else "no letters"]


def keys(token: str) -> list[str]:
    """Tokens that share a key are equal or similar: the same address whatever
    its case and the punctuation around it, or the same digits, at least
    three, however they are set, or the same last seven of more digits. With
    letters around, each run of at least seven digits counts."""
    out = []
    if "@" in token:
        out.append("@" + token.strip(".,;:!?\"'()[]<>").lower())
        return out
    lettered = re.search(r"[^\W\d_]", token)
    for run in RUN.findall(token) if lettered else [token]:
        digits = re.sub(r"[^0-9]", "", run)
        if len(digits) >= (7 if lettered else 3):
            out.append(digits)
        if len(digits) > 7:  # a number with and without its area or country code
            out.append(digits[-7:])
    return list(dict.fromkeys(out))


class Nodes:
    """The tokens of some documents as nodes: place, features, kind by the
    base spans (0: none, 1 + k: kind k), and the edges among them. A key's
    tokens are all joined to its first sure one (else its first): ``skip``, so
    that a label is one step from each; ``again`` has each with the one before
    it; ``bare`` are tokens that no pattern matched though one matched an equal
    or similar token. ``own`` marks the nodes that are this window's: a long
    text's windows share the token before them and the hubs of their keys, which
    may stand in any other window."""

    def __init__(self) -> None:
        self.doc, self.at, self.features, self.label, self.own = [], [], [], [], []
        self.chain, self.skip, self.again, self.bare = [], [], [], set()
        self.words: dict[str, str] = {}  # each feature once in memory

    def node(self, doc: int, at: tuple[int, int], features: list[str], label: int, own: bool = True) -> int:
        self.doc.append(doc)
        self.at.append(at)
        self.features.append([self.words.setdefault(f, f) for f in features])
        self.label.append(label)
        self.own.append(own)
        return len(self.at) - 1

    def taken(self) -> Nodes:
        """What is here, as nodes of its own; this one is empty afterwards."""
        full, empty = Nodes(), Nodes()
        full.__dict__, self.__dict__ = self.__dict__, empty.__dict__
        return full

    def tell(self, i: int, first: int) -> None:
        """The form of a token before ``i``, and of ``i`` to that token."""
        near = i > first and self.at[i][0] - self.at[i - 1][1] <= 2
        form = lambda k: self.features[k][0] if near else "-"
        self.features[i].append("before " + form(i - 1))
        if i > first:
            self.features[i - 1].append("after " + form(i))

    def link(self, seen: dict[str, list[int]], hubs: dict[str, tuple], last: dict[str, tuple], doc: int) -> None:
        """Skip edges among the tokens of each key; ``hubs`` has the hub of the
        keys that a long text has more than once, ``last`` their last mention."""
        for key, same in seen.items():
            if key in hubs:
                hub = next((i for i in same if self.at[i] == hubs[key][0]), None)
                before = last.get(key)
                last[key] = (self.at[same[-1]], self.features[same[-1]], self.label[same[-1]])
                hub = self.node(doc, *hubs[key], own=False) if hub is None else hub
                if before:  # the pair that stands on both sides of a window's start
                    same = [hub if before[0] == self.at[hub] else self.node(doc, *before, own=False), *same]
            else:
                hub = next((i for i in same if self.label[i]), same[0])
            if self.label[hub]:
                self.bare.update(i for i in same if not self.label[i])
            self.skip += [(hub, i) for i in same if i != hub and self.own[i]]
            self.again += zip(same, same[1:], strict=False)

    def add(self, doc: int, text: str, spans: list[tuple[str, int, int]]) -> None:
        """Add all tokens of a document."""
        for _ in self.windows(doc, text, spans, 1 << 62):
            pass

    def windows(self, doc: int, text: str, spans: list[tuple[str, int, int]], window: int, linked: bool = True) -> Iterator[Nodes]:
        """Add a document's tokens; each time that ``window`` of them are there,
        the nodes are taken, and the token before goes along as context. A
        document of fewer tokens stays together, whatever stands before it."""
        kinds = {k: i + 1 for i, k in enumerate(KINDS)}
        todo = sorted((a, b, kinds[k]) for k, a, b in spans)
        hubs: dict[str, tuple] | None = None if linked else {}
        past: dict[str, tuple] = {}
        seen: dict[str, list[int]] = defaultdict(list)
        j, i, last, first = 0, None, None, len(self.at)
        for m in TOKEN.finditer(text):
            a, b = m.span()
            if i is not None and len(self.at) - first >= window:
                before = (self.at[i], self.features[i][:-1], self.label[i])
                self.features[i].append("after " + (shape(m.group())[0] if a - last <= 2 else "-"))
                hubs = hubs_of(text, spans, window) if hubs is None else hubs
                self.link(seen, hubs, past, doc)
                yield self.taken()
                seen.clear()
                first = i = self.node(doc, *before, own=False)
                self.tell(i, first)
            while j < len(todo) and todo[j][1] <= a:
                j += 1
            got, k = 0, j
            while not got and k < len(todo) and todo[k][0] < b:
                got, k = todo[k][2] if a < todo[k][1] else 0, k + 1
            i = self.node(doc, (a, b), shape(m.group()), got)
            self.tell(i, first)
            if last is not None and a - last <= 2:
                self.chain.append((i - 1, i))
            last = b
            for key in keys(m.group()) if linked else ():
                seen[key].append(i)
        if i is not None:
            self.features[i].append("after -")
            self.link(seen, hubs or {}, past, doc)


def hubs_of(text: str, spans: list[tuple[str, int, int]], window: int) -> dict[str, tuple]:
    """Of each key that a text has more than once, the token that all others are
    joined to, in whichever window they are: the first sure one in the whole
    text, else the first. Place, features and kind."""
    seen, many = set(), set()
    for m in TOKEN.finditer(text):
        for key in keys(m.group()):
            (many if key in seen else seen).add(key)
    seen.clear()
    out: dict[str, tuple] = {}
    nodes = Nodes()

    def kept(nodes: Nodes) -> None:
        for at, features, label, own in zip(nodes.at, nodes.features, nodes.label, nodes.own, strict=True):
            for key in keys(text[at[0] : at[1]]) if own else ():
                if key in many and (key not in out or (label and not out[key][2])):
                    out[key] = (at, features, label)

    for full in nodes.windows(0, text, spans, window, linked=False):
        kept(full)
    kept(nodes)
    return out


def drawn(docs: DataFrame, share: float) -> DataFrame:
    """About this share of the documents, however small, by id."""
    return docs.filter(uniform("doc_id", seed=5) < share)


def fit(docs: DataFrame, fit_docs: int = FIT_DOCS, fit_tokens: int = FIT_TOKENS, steps: int = 200) -> dict:
    """The field's potentials, from the base spans of at most ``fit_docs``
    documents and ``fit_tokens`` of their tokens.

    Unary weights are a softmax regression on the features; chain and skip
    potentials are smoothed log ratios of how often two joined tokens have two
    kinds to how often they would by chance."""
    n = docs.count()
    sampled = docs if n <= fit_docs else drawn(docs, fit_docs / n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            nodes, pairs, kinds = Nodes(), defaultdict(int), defaultdict(int)

            def counted(nodes: Nodes, pairs: dict = pairs, kinds: dict = kinds) -> None:
                # a bare mention of what a pattern matched elsewhere is no evidence that its form is none of the kinds
                for name, edges in (("chain", nodes.chain), ("skip", nodes.again)):
                    for i, j in edges:
                        if i not in nodes.bare and j not in nodes.bare:
                            pairs[f"{name} {nodes.label[i]} {nodes.label[j]}"] += 1
                for i, (f, k, own) in enumerate(zip(nodes.features, nodes.label, nodes.own, strict=True)):
                    if own and i not in nodes.bare:
                        kinds["\t".join(f), k] += 1

            for i, t in enumerate(b.column("text").to_pylist()):
                if t:
                    for full in nodes.windows(i, t, base(t), WINDOW):
                        counted(full)
                    if len(nodes.at) >= WINDOW:
                        counted(nodes.taken())
            counted(nodes)
            rows = [(f, k, c) for (f, k), c in kinds.items()] + [(p, -1, c) for p, c in pairs.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.int64())], ["f", "k", "n"])

    seen = sampled.select("text").mapInArrow(run, "f string, k int, n long").groupBy("f", "k").agg(F.sum("n").alias("n"))
    seen = cut(seen, "tokens")
    share = fit_tokens / max(1, seen.count())
    rows = seen.filter((F.col("k") < 0) | (uniform("f", "k", seed=4) < share)).orderBy("f", "k").collect()
    labels = len(KINDS) + 1
    pair = {"chain": np.full((labels, labels), 0.5), "skip": np.full((labels, labels), 0.5)}
    for f, k, c in rows:
        if k < 0:
            name, i, j = f.split(" ")
            pair[name][int(i), int(j)] += c
            pair[name][int(j), int(i)] += c
    found = [(f.split("\t"), k, c) for f, k, c in rows if k >= 0]
    names = {f: i for i, f in enumerate(sorted({x for f, _, _ in found for x in f}))}
    w = np.zeros((len(names) + 1, labels))
    if found:
        width = max(len(f) for f, _, _ in found)
        x = np.full((len(found), width), len(names))
        for r, (f, _, _) in enumerate(found):
            x[r, : len(f)] = [names[v] for v in f]
        y, c = np.array([k for _, k, _ in found]), np.array([c for _, _, c in found], dtype=np.float64)
        # each kind weighs alike in sum, so that rare kinds are learnt
        c *= (1 / np.maximum(np.bincount(y, weights=c, minlength=labels), 1))[y]
        grad2 = np.full(w.shape, 1e-8)
        for _ in range(steps):
            z = w[x].sum(axis=1)
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(y)), y] -= 1
            g = np.zeros_like(w)
            for col in range(width):
                np.add.at(g, x[:, col], p * c[:, None])
            g += 1e-4 * w
            g[-1] = 0
            grad2 += g * g
            w -= 0.5 * g / np.sqrt(grad2)
    ratio = {}
    for name, m in pair.items():
        m = m / m.sum()
        by = m.sum(axis=1)
        ratio[name] = np.clip(np.log(m / np.outer(by, by)), -4, 4)
    # a token like one of a kind is of that kind, also where the sample has no such pair
    ratio["skip"] = np.maximum(ratio["skip"], np.where(np.eye(labels, dtype=bool), 2.0, -4.0))
    # no token of a form that the sample lacks is given a kind by its form alone
    return {"names": names, "unary": w, "none": 3.0, **ratio}


def beliefs(nodes: Nodes, model: dict, rounds: int = ROUNDS) -> np.ndarray:
    """Each token's belief in each label after loopy sum-product passing."""
    n, labels = len(nodes.at), len(KINDS) + 1
    names = model["names"]
    unary = np.zeros((n, labels))
    for i, f in enumerate(nodes.features):
        known = [names[x] for x in f if x in names]
        unary[i] = model["unary"][known].sum(axis=0)
    unary[:, 0] += model["none"]
    label = np.array(nodes.label, dtype=np.int64)
    sure = np.flatnonzero(label)
    unary[sure] = -30.0
    unary[sure, label[sure]] = 0.0
    edges = np.array(nodes.chain + nodes.skip, dtype=np.int64).reshape(-1, 2)
    if len(edges):
        m, chains = len(edges), len(nodes.chain)
        # both directions: message e goes from src[e] to dst[e], its reverse is e + m; a potential for each kind and direction
        pots = np.stack([model["chain"], model["skip"], model["chain"].T, model["skip"].T])
        kind = (np.arange(m) >= chains).astype(np.int8)
        kind = np.concatenate([kind, kind + 2])
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        msg = np.zeros((2 * m, labels))
        received = lambda msg: np.stack([np.bincount(dst, weights=msg[:, c], minlength=n) for c in range(labels)], axis=1)
        for _ in range(rounds):
            total = unary + received(msg)
            new = np.empty_like(msg)
            for at in range(0, 2 * m, EDGES):
                some = slice(at, at + EDGES)
                z = (total[src[some]] - msg[back[some]])[:, :, None] + pots[kind[some]]
                top = z.max(axis=1)
                part = top + np.log(np.exp(z - top[:, None, :]).sum(axis=1))
                new[some] = part - part.max(axis=1, keepdims=True)
            msg = DAMPING * new + (1 - DAMPING) * msg
        unary += received(msg)
    p = np.exp(unary - unary.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def found(texts: list[str], model: dict, window: int = WINDOW) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text, by kind, then start. Tokens are
    inferred in windows of about ``window``, so memory doesn't follow a text."""
    bases, more = [base(t) for t in texts], defaultdict(list)
    nodes = Nodes()
    for i, (t, spans) in enumerate(zip(texts, bases, strict=True)):
        if any("0" <= c <= "9" for c in t) or "@" in t:
            for full in nodes.windows(i, t, spans, window):
                infer(texts, full, model, more)
            if len(nodes.at) >= window:
                infer(texts, nodes.taken(), model, more)
    infer(texts, nodes, model, more)
    order = {k: i for i, k in enumerate(KINDS)}
    return [(s, sorted(s + more[i], key=lambda x: (order[x[0]], x[1]))) for i, s in enumerate(bases)]


def infer(texts: list[str], nodes: Nodes, model: dict, more: dict[int, list]) -> None:
    """Add to ``more`` the spans that the field finds among some nodes."""
    if not nodes.at:
        return
    p = beliefs(nodes, model)
    kind = p.argmax(axis=1)
    picked = np.flatnonzero((kind > 0) & (p.max(axis=1) >= SURE) & (np.array(nodes.label) == 0) & np.array(nodes.own))
    last = None
    for i in picked.tolist():
        d, (a, b), k = nodes.doc[i], nodes.at[i], KINDS[kind[i] - 1]
        t = texts[d]
        while a < b and t[a] in ".,;:!?\"'[]<>":
            a += 1
        while b > a and t[b - 1] in ".,;:!?\"'[]<>":
            b -= 1
        if k != "email" and re.search(r"[^\W\d_]", t[a:b]):  # without the letters around a number
            a, b = max(((a + m.start(), a + m.end()) for m in RUN.finditer(t[a:b])), key=lambda x: x[1] - x[0], default=(a, b))
        run = more[d]
        if run and last == i - 1 and run[-1][0] == k and a - run[-1][2] <= 2:
            run[-1] = (k, run[-1][1], b)
        elif a < b:
            run.append((k, a, b))
        last = i


def detect(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone`` (base spans), ``base`` and
    ``spans`` (kind:start:end, comma-joined; code points, end exclusive).

    Null text as empty; whole texts, in time that follows their length and
    memory for a window of their tokens; repeated rows stay rows; other columns
    are not used; no rows give no rows."""
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = found([t or "" for t in b.column("text").to_pylist()], model)
            n = [pa.array([sum(x[0] == k for x in s) for s, _ in got], pa.int64()) for k in KINDS]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *n, pa.array([joined(s) for s, _ in got], pa.string()), pa.array([joined(s) for _, s in got], pa.string())], ["doc_id", *[f"n_{k}" for k in KINDS], "base", "spans"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string")


def masked(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in angle brackets; of
    overlapping spans the first, then the longest, names the whole."""
    out, at, name = [], 0, None
    for k, a, b in sorted(spans, key=lambda x: (x[1], -x[2])):
        if name is None or a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
            name = k
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, model: dict | None = None) -> DataFrame:
    """``docs`` with the found spans of ``text`` masked. A null text stays null,
    an empty one empty; other columns, whatever their names, and repeated rows
    stay as they are; no rows give no rows; long texts as in ``detect``."""
    model = model or fit(docs)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = b.column(at).to_pylist()
            got = found([t or "" for t in texts], model)
            new = [t if t is None else masked(t, s) for t, (_, s) in zip(texts, got, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, pa.string()) if i == at else c for i, c in enumerate(b.columns)], b.schema.names)

    return docs.mapInArrow(run, docs.schema)
