"""Language-model scoring over a subword lattice.

A word's lattice has an edge for each piece of an existing vocabulary that
fits, for each character spelled by its bytes, and, if the training text holds
the word, one edge over it all. The pieces start from the scores that stand in
the vocabulary's file and are weighed by the training words (expected counts
over all segmentations); a word edge weighs its count less DISCOUNT, and what
the discounts leave goes to the pieces, so that all texts' probabilities sum
to one. A text's probability is the sum over all segmentations, by a forward
recursion in log space. Edges don't cross words, so each distinct word is
summed once, however often it occurs."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanalign.llm.common import cut
from spanalign.llm.textops import LOWER, mixed, raw, slices, span_hashes, words

#: Vocabulary file (a SentencePiece model), read on the driver.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Passes over the training words that re-weigh the pieces; what is added to every piece's expected count.
PASSES, SMOOTH = 2, 0.01
#: Taken off the count of each word edge.
DISCOUNT = 0.75
#: A word that makes up at least 1 / FREQUENT of all words is looked up in the tasks, by hash: at most FREQUENT words of
#: 32 bytes each, however long they are, are sent there, whatever the input. All others are joined.
FREQUENT = 1 << 20
#: Marks a word's start in the vocabulary.
MARK = "▁"
#: Added to the code point of a mark that is a character of its word; beyond all code points.
ASIDE = 0x110000
#: Lattice cells worked on at once.
CELLS = 1 << 19
#: A longer word (in characters) is summed place by place over blocks of its lattice, which isn't held whole.
LONG = 1 << 13


class Vocabulary:
    """Pieces by hash. Pieces 0 to 255 are the single bytes: any character can
    be spelled by its bytes, so every text has a segmentation."""

    def __init__(self, pieces: list[str], scores: np.ndarray) -> None:
        self.pieces, self.scores = pieces, scores
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        self.longest = int(lengths.max(initial=1))
        h = np.zeros(len(pieces), dtype=np.uint64)
        for n in np.unique(lengths):
            some = np.flatnonzero(lengths == n)
            points = np.frombuffer("".join(pieces[i] for i in some).encode("utf-32-le"), dtype=np.uint32).reshape(-1, n)
            part = np.zeros(len(some), dtype=np.uint64)
            for k in range(n):
                part = self.push(part, points[:, k])
            h[some] = mixed(part)
        self.tables = []  # each: shift factor, hash of a slot, piece of a slot; what collides goes to the next
        left = np.arange(len(h))
        factor = 0x9E3779B97F4A7C15
        while len(left):
            slot = self.slots(h[left], factor)
            _, keep = np.unique(slot, return_index=True)
            key, number = np.zeros(1 << 18, dtype=np.uint64), np.full(1 << 18, -1, dtype=np.int32)
            key[slot[keep]], number[slot[keep]] = h[left[keep]], left[keep] + 256
            self.tables.append((factor, key, number))
            left = np.delete(left, keep)
            factor = factor * 0xD1342543DE82EF95 % (1 << 64) | 1

    @staticmethod
    def push(h: np.ndarray, points: np.ndarray) -> np.ndarray:
        return h * np.uint64(0x5851F42D4C957F2D) + points.astype(np.uint64) + np.uint64(1)

    @staticmethod
    def slots(h: np.ndarray, factor: int) -> np.ndarray:
        return ((h * np.uint64(factor)) >> np.uint64(46)).astype(np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece number of each hash, or -1."""
        out = np.full(h.shape, -1, dtype=np.int32)
        for factor, key, number in self.tables:
            slot = self.slots(h, factor)
            out = np.where((number[slot] >= 0) & (key[slot] == h), number[slot], out)
        return out

    @staticmethod
    def load(path: str) -> Vocabulary:
        """The file's pieces with start probabilities from its scores.

        Scores of merge-based files are minus the rank of the merge; read as
        1 / (2 + rank) they weigh pieces as ranked words are weighed. Pieces
        that stand for nothing in a text (controls, unknown) are left out."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        every = [i for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        scores = np.array([max(sp.get_score(i), -1e6) for i in every])
        rank = np.minimum(-scores, 1e6) if scores.min(initial=0) < -50 else np.expm1(-scores)
        pieces, weight = [sp.id_to_piece(i) for i in every], 1 / (2 + rank)
        if MARK not in pieces:
            pieces, weight = [*pieces, MARK], np.append(weight, 1e-6)
        weight = np.concatenate([np.full(256, 1e-6), weight])
        return Vocabulary(pieces, weight / weight.sum())


def lattices(texts: list[str], vocabulary: Vocabulary) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For words of one length at a time: their numbers, the piece from each
    start over each length (words x length x start; -1: none), and the code
    points (words x place)."""
    by_length: dict[int, list[int]] = {}
    for i, w in enumerate(texts):
        by_length.setdefault(len(w) + 1, []).append(i)
    for n, every in sorted(by_length.items()):
        most = min(n, vocabulary.longest)
        step = max(1, CELLS // (n * most))
        for at in range(0, len(every), step):
            some = every[at : at + step]
            points = np.frombuffer("".join(MARK + texts[i] for i in some).encode("utf-32-le"), dtype=np.uint32).reshape(-1, n)
            # a mark inside a word is a character to spell, not a word's start
            points = np.where((points == ord(MARK)) & (np.arange(n) > 0), points + np.uint32(ASIDE), points)
            piece = np.full((len(some), most, n), -1, dtype=np.int32)
            h = np.zeros((len(some), n), dtype=np.uint64)
            for k in range(most):
                h = Vocabulary.push(h[:, : n - k], points[:, k:])
                piece[:, k, : n - k] = vocabulary.find(mixed(h))
            yield np.array(some), piece, points


def byte_scores(points: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of each code point spelled by its bytes, and those
    bytes (4 of them, -1: none). A word's start isn't spelled: it is the mark."""
    kinds, of = np.unique(points, return_inverse=True)
    spelled = np.full((len(kinds), 4), -1, dtype=np.int64)
    for i, c in enumerate(kinds.tolist()):
        code = chr(c - ASIDE if c >= ASIDE else c).encode()
        spelled[i, : len(code)] = list(code)
    value = np.where(spelled >= 0, log_p[spelled], 0.0).sum(axis=1)
    log, each = value[of].reshape(points.shape), spelled[of].reshape(*points.shape, 4)
    log[:, 0], each[:, 0] = -np.inf, -1
    return log, each


def forward(piece: np.ndarray, spell: np.ndarray, log_p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """alpha (words x place): log probability of all segmentations up to each
    place; and the edges' log probabilities (words x length x start)."""
    m, most, n = piece.shape
    edge = np.where(piece >= 0, log_p[piece], -np.inf)
    edge[:, 0, :] = np.logaddexp(edge[:, 0, :], spell)
    alpha = np.full((m, n + 1), -np.inf)
    alpha[:, 0] = 0.0
    for j in range(1, n + 1):
        k = np.arange(min(most, j))
        terms = alpha[:, j - 1 - k] + edge[:, k, j - 1 - k]
        top = terms.max(axis=1)
        alpha[:, j] = top + np.log(np.exp(terms - top[:, None]).sum(axis=1))
    return alpha, edge


class LongWord:
    """The lattice of one long word, made block by block."""

    def __init__(self, text: str, vocabulary: Vocabulary, log_p: np.ndarray, block: int = 0) -> None:
        self.vocabulary, self.log_p = vocabulary, log_p
        points = np.frombuffer((MARK + text).encode("utf-32-le"), dtype=np.uint32)
        self.points = np.where((points == ord(MARK)) & (np.arange(len(points)) > 0), points + np.uint32(ASIDE), points)
        self.n, self.most = len(points), min(len(points), vocabulary.longest)
        self.block = block or max(1, CELLS // self.most)

    def parts(self, backwards: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For each block of starts: the first, the pieces (length x start), the
        edges' log probabilities, the characters' own and their bytes."""
        starts = range(0, self.n, self.block)
        for a in reversed(starts) if backwards else starts:
            width = min(self.block, self.n - a)
            near = self.points[a : a + width + self.most]
            piece, h = np.full((self.most, width), -1, dtype=np.int32), np.zeros(width, dtype=np.uint64)
            for k in range(self.most):
                if (m := min(width, len(near) - k)) <= 0:
                    break
                h = Vocabulary.push(h[:m], near[k : k + m])
                piece[k, :m] = self.vocabulary.find(mixed(h))
            spell, spelled = byte_scores(near[None, :width], self.log_p)
            if a:  # only the word's start is a mark that isn't spelled
                spell[:, :1], spelled[:, :1] = (x[:, 1:] for x in byte_scores(np.append(near[:1], near[:1])[None], self.log_p))
            edge = np.where(piece >= 0, self.log_p[piece], -np.inf)
            edge[0] = np.logaddexp(edge[0], spell[0])
            yield a, piece, edge, spell[0], spelled[0]

    def forward(self) -> np.ndarray:
        alpha = np.full(self.n + 1, -np.inf)
        alpha[0] = 0.0
        for a, _, edge, _, _ in self.parts():
            for i in range(edge.shape[1]):
                m = min(self.most, self.n - a - i)
                to = alpha[a + i + 1 : a + i + 1 + m]
                np.logaddexp(to, alpha[a + i] + edge[:m, i], out=to)
        return alpha

    def backward(self) -> np.ndarray:
        beta = np.full(self.n + 1, -np.inf)
        beta[self.n] = 0.0
        for a, _, edge, _, _ in self.parts(backwards=True):
            for i in reversed(range(edge.shape[1])):
                m = min(self.most, self.n - a - i)
                beta[a + i] = np.logaddexp.reduce(beta[a + i + 1 : a + i + 1 + m] + edge[:m, i])
        return beta

    def expected(self, count: float) -> np.ndarray:
        alpha, beta, total = self.forward(), self.backward(), np.zeros(len(self.log_p))
        for a, piece, _, spell, spelled in self.parts():
            for k in range(self.most):
                m = min(piece.shape[1], self.n - a - k)
                if m <= 0:
                    break
                outside = alpha[a : a + m] + beta[a + k + 1 : a + k + 1 + m] - alpha[self.n]
                on = piece[k, :m] >= 0
                total += np.bincount(piece[k, :m][on], weights=np.exp(outside[on] + self.log_p[piece[k, :m][on]]) * count, minlength=len(total))
                if k == 0:
                    post = np.exp(outside + spell) * count
                    for b in range(4):
                        on = spelled[:, b] >= 0
                        total += np.bincount(spelled[on, b], weights=post[on], minlength=len(total))
        return total


def log_words(texts: list[str], vocabulary: Vocabulary, log_p: np.ndarray) -> np.ndarray:
    """Natural log of each word's marginal probability."""
    out = np.zeros(len(texts))
    short = np.array([i for i, t in enumerate(texts) if len(t) <= LONG], dtype=np.int64)
    for some, piece, points in lattices([texts[i] for i in short], vocabulary):
        alpha, _ = forward(piece, byte_scores(points, log_p)[0], log_p)
        out[short[some]] = alpha[:, -1]
    for i in np.setdiff1d(np.arange(len(texts)), short):
        out[i] = LongWord(texts[i], vocabulary, log_p).forward()[-1]
    return out


def expected(texts: list[str], count: np.ndarray, vocabulary: Vocabulary, log_p: np.ndarray) -> np.ndarray:
    """How often each piece is expected in all segmentations of the words, by
    forward and backward sums."""
    total = np.zeros(len(log_p))
    for t, n in zip(texts, count.tolist(), strict=True):
        if len(t) > LONG:
            total += LongWord(t, vocabulary, log_p).expected(n)
    short = [len(t) <= LONG for t in texts]
    texts, count = [t for t, on in zip(texts, short, strict=True) if on], count[np.array(short, dtype=bool)]
    for some, piece, points in lattices(texts, vocabulary):
        spell, spelled = byte_scores(points, log_p)
        alpha, edge = forward(piece, spell, log_p)
        m, most, n = piece.shape
        beta = np.full((m, n + 1), -np.inf)
        beta[:, n] = 0.0
        for i in range(n - 1, -1, -1):
            k = np.arange(min(most, n - i))
            terms = beta[:, i + 1 + k] + edge[:, k, i]
            top = terms.max(axis=1)
            beta[:, i] = top + np.log(np.exp(terms - top[:, None]).sum(axis=1))
        base = alpha[:, -1:]
        for k in range(most):
            outside = alpha[:, : n - k] + beta[:, k + 1 :] - base
            got = piece[:, k, : n - k]
            on = got >= 0
            post = np.exp(outside[on] + log_p[got[on]]) * np.broadcast_to(count[some][:, None], got.shape)[on]
            total += np.bincount(got[on], weights=post, minlength=len(log_p))
            if k == 0:
                post = np.exp(outside + spell) * count[some][:, None]
                for b in range(4):
                    on = spelled[:, :, b] >= 0
                    total += np.bincount(spelled[:, :, b][on], weights=post[on], minlength=len(log_p))
    return total


def held_out() -> F.Column:
    return F.crc32(F.encode(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "UTF-8")) % 5 == 1


def count_words(docs: DataFrame) -> DataFrame:
    """``word, c, every``: how often each word occurs in the training texts and
    in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, most=1 << 24):
            train, rest = Counter(), Counter()
            for t, out in zip(b.column("text").to_pylist(), b.column("held_out").to_pylist(), strict=True):
                if t:
                    (rest if out else train).update(t.encode().lower().split())
            both = list(train.keys() | rest.keys())
            yield pa.RecordBatch.from_arrays([pa.array(both, pa.binary()).cast(pa.string()), pa.array([train[w] for w in both], pa.int64()), pa.array([train[w] + rest[w] for w in both], pa.int64())], ["word", "c", "every"])

    part = docs.select("text", held_out().alias("held_out")).mapInArrow(run, "word string, c long, every long")
    return part.groupBy("word").agg(F.sum("c").alias("c"), F.sum("every").alias("every"))


def train(counted: DataFrame, vocabulary: Vocabulary, passes: int = PASSES) -> np.ndarray:
    """Log probability of each piece, learnt from all distinct training words
    (the pieces are there for words not seen, so a word counts once): each
    pass sums the expected counts in the tasks, and a row a piece comes to the
    driver. Pieces that start words and pieces that go on sum to one, and so
    do the words' probabilities."""
    log_p = np.log(vocabulary.scores)
    n = len(log_p)
    pieces, scores = vocabulary.pieces, vocabulary.scores
    for _ in range(passes):

        def run(batches: Iterator[pa.RecordBatch], log_p: np.ndarray = log_p) -> Iterator[pa.RecordBatch]:
            vocabulary, total = Vocabulary(pieces, scores), np.zeros(n)
            for b in slices(batches, "word"):
                total += expected(b.column("word").to_pylist(), np.ones(b.num_rows), vocabulary, log_p)
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["piece", "n"])

        rows = counted.filter("c > 0").select("word").mapInArrow(run, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        count = np.full(n, SMOOTH)
        count[rows["piece"].to_numpy(dtype=np.int64)] += rows["n"].to_numpy(dtype=np.float64)
        log_p = np.log(count / count.sum())
    return log_p


def score(docs: DataFrame, model: str = MODEL, passes: int = PASSES) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``
    for each row of ``docs(doc_id, text)``.

    Documents whose crc32 of the id modulo 5 is 1 are held out of all that is
    learnt (a null id counts as the empty string). A-Z is lower-cased; tokens
    are words and one end. ``base_score`` is the plain smoothed word model,
    ``score`` the lattice model's log10 probability of the same
    tokens. Null text as empty; repeated rows stay rows; other columns are
    not used; without training text all pieces weigh alike; a word of any
    length is summed in memory of some 50 bytes a character."""
    vocabulary = Vocabulary.load(model)
    counted = cut(count_words(docs), "words")
    ends = docs.filter(~held_out()).count()
    tokens, kinds, every = counted.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0), F.coalesce(F.sum("every"), F.lit(0))).first()
    n, v = tokens + ends, kinds + (ends > 0)
    below = math.log10(n + 0.5 * (v + 1))
    log_p = train(counted, vocabulary, passes)
    # events: the words, the ends, and one more of each, so that neither is impossible without training text
    events, left = tokens + ends + 2, DISCOUNT * kinds + 1
    pieces, scores = vocabulary.pieces, vocabulary.scores

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(pieces, scores)
        for b in slices(batches, "word"):
            c = b.column("c").to_numpy(zero_copy_only=False).astype(np.float64)
            parts = log_words(b.column("word").to_pylist(), vocabulary, log_p) + math.log(left)
            whole = np.log(np.maximum(c - DISCOUNT, 1e-300))
            lattice = (np.logaddexp(parts, np.where(c > 0, whole, -np.inf)) - math.log(events)) / math.log(10)
            base = np.log10(c + 0.5) - below
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(base), pa.array(lattice)], ["word", "c", "every", "base", "lattice"])

    priced = cut(counted.mapInArrow(price, "word string, c long, every long, base double, lattice double"), "priced")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = raw(b.column("word"))
            h = span_hashes(data, offsets[:-1], offsets[1:]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h), *(b.column(c) for c in ("c", "base", "lattice"))], ["h", "c", "base", "lattice"])

    common = priced.filter(F.col("every") * FREQUENT >= every).mapInArrow(hashed, "h long, c long, base double, lattice double").toPandas()
    h = common["h"].to_numpy(dtype=np.int64).view(np.uint64)
    order = np.argsort(h)
    h = np.append(h[order], np.uint64(2**64 - 1))  # so that a search always lands on an entry
    known, base, lattice = ((np.append(common[c].to_numpy(dtype=np.float64)[order], 0.0)) for c in ("c", "base", "lattice"))
    known = known > 0
    kind = docs.schema["doc_id"].dataType.simpleString()
    end_base, end_score = math.log10(ends + 0.5) - below, math.log10((ends + 1) / events)

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            data, offsets = raw(b.column("text"))
            data, m = LOWER[data], b.num_rows
            starts, ends_, doc = words(data, offsets)
            got = span_hashes(data, starts, ends_)
            at = np.searchsorted(h[:-1], got)
            hit = h[at] == got
            add = lambda x: np.bincount(doc[hit], weights=x[at[hit]], minlength=m)  # noqa: E731, B023
            rest, rest_doc = np.flatnonzero(~hit), doc[~hit]
            by = np.lexsort((got[rest], rest_doc))
            rest, rest_doc = rest[by], rest_doc[by]
            new = np.flatnonzero(np.concatenate([[True], (got[rest][1:] != got[rest][:-1]) | (rest_doc[1:] != rest_doc[:-1])])) if len(rest) else np.zeros(0, dtype=np.int64)
            times = np.diff(np.append(new, len(rest)))
            one = rest[new]
            text = data.tobytes()
            pairs = pa.StructArray.from_arrays([pa.array([text[i:j] for i, j in zip(starts[one].tolist(), ends_[one].tolist(), strict=True)], pa.binary()).cast(pa.string()), pa.array(times.astype(np.int64))], ["word", "n"])
            cuts = np.searchsorted(rest_doc[new], np.arange(m + 1)).astype(np.int32)
            columns = [b.column("doc_id"), b.column("held_out"), pa.array(np.bincount(doc, minlength=m) + 1), pa.array(add(known.astype(np.float64)).astype(np.int64)), pa.array(add(base)), pa.array(add(lattice)), pa.ListArray.from_arrays(pa.array(cuts), pairs)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "n_tokens", "n_known", "base", "lattice", "rest"])

    found = docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(look_up, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, lattice double, rest array<struct<word:string,n:long>>")
    found = cut(found.withColumn("_row", F.monotonically_increasing_id()), "looked-up")  # written, so that the numbers stay
    pairs = found.select("_row", F.explode("rest").alias("x")).select("_row", "x.word", "x.n")
    more = pairs.join(priced, "word").groupBy("_row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("_k"), F.sum(F.col("n") * F.col("base")).alias("_b"), F.sum(F.col("n") * F.col("lattice")).alias("_l"))
    out = found.drop("rest").join(more, "_row", "left")
    plus = lambda a, b, c: (F.col(a) + F.coalesce(F.col(b), F.lit(0)) + F.lit(c))
    return out.select("doc_id", "held_out", "n_tokens", plus("n_known", "_k", int(ends > 0)).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"), plus("base", "_b", end_base).alias("base_score"), plus("lattice", "_l", end_score).alias("score"))
