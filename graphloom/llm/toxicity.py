"""Toxicity: a support vector machine over a gapped subsequence kernel with Nystroem landmarks, trained on sentences of labelled documents.

The kernel of two words sums over all subsequences of three characters that lie within six, start and end of the word counted as
characters; each occurrence weighs GAP to the number of skipped characters. So an insult with characters put in, or cut by marks, still
shares most of its subsequences with the plain one. The kernel is divided by both words' norms, and cubed, so that chance overlap
counts next to nothing. The kernel of two sentences is the sum over their pairs of different words; letters spelled
out one by one are read as a word as well.

Landmarks are words: those that tell toxic from clean documents most, none too like another, and the most frequent clean words. A
sentence becomes its kernels with them, whitened by their kernel matrix (Nystroem). Labels are of documents, so training goes by rounds:
a document stands for its highest sentences under the machine so far, toxic documents by the newest and those near it, clean ones by one of
each round.
A document's score is that of its highest sentences, the first and the next three, made a probability on training documents that the
machine hasn't seen. As the machine is linear over words, a word's share is one number, kept by its hash while a worker lives.

Training reads at most MAX_EACH documents of each label, those of smallest xxhash64(doc_id), whole; scoring reads everything.

Defined cases: null and empty texts score as a sentence without words; of repeated labels of one document the lowest known one counts,
of repeated rows of a labelled document the smallest text; null labels count not at all; without labels of both kinds every score is the
share of toxic labels, (0 + 1) / (0 + 2) without any; an empty table gives no rows; further columns are ignored. Texts of more than
PIECE characters are read in pieces cut at white space; sentences of more than SENTENCE words are cut there.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from .common import keep, materialize, mix, range_hashes, shuffle_partitions, tidy

MAX_EACH = 4000
LANDMARKS, BACKGROUND = 192, 64
ROUNDS = 3
LEAST_TELLS = 20.0  # documents times log ratio, under which a word is no landmark
THRESHOLD = 0.7
SENTENCE = 40
TOP = 4  # sentences that a document's score counts
CLEAR = 0.5
PIECE = 1 << 20
KEPT_WORDS = 1_000_000
GAP, SPAN, POWER = 0.5, 6, 3
#: Offsets of the second and third character of a subsequence, and its weight.
_OFFSETS = [(i, j, GAP ** (j - 2)) for j in range(2, SPAN) for i in range(1, j)]

# Characters in 64 classes: 0 none, 1 and 2 start and end of a word, letters, digits, the rest by a hash.
_CLASS = np.zeros(0x110000, dtype=np.uint8)
_CLASS[:] = 39 + (mix(np.arange(0x110000, dtype=np.uint64)) % np.uint64(25)).astype(np.uint8)
_CLASS[97:123] = np.arange(3, 29)
_CLASS[65:91] = np.arange(3, 29)
_CLASS[48:58] = np.arange(29, 39)
_MARK = np.zeros(0x110000, dtype=bool)
_MARK[:128] = True
_MARK[97:123] = _MARK[65:91] = _MARK[48:58] = False
_MARK[[0x2018, 0x2019, 0x201C, 0x201D, 0x2026, 0xAB, 0xBB]] = True
_SPACES = np.zeros(0x110000, dtype=bool)
_SPACES[[32, 9, 10, 11, 12, 13, 0x85, 0xA0]] = True
_STOP = np.zeros(0x110000, dtype=bool)
_STOP[[33, 46, 63]] = True


def pieces(text: str) -> list[str]:
    """A text in parts of at most PIECE characters, cut at white space where there is some."""
    out = []
    while len(text) > PIECE:
        at = max(text.rfind(" ", 0, PIECE), text.rfind("\n", 0, PIECE))
        at = at if at > 0 else PIECE
        out.append(text[:at])
        text = text[at:]
    return [*out, text]


class Sentences:
    """The words of some texts, classes of their characters side by side, and the sentence and text of each word.

    chars: classes, one start and one end around every word. begin: word i is chars[begin[i]:begin[i + 1]]. hashes: of each word.
    sentence: number of each word's sentence, in order. of_text: text of each sentence.
    """

    def __init__(self, texts: list[str]):
        joined = np.frombuffer((" \n".join(t.lower() for t in texts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        size = np.array([len(t.lower()) + 2 for t in texts])
        text_begin = np.concatenate(([0], np.cumsum(size)))[:-1]
        space = _SPACES[joined]
        edge = np.diff(space.astype(np.int8), prepend=np.int8(1))
        starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        # Marks around a word go; a word of marks alone is none.
        solid = np.flatnonzero(~space & ~_MARK[joined])
        first, last = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
        some = last > first
        # A sentence ends with a word that a stop follows, with a line, and with its text.
        stop = np.concatenate(([0], np.cumsum(_STOP[joined])))
        line = np.concatenate(([0], np.cumsum(joined == 10)))
        low, high = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        low[some], high[some] = solid[first[some]], solid[last[some] - 1] + 1
        low[~some], high[~some] = ends[~some], ends[~some]
        ended = (stop[ends] > stop[high]) | (~some & (stop[ends] > stop[starts]))
        following = np.append(starts[1:], len(joined) - 1) if len(starts) else starts
        ended |= line[following] > line[ends]
        number = np.concatenate(([0], np.cumsum(ended)))[: len(starts)]
        starts, ends, number = low[some], high[some], number[some]
        text = np.searchsorted(text_begin, starts, side="right") - 1
        # Letters spelled out one by one, three or more, are a word too, in the sentence of the first.
        single = ends - starts == 1
        change = np.flatnonzero(np.diff(np.where(single, text + 1, 0), prepend=0, append=0))
        runs = [(a, b) for a, b in zip(change[:-1].tolist(), change[1:].tolist(), strict=True) if b - a >= 3 and single[a]]
        lengths = np.concatenate((ends - starts, np.array([b - a for a, b in runs], dtype=np.int64)))
        self.begin = np.concatenate(([0], np.cumsum(lengths + 2)))
        at = np.arange(self.begin[-1]) - np.repeat(self.begin[:-1], lengths + 2)
        n = len(starts)
        self.chars = np.zeros(self.begin[-1], dtype=np.uint8)
        head = self.begin[n]
        inner = (at > 0) & (at <= np.repeat(lengths, lengths + 2))
        source = np.repeat(starts, lengths[:n] + 2) + at[:head] - 1
        self.chars[:head][inner[:head]] = _CLASS[joined[source[inner[:head]]]]
        for k, (a, b) in enumerate(runs):
            self.chars[self.begin[n + k] + 1 : self.begin[n + k + 1] - 1] = _CLASS[joined[starts[a:b]]]
        self.chars[self.begin[:-1]], self.chars[self.begin[1:] - 1] = 1, 2
        place = np.arange(n)
        fresh = np.concatenate(([True], (number[1:] != number[:-1]) | (text[1:] != text[:-1]))) if n else np.zeros(0, bool)
        since = place - np.maximum.accumulate(np.where(fresh, place, 0)) if n else place
        fresh |= (since % SENTENCE) == 0
        sentence = np.cumsum(fresh) - 1
        self.of_text = text[fresh]
        self.sentence = np.concatenate((sentence, sentence[[a for a, _ in runs]])) if runs else sentence
        self.hashes = range_hashes(self.chars, self.begin[:-1], self.begin[1:])


def occurrences(chars: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, code, weight) of every subsequence of words chars[begin[i]:begin[i + 1]]."""
    end = np.repeat(begin[1:], np.diff(begin))
    word = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    place = np.arange(len(chars))
    padded = np.concatenate((chars.astype(np.int32), np.zeros(SPAN, np.int32)))
    out = []
    for i, j, weight in _OFFSETS:
        p = place[place + j < end]
        out.append((word[p], (padded[p] << 12) | (padded[p + i] << 6) | padded[p + j], np.full(len(p), weight, np.float32)))
    w, c, x = (np.concatenate([o[k] for o in out]) for k in range(3))
    return w, c, x


def side_by_side(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of some words, and where each begins."""
    return np.frombuffer(b"".join(words), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int64)


def norms(word: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """The root of each of n words' kernel with itself: occurrences of one subsequence add up first."""
    key = np.sort(((word.astype(np.int64) << 18 | code) << 2) | np.rint(-np.log2(weight)).astype(np.int64))
    same = key >> 2
    first = np.flatnonzero(np.diff(same, prepend=-1))
    total = np.add.reduceat(GAP ** (key & 3).astype(float), first) if len(key) else np.zeros(0)
    return np.sqrt(np.maximum(1e-9, np.bincount(same[first] >> 18, weights=total**2, minlength=n)))


@dataclass
class Kernel:
    """Kernels of words with the landmarks: for every subsequence that landmarks have, which of them and how much."""

    landmarks: list[bytes]
    row: np.ndarray = field(init=False)
    begin: np.ndarray = field(init=False)
    column: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        chars, begin = side_by_side(self.landmarks)
        word, code, weight = occurrences(chars, begin)
        pair, of = np.unique(code.astype(np.int64) * len(self.landmarks) + word, return_inverse=True)
        self.column = (pair % max(1, len(self.landmarks))).astype(np.int64)
        self.value = np.bincount(of, weights=weight) / norms(word, code, weight, len(self.landmarks))[self.column] if len(pair) else np.zeros(0)
        codes, first = np.unique(pair // max(1, len(self.landmarks)), return_index=True)
        self.begin = np.append(first, len(pair)).astype(np.int64)
        self.row = np.full(1 << 18, -1, dtype=np.int32)
        self.row[codes] = np.arange(len(codes))

    def rows(self, chars: np.ndarray, begin: np.ndarray, at_once: int = 40_000) -> np.ndarray:
        """A row of kernels for every word, about at_once characters in one step."""
        m = len(self.landmarks)
        out = np.zeros((len(begin) - 1, m), dtype=np.float32)
        a = 0
        while a < len(begin) - 1:
            b = max(a + 1, int(np.searchsorted(begin, begin[a] + at_once, side="right")) - 1)
            word, code, weight = occurrences(chars[begin[a] : begin[b]], begin[a : b + 1] - begin[a])
            row = self.row[code]
            some = np.flatnonzero(row >= 0)
            for c in range(0, len(some), 1_000_000):
                part = some[c : c + 1_000_000]
                at, n = self.begin[row[part]], np.diff(self.begin)[row[part]]
                entry = np.repeat(at - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
                out[a:b] += np.bincount(np.repeat(word[part] * m, n) + self.column[entry], weights=np.repeat(weight[part], n) * self.value[entry], minlength=(b - a) * m).reshape(b - a, m)
            out[a:b] /= norms(word, code, weight, b - a).astype(np.float32)[:, None]
            a = b
        return out**POWER


@dataclass
class Model:
    """A word's share is kernel @ weights; a document's score is the sigmoid of slopes @ (highest sentence, next ones) + shift."""

    landmarks: list[bytes]
    weights: np.ndarray
    slopes: tuple[float, float] = (1.0, 0.0)
    shift: float = 0.0


def _take(chars: np.ndarray, begin: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Some words' characters side by side."""
    size = begin[which + 1] - begin[which]
    out = np.concatenate(([0], np.cumsum(size)))
    return chars[np.repeat(begin[which] - out[:-1], size) + np.arange(out[-1])], out


class Scorer:
    """Shares of words under a model, remembered by hash for up to KEPT_WORDS of them."""

    def __init__(self, model: Model):
        self.model, self.kernel = model, Kernel(model.landmarks)
        self.known, self.value = np.zeros(0, np.uint64), np.zeros(0, np.float32)

    def shares(self, s: Sentences) -> tuple[np.ndarray, np.ndarray]:
        """(hash number of each word, share by hash number)."""
        hashes, first, of = np.unique(s.hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.known, hashes)
        seen = np.zeros(len(hashes), bool)
        inside = at < len(self.known)
        seen[inside] = self.known[at[inside]] == hashes[inside]
        share = np.zeros(len(hashes), np.float32)
        share[seen] = self.value[at[seen]]
        if not seen.all():
            share[~seen] = self.kernel.rows(*_take(s.chars, s.begin, first[~seen])) @ self.model.weights
            if len(self.known) + len(hashes) > KEPT_WORDS:
                self.known, self.value = hashes, share
            else:
                self.known = np.insert(self.known, at[~seen], hashes[~seen])
                self.value = np.insert(self.value, at[~seen], share[~seen])
        return of, share

    def sentences(self, s: Sentences) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(margin of every sentence without the bias, and its different words as (sentence, word) pairs)."""
        of, share = self.shares(s)
        pair, first = np.unique(s.sentence.astype(np.int64) * (len(share) + 1) + of, return_index=True)
        sentence = pair // (len(share) + 1)
        return np.bincount(sentence, weights=share[of[first]], minlength=len(s.of_text)), sentence, first

    def highest(self, texts: list[str]) -> np.ndarray:
        """Of every text the highest sentence, and the sum of the next TOP - 1 as far as they are above 0; 0 for a text without words."""
        parts = [(i, p) for i, t in enumerate(texts) for p in pieces(t)]
        of, value, at = np.zeros(0, np.int64), np.zeros(0), 0
        while at < len(parts):
            to, n = at, 0
            while to < len(parts) and (to == at or n + len(parts[to][1]) <= PIECE):
                n += len(parts[to][1])
                to += 1
            s = Sentences([p for _, p in parts[at:to]])
            if len(s.of_text):
                of = np.concatenate((of, np.array([i for i, _ in parts[at:to]])[s.of_text]))
                value = np.concatenate((value, self.sentences(s)[0]))
                order = np.lexsort((-value, of))
                of, value = of[order], value[order]
                first = np.searchsorted(of, of)
                place = np.arange(len(of)) - first
                of, value = of[place < TOP], value[place < TOP]
            at = to
        out = np.zeros((len(texts), 2))
        top = np.diff(of, prepend=-1) != 0
        out[of[top], 0] = value[top]
        np.add.at(out[:, 1], of[~top], np.maximum(value[~top], 0))
        return out

    def witnesses(self, text: str, several: bool) -> list[np.ndarray]:
        """The kernels, summed over different words, of a text's highest sentence; with several also of its next TOP - 1 sentences, if they have half as much and CLEAR at least."""
        found: list[tuple[float, np.ndarray]] = []
        for p in pieces(text):
            s = Sentences([p])
            if len(s.of_text):
                margin, sentence, first = self.sentences(s)
                for top in np.argsort(-margin, kind="stable")[: TOP if several else 1].tolist():
                    if not found or margin[top] > found[-1][0] or len(found) < TOP:
                        found.append((float(margin[top]), self.kernel.rows(*_take(s.chars, s.begin, first[sentence == top])).sum(0)))
                found = sorted(found, key=lambda x: -x[0])[: TOP if several else 1]
        return [f for m, f in found if m == found[0][0] or m >= max(CLEAR, found[0][0] / 2)] or [np.zeros(len(self.model.landmarks), np.float32)]


# --- training --------------------------------------------------------------------------------------


def sample(docs: DataFrame, labels: DataFrame, label: str = "toxic", each: int = MAX_EACH, held_out: bool = True) -> DataFrame:
    """doc_id, text, y, part of at most `each` labelled documents of either label; part 0 calibrates. Documents whose crc32(doc_id) mod 3
    is 1 are left out unless told otherwise."""
    y = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    if held_out:
        y = y.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) != 1)
    y = y.groupBy("doc_id").agg(F.min(label).cast("int").alias("y")).join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    some = [y.where(F.col("y") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(each) for v in (0, 1)]
    chosen = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(some[0].unionByName(some[1])), "doc_id")  # at most 2 * each rows of 12 bytes
    return chosen.groupBy("doc_id", "y").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")).withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(5))).repartition(shuffle_partitions(docs.sparkSession))


def word_counts(train: DataFrame) -> DataFrame:
    """word (classes of its characters), toxic and clean: how many documents of each kind hold it."""

    def run(batches):
        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist(), strict=True):
                found: dict[int, bytes] = {}
                for p in pieces(text):
                    s = Sentences([p])
                    hashes, first = np.unique(s.hashes, return_index=True)
                    for h, i in zip(hashes.tolist(), first.tolist(), strict=True):
                        if h not in found and s.begin[i + 1] - s.begin[i] <= 64:  # landmarks are short
                            found[h] = s.chars[s.begin[i] : s.begin[i + 1]].tobytes()
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(list(found.values()), pa.binary()), pa.array([y] * len(found), pa.int32())], names=["word", "y"])

    return train.select("text", "y").mapInArrow(run, "word binary, y int").groupBy("word").agg(F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))


def choose_landmarks(counts: DataFrame, documents: dict[int, int], n: int = LANDMARKS, background: int = BACKGROUND) -> tuple[list[bytes], int]:
    """(landmarks, how many of them are toxic). Candidates are the words that tell most, twelve for each place; those too like one chosen before are passed over."""
    t, c = (F.col("toxic") + 0.5) / (documents.get(1, 0) + 1), (F.col("clean") + 0.5) / (documents.get(0, 0) + 1)
    tells = (F.col("toxic") * F.log(t / c)).alias("tells")
    top = counts.where("toxic > 1").select("word", tells).where(F.col("tells") > LEAST_TELLS).orderBy(F.desc("tells"), "word").limit(12 * n).collect()  # at most 12 n words of 64 bytes
    words = [bytes(r["word"]) for r in top]
    chosen: list[bytes] = []
    if words:
        alike = Kernel(words).rows(*side_by_side(words))
        free = np.ones(len(words), bool)
        for i in range(len(words)):
            if free[i] and len(chosen) < n:
                chosen.append(words[i])
                free &= alike[i] < 0.4
    plain = counts.orderBy(F.desc("clean"), "word").limit(background + n).collect()
    rest = [w for w in (bytes(r["word"]) for r in plain) if w not in set(chosen)][:background]
    return [*chosen, *rest], len(chosen)


def whitening(kernel: np.ndarray, least: float = 1e-3) -> np.ndarray:
    """The inverse root of the landmarks' kernel matrix, without directions that they hardly have."""
    values, vectors = np.linalg.eigh((kernel + kernel.T) / 2)
    good = values > least
    return vectors[:, good] / np.sqrt(values[good])


def svm(x: np.ndarray, y: np.ndarray, cost: float = 0.25, steps: int = 50) -> tuple[np.ndarray, float]:
    """Weights and bias of least |w|**2 / 2 + cost * the sum of half the weighted squared hinge losses, by Newton steps; both labels weigh the same in sum."""
    a = np.column_stack((x, np.ones(len(x))))
    sign = np.where(y > 0, 1.0, -1.0)
    weight = cost * len(y) * np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    ridge = np.eye(a.shape[1])
    ridge[-1, -1] = 1e-6
    w, active = np.zeros(a.shape[1]), np.ones(len(a), bool)
    for _ in range(steps):
        s = a[active] * weight[active, None]
        w = np.linalg.solve(ridge + s.T @ a[active], s.T @ sign[active])
        now = sign * (a @ w) < 1
        if (now == active).all():
            break
        active = now
    return w[:-1], float(w[-1])


def calibrated(highest: np.ndarray, y: np.ndarray) -> tuple[tuple[float, float], float]:
    """Slopes and shift of the sigmoid that fits labels to documents' highest sentences, with the usual smoothed targets."""
    up, down = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x, w = np.column_stack((highest, np.ones(len(highest)))), np.zeros(3)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3)
        step = np.linalg.solve(h, x.T @ (p - target) + 1e-3 * w)
        w -= step * min(1.0, 5 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-8:
            break
    return (max(float(w[0]), 0.0), max(float(w[1]), 0.0)), float(w[2])


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", each: int = MAX_EACH, rounds: int = ROUNDS, held_out: bool = True) -> Model:
    """Spark counts words and finds every document's highest sentence; the machine over at most (TOP + rounds) * each rows is solved here."""
    train = materialize(sample(docs, labels, label, each, held_out), "toxic_train")
    n = {r["y"]: r["n"] for r in train.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        share = (n.get(1, 0) + 1) / (sum(n.values()) + 2)
        return Model([], np.zeros(0, np.float32), shift=float(np.log(share / (1 - share))))
    learn = train.where("part > 0")
    landmarks, toxic = choose_landmarks(materialize(word_counts(learn), "toxic_words"), n)
    if not landmarks:
        share = (n[1] + 1) / (sum(n.values()) + 2)
        return Model([], np.zeros(0, np.float32), shift=float(np.log(share / (1 - share))))
    root = whitening(Kernel(landmarks).rows(*side_by_side(landmarks)).astype(float))
    model = Model(landmarks, np.concatenate((np.ones(toxic), np.zeros(len(landmarks) - toxic))).astype(np.float32))
    clean: list[np.ndarray] = []
    for _ in range(rounds):
        rows = np.array([(r["y"], *np.frombuffer(r["phi"], np.float32)) for r in witnesses(learn, model).collect()])
        clean.append(rows[rows[:, 0] == 0])
        all_rows = np.concatenate((rows[rows[:, 0] == 1], *clean))
        w, bias = svm(all_rows[:, 1:] @ root, all_rows[:, 0])
        model = Model(landmarks, (root @ w).astype(np.float32), shift=bias)
    rest = with_highest(train.where("part = 0").select("text", "y"), model).select("y", "highest").collect()
    if len({r["y"] for r in rest}) == 2:
        model.slopes, model.shift = calibrated(np.array([r["highest"] for r in rest]), np.array([r["y"] for r in rest]))
    return model


def witnesses(train: DataFrame, model: Model) -> DataFrame:
    """y and phi, the landmark kernels of the highest sentences, of every training document: TOP of a toxic one at most, one of a clean one."""
    shared = train.sparkSession.sparkContext.broadcast(model)  # some hundred words and numbers

    def run(batches):
        keep("toxicity", tidy)
        scorer = Scorer(shared.value)
        for batch in batches:
            rows = [(y, w.tobytes()) for y, t in zip(batch.column("y").to_pylist(), batch.column("text").to_pylist(), strict=True) for w in scorer.witnesses(t, y == 1)]
            yield pa.RecordBatch.from_arrays([pa.array([y for y, _ in rows], pa.int32()), pa.array([w for _, w in rows], pa.binary())], names=["y", "phi"])

    return train.select("text", "y").mapInArrow(run, "y int, phi binary")


def with_highest(docs: DataFrame, model: Model, column: str = "highest") -> DataFrame:
    """docs with an array of the highest sentence and the sum of the next. The model (some hundred words and numbers) goes along as a broadcast variable."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in docs.columns if c != column]
    schema = docs.select(rest).schema.add(column, ArrayType(DoubleType()))

    def run(batches):
        keep("toxicity", tidy)
        scorer = Scorer(shared.value) if shared.value.landmarks else None
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            out = scorer.highest(texts) if scorer else np.zeros((len(texts), 2))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(out), pa.list_(pa.float64()))], names=[*batch.schema.names, column])

    return docs.select(*rest).mapInArrow(run, schema)


def with_score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """docs with a score from 0 to 1."""
    name = "highest"
    while name in docs.columns:
        name = "_" + name
    rest = [c for c in docs.columns if c != column]
    margin = F.col(name)[0] * model.slopes[0] + F.col(name)[1] * model.slopes[1] + model.shift
    return with_highest(docs.select(*rest), model, name).select(*rest, (1 / (1 + F.exp(-margin))).alias(column))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = fit(docs, labels)
    scored = with_score(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return scored.select("doc_id", (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
