"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

The channel writes letters as look-alikes, repeats them, and puts separators or spaces between them.
A word that can't have passed through it as something else (letters only, none twice in a row)
is its own restoration; every other word becomes a lattice of characters, and the most likely path
under a character trigram model and the channel's costs is the restored word (Viterbi).  A run of
four or more single characters is read as one spaced word, and so is every span of it that has the
letters of an entry, and so are neighbours of up to SHORT letters that make a whole word together.
What stands between marks within a word is read as well.  Neither words nor runs have a limit of length.  The character model is counted
over all texts: 28**3 numbers, summed per task and then over tasks.

The score comes from a lexicon of restored words and word beginnings that are significant for label
1, learned from at most `sample` labelled rows of each label (in the order of a hash of the id), and
a logistic model of how many of them a text has and how strong they are.  Labels, language, source
and id are never inputs.  Both models are broadcast (the lexicon has at most LEXICON entries); every
text is scored whole, beside the scan.

Null texts count as empty; an empty text has the score of a text without any entry.  Without labels
of both kinds every score is the share of label 1 (0.5 without labels).  An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from credsieve.llm.common import numbered, plain_text, ship_package
from credsieve.llm.quality import fold, labelled_sample

__all__ = ["fit", "fold", "restored_words", "scores"]

#: Labelled rows of each label to fit on, entries of the lexicon, words a worker remembers and their characters at most.
SAMPLE, LEXICON, REMEMBERED, KEPT = 3000, 4000, 200_000, 64
BEGINNINGS = (3, 4, 5, 6)

#: What a look-alike may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¥": "y", "µ": "u",
}
SEPARATORS = ".-_*~'`^/\\,:;=#%&"
#: Costs of the channel in nats: a look-alike, a repeated letter, a separator.
SUBSTITUTED, REPEATED, SEPARATED = 1.0, 0.7, 0.7
#: Letters a-z are 1 to 26, other letters 27, the edge of a word 0.
SYMBOLS = 28

#: Pieces of up to this many letters (repeats aside) may be parts of one word.
SHORT = 3

_DOUBLE = re.compile(r"(.)\1")
#: What stands between white space and marks: look-alikes count as letters in pieces, but not in the strict ones.
_ALIKE = "".join(map(re.escape, LOOK_ALIKES))
_PIECE, _STRICT = re.compile(rf"(?:[^\W_]|[{_ALIKE}])+"), re.compile(r"[^\W_]+")
_EDGES = "\"“”‘’()[]{}«»¿¡?….,;:!"


def _symbol(letter: str) -> int:
    return ord(letter) - 96 if "a" <= letter <= "z" else 27


#: Of UTF-8 bytes: ASCII letters for themselves, the first byte of a longer character as another letter, its others left out.
_BYTE_SYMBOLS = np.zeros(256, np.uint8)
_BYTE_SYMBOLS[65:91] = _BYTE_SYMBOLS[97:123] = np.arange(1, 27)
_BYTE_SYMBOLS[128:192], _BYTE_SYMBOLS[192:] = 255, 27


def trigram_counts(text: bytes) -> np.ndarray:
    symbols = _BYTE_SYMBOLS[np.frombuffer(b" " + text + b" ", np.uint8)]
    symbols = symbols[symbols != 255].astype(np.int64)
    if len(symbols) < 3:
        return np.zeros(SYMBOLS**3, np.int64)
    return np.bincount((symbols[:-2] * SYMBOLS + symbols[1:-1]) * SYMBOLS + symbols[2:], minlength=SYMBOLS**3)


def character_costs(counts: np.ndarray) -> np.ndarray:
    """-log p(third | first two), smoothed by the pairs and by the letters alone."""
    tri = counts.reshape((SYMBOLS,) * 3).astype(float)
    two, one = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (one + 1) / (one + 1).sum()
    p2 = (two + 20 * p1) / (two.sum(axis=1, keepdims=True) + 20)
    p3 = (tri + 20 * p2[None]) / (tri.sum(axis=2, keepdims=True) + 20)
    return -np.log(p3)


def restored(word: str, costs: np.ndarray) -> str:
    """The most likely letters behind a lower-cased `word` of any length."""
    if word.isalpha() and not _DOUBLE.search(word):
        return word
    if not any(x.isalpha() or x in LOOK_ALIKES for x in word):
        return word
    # State: the two symbols before, and the last letter written; value: cost and letters so far, the last one first.
    states: dict[tuple[int, int, str], tuple[float, tuple]] = {(0, 0, ""): (0.0, ())}
    for seen in word:
        after: dict[tuple[int, int, str], tuple[float, tuple]] = {}
        options = [(seen, 0.0)] if seen.isalpha() else [(x, SUBSTITUTED) for x in LOOK_ALIKES.get(seen, "")]
        for (a, b, last), (cost, so_far) in states.items():
            moves = []
            for letter, paid in options:
                c = _symbol(letter)
                moves.append(((b, c, letter), cost + paid + costs[a, b, c], (letter, so_far)))
                if letter == last:  # the same letter again, or a look-alike of it
                    moves.append(((a, b, last), cost + paid + REPEATED, so_far))
            if seen in SEPARATORS or not options:
                moves.append(((a, b, last), cost + SEPARATED, so_far))
            for state, total, letters in moves:
                if state not in after or total < after[state][0]:
                    after[state] = (total, letters)
        states = after
    ends = [(total + costs[a, b, 0], letters) for (a, b, _), (total, letters) in states.items()]
    least = min(total for total, _ in ends)
    return min(_written(letters) for total, letters in ends if total == least) or word


def _written(letters: tuple) -> str:
    found = []
    while letters:
        last, letters = letters
        found.append(last)
    return "".join(reversed(found))


#: Letters and look-alikes that may stand for each other, as one letter each; other characters go, but line ends.
_SAME = {"l": "i"} | {x: y[0].replace("l", "i") for x, y in LOOK_ALIKES.items()}
_AGAIN = re.compile(r"([^\n])\1+")


class _Skeleton(dict):
    """For str.translate: each character is classed when it is first met."""

    def __missing__(self, code: int) -> str:
        letter = chr(code)
        self[code] = found = _SAME.get(letter, letter if letter.isalpha() or letter == "\n" else "")
        return found


_SKELETON = _Skeleton()


def skeletons(words: Sequence[str]) -> list[str]:
    """What the channel leaves as it is of each word (without line ends): equal for a word and all that it may be written as."""
    return _AGAIN.sub(r"\1", "\n".join(words).translate(_SKELETON)).split("\n") if words else []


@lru_cache(1 << 16)
def _short_skeleton(word: str) -> str:
    return skeleton(word)


def skeleton(word: str) -> str:
    return skeletons([word])[0]


def _spaced(words: list[str]) -> list[list[str]]:
    """Runs of four or more single characters."""
    found, run = [], []
    for k in [k for k, x in enumerate(words) if len(x) == 1]:
        if run and k == run[-1] + 1:
            run.append(k)
        else:
            found.append(run)
            run = [k]
    return [[words[k] for k in x] for x in [*found, run] if len(x) >= 4]


class _Short(dict):
    """1 for pieces of up to SHORT letters, repeats aside, else 0."""

    def __missing__(self, piece: str) -> int:
        found = int(len(piece) <= SHORT or bool(_DOUBLE.search(piece)) and len(skeleton(piece)) <= SHORT)
        if len(piece) <= KEPT:
            if len(self) >= REMEMBERED // 4:
                self.clear()
            self[piece] = found
        return found


_SHORT, _RUN = _Short(), re.compile(b"\x01{2,}")


def _short(pieces: list[str]) -> list[list[str]]:
    """Runs of two or more short pieces."""
    return [pieces[x.start() : x.end()] for x in _RUN.finditer(bytes(map(_SHORT.__getitem__, pieces)))]


def parts(word: str) -> set[str]:
    """What stands between the marks within a word: look-alikes once as letters, once as marks."""
    if word.isalpha():
        return set()
    return {*_PIECE.findall(word), *_STRICT.findall(word)} - {word, word.strip(_EDGES)}


@dataclass
class Model:
    """Both models and what a worker has restored so far."""

    costs: np.ndarray
    lexicon: dict[str, float] = field(default_factory=dict)
    weights: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)
    seen: dict[str, tuple] = field(default_factory=dict)
    clean: set[str] = field(default_factory=set)

    def __post_init__(self) -> None:
        self.know(self.lexicon)

    def know(self, lexicon: dict[str, float]) -> None:
        """Take this lexicon.  `starts`: all beginnings of the skeletons of its whole words, true for whole ones;
        `begun`: the skeletons of its beginnings of words; `two`: how skeletons of words with an entry begin."""
        self.lexicon, self.starts = lexicon, {}
        self.forget()
        wholes = {skeleton(x[:-1]) for x in lexicon if x.endswith("$")} - {""}
        for whole in wholes:
            for k in range(1, len(whole)):
                self.starts.setdefault(whole[:k], False)
            self.starts[whole] = True
        self.begun = {skeleton(x) for x in lexicon if not x.endswith("$")} - {""}
        self.two = {x[:2] for x in self.begun | wholes}
        self.single = any(len(x) < 2 for x in self.begun)
        self.within = re.compile("|".join(map(re.escape, sorted(wholes)))) if wholes else None

    def forget(self) -> None:
        self.seen, self.clean = {}, set()

    def may_hit(self, bone: str) -> bool:
        """Whether a word with this skeleton may have an entry: else neither it nor its restoration has."""
        if bone[:2] not in self.two and not self.single:
            return False
        return self.starts.get(bone, False) or any(bone[:k] in self.begun for k in range(1, BEGINNINGS[-1] + 1))

    def readings(self, word: str) -> tuple[str, ...]:
        """The word without marks around it, and its restoration where that differs."""
        plain = word.strip(_EDGES)
        if plain.isalpha() and not _DOUBLE.search(plain):
            return (plain,)
        best = restored(word, self.costs)
        inner = restored(plain, self.costs) if plain else best
        return tuple(dict.fromkeys(x for x in (plain, inner, best) if x))

    def entries(self, word: str) -> tuple:
        """The strongest entry of the lexicon, (strength, reading), of the word and of each part of it."""
        best = []
        for z in (word, *parts(word)):
            if self.may_hit(skeleton(z)) or self.may_hit(skeleton(z.strip(_EDGES))):
                best.append(max(((self.lexicon.get(x, 0.0), x) for y in self.readings(z) for x in terms(y)), default=(0.0, "")))
        return tuple({x for x in best if x[0] > 0})

    def hits(self, words: set[str]) -> set[tuple]:
        """Entries of all these words.  Words without one are known by their skeletons, most of them without decoding."""
        left = words - self.clean
        new = [x for x in left if x not in self.seen]
        found: set[tuple] = set()
        for word, bone in zip(new, skeletons(new), strict=True):
            # Without marks inside and look-alikes at the edges a word has no parts, and one skeleton.
            plain = "(" not in word and "!" not in word and word.strip(_EDGES).isalnum()
            got = () if plain and not self.may_hit(bone) else self.entries(word)
            found.update(got)
            if len(word) <= KEPT:
                if len(self.seen) + len(self.clean) >= REMEMBERED:
                    self.forget()
                if got:
                    self.seen[word] = got
                else:
                    self.clean.add(word)
        for word in left:
            found.update(self.seen.get(word, ()))
        return found

    def inside(self, run: Sequence[str]) -> set[tuple]:
        """Entries for whole words that two or more neighbours of `run` make together.

        All beginnings are followed at once by their skeletons, so the time is linear in the run; only spans with
        the skeleton of an entry are decoded.  Of spans that differ by repeats alone, the longest and shortest are.
        """
        found: set[tuple] = set()
        if self.within is None or not self.within.search(skeleton("".join(run))):
            return found  # no whole entry lies in the run
        # By skeleton: first and last place where it starts, first and last place where it ends.
        active: dict[str, tuple[int, int, int, int]] = {}
        for k, part in enumerate([*run, ""]):
            own = _short_skeleton(part) if len(part) <= SHORT else skeleton(part)
            if part and not own:  # a separator
                continue
            for old, (first, last, early, late) in active.items():
                if self.starts[old] and own != old[-1]:
                    for a, b in {(a, b) for a in (first, last) for b in (early, late) if a < b}:
                        for reading in self.readings("".join(run[a : b + 1])):
                            if strength := self.lexicon.get(reading + "$"):
                                found.add((strength, reading + "$"))
            after: dict[str, tuple[int, int, int, int]] = {}
            if own:
                for old, (first, last, early, _) in active.items():
                    new = old + (own[1:] if own[0] == old[-1] else own)
                    if new in self.starts:
                        after[new] = (first, last, early if new == old else k, k)
                if own in self.starts:
                    first, _, early, _ = after.get(own, (k, k, k, k))
                    after[own] = (first, k, early, k)
            active = after
        return found

    def inputs(self, text: str) -> list[float]:
        text = text.lower()
        words = text.split()
        hits = self.hits(set(words))
        for run in _spaced(words):
            hits |= self.hits({"".join(run)}) | self.inside(run)
        for run in _short(_PIECE.findall(text)):
            hits |= self.inside(run)
        strengths = sorted((x for x, _ in hits), reverse=True)
        return [1.0, strengths[0] if strengths else 0.0, sum(strengths[:4]), float(np.log1p(len(hits)))]

    def score(self, text: str) -> float:
        margin = float(np.dot(self.weights, self.inputs(text)))
        return float(1 / (1 + np.exp(-np.clip(margin, -30, 30))))


def terms(word: str) -> list[str]:
    """A whole word (marked) and its beginnings."""
    return [word + "$", *(word[:k] for k in BEGINNINGS if len(word) >= k)]


def restored_words(text: str, costs: np.ndarray, known: dict[str, set[str]] | None = None) -> set[str]:
    """Readings of all words, their parts and spaced words; `known` remembers those of words."""
    model, known = Model(costs), {} if known is None else known
    words = text.lower().split()
    found: set[str] = set()
    for x in {*words, *map("".join, _spaced(words))}:
        if (read := known.get(x)) is None:
            read = {z for y in (x, *parts(x)) for z in model.readings(y)}
            if len(x) <= KEPT:
                if len(known) >= REMEMBERED:
                    known.clear()
                known[x] = read
        found |= read
    return found


def _character_model(docs: DataFrame, text_col: str) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for text in batch.column(0).cast(pa.binary()).to_pylist():
                total += trigram_counts(text)
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["code", "n"])

    counted = docs.select(plain_text(docs, text_col).alias("text")).mapInArrow(count, "code int, n long")
    counts = np.zeros(SYMBOLS**3, np.int64)
    for code, n in counted.groupBy("code").agg(F.sum("n")).collect():
        counts[code] = n
    return character_costs(counts)


def fit(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Both models: characters over all rows, the lexicon and its weights over a bounded sample."""
    ship_package(docs.sparkSession)
    model = Model(_character_model(docs, text_col))
    sent = docs.sparkSession.sparkContext.broadcast(model.costs)
    kinds = [
        labelled_sample(docs, labels.where(F.col(label) == y), label, sample, learn, id_col, text_col) for y in (0, 1)
    ]
    rows = kinds[0].unionByName(kinds[1])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        known: dict[str, set[str]] = {}
        for batch in batches:
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts[y].update({t for x in restored_words(text, sent.value, known) for t in terms(x)})
                counts[y][""] += 1
        for y in (0, 1):
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts[y]), pa.string()), pa.array([y] * len(counts[y]), pa.int32()), pa.array(list(counts[y].values()), pa.int64())],
                names=["term", "y", "n"],
            )

    counted = rows.mapInArrow(work, "term string, y int, n long").groupBy("term")
    counted = counted.agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"), F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("good"))
    totals = counted.where("term = ''").first()
    bad, good = (totals["bad"], totals["good"]) if totals else (0, 0)
    if not bad or not good:
        share = bad / (bad + good) if bad + good else 0.5
        model.weights = (float(np.log(max(share, 1e-3) / max(1 - share, 1e-3))) if share != 0.5 else 0.0, 0.0, 0.0, 0.0)
        return model
    # Significant for label 1: often enough, and its share there far above that elsewhere.
    least = max(3, bad // 50)
    strength = F.log((F.col("bad") + 0.5) / (bad + 1)) - F.log((F.col("good") + 0.5) / (good + 1))
    spread = F.sqrt(1 / (F.col("bad") + 0.5) + 1 / (F.col("good") + 0.5))
    known = counted.where((F.col("term") != "") & (F.col("bad") >= least) & (strength > 1.5) & (strength / spread > 3))
    known = known.select("term", strength.alias("strength")).orderBy(F.desc("strength"), "term").limit(LEXICON)
    model.know({r[0]: r[1] for r in known.collect()})
    whole = docs.sparkSession.sparkContext.broadcast(model)

    def inputs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [whole.value.inputs(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    data = rows.mapInArrow(inputs, "x array<double>, y int").collect()
    prior = labels.where(learn & F.col(label).isin(0, 1)).agg(F.avg(label)).first()[0]
    model.weights = _logistic(np.array([r[0] for r in data]), np.array([r[1] for r in data]), prior)
    model.forget()
    return model


def _logistic(x: np.ndarray, y: np.ndarray, prior: float) -> tuple[float, ...]:
    """Newton steps with a ridge; rows weighted so that the labels have their shares among all labelled rows."""
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3, *[0.05] * (x.shape[1] - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge @ w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(map(float, w))


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """id, score and predicted of every row."""
    return with_scores(docs.select(F.col(id_col), F.col(text_col)), model, text_col, threshold).select(id_col, "score", "predicted")


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """`docs` with score and predicted (in place of columns of these names); rows stay where they are."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("score", "predicted")
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    place = docs.columns.index(text_col)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.score(x or "") for x in batch.column(place).cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.float64()), pa.array([int(x >= threshold) for x in found], pa.int32())],
                names=schema.names,
            )

    return numbered(docs).mapInArrow(work, schema)
