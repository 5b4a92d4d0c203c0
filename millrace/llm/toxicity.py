"""Operator 10: toxic texts by fuzzy lexicon matches weighed in their context.

``mine`` finds lexicon terms in labelled rows: words, or stems with several endings, that are far more frequent in toxic
texts, chosen greedily so that each explains toxic texts no earlier term explains; stems that clean texts use now and then
count by repetition; the whole words that a stem covers stay in the lexicon (``covered``).  ``Automaton`` walks the Levenshtein
automata of all terms through the trie of the lexicon at once: a state is the set of (trie node, edits) a prefix of the word
can have reached, states and steps are made when first met, and all distinct words of a batch are walked together.  Words of
five letters may differ by one edit, of nine by two, also those that a stem covers; stems themselves must be met exactly.  Spellings that also occur in texts
labelled clean are cleared.

Every match is looked at in a window of words: inside quotation marks, or after a word of reporting, it counts as
quoted; next to a word of address it counts as aimed.  A logistic model over the presence of plain, misspelled, quoted,
aimed and repeated matches, fitted with a prior towards fixed weights, gives the score.

The sample holds at most twice ``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN`` rows.  Without labelled rows the prior weights and an
empty lexicon are used.  Null and empty texts score like any text without a match.  An empty table gives an empty
result; repeated rows score alike; other columns are kept, those named as an added one are replaced.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import encoded, passes, stored, utf8, words
from millrace.llm.sampling import bounded, texts_of

SAMPLE_TOXIC, SAMPLE_CLEAN = 2000, 4000
STEM_SIZES = range(4, 9)
LEAST_ENDINGS = 3
LEAST_TEXTS = 3
#: How much more frequent in toxic texts a term must be: of its own, or (stems) when it counts only by repetition.
STRONG_RATIO, WEAK_RATIO = 20.0, 5.0
MOST_TERMS = 400
#: Letters of a covered word that is kept for its misspellings; a longer one is met by its stem alone.
LONGEST = 32
#: Terms that explain a toxic text before it asks for no more, and how common a word may be to tell copies apart.
COVER, RARE = 3, 0.05
WINDOW = 6
#: Intercept, any plain match, log of their number, best misspelled match, quoted only, aimed at someone, one weak stem,
#: further weak stems (up to 5), log of weak stems per 200 words.
PRIOR = np.array([-4.5, 6.5, 0.5, 6.5, 2.0, 1.0, 0.5, 1.0, 0.5])
#: Fixed word lists of the context rules.
REPORTING = set("said says called calls wrote writes quote quoted quotes word term dit disait sagte nannte wort dijo llamó palabra".split())
ADDRESS = set("you your you're youre du dich dir dein ihr tu te toi ton vous tú usted eres bist es-tu".split())
QUOTES = "\"“”„«»‹›'‘’"
_EDGES = re.compile(r"^[\W_]+|[\W_]+$")


def normal(word: str) -> str:
    """Lower case without marks at the ends."""
    word = word.lower()
    return word if word.isalnum() else _EDGES.sub("", word)


def edits(term: str) -> int:
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


# Lexicon --------------------------------------------------------------------------------------


@dataclass
class Lexicon:
    words: list[str]
    stems: list[str]
    weak: set[str] = field(default_factory=set)
    cleared: set[str] = field(default_factory=set)
    trust: dict[str, float] = field(default_factory=dict)


def uncopied(*classes: list[list[str]]) -> list[list[list[str]]]:
    """One text per pair of rare words of smallest checksum: copies and near copies mostly share it, other texts do not."""
    often = Counter(w for texts in classes for text in texts for w in text)
    most = max(2, RARE * sum(map(len, classes)))
    out = []
    for texts in classes:
        seen = {}
        for i, text in enumerate(texts):
            rare = sorted(crc32(w.encode("utf-8", "surrogatepass")) for w in text if often[w] <= most)
            seen.setdefault(tuple(rare[:2]) if len(rare) > 1 else i, text)
        out.append(list(seen.values()))
    return out


def covered(stem: str, bad: Counter, known: list[str], strong: set[str]) -> set[str]:
    """The words of toxic texts that begin with ``stem`` and that no clean text has, to be met with edits.

    Terms of their own all stay.  A rarer word is left out where clean texts have words within its edits, and a word of
    a single text also where it is another one misspelt: edits of it would be two steps away.
    """
    seen = set(known)
    own = sorted(w for w in bad if w.startswith(stem) and not w.endswith("*") and w not in seen and w not in strong and len(w) <= LONGEST)
    near = {0}
    while near:
        # A clean word names its nearest term only, so those left are asked again.
        near = {*Automaton(Lexicon(own, [])).walk(known)[0].tolist()} - {-1}
        own = [w for i, w in enumerate(own) if i not in near]
    kept = sorted({w for w in strong if w.startswith(stem)} | {w for w in own if bad[w] > 1})
    once = [w for w in own if bad[w] == 1]
    return {*kept, *(w for w, t in zip(once, Automaton(Lexicon(kept, [])).walk(once)[0].tolist()) if t < 0)}


def mine(toxic: list[list[str]], clean: list[list[str]]) -> Lexicon:
    """Terms from the distinct normal words of toxic and clean texts."""

    def forms(text: list[str]) -> set[str]:
        out = set()
        for w in text:
            if len(w) >= 4:
                out.add(w)
                out.update(w[:n] + "*" for n in STEM_SIZES if n < len(w))
        return out

    toxic, clean = uncopied(toxic, clean)
    bad, good, endings = Counter(), Counter(), defaultdict(set)
    held = []
    for text in toxic:
        own = forms(text)
        held.append(own)
        bad.update(own)
    few = {f for f, n in bad.items() if n >= LEAST_TEXTS}
    for text in clean:
        good.update(few & forms(text))
    scale = (len(clean) + 1) / (len(toxic) + 1)
    ratio = {f: (bad[f] + 0.5) * scale / (good[f] + 0.5) for f in few}
    terms = {f for f in few if ratio[f] >= (WEAK_RATIO if f.endswith("*") else STRONG_RATIO)}
    for text in toxic:
        for w in text:
            for n in STEM_SIZES:
                if n < len(w) and len(endings[w[:n] + "*"]) < LEAST_ENDINGS:
                    endings[w[:n] + "*"].add(w)
    terms = {f for f in terms if not f.endswith("*") or len(endings[f]) >= LEAST_ENDINGS}
    strong = {f for f in terms if not f.endswith("*")}
    left = {i: (COVER, own & terms) for i, own in enumerate(held)}
    chosen, least, least_weak = [], max(LEAST_TEXTS, len(toxic) // 100), max(8, len(toxic) // 30)
    terms -= {f for f in terms if ratio[f] < STRONG_RATIO and bad[f] < least_weak}
    left = {i: (n, own & terms) for i, (n, own) in left.items()}
    while len(chosen) < MOST_TERMS:
        gain = Counter(f for _, own in left.values() for f in own)
        if not gain:
            break
        # Most texts and fewest clean ones first; at a tie a whole word before a stem, a longer stem before a shorter one.
        best = max(gain, key=lambda f: (round(gain[f] * (1 - 1 / ratio[f]), 3), not f.endswith("*"), len(f), f))
        if gain[best] < least:
            break
        if ratio[best] >= STRONG_RATIO or gain[best] >= least_weak:
            chosen.append(best)
        body = best.rstrip("*")
        met = {f for f in gain if f == best or (f.endswith("*") and body.startswith(f[:-1])) or (best.endswith("*") and f.startswith(body))}
        left = {i: (n - (best in own), own - met) for i, (n, own) in left.items() if n > (best in own)}
    lexicon = Lexicon(sorted(f for f in chosen if not f.endswith("*")), sorted(f[:-1] for f in chosen if f.endswith("*")))
    lexicon.weak = {f[:-1] for f in chosen if f.endswith("*") and ratio[f] < STRONG_RATIO}
    known = sorted({w for text in clean for w in text})
    kept = set(lexicon.words)
    for stem in lexicon.stems:
        if stem in lexicon.weak:
            # Terms frequent enough to be chosen without the stem; misspelt they count as weakly as it does.
            own = {f for f in strong if f.startswith(stem) and bad[f] >= least} - kept
            lexicon.weak |= own
        else:
            own = covered(stem, bad, known, strong)
        kept |= own
    lexicon.words = sorted(kept)
    return weighed(lexicon, toxic, clean)


def weighed(lexicon: Lexicon, toxic: list[list[str]], clean: list[list[str]]) -> Lexicon:
    """Clear spellings met in clean texts, and trust a term's misspellings by where they occur."""
    automaton = Automaton(lexicon)
    bad, good = Counter(), Counter()
    for texts, count in ((toxic, bad), (clean, good)):
        distinct = sorted({w for text in texts for w in text})
        term, edit = automaton.walk(distinct)
        fuzzy = {w: automaton.terms[t] for w, t, e in zip(distinct, term.tolist(), edit.tolist()) if t >= 0 and e > 0}
        exact = {w for w, t, e in zip(distinct, term.tolist(), edit.tolist()) if t >= 0 and e == 0}
        for text in texts:
            if count is bad and any(w in exact for w in text):
                continue
            for w in text:
                if w in fuzzy:
                    count[fuzzy[w]] += 1
                    if count is good:
                        lexicon.cleared.add(w)
    lexicon.trust = {t: (bad[t] + 1.0) / (bad[t] + 1.0 + 0.02 * good[t]) for t in automaton.terms}
    return lexicon


class Automaton:
    """Deterministic states over sets of (trie node, edits), made as words need them; state 0 is the dead end."""

    def __init__(self, lexicon: Lexicon):
        self.terms = [*lexicon.words, *lexicon.stems]
        self.n_words = len(lexicon.words)
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[int] = [-1]
        self.stem: list[int] = [-1]
        self.most: list[int] = [0]
        for i, term in enumerate(self.terms):
            at, most = 0, edits(term) if i < self.n_words else 0
            for c in term:
                self.most[at] = max(self.most[at], most)
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                    self.ends.append(-1)
                    self.stem.append(-1)
                    self.most.append(0)
                at = self.next[at][c]
            self.most[at] = max(self.most[at], most)
            if i < self.n_words:
                self.ends[at] = i
            else:
                self.stem[at] = i
        self.letters = sorted({c for term in self.terms for c in term})
        self.points = np.array([ord(c) for c in self.letters], np.uint32)
        self.depth = max(map(len, self.terms), default=0) + 3
        self.states: list[dict[int, int] | int] = [{}]
        self.numbers: dict[object, int] = {}
        self.step = np.zeros((1, len(self.letters) + 1), np.int64)
        self.term, self.edit = [-1], [0]
        self.start = self.number(self.closed({0: 0}))

    def closed(self, at: dict[int, int]) -> dict[int, int]:
        """With all letters that the word may leave out."""
        todo = list(at.items())
        while todo:
            node, e = todo.pop()
            if e < self.most[node] and at.get(node, 99) == e:
                for child in self.next[node].values():
                    if e + 1 < at.get(child, 99):
                        at[child] = e + 1
                        todo.append((child, e + 1))
        return at

    def number(self, at: dict[int, int] | int) -> int:
        key = at if isinstance(at, int) else frozenset(at.items())
        if key == frozenset():
            return 0
        if key not in self.numbers:
            self.numbers[key] = len(self.states)
            self.states.append(at)
            self.step = np.vstack([self.step, np.full((1, len(self.letters) + 1), self.numbers[key] if isinstance(at, int) else -1)])
            found = (0, at) if isinstance(at, int) else min(
                ((e, self.ends[n]) for n, e in at.items() if self.ends[n] >= 0 and e <= edits(self.terms[self.ends[n]])), default=(0, -1))
            self.edit.append(found[0])
            self.term.append(found[1])
        return self.numbers[key]

    def after(self, state: int, letter: int) -> int:
        c = self.letters[letter - 1] if letter else None
        out: dict[int, int] = {}
        for node, e in self.states[state].items():
            child = self.next[node].get(c)
            if child is not None:
                if e == 0 and self.stem[child] >= 0:
                    return self.number(self.stem[child])
                out[child] = min(e, out.get(child, 99))
            if e < self.most[node]:
                out[node] = min(e + 1, out.get(node, 99))
                for other in self.next[node].values():
                    out[other] = min(e + 1, out.get(other, 99))
        return self.number(self.closed({n: e for n, e in out.items() if e <= self.most[n] or e == 0}))

    def walk(self, distinct: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Term (-1 for none) and edits of every word."""
        if not self.terms or not distinct:
            return np.full(len(distinct), -1), np.zeros(len(distinct), np.int64)
        size = np.fromiter(map(len, distinct), np.int64, len(distinct))
        shown = "".join(w[: self.depth].ljust(self.depth, "\0") for w in distinct)
        points = np.frombuffer(shown.encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(distinct), self.depth)
        place = np.minimum(np.searchsorted(self.points, points), len(self.points) - 1)
        letter = np.where(self.points[place] == points, place + 1, 0)
        state = np.full(len(distinct), self.start)
        for j in range(self.depth):
            on = np.flatnonzero((size > j) & (state > 0))
            if not len(on):
                break
            s, c = state[on], letter[on, j]
            to = self.step[s, c]
            for pair in np.unique(np.stack([s[to < 0], c[to < 0]]), axis=1).T.tolist() if (to < 0).any() else []:
                made = self.after(*pair)
                self.step[pair[0], pair[1]] = made
            state[on] = self.step[s, c]
        # A word that goes on past the longest term can only have met a stem.
        term = np.asarray(self.term)[state]
        term = np.where((size > self.depth) & (term < self.n_words), -1, term)
        return term, np.asarray(self.edit)[state]


# Context and score ----------------------------------------------------------------------------


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray


def features(automaton: Automaton, lexicon: Lexicon, column: pa.Array) -> np.ndarray:
    """The numbers that PRIOR weighs, for every row."""
    data, at = utf8(column)
    found, rows = words(data, at)
    codes, distinct = encoded(found)
    shapes = [normal(w) for w in distinct.to_pylist()]
    term, edit = automaton.walk(shapes)
    hit = term >= 0
    for i in np.flatnonzero(hit & (edit > 0)).tolist():
        hit[i] = shapes[i] not in lexicon.cleared
    out = np.zeros((len(column), len(PRIOR)))
    out[:, 0] = 1
    plain, weak = np.zeros(len(column)), np.zeros(len(column))
    feeble = np.array([t in lexicon.weak for t in automaton.terms], bool)
    places = np.flatnonzero(hit[codes])
    owner = np.searchsorted(rows, places, "right") - 1
    for p, row in zip(places.tolist(), owner.tolist()):
        low, high = max(int(rows[row]), p - WINDOW), min(int(rows[row + 1]), p + WINDOW + 1)
        near = found.slice(low, high - low).to_pylist()
        own = p - low
        opened = any(w[0] in QUOTES for w in near[: own + 1])
        shut = any(w.rstrip(".,;:!?")[-1:] in QUOTES and w.rstrip(".,;:!?") for w in near[own:])
        about = [w.lower().strip(".,;:!?" + QUOTES) for w in near]
        quoted = (opened and shut) or any(w in REPORTING for w in about[max(0, own - 2) : own])
        code = codes[p]
        if feeble[term[code]]:
            weak[row] += not quoted
            continue
        if quoted:
            out[row, 4] = 1
            continue
        if edit[code] == 0:
            out[row, 1] = 1
            plain[row] += 1
        else:
            out[row, 3] = max(out[row, 3], lexicon.trust.get(automaton.terms[term[code]], 1.0))
        if any(w in ADDRESS for w in about[max(0, own - 2) : own + 3]):
            out[row, 5] = 1
    out[:, 2] = np.log1p(plain)
    out[:, 6] = weak > 0
    out[:, 7] = np.clip(weak - 1, 0, 5)
    out[:, 8] = np.log1p(200 * weak / np.maximum(np.diff(rows), 1))
    out[out[:, 1] > 0, 3] = 0
    out[(out[:, 1] > 0) | (out[:, 3] > 0), 4] = 0
    return out


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_weights(x: np.ndarray, y: np.ndarray, strength: float = 2.0) -> np.ndarray:
    """Logistic regression with a Gaussian prior around PRIOR, by Newton's method."""
    w = PRIOR.copy()
    for _ in range(25):
        p = logistic(x @ w)
        grad = x.T @ (p - y) + strength * (w - PRIOR)
        curve = (x * (p * (1 - p))[:, None]).T @ x + strength * np.eye(len(w))
        move = np.linalg.solve(curve, grad)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def normal_words(docs: DataFrame) -> DataFrame:
    """(key, toxic, terms): the distinct normal words of every row of (key, text, toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches):
            found, rows = words(*utf8(batch.column("text")))
            codes, distinct = encoded(found)
            shapes = np.asarray([normal(w) for w in distinct.to_pylist()], object)
            own = [sorted({*shapes[np.unique(codes[a:b])]} - {""}) if b > a else [] for a, b in zip(rows[:-1], rows[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("toxic"), pa.array(own, pa.list_(pa.string()))], ["key", "toxic", "terms"])

    return docs.mapInArrow(run, "key string, toxic int, terms array<string>")


def scored_features(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(shared.value)
        for batch in passes(batches):
            x = features(automaton, shared.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("toxic"), pa.array(list(x), pa.list_(pa.float64()))], ["key", "toxic", "x"])

    return docs.mapInArrow(run, "key string, toxic int, x array<double>")


def train(docs: DataFrame, labels: DataFrame, toxic: int = SAMPLE_TOXIC, clean: int = SAMPLE_CLEAN) -> Model:
    """Fit on a bounded sample of (doc_id, text) with labels (doc_id, toxic)."""
    marks = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).distinct()
    chosen = bounded(marks.where("toxic = 1"), toxic).unionByName(bounded(marks.where("toxic = 0"), clean))
    # At most 2 * (toxic + clean) rows, of ids as of texts, however ids repeat.
    texts = texts_of(docs.select("doc_id", F.col("text").cast("string").alias("text")), chosen, toxic + clean)
    sample = stored(texts.select(F.col("doc_id").cast("string").alias("key"), "text", "toxic"), "toxicity-sample")
    # Sorted by key, so that reruns agree.
    sets = normal_words(sample).toArrow().sort_by("key")
    marked = sets["toxic"].to_numpy() if sets.num_rows else np.zeros(0)
    texts = sets["terms"].to_pylist()
    lexicon = mine([t for t, m in zip(texts, marked) if m == 1], [t for t, m in zip(texts, marked) if m == 0])
    rows = scored_features(sample, lexicon).toArrow().sort_by("key")
    if not rows.num_rows:
        return Model(lexicon, PRIOR.copy())
    return Model(lexicon, fit_weights(np.asarray(rows["x"].to_pylist()), rows["toxic"].to_numpy()))


def predict(docs: DataFrame, model: Model, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """Add score, predicted, and the kinds of matches that decided: n_features as an array."""
    added = ["score", "predicted", "matches"]
    docs = docs.drop(*added)
    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType()), T.StructField("matches", T.ArrayType(T.DoubleType()))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        automaton = Automaton(model.lexicon)
        for batch in passes(batches, text_col):
            x = features(automaton, model.lexicon, batch.column(text_col))
            score = logistic(x @ model.weights)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(score), pa.array((score >= threshold).astype(np.int32)), pa.array(list(x[:, 1:]), pa.list_(pa.float64()))], [*columns, *added])

    return docs.mapInArrow(run, schema)
