"""Stretches of words that repeat with a period, found by a sparse dynamic programme over diagonals while words are read.

A diagonal is a lag; its match length is the number of words on end that equal the word one lag earlier.  Reading
a word, its earlier occurrences lengthen the match at their lags; a diagonal whose next word differs ends, and emits its
stretch at once if that is long enough.  Of the diagonals that end with the same stretch the smallest lag is its period.

Common words would put every lag in play, so an occurrence opens a diagonal only in context: lags from K to 2K - 1 (K = 1,
2, 4, ...) are opened by three equal sequences of K words, one and two lags apart, that do not recur within K / 2 words.
Nothing is lost by that.  A run of smallest period q, K <= q < 2K, has 4q words or more, so each of its q phases has three
equal sequences at this lag.  If all of them recurred within K / 2 words, each would have a period of at most K / 2; two that
overlap in K - 1 words then share that period, so the whole run would have it, against the choice of q.  The longest
match is opened backwards, to the first word at which the lag holds.  A sequence that does not recur within K / 2 words meets at
most four earlier ones within 2K words, unless it begins a run of a smaller period: so the work per word is bounded by a
multiple of the logarithm of the text's length.  Sequences are compared by 64-bit mixes, words exactly: a collision could
open a diagonal in vain, which then ends without a run.

Defined results: a null or empty text has no words and no runs; very long texts are worked on whole; rows are treated one by one,
so ties and repeated rows give equal rows; empty tables give empty tables; a column with the name of a result is replaced, all others
pass through.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.llm.common import encoded, passes, utf8, words

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4

RUN = T.StructType([T.StructField(n, T.LongType(), False) for n in ("start", "length", "period")])
RUNS = T.ArrayType(RUN, False)
ARROW_RUNS = pa.list_(pa.struct([(n, pa.int64()) for n in RUN.names]))


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit mixes of ordered pairs."""
    x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)


def openings(codes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words (numbered over all rows) and lags at which diagonals are opened; ``rows`` has where each row begins and the end."""
    n = len(codes)
    row_end = np.repeat(rows[1:], np.diff(rows))
    row_of = np.repeat(np.arange(len(rows) - 1), np.diff(rows)).astype(np.uint64)
    mix = _mixed(codes.astype(np.uint64), row_of)  # equal words of other rows differ
    places = np.arange(n)
    found_places, found_lags = [], []
    k = 1
    while len(places):
        # ``places`` begin sequences of k words, in ascending order, each of which begins at two places or more.
        keys = mix[places]
        order = np.argsort(keys, kind="stable")
        keys, at = keys[order], places[order]
        same = keys[1:] == keys[:-1]
        gap = np.where(same, at[1:] - at[:-1], n + 1)  # to the place before it with the same sequence
        here = np.flatnonzero(2 * gap > k) + 1
        here = here[same[here - 1]]
        there = here - 1
        while len(here):
            lag = at[here] - at[there]
            alive = lag < 2 * k
            here, there, lag = here[alive], there[alive], lag[alive]
            third = at[there] - lag
            fit = (lag >= k) & (third >= 0)
            fit[fit] = mix[third[fit]] == keys[here[fit]]
            found_places.append(at[here[fit]])
            found_lags.append(lag[fit])
            there = there - 1
            more = there >= 0
            more[more] = keys[there[more]] == keys[here[more]]
            here, there = here[more], there[more]
        twice = np.concatenate([[False], same]) | np.concatenate([same, [False]]) if len(at) else np.zeros(0, bool)
        # Only where both halves recur can a sequence of twice the length recur.
        recurs = np.zeros(n, bool)
        recurs[at[twice]] = True
        places = np.flatnonzero(recurs)
        places = places[places + 2 * k <= row_end[places]]
        places = places[recurs[places + k]] if len(places) else places
        grown = np.zeros(n, np.uint64)
        grown[places] = _mixed(mix[places], mix[places + k])
        mix, k = grown, 2 * k
        # A run of a period from k on needs a row of 4k words.
        places = places[row_end[places] - rows[row_of[places].astype(np.int64)] >= LEAST_PERIODS * k]
    if not found_places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_places), np.concatenate(found_lags)


def runs_of(codes: Sequence[int], opened: Sequence[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) of one row by start and period; ``opened`` are its (word, lag) pairs in order."""
    n, found, active = len(codes), [], {}
    i, k = 0, 0
    while k < len(opened) or active:
        if not active:
            i = opened[k][0]  # nothing can end before the next opening
        ended = [lag for lag in active if i == n or codes[i] != codes[i - lag]]
        for lag in sorted(ended):
            start = active.pop(lag) - lag
            if i - start >= max(LEAST_WORDS, LEAST_PERIODS * lag) and all(s != start or e != i for s, e, _ in found[-len(ended) :]):
                found.append((start, i, lag))
        while k < len(opened) and opened[k][0] == i:
            lag = opened[k][1]
            if lag not in active:
                first = i
                while first > lag and codes[first - 1] == codes[first - 1 - lag]:
                    first -= 1
                active[lag] = first
            k += 1
        i += 1
    return sorted((s, e - s, q) for s, e, q in found)


def find(codes: np.ndarray, rows: np.ndarray) -> dict[int, list[tuple[int, int, int]]]:
    """Runs of every row that has any."""
    at, lag = openings(codes, rows)
    if not len(at):
        return {}
    order = np.lexsort((lag, at))
    at, lag = at[order], lag[order]
    row = np.searchsorted(rows, at, "right") - 1
    cuts = np.flatnonzero(np.diff(row)) + 1
    out = {}
    for a, b in zip([0, *cuts], [*cuts, len(row)]):
        first, end = rows[row[a]], rows[row[a] + 1]
        found = runs_of(codes[first:end].tolist(), list(zip((at[a:b] - first).tolist(), lag[a:b].tolist())))
        if found:
            out[int(row[a])] = found
    return out


def kept_words(ws: list, found: Sequence[tuple[int, int, int]]) -> list:
    """The words without those that any run contains after its first period."""
    gone = np.zeros(len(ws) + 1, np.int64)
    for start, length, period in found:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, g in zip(ws, np.cumsum(gone).tolist()) if not g]


def periodic_runs(
    df: DataFrame, text: str = "text", tail: tuple[str, Callable[[int, int], tuple[int, int]]] | None = None,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """Columns ``keep`` (all of them if not given), ``n_words``, the ``runs`` of every text and the ``collapsed`` text: kept words joined by one blank.

    ``tail`` is a column and a function of its value and the number of words (not 0) that gives (first, period): each word from
    ``first`` on becomes the word a whole number of periods before it.  Where the column is null, the text stays as it is.
    """
    added = {"n_words": T.LongType(), "runs": RUNS, "collapsed": T.BinaryType()}
    kept = [c for c in (df.columns if keep is None else keep) if c not in added]
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(n, t) for n, t in added.items()])

    def sources(batch: pa.RecordBatch, rows: np.ndarray) -> tuple[np.ndarray, set[int]]:
        """The word that stands at each place, and the rows that were changed."""
        source, changed = np.arange(rows[-1]), set()
        for r, value in enumerate(batch.column(tail[0]).to_pylist() if tail else ()):
            begin, end = int(rows[r]), int(rows[r + 1])
            if value is not None and end > begin:
                first, period = tail[1](value, end - begin)
                source[begin + first : end] = begin + first + np.arange(end - begin - first) % period
                changed.add(r)
        return source, changed

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in passes(batches, text):
            data, at = utf8(batch.column(text))
            flat, rows = words(data, at)
            codes, _ = encoded(flat)
            source, changed = sources(batch, rows)
            found = find(codes[source], rows)
            body, collapsed, runs = data.tobytes(), [], []
            for r in range(batch.num_rows):
                ws, own = body[at[r] : at[r + 1]].split(), found.get(r, [])
                if r in changed:
                    ws = [ws[i] for i in (source[rows[r] : rows[r + 1]] - rows[r]).tolist()]
                collapsed.append(b" ".join(kept_words(ws, own) if own else ws))
                runs.append([dict(zip(RUN.names, x)) for x in own])
            new = pa.array(np.diff(rows), pa.int64()), pa.array(runs, ARROW_RUNS), pa.array(collapsed, pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], names=[*kept, *added])

    return df.select(*dict.fromkeys([*kept, text, *(tail[:1] if tail else ())])).mapInArrow(run, schema)
