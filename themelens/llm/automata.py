"""Repeated word sequences by suffix automata of reference shards.

The reference is the corpus itself, cut by ``repeats`` into shards such that all places of a sequence lie in one. Of each
shard a suffix automaton is built, only its states that occur twice or more are kept, and the texts are streamed through
it: the matching statistic at a word is the longest sequence ending there that has another place. Where it reaches the
threshold, a window ends. A shard's automaton is used by the task that holds the shard's texts, so nothing is broadcast
that grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themelens.llm.common import chunks
from themelens.llm.repeats import HOT, Pieces, Units, covered, cut_at, hashes, sums, with_spans

#: Fixed value of the contract.
WINDOW = 35
GRAM = 10

_CODES = np.random.default_rng(10).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True

#: Bytes whose words are hashed at once; length from which a word's code is a hash of its bytes in one call.
BYTES_AT_ONCE = 1 << 20
LONG_WORD = 1 << 12


class SuffixAutomaton:
    """Suffix automaton of several sequences with weights; ``times[state]`` is the weight of its sequences' places."""

    def __init__(self, sequences: list[list[int]], weights: list[int]):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.times = [0]
        for sequence, weight in zip(sequences, weights, strict=True):
            last = 0
            for symbol in sequence:
                last = self._extend(last, symbol)
                self.times[last] += weight
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            self.times[self.link[state]] += self.times[state]

    def _state(self, length: int, following: dict[int, int], link: int) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.times.append(0)
        return len(self.link) - 1

    def _split(self, state: int, symbol: int, target: int) -> int:
        """A copy of ``target`` for its sequences that are one longer than the state's."""
        copy = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = copy
        while state >= 0 and self.next[state].get(symbol) == target:
            self.next[state][symbol] = copy
            state = self.link[state]
        return copy

    def _extend(self, last: int, symbol: int) -> int:
        target = self.next[last].get(symbol)
        if target is not None:
            return target if self.length[target] == self.length[last] + 1 else self._split(last, symbol, target)
        new = self._state(self.length[last] + 1, {}, 0)
        state = last
        while state >= 0 and symbol not in self.next[state]:
            self.next[state][symbol] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][symbol]
            fits = self.length[target] == self.length[state] + 1
            self.link[new] = target if fits else self._split(state, symbol, target)
        return new

    def statistics(self, sequence: list[int]) -> Iterator[int]:
        """At each symbol, the length of the longest sequence that ends there and occurs at least twice."""
        state = matched = 0
        following, link, length, times = self.next, self.link, self.length, self.times
        for symbol in sequence:
            while True:
                target = following[state].get(symbol)
                if target is not None and times[target] > 1:
                    state, matched = target, matched + 1
                    break
                if state == 0:
                    matched = 0
                    break
                state = link[state]
                matched = length[state]
            yield matched


class Words(Units):
    window, gram = WINDOW, GRAM

    def pieces(self, batch: pa.BinaryArray) -> Iterator[Pieces]:
        offsets = np.frombuffer(batch.buffers()[1], np.int32)[batch.offset : batch.offset + len(batch) + 1].astype(np.int64)
        data = np.frombuffer(batch.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
        offsets -= offsets[0]
        if len(data) <= BYTES_AT_ONCE:
            first, last, codes = words_of(data, offsets[:-1])
            starts = np.searchsorted(first, offsets[:-1])
            some = np.append(starts[1:], len(first)) > starts
            yield Spelled(data, first, last, codes, starts[some], np.flatnonzero(some), np.zeros(int(some.sum()), np.int64))
            return
        for row, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            text = data[a:b]
            parts = []
            start = 0
            while start < len(text):
                end = min(start + BYTES_AT_ONCE, len(text))
                spaces = np.flatnonzero(_SPACE[text[start:end]])
                if end == len(text) or len(spaces):  # up to the last white space, so that no word is cut
                    end = end if end == len(text) else start + int(spaces[-1]) + 1
                    first, last, codes = words_of(text[start:end], np.zeros(1, np.int64))
                    parts.append((first + start, last + start, codes))
                else:  # one word, whose end lies further on
                    while end < len(text) and not len(spaces):
                        further = min(end + BYTES_AT_ONCE, len(text))
                        spaces = np.flatnonzero(_SPACE[text[end:further]])
                        end = end + int(spaces[0]) if len(spaces) else further
                    ends = np.array([start]), np.array([end])
                    parts.append((*ends, long_codes(text, *ends)))
                start = end
            if parts:
                first, last, codes = (np.concatenate(x) for x in zip(*parts, strict=True))
                for x, y in cut_at(codes, WINDOW):
                    yield Spelled(text, first[x:y], last[x:y], codes[x:y], np.zeros(1, np.int64), np.array([row]), np.array([x]))

    def content(self, pieces: Pieces, start: int, end: int) -> bytes:
        return b" ".join(pieces.data[pieces.first[start] : pieces.last[end - 1]].tobytes().split())

    def repeated(self, snippets: list[bytes], weights: list[int]) -> Iterable[np.ndarray]:
        names: dict[bytes, int] = {}
        sequences = [[names.setdefault(w, len(names)) for w in x.split(b" ")] for x in snippets]
        automaton = SuffixAutomaton(sequences, weights)
        for sequence in sequences:
            yield np.fromiter(automaton.statistics(sequence), np.int64, len(sequence))[WINDOW - 1 :] >= WINDOW


def words_of(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and hash of every word; no word goes on past the start of a text."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    letter = ~_SPACE[data]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    starts = starts[starts < len(data)]
    begins[starts] = letter[starts]
    ends = letter.copy()
    ends[:-1] &= ~letter[1:]
    before = starts[starts > 0] - 1
    ends[before] = letter[before]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    codes = hashes(sums(_CODES[data]), first, last)
    long = np.flatnonzero(last - first >= LONG_WORD)
    codes[long] = long_codes(data, first[long], last[long])
    return first, last, codes


def long_codes(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)


class Spelled(Pieces):
    def __init__(self, data, first, last, codes, starts, rows, offsets):
        super().__init__(codes, starts, rows, offsets)
        self.data, self.first, self.last = data, first, last


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, removed (maximal runs of removed words) and kept (words joined by one space) of every row.

    A null text has no words. Texts of fewer words than the window stay. Equal rows repeat each other.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            kept, removed, size = [], [], []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                words = text.split()
                runs = covered(spans, WINDOW)
                edges = [0, *(x for run in runs for x in run), len(words)]
                kept.append(b" ".join(w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]))
                removed.append([{"start": a, "end": b} for a, b in runs])
                size.append(len(words))
            run = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, run), pa.array(kept, pa.binary())],
                ["doc_id", "n_words", "removed", "kept"],
            )

    rows = with_spans(docs, Words(), hot)
    schema = rows.select(
        "doc_id",
        F.lit(0).cast("long").alias("n_words"),
        F.lit(None).cast("array<struct<start:long,end:long>>").alias("removed"),
        F.col("text").alias("kept"),
    ).schema
    return rows.mapInArrow(cut, schema)


def report(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256."""
    total = F.aggregate("removed", F.lit(0).cast("long"), lambda n, run: n + run["end"] - run["start"])
    return remove_repeats(docs, hot).select(
        "doc_id", "n_words", total.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )


#: The same spans in DuckDB: all windows are written out and counted.
ORACLE = """
WITH docs AS (
  SELECT row_number() OVER () AS place, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS words
  FROM {documents}),
windows AS (
  SELECT place, i, array_to_string(words[i:i + 34], ' ') AS own
  FROM (SELECT place, words, unnest(range(1, len(words) - 33)) AS i FROM docs)),
repeated AS (SELECT place, i FROM (SELECT place, i, count(*) OVER (PARTITION BY own) AS times FROM windows) WHERE times > 1),
removed AS (SELECT DISTINCT place, i FROM (SELECT place, i + unnest(range(0, 35)) AS i FROM repeated)),
numbered AS (SELECT place, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM docs),
kept AS (
  SELECT place, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM numbered ANTI JOIN removed USING (place, i)
  GROUP BY place)
SELECT doc_id, len(words)::BIGINT AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (place)
"""
