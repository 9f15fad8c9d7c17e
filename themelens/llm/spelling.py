"""Spelling variants by a trie of letter-group counts.

Letters fall into ``LEVELS`` groups; a word's vector counts its letters by group. The trie arranges words by their counts,
one group a level. One edit changes a vector by at most one letter more and one letter fewer, so a depth-first search for a
word's neighbours goes down with a budget of one surplus and one deficit, and what it reaches at the leaves is verified
letter by letter. Many words go down together: at each node those whose budget is spent are dropped in numpy.

The trie is cut into shards. Its top, the directory, holds the counted nodes of more than a shard's words and is broadcast;
its leaves are the shards. A word lives in one shard and visits those that its budget reaches; of two shards only the word
of the first visits the second, so each pair meets once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themelens.llm.common import body, chunks, stored

#: Fixed values of the contract: least length and occurrences of a word, times that a form is more frequent than its
#: variant, and which runs lose a letter.
LENGTH = 6
TIMES = 5
DOMINANCE = 5
SLIP = 199

_RUN = re.compile(f"[a-zÀ-ÿ]{{{LENGTH},}}")

#: Letter groups. Words up to which a node of the trie is a leaf.
LEVELS = 24
LEAF = 16
#: Words of a shard, and shards above which they are made larger, so that the directory stays within some MB.
SHARD = 2000
SHARDS = 20_000
#: Words whose counts a task holds; letters compared at once; bytes from which a text's words are counted one by one.
HELD = 400_000
LETTERS = 1 << 22
LONG = 1 << 20


def counted(docs: DataFrame, slip: int | None = None, length: int = LENGTH, times: int = TIMES) -> DataFrame:
    """word and n of the runs of letters, in lower case for A-Z, of ``length`` letters and ``times`` occurrences or more.

    With ``slip``, a run loses its letter h % length where slip divides h, the crc32 of ``<doc_id>:<run>``; a null id is
    empty text there.
    """
    rows = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), body().cast("binary"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def held() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"]
            )

        for batch in chunks(batches):
            for doc_id, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                text = data.lower().decode(errors="replace")  # of bytes, so only A-Z
                runs = _RUN.findall(text) if len(data) < LONG else (m[0] for m in _RUN.finditer(text))
                start = zlib.crc32(f"{doc_id}:".encode())
                for word, n in Counter(runs).items():
                    if slip is not None:
                        h = zlib.crc32(word.encode(), start)
                        if h % slip == 0:
                            at = h % len(word)
                            word = word[:at] + word[at + 1 :]
                    if len(word) >= length:
                        total[word] = total.get(word, 0) + n
                if len(total) > HELD:
                    yield held()
                    total.clear()
        if total:
            yield held()

    return (
        rows.mapInArrow(count, "word string, n long")
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= times)
    )


@dataclass(frozen=True)
class Letters:
    """The group of each letter: letters in order of frequency are dealt out in turn."""

    codes: np.ndarray  # ascending
    groups: np.ndarray

    @classmethod
    def of(cls, words: DataFrame) -> Letters:
        seen = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
        table = seen.where("letter != ''").toArrow()  # at most all code points
        codes = np.array([ord(x) for x in table["letter"].to_pylist()], np.int64)
        order = np.lexsort((codes, -table["count"].to_numpy()))
        groups = np.empty(len(codes), np.int64)
        groups[order] = np.arange(len(codes)) % LEVELS
        turn = np.argsort(codes)
        return cls(codes[turn], groups[turn])

    def vectors(self, words: list[str]) -> np.ndarray:
        codes, _, lengths = spelled(words)
        group = self.groups[np.searchsorted(self.codes, codes)]
        place = np.repeat(np.arange(len(words)), lengths) * LEVELS + group
        return np.bincount(place, minlength=len(words) * LEVELS).reshape(-1, LEVELS).astype(np.int32)


def spelled(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Letters of all words behind each other, first place and length of each."""
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.array([len(w) for w in words], np.int64)
    return codes, np.cumsum(lengths) - lengths, lengths


def descend(
    rows: np.ndarray, depth: np.ndarray, queries: np.ndarray, leaf: int = 0
) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end, queries that reach them, whether with an untouched budget) of the trie's leaves, depth first.

    ``rows`` are vectors in ascending order, of which the first ``depth`` counts are given. A node of ``leaf`` rows or
    fewer is not taken apart.
    """
    every = np.arange(len(queries))
    stack = [(0, len(rows), 0, every, np.ones(len(every), bool), np.ones(len(every), bool))] if len(rows) else []
    while stack:
        low, high, level, alive, surplus, deficit = stack.pop()
        if high - low <= leaf or level == depth[low]:
            yield low, high, alive, surplus & deficit
            continue
        column, counts = rows[low:high, level], queries[alive, level]
        edges = [0, *(np.flatnonzero(column[1:] != column[:-1]) + 1).tolist(), high - low]
        for a, b in pairwise(edges):
            more = counts - column[a]
            at = np.flatnonzero((more == 0) | ((more == 1) & surplus) | ((more == -1) & deficit))
            if len(at):
                own = more[at]
                stack.append((low + a, low + b, level + 1, alive[at], surplus[at] & (own <= 0), deficit[at] & (own >= 0)))


def one_edit(text: tuple[np.ndarray, np.ndarray, np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of words differ by exactly one letter inserted, deleted or replaced."""
    codes, starts, lengths = text
    swap = lengths[a] > lengths[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    out = np.zeros(len(a), bool)
    more = lengths[b] - lengths[a]
    for length in np.unique(lengths[a[more <= 1]]).tolist():
        own = np.flatnonzero((lengths[a] == length) & (more <= 1))
        step = max(1, LETTERS // length)
        for k in range(0, len(own), step):
            at = own[k : k + step]
            letters = np.arange(length)
            short = codes[starts[a[at], None] + letters]
            places = starts[b[at], None] + letters
            same = short == codes[places]
            longer = more[at] == 1
            out[at[~longer]] = length - same[~longer].sum(axis=1) == 1
            shifted = short[longer] == codes[places[longer] + 1]
            # Letters that agree from the left, and from the right.
            head = np.logical_and.accumulate(same[longer], axis=1).sum(axis=1)
            tail = np.logical_and.accumulate(shifted[:, ::-1], axis=1).sum(axis=1)
            out[at[longer]] = head + tail >= length
    return out


def neighbours(words: list[str], home: np.ndarray, letters: Letters) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of words at one edit of which one lives here, each once. ``words`` ascending and distinct."""
    vectors, text = letters.vectors(words), spelled(words)
    own = np.flatnonzero(home)
    own = own[np.lexsort(vectors[own].T[::-1])]
    found: list[np.ndarray] = [np.zeros((2, 0), np.int64)]
    kept: list[np.ndarray] = []
    size = 0

    def verify() -> None:
        pairs = np.concatenate(kept, axis=1)
        found.append(pairs[:, one_edit(text, *pairs)])
        kept.clear()

    for low, high, alive, _ in descend(vectors[own], np.full(len(own), LEVELS), vectors, LEAF):
        members = own[low:high]
        step = max(1, LETTERS // 8 // len(members))
        for k in range(0, len(alive), step):
            part = alive[k : k + step]
            pairs = np.stack([np.repeat(part, len(members)), np.tile(members, len(part))])
            # Two that live here meet twice.
            pairs = pairs[:, ~home[pairs[0]] | (pairs[0] < pairs[1])]
            kept.append(pairs)
            size += pairs.shape[1]
            if size > LETTERS // 8:
                verify()
                size = 0
    if kept:
        verify()
    return tuple(np.concatenate(found, axis=1))


@dataclass(frozen=True)
class Directory:
    """The top of the trie: given counts of its leaves, their depth, first shard and number of shards."""

    rows: np.ndarray
    depth: np.ndarray
    first: np.ndarray
    shards: np.ndarray

    @classmethod
    def of(cls, words: DataFrame, letters: Letters, shard: int) -> Directory:
        """``words`` is a stored table. A node of more words than a shard's is taken apart; a full vector of more words
        is dealt over several shards."""
        shared = words.sparkSession.sparkContext.broadcast(letters)

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found, times = np.unique(shared.value.vectors(batch.column(0).to_pylist()), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found.tolist(), pa.list_(pa.int32())), pa.array(times)], ["vector", "n"]
                )

        vectors = words.select("word").mapInArrow(count, "vector array<int>, n long")
        prefix = F.explode(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), lambda k: F.slice("vector", 1, k)))
        nodes = stored(
            vectors.groupBy("vector").agg(F.sum("n").alias("n")).select(prefix.alias("node"), "n").groupBy("node").agg(F.sum("n").alias("n")),
            "nodes",
        )
        # At most LEVELS * words / shard nodes are taken apart.
        apart = nodes.where((F.col("n") > shard) & (F.size("node") < LEVELS)).select(F.col("node").alias("parent"))
        leaves = nodes.where((F.col("n") <= shard) | (F.size("node") == LEVELS))
        parent = F.slice("node", 1, F.size("node") - 1)
        below = leaves.where(F.size("node") > 0).join(apart, parent == F.col("parent"), "left_semi")
        table = below.unionByName(leaves.where(F.size("node") == 0)).select("node", "n").toArrow()
        given = sorted(zip(table["node"].to_pylist(), table["n"].to_pylist(), strict=True))
        rows = np.zeros((len(given), LEVELS), np.int32)
        for row, (node, _) in enumerate(given):
            rows[row, : len(node)] = node
        shards = np.array([-(-n // shard) for _, n in given], np.int64)
        depth = np.array([len(node) for node, _ in given], np.int64)
        return cls(rows, depth, np.cumsum(shards) - shards, shards)

    def visits(self, words: list[str], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of the word, shard, whether it lives there): its own shard and the later ones that its budget reaches."""
        home = np.zeros(len(words), np.int64)
        reached: list[tuple[np.ndarray, np.ndarray]] = []
        for row, _, alive, untouched in descend(self.rows, self.depth, vectors):
            reached.append((alive, np.full(len(alive), row)))
            many = int(self.shards[row])
            own = alive[untouched]
            home[own] = self.first[row] + [zlib.crc32(words[k].encode()) % many if many > 1 else 0 for k in own.tolist()]
        if not reached:
            return home, home, home > 0
        word, row = (np.concatenate(x) for x in zip(*reached, strict=True))
        many = self.shards[row]
        nth = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        word, shard = np.repeat(word, many), np.repeat(self.first[row], many) + nth
        kept = shard >= home[word]
        return word[kept], shard[kept], (shard == home[word])[kept]


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """word, n, n_near (words at one edit), near (the most frequent of them, the first in code-point order of equals; or
    null) and near_n of every row of ``words`` (word, n; words distinct and not null). No words: no rows."""
    words = stored(words.select("word", "n"), "words")
    spark = words.sparkSession
    shard = max(shard, words.count() // SHARDS)
    letters = Letters.of(words)
    shared = spark.sparkContext.broadcast((letters, Directory.of(words, letters, shard)))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own_letters, directory = shared.value
        for batch in batches:
            own = batch.column(0).to_pylist()
            word, at, home = directory.visits(own, own_letters.vectors(own))
            taken = [column.take(pa.array(word)) for column in batch.columns]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(at), pa.array(home)], ["word", "n", "shard", "home"])

    def resolve(table: pa.Table) -> pa.Table:
        table = table.sort_by("word")
        own, n = table["word"].to_pylist(), table["n"].to_numpy()
        a, b = neighbours(own, table["home"].to_numpy(), shared.value[0])
        word, other = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((other, -n[other], word))
        word, other = word[order], other[order]
        first = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, np.int64)
        best = pa.array(other[first])
        return pa.table(
            [
                table["word"].take(pa.array(word[first])),
                pa.array(np.diff(np.append(first, len(word)))),
                table["word"].take(best),
                table["n"].take(best),
            ],
            ["word", "n_near", "near", "near_n"],
        )

    sent = words.mapInArrow(send, "word string, n long, shard long, home boolean")
    found = sent.groupBy("shard").applyInArrow(resolve, "word string, n_near long, near string, near_n long")
    best = F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word")))
    own = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("struct<n:long,word:string>").alias("best"))
    merged = own.unionByName(found.select("word", F.lit(None).cast("long").alias("n"), "n_near", best.alias("best")))
    merged = merged.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return merged.select("word", "n", "n_near", F.col("best.word").alias("near"), (-F.col("best.n")).alias("near_n"))


def forms(near: DataFrame, dominance: int = DOMINANCE) -> DataFrame:
    """word, n, n_near, form (the near word, if it is ``dominance`` times as frequent), form_n and root.

    The root is the last of the forms from the word on, or the word. Each is ``dominance`` times as frequent as the one
    before, so the chains are as long as a logarithm; a round of following doubles what has been followed.
    """
    given = F.col("near_n") >= dominance * F.col("n")
    table = stored(
        near.select(
            "word", "n", "n_near", F.when(given, F.col("near")).alias("form"), F.when(given, F.col("near_n")).alias("form_n")
        ),
        "forms",
    )
    links = table.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    chain, most = 0, table.agg(F.max("n")).first()[0] or 0
    while most >= dominance:
        most, chain = most // dominance, chain + 1
    followed = 1
    while followed < chain:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = links.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root"))
        links, followed = stored(links, "roots"), 2 * followed
    return table.join(links, "word", "left").select("*", F.coalesce("root", "word").alias("last")).drop("root").withColumnRenamed("last", "root")


def report(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of the words of all texts. Null and empty texts have no words."""
    return forms(near_words(counted(docs, SLIP))).select("word", "form", "root", "n", "n_near", "form_n")


#: The same in DuckDB: pairs share what is left of them without one letter, or one is left of the other.
ORACLE = """
WITH RECURSIVE runs AS MATERIALIZED (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc_id,
      translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
    FROM {documents}) WHERE length(run) >= 6 GROUP BY ALL),
hashed AS MATERIALIZED (
  SELECT run, n, xor(4294967295::UBIGINT, list_reduce(list_prepend(4294967295::UBIGINT,
      list_transform(range(length(bytes) // 2), lambda i: (16 * (instr('0123456789ABCDEF', bytes[2 * i + 1]) - 1) + instr('0123456789ABCDEF', bytes[2 * i + 2]) - 1)::UBIGINT)),
    lambda s, b: list_reduce(list_prepend(xor(s, b), list_transform(range(8), lambda k: k::UBIGINT)),
      lambda t, k: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384::UBIGINT) ELSE t >> 1 END)))::BIGINT AS h
  FROM (SELECT *, hex(doc_id || ':' || run) AS bytes FROM runs)),
words AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
shorter AS MATERIALIZED (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM shorter a JOIN shorter b USING (rest, i) WHERE a.word <> b.word
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.rest = w.word),
best AS MATERIALIZED (
  SELECT near.word, count(*) AS n_near, first(other ORDER BY n DESC, other) AS other, max(n) AS other_n
  FROM near JOIN words ON other = words.word GROUP BY near.word),
forms AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
followed AS (
  SELECT word, word AS root FROM forms UNION ALL SELECT f.word, g.form FROM followed f JOIN forms g ON f.root = g.word WHERE g.form IS NOT NULL)
SELECT w.word, w.form, f.root, w.n, w.n_near, w.form_n
FROM forms w JOIN followed f ON f.word = w.word JOIN forms g ON f.root = g.word AND g.form IS NULL
"""
