"""A small corpus with the awkward cases, and plain references for the operators."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import DataFrame, SparkSession

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"

#: Names that operators use for columns of their own.
CLASHING = ("row", "key", "size", "hash", "times", "kept", "fingerprint", "length", "part", "nth", "spans", "gram", "copies")

SYLLABLES = {"en": "th er an on the ing ness wor", "de": "sch ung ein ver keit der ge zu", "fr": "eau oi ment que re la é ç"}


def sentence(rng: random.Random, lang: str, n: int) -> str:
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n)) + "."


def corpus() -> list[tuple]:
    rng = random.Random(7)
    passage = sentence(rng, "en", 90)
    rows: list[tuple] = []
    for k in range(60):
        lang = ("en", "de", "fr")[k % 3]
        text = "\n".join(sentence(rng, lang, rng.randint(5, 60)) for _ in range(rng.randint(1, 4)))
        if k % 5 == 0:
            text = f"{text} {passage} {sentence(rng, lang, 3)}"
        rows.append((k, text, lang, f"src{k % 4}" if k % 9 else None))
    first = rows[1][1]
    rows += [
        (100, first, "de", "src1"),
        (101, first.replace(" ", "  "), "de", "src1"),
        (102, rows[2][1] + " one more", "fr", "src2"),
        *[(103, passage, "en", "src0")] * 3,  # repeated rows
        (104, None, "en", "src0"),
        (105, "", None, "src1"),
        (106, " \t\r\n\x0b\x0c ", "en", "src1"),
        (None, "no id at all, but a text " + sentence(rng, "en", 50), "en", None),
        (107, "1234 !! ### 5678", "en", "src3"),
        (108, " ".join(sentence(rng, "en", 40) for _ in range(150)) + "x" * 50_000, "en", "src0"),
        (109, "mail a.b@c.de and again a.b@c.de, ip 10.0.0.1 or 300.1.1.1, card 4111 1111 1111 1111, +49 (30) 123-456.", "en", "src0"),
        (110, " nbsp em \U0001f600 emoji Ünïcode ÄÖ", "de", "src2"),
        (111, "short", "en", "src9"),
    ]
    return [(i, t, lang, s, None if t is None else len(t)) for i, t, lang, s in rows]


def table(spark: SparkSession, rows: list[tuple] | None = None, extra: bool = False) -> DataFrame:
    docs = spark.createDataFrame(corpus() if rows is None else rows, COLUMNS).repartition(3)
    if extra:
        docs = docs.selectExpr("*", *(f"'{name}' as `{name}`" for name in CLASHING))
    return docs


def rows_of(df: DataFrame) -> Counter:
    return Counter(tuple(row) for row in df.collect())


def repeated(sequences: list, window: int) -> list[list[bool]]:
    """For each sequence, which of its items lie in a window that starts at least twice anywhere."""
    starts = Counter(s[i : i + window] for s in sequences for i in range(len(s) - window + 1))
    out = []
    for s in sequences:
        flags = [False] * len(s)
        for i in range(len(s) - window + 1):
            if starts[s[i : i + window]] > 1:
                flags[i : i + window] = [True] * window
        out.append(flags)
    return out


def runs(flags: list[bool]) -> int:
    return sum(1 for i, x in enumerate(flags) if x and (i == 0 or not flags[i - 1]))
