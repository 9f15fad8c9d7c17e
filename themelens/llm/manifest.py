"""Merkle manifest of a dataset by time-forward processing.

A node's label is the time at which its last leaf has passed and its level, so labels ascend from children to parents. A
sweep in order of labels takes each node when all messages to it have come: it hashes its children's digests and sends the
digest to its parent through a priority queue ordered by label. The reversed sweep sends each node's proof suffix (the
siblings from there up to the root) to its children through the same queue in descending order.

The queue is external. Spark tables hold it between runs of ``3 ** most`` neighbouring nodes, which one task sweeps: it
is grouped by label, spills as any shuffle does, and a lost task is swept again. Inside a run the queue has at most a few
digests a level. Runs' roots are the nodes of the next round, so a source of any size takes log(n) / log(3 ** most) rounds.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType

from themelens.llm.common import broadcast_if_small, chunks, stored

#: Children of a node, and levels that one task sweeps at most.
FAN = 3
HEIGHT = 5

#: Columns of a leaf in the order of its digest.
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def _hash(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def height(n: int, most: int) -> int:
    """Levels of a run above its nodes, ``most`` or up to the root, if ``n`` nodes of the group stand on the nodes' level."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // FAN), levels + 1
    return levels


def sweep_up(digests: list[str], levels: int) -> list[list[str]]:
    """Digests of a run's nodes by level; the last level is the run's root alone."""
    size = len(digests)
    nodes: list[list[str]] = [[] for _ in range(levels + 1)]
    queue: list[tuple[int, int, int, str]] = []

    def send(level: int, index: int, digest: str) -> None:
        parent = index // FAN
        last = min((parent + 1) * FAN ** (level + 1), size) - 1
        heapq.heappush(queue, (last, level + 1, index, digest))

    for time, digest in enumerate(digests):
        nodes[0].append(digest)
        if levels:
            send(0, time, digest)
        while queue and queue[0][0] == time:
            level = queue[0][1]
            children = ""
            while queue and queue[0][:2] == (time, level):
                children += heapq.heappop(queue)[3]
            nodes[level].append(_hash(children))
            if level < levels:
                send(level, len(nodes[level]) - 1, nodes[level][-1])
    return nodes


def sweep_down(nodes: list[list[str]], suffix: str) -> Iterator[tuple[int, str]]:
    """(place, proof) of a run's nodes, last first. A proof has ``left.right,`` for every level, from the node upwards."""
    queue = [(-(len(nodes[0]) - 1), -(len(nodes) - 1), 0, suffix)]
    while queue:
        _, level, index, above = heapq.heappop(queue)
        level = -level
        if not level:
            yield index, above
            continue
        below = nodes[level - 1]
        first, end = index * FAN, min(index * FAN + FAN, len(below))
        for child in range(first, end):
            last = min((child + 1) * FAN ** (level - 1), len(nodes[0])) - 1
            own = f"{''.join(below[first:child])}.{''.join(below[child + 1 : end])},"
            heapq.heappush(queue, (-last, 1 - level, child, own + above))


def siblings(proof: str) -> str:
    """The digests of a proof in its order."""
    return proof.replace(".", "").replace(",", "")


def fold(digest: str, proof: str) -> str:
    """The root that a leaf's digest and its proof lead to."""
    for level in proof.split(",")[:-1]:
        left, right = level.split(".")
        digest = _hash(left + digest + right)
    return digest


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """Stored ``rows`` (group, ...) with position (from 0 in the group, by ``order``) and n (rows of the group).

    Ranges of the whole order are counted and offset, so no group meets in one task.
    """
    keys = ["group", *order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    schema = ranged.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("place")).schema
    names = rows.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, last, count = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            places = []
            for group in batch.column(names.index("group")).to_pylist():
                count = count + 1 if group == last else 0
                last = group
                places.append(count)
            own = [pa.array([shard] * len(places), pa.int32()), pa.array(places, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], [*names, "shard", "place"])

    placed = stored(ranged.mapInArrow(place, schema), "placed")
    # A row for each range that a group reaches into.
    counted = placed.groupBy("group", "shard").agg(F.count("*").alias("rows"))
    group = Window.partitionBy("group")
    before = F.sum("rows").over(group.orderBy("shard")) - F.col("rows")
    offsets = stored(counted.select("group", "shard", before.alias("offset"), F.sum("rows").over(group).alias("n")), "offsets")
    position = (F.col("offset") + F.col("place")).alias("position")
    return placed.join(broadcast_if_small(offsets), ["group", "shard"]).select(*names, position, "n")


def grow(nodes: DataFrame, most: int = HEIGHT) -> tuple[list[DataFrame], DataFrame]:
    """Tables of runs, one a round (group, n, run, digests, payload, root), and the roots (group, digest) of all groups.

    ``nodes``: group, n, position, digest (binary) and payload (a struct that the first round keeps).
    """
    rounds: list[DataFrame] = []
    length = FAN**most
    while True:
        rows = nodes.select("group", "n", F.expr(f"position div {length}").alias("run"), "position", "digest", "payload")
        schema = rows.select("group", "n", "run").schema
        schema = schema.add("digests", ArrayType(BinaryType())).add("payload", ArrayType(rows.schema["payload"].dataType))
        schema = schema.add("root", BinaryType())

        def sweep(table: pa.Table) -> pa.Table:
            table = table.sort_by("position").combine_chunks()
            n, digests = table["n"][0].as_py(), table["digest"]
            root = sweep_up([d.hex() for d in digests.to_pylist()], height(n, most))[-1][0]
            whole = pa.array([0, len(table)], pa.int32())
            lists = [pa.ListArray.from_arrays(whole, pa.concat_arrays(table[c].chunks)) for c in ("digest", "payload")]
            first = [table[c].slice(0, 1).combine_chunks() for c in ("group", "n", "run")]
            return pa.table(
                [*first, *lists, pa.array([bytes.fromhex(root)], pa.binary())],
                ["group", "n", "run", "digests", "payload", "root"],
            )

        runs = stored(rows.groupBy("group", "run").applyInArrow(sweep, schema), "runs")
        rounds.append(runs)
        left = runs.agg(F.max(F.col("n"))).first()[0] or 1
        if left <= length:
            return rounds, runs.select("group", F.col("root").alias("digest"))
        nodes = runs.select(
            "group",
            F.expr(f"(n + {length - 1}) div {length}").alias("n"),
            F.col("run").alias("position"),
            F.col("root").alias("digest"),
            F.lit(None).cast("struct<none:int>").alias("payload"),
        )


def deliver(rounds: list[DataFrame], suffixes: DataFrame, most: int = HEIGHT) -> DataFrame:
    """payload, digest, proof and what else ``suffixes`` (group, suffix, ...) has, of every leaf of every group."""
    carried = [c for c in suffixes.columns if c not in ("group", "suffix")]
    given = suffixes.withColumn("run", F.lit(0).cast("long"))
    for k, runs in reversed(list(enumerate(rounds))):
        rows = runs.drop("root").join(given, ["group", "run"]).select("group", "n", "run", "digests", "payload", "suffix", *carried)
        empty = F.lit(None).cast("string")
        schema = rows.select(
            "group",
            F.col("run").alias("position"),
            F.element_at("digests", 1).alias("digest"),
            F.element_at("payload", 1).alias("payload"),
            empty.alias("proof"),
            *carried,
        ).schema

        def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in chunks(batches, rows=4):
                for row in range(batch.num_rows):
                    group, n, run, digests, payload, suffix, *more = (column[row] for column in batch.columns)
                    nodes = sweep_up([d.hex() for d in digests.as_py()], height(n.as_py(), most))
                    size = len(nodes[0])
                    proofs = [""] * size
                    for place, proof in sweep_down(nodes, suffix.as_py()):
                        proofs[place] = proof
                    first = run.as_py() * FAN**most
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.repeat(group, size),
                            pa.array(range(first, first + size), pa.int64()),
                            digests.values,
                            payload.values,
                            pa.array(proofs, pa.string()),
                            *(pa.repeat(value, size) for value in more),
                        ],
                        schema.names,
                    )

        found = rows.mapInArrow(sweep, schema)
        if k:
            given = found.select("group", F.col("position").alias("run"), F.col("proof").alias("suffix"), *carried)
    return found.select("payload", "digest", "proof", *carried)


def leaf(text: Column) -> Column:
    """Digest of a row whose text is ``text``."""
    values = [text if name == "text" else F.col(name).cast("string") for name in COLUMNS]
    sized = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values]
    return F.unhex(F.sha2(F.concat(*sized).cast("binary"), 256))


def proved(docs: DataFrame, tampered: Column | None = None, most: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot and root (binary digests), proof and ``changed`` (the leaf of the ``tampered`` text, or null).

    Rows of one source stand in ascending order of doc_id, null first, then of their digests; equal rows are leaves of
    their own. Sources stand in bytewise order, null first, and an empty one is a source. No rows: no result.
    """
    changed = F.lit(None).cast("binary") if tampered is None else F.when(~F.col("text").eqNullSafe(tampered), leaf(tampered))
    rows = stored(
        docs.select(
            # Null before all others, the empty source among them.
            F.coalesce(F.concat(F.lit("+"), F.col("source").cast("string")), F.lit("")).alias("group"),
            "doc_id",
            leaf(F.col("text").cast("string")).alias("digest"),
            changed.alias("changed"),
            F.monotonically_increasing_id().alias("tie"),
        ),
        "leaves",
    )
    leaves = numbered(rows, ["doc_id", "digest", "tie"])
    rounds, subroots = grow(leaves.select("group", "n", "position", "digest", F.struct("doc_id", "changed").alias("payload")), most)
    # The same over the sources, as one group.
    named = stored(subroots.select(F.lit("").alias("group"), F.col("group").alias("source"), "digest"), "subroots")
    tops, roots = grow(numbered(named, ["source"]).select("group", "n", "position", "digest", F.struct("source").alias("payload")), most)
    start = roots.select("group", F.lit("").alias("suffix"), F.col("digest").alias("root"))
    sources = deliver(tops, start, most).select(
        F.col("payload.source").alias("group"), F.col("proof").alias("suffix"), F.col("digest").alias("subroot"), "root"
    )
    found = deliver(rounds, stored(sources, "sources"), most)
    return found.select("payload.doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof", "payload.changed")


def report(docs: DataFrame, most: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered leaf, else the original) and verified.

    Texts of even crc32 of the id lose their line feeds; a null id or text is left as it is.
    """
    even = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    text = F.col("text").cast("string")
    found = proved(docs, F.when(even, F.replace(text, F.lit("\n"), F.lit(""))).otherwise(text), most)
    schema = found.select(
        "doc_id", *(F.lit("").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root"))
    ).schema

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves, subroots, roots = ([d.hex() for d in batch.column(k).to_pylist()] for k in (1, 2, 3))
            proofs, changed = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            folded = [
                fold(own if new is None else new.hex(), proof)
                for own, proof, new in zip(leaves, proofs, changed, strict=True)
            ]
            hashes = [_hash(siblings(proof)) for proof in proofs]
            columns = [pa.array(x, pa.string()) for x in (leaves, subroots, roots, hashes, folded)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], schema.names)

    return found.mapInArrow(check, schema).withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 20, sources: int = 8) -> str:
    """The same in DuckDB for up to 3 ** ``levels`` leaves of a source and 3 ** ``sources`` sources, level by level."""
    texts = {"text": "text", "plain": "CASE WHEN even THEN replace(text, chr(10), '') ELSE text END"}

    def leaf_of(text: str) -> str:
        values = [texts[text] if c == "text" else f"{c}::VARCHAR" for c in COLUMNS]
        return f"sha256({' || '.join(f"coalesce(strlen({v}) || ':' || {v}, '-')" for v in values)})"

    # Bit by bit, as the ids' digits are few.
    crc = """list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
      lambda s, b: list_reduce(list_prepend(xor(s, b), list_transform(range(8), lambda k: k::UBIGINT)),
        lambda t, k: CASE WHEN t & 1 = 1 THEN xor(t >> 1, 3988292384::UBIGINT) ELSE t >> 1 END))"""
    parts = [
        f"docs AS MATERIALIZED (SELECT *, coalesce(({crc}) % 2 = 1, false) AS even FROM documents)",  # before the last inversion
        f"leaves AS MATERIALIZED (SELECT *, {leaf_of('text')} AS leaf, {leaf_of('plain')} AS changed FROM docs)",
        """a0 AS MATERIALIZED (SELECT source AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS d,
      doc_id, leaf, changed FROM leaves)""",
        "af0 AS (SELECT g, i, doc_id, leaf, changed AS folded, '' AS proof FROM a0)",
    ]

    def climb(name: str, height: int) -> None:
        for k in range(height):
            run = "PARTITION BY g, i // 3 ORDER BY i ROWS BETWEEN"
            parts.append(
                f"""{name}s{k} AS MATERIALIZED (SELECT g, i, d, count(*) OVER (PARTITION BY g) > 1 AS more,
      coalesce(string_agg(d, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
      coalesce(string_agg(d, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {name}{k})"""
            )
            parts.append(
                f"""{name}{k + 1} AS MATERIALIZED (SELECT g, i // 3 AS i, CASE WHEN bool_or(more) THEN sha256(string_agg(d, '' ORDER BY i)) ELSE max(d) END AS d
      FROM {name}s{k} GROUP BY g, i // 3)"""
            )
            parts.append(
                f"""{name}f{k + 1} AS MATERIALIZED (SELECT f.* REPLACE (f.i // 3 AS i, proof || l || r AS proof, CASE WHEN more THEN sha256(l || folded || r) ELSE folded END AS folded)
      FROM {name}f{k} f JOIN {name}s{k} s ON f.g IS NOT DISTINCT FROM s.g AND f.i = s.i)"""
            )

    climb("a", levels)
    parts.append(
        f"b0 AS MATERIALIZED (SELECT 0 AS g, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS i, d, g AS source FROM a{levels})"
    )
    parts.append(
        f"""bf0 AS (SELECT 0 AS g, b0.i, doc_id, leaf, folded, proof, b0.d AS subroot
      FROM af{levels} f JOIN b0 ON f.g IS NOT DISTINCT FROM b0.source)"""
    )
    climb("b", sources)
    return f"""WITH {', '.join(parts)}
SELECT doc_id, leaf, subroot, d AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = d AS verified
FROM bf{sources} CROSS JOIN b{sources}"""
