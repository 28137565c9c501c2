"""Connected components of a table of links: forests of bounded chunks, then alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from cloakframe.llm.common import counted, lean, written

#: So many links are united at a time in a task's memory.
CHUNK = 1 << 20


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes that a[i] - b[i] link, ascending, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    parent = np.arange(len(nodes))
    while len(a):
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))
        while (up := parent[parent] != parent).any():
            parent = np.where(up, parent[parent], parent)
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return nodes, nodes[parent]


def _forest(chunk: int):
    """Links (a, b) as stars around the smallest node of what a chunk of them connects."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            if held:
                node, root = roots(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("a", "b")))
                held.clear()
                far = node != root
                yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(root[far])], names=["a", "b"])

        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, chunk - size))
                size += held[-1].num_rows
                batch = batch.slice(held[-1].num_rows)
                if size == chunk:
                    yield from out()
                    size = 0
        yield from out()

    return lean(work)


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(links: DataFrame) -> DataFrame:
    """links (u, v of long) to (node, label): each node that reaches a smaller one, and the smallest that it reaches.

    Links go to as many tasks as there are chunks of CHUNK of them, and each chunk leaves its spanning stars; if there is one chunk, that is all. Else every
    round is a table in the shared folder; a node with very many neighbours is only ever an end of a join that
    Spark can split, never a group in one task. The smallest node of a component, nodes without links, and links of a node to itself give no row."""
    edges, n = counted(links.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "links")
    state = None
    while True:
        parts = max(1, -(-n // CHUNK))
        forest = edges.coalesce(parts).mapInArrow(_forest(CHUNK), "a long, b long")
        if parts == 1:
            return forest.select(F.col("a").alias("node"), F.col("b").alias("label"))
        edges = written(forest, "forest")
        both = edges.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(edges.select(F.col("b").alias("x"), F.col("a").alias("y")))
        least = written(both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), "least")
        large = written(edges.join(least, F.col("b") == F.col("x")).select("a", F.col("m").alias("b")), "large")
        low = written(large.groupBy("a").agg(F.min("b").alias("m")), "low")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(low.select("a", F.col("m").alias("b"))).distinct()
        edges, n = counted(small, "links")
        before, state = state, _state(edges)
        if state == before:
            return edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))
