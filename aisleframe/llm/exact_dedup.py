"""Exact dedup by Patricia tries: every distinct byte string has one terminal node that owns its group.

Rows are dealt by length and content hash, so equal texts meet in one task and a trie only sees
strings of its share. Before the shuffle each task inserts its own rows into a trie, so a text that
fills a third of the table leaves every task once. A trie that outgrows its budget gives up its
heaviest subtree: those strings, and later ones under the same prefix, go to the next round over
more partitions.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aisleframe.llm.common import Rows, folder_table, slices, whole_text

TRIE_BYTES = 48 * 1024 * 1024
STUB = object()  # stands for a subtree that was given up


class Node:
    __slots__ = ("label", "below", "owner", "size", "digest")

    def __init__(self, label: bytes):
        self.label, self.below = label, {}
        self.owner = self.digest = None
        self.size = 0


def shared_length(label: bytes, text: bytes, at: int) -> int:
    """How many leading bytes of ``label`` stand in ``text`` from ``at`` on."""
    low, high = 0, min(len(label), len(text) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if label[low:mid] == text[at + low : at + mid]:
            low = mid
        else:
            high = mid - 1
    return low


class Trie:
    """Compressed radix trie over byte strings; terminals hold owner, group size and digest."""

    def __init__(self, smallest: bool = True):
        self.root, self.bytes, self.pick = Node(b""), 0, min if smallest else max

    def insert(self, text: bytes, owner: int | None, size: int, digest: bytes) -> bool:
        """False when the string lies in a subtree that was given up."""
        node, at = self.root, 0
        while at < len(text):
            child = node.below.get(text[at])
            if child is STUB:
                return False
            if child is None:
                child = node.below[text[at]] = Node(text[at:])
                self.bytes += len(child.label)
            elif not text.startswith(child.label, at):
                k = shared_length(child.label, text, at)
                upper = node.below[text[at]] = Node(child.label[:k])
                upper.below[child.label[k]] = child
                child.label = child.label[k:]
                child = upper
            at += len(child.label)
            node = child
        node.digest = digest
        node.size += size
        if owner is not None:
            node.owner = owner if node.owner is None else self.pick(node.owner, owner)
        return True

    def terminals(self, node: Node | None = None, prefix: bytes = b"") -> Iterator[tuple[bytes, Node]]:
        stack = [(node or self.root, prefix)]
        while stack:
            node, before = stack.pop()
            text = before + node.label
            if node.size:
                yield text, node
            stack += [(c, text) for c in node.below.values() if c is not STUB]

    def weigh(self, node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.label)
            stack += [c for c in node.below.values() if c is not STUB]
        return total

    def give_up(self) -> list[tuple[bytes, Node]]:
        """Cut the heaviest subtree below the first branching node; empty if only one string is left."""
        node, prefix = self.root, b""
        while True:
            live = [c for c in node.below.values() if c is not STUB]
            if len(live) > 1 or live and node.size:
                break
            if not live:
                return []
            node, prefix = live[0], prefix + node.label
        prefix += node.label
        heavy = max(live, key=self.weigh)
        self.bytes -= self.weigh(heavy)
        node.below[heavy.label[0]] = STUB
        return list(self.terminals(heavy, prefix))


OWNED = "n_bytes int, digest binary, body binary, owner bigint, size bigint, spilled boolean"


def _owned_schema() -> pa.Schema:
    return pa.schema(
        [("n_bytes", pa.int32()), ("digest", pa.binary()), ("body", pa.binary()),
         ("owner", pa.int64()), ("size", pa.int64()), ("spilled", pa.bool_())]
    )


def _tries(smallest: bool, budget: int, local: bool):
    """Task function. Local tries hand everything on; final ones keep bodies only of spilled strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, out = Trie(smallest), Rows(_owned_schema())

        def emit(found, spilled: bool):
            for text, node in found:
                body = text if local or spilled else None
                if out.add(len(text), node.digest, body, node.owner, node.size, spilled,
                           size=len(body or b"") + 64):
                    yield out.take()

        for batch in slices(batches, "body"):
            columns = [batch.column(c).to_pylist() for c in ("body", "owner", "size", "digest")]
            for text, owner, size, digest in zip(*columns):
                if not trie.insert(text, owner, size, digest):
                    if out.add(len(text), digest, text, owner, size, True, size=len(text) + 64):
                        yield out.take()
                while trie.bytes > budget:
                    if local:
                        yield from emit(trie.terminals(), False)
                        trie = Trie(smallest)
                    elif given := trie.give_up():
                        yield from emit(given, True)
                    else:
                        break
        yield from emit(trie.terminals(), False)
        if len(out):
            yield out.take()

    return run


def content_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def owners(
    docs: DataFrame, keep: str = "min", budget: int = TRIE_BYTES, digest=content_digest
) -> DataFrame:
    """One row per distinct text: n_bytes, digest, owner, size.

    ``keep`` picks the smallest or largest identifier as owner; null identifiers own nothing while
    another one is there. ``budget`` bounds the bytes held by one trie.
    """
    text = whole_text()
    rows = docs.select(
        F.octet_length(text).alias("n_bytes"),
        digest(text).alias("digest"),
        text.cast("binary").alias("body"),
        F.col("doc_id").cast("bigint").alias("owner"),
        F.lit(1).cast("bigint").alias("size"),
    )
    smallest = keep == "min"
    todo = rows.mapInArrow(_tries(smallest, budget, local=True), OWNED).drop("spilled")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    done: DataFrame | None = None
    first = True
    while True:
        dealt = todo.repartition("n_bytes", "digest") if first else todo.repartition(
            parts, "n_bytes", "digest"
        )
        both = folder_table(dealt.mapInArrow(_tries(smallest, budget, local=False), OWNED), "tries")
        part = both.where("not spilled").select("n_bytes", "digest", "owner", "size")
        done = part if done is None else done.unionByName(part)
        todo = both.where("spilled").drop("spilled")
        if todo.isEmpty():
            return done
        first, parts = False, parts * 4


def groups(
    docs: DataFrame, keep: str = "min", budget: int = TRIE_BYTES, digest=content_digest
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest.

    Null text counts as empty. Rows that repeat identifier and text are one document and count in
    ``group_size``; of equal identifiers with different texts each is a document of its own.
    """
    text = whole_text()
    keyed = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.octet_length(text).alias("n_bytes"),
        digest(text).alias("digest"),
    ).distinct()
    owned = owners(docs, keep, budget, digest)
    twice = owned.groupBy("n_bytes", "digest").count().where("count > 1").select("n_bytes", "digest")
    if twice.isEmpty():
        rows = keyed.join(owned, ["n_bytes", "digest"])
    else:
        rows = _by_text(docs, keyed, owned, folder_table(twice, "collisions"), keep, digest)
    return rows.select(
        "doc_id",
        F.col("owner").alias("keep_id"),
        F.col("size").alias("group_size"),
        F.col("doc_id").eqNullSafe(F.col("owner")).alias("kept"),
        "digest",
    )


def _by_text(docs, keyed, owned, twice, keep, digest) -> DataFrame:
    """Digests that several texts share are resolved by the texts themselves."""
    key = ["n_bytes", "digest"]
    text = whole_text()
    clash = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.octet_length(text).alias("n_bytes"),
        digest(text).alias("digest"), text.alias("body"),
    ).join(twice, key, "left_semi")
    pick = F.min if keep == "min" else F.max
    own = clash.groupBy(*key, "body").agg(
        pick("doc_id").alias("owner"), F.count(F.lit(1)).alias("size")
    )
    exact = clash.distinct().join(own, [*key, "body"]).drop("body")
    plain = keyed.join(owned.join(twice, key, "left_anti"), key)
    return plain.unionByName(exact)


def keep_owners(docs: DataFrame, keep: str = "min", budget: int = TRIE_BYTES) -> DataFrame:
    """``docs`` with one row of every group of equal texts, the owner's."""
    columns = docs.columns
    text = whole_text()
    marked = docs.select(
        *[F.col(f"`{c}`") for c in columns],
        F.octet_length(text).alias("_trie_bytes"), content_digest(text).alias("_trie_digest"),
    )
    owned = owners(docs, keep, budget).select(
        F.col("n_bytes").alias("_trie_bytes"), F.col("digest").alias("_trie_digest"),
        F.col("owner").alias("_trie_owner"),
    )
    at = ["_trie_bytes", "_trie_digest"]
    same = marked.join(owned, at)
    mine = same.where(F.col("doc_id").cast("bigint").eqNullSafe(F.col("_trie_owner")))
    return mine.dropDuplicates(at).select(*[F.col(f"`{c}`") for c in columns])
