"""Merkle manifest of a dataset by superblock reduction.

Every row is a leaf; the leaves of a language, ordered by ``doc_id``, are reduced ``FANOUT`` at a time to the language's
subroot, and the subroots, ordered by language, likewise to the root. A superblock is ``FANOUT ** LEVELS`` consecutive
nodes: one group of ``applyInPandas`` collapses ``LEVELS`` levels of it, the superblocks' roots are the nodes of the next
round, and so on until one node is left. Then the way back: the siblings on a superblock's own way to the root are its
upper proof, and a second grouped pass over the same nodes puts a node's siblings inside its superblock (the lower
proof) before it. So a proof is never shuffled, no group has more than ``FANOUT ** LEVELS`` rows however large a
language is, and both passes of the leaves move a few dozen bytes a row.

Positions inside a language come from ranges of (lang, doc_id, leaf): a row's number inside its range, and the sizes of
the ranges before it. The only windows over a whole language have one row a range.

Edge cases: null is a value of its own in every column, and a null language comes first; null ids come first in their
language and are never chosen for the tampering of ``tampered_leaf``; an empty text is not a null one; of equal ids the
smaller leaf comes first, and rows equal in all columns are leaves that can't be told apart (their places are dealt in
any order); a language or a dataset of one node has no siblings there; an empty table gives an empty result. Columns
beside ``doc_id``, ``source``, ``lang``, ``n_chars`` and ``text`` are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.operators.ranking import positions
from quarry.session import arrow_map, cut, ship_package

FANOUT = 8
LEVELS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST_BYTES = 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(values: dict[str, Column]) -> Column:
    """SHA-256 of the fields in order: ``-`` for null, else byte count, colon and value."""
    cells = []
    for name in FIELDS:
        value = values[name].cast("string")
        cells.append(F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.unhex(F.sha2(F.concat(*cells), 256))


def leaves(docs: DataFrame) -> DataFrame:
    """lang, doc_id, leaf."""
    return docs.select("lang", "doc_id", leaf_digest({c: F.col(c) for c in FIELDS}).alias("leaf"))


def tampered_leaf() -> Column:
    """The leaf after someone lower-cased the text of every third document (3 divides crc32 of its id), else null."""
    chosen = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    values = {c: F.col(c) for c in FIELDS} | {"text": F.translate("text", UPPER, LOWER)}
    return F.when(chosen, leaf_digest(values))


def parent(run: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(run).hex().encode()).digest()


def collapse(nodes: list[bytes], levels: int) -> list[list[bytes]]:
    """``levels`` levels above consecutive nodes, these first."""
    out = [nodes]
    for _ in range(levels):
        below = out[-1]
        out.append([parent(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
    return out


def siblings(levels: list[list[bytes]]) -> list[bytes]:
    """For each node of the first level, the others of its run on every level but the last, joined."""
    n = len(levels[0])
    out = [[] for _ in range(n)]
    for depth, level in enumerate(levels[:-1]):
        of = [level[i : i + FANOUT] for i in range(0, len(level), FANOUT)]
        for i in range(n):
            place = i // FANOUT**depth
            run, at = of[place // FANOUT], place % FANOUT
            out[i] += run[:at] + run[at + 1 :]
    return [b"".join(x) for x in out]


def height(n: int, most: int) -> int:
    """Levels above ``n`` nodes, ``most`` at most."""
    h = 0
    while n > 1 and h < most:
        n, h = -(-n // FANOUT), h + 1
    return h


def _bucket(levels: int) -> Column:
    return F.floor(F.col("idx") / F.lit(FANOUT**levels)).cast("long")


def ascend(nodes: DataFrame, levels: int, most: int) -> list[DataFrame]:
    """Rounds of (tree, idx, n, h), the last with one node a tree; ``most`` is the largest n."""
    ship_package(nodes.sparkSession)

    def up(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        n = int(rows["n"].iloc[0])
        top = collapse(rows["h"].tolist(), height(n, levels))[-1]
        return pd.DataFrame({"tree": [key[0]], "idx": [key[1]], "n": [-(-n // FANOUT**levels)], "h": top})

    rounds = [nodes]
    while most > 1:
        below = rounds[-1].select("tree", "idx", "n", "h")
        rounds.append(cut(below.groupBy("tree", _bucket(levels).alias("bucket")).applyInPandas(up, "tree long, idx long, n long, h binary")))
        most = -(-most // FANOUT**levels)
    return rounds


def descend(rounds: list[DataFrame], above: DataFrame, levels: int) -> DataFrame:
    """The nodes of the first round with ``proof``: siblings inside the superblock, then those of the superblock.

    ``above`` has the columns tree, proof and whatever the trees' nodes are to carry, one row a tree.
    """
    ship_package(above.sparkSession)
    carried = [c for c in above.columns if c not in ("tree", "proof")]
    above = above.withColumn("bucket", F.lit(0).cast("long"))
    for k in range(len(rounds) - 1, -1, -1):
        own = [c for c in rounds[k].columns if c not in ("tree", "idx", "n", "h")]
        below = rounds[k].withColumn("bucket", _bucket(levels))
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in [*rounds[k].schema, *(above.schema[c] for c in carried)])
        grouped = below.groupBy("tree", "bucket").cogroup(above.groupBy("tree", "bucket"))
        # Arrow tables keep null ids what they are
        done = grouped.applyInArrow(_prover(["tree", "idx", "n", "h", *own], carried, levels), f"{schema}, proof binary")
        if k:
            above = cut(done.select("tree", F.col("idx").alias("bucket"), "proof", *carried))
    return done


def _prover(own: list[str], carried: list[str], levels: int) -> Callable:
    def down(rows: pa.Table, upper: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        nodes = rows["h"].to_pylist()
        inside = collapse(nodes, height(rows["n"][0].as_py(), levels))
        rest = upper["proof"][0].as_py()
        above = {c: pa.repeat(upper[c][0], len(nodes)) for c in carried}
        proofs = pa.array([x + rest for x in siblings(inside)], pa.binary())
        return pa.table({c: rows[c] for c in own} | above | {"proof": proofs})

    return down


def manifest(rows: DataFrame, levels: int = LEVELS) -> DataFrame:
    """``rows`` (lang, doc_id, leaf, more) with leaf_index, leaves, lang_index, langs, subroot, root and siblings.

    ``siblings`` holds the proof's digests in order: each level's run without the row's own node, left to right, up to
    the subroot and from there up to the root.
    """
    names = rows.columns
    dealt = cut(rows.repartitionByRange("lang", "doc_id", "leaf").withColumn("_range", F.spark_partition_id()))
    sizes = cut(dealt.groupBy("lang", "_range").agg(F.count(F.lit(1)).alias("size")))
    every = positions(sizes.groupBy("lang").agg(F.sum("size").alias("n")), ["lang"], "place")
    every = cut(every.select(F.col("lang").alias("_l"), (F.col("place") - 1).alias("tree"), "n"))
    measured = every.agg(F.count(F.lit(1)).alias("langs"), F.max("n").alias("most")).first()
    langs, most = int(measured["langs"]), int(measured["most"] or 0)
    ahead = Window.partitionBy("lang").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("lang", "_range", F.coalesce(F.sum("size").over(ahead), F.lit(0)).alias("ahead"))
    starts = starts.join(every, F.col("lang").eqNullSafe(F.col("_l"))).select("_l", F.col("_range").alias("_r"), "ahead", "tree", "n")
    inside = F.row_number().over(Window.partitionBy("lang", "_range").orderBy("doc_id", "leaf"))
    # a language is spread over its ranges, so no key of this join is hotter than a range
    placed = dealt.withColumn("_nth", inside).join(starts, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("_range") == F.col("_r")))
    own = [F.col(c).alias(f"_c{i}") for i, c in enumerate(names)]
    nodes = cut(placed.select("tree", (F.col("ahead") + F.col("_nth") - 1).alias("idx"), "n", F.col("leaf").alias("h"), *own))

    rounds = ascend(nodes, levels, most)
    subroots = rounds[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(langs).cast("long").alias("n"), "h")
    upper = ascend(cut(subroots), levels, langs)
    root = upper[-1].select("tree", F.lit(b"").alias("proof"), F.col("h").alias("root"))
    over = descend(upper, root, levels)
    over = cut(over.select(F.col("idx").alias("tree"), "proof", F.col("h").alias("subroot"), "root"))
    done = descend(rounds, over, levels)
    return done.select(
        *(F.col(f"_c{i}").alias(c) for i, c in enumerate(names)),
        F.col("idx").alias("leaf_index"),
        F.col("n").alias("leaves"),
        F.col("tree").alias("lang_index"),
        F.lit(langs).cast("long").alias("langs"),
        "subroot",
        "root",
        F.col("proof").alias("siblings"),
    )


def fold(node: bytes, idx: int, n: int, proof: bytes, at: int) -> tuple[bytes, int]:
    """The root above ``node`` by the siblings in ``proof`` from byte ``at``, and the byte after those used."""
    while n > 1:
        place = idx % FANOUT
        width = min(FANOUT, n - (idx - place))
        mid, end = at + place * DIGEST_BYTES, at + (width - 1) * DIGEST_BYTES
        node = hashlib.sha256((proof[at:mid] + node + proof[mid:end]).hex().encode()).digest()
        idx, n, at = idx // FANOUT, -(-n // FANOUT), end
    return node, at


def verify(proofs: DataFrame, leaf: str) -> DataFrame:
    """``proofs`` (rows of ``manifest``) with folded_root, recomputed from the column ``leaf`` and the siblings alone."""
    taken = [leaf, "leaf_index", "leaves", "lang_index", "langs", "siblings"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in taken]
            folded = []
            for node, i, n, j, m, proof in zip(*cols, strict=True):
                node, at = fold(node, i, n, proof, 0)
                folded.append(fold(node, j, m, proof, at)[0])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(folded, pa.binary())], [*batch.schema.names, "folded_root"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in proofs.schema)
    return arrow_map(proofs, run, f"{schema}, folded_root binary")


def merkle_digest(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """Query form: hexadecimal digests, and the proofs' check after some texts were tampered with."""
    one = docs.select("lang", "doc_id", leaf_digest({c: F.col(c) for c in FIELDS}).alias("leaf"), tampered_leaf().alias("tampered"))
    one = one.withColumn("tampered", F.coalesce("tampered", "leaf"))
    checked = verify(manifest(one, levels), "tampered")
    text = {c: F.lower(F.hex(c)) for c in ("leaf", "subroot", "root", "siblings", "folded_root")}
    return checked.select(
        "doc_id",
        text["leaf"].alias("leaf"),
        text["subroot"].alias("subroot"),
        text["root"].alias("root"),
        F.sha2(text["siblings"], 256).alias("proof_sha256"),
        text["folded_root"].alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
