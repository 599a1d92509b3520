"""A Merkle manifest of a table: a tree of digests over the rows of each group, and one over the groups' roots.

Rows become leaves where they are read, so no text is shuffled. Leaves are
placed by a range sort and packed into blocks of WIDE consecutive ones, each of
which a task reduces to one digest. That leaves a small top tree: the driver
builds it and sends each block the path from its digest to the root, with which
the executors finish the proofs and fold every row. Where more than TOP digests
are left, they are reduced once more in blocks first.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import forget, met, shuffle_width, table, written

#: Children of a node, levels that a block spans, and digests that the driver takes at most.
FAN, LEVELS, TOP = 3, 7, 4096
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = T.ArrayType(T.StructType([T.StructField("left", T.StringType()), T.StructField("right", T.StringType())]))


def leaf(values: list[Column]) -> Column:
    """The digest of a row: of each value its UTF-8 byte count, a colon and the value, or '-' for null, one after the other."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def node(*digests: str) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def risen(digests: list[str], levels: int | None = None) -> list[list[str]]:
    """These digests and the levels above them: so many, or up to the level of one digest."""
    out = [digests]
    while len(out[-1]) > 1 if levels is None else len(out) <= levels:
        out.append([node(*out[-1][i : i + FAN]) for i in range(0, len(out[-1]), FAN)])
    return out


def siblings(levels: list[list[str]], k: int) -> list[tuple[str, str]]:
    """For digest k of the lowest level: the others of its run, joined left and right of it, level by level."""
    out = []
    for row in levels[:-1]:
        first = k - k % FAN
        out.append(("".join(row[first:k]), "".join(row[k + 1 : first + FAN])))
        k //= FAN
    return out


def folded(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a digest and its siblings lead to."""
    for left, right in path:
        digest = node(left, digest, right)
    return digest


def _placed(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """leaves (id, group, leaf, seen) with tree, pos and n, and the table (tree, n): groups numbered in order, their rows by id, then leaf.

    Equal rows differ by where they were read, so that a range of the sort holds
    a task's share of them at most. Counts have a row for each group and range.
    """
    order = ["group", "id", "leaf", "turn"]
    dealt = leaves.withColumn("turn", F.monotonically_increasing_id()).repartitionByRange(shuffle_width(leaves.sparkSession), *order).sortWithinPartitions(*order)
    ordered = written(dealt.drop("turn").withColumn("k", F.monotonically_increasing_id()).withColumn("part", F.shiftright("k", 33).cast("int")))
    counts = written(ordered.groupBy("group", "part").agg(F.count("*").alias("n"), F.min("k").alias("first")))
    # a group begins in its first range; groups are numbered range by range
    groups = counts.groupBy("group").agg(F.min("part").alias("part"), F.sum("n").alias("whole")).withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("group")) - 1)
    groups = written(groups)
    parts = groups.groupBy("part").count().orderBy("part").collect()  # a row for each range
    before, sums = {}, 0
    for r in parts:
        before[r["part"]], sums = sums, sums + r["count"]
    offsets = leaves.sparkSession.createDataFrame(list(before.items()), "part int, before long")
    trees = written(groups.join(F.broadcast(offsets), "part").select("group", (F.col("before") + F.col("at")).alias("tree"), "whole"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("group").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.withColumn("earlier", earlier).alias("c").join(trees.alias("t"), F.expr("c.group <=> t.group")).select("c.group", "part", "tree", "whole", (F.col("earlier") - F.col("first")).alias("shift"))
    out = ordered.alias("o").join(starts.alias("s"), F.expr("o.part = s.part and o.group <=> s.group"))
    return out.select("tree", (F.col("k") + F.col("shift")).alias("pos"), F.col("whole").alias("n"), "id", "o.group", "leaf", "seen"), trees.select("tree", F.col("whole").alias("n"))


def _blocks(nodes: DataFrame, levels: int) -> DataFrame:
    """(tree, block, n, rows): consecutive nodes of a tree, at most FAN**levels to a block; nodes has tree, pos, n and what goes into the rows."""
    rest = [c for c in nodes.columns if c not in ("tree", "pos", "n")]
    rows = F.array_sort(F.collect_list(F.struct("pos", *rest))).alias("rows")
    return written(nodes.groupBy("tree", F.expr(f"pos div {FAN**levels}").alias("block")).agg(F.max("n").alias("n"), rows))


def _levels(digests: list[str], n: int, levels: int) -> list[list[str]]:
    """A block's levels: all that it spans where its tree has other blocks, else up to the tree's root."""
    return risen(digests, levels if n > FAN**levels else None)


def _tops(blocks: DataFrame, levels: int) -> DataFrame:
    """(tree, pos, n, digest): one digest for each block, n of them in its tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.column(2).to_pylist()
            tops = [_levels(rows.values.field("digest").to_pylist(), n[i], levels)[-1][0] for i, rows in enumerate(batch.column(3))]
            wide = FAN**levels
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([-(-x // wide) for x in n], pa.int64()), pa.array(tops, pa.string())], names=["tree", "pos", "n", "digest"])

    shown = F.transform("rows", lambda r: F.struct((F.lower(F.hex(r["leaf"])) if "leaf" in blocks.schema["rows"].dataType.elementType.names else r["digest"]).alias("digest")))
    return blocks.select("tree", "block", "n", shown.alias("rows")).mapInArrow(run, "tree long, pos long, n long, digest string")


PATHS = T.StructType([T.StructField("tree", T.LongType()), T.StructField("pos", T.LongType()), T.StructField("path", PATH), T.StructField("top", T.StringType())])


def paths(nodes: DataFrame, top: int = TOP, levels: int = LEVELS) -> tuple[DataFrame, bool]:
    """(tree, pos, path, top) of nodes (tree, pos, n, digest): siblings up to the root of the tree, and that root.

    The flag says that the driver made the table, of at most `top` rows, each
    with the siblings of about log3(top) levels; it may be broadcast. Trees that
    are one node go no further up.
    """
    spark = nodes.sparkSession
    every = written(nodes)
    nodes = every.where("n > 1")
    if every.count() <= top:
        nodes = every
    elif nodes.isEmpty():
        return every.select("tree", "pos", F.array().cast(PATH).alias("path"), F.col("digest").alias("top")), False
    if nodes is every:
        trees: dict[int, list] = {}
        for r in nodes.orderBy("tree", "pos").collect():
            trees.setdefault(r["tree"], []).append(r["digest"])
        rows = []
        for t, digests in trees.items():
            above = risen(digests)
            rows += [(t, k, siblings(above, k), above[-1][0]) for k in range(len(digests))]
        return spark.createDataFrame(rows, PATHS), True
    blocks = _blocks(nodes, levels)
    above, small = paths(_tops(blocks, levels), top, levels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        for batch in batches:
            for tree, n, rows, path, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, upper = _levels([r["digest"] for r in rows], n, levels), [(s["left"], s["right"]) for s in path]
                for i in range(0, len(rows), 100):
                    some = range(i, min(i + 100, len(rows)))
                    held = [[{"left": x, "right": y} for x, y in siblings(own, k) + upper] for k in some]
                    yield pa.RecordBatch.from_arrays([pa.array([tree] * len(some), pa.int64()), pa.array([rows[k]["pos"] for k in some], pa.int64()), pa.array(held, kind), pa.array([root] * len(some), pa.string())], names=PATHS.names)

    joined = blocks.join(F.broadcast(above) if small else above, (blocks["tree"] == above["tree"]) & (blocks["block"] == above["pos"]))
    found = joined.select(blocks["tree"], "n", "rows", "path", "top").mapInArrow(run, PATHS)
    alone = every.where("n = 1").select("tree", "pos", F.array().cast(PATH).alias("path"), F.col("digest").alias("top"))
    return written(found.unionByName(alone)), False


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, id_col: str = "doc_id", group_col: str = "source", seen: Column | None = None, top: int = TOP, levels: int = LEVELS, proofs: bool = False) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) for every row of docs.

    leaf: the row's digest over `columns`; subroot and root: of its group's tree,
    and of the tree over all groups in order, null first. Leaves ascend by id
    (null first), those of one id by digest; equal rows are leaves of their own.
    folded_root is what the digest `seen` (a column of docs, by default the leaf)
    leads to by the row's siblings, proof_sha256 a digest of these, `proof` with
    `proofs` the siblings themselves. A text is hashed where it is read, whatever
    its length; null and empty values have different digests. An empty table
    gives no rows; columns that are not asked for play no part.
    """
    own = leaf([F.col(f"`{c}`") for c in columns])
    leaves = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{group_col}`").alias("group"), F.unhex(own).alias("leaf"), F.unhex(own if seen is None else seen).alias("seen"))
    nodes, trees = _placed(written(leaves))
    blocks = _blocks(nodes.select("tree", "pos", "n", "leaf", "seen", "id"), levels)
    ups, small = paths(_tops(blocks, levels), top, levels)
    roots = ups.where("pos = 0").select("tree", F.col("top").alias("subroot"))
    subs, few = paths(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(trees.count()).alias("n"), F.col("subroot").alias("digest")), top, levels)
    subs = subs.select(F.col("pos").alias("tree"), F.col("path").alias("upper"), F.col("top").alias("root"))
    # the paths of a group's blocks meet its subroot's; a group may have most of all blocks
    whole = ups.join(F.broadcast(subs), "tree") if few else met(ups, subs.join(trees, "tree"), ["tree"], ["pos"])
    whole = whole.select("tree", F.col("pos").alias("block"), "path", "upper", F.col("top").alias("subroot"), "root")
    joined = blocks.join(F.broadcast(whole) if small else whole, ["tree", "block"]).select("n", "rows", "path", "upper", "subroot", "root")
    id_type = docs.schema[id_col].dataType
    schema = T.StructType().add(id_col, id_type).add("leaf", "string").add("subroot", "string").add("root", "string").add("proof_sha256", "string").add("folded_root", "string").add("verified", "boolean")
    if proofs:
        schema = schema.add("proof", PATH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
        for batch in batches:
            n, path, upper, subroot, root = (batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))
            for i, packed in enumerate(batch.column(1)):
                rows = packed.values
                digests, shown = ([x.hex() for x in rows.field(c).to_pylist()] for c in ("leaf", "seen"))
                above = _levels(digests, n[i], levels)
                rest = [(s["left"], s["right"]) for s in path[i] + upper[i]]
                tail = "".join(x + y for x, y in rest).encode()
                hashes, ends, held = [], [], []
                for k in range(len(digests)):
                    near = siblings(above, k)
                    proof = sha256("".join(x + y for x, y in near).encode())
                    proof.update(tail)
                    hashes.append(proof.hexdigest())
                    ends.append(folded(shown[k], near + rest))
                    if proofs:
                        held.append([{"left": x, "right": y} for x, y in near + rest])
                m = len(digests)
                out = [rows.field("id"), pa.array(digests), pa.array([subroot[i]] * m), pa.array([root[i]] * m), pa.array(hashes), pa.array(ends), pa.array([x == root[i] for x in ends])]
                yield pa.RecordBatch.from_arrays([*out, *([pa.array(held, kind)] if proofs else [])], names=schema.names)

    return joined.mapInArrow(run, schema)


def op12_manifest(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    spoilt = F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.replace(F.col("text"), F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return manifest(docs, seen=leaf([spoilt if c == "text" else F.col(c) for c in COLUMNS]))


#: Levels that the SQL reckons with: trees of up to 3**14 leaves.
_DEPTH = 14


def _sql() -> str:
    value = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    h = lambda text: "sha256(" + " || ".join(value(text if c == "text" else c) for c in COLUMNS) + ")"
    crc = "xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"
    out = [
        "z AS (SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)",
        f"d AS (SELECT *, CASE WHEN {crc} % 2 = 0 THEN replace(text, chr(10), '') ELSE text END AS spoilt FROM documents, z)",
        f"l AS (SELECT doc_id, source, {h('text')} AS leaf, {h('spoilt')} AS seen FROM d)",
        "a0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM l)",
        "n0 AS (SELECT source AS tree, pos, leaf AS digest, count(*) OVER (PARTITION BY source) AS n FROM a0)",
    ]

    def climb(nodes: str) -> str:
        """Rows (level, tree, pos, digest, n) of all levels of the trees."""
        out.append(f"{nodes}_up AS (SELECT 0 AS level, tree, pos, digest, n FROM {nodes} UNION ALL SELECT level + 1, tree, pos // {FAN}, sha256(string_agg(digest, '' ORDER BY pos)), (any_value(n) + 2) // {FAN} FROM {nodes}_up WHERE n > 1 AND level < {_DEPTH} GROUP BY level, tree, pos // {FAN})")
        return f"{nodes}_up"

    up = climb("n0")
    out += [
        f"sub AS (SELECT tree, digest AS subroot FROM {up} WHERE n = 1)",
        "n1 AS (SELECT 0 AS tree, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos, tree AS source, subroot AS digest, count(*) OVER () AS n FROM sub)",
    ]
    high = climb("n1")
    steps = lambda name, up, of, tree, key: f"{name} AS (SELECT p.{key}, s.level, string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos < p.pos // pow(3, s.level)::BIGINT) AS lo, string_agg(s.digest, '' ORDER BY s.pos) FILTER (s.pos > p.pos // pow(3, s.level)::BIGINT) AS hi FROM {of} p JOIN {up} s ON s.tree IS NOT DISTINCT FROM p.{tree} AND s.n > 1 AND s.pos // 3 = p.pos // pow(3, s.level)::BIGINT // 3 GROUP BY p.{key}, s.level)"
    out += [
        "a1 AS (SELECT *, row_number() OVER () AS row FROM a0)",
        steps("p0", up, "a1", "source", "row"),
        steps("p1", high, "n1", "tree", "pos"),
        "w AS (SELECT row, list({'l': coalesce(lo, ''), 'h': coalesce(hi, '')} ORDER BY level) AS path FROM p0 GROUP BY row)",
        "v AS (SELECT pos, list({'l': coalesce(lo, ''), 'h': coalesce(hi, '')} ORDER BY level) AS path FROM p1 GROUP BY pos)",
        f"root AS (SELECT digest AS root FROM {high} WHERE n = 1)",
        "j AS (SELECT a1.doc_id, a1.leaf, a1.seen, n1.digest AS subroot, root.root, list_concat(coalesce(w.path, []), coalesce(v.path, [])) AS path FROM a1 JOIN n1 ON n1.source IS NOT DISTINCT FROM a1.source LEFT JOIN w ON w.row = a1.row LEFT JOIN v ON v.pos = n1.pos, root)",
        "f AS (SELECT *, list_reduce(list_concat([{'l': seen, 'h': ''}], path), lambda x, y: {'l': sha256(y.l || x.l || y.h), 'h': ''}).l AS folded_root FROM j)",
    ]
    return "WITH RECURSIVE " + ",\n".join(out) + "\nSELECT doc_id, leaf, subroot, root, sha256(coalesce(list_aggregate(list_transform(path, lambda p: p.l || p.h), 'string_agg', ''), '')) AS proof_sha256, folded_root, folded_root = root AS verified FROM f"


OP12_SQL = _sql()
