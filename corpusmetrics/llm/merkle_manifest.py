"""Merkle manifest of a table: a ternary hash tree a group, one over the groups, and a proof for each row.

Spark hashes the rows to leaves and numbers them within their groups by range partitions and
counts, with no window over rows.  The leaves of a group then fall into aligned buckets of
3**LEVELS consecutive ones, so a bucket is a whole subtree.  Tasks get several buckets as one
Arrow table and run the levels as DuckDB queries (ordered string_agg, sha256).  What a bucket
leaves is a node of the next round, with the same code, until each group has one root; the
roots, ordered by group, are numbered and climbed in the same way.  On the way down Spark
joins the siblings above a bucket (one row a bucket) to its leaves, and DuckDB folds them.

Defined results: a null doc_id comes first in its group and is never tampered with; rows of
equal doc_id (ties) are ordered by their leaves, so repeated rows stand side by side and have the
same leaf at different places; a null group is a group, the first one, apart from the empty
string; null values hash as ``-``, empty ones as ``0:``; texts of any length are hashed whole;
an empty table gives an empty result; columns beyond the named ones, whatever their names, are not read.
"""

from __future__ import annotations

import duckdb
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions_for, stored

#: Nodes of a run, and levels of a bucket: 3**6 = 729 leaves.
FANOUT, LEVELS = 3, 6
#: Nodes that one DuckDB session works on, about.
TOGETHER = 3000
#: Columns of a document that make its leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

_SIDES = "lefts array<string>, rights array<string>"


def leaf(*values: Column) -> Column:
    """sha256 over ``-`` for each null, byte count, colon and value for each other."""
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in (v.cast("string") for v in values)]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """rows with pos (from 0, by ``order``, within g) and n (rows of g).

    Range partitions hold the rows in order; a row's place in its partition and the counts of the
    partitions before give its position.  Rows that agree in all of ``order`` are told apart by ``tie``,
    a number that the stored rows already have, so that many equal ones spread over partitions too.
    """
    spark = rows.sparkSession
    parts = partitions_for(spark, 200.0 * rows.count())
    ordered = rows.repartitionByRange(parts, "g", *order, "tie").sortWithinPartitions("g", *order, "tie")
    ordered = stored(ordered.withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)).drop("tie"), "ordered")
    counts = ordered.groupBy("g", "part").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    before = F.sum("rows").over(Window.partitionBy("g").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.withColumn("shift", F.coalesce(before, F.lit(0)) - F.col("first")).withColumn("n", F.sum("rows").over(Window.partitionBy("g")))
    return ordered.join(counts.select("g", "part", "shift", "n"), ["g", "part"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "part", "shift")


def _session(**tables: pa.Table) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    for name, rows in tables.items():
        con.register(name, rows)
    return con


def _levels(con, levels: int) -> None:
    """Tables level0, level1, ... of the nodes: one row (g, pos, n, h) for each node that is left."""
    con.execute("CREATE TABLE level0 AS SELECT g, pos, n, h FROM nodes")
    for k in range(levels):
        con.execute(
            f"CREATE TABLE level{k + 1} AS SELECT g, pos // {FANOUT} AS pos, (any_value(n) + {FANOUT - 1}) // {FANOUT} AS n, "
            f"CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM level{k} GROUP BY g, pos // {FANOUT}"
        )


def _up(levels: int, rows: pa.Table) -> pa.Table:
    """The subtree roots of whole buckets."""
    with _session(nodes=rows) as con:
        _levels(con, levels)
        return con.sql(f"SELECT g, pos, n, h FROM level{levels}").to_arrow_table()


def _siblings(con, levels: int) -> None:
    """Table sided: each leaf of level0 with the digests to its left and right, level by level up to its bucket's root."""
    con.execute("CREATE TABLE sided AS SELECT g, pos, []::VARCHAR[] AS lefts, []::VARCHAR[] AS rights FROM level0")
    for k in range(levels):
        run = f"(PARTITION BY g, pos // {FANOUT} ORDER BY pos ROWS BETWEEN"
        con.execute(
            f"CREATE OR REPLACE TABLE beside AS SELECT g, pos, coalesce(string_agg(h, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
            f"coalesce(string_agg(h, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM level{k} WHERE n > 1"
        )
        con.execute(
            "CREATE OR REPLACE TABLE sided AS SELECT s.g, s.pos, CASE WHEN b.l IS NULL THEN lefts ELSE list_append(lefts, b.l) END AS lefts, "
            f"CASE WHEN b.l IS NULL THEN rights ELSE list_append(rights, b.r) END AS rights FROM sided s LEFT JOIN beside b ON s.g = b.g AND s.pos // {FANOUT**k} = b.pos"
        )


def _whole(con, levels: int) -> None:
    """Table whole: the nodes with all siblings up to the root, those above their bucket included."""
    _levels(con, levels)
    _siblings(con, levels)
    con.execute(
        "CREATE TABLE whole AS SELECT n.*, list_concat(s.lefts, o.lefts) AS lefts, list_concat(s.rights, o.rights) AS rights, o.subroot, o.root "
        f"FROM nodes n JOIN sided s USING (g, pos) JOIN above o ON n.g = o.g AND n.pos // {FANOUT**levels} = o.pos"
    )


def _down(levels: int, rows: pa.Table, above: pa.Table) -> pa.Table:
    """The nodes of whole buckets with all siblings up to the root."""
    with _session(nodes=rows, above=above) as con:
        _whole(con, levels)
        return con.sql("SELECT g, pos, lefts, rights, subroot, root FROM whole").to_arrow_table()


def _fold(levels: int, rows: pa.Table, above: pa.Table) -> pa.Table:
    """The leaves of whole buckets: digest of the proof, and the root that the tampered leaf folds to."""
    with _session(nodes=rows, above=above) as con:
        _whole(con, levels)
        con.execute("CREATE TABLE folded AS SELECT *, coalesce(tampered, h) AS cur FROM whole")
        for k in range(1, (con.sql("SELECT max(len(lefts)) FROM folded").fetchall()[0][0] or 0) + 1):
            con.execute(f"CREATE OR REPLACE TABLE folded AS SELECT * REPLACE (CASE WHEN len(lefts) < {k} THEN cur ELSE sha256(concat(lefts[{k}], cur, rights[{k}])) END AS cur) FROM folded")
        proof = "sha256(array_to_string(list_transform(range(1, len(lefts) + 1), lambda k: concat(lefts[k], rights[k])), ''))"
        return con.sql(f"SELECT doc_id, h AS leaf, subroot, root, {proof} AS proof_sha256, cur AS folded_root, cur = root AS verified FROM folded").to_arrow_table()


def _climbed(nodes: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The nodes of each round, leaves first, and one root (g, h) a group."""
    rounds, bucket = [nodes], FANOUT**levels
    most = nodes.agg(F.max("n")).first()[0] or 1
    while True:
        task = _task(F.floor(F.col("pos") / bucket), rounds[-1].count())
        tops = stored(rounds[-1].select("g", "pos", "n", "h").groupBy(task).applyInArrow(lambda rows: _up(levels, rows), "g string, pos long, n long, h string"), "nodes")
        if most <= bucket:
            return rounds, tops
        most = -(-most // bucket)
        rounds.append(tops)


def _task(bucket: Column, rows: int) -> Column:
    """The task that works on a bucket: the same for its nodes and the row with what lies above it."""
    return F.pmod(F.xxhash64("g", bucket.cast("long")), F.lit(rows // TOGETHER + 1)).alias("task")


def _descended(rounds: list[DataFrame], above: DataFrame, levels: int, finish, schema: str) -> DataFrame:
    """Joins what lies above the roots to them and goes down round by round; the first round is worked on by ``finish``."""
    for k in range(len(rounds) - 1, -1, -1):
        size = rounds[k].count()
        nodes = rounds[k].groupBy(_task(F.floor(F.col("pos") / FANOUT**levels), size))
        over = above.groupBy(_task(F.col("pos"), size))
        work, out = (finish, schema) if k == 0 else (_down, f"g string, pos long, {_SIDES}, subroot string, root string")
        above = nodes.cogroup(over).applyInArrow(_bound(work, levels), out)
        above = stored(above, "above") if k else above
    return above


def _bound(work, levels: int):
    def run(rows: pa.Table, above: pa.Table) -> pa.Table:
        return work(levels, rows, above)

    return run


def _named(levels: int, rows: pa.Table, above: pa.Table) -> pa.Table:
    """As _down, keyed by the groups that the nodes stand for."""
    with _session(nodes=rows, above=above) as con:
        _whole(con, levels)
        return con.sql("SELECT name AS g, 0::BIGINT AS pos, lefts, rights, h AS subroot, root FROM whole").to_arrow_table()


def manifest(leaves: DataFrame, levels: int = LEVELS) -> DataFrame:
    """For leaves (g: null or a group's name; doc_id; h: the leaf; tampered: the leaf to fold, null for h itself):
    doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    g = F.coalesce(F.concat(F.lit("s"), "g"), F.lit("n"))  # the null group before all others, the others bytewise
    leaves = stored(leaves.select(g.alias("g"), "doc_id", "h", "tampered").withColumn("tie", F.monotonically_increasing_id()), "leaves")
    leaves = stored(numbered(leaves, "doc_id", "h"), "numbered")
    rounds, subroots = _climbed(leaves, levels)
    names = subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "h", F.lit(0).alias("tie"))
    names = stored(numbered(names, "name"), "names")
    outer, root = _climbed(names, levels)
    none = F.array().cast("array<string>")
    top = root.select("g", F.lit(0).cast("long").alias("pos"), none.alias("lefts"), none.alias("rights"), F.col("h").alias("subroot"), F.col("h").alias("root"))
    above = stored(_descended(outer, top, levels, _named, f"g string, pos long, {_SIDES}, subroot string, root string"), "above")
    return _descended(rounds, above, levels, _fold, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def merkle_manifest(docs: DataFrame, tampered: Column, tampering: Column, levels: int = LEVELS) -> DataFrame:
    """The manifest of documents, a tree for each source; where ``tampered`` holds, ``tampering`` stands for the text when folding."""
    doc_id = F.col("doc_id").cast("long")
    fields = {c: doc_id if c == "doc_id" else F.col(c) for c in FIELDS}
    changed = F.when(tampered, leaf(*(fields | {"text": tampering}).values()))
    return manifest(docs.select(F.col("source").cast("string").alias("g"), doc_id.alias("doc_id"), leaf(*fields.values()).alias("h"), changed.alias("tampered")), levels)
