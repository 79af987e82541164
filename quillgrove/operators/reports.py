"""Reports for readers, and proofs of excerpts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import trees
from ..plans.register import Register, dimensions


def excerpt_proofs(docs: DataFrame, reg: Register, read: Callable[[bytes], object] | None = None, *, id_col: str = "doc_id", raw_col: str = "raw", domain: str = "node") -> DataFrame:
    """For each document's middle block: siblings and bytes of its proof, that it holds, and that a forged leaf fails."""
    read = read or trees.load_json

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                leaves = trees.block_digests(read(raw), reg, domain.encode())
                levels, root, middle = trees.merkle_levels(leaves), trees.merkle_root(leaves), len(leaves) // 2
                proof = trees.merkle_proof(levels, middle) if leaves else []
                forged = trees.structural_hash(trees.text("forged"), domain.encode())
                out.append((doc_id, len(leaves), len(proof), 32 * len(proof), bool(leaves) and trees.merkle_holds(leaves[middle], proof, root), bool(leaves) and trees.merkle_holds(forged, proof, root)))
            names = ["doc_id", "blocks", "siblings", "bytes", "holds", "forged_holds"]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names)

    return docs.select(F.col(id_col).cast("string").alias("doc_id"), raw_col).mapInArrow(run, "doc_id string, blocks long, siblings long, bytes long, holds boolean, forged_holds boolean")


def control_statistics(labelled: DataFrame) -> DataFrame:
    """One row over labelled controls: how many had no label of their own, and what rescued them."""
    return labelled.agg(
        F.count("*").alias("controls"),
        F.count_if(~F.col("way").isin("for", "wrapping")).alias("unlabelled"),
        F.count_if(F.col("way") == "aria").alias("by_aria"),
        F.count_if(F.col("way") == "placeholder").alias("by_placeholder"),
        F.count_if(F.col("way") == "none").alias("none"),
    ).withColumn("percent_unlabelled", F.round(100 * F.col("unlabelled") / F.greatest("controls", F.lit(1)), 1))


def finding_totals(findings: DataFrame) -> DataFrame:
    """genre, key, n over all documents of a genre."""
    return findings.groupBy("genre", "key").agg(F.sum("n").alias("n"))


def action_statistics(findings: DataFrame) -> DataFrame:
    """One row from form findings (key, n): actions, how many of them lead elsewhere, and their share."""
    n = lambda k: F.coalesce(F.sum(F.when(F.col("key") == k, F.col("n"))), F.lit(0))
    held = findings.agg(n("actions").alias("actions"), n("cross_origin").alias("cross_origin"))
    return held.withColumn("percent", F.round(100 * F.col("cross_origin") / F.greatest("actions", F.lit(1)), 1))


def by_genre(nodes: DataFrame, diags: DataFrame, findings: DataFrame, reg: Register) -> DataFrame:
    """genre, section, key, n of every genre's report: documents and those that conform, elements used, rules broken, findings.

    nodes and diags have a `genre`; findings are (genre, key, n).
    """
    documents = nodes.where("depth = 0").select("genre", "doc_id")
    faulty = diags.select("genre", "doc_id").distinct().withColumn("faulty", F.lit(True))
    state = documents.join(faulty, ["genre", "doc_id"], "left").groupBy("genre").agg(F.count("*").alias("documents"), F.count_if(F.col("faulty").isNull()).alias("conforming"))
    coverage = state.select("genre", F.lit("coverage").alias("section"), F.expr("stack(2, 'documents', documents, 'conforming', conforming) as (key, n)"))
    known = F.broadcast(dimensions(nodes.sparkSession, reg)["elements"].select("t"))
    part = lambda rows, section, key: rows.groupBy("genre", F.col(key).alias("key")).agg(F.count("*").alias("n")).select("genre", F.lit(section).alias("section"), "key", "n")
    found = findings.groupBy("genre", "key").agg(F.sum("n").cast("long").alias("n")).select("genre", F.lit("findings").alias("section"), "key", "n")
    return coverage.unionAll(part(nodes.join(known, "t"), "elements", "t")).unionAll(part(diags, "rules", "rule")).unionAll(found)


#: A line of a report's table of elements.
ELEMENT_LINE = r"^\| `([a-z-]+)` \| L\d"


def element_lines(report: DataFrame, reg: Register) -> DataFrame:
    """genre, line: the lines of each genre's table of elements, as `used_in` reads them."""
    known = F.broadcast(dimensions(report.sparkSession, reg)["elements"].select(F.col("t").alias("key"), "layer"))
    line = F.concat(F.lit("| `"), "key", F.lit("` | L"), F.col("layer").cast("string"), F.lit(" | "), F.col("n").cast("string"), F.lit(" |"))
    return report.where("section = 'elements'").join(known, "key").select("genre", line.alias("line"))


def used_in(spark: SparkSession, path: str) -> DataFrame:
    """genre, t: elements that written reports list; the folder of a report is its genre (`genre=...`)."""
    t = F.regexp_extract("value", ELEMENT_LINE, 1)
    return spark.read.text(path).select("genre", t.alias("t")).where("t <> ''").distinct()


def markdown(report: DataFrame, title: str, most: int = 1000) -> str:
    """A small report (an aggregate of at most `most` rows) as a table for readers."""
    rows = report.limit(most).collect()
    lines = [f"# {title}", "", "| " + " | ".join(report.columns) + " |", "|" + "-|" * len(report.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows]) + "\n"
