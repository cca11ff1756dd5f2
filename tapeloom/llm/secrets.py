"""Secret scans with an incremental blob ledger.

Every historical version of a path is content-addressed by SHA-256.  The ledger holds one row per blob, kind of
rule and rule version that was ever scanned, with the spans found; a run scans only the (blob, rule version) pairs the ledger
lacks, appends them, and joins findings back to all paths.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, ship, spread_join, stored, table, trim

#: kind: (version, pattern, group whose length counts, least length).
RULES = {
    "assign": (1, r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
    "access": (1, r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (1, r"[0-9a-f]+", 0, 24),
}
#: So many unseen blobs or fewer are told to the texts by broadcast, some 60 bytes each; for more, both sides are shuffled.
FEW = 200_000
LEDGER = "blob binary, kind string, version int, spans array<struct<start:bigint,end:bigint>>"


def find_spans(kind: str, text: str, rules: dict = RULES) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches that are long enough, in code points, end exclusive."""
    _, pattern, group, least = rules[kind]
    return [m.span() for m in re.finditer(pattern, text) if m.end(group) - m.start(group) >= least]


def _any_of(low: str) -> bool:
    return "passw" in low or "secret" in low or "token" in low or "api" in low


_HEX = bytes(104 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
#: Cheap tests that a text can hold a kind at all; kinds without one are always searched.
MAY_HOLD = {
    "assign": lambda t: _any_of(t.lower()),
    "access": lambda t: "AKIA" in t,
    "hex": lambda t: b"h" * 24 in t.encode("utf-8", "surrogatepass").translate(_HEX),
}


def _scan(rules: dict):
    compiled = {k: (v, re.compile(p), g, least) for k, (v, p, g, least) in rules.items()}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for blob, kinds, text in zip(frame["blob"], frame["kinds"], frame["content"]):
                for kind in kinds:
                    version, pattern, group, least = compiled[kind]
                    found = pattern.finditer(text) if MAY_HOLD.get(kind, bool)(text) else ()
                    spans = [{"start": m.start(), "end": m.end()} for m in found if m.end(group) - m.start(group) >= least]
                    rows.append((blob, kind, version, spans))
            yield pd.DataFrame(rows, columns=["blob", "kind", "version", "spans"])
        trim()

    return run


def blob_of(content: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(content, F.lit("")).cast("binary"), 256))


def scan_versions(versions: DataFrame, ledger: DataFrame | None = None, rules: dict = RULES, few: int = FEW) -> tuple[DataFrame, DataFrame]:
    """versions: path, content (one row per historical version).  Returns (findings, scanned).

    scanned: the ledger rows this run adds; append them to the stored ledger.  findings: path, blob and per kind its spans
    for every version, from old and new ledger rows.  Null content counts as empty, a null path is a path like others; equal
    contents are scanned once; repeated rows repeat in findings; texts are searched whole; an empty table gives empty results.  Up to
    *few* unseen blobs are told to the texts by broadcast; with 0, texts go to them by one shuffle at every size.
    """
    spark = versions.sparkSession
    ship(spark)
    paths = stored(versions.select("path", blob_of(F.col("content")).alias("blob")))
    first = paths.groupBy("blob").agg(F.min("path").alias("path"))
    wanted = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(r[0]).alias("version")) for k, r in rules.items()]))
    if ledger is not None:
        pairs = first.select("blob", "path", wanted.alias("r")).select("blob", "path", "r.*")
        pairs = pairs.join(ledger.select("blob", "kind", "version"), ["blob", "kind", "version"], "left_anti")
        todo = pairs.groupBy("blob", "path").agg(F.collect_list("kind").alias("kinds"))
    else:
        todo = first.withColumn("kinds", F.array(*map(F.lit, rules)))
    todo = stored(todo.select(F.col("path").alias("_path"), F.col("blob").alias("_blob"), "kinds"))
    if few and todo.count() <= few:
        todo = F.broadcast(todo)
    content = F.coalesce(F.col("content"), F.lit(""))
    texts = versions.select("path", content.alias("content")).join(todo, F.col("path").eqNullSafe(F.col("_path")) & (blob_of(F.col("content")) == F.col("_blob")))
    scanned = stored(texts.select(F.col("_blob").alias("blob"), "kinds", "content").mapInPandas(_scan(rules), LEDGER))
    known = scanned.dropDuplicates(["blob", "kind", "version"])
    if ledger is not None:
        now = F.coalesce(*[F.when(F.col("kind") == k, F.lit(r[0])) for k, r in rules.items()])
        known = known.unionByName(ledger.select("blob", "kind", "version", "spans").where(F.col("version") == now))
    per_kind = [F.max(F.when(F.col("kind") == k, F.col("spans"))).alias(f"_{k}") for k in rules]
    found = stored(known.where(F.size("spans") > 0).groupBy("blob").agg(*per_kind))
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    joined = spread_join(paths, found, "blob", "left")
    return joined.select("path", "blob", *[F.coalesce(f"_{k}", empty).alias(k) for k in rules]), scanned


def update_ledger(versions: DataFrame, path: str, rules: dict = RULES) -> tuple[DataFrame, DataFrame]:
    """scan_versions() against the ledger stored at *path*, to which what was scanned is appended; no ledger there yet: an empty
    one.  A run that failed before may have left rows twice; they count once."""
    spark = versions.sparkSession
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
    findings, scanned = scan_versions(versions, spark.read.schema(LEDGER).parquet(path) if there else None, rules)
    scanned.write.mode("append").parquet(path)
    return findings, scanned


def listing(kinds: list[str]) -> Column:
    """kind:start:end of all spans by start, then kind as listed, joined by commas."""

    def named(i: int, kind: str) -> Column:
        return F.transform(kind, lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), F.concat_ws(":", F.lit(kind), s["start"], s["end"]).alias("name")))

    marked = [named(i, kind) for i, kind in enumerate(kinds)]
    return F.array_join(F.transform(F.array_sort(F.concat(*marked)), lambda s: s["name"]), ",")


def op2_blob_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every document from a stored ledger that two runs fill: the first sees about half of the blobs, the second
    sees all documents and scans those that the ledger lacks.  Nulls, empty and long texts as in scan_versions()."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    ledger = shared_dir(spark)
    update_ledger(docs.where(F.pmod(F.xxhash64(F.coalesce("content", F.lit(""))), F.lit(2)) == 0), ledger)
    findings, _ = update_ledger(docs, ledger)
    spans = listing(list(RULES))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in RULES]
    rows = findings.select(F.col("path").alias("doc_id"), *counts, spans.alias("spans"), F.hex("blob").alias("blob"))
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), "spans", F.lower("blob").alias("blob"))
