"""A corpus pipeline of five training-data operators over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import bagminhash, langid, mixing, pieces, secrets
from tapeloom.llm.bagminhash import _small as few
from tapeloom.llm.common import numbered, spread_join, stored, sub_groups, table

MARK = "[SECRET]"
#: Spans of up to so many bytes are told to all tasks; beyond, rows meet them by a shuffle in which no text that many rows share goes to one task.
TOLD = 32 << 20


def whole(docs: DataFrame) -> DataFrame:
    """Each row as one struct, beside which a stage's own columns clash with no column of the table."""
    return docs.select(F.struct("*").alias("row"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known with enough certainty.

    The languages are those that enough rows declare.  Rows are judged by text, declared language and source: rows that repeat an id are
    judged one by one.  Null, empty and letterless texts go, as do texts that fit no language better than none; a text in a language that too few
    rows declare may pass as one that is near to it.  Texts count whole.  Ties of languages go to the first one.  An
    empty table stays empty; columns and their names are kept, whatever they are.
    """
    found = langid.identify(langid.document_records(docs), langid.train(docs))
    gone = stored(found.where("not keep").select("key.*").distinct())
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (langid.content("row.text", "row.lang", "row.source") == F.col("content"))
    return whole(docs).join(gone, same, "left_anti").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near-duplicates: the one of least id (null last), digest of the text and other columns.

    Rows are told apart by id and text, so other texts of a repeated id, or without an id, stay.  Null, empty and blank texts are like
    nothing but themselves under the same id.  Texts count whole; an empty table stays empty; columns are kept, whatever they are.
    """
    found = stored(bagminhash.labelled(docs).select("doc_id", "digest", "times", "label"))
    first = found.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first"))
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest"))
    chosen = spread_join(found, first, "label").select("doc_id", "digest", "times", is_first.alias("kept"))
    gone = few(stored(chosen.where("not kept or times > 1")))
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (bagminhash.digest(F.col("row.text")) == F.col("digest"))
    rows = whole(docs)
    kept = rows.join(gone, same, "left_anti")
    again = gone.where("kept")
    if not again.isEmpty():
        twins = rows.join(again, same, "left_semi").groupBy("row.doc_id", bagminhash.digest(F.col("row.text")))
        kept = kept.unionByName(twins.agg(F.min_by("row", F.to_json("row")).alias("row")).select("row"))  # maps have no order, their text has
    return kept.select("row.*")


def _masked(text: Column, spans: Column) -> Column:
    """*text* with *spans* (ascending, apart) replaced, from the last to the first."""
    cut = lambda t, s: F.concat(F.substring(t, F.lit(1), s["start"].cast("int")), F.lit(MARK), F.substring(t, (s["end"] + 1).cast("int"), F.length(t)))
    return F.aggregate(F.reverse(spans), text, cut)


def _merged(spans: Column) -> Column:
    """Overlapping spans joined, in ascending order."""
    start = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def add(held: Column, s: Column) -> Column:
        last = F.element_at(held, -1)
        joined = F.concat(F.slice(held, 1, F.size(held) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(held) > 0) & (F.get(held, F.size(held) - 1)["end"] > s["start"]), joined).otherwise(F.concat(held, F.array(s)))

    return F.aggregate(F.array_sort(spans), start, add)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret found masked; n_chars, if there is such a column, follows the text.

    Null and empty texts hold no secret and stay as they are; texts are searched whole; overlapping spans are masked once; rows
    repeat as given; an empty table stays empty; other columns are kept, whatever they are.
    """
    findings, _ = secrets.scan_versions(docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content")), few=0)
    spans = F.concat(*secrets.RULES)
    hits = stored(findings.where(F.size(spans) > 0).select("blob", _merged(spans).alias("spans")).dropDuplicates(["blob"]))
    size = hits.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("spans")), F.lit(0))).first()
    rows = whole(docs).withColumn("blob", secrets.blob_of(F.col("row.text")))
    if 64 * size[0] + 16 * size[1] <= TOLD:
        joined = rows.join(F.broadcast(hits), "blob", "left")
    else:
        joined = spread_join(rows, hits, "blob", "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(_masked(F.col("row.text"), F.col("spans")))
    made = {"text": text}
    if "n_chars" in docs.columns:
        made["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length(text)).cast(dict(docs.dtypes)["n_chars"])
    return joined.select(*[made.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it.

    Copies are joined back by id, text and source.  Rows that agree in these take the same copies, and some of them, in
    order of their other columns, one more.  Null, empty and blank texts have no words; the mix takes them once in a source without
    words, else as its rates say.  A null source is one of the sources.  An empty table stays empty; columns are kept, whatever they are.
    """
    keys = ["doc_id", "content"]
    rows = docs.select("doc_id", "text", "source", langid.content("text", "source").alias("content"), F.struct("*").alias("row"))
    mixed = mixing.entropy_mix(rows, carry=("content",))
    dealt = mixed.groupBy(*[F.col(k).alias(f"{k}_") for k in keys]).agg(F.min("copies").alias("each"), (F.sum("copies") - F.min("copies") * F.count(F.lit(1))).alias("more"))
    dealt = stored(dealt.where("each + more > 0"))
    same = F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("content") == F.col("content_"))
    joined = rows.join(few(dealt.where("more = 0")), same).select("row", F.col("each").alias("copies"))
    uneven = dealt.where("more > 0")
    if not uneven.isEmpty():
        written = F.to_json("row").alias("written")  # maps have no order, their text has
        twins = rows.join(uneven, same).select(F.struct(*keys).alias("key"), "row", "each", "more", written)  # nulls in a struct are equal
        sub = F.pmod(F.xxhash64("written"), F.lit(sub_groups(0, 1))).cast("int")
        twins = numbered(twins, ["key"], ["written"], sub, "place")
        joined = joined.unionByName(twins.select("row", (F.col("each") + (F.col("place") < F.col("more")).cast("long")).alias("copies")))
    return joined.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids by merge-dropout beside the columns of documents; a column named ids is replaced.

    Null and empty texts have no ids; texts count whole; a null doc_id draws as 0 does; rows repeat as given, an empty table stays empty.
    """
    return pieces.encode_documents(docs)


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("secret_scan", secret_scan),
    ("source_mixing", source_mixing),
    ("sentencepiece", sentencepiece),
]

#: Trained models, signatures and keyed hashes have no SQL form; tests hold the result against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
