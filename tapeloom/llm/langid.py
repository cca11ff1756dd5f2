"""Language identification by Bayesian fusion of text, declared language, address and host evidence.

Text: hashed letter trigrams, multinomial likelihood per language learned from all labelled rows by grouped
aggregation; the mean log-likelihood counts for at most EVIDENCE trigrams, since neighbouring trigrams depend
on each other.  Words with digits or signs of keys and addresses are cut out; their share of the words speaks for no
language.  Declared language: its confusion with the text decision.  Address suffix and host: shares of text
posteriors, the host smoothed by its parent and the parent by the whole collection.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship, spread_join, stored, table

UNKNOWN = "und"
#: A declared language is one of the model's if so many rows with a text declare it, and such a share of those that declare any.
LANGUAGE_ROWS, LANGUAGE_SHARE = 10, 0.005
BUCKETS, EVIDENCE, STRENGTH, UNKNOWN_PRIOR, LEAST = 1 << 14, 60.0, 20.0, 0.001, 0.5
#: Share of a flat distribution in every language, and the level of a trigram in no language.
FLAT, UNKNOWN_LOG = 0.02, -11.0
#: Evidence for no language of a text whose words are all cut out, in nats; in proportion for a part of them.
CUT = 30.0
_SIGNS, _SPACES = np.isin(np.arange(256), list(b"0123456789@=_/\\")), np.isin(np.arange(256), list(b" \t\n\v\f\r"))


def evidence(text: str) -> tuple[np.ndarray, float]:
    """Buckets of the byte trigrams of a text and the share of its words left out of them.  Words that hold digits or
    signs of addresses and keys are cut out, every run of white space is one blank; no other word: no trigram."""
    b = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8)
    space, share = _SPACES[b], 0.0
    keep = np.append(~(space[1:] & space[:-1]), True)
    if (sign := _SIGNS[b]).any():
        word = np.cumsum(space)
        drop = np.zeros(int(word[-1]) + 1, bool)
        drop[word[sign]] = True
        share = float(drop.sum() / (np.count_nonzero(keep & space) - 1))
        keep &= ~drop[word]
    b = np.where(space, np.uint8(32), b)[keep].astype(np.uint32)
    return ((b[:-2] * np.uint32(0x9E3779B1) ^ b[1:-1] * np.uint32(0x85EBCA77)) * np.uint32(31) + b[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(18), share


def trigrams(text: str) -> np.ndarray:
    return evidence(text)[0]


def _count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    totals: dict[str, np.ndarray] = {}
    for frame in frames:
        for lang, text in zip(frame["lang"], frame["text"]):
            if lang not in totals:
                totals[lang] = np.zeros(BUCKETS, np.int64)
            grams = trigrams(text)
            if len(grams) > BUCKETS // 8:
                totals[lang] += np.bincount(grams, minlength=BUCKETS)
            else:
                np.add.at(totals[lang], grams, 1)
    for lang, n in totals.items():
        at = np.flatnonzero(n)
        yield pd.DataFrame({"lang": lang, "bucket": at, "n": n[at]})


def languages_of(labelled: DataFrame, rows: int = LANGUAGE_ROWS, share: float = LANGUAGE_SHARE) -> tuple[str, ...]:
    """Two-letter codes, in order, that enough rows with a text declare; as there are at most 1 / *share* of them, they come to the driver."""
    declared = labelled.where("text is not null").select(code(F.col("lang")).alias("lang")).where("lang is not null").groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    total = declared.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return tuple(sorted(r["lang"] for r in declared.where(F.col("n") >= max(rows, share * total)).collect()))


class Model(NamedTuple):
    """Log-probabilities, one row per bucket, one column per language and a constant one for UNKNOWN."""

    logs: np.ndarray
    languages: tuple[str, ...]


def train(labelled: DataFrame, languages: tuple[str, ...] | None = None) -> Model:
    """labelled: text, lang.  Without *languages*, those of languages_of(); len(languages) * BUCKETS sums come to the driver.  Rows of
    other or no language, or no text, are left out."""
    ship(labelled.sparkSession)
    languages = languages_of(labelled) if languages is None else languages
    rows = labelled.select(code(F.col("lang")).alias("lang"), "text").where(F.col("lang").isin(*languages) & F.col("text").isNotNull())
    sums = rows.mapInPandas(_count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.full((BUCKETS, len(languages)), 0.5)
    for i, lang in enumerate(languages):
        own = sums[sums["lang"] == lang]
        counts[own["bucket"].to_numpy(), i] += own["n"].to_numpy()
    logs = np.log((1 - FLAT) * counts / counts.sum(axis=0) + FLAT / BUCKETS)
    return Model(np.hstack([logs, np.full((BUCKETS, 1), UNKNOWN_LOG)]).astype(np.float32), tuple(languages))


def code(declared: Column) -> Column:
    """Two-letter code of a declared language such as en-US; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(F.trim(F.coalesce(declared.cast("string"), F.lit(""))), r"^([A-Za-z]{2})(?:[-_].*)?$", 1)), F.lit(""))


def parent(host: Column) -> Column:
    """The host without its first label, or a plain name without its number."""
    return F.when(F.size(F.split(host, r"\.")) > 2, F.regexp_replace(host, r"^[^.]*\.", "")).when(host.contains("."), host).otherwise(F.regexp_replace(host, r"\d+$", ""))


def _normal(logs: Column) -> Column:
    """Logs to probabilities that sum to 1."""
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _share(mass: str, n: str, over: Column) -> Column:
    return F.transform(F.zip_with(mass, over, lambda m, p: m + STRENGTH * p), lambda x: x / (F.col(n) + STRENGTH))


def _masses(rows: DataFrame, key: str, width: int, out: str) -> DataFrame:
    """Sums of text posteriors by key."""
    return rows.groupBy(key).agg(F.array(*[F.sum(F.col("text_p")[i]) for i in range(width)]).alias(f"{out}_mass"), F.count(F.lit(1)).cast("double").alias(f"{out}_n"))


def identify(records: DataFrame, model: Model, least: float = LEAST) -> DataFrame:
    """records: key, text, declared, host, suffix.  Returns key, language, posterior, text_language, keep.

    keep: the text has a letter, and the language found is one of the model's with posterior >= *least*.  Null and empty
    texts, texts without letters and texts of cut words alone (keys, addresses) are und and not kept.  Null declared,
    host or suffix give no evidence (a null host takes the collection's prior).  Ties go to the first language.  Rows
    repeat as given; texts count whole, their evidence for at most EVIDENCE trigrams; an empty table gives an empty result.
    """
    languages = model.languages
    spark, width = records.sparkSession, len(languages) + 1
    ship(spark)
    names = F.array(*[F.lit(x) for x in (*languages, UNKNOWN)])
    shared = spark.sparkContext.broadcast(model.logs)

    @F.pandas_udf("array<double>")
    def likelihood(texts: pd.Series) -> pd.Series:
        m, out = shared.value, []
        for t in texts:
            grams, cut = evidence(t)
            if not len(grams):
                out.append(None)
                continue
            ll = m[grams].mean(axis=0, dtype=np.float64) * min(len(grams), EVIDENCE)
            ll[-1] += CUT * cut
            out.append(ll)
        return pd.Series(out)

    text = F.coalesce("text", F.lit(""))
    rows = records.select("key", code(F.col("declared")).alias("declared"), F.lower("host").alias("host"), F.lower("suffix").alias("suffix"), text.rlike(r"\p{L}").alias("letters"), likelihood(text).alias("ll"))
    rows = rows.withColumn("letters", F.col("letters") & F.col("ll").isNotNull())
    prior = F.array(*[F.lit((1 - UNKNOWN_PRIOR) / max(1, width - 1))] * (width - 1), F.lit(UNKNOWN_PRIOR))
    rows = rows.withColumn("text_p", _normal(F.zip_with("ll", F.transform(prior, F.ln), lambda a, b: a + b)))
    rows = stored(rows.withColumns({"text_language": F.when(F.col("letters"), names[(F.array_position("text_p", F.array_max("text_p")) - 1).cast("int")]).otherwise(UNKNOWN), "parent": parent(F.col("host"))}))
    sure = rows.where("letters")

    known = F.when(F.col("declared").isin(*languages), F.col("declared")).otherwise("other")
    seen = {(r["d"], r["text_language"]): r["n"] for r in sure.where("declared is not null").groupBy(known.alias("d"), "text_language").agg(F.count(F.lit(1)).alias("n")).collect()}
    kinds = (*languages, "other")

    def says(d: str) -> Column:
        rate = [(seen.get((d, t), 0) + 1.0 / len(kinds)) / (sum(seen.get((k, t), 0) for k in kinds) + 1.0) for t in (*languages, UNKNOWN)]
        return F.array(*[F.lit(float(np.log(x))) for x in rate])

    declared_log = F.coalesce(*[F.when(F.col("declared").isNotNull() & (known == d), says(d)) for d in kinds], F.array(*[F.lit(0.0)] * width))

    whole = sure.agg(*[F.coalesce(F.sum(F.col("text_p")[i]), F.lit(0.0)) for i in range(width)], F.count(F.lit(1))).first()
    overall = F.array(*[F.lit((whole[i] + 1.0 / width) / (whole[width] + 1.0)) for i in range(width)])
    parents = _masses(sure.where("parent is not null"), "parent", width, "parent")
    parents = parents.select("parent", _share("parent_mass", "parent_n", overall).alias("parent_p"))
    hosts = _masses(sure.where("host is not null"), "host", width, "host").withColumn("parent", parent(F.col("host")))
    hosts = stored(hosts.join(parents, "parent").select("host", _share("host_mass", "host_n", F.col("parent_p")).alias("host_p")))
    suffixes = _masses(sure.where("suffix is not null"), "suffix", width, "suffix")
    ratio = F.zip_with(_share("suffix_mass", "suffix_n", overall), overall, lambda a, b: F.ln(a / b))
    suffixes = stored(suffixes.select("suffix", ratio.alias("suffix_log")))

    all_ = spread_join(rows, hosts, "host", "left", nulls=True).join(suffixes, "suffix", "left")
    zero = F.array(*[F.lit(0.0)] * width)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    logs = add(add(F.col("ll"), F.transform(F.coalesce("host_p", overall), F.ln)), add(declared_log, F.coalesce("suffix_log", zero)))
    all_ = all_.withColumn("p", _normal(logs))
    best = F.array_max("p")
    language = F.when(F.col("letters"), names[(F.array_position("p", best) - 1).cast("int")]).otherwise(UNKNOWN)
    all_ = all_.select("key", language.alias("language"), F.when(F.col("letters"), best).otherwise(0.0).alias("posterior"), "text_language")
    return all_.withColumn("keep", (F.col("language") != UNKNOWN) & (F.col("posterior") >= least))


def content(*names: str) -> Column:
    """Hash of columns in which a null differs from every value."""
    return F.xxhash64(*[x for n in names for x in (F.col(n).isNull(), F.col(n))])


def document_records(docs: DataFrame) -> DataFrame:
    """Documents declare lang, and their source stands for the host."""
    key = F.struct(F.col("doc_id").alias("doc_id"), content("text", "lang", "source").alias("content"))
    return docs.select(key.alias("key"), "text", F.col("lang").alias("declared"), F.col("source").cast("string").alias("host"), F.lit(None).cast("string").alias("suffix"))


def page_records(pages: DataFrame) -> DataFrame:
    """Pages: text outside tags, the lang attribute of html, the host, and the language part of the address or else its
    last label."""
    html = F.coalesce("html", F.lit(""))
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " "), r"(?s)<[^>]*>", " ")
    host = F.nullif(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit(""))
    path = F.nullif(F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^/]+/([A-Za-z]{2})(?:[/?#]|$)", 1), F.lit(""))
    declared = F.regexp_extract(html, r"(?i)<html[^>]*\slang\s*=\s*[\"']?([A-Za-z_-]+)", 1)
    return pages.select(F.struct("page_id").alias("key"), bare.alias("text"), declared.alias("declared"), host.alias("host"), F.coalesce(F.concat(F.lit("/"), path), F.concat(F.lit("."), F.substring_index(host, ".", -1))).alias("suffix"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document; nulls, empty and long texts, ties and repeats as in identify()."""
    docs = table(spark, sf_dir, "documents")
    found = identify(document_records(docs), train(docs))
    return found.select("key.doc_id", "language", "posterior", "text_language", "keep")


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every page by a model of the documents; a null html or url gives no text or no evidence, the rest as in identify()."""
    found = identify(page_records(table(spark, sf_dir, "pages")), train(table(spark, sf_dir, "documents")))
    return found.select("key.page_id", "language", "posterior", "text_language", "keep")
