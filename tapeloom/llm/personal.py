"""Personal data by bootstrapped contextual extraction, in DataFrame functions alone.

Matches of the base patterns are seeds.  The words before a seed are a lexical pattern; patterns and the identifiers seen after
them (seeds, and candidates that only look like one) form a graph.  In each iteration a pattern's confidence in a kind is the
share of that kind among the distinct identifiers it introduces, and a candidate's score in a kind combines the patterns it follows;
candidates that score high are seeds of the next iteration.  Spans of candidates accepted at the end join those of the base patterns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread_join, stored, table

KINDS = ("email", "ip", "card", "phone")
#: Kinds of spans that the method adds, in the order of the base kinds.
LIKE = tuple(f"{k}_like" for k in KINDS)
_LOCAL = "A-Za-z0-9._%+-"
#: Java patterns.  Each finds what the plain pattern of its kind finds, without going over a stretch again from each of its characters: a match
#: begins where the one before ended or where no character of its first class stands before; what follows takes all it can.
PATTERNS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What may be an identifier of a class: anything round an @, and digits with what people put between them.
CANDIDATES = {"mail": r"(?:\G|(?<![^\x20\x09-\x0D@]))[^\x20\x09-\x0D@]++@[^\x20\x09-\x0D@]++", "number": r"[0-9][0-9().\x20/-]*[0-9]"}
CLASS = {"email": "mail", "ip": "number", "card": "number", "phone": "number"}
NUMBER_DIGITS = (7, 20)
#: Iterations; distinct identifiers of a kind after a pattern, at least; the prior number of others; confidence that a pattern and a candidate need.
ROUNDS, SUPPORT, PRIOR, SURE, ACCEPT = 3, 3, 1.0, 0.7, 0.9
#: Characters before an identifier that its pattern is taken from.
CONTEXT = 80
CHUNK = 64
_HIT = "array<struct<value:string,before:string,start:bigint,end:bigint>>"
_SPACE = r"[\x20\x09-\x0D]+"


def _none(kind: str) -> Column:
    return F.array().cast(kind)


def _total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0).cast("bigint"), lambda a, b: a + b)


def _before(lengths: Column) -> Column:
    """For each number the sum of those before it: sums within chunks on top of sums of whole chunks."""
    chunks = F.sequence(F.lit(0), F.ceil((F.size(lengths) - 1) / CHUNK).cast("int"))
    part = lambda i: F.slice(lengths, i * CHUNK + 1, F.lit(CHUNK))
    sums = F.transform(chunks, lambda i: _total(part(i)))

    def running(i: Column) -> Column:
        start = F.struct(_none("array<bigint>").alias("out"), _total(F.slice(sums, F.lit(1), i)).alias("at"))
        step = lambda a, x: F.struct(F.concat(a["out"], F.array(a["at"])).alias("out"), (a["at"] + x).alias("at"))
        return F.aggregate(part(i), start, step, lambda a: a["out"])

    return F.flatten(F.transform(chunks, running))


def locate(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column]]) -> DataFrame:
    """Per name a column of all matches of its pattern in *text* with their places in code points and what stands before; where
    the condition beside a pattern fails, the text is not searched.

    Matches and the stretches between them come from two passes of the pattern; places are sums of their lengths."""
    found = df.withColumns({f"_h_{n}": F.when(may, F.regexp_extract_all(text, F.lit(p), F.lit(0))) for n, (p, may) in patterns.items()})
    some = {n: F.coalesce(F.size(f"_h_{n}") > 0, F.lit(False)) for n in patterns}
    found = found.withColumns({f"_g_{n}": F.when(some[n], F.split(text, p, -1)) for n, (p, _) in patterns.items()})
    gap = lambda n, i: F.length(F.get(f"_g_{n}", i)).cast("bigint")
    each = lambda n: F.transform(f"_h_{n}", lambda h, i: F.length(h) + gap(n, i))
    found = found.withColumns({f"_l_{n}": F.when(some[n], each(n)) for n in patterns})
    found = found.withColumns({f"_b_{n}": F.when(some[n], _before(F.col(f"_l_{n}"))) for n in patterns})

    def hit(n: str):
        def build(h: Column, i: Column) -> Column:
            start = F.get(f"_b_{n}", i) + gap(n, i)
            return F.struct(h.alias("value"), F.right(F.get(f"_g_{n}", i), F.lit(CONTEXT)).alias("before"), start.alias("start"), (start + F.length(h)).alias("end"))

        return build

    places = {n: F.coalesce(F.when(some[n], F.transform(f"_h_{n}", hit(n))), _none(_HIT)) for n in patterns}
    return found.select(*df.columns, *[c.alias(n) for n, c in places.items()])


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass the checksum: every second one from the right counts as the digit sum of its double."""
    padded = F.lpad(digits, 19, "0")
    doubled = F.translate(padded, "0123456789", "0246813579")
    return reduce(lambda a, b: a + b, [F.substring(padded if i % 2 else doubled, i, 1).cast("int") for i in range(1, 20)]) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """The condition on a match of a base pattern, besides the pattern."""
    count = F.length(_digits(value))
    if kind == "ip":
        return value.rlike(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$")
    if kind == "card":
        return count.between(16, 19) & luhn(_digits(value))
    return count.between(8, 15) if kind == "phone" else F.lit(True)


def find_mentions(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text.  Per row its base matches by kind and, as ``mail`` and ``number``, candidates that overlap none of them."""
    t = F.col("text")
    digit = t.rlike("[0-9]")
    may = {"email": t.contains("@"), "ip": digit, "card": digit, "phone": t.contains("+"), "mail": t.contains("@"), "number": digit}
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = locate(rows, "text", {n: (p, may[n]) for n, p in (PATTERNS | CANDIDATES).items()})
    good = lambda k: F.filter(k, lambda h: valid(k, h["value"]))
    found = found.withColumns({k: good(k) for k in KINDS})
    apart = lambda h: ~F.exists("base", lambda b: (b["start"] < h["end"]) & (h["start"] < b["end"]))
    few, many = NUMBER_DIGITS
    found = found.withColumn("base", F.concat(*KINDS))
    number = F.filter("number", lambda h: F.length(_digits(h["value"])).between(few, many) & apart(h))
    return found.select("doc_id", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"), *KINDS, F.filter("mail", apart).alias("mail"), number.alias("number"))


def _mentions(rows: DataFrame) -> DataFrame:
    """One row per mention in a different text: class, instance, base kind or null, last word and last two words before it."""

    def as_mentions(name: str) -> Column:
        kind = F.lit(name if name in KINDS else None).cast("string")
        group = CLASS.get(name, name)
        value = (lambda h: F.lower(h["value"])) if group == "mail" else (lambda h: _digits(h["value"]))
        return F.transform(name, lambda h: F.struct(F.lit(group).alias("class"), value(h).alias("instance"), kind.alias("kind"), F.split(F.trim(F.regexp_replace(F.lower(h["before"]), _SPACE, " ")), " ").alias("words"), h["start"].alias("start"), h["end"].alias("end")))

    names = [*KINDS, *CANDIDATES]
    some = rows.where(F.size(F.concat(*names)) > 0).dropDuplicates(["digest"])
    each = some.select("digest", F.explode(F.concat(*map(as_mentions, names))).alias("m")).select("digest", "m.*")
    words = F.filter("words", lambda w: w != "")
    last = F.when(F.size(words) > 0, F.element_at(words, -1))
    two = F.when(F.size(words) > 1, F.concat_ws(" ", F.slice(words, -2, 2)))
    return each.withColumn("patterns", F.array_compact(F.array(last, two))).drop("words")


def bootstrap(mentions: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """class, instance, kind, score of the candidates accepted after some iterations over the pattern-instance graph."""
    edges = stored(mentions.select("class", "instance", "kind", F.explode("patterns").alias("pattern")).distinct())
    key = F.concat_ws(":", "class", "instance")
    links = stored(edges.select(F.concat_ws(":", "class", "pattern").alias("pattern"), key.alias("instance")).distinct())
    seeds = stored(mentions.where("kind is not null").select(key.alias("instance"), "kind", F.lit(1.0).alias("score")).distinct())
    held = links.groupBy("pattern").agg(F.count(F.lit(1)).alias("n"))
    scores = seeds
    for _ in range(rounds):
        # One row per instance: its scores by kind.
        told = scores.groupBy("instance").agg(F.map_from_entries(F.collect_list(F.struct("kind", "score"))).alias("by_kind"))
        votes = spread_join(links, told, "instance").select("pattern", F.explode("by_kind").alias("kind", "score"))
        sums = votes.groupBy("pattern", "kind").agg(F.sum("score").alias("sum"), F.count_if(F.col("score") >= ACCEPT).alias("support"))
        sure = sums.where(F.col("support") >= SUPPORT).join(held, "pattern").withColumn("sure", F.col("sum") / (F.col("n") + PRIOR))
        sure = stored(sure.where(F.col("sure") >= SURE).groupBy("pattern").agg(F.map_from_entries(F.collect_list(F.struct("kind", "sure"))).alias("by_kind")))
        new = spread_join(links, sure, "pattern").select("instance", F.explode("by_kind").alias("kind", "sure"))
        doubt = F.exp(F.sum(F.log(F.greatest(1 - F.col("sure"), F.lit(1e-9)))))
        found = new.groupBy("instance", "kind").agg((1 - doubt).alias("score")).where(F.col("score") >= ACCEPT)
        scores = stored(seeds.unionByName(found.join(seeds.select("instance").distinct(), "instance", "left_anti")))
    return scores.join(seeds.select("instance").distinct(), "instance", "left_anti")


def personal_data(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """docs: doc_id, text.  Per row doc_id and per kind an array of (start, end), for the base kinds and those that the method adds.

    Places are in code points, end exclusive, ascending.  Texts are searched whole; a null text counts as empty; a null doc_id stays; rows
    repeat as given, and equal texts have equal spans and count once as evidence.  Candidates overlap no base span; one that fits
    several kinds is listed under each.  An empty table gives an empty result; other columns play no part.  A candidate's cost
    grows with the base spans of its own text.
    """
    rows = stored(find_mentions(docs))
    mentions = stored(_mentions(rows))
    accepted = bootstrap(mentions, rounds)
    key = F.concat_ws(":", "class", "instance").alias("instance")
    others = mentions.where("kind is null").select("digest", key, "start", "end")
    by_value = accepted.groupBy("instance").agg(F.collect_set("kind").alias("kinds"))
    met = spread_join(others, by_value, "instance").select("digest", F.explode("kinds").alias("kind"), F.struct("start", "end").alias("span"))
    place = "array<struct<start:bigint,end:bigint>>"
    lists = [F.coalesce(F.array_sort(F.collect_set(F.when(F.col("kind") == k, F.col("span")))), _none(place)).alias(f"{k}_like") for k in KINDS]
    added = stored(met.groupBy("digest").agg(*lists))
    base = [F.transform(k, lambda h: F.struct(h["start"].alias("start"), h["end"].alias("end"))).alias(k) for k in KINDS]
    open_ = (F.size("mail") + F.size("number")) > 0
    plain = rows.where(~open_).select("doc_id", *base, *[_none(place).alias(k) for k in LIKE])
    joined = spread_join(rows.where(open_).select("doc_id", "digest", *base), added, "digest", "left")
    return plain.unionByName(joined.select("doc_id", *KINDS, *[F.coalesce(k, _none(place)).alias(k) for k in LIKE]))


def listing(kinds: tuple[str, ...]) -> Column:
    """kind:start:end by kind as listed, then start, joined by commas."""
    named = lambda k: F.transform(k, lambda s: F.concat_ws(":", F.lit(k), s["start"], s["end"]))
    return F.array_join(F.concat(*map(named, kinds)), ",")


def op12_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base spans and added spans of every document; nulls, empty and long texts and repeats as in personal_data()."""
    found = personal_data(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(listing(KINDS).cast("binary"), 256).alias("base_sha256"), listing(KINDS + LIKE).alias("spans"))
