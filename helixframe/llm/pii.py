"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base patterns find emails, IP addresses, card and phone numbers. They are the seeds of a graph of lexical contexts
(the words before) and instances (what stands there): contexts are scored by the instances that they hold, instances by
their contexts, in turn; contexts that end with a high score mark further identifiers.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.llm.common import cut, written

#: Kinds in the order of results; "id" are spans that contexts discover.
KINDS = ("email", "ip", "card", "phone", "id")
EMAIL, IP, CARD, PHONE, ID, EVERY = range(6)
#: Base patterns, written so that a failed attempt isn't repeated from each character of the same run.
PATTERNS = (
    r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)
#: What a text must have for a kind's pattern to be tried on it.
NEEDED = (r"@", r"[0-9]\.[0-9]++\.[0-9]", r"[0-9](?:[\x20-]?[0-9]){12}", r"\+[0-9]")
#: A token with a digit, from white space or a bracket, quote or sign of assignment on.
TOKEN = r"(?<![^\s=:\"'(\[<,;])[^\s0-9=:\"'(\[<,;]*+[0-9][^\s\"')\]>,;]*+"
#: Rounds of scoring; least seeds of a context, its least score; smoothing; weight of a context for its instances.
ROUNDS, LEAST_SEEDS, LEAST_SCORE, SMOOTH, DAMP = 3, 3, 0.6, 1.0, 0.9
#: Characters before a token that nearly always hold its context, the two words before it; where they don't, all are searched.
REACH = 80


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def value(i: Column) -> Column:
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).otherwise(d * 2 - F.when(d > 4, 9).otherwise(0))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + value(i)) % 10 == 0


def _valid(kind: int, x: Column) -> Column:
    if kind == IP:
        bare = F.transform(F.split(x, r"\."), lambda p: F.ltrim(p, F.lit("0")))
        return F.forall(bare, lambda p: F.when(F.length(p) <= 3, F.coalesce(p.try_cast("int"), F.lit(0)) <= 255).otherwise(False))
    n = F.length(_digits(x))
    if kind == CARD:
        return F.when(n.between(13, 19), _luhn(_digits(x))).otherwise(False)
    if kind == PHONE:
        return n.between(9, 15)
    return F.lit(True)


def _before(gap: Column) -> Column:
    """The end of a text that holds its last two words, whole."""
    end = F.right(gap, F.lit(REACH))
    return F.when((F.length(gap) <= REACH) | end.rlike(r"\s\S+\s+\S+\s*$"), end).otherwise(F.regexp_extract(gap, r"((?:\S++\s++)?+\S*+\s*+)$", 1))


def _found(kind: int, text: Column, pattern: str, needed: str) -> Column:
    """Array of (kind, k, gap, value, before): the k-th match, the length of the text between it and the one before, and that text's end."""
    matches, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    rows = F.transform(
        F.arrays_zip(matches.alias("m"), F.slice(gaps, 1, F.size(gaps) - 1).alias("g")),
        lambda x: F.struct(F.lit(kind).alias("kind"), F.length(x["g"]).alias("gap"), x["m"].alias("value"), (_before(x["g"]) if kind == EVERY else F.lit(None).cast("string")).alias("before")),
    )
    return F.when(text.rlike(needed), F.transform(rows, lambda x, i: F.struct(x["kind"].alias("kind"), i.alias("k"), x["gap"].alias("gap"), x["value"].alias("value"), x["before"].alias("before"))))


def _contexts(before: Column) -> Column:
    """The last two words before a token, and the last alone if it is a label (ends with : = or #); lower case, of the same line."""
    line = F.regexp_extract(before, r"([^\n]*)$", 1)
    words = F.split(F.trim(F.lower(F.regexp_replace(line, r"[\"'(\[<{\s]+", " "))), " ")
    one, two = F.element_at(words, -1), F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - 1), 2), " ")
    label, pair = one.rlike("[:=#]$"), F.size(words) > 1
    return F.filter(F.array(F.when(label, one), F.when(pair, two)), lambda c: c.isNotNull())


def mentions(docs: DataFrame) -> DataFrame:
    """All base matches that hold and all tokens with a digit, one row each, and one of kind null for every row of docs.

    Columns: rid (a number of the row), doc_id, h (a hash of the text), kind, start, end (code points, end exclusive),
    value, contexts, seed (for tokens: a base span begins in it), free (no base span touches it).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text.alias("text"))
    empty = F.expr("array(named_struct('kind', cast(null as int), 'k', 0, 'gap', 0, 'value', cast(null as string), 'before', cast(null as string)))")
    none = F.expr("cast(array() as array<struct<kind:int,k:int,gap:int,value:string,before:string>>)")
    every = [*((k, p, n) for k, (p, n) in enumerate(zip(PATTERNS, NEEDED))), (EVERY, TOKEN, "[0-9]")]
    found = F.concat(empty, *(F.coalesce(_found(k, F.col("text"), p, n), none) for k, p, n in every))
    long = rows.select("rid", "doc_id", F.xxhash64("text").alias("h"), F.explode(found).alias("f")).select("rid", "doc_id", "h", "f.*")
    end = F.sum(F.col("gap") + F.coalesce(F.length("value"), F.lit(0))).over(W.partitionBy("rid", "kind").orderBy("k"))
    long = long.withColumn("end", end.cast("int")).withColumn("start", (F.col("end") - F.length("value")).cast("int"))
    # tokens lose final punctuation that isn't theirs
    trimmed = F.when(F.col("kind") == EVERY, F.regexp_replace("value", r"[.:!?]+$", "")).otherwise(F.col("value"))
    long = long.withColumn("value", trimmed).withColumn("end", F.col("start") + F.length("value"))
    holds = F.col("kind").isNull() | (F.col("kind") == EVERY)
    for k in (EMAIL, IP, CARD, PHONE):
        holds = F.when(F.col("kind") == k, _valid(k, F.col("value"))).otherwise(holds)
    long = long.where(holds)
    # A token is touched if, of the base spans that begin before its end, the farthest reaches beyond its start.
    base = F.col("kind") < ID
    at = F.when(F.col("kind") == EVERY, F.col("end") - 1).otherwise(F.col("start"))
    before = W.partitionBy("rid").orderBy(at, F.col("kind")).rowsBetween(W.unboundedPreceding, 0)
    reach, begun = F.max(F.when(base, F.col("end"))).over(before), F.max(F.when(base, F.col("start"))).over(before)
    token = F.col("kind") == EVERY
    long = long.withColumn("free", token & ~F.coalesce(reach > F.col("start"), F.lit(False))).withColumn("seed", token & F.coalesce(begun >= F.col("start"), F.lit(False)))
    contexts = F.when(F.col("free") | F.col("seed"), _contexts(F.col("before"))).otherwise(F.lit(None))
    return long.select("rid", "doc_id", "h", "kind", "start", "end", "value", contexts.alias("contexts"), "seed", "free")


def score_contexts(found: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(context, score, seeds) of the accepted contexts of mentions(): scored with their instances in turn.

    A context's score is the sum of its distinct instances' scores over their number and SMOOTH; an instance's is 1 for
    a seed, else the noisy-or of its contexts'. Sums are combined map-side; a context with a third of all tokens is
    a sum over many tasks and a join that adaptive execution splits.
    """
    edges = found.where("(seed or free) and size(contexts) > 0").select(F.explode("contexts").alias("context"), F.lower("value").alias("instance"), "seed")
    edges, _ = written(edges.groupBy("context", "instance").agg(F.max("seed").alias("seed")))
    seeds = edges.groupBy("instance").agg(F.max(F.col("seed").cast("double")).alias("base"))
    instances = seeds.select("instance", F.col("base").alias("score"))
    contexts = None
    for k in range(rounds):
        instances, _ = written(instances)  # so the join has plain exchanges on both sides, or none where they are small
        contexts = edges.join(instances, "instance").groupBy("context").agg(F.sum(F.round("score", 9).cast("decimal(28,9)")).cast("double").alias("held"), F.count("*").alias("n"), F.sum(F.col("seed").cast("int")).alias("seeds"))
        contexts = contexts.select("context", (F.col("held") / (F.col("n") + SMOOTH)).alias("score"), "seeds").where(F.col("seeds") >= LEAST_SEEDS)
        if k < rounds - 1:
            missed = F.sum(F.round(F.log(1 - DAMP * F.col("s")), 9).cast("decimal(28,9)")).cast("double")
            scored = edges.join(contexts.select("context", F.col("score").alias("s")), "context").groupBy("instance").agg((1 - F.exp(missed)).alias("near"))
            instances = seeds.join(scored, "instance", "left").select("instance", F.greatest("base", F.coalesce("near", F.lit(0.0))).alias("score"))
    return contexts.where(F.col("score") >= LEAST_SCORE)


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text) to one row per row of docs: rid, doc_id, h, spans array<struct<kind, start, end>> sorted by kind and start.

    kind is an index of KINDS. Null and empty texts have no spans; repeated rows come back as often; other columns
    aren't read; an empty table gives an empty result.
    """
    found = cut(mentions(docs))
    tokens = found.where("free and size(contexts) > 0").where((F.length("value") >= 6) & (F.length(_digits(F.col("value"))) >= 2))
    hits = tokens.select("rid", "doc_id", "h", "start", "end", F.explode("contexts").alias("context")).join(score_contexts(found).select("context"), "context")
    discovered = hits.select("rid", "doc_id", "h", F.lit(ID).alias("kind"), "start", "end").distinct()
    base = found.where(f"kind is null or kind < {ID}").select("rid", "doc_id", "h", "kind", "start", "end")
    one = F.when(F.col("kind").isNotNull(), F.struct("kind", "start", "end"))
    return base.union(discovered).groupBy("rid", "doc_id", "h").agg(F.array_sort(F.collect_list(one)).alias("spans"))


def _joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame) -> DataFrame:
    """Per row of docs: counts of the base kinds, a digest of the base spans, all spans, and how many the contexts added."""
    s = F.col("spans")

    def count(k: int) -> Column:
        return F.size(F.filter(s, lambda x: x["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")

    counts = [count(k) for k in range(5)]
    return spans(docs).select("doc_id", *counts[:4], F.sha2(_joined(F.filter(s, lambda x: x["kind"] < ID)), 256).alias("base_sha256"), _joined(s).alias("spans"), counts[4])


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span of its text replaced by its kind in brackets; all columns and rows stay.

    Where spans overlap, one placeholder stands for their union, with the kind of the first. Rows are matched by
    doc_id, null included, and a hash of the text; rows alike in both have the same spans. n_chars, where there is
    such a column, is counted anew.
    """
    own = lambda name: f"__{name}_{uuid.uuid4().hex}"  # noqa: E731  no column of docs has it
    at, hashed, where = own("id"), own("hash"), own("spans")
    ordered = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("a"), s["end"].alias("b"), s["kind"].alias("k"))))
    found = spans(docs).where("size(spans) > 0").select(F.col("doc_id").alias(at), F.col("h").alias(f"{hashed}_of"), ordered.alias(where)).dropDuplicates([at, f"{hashed}_of"])
    first = F.array().cast("array<struct<a:int,b:int,k:int>>")

    def merged(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["a"].alias("a"), F.greatest(last["b"], s["b"]).alias("b"), last["k"].alias("k"))))
        return F.when((F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["b"] > s["a"]), joined).otherwise(F.concat(out, F.array(s)))

    overlaps = F.exists(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(where))), lambda i: F.coalesce(F.try_element_at(where, i)["a"] < F.try_element_at(where, i - 1)["b"], F.lit(False)))
    found = found.withColumn(where, F.when(overlaps, F.aggregate(where, first, merged)).otherwise(F.col(where)))
    names = F.array(*map(F.lit, KINDS))
    text, s = F.col("text"), F.col(where)
    pieces = F.transform(s, lambda x, i: F.concat(F.substring(text, F.coalesce(F.get(s, i - 1)["b"], F.lit(0)) + 1, x["a"] - F.coalesce(F.get(s, i - 1)["b"], F.lit(0))), F.lit("["), F.upper(F.element_at(names, x["k"] + 1)), F.lit("]")))
    clean = F.when(s.isNull(), text).otherwise(F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(s, -1)["b"] + 1, F.length(text))))
    keyed = docs.withColumn(hashed, F.xxhash64(F.coalesce("text", F.lit(""))))
    joined = keyed.join(found, F.col("doc_id").eqNullSafe(F.col(at)) & (F.col(hashed) == F.col(f"{hashed}_of")), "left").withColumn("text", clean)
    if "n_chars" in docs.columns:
        joined = joined.withColumn("n_chars", F.when(s.isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns))
