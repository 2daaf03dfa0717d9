"""Low-frequency alleles: counts by read, error model, differences between samples, classes and flags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import statistics

#: Classes that are reported, in order of priority; the others are subtracted or nothing.
REPORTED = ("EDITED_SPECIFIC", "EDITED_ENRICHED", "INDETERMINATE_STARTER_DEPTH", "AMBIGUOUS_STARTER_TRACE")


@dataclass(frozen=True)
class Limits:
    """Thresholds of detection and difference."""

    min_depth: int = 20
    min_alt: int = 3
    min_af: float = 0.05
    max_af: float = 0.7499
    min_delta: float = 0.05
    fdr: float = 0.01
    strand_p: float = 0.001
    snp_error: float = 0.005
    indel_error: float = 0.010


def allele_counts(obs: DataFrame, by: list[str], read: str, allele: Column, reference: Column, minus: Column) -> DataFrame:
    """Reads of each kind and strand for each position: (by, ref_fwd, ref_rev, alt_fwd, alt_rev, other_fwd, other_rev).

    A read counts once: as alt if any of its observations is, else as ref if any is.
    """
    once = obs.groupBy(*by, read).agg(F.bool_or(allele).alias("a"), F.bool_or(reference).alias("r"), F.bool_or(minus).alias("m"))
    kind = F.when(F.col("a"), "alt").when(F.col("r"), "ref").otherwise("other")
    return once.groupBy(*by).agg(*(F.count_if((kind == k) & (F.col("m") == (s == "rev"))).alias(f"{k}_{s}") for k in ("ref", "alt", "other") for s in ("fwd", "rev")))


def evaluate(pairs: DataFrame, limits: Limits = Limits(), error: Column | None = None) -> DataFrame:
    """Candidates with counts of both samples to their statistics, class and flags.

    pairs has, with suffixes _s (starter) and _e (edited), the columns of allele_counts; q-values are adjusted over all
    its rows. Adds af, ci, error and difference p and q, delta with its interval, class, flags, strand p.
    """
    rate = F.lit(limits.snp_error) if error is None else error
    n = lambda k, s: (F.col(f"{k}_fwd_{s}") + F.col(f"{k}_rev_{s}")).cast("long")
    rows = pairs
    for s in "se":
        depth, alt = n("ref", s) + n("alt", s) + n("other", s), n("alt", s)
        rows = rows.withColumns({f"depth_{s}": depth, f"alt_{s}": alt, f"af_{s}": F.coalesce(F.try_divide(alt.cast("double"), depth.cast("double")), F.lit(0.0)), f"ci_{s}": F.coalesce(statistics.wilson(alt, depth), F.struct(F.lit(0.0).alias("low"), F.lit(0.0).alias("high"))), f"p_error_{s}": F.coalesce(statistics.binomial_tail(alt, depth, rate), F.lit(1.0))})
    rows = rows.withColumn("p_diff", statistics.fisher_exact(F.col("alt_e"), F.col("depth_e") - F.col("alt_e"), F.col("alt_s"), F.col("depth_s") - F.col("alt_s")))
    rows = rows.withColumn("p_strand", statistics.fisher_exact(*(F.col(f"{k}_{d}_e") for k in ("ref", "alt") for d in ("fwd", "rev"))))
    for p, q in (("p_error_s", "q_error_s"), ("p_error_e", "q_error_e"), ("p_diff", "q_diff")):
        rows = statistics.benjamini_hochberg(rows, p, q)
    rows = rows.withColumn("change", statistics.newcombe(F.col("af_e"), F.col("ci_e"), F.col("af_s"), F.col("ci_s")))
    return rows.withColumn("class", allele_class(limits)).withColumn("flags", flags(limits))


def allele_class(limits: Limits = Limits()) -> Column:
    """The class of a row of evaluate(), the first rule that holds."""
    seen = lambda s: (F.col(f"depth_{s}") >= limits.min_depth) & (F.col(f"alt_{s}") >= limits.min_alt) & (F.col(f"af_{s}") >= limits.min_af) & (F.col(f"q_error_{s}") <= limits.fdr)
    in_s, in_e = seen("s"), seen("e") & (F.col("af_e") <= limits.max_af)
    differs, delta = F.col("q_diff") <= limits.fdr, F.col("change.delta")
    more = differs & (delta >= limits.min_delta) & (F.col("change.low") > 0)
    return (
        F.when(in_e & (F.col("depth_s") < limits.min_depth), "INDETERMINATE_STARTER_DEPTH")
        .when(in_e & ~in_s & more, "EDITED_SPECIFIC")
        .when(in_s & in_e & more, "EDITED_ENRICHED")
        .when(in_s & (~in_e | ~differs | (delta < limits.min_delta)), F.when(differs & (delta <= -limits.min_delta), "DEPLETED_IN_EDITED").otherwise("PRE_EXISTING_IN_STARTER"))
        .when(in_e & ~in_s & (F.col("alt_s") >= 1), "AMBIGUOUS_STARTER_TRACE")
        .otherwise("NOT_SUBCLONAL")
    )


def flags(limits: Limits = Limits()) -> Column:
    """Sorted quality flags of a row of evaluate()."""
    one_sided = (F.col("alt_e") >= 8) & ((F.col("alt_fwd_e") == 0) | (F.col("alt_rev_e") == 0))
    other = (F.col("other_fwd_e") + F.col("other_rev_e")).cast("double")
    rules = {
        "HIGH_OTHER_FRACTION": F.try_divide(other, F.col("depth_e").cast("double")) > 0.10,
        "LOW_DEPTH": F.col("depth_e") < limits.min_depth,
        "NEAR_CONSENSUS": (F.col("af_e") >= 0.70) & (F.col("af_e") < 0.75),
        "SINGLE_STRAND_ALT": one_sided,
        "STRAND_BIAS": F.col("p_strand") < limits.strand_p,
    }
    return F.array_compact(F.array(*(F.when(rule, name) for name, rule in rules.items())))


def reportable(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("class").isin(*REPORTED))


def authorised(kind: Column, ref: Column, alt: Column) -> Column:
    """Whether a change is of a kind that is judged at low frequency: a base for a base, or one or two bases exchanged, added or lost."""
    r, a, k = F.length(ref), F.length(alt), F.upper(kind)
    return F.when(k == "SNP", (r == 1) & (a == 1) & (ref != alt)).when(k == "SUB", r.between(1, 2) & (r == a) & (ref != alt)).when(k == "INS", a.between(1, 2)).when(k == "DEL", r.between(1, 2)).otherwise(False)


def candidates(seen: DataFrame, starter: str, edited: str, limits: Limits = Limits(), consensus: float = 0.75) -> DataFrame:
    """Alleles of observations (pileup.OBSERVATION) that either sample has in enough reads below consensus: counts of both.

    One row a read and position comes first, so a read counts once: its base, the bases inserted after it, and the
    deletions that begin there. An allele's reference reads show the reference base (and for insertions, none); the rest
    of the position's reads are other. Returns contig, pos, kind, allele and allele_counts' columns with _s and _e.
    """
    by = ["sample", "contig", "pos"]
    what, bases = F.col("what"), F.upper("bases")
    reads = seen.where(what.isin("base", "ins", "del")).groupBy(*by, "read_id", "minus").agg(
        F.max(F.when(what == "base", bases)).alias("base"), F.max(F.upper("ref")).alias("ref"),
        F.collect_set(F.when((what == "ins") & F.length("bases").between(1, 2), bases)).alias("ins"), F.bool_or(what == "ins").alias("any_ins"), F.collect_set(F.when((what == "del") & F.col("size").between(1, 2), F.col("size"))).alias("gone"),
    )
    one = lambda k, x: F.struct(F.lit(k).alias("kind"), x.cast("string").alias("allele"))
    snp = F.when(F.col("base").isin(*"ACGT") & (F.col("base") != F.col("ref")), F.array(one("SNP", F.col("base")))).otherwise(F.array().cast("array<struct<kind:string,allele:string>>"))
    own = reads.select(*by, "minus", F.explode(F.concat(snp, F.transform("ins", lambda x: one("INS", x)), F.transform("gone", lambda x: one("DEL", x)))).alias("a")).select(*by, "minus", "a.*")
    strands = {"fwd": ~F.col("minus"), "rev": F.col("minus")}
    alts = own.groupBy(*by, "kind", "allele").agg(*(F.count_if(s).alias(f"alt_{n}") for n, s in strands.items()))
    same = F.coalesce(F.col("base") == F.col("ref"), F.lit(False))
    whole = reads.groupBy(*by).agg(*(F.count_if(s & same & c).alias(f"{k}_{n}") for n, s in strands.items() for k, c in (("ref", F.lit(True)), ("bare", ~F.col("any_ins")))), *(F.count_if(s).alias(f"all_{n}") for n, s in strands.items()))
    rows = alts.join(whole, by)
    depth, alt = F.col("all_fwd") + F.col("all_rev"), F.col("alt_fwd") + F.col("alt_rev")
    share = alt.cast("double") / depth.cast("double")
    keys = rows.where((alt >= limits.min_alt) & (share >= limits.min_af) & (share < consensus) & F.col("sample").isin(starter, edited)).select("contig", "pos", "kind", "allele").distinct()
    out = keys
    for s, name in (("s", starter), ("e", edited)):
        there, count = whole.where(F.col("sample") == name).drop("sample"), alts.where(F.col("sample") == name).drop("sample")
        side = out.join(there, ["contig", "pos"], "left").join(count, ["contig", "pos", "kind", "allele"], "left")
        n = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
        ref = lambda d: F.when(F.col("kind") == "INS", n(f"bare_{d}")).otherwise(n(f"ref_{d}"))
        made = {f"{k}_{d}_{s}": v for d in ("fwd", "rev") for k, v in (("ref", ref(d)), ("alt", n(f"alt_{d}")), ("other", F.greatest(F.lit(0).cast("long"), n(f"all_{d}") - ref(d) - n(f"alt_{d}"))))}
        out = side.select(*out.columns, *(v.alias(k) for k, v in made.items()))
    return out
