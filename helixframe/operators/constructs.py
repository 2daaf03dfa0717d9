"""The second pass over reads: candidate junctions, their sequences, and which alignments to these are evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.functions.sequence import reverse_complement
from helixframe.operators import junctions, segments
from helixframe.operators.emission import TERMINUS_REACH, TERMINUS_SLACK, continues_clip, with_repeat

#: Least read bases that an alignment to a construct covers, least bases on each side, least matched bases of a piece.
LEAST_COVER, LEAST_SIDE, LEAST_PIECE = 28, 3, 5
KEY = ["seq_id1", "pos1", "minus1", "seq_id2", "pos2", "minus2", "overlap"]


def operations(cigar: Column, kinds: str) -> Column:
    """Total length of a CIGAR's operations of some kinds."""
    found = F.regexp_extract_all(cigar, F.lit(rf"(\d+)[{kinds}]"), F.lit(1))
    return F.aggregate(found, F.lit(0), lambda a, x: a + x.cast("int"))


def alignment_score(cigar: Column) -> Column:
    """Matched bases less inserted and deleted ones."""
    return operations(cigar, "M=X") - operations(cigar, "ID")


def spans_breakpoint(start: Column, end: Column, breakpoint: Column, least: int = LEAST_SIDE) -> Column:
    """Whether [start, end), 0-based on a construct, has the least number of bases on each side of the breakpoint."""
    return (end > start) & (breakpoint - start >= least) & (end - breakpoint >= least)


def flank(seq: Column, pos: Column, minus: Column, length: int, entering: bool) -> Column:
    """Reference bases beside a side's 1-based position, in the direction of the read that crosses the junction.

    A side on minus has its bases up to pos, else from pos on. Entering (the first side) they end at pos, leaving
    they begin there; where that is against the reference, they are its reverse complement. Clipped at contig ends;
    empty outside.
    """
    below = F.substring(seq, F.greatest(F.lit(1), pos - length + 1).cast("int"), F.least(pos, F.lit(length)).cast("int"))
    above = F.substring(seq, pos.cast("int"), F.lit(length))
    bases = F.upper(F.when(minus, below).otherwise(above))
    turned = ~minus if entering else minus
    inside = pos.between(1, F.length(seq))
    return F.when(inside, F.when(turned, reverse_complement(bases)).otherwise(bases)).otherwise("")


def canonical_candidates(rows: DataFrame) -> DataFrame:
    """Junctions with the side of the smaller (seq_id, pos) first; the strands flip where the sides change places."""
    swap = F.struct("seq_id1", "pos1") > F.struct("seq_id2", "pos2")
    pick = lambda a, b: F.when(swap, b).otherwise(a)
    new = {"seq_id1": pick(F.col("seq_id1"), F.col("seq_id2")), "pos1": pick(F.col("pos1"), F.col("pos2")), "minus1": pick(F.col("minus1"), ~F.col("minus2")), "seq_id2": pick(F.col("seq_id2"), F.col("seq_id1")), "pos2": pick(F.col("pos2"), F.col("pos1")), "minus2": pick(F.col("minus2"), ~F.col("minus1"))}
    return rows.withColumns(new)


def endpoint(start: Column, span: Column, reverse: Column, first: bool) -> Column:
    """(pos, minus) where a piece of a read, aligned from 1-based start over span bases, meets the next or the one before."""
    low = F.struct(start.alias("pos"), F.lit(False).alias("minus"))
    high = F.struct((start + span - 1).alias("pos"), F.lit(True).alias("minus"))
    return F.when(reverse if first else ~reverse, low).otherwise(high)


def split_pieces(sam: DataFrame) -> DataFrame:
    """SAM rows (qname, flag, rname, pos, cigar) to pieces (qname, seq_id, start, span, reverse, read_start, read_end).

    Read coordinates are in the read's own direction, so a reverse alignment's clips change ends. Unmapped rows and
    pieces with under LEAST_PIECE matched bases are left out.
    """
    lead = F.coalesce(F.regexp_extract("cigar", r"^(\d+)[SH]", 1).try_cast("int"), F.lit(0))
    trail = F.coalesce(F.regexp_extract("cigar", r"(\d+)[SH]$", 1).try_cast("int"), F.lit(0))
    reverse = F.col("flag").bitwiseAND(16) > 0
    begin = F.when(reverse, trail).otherwise(lead)
    rows = sam.where(F.col("flag").bitwiseAND(4) == 0).where(operations(F.col("cigar"), "M=X") >= LEAST_PIECE)
    return rows.select("qname", F.col("rname").alias("seq_id"), F.col("pos").alias("start"), operations(F.col("cigar"), "MDN=X").alias("span"), reverse.alias("reverse"), begin.alias("read_start"), (begin + operations(F.col("cigar"), "MI=X")).alias("read_end"))


def merged_candidates(rows: DataFrame) -> DataFrame:
    """Candidates (KEY, seed_reads) canonical and once each, with the sum of their seeds."""
    return canonical_candidates(rows).groupBy(*KEY).agg(F.sum("seed_reads").alias("seed_reads"))


def constructs(candidates: DataFrame, contigs: DataFrame, length: int) -> DataFrame:
    """Candidates with left and right flanks of at most `length` bases, sequence, and breakpoint, the length of left.

    The overlap's bases are taken from the right flank. Contigs are joined by seq_id, each side once.
    """
    one = contigs.select(F.col("seq_id").alias("seq_id1"), F.col("seq").alias("_s1"))
    two = contigs.select(F.col("seq_id").alias("seq_id2"), F.col("seq").alias("_s2"))
    rows = candidates.join(one, "seq_id1").join(two, "seq_id2")
    left = flank(F.col("_s1"), F.col("pos1"), F.col("minus1"), length, True)
    right = flank(F.col("_s2"), F.col("pos2"), F.col("minus2"), length, False)
    right = F.substring(right, (F.greatest(F.col("overlap"), F.lit(0)) + 1).cast("int"), F.lit(2**31 - 1))
    rows = rows.select(*candidates.columns, left.alias("left"), right.alias("right"))
    return rows.withColumns({"sequence": F.concat("left", "right"), "breakpoint": F.length("left")})


def distinct_constructs(built: DataFrame) -> DataFrame:
    """One candidate of those with the same sequence in either direction: most seeds, then the first by KEY; seeds summed."""
    same = F.least(F.col("sequence"), reverse_complement(F.col("sequence")))
    best = F.min_by(F.struct(*built.columns), F.struct(-F.col("seed_reads"), *KEY))
    groups = built.groupBy(same.alias("_same")).agg(best.alias("_best"), F.sum("seed_reads").alias("_seeds"))
    return groups.select("_best.*", "_seeds").withColumn("seed_reads", F.col("_seeds")).drop("_seeds")


def register_chains(rows: DataFrame, by: list[str], pos: str, tolerance: int = TERMINUS_SLACK) -> DataFrame:
    """Adds chain, a number in the group: rows in order of position, a new chain where the one before is farther away."""
    gaps = segments.previous(rows, by, pos, {"_before": F.col(pos)})
    begins = F.coalesce(F.col(pos) - F.col("_before") > tolerance, F.lit(True))
    return segments.running(gaps, by, pos, {"chain": ("sum", begins.cast("int"))}, ties=True).drop("_before")


def slid(rows: DataFrame, repeats: DataFrame, ident: str = "id") -> DataFrame:
    """Junctions (id, KEY) with the overlap's bases given to one side, and sides near a copy's end set on it.

    An overlap of up to four bases moves a side along its own direction: the one that isn't at a copy's end if the other
    is; else the first if it is on minus, the second if that is on plus, or again the first. A longer overlap moves the
    side at a copy's end only, and only if it lands there. Then it is 0; else it stays. At last, sides within
    TERMINUS_SLACK of a copy's end are set on it.
    """
    rows = with_repeat(with_repeat(rows, repeats, ident, "seq_id1", "pos1", "_r1", TERMINUS_REACH), repeats, ident, "seq_id2", "pos2", "_r2", TERMINUS_REACH)
    k, none1, none2 = F.col("overlap"), F.col("_r1").isNull(), F.col("_r2").isNull()
    moved = lambda s: F.when(F.col(f"minus{s}"), F.greatest(F.lit(0), F.col(f"pos{s}") - k)).otherwise(F.col(f"pos{s}") + k)
    one_at_end = none1 != none2
    first = F.when(one_at_end, none1).otherwise(F.col("minus1") | F.col("minus2"))
    small, large = k.between(1, 4), k > 4
    end = lambda p, r: F.when(F.abs(p - r["start"]) <= F.abs(p - r["end"]), r["start"]).otherwise(r["end"])
    lands = lambda s: F.coalesce(F.abs(moved(s) - end(moved(s), F.col(f"_r{s}"))) <= TERMINUS_SLACK, F.lit(False))
    take1, take2 = large & one_at_end & ~none1 & lands("1"), large & one_at_end & ~none2 & lands("2")
    new = {
        "pos1": F.when(small & first, moved("1")).when(take1, end(moved("1"), F.col("_r1"))).otherwise(F.col("pos1")),
        "pos2": F.when(small & ~first, moved("2")).when(take2, end(moved("2"), F.col("_r2"))).otherwise(F.col("pos2")),
        "overlap": F.when(small | take1 | take2, 0).otherwise(k),
    }
    rows = rows.withColumns(new).drop("_r1", "_r2")
    rows = with_repeat(with_repeat(rows, repeats, ident, "seq_id1", "pos1", "_r1", TERMINUS_REACH), repeats, ident, "seq_id2", "pos2", "_r2", TERMINUS_REACH)
    at_end = lambda s: end(F.col(f"pos{s}"), F.col(f"_r{s}"))
    return rows.withColumns({f"pos{s}": F.when(F.abs(F.col(f"pos{s}") - at_end(s)) <= TERMINUS_SLACK, at_end(s)).otherwise(F.col(f"pos{s}")) for s in "12"}).drop("_r1", "_r2")


def primary_scores(sam: DataFrame) -> DataFrame:
    """(name, mate, primary): the best score of each mate's primary alignments."""
    flagged = junctions.flagged_reads(sam).where(F.col("flag").bitwiseAND(0x100 | 0x4) == 0)
    return flagged.groupBy("name", "mate").agg(F.max(alignment_score(F.col("cigar"))).alias("primary"))


def judged_alignments(sam: DataFrame, built: DataFrame, primary: DataFrame) -> DataFrame:
    """Alignments of reads to constructs (contig jc<number>) with reject: why they are no evidence, or null.

    built has number, breakpoint and both_repeats. Reasons, in this order: short_cover, not_spanning,
    worse_than_primary (the reference explains the mate as well, or better if both sides are repeats) and
    worse_than_competing (another construct does; ties stay). A mate's primary score is that of its own code, else of
    the read without one. Rows of other contigs and unmapped ones are left out.
    """
    rows = junctions.flagged_reads(sam).where(F.col("flag").bitwiseAND(4) == 0)
    rows = rows.withColumn("number", F.regexp_extract("rname", r"^jc(\d+)$", 1).try_cast("long")).join(built.select("number", "breakpoint", "both_repeats"), "number")
    single = primary.where("mate = 0").select("name", F.col("primary").alias("_single"))
    rows = rows.join(primary, ["name", "mate"], "left").join(single, "name", "left").withColumn("primary", F.coalesce("primary", "_single")).drop("_single")
    begin = F.col("pos") - 1
    end = begin + operations(F.col("cigar"), "MDN=X")
    score = alignment_score(F.col("cigar"))
    worse = (score < F.col("primary")) | (score == F.col("primary")) & ~F.col("both_repeats")
    reject = F.when(operations(F.col("cigar"), "MI=X") < LEAST_COVER, "short_cover").when(~spans_breakpoint(begin, end, F.col("breakpoint")), "not_spanning").when(F.coalesce(worse, F.lit(False)), "worse_than_primary")
    rival = F.coalesce(F.col("as_score"), score - F.col("nm"), score) if {"as_score", "nm"} <= set(sam.columns) else score
    rows = rows.withColumns({"reject": reject, "score": rival, "left_bases": F.col("breakpoint") - begin, "right_bases": end - F.col("breakpoint")})
    best = F.max(F.when(F.col("reject").isNull(), F.col("score"))).over(W.partitionBy("name", "mate"))
    return rows.withColumn("reject", F.coalesce("reject", F.when(F.col("score") < best, "worse_than_competing")))


def second_pass(pieces: DataFrame, contigs: DataFrame, length: int, budget: int) -> DataFrame:
    """Pieces of reads, paired as candidates (KEY, seed_reads), to the numbered constructs that reads are aligned to again; budget is their length in all."""
    sized = merged_candidates(pieces).withColumn("_length", 2 * length - F.greatest("overlap", F.lit(0)))
    ranked = junctions.rank_and_cap_all(sized, "seed_reads", "_length", KEY, budget)
    built = distinct_constructs(constructs(ranked.drop("_length", "total"), contigs, length))
    return built.withColumn("number", F.col("rank").cast("long")).drop("rank")


def clip_candidates(clips: DataFrame, contigs: DataFrame, least: int = 12, concrete: int = 20) -> tuple[DataFrame, DataFrame]:
    """Clipped ends of reads (id, seq_id, pos, left, bases) placed exactly in the contigs: (candidates, repeats).

    pos is the 1-based aligned base beside the clip, left whether the clip comes before it. Equal clips are searched
    once, on both strands, from `least` bases on. candidates has id and KEY for each place of a clip with at most
    `concrete` places that doesn't just go on where its read was aligned; repeats (id, places) has the clips with more,
    none of whose places is told from the others.
    """
    from helixframe.operators.sites import kmer_placements

    long = clips.where(F.length("bases") >= least).withColumn("query", F.upper("bases"))
    placed = kmer_placements(long.select("query").distinct(), contigs, least)
    places = placed.groupBy("query").agg(F.count("*").alias("places"))
    few = placed.join(places.where(F.col("places") <= concrete), "query").select("query", F.col("seq_id").alias("_c"), "start", F.col("minus").alias("_rc"))
    size = F.length("query")
    rows = long.join(few, "query").withColumns({"_low": F.col("start"), "_high": F.col("start") + size - 1})
    goes_on = ~F.col("_rc") & (F.col("_c") == F.col("seq_id")) & continues_clip(F.col("left"), F.col("pos"), F.col("start") - 1, size)
    rows = rows.where(~goes_on)
    # a clip after the read is left towards its own start, one before the read is entered from its own end
    far = F.when(F.col("left") == F.col("_rc"), F.col("_low")).otherwise(F.col("_high"))
    clip = F.struct(F.col("_c").alias("c"), far.alias("p"), F.when(F.col("left"), ~F.col("_rc")).otherwise(F.col("_rc")).alias("m"))
    own = F.struct(F.col("seq_id").alias("c"), F.col("pos").alias("p"), (~F.col("left")).alias("m"))
    one, two = F.when(F.col("left"), clip).otherwise(own), F.when(F.col("left"), own).otherwise(clip)
    sides = {f"{n}{k}": s[c] for k, s in ((1, one), (2, two)) for n, c in (("seq_id", "c"), ("pos", "p"), ("minus", "m"))}
    out = rows.select("id", *(v.alias(k) for k, v in sides.items()), F.lit(0).alias("overlap")).select("id", *KEY)
    return out, long.join(places.where(F.col("places") > concrete), "query").select("id", "places")
