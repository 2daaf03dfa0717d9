"""Junctions into repeats whose copy stays open: seeds from reads with many pieces, resolution by each other, families and their states.

A seed is one read's view of a junction: an anchor (a side of it) and the copies of a repeat where the other side may
lie. Bounds are counted before anything is multiplied: what is beyond one becomes a row in state RESOURCE_LIMIT, and its
family with it, instead of being cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.operators.constructs import KEY, canonical_candidates, endpoint
from helixframe.operators.emission import TERMINUS_REACH, repeats_near
from helixframe.operators.junctions import accepted, is_mosaic, support_columns
from helixframe.plans.session import kept

#: Pieces of a read that are paired one by one, pairs of families of a read, copies of a seed, entries of
#: the index of copies, and candidates that one seed may meet there.
PAIRED_PIECES, GEOMETRIES, PLACEMENTS, INDEX_ENTRIES, CANDIDATES = 20, 5_000, 4_096, 200_000, 5_000
#: States of a family, and reasons in its record.
STATES = ("CANDIDATE", "SUPPORTED_AMBIGUOUS", "RESOLVED", "RESOURCE_LIMIT")
TRIVIAL, BOTH_SIDES = "TRIVIAL_CONTINUATION_ONLY", "BOTH_SIDES_MULTICOPY"
LIMITS = {"geometry": "RESOURCE_LIMIT_STAGE2_FAMILY_GEOMETRY", "family": "RESOURCE_LIMIT_INCOMPLETE_FAMILY", "index": "RESOURCE_LIMIT_RECIPROCAL_INDEX", "candidates": "RESOURCE_LIMIT_RECIPROCAL_CANDIDATES"}
#: Columns of a seed. anchor and the copies are struct<seq_id, pos, minus>; observed has all places, eligible those that
#: may be the copy; complete says that no place is missing; limit names the bound that was met, else null.
SEED = ("id", "source", "anchor", "observed", "eligible", "placement_count", "family", "complete", "overlap", "molecule", "molecule_minus", "clip_length", "aligned_length", "mapq", "score", "geometry", "anchored", "rejection", "limit")
_PLACE = "struct<seq_id:string,pos:long,minus:boolean>"
_READ = ["qname", "mate"]
_SHAPE = ["read_start", "read_end", "read_len", "span", "reverse"]


def _place(seq_id: Column, pos: Column, minus: Column) -> Column:
    return F.struct(seq_id.alias("seq_id"), pos.cast("long").alias("pos"), minus.alias("minus"))


def piece_families(pieces: DataFrame, most: int = PAIRED_PIECES) -> DataFrame:
    """Pieces of reads with more than `most` of them (qname, mate, seq_id, start, span, reverse, read_start, read_end, read_len), by shape.

    Pieces with the same part of the read, span and direction are one family: (qname, mate, shape, copies, n, rank,
    families), copies sorted by place, rank in the order of shapes, families the number of the read.
    """
    shapes = pieces.groupBy(*_READ, *_SHAPE).agg(F.array_sort(F.collect_list(F.struct("seq_id", "start"))).alias("copies"), F.count("*").alias("n"))
    of_read = W.partitionBy(*_READ)
    counted = shapes.withColumns({"_pieces": F.sum("n").over(of_read), "families": F.count("*").over(of_read)}).where(F.col("_pieces") > most)
    return counted.withColumn("rank", F.row_number().over(of_read.orderBy(*_SHAPE))).drop("_pieces")


def _continues(a: Column, a_copy: Column, b: Column, b_copy: Column) -> Column:
    """Whether a copy of b only goes on where a copy of a ends."""
    return (a_copy["seq_id"] == b_copy["seq_id"]) & ~a["reverse"] & ~b["reverse"] & (a_copy["start"] + a["span"] == b_copy["start"]) & (a["read_end"] == b["read_start"])


def family_seeds(pieces: DataFrame, repeats: DataFrame, contigs: DataFrame, most: int = PAIRED_PIECES, geometries: int = GEOMETRIES) -> tuple[DataFrame, DataFrame]:
    """(seeds, candidates) of reads with more than `most` pieces, by pairs of their families.

    Two families that make a junction give a seed: with one copy on one side, anchored there, without copies that only
    go on where it ends; with several on both sides, a seed without an anchor. A read with more than `geometries` pairs
    of families gives one seed at its limit, and none is made of a part of them. candidates (id, KEY, seed_reads) has,
    for anchors outside all repeats, the eligible copy on their contig at a repeat's end that is nearest on the circle,
    ties by position.
    """
    families = piece_families(pieces, most)
    pairs_of = F.col("families") * (F.col("families") - 1) / 2
    over = families.where((pairs_of > geometries) & (F.col("rank") == 1))
    some = families.where(pairs_of <= geometries)
    side = lambda n: F.struct(*_SHAPE, "copies", "n", "rank").alias(n)
    pairs = some.select(*_READ, side("a")).join(some.select(*_READ, side("b")), _READ).where("a.rank < b.rank")
    a, b = F.col("a"), F.col("b")
    pairs = pairs.where(is_mosaic(F.greatest(a["read_len"], b["read_len"]), a["read_start"], a["read_end"], b["read_start"], b["read_end"])).where("a.n > 1 or b.n > 1")

    def places(s: Column, first: bool, keep=lambda c: F.lit(True)) -> Column:
        def of(c):
            end = endpoint(c["start"], s["span"], s["reverse"], first)
            return _place(c["seq_id"], end["pos"], end["minus"])

        return F.transform(F.filter(s["copies"], keep), of)

    one_a, one_b = F.col("a.n") == 1, F.col("b.n") == 1
    anchor = F.when(one_a, F.get(places(a, True), F.lit(0))).when(one_b, F.get(places(b, False), F.lit(0))).otherwise(_place(F.lit(None).cast("string"), F.lit(0), F.lit(False)))
    onwards = places(b, False, lambda c: ~_continues(a, F.get(a["copies"], F.lit(0)), b, c))
    backwards = places(a, True, lambda c: ~_continues(a, c, b, F.get(b["copies"], F.lit(0))))
    none = F.array().cast(f"array<{_PLACE}>")
    eligible = F.when(one_a, onwards).when(one_b, backwards).otherwise(none)
    observed = F.when(one_a, places(b, False)).when(one_b, places(a, True)).otherwise(F.array_sort(F.array_distinct(F.concat(places(a, True), places(b, False)))))
    told = lambda s: F.concat_ws(":", *(s[c].cast("string") for c in _SHAPE), F.array_join(F.transform(s["copies"], lambda c: F.concat_ws(":", c["seq_id"], c["start"].cast("string"))), ":"))
    family = F.when(one_a, F.concat(F.lit("STAGE2:"), told(b))).when(one_b, F.concat(F.lit("STAGE2:"), told(a))).otherwise(F.concat(F.lit("BOTH_SIDES:"), F.least(told(a), told(b)), F.lit("|"), F.greatest(told(a), told(b))))
    count = F.when(one_a, F.col("b.n")).when(one_b, F.col("a.n")).otherwise(F.col("a.n") + F.col("b.n"))
    molecule = F.xxhash64("qname", "mate")
    made = pairs.select(*_READ, "a", "b", anchor.alias("anchor"), observed.alias("observed"), eligible.alias("eligible"), family.alias("family"), count.cast("long").alias("placement_count"), (one_a | one_b).alias("_one"))
    trivial = F.col("_one") & (F.size("eligible") == 0)
    seeds = made.select(
        F.concat_ws(":", "qname", F.col("mate").cast("string"), F.col("a.rank").cast("string"), F.col("b.rank").cast("string")).alias("id"), F.lit("STAGE2_MOSAIC").alias("source"), "anchor",
        F.slice("observed", 1, PLACEMENTS).alias("observed"), F.slice("eligible", 1, PLACEMENTS).alias("eligible"), "placement_count", "family", (F.col("placement_count") <= PLACEMENTS).alias("complete"), (F.col("a.read_end") - F.col("b.read_start")).cast("long").alias("overlap"),
        molecule.alias("molecule"), F.col("a.reverse").alias("molecule_minus"), (F.col("b.read_end") - F.col("b.read_start")).cast("long").alias("clip_length"), (F.col("a.read_end") - F.col("a.read_start")).cast("long").alias("aligned_length"),
        F.lit(0).alias("mapq"), F.lit(None).cast("int").alias("score"), F.lit("STAGE2_MOSAIC").alias("geometry"), (F.col("_one") & ~trivial).alias("anchored"), F.when(trivial, TRIVIAL).when(~F.col("_one"), BOTH_SIDES).alias("rejection"), F.lit(None).cast("string").alias("limit"),
    )
    first = F.get("copies", F.lit(0))
    end = endpoint(first["start"], F.col("span"), F.col("reverse"), True)
    limit = F.lit(LIMITS["geometry"])
    stopped = over.select(
        F.concat_ws(":", "qname", F.col("mate").cast("string")).alias("id"), F.lit("STAGE2_MOSAIC").alias("source"), _place(first["seq_id"], end["pos"], end["minus"]).alias("anchor"), none.alias("observed"), none.alias("eligible"), F.col("families").cast("long").alias("placement_count"),
        F.concat_ws(":", F.lit("STAGE2_RESOURCE"), "qname", F.col("mate").cast("string")).alias("family"), F.lit(False).alias("complete"), F.lit(0).cast("long").alias("overlap"), molecule.alias("molecule"), F.lit(False).alias("molecule_minus"), F.lit(0).cast("long").alias("clip_length"),
        (F.col("read_end") - F.col("read_start")).cast("long").alias("aligned_length"), F.lit(0).alias("mapq"), F.lit(None).cast("int").alias("score"), F.lit("STAGE2_RESOURCE_LIMIT").alias("geometry"), F.lit(False).alias("anchored"), limit.alias("rejection"), limit.alias("limit"),
    )
    anchored = made.where(F.col("_one") & ~trivial).select(F.concat_ws(":", "qname", F.col("mate").cast("string"), F.col("a.rank").cast("string"), F.col("b.rank").cast("string")).alias("id"), "anchor", "eligible", (F.col("b.n") == 1).alias("_second"), (F.col("a.read_end") - F.col("b.read_start")).cast("long").alias("overlap"))
    return seeds.unionByName(stopped), _nearest_ends(anchored, repeats, contigs)


def _nearest_ends(anchored: DataFrame, repeats: DataFrame, contigs: DataFrame) -> DataFrame:
    """Candidates of unique anchors with the nearest eligible copy at a repeat's end on their contig."""
    inside = repeats_near(anchored.select("id", "anchor.seq_id", "anchor.pos"), repeats, "id", "seq_id", "pos").select("id").distinct()
    unique = anchored.join(inside, "id", "left_anti")
    copies = unique.select("id", "anchor", "_second", "overlap", F.explode("eligible").alias("copy")).where("copy.seq_id = anchor.seq_id").withColumn("_at", F.struct("id", "copy"))
    met = repeats_near(copies.select("_at", F.col("copy.seq_id").alias("seq_id"), F.col("copy.pos").alias("pos")), repeats, "_at", "seq_id", "pos")
    near = F.least(F.abs(F.col("_at.copy.pos") - F.col("repeat.start")), F.abs(F.col("_at.copy.pos") - F.col("repeat.end"))) <= TERMINUS_REACH
    ends = copies.join(met.where(near).select("_at").distinct(), "_at", "left_semi").join(contigs.select("seq_id", F.length("seq").alias("_n")), F.col("anchor.seq_id") == F.col("seq_id"))
    apart = F.abs(F.col("anchor.pos") - F.col("copy.pos"))
    best = ends.groupBy("id", "anchor", "_second", "overlap").agg(F.min_by("copy", F.struct(F.least(apart, F.col("_n") - apart), F.col("copy.pos"))).alias("copy"))
    one, two = F.when(F.col("_second"), F.col("copy")).otherwise(F.col("anchor")), F.when(F.col("_second"), F.col("anchor")).otherwise(F.col("copy"))
    sides = {f"{c}{k}": s[c] for k, s in ((1, one), (2, two)) for c in ("seq_id", "pos", "minus")}
    return canonical_candidates(best.select("id", *(v.alias(k) for k, v in sides.items()), "overlap").select("id", *KEY)).withColumn("seed_reads", F.lit(1))


def _usable() -> Column:
    return F.col("complete") & F.col("limit").isNull() & F.col("anchored")


def _limited(seeds: DataFrame, when: Column, reason: str) -> DataFrame:
    """Seeds with a limit where a condition holds: they keep what was seen, and lose the copies among which one could be chosen."""
    when = F.coalesce(when, F.lit(False))
    return seeds.withColumns({
        "limit": F.when(when, F.coalesce("limit", F.lit(reason))).otherwise(F.col("limit")), "complete": F.col("complete") & ~when, "eligible": F.when(when, F.array().cast(f"array<{_PLACE}>")).otherwise(F.col("eligible")),
    })


def scoped_limits(seeds: DataFrame) -> DataFrame:
    """Seeds without trivial ones; those of a family of which any is incomplete or at a limit are at one as well.

    Such families are written first, so that the seeds stay where they are while these are few.
    """
    some = seeds.where(~F.col("rejection").eqNullSafe(TRIVIAL)).withColumn("family", F.coalesce("family", F.lit("")))
    bad = some.groupBy("family").agg(F.bool_or(F.col("limit").isNotNull() | ~F.col("complete")).alias("_bad")).where("_bad")
    bad = kept(bad)
    return _limited(some.join(bad, "family", "left"), F.col("_bad"), LIMITS["family"]).select(*SEED)


def resolved_by_others(seeds: DataFrame, entries: int = INDEX_ENTRIES, candidates: int = CANDIDATES, only: Column | None = None) -> DataFrame:
    """Adds resolution_molecule and reciprocal: a copy is chosen where seeds of other molecules, anchored there, have this anchor among their copies.

    Overlap and geometry must agree, and all such seeds must name one copy. The index of copies is counted first: above
    `entries`, every seed is at its limit; a seed whose anchor has more than `candidates` entries is, and no others.
    Ids tell seeds apart; `only` says which seeds are returned, by their anchors.

    Seeds of one anchor with the same copies say the same, but for who they are: of each such group its first seed
    counts, and the first of another molecule than that. Groups, not seeds, are multiplied by their copies, and what is
    known of a place comes to its seeds as one row. Seeds move once, to their anchor's task, and stay dealt by it.
    """
    seeds = seeds.withColumns({"anchor": F.col("anchor").cast(_PLACE), "eligible": F.col("eligible").cast(f"array<{_PLACE}>")})  # one type of places, or the join deals anew
    total = seeds.where(_usable()).agg(F.coalesce(F.sum(F.size("eligible")), F.lit(0)).alias("_total"))  # one row
    rows = _limited(seeds.crossJoin(F.broadcast(total)), F.col("_total") > entries, LIMITS["index"]).drop("_total")
    same = ["anchor", "overlap", "geometry", "eligible"]
    who = F.when(F.col("molecule").isNotNull(), F.struct("id", "molecule"))
    told = rows.where(_usable()).select(*same, who.alias("_who")).repartition("anchor").withColumn("_one", F.min("_who").over(W.partitionBy(*same)))
    groups = told.groupBy(*same).agg(F.count("*").alias("_n"), F.min("_one").alias("one"), F.min(F.when(F.col("_who.molecule") != F.col("_one.molecule"), F.col("_who"))).alias("two"))
    index = groups.select("overlap", "geometry", F.col("anchor").alias("copy"), "one", "two", "_n", F.explode("eligible").alias("place")).withColumn("_here", F.sum("_n").over(W.partitionBy("place")))
    places = index.groupBy(F.col("place").alias("anchor")).agg(F.max("_here").alias("_here"), F.collect_list(F.when(F.col("_here") <= candidates, F.struct("overlap", "geometry", "copy", "one", "two"))).alias("_others"))
    rows = (rows if only is None else rows.where(only)).repartition("anchor").join(places, "anchor", "left")
    open_ones = _usable() & (F.size("eligible") > 1)
    rows = _limited(rows, open_ones & (F.col("_here") > candidates), LIMITS["candidates"])
    other = lambda x: F.when(x["one"]["molecule"] != F.col("molecule"), x["one"]).otherwise(F.when(F.col("molecule").isNotNull(), x["two"]))
    meets = lambda x: (x["overlap"] == F.col("overlap")) & (x["geometry"] == F.col("geometry")) & other(x).isNotNull() & F.array_contains("eligible", x["copy"])
    met = F.when(open_ones & F.col("molecule").isNotNull(), F.transform(F.filter("_others", meets), lambda x: F.struct(x["copy"].alias("copy"), other(x).alias("who"))))
    rows = rows.withColumn("_met", met).drop("_others")
    copies = F.transform("_met", lambda x: x["copy"])
    rows = rows.withColumn("_copy", F.when(F.array_min(copies) == F.array_max(copies), F.array_min(copies)))
    rows = rows.withColumn("_by", F.when(F.col("_copy").isNotNull(), F.array_min(F.transform("_met", lambda x: x["who"]))["molecule"])).drop("_met")
    return rows.select(*(F.when(F.col("_copy").isNotNull(), F.array("_copy")).otherwise(F.col("eligible")).alias(c) if c == "eligible" else F.col(c) for c in SEED), F.col("_by").alias("resolution_molecule"), F.col("_copy").isNotNull().alias("reciprocal"))


def family_records(seeds: DataFrame) -> DataFrame:
    """One row for each family of resolved_by_others' seeds, with its support by molecules and its state.

    Usable seeds belong together by anchor, overlap and copies, others by anchor, overlap and family. A molecule counts
    once, with its longest parts and the strand of its first seed. RESOURCE_LIMIT comes first; RESOLVED needs one copy,
    accepted support and a resolving molecule that isn't one of the family's; SUPPORTED_AMBIGUOUS several copies and
    accepted support; all else is CANDIDATE.
    """
    rows = seeds.withColumns({"_usable": _usable(), "_copies": F.when(_usable(), F.array_sort(F.array_distinct("eligible"))).otherwise(F.array().cast(f"array<{_PLACE}>")), "_family": F.when(_usable(), "").otherwise(F.col("family"))})
    key = ["anchor", "overlap", "_usable", "_copies", "_family"]
    order = F.struct("source", "molecule_minus", "clip_length", "aligned_length", "id")
    of_one = W.partitionBy(*key, "molecule").orderBy(order)
    whole_one = of_one.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.withColumns({"_first": F.row_number().over(of_one) == 1, "_most_aligned": F.max("aligned_length").over(whole_one), "_most_clip": F.max("clip_length").over(whole_one)})
    first = lambda c: F.when(F.col("_first"), F.col(c))
    rows = rows.withColumns({"_minus": first("molecule_minus"), "_aligned": first("_most_aligned"), "_clip": first("_most_clip")})
    every = lambda c: F.array_sort(F.collect_set(c)).alias(c)
    merged = lambda c, n: F.array_sort(F.array_distinct(F.flatten(F.collect_set(c)))).alias(n)
    whole = rows.groupBy(*key).agg(
        F.min_by("family", first("molecule")).alias("family"), *(every(c) for c in ("clip_length", "aligned_length", "mapq", "score", "source", "geometry", "rejection", "limit", "resolution_molecule")), merged("eligible", "feasible"), merged("observed", "observed"),
        F.max("placement_count").alias("placement_count"), F.bool_and("complete").alias("complete"), F.bool_or("reciprocal").alias("reciprocal"), F.bool_and("anchored").alias("anchored"), F.collect_set("molecule").alias("_molecules"),
        *support_columns("_aligned", "_clip", F.col("_minus"), F.col("_first")),
    )
    independent = F.size(F.array_except("resolution_molecule", "_molecules")) > 0
    good = F.col("anchored") & accepted()
    limited = ~F.col("complete") | (F.col("placement_count") > PLACEMENTS) | (F.size("limit") > 0)
    state = F.when(limited, STATES[3]).when((F.size("feasible") == 1) & independent & good, STATES[2]).when((F.size("feasible") > 1) & good, STATES[1]).otherwise(STATES[0])
    spots = F.when(F.size("feasible") > 0, F.col("feasible")).otherwise(F.col("observed"))
    pos = F.transform(spots, lambda p: p["pos"])
    return whole.select(
        "anchor", "overlap", "family", "placement_count", "complete", "feasible", "observed", state.alias("state"), F.coalesce(F.array_min(pos), F.col("anchor.pos")).alias("start"), F.coalesce(F.array_max(pos), F.col("anchor.pos")).alias("end"),
        F.col("reads").alias("molecules"), "plus", "minus", "best_min", "clip_length", "aligned_length", "mapq", "score", "source", "geometry", "reciprocal", "resolution_molecule", F.array_sort(F.array_distinct(F.concat("rejection", "limit"))).alias("reasons"),
    )


def repeat_families(seeds: DataFrame, entries: int = INDEX_ENTRIES, candidates: int = CANDIDATES) -> DataFrame:
    """Seeds to families with states: limits by family, resolution by others, records. Empty tables give none.

    A family's seeds share their anchor, by which they are dealt already; those without one are dealt anew, by family.
    """
    rows, placed = scoped_limits(seeds), F.col("anchor.seq_id").isNotNull()
    some, others = (resolved_by_others(rows, entries, candidates, only) for only in (placed, ~placed))
    return family_records(some).unionByName(family_records(others.repartition("anchor", "family")))


def table_rows(records: DataFrame, contigs: DataFrame) -> DataFrame:
    """Rows of the table of junctions whose copy stays open, for products.repeat_ambiguous; contigs are numbered by name."""
    names = contigs.select("seq_id").distinct().withColumn("_k", F.row_number().over(W.orderBy("seq_id")) - 1)  # contigs are few
    every = names.agg(F.array_sort(F.collect_list("seq_id")).alias("reference_contigs"))
    totals = records.agg(F.count("*").alias("candidate_count"), F.count("*").alias("repeat_family_count"), F.count_if(F.col("state") == STATES[3]).alias("overflow_count"), F.count_if(F.col("state") == STATES[0]).alias("discard_count"))
    rows = records.join(F.broadcast(names), F.col("anchor.seq_id") == F.col("seq_id"), "left").crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(every))
    return rows.select(
        "reference_contigs", "state", (F.col("state") == STATES[2]).alias("exact_breakpoint_supported"), F.coalesce("_k", F.lit(0)).alias("anchor_contig_idx"), F.col("anchor.pos").alias("anchor_position_1"), F.when(F.col("anchor.minus"), "-").otherwise("+").alias("anchor_orientation"),
        "placement_count", F.col("complete").alias("placement_set_complete"), F.size("feasible").alias("feasible_copy_count"), F.concat_ws("-", F.col("start").cast("string"), F.col("end").cast("string")).alias("breakpoint_interval"), "overlap", F.col("molecules").alias("distinct_molecule_count"),
        F.col("plus").alias("plus_molecules"), F.col("minus").alias("minus_molecules"), F.col("clip_length").alias("clip_lengths"), F.col("aligned_length").alias("aligned_lengths"), F.col("mapq").alias("effective_mapq"), F.col("score").alias("alignment_scores"), F.col("source").alias("sources"),
        F.col("geometry").alias("pair_geometry"), F.col("reciprocal").alias("reciprocal_evidence"), F.col("resolution_molecule").alias("resolution_molecule_ids"), F.lit("NOT_USED_FOR_COPY_RESOLUTION").alias("coverage_context"), F.col("reasons").alias("rejection_reasons"), F.col("family").alias("placement_family"), F.lit("").alias("placement_sequence"),
        "candidate_count", "repeat_family_count", "overflow_count", "discard_count",
    )
