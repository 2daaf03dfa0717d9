"""From aligned reads of any number of samples to records: calls, missing coverage, junctions, deletions, insertions of elements.

One plan for all samples: reads are walked once, and every step that works along a contig gets the sample as a part of
the contig's name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.functions.sequence import right_aligned_deletion
from helixframe.operators import constructs, elements, emission, folding, intervals, junctions, pileup
from helixframe.operators.constructs import KEY
from helixframe.plans.session import cut, kept

#: Separates a sample from a contig in the names that steps work with.
APART = "\x1f"
#: Least length of missing coverage that is a record; how far a junction's sides may be from a deletion whose bounds it gives.
LEAST_MISSING, JUNCTION_REACH = 3, 50
#: Order of kinds in a file of records.
ORDER = ("SNP", "SUB", "DEL", "INS", "MOB", "MC", "JC")
NO_REPEATS = "ord long, seq_id string, start long, `end` long, strand int, name string"


def _keyed(table: DataFrame, samples: DataFrame, name: str = "seq_id") -> DataFrame:
    """A table of contigs, or of places on them, once for each sample; both are small beside the reads."""
    return table.crossJoin(F.broadcast(samples)).withColumn(name, F.concat_ws(APART, "sample", name)).drop("sample")


def junction_reads(seen: DataFrame, contigs: DataFrame) -> DataFrame:
    """One row for each read's view of a junction: (id, sample, read_id, minus, cigar, side1, side2, KEY), the lesser side first.

    Clipped ends are placed in the contigs, once for equal ones, whatever the sample; longer indels within a read are
    junctions as they are. side1 and side2 are the read's bases on each side.
    """
    clips = seen.where(F.col("what").isin("clip_left", "clip_right")).select(F.xxhash64("sample", "read_id", "what", "pos").alias("id"), "sample", "read_id", F.col("contig").alias("seq_id"), (F.col("pos") + 1).alias("pos"), (F.col("what") == "clip_left").alias("left"), "bases", "minus", "before", "after")
    placed, _ = constructs.clip_candidates(clips.select("id", "seq_id", "pos", "left", "bases"), contigs)
    from_clips = placed.join(clips.select("id", "sample", "read_id", "minus", F.col("before").alias("side1"), F.col("after").alias("side2")), "id").withColumn("cigar", F.lit(False))
    split = seen.where("what = 'split' and pos2 > pos")
    from_splits = split.select(
        F.xxhash64("sample", "read_id", "what", "pos").alias("id"), "sample", "read_id", "minus", F.lit(True).alias("cigar"), F.col("before").alias("side1"), F.col("after").alias("side2"),
        F.col("contig").alias("seq_id1"), (F.col("pos") + 1).alias("pos1"), F.lit(True).alias("minus1"), F.col("contig").alias("seq_id2"), (F.col("pos2") + 1).alias("pos2"), F.lit(False).alias("minus2"), F.lit(0).alias("overlap"),
    )
    rows = emission.evidence_union(from_clips, from_splits).drop("origin")
    # a side's strand says on which side of its place the joined bases lie, so it stays with it where the sides change places
    swap = F.struct("seq_id1", "pos1") > F.struct("seq_id2", "pos2")
    rows = rows.withColumns({f"{c}{k}": F.when(swap, F.col(f"{c}{3 - k}")).otherwise(F.col(f"{c}{k}")) for k in (1, 2) for c in ("seq_id", "pos", "minus", "side")})
    return rows.withColumns({f"seq_id{k}": F.concat_ws(APART, "sample", f"seq_id{k}") for k in "12"})


def accepted_junctions(rows: DataFrame) -> DataFrame:
    """junction_reads' rows to accepted junctions: (id, KEY, support, seed_reads, ids of the reads, has_cigar), both directions as one."""
    clustered = cut(junctions.clusters(rows.withColumn("overlap", F.col("overlap").cast("long")), ["seq_id1", "minus1", "seq_id2", "minus2"], "pos1", "pos2", "id"))
    first = F.min_by(F.struct(*KEY), F.struct((F.col("id") != F.col("cluster")).alias("other"), "id"))
    places = clustered.groupBy("cluster").agg(first.alias("k"), F.count("*").alias("seed_reads"), F.collect_set("read_id").alias("reads_of"), F.bool_or("cigar").alias("has_cigar"))
    found = places.join(junctions.support(clustered, ["cluster"], "side1", "side2", F.col("minus")), "cluster").select(F.col("cluster").alias("id"), "k.*", "seed_reads", "reads_of", "has_cigar", *folding._SUPPORT)
    found = cut(found.where(junctions.accepted()))
    folded = cut(folding.fold_directions(found))
    parts = folded.select("id", F.explode("ids").alias("_part")).join(found.select(F.col("id").alias("_part"), "reads_of", F.col("has_cigar").alias("_cigar")), "_part")
    reads = parts.groupBy("id").agg(F.array_distinct(F.flatten(F.collect_list("reads_of"))).alias("ids"), F.bool_or("_cigar").alias("has_cigar"))
    return folded.drop("ids").join(reads, "id")


def records(reads: DataFrame, contigs: DataFrame, repeats: DataFrame | None = None) -> DataFrame:
    """Records (sample, id, kind, parent_ids, fields, attrs) of aligned reads (sample, contig, start_0, minus, seq, cigar, mapq, read_id).

    contigs is (seq_id, seq), repeats (ord, seq_id, start, end, strand, name). Ids count within a sample: mutations by
    place, then missing coverage and junctions. Deletions name the missing coverage and the junctions that they come
    from, insertions of elements their two junctions. A sample without findings has no rows; nor has an empty table.
    """
    spark = reads.sparkSession
    repeats = spark.createDataFrame([], NO_REPEATS) if repeats is None else repeats
    seen = kept(pileup.observations(reads, contigs.withColumnRenamed("seq_id", "contig")))
    samples = cut(seen.select("sample").distinct())
    own, copies = _keyed(contigs, samples), _keyed(repeats, samples)
    depth = kept(pileup.depths(seen, contigs.withColumnRenamed("seq_id", "contig")).select(F.concat_ws(APART, "sample", "contig").alias("seq_id"), "pos", "unique_depth", "total_depth"))
    cutoff = cut(intervals.coverage_cutoff(depth, ["seq_id"]))
    ends = own.select("seq_id", F.length("seq").alias("_n"))
    spans = intervals.missing_coverage(depth, ["seq_id"], "pos", cutoff, LEAST_MISSING)
    spans = cut(spans.join(ends, "seq_id").where("start_0 > 0 and end_0 < _n").drop("_n"))  # the ends of contigs have fewer reads

    # each lookup of repeats reads its rows twice, so what goes into a row of them is computed once: a few thousand junctions
    own, copies = cut(own), cut(copies)
    found = cut(accepted_junctions(cut(junction_reads(seen, contigs))))
    folded = cut(folding.fold_copies(found, copies, own).drop("members", "ids"))
    placed = cut(constructs.slid(folded, copies))
    for k in "12":
        placed = emission.with_repeat(placed, copies, "id", f"seq_id{k}", f"pos{k}", f"_r{k}")
    at = depth.select(F.col("seq_id").alias("seq_id1"), (F.col("pos") + 1).alias("pos1"), F.col("total_depth").alias("depth"))
    placed = cut(placed.join(at, ["seq_id1", "pos1"], "left").withColumn("both_repeats", F.col("_r1").isNotNull() & F.col("_r2").isNotNull()).drop("_r1", "_r2"))
    hypotheses = cut(elements.insertion_hypotheses(placed.withColumn("support", F.col("reads")), copies, depth.select("seq_id", (F.col("pos") + 1).alias("pos"), "unique_depth"), own))
    inserted = cut(elements.element_records(elements.insertions(hypotheses)))
    parents = inserted.select(F.explode(F.col("parent_ids").cast("array<long>")).alias("id")).distinct()
    marked = cut(placed.join(parents.withColumn("_parent", F.lit(True)), "id", "left").withColumns({"constituent": F.coalesce("_parent", F.lit(False)), "balanced": (F.col("plus") >= emission.BALANCED) & (F.col("minus") >= emission.BALANCED)}))
    shown = cut(emission.gated(marked.where(F.col("constituent") | junctions.frequent_enough()), copies))

    endpoints = shown.select(F.explode(F.array(*(F.struct(F.col(f"seq_id{k}").alias("seq_id"), F.col(f"pos{k}").alias("endpoint")) for k in "12"))).alias("e")).select("e.*")
    gone = cut(bounded_deletions(intervals.promoted_deletions(spans, depth, ["seq_id"], "pos", cutoff, junctions=endpoints), shown, copies, own))
    calls = pileup.calls_of(seen).select(F.concat_ws(APART, "sample", "contig").alias("seq_id"), "kind", F.col("start_1").alias("start"), (F.col("start_1") + F.col("size") - 1).alias("end"), "size", "alt", "depth", "support", "frequency")
    calls = emission.outside_deletions(cut(calls.withColumn("id", F.xxhash64("seq_id", "start", "kind"))), gone.select("seq_id", (F.col("start_0") + 1).alias("start"), F.col("end_0").alias("end")))
    return _numbered(_small(calls), _missing(spans), _deletions(gone, spans, shown), _insertions(inserted), _junctions(shown))


def bounded_deletions(cores: DataFrame, shown: DataFrame, copies: DataFrame, contigs: DataFrame) -> DataFrame:
    """Deleted cores (seq_id, start_0, end_0) with their exact bounds, and mediated, the repeat that one lies at.

    A junction of the contig whose sides are within JUNCTION_REACH of a core's gives both bounds. Where a copy's end lies
    within TERMINUS_REACH of one side, it gives that one (the left first), and a junction's side near the other one that.
    All other deletions stand at the last of their equivalent places.
    """
    rows = cores.withColumns({"_d": F.struct("seq_id", "start_0", "end_0"), "_left": F.col("start_0"), "_right": F.col("end_0") + 1})
    both = shown.where("seq_id1 = seq_id2").select(F.col("seq_id1").alias("seq_id"), F.least("pos1", "pos2").alias("_p"), F.greatest("pos1", "pos2").alias("_q"), "id")
    near = intervals.band_join(rows.select("seq_id", "_d", "_left", "_right"), both, ["seq_id"], "_left", "_p", JUNCTION_REACH).where(F.abs(F.col("_q") - F.col("_right")) <= JUNCTION_REACH)
    exact = near.groupBy("_d").agg(F.min_by(F.struct("_p", "_q"), F.struct(F.abs(F.col("_p") - F.col("_left")) + F.abs(F.col("_q") - F.col("_right")), "id")).alias("_j"))
    sides = shown.select(F.explode(F.array(*(F.struct(F.col(f"seq_id{k}").alias("seq_id"), F.col(f"pos{k}").alias("_s")) for k in "12"))).alias("s")).select("s.*")
    closest = lambda at, keep: intervals.band_join(rows.select("seq_id", "_d", at), sides, ["seq_id"], at, "_s", JUNCTION_REACH).where(keep).groupBy("_d").agg(F.min_by("_s", F.struct(F.abs(F.col("_s") - F.col(at)), "_s")))
    right = closest("_right", F.col("_s") > F.col("_right") - 6).toDF("_d", "_sr")
    left = closest("_left", F.col("_s") < F.col("_left") + 6).toDF("_d", "_sl")
    rows = cut(rows.join(exact, "_d", "left").join(right, "_d", "left").join(left, "_d", "left"))
    rows = emission.with_repeat(rows, copies, "_d", "seq_id", "_left", "_rl", emission.TERMINUS_REACH)
    rows = cut(emission.with_repeat(rows, copies, "_d", "seq_id", "_right", "_rr", emission.TERMINUS_REACH))
    begin, end = F.coalesce(F.col("_j._p") + 1, F.col("start_0") + 1), F.coalesce(F.col("_j._q") - 1, F.col("end_0"))
    at_left, at_right = F.col("_rl").isNotNull(), F.col("_rl").isNull() & F.col("_rr").isNotNull()
    first = F.when(at_left, F.col("_rl.end") + 1).when(at_right, F.greatest(F.coalesce(F.col("_sl") + 1, begin), F.when(F.col("_sl").isNotNull(), F.col("_left")).otherwise(begin))).otherwise(begin)
    last = F.when(at_left, F.coalesce(F.least(F.col("_sr") - 1, F.col("_right")), end)).when(at_right, F.col("_rr.start") - 1).otherwise(end)
    rows = rows.select("seq_id", F.coalesce("_rl.name", "_rr.name").alias("mediated"), "_d", first.alias("_first"), last.alias("_last")).where("_last >= _first").join(contigs, "seq_id")
    size = F.col("_last") - F.col("_first") + 1
    slid = right_aligned_deletion("seq", F.col("_first").cast("int"), size.cast("int"))
    return rows.select("seq_id", (F.when(F.col("mediated").isNull(), slid).otherwise(F.col("_first")) - 1).cast("long").alias("start_0"), size.alias("_size"), "mediated", "_d").select("seq_id", "start_0", (F.col("start_0") + F.col("_size")).alias("end_0"), "mediated", F.col("_d.start_0").alias("core_start_0"), F.col("_d.end_0").alias("core_end_0"))


def _text(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _record(df: DataFrame, ref: Column, kind: Column, place: Column, fields: list[Column], parents: Column, attrs: dict[str, str]) -> DataFrame:
    """A step's rows as records: ref is the key that others name, parents such keys; null fields are left out at the end."""
    told = F.map_from_arrays(F.array(*map(F.lit, attrs)), F.array(*map(_text, attrs.values()))) if attrs else F.create_map().cast("map<string,string>")
    told = F.map_filter(told, lambda _, v: v.isNotNull())
    return df.select(ref.alias("ref"), kind.alias("kind"), F.col("seq_id").alias("_key"), place.cast("long").alias("_pos"), F.filter(F.array(*fields), lambda x: x.isNotNull()).alias("fields"), parents.alias("_parents"), told.alias("attrs"))


def _contig() -> Column:
    return F.element_at(F.split("seq_id", APART), -1)


def _no_parents() -> Column:
    return F.array().cast("array<string>")


def _small(calls: DataFrame) -> DataFrame:
    sized = F.when(F.col("kind").isin("SUB", "DEL"), _text("size"))
    return _record(calls, F.concat_ws(":", F.lit("call"), _text("id")), F.col("kind"), F.col("start"), [_contig(), _text("start"), sized, F.when(F.col("kind") != "DEL", F.col("alt"))], _no_parents(), {"pd_ra_depth": "depth", "pd_ra_support_reads": "support", "pd_ra_frequency": "frequency"})


def _span(kind: str) -> Column:
    return F.concat_ws(":", F.lit(kind), "seq_id", _text("start_0"), _text("end_0"))


def _missing(spans: DataFrame) -> DataFrame:
    return _record(spans, _span("MC"), F.lit("MC"), F.col("start_0") + 1, [_contig(), _text(F.col("start_0") + 1), _text("end_0"), F.lit("0"), F.lit("0")], _no_parents(), {})


def _deletions(gone: DataFrame, spans: DataFrame, shown: DataFrame) -> DataFrame:
    """Deletions with the missing coverage that they meet and the junctions that join what is left on both sides."""
    held = spans.select("seq_id", F.col("start_0").alias("_a"), (F.col("end_0") - 1).alias("_b"), _span("MC").alias("_ref"))
    core = gone.withColumns({"_d": F.struct("seq_id", "start_0", "end_0"), "_last": F.col("core_end_0") - 1})
    by_span = intervals.window_join(core, held, ["seq_id"], ("core_start_0", "_last"), ("_a", "_b"), 0, 1000).select("_d", "_ref")
    joins = shown.where("seq_id1 = seq_id2 and minus1 and not minus2").select(F.struct(F.col("seq_id1").alias("seq_id"), F.col("pos1").alias("start_0"), (F.col("pos2") - 1).alias("end_0")).alias("_d"), F.concat_ws(":", F.lit("JC"), _text("id")).alias("_ref"))
    refs = by_span.union(joins).groupBy("_d").agg(F.array_sort(F.collect_set("_ref")).alias("_refs"))
    rows = core.join(refs, "_d", "left")
    return _record(rows, _span("DEL"), F.lit("DEL"), F.col("start_0") + 1, [_contig(), _text(F.col("start_0") + 1), _text(F.col("end_0") - F.col("start_0"))], F.coalesce("_refs", _no_parents()), {"mediated": "mediated"})


def _insertions(inserted: DataFrame) -> DataFrame:
    rows = inserted.withColumn("seq_id", F.get("fields", F.lit(0)))
    at = F.get("fields", F.lit(1)).cast("long")
    fields = [_contig(), *(F.get("fields", F.lit(i)) for i in range(1, 5))]
    return _record(rows, F.concat_ws(":", F.lit("MOB"), F.array_join("fields", ":")), F.lit("MOB"), at, fields, F.transform("parent_ids", lambda x: F.concat(F.lit("JC:"), x)), {})


def _junctions(shown: DataFrame) -> DataFrame:
    rows = shown.withColumn("seq_id", F.col("seq_id1"))
    sign = lambda c: F.when(F.col(c), "-1").otherwise("1")
    fields = [_contig(), _text("pos1"), sign("minus1"), F.element_at(F.split("seq_id2", APART), -1), _text("pos2"), sign("minus2"), _text("overlap")]
    attrs = {"pd_support_reads": "reads", "pd_plus_reads": "plus", "pd_minus_reads": "minus", "pd_best_min_overlap": "best_min", "pd_min_overlap_side1": "min_side1", "pd_min_overlap_side2": "min_side2", "pd_repeat_junction": "repeat_junction"}
    return _record(rows, F.concat_ws(":", F.lit("JC"), _text("id")), F.lit("JC"), F.col("pos1"), fields, _no_parents(), attrs)


def _numbered(*parts: DataFrame) -> DataFrame:
    """Records with ids by sample, and parents' ids in place of their keys; a sample's records are few."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    sample = F.substring_index("_key", APART, 1)
    mutation = F.array_position(F.array(*map(F.lit, ORDER)), F.col("kind"))
    order = [F.when(mutation <= 5, 0).otherwise(mutation), "_key", "_pos", "kind", F.array_join("fields", APART)]
    rows = cut(rows.withColumn("sample", sample).withColumn("id", F.row_number().over(W.partitionBy("sample").orderBy(*order))))
    named = rows.select("sample", "ref", F.explode("_parents").alias("_p")).join(rows.select("sample", F.col("ref").alias("_p"), F.col("id").alias("_pid")), ["sample", "_p"])
    parents = named.groupBy("sample", "ref").agg(F.array_sort(F.collect_set("_pid")).alias("parent_ids"))
    out = rows.join(parents, ["sample", "ref"], "left")
    return out.select("sample", "id", "kind", F.coalesce("parent_ids", F.array().cast("array<int>")).alias("parent_ids"), "fields", "attrs")
