"""Classes and annotations of unintended events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.geometry import event_intervals, is_structural
from helixframe.functions.identity import bare
from helixframe.operators.intervals import best_of, window_join

#: Reach of a site, greatest mismatches.
NEAR_DISTANCE, MAX_MISMATCHES = 50, 4
#: Mobile elements by family, as exact names and beginnings of names, upper case.
FAMILIES = {
    "IS1 family": (("IS1",), ("IS1_", "IS1A", "IS1B", "IS1C", "IS1D", "IS1E", "IS1F", "IS1R")),
    "IS3 family": (("IS3",), ("IS150", "IS911", "IS600", "IS3_", "IS3A")),
    "IS4 family": (("IS4",), ("IS186", "IS10", "IS50", "IS4_")),
    "IS5 family": (("IS5",), ("IS903", "IS1182", "IS5_")),
    "IS2 family": (("IS2",), ("IS2_",)),
    "IS30 family": ((), ("IS30",)),
    "IS110 family": ((), ("IS110", "IS621")),
    "IS21 family": ((), ("IS21",)),
    "IS256 family": ((), ("IS256",)),
    "IS630 family": ((), ("IS630",)),
    "IS66 family": ((), ("IS66",)),
    "Tn3 family": ((), ("TN3", "TN1000")),
    "Tn7 family": ((), ("TN7",)),
}
FEATURE_ORDER = ("CDS", "tRNA", "rRNA", "gene")


def element_family(name: Column) -> Column:
    """The family of a mobile element's name: the first whose names or beginnings fit, else its own, else unspecific."""
    s = F.trim(name)
    up, out = F.upper(s), None
    for family, (names, starts) in FAMILIES.items():
        fits = reduce(lambda a, b: a | b, [up.startswith(x) for x in starts] + [up == x for x in names])
        out = F.when(fits, family) if out is None else out.when(fits, family)
    return out.when(up.startswith("IS"), F.concat(s, F.lit(" family"))).otherwise("Mobile Element")


def associate(events: DataFrame, sites: DataFrame, within: int = NEAR_DISTANCE) -> DataFrame:
    """All pairs of event sides (event_id, side, seq_id, start, end) and sites within a distance; adds distance."""
    named = sites.select("seq_id", "site_id", F.col("start").alias("site_start"), F.col("end").alias("site_end"), "mismatches", "pam")
    return window_join(events, named, ["seq_id"], ("start", "end"), ("site_start", "site_end"), within, 1000)


def primary(pairs: DataFrame) -> DataFrame:
    """Each event's nearest site: least distance, mismatches, side, site_id."""
    return best_of(pairs, ["event_id"], [F.col("distance"), F.col("mismatches"), F.col("side"), F.col("site_id")])


def event_class(kind: Column, size: Column, associated: Column, editor: str = "cas9", hypothesis: bool = False) -> Column:
    """struct(class, hypothesis): structural, else near_homolog (for guided editors), else scattered_snv."""
    name = F.when(is_structural(kind, size), "structural").when(F.lit(editor != "dsb") & associated, "near_homolog").otherwise("scattered_snv")
    return F.struct(name.alias("class"), F.when(F.lit(hypothesis) & (name == "scattered_snv"), "sos_widney2014").alias("hypothesis"))


def classify(events: DataFrame, sides: DataFrame, sites: DataFrame, editor: str = "cas9", within: int = NEAR_DISTANCE, hypothesis: bool = False) -> DataFrame:
    """Events (event_id, kind, size) with class, hypothesis, and the nearest site's id, distance, mismatches and PAM."""
    near = primary(associate(sides, sites, within)).select("event_id", "site_id", "distance", "mismatches", "pam")
    rows = events.join(near, "event_id", "left").withColumn("_c", event_class(F.col("kind"), F.col("size"), F.col("site_id").isNotNull(), editor, hypothesis))
    shown = F.col("_c.class") == "near_homolog"
    return rows.select(*events.columns, F.col("_c.class").alias("class"), F.col("_c.hypothesis").alias("hypothesis"), *(F.when(shown, F.col(c)).alias(c) for c in ("site_id", "distance", "mismatches", "pam")))


def masked_companions(junctions: DataFrame, elements: DataFrame, reach: int = 20) -> DataFrame:
    """Junctions (event_id, seq_id, pos) that aren't the evidence of an element insertion (seq_id, pos) within reach."""
    j = junctions.withColumn("_p", F.col("pos"))
    e = elements.select("seq_id", F.col("pos").alias("_e"), F.col("pos").alias("_f"))
    hit = window_join(j, e, ["seq_id"], ("pos", "_p"), ("_e", "_f"), reach, 1000).select("event_id").distinct()
    return junctions.join(hit, "event_id", "left_anti")


def intended_hits(events: DataFrame, intended: DataFrame) -> DataFrame:
    """(event_id, edit_id) of event sides that overlap an intended edit (edit_id, seq_id, start, end)."""
    e = intended.select("seq_id", "edit_id", F.col("start").alias("_a"), F.col("end").alias("_b"))
    return window_join(events, e, ["seq_id"], ("start", "end"), ("_a", "_b"), 0, 1000).select("event_id", "edit_id").distinct()


def evidence_summary(parents: Column) -> Column:
    """struct(ra, mc, jc): 1 where a record of the kind is among the parents' kinds, else null, which isn't 0."""
    return F.struct(*(F.when(F.array_contains(parents, k.upper()), 1).alias(k) for k in ("ra", "mc", "jc")))


def gene_context(points: DataFrame, features: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """points (point_id, seq_id, pos) with feature_type, label and consequence.

    The overlapping feature of the highest order (CDS, tRNA, rRNA, gene, others; ties by ord), else the neighbours on
    both sides. features has ord, seq_id, start, end, feature_type, label, and the columns `keep`, which an overlapping
    feature adds (strings; null between features).
    """
    from helixframe.operators.intervals import nearest

    p = points.withColumn("_p", F.col("pos"))
    f = features.select("seq_id", F.col("start").alias("_a"), F.col("end").alias("_b"), "feature_type", "label", "ord", *keep)
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, FEATURE_ORDER)), F.col("feature_type")), F.lit(0))
    rank = F.when(rank == 0, len(FEATURE_ORDER) + 1).otherwise(rank)
    inside = best_of(window_join(p, f, ["seq_id"], ("pos", "_p"), ("_a", "_b"), 0, 1000), ["point_id"], [rank, F.col("ord")])
    inside = inside.select("point_id", "feature_type", "label", *keep, F.concat(F.lit("within "), "feature_type").alias("consequence"))
    named = features.select("seq_id", "start", "end", F.coalesce("label", F.lit("unknown")).alias("name"))
    rest = nearest(points.join(inside, "point_id", "left_anti"), named, ["seq_id"], "pos", "start", "end", "name")
    up, down = F.col("pos") - F.col("up_end"), F.col("down_start") - F.col("pos")
    text = (
        F.when(up.isNotNull() & down.isNotNull(), F.format_string("intergenic (+%d bp from %s, -%d bp to %s)", up, "up_name", down, "down_name"))
        .when(up.isNotNull(), F.format_string("intergenic (+%d bp downstream of %s)", up, "up_name"))
        .when(down.isNotNull(), F.format_string("intergenic (%d bp upstream of %s)", down, "down_name"))
    )
    flanked = rest.select("point_id", F.when(text.isNotNull(), "intergenic").alias("feature_type"), F.when(text.isNotNull(), F.concat_ws("/", "up_name", "down_name")).alias("label"), *(F.lit(None).cast("string").alias(c) for c in keep), text.alias("consequence"))
    return points.join(inside.unionByName(flanked), "point_id", "left")


def annotations(events: DataFrame, features: DataFrame) -> DataFrame:
    """(event_id, gene_name, locus_tag, feature_type, consequence) of events (event_id, seq_id, position) among features.

    features has ord, seq_id, start, end, feature_type, locus_tag and gene_name. Within a feature its own names count,
    between features the neighbours' names, without a locus. Sequences without features have nulls.
    """
    named = features.withColumn("label", F.coalesce("gene_name", "locus_tag"))
    points = events.select(F.col("event_id").alias("point_id"), bare("seq_id").alias("seq_id"), F.col("position").alias("pos"))
    found = gene_context(points, named, ("locus_tag", "gene_name"))
    between = F.col("feature_type") == "intergenic"
    return found.select(F.col("point_id").alias("event_id"), F.when(between, F.col("label")).otherwise(F.col("gene_name")).alias("gene_name"), "locus_tag", "feature_type", "consequence")


def links_by_point(events: DataFrame, sites: DataFrame, within: int = NEAR_DISTANCE) -> DataFrame:
    """associate() of events (event_id, kind, fields) by points alone: a record is where it begins, whatever its length; a junction is at both sides."""
    sides = events.select("event_id", "kind", F.posexplode(event_intervals(F.col("kind"), F.col("fields"))).alias("k", "s"))
    return associate(sides.select("event_id", "kind", (F.col("k") + 1).alias("side"), "s.seq_id", "s.start", F.col("s.start").alias("end")), sites, within)
