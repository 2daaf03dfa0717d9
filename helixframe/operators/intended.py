"""Whether declared edits were made: each is judged by the events that meet it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.geometry import event_intervals
from helixframe.operators.intervals import window_join

#: Reach of a cassette's junctions; how far deletion ends, junctions at deletions, and cassette junctions may be off.
CASSETTE_REACH, DELETION_SLACK, JUNCTION_SLACK, CASSETTE_SLACK = 50, 2, 5, 5
SMALL = ("snp", "sub", "ins")
#: What assessments say beside their status.
NOTES = {
    "extra_structure": "the edit is there, and a structural event beside it",
    "extra_sequence": "the edit is there, and another sequence event beside it",
    "disrupted": "no edit; a structural event lies on its place",
    "other_sequence": "no edit; another sequence event lies on its place",
    "beside_deletion": "the deletion is there, and another event beside it",
    "beside_junction": "a junction shows the deletion, and other events lie beside it",
    "by_junction": "only junctions show the deletion",
    "odd_junction": "no deletion; a junction with other ends lies on its place",
    "odd_event": "no deletion; another event lies on its place",
    "one_end": "one end of the cassette is missing",
    "beside_cassette": "the cassette is there, and another event beside it",
    "ends": "the deletion's ends are off by %d and %d bases",
}
ASSESSMENT = "edit_id string, kind string, seq_id string, start long, end long, status string, matched array<string>, unexpected array<string>, left_diff long, right_diff long, expected_size long, observed_size long, notes array<string>"


def meeting(intended: DataFrame, events: DataFrame) -> DataFrame:
    """Pairs of edits (edit_id, seq_id, start, end, ref, alt, kind) and events (event_id, kind, fields) at their place.

    An event meets an edit that one of its intervals overlaps, for cassettes within their reach. Adds role: match (the
    edit's own kind and bases), mismatch (its kind, other bases), junction, deletion, element, or other.
    """
    sides = events.select("event_id", F.col("kind").alias("event_kind"), "fields", F.explode(event_intervals(F.col("kind"), F.col("fields"))).alias("s")).select("event_id", "event_kind", "fields", "s.seq_id", F.col("s.start").alias("_a"), F.col("s.end").alias("_b"))
    edits = intended.withColumns({"kind": F.lower("kind"), "_reach": F.when(F.lower("kind") == "cassette", CASSETTE_REACH).otherwise(0)})
    near = window_join(edits, sides, ["seq_id"], ("start", "end"), ("_a", "_b"), CASSETTE_REACH, 1000).where("distance <= _reach")
    near = near.dropDuplicates(["edit_id", "event_id"])
    k, seen = F.col("event_kind"), F.when(F.col("event_kind").isin("SNP", "INS"), F.get("fields", F.lit(2))).when(F.col("event_kind") == "SUB", F.get("fields", F.lit(3)))
    free = F.col("alt").isNull() | F.col("alt").isin("", ".")
    same = free | F.coalesce(F.upper(seen) == F.upper("alt"), F.lit(True))
    own = (k == F.upper("kind")) & F.col("kind").isin(*SMALL)
    role = F.when(own, F.when(same, "match").otherwise("mismatch")).when(k == "JC", "junction").when(k == "DEL", "deletion").when(k == "MOB", "element").otherwise("other")
    return near.select("edit_id", "event_id", "event_kind", "fields", role.alias("role"), seen.alias("observed"))


def _small(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """SNP, SUB and INS edits: complete if only matching events meet them."""
    has = lambda *roles: F.coalesce(F.bool_or(F.col("role").isin(*roles)), F.lit(False))
    ids = lambda *roles: F.array_sort(F.collect_list(F.when(F.col("role").isin(*roles), F.col("event_id"))))
    rough = ("junction", "deletion", "element")
    g = edits.join(rows, "edit_id", "left").groupBy(*edits.columns).agg(
        has("match").alias("hit"), has("mismatch").alias("miss"), has(*rough).alias("rough"), has("other").alias("odd"), ids("match").alias("m"), ids("mismatch").alias("x"), ids(*rough, "other").alias("o"),
        F.array_sort(F.collect_set(F.when(F.col("role") == "mismatch", F.concat(F.lit("other bases: "), "observed", F.lit(" in place of "), "alt")))).alias("alleles"),
    )
    hit, miss, rough_, odd = F.col("hit"), F.col("miss"), F.col("rough"), F.col("odd")
    status = F.when(rough_, "unexpected_structure").when(hit, F.when(miss | odd, "partial").otherwise("complete")).when(miss, "partial").otherwise("missing")
    note = (
        F.when(rough_ & (hit | miss), NOTES["extra_structure"])
        .when(hit & (miss | odd), NOTES["extra_sequence"])
        .when(rough_, NOTES["disrupted"])
        .when(odd & ~miss & ~hit, NOTES["other_sequence"])
    )
    notes = F.array_compact(F.concat(F.when(hit, F.array().cast("array<string>")).otherwise(F.col("alleles")), F.array(note)))
    none = F.lit(None).cast("long")
    return g.select("edit_id", "kind", "seq_id", "start", "end", status.alias("status"), F.when(hit, F.col("m")).otherwise(F.col("x")).alias("matched"), F.when(hit, F.array_sort(F.concat("x", "o"))).otherwise(F.col("o")).alias("unexpected"), none.alias("left_diff"), none.alias("right_diff"), none.alias("expected_size"), none.alias("observed_size"), notes.alias("notes"))


def _deletions(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """Deletions: the closest one is judged by its ends and size; without one, junctions at both ends can stand for it."""
    span = F.col("end") - F.col("start") + 1
    pairs = edits.join(rows, "edit_id", "left").withColumn("alt", F.coalesce("alt", F.lit(".")))
    at = lambda i: F.get("fields", F.lit(i)).try_cast("long")
    size = at(2)
    left, right = at(1) - F.col("start"), at(1) + size - 1 - F.col("end")
    found = F.when(F.col("role") == "deletion", F.struct((F.abs(left) + F.abs(right)).alias("off"), F.abs(size - span).alias("d"), "event_id", left.alias("l"), right.alias("r"), size.alias("n")))
    fits = (F.col("role") == "junction") & (F.abs(at(1) - F.col("start")) <= JUNCTION_SLACK) & (F.abs(at(4) - F.col("end")) <= JUNCTION_SLACK)
    g = pairs.groupBy(*edits.columns).agg(F.min(found).alias("b"), F.array_sort(F.collect_list(F.when(F.coalesce(fits, F.lit(False)), F.col("event_id")))).alias("j"), F.array_sort(F.collect_list("event_id")).alias("all"), F.coalesce(F.bool_or(F.col("role") == "junction"), F.lit(False)).alias("any_j"))
    has, b = F.col("b").isNotNull(), F.col("b")
    matched = F.when(has, F.array("b.event_id")).otherwise(F.col("j"))
    unexpected = F.array_except("all", matched)
    more = F.size(unexpected) > 0
    exact = (F.abs(b["l"]) <= DELETION_SLACK) & (F.abs(b["r"]) <= DELETION_SLACK) & (b["n"] == span) & (F.col("alt").isNull() | F.col("alt").isin("", "."))
    joined = F.size("j") > 0
    status = F.when(has, F.when(more, "unexpected_structure").when(exact, "complete").otherwise("partial")).when(joined & ~more, "complete").when(more, "unexpected_structure").otherwise("missing")
    note = (
        F.when(has & more, NOTES["beside_deletion"])
        .when(has & ~exact, F.format_string(NOTES["ends"], b["l"], b["r"]))
        .when(~has & joined & more, NOTES["beside_junction"])
        .when(~has & joined, NOTES["by_junction"])
        .when(~has & F.col("any_j"), NOTES["odd_junction"])
        .when(~has & more, NOTES["odd_event"])
    )
    return g.select("edit_id", "kind", "seq_id", "start", "end", status.alias("status"), matched.alias("matched"), unexpected.alias("unexpected"), b["l"].alias("left_diff"), b["r"].alias("right_diff"), span.alias("expected_size"), b["n"].alias("observed_size"), F.array_compact(F.array(note)).alias("notes"))


def _cassettes(edits: DataFrame, rows: DataFrame) -> DataFrame:
    """Cassettes: junctions or elements near both ends; each end takes the closest, the rest is unexpected."""
    pairs = edits.join(rows, "edit_id", "left")
    at = lambda i: F.get("fields", F.lit(i)).try_cast("long")
    near = F.col("role").isin("junction", "element")
    spot = lambda target: F.least(*(F.struct(F.abs(p - F.col(target)).alias("off"), (p - F.col(target)).alias("d")) for p in (at(1), F.when(F.col("role") == "junction", at(4)).otherwise(at(1)))))
    best = lambda target: F.min(F.when(near & (spot(target)["off"] <= CASSETTE_REACH), F.struct(spot(target)["off"].alias("off"), F.col("event_id"), spot(target)["d"].alias("d"))))
    g = pairs.groupBy(*edits.columns).agg(best("start").alias("l"), best("end").alias("r"), F.array_sort(F.collect_list("event_id")).alias("all"))
    l_ok, r_ok = F.coalesce(F.col("l.off") <= CASSETTE_SLACK, F.lit(False)), F.coalesce(F.col("r.off") <= CASSETTE_SLACK, F.lit(False))
    matched = F.array_sort(F.array_distinct(F.array_compact(F.array(F.when(l_ok, F.col("l.event_id")), F.when(r_ok, F.col("r.event_id"))))))
    unexpected = F.array_except("all", matched)
    status = F.when(l_ok & r_ok, F.when(F.size(unexpected) > 0, "unexpected_structure").otherwise("complete")).when(l_ok | r_ok, "partial").when(F.size("all") > 0, "unexpected_structure").otherwise("missing")
    note = F.when(l_ok != r_ok, NOTES["one_end"]).when(l_ok & r_ok & (F.size(unexpected) > 0), NOTES["beside_cassette"])
    none = F.lit(None).cast("long")
    return g.select("edit_id", "kind", "seq_id", "start", "end", status.alias("status"), matched.alias("matched"), unexpected.alias("unexpected"), F.col("l.d").alias("left_diff"), F.col("r.d").alias("right_diff"), none.alias("expected_size"), none.alias("observed_size"), F.array_compact(F.array(note)).alias("notes"))


def assess(intended: DataFrame, events: DataFrame) -> DataFrame:
    """ASSESSMENT rows: each edit's status (complete, partial, missing, unexpected_structure), events, ends and notes.

    Edits of other kinds are complete if any event meets them. Everything is a join by interval and one aggregation
    by edit.
    """
    edits = intended.withColumn("kind", F.lower("kind")).select("edit_id", "seq_id", "start", "end", "ref", "alt", "kind")
    rows = meeting(intended, events)
    known = (*SMALL, "del", "indel", "cassette")
    other = edits.where(~F.col("kind").isin(*known)).join(rows, "edit_id", "left").groupBy("edit_id", "kind", "seq_id", "start", "end").agg(F.array_sort(F.collect_list("event_id")).alias("matched"))
    none, empty = F.lit(None).cast("long"), F.array().cast("array<string>")
    other = other.select("edit_id", "kind", "seq_id", "start", "end", F.when(F.size("matched") > 0, "complete").otherwise("missing").alias("status"), "matched", empty.alias("unexpected"), none.alias("left_diff"), none.alias("right_diff"), none.alias("expected_size"), none.alias("observed_size"), empty.alias("notes"))
    return _small(edits.where(F.col("kind").isin(*SMALL)), rows).unionByName(_deletions(edits.where(F.col("kind").isin("del", "indel")), rows)).unionByName(_cassettes(edits.where("kind = 'cassette'"), rows)).unionByName(other)


def unmasked(events: DataFrame, assessments: DataFrame) -> DataFrame:
    """Events but for those that some edit expects and none finds unexpected or partial."""
    expected = assessments.where(F.col("status") == "complete").select(F.explode("matched").alias("event_id"))
    against = assessments.select(F.explode("unexpected").alias("event_id")).union(assessments.where("status <> 'complete'").select(F.explode("matched")))
    return events.join(expected.join(against, "event_id", "left_anti").distinct(), "event_id", "left_anti")
