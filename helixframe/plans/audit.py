"""The pairwise audit and the cohort: from records of two or more samples to tables and a report, as one lazy plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.functions.geometry import PRODUCT_KINDS, event_intervals
from helixframe.functions.identity import scoped, scoped_fields
from helixframe.operators import classify, cohort, differential, intended, sites
from helixframe.plans.session import cut
from helixframe.sources import writers

EDITS = "edit_id string, seq_id string, start long, end long, ref string, alt string, kind string"
SITES = "seq_id string, start long, end long, strand string, target string, pam string, mismatches int, site_id string"
SITE_ORDER = ["seq_id", "start", "end", "strand", "mismatches", "target", "pam"]


@dataclass
class Audit:
    """What an audit found: tables of a few thousand rows a sample, computed once, and sites, which are lazy."""

    events: DataFrame
    assessments: DataFrame
    sites: DataFrame
    unintended: DataFrame

    def summary(self) -> DataFrame:
        """(key, value): counts by class, and of edits by status."""
        classes = self.unintended.groupBy(F.concat(F.lit("class_"), "class").alias("key")).agg(F.count("*").alias("value"))
        edits = self.assessments.groupBy(F.concat(F.lit("intended_"), "status").alias("key")).agg(F.count("*").alias("value"))
        total = self.events.agg(F.count("*").alias("value")).select(F.lit("events").alias("key"), "value")
        return total.unionByName(classes).unionByName(edits)

    def report(self) -> str:
        plain = self.unintended.select("event_id", "kind", F.array_join("fields", " ").alias("fields"), "class", "site_id", "distance").orderBy("event_id")
        edits = self.assessments.select("edit_id", "kind", "status", F.array_join("notes", "; ").alias("notes")).orderBy("edit_id")
        return writers.report("Edit audit", {"Summary": self.summary().orderBy("key"), "Intended edits": edits, "Unintended events": plain, "Candidate sites": self.sites.orderBy("site_id")})


def _product(df: DataFrame, *more: str) -> DataFrame:
    return df.where(F.col("kind").isin(*PRODUCT_KINDS)).select(*more, "id", "kind", "fields")


def _judged(events: DataFrame, edits: DataFrame, found: DataFrame, editor: str, within: int, hypothesis: bool) -> Audit:
    """Assesses edits by events, and classes by sites what no edit explains."""
    judged = cut(intended.assess(edits, events))  # a few thousand rows a sample, read by several of the tables
    rest = cut(intended.unmasked(events, judged))
    sides = rest.select("event_id", F.explode(event_intervals(F.col("kind"), F.col("fields"))).alias("s")).select("event_id", "s.*")
    size = F.when(F.col("kind") == "DEL", F.get("fields", F.lit(2)).try_cast("long"))
    return Audit(events, judged, found, cut(classify.classify(rest.withColumn("size", size), sides, found, editor, within, hypothesis)))


def audit(edited: DataFrame, starter: DataFrame, contigs: DataFrame, edits: DataFrame | None = None, guide: str | None = None, nuclease: sites.Nuclease = sites.CAS9, mismatches: int = classify.MAX_MISMATCHES, within: int = classify.NEAR_DISTANCE, hypothesis: bool = False) -> Audit:
    """Compares an edited sample's records with its starter's (id, kind, fields): what was meant, and what else changed.

    contigs is (seq_id, seq). Without edits nothing is masked; without a guide no sites are searched, as for cuts that
    no guide directs.
    """
    spark = edited.sparkSession
    events = cut(differential.difference(_product(edited), _product(starter), contigs))
    if edits is None:
        edits = spark.createDataFrame([], EDITS)
    if guide:
        found = sites.scan(contigs, guide, nuclease, mismatches)
        found = cohort.numbered(found, SITE_ORDER, "SITE", 6, "site_id")
    else:
        found = spark.createDataFrame([], SITES)
    return _judged(events, edits, found, "cas9" if guide else "dsb", within, hypothesis)


def audit_clones(records: DataFrame, starter: DataFrame, contigs: DataFrame, edits: DataFrame | None = None, guides: DataFrame | None = None, side: int = 3, mismatches: int = classify.MAX_MISMATCHES, within: int = classify.NEAR_DISTANCE, hypothesis: bool = False) -> Audit:
    """audit() of many clones in one plan, each against the same starter.

    records is (clone_id, id, kind, fields), edits have clone_id as well, guides is (clone_id, guide, pam). In what it
    returns, ids of events, edits and sequences are scoped by their clone (functions.identity), so that clones never
    meet in a join. A guide is searched once, however many clones have it; the starter is read once. Clones without a
    guide have no sites, and clones without records no rows.
    """
    spark = records.sparkSession
    own = differential.difference(_product(records, "clone_id"), _product(starter), contigs, by=("clone_id",))
    fields = scoped_fields("clone_id", F.col("kind"), F.col("fields"))
    events = cut(own.select(scoped("clone_id", "event_id").alias("event_id"), "kind", fields.alias("fields"), "ids"))
    if edits is None:
        edits = spark.createDataFrame([], f"clone_id string, {EDITS}")
    edits = edits.select(scoped("clone_id", "edit_id").alias("edit_id"), scoped("clone_id", "seq_id").alias("seq_id"), "start", "end", "ref", "alt", "kind")
    found = spark.createDataFrame([], SITES)
    if guides is not None:
        asked = guides.where("guide is not null").select("clone_id", F.col("guide").alias("_guide"), F.col("pam").alias("_pattern"))
        # guides are settings, a few in a cohort: one search each, however many clones share it
        for r in asked.select("_guide", "_pattern").distinct().orderBy("_guide", "_pattern").collect():
            near = cohort.numbered(sites.scan(contigs, r._guide, sites.Nuclease("cohort", r._pattern, side), mismatches), SITE_ORDER, "SITE", 6, "site_id")
            near = near.withColumns({"_guide": F.lit(r._guide), "_pattern": F.lit(r._pattern)}).join(asked, ["_guide", "_pattern"])
            found = found.unionByName(near.withColumn("seq_id", scoped("clone_id", "seq_id")).drop("_guide", "_pattern", "clone_id"))
    return _judged(events, edits, found, "cas9", within, hypothesis)


def cohort_tables(records: DataFrame, starter: DataFrame, contigs: DataFrame, clones: list[str]) -> tuple[DataFrame, DataFrame]:
    """(recurrence, matrix) of many clones' records (clone_id, id, kind, fields) against one starter.

    All clones are one table: events that a clone shares with the starter by identity are left out, then counted.
    """
    named = differential.canonical(records.where(F.col("kind").isin(*PRODUCT_KINDS)), contigs).select("clone_id", "event_id")
    known = differential.canonical(starter.where(F.col("kind").isin(*PRODUCT_KINDS)), contigs).select("event_id").distinct()
    fresh = named.join(known, "event_id", "left_anti").distinct()
    return cohort.recurrence(fresh, "event_id", "clone_id", len(clones)), cohort.presence_matrix(fresh, "event_id", "clone_id", clones)
