"""The audit's product tables as lines: edit outcomes, variants, links to sites, provenance, and the cohort's report.

Version 2 of a table is version 1 with more columns at its end. Column names are fixed values of the formats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions.geometry import is_structural
from helixframe.functions.identity import bare
from helixframe.sources import writers

#: Columns by table, and those that version 2 adds.
COLUMNS = {
    "edit_outcomes": "edit_id kind seq_id expected_start expected_end status matched_event_ids left_boundary_status right_boundary_status expected_size observed_size unexpected_events notes".split(),
    "post_edit_variants": "variant_id seq_id position end gd_type ref alt origin_status intended_relation size_class review_priority guide_relation guide_mismatches pam dist_to_site mobile_element evidence gene locus_tag feature_type legacy_class".split(),
    "mutation_offtarget_links": "mutation_id site_id mutation_type mutation_position site_start site_end distance_to_site mismatches pam cfd_score association_window".split(),
}
MORE = {
    "edit_outcomes": ["matched_event_ids_dv1", "unexpected_event_ids_dv1"],
    "post_edit_variants": ["event_id"],
    "mutation_offtarget_links": ["event_id", "junction_side", "search_backend", "bulge_type", "bulge_size"],
}


def columns(table: str, version: int = 2) -> list[str]:
    """Columns of a table in a version; other versions than 1 and 2 are an error."""
    if version not in (1, 2):
        raise ValueError(f"no version {version} of the tables")
    return COLUMNS[table] + (MORE[table] if version == 2 else [])


def table(name: str, rows: DataFrame, version: int = 2, keep: tuple[str, ...] = ()) -> tuple[list[str], DataFrame]:
    """Header and lines of a table whose rows have its columns; null is NA."""
    names = columns(name, version)
    return names, writers.tsv_lines(rows, {n: F.col(n) for n in names}, "NA", keep)


def unintended_rows(classed: DataFrame, contigs: DataFrame, editor: str) -> DataFrame:
    """Rows of the table of unintended events: classed has event_id, kind, fields, class, hypothesis, distance, mismatches, pam,
    and seq_id, position and end. Alleles are bases only: other kinds than SNP, SUB and INS show dots."""
    at = lambda i: F.get("fields", F.lit(i))
    kind, second = F.col("kind"), lambda i: F.when(F.col("kind") == "JC", at(i))
    rows = classed.join(contigs.select(F.col("seq_id").alias("_c"), F.col("seq").alias("_seq")), bare("seq_id") == F.col("_c"), "left")
    alt = F.when(kind.isin("SNP", "INS"), at(2)).when(kind == "SUB", at(3))
    return rows.select(
        "event_id", "seq_id", "position", F.when(kind == "JC", F.col("position")).otherwise(F.col("end")).alias("end"), kind.alias("gd_type"), display_alleles(kind, F.col("fields"), F.col("_seq"))["genomic"].alias("ref"), F.coalesce(alt, F.lit(".")).alias("alt"), "class", "hypothesis",
        F.lit(editor).alias("editor"), F.col("pam").alias("pam_profile"), F.col("mismatches").alias("offtarget_mismatch"), F.col("distance").alias("distance_to_site"), second(3).alias("side2_seq_id"), second(4).alias("side2_position"),
    )


def evidence_text(kinds: Column) -> Column:
    """RA=1;MC=NA;JC=NA: which kinds of evidence are among an event's (an array, null for none); no evidence is NA, never 0."""
    return F.concat_ws(";", *(F.concat(F.lit(f"{k}="), F.when(F.array_contains(kinds, k), "1").otherwise("NA")) for k in ("RA", "MC", "JC")))


def display_alleles(kind: Column, fields: Column, seq: Column) -> Column:
    """struct(ref, alt, genomic): what a variants table shows of a record, and the reference's own bases for substitutions.

    Positions outside the sequence give a dot. Kinds without alleles show dots, junctions their second side.
    """
    at = lambda i, missing=".": F.coalesce(F.get(fields, F.lit(i)), F.lit(missing))
    pos = F.get(fields, F.lit(1)).try_cast("int")
    size = F.when(kind == "SUB", F.coalesce(F.get(fields, F.lit(2)).try_cast("int"), F.lit(1))).otherwise(1)
    bases = F.when(pos.between(1, F.length(seq)), F.upper(F.substring(seq, pos, size))).otherwise(".")
    genomic = F.when(kind.isin("SNP", "SUB"), F.coalesce(bases, F.lit("."))).otherwise(".")
    ref = F.when(kind == "SNP", genomic).when(kind == "SUB", at(2)).when(kind == "DEL", F.coalesce(F.concat(F.get(fields, F.lit(2)), F.lit("bp")), F.lit("."))).when(kind.isin("MOB", "JC"), "none").otherwise(".")
    alt = F.when(kind.isin("SNP", "INS"), at(2)).when(kind == "SUB", at(3)).when(kind == "DEL", "none").when(kind == "MOB", at(2, "IS")).when(kind == "JC", F.concat(at(3), F.lit(":"), at(4))).otherwise(".")
    return F.struct(ref.alias("ref"), alt.alias("alt"), genomic.alias("genomic"))


def _boundary(off: Column, slack: int) -> Column:
    return F.when(off.isNull(), "NA").when(F.abs(off) <= slack, "PASS").otherwise(F.format_string("FAIL(%dbp)", off))


def edit_outcomes(assessments: DataFrame, events: DataFrame, slack: int = 2) -> DataFrame:
    """Rows of the table of edit outcomes: assessments with their events' record ids (events has event_id and id).

    Empty lists are NONE. An assessment that names an event that isn't there stops the job.
    """
    ids = events.select("event_id", F.col("id").cast("string").alias("gd"))
    keyed = assessments.withColumn("_edit", F.struct("edit_id", "kind", "seq_id", "start", "end"))
    named = keyed.select("_edit", F.explode(F.array(F.struct(F.lit("m").alias("role"), F.col("matched").alias("list")), F.struct(F.lit("u").alias("role"), F.col("unexpected").alias("list")))).alias("x"))
    named = named.select("_edit", "x.role", F.posexplode("x.list").alias("k", "event_id")).join(ids, "event_id", "left")
    gd = F.coalesce("gd", F.raise_error(F.concat(F.lit("an edit names the missing event "), "event_id")).cast("string"))
    lists = named.groupBy("_edit").agg(*(F.array_sort(F.collect_list(F.when(F.col("role") == r, F.struct("k", gd.alias("gd"))))).alias(r) for r in "mu"))
    rows = keyed.join(lists, "_edit", "left")
    joined = lambda c: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.array_join(c, ",")).otherwise("NONE")
    gds = lambda r: joined(F.transform(r, lambda x: x["gd"]))
    return rows.select(
        "edit_id", "kind", "seq_id", F.col("start").alias("expected_start"), F.col("end").alias("expected_end"), F.upper("status").alias("status"), gds("m").alias("matched_event_ids"),
        _boundary(F.col("left_diff"), slack).alias("left_boundary_status"), _boundary(F.col("right_diff"), slack).alias("right_boundary_status"), "expected_size", "observed_size", gds("u").alias("unexpected_events"),
        F.when(F.size("notes") > 0, F.array_join("notes", "; ")).otherwise("NONE").alias("notes"), joined(F.col("matched")).alias("matched_event_ids_dv1"), joined(F.col("unexpected")).alias("unexpected_event_ids_dv1"),
    )


def review_priority(size_class: Column, relation: Column, guide: Column) -> Column:
    """How soon a variant should be looked at: unexpected structures and candidate off-targets first, expected ones last."""
    return F.when(relation == "EXPECTED", "LOW").when((size_class == "STRUCTURAL") | (guide == "CANDIDATE_OFF_TARGET"), "HIGH").otherwise("MEDIUM")


def post_edit_variants(events: DataFrame, assessments: DataFrame, classed: DataFrame, contigs: DataFrame, annotations: DataFrame) -> DataFrame:
    """Rows of the variants table: every event (event_id, kind, fields, seq_id, position, end, evidence) annotated.

    classed has class, site_id, distance, mismatches and pam by event; annotations gene_name, locus_tag and feature_type;
    contigs (seq_id, seq). An event that an edit expects is EXPECTED, one that an edit finds beside it UNEXPECTED. Ids
    are a hash of the event's, so no row waits for a global order.
    """
    expected = assessments.select(F.explode("matched").alias("event_id")).distinct().withColumn("_m", F.lit(True))
    beside = assessments.select(F.explode("unexpected").alias("event_id")).distinct().withColumn("_u", F.lit(True))
    rows = events.join(expected, "event_id", "left").join(beside, "event_id", "left").join(classed.select("event_id", "class", "site_id", "distance", "mismatches", F.col("pam").alias("_pam")), "event_id", "left")
    rows = rows.join(annotations.select("event_id", "gene_name", "locus_tag", "feature_type"), "event_id", "left").join(contigs.select(F.col("seq_id").alias("_c"), F.col("seq").alias("_seq")), bare("seq_id") == F.col("_c"), "left")
    size = F.when(F.col("kind") == "DEL", F.get("fields", F.lit(2)).try_cast("long"))
    relation = F.when(F.col("_m"), "EXPECTED").when(F.col("_u"), "UNEXPECTED").otherwise("UNRELATED")
    guide = F.when(F.col("_m"), "ON_TARGET").when(F.col("site_id").isNotNull(), "CANDIDATE_OFF_TARGET").otherwise("NONE")
    off = lambda c: F.when(F.col("guide_relation") == "CANDIDATE_OFF_TARGET", F.col(c))
    rows = rows.withColumns({"intended_relation": relation, "guide_relation": guide, "size_class": F.when(is_structural(F.col("kind"), size), "STRUCTURAL").otherwise("SMALL"), "_show": display_alleles(F.col("kind"), F.col("fields"), F.col("_seq"))})
    element = F.when(F.col("kind") == "MOB", F.format_string("%s(TSD=%s)", F.coalesce(F.get("fields", F.lit(2)), F.lit("IS")), F.coalesce(F.get("fields", F.lit(4)), F.lit("none")))).otherwise("NONE")
    return rows.select(
        F.concat(F.lit("VAR_"), F.substring(F.sha2(bare("event_id"), 256), 1, 12)).alias("variant_id"), "seq_id", "position", "end", F.col("kind").alias("gd_type"), F.col("_show.ref").alias("ref"), F.col("_show.alt").alias("alt"), F.lit("EDITED_ONLY").alias("origin_status"),
        "intended_relation", "size_class", review_priority(F.col("size_class"), F.col("intended_relation"), F.col("guide_relation")).alias("review_priority"), "guide_relation", off("mismatches").alias("guide_mismatches"), off("_pam").alias("pam"), off("distance").alias("dist_to_site"),
        element.alias("mobile_element"), "evidence", F.col("gene_name").alias("gene"), "locus_tag", "feature_type", F.coalesce("class", F.lit("none")).alias("legacy_class"), "event_id",
    )


def links(associations: DataFrame, window: int, backend: str = "spark") -> DataFrame:
    """Rows of the table of links between events and sites: every association within the window.

    associations has event_id, id, kind, position, side and the site's site_id, site_start, site_end, distance,
    mismatches and pam, and may have cfd, bulge_type and bulge_size.
    """
    have = set(associations.columns)
    given = lambda c, other: F.coalesce(F.col(c), F.lit(other)) if c in have else F.lit(other)
    cfd = F.when(F.col("cfd").isNotNull(), F.format_string("%.4f", F.col("cfd"))) if "cfd" in have else F.lit(None).cast("string")
    return associations.select(
        F.concat(F.lit("mut_"), F.col("id").cast("string")).alias("mutation_id"), "site_id", F.col("kind").alias("mutation_type"), F.col("position").alias("mutation_position"), "site_start", "site_end", F.col("distance").alias("distance_to_site"), "mismatches", "pam", cfd.alias("cfd_score"), F.lit(window).alias("association_window"),
        "event_id", F.when(F.col("kind") == "JC", F.concat(F.lit("side"), F.col("side").cast("string"))).alias("junction_side"), F.lit(backend).alias("search_backend"), given("bulge_type", "none").alias("bulge_type"), given("bulge_size", 0).alias("bulge_size"),
    )


def in_order(associations: DataFrame) -> DataFrame:
    """Associations in their order of presentation: event, side (those without first), distance, mismatches, site, position."""
    return associations.orderBy("event_id", F.col("side").asc_nulls_first(), "distance", "mismatches", "site_id", "position")


def events_in_order(events: DataFrame, kinds: tuple[str, ...] = ("SNP", "SUB", "INS", "DEL", "MOB", "AMP", "CON", "INV", "JC")) -> DataFrame:
    """Events by kind, in the order of the formats, then by sequence, position and fields."""
    return events.orderBy(F.array_position(F.array(*map(F.lit, kinds)), F.col("kind")), "seq_id", "position", F.array_join("fields", "\t"))


def provenance(engine: str, commit: str, reference_sha256: str | None, aligner: str | None, search: str, timestamp: str) -> str:
    """The table of provenance, key and value; what this engine never computes says so."""
    values = {"engine_version": engine, "git_commit": commit, "reference_sha256": reference_sha256, "aligner_version": aligner, "offtarget_search_status": search, "cfd_scoring_status": "NOT_PERFORMED", "hsu_scoring_status": "NOT_PERFORMED", "bulge_search_status": search, "run_timestamp": timestamp}
    return "key\tvalue\n" + "".join(f"{k}\t{'NA' if v is None else v}\n" for k, v in values.items())


def clone_observations(records: DataFrame) -> DataFrame:
    """Records (clone_id, event_id, kind, fields) as a cohort sees them: place, end and alleles by kind, and a junction's other side."""
    at = lambda i: F.get("fields", F.lit(i))
    k, pos = F.col("kind"), F.get("fields", F.lit(1)).try_cast("long")
    size = F.when(k.isin("SUB", "DEL", "AMP", "CON", "INV"), at(2).try_cast("long")).otherwise(1)
    bp = F.concat(size.cast("string"), F.lit("bp"))
    ref = F.when(k.isin("SUB", "DEL", "AMP", "CON", "INV"), bp).when(k.isin("JC", "MOB"), "none").otherwise(".")
    alt = F.when(k.isin("SNP", "INS", "MOB"), at(2)).when(k.isin("SUB", "CON"), at(3)).when(k == "DEL", "none").when(k == "AMP", F.concat(F.lit("x"), at(3))).when(k == "INV", "inverted").when(k == "JC", F.concat(at(3), F.lit(":"), at(4), F.lit(":overlap="), F.coalesce(at(6), F.lit("0")))).otherwise(".")
    other = lambda i: F.when(k == "JC", at(i))
    return records.select("clone_id", "event_id", "kind", at(0).alias("seq_id"), pos.alias("position"), (pos + F.coalesce(size, F.lit(1)) - 1).alias("end"), ref.alias("ref"), alt.alias("alt"), other(3).alias("side2_seq_id"), other(4).try_cast("long").alias("side2_position"))


def batch_matrix(observations: DataFrame, clones: list[str]) -> DataFrame:
    """One row an event of a cohort: its place and alleles, in how many clones it is, and a column of 1 and 0 for each clone."""
    n = F.count_distinct("clone_id")
    first = [F.min(c).alias(c) for c in ("kind", "seq_id", "position", "end", "ref", "alt", "side2_seq_id", "side2_position")]
    scope = F.when(n == 1, "clone_specific").when(n == len(clones), "shared_all").otherwise("shared_subset")
    return observations.groupBy("event_id").agg(*first, n.alias("n_clones"), scope.alias("scope"), *(F.max((F.col("clone_id") == c).cast("int")).alias(f"clone_{c}") for c in clones))


def batch_report(matrix: DataFrame, clones: list[str], failed: dict[str, str] | None = None) -> str:
    """A cohort's report in Markdown: how events are shared, each clone's count, clones that failed, and the shared events."""
    counts = matrix.groupBy("scope", "kind").agg(F.count("*").alias("events")).orderBy("scope", "kind")
    one = matrix.agg(*(F.sum(f"clone_{c}").alias(c) for c in clones))
    return writers.report("Cohort", {"Sharing": counts, "Events by clone": one, "Clones that failed": "\n".join(f"* {c}: {why}" for c, why in sorted((failed or {}).items())) or "None.", "Shared events": matrix.where("n_clones > 1").select("event_id", "kind", "seq_id", "position", "alt", "n_clones").orderBy("event_id")})


#: Columns of the table of junctions whose repeat copy stays open.
AMBIGUOUS = (
    "sample_id reference_contigs state exact_breakpoint_supported anchor_contig_idx anchor_position_1 anchor_orientation placement_count placement_set_complete feasible_copy_count breakpoint_interval overlap distinct_molecule_count plus_molecules minus_molecules "
    "clip_lengths aligned_lengths effective_mapq alignment_scores sources pair_geometry reciprocal_evidence resolution_molecule_ids coverage_context rejection_reasons placement_family placement_sequence candidate_count repeat_family_count overflow_count discard_count"
).split()


def repeat_ambiguous(rows: DataFrame, sample: str) -> tuple[list[str], DataFrame]:
    """Header and lines of that table; arrays are joined by commas, columns that the rows lack are empty."""
    kinds = dict(rows.dtypes)
    shown = lambda n: F.lit(sample) if n == "sample_id" else F.lit(None) if n not in kinds else F.array_join(F.col(n).cast("array<string>"), ",") if kinds[n].startswith("array") else F.col(n)
    return AMBIGUOUS, writers.tsv_lines(rows, {n: shown(n) for n in AMBIGUOUS})
