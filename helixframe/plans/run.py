"""Whole runs, from files to published tables: one pair of samples, a cohort of clones, one sample's calls, a search for sites."""

from __future__ import annotations

import glob
import os
import shlex

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import checks
from helixframe.functions.geometry import PRODUCT_KINDS, event_intervals
from helixframe.functions.identity import all_bare, scope
from helixframe.operators import classify, differential, sites
from helixframe.plans import evidence
from helixframe.plans.audit import Audit, audit, audit_clones
from helixframe.plans.session import cut, kept
from helixframe.sources import products, readers, writers

#: Settings of the external aligner's three passes.
PASSES = {"primary": "--local", "unmatched": "--local -L 9 --score-min L,6,0.2 -k 200", "junction": "--local -L 10 --score-min L,1,0.70 -k 2000"}


def aligner_command(kind: str, index: str, reads: list[str], out: str, threads: int = 1, program: str | None = None) -> list[str]:
    """The command of a pass of the external aligner; raises where the program isn't there, as SAM files are taken as well."""
    found = program or checks.program("bowtie2")
    if found is None:
        raise FileNotFoundError("no aligner is installed: give SAM files of the pass instead")
    files = ["-U", reads[0]] if len(reads) == 1 else ["-1", reads[0], "-2", reads[1]]
    return [found, *shlex.split(PASSES[kind]), "-p", str(threads), "-x", index, *files, "-S", out]


def sibling_annotation(reference: str) -> str | None:
    """A GenBank file beside the reference with its name, which has repeats and features."""
    stem = os.path.splitext(reference)[0]
    found = [f"{stem}.gb", f"{stem}.gbk", *sorted(glob.glob(os.path.join(os.path.dirname(reference) or ".", "*.gb*")))]
    return next((p for p in found if os.path.isfile(p)), None)


def _placed(events: DataFrame) -> DataFrame:
    """Events with seq_id, position and end: their first interval."""
    first = F.element_at(event_intervals(F.col("kind"), F.col("fields")), 1)
    return events.withColumn("_i", first).select(*events.columns, F.col("_i.seq_id").alias("seq_id"), F.col("_i.start").alias("position"), F.col("_i.end").alias("end"))


def evidence_of(records: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, id, evidence): of each record with parents, which kinds of evidence these are."""
    asked = records.select(*by, "id", F.explode("parent_ids").alias("_parent"))
    kinds = records.select(*by, F.col("id").alias("_parent"), F.col("kind").alias("_kind"))
    return asked.join(kinds, [*by, "_parent"]).groupBy(*by, "id").agg(products.evidence_text(F.collect_set("_kind")).alias("evidence"))


def tables(found: Audit, contigs: DataFrame, within: int, version: int, features: DataFrame | None = None, proofs: DataFrame | None = None, editor: str = "cas9", hypothesis: bool = False) -> dict[str, tuple[list[str], DataFrame]]:
    """The product tables of an audit, by file name: header and lines (clone_id, value); clone_id is null unless ids are scoped.

    features are read_features' rows, for genes; proofs (scope, id, evidence) what evidence_of tells by record, the scope
    null for a single sample.
    """
    spark = contigs.sparkSession
    events = _placed(found.events)
    events = events.withColumns({"id": F.element_at("ids", 1), "_scope": scope("event_id")})
    if proofs is None:
        proofs = spark.createDataFrame([], "scope string, id int, evidence string")
    told = proofs.select(F.coalesce("scope", F.lit("")).alias("_p"), F.col("id").alias("_id"), "evidence")
    events = events.join(told, (F.coalesce("_scope", F.lit("")) == F.col("_p")) & (F.col("id") == F.col("_id")), "left").withColumn("evidence", F.coalesce("evidence", products.evidence_text(F.lit(None).cast("array<string>")))).drop("_p", "_id", "_scope")
    if features is None:
        genes = spark.createDataFrame([], "event_id string, gene_name string, locus_tag string, feature_type string")
    else:
        genes = classify.annotations(events, features)
    variants = products.post_edit_variants(events, found.assessments, found.unintended, contigs, genes)
    sides = found.unintended.select("event_id", "kind", F.posexplode(event_intervals(F.col("kind"), F.col("fields"))).alias("k", "s")).select("event_id", "kind", (F.col("k") + 1).alias("side"), "s.seq_id", "s.start", "s.end")
    near = classify.associate(sides.select("event_id", "kind", "side", "seq_id", "start", "end"), found.sites, within).join(events.select("event_id", "id", "position"), "event_id")
    rest = products.unintended_rows(_placed(found.unintended), contigs, editor)
    of = lambda df, key: df.withColumn("clone_id", scope(key))
    keep = ("clone_id",)
    lines = {
        "edit_outcomes.tsv": products.table("edit_outcomes", of(products.edit_outcomes(found.assessments, events), "edit_id"), version, keep),
        "post_edit_variants.tsv": products.table("post_edit_variants", of(variants, "event_id"), version, keep),
        "mutation_offtarget_links.tsv": products.table("mutation_offtarget_links", of(products.links(near, within), "event_id"), version, keep),
        "offtarget_sites.tsv": writers.sites(of(found.sites, "seq_id"), keep),
        "unintended.tsv": writers.unintended(of(rest, "event_id"), hypothesis, version == 2, keep),
    }
    return {name: (names, rows.withColumn("value", all_bare("value"))) for name, (names, rows) in lines.items()}


def _features(spark: SparkSession, reference: list[str], annotation: str | None) -> DataFrame | None:
    """Features of a GenBank file: the given one, else one beside the reference, if there is one."""
    path = annotation or sibling_annotation(reference[0])
    return readers.read_features(spark, path) if path else None


def run_audit(spark: SparkSession, edited: str, starter: str, reference: list[str], out: str, intended: str | None = None, guide: str | None = None, pam: str | None = None, editor: str = "cas9", mismatches: int = 4, within: int = 50, hypothesis: bool = False, version: int = 2, annotation: str | None = None) -> Audit:
    """Compares two files of records and publishes the tables, a summary, provenance and a report into one folder."""
    contigs = kept(readers.read_reference(spark, reference))
    edits = readers.read_intended(spark, intended) if intended else None
    guide, nuclease = _search(guide, pam, editor)
    checks.within("mismatches", mismatches, 0, 10)
    records = readers.read_gd(spark, edited)
    found = audit(records, readers.read_gd(spark, starter), contigs, edits, guide, nuclease, mismatches, within, hypothesis)
    proofs = evidence_of(records).withColumn("scope", F.lit(None).cast("string"))
    made = tables(found, contigs, within, version, _features(spark, reference, annotation), proofs, editor, hypothesis)
    files = {name: writers.rendered(t) for name, t in made.items()}
    files["summary.txt"] = "".join(f"{r.key}\t{r.value}\n" for r in found.summary().orderBy("key").collect())
    files["report.md"] = found.report()
    files["provenance.tsv"] = _provenance(reference, checks.search_status(guide is not None, found.sites.limit(1).count()))
    writers.publish(out, files)
    return found


def _search(guide: str | None, pam: str | None, editor: str) -> tuple[str | None, sites.Nuclease]:
    """What is searched: a checked guide, none for editors that no guide directs, and the PAM given or usual for the editor."""
    guide = checks.spacer(guide) if guide and checks.editor(editor) != "dsb" else None
    usual = sites.CAS12A if editor == "cas12a" else sites.CAS9
    return guide, sites.Nuclease(editor, checks.pam(pam or usual.pam), usual.side)


def _provenance(reference: list[str], status: str) -> str:
    digest = checks.file_sha256(reference[0]) if os.path.isfile(reference[0]) else None
    return products.provenance("1", os.environ.get("GIT_COMMIT", "NA"), digest, None, status, checks.utc_now())


def _broken(records: DataFrame, edits: DataFrame, contigs: DataFrame) -> DataFrame:
    """(clone_id, why): what stops a clone's audit and nobody else's, the least message of each clone."""
    ids = contigs.select(F.col("seq_id").alias("_s"), F.lit(True).alias("_there"))
    product = records.where(F.col("wrong").isNull() & F.col("kind").isin(*PRODUCT_KINDS))
    named = product.select("clone_id", F.explode(F.array_compact(F.array(F.get("fields", F.lit(0)), F.when(F.col("kind") == "JC", F.get("fields", F.lit(3)))))).alias("_s")).distinct()
    unknown = named.join(ids, "_s", "left_anti").select("clone_id", F.concat(F.lit("unknown sequence "), "_s").alias("why"))
    wrong = records.where("wrong is not null").select("clone_id", "wrong").union(edits.where("wrong is not null").select("clone_id", "wrong"))
    return unknown.union(wrong).groupBy("clone_id").agg(F.min("why").alias("why"))


def run_batch(spark: SparkSession, manifest: str, starter: str, reference: list[str], out: str, intended: str | None = None, guide: str | None = None, pam: str | None = None, editor: str = "cas9", mismatches: int = 4, within: int = 50, hypothesis: bool = False, version: int = 2, annotation: str | None = None) -> DataFrame:
    """Audits every clone of a manifest, whose r1 is a file of records, against one starter; a clone's own edits, guide and PAM go before the given ones.

    All clones are one plan: their files are one scan, and each product table is one table, written as text by clone
    (out/<table>/clone_id=<clone>), each part with its header. A clone that fails is a row of the report and of
    out/failures, and doesn't stop the others. Returns the matrix of all clones, which is one table as well.
    """
    contigs, rows, failed = kept(readers.read_reference(spark, reference)), [], {}
    checks.within("mismatches", mismatches, 0, 10)
    for row in readers.read_manifest(spark, manifest).collect():  # settings, one row a clone: only checked here
        try:
            own, nuclease = _search(row.spacer or guide, row.pam or pam, editor)
            paths = [readers.beside(row.r1, manifest), readers.beside(row.intended_tsv, manifest) or intended]
            if absent := [p for p in paths if p and readers.named_file(spark, p) is None]:
                raise ValueError(f"no file {absent[0]}")
            rows.append((checks.clone_id(row.clone_id), *paths, own, nuclease.pam))
        except ValueError as e:
            failed[row.clone_id] = str(e)
    plan = spark.createDataFrame(rows, "clone_id string, r1 string, edits string, guide string, pam string")
    records = kept(readers.read_gd_of_clones(spark, plan.select("clone_id", F.col("r1").alias("path"))))
    edits = cut(readers.read_intended_of_clones(spark, plan.where("edits is not null").select("clone_id", F.col("edits").alias("path"))))
    bad = cut(_broken(records, edits, contigs))
    failed |= {r.clone_id: r.why for r in bad.collect()}
    clones = [r[0] for r in rows if r[0] not in failed]
    if not clones:
        raise ValueError("every clone failed: " + "; ".join(f"{c}: {why}" for c, why in failed.items()))
    records, edits, plan = (df.join(F.broadcast(bad.select("clone_id")), "clone_id", "left_anti") for df in (records, edits, plan))
    side = (sites.CAS12A if editor == "cas12a" else sites.CAS9).side
    known = readers.read_gd(spark, starter)
    found = audit_clones(records, known, contigs, edits, plan.select("clone_id", "guide", "pam"), side, mismatches, within, hypothesis)
    proofs = evidence_of(records, ("clone_id",)).withColumnRenamed("clone_id", "scope")
    for name, (header, lines) in tables(found, contigs, within, version, _features(spark, reference, annotation), proofs, editor, hypothesis).items():
        writers.by_clone(lines, header, plan.select("clone_id"), os.path.join(out, name))
    spark.createDataFrame(sorted(failed.items()), "clone_id string, why string").coalesce(1).write.mode("overwrite").csv(os.path.join(out, "failures"), sep="\t", header=True)
    own = differential.canonical(records.where(F.col("kind").isin(*PRODUCT_KINDS)), contigs)
    named = own.join(differential.canonical(known.where(F.col("kind").isin(*PRODUCT_KINDS)), contigs).select("event_id").distinct(), "event_id", "left_anti")
    matrix = kept(products.batch_matrix(products.clone_observations(named), clones))
    names = matrix.columns
    status = checks.search_status(any(r[3] for r in rows), found.sites.limit(1).count())
    writers.publish(os.path.join(out, "cohort"), {"batch_variants.tsv": writers.rendered((names, writers.tsv_lines(matrix, {n: F.col(n) for n in names}, "NA"))), "batch_report.md": products.batch_report(matrix, clones, failed), "provenance.tsv": _provenance(reference, status)})
    return matrix


def run_evidence(spark: SparkSession, sam: str | dict[str, str], reference: list[str], out: str, repeats: DataFrame | None = None) -> DataFrame:
    """Records of alignments, by sample (sam: a SAM file, or one for each sample's name), as Parquet.

    Repeats are those given, else those of a GenBank file beside the reference, if there is one.
    """
    contigs = readers.read_reference(spark, reference)
    files = {"sample": sam} if isinstance(sam, str) else sam
    reads = None
    for name, path in files.items():
        part = readers.read_sam(spark, path).withColumn("sample", F.lit(name))
        reads = part if reads is None else reads.unionByName(part)
    annotated = sibling_annotation(reference[0]) if repeats is None else None
    if annotated:
        repeats = readers.read_repeats(spark, annotated)
    found = evidence.records(reads.withColumn("read_id", F.xxhash64("qname", "flag")), contigs, repeats)
    found.write.mode("overwrite").parquet(out)
    return spark.read.parquet(out)


def run_sites(spark: SparkSession, reference: list[str], guide: str, out: str, pam: str = "NGG", mismatches: int = 4) -> DataFrame:
    """Candidate sites of a guide, as Parquet."""
    found = sites.scan(readers.read_reference(spark, reference), checks.spacer(guide), sites.Nuclease("custom", checks.pam(pam), 3), mismatches)
    found.write.mode("overwrite").parquet(out)
    return found
