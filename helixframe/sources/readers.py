"""Scans of the domain's text formats as DataFrames: all by lines, so that files are split like any text; a row holds one
record at most."""

from __future__ import annotations

import os
import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.operators import segments

#: Fixed values of the record format: positional fields of each kind.
GD_ARITY = {"SNP": 3, "SUB": 4, "INS": 3, "DEL": 3, "MOB": 5, "AMP": 4, "CON": 4, "INV": 3, "JC": 7, "UN": 3, "RA": 5, "MC": 5}
NULLS = ("", ".", "na", "NA")
LOCAL = re.compile("^file:/+")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", r"\r$", "").alias("value"))


def _required(rows: Column, value: Column, message: Column | str) -> Column:
    """value where the condition holds, else an error when the row is computed."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(rows, value).otherwise(F.raise_error(text))


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, n, value): lines with their number in the file, from 0, however files are split.

    A line's number within its split comes from its row's; what splits hold, a row each, gives the numbers at which
    they begin.
    """
    block = F.col("_metadata.file_block_start").alias("_block")
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), block, F.monotonically_increasing_id().alias("_id"), F.regexp_replace("value", r"\r$", "").alias("value"))
    splits = lines.groupBy("file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy("file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    begins = splits.select("file", "_block", "_first", before.alias("_begin"))
    return lines.join(F.broadcast(begins), ["file", "_block"]).select("file", (F.col("_begin") + F.col("_id") - F.col("_first")).alias("n"), "value")


def _joined(values: Column) -> Column:
    """A group's lines, (n, value) or null, one after another; a row of it is one record's, not its file's."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(values)), lambda x: x["value"]), "")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seq): the first word after each >, and the letters of its lines, upper case.

    Files are read by lines, in splits; which record a line belongs to is carried over the splits' borders.
    """
    head = F.startswith("value", F.lit(">"))
    lines = segments.running(numbered_lines(spark, path), ["file"], "n", {"rec": ("sum", head.cast("int"))}).where("rec > 0")
    name = F.max(F.when(head, F.regexp_extract("value", r"^>\s*(\S*)", 1)))
    letters = F.when(~head, F.struct("n", F.upper(F.regexp_replace("value", r"\s", "")).alias("value")))
    return lines.groupBy("file", "rec").agg(name.alias("seq_id"), _joined(letters).alias("seq")).select("seq_id", "seq")


def _genbank_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with the record that they belong to, which // ends, and its section: the word that began the line at which it begins."""
    word = F.regexp_extract("value", r"^([A-Z]+)", 1)
    ends = F.col("value").rlike(r"^//\s*$")
    lines = segments.running(numbered_lines(spark, path), ["file"], "n", {"rec": ("sum", ends.cast("int")), "_s": ("max", F.when((word != "") | ends, F.struct("n", word.alias("word"))))})
    return lines.where(~ends).withColumn("section", F.col("_s.word")).drop("_s")


def _genbank_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, rec, seq_id, r): each record's text without its sequence; VERSION names it before LOCUS does."""
    told = _genbank_lines(spark, path).where(~F.col("section").eqNullSafe("ORIGIN"))
    parts = told.groupBy("file", "rec").agg(_joined(F.struct("n", F.concat("value", F.lit("\n")).alias("value"))).alias("r")).where(F.col("r").rlike(r"(?m)^LOCUS"))
    locus, version = F.regexp_extract("r", r"(?m)^LOCUS\s+(\S+)", 1), F.regexp_extract("r", r"(?m)^VERSION\s+(\S+)", 1)
    return parts.select("file", "rec", F.when(version != "", version).otherwise(locus).alias("seq_id"), "r")


def read_genbank(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, seq) of GenBank records; a record without a sequence has an empty one."""
    bases = _genbank_lines(spark, path).where(F.col("section").eqNullSafe("ORIGIN") & ~F.startswith("value", F.lit("ORIGIN")))
    seqs = bases.groupBy("file", "rec").agg(_joined(F.struct("n", F.upper(F.regexp_replace("value", "[^A-Za-z]", "")).alias("value"))).alias("seq"))
    return _genbank_records(spark, path).join(seqs, ["file", "rec"], "left").select("seq_id", F.coalesce("seq", F.lit("")).alias("seq"))


def read_reference(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(seq_id, seq) of several files, FASTA or GenBank by their first line; ids that occur twice raise."""
    parts = []
    for p in paths:
        head = spark.read.text(p).where(F.length(F.trim("value")) > 0).limit(1).collect()
        first = head[0].value if head else ">"
        if not first.startswith((">", "LOCUS")):
            raise ValueError(f"{p} is neither FASTA nor GenBank")
        if not head:
            raise ValueError(f"{p} has no records")
        parts.append((read_fasta if first.startswith(">") else read_genbank)(spark, p))
    every = reduce(DataFrame.unionByName, parts)
    twice = [r.seq_id for r in every.groupBy("seq_id").count().where("count > 1").orderBy("seq_id").limit(5).collect()]
    if twice:
        raise ValueError(f"sequence ids occur more than once: {', '.join(twice)}")
    return every


def span_of(location: Column) -> Column:
    """struct(start, end, strand) of a feature location: the least start and greatest end of its parts, -1 for complements."""
    parts = F.regexp_extract_all(location, F.lit(r"[<>]?(\d+)(?:\.\.[<>]?(\d+))?"), F.lit(0))
    numbers = F.transform(F.flatten(F.transform(parts, lambda p: F.regexp_extract_all(p, F.lit(r"\d+"), F.lit(0)))), lambda x: x.cast("long"))
    return F.struct(F.array_min(numbers).alias("start"), F.array_max(numbers).alias("end"), F.when(location.contains("complement"), -1).otherwise(1).alias("strand"))


def _feature_rows(spark: SparkSession, path: str) -> DataFrame:
    table = F.regexp_extract("r", r"(?ms)^FEATURES[^\n]*\n(.*?)(?=^\S|\z)", 1)
    blocks = _genbank_records(spark, path).select("seq_id", F.posexplode(F.split(table, r"\n(?=     \S)")).alias("ord", "b"))
    location = F.regexp_replace(F.regexp_extract("b", r"^\s*\S+\s+([^/]*)", 1), r"\s", "")
    rows = blocks.select("seq_id", "ord", F.regexp_extract("b", r"^\s*(\S+)", 1).alias("feature_type"), span_of(location).alias("s"), "b")
    return rows.select("seq_id", "ord", "feature_type", "s.*", "b").where("start is not null")


def _qualifier(name: str) -> Column:
    """A qualifier's value, its continuation lines joined; null where there is none."""
    text = F.regexp_extract("b", rf'/{name}="([^"]*)"', 1)
    return F.when(F.col("b").contains(f"/{name}="), F.regexp_replace(text, r"\s*\n\s*", " "))


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """Genes, CDS, tRNA and rRNA: (ord, seq_id, start, end, strand, feature_type, locus_tag, gene_name, product)."""
    rows = _feature_rows(spark, path).where(F.col("feature_type").isin("CDS", "tRNA", "rRNA", "gene"))
    return rows.select("ord", "seq_id", "start", "end", "strand", "feature_type", _qualifier("locus_tag").alias("locus_tag"), _qualifier("gene").alias("gene_name"), _qualifier("product").alias("product"))


def read_repeats(spark: SparkSession, path: str) -> DataFrame:
    """Mobile elements and repeats: (ord, seq_id, start, end, strand, name)."""
    rows = _feature_rows(spark, path).where(F.col("feature_type").isin("mobile_element", "repeat_region"))
    element = F.regexp_replace(_qualifier("mobile_element"), "^insertion sequence:", "")
    name = F.coalesce(*(F.when(F.trim(x) != "", F.trim(x)) for x in (element, _qualifier("note"), _qualifier("gene"))), F.lit("repeat"))
    return rows.select("ord", "seq_id", "start", "end", "strand", name.alias("name"))


def _gd_rows(lines: DataFrame, *keep: str) -> DataFrame:
    """Records (keep, kind, id, parent_ids, fields, attrs) of lines (keep, value), with wrong: what is wrong with a line, or null."""
    rows = lines.where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(*keep, F.split("value", "\t").alias("p"))
    kind = F.get("p", F.lit(0))
    arity = F.create_map(*[F.lit(x) for kv in GD_ARITY.items() for x in kv])
    rest = F.slice("p", F.lit(4), F.greatest(F.size("p"), F.lit(1)))
    n = F.try_element_at(arity, kind)
    pairs = F.filter(F.slice(rest, n + 1, F.greatest(F.size("p"), F.lit(1))), lambda x: x.contains("="))
    attrs = F.map_from_entries(F.transform(pairs, lambda x: F.struct(F.substring_index(x, "=", 1).alias("k"), F.regexp_extract(x, "^[^=]*=(.*)$", 1).alias("v"))))
    parents = F.when(F.get("p", F.lit(2)).isin(*NULLS), F.array().cast("array<int>")).otherwise(F.transform(F.split(F.get("p", F.lit(2)), ","), lambda x: x.try_cast("int")))
    id_ = F.get("p", F.lit(1)).try_cast("int")
    right = F.coalesce((n <= F.size(rest)) & id_.isNotNull() & ~F.exists(parents, lambda x: x.isNull()), F.lit(False))
    wrong = F.when(~right, F.concat(F.lit("malformed record: "), F.array_join("p", " ")))
    return rows.select(*keep, kind.alias("kind"), id_.alias("id"), parents.alias("parent_ids"), F.slice(rest, F.lit(1), n).alias("fields"), attrs.alias("attrs"), wrong.alias("wrong"))


def read_gd(spark: SparkSession, path: str) -> DataFrame:
    """Records (ord, kind, id, parent_ids, fields, attrs); comments and metadata are left out, a malformed line raises."""
    lines = _lines(spark, path).select(F.monotonically_increasing_id().alias("ord"), "value")
    rows = _gd_rows(lines, "ord")
    return rows.withColumn("fields", _required(F.col("wrong").isNull(), F.col("fields"), F.col("wrong"))).drop("wrong")


def _files(spark: SparkSession, paths: DataFrame) -> tuple[list[str], DataFrame]:
    """The distinct paths of (clone_id, path), of which a cohort has a few for each clone, and (clone_id, file) as scans name files."""
    rows = paths.select("clone_id", "path").distinct().collect()
    whole = {p: named_file(spark, p) for p in {r.path for r in rows}}
    return sorted(whole), spark.createDataFrame([(r.clone_id, whole[r.path]) for r in rows], "clone_id string, file string")


def named_file(spark: SparkSession, path: str) -> str | None:
    """A file's path as scans name it; null where there is no such file."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return LOCAL.sub("file:/", system.makeQualified(p).toUri().toString()) if system.exists(p) else None


def _file(name: Column) -> Column:
    """A scan's name of a file as named_file has it: a local one with one slash."""
    return F.regexp_replace(name, LOCAL.pattern, "file:/")


def read_gd_of_clones(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """Records of many clones (clone_id, path) in one scan: (clone_id, kind, id, parent_ids, fields, attrs, wrong).

    A malformed line is a row that says so in `wrong`, and stops nothing. A file may be several clones'.
    """
    every, files = _files(spark, paths)
    lines = spark.read.text(every).select(_file(F.col("_metadata.file_path")).alias("file"), F.regexp_replace("value", r"\r$", "").alias("value"))
    return _gd_rows(lines, "file").join(F.broadcast(files), "file").drop("file")


def read_gd_metadata(spark: SparkSession, path: str) -> DataFrame:
    """(ord, key, value) of a record file's metadata lines, in their order; a file that doesn't give its version is of 1.0."""
    text = F.trim(F.substring("value", 3, 1 << 30))
    rows = numbered_lines(spark, path).where(F.startswith("value", F.lit("#="))).select(F.col("n").alias("ord"), F.regexp_extract(text, r"^(\S*)", 1).alias("key"), F.regexp_extract(text, r"^\S*\s*(.*?)\s*$", 1).alias("value"))
    version = spark.createDataFrame([(-1, "GENOME_DIFF", "1.0")], "ord long, key string, value string")
    return rows.unionByName(version.join(rows.where("key = 'GENOME_DIFF'").limit(1).select("key"), "key", "left_anti"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Alignments (qname, flag, contig, start_0, minus, mapq, cigar, seq, qual, score, other_score).

    Secondary ones are left out; the quality counts as 0 where another place scores as well (XS >= AS).
    """
    p = F.split("value", "\t")
    rows = _lines(spark, path).where(~F.col("value").rlike(r"^@[A-Z][A-Z]\t")).select(p.alias("p")).where(F.size("p") >= 11)
    tag = lambda name: F.regexp_extract(F.array_join(F.slice("p", F.lit(12), F.size("p")), "\t"), rf"(?:^|\t){name}:i:(-?\d+)", 1).try_cast("int")
    at = lambda i: F.get("p", F.lit(i))
    out = rows.select(at(0).alias("qname"), at(1).cast("int").alias("flag"), at(2).alias("contig"), (at(3).cast("long") - 1).alias("start_0"), at(4).cast("int").alias("q"), at(5).alias("cigar"), at(9).alias("seq"), at(10).alias("qual"), tag("AS").alias("score"), tag("XS").alias("other_score"))
    out = out.where(F.col("flag").bitwiseAND(0x100) == 0)
    return out.withColumn("minus", F.col("flag").bitwiseAND(0x10) > 0).withColumn("mapq", F.when(F.col("other_score") >= F.col("score"), 0).otherwise(F.col("q"))).drop("q")


def cigar_counts(cigar: Column) -> Column:
    """struct(match, ins, del, query, span): bases by operation, query bases covered, reference bases spanned."""
    ops, sizes = F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2)), F.regexp_extract_all(cigar, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    pairs = F.arrays_zip(ops.alias("o"), sizes.alias("n"))
    total = lambda *kinds: F.aggregate(F.filter(pairs, lambda x: x["o"].isin(*kinds)), F.lit(0).cast("long"), lambda a, x: a + x["n"].cast("long"))
    return F.struct(total("M", "=", "X").alias("match"), total("I").alias("ins"), total("D").alias("del"), total("M", "=", "X", "I").alias("query"), total("M", "=", "X", "D", "N").alias("span"))


def read_fastq(spark: SparkSession, path: str) -> DataFrame:
    """(file, rec, qname, seq, qual): four lines a record, by their number in the file; a file must have whole records."""
    if any(p.strip().lower().endswith((".gz", ".bgz")) for p in path.split(",")):
        raise ValueError(f"{path}: compressed reads are one task each; unpack them first")
    rows = numbered_lines(spark, path).select("file", F.floor(F.col("n") / 4).alias("rec"), (F.col("n") % 4).alias("k"), "value")
    part = lambda k: F.max(F.when(F.col("k") == k, F.col("value")))
    whole = rows.groupBy("file", "rec").agg(part(0).alias("name"), part(1).alias("seq"), part(3).alias("qual"))
    name = _required(F.col("qual").isNotNull() & F.startswith("name", F.lit("@")), F.regexp_extract("name", r"^@(\S+)", 1), F.concat(F.lit("broken record in "), "file"))
    return whole.select("file", "rec", name.alias("qname"), "seq", "qual")


def second_pass_reads(fastq: DataFrame, keep: DataFrame, seen: DataFrame) -> DataFrame:
    """Reads whose name is to be kept, or that no alignment has: keep and seen are tables of names, without /1 and /2."""
    named = fastq.withColumn("_n", F.regexp_replace("qname", "/[12]$", ""))
    k, s = keep.select(F.col("name").alias("_n")).distinct().withColumn("_k", F.lit(1)), seen.select(F.col("name").alias("_n")).distinct().withColumn("_s", F.lit(1))
    return named.join(k, "_n", "left").join(s, "_n", "left").where("_k is not null or _s is null").select(*fastq.columns)


def _table(spark: SparkSession, path: str) -> DataFrame:
    """A tab-separated table with a header; blank lines and lines of # are skipped."""
    return spark.read.csv(path, sep="\t", header=True, comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)


def _first_of(df: DataFrame, *names: str) -> Column:
    """The column with one of the names, whatever its case; null where the table has none."""
    known = {c.lower(): c for c in df.columns}
    found = [F.col(f"`{known[n.lower()]}`") for n in names if n.lower() in known]
    value = F.coalesce(*found) if found else F.lit(None).cast("string")
    return F.when(~value.isin(*NULLS), value)


def read_intended(spark: SparkSession, path: str) -> DataFrame:
    """Declared edits (edit_id, seq_id, start, end, ref, alt, kind); edits without an id get edit_<n>; empty intervals raise."""
    t = _table(spark, path)
    rows = _edits(t.withColumn("_n", F.monotonically_increasing_id() + 1), lambda *names: _first_of(t, *names))
    return rows.withColumn("start", _required(F.col("wrong").isNull(), F.col("start"), F.col("wrong"))).drop("wrong")


def _edits(rows: DataFrame, of: Callable[..., Column], *keep: str) -> DataFrame:
    """Edits of rows numbered by _n, whose columns `of` gives by any of their names; wrong says what is wrong, or is null."""
    start = of("start", "position").try_cast("long")
    told = rows.select(*keep, F.coalesce(of("edit_id"), F.concat(F.lit("edit_"), F.col("_n").cast("string"))).alias("edit_id"), of("seq_id").alias("seq_id"), start.alias("start"), F.coalesce(of("end").try_cast("long"), start).alias("end"), of("ref").alias("ref"), of("alt").alias("alt"), F.lower(of("kind", "gd_type")).alias("kind"))
    ok = F.coalesce((F.col("start") >= 1) & (F.col("end") >= F.col("start")) & F.col("seq_id").isNotNull(), F.lit(False))
    return told.withColumn("wrong", F.when(~ok, "an intended edit has no valid interval"))


def read_intended_of_clones(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """Declared edits of many clones (clone_id, path) in one scan, each file with a header of its own; adds clone_id and wrong.

    A clone's edits are few: they are numbered file by file.
    """
    every, files = _files(spark, paths)
    if not every:
        return spark.createDataFrame([], "clone_id string, edit_id string, seq_id string, start long, end long, ref string, alt string, kind string, wrong string")
    lines = numbered_lines(spark, every).withColumn("file", _file(F.col("file"))).where(~F.startswith("value", F.lit("#")) & (F.trim("value") != ""))
    heads = lines.groupBy("file").agg(F.min("n").alias("_h"), F.min_by("value", "n").alias("_names"))
    rows = lines.join(heads, "file").where("n > _h").withColumn("_n", F.row_number().over(W.partitionBy("file").orderBy("n")))
    names, cells = (F.transform(F.split(F.col(c), "\t"), lambda x: F.trim(x)) for c in ("_names", "value"))
    filled = F.zip_with(F.transform(names, lambda x: F.lower(x)), F.slice(cells, F.lit(1), F.size(names)), lambda k, v: F.struct(k.alias("k"), v.alias("v")))
    rows = rows.withColumn("_m", F.map_from_entries(filled))

    def of(*names: str) -> Column:
        value = F.coalesce(*(F.try_element_at("_m", F.lit(x)) for x in names))
        return F.when(~value.isin(*NULLS), value)

    return _edits(rows, of, "file").join(F.broadcast(files), "file").drop("file")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Clones (clone_id, r1, r2, intended_tsv, spacer, pam); ragged rows, missing files of reads and repeated ids raise."""
    lines = [line for r in _lines(spark, path).collect() if (line := r.value).strip() and not line.startswith("#")]
    head, rows = lines[0].split("\t"), [x.split("\t") for x in lines[1:]]
    if not {"clone_id", "r1"} <= set(head):
        raise ValueError("a manifest needs clone_id and r1")
    if ragged := [i for i, r in enumerate(rows, 2) if len(r) != len(head)]:
        raise ValueError(f"line {ragged[0]} has another number of columns")
    table = [{k: None if v.strip() in NULLS else v.strip() for k, v in zip(head, r)} for r in rows]
    ids = [t["clone_id"] for t in table]
    if None in ids or len(set(ids)) < len(ids) or any(not t["r1"] for t in table):
        raise ValueError("clone ids must be unique, and every clone needs r1")
    names = ["clone_id", "r1", "r2", "intended_tsv", "spacer", "pam"]
    return spark.createDataFrame([tuple(t.get(n) for n in names) for t in table], ", ".join(f"{n} string" for n in names))


def strict_gd(records: DataFrame, kinds: tuple[str, ...] = (), attributes: bool = True) -> DataFrame:
    """Records as a comparison wants them: of some kinds (all if none are given), with or without attributes, none rejected."""
    out = records.where(F.col("kind").isin(*kinds)) if kinds else records
    out = out.where(~F.map_contains_key("attrs", "reject"))
    return out if attributes else out.withColumn("attrs", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))


def beside(path: str | None, manifest: str) -> str | None:
    """A path of a manifest, which counts from the manifest's folder unless it is absolute or has a scheme."""
    return path if path is None or "://" in path else os.path.join(os.path.dirname(manifest), path)


#: Columns of a site, 1-based and closed, as all readers of search tools return them.
SITE = ("guide", "seq_id", "start", "end", "strand", "target", "mismatches", "bulge_type", "bulge_size", "score_cfd", "score_hsu")


def _site(df: DataFrame, **c: Column) -> DataFrame:
    kinds = {"start": "long", "end": "long", "mismatches": "int", "bulge_size": "int", "score_cfd": "double", "score_hsu": "double"}
    return df.select(*(c.get(n, F.lit(None)).cast(kinds.get(n, "string")).alias(n) for n in SITE))


def read_sites_v2(spark: SparkSession, path: str) -> DataFrame:
    """Six columns without a header, 0-based starts; with a seventh and eighth, type and size of a bulge."""
    p = F.split("value", "\t")
    rows = _lines(spark, path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(p.alias("p"))
    at = lambda i: F.get("p", F.lit(i))
    length = F.length(F.regexp_replace(at(3), "[-]", ""))
    return _site(rows, guide=at(0), seq_id=F.regexp_extract(at(1), r"^(\S+)", 1), start=at(2).cast("long") + 1, end=at(2).cast("long") + length, strand=at(4), target=F.upper(at(3)), mismatches=at(5), bulge_type=F.coalesce(F.lower(at(6)), F.lit("none")), bulge_size=F.coalesce(at(7).cast("int"), F.lit(0)))


def read_sites(spark: SparkSession, path: str, layout: str = "v2") -> DataFrame:
    """Sites of a search tool by the layout of its table: v2 and v3 (columns by position), half_open or closed (by name)."""
    known = {"v2": read_sites_v2, "v3": read_sites_v2, "half_open": read_sites_half_open, "closed": read_sites_closed}
    if layout not in known:
        raise ValueError(f"layout {layout!r}: one of {', '.join(known)}")
    return known[layout](spark, path)


def second_pass_names(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(keep, seen), tables of name, of all alignments of a SAM file: names that are aligned again, and all names."""
    from helixframe.operators.junctions import flagged_reads

    p = F.split("value", "\t")
    rows = _lines(spark, path).where(~F.col("value").rlike(r"^@[A-Z][A-Z]\t")).select(p.alias("p")).where(F.size("p") >= 11)
    rows = rows.select(F.get("p", F.lit(0)).alias("qname"), F.get("p", F.lit(1)).cast("int").alias("flag"), F.get("p", F.lit(5)).alias("cigar")).where(F.col("flag").bitwiseAND(0x100) == 0)
    marked = flagged_reads(rows)
    return marked.where("second_pass").select("name").distinct(), marked.select("name").distinct()


def read_sites_half_open(spark: SparkSession, path: str) -> DataFrame:
    """A header with aliases, half-open intervals, orientation FWD or RVS, scores NA where missing."""
    t = _table(spark, path)
    start = _first_of(t, "start").cast("long") + 1
    strand = F.when(F.upper(_first_of(t, "orientation", "strand")).isin("FWD", "+"), "+").otherwise("-")
    return _site(t, guide=_first_of(t, "guide", "spacer"), seq_id=_first_of(t, "contig", "chr", "chrom"), start=start, end=_first_of(t, "stop", "end").cast("long"), strand=strand, target=F.upper(_first_of(t, "target", "sequence")), mismatches=_first_of(t, "numberOfMismatches", "mismatches"), bulge_type=F.lit("none"), bulge_size=F.lit(0), score_cfd=_first_of(t, "Doench2016CFDScore", "cfd").try_cast("double"), score_hsu=_first_of(t, "Hsu2013", "hsu").try_cast("double"))


def read_sites_closed(spark: SparkSession, path: str) -> DataFrame:
    """A header with aliases, 1-based closed intervals, bulges and scores where given."""
    t = _table(spark, path)
    start = _first_of(t, "position", "start", "pos").cast("long")
    target = F.upper(_first_of(t, "target", "dna"))
    end = F.coalesce(_first_of(t, "stop", "end").cast("long"), start + F.length(F.regexp_replace(target, "-", "")) - 1)
    return _site(t, guide=_first_of(t, "guide", "crrna"), seq_id=_first_of(t, "chr", "chromosome", "contig"), start=start, end=end, strand=_first_of(t, "strand", "direction"), target=target, mismatches=_first_of(t, "mismatches", "mm"), bulge_type=F.coalesce(F.lower(_first_of(t, "bulge_type")), F.lit("none")), bulge_size=F.coalesce(_first_of(t, "bulge_size").cast("int"), F.lit(0)), score_cfd=_first_of(t, "cfd").try_cast("double"))


def elapsed_seconds(text: Column) -> Column:
    """Seconds of h:mm:ss or m:ss.ff."""
    parts = F.reverse(F.split(text, ":"))
    return F.aggregate(F.transform(parts, lambda x, i: x.try_cast("double") * F.pow(F.lit(60.0), i)), F.lit(0.0), lambda a, x: a + x)


def read_time(spark: SparkSession, path: str) -> DataFrame:
    """(file, seconds, peak_kb) of /usr/bin/time -v reports."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    return rows.select("file", elapsed_seconds(F.regexp_extract("value", r"Elapsed \(wall clock\) time[^\n]*: ([\d:.]+)", 1)).alias("seconds"), F.regexp_extract("value", r"Maximum resident set size \(kbytes\): (\d+)", 1).try_cast("long").alias("peak_kb"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(key, value) of tab-separated metric files."""
    return _lines(spark, path).where(F.col("value").contains("\t")).select(F.substring_index("value", "\t", 1).alias("key"), F.regexp_extract("value", r"^[^\t]*\t(.*)$", 1).alias("value"))
