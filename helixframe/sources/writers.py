"""Sinks: the domain's text formats from DataFrames, and publication of a set of files at once."""

from __future__ import annotations

import os
import shutil
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: Most lines of a table that the driver puts into one file.
LINES = 1_000_000


def _text(x: Column, missing: str) -> Column:
    return F.coalesce(x.cast("string"), F.lit(missing))


def gd_lines(records: DataFrame) -> DataFrame:
    """(ord, value): records (kind, id, parent_ids, fields, attrs) as tab-separated lines, attributes in order of their keys."""
    parents = F.when(F.size("parent_ids") > 0, F.array_join("parent_ids", ",")).otherwise(".")
    attrs = F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return records.select("ord", F.array_join(F.concat(F.array("kind", F.col("id").cast("string"), parents), "fields", attrs), "\t").alias("value"))


def gd_metadata_lines(metadata: DataFrame) -> DataFrame:
    """(ord, value): metadata (ord, key, value) as the lines that go before all records; a key without a value stands alone."""
    return metadata.select("ord", F.concat(F.lit("#="), "key", F.when(F.coalesce("value", F.lit("")) != "", F.concat(F.lit("\t"), "value")).otherwise("")).alias("value"))


def gd_text(records: DataFrame, metadata: DataFrame) -> DataFrame:
    """(value): a whole record file's lines in order, metadata first; sorted by ranges, for a text sink."""
    both = gd_metadata_lines(metadata).select(F.lit(0).alias("_part"), "ord", "value").unionByName(gd_lines(records).select(F.lit(1).alias("_part"), "ord", "value"))
    return both.orderBy("_part", "ord").select("value")


def fasta_lines(contigs: DataFrame, width: int = 80) -> DataFrame:
    """(seq_id, value): each sequence with its name and lines of a width."""
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return contigs.select("seq_id", F.concat(F.lit(">"), "seq_id", F.lit("\n"), wrapped).alias("value"))


def tsv_lines(df: DataFrame, columns: dict[str, Column], missing: str = "", keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, value): a table's lines without the header; null as the given text. Formats differ in theirs: '', NA or NONE."""
    return df.select(*keep, F.concat_ws("\t", *(_text(c, missing).alias(n) for n, c in columns.items())).alias("value"))


def exponent(x: Column, digits: int = 3) -> Column:
    """d.ddde-5: scientific notation without padding of the exponent."""
    return F.regexp_replace(F.regexp_replace(F.format_string(f"%.{digits}e", x.cast("double")), r"e([+-])0+(\d)", "e$1$2"), r"e\+", "e")


#: Columns of the table of unintended events.
UNINTENDED = "seq_id position end gd_type ref alt class editor pam_profile offtarget_mismatch distance_to_site side2_seq_id side2_position".split()


def unintended(df: DataFrame, hypothesis: bool = False, event_ids: bool = True, keep: tuple[str, ...] = ()) -> tuple[list[str], DataFrame]:
    """Header and lines of the table of unintended events; empty cells for nulls."""
    names = UNINTENDED + ["hypothesis"] * hypothesis + ["event_id"] * event_ids
    return names, tsv_lines(df, {n: F.col(n) for n in names}, keep=keep)


def sites(df: DataFrame, keep: tuple[str, ...] = ()) -> tuple[list[str], DataFrame]:
    """Header and lines of candidate sites; scores with four decimals, NA where missing."""
    score = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c)))
    plain = ["site_id", "seq_id", "start", "end", "strand", "guide", "target", "pam", "mismatches", "bulge_type", "bulge_size"]
    columns = {n: F.col(n) for n in plain if n in df.columns} | {n: score(n) for n in ("score_cfd", "score_hsu") if n in df.columns}
    return list(columns), tsv_lines(df, columns, "NA", keep)


def subclonal(df: DataFrame) -> tuple[list[str], DataFrame]:
    """Header and lines of evaluated low-frequency alleles: fractions with six decimals, p-values in scientific notation."""
    real = lambda c: F.format_string("%.6f", c)
    keys = [c for c in df.columns if c in ("sample", "contig", "pos", "ref", "alt", "user_id")]
    columns = {c: F.col(c) for c in keys}
    for s in "se":
        columns |= {f"depth_{s}": F.col(f"depth_{s}"), f"alt_{s}": F.col(f"alt_{s}"), f"af_{s}": real(F.col(f"af_{s}")), f"low_{s}": real(F.col(f"ci_{s}.low")), f"high_{s}": real(F.col(f"ci_{s}.high")), f"q_error_{s}": exponent(F.col(f"q_error_{s}"))}
    columns |= {"delta": real(F.col("change.delta")), "delta_low": real(F.col("change.low")), "delta_high": real(F.col("change.high")), "p_diff": exponent(F.col("p_diff")), "q_diff": exponent(F.col("q_diff")), "class": F.col("class"), "flags": F.when(F.size("flags") > 0, F.array_join("flags", ";"))}
    return list(columns), tsv_lines(df, columns, "NA")


def report(title: str, sections: dict[str, DataFrame | str], most: int = 200) -> str:
    """A Markdown report of small tables; a table over `most` rows is counted and cut, and says so."""
    out = [f"# {title}"]
    for k, (name, body) in enumerate(sections.items(), 1):
        out += ["", f"## {k}. {name}", ""]
        if isinstance(body, str):
            out.append(body)
            continue
        rows = body.limit(most + 1).collect()
        out += ["| " + " | ".join(body.columns) + " |", "|" + "---|" * len(body.columns)]
        out += ["| " + " | ".join("NA" if x is None else str(x) for x in r) + " |" for r in rows[:most]]
        if len(rows) > most:
            out.append(f"\nThe first {most} of {body.count()} rows.")
    return "\n".join(out) + "\n"


def by_clone(lines: DataFrame, header: list[str], clones: DataFrame, out: str) -> None:
    """Writes lines (clone_id, value) as text by clone into a folder; each of the clones has its header, with lines or without."""
    heads = clones.select("clone_id", F.lit(0).alias("_k"), F.lit("\t".join(header)).alias("value"))
    both = heads.unionByName(lines.select("clone_id", F.lit(1).alias("_k"), "value"))
    ordered = both.repartition("clone_id").sortWithinPartitions("clone_id", "_k", "value")
    ordered.select("clone_id", "value").write.mode("overwrite").partitionBy("clone_id").text(out)


def publish(folder: str, files: dict[str, str]) -> None:
    """Puts files (name to text) into a local folder together: staged beside it, swapped by rename, put back on failure."""
    target = Path(folder)
    target.parent.mkdir(parents=True, exist_ok=True)
    mark = uuid.uuid4().hex[:8]
    stage, backup = target.with_name(f".{target.name}.stage-{mark}"), target.with_name(f".{target.name}.old-{mark}")
    stage.mkdir()
    try:
        for name, text in files.items():
            (stage / name).write_text(text)
            if (stage / name).stat().st_size != len(text.encode()):
                raise OSError(f"{name} was not written whole")
        if target.exists():
            os.rename(target, backup)
        try:
            os.rename(stage, target)
        except OSError:
            if backup.exists():
                os.rename(backup, target)
            raise
    finally:
        shutil.rmtree(stage, ignore_errors=True)
        shutil.rmtree(backup, ignore_errors=True)


def rendered(table: tuple[list[str], DataFrame], order: list[str] | None = None) -> str:
    """A table of at most LINES lines as text, with its header; a longer one is an error, as it belongs into a folder of files."""
    names, lines = table
    rows = lines.limit(LINES + 1).collect()
    if len(rows) > LINES:
        raise ValueError(f"over {LINES} lines: write the table itself")
    return "\n".join(["\t".join(names), *sorted(r.value for r in rows)]) + "\n"
