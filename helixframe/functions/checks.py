"""Checks of what users give, labels of results, and small driver-side helpers."""

from __future__ import annotations

import hashlib
import os
import re
import shutil
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labels of results: fixed values, by what they are about.
LABELS = {
    "editor": ("cas9", "cas12a", "dsb"),
    "origin": ("EDITED_ONLY", "SHARED", "STARTER_ONLY"),
    "relation": ("EXPECTED", "UNEXPECTED", "UNRELATED"),
    "size": ("SMALL", "STRUCTURAL"),
    "guide": ("NONE", "ON_TARGET", "CANDIDATE_OFF_TARGET"),
    "priority": ("HIGH", "MEDIUM", "LOW"),
    "status": ("COMPLETE", "PARTIAL", "MISSING", "UNEXPECTED_STRUCTURE"),
    "search": ("NOT_PERFORMED", "NO_CANDIDATES", "WITH_CANDIDATES"),
    "recurrence": ("clone_specific", "shared_subset", "shared_all"),
}
_CLONE = re.compile(r"[A-Za-z0-9][A-Za-z0-9_.-]*")


def spacer(text: str) -> str:
    """A guide's spacer in upper case; raises on letters other than A, C, G, T and N, U among them."""
    s = text.strip().upper()
    if not s or set(s) - set("ACGTN"):
        raise ValueError(f"spacer {text!r}: only A, C, G, T and N are bases here")
    return s


def pam(text: str) -> str:
    """A PAM in upper case; raises on what isn't an IUPAC code."""
    s = text.strip().upper()
    if not s or set(s) - set("ACGTRYSWKMBDHVN"):
        raise ValueError(f"PAM {text!r}: not IUPAC codes")
    return s


def editor(text: str) -> str:
    if text.lower() not in LABELS["editor"]:
        raise ValueError(f"editor {text!r}: one of {', '.join(LABELS['editor'])}")
    return text.lower()


def clone_id(text: str) -> str:
    if not _CLONE.fullmatch(text):
        raise ValueError(f"clone id {text!r}: letters, digits, _, . and - only, no sign first")
    return text


def within(name: str, value: float, low: float, high: float) -> float:
    if not low <= value <= high:
        raise ValueError(f"{name} is {value}; it lies between {low} and {high}")
    return value


def read_files(first: str, second: str | None) -> tuple[str, str | None]:
    """Paths of read files; raises if one is missing or both are the same."""
    if second is not None and os.path.realpath(first) == os.path.realpath(second):
        raise ValueError(f"{first} is given for both mates")
    for p in filter(None, (first, second)):
        if not os.path.isfile(p):
            raise ValueError(f"no file {p}")
    return first, second


def search_status(performed: bool, candidates: int) -> str:
    """Whether sites were searched for and any found."""
    return LABELS["search"][0 if not performed else 2 if candidates else 1]


def utc_now() -> str:
    return datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def file_sha256(path: str) -> str:
    """SHA-256 of a file on the driver, read in pieces."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def sha256_of(spark, paths: str) -> DataFrame:
    """(path, sha256) of files that Spark reads, one file a row."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))


def program(name: str) -> str | None:
    """Path of a program: the variable <NAME>_PATH, else the search path."""
    given = os.environ.get(f"{name.upper().replace('-', '_')}_PATH")
    return given if given and Path(given).is_file() else shutil.which(name)


def event_problem(kind: Column, pos: Column, size: Column, length: Column, alleles: Column, strand: Column) -> Column:
    """What is wrong with an event's place, span, bases or strand on a contig of a length, or null; the first problem counts."""
    return (
        F.when(length.isNull(), "unknown sequence")
        .when(pos.isNull() | (pos < 1), "position below 1")
        .when(pos > length, "position beyond the sequence")
        .when(size.isNotNull() & ((size < 1) | (pos + size - 1 > length)), "span beyond the sequence")
        .when(alleles.isNotNull() & ~F.upper(alleles).rlike("^[ACGTN]+$"), "letters that aren't bases")
        .when(kind.isin("JC", "MOB") & ~F.coalesce(strand.isin("1", "-1"), F.lit(False)), "no strand")
    )


def checked(events: DataFrame, problem: Column) -> DataFrame:
    """events, in whose plan the first row with a problem stops the job with that problem and the event's id."""
    return events.withColumn("_ok", F.when(problem.isNotNull(), F.raise_error(F.concat_ws(": ", F.col("event_id").cast("string"), problem)).cast("boolean")).otherwise(True)).where("_ok").drop("_ok")
