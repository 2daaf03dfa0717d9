"""Content-addressed event identities: a binary preimage of what changed, hashed with SHA-256."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: the number of each kind in a preimage.
KIND_NUMBER = {"SNP": 1, "SUB": 2, "INS": 3, "DEL": 4, "MOB": 5, "AMP": 6, "CON": 7, "INV": 8, "JC": 9}
#: The default domain of ids; ids of different domains never meet.
DOMAIN = b"helixframe-ev1"
#: Between a sample's name and an id of its own, where many samples share a table; neither holds it.
SCOPE = "\x1f"


def scoped(*names: Column | str) -> Column:
    """An id within a sample's, which no other sample has."""
    return F.concat_ws(SCOPE, *names)


def scope(x: Column | str) -> Column:
    """The sample of a scoped id; null for ids without one."""
    x = F.col(x) if isinstance(x, str) else x
    return F.when(x.contains(SCOPE), F.substring_index(x, SCOPE, 1))


def bare(x: Column | str) -> Column:
    """A scoped id without its sample; other ids as they are."""
    return F.substring_index(x, SCOPE, -1)


def all_bare(text: Column | str) -> Column:
    """A text without the samples of any ids in it, which begin after a comma, a tab or nothing."""
    return F.regexp_replace(text, f"[^\\t,]*{SCOPE}", "")


def scoped_fields(sample: Column | str, kind: Column, fields: Column) -> Column:
    """Fields of a record with its sequences' ids scoped: its first field, and a junction's fourth."""
    return F.transform(fields, lambda x, i: F.when((i == 0) | ((i == 3) & (kind == "JC")), scoped(sample, x)).otherwise(x))


def big_endian(x: Column, width: int = 8) -> Column:
    """A number as so many bytes; negative ones in two's complement."""
    return F.unhex(F.right(F.lpad(F.hex(x.cast("long")), 16, "0"), F.lit(2 * width)))


def sized(x: Column) -> Column:
    """UTF-8 bytes after their number, as 4 bytes."""
    raw = F.encode(x, "UTF-8")
    return F.concat(big_endian(F.octet_length(raw), 4), raw)


def contig(seq_id: Column, sha256: Column) -> Column:
    """A sequence by name and by content (its SHA-256, as hex)."""
    return F.concat(sized(seq_id), F.unhex(sha256))


def strand_byte(strand: Column) -> Column:
    """01 for the forward strand, 02 for the reverse."""
    return F.when(strand.isin("1", "+", "+1"), F.unhex(F.lit("01"))).when(strand.isin("-1", "-"), F.unhex(F.lit("02")))


def preimage(kind: Column, parts: dict[str, list[Column]], domain: bytes = DOMAIN) -> Column:
    """domain, the kind's number, then the kind's parts, each already bytes; null for other kinds."""
    out = None
    for name, columns in parts.items():
        bytes_ = reduce(F.concat, [F.unhex(F.lit(domain.hex())), F.unhex(F.lit(f"{KIND_NUMBER[name]:02x}")), *columns])
        out = F.when(kind == name, bytes_) if out is None else out.when(kind == name, bytes_)
    return out


def event_preimage(kind: Column, fields: Column, sha: Column, sha2: Column | None = None, domain: bytes = DOMAIN) -> Column:
    """The preimage of a record from its positional fields and the SHA-256 of its sequence (and, for junctions, of the second).

    Sides of a junction are put in order first, by sequence, position and strand, so either way of writing it has one id.
    """
    text = lambda i: F.get(fields, F.lit(i))
    number = lambda i: big_endian(text(i).try_cast("long"))
    where = [contig(text(0), sha), number(1)]
    second = sha if sha2 is None else sha2
    one = F.struct(text(0).alias("s"), sha.alias("h"), text(1).try_cast("long").alias("p"), strand_byte(text(2)).alias("t"))
    two = F.struct(text(3).alias("s"), second.alias("h"), text(4).try_cast("long").alias("p"), strand_byte(text(5)).alias("t"))
    low, high = F.least(one, two), F.greatest(one, two)
    side = lambda x: [contig(x["s"], x["h"]), big_endian(x["p"]), x["t"]]
    return preimage(
        kind,
        {
            "SNP": [*where, F.encode(text(2), "UTF-8")],
            "SUB": [*where, number(2), sized(text(3))],
            "INS": [*where, sized(text(2))],
            "DEL": [*where, number(2)],
            "MOB": [*where, sized(text(2)), strand_byte(text(3)), number(4)],
            "AMP": [*where, number(2), number(3)],
            "CON": [*where, number(2), sized(text(3))],
            "INV": [*where, number(2)],
            "JC": [*side(low), *side(high), big_endian(text(6).try_cast("long"))],
        },
        domain,
    )


def event_id(image: Column, version: str = "DV1") -> Column:
    """version_ and the first 16 bytes of the preimage's SHA-256, in hex."""
    return F.concat(F.lit(f"{version}_"), F.substring(F.sha2(image, 256), 1, 32))


def collisions(events: DataFrame, id_column: str = "event_id", image: str = "preimage") -> DataFrame:
    """Ids that stand for more than one preimage; empty unless the hash fails."""
    return events.groupBy(id_column).agg(F.min(image).alias("least"), F.max(image).alias("most")).where("least <> most").select(id_column)
