"""Junctions that are one: seen in both directions, or placed on several copies of a repeat."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from helixframe.operators import segments
from helixframe.operators.components import connected_components
from helixframe.operators.constructs import KEY
from helixframe.operators.elements import element_end
from helixframe.operators.emission import TERMINUS_REACH, TERMINUS_SLACK, with_repeat
from helixframe.operators.junctions import clusters
from helixframe.plans.session import cut

#: Reads by which copies may differ and still count as equally supported.
TIE_GAP = 2
_SUPPORT = ("reads", "plus", "minus", "best_min", "best_min_plus", "best_min_minus", "min_side1", "min_side2")


def seed_candidates(clustered: DataFrame) -> DataFrame:
    """Clustered split reads (id, KEY, cluster) to candidates: the first member's coordinates, and how many reads there are."""
    first = F.min_by(F.struct(*KEY), F.struct((F.col("id") != F.col("cluster")).alias("other"), "id"))
    return clustered.groupBy("cluster").agg(first.alias("k"), F.count("*").alias("seed_reads")).select("k.*", "seed_reads")


def _merged(groups) -> DataFrame:
    """Sums, bests and least known sides of the support of a group's junctions."""
    known = lambda c: F.coalesce(F.min(F.when(F.col(c) > 0, F.col(c))), F.lit(0)).alias(c)
    shown = F.max_by(F.struct("id", *KEY), F.struct("reads", "seed_reads", (-F.col("id")).alias("first")))
    return groups.agg(
        shown.alias("shown"), *(F.sum(c).alias(c) for c in _SUPPORT[:3]), *(F.max(c).alias(c) for c in _SUPPORT[3:6]), known("min_side1"), known("min_side2"), F.max("seed_reads").alias("seed_reads"), F.array_sort(F.collect_set("id")).alias("ids")
    )


def fold_directions(junctions: DataFrame) -> DataFrame:
    """Junctions (id, KEY, support columns, seed_reads) seen from either side within TERMINUS_SLACK as one each.

    Sides are compared with the lesser one first, strands as they are. The one with most reads, then seeds, then the
    least id gives the coordinates; reads are summed, bests kept, unknown sides of 0 don't count. Adds ids.
    """
    swap = F.struct("seq_id1", "pos1", "minus1") > F.struct("seq_id2", "pos2", "minus2")
    side = {f"_{c}{n}": F.when(swap, F.col(f"{c}{3 - n}")).otherwise(F.col(f"{c}{n}")) for n in (1, 2) for c in ("seq_id", "pos", "minus")}
    keyed = junctions.withColumns(side)
    grouped = clusters(keyed, ["_seq_id1", "_minus1", "_seq_id2", "_minus2"], "_pos1", "_pos2", "id", TERMINUS_SLACK)
    return _merged(grouped.groupBy("cluster")).select("shown.*", *_SUPPORT, "seed_reads", "ids")


def displayed_copies(alternatives: DataFrame, by: list[str]) -> DataFrame:
    """The copy of a repeat that a junction is shown at: of those within TIE_GAP reads of the best supported, by place first.

    alternatives has reads, seed_reads, outside (the side lies just outside the copy's end, so the shared bases are
    known) and distance (to the copy's end, null if unknown), and id. Outside comes first, then the least distance, most
    reads, most seeds, the least id.
    """
    near = alternatives.withColumn("_most", F.max("reads").over(W.partitionBy(*by))).where(F.col("reads") + TIE_GAP >= F.col("_most")).drop("_most")
    order = F.struct((~F.col("outside")).alias("a"), F.col("distance").isNull().alias("b"), F.coalesce("distance", F.lit(0)).alias("c"), (-F.col("reads")).alias("d"), (-F.col("seed_reads")).alias("e"), "id")
    names = [c for c in alternatives.columns if c not in by]
    return near.groupBy(*by).agg(F.min_by(F.struct(*names), order).alias("_x")).select(*by, "_x.*")


def _annotated(junctions: DataFrame, repeats: DataFrame, contigs: DataFrame) -> DataFrame:
    """Adds locus1 and locus2, where in an element a side lies (null: in none), whether it is in or at one, outside and distance.

    A locus is the element's name, the offset from its start in its own direction, and its end, 5 or 3, if the side
    enters it there. outside: a side lies up to TERMINUS_SLACK beyond its copy's start. distance: between a side outside
    all copies and one at a copy's end of the same contig, around the circle; null for other pairs.
    """
    rows = junctions
    for k in "12":
        rows = with_repeat(rows, repeats, "id", f"seq_id{k}", f"pos{k}", f"_t{k}", TERMINUS_REACH)
        rows = with_repeat(rows, repeats, "id", f"seq_id{k}", f"pos{k}", f"_i{k}")
    new: dict[str, Column] = {}
    for k in "12":
        copy, pos = F.coalesce(f"_t{k}", f"_i{k}"), F.col(f"pos{k}")
        offset = F.when(copy["strand"] >= 0, pos - copy["start"]).otherwise(copy["end"] - pos)
        new[f"locus{k}"] = F.when(copy.isNotNull(), F.struct(copy["name"].alias("name"), offset.alias("offset"), element_end(copy, pos, F.col(f"minus{k}")).alias("end")))
    short = lambda k: F.coalesce(F.when(F.col(f"_t{k}.strand") >= 0, (F.col(f"_t{k}.start") - F.col(f"pos{k}")).between(1, TERMINUS_SLACK)).otherwise((F.col(f"pos{k}") - F.col(f"_t{k}.end")).between(1, TERMINUS_SLACK)), F.lit(False))
    unique = lambda k: F.col(f"_t{k}").isNull() & F.col(f"_i{k}").isNull()
    apart = F.abs(F.col("pos1") - F.col("pos2"))
    pair = (F.col("seq_id1") == F.col("seq_id2")) & (F.col("_t1").isNotNull() & unique("2") | F.col("_t2").isNotNull() & unique("1"))
    rows = rows.join(contigs.select(F.col("seq_id").alias("seq_id1"), F.length("seq").alias("_n")), "seq_id1", "left")
    return rows.withColumns(new | {"outside": short("1") | short("2"), "distance": F.when(pair, F.least(apart, F.coalesce(F.col("_n") - apart, apart)))}).select(*junctions.columns, "locus1", "locus2", "outside", "distance")


class _Family:
    """Placements of one junction: the one that is shown, and what all show together."""

    def __init__(self, row: dict):
        self.shown, self.members = row, [row["id"]]
        self.ids, self.cigar, self.seeds = set(row["ids"]), row["has_cigar"], row["seed_reads"]
        self.support = {c: row[c] for c in _SUPPORT}

    @staticmethod
    def sides(row: dict) -> list[tuple]:
        return [(row[f"seq_id{k}"], row[f"pos{k}"], row[f"minus{k}"], row[f"locus{k}"]) for k in "12"]

    def admits(self, row: dict) -> bool:
        """Whether a junction is shown to be this one: the shared side, the overlap and the element's end agree, and so does the evidence."""
        alike = lambda x, y: x[0] == y[0] and x[2] == y[2] and abs(x[1] - y[1]) <= TERMINUS_SLACK
        ours, theirs = self.sides(self.shown), self.sides(row)
        common = [x for x in ours if any(alike(x, y) for y in theirs)]
        a, b = self.shown["overlap"], row["overlap"]
        if self.cigar and row["has_cigar"] or not common or (a > 0) - (a < 0) != (b > 0) - (b < 0) or abs(a - b) > TERMINUS_SLACK:
            return False
        mine = [x[3] for x in ours if not any(alike(x, y) for y in theirs)]
        other = [y[3] for y in theirs if not any(alike(x, y) for x in ours)]
        one_each = len(mine) == 1 and len(other) == 1
        if one_each:
            p, q = mine[0], other[0]
            if (p is None) != (q is None):
                return False
            same_end = p is not None and p["name"] == q["name"] and (p["end"] == q["end"] if p["end"] or q["end"] else abs(p["offset"] - q["offset"]) <= TERMINUS_SLACK)
            if p is not None and not same_end:
                return False
        elif (len(mine) == 1) != (len(other) == 1):
            return False
        read_by_both = len(self.ids & set(row["ids"]))
        if 2 * read_by_both > min(len(self.ids), len(row["ids"])) > 0:
            return True
        return one_each and mine[0] is not None and bool(mine[0]["end"]) and any(x[3] is None for x in common)

    def better(self, row: dict) -> bool:
        """Whether a member is to be shown instead: support beyond a tie, then a side just outside a copy, then the nearer one, then support and seeds."""
        now = self.shown
        most = max(row["reads"], now["reads"])
        ahead = [r["reads"] + TIE_GAP >= most for r in (row, now)]
        if ahead[0] != ahead[1]:
            return ahead[0]
        if row["outside"] != now["outside"]:
            return row["outside"]
        if row["distance"] is not None and now["distance"] is not None and row["distance"] != now["distance"]:
            return row["distance"] < now["distance"]
        return (row["reads"], row["seed_reads"]) > (now["reads"], now["seed_reads"])

    def add(self, row: dict) -> None:
        """Takes a member in; reads that were there already count once, in proportion where only some were."""
        new = _Family(row)
        kept, come = (new, self) if self.better(row) else (self, new)
        fresh, n = len(come.ids - kept.ids), len(come.ids)
        share = (1, 1) if fresh == n else (fresh, n)
        for c in ("plus", "minus"):
            kept.support[c] += come.support[c] * share[0] // share[1]
        for c in ("best_min", "best_min_plus", "best_min_minus"):
            kept.support[c] = max(kept.support[c], come.support[c])
        for c in ("min_side1", "min_side2"):
            kept.support[c] = min((x for x in (kept.support[c], come.support[c]) if x), default=0)
        self.shown, self.support = kept.shown, kept.support
        self.ids |= new.ids
        self.cigar, self.seeds, self.members = self.cigar or new.cigar, max(self.seeds, new.seeds), self.members + new.members


def fold_copies(junctions: DataFrame, repeats: DataFrame, contigs: DataFrame) -> DataFrame:
    """Junctions (id, KEY, support columns, seed_reads, ids, has_cigar) placed on several copies of a repeat as one each.

    In order of their sides, each joins the first family whose shown member it is equivalent to, else begins one. The
    equivalence isn't transitive, so the order counts; but members share a side within TERMINUS_SLACK with one another,
    so components over stretches of sides part the work, and each is one sequential pass. Returns the shown member's id
    and KEY, merged support, seed_reads, ids, and members. Null positions share no side; an empty table gives none.
    """
    marked = cut(_annotated(junctions.withColumn("reads", F.col("plus") + F.col("minus")), repeats, contigs))
    sides = marked.select("id", F.explode(F.array(*(F.struct(F.col(f"seq_id{k}").alias("seq_id"), F.col(f"pos{k}").alias("pos"), F.col(f"minus{k}").alias("minus")) for k in "12"))).alias("s")).select("id", "s.*")
    near = segments.stretches(sides, ["seq_id", "minus"], "pos", TERMINUS_SLACK)
    links = near.join(near.groupBy("seq_id", "minus", "stretch").agg(F.min("id").alias("b")), ["seq_id", "minus", "stretch"]).select(F.col("id").alias("a"), "b")
    parts = marked.join(connected_components(links).withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    kinds = dict(junctions.dtypes)
    names = ["id", *KEY, *_SUPPORT, "seed_reads", "ids", "members"]
    schema = ", ".join(f"`{c}` {kinds.get(c, 'array<long>' if c == 'members' else 'long')}" for c in names)

    def folded(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.astype(object).where(pdf.notna(), None).to_dict("records")
        families: list[_Family] = []
        for row in sorted(rows, key=lambda r: (*sorted(s[:3] for s in _Family.sides(r)), r["id"])):
            found = next((f for f in families if f.admits(row)), None)
            if found:
                found.add(row)
            else:
                families.append(_Family(row))
        out = [{**{c: f.shown[c] for c in ("id", *KEY)}, **f.support, "reads": f.support["plus"] + f.support["minus"], "seed_reads": f.seeds, "ids": sorted(f.ids), "members": sorted(f.members)} for f in families]
        return pd.DataFrame(out, columns=names)

    return parts.groupBy("root").applyInPandas(folded, schema)
