"""Queries over the driver's tables, one per operator family, each with DuckDB SQL for the same rows.

The tables have no reads or genomes, so each query gives an operator a view of them in the operator's shape: orders are
intervals, users are sequences, halves of a month are samples, letters of texts are bases.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.functions import identity, sequence, statistics
from helixframe.functions.identity import all_bare, bare, scope
from helixframe.operators import classify, cohort, constructs, differential, emission, families, intended, intervals, junctions, pileup, review, sites, subclonal
from helixframe.plans import evidence, gates
from helixframe.plans.audit import Audit, audit, audit_clones
from helixframe.plans.session import cut
from helixframe.sources import products

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "audit_summary"


def query(sql: str | None = None):
    """Registers a query under its function's name, and its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(c):
    return F.unix_timestamp(c).cast("long")


def _day(c):
    return F.unix_date(F.to_date(c)).cast("long")


# --- differences ------------------------------------------------------------------------------------------------------


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def subtract_exact_set(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    return differential.subtract_set(o.where("o_orderstatus = 'F'").select("o_custkey").distinct(), o.where("o_orderstatus = 'O'"), ["o_custkey"])


@query("SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'F' EXCEPT ALL SELECT o_custkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'")
def subtract_multiset(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    keys = ["o_custkey", "o_orderpriority"]
    return differential.subtract_multiset(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'"), keys, ["o_orderkey"]).select(*keys)


@query(
    "SELECT l_partkey, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS ship_day, min((l_quantity, l_orderkey, l_linenumber))[1] AS quantity, min((l_quantity, l_orderkey, l_linenumber))[2] AS orderkey, "
    "array_to_string(list_sort(list(DISTINCT l_orderkey)), ',') AS ids FROM lineitem GROUP BY ALL"
)
def coalesce_groups(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").withColumn("ship_day", _day("l_shipdate"))
    out = differential.coalesce_events(rows, ["l_partkey", "ship_day"], ["l_quantity", "l_orderkey", "l_linenumber"], "l_orderkey")
    return out.select("l_partkey", "ship_day", F.col("l_quantity").alias("quantity"), F.col("l_orderkey").alias("orderkey"), F.array_join("ids", ",").alias("ids"))


def _tolerant(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type", _seconds("ts").alias("at"))
    return differential.tolerant_candidates(e.where("event_type = 'purchase'").drop("event_type"), e.where("event_type = 'click'").drop("event_type"), ["user_id"], "at", tolerance=7200)


_CANDIDATES = (
    "WITH e AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events), c AS (SELECT a.event_id AS edited_id, b.event_id AS starter_id, abs(a.at - b.at) AS d "
    "FROM e a JOIN e b USING (user_id) WHERE a.event_type = 'purchase' AND b.event_type = 'click' AND abs(a.at - b.at) <= 7200) "
)


@query(_CANDIDATES + "SELECT edited_id, starter_id, d AS max_delta, d AS sum_delta FROM c")
def tolerant_band_candidates(spark, sf_dir):
    return _tolerant(spark, sf_dir)


@query(
    _CANDIDATES + "SELECT m.edited_id, m.starter_id FROM (SELECT edited_id, starter_id, row_number() OVER (PARTITION BY edited_id ORDER BY d, starter_id) AS r FROM c) m "
    "JOIN (SELECT edited_id, starter_id, row_number() OVER (PARTITION BY starter_id ORDER BY d, edited_id) AS r FROM c) t ON m.edited_id = t.edited_id AND m.starter_id = t.starter_id WHERE m.r = 1 AND t.r = 1"
)
def mutual_nearest_pairs(spark, sf_dir):
    return differential.mutual_nearest(_tolerant(spark, sf_dir))


@query(_CANDIDATES + "SELECT edited_id, starter_id, count(*) OVER (PARTITION BY edited_id) AS edited_degree, count(*) OVER (PARTITION BY starter_id) AS starter_degree FROM c")
def candidate_multiplicity(spark, sf_dir):
    return differential.multiplicity(_tolerant(spark, sf_dir)).select("edited_id", "starter_id", "edited_degree", "starter_degree")


@query()
def tolerant_one_to_one(spark, sf_dir):
    """Cheapest maximum matching of the candidates by user; a search, tested against all matchings of small graphs."""
    c = _tolerant(spark, sf_dir)
    users = _t(spark, sf_dir, "events").select(F.col("event_id").alias("edited_id"), "user_id")
    return differential.one_to_one(c.join(users, "edited_id"), ["user_id"])


@query(
    "SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'only_a' ELSE 'only_b' END AS side FROM (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT') a "
    "FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '5-LOW') b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL"
)
def key_leftovers(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderpriority")
    return cohort.leftovers(o.where("o_orderpriority = '1-URGENT'"), o.where("o_orderpriority = '5-LOW'"), ["k"])


@query("SELECT count(*) AS missing FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer))")
def referential_gate(spark, sf_dir):
    return differential.missing_references(_t(spark, sf_dir, "orders"), "o_custkey", _t(spark, sf_dir, "customer"), "c_custkey").agg(F.count("*").alias("missing"))


# --- intervals and runs -----------------------------------------------------------------------------------------------


def _order_spans(spark, sf_dir):
    """Orders as intervals from the order's day to its last shipment's."""
    ship = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max(_day("l_shipdate")).alias("ship"))
    o = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("key"), _day("o_orderdate").alias("a"))
    return o.join(ship, "o_orderkey").select("o_orderkey", "key", F.least("a", "ship").alias("a"), F.greatest("a", "ship").alias("b"))


_SPANS = (
    "WITH s AS (SELECT o_orderkey, o_custkey AS key, least(a, ship) AS a, greatest(a, ship) AS b FROM (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS a FROM orders) "
    "JOIN (SELECT l_orderkey AS o_orderkey, max(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE))) AS ship FROM lineitem GROUP BY 1) USING (o_orderkey)) "
)


def _pairs(spark, sf_dir, within):
    s = _order_spans(spark, sf_dir)
    other = s.select(F.col("o_orderkey").alias("other"), "key", F.col("a").alias("c"), F.col("b").alias("d"))
    return intervals.window_join(s, other, ["key"], ("a", "b"), ("c", "d"), within, 64).where("o_orderkey < other")


@query(_SPANS + "SELECT x.o_orderkey, y.o_orderkey AS other FROM s x JOIN s y ON x.key = y.key AND x.a <= y.b AND y.a <= x.b AND x.o_orderkey < y.o_orderkey")
def interval_overlap(spark, sf_dir):
    return _pairs(spark, sf_dir, 0).select("o_orderkey", "other")


@query(_SPANS + "SELECT x.o_orderkey, y.o_orderkey AS other, greatest(0, x.a - y.b, y.a - x.b) AS distance FROM s x JOIN s y ON x.key = y.key AND greatest(0, x.a - y.b, y.a - x.b) <= 50 AND x.o_orderkey < y.o_orderkey")
def window_association(spark, sf_dir):
    return _pairs(spark, sf_dir, 50).select("o_orderkey", "other", "distance")


@query(
    _SPANS + "SELECT o_orderkey, other, distance FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY distance, other) AS r FROM (SELECT x.o_orderkey, y.o_orderkey AS other, "
    "greatest(0, x.a - y.b, y.a - x.b) AS distance FROM s x JOIN s y ON x.key = y.key AND greatest(0, x.a - y.b, y.a - x.b) <= 50 AND x.o_orderkey < y.o_orderkey)) WHERE r = 1"
)
def primary_association(spark, sf_dir):
    pairs = _pairs(spark, sf_dir, 50).select("o_orderkey", "other", "distance")
    return intervals.best_of(pairs, ["o_orderkey"], [F.col("distance"), F.col("other")])


@query(
    "WITH p AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS at FROM events WHERE event_type = 'purchase'), f AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) AS at, CAST(event_id AS VARCHAR) AS name FROM events WHERE event_type = 'view') "
    "SELECT event_id, coalesce(up_end, -1) AS up_end, coalesce(down_start, -1) AS down_start FROM (SELECT p.event_id, max(f.at) FILTER (f.at < p.at) AS up_end, min(f.at) FILTER (f.at > p.at) AS down_start FROM p LEFT JOIN f USING (user_id) GROUP BY 1)"
)
def nearest_feature_updown(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", "user_id", "event_type", _seconds("ts").alias("at"))
    p = e.where("event_type = 'purchase'").select("event_id", "user_id", "at")
    f = e.where("event_type = 'view'").select("user_id", "at", F.col("at").alias("stop"), F.col("event_id").alias("name"))
    return intervals.nearest(p, f, ["user_id"], "at", "at", "stop", "name").select("event_id", *(F.coalesce(c, F.lit(-1)).alias(c) for c in ("up_end", "down_start")))


def _hours(spark, sf_dir):
    """Events of each user by hour, dense between each user's first and last."""
    e = _t(spark, sf_dir, "events").select("user_id", F.floor(_seconds("ts") / 21600).alias("pos"))
    counts = e.groupBy("user_id", "pos").agg(F.count("*").alias("unique_depth"))
    bounds = e.groupBy("user_id").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
    return intervals.dense(counts, ["user_id"], "pos", bounds, ["unique_depth"])


_HOURS = (
    "WITH e AS (SELECT user_id, CAST(floor(epoch(ts)) AS BIGINT) // 21600 AS pos FROM events), d AS (SELECT x.user_id, x.pos, coalesce(c.n, 0) AS depth FROM (SELECT user_id, unnest(range(min(pos), max(pos) + 1)) AS pos FROM e GROUP BY user_id) x "
    "LEFT JOIN (SELECT user_id, pos, count(*) AS n FROM e GROUP BY ALL) c ON x.user_id = c.user_id AND x.pos = c.pos), "
    "cut AS (SELECT user_id, CAST(greatest(2, list_sort(list(depth))[len(list(depth)) // 2 + 1] // 4) AS BIGINT) AS cutoff FROM d WHERE depth > 0 GROUP BY user_id) "
)


@query(_HOURS + "SELECT user_id, pos, depth FROM d")
def dense_axis(spark, sf_dir):
    return _hours(spark, sf_dir).select("user_id", "pos", F.col("unique_depth").alias("depth"))


@query(_HOURS + "SELECT user_id, cutoff FROM cut")
def coverage_cutoff(spark, sf_dir):
    return intervals.coverage_cutoff(_hours(spark, sf_dir), ["user_id"])


@query(
    _HOURS + "SELECT user_id, start_0, end_0 FROM (SELECT user_id, isl, min(pos) FILTER (depth = 0) AS start_0, max(pos) + 1 AS end_0 FROM (SELECT d.user_id, pos, depth, cutoff, "
    "count(*) FILTER (depth >= cutoff) OVER (PARTITION BY d.user_id ORDER BY pos) AS isl FROM d JOIN cut ON d.user_id = cut.user_id) WHERE depth < cutoff GROUP BY user_id, isl) WHERE end_0 - start_0 >= 3"
)
def missing_coverage_islands(spark, sf_dir):
    d = _hours(spark, sf_dir)
    return intervals.missing_coverage(d, ["user_id"], "pos", intervals.coverage_cutoff(d, ["user_id"]), 3)


@query(
    _SPANS + ", u AS (SELECT key, a AS pos, 1 AS d FROM s UNION ALL SELECT key, b + 1, -1 FROM s) SELECT key, pos, CAST(sum(sum(d)) OVER (PARTITION BY key ORDER BY pos) AS BIGINT) AS depth FROM u GROUP BY key, pos"
)
def depth_events(spark, sf_dir):
    return intervals.depth_of(_order_spans(spark, sf_dir), ["key"], "a", "b")


@query(
    "SELECT l_orderkey, l_returnflag, min(l_linenumber) AS first_line, max(l_linenumber) AS last_line, count(*) AS n FROM (SELECT l_orderkey, l_returnflag, l_linenumber, "
    "l_linenumber - row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS run FROM (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber FROM lineitem)) GROUP BY l_orderkey, l_returnflag, run"
)
def adjacent_run_merge(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber").distinct()
    runs = intervals.adjacent_runs(rows, ["l_orderkey", "l_returnflag"], "l_linenumber")
    return runs.groupBy("l_orderkey", "l_returnflag", "run").agg(F.min("l_linenumber").alias("first_line"), F.max("l_linenumber").alias("last_line"), F.count("*").alias("n")).drop("run")


# --- pileup and calls -------------------------------------------------------------------------------------------------

_LETTER = "CASE WHEN l_returnflag = 'R' THEN 'C' WHEN l_returnflag = 'A' THEN 'A' WHEN l_tax > 0.04 THEN '-' ELSE 'G' END"


def _columns(spark, sf_dir):
    """Line items as observations: the part is the position, the return flag the base, the line status the strand."""
    return _t(spark, sf_dir, "lineitem").select("l_partkey", F.expr(_LETTER).alias("base"), (F.col("l_linestatus") == "F").alias("minus"), F.lit("A").alias("ref"))


_CALLS = (
    f"WITH o AS (SELECT l_partkey, {_LETTER} AS base, l_linestatus = 'F' AS minus FROM lineitem), c AS (SELECT l_partkey, base, count(*) AS n, count(*) FILTER (NOT minus) AS f FROM o GROUP BY ALL), "
    "t AS (SELECT l_partkey, sum(n) AS depth, sum(f) AS plus FROM c GROUP BY 1), b AS (SELECT c.*, depth, plus, row_number() OVER (PARTITION BY c.l_partkey ORDER BY n DESC, "
    "CASE base WHEN '-' THEN 0 WHEN 'G' THEN 2 WHEN 'C' THEN 3 ELSE 4 END) AS r FROM c JOIN t ON c.l_partkey = t.l_partkey), "
    "k AS (SELECT l_partkey, CAST(depth AS BIGINT) AS depth, n, base, CASE WHEN depth < 5 THEN 'insufficient' WHEN n / depth < 0.4 OR base = 'A' THEN 'ref' WHEN plus > 0 AND depth > plus AND (f = 0 OR f = n) THEN 'strand_bias' "
    "WHEN base = '-' THEN 'del' ELSE 'snp' END AS call FROM b WHERE r = 1) "
)


@query(_CALLS + "SELECT l_partkey, call, CASE WHEN call IN ('snp', 'del') THEN base END AS alt, depth, CASE WHEN call IN ('snp', 'del') THEN n END AS support, round(CASE WHEN call IN ('snp', 'del') THEN n / depth END, 9) AS frequency FROM k")
def consensus_call(spark, sf_dir):
    calls = pileup.base_consensus(_columns(spark, sf_dir), ["l_partkey"], "base", F.col("minus"), "ref", 5, 0.4)
    return calls.withColumn("frequency", F.round("frequency", 9))


@query(
    _CALLS + "SELECT kind, n, count(*) AS runs FROM (SELECT CASE WHEN call = 'del' THEN 'DEL' WHEN count(*) = 1 THEN 'SNP' ELSE 'SUB' END AS kind, count(*) AS n FROM (SELECT l_partkey, call, run, CASE WHEN call = 'del' THEN (row_number() OVER "
    "(PARTITION BY call, run ORDER BY l_partkey) - 1) // 2 ELSE 0 END AS part FROM (SELECT l_partkey, call, l_partkey - row_number() OVER (PARTITION BY call ORDER BY l_partkey) AS run FROM k WHERE call IN ('snp', 'del'))) GROUP BY call, run, part) GROUP BY kind, n"
)
def merged_call_runs(spark, sf_dir):
    calls = pileup.base_consensus(_columns(spark, sf_dir), ["l_partkey"], "base", F.col("minus"), "ref", 5, 0.4)
    merged = pileup.merged_calls(calls.withColumn("chrom", F.lit("p")), ["chrom"], "l_partkey")
    return merged.groupBy("kind", F.col("size").alias("n")).agg(F.count("*").alias("runs"))


@query(
    "WITH d AS (SELECT user_id, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS day, count(*) AS total, count(*) FILTER (event_type = 'error') AS wrong FROM events GROUP BY ALL), "
    "w AS (SELECT *, sum(total) OVER r - total AS n, sum(wrong) OVER r - wrong AS bad FROM d WINDOW r AS (PARTITION BY user_id ORDER BY day RANGE BETWEEN 5 PRECEDING AND 5 FOLLOWING)) "
    "SELECT user_id, day, round(CASE WHEN n >= 10 THEN bad / n ELSE 0.005 END, 9) AS error_rate FROM w"
)
def local_error_window(spark, sf_dir):
    d = _t(spark, sf_dir, "events").groupBy("user_id", _day("ts").alias("day")).agg(F.count("*").alias("total"), F.count_if(F.col("event_type") == "error").alias("wrong"))
    return pileup.local_error(d, ["user_id"], "day", "wrong", "total", 5, 10).select("user_id", "day", F.round("error_rate", 9).alias("error_rate"))


# --- statistics -------------------------------------------------------------------------------------------------------


def _counts(spark, sf_dir):
    """Purchases among each user's events in the first (s) and second (e) half of the month."""
    e = _t(spark, sf_dir, "events").withColumn("late", F.dayofmonth("ts") > 15).withColumn("alt", F.col("event_type") == "purchase")
    part = lambda late, alt: F.count_if((F.col("late") == late) & (F.col("alt") == alt))
    return e.groupBy("user_id").agg(part(False, True).alias("alt_s"), part(False, False).alias("ref_s"), part(True, True).alias("alt_e"), part(True, False).alias("ref_e")).withColumns({"depth_s": F.col("alt_s") + F.col("ref_s"), "depth_e": F.col("alt_e") + F.col("ref_e")})


_COUNTS = (
    "WITH c AS (SELECT *, alt_s + ref_s AS depth_s, alt_e + ref_e AS depth_e FROM (SELECT user_id, count(*) FILTER (day(ts) <= 15 AND event_type = 'purchase') AS alt_s, count(*) FILTER (day(ts) <= 15 AND event_type <> 'purchase') AS ref_s, "
    "count(*) FILTER (day(ts) > 15 AND event_type = 'purchase') AS alt_e, count(*) FILTER (day(ts) > 15 AND event_type <> 'purchase') AS ref_e FROM events GROUP BY user_id)) "
)
_Z = "1.959963984540054e0"


def _wilson_sql(a: str, n: str) -> tuple[str, str]:
    zz = f"({_Z} * {_Z})"
    low = f"CASE WHEN {a} = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, (2e0 * {a} + {zz} - 1e0 - {_Z} * sqrt(greatest(0e0, {zz} - 2e0 - 1e0 / {n} + 4e0 * ({a} / {n}) * ({n} - {a} + 1e0)))) / (2e0 * ({n} + {zz})))) END"
    high = f"CASE WHEN {a} = {n} THEN 1e0 ELSE greatest(0e0, least(1e0, (2e0 * {a} + {zz} + 1e0 + {_Z} * sqrt(greatest(0e0, {zz} + 2e0 - 1e0 / {n} + 4e0 * ({a} / {n}) * ({n} - {a} - 1e0)))) / (2e0 * ({n} + {zz})))) END"
    return low, high


_LS, _HS = _wilson_sql("CAST(alt_s AS DOUBLE)", "CAST(depth_s AS DOUBLE)")
_LE, _HE = _wilson_sql("CAST(alt_e AS DOUBLE)", "CAST(depth_e AS DOUBLE)")
_CI = _COUNTS + f", w AS (SELECT *, alt_s / depth_s AS af_s, alt_e / depth_e AS af_e, {_LS} AS ls, {_HS} AS hs, {_LE} AS le, {_HE} AS he FROM c WHERE depth_s > 0 AND depth_e > 0) "


@query(_COUNTS + "SELECT user_id, alt_s, ref_s, alt_e, ref_e FROM c")
def allele_counts(spark, sf_dir):
    return _counts(spark, sf_dir).select("user_id", "alt_s", "ref_s", "alt_e", "ref_e")


@query(_CI + "SELECT user_id, round(le, 9) AS low, round(he, 9) AS high FROM w")
def wilson_ci(spark, sf_dir):
    c = _counts(spark, sf_dir).where("depth_s > 0 and depth_e > 0").withColumn("ci", statistics.wilson(F.col("alt_e"), F.col("depth_e")))
    return c.select("user_id", F.round("ci.low", 9).alias("low"), F.round("ci.high", 9).alias("high"))


@query(_CI + "SELECT user_id, round(af_e - af_s, 9) AS delta, round(greatest(-1e0, af_e - af_s - sqrt((af_e - le) * (af_e - le) + (hs - af_s) * (hs - af_s))), 9) AS low, round(least(1e0, af_e - af_s + sqrt((he - af_e) * (he - af_e) + (af_s - ls) * (af_s - ls))), 9) AS high FROM w")
def newcombe_delta(spark, sf_dir):
    c = _counts(spark, sf_dir).where("depth_s > 0 and depth_e > 0")
    ci = lambda s: statistics.wilson(F.col(f"alt_{s}"), F.col(f"depth_{s}"))
    af = lambda s: F.col(f"alt_{s}").cast("double") / F.col(f"depth_{s}")
    c = c.withColumns({"ci_e": ci("e"), "ci_s": ci("s")}).withColumn("d", statistics.newcombe(af("e"), F.col("ci_e"), af("s"), F.col("ci_s")))
    return c.select("user_id", *(F.round(f"d.{x}", 9).alias(x) for x in ("delta", "low", "high")))


def _choose(n: str, k: str) -> str:
    return f"(lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1))"


@query(
    _COUNTS + ", x AS (SELECT user_id, alt_e + alt_s AS m, depth_e AS r, depth_s AS q, alt_e AS a, unnest(range(greatest(0, alt_e + alt_s - depth_s), least(depth_e, alt_e + alt_s) + 1)) AS k FROM c), "
    f"p AS (SELECT *, exp({_choose('r', 'k')} + {_choose('q', '(m - k)')} - {_choose('(r + q)', 'm')}) AS p, exp({_choose('r', 'a')} + {_choose('q', '(m - a)')} - {_choose('(r + q)', 'm')}) AS o FROM x) "
    "SELECT user_id, round(CASE WHEN min(r) = 0 OR min(q) = 0 OR min(m) = 0 OR min(r + q - m) = 0 THEN 1e0 ELSE least(1e0, sum(p) FILTER (p <= o * (1 + 1e-7))) END, 7) AS p FROM p GROUP BY user_id"
)
def fisher_exact(spark, sf_dir):
    c = _counts(spark, sf_dir)
    return c.select("user_id", F.round(statistics.fisher_exact("alt_e", "ref_e", "alt_s", "ref_s"), 7).alias("p"))


@query(
    _COUNTS + f", x AS (SELECT user_id, depth_e AS n, unnest(range(alt_e, depth_e + 1)) AS k FROM c WHERE depth_e > 0) SELECT user_id, round(least(1e0, sum(exp({_choose('n', 'k')} + k * ln(0.15e0) + (n - k) * ln(0.85e0)))), 7) AS p FROM x GROUP BY user_id"
)
def binom_tail(spark, sf_dir):
    c = _counts(spark, sf_dir).where("depth_e > 0")
    return c.select("user_id", F.round(statistics.binomial_tail("alt_e", "depth_e", F.lit(0.15)), 7).alias("p"))


@query("WITH p AS (SELECT o_orderkey, (o_orderkey * 7919 % 1009 + 1) / 1010 AS p FROM orders), r AS (SELECT *, rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1 AS k, count(*) OVER () AS m FROM p) SELECT o_orderkey, round(min(least(1e0, p * m / k)) OVER (ORDER BY p DESC), 9) AS q FROM r")
def bh_fdr(spark, sf_dir):
    p = _t(spark, sf_dir, "orders").select("o_orderkey", ((F.col("o_orderkey") * 7919 % 1009 + 1).cast("double") / 1010).alias("p"))
    return statistics.benjamini_hochberg(p, "p", "q").select("o_orderkey", F.round("q", 9).alias("q"))


def _q_sql(p: str, q: str) -> str:
    """q-values of a column of table v, as a column of its rows."""
    return f"min(least(1e0, {p} * {p}_m / {p}_k)) OVER (ORDER BY {p} DESC) AS {q}"


def _rank_sql(p: str) -> str:
    return f"rank() OVER (ORDER BY {p}) + count(*) OVER (PARTITION BY {p}) - 1 AS {p}_k, count(*) OVER () AS {p}_m"


def _tail_sql(s: str) -> str:
    return (
        f"b{s} AS (SELECT user_id, least(1e0, coalesce(sum(exp({_choose('n', 'k')} + k * ln(0.005e0) + (n - k) * ln(0.995e0))), 1e0)) AS pe{s} FROM (SELECT user_id, depth_{s} AS n, unnest(range(alt_{s}, depth_{s} + 1)) AS k FROM c WHERE depth_{s} > 0) GROUP BY 1)"
    )


_CLASSES = (
    _COUNTS + ", x AS (SELECT user_id, alt_e + alt_s AS m, depth_e AS r, depth_s AS q, alt_e AS a, unnest(range(greatest(0, alt_e + alt_s - depth_s), least(depth_e, alt_e + alt_s) + 1)) AS k FROM c), "
    f"f AS (SELECT user_id, CASE WHEN min(r) = 0 OR min(q) = 0 OR min(m) = 0 OR min(r + q - m) = 0 THEN 1e0 ELSE least(1e0, sum(p) FILTER (p <= o * (1 + 1e-7))) END AS pd FROM (SELECT *, exp({_choose('r', 'k')} + {_choose('q', '(m - k)')} - {_choose('(r + q)', 'm')}) AS p, exp({_choose('r', 'a')} + {_choose('q', '(m - a)')} - {_choose('(r + q)', 'm')}) AS o FROM x) GROUP BY user_id), "
    + _tail_sql("s") + ", " + _tail_sql("e") + ", "
    f"w AS (SELECT c.*, coalesce(alt_s / nullif(depth_s, 0), 0e0) AS af_s, coalesce(alt_e / nullif(depth_e, 0), 0e0) AS af_e, CASE WHEN depth_s = 0 THEN 0e0 ELSE {_HS} END AS hs, CASE WHEN depth_e = 0 THEN 0e0 ELSE {_LE} END AS le, coalesce(pes, 1e0) AS pes, coalesce(pee, 1e0) AS pee, pd FROM c LEFT JOIN f ON f.user_id = c.user_id LEFT JOIN bs ON bs.user_id = c.user_id LEFT JOIN be ON be.user_id = c.user_id), "
    f"v AS (SELECT *, {_rank_sql('pes')}, {_rank_sql('pee')}, {_rank_sql('pd')} FROM w), u AS (SELECT *, {_q_sql('pes', 'qs')}, {_q_sql('pee', 'qe')}, {_q_sql('pd', 'qd')}, af_e - af_s AS delta, greatest(-1e0, af_e - af_s - sqrt((af_e - le) * (af_e - le) + (hs - af_s) * (hs - af_s))) AS low FROM v), "
    "t AS (SELECT *, depth_s >= 20 AND alt_s >= 3 AND af_s >= 0.05 AND qs <= 0.01 AS ins, depth_e >= 20 AND alt_e >= 3 AND af_e >= 0.05 AND qe <= 0.01 AND af_e <= 0.7499 AS ine, qd <= 0.01 AS differs FROM u) "
    "SELECT class, count(*) AS n FROM (SELECT CASE WHEN ine AND depth_s < 20 THEN 'INDETERMINATE_STARTER_DEPTH' WHEN ine AND NOT ins AND differs AND delta >= 0.05 AND low > 0 THEN 'EDITED_SPECIFIC' WHEN ins AND ine AND differs AND delta >= 0.05 AND low > 0 THEN 'EDITED_ENRICHED' "
    "WHEN ins AND (NOT ine OR NOT differs OR delta < 0.05) THEN CASE WHEN differs AND delta <= -0.05 THEN 'DEPLETED_IN_EDITED' ELSE 'PRE_EXISTING_IN_STARTER' END WHEN ine AND NOT ins AND alt_s >= 1 THEN 'AMBIGUOUS_STARTER_TRACE' ELSE 'NOT_SUBCLONAL' END AS class FROM t) GROUP BY 1"
)


@query(_CLASSES)
def subclonal_classes(spark, sf_dir):
    """Classes of users as alleles."""
    c = _counts(spark, sf_dir)
    wide = c.select("user_id", *(F.col(f"{k}_{s}").alias(f"{k}_fwd_{s}") for k in ("ref", "alt") for s in "se"), *(F.lit(0).cast("long").alias(f"{k}_rev_{s}") for k in ("ref", "alt") for s in "se"), *(F.lit(0).cast("long").alias(f"other_{d}_{s}") for d in ("fwd", "rev") for s in "se"))
    out = subclonal.evaluate(wide)
    return out.groupBy("class").agg(F.count("*").alias("n"))


# --- sequences --------------------------------------------------------------------------------------------------------

#: Letters of texts as bases.
_BASES = ("abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
_DNA_SQL = "translate(regexp_replace(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')"


def _dna(spark, sf_dir, table="documents", ident="doc_id"):
    bases = bytes.maketrans("".join((_BASES[0], _BASES[0].upper())).encode(), (_BASES[1] * 2).encode())
    others = bytes(b for b in range(256) if not chr(b).isascii() or not chr(b).isalpha())

    def run(batches):
        for batch in batches:
            seqs = [None if t is None else t.encode("utf-8", "replace").translate(bases, others).decode("ascii") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(seqs, pa.string())], ["seq_id", "seq"])

    return _t(spark, sf_dir, table).select(F.col(ident).cast("string").alias("seq_id"), "text").mapInArrow(run, "seq_id string, seq string")


@query(f"SELECT CAST(doc_id AS VARCHAR) AS seq_id, reverse(translate({_DNA_SQL}, 'ACGT', 'TGCA')) AS rc, round(len(regexp_replace({_DNA_SQL}, '[^GC]', '', 'g')) / nullif(len({_DNA_SQL}), 0), 9) AS gc FROM documents")
def reverse_complements(spark, sf_dir):
    d = _dna(spark, sf_dir)
    return d.select("seq_id", sequence.reverse_complement("seq").alias("rc"), F.round(sequence.gc_fraction("seq"), 9).alias("gc"))


_GUIDE = "GTACGTTGACATCAGTCCAT"


def _hamming_sql(column: str, guide: str, start: int) -> str:
    return " + ".join(f"CAST(substr({column}, {start + i}, 1) <> '{c}' AS INT)" for i, c in enumerate(guide))


_WINDOWS = f"WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS seq_id, {_DNA_SQL} AS seq FROM documents), w AS (SELECT seq_id, i AS start, substr(seq, i, 23) AS w FROM (SELECT seq_id, seq, unnest(range(1, len(seq) - 21)) AS i FROM d)) "


@query(
    _WINDOWS + f"SELECT seq_id, start, start + 22 AS \"end\", '+' AS strand, substr(w, 1, 20) AS target, substr(w, 21, 3) AS pam, {_hamming_sql('w', _GUIDE, 1)} AS mismatches FROM w WHERE w LIKE '%GG' AND {_hamming_sql('w', _GUIDE, 1)} <= 11 "
    f"UNION ALL SELECT seq_id, start, start + 22, '-', reverse(translate(substr(w, 4, 20), 'ACGT', 'TGCA')), reverse(translate(substr(w, 1, 3), 'ACGT', 'TGCA')), {_hamming_sql('w', 'ATGGACTGATGTCAACGTAC', 4)} FROM w WHERE w LIKE 'CC%' AND {_hamming_sql('w', 'ATGGACTGATGTCAACGTAC', 4)} <= 11"
)
def hamming_scan(spark, sf_dir):
    return sites.scan(_dna(spark, sf_dir), _GUIDE, sites.CAS9, 11)


@query()
def bulge_scan(spark, sf_dir):
    """Sites with bulges; tested against a search of all alignments."""
    return sites.scan_bulges(_dna(spark, sf_dir), _GUIDE, sites.CAS9, 7, 1, 1)


@query(_WINDOWS + "SELECT seq_id, count(*) AS windows, count(*) FILTER (regexp_matches(w, '^[AG][CT][ACG]')) AS fits FROM w GROUP BY 1")
def iupac_filter(spark, sf_dir):
    return sites.fitting(_dna(spark, sf_dir), 23, "RYV")


@query(
    f"WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS seq_id, {_DNA_SQL} AS seq FROM documents), z AS (SELECT {_DNA_SQL} AS seq FROM benchmark), q AS (SELECT DISTINCT substr(seq, i, 20) AS query FROM (SELECT seq, unnest(range(1, len(seq) - 18)) AS i FROM z)), "
    "b AS (SELECT query, query AS s, false AS minus FROM q UNION ALL SELECT query, reverse(translate(query, 'ACGT', 'TGCA')), true FROM q), k AS (SELECT seq_id, i AS start, substr(seq, i, 20) AS s FROM (SELECT seq_id, seq, unnest(range(1, len(seq) - 18)) AS i FROM d)) "
    "SELECT query, seq_id, start, minus FROM b JOIN k USING (s)"
)
def kmer_seed_join(spark, sf_dir):
    """Every 20 letters in a row of a benchmark item, placed in all documents on both strands."""
    seeds = sites.windows(_dna(spark, sf_dir, "benchmark", "item_id"), 20).select(F.col("window").alias("query")).distinct()
    return sites.kmer_placements(seeds, _dna(spark, sf_dir), 20)


@query("SELECT p_partkey, 'EV_' || substr(sha256('part|' || p_partkey || '|' || p_brand || '|' || p_size), 1, 32) AS event_id FROM part")
def event_id_sha256(spark, sf_dir):
    image = F.encode(F.concat_ws("|", F.lit("part"), F.col("p_partkey").cast("string"), "p_brand", F.col("p_size").cast("string")), "UTF-8")
    return _t(spark, sf_dir, "part").select("p_partkey", identity.event_id(image, "EV").alias("event_id"))


# --- junctions, ranks, cohorts ----------------------------------------------------------------------------------------


@query(
    "SELECT l_partkey, count(*) AS reads, count(*) FILTER (l_linestatus <> 'F') AS plus, count(*) FILTER (l_linestatus = 'F') AS minus, max(least(q, d)) AS best_min, coalesce(max(least(q, d)) FILTER (l_linestatus <> 'F'), 0) AS best_min_plus, "
    "coalesce(max(least(q, d)) FILTER (l_linestatus = 'F'), 0) AS best_min_minus, coalesce(min(nullif(q, 0)), 0) AS min_side1, coalesce(min(nullif(d, 0)), 0) AS min_side2 FROM (SELECT l_partkey, l_linestatus, CAST(l_quantity AS BIGINT) AS q, CAST(round(l_discount * 300) AS BIGINT) AS d FROM lineitem) GROUP BY l_partkey"
)
def junction_support(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_partkey", "l_linestatus", F.col("l_quantity").cast("long").alias("q"), F.round(F.col("l_discount") * 300).cast("long").alias("d"))
    return junctions.support(rows, ["l_partkey"], "q", "d", F.col("l_linestatus") == "F")


@query(
    "WITH p AS (SELECT l_orderkey, l_linenumber AS k, CAST(l_quantity AS BIGINT) AS a, CAST(l_quantity AS BIGINT) + l_linenumber * 7 AS b, count(*) OVER (PARTITION BY l_orderkey) AS n, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS r FROM lineitem) "
    "SELECT x.l_orderkey, count(*) AS pairs, count(*) FILTER (greatest(x.b, y.b) - least(x.a, y.a) <= 40) AS near FROM p x JOIN p y ON x.l_orderkey = y.l_orderkey AND x.r < y.r GROUP BY 1"
)
def read_piece_pairs(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("k"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"), F.col("l_quantity").cast("long").alias("a"), (F.col("l_quantity").cast("long") + F.col("l_linenumber") * 7).alias("b"))
    pairs, overflow = junctions.read_pairs(rows, ["l_orderkey"], ["k", "p", "s", "q"])
    near = F.greatest("b", "b_2") - F.least("a", "a_2") <= 40
    # the pieces of a read with many have few shapes: pairs of shapes are counted instead, each as often as it occurs
    shapes = rows.join(overflow, "l_orderkey", "left_semi").groupBy("l_orderkey", "a", "b").agg(F.count("*").alias("n"))
    second = shapes.select("l_orderkey", F.col("a").alias("a_2"), F.col("b").alias("b_2"), F.col("n").alias("n_2"))
    unlike = shapes.join(second, "l_orderkey").where(F.struct("a", "b") < F.struct("a_2", "b_2")).withColumn("times", F.col("n") * F.col("n_2"))
    alike = shapes.withColumns({"a_2": F.col("a"), "b_2": F.col("b"), "times": (F.col("n") * (F.col("n") - 1) / 2).cast("long")})
    counted = [pairs.withColumn("times", F.lit(1).cast("long")), unlike, alike]
    some = [c.groupBy("l_orderkey").agg(F.sum("times").alias("pairs"), F.coalesce(F.sum(F.when(near, F.col("times"))), F.lit(0)).alias("near")) for c in counted]
    return some[0].union(some[1]).union(some[2]).groupBy("l_orderkey").agg(F.sum("pairs").alias("pairs"), F.sum("near").alias("near"))


_SHAPES_SQL = """
WITH p AS (
  SELECT l_partkey AS q, CASE WHEN l_linenumber % 2 = 1 THEN 0 ELSE 40 END AS a, CASE WHEN l_linenumber % 2 = 1 THEN 40 + l_linenumber % 3 ELSE 100 END AS b, l_returnflag = 'R' AS rev, l_linestatus AS c, l_suppkey * 7 AS s, count(*) OVER (PARTITION BY l_partkey) AS n FROM lineitem
), f AS (
  SELECT q, a, b, rev, list({'c': c, 's': s} ORDER BY c, s) AS copies, count(*) AS n FROM p WHERE n > 20 GROUP BY q, a, b, rev
), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY a, b, rev) AS k, count(*) OVER (PARTITION BY q) AS m FROM f),
x AS (
  SELECT y.q, y.b - z.a AS overlap, y.n AS na, z.n AS nb, CASE WHEN y.n = 1 THEN z.copies ELSE y.copies END AS many,
         CASE WHEN y.n = 1 THEN list_filter(z.copies, lambda v: NOT (v.c = y.copies[1].c AND NOT y.rev AND NOT z.rev AND y.copies[1].s + (y.b - y.a) = v.s AND y.b = z.a))
              ELSE list_filter(y.copies, lambda v: NOT (v.c = z.copies[1].c AND NOT y.rev AND NOT z.rev AND v.s + (y.b - y.a) = z.copies[1].s AND y.b = z.a)) END AS kept
  FROM r y JOIN r z ON y.q = z.q AND y.k < z.k WHERE y.m * (y.m - 1) / 2 <= 28 AND y.a = 0 AND z.b = 100 AND (y.n > 1 OR z.n > 1)
), s AS (
  SELECT q, CASE WHEN na > 1 AND nb > 1 THEN 'BOTH_SIDES_MULTICOPY' WHEN len(kept) = 0 THEN 'TRIVIAL_CONTINUATION_ONLY' ELSE '' END AS rejection, overlap, CASE WHEN na > 1 AND nb > 1 THEN na + nb ELSE len(many) END AS places, CASE WHEN na > 1 AND nb > 1 THEN 0 ELSE len(kept) END AS eligible FROM x
  UNION ALL SELECT q, 'RESOURCE_LIMIT_STAGE2_FAMILY_GEOMETRY', 0, m, 0 FROM r WHERE k = 1 AND m * (m - 1) / 2 > 28
)
SELECT q AS l_partkey, rejection, CAST(overlap AS BIGINT) AS overlap, count(*) AS seeds, CAST(sum(places) AS BIGINT) AS places, CAST(sum(eligible) AS BIGINT) AS eligible FROM s GROUP BY 1, 2, 3"""


@query(_SHAPES_SQL)
def family_pair_seeds(spark, sf_dir):
    """Order lines as pieces of reads, a part's lines a read: parts with over 20 lines are paired by families of pieces, those with over 28 pairs of families stop at the limit."""
    odd = F.col("l_linenumber") % 2 == 1
    pieces = _t(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("qname"), F.lit(1).alias("mate"), F.col("l_linestatus").alias("seq_id"), (F.col("l_suppkey") * 7).alias("start"), F.when(odd, 0).otherwise(40).alias("read_start"), F.when(odd, 40 + F.col("l_linenumber") % 3).otherwise(100).alias("read_end"), F.lit(100).alias("read_len"), (F.col("l_returnflag") == "R").alias("reverse"),
    ).withColumn("span", F.col("read_end") - F.col("read_start"))
    contigs = pieces.select("seq_id", F.lit("A").alias("seq")).distinct()
    repeats = contigs.select("seq_id", F.lit(1).alias("start"), F.lit(70).alias("end"), F.lit(1).alias("strand"), F.lit("r").alias("name"), F.lit(0).alias("ord"))
    seeds, _ = families.family_seeds(pieces, repeats, contigs, 20, 28)
    part = F.element_at(F.split(F.regexp_replace("id", ":.*", ""), ":"), 1).cast("long").alias("l_partkey")
    return seeds.groupBy(part, F.coalesce("rejection", F.lit("")).alias("rejection"), "overlap").agg(F.count("*").alias("seeds"), F.sum("placement_count").alias("places"), F.sum(F.size("eligible")).cast("long").alias("eligible"))


_FAMILY_SQL = """
WITH s AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS id, l_orderkey AS mol, l_partkey AS p, l_linestatus = 'F' AS m, CAST(l_quantity AS BIGINT) AS al, 5 + l_linenumber * 4 AS cl, l_returnflag AS g, l_partkey % 24 < 18 AS anchored,
         CASE WHEN l_partkey % 24 < 9 THEN [xor(l_partkey, 1), l_partkey + 100000] ELSE [l_partkey + 100000, l_partkey + 200000] END AS e, NOT (l_partkey % 24 >= 21 AND l_quantity >= 48) AS complete, l_partkey // 2 AS fam FROM lineitem
), b AS (SELECT fam, bool_or(NOT complete) AS bad FROM s GROUP BY fam),
t AS (SELECT s.*, CASE WHEN bad THEN 'RESOURCE_LIMIT_INCOMPLETE_FAMILY' END AS lim FROM s JOIN b USING (fam)),
x AS (SELECT id AS oi, mol AS om, p AS op, g, unnest(e) AS place FROM t WHERE lim IS NULL AND anchored),
h AS (SELECT place, count(*) AS n FROM x GROUP BY 1),
u AS (SELECT t.*, CASE WHEN lim IS NULL AND anchored AND coalesce(n, 0) > 36 THEN 'RESOURCE_LIMIT_RECIPROCAL_CANDIDATES' ELSE lim END AS lim2, n FROM t LEFT JOIN h ON h.place = t.p),
v AS (SELECT u.id, min(x.op) AS copy, arg_min(x.om, x.oi) AS who FROM u JOIN x ON x.place = u.p AND x.g = u.g AND x.oi <> u.id AND x.om <> u.mol AND list_contains(u.e, x.op) WHERE u.lim2 IS NULL AND u.anchored GROUP BY u.id HAVING min(x.op) = max(x.op)),
w AS (SELECT u.*, CASE WHEN lim2 IS NOT NULL THEN [] WHEN v.copy IS NOT NULL THEN [v.copy] ELSE e END AS e2, v.who FROM u LEFT JOIN v USING (id)),
k AS (SELECT *, CASE WHEN lim2 IS NULL AND anchored THEN e2 ELSE [] END AS kc, CASE WHEN lim2 IS NULL AND anchored THEN -1 ELSE fam END AS kf FROM w),
m AS (SELECT p, kc, kf, mol, arg_min(m, (m::INT * 1000 + cl) * 1000 + al) AS minus, max(al) AS al, max(cl) AS cl, bool_and(anchored) AS anchored, count(lim2) AS lims, list(who) FILTER (who IS NOT NULL) AS bys, list(e2) AS es FROM k GROUP BY 1, 2, 3, 4),
f AS (
  SELECT p, kc, kf, list_distinct(flatten(flatten(list(es)))) AS copies, count(*) AS molecules, count(*) FILTER (NOT minus) AS plus, count(*) FILTER (minus) AS minus, max(least(al, cl)) AS best, coalesce(max(least(al, cl)) FILTER (NOT minus), 0) AS bp, coalesce(max(least(al, cl)) FILTER (minus), 0) AS bm,
         min(al) AS s1, min(cl) AS s2, bool_and(anchored) AS anchored, sum(lims) AS lims, list(mol) AS mols, flatten(list(bys) FILTER (bys IS NOT NULL)) AS bys FROM m GROUP BY 1, 2, 3
), q AS (SELECT *, anchored AND plus > 0 AND minus > 0 AND best >= 14 AND bp >= 9 AND bm >= 9 AND least(s1, s2) >= 3 AS good FROM f)
SELECT p AS l_partkey, CASE WHEN lims > 0 THEN 'RESOURCE_LIMIT' WHEN len(copies) = 1 AND good AND len(list_filter(bys, lambda y: NOT list_contains(mols, y))) > 0 THEN 'RESOLVED' WHEN len(copies) > 1 AND good THEN 'SUPPORTED_AMBIGUOUS' ELSE 'CANDIDATE' END AS state,
       CAST(len(copies) AS INTEGER) AS feasible, molecules, plus, minus, best AS best_min, coalesce(list_max(copies), 0) AS last_copy FROM q"""


@query(_FAMILY_SQL)
def repeat_families(spark, sf_dir):
    """Order lines as seeds anchored at their part: other parts are copies, some of which name each other, and parts with large quantities are incomplete."""
    part = F.col("l_partkey")
    place = lambda p: F.struct(F.lit("c").alias("seq_id"), p.cast("long").alias("pos"), F.lit(False).alias("minus"))
    eligible = F.when(part % 24 < 9, F.array(place(part.bitwiseXOR(F.lit(1))), place(part + 100000))).otherwise(F.array(place(part + 100000), place(part + 200000)))
    seeds = _t(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("id"), F.lit("STAGE2_MOSAIC").alias("source"), place(part).alias("anchor"), eligible.alias("observed"), eligible.alias("eligible"), F.lit(2).cast("long").alias("placement_count"), F.floor(part / 2).cast("string").alias("family"),
        (~((part % 24 >= 21) & (F.col("l_quantity") >= 48))).alias("complete"), F.lit(0).cast("long").alias("overlap"), F.col("l_orderkey").alias("molecule"), (F.col("l_linestatus") == "F").alias("molecule_minus"), (5 + F.col("l_linenumber") * 4).cast("long").alias("clip_length"), F.col("l_quantity").cast("long").alias("aligned_length"),
        F.lit(0).alias("mapq"), F.lit(None).cast("int").alias("score"), F.col("l_returnflag").alias("geometry"), (part % 24 < 18).alias("anchored"), F.lit(None).cast("string").alias("rejection"), F.lit(None).cast("string").alias("limit"),
    )
    out = families.repeat_families(seeds, 2**40, 36)
    return out.select(F.col("anchor.pos").alias("l_partkey"), "state", F.size("feasible").alias("feasible"), "molecules", "plus", "minus", F.col("best_min"), F.coalesce(F.array_max(F.transform("feasible", lambda x: x["pos"])), F.lit(0)).alias("last_copy"))


@query(
    "WITH s AS (SELECT o_custkey, o_orderkey, 1 + o_orderkey % 3 AS seeds, CAST(floor(o_totalprice) AS BIGINT) AS len FROM orders), t AS (SELECT *, max(seeds) OVER (PARTITION BY o_custkey) AS mx FROM s), "
    "r AS (SELECT *, row_number() OVER w AS rank, CAST(sum(len) OVER w AS BIGINT) AS total FROM t WHERE mx < 2 OR seeds >= 2 WINDOW w AS (PARTITION BY o_custkey ORDER BY seeds DESC, o_orderkey ROWS UNBOUNDED PRECEDING)), "
    "f AS (SELECT *, max(CASE WHEN rank > 1 AND (rank > 5 OR total > 600000) THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY rank) AS stop FROM r) SELECT o_custkey, o_orderkey, rank, total FROM f WHERE stop = 0"
)
def rank_and_cap(spark, sf_dir):
    s = _t(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (1 + F.col("o_orderkey") % 3).alias("seeds"), F.floor("o_totalprice").alias("len"))
    out = junctions.rank_and_cap(s, ["o_custkey"], "seeds", "len", ["o_orderkey"], F.lit(600000), 5)
    return out.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"), "total")


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority DESC) AS r FROM orders) WHERE r = 1")
def best_score_ties(spark, sf_dir):
    return junctions.best_with_ties(_t(spark, sf_dir, "orders"), ["o_custkey"], "o_orderpriority").select("o_custkey", "o_orderkey", "o_orderpriority")


@query("SELECT user_id, count(DISTINCT event_type) AS n_clones, CASE WHEN count(DISTINCT event_type) = 1 THEN 'clone_specific' WHEN count(DISTINCT event_type) = 5 THEN 'shared_all' ELSE 'shared_subset' END AS scope FROM events GROUP BY 1")
def recurrence(spark, sf_dir):
    return cohort.recurrence(_t(spark, sf_dir, "events"), "user_id", "event_type", 5)


@query("SELECT user_id, " + ", ".join(f"CAST(max(CASE WHEN event_type = '{c}' THEN 1 ELSE 0 END) AS INTEGER) AS clone_{c}" for c in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1")
def recurrence_matrix(spark, sf_dir):
    return cohort.presence_matrix(_t(spark, sf_dir, "events"), "user_id", "event_type", ["click", "error", "purchase", "signup", "view"])


@query(
    "WITH c AS (SELECT o_orderpriority, count(*) FILTER (t AND c) AS tp, count(*) FILTER (NOT t AND c) AS fp, count(*) FILTER (t AND NOT c) AS fn, count(*) FILTER (NOT t AND NOT c) AS tn FROM (SELECT o_orderpriority, o_orderstatus = 'F' AS t, o_totalprice > 150000 AS c FROM orders) GROUP BY 1) "
    "SELECT *, round(tp / nullif(tp + fp, 0), 9) AS precision, round(tp / nullif(tp + fn, 0), 9) AS recall, round(2 * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM c"
)
def confusion_metrics(spark, sf_dir):
    out = cohort.confusion(_t(spark, sf_dir, "orders"), ["o_orderpriority"], F.col("o_orderstatus") == "F", F.col("o_totalprice") > 150000)
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "recall", "f1")})


@query("SELECT event_type, count(value) AS n, min(value) AS low, round(quantile_cont(value, 0.25), 9) AS q1, round(quantile_cont(value, 0.5), 9) AS median, round(quantile_cont(value, 0.75), 9) AS q3, max(value) AS high FROM events GROUP BY 1")
def spread_summary(spark, sf_dir):
    return cohort.spread(_t(spark, sf_dir, "events"), ["event_type"], "value").withColumns({c: F.round(c, 9) for c in ("q1", "median", "q3")})


@query("SELECT p_brand, CASE WHEN count(DISTINCT p_size) = 1 THEN CAST(min(p_size) AS VARCHAR) ELSE 'NOT_EVALUABLE' END AS p_size FROM part GROUP BY 1")
def merged_metrics(spark, sf_dir):
    return cohort.merged_metrics(_t(spark, sf_dir, "part"), ["p_brand"], "p_size")


# --- emission, constructs, review -------------------------------------------------------------------------------------


@query(
    _SPANS + "SELECT e.o_orderkey FROM s e JOIN orders o ON o.o_orderkey = e.o_orderkey WHERE o.o_orderstatus = 'F' AND (o.o_orderkey % 3 = 0 OR NOT EXISTS (SELECT 1 FROM s d JOIN orders p ON p.o_orderkey = d.o_orderkey WHERE p.o_orderstatus = 'P' AND d.key = e.key AND d.a <= e.b AND e.a <= d.b))"
)
def calls_outside_deletions(spark, sf_dir):
    """Orders in status F as calls, every third an insertion, that no order in status P, a deletion, overlaps."""
    s = _order_spans(spark, sf_dir).join(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    s = s.select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 3 == 0, "INS").otherwise("SNP").alias("kind"), F.col("key").alias("seq_id"), F.col("a").alias("start"), F.col("b").alias("end"), "o_orderstatus")
    out = emission.outside_deletions(s.where("o_orderstatus = 'F'").drop("o_orderstatus"), s.where("o_orderstatus = 'P'").select("seq_id", "start", "end"))
    return out.select(F.col("id").alias("o_orderkey"))


@query(
    "WITH x AS (SELECT o_orderkey, o_custkey AS seq_id, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS p, o_orderstatus AS st FROM orders), r AS (SELECT o_orderkey AS ord, seq_id, p - 30 AS a, p + 30 AS b FROM x WHERE st = 'P') "
    "SELECT o_orderkey, min(ord) FILTER (p BETWEEN a AND b) AS inside, min(ord) FILTER (least(abs(p - a), abs(p - b)) <= 20) AS terminus FROM x LEFT JOIN r USING (seq_id) WHERE st = 'F' GROUP BY 1"
)
def repeat_lookup(spark, sf_dir):
    """For orders in status F, the first order in status P within 30 days, and the first one such a span's end is near."""
    x = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("seq_id"), _day("o_orderdate").alias("p"), "o_orderstatus")
    copies = x.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("ord"), "seq_id", (F.col("p") - 30).alias("start"), (F.col("p") + 30).alias("end"), F.lit(1).alias("strand"), F.lit("r").alias("name"))
    rows = x.where("o_orderstatus = 'F'").select("o_orderkey", "seq_id", "p")
    rows = emission.with_repeat(emission.with_repeat(rows, copies, "o_orderkey", "seq_id", "p", "r1"), copies, "o_orderkey", "seq_id", "p", "r2", 20)
    return rows.select("o_orderkey", F.col("r1.ord").alias("inside"), F.col("r2.ord").alias("terminus"))


_GATE = "WITH g AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS p1, l_suppkey * 7 % 120 AS p2, l_partkey % 40 AS a1, l_partkey % 40 + 10 + l_partkey % 50 AS b1, l_suppkey % 90 AS a2, l_suppkey % 90 + 10 + l_suppkey % 60 AS b2, l_tax > 0.07 AS bal, l_discount > 0.09 AS con FROM lineitem), "


@query(
    _GATE + "d AS (SELECT *, least(abs(p1 - a1), abs(p1 - b1)) AS o1, least(abs(p2 - a2), abs(p2 - b2)) AS o2, a1 = a2 AND b1 = b2 AS same FROM g) SELECT fate, count(*) AS n FROM (SELECT CASE WHEN same AND o1 > 5 AND o2 > 5 THEN 'drop' "
    "WHEN NOT same AND NOT (a1 <= b2 AND a2 <= b1) AND (o1 > 20 OR o2 > 20) AND abs(p1 - p2) > greatest(b1 - a1, b2 - a2) AND NOT bal AND NOT con THEN 'drop' ELSE 'tag' END AS fate FROM d) GROUP BY 1"
)
def repeat_gate(spark, sf_dir):
    """What the gate of junctions between repeats says of line items, whose numbers make positions and copies."""
    g = _t(spark, sf_dir, "lineitem")
    copy = lambda a, w: F.struct(a.alias("start"), (a + 10 + w).alias("end"))
    one, two = copy(F.col("l_partkey") % 40, F.col("l_partkey") % 50), copy(F.col("l_suppkey") % 90, F.col("l_suppkey") % 60)
    fate = emission.repeat_gate(F.col("l_quantity").cast("long"), one, F.col("l_suppkey") * 7 % 120, two, F.col("l_tax") > 0.07, F.col("l_discount") > 0.09)
    return g.select(fate.alias("fate")).groupBy("fate").agg(F.count("*").alias("n"))


@query(
    "SELECT o_orderkey, string_agg(CASE WHEN l_returnflag IS NOT NULL THEN CAST(ln AS VARCHAR) || l_returnflag END, ',' ORDER BY ln) AS found, coalesce(string_agg(CASE WHEN l_returnflag IS NULL THEN CAST(ln AS VARCHAR) END, ',' ORDER BY CAST(ln AS VARCHAR)), '') AS unresolved "
    "FROM (SELECT DISTINCT o.o_orderkey, o.ln, l.l_returnflag FROM (SELECT o_orderkey, unnest([1, 2, 3, 9]) AS ln FROM orders) o LEFT JOIN (SELECT l_orderkey, l_linenumber, min(l_returnflag) AS l_returnflag FROM lineitem GROUP BY ALL) l ON l.l_orderkey = o.o_orderkey AND l.l_linenumber = o.ln) GROUP BY 1"
)
def evidence_resolution(spark, sf_dir):
    """Each order names lines 1, 2, 3 and 9 as its evidence; those that it has are found with their flag."""
    events = _t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderkey").alias("event_id"), F.array(*(F.lit(str(k)) for k in (1, 2, 3, 9))).alias("parent_ids"))
    lines = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), F.col("l_linenumber").alias("id")).agg(F.min("l_returnflag").alias("kind"))
    out = emission.resolved_parents(events, lines, ["o_orderkey"])
    found = F.array_join(F.transform("found", lambda x: F.concat(x["id"], x["kind"])), ",")
    return out.select("o_orderkey", F.when(F.size("found") > 0, found).alias("found"), F.array_join("unresolved", ",").alias("unresolved"))


@query(
    "WITH c AS (SELECT l_partkey AS k1, CAST(l_quantity AS BIGINT) AS p1, l_linestatus = 'F' AS m1, l_suppkey AS k2, CAST(round(l_tax * 100) AS BIGINT) AS p2, l_returnflag = 'R' AS m2 FROM lineitem), d AS (SELECT CASE WHEN s THEN k2 ELSE k1 END AS seq_id1, CASE WHEN s THEN p2 ELSE p1 END AS pos1, CASE WHEN s THEN NOT m2 ELSE m1 END AS minus1, "
    "CASE WHEN s THEN k1 ELSE k2 END AS seq_id2, CASE WHEN s THEN p1 ELSE p2 END AS pos2, CASE WHEN s THEN NOT m1 ELSE m2 END AS minus2 FROM (SELECT *, (k1 > k2 OR (k1 = k2 AND p1 > p2)) AS s FROM c)) SELECT seq_id1, pos1, minus1, seq_id2, pos2, minus2, 0 AS overlap, count(*) AS seed_reads FROM d GROUP BY ALL"
)
def candidate_merge(spark, sf_dir):
    """Line items as junctions of part and supplier, in canonical direction, counted."""
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("seq_id1"), F.col("l_quantity").cast("long").alias("pos1"), (F.col("l_linestatus") == "F").alias("minus1"), F.col("l_suppkey").alias("seq_id2"), F.round(F.col("l_tax") * 100).cast("long").alias("pos2"), (F.col("l_returnflag") == "R").alias("minus2"), F.lit(0).alias("overlap"), F.lit(1).alias("seed_reads"))
    return constructs.merged_candidates(rows)


@query(
    "WITH x AS (SELECT DISTINCT o_custkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d FROM orders), g AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY o_custkey ORDER BY d) <= 40 THEN 0 ELSE 1 END AS b FROM x), "
    "c AS (SELECT *, sum(b) OVER (PARTITION BY o_custkey ORDER BY d) AS chain FROM g) SELECT o_custkey, CAST(chain AS BIGINT) AS chain, min(d) AS low, max(d) AS high, count(*) AS n FROM c GROUP BY 1, 2"
)
def register_chains(spark, sf_dir):
    """A customer's order days in chains whose steps are 40 days at most."""
    x = _t(spark, sf_dir, "orders").select("o_custkey", _day("o_orderdate").alias("d")).distinct()
    out = constructs.register_chains(x, ["o_custkey"], "d", 40)
    return out.groupBy("o_custkey", "chain").agg(F.min("d").alias("low"), F.max("d").alias("high"), F.count("*").alias("n"))


@query(
    f"WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS seq_id, {_DNA_SQL} AS seq FROM documents WHERE text IS NOT NULL), e AS (SELECT seq_id, seq, len(seq) // 2 + 1 AS p, len(seq) // 3 + 1 AS q FROM d WHERE len(seq) > 0), "
    "f AS (SELECT seq_id, seq, p, q, substr(seq, greatest(1, p - 35), least(p, 36)) AS l, reverse(translate(substr(seq, greatest(1, q - 35), least(q, 36)), 'ACGT', 'TGCA')) AS r FROM e) SELECT seq_id, l || substr(r, 4) AS sequence, len(l) AS breakpoint FROM f"
)
def junction_constructs(spark, sf_dir):
    """Each document's letters as a contig: the sequence of a junction of its middle and its first third, with three shared bases."""
    d = _dna(spark, sf_dir).where("length(seq) > 0")
    half, third = F.floor(F.length("seq") / 2) + 1, F.floor(F.length("seq") / 3) + 1
    rows = d.select(F.col("seq_id").alias("seq_id1"), half.alias("pos1"), F.lit(True).alias("minus1"), F.col("seq_id").alias("seq_id2"), third.alias("pos2"), F.lit(True).alias("minus2"), F.lit(3).alias("overlap"))
    out = constructs.constructs(rows, d.dropDuplicates(["seq_id"]), 36)
    return out.select(F.col("seq_id1").alias("seq_id"), "sequence", F.col("breakpoint").cast("long").alias("breakpoint"))


@query(
    "SELECT l_partkey, count(*) FILTER (k = 'ref') AS raw_ref, count(*) FILTER (k = 'alt') AS raw_alt, count(*) FILTER (k = 'other') AS raw_other, count(*) FILTER (k = 'ref' AND u) AS unique_ref, count(*) FILTER (k = 'alt' AND u) AS unique_alt, count(*) FILTER (k = 'other' AND u) AS unique_other, "
    "count(*) FILTER (k = 'ref' AND u AND g) AS good_ref, count(*) FILTER (k = 'alt' AND u AND g) AS good_alt, count(*) FILTER (k = 'other' AND u AND g) AS good_other, count(DISTINCT l_returnflag) AS n_bases FROM (SELECT l_partkey, l_returnflag, CASE l_returnflag WHEN 'A' THEN 'ref' WHEN 'R' THEN 'alt' ELSE 'other' END AS k, l_quantity >= 10 AS u, l_linenumber >= 3 AS g FROM lineitem) GROUP BY 1"
)
def locus_evidence(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem")
    out = review.locus_counters(rows, ["l_partkey"], F.col("l_returnflag"), F.lit("A"), F.lit("R"), F.col("l_quantity"), F.col("l_linenumber"), 10, 3)
    return out.withColumn("n_bases", F.size("histogram").cast("long")).drop("histogram")


@query(
    "WITH p AS (SELECT l_partkey % 30 AS a1, l_suppkey % 30 AS a2, l_linenumber % 2 = 0 AS s, CAST(l_quantity AS BIGINT) % 30 AS b1, CAST(round(l_tax * 300) AS BIGINT) AS b2, l_returnflag = 'R' AS t, l_linenumber % 3 AS ao, l_orderkey % 3 AS bo FROM lineitem), "
    "q AS (SELECT *, greatest(abs(a1 - b1), abs(a2 - b2)) AS st, greatest(abs(a1 - b2), abs(a2 - b1)) AS cr, least(abs(a1 - b1), abs(a2 - b2), abs(a1 - b2), abs(a2 - b1)) AS one FROM p) "
    "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN least(st, cr) <= 5 THEN CASE WHEN NOT (s = t) THEN 'TOPOLOGY' WHEN ao <> bo THEN 'OVERLAP_DIFFERS' ELSE (CASE WHEN least(st, cr) <= 0 THEN 'EXACT' ELSE 'NEAR' END) || (CASE WHEN cr < st THEN '_SWAPPED' ELSE '' END) END WHEN one <= 5 THEN 'DISCORDANT_BREAKEND' ELSE 'UNRELATED' END AS reason FROM q) GROUP BY 1"
)
def pair_reasons(spark, sf_dir):
    """Why two junctions that a line item's numbers make agree or don't."""
    l, long = _t(spark, sf_dir, "lineitem"), lambda c: c.cast("long")  # noqa: E741
    rows = l.select((F.col("l_partkey") % 30).alias("a1"), (F.col("l_suppkey") % 30).alias("a2"), *((F.col("l_linenumber") % 2 == 0).alias(c) for c in ("as1", "as2")), (long(F.col("l_quantity")) % 30).alias("b1"), long(F.round(F.col("l_tax") * 300)).alias("b2"), *((F.col("l_returnflag") == "R").alias(c) for c in ("bs1", "bs2")), (F.col("l_linenumber") % 3).alias("ao"), (F.col("l_orderkey") % 3).alias("bo"))
    return rows.select(review.pair_reason(0, 5).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(
    "SELECT o_orderpriority AS kind, o_orderkey % 4 AS size, count(*) AS n, count(*) FILTER (CASE o_orderpriority WHEN '1-URGENT' THEN len(r) = 1 AND len(a) = 1 AND r <> a WHEN '2-HIGH' THEN len(r) BETWEEN 1 AND 2 AND len(r) = len(a) AND r <> a WHEN '3-MEDIUM' THEN len(a) BETWEEN 1 AND 2 WHEN '5-LOW' THEN len(r) BETWEEN 1 AND 2 ELSE false END) AS judged "
    "FROM (SELECT *, repeat('A', o_orderkey % 4) AS r, repeat('C', o_custkey % 4) AS a FROM orders) GROUP BY ALL"
)
def authorised_kinds(spark, sf_dir):
    kinds = {"1-URGENT": "SNP", "2-HIGH": "SUB", "3-MEDIUM": "INS", "4-NOT SPECIFIED": "MOB", "5-LOW": "DEL"}
    o = _t(spark, sf_dir, "orders").withColumns({"r": F.expr("repeat('A', cast(o_orderkey % 4 as int))"), "a": F.expr("repeat('C', cast(o_custkey % 4 as int))")})
    kind = F.element_at(F.create_map(*(F.lit(x) for kv in kinds.items() for x in kv)), F.col("o_orderpriority"))
    return o.groupBy(F.col("o_orderpriority").alias("kind"), (F.col("o_orderkey") % 4).alias("size")).agg(F.count("*").alias("n"), F.count_if(subclonal.authorised(kind, F.col("r"), F.col("a"))).alias("judged"))


@query(
    "WITH k AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'SNP' WHEN 1 THEN 'SUB' WHEN 2 THEN 'INS' WHEN 3 THEN 'DEL' WHEN 4 THEN 'MOB' ELSE 'JC' END AS kind, p_size % 20 AS pos, upper(p_brand) AS seq FROM part) SELECT p_partkey, "
    "CASE kind WHEN 'SNP' THEN CASE WHEN pos BETWEEN 1 AND len(seq) THEN substr(seq, CAST(pos AS INTEGER), 1) ELSE '.' END WHEN 'SUB' THEN '2' WHEN 'INS' THEN '.' WHEN 'DEL' THEN '2bp' ELSE 'none' END AS ref, "
    "CASE kind WHEN 'SNP' THEN '2' WHEN 'SUB' THEN 'x' WHEN 'INS' THEN '2' WHEN 'DEL' THEN 'none' WHEN 'MOB' THEN '2' ELSE 'x:y' END AS alt, CASE WHEN kind IN ('SNP', 'SUB') THEN CASE WHEN pos BETWEEN 1 AND len(seq) THEN substr(seq, CAST(pos AS INTEGER), CASE WHEN kind = 'SUB' THEN 2 ELSE 1 END) ELSE '.' END ELSE '.' END AS genomic FROM k"
)
def display_alleles(spark, sf_dir):
    """What tables show of records that parts make: the brand is the sequence, the size a position."""
    names = F.array(*map(F.lit, ("SNP", "SUB", "INS", "DEL", "MOB", "JC")))
    p = _t(spark, sf_dir, "part").withColumn("kind", F.element_at(names, (F.col("p_partkey") % 6 + 1).cast("int")))
    fields = F.array(F.lit("s"), (F.col("p_size") % 20).cast("string"), F.lit("2"), F.lit("x"), F.lit("y"))
    return p.select("p_partkey", products.display_alleles(F.col("kind"), fields, F.col("p_brand")).alias("d")).select("p_partkey", "d.ref", "d.alt", "d.genomic")


@query(
    "WITH r AS (SELECT l_partkey, l_orderkey, bool_or(l_returnflag = 'R') AS a, bool_or(l_returnflag = 'A') AS f, bool_or(l_linestatus = 'F') AS m FROM lineitem GROUP BY 1, 2), k AS (SELECT l_partkey, m, CASE WHEN a THEN 'alt' WHEN f THEN 'ref' ELSE 'other' END AS k FROM r) "
    "SELECT l_partkey, " + ", ".join(f"count(*) FILTER (k = '{k}' AND {'m' if d == 'rev' else 'NOT m'}) AS {k}_{d}" for k in ("ref", "alt", "other") for d in ("fwd", "rev")) + " FROM k GROUP BY 1"
)
def read_allele_counts(spark, sf_dir):
    """Orders as reads over parts: each counts once, as alt before ref, by strand."""
    rows, flag = _t(spark, sf_dir, "lineitem"), F.col("l_returnflag")
    return subclonal.allele_counts(rows, ["l_partkey"], "l_orderkey", flag == "R", flag == "A", F.col("l_linestatus") == "F")


_DAYS = "WITH x AS (SELECT o_orderkey, o_custkey, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d, o_orderstatus AS st FROM orders) "


@query(_DAYS + "SELECT o_orderkey FROM x j WHERE st = 'F' AND NOT EXISTS (SELECT 1 FROM x m WHERE m.st = 'P' AND m.o_custkey = j.o_custkey AND abs(m.d - j.d) <= 20)")
def companion_mask(spark, sf_dir):
    """Orders in status F, as junctions, without one in status P, an element's insertion, within 20 days."""
    x = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("seq_id"), _day("o_orderdate").alias("pos"), "o_orderstatus")
    return classify.masked_companions(x.where("o_orderstatus = 'F'"), x.where("o_orderstatus = 'P'").select("seq_id", "pos")).select(F.col("event_id").alias("o_orderkey"))


@query(_SPANS + "SELECT DISTINCT e.o_orderkey AS event_id, i.o_orderkey AS edit_id FROM s e JOIN s i ON e.key = i.key AND e.a <= i.b AND i.a <= e.b JOIN orders x ON x.o_orderkey = e.o_orderkey JOIN orders y ON y.o_orderkey = i.o_orderkey WHERE x.o_orderstatus = 'F' AND y.o_orderstatus = 'P'")
def intended_overlap(spark, sf_dir):
    s = _order_spans(spark, sf_dir).join(_t(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    side = lambda st, name: s.where(F.col("o_orderstatus") == st).select(F.col("o_orderkey").alias(name), F.col("key").alias("seq_id"), F.col("a").alias("start"), F.col("b").alias("end"))
    return classify.intended_hits(side("F", "event_id"), side("P", "edit_id"))


@query(
    "WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey % 3 AS number, l_linenumber % 4 + 1 AS pos, CAST(l_quantity AS BIGINT) AS m, l_suppkey % 3 AS d FROM lineitem), b AS (SELECT *, 12 + number * 3 AS bp, number = 2 AS br, 30 + l_orderkey % 15 AS primary_score, pos - 1 AS lo, pos - 1 + m + d AS hi, m - d AS score FROM a), "
    "c AS (SELECT *, CASE WHEN m < 28 THEN 'short_cover' WHEN NOT (hi > lo AND bp - lo >= 3 AND hi - bp >= 3) THEN 'not_spanning' WHEN score < primary_score OR (score = primary_score AND NOT br) THEN 'worse_than_primary' END AS r FROM b), "
    "e AS (SELECT *, max(CASE WHEN r IS NULL THEN score END) OVER (PARTITION BY l_orderkey) AS best FROM c) SELECT number, coalesce(r, CASE WHEN score < best THEN 'worse_than_competing' ELSE 'kept' END) AS fate, count(*) AS n FROM e GROUP BY ALL"
)
def second_pass_fates(spark, sf_dir):
    """Line items as alignments of orders, the reads, to three constructs: which are evidence, and why others aren't."""
    l = _t(spark, sf_dir, "lineitem")  # noqa: E741
    cigar = F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit("M"), F.when(F.col("l_suppkey") % 3 > 0, F.concat((F.col("l_suppkey") % 3).cast("string"), F.lit("D"))).otherwise(""))
    sam = l.select(F.col("l_orderkey").cast("string").alias("qname"), F.lit(0).alias("flag"), F.concat(F.lit("jc"), (F.col("l_partkey") % 3).cast("string")).alias("rname"), (F.col("l_linenumber") % 4 + 1).alias("pos"), cigar.alias("cigar"))
    built = spark.range(3).select(F.col("id").alias("number"), (12 + F.col("id") * 3).cast("int").alias("breakpoint"), (F.col("id") == 2).alias("both_repeats"))
    primary = l.select("l_orderkey").distinct().select(F.col("l_orderkey").cast("string").alias("name"), F.lit(0).alias("mate"), (30 + F.col("l_orderkey") % 15).cast("int").alias("primary"))
    out = constructs.judged_alignments(sam, built, primary)
    return out.groupBy("number", F.coalesce("reject", F.lit("kept")).alias("fate")).agg(F.count("*").alias("n"))


@query(
    "SELECT l_orderkey, l_linenumber, CASE WHEN r IS NULL THEN 'cell' ELSE r END AS reads, CASE WHEN p > 0 AND m > 0 THEN 'BOTH' WHEN p + m > 0 THEN 'ONE' ELSE 'NONE' END AS strands, CASE WHEN s >= 14 THEN 'LONG' WHEN s >= 3 THEN 'SHORT' ELSE 'UNANCHORED' END AS sides, "
    "CASE WHEN c = 0 THEN 'UNIQUE' WHEN c = 1 OR y THEN 'ONE_REPEAT' ELSE 'REPEATS' END AS places FROM (SELECT l_orderkey, l_linenumber, l_linenumber % 3 AS p, l_partkey % 3 AS m, CASE WHEN l_suppkey % 15 >= 10 THEN 'STRONG' WHEN l_suppkey % 15 >= 3 THEN 'MODERATE' WHEN l_suppkey % 15 >= 1 THEN 'WEAK' ELSE 'NONE' END AS r, CAST(l_quantity AS BIGINT) % 20 AS s, l_partkey % 4 AS c, l_returnflag = 'R' AS y FROM lineitem)"
)
def evidence_classes(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")  # noqa: E741
    c = review.evidence_classes(F.col("l_suppkey") % 15, F.col("l_linenumber") % 3, F.col("l_partkey") % 3, F.col("l_quantity").cast("long") % 20, F.col("l_partkey") % 4, F.col("l_returnflag") == "R")
    return l.select("l_orderkey", "l_linenumber", c.alias("c")).select("l_orderkey", "l_linenumber", "c.*")


@query(
    _SPANS + "SELECT relevance, structure, count(*) AS n FROM (SELECT CASE WHEN apart = 0 THEN 'ON_TARGET' WHEN apart <= 60 THEN 'FLANKING' ELSE 'ELSEWHERE' END AS relevance, CASE WHEN k = 0 THEN 'STRUCTURAL' WHEN k = 1 THEN CASE WHEN a <= 9500 AND b >= 9520 THEN 'DELETES_TARGET' ELSE 'DELETION' END ELSE 'SEQUENCE' END AS structure "
    "FROM (SELECT a, b, greatest(0, a - 9520, 9500 - b) AS apart, o_orderkey % 3 AS k FROM s)) GROUP BY ALL"
)
def locus_relevance(spark, sf_dir):
    kind = F.element_at(F.array(F.lit("JC"), F.lit("DEL"), F.lit("SNP")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    near, structure = review.locus_relevance(F.col("a"), F.col("b"), F.lit(9500), F.lit(9520), 60, kind)
    return _order_spans(spark, sf_dir).groupBy(near.alias("relevance"), structure.alias("structure")).agg(F.count("*").alias("n"))


@query(
    "SELECT o_custkey, o_orderkey, CASE WHEN n = 0 THEN 'NONE' ELSE m END AS matched_event_ids, CASE WHEN o_orderkey % 5 = 0 THEN 'NA' WHEN abs(o_orderkey % 9 - 4) <= 2 THEN 'PASS' ELSE 'FAIL(' || (o_orderkey % 9 - 4) || 'bp)' END AS left_boundary_status, upper(CASE WHEN n > 0 THEN 'complete' ELSE 'missing' END) AS status "
    "FROM (SELECT o.o_custkey, o.o_orderkey, count(l.l_orderkey) AS n, string_agg(CAST(o.o_orderkey * 10 + l.l_linenumber AS VARCHAR), ',' ORDER BY l.l_linenumber, l.l_partkey) AS m FROM orders o LEFT JOIN (SELECT DISTINCT l_orderkey, l_linenumber, 0 AS l_partkey FROM lineitem WHERE l_returnflag = 'R') l ON l.l_orderkey = o.o_orderkey GROUP BY 1, 2)"
)
def edit_outcomes(spark, sf_dir):
    """Orders as edits that their returned lines, the events, match: rows of the table of edit outcomes."""
    lines = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber").distinct()
    event = F.concat_ws("_", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    events = lines.select(event.alias("event_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    matched = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(event)).alias("matched"))
    none, empty = F.lit(None).cast("long"), F.expr("cast(array() as array<string>)")
    o = _t(spark, sf_dir, "orders").join(matched, "o_orderkey", "left")
    off = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey") % 9 - 4)
    edits = o.select(F.col("o_orderkey").alias("edit_id"), F.lit("snp").alias("kind"), F.col("o_custkey").alias("seq_id"), F.lit(1).alias("start"), F.lit(1).alias("end"), F.when(F.size("matched") > 0, "complete").otherwise("missing").alias("status"), F.coalesce("matched", empty).alias("matched"), empty.alias("unexpected"), off.alias("left_diff"), none.alias("right_diff"), none.alias("expected_size"), none.alias("observed_size"), empty.alias("notes"))
    return products.edit_outcomes(edits, events).select(F.col("seq_id").alias("o_custkey"), F.col("edit_id").alias("o_orderkey"), "matched_event_ids", "left_boundary_status", "status")


@query(
    "SELECT user_id AS event_id, count(DISTINCT event_type) AS n_clones, CASE WHEN count(DISTINCT event_type) = 1 THEN 'clone_specific' WHEN count(DISTINCT event_type) = 5 THEN 'shared_all' ELSE 'shared_subset' END AS scope, 's' AS seq_id, CAST(min(user_id) AS BIGINT) AS position, "
    "CAST(min(user_id) + 1 AS BIGINT) AS \"end\", '2bp' AS ref, 'none' AS alt, " + ", ".join(f"CAST(max(CASE WHEN event_type = '{c}' THEN 1 ELSE 0 END) AS INTEGER) AS clone_{c}" for c in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1"
)
def batch_matrix(spark, sf_dir):
    """Users as deletions that clones, the types of their events, have."""
    records = _t(spark, sf_dir, "events").select(F.col("event_type").alias("clone_id"), F.col("user_id").alias("event_id"), F.lit("DEL").alias("kind"), F.array(F.lit("s"), F.col("user_id").cast("string"), F.lit("2")).alias("fields"))
    clones = ["click", "error", "purchase", "signup", "view"]
    out = products.batch_matrix(products.clone_observations(records), clones)
    return out.select("event_id", "n_clones", "scope", "seq_id", "position", "end", "ref", "alt", *(f"clone_{c}" for c in clones))


_SIDES = _DAYS.rstrip() + ", y AS (SELECT o_orderkey AS id, o_custkey AS k, d, o_orderkey % 2 = 0 AS m, st FROM x JOIN orders USING (o_orderkey, o_custkey)) "


def _bucket_sql(own: str, other: str, side: str) -> str:
    return (
        f"SELECT '{side}' AS side, id, CASE WHEN id <> first THEN 'duplicate' WHEN best = 0 THEN 'exact' WHEN best = 1 THEN 'jitter' WHEN best = 2 THEN 'strand' ELSE 'only' END AS bucket FROM (SELECT a.id, a.first, min(CASE WHEN b.m = a.m AND b.d = a.d THEN 0 WHEN b.m = a.m THEN 1 WHEN b.m IS NOT NULL THEN 2 END) AS best "
        f"FROM (SELECT *, min(id) OVER (PARTITION BY k, d, m) AS first FROM y WHERE st = '{own}') a LEFT JOIN (SELECT * FROM y WHERE st = '{other}') b ON a.k = b.k AND abs(a.d - b.d) <= 15 GROUP BY 1, 2)"
    )


@query(_SIDES + _bucket_sql("F", "O", "a") + " UNION ALL " + _bucket_sql("O", "F", "b"))
def discrepancy_buckets(spark, sf_dir):
    """Orders in status F against those in status O: places are days, strands whether the key is even."""
    y = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), _day("o_orderdate").alias("d"), (F.col("o_orderkey") % 2 == 0).alias("m"), "o_orderstatus")
    return gates.discrepancies(y.where("o_orderstatus = 'F'"), y.where("o_orderstatus = 'O'"), ["k"], "d", "m", 15)


@query(
    f"WITH g AS (SELECT CAST(item_id AS VARCHAR) AS seq_id, {_DNA_SQL} AS seq FROM benchmark), c AS (SELECT seq_id, seq, unnest(range(50, len(seq) - 29, 97)) AS pos FROM g) "
    "SELECT CAST(row_number() OVER (ORDER BY seq_id, pos) AS INTEGER) AS id, 'SNP' AS kind, seq_id, pos, translate(substr(seq, pos, 1), 'ACGT', 'CGTA') AS alt FROM c"
)
def evidence_records(spark, sf_dir):
    """Reads of changed copies of the benchmark's items, in steps of three bases on both strands, through the whole evidence plan."""
    items = _dna(spark, sf_dir, "benchmark", "item_id")
    at = F.transform(F.split("seq", ""), lambda b, i: F.when((i % 97 == 49) & (i < F.char_length("seq") - 30), F.translate(b, "ACGT", "CGTA")).otherwise(b))
    changed = items.withColumn("genome", F.array_join(at, "")).where(F.char_length("seq") >= 30)
    reads = changed.select(F.col("seq_id").alias("contig"), "genome", F.explode(F.sequence(F.lit(0), F.char_length("seq") - 30, F.lit(3))).alias("start"))
    reads = reads.select(F.lit("s").alias("sample"), "contig", F.col("start").cast("long").alias("start_0"), (F.col("start") % 2 == 1).alias("minus"), F.substring("genome", F.col("start") + 1, F.lit(30)).alias("seq"), F.lit("30M").alias("cigar"), F.lit(40).alias("mapq"), F.xxhash64("contig", "start").alias("read_id"))
    out = evidence.records(reads, items.where(F.char_length("seq") > 0))
    return out.select("id", "kind", F.get("fields", F.lit(0)).alias("seq_id"), F.get("fields", F.lit(1)).cast("long").alias("pos"), F.get("fields", F.lit(2)).alias("alt"))


# --- records of two samples and declared edits ------------------------------------------------------------------------

_DOMAIN = identity.DOMAIN.hex().upper()
_BYTES8 = "lpad(hex({0}), 16, '0')"
_EVENT_SQL = f"""
WITH o AS (
  SELECT o_orderstatus AS st, o_orderkey AS id, o_custkey AS k, r_name AS s, o_orderkey % 3 AS kind, substr('ACGT', CAST(o_orderkey % 4 + 1 AS INT), 1) AS alt, CASE WHEN o_orderstatus = 'O' THEN o_custkey % 3 * 4 ELSE 0 END AS off FROM orders JOIN region ON r_regionkey = o_custkey % 5
), n AS (SELECT *, '{_DOMAIN}' AS head, lpad(hex(strlen(s)), 8, '0') || hex(s) || upper(sha256(s)) AS c FROM o),
p AS (
  SELECT *, CASE kind WHEN 0 THEN head || '01' || c || {_BYTES8.format("100 * k + 70")} || hex(alt)
                      WHEN 1 THEN head || '09' || c || {_BYTES8.format("100 * k + off")} || '01' || c || {_BYTES8.format("100 * k + 50 + off")} || '02' || {_BYTES8.format("0::BIGINT")}
                      ELSE head || '05' || c || {_BYTES8.format("100 * k + 20 + off")} || '00000003' || hex('IS1') || '01' || {_BYTES8.format("4::BIGINT")} END AS image FROM n
), e AS (SELECT st, 'DV1_' || substr(sha256(unhex(image)), 1, 32) AS event_id, kind, any_value(k) AS k, any_value(s) AS s, any_value(alt) AS alt, any_value(off) AS off, min(id) AS first_id, count(*) AS n_ids FROM p GROUP BY 1, 2, 3),
f AS (SELECT * FROM e WHERE st = 'F' AND event_id NOT IN (SELECT event_id FROM e WHERE st = 'O')),
d AS (SELECT * FROM f WHERE kind = 0 OR NOT EXISTS (SELECT 1 FROM e z WHERE z.st = 'O' AND z.kind = f.kind AND z.k = f.k AND z.off <= 5)),
j AS (
  SELECT c_custkey AS edit_id, c_custkey AS k, 'snp' AS kind, list(event_id ORDER BY event_id) FILTER (alt = 'A') AS hits, list(event_id ORDER BY event_id) FILTER (alt <> 'A') AS others FROM customer LEFT JOIN d ON d.k = c_custkey AND d.kind = 0 WHERE c_custkey % 3 = 0 GROUP BY 1
  UNION ALL SELECT -1 - c_custkey, c_custkey, 'mob', list(event_id ORDER BY event_id) FILTER (event_id IS NOT NULL), NULL FROM customer LEFT JOIN d ON d.k = c_custkey AND d.kind = 2 WHERE c_custkey % 7 = 0 GROUP BY 1, 2
), a AS (
  SELECT edit_id, kind, CASE WHEN len(hits) > 0 THEN CASE WHEN len(others) > 0 THEN 'partial' ELSE 'complete' END WHEN len(others) > 0 THEN 'partial' ELSE 'missing' END AS status,
         coalesce(CASE WHEN len(hits) > 0 THEN hits ELSE others END, []) AS matched, coalesce(CASE WHEN len(hits) > 0 THEN others END, []) AS unexpected FROM j
), g AS (SELECT unnest(matched) AS event_id, status FROM a UNION ALL SELECT unnest(unexpected), 'unexpected' FROM a),
u AS (SELECT * FROM d WHERE event_id NOT IN (SELECT event_id FROM g GROUP BY 1 HAVING bool_and(status = 'complete')))
"""
_NAMES = "CASE kind WHEN 0 THEN 'SNP' WHEN 1 THEN 'JC' ELSE 'MOB' END"


def _records(spark, sf_dir, status: str, *more) -> DataFrame:
    """Orders in a status as records on regions: substitutions, junctions and elements at places of their customer; more columns go before."""
    text = lambda c: c.cast("string")
    at = F.col("o_custkey") * 100
    off = F.when(F.col("o_orderstatus") == "O", F.col("o_custkey") % 3 * 4).otherwise(0)
    seq, kind = F.col("r_name"), F.col("o_orderkey") % 3
    fields = F.when(kind == 0, F.array(seq, text(at + 70), F.substring(F.lit("ACGT"), (F.col("o_orderkey") % 4 + 1).cast("int"), F.lit(1))))
    fields = fields.when(kind == 1, F.array(seq, text(at + off), F.lit("1"), seq, text(at + 50 + off), F.lit("-1"), F.lit("0"))).otherwise(F.array(seq, text(at + 20 + off), F.lit("IS1"), F.lit("1"), F.lit("4")))
    rows = _t(spark, sf_dir, "orders").where(F.col("o_orderstatus") == status).join(F.broadcast(_t(spark, sf_dir, "region")), F.col("o_custkey") % 5 == F.col("r_regionkey"))
    return rows.select(*more, F.col("o_orderkey").alias("id"), F.when(kind == 0, "SNP").when(kind == 1, "JC").otherwise("MOB").alias("kind"), fields.alias("fields"))


def _pair(spark, sf_dir):
    contigs = _t(spark, sf_dir, "region").select(F.col("r_name").alias("seq_id"), F.col("r_name").alias("seq"))
    return _records(spark, sf_dir, "F"), _records(spark, sf_dir, "O"), contigs


def _edits(spark, sf_dir) -> DataFrame:
    """Declared edits at customers' places: substitutions by A, and others where an element may be."""
    c = _t(spark, sf_dir, "customer").join(F.broadcast(_t(spark, sf_dir, "region")), F.col("c_custkey") % 5 == F.col("r_regionkey"))
    at = F.col("c_custkey") * 100
    edit = lambda ident, a, b, alt, kind: [ident.alias("edit_id"), F.col("r_name").alias("seq_id"), a.alias("start"), b.alias("end"), F.lit(".").alias("ref"), F.lit(alt).alias("alt"), F.lit(kind).alias("kind")]
    return c.where("c_custkey % 3 = 0").select(*edit(F.col("c_custkey"), at + 70, at + 70, "A", "snp")).union(c.where("c_custkey % 7 = 0").select(*edit(-1 - F.col("c_custkey"), at + 15, at + 35, ".", "mob")))


@query(_EVENT_SQL + f"SELECT event_id, {_NAMES} AS kind, first_id, n_ids FROM d")
def difference_events(spark, sf_dir):
    """Records of orders in status F that those in status O lack, exactly or within the tolerance, by their identities."""
    out = differential.difference(*_pair(spark, sf_dir))
    return out.select("event_id", "kind", F.element_at("ids", 1).alias("first_id"), F.size("ids").cast("long").alias("n_ids"))


@query(_EVENT_SQL + "SELECT edit_id, kind, status, array_to_string(matched, ',') AS matched, array_to_string(unexpected, ',') AS unexpected FROM a")
def edit_assessments(spark, sf_dir):
    """Declared edits at customers, judged by the events of the difference."""
    judged = intended.assess(_edits(spark, sf_dir), cut(differential.difference(*_pair(spark, sf_dir))))
    return judged.select("edit_id", "kind", "status", F.array_join("matched", ",").alias("matched"), F.array_join("unexpected", ",").alias("unexpected"))


@query(_EVENT_SQL + f"SELECT event_id, {_NAMES} AS kind, s AS seq_id, k AS custkey FROM u")
def unintended_events(spark, sf_dir):
    """What the whole audit of the two samples leaves beside the declared edits."""
    found = audit(*_pair(spark, sf_dir), _edits(spark, sf_dir))
    return found.unintended.select("event_id", "kind", F.get("fields", F.lit(0)).alias("seq_id"), F.floor(F.get("fields", F.lit(1)).cast("long") / 100).alias("custkey"))


# --- audits of many clones: the orders of each priority are one, all against the same starter

_CLONE_SQL = (
    _EVENT_SQL
    + """, ce AS (SELECT 'p' || substr(o_orderpriority, 1, 1) AS clone_id, d.event_id, d.kind, d.k, d.s, d.alt FROM p JOIN orders ON o_orderkey = p.id JOIN d ON d.event_id = 'DV1_' || substr(sha256(unhex(p.image)), 1, 32) WHERE p.st = 'F' GROUP BY ALL),
cj AS (
  SELECT 'p' || (c_custkey % 5 + 1) AS clone_id, c_custkey AS edit_id, 'snp' AS kind, list(event_id ORDER BY event_id) FILTER (alt = 'A') AS hits, list(event_id ORDER BY event_id) FILTER (alt <> 'A') AS others FROM customer LEFT JOIN ce ON ce.k = c_custkey AND ce.kind = 0 AND ce.clone_id = 'p' || (c_custkey % 5 + 1) WHERE c_custkey % 3 = 0 GROUP BY 1, 2
  UNION ALL SELECT 'p' || (c_custkey % 5 + 1), -1 - c_custkey, 'mob', list(event_id ORDER BY event_id) FILTER (event_id IS NOT NULL), NULL FROM customer LEFT JOIN ce ON ce.k = c_custkey AND ce.kind = 2 AND ce.clone_id = 'p' || (c_custkey % 5 + 1) WHERE c_custkey % 7 = 0 GROUP BY 1, 2
), ca AS (
  SELECT clone_id, edit_id, kind, CASE WHEN len(hits) > 0 THEN CASE WHEN len(others) > 0 THEN 'partial' ELSE 'complete' END WHEN len(others) > 0 THEN 'partial' ELSE 'missing' END AS status,
         coalesce(CASE WHEN len(hits) > 0 THEN hits ELSE others END, []) AS matched, coalesce(CASE WHEN len(hits) > 0 THEN others END, []) AS unexpected FROM cj
), cg AS (SELECT clone_id, unnest(matched) AS event_id, status FROM ca UNION ALL SELECT clone_id, unnest(unexpected), 'unexpected' FROM ca),
cx AS (SELECT clone_id, event_id FROM cg GROUP BY 1, 2 HAVING bool_and(status = 'complete'))
"""
)


def _clone_audit(spark, sf_dir) -> Audit:
    starter, contigs = _pair(spark, sf_dir)[1:]
    records = _records(spark, sf_dir, "F", F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)).alias("clone_id"))
    edits = _edits(spark, sf_dir)
    owner = F.when(F.col("edit_id") >= 0, F.col("edit_id")).otherwise(-1 - F.col("edit_id"))
    return audit_clones(records, starter, contigs, edits.withColumn("clone_id", F.concat(F.lit("p"), (owner % 5 + 1).cast("string"))))


@query(_CLONE_SQL + "SELECT clone_id, CAST(edit_id AS VARCHAR) AS edit_id, kind, status, array_to_string(matched, ',') AS matched, array_to_string(unexpected, ',') AS unexpected FROM ca")
def clone_assessments(spark, sf_dir):
    """Each clone's declared edits, judged by its own events; all clones are one plan."""
    judged = _clone_audit(spark, sf_dir).assessments
    return judged.select(scope("edit_id").alias("clone_id"), bare("edit_id").alias("edit_id"), "kind", "status", all_bare(F.array_join("matched", ",")).alias("matched"), all_bare(F.array_join("unexpected", ",")).alias("unexpected"))


@query(_CLONE_SQL + f"SELECT clone_id, event_id, {_NAMES} AS kind, s AS seq_id, k AS custkey, CASE WHEN kind = 0 THEN 'scattered_snv' ELSE 'structural' END AS class FROM ce WHERE NOT EXISTS (SELECT 1 FROM cx WHERE cx.clone_id = ce.clone_id AND cx.event_id = ce.event_id)")
def clone_unintended(spark, sf_dir):
    """What the audits of all clones, in one plan, leave beside each clone's edits, with its class."""
    found = _clone_audit(spark, sf_dir).unintended
    return found.select(scope("event_id").alias("clone_id"), bare("event_id").alias("event_id"), "kind", bare(F.get("fields", F.lit(0))).alias("seq_id"), F.floor(F.get("fields", F.lit(1)).cast("long") / 100).alias("custkey"), "class")


# --- the composed audit -----------------------------------------------------------------------------------------------

_KINDS = {"1-URGENT": "SNP", "2-HIGH": "DEL", "3-MEDIUM": "INS", "4-NOT SPECIFIED": "MOB", "5-LOW": "JC"}


def audited(spark, sf_dir) -> DataFrame:
    """Orders in status F that the customer has no order in status O beside of (within 30 days), classified by shipments as sites."""
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").cast("string").alias("seq_id"), _day("o_orderdate").alias("start"), F.element_at(F.create_map(*[F.lit(x) for p in _KINDS.items() for x in p]), F.col("o_orderpriority")).alias("kind"), (F.col("o_orderkey") % 5).alias("size"), "o_orderstatus")
    e, s = o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'O'")
    near = intervals.band_join(e.select("event_id", "seq_id", "kind", "start"), s.select("seq_id", "kind", F.col("start").alias("other")), ["seq_id", "kind"], "start", "other", 30).select("event_id").distinct()
    events = e.join(near, "event_id", "left_anti").drop("o_orderstatus")
    sides = events.select("event_id", F.lit(0).alias("side"), "seq_id", "start", F.col("start").alias("end"))
    places = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").cast("string").alias("seq_id"), F.col("o_orderkey").alias("site_id"), _day("o_orderdate").alias("start"), _day("o_orderdate").alias("end"), F.lit(0).alias("mismatches"), F.lit("NGG").alias("pam"))
    return classify.classify(events, sides, places, within=50, hypothesis=True)


@query(
    "WITH o AS (SELECT o_orderkey, o_custkey, o_orderstatus, date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS d, CASE o_orderpriority WHEN '1-URGENT' THEN 'SNP' WHEN '2-HIGH' THEN 'DEL' WHEN '3-MEDIUM' THEN 'INS' WHEN '4-NOT SPECIFIED' THEN 'MOB' ELSE 'JC' END AS kind, o_orderkey % 5 AS size FROM orders), "
    "e AS (SELECT * FROM o WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM o s WHERE s.o_orderstatus = 'O' AND s.o_custkey = o.o_custkey AND s.kind = o.kind AND abs(s.d - o.d) <= 30)), "
    "n AS (SELECT o_orderkey, min(abs(e.d - p.d)) AS distance FROM e JOIN (SELECT o_custkey, d FROM o WHERE o_orderstatus = 'P') p USING (o_custkey) WHERE abs(e.d - p.d) <= 50 GROUP BY 1), "
    "c AS (SELECT kind, distance, CASE WHEN kind IN ('MOB', 'JC') OR (kind = 'DEL' AND size > 2) THEN 'structural' WHEN distance IS NOT NULL THEN 'near_homolog' ELSE 'scattered_snv' END AS class FROM e LEFT JOIN n USING (o_orderkey)) "
    "SELECT kind, class, count(*) AS n, count(*) FILTER (class = 'scattered_snv') AS hypotheses, min(CASE WHEN class = 'near_homolog' THEN distance END) AS nearest FROM c GROUP BY 1, 2"
)
def audit_summary(spark, sf_dir):
    return audited(spark, sf_dir).groupBy("kind", "class").agg(F.count("*").alias("n"), F.count("hypothesis").alias("hypotheses"), F.min("distance").alias("nearest"))
