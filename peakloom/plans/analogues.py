"""Queries that exercise the library's operators on the shared tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions import scalars as S
from peakloom.operators import aggregates as A
from peakloom.operators import calibrate as C
from peakloom.operators import candidates as K
from peakloom.operators import competition as X
from peakloom.operators import fdr as E
from peakloom.operators import joins as J
from peakloom.operators import library as L
from peakloom.operators import peak_index as I
from peakloom.operators import quantify as Q
from peakloom.operators import ranking as R
from peakloom.operators import signal as G
from peakloom.operators.grouping import infer_groups
from peakloom.streaming import accumulate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with the equivalent SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the shared tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scored_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored rows: value is the score, errors are decoys."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", F.col("value").alias("proba"), (F.col("event_type") == "error").cast("int").alias("decoy"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best scored row per user and type, q-values, and the rows that pass."""
    best = R.keep_best(scored_events(spark, sf_dir), ["user_id", "event_type"], ["proba", "event_id"])
    return R.q_values(best, "proba", "decoy", ["event_id"]).where("qval <= 0.5")


# --- ordered operators ----------------------------------------------------------------------


@query("""
with s as (select event_id, value as proba, case when event_type='error' then 1 else 0 end as decoy from events),
c as (select *, sum(decoy) over w as dc, sum(1-decoy) over w as tc, row_number() over w as rn from s
      window w as (order by proba, decoy, event_id rows between unbounded preceding and current row))
select event_id, decoy, round(min(case when tc=0 then 1e18 else cast(dc as double)/tc end)
  over (order by rn rows between current row and unbounded following),6) as qval from c""")
def q_values(spark, sf_dir):
    """Target-decoy q-values of all events."""
    out = R.q_values(scored_events(spark, sf_dir), "proba", "decoy", ["event_id"])
    return out.select("event_id", "decoy", F.round("qval", 6).alias("qval"))


@query("""
with s as (select event_id, value as proba, case when event_type='error' then 1 else 0 end as decoy from events),
c as (select *, sum(decoy) over w as dc, sum(1-decoy) over w as tc, row_number() over w as rn from s
      window w as (order by proba, decoy, event_id rows between unbounded preceding and current row))
select event_id, round(min(0.25*dc/(tc+1e-6)) over (order by rn rows between current row and unbounded following),6) as qval from c""")
def q_values_scaled(spark, sf_dir):
    """Q-values with a damped denominator and a target-decoy ratio."""
    out = R.q_values(scored_events(spark, sf_dir), "proba", "decoy", ["event_id"], scale=0.25, epsilon=1e-6)
    return out.select("event_id", F.round("qval", 6).alias("qval"))


@query("""select user_id, event_type, event_id, value as proba from
(select *, row_number() over (partition by user_id, event_type order by value, event_id) rn from events) where rn = 1""")
def keep_best(spark, sf_dir):
    """Best event per user and type."""
    return R.keep_best(scored_events(spark, sf_dir), ["user_id", "event_type"], ["proba", "event_id"]).select("user_id", "event_type", "event_id", "proba")


@query("""with r as (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) rn from lineitem)
select l_orderkey, l_linenumber, l_extendedprice from r where rn <= 2 or l_discount > 0.05""")
def quality_filter(spark, sf_dir):
    """Two dearest lines per order, or well discounted ones."""
    t = table(spark, sf_dir, "lineitem")
    out = R.rank_or_quality(t, ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber"], 2, F.col("l_discount") > 0.05)
    return out.select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("""select l_orderkey, l_linenumber, dense_rank() over (order by l_orderkey, l_returnflag, l_linenumber) - 1 as group_id from lineitem""")
def score_groups(spark, sf_dir):
    """Dense numbers of (order, flag, line)."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber")
    return R.dense_groups(t, ["l_orderkey", "l_returnflag", "l_linenumber"]).select("l_orderkey", "l_linenumber", "group_id")


@query("""select l_partkey, l_orderkey, l_linenumber, l_extendedprice from (select *, row_number() over (partition by l_partkey order by l_extendedprice, l_orderkey, l_linenumber) rn from lineitem) where rn <= 3""")
def transfer_top_n(spark, sf_dir):
    """Three cheapest lines per part."""
    out = R.keep_best(table(spark, sf_dir, "lineitem"), ["l_partkey"], ["l_extendedprice", "l_orderkey", "l_linenumber"], 3)
    return out.select("l_partkey", "l_orderkey", "l_linenumber", "l_extendedprice")


@query("""with f as (select min(struct_pack(v := value, e := event_id)) k from events where value >= 90)
select event_id, value from events, f where k is null or struct_pack(v := value, e := event_id) < k""")
def prefix_below(spark, sf_dir):
    """Rows before the first that reaches a limit."""
    return R.prefix_below(table(spark, sf_dir, "events").select("event_id", "value"), "value", 90.0, ["value", "event_id"])


@query("""select event_id, value from events where event_type <> 'error' order by value desc, event_id limit 500""")
def fragment_calib_topk(spark, sf_dir):
    """The 500 highest of the filtered rows (a top-k report)."""
    return R.top_rows(table(spark, sf_dir, "events"), [F.desc("value"), "event_id"], 500, F.col("event_type") != "error").select("event_id", "value")


# --- joins and sets -------------------------------------------------------------------------


@query("""with spec as (select l_partkey k, median(l_quantity) v from lineitem where l_returnflag='R' and l_discount>0.09 group by 1),
fb as (select p_brand b, median(l_quantity) v from lineitem join part on l_partkey=p_partkey group by 1)
select p_partkey, round(coalesce(spec.v,fb.v),6) v from part left join spec on p_partkey=spec.k left join fb on p_brand=fb.b""")
def fallback_lookup(spark, sf_dir):
    """Median quantity of the part, else of its brand."""
    lines, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")
    own = lines.where("l_returnflag = 'R' AND l_discount > 0.09").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.median("l_quantity").alias("v"))
    brand = lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy("p_brand").agg(F.median("l_quantity").alias("v"))
    out = J.lookup_with_fallback(part.select("p_partkey", "p_brand"), own, brand, key="p_partkey", fallback_key="p_brand", value="v", out="found")
    return out.select("p_partkey", F.round("found", 6).alias("v"))


@query("""select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_totalprice < 50000)""")
def fdr_semi_filter(spark, sf_dir):
    """Lines of cheap orders."""
    keys = table(spark, sf_dir, "orders").where("o_totalprice < 50000").select(F.col("o_orderkey").alias("l_orderkey"))
    return J.only_keys(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), keys, ["l_orderkey"])


@query("""select c_custkey from customer except select o_custkey from orders where o_totalprice > 300000""")
def missing_channels(spark, sf_dir):
    """Customers without a large order."""
    some = table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    return J.without_keys(table(spark, sf_dir, "customer").select("c_custkey"), some, ["c_custkey"])


@query("""select l_orderkey, l_linenumber, o_orderstatus, o_totalprice from lineitem left join orders on l_orderkey = o_orderkey""")
def merge_missing(spark, sf_dir):
    """Missing columns of an order joined to its lines."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    return J.merge_missing_columns(lines, orders, ["l_linenumber", "o_orderstatus", "o_totalprice"], ["l_orderkey"])


@query("""with w as (select r_regionkey wi, r_regionkey*20.0 lo, r_regionkey*20.0+20.0 hi from region)
select event_id, coalesce(min(wi),0) window_idx from events left join w on value>=lo and value<hi group by 1""")
def window_idx(spark, sf_dir):
    """First interval that holds a value."""
    return J.window_index(table(spark, sf_dir, "events"), "value", [(20.0 * i, 20.0 * i + 20.0) for i in range(5)]).select("event_id", "window_idx")


@query("""select a.l_orderkey k, a.l_suppkey s, a.l_linenumber i, b.l_linenumber j from lineitem a join lineitem b on a.l_suppkey=b.l_suppkey
  and a.l_orderkey=b.l_orderkey and a.l_linenumber<b.l_linenumber and abs(a.l_quantity-b.l_quantity)<3""")
def competition_pairs(spark, sf_dir):
    """Lines of one order and supplier with close quantities."""
    out = J.close_pairs(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_suppkey"], "l_quantity", "l_linenumber", 3.0)
    return out.select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("s"), F.col("l_linenumber_1").alias("i"), F.col("l_linenumber_2").alias("j"))


@query("""select a.event_id a_id, b.event_id b_id from events a join events b on a.user_id = b.user_id and a.event_id < b.event_id
  and abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 600000000""")
def rt_band_pairs(spark, sf_dir):
    """Events of one user within ten minutes."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", (F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"))
    pairs = J.band_join(e.withColumnsRenamed({"event_id": "a_id", "t": "ta"}), e.withColumnsRenamed({"event_id": "b_id", "t": "tb"}), "ta", "tb", width=600_000_000, on=["user_id"])
    return pairs.where("a_id < b_id").select("a_id", "b_id")


@query("""select e.event_id, o.o_orderkey from events e join orders o on abs(e.value - o.o_totalprice / 1000) <= o.o_totalprice / 1000 * 20 * 1e-6""")
def mz_band_join(spark, sf_dir):
    """Values within 20 ppm of a scaled price."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("mz"))
    return J.band_join(table(spark, sf_dir, "events").select("event_id", "value").where("value > 0"), o, "value", "mz", ppm=20).select("event_id", "o_orderkey")


@query("""with p as (select p_partkey, p_size * 1.0 lo, p_size + 1.5 hi from part), s as (select s_suppkey, s_acctbal / 200 a, s_acctbal / 200 + 0.25 b from supplier)
select p_partkey, s_suppkey from p join s on lo <= b and a <= hi""")
def interval_overlap(spark, sf_dir):
    """Overlapping size and balance intervals."""
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 1.0).alias("lo"), (F.col("p_size") + 1.5).alias("hi"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 200).alias("a"), (F.col("s_acctbal") / 200 + 0.25).alias("b"))
    return J.interval_overlap_join(p, s, ("lo", "hi"), ("a", "b"), 2.0).select("p_partkey", "s_suppkey")


@query("""with b as (select o_custkey,o_orderkey,o_totalprice,row_number() over (partition by o_custkey order by o_totalprice,o_orderkey) rn from orders),
ch as (select distinct o_custkey, o_orderpriority from orders)
select b.o_custkey, ch.o_orderpriority, o_orderkey, o_totalprice from b join ch on b.o_custkey = ch.o_custkey where rn=1 and o_orderpriority <> '5-LOW'""")
def multiplex_expand(spark, sf_dir):
    """The best order of a customer for each priority that the customer has used."""
    o = table(spark, sf_dir, "orders")
    channels = sorted(r[0] for r in o.select("o_orderpriority").distinct().collect())
    best = o.select("o_custkey", "o_orderkey", "o_totalprice")
    library = o.select("o_custkey", "o_orderpriority").distinct()
    return J.multiplex(best, library, group="o_custkey", channel="o_orderpriority", order=["o_totalprice", "o_orderkey"], channels=[c for c in channels if c != "5-LOW"])


# --- aggregates -----------------------------------------------------------------------------


def _psm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as rows of a search: flags are groups, parts precursors, suppliers peptides."""
    t = table(spark, sf_dir, "lineitem")
    return t.select(
        "l_orderkey", F.col("l_returnflag").alias("pg"), (F.col("l_linestatus") == "O").cast("int").alias("decoy"), F.col("l_partkey").alias("precursor_idx"), F.col("l_suppkey").alias("sequence"),
        F.col("l_linenumber").alias("run"), F.col("l_discount").alias("proba"), F.col("l_returnflag").alias("genes"), F.col("l_linestatus").alias("proteins"),
    )


@query("""select l_returnflag pg, cast(l_linestatus='O' as int) decoy, count(*) n_rows, count(distinct l_partkey) n_precursors, count(distinct l_suppkey) n_peptides,
count(distinct l_linenumber) n_runs, round(avg(l_discount),6) mean_score, min(l_discount) best_score, max(l_discount) worst_score from lineitem group by 1, 2""")
def protein_features(spark, sf_dir):
    """Evidence per group."""
    return A.protein_features(_psm(spark, sf_dir)).withColumn("mean_score", F.round("mean_score", 6)).drop("genes", "proteins")


@query("""with b as (select n_name run, c channel from nation, (select 0 c union all select 1 union all select 9)),
s as (select n_name run, cast(l_linestatus='O' as int) channel, count(*) n, count(distinct l_returnflag) n_pg from lineitem join supplier on l_suppkey=s_suppkey join nation on s_nationkey=n_nationkey group by 1,2)
select b.run, b.channel, coalesce(n,0) n, coalesce(n_pg,0) n_pg from b left join s on b.run = s.run and b.channel = s.channel""")
def run_channel_stats(spark, sf_dir):
    """Rows and groups per run and channel, empty ones included."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("run"))
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    psm = lines.select("run", (F.col("l_linestatus") == "O").cast("int").alias("channel"), F.col("l_returnflag").alias("pg"), F.col("l_tax").alias("cycle_fwhm"), F.col("l_tax").alias("mobility_fwhm"))
    return A.run_statistics(psm, nation, [0, 1, 9]).select("run", "channel", "n", "n_pg")


@query("""select p_brand, round(median(p_retailprice),6) med, round(quantile_cont(p_retailprice,0.9),6) p90 from part group by 1""")
def median_stats(spark, sf_dir):
    """Median and percentile per brand."""
    p = A.group_quantiles(table(spark, sf_dir, "part"), ["p_brand"], "p_retailprice", {"m": 0.5, "p": 0.9})
    return p.select("p_brand", F.round("m", 6).alias("med"), F.round("p", 6).alias("p90"))


@query("""select modification, count(*) n from (select unnest(list_distinct(string_split(lang || ';' || source, ';'))) modification from documents) group by 1
union all select 'unmodified', 0 union all select 'Total', count(*) from documents""")
def mods_explode(spark, sf_dir):
    """Rows per item of a joined list, with totals."""
    d = table(spark, sf_dir, "documents").select(F.concat_ws(";", "lang", "source").alias("mods"))
    return A.modification_counts(d)


@query("""select user_id, count(*) filter (event_type<>'error') targets, count(*) filter (event_type='error') decoys,
count(*) filter (event_type<>'error' and value<=50) "targets_50", count(*) filter (event_type<>'error' and value<=10) "targets_10" from events group by 1""")
def fdr_summary(spark, sf_dir):
    """Targets and decoys per user at limits."""
    return A.fdr_summary(scored_events(spark, sf_dir), ["user_id"], qval="proba", limits=(50.0, 10.0))


@query("""with m as (select avg(l_quantity) m from lineitem)
select round((abs(quantile_cont(l_quantity - m, 0.025)) + abs(quantile_cont(l_quantity - m, 0.975))) / 2, 6) ci from lineitem, m""")
def calibration_ci(spark, sf_dir):
    """Half width that holds 95 % of residuals."""
    t = table(spark, sf_dir, "lineitem")
    r = t.join(F.broadcast(t.agg(F.avg("l_quantity").alias("m")))).select((F.col("l_quantity") - F.col("m")).alias("r"))  # one row
    return A.residual_interval(r, "r").select(F.round("ci", 6).alias("ci"))


@query("""with m as (select l_orderkey k, median(l_quantity) md from lineitem where l_quantity>0 group by 1)
select l_orderkey,l_linenumber,case when l_quantity>0.75*md then l_quantity else 0.0 end q, md>20 u from lineitem join m on l_orderkey=k""")
def ms2_qc(spark, sf_dir):
    """Weak lines of an order set to zero."""
    out = A.quality_control(table(spark, sf_dir, "lineitem"), ["l_orderkey"], intensity="l_quantity", least=20.0)
    return out.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("q"), F.col("use").alias("u"))


@query("""select cast(floor(l_discount/0.01) as bigint) bin, cast(sum(cast(l_returnflag<>'R' as int)) as bigint) t, cast(sum(cast(l_returnflag='R' as int)) as bigint) d from lineitem group by 1""")
def pep_histogram(spark, sf_dir):
    """Targets and decoys per score bin."""
    return A.score_histogram(table(spark, sf_dir, "lineitem"), "l_discount", F.col("l_returnflag") == "R", 0.01)


@query("""select user_id, round(case when (count(*)*sum(value*value)-sum(value)*sum(value)) > 0 then corr(value, event_id) else 0 end, 4) r from events group by 1""")
def safe_pearson(spark, sf_dir):
    """Correlation per user, 0 where nothing varies."""
    e = table(spark, sf_dir, "events").withColumn("id", F.col("event_id").cast("double"))
    return e.groupBy("user_id").agg(F.round(S.safe_pearson("value", "id"), 4).alias("r"))


@query("""select l_returnflag, round(sum(l_extendedprice*l_quantity)/sum(l_quantity),4) centre from lineitem group by 1""")
def weighted_centre(spark, sf_dir):
    """Quantity-weighted mean price."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(S.weighted_mean("l_extendedprice", "l_quantity"), 4).alias("centre"))


# --- quantities -----------------------------------------------------------------------------


@query("""select l_partkey, coalesce(sum(l_quantity) filter (l_returnflag='A'),0) "A", coalesce(sum(l_quantity) filter (l_returnflag='N'),0) "N", coalesce(sum(l_quantity) filter (l_returnflag='R'),0) "R" from lineitem group by 1""")
def fragment_accumulate(spark, sf_dir):
    """Sums per part and flag, missing ones 0."""
    return Q.accumulate(table(spark, sf_dir, "lineitem"), ["l_partkey"], "l_returnflag", "l_quantity", ["A", "N", "R"])


@query("""select p_brand, 'avg_price' run, round(avg(p_retailprice),6) intensity from part group by 1 union all select p_brand, 'avg_size', round(avg(p_size),6) from part group by 1""")
def melt_levels(spark, sf_dir):
    """Brand averages in long form."""
    wide = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.round(F.avg("p_retailprice"), 6).alias("avg_price"), F.round(F.avg("p_size"), 6).alias("avg_size"))
    return Q.melt(wide, ["p_brand"])


@query("""with m as (select l_orderkey, l_suppkey, avg(l_extendedprice) q from lineitem group by 1,2),
k as (select *, row_number() over (partition by l_orderkey order by q desc, l_suppkey) rn from m)
select l.l_orderkey, l.l_suppkey, l.l_linenumber from lineitem l join k on l.l_orderkey=k.l_orderkey and l.l_suppkey=k.l_suppkey where rn<=1 or q>60000""")
def ion_filter(spark, sf_dir):
    """Rows of the best or good ions."""
    return Q.filter_ions(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_suppkey", "l_extendedprice", top_n=1, min_quality=60000.0).select("l_orderkey", "l_suppkey", "l_linenumber")


def _polish(rounds: int) -> str:
    """SQL of the rounds of a median polish that starts from ``a0(g, i, r, x, p)``."""
    steps = [f"""s{k} as (select g, i, r, x, p, median(x - p) over (partition by g, i) s from a{k}),
a{k + 1} as (select g, i, r, x, median(x - s) over (partition by g, r) p from s{k})""" for k in range(rounds)]
    return ",\n".join(steps)


@query(f"""with long as (select p_brand g, l_partkey i, cast(l_linenumber as int) r, sum(l_extendedprice) v from lineitem join part on l_partkey = p_partkey group by 1, 2, 3),
logs as (select *, log2(v) lg from long where v > 0), means as (select i, avg(lg) m from logs group by 1 having count(*) > 1),
moved as (select r, median(lg - m) s from logs join means using (i) group by 1),
a0 as (select g, i, r, max(lg - coalesce(s, 0)) x, 0.0::double p from logs left join moved using (r) group by g, i, r),
{_polish(4)},
runs as (select g, r, min(p) p, sum(pow(2.0, x)) t from a4 group by 1, 2)
select g p_brand, r run, round(log2(pow(2.0, p) * sum(t) over (partition by g) / sum(pow(2.0, p)) over (partition by g)), 6) log_intensity from runs""")
def lfq(spark, sf_dir):
    """Label-free quantities of brands over line numbers."""
    t = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    long = t.groupBy("p_brand", "l_partkey", F.col("l_linenumber").cast("int").alias("run")).agg(F.sum("l_extendedprice").alias("v"))
    return Q.label_free(long, "p_brand", "l_partkey", "run", "v").select("p_brand", "run", F.round(F.log2("intensity"), 6).alias("log_intensity"))


@query("""select distinct l_partkey, l_returnflag as run, round(sum(l_quantity) over (partition by l_partkey, l_returnflag), 6) precursor_intensity,
round(sum(l_quantity) over (partition by l_suppkey % 5, l_returnflag), 6) pg_intensity, l_suppkey % 5 as pg from lineitem""")
def merge_levels(spark, sf_dir):
    """Quantities of parts and of groups of suppliers joined to rows by run."""
    t = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_returnflag").alias("run"), (F.col("l_suppkey") % 5).alias("pg"), "l_quantity")
    wide = lambda key: (key, Q.accumulate(t, [key], "run", "l_quantity", ["A", "N", "R"]))
    out = Q.merge_levels(t.select("l_partkey", "run", "pg").distinct(), {"precursor": wide("l_partkey"), "pg": wide("pg")})
    return out.withColumns({c: F.round(c, 6) for c in ("precursor_intensity", "pg_intensity")})


# --- signals and scalars --------------------------------------------------------------------


@query("""with x as (select user_id, value v, lag(value) over w pv, epoch(ts) t, lag(epoch(ts)) over w pt from events
  window w as (partition by user_id order by ts,event_id)) select user_id, round(sum((v+pv)*0.5*(t-pt)),2) area from x group by 1""")
def trapezoid_area(spark, sf_dir):
    """Area under each user's values."""
    t = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return G.trapezoid_area(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], t, "value").select("user_id", F.round("area", 2).alias("area"))


@query("""with x as (select user_id,event_id,value v,lag(value,1) over w a,lag(value,2) over w b,lead(value,1) over w c,lead(value,2) over w d
  from events window w as (partition by user_id order by ts,event_id)) select user_id,event_id from x where b<a and a<v and v>c and c>d""")
def local_peaks(spark, sf_dir):
    """Five-point maxima of each user's values."""
    return G.local_peaks(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id")


@query("""with x as (select user_id, event_id, value v, lag(value) over w a, lead(value) over w c from events window w as (partition by user_id order by ts,event_id))
select user_id, event_id, case when (v<a or v<c) and a is not null and c is not null then (a+c)/2 else v end as value from x""")
def envelope(spark, sf_dir):
    """Dips filled from both sides."""
    return G.fill_dips(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value").select("user_id", "event_id", "value")


@query("""with x as (select event_id i, cast(user_id as double)-avg(cast(user_id as double)) over () d from events)
select b.i-a.i lag, round(sum(a.d*b.d)/max(z.s),6) r from x a join x b on b.i-a.i between 0 and 20 cross join (select sum(d*d) s from x) z group by 1""")
def autocorrelation(spark, sf_dir):
    """Autocorrelation of the user sequence."""
    return G.autocorrelation(table(spark, sf_dir, "events"), "event_id", "user_id", 20).select("lag", F.round("r", 6).alias("r"))


@query("""with m as (select percentile_cont(0.001) within group (order by l_extendedprice) lo, percentile_cont(0.999) within group (order by l_extendedprice) hi from lineitem)
select l_orderkey,l_linenumber, round(least(greatest(l_extendedprice,lo),hi),4) v from lineitem cross join m""")
def rt_percentile_clip(spark, sf_dir):
    """Prices limited to two percentiles."""
    return L.clip_times(table(spark, sf_dir, "lineitem"), "l_extendedprice").select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 4).alias("v"))


@query("""with m as (select max(o_totalprice) mo, max(o_totalprice * 0.9 + 1000) mc from orders)
select o_orderkey, round((1 - o_totalprice/mo) * ((o_totalprice*0.9+1000)/mc) + (o_totalprice/mo)*(o_totalprice/mo), 9) rt_norm from orders, m""")
def rt_norm_delta(spark, sf_dir):
    """Blend of two max-normalised columns."""
    o = table(spark, sf_dir, "orders").withColumn("c", F.col("o_totalprice") * 0.9 + 1000)
    return L.blend_times(o, "o_totalprice", "c").select("o_orderkey", F.round("rt_norm", 9).alias("rt_norm"))


@query("""select l_orderkey, l_linenumber, l_partkey + (cast(l_linenumber as bigint) << 32) as hash from lineitem""")
def candidate_hash(spark, sf_dir):
    """Part and line in one number."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.candidate_hash(F.col("l_partkey"), F.col("l_linenumber")).alias("hash"))


@query("""select doc_id, cast(length(text) - length(replace(text, 'K', '')) as int) n_k from documents""")
def seq_char_count(spark, sf_dir):
    """Number of one letter."""
    return table(spark, sf_dir, "documents").select("doc_id", S.count_of(F.col("text"), "K").alias("n_k"))


@query("""select event_id, cast(json_extract_string(props, '$.k') as int) k from events""")
def props_json(spark, sf_dir):
    """A field of a JSON column."""
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("""select a.vec_id, round(list_dot_product(a.embedding::double[], b.embedding::double[]) / (sqrt(list_dot_product(a.embedding::double[], a.embedding::double[]))
  * sqrt(list_dot_product(b.embedding::double[], b.embedding::double[])) + 1e-4), 6) c from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def embedding_cosine(spark, sf_dir):
    """Damped cosine of each vector with the next one."""
    e = table(spark, sf_dir, "embeddings")
    after = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(after, "vec_id").select("vec_id", F.round(S.cosine(F.col("embedding"), F.col("other")), 6).alias("c"))


@query("""select p_partkey, round(p_retailprice + 3*1.0033548350700006/2, 6) mz3 from part""")
def isotope_mz(spark, sf_dir):
    """Fourth isotope position."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(S.isotope_mz(F.col("p_retailprice"), F.lit(2), 4)[3], 6).alias("mz3"))


# --- kernels that SQL cannot express ----------------------------------------------------------


@query()
def protein_inference(spark, sf_dir):
    """Set cover of orders by the brands of their parts."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type")
    ids = table(spark, sf_dir, "lineitem").join(part, "l_partkey").groupBy(F.col("l_orderkey").alias("precursor_idx")).agg(
        F.array_join(F.array_sort(F.collect_set(F.concat("p_brand", "p_type"))), ";").alias("proteins"), F.lit(0).alias("decoy"))
    return infer_groups(ids).select("precursor_idx", "pg_master", "pg")


@query()
def fragment_competition(spark, sf_dir):
    """Orders of a month that share line quantities compete by price."""
    o = table(spark, sf_dir, "orders")
    psm = o.select(F.col("o_orderkey").alias("id"), F.month("o_orderdate").alias("window_idx"), F.dayofmonth("o_orderdate").cast("double").alias("rt"), F.col("o_totalprice").alias("proba"))
    frag = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_extendedprice").alias("mz"))
    return X.compete(psm, frag, rt=3.0, least=1)


@query("""with e as (select quantile_disc(l_quantity, 0.001)::double lo, quantile_disc(l_quantity, 0.999)::double hi from lineitem),
k as (select i, lo + (hi - lo) / 5 * i c, 1.5 * (hi - lo) / 5 v, lo, hi from e, (select unnest(range(0, 6)) i)),
x as (select l_quantity::double x, count(*) n, sum(l_extendedprice)::double y from lineitem group by 1),
g as (select i, c, v, x, n, y, (x - c) / v z, pow(1 - pow(least(abs(least(greatest(x, lo), hi) - c) / v, 1), 3), 3) w from x, k),
s as (select i, sum(w*n) s0, sum(w*n*z) s1, sum(w*n*z*z) s2, sum(w*n*pow(z,3)) s3, sum(w*n*pow(z,4)) s4, sum(w*y) t0, sum(w*z*y) t1, sum(w*z*z*y) t2 from g group by 1),
b as (select i, s0*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) d, t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2) d0,
 s0*(t1*s4-s3*t2) - t0*(s1*s4-s2*s3) + s2*(s1*t2-t1*s2) d1, s0*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2) d2 from s),
f as (select x, sum(w * (d0 + d1*z + d2*z*z) / d) / sum(w) fit from g join b using (i) group by 1)
select l_orderkey, l_linenumber, round(fit, 2) fit from lineitem join f on l_quantity = x""")
def loess_calibration(spark, sf_dir):
    """Price by quantity, smoothed."""
    t = table(spark, sf_dir, "lineitem")
    model = C.fit_local(t, "l_quantity", "l_extendedprice")
    return t.select("l_orderkey", "l_linenumber", F.round(model.predict(F.col("l_quantity")), 2).alias("fit"))


@query()
def psm_classifier(spark, sf_dir):
    """Returned lines as decoys: probabilities and q-values of the best line per part."""
    t = table(spark, sf_dir, "lineitem").withColumn("decoy", (F.col("l_returnflag") == "R").cast("int")).withColumnRenamed("l_partkey", "precursor_idx")
    rows = t.select("precursor_idx", "decoy", "l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return E.control(rows, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], keys=["precursor_idx", "decoy"], idx="l_orderkey").select("precursor_idx", "decoy", "proba", "qval")


@query()
def candidate_selection(spark, sf_dir):
    """Peaks of users' events, types as fragments and hours as cycles."""
    e = table(spark, sf_dir, "events")
    traces = e.groupBy(F.col("user_id").alias("precursor_idx"), F.col("event_type").alias("fragment"), (F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).cast("long").alias("cycle")).agg(
        F.sum("value").alias("intensity"), F.avg("value").alias("mz"))
    return K.select(traces, K.Selection(least_fragments=2))


@query()
def candidate_scoring(spark, sf_dir):
    """Features of those peaks."""
    e = table(spark, sf_dir, "events")
    traces = e.groupBy(F.col("user_id").alias("precursor_idx"), F.col("event_type").alias("fragment"), (F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400).cast("long").alias("cycle")).agg(
        F.sum("value").alias("intensity"), F.avg("value").alias("mz"))
    traces = traces.withColumn("mz_library", F.col("mz"))
    library = traces.groupBy("precursor_idx", "fragment").agg(F.max("mz_library").alias("mz_library"), F.avg("intensity").alias("intensity_library"))
    return K.score_candidates(traces, K.select(traces, K.Selection(least_fragments=2)), library)


# --- further operators ------------------------------------------------------------------------


@query("""with p as (select user_id, epoch_us(ts) a, epoch_us(ts) + cast(floor(value) as bigint) * 600000000 b, event_id from events),
g as (select *, case when a <= max(b) over (partition by user_id order by a, event_id rows between unbounded preceding and 1 preceding) then 0 else 1 end n0 from p),
i as (select *, sum(n0) over (partition by user_id order by a, event_id rows between unbounded preceding and current row) box from g)
select user_id, min(a) a, max(b) b, count(*) n from i group by user_id, box""")
def merge_boxes(spark, sf_dir):
    """Overlapping boxes of a user merged."""
    a = F.unix_micros(F.col("ts").cast("timestamp"))
    e = table(spark, sf_dir, "events").select("user_id", "event_id", a.alias("a"), (a + F.floor("value") * 600_000_000).alias("b"))
    return G.merge_boxes(e, ["user_id"], "a", "b", ["event_id"])


@query("""with t as (select *, row_number() over (partition by l_orderkey order by l_extendedprice desc, l_linenumber) rn from lineitem)
select l_orderkey, l_linenumber, round(l_extendedprice / sum(l_extendedprice) over (partition by l_orderkey), 9) share from t where rn <= 3""")
def fragment_top_share(spark, sf_dir):
    """Three dearest lines per order as shares."""
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    out = G.normalised_top(t, ["l_orderkey"], "l_extendedprice", ["l_linenumber"], 3)
    return out.select("l_orderkey", "l_linenumber", F.round("l_extendedprice", 9).alias("share"))


@query("""with x as (select l_quantity y, l_extendedprice/1000 p from lineitem)
select 'r_square' metric, round(regr_r2(p, y), 6) as value from x union all select 'r_slope', round(regr_slope(p, y), 6) from x
union all select 'l1', round(avg(abs(p-y)), 6) from x union all select 'abs_error_95', round(quantile_cont(abs(p-y), 0.95), 6) from x""")
def regression_metrics(spark, sf_dir):
    """Metrics of a prediction in long form."""
    t = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("y"), (F.col("l_extendedprice") / 1000).alias("p"))
    return A.regression_metrics(t, "y", "p").select("metric", F.round("value", 6).alias("value"))


@query("""with x as (select cast(l_returnflag='R' as int) y, l_discount*10 p from lineitem), h as (select y, p >= 0.5 h, least(greatest(p,1e-12),1-1e-12) s from x)
select 'accuracy' metric, round(avg(cast(h = (y=1) as int)), 6) as value from h
union all select 'precision', round(count(*) filter (h and y=1) / count(*) filter (h), 6) from h
union all select 'recall', round(count(*) filter (h and y=1) / count(*) filter (y=1), 6) from h
union all select 'bce', round(avg(-case when y=1 then ln(s) else ln(1-s) end), 6) from h""")
def classification_metrics(spark, sf_dir):
    """Metrics of a classifier in long form."""
    t = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_discount") * 10).alias("p"))
    return A.classification_metrics(t, "y", "p").select("metric", F.round("value", 6).alias("value"))


@query("""select 'value' as "column", count(*) filter (value is null or isnan(value) or isinf(value)) n from events""")
def critical_values(spark, sf_dir):
    """Rows with unusable numbers."""
    return A.critical_values(table(spark, sf_dir, "events"), ["value"])


@query("""select count(*) filter (o_orderstatus<>'F') targets, count(*) filter (o_orderstatus='F') decoys, count(distinct o_custkey) elution_groups,
count(distinct o_orderpriority) proteins, count(distinct o_orderstatus) channels from orders""")
def library_stats(spark, sf_dir):
    """Counts of a library."""
    o = table(spark, sf_dir, "orders")
    return A.library_statistics(o.select((F.col("o_orderstatus") == "F").cast("int").alias("decoy"), F.col("o_custkey").alias("elution_group_idx"), F.col("o_orderpriority").alias("proteins"), F.col("o_orderstatus").alias("channel")))


@query("""select c_custkey from customer intersect select o_custkey from orders where o_totalprice > 250000""")
def available_features(spark, sf_dir):
    """Intersection of two key sets."""
    some = table(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("c_custkey"))
    return J.only_keys(table(spark, sf_dir, "customer").select("c_custkey"), some, ["c_custkey"])


@query("""select 'customer' as kind, c_custkey as id from customer union all select 'supplier', s_suppkey from supplier""")
def union_runs(spark, sf_dir):
    """Rows of several tables in one."""
    c = table(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"))
    return c.unionByName(table(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id")))


@query("""with m as (select min(o_totalprice) lo, max(o_totalprice) hi from orders) select o_orderkey, round((o_totalprice-lo)/(hi-lo)*(1200-60)+60, 6) rt from orders, m""")
def rt_scale(spark, sf_dir):
    """Prices mapped to a range of times."""
    o = table(spark, sf_dir, "orders")
    ends = o.agg(F.min("o_totalprice").alias("lo"), F.max("o_totalprice").alias("hi"))
    scaled = S.min_max_scale(F.col("o_totalprice"), F.col("lo"), F.col("hi"), F.lit(60.0), F.lit(1200.0))
    return o.join(F.broadcast(ends)).select("o_orderkey", F.round(scaled, 6).alias("rt"))  # one row


@query("""select l_orderkey, l_linenumber, round((l_extendedprice - l_quantity*1000)/(l_quantity*1000)*1e6, 3) ppm,
round(1/(1+exp(-(l_quantity-20)/3)) - 1/(1+exp(-(l_quantity-40)/5)), 9) q from lineitem""")
def deviation_and_rectangle(spark, sf_dir):
    """Relative deviation, and a logistic rectangle."""
    t = table(spark, sf_dir, "lineitem")
    ppm = S.ppm_error(F.col("l_extendedprice"), F.col("l_quantity") * 1000)
    return t.select("l_orderkey", "l_linenumber", F.round(ppm, 3).alias("ppm"), F.round(S.logistic_rectangle(F.col("l_quantity"), 20, 40, 3, 5), 9).alias("q"))


@query("""select vec_id, round(len(list_filter(embedding, lambda x: x > list_max(embedding)/2)) / len(embedding) * 3.0, 9) w from embeddings""")
def profile_width(spark, sf_dir):
    """Share of a profile above half of its maximum."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(S.above_half(F.col("embedding"), 3.0), 9).alias("w"))


@query("""select event_id, user_id, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events""")
def running_index(spark, sf_dir):
    """Number of an event within its user."""
    return A.running_order(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "i").select("event_id", "user_id", F.col("i").cast("long").alias("i"))


@query("""select time_bucket(interval '1 hour', ts) as start, event_type, count(*) n from events group by 1, 2""")
def extra_tumbling(spark, sf_dir):
    """Events per hour and type (an addition)."""
    return accumulate.tumbling_counts(table(spark, sf_dir, "events"), "ts", "event_type", "1 hour")


@query("""with g as (select user_id, ts, case when ts < lag(ts) over w + interval '6 hours' then 0 else 1 end n from events window w as (partition by user_id order by ts)),
s as (select user_id, ts, sum(n) over (partition by user_id order by ts rows between unbounded preceding and current row) k from g)
select user_id, min(ts) as start, max(ts) + interval '6 hours' as "end", count(*) n from s group by user_id, k""")
def extra_sessions(spark, sf_dir):
    """Sessions of users (an addition)."""
    return accumulate.sessions(table(spark, sf_dir, "events"), "ts", "user_id", "6 hours")


@query("""with s as (select event_id, value v, cast(event_type = 'error' as int) d from events), e as (select min(v) lo, max(v) hi from s),
b as (select event_id, d, cast(least(floor((v - lo) / greatest(hi - lo, 1e-12) * 100), 99) as int) bin from s, e),
c as (select bin, cast(sum(d) as double) d, cast(sum(1 - d) as double) t from b group by 1),
m as (select bin + k bin, sum(d * exp(-k * k / 32.0)) d, sum(t * exp(-k * k / 32.0)) t from c, (select unnest(range(-20, 21)) k) group by 1)
select event_id, round(least(1.0, coalesce(m.d / nullif(m.t, 0), 1.0)), 6) pep from b left join m using (bin)""")
def pep(spark, sf_dir):
    """Posterior errors of scored events."""
    out = A.posterior_error(scored_events(spark, sf_dir), "proba", "decoy")
    return out.select("event_id", F.round("pep", 6).alias("pep"))


# --- libraries --------------------------------------------------------------------------------


@query(r"""with p as (select cast(doc_id as varchar) protein, list_filter(string_split(replace(regexp_replace(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '([KR])', '\1|', 'g'), '|P', 'P'), '|'), lambda x: x <> '') w from documents),
s as (select distinct protein, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || w[i + 1])) peptide from p where len(w) > 0)
select peptide, array_to_string(list_sort(list(protein)), ';') proteins from s where length(peptide) between 7 and 35 and not regexp_matches(peptide, '[BJXZ]') group by 1""")
def digest(spark, sf_dir):
    """Letters of texts as proteins, digested."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("protein"), F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("sequence"))
    return L.digest(d)


@query("""with s as (select p_partkey, upper(replace(p_name || p_type, ' ', '')) q from part), n as (select *, length(q) n from s)
select p_partkey, q sequence, 0 decoy from n union all
select p_partkey, case when n >= 5 then q[1:1] || translate(q[2:2], 'GAVLIFMPWSCTYHKRQEND', 'LLLVVLLLLTSSSSLLNDQE') || substr(q, 3, n - 4) || translate(substr(q, n - 1, 1), 'GAVLIFMPWSCTYHKRQEND', 'LLLVVLLLLTSSSSLLNDQE') || substr(q, n, 1) else q end, 1 from n""")
def add_decoys(spark, sf_dir):
    """Names of parts as sequences, with mutated decoys."""
    return L.add_decoys(table(spark, sf_dir, "part").select("p_partkey", F.upper(F.replace(F.concat("p_name", "p_type"), F.lit(" "), F.lit(""))).alias("sequence")))


@query("""with r(c, nc, nh, nn, no, ns) as (values ('G',2,3,1,1,0),('A',3,5,1,1,0),('S',3,5,1,2,0),('P',5,7,1,1,0),('V',5,9,1,1,0),('T',4,7,1,2,0),('C',3,5,1,1,1),('L',6,11,1,1,0),('I',6,11,1,1,0),('N',4,6,2,2,0),
('D',4,5,1,3,0),('Q',5,8,2,2,0),('K',6,12,2,1,0),('E',5,7,1,3,0),('M',5,9,1,1,1),('H',6,7,3,1,0),('F',9,9,1,1,0),('R',6,12,4,1,0),('Y',9,9,1,2,0),('W',11,10,2,1,0)),
l as (select p_partkey, unnest(string_split(upper(replace(p_name || p_type, ' ', '')), '')) c from part),
n as (select p_partkey, coalesce(sum(nc), 0)::double c, 2 + coalesce(sum(nh), 0)::double h, coalesce(sum(nn), 0)::double n, 1 + coalesce(sum(no), 0)::double o, coalesce(sum(ns), 0)::double s from l left join r using (c) group by 1),
q as (select p_partkey, c * (0.0107/0.9893) + h * (0.000115/0.999885) + n * (0.00364/0.99636) + o * (0.00038/0.99757) + s * (0.0075/0.9499) s1,
 -c * pow(0.0107/0.9893, 2) / 2 - h * pow(0.000115/0.999885, 2) / 2 - n * pow(0.00364/0.99636, 2) / 2 + o * (0.00205/0.99757 - pow(0.00038/0.99757, 2) / 2) + s * (0.0425/0.9499 - pow(0.0075/0.9499, 2) / 2) s2 from n)
select p_partkey, round(1 / (1 + s1 + s2 + s1 * s1 / 2), 9) as first, round((s2 + s1 * s1 / 2) / (1 + s1 + s2 + s1 * s1 / 2), 9) third from q""")
def isotope_pattern(spark, sf_dir):
    """Isotope heights of part names read as peptides, by their elements."""
    part = table(spark, sf_dir, "part")
    p = L.isotope_pattern(F.upper(F.regexp_replace(F.concat("p_name", "p_type"), " ", "")), 3)
    return part.select("p_partkey", F.round(p[0], 9).alias("first"), F.round(p[2], 9).alias("third"))


@query("""with w as (select distinct unnest(string_split(lower(text), ' ')) peptide from benchmark where text is not null)
select peptide, string_agg(cast(doc_id as varchar), ';' order by cast(doc_id as varchar)) proteins from w join (select distinct doc_id, lower(text) t from documents) d on contains(d.t, w.peptide)
where length(peptide) >= 6 group by 1""")
def peptide_annotation(spark, sf_dir):
    """Documents that hold each word of six or more letters of the benchmark, inside words too."""
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), " ")).alias("peptide")).where(F.length("peptide") >= 6)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("protein"), F.lower("text").alias("sequence"))
    return L.annotate(words, docs)


@query("""select l_orderkey, l_linenumber, p_partkey from lineitem join part on abs(l_extendedprice - p_retailprice * 20) <= p_retailprice * 20 * 20e-6""")
def peak_index(spark, sf_dir):
    """Lines priced like twenty of a part, from an index of the lines by price."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("mz"), F.pmod("l_orderkey", F.lit(4096)).alias("cycle"))
    parts = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_retailprice") * 20).alias("mz_library"))
    return I.build_index(lines, ppm=20.0, cycles=1024).near(parts, "mz_library", ppm=20.0).select("l_orderkey", "l_linenumber", "p_partkey")


@query()
def nearest_lfq(spark, sf_dir):
    """Brands over ship years from the prices of their parts."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = lines.select("p_brand", "l_partkey", F.year("l_shipdate").alias("year"), "l_extendedprice")
    return Q.nearest_lfq(rows, "p_brand", "l_partkey", "year", "l_extendedprice").select("p_brand", "year", F.round("intensity", 3).alias("intensity"))


@query()
def density_calibration(spark, sf_dir):
    """Price by quantity, smoothed with kernels at ranks of the quantities."""
    t = table(spark, sf_dir, "lineitem")
    model = C.fit_local(t, "l_quantity", "l_extendedprice", density=True)
    return t.select("l_orderkey", "l_linenumber", F.round(model.predict(F.col("l_quantity")), 3).alias("fit"))


@query()
def quadrupole_transfer(spark, sf_dir):
    """Share of orders above a price by order priority, as transfer curves of windows of one year."""
    o = table(spark, sf_dir, "orders").withColumn("day", F.dayofyear("o_orderdate").cast("double"))
    rows = o.select(F.col("o_orderpriority").alias("window"), "day", ((F.col("day") > 90) & (F.col("day") < 270) & (F.col("o_totalprice") > 20_000)).cast("double").alias("share"))
    names = [r[0] for r in rows.select("window").distinct().collect()]  # a row per window
    curves = C.fit_rectangles(rows, "window", "day", "share", {n: (80.0, 280.0, 5.0, 5.0) for n in names})
    limits = spark.createDataFrame([(n, *C.transfer_limits(c)) for n, c in curves.items()], "window string, low double, high double")
    return rows.join(F.broadcast(limits), "window").where(F.col("day").between(F.col("low"), F.col("high"))).groupBy("window").agg(F.count("*").alias("n"), F.min("day").alias("first"), F.max("day").alias("last"))


@query("""select p_partkey, replace(p_brand, 'Brand#1', 'light') mods, 'a' channel from part union all
select p_partkey, replace(replace(p_brand, 'Brand#1', 'heavy'), '#2', '+2'), 'b' from part""")
def multiplex_library(spark, sf_dir):
    """A copy of the parts per channel with translated brands."""
    lib = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("mods"))
    return L.multiplex_library(lib, {"a": {"Brand#1": "light"}, "b": {"Brand#1": "heavy", "#2": "+2"}})


@query("""with r as (select user_id e, event_id % 7 + user_id * 10 h, value rt, event_type pg, value / 200 q, cast(event_type = 'error' as int) d from events),
f as (select * from r where q <= 0.2), n as (select * from f where d = 0), lib as (select distinct e, h from r),
a as (select h, median(rt) m from f group by 1), b as (select e, median(rt) m from f group by 1),
g as (select e, pg from (select e, pg, row_number() over (partition by e order by h, pg) k from n) where k = 1)
select lib.e elution_group_idx, lib.h mod_seq_charge_hash, round(coalesce(a.m, b.m), 6) rt_library, g.pg from lib join g on lib.e = g.e left join a on lib.h = a.h left join b on lib.e = b.e""")
def match_between_runs(spark, sf_dir):
    """Library of found users with observed values, by hash or else by user."""
    e = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("elution_group_idx"), (F.col("event_id") % 7 + F.col("user_id") * 10).alias("mod_seq_charge_hash"), F.col("value").alias("rt_observed"),
        F.col("event_type").alias("pg"), (F.col("value") / 200).alias("qval"), (F.col("event_type") == "error").cast("int").alias("decoy"))
    out = L.match_between_runs(e, e.select("elution_group_idx", "mod_seq_charge_hash").distinct(), fdr=0.2)
    return out.select("elution_group_idx", "mod_seq_charge_hash", F.round("rt_library", 6).alias("rt_library"), "pg")


@query("""with b as (select event_id, user_id, value + 1 t from (select *, row_number() over (partition by user_id order by value, event_type, event_id) k from events where event_type <> 'error') where k <= 3)
select event_id, user_id, round(t / (select max(t) from b), 9) rt_norm from b""")
def transfer_library(spark, sf_dir):
    """Best three rows per user with normalised times."""
    psm = scored_events(spark, sf_dir).select("event_id", F.col("user_id").alias("mod_seq_hash"), "proba", F.col("event_type").alias("run"), F.col("event_id").alias("precursor_idx"), "decoy", (F.col("proba") + 1).alias("rt_observed"))
    return L.transfer_library(psm).select("event_id", F.col("mod_seq_hash").alias("user_id"), F.round("rt_norm", 9).alias("rt_norm"))


@query("""select c_custkey, count(*) over (partition by c_mktsegment, coalesce(m, '')) n_same, count(*) over (partition by c_mktsegment, coalesce(m, ''), c_nationkey % 4) n_charge
from (select *, case when c_nationkey % 3 = 0 then null else cast(c_nationkey % 3 as varchar) end m from customer)""")
def precursor_hashes(spark, sf_dir):
    """Customers that share a hashed key, with null modifications cleaned."""
    mods = F.when(F.col("c_nationkey") % 3 != 0, (F.col("c_nationkey") % 3).cast("string"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_mktsegment").alias("sequence"), mods.alias("mods"), F.lit(None).cast("string").alias("mod_sites"), (F.col("c_nationkey") % 4).alias("charge"))
    h = L.hash_precursors(c)
    same = lambda k: h.groupBy(k).agg(F.count("*").alias(f"n_{k}"))
    out = h.join(same("mod_seq_hash"), "mod_seq_hash").join(same("mod_seq_charge_hash"), "mod_seq_charge_hash")
    return out.select("c_custkey", F.col("n_mod_seq_hash").alias("n_same"), F.col("n_mod_seq_charge_hash").alias("n_charge"))


# --- more of the operators above --------------------------------------------------------------


@query("""with f as (select event_id slot, user_id u from events where event_id < 7) select event_id from events join f on event_id % 7 = slot where user_id <> u""")
def check_cycle(spark, sf_dir):
    """Events whose user differs from that of the first cycle of seven."""
    return G.check_cycle(table(spark, sf_dir, "events"), "event_id", "user_id", 0, 7).select("event_id")


@query("""select 'l_tax' as "column", round(median(l_tax), 6) as value from lineitem union all select 'l_quantity', round(median(l_quantity), 6) from lineitem""")
def median_known(spark, sf_dir):
    """Medians of columns by ranks of range blocks."""
    found = A.median_known(table(spark, sf_dir, "lineitem"), ["l_tax", "l_quantity"])
    return spark.createDataFrame([(c, round(v, 6)) for c, v in found.items()], "column string, value double")


@query("""select round(median(l_tax), 6) fwhm_rt, round(median(l_discount), 6) fwhm_mobility, round(quantile_cont(l_extendedprice, 0.01) * 0.99, 6) score_cutoff from lineitem""")
def recalibration(spark, sf_dir):
    """Median widths and a score cutoff."""
    t = table(spark, sf_dir, "lineitem").withColumnsRenamed({"l_tax": "cycle_fwhm", "l_discount": "mobility_fwhm"})
    out = A.recalibration(t, score="l_extendedprice")
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("""select l_orderkey, l_linenumber, o_custkey, o_totalprice from lineitem left join orders on l_orderkey = o_orderkey""")
def unique_left_join(spark, sf_dir):
    """Orders joined to lines, one per key."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_totalprice")
    return J.unique_left_join(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), o, ["l_orderkey"])


@query("""select l_orderkey, l_linenumber, l_partkey + (l_linenumber::bigint << 32) + (l_suppkey % 100 << 40) + (cast(l_quantity as bigint) % 5 << 48) as hash from lineitem""")
def ion_hash(spark, sf_dir):
    """Part, line, supplier and quantity in one number."""
    h = S.ion_hash(F.col("l_partkey"), F.col("l_linenumber"), F.col("l_suppkey") % 100, F.col("l_quantity").cast("long") % 5, F.lit(0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", h.alias("hash"))


@query("""select l_returnflag, round(sum(l_discount*l_discount*l_quantity)/sum(l_quantity) - pow(sum(l_discount*l_quantity)/sum(l_quantity), 2), 9) spread from lineitem group by 1""")
def weighted_spread(spark, sf_dir):
    """Quantity-weighted variance of discounts."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(S.weighted_variance("l_discount", "l_quantity"), 9).alias("spread"))


@query("""with e as (select vec_id, list_transform(embedding::double[], lambda x: abs(x)) v from embeddings), m as (select *, list_sum(v[len(v)//2 : len(v)//2 + 2]) / 3 c from e)
select vec_id, round(case when c > 0 then v[1] / c else 0 end, 6) first, round(case when c > 0 then v[len(v)] / c else 0 end, 6) last from m""")
def profile_centre(spark, sf_dir):
    """Profiles over the mean of their centre."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("v"))
    n = S.normalise_profile(F.col("v"))
    return e.select("vec_id", F.round(n[0], 6).alias("first"), F.round(F.element_at(n, -1), 6).alias("last"))


@query("""select doc_id, round(list_sum(list_transform(range(1, 6), lambda i: ln(1 + i * n_chars))), 6) s, replace(replace(lang, 'e', 'E'), 'n', 'N') as tag from documents""")
def log_sum(spark, sf_dir):
    """Sums of logarithms, and translated names."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(S.log_sum(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: (i * F.col("n_chars")).cast("double"))), 6).alias("s"), S.translate_mods(F.col("lang"), {"e": "E", "n": "N"}).alias("tag"))


@query("""with g as (select event_id % 40 a, event_id // 40 b, value v from events),
x as (select *, lag(v) over r r1, lag(v, 2) over r r2, lead(v) over r r3, lead(v, 2) over r r4, lag(v) over c c1, lag(v, 2) over c c2, lead(v) over c c3, lead(v, 2) over c c4,
lag(a) over c a1, lag(b) over r b1 from g window r as (partition by a order by b), c as (partition by b order by a))
select a, b, v from x where r2 < r1 and r1 < v and v > r3 and r3 > r4 and c2 < c1 and c1 < v and v > c3 and c3 > c4""")
def local_peaks_2d(spark, sf_dir):
    """Events laid out as a grid of 40 rows; maxima along both directions."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 40).alias("a"), F.floor(F.col("event_id") / 40).alias("b"), F.col("value").alias("v"))
    return G.local_peaks_2d(e, [], "a", "b", "v")


@query("""with recursive e as (select vec_id, list_transform(embedding::double[], lambda x: abs(x)) v from embeddings),
k as (select vec_id, case when vec_id % 2 = 0 then v else v[1 : len(v) - 1] end v from e),
s as (select vec_id, v, side, case when len(v) % 2 = 1 then len(v) // 2 + 1 when side = -1 then len(v) // 2 else len(v) // 2 + 1 end i0 from k, (values (-1), (1)) t(side)),
r as (select vec_id, side, i0 i, v[i0] x, case when len(v) % 2 = 1 then (v[i0] + v[i0 + side]) / 2 else v[i0] end lim from s
 union all select r.vec_id, r.side, r.i + r.side, least(r.lim, s.v[r.i + r.side]), (least(r.lim, s.v[r.i + r.side]) + r.x) / 2
 from r join s using (vec_id, side) where r.i + r.side between 1 and len(s.v)),
o as (select distinct vec_id, i, x from r)
select vec_id, count(*) n, round(sum(x), 6) total, round(arg_min(x, i), 6) first, round(arg_max(x, i), 6) last from o group by 1""")
def centre_envelope(spark, sf_dir):
    """Profiles of even and odd length that fall off from their centre."""
    v = F.transform("embedding", lambda x: F.abs(x.cast("double")))
    v = F.when(F.col("vec_id") % 2 == 0, v).otherwise(F.slice(v, F.lit(1), F.size(v) - 1))
    e = table(spark, sf_dir, "embeddings").select("vec_id", G.centre_envelope(v).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return e.select("vec_id", F.size("v").cast("long").alias("n"), F.round(total, 6).alias("total"), F.round(F.col("v")[0], 6).alias("first"), F.round(F.element_at("v", -1), 6).alias("last"))


@query("""with p as (select p_partkey, upper(replace(p_name, ' ', '')) q from part),
s as (select p_partkey, q, i place, m.name, m.mass from p, unnest(range(1, len(q) + 1)) t(i), (values ('Oxidation@M', 15.5::double, 'M'), ('Phospho@S', 80.0::double, 'S'), ('Phospho@T', 80.0::double, 'T')) m(name, mass, r) where q[i] = r),
n as (select * from s union all select p_partkey, q, 0, 'Acetyl@Any_N-term', 42.25::double from p),
f as (select p_partkey, string_agg(name, ';' order by i) names, string_agg(i::varchar, ';' order by i) sites, count(*) * 57.0::double mass from
 (select p_partkey, i, 'Carbamidomethyl@C' as name from p, unnest(range(1, len(q) + 1)) t(i) where q[i] = 'C') group by 1),
v as (select p_partkey, null names, null sites, 0.0::double mass from p union all select p_partkey, name, place::varchar, mass from n union all
 select a.p_partkey, a.name || ';' || b.name, a.place || ';' || b.place, a.mass + b.mass from n a join n b on a.p_partkey = b.p_partkey and a.place < b.place)
select v.p_partkey, concat_ws(';', f.names, v.names) mods, concat_ws(';', f.sites, v.sites) mod_sites, round(coalesce(f.mass, 0) + v.mass, 6) mod_mass from v left join f using (p_partkey)""")
def modifications(spark, sf_dir):
    """Names of parts as peptides, with a fixed and up to two variable modifications."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("peptide"))
    variable = {"Oxidation@M": 15.5, "Phospho@S": 80.0, "Phospho@T": 80.0, "Acetyl@Any_N-term": 42.25}
    return L.modify(p, fixed={"Carbamidomethyl@C": 57.0}, variable=variable).select("p_partkey", "mods", "mod_sites", F.round("mod_mass", 6).alias("mod_mass"))


@query("""with r as (select o_custkey g, o_orderkey k, l_linenumber c, round(l_discount, 4) mz from lineitem join orders on l_orderkey = o_orderkey)
select g, k, c, mz from r where (g, mz) in (select (g, mz) from r group by g, mz having count(distinct c) = 1)
and g in (select g from r where c = 3)""")
def channel_ions(spark, sf_dir):
    """Lines of customers that have a third line, without discounts that two line numbers share."""
    lines = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = lines.select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("k"), F.col("l_linenumber").alias("c"), F.round("l_discount", 4).alias("mz"))
    kept = L.unshared_ions(L.with_reference(rows, 3, group="g", channel="c"), group="g", channel="c", mz="mz")
    return kept.select("g", "k", "c", "mz")


@query("""select o_orderkey, o_custkey, o_totalprice rt, cast(o_custkey as double) mz, cast(o_custkey % 5 as double) mobility from orders where o_orderstatus <> 'F'""")
def observed_library(spark, sf_dir):
    """Orders as rows of a library: observed, calibrated and library values by what is there."""
    o = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.col("o_totalprice").alias("rt_observed"), F.lit(0.0).alias("rt_library"), F.col("o_custkey").cast("double").alias("mz_calibrated"), F.lit(0.0).alias("mz_library"),
        (F.col("o_custkey") % 5).cast("double").alias("mobility_library"), (F.col("o_orderstatus") == "F").cast("int").alias("decoy"),
        F.col("o_orderpriority").alias("sequence"), F.lit(None).cast("string").alias("mods"), F.lit(None).cast("string").alias("mod_sites"), F.lit(2).alias("charge"))
    return L.observed_library(o, "a").select("o_orderkey", "o_custkey", "rt", "mz", "mobility")


@query("""with c as (select o_orderkey k from orders), x as (select i from (select unnest(range(0, 4)) i)),
t as (select l_orderkey k, l_linenumber - 1 i, sum(l_quantity) q, max(l_quantity) h, sum(l_extendedprice * l_quantity) / sum(l_quantity) mz, 50000.0 ref from lineitem where l_linenumber <= 4 group by 1, 2),
w as (select c.k, x.i, 1.0 / (1 + x.i) e, coalesce(q, 0.0) q, coalesce(h, 0.0) h, mz, ref from c cross join x left join t on t.k = c.k and t.i = x.i)
select k, round(max(case when i = 0 then q end), 6) mono, round(sum(q), 6) total, round(arg_max(h, e), 6) top, round(sum(q * e), 6) weighted, round(coalesce(sum((mz - ref) / ref * 1e6 * e), 0), 3) error,
round((sum(e * q) - sum(e) * sum(q) / 4) / (sqrt(greatest(sum(e * e) - sum(e) * sum(e) / 4, 0) * greatest(sum(q * q) - sum(q) * sum(q) / 4, 0)) + 1e-12), 6) r from w group by 1""")
def precursor_scores(spark, sf_dir):
    """Orders as candidates whose first four lines are isotopes."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("precursor_idx"), F.lit(0).alias("rank"), F.lit(0).alias("cycle_start"), F.lit(9).alias("cycle_stop"))
    iso = table(spark, sf_dir, "lineitem").where("l_linenumber <= 4").select(
        F.col("l_orderkey").alias("precursor_idx"), (F.col("l_linenumber") - 1).alias("isotope"), F.lit(50000.0).alias("mz_library"), F.lit(3).alias("cycle"), F.col("l_quantity").alias("intensity"), F.col("l_extendedprice").alias("mz"))
    lib = orders.select("precursor_idx", F.explode(F.array(*map(F.lit, range(4)))).alias("isotope")).withColumn("intensity", 1.0 / (1 + F.col("isotope")))
    s = K.precursor_scores(iso, orders, lib)
    names = {"mono": "mono_ms1_intensity", "total": "sum_ms1_intensity", "top": "top_ms1_height", "weighted": "weighted_ms1_intensity", "r": "isotope_intensity_correlation"}
    return s.select(F.col("precursor_idx").alias("k"), *(F.round(c, 6).alias(n) for n, c in names.items()), F.round("weighted_mass_deviation", 3).alias("error"))


@query("""select l_linestatus, round(avg(l_quantity), 6) q_mean, round(stddev_samp(l_quantity), 6) q_std from lineitem group by 1""")
def mean_and_spread(spark, sf_dir):
    """Mean and deviation of quantities by mode."""
    out = A.mean_and_spread(table(spark, sf_dir, "lineitem"), ["l_linestatus"], ["l_quantity"])
    return out.select("l_linestatus", F.round("l_quantity_mean", 6).alias("q_mean"), F.round("l_quantity_std", 6).alias("q_std"))


@query("""select user_id, min(event_id) as start, max(event_id) + 1 as stop from events group by 1""")
def group_ranges(spark, sf_dir):
    """Range of each user's events."""
    return A.group_ranges(table(spark, sf_dir, "events"), ["user_id"], "event_id")


@query("""select o_custkey, round(sum(l_quantity), 6) q from (select distinct o_custkey, o_orderkey from orders) join lineitem on o_orderkey = l_orderkey group by 1""")
def assemble_places(spark, sf_dir):
    """Quantities of the orders that each customer lists."""
    wanted = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderkey").alias("l_orderkey"))
    out = J.assemble(wanted, table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["o_custkey"], "l_quantity")
    return out.select("o_custkey", F.round("l_quantity", 6).alias("q"))


@query("""with x as (select l_returnflag f, l_quantity a, cast(l_extendedprice as double) b from lineitem)
select f, round((sum(a * b) - sum(a) * sum(b) / count(*)) / (sqrt((sum(a * a) - sum(a) * sum(a) / count(*)) * (sum(b * b) - sum(b) * sum(b) / count(*))) + 1e-12), 6) r from x group by 1""")
def damped_pearson(spark, sf_dir):
    """Correlation of quantities and prices."""
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("f")).agg(F.round(S.damped_pearson("l_quantity", "l_extendedprice"), 6).alias("r"))


@query()
def protein_fdr(spark, sf_dir):
    """Every line with the q-value of its group: ten neighbouring parts with one flag, so that groups grow with the parts."""
    psm = _psm(spark, sf_dir).withColumn("pg", F.concat_ws("_", F.floor(F.col("precursor_idx") / 10).cast("string"), "pg"))
    return E.protein_control(psm)
