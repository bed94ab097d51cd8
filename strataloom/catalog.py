"""All queries of the engine's own operators with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from strataloom.functions import intensity as it
from strataloom.functions import sequences as sq
from strataloom.functions import statistics as st
from strataloom.operators import adjustment as ad
from strataloom.operators import annotation as an
from strataloom.operators import columns as co
from strataloom.operators import composition as cp
from strataloom.operators import genotypes as g
from strataloom.operators import intervals as iv
from strataloom.operators import loci as lo
from strataloom.operators import pairs as pr
from strataloom.operators import pedigrees as pd
from strataloom.operators import regression as rg
from strataloom.operators import tables as tb
from strataloom.operators import variants as va
from strataloom.plans import views as v
from strataloom.plans.views import GENO, IV, LOCI, PED, TG, TRIP, TRIP_PART, table
from strataloom.plans.workspace import Workspace
from strataloom.sources import exchange as ex
from strataloom.sources import genotypes as sg
from strataloom.sources import plink as pl
from strataloom.streaming import events as ev

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "merge_vote"


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _text(df):
    return df.select(*[F.col(c).cast("string").alias(c) for c in df.columns])


def _voted(spark, sf):
    return g.merge(v.triples(spark, sf), "vote", 0.4).where("a1 IS NOT NULL").select("sample", "locus", "a1", "a2")


def _dosages(spark, sf):
    return _voted(spark, sf).select("sample", "locus", g.dosage("A").alias("x"))


def _r(c, n=6):
    return F.round(c, n)


# --- tables ------------------------------------------------------------------------------


@_query("SELECT c_custkey AS id, c_mktsegment AS segment, c_acctbal FROM customer")
def table_projection_rename(spark, sf):
    return co.project(table(spark, sf, "customer"), "1,c_mktsegment,*", "c_name,c_nationkey", "c_custkey=id,c_mktsegment=segment")


@_query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 1000 AND c_mktsegment IN ('BUILDING', 'MACHINERY') AND NOT c_name LIKE '%7'")
def table_filter_expr(spark, sf):
    t = table(spark, sf, "customer")
    return tb.filter_expr(t, ["float(c_acctbal) > 1000 and c_mktsegment in ['BUILDING', 'MACHINERY']", "not c_name.endswith('7')"]).select("c_custkey", "c_acctbal")


@_query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('F','O') AND o_orderpriority NOT IN ('1-URGENT') AND o_orderpriority <> ''")
def table_includevar(spark, sf):
    t = table(spark, sf, "orders")
    return tb.include_variables(t, ["o_orderstatus=F,O", "o_orderpriority"], ["o_orderpriority=1-URGENT"]).select("o_orderkey", "o_orderstatus")


@_query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN '1' WHEN o_orderstatus IN ('O','P') THEN '0' ELSE '' END AS st_F,
CASE WHEN o_orderstatus = 'O' THEN '1' WHEN o_orderstatus IN ('F','P') THEN '0' ELSE '' END AS st_O FROM orders""")
def table_categorical(spark, sf):
    t = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return tb.indicators(t, "o_orderstatus", "st_", ref=["P"], include=["F", "O", "P"]).drop("o_orderstatus")


@_query("SELECT p_partkey, CAST(p_size * 2 + 1 AS VARCHAR) AS twice, upper(substr(p_name, 1, 3)) AS head, CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS kind FROM part")
def table_column_expr(spark, sf):
    t = _text(table(spark, sf, "part").select("p_partkey", "p_name", "p_size"))
    out = tb.column_exprs(t, ["twice=int(int(p_size) * 2 + 1)", "head=p_name[:3].upper()", "kind='big' if int(p_size) > 25 else 'small'"])
    return out.select(F.col("p_partkey").cast("bigint").alias("p_partkey"), "twice", "head", "kind")


@_query("SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey, c_acctbal, c_custkey LIMIT 100")
def table_sort_topk(spark, sf):
    t = table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    return tb.sort_table(t, "c_nationkey,c_acctbal", ["c_custkey"]).limit(100)


@_query("""SELECT l_partkey % 50 AS k, l_orderkey, l_linenumber FROM lineitem
QUALIFY ROW_NUMBER() OVER (PARTITION BY l_partkey % 50 ORDER BY l_orderkey, l_linenumber) = 1""")
def table_uniq_first(spark, sf):
    t = table(spark, sf, "lineitem").select((F.col("l_partkey") % 50).alias("k"), "l_orderkey", "l_linenumber")
    return tb.uniq_table(t, "k", ["l_orderkey", "l_linenumber"])


@_query("""SELECT event_id, event_type FROM (SELECT event_id, event_type, LAG(event_type) OVER (ORDER BY event_id) AS b FROM events)
WHERE b IS NULL OR b <> event_type""")
def table_uniq_consecutive(spark, sf):
    t = table(spark, sf, "events").select("event_id", "event_type")
    return tb.uniq_table(t, "event_type", ["event_id"], consecutive=True)


@_query("SELECT n_regionkey, COUNT(*) AS n, MAX(n_name) AS last FROM nation WHERE n_nationkey > 3 GROUP BY n_regionkey")
def table_query(spark, sf):
    return tb.query(table(spark, sf, "nation"), ["SELECT * FROM data WHERE n_nationkey > 3", "SELECT n_regionkey, COUNT(*) AS n, MAX(n_name) AS last FROM data GROUP BY n_regionkey"])


@_query("""SELECT p_partkey, p_size, big FROM (SELECT p_partkey, p_size, CASE WHEN p_size > 20 THEN '1' ELSE '0' END AS big,
ROW_NUMBER() OVER (PARTITION BY p_size ORDER BY p_size, p_partkey) AS rn FROM part WHERE p_type <> '' AND p_size <> 7) WHERE rn = 1""")
def table_cook(spark, sf):
    t = table(spark, sf, "part")
    return tb.cook(
        t, columnexpr=["big='1' if int(p_size) > 20 else '0'"], queries=["SELECT p_partkey, p_size, big, p_type FROM data"], includevar=["p_type"],
        filterexpr=["int(p_size) != 7"], sort="p_size", uniq="p_size", order=["p_partkey"],
    ).drop("p_type")


@_query("SELECT c_custkey, c_nationkey, COALESCE(n_name, '') AS n_name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey >= 2) ON c_nationkey = n_nationkey")
def join_left(spark, sf):
    right = table(spark, sf, "nation").where("n_regionkey >= 2").select("n_nationkey", "n_name")
    return tb.join_tables(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), right, ["c_nationkey"], ["n_nationkey"])


@_query("SELECT s_suppkey AS l_s_suppkey, s_nationkey AS l_s_nationkey, c_custkey AS r_c_custkey FROM supplier JOIN customer ON s_nationkey = c_nationkey")
def join_inner_prefix(spark, sf):
    right = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    left = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey")
    return tb.join_tables(left, right, ["s_nationkey"], ["c_nationkey"], "inner", prefix1="l_", prefix2="r_", spread=(right.count() >> 16) + 1)


@_query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def semi_include(spark, sf):
    return g.keep(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey")).select("o_orderkey")


@_query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def anti_exclude(spark, sf):
    return g.keep(table(spark, sf, "orders"), "o_custkey", table(spark, sf, "customer").where("c_acctbal < 0").select("c_custkey"), True).select("o_orderkey")


@_query("""SELECT l_returnflag, ROUND(SUM(CASE WHEN l_linestatus='F' THEN l_quantity END), 4) AS F, ROUND(SUM(CASE WHEN l_linestatus='O' THEN l_quantity END), 4) AS O
FROM lineitem GROUP BY l_returnflag""")
def xtab_pivot(spark, sf):
    return tb.xtab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus", F.round(F.sum("l_quantity"), 4), ["F", "O"])


@_query("SELECT o_orderstatus, SUM((o_orderpriority='1-URGENT')::BIGINT) AS n, 'urgent' AS col FROM orders GROUP BY 1 UNION ALL SELECT o_orderstatus, COUNT(*), 'all' FROM orders GROUP BY 1")
def melt_columns(spark, sf):
    wide = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), F.count(F.lit(1)).alias("all"))
    return tb.melt(wide, "o_orderstatus", ["urgent", "all"], "col", "n")


@_query("""SELECT COALESCE(a.k, b.k) AS key, a.v AS value_0, b.v AS value_1 FROM
(SELECT CAST(FLOOR(c_acctbal) AS BIGINT) AS k, MIN(c_custkey) AS v FROM customer GROUP BY 1 HAVING COUNT(*) = 1) a FULL JOIN
(SELECT CAST(FLOOR(s_acctbal) AS BIGINT) AS k, MIN(s_suppkey) AS v FROM supplier GROUP BY 1 HAVING COUNT(*) = 1) b ON a.k = b.k""")
def align_outer(spark, sf):
    a = table(spark, sf, "customer").select(F.floor("c_acctbal").alias("k"), F.col("c_custkey").alias("v"))
    return tb.align([a, table(spark, sf, "supplier").select(F.floor("s_acctbal").alias("k"), F.col("s_suppkey").alias("v"))], "k", "v")


@_query("SELECT k, o FROM (SELECT c_custkey AS k, 'c' AS o FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier)")
def merge_tables(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit("c").alias("o"))
    return tb.merge_sorted([a, table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("s").alias("o"))], ["k", "o"])


@_query("SELECT n_nationkey AS key, MAX(n_name) AS value FROM nation GROUP BY 1")
def map_unique(spark, sf):
    return tb.mapping(table(spark, sf, "nation"), "n_nationkey", "n_name")


@_query("SELECT o_orderkey, o_custkey, CAST(FLOOR((ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 4) AS BIGINT) AS chunk FROM orders")
def chunk_rows(spark, sf):
    return tb.numbered_chunks(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), 4, ["o_custkey"], ["o_orderkey"])


@_query("SELECT event_id, value FROM (SELECT event_id, value, LAG(value) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM events) WHERE value < b")
def check_sorted(spark, sf):
    return tb.check_sorted(table(spark, sf, "events").select("event_id", "user_id", "value"), ["user_id"], ["event_id"], "value").select("event_id", "value")


@_query("SELECT o_orderpriority, COUNT(*) AS n FROM orders GROUP BY 1")
def tally(spark, sf):
    return tb.tally(table(spark, sf, "orders"), "o_orderpriority")


# --- genotypes ---------------------------------------------------------------------------


@_query("WITH " + TRIP + " SELECT CASE WHEN locus < 5 THEN locus + 1000 ELSE locus END AS locus, COUNT(*) AS n FROM trip GROUP BY 1")
def rename_map(spark, sf):
    names = spark.createDataFrame([(i, i + 1000) for i in range(5)], "old long, new long")
    return g.rename(v.triples(spark, sf), "locus", names).groupBy("locus").agg(F.count(F.lit(1)).alias("n"))


@_query("WITH " + TRIP_PART + """, c AS (SELECT sample, locus, COUNT(*) AS reps, COUNT(a1) AS called, COUNT(DISTINCT a1 || a2) AS kinds FROM trip GROUP BY 1, 2)
SELECT CASE WHEN called = 0 THEN 'MISSING' WHEN reps = 1 THEN 'UNAMBIGUOUS' WHEN kinds = 1 THEN 'CONCORDANT' ELSE 'DISCORDANT' END AS class, COUNT(*) AS n FROM c GROUP BY 1""")
def merge_unanimous_classes(spark, sf):
    return tb.tally(g.merge(v.triples(spark, sf, None), "unanimous"), "class")


@_query("WITH " + GENO + " SELECT sample, locus, a1, a2 FROM geno")
def merge_vote(spark, sf):
    return _voted(spark, sf)


@_query("WITH " + TRIP + """, c AS (SELECT sample, locus, a1, a2, COUNT(*) AS n, MIN(ord) AS o FROM trip WHERE a1 IS NOT NULL GROUP BY 1, 2, 3, 4),
r AS (SELECT *, SUM(n) OVER (PARTITION BY sample, locus) AS t, ROW_NUMBER() OVER (PARTITION BY sample, locus ORDER BY o, n, a1, a2) AS rn FROM c)
SELECT sample, locus, a1, a2 FROM r WHERE rn = 1 AND n * 1.0 / t >= 0.4999999""")
def merge_ordered(spark, sf):
    return g.merge(v.triples(spark, sf), "ordered").where("a1 IS NOT NULL").select("sample", "locus", "a1", "a2")


@_query("WITH " + TRIP_PART + """, c AS (SELECT sample, locus, COUNT(*) AS reps, COUNT(a1) AS called, COUNT(DISTINCT a1 || a2) AS kinds FROM trip GROUP BY 1, 2),
k AS (SELECT sample, SUM((called = 0)::BIGINT) AS m, SUM((called > 0 AND reps > 1 AND kinds = 1)::BIGINT) AS c, SUM((called > 0 AND reps > 1 AND kinds > 1)::BIGINT) AS d, COUNT(*) AS t FROM c GROUP BY 1)
SELECT sample, ROUND(COALESCE(d * 1.0 / NULLIF(c + d, 0), 0), 6) AS discord_rate, ROUND((m + d) * 1.0 / t, 6) AS missing_rate FROM k""")
def merge_stats(spark, sf):
    s = g.merge_statistics(g.merge(v.triples(spark, sf, None), "unanimous"), "sample")
    return s.select("sample", _r("discord_rate").alias("discord_rate"), _r("missing_rate").alias("missing_rate"))


_COUNTS = """, b AS (SELECT locus, SUM((x=0)::BIGINT) AS hom1, SUM((x=1)::BIGINT) AS het, SUM((x=2)::BIGINT) AS hom2 FROM geno GROUP BY 1)"""


@_query("WITH " + GENO + _COUNTS + """ SELECT locus, hom1, het, hom2, ROUND(LEAST((2.0*hom1+het)/(2*(hom1+het+hom2)), (2.0*hom2+het)/(2*(hom1+het+hom2))), 6) AS maf,
ROUND(het * 1.0 / (hom1+het+hom2), 6) AS heterozygosity FROM (SELECT CAST(locus AS VARCHAR) AS locus, hom1, het, hom2 FROM b UNION ALL SELECT '*', SUM(hom1), SUM(het), SUM(hom2) FROM b)""")
def locus_summary(spark, sf):
    s = g.locus_summary(_voted(spark, sf), exact=False, total=True)
    return s.select("locus", "hom1", "het", "hom2", _r("maf").alias("maf"), _r("heterozygosity").alias("heterozygosity"))


@_query("WITH " + TRIP + """ SELECT sample, SUM((a1 IS NULL)::BIGINT) AS missing, SUM((a1 = a2)::BIGINT) AS homozygote, SUM((a1 <> a2)::BIGINT) AS heterozygote,
ROUND(SUM((a1 IS NULL)::BIGINT) * 1.0 / COUNT(*), 6) AS missing_rate FROM trip GROUP BY 1""")
def sample_summary(spark, sf):
    s = g.sample_summary(v.triples(spark, sf))
    return s.select("sample", "missing", "homozygote", "heterozygote", _r("missing_rate").alias("missing_rate"))


@_query("WITH " + GENO + _COUNTS + """, f AS (SELECT *, (hom1+het+hom2) * 1.0 AS n, (2.0*hom1+het)/(2*(hom1+het+hom2)) AS p FROM b)
SELECT locus, ROUND(POWER(hom1-n*p*p,2)/(n*p*p) + POWER(het-2*n*p*(1-p),2)/(2*n*p*(1-p)) + POWER(hom2-n*(1-p)*(1-p),2)/(n*(1-p)*(1-p)), 5) AS chisq FROM f""")
def hwp_chisq(spark, sf):
    return g.biallelic(_voted(spark, sf)).select("locus", _r(st.hwp_chisq_stat(F.col("hom1"), F.col("het"), F.col("hom2")), 5).alias("chisq"))


@_query("WITH " + GENO + _COUNTS + """, rr AS (SELECT *, hom1 + het + hom2 AS n, 2 * LEAST(hom1, hom2) + het AS rare FROM b),
w AS (SELECT locus, het, h, h * LN(2) - LGAMMA(h + 1) - LGAMMA((rare - h) / 2 + 1) - LGAMMA(n - h - (rare - h) / 2 + 1) AS l
FROM (SELECT locus, het, n, rare, UNNEST(RANGE(CAST(rare % 2 AS BIGINT), CAST(rare + 1 AS BIGINT), 2)) AS h FROM rr)),
m AS (SELECT *, EXP(l - MAX(l) OVER (PARTITION BY locus)) AS p FROM w), k AS (SELECT locus, p FROM m WHERE h = het)
SELECT m.locus, ROUND(LEAST(1, SUM(CASE WHEN m.p <= k.p * (1 + 1e-9) THEN m.p ELSE 0 END) / SUM(m.p)), 6) AS p FROM m JOIN k ON k.locus = m.locus GROUP BY 1""")
def hwp_exact(spark, sf):
    return g.biallelic(_voted(spark, sf)).select("locus", _r(st.hwp(F.col("hom1"), F.col("het"), F.col("hom2"))).alias("p"))


@_query("WITH " + GENO + """, a AS (SELECT locus, SUM(2-x) AS na, SUM(x) AS nb FROM geno GROUP BY 1)
SELECT locus, CASE WHEN na <= nb THEN 'A' ELSE 'B' END AS minor, ROUND(LEAST(na, nb) * 1.0 / (na+nb), 6) AS minor_freq, CASE WHEN na >= nb THEN 'A' ELSE 'B' END AS major FROM a""")
def minor_major_alleles(spark, sf):
    return g.minor_major(_voted(spark, sf)).select("locus", "minor", _r("minor_freq").alias("minor_freq"), "major")


@_query("WITH " + TRIP + " SELECT locus, allele, COUNT(*) AS n FROM (SELECT locus, a1 AS allele FROM trip UNION ALL SELECT locus, a2 FROM trip) WHERE allele IS NOT NULL GROUP BY 1, 2")
def allele_counts(spark, sf):
    return g.allele_counts(v.triples(spark, sf))


@_query("WITH " + TRIP + " SELECT locus, COUNT(a1) AS called, COUNT(*) AS total, ROUND(COUNT(a1) * 1.0 / COUNT(*), 6) AS completion FROM trip GROUP BY 1")
def locus_completion(spark, sf):
    return g.completion(v.triples(spark, sf), "locus").withColumn("completion", _r("completion"))


_PAIRS = """, p AS (SELECT a.sample AS s1, b.sample AS s2, COUNT(*) AS comparisons, SUM((a.x = b.x)::BIGINT) AS ibs2, SUM((ABS(a.x - b.x) = 1)::BIGINT) AS ibs1,
SUM((ABS(a.x - b.x) = 2)::BIGINT) AS ibs0 FROM geno a JOIN geno b ON a.locus = b.locus AND a.sample < b.sample GROUP BY 1, 2)"""


@_query("WITH " + GENO + _PAIRS + " SELECT s1, s2, comparisons, ibs0, ibs1, ibs2, ROUND(ibs2 * 1.0 / comparisons, 6) AS concordance FROM p WHERE comparisons >= 30")
def pair_concordance_ibs(spark, sf):
    return g.sample_pairs(_voted(spark, sf), None, 30).withColumn("concordance", _r("concordance"))


@_query("WITH " + GENO + _PAIRS + " SELECT s1, s2, 'UNEXPECTED CONCORDANT' AS disposition FROM p WHERE comparisons >= 25 AND ibs2 * 1.0 / comparisons >= 0.5")
def duplicate_pairs(spark, sf):
    return g.duplicates(_voted(spark, sf), 0.5, 25).select("s1", "s2", "disposition")


@_query("WITH " + GENO + _PAIRS + """, t AS (SELECT SUM(2 - x) * 1.0 AS x, SUM(x) * 1.0 AS y, COUNT(*) * 2.0 AS n FROM geno GROUP BY locus),
s AS (SELECT 2*x*x*y*y/n**4 * (x-1)/x * (y-1)/y * n/(n-1) * n/(n-2) * n/(n-3) AS e00, (4*x*x*x*y/n**4 * (x-1)/x * (x-2)/x + 4*x*y*y*y/n**4 * (y-1)/y * (y-2)/y) * n/(n-1) * n/(n-2) * n/(n-3) AS e01,
(2*x*x*y/n**3 * (x-1)/x + 2*x*y*y/n**3 * (y-1)/y) * n/(n-1) * n/(n-2) AS e11 FROM t WHERE x > 0 AND y > 0 AND n > 3),
e AS (SELECT AVG(e00) AS e00, AVG(e01) AS e01, AVG(e11) AS e11 FROM s), z AS (SELECT s1, s2, GREATEST(0, LEAST(1, ibs0 / (comparisons * e00))) AS ibd0,
GREATEST(0, LEAST(1, (ibs1 - ibs0 / (comparisons * e00) * comparisons * e01) / (comparisons * e11))) AS z1 FROM p, e WHERE comparisons >= 30)
SELECT s1, s2, ROUND(ibd0, 6) AS ibd0, ROUND(LEAST(z1, 1 - ibd0), 6) AS ibd1, ROUND(LEAST(z1, 1 - ibd0) / 2 + 1 - ibd0 - LEAST(z1, 1 - ibd0), 6) AS pihat FROM z""")
def ibd_estimates(spark, sf):
    geno = _voted(spark, sf)
    found = g.ibd(g.sample_pairs(geno, None, 30), g.allele_totals(geno))
    return found.select("s1", "s2", *[_r(c).alias(c) for c in ("ibd0", "ibd1", "pihat")])


@_query("WITH " + GENO + """, e AS (SELECT sample, locus, a1, a2 FROM trip WHERE a1 IS NOT NULL)
SELECT geno.locus, SUM((geno.a1 = e.a1 AND geno.a2 = e.a2)::BIGINT) AS concordant, COUNT(*) AS comparisons FROM geno JOIN e ON geno.sample = e.sample AND geno.locus = e.locus GROUP BY 1""")
def concordance_by_locus(spark, sf):
    comp = v.triples(spark, sf).select("sample", "locus", "a1", "a2")
    return g.concordance(_voted(spark, sf), comp, "locus").select("locus", "concordant", "comparisons")


@_query("WITH " + GENO + ", " + PED + """, t AS (SELECT child, c.x AS c, a.x AS p, b.x AS q FROM ped JOIN geno c ON c.sample = child LEFT JOIN geno a ON a.sample = p1 AND a.locus = c.locus
LEFT JOIN geno b ON b.sample = p2 AND b.locus = c.locus WHERE a.x IS NOT NULL OR b.x IS NOT NULL)
SELECT child, SUM(CASE WHEN p IS NOT NULL AND q IS NOT NULL THEN (c BETWEEN (p=2)::INT + (q=2)::INT AND (p>0)::INT + (q>0)::INT)::BIGINT
 ELSE (ABS(c - COALESCE(p, q)) < 2)::BIGINT END) AS consistent, COUNT(*) AS total FROM t GROUP BY 1""")
def mendel_check(spark, sf):
    return g.mendel(_voted(spark, sf), v.pedigree(spark, sf))


@_query("WITH " + GENO + ", " + PED + " SELECT sample, COUNT(*) AS n FROM geno WHERE sample NOT IN (SELECT child FROM ped) GROUP BY 1")
def founders_only(spark, sf):
    ped = v.pedigree(spark, sf).withColumnRenamed("child", "name")
    return tb.tally(g.founders(_voted(spark, sf), ped), "sample")


@_query("WITH " + GENO + """ SELECT sample, locus + 500 AS locus, CASE WHEN a1 = 'A' THEN 'T' ELSE a1 END AS a2, a2 AS a1 FROM geno WHERE locus < 10 AND sample % 2 = 0 AND a1 = 'A' AND a2 = 'B'
UNION ALL SELECT sample, locus + 500, CASE WHEN a2 = 'A' THEN 'T' ELSE a2 END, CASE WHEN a1 = 'A' THEN 'T' ELSE a1 END FROM geno WHERE locus < 10 AND sample % 2 = 0 AND a1 = a2""")
def transform_spec(spark, sf):
    one = lambda xs, name: spark.createDataFrame([(x,) for x in xs], f"{name} long")
    even = v.triples(spark, sf).select("sample").where("sample % 2 = 0")
    spec = g.Transform(
        include={"locus": [one(range(10), "locus"), one(range(20), "locus")], "sample": [even]},
        rename={"locus": spark.createDataFrame([(i, i + 500) for i in range(10)], "old long, new long")},
        alleles=spark.createDataFrame([(i, "A", "T") for i in range(10)], "locus long, old string, new string"),
    )
    return spec.apply(_voted(spark, sf))


@_query("WITH " + GENO + """ SELECT CASE WHEN sample % 3 = 0 THEN 'low' WHEN sample % 3 = 1 THEN 'mid' ELSE 'rest' END AS sample_group, COUNT(*) AS n FROM geno GROUP BY 1""")
def split_by_group(spark, sf):
    samples = v.triples(spark, sf).select("sample").distinct().where("sample % 3 < 2")
    groups = samples.select("sample", F.when(F.col("sample") % 3 == 0, "low").otherwise("mid").alias("grp"))
    return tb.tally(g.split_groups(_voted(spark, sf), samples=groups, default_sample="rest"), "sample_group")


# --- locus pairs -------------------------------------------------------------------------

_LD = ", " + LOCI + """, bp AS (SELECT a.locus AS locus1, b.locus AS locus2 FROM loci a JOIN loci b ON a.chrom = b.chrom AND b.location > a.location AND b.location - a.location <= 12000),
ld AS (SELECT locus1, locus2, COALESCE(POWER(CORR(a.x, b.x), 2), 0) AS r2, COUNT(*) AS n FROM bp JOIN geno a ON a.locus = locus1 JOIN geno b ON b.locus = locus2 AND b.sample = a.sample GROUP BY 1, 2)"""


def _dosage_ld(spark, sf):
    return pr.dosage_r2(_dosages(spark, sf), pr.band_pairs(v.loci(spark, sf), 12000))


@_query("WITH " + GENO + _LD + " SELECT locus1, locus2, ROUND(r2, 6) AS r2, n FROM ld")
def ld_dosage_r2(spark, sf):
    return _dosage_ld(spark, sf).withColumn("r2", _r("r2"))


@_query("WITH RECURSIVE " + GENO + ", " + LOCI + """, bp AS (SELECT a.locus AS locus1, b.locus AS locus2 FROM loci a JOIN loci b ON a.chrom = b.chrom AND b.location > a.location AND b.location - a.location <= 12000),
h AS (SELECT locus1, locus2, COUNT(*) * 2.0 AS n, SUM((a.x = 1 AND b.x = 1)::INT) * 1.0 AS dh, SUM(2 - a.x) / (COUNT(*) * 2.0) AS p, SUM(2 - b.x) / (COUNT(*) * 2.0) AS q,
SUM(CASE WHEN a.x = 0 THEN 2 - b.x WHEN a.x = 1 AND b.x = 0 THEN 1 ELSE 0 END) * 1.0 AS c11 FROM bp JOIN geno a ON a.locus = locus1 JOIN geno b ON b.locus = locus2 AND b.sample = a.sample GROUP BY 1, 2),
em(locus1, locus2, n, dh, p, q, c11, k, v) AS (SELECT locus1, locus2, n, dh, p, q, c11, 0, CAST(p * q AS DOUBLE) FROM h UNION ALL
SELECT locus1, locus2, n, dh, p, q, c11, k + 1, CAST((c11 + dh * COALESCE(v * (1 - p - q + v) / NULLIF(v * (1 - p - q + v) + (p - v) * (q - v), 0), 0)) / n AS DOUBLE) FROM em WHERE k < 100),
d AS (SELECT *, v - p * q AS d FROM em WHERE k = 100)
SELECT locus1, locus2, ROUND(COALESCE(d * d / NULLIF(p * (1 - p) * q * (1 - q), 0), 0), 4) AS r2, ROUND(COALESCE(ABS(d) / NULLIF(CASE WHEN d > 0 THEN LEAST(p * (1 - q), q * (1 - p)) ELSE LEAST(p * q, (1 - p) * (1 - q)) END, 0), 0), 4) AS dprime FROM d""")
def ld_pairs_em(spark, sf):
    found = pr.ld_pairs(_dosages(spark, sf), pr.band_pairs(v.loci(spark, sf), 12000))
    return found.select("locus1", "locus2", _r("r2", 4).alias("r2"), _r("dprime", 4).alias("dprime"))


@_query("WITH " + GENO + _LD + """, bw AS (SELECT locus1 AS a, locus2 AS b, ROUND(r2, 9) AS r FROM ld UNION ALL SELECT locus2, locus1, ROUND(r2, 9) FROM ld), m AS (SELECT locus, chrom AS bin, locus % 8 < 4 AS tag FROM loci),
t AS (SELECT m.bin, m.locus, MIN(r) AS least, SUM(CASE WHEN NOT o.tag THEN r END) AS total FROM m LEFT JOIN bw ON a = m.locus LEFT JOIN m o ON o.locus = b AND o.bin = m.bin WHERE m.tag GROUP BY 1, 2),
s AS (SELECT *, (locus % 5 + 1) / (CASE WHEN least < MAX(least) OVER w - 1e-10 THEN 2.0 ELSE 1 END) / (CASE WHEN total < MAX(total) OVER w - 1e-10 THEN 3.0 ELSE 1 END) AS score FROM t WINDOW w AS (PARTITION BY bin))
SELECT bin, locus AS tag, ROUND(score, 6) AS score, CAST(ROW_NUMBER() OVER (PARTITION BY bin ORDER BY ROUND(score, 6) DESC, locus DESC) AS INTEGER) AS rank FROM s""")
def tag_ranking(spark, sf):
    loci, at = v.loci(spark, sf), F.col("locus")
    bins = loci.select(F.col("chrom").alias("bin"), "locus", (at % 8 < 4).alias("tag"))
    scores = loci.select("locus", (at % 5 + 1).alias("score"))
    ranked = pr.rank_tags(bins, _dosage_ld(spark, sf).withColumn("r2", F.round("r2", 9)), scores, {"maxsnp": 2, "avgtag": 3})
    return ranked.select("bin", "tag", _r("score").alias("score"), "rank")


_MATRIX = ", ".join(f'MAX(CASE WHEN locus2 = {i} THEN ROUND(r2, 6) END) AS "{i}"' for i in range(40))


@_query("WITH " + GENO + _LD + f" SELECT locus1, {_MATRIX} FROM ld GROUP BY 1")
def ld_matrix(spark, sf):
    return lo.ld_matrix(_dosage_ld(spark, sf).withColumn("r2", _r("r2")), "r2", list(range(40)))


_BOTH = ", bw AS (SELECT locus1 AS needle, locus2 AS surrogate, ROUND(r2, 9) AS r2 FROM ld UNION ALL SELECT locus2, locus1, ROUND(r2, 9) FROM ld)"


@_query("WITH " + GENO + _LD + _BOTH + """ SELECT needle, surrogate, ROUND(r2, 6) AS r2, CAST(rn AS INTEGER) AS rank FROM
(SELECT *, ROW_NUMBER() OVER (PARTITION BY needle ORDER BY r2 DESC, surrogate DESC) AS rn FROM bw) WHERE rn <= 3""")
def surrogates_topk(spark, sf):
    return pr.surrogates(_dosage_ld(spark, sf).withColumn("r2", F.round("r2", 9)), 3).withColumn("r2", _r("r2"))


@_query("WITH " + GENO + _LD + _BOTH + """ SELECT needle AS locus, surrogate AS tag, ROUND(r2, 6) AS r2 FROM
(SELECT *, ROW_NUMBER() OVER (PARTITION BY needle ORDER BY r2 DESC, surrogate) AS rn FROM bw WHERE surrogate % 5 = 0) WHERE rn = 1""")
def tag_coverage(spark, sf):
    tags = spark.range(0, 40, 5).toDF("tag")
    return pr.best_tag(_dosage_ld(spark, sf).withColumn("r2", F.round("r2", 9)), tags).withColumn("r2", _r("r2"))


@_query()
def greedy_tags(spark, sf):
    return pr.greedy_tags(v.loci(spark, sf), _dosage_ld(spark, sf), 12000, 0.02)


@_query()
def ld_prune(spark, sf):
    loci = v.loci(spark, sf).withColumn("p", F.pmod(F.xxhash64("locus"), F.lit(1000)) / 1000)
    return pr.prune(loci, _dosage_ld(spark, sf), 12000, 0.02)


@_query("""WITH RECURSIVE e AS (SELECT n_nationkey AS u, n_regionkey AS w FROM nation), b AS (SELECT u, w FROM e UNION ALL SELECT w, u FROM e),
r(node, c) AS (SELECT u, u FROM b UNION SELECT b.w, r.c FROM r JOIN b ON b.u = r.node) SELECT node, MIN(c) AS component FROM r GROUP BY 1""")
def connected_components(spark, sf):
    return pr.components(table(spark, sf, "nation"), "n_nationkey", "n_regionkey")


# --- intervals ---------------------------------------------------------------------------


@_query("WITH " + IV + ", " + TG + " SELECT tg.name AS name, COUNT(*) AS n, CAST(SUM(LEAST(tg.e, iv.e) - GREATEST(tg.s, iv.s)) AS BIGINT) AS bases FROM tg JOIN iv ON tg.chrom = iv.chrom AND tg.s < iv.e AND iv.s < tg.e GROUP BY 1")
def interval_overlap(spark, sf):
    return iv.overlap_join(v.targets(spark, sf), v.intervals(spark, sf)).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.sum("overlap").alias("bases"))


_SWEEP = IV + """, d AS (SELECT chrom, pos, SUM(x) AS x FROM (SELECT chrom, s AS pos, 1 AS x FROM iv UNION ALL SELECT chrom, e, -1 FROM iv) GROUP BY 1, 2),
sw AS (SELECT chrom, pos AS s, LEAD(pos) OVER (PARTITION BY chrom ORDER BY pos) AS e, SUM(x) OVER (PARTITION BY chrom ORDER BY pos) AS depth FROM d)"""


@_query("WITH " + _SWEEP + """, h AS (SELECT CAST(depth AS BIGINT) AS bin, CAST(SUM(e - s) AS BIGINT) AS bases FROM sw WHERE depth > 0 GROUP BY 1)
SELECT bin, bases, CAST(SUM(bases) OVER (ORDER BY bin DESC) AS BIGINT) AS at_least FROM h""")
def interval_depth_sweep(spark, sf):
    return iv.depth_histogram(iv.depth(v.intervals(spark, sf)))


@_query("WITH " + _SWEEP + " SELECT CAST(depth AS BIGINT) AS depth, CAST(SUM(e - s) AS BIGINT) AS bases FROM sw WHERE depth > 0 GROUP BY 1")
def interval_depth_tiled(spark, sf):
    return iv.tiled_depth(v.intervals(spark, sf), 1000).groupBy("depth").agg(F.sum(F.col("end") - F.col("start")).alias("bases"))


@_query("""WITH i AS (SELECT o_custkey % 3 AS chrom, o_orderkey AS s, o_orderkey + o_custkey % 3 + 1 AS e FROM orders),
m AS (SELECT *, CASE WHEN s <= MAX(e) OVER (PARTITION BY chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS new FROM i),
k AS (SELECT *, SUM(new) OVER (PARTITION BY chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m) SELECT chrom, MIN(s) AS start, MAX(e) AS "end", COUNT(*) AS n FROM k GROUP BY chrom, island""")
def interval_islands(spark, sf):
    narrow = table(spark, sf, "orders").select((F.col("o_custkey") % 3).alias("chrom"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + F.col("o_custkey") % 3 + 1).alias("end"))
    return iv.islands(narrow).drop("island")


@_query("WITH " + IV + ", " + TG + """ SELECT chrom, pos, start, "end", pos - "end" AS distance FROM (SELECT tg.chrom, tg.s AS pos, iv.s AS start, iv.e AS "end",
ROW_NUMBER() OVER (PARTITION BY tg.name ORDER BY iv.e DESC, iv.s DESC) AS rn FROM tg JOIN iv ON tg.chrom = iv.chrom AND iv.e <= tg.s) WHERE rn = 1""")
def interval_nearest(spark, sf):
    points = v.targets(spark, sf).select("chrom", F.col("start").alias("pos"))
    return iv.nearest(points, v.intervals(spark, sf)).drop("rank")


@_query("WITH " + _SWEEP + ", " + TG + """, o AS (SELECT tg.name, sw.depth, SUM(LEAST(tg.e, sw.e) - GREATEST(tg.s, sw.s)) AS bases FROM tg JOIN sw ON tg.chrom = sw.chrom AND tg.s < sw.e AND sw.s < tg.e AND depth > 0 GROUP BY 1, 2),
z AS (SELECT tg.name, 0 AS depth, tg.e - tg.s - COALESCE((SELECT SUM(bases) FROM o WHERE o.name = tg.name), 0) AS bases FROM tg)
SELECT name, CAST(depth AS BIGINT) AS depth, CAST(bases AS BIGINT) AS bases FROM (SELECT * FROM o UNION ALL SELECT * FROM z WHERE bases > 0)""")
def target_coverage(spark, sf):
    return iv.target_coverage(v.intervals(spark, sf), v.targets(spark, sf), "name")


@_query("WITH " + IV + ", " + TG + """ SELECT iv.name AS name, CASE WHEN EXISTS (SELECT 1 FROM tg WHERE tg.chrom = iv.chrom AND LEAST(tg.e, iv.e) - GREATEST(tg.s, iv.s) >= 10) THEN 'ontarget' ELSE 'offtarget' END AS class FROM iv""")
def target_filter(spark, sf):
    return iv.target_filter(v.intervals(spark, sf), v.targets(spark, sf), "name", 10).select("name", "class")


@_query("WITH " + IV + ", " + TG + """ SELECT name, target, ROUND(share, 6) AS share FROM (SELECT iv.name AS name, tg.name AS target, (LEAST(tg.e, iv.e) - GREATEST(tg.s, iv.s)) * 1.0 / (iv.e - iv.s) AS share,
ROW_NUMBER() OVER (PARTITION BY iv.name ORDER BY (LEAST(tg.e, iv.e) - GREATEST(tg.s, iv.s)) * 1.0 / (iv.e - iv.s) DESC, tg.name) AS rn
FROM iv JOIN tg ON tg.chrom = iv.chrom AND tg.s < iv.e AND iv.s < tg.e) WHERE rn = 1""")
def best_target(spark, sf):
    reads = v.intervals(spark, sf).withColumnRenamed("name", "read")
    best = iv.best_overlap(reads, v.targets(spark, sf), "read", "name")
    return best.select(F.col("read").alias("name"), F.col("name").alias("target"), _r("share").alias("share"))


@_query("""SELECT o_orderkey AS read, o_orderkey <> FIRST_VALUE(o_orderkey) OVER (PARTITION BY o_custkey % 3, o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS duplicate FROM orders""")
def duplicate_reads(spark, sf):
    reads = table(spark, sf, "orders").select((F.col("o_custkey") % 3).alias("strand"), F.col("o_custkey").alias("start"), F.col("o_totalprice").alias("length"), F.col("o_orderkey").alias("read"))
    return iv.mark_duplicates(reads, ["strand", "start"], "length", "read").select("read", "duplicate")


# --- regression and statistics ------------------------------------------------------------


def _phenotypes(spark, sf):
    pheno = table(spark, sf, "customer").select(F.col("c_custkey").alias("sample"), F.col("c_acctbal").alias("y"), F.col("c_nationkey").cast("double").alias("nation"))
    return _dosages(spark, sf).join(pheno, "sample").withColumn("case", (F.col("y") > 4000).cast("double"))


@_query("WITH " + GENO + """ SELECT locus, COUNT(*) AS n, ROUND(REGR_SLOPE(c_acctbal, x), 4) AS slope, ROUND(REGR_INTERCEPT(c_acctbal, x), 4) AS intercept, ROUND(REGR_R2(c_acctbal, x), 6) AS r2
FROM geno JOIN customer ON c_custkey = sample GROUP BY 1""")
def assoc_linear_simple(spark, sf):
    s = rg.linear_by_locus(_phenotypes(spark, sf))
    return s.select("locus", "n", _r("slope", 4).alias("slope"), _r("intercept", 4).alias("intercept"), _r("r2").alias("r2"))


@_query("WITH " + GENO + """ SELECT locus, ROUND(REGR_SLOPE(c_acctbal, x), 4) AS beta,
ROUND(SQRT((REGR_SYY(c_acctbal, x) - REGR_SXY(c_acctbal, x) * REGR_SXY(c_acctbal, x) / REGR_SXX(c_acctbal, x)) / (COUNT(*) - 2) / REGR_SXX(c_acctbal, x)), 4) AS se
FROM geno JOIN customer ON c_custkey = sample GROUP BY 1""")
def assoc_linear_scan(spark, sf):
    s = rg.scan(_phenotypes(spark, sf), "y = TREND(locus)").where("term = 'trend'")
    return s.select("locus", _r("beta", 4).alias("beta"), _r("se", 4).alias("se"))


@_query()
def assoc_logistic_scan(spark, sf):
    return rg.scan(_phenotypes(spark, sf), "case = GENO(locus) + nation", "logistic")


_CELLS = ", k AS (SELECT locus, x, c_acctbal > 4000 AS c FROM geno JOIN customer ON c_custkey = sample), t AS (SELECT locus, COUNT(*) * 1.0 AS n, SUM(c::INT) * 1.0 AS a, SUM(x * c::INT) * 1.0 AS xc, SUM(x) * 1.0 AS sx, SUM(x * x) * 1.0 AS sxx FROM k GROUP BY 1)"


@_query("WITH " + GENO + _CELLS + " SELECT locus, ROUND(COALESCE(n * POWER(n * xc - a * sx, 2) / NULLIF(a * (n - a) * (n * sxx - sx * sx), 0), 0), 5) AS trend FROM t")
def trend_test(spark, sf):
    d = _phenotypes(spark, sf)
    n = lambda x, c: F.count_if((F.col("x") == x) & (F.col("case") == c)).cast("double")
    return d.groupBy("locus").agg(*[n(x, c).alias(f"n{x}{int(c)}") for x in range(3) for c in (0.0, 1.0)]).select(
        "locus", _r(rg.trend([F.col(f"n{x}1") for x in range(3)], [F.col(f"n{x}0") for x in range(3)]), 5).alias("trend"))


@_query("""WITH c AS (SELECT o_orderstatus AS a, o_orderpriority AS b, COUNT(*) AS o FROM orders GROUP BY 1, 2), m AS (SELECT *, SUM(o) OVER (PARTITION BY a) AS ra, SUM(o) OVER (PARTITION BY b) AS cb, SUM(o) OVER () AS t FROM c)
SELECT ROUND(SUM(o * o * t / (ra * cb * 1.0)) - MAX(t), 5) AS chisq, (COUNT(DISTINCT a) - 1) * (COUNT(DISTINCT b) - 1) AS df FROM m""")
def contingency_test(spark, sf):
    return rg.contingency(table(spark, sf, "orders"), "o_orderstatus", "o_orderpriority").withColumn("chisq", _r("chisq", 5))


@_query("SELECT c_mktsegment, ROUND(AVG(c_acctbal), 4) AS mean, ROUND(QUANTILE_CONT(c_acctbal, 0.5), 4) AS median, ROUND(QUANTILE_CONT(c_acctbal, 0.9), 4) AS q90 FROM customer GROUP BY 1")
def quantiles(spark, sf):
    q = lambda k: _r(F.percentile("c_acctbal", k), 4)
    return table(spark, sf, "customer").groupBy("c_mktsegment").agg(_r(F.avg("c_acctbal"), 4).alias("mean"), q(0.5).alias("median"), q(0.9).alias("q90"))


@_query("""WITH k AS (SELECT c_nationkey, SUM((c_acctbal < 0)::INT) * 1.0 AS x, COUNT(*) * 1.0 AS n FROM customer GROUP BY 1), z AS (SELECT *, x / n AS p, 1.959963984540054 AS z FROM k)
SELECT c_nationkey, ROUND(GREATEST(0, (p + z*z/(2*n) - z*SQRT(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS low, ROUND(LEAST(1, (p + z*z/(2*n) + z*SQRT(p*(1-p)/n + z*z/(4*n*n))) / (1 + z*z/n)), 6) AS high FROM z""")
def wilson_interval(spark, sf):
    k = table(spark, sf, "customer").groupBy("c_nationkey").agg(F.count_if(F.col("c_acctbal") < 0).alias("x"), F.count(F.lit(1)).alias("n"))
    low, high = st.wilson_interval(F.col("x"), F.col("n"))
    return k.select("c_nationkey", _r(low).alias("low"), _r(high).alias("high"))


# --- sequences and variants ----------------------------------------------------------------


@_query("SELECT a.n_name AS a, b.n_name AS b, CAST(levenshtein(a.n_name, b.n_name) AS INTEGER) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def edit_distance(spark, sf):
    n = table(spark, sf, "nation")
    b = n.select(F.col("n_name").alias("b"), F.col("n_regionkey").alias("r"), F.col("n_nationkey").alias("k"))
    return n.join(b, (F.col("r") == F.col("n_regionkey")) & (F.col("n_nationkey") < F.col("k"))).select(F.col("n_name").alias("a"), "b", sq.levenshtein(F.col("n_name"), F.col("b")).alias("d"))


@_query("SELECT n_name, CAST(damerau_levenshtein(n_name, reverse(n_name)) AS INTEGER) AS d FROM nation")
def transposition_distance(spark, sf):
    n = table(spark, sf, "nation").select("n_name")
    return n.select("n_name", sq.damerau_levenshtein(F.col("n_name"), F.reverse("n_name")).alias("d"))


_SEQ = "translate(substr(sha256(p_name), 1, 24), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@_query(f"SELECT p_partkey, translate(s, 'ACGT', 'TGCA') AS comp, reverse(translate(s, 'ACGT', 'TGCA')) AS rc, ROUND(length(regexp_replace(s, '[^GC]', '', 'g')) / 24.0, 6) AS gc FROM (SELECT p_partkey, {_SEQ} AS s FROM part)")
def sequence_functions(spark, sf):
    s = F.translate(F.substring(F.sha2("p_name", 256), 1, 24), "0123456789abcdef", "ACGTACGTACGTACGT")
    t = table(spark, sf, "part").select("p_partkey", s.alias("s"))
    return t.select("p_partkey", sq.complement(F.col("s")).alias("comp"), sq.reverse_complement(F.col("s")).alias("rc"), _r(sq.gc_fraction(F.col("s"))).alias("gc"))


@_query("""WITH q AS (SELECT l_orderkey, ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, CAST(l_quantity AS INTEGER)) AS i, CAST(l_quantity AS INTEGER) - 20 AS d FROM lineitem), c AS (SELECT *, SUM(d) OVER (PARTITION BY l_orderkey ORDER BY i) AS t FROM q),
m AS (SELECT *, t - LEAST(0, MIN(t) OVER (PARTITION BY l_orderkey ORDER BY i)) AS s FROM c), b AS (SELECT *, MAX(s) OVER (PARTITION BY l_orderkey) AS top FROM m)
SELECT l_orderkey, CAST(COALESCE(MIN(CASE WHEN s = top AND top > 0 THEN i END), 0) AS INTEGER) AS kept FROM b GROUP BY 1""")
def quality_trim(spark, sf):
    q = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("qs"))
    return q.select("l_orderkey", sq.trim_quality(F.transform("qs", lambda x: x["q"]), 20).alias("kept"))


def _vcf(spark, sf):
    ref, alt = F.element_at(F.array(*map(F.lit, "ACGT")), (F.col("p_partkey") % 4 + 1).cast("int")), F.element_at(F.array(*map(F.lit, "ACGT")), ((F.col("p_partkey") + F.col("p_size") % 3 + 1) % 4 + 1).cast("int"))
    line = F.concat_ws("\t", F.concat(F.lit("chr"), (F.col("p_partkey") % 3).cast("string")), F.col("p_partkey").cast("string"), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("rs"), "p_partkey")).otherwise("."),
                       ref, alt, F.lit("50"), F.when(F.col("p_size") > 25, "PASS").otherwise("q10;s50"), F.concat(F.lit("DP="), F.col("p_size").cast("string")), F.lit("GT:DP"), F.lit("0/1:3"), F.when(F.col("p_size") % 5 == 0, "./.").otherwise("1/1:9"))
    return va.parse_vcf(table(spark, sf, "part").select(line.alias("value")), ["s1", "s2"])


@_query("""SELECT CAST(p_partkey % 3 AS VARCHAR) AS chrom, p_partkey - 1 AS start, CASE WHEN p_size % 2 = 0 THEN 'rs' || p_partkey ELSE '' END AS id, CAST(p_size AS VARCHAR) AS DP,
CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS filter_PASS FROM part""")
def vcf_flatten(spark, sf):
    return va.flatten(_vcf(spark, sf), ["DP"], ["PASS"]).select("chrom", "start", "id", "DP", "filter_PASS")


@_query("SELECT p_partkey - 1 AS start FROM part WHERE p_size % 2 = 0 AND p_size <= 25")
def vcf_filter(spark, sf):
    return va.filter_records(_vcf(spark, sf), with_id=True, all_of=["q10", "s50"], none_of=["PASS"]).select("start")


@_query("SELECT 's' || i AS sample, CAST(SUM((i = 1 OR p_size % 5 <> 0)::INT) AS BIGINT) AS called FROM part, range(1, 3) t(i) GROUP BY 1")
def vcf_genotypes(spark, sf):
    return va.calls(_vcf(spark, sf), ["s1", "s2"]).groupBy("sample").agg(F.count("a1").alias("called"))


@_query("""WITH c AS (SELECT p_size % 7 AS sample, p_partkey % 2 = 0 AS known, substr('ACGT', CAST(p_partkey % 4 + 1 AS INTEGER), 1) AS r, substr('ACGT', CAST((p_partkey + p_size % 3 + 1) % 4 + 1 AS INTEGER), 1) AS a FROM part)
SELECT sample, SUM(known::BIGINT) AS known, SUM((NOT known)::BIGINT) AS novel, SUM((r || a IN ('AG','GA','CT','TC'))::BIGINT) AS ti, SUM((r || a NOT IN ('AG','GA','CT','TC'))::BIGINT) AS tv FROM c GROUP BY 1""")
def variant_ti_tv(spark, sf):
    base = F.array(*map(F.lit, "ACGT"))
    t = table(spark, sf, "part").select(
        (F.col("p_size") % 7).alias("sample"), (F.col("p_partkey") % 2 == 0).alias("known"), F.element_at(base, (F.col("p_partkey") % 4 + 1).cast("int")).alias("ref"),
        F.element_at(base, ((F.col("p_partkey") + F.col("p_size") % 3 + 1) % 4 + 1).cast("int")).alias("alt"),
    )
    return va.ti_tv(t).drop("ratio")


@_query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_partkey & 5) = 5 AND (l_partkey & 16) = 0 AND l_suppkey % 60 >= 20")
def alignment_filter(spark, sf):
    r = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("flag"), (F.col("l_suppkey") % 60).alias("mapq"))
    return va.filter_alignments(r, 5, 16, 20).select("l_orderkey", "l_linenumber")


@_query("""SELECT p_brand AS chrom, p_size AS start, p_size + 1 AS "end", string_agg(DISTINCT substr(p_type, 1, 1), '/' ORDER BY substr(p_type, 1, 1)) AS alleles, COUNT(*) AS n FROM part GROUP BY 1, 2, 3""")
def variant_merge(spark, sf):
    calls = table(spark, sf, "part").select(F.col("p_brand").alias("chrom"), F.col("p_size").alias("start"), (F.col("p_size") + 1).alias("end"), F.substring("p_type", 1, 1).alias("allele"), F.col("p_partkey").cast("string").alias("individual"))
    return va.merge_sparse(calls).drop("individuals")


@_query("""WITH s AS (SELECT sample, locus, 2 - x AS r, x AS o FROM geno), m AS (SELECT * FROM (VALUES (1, 'HET', 1, 0), (2, 'NOTREF', 1, 1), (3, 'REF', 0, 1)) t(sample, term, cost, score)),
f AS (SELECT locus, cost, score, CASE term WHEN 'HET' THEN r > 0 AND o > 0 WHEN 'NOTREF' THEN o > 0 ELSE r > 0 AND o = 0 END AS ok FROM s JOIN m USING (sample))
SELECT locus, CAST(SUM(CASE WHEN ok THEN 0 ELSE cost END) AS BIGINT) AS cost, CAST(SUM(CASE WHEN ok THEN score ELSE 0 END) AS BIGINT) AS score FROM f GROUP BY 1
HAVING SUM(CASE WHEN ok THEN 0 ELSE cost END) < 2 AND SUM(CASE WHEN ok THEN score ELSE 0 END) >= 1""".replace("WITH s", "WITH " + GENO + ", s"))
def segregation_model(spark, sf):
    geno = _dosages(spark, sf).select("sample", "locus", (2 - F.col("x")).alias("ref_alleles"), F.col("x").alias("other_alleles"))
    model = spark.createDataFrame([(1, "HET", 1, 0), (2, "NOTREF", 1, 1), (3, "REF", 0, 1)], "sample long, term string, cost int, score int")
    return va.segregation(geno, model, "locus", 2, 1)


@_query("""SELECT c_custkey AS id, CASE WHEN d1 <= 6 AND d2 - d1 >= 1 THEN CASE WHEN a <= b AND a <= c THEN 'A' WHEN b <= c THEN 'B' ELSE 'C' END END AS barcode, CAST(d1 AS INTEGER) AS distance FROM
(SELECT *, LEAST(a, b, c) AS d1, a + b + c - LEAST(a, b, c) - GREATEST(a, b, c) AS d2 FROM
(SELECT c_custkey, levenshtein(c_mktsegment, 'BUILDING') AS a, levenshtein(c_mktsegment, 'MACHINERY') AS b, levenshtein(c_mktsegment, 'HOUSEHOLD') AS c FROM customer))""")
def barcode_assignment(spark, sf):
    reads = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("seq"))
    return va.nearest_barcode(reads, [("A", "BUILDING"), ("B", "MACHINERY"), ("C", "HOUSEHOLD")], 6)


# --- locus filters and two sets of genotypes ------------------------------------------------

_TENS = "SELECT i AS locus FROM range(0, 40, 10) t(i)"


@_query("WITH " + GENO + """, m AS (SELECT locus, LEAST(SUM(x), SUM(2 - x)) * 1.0 / (2 * COUNT(*)) AS maf FROM geno GROUP BY 1)
SELECT locus, ROUND(maf, 6) AS maf FROM m WHERE maf >= CASE WHEN locus % 10 = 0 THEN 0.2 ELSE 0.45 END""")
def locus_filter_maf(spark, sf):
    maf = g.minor_major(_voted(spark, sf)).select("locus", F.col("minor_freq").alias("maf"))
    return lo.by_maf(maf, 0.45, spark.range(0, 40, 10), 0.2).select("locus", _r("maf").alias("maf"))


@_query(f"SELECT * FROM ({ORACLE_SQL['hwp_exact']}) WHERE p >= 0.05")
def locus_filter_hwp(spark, sf):
    return lo.by_hwp(_voted(spark, sf), 0.05).select("locus", _r("hwp").alias("p"))


@_query("WITH " + LOCI + " SELECT locus, location FROM loci WHERE location < 3000 OR (location >= 8000 AND location < 12000) OR location >= 30000")
def locus_filter_range(spark, sf):
    return lo.by_range(v.loci(spark, sf), "-3000,12000-8000,30000-").select("locus", "location")


@_query("WITH " + TRIP + """, t AS (SELECT locus, COUNT(a1) AS called, COUNT(*) AS total FROM trip GROUP BY 1)
SELECT locus, called, total, ROUND(called * 1.0 / total, 9) AS completion FROM t WHERE called >= 100 AND called * 1.0 / total >= 0.85""")
def locus_filter_completion(spark, sf):
    return lo.by_completion(v.triples(spark, sf), 100, 0.85).withColumn("completion", _r("completion", 9))


@_query("WITH " + LOCI + f", m AS (SELECT chrom, location FROM loci WHERE locus IN ({_TENS})) SELECT locus, chrom FROM loci l WHERE EXISTS (SELECT 1 FROM m WHERE m.chrom = l.chrom AND ABS(m.location - l.location) <= 5000)")
def loci_near_monitored(spark, sf):
    return lo.near_monitored(v.loci(spark, sf), spark.range(0, 40, 10), 5000).select("locus", "chrom")


#: A second set of genotypes: a lower threshold, and heterozygotes where the number of called replicates is odd.
_SECOND = """, g2 AS (SELECT sample, locus, CASE WHEN t % 2 = 1 THEN 1 WHEN a1 = 'B' THEN 2 WHEN a2 = 'B' THEN 1 ELSE 0 END AS x
FROM r WHERE rn = 1 AND n > COALESCE(n2, 0) AND n * 1.0 / t >= 0.3), cc AS (SELECT locus, geno.x AS x, g2.x AS y FROM geno FULL JOIN g2 USING (sample, locus))"""
_TREND = "COALESCE(POWER(COUNT(x * y) * SUM(x * y) - SUM(CASE WHEN y IS NOT NULL THEN x END) * SUM(CASE WHEN x IS NOT NULL THEN y END), 2) / NULLIF((COUNT(x * y) * SUM(CASE WHEN y IS NOT NULL THEN x * x END) - POWER(SUM(CASE WHEN y IS NOT NULL THEN x END), 2)) * (COUNT(x * y) * SUM(CASE WHEN x IS NOT NULL THEN y * y END) - POWER(SUM(CASE WHEN x IS NOT NULL THEN y END), 2)), 0), 0)"
_FREQS = """COUNT(*) AS samples, ROUND(AVG((x IS NULL)::INT), 6) AS missing1, ROUND(LEAST(AVG(x) / 2, 1 - AVG(x) / 2), 6) AS maf1,
ROUND(AVG((y IS NULL)::INT), 6) AS missing2, ROUND(LEAST(AVG(y) / 2, 1 - AVG(y) / 2), 6) AS maf2"""


def _second(spark, sf):
    merged = g.merge(v.triples(spark, sf), "vote", 0.3).where("a1 IS NOT NULL")
    odd = F.col("called") % 2 == 1
    return merged.select("sample", "locus", F.when(odd, "A").otherwise(F.col("a1")).alias("a1"), F.when(odd, "B").otherwise(F.col("a2")).alias("a2"))


def _rounded(df, *columns):
    return df.withColumns({c: _r(c) for c in columns})


@_query("WITH " + GENO + _SECOND + f" SELECT locus, {_FREQS}, ROUND(SUM((x = y)::INT) * 1.0 / COUNT(x * y), 6) AS concordance, COUNT(x * y) AS comps, ROUND({_TREND}, 6) AS r2_trend FROM cc GROUP BY 1")
def genotype_correlation(spark, sf):
    return _rounded(lo.genotype_correlation(_voted(spark, sf), _second(spark, sf)), "missing1", "maf1", "missing2", "maf2", "concordance", "r2_trend")


@_query("WITH " + GENO + _SECOND + f" SELECT locus, {_FREQS}, ROUND({_TREND}, 6) AS r2 FROM cc GROUP BY 1")
def dosage_correlation(spark, sf):
    half = lambda df: df.select("sample", "locus", (g.dosage("A") / 2).alias("x"))
    return _rounded(lo.dosage_correlation(half(_voted(spark, sf)), half(_second(spark, sf))), "missing1", "maf1", "missing2", "maf2", "r2")


@_query("WITH " + GENO + _SECOND + """, k AS (SELECT locus, SUM((x = y)::BIGINT) AS same, SUM((x = 2 - y)::BIGINT) AS other FROM cc WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1)
SELECT locus, CAST(GREATEST(same, other) AS BIGINT) AS concord, CASE WHEN same > other THEN 'C' ELSE 'A' END AS g_is, CASE WHEN same > other THEN 'complement' ELSE 'other' END AS category FROM k""")
def allele_remap(spark, sf):
    named = lambda df, a, b: df.select("sample", "locus", *[F.when(F.col(c) == "A", a).otherwise(b).alias(c) for c in ("a1", "a2")])
    right = named(_second(spark, sf), "T", "G")
    found = lo.remap_alleles(named(_voted(spark, sf), "A", "C"), right.select("sample", "locus", *[c.alias(n) for c, n in zip(g.genotype(F.col("a1"), F.col("a2")), ("a1", "a2"))]))
    return found.select("locus", "concord", F.try_element_at("allele_map", F.lit("G")).alias("g_is"), "category")


# --- families -------------------------------------------------------------------------------


def _families(spark, sf):
    s = F.col("s_suppkey")
    first = s - s % 10
    return table(spark, sf, "supplier").where(s % 10 >= 7).select(s.alias("name"), first.alias("parent1"), (first + 1).alias("parent2"))


@_query("WITH " + GENO + """, f AS (SELECT s_suppkey AS child, s_suppkey - s_suppkey % 10 AS p1, s_suppkey - s_suppkey % 10 + 1 AS p2 FROM supplier WHERE s_suppkey % 10 >= 7),
t AS (SELECT c.locus, p1, p2, child, CASE WHEN ABS(c.x - a.x) = 2 OR ABS(c.x - b.x) = 2 THEN 1 WHEN c.x BETWEEN (a.x = 2)::INT + (b.x = 2)::INT AND (a.x > 0)::INT + (b.x > 0)::INT THEN 0 ELSE 2 END AS level
FROM f JOIN geno c ON c.sample = child JOIN geno a ON a.sample = p1 AND a.locus = c.locus JOIN geno b ON b.sample = p2 AND b.locus = c.locus),
u AS (SELECT *, COUNT(*) OVER w AS n, MAX((level = 1)::INT) OVER w AS first FROM t WINDOW w AS (PARTITION BY locus, p1, p2))
SELECT locus, p1 AS parent1, p2 AS parent2, child, level FROM u WHERE n = 3 AND (level = 1 OR (level = 2 AND first = 0))""")
def family_errors(spark, sf):
    return pd.family_errors(_voted(spark, sf), _families(spark, sf))


@_query()
def genotype_elimination(spark, sf):
    return pd.genotype_elimination(_voted(spark, sf), _families(spark, sf)).select("locus", "sample", F.array_join("possible", ",").alias("possible"))


# --- genotype files, written and read again -------------------------------------------------

_CALLED = "WITH " + GENO + " SELECT CAST(sample AS VARCHAR) AS sample, CAST(locus AS VARCHAR) AS locus, a1, a2 FROM geno"


@_query(_CALLED)
def bed_matrix_roundtrip(spark, sf):
    stem = Workspace(spark, "bed").at("genotypes")
    pl.write_bed_matrix(_voted(spark, sf), stem, v.loci(spark, sf))
    return g.drop_missing(pl.read_bed_matrix(spark, f"{stem}.bed"))


@_query(_CALLED)
def tped_roundtrip(spark, sf):
    stem = Workspace(spark, "tped").at("genotypes")
    pl.write_tped(_voted(spark, sf), stem, v.loci(spark, sf))
    return g.drop_missing(sg.read_tped(spark, f"{stem}.tped", f"{stem}.tfam"))


@_query(_CALLED)
def vcf_roundtrip(spark, sf):
    path = Workspace(spark, "vcf").at("genotypes.vcf")
    pl.write_vcf(_voted(spark, sf), path, v.loci(spark, sf))
    return g.drop_missing(sg.read_genotypes(spark, path))


@_query(_CALLED)
def probabilities_roundtrip(spark, sf):
    path = Workspace(spark, "probabilities").at("genotypes")
    samples = ex.write_probabilities(_voted(spark, sf), path, v.loci(spark, sf))
    return g.drop_missing(ex.read_probabilities(spark, path, [str(s) for s in samples]))


@_query(_CALLED)
def dosage_table_roundtrip(spark, sf):
    path = Workspace(spark, "dosages").at("genotypes")
    ex.write_dosage_table(_voted(spark, sf), path, v.loci(spark, sf))
    return g.drop_missing(ex.read_dosage_table(spark, path))


@_query("WITH " + TRIP + """, a AS (SELECT locus, COUNT(DISTINCT x) AS k FROM (SELECT locus, a1 AS x FROM trip UNION ALL SELECT locus, a2 FROM trip) WHERE x IS NOT NULL GROUP BY 1)
SELECT COUNT(DISTINCT sample) AS samples, COUNT(DISTINCT locus) AS loci, COUNT(*) AS cells, COUNT(a1) AS called, CAST(0 AS BIGINT) AS half_called, (SELECT COUNT(*) FROM a WHERE k = 1) AS monomorphic,
(SELECT COUNT(*) FROM a WHERE k = 2) AS biallelic, (SELECT COUNT(*) FROM a WHERE k > 2) AS multiallelic FROM trip""")
def genotype_contents(spark, sf):
    return ex.contents(v.triples(spark, sf))


# --- composition, strands and intensities ---------------------------------------------------

_BASES = "translate(sha256(CAST(p_partkey AS VARCHAR)), '0123456789abcdef', 'ACGTACGTACGTACGN')"


def _bases(spark, sf):
    text = F.sha2(F.col("p_partkey").cast("string"), 256)
    return table(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.translate(text, "0123456789abcdef", "ACGTACGTACGTACGN").alias("seq"))


@_query(f"""WITH s AS (SELECT p_partkey AS name, {_BASES} AS seq FROM part), p AS (SELECT name, seq, pos, w, GREATEST(0, pos - w // 2) AS lo, LEAST(64, pos + (w + 1) // 2) AS hi FROM s, range(0, 64, 8) r(pos), (VALUES (5), (20)) t(w)),
t AS (SELECT *, substr(seq, lo + 1, hi - lo) AS u, CASE WHEN lo = 0 THEN substr(seq, 1, hi) ELSE substr(seq, lo, hi - lo + 1) END AS e FROM p),
n AS (SELECT *, length(regexp_replace(u, '[^ACGT]', '', 'g')) * 1.0 AS valid FROM t)
SELECT name, pos, CAST(w AS INTEGER) AS "window", ROUND(COALESCE(length(regexp_replace(u, '[^GC]', '', 'g')) / NULLIF(valid, 0), 0), 9) AS gc, ROUND(COALESCE((length(e) - length(replace(e, 'CG', ''))) / NULLIF(valid, 0), 0), 9) AS cpg FROM n""")
def gc_windows(spark, sf):
    seqs = _bases(spark, sf)
    places = seqs.select("name", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(56).cast("bigint"), F.lit(8).cast("bigint"))).alias("pos"))
    found = cp.window_shares(cp.tiles(seqs, 16), places, [5, 20], 16)
    return found.select("name", "pos", "window", _r("gc", 9).alias("gc"), _r("cpg", 9).alias("cpg"))


_STRAND = "CASE WHEN {0} IN ('A','T') AND {1} IN ('C','G') THEN 'Top' WHEN {1} IN ('A','T') AND {0} IN ('C','G') THEN 'Bot' END"


@_query(f"""WITH s AS (SELECT p_partkey AS name, {_BASES} AS q FROM part), f AS (SELECT name, q, LEAST(substr(q, 17, 1), substr(q, 18, 1)) AS lo, GREATEST(substr(q, 17, 1), substr(q, 18, 1)) AS hi FROM s),
t AS (SELECT *, COALESCE({_STRAND.format("lo", "hi")}, list_filter(list_transform(range(0, 8), lambda i: {_STRAND.format("substr(q, 8 - i, 1)", "substr(q, 9 + i, 1)")}), lambda x: x IS NOT NULL)[1], 'Unknown') AS strand FROM f)
SELECT name, strand, CASE WHEN strand = 'Bot' THEN hi ELSE lo END AS a, CASE WHEN strand = 'Bot' THEN lo ELSE hi END AS b FROM t""")
def snp_strand(spark, sf):
    q = lambda k, n: F.substring("seq", k, n)
    text = F.concat(q(1, 8), F.lit("["), q(17, 1), F.lit("/"), q(18, 1), F.lit("]"), q(9, 8))
    seqs = _bases(spark, sf)
    seqs = seqs.repartition((seqs.count() >> 16) + 1, "name")  # a small file holds many rows
    return seqs.select("name", sq.snp_strand(text).alias("s")).select("name", "s.*")


@_query("""SELECT c_custkey AS id, ROUND((SQRT(ABS(c_acctbal) + 1) - 1) / 0.5, 6) AS root, ROUND(LN(ABS(c_acctbal) + 1) / LN(2), 6) AS log2,
ROUND(SIGN(c_acctbal) * (SQRT(ABS(c_acctbal) + 1) - 1) / 0.5, 6) AS signed_root, ROUND(SIGN(c_acctbal) * LN(ABS(c_acctbal) + 1), 6) AS signed_log FROM customer""")
def power_transforms(spark, sf):
    x = F.col("c_acctbal")
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), _r(it.boxcox(F.abs(x), 0.5, -1)).alias("root"), _r(it.boxcox(F.abs(x), 0, -1, 2)).alias("log2"),
        _r(it.modulus(x, 0.5)).alias("signed_root"), _r(it.modulus(x)).alias("signed_log"),
    )


@_query("""WITH t AS (SELECT c_custkey AS id, c_nationkey AS k, c_acctbal AS x, c_custkey * 5.0 AS y FROM customer), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY k ORDER BY x, y) AS rx, ROW_NUMBER() OVER (PARTITION BY k ORDER BY y, x) AS ry FROM t)
SELECT a.id, ROUND(LEAST(GREATEST((a.x + b.y) / 2, 0.5 * a.x), 2 * a.x), 4) AS x, ROUND(LEAST(GREATEST((c.x + a.y) / 2, 0.5 * a.y), 2 * a.y), 4) AS y
FROM r a JOIN r b ON a.k = b.k AND a.rx = b.ry JOIN r c ON a.k = c.k AND a.ry = c.rx""")
def quantile_normalize(spark, sf):
    t = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("k"), F.col("c_acctbal").alias("x"), (F.col("c_custkey") * 5.0).alias("y"))
    return it.quantile_normalize(t, "k", "x", "y", 0.5, 2.0).select("id", _r("x", 4).alias("x"), _r("y", 4).alias("y"))


@_query("""SELECT l_returnflag AS flag, ROUND(AVG(l_extendedprice), 2) AS mean FROM (SELECT l_returnflag, l_extendedprice, ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) AS k,
FLOOR(COUNT(*) OVER (PARTITION BY l_returnflag) * 0.05::DOUBLE) AS cut, COUNT(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) WHERE k > cut AND k <= n - cut GROUP BY 1""")
def trimmed_means(spark, sf):
    return it.trimmed_mean(table(spark, sf, "lineitem").withColumnRenamed("l_returnflag", "flag"), "flag", "l_extendedprice", 0.05).select("flag", _r("mean", 2).alias("mean"))


@_query("""WITH t AS (SELECT l_orderkey AS o, l_linenumber AS n, l_partkey % 40 AS locus, l_returnflag AS f, l_extendedprice / 10000 + 0.1 AS r, l_tax * 2 + CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 0.3 ELSE 0.6 END AS th FROM lineitem),
c AS (SELECT locus, AVG(CASE WHEN f = 'A' THEN th END) AS ta, AVG(CASE WHEN f = 'A' THEN r END) AS ra, AVG(CASE WHEN f = 'N' THEN th END) AS tb, AVG(CASE WHEN f = 'N' THEN r END) AS rb,
AVG(CASE WHEN f = 'R' THEN th END) AS tc, AVG(CASE WHEN f = 'R' THEN r END) AS rc FROM t GROUP BY 1)
SELECT o, n, ROUND(LOG2(r / (1e-6 + CASE WHEN th <= ta THEN ra WHEN th <= tb THEN ra + (rb - ra) * (th - ta) / (tb - ta) WHEN th < tc THEN rb + (rc - rb) * (th - tb) / (tc - tb) ELSE rc END)), 5) + 0.0 AS lrr,
ROUND(CASE WHEN th <= ta THEN 0 WHEN th <= tb THEN (th - ta) / (tb - ta) / 2 WHEN th < tc THEN ((th - tb) / (tc - tb) + 1) / 2 ELSE 1 END, 5) AS baf FROM t JOIN c USING (locus)""")
def log_ratio_baf(spark, sf):
    flag = F.col("l_returnflag")
    offset = F.when(flag == "A", 0.0).when(flag == "N", 0.3).otherwise(0.6)
    t = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") % 40).alias("locus"), F.when(flag == "A", "AA").when(flag == "N", "AB").otherwise("BB").alias("g"),
        (F.col("l_extendedprice") / 10000 + 0.1).alias("r"), (F.col("l_tax") * 2 + offset).alias("theta"),
    )
    centres = it.cluster_centres(t)
    names = [c for c in centres.columns if c != "locus"]
    lrr, baf = it.log_ratio(F.col("r"), F.col("theta"), {c: F.col(c) for c in names})
    return t.join(centres, "locus").select("o", "n", (_r(lrr, 5) + 0.0).alias("lrr"), _r(baf, 5).alias("baf"))


# --- annotation and adjustment ---------------------------------------------------------------


def _genes(spark, sf):
    k = F.col("p_partkey")
    at = lambda n: (k * 400 + n).cast("bigint")
    return table(spark, sf, "part").select(
        k.cast("string").alias("gene"), F.col("p_brand").alias("symbol"), (k % 3).cast("string").alias("chrom"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"), at(0).alias("tx_start"), at(300).alias("tx_end"),
        at(20).alias("cds_start"), F.when(k % 5 == 0, at(20)).otherwise(at(250)).alias("cds_end"), F.array(at(0), at(120), at(200)).alias("exon_starts"), F.array(at(60), at(160), at(300)).alias("exon_ends"),
    )


_FEATURES = """g AS (SELECT p_partkey AS k, p_partkey * 400 AS b, p_partkey % 2 = 0 AS fwd, p_partkey % 5 = 0 AS nc, CAST(p_partkey % 3 AS VARCHAR) AS chrom FROM part),
f AS (SELECT k, chrom, b + s AS fs, b + e AS fe, CASE WHEN what <> 'EXON' THEN CASE WHEN what = 'SIDE1' THEN CASE WHEN fwd THEN 'upstream' ELSE 'downstream' END WHEN what = 'SIDE2' THEN CASE WHEN fwd THEN 'downstream' ELSE 'upstream' END ELSE what END
WHEN nc THEN 'NONCODING' WHEN e <= 20 THEN CASE WHEN fwd THEN 'UTR5' ELSE 'UTR3' END WHEN s >= 250 THEN CASE WHEN fwd THEN 'UTR3' ELSE 'UTR5' END ELSE 'CDS' END AS feature,
CASE WHEN what LIKE 'SIDE%' THEN 0 WHEN what = 'intron' THEN CASE WHEN fwd THEN n ELSE 3 - n END ELSE CASE WHEN fwd THEN n ELSE 4 - n END END AS number
FROM g, (VALUES (0, 20, 'EXON', 1), (20, 60, 'EXON', 1), (60, 120, 'intron', 1), (120, 160, 'EXON', 2), (160, 200, 'intron', 2), (200, 250, 'EXON', 3), (250, 300, 'EXON', 3), (-100, 0, 'SIDE1', 0), (300, 400, 'SIDE2', 0)) t(s, e, what, n))"""


@_query("WITH " + _FEATURES + """, v AS (SELECT o_orderkey AS name, CAST(o_custkey % 3 AS VARCHAR) AS chrom, o_orderkey * 97 % 800000 AS s, o_orderkey * 97 % 800000 + o_custkey % 12 AS e FROM orders)
SELECT DISTINCT name, v.chrom, CAST(k AS VARCHAR) AS gene, CASE WHEN feature = 'intron' AND (s < fs + 5 OR GREATEST(e, s + 1) > fe - 5) THEN 'SPLICE' ELSE feature END AS feature, CAST(number AS INTEGER) AS number
FROM v LEFT JOIN f ON f.chrom = v.chrom AND s < fe AND GREATEST(fs, 0) < GREATEST(e, s + 1)""")
def variant_annotation(spark, sf):
    start = F.col("o_orderkey") * 97 % 800000
    variants = table(spark, sf, "orders").select(F.col("o_orderkey").alias("name"), (F.col("o_custkey") % 3).cast("string").alias("chrom"), start.alias("start"), (start + F.col("o_custkey") % 12).alias("end"))
    return an.annotate_variants(variants, _genes(spark, sf), 100).select("name", "chrom", "gene", "feature", "number")


@_query("""WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, l_suppkey % 25 AS c, l_partkey % 60 AS p, l_returnflag AS f FROM lineitem),
h AS (SELECT c, p, f, COUNT(DISTINCT CASE WHEN c_nationkey < 10 THEN c_name END) AS i, COUNT(DISTINCT CASE WHEN c_nationkey >= 10 THEN c_name END) AS o FROM (SELECT DISTINCT c, p, f FROM l)
JOIN customer ON c = c_nationkey AND p = c_custkey % 60 AND substr(c_mktsegment, 1, 1) IN (f, 'B') GROUP BY 1, 2, 3)
SELECT l.o, l.n, CAST(COALESCE(h.i, 0) AS INTEGER) AS ingroup, CAST(COALESCE(h.o, 0) AS INTEGER) AS outgroup FROM l LEFT JOIN h USING (c, p, f)""")
def known_variant_subjects(spark, sf):
    place = lambda a, b: [a.cast("string").alias("chrom"), b.alias("start"), (b + 1).alias("end")]
    own = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *place(F.col("l_suppkey") % 25, F.col("l_partkey") % 60), F.array(F.col("l_returnflag"), F.lit("B")).alias("alleles"))
    customers = table(spark, sf, "customer")
    known = customers.select(*place(F.col("c_nationkey"), F.col("c_custkey") % 60), F.array(F.substring("c_mktsegment", 1, 1)).alias("alleles"), F.array("c_name").alias("subjects"))
    found = an.known_variants(own, known, customers.where("c_nationkey < 10").select("c_name"))
    return found.select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.size("ingroup").alias("ingroup"), F.size("outgroup").alias("outgroup"))


@_query("""WITH b AS (SELECT l_partkey AS locus, CASE l_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END AS ref, l_returnflag AS base, CAST(l_quantity AS INTEGER) AS q, POWER(10, -CAST(l_quantity AS INTEGER) / 10.0) AS w FROM lineitem),
c AS (SELECT locus, ref, base, COUNT(*) AS n, SUM(LN(1 - w)) AS good, SUM(LN(w)) AS bad FROM b GROUP BY ALL), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY locus ORDER BY n DESC, base) AS k, SUM(bad) OVER (PARTITION BY locus) AS t, SUM(n) OVER (PARTITION BY locus) AS m FROM c),
p AS (SELECT a.locus, a.ref, a.base AS one, COALESCE(b.base, CASE WHEN a.base = a.ref THEN 'N' ELSE a.ref END) AS two, a.n AS n1, COALESCE(b.n, 0) AS n2, a.good AS g1, COALESCE(b.good, 0) AS g2, a.bad AS b1, COALESCE(b.bad, 0) AS b2, a.t, a.m FROM r a LEFT JOIN r b ON a.locus = b.locus AND b.k = 2 WHERE a.k = 1),
s AS (SELECT *, two = ref OR (one <> ref AND one > two) AS x FROM p), o AS (SELECT locus, ref, t, m, CASE WHEN x THEN two ELSE one END AS a, CASE WHEN x THEN one ELSE two END AS b, CASE WHEN x THEN n2 ELSE n1 END AS n_a, CASE WHEN x THEN n1 ELSE n2 END AS n_b,
CASE WHEN x THEN g2 ELSE g1 END AS ga, CASE WHEN x THEN g1 ELSE g2 END AS gb, CASE WHEN x THEN b2 ELSE b1 END AS ba, CASE WHEN x THEN b1 ELSE b2 END AS bb FROM s),
l AS (SELECT *, ga + t - ba + CASE WHEN a = ref THEN LN(0.95) ELSE 0 END AS laa, gb + t - bb + CASE WHEN a = ref THEN LN(0.025) ELSE 0 END AS lbb, ga + gb + t - ba - bb - m * LN(2) + CASE WHEN a = ref THEN LN(0.025) ELSE 0 END AS lab FROM o),
z AS (SELECT *, EXP(laa - GREATEST(laa, lab, lbb)) AS eaa, EXP(lab - GREATEST(laa, lab, lbb)) AS eab, EXP(lbb - GREATEST(laa, lab, lbb)) AS ebb FROM l)
SELECT locus, a, b, n_a, n_b, ROUND(CASE WHEN a = ref AND n_b = 0 THEN 1 ELSE eaa / (eaa + eab + ebb) END, 6) AS p_aa, ROUND(CASE WHEN a = ref AND n_b = 0 THEN 0 ELSE eab / (eaa + eab + ebb) END, 6) AS p_ab FROM z""")
def genotype_posteriors(spark, sf):
    k = F.col("l_partkey")
    bases = table(spark, sf, "lineitem").select(k.alias("locus"), F.when(k % 3 == 0, "A").when(k % 3 == 1, "N").otherwise("R").alias("ref"), F.col("l_returnflag").alias("base"), F.col("l_quantity").cast("int").alias("qual"))
    return an.genotype_posteriors(bases).select("locus", "a", "b", "n_a", "n_b", _r("p_aa").alias("p_aa"), _r("p_ab").alias("p_ab"))


@_query("""WITH t AS (SELECT l_orderkey AS o, l_linenumber AS n, l_suppkey AS s, l_extendedprice / 1000 AS v, l_quantity AS a, l_tax AS b FROM lineitem),
c AS (SELECT s, AVG(a) AS ma, AVG(b) AS mb, VAR_POP(a) AS aa, VAR_POP(b) AS bb, COVAR_POP(a, b) AS ab, COVAR_POP(a, v) AS av, COVAR_POP(b, v) AS bv FROM t GROUP BY 1)
SELECT o, n, ROUND(v - (a - ma) * (av * bb - bv * ab) / (aa * bb - ab * ab) - (b - mb) * (bv * aa - av * ab) / (aa * bb - ab * ab), 5) + 0.0 AS corrected FROM t JOIN c USING (s)""")
def correct_by_terms(spark, sf):
    t = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_suppkey").alias("s"), (F.col("l_extendedprice") / 1000).alias("v"), F.col("l_quantity").alias("a"), F.col("l_tax").alias("b"))
    return ad.correct_by_terms(t, "s", "v", ["a", "b"]).select("o", "n", (_r("corrected", 5) + 0.0).alias("corrected"))


@_query("""SELECT 'continuous' AS kind, COUNT(*) AS n, COUNT(DISTINCT c_acctbal) AS "distinct", MIN(c_acctbal) AS min, ROUND(AVG(c_acctbal), 4) AS mean, ROUND(MEDIAN(c_acctbal), 4) AS median, MAX(c_acctbal) AS max, ROUND(STDDEV_POP(c_acctbal), 4) AS sd FROM customer""")
def variable_summary(spark, sf):
    out = ad.variable_summary(table(spark, sf, "customer"), "c_acctbal")
    return out.withColumns({c: _r(c, 4) for c in ("mean", "median", "sd")})


@_query()
def admixture_shares(spark, sf):
    geno = _dosages(spark, sf)
    populations = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("sample"), (F.col("s_nationkey") % 3).alias("population"))
    return ad.admixture(geno, ad.population_frequencies(geno, populations)).withColumns({"share": _r("share", 4), "loglik": _r("loglik", 4)})


# --- events (an extension) ------------------------------------------------------------------


@_query("SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM events GROUP BY 1, 2")
def event_hours(spark, sf):
    return ev.windowed(table(spark, sf, "events"), "1 hour").select(F.unix_timestamp("start").alias("start"), "event_type", "n", _r("total", 4).alias("total"))


@_query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - LAG(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, SUM(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(MIN(ts), '%Y-%m-%d %H:%M:%S') AS start, strftime(MAX(ts) + INTERVAL 6 HOUR, '%Y-%m-%d %H:%M:%S') AS "end", COUNT(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(spark, sf):
    return ev.sessions(table(spark, sf, "events"), "6 hours").select("user_id", *[F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c) for c in ("start", "end")], "n")


@_query("SELECT DISTINCT user_id, event_type FROM events")
def event_first(spark, sf):
    return ev.first_only(table(spark, sf, "events"), ["user_id", "event_type"]).select("user_id", "event_type")
