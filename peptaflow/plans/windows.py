"""Ranking, running values, runs and rank statistics on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import joins, statistics, windows
from .registry import Tables, query

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def _top_order() -> list:
    return [F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey"]


_SQL_TOP = "(PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey)"


@query(f"""SELECT s_suppkey, CASE WHEN pos = 0 THEN -1.0 ELSE round(hits / pos, 6) END AS recall FROM supplier LEFT JOIN (
SELECT l_suppkey, CAST(sum(CASE WHEN l_returnflag = 'R' AND rk <= 20 THEN 1 ELSE 0 END) AS DOUBLE) AS hits, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) AS pos
FROM (SELECT *, row_number() OVER {_SQL_TOP} rk FROM lineitem) GROUP BY l_suppkey) ON l_suppkey = s_suppkey""")
def topn_recall_pivot(t: Tables) -> DataFrame:
    li = t.lineitem.select(*LINE, "l_extendedprice", "l_returnflag")
    hit = (F.col("l_returnflag") == "R").cast("long")
    top = joins.top_by(li, ["l_suppkey"], _top_order(), 20).groupBy("l_suppkey").agg(F.sum(hit).alias("hits"))
    pos = li.groupBy("l_suppkey").agg(F.sum(hit).alias("pos"))
    j = t.supplier.select("s_suppkey").join(top.join(pos, "l_suppkey"), F.col("s_suppkey") == F.col("l_suppkey"), "left")
    return j.select("s_suppkey", F.when(F.col("pos") == 0, -1.0).otherwise(F.round(F.col("hits") / F.col("pos"), 6)).alias("recall"))


@query(f"SELECT l_suppkey, l_orderkey, l_linenumber, l_partkey, CAST(row_number() OVER {_SQL_TOP} AS INTEGER) AS rk FROM lineitem QUALIFY rk <= 20")
def topn_per_group(t: Tables) -> DataFrame:
    li = t.lineitem.select(*LINE, "l_extendedprice")
    return joins.top_by(li, ["l_suppkey"], _top_order(), 20).select(*LINE, "rk")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1000")
def top1000(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(1000)


@query("SELECT o_orderkey, row_number() OVER (ORDER BY nullif(o_totalprice, 1013.7) DESC NULLS LAST, o_orderkey) AS rk FROM orders")
def rank_first(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", F.nullif("o_totalprice", F.lit(1013.7)).alias("p"))
    return windows.rank_first(o, F.col("p"), ["o_orderkey"], "rk").select("o_orderkey", "rk")


@query("""SELECT o_orderkey, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) OVER w AS BIGINT) AS cum_cents, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS cum_f,
CAST(count(*) OVER () AS BIGINT) AS total FROM orders WINDOW w AS (ORDER BY o_totalprice DESC, o_orderkey ROWS UNBOUNDED PRECEDING)""")
def cumsum_ranked(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_totalprice", F.round(F.col("o_totalprice") * 100).cast("long").alias("c"), (F.col("o_orderstatus") == "F").cast("long").alias("f"))
    out = windows.running(o, [F.desc("o_totalprice"), "o_orderkey"], {"cum_cents": ("sum", F.col("c")), "cum_f": ("sum", F.col("f"))})
    total = o.agg(F.count(F.lit(1)).alias("total"))
    return out.join(F.broadcast(total)).select("o_orderkey", "cum_cents", "cum_f", "total")  # one row


_RUNS = """WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER w IS NOT DISTINCT FROM event_type AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run FROM a),
g AS (SELECT user_id, CAST(run AS BIGINT) AS run, min(event_type) AS event_type, count(*) AS n FROM r GROUP BY ALL)
"""


@query(_RUNS + """SELECT *, coalesce(lag(n, 1) OVER w, n) AS prev1, coalesce(lead(n, 1) OVER w, n) AS next1,
coalesce(lag(n, 2) OVER w, lag(n, 1) OVER w, n) AS prev2, coalesce(lead(n, 2) OVER w, lead(n, 1) OVER w, n) AS next2 FROM g WINDOW w AS (PARTITION BY user_id ORDER BY run)""")
def run_lengths(t: Tables) -> DataFrame:
    r = windows.runs(t.events.select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"], "event_type")
    g = r.groupBy("user_id", "run").agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"))
    return windows.run_neighbours(g, ["user_id"])


@query("""SELECT user_id, event_id, round(avg, 4) AS avg FROM (SELECT user_id, event_id, avg(value) OVER w AS avg, count(*) OVER w AS k FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)) WHERE k = 5""")
def moving_avg_valid(t: Tables) -> DataFrame:
    m = windows.moving_average(t.events.select("user_id", "event_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value", 5)
    return m.select("user_id", "event_id", F.round("avg", 4).alias("avg"))


@query("""WITH b AS (SELECT o_custkey, o_orderkey, o_totalprice, floor(o_totalprice / 100000) AS y FROM orders),
a AS (SELECT *, CASE WHEN lag(y) OVER w IS NOT DISTINCT FROM y AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)),
r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING) AS BIGINT) AS run FROM a)
SELECT o_custkey, run, round(avg(o_totalprice), 6) AS x, round(avg(y), 6) AS y, count(*) AS n FROM r GROUP BY o_custkey, run""")
def center_runs(t: Tables) -> DataFrame:
    o = t.orders.select("o_custkey", "o_orderkey", "o_totalprice", F.floor(F.col("o_totalprice") / 100000).cast("double").alias("level"))
    c = windows.centre_runs(o, ["o_custkey"], ["o_totalprice", "o_orderkey"], "o_totalprice", "level")
    return c.select("o_custkey", "run", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"), "n")


@query("SELECT l_quantity, count(*) AS n, min(r) + (count(*) - 1) / 2.0 AS midrank FROM (SELECT l_quantity, rank() OVER (ORDER BY l_quantity) AS r FROM lineitem) GROUP BY l_quantity")
def midrank(t: Tables) -> DataFrame:
    return windows.midranks(t.lineitem.select("l_quantity"), "l_quantity").select("l_quantity", "n", "midrank")


_MWU = """WITH r AS (SELECT l_extendedprice AS v, l_returnflag = 'R' AS y FROM lineitem),
g AS (SELECT v, count(*) AS n, count(CASE WHEN y THEN 1 END) AS k FROM r GROUP BY v),
m AS (SELECT *, sum(n) OVER (ORDER BY v ROWS UNBOUNDED PRECEDING) - (n - 1) / 2.0 AS mid FROM g),
s AS (SELECT CAST(sum(k) AS BIGINT) AS n1, CAST(sum(n - k) AS BIGINT) AS n2, sum(mid * k) AS r1, sum(CAST(n AS DOUBLE) * n * n - n) AS ties FROM m)
"""


@query(_MWU + "SELECT n1, n2, CAST(r1 - n1 * (n1 + 1) / 2.0 AS DOUBLE) AS u1, ties FROM s")
def mwu_u(t: Tables) -> DataFrame:
    return statistics.mwu_summary(t.lineitem, "l_extendedprice", F.col("l_returnflag") == "R")


@query(_MWU + """, u AS (SELECT *, CAST(r1 - n1 * (n1 + 1) / 2.0 AS DOUBLE) AS u1, CAST(n1 AS DOUBLE) AS a, CAST(n2 AS DOUBLE) AS b FROM s),
d AS (SELECT *, sqrt(a * b / 12 * (a + b + 1 - ties / ((a + b) * (a + b - 1)))) AS sd FROM u)
SELECT round(sd, 2) AS sd, round(greatest(abs(u1 - a * b / 2) - 0.5, 0) / sd, 6) AS z, round(1 - 2 * u1 / (a * b), 6) AS effect FROM d""")
def mwu_z(t: Tables) -> DataFrame:
    z = statistics.mwu_z(statistics.mwu_summary(t.lineitem, "l_extendedprice", F.col("l_returnflag") == "R"))
    return z.select(F.round("sd", 2).alias("sd"), F.round("z", 6).alias("z"), F.round("effect", 6).alias("effect"))


@query("""WITH a AS (SELECT *, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS rx,
rank() OVER (ORDER BY l_discount) + (count(*) OVER (PARTITION BY l_discount) - 1) / 2.0 AS ry FROM lineitem) SELECT count(*) AS n, round(corr(rx, ry), 6) AS r FROM a""")
def spearman_r(t: Tables) -> DataFrame:
    return statistics.spearman(t.lineitem, "l_quantity", "l_discount").select("n", F.round("r", 6).alias("r"))


def _scored(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id")


@query("""WITH j AS (SELECT n_chars, toxic FROM documents JOIN labels USING (doc_id)),
r AS (SELECT toxic, rank() OVER (ORDER BY n_chars) + (count(*) OVER (PARTITION BY n_chars) - 1) / 2.0 AS mid FROM j),
s AS (SELECT sum(CASE WHEN toxic = 1 THEN mid END) AS r1, sum(toxic) AS a, sum(1 - toxic) AS b FROM r)
SELECT round((r1 - a * (a + 1) / 2.0) / (a * b), 6) AS auroc, CAST(a AS BIGINT) AS n_pos, CAST(b AS BIGINT) AS n_neg FROM s""")
def auroc(t: Tables) -> DataFrame:
    a = statistics.auroc(_scored(t), F.col("n_chars"), F.col("toxic"))
    return a.select(F.round("auroc", 6).alias("auroc"), "n_pos", "n_neg")


@query("""WITH g AS (SELECT n_chars AS s, sum(toxic) AS k, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY n_chars),
r AS (SELECT k, sum(k) OVER w AS tp, sum(n) OVER w AS seen FROM g WINDOW w AS (ORDER BY s DESC ROWS UNBOUNDED PRECEDING))
SELECT round(sum(k * tp / seen) / sum(k), 6) AS average_precision FROM (SELECT CAST(k AS DOUBLE) AS k, CAST(tp AS DOUBLE) AS tp, CAST(seen AS DOUBLE) AS seen FROM r)""")
def avg_precision(t: Tables) -> DataFrame:
    return statistics.average_precision(_scored(t), F.col("n_chars"), F.col("toxic")).select(F.round("average_precision", 6).alias("average_precision"))


@query("""WITH r AS (SELECT toxic AS y, row_number() OVER (ORDER BY n_chars DESC, d.doc_id) AS rk FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT """ + ", ".join(f"CAST(sum(CASE WHEN rk <= {n} THEN coalesce(y, 0) ELSE 0 END) AS BIGINT) AS top{n}" for n in (20, 50, 100)) + """,
round(CAST(sum(CASE WHEN rk <= 20 THEN y END) AS DOUBLE) / count(CASE WHEN rk <= 20 THEN y END), 6) AS ttif,
round(CAST(sum(CASE WHEN rk <= 100 THEN coalesce(y, 0) ELSE 0 END) AS DOUBLE) / sum(coalesce(y, 0)), 6) AS fr FROM r""")
def metrics_topk(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id", "n_chars").join(t.labels.select("doc_id", "toxic"), "doc_id", "left")
    m = statistics.top_hits(j, [F.desc("n_chars"), "doc_id"], F.col("toxic"))
    return m.withColumns({"ttif": F.round("ttif", 6), "fr": F.round("fr", 6)})


@query("""WITH p AS (SELECT event_id, (value - 0.005) / 500 AS p FROM events), r AS (SELECT *, row_number() OVER (ORDER BY p, event_id) AS rk, count(*) OVER () AS m FROM p)
SELECT event_id, round(least(1, min(p * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 6) AS q FROM r""")
def bh_fdr(t: Tables) -> DataFrame:
    p = t.events.select("event_id", ((F.col("value") - 0.005) / 500).alias("p"))
    return statistics.bh_adjust(p, "p", ["event_id"]).select("event_id", F.round("q", 6).alias("q"))


@query("""WITH g AS (SELECT source, sum(1 - toxic) AS n0, sum(toxic) AS n1 FROM documents JOIN labels USING (doc_id) GROUP BY source),
w AS (SELECT sum(n0) AS a, sum(n1) AS b FROM g), e AS (SELECT source, (n1 + 1) / (n0 + n1 + 1 + a / CAST(b AS DOUBLE)) AS e FROM g, w)
SELECT doc_id, round(coalesce(e.e, (SELECT b / CAST(a + b AS DOUBLE) FROM w)), 6) AS encoded FROM documents d LEFT JOIN e ON e.source = d.source""")
def woe_encode(t: Tables) -> DataFrame:
    docs = t.documents.select("doc_id", "source")
    j = docs.join(t.labels, "doc_id")
    enc = statistics.woe(j, "source", F.col("toxic"))
    whole = j.agg(F.avg("toxic").alias("prior")).first()["prior"]  # one number
    return statistics.woe_encode(docs, enc, "source", whole, "encoded").select("doc_id", F.round("encoded", 6).alias("encoded"))


@query("""SELECT l_returnflag, percentile AS med FROM (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS percentile FROM lineitem GROUP BY l_returnflag)""")
def median_by_group(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.lit(0.5)).alias("med"))


@query("""WITH e AS (SELECT CAST(substr(p_brand, 7) AS INTEGER) AS wild, p_type, p_partkey, p_retailprice AS aff FROM part),
m AS (SELECT wild, p_type, min(aff) AS least FROM e GROUP BY ALL), w AS (SELECT wild, avg(least) AS mean FROM m GROUP BY wild)
SELECT e.p_partkey, round(w.mean, 4) AS mean_least, count(CASE WHEN m.least < e.aff THEN 1 END) AS n_less, count(CASE WHEN m.least >= e.aff THEN 1 END) AS n_not_less
FROM e JOIN w USING (wild) JOIN m USING (wild) GROUP BY e.p_partkey, w.mean""")
def wildcard_stats(t: Tables) -> DataFrame:
    e = t.part.select(F.expr("cast(substr(p_brand, 7) AS int)").alias("wild"), "p_type", "p_partkey", F.col("p_retailprice").alias("aff"))
    least = e.groupBy("wild", "p_type").agg(F.min("aff").alias("least"))
    mean = least.groupBy("wild").agg(F.avg("least").alias("mean"), F.collect_list("least").alias("all"))  # one value a type
    n = F.size(F.filter("all", lambda x: x < F.col("aff")))
    return e.join(mean, "wild").select("p_partkey", F.round("mean", 4).alias("mean_least"), n.cast("long").alias("n_less"), (F.size("all") - n).cast("long").alias("n_not_less"))
