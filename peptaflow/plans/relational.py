"""Filters, projections, joins, set operations and plain aggregates on the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.missing import BIG_INT, is_na, na_to_null, to_number
from ..operators import joins
from .registry import Tables, query

LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def drop_present(df: DataFrame, names: list[str]) -> DataFrame:
    """Drops the columns that are there."""
    return df.drop(*names)


def column_last(df: DataFrame, name: str) -> DataFrame:
    """Moves a column to the end; unchanged if it is absent."""
    return df.select(*[c for c in df.columns if c != name], name) if name in df.columns else df


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM lineitem
WHERE (l_quantity <= 24 AND l_discount BETWEEN 0.02 AND 0.07) OR (l_returnflag = 'R' AND l_tax >= 0.06)""")
def filter_conj(t: Tables) -> DataFrame:
    keep = ((F.col("l_quantity") <= 24) & F.col("l_discount").between(0.02, 0.07)) | ((F.col("l_returnflag") == "R") & (F.col("l_tax") >= 0.06))
    return t.lineitem.filter(keep).select(*LINE, "l_quantity")


@query("""SELECT p_partkey, raw, CASE WHEN raw IN ('None','','NA','Na','N/A','none','.') THEN NULL ELSE CAST(raw AS DOUBLE) END AS num,
raw IN ('None','','NA','Na','N/A','none','.') AS missing FROM (SELECT p_partkey,
CASE p_size % 5 WHEN 0 THEN 'NA' WHEN 1 THEN '.' WHEN 2 THEN 'N/A' ELSE CAST(p_size AS VARCHAR) END AS raw FROM part)""")
def na_tokens_to_null(t: Tables) -> DataFrame:
    m = F.col("p_size") % 5
    raw = F.when(m == 0, "NA").when(m == 1, ".").when(m == 2, "N/A").otherwise(F.col("p_size").cast("string"))
    return t.part.select("p_partkey", raw.alias("raw")).select("p_partkey", "raw", to_number(F.col("raw")).alias("num"), is_na(F.col("raw")).alias("missing"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderdate, o_custkey FROM orders")
def project_drop_reorder(t: Tables) -> DataFrame:
    return t.orders.transform(drop_present, ["o_orderpriority", "not_there"]).transform(column_last, "o_custkey").transform(column_last, "absent")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce(p_size, 1073741824) AS aff
FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size <= 25) ON l_partkey = p_partkey""")
def lookup_default(t: Tables) -> DataFrame:
    sizes = t.part.filter("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"), F.col("p_size").alias("aff"))
    return joins.lookup(t.lineitem.select(*LINE), sizes, ["l_partkey"], {"aff": BIG_INT})


@query("SELECT d.doc_id, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id AND d.n_chars BETWEEN 500 AND 5000")
def guarded_left_join(t: Tables) -> DataFrame:
    return joins.lookup(t.documents.select("doc_id", "n_chars"), t.labels, ["doc_id"], {"quality": None, "toxic": None}, F.col("n_chars").between(500, 5000)).drop("n_chars")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45)")
def semi_keep(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem.filter("l_quantity > 45"), F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_normals(t: Tables) -> DataFrame:
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey", "o_custkey")


_LINE_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice"]


@query("""SELECT s_suppkey, s_name, l_orderkey, l_linenumber, l_partkey FROM supplier LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY l_suppkey
ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice) n FROM lineitem) ON l_suppkey = s_suppkey AND n = 1""")
def first_match_join(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumnRenamed("l_suppkey", "s_suppkey").select("s_suppkey", *_LINE_ORDER)
    return joins.first_match(t.supplier.select("s_suppkey", "s_name"), lines, ["s_suppkey"], _LINE_ORDER).select("s_suppkey", "s_name", "l_orderkey", "l_linenumber", "l_partkey")


@query("""SELECT n.n_nationkey, (a.n_regionkey + b.n_regionkey) / 2.0 AS mean_region FROM nation n
LEFT JOIN nation a ON a.n_nationkey = n.n_nationkey + 1 LEFT JOIN nation b ON b.n_nationkey = n.n_nationkey * 2""")
def double_lookup_mean(t: Tables) -> DataFrame:
    n = t.nation.select("n_nationkey", (F.col("n_nationkey") + 1).alias("k1"), (F.col("n_nationkey") * 2).alias("k2"))
    side = lambda k, v: t.nation.select(F.col("n_nationkey").alias(k), F.col("n_regionkey").alias(v))
    out = joins.lookup(joins.lookup(n, side("k1", "a"), ["k1"], {"a": None}), side("k2", "b"), ["k2"], {"b": None})
    return out.select("n_nationkey", ((F.col("a") + F.col("b")) / 2).alias("mean_region"))


@query("""SELECT n_name, greatest(CAST(sum(CASE WHEN o_orderstatus <> 'F' THEN cents ELSE 0 END) AS BIGINT), CAST(sum(CASE WHEN o_orderstatus <> 'O' THEN cents ELSE 0 END) AS BIGINT)) AS best
FROM (SELECT DISTINCT n_name, o_orderkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM nation JOIN supplier ON s_nationkey = n_nationkey
JOIN lineitem ON l_suppkey = s_suppkey JOIN orders ON o_orderkey = l_orderkey) GROUP BY n_name""")
def multi_hop_chain(t: Tables) -> DataFrame:
    path = t.nation.join(t.supplier, F.col("s_nationkey") == F.col("n_nationkey")).join(t.lineitem, F.col("l_suppkey") == F.col("s_suppkey")).join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    once = path.select("n_name", "o_orderkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents")).distinct()
    part = lambda s: F.sum(F.when(F.col("o_orderstatus") != s, F.col("cents")).otherwise(0))
    return once.groupBy("n_name").agg(F.greatest(part("F"), part("O")).alias("best"))


@query("SELECT r_name, n_name, c_mktsegment FROM region, nation, (SELECT DISTINCT c_mktsegment FROM customer)")
def cross_pairs(t: Tables) -> DataFrame:
    """Three small sides: every region with every nation and market segment."""
    return t.region.select("r_name").crossJoin(t.nation.select("n_name")).crossJoin(t.customer.select("c_mktsegment").distinct())


@query("""SELECT p_partkey, max(o_totalprice) AS best, count(o_totalprice) AS n FROM part
LEFT JOIN orders ON o_totalprice BETWEEN p_retailprice * 100 AND p_retailprice * 100 + 50 GROUP BY p_partkey""")
def interval_join_max(t: Tables) -> DataFrame:
    spans = t.part.select("p_partkey", (F.col("p_retailprice") * 100).alias("lo"), (F.col("p_retailprice") * 100 + 50).alias("hi"))
    met = joins.point_in_interval(t.orders.select("o_totalprice"), spans, "o_totalprice", "lo", "hi", 64.0, how="right")
    return met.groupBy("p_partkey").agg(F.max("o_totalprice").alias("best"), F.count("o_totalprice").alias("n"))


@query("""SELECT o_orderkey, p_partkey FROM orders JOIN part ON p_retailprice * 100 < o_totalprice AND o_totalprice + 10 < p_retailprice * 100 + 50""")
def interval_contain(t: Tables) -> DataFrame:
    outer = t.part.select("p_partkey", (F.col("p_retailprice") * 100).alias("lo"), (F.col("p_retailprice") * 100 + 50).alias("hi"))
    inner = t.orders.select("o_orderkey", F.col("o_totalprice").alias("a"), (F.col("o_totalprice") + 10).alias("b"))
    return joins.contained(inner, outer, "a", "b", "lo", "hi", 64.0).select("o_orderkey", "p_partkey")


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) n
FROM orders) ON o_custkey = c_custkey AND n = 1""")
def best_row_left_join(t: Tables) -> DataFrame:
    o = t.orders.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return joins.first_match(t.customer.select("c_custkey"), o, ["c_custkey"], [F.desc("o_totalprice"), "o_orderkey"])


@query("""SELECT l_suppkey, l_extendedprice AS price, l_orderkey, l_linenumber, l_partkey FROM lineitem
QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber, l_partkey) = 1""")
def argmin_struct(t: Tables) -> DataFrame:
    best = t.lineitem.groupBy("l_suppkey").agg(F.min(F.struct(F.col("l_extendedprice").alias("price"), "l_orderkey", "l_linenumber", "l_partkey")).alias("b"))
    return best.select("l_suppkey", "b.*")


@query("""SELECT l_partkey, count(*) AS n, min(l_extendedprice) AS least FROM lineitem GROUP BY l_partkey HAVING min(l_extendedprice) <= 2000
""")
def min_per_key_filter(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_partkey").agg(F.count(F.lit(1)).alias("n"), F.min("l_extendedprice").alias("least")).filter("least <= 2000")


@query("""SELECT l_suppkey, array_to_string(list_sort(list(DISTINCT l_returnflag || l_linestatus || CAST(l_linenumber AS VARCHAR))), ',') AS flags FROM lineitem GROUP BY l_suppkey""")
def collect_sorted_set(t: Tables) -> DataFrame:
    item = F.concat("l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"))
    return t.lineitem.groupBy("l_suppkey").agg(F.array_join(F.array_sort(F.collect_set(item)), ",").alias("flags"))


@query("SELECT p_brand, " + ", ".join(f"count(CASE WHEN p_size = {k} THEN 1 END) AS len_{k}" for k in range(6, 16)) + " FROM part GROUP BY p_brand")
def hist_pivot(t: Tables) -> DataFrame:
    wide = t.part.groupBy("p_brand").pivot("p_size", list(range(6, 16))).count().fillna(0)
    return wide.select("p_brand", *[F.col(str(k)).alias(f"len_{k}") for k in range(6, 16)])


@query("""SELECT o_orderpriority, """ + ", ".join(f"coalesce(CAST(sum(CASE WHEN o_orderstatus = '{s}' THEN 1 END) AS BIGINT), -1) AS n_{s}" for s in "FOPX") + " FROM orders GROUP BY o_orderpriority")
def label_matrix(t: Tables) -> DataFrame:
    wide = t.orders.withColumn("one", F.lit(1)).groupBy("o_orderpriority").pivot("o_orderstatus", list("FOPX")).agg(F.sum("one")).fillna(-1)
    return wide.select("o_orderpriority", *[F.col(s).alias(f"n_{s}") for s in "FOPX"])


@query("""SELECT source, count(CASE WHEN toxic IS NOT NULL THEN 1 END) AS tested, round(ln(greatest(1, count(CASE WHEN toxic IS NOT NULL THEN 1 END))), 6) AS ln_tested
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def n_tested_ln(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id", "source").join(t.labels, "doc_id", "left")
    n = F.count(F.when(F.col("toxic").isNotNull(), 1))
    return j.groupBy("source").agg(n.alias("tested"), F.round(F.log(F.greatest(F.lit(1), n)), 6).alias("ln_tested"))


@query("""SELECT o_orderkey AS k, 'F' AS src FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, 'hi' FROM orders WHERE o_totalprice > 300000
UNION ALL SELECT c_custkey, 'cust' FROM customer""")
def concat_sources(t: Tables) -> DataFrame:
    a = t.orders.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.lit("F").alias("src"))
    b = t.orders.filter("o_totalprice > 300000").select(F.lit("hi").alias("src"), F.col("o_orderkey").alias("k"))
    return a.unionByName(b).unionByName(t.customer.select(F.col("c_custkey").alias("k"), F.lit("cust").alias("src")))


@query("SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' UNION SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def distinct_union(t: Tables) -> DataFrame:
    return t.orders.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("k")).union(t.customer.filter("c_acctbal > 0").select("c_custkey")).distinct()


@query("SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 400000")
def difference(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey").subtract(t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey")))


@query("SELECT doc_id, lang, source FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1")
def dedup_first(t: Tables) -> DataFrame:
    least = t.documents.groupBy("text").agg(F.min(F.struct("doc_id", "lang", "source")).alias("b"))  # min of structs combines map-side
    return least.select("b.*")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(sum(CAST(floor(l_quantity) AS BIGINT)) OVER (PARTITION BY l_partkey) AS BIGINT) AS quant FROM lineitem""")
def quant_sum_broadcast(t: Tables) -> DataFrame:
    total = t.lineitem.groupBy("l_partkey").agg(F.sum(F.floor("l_quantity")).alias("quant"))
    return t.lineitem.select(*LINE).join(total, "l_partkey")


@query("""SELECT p_brand, CAST(sum(CASE WHEN p_size > 20 THEN 1 ELSE 0 END + CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM part GROUP BY p_brand""")
def failed_thresholds(t: Tables) -> DataFrame:
    return t.part.groupBy("p_brand").agg(F.sum((F.col("p_size") > 20).cast("int") + (F.col("p_retailprice") > 1000).cast("int")).alias("failed"))


@query("""SELECT p_partkey, p_name FROM part WHERE NOT (p_brand IS NOT DISTINCT FROM CASE WHEN p_size > 10 THEN 'Brand#1' END)""")
def null_safe_differs(t: Tables) -> DataFrame:
    other = F.when(F.col("p_size") > 10, "Brand#1")
    return t.part.filter(~F.col("p_brand").eqNullSafe(other)).select("p_partkey", "p_name")


@query("""SELECT doc_id, n_chars, CASE WHEN toxic = -1 THEN 0 ELSE toxic END AS label FROM (SELECT d.doc_id, d.n_chars, coalesce(l.toxic, -1) AS toxic FROM documents d LEFT JOIN labels l USING (doc_id))""")
def label_policy_zero(t: Tables) -> DataFrame:
    lab = F.coalesce("toxic", F.lit(-1))
    return t.documents.select("doc_id", "n_chars").join(t.labels, "doc_id", "left").select("doc_id", "n_chars", F.when(lab == -1, 0).otherwise(lab).alias("label"))


@query("""SELECT p_partkey, k, v FROM (SELECT p_partkey, p_name, p_brand, p_type FROM part) UNPIVOT (v FOR k IN (p_name, p_brand, p_type))""")
def unpivot_columns(t: Tables) -> DataFrame:
    return t.part.unpivot("p_partkey", ["p_name", "p_brand", "p_type"], "k", "v")


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def json_props(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""SELECT p_partkey, regexp_extract(p_brand, '^([A-Za-z]+)#(\\d+)$', 1) AS kind, CAST(regexp_extract(p_brand, '^([A-Za-z]+)#(\\d+)$', 2) AS INTEGER) AS num FROM part""")
def identity_parse(t: Tables) -> DataFrame:
    e = lambda g: F.regexp_extract("p_brand", r"^([A-Za-z]+)#(\d+)$", g)
    return t.part.select("p_partkey", e(1).alias("kind"), e(2).cast("int").alias("num"))


@query("""SELECT page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(string_split(html, '<p>')) - 1 AS INTEGER) AS paragraphs FROM pages""")
def html_fields(t: Tables) -> DataFrame:
    return t.pages.select("page_id", F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("lang"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), (F.size(F.split("html", "<p>")) - 1).alias("paragraphs"))


@query("""SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#=]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#=]*)', 1), '') AS ref FROM pages""")
def header_kv(t: Tables) -> DataFrame:
    from ..functions.sequences import header_value

    header = F.concat(F.lit("q "), F.translate(F.regexp_replace(F.regexp_extract("url", r"\?([^#]*)", 1), "&", " "), "#", " "))
    none = lambda k: na_to_null(header_value(header, k), ("",))
    return t.pages.select("page_id", none("page").alias("page"), none("ref").alias("ref"))
