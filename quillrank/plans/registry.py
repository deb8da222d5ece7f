"""Registered queries of the engine and the SQL that each must agree with. Sums of floats are rounded to six digits, since
engines add in different orders; rankings break ties by item id."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillrank.functions.text import STOPWORDS
from quillrank.operators import checks, evaluation, factorisation, neural_data, prep, ranking, recommenders, similarity, splits, statistics, weighting
from quillrank.plans import report
from quillrank.runtime import materialise, shared_dir, table
from quillrank.sources import readers, store, tables
from quillrank.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# --- SQL building blocks ----------------------------------------------------------------------------------------------

UO = "uo AS (SELECT o_custkey AS user_id, l_partkey AS item_id, sum(l_quantity) AS rating, max(l_shipdate) AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"
UE = "ue AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, CAST(count(*) AS DOUBLE) AS rating, max(ts) AS ts FROM events GROUP BY ALL)"
ICM = """icm AS (SELECT DISTINCT p_partkey AS item_id, unnest(list_concat(['brand_' || p_brand, 'type_' || p_type, 'size_' || CAST(p_size AS VARCHAR)], list_transform(string_split(p_name, ' '), lambda x: 'name_' || x))) AS feature, 1.0::DOUBLE AS value FROM part)"""
UCM = """ucm AS (SELECT c_custkey AS user_id, unnest(['nation_' || n_name, 'segment_' || c_mktsegment, 'region_' || r_name]) AS feature, 1.0::DOUBLE AS value FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
SPLIT = "sp AS (SELECT user_id, item_id, rating, ts, CASE r WHEN 1 THEN 'test' WHEN 2 THEN 'validation' ELSE 'train' END AS split FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM uo) WHERE n >= 3)"
TRAIN = "train AS (SELECT * FROM sp WHERE split = 'train'), test AS (SELECT user_id, item_id, 1.0::DOUBLE AS rating FROM sp WHERE split = 'test')"


def key_sql(seed: int = 0) -> str:
    return f"((user_id * 1000003 + item_id * 7919 + {seed * 611953}) % 104729)"


def user_key_sql(seed: int = 0) -> str:
    return f"((user_id * 15485863 + {seed * 611953} + 12345) % 104729)"


def query(sql: str | None = None):
    """Registers a query, with the SQL that it must agree with if there is one."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def six(df: DataFrame, *cols: str) -> DataFrame:
    for c in cols:
        df = df.withColumn(c, F.round(F.col(c), 6))
    return df


# --- matrices ---------------------------------------------------------------------------------------------------------


def _pairs(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return table(spark, sf_dir, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").alias("rating"), F.col("l_shipdate").alias("ts"))


@query("SELECT o_custkey AS user_id, l_partkey AS item_id, sum(l_quantity) AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL HAVING sum(l_quantity) <> 0")
def urm_build(spark, sf_dir):
    return prep.build(_pairs(spark, sf_dir))


@query("SELECT user_id, item_id, rating FROM (SELECT o_custkey AS user_id, l_partkey AS item_id, l_quantity AS rating, row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_shipdate DESC, l_quantity DESC) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey) WHERE r = 1")
def urm_dedup_last(spark, sf_dir):
    return readers.keep_last(_pairs(spark, sf_dir)).drop("ts")


@query(f"""WITH {UO}, u AS (SELECT count(*) AS k FROM uo GROUP BY user_id), i AS (SELECT count(*) AS k FROM uo GROUP BY item_id), nu AS (SELECT count(*) AS n FROM customer), ni AS (SELECT count(*) AS n FROM part)
SELECT (SELECT count(*) FROM uo) AS nnz, (SELECT count(*) FROM uo) / (nu.n * ni.n) AS density,
  (SELECT CASE WHEN count(*) < nu.n THEN 0 ELSE min(k) END FROM u) AS user_min, (SELECT sum(k) FROM u) / nu.n AS user_avg, (SELECT max(k) FROM u) AS user_max,
  (SELECT CASE WHEN count(*) < ni.n THEN 0 ELSE min(k) END FROM i) AS item_min, (SELECT sum(k) FROM i) / ni.n AS item_avg, (SELECT max(k) FROM i) AS item_max FROM nu, ni""")
def urm_stats(spark, sf_dir):
    return prep.statistics(tables.urm_orders(spark, sf_dir), table(spark, sf_dir, "customer").count(), table(spark, sf_dir, "part").count())


@query(f"""WITH {UO}, p AS (SELECT count(*) + 1e-7 AS x FROM uo GROUP BY user_id), r AS (SELECT x, row_number() OVER (ORDER BY x) AS i, count(*) OVER () AS n FROM p)
SELECT round(sum((2 * i - n - 1) * x) / (any_value(n) * sum(x)), 6) AS gini FROM r""")
def gini_user_profile(spark, sf_dir):
    return six(prep.gini(tables.urm_orders(spark, sf_dir).groupBy("user_id").count(), "count"), "gini")


@query("SELECT DISTINCT p_name AS original, dense_rank() OVER (ORDER BY p_name) - 1 AS idx FROM part")
def id_index(spark, sf_dir):
    return prep.dense_index(table(spark, sf_dir, "part"), "p_name")


@query("""WITH m AS (SELECT DISTINCT p_name AS original, dense_rank() OVER (ORDER BY p_name) - 1 AS idx FROM part), l AS (SELECT * FROM m WHERE idx % 3 <> 0)
SELECT original, row_number() OVER (ORDER BY idx) - 1 AS idx FROM l""")
def id_index_reconciled(spark, sf_dir):
    m = prep.dense_index(table(spark, sf_dir, "part"), "p_name")
    return prep.reconcile_index(m, m.filter("idx % 3 = 0").select(F.col("idx").alias("gone")), "gone")


@query("""WITH m AS (SELECT DISTINCT c_mktsegment AS original, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS idx FROM customer WHERE c_custkey < 5)
SELECT c_custkey AS user_id, idx AS segment FROM customer JOIN m ON c_mktsegment = original""")
def id_filter_ignore(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return prep.to_index(c, "segment", prep.dense_index(c.filter("user_id < 5"), "segment")).select("user_id", "segment")


@query("""WITH m AS (SELECT DISTINCT c_mktsegment AS original, dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS idx FROM customer WHERE c_custkey < 3),
a AS (SELECT * FROM m UNION ALL SELECT s, (SELECT max(idx) FROM m) + row_number() OVER (ORDER BY s) FROM (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment NOT IN (SELECT original FROM m)))
SELECT c_custkey AS user_id, CAST(idx AS BIGINT) AS segment FROM customer JOIN a ON c_mktsegment = original""")
def id_filter_add(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"))
    return prep.to_index(c, "segment", prep.dense_index(c.filter("user_id < 3"), "segment"), "add").select("user_id", "segment")


@query("SELECT idx, original FROM (SELECT DISTINCT p_name AS original, dense_rank() OVER (ORDER BY p_name) - 1 AS idx FROM part)")
def id_index_inverted(spark, sf_dir):
    return prep.invert_index(prep.dense_index(table(spark, sf_dir, "part"), "p_name"))


@query(f"""WITH {UO} SELECT 'user' AS kind, c_custkey AS id, c_custkey IN (SELECT user_id FROM uo) AS kept FROM customer UNION ALL SELECT 'item', p_partkey, p_partkey IN (SELECT item_id FROM uo) FROM part""")
def remove_empty(spark, sf_dir):
    u, i, nu, ni = prep.remove_empty(tables.urm_orders(spark, sf_dir), tables.users(spark, sf_dir), tables.items(spark, sf_dir))
    tag = lambda df, kind, kept: df.toDF("id").select(F.lit(kind).alias("kind"), "id", F.lit(kept).alias("kept"))
    return tag(u, "user", True).union(tag(i, "item", True)).union(tag(nu, "user", False)).union(tag(ni, "item", False))


@query(f"""WITH {UO}, a AS (SELECT * FROM uo WHERE user_id IN (SELECT user_id FROM uo GROUP BY 1 HAVING count(*) >= 40))
SELECT user_id, item_id, rating FROM a WHERE item_id IN (SELECT item_id FROM a GROUP BY 1 HAVING count(*) >= 15)""")
def degree_filter(spark, sf_dir):
    return prep.degree_filter(tables.urm_orders(spark, sf_dir), 40, 15).select("user_id", "item_id", "rating")


@query(f"WITH {ICM}, n AS (SELECT count(*) AS n FROM part), f AS (SELECT feature FROM icm, n GROUP BY feature, n.n HAVING count(*) >= 5 AND count(*) <= n.n * 0.30) SELECT item_id, feature, value FROM icm WHERE feature IN (SELECT feature FROM f)")
def feature_prune(spark, sf_dir):
    return prep.prune_features(tables.icm_part(spark, sf_dir), table(spark, sf_dir, "part").count()).select("item_id", "feature", "value")


@query(f"""WITH {UO}, {ICM}, gone AS (SELECT p_partkey AS item_id FROM part WHERE p_size < 10), kept AS (SELECT * FROM uo WHERE item_id NOT IN (SELECT item_id FROM gone))
SELECT (SELECT count(*) FROM kept) AS n_interactions, (SELECT count(*) FROM icm WHERE item_id NOT IN (SELECT item_id FROM gone)) AS n_features, (SELECT count(DISTINCT feature) FROM icm WHERE item_id NOT IN (SELECT item_id FROM gone)) AS n_distinct""")
def remove_items(spark, sf_dir):
    gone = table(spark, sf_dir, "part").filter("p_size < 10").select(F.col("p_partkey").alias("item_id"))
    u, f = prep.remove_ids(tables.urm_orders(spark, sf_dir), gone, "item_id"), prep.remove_ids(tables.icm_part(spark, sf_dir), gone, "item_id")
    return u.agg(F.count("*").alias("n_interactions")).join(f.agg(F.count("*").alias("n_features"), F.count_distinct("feature").alias("n_distinct")))


@query("""WITH b AS (SELECT p_partkey AS item_id, dense_rank() OVER (ORDER BY p_brand) - 1 AS feature_id FROM part), t AS (SELECT p_partkey AS item_id, dense_rank() OVER (ORDER BY p_type) - 1 AS feature_id FROM part)
SELECT item_id, feature_id, 1.0::DOUBLE AS value FROM b UNION ALL SELECT item_id, feature_id + (SELECT count(DISTINCT p_brand) FROM part), 1.0 FROM t""")
def icm_union_offset(spark, sf_dir):
    part = table(spark, sf_dir, "part")

    def icm(col):
        rows = part.select(F.col("p_partkey").alias("item_id"), F.col(col).alias("feature_id"))
        m = prep.dense_index(rows, "feature_id")
        return prep.to_index(rows, "feature_id", m).withColumn("value", F.lit(1.0)), m.count()

    (a, n), (b, _) = icm("p_brand"), icm("p_type")
    return prep.union_features(a, b, n)


@query(f"WITH {UO} SELECT user_id, item_id, 1.0::DOUBLE AS rating FROM uo WHERE rating >= 40")
def threshold_implicit(spark, sf_dir):
    return prep.implicit_from(tables.urm_orders(spark, sf_dir), 40).select("user_id", "item_id", "rating")


@query(f"WITH {UO}, n AS (SELECT count(*) AS n FROM part) SELECT least(item_id // greatest(1, n.n // 7), 6)::INT AS part, count(*) AS nnz, sum(rating) AS total FROM uo, n GROUP BY 1")
def column_parts(spark, sf_dir):
    n = table(spark, sf_dir, "part").count()
    return prep.column_parts(tables.urm_orders(spark, sf_dir), n, 7).groupBy("part").agg(F.count("*").alias("nnz"), F.sum("rating").alias("total"))


@query(f"WITH {UO} SELECT user_id, item_id FROM uo WHERE ts < TIMESTAMP '1995-01-01' AND rating <> 0")
def matrix_differences(spark, sf_dir):
    urm = tables.urm_orders(spark, sf_dir)
    return prep.differing(urm, urm.filter("ts >= timestamp '1995-01-01'")).select("user_id", "item_id")


@query(f"""WITH {UO}, p AS (SELECT p_partkey AS item_id, coalesce(sum(rating), 0) AS s FROM part LEFT JOIN uo ON item_id = p_partkey GROUP BY 1), t AS (SELECT item_id, row_number() OVER (ORDER BY s DESC, item_id) AS r, count(*) OVER () AS n FROM p)
SELECT user_id, item_id, rating FROM uo WHERE item_id NOT IN (SELECT item_id FROM t WHERE r <= CAST(floor(n * 0.2) AS BIGINT))""")
def remove_top_pop(spark, sf_dir):
    urm = tables.urm_orders(spark, sf_dir)
    return prep.remove_ids(urm, prep.top_popular(urm, tables.items(spark, sf_dir)), "item_id").select("user_id", "item_id", "rating")


@query(f"""WITH {UO}, n AS (SELECT (SELECT count(*) FROM customer) AS u, (SELECT count(*) FROM part) AS i, (SELECT count(*) FROM uo) AS k), s AS (SELECT list_filter([{", ".join(map(str, prep.CELL_STEPS))}], lambda p: (u * i) % p <> 0)[1] AS step FROM n),
c AS (SELECT t, (t * step + 42) % (u * i) AS cell, i FROM n, s, (SELECT unnest(range((SELECT least(u * i, k + 1000) FROM n))) AS t)), p AS (SELECT t, cell // i AS user_id, cell % i AS item_id FROM c)
SELECT user_id, item_id, 0.0::DOUBLE AS rating FROM (SELECT *, row_number() OVER (ORDER BY t) AS r FROM p WHERE NOT EXISTS (SELECT 1 FROM uo WHERE uo.user_id = p.user_id AND uo.item_id = p.item_id)) WHERE r <= 1000""")
def zero_samples(spark, sf_dir):
    return prep.zero_samples(tables.urm_orders(spark, sf_dir), table(spark, sf_dir, "customer").count(), table(spark, sf_dir, "part").count(), 1000)


@query(f"WITH {UO} SELECT item_id, user_id, rating FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rating DESC, user_id) AS r FROM uo WHERE rating <> 0) WHERE r <= 5")
def topk_column(spark, sf_dir):
    return prep.top_k(tables.urm_orders(spark, sf_dir), 5, "item_id", "rating", "user_id").select("item_id", "user_id", "rating")


@query(r"""WITH t AS (SELECT doc_id AS item_id, unnest(string_split(regexp_replace(regexp_replace(coalesce(text, ''), '[^a-zA-Z0-9]', ' ', 'g'), ' +', ' ', 'g'), ' ')) AS feature FROM documents)
SELECT item_id, feature, count(*)::DOUBLE AS value FROM t WHERE feature NOT IN (""" + ", ".join(f"'{w}'" for w in STOPWORDS) + ") GROUP BY ALL")
def tag_tokens(spark, sf_dir):
    return prep.tokens_of(table(spark, sf_dir, "documents"), "doc_id", F.coalesce("text", F.lit("")), distinct=False)


@query(f"WITH {UCM} SELECT feature, count(*) AS n FROM ucm GROUP BY feature")
def ucm_one_hot(spark, sf_dir):
    return tables.ucm_customer(spark, sf_dir).groupBy("feature").agg(F.count("*").alias("n"))


# --- readers: a table is written as lines and read back ----------------------------------------------------------------


def _lines(spark, df: DataFrame, **how) -> str:
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    df.write.options(**how).text(path)
    return path


@query("SELECT o_custkey::VARCHAR AS user_id, l_partkey::VARCHAR AS item_id, sum(l_quantity) AS rating FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity <> 0 GROUP BY ALL")
def read_delimited(spark, sf_dir):
    path = _lines(spark, _pairs(spark, sf_dir).select(F.concat_ws("::", "user_id", "item_id", "rating", F.unix_timestamp("ts"))))
    return readers.read_interactions(spark, readers.spec("movielens_1m", path, repeats="sum")).select("user_id", "item_id", "rating")


@query(f"WITH {UE} SELECT user_id::VARCHAR AS user_id, item_id::VARCHAR AS item_id, rating FROM ue WHERE item_id IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def read_known_items_gzip(spark, sf_dir):
    path = _lines(spark, tables.urm_events(spark, sf_dir).select(F.concat_ws("\t", "user_id", "item_id", "rating")), compression="gzip")
    known = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_partkey").cast("string").alias("item_id"))
    logs = readers.read_interactions(spark, readers.ReaderSpec(path, ("user_id", "item_id", "rating"), "\t"))
    return readers.read_known_items(logs, known).select("user_id", "item_id", "rating")


@query("SELECT DISTINCT p_partkey AS item_id, unnest(string_split(p_name, ' ')) AS feature, 1.0::DOUBLE AS value FROM part")
def read_genres(spark, sf_dir):
    return readers.token_features(table(spark, sf_dir, "part"), "p_partkey", "p_name", " ")


@query("SELECT p_partkey::VARCHAR AS item_id, concat_ws(' ', p_name, p_brand, p_type || ' ' || p_size, '') AS text FROM part")
def read_json_metadata(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    own = F.struct(F.col("p_partkey").cast("string").alias("asin"), F.col("p_name").alias("title"), F.col("p_brand").alias("brand"), F.array(F.array("p_type", F.col("p_size").cast("string"))).alias("categories"))
    return readers.read_json_metadata(spark, _lines(spark, part.select(F.to_json(own))))


@query("SELECT source AS user_id, doc_id::VARCHAR AS item_id, n_chars::DOUBLE AS rating, coalesce(text, '') || ' ' || coalesce(lang, '') AS text FROM documents")
def read_json_reviews(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    own = F.struct(F.col("source").alias("reviewerID"), F.col("doc_id").cast("string").alias("asin"), F.col("n_chars").cast("double").alias("overall"), F.col("text").alias("reviewText"), F.col("lang").alias("summary"))
    return readers.read_json_reviews(spark, _lines(spark, d.select(F.to_json(own)))).drop("ts")


@query(f"WITH {UO} SELECT user_id::VARCHAR AS user_id, item_id::VARCHAR AS item_id, 1.0::DOUBLE AS rating FROM uo WHERE rating >= 25")
def read_labelled_pairs(spark, sf_dir):
    label = F.when(F.col("rating") >= 25, "1").otherwise("-1")
    return readers.read_labelled_pairs(spark, _lines(spark, tables.urm_orders(spark, sf_dir).select(F.concat(label, F.lit(" "), "user_id", F.lit(":1 "), "item_id", F.lit(":1 9:0.5")))))


@query(f"WITH {UO} SELECT user_id::VARCHAR AS user_id, item_id::VARCHAR AS item_id, rating, epoch(date_trunc('day', ts))::DOUBLE AS ts FROM uo")
def read_blocks(spark, sf_dir):
    line = F.concat_ws(",", "user_id", "rating", F.date_format("ts", "yyyy-MM-dd"))
    blocks = tables.urm_orders(spark, sf_dir).groupBy("item_id").agg(F.concat_ws("\n", F.collect_list(line)).alias("lines"))
    return readers.read_blocks(spark, _lines(spark, blocks.select(F.concat("item_id", F.lit(":\n"), "lines"))))


# --- splits -----------------------------------------------------------------------------------------------------------


@query(f"WITH {UO}, {SPLIT} SELECT user_id, item_id, split FROM sp")
def split_timestamp(spark, sf_dir):
    return splits.timestamp(tables.urm_orders(spark, sf_dir)).select("user_id", "item_id", "split")


@query(f"""WITH {UO}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {key_sql()}, item_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM uo)
SELECT user_id, item_id, CASE WHEN r <= 2 THEN 'test' WHEN r <= 4 THEN 'validation' ELSE 'train' END AS split FROM r WHERE n >= 5""")
def split_leave_k_hash(spark, sf_dir):
    return splits.leave_k_out_checked(tables.urm_orders(spark, sf_dir), 2).select("user_id", "item_id", "split")


@query(f"""WITH {UO}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS r FROM uo)
SELECT user_id, item_id, CASE WHEN r <= 1 THEN 'test' WHEN r <= 2 THEN 'validation' ELSE 'train' END AS split FROM r""")
def split_leave_last(spark, sf_dir):
    return splits.leave_k_out(tables.urm_orders(spark, sf_dir), 1, by="rating").select("user_id", "item_id", "split")


@query(f"""WITH {UO}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {key_sql()}, item_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM uo),
c AS (SELECT *, CASE WHEN round_even(n * 0.8, 0) = n AND n > 1 THEN n - 1 ELSE round_even(n * 0.8, 0) END AS cut FROM r) SELECT user_id, item_id, CASE WHEN r <= cut THEN 'train' ELSE 'test' END AS split FROM c""")
def split_pct_user(spark, sf_dir):
    return splits.user_percentage(tables.urm_orders(spark, sf_dir), 0.8).select("user_id", "item_id", "split")


@query(f"""WITH {UO}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {key_sql()}, item_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM uo)
SELECT user_id, item_id, CASE WHEN r = 1 AND n > 30 THEN 'test' ELSE 'train' END AS split FROM r""")
def split_leave_one_if(spark, sf_dir):
    return splits.leave_one_out_if(tables.urm_orders(spark, sf_dir), 30).select("user_id", "item_id", "split")


@query(f"WITH {UO} SELECT user_id, item_id, CASE WHEN {key_sql()} < 0.8 * 104729 THEN 'train' ELSE 'test' END AS split FROM uo")
def split_holdout(spark, sf_dir):
    return splits.holdout(tables.urm_orders(spark, sf_dir), 0.8).select("user_id", "item_id", "split")


@query(f"""WITH {UO}, s AS (SELECT user_id, count(*) AS n FROM uo GROUP BY 1), w AS (SELECT user_id, row_number() OVER (ORDER BY {user_key_sql()}, user_id) AS pos, count(*) OVER () AS m FROM s WHERE n > 10),
h AS (SELECT user_id FROM w WHERE pos > round_even(m * 0.7, 0)), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {key_sql()}, item_id) AS r FROM uo)
SELECT user_id, item_id, CASE WHEN r > 10 AND user_id IN (SELECT user_id FROM h) THEN 'test' ELSE 'train' END AS split FROM r""")
def split_cold_start(spark, sf_dir):
    return splits.cold_start(tables.urm_orders(spark, sf_dir), 10, 0.7).select("user_id", "item_id", "split")


@query(f"""WITH {UO}, l AS (SELECT * FROM uo WHERE user_id IN (SELECT user_id FROM uo GROUP BY 1 HAVING count(*) >= 5)), s AS (SELECT *, CASE WHEN {user_key_sql()} / 104729.0 < 0.1 THEN 'test' WHEN {user_key_sql()} / 104729.0 < 0.2 THEN 'validation' ELSE 'train' END AS split FROM l),
t AS (SELECT * FROM s WHERE split = 'train'), h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {key_sql()}, item_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM s WHERE split <> 'train' AND item_id IN (SELECT item_id FROM t))
SELECT user_id, item_id, split, NULL AS part FROM t UNION ALL SELECT user_id, item_id, split, CASE WHEN r <= floor(n * 0.2) THEN 'hidden' ELSE 'fold_in' END FROM h""")
def split_user_disjoint(spark, sf_dir):
    return splits.user_disjoint(tables.urm_orders(spark, sf_dir), 5, 0.1).select("user_id", "item_id", "split", "part")


@query(" UNION ALL ".join(f"""SELECT user_id, item_id, CASE WHEN r <= (CASE WHEN round_even(n * 0.8, 0) = n AND n > 1 THEN n - 1 ELSE round_even(n * 0.8, 0) END) THEN 'train' ELSE 'test' END AS split, {f} AS fold FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {key_sql(f + 1)}, item_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM (SELECT o_custkey AS user_id, l_partkey AS item_id FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL))""" for f in range(3)))
def split_repeats(spark, sf_dir):
    return splits.repeats(tables.urm_orders(spark, sf_dir), 3).select("user_id", "item_id", "split", "fold")




def walk_sql(name: str, users: str, seen: str, n: int | str, seed: int = 0) -> str:
    """CTE name (user_id, item_id, rank): the first n items outside seen of each user's walk over the catalogue."""
    steps = ", ".join(map(str, splits.STEPS))
    return f"""{name} AS (WITH z AS (SELECT n, list_filter([{steps}], lambda p: n % p <> 0) AS steps FROM (SELECT count(*) AS n FROM part)), own AS ({users}), most AS (SELECT max(k) AS k FROM (SELECT count(*) AS k FROM {seen} GROUP BY user_id)),
v AS (SELECT user_id, j AS pos, (user_id * 7919 + {seed * 31} + j * steps[1 + user_id % len(steps)]) % n AS item_id FROM own, z, (SELECT unnest(range((SELECT least(n, k + ({n})) FROM z, most))) AS j)),
f AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS rank FROM v WHERE NOT EXISTS (SELECT 1 FROM {seen} s WHERE s.user_id = v.user_id AND s.item_id = v.item_id)) SELECT user_id, item_id, rank FROM f WHERE rank <= ({n}))"""


NEGATIVES = walk_sql("neg", "SELECT c_custkey AS user_id FROM customer", "uo", 100)


@query(f"WITH {UO}, {NEGATIVES} SELECT user_id, item_id FROM neg")
def negatives_hash(spark, sf_dir):
    return splits.negatives(tables.urm_orders(spark, sf_dir), tables.users(spark, sf_dir), table(spark, sf_dir, "part").count(), 100)


@query(f"""WITH {UO}, a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY {key_sql()}, item_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM uo),
b AS (SELECT *, r <= (CASE WHEN round_even(n * 0.8, 0) = n AND n > 1 THEN n - 1 ELSE round_even(n * 0.8, 0) END) AS tr FROM a),
c AS (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY {key_sql(1)}, item_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM b WHERE tr)
SELECT user_id, item_id, CASE WHEN r <= (CASE WHEN round_even(n * 0.9, 0) = n AND n > 1 THEN n - 1 ELSE round_even(n * 0.9, 0) END) THEN 'train' ELSE 'validation' END AS split FROM c UNION ALL SELECT user_id, item_id, 'test' FROM b WHERE NOT tr""")
def split_two_level(spark, sf_dir):
    return splits.two_level(tables.urm_orders(spark, sf_dir)).select("user_id", "item_id", "split")


@query(f"""WITH {UO}, {SPLIT}, {TRAIN}, {walk_sql("f", "SELECT DISTINCT user_id FROM test", "train", 50)} SELECT user_id, item_id FROM f WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.user_id = f.user_id AND sp.item_id = f.item_id AND split <> 'train')""")
def negatives_without_overlap(spark, sf_dir):
    train, _, users, _, n_items = _setting(spark, sf_dir)
    held = splits.timestamp(tables.urm_orders(spark, sf_dir)).filter("split <> 'train'")
    return splits.drop_overlap(splits.negatives(train, users, n_items, 50), held)


@query(f"WITH {UO}, {SPLIT}, {TRAIN} SELECT user_id, item_id FROM test WHERE item_id IN (SELECT item_id FROM train)")
def warm_test_items(spark, sf_dir):
    train, test, _, _, _ = _setting(spark, sf_dir)
    return checks.without_cold_test_items(test, train).select("user_id", "item_id")


@query(f"WITH {UO}, {SPLIT} SELECT split AS part, count(*) AS n, min(rating) = 1 AND max(rating) = 1 AS implicit, count(*) FILTER (NOT isfinite(rating) OR rating IS NULL) AS not_finite FROM sp GROUP BY 1")
def split_checks(spark, sf_dir):
    return checks.parts(splits.timestamp(tables.urm_orders(spark, sf_dir)), ["train", "validation", "test"])


@query(f"""WITH {UO}, {walk_sql("f", "SELECT DISTINCT user_id FROM uo", "uo", "SELECT max(k) FROM (SELECT count(*) AS k FROM uo GROUP BY user_id)")}, p AS (SELECT user_id, item_id AS positive, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM uo),
g AS (SELECT f.user_id, f.item_id AS negative, row_number() OVER (PARTITION BY f.user_id ORDER BY f.item_id) AS r FROM f JOIN (SELECT user_id, count(*) AS n FROM uo GROUP BY 1) c ON c.user_id = f.user_id AND rank <= n) SELECT user_id, positive, negative FROM p JOIN g USING (user_id, r)""")
def pairwise_samples(spark, sf_dir):
    return neural_data.pairwise_samples(tables.urm_orders(spark, sf_dir), table(spark, sf_dir, "part").count())


@query(f"""WITH {UO}, {SPLIT}, want AS (SELECT user_id, 5 * count(*) AS w FROM sp WHERE split = 'test' GROUP BY 1), {walk_sql("f", "SELECT user_id FROM want", "sp", "SELECT max(w) FROM want")}
SELECT user_id, item_id FROM f JOIN want USING (user_id) WHERE rank <= w""")
def negatives_per_positive(spark, sf_dir):
    return splits.with_negatives(splits.timestamp(tables.urm_orders(spark, sf_dir)), table(spark, sf_dir, "part").count(), 5)


@query(f"WITH {UO}, {SPLIT} SELECT user_id, item_id, count(*) AS n_parts FROM (SELECT user_id, item_id FROM sp WHERE split = 'train' UNION ALL SELECT user_id, item_id FROM sp WHERE split = 'test') GROUP BY ALL HAVING count(*) > 1")
def disjoint_check(spark, sf_dir):
    s = splits.timestamp(tables.urm_orders(spark, sf_dir))
    return checks.overlaps({k: s.filter(F.col("split") == k) for k in ("train", "test")})


@query(f"""WITH {UO}, {UE} SELECT (SELECT min(rating) = 1 AND max(rating) = 1 FROM uo) AS orders_implicit, (SELECT count(*) FROM part WHERE p_partkey NOT IN (SELECT item_id FROM uo)) AS cold_items, (SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT user_id FROM uo)) AS cold_users, (SELECT count(*) FROM (SELECT DISTINCT user_id FROM ue) WHERE user_id NOT IN (SELECT c_custkey FROM customer)) AS unknown_users, 0::BIGINT AS not_finite""")
def consistency_checks(spark, sf_dir):
    u, e = tables.urm_orders(spark, sf_dir), tables.urm_events(spark, sf_dir)
    users, items = tables.users(spark, sf_dir), tables.items(spark, sf_dir)
    n = lambda df, name: df.agg(F.count("*").alias(name))
    return checks.implicit(u).withColumnRenamed("implicit", "orders_implicit").join(n(checks.cold(items, u, "item_id"), "cold_items")).join(n(checks.cold(users, u, "user_id"), "cold_users")).join(n(checks.unknown_ids(e, users, "user_id"), "unknown_users")).join(n(checks.not_finite(u, "rating", True), "not_finite"))


@query(f"""WITH {UO}, {SPLIT}, {TRAIN}, {NEGATIVES}, t AS (SELECT user_id, count(*) AS t FROM test GROUP BY 1), n AS (SELECT user_id, count(*) AS n FROM neg GROUP BY 1)
SELECT count(t) AS test_users, count(n) AS negative_users, sum((n IS NULL)::BIGINT)::BIGINT AS test_only, sum((t IS NULL)::BIGINT)::BIGINT AS negative_only, min(n) AS least, max(n) AS most, (SELECT count(*) FROM test JOIN neg USING (user_id, item_id)) AS both FROM t FULL JOIN n USING (user_id)""".replace(" AS both ", ' AS "both" '))
def negative_statistics(spark, sf_dir):
    u = tables.urm_orders(spark, sf_dir)
    return checks.negative_statistics(splits.timestamp(u).filter("split = 'test'"), splits.negatives(u, tables.users(spark, sf_dir), table(spark, sf_dir, "part").count(), 100))


# --- weighting and similarity -----------------------------------------------------------------------------------------


@query(f"""WITH {UO}, n AS (SELECT count(*) AS n FROM part), l AS (SELECT item_id, sum(rating) AS len FROM uo GROUP BY 1), a AS (SELECT sum(rating) / any_value(n.n) AS avg FROM uo, n), f AS (SELECT user_id, ln(any_value(n.n) / (1.0 + count(*))) AS idf FROM uo, n GROUP BY 1)
SELECT item_id, user_id, round(rating * 2.2 / (1.2 * (0.25 + 0.75 * len / avg) + rating) * idf, 6) AS rating FROM uo JOIN l USING (item_id) JOIN f USING (user_id), a""")
def bm25_item(spark, sf_dir):
    return six(weighting.bm25(tables.urm_orders(spark, sf_dir), table(spark, sf_dir, "part").count(), "item_id", "user_id", "rating"), "rating")


@query(f"""WITH {UO}, n AS (SELECT count(*) AS n FROM part), f AS (SELECT user_id, ln(any_value(n.n) / (1.0 + count(*))) AS idf FROM uo, n GROUP BY 1)
SELECT item_id, user_id, round(sqrt(rating) * idf, 6) AS rating FROM uo JOIN f USING (user_id)""")
def tfidf_item(spark, sf_dir):
    return six(weighting.tf_idf(tables.urm_orders(spark, sf_dir), table(spark, sf_dir, "part").count(), "item_id", "user_id", "rating"), "rating")


@query(f"WITH {UO} SELECT user_id, item_id, round(rating / sum(rating) OVER (PARTITION BY user_id), 6) AS l1, round(rating / sqrt(sum(rating * rating) OVER (PARTITION BY item_id)), 6) AS l2 FROM uo")
def normalise_rows_columns(spark, sf_dir):
    u = tables.urm_orders(spark, sf_dir).select("user_id", "item_id", "rating")
    a = weighting.normalised(u, "user_id", "rating", "l1").withColumnRenamed("rating", "l1")
    b = weighting.normalised(u, "item_id", "rating", "l2").withColumnRenamed("rating", "l2")
    return six(a.join(b, ["user_id", "item_id"]), "l1", "l2")


def sim_sql(source: str, weight: str, k: int, centre: str = "", binary: bool = False, n_cols: str = "", weights: bool = False) -> str:
    """Pairs of source's items; weight over dot, qd (of dst) and qs (of src)."""
    value = "1.0::DOUBLE" if binary else f"CASE WHEN abs(rating - avg(rating) OVER (PARTITION BY {centre})) < 1e-9 THEN 0 ELSE rating - avg(rating) OVER (PARTITION BY {centre}) END" if centre else "rating"
    dot = "sum(a.v * b.v * (1 + a.user_id % 3))" if weights else "sum(a.v * b.v)"
    order = "weight" if binary else "round(weight, 9)"  # quotients of whole numbers are the same everywhere
    rank = f"CASE WHEN weight > 0 THEN r ELSE r + {n_cols} - h END" if n_cols else "r"
    return f"""WITH {UO}, {UE}, m AS (SELECT user_id, item_id, {value} AS v FROM {source}), q AS (SELECT item_id, sum(v * v) AS q FROM m GROUP BY 1),
d AS (SELECT a.item_id AS src, b.item_id AS dst, {dot} AS dot FROM m a JOIN m b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY ALL),
w AS (SELECT src, dst, {weight} AS weight FROM d JOIN (SELECT item_id AS src, q AS qs FROM q) USING (src) JOIN (SELECT item_id AS dst, q AS qd FROM q) USING (dst)),
t AS (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY {order} DESC, src) AS r, count(*) OVER (PARTITION BY dst) AS h FROM w WHERE abs(weight) > 1e-12)
SELECT src, dst, round(weight, 6) AS weight FROM t WHERE {rank} <= {k}"""


def _items_matrix(urm):
    return urm.select(F.col("user_id").alias("row"), F.col("item_id").alias("col"), F.col("rating").alias("value"))


def _sim(kind, k=20, source="orders", **how):
    def run(spark, sf_dir):
        urm = (tables.urm_orders if source == "orders" else tables.urm_events)(spark, sf_dir)
        return six(similarity.similarity(_items_matrix(urm), kind, k, **how), "weight")

    return run


SIMS = {
    "sim_cosine": (dict(kind="cosine", shrink=10), sim_sql("uo", "dot / (sqrt(qs) * sqrt(qd) + 10 + 1e-6)", 20)),
    "sim_dot": (dict(kind="cosine", normalise=False), sim_sql("uo", "dot", 20)),
    "sim_asymmetric": (dict(kind="asymmetric", alpha=0.3), sim_sql("uo", "dot / (pow(qd, 0.3) * pow(qs, 0.7) + 1e-6)", 20)),
    "sim_jaccard": (dict(kind="jaccard"), sim_sql("uo", "dot / (qs + qd - dot + 1e-6)", 20, binary=True)),
    "sim_dice": (dict(kind="dice", shrink=5), sim_sql("uo", "dot / (qs + qd + 5 + 1e-6)", 20, binary=True)),
    "sim_tversky": (dict(kind="tversky", alpha=0.5, beta=1.5), sim_sql("uo", "dot / (dot + (qd - dot) * 0.5 + (qs - dot) * 1.5 + 1e-6)", 20, binary=True)),
    "sim_adjusted": (dict(kind="adjusted", source="events", k=1000), sim_sql("ue", "dot / (sqrt(qs) * sqrt(qd) + 1e-6)", 1000, centre="user_id")),
    "sim_pearson": (dict(kind="pearson", source="events", k=1000), sim_sql("ue", "dot / (sqrt(qs) * sqrt(qd) + 1e-6)", 1000, centre="item_id")),
    "sim_column_range": (dict(kind="cosine", start_col=10, end_col=60), sim_sql("uo", "dot / (sqrt(qs) * sqrt(qd) + 1e-6)", 20) + " AND dst >= 10 AND dst < 60"),
}
for _name, (_how, _sql) in SIMS.items():
    QUERIES[_name], ORACLE_SQL[_name] = _sim(**_how), _sql


@query(sim_sql("uo", "dot / (sqrt(qs) * sqrt(qd) + 1e-6)", 20, weights=True))
def sim_row_weighted(spark, sf_dir):
    urm = tables.urm_orders(spark, sf_dir)
    w = urm.select(F.col("user_id").alias("row")).distinct().withColumn("weight", (1 + F.col("row") % 3).cast("double"))
    return six(similarity.similarity(_items_matrix(urm), "cosine", 20, row_weights=w), "weight")


def euclid_sql(weight: str, d2: str = "greatest(x.q + y.q - 2 * coalesce(dot, 0), 0)") -> str:
    return f"""WITH {UE}, q AS (SELECT item_id, sum(rating * rating) AS q FROM ue GROUP BY 1), d AS (SELECT a.item_id AS src, b.item_id AS dst, sum(a.rating * b.rating) AS dot FROM ue a JOIN ue b ON a.user_id = b.user_id GROUP BY ALL),
p AS (SELECT x.item_id AS src, y.item_id AS dst, sqrt({d2}) AS d FROM q x JOIN q y ON x.item_id <> y.item_id LEFT JOIN d ON src = x.item_id AND dst = y.item_id), w AS (SELECT src, dst, {weight} AS weight FROM p)
SELECT src, dst, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) AS r FROM w) WHERE r <= 10"""


def _euclid(spark, sf_dir, **how):
    m = _items_matrix(tables.urm_events(spark, sf_dir))
    return six(similarity.euclidean(m, m.select("col").distinct(), 10, **how), "weight")


@query(euclid_sql("1 / (d + 1e-9)"))
def sim_euclid_lin(spark, sf_dir):
    return _euclid(spark, sf_dir)


@query(euclid_sql("1 / (ln(d + 1) + 2 + 1e-9)"))
def sim_euclid_log(spark, sf_dir):
    return _euclid(spark, sf_dir, mode="log", shrink=2.0)


@query(euclid_sql("1 / (exp(d) + 1e-9)", "greatest(x.q + y.q - 2 * coalesce(dot, 0), 0) / (sqrt(x.q) * sqrt(y.q))"))
def sim_euclid_exp_normalised(spark, sf_dir):
    return _euclid(spark, sf_dir, mode="exp", normalise=True)


# --- recommenders -----------------------------------------------------------------------------------------------------


def _setting(spark, sf_dir):
    s = materialise(splits.timestamp(tables.urm_orders(spark, sf_dir, "user_id")), "split")  # read by several branches of a plan
    train = s.filter("split = 'train'").select("user_id", "item_id", "rating")
    test = s.filter("split = 'test'").select("user_id", "item_id", F.lit(1.0).alias("rating"))
    return train, test, evaluation.eligible(test), tables.items(spark, sf_dir), table(spark, sf_dir, "part").count()


def _by_items(setting, profile, w, n=10):
    train, _, users, _, n_items = setting
    return six(ranking.top_n_weighted(profile, w, users, n_items, n, train), "score")


def _by_users(setting, ratings, w, n=10):
    return _by_items(setting, ranking.neighbour_profiles(w), ranking.rating_weights(ratings), n)


def recs_sql(model: str, scores: str = "SELECT user_id, dst AS item_id, sum(rating * weight) AS score FROM train JOIN w ON src = item_id GROUP BY ALL", n: int = 10) -> str:
    """The whole grid of users and items, without what train has. model: CTEs that define w (or what scores reads)."""
    return f"""WITH {UO}, {SPLIT}, {TRAIN}, {UCM}, {ICM}, {model}, sc AS ({scores}),
g AS (SELECT u.user_id, p_partkey AS item_id, round(coalesce(score, 0), 9) AS score FROM (SELECT DISTINCT user_id FROM test) u CROSS JOIN part LEFT JOIN sc ON sc.user_id = u.user_id AND sc.item_id = p_partkey),
k AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank FROM g WHERE NOT EXISTS (SELECT 1 FROM train WHERE train.user_id = g.user_id AND train.item_id = g.item_id))
SELECT user_id, rank::INT AS rank, item_id, round(score, 6) AS score FROM k WHERE rank <= {n}"""


def cosine_sql(m: str, shrink: float, k: int, row: str = "user_id", col: str = "item_id", value: str = "rating") -> str:
    return f"""q AS (SELECT {col} AS c, sum({value} * {value}) AS q FROM {m} GROUP BY 1), d AS (SELECT a.{col} AS src, b.{col} AS dst, sum(a.{value} * b.{value}) AS dot FROM {m} a JOIN {m} b ON a.{row} = b.{row} AND a.{col} <> b.{col} GROUP BY ALL),
w0 AS (SELECT src, dst, dot / (sqrt(x.q) * sqrt(y.q) + {shrink} + 1e-6) AS weight FROM d JOIN q x ON x.c = src JOIN q y ON y.c = dst), w AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) AS r FROM w0 WHERE weight <> 0) WHERE r <= {k})"""


@query(recs_sql("p AS (SELECT item_id, count(*)::DOUBLE AS s FROM train GROUP BY 1)", "SELECT u.user_id, p.item_id, s AS score FROM (SELECT DISTINCT user_id FROM test) u CROSS JOIN p"))
def rec_toppop(spark, sf_dir):
    train, _, users, items, _ = _setting(spark, sf_dir)
    return ranking.top_n_global(recommenders.top_pop(train, items), train, users, 10)


@query(recs_sql("p AS (SELECT item_id, count(*)::DOUBLE AS s FROM train GROUP BY 1)", "SELECT u.user_id, p.item_id, s AS score FROM (SELECT DISTINCT user_id FROM test) u CROSS JOIN p").replace("CROSS JOIN part LEFT", "CROSS JOIN (SELECT * FROM part WHERE p_size >= 10) part LEFT"))
def rec_toppop_ignoring(spark, sf_dir):
    train, _, users, items, _ = _setting(spark, sf_dir)
    small = table(spark, sf_dir, "part").filter("p_size < 10").select(F.col("p_partkey").alias("item_id"))
    return ranking.top_n_global(recommenders.top_pop(train, items).join(small, "item_id", "left_anti"), train, users, 10)


@query(f"""WITH {UO}, mu AS (SELECT avg(rating) AS mu FROM uo), i AS (SELECT item_id, sum(rating - mu) / (count(*) + 25) AS score FROM uo, mu GROUP BY 1), u AS (SELECT user_id, sum(rating - mu - score) / (count(*) + 10) AS bias FROM uo JOIN i USING (item_id), mu GROUP BY 1)
SELECT 'item' AS kind, item_id AS id, round(score, 6) AS bias FROM i UNION ALL SELECT 'user', user_id, round(bias, 6) FROM u""")
def rec_global_effects(spark, sf_dir):
    _, item, user = recommenders.global_effects(tables.urm_orders(spark, sf_dir))
    return six(item.select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.col("score").alias("bias")).union(user.select(F.lit("user"), "user_id", "bias")), "bias")


@query(f"""WITH {UO}, {SPLIT}, {TRAIN}, {walk_sql("f", "SELECT DISTINCT user_id FROM test", "train", 10, 42)} SELECT user_id, rank::INT AS rank, item_id FROM f""")
def rec_random(spark, sf_dir):
    train, _, users, _, n_items = _setting(spark, sf_dir)
    return recommenders.random_lists(train, users, n_items, 10)


@query(recs_sql(cosine_sql("train", 100, 50)))
def rec_itemknn_cf(spark, sf_dir):
    setting = train, _, _, _, n_items = _setting(spark, sf_dir)
    w, p = recommenders.item_knn_cf(train, n_items)
    return _by_items(setting, p, w)


@query(recs_sql(f"""n AS (SELECT count(*) AS n FROM part), f AS (SELECT user_id, ln(any_value(n.n) / (1.0 + count(*))) AS idf FROM train, n GROUP BY 1), tw AS (SELECT user_id, item_id, sqrt(rating) * idf AS rating FROM train JOIN f USING (user_id)), {cosine_sql("tw", 10, 30)}""", "SELECT user_id, dst AS item_id, sum(rating * weight) AS score FROM tw JOIN w ON src = item_id GROUP BY ALL"))
def rec_itemknn_cf_tfidf(spark, sf_dir):
    setting = train, _, _, _, n_items = _setting(spark, sf_dir)
    w, p = recommenders.item_knn_cf(train, n_items, k=30, shrink=10, feature_weighting="TF-IDF")
    return _by_items(setting, p, w)


@query(recs_sql(cosine_sql("train", 100, 50, row="item_id", col="user_id"), "SELECT src AS user_id, item_id, sum(rating * weight) AS score FROM w JOIN train ON dst = train.user_id GROUP BY ALL"))
def rec_userknn_cf(spark, sf_dir):
    setting = train, _, _, _, _ = _setting(spark, sf_dir)
    w, p = recommenders.user_knn_cf(train, table(spark, sf_dir, "customer").count())
    return _by_users(setting, p, w)


def _cbf_sql(name: str, source: str, col: str) -> str:
    return cosine_sql(source, 20, 20, row="feature", col=col, value="value")


@query(recs_sql(_cbf_sql("icm", "icm", "item_id")))
def rec_itemknn_cbf(spark, sf_dir):
    setting = train, _, _, _, n_items = _setting(spark, sf_dir)
    w = recommenders.knn_cbf(tables.icm_part(spark, sf_dir).withColumnRenamed("item_id", "id"), n_items, 20, 20)
    return _by_items(setting, train, w)


@query(recs_sql(_cbf_sql("ucm", "ucm", "user_id"), "SELECT src AS user_id, item_id, sum(rating * weight) AS score FROM w JOIN train ON dst = train.user_id GROUP BY ALL"))
def rec_userknn_cbf(spark, sf_dir):
    setting = train, _, _, _, _ = _setting(spark, sf_dir)
    w = recommenders.knn_cbf(tables.ucm_customer(spark, sf_dir).withColumnRenamed("user_id", "id"), table(spark, sf_dir, "customer").count(), 20, 20)
    return _by_users(setting, train, w)


@query(recs_sql("hy AS (SELECT item_id, 'f' || feature AS feature, value * 5 AS value FROM icm UNION ALL SELECT item_id, 'i' || user_id, rating FROM train), " + cosine_sql("hy", 20, 20, row="feature", col="item_id", value="value")))
def rec_hybrid_item(spark, sf_dir):
    setting = train, _, _, _, n_items = _setting(spark, sf_dir)
    w = recommenders.item_knn_hybrid(train, tables.icm_part(spark, sf_dir), n_items, 5.0, k=20, shrink=20)
    return _by_items(setting, train, w)


@query(recs_sql("hy AS (SELECT user_id, 'f' || feature AS feature, value * 5 AS value FROM ucm UNION ALL SELECT user_id, 'i' || item_id, rating FROM train), " + cosine_sql("hy", 20, 20, row="feature", col="user_id", value="value"), "SELECT src AS user_id, item_id, sum(rating * weight) AS score FROM w JOIN train ON dst = train.user_id GROUP BY ALL"))
def rec_hybrid_user(spark, sf_dir):
    setting = train, _, _, _, _ = _setting(spark, sf_dir)
    w = recommenders.user_knn_hybrid(train, tables.ucm_customer(spark, sf_dir), table(spark, sf_dir, "customer").count(), 5.0, k=20, shrink=20)
    return _by_users(setting, train, w)


def p3_sql(alpha: float, k: int, beta: float | None = None, normalise: bool = False) -> str:
    discount = f" * pow(deg, -{beta})" if beta is not None else ""
    scale = "weight / sum(weight) OVER (PARTITION BY src)" if normalise else "weight"
    return f"""a AS (SELECT user_id, item_id AS dst, pow(rating / sum(rating) OVER (PARTITION BY user_id), {alpha}) AS p FROM train), b AS (SELECT user_id, item_id AS src, pow(1.0 / count(*) OVER (PARTITION BY item_id), {alpha}) AS q FROM train),
dg AS (SELECT item_id AS dst, count(*)::DOUBLE AS deg FROM train GROUP BY 1), w1 AS (SELECT src, dst, sum(p * q){discount} AS weight FROM a JOIN b USING (user_id) JOIN dg USING (dst) WHERE src <> dst GROUP BY src, dst, deg),
w2 AS (SELECT src, dst, {scale} AS weight FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS r FROM w1) WHERE r <= {k}),
w AS (SELECT src, dst, weight FROM (SELECT *, row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) AS r FROM w2) WHERE r <= {k})"""


@query(recs_sql(p3_sql(0.8, 1000)))
def rec_p3alpha(spark, sf_dir):
    train, _, users, _, n_items = _setting(spark, sf_dir)
    return six(recommenders.p3alpha_lists(train, users, n_items, 10, 1000, 0.8), "score")


@query(recs_sql(p3_sql(1.0, 1000, 0.6, True)))
def rec_rp3beta(spark, sf_dir):
    train, _, users, _, n_items = _setting(spark, sf_dir)
    return six(recommenders.p3alpha_lists(train, users, n_items, 10, 1000, 1.0, normalise=True, beta=0.6), "score")


@query(f"WITH {UE} SELECT src, dst, round(weight, 6) AS weight FROM (SELECT user_id AS src, item_id AS dst, rating AS weight, row_number() OVER (PARTITION BY item_id ORDER BY rating DESC, user_id) AS r FROM ue) WHERE r <= 3")
def rec_custom_similarity(spark, sf_dir):
    return recommenders.custom_similarity(tables.urm_events(spark, sf_dir).select(F.col("user_id").alias("src"), F.col("item_id").alias("dst"), F.col("rating").alias("weight")), 3)


def _factor_recs(urm, users, items, n=10, mu=0.0):
    return six(ranking.top_n_factors(users, items, n, urm.select("user_id", "item_id"), mu), "score")


def _events(spark, sf_dir):
    """The matrix of the events, written once, with the sizes of its universe: users and ids up to the greatest item's."""
    u = materialise(tables.urm_events(spark, sf_dir), "events")
    size = u.agg(F.count_distinct("user_id").alias("users"), (F.coalesce(F.max("item_id"), F.lit(-1)) + 1).alias("items")).first()
    return u, size["users"], size["items"]


@query()
def rec_ease(spark, sf_dir):
    u, _, n_items = _events(spark, sf_dir)
    return six(ranking.ranked(ranking.item_scores(u, factorisation.ease(u, n_items, 50.0)).join(u.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti"), 10), "score")


@query(f"""WITH {UE}, g AS (SELECT a.item_id AS i, b.item_id AS j, sum(a.rating * b.rating) AS v FROM ue a JOIN ue b ON a.user_id = b.user_id AND a.item_id <> b.item_id GROUP BY ALL) SELECT i, j, round(v, 4) AS value FROM g""")
def ease_optimality(spark, sf_dir):
    """EASE minimises its loss if (G + l2) B equals G off the diagonal, G's own diagonal being the items' interactions."""
    u, _, n_items = _events(spark, sf_dir)
    b = factorisation.ease(u, n_items, 50.0)
    m = _items_matrix(u)
    pairs = similarity.pair_dots(m)
    diagonal = u.groupBy(F.col("item_id").alias("i")).agg((F.count("*") + 50.0).alias("dot")).select("i", F.col("i").alias("j"), "dot")
    g = materialise(pairs.union(pairs.select("j", "i", "dot")).union(diagonal), "gram")
    left = g.select("i", F.col("j").alias("src"), "dot").join(b, "src").groupBy("i", F.col("dst").alias("j")).agg(F.round(F.sum(F.col("dot") * F.col("weight")), 4).alias("value"))
    return left.join(g.filter("i <> j").select("i", "j"), ["i", "j"], "left_semi")


@query("SELECT i AS a, j AS b, (i = j)::INT::DOUBLE AS dot FROM range(8) x(i), range(8) y(j)")
def puresvd_orthonormal(spark, sf_dir):
    """The item factors of a truncated SVD are orthonormal."""
    u, _, n_items = _events(spark, sf_dir)
    _, v, _ = factorisation.pure_svd(u, n_items, 8)
    f = factorisation.item_table(spark, v).select("id", F.posexplode("factors").alias("k", "x"))
    both = f.select("id", F.col("k").alias("a"), F.col("x").alias("xa")).join(f.select("id", F.col("k").alias("b"), F.col("x").alias("xb")), "id")
    dots = both.groupBy("a", "b").agg(F.round(F.sum(F.col("xa") * F.col("xb")), 6).alias("dot"))
    return dots.select(F.col("a").cast("bigint").alias("a"), F.col("b").cast("bigint").alias("b"), (F.col("dot") + 0.0).alias("dot"))


@query()
def rec_puresvd(spark, sf_dir):
    u, _, n_items = _events(spark, sf_dir)
    users, v, _ = factorisation.pure_svd(u, n_items, 8)
    return _factor_recs(u, users, factorisation.item_table(spark, v))


@query()
def rec_puresvd_item(spark, sf_dir):
    u, _, n_items = _events(spark, sf_dir)
    _, v, _ = factorisation.pure_svd(u, n_items, 8)
    return six(factorisation.item_similarity_of(spark, v, 10), "weight")


@query()
def rec_ials(spark, sf_dir):
    u = materialise(tables.urm_orders(spark, sf_dir), "orders")
    users, items = factorisation.implicit_als(u, 5, rounds=2)
    return _factor_recs(u, users, items)


@query()
def rec_nmf(spark, sf_dir):
    u, _, n_items = _events(spark, sf_dir)
    users, h = factorisation.nmf(u, n_items, 5, 5)
    return _factor_recs(u, users, factorisation.item_table(spark, h))


@query()
def rec_slim_en(spark, sf_dir):
    u, n_users, n_items = _events(spark, sf_dir)
    return six(factorisation.slim_elastic_net(u, n_items, n_users, k=20), "weight")


def _sgd(model):
    def run(spark, sf_dir):
        u, _, n_items = _events(spark, sf_dir)
        users, v, b, _ = factorisation.sgd_factors(u, n_items, model, 5, 3, rate=0.01, negatives=0.2 if model == "funk" else 0.0)
        return _factor_recs(u, users, factorisation.item_table(spark, v, b))

    return run


for _model, _name in (("funk", "rec_funksvd"), ("bpr", "rec_bpr"), ("asy", "rec_asysvd")):
    QUERIES[_name] = _sgd(_model)


@query()
def rec_slim_bpr(spark, sf_dir):
    u, _, n_items = _events(spark, sf_dir)
    return six(factorisation.slim_bpr(u, n_items, 2, k=20), "weight")


@query(f"WITH {UE} SELECT DISTINCT user_id, 0.0::DOUBLE AS residual FROM ue")
def ials_optimality(spark, sf_dir):
    """ALS ends with the users' step: each user's factors x solve (Y'Y + sum r y y' + reg n I) x = sum (1 + r) y over its n
    items. Residual: the greatest part of the difference over the greatest of the right side, to two digits (ALS keeps
    single precision)."""
    k, reg = 5, 0.1
    u, _, _ = _events(spark, sf_dir)
    users, items = factorisation.implicit_als(u, k, reg, rounds=2)
    users, items = materialise(users, "users"), materialise(items, "items")
    cells = items.agg(*[F.sum(F.col("factors")[a] * F.col("factors")[b]).alias(f"g{a}_{b}") for a in range(k) for b in range(k)]).first()
    pairs = u.join(users.select(F.col("id").alias("user_id"), F.col("factors").alias("x")), "user_id").join(items.select(F.col("id").alias("item_id"), F.col("factors").alias("y")), "item_id")
    at = F.aggregate(F.zip_with("x", "y", lambda a, b: a * b), F.lit(0.0), lambda t, v: t + v)
    parts = [F.sum(F.col("rating") * at * F.col("y")[a]).alias(f"l{a}") for a in range(k)] + [F.sum((1 + F.col("rating")) * F.col("y")[a]).alias(f"r{a}") for a in range(k)]
    sums = pairs.groupBy("user_id").agg(F.first("x").alias("x"), F.count("*").alias("n"), *parts)
    off = [F.abs(sum(F.lit(cells[f"g{a}_{b}"]) * F.col("x")[b] for b in range(k)) + F.col(f"l{a}") + reg * F.col("n") * F.col("x")[a] - F.col(f"r{a}")) for a in range(k)]
    return sums.select("user_id", F.round(F.greatest(*off) / F.greatest(*[F.abs(F.col(f"r{a}")) for a in range(k)]), 2).alias("residual"))


@query("SELECT unnest(['asy', 'funk', 'nmf']) AS model, true AS falls")
def factor_loss_falls(spark, sf_dir):
    """More rounds fit the events' matrix better: the squared error, of NMF over all cells, of the others over what is stored."""
    u, _, n_items = _events(spark, sf_dir)

    def loss(users, v, bias=None, mu=0.0, all_cells=False):
        users = materialise(users, "users")
        s = ranking.factor_scores(users, factorisation.item_table(spark, v, bias), u.select("user_id", "item_id"), mu).join(u, ["user_id", "item_id"])
        if not all_cells:
            return s.agg(F.sum(F.pow(F.col("rating") - F.col("score"), F.lit(2.0))).alias("e")).first()["e"]
        k = v.shape[1]
        own = users.agg(*[F.sum(F.col("factors")[a] * F.col("factors")[b]) for a in range(k) for b in range(k)]).first()
        return s.agg(F.sum(F.col("rating") * (F.col("rating") - 2 * F.col("score"))).alias("e")).first()["e"] + sum(x * y for x, y in zip(own, (v.T @ v).ravel().tolist(), strict=True))

    found = [("nmf", *(loss(*factorisation.nmf(u, n_items, 5, n), all_cells=True) for n in (1, 3, 6)))]
    found += [(model, *(loss(*factorisation.sgd_factors(u, n_items, model, 5, n, rate=0.01)) for n in (1, 3, 6))) for model in ("asy", "funk")]
    return spark.createDataFrame([(model, bool(a > b > c)) for model, a, b, c in found], "model string, falls boolean")


# --- evaluation -------------------------------------------------------------------------------------------------------

TOPPOP = """p AS (SELECT p_partkey AS item_id, coalesce(s, 0) AS s FROM part LEFT JOIN (SELECT item_id, count(*) AS s FROM train GROUP BY 1) x ON x.item_id = p_partkey),
recs AS (SELECT user_id, item_id, rank FROM (SELECT u.user_id, p.item_id, row_number() OVER (PARTITION BY u.user_id ORDER BY s DESC, p.item_id) AS rank FROM (SELECT DISTINCT user_id FROM test) u CROSS JOIN p WHERE NOT EXISTS (SELECT 1 FROM train WHERE train.user_id = u.user_id AND train.item_id = p.item_id)) WHERE rank <= 20)"""
MARKED = """c AS (SELECT unnest([5, 10, 20]) AS cutoff), hm AS (SELECT r.*, t.rating AS rel, (t.rating IS NOT NULL)::INT AS hit, sum((t.rating IS NOT NULL)::INT) OVER (PARTITION BY r.user_id ORDER BY rank) AS hits FROM recs r LEFT JOIN test t USING (user_id, item_id)),
g AS (SELECT cutoff, user_id, count(*) AS n, sum(hit) AS h, sum(hit * hits / rank) AS ps, min(CASE WHEN hit = 1 THEN rank END) AS f, sum(hit / rank) AS arhr, sum(CASE WHEN hit = 1 THEN (pow(2, rel) - 1) / ln(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN hit = 0 THEN hits ELSE 0 END) AS won FROM hm JOIN c ON rank <= cutoff GROUP BY ALL),
i AS (SELECT user_id, count(*) AS p, sum((pow(2, rating) - 1) / ln(r + 1)) AS idcg FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS r FROM test) GROUP BY 1),
e AS (SELECT * FROM g JOIN i USING (user_id))"""


def _toppop_lists(spark, sf_dir, k_out: bool = False):
    train, test, users, items, n_items = _setting(spark, sf_dir)
    return ranking.top_n_global(recommenders.top_pop(train, items), train, users, 20), train, test, users, items


@query(f"""WITH {UO}, {SPLIT}, {TRAIN}, {TOPPOP}, {MARKED}, a AS (SELECT cutoff, count(*) AS n_users, avg(h / n) AS pr, avg(h / least(p, n)) AS prm, avg(h / p) AS re, avg(h) AS hr, avg(arhr) AS arhr FROM e GROUP BY 1)
SELECT cutoff, n_users, round(pr, 6) AS "PRECISION", round(prm, 6) AS "PRECISION_RECALL_MIN_DEN", round(re, 6) AS "RECALL", round(hr, 6) AS "HIT_RATE", round(arhr, 6) AS "ARHR", round(CASE WHEN pr + re = 0 THEN 0 ELSE 2 * pr * re / (pr + re) END, 6) AS "F1" FROM a""")
def eval_holdout_accuracy(spark, sf_dir):
    recs, _, test, users, _ = _toppop_lists(spark, sf_dir)
    cols = ["PRECISION", "PRECISION_RECALL_MIN_DEN", "RECALL", "HIT_RATE", "ARHR", "F1"]
    return six(evaluation.accuracy(recs, test, users, [5, 10, 20]).select("cutoff", "n_users", *cols), *cols)


@query(f"""WITH {UO}, {SPLIT}, {TRAIN}, {TOPPOP}, {MARKED}, few AS (SELECT user_id FROM train GROUP BY 1 HAVING count(*) < 30) SELECT cutoff, count(*) AS n_users, round(avg(h / n), 6) AS "PRECISION", round(avg(h / p), 6) AS "RECALL" FROM e WHERE user_id IN (SELECT user_id FROM few) GROUP BY 1""")
def eval_user_subset(spark, sf_dir):
    recs, train, test, users, _ = _toppop_lists(spark, sf_dir)
    few = users.join(train.groupBy("user_id").count().filter("count < 30"), "user_id", "left_semi")
    return six(evaluation.accuracy(recs, test, few, [5, 10, 20]).select("cutoff", "n_users", "PRECISION", "RECALL"), "PRECISION", "RECALL")


@query(f"""WITH {UO}, {SPLIT}, {TRAIN}, {TOPPOP}, {MARKED} SELECT cutoff, round(avg(ps / least(p, n)), 6) AS "MAP", round(avg(coalesce(1 / f, 0)), 6) AS "MRR", round(avg(CASE WHEN n = h THEN 1 WHEN h = 0 THEN 0 ELSE won / (h * (n - h)) END), 6) AS "ROC_AUC" FROM e GROUP BY 1""")
def eval_map_mrr_auc(spark, sf_dir):
    recs, _, test, users, _ = _toppop_lists(spark, sf_dir)
    return six(evaluation.accuracy(recs, test, users, [5, 10, 20]).select("cutoff", "MAP", "MRR", "ROC_AUC"), "MAP", "MRR", "ROC_AUC")


GRADED = """sp AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, item_id) AS r, count(*) OVER (PARTITION BY user_id) AS n FROM uo), train AS (SELECT user_id, item_id, rating FROM sp WHERE r > 6 AND n >= 7), test AS (SELECT user_id, item_id, 1 + rating % 5 AS rating FROM sp WHERE r <= 6 AND n >= 7)"""


@query(f"""WITH {UO}, {GRADED}, {TOPPOP}, {MARKED} SELECT cutoff, round(avg(CASE WHEN dcg = 0 THEN 0 ELSE dcg / idcg END), 6) AS "NDCG", round(avg(h / p), 6) AS "RECALL" FROM (SELECT cutoff, user_id, p, idcg, coalesce(h, 0) AS h, coalesce(dcg, 0) AS dcg FROM (SELECT * FROM i, c) LEFT JOIN (SELECT cutoff, user_id, h, dcg FROM g) USING (cutoff, user_id)) GROUP BY 1""")
def eval_ndcg(spark, sf_dir):
    s = splits.leave_k_out(splits.with_long_profiles(tables.urm_orders(spark, sf_dir), 7), 6, by="rating", validation=False)
    train = s.filter("split = 'train'").select("user_id", "item_id", "rating")
    test = s.filter("split = 'test'").select("user_id", "item_id", (1 + F.col("rating") % 5).alias("rating"))
    users = evaluation.eligible(test)
    recs = ranking.top_n_global(recommenders.top_pop(train, tables.items(spark, sf_dir)), train, users, 20)
    return six(evaluation.accuracy(recs, test, users, [5, 10, 20]).select("cutoff", "NDCG", "RECALL"), "NDCG", "RECALL")


@query(f"""WITH {UO}, {SPLIT}, {TRAIN}, {NEGATIVES}, cand AS (SELECT user_id, item_id FROM test UNION SELECT user_id, item_id FROM neg WHERE user_id IN (SELECT user_id FROM test)), p AS (SELECT item_id, count(*) AS s FROM train GROUP BY 1),
recs AS (SELECT user_id, item_id, rank FROM (SELECT user_id, item_id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(s, 0) DESC, item_id) AS rank FROM cand LEFT JOIN p USING (item_id) WHERE NOT EXISTS (SELECT 1 FROM train WHERE train.user_id = cand.user_id AND train.item_id = cand.item_id)) WHERE rank <= 20),
{MARKED} SELECT cutoff, round(avg(h), 6) AS "HIT_RATE", round(avg(ps / least(p, n)), 6) AS "MAP", round(avg(CASE WHEN dcg = 0 THEN 0 ELSE dcg / idcg END), 6) AS "NDCG" FROM e GROUP BY 1""")
def eval_negative_sample(spark, sf_dir):
    train, test, users, items, n_items = _setting(spark, sf_dir)
    neg = splits.negatives(tables.urm_orders(spark, sf_dir), users, n_items, 100)
    only = test.select("user_id", "item_id").union(neg).distinct()
    pop = recommenders.top_pop(train, items)
    recs = ranking.top_n(only.join(pop, "item_id").select("user_id", "item_id", "score"), train, users, n_items, 20, only=only)
    cols = ["HIT_RATE", "MAP", "NDCG"]
    return six(evaluation.accuracy(recs, test, users, [5, 10, 20]).select("cutoff", *cols), *cols)


@query(f"""WITH {UO}, {SPLIT}, {TRAIN}, {TOPPOP}, c AS (SELECT unnest([5, 10, 20]) AS cutoff), k AS (SELECT cutoff, p_partkey AS item_id, count(r.item_id) AS n FROM c CROSS JOIN part LEFT JOIN recs r ON r.item_id = p_partkey AND rank <= cutoff GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY cutoff) AS t, row_number() OVER (PARTITION BY cutoff ORDER BY n) AS i, count(*) OVER (PARTITION BY cutoff) AS m FROM k),
d AS (SELECT cutoff, avg((n > 0)::INT) AS cov, 1 - sum((n / t) * (n / t)) AS her, -sum(CASE WHEN n > 0 THEN n / t * log2(n / t) ELSE 0 END) AS sha, sum(n * n) AS sq, 2 * sum((m + 1 - i) / (m + 1) * n) / any_value(t) AS gin FROM s GROUP BY 1),
pop AS (SELECT item_id, count(*) AS pop FROM train GROUP BY 1), st AS (SELECT sum(pop) AS nnz, max(pop) AS top FROM pop), nu AS (SELECT count(DISTINCT user_id) AS u FROM test),
x AS (SELECT cutoff, r.user_id, sum(CASE WHEN pop IS NULL THEN 0 ELSE -log2(pop / nnz) END) / (SELECT count(*) FROM part) AS nov, avg(coalesce(pop, 0) / top) AS ap FROM recs r JOIN c ON rank <= cutoff LEFT JOIN pop USING (item_id), st GROUP BY 1, 2),
y AS (SELECT cutoff, sum(nov) / any_value(u) AS nov, sum(ap) / any_value(u) AS ap, count(*) AS l FROM x, nu GROUP BY 1)
SELECT cutoff, round(cov, 6) AS "COVERAGE_ITEM", round(her, 6) AS "DIVERSITY_HERFINDAHL", round(sha, 6) AS "SHANNON_ENTROPY", round(gin, 6) AS "DIVERSITY_GINI", round(nov, 6) AS "NOVELTY", round(ap, 6) AS "AVERAGE_POPULARITY", round((u * u - u - (sq / cutoff - u)) / (u * u - u), 6) AS "DIVERSITY_MEAN_INTER_LIST", round(l / (SELECT count(*) FROM customer), 6) AS "COVERAGE_USER" FROM d JOIN y USING (cutoff), nu""")
def eval_beyond_accuracy(spark, sf_dir):
    recs, train, _, users, items = _toppop_lists(spark, sf_dir)
    got = evaluation.beyond_accuracy(recs, train, items, users, table(spark, sf_dir, "customer").count(), [5, 10, 20])
    return six(got, *[c for c in got.columns if c != "cutoff"])


@query(f"""WITH {UO}, {SPLIT}, {TRAIN}, {TOPPOP}, c AS (SELECT unnest([10, 20]) AS cutoff), h AS (SELECT cutoff, r.* FROM recs r JOIN test t USING (user_id, item_id) JOIN c ON rank <= cutoff)
SELECT cutoff, round(count(DISTINCT item_id) / (SELECT count(*) FROM part), 6) AS "COVERAGE_TEST_CORRECT", round(count(DISTINCT user_id) / (SELECT count(*) FROM customer), 6) AS "COVERAGE_USER_CORRECT" FROM h GROUP BY 1""")
def eval_correct_coverage(spark, sf_dir):
    recs, _, test, _, items = _toppop_lists(spark, sf_dir)
    return six(evaluation.correct_coverage(recs, test, items, table(spark, sf_dir, "customer").count(), [10, 20]), "COVERAGE_TEST_CORRECT", "COVERAGE_USER_CORRECT")


@query(f"""WITH {UO}, {SPLIT}, {TRAIN}, {TOPPOP}, {cosine_sql("train", 0, 1 << 62)}, t AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM recs WHERE rank <= 5),
x AS (SELECT a.user_id, a.n, sum(1 - coalesce(weight, 0)) AS s FROM t a JOIN t b ON a.user_id = b.user_id AND a.rank <> b.rank AND a.rank < a.n LEFT JOIN w ON src = a.item_id AND dst = b.item_id GROUP BY 1, 2) SELECT round(avg(s / (n * (n - 1))), 6) AS "DIVERSITY_SIMILARITY" FROM x""")
def eval_similarity_diversity(spark, sf_dir):
    recs, train, _, _, _ = _toppop_lists(spark, sf_dir)
    listed = recs.filter("rank <= 5").select("item_id").distinct()  # a cosine is of its two items alone, and no other pair is asked for
    w = similarity.similarity(_items_matrix(train.join(listed, "item_id", "left_semi")), "cosine", None)
    return six(evaluation.similarity_diversity(recs, w, 5), "DIVERSITY_SIMILARITY")


@query(f"""WITH {UO}, {SPLIT}, {TRAIN}, {TOPPOP}, h AS (SELECT user_id, min(rank) AS r FROM recs JOIN test USING (user_id, item_id) WHERE rank <= 10 GROUP BY 1), a AS (SELECT DISTINCT user_id FROM test),
v AS (SELECT user_id, count(*) AS h, sum(1 / log2(rank + 1)) AS dcg FROM recs JOIN test USING (user_id, item_id) WHERE rank <= 10 GROUP BY 1), rl AS (SELECT user_id, least(count(*), 10) AS m FROM test GROUP BY 1),
al AS (SELECT DISTINCT user_id, item_id FROM sp WHERE split IN ('train', 'test')), na AS (SELECT user_id, count(*) AS n FROM al WHERE user_id IN (SELECT user_id FROM test) GROUP BY 1), ha AS (SELECT user_id, count(*) AS h FROM recs JOIN al USING (user_id, item_id) WHERE rank <= 10 GROUP BY 1)
SELECT round(avg((r IS NOT NULL)::INT), 6) AS "HR", round(avg(coalesce(ln(2) / ln(r + 1), 0)), 6) AS "NDCG", (SELECT round(avg(coalesce(h, 0) / m), 6) FROM rl LEFT JOIN v USING (user_id)) AS "RECALL_MIN", (SELECT round(avg(coalesce(dcg, 0) / list_sum(list_transform(range(1, m + 1), lambda q: 1 / log2(q + 1)))), 6) FROM rl LEFT JOIN v USING (user_id)) AS "NDCG_TRUNCATED", (SELECT round(avg(coalesce(h, 0) / n), 6) FROM na LEFT JOIN ha USING (user_id)) AS "RECALL_ALL" FROM a LEFT JOIN h USING (user_id)""")
def eval_variants(spark, sf_dir):
    recs, train, test, users, _ = _toppop_lists(spark, sf_dir)
    got = evaluation.binary_ndcg(recs, test, 10).join(evaluation.truncated(recs, test, users, 10)).join(evaluation.recall_of_all(recs, train, test, 10))
    return six(got, *got.columns)


@query(f"""WITH {UO}, {SPLIT}, tr AS (SELECT * FROM sp WHERE split = 'train'), te AS (SELECT * FROM sp WHERE split = 'test'), m AS (SELECT item_id, avg(rating) AS score FROM tr GROUP BY 1)
SELECT round(sqrt(avg(pow(rating - least(greatest(coalesce(score, 0), 1), 50), 2))), 6) AS "RMSE" FROM te LEFT JOIN m USING (item_id)""")
def eval_rmse(spark, sf_dir):
    s = splits.timestamp(tables.urm_orders(spark, sf_dir))
    test = s.filter("split = 'test'")
    mean = s.filter("split = 'train'").groupBy("item_id").agg(F.avg("rating").alias("score"))
    return six(evaluation.rmse(test.join(mean, "item_id").select("user_id", "item_id", "score"), test, 1.0, 50.0), "RMSE")


@query(f"""WITH {UO}, {SPLIT}, {TRAIN}, {TOPPOP} SELECT 10 AS cutoff, p_partkey AS item_id, count(r.item_id) AS n FROM part LEFT JOIN recs r ON r.item_id = p_partkey AND rank <= 10 WHERE p_partkey % 7 <> 0 GROUP BY p_partkey""")
def eval_item_counts(spark, sf_dir):
    recs, _, _, _, items = _toppop_lists(spark, sf_dir)
    return evaluation.recommended_counts(recs, items, [10], items.filter("item_id % 7 = 0"))


# --- statistics, reports, preparation for wrapped models --------------------------------------------------------------


@query(f"""WITH {UO}, k AS (SELECT p_partkey, count(item_id) AS n FROM part LEFT JOIN uo ON item_id = p_partkey GROUP BY 1), s AS (SELECT *, n + 1e-7 AS x, sum(n) OVER () AS t, row_number() OVER (ORDER BY n) AS i, count(*) OVER () AS m FROM k)
SELECT max(n) AS most, min(n) AS least, round(avg(n), 6) AS mean, round(-sum(CASE WHEN n > 0 THEN n / t * log2(n / t) ELSE 0 END), 6) AS shannon, round(1 - sum((n / t) * (n / t)), 6) AS herfindahl, round(sum((2 * i - m - 1) * x) / (any_value(m) * sum(x)), 6) AS gini FROM s""")
def popularity_stats(spark, sf_dir):
    return six(statistics.popularity(tables.urm_orders(spark, sf_dir), tables.items(spark, sf_dir)), "mean", "shannon", "herfindahl", "gini")


@query(f"""WITH {UO}, n AS (SELECT count(*) AS c FROM uo GROUP BY item_id) SELECT p_partkey AS item_id, round(count(item_id) / (SELECT max(c) FROM n), 6) AS share FROM part LEFT JOIN uo ON item_id = p_partkey GROUP BY 1""")
def popularity_curve(spark, sf_dir):
    return six(statistics.popularity_curve(tables.urm_orders(spark, sf_dir), tables.items(spark, sf_dir)), "share")


@query(f"""WITH {UO}, a AS (SELECT p_partkey AS i, count(item_id) AS x FROM part LEFT JOIN uo ON item_id = p_partkey GROUP BY 1), b AS (SELECT p_partkey AS i, count(item_id) AS y FROM part LEFT JOIN (SELECT * FROM uo WHERE rating >= 25) ON item_id = p_partkey GROUP BY 1), j AS (SELECT * FROM a JOIN b USING (i)),
s AS (SELECT sum(sign(q.y - p.y)) AS s FROM j p JOIN j q ON p.x < q.x), n AS (SELECT count(*) * (count(*) - 1) / 2 AS n0 FROM j), tx AS (SELECT sum(c * (c - 1) / 2) AS t FROM (SELECT count(*) AS c FROM j GROUP BY x)), ty AS (SELECT sum(c * (c - 1) / 2) AS t FROM (SELECT count(*) AS c FROM j GROUP BY y))
SELECT round(s / sqrt((n0 - tx.t) * (n0 - ty.t)), 6) AS tau FROM s, n, tx, ty""")
def popularity_tau(spark, sf_dir):
    u, items = tables.urm_orders(spark, sf_dir), tables.items(spark, sf_dir)
    n = lambda df, name: items.join(df.groupBy("item_id").agg(F.count("*").alias(name)), "item_id", "left").na.fill(0, [name])
    return six(statistics.kendall_tau(n(u, "x").join(n(u.filter("rating >= 25"), "y"), "item_id"), "x", "y"), "tau")


@query(f"""WITH {UO}, {SPLIT}, {TRAIN}, {TOPPOP}, {MARKED}, a AS (SELECT cutoff, avg(h / n) AS pr, avg(h / p) AS re FROM e GROUP BY 1)
SELECT 'toppop' AS algorithm, max(CASE WHEN cutoff = 5 THEN round(pr, 6) END) AS "PRECISION@5", max(CASE WHEN cutoff = 5 THEN round(re, 6) END) AS "RECALL@5", max(CASE WHEN cutoff = 10 THEN round(pr, 6) END) AS "PRECISION@10", max(CASE WHEN cutoff = 10 THEN round(re, 6) END) AS "RECALL@10" FROM a""")
def results_pivot(spark, sf_dir):
    recs, _, test, users, _ = _toppop_lists(spark, sf_dir)
    long = evaluation.long_form(six(evaluation.accuracy(recs, test, users, [5, 10]).select("cutoff", "PRECISION", "RECALL"), "PRECISION", "RECALL"))
    return report.results_table(long.withColumn("algorithm", F.lit("toppop")), ["PRECISION", "RECALL"], [5, 10])


@query("SELECT o_orderstatus AS algorithm, count(*) AS n_cases, round(avg(o_totalprice), 6) AS train_s_mean, round(stddev_samp(o_totalprice), 6) AS train_s_std, round(avg(o_orderkey::DOUBLE + 1), 6) AS evaluate_s_mean, round(stddev_samp(o_orderkey::DOUBLE + 1), 6) AS evaluate_s_std, round(max(o_custkey) / avg(o_orderkey::DOUBLE + 1), 6) AS users_per_s FROM orders GROUP BY 1")
def time_statistics(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("algorithm"), F.col("o_totalprice").alias("train_s"), (F.col("o_orderkey") + 1.0).alias("evaluate_s"), F.col("o_custkey").alias("n_users"))
    got = report.time_statistics(o)
    return six(got, *[c for c in got.columns if c not in ("algorithm", "n_cases")])


@query(f"""WITH {UE}, du AS (SELECT user_id, count(*) AS du FROM ue GROUP BY 1), di AS (SELECT item_id, count(*) AS di FROM ue GROUP BY 1), e AS (SELECT 'u' || user_id AS u, 'i' || item_id AS i, round(-1 / sqrt(du * di), 6) AS value FROM ue JOIN du USING (user_id) JOIN di USING (item_id))
SELECT u AS src, i AS dst, value FROM e UNION ALL SELECT i, u, value FROM e""")
def bipartite_laplacian(spark, sf_dir):
    return six(neural_data.bipartite_laplacian(tables.urm_events(spark, sf_dir)), "value")


@query(f"WITH {UO} SELECT item_id, CAST(list(user_id ORDER BY user_id)[1:5] AS VARCHAR) AS users FROM uo GROUP BY 1")
def item_neighbourhood(spark, sf_dir):
    got = neural_data.item_neighbourhood(tables.urm_orders(spark, sf_dir), 5)
    return got.select("item_id", F.concat(F.lit("["), F.array_join(F.col("users").cast("array<string>"), ", "), F.lit("]")).alias("users"))


@query(f"""WITH {UO}, want AS (SELECT user_id, 2 * count(*) AS w FROM uo GROUP BY 1), {walk_sql("f", "SELECT user_id FROM want", "uo", "SELECT max(w) FROM want")}
SELECT user_id, item_id, 1 AS label FROM uo UNION ALL SELECT user_id, item_id, 0 FROM f JOIN want USING (user_id) WHERE rank <= w""")
def pointwise_samples(spark, sf_dir):
    return neural_data.pointwise_samples(tables.urm_orders(spark, sf_dir), table(spark, sf_dir, "part").count(), 2)


@query(f"""WITH {UO}, {cosine_sql("uo", 0, 5, row="item_id", col="user_id")},
p AS (SELECT a.user_id, a.item_id AS via_item, w.dst AS via_user, c.item_id, round(weight, 9) AS weight FROM uo a JOIN w ON w.src = a.user_id AND w.weight > 0.1 JOIN uo b ON b.user_id = w.dst AND b.item_id = a.item_id JOIN uo c ON c.user_id = w.dst AND c.item_id <> a.item_id)
SELECT user_id, via_item, via_user, item_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY weight DESC, via_user, via_item) AS r FROM p) WHERE r <= 1""")
def meta_paths(spark, sf_dir):
    u = tables.urm_orders(spark, sf_dir)
    m = u.select(F.col("item_id").alias("row"), F.col("user_id").alias("col"), F.col("rating").alias("value"))
    return neural_data.meta_paths(u, similarity.similarity(m, "cosine", 5), 0.1, 1)


@query("SELECT date_trunc('day', ts) AS window_start, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS item_id, count(*)::DOUBLE AS rating FROM events GROUP BY ALL")
def windowed_interactions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item_id"), "ts")
    return ingest.windowed_interactions(e).drop("ts")


@query("""WITH e AS (SELECT vec_id, unnest([1, 2, 3]) AS k, embedding FROM embeddings), u AS (SELECT vec_id, k, embedding[k % 3 + 1]::DOUBLE AS v FROM e), i AS (SELECT vec_id, k, embedding[k]::DOUBLE AS v FROM e)
SELECT u.vec_id AS user_id, i.vec_id AS item_id, ((u.k - 1) * 3 + i.k - 1)::INT AS cell, round(CASE WHEN u.k = i.k THEN 0 ELSE u.v * i.v END, 6) + 0.0 AS value FROM u JOIN i ON i.vec_id = u.vec_id + 1""")
def interaction_maps(spark, sf_dir):
    """Maps of permuted user factors and item factors, without their main diagonals."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.slice("embedding", 1, 3).cast("array<double>").alias("factors"))
    pairs = e.select(F.col("id").alias("user_id"), (F.col("id") + 1).alias("item_id"))
    maps = neural_data.outer_product(neural_data.permuted_factors(e, [1, 2, 0]), e, pairs, "off_diagonal")
    return six(maps.select("user_id", "item_id", F.posexplode("map").alias("cell", "value")), "value").withColumn("value", F.col("value") + 0.0)


# --- store ------------------------------------------------------------------------------------------------------------


@query(f"WITH {UE} SELECT user_id, item_id, rating, (SELECT count(*) FROM ue) AS stored FROM ue")
def stored_matrix(spark, sf_dir):
    """A matrix and its count, saved and loaded; what is built a second time isn't: the saved copy serves."""
    u, folder = tables.urm_events(spark, sf_dir).select("user_id", "item_id", "rating"), f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    store.load_or_build(spark, folder, lambda: ({"urm": u}, {"n": u.count()}))
    found, values = store.load_or_build(spark, folder, lambda: ({"urm": u.limit(0)}, {"n": 0}))
    return found["urm"].withColumn("stored", F.lit(values["n"]).cast("bigint"))
