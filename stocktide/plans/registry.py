"""Every query by name, with its SQL oracle.

The shared tables play inventory roles: part is the catalogue (sku = brand-key), lineitem summed by part and supplier
the source rows, part x supplier the variations, events an ordered sheet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stocktide.functions import text
from stocktide.operators import match, ordered, reconcile


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _catalogue(spark, sf_dir) -> DataFrame:
    sku = F.concat_ws("-", "p_brand", F.col("p_partkey").cast("string"))
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").alias("ord"), sku.alias("sku"), F.col("p_name").alias("name"), "p_type", "p_brand", "p_size")


def sku_normalize(spark, sf_dir):
    c = _catalogue(spark, sf_dir)
    keys = text.sku_match_keys(F.concat("sku", F.lit("f")))
    return c.select("id", text.normalize_sku(F.col("sku")).alias("norm"), text.digits_of(F.col("sku")).alias("digits"), F.array_join(keys, "|").alias("keys"))


def name_normalize(spark, sf_dir):
    c = _catalogue(spark, sf_dir).withColumn("full", F.concat_ws(" / ", "name", "p_type"))
    return c.select("id", text.normalize_name(F.col("full")).alias("norm"), F.array_join(F.array_sort(text.name_tokens(F.col("full"))), "|").alias("tokens"))


def size_alias(spark, sf_dir):
    sizes = _catalogue(spark, sf_dir).withColumn("raw", F.element_at(F.array(*map(F.lit, (" 2xl", "3XL", "one size", "f ", "M", "xl"))), (F.col("p_size") % 6 + 1).cast("int")))
    return sizes.select("id", text.normalize_size(F.col("raw")).alias("size"))


def to_int_parse(spark, sf_dir):
    li = _table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.sum(F.round(F.col("l_extendedprice") * 100)).cast("bigint").alias("cents"))
    raw = F.when(F.col("cents") % 7 == 0, "n/a").when(F.col("cents") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.expr("cents div 1000"), F.lit(","), F.lpad(F.expr("cents % 1000").cast("string"), 3, "0"), F.lit(".7")))
    q = li.select("l_partkey", text.to_int(raw).alias("quantity"))
    return q.select("l_partkey", "quantity", text.availability(F.col("quantity") % 3).alias("availability"))


def forward_fill(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("").alias("cell"))
    return ordered.forward_fill(e, "cell", ["user_id"], "event_id", "filled").select("event_id", "filled")


def consecutive_dedup(spark, sf_dir):
    return ordered.drop_consecutive(_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), ["event_type"], ["user_id"], "event_id")


def occurrence_islands(spark, sf_dir):
    return ordered.occurrence_keys(_table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "event_type", ["user_id"], "event_id").select("event_id", "occurrence", F.col("block").cast("bigint").alias("block"), F.col("blocks").cast("bigint").alias("blocks"))


def block_split(spark, sf_dir):
    e = _table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("event_id") % 5).alias("rank"), (F.col("event_id") * 10).cast("double").alias("y"))
    return ordered.split_blocks(e, "rank", "y", ["user_id"], "event_id", 9000.0).select("event_id", F.col("part").cast("bigint").alias("part"))


def first_wins_index(spark, sf_dir):
    c = _catalogue(spark, sf_dir)
    return ordered.first_wins(c, text.normalize_name(F.col("name")), "id", "ord")


def _sources(spark, sf_dir) -> DataFrame:
    p = _catalogue(spark, sf_dir)
    kind = F.col("id") % 5
    product = F.when(kind == 0, F.lower("sku")).when(kind == 1, F.concat("sku", F.lit("F"))).when(kind == 2, F.upper(F.col("name"))).when(kind == 3, F.concat_ws(" ", F.col("p_type"), F.lit("made up"))).otherwise(F.concat(F.lit("none"), F.col("id")))
    return p.select("ord", F.element_at(F.array(F.lit("SP5"), F.lit("ALO"), F.lit("PALLET")), (F.col("id") % 3 + 1).cast("int")).alias("source"), F.col("p_type").alias("category"), product.alias("product"), product.alias("occurrence"))


def _rules(spark, sf_dir) -> DataFrame:
    p = _catalogue(spark, sf_dir).where("id % 20 in (4, 9, 14)")
    return p.select(F.when(F.col("id") % 20 == 4, "*").otherwise(F.element_at(F.array(F.lit("SP5"), F.lit("ALO"), F.lit("PALLET")), (F.col("id") % 3 + 1).cast("int"))).alias("source"), F.when(F.col("id") % 20 == 9, "").otherwise(F.col("p_type")).alias("category"), F.concat(F.lit("none"), F.col("id")).alias("product"), F.when(F.col("id") % 20 == 4, F.concat("sku", F.lit("FF"))).when(F.col("id") % 20 == 9, F.lit("gone-1")).otherwise("").alias("parent_sku"), "ord")


def rule_cascade(spark, sf_dir):
    return match.match_products(_sources(spark, sf_dir), _catalogue(spark, sf_dir), _rules(spark, sf_dir))


def fuzzy_name_top1(spark, sf_dir):
    """Every part's name with a word more, against all products."""
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("name"))
    rows = p.select(F.col("id").alias("ord"), F.concat(F.lit("New "), "name", F.lit("!")).alias("product"))
    return match.by_similarity(rows, p.select("id", F.col("id").alias("ord"), "name"), 0.6).select("ord", "product_id")


def fuzzy_name_every(spark, sf_dir):
    """Every part against all others."""
    p = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_type", "p_name").alias("name"))
    rows = p.select(F.col("id").alias("ord"), F.col("name").alias("product"))
    return match.by_similarity(rows, p.withColumn("ord", F.col("id")), 0.6, others=True).select("ord", "product_id")


def nearest_sku_topk(spark, sf_dir):
    """Every identifier with one symbol too many against all products, some of which end in F or combine two identifiers."""
    c = _catalogue(spark, sf_dir)
    sku = F.when(F.col("id") % 7 == 0, F.concat("sku", F.lit("F"))).when(F.col("id") % 7 == 1, F.concat("sku", F.lit(" SET"), F.col("id"))).otherwise(F.col("sku"))
    c = c.withColumn("sku", sku)
    wanted = c.select(F.concat(F.split_part("sku", F.lit(" "), F.lit(1)), F.lit("X")).alias("key"))
    return match.nearest_sku(wanted, c).select("key", "id", F.col("distance").cast("bigint").alias("distance"), F.col("place").cast("bigint").alias("place"))


def nearest_sku_every(spark, sf_dir):
    """Every identifier with one symbol too many against all products."""
    c = _catalogue(spark, sf_dir)
    return match.nearest_sku(c.select(F.concat("sku", F.lit("X")).alias("key")), c).select("key", "id", F.col("distance").cast("bigint").alias("distance"), F.col("place").cast("bigint").alias("place"))


def _stock(spark, sf_dir) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").cast("bigint").alias("q"))
    k = F.col("l_partkey") + F.col("l_suppkey")
    return li.select(
        (F.col("l_partkey") * 1000000 + F.col("l_suppkey")).alias("ord"), F.element_at(F.array(F.lit("SP5"), F.lit("ALO"), F.lit("PALLET")), (k % 3 + 1).cast("int")).alias("source"),
        F.concat(F.lit("p"), F.col("l_partkey")).alias("product"), F.col("l_suppkey").cast("string").alias("size"),
        F.when(k % 13 != 0, F.col("l_partkey")).alias("product_id"), F.when(k % 26 == 0, match.RULE_MISSING).when(k % 13 == 0, match.NONE).otherwise(match.SKU).alias("method"),
        F.when(k % 17 != 0, F.col("l_suppkey")).alias("variation_id"), F.when(k % 5 != 0, F.col("q")).alias("src_qty"), F.when(k % 4 == 0, "outofstock").otherwise("instock").alias("src_status"),
        (k % 3 != 0).alias("managed"), F.when(k % 10 == 0, 0).when(k % 6 != 0, F.col("q") + k % 2).cast("bigint").alias("store_qty"), F.when(k % 8 == 0, "onbackorder").when(k % 20 == 0, "outofstock").otherwise("instock").alias("store_status"),
    )


def reconcile_diff(spark, sf_dir):
    return reconcile.classify(_stock(spark, sf_dir)).select("ord", "status", "qty_delta", "action", "note")


def reconcile_summary(spark, sf_dir):
    return reconcile.summarize(reconcile.classify(_stock(spark, sf_dir)))


def update_payload(spark, sf_dir):
    d = reconcile.select_changes(reconcile.classify(_stock(spark, sf_dir)).withColumn("parent_sku", F.lit("")).withColumn("product_name", F.lit("")), ["sp5", " ALO "], "P1")
    return d.select("ord", reconcile.payload().alias("p")).select("ord", "p.*")


def collapsed_updates(spark, sf_dir):
    d = reconcile.select_changes(reconcile.classify(_stock(spark, sf_dir))).withColumn("payload", reconcile.payload()).withColumn("variation_id", F.col("variation_id") % 3)
    return reconcile.collapse_updates(d)


def manual_by_product(spark, sf_dir):
    d = reconcile.classify(_stock(spark, sf_dir)).where(F.col("status").isin(*reconcile.MANUAL))
    return reconcile.transitions(d, ["source", "product"], F.col("size"), "method")


def change_by_product(spark, sf_dir):
    d = reconcile.classify(_stock(spark, sf_dir)).where(F.col("status") == reconcile.CHANGED)
    return reconcile.transitions(d, ["source", "product", "product_id"], F.concat_ws(":", "size", "qty_delta"), "action")


def duplicate_keys(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1")


def quality_histogram(spark, sf_dir):
    v = F.col("value")
    return _table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(v < 1).alias("blank"), F.count_if(v >= 60).alias("marked"), F.count_if((v >= 1) & (v < 60)).alias("ambiguous"))


def source_stats(spark, sf_dir):
    return _stock(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_rows"), F.count_distinct("product").alias("products"))


def orphan_skus(spark, sf_dir):
    used = _table(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("id"))
    return _catalogue(spark, sf_dir).select("id", "sku").join(used, "id", "left_anti")


QUERIES = (sku_normalize, name_normalize, size_alias, to_int_parse, forward_fill, consecutive_dedup, occurrence_islands, block_split, first_wins_index, rule_cascade, fuzzy_name_top1, fuzzy_name_every, nearest_sku_topk, nearest_sku_every, reconcile_diff, reconcile_summary, update_payload, collapsed_updates, manual_by_product, change_by_product, duplicate_keys, quality_histogram, source_stats, orphan_skus)


def queries() -> dict:
    from stocktide.plans import inventory

    return {f.__name__: f for f in (*QUERIES, *inventory.QUERIES)}


CAT = "cat AS (SELECT p_partkey AS id, p_brand || '-' || p_partkey AS sku, p_name AS name, p_type, p_size FROM part)"
PUNCT = r"[\s_\-/\\|,.:;''\"()\[\]{}<>+&*#@!?~`^$%]+"
NORM = "upper(regexp_replace({}, '[^0-9A-Za-z]+', '', 'g'))"
SRC = "list_extract(['SP5', 'ALO', 'PALLET'], ({}) % 3 + 1)"
STOCK = f"""agg AS (SELECT l_partkey, l_suppkey, l_partkey + l_suppkey AS k, CAST(sum(l_quantity) AS BIGINT) AS q FROM lineitem GROUP BY ALL),
stock AS (SELECT l_partkey * 1000000 + l_suppkey AS ord, {SRC.format("k")} AS source, 'p' || l_partkey AS product, CAST(l_suppkey AS VARCHAR) AS size,
 CASE WHEN k % 13 <> 0 THEN l_partkey END AS product_id, CASE WHEN k % 26 = 0 THEN '{match.RULE_MISSING}' WHEN k % 13 = 0 THEN '{match.NONE}' ELSE '{match.SKU}' END AS method,
 CASE WHEN k % 17 <> 0 THEN l_suppkey END AS variation_id, CASE WHEN k % 5 <> 0 THEN q END AS src_qty, CASE WHEN k % 4 = 0 THEN 'outofstock' ELSE 'instock' END AS src_status,
 k % 3 <> 0 AS managed, CASE WHEN k % 10 = 0 THEN 0 WHEN k % 6 <> 0 THEN q + k % 2 END AS store_qty, CASE WHEN k % 8 = 0 THEN 'onbackorder' WHEN k % 20 = 0 THEN 'outofstock' ELSE 'instock' END AS store_status FROM agg),
judged AS (SELECT *, (NOT managed OR src_qty IS NULL OR (store_qty IS NOT NULL AND src_qty = store_qty)) AS qty_same, src_status = store_status AS status_same,
 src_qty IS NULL AND managed AND src_status = 'instock' AND store_status <> 'instock' AND coalesce(store_qty, 0) = 0 AS need FROM stock),
diff AS (SELECT *, CASE WHEN product_id IS NULL THEN CASE WHEN method = '{match.RULE_MISSING}' THEN '{reconcile.NO_PRODUCT}' ELSE '{reconcile.UNMATCHED}' END
 WHEN variation_id IS NULL THEN '{reconcile.NO_VARIATION}' WHEN need THEN '{reconcile.NEED_QTY}' WHEN qty_same AND status_same THEN '{reconcile.SAME}' ELSE '{reconcile.CHANGED}' END AS status,
 CASE WHEN product_id IS NOT NULL AND variation_id IS NOT NULL AND NOT need AND managed THEN src_qty - store_qty END AS qty_delta FROM judged),
pay AS (SELECT *, CASE WHEN managed THEN true END AS manage_stock, CASE WHEN managed THEN coalesce(src_qty, CASE WHEN src_status = 'outofstock' THEN 0 END) END AS stock_quantity, src_status AS stock_status FROM diff),
diffs AS (SELECT *, CASE status WHEN '{reconcile.CHANGED}' THEN concat_ws('；', '数量 ' || coalesce(CAST(store_qty AS VARCHAR), 'None') || ' → ' || CAST(stock_quantity AS VARCHAR),
  '状态 ' || CASE store_status WHEN 'instock' THEN '有货' WHEN 'outofstock' THEN '缺货' ELSE store_status END || ' → ' || CASE src_status WHEN 'instock' THEN '有货' ELSE '缺货' END) WHEN '{reconcile.SAME}' THEN '{reconcile.NOTHING}' ELSE '{reconcile.BY_HAND}' END AS action,
 CASE status WHEN '{reconcile.CHANGED}' THEN CASE WHEN src_qty IS NULL AND managed AND stock_quantity IS NULL THEN '{reconcile.NOTE_STATUS_ONLY}' WHEN src_qty IS NULL AND NOT managed THEN '{reconcile.NOTE_UNMANAGED}' ELSE '' END
  WHEN '{reconcile.SAME}' THEN CASE WHEN managed THEN '{reconcile.NOTE_SAME}' ELSE '{reconcile.NOTE_SAME_STATUS}' END WHEN '{reconcile.NO_PRODUCT}' THEN '{reconcile.NOTE_RULE_MISSING}' WHEN '{reconcile.UNMATCHED}' THEN '{reconcile.NOTE_UNMATCHED}'
  WHEN '{reconcile.NO_VARIATION}' THEN '{reconcile.NOTE_NO_VARIATION}' ELSE '{reconcile.NOTE_NEED_QTY}' END AS note FROM pay)"""


def _keys(alias: str, value: str) -> str:
    """Sorted identifier keys of a value, as a list."""
    n = NORM.format(value)
    return f"list_sort(list_distinct([{n}, CASE WHEN length({n}) > 1 AND {n} LIKE '%F' THEN left({n}, length({n}) - 1) ELSE {n} END])) AS {alias}"


ROWS = f"""src AS (SELECT id AS ord, {SRC.format("id")} AS source, p_type AS category, CASE id % 5 WHEN 0 THEN lower(sku) WHEN 1 THEN sku || 'F' WHEN 2 THEN upper(name) WHEN 3 THEN p_type || ' made up' ELSE 'none' || id END AS product FROM cat),
rules AS (SELECT CASE WHEN id % 20 = 4 THEN '*' ELSE {SRC.format("id")} END AS source, CASE WHEN id % 20 = 9 THEN '*' ELSE p_type END AS category, 'none' || id AS product, CASE id % 20 WHEN 4 THEN sku || 'FF' WHEN 9 THEN 'gone-1' ELSE '' END AS parent FROM cat WHERE id % 20 IN (4, 9, 14))"""

#: Every identifier key of a product (its own, pool 0, or a part of a combined one, pool 1) goes to the first product that has it.
NEAREST = f"""WITH {CAT}, c AS (SELECT id, {{sku}} AS sku FROM cat), t AS (SELECT id, sku, string_split(sku, ' ') AS parts FROM c),
one AS (SELECT id, 0 AS pool, {NORM.format("sku")} AS n FROM t UNION ALL SELECT id, 1, {NORM.format("p")} FROM (SELECT id, unnest(parts) AS p FROM t WHERE len(parts) > 1)),
ks AS (SELECT id, pool, n AS k FROM one UNION ALL SELECT id, pool, left(n, length(n) - 1) FROM one WHERE n LIKE '_%F'), f AS (SELECT k, pool, min(id) AS id FROM ks WHERE k <> '' GROUP BY 1, 2),
w AS (SELECT DISTINCT parts[1] || 'X' AS key, {NORM.format("parts[1] || 'X'")} AS q, regexp_replace(parts[1], '[^0-9]', '', 'g') AS g FROM t), k2 AS (SELECT *, regexp_replace(k, '[^0-9]', '', 'g') AS g FROM f),
p AS (SELECT key, q, id, min(row(levenshtein(q, k), pool, CASE WHEN w.g <> '' AND w.g = k2.g THEN 0 ELSE 1 END)) AS b FROM w JOIN k2 ON levenshtein(q, k) <= 2 OR (w.g <> '' AND w.g = k2.g) GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY b, id) AS place FROM p)
SELECT key, r.id, CAST(list_min(list_transform(parts, lambda x: levenshtein(q, {NORM.format("x")}))) AS BIGINT) AS distance, place FROM r JOIN t ON t.id = r.id WHERE place <= 3"""

ORACLES = {
    "sku_normalize": f"WITH {CAT} SELECT id, {NORM.format('sku')} AS norm, regexp_replace(sku, '[^0-9]', '', 'g') AS digits, {NORM.format('sku')} || '|' || {NORM.format('sku')} || 'F' AS keys FROM cat",
    "name_normalize": f"WITH {CAT}, f AS (SELECT id, lower(name || ' / ' || p_type) AS n FROM cat) SELECT id, regexp_replace(n, '{PUNCT}', '', 'g') AS norm, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(n, '{PUNCT}'), lambda t: t <> ''))), '|') AS tokens FROM f",
    "size_alias": "SELECT p_partkey AS id, list_extract(['XXL', 'XXXL', 'OS', 'OS', 'M', 'XL'], p_size % 6 + 1) AS size FROM part",
    "to_int_parse": "WITH a AS (SELECT l_partkey, CAST(sum(round(l_extendedprice * 100)) AS BIGINT) AS c FROM lineitem GROUP BY 1), q AS (SELECT l_partkey, CASE WHEN c % 7 = 0 OR c % 5 = 0 THEN NULL ELSE c END AS quantity FROM a) SELECT l_partkey, quantity, CASE WHEN quantity IS NULL OR quantity % 3 > 0 THEN 'instock' ELSE 'outofstock' END AS availability FROM q",
    "forward_fill": "SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS filled FROM events",
    "consecutive_dedup": "SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE p IS NULL OR p <> event_type",
    "occurrence_islands": "WITH a AS (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 0 ELSE 1 END AS s FROM events), b AS (SELECT *, CAST(sum(s) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS BIGINT) AS block, CAST(sum(s) OVER (PARTITION BY user_id, event_type) AS BIGINT) AS blocks FROM a) SELECT event_id, CASE WHEN blocks > 1 THEN event_type || '#' || block ELSE event_type END AS occurrence, block, blocks FROM b",
    "block_split": "WITH a AS (SELECT event_id, user_id, CASE WHEN event_id % 5 <= lag(event_id % 5) OVER w OR event_id * 10 - lag(event_id * 10) OVER w > 9000 THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT event_id, CAST(sum(c) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) + 1 AS part FROM a",
    "first_wins_index": f"SELECT regexp_replace(lower(p_name), '{PUNCT}', '', 'g') AS key, min(p_partkey) AS id FROM part GROUP BY 1",
    "rule_cascade": f"""WITH {CAT}, {ROWS},
tried AS (SELECT ord, unnest([0, 1, 2, 3, 4, 5]) AS prio, unnest([source, '*', source, '*', source, '*']) AS s, unnest([category, category, '*', '*', category, '*']) AS c, product FROM src),
ruled AS (SELECT t.ord, arg_min(r.parent, t.prio) AS parent FROM tried t JOIN rules r ON r.source = t.s AND r.category = t.c AND r.product = t.product GROUP BY 1),
idx AS (SELECT k, min(id) AS id FROM (SELECT id, unnest(ks) AS k FROM (SELECT id, {_keys("ks", "sku")} FROM cat)) GROUP BY 1),
r1 AS (SELECT ruled.ord, coalesce(a.id, b.id) AS id FROM ruled LEFT JOIN idx a ON a.k = {NORM.format("parent")} LEFT JOIN idx b ON b.k = rtrim({NORM.format("parent")}, 'F') WHERE parent <> ''),
r2 AS (SELECT ord, arg_min(id, k) AS id FROM (SELECT ord, unnest(ks) AS k FROM (SELECT ord, {_keys("ks", "product")} FROM src WHERE ord NOT IN (SELECT ord FROM r1))) JOIN idx USING (k) GROUP BY 1),
names AS (SELECT regexp_replace(lower(name), '{PUNCT}', '', 'g') AS n, min(id) AS id FROM cat GROUP BY 1),
r3 AS (SELECT ord, id FROM src JOIN names ON n = regexp_replace(lower(product), '{PUNCT}', '', 'g') WHERE ord NOT IN (SELECT ord FROM r1 UNION ALL SELECT ord FROM r2)),
tn AS (SELECT name, min(id) AS id, list_distinct(list_filter(regexp_split_to_array(lower(name), '{PUNCT}'), lambda t: t <> '')) AS ts FROM cat GROUP BY name),
tp AS (SELECT DISTINCT product, list_distinct(list_filter(regexp_split_to_array(lower(product), '{PUNCT}'), lambda t: t <> '')) AS ts FROM src),
sc AS (SELECT product, id, len(list_intersect(tp.ts, tn.ts)) / len(list_distinct(list_concat(tp.ts, tn.ts))) AS score FROM tp JOIN tn ON len(tp.ts) >= 2 AND len(tn.ts) >= 2),
bp AS (SELECT product, arg_max(struct_pack(id := id, score := score), struct_pack(score := score, o := -id)) AS b FROM sc WHERE score >= 0.86 GROUP BY 1),
r4 AS (SELECT ord, b.id AS id, b.score AS score FROM src JOIN bp USING (product) WHERE ord NOT IN (SELECT ord FROM r1 UNION ALL SELECT ord FROM r2 UNION ALL SELECT ord FROM r3))
SELECT ord, id AS product_id, CASE WHEN id IS NULL THEN '{match.RULE_MISSING}' ELSE '{match.RULE}' END AS method FROM r1 UNION ALL SELECT ord, id, '{match.SKU}' FROM r2 UNION ALL SELECT ord, id, '{match.NAME}' FROM r3
UNION ALL SELECT ord, id, format('名称相似度 {{:.2f}}', score) FROM r4 UNION ALL SELECT ord, NULL, '{match.NONE}' FROM src WHERE ord NOT IN (SELECT ord FROM r1 UNION ALL SELECT ord FROM r2 UNION ALL SELECT ord FROM r3 UNION ALL SELECT ord FROM r4)""",
    "fuzzy_name_top1": f"""WITH t AS (SELECT p_partkey AS id, list_distinct(list_filter(regexp_split_to_array(lower(p_brand || ' ' || p_type || ' ' || p_name), '{PUNCT}'), lambda t: t <> '')) AS ts FROM part),
u AS (SELECT id, list_distinct(list_append(ts, 'new')) AS ts FROM t),
sc AS (SELECT a.id AS ord, b.id, len(list_intersect(a.ts, b.ts)) / len(list_distinct(list_concat(a.ts, b.ts))) AS score FROM u a JOIN t b ON len(a.ts) >= 2 AND len(b.ts) >= 2)
SELECT ord, arg_max(id, struct_pack(s := score, o := -id)) AS product_id FROM sc WHERE score >= 0.6 GROUP BY 1""",
    "fuzzy_name_every": f"""WITH t AS (SELECT p_partkey AS id, list_distinct(list_filter(regexp_split_to_array(lower(p_brand || ' ' || p_type || ' ' || p_name), '{PUNCT}'), lambda t: t <> '')) AS ts FROM part),
sc AS (SELECT a.id AS ord, b.id, len(list_intersect(a.ts, b.ts)) / len(list_distinct(list_concat(a.ts, b.ts))) AS score FROM t a JOIN t b ON a.id <> b.id AND len(a.ts) >= 2 AND len(b.ts) >= 2)
SELECT ord, arg_max(id, struct_pack(s := score, o := -id)) AS product_id FROM sc WHERE score >= 0.6 GROUP BY 1""",
    "nearest_sku_topk": NEAREST.format(sku="CASE id % 7 WHEN 0 THEN sku || 'F' WHEN 1 THEN sku || ' SET' || id ELSE sku END"),
    "nearest_sku_every": NEAREST.format(sku="sku"),
    "reconcile_diff": f"WITH {STOCK} SELECT ord, status, qty_delta, action, note FROM diffs",
    "reconcile_summary": f"WITH {STOCK} SELECT count(*) AS total, count(*) FILTER (status = '{reconcile.CHANGED}') AS changed, count(*) FILTER (status = '{reconcile.SAME}') AS same, count(*) FILTER (status = '{reconcile.NO_PRODUCT}') AS no_product, count(*) FILTER (status = '{reconcile.NO_VARIATION}') AS no_variation, count(*) FILTER (status = '{reconcile.UNMATCHED}') AS unmatched, count(*) FILTER (status = '{reconcile.NEED_QTY}') AS need_qty, count(DISTINCT product_id) AS products, count(DISTINCT CASE WHEN status = '{reconcile.CHANGED}' THEN product_id END) AS changed_products FROM diffs",
    "update_payload": f"WITH {STOCK} SELECT ord, manage_stock, stock_quantity, stock_status FROM diffs WHERE status = '{reconcile.CHANGED}' AND source IN ('SP5', 'ALO') AND product LIKE 'p1%'",
    "collapsed_updates": f"WITH {STOCK} SELECT product_id, variation_id % 3 AS variation_id, count(*) AS writes, arg_max(manage_stock, ord) FILTER (manage_stock IS NOT NULL) AS manage_stock, arg_max(stock_quantity, ord) FILTER (stock_quantity IS NOT NULL) AS stock_quantity, arg_max(stock_status, ord) AS stock_status FROM diffs WHERE status = '{reconcile.CHANGED}' GROUP BY 1, 2",
    "manual_by_product": f"WITH {STOCK} SELECT source, product, count(*) AS n, string_agg(size, '、' ORDER BY ord) AS items, arg_min(method, ord) AS first_note FROM diffs WHERE status NOT IN ('{reconcile.CHANGED}', '{reconcile.SAME}') GROUP BY 1, 2",
    "change_by_product": f"WITH {STOCK} SELECT source, product, product_id, count(*) AS n, string_agg(concat_ws(':', size, CAST(qty_delta AS VARCHAR)), '、' ORDER BY ord) AS items, arg_min(action, ord) AS first_note FROM diffs WHERE status = '{reconcile.CHANGED}' GROUP BY 1, 2, 3",
    "duplicate_keys": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1",
    "quality_histogram": "SELECT event_type, count(*) FILTER (value < 1) AS blank, count(*) FILTER (value >= 60) AS marked, count(*) FILTER (value >= 1 AND value < 60) AS ambiguous FROM events GROUP BY 1",
    "source_stats": f"WITH {STOCK} SELECT source, count(*) AS n_rows, count(DISTINCT product) AS products FROM stock GROUP BY 1",
    "orphan_skus": f"WITH {CAT} SELECT id, sku FROM cat WHERE id NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)",
}


def oracle_sql() -> dict[str, str]:
    from stocktide.plans import inventory

    return {**ORACLES, **inventory.ORACLES}
