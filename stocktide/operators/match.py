"""Source rows to catalogue products: curated rules, then keys, names and similarity, each on what is left.

Every strategy is an equi-join (similarity too, through signatures of tokens). The exact ones are tried over all rows at once, and the
first that hits counts; similarity sees only the names of rows that are left. Sides grow with the catalogue and are never broadcast, see `met`.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stocktide.functions import text
from stocktide.storage import stored

# Labels of how a product was found.
RULE, RULE_MISSING, SKU, COMBO, NAME, NONE = "人工映射", "映射的 SKU 在本店不存在", "SKU 相同", "组合商品 SKU 命中", "商品名相同", "未匹配"
TO_FILL = "⚠ 需要人工填写 parent_sku"
SIGNATURES = 24


def met(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join that shuffles both sides. The planner takes their sizes from compressed files, and those of generated rows (keys, signatures,
    shortened texts) from the rows they were made of, so that it would broadcast far too much through the driver."""
    return left.join(right.hint("merge"), on, how)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """Few rows of which many will be made, dealt to as many tasks as shuffles have."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def rule_lookup(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """`parent_sku` and `size_map` of the first rule key present, out of six from exact to wildcard; null if none is.

    rows: ord, source, category, product, occurrence. rules: source, category, product, parent_sku, size_map, ord (last of equal keys counts).
    """
    if "size_map" not in rules.columns:
        rules = rules.withColumn("size_map", F.lit(""))
    tidy = lambda c: text.strip(F.coalesce(F.col(c), F.lit("")))
    category = F.when(tidy("category") == "", "*").otherwise(tidy("category"))
    value = F.struct(tidy("parent_sku").alias("parent_sku"), tidy("size_map").alias("size_map"))
    last = rules.groupBy(tidy("source").alias("source"), category.alias("category"), tidy("product").alias("product")).agg(F.max_by(value, "ord").alias("r")).where("product <> ''")
    s, c, k, p, any_ = (F.col("source"), F.col("category"), F.col("occurrence"), F.col("product"), F.lit("*"))
    keys = [(s, c, k), (any_, c, k), (s, any_, k), (any_, any_, k), (s, c, p), (any_, any_, p)]
    options = F.array(*[F.struct(F.lit(i).alias("prio"), a.alias("rs"), b.alias("rc"), d.alias("rp")) for i, (a, b, d) in enumerate(keys)])
    tried = rows.select("ord", F.explode(options).alias("o")).select("ord", "o.*")
    found = met(tried, last, (F.col("rs") == last["source"]) & (F.col("rc") == last["category"]) & (F.col("rp") == last["product"]))
    best = found.groupBy("ord").agg(F.min_by("r", "prio").alias("rule"))
    return met(rows, best, "ord", "left").withColumn("parent_sku", F.col("rule.parent_sku")).withColumn("size_map", F.col("rule.size_map")).drop("rule")


def sku_index(products: DataFrame) -> DataFrame:
    keyed = products.select(F.explode(text.sku_match_keys(F.col("sku"))).alias("key"), "id", "ord")
    return keyed.groupBy("key").agg(F.min_by("id", "ord").alias("id"))


def combo_index(products: DataFrame) -> DataFrame:
    parts = text.split_sku_field(F.col("sku"))
    keyed = products.where(F.size(parts) > 1).select(F.explode(parts).alias("part"), "id", "ord").select(F.explode(text.sku_match_keys(F.col("part"))).alias("key"), "id", "ord")
    return keyed.groupBy("key").agg(F.min_by("id", "ord").alias("id"))


def by_rule_sku(rows: DataFrame, products: DataFrame) -> DataFrame:
    """Rows with a filled rule: the product of that SKU as it stands, then without trailing Fs; a miss is final."""
    index = sku_index(products)
    plain = index.select(F.col("key").alias("k1"), F.col("id").alias("id1"))
    bare = index.select(F.col("key").alias("k2"), F.col("id").alias("id2"))
    ruled = rows.where(F.coalesce("parent_sku", F.lit("")) != "").withColumn("k1", text.normalize_sku(F.col("parent_sku"))).withColumn("k2", text.without_trailing_f(F.col("parent_sku")))
    hit = met(met(ruled, plain, "k1", "left"), bare, "k2", "left").withColumn("product_id", F.coalesce("id1", "id2"))
    return hit.select("ord", "product_id", F.when(F.col("product_id").isNull(), RULE_MISSING).otherwise(RULE).alias("method"))


def by_keys(rows: DataFrame, index: DataFrame, method: str) -> DataFrame:
    """First of a row's sorted keys that the index has."""
    keyed = rows.select("ord", F.explode(text.sku_match_keys(F.col("product"))).alias("key"))
    return met(keyed, index, "key").groupBy("ord").agg(F.min_by("id", "key").alias("product_id")).withColumn("method", F.lit(method))


def by_name(rows: DataFrame, products: DataFrame) -> DataFrame:
    index = products.select(text.normalize_name(F.col("name")).alias("key"), "id", "ord").where("key <> ''").groupBy("key").agg(F.min_by("id", "ord").alias("product_id"))
    return met(rows.select("ord", text.normalize_name(F.col("product")).alias("key")), index, "key").select("ord", "product_id", F.lit(NAME).alias("method"))


def signature_plan(threshold: float, left_sizes: list[int], right_sizes: list[int], most: int = SIGNATURES) -> list[tuple]:
    """For every two sizes n, m of token sets that can reach the similarity: n, m, how many tokens a signature has, and which places of
    the sets, put in one order of tokens, make up the signatures of either.

    Sets of that similarity share k >= (n + m) * threshold / (1 + threshold) tokens. Of these, the first s in order lie among the first
    n - k + s tokens of the one and m - k + s of the other: sets that are alike have one of the choices of s tokens from there in common. More
    tokens make rarer signatures, but more of them: s is the largest for which neither set has over `most`.
    """
    plan = []
    for n in left_sizes:
        for m in right_sizes:
            k = math.ceil((n + m) * threshold / (1 + threshold) - 1e-9)
            if k > min(n, m):
                continue
            s = max(x for x in range(1, k + 1) if x == 1 or max(math.comb(n - k + x, x), math.comb(m - k + x, x)) <= most)
            choices = lambda size, s=s, k=k: [list(c) for c in combinations(range(size - k + s), s)]
            plan.append((n, m, s, choices(n), choices(m)))
    return plan


def candidates(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """Pairs of rows whose token sets may reach the similarity, each once. Both sides have a column of distinct tokens: `lt`, `rt`.

    Signatures hold both sizes and several tokens, the rarest ones first, so that sets of frequent tokens don't meet in full.
    """
    seen = left.select(F.explode("lt").alias("token")).unionAll(right.select(F.explode("rt").alias("token"))).groupBy("token").agg(F.count("*").alias("df"))

    def ordered(df: DataFrame, tokens: str) -> DataFrame:
        ranked = met(df.select(tokens).distinct().select(tokens, F.explode(tokens).alias("token")), seen, "token").groupBy(tokens).agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("r"))
        return stored(met(df, ranked.select(tokens, F.col("r.token").alias("r")), tokens).withColumn("n", F.size(tokens)), "ranked")

    left, right = ordered(left, "lt"), ordered(right, "rt")
    sizes = [sorted(r["n"] for r in df.select("n").distinct().collect()) for df in (left, right)]  # a row for each size of a name
    plan = left.sparkSession.createDataFrame(signature_plan(threshold, *sizes), "ln int, rn int, s int, lc array<array<int>>, rc array<array<int>>")

    def signed(df: DataFrame, side: str) -> DataFrame:
        one = lambda places: F.xxhash64("ln", "rn", F.transform(places, lambda i: F.get("r", i)))
        planned = df.join(plan.select("ln", "rn", "s", f"{side}c"), F.col("n") == F.col(f"{side}n"))
        return planned.select(*[c for c in df.columns if c not in ("r", "n")], F.col("r").alias(f"{side}r"), "ln", "rn", "s", F.explode(F.transform(f"{side}c", one)).alias("signature"))

    both = met(signed(left, "l"), signed(right, "r").drop("ln", "rn", "s"), "signature")
    first = F.xxhash64("ln", "rn", F.slice(F.array_intersect("lr", "rr"), F.lit(1), F.col("s")))
    return both.where(F.col("signature") == first).drop("signature", "lr", "rr", "ln", "rn", "s")


def by_similarity(rows: DataFrame, products: DataFrame, threshold: float = 0.86, others: bool = False) -> DataFrame:
    """Best Jaccard similarity of name tokens, the earliest product on ties; names of one token never match.

    Names of the same tokens are one on either side. With `others`, a row's ord is a product's id, which the row can't have as its match.
    """
    side = lambda df, col, out: df.withColumn(out, F.array_sort(text.name_tokens(F.col(col)))).where(F.size(out) >= 2)
    left = stored(side(rows.select("product").distinct(), "product", "lt"), "names")
    ranked = side(products.select("name", F.struct(F.col("ord").alias("first"), "id").alias("f")), "name", "rt")
    nth = F.row_number().over(Window.partitionBy("rt").orderBy("f"))
    right = ranked.withColumn("nth", nth).where(F.col("nth") <= (2 if others else 1)).groupBy("rt").agg(F.collect_list("f").alias("f"))
    k = F.size(F.array_intersect("lt", "rt"))
    scored = candidates(left.select("lt").distinct(), right, threshold).select("lt", (k / (F.size("lt") + F.size("rt") - k)).alias("score"), "f").where(F.col("score") >= threshold)
    scored = scored.select("lt", "score", F.explode("f").alias("f")).select("lt", F.struct((-F.col("score")).alias("s"), "f.first", "f.id", "score").alias("b"))
    named = met(rows.select("ord", "product"), left, "product")
    if not others:
        hits = met(named, scored.groupBy("lt").agg(F.min("b").alias("b")), "lt")
    else:
        # At most one entry is the row itself: the better two are enough.
        place = F.row_number().over(Window.partitionBy("lt").orderBy("b"))
        two = scored.withColumn("place", place).where("place <= 2").groupBy("lt").agg(F.array_sort(F.collect_list("b")).alias("two"))
        hits = met(named, two, "lt").withColumn("b", F.get(F.filter("two", lambda b: b["id"] != F.col("ord")), 0)).where("b is not null")
    return hits.select("ord", F.col("b.id").alias("product_id"), F.format_string("名称相似度 %.2f", "b.score").alias("method"))


def match_products(rows: DataFrame, products: DataFrame, rules: DataFrame | None = None, combos: bool = False, threshold: float = 0.86) -> DataFrame:
    """ord, product_id, method of every row.

    All exact strategies are tried at once and the first that hits is kept; similarity sees only the names of the rows that are left.
    """
    if rules is not None:
        rows = rule_lookup(rows, rules)
    steps = [by_rule_sku(rows, products)] if rules is not None else []
    steps.append(by_keys(rows, sku_index(products), SKU))
    steps += [by_keys(rows, combo_index(products), COMBO)] if combos else []
    steps.append(by_name(rows, products))
    hits = None
    for prio, hit in enumerate(steps):
        ranked = hit.select("ord", F.struct(F.lit(prio).alias("prio"), "product_id", "method").alias("hit"))
        hits = ranked if hits is None else hits.unionAll(ranked)
    first = hits.groupBy("ord").agg(F.min_by("hit", "hit.prio").alias("hit"))
    joined = met(rows.select("ord", "product"), first, "ord", "left")
    alike = by_similarity(joined.where("hit is null").select(F.col("product").alias("ord"), "product").distinct(), products, threshold)
    alike = alike.select(F.col("ord").alias("product"), F.struct("product_id", "method").alias("alike"))
    out = met(joined, alike, "product", "left")
    chosen = F.when(F.col("hit").isNotNull(), F.col("hit.product_id")).otherwise(F.col("alike.product_id"))
    method = F.coalesce(F.col("hit.method"), F.col("alike.method"), F.lit(NONE))
    return out.select("ord", chosen.alias("product_id"), method.alias("method"))


def find_variation(rows: DataFrame, variations: DataFrame) -> DataFrame:
    """rows (ord, product_id, size, and size_map if sizes are to be translated) with the first variation any of whose options is that
    size; null if none is."""
    options = variations.select("product_id", F.explode("options").alias("option"), F.col("id").alias("variation_id"), F.col("ord").alias("vord")).withColumn("key", text.normalize_size(F.col("option")))
    first = options.groupBy("product_id", "key").agg(F.min_by("variation_id", "vord").alias("variation_id"))
    size = text.normalize_size(F.col("size"))
    if "size_map" in rows.columns:
        translated = F.try_element_at(text.size_map(F.col("size_map")), size)
        size = F.when(F.coalesce("size_map", F.lit("")) == "", size).otherwise(text.normalize_size(F.coalesce(translated, F.col("size"))))
    return met(rows.withColumn("key", size), first, ["product_id", "key"], "left").drop("key")


def suggestions(rows: DataFrame, products: DataFrame, rules: DataFrame | None = None, combos: bool = False, threshold: float = 0.86) -> DataFrame:
    """A rule for each product of the sources: the catalogue's identifier if one is found, else a request to fill it in.

    rows: ord, source, category, product, occurrence. The first row of each (source, category, occurrence) speaks for it.
    """
    first = rows.groupBy("source", "category", "occurrence").agg(F.min_by(F.struct("ord", "product"), "ord").alias("f")).select("source", "category", "occurrence", "f.*")
    matched = match_products(first, products, rules, combos, threshold)
    given = rule_lookup(first, rules).select("ord", "parent_sku") if rules is not None else first.select("ord", F.lit("").alias("parent_sku"))
    out = met(met(met(first, matched, "ord"), given, "ord"), products.select(F.col("id").alias("product_id"), "sku"), "product_id", "left")
    sku = F.when(F.coalesce("sku", F.lit("")) != "", F.col("sku")).when(F.col("method").isin(RULE, RULE_MISSING), F.coalesce("parent_sku", F.lit(""))).otherwise("")
    note = F.when(F.col("product_id").isNotNull(), F.col("method")).otherwise(TO_FILL)
    return out.select("ord", "source", "category", F.col("occurrence").alias("source_product"), sku.alias("parent_sku"), F.lit("").alias("size_map"), note.alias("note"))


LONG_KEY = 40
REACHES = (3, 4, 8, 16)
DELETED, SHORT_REST, SMALL_GROUP = 4, 14, 64


def _shortened(s: Column, edits: int) -> Column:
    """Hashes of a text and of all texts that up to `edits` deletions make of it: two texts within so many edits share one."""
    without = lambda t: F.when(F.length(t) > 0, F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))).otherwise(F.array(t))
    every, layer = [F.array(s)], F.array(s)
    for _ in range(edits):
        layer = F.array_distinct(F.flatten(F.transform(layer, without)))
        every.append(layer)
    return F.array_distinct(F.transform(F.concat(*every), lambda t: F.xxhash64(t)))


def nearest_sku(wanted: DataFrame, products: DataFrame, max_distance: int = 2, limit: int = 3) -> DataFrame:
    """wanted (key): up to `limit` products by edit distance to any identifier of theirs, or of the same digits; nearer ones first, then
    those whose own identifier it is before parts of combined ones, then those of the same digits, then by catalogue order.

    Gives key, id, sku, combo, distance (to the nearest part of the product's identifier) and place. Pairs within the distance share a
    text that deletions make of both; identifiers of over LONG_KEY characters share a piece that edits left whole. Equal digits
    are looked up only for keys with fewer than `limit` products so far: others rank behind. See `_same_digits`.
    """
    pool = sku_index(products).select("key", "id", F.lit(0).alias("pool")).unionAll(combo_index(products).select("key", "id", F.lit(1).alias("pool")))
    other = stored(pool.withColumnRenamed("key", "sku_key").where("sku_key <> ''"), "pool")
    mine = wanted.select("key").distinct().withColumn("k", text.normalize_sku(F.col("key"))).where("k <> ''")
    ks, skus = stored(mine.select("k").distinct(), "keys"), other.select("sku_key").distinct()
    dealt = spread(ks, "k")
    short = dealt.where(F.length("k") <= LONG_KEY).select("k", F.explode(_shortened(F.col("k"), max_distance)).alias("h"))
    skus = spread(skus, "sku_key")
    short = met(short, skus.where(F.length("sku_key") <= LONG_KEY + max_distance).select("sku_key", F.explode(_shortened(F.col("sku_key"), max_distance)).alias("h")), "h").select("k", "sku_key").distinct()
    near = short.unionAll(_by_pieces(dealt.where(F.length("k") > LONG_KEY), skus.where(F.length("sku_key") > LONG_KEY - max_distance), max_distance))
    near = near.withColumn("d", F.levenshtein("k", "sku_key", max_distance)).where(F.col("d").between(0, max_distance))
    near = stored(met(near, other, "sku_key").select("k", "sku_key", "id", "pool", "d"), "near")
    first = products.select("id", F.col("ord").alias("o"), F.col("sku").alias("sku"))
    every = met(near.unionByName(_same_digits(ks, other, near, limit)).distinct(), first, "id")
    flag = F.when((_digits("k") != "") & (_digits("k") == _digits("sku_key")), 0).otherwise(1)
    best = every.groupBy("k", "id").agg(F.min(F.struct("d", "pool", flag.alias("flag"), "o")).alias("b"), F.first("sku").alias("sku"))
    place = F.row_number().over(Window.partitionBy("k").orderBy("b"))
    top = best.withColumn("place", place).where(F.col("place") <= limit)
    distance = F.array_min(F.transform(text.split_sku_field(F.col("sku")), lambda t: F.levenshtein(F.col("k"), text.normalize_sku(t))))
    return met(mine, top, "k").select("key", "id", "sku", (F.col("b.pool") == 1).alias("combo"), distance.alias("distance"), "place")


def _digits(c: str) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _same_digits(ks: DataFrame, other: DataFrame, near: DataFrame, limit: int) -> DataFrame:
    """(k, sku_key, id, pool, d): the identifiers of a key's digits that may be among its `limit` nearest.

    A key is compared with its whole group where that is small. In larger groups the distance that is searched grows: keys that have
    found enough products, or all that their group has, are through, for what is farther off ranks behind. Beginnings and ends that a
    whole group has in common don't count for distances and are left out; short rests meet by the texts that deletions make of
    them, longer ones by pieces that edits leave whole. Only keys that then still are without enough products, and so far from
    nearly all others, are compared with their whole group.
    """
    pool = other.withColumn("digits", _digits("sku_key")).where("digits <> ''")
    in_group = pool.groupBy("digits").agg(F.count_distinct("id").alias("has"))
    asked = ks.withColumn("digits", _digits("k")).where("digits <> ''")
    asked = met(asked, in_group, "digits")

    def open_(found: DataFrame) -> DataFrame:
        """Keys that still need products."""
        own = found.groupBy("k").agg(F.count_distinct("id").alias("n"), F.count_distinct(F.when(_digits("k") == _digits("sku_key"), F.col("id"))).alias("same"))
        kept = met(asked, own, "k", "left").where((F.coalesce("n", F.lit(0)) < limit) & (F.coalesce("same", F.lit(0)) < F.col("has")))
        return stored(kept.select("k", "digits", "has"), "open")

    def whole(left: DataFrame) -> DataFrame:
        return met(left, pool, "digits").select("k", "sku_key", "id", "pool", F.levenshtein("k", "sku_key").alias("d"))

    left = open_(near)
    found, left = whole(left.where(F.col("has") <= SMALL_GROUP)), left.where(F.col("has") > SMALL_GROUP)
    if left.isEmpty():
        return found
    every = left.select("digits", F.col("k").alias("s")).unionAll(met(pool, left.select("digits").distinct(), "digits", "left_semi").select("digits", F.col("sku_key").alias("s"))).distinct()
    back = F.reverse("s")
    ends = every.groupBy("digits").agg(F.min("s").alias("a"), F.max("s").alias("b"), F.min(back).alias("y"), F.max(back).alias("z"), F.min(F.length("s")).alias("least"))
    common = lambda x, y: f"size(filter(sequence(0, least), i -> i > 0 AND substring({x}, 1, i) = substring({y}, 1, i)))"
    ends = ends.select("digits", "least", F.expr(common("a", "b")).alias("head"), F.expr(common("y", "z")).alias("tail")).withColumn("tail", F.least("tail", F.col("least") - F.col("head")))
    rest = met(every, ends, "digits").select("digits", "s", F.substring("s", F.col("head") + 1, F.length("s") - F.col("head") - F.col("tail")).alias("rest"))
    rest = stored(rest, "rests")
    for reach in REACHES:
        mine = met(left, rest.select("digits", F.col("s").alias("k"), F.col("rest").alias("k_rest")), ["digits", "k"])
        others = met(pool, rest.select("digits", F.col("s").alias("sku_key"), F.col("rest").alias("sku_rest")), ["digits", "sku_key"]).select("digits", "sku_rest").distinct()
        if reach <= DELETED:
            brief = lambda c: F.length(c) <= SHORT_REST + reach  # noqa: B023, E731
            tried = mine.where(F.length("k_rest") <= SHORT_REST).select("digits", "k_rest").distinct()
            shortened = lambda df, c: spread(df, "digits", c).select("digits", c, F.explode(_shortened(F.col(c), reach)).alias("h"))  # noqa: B023, E731
            pairs = met(shortened(tried, "k_rest"), shortened(others.where(brief("sku_rest")), "sku_rest"), ["digits", "h"]).select("digits", "k_rest", "sku_rest").distinct()
        else:
            tried = mine.where(F.length("k_rest") >= 2 * (reach + 1)).select("digits", F.col("k_rest").alias("k")).distinct()
            pairs = _by_pieces(tried, others.withColumnRenamed("sku_rest", "sku_key"), reach, ["digits"]).withColumnsRenamed({"k": "k_rest", "sku_key": "sku_rest"})
        if tried.isEmpty():
            continue
        close = pairs.withColumn("d", F.levenshtein("k_rest", "sku_rest", reach)).where(F.col("d").between(0, reach))
        named = met(met(close, mine, ["digits", "k_rest"]), rest.select("digits", F.col("s").alias("sku_key"), F.col("rest").alias("sku_rest")), ["digits", "sku_rest"])
        found = found.unionByName(stored(met(named, pool, ["digits", "sku_key"]).select("k", "sku_key", "id", "pool", "d"), "same"))
        left = open_(near.unionByName(found)).where(F.col("has") > SMALL_GROUP)
        if left.isEmpty():
            return found
    return found.unionByName(whole(left))


def _by_pieces(ks: DataFrame, skus: DataFrame, max_distance: int, equal: list[str] | None = None) -> DataFrame:
    """Of max_distance + 1 pieces of a key, one is left whole by that many edits, and it stands within max_distance of its place in the
    other. Both sides may have columns that have to be equal."""
    pieces, equal = max_distance + 1, equal or []
    numbers = f"sequence(0, {pieces - 1})"
    cut = lambda col, n, i, shift: f"substring({col}, 1 + {i} * {n} div {pieces} + {shift}, ({i} + 1) * {n} div {pieces} - {i} * {n} div {pieces})"
    whole = ks.select("k", *equal, F.expr(f"explode(transform({numbers}, i -> struct(i AS i, length(k) AS n, {cut('k', 'length(k)', 'i', '0')} AS piece)))").alias("p")).select("k", *equal, "p.*")
    reach = f"sequence(-{max_distance}, {max_distance})"
    spots = f"flatten(flatten(transform({reach}, e -> transform({numbers}, i -> transform({reach}, d -> struct(i AS i, length(sku_key) + e AS n, CASE WHEN 1 + i * (length(sku_key) + e) div {pieces} + d >= 1 THEN {cut('sku_key', '(length(sku_key) + e)', 'i', 'd')} END AS piece))))))"
    pool = skus.select("sku_key", *equal).distinct().select("sku_key", *equal, F.expr(f"explode(array_distinct({spots}))").alias("p")).select("sku_key", *equal, "p.*").where("piece is not null")
    return met(whole, pool, [*equal, "i", "n", "piece"]).select(*equal, "k", "sku_key").distinct()
