"""Queries in which every branch of an operator occurs in the given tables: whole profiles, cascades, retrieval, dashboards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rosterlake.functions import records as R
from rosterlake.operators import filters, matching, reports, resolve, retrieval, writing
from rosterlake.operators.filters import Field
from rosterlake.plans.queries import HELD, TRIGRAMS, held_parts, query
from rosterlake.sources import files

SIMILARITY = "len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g)))"


@query("""
WITH tok AS (SELECT doc_id, lang, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS ws FROM documents),
st AS (SELECT count(*) AS docs, avg(len(ws)) AS mean FROM tok), tf AS (SELECT doc_id, lang, len(ws) AS n, unnest(ws) AS token FROM tok), c AS (SELECT doc_id, lang, n, token, count(*) AS tf FROM tf GROUP BY ALL),
qt AS (SELECT item_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))) AS token FROM benchmark), df AS (SELECT token, count(*) AS df FROM c GROUP BY 1),
s AS (SELECT item_id AS query_id, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score FROM qt JOIN df USING (token) JOIN c USING (token), st WHERE lang <> 'fr' GROUP BY 1, 2),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM s QUALIFY r <= 10),
v AS (SELECT item_id AS query_id, d.doc_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM benchmark JOIN embeddings q ON q.vec_id = item_id, documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE lang <> 'fr'),
a AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM v QUALIFY r <= 10),
f AS (SELECT coalesce(a.query_id, b.query_id) AS query_id, coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(0.5 / (60 + a.r), 0) + coalesce(0.5 / (60 + b.r), 0) AS score, a.r AS vector_rank, b.r AS text_rank
  FROM a FULL JOIN b ON a.query_id = b.query_id AND a.doc_id = b.doc_id)
SELECT query_id, doc_id, round(score, 6)::DOUBLE AS score, vector_rank, text_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 5""")
def hybrid_search(t):
    """Texts and vectors of all documents, without those in French: top 10 of either search, fused and cut to 5."""
    vectors = t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    asked = t("benchmark").join(vectors.select(F.col("doc_id").alias("item_id"), F.col("embedding").alias("asked")), "item_id", "left")
    asked = asked.select(F.col("item_id").alias("query_id"), F.col("text").alias("q"), "asked")
    return retrieval.hybrid(t("documents"), "doc_id", "text", "embedding", asked, "query_id", "q", "asked", 5, weights=(0.5, 0.5), where=F.col("lang") != "fr", vectors=vectors)


def item_text():
    name = F.col("p_name")
    word = lambda i: F.split_part(name, F.lit(" "), F.lit(i))
    return (
        F.when(F.col("p_size") <= 10, F.upper(name))
        .when(F.col("p_size") <= 20, F.concat(name, F.lit(" xl")))
        .when(F.col("p_size") <= 30, F.concat(word(1), F.lit(" "), F.substring(word(2), 1, 1), word(2)))
        .when(F.col("p_size") <= 40, F.concat(F.left(name, F.length(name) - 1), F.lit("qq")))
        .otherwise(F.concat(F.lit("zz"), F.reverse(name)))
    )


@query(f"""
WITH p AS (SELECT *, CASE WHEN p_size <= 10 THEN upper(p_name) WHEN p_size <= 20 THEN p_name || ' xl' WHEN p_size <= 30 THEN split_part(p_name, ' ', 1) || ' ' || left(split_part(p_name, ' ', 2), 1) || split_part(p_name, ' ', 2)
  WHEN p_size <= 40 THEN left(p_name, length(p_name) - 1) || 'qq' ELSE 'zz' || reverse(p_name) END AS item FROM part),
i AS (SELECT item, lower(trim(item)) AS plain, {TRIGRAMS.format('item')} AS g, min(p_partkey) AS k FROM p GROUP BY 1), n AS (SELECT p_name AS name, {TRIGRAMS.format('p_name')} AS g, min(p_partkey) AS k FROM part GROUP BY 1),
e AS (SELECT item, name, 'exact' AS method, 1.0 AS similarity FROM i JOIN n ON plain = name),
s AS (SELECT item, name, 'substring', 0.9 FROM i JOIN n ON contains(plain, name) OR contains(name, plain) WHERE item NOT IN (SELECT item FROM e) QUALIFY row_number() OVER (PARTITION BY item ORDER BY length(name) DESC, name) = 1),
r AS (SELECT item, name, CASE WHEN sim >= 0.75 THEN 'trigram' ELSE 'suggested' END, sim FROM (SELECT a.item, b.name, {SIMILARITY} AS sim FROM i a, n b WHERE item NOT IN (SELECT item FROM e UNION SELECT item FROM s))
  WHERE sim >= 0.6 QUALIFY row_number() OVER (PARTITION BY item ORDER BY sim DESC, name) = 1),
v AS (SELECT item, name, CASE WHEN c >= 0.85 THEN 'vector' ELSE 'vector_suggested' END, c FROM (
    SELECT item, name, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 6) AS c FROM i JOIN embeddings x ON x.vec_id = i.k, n JOIN embeddings y ON y.vec_id = n.k WHERE item NOT IN (SELECT item FROM e UNION SELECT item FROM s UNION SELECT item FROM r)
    QUALIFY row_number() OVER (PARTITION BY item ORDER BY c DESC, name) = 1) WHERE c >= 0.6)
SELECT item, m.name, coalesce(method, 'none') AS method, similarity::DOUBLE AS similarity FROM i LEFT JOIN (SELECT * FROM e UNION ALL SELECT * FROM s UNION ALL SELECT * FROM r UNION ALL SELECT * FROM v) m USING (item)""")
def full_cascade(t):
    """Names in capitals, extended, misspelt a little or more, or unlike: each tier gets its share of the items."""
    items = t("part").select("p_partkey", item_text().alias("item"), F.col("p_name").alias("name"))
    vectors = t("embeddings").select(F.col("vec_id").alias("k"), F.col("embedding").alias("vector"))
    of = lambda c: items.groupBy(c).agg(F.min("p_partkey").alias("k")).join(vectors, "k").select(c, "vector")
    return matching.cascade(items, "item", items, "name", vectors=(of("item"), of("name")))


@query(f"""
WITH r AS (SELECT p_partkey AS k, CASE WHEN p_size <= 15 THEN lower(p_type) || p_size || '@' || lower(p_brand) END AS email, CASE WHEN p_size > 10 AND p_size <= 30 THEN p_brand || '-' || p_size || left(p_name, 2) END AS phone, p_name || ' ' || p_brand AS name FROM part),
e AS (SELECT email, min(k) AS f FROM r GROUP BY 1), h AS (SELECT phone, min(k) AS f FROM r GROUP BY 1), n AS (SELECT name, min(k) AS f, {TRIGRAMS.format('name')} AS g FROM r GROUP BY 1),
m AS (SELECT a.name, b.f, {SIMILARITY} AS sim FROM n a, n b WHERE {SIMILARITY} >= 0.8),
x AS (SELECT k, f AS other, 1.0 AS score, 'email' AS reason, 1 AS turn FROM r JOIN e USING (email) WHERE f < k UNION ALL SELECT k, f, 0.95, 'phone', 2 FROM r JOIN h USING (phone) WHERE f < k UNION ALL SELECT k, f, sim, 'name', 3 FROM r JOIN m USING (name) WHERE f < k)
SELECT k AS p_partkey, other, score::DOUBLE AS score, reason FROM x QUALIFY row_number() OVER (PARTITION BY k ORDER BY turn, score DESC, other) = 1""")
def entity_resolution(t):
    """Parts as people: e-mail before phone before a similar name."""
    size = F.col("p_size")
    email = F.when(size <= 15, F.concat(F.lower("p_type"), size.cast("string"), F.lit("@"), F.lower("p_brand")))
    phone = F.when((size > 10) & (size <= 30), F.concat("p_brand", F.lit("-"), size.cast("string"), F.left("p_name", F.lit(2))))
    return resolve.find_duplicates(t("part"), "p_partkey", [("email", email, 1.0), ("phone", phone, 0.95)], F.concat_ws(" ", "p_name", "p_brand"))


CHILDREN = {
    "urgent": ("SELECT o_custkey AS c, o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderpriority = '1-URGENT'", "o_orderkey"),
    "open_orders": ("SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O'", "o_orderkey"),
    "returns": ("SELECT o_custkey, l_orderkey * 10 + l_linenumber, l_linestatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R'", "line"),
    "promos": (f"SELECT DISTINCT o_custkey, p_partkey, p_name FROM {HELD} WHERE p_type = 'PROMO'", "p_partkey"),
    "economy": (f"SELECT DISTINCT o_custkey, p_partkey, p_name FROM {HELD} WHERE p_type = 'ECONOMY'", "p_partkey"),
    "errors": ("SELECT user_id, event_id, event_type FROM events WHERE event_type = 'error'", "event_id"),
    "purchases": ("SELECT user_id, event_id, event_type FROM events WHERE event_type = 'purchase'", "event_id"),
    "documents": ("SELECT doc_id, doc_id, lang FROM documents", "doc_id"),
}


@query(
    "WITH " + ", ".join(f"{n}(c, k, v) AS ({sql})" for n, (sql, _) in CHILDREN.items())
    + " SELECT c_custkey, c_name, " + ", ".join(f"coalesce({n}.j, '[]') AS {n}" for n in CHILDREN)
    + " FROM customer " + " ".join(f"LEFT JOIN (SELECT c, to_json(list(struct_pack(k := k, v := v) ORDER BY k, v))::VARCHAR AS j FROM {n} GROUP BY 1) {n} ON {n}.c = c_custkey" for n in CHILDREN)
)
def full_profile(t):
    """Customers with eight child lists, each in its own order, empty where there are none."""
    orders, events, held = t("orders"), t("events"), held_parts(t)
    lines = t("lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    child = lambda df, c, k, v: df.select(F.col(c).alias("c_custkey"), (F.col(k) if isinstance(k, str) else k).cast("long").alias("k"), F.col(v).alias("v"))
    parts = lambda kind: child(held.where(F.col("p_type") == kind), "o_custkey", "p_partkey", "p_name").distinct()
    children = {
        "urgent": child(orders.where("o_orderpriority = '1-URGENT'"), "o_custkey", "o_orderkey", "o_orderstatus"),
        "open_orders": child(orders.where("o_orderstatus = 'O'"), "o_custkey", "o_orderkey", "o_orderpriority"),
        "returns": child(lines.where("l_returnflag = 'R'"), "o_custkey", F.col("l_orderkey") * 10 + F.col("l_linenumber"), "l_linestatus"),
        "promos": parts("PROMO"),
        "economy": parts("ECONOMY"),
        "errors": child(events.where("event_type = 'error'"), "user_id", "event_id", "event_type"),
        "purchases": child(events.where("event_type = 'purchase'"), "user_id", "event_id", "event_type"),
        "documents": t("documents").select(F.col("doc_id").alias("c_custkey"), F.col("doc_id").alias("k"), F.col("lang").alias("v")),
    }
    made = files.nest(t("customer").select("c_custkey", "c_name"), "c_custkey", {n: (df, ["k"]) for n, df in children.items()})
    return made.select("c_custkey", "c_name", *[F.to_json(n, {"ignoreNullFields": "false"}).alias(n) for n in children])


@query("""SELECT c_custkey, c_name, doc_id, lang FROM customer LEFT JOIN (SELECT doc_id, lang FROM documents JOIN labels USING (doc_id) WHERE quality = 1) ON doc_id = c_custkey ORDER BY c_name DESC, c_custkey LIMIT 100 OFFSET 50""")
def page_with_primary(t):
    """The list of people with their primary document: the predicate is on the joined side only."""
    primary = t("documents").join(t("labels").where("quality = 1"), "doc_id").select("doc_id", "lang")
    rows = t("customer").select("c_custkey", "c_name").join(primary, F.col("c_custkey") == F.col("doc_id"), "left")
    return filters.ordered_page(rows, "name", {"name": F.desc("c_name")}, "name", "c_custkey", 100, 50)


@query("""SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 500""")
def capped_request(t):
    return filters.ordered_page(t("orders").select("o_orderkey", "o_orderdate"), "?", {"newest": F.desc("o_orderdate")}, "newest", "o_orderkey", 700, cap=500)


@query("""WITH d AS (SELECT o_orderkey, o_orderdate::DATE AS born FROM orders), m AS (SELECT *, (2030 - year(born)) * 12 + 6 - month(born) - (day(born) > 15)::INT AS months FROM d)
SELECT 'between' AS kind, count(*) AS n FROM m WHERE months // 12 BETWEEN 3 AND 5 UNION ALL SELECT 'gte', count(*) FROM m WHERE months // 12 >= 4 UNION ALL SELECT 'lte', count(*) FROM m WHERE months // 12 <= 4""")
def age_filter(t):
    """Age in whole years on a given day, as a filter."""
    fields = {"age": Field("o_orderdate", as_of="2030-06-15")}
    kinds = {"between": [3, 5], "gte": 4, "lte": 4}
    parts = [filters.apply_filters(t("orders"), "o_orderkey", {"age": {"operator": k, "value": v}}, fields, {})[0].agg(F.count("*").alias("n")).select(F.lit(k).alias("kind"), "n") for k, v in kinds.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("""WITH w AS (SELECT max(ts) AS as_of FROM events), f AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'view') AS s, max(ts) FILTER (WHERE event_type = 'purchase') AS e, arg_max(event_type, struct_pack(t := ts, k := event_id)) AS state FROM events GROUP BY 1)
SELECT (SELECT count(*) FROM customer) AS people, (SELECT count(*) FROM customer WHERE c_acctbal > 0) AS active, (SELECT count(*) FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) - INTERVAL 7 DAY FROM orders)) AS new_7_days,
  (SELECT count(*) FROM orders WHERE o_orderdate > (SELECT max(o_orderdate) - INTERVAL 30 DAY FROM orders)) AS new_30_days, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS open_orders, (SELECT round(avg(o_totalprice), 4) FROM orders) AS mean_order,
  count(*) AS users, count(*) FILTER (WHERE state = 'purchase') AS finished, count(*) FILTER (WHERE state = 'error') AS failed, count(*) FILTER (WHERE state NOT IN ('purchase', 'error')) AS running,
  round(avg(epoch(e) - epoch(s)) FILTER (WHERE e > s), 3) AS mean_seconds, (SELECT count(*) FROM events, w WHERE ts > as_of - INTERVAL 7 DAY) AS events_7_days, (SELECT as_of FROM w) AS as_of FROM f""")
def dashboard_metrics(t):
    """Twelve figures and the time they are for, in one row; each table is read for one row, and these are set side by side."""
    people = t("customer").agg(F.count("*").alias("people"), F.count_if(F.col("c_acctbal") > 0).alias("active"))
    last = t("orders").agg(F.max("o_orderdate").alias("last"))
    within = lambda c, now, days: F.count_if(F.col(c) > F.expr(f"{now} - INTERVAL {days} DAYS"))
    orders = t("orders").crossJoin(F.broadcast(last)).agg(  # last: one row
        within("o_orderdate", "last", 7).alias("new_7_days"), within("o_orderdate", "last", 30).alias("new_30_days"),
        F.count_if(F.col("o_orderstatus") == "O").alias("open_orders"), F.round(F.avg("o_totalprice"), 4).alias("mean_order"),
    )
    kind, at = F.col("event_type"), F.col("ts")
    users = t("events").groupBy("user_id").agg(
        F.min(F.when(kind == "view", at)).alias("s"), F.max(F.when(kind == "purchase", at)).alias("e"), F.max_by("event_type", F.struct("ts", "event_id")).alias("state")
    )
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / 1000000
    jobs = users.agg(
        F.count("*").alias("users"), F.count_if(F.col("state") == "purchase").alias("finished"), F.count_if(F.col("state") == "error").alias("failed"),
        F.count_if(~F.col("state").isin("purchase", "error")).alias("running"), F.round(F.avg(F.when(F.col("e") > F.col("s"), seconds("e") - seconds("s"))), 3).alias("mean_seconds"),
    )
    newest = t("events").agg(F.max("ts").alias("as_of"))
    seen = t("events").crossJoin(F.broadcast(newest)).agg(within("ts", "as_of", 7).alias("events_7_days"), F.max("as_of").alias("as_of"))
    return people.crossJoin(orders).crossJoin(jobs).crossJoin(seen)  # one row each


VIEW = {
    "brands": (HELD, "o_custkey", "p_brand"), "types": (HELD, "o_custkey", "p_type"), "names": (HELD, "o_custkey", "p_name"),
    "priorities": ("orders", "o_custkey", "o_orderpriority"), "statuses": ("orders", "o_custkey", "o_orderstatus"), "kinds": ("events", "user_id", "event_type"),
    "flags": ("(SELECT o_custkey, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey)", "o_custkey", "l_returnflag"),
    "suppliers": ("(SELECT o_custkey, s_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey)", "o_custkey", "s_name"),
}


@query(
    "SELECT c_custkey, coalesce(years, 0) AS years, " + ", ".join(f"coalesce({n}, '') AS {n}" for n in VIEW)
    + " FROM customer LEFT JOIN (SELECT o_custkey, round(sum(o_totalprice) / 12, 4) AS years FROM orders GROUP BY 1) o ON o.o_custkey = c_custkey "
    + " ".join(f"LEFT JOIN (SELECT {k} AS k, md5(string_agg(DISTINCT {c}, '|' ORDER BY {c})) AS {n} FROM {source} GROUP BY 1) {n} ON {n}.k = c_custkey" for n, (source, k, c) in VIEW.items())
)
def match_view(t):
    """Years and eight arrays of distinct names for each person; the arrays as digests, to keep the result small."""
    held, orders = held_parts(t), t("orders")
    lines = t("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag").join(orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    sold = lines.join(t("supplier").select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    source = {"brands": held, "types": held, "names": held, "priorities": orders, "statuses": orders, "kinds": t("events"), "flags": lines, "suppliers": sold}
    lists = [
        source[n].select(F.col(k).alias("c_custkey"), F.col(c).alias("v")).distinct().groupBy("c_custkey").agg(F.array_sort(F.collect_set("v")).alias(n))
        for n, (_, k, c) in VIEW.items()
    ]
    years = orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice") / 12, 4).alias("years"))
    out = reports.with_totals(t("customer").select("c_custkey"), "c_custkey", [years, *lists], ["years"])
    return out.select("c_custkey", "years", *[F.when(F.col(n).isNull(), "").otherwise(F.md5(F.array_join(n, "|"))).alias(n) for n in VIEW])


@query("""SELECT s_suppkey, coalesce(required, 0) AS required, coalesce(mandatory, 0) AS mandatory, coalesce(matches, 0) AS matches, coalesce(shortlisted, 0) AS shortlisted, mean_score FROM supplier
LEFT JOIN (SELECT l_suppkey k, count(DISTINCT p_type) required, count(DISTINCT p_type) FILTER (WHERE l_returnflag = 'R') mandatory FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1) a ON a.k = s_suppkey
LEFT JOIN (SELECT l_suppkey k, count(*) matches, count(*) FILTER (WHERE score >= 0.5) shortlisted, round(avg(score), 4) mean_score FROM (SELECT l_suppkey, o_custkey, least(sum(l_quantity) / 100, 1.0) AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2) GROUP BY 1) b ON b.k = s_suppkey""")
def job_summary_scores(t):
    """Requirements and scored matches of each job, from two aggregates."""
    needs = t("lineitem").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_type").agg(F.bool_or(F.col("l_returnflag") == "R").alias("must"))
    needs = needs.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("p_type").alias("required"), F.count_if("must").alias("mandatory"))
    pairs = t("lineitem").join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "o_custkey").agg(F.least(F.sum("l_quantity") / 100, F.lit(1.0)).alias("score"))
    made = pairs.groupBy(F.col("l_suppkey").alias("s_suppkey")).agg(F.count("*").alias("matches"), F.count_if(F.col("score") >= 0.5).alias("shortlisted"), F.round(F.avg("score"), 4).alias("mean_score"))
    return reports.with_totals(t("supplier").select("s_suppkey"), "s_suppkey", [needs, made], ["required", "mandatory", "matches", "shortlisted"])


@query("""SELECT event_type AS section, CASE WHEN value >= 10 THEN 'large' ELSE 'small' END AS field, count(*) AS occurrences, count(DISTINCT user_id) AS people, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1, 2""")
def field_summary(t):
    field = F.when(F.col("value") >= 10, "large").otherwise("small").alias("field")
    return t("events").groupBy(F.col("event_type").alias("section"), field).agg(
        F.count("*").alias("occurrences"), F.count_distinct("user_id").alias("people"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )


@query("""SELECT lang, source, count(*) AS total, count(*) FILTER (WHERE quality = 1) AS accepted, count(*) FILTER (WHERE quality = 0) AS rejected, count(*) FILTER (WHERE quality IS NULL) AS pending, round(avg(n_chars), 2) AS mean_size FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1, 2""")
def feedback_summary(t):
    q = F.col("quality")
    return t("documents").select("doc_id", "lang", "source", "n_chars").join(t("labels"), "doc_id", "left").groupBy("lang", "source").agg(
        F.count("*").alias("total"), F.count_if(q == 1).alias("accepted"), F.count_if(q == 0).alias("rejected"), F.count_if(q.isNull()).alias("pending"), F.round(F.avg("n_chars"), 2).alias("mean_size")
    )


@query(f"""
WITH need AS (SELECT l_suppkey, p_type, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS must, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
m AS (SELECT l_suppkey, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2 HAVING sum(l_quantity) >= 60), h AS (SELECT DISTINCT o_custkey, p_type FROM {HELD} WHERE p_size <= 10)
SELECT m.l_suppkey, m.o_custkey, count(*) AS gaps, count(*) FILTER (WHERE must = 1 AND n >= 4) AS critical, count(*) FILTER (WHERE must = 1 AND n < 4) AS major, count(*) FILTER (WHERE must = 0) AS minor,
  string_agg(p_type, ',' ORDER BY p_type) AS missing FROM m JOIN need USING (l_suppkey) WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.o_custkey = m.o_custkey AND h.p_type = need.p_type) GROUP BY 1, 2""")
def gap_severity(t):
    """For each match of job and person, what is missing and how badly: only matches meet requirements, not all pairs."""
    lines = t("lineitem")
    need = lines.join(t("part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("l_suppkey", "p_type").agg(F.bool_or(F.col("l_returnflag") == "R").alias("must"), F.count("*").alias("n"))
    matches = lines.join(t("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).groupBy("l_suppkey", "o_custkey").agg(F.sum("l_quantity").alias("q")).where("q >= 60")
    held = held_parts(t).join(t("part").where("p_size <= 10").select("p_partkey"), "p_partkey", "left_semi").select("o_custkey", "p_type").distinct()
    missing = matches.join(need, "l_suppkey").join(held, ["o_custkey", "p_type"], "left_anti")
    severity = F.when(F.col("must") & (F.col("n") >= 4), "critical").when(F.col("must"), "major").otherwise("minor")
    by = [F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "major", "minor")]
    # A person lacks at most all types, so the list is short.
    return missing.withColumn("severity", severity).groupBy("l_suppkey", "o_custkey").agg(F.count("*").alias("gaps"), *by, F.array_join(F.array_sort(F.collect_set("p_type")), ",").alias("missing"))


def matched_people(t) -> DataFrame:
    """Customers with roles, years, software (types of small parts bought), languages (their nation) and certificates (priorities of large orders)."""
    years = t("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg((F.count("*") / 4.0).alias("years"))
    small = held_parts(t).join(t("part").where("p_size <= 3").select("p_partkey"), "p_partkey", "left_semi")
    software = small.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("p_type").alias("software"))
    large = t("orders").where("o_totalprice > 250000").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.collect_set("o_orderpriority").alias("certificates"))
    people = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(years, "c_custkey", "left").join(software, "c_custkey", "left").join(large, "c_custkey", "left")
    none = F.array().cast("array<string>")
    return people.select(
        "c_custkey", F.coalesce("years", F.lit(0.0)).alias("years"), F.array("c_mktsegment").alias("roles"), F.coalesce("software", none).alias("software"),
        F.array("n_name").alias("languages"), F.coalesce("certificates", none).alias("certificates"),
    )


def vocabularies(t) -> tuple[DataFrame, DataFrame]:
    """Categories (brands with the types that they have among the smallest parts) and what certificates imply."""
    categories = t("part").where("p_size = 1").select(F.lower("p_brand").alias("category"), F.col("p_type").alias("name")).distinct()
    implied = t("part").where("p_type in ('PROMO', 'LARGE')").select(F.when(F.col("p_type") == "PROMO", "Urgent").otherwise("HIGH").alias("certificate"), F.col("p_type").alias("name")).distinct()
    return categories, implied


V2 = f"""
c0 AS (SELECT c_custkey, c_mktsegment AS seg, n_name, coalesce(n, 0) / 4.0 AS years, coalesce(sw, []) AS sw, coalesce(ce, []) AS ce FROM customer JOIN nation ON c_nationkey = n_nationkey
  LEFT JOIN (SELECT o_custkey a, count(*) n FROM orders GROUP BY 1) ON a = c_custkey LEFT JOIN (SELECT o_custkey b, list(DISTINCT p_type) sw FROM {HELD} WHERE p_size <= 3 GROUP BY 1) ON b = c_custkey
  LEFT JOIN (SELECT o_custkey d, list(DISTINCT o_orderpriority) ce FROM orders WHERE o_totalprice > 250000 GROUP BY 1) ON d = c_custkey),
c1 AS (SELECT *, list_distinct(sw || CASE WHEN len(list_filter(ce, lambda x: contains(lower(x), 'urgent'))) > 0 AND EXISTS (SELECT 1 FROM part WHERE p_type = 'PROMO') THEN ['PROMO'] ELSE [] END
  || CASE WHEN len(list_filter(ce, lambda x: contains(lower(x), 'high'))) > 0 AND EXISTS (SELECT 1 FROM part WHERE p_type = 'LARGE') THEN ['LARGE'] ELSE [] END) AS s2 FROM c0),
cat AS (SELECT list(DISTINCT p_type) AS names FROM part WHERE p_size = 1 AND lower(p_brand) IN ('brand#7', 'promo')),
c2 AS (SELECT c_custkey, years, contains(lower(seg), 'building') AS r, CASE WHEN years >= 4 THEN 0.35 WHEN years >= 2.8 THEN 0.2 WHEN years >= 2 THEN 0.1 ELSE 0 END AS y,
  len(list_filter(s2, lambda x: contains(lower(x), 'promo') OR contains('promo', lower(x)) OR contains(lower(x), 'brand#7') OR contains('brand#7', lower(x)))) > 0 AS s,
  coalesce(list_has_any(s2, names), false) AS k, n_name IN ('FRANCE', 'NATION_3', 'GERMANY') AS l, len(list_filter(ce, lambda x: contains(lower(x), 'low'))) > 0 AS e FROM c1, cat),
v2 AS (SELECT c_custkey, years, round(r::INT * 0.25 + y + CASE WHEN s THEN 0.2 WHEN k THEN 0.18 ELSE 0 END + l::INT * 0.1 + e::INT * 0.1, 4)::DOUBLE AS score, r AS role_matched, y > 0 AS years_matched, s AS software_matched, k AND NOT s AS category_matched,
  l AS languages_matched, e AS certificates_matched FROM c2)"""


@query(f"""WITH {V2} SELECT *, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS level, row_number() OVER (ORDER BY score DESC, years DESC, c_custkey) AS rank FROM v2 WHERE score > 0 QUALIFY rank <= 200""")
def relaxed_match_v2(t):
    """All criteria, with software by certificate and by category, and what counted in each case."""
    categories, implied = vocabularies(t)
    return matching.match_relaxed(
        matched_people(t), "c_custkey", "building", 4.0, ["promo", "brand#7"], ["FRANCE", "NATION_3", "GERMANY"], ["low"], categories, implied, limit=200, flags=True
    )


@query(f"""WITH {V2}, b AS (SELECT *, row_number() OVER (ORDER BY score DESC, years DESC, c_custkey) AS rank FROM v2 WHERE score > 0 QUALIFY rank <= 50)
SELECT c_custkey, to_json(struct_pack(rank := rank, candidate := c_custkey, matched := list_filter([CASE WHEN role_matched THEN 'role' END, CASE WHEN years_matched THEN 'years' END, CASE WHEN software_matched THEN 'software' END, CASE WHEN category_matched THEN 'category' END], lambda x: x IS NOT NULL),
  missing := list_filter([CASE WHEN NOT role_matched THEN 'role' END, CASE WHEN NOT years_matched THEN 'years' END, CASE WHEN NOT software_matched THEN 'software' END, CASE WHEN NOT category_matched THEN 'category' END], lambda x: x IS NOT NULL)))::VARCHAR AS record FROM b""")
def match_json(t):
    """The best matches as JSON with rank, matched and missing criteria."""
    categories, implied = vocabularies(t)
    best = matching.match_relaxed(matched_people(t), "c_custkey", "building", 4.0, ["promo", "brand#7"], ["FRANCE", "NATION_3", "GERMANY"], ["low"], categories, implied, limit=50, flags=True)
    criteria = ("role", "years", "software", "category")
    named = lambda wanted: F.array_compact(F.array(*[F.when(F.col(f"{c}_matched") == wanted, c) for c in criteria]))
    return best.select("c_custkey", F.to_json(F.struct("rank", F.col("c_custkey").alias("candidate"), named(True).alias("matched"), named(False).alias("missing"))).alias("record"))


STRICT = "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal >= {0}"


@query(f"""WITH {V2}, top AS (SELECT c_custkey, row_number() OVER (ORDER BY score DESC, years DESC, c_custkey) AS rank FROM v2 WHERE score > 0 QUALIFY rank <= 20),
a AS ({STRICT.format('(SELECT max(c_acctbal) - 500 FROM customer WHERE c_mktsegment = $$BUILDING$$)')}), b AS ({STRICT.format('(SELECT max(c_acctbal) + 1 FROM customer)')})
SELECT 'reachable' AS search, c_custkey, false AS fallback_used FROM a UNION ALL SELECT 'reachable', c_custkey, true FROM top WHERE NOT EXISTS (SELECT 1 FROM a)
UNION ALL SELECT 'out of reach', c_custkey, false FROM b UNION ALL SELECT 'out of reach', c_custkey, true FROM top WHERE NOT EXISTS (SELECT 1 FROM b)""")
def strict_or_relaxed(t):
    """Two searches over the same table: one finds people, the other finds none and falls back on the relaxed match."""
    best = t("customer").agg(F.max("c_acctbal").alias("all"), F.max(F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_acctbal"))).alias("segment")).first()
    fields = {"segment": Field("c_mktsegment"), "balance": Field("c_acctbal")}
    categories, implied = vocabularies(t)

    def search(name: str, least: float) -> DataFrame:
        strict = filters.apply_filters(t("customer"), "c_custkey", {"segment": "BUILDING", "balance": {"operator": "gte", "value": least}}, fields, {})[0]
        fallback = strict.isEmpty()
        found = matching.match_relaxed(matched_people(t), "c_custkey", "building", 4.0, ["promo", "brand#7"], ["FRANCE", "NATION_3", "GERMANY"], ["low"], categories, implied) if fallback else strict
        return found.select(F.lit(name).alias("search"), "c_custkey", F.lit(fallback).alias("fallback_used"))

    return search("reachable", best["segment"] - 500).union(search("out of reach", best["all"] + 1))


@query("""SELECT doc_id, md5(left(text, 10000)) AS text, len(left(text, 10000)) AS size, strip_accents(lower(source || ' ' || lang)) AS plain_name FROM documents""")
def search_texts(t):
    """Search documents with their text cut at 10,000 characters, the cut being the feature."""
    none = lambda kind: F.array().cast(f"array<struct<{kind}>>")
    name = F.concat_ws(" ", "source", "lang")
    made = R.search_document(name, none("title:string,company:string,months:int,is_current:boolean"), none("name:string"), F.col("text"))
    return t("documents").select("doc_id", made.alias("d")).select("doc_id", F.md5(F.col("d.text")).alias("text"), F.length("d.text").cast("long").alias("size"), "d.plain_name")


@query(f"""
WITH s AS (SELECT o_custkey k, array_to_string(list(DISTINCT p_name ORDER BY p_name)[1:20], ', ') v FROM {HELD} GROUP BY 1), j AS (SELECT o_custkey k, array_to_string(list(left(o_orderpriority || ' at ' || o_orderstatus, 200) ORDER BY o_orderdate, o_orderkey)[1:5], ' | ') v FROM orders GROUP BY 1),
b AS (SELECT o_custkey k, array_to_string(list(DISTINCT p_brand ORDER BY p_brand)[1:3], ', ') v FROM {HELD} GROUP BY 1), l AS (SELECT o_custkey k, array_to_string(list(DISTINCT o_orderpriority ORDER BY o_orderpriority)[1:5], ', ') v FROM orders GROUP BY 1),
e AS (SELECT user_id k, array_to_string(list(DISTINCT event_type ORDER BY event_type)[1:5], ', ') v FROM events GROUP BY 1), y AS (SELECT o_custkey k, array_to_string(list(DISTINCT p_type ORDER BY p_type)[1:5], ', ') v FROM {HELD} GROUP BY 1)
SELECT c_custkey, concat_ws(' | ', c_name, 'Skills: ' || s.v, j.v, 'Schools: ' || b.v, 'Languages: ' || l.v, 'Certificates: ' || e.v, 'Trainings: ' || y.v) AS summary FROM customer
LEFT JOIN s ON s.k = c_custkey LEFT JOIN j ON j.k = c_custkey LEFT JOIN b ON b.k = c_custkey LEFT JOIN l ON l.k = c_custkey LEFT JOIN e ON e.k = c_custkey LEFT JOIN y ON y.k = c_custkey""")
def full_summary(t):
    """The summary text of each person with all its parts: 20 skills, 5 jobs of 200 characters, 3 schools, 5 languages, certificates and trainings."""
    held, orders = held_parts(t), t("orders")

    def first(df: DataFrame, key: str, column, most: int, name: str, order: list | None = None) -> DataFrame:
        rows = df.select(F.col(key).alias("c_custkey"), column.alias("v"), *(order or []))
        rows = rows if order else rows.distinct()
        return reports.first_values(rows, "c_custkey", F.col("v"), [F.col(c) for c in order] if order else [F.col("v")], most, name)

    job = F.left(F.concat_ws(" at ", "o_orderpriority", "o_orderstatus"), F.lit(200))
    lists = [
        first(held, "o_custkey", F.col("p_name"), 20, "skills"), first(orders, "o_custkey", job, 5, "jobs", ["o_orderdate", "o_orderkey"]),
        first(held, "o_custkey", F.col("p_brand"), 3, "schools"), first(orders, "o_custkey", F.col("o_orderpriority"), 5, "languages"),
        first(t("events"), "user_id", F.col("event_type"), 5, "certificates"), first(held, "o_custkey", F.col("p_type"), 5, "trainings"),
    ]
    rows = reports.with_totals(t("customer").select("c_custkey", "c_name"), "c_custkey", lists, [])
    parts = [("Skills: ", "skills", 20, ", "), ("", "jobs", 5, " | "), ("Schools: ", "schools", 3, ", "), ("Languages: ", "languages", 5, ", "), ("Certificates: ", "certificates", 5, ", "), ("Trainings: ", "trainings", 5, ", ")]
    return rows.select("c_custkey", R.summary_text(F.col("c_name"), [(label, F.col(c), most, sep) for label, c, most, sep in parts]).alias("summary"))


@query("""
WITH new AS (SELECT o_custkey AS k, o_orderpriority AS label, o_orderdate AS day, o_orderkey AS id FROM orders WHERE o_orderstatus <> 'F' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1),
old AS (SELECT c_custkey AS k, c_mktsegment AS label FROM customer)
SELECT k, label, day, id FROM new UNION ALL SELECT k, label, NULL, NULL FROM old WHERE k NOT IN (SELECT k FROM new)""")
def index_upsert(t):
    """An index of all customers by key, in which the last open order of each replaces the customer's own row."""
    new = t("orders").where("o_orderstatus <> 'F'").select(
        F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("label"), F.col("o_orderdate").alias("day"), F.col("o_orderkey").alias("id")
    )
    return writing.indexed(t("customer").select(F.col("c_custkey").alias("k"), F.col("c_mktsegment").alias("label")), new, "k", ["day", "id"]).select("k", "label", "day", "id")


@query("""
WITH last AS (SELECT o_custkey AS k, max(o_orderdate) AS day FROM orders GROUP BY 1)
SELECT c_custkey AS k, CASE WHEN day IS NULL THEN c_name ELSE lower(trim(c_name)) END AS plain, coalesce(day, DATE '1990-01-01') AS updated_at FROM customer LEFT JOIN last ON k = c_custkey""")
def triggered_upsert(t):
    """Customers with orders are written again: their names are made plain and their stamp is the last order's day."""
    people = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("plain"), F.expr("DATE '1990-01-01'").alias("updated_at"))
    last = t("orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_orderdate").alias("day"))
    again = writing.on_write(people.select("k", "plain").join(last, "k"), F.col("day"), {"plain": "plain"})
    return writing.upsert(people, again, ["k"], {"plain": "replace", "updated_at": "replace"})
