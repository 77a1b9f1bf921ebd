"""Weighted relaxed matching of people to a requirement, and vocabulary mapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rosterlake.functions import nested, records, scoring, text
from rosterlake.operators import retrieval

#: Weights of role, years (by tier), software, languages and certificates.
WEIGHTS = {"role": 0.25, "software": 0.20, "category": 0.18, "languages": 0.10, "certificates": 0.10}


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def match_relaxed(
    people: DataFrame, key: str, role: str | None, years: float | None, software: list[str], languages: list[str], certificates: list[str],
    categories: DataFrame | None = None, implied: DataFrame | None = None, limit: int = 20, flags: bool = False,
) -> DataFrame:
    """People with score, level and rank, best first; those without any match are left out.

    flags: a boolean column too for each of role, years, software, category, languages
    and certificates: whether that criterion counted.

    people: key, roles, years, software, languages, certificates (arrays of strings).
    categories (category, name): where software asked for is a category, software of
    that category gives a little less.  implied (certificate, name): software that a
    certificate implies counts as held.
    """
    rows = people
    if implied is not None:
        named = people.select(key, F.explode("certificates").alias("c")).withColumn("c", F.lower("c"))
        rules = implied.select(F.lower("certificate").alias("rule"), "name")
        held = named.join(containing(named, "c", rules, "rule"), "c").join(rules, "rule")
        rows = rows.join(held.groupBy(key).agg(F.array_sort(F.collect_set("name")).alias("extra")), key, "left")
        rows = rows.withColumn("software", F.array_distinct(F.concat("software", F.coalesce("extra", F.array().cast("array<string>"))))).drop("extra")
    tier = F.lit(False)
    if categories is not None and software:
        names = categories.where(F.lower("category").isin(*[s.lower() for s in software])).agg(F.array_sort(F.collect_set("name")).alias("in_category"))
        rows = rows.crossJoin(F.broadcast(names))  # one row
        tier = nested.contains_either_way(F.col("software"), F.col("in_category"))
    when = lambda test, w: F.when(test, w).otherwise(0.0)
    parts = [
        when(nested.any_contains(F.col("roles"), F.lit(role)), WEIGHTS["role"]) if role else F.lit(0.0),
        scoring.years_tier(F.col("years"), years) if years is not None else F.lit(0.0),
        F.when(nested.contains_either_way(F.col("software"), strings(software)), WEIGHTS["software"]).otherwise(when(tier, WEIGHTS["category"])) if software else F.lit(0.0),
        when(F.arrays_overlap("languages", strings(languages)), WEIGHTS["languages"]) if languages else F.lit(0.0),
        when(nested.contains_either_way(F.col("certificates"), strings(certificates)), WEIGHTS["certificates"]) if certificates else F.lit(0.0),
    ]
    names_ = ["role", "years", "software", "category", "languages", "certificates"]
    if flags:
        software_part = parts[2]
        counted = [parts[0] > 0, parts[1] > 0, software_part == WEIGHTS["software"], software_part == WEIGHTS["category"], parts[3] > 0, parts[4] > 0]
        rows = rows.withColumns({f"{n}_matched": F.coalesce(c, F.lit(False)) for n, c in zip(names_, counted)})
    scored = rows.withColumn("score", F.round(sum(parts[1:], parts[0]), 4)).where("score > 0")
    best = scored.orderBy(F.desc("score"), F.desc("years"), key).limit(limit)
    place = Window.orderBy(F.desc("score"), F.desc("years"), key)  # over at most limit rows
    return best.select(key, "years", "score", scoring.level(F.col("score"), scoring.MATCH, "low").alias("level"), F.row_number().over(place).alias("rank"), *([f"{n}_matched" for n in names_] if flags else []))


def trigram_matches(items: DataFrame, item: str, names: DataFrame, name: str, threshold: float) -> DataFrame:
    """Pairs of distinct texts with a trigram similarity of threshold or more: item, name, similarity.

    Each text's trigrams are put in order, rarest first.  Two texts as similar as asked
    share one of the first few of each, so only these meet in an equi-join: a trigram
    that many texts have hardly ever brings two of them together.
    """

    def distinct(df: DataFrame, c: str) -> DataFrame:
        return df.select(F.col(c).alias(c)).where(F.col(c).isNotNull()).distinct().withColumn("grams", text.trigrams(F.col(c))).where(F.size("grams") > 0)

    left, right = distinct(items, item), distinct(names, name)
    counts = left.select(F.explode("grams").alias("gram")).union(right.select(F.explode("grams").alias("gram"))).groupBy("gram").agg(F.count("*").alias("n"))

    def first(df: DataFrame, c: str, grams: str) -> DataFrame:
        """c, all trigrams in order, and a row for each of the first ones."""
        ranked = df.select(c, F.explode("grams").alias("gram")).join(counts, "gram").groupBy(c).agg(F.sort_array(F.collect_list(F.struct("n", "gram"))).alias("o"))
        ordered = ranked.select(c, F.col("o.gram").alias(grams))
        most = F.size(grams) - F.ceil(F.size(grams) * threshold - 1e-9) + 1
        return ordered.select(c, grams, F.explode(F.slice(F.col(grams), F.lit(1), most.cast("int"))).alias("gram"))

    near = first(left, item, "grams_a").join(first(right, name, "grams_b"), "gram")
    sizes = F.size("grams_a"), F.size("grams_b")
    near = near.where(F.least(*sizes) >= F.greatest(*sizes) * threshold)
    shared = F.size(F.array_intersect("grams_a", "grams_b"))
    found = near.select(item, name, (shared / (sizes[0] + sizes[1] - shared)).alias("similarity"))
    return found.where(F.col("similarity") >= threshold).distinct()


def containing(longer: DataFrame, a: str, shorter: DataFrame, b: str) -> DataFrame:
    """Pairs of distinct texts (a, b) where a contains b; an empty b is in none.

    b meets only the texts that have its rarest piece of three characters (or b itself,
    if shorter), in an equi-join.
    """

    def pieces(c: str, n: int) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substr(F.col(c), i, F.lit(n)))
        return F.when(F.length(c) >= n, cut).otherwise(F.array().cast("array<string>"))

    long = longer.select(F.col(a).alias(a)).where(F.col(a).isNotNull()).distinct()
    short = shorter.select(F.col(b).alias(b)).where(F.length(b) > 0).distinct()
    held = long.select(a, F.explode(F.array_distinct(F.concat(*[pieces(a, n) for n in (1, 2, 3)]))).alias("piece"))
    counts = held.groupBy("piece").agg(F.count("*").alias("n"))
    asked = short.select(b, F.explode(F.when(F.length(b) < 3, F.array(b)).otherwise(pieces(b, 3))).alias("piece"))
    rarest = asked.join(counts, "piece").groupBy(b).agg(F.min_by("piece", F.struct("n", "piece")).alias("piece"))
    return rarest.join(held, "piece").where(F.contains(a, b)).select(a, b)


def cascade(
    items: DataFrame, item: str, names: DataFrame, name: str, confident: float = 0.75, suggested: float = 0.6,
    vectors: tuple[DataFrame, DataFrame] | None = None, near: float = 0.85, maybe: float = 0.6,
) -> DataFrame:
    """Map distinct texts to a vocabulary: item, name, method, similarity.

    Exact after normalising (1.0), else one contains the other (0.9, the longest name
    wins), else the best trigram match: trigram from confident on, suggested below.
    vectors: (item, vector) and (name, vector); what is still open takes the nearest
    name by cosine: vector from near on, vector_suggested from maybe on.
    An item's first tier counts; without a match the method is none.  The first three
    tiers are equi-joins over distinct texts, each run once, of which a window keeps the
    best: a chain of anti joins would run the early tiers again for every later one.
    """
    distinct = items.select(F.col(item).alias("item")).where(F.col(item).isNotNull()).distinct().withColumn("plain", text.normalise(F.col("item")))
    vocabulary = names.select(F.col(name).alias("name")).distinct().withColumn("plain_name", text.normalise(F.col("name"))).where("plain_name <> ''")
    filled = distinct.where("plain <> ''")
    equal = filled.select("plain", F.col("plain").alias("plain_name"), F.lit(0).alias("tier"), F.lit(1.0).alias("similarity"))
    parts = containing(filled, "plain", vocabulary, "plain_name").union(containing(vocabulary, "plain_name", filled, "plain").select("plain", "plain_name"))
    inside = parts.select("plain", "plain_name", F.lit(1), F.lit(0.9))
    close = trigram_matches(filled, "plain", vocabulary, "plain_name", suggested).select("plain", "plain_name", F.lit(2), "similarity")
    best = F.when(F.col("tier") == 1, -F.length("plain_name")).otherwise(-F.col("similarity"))
    place = Window.partitionBy("item").orderBy("tier", best, "name")
    met = filled.join(equal.union(inside).union(close), "plain").join(vocabulary, "plain_name").withColumn("place", F.row_number().over(place)).where("place = 1")
    method = F.when(F.col("tier") == 0, "exact").when(F.col("tier") == 1, "substring").when(F.col("similarity") >= confident, "trigram").otherwise("suggested")
    found = met.select("item", "name", method.alias("method"), "similarity")
    if vectors is not None:
        asked = vectors[0].join(distinct.join(found, "item", "left_anti"), "item", "left_semi")
        best = retrieval.nearest(vectors[1], "name", "vector", asked.withColumnRenamed("vector", "asked"), "item", "asked", 1).where(F.col("score") >= maybe)
        found = found.union(best.select("item", "name", F.when(F.col("score") >= near, "vector").otherwise("vector_suggested"), "score"))
    return distinct.select("item").join(found, "item", "left").select("item", "name", F.coalesce("method", F.lit("none")).alias("method"), "similarity")


def upsert_counts(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Add up occurrences; keep the best similarity and the latest suggestion that is not null."""
    both = old.withColumn("turn", F.lit(0)).unionByName(new.withColumn("turn", F.lit(1)))
    latest = F.max_by("suggestion", F.when(F.col("suggestion").isNotNull(), F.col("turn")))
    return both.groupBy(*keys).agg(F.sum("occurrences").alias("occurrences"), F.max("similarity").alias("similarity"), latest.alias("suggestion"))


def merge(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], update: bool = True) -> DataFrame:
    """Insert new rows; on a key conflict take the new values that are not null, or nothing."""
    if not update:
        return old.unionByName(new.join(old, keys, "left_anti"))
    renamed = new.select(*keys, *[F.col(c).alias(f"new_{c}") for c in columns])
    return old.join(renamed, keys, "full_outer").select(*keys, *[F.coalesce(f"new_{c}", c).alias(c) for c in columns])


def report(matches: DataFrame, key: str, limit: int, floor: float = 0.0) -> DataFrame:
    """key, rank, percent, level and recommendation of the best matches, from a score of 0 to 1; below floor percent none."""
    percent = F.round(F.col("score") * 100, 1)
    best = matches.where(percent >= floor).orderBy(F.desc("score"), key).limit(limit)
    place = F.row_number().over(Window.orderBy(F.desc("score"), key))  # over at most limit rows
    ranked = best.select(key, place.alias("rank"), percent.alias("percent"), scoring.level(F.col("score"), scoring.MATCH, "low").alias("level"))
    return ranked.withColumn("recommendation", records.suitability(F.col("rank"), F.col("level"), F.col("percent")))


def summary(ranked: DataFrame) -> DataFrame:
    """One row: total, high, medium, to_interview (at most three of the high ones)."""
    high = F.count_if(F.col("level") == "high")
    return ranked.agg(F.count("*").alias("total"), high.alias("high"), F.count_if(F.col("level") == "medium").alias("medium"), F.least(high, F.lit(3)).alias("to_interview"))
