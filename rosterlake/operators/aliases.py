"""Alias tables of vocabularies, and what texts mean by them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from rosterlake.operators import matching
from rosterlake.functions import nested, spotting, text
from rosterlake.functions.synonyms import unmarked_greek

#: Confidence of a name, an abbreviation and an alias.
SURE = {"name": 1.0, "abbreviation": 0.98, "alias": 0.95}


def alias_table(sources: dict[str, DataFrame], key: str, columns: dict[str, str]) -> DataFrame:
    """term, key, source, kind, confidence: each normalised term once.

    columns: column -> kind (name, alias, abbreviation); a column holds a string or an
    array of strings.  Of equal terms the later source wins, then the later column,
    then the larger key.
    """
    parts = []
    for place, (source, table) in enumerate(sources.items()):
        for turn, (column, kind) in enumerate(columns.items()):
            if column not in table.columns:
                continue
            is_array = table.schema[column].dataType.typeName() == "array"
            term = F.explode(F.col(column)) if is_array else F.col(column)
            order = F.struct(F.lit(place).alias("place"), F.lit(turn).alias("turn"))
            parts.append(table.select(
                term.alias("raw"), F.col(key).alias("key"), F.lit(source).alias("source"), F.lit(kind).alias("kind"), F.lit(SURE[kind]).alias("confidence"), order.alias("order")
            ))
    rows = reduce(DataFrame.union, parts).withColumn("term", text.normalise(F.col("raw"))).where("term <> ''")
    best = F.max_by(F.struct("key", "source", "kind", "confidence"), F.struct("order", "key"))
    return rows.groupBy("term").agg(best.alias("best")).select("term", "best.*")


def weighted_tokens(rows: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """key, token, weight: words of the columns, each with the best (first) weight letter of the columns it occurs in."""
    pick = lambda c: F.split(text.normalise(c), r"[^\p{L}\p{N}]+")
    weighed = lambda c, g: F.transform(pick(F.col(c)), lambda w: F.struct(w.alias("token"), F.lit(g).alias("weight")))
    none = F.array().cast("array<struct<token:string,weight:string>>")
    pairs = [F.coalesce(weighed(c, g), none) for c, g in columns.items()]
    return rows.select(key, F.inline(F.concat(*pairs))).where("token <> ''").groupBy(key, "token").agg(F.min("weight").alias("weight"))


def analysed(c: Column, stop: list[str], compound: bool = False) -> Column:
    """Tokens for an index: Greek accents folded, lower case, without stop words; stemming.english cuts English ones to stems.

    compound: words also fall apart where letters meet digits and at a change to upper
    case; the whole word stays, too.
    """
    words = F.filter(F.split(unmarked_greek(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    if compound:
        cut = lambda w: F.split(w, r"(?<=\p{Ll})(?=\p{Lu})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
        words = F.flatten(F.transform(words, lambda w: F.array_distinct(F.concat(F.array(w), cut(w)))))
    low = F.transform(words, lambda w: F.lower(w))
    return F.filter(low, lambda w: ~w.isin(*stop)) if stop else low


def expanded(names: DataFrame, name: str, variants: str, group: str) -> DataFrame:
    """group, terms: all names of a group and their variants, each once, sorted."""
    every = F.explode(F.array_union(F.array(name), F.coalesce(F.col(variants), F.array().cast("array<string>")))).alias("term")
    return names.select(group, every).groupBy(group).agg(F.array_sort(F.collect_set("term")).alias("terms"))


def spoken(plain: Column) -> Column:
    """Words of a normalised text: letters, digits, + and #."""
    return F.filter(F.split(plain, r"[^\p{L}\p{N}+#]+"), lambda w: w != "")


def terms_in_words(plain: DataFrame, key: str, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, term) of the aliases that a text has as whole words, and (term, alias_key, source)."""
    known = aliases.select(spoken(F.col("term")).alias("words"), "key", "source").where(F.size("words") > 0)
    lengths = known.agg(F.array_sort(F.collect_set(F.size("words"))).alias("lengths"))
    known = known.select(F.array_join("words", " ").alias("term"), F.col("key").alias("alias_key"), "source").distinct()
    fits = F.filter("lengths", lambda n: n <= F.size("words"))
    sized = plain.select(key, spoken(F.col("plain")).alias("words")).crossJoin(F.broadcast(lengths)).select(key, "words", F.explode(fits).alias("n_words"))  # lengths: one row
    runs = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n_words") + 1), lambda i: F.array_join(F.slice("words", i, F.col("n_words")), " "))
    return sized.select(key, F.explode(F.array_distinct(runs)).alias("term")), known


def tag(rows: DataFrame, key: str, body: str, aliases: DataFrame, inside: bool = False) -> DataFrame:
    """key and one struct of filters per text: years, license, ids (per source a sorted array), confidence, kind.

    aliases: as alias_table gives them.  Aliases fall into words as texts do, so an
    alias counts as whole words, whatever stands between them.  A text's runs of as
    many words as some alias has meet the aliases in an equi-join, so no text is
    compared with every alias.  inside: an alias counts wherever its letters stand, in
    other words too; then one automaton of all aliases reads each text once.
    """
    plain = rows.select(key, text.normalise(F.col(body)).alias("plain"))
    if inside:
        known = aliases.select("term", F.col("key").alias("alias_key"), "source").distinct()
        terms = spotting.spot(plain, key, "plain", aliases, "term").select(key, "term").distinct()
    else:
        terms, known = terms_in_words(plain, key, aliases)
    per_source = terms.join(known, "term").groupBy(key, "source").agg(F.array_sort(F.collect_set("alias_key")).alias("ids"))
    ids = per_source.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source", "ids")))).alias("ids"))
    years = F.regexp_extract("plain", r"(\d+)\+?\s*(?:χρονια|years?|ετ[ωη])", 1).try_cast("int")
    licence = F.regexp_extract("plain", r"(?:διπλωμα|αδεια|license).*?\b(forklift|κλαρκ|γερανος|[a-d])(?![\p{L}\p{N}])", 1)
    vehicle = F.when(licence.isin("forklift", "κλαρκ"), "forklift").when(licence == "γερανος", "crane").otherwise(F.nullif(F.upper(licence), F.lit("")))
    wide = plain.join(ids, key, "left").select(key, years.alias("years"), vehicle.alias("license"), "ids")
    found = F.col("years").isNotNull().cast("int") + F.col("license").isNotNull().cast("int") + F.coalesce(F.nullif(F.size("ids"), F.lit(-1)), F.lit(0))
    return wide.select(
        "*", F.round(F.least(F.lit(0.3) + found * 0.1, F.lit(0.7)), 4).alias("confidence"), F.when(found > 0, "structured").otherwise("semantic").alias("kind")
    )


def implied(names: DataFrame, name: str, rules: DataFrame, rule: str, variants: str, gives: str) -> DataFrame:
    """name, gives: what the first rule (by name) gives whose own name or variant occurs in a name."""
    held = names.select(F.col(name).alias("held")).where("held is not null").distinct().withColumn("low", F.lower("held"))
    wanted = F.array_union(F.array(F.col(rule)), F.coalesce(F.col(variants), F.array().cast("array<string>")))
    terms = rules.select(rule, gives, F.explode(wanted).alias("term")).withColumn("term", F.lower("term")).where("term <> ''")
    hits = held.join(matching.containing(held, "low", terms, "term"), "low").join(terms, "term")
    first = hits.withColumn("place", F.row_number().over(Window.partitionBy("held").orderBy(rule))).where("place = 1")
    return first.select(F.col("held").alias(name), gives)


def in_category(items: Column, names: Column) -> Column:
    """Whether some item and some name of a category contain one another."""
    return F.coalesce(nested.contains_either_way(items, names), F.lit(False))
