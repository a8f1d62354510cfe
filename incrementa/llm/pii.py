"""Personal data: fixed patterns, and information-theoretic sanitisation of what gives it away.

Emails, network addresses, payment cards and phone numbers are found by pattern. An entity to protect
is such a value, the name part or the domain of an email, or the presence of a kind. Over the whole
corpus, counting equal texts once, it is estimated how strongly a term anywhere in a text reveals an
entity of that text: pointwise mutual information, as a share of the entity's own information content.
The text itself is left out of its evidence (else every word that stands once would give all away), and low
counts are smoothed by ``support`` texts in which the entity is as frequent as anywhere. Entities, and terms, that stand
in the same texts are counted as one class, so that what is paired grows with the different texts, not with the
number of values in one. Terms at or over the disclosure threshold are spans of kind ``term`` and are removed wherever they stand in a
text with the entity. Only DataFrame functions are used.

Edge cases: null text is empty; a text without matches has no spans, whatever its terms; repeated rows are
judged each, equal texts count once as evidence; an empty table gives an empty result. Other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from incrementa.llm.common import settle
from incrementa.llm.spans import checked, clear_of, digits, found, luhn, named, placed, replaced

_LOCAL = "[A-Za-z0-9._%+-]"
_OCTET = "(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)|0++)"
#: kinds in the order of listing
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"\p{L}[\p{L}0-9_]{3,}"


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return value.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        n = F.length(digits(value))
        return F.when((n >= 13) & (n <= 19), luhn(digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(digits(value)).between(9, 15)
    return F.lit(True)


def base_spans(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, text where there is a span, one array of spans for each kind, text_hash); rid numbers the rows."""
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("*", *(found(F.col("text"), p).alias(f"m_{k}") for k, p in PATTERNS.items()))
    rows = rows.select("rid", "doc_id", "text", *(checked(placed(F.col("text"), F.col(f"m_{k}"), p), k, valid).alias(k) for k, p in PATTERNS.items()))
    touched = sum((F.size(k) for k in PATTERNS), F.lit(0)) > 0
    return settle(rows.select("rid", "doc_id", *PATTERNS, F.when(touched, F.col("text")).alias("text"), F.when(touched, F.xxhash64("text")).alias("text_hash")), "base")


def terms_of(text: Column) -> Column:
    """The distinct terms of a text, in lower case."""
    return F.array_distinct(F.transform(found(text, TERM), lambda t: F.lower(t)))


def entities_of(kind: str) -> Column:
    """Names of what a text's spans of a kind tell: the values in lower case, parts of emails, the kind."""
    value = lambda name, part: F.transform(kind, lambda s: F.concat(F.lit(f"{name}:"), part(F.lower(s["value"]))))
    parts = [value(kind, lambda v: v)]
    if kind == "email":
        parts += [value("name", lambda v: F.substring_index(v, "@", 1)), value("domain", lambda v: F.substring_index(v, "@", -1))]
    return F.concat(*parts, F.when(F.size(kind) > 0, F.array(F.lit(f"kind:{kind}"))).otherwise(F.array().cast("array<string>")))


def holdings(base: DataFrame) -> DataFrame:
    """(text_hash, entities, words) of every row with a span: its entities' names and the terms of its whole text."""
    entities = F.array_distinct(F.concat(*(entities_of(k) for k in PATTERNS)))
    return settle(base.where("text is not null").select("text_hash", entities.alias("entities"), terms_of(F.col("text")).alias("words")), "holdings")


def frequencies(docs: DataFrame) -> tuple[DataFrame, float]:
    """((term, n_term), number of texts) over the whole corpus, equal texts once; combined before the shuffle."""
    texts = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    total = float(max(texts.select("text_hash").distinct().count(), 2))
    words = texts.dropDuplicates(["text_hash"]).select(F.explode(terms_of(F.col("text"))).alias("term"))
    # written, so that no join is pushed below the counting
    return settle(words.groupBy("term").agg(F.count("*").alias("n_term")), "frequencies"), total


def standing(rows: DataFrame, name: str, *more: str) -> DataFrame:
    """(``name``, class): what stands in exactly the same texts is one class (a digest of the texts, their number, and ``more``).

    A name in one text alone is left out: it is no evidence, as its information there is 0 or less.
    """
    found = rows.groupBy(name).agg(*(F.bit_xor(F.xxhash64("text_hash", F.lit(k))).alias(f"x{k}") for k in (1, 2)), F.count("*").alias("n"), *(F.first(c).alias(c) for c in more))
    return found.where("n > 1").select(name, F.struct("x1", "x2", "n", *more).alias("class"))


def revealing(docs: DataFrame, held: DataFrame, support: int, threshold: float) -> DataFrame:
    """(text_hash, term): the terms of each text with a span that give one of its entities away.

    Entities are paired with terms by class, so a list of addresses that stands in the same texts is paired once, and
    one that stands in a single text not at all.
    """
    once = settle(held.dropDuplicates(["text_hash"]).select("text_hash", "entities", "words"), "once")
    seen = once.select("text_hash", F.explode("entities").alias("entity"))
    named_terms = once.select("text_hash", F.explode("words").alias("term"))
    entities = settle(standing(seen, "entity").withColumnRenamed("class", "ec"), "entity-classes")
    terms, total = frequencies(docs)
    words = settle(standing(named_terms.join(terms, "term"), "term", "n_term").withColumnRenamed("class", "wc"), "term-classes")
    entity_of = settle(seen.join(entities, "entity").select("text_hash", "ec").distinct(), "entities-of")
    word_of = named_terms.join(words, "term").select("text_hash", "wc").distinct()
    pairs = entity_of.join(word_of, "text_hash").groupBy("ec", "wc").agg(F.count("*").alias("both")).where("both > 1")
    share = F.col("ec.n") / total
    pmi = F.log2((F.col("both") - 1 + support * share) / (F.col("wc.n_term") - 1 + support) / share)  # from the other texts
    content = -F.log2(share)
    told = settle(pairs.where((content > 0) & (pmi >= threshold * content)).select("ec", "wc"), "disclosing")
    # from the terms that tell anything to what they tell, and whether that is in the text
    tellers = words.join(told, "wc").select("term", "ec")
    return settle(named_terms.join(tellers, "term").join(entity_of, ["text_hash", "ec"], "left_semi").select("text_hash", "term").distinct(), "revealing")


def revealed(base: DataFrame, told: DataFrame) -> DataFrame:
    """(rid, terms): places of the terms ``told(text_hash, term)``, outside all base spans."""
    rows = base.where("text is not null").join(told.select("text_hash").distinct(), "text_hash").select("rid", "text_hash", "text", F.concat(*PATTERNS).alias("spans"))
    rows = rows.select("rid", "text_hash", F.explode(clear_of(placed(F.col("text"), found(F.col("text"), TERM), TERM), F.col("spans"))).alias("t"))
    rows = rows.select("rid", "text_hash", F.lower("t.value").alias("term"), "t.start", "t.end").join(told, ["text_hash", "term"])
    return settle(rows.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("terms")), "terms")


def sanitise(docs: DataFrame, support: int = 3, threshold: float = 0.8) -> DataFrame:
    """One row per input row: doc_id, the base spans by kind, ``terms`` (start, end), ``clean``: the text without what it gives away (null where nothing was found)."""
    base = base_spans(docs)
    held = holdings(base)
    terms = revealed(base, revealing(docs, held, support, threshold))
    rows = base.join(terms, "rid", "left").withColumn("terms", F.coalesce("terms", F.array().cast("array<struct<start:int,end:int>>")))
    kinds = [*PATTERNS, "terms"]
    every = F.concat(*(named(F.col(k), k.removesuffix("s")) for k in kinds))
    # what overlapping spans of several kinds cover is named by the first of them
    return rows.select("doc_id", *PATTERNS, "terms", F.when(F.col("text").isNotNull(), replaced(F.col("text"), F.array_sort(every), "kind")).alias("clean"))
