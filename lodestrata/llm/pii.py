"""Operator 7, PII: base patterns, and information-theoretic sanitisation of the terms around them.

Native: built-in functions only. The protected entities are the base spans' values, terms are lower-cased words, and the
event space is documents: PMI(term; entity) = log2(n(t,e) N / (n(t) n(e))), all counts of documents, says how many bits of
the entity's IC(e) = log2(N / n(e)) a term gives away. Terms that give away REMOVE of it or more are removed, those from
GENERALISE on are replaced by their kind, wherever they stand in the whole text of a document with the entity. A term must
meet an entity in SUPPORT documents or more: fewer are no estimate of a probability.

As n(t,e) is at most n(t) and n(e), an entity in fewer than SUPPORT documents, or a term in more than
N (n(e) / N) ** (1 - GENERALISE), can't reach a threshold; such are left out before anything is paired.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, durable, join_counted, table
from .spans import count_of, joined, matches, ordered

NAME = "op7_pii"

# Runs of a class are entered at their start only (or where the last match ended), and never given back: the matches are
# those of the plain patterns, in time proportional to the text.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9]++(?:[\x20-][0-9]++)*+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone", "term"]

#: A term has so many code points or more.
TERM = 3
SUPPORT = 3
GENERALISE = 0.5
REMOVE = 0.8


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    d = F.transform(F.reverse(F.split(digits, "")), lambda c: c.cast("int"))
    doubled = F.transform(d, lambda x, i: F.when(i % 2 == 0, x).otherwise(F.when(x > 4, 2 * x - 9).otherwise(2 * x)))
    return F.aggregate(doubled, F.lit(0), lambda a, x: a + x) % 10 == 0


def _ip_ok(m: Column) -> Column:
    parts = F.transform(F.split(m, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(parts, lambda p: (F.length(p) <= 3) & (F.lpad(p, 3, "0") <= "255"))


def base_spans(text: Column) -> Column:
    """The base spans of a text that isn't null, sorted."""
    spans = [
        matches(text, EMAIL, "email", lambda m: F.lit(True), "@"),
        matches(text, IP, "ip", _ip_ok),
        matches(text, CARD, "card", lambda m: F.length(_digits(m)).between(12, 19) & luhn(_digits(m)), "[0-9](?:[\\x20-]?[0-9]){11}"),
        matches(text, PHONE, "phone", lambda m: F.length(_digits(m)).between(9, 15)),
    ]
    return ordered(F.concat(*spans), KINDS)


def _pair(entity: Column, term: Column) -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", F.length(entity).cast("string"), entity, term), 256))


def cooccurring(rows: DataFrame, total: int) -> DataFrame:
    """``rid, entity, ne, term, nt``: entities and terms of a document that may reach GENERALISE, by the bounds above.

    ``rows`` has ``rid, text, base``, the base spans with their values, for all ``total`` documents.
    """
    entity = lambda s: F.concat_ws(":", s["kind"], s["value"])
    of = durable(rows.where(F.size("base") > 0).select("rid", F.explode(F.array_distinct(F.transform("base", entity))).alias("entity")))
    often = of.groupBy("entity").agg(F.count("*").alias("ne")).where(F.col("ne") >= SUPPORT)
    held = durable(join_counted(of, often, "entity", "ne", of.count()).where("ne is not null"))
    most = held.agg(F.max("ne")).first()[0] or 0
    bound = lambda ne: total * F.pow(ne / F.lit(float(max(total, 1))), F.lit(1 - GENERALISE))
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")), lambda w: F.length(w) >= TERM)
    terms = rows.where("text is not null").select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("nt"))
    terms = terms.where((F.col("nt") >= SUPPORT) & (F.col("nt") <= bound(F.lit(float(most))) + 1e-6))
    theirs = held.groupBy("rid").agg(F.collect_list(F.struct("entity", "ne")).alias("es"))
    spoken = durable(rows.where(F.size("base") > 0).join(theirs, "rid").select("rid", "es", F.explode(words).alias("term")).select("rid", "es", "term"))
    met = join_counted(spoken, terms, "term", "nt", spoken.count()).where("nt is not null")
    met = met.select("rid", "term", "nt", F.explode("es").alias("e")).select("rid", "e.entity", "e.ne", "term", "nt")
    return met.where(F.col("nt") <= bound(F.col("ne")) + 1e-6)


def disclosing(met: DataFrame, total: int) -> DataFrame:
    """``pair, n, bits``: pairs of entity and term that give away GENERALISE or more; bits: the share of the entity's IC."""
    pairs = met.groupBy(_pair(F.col("entity"), F.col("term")).alias("pair")).agg(F.count("*").alias("n"), F.first("ne").alias("ne"), F.first("nt").alias("nt"))
    pmi = F.log2(F.col("n") * F.lit(float(total)) / (F.col("nt") * F.col("ne")))
    ic = F.log2(F.lit(float(total)) / F.col("ne"))
    pairs = pairs.where((F.col("n") >= SUPPORT) & (ic > 0)).withColumn("bits", pmi / ic)
    return pairs.where(F.col("bits") >= GENERALISE).select("pair", "n", "bits")


_NO_SPANS = "array<struct<start:int,kind:string,end:int,value:string>>"


def _flagged(rows: DataFrame) -> DataFrame:
    """``rows`` with ``extra``: spans of disclosing terms that touch no base span; value says "remove" or "generalise".

    Only rows with base spans are shuffled with their texts; the others have no entity and stay where they are.
    """
    total = rows.count()
    met = durable(cooccurring(rows, total).withColumn("pair", _pair(F.col("entity"), F.col("term"))))
    found = durable(disclosing(met, total))
    hit = join_counted(met.select("rid", "term", "pair"), found, "pair", "n", met.count()).where("bits is not null")
    each = hit.groupBy("rid", "term").agg(F.when(F.max("bits") >= REMOVE, "remove").otherwise("generalise").alias("act"))
    acts = each.groupBy("rid").agg(F.map_from_entries(F.collect_list(F.struct("term", "act"))).alias("acts"))  # a document's own words
    spans = matches(F.col("text"), WORD, "term", lambda m: F.map_contains_key("acts", F.lower(m)))
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), F.element_at("acts", F.lower(s["value"])).alias("value")))
    spans = F.filter(spans, lambda t: ~F.exists("base", lambda b: (b["start"] < t["end"]) & (b["end"] > t["start"])))
    none = F.array().cast(_NO_SPANS)
    own = rows.where(F.size("base") > 0).repartition(rows.rdd.getNumPartitions(), "rid")
    extra = own.join(acts, "rid", "left").withColumn("extra", F.when(F.col("acts").isNull(), none).otherwise(spans)).drop("acts")
    return rows.where(F.size("base") == 0).withColumn("extra", none).unionByName(extra)


def find_pii(docs: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, n_removed, n_generalised, base_sha256, spans, sanitised`` of every document.

    Base spans are the matches of the four patterns that pass their rules; spans of kind ``term`` are added for
    disclosing terms. ``sanitised`` is the text without them, as ``sanitise`` says. Positions are code points, ends
    exclusive. A null text counts as empty; null and repeated ids pass through; rows that repeat count as documents of
    their own; extra columns are ignored; an empty table gives an empty result.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text.alias("text"), base_spans(text).alias("base"))
    out = _flagged(durable(rows))
    acted = lambda act: F.size(F.filter("extra", lambda s: s["value"] == act)).cast("long")
    return out.select(
        "doc_id",
        *[count_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS[:4]],
        acted("remove").alias("n_removed"),
        acted("generalise").alias("n_generalised"),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(ordered(F.concat("base", "extra"), KINDS)).alias("spans"),
        sanitise(F.col("text"), F.concat("base", "extra")).alias("sanitised"),
    )


def sanitise(text: Column, spans: Column) -> Column:
    """The text with each span replaced: base spans and generalised terms by their kind in brackets, others by nothing.

    ``spans`` is an array of struct<start, kind, end, value>; spans that overlap are replaced as one, by the first's kind.
    A null text or array gives null.
    """
    empty = F.array().cast(_NO_SPANS)

    def join(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        wide = F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"), last["value"].alias("value"))
        apart = (F.size(acc) == 0) | (s["start"] >= F.coalesce(last["end"], F.lit(0)))
        return F.when(apart, F.concat(acc, F.array(s))).otherwise(F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wide)))

    whole = F.aggregate(ordered(spans, KINDS), empty, join)

    def rebuilt(one: Column) -> Column:
        before = lambda i: F.when(i == 0, 0).otherwise(F.get(one, i - 1)["end"])
        pieces = F.transform(one, lambda s, i: F.concat(F.substring(text, before(i) + 1, s["start"] - before(i)), F.when((s["kind"] == "term") & (s["value"] == "remove"), "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))))
        end = F.coalesce(F.try_element_at(one, F.lit(-1))["end"], F.lit(0))
        return F.concat(F.array_join(pieces, ""), F.substring(text, end + 1, 2**31 - 1))

    return F.when(F.size(spans) == 0, text).otherwise(F.element_at(F.transform(F.array(whole), rebuilt), 1))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    out = find_pii(table(spark, sf_dir, "documents"))
    return out.withColumn("sanitised_sha256", F.sha2("sanitised", 256)).drop("sanitised")
