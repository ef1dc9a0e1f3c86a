"""Personal data: patterns, and terms that give a protected entity away.

Patterns find the protected entities (e-mail, IP, card and phone numbers). Then corpus statistics
decide which other terms disclose one (Sanchez and Batet's information-theoretic sanitisation):
with IC(e) = -log2 P(e) and PMI(e, t) = log2 P(e, t) / (P(e) P(t)), a term t of a document that
holds an entity e discloses it when PMI(e, t) >= THRESHOLD * IC(e), that is, when seeing t tells at
least that share of e's information, and when P(e | t) >= MIN_SHARE, as in a large corpus the first
alone is met by terms that nearly all occur elsewhere. P counts whole documents, and t counts as if
one more document held it without e: so a term seen with e once and nowhere else discloses it only
in a corpus large enough for that to mean something. Such terms are removed like the entities
themselves, in the documents that hold the entity.

Everything is built-in expressions. A match's place is the summed length of what lies before it:
the pieces between matches (``split``) and the matches (``regexp_extract_all``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.tables import let, text_key
from casework.operators.joins import lookup
from casework.workspace import freeze

# What a match of each kind is. Possessive repeats and the start condition of the
# e-mail change no match (nothing that follows could make them give back); they keep long runs of
# one character linear.
KINDS = ("email", "ip", "card", "phone", "term")
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
HINTS = {"email": "@", "ip": ".", "card": None, "phone": "+"}  # a text without it has no match
_BYTE = r"^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"
_TERM = r"[\p{L}\p{M}\p{N}]+"

_MATCHES = "array<struct<kind:int,i:int,gap:bigint,value:string>>"

THRESHOLD = 0.8
MIN_SHARE = 0.5


def _found(kind: str) -> Column:
    """All matches of a kind: order, code points since the last match, and value."""
    pattern = PATTERNS[kind]

    def matches(gaps: Column) -> Column:
        return F.transform(
            F.regexp_extract_all("text", F.lit(pattern), F.lit(0)),
            lambda v, i: F.struct(
                F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"),
                F.length(F.get(gaps, i)).cast("long").alias("gap"), v.alias("value")))

    whole = let(F.split("text", pattern, -1), matches)
    hint = HINTS[kind]
    possible = F.col("text").contains(hint) if hint else F.col("text").rlike("[0-9]{2}|[0-9][ -][0-9]")
    return F.when(possible, whole).otherwise(F.array().cast(_MATCHES))


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, -i, 1).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def _valid() -> Column:
    value, digits = F.col("value"), F.regexp_replace("value", "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(F.col("kind") == 0, True)
        .when(F.col("kind") == 1, F.forall(F.split(value, r"\."), lambda p: p.rlike(_BYTE)))
        .when(F.col("kind") == 2, F.when(n.between(14, 19), _luhn(digits)).otherwise(False))
        .otherwise(n.between(10, 15)))


def _named(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.select(F.col("doc_id"), text_key(), text.alias("text"))
    return named.select(F.struct("doc_id", "text_key").alias("row"), "text")


def entities(docs: DataFrame) -> DataFrame:
    """(row, kind, start, end, value) of every valid match, places in code points."""
    kinds = [k for k in KINDS if k in PATTERNS]
    found = _named(docs).select("row", F.inline(F.concat(*[_found(k) for k in kinds])))
    found = found.dropDuplicates(["row", "kind", "i"])  # rows that agree in id and text
    so_far = Window.partitionBy("row", "kind").orderBy("i")
    size = F.length("value").cast("long")
    end = F.sum(F.col("gap") + size).over(so_far.rowsBetween(Window.unboundedPreceding, 0))
    return found.withColumn("end", end).withColumn("start", F.col("end") - size).where(_valid())


def _terms(text: str = "text") -> Column:
    return F.regexp_extract_all(text, F.lit(_TERM), F.lit(0))


def _each_term(rows: DataFrame, *kept: str | Column) -> DataFrame:
    """(kept, term) for every different term of every text, in lower case."""
    return rows.select(*kept, F.explode(F.array_distinct(F.transform(_terms(), F.lower))).alias("term"))


def _holders(docs: DataFrame, held: DataFrame) -> DataFrame:
    """(row, text) of the documents with an entity; what cannot hold one is not moved."""
    text = F.col("text")
    digits = text.rlike(r"(?:[0-9][ -]?){13}[0-9]") | text.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]")
    likely = _named(docs).where(text.contains("@") | text.contains("+") | digits)
    return lookup(likely, held.select("row").distinct(), "row", "left_semi").dropDuplicates(["row"])


def _held(found: DataFrame) -> DataFrame:
    """(row, who): what entities a document holds, those of the same documents counted as one.

    ``who`` has the number of documents ``n`` and two checksums of their names. Entities that
    share it have the same statistics, so a directory of names is one entity, not thousands.
    """
    entity = F.concat_ws(":", F.col("kind"), F.when(F.col("kind") == 0, F.lower("value"))
                         .when(F.col("kind") == 1, F.col("value"))
                         .otherwise(F.regexp_replace("value", "[^0-9]", "")))
    held = freeze(found.select("row", entity.alias("entity")).distinct(), "held")
    who = F.struct(F.count("*").alias("n"), F.bit_xor(F.xxhash64("row")).alias("x"),
                   F.bit_xor(F.xxhash64("row", F.lit(1))).alias("y"))
    same = held.groupBy("entity").agg(who.alias("who"))
    return lookup(held, same, "entity", "inner").select("row", "who").distinct()


def _term_counts(docs: DataFrame, again: DataFrame) -> DataFrame:
    """(term, with_term): how many documents hold it; ``again`` has the rows that come repeatedly."""
    repeated = lookup(_named(docs), again, "row", "inner").dropDuplicates(["row"])
    each = _each_term(_named(docs), F.lit(1).cast("long").alias("n"))
    less = _each_term(repeated, (1 - F.col("count")).alias("n"))
    return each.union(less).groupBy("term").agg(F.sum("n").alias("with_term"))


def revealing(docs: DataFrame, holders: DataFrame, held: DataFrame, threshold: float) -> DataFrame:
    """(row, term) where the term discloses an entity of the document.

    A term in more than n^threshold * N^(1 - threshold) or n / MIN_SHARE documents cannot disclose
    an entity of n, as no more than n hold both. Common terms leave before any pair is formed.
    """
    again = freeze(_named(docs).groupBy("row").count().where("count > 1"), "again")
    more, most = again.agg(F.sum(F.col("count") - 1)).first()[0], held.agg(F.max("who.n")).first()[0]
    total = F.lit(float(docs.count() - (more or 0)))

    def limit(n: Column) -> Column:
        by_pmi = F.pow(n.cast("double"), F.lit(threshold)) * F.pow(total, F.lit(1 - threshold)) * 1.0001
        return F.least(by_pmi, n / F.lit(MIN_SHARE))

    known = (F.col("with_term") + 1).cast("double")
    counts = _term_counts(docs, again).where(known <= limit(F.lit(most or 0)))
    seen = lookup(_each_term(holders, "row"), freeze(counts, "terms"), "term", "inner")
    met = seen.join(held, "row").where(known <= limit(F.col("who.n")))
    met = freeze(met.select("row", F.struct("who", "term").alias("pair"), "with_term"), "met")
    n = F.col("pair.who.n").cast("double")
    share, pmi = F.log2(total / n), F.log2(F.col("both") * total / (n * known))
    pairs = met.groupBy("pair").agg(F.count("*").alias("both"), F.min("with_term").alias("with_term"))
    pairs = pairs.where((share > 0) & (pmi >= threshold * share) & (F.col("both") >= MIN_SHARE * known)).select("pair")
    return lookup(met, pairs, "pair", "left_semi").select("row", F.col("pair.term").alias("term")).distinct()


def _places(holders: DataFrame, flagged: DataFrame) -> DataFrame:
    """(row, kind, start, end) of every occurrence of a document's flagged terms."""
    rows = lookup(holders, flagged.select("row").distinct(), "row", "left_semi")
    sizes = rows.select("row", let(F.split("text", _TERM, -1), lambda gaps: F.transform(
        _terms(), lambda v, i: F.struct(
            F.length(F.get(gaps, i)).cast("long").alias("gap"), F.length(v).cast("long").alias("n"),
            F.lower(v).alias("term")))).alias("words"))
    words = sizes.select("row", F.posexplode("words").alias("i", "word")).select("row", "i", "word.*")
    so_far = Window.partitionBy("row").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    words = words.withColumn("end", F.sum(F.col("gap") + F.col("n")).over(so_far))
    found = lookup(words.withColumn("key", F.struct("row", "term")),
                   flagged.select(F.struct("row", "term").alias("key")), "key", "left_semi")
    return found.select("row", F.lit(KINDS.index("term")).alias("kind"),
                        (F.col("end") - F.col("n")).alias("start"), "end")


def _spans(docs: DataFrame, threshold: float) -> DataFrame:
    """(row, kind, start, end) of entities and of revealing terms that touch no entity."""
    found = freeze(entities(docs), "entities")
    held = freeze(_held(found), "who")
    holders = freeze(_holders(docs, held), "holders")
    flagged = _places(holders, freeze(revealing(docs, holders, held, threshold), "flagged"))
    spans = found.select("row", "kind", "start", "end").union(flagged)
    order = Window.partitionBy("row").orderBy("start", "kind")
    base_end = F.when(F.col("kind") < 4, F.col("end"))
    base_start = F.when(F.col("kind") < 4, F.col("start"))
    spans = spans.withColumns({
        "reached": F.max(base_end).over(order.rowsBetween(Window.unboundedPreceding, -1)),
        "next": F.min(base_start).over(order.rowsBetween(1, Window.unboundedFollowing))})
    free = (F.coalesce("reached", F.lit(0)) <= F.col("start")) & (
        F.col("next").isNull() | (F.col("next") >= F.col("end")))
    return spans.where((F.col("kind") < 4) | free).select("row", "kind", "start", "end")


def find_personal_data(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, spans) of every row of ``docs``; spans are (start, kind, end), sorted.

    ``kind`` is the place in ``KINDS``; places are code points, the end exclusive. Null and empty
    texts have no spans. Rows that agree in doc_id and text get the same spans; null ids and other
    columns are fine; an empty table gives an empty result.
    """
    spans = freeze(_spans(docs, threshold), "spans")
    listed = spans.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    rows = _named(docs).select("row")
    out = lookup(rows, listed, "row")
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return out.select("row.doc_id", "row.text_key", F.coalesce("spans", empty).alias("spans"))


def sanitise(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with personal data in ``text`` generalised to its kind (``<email>``, ``<term>``).

    Overlapping spans become the first one's kind. Null texts stay null.
    """
    spans = freeze(_spans(docs, threshold), "spans")
    order = Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.withColumn("last", F.coalesce(F.max("end").over(order), F.lit(0)))
    listed = spans.groupBy("row").agg(
        F.sort_array(F.collect_list(F.struct("start", "kind", "end", "last"))).alias("spans"))
    label = F.array(*[F.lit(f"<{k}>") for k in KINDS])

    def piece(s: Column) -> Column:
        gap = F.substring("text", (s["last"] + 1).cast("int"), (s["start"] - s["last"]).cast("int"))
        return F.when(s["start"] >= s["last"], F.concat(gap, F.get(label, s["kind"]))).otherwise("")

    done = F.array_max(F.transform("spans", lambda s: s["end"])).cast("int")
    text = F.concat(F.array_join(F.transform("spans", piece), ""),
                    F.substring("text", done + 1, F.length("text")))
    keyed = docs.select(
        F.struct(*docs.columns).alias("all"), F.struct("doc_id", text_key()).alias("row"), "text")
    out = lookup(keyed, listed, "row")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(text)
    return out.select(*[
        text.alias("text") if c == "text" else F.col("all").getField(c).alias(c) for c in docs.columns])


def digest(found: DataFrame) -> DataFrame:
    """Counts, a hash of the pattern spans, and all spans as text."""
    def listed(spans: Column) -> Column:
        name = F.array(*[F.lit(k) for k in KINDS])
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(
            ":", F.get(name, s["kind"]), s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        k = KINDS.index(kind)
        return F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] < 4)
    return found.select(
        "doc_id", *[count(k) for k in KINDS[:4]], F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"), *[count(k) for k in KINDS[4:]],
        F.size("spans").cast("long").alias("n_spans"))
