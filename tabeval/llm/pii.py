"""Personal data: pattern spans, and the terms that give the same entity away.

Built-in functions only. Patterns find emails, IP addresses, card and phone numbers. Each is a protected
entity, and so is what its owner shares with others: an email's domain, an address's first three numbers,
a card's first six digits, a phone's first six. The corpus tells how much a term t reveals of an entity e:

    IC(e) = -log2( n(e) / N ),   PMI(e; t) = log2( n(e,t) N / (n(e) n(t)) ) = IC(e) + log2( n(e,t) / n(t) )

with n(e,t) the texts that hold both, n(e) and n(t) those that hold the entity and the term, and N all
different texts. Few texts are weak evidence, so n(e,t) / n(t) is taken at its lower Wilson bound. What
IC leaves above PMI is hidden from a reader of the term; a term that hides at most HIDDEN_BITS discloses
the entity even when the entity itself is cut out. It is generalised to its first letters, as many as so
many texts share that they don't disclose the entity in turn, or removed where it hides nearly nothing or
no first letters are shared enough; wherever it stands in the corpus.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import free_names, named
from ..operators.ordered import checked
from .common import freeze

#: the patterns, written so that no attempt scans a run of characters twice: an attempt starts where a
#: run starts or the last match ended, and repeats are possessive (nothing after them can use what they took)
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(PATTERNS)
BYTE = "0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
#: words of letters and digits, also with apostrophes inside
TERM = r"[\p{L}\p{N}]++(?:['\x{2019}][\p{L}\p{N}]++)*+"
#: standard errors that evidence is lowered by: a term of one text hides one bit, of two texts 0.6
Z = 1.0
#: bits of an entity that a term may hide and still disclose it, and so few that it is removed
HIDDEN_BITS, REMOVED_BITS = 1.0, 0.15
#: a term is generalised to so many of its first letters
CLASSES = (3, 1)
#: terms in more texts than one in so many (text, term) pairs are broadcast: at most as many terms
FREQUENT = 50_000
#: elements whose running sum is taken at once, and code points cut from at once
BLOCK, PIECE = 64, 1024

SPAN = "struct<start:int,end:int,value:string>"
PLACE = "struct<start:int,end:int,by:string>"


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also where ``body`` uses it for each element of an array."""
    return F.element_at(F.transform(F.array(value), lambda v: body(v)), 1)


def running(values: Column, op) -> Column:
    """``op`` (sum or greatest) of 0 and all values before each, by blocks: appending to an array copies it,
    so one pass over a long array would take the square of its length."""
    def scan(items: Column, of) -> Column:
        return F.aggregate(items, F.array(F.lit(0)), lambda done, x: F.concat(done, F.array(op(F.element_at(done, -1), of(x)).cast("int"))))

    def blocks(all_values: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(0), F.shiftright(F.size(all_values), BLOCK.bit_length() - 1)),
                          lambda b: F.slice(all_values, b * BLOCK + 1, F.lit(BLOCK)))
        return F.transform(cut, lambda block: scan(block, lambda v: v))

    def joined(inner: Column) -> Column:
        offsets = scan(inner, lambda block: F.element_at(block, -1))
        return F.flatten(F.zip_with(inner, F.slice(offsets, F.lit(1), F.size(inner)), lambda block, before: F.transform(
            F.slice(block, F.lit(1), F.size(block) - 1), lambda v: op(before, v).cast("int"))))

    return let(let(values, blocks), joined)


def add(a: Column, b: Column) -> Column:
    return a + b


def matches(text: Column, pattern: str) -> Column:
    """All matches, leftmost and not overlapping, as array<start, end, value> in code points."""
    def placed(both: Column) -> Column:
        found, gaps = both["found"], both["gaps"]  # one more gap than matches; the last one counts for nothing
        gaps = F.slice(gaps, F.lit(1), F.size(found))
        starts = F.zip_with(running(F.zip_with(gaps, found, lambda g, v: F.length(g) + F.length(v)), add), gaps,
                            lambda before, g: before + F.length(g))
        return F.zip_with(starts, found, lambda at, v: F.struct(
            at.alias("start"), (at + F.length(v)).alias("end"), v.alias("value"))).cast(f"array<{SPAN}>")

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")), placed)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(total: Column, k: Column) -> Column:
        digit = F.substring(number, -k, F.lit(1)).cast("int")
        twice = digit * (F.lit(2) - k % 2)  # even places from the right count double
        return total + twice - F.when(twice > 9, 9).otherwise(0)
    # ``-k`` counts from the right, from 1: odd places single, even places double
    number = F.when(F.length(number) > 0, number)
    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0),
                       lambda total, k: add(total, k)) % 10 == 0


def base_spans(text: Column, kind: str) -> Column:
    """The valid spans of one kind; a match that fails its check is dropped."""
    def valid(span: Column) -> Column:
        value = span["value"]
        if kind == "ip":
            return value.rlike(rf"^{BYTE}(?:\.{BYTE}){{3}}$")
        if kind == "card":
            return F.length(digits(value)).between(16, 19) & luhn(F.when(F.length(digits(value)).between(16, 19), digits(value)))
        if kind == "phone":
            return F.length(digits(value)).between(8, 15)
        return F.lit(True)
    sign = {"email": "@", "ip": ".", "phone": "+"}.get(kind)
    # texts without the sign, or without sixteen digits in close order, hold none
    maybe = text.contains(sign) if sign else text.rlike(r"(?:[0-9][\x20-]?){15}[0-9]")
    return F.when(maybe, F.filter(matches(text, PATTERNS[kind]), valid)).otherwise(F.array().cast(f"array<{SPAN}>"))


def cut_out(content: Column, cuts: Column, by) -> Column:
    """``content`` with each of the sorted ``cuts`` (start, end, ...) replaced by ``by(cut, reach)``; ``reach`` is
    the end of the cuts before it, so a cut that starts before it overlaps one."""
    def cut(both: Column) -> Column:
        blocks, sorted_cuts = both["blocks"], both["cuts"]

        def piece(start: Column, end: Column) -> Column:
            first = F.floor(start / PIECE).cast("int")
            some = F.array_join(F.slice(blocks, first + 1, F.floor(end / PIECE).cast("int") - first + 1), "")
            return F.when(end > start, F.substring(some, start % PIECE + 1, end - start)).otherwise("")

        ends = F.transform(sorted_cuts, lambda c: c["end"])
        parts = F.zip_with(sorted_cuts, running(ends, F.greatest), lambda c, r: F.concat(piece(r, c["start"]), by(c, r)))
        return F.concat(F.array_join(parts, ""), piece(F.array_max(ends), both["size"]))

    both = F.struct(F.regexp_extract_all(content, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0)).alias("blocks"),
                    cuts.alias("cuts"), F.length(content).alias("size"))
    return F.when(F.size(cuts) > 0, let(both, cut)).otherwise(content)


def masked(content: Column, spans: Column) -> Column:
    """``content`` with its sorted spans blanked; other characters keep their places."""
    return cut_out(content, spans, lambda s, reach: F.repeat(F.lit(" "), F.greatest(s["end"] - F.greatest(s["start"], reach), F.lit(0))))


def text_key(text: Column) -> Column:
    """Identifies a text: equal texts have equal spans."""
    return F.struct(F.xxhash64(text).alias("a"), F.hash(text).alias("b"), F.length(text).alias("c"))


def with_spans(rows: DataFrame) -> DataFrame:
    """Adds per kind the spans of ``_content``, and ``_rest``: the content without what lies in them."""
    for kind in KINDS:
        rows = rows.withColumn(f"_{kind}", base_spans(F.col("_content"), kind))
    every = F.sort_array(F.concat(*[F.transform(f"_{k}", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))) for k in KINDS]))
    return rows.withColumn("_every", every).withColumn("_rest", masked(F.col("_content"), F.col("_every"))).drop("_every")


def entities() -> Column:
    """What a text's spans protect: each value, and what it shares with others of its owner or net."""
    def shared(kind: str, value: Column) -> Column:
        return {"email": F.lower(F.substring_index(value, "@", -1)), "ip": F.substring_index(value, ".", 3),
                "card": F.substring(digits(value), 1, 6), "phone": F.substring(digits(value), 1, 6)}[kind]

    def of(kind: str) -> list[Column]:
        return [F.transform(f"_{kind}", lambda s: F.concat(F.lit(f"{kind}:"), s["value"])),
                F.transform(f"_{kind}", lambda s: F.concat(F.lit(f"{kind}/"), shared(kind, s["value"])))]

    return F.array_distinct(F.concat(*[e for k in KINDS for e in of(k)]))


def find(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """One row per document: the ``keep`` columns as k0, k1, ..., ``_text`` (its text's key), ``_row`` (unique), per
    kind the spans, ``_terms`` (the different words outside entities), and of a text with an entity
    ``_words``, these words with their places. Frozen: a text is read once."""
    content = F.coalesce(named(text), F.lit(""))
    rows = with_spans(docs.select(*[named(c).alias(f"k{i}") for i, c in enumerate(keep)], content.alias("_content")))
    terms = F.array_distinct(F.transform(F.regexp_extract_all(F.col("_rest"), F.lit(TERM), F.lit(0)), F.lower))
    protected = reduce(lambda a, b: a | b, [F.size(f"_{k}") > 0 for k in KINDS])
    return freeze(rows.select(*[f"k{i}" for i in range(len(keep))], text_key(F.col("_content")).alias("_text"),
                              F.monotonically_increasing_id().alias("_row"), *[f"_{k}" for k in KINDS], terms.alias("_terms"),
                              F.when(protected, words(F.col("_rest"))).alias("_words")), "pii")


def words(rest: Column) -> Column:
    """The words of ``rest`` in lower case, with their places."""
    return F.transform(matches(rest, TERM), lambda w: F.struct(F.lower(w["value"]).alias("term"), w["start"].alias("start"), w["end"].alias("end")))


def different(found: DataFrame) -> tuple[DataFrame, int]:
    """The rows of ``found``, one for each different text, and how many these are."""
    texts = freeze(found.groupBy("_text").agg(F.count("*").alias("_n"), F.min("_row").alias("_first")), "texts")
    copied = checked(texts.where("_n > 1").select("_text", "_first"), name="copied")
    first = found.join(copied, "_text", "left")
    return first.where("_first is null or _first = _row").drop("_first"), texts.count()


def lowest_share(part: Column, whole: Column) -> Column:
    """The lower Wilson bound of part / whole, Z standard errors down."""
    p, z2 = part / whole, Z * Z
    return (p + z2 / (2 * whole) - Z * F.sqrt(p * (1 - p) / whole + z2 / (4 * whole * whole))) / (1 + z2 / whole)


def term_counts(once: DataFrame) -> DataFrame:
    """term and n_term, the texts that hold it; added up in each task before they move."""
    return freeze(once.select(F.explode("_terms").alias("term")).groupBy("term").agg(F.count("*").alias("n_term")), "terms")


def holders(once: DataFrame) -> DataFrame:
    """The texts with an entity: ``_text``, ``_terms``, ``_words``, ``_groups`` and ``_most``.

    Entities that stand in the same texts can't be told apart by any term, so they are judged as one group:
    (n_entity, two checksums of its texts). A list of thousands of contacts has one group, not thousands. ``_most``
    is the largest n_entity.
    """
    held = once.where("_words is not null")
    pairs = freeze(held.select("_text", F.explode(entities()).alias("entity")), "entities")
    per = pairs.groupBy("entity").agg(F.count("*").alias("n_entity"), F.bit_xor(F.xxhash64("_text")).alias("x"),
                                      F.bit_xor(F.xxhash64("_text", F.lit(1))).alias("y"))
    groups = pairs.join(checked(per, name="entities"), "entity").groupBy("_text").agg(
        F.collect_set(F.struct("n_entity", "x", "y")).alias("_groups"), F.max("n_entity").alias("_most"))
    return freeze(held.select("_text", "_terms", "_words").join(checked(groups, name="groups"), "_text"), "holders")


def disclosing_terms(found: DataFrame, held: DataFrame | None = None, once: DataFrame | None = None, total: int | None = None) -> DataFrame:
    """term, n_term, hidden (the fewest bits of an entity that it hides), n_entity (of the largest entity it
    discloses) and letters, how many of its first ones may stay (0: it is removed). One row per disclosing term.

    An entity that every text holds tells nothing, so nothing discloses it.
    """
    if once is None:
        once, total = different(found)
    held = holders(once) if held is None else held
    counts = term_counts(once)
    # n(e,t) <= n(e), so a term in more than 2^HIDDEN_BITS texts per text of the entity hides more
    reach = F.col("_most") * 2.0 ** HIDDEN_BITS
    frequent, named_terms = _frequent(counts)
    pairs = held.select("_groups", "_most", F.explode("_terms").alias("term")).join(F.broadcast(frequent), "term", "left")
    known = pairs.where(F.col("n_term") <= reach)
    rare = pairs.where("n_term is null").drop("n_term").join(named_terms, "term").where(F.col("n_term") <= reach)
    both = known.unionByName(rare).select("term", "n_term", F.explode("_groups").alias("e")).where(
        (F.col("e.n_entity") < total) & (F.col("n_term") <= F.col("e.n_entity") * 2.0 ** HIDDEN_BITS))
    together = both.groupBy("term", "n_term", "e").agg(F.count("*").alias("n_both"))
    hidden = -F.log2(lowest_share(F.col("n_both").cast("double"), F.col("n_term").cast("double")))
    told = together.withColumn("hidden", hidden).where(F.col("hidden") <= HIDDEN_BITS).groupBy("term", "n_term").agg(
        F.min("hidden").alias("hidden"), F.max("e.n_entity").alias("n_entity"))
    # first letters that so many texts share that even all of the entity's are a small part of them
    def first(k: int) -> Column:
        return F.transform("_terms", lambda t: F.substring(t, 1, k))

    firsts = F.array_distinct(F.concat(*[first(k) for k in CLASSES]))
    shared = checked(once.select(F.explode(firsts).alias("c")).groupBy("c").agg(F.count("*").alias("n")), name="first-letters")
    kept = F.lit(0)
    for k in sorted(CLASSES):
        side = shared.select(F.col("c").alias(f"c{k}"), F.col("n").alias(f"n{k}"))
        told = told.join(side, F.substring("term", 1, k) == F.col(f"c{k}"), "left")
        enough = (F.length("term") > k) & (F.col(f"n{k}") > F.col("n_entity") * 2.0 ** HIDDEN_BITS)
        kept = F.when(enough, F.lit(k)).otherwise(kept)
    letters = F.when(F.col("hidden") <= REMOVED_BITS, F.lit(0)).otherwise(kept)
    return freeze(told.select("term", "n_term", "hidden", "n_entity", letters.alias("letters")), "disclosing")


def _frequent(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Terms so frequent that there are at most FREQUENT of them, and the others."""
    pairs = counts.agg(F.sum("n_term")).first()[0] or 0
    return counts.where(F.col("n_term") > pairs / FREQUENT), counts.where(F.col("n_term") <= pairs / FREQUENT)


def term_places(docs: DataFrame, once: DataFrame, held: DataFrame, terms: DataFrame, text: str) -> DataFrame:
    """_text and _places: the spans of disclosing terms in each text that has any, sorted, whether or not the
    text spells the entity out."""
    asked = checked(terms.select("term", "letters", "n_term"), name="asked")
    inside = freeze(held.select("_text", F.explode("_words").alias("w")).select("_text", "w.*").join(asked, "term"), "inside")
    # terms that texts without an entity hold too
    seen = inside.groupBy("term").agg(F.countDistinct("_text").alias("n_held"))
    outside = checked(asked.join(seen, "term").where("n_term > n_held").select("term", "letters"), name="outside")
    places = inside.select("_text", "term", "start", "end", "letters")
    if outside.head(1):
        hits = once.where("_words is null").select("_text", F.explode("_terms").alias("term")).join(outside, "term")
        hits = checked(hits.groupBy("_text").agg(F.map_from_entries(F.collect_list(F.struct("term", "letters"))).alias("_letters")), name="hits")
        rows = docs.select(F.coalesce(named(text), F.lit("")).alias("_content")).withColumn("_text", text_key(F.col("_content")))
        rows = rows.join(hits, "_text").select("_text", "_letters", words(F.col("_content")).alias("_words"))
        found = rows.select("_text", F.explode(F.filter("_words", lambda w: F.map_contains_key("_letters", w["term"]))).alias("w"), "_letters")
        places = places.unionByName(found.select("_text", "w.*", F.try_element_at("_letters", F.col("w.term")).alias("letters")).distinct())
    by = F.when(F.col("letters") > 0, F.concat(F.expr("substring(term, 1, letters)"), F.lit("\u2026"))).otherwise("")
    return places.groupBy("_text").agg(F.sort_array(F.collect_list(F.struct("start", "end", by.alias("by")))).cast(f"array<{PLACE}>").alias("_places"))


def spans(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The ``keep`` columns as k0, k1, ..., ``_text``, per kind the spans, and ``_terms``, one row per document.

    Null texts count as empty, repeated rows are counted and returned as they are, an empty table gives
    none. Equal texts get equal spans. A document's spans meet in one row, as its text does.
    """
    found = find(docs, keep, text)
    once, total = different(found)
    held = holders(once)
    places = checked(term_places(docs, once, held, disclosing_terms(found, held, once, total), text), name="places")
    return found.drop("_row", "_terms", "_words").join(places, "_text", "left").withColumn(
        "_terms", F.coalesce(F.col("_places"), F.array().cast(f"array<{PLACE}>"))).drop("_places")


def listed(kinds: list[str]) -> Column:
    """kind:start:end of the spans, by kind in the given order, then start, comma-joined."""
    def part(kind: str) -> Column:
        return F.transform("_terms" if kind == "term" else f"_{kind}", lambda s: F.concat_ws(":", F.lit(kind), s["start"], s["end"]))
    return F.array_join(F.concat(*[part(k) for k in kinds]), ",")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term, n_spans."""
    rows = spans(docs, [key], text)
    counts = [F.size(f"_{k}").cast("long") for k in (*KINDS, "terms")]
    return rows.select(F.col("k0").alias(key), *[c.alias(f"n_{k}") for c, k in zip(counts, KINDS)],
                       F.sha2(listed(KINDS), 256).alias("base_sha256"), listed([*KINDS, "term"]).alias("spans"),
                       counts[-1].alias("n_term"), reduce(add, counts).alias("n_spans"))


def sanitise(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with entities replaced by [EMAIL], [IP], [CARD] or [PHONE], disclosing terms by their first
    letters or nothing. Overlapping spans are cut out together, under the name of the first. Null texts
    stay null. What to cut is broadcast up to BROADCAST_BYTES of Parquet; beyond, texts are shuffled once."""
    places = spans(docs, [], text).where(
        reduce(lambda a, b: a | b, [F.size(c) > 0 for c in (*[f"_{k}" for k in KINDS], "_terms")])).dropDuplicates(["_text"])

    def cut(column: str, by) -> Column:
        return F.transform(column, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), by(s).alias("by")))

    cuts = [cut(f"_{k}", lambda s, k=k: F.lit(f"[{k.upper()}]")) for k in KINDS] + [cut("_terms", lambda s: s["by"])]
    at, cut_at = free_names(docs.columns, ["text_key", "cuts"])
    places = checked(places.select(F.col("_text").alias(at), F.sort_array(F.concat(*cuts)).alias(cut_at)), name="cuts")
    content = named(text)
    clean = cut_out(content, F.col(cut_at), lambda c, reach: F.when(c["start"] >= reach, c["by"]).otherwise(""))
    joined = docs.withColumn(at, text_key(F.coalesce(content, F.lit("")))).join(places, at, "left")
    new = F.when(F.col(cut_at).isNull(), content).otherwise(clean)
    return joined.select(*[(new if c == text else named(c)).alias(c) for c in docs.columns])
