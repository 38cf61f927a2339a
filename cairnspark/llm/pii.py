r"""Personal data: patterns, and terms that disclose them, in DataFrame operations alone.

Base findings are e-mail addresses, IP addresses, card numbers and telephone numbers, found leftmost and without overlap
per kind and then validated. Offsets come from the lengths of matches and of the gaps between them.

The information-theoretic step (after Sanchez and Batet, "C-sanitized"): the corpus tells how much a term reveals of the
protected entities that its texts hold. An entity counts as its value and as what it generalises to (a mail domain, the
first two parts of an address, the first digits of a number, the kind). With document frequencies over distinct texts,

    disclosure(term; entity) = PMI(term; entity) / IC(entity) = log(p(t, e) / (p(t) p(e))) / -log p(e),

1 if the term stands only with the entity; one joint text is discounted, so that chance meetings weigh less. Entities and
pairs need SUPPORT distinct texts to be estimated. Terms that disclose THRESHOLD or more become findings of kind "term"
wherever they stand in texts that hold the entity, outside its base findings. sanitise() replaces base findings by their
kind, generalises terms that give a class or kind away to it, and removes terms that give a value away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairnspark.llm.shared import aside, table, written

#: Fixed patterns. Possessive and guarded forms of the leftmost matches asked for, so that long runs cost linear time:
#: a local part or number can only begin where a run of its characters begins, or where the last match ended.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must contain to be searched at all.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}
SUPPORT, THRESHOLD = 3, 0.8
#: Matches of a text that are walked through together.
RUN = 256
#: Levels of what a finding counts as, the closest first.
CLOSEST = ("value", "class", "kind")
_SPAN = "array<struct<kind:string,start:int,end:int,value:string>>"


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _luhn(digits: Column) -> Column:
    n = F.length(digits)

    def worth(i: Column) -> Column:
        d = F.ascii(F.substring(digits, n - i, F.lit(1))) - 48
        twice = d * 2
        return F.when(i % 2 == 0, d).when(twice > 9, twice - 9).otherwise(twice)

    total = F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda a, i: a + worth(i))
    return total % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    if kind == "ip":
        small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (
            F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255
        )
        return F.forall(F.split(m, r"\."), small)
    if kind == "card":
        digits = F.translate(m, " -", "")
        return F.when(F.length(digits).between(16, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(F.regexp_replace(m, "[^0-9]", "")).between(8, 15)
    return F.lit(True)


def found(kind: str, text: Column) -> Column:
    """Findings of a kind in a text: array of (kind, start, end, value), offsets in code points, end exclusive."""
    pattern = PATTERNS[kind]
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.array().cast(_SPAN)

    def step(acc: Column, pair: Column) -> Column:
        a = acc["at"] + F.length(pair["gap"])
        b = a + F.length(pair["m"])
        one = F.struct(F.lit(kind).alias("kind"), a.alias("start"), b.alias("end"), pair["m"].alias("value"))
        kept = F.when(_valid(kind, pair["m"]), F.concat(acc["out"], F.array(one))).otherwise(acc["out"])
        return F.when(pair["m"].isNull(), acc).otherwise(F.struct(b.alias("at"), kept.alias("out")))

    def walked(pieces: Column) -> Column:
        """Matches after their gaps, RUN at a time: appending copies what is there, so only short arrays are appended to."""
        lengths = F.transform(pieces, lambda p: F.aggregate(p, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))))
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        starts = F.aggregate(lengths, none, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]
        runs = F.arrays_zip(pieces.alias("pairs"), starts.alias("at"))
        return F.flatten(F.transform(runs, lambda r: F.aggregate(r["pairs"], F.struct(r["at"].alias("at"), empty.alias("out")), step)["out"]))

    def cut(pairs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN).cast("int")), lambda i: F.slice(pairs, i * RUN + 1, F.lit(RUN)))

    # Zipped, as a lambda would split the text anew for every match; the last gap has no match.
    spans = _let(F.arrays_zip(gaps.alias("gap"), matches.alias("m")), lambda pairs: _let(cut(pairs), walked))
    likely = F.lit(True) if NEEDED[kind] is None else F.contains(text, F.lit(NEEDED[kind]))
    if kind in ("card", "ip"):
        likely = likely & text.rlike("[0-9]")
    return F.when(text.isNotNull() & likely, spans).otherwise(F.array().cast(_SPAN))


def base_findings(docs: DataFrame) -> DataFrame:
    """docs with a column `base`: findings by kind as listed, then by start. Null and empty texts have none.

    One row out for each row in, a text of any length within its row. A column of the caller named base, terms or clean
    is kept as base_in, terms_in or clean_in, here and below.
    """
    return aside(docs, "base", "terms", "clean").withColumn("base", F.concat(*[found(k, F.col("text")) for k in PATTERNS]))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}{4,}+"), F.lit(0))


def _outside(text: Column) -> Column:
    """The text with blanks in place of its mail addresses: no other finding holds a letter."""
    return F.when(F.contains(text, F.lit("@")), F.regexp_replace(text, PATTERNS["email"], " ")).otherwise(text)


def entities(span: Column) -> Column:
    """What a finding counts as: its value, the class it belongs to, its kind; as level:kind:text."""
    value, digits = F.lower(span["value"]), F.regexp_replace(span["value"], "[^0-9]", "")
    group = (
        F.when(span["kind"] == "email", F.substring_index(value, "@", -1)).when(span["kind"] == "ip", F.substring_index(value, ".", 2))
        .when(span["kind"] == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
    )
    named = lambda level, x: F.concat_ws(":", F.lit(level), span["kind"], x)
    return F.array(named("value", value), named("class", group), named("kind", F.lit("")))


def _with_entities(docs: DataFrame) -> DataFrame:
    """(row, text, base, entities) of texts with findings; rows alike in full become one."""
    held = F.array_distinct(F.flatten(F.transform("base", entities)))
    some = docs.where(F.size("base") > 0).select("text", "base", held.alias("entities"))
    return some.withColumn("row", F.xxhash64("text")).dropDuplicates(["row"])


def disclosing_terms(docs: DataFrame) -> DataFrame:
    """(entity, term, disclosure) from base_findings: terms that give an entity away.

    Frequencies are over distinct texts, so that copies of a text count once.
    """
    some = written(_with_entities(docs), "entity-texts")
    of_entity = some.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_value"))
    of_entity = written(of_entity.where(F.col("n_value") >= SUPPORT), "entities")
    known = some.select("row", F.explode("entities").alias("entity")).join(of_entity.select("entity"), "entity")
    terms = some.select("row", F.array_distinct(_words(_outside(F.col("text")))).alias("terms"))
    pairs = known.join(terms, "row").select("entity", F.explode("terms").alias("term"))
    joint = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= SUPPORT)
    joint = written(joint, "disclosure-pairs")
    texts = docs.where("text is not null").select("text", F.xxhash64("text").alias("h"))
    told = texts.dropDuplicates(["h"]).select(F.explode(F.array_distinct(_words(F.col("text")))).alias("term"))
    # Counted before the join: candidates may be frequent words, and their occurrences outgrow the input. An inner
    # join, as a semi-join would be moved below the count.
    wanted = joint.select("term").distinct()
    of_term = told.groupBy("term").agg(F.count(F.lit(1)).alias("n_term")).join(wanted, "term")
    total = texts.agg(F.approx_count_distinct("h", 0.01).alias("n"))
    p = lambda c: F.col(c) / F.col("n")
    share = F.try_divide(F.log((F.col("both") - 1) / F.col("n") / (p("n_term") * p("n_value"))), -F.log(p("n_value")))
    return (
        joint.join(of_entity, "entity")
        .join(of_term, "term")
        .join(F.broadcast(total))  # one row
        .select("entity", "term", share.alias("disclosure"))
        .where(F.col("disclosure") >= THRESHOLD)
    )


def with_terms(docs: DataFrame) -> DataFrame:
    """base_findings with a column `terms`: spans of disclosing terms in texts that hold the entities they disclose.

    The value of a term's span is level:kind of the closest entity it discloses. Rows are matched by text, so that each
    row, whatever its doc_id, has the spans of its own text.
    """
    bad = written(disclosing_terms(docs), "disclosing-terms")
    some = _with_entities(docs)
    level = F.concat_ws(":", F.substring_index("entity", ":", 2))
    near = F.array_position(F.array(*[F.lit(x) for x in CLOSEST]), F.substring_index("entity", ":", 1))
    bad = bad.groupBy("term").agg(F.collect_set("entity").alias("discloses"))
    told = some.select("row", "entities", F.explode(F.array_distinct(_words(_outside(F.col("text"))))).alias("term")).join(bad, "term")
    told = told.select("row", "term", F.explode(F.array_intersect("entities", "discloses")).alias("entity"))
    told = written(told.groupBy("row", "term").agg(F.min(F.struct(near.alias("near"), level.alias("level")))["level"].alias("level")), "told-terms")
    # Words with offsets, of texts with terms only: gaps and words laid end to end. Mail addresses are matched as such, so
    # that their letters are no words.
    token = PATTERNS["email"] + r"|\p{L}+"
    cut = F.arrays_zip(F.split("text", token, -1).alias("gap"), F.regexp_extract_all("text", F.lit(token), F.lit(0)).alias("word"))
    places = some.join(told.select("row").distinct(), "row", "left_semi").select("row", F.posexplode(cut).alias("pos", "p"))
    end = F.sum(F.length("p.gap") + F.coalesce(F.length("p.word"), F.lit(0))).over(W.partitionBy("row").orderBy("pos"))
    places = places.select("row", F.col("p.word").alias("word"), F.lower("p.word").alias("term"), end.cast("int").alias("end")).where("word is not null")
    spans = places.withColumn("start", F.col("end") - F.length("word")).join(told, ["row", "term"])
    per_row = spans.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct(F.col("start"), F.col("end"), F.col("level").alias("value")))).alias("found")
    )
    per_row = per_row.select("row", F.transform("found", lambda s: F.struct(F.lit("term").alias("kind"), s["start"], s["end"], s["value"])).cast(_SPAN).alias("terms"))
    extra = F.array().cast(_SPAN)
    # The hash is a column of its own, so that texts do not travel with rows that only need their findings.
    keyed = aside(docs, "__row").withColumn("__row", F.xxhash64("text"))
    return keyed.join(per_row.withColumnRenamed("row", "__row"), "__row", "left").drop("__row").withColumn("terms", F.coalesce("terms", extra))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with `base`, `terms` and `clean`: base findings replaced by their kind in brackets, terms generalised or removed.

    A term that discloses a class or kind becomes [about KIND]; one that discloses a value goes. Where findings overlap,
    the first (then the longest) is replaced. Null texts stay null; empty tables stay empty.
    """
    marked = with_terms(base_findings(docs))
    order = F.array_sort(
        F.transform(
            F.concat("base", "terms"),
            lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"), s["value"].alias("value")),
        )
    )
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        about = F.when(s["value"].startswith("value:"), F.lit("")).otherwise(F.concat(F.lit("[about "), F.substring_index(s["value"], ":", -1), F.lit("]")))
        label = F.when(s["kind"] == "term", about).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        piece = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), label)
        return F.when(s["start"] >= acc["at"], F.struct((-s["back"]).alias("at"), piece.alias("out"))).otherwise(acc)

    done = F.aggregate(order, start, step)
    clean = F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text")))
    return marked.withColumn("clean", F.when(F.size(order) > 0, clean).otherwise(F.col("text")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; and n_base, n_term."""
    docs = base_findings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return report(docs)


def report(docs: DataFrame) -> DataFrame:
    """The digest columns of base_findings(docs), one row for each row, and n_base and n_term: spans of either sort."""
    marked = with_terms(docs)

    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in PATTERNS]
    return marked.select(
        "doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "terms")).alias("spans"), F.size("base").cast("long").alias("n_base"), F.size("terms").cast("long").alias("n_term"),
    )
