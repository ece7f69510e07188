"""Personal data by patterns, and information-theoretic sanitisation of what surrounds it.

Everything here is DataFrame and SQL functions.

Base spans are the leftmost non-overlapping matches of each kind's pattern that pass the kind's check.
Terms in the documents of an entity (a base value) can give it away.  How strongly is estimated from the corpus: a
term t tells PMI(t; e) = log2(N n(t,e) / (n(t) n(e))) of the entity's information IC(e) = log2(N / n(e)),
with n counting documents.  Terms that tell at least `disclosure` of IC(e) are spans of kind `term`,
for entities of a single document too; `sanitise` removes them and generalises entities to their kind.

A term is a run of at least three letters, lower-cased, anywhere in the text.  Every place of a telling
term in a document that holds the entity is a span, except where it overlaps a base span.

Defined results: a null text counts as empty and has no spans; rows that repeat both id and text share
their spans and count as one document; a null id is an id of its own; other columns stay as they are.
Marker characters U+E000 and U+E001 in a text count as U+E002 while positions are found; they are in
no pattern.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, unused, written

KINDS = ["email", "ip", "card", "phone", "term"]

#: The contract's patterns.  Runs are possessive and begin only where a run can begin, which matches
#: the same places without trying every suffix of a long run and without recursion.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these has no match.
HINTS = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"),
    "phone": lambda t: t.contains("+"),
}
OPEN, CLOSE, OTHER = "\ue000", "\ue001", "\ue002"
TERM = r"\p{L}{3,}+"
PIECE = "array<struct<pos:int,piece:string>>"


def _bound(value: Column, body) -> Column:
    """body(value) with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _placed(pieces: Column, at: Column) -> Column:
    """Each piece with its position, the first one at `at`."""
    return F.aggregate(
        pieces,
        F.struct(F.array().cast(PIECE).alias("done"), at.alias("at")),
        lambda acc, x: F.struct(F.concat(acc["done"], F.array(F.struct(acc["at"].alias("pos"), x.alias("piece")))).alias("done"), (acc["at"] + F.char_length(x)).alias("at")),
        lambda acc: acc["done"],
    )


def _pieces(text: Column, pattern: str) -> Column:
    """The text cut at the matches, each piece with its position; every second piece is a match.

    Positions are summed within runs of about the square root of all pieces, and over the runs, so that
    no long array is copied for each piece.
    """
    cut = F.split(F.regexp_replace(text, F.lit(pattern), F.lit(f"{OPEN}$0{CLOSE}")), f"[{OPEN}{CLOSE}]", -1)
    length = lambda run: F.aggregate(run, F.lit(0), lambda n, x: n + F.char_length(x))
    begins = lambda runs: F.aggregate(
        runs,
        F.struct(F.array().cast("array<int>").alias("done"), F.lit(0).alias("at")),
        lambda acc, run: F.struct(F.concat(acc["done"], F.array(acc["at"])).alias("done"), (acc["at"] + length(run)).alias("at")),
        lambda acc: acc["done"],
    )

    def runs(pieces: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(pieces))).cast("int")
        return _bound(size, lambda n: F.transform(F.sequence(F.lit(1), F.size(pieces), n), lambda at: F.slice(pieces, at, n)))

    return _bound(
        _bound(cut, runs),
        lambda part: _bound(begins(part), lambda starts: F.flatten(F.transform(part, lambda run, i: _placed(run, F.get(starts, i))))),
    )


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digit string passes the Luhn check."""
    total = F.aggregate(
        F.split(F.reverse(digits), ""),
        F.struct(F.lit(0).alias("sum"), F.lit(0).alias("i")),
        lambda acc, x: F.when(x == "", acc).otherwise(
            F.struct((acc["sum"] + F.when(acc["i"] % 2 == 0, x.cast("int")).otherwise(F.when(x.cast("int") > 4, x.cast("int") * 2 - 9).otherwise(x.cast("int") * 2))).alias("sum"), (acc["i"] + 1).alias("i"))
        ),
        lambda acc: acc["sum"],
    )
    return total % 10 == 0


def _passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        lean = lambda p: F.ltrim(p, F.lit("0"))
        small = lambda p: (F.char_length(lean(p)) <= 3) & (F.concat(F.lit("0"), F.substring(lean(p), 1, 3)).cast("int") <= 255)
        return F.forall(F.split(value, r"\."), small)
    n = F.char_length(_digits(value))
    if kind == "card":
        return n.between(12, 19) & luhn(_digits(value))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


SPAN = "array<struct<start:int,ord:int,end:int,value:string>>"


def _matches(text: Column, kind: str) -> Column:
    """The spans of one kind."""
    nth = KINDS.index(kind)

    def spans(pieces: Column) -> Column:
        found = F.transform(
            pieces,
            lambda x, i: F.when(
                (i % 2 == 1) & _passes(kind, x["piece"]),
                F.struct(
                    x["pos"].alias("start"),
                    F.lit(nth).alias("ord"),
                    (x["pos"] + F.char_length(x["piece"])).alias("end"),
                    x["piece"].alias("value"),
                ),
            ),
        )
        return F.filter(found, lambda x: x.isNotNull())

    marked = F.translate(text, OPEN + CLOSE, OTHER * 2)
    return F.when(HINTS[kind](text), _bound(_pieces(marked, PATTERNS[kind]), spans).cast(SPAN)).otherwise(F.array().cast(SPAN))


def base_spans(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, version of the text, base spans sorted by start and kind, the text if there are any) of every row, written once."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    every = F.array_sort(F.concat(*(_matches(text, kind) for kind in KINDS[:4])))
    found = _bound(every, lambda b: F.struct(b.alias("base"), F.when(F.size(b) > 0, text).alias("text")))
    kept = written(docs.select(F.col(id_column).alias("_id"), F.xxhash64(text).alias("_version"), found.alias("_found")), "pii-spans")
    return kept.select("_id", "_version", F.col("_found.base").alias("_base"), F.col("_found.text").alias("_text"))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(f"({TERM})")), F.lower))


def _places(texts: DataFrame) -> DataFrame:
    """(_doc, term, start, end) of every term of (_doc, _text)."""
    marked = F.translate("_text", OPEN + CLOSE, OTHER * 2)
    cut = F.split(F.regexp_replace(marked, F.lit(TERM), F.lit(f"{OPEN}$0{CLOSE}")), f"[{OPEN}{CLOSE}]", -1)
    pieces = texts.select("_doc", F.posexplode(cut).alias("i", "piece")).select("_doc", "i", F.lower("piece").alias("term"), F.char_length("piece").alias("n"))
    end = F.sum("n").over(Window.partitionBy("_doc").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    return pieces.withColumn("end", end).where(F.col("i") % 2 == 1).select("_doc", "term", (F.col("end") - F.col("n")).alias("start"), "end")


def term_spans(docs: DataFrame, base: DataFrame, disclosure: float = 0.8, text_column: str = "text") -> DataFrame:
    """(id, version, spans of kind term): the terms of documents with base spans that give an entity of theirs away."""
    entities = F.array_distinct(F.transform("_base", lambda s: F.xxhash64(s["ord"], s["value"])))
    bare = F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    met = base.where(F.size("_base") > 0).dropDuplicates(["_id", "_version"])
    met = written(met.select(F.monotonically_increasing_id().alias("_doc"), "_id", "_version", entities.alias("_entities"), bare.alias("_bare"), "_text"), "pii-met")
    n_all = float(docs.count())
    inside = met.select("_doc", F.explode("_entities").alias("entity"))
    entity = written(inside.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") < n_all), "pii-entities")
    # n(t, e) <= n(e), so that a telling term has n(t) <= N (n(e) / N) ** disclosure; others need no pair
    most = lambda n_e: (1 + 1e-9) * n_all * F.pow(n_e / F.lit(max(n_all, 1.0)), F.lit(disclosure))
    largest = entity.agg(F.max("n_e")).first()[0] or 0
    term = docs.select(F.explode(_terms(F.coalesce(F.col(text_column), F.lit("")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).where(F.col("n_t") <= most(F.lit(largest)))
    held = met.select("_doc", F.explode(_terms(F.col("_text"))).alias("term")).join(term, "term")
    pair = written(held.join(inside.join(entity, "entity"), "_doc").where(F.col("n_t") <= most(F.col("n_e"))), "pii-pairs")
    pmi = F.log2(n_all * F.col("n_te") / (F.col("n_t") * F.col("n_e")))
    scored = pair.groupBy("entity", "term", "n_e", "n_t").agg(F.count(F.lit(1)).alias("n_te"))
    telling = scored.where(pmi >= disclosure * F.log2(n_all / F.col("n_e"))).select("entity", "term")
    told = written(pair.join(telling, ["entity", "term"]).select("_doc", "term").distinct(), "pii-told")
    discard(pair, entity)
    inner = met.join(told.select("_doc").distinct(), "_doc", "left_semi")
    places = _places(inner).join(told, ["_doc", "term"]).select("_doc", "start", "end", F.lit(True).alias("own"))
    bases = inner.select("_doc", F.explode("_bare").alias("s")).select("_doc", "s.start", "s.end", F.lit(False).alias("own"))
    # in the order of their starts, a term overlaps a base span if one before ends after its start or one after starts before its end
    ahead = Window.partitionBy("_doc").orderBy("start")
    reach = F.max(F.when(~F.col("own"), F.col("end"))).over(ahead.rangeBetween(Window.unboundedPreceding, 0))
    following = F.min(F.when(~F.col("own"), F.col("start"))).over(ahead.rangeBetween(0, Window.unboundedFollowing))
    apart = (F.coalesce("reach", F.col("start")) <= F.col("start")) & (F.coalesce("following", F.col("end")) >= F.col("end"))
    free = places.unionByName(bases).withColumns({"reach": reach, "following": following}).where(F.col("own") & apart)
    spans = free.groupBy("_doc").agg(F.collect_set(F.struct("start", F.lit(4).alias("ord"), "end")).alias("_terms"))
    return spans.join(met.select("_doc", "_id", "_version"), "_doc").select("_id", "_version", "_terms")


def find(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **limits: float) -> DataFrame:
    """Per row: id, version, base spans and all spans (start, ord, end), both sorted."""
    base = base_spans(docs, id_column, text_column)
    terms = term_spans(docs, base, text_column=text_column, **limits).withColumnRenamed("_id", "_t_id").withColumnRenamed("_version", "_t_version")
    narrow = base.select("_id", "_version", F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["end"].alias("end"))).alias("base"))
    joined = narrow.join(terms, F.col("_id").eqNullSafe(F.col("_t_id")) & (F.col("_version") == F.col("_t_version")), "left")
    every = F.array_sort(F.concat("base", F.coalesce("_terms", F.array().cast("array<struct<start:int,ord:int,end:int>>"))))
    return joined.select(F.col("_id").alias(id_column), "_version", "base", every.alias("spans"))


def _text(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["ord"]), s["start"], s["end"])), ",")


def digest(found: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """The contract's columns of find()."""
    count = lambda k: F.size(F.filter("base", lambda s: s["ord"] == k)).cast("long")
    return found.select(id_column, *(count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])), F.sha2(_text("base"), 256).alias("base_sha256"), _text("spans").alias("spans"))


def sanitise(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **limits: float) -> DataFrame:
    """The documents with entities generalised to their kind in brackets and telling terms removed."""
    found = find(docs, id_column, text_column, **limits).where(F.size("spans") > 0).dropDuplicates([id_column, "_version"])
    names = F.array(*(F.lit(f"[{k}]" if k != "term" else "") for k in KINDS))
    # what stands before each span that begins beyond all spans before it, and the span's name
    ahead = Window.partitionBy(id_column, "_version").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    parts = found.select(id_column, "_version", F.explode("spans").alias("s")).withColumn("at", F.coalesce(F.max("s.end").over(ahead), F.lit(0)))
    part = F.struct("s", "at", F.when(F.col("s.start") >= F.col("at"), F.get(names, F.col("s.ord"))).otherwise(F.lit("")).alias("name"))
    cuts = parts.groupBy(id_column, "_version").agg(F.array_sort(F.collect_list(part)).alias("parts"), F.max("s.end").alias("end"))
    own, version, pieces, end = (unused(docs, c) for c in ("_id", "_version", "_parts", "_end"))
    text = F.coalesce(F.col(text_column), F.lit(""))
    joined = docs.join(cuts.toDF(own, version, pieces, end), F.col(id_column).eqNullSafe(F.col(own)) & (F.xxhash64(text) == F.col(version)), "left")
    between = lambda points, a, b: F.array_join(F.slice(points, a + 1, F.greatest(b - a, F.lit(0))), "")
    rebuilt = _bound(  # over the code points, so that no position is counted from the start again
        F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)),
        lambda points: F.concat(F.array_join(F.transform(pieces, lambda p: F.concat(between(points, p["at"], p["s"]["start"]), p["name"])), ""), between(points, F.col(end), F.size(points))),
    )
    return joined.select(*(F.when(F.col(pieces).isNull(), F.col(c)).otherwise(rebuilt).alias(c) if c == text_column else F.col(c) for c in docs.columns))
