"""Personal data: fixed kinds by pattern, and bootstrapped contexts that find more. Only DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerloom.llm.common import join_hot, keep

# The kinds, in the order that breaks ties, and their patterns. Loops give nothing back (no later sign could use what
# they give back) and start only where a longer match cannot, so that no text, however long, is read again and again.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that any text with such a span passes.
MAYBE = {"email": r"@", "ip": r"[0-9]\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){13}", "phone": r"\+[0-9]"}
#: What may be an identifier that no pattern knows: digits, at least ``LEAST_DIGITS``, with usual signs between.
CANDIDATE = r"(?<![0-9A-Za-z])[+(]?[0-9][\x20().0-9-]*[0-9](?![0-9A-Za-z])"
LEAST_DIGITS = 7


def _found(text, pattern: str, maybe: str):
    """Array of (start, end, hit, gap, next) of all matches, from the lengths of the matches and of the text between them; gap and next are what
    stands before and after, 80 characters at most."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    parts = F.arrays_zip(hits.alias("hit"), F.slice(between, F.lit(1), F.size(hits)).alias("gap"), F.slice(between, F.lit(2), F.size(hits)).alias("next"))
    kind = "array<struct<start:bigint,end:bigint,hit:string,gap:string,next:string>>"

    def add(s, x):
        start = s["at"] + F.char_length(x["gap"])
        end = start + F.char_length(x["hit"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), F.right(x["gap"], F.lit(80)).alias("gap"), F.left(x["next"], F.lit(80)).alias("next"))
        return F.struct(end.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(kind).alias("out"))
    some = F.aggregate(parts, begin, lambda s, x: F.struct(add(s, x)["at"].cast("long").alias("at"), add(s, x)["out"].cast(kind).alias("out")), lambda s: s["out"])
    return F.when(text.rlike(maybe), some).otherwise(F.array().cast(kind))


def _digits(hit):
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits):
    """Whether the sum of the digits, every second from the right doubled and its digits added, is a multiple of ten."""
    n = F.char_length(digits)

    def add(s, i):
        d = F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1)
        return s + d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def _holds(kind: str, hit):
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        short = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(hit, r"\."), lambda p: (F.char_length(short(p)) <= 3) & (F.coalesce(short(p).try_cast("int"), F.lit(0)) <= 255))
    n = F.char_length(_digits(hit))
    return F.when(n.between(14, 19), _luhn(_digits(hit))).otherwise(False) if kind == "card" else n.between(10, 15)


def base_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, row, base, phrases): base is the array of (start, kind_no, end), by start and then kind, row a number of the row, and phrases are the
    digit phrases that may be identifiers, as (start, end, hit, gap, next). Every text is read once."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    some = docs.select(F.col("doc_id").cast("long"), text.alias("text"), F.monotonically_increasing_id().alias("row"))
    arrays = []
    for i, kind in enumerate(KINDS):
        some = some.withColumn(kind, _found(F.col("text"), PATTERNS[kind], MAYBE[kind]))
        arrays.append(_kept(kind, i))
    phrases = F.filter(_found(F.col("text"), CANDIDATE, r"[0-9][\x20().0-9-]{5,}"), lambda c: F.char_length(_digits(c["hit"])) >= LEAST_DIGITS)
    return some.withColumn("base", F.array_sort(F.concat(*arrays))).select("doc_id", "row", "base", phrases.alias("phrases"))


def _kept(kind: str, number: int):
    ok = F.filter(F.col(kind), lambda x: _holds(kind, x["hit"]))
    return F.transform(ok, lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind"), x["end"].alias("end")))


def _word(text, n: int):
    """The ``n``-th word of a text, from 1 on or from the end; lower case, without signs around it."""
    words = F.split(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")), " ")
    return F.lower(F.regexp_replace(F.coalesce(F.try_element_at(words, F.lit(n)), F.lit("")), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))


def contextual_spans(rows: DataFrame, rounds: int = 5, sure: float = 0.8, seeds: int = 3) -> DataFrame:
    """(row, more): spans that contexts of known ones point at, as (start, kind_no, end).

    A lexical pattern is the two words before a digit phrase, or the word before and the word after it, with the phrase's number of digits in
    three classes; how it is grouped and which signs it has is left open. Phrases that lie in base spans are the seeds. Patterns and phrases form
    a graph: a pattern is as sure as its phrases are on average, a phrase that is no seed as sure as that one of its patterns is right.
    Rounds go on until no pattern becomes or ceases to be sure, ``rounds`` at most. Phrases of patterns that are ``sure``, and had at least
    ``seeds`` different seeds, are spans of the kind that most of these seeds have.
    """
    found = rows.select("row", "base", F.explode("phrases").alias("c"))
    n = F.char_length(_digits(F.col("c.hit")))
    size = F.when(n < 10, "7").when(n <= 15, "10").otherwise("16")
    last = _word(F.col("c.gap"), -1)
    patterns = F.array(F.concat_ws("\t", F.lit("before"), _word(F.col("c.gap"), -2), last, size), F.concat_ws("\t", F.lit("around"), last, _word(F.col("c.next"), 1), size))
    inside = F.filter("base", lambda b: (b["start"] <= F.col("c.start")) & (b["end"] >= F.col("c.end")))
    touching = F.exists("base", lambda b: (b["start"] < F.col("c.end")) & (b["end"] > F.col("c.start")))
    found = found.select(
        "row", F.col("c.start").alias("start"), F.col("c.end").alias("end"), _digits(F.col("c.hit")).alias("phrase"), touching.alias("known"),
        F.get(inside, F.lit(0))["kind"].alias("seed"), F.explode(patterns).alias("pattern"))
    found = keep(found, "phrases")
    edges = keep(found.groupBy("pattern", "phrase").agg(F.max("seed").alias("seed")), "edges")
    phrases = edges.groupBy("phrase").agg(F.max(F.when(F.col("seed").isNotNull(), 1.0).otherwise(0.0)).alias("sure"), F.count("*").alias("n"))
    scored, before = None, None
    for _ in range(rounds):
        told = join_hot(edges, phrases, ["phrase"], "n", "inner").drop("n")
        scored = told.groupBy("pattern").agg((F.sum("sure") / (F.count("*") + 1)).alias("p"), F.count("seed").alias("seeds"), F.mode("seed").alias("kind"), F.count("*").alias("n"))
        scored = keep(scored, "patterns")
        now = scored.filter((F.col("p") >= sure) & (F.col("seeds") >= seeds)).agg(F.count("*"), F.bit_xor(F.xxhash64("pattern"))).first()
        if now == before:
            break
        before = now
        back = join_hot(edges, scored.select("pattern", "p", "n"), ["pattern"], "n", "inner")
        right = F.when(F.max("seed").isNotNull(), 1.0).otherwise(1 - F.exp(F.sum(F.log(F.greatest(F.lit(1e-9), 1 - F.col("p"))))))
        phrases = keep(back.groupBy("phrase").agg(right.alias("sure"), F.count("*").alias("n")), "phrases_scored")
    good = scored.filter((F.col("p") >= sure) & (F.col("seeds") >= seeds)).select("pattern", "kind", "n")
    new = join_hot(found.filter("NOT known"), good, ["pattern"], "n", "inner")
    return new.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "kind", "end"))).alias("more"))


def _written(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """Find e-mail addresses, IP addresses, card and phone numbers, and what their contexts point at, in whole texts.

    Returns (doc_id, n_email, n_ip, n_card, n_phone, base, spans), one row per row of ``docs``; base and spans are written as
    kind:start:end, by start and then kind, in code points with the end exclusive; the counts are those of base, which is part of
    spans. Null or empty text: zeros and empty strings. Repeated rows get the same spans. Other columns are not looked at.
    """
    rows = keep(base_spans(docs), "base_spans")
    more = contextual_spans(rows)
    out = rows.select("doc_id", "row", "base").join(more, "row", "left").withColumn("all", F.array_sort(F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_union("base", "more"))))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return out.select("doc_id", *counts, _written(F.col("base")).alias("base"), _written(F.col("all")).alias("spans"))
