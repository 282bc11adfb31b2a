"""Point lookups, searches, paging and request checks. All are plain filters that reach the scan."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from offerloom.functions import columns as C, fixed


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def present(*pairs) -> Column:
    """AND of the conditions whose argument was given."""
    cond = F.lit(True)
    for given, make in pairs:
        if given is not None and given != "":
            cond = cond & make(given)
    return cond


def search_offers(df: DataFrame, country=None, degree_type=None, min_gpa=None, max_tuition=None, query=None,
                  text_cols=("university_name", "program_name"), order=("source_url",), limit: int | None = 50,
                  tuition: str = "tuition_fees.international_per_year", gpa: str = "gpa_requirement_min"):
    cond = present(
        (country, lambda v: F.col("country") == v),
        (degree_type, lambda v: F.col("degree_type") == v),
        (min_gpa, lambda v: F.col(gpa) <= v),
        (max_tuition, lambda v: F.col(tuition) <= v),
        (query, lambda v: any_field_contains(text_cols, v)),
    )
    out = df.filter(cond)
    return out if limit is None else out.orderBy(*order).limit(limit)


def any_field_contains(cols, text: str) -> Column:
    """Literal, case-insensitive containment in any of the columns."""
    needle = F.lit(text.lower())
    return C.any_of([F.coalesce(F.lower(F.col(c)).contains(needle), F.lit(False)) for c in cols])


def search_contains(df: DataFrame, contains: dict, equals: dict, order, limit: int = 20, offset: int = 0) -> DataFrame:
    cond = F.lit(True)
    for c, v in contains.items():
        if v:
            cond = cond & any_field_contains([c], v)
    for c, v in equals.items():
        if v is not None:
            cond = cond & (F.col(c) == v)
    return page(df.filter(cond), order, limit, offset)


def search_entities(df: DataFrame, query=None, country=None, tier=None, kind=None, lo=None, hi=None,
                    rank: str = "rank", aliases: str = "aliases", name: str = "name") -> DataFrame:
    def named(v):
        needle = F.lit(v.lower())
        return any_field_contains([name], v) | F.coalesce(
            F.exists(F.col(aliases), lambda a: F.lower(a).contains(needle)), F.lit(False)
        )

    return df.filter(present(
        (query, named),
        (country, lambda v: F.col("country") == v),
        (tier, lambda v: F.col("tier") == v),
        (kind, lambda v: F.col("type") == v),
        (lo, lambda v: F.col(rank) >= v),
        (hi, lambda v: F.col(rank) <= v),
    ))


def has_word(text: Column, word: str) -> Column:
    """Whether a lower-case text contains the word between non-alphanumeric characters."""
    w = re.escape(word)  # the word first: the engine then looks around its occurrences only
    exact = text.rlike(w + r"(?![\p{L}\p{N}])(?<![\p{L}\p{N}]" + w + ")")
    return text.contains(word) & exact


def text_search(df: DataFrame, id_col: str, text_col: str, terms, k: int | None = None) -> DataFrame:
    """Any-term search: distinct terms found and their idf sum per document, best first.

    Each document is filtered to the query terms before anything is shuffled, so a row leaves the scan
    only with the few terms it matches; document frequencies come from the same rows.
    """
    terms = sorted({t.lower() for t in terms})
    hits = C.bind(F.lower(F.col(text_col)), lambda t: F.array_compact(F.array(*[F.when(has_word(t, w), F.lit(w)) for w in terms])))
    found = df.select(F.col(id_col), hits.alias("hit")).filter(F.size("hit") > 0)
    totals = df.agg(F.count("*").alias("n")).scalar()
    freq = found.select(F.explode("hit").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    idf = freq.select("term", F.log((totals + F.lit(1.0)) / (F.col("df") + F.lit(1.0))).alias("idf"))
    table = idf.agg(F.map_from_entries(F.collect_list(F.struct("term", "idf"))).alias("m"))  # one entry per term
    score = F.aggregate("hit", F.lit(0.0), lambda s, t: s + F.try_element_at(F.col("_idf"), t))
    out = found.withColumn("_idf", table.scalar()).select(
        id_col, F.size("hit").cast("bigint").alias("n_terms"), score.alias("score")
    )
    return out if k is None else out.orderBy(F.col("n_terms").desc(), F.round("score", 9).desc(), id_col).limit(k)


def recent(df: DataFrame, ts: str, as_of, days: int = 7, limit: int | None = None, tie: str | None = None) -> DataFrame:
    out = df.filter(F.col(ts) >= F.lit(as_of) - F.expr(f"INTERVAL {int(days)} DAYS"))
    if limit is None:
        return out
    return out.orderBy(F.col(ts).desc(), *([tie] if tie else [])).limit(limit)


def filter_by_url_pattern(df: DataFrame, col: str, pattern: str) -> DataFrame:
    return df.filter(F.col(col).rlike(pattern))


def browse(df: DataFrame, equals: dict, shown, order, n: int = 100) -> DataFrame:
    """First n matching rows, only the shown columns, each with the total of all matches."""
    cond = F.lit(True)
    for c, v in equals.items():
        if v is not None:
            cond = cond & (F.col(c) == v)
    kept = df.filter(cond)
    total = kept.agg(F.count("*").alias("n")).scalar()
    return kept.orderBy(*order).limit(n).select(*shown, total.alias("total"))


def page(df: DataFrame, order, limit: int, offset: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def top_ranked(df: DataFrame, rank: str, tie: str, n: int = 10) -> DataFrame:
    return df.filter(F.col(rank).isNotNull()).orderBy(rank, tie).limit(n)


def best_run(runs: DataFrame, metric: str, name: str) -> DataFrame:
    """The run with the largest metric; a missing metric counts as minus infinity."""
    key = F.struct(F.coalesce(F.col(metric), F.lit(float("-inf"))), F.col(name))
    return runs.agg(F.max_by(F.struct(*runs.columns), key).alias("r")).select("r.*")


def flag_profiles(df: DataFrame, gpa: str = "gpa", budget: str = "budget", countries: str = "countries") -> DataFrame:
    """Adds ``warnings``: implausible or empty profiles."""
    g, b = F.col(gpa), F.col(budget)
    n = F.coalesce(F.array_size(F.col(countries)), F.lit(0))
    empty = (F.coalesce(g, F.lit(0)) == 0) & (F.coalesce(b, F.lit(0)) == 0) & (n == 0)
    return df.withColumn("warnings", F.array_compact(F.array(
        F.when((g >= 3.8) & (b < 1000), "suspicious: high gpa with tiny budget"),
        F.when(b > fixed.MAX_REASONABLE_BUDGET, "unrealistic: budget too high"),
        F.when(b <= 0, "invalid: budget must be positive"),
        F.when((g < 0) | (g > 4), "invalid: gpa outside [0, 4]"),
        F.when(n > 10, "suspicious: too many countries"),
        F.when(empty, "empty: no filters"),
    )))


def classify_urls(df: DataFrame, url: str, text: str) -> DataFrame:
    """Adds ``url_valid`` and ``url_reason``: structure, education host, at least two relevance words."""
    scheme = F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1)
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    known = C.ends_with_any(host, fixed.EDUCATION_SUFFIXES) | C.contains_any(host, fixed.EDUCATION_HOST_WORDS)
    relevant = C.hits(F.lower(F.coalesce(F.col(text), F.lit(""))), fixed.RELEVANCE_WORDS) >= 2
    reason = (
        F.when((scheme == "") | (host == ""), "Invalid URL structure")
        .when(~known, "Not a recognized university domain")
        .when(~relevant, "Content does not appear to be program information")
        .otherwise("Valid university program URL")
    )
    return df.withColumn("url_reason", F.coalesce(reason, F.lit("Invalid URL structure"))).withColumn(
        "url_valid", F.col("url_reason") == "Valid university program URL"
    )
