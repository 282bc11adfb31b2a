"""Column builders: every rule is a Catalyst expression, so it stays inside codegen and can be pushed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from offerloom.functions import fixed

BLANKS = " \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Remove leading and trailing whitespace of every kind (``trim`` only knows the space)."""
    return F.trim(_c(c), F.lit(BLANKS))


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with the value computed once per row. A long chain of conditions would otherwise
    repeat the expression in every branch, because only unconditional parts are shared."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def blank_to_null(c) -> Column:
    s = strip(c)
    return F.when(s != "", s)


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def contains_any(c, words) -> Column:
    c = _c(c)
    return any_of([c.contains(w) for w in words])


def ends_with_any(c, words) -> Column:
    c = _c(c)
    return any_of([c.endswith(w) for w in words])


def hits(c, words) -> Column:
    """How many of the words occur in the text."""
    return bind(_c(c), lambda t: reduce(lambda a, b: a + b, [t.contains(w).cast("int") for w in words]))


def first_rule(c, rules, default) -> Column:
    """Label of the first (label, words) rule with a word inside the lower-cased text."""

    def number(text):
        chain = None
        for i, (_, words) in enumerate(rules):
            hit = contains_any(text, words)
            chain = F.when(hit, i) if chain is None else chain.when(hit, i)
        return chain

    labels = F.array(*[F.lit(label) for label, _ in rules])
    return F.coalesce(F.get(labels, bind(F.lower(_c(c)), number)), F.lit(default) if isinstance(default, str) else default)


def lookup(c, mapping, default=None) -> Column:
    """Value of a small literal map; the map is part of the plan, so there is no join."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    hit = F.try_element_at(F.create_map(*pairs), _c(c))
    return hit if default is None else F.coalesce(hit, F.lit(default))


NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def found(text, pattern: str, group: int = 1, kind: str = "double") -> Column:
    """Number matched by a pattern. Texts without a match never reach the cast: a failing cast costs far
    more than a test, because it is an exception inside the engine."""
    return bind(F.regexp_extract(text, pattern, group), lambda t: F.when(t != "", t.try_cast(kind)))


def to_number(c) -> Column:
    """Text as a number, null where it is not one."""
    return bind(strip(_c(c).cast("string")), lambda t: F.when(t.rlike(NUMBER), t.try_cast("double")))


# --- ranks -------------------------------------------------------------------------------


def _rank_text(c) -> Column:
    return strip(F.regexp_replace(strip(_c(c).cast("string")), r"^#+", ""))


def parse_rank(c) -> Column:
    """'#1', '=5', '101-150' (lower bound), '1401+' to a number, else null."""
    return found(_rank_text(c), r"^=?([0-9]+)", 1, "int")


def parse_rank_midpoint(c) -> Column:
    """As ``parse_rank`` but a range becomes its floored midpoint."""
    pattern = r"^([0-9]+)\s*[-–]\s*([0-9]+)"

    def middle(t):
        span = F.floor((found(t, pattern, 1, "int") + found(t, pattern, 2, "int")) / 2).cast("int")
        return F.when(t.rlike(pattern), span).otherwise(found(t, r"^=?([0-9]+)", 1, "int"))

    return bind(_rank_text(c), middle)


def rank_points(rank, largest) -> Column:
    """1.0 for rank 1 falling linearly to 0.0 at the largest rank; 0 for non-positive ranks."""
    rank = _c(rank)
    return F.when(rank <= 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), F.lit(1.0) - (rank - F.lit(1)) / _c(largest))
    )


# --- numbers -----------------------------------------------------------------------------


def positive_int(c) -> Column:
    return bind(to_number(c).cast("bigint"), lambda v: F.when(v > 0, v))


def nonzero_float(c) -> Column:
    return bind(to_number(c), lambda v: F.when(v != 0, v))


def score_number(c) -> Column:
    """First number inside a score text such as '304+' or 'IELTS 6.5'."""
    return found(_c(c), r"([0-9]+(?:\.[0-9]+)?)")


# --- durations, fees, money ------------------------------------------------------------------


def duration_years(c) -> Column:
    return bind(F.lower(_c(c)), lambda t: F.coalesce(
        F.when(t.contains("month"), F.round(found(t, r"([0-9]+)\s*month") / 12, 2)),
        F.when(t.contains("year"), found(t, r"([0-9]+(?:\.[0-9]+)?)\s*year")),
        F.when(t.contains("week"), F.round(found(t, r"([0-9]+)\s*week") / 52, 2)),
    ))


def fee_currency(c) -> Column:
    t = _c(c)
    chain = None
    for code, marks in fixed.FEE_CURRENCY_MARKS:
        hit = contains_any(t, marks)
        chain = F.when(hit, code) if chain is None else chain.when(hit, code)
    return chain.otherwise("USD")


def fee_amount(c) -> Column:
    """Largest whole number in a fee text."""
    numbers = F.regexp_extract_all(_c(c), F.lit(r"([0-9,]*[0-9][0-9,]*)(?:\.[0-9]+)?"), F.lit(1))
    return F.array_max(F.transform(numbers, lambda n: F.replace(n, F.lit(","), F.lit("")).try_cast("bigint")))


def round_to(c, digits: int) -> Column:
    """Round the binary value, as floating-point libraries do. ``round`` works on the shortest decimal text
    of the number and so lifts values that lie just below a half."""
    scale = F.lit(10.0 ** digits)
    v = _c(c).cast("double")
    near = F.signum(v) * F.floor(F.abs(v) * scale + F.lit(0.5)) / scale
    return F.when(F.abs(v) * scale < F.lit(2.0 ** 52), near).otherwise(v)


def to_usd(amount, currency) -> Column:
    rate = lookup(F.upper(_c(currency)), fixed.USD_RATES, 1.0)
    return round_to(_c(amount) * rate, 2)


# --- names and labels ---------------------------------------------------------------------------


def entity_id(c) -> Column:
    t = F.regexp_replace(F.lower(strip(c)), r"[^a-z0-9 \t\n\r\f\v]", "")
    return F.substring(F.md5(F.regexp_replace(t, r"[ \t\n\r\f\v]+", " ")), 1, 12)


def institution_key(c) -> Column:
    t = F.lower(F.regexp_replace(strip(c), r"[ \t\n\r\f\v]+", " "))
    return F.regexp_replace(F.coalesce(t, F.lit("")), r" ?\([^)]*\) ?$", "")


def match_key(c) -> Column:
    """Name form used for matching: lower, 'university of', 'the ' and commas removed."""
    t = F.lower(strip(c))
    for part in ["university of", "the ", ","]:
        t = F.replace(t, F.lit(part), F.lit(""))
    return F.coalesce(strip(t), F.lit(""))


def degree_type(c) -> Column:
    """Exact name, else the first known name that contains the text or is contained in it."""

    def named(v):
        part = None
        for k, n in fixed.DEGREE_NAMES.items():
            hit = v.contains(k) | F.lit(k).contains(v)
            part = F.when(hit, n) if part is None else part.when(hit, n)
        return F.coalesce(lookup(v, fixed.DEGREE_NAMES), part, F.lit(fixed.DEFAULT_DEGREE))

    return F.when(F.coalesce(_c(c), F.lit("")) == "", fixed.DEFAULT_DEGREE).otherwise(bind(strip(F.lower(_c(c))), named))


def degree_type_short(c) -> Column:
    return F.coalesce(lookup(strip(F.lower(_c(c))), fixed.DEGREE_NAMES_SHORT), _c(c))


def level(c) -> Column:
    return F.when(F.coalesce(_c(c), F.lit("")) == "", "Masters").otherwise(
        first_rule(strip(c), fixed.LEVEL_WORDS, "Masters")
    )


def link_level(text, url) -> Column:
    return first_rule(F.concat_ws(" ", text, url), fixed.LINK_LEVEL_WORDS, "Unknown")


def category(c) -> Column:
    return F.when(F.coalesce(_c(c), F.lit("")) == "", "Other").otherwise(
        first_rule(strip(c), fixed.CATEGORY_WORDS, "Other")
    )


def link_category(text, url) -> Column:
    return first_rule(F.concat_ws(" ", text, url), fixed.LINK_CATEGORY_WORDS, "Other")


def ownership(c) -> Column:
    t = F.lower(_c(c))
    return (
        F.when(t.contains("public"), "public")
        .when(t.contains("private") & t.contains("not for profit"), "private_nonprofit")
        .when(t.contains("private") & t.contains("for profit"), "private_forprofit")
        .when(t.contains("private"), "private")
    )


def research_intensity(c) -> Column:
    return lookup(F.upper(_c(c)), fixed.RESEARCH_CODES)


# --- places ------------------------------------------------------------------------------------------


def _parts(c) -> Column:
    return F.transform(F.split(_c(c), ","), lambda p: strip(p))


def campus_country(c) -> Column:
    """Last comma part; with three or more parts its first word is the city and is dropped."""
    parts = _parts(c)
    last = F.element_at(parts, -1)
    words = F.filter(F.split(last, r"[ \t\n\r]+"), lambda w: w != "")
    tail = F.array_join(F.slice(words, 2, F.greatest(F.size(words), F.lit(1))), " ")
    return (
        F.when(F.coalesce(_c(c), F.lit("")) == "", "Unknown")
        .when(F.size(parts) >= 3, F.when(F.size(words) >= 2, tail).otherwise(last))
        .when(F.size(parts) == 2, last)
        .otherwise("Unknown")
    )


def campus_city(c) -> Column:
    parts = _parts(c)
    return (
        F.when(F.coalesce(_c(c), F.lit("")) == "", "Unknown")
        .when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2))
        .otherwise(F.get(parts, F.lit(0)))
    )


def location_country(c) -> Column:
    """'City, Country' or 'Country'; the three-part form yields its first part, as given."""
    parts = _parts(c)
    n = F.size(parts)
    return F.when(_c(c) != "", F.when(n == 3, F.get(parts, F.lit(0))).when(n == 2, F.get(parts, F.lit(1)))
                  .when(n == 1, F.get(parts, F.lit(0))))


def location_city(c) -> Column:
    parts = _parts(c)
    n = F.size(parts)
    return F.when(_c(c) != "", F.when(n == 3, F.get(parts, F.lit(2))).when(n == 2, F.get(parts, F.lit(0))))


def infer_city(name, country) -> Column:
    rules = [(city, [w.lower() for w in words]) for city, words in fixed.CITY_PATTERNS]
    return first_rule(name, rules, F.coalesce(lookup(country, fixed.CAPITALS), _c(country)))


def infer_country(name) -> Column:
    return first_rule(name, fixed.COUNTRY_PATTERNS, "Unknown")


# --- text -------------------------------------------------------------------------------------------------


def clean_text(c) -> Column:
    """Tags out, whitespace collapsed, empty to null."""
    t = F.regexp_replace(F.regexp_replace(_c(c), r"<[^>]+>", " "), r"[ \t\n\r\f\v]+", " ")
    return blank_to_null(t)


def official_website(site, canonical, aggregator: str) -> Column:
    """The entity's own site; links back to the aggregator give way to the canonical address."""
    own = F.when((_c(site) != "") & ~_c(site).contains(aggregator), strip(site))
    return F.coalesce(own, blank_to_null(canonical))


def title_case(c) -> Column:
    """Upper first letter of every run of letters, the rest lower."""
    runs = F.split(F.lower(_c(c)), r"(?<=[^\p{L}])(?=\p{L})")
    return F.array_join(F.transform(runs, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), "")


def snake(c) -> Column:
    return F.regexp_replace(F.lower(strip(c)), r"[ /]", "_")


def standard_name(name: str) -> str:
    """Header text to column name: lower, everything else to '_', runs collapsed."""
    out = "".join(ch if ch.isascii() and ch.isalnum() else "_" for ch in str(name).lower())
    return "_".join(p for p in out.split("_") if p)


# --- fill rates -------------------------------------------------------------------------------------------


def filled(c) -> Column:
    return F.coalesce(strip(_c(c).cast("string")) != "", F.lit(False))


def share(flags) -> Column:
    """Mean of boolean flags, nulls as false."""
    flags = list(flags)
    total = reduce(lambda a, b: a + b, [F.coalesce(f, F.lit(False)).cast("int") for f in flags])
    return total / F.lit(float(len(flags)))


# --- tiers and scores ------------------------------------------------------------------------------------


def tier_by_cuts(rank, cuts, labels, null_label=None) -> Column:
    """Right-closed bands: first cut >= rank wins, beyond the last cut the last label."""
    rank = _c(rank)
    chain = F.when(rank.isNull(), F.lit(null_label))
    for cut, label in zip(cuts, labels):
        chain = chain.when(rank <= cut, label)
    return chain.otherwise(labels[-1])


def tier_of_score(score) -> Column:
    score = _c(score)
    return (
        F.when(score >= fixed.TOP_THRESHOLD, "top")
        .when(score >= fixed.GOOD_THRESHOLD, "good")
        .otherwise("standard")
    )


def match_score(probabilities, classes) -> Column:
    """Weighted sum of an array of class probabilities, clipped to [0, 1]."""
    p = _c(probabilities)
    parts = [F.get(p, F.lit(i)) * F.lit(fixed.TIER_WEIGHTS[k]) for i, k in enumerate(classes)
             if k in fixed.TIER_WEIGHTS]
    total = reduce(lambda a, b: a + b, parts) if parts else F.lit(0.0)
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def confidence_band(probabilities) -> Column:
    top = F.array_max(_c(probabilities))
    return F.when(top >= fixed.BAND_HIGH, "high").when(top >= fixed.BAND_MEDIUM, "medium").otherwise("low")
