"""Whole-table standardisation jobs built from the column rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from offerloom.functions import columns as C, fixed
from offerloom.operators import prefix, tiers



def standardise_offers(df: DataFrame) -> DataFrame:
    """Scraped text fields to typed offer columns; rows without names or place are left out.

    Expected text columns: university_name, program_name, country, city, duration, fee_domestic,
    fee_international, tuition_fee_summary, fee_currency, toefl_score, ielts_score, pte_score, bachelor_gpa.
    """
    needed = [C.filled(c) for c in ("university_name", "program_name", "country", "city")]
    dom, intl, summary = C.fee_amount("fee_domestic"), C.fee_amount("fee_international"), C.fee_amount("tuition_fee_summary")
    neither = dom.isNull() & intl.isNull()
    gpa = C.score_number("bachelor_gpa")
    n_filled = sum((C.filled(c).cast("int") for c in df.columns), F.lit(0))
    keep = F.lit(True)
    for cond in needed:
        keep = keep & cond
    return df.filter(keep).select(
        *df.columns,
        C.entity_id("university_name").alias("university_id"),
        C.duration_years("duration").alias("duration_years"),
        dom.alias("domestic_per_year"),
        F.when(neither, summary).otherwise(intl).alias("international_per_year"),
        F.when(neither, C.fee_currency(F.coalesce("tuition_fee_summary", F.lit("")))).otherwise(
            F.coalesce(F.when(F.col("fee_currency") != "", F.col("fee_currency")), F.lit("USD"))).alias("currency"),
        C.score_number("toefl_score").cast("int").alias("toefl_min"),
        C.score_number("ielts_score").alias("ielts_min"),
        C.score_number("pte_score").cast("int").alias("pte_min"),
        F.when((gpa != 0) & (gpa <= 4), gpa).alias("gpa_requirement_min"),
        F.least(F.lit(1.0), F.round(n_filled / F.lit(float(max(len(df.columns), 38))), 2)).alias("confidence_score"),
    )


def derive_demographics(df: DataFrame, total="total_students", pct="international_students_pct", given="international_students",
                        faculty="faculty_count") -> DataFrame:
    t, f = C.positive_int(total), C.positive_int(faculty)
    share = F.regexp_replace(F.col(pct).cast("string"), "%", "")
    p = C.to_number(share)
    return df.withColumn("international_count", F.coalesce(F.when(C.filled(pct), F.floor(t * p / 100)), C.positive_int(given)).cast("bigint")).withColumn(
        "student_faculty_ratio", C.round_to(t / f, 2)
    )


def highlights_map(c) -> Column:
    """Array of (label, value) to a map with snake-case keys; the last of equal labels wins, blanks are left out."""
    pairs = F.filter(F.transform(c, lambda h: F.struct(C.snake(h["label"]).alias("k"), C.strip(h["value"]).alias("v"))),
                     lambda e: (e["k"] != "") & (e["v"] != ""))
    later = lambda a, i: F.slice(a, i + 2, F.greatest(F.size(a), F.lit(1)))
    return C.bind(pairs, lambda a: F.map_from_entries(
        F.filter(a, lambda e, i: ~F.exists(later(a, i), lambda x: x["k"] == e["k"]))))


def first_key(m, *keys) -> Column:
    return F.coalesce(*[F.try_element_at(m, F.lit(k)) for k in keys])


def requirements_list(c) -> Column:
    """Array of (exam_name, score) to 'name: score' texts."""
    a = F.filter(c, lambda e: F.coalesce(C.strip(e["exam_name"]), F.lit("")) != "")
    return F.transform(a, lambda e: F.when(F.coalesce(C.strip(e["score"]), F.lit("")) != "",
                                           F.concat(C.strip(e["exam_name"]), F.lit(": "), C.strip(e["score"]))).otherwise(C.strip(e["exam_name"])))


def flatten_entities(raw: DataFrame, aggregator: str) -> DataFrame:
    """Nested raw entity records to flat rows; records without a name are left out."""
    text = lambda c: F.coalesce(C.strip(F.col(c).cast("string")), F.lit(""))
    df = raw.withColumn("_rank", tiers.standardise_rankings_array(F.coalesce(F.col("rankings"), F.array().cast(raw.schema["rankings"].dataType))))
    canonical = F.coalesce(C.blank_to_null("crawl_metadata.canonical_url"), C.blank_to_null("identity.canonical_url"))
    total, faculty = C.positive_int("demographics.total_students"), C.positive_int("demographics.faculty_count")
    pct = C.to_number(F.replace(F.col("demographics.international_students_pct").cast("string"), F.lit("%"), F.lit("")))
    fee = lambda k: C.positive_int(F.coalesce(F.col(f"financials.{k}.amount"), F.col(f"financials.{k}.amount_min")))
    return df.filter(text("identity.name") != "").select(
        C.entity_id(F.when(text("identity.slug") != "", text("identity.slug")).otherwise(text("identity.name"))).alias("university_id"),
        text("identity.name").alias("name"), text("identity.slug").alias("slug"),
        F.coalesce(C.blank_to_null("location.country"), F.lit("Unknown")).alias("country"),
        F.coalesce(C.blank_to_null("location.city"), F.lit("Unknown")).alias("city"),
        C.blank_to_null("location.state").alias("state_province"), C.blank_to_null("location.address").alias("address"),
        C.nonzero_float("location.latitude").alias("latitude"), C.nonzero_float("location.longitude").alias("longitude"),
        C.clean_text(F.coalesce(F.when(F.col("profile.description_full") != "", F.col("profile.description_full")),
                                F.col("profile.description_short"))).alias("description"),
        C.official_website("contact.website", canonical, aggregator).alias("website"),
        tiers.array_rank("_rank", fixed.WORLD_SYSTEM).alias("qs_world_ranking"),
        C.blank_to_null("profile.institution_type").alias("type"), C.positive_int("profile.established_year").alias("founding_year"),
        total.alias("total_students"),
        F.coalesce(F.floor(total * pct / 100), C.positive_int("demographics.international_students")).alias("international_students"),
        faculty.alias("faculty_count"), C.round_to(total / faculty, 2).alias("student_faculty_ratio"),
        fee("tuition_domestic").alias("average_tuition_domestic"), fee("tuition_international").alias("average_tuition_international"),
        F.filter("_rank", lambda x: F.coalesce(x["ranking_type"], F.lit("")) != "").alias("ranking_signals"),
        text("crawl_metadata.content_hash").alias("content_hash"), text("crawl_metadata.source_url").alias("source_url"),
        text("crawl_metadata.crawl_timestamp").alias("crawled_at"),
    )


def flatten_offers(raw: DataFrame) -> DataFrame:
    """Nested raw offer records to flat rows; records without a title or parent are left out."""
    text = lambda c: F.coalesce(C.strip(F.col(c).cast("string")), F.lit(""))
    h = F.col("_h")
    degree = F.coalesce(first_key(h, "degree", "qualification"), F.lit(""))
    subject = first_key(h, "main_subject", "main_subject_area", "subject_area")
    fees = F.filter(F.transform("tuition_fees", lambda f: C.strip(f["fee_amount"])), lambda t: F.replace(t, F.lit(","), F.lit("")).rlike("[0-9]"))
    fee = F.get(fees, F.lit(0))
    amount = C.found(F.replace(fee, F.lit(","), F.lit("")), r"([0-9]+\.?[0-9]*)").cast("bigint")
    badge = F.get(F.filter("badges", lambda b: F.lower(b["label"]).contains("ranking") & (F.coalesce(C.strip(b["value"]), F.lit("")) != "")), F.lit(0))
    history = F.col("qs_subject_rankings.ranking_history")
    latest = F.get(F.sort_array(F.transform(history, lambda r: F.struct(r["year"].cast("string").alias("y"), r["rank"].cast("string").alias("r"))), False), F.lit(0))
    empty = F.array().cast("array<string>")
    reqs = F.concat(F.coalesce(requirements_list("admission_requirements.exam_scores"), empty),
                    F.coalesce(requirements_list("admission_requirements.english_requirements"), empty))
    df = raw.withColumn("_h", highlights_map("overview.highlights"))
    title, campus = "programme_header.programme_title", "programme_header.campus_location"
    return df.filter((text(title) != "") & (text("parent_university_slug") != "")).select(
        text(title).alias("program_name"), text("parent_university_slug").alias("university_name"),
        C.campus_country(campus).alias("country"), C.campus_city(campus).alias("city"),
        C.degree_type(degree).alias("degree_type"), C.level(F.coalesce(first_key(h, "study_level"), degree)).alias("degree_level"),
        C.category(F.coalesce(subject, text(title))).alias("program_category"),
        F.coalesce(subject, C.category(text(title))).alias("field_of_study"),
        first_key(h, "study_mode", "mode_of_study").alias("mode_of_study"),
        C.to_number(F.get(F.split("admission_requirements.gpa_score", "/"), F.lit(0))).alias("gpa_requirement_min"),
        reqs.alias("entry_requirements"), amount.alias("international_per_year"),
        F.when(fee.contains("€"), "EUR").when(fee.contains("£"), "GBP").otherwise("USD").alias("currency"),
        F.coalesce(C.parse_rank(badge["value"]), C.parse_rank(latest["r"])).alias("subject_ranking"),
        C.clean_text("overview.description_short").alias("description"), text("source_url").alias("source_url"),
        text("program_slug").alias("program_slug"), text("crawled_at").alias("crawled_at"),
    )


def flatten_directory(items: DataFrame, source: str) -> DataFrame:
    """Directory items: first of the country and city lists, numeric position."""
    return items.select(
        C.strip("program_name").alias("program_name"), "program_url", C.strip("uni_name").alias("university_name"), "uni_url",
        F.get("country", F.lit(0)).alias("country"), F.get("city", F.lit(0)).alias("city"), F.col("campus_name").alias("campus"),
        "region", C.parse_rank("rankings_position").alias("rankings_position"), F.col("rankings_position").alias("rankings_display"),
        F.lit(source).alias("source"),
    )


def fill_missing(df: DataFrame) -> DataFrame:
    """Duration by degree, country from the name, a template description below ten characters."""
    d = F.lower("degree_type")
    years = F.when(d.contains("bachelor"), 4.0).when(d.contains("master"), 2.0).when(d.contains("phd"), 4.0)
    out = df.withColumn("duration_years", F.coalesce(F.when(F.col("duration_years") != 0, F.col("duration_years")), years))
    out = out.withColumn("country", F.when((F.coalesce("country", F.lit("")) == "") & C.filled("university_name"), C.infer_country("university_name")).otherwise(F.col("country")))
    short = F.length(C.strip(F.coalesce("program_description", F.lit("")))) < 10
    spec = F.when(F.size("specializations") > 0, F.concat(F.lit(" with specializations in "), F.array_join(F.slice("specializations", 1, 3), ", "))).otherwise("")
    length = F.when(F.col("duration_years") != 0, F.concat(F.lit(" This "), F.col("duration_years").cast("string"), F.lit("-year program"))).otherwise("")
    text = F.concat(F.lit("This is a "), F.coalesce("degree_type", F.lit("degree")), F.lit(" program in Computer Science"), spec, F.lit("."), length,
                    F.lit(" The program provides comprehensive education in computer science fundamentals and advanced topics."),
                    F.when(C.filled("university_name"), F.concat(F.lit(" Offered by "), F.col("university_name"), F.lit("."))).otherwise(""))
    return out.withColumn("program_description", F.when(short, text).otherwise(F.col("program_description")))


def standardise_text(df: DataFrame, names=("university_name", "program_name"), places=("country", "city"), degree: str = "degree_type") -> DataFrame:
    out = df
    for c in names:
        out = out.withColumn(c, C.strip(c))
    for c in places:
        out = out.withColumn(c, C.title_case(C.strip(c)))
    return out.withColumn(degree, C.degree_type_short(degree))


def completeness_eight(df: DataFrame, nested=("tuition_fees", "application_deadlines"), texts=("program_description",),
                       numbers=("duration_years", "gpa_requirement_min"), lists=("prerequisites", "specializations", "faculty_research_interests")) -> Column:
    """Share of eight fields; nested records always count as filled."""
    return C.share([F.lit(True) for _ in nested] + [F.col(c).isNotNull() & (F.col(c) != "") for c in texts]
                   + [F.col(c).isNotNull() for c in numbers] + [F.size(c) > 0 for c in lists])


def completeness_ten(texts=("program_description", "fall_deadline", "country", "city"), numbers=("duration_years", "international_per_year", "gpa_requirement_min"),
                     lists=("prerequisites", "specializations", "faculty_research_interests")) -> Column:
    """Share of ten typed fields: numbers above zero, non-blank texts, non-empty lists."""
    return C.share([C.filled(c) for c in texts] + [F.col(c) > 0 for c in numbers] + [F.size(c) > 0 for c in lists])


def confidence(completeness: Column, critical, academic, fee, rank) -> Column:
    """Completeness plus bonuses (0.1, 0.1, 0.1, 0.05; at most 0.3), at most 1, three decimals."""
    bonus = sum((F.when(F.coalesce(c, F.lit(False)), b).otherwise(0.0) for c, b in [(critical, 0.1), (academic, 0.1), (fee, 0.1), (rank, 0.05)]), F.lit(0.0))
    return F.round(F.least(completeness + F.least(bonus, F.lit(0.3)), F.lit(1.0)), 3)


# --- typing and cleaning by data ----------------------------------------------------------------------


def promote_numeric(df: DataFrame, share: float = 0.8) -> DataFrame:
    """Text columns that are numeric in more than ``share`` of all rows become numbers. One pass decides."""
    texts = [c for c, t in df.dtypes if t == "string"]
    if not texts:
        return df
    row = df.agg(*[F.avg(F.coalesce(C.strip(c).rlike(C.NUMBER), F.lit(False)).cast("int")).alias(c) for c in texts]).first()
    numeric = {c for c in texts if (row[c] or 0) > share}
    return df.select(*[C.to_number(c).alias(c) if c in numeric else F.col(c) for c in df.columns])


def impute(df: DataFrame, numeric, categorical, hot_rows: int = prefix.HOT_ROWS) -> DataFrame:
    """Medians and modes (smallest on ties), 'Unknown' where a column has no value at all."""
    out = df
    if numeric:
        med = prefix.quantiles(prefix.unpivot(df, numeric), ["feature"], "value", [0.5], hot_rows)
        row = med.agg(*[F.max(F.when(F.col("feature") == c, F.col("quantile"))).alias(c) for c in numeric])
        for c in numeric:
            out = out.withColumn(c, F.coalesce(F.col(c), row.select(c).scalar()))
    if categorical:
        counts = prefix.unpivot(df, categorical, kind="string").filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(F.count("*").alias("n"))
        top = counts.groupBy("feature").agg(F.max("n").alias("n")).join(counts, ["feature", "n"]).groupBy("feature").agg(F.min("value").alias("value"))
        row = top.agg(*[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(c) for c in categorical])
        for c in categorical:
            out = out.withColumn(c, F.coalesce(F.col(c), row.select(c).scalar(), F.lit("Unknown")))
    return out


def clip_outliers(df: DataFrame, cols, lo: float = 0.01, hi: float = 0.99, hot_rows: int = prefix.HOT_ROWS) -> DataFrame:
    """Values outside the exact interpolated quantiles move to them."""
    q = prefix.quantiles(prefix.unpivot(df, cols), ["feature"], "value", [lo, hi], hot_rows)
    pick = lambda c, p: F.max(F.when((F.col("feature") == c) & (F.col("prob") == p), F.col("quantile")))
    row = q.agg(*[pick(c, lo).alias(f"{c}__lo") for c in cols], *[pick(c, hi).alias(f"{c}__hi") for c in cols])
    out = df
    for c in cols:
        low, high = row.select(f"{c}__lo").scalar(), row.select(f"{c}__hi").scalar()
        out = out.withColumn(c, F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), low), high)))
    return out


def detect_feature_groups(df: DataFrame, id_pattern: str = r"(?i)(^|_)id$|_key$|url") -> DataFrame:
    """(column, group): id by name, numeric by type, text by mean length above 40 or ';' in more than half, else categorical."""
    spark = df.sparkSession
    import re

    texts = [c for c, t in df.dtypes if t == "string" and not re.search(id_pattern, c)]
    numeric_types = ("int", "bigint", "double", "float", "smallint", "tinyint")
    stats = {}
    if texts:
        row = df.agg(*[F.avg(F.length(c)).alias(f"{c}__l") for c in texts], *[F.avg(F.col(c).contains(";").cast("int")).alias(f"{c}__s") for c in texts]).first()
        stats = {c: ((row[f"{c}__l"] or 0) > 40 or (row[f"{c}__s"] or 0) > 0.5) for c in texts}
    rows = []
    for c, t in df.dtypes:
        group = "id" if re.search(id_pattern, c) else "numeric" if t in numeric_types or t.startswith("decimal") else "text" if stats.get(c) else "categorical" if t == "string" else "other"
        rows.append((c, group))
    return spark.createDataFrame(rows, "column string, group string")


def detect_target(df: DataFrame, candidates, rank: str | None = None, max_classes: int = 5):
    """(frame, target): the first candidate with at most five values, otherwise a tier cut from the rank."""
    for c in candidates:
        if c in df.columns and df.select(c).filter(F.col(c).isNotNull()).distinct().limit(max_classes + 1).count() <= max_classes:
            return df, c
    if rank is None:
        raise ValueError("no target column and no rank to derive one")
    return df.withColumn("university_tier", C.tier_by_cuts(F.coalesce(F.col(rank), F.lit(9999)), [100, 500], ["top", "good", "standard"])), "university_tier"
