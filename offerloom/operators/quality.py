"""Row contracts, scored validation of offers and entities, gates over training runs, source contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from offerloom.functions import columns as C, fixed



def enforce_constraints(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds ``reasons``: names of violated rules. A rule is a condition that must hold; null holds."""
    bad = [F.when(~F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in rules.items()]
    return df.withColumn("reasons", F.array_compact(F.array(*bad)))


def split_by_constraints(df: DataFrame, rules) -> tuple[DataFrame, DataFrame]:
    marked = enforce_constraints(df, rules)
    return marked.filter(F.size("reasons") == 0).drop("reasons"), marked.filter(F.size("reasons") > 0)


def offer_rules() -> dict[str, Column]:
    name = lambda c: C.strip(c)
    return {
        "id_format": F.col("university_id").rlike("^[a-f0-9]{12}$"),
        "university_name_empty": F.length(F.coalesce(name("university_name"), F.lit(""))) > 0,
        "university_name_long": F.length("university_name") <= 200,
        "program_name_empty": F.length(F.coalesce(name("program_name"), F.lit(""))) > 0,
        "program_name_long": F.length("program_name") <= 300,
        "gpa_range": F.col("gpa_requirement_min").between(0, 4),
        "ielts_range": F.col("ielts_min").between(0, 9),
        "toefl_range": F.col("toefl_min").between(0, 120),
        "duration_range": (F.col("duration_years") > 0) & (F.col("duration_years") <= 7),
    }


def validate_offers(df: DataFrame, desc: str = "program_description", tuition: str = "tuition") -> DataFrame:
    """Adds score, issues, warnings and recommendations of the offer checks."""
    required = [("university_name", "University name is required"), ("program_name", "Program name is required"),
                ("degree_type", "Degree type is required"), ("country", "Country is required"),
                ("source_url", "Source URL is required")]
    present = [C.filled(c) for c, _ in required]
    g, t, i = F.col("gpa_requirement_min"), F.col("toefl_min"), F.col("ielts_min")
    gpa_ok = g.between(0, 4)
    url_ok = F.coalesce(F.lower("source_url").rlike("^https?:"), F.lit(False))
    points = sum((p.cast("double") for p in present), F.lit(0.0)) + F.when(gpa_ok, 0.5).otherwise(0.0) + url_ok.cast("double")
    issues = F.array_compact(F.array(
        *[F.when(~p, F.lit(text)) for p, (_, text) in zip(present, required)],
        F.when(~gpa_ok, "GPA requirement must be between 0.0 and 4.0"),
        F.when((t != 0) & ~t.between(0, 120), "TOEFL score must be between 0 and 120"),
        F.when((i != 0) & ~i.between(0, 9), "IELTS score must be between 0.0 and 9.0"),
        F.when(~url_ok, "Source URL must use HTTP or HTTPS"),
    ))
    warnings = F.array_compact(F.array(
        F.when((F.length(desc) > 0) & (F.length(desc) < 50), "Program description seems too short"),
        F.when((F.col(tuition) != 0) & (F.col(tuition) < 1000), "Tuition fee seems unusually low"),
    ))
    said = lambda word: F.exists("issues", lambda s: F.lower(s).contains(word))
    out = df.withColumn("score", points / 7).withColumn("issues", issues).withColumn("warnings", warnings)
    return out.withColumn("is_valid", F.size("issues") == 0).withColumn("recommendations", F.array_compact(F.array(
        F.when(said("required"), "Complete all required fields before saving"),
        F.when(said("url"), "Verify source URL is correct and accessible"),
        F.when(said("gpa"), "Ensure GPA requirements are in 4.0 scale format"),
        F.when(F.size("warnings") > 0, "Review warnings for potential data quality issues"),
    )))


def quality_score(validated: DataFrame, completeness: str = "data_completeness") -> DataFrame:
    """One row: 0.7 of mean completeness less penalties for issues and warnings; critical issues counted."""
    n = F.count("*")
    totals = validated.agg(
        n.alias("total"), F.avg(completeness).alias("avg_completeness"), F.sum(F.size("issues")).alias("n_issues"),
        F.sum(F.size("warnings")).alias("n_warnings"),
        F.sum(F.size(F.filter("issues", lambda s: F.lower(s).contains("required")))).alias("n_critical"),
    )
    raw = (F.col("avg_completeness") * 0.7 - F.least(F.col("n_issues") / F.col("total"), F.lit(0.3))
           - F.least(F.col("n_warnings") / (F.col("total") * 2), F.lit(0.2)))
    return totals.withColumn("quality_score", F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)))


def top_issues(validated: DataFrame, k: int = 3) -> DataFrame:
    return validated.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n")).orderBy(
        F.col("n").desc(), "issue").limit(k)


def quality_recommendations(validated: DataFrame, completeness: str = "data_completeness") -> DataFrame:
    """(position, recommendation): what the totals and the three most frequent issues call for, or one line that nothing is."""
    totals = quality_score(validated, completeness).select("avg_completeness", "n_warnings")
    top = top_issues(validated).agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("o"), "issue", "n"))).alias("top"))  # three rows
    row = totals.crossJoin(top)
    fix = F.transform("top", lambda t: F.concat(F.lit("Fix "), t["n"].cast("string"), F.lit(" programs with: "), t["issue"]))
    said = F.array_compact(F.concat(
        F.array(F.when(F.col("avg_completeness") < 0.7, fixed.IMPROVE_COMPLETENESS)), fix, F.array(F.when(F.col("n_warnings") > 0, fixed.REVIEW_WARNINGS))))
    said = F.when(F.size(said) > 0, said).otherwise(F.array(F.lit(fixed.QUALITY_IS_GOOD)))
    return row.select(F.posexplode(said).alias("position", "recommendation"))


# --- entities -------------------------------------------------------------------------------------


def check_weight(name: Column) -> Column:
    return F.when(name.contains("required") | name.contains("critical"), 2.0).when(name.contains("optional"), 0.5).otherwise(1.0)


def validate_entities(entities: DataFrame, offers: DataFrame) -> DataFrame:
    """Long table (entity, check, passed, severity, weight, issue) of all named checks that apply."""
    child = stats_of_children(offers)
    j = entities.join(child, entities["name"] == child["_cname"], "left")
    n = F.coalesce("n_offers", F.lit(0))
    level = lambda cond, bad: F.when(cond, "info").otherwise(bad)

    def check(name, cond, bad, applies=None):
        cond = F.coalesce(cond, F.lit(False))
        s = F.struct(F.lit(name).alias("check"), cond.alias("passed"), level(cond, bad).alias("severity"))
        return s if applies is None else F.when(F.coalesce(applies, F.lit(False)), s)

    has = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    ranks = ["qs_world_ranking", "the_world_ranking", "us_news_ranking"]
    some_rank = C.any_of([F.col(r).isNotNull() for r in ranks])
    important = ["description", "website", "founding_year", "total_students", "qs_world_ranking", "type", "tier"]
    fullness = C.share([F.col(c).isNotNull() for c in important])
    never = F.lit(False)
    checks = [check(f"required_field_{c}", C.filled(c), "error") for c in ("name", "country", "city")]
    checks += [
        check("university_id_format", F.col("university_id").rlike("^[a-f0-9]{12}$"), "warning", has("university_id")),
        check("university_id_missing", never, "warning", ~has("university_id")),
        check("website_url_valid", F.col("website").rlike("^https?://[^/]+"), "warning", has("website")),
        check("website_url_missing", never, "info", ~has("website")),
        *[check(f"ranking_{r}_valid", F.col(r) > 0, "warning", F.col(r).isNotNull()) for r in ranks],
        check("no_rankings", never, "info", ~some_rank),
        check("tier_classification", F.lower("tier").isin("top", "good", "standard"), "warning", has("tier")),
        check("tier_missing", never, "info", ~has("tier")),
        check("no_programs", never, "error", n == 0),
        check("programs_count", n > 0, "info", n > 0),
        # exactly half (or 30%) fails but is only worth an info
        F.when(n > 0, F.struct(F.lit("program_descriptions").alias("check"), (F.col("description_coverage") > 0.5).alias("passed"),
                               F.when(F.col("description_coverage") < 0.5, "warning").otherwise("info").alias("severity"))),
        F.when(n > 0, F.struct(F.lit("program_fees").alias("check"), (F.col("fee_coverage") > 0.3).alias("passed"),
                               F.when(F.col("fee_coverage") < 0.3, "warning").otherwise("info").alias("severity"))),
        check("duplicate_programs", never, "warning", F.col("duplicates") > 0),
        F.struct(F.lit("data_completeness").alias("check"), (fullness > 0.6).alias("passed"),
                 F.when(fullness < 0.6, "warning").otherwise("info").alias("severity")),
    ]
    rows = j.select(F.col("name").alias("entity"), F.explode(F.array_compact(F.array(*checks))).alias("c"))
    return rows.select("entity", "c.check", "c.passed", "c.severity", check_weight(F.col("c.check")).alias("weight"),
                       (~F.col("c.passed") & F.col("c.severity").isin("error", "warning")).alias("issue"))


def stats_of_children(offers: DataFrame) -> DataFrame:
    per_name = offers.groupBy("university_name", F.lower(C.strip("program_name")).alias("_n")).agg(
        F.count("*").alias("n"), F.count_if(C.filled("program_description")).alias("d"),
        F.count_if(F.coalesce(F.col("tuition_domestic"), F.lit(0)) != 0).alias("f"),
    )
    return per_name.groupBy(F.col("university_name").alias("_cname")).agg(
        F.sum("n").alias("n_offers"), (F.sum("d") / F.sum("n")).alias("description_coverage"),
        (F.sum("f") / F.sum("n")).alias("fee_coverage"), (F.sum("n") - F.count("*")).alias("duplicates"),
    )


def entity_scores(checks: DataFrame) -> DataFrame:
    return checks.groupBy("entity").agg(
        (F.sum(F.when(F.col("passed"), F.col("weight")).otherwise(0.0)) / F.sum("weight")).alias("score"),
        F.count("*").alias("n_checks"), F.count_if("issue").alias("n_issues"),
    )


def validation_report(checks: DataFrame) -> DataFrame:
    """One row: mean score, four score bands, issues."""
    s = F.col("score")
    return entity_scores(checks).agg(
        F.count("*").alias("n_entities"), F.avg("score").alias("mean_score"), F.count_if(s >= 0.9).alias("excellent"),
        F.count_if((s >= 0.7) & (s < 0.9)).alias("good"), F.count_if((s >= 0.5) & (s < 0.7)).alias("fair"),
        F.count_if(s < 0.5).alias("poor"), F.sum("n_issues").alias("n_issues"),
    )


def milestone_report(scores: DataFrame, milestones: DataFrame, entity: str = "entity", status: str = "status") -> DataFrame:
    """One row: as ``validation_report`` from scores by entity, with how many of the validations are completed."""
    s = F.coalesce("score", F.lit(0.0))
    return milestones.join(scores, entity, "left").agg(
        F.count("*").alias("n_entities"), F.count_if(F.col(status) == "completed").alias("completed"), F.round(F.avg(s), 3).alias("mean_score"),
        F.count_if(s >= 0.9).alias("excellent"), F.count_if((s >= 0.7) & (s < 0.9)).alias("good"), F.count_if((s >= 0.5) & (s < 0.7)).alias("needs_improvement"),
        F.count_if(s < 0.5).alias("critical_issues"))


def distinct_recommendations(validated: DataFrame, recommendations: str = "recommendations") -> DataFrame:
    return validated.select(F.explode(recommendations).alias("recommendation")).groupBy("recommendation").agg(F.count("*").alias("n"))


def issues_by_category(checks: DataFrame) -> DataFrame:
    return checks.filter("issue").groupBy("check").agg(F.count("*").alias("n"))


# --- gates over training runs -----------------------------------------------------------------------


def gate_runs(runs: DataFrame, min_accuracy: float = 0.60, max_accuracy: float = 0.995, min_gap: float = 0.05,
              max_size_mb: float = 100.0, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(check rows per run and rule, verdict per run).

    ``runs`` columns: run_name, model_backend, target_column, class_names, data_hash, leakage_check_passed,
    accuracy, f1_macro, baseline_accuracy, model_size_mb, n_features, n_blocked_documented.
    """
    acc = F.coalesce("accuracy", F.lit(0.0))
    gap = acc - F.coalesce("baseline_accuracy", F.lit(0.0))
    keys = ["model_backend", "target_column", "class_names", "accuracy", "baseline_accuracy", "leakage_check_passed", "data_hash"]
    complete = F.lit(True)
    for k in keys:
        complete = complete & F.col(k).isNotNull()
    perfect = F.greatest(acc, F.coalesce("f1_macro", F.lit(0.0))) >= 1.0 - 1e-6
    rules = [
        ("metadata_complete", complete, "error"),
        ("leakage_check_passed", F.coalesce("leakage_check_passed", F.lit(False)), "error"),
        ("min_accuracy", acc >= min_accuracy, "error"),
        ("max_accuracy", acc < max_accuracy, "warning"),
        ("baseline_gap", gap >= min_gap, "error"),
        ("no_perfect_metrics", ~perfect, "error"),
        ("high_accuracy", acc < 0.98, "warning"),
        ("model_size", F.coalesce("model_size_mb", F.lit(0.0)) <= max_size_mb, "warning"),
        ("feature_list_present", F.coalesce("n_features", F.lit(0)) > 0, "warning"),
        ("leaky_features_documented", F.coalesce("n_blocked_documented", F.lit(0)) > 0, "warning"),
    ]
    cells = F.array(*[F.struct(F.lit(n).alias("check"), c.alias("passed"), F.lit(s).alias("severity")) for n, c, s in rules])
    checks = runs.select("run_name", F.explode(cells).alias("c")).select("run_name", "c.*")
    failing = ~F.col("passed") & (F.lit(strict) | (F.col("severity") == "error"))
    verdict = checks.groupBy("run_name").agg(
        (F.count_if(failing) == 0).alias("passed"),
        F.count_if(~F.col("passed") & (F.col("severity") == "error")).alias("n_errors"),
        F.count_if(~F.col("passed") & (F.col("severity") == "warning")).alias("n_warnings"),
    )
    return checks, verdict


# --- source contracts --------------------------------------------------------------------------------------


def source_contract(df: DataFrame, required, formats: dict[str, str], types: dict[str, str] | None = None, entries: dict[str, tuple] | None = None) -> DataFrame:
    """Rows (check, passed, n_bad): columns present and of the stated type, value formats, no zero-width or no-break characters, complete entries.

    ``entries`` maps a column of map type to (keys every row must have, fields every entry must have): rows that lack a key or an entry's field count as bad.
    """
    spark = df.sparkSession
    there = [(f"present:{c}", c in df.columns, 0 if c in df.columns else 1) for c in required]
    kinds = dict(df.dtypes)
    there += [(f"type:{c}", kinds.get(c) == t, 0 if kinds.get(c) == t else 1) for c, t in (types or {}).items()]
    schema = "check string, passed boolean, n_bad bigint"
    texts = [c for c, t in df.dtypes if t == "string"]
    aggs, names = [], []
    for c, pattern in formats.items():
        if c in df.columns:
            names.append(f"format:{c}")
            aggs.append(F.count_if(F.col(c).isNotNull() & ~F.col(c).cast("string").rlike(pattern)))
    for c in texts:
        names.append(f"clean:{c}")
        aggs.append(F.count_if(F.col(c).rlike("[\\u200B\\u200C\\u200D\\uFEFF\\u00A0]")))
    for c, (keys, fields) in (entries or {}).items():
        if c in df.columns:
            lacks = lambda e, fs=fields: C.any_of([e[f].isNull() for f in fs])
            names += [f"keys:{c}", f"entries:{c}"]
            aggs.append(F.count_if(F.coalesce(C.any_of([~F.map_contains_key(c, F.lit(k)) for k in keys]), F.lit(True))))
            aggs.append(F.count_if(F.coalesce(F.exists(F.map_values(c), lambda e: e.isNull() | lacks(e)), F.lit(False))))
    if not aggs:
        return spark.createDataFrame(there, schema)
    row = df.agg(*[a.alias(f"c{i}") for i, a in enumerate(aggs)])
    cells = F.array(*[F.struct(F.lit(n).alias("check"), (F.col(f"c{i}") == 0).alias("passed"), F.col(f"c{i}").alias("n_bad"))
                      for i, n in enumerate(names)])
    return spark.createDataFrame(there, schema).unionByName(row.select(F.explode(cells).alias("s")).select("s.*"))
