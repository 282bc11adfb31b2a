"""Jobs over landed pages: text, links, link rules, traversal, names, field and ranking extraction."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame, Window, functions as F

from offerloom.functions import columns as C, fixed
from offerloom.session import materialise

DROPPED = r"(?is)<(?:(script|style)(\s[^>]*)?>.*?</\1\s*>|!--.*?-->)"  # comments, too
DROPPED_TAGS = ("nav", "footer", "header")
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
ANCHOR = r"(?is)<a\s[^>]*>.*?</a>"


def _named() -> Column:
    """Entity name to code point: the standard table, and &apos;."""
    return F.create_map(*[F.lit(x) for pair in sorted({**name2codepoint, "apos": 39}.items()) for x in pair])


def _entity(mark: Column) -> Column:
    """The character of one entity; unknown names stay as they are, a no-break space is a blank."""
    body = F.substring(mark, F.lit(2), F.length(mark) - 2)
    digits = F.regexp_extract(body, r"^#[xX]?([0-9a-fA-F]+)$", 1)
    code = F.when(body.rlike("^#[xX]"), F.conv(digits, 16, 10).cast("int")).when(body.startswith("#"), digits.cast("int")).otherwise(
        F.try_element_at(_named(), body))
    valid = (code > 0) & (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
    return (F.when(code.isNull(), mark).when(code == 0xA0, F.lit(" "))
            .when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(F.lit("\ufffd")))


def unescape(c: Column) -> Column:
    """Numeric and named entities decoded once, in one pass."""
    def decode(t):
        marks = F.regexp_extract_all(t, F.lit(ENTITY), F.lit(0))
        whole = F.zip_with(F.split(t, ENTITY), marks, lambda text, m: F.concat(text, F.when(m.isNull(), F.lit("")).otherwise(_entity(m))))
        return F.when(t.contains("&"), F.array_join(whole, "")).otherwise(t)

    return C.bind(c, decode)


def _step(p: Column) -> Column:
    """What a piece's first tag adds to the depth."""
    return F.when(~p.startswith("<"), 0).when(p.startswith("</"), -1).when(p.rlike(r"^<[^>]*/>"), 0).otherwise(1)


def _depths(pieces: Column, start: int = 0) -> Column:
    """Depth after each piece's first tag; pieces begin with an opening or a closing tag or with none."""
    step = _step
    last = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(start))
    return F.aggregate(pieces, F.array().cast("array<int>"), lambda a, p: F.array_append(a, F.greatest(last(a) + step(p), F.lit(0))))


def without_blocks(html: Column, tags=DROPPED_TAGS) -> Column:
    """The text outside all blocks of these tags, however deep they nest; an unclosed block reaches to the end.

    The blank before the text keeps its first piece from beginning with a tag."""
    cut = rf"(?i)(?=</?(?:{'|'.join(tags)})[\s/>])"
    outside = lambda ps: F.zip_with(ps, _depths(ps), lambda p, d: F.when(d == 0, F.regexp_replace(p, rf"(?i)^</?(?:{'|'.join(tags)})[^>]*>?", " ")).otherwise(F.lit("")))
    return C.bind(html, lambda t: F.when(t.rlike(cut), C.bind(F.split(F.concat(F.lit(" "), t), cut), lambda ps: F.array_join(outside(ps), ""))).otherwise(t))


def plain_text(html) -> Column:
    """Visible text: blocks without content dropped, tags to blanks, entities decoded, whitespace collapsed."""
    t = without_blocks(F.regexp_replace(C._c(html), DROPPED, " "))
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    return C.strip(F.regexp_replace(unescape(t), r"[ \t\n\r\f\v]{2,}|[\t\n\r\f\v]", " "))


def page_text(pages: DataFrame, html: str = "html", min_chars: int = 100, max_chars: int | None = None) -> DataFrame:
    """Adds ``text`` and ``status``. Texts stay whole unless a consumer's limit is passed as ``max_chars``."""
    out = pages.withColumn("text", plain_text(html))
    out = out.withColumn("status", F.when(F.length("text") < min_chars, "too_short").otherwise("ok"))
    if max_chars is not None:
        long = F.length("text") > max_chars
        out = out.withColumn("status", F.when(long, "truncated").otherwise(F.col("status"))).withColumn(
            "text", F.when(long, F.concat(F.substring("text", 1, max_chars), F.lit("\n... [content truncated]"))).otherwise(F.col("text"))
        )
    return out


# --- links ---------------------------------------------------------------------------------------------


def scheme_of(url) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def host_of(url) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def path_of(url) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def resolve(base: Column, href: Column) -> Column:
    """Absolute form of a link found on a page."""
    root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    plain = F.regexp_extract(base, r"^([^?#]*)", 1)
    folder = F.when(F.length(plain) > F.length(root), F.regexp_replace(plain, r"[^/]*$", "")).otherwise(F.concat(root, F.lit("/")))
    joined = (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme_of(base), F.lit(":"), href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(plain, href))
        .otherwise(F.concat(folder, href))
    )
    return C.bind(joined, lambda u: F.when(u.rlike(r"/\.\.?(/|$|[?#])"), _tidy(u)).otherwise(u))


def _tidy(url: Column) -> Column:
    """The url without "." and ".." segments, of which there may be any number."""
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#]*)(.*)$"
    segments = F.split(F.regexp_extract(url, parts, 2), "/")
    folded = F.aggregate(segments, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(1))))
                         .when(s == ".", a).otherwise(F.array_append(a, s)))
    path = F.concat(F.array_join(folded, "/"), F.when(F.element_at(segments, -1).isin(".", ".."), F.lit("/")).otherwise(F.lit("")))
    return F.when(url.rlike(parts), F.concat(F.regexp_extract(url, parts, 1), path, F.regexp_extract(url, parts, 3))).otherwise(url)


def excluded(href) -> Column:
    return C.bind(F.lower(C._c(href)), lambda h: C.contains_any(h, fixed.EXCLUDED_LINK_PARTS))


def extract_links(pages: DataFrame, url: str = "url", html: str = "html", min_text: int = 3, max_text: int = 200) -> DataFrame:
    """(page_url, position, url, text) of each page's usable links, first occurrence per page and target."""
    anchors = pages.select(F.col(url).alias("page_url"), F.posexplode(F.regexp_extract_all(html, F.lit(ANCHOR), F.lit(0))).alias("position", "a"))
    tag = F.regexp_extract("a", r"(?is)^(<a\s[^>]*>)", 1)
    value = r"(?is)\shref\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))"
    href = C.strip(F.concat(*[F.regexp_extract(tag, value, i) for i in (1, 2, 3)]))  # one group matches, the others are empty
    text = C.strip(F.regexp_replace(unescape(F.regexp_replace(F.regexp_replace("a", r"<[^>]+>", " "), r"\s+", " ")), r"\s+", " "))
    rows = anchors.select("page_url", "position", unescape(href).alias("href"), text.alias("text")).filter(
        (F.col("href") != "") & ~excluded("href") & F.length("text").between(min_text, max_text)
    )
    rows = rows.select("page_url", "position", resolve(F.col("page_url"), F.col("href")).alias("url"), "text")
    return rows.groupBy("page_url", "url").agg(F.min("position").alias("position"), F.min_by("text", "position").alias("text"))


def _segments(url: Column) -> Column:
    return F.filter(F.split(path_of(url), "/"), lambda s: s != "")


def link_rule(url, text) -> Column:
    """Name of the first rule that accepts (+) or rejects (-) a link as a programme page."""
    return C.bind(F.struct(F.lower(C._c(url)).alias("u"), F.lower(C._c(text)).alias("t"), _segments(F.lower(C._c(url))).alias("g")), _link_rule)


def _link_rule(link: Column) -> Column:
    u, t, segs = link["u"], link["t"], link["g"]
    last = F.regexp_replace(F.coalesce(F.try_element_at(segs, F.lit(-1)), F.lit("")), r"\.html?", "")
    parent = F.coalesce(F.when(F.size(segs) >= 2, F.try_element_at(segs, F.lit(-2))), F.lit(""))
    deep = F.size(segs) >= 2
    detail = F.regexp_extract(u, r"/detail/([a-z0-9-]+)/?$", 1)
    good_detail = (F.length(detail) > 5) & detail.contains("-")
    nested = F.regexp_extract(u, r"/degree-programmes?/[^/]+/([a-z0-9-]+)\.html$", 1)
    at = F.array_position(segs, "courses")
    after = F.get(segs, (at + 1).cast("int"))
    course = F.when(after.rlike("^[0-9]+$") & (F.size(segs) > at + 2), F.get(segs, (at + 2).cast("int"))).otherwise(after)
    course_ok = (F.size(segs) >= 4) & (at > 0) & (at + 1 < F.size(segs)) & course.contains("-") & ~course.isin(
        *fixed.GENERIC_SEGMENTS, *fixed.ADMIN_SEGMENTS)
    coded = last.rlike("^(" + "|".join(fixed.DEGREE_CODES) + ")(-|$)")
    return (
        F.when(u.contains("/degree-programs/") & good_detail, "+program_detail")
        .when(C.contains_any(t, fixed.LINK_SKIP_TEXTS), "-skip_text")
        .when(C.contains_any(u, fixed.LINK_SKIP_SECTIONS), "-skip_section")
        .when(C.ends_with_any(u, fixed.LINK_LISTING_ENDINGS), "-listing")
        .when(good_detail, "+detail")
        .when((nested != "") & ~nested.isin(*fixed.CATEGORY_SLUGS), "+nested_program")
        .when(u.rlike("|".join(fixed.DEGREE_PREFIX_PATTERNS)), "+degree_prefix")
        .when(deep & last.isin(*fixed.GENERIC_SEGMENTS), "-generic_segment")
        .when(deep & coded, "+degree_code")
        .when(deep & parent.isin(*fixed.DEGREE_DIRECTORIES) & last.contains("-") & (F.length(last) > 5) & ~u.contains("?")
              & ~C.contains_any(t, fixed.DIRECTORY_SKIP_TEXTS), "+degree_directory")
        .when(F.coalesce(course_ok, F.lit(False)), "+course_path")
        .when(deep & last.contains("-") & (F.length(last) > 8) & (F.length(t) > 10) & C.contains_any(t, fixed.SUBJECT_WORDS)
              & ~C.contains_any(t, fixed.NAVIGATION_WORDS), "+subject_text")
        .otherwise("-no_rule")
    )


def slug_title(url) -> Column:
    """Last path segment as a title; degree codes upper, small words lower."""
    slug = F.regexp_replace(F.coalesce(F.try_element_at(_segments(C._c(url)), F.lit(-1)), F.lit("")), r"\.html?", "")
    words = F.filter(F.split(F.translate(slug, "-_", "  "), " +"), lambda w: w != "")
    codes = ["BSC", "MSC", "MBA", "PHD", "BA", "MA", "MENG", "BENG", "LLM", "LLB"]
    small = ["of", "and", "in", "for", "the", "with"]
    cased = F.transform(words, lambda w: F.when(F.upper(w).isin(*codes), F.upper(w)).when(F.lower(w).isin(*small), F.lower(w)).otherwise(
        F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))))
    return F.array_join(cased, " ")


def program_links(links: DataFrame, url_pattern: str | None = None, category_filter: str | None = None) -> DataFrame:
    """Programme links with category and level, one row per target.

    With a URL pattern the pattern decides and the name may come from the URL; without, the link rules decide.
    """
    if url_pattern:
        kept = links.filter(F.col("url").rlike("(?i)" + url_pattern))
        name = F.when(F.length(F.coalesce("text", F.lit(""))) > 3, F.col("text")).otherwise(slug_title("url"))
    else:
        kept = links.filter(F.length("text").between(3, 200)).filter(link_rule("url", "text").startswith("+"))
        name = F.col("text")
    kept = kept.withColumn("program_name", name).filter(F.col("program_name") != "")
    kept = kept.withColumn("category", C.link_category(F.col("program_name"), F.col("url")))
    if category_filter:
        kept = kept.filter(F.lower("category") == category_filter.lower())
    first = F.struct("page_url", "position")
    one = kept.groupBy("url").agg(F.min_by(F.struct("program_name", "category"), first).alias("r"))
    return one.select("r.program_name", F.col("url").alias("program_url"), "r.category",
                      C.link_level(F.col("r.program_name"), F.col("url")).alias("degree_level"))


def relevant_internal_links(links: DataFrame, base: str = "page_url", url: str = "url") -> DataFrame:
    """Links on the same or a related host, not excluded, not files; flags programme pages."""
    u, b = F.col(url), F.col(base)
    lu = F.lower(u)
    same = host_of(u).endswith(host_of(b)) | host_of(b).endswith(host_of(u))
    ok = scheme_of(u).isin("http", "https") & same & ~excluded(u) & ~C.ends_with_any(lu, fixed.FILE_ENDINGS)
    words = sorted({w for _, ws in fixed.LINK_CATEGORY_WORDS for w in ws} | {w for ws in fixed.LEVEL_KEYWORDS.values() for w in ws}
                   | set(fixed.EXTRA_PROGRAM_KEYWORDS))
    program = (C.hits(lu, words) >= 2) | C.contains_any(lu, fixed.PROGRAM_PATHS)
    return links.filter(ok).withColumn("is_program", program)


def reachable_pages(links: DataFrame, seeds: DataFrame, depth: int = 2, fan_out: int = 5, max_pages: int | None = 10) -> DataFrame:
    """Pages reached from each seed by following the first ``fan_out`` links of a page, breadth first.

    ``links``: page_url, position, url. ``seeds``: url. A page's followed links are at most ``fan_out`` rows,
    fixed before the loop. ``max_pages`` is the visit budget of a seed; None visits everything within depth.
    Each round is materialised in the shared folder, so plans stay short and lost executors cost one round.
    """
    w = Window.partitionBy("page_url").orderBy("position", "url")
    edges = materialise(links.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= fan_out)
                        .select(F.col("page_url").alias("src"), F.col("url").alias("dst"), F.col("_rn").alias("n")))
    visited = seeds.select(F.col("url").alias("seed"), F.col("url")).distinct().withColumn("depth", F.lit(0)).withColumn("place", F.lit(1))
    frontier = visited
    for d in range(1, depth + 1):
        step = frontier.join(edges, frontier["url"] == edges["src"]).select(
            "seed", F.col("dst").alias("url"), (F.col("place") * (fan_out + 1) + F.col("n")).alias("place"))
        fresh = step.groupBy("seed", "url").agg(F.min("place").alias("place")).join(visited.select("seed", "url"), ["seed", "url"], "left_anti")
        frontier = fresh.select("seed", "url", F.lit(d).alias("depth"), "place")
        if max_pages is not None:
            room = visited.groupBy("seed").agg((F.lit(max_pages) - F.count("*")).alias("room"))
            order = Window.partitionBy("seed").orderBy("place", "url")
            frontier = frontier.withColumn("_rn", F.row_number().over(order)).join(room, "seed").filter(
                F.col("_rn") <= F.col("room")).select("seed", "url", "depth", "place")
        frontier = materialise(frontier)
        visited = visited.unionByName(frontier)
    return visited.select("seed", "url", "depth")


# --- names and degrees from urls -------------------------------------------------------------------------


def name_from_url(url) -> Column:
    """Programme name guessed from the last meaningful path segment, null when it is too short."""
    segs = F.filter(F.split(F.try_url_decode(path_of(C._c(url))), "/"), lambda s: (s != "") & ~s.isin(*fixed.NAME_SKIP_SEGMENTS))
    seg = F.try_element_at(segs, F.lit(-1))
    seg = F.regexp_replace(seg, r"\.(html?|php|aspx?)$", "")
    seg = F.regexp_replace(F.regexp_replace(seg, r"^[a-z][0-9]{3,}[-_]", ""), r"[-_]?[0-9]{4,}$", "")
    name = C.strip(F.regexp_replace(seg, r"[-_]+", " "))
    titled = C.title_case(name)
    for pattern, prefix in [(r"(?i)^(Msc\s?|Ms\s)", "MSc "), (r"(?i)^(Bsc\s?|Bs\s)", "BSc "), (r"(?i)^(Phd|Ph\s?D\s)", "PhD "),
                            (r"(?i)^Mba\s?", "MBA "), (r"(?i)^Ma\s+(?!ster)", "MA ")]:
        titled = F.regexp_replace(titled, pattern, prefix)
    titled = C.strip(F.regexp_replace(titled, r"\s+", " "))
    return F.when((F.length(name) >= 3) & (F.length(titled) >= 5), titled)


def degree_from_url(url, name=None) -> Column:
    name = F.coalesce(C._c(name) if name is not None else F.lit(""), F.lit(""))
    return C.bind(F.concat(F.lower(C._c(url)), F.lit(" "), F.lower(name)), _degree_of)


def _degree_of(t: Column) -> Column:
    under = C.contains_any(t, ["/undergraduate", "/bsc", "/bachelor", "/ba/", "bachelor-of"])
    return (
        F.when(C.contains_any(t, ["/phd", "doctoral", "doctorate", "research-degree", "/research/", "dphil"]), "Doctor of Philosophy")
        .when(under & t.contains("engineering"), "Bachelor of Engineering")
        .when(under & C.contains_any(t, ["arts", "humanities", "literature", "history"]), "Bachelor of Arts")
        .when(under, "Bachelor of Science")
        .when(C.contains_any(t, ["/mba", "business-administration"]), "Master of Business Administration")
        .when(C.contains_any(t, ["mphil", "master-of-philosophy"]), "Master of Philosophy")
        .when(C.contains_any(t, ["meng", "master-of-engineering"]), "Master of Engineering")
        .when(C.contains_any(t, ["master-of-arts", "/ma-", "-ma/", "/ma/"]), "Master of Arts")
        .otherwise("Master of Science")
    )


# --- fields -----------------------------------------------------------------------------------------------------


def offer_fields(html, text) -> dict[str, Column]:
    """Title, fees and test scores as expressions over a page's html and lower-cased text."""
    t = C._c(text)
    none = lambda c: F.nullif(c, F.lit(""))  # worked out once, as in a condition and its result it would be twice
    money = r"(?:£|\$|€|sgd|usd|gbp)\s*([0-9,]+)"
    plus = lambda c: F.concat(none(c), F.lit("+"))
    return {
        "program_name": none(C.strip(unescape(F.regexp_replace(F.regexp_extract(html, r"(?is)<h1[^>]*>(.*?)</h1>", 1), r"<[^>]+>", "")))),
        "fee_domestic": none(F.regexp_extract(t, r"(?s)domestic.*?" + money, 1)),
        "fee_international": none(F.regexp_extract(t, r"(?s)international.*?" + money, 1)),
        "ielts_score": plus(F.regexp_extract(t, r"ielts\s*[:\-]?\s*([0-9.]+)", 1)),
        "toefl_score": plus(F.regexp_extract(t, r"toefl\s*[:\-]?\s*([0-9]{2,3})", 1)),
        "pte_score": plus(F.regexp_extract(t, r"pte\s*[:\-]?\s*([0-9]{2,3})", 1)),
    }


BOX = r"(?is)(?=<(?:div|li|span)\s[^>]*class\s*=\s*[\"']?[^\"'>]*(?:badge-description|detail-box))"
BOX_TAG = r"(?i)(?=</?(?:div|li|span)[\s/>])"
LABEL = r"(?is)<(?:label|span class=[\"']?(?:label|title)[\"']?)[^>]*>(.*?)</"
VALUE = r"(?is)class=[\"']?(?:value|detail-value)[\"']?[^>]*>(.*?)</"


BOX_FIELDS = ("duration", "tuition_fee_summary", "degree_type", "study_level")


def _first_element(piece: Column) -> Column:
    """What the element that opens the piece encloses, tags inside it included."""
    def deeper(s, p):  # the depth, -1 once the element has closed, and how many pieces lie in it
        return F.when(s["depth"] < 0, s).otherwise(C.bind(F.greatest(s["depth"] + _step(p), F.lit(0)), lambda d: F.struct(
            F.when(d == 0, -1).otherwise(d).alias("depth"), (s["n"] + F.when(d == 0, 0).otherwise(1)).alias("n"))))

    def cut(tags):
        begin = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("n"))
        return F.array_join(F.slice(tags, F.lit(1), F.aggregate(tags, begin, deeper, lambda s: s["n"])), "")

    return C.bind(F.split(piece, BOX_TAG), cut)


def detail_boxes(html) -> Column:
    """Labelled boxes as a struct: duration, fees, degree and level by words in the label; the last box of a kind wins."""
    boxes = C.bind(F.split(F.concat(F.lit(" "), html), BOX), lambda a: F.transform(F.slice(a, F.lit(2), F.size(a)), _first_element))
    kind = lambda l: (F.when(l.contains("duration"), "duration").when(l.contains("tuition") | l.contains("fee"), "tuition_fee_summary")
                      .when(l.contains("degree"), "degree_type").when(l.contains("level"), "study_level"))
    pairs = F.transform(boxes, lambda b: F.struct(C.bind(F.lower(F.regexp_extract(b, LABEL, 1)), kind).alias("k"),
                                                  C.strip(F.regexp_extract(b, VALUE, 1)).alias("v")))
    pick = lambda ps, n: F.try_element_at(F.transform(F.filter(ps, lambda p: (p["k"] == n) & (p["v"] != "")), lambda p: p["v"]), F.lit(-1))
    return C.bind(pairs, lambda ps: F.struct(*[pick(ps, n).alias(n) for n in BOX_FIELDS]))


def _all_fields(df: DataFrame, html: str) -> DataFrame:
    """Adds every offer field; text and boxes are worked out once per page."""
    staged = df.withColumn("_t", F.lower(plain_text(html))).withColumn("_b", detail_boxes(html))
    fields = offer_fields(html, "_t")
    return staged.select(*df.columns, *[c.alias(n) for n, c in fields.items()], "_b.*")


def extract_offer_fields(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    return _all_fields(pages.select(F.col(url).alias("program_url"), F.col(html).alias("_html")), "_html").drop("_html")


def merge_over(discovery: DataFrame, detail: DataFrame, key: str) -> DataFrame:
    """Discovery rows with every non-null detail field taking over. Of several detail rows of a key the one that is smallest as JSON counts."""
    row = F.struct(*detail.columns)
    d = detail.groupBy(key).agg(F.min_by(row, F.to_json(row)).alias("_row")).select("_row.*").select(*[F.col(c).alias(c if c == key else f"_d_{c}") for c in detail.columns])
    j = discovery.join(d, key, "left")
    own = set(discovery.columns)
    cols = [F.coalesce(f"_d_{c}", c).alias(c) if c != key and c in detail.columns else F.col(c) for c in discovery.columns]
    return j.select(*cols, *[F.col(f"_d_{c}").alias(c) for c in detail.columns if c not in own])


def extract_ranking_rows(pages: DataFrame, marker: str, patterns: dict[str, str], base_url: str, html: str = "html", subject: Column | None = None,
                         keys=()) -> DataFrame:
    """Ranking items of a page: html cut at ``marker``; rank, name, location, score, profile by patterns.

    Items without a name are dropped.
    """
    items = pages.select(*keys, *([subject.alias("subject")] if subject is not None else []),
                         F.posexplode(C.bind(F.split(html, marker), lambda a: F.slice(a, F.lit(2), F.size(a)))).alias("position", "_i"))
    got = {k: C.strip(unescape(F.regexp_replace(F.regexp_extract("_i", p, 1), r"<[^>]+>", ""))) for k, p in patterns.items()}
    loc = got["location"]
    href = got["profile_url"]
    out = items.select(
        *keys, *(["subject"] if subject is not None else []), "position",
        C.found(got["rank"], r"([0-9]+)", 1, "int").alias("rank"), got["name"].alias("university_name"),
        C.location_country(loc).alias("country"), C.location_city(loc).alias("city"),
        C.found(got["score"], r"([0-9]+\.?[0-9]*)").alias("score"),
        F.when(href.startswith("http"), href).when(href != "", F.concat(F.lit(base_url), href)).alias("profile_url"),
    )
    return out.filter(F.col("university_name") != "")


# --- pluggable extraction --------------------------------------------------------------------------------------------


def fingerprint(content, *settings) -> Column:
    return F.md5(F.concat_ws("\u0001", content, *[F.lit(str(s)) for s in settings]))


def dedup_by_content(pages: DataFrame, content: str, key: str, *settings) -> tuple[DataFrame, DataFrame]:
    """(one row per distinct content, page -> fingerprint map). Only fingerprints and keys are compared."""
    marked = pages.withColumn("fingerprint", fingerprint(F.col(content), *settings))
    chosen = marked.groupBy("fingerprint").agg(F.min(key).alias(key))
    distinct = marked.join(chosen, ["fingerprint", key])
    return distinct, marked.select(key, "fingerprint")


def strip_fences(c) -> Column:
    t = C.strip(c)
    t = F.regexp_replace(F.regexp_replace(t, r"^```json", ""), r"^```", "")
    return C.strip(F.regexp_replace(t, r"```$", ""))


def json_text(c) -> Column:
    """The JSON object in an extractor's answer: the text itself, else from the first '{' to the last '}'."""
    t = strip_fences(c)
    inner = F.regexp_extract(t, r"(?s)(\{.*\})", 1)
    valid = lambda x: F.try_parse_json(x).isNotNull()
    return F.when(valid(t), t).when((inner != "") & valid(inner), inner)


def response_score(c) -> Column:
    """Plausibility of an answer: valid JSON, expected words, length."""
    t = C._c(c)
    valid = F.try_parse_json(t).isNotNull()
    score = (F.lit(0.5) + F.when(valid, 0.3).otherwise(-0.2) + F.when(C.contains_any(F.lower(t), fixed.RESPONSE_WORDS), 0.1).otherwise(0.0)
             + F.when(F.length(t) < 50, -0.2).when(F.length(t) > 200, 0.1).otherwise(0.0))
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def parse_extractions(df: DataFrame, text: str) -> DataFrame:
    """Adds ``fields`` (map of non-empty top-level values as text, null when no JSON) and ``response_score``."""
    parsed = F.from_json(json_text(text), "map<string,string>")
    kept = F.map_filter(parsed, lambda k, v: v.isNotNull() & ~v.isin("", "[]", "null"))
    return df.withColumn("fields", kept).withColumn("response_score", response_score(text))


def extract_with(pages: DataFrame, fn=None, schema: str | None = None, key: str = "url", content: str = "html") -> DataFrame:
    """Batch extraction once per distinct content, results by page.

    ``fn(iterator of pandas frames with fingerprint and content) -> iterator of frames`` runs in
    ``mapInPandas`` over the distinct contents spread evenly. Without ``fn`` the built-in field rules are
    used, which stay in the JVM.
    """
    distinct, by_page = dedup_by_content(pages, content, key)
    if fn is None:
        found = _all_fields(distinct.select("fingerprint", content), content).drop(content)
    else:
        spread = distinct.select("fingerprint", F.col(content).alias("content")).repartition("fingerprint")
        found = spread.mapInPandas(fn, schema)
    return by_page.join(found, "fingerprint", "left")


def extraction_counts(extracted: DataFrame, field: str) -> DataFrame:
    return extracted.agg(F.count_if(F.col(field).isNotNull()).alias("successful"), F.count_if(F.col(field).isNull()).alias("failed"))
