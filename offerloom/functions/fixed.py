"""Word lists, lookup tables, thresholds and patterns.

Everything here is a value that results depend on, stated as plain text in its natural order.
The logic that uses them lives elsewhere.
"""

# --- tiers and scoring -------------------------------------------------------------------
TIER_WEIGHTS = {"top": 1.0, "good": 0.6, "standard": 0.2}
BAND_HIGH = 0.80
BAND_MEDIUM = 0.50
TOP_THRESHOLD = 0.70
GOOD_THRESHOLD = 0.35
REGIONAL_DISCOUNT = 0.70

# ranking system -> (scope, largest rank, weight beside the world rank)
WORLD_SYSTEM = "QS World University Rankings"
RANKING_SYSTEMS = [
    ("QS World University Rankings", "world", 1500, 0.60),
    ("QS WUR Ranking By Subject", "global", 900, 0.20),
    ("QS Sustainability Ranking", "global", 1400, 0.10),
    ("QS Graduate Employability Rankings", "global", 1000, 0.10),
    ("Asian University Rankings", "regional", 1400, None),
    ("Europe University Rankings", "regional", 900, None),
    ("Latin America and the Caribbean Rankings", "regional", 400, None),
    ("EECA University Rankings", "regional", 400, None),
    ("Arab Region University Rankings", "regional", 300, None),
]

# --- money: units of US dollar per unit of currency ---------------------------------------
USD_RATES = {
    "USD": 1.0, "GBP": 1.27, "EUR": 1.08, "CAD": 0.74, "AUD": 0.65, "CHF": 1.13,
    "JPY": 0.0067, "CNY": 0.14, "INR": 0.012, "KRW": 0.00075, "SGD": 0.74, "HKD": 0.13,
    "SEK": 0.096, "DKK": 0.145, "NOK": 0.094, "NZD": 0.60, "RUB": 0.011, "BRL": 0.20,
    "MXN": 0.058, "SAR": 0.27, "AED": 0.27, "TRY": 0.031, "PLN": 0.25, "CZK": 0.044,
    "TWD": 0.031, "THB": 0.028, "IDR": 0.000063, "PKR": 0.0036, "EGP": 0.020, "ZAR": 0.055,
    "ARS": 0.0010, "CLP": 0.0011, "COP": 0.00024, "PHP": 0.018, "ILS": 0.27, "MYR": 0.22,
}

# order in which a fee text is searched for its currency: code, then symbol if any
FEE_CURRENCY_MARKS = [
    ("GBP", ["GBP", "£"]),
    ("EUR", ["EUR", "€"]),
    ("AUD", ["AUD"]),
    ("CAD", ["CAD"]),
    ("SGD", ["SGD"]),
    ("USD", ["USD", "$"]),
]

# --- degrees ------------------------------------------------------------------------------
DEFAULT_DEGREE = "Master of Science"
DEGREE_NAMES = {
    "bsc": "Bachelor of Science",
    "b.sc": "Bachelor of Science",
    "bs": "Bachelor of Science",
    "b.s.": "Bachelor of Science",
    "bachelor": "Bachelor of Science",
    "bachelor of science": "Bachelor of Science",
    "ba": "Bachelor of Arts",
    "b.a.": "Bachelor of Arts",
    "bachelor of arts": "Bachelor of Arts",
    "beng": "Bachelor of Engineering",
    "b.eng": "Bachelor of Engineering",
    "bachelor of engineering": "Bachelor of Engineering",
    "bba": "Bachelor of Business Administration",
    "bachelor of business": "Bachelor of Business Administration",
    "bachelor of business administration": "Bachelor of Business Administration",
    "mbbs": "Bachelor of Medicine",
    "bachelor of medicine": "Bachelor of Medicine",
    "md": "Bachelor of Medicine",
    "llb": "Bachelor of Laws",
    "bachelor of laws": "Bachelor of Laws",
    "bed": "Bachelor of Education",
    "bachelor of education": "Bachelor of Education",
    "msc": "Master of Science",
    "m.sc": "Master of Science",
    "ms": "Master of Science",
    "m.s.": "Master of Science",
    "master": "Master of Science",
    "master of science": "Master of Science",
    "masters": "Master of Science",
    "ma": "Master of Arts",
    "m.a.": "Master of Arts",
    "master of arts": "Master of Arts",
    "meng": "Master of Engineering",
    "m.eng": "Master of Engineering",
    "master of engineering": "Master of Engineering",
    "mphil": "Master of Philosophy",
    "m.phil": "Master of Philosophy",
    "master of philosophy": "Master of Philosophy",
    "mba": "Master of Business Administration",
    "master of business administration": "Master of Business Administration",
    "llm": "Master of Laws",
    "master of laws": "Master of Laws",
    "med": "Master of Education",
    "master of education": "Master of Education",
    "mph": "Master of Public Health",
    "master of public health": "Master of Public Health",
    "phd": "Doctor of Philosophy",
    "ph.d.": "Doctor of Philosophy",
    "doctor of philosophy": "Doctor of Philosophy",
    "doctorate": "Doctor of Philosophy",
    "dphil": "Doctor of Philosophy",
    "dsc": "Doctor of Science",
    "d.sc": "Doctor of Science",
    "doctor of science": "Doctor of Science",
    "doctor of medicine": "Doctor of Medicine",
    "edd": "Doctor of Education",
    "doctor of education": "Doctor of Education",
    "dba": "Doctor of Business Administration",
    "doctor of business administration": "Doctor of Business Administration",
    "pgdip": "Master of Arts",
    "pgcert": "Master of Arts",
    "postgraduate diploma": "Master of Arts",
    "postgraduate certificate": "Master of Arts",
    "diploma": "Master of Arts",
    "certificate": "Master of Arts",
    "mst": "Master of Arts",
    "mth": "Master of Arts",
    "mres": "Master of Science",
    "mlitt": "Master of Arts",
    "mmus": "Master of Arts",
}

# short map of the format standardisation step; other texts stay as they are
DEGREE_NAMES_SHORT = {
    "bachelor of science": "Bachelor of Science",
    "bachelor of arts": "Bachelor of Arts",
    "bachelors": "Bachelor of Science",
    "master of science": "Master of Science",
    "master of arts": "Master of Arts",
    "masters": "Master of Science",
    "msc": "Master of Science",
    "ms": "Master of Science",
    "ma": "Master of Arts",
    "phd": "Doctor of Philosophy",
    "doctorate": "Doctor of Philosophy",
    "doctoral": "Doctor of Philosophy",
}

# ordered: the first level with a matching word wins ("MBA" is Undergraduate through "ba")
LEVEL_WORDS = [
    ("Undergraduate", ["bachelor", "bsc", "ba", "beng", "undergraduate", "ug"]),
    ("PhD", ["phd", "doctoral", "doctorate", "dphil", "research degree"]),
    ("Masters", ["master", "msc", "ma", "mba", "meng", "mphil"]),
    ("Graduate", ["graduate", "postgraduate", "pg"]),
]
LINK_LEVEL_WORDS = [
    ("PhD", ["phd", "doctor", "doctoral", "dphil", "research degree"]),
    ("Masters", ["master", "msc", "ma", "mba", "meng", "mphil", "postgraduate taught"]),
    ("Undergraduate", ["bachelor", "bsc", "ba", "beng", "undergraduate"]),
    ("Graduate", ["graduate", "postgraduate"]),
]

# --- subject categories: two keyword tables --------------------------------------------------
CATEGORY_WORDS = [
    ("Computer Science", ["computer", "computing", "informatics", "software", "ai", "machine learning",
                          "data science", "cybersecurity", "it"]),
    ("Networking", ["network", "telecommunication", "wireless"]),
    ("Business", ["business", "mba", "management", "finance", "accounting", "marketing", "economics",
                  "commerce"]),
    ("Medical", ["medicine", "medical", "healthcare", "nursing", "pharmacy", "dentistry", "health",
                 "clinical", "biomedical"]),
    ("Education", ["education", "teaching", "pedagogy", "curriculum", "tesol"]),
    ("Engineering", ["engineering", "mechanical", "electrical", "civil", "chemical", "aerospace"]),
    ("Law", ["law", "legal", "jurisprudence", "llm", "jd"]),
    ("Arts & Humanities", ["arts", "humanities", "literature", "history", "philosophy", "linguistics",
                           "music"]),
    ("Sciences", ["biology", "chemistry", "physics", "mathematics", "statistics", "environmental"]),
]
LINK_CATEGORY_WORDS = [
    ("Computer Science", ["computer science", "computing", "informatics", "software engineering",
                          "artificial intelligence", "machine learning", "data science", "cybersecurity",
                          "information technology", "computer engineering"]),
    ("Networking", ["networking", "network engineering", "telecommunications", "network security",
                    "network administration", "computer networks", "wireless networks"]),
    ("Business", ["business", "mba", "management", "finance", "accounting", "marketing",
                  "entrepreneurship", "business administration", "commerce", "economics",
                  "international business", "supply chain", "operations management"]),
    ("Medical", ["medicine", "medical", "healthcare", "nursing", "pharmacy", "dentistry",
                 "public health", "biomedical", "clinical", "health sciences", "physiotherapy",
                 "occupational therapy", "medical imaging", "pathology"]),
    ("Education", ["education", "teaching", "pedagogy", "curriculum", "educational leadership",
                   "special education", "early childhood", "educational psychology", "tesol",
                   "educational technology"]),
    ("Engineering", ["engineering", "mechanical", "electrical", "civil", "chemical", "aerospace",
                     "industrial", "environmental engineering", "materials science"]),
    ("Law", ["law", "legal", "jurisprudence", "llm", "jd"]),
    ("Arts & Humanities", ["arts", "humanities", "literature", "history", "philosophy", "linguistics",
                           "languages", "music", "fine arts", "creative writing"]),
    ("Sciences", ["biology", "chemistry", "physics", "mathematics", "statistics",
                  "environmental science", "geology", "astronomy"]),
]
LEVEL_KEYWORDS = {
    "Undergraduate": ["bachelor", "bsc", "ba", "beng", "bba", "undergraduate", "ug"],
    "Graduate": ["graduate", "postgraduate", "pg"],
    "Masters": ["master", "msc", "ma", "mba", "meng", "mphil", "masters", "taught masters"],
    "PhD": ["phd", "doctorate", "doctoral", "dphil", "research degree"],
}
EXTRA_PROGRAM_KEYWORDS = ["program", "programme", "course", "degree", "study", "major", "curriculum",
                          "admission", "apply", "enrol", "enroll"]

# --- places -------------------------------------------------------------------------------------
CITY_PATTERNS = [
    ("London", ["London", "UCL", "Imperial", "King's College London", "LSE"]),
    ("Cambridge", ["Cambridge"]),
    ("Oxford", ["Oxford"]),
    ("Edinburgh", ["Edinburgh"]),
    ("Manchester", ["Manchester"]),
    ("Boston", ["MIT", "Harvard", "Boston"]),
    ("Stanford", ["Stanford"]),
    ("New York", ["Columbia", "NYU", "New York"]),
    ("Chicago", ["Chicago"]),
    ("Toronto", ["Toronto"]),
    ("Melbourne", ["Melbourne"]),
    ("Sydney", ["Sydney"]),
    ("Zurich", ["ETH Zurich", "Zurich"]),
    ("Munich", ["Munich", "München", "TUM", "LMU"]),
    ("Berlin", ["Berlin", "Humboldt", "Freie"]),
    ("Paris", ["Paris", "PSL", "Sorbonne", "Polytechnique"]),
    ("Amsterdam", ["Amsterdam"]),
    ("Tokyo", ["Tokyo"]),
    ("Beijing", ["Peking", "Tsinghua", "Beijing"]),
    ("Shanghai", ["Shanghai", "Fudan", "Jiao Tong"]),
    ("Singapore", ["Singapore", "NUS", "NTU"]),
    ("Hong Kong", ["Hong Kong"]),
    ("Seoul", ["Seoul", "Korea", "KAIST"]),
]
CAPITALS = {
    "United States of America": "Washington, D.C.", "United Kingdom": "London", "Canada": "Ottawa",
    "Australia": "Canberra", "Germany": "Berlin", "France": "Paris", "Japan": "Tokyo",
    "China (Mainland)": "Beijing", "India": "New Delhi", "South Korea": "Seoul",
    "Netherlands": "Amsterdam", "Switzerland": "Bern", "Sweden": "Stockholm", "Italy": "Rome",
    "Spain": "Madrid", "Brazil": "Brasília", "Russia": "Moscow",
}
COUNTRY_PATTERNS = [
    ("United States", ["stanford", "harvard", "mit", "berkeley", "california", "yale"]),
    ("United Kingdom", ["oxford", "cambridge", "london", "manchester", "edinburgh"]),
    ("Germany", ["munich", "heidelberg", "berlin", "hamburg"]),
    ("Switzerland", ["zurich", "lausanne", "geneva"]),
    ("Canada", ["toronto", "montreal", "vancouver", "british columbia"]),
    ("Australia", ["melbourne", "sydney", "canberra"]),
    ("Singapore", ["singapore"]),
    ("China", ["beijing", "shanghai", "tsinghua", "peking"]),
    ("Netherlands", ["amsterdam", "delft", "utrecht"]),
]

# --- country defaults: (domestic, international, currency) per year --------------------------------
COUNTRY_TUITION = {
    "United States of America": (15000, 45000, "USD"), "United Kingdom": (12000, 30000, "GBP"),
    "Canada": (8000, 30000, "CAD"), "Australia": (10000, 35000, "AUD"), "Germany": (500, 1500, "EUR"),
    "France": (300, 5000, "EUR"), "Netherlands": (2200, 15000, "EUR"),
    "Switzerland": (1500, 3000, "CHF"), "Sweden": (0, 15000, "SEK"), "Denmark": (0, 15000, "DKK"),
    "Norway": (0, 0, "NOK"), "Finland": (0, 15000, "EUR"), "Japan": (5000, 10000, "JPY"),
    "South Korea": (5000, 10000, "KRW"), "China (Mainland)": (3000, 6000, "CNY"),
    "Hong Kong SAR": (6000, 18000, "HKD"), "Singapore": (8000, 20000, "SGD"),
    "India": (1000, 5000, "INR"), "Malaysia": (2000, 8000, "MYR"), "Ireland": (5000, 18000, "EUR"),
    "Italy": (2000, 5000, "EUR"), "Spain": (1500, 8000, "EUR"), "Belgium": (1000, 5000, "EUR"),
    "Austria": (800, 1600, "EUR"), "New Zealand": (6000, 25000, "NZD"), "Russia": (2000, 5000, "RUB"),
    "Brazil": (0, 3000, "BRL"), "Mexico": (1000, 5000, "MXN"), "Saudi Arabia": (0, 0, "SAR"),
    "United Arab Emirates": (10000, 20000, "AED"), "Turkey": (500, 3000, "TRY"),
    "Poland": (0, 4000, "PLN"), "Czech Republic": (0, 5000, "CZK"), "Portugal": (1000, 5000, "EUR"),
    "Taiwan": (3000, 6000, "TWD"), "Thailand": (1500, 5000, "THB"), "Indonesia": (1000, 4000, "IDR"),
    "Pakistan": (500, 3000, "PKR"), "Egypt": (500, 5000, "EGP"), "South Africa": (3000, 8000, "ZAR"),
    "Argentina": (0, 3000, "ARS"), "Chile": (5000, 10000, "CLP"), "Colombia": (2000, 6000, "COP"),
    "Philippines": (1000, 4000, "PHP"), "Israel": (5000, 12000, "ILS"),
}
DEFAULT_TUITION = (3000, 10000, "USD")
COUNTRY_IELTS = {
    "United States of America": 6.5, "United Kingdom": 6.5, "Canada": 6.5, "Australia": 6.5,
    "New Zealand": 6.5, "Ireland": 6.5, "Singapore": 6.5, "Hong Kong SAR": 6.5, "Netherlands": 6.5,
    "Sweden": 6.5, "Denmark": 6.5, "Norway": 6.5, "Finland": 6.0, "Germany": 6.0, "France": 6.0,
    "Switzerland": 6.5, "Japan": 6.0, "South Korea": 6.0, "Malaysia": 6.0,
}
DEFAULT_IELTS = 6.0
COUNTRY_TOEFL = {
    "United States of America": 90, "United Kingdom": 90, "Canada": 90, "Australia": 85,
    "New Zealand": 85, "Ireland": 90, "Singapore": 90, "Hong Kong SAR": 85, "Netherlands": 85,
    "Germany": 80, "France": 80, "Switzerland": 85, "Sweden": 85,
}
DEFAULT_TOEFL = 80
COUNTRY_LIVING_COST = {
    "United States of America": 18000, "United Kingdom": 15000, "Canada": 14000, "Australia": 16000,
    "Switzerland": 25000, "Singapore": 15000, "Hong Kong SAR": 16000, "Japan": 12000,
    "Germany": 11000, "France": 12000, "Netherlands": 13000, "Sweden": 12000, "Norway": 15000,
    "Denmark": 14000, "South Korea": 10000, "Ireland": 14000, "New Zealand": 13000, "Italy": 11000,
    "Spain": 10000, "Belgium": 12000,
}
DEFAULT_LIVING_COST = 8000
TIER_MULTIPLIER = {"top": 1.3, "good": 1.0, "standard": 0.8}

# --- codes -----------------------------------------------------------------------------------------
RESEARCH_CODES = {"VH": "very high", "H": "high", "M": "medium", "L": "low"}

# --- urls --------------------------------------------------------------------------------------------
EDUCATION_SUFFIXES = [".edu", ".ac.uk", ".ac.au", ".ac.nz", ".ac.ca", ".edu.au", ".edu.sg", ".edu.hk",
                      ".edu.cn"]
EDUCATION_HOST_WORDS = ["university", "college", "institute", "school"]
RELEVANCE_WORDS = ["computer science", "masters", "bachelor", "phd", "admission", "tuition",
                   "requirements", "application"]
EXCLUDED_LINK_PARTS = [
    "facebook.com", "twitter.com", "linkedin.com", "instagram.com", "youtube.com", "calendar", "events",
    "news", "blog", "staff", "faculty-profile", "alumni", "login", "register", "privacy", "terms",
    "cookie", "accessibility", "sitemap", "careers", "jobs", "vacancies", "#", "javascript:", "mailto:",
    "tel:", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip",
]
FILE_ENDINGS = [".pdf", ".doc", ".docx", ".xls", ".xlsx"]
PROGRAM_PATHS = ["/program", "/course", "/study", "/degree", "/masters", "/phd", "/undergraduate",
                 "/graduate", "/academic", "/admission"]

# --- requests ---------------------------------------------------------------------------------------
MAX_REASONABLE_BUDGET = 200_000

# --- feature registry: name -> use ----------------------------------------------------------------------
FEATURE_USE = {
    "gpa_requirement_min": "training", "tuition_domestic": "training",
    "tuition_international": "training", "tuition_domestic_usd": "training",
    "tuition_international_usd": "training", "cost_of_living": "training",
    "cost_of_living_usd": "training", "ielts_min": "training", "toefl_min": "training",
    "duration_years": "training", "application_fee": "training", "country": "training",
    "degree_level": "training", "program_category": "training", "specializations": "training",
    "career_outcomes": "training", "affordability_ratio": "training", "selectivity_index": "training",
    "university_name": "display", "program_name": "display", "city": "display",
    "degree_type": "display", "tuition_currency": "display", "university_id": "id",
    "qs_world_ranking": "blocked", "qs_overall_score": "blocked", "qs_academic_reputation": "blocked",
    "qs_employer_reputation": "blocked", "qs_faculty_student_ratio": "blocked",
    "qs_citations": "blocked", "qs_intl_students": "blocked", "qs_intl_faculty": "blocked",
    "qs_employment_outcomes": "blocked", "qs_sustainability": "blocked", "university_tier": "target",
}

# --- program links: words and path parts --------------------------------------------------------------------
LINK_SKIP_TEXTS = [
    "home", "back", "next", "previous", "page", "more", "see all", "read more", "learn more",
    "click here", "view all", "contact", "enquire", "apply now", "apply online", "download", "print",
    "menu", "skip", "search", "login", "sign in", "subscribe", "follow us", "share", "tweet", "facebook",
    "twitter", "linkedin", "instagram", "youtube", "email", "phone", "address", "map", "privacy",
    "terms", "cookies", "accessibility", "sitemap", "about us", "about the", "our mission", "our values",
    "staff", "faculty", "alumni", "news", "events", "blog", "careers", "jobs", "vacancies",
    "work with us", "support researchers", "engage with us", "recognition", "partnerships",
    "collaboration", "funding", "grants", "where do i start", "getting started", "open days",
    "changes to", "departments", "research courses", "taught courses", "how to apply", "fees",
    "scholarships", "visa", "accommodation", "international", "student portal", "media information",
    "newsfeed",
]
LINK_SKIP_SECTIONS = [
    "/the-eth-zurich/", "/portrait/", "/sustainability/", "/working-teaching", "/vocational-education",
    "/quality-management/", "/educational-development/", "/ai-in-education/", "/information-material/",
    "/continuing-education", "/research/", "/news/", "/events/", "/open-science/", "/doctorate.",
    "/utils/", "/footer/", "/login/", "/search/", "/contact/", "/media/", "/about/", "/staff/",
    "/alumni/", "/careers/", "/jobs/", "/vacancies/", "/student-life/", "/wellbeing/", "/support/",
    "/finance/", "/prospective-students", "/application/", "/beginning-your", "/admissions/",
    "/funding/", "/scholarships/", "/fees/", "getting-started", "taught-courses", "research-courses",
    "open-days", "changes-to", "departments", "how-to-apply", "fees-and-funding",
    "international-applicants", "advice-", "why-oxford", "sport-arts", "disability", "colleges",
    "entry-requirements", "general-information", "choosing-a", "masterprogrammas",
    "masters-programmes.", "bachelors-programmes.", "/d-arch/", "/d-baug/", "/d-biol/", "/d-bsse/",
    "/d-chab/", "/d-eaps/", "/d-gess/", "/d-hest/", "/d-infk/", "/d-itet/", "/d-math/", "/d-matl/",
    "/d-mavt/", "/d-mtec/", "/d-phys/", "/d-usys/",
]
LINK_LISTING_ENDINGS = [
    "degree-programmes.html", "degree-programs.html", "bachelors-degree-programmes.html",
    "masters-degree-programmes.html", "/programmes.html", "/programs.html", "/courses.html",
    "/bachelors.html", "/masters.html", "/undergraduate.html", "/graduate.html", "/postgraduate.html",
    "/index.html",
]
CATEGORY_SLUGS = [
    "engineering-sciences", "natural-sciences-and-mathematics", "architecture-and-civil-engineering",
    "management-and-social-sciences", "system-oriented-natural-sciences",
]
DEGREE_PREFIX_PATTERNS = [
    r"/msc-[a-z]", r"/ma-[a-z]", r"/mba[/-]?", r"/mth-[a-z]", r"/mst-[a-z]", r"/bsc-[a-z]", r"/ba-[a-z]",
    r"/beng-[a-z]", r"/meng-[a-z]", r"/phd-[a-z]", r"/dphil-[a-z]", r"/dphil\b", r"/phd\b",
    r"/llm-[a-z]", r"/llb-[a-z]", r"/med-[a-z]", r"/md-[a-z]", r"/mph-[a-z]", r"/mph\b",
    r"/mphil-[a-z]", r"/mres-[a-z]", r"/pgcert-[a-z]", r"/pgdip-[a-z]", r"/postgrad-[a-z]",
    r"/mlitt-[a-z]", r"/mmus-[a-z]", r"/march-[a-z]", r"/msci-[a-z]", r"/mmath-[a-z]", r"/mchem-[a-z]",
    r"/mphys-[a-z]",
]
GENERIC_SEGMENTS = [
    "courses", "programmes", "programs", "degrees", "undergraduate", "postgraduate", "graduate",
    "taught", "research", "admissions", "study", "index", "listing", "list", "all", "a-z",
    "course-listing", "masters-programmes", "bachelors-programmes", "phd-programmes", "masters",
    "bachelors", "overview",
]
DEGREE_CODES = [
    "msc", "ma", "mba", "mth", "mst", "bsc", "ba", "beng", "meng", "phd", "dphil", "llm", "llb", "med",
    "md", "mph", "mphil", "mres", "pgcert", "pgdip", "mlitt", "mmus", "march", "msci", "mmath", "mchem",
    "mphys",
]
DEGREE_DIRECTORIES = [
    "masters", "bachelors", "undergraduate", "postgraduate", "graduate", "phd", "doctoral",
    "research-degrees", "master", "bachelor", "master-s", "bachelor-s",
]
DIRECTORY_SKIP_TEXTS = ["contact", "info", "about", "apply", "faq", "news", "events", "all-programmes",
                        "overview", "all-courses", "course-listing"]
ADMIN_SEGMENTS = ["offer-holders", "application-process", "teachers-conference", "imperial-on-tour",
                  "information-by-region", "executive-education"]
SUBJECT_WORDS = [
    "science", "arts", "engineering", "business", "medicine", "law", "education", "computer",
    "computing", "data", "software", "network", "information", "management", "finance", "accounting",
    "marketing", "economics", "nursing", "pharmacy", "healthcare", "clinical", "medical", "teaching",
    "curriculum", "mathematics", "physics", "chemistry", "biology", "psychology", "history",
    "philosophy", "literature", "linguistics", "sociology", "politics", "international",
    "environmental", "sustainability", "energy", "architecture", "theology", "archaeology",
    "anthropology", "geography", "music", "biotechnology", "bioinformatics", "robotics", "quantum",
    "nuclear", "materials", "mechanical", "electrical", "civil", "cyber", "security",
]
NAVIGATION_WORDS = ["department", "d-", "faculty"]
NAME_SKIP_SEGMENTS = ["courses", "programmes", "programs", "degrees", "study", "masters", "postgraduate",
                      "undergraduate", "taught", "research", "detail", "list", "directory", "index.php"]
RESPONSE_WORDS = ["university", "program", "degree", "requirements", "tuition"]


# Sentences of the quality report.
IMPROVE_COMPLETENESS = "Improve data completeness - aim for 80%+ field coverage"
REVIEW_WARNINGS = "Review and address data quality warnings"
QUALITY_IS_GOOD = "Data quality is good - continue monitoring"
