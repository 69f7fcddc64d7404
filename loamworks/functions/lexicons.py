"""Keyword lists, weights and sector tables that results depend on."""

# Keywords of company culture.
INNOVATION_POSITIVE = (
    "innovative", "cutting-edge", "forward-thinking", "encourages new ideas", "experimental", "creative freedom", "startup mentality", "move fast", "disruptive",
    "innovation", "pioneering", "breakthrough", "novel", "creative", "creativity", "leading-edge", "visionary", "collaboration", "collaborative", "first principle",
    "world-class", "best", "top tier", "excellence", "research", "r&d", "prototype", "pilot",
)
INNOVATION_NEGATIVE = (
    "bureaucratic", "slow to change", "resistant", "outdated", "stuck in old ways", "red tape", "politics", "siloed", "hierarchical",
    "conservative", "micromanagement", "inflexible", "legacy systems", "no innovation", "stagnant", "old-fashioned", "behind", "inefficient",
)
DATA_DRIVEN = (
    "data-driven", "metrics", "evidence-based", "analytical", "kpis", "dashboards", "data culture", "measurement", "quantitative",
    "data science", "analytics", "data analytics", "insights", "reporting", "business intelligence", "data literacy", "analysis", "statistics",
    "data team", "analyst", "data engineer", "bi", "reporting tools", "data quality",
)
AI_AWARENESS = (
    "ai", "artificial intelligence", "machine learning", "automation", "data science", "ml", "algorithms", "predictive", "neural network",
    "deep learning", "models", "llm", "training", "inference", "gpu", "cuda", "ai platform", "ml engineer", "ml platform", "ai tools",
    "generative ai", "nlp", "computer vision", "tensorflow", "pytorch", "ai strategy",
)
CHANGE_POSITIVE = (
    "agile", "adaptive", "fast-paced", "embraces change", "continuous improvement", "growth mindset", "flexible", "dynamic", "responsive", "evolving",
    "transforming", "transformation", "modern", "progressive", "open to change", "willing to adapt", "learning culture", "improvement", "advancing",
)
CHANGE_NEGATIVE = (
    "rigid", "traditional", "slow", "risk-averse", "change resistant", "old school", "bureaucracy", "resistant to change", "stuck",
    "inflexible", "unwilling", "hesitant", "status quo", "comfort zone", "afraid of change",
)

# Keywords of board composition.
BOARD_EXPERTISE = ("artificial intelligence", "machine learning", "deep learning", "data science", "neural network", "nlp", "computer vision", "ai research", "ml engineer", "chief data", "chief ai")
TECH_COMMITTEES = ("technology", "digital", "innovation", "cyber", "data")
DATA_OFFICERS = ("chief ai officer", "chief data officer", "chief technology officer", "chief digital officer", "chief information officer", "chief analytics officer")
TECH_MENTIONS = ("technology", "cyber", "digital")
STRATEGY_WORDS = ("artificial intelligence", "machine learning")

# Keywords of filings.
FILING_TERMS = ("machine learning", "automation", "cloud", "data lake", "analytics", "cybersecurity", "forecasting", "feature store", "governance", "pilot")

# Weights of the dimensions, and the two vocabularies of their names.
DIMENSIONS = {"data_infrastructure": 0.15, "ai_governance": 0.15, "technology_stack": 0.15, "talent": 0.15, "leadership": 0.10, "use_case_portfolio": 0.15, "culture": 0.15}
DIMENSION_ALIASES = {"talent_skills": "talent", "leadership_vision": "leadership", "culture_change": "culture"}

# How evidence of a source weighs on dimensions, and its reliability.
SOURCE_WEIGHTS = {
    "sec_filing": ({"ai_governance": 0.80, "data_infrastructure": 0.20}, 0.90),
    "employee_review": ({"culture": 0.80, "talent": 0.10, "leadership": 0.10}, 0.70),
    "board_composition": ({"ai_governance": 0.70, "leadership": 0.30}, 0.85),
}

# A rubric of levels by keywords of the corpus, and how many a level needs.
RUBRIC = {
    5: ("machine learning pilots", "feature store", "responsible technology"),
    4: ("cloud data", "governance policy", "data platform"),
    3: ("analytics", "automation", "cybersecurity"),
    2: ("legacy", "customer records"),
}
RUBRIC_LEAST = {5: 2, 4: 2, 3: 1, 2: 1}

# Fixed values by sector: average score, base score, alignment, timing; defaults for other sectors.
SECTORS = {
    "technology": (65.0, 75.0, 1.10, 1.15),
    "financial_services": (55.0, 80.0, 1.05, 1.10),
    "healthcare": (52.0, 78.0, 1.0, 1.0),
    "business_services": (50.0, 75.0, 1.0, 1.0),
    "retail": (48.0, 70.0, 0.95, 0.95),
    "manufacturing": (45.0, 72.0, 0.90, 0.90),
}
SECTOR_DEFAULT = (50.0, 75.0, 1.0, 1.0)

# Coefficients of the chain of scores.
PENALTY, TALENT_COEFFICIENT, TALENT_THRESHOLD, POSITION, SHARE, SYNERGY = 0.25, 0.15, 0.25, 0.15, 0.60, 0.12
SPREAD, RELIABILITY, MOST_RELIABLE, Z95 = 14.0, 0.32, 0.99, 1.96

# How lines of filings start that are no narrative: headers, markup of figures, file lists, page furniture, figures; and what stands anywhere in such lines.
LINE_STARTS = (
    r"UNITED STATES SECURITIES AND EXCHANGE COMMISSION", r"WASHINGTON,\s*D\.C\.\s*20549", r"FORM\s+(10-K|10-Q|8-K|DEF\s*14A)\b", r"Commission File Number", r"Securities registered pursuant to Section",
    r"Indicate by check mark", r"☐|☑", r"TABLE OF CONTENTS\b", r"INDEX TO FINANCIAL STATEMENTS\b",
    r"(?:dei|us-gaap|ifrs|srt|country|currency|exch|naics|sic|stpr|invest)[:_][\w]+", r"xbrli?:\w+", r"ix:\w+", r"link:\w+", r"xlink:\w+", r"IDEA:\s*XBRL\s+DOCUMENT", r"<XBRL>", r"<?xml.*xbrl", r"CONSOLIDATED\s+DOCUMENT",
    r"Namespace\s+Prefix", r"Namespace\s+URI", r"Document\s+And\s+Entity\s+Information", 
    r"[\(\$\d\.,\)]{3,}$", r"\(\s*\d+[\d\.,]*\s*\)$", r"[\d\.,]+\s+[\d\.,]+\s+[\d\.,]+$", r"\$\s*[\d\.,]+$",
    r"In\s+millions,?\s+except", r"\$\s+in\s+millions", r"Years?\s+ended\s+\w+\s+\d+", r"Three\s+months\s+ended", r"Nine\s+months\s+ended", r"As\s+of\s+\w+\s+\d+,?\s+\d{4}",
    r"[-_]{8,}$", r"\d+$", r"Page\s+\d+$", r"https?://\S+$", r"(xbrl|ixbrl|inline xbrl)$", r"<[^>]+>$",
    r"EX-\d+(?:\.\w+)?\s+\S+\.(?:htm|html|xml|xsd|xbrl|jpg|jpeg|png|gif|pdf|txt)$", r"[A-Za-z0-9][A-Za-z0-9._-]{2,}\.(?:htm|html|xml|xsd|xbrl|jpg|jpeg|png|gif|pdf|txt)$", r"GRAPHIC(?:\s+\S+)?$",
    r"begin\s+\d{3}\s+.+$", r"end$",
)
LINE_MARKS = ("report.css", "show.js", ".xsd", "xmlns:", "fasb.org", "xbrl.org")

# Headings of sections by form.
SECTION_HEADINGS = {
    "10K": ("Item 1", "Item 1A", "Item 1B", "Item 7", "Item 7A"),
    "10Q": ("Item 1A", "Item 2"),
    "8K": ("Item 1.01", "Item 2.02", "Item 5.02", "Item 7.01", "Item 8.01"),
    "DEF14A": ("Executive Compensation", "Compensation Discussion and Analysis", "Director Compensation", "Named Executive Officers?"),
}
SECTION_NAMES = {"Compensation Discussion and Analysis": "CD&A", "Named Executive Officers?": "Named Executive Officers"}
