"""Fixed values of the insurance domain: word lists, dictionaries and weights that results depend on."""

# Words that are not indexed.
STOPWORDS = (
    "a an the and or but in on at to for of with by from as is was are were been be have has had do does did will would "
    "could should may might must shall can need it its this that these those i you he she we they what which who whom when "
    "where why how all each every both few more most other some such no nor not only own same so than too very just also now "
    "here there then once if because until while about into through during before after above below between under again "
    "further any being having doing"
).split()

# Acronyms and their words.
ACRONYMS = {
    "coi": "certificate of insurance",
    "acord": "association for cooperative operations research and development",
    "gl": "general liability",
    "cgl": "commercial general liability",
    "pl": "professional liability",
    "pol": "professional liability",
    "el": "employers liability",
    "wc": "workers compensation",
    "wci": "workers compensation insurance",
    "d&o": "directors and officers",
    "dno": "directors and officers",
    "do": "directors officers",
    "e&o": "errors and omissions",
    "eno": "errors and omissions",
    "p&c": "property and casualty",
    "pc": "property casualty",
    "epli": "employment practices liability insurance",
    "epl": "employment practices liability",
    "bop": "business owners policy",
    "cpp": "commercial package policy",
    "um": "uninsured motorist",
    "uim": "underinsured motorist",
    "pip": "personal injury protection",
    "bi": "bodily injury",
    "pd": "property damage",
    "comp": "comprehensive",
    "coll": "collision",
    "cyb": "cyber liability",
    "cyber": "cyber liability",
    "aop": "all other perils",
    "bpp": "business personal property",
    "bii": "business income insurance",
    "ee": "extra expense",
    "occ": "occurrence",
    "agg": "aggregate",
    "ded": "deductible",
    "sir": "self insured retention",
    "fnol": "first notice of loss",
    "siu": "special investigations unit",
    "tpa": "third party administrator",
    "mga": "managing general agency",
    "ri": "reinsurance",
    "xs": "excess",
    "qsr": "quota share reinsurance",
}

# Words and what they are searched with.
SYNONYMS = {
    "policy": ["coverage", "plan", "contract"],
    "premium": ["rate", "cost", "price", "payment"],
    "claim": ["loss", "incident", "occurrence"],
    "deductible": ["excess", "retention", "selfinsured"],
    "coverage": ["protection", "insurance", "policy"],
    "endorsement": ["rider", "amendment", "addendum"],
    "underwriting": ["riskassessment", "evaluation"],
    "insured": ["policyholder", "client", "customer"],
    "beneficiary": ["payee", "recipient"],
    "carrier": ["insurer", "company", "provider"],
    "agent": ["broker", "producer", "representative"],
    "renewal": ["extension", "continuation"],
    "cancellation": ["termination", "void", "cancel"],
    "exclusion": ["exception", "limitation"],
    "limit": ["maximum", "cap", "ceiling"],
    "liability": ["responsibility", "obligation"],
    "peril": ["risk", "hazard", "danger"],
    "sublimit": ["sublimitation", "internalimit"],
    "coinsurance": ["costsharing", "copay"],
    "indemnity": ["compensation", "reimbursement"],
}

# Fixed values: (suffix, replacement), tried in this order.
SUFFIXES = [
    ("ational", "ate"), ("tional", "tion"), ("encies", "ence"), ("ancies", "ance"), ("iveness", "ive"), ("fulness", "ful"),
    ("ousness", "ous"), ("ization", "ize"), ("isation", "ise"), ("ating", "ate"), ("izing", "ize"), ("ising", "ise"),
    ("ities", "ity"), ("ments", "ment"), ("ness", ""), ("ings", ""), ("tion", "t"), ("sion", "s"), ("ious", ""), ("eous", ""),
    ("ment", ""), ("able", ""), ("ible", ""), ("ally", ""), ("ful", ""), ("ous", ""), ("ive", ""), ("ing", ""), ("ion", ""),
    ("ies", "y"), ("es", ""), ("ed", ""), ("ly", ""), ("er", ""), ("s", ""),
]

# Keywords of document types, of categories, of queries that want an answer, of query types.
DOC_TYPES = {
    "policy_wording": ["policy wording", "policy document", "terms and conditions", "coverage terms", "policy terms", "wording"],
    "endorsement": ["endorsement", "amendment", "rider", "addendum", "policy change", "modification"],
    "certificate": ["certificate", "coi", "certificate of insurance", "proof of insurance", "cert"],
    "claim": ["claim", "claim form", "loss notice", "incident report", "claim submission", "fnol"],
    "underwriting": ["underwriting", "risk assessment", "underwriting guide", "risk evaluation", "uw guide"],
    "premium": ["premium", "rate", "pricing", "premium schedule", "rate sheet", "quote"],
    "process": ["process", "procedure", "workflow", "how to", "step by step", "sop", "guide"],
    "announcement": ["announcement", "update", "news", "bulletin", "notice", "memo"],
    "compliance": ["compliance", "regulatory", "audit", "regulation", "requirement", "filing"],
    "renewal": ["renewal", "renew", "expiration", "policy renewal", "renewal notice"],
    "cancellation": ["cancel", "cancellation", "termination", "policy cancellation", "non-renewal"],
    "coverage": ["coverage", "coverage summary", "declarations", "dec page", "limits"],
    "training": ["training", "onboarding", "education", "learning", "course"],
}

CATEGORIES = {
    "procedure": ["how to", "steps", "process", "procedure", "workflow", "instructions", "guide"],
    "definition": ["what is", "define", "meaning", "definition", "what does", "what are"],
    "data": ["statistics", "numbers", "data", "metrics", "table", "figures", "amount"],
    "example": ["example", "case study", "illustration", "sample", "instance", "scenario"],
    "reference": ["reference", "citation", "source", "appendix", "annex", "schedule"],
    "narrative": ["background", "history", "overview", "context", "story"],
}

SYNTHESIS = ["summarize", "explain", "compare", "difference", "relationship", "how does", "why", "what is the", "overview", "total", "average", "trend"]
QUERY_TYPES = [
    ("comparative", ["compare", "difference", "versus", "vs"]),
    ("aggregation", ["total", "sum", "average", "count", "how many"]),
    ("exploratory", ["what", "how", "why", "explain"]),
]

SOURCES = ("main_vector", "summary_vector", "question_vector", "bm25")
# Fusion weights by query type, in the order of SOURCES.
WEIGHTS = {
    "default": (0.40, 0.15, 0.20, 0.25),
    "factual": (0.35, 0.10, 0.20, 0.35),
    "exploratory": (0.45, 0.15, 0.25, 0.15),
    "comparative": (0.35, 0.15, 0.30, 0.20),
    "aggregation": (0.30, 0.20, 0.20, 0.30),
}
RRF_K, BOOST, BOOST_WINDOW = 30, 1.3, 50
CACHE_SIMILARITY, CACHE_TTL, CACHE_ENTRIES = 0.92, 3600, 2000

# USD for a million tokens: model -> (input, output).
PRICES = {
    "gpt-5.2": (1.75, 14.00), "gpt-5.1": (1.25, 10.00), "gpt-5": (1.25, 10.00), "gpt-5-mini": (0.25, 2.00), "gpt-5-nano": (0.05, 0.40),
    "gpt-4.1": (2.00, 8.00), "gpt-4.1-mini": (0.40, 1.60), "gpt-4.1-nano": (0.10, 0.40), "gpt-4o": (2.50, 10.00), "gpt-4o-mini": (0.15, 0.60),
    "o3": (2.00, 8.00), "o4-mini": (1.10, 4.40), "gemini-1.5-flash": (0.075, 0.30), "gemini-1.5-pro": (1.25, 5.00), "gemini-2.0-flash": (0.10, 0.40),
    "gemini-2.5-flash": (0.15, 0.60), "gemini-2.5-pro": (1.25, 10.00),
}

# Keys that chunk entities may have.
ENTITY_KEYS = (
    "policy_numbers", "claim_numbers", "insured_names", "coverage_types", "premium_amounts", "deductibles", "coverage_limits", "effective_dates",
    "expiration_dates", "agents", "carriers", "risk_types", "locations", "exclusions", "conditions",
)
# Categories that chunk metadata may have; priorities of box labels, pairs that may be nested, captions' parents.
CHUNK_CATEGORIES = ("procedure", "definition", "data", "example", "reference", "narrative")
BOX_PRIORITY = {
    "title": 0, "section-header": 1, "table": 2, "figure": 2, "isolate_formula": 2, "text": 3, "plain text": 3, "table_caption": 4,
    "figure_caption": 4, "formula_caption": 4, "table_footnote": 5, "page-header": 8, "page-footer": 8, "abandon": 10,
}
NESTED_LABELS = (("table", "table_caption"), ("table", "table_footnote"), ("figure", "figure_caption"), ("isolate_formula", "formula_caption"))
ORDER_PRIORITY = {
    "title": 0, "section_header": 1, "text": 2, "plain text": 2, "figure": 3, "figure_caption": 4, "table": 3, "table_caption": 4,
    "table_footnote": 5, "isolate_formula": 3, "formula_caption": 4, "abandon": 10,
}
CAPTION_OF = {"figure_caption": "figure", "table_caption": "table", "table_footnote": "table_caption", "formula_caption": "isolate_formula"}
