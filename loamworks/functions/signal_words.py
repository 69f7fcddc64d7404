"""Keyword lists, patterns and weights of the evidence extractors."""

# Skills of job postings by family.
SKILLS = {
    "ml_engineering": (
        "pytorch", "tensorflow", "keras", "mlops", "deep learning", "transformers", "llm", "fine-tuning", "model training", "tensorrt", "cuda", "deep learning algorithm", "inference engine",
        "neural reconstruction", "generative ai", "model inference", "machine learning framework", "triton", "cutlass", "large language model", "foundation model", "diffusion",
        "deep learning inference", "model evaluation", "training framework", "ai systems", "performance engineering",
    ),
    "data_science": ("data science", "statistics", "feature engineering", "scikit-learn", "sklearn", "xgboost", "lightgbm", "numpy", "pandas", "data scientist", "quantitative", "predictive modeling", "experimentation platform"),
    "ai_infrastructure": (
        "aws", "azure", "gcp", "docker", "kubernetes", "snowflake", "databricks", "spark", "airflow", "vector database", "faiss", "pinecone", "weaviate", "hpc", "high performance computing", "gpu cluster",
        "distributed training", "model serving", "mlflow", "kubeflow", "ray", "dask",
    ),
    "ai_product": ("prompt engineering", "rag", "retrieval augmented", "product analytics", "experimentation", "a/b testing", "recommendation", "personalization", "conversational ai", "generative", "agentic", "autonomous agent"),
    "ai_strategy": ("ai strategy", "responsible ai", "model risk", "enterprise ai", "ai governance", "ai roadmap", "ai platform", "ai enablement", "ai benchmarking"),
    "hardware_ai": (
        "asic", "soc", "rtl", "vlsi", "physical design", "verification engineer", "deep learning hardware", "neural network accelerator", "ai chip", "robotics", "autonomous vehicles", "embodied agent",
        "site reliability", "network ai", "ai for science", "hypervisor", "rtos", "nondestructive evaluation", "digital twin", "industrial ai", "iot", "edge ai", "deep learning algorithm", "deep learning inference",
        "deep learning engineer", "ai systems", "ml framework", "performance engineer", "ai developer", "ai research", "generalist embodied", "ai benchmarking", "network ai platform", "ai enabling",
    ),
}
# How many hits of a family count, and their weight.
SKILL_WEIGHTS = {"ml_engineering": (6, 0.10), "data_science": (4, 0.07), "ai_infrastructure": (4, 0.05), "ai_product": (3, 0.06), "ai_strategy": (2, 0.05), "hardware_ai": (6, 0.12)}
# Words of titles.
AI_TITLES = (
    "ai", "machine learning", "deep learning", "mlops", "artificial intelligence", "data scientist", "data science", "genai", "gen ai", "llm", "neural", "autonomous", "robotics", "tensorrt", "cuda", "generative", "hpc",
    "conversational ai", "ml engineer", "ai engineer", "applied ai", "agentic", "ai/ml", "ml/ai", "nlp", "computer vision", "reinforcement", "recommendation", "personalization", "analytics engineer",
)
GENERIC_TITLES = (
    "solution architect", "software architect", "enterprise architect", "lead software engineer", "senior software engineer", "staff software engineer", "principal software engineer", "it manager", "infrastructure engineer",
    "devops engineer", "security engineer", "network engineer", "systems engineer", "business analyst", "project manager", "program manager", "scrum master", "product owner",
)
HARDWARE_TITLES = ("deep learning", "neural", "autonomous", "robotics", "ai chip", "hpc", "tensorrt", "cuda", "embodied", "ai for science", "network ai", "ai benchmarking", "ai enabling")
SENIOR_POSTS = ("principal", "staff", "director", "vp", "vice president", "head", "chief")
MID_POSTS = ("senior", "lead", "manager")
ENTRY_POSTS = ("junior", "associate", "entry", "intern", "new grad", "graduate")

# Technologies of web pages by family, how many hits count, and their weight.
TECHNOLOGIES = {
    "core": (
        "openai", "chatgpt", "gpt", "llm", "transformers", "rag", "vector database", "pytorch", "tensorflow", "keras", "hugging face", "langchain", "llamaindex", "embedding", "embeddings", "genai", "generative ai",
        "large language model", "machine learning", "deep learning", "neural network", "natural language", "computer vision", "reinforcement learning", "mlops", "ai platform", "foundation model", "fine-tuning", "inference", "diffusion model",
    ),
    "data": (
        "snowflake", "databricks", "spark", "airflow", "kafka", "dbt", "delta lake", "s3", "adls", "bigquery", "redshift", "data warehouse", "data lake", "data pipeline", "data platform", "real-time data", "stream processing",
        "elasticsearch", "pinecone", "weaviate", "chroma", "vector store",
    ),
    "cloud": ("aws sagemaker", "bedrock", "azure openai", "azure ml", "vertex ai", "google cloud ai", "amazon comprehend", "aws rekognition", "azure cognitive", "google automl", "huggingface", "replicate", "modal", "together ai"),
    "web": (
        "react", "next.js", "nextjs", "angular", "vue", "svelte", "node.js", "nodejs", "express", "django", "flask", "fastapi", "kubernetes", "docker", "terraform", "cloudflare", "akamai", "segment", "amplitude", "mixpanel",
        "google analytics", "gtag", "gtm", "tag manager", "stripe", "paypal",
    ),
}
TECHNOLOGY_WEIGHTS = {"core": (8, 0.10), "data": (6, 0.07), "cloud": (4, 0.08), "web": (6, 0.03)}
TECHNOLOGY_TITLES = ("ai", "ml", "machine learning", "llm", "genai", "platform", "engineering", "research", "data", "cloud")

# Categories of patents by keyword and by the start of their class codes.
PATENT_CATEGORIES = {
    "ml_core": ("machine learning", "deep learning", "neural network", "supervised learning", "unsupervised learning", "reinforcement learning"),
    "nlp": ("natural language processing", "nlp", "sentiment analysis", "text mining", "semantic search", "language model"),
    "computer_vision": ("computer vision", "image recognition", "object detection", "facial recognition", "image processing"),
    "predictive": ("predictive analytics", "forecasting", "anomaly detection", "pattern recognition"),
    "automation": ("robotics", "autonomous systems", "process automation", "intelligent agents"),
}
PATENT_CLASSES = {"G06N": "ml_core", "G06V": "computer_vision", "G10L": "nlp", "G06F18": "predictive"}

# Indicators of leadership, their scores, and the patterns that show them; of titles the first that fits counts.
INDICATORS = {"chief_ai": 1.0, "veteran": 0.9, "phd": 0.8, "publications": 0.7, "patents": 0.6, "board": 0.5, "certified": 0.3, "keywords": 0.1}
TITLE_PATTERNS = (
    (r"chief\s+ai\s+officer|c\.?a\.?i\.?o", "chief_ai"),
    (r"chief\s+(data|digital|analytics|(data\s+[&]\s+analytics)|(data\s+and\s+analytics))\s+officer|c\.?d\.?[ao]", "veteran"),
    (r"chief\s+technology\s+officer|c\.?t\.?o", "veteran"),
    (r"chief\s+(information|innovation)\s+officer", "veteran"),
    (r"(vp|vice\s+president).{0,40}(ai|machine.learning|data.science)", "board"),
    (r"(director|head|lead).{0,40}(ai|machine.learning|data.science|analytics)", "board"),
    (r"\b(ai|ml|machine.learning|data.science|analytics)\b", "keywords"),
)
BIO_PATTERNS = (
    (r"ph\.?\s*d.{0,80}(machine.learning|artificial.intelligence|deep.learning|nlp|computer.vision)", "phd"),
    (r"(machine.learning|artificial.intelligence|deep.learning).{0,80}ph\.?\s*d", "phd"),
    (r"(google|deepmind|openai|meta ai|microsoft research|amazon|nvidia).{0,60}(engineer|scientist|researcher|director)", "veteran"),
    (r"published.{0,60}(machine.learning|ai|nlp|neural)", "publications"),
    (r"(patent|inventor).{0,60}(ai|machine.learning|algorithm)", "patents"),
    (r"(certified|certification).{0,60}(ai|machine.learning|data.science)", "certified"),
    (r"\b(machine.learning|deep.learning|artificial.intelligence|neural.network|nlp|generative.ai)\b", "keywords"),
)
OPENING_PATTERN = r"(director|vp|vice.president|head|lead|principal|chief).{0,40}(ai|machine.learning|data.science|analytics|artificial.intelligence|ml)"
JOB_WORDS = ("engineer", "developer", "architect", "intern", "new college grad", " - new college grad", "applications engineer", "solutions architect")

# Weights of the four categories of signals in their composite.
COMPOSITE = {"technology_hiring": 0.30, "innovation_activity": 0.25, "digital_presence": 0.25, "leadership_signals": 0.20}

# Broad terms whose number gives a text without a rubric its score.
BROAD_TERMS = (
    "technology", "digital", "data", "analytics", "systems", "platform", "software", "cloud", "automation", "innovation", "strategy", "strategic", "growth", "revenue", "efficiency", "operations", "customers", "market",
    "competitive", "value", "risk", "governance", "compliance", "oversight", "controls",
)

# How evidence of each of the eleven sources weighs on dimensions, and its reliability.
EVIDENCE_WEIGHTS = {
    "technology_hiring": ({"talent": 0.70, "data_infrastructure": 0.10, "technology_stack": 0.20}, 0.85),
    "innovation_activity": ({"technology_stack": 0.50, "data_infrastructure": 0.20, "use_case_portfolio": 0.30}, 0.80),
    "digital_presence": ({"data_infrastructure": 0.60, "technology_stack": 0.40}, 0.75),
    "leadership_signals": ({"leadership": 0.60, "ai_governance": 0.25, "culture": 0.15}, 0.80),
    "sec_item_1": ({"use_case_portfolio": 0.70, "technology_stack": 0.30}, 0.90),
    "sec_item_1a": ({"ai_governance": 0.80, "data_infrastructure": 0.20}, 0.90),
    "sec_item_7": ({"leadership": 0.50, "use_case_portfolio": 0.30, "data_infrastructure": 0.20}, 0.85),
    "sec_item_2": ({"leadership": 0.50, "use_case_portfolio": 0.30, "data_infrastructure": 0.20}, 0.85),
    "sec_item_8_01": ({"leadership": 1.0}, 0.70),
    "glassdoor_reviews": ({"culture": 0.80, "talent": 0.10, "leadership": 0.10}, 0.70),
    "board_composition": ({"ai_governance": 0.70, "leadership": 0.30}, 0.85),
}

# Committees as their names stand in proxy statements.
COMMITTEE_PATTERNS = (
    r"audit\s+committee", r"compensation\s+committee", r"nominating\s+(?:and\s+)?(?:corporate\s+)?governance\s+committee", r"technology\s+(?:and\s+)?(?:\w+\s+)?committee", r"risk\s+(?:management\s+)?committee",
    r"innovation\s+committee", r"digital\s+(?:\w+\s+)?committee", r"executive\s+committee", r"finance\s+committee", r"cyber(?:security)?\s+committee", r"data\s+(?:\w+\s+)?committee",
)

# Headings that mark a passage as a table or a form, where they stand at its start.
FORM_HEADINGS = (
    "table of contents", "beneficial ownership", "compensation discussion and analysis", "pay versus performance", "summary compensation table", "outstanding equity awards", "option exercises and stock vested",
    "nonqualified deferred compensation", "potential payments upon termination", "ceo pay ratio",
)
