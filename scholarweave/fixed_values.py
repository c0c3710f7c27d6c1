"""Word lists, patterns and tables the results depend on.

These are data, stated as they must be; nothing here is logic.
"""

# Generic words that are never a keyword.
KEYWORD_STOPWORDS = """
the and or but in on at to for of with by from up about into through during before after above below
between among this that these those i me my myself we our ours ourselves you your yours yourself yourselves
he him his himself she her hers herself it its itself they them their theirs themselves
paper study research method approach analysis result conclusion
""".split()

# Keywords looked up in titles.
TITLE_TERMS = [
    "machine learning", "deep learning", "artificial intelligence", "AI", "reinforcement learning", "neural network",
    "battery", "lithium-ion", "electric vehicle", "EV", "charging", "energy management", "optimization", "IoT",
    "blockchain", "federated learning", "CNN", "LSTM", "RNN",
]

# Technical dictionary looked up in full texts.
TECHNICAL_TERMS = [
    "machine learning", "deep learning", "artificial intelligence", "neural network", "reinforcement learning",
    "supervised learning", "unsupervised learning", "convolutional neural network", "cnn", "lstm", "rnn",
    "transformer", "federated learning", "transfer learning", "ensemble learning",
    "lithium-ion battery", "li-ion battery", "battery management system", "bms", "state of charge", "soc",
    "state of health", "soh", "battery capacity", "battery degradation", "battery aging",
    "battery thermal management", "electrode", "cathode", "anode", "electrolyte", "separator",
    "lithium iron phosphate", "lifepo4", "nickel manganese cobalt", "nmc",
    "electric vehicle", "ev", "electric car", "plug-in hybrid", "phev", "vehicle-to-grid", "v2g",
    "charging station", "fast charging", "wireless charging", "battery swapping", "energy management",
    "battery production", "battery manufacturing", "electrode manufacturing", "coating process", "calendering",
    "drying process", "cell assembly", "quality control", "process optimization", "production line",
    "optimization", "internet of things", "iot", "cyber-physical system", "smart grid", "energy storage",
    "renewable energy", "sustainability",
]

# English stop words of the usual public list, then words common in papers.
ENGLISH_STOPWORDS = """
i me my myself we our ours ourselves you you're you've you'll you'd your yours yourself yourselves he him his
himself she she's her hers herself it it's its itself they them their theirs themselves what which who whom this
that that'll these those am is are was were be been being have has had having do does did doing a an the and but
if or because as until while of at by for with about against between into through during before after above below
to from up down in out on off over under again further then once here there when where why how all any both each
few more most other some such no nor not only own same so than too very s t can will just don don't should
should've now d ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn hadn't hasn hasn't
haven haven't isn isn't ma mightn mightn't mustn mustn't needn needn't shan shan't shouldn shouldn't wasn wasn't
weren weren't won won't wouldn wouldn't
""".split()
PAPER_STOPWORDS = """
paper study research method approach analysis result conclusion abstract introduction literature article journal
conference proceedings ieee acm university department technology science engineering international national
system systems based using
""".split()

# Stop words of node texts.
NODE_STOPWORDS_KO = "이 가 을 를 의 에 에서 와 과 도 는 은 하다 있다 되다 이다 그 것 수 등 및 또한 그리고".split()
NODE_STOPWORDS_EN = """
the a an and or but in on at to for of with by from up about into through during before after above below
between among this that these those i me my myself we our ours
""".split()

# Journal abbreviation patterns and full names, first hit wins.
JOURNAL_ABBREVIATIONS = [
    (r"IEEE Trans\.?\s*Power\s*Syst\.?", "IEEE Transactions on Power Systems"),
    (r"IEEE Trans\.?\s*Ind\.?\s*Electron\.?", "IEEE Transactions on Industrial Electronics"),
    (r"IEEE Trans\.?\s*Energy\s*Convers\.?", "IEEE Transactions on Energy Conversion"),
    (r"IEEE Trans\.?\s*Smart\s*Grid", "IEEE Transactions on Smart Grid"),
    (r"IEEE Trans\.?\s*Veh\.?\s*Technol\.?", "IEEE Transactions on Vehicular Technology"),
    (r"IEEE Trans\.?\s*Neural\s*Netw\.?", "IEEE Transactions on Neural Networks"),
    (r"IEEE Trans\.?\s*Pattern\s*Anal\.?", "IEEE Transactions on Pattern Analysis and Machine Intelligence"),
    (r"IEEE Trans\.?\s*Autom\.?\s*Sci\.?\s*Eng\.?", "IEEE Transactions on Automation Science and Engineering"),
    (r"J\.?\s*Power\s*Sources", "Journal of Power Sources"),
    (r"Appl\.?\s*Energy", "Applied Energy"),
    (r"Renew\.?\s*Sustain\.?\s*Energy\s*Rev\.?", "Renewable and Sustainable Energy Reviews"),
    (r"Energy\s*Build\.?", "Energy and Buildings"),
    (r"Int\.?\s*J\.?\s*Electr\.?\s*Power", "International Journal of Electrical Power & Energy Systems"),
    (r"Nat\.?\s*Energy", "Nature Energy"),
    (r"Nat\.?\s*Commun\.?", "Nature Communications"),
    (r"Sci\.?\s*Rep\.?", "Scientific Reports"),
    (r"Expert\s*Syst\.?\s*Appl\.?", "Expert Systems with Applications"),
    (r"Neurocomputing", "Neurocomputing"),
    (r"Comput\.?\s*Chem\.?\s*Eng\.?", "Computers & Chemical Engineering"),
]

# Journal classes in order, with the words that decide them.
JOURNAL_TYPES = [
    ("IEEE", ["ieee"]),
    ("High-Impact", ["nature", "science"]),
    ("Energy & Power", ["energy", "power", "electric"]),
    ("AI & ML", ["neural", "machine", "artificial", "intelligence"]),
    ("Computer Science", ["computer", "computing", "software"]),
    ("Engineering", ["engineering", "industrial", "automation"]),
    ("Applied Science", ["applied", "international", "journal"]),
]

# Journal domains for node texts, by name first, then by keyword text.
JOURNAL_DOMAINS_BY_NAME = [
    ("Computer Science", ["ieee", "acm", "computer", "software"]),
    ("High-Impact General Science", ["nature", "science", "cell"]),
    ("Energy and Power Systems", ["energy", "power", "electric", "battery"]),
    ("Artificial Intelligence", ["artificial", "intelligence", "neural", "machine"]),
    ("Engineering", ["engineering", "industrial", "automation"]),
    ("Applied Sciences", ["applied", "international", "journal"]),
]
JOURNAL_DOMAINS_BY_KEYWORD = [
    ("Artificial Intelligence", ["ai", "machine learning", "neural"]),
    ("Energy Systems", ["battery", "energy", "power"]),
    ("Computer Science", ["computer", "algorithm", "software"]),
]

# Word sets of the three research domains.
AI_DOMAIN = ["machine learning", "deep learning", "neural network", "ai", "artificial intelligence"]
ENERGY_DOMAIN = ["battery", "energy", "power", "electric", "charging"]
ENGINEERING_DOMAIN = ["system", "control", "optimization", "design", "manufacturing"]

# Terms counted in titles and abstracts when nodes are standardised.
ML_TERMS = [
    "machine learning", "deep learning", "neural network", "artificial intelligence", "reinforcement learning",
    "supervised learning", "unsupervised learning", "classification", "regression", "clustering", "algorithm",
]
BATTERY_TERMS = [
    "battery", "lithium", "soc", "state of charge", "electric vehicle", "energy storage", "charging",
    "power management", "thermal management",
]
EXPERIENCE_MARKS = ["professor", "dr.", "phd", "senior", "lead"]

# Words that describe a keyword, first entry that overlaps wins.
KEYWORD_CONTEXTS = [
    ("machine learning", "artificial intelligence algorithm data analysis prediction model training"),
    ("deep learning", "neural network artificial intelligence machine learning algorithm"),
    ("neural network", "deep learning artificial intelligence machine learning algorithm"),
    ("artificial intelligence", "machine learning deep learning neural network algorithm"),
    ("reinforcement learning", "machine learning artificial intelligence agent reward algorithm"),
    ("battery", "energy storage lithium ion electric vehicle power management"),
    ("lithium", "battery energy storage electric vehicle ion cell"),
    ("soc", "state of charge battery energy management system estimation"),
    ("electric vehicle", "battery charging power management energy storage automotive"),
    ("charging", "battery electric vehicle power energy management station"),
    ("optimization", "algorithm performance improvement efficiency solution"),
    ("control", "system management regulation automation process"),
    ("system", "architecture design implementation framework platform"),
    ("algorithm", "computation method procedure optimization solution"),
    ("model", "simulation representation framework algorithm analysis"),
]

# Institution patterns searched in author fields.
INSTITUTION_PATTERNS = [
    (r"(?i)University of ([^,\n]+)"),
    (r"(?i)([^,\n]*University[^,\n]*)"),
    (r"(?i)([^,\n]*Institute[^,\n]*)"),
    (r"(?i)([^,\n]*College[^,\n]*)"),
]

# Keyword section patterns.
KEYWORD_SECTION_PATTERNS = [
    r"(?is)Keywords?[:\-\s]+(.*?)(?:\n\s*\n|\n\s*[A-Z]|\n\s*\d+)",
    r"(?is)Index Terms?[:\-\s]+(.*?)(?:\n\s*\n|\n\s*[A-Z]|\n\s*\d+)",
    r"(?is)Key words?[:\-\s]+(.*?)(?:\n\s*\n|\n\s*[A-Z]|\n\s*\d+)",
]

# Abstract patterns, tried in order.
ABSTRACT_PATTERNS = [
    r"(?is)Abstract[:\-\s]*\n\s*(.*?)(?:\n\s*\n|\n\s*(?:Keywords?|Index\s+Terms?|Introduction|1\.?\s*Introduction))",
    r"(?is)ABSTRACT[:\-\s]*\n\s*(.*?)(?:\n\s*\n|\n\s*(?:KEYWORDS?|INDEX\s+TERMS?|INTRODUCTION|1\.?\s*INTRODUCTION))",
    r"(?is)Abstract[:\-\s]*[:\-]\s*(.*?)(?:\n\s*\n|\n\s*(?:Keywords?|Introduction|1\.?\s*Introduction))",
    r"(?is)ABSTRACT[:\-\s]*[:\-]\s*(.*?)(?:\n\s*\n|\n\s*(?:KEYWORDS?|INTRODUCTION|1\.?\s*INTRODUCTION))",
    r"(?is)Abstract[:\-\s]+(.{100,2000}?)(?:\n\s*(?:Keywords?|Index\s+Terms?|Introduction|1\.?\s*Introduction|\d+\.?\s*Introduction))",
    r"(?is)ABSTRACT[:\-\s]+(.{100,2000}?)(?:\n\s*(?:KEYWORDS?|INDEX\s+TERMS?|INTRODUCTION|1\.?\s*INTRODUCTION|\d+\.?\s*INTRODUCTION))",
    r"(?is)Abstract[:\-\s]*\n\s*(.*?)(?:\n\s*(?:1\.?\s*Introduction|2\.?\s*|Keywords?))",
    r"(?is)Abstract[:\-\s]+(.*?)(?:\n\s*[A-Z][a-z]+\s*:|\n\s*\d+\.|\n\s*\n\s*[A-Z])",
]

# Headers that open and patterns that close a reference section.
REFERENCE_HEADERS = [
    r"(?im)References?\s*\n", r"(?im)REFERENCES?\s*\n", r"(?im)Bibliography\s*\n", r"(?im)BIBLIOGRAPHY\s*\n",
    r"(?im)Literature Cited\s*\n", r"(?im)Works Cited\s*\n",
]
REFERENCE_ENDS = [
    r"(?i)\n\s*Appendix", r"(?i)\n\s*APPENDIX", r"(?i)\n\s*Author.*Biography", r"(?i)\n\s*AUTHOR.*BIOGRAPHY",
    r"(?i)\n\s*Acknowledgments?", r"(?i)\n\s*ACKNOWLEDGMENTS?", r"(?i)\n\s*Supplementary", r"(?i)\n\s*Index",
    r"(?i)\n\s*\d+\.\s*Conclusion",
]
REFERENCE_SPLITS = [r"\n\s*\[\d+\]", r"\n\s*\d+\.\s", r"\n\s*\(\d+\)", r"\n(?=[A-Z][a-z]+.*?20[0-2][0-9])"]
REFERENCE_YEAR = r"\b(20[0-2][0-9])\b"
REFERENCE_TITLE = r"[A-Z][a-z]+.*?\.\s*([^.]+?)\s*(?:\b(?:20[0-2][0-9])\b|In\s|Proceedings|Journal)"
REFERENCE_AUTHOR = r"^([A-Z][a-z]+(?:\s+[A-Z]\.?\s*)*[A-Z][a-z]+)"

# Default edge type of each source graph, in load order.
SOURCE_GRAPHS = ["citation", "keyword", "semantic", "author_collab", "author_paper", "journal_paper"]
DEFAULT_EDGE_TYPES = {
    "citation": "cites",
    "keyword": "co_occurs_with",
    "semantic": "semantically_similar_to",
    "author_collab": "collaborates_with",
    "author_paper": "authored_by",
    "journal_paper": "published_in",
}
# Names the builders write, and the names the analysis and context speak.
EDGE_TYPE_ALIASES = {
    "citation": "cites",
    "semantic_similarity": "semantically_similar_to",
    "collaboration": "collaborates_with",
    "authored": "authored_by",
}

# Scoring weights of extraction and context.
VECTOR_WEIGHT, METADATA_WEIGHT, GRAPH_WEIGHT = 0.4, 0.3, 0.3
NODE_TYPE_WEIGHTS = {"paper": 1.0, "author": 0.8, "keyword": 0.6, "journal": 0.5}
NODE_TYPE_BONUS = {"paper": 0.2, "author": 0.15, "keyword": 0.1, "journal": 0.05}
EDGE_IMPORTANCE = {
    "cites": 0.2, "authored_by": 0.15, "published_in": 0.1, "collaborates_with": 0.15, "has_keyword": 0.05,
    "similar_to": 0.1,
}
HYBRID_SHARES = [("local", 0.4), ("semantic", 0.3), ("global", 0.3)]

# Embedding models that are known by name.
EMBEDDING_MODELS = [
    ("sentence-transformers", "all-MiniLM-L6-v2", 384, 256, "Fast and good quality, English focused"),
    ("sentence-transformers", "all-mpnet-base-v2", 768, 384, "High quality, English focused"),
    ("sentence-transformers", "paraphrase-multilingual-MiniLM-L12-v2", 384, 128, "Multilingual, good for Korean/English"),
    ("sentence-transformers", "paraphrase-multilingual-mpnet-base-v2", 768, 128, "High quality multilingual"),
    ("sentence-transformers", "allenai/specter", 768, 512, "Scientific papers specialist"),
    ("sentence-transformers", "allenai/specter2_base", 768, 512, "Updated scientific papers model"),
    ("huggingface", "sentence-transformers/all-MiniLM-L6-v2", 384, 256, "Same as ST version but via HF"),
    ("huggingface", "klue/bert-base", 768, 512, "Korean BERT"),
    ("huggingface", "microsoft/DialoGPT-medium", 1024, 1024, "Dialog focused"),
]
