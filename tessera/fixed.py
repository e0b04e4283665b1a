"""Word lists, weights and limits that results depend on. They are data, to be equal and not to be tuned."""

# Stopwords.
ENGLISH_STOPWORDS = """
a an the and or but in on at to for of with by from is are was were be been being have has had do does did will would
could should may might shall can need dare it its this that these those i me my myself we our ours ourselves you your
yours yourself yourselves he him his himself she her hers herself they them their theirs themselves what which who whom
when where why how all each every both few more most other some such no nor not only own same so than too very just
because as until while about between through during before after above below up down out off over under again further
then once here there if also into
""".split()
HINDI_STOPWORDS = """
का के की में है हैं को पर से ने और एक यह नहीं तो भी कि हो था थी थे या इस उस कर हुए जो अपने वह जा रहे रहा रही अब जब सब कुछ बहुत होता
होती होते करता करती करते गया गई गए लिए दो तक ही बाद साथ उन इन कोई कैसे क्या वो मैं हम तुम आप वे उसे इसे किसी सकता सकती सकते होगा
होगी होंगे अगर मगर लेकिन फिर ऐसे वैसे जैसे जिस जिन कहा
""".split()
TELUGU_STOPWORDS = """
మరియు ఒక ఈ ఆ ఇది అది కు లో తో యొక్క గా నుండి కోసం పై వల్ల ద్వారా అయిన అయితే కానీ లేదా మాత్రమే కూడా ఇంకా అన్ని ఏ ఎవరు ఏమి ఎక్కడ
ఎప్పుడు ఎలా చేయడం చేసిన అవి వారు మేము నేను మీరు అతను ఆమె వాళ్ళు తన దాని వారి మా మీ నా ఉంది ఉన్న ఉన్నాయి ఉంటుంది చేస్తుంది అయింది
కాదు లేదు అవును ఇప్పుడు ముందు
""".split()
STOPWORDS = [*ENGLISH_STOPWORDS, *HINDI_STOPWORDS, *TELUGU_STOPWORDS]

# Tokens, languages, n-grams.
URL, EMAIL, TOKEN = r"https?://\S+|www\.\S+", r"\S+@\S+\.\S+", "[a-zA-Z0-9ऀ-ॿఀ-౿]+"
MIN_TOKEN, MAX_TOKEN, MIN_NUMBER = 2, 50, 5
INDIC_SHARE, LATIN_SHARE, LANGUAGE_CHARS = 0.3, 0.5, 500

# File types.
FILE_TYPES = {
    "pdf": [".pdf"],
    "docx": [".docx"],
    "text": [".txt", ".md", ".csv", ".log"],
    "excel": [".xlsx", ".xls"],
    "image": [".jpg", ".jpeg", ".png", ".bmp", ".tiff", ".avif", ".webp"],
}

# Words that a file's name adds to its text.
FILENAME_TAGS = {
    "id": ["identity", "card", "student"],
    "identity": ["id", "card"],
    "card": ["id", "identity"],
    "electricity": ["power", "bill"],
    "power": ["electricity", "bill"],
    "permission": ["approval", "permit"],
    "permit": ["permission", "approval"],
    "schedule": ["timetable", "calendar"],
    "timetable": ["schedule", "calendar"],
}
FILENAME_TERMS = {
    "id": ["id card", "identity", "identity card", "student", "student id"],
    "electricity": ["electricity", "power", "bill"],
    "permission": ["permission", "approval", "permit", "house permission", "building permit"],
    "environment": ["environment", "pollution", "environmental"],
}

# Query intents, boosts and expansions.
INTENT_KEYWORDS = {
    "marksheet": ["marksheet", "transcript", "grade sheet", "score sheet", "semester"],
    "invoice": ["invoice", "bill", "billing", "receipt", "tax invoice"],
    "permission": ["permission", "approval", "noc", "no objection", "permit", "house permission"],
    "certificate": ["certificate", "cert", "provisional", "bonafide"],
    "id": ["id", "identity", "aadhaar", "aadhar", "pan", "passport"],
    "address": ["address", "residence", "residential proof", "ration card"],
    "property": ["property", "land", "plot", "survey", "patta"],
}
INTENT_TERMS = {
    "marksheet": ["marksheet", "transcript"],
    "invoice": ["invoice", "bill"],
    "permission": ["permission", "approval"],
    "certificate": ["certificate"],
    "id": ["id", "identity"],
    "address": ["address", "residence"],
    "property": ["property", "land"],
}
INTENT_WEIGHT, INTENT_MAX_TERMS = 1.4, 4
TERM_BOOSTS = {"marksheet": 1.6, "result": 1.3, "transcript": 1.3, "id": 1.4, "identity": 1.4, "card": 1.2, "electricity": 1.3, "power": 1.2, "current": 1.2}
PHRASE_EXPANSIONS = {
    "marksheet semester": ["marksheet", "result", "transcript"],
    "id card": ["identity", "identity card"],
    "house permission": ["permission", "approval", "noc"],
    "electricity power": ["electricity", "power", "current", "power supply"],
}
PHRASE_EXPANSION_WEIGHT = 1.5
TRIGGER_EXPANSIONS = {
    "electricity": ["power supply", "current", "electric bill"],
    "house permission": ["building permit", "construction approval"],
    "id card": ["identity card", "student id", "id proof"],
    "environment": ["environmental", "climate", "pollution control"],
    "timetable": ["schedule", "calendar", "class routine"],
}
ORIGINAL_WEIGHT, EXPANDED_WEIGHT, SHORT_QUERY, SYNONYMS_PER_TERM = 1.0, 0.3, 3, 2
GENERIC_TERMS = {
    "en": "document documents file files form letter report project info information details data record records certificate application".split(),
    "hi": "दस्तावेज दस्तावेज़ फाइल सूचना जानकारी रिपोर्ट प्रमाणपत्र पत्र विवरण रिकॉर्ड".split(),
    "te": "పత్రం పత్రాలు ఫైల్ సమాచారం వివరాలు రిపోర్ట్ సర్టిఫికేట్ రికార్డు దరఖాస్తు".split(),
}
TECHNICAL_TERMS = {
    "en": "network security tfidf faiss hnsw semantic cross encoder index indexing vector embedding database api ocr retrieval ranking".split(),
    "hi": "नेटवर्क सुरक्षा डेटाबेस इंडेक्स एम्बेडिंग".split(),
    "te": "నెట్వర్క్ భద్రత డేటాబేస్ ఇండెక్స్ ఎంబెడింగ్".split(),
}
STRONG_PHRASES = {"en": ["network security", "machine learning", "software engineering", "query expansion", "information retrieval", "cross encoder"], "hi": [], "te": []}
BROAD_TERMS = {
    "en": "internet system service services thing general data information details record records document documents".split(),
    "hi": "जानकारी सूचना डेटा सेवा सामान्य".split(),
    "te": "సమాచారం డేటా సేవ సాధారణ".split(),
}
SYNONYMS = {
    "en": {
        "network": ["networking"],
        "security": ["protection", "safety"],
        "marksheet": ["gradecard", "result", "transcript"],
        "id": ["identity"],
        "identity": ["id"],
        "card": ["identity"],
        "electricity": ["power", "power supply", "current"],
        "invoice": ["bill", "receipt"],
        "timetable": ["schedule"],
        "drainage": ["sewerage", "stormwater"],
    },
    "hi": {"सुरक्षा": ["रक्षा", "बचाव"], "शिक्षा": ["पढ़ाई", "अध्ययन"], "स्वास्थ्य": ["सेहत", "आरोग्य"], "बिजली": ["विद्युत", "पावर"], "पानी": ["जल", "नीर"]},
    "te": {"విద్య": ["చదువు", "శిక్షణ"], "ఆరోగ్యం": ["ఆరోగ్యము", "స్వస్థత"], "నీరు": ["జలం"], "విద్యుత్": ["కరెంటు"], "భద్రత": ["రక్షణ", "సురక్ష"]},
}

# Ranking and fusion.
TOP_K, RRF_K, OVERSAMPLE, BOOLEAN_FLOOR = 10, 60, 5, 0.01
PHRASE_BOOST = 0.15
PHRASE_BOOST_TERMS = ["id card", "identity card", "student id", "electricity bill", "power bill", "house permission", "building permit", "timetable", "class routine"]
KEYWORD_WEIGHT, SEMANTIC_WEIGHT, RERANK_WEIGHT, RERANK_MAX = 0.2, 0.8, 0.4, 0.35
DIGIT_BOOST, SHORT_BOOST, LONG_BOOST, LEAST_WEIGHT = 0.35, 0.2, 0.2, 0.1
RERANK_CANDIDATES, RERANK_CHARS, FLAT = 30, 1200, 1e-12

# Chunks, snippets, clusters, history.
CHUNK_WORDS, CHUNK_STRIDE, CHUNK_MIN, CHUNK_SIMILARITY, CHUNK_OVERLAP = 180, 130, 60, 0.68, 1
SNIPPET_CHARS, SNIPPET_LEAD = 200, 66
CLUSTERS, CLUSTER_SEED, CLUSTER_RUNS = 5, 42, 10
HISTORY = 200
