"""Word lists, patterns, weights and thresholds that results depend on."""

# Discourse markers by type, in the order in which the last type found wins.
DISCOURSE = {
    "condition": ["if", "unless", "provided", "only if", "in case", "when"],
    "exception": ["except", "excluding", "but not", "other than", "apart from"],
    "temporal": ["before", "after", "until", "by", "deadline", "during", "while"],
    "negation": ["not", "no", "never", "cannot", "won't", "shouldn't"],
    "requirement": ["must", "shall", "required", "need to", "have to", "should"],
    "causation": ["because", "since", "therefore", "thus", "hence", "so"],
    "contrast": ["but", "however", "although", "while", "whereas", "yet"],
    "addition": ["and", "also", "moreover", "furthermore", "additionally"],
}

# Entity patterns by type; they run without regard to case.
ENTITY_PATTERNS = {
    "PERSON/ORG": r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b",
    "YEAR": r"\b\d{4}\b",
    "DATE": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    "PERCENTAGE": r"\b\d+%\b",
    "SCORE": r"\b\d+\s*(?:marks?|points?|credits?)\b",
}

# Words dropped from the front of a knowledge-graph entity.
ENTITY_STOP = "a an the this that these those it its they their he she his her we our you your i my".split()

# Stop words of retrieval and answer ranking.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between into through during before "
    "after above below to from up down in out on off over under again further then once"
).split()

# The question classes, in the order tested, with the words whose presence decides.
QUESTION_CLASSES = [
    ("comparative", ["compare", "difference", "versus", "vs", "older ", "younger ", "taller ", "which is", "are both", "or", "both"]),
    ("causal", ["why", "because", "reason"]),
    ("temporal", ["when", "date", "year", "deadline"]),
    ("process", ["how", "process", "step", "method"]),
    ("definitional", ["what is", "define", "meaning"]),
]
DECOMPOSED = ["comparative", "bridge", "causal", "process"]
PLAIN_ADJECTIVE = [("older", "old"), ("longer", "long"), ("taller", "tall"), ("larger", "large"), ("bigger", "big")]

# The forms of compound questions, in the order tried.
BOTH_SHARE = r"(?i)^(?:are|is|were|was|do|did|does)\s+(.*?)\s+and\s+(.*?)\s+both\s+(.*)"
TWO_ACTS = r"(?i)^(who|which|what)(.*?)(?:was|is|did|does|has|had)\s+(.*?)\s+and\s+(.*?)$"
CHOICE = r"(?i)^(who|which|what)\s+(?:is|was)\s+(.*?),\s+(.*?)\s+or\s+(.*?)$"
ONE_LACKS = r"(?i)^(?:does|do|did|is|are|was) (.*?) (.*?) that (.*?) (?:does not|do not|is not)$"
BRIDGE = r"(the\s+\w+\s+of\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)"

# Comparison question types by pattern, tested in this order.
DIFFERENCE = [r"\bdifferent\b", r"\bhow is\b"]
COMMON_PROPERTY = [
    r"\bin common\b",
    r"\bmutual\b",
    r"\bwhat type of\b",
    r"\bwhat kind of\b",
    r"\bwhat genre\b",
    r"\bboth what\b",
    r"\bshared\b",
    r"\bwhich occupation\b",
    r"\bwhat did both\b",
    r"\bwhat do both\b",
    r"^[A-Z].{0,80},\s+are\s+(?:a\s+)?(?:genus|type|kind|form|example)",
    r"are\s+what\s+(?:type|kind|sort|form|genre)",
    r"have\s+which\s+\w+",
    r"share\s+which\s+\w+",
    r"shared\s+.{0,30}\s+and\s+what",
]
BOOLEAN = [
    r"^are\s+both\b",
    r"^do\s+both\b",
    r"^does\s+both\b",
    r"^did\s+both\b",
    r"^is\s+.{0,60}\s+or\s+.{0,60}\b",
    r"^are\s+the\s+",
    r"^are\s+[a-z]",
    r"^did\s+",
    r"^do\s+",
    r"^does\s+",
    r"^is\s+",
    r"\bboth\s+located\b",
    r"\bboth\s+headquartered\b",
    r"\bboth\s+available\b",
    r"\bboth\s+a\s+",
    r"\bboth\s+\w+\?$",
]
COMPARATIVE = [
    r"\bmore\b",
    r"\bless\b",
    r"\blarger\b",
    r"\bsmaller\b",
    r"\bfirst\b",
    r"\bearlier\b",
    r"\brecent\b",
    r"\bolder\b",
    r"\bwider\b",
    r"\bbigger\b",
    r"\bdiverse\b",
]

# The patterns that name the two sides of a comparison, in the order tried: (what they read, pattern).
COMPARISON_SIDES = [
    ("question", r"(?i)(?:in\s+)?between\s+(.{2,80}?)\s+and\s+(.{2,80})"),
    ("after_comma", r"^(.{2,80}?)\s+or\s+(.{2,80})$"),
    ("question", r";\s*(.{2,80}?)\s+or\s+(.{2,80})"),
    ("question", r"(?i)\bboth\s+(?:the\s+)?(.{2,80}?)\s+and\s+(?:the\s+)?(.{2,80}?)(?=\s+(?:are|were|have|do|did|share|is|a\b|an\b|\?))"),
    ("stripped", r"(?i)^(.{2,80}?)\s+and\s+(?:the\s+)?(.{2,80}?)\s*,"),
    ("question", r"(?i)(?:Are|Is|Were|Was)\s+(?:the\s+)?(.{2,80}?)\s+and\s+(?:the\s+)?(.{2,80}?)\s+both\b"),
    ("question", r"(?i)(?:the\s+)?(.{2,60}?)\s+and\s+(?:the\s+)?(.{2,60}?)(?=\s*,|\s+both\b|\s+are\b|\s+have\b|\s+share\b|\s+were\b|\s+be\b|\s+is\b)"),
    ("question", r"(?:the\s+)?(.{2,60}?)\s+or\s+(?:the\s+)?(.{2,60})"),
]
QUESTION_PREFIX = r"(?i)^(?:Are\s+|Is\s+|Do\s+|Did\s+|Were\s+|Was\s+)(?:both\s+|either\s+)?(?:the\s+)?"
ENTITY_NOISE = r"(?i)^(are\s+the|is\s+the|are\s+|is\s+|the\s+|both\s+)"

# The boolean vote and the refinement of comparison answers.
NEGATIONS = [r"\bnot\b", r"\bnever\b", r"\bno\b", r"\bneither\b", r"n't\b", r"\bdifferent\b", r"\bvaries\b"]
BOTH_WORDS = ["both", "same", "also", "either", "share", "similar"]
STRONG_NEGATIVES = ["neither", "only one", "not both", "different countr", "different locat", "not the same"]
SOFT_NEGATIVE = r"\bnot\s+(?:located|headquartered|based|available|a\s+\w+|in\s+the)"
FIRST_WORDS, RECENT_WORDS = ["first", "earlier", "oldest"], ["recent", "latest", "newest"]
NEGATIVE_HITS = [" not ", " no ", " neither ", " different ", " not both "]

# Edge weights by type, and retrieval and answer weights and thresholds.
EDGE_WEIGHTS = {
    "adjacent": 1.0,
    "context": 0.8,
    "page": 0.5,
    "section": 0.6,
    "entity": 0.85,
    "kg_overlap": 0.9,
    "same_sentence": 1.0,
    "sequential": 0.9,
    "backward": 0.7,
    "discourse": 0.85,
    "entity_overlap": 0.8,
    "mentions": 1.0,
    "mentioned_in": 1.0,
    "entity_relation": 0.9,
}
TRAVERSABLE = ["condition", "exception", "temporal", "same_sentence"]
HYBRID_WEIGHTS = (0.5, 0.3, 0.2)
CORE_WEIGHTS = {"sem": 0.28, "bm25": 0.18, "overlap": 0.12, "sentence": 0.10, "cent": 0.08, "in_hybrid": 0.06, "in_traversal": 0.04, "in_expansion": 0.03, "in_kg": 0.05, "kg_bonus": 0.06}
NO_ANSWER = "No answer found"
