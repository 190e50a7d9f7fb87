"""Fixed values of the text rules: word lists, maps, formats and messages."""

# Character classes shared by Spark (Java) and SQL engines with RE2.
WS = r"[\t-\r\x{85}\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"

#: Resource prefix of a line that is an entry.
PREFIX = "languageResource."

#: Glossary that holds where no other is given.
GLOSSARY = {"ip": "IP", "sop": "SOP", "hu": "HU", "po": "PO", "fg": "FG", "qc": "QC", "sscc": "SSCC", "drl": "DRL"}

LANGUAGES = {
    "en": "English", "fr": "French", "de": "German", "es": "Spanish", "it": "Italian", "pt": "Portuguese", "nl": "Dutch", "sv": "Swedish",
    "pl": "Polish", "tr": "Turkish", "ru": "Russian", "ja": "Japanese", "zh": "Chinese", "ko": "Korean", "ar": "Arabic", "hi": "Hindi",
}
SPACE_BEFORE_MARKS = ("fr",)
ENGLISH = ("en", "unknown")

MINOR_WORDS = ("of", "the", "a", "an", "in", "to", "and", "or", "is", "are", "was", "were", "by", "on", "at", "as", "per", "vs", "nor", "but", "for")
CONTINUATIONS = (
    "please", "process", "add", "check", "click", "select", "enter", "confirm", "contact", "ensure", "note", "review", "verify",
    "wait", "try", "refresh", "update", "save", "choose", "the", "this", "as", "and", "but",
)
EXTENSIONS = ("gif", "png", "jpg", "jpeg", "pdf", "csv", "xls", "xlsx")
AUXILIARIES = "Am|Is|Are|Was|Were|Do|Does|Did|Have|Has|Had|Will|Would|Shall|Should|Can|Could|May|Might|Must"
ACTIONS = "click|tap|press|select|choose|hit"
#: Passive constructions: pattern of the noun form, auxiliary kept, verb form.
PASSIVE = ((r"(been|being)", r"handovers?", "handed over"),)

CONTRACTIONS = {
    "dont": "don't", "cant": "can't", "wont": "won't", "isnt": "isn't", "wasnt": "wasn't", "arent": "aren't", "doesnt": "doesn't",
    "didnt": "didn't", "havent": "haven't", "hasnt": "hasn't", "hadnt": "hadn't", "shouldnt": "shouldn't", "wouldnt": "wouldn't",
    "couldnt": "couldn't", "youre": "you're", "theyre": "they're", "ive": "I've", "youve": "you've", "theyve": "they've", "im": "I'm",
}
REAL_WORDS = {"caned": "canned", "pleas": "please", "sech": "search", "exits": "exists"}
TYPOS = {"falied": "failed"}
VARIANTS = ("cancelled",)
SUFFIX_PAIRS = (
    ("ogue", "og"), ("ogues", "ogs"), ("our", "or"), ("ours", "ors"), ("ise", "ize"), ("ised", "ized"), ("ising", "izing"), ("iser", "izer"),
    ("isers", "izers"), ("isation", "ization"), ("isations", "izations"), ("yse", "yze"), ("ysed", "yzed"), ("ysing", "yzing"), ("yser", "yzer"),
    ("tre", "ter"), ("tres", "ters"), ("ence", "ense"), ("lled", "led"), ("lling", "ling"), ("ller", "ler"),
)
PREFIXES = ("counter", "inter", "under", "over", "semi", "multi", "auto", "anti", "post", "non", "pre", "sub", "mis", "dis", "re", "un", "in", "co", "de")
INFLECTIONS = ("ing", "ed", "es", "s", "er", "ers")

CATEGORIES = ("Spelling", "Grammar", "Terminology", "Spacing")
MANUAL = "(needs manual review - no confident auto-suggestion)"
DUPLICATE_NOTE = "Duplicate key - both copies kept as-is, needs manual decision on which is correct"

M_TRIM = "Leading/trailing whitespace"
M_DOUBLE_SPACE = "Double space"
M_MISSING_SPACE = "Missing space after punctuation (run-on sentence)"
M_SPACE_BEFORE = "Unexpected space before punctuation"
M_FRENCH = "Missing required space before punctuation (French-style spacing)"
M_REPEATED = 'Repeated punctuation (e.g. "!!")'
M_DOUBLE_PERIOD = "Double period (not an ellipsis)"
M_NO_OF_GLUED = '"No.Of" should be "No. of" (missing space, and "of" should be lowercase)'
M_NO_OF = '"Of" should be lowercase: "No. of", not "No. Of"'
M_SPLICE = 'Comma splice before an embedded question - should be a new sentence ("." instead of ",")'
M_FAIL = '"Fail to" should be "Failed to" at the start of a sentence'
M_START = "Sentence does not start with a capital letter"
M_MIXED = "Inconsistent capitalization - mixes Title Case and sentence case within the same string"
M_TITLE = "Sentence is written in Title Case - normal UI sentences should use sentence case (capitalize only the first word and any defined terminology)"
M_NUMBER_OF = '"No. of" should be "number of" for consistency (the majority phrasing in this file)'

L_TRIM = "Spacing (trim)"
L_NO_OF = "Grammar (No.Of casing)"
L_NUMBER_OF = "Terminology (No. of -> number of)"
L_PASSIVE = "Grammar (passive voice phrasing)"
L_ID = "Terminology (identifier + ID spacing)"
L_DOUBLE_SPACE = "Spacing (double space)"
L_MISSING_SPACE = "Spacing (missing space after punctuation)"
L_COMMA = "Grammar (comma-continuation casing)"
L_SPACE_BEFORE = "Spacing (space before punctuation)"
L_REPEATED = "Punctuation (repeated !/?)"
L_DOUBLE_PERIOD = "Punctuation (double period)"
L_SPLICE = "Grammar (split comma splice before embedded question)"
L_FAIL = 'Grammar ("Fail to" -> "Failed to")'
L_START = "Grammar (capitalize sentence start)"
L_CASING = "Grammar (inconsistent capitalization)"
L_GLOSSARY = "Terminology (abbreviation casing)"
L_SPELLING = "Spelling (dictionary correction)"
