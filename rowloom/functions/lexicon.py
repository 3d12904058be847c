"""Word lists, patterns and numbers that results depend on."""

# White space as one class, since regular expression dialects disagree about \s.
SPACES = "\t\n\x0b\f\r \xa0  -     　﻿"

# Scripts.
TARGET_SCRIPT = "[؀-ۿ]"
LATIN = "[A-Za-z]"

# Patterns over text whose white space is normalized. Word boundaries are ASCII ones.
SENTENCE_END = r"""[.!?؟…]["')\]»]*$"""
HEADER = r"(?i)^(show|airdate|your language)"
BRACKETED = r"^[\[(（].{1,80}[\])）]$"
URL = r"(?i)^(https?://|www\.|[A-Za-z0-9-]+\.(com|org|net|tv|ir|vn|news|co)(/|$))"
CREDIT = r"(?i)^(source|video|footage|courtesy|credit)s?:"
MONTHS = (
    "jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec|"
    "march|april|june|july|august|september|october|november|december"
)
TITLE = r"(?i)news scroll|daily news"
COMMA_END = "[،,:;]$"
SOURCE_COMMA_END = "[,:;]$"

# Punctuation that target spacing closes up, and that token comparison ignores.
NO_SPACE_BEFORE = r" +([،؛؟!,.:\]])"
NO_SPACE_AFTER = r"([\[(\"«]) +"
POLISH = [(r" +([،؛؟!,.])", "$1"), (r"([«(\[]) +", "$1"), (r" +([)\]»])", "$1")]
IGNORED_IN_TOKENS = r"[،؛؟!,.:\"«»()\[\]-]"

# Words.
AUXILIARIES = (
    "است هست بود شد شده شوند شده‌اند می‌شود می‌شوند می‌کند می‌کنند می‌کنید می‌کرد می‌کردند نمی‌شود نمی‌کنند "
    "خواهد خواهند کرد کرده کردند گرفت گرفته گرفتند"
).split()
VERB_PREFIXES = ["می", "نمی"]
CONNECTORS = "و یا اما که تا در از به با برای بر اگر زیرا ولی چون".split()
ADJECTIVES = (
    "شگفت‌انگیز شگفت‌انگيز قادر مطلق قدیمی قديمي جدید جديد رایگان رايگان قابل‌اعتماد بین‌المللی بین‌المللى "
    "کم‌برخوردار بازنشسته طبیعی طبيعی نادِر نادر پایدار پايدار الهی خدایی خدايی"
).split()
ADJECTIVE_ENDS = "(انه|مند|وار|آمیز|انگیز|آسا|گونه|گونه‌ای|گونۀ)$"
RIGHT_FRAGMENTS = "اما اگر که برای با به از و یا زیرا ولی چون تا در روی مثل هنوز".split()
CONTINUATIONS = "اما که و یا زیرا ولی چون تا هنوز".split()
LEFT_FRAGMENTS = "با به از در برای تا مثل اگر که اما".split()
FLOW_CONNECTORS = "اما که و یا زیرا ولی چون".split()

# Phrases that stay together, and the ones a reviewer is told about.
PHRASES = [
    "در پی", "به دنبال", "به دلیل", "به خاطر", "از سوی", "از طریق", "در واقع", "در حالی", "در حالی که", "درحالی که",
    "درحالیکه", "برای مثال", "کریستف کلمب", "کلمب کریستف", "کریستوفر کلمب",
]
HINT_PHRASES = [
    "در پی", "به دنبال", "به دلیل", "از سوی", "از طریق", "در حالی که", "کریستف کلمب", "کلمب کریستف", "کریستوفر کلمب",
]

# Limits of a line where nothing is learned.
LIMITS = {
    "preferred_char_min": 12,
    "preferred_char_target": 28,
    "preferred_char_max": 45,
    "soft_char_max": 45,
    "hard_char_max": 45,
    "preferred_word_target": 6,
    "preferred_word_max": 9,
    "hard_word_max": 12,
}
#: Lines of a row type from which its own limits count.
MIN_TYPE_LINES = 10

# Planning weights, by profile.
WEIGHTS = {
    "default": {"boundary": 1.0, "short_single": 3.5, "lead_in": 1.5, "single_run": 0.0, "meta": 20.0, "comma": 1.0},
    "nwn": {"boundary": 1.35, "short_single": 5.75, "lead_in": 2.5, "single_run": 2.75, "meta": 20.0, "comma": 1.75},
}
GLOBAL_ROWS = 6
KEPT_PLANS = {"default": 12, "nwn": 18}
SPANS = {"default": (1, 2, 3), "nwn": (1, 2, 3, 4)}
SHOWN_PLANS = 5
REVIEW_BATCH = 8

# How many phrase notes and flagged groups are shown.
SHOWN_PHRASES, SHOWN_FLAGGED = 10, 20
