"""Fixed values that results depend on.

These are stated once, as text, in natural order.  Sources are public:
the NLTK English stop-word list, Python's ``string.punctuation``, the
default character filter of the Keras text tokenizer, and the whitespace
set of Python's ``str.isspace``.
"""

# ---- fixed values: NLTK English stop words (179 words, NLTK 3.x order) ----
NLTK_STOPWORDS = (
    "i me my myself we our ours ourselves you you're you've you'll you'd your "
    "yours yourself yourselves he him his himself she she's her hers herself it "
    "it's its itself they them their theirs themselves what which who whom this "
    "that that'll these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for "
    "with about against between into through during before after above below to "
    "from up down in out on off over under again further then once here there when "
    "where why how all any both each few more most other some such no nor not only "
    "own same so than too very s t can will just don don't should should've now d "
    "ll m o re ve y ain aren aren't couldn couldn't didn didn't doesn doesn't hadn "
    "hadn't hasn hasn't haven haven't isn isn't ma mightn mightn't mustn mustn't "
    "needn needn't shan shan't shouldn shouldn't wasn wasn't weren weren't won "
    "won't wouldn wouldn't"
).split()

# ---- fixed values: Python string.punctuation (32 ASCII characters) ----
ASCII_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

# ---- fixed values: default filter characters of the Keras text tokenizer ----
KERAS_FILTERS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~\t\n"

# ---- fixed values: characters for which Python's str.isspace() is true ----
# (as a Java regex character-class body)
PY_WHITESPACE_CLASS = (
    "\\t\\n\\x0B\\f\\r\\x1C-\\x1F \\x85\\xA0\\u1680\\u2000-\\u200A"
    "\\u2028\\u2029\\u202F\\u205F\\u3000"
)

# the same set as literal characters
PY_WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

# ---- fixed values: small irregular-noun lemma table (user-replaceable) ----
LEMMA_TABLE = {
    "children": "child",
    "feet": "foot",
    "geese": "goose",
    "men": "man",
    "mice": "mouse",
    "teeth": "tooth",
    "women": "woman",
}

# ---- fixed values: noun suffix rules, tried longest first ----
# (suffix, replacement); a word keeps its form when it ends in ss, us or is,
# or when it is three characters or shorter.
NOUN_SUFFIX_RULES = (
    ("sses", "ss"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("ies", "y"),
    ("xes", "x"),
    ("zes", "z"),
    ("s", ""),
)

# ---- fixed values: detachment rules of WordNet's noun morphology (suffix, ending of the lemma) ----
NOUN_DETACHMENTS = (
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
)

# ---- fixed values: Porter's suffix rules, steps 2 to 4, with the extended mode's bli and fulli ----
# (M. F. Porter, "An algorithm for suffix stripping", Program 14(3), 1980)
PORTER_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful"),
)
PORTER_STEP3 = (
    ("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""),
)
PORTER_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)

# ---- fixed values: irregular forms of the extended mode ----
PORTER_IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
    "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing", "cannings": "canning",
    "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}

# ---- fixed values: label vocabularies of the message sets ----
EMAIL_POSITIVE = "Phishing Email"
EMAIL_NEGATIVE = "Safe Email"
SMS_THREE = {"ham": 0, "spam": 1, "smishing": 2}
SMS_MERGED = {"ham": 0, "spam": 0, "smishing": 1}

# ---- fixed values: verdict strings of the scorer ----
VERDICT_PHISHING = "Potential phishing email detected: "
VERDICT_NORMAL = "Normal email: "
