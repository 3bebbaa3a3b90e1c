"""Fixed values that results depend on."""

# Normalisation of transliterations.
ERASURE = r"<<.*?>>"
BIG_GAPS = ("[x x]", "[x x x]", "[x x x x]", "[x x x x x]", "[...]", "[n lines broken]", "[broken]", "[lost]", "[missing]")
SINGLE_GAPS = ("[x]", "[?.]")
BIG_GAP, SINGLE_GAP = "<big_gap>", "<gap>"
DELETED = "!?/:.˹˺"

# Letters of transliterations, with the index digits.
UPPER = "A-ZĀĒĪŪṢṬŠḪÁÀÉÈÍÌÚÙÂÊÎÛÄÏÜ"
LOWER = "a-zāēīūṣṭšḫáàéèíìúùâêîûäïüʾ"
INDEX = "₀₁₂₃₄₅₆₇₈₉"
DETERMINATIVE = r"\{[^}]+\}"
PLAIN_LETTERS = "a-zA-ZāēīūṣṭšḫĀĒĪŪṢṬŠḪ"

# Running headers of scanned pages.
PAGE_NUMBER = r"^\d+\s*(?:\w\s+[A-Z][A-Za-z\s\.\,\-]+)?\s*$"
HEADER_MARKS = "šṭṣḫāēīūṣṭŠḤĪŪĀĒṦḫšṢ"

# Language scores.
DIACRITICS = "šṭṣḫāēīūṢŠḤĪŪĀĒṦ"
SCORE_SUMEROGRAM = r"[A-Z]{2,}(?:\.[A-Z]+)*"
SCORE_GAP = r"\[[\p{L}\p{N}_\s\x0B\x1C-\x1F\x85\p{Z}.x?+]*\]"
KEYWORDS = "dumu i-na a-na itu.kam li-mu-um iš-tù ḫa-mu kù.babbar ma-na gín um-ma igi ṣí-ib-tám ú-ṣa-áb i-ṣé-er i-šu ḫa-mu-uš-tim i-ša-qal il5-qé".split()
ENGLISH = (
    "the and of to in is that he she his her was will from with has have had not but or as at by be it its this for an are were been being which who whom they "
    "them their we our you your"
).split()
TRADE = (
    "owes silver mina minas shekel shekels son debt paid pay interest month week weeks witness seal tablet took gave received said wrote brother father copper "
    "tin textile textiles talent talents loaves bread donkey palace swore oath city claim claims owed"
).split()
GERMAN = (
    "der die das den dem des ein eine einer einem einen und oder aber wenn weil damit dass von mit aus nach für ist sind war werden hat haben nicht auch noch "
    "sich wie so nur schon immer jetzt hier dort sehr ob bei wird kann sein"
).split()
TURKISH = "bir bu için olan ile veya ama ancak daha çok sonra önce hem ya da milyonu olarak olduğu edecek edildiğinden yılında oğlu gümüş satır metni teslim".split()
FRENCH = (
    "le la les un une des du de et ou mais donc car ni que qui quoi dont où est sont dans pour par sur avec sans sous entre vers depuis selon comme très bien "
    "aussi même plus moins tout tous toutes cette ces leur leurs ses notre nos votre vos il elle ils elles nous vous lui eux ce cela"
).split()

# Pairs on pages.
TEXT_HEADER = r"(?i)\bText\s+\d+[a-z]?[.:]"
LABEL = r"\((Tablet|Envelope|Composite Text)\)\s*"
REFERENCE = r"\s*REL\s+\d+\s+[IVX]+\.?\s*$"

# Keys for comparing names.
KEY_FROM, KEY_TO = "āēīūṣṭḫ", "aeiusth"
NUMERALS = ("I", "II", "III", "IV")
TASK_PREFIX = "translate Akkadian to English: "
