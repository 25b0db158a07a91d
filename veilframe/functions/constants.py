"""Fixed values of the text rules, in natural order."""

# Spoken numbers and their digits.
NUMBER_WORDS = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "ten": "10", "eleven": "11", "twelve": "12", "thirteen": "13", "fourteen": "14", "fifteen": "15", "sixteen": "16", "seventeen": "17", "eighteen": "18", "nineteen": "19",
    "twenty": "20", "thirty": "30", "forty": "40", "fifty": "50", "sixty": "60", "seventy": "70", "eighty": "80", "ninety": "90",
}

# Spoken mail providers and their domains.
EMAIL_PROVIDERS = {
    "gmail": "gmail.com", "google": "gmail.com", "hotmail": "hotmail.com", "outlook": "outlook.com", "yahoo": "yahoo.com", "icloud": "icloud.com", "apple": "icloud.com",
    "aol": "aol.com", "protonmail": "protonmail.com", "proton": "protonmail.com", "yandex": "yandex.com", "zoho": "zoho.com", "live": "live.com", "msn": "msn.com",
    "mail": "mail.com", "gmx": "gmx.com", "fastmail": "fastmail.com", "me": "me.com", "mac": "mac.com", "qq": "qq.com",
}

# Filler words, as patterns.
FILLERS = (r"\buh\b", r"\bhuh\b", r"\bmm+\b", r"\bhmm+\b", r"\bum+\b")

# Months and their short forms; "may" is left out, as it mostly is a verb.
MONTHS = (
    "january", "february", "march", "april", "june", "july", "august", "september", "october", "november", "december",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug", "sep", "sept", "oct", "nov", "dec",
)

# Ordinal words up to thirty-first, "first" alone left out; transcripts lose hyphens, so both forms count.
ORDINAL_WORDS = (
    "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth", "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth",
    "eighteenth", "nineteenth", "twentieth", "thirtieth", "twenty-first", "twenty-second", "twenty-third", "twenty-fourth", "twenty-fifth", "twenty-sixth", "twenty-seventh", "twenty-eighth",
    "twenty-ninth", "twenty first", "twenty second", "twenty third", "twenty fourth", "twenty fifth", "twenty sixth", "twenty seventh", "twenty eighth", "twenty ninth", "thirty-first", "thirty first",
)

# Australian street kinds and states.
STREETS = ("Street", "St", "Road", "Rd", "Avenue", "Ave", "Drive", "Dr", "Lane", "Ln", "Boulevard", "Blvd", "Circuit", "Cct", "Court", "Ct", "Place", "Pl", "Way", "Crescent", "Cres")
STATES = ("NSW", "VIC", "QLD", "WA", "SA", "TAS", "ACT", "NT")

# Which ground-truth fields a detected type may stand for.
COMPATIBLE = {
    "PERSON": ("member_first_name", "member_full_name", "consultant_first_name"),
    "EMAIL_ADDRESS": ("member_email",),
    "PHONE_NUMBER": ("member_mobile",),
    "AU_PHONE_NUMBER": ("member_mobile",),
    "LOCATION": ("member_address",),
    "AU_ADDRESS": ("member_address",),
    "MEMBER_NUMBER": ("member_number",),
    "ORGANIZATION": (),
    "DATE_TIME": (),
    "US_SSN": ("member_number",),
}

# Ground-truth fields, those that are names, and the entities looked for.
GROUND_TRUTH_FIELDS = ("member_first_name", "member_full_name", "member_email", "member_mobile", "member_address", "member_number", "consultant_first_name")
NAME_FIELDS = ("member_first_name", "member_full_name", "consultant_first_name")
ENTITIES = ("PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "LOCATION", "CREDIT_CARD", "MEMBER_NUMBER", "AU_PHONE_NUMBER", "AU_ADDRESS", "GENERIC_NUMBER")
