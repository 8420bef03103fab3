"""Fixed values of the normalisers: word lists, abbreviations, patterns and letters that results depend on."""

from __future__ import annotations

import re
import unicodedata

# Digits that stand for letters.
LEET_DIGITS, LEET_LETTERS = "01568", "olsgb"
# Legal forms and how they are written.
LEGAL = {
    "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "co": "co", "company": "co",
    "llc": "llc", "ltd": "ltd", "limited": "ltd", "pvt": "pvt", "private": "pvt", "llp": "llp", "lp": "lp",
    "pc": "pc", "pllc": "pllc", "plc": "plc", "pa": "pa", "privatelimited": "pvtltd", "sarl": "sarl", "sas": "sas",
    "sasu": "sasu", "eurl": "eurl", "sci": "sci", "sa": "sa", "snc": "snc", "ei": "ei", "scop": "scop", "gie": "gie",
    "gmbh": "gmbh", "ag": "ag", "bv": "bv", "nv": "nv",
}
# Forms of address, words that join others, words that many names share.
HONORIFIC = ("mr", "mrs", "ms", "dr", "smt", "sri", "shri", "shree", "m/s", "ms/", "the", "messrs")
STOP_NAME = ("and", "&", "of", "+", "|", "-", "le", "la", "les", "du", "de", "des", "et", "l", "d")
GENERIC = ("center", "centre", "services", "service", "partners", "group", "co", "company", "holdings", "holding", "india", "france", "usa", "us", "participations", "distribution", "groupe", "international", "intl", "developpement", "trading", "enterprises")
# Abbreviations of words in names.
NAME_ABBREVIATIONS = {"etablissements": "ets", "etabl": "ets", "compagnie": "cie", "freres": "frs", "brothers": "bros", "associates": "assoc", "associes": "assoc", "international": "intl", "manufacturing": "mfg", "mfrs": "mfg", "technologies": "tech", "technology": "tech", "saint": "st", "sainte": "ste"}
# The standard form of words in addresses.
ADDRESS_ABBREVIATIONS = {
    "st": "st", "street": "st", "saint": "st", "str": "st",
    "rd": "rd", "road": "rd",
    "ave": "ave", "av": "ave", "avenue": "ave", "avanue": "ave",
    "blvd": "blvd", "bd": "blvd", "boulevard": "blvd", "boul": "blvd", "boulevrd": "blvd",
    "dr": "dr", "drive": "dr",
    "ln": "ln", "lane": "ln",
    "ct": "ct", "court": "ct",
    "cir": "cir", "circle": "cir",
    "pl": "pl", "place": "pl",
    "pkwy": "pkwy", "parkway": "pkwy",
    "hwy": "hwy", "highway": "hwy",
    "trl": "trl", "trail": "trl",
    "twp": "twp", "township": "twp",
    "ter": "ter", "terrace": "ter",
    "sq": "sq", "square": "sq",
    "pt": "pt", "point": "pt",
    "mt": "mt", "mount": "mt",
    "ft": "ft", "fort": "ft",
    "n": "n", "north": "n",
    "s": "s", "south": "s",
    "e": "e", "east": "e",
    "w": "w", "west": "w",
    "unit": "unit", "apt": "unit", "apartment": "unit", "suite": "unit", "ste": "unit", "floor": "unit", "flr": "unit",
    "rue": "rue", "r": "rue",
    "imp": "imp", "impasse": "imp",
    "ch": "ch", "chemin": "ch",
    "all": "all", "allee": "all",
    "rte": "rte", "route": "rte",
    "crs": "crs", "cours": "crs",
    "fbg": "fbg", "faubourg": "fbg",
    "qu": "qu", "quai": "qu",
    "nagar": "nagar", "ngr": "nagar",
    "bldg": "bldg", "building": "bldg",
    "opp": "opp", "opposite": "opp",
    "nr": "nr", "near": "nr",
    "sec": "sec", "sector": "sec",
    "grd": "grd", "ground": "grd",
    "colony": "colony", "col": "colony",
}
# Words of addresses without meaning.
ADDRESS_DROP = ("no", "nos", "h", "hno", "h.no", "hn", "door", "number", "num", "n°", "null", "<null>", "n/a", "na", "none", "nil", "1/2", "cdp", "of", "the", "city", "de", "du", "des", "la", "le", "les", "d", "l")
# Marks of trade names, domains, tags, ordinals, elisions and boxes, as patterns.
TRADE_NAME = r"\b(?:doing business as|d\.b\.a\.?|d/b/a|dba:?|f/k/a|fka|formerly known as|formerly|a/k/a|aka|trading as|t/a)(?=\s|$|:)"
DOMAIN = r"^(?:www\.)?([a-z0-9][a-z0-9\-]*)\.(?:com|net|org|in|co|biz|info|fr|us|io)\b"
ID_TAG = r"(?i)\(\s*id\s*:\s*\d+\s*\)|#\d+\b"
ORDINAL = r"^[0-9]+(st|nd|rd|th|er|e|eme|ème)$"
ELISION = r"(?<![a-z])[ld]['’](?=[a-z])"
BOX = r"^(?:p\.?\s*o\.?\s*box|pmb|box)\s*#?\s*\w+$"
# Bits of the flags of a name.
IS_DOMAIN, IS_HANDLE, IS_INDIC, IS_TRADE, IS_TAGGED = 1, 2, 4, 8, 16
# Vowels and simplified consonants of Indic letters, by the end of their Unicode names.
INDIC_VOWELS = {"A": "a", "AA": "a", "I": "i", "II": "i", "U": "u", "UU": "u", "VOCALIC R": "ri", "VOCALIC RR": "ri", "VOCALIC L": "li", "E": "e", "EE": "e", "AI": "ai", "O": "o", "OO": "o", "AU": "au", "SHORT E": "e", "SHORT O": "o", "CANDRA E": "e", "CANDRA O": "o", "SHORT A": "a"}
INDIC_CONSONANTS = {"tt": "t", "tth": "th", "dd": "d", "ddh": "dh", "nn": "n", "ny": "n", "ng": "n", "ss": "sh", "ll": "l", "lll": "l", "rr": "r", "c": "ch", "nnn": "n", "zh": "l"}
INDIC_BLOCKS = range(0x0900, 0x0D80)


def indic_sounds() -> tuple[dict[str, str], dict[str, str]]:
    """By their Unicode names, the Latin form of each Indic letter, sign, mark and digit ('' for what is silent), and its kind: consonant, sign, stop (which takes a consonant's vowel away) or other."""
    sound, kind = {}, {}
    for c in map(chr, INDIC_BLOCKS):
        what = unicodedata.name(c, "")
        if not what:
            continue
        kind[c], sound[c] = "other", ""
        if " DIGIT " in what:
            sound[c] = str(unicodedata.digit(c, 0))
        elif " VOWEL SIGN " in what:
            kind[c], sound[c] = "sign", INDIC_VOWELS.get(what.split(" VOWEL SIGN ")[1], "")
        elif what.endswith("VIRAMA"):
            kind[c] = "stop"
        elif "ANUSVARA" in what or "CANDRABINDU" in what:
            sound[c] = "n"
        elif "VISARGA" in what:
            sound[c] = "h"
        elif " LETTER " in what:
            letter = what.split(" LETTER ")[1]
            if letter in INDIC_VOWELS:
                sound[c] = INDIC_VOWELS[letter]
            else:
                root = letter.split()[0].lower()
                root = re.sub("(?<=.)a$", "", root)
                kind[c], sound[c] = "consonant", INDIC_CONSONANTS.get(root, root)
    return sound, kind


def unmarked() -> dict[str, str]:
    """The letters and digits that compatibility decomposition gives for each character of the basic plane that it changes, without combining marks; syllables of Hangul and what becomes nothing are left out."""
    out = {}
    for c in map(chr, (*range(0xA0, 0xAC00), *range(0xF900, 0xFE00), *range(0xFE30, 0xFFFE))):
        plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if plain != c and plain and not unicodedata.combining(c):
            out[c] = plain
    return out
