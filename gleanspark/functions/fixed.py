"""Patterns and word lists that must match the data model's exactly for right results, whole and in their natural order.

Everything that has a rule of its own lives beside its use; here is only what can't differ.
"""

from __future__ import annotations

# Noise: security checks, closed pages, consent banners, labels that describe a page.
CHALLENGE = (
    r"(?i)just a moment|attention required|checking your browser|verify(?:ing)? you are (?:a )?human|"
    r"performing security verification|security check to access|are you a robot|"
    r"enable javascript and cookies to continue|ddos protection by|cf-browser-verification|"
    r"captcha|access denied|request blocked|unusual traffic from your computer|"
    r"press (?:&|and) hold|bot detection|you have been blocked|error 1020|bots use \w+ too|"
    r"confirm (?:this search|that you) (?:was made by|are) a human|select all (?:squares|images) (?:containing|with)"
)
LOGIN = (
    r"(?i)\b(?:sign in|log in|login) to (?:continue|view|access|read)|subscribe to (?:continue|read)|"
    r"create (?:a free|an) account to|this content is for (?:subscribers|members)"
)
CONSENT = (
    r"(?i)\b(?:we use cookies|this (?:site|website) uses cookies|cookie (?:policy|settings|preferences)|"
    r"accept all cookies|manage (?:consent|cookies)|your privacy choices)\b"
)
METADATA_LABEL = (
    r"(?i)^(?:last[ _-]?updated|updated|last[ _-]?modified|modified|created|published|"
    r"publication[ _-]?date|release[ _-]?date|author|authors|maintainer|contact|license|licence|"
    r"format|version|identifier|doi|issn|isbn|language|publisher|source|citation|keywords|"
    r"tags|frequency|update[ _-]?frequency|coverage|spatial|temporal|status)$"
)
PUBLISHER_TYPES = (
    "organization", "corporation", "localbusiness", "automotivebusiness", "brand", "place", "governmentorganization",
    "educationalorganization", "newsmediaorganization", "onlinestore", "store", "ngo",
)
PUBLIC_LABELS = ("gov", "gouv", "gob", "govt", "edu", "ac", "int", "mil")

# Records: labels of identifiers, titles and internals.
IDENTIFIER_LABEL = r"(?:^|_)(?:id|no|num|number|ref|reference|code|serial|sr|circular|notification)(?:_|$)"
TITLE_LABEL = (
    r"(?:^|_)(?:title|name|subject|heading|headline|event|product|company|organi[sz]ation|"
    r"institution|notification|circular|topic|tool|program(?:me)?|project)(?:_|$)"
)
INTERNAL_LABEL = r"(?:^|_)(?:id|uuid|guid|slug|pk)$|(?:order|position|index|weight)$"

# Cells: money, shares, bounds.
MONEY_CELL = r"(?i)(?:[$€£¥₹₩₽]|\b(?:usd|eur|gbp|inr|jpy|cny|rs\.?|us\$)\b)\s?-?\d|\d\s?(?:usd|eur|gbp|inr|jpy|cny|dollars?|euros?|rupees?)\b"
PERCENT_CELL = r"(?i)-?\d[\d.,]*\s?(?:%|percent\b|pct\b|pp\b)"
BOUND_CELL = r"(?i)\b(?:under|over|below|less than|more than|up to|at least|at most)\s+(?:[$€£¥₹]|\d)"

# Prose: what stands before and after a quantity that is a bound or a change.
BOUND_BEFORE = (
    r"(?i)\b(?:under|over|below|above|less than|more than|fewer than|up to|at least|at most|"
    r"exceeding|beyond|upwards of|in excess of)\s*$"
)
CHANGE_BEFORE = (
    r"(?i)\b(?:by|up|down|rose|fell|increased?|decreased?|dropped|climbed|jumped|declined|grew|gained|"
    r"rise|drop|jump|gain|grow|fall|climb|slip|slide|cut|saving|savings|difference of|(?:decline|increase|drop|rise|fall|reduction|jump|gain|growth|"
    r"change|premium|discount)s?\s+of(?:\s+(?:roughly|about|around|nearly|almost|some))?)\s*$"
)
CHANGE_AFTER = (
    r"(?i)^\s*(?:less|more|lower|higher|cheaper|pricier|increase|decrease|drop|rise|gain|decline|jump|"
    r"year[- ]over[- ]year|yoy|annually)\b"
)
QUANTITY_SCALE = r"(?:\s?(?:trillion|billion|million|thousand|crore|lakh|bn|mn|tn|k|m)\b)?"

# Requests: windows of time in words, with counts as digits or words.
COUNT_WORDS = {
    "a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "fifteen": 15, "twenty": 20, "thirty": 30,
}
LAST_PERIODS = (
    r"\b(?:last|past|previous|prior|recent|preceding)\s+"
    rf"(?:(\d{{1,3}}|{'|'.join(sorted(COUNT_WORDS, key=len, reverse=True))})\s+)?"
    r"(?:(complete|completed|full|calendar)\s+)?(day|week|month|quarter|year|yr|decade)s?\b"
)
