"""They have to equal these for results to be right."""

# Symbols of enumerated labels, in counting order, and the longest label tracked.
LABEL_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"
MAX_LENGTH = 10

# TLDs crossed with every enumerated label and word, in scan order.
TRACKED_TLDS = [
    "com",
    "net",
    "org",
    "io",
    "co",
    "info",
    "biz",
    "online",
    "store",
    "app",
    "dev",
    "ai",
    "xyz",
    "me",
]

# Sponsored and legacy TLDs: type and jurisdiction.
SPECIAL_TLDS = {
    "gov": ("sTLD", "US"),
    "edu": ("sTLD", "US"),
    "mil": ("sTLD", "US"),
    "int": ("sTLD", "INT"),
    "arpa": ("sTLD", "INT"),
    "aero": ("sTLD", "INT"),
    "asia": ("sTLD", "INT"),
    "cat": ("sTLD", "INT"),
    "coop": ("sTLD", "INT"),
    "jobs": ("sTLD", "INT"),
    "mobi": ("sTLD", "INT"),
    "museum": ("sTLD", "INT"),
    "post": ("sTLD", "INT"),
    "tel": ("sTLD", "INT"),
    "travel": ("sTLD", "INT"),
    "xxx": ("sTLD", "INT"),
}

# Phrases looked for in the lower-cased start of a home page.
PARKING_PHRASES = ["domain parking", "parked domain", "this domain is for sale"]
PRODUCT_PHRASES = [
    "pricing",
    "plans",
    "subscribe",
    "sign up",
    "buy now",
    "api docs",
    "api documentation",
]
INSPECTED_BODY_BYTES = 4096
REDIRECT_STATUSES = [301, 302, 303, 307, 308]

USAGE_NONE = "no_website"
USAGE_PARKED = "parked_or_placeholder"
USAGE_ACTIVE = "active_site"
PRODUCT_ACTIVE = "active_product"
PRODUCT_UNKNOWN = "unknown"

# Parts of speech in the order that decides which list claims a word.
PARTS_OF_SPEECH = ["noun", "verb", "adj", "adv"]

# Substrings that identify a column of a registrar report.
REPORT_COLUMN_HINTS = {
    "iana_id": ["iana-id", "iana id", "registrar-id"],
    "registrar_name": ["registrar name", "registrar-name", "registrar"],
    "tld": ["tld", "gtld"],
    "net_adds": ["net adds", "net-adds", "net_add"],
    "renewals": ["renew"],
    "transfers": ["transfer"],
    "deletes": ["delete"],
    "domains_under_mgmt": ["domains-in-host", "dum", "domains under", "end-of-month-domains"],
}
REPORT_MONTHS_BACK = 3

# Tables on an index page and the ticker links inside them.
INDEX_TABLE_PATTERN = r"<table[^>]*wikitable[^>]*>(.+?)</table>"
TICKER_LINK_PATTERN = r">([A-Z][A-Z0-9.\-]{0,5})</a>"

RANK_LIMIT = 10_000

# Run log vocabulary.
RUN_EVENTS = ["start", "finish", "heartbeat"]
RUN_STATUSES = ["success", "partial", "failed"]
RUN_RUNNING = "running"

# Keys of the stored rollups.
SNAP_OVERALL = "overall"
TLD_ALL = "ALL"

# Freshness report.
STALE_AFTER_HOURS = 30
HISTORY_MONTHS_DEFAULT = 12
HISTORY_MONTHS_MAX = 36

# Tier names and the rank bounds of the ranked ones.
COMPANY_TIERS = {
    "sp500": "in_sp500",
    "russell1000": "in_russell1000",
    "russell3000": "in_russell3000",
    "all_us_public": "in_us_public",
}
RANK_TIERS = {"tranco100": 100, "tranco1000": 1000, "tranco10000": 10000}
TIER_ALL = "all"
