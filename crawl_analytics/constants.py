"""Fixed values. These must stay as they are for results to be right."""

# Filter lists used when no choice is given.
DEFAULT_FILTER_LISTS = [
    "https://easylist.to/easylist/easylist.txt",
    "https://easylist.to/easylist/easyprivacy.txt",
    "https://easylist.to/easylistgermany/easylistgermany.txt",
    "https://stanev.org/abp/adblock_bg.txt",
    "https://easylist-downloads.adblockplus.org/easylistdutch.txt",
    "https://raw.githubusercontent.com/EasyList-Lithuania/easylist_lithuania/master/easylistlithuania.txt",
    "https://easylist-downloads.adblockplus.org/easylistitaly.txt",
    "https://easylist-downloads.adblockplus.org/easylistpolish.txt",
    "https://easylist-downloads.adblockplus.org/easylistportuguese.txt",
    "https://easylist-downloads.adblockplus.org/ruadlist.txt",
    "https://zoso.ro/pages/rolist.txt",
    "https://easylist-downloads.adblockplus.org/liste_fr.txt",
]

# Consent phrases, most specific first within a language.
ACCEPT_PHRASES = [
    # english
    "accept all cookies and continue",
    "accept all cookies",
    "accept all & close",
    "accept all and close",
    "accept and continue",
    "agree to all cookies",
    "allow all cookies",
    "i agree to all",
    "accept all",
    "allow all",
    "i accept all",
    "accept cookies",
    "agree to cookies",
    "allow cookies",
    "i accept cookies",
    "i agree",
    "i accept",
    "accept & close",
    "accept and close",
    "accept",
    "agree",
    "allow",
    "consent",
    "got it",
    "ok",
    # german
    "alle cookies akzeptieren",
    "alle cookies zulassen",
    "alle cookies erlauben",
    "alle cookies annehmen",
    "alles akzeptieren",
    "alles zulassen",
    "alle akzeptieren",
    "alle zustimmen",
    "allen zustimmen",
    "cookies akzeptieren",
    "cookies zulassen",
    "zustimmen und weiter",
    "ich stimme zu",
    "zustimmen",
    "akzeptieren",
    "erlauben",
    "einverstanden",
    # french
    "accepter tous les cookies",
    "accepter tous",
    "tout accepter",
    "tout autoriser",
    "autoriser tout",
    "j'accepte tout",
    "j'accepte",
    "je suis d'accord",
    "accepter les cookies",
    "accepter",
    "autoriser",
    "d'accord",
    # spanish
    "aceptar todas las cookies",
    "aceptar todo",
    "aceptar todas",
    "permitir todo",
    "acepto todo",
    "acepto las cookies",
    "acepto",
    "aceptar",
    "permitir",
    "de acuerdo",
    # italian
    "accetta tutti i cookie",
    "accetta tutto",
    "accetta tutti",
    "accetto tutto",
    "accetta",
    # dutch
    "alle cookies accepteren",
    "alle cookies toestaan",
    "alles accepteren",
    "alles toestaan",
    "accepteer alles",
    "cookies accepteren",
    "accepteren",
    "accepteer",
    "toestaan",
    # polish
    "zaakceptuj wszystkie cookies",
    "akceptuję wszystkie",
    "zaakceptuj wszystkie",
    "akceptuję",
    "zgadzam się",
    # russian
    "принять все файлы cookie",
    "принять все куки",
    "разрешить все",
    "принять все",
    "согласен со всем",
    "принять",
    "разрешить",
    "согласен",
]

# Country codes under the EU data protection law.
EU_COUNTRY_CODES = [
    "AT", "BE", "BG", "CY", "CZ", "DE", "DK", "EE", "ES", "FI", "FR", "GR", "HR", "HU",
    "IE", "IT", "LT", "LU", "LV", "MT", "NL", "PL", "PT", "RO", "SE", "SI", "SK",
]

# Pattern that takes the domain out of a URL (group 1).
DOMAIN_PATTERN = r"^(?:https?://)?(?:[^@/\n]+@)?(?:www\.)?([^:/ \n]+)"

# Wall clock used by the models, and time zones offered by the dashboard.
CRAWL_TIME_ZONE = "Europe/Berlin"
DASHBOARD_TIME_ZONES = [
    "UTC",
    "America/Los_Angeles",
    "America/Chicago",
    "America/New_York",
    "Europe/London",
    "Europe/Paris",
    "Asia/Jerusalem",
    "Europe/Moscow",
    "Asia/Kolkata",
    "Asia/Shanghai",
    "Asia/Tokyo",
    "Australia/Sydney",
]

# Rank buckets (upper bound, label) and the labels past them.
RANK_BUCKETS = [(1000, "1. Top 1K"), (10000, "2. 1K - 10K"), (50000, "3. 10K - 50K")]
RANK_BEYOND = "4. 50K+"
RANK_UNKNOWN = "5. Unknown/Unranked"

# Legal zones.
ZONE_EU = "EU (GDPR)"
ZONE_UK = "UK (Post-Brexit GDPR)"
ZONE_CH = "Switzerland (DPA)"
ZONE_OTHER_CCTLD = "Non-EU ccTLD"
ZONE_GENERIC = "Global/Generic"

# Cookie behaviour classes.
COOKIES_BOTH = "regardless (both)"
COOKIES_ACCEPTED = "only when cookies accepted"
COOKIES_NOT_ACCEPTED = "only when cookies not accepted"
COOKIES_UNCLASSIFIED = "unclassified"

# Outcome classes of a seed.
OUTCOME_LOADED = "Loaded"
OUTCOME_REDIRECT = "Redirect (no content)"
OUTCOME_BLOCKED = "Blocked (403)"
OUTCOME_CLIENT_ERROR = "Client Error (4xx)"
OUTCOME_SERVER_ERROR = "Server Error (5xx)"
OUTCOME_OTHER = "Other"
OUTCOME_NO_RESPONSE = "No Response"

# Consent categories.
WITH_WARNING = "With Cookie Warning"
WITHOUT_WARNING = "Without Cookie Warning"

# Browsers, event kinds, crawl parameter defaults and queue names.
BROWSERS = ["chromium", "firefox", "webkit"]
DATA_TYPES = ["requests", "responses", "cookie_warning_consents", "site_metadata", "worker_metadata"]
PARAM_DEFAULTS = {
    "auto_accept_cookies": True,
    "navigate_subpages": False,
    "max_depth": 0,
    "dwell_time": 30,
    "scroll_amounts": [],
    "browser_type": "chromium",
    "headless": False,
}
SYSTEM_EXPERIMENT = "system"
DEFAULT_EXPERIMENT = "default"
SUBJECT_PREFIX = "crawl.urls"
TARGET_SEEDS = 25000
DESCRIPTION_CHARS = 500
BLOCKED_MAX_OK = 5
