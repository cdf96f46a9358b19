"""Fixed values and the settings a monitoring job can change.

Everything under "Fixed values" has to be exactly as written for results to be
right: it is the vocabulary, the page layout and the constants of the portals.
"""

from __future__ import annotations

from dataclasses import dataclass

# --------------------------------------------------------------------------
# Fixed values
# --------------------------------------------------------------------------

# Source labels and the key prefixes that keep their ids apart.
MAIN_SOURCE = "sreality"
NODE_SOURCE = "bezrealitky"
CARD_SOURCE = "idnes"
NODE_KEY_PREFIX = "bez-"
CARD_KEY_PREFIX = "idnes-"

# Source badges and display names.
SOURCE_BADGES = {"sreality": "SR", "bezrealitky": "BR", "idnes": "iD"}
SOURCE_NAMES = {"sreality": "Sreality", "bezrealitky": "Bezrealitky", "idnes": "iDNES"}

# Order of the sources in a run.
SOURCE_ORDER = (MAIN_SOURCE, NODE_SOURCE, CARD_SOURCE)

# Transaction types, in the order each source is searched, and the wording used in titles.
RENT = "pronajem"
SALE = "prodej"
TX_TYPES = (RENT, SALE)
SEARCH_ORDER = {MAIN_SOURCE: (RENT, SALE), NODE_SOURCE: (SALE, RENT), CARD_SOURCE: (SALE, RENT)}
RENT_TITLE = "Pronájem"
SALE_TITLE = "Prodej"
RENT_TYPE_CODE = 2
RENT_OFFER_TYPE = "PRONAJEM"

# Disposition code and enum labels.
DISPOSITION_CODES = {2: "1+kk", 4: "2+kk"}
DISPOSITION_ENUM = {
    "DISP_1_KK": "1+kk",
    "DISP_2_KK": "2+kk",
    "DISP_3_KK": "3+kk",
    "DISP_4_KK": "4+kk",
    "DISP_1_1": "1+1",
    "DISP_2_1": "2+1",
    "DISP_3_1": "3+1",
}

# Keywords that decide what an amount in a clause means.
FEE_KEYWORDS = (
    "poplatky", "poplatek", "služby", "zálohy", "záloha", "měsíční výdaje",
    "provozní náklady", "fond oprav", "svj", "společné prostory", "správa domu",
)
EXCLUDE_KEYWORDS = ("kauce", "provize", "jednorázov", "deposit", "refundable")
ELECTRICITY_KEYWORDS = ("energie", "elektřin")

# Text patterns (Java syntax; (?U) gives \s, \b and \d their Unicode meaning).
CLAUSE_BREAK = r"[+;\n]|,(?U:\s)+|(?iuU:\bplus\b)|\.(?iu:(?<=[a-zá-ž]\.))(?U:\s)+(?iu:(?=[A-ZÁ-Ž]))"
AMOUNT = r"(\d{1,3}(?:[ .,]\d{3})+|\d{3,6})"
AMOUNT_SEPARATORS = r"[ .,]"
TITLE_AREA = r"(?U)(\d+(?:[.,]\d+)?)\s*m"
URL_ID = r"/(\d+)/?$"

# Page patterns.
EMBEDDED_STATE = r'(?s)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>'
SEARCH_QUERY = "estatesSearch"
DETAIL_QUERY = "estate"
TAG = r"<[^>]+>"
CARD = r"(?s)c-products__item(.*?)(?=c-products__item|</main)"
CARD_LINK = r'href="(https://reality\.idnes\.cz/detail/[^"]+)"'
CARD_TITLE = r"(?s)c-products__title[^>]*>(.*?)</a>"
CARD_PRICE = r"(?s)c-products__price[^>]*>(.*?)</p>"
CARD_INFO = r"(?s)c-products__info[^>]*>(.*?)</p>"
CARD_DISPOSITION = r"(?iU)(\d\s*\+\s*(?:kk|\d))"
CARD_AREA = r"(?U)(\d+(?:[.,]\d+)?)\s*m²"
CARD_ID = r"/detail/[^/]+/[^/]+/[^/]+/([0-9a-f]+)/?"
CARD_IMAGE_TAG = r"<img[^>]+>"
CARD_IMAGE_URL = r'(?:data-src|src)="([^"]*1gr\.cz[^"]*)"'

# Nested-node vocabulary.
ADVERT_NODE = "Advert"
IMAGE_NODE = "Image"
IMAGE_URL_KEY = "url("
THUMB_FILTER = "RECORD_THUMB"
MAIN_FILTER = "RECORD_MAIN"

# URL formats.
MAIN_DETAIL_URL = "https://www.sreality.cz/detail/"
NODE_DETAIL_URL = "https://www.bezrealitky.cz/nemovitosti-byty-domy/"
THUMB_SUFFIX = "?fl=res,400,400,1|shr,,20|webp,60"
FULL_SUFFIX = "?fl=res,800,800,1|shr,,20|jpg,80"

# Wording of the serving tables.
COST_LABELS = {
    "rent": "Nájem (net)",
    "fees": "Poplatky / služby",
    "electricity": "Elektřina",
    "total": "Celkem (s elektřinou)",
    "price": "Cena",
    "one_time": "Administrativní poplatek (jednorázově)",
}
FEES_UNSTATED = "neuvedeno listingem"
FEES_FROM_TEXT = "z popisu"
ESTIMATED = "odhad"
ELECTRICITY_STATED = "Elektřina dle částky uvedené v inzerátu."
FEES_AS_ZERO = "Poplatky/služby nejsou u tohoto inzerátu uvedeny -- do celkové ceny započteny jako 0 navíc k odhadu elektřiny."
YES, NO, UNSTATED = "Ano", "Ne", "neuvedeno"
NOTE_PRICE = "Price changed: "
NOTE_NEW = "New listing since last check"
NOTE_LAST_KNOWN = "No longer listed — showing last known details from "

# What is recorded about a watched page that could not be read.
ERROR_STATUS = "HTTP "
ERROR_NO_STATE = "no __NEXT_DATA__ in page (HTTP {})"
ERROR_NO_QUERY = "estate query missing from page"
ERROR_NO_ANSWER = "no answer"

# Fetch statuses that say nothing about the listing itself.
RETRY_STATUSES = (429, 500, 502, 503, 504)

# Page size assumed when neither the page nor its rows give one.
DEFAULT_PAGE_LIMIT = 22

# Mean earth radius, km.
EARTH_RADIUS_KM = 6371.0


@dataclass(frozen=True)
class MonitorConfig:
    """Settings of one monitored market; the defaults are its fixed values."""

    region: str = "Vysočany"
    dispositions: tuple[str, ...] = ("1+kk", "2+kk")
    disposition_codes: tuple[int, ...] = (2, 4)
    max_images: int = 5
    max_text: int = 1200
    history_cap: int = 300
    electricity_estimate: int = 1500
    admin_fee_cap: int = 5000
    centre: tuple[float, float] = (50.10444, 14.50650)
    radius_km: float = 2.0
    fallback_centroid: tuple[float, float] = (50.1075, 14.5070)
    focus_street: str = "Pod Harfou"
    locality_label: str = "Vysočany"
    node_locality: str = "Vysočany (okolí Pod Harfou)"
    #: Compare each portal only over the runs in which it was read to its end, and a listing whose detail page
    #: failed on its bare price.
    strict: bool = False


DEFAULTS = MonitorConfig()
