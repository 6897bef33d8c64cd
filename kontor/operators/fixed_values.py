"""Fixed values the results depend on.

FIXED VALUES — these must stay equal to the behaviour being reproduced: the
default keyword rules (tried in this order, first match wins, keywords are
literal lower-case substrings), the category vocabulary, the transfer
categories, the card transaction-type map, and the numeric constants of the
forecast, the prefix learner and the override retention.

Keywords that are personal names or account / loan numbers are deliberately
left out of the default rules; users add their own rules as data.
"""

from __future__ import annotations

# ---- FIXED VALUES: default keyword rules (order matters; "other" is the default) ----
DEFAULT_RULES: list[tuple[list[str], str]] = [
    (["city supermarket", "fresh market", "green grocers", "daily foods", "market plus",
      "intl supermarket", "international supermarket", "travel grocery",
      "mercadona", "carrefour", "leclerc", "lidl", "aldi", "eroski", "coviran",
      "tj-bm", "carniceria", "fruteria", "tj-dia ", "chuleteros", "carnicas",
      "frutimix", "tj-monop", "tj-mendi", "mas x menos",
      "auto mercado", "mini super", "walmart", "super ofermas",
      "mercadito", "pali ", "gran pequeno"], "supermarket"),
    (["amazon", "amzn", "prime video"], "amazon"),
    (["pharmacy", "health plus pharmacy", "farmacia", "tj-fcia", "tj-carlos iii"], "pharmacy"),
    (["morning bakery", "city patisserie", "the bread shop", "sweet corner",
      "panaderia", "panadero", "tahona", "granier", "ogipan", "manterola",
      "arkupe gozotegia", "quindianita", "delicias de jose", "pasteleria",
      "tj-etxe goxoan", "tj-sarl aita"], "bakery"),
    (["the bistro", "city burger", "local kitchen", "corner café", "the grill",
      "sakura", "airport bistro", "holiday restaurant", "beach café",
      "hosteleria", "heladeria", "restaurante", "restauracion", "udon",
      "mc donalds", "mcdonalds", "tagliatella", "asados labea", "meson",
      "tasca ", "la guillotina", "hostal ", "tj-zuasti", "sota de lezkairu",
      "k fecico", "kfc", "central park", "pops ", "brief atocha",
      "la huerta de chicha", "el faro de suances", "tj-calenda",
      "tj-glaces", "tj-arcasa", "tj-plk", "tj-garden", "tj-butchers",
      "soda ", "rosti pollos"], "restaurant"),
    (["café", "cafe "], "restaurant"),
    (["bar "], "restaurant"),
    (["city hotel", "grand suites", "the lodge", "seaside hotel", "airport hotel",
      "hotel iriguibel", "hotel arenas", "hotel venta", "hotel"], "hotel"),
    (["airbnb", "booking.com"], "accommodation"),
    (["air connect", "euro airways", "budget airlines",
      "expedia", "vueling", "iberia", "ryanair", "evelop", "lufthansa", "airlines"], "flight"),
    (["city taxi", "quickcab", "airport taxi", "taxi licencia", "taxi ",
      "uber"], "taxi"),
    (["buildright", "home depot", "tool store", "paint express",
      "leroy merlin", "brico depot", "ferreteria", "textil hogar",
      "berroa garden", "cerrajeria", "saltoki"], "diy"),
    (["sportzone", "gym central", "active life", "gesport", "sarriguren", "decathlon"], "sports"),
    (["highway fuel", "city gas station", "express petrol", "motorway petrol",
      "olloki oil", "es lezkairu", "mutilva", "tj-e.s. zuasti", "cepsa",
      "petro", "gasolinera", "gasolina", "low cost repost", "aralar soto",
      "estacion de servicio", "estacion servicio", "servicentro"], "fuel"),
    (["highway toll", "north motorway", "city bypass toll", "east toll road",
      "vasco aragonesa", "autopista", "interbiak", "peage", "bidegi"], "toll"),
    (["city parking", "central car park", "station parking", "mall car park",
      "parking", "aparcamiento", "ap. pl. castillo", "telpark", "parqueo"], "parking"),
    (["telecom mobile", "netconnect", "móvil ", "vodafone", "lowi", "mybox", "orange"],
     "internet & mobile"),
    (["city electric", "water services", "gas supply", "rcbo.", "recibo unico",
      "energia xxi", "rcbo.energia"], "utilities"),
    (["property management", "monthly rent"], "rent"),
    (["tenant monthly payment", "tenant payment"], "rental income"),
    (["bank loan payment", "santander consumer", "berlingo"], "loan"),
    (["interactive brokers", "revolut digital assets",
      "/cdp ", "superfondo", "cancelacion anticipada"], "investment"),
    (["the mall", "city department store", "tj-0246 eci", "el corte ingles", "corte ingles",
      "tj-ikea", "ikea", "herno", "mediacite"], "dept. store"),
    (["atm cash withdrawal", "cash withdrawal", "reint.cajero", "cajero", "tj-cajero",
      "atm "], "atm"),
    (["bizum recibido", "bizum"], "bizum"),
    (["paypal"], "paypal"),
    (["amazon refund", "store refund", "card refund"], "refund"),
    (["transfer to bank2", "transfer to bank3", "transfer to bank1",
      "transfer from bank1", "transfer from bank2",
      "payment from bank account", "transfer from bank account",
      "transfer to bank account"], "own transfer"),
    (["employer corp", "salary payment", "freelance income",
      "ing. cheque ajeno", "ingreso cajero", "apertura cta",
      "tgss", "direccion provincial", "bncr/intereses ganados"], "income"),
    (["transferencia", "trf. ", "transf. a su favor"], "transfer"),
    (["exchange", "currency exchange"], "exchange"),
]
DEFAULT_CATEGORY = "other"

# ---- FIXED VALUES: category vocabulary (sorted, as stored) ----
DEFAULT_VOCABULARY: list[str] = [
    "accommodation", "amazon", "atm", "bakery", "bizum", "dept. store", "diy",
    "exchange", "flight", "fuel", "hotel", "income", "internet & mobile",
    "investment", "loan", "other", "own transfer", "parking", "paypal",
    "pharmacy", "refund", "rent", "rental income", "restaurant", "sports",
    "supermarket", "taxi", "toll", "transfer", "utilities",
]
# vocabulary used when no vocabulary file exists
EMPTY_VOCABULARY_DEFAULT: list[str] = ["otros"]

# ---- FIXED VALUES: categories that move money between own accounts ----
TRANSFER_CATEGORIES: list[str] = ["own transfer", "transfer"]

# ---- FIXED VALUES: card export transaction type -> category ----
CARD_TYPE_CATEGORY: dict[str, str] = {
    "Topup": "own transfer",
    "ATM": "atm",
    "Card Refund": "refund",
    "Exchange": "exchange",
}
CARD_COMPLETED_STATE = "COMPLETED"

# ---- FIXED VALUES: legacy category folded into "other" ----
LEGACY_CATEGORY = "accommodation"

# ---- FIXED VALUES: numeric constants ----
FORECAST_LOOKBACK_MONTHS = 24
FORECAST_MIN_MONTHS = 2
FORECAST_TREND_MIN = 4
PREFIX_LEN = 20            # bulk apply: characters of the edited concept
LEARN_PREFIX_MIN = 5       # learned prefix rules: shortest prefix
LEARN_PREFIX_MAX = 30      # learned prefix rules: longest prefix
SNAPSHOTS_KEPT = 200       # override versions kept
BALANCE_GAP_TOLERANCE = 0.01
BASE_CURRENCY = "€"
# ---- end of fixed values ----
