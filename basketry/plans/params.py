"""Request parameters of the registered request-style queries (one product, group, category, period).

Request queries still read and join the whole tables; the parameters only pick the request, as a caller's
arguments would.
"""

PRODUCT_ID = 42
ASIN = "0000000042"
GROUP = "MEDIUM"
SIMILARS_GROUP = "LARGE"
CATEGORY = "|MEDIUM|Brand#21"
CATEGORY_SUBSTRING = "Brand#2"
CHOSEN_CATEGORIES = ["|SMALL|Brand#2", "|Brand#21|size_1"]
REQUESTED_CATEGORY = "|PROMO|Brand#7"
MONTH = 7
YEAR = 1997
TOP_N = 5
THRESHOLD = 0.3
NGRAM = 3
PATH_GROUP = "MEDIUM"
PATH_CATEGORY = "|Brand#21|size_1"
DIGITS = 9
REACH_DEPTH = 2
