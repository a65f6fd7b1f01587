"""Normalisers of the record-cleaning path, as SQL of either dialect."""

from __future__ import annotations

from .dialect import Dialect

# Fixed values of the record format.
NOISE = ("add to compare", "currently unavailable", "coming soon", "pre order", "pre-order", "trending")
PLACEHOLDERS = ("", "na", "n/a", "none", "null", "unknown", "item", "product", "placeholder", "test")
CATEGORIES = {"laptops": "laptop", "laptop": "laptop", "notebook": "laptop", "ultrabook": "laptop", "mobiles": "smartphone", "mobile": "smartphone", "phone": "smartphone", "smartphone": "smartphone", "tablets": "tablet", "tablet": "tablet"}
CATEGORY_WORDS = {"laptop": ("laptop", "notebook", "ultrabook", "macbook"), "smartphone": ("smartphone", "mobile", "iphone", "android phone"), "tablet": ("tablet", "ipad")}
BRANDS = {"apple": "Apple", "samsung": "Samsung", "lenovo": "Lenovo", "dell": "Dell", "hp": "HP", "asus": "ASUS", "acer": "Acer", "msi": "MSI", "xiaomi": "Xiaomi", "oneplus": "OnePlus", "realme": "Realme", "oppo": "OPPO", "vivo": "Vivo"}
PROCESSORS = (r"\bA\d{1,2}\s*Pro\b", r"\bA\d{1,2}\b", r"\bM[1-5](?:\s*Pro|\s*Max|\s*Ultra)?\b", r"\bIntel\s+Core\s+i[3579]\b", r"\bCore\s+i[3579]\b", r"\bRyzen\s+\d+\b", r"\bSnapdragon\s+[A-Za-z0-9+\-]+\b", r"\bDimensity\s+\d+\b")
OUTPUT = ("brand", "category", "model", "variant", "ram", "storage", "processor", "display", "os", "price_inr", "rating", "review_count", "availability", "product_url")
PRICE_BOUNDS = {"laptop": (10_000, 1_000_000), "smartphone": (2_000, 300_000), "tablet": (3_000, 300_000), None: (100, 10_000_000)}
MEDIUM = "ssd|hdd|ufs|rom|emmc"
# Counts with a suffix, and sizes of memory as titles have them.
COUNT_BASE, COUNT_UNIT = r"(\d+(?:\.\d+)?)\s*[km]\b", r"\d\s*([km])\b"
MEMORY_PAIR = rf"\b(\d{{1,3}})\s*gb\s*(?:/|\s)\s*(\d{{2,4}})\s*(gb|tb)(?:\s*({MEDIUM}))?\b"
MEMORY_NAMED = rf"\b(\d{{2,4}})\s*(gb|tb)\s*({MEDIUM})\b"
RAM_GB = r"\b(\d{1,3})\s*gb\s*ram\b"
TITLE_TAILS = (r"\b\d+(?:\.\d+)?\s*\d[\d,]*\s*ratings?\b.*$", r"\b\d+(?:\.\d+)?\s*ratings?\b.*$", r"\b\d[\d,]*\s*reviews?\b.*$", r"\bno\s+cost\s+emi\b.*$", r"\bbank\s+offer\b.*$")
MEMORY_SIGNAL = r"\b\d{1,4}\s*(gb|tb)\s*(ram|rom|ssd|hdd|ufs|emmc)?\b"
OWN_STORAGE = r"(\d{2,4})\s*(GB|TB)(?:\s*(SSD|HDD|UFS|ROM|eMMC))?"
DISPLAY_INCH, DISPLAY_CM = r"\b(\d{1,2}(?:\.\d+)?)\s*(?:inch\b|inches\b|\"\b)", r"\b(\d{1,2}(?:\.\d+)?)\s*cm\b"
SYSTEMS = ((("macos", "mac os"), "macOS"), (("windows",), "Windows"), (("chrome os", "chromeos"), "ChromeOS"), (("linux", "ubuntu"), "Linux"), (("android",), "Android"), (("ios",), "iOS"))
STATES = ((("unavailable",), "unavailable"), (("out of stock", "sold out"), "out_of_stock"), (("pre order", "pre-order", "coming soon", "preorder"), "preorder"), (("in stock", "available now"), "in_stock"))
MODEL_PARENS, MODEL_SIZES, MODEL_SCREENS = r"\([^)]*\)", r"\b\d{1,4}\s*(?:GB|TB)\b(?:\s*(?:RAM|ROM|SSD|HDD|UFS|eMMC))?", r"\b\d+(?:\.\d+)?\s*(?:inch|inches|cm)\b"
MODEL_RATINGS, MODEL_CODES = r"\b\d+(?:\.\d+)?\s*ratings?\b.*$", r"\b\d+[A-Za-z0-9\-]{6,}\b"


def _raw(x: str) -> str:
    return f"coalesce(trim({x}), '')"


def _medium(kind: str) -> str:
    return f"CASE WHEN lower({kind}) = 'emmc' THEN 'eMMC' ELSE upper({kind}) END"


def _with(base: str, kind: str) -> str:
    return f"rtrim({base} || ' ' || coalesce({_medium(kind)}, ''))"


def title(d: Dialect, x: str) -> str:
    """C2."""
    x = _raw(x)
    for p in NOISE:
        x = d.sub(d.sub(x, rf"^\s*{p}\s*[:|\-]?\s*", ""), rf"\b{p}\b", " ")
    for p in TITLE_TAILS:
        x = d.sub(x, p, "")
    return d.strip(d.squeeze(x), " ,;|-")


def price(d: Dialect, x: str) -> str:
    """All digits together, if positive."""
    return f"nullif({d.long(d.sub(x, '[^0-9]', ''))}, 0)"


def rating(d: Dialect, x: str) -> str:
    """C6."""
    n = d.double(d.find(f"replace({x}, ',', '.')", r"\d+(?:\.\d+)?"))
    return f"CASE WHEN {n} <= 5 THEN {n} END"


def review_count(d: Dialect, x: str) -> str:
    """C7."""
    t = f"replace(lower({x}), ',', '')"
    base, unit = d.double(d.find(t, COUNT_BASE, 1)), d.find(t, COUNT_UNIT, 1)
    return f"CASE WHEN {base} IS NOT NULL THEN cast(floor({base} * CASE {unit} WHEN 'k' THEN 1000 ELSE 1000000 END) AS bigint) ELSE {d.long(d.sub(t, '[^0-9]', ''))} END"


def rating_in(d: Dialect, x: str) -> str:
    """C8."""
    return rating(d, d.either(d.find(x, r"\b(\d(?:\.\d)?)\s+\d[\d,]*\s*ratings?\b", 1), d.find(x, r"\b(\d(?:\.\d)?)\s*(?:ratings?|reviews?)\b", 1)))


def reviews_in(d: Dialect, x: str) -> str:
    return d.long(f"replace({d.find(x, r'\b(\d[\d,]*)\s*reviews?\b', 1)}, ',', '')")


def brand_text(d: Dialect, x: str, name: str, slug: str) -> str:
    """What is given, else the title's first word, else the link's."""
    raw = d.either(f"nullif({_raw(x)}, '')", d.find(name, r"^\S+"), f"nullif(split_part({slug}, '-', 1), '')")
    return f"trim({d.sub(raw, r'[^A-Za-z0-9+\- ]', '')})"


def brand(d: Dialect, raw: str) -> str:
    known = " ".join(f"WHEN {d.text(k)} THEN {d.text(v)}" for k, v in BRANDS.items())
    caps = f"{raw} = upper({raw}) AND {d.match(raw, '[A-Z]', False)}"
    return f"CASE lower({raw}) WHEN '' THEN null {known} ELSE CASE WHEN {caps} THEN {raw} ELSE {d.title(raw)} END END"


def category(d: Dialect, x: str, *others: str) -> str:
    """C10."""
    raw = f"lower({_raw(x)})"
    blob = "lower(" + " || ' ' || ".join(f"coalesce({o}, '')" for o in (x, *others)) + ")"
    own = [(f"contains({raw}, {d.text(k)})", d.text(v)) for k, v in CATEGORIES.items()]
    return d.case(*own, *(((" OR ".join(f"contains({blob}, {d.text(w)})" for w in words)), d.text(k)) for k, words in CATEGORY_WORDS.items()))


def variant(d: Dialect, x: str, name: str) -> str:
    """C11."""
    return d.either(f"nullif({_raw(x)}, '')", f"trim({d.find(name, r'\(([^)]{0,118}[^)\s][^)]{0,118})\)', 1)})")


def memory_text(d: Dialect, *sources: str) -> str:
    """What memory_specs reads: the sources in lower case, separators as spaces."""
    return d.sub("lower(concat_ws(' ', " + ", ".join(f"nullif({s}, '')" for s in sources) + "))", "[-_/]+", " ")


def memory_list(d: Dialect, m: str) -> str:
    """Every size in the text as 'number unit medium' (medium may be empty), in order."""
    return d.all(m, rf"\b\d{{1,4}} *(?:gb|tb)\b(?: (?:{MEDIUM})\b)?")


def _megas(d: Dialect, v: str) -> str:
    return f"({d.long(d.find(v, '[0-9]+'))} * CASE WHEN contains({v}, 'tb') THEN 1024 ELSE 1 END)"


def memory_specs(d: Dialect, m: str, sizes: str) -> tuple[str, str]:
    """Ram and storage from memory_text and memory_list: a pair, what is named, else the least and the greatest size."""
    pair, named = MEMORY_PAIR, MEMORY_NAMED
    two = d.match(m, pair)
    low = d.at(d.keep(sizes, f"{_megas(d, 'v')} = {_least(d, sizes)}", "v"), 1)
    high = d.at(d.keep(sizes, f"{_megas(d, 'v')} = {_most(d, sizes)}", "v"), 1)
    several = f"{d.size(sizes)} >= 2"
    ram = d.case(
        (two, f"{d.find(m, pair, 1)} || ' GB'"), (d.match(m, RAM_GB), f"{d.find(m, RAM_GB, 1)} || ' GB'"),
        (f"{several} AND contains({low}, 'gb') AND {d.long(d.find(low, '[0-9]+'))} <= 64", f"cast({d.long(d.find(low, '[0-9]+'))} AS {'string' if d.spark else 'varchar'}) || ' GB'"),
        (f"{d.size(sizes)} = 1 AND {d.match(m, r'\b\d+\s*(gb|tb)\s*ram\b')}", f"upper({d.find(m, r'\b(\d+)\s*(?:gb|tb)\s*ram\b', 1)} || ' ' || {d.find(m, r'\b\d+\s*(gb|tb)\s*ram\b', 1)})"),
    )
    large = f"cast({d.long(d.find(high, '[0-9]+'))} AS {'string' if d.spark else 'varchar'}) || ' ' || upper({d.find(high, 'gb|tb')})"
    storage = d.case(
        (two, _with(f"{d.find(m, pair, 2)} || ' ' || upper({d.find(m, pair, 3)})", d.find(m, pair, 4))),
        (d.match(m, named), _with(f"{d.find(m, named, 1)} || ' ' || upper({d.find(m, named, 2)})", d.find(m, named, 3))),
        (several, _with(large, d.find(high, rf"({MEDIUM})$", 1))),
        (f"{d.size(sizes)} = 1 AND {d.match(m, rf'\b\d+\s*(gb|tb)\s*({MEDIUM})\b')}", _with(large, d.find(high, rf"({MEDIUM})$", 1))),
    )
    return ram, storage


def _least(d: Dialect, sizes: str) -> str:
    values = d.map(sizes, _megas(d, "w"), "w")
    return f"array_min({values})" if d.spark else f"list_min({values})"


def _most(d: Dialect, sizes: str) -> str:
    values = d.map(sizes, _megas(d, "w"), "w")
    return f"array_max({values})" if d.spark else f"list_max({values})"


def with_medium(d: Dialect, storage: str, m: str) -> str:
    """A medium that the text names anywhere, if the storage has none."""
    bare = f"NOT {d.match(storage, r'\b(SSD|HDD|UFS|ROM|eMMC)\b', False)}"
    ways = [(f"{bare} AND {d.match(m, rf'\b{k}\b')}", f"{storage} || ' {k.upper()}'") for k in ("ssd", "hdd", "ufs", "rom")]
    return f"CASE WHEN {storage} IS NOT NULL THEN {d.case(*ways, other=storage)} END"


def own_ram(d: Dialect, x: str) -> str:
    """C13."""
    return f"{d.find(x, r'(\d{1,3})\s*(?:GB|TB)', 1)} || ' ' || upper({d.find(x, r'\d{1,3}\s*(GB|TB)', 1)})"


def own_storage(d: Dialect, x: str) -> str:
    return _with(f"{d.find(x, OWN_STORAGE, 1)} || ' ' || upper({d.find(x, OWN_STORAGE, 2)})", d.find(x, OWN_STORAGE, 3))


def processor(d: Dialect, x: str) -> str:
    """C14."""
    return d.squeeze(d.either(*(d.find(x, p) for p in PROCESSORS)))


def display(d: Dialect, x: str, text: str) -> str:
    """C15."""
    return d.either(f"nullif({_raw(x)}, '')", f"{d.find(text, DISPLAY_INCH, 1)} || ' inch'", f"{d.find(text, DISPLAY_CM, 1)} || ' cm'")


def system(d: Dialect, x: str, text: str) -> str:
    t = f"lower({_raw(x)} || ' ' || {text})"
    return d.case(*((" OR ".join(f"contains({t}, '{w}')" for w in words), f"'{n}'") for words, n in SYSTEMS), other=f"nullif({_raw(x)}, '')")


def availability(d: Dialect, x: str, text: str) -> str:
    raw = f"lower({_raw(x)})"
    t = f"({raw} || ' ' || lower({text}))"
    return d.case(*((" OR ".join(f"contains({t}, '{w}')" for w in words), f"'{n}'") for words, n in STATES), (f"{raw} IN ('in_stock', 'out_of_stock', 'unavailable', 'preorder')", raw))


def model_text(d: Dialect, x: str, name: str) -> str:
    """What is given, else the title, without the noise."""
    m = d.either(f"nullif({_raw(x)}, '')", name)
    for p in NOISE:
        m = d.sub(m, rf"\b{p}\b", " ")
    return m


def model(d: Dialect, m: str, brand_: str) -> str:
    begins = f"lower(substring({m}, 1, length({brand_}) + 1)) = lower({brand_}) || ' '"
    m = f"CASE WHEN {begins} THEN trim(substring({m}, length({brand_}) + 1)) ELSE {m} END"
    for p in (MODEL_PARENS, MODEL_SIZES, MODEL_SCREENS):
        m = d.sub(m, p, " ")
    m = d.sub(d.sub(m, MODEL_RATINGS, ""), MODEL_CODES, " ", False)
    m = d.sub(d.sub(m, r"\s*/\s*", " "), r"\bmacbook\b", "MacBook")
    return d.strip(d.squeeze(m), ' ,;|-')


def realistic_price(d: Dialect, category_: str, price_: str) -> str:
    """F7."""
    low, high = PRICE_BOUNDS[None]
    ways = [(f"{category_} = '{k}'", f"{price_} BETWEEN {a} AND {b}") for k, (a, b) in PRICE_BOUNDS.items() if k]
    return f"coalesce({d.case(*ways, other=f'{price_} BETWEEN {low} AND {high}')}, false)"


def placeholder(d: Dialect, x: str) -> str:
    """F5."""
    return f"coalesce(lower(trim({x})) IN ({', '.join(d.text(p) for p in PLACEHOLDERS)}), true)"


def memory_signal(d: Dialect, x: str) -> str:
    """F8."""
    return d.match(x, MEMORY_SIGNAL)
