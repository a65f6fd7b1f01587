"""Identity keys, ids and confidences of catalog rows (X31-X35, F10, G8-G10), as SQL of either dialect.

Columns read: brand category product_family model sku sku_confidence ram storage processor display os_family
os_version price_inr product_url name_source is_canonical_name.
"""

from __future__ import annotations

from .dialect import Dialect

# Words that say nothing about a model.
STOPWORDS = ("laptop", "notebook", "computer", "pc", "with", "and", "full", "metal", "oled", "display")

# What is left out of a model's name, families of models, and what each known part adds to a confidence.
MODEL_NOISE = (r"[\(\)\[\]/,]", r"\b20\d{2}\b", r"\b\d{1,2}(?:\.\d+)?\s*(?:inch|inches|in)\b", r"\b(?:laptop|notebook|computer|pc)\b")
MACBOOKS = ("macbook neo", "macbook air", "macbook pro", "macbook")
MACBOOK, CHIP_M, CHIP_A, CHIP_A_PRO = r"\bmacbook\s+(neo|air|pro)\b", r"\bm([1-9])\b", r"\ba(\d{1,2})(?:\s*pro)?\b", r"\ba\d{1,2}\s*pro\b"
GALAXY_BOOK, MOTOBOOK, MOTOBOOK_PRO = r"\bgalaxy\s+book(\d+)\b", r"\bmotobook\s+(\d+)\b", r"\bmotobook\s+(\d+)(?:\s+pro)?\b"
POINTS = {"k_brand": 0.2, "k_product_family": 0.12, "k_signature": 0.2, "k_ram": 0.08, "k_storage": 0.08, "k_processor": 0.12, "k_display": 0.05, "k_band": 0.03}


def part(d: Dialect, x: str) -> str:
    """Clean, lower, '' for null."""
    return f"lower({d.squeeze(f"coalesce({x}, '')")})"


def model_signature(d: Dialect, x: str) -> str:
    words = ", ".join(f"'{w}'" for w in STOPWORDS)
    return d.join(d.head(d.keep(d.all(f"lower(coalesce({x}, ''))", "[a-z0-9]+"), f"v NOT IN ({words})"), 8), "-")


def price_band(d: Dialect, x: str) -> str:
    text = "string" if d.spark else "varchar"
    low = f"({x} div 10000 * 10)" if d.spark else f"({x} // 10000 * 10)"
    return f"coalesce(cast({low} AS {text}) || 'k-' || cast({low} + 9 AS {text}) || 'k', '')"


def stable_id(d: Dialect, prefix: str, key: str) -> str:
    payload = f"CASE WHEN {key} = '' THEN 'unknown' ELSE trim({key}) END"
    return f"'{prefix}_' || substring(sha1({payload}), 1, 16)"


def strong(d: Dialect) -> str:
    return f"coalesce(trim(sku) <> '' AND sku_confidence >= 0.9, false)"


def _words(d: Dialect, x: str, n: int) -> str:
    return d.join(d.head(d.split(x, " "), n), " ")


def parent_family(d: Dialect, x: str, brand: str) -> str:
    n = d.squeeze(d.sub(x, "[^a-z0-9 ]+", " "))
    mac = [(f"{brand} = 'apple' AND contains({n}, '{w}')", f"'{w}'") for w in MACBOOKS]
    galaxy, moto = d.find(n, GALAXY_BOOK, 1), d.find(n, MOTOBOOK, 1)
    return d.case((f"{x} = ''", "''"), *mac, (f"{galaxy} IS NOT NULL", f"'galaxy book' || {galaxy}"), (f"{moto} IS NOT NULL", f"'motobook ' || {moto}"), other=_words(d, n, 3))


def model_text(d: Dialect, x: str) -> str:
    n = x
    for p in MODEL_NOISE:
        n = d.sub(n, p, " ")
    return d.squeeze(n)


def parent_model(d: Dialect, x: str, n: str, family: str, brand: str) -> str:
    """x: the model, n: its model_text."""
    kind, m, a = d.find(n, MACBOOK, 1), d.find(n, CHIP_M, 1), d.find(n, CHIP_A, 1)
    chip = d.case((f"{m} IS NOT NULL", f"' m' || {m}"), (f"{a} IS NOT NULL", f"' a' || {a} || CASE WHEN {d.match(n, CHIP_A_PRO)} THEN ' pro' ELSE '' END"), other="''")
    galaxy, moto = d.find(n, GALAXY_BOOK, 1), d.find(n, MOTOBOOK_PRO, 1)
    return d.case(
        (f"{x} = ''", family), (f"{brand} = 'apple' AND {kind} IS NOT NULL", f"'macbook ' || {kind} || {chip}"), (f"{galaxy} IS NOT NULL", f"'galaxy book' || {galaxy}"),
        (f"{moto} IS NOT NULL", f"'motobook ' || {moto} || CASE WHEN contains({n}, ' pro') THEN ' pro' ELSE '' END"), other=_words(d, n, 6),
    )


def parts(d: Dialect) -> dict[str, str]:
    """The key's parts; a sku counts where its confidence is 0.9 or more."""
    out = {f"k_{c}": part(d, c) for c in ("brand", "category", "product_family", "model", "ram", "storage", "processor", "display", "os_family", "os_version", "product_url", "sku")}
    return out | {"k_strong": strong(d), "k_signature": model_signature(d, "model"), "k_band": price_band(d, "price_inr")}


def override_score() -> str:
    """How much a row says about its sku's family and model."""
    return "CASE WHEN k_product_family <> '' THEN 0.3 ELSE 0.0 END + CASE WHEN k_model <> '' THEN 0.5 ELSE 0.0 END + least(length(k_model), 40) / 200.0 + CASE WHEN name_source = 'catalog_pattern' THEN 0.2 ELSE 0.0 END"


def key_steps(d: Dialect) -> list[dict[str, str]]:
    """G8-G11 over parts() and the sku's o_family and o_model (null without one)."""
    sku = "CASE WHEN k_strong THEN k_sku ELSE '' END"
    one = {"f_in": "coalesce(nullif(o_family, ''), k_product_family)", "m_in": "coalesce(nullif(o_model, ''), k_model)", "s": sku}
    two = {"f": parent_family(d, "f_in", "k_brand"), "m_text": model_text(d, "m_in")}
    three = {"m": parent_model(d, "m_in", "m_text", "f", "k_brand")}
    four = {"parent_key": "CASE WHEN k_brand || k_category || f || m = '' THEN 'unknown|' || k_product_url ELSE k_brand || '|' || k_category || '|' || CASE WHEN f = '' THEN m ELSE f END || '|' || CASE WHEN m = '' THEN f ELSE m END END"}
    specs = "k_ram || '|' || k_storage || '|' || k_processor || '|' || k_display || '|' || k_os_family || '|' || k_os_version || '|' || s"
    none = "k_ram || k_storage || k_processor || k_display || k_os_family || k_os_version || s = ''"
    exact = "k_brand <> '' AND k_signature <> '' AND k_ram <> '' AND k_storage <> ''"
    odd = "CASE WHEN NOT is_canonical_name THEN 0.05 ELSE 0.0 END"
    score = " + ".join(f"CASE WHEN {c} <> '' THEN {v} ELSE 0.0 END" for c, v in POINTS.items()) + f" + CASE WHEN s <> '' THEN 0.18 WHEN k_sku <> '' THEN 0.07 ELSE 0.0 END + CASE WHEN name_source = 'catalog_pattern' THEN 0.05 ELSE 0.0 END - {odd}"
    cluster = f"CASE WHEN s <> '' THEN CASE WHEN name_source = 'catalog_pattern' THEN 0.99 ELSE 0.95 END WHEN {exact} THEN 0.94 + CASE WHEN k_processor || k_display <> '' THEN 0.03 ELSE 0.0 END - {odd} ELSE 0.72 + CASE WHEN k_brand <> '' AND k_signature <> '' THEN 0.08 ELSE 0.0 END + CASE WHEN k_ram || k_storage <> '' THEN 0.05 ELSE 0.0 END - {odd} END"
    five = {
        "variant_key": f"CASE WHEN s <> '' THEN parent_key || '|sku|' || s WHEN {none} THEN parent_key || '|' || k_signature || '|' || k_band || '|' || k_band ELSE parent_key || '|' || {specs} || '|' || k_band END",
        "cluster_key": f"CASE WHEN s <> '' THEN 'sku|' || k_brand || '|' || s WHEN {exact} THEN 'exact|' || k_brand || '|' || k_signature || '|' || k_ram || '|' || k_storage || '|' || k_processor || '|' || k_display ELSE 'fuzzy|' || k_brand || '|' || k_signature || '|' || k_ram || '|' || k_storage || '|' || k_band END",
        "global_key": "CASE WHEN s <> '' THEN 'sku|' || k_brand || '|' || s ELSE 'spec|' || k_brand || '|' || k_product_family || '|' || k_signature || '|' || k_ram || '|' || k_storage || '|' || k_processor || '|' || k_display || '|' || k_band END",
        "cluster_confidence": f"cast(round(least(0.99, greatest(0.55, {cluster})), 2) AS double)", "match_confidence": f"cast(round(least(0.99, greatest(0.5, {score})), 2) AS double)",
    }
    six = {"canonical_key": "'v1|' || k_category || '|' || parent_key || '|' || variant_key || '|' || CASE WHEN is_canonical_name THEN 'canon' ELSE 'market' END"}
    return [one, two, three, four, five, six]


def ids(d: Dialect) -> dict[str, str]:
    of = {"parent_product_id": ("pp", "parent_key"), "parent_cluster_id": ("pclu", "parent_key"), "variant_id": ("var", "variant_key"), "variant_cluster_id": ("vclu", "cluster_key"), "canonical_product_id": ("cpv1", "canonical_key"), "cluster_id": ("vclu", "cluster_key"), "global_entity_id": ("ge", "global_key")}
    return {name: stable_id(d, *p) for name, p in of.items()}
