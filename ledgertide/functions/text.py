"""Scalar column functions: tickers, names, identifiers, decimals, display rounding, roles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ticker shape and placeholders that are not tickers.
TICKER_PATTERN = r"^[A-Z0-9][A-Z0-9.\-]{0,9}$"
PLACEHOLDERS = ("NONE", "NA", "N/A", "NULL")
CIK_PATTERN = r"^[0-9]{1,10}$"
ACCESSION_PATTERN = r"(\d{10}-\d{2}-\d{6}|(?<!\d)\d{18}(?!\d))"


# --- tickers ----------------------------------------------------------------------


def ticker_key(text: Column) -> Column:
    """The compared form of one code: upper case, "." read as "-"."""
    return F.replace(F.upper(F.trim(text)), F.lit("."), F.lit("-"))


def tokens(text: Column) -> Column:
    """The written classes of a ticker text, in order."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[,;\s]+"), lambda t: t != "")


def ticker_tokens(*texts: Column) -> Column:
    """Every stated class of the texts as distinct compared keys."""
    return F.array_distinct(F.transform(F.flatten(F.array(*[tokens(t) for t in texts])), ticker_key))


def usable_ticker(text: Column) -> Column:
    value = F.upper(F.trim(text))
    return value.rlike(TICKER_PATTERN) & ~value.isin(*PLACEHOLDERS)


def provider_symbol(text: Column) -> Column:
    """Provider form of a ticker ("." as "-"); NULL when unusable."""
    return F.when(usable_ticker(text), ticker_key(text))


def normalized_ticker(text: Column) -> Column:
    """Upper-case text, NULL for placeholders and blanks."""
    value = F.upper(F.trim(text))
    return F.when((value != "") & ~value.isin(*PLACEHOLDERS), value)


def display_ticker(*texts: Column) -> Column:
    """The first usable symbol over the texts in order, else the first text that is not a placeholder."""
    usable = F.filter(F.flatten(F.array(*[tokens(t) for t in texts])), usable_ticker)
    return F.coalesce(F.upper(F.trim(F.get(usable, 0))), *[normalized_ticker(t) for t in texts])


# --- names ------------------------------------------------------------------------

# Company suffixes dropped before names are compared.
NAME_CODE, NAME_PAR = r"\[[A-Z]{1,3}\]", r"\b(?:USD|US\$|PAR VALUE)\s*\d+(?:\.\d+)?"
NAME_CLASS = r"\b(?:COMMON\s+(?:STOCK|SHARES)|CLASS\s+[AB])\b"
NAME_SUFFIXES = ("INCORPORATED", "INC", "CORPORATION", "CORP", "COMPANY", "CO", "LIMITED", "LTD", "PLC", "COM", "CMN")


def clean(text: Column) -> Column:
    """Whitespace collapsed, NUL characters removed, never NULL."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "\\x00", ""), r"\s+", " "))


def fold(text: Column) -> Column:
    return F.lower(clean(text))


def normalize_name(name: Column) -> Column:
    """Comparable company name: no codes, par values, classes, suffixes or punctuation; digits that
    stand for letters are corrected only inside words that also hold letters."""
    value = F.upper(name)
    for pattern in (NAME_CODE, NAME_PAR, NAME_CLASS):
        value = F.regexp_replace(value, pattern, " ")
    pieces = F.regexp_extract_all(value, F.lit(r"([A-Z0-9]+|[^A-Z0-9]+)"), 1)
    mended = F.transform(pieces, lambda w: F.when(w.rlike("[A-Z]") & w.rlike("[0-9]"), F.translate(w, "50", "SO")).otherwise(w))
    value = F.array_join(mended, "")
    value = F.regexp_replace(value, r"\b(?:" + "|".join(NAME_SUFFIXES) + r")\b", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(value, "[^A-Z0-9 ]", " "), " +", " "))


# --- identifiers ------------------------------------------------------------------


def cik(text: Column) -> Column:
    """Ten-digit form of a CIK, NULL when it is not one."""
    value = F.trim(text)
    return F.when(value.rlike(CIK_PATTERN) & ~value.rlike("^0+$"), F.lpad(value, 10, "0"))


def accession(text: Column) -> Column:
    """The one accession a text names, with dashes; NULL when it names none or several."""
    found = F.array_distinct(F.transform(
        F.regexp_extract_all(text, F.lit(ACCESSION_PATTERN), 1),
        lambda a: F.when(a.contains("-"), a).otherwise(F.concat_ws("-", F.substring(a, 1, 10), F.substring(a, 11, 2), F.substring(a, 13, 6)))))
    return F.when(F.size(found) == 1, F.get(found, 0))


def person_key(source: Column, cik_text: Column, name: Column, district: Column, position: Column) -> Column:
    detail = F.when(source == "house", district).otherwise(position)
    return F.when(source == "sec", F.concat(F.lit("sec:"), cik(cik_text))).otherwise(
        F.concat(source, F.lit(":"), name, F.lit("|"), detail))


def parse_person_key(key: Column) -> Column:
    """Struct (source, cik, name, detail); NULL for a malformed key."""
    source, rest = F.split_part(key, F.lit(":"), F.lit(1)), F.substring_index(key, ":", -1)
    is_sec = (source == "sec") & rest.rlike(r"^\d{10}$")
    is_other = source.isin("house", "oge") & rest.rlike(r"^[^|]*\S[^|]*\|[^|]*\S[^|]*$") & (F.length(key) <= 300)
    return F.when(is_sec | is_other, F.struct(
        source.alias("source"), F.when(is_sec, rest).alias("cik"), F.when(is_other, F.split_part(rest, F.lit("|"), F.lit(1))).alias("name"),
        F.when(is_other, F.split_part(rest, F.lit("|"), F.lit(2))).alias("detail")))


def identity(*parts: Column) -> Column:
    """A stable id from its parts."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


# --- numbers ----------------------------------------------------------------------


def decimal_value(text: Column, kind: str = "decimal(18,6)") -> Column:
    """Finite decimal of a text, else NULL."""
    return text.try_cast(kind)


def positive_value(text: Column) -> Column:
    value = decimal_value(text)
    return F.when(value > 0, value)


def price_text(value: Column) -> Column:
    """Two places, four below one, half-up."""
    number = value.cast("decimal(30,12)")
    return F.when(F.abs(number) >= 1, F.round(number, 2).cast("decimal(20,2)").cast("string")).otherwise(
        F.round(number, 4).cast("decimal(20,4)").cast("string"))


def money_text(value: Column) -> Column:
    return F.round(value.cast("decimal(38,12)"), 2).cast("decimal(28,2)").cast("string")


def shares_text(value: Column) -> Column:
    """A share count without trailing zeros."""
    text = value.cast("string")
    return F.when(text.contains("."), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text)


def ratio_text(value: Column, places: int = 10) -> Column:
    """A ratio at fixed places, half-even."""
    return F.bround(value.cast("decimal(38,20)"), places).cast(f"decimal(30,{places})").cast("string")


def basis_points(change: Column) -> Column:
    """Change of a yield quoted in percent, as basis points."""
    return F.round(change.cast("double") * 100, 4)


# --- roles ------------------------------------------------------------------------

# Words of an executive position -> department code, first match wins.
DEPARTMENTS = (
    ("treasury", "treasury"), ("commerce", "commerce"), ("defense", "defense"), ("justice", "justice"),
    ("interior", "interior"), ("energy", "energy"), ("health and human services", "hhs"),
    ("housing and urban development", "hud"), ("homeland security", "homeland_security"),
    ("education", "education"), ("labor", "labor"), ("transportation", "transportation"),
    ("environmental protection agency", "epa"), ("navy", "navy"), ("army", "army"), ("air force", "air_force"),
    ("state", "state"), ("agriculture", "agriculture"), ("veterans affairs", "veterans_affairs"),
)


def truth(text: Column) -> Column:
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("1", "true", "yes"), F.lit(False))


def executive_role(position: Column) -> Column:
    """Role code of an executive-branch position, e.g. secretary.commerce."""
    value = F.lower(F.trim(F.coalesce(position, F.lit(""))))
    office = F.regexp_extract(value, r"^(secretary|administrator)\s*\((.*)\)", 1)
    inside = F.regexp_extract(value, r"^(secretary|administrator)\s*\((.*)\)", 2)
    department = F.lit(None).cast("string")
    for words, code in reversed(DEPARTMENTS):
        department = F.when(inside.contains(words), code).otherwise(department)
    return (F.when(value == "president", "president").when(value.startswith("vice president"), "vice_president")
            .when(value.startswith("attorney general"), "attorney_general")
            .when((office != "") & department.isNotNull(), F.concat_ws(".", office, department)).otherwise("official"))


def filer_roles(is_officer: Column, title: Column, is_director: Column, is_ten_percent: Column, is_other: Column) -> Column:
    """Role codes of one filer on one filing."""
    text = F.upper(F.coalesce(title, F.lit("")))
    ceo, cfo = text.rlike(r"\bCEO\b|CHIEF\s+EXECUTIVE"), text.rlike(r"\bCFO\b|CHIEF\s+FINANCIAL")
    officer = truth(is_officer)
    return F.array_compact(F.array(
        F.when(officer & ceo, "ceo"), F.when(officer & cfo, "cfo"), F.when(officer & ~ceo & ~cfo, "officer"),
        F.when(truth(is_director), "director"), F.when(truth(is_ten_percent), "ten_percent"), F.when(truth(is_other), "other")))


def title_flags(title: Column) -> dict[str, Column]:
    """Executive flags of officer titles; a Vice President is not the President."""
    text = F.coalesce(title, F.lit(""))
    without_vice = F.regexp_replace(text, r"(?i)\bVice[ -]+President\b", "")
    return {"is_ceo": text.rlike(r"(?i)\b(?:CEO|Chief\s+Executive\s+Officer)\b"),
            "is_cfo": text.rlike(r"(?i)\b(?:CFO|Chief\s+Financial\s+Officer)\b"),
            "is_president": without_vice.rlike(r"(?i)\bPresident\b"),
            "is_chair": text.rlike(r"(?i)\b(?:Chairman|Chairwoman|Chairperson|Chair)\b")}


def asset_kind(asset_type: Column) -> Column:
    value = F.lower(F.coalesce(asset_type, F.lit("")))
    return F.when(value.contains("bond"), "bond").when(value.isin("stock", "option", "fund"), value).otherwise("other")


def plan_answer(flags: Column) -> Column:
    """yes / no / partly / unknown from an aggregate over a filing's plan flags (NULL = not stated)."""
    return (F.when(F.bool_and(F.coalesce(flags, F.lit(False))), "yes")
            .when(F.bool_and(F.coalesce(~flags, F.lit(False))), "no")
            .when(F.bool_or(F.coalesce(flags, F.lit(False))), "partly").otherwise("unknown"))


# --- filing notes -----------------------------------------------------------------

_NUMBER = r"\$?\s*([0-9]+(?:,[0-9]{3})*(?:\.[0-9]+)?)"
RANGE_PATTERN = (r"(?i)(?:ranging\s+from|range(?:d|s)?\s+(?:from|of)|prices\s+(?:from|between)|between)\s*"
                 + _NUMBER + r"\s*(?:to|and|[-–])\s*" + _NUMBER)


def plan_flag(raw_flag: Column, notes: Column) -> Column:
    """The 10b5-1 flag, or a footnote clause that affirms the plan without negating it."""
    text = F.array_join(notes, " ")
    affirmed = F.exists(F.split(text, r"[.;]"), lambda c: c.rlike(r"(?is)(?:pursuant\s+to|under|in\s+accordance\s+with).*?10b5[\s-]*1")
                        & ~c.rlike(r"(?is)\b(?:not|no|without)\b.*?10b5[\s-]*1"))
    return F.coalesce(F.lower(raw_flag).isin("1", "true"), F.lit(False)) | F.coalesce(affirmed, F.lit(False))


def weighted_price_range(notes: Column) -> tuple[Column, Column]:
    """The one unambiguous (low, high) of footnotes that name a weighted average."""
    weighted = F.filter(notes, lambda n: n.rlike(r"(?i)weighted[\s-]+average"))
    number = lambda t: F.replace(t, F.lit(","), F.lit("")).try_cast("decimal(18,6)")
    part = lambda n, group: F.regexp_extract_all(n, F.lit(RANGE_PATTERN), group)
    ranges = F.flatten(F.transform(weighted, lambda n: F.zip_with(
        part(n, 1), part(n, 2), lambda low, high: F.struct(number(low).alias("low"), number(high).alias("high")))))
    valid = F.array_distinct(F.filter(ranges, lambda r: (r["low"] >= 0) & (r["low"] <= r["high"])))
    one = F.when(F.size(valid) == 1, F.get(valid, 0))
    return one["low"], one["high"]
