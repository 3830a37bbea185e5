"""Column expressions of the engine. All are built-in functions, so that they stay inside code generation.

Bad input never raises: what can't be read becomes null, and x/0 becomes 0 where a ratio is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest key, the registries' names, and the patterns of a web address and of a domain.
MAX_KEY = 4_294_967_295
REGISTRIES = ("AFRINIC", "APNIC", "ARIN", "LACNIC", "RIPE NCC")
URL = r"(?i)^https?://(?:(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?|localhost|\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(?::\d+)?(?:/?|[/?]\S+)$"
DOMAIN = r"(?i)^(?:[A-Z0-9](?:[A-Z0-9-]{0,61}[A-Z0-9])?\.)+[A-Z]{2,6}\.?$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def filled(c: Column) -> Column:
    """The text, or null where it is empty."""
    return F.when(c != "", c)


def truthy(c: Column) -> Column:
    """Whether a text is there and not empty."""
    return F.coalesce(c != "", F.lit(False))


def normalized_key(c: Column) -> Column:
    """A key as bigint: text is trimmed and loses one leading AS in any case, numbers are truncated; null if that is no number."""
    text = F.regexp_replace(stripped(c.cast("string")), "(?i)^AS", "")
    whole = F.regexp_extract(text, r"^([+-]?\d+)(?:\.\d*)?$", 1)
    return F.when(whole != "", whole.try_cast("bigint"))


def valid_key(c: Column) -> Column:
    return F.coalesce(c.between(1, MAX_KEY), F.lit(False))


def digits_key(c: Column) -> Column:
    """A key without any AS in it."""
    return F.replace(c, F.lit("AS"), F.lit("")).try_cast("bigint")


def as_flag(c: Column) -> Column:
    """A boolean of its text, in any case; anything else is false."""
    return F.coalesce(F.lower(stripped(c)) == "true", F.lit(False))


def number(c: Column, kind: str = "double") -> Column:
    """A number of its text; null where it is blank or none."""
    return filled(stripped(c.cast("string"))).try_cast(kind)


def whole_number(c: Column) -> Column:
    """A label cell as int: blanks and what is no number are 0."""
    return F.coalesce(number(c), F.lit(0.0)).cast("int")


def nz(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def ratio(n: Column, d: Column) -> Column:
    """n / d, 0.0 where d is 0 or either is null."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def valid_url(c: Column) -> Column:
    return F.coalesce(c.rlike(URL), F.lit(False))


def valid_domain(c: Column) -> Column:
    return F.coalesce(c.rlike(DOMAIN), F.lit(False))


def sanitised(c: Column) -> Column:
    """A category's name as a column's: blanks and slashes become underscores."""
    return F.regexp_replace(c, "[ /]", "_")


def one_hot_name(prefix: str, value: str) -> str:
    return f"{prefix}_{value.lower().replace(' ', '_')}"


def organisation(c: Column) -> Column:
    """An organisation's text without the key that may stand before it: 'AS174 Cogent' is 'Cogent'."""
    parts = F.split(c, " ", 2)
    return F.when(c.startswith("AS") & (F.size(parts) == 2), F.get(parts, F.lit(1))).otherwise(c)


def first_filled(*cs: Column) -> Column:
    return F.coalesce(*(filled(c) for c in cs))


def website(site: Column, domain: Column) -> Column:
    """The site, else https:// before the domain without leading slashes."""
    return F.coalesce(filled(site), F.concat(F.lit("https://"), F.regexp_replace(filled(domain), "^//", "")))


def contains_any(c: Column, needles: tuple[str, ...]) -> Column:
    """1 if the lower-cased text holds any of the needles, else 0; null stays null."""
    low = F.lower(c)
    hit = low.contains(needles[0])
    for n in needles[1:]:
        hit = hit | low.contains(n)
    return hit.cast("int")


def ordered_text(c: Column, sep: str = "|") -> Column:
    """A set of texts as one, in order."""
    return F.array_join(F.array_sort(F.array_distinct(c)), sep)


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; two empty sets have 1."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def mix(seed: int | str, *keys: Column) -> Column:
    """A text that orders keys at random, the same on every engine."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *(k.cast("string") for k in keys)))
