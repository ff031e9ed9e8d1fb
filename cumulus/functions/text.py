"""Text repair for place names and quote-aware splitting of raw lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cumulus.functions._util import as_col

# Ship names kept whole when a region mentions them.
SHIP_REGIONS = ("Diamond Princess", "Grand Princess")
# Region text meaning "no region".
NULL_REGION_EXACT = ("None",)
NULL_REGION_CONTAINS = ("Unknown",)
# Country spellings repaired to one name.
COUNTRY_EXACT_FIXES = {"('St. Martin',)": "St. Martin"}
COUNTRY_CONTAINS_FIXES = ("Bahamas", "Gambia")

# Fixed value: one field of a raw line. A field starts at the line start or right
# after a comma and runs to the next comma outside quotes; quoted runs may stand
# anywhere in it. Possessive, so one linear pass without recursion finds the fields;
# splitting on "a comma followed by an even number of quotes" instead rescans
# the rest of the line at every comma, which is quadratic in the line length.
FIELD_PATTERN = r'(?:^|(?<=,))([^,"]*+(?:"[^"]*+"[^,"]*+)*+)'


def normalise_region(region="region", country="country") -> Column:
    """Clean a region name.

    A region that mentions a ship becomes the ship's name; "None", anything
    containing "Unknown", and a region equal to its country (repaired by
    :func:`normalise_country`) become null (a country-level row); everything else
    is trimmed. (The reference compared the region with itself, which nulled every
    region; comparing with the country is the repair.)
    """
    r = as_col(region)
    c = as_col(country)
    expr = None
    for ship in SHIP_REGIONS:
        cond = r.contains(ship)
        expr = F.when(cond, F.lit(ship)) if expr is None else expr.when(cond, F.lit(ship))
    null_cond = r.isin(*NULL_REGION_EXACT) | (F.trim(r) == F.trim(c)) | (F.trim(r) == normalise_country(c))
    for part in NULL_REGION_CONTAINS:
        null_cond = null_cond | r.contains(part)
    return expr.when(null_cond, F.lit(None).cast("string")).otherwise(F.trim(r))


def normalise_country(country="country") -> Column:
    """Clean a country name: known odd spellings to one name, else trimmed."""
    c = as_col(country)
    expr = None
    for bad, good in COUNTRY_EXACT_FIXES.items():
        cond = c == F.lit(bad)
        expr = F.when(cond, F.lit(good)) if expr is None else expr.when(cond, F.lit(good))
    for name in COUNTRY_CONTAINS_FIXES:
        expr = expr.when(c.contains(name), F.lit(name))
    return expr.otherwise(F.trim(c))


def split_quoted(line) -> Column:
    """Split a raw CSV line on commas outside double quotes, keep trailing empty fields,
    delete every double quote, and turn empty fields into null. Gives array<string>.

    A line with an odd number of quotes has no defined fields: it gives null, and
    ``sources.bad_lines`` reports it. One linear regex pass per line
    (``regexp_extract_all``), built-in and JVM-side.
    """
    parts = F.regexp_extract_all(as_col(line), F.lit(FIELD_PATTERN), 1)
    fields = F.transform(parts, lambda p: F.nullif(F.regexp_replace(p, '"', ""), F.lit("")))
    return F.when(balanced_quotes(line), fields)


def balanced_quotes(line) -> Column:
    """Whether a raw line has an even number of double quotes."""
    c = as_col(line)
    return (F.length(c) - F.length(F.translate(c, '"', ""))) % 2 == 0
