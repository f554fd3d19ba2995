"""Scalar functions as column expressions, so Catalyst can see into them."""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
M_PER_MI = 1609.344
FT_PER_M = 3.28084
FIXED = 1e7
TTL_MS = 7 * 24 * 60 * 60 * 1000
MAX_ENTRY_CHARS = 1_500_000
COOLDOWN_MS = 60_000


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    half_lat, half_lon = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * EARTH_M) * F.asin(F.sqrt(h))


def planar2(lat1, lon1, lat2, lon2) -> Column:
    """Squared distance in degrees, without a correction for latitude."""
    dlat, dlon = _c(lat1) - _c(lat2), _c(lon1) - _c(lon2)
    return dlat * dlat + dlon * dlon


def half_up(x) -> Column:
    """Nearest integer, halves toward plus infinity."""
    return F.floor(_c(x) + 0.5)


def rounded(x, digits: int) -> Column:
    """Nearest multiple of 10**-digits by one shared formula, halves up."""
    scale = float(10**digits)
    return F.floor(_c(x) * scale + 0.5) / F.lit(scale)


def exact_fixed(x: float | None, digits: int) -> float | None:
    """Rounding of the exact binary value, halves away from zero; for use on
    single numbers where ``rounded`` is off by one on near ties."""
    if x is None:
        return None
    return float(Decimal(x).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))


def xml_escape(s) -> Column:
    """The five markup characters as entities, the ampersand first."""
    out = _c(s).cast("string")
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(plain), F.lit(entity))
    return out


def number_text(x) -> Column:
    """Shortest plain decimal text of a coordinate (up to nine places)."""
    return F.regexp_replace(_c(x).cast("decimal(14,9)").cast("string"), r"\.?0+$", "")


def fixed4(x) -> Column:
    """Four decimals, as text."""
    return rounded(x, 4).cast("decimal(14,4)").cast("string")


def area_key(net, radius_m, lat, lon) -> Column:
    """Cache key of an area: a shift of a few metres gives the same one."""
    return F.concat_ws("|", _c(net), half_up(radius_m).cast("bigint").cast("string"), fixed4(lat), fixed4(lon))


def address_key(q) -> Column:
    """Trimmed, lower case, runs of white space as one space."""
    space = " \t\n\x0b\f\r\xa0\ufeff\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
    return F.lower(F.regexp_replace(F.btrim(_c(q), F.lit(space)), f"[{space}]+", " "))


def cooldown_left(now, last, window=COOLDOWN_MS) -> Column:
    """Milliseconds until the next request may go; 0 if there was none."""
    now, last, window = _c(now), _c(last), F.coalesce(_c(window), F.lit(COOLDOWN_MS))
    return F.when(last.isNull(), F.lit(0).cast("bigint")).otherwise(F.greatest(F.lit(0).cast("bigint"), (window - (now - last)).cast("bigint")))


def to_fixed7(x) -> Column:
    return half_up(_c(x) * FIXED).cast("bigint")


def from_fixed7(x) -> Column:
    return _c(x) / F.lit(FIXED)


def miles(metres) -> Column:
    return _c(metres) / F.lit(M_PER_MI)


def feet(metres) -> Column:
    return half_up(_c(metres) * FT_PER_M).cast("bigint")


def seconds_up(ms) -> Column:
    return F.ceil(_c(ms) / F.lit(1000.0)).cast("bigint")


def hue(i, n) -> Column:
    return _c(i) / F.greatest(_c(n), F.lit(1)) * 360


def color(i, n) -> Column:
    return F.concat(F.lit("hsl("), number_text(hue(i, n)), F.lit(",70%,62%)"))


def uri_component(s) -> Column:
    """Percent-encoding of a query value: a space is %20, and ! ' ( ) * ~ stay."""
    out = F.url_encode(_c(s))
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out
