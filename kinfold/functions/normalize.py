"""Normalisers of company records, as column expressions. Two families: one for matching, one for local profiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hosts that many unrelated companies share; compared as whole hosts.
DENIED_HOSTS = ("linkedin.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "bit.ly", "linktr.ee", "google.com", "business.site", "negocio.site", "indiamart.com", "wixsite.com", "wordpress.com", "yelp.com", "weebly.com")
# Legal forms that the local name drops from its end.
LEGAL_FORMS = ("inc", "llc", "ltd", "corp", "gmbh", "sa", "ag")


def nullify_blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def name_norm(name: Column) -> Column:
    """Lower case, runs of white space as one space. Only U+0020 is trimmed, and before that, so other edges leave a space."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(name)), r"\s+", " "), F.lit(""))


def name_norm_ingest(name: Column) -> Column:
    """As name_norm, trimmed once more at the end."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(F.trim(name)), r"\s+", " ")), F.lit(""))


def host(website: Column) -> Column:
    """What follows the scheme http(s) and www. up to a slash; port, user and a query without a slash stay."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(website)), r"^https?://", ""), r"^www\.", "")
    return F.nullif(F.regexp_extract(bare, r"^([^/]+)", 1), F.lit(""))


def eligible_host(host_: Column, denied: tuple[str, ...] = DENIED_HOSTS) -> Column:
    return host_.isNotNull() & ~host_.isin(*denied)


def country_norm(country: Column) -> Column:
    return F.lower(nullify_blank(country))


city_norm = country_norm


def local_host(website: Column) -> Column:
    """Any scheme is understood, and one is assumed if there is none; a query or fragment is cut."""
    text = F.lower(F.trim(website))
    whole = F.when(text.contains("://"), text).otherwise(F.concat(F.lit("http://"), text))
    scheme = r"^[a-z][a-z0-9+.-]*://([^/?#]*)"
    found = F.when(F.regexp_like(whole, F.lit(scheme)), F.regexp_extract(whole, scheme, 1)).otherwise(F.regexp_extract(whole, r"^([^/]*)", 1))
    return F.nullif(F.regexp_replace(found, r"^www\.", ""), F.lit(""))


def local_name(name: Column, forms: tuple[str, ...] = LEGAL_FORMS) -> Column:
    """Legal forms are dropped from the end, one after the other; nothing left is null."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"(?U)\s+", " "))
    return F.nullif(F.regexp_replace(text, rf"(?:(?:^| )(?:{'|'.join(forms)})[.,]*)+$", ""), F.lit(""))


def coarse_key(name: Column, country: Column) -> Column:
    """The local name's first 20 characters and the country, where null countries are alike."""
    return F.concat(F.substring(local_name(name), 1, 20), F.lit("|"), F.lower(F.trim(F.coalesce(country, F.lit("")))))


def masked_hash(c: Column) -> Column:
    text = nullify_blank(c)
    return F.concat(F.lit("hash:"), F.substring(F.sha2(text, 256), 1, 8))


def record_id(number: Column, digits: int = 12) -> Column:
    """'r' and the number with leading zeros. A longer number is kept whole: lpad alone would cut it."""
    text = number.cast("string")
    return F.concat(F.lit("r"), F.when(F.length(text) >= digits, text).otherwise(F.lpad(text, digits, "0")))


def host_parent_id(host_: Column, denied: tuple[str, ...] = DENIED_HOSTS) -> Column:
    return F.when(eligible_host(host_, denied), F.concat(F.lit("p"), F.substring(F.sha2(host_, 256), 1, 16)))


def pct_reduction(num: Column, den: Column) -> Column:
    """1 - num / den; an error for a zero denominator."""
    return F.when(den == 0, F.raise_error(F.lit("reduction of an empty set")).cast("double")).otherwise(1 - num / den)
