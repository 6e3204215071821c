"""URL parts and scope predicates.

Parts are cut by pattern rather than by a validating parser, so a malformed
URL still yields the text a lenient splitter would give, never NULL.
"""

from pyspark.sql import Column, functions as F

from pagelens.functions import text

_SCHEME = r"^([a-zA-Z][a-zA-Z0-9+.\-]*):"
_AUTHORITY = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)"
_PATH = r"^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def authority(url: Column) -> Column:
    """Host with any port and user info, as written."""
    return F.regexp_extract(url, _AUTHORITY, 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def host(url: Column) -> Column:
    return F.substring_index(F.lower(authority(url)), ":", 1)


def in_tld(url: Column, tld: str = "cl") -> Column:
    """FLT-1: the last of at least two host labels is ``tld``."""
    return host(url).endswith("." + tld.lower())


def in_scope(url: Column, seed: Column, scope: str, tld: str = "cl") -> Column:
    """FLT-2: ``scope='tld'`` keeps in-TLD pages and seeds, ``'any'`` all."""
    if scope not in ("tld", "any"):
        raise ValueError(f"unknown scope {scope!r}; use 'tld' or 'any'")
    return F.lit(True) if scope == "any" else in_tld(url, tld) | seed


def is_http(url: Column) -> Column:
    """FLT-6: absolute http or https link."""
    return scheme(url).isin("http", "https")


def is_internal(url: Column, domain: Column | str) -> Column:
    """FLT-7: the domain occurs in the host part, nowhere else counts."""
    domain = F.lit(domain) if isinstance(domain, str) else domain
    return F.contains(F.lower(authority(url)), domain)


def domain_norm(domain: Column) -> Column:
    """SCA-30: without leading ``@``, lower-case, trimmed."""
    return text.strip(F.lower(F.ltrim(domain, F.lit("@"))))


def email_domain(email: Column) -> Column:
    """SCA-25: text between the first and second ``@``; NULL without one."""
    return F.try_element_at(F.split(email, "@"), F.lit(2))


def at_suffix(email: Column, target: Column | str) -> Column:
    """FLT-3: plain suffix test, so ``x@notnunoa.cl`` passes ``nunoa.cl``."""
    return F.endswith(email, F.lit(target) if isinstance(target, str) else target)


def at_host(email: Column, domain: Column | str) -> Column:
    """FLT-4: the address host is the domain or lies under it."""
    domain = F.lit(domain) if isinstance(domain, str) else domain
    host_part = F.substring_index(email, "@", -1)
    return (host_part == domain) | F.endswith(
        host_part, F.concat(F.lit("."), domain)
    )
