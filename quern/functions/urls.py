"""URL functions: pattern-based expressions that never raise, and one Arrow UDF for relative references."""

from __future__ import annotations

import re
from collections.abc import Iterable
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import _c, blank, default, strip

#: scheme, authority, path, query of an absolute URL without its fragment.
_ABSOLUTE = r"(?i)\A(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?\z"
#: Path endings of what isn't a page, and of documents.
ASSET_ENDINGS = ".png .jpg .jpeg .gif .svg .webp .ico .css .js .map .woff .woff2 .ttf .eot .mp4 .mp3 .zip .rar .7z .exe .dmg".split()
DOCUMENT_ENDINGS = ".pdf .doc .docx .xls .xlsx .ppt .pptx".split()
#: Marks of sign-in pages and refusals.
LOGIN_HOSTS = ("login.microsoftonline.com", "login.windows.net", "sts.windows.net", "adfs")
LOGIN_PATHS = ("login", "signin", "sign-in", "signout", "logoff", "/adfs/", "oauth", "saml", "auth")
LOGIN_PATHS_ON_SITE = ("login", "signin", "sign-in", "/adfs/", "authenticate.aspx")
SIGN_IN_TITLES = ("sign in", "sign-in", "log in", "login", "pick an account", "enter password", "verify your identity")
DENIED_PHRASES = ("access denied", "401 unauthorized", "403 forbidden", "you don't have access", "you do not have access", "request access", "access restricted")


def _part(url: Column | str, k: int) -> Column:
    return F.regexp_extract(blank(url), _ABSOLUTE, k)


def host(url: Column | str) -> Column:
    """Host in lower case, without user info and port; '' if the URL is not absolute."""
    authority = F.regexp_replace(_part(url, 2), r"\A.*@", "")
    return F.lower(F.when(authority.startswith("["), F.regexp_extract(authority, r"\A\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(authority, r"\A([^:]*)", 1)))


def path(url: Column | str) -> Column:
    return _part(url, 3)


def normalize_url(url: Column | str) -> Column:
    """An absolute http(s) URL in its normal form, or null.

    The fragment, user info, ports 80 and 443 and a last segment's parameters go; host and scheme are lower-cased; runs
    of slashes in the path become one; an empty path is a slash; the query stays.
    """
    raw = strip(blank(url))
    dropped = raw.rlike(r"\A(javascript:|mailto:|tel:|data:)")
    authority = F.regexp_replace(_part(raw, 2), r"\A.*@", "")
    port = F.regexp_extract(authority, r":(\d+)\z", 1)
    bad_port = authority.rlike(r":[^:\]]*[^0-9:\]][^:\]]*\z") | (F.length(port) > 5) | F.coalesce(port.try_cast("int") > 65535, F.lit(False))
    named = F.when((port == "") | port.try_cast("int").isin(0, 80, 443), host(raw)).otherwise(F.concat_ws(":", host(raw), port.try_cast("int").cast("string")))
    where = F.regexp_replace(path(raw), r";[^/]*\z", "")
    where = F.regexp_replace(default(where, "/"), "/{2,}", "/")
    query = _part(raw, 4)
    whole = F.concat(F.lower(_part(raw, 1)), F.lit("://"), named, where, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(~dropped & raw.rlike(_ABSOLUTE) & (_part(raw, 2) != "") & ~bad_port, whole)


@F.pandas_udf(T.StringType())
def _join(base: pd.Series, ref: pd.Series) -> pd.Series:
    def one(b: str | None, r: str | None) -> str | None:
        try:
            return urljoin(b or "", r or "")
        except ValueError:
            return None

    return pd.Series([one(b, r) for b, r in zip(base, ref)], dtype=object)


def resolve_url(base: Column | str, ref: Column | str) -> Column:
    """normalize_url of a reference that may be relative to base; only relative ones go through Python."""
    raw = strip(blank(ref))
    dropped = (raw == "") | raw.rlike(r"\A(javascript:|mailto:|tel:|data:)")
    return F.when(dropped, F.lit(None).cast("string")).when(raw.rlike(r"(?i)\Ahttps?://"), normalize_url(raw)).otherwise(normalize_url(_join(_c(base), raw)))


def is_internal(url: Column | str, hosts: Iterable[str]) -> Column:
    return host(url).isin(*hosts)


def is_allowed(url: Column | str, hosts: Iterable[str]) -> Column:
    return (F.lower(_part(url, 1)) == "https") & host(url).isin(*hosts)


def _ends(url: Column | str, endings: Iterable[str]) -> Column:
    return F.lower(path(url)).rlike("(?:" + "|".join(map(re.escape, endings)) + r")\z")


def is_document(url: Column | str) -> Column:
    return _ends(url, DOCUMENT_ENDINGS)


def is_probably_html(url: Column | str) -> Column:
    return ~_ends(url, [*ASSET_ENDINGS, *DOCUMENT_ENDINGS])


def log_path(url: Column | str) -> Column:
    """The path alone: a query may carry session data."""
    return default(path(url), "/")


def page_slug(url: Column | str) -> Column:
    raw = F.regexp_replace(F.regexp_replace(blank(url), r"(?i)\Ahttps?://", ""), r"#.*\z", "")
    clean = F.regexp_replace(F.regexp_replace(raw, "[^a-zA-Z0-9._-]+", "_"), r"\A_+|_+\z", "")
    return F.concat_ws("_", F.substring(default(clean, "root"), 1, 120), F.substring(F.sha1(F.encode(blank(url), "UTF-8")), 1, 10))


def _any(text: Column, phrases: Iterable[str]) -> Column:
    return text.rlike("|".join(map(re.escape, phrases)))


def looks_like_login(url: Column | str, hosts: Iterable[str]) -> Column:
    """Identity providers, any host outside the allowed ones, and sign-in paths on those."""
    h, p = host(url), F.lower(path(url))
    hosts = list(hosts)
    if not hosts:
        return _any(h, LOGIN_HOSTS) | _any(F.concat(h, p), LOGIN_PATHS)
    return _any(h, LOGIN_HOSTS) | ~h.isin(*hosts) | _any(p, LOGIN_PATHS_ON_SITE)


def looks_like_sign_in_title(title: Column | str) -> Column:
    return _any(strip(F.lower(blank(title))), SIGN_IN_TITLES)


def looks_like_denied(status: Column, url: Column, title: Column, html: Column) -> Column:
    text = F.lower(F.concat_ws(" ", blank(url), blank(title), F.substring(blank(html), 1, 2000)))
    return F.coalesce(status.isin(401, 403), F.lit(False)) | _any(text, DENIED_PHRASES)


def allowed_hosts(raw: Column | str, start_url: Column | str) -> Column:
    """A comma list of hosts in lower case, or the start URL's host if it names none."""
    named = F.filter(F.transform(F.split(blank(raw), ","), lambda h: F.lower(strip(h))), lambda h: h != "")
    own = host(start_url)
    return F.when(F.size(named) > 0, named).when(own != "", F.array(own)).otherwise(F.array().cast("array<string>"))
