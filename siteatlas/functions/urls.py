"""URL expressions.

URLs are taken apart with one anchored pattern instead of ``parse_url``, which
returns NULL for raw spaces and non-ASCII text that browsers accept.  Text is
kept raw; only query parameters are decoded and re-encoded, as a browser does.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column
from pyspark.sql import functions as F

from siteatlas.functions.bind import let, let_all
from siteatlas.functions.literals import alternatives, contains_any

# ---- fixed values -----------------------------------------------------------
TRACKING_PARAMS = [
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
    "fbclid", "gclid", "gclsrc", "dclid", "gbraid", "wbraid",
    "msclkid", "twclid", "li_fat_id",
    "_ga", "_gl", "_hsenc", "_hsmi",
    "mc_cid", "mc_eid",
    "oly_anon_id", "oly_enc_id",
    "vero_id", "rb_clickid",
    "ref", "source", "spm", "pvid",
    "__hstc", "__hssc", "__hsfp",
    "trk", "trkCampaign", "trkInfo",
    "sc_campaign", "sc_channel", "sc_content", "sc_country", "sc_geo", "sc_outcome",
]
SESSION_PARAMS = [
    "sid", "session_id", "sessionid", "PHPSESSID", "jsessionid",
    "token", "auth", "nonce", "timestamp", "ts", "_t", "cb",
    "_dc", "_", "nocache", "rand", "random",
]
PAGINATION_PARAMS = ["page", "p", "pg", "offset", "start", "skip", "from", "cursor"]
REDIRECT_PARAMS = ["redirect", "return", "next", "continue", "goto", "url", "target",
                   "dest", "destination"]
REDIRECT_PATHS = ["/redirect", "/goto", "/bounce"]
DOWNLOAD_EXTENSIONS = [
    "pdf", "zip", "tar", "gz", "exe", "dmg", "pkg", "deb", "rpm", "iso", "img", "mp3", "mp4",
    "avi", "mkv", "mov", "wav", "jpg", "jpeg", "png", "gif", "svg", "ico", "css", "js",
    "woff", "woff2", "ttf", "eot",
]
LOGIN_PATHS = [
    "/login", "/signin", "/sign-in", "/sign_in",
    "/auth", "/authenticate", "/sso",
    "/account/login", "/user/login", "/users/sign_in",
    "/session/new", "/sessions/new",
]
LOGIN_HOSTS = ["accounts.google.com", "login.microsoftonline.com", "auth0.com/login",
               "login.okta.com"]
TRACKER_HOSTS = [
    "google-analytics.com", "googletagmanager.com", "facebook.net", "facebook.com/tr",
    "doubleclick.net", "googlesyndication.com", "hotjar.com", "mixpanel.com", "segment.com",
    "amplitude.com", "heapanalytics.com", "intercom.io", "crisp.chat", "tawk.to", "drift.com",
    "optimizely.com", "fullstory.com", "mouseflow.com", "clarity.ms", "sentry.io",
    "bugsnag.com", "logrocket.com",
]
FONT_EXTENSIONS = [".woff", ".woff2", ".ttf", ".eot", ".otf"]
MEDIA_EXTENSIONS = [".mp4", ".webm", ".ogg", ".avi", ".mov", ".mp3", ".wav", ".flac", ".aac",
                    ".gif"]
UNSAFE_SCHEMES = ["javascript:", "data:", "vbscript:"]
# -----------------------------------------------------------------------------

HTTP_URL = r"(?is)^\s*(https?)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
ANY_SCHEME = r"(?is)^\s*([a-z][a-z0-9+.\-]*):"


def _piece(url: Column, group: int) -> Column:
    return F.regexp_extract(url, HTTP_URL, group)


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, ANY_SCHEME, 1))


def authority(url: Column) -> Column:
    """host[:port], lower case, without user info and default ports."""
    raw = F.lower(F.regexp_replace(_piece(url, 2), r"^.*@", ""))
    no_http = F.regexp_replace(raw, r":80$", "")
    no_https = F.regexp_replace(raw, r":443$", "")
    return F.when(scheme(url) == "http", no_http).otherwise(no_https)


def hostname(url: Column) -> Column:
    return F.regexp_replace(authority(url), r":\d*$", "")


def is_http(url: Column) -> Column:
    return _piece(url, 2) != ""


def is_valid(url: Column) -> Column:
    """Parses as an absolute URL of any scheme."""
    return is_http(url) | ((scheme(url) != "") & ~scheme(url).isin("http", "https"))


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def path(url: Column) -> Column:
    raw = _piece(url, 3)
    return F.when(raw == "", F.lit("/")).otherwise(raw)


def query(url: Column) -> Column:
    """Query text without the question mark; empty when there is none."""
    return F.regexp_replace(_piece(url, 4), r"^\?", "")


def search(url: Column) -> Column:
    """Query text with its question mark; empty when the query is empty."""
    q = query(url)
    return F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q))


def _decode(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def query_params(url: Column) -> Column:
    """Decoded parameters in order of appearance, as array<struct<k,v>>."""
    pairs = F.filter(F.split(query(url), "&"), lambda p: p != "")
    return F.transform(pairs, lambda p: F.struct(
        _decode(F.regexp_extract(p, r"(?s)^([^=]*)", 1)).alias("k"),
        _decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v")))


def kept_params(url: Column, strip_mixed_case: bool = False) -> Column:
    """Parameters that are neither tracking nor session-like.

    Keys are lower-cased before the lookup while three fixed names hold capitals;
    those three never match unless ``strip_mixed_case`` is set.
    """
    names = TRACKING_PARAMS + SESSION_PARAMS
    if strip_mixed_case:
        names = [n.lower() for n in names]
    return F.filter(query_params(url), lambda p: ~F.lower(p.k).isin(names))


def normalize(url: Column, strip_mixed_case: bool = False) -> Column:
    """Same page, same text: no fragment, no tracking, sorted parameters."""
    def clean_query() -> Column:
        ordered = F.array_sort(F.transform(
            kept_params(url, strip_mixed_case),
            lambda p: F.struct(F.concat(p.k, F.lit(","), p.v).alias("order"), p.k.alias("k"), p.v.alias("v"))))
        return F.array_join(F.transform(
            ordered, lambda p: F.concat(F.url_encode(p.k), F.lit("="), F.url_encode(p.v))), "&")

    def without_query(where: Column) -> Column:
        return F.when(where == "/", where).otherwise(F.regexp_replace(where, r"/$", ""))

    where = path(url)
    # Parameters are taken apart once, and only where there are any.
    rest = F.when(F.contains(url, F.lit("?")), let(clean_query(), lambda text: F.when(
        text == "", without_query(where)).otherwise(F.concat(where, F.lit("?"), text)))).otherwise(without_query(where))
    return F.when(is_http(url), F.concat(origin(url), rest)).otherwise(url)


def hash_input(url: Column) -> Column:
    text = F.lower(url)
    for pattern in (r"^https?://", r"^www\.", r"#.*$", r"/$"):
        text = F.regexp_replace(text, pattern, "")
    return text


def url_hash(url: Column) -> Column:
    return F.substring(F.sha2(hash_input(url), 256), 1, 16)


def pattern(url: Column) -> Column:
    """Template of a URL: identifiers replaced by placeholders, query sorted."""
    where = F.regexp_replace(path(url), r"/\d+", "/:id")
    where = F.regexp_replace(
        where, r"(?i)/[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}", "/:uuid")
    where = F.regexp_replace(where, r"(?i)/[a-f0-9]{32,}", "/:hash")
    where = F.regexp_replace(where, r":\d+", "/:num")

    def shape(p: Column) -> Column:
        value = (F.when(p.v.rlike(r"^\d+$"), F.lit(":num"))
                 .when(F.length(p.v) > 50, F.lit(":token")).otherwise(p.v))
        return F.concat(p.k, F.lit("="), value)

    text = F.array_join(F.array_sort(F.transform(query_params(url), shape)), "&")
    tail = F.when(F.contains(url, F.lit("?")), let(text, lambda q: F.when(q == "", q).otherwise(
        F.concat(F.lit("?"), q)))).otherwise(F.lit(""))
    return F.when(is_http(url), F.concat(origin(url), where, tail))


def segments(url: Column) -> Column:
    return F.filter(F.split(path(url), "/"), lambda s: s != "")


def section(url: Column) -> Column:
    """Origin and first path segment."""
    first = F.coalesce(F.try_element_at(segments(url), F.lit(1)), F.lit(""))
    return F.when(is_http(url), F.concat(origin(url), F.lit("/"), first)).otherwise(url)


def is_pagination(url: Column) -> Column:
    where = F.lower(path(url))
    asked = F.lower(search(url))
    names = "|".join(PAGINATION_PARAMS)
    return is_http(url) & (where.rlike(r"/page/\d+") | where.rlike(r"/p/\d+")
                           | asked.rlike(rf"[?&]({names})=\d+"))


def page_pattern(url: Column) -> Column:
    return F.regexp_replace(url, r"\d+", ":n")


def is_redirector(url: Column) -> Column:
    names = "|".join(REDIRECT_PARAMS)
    return is_http(url) & (F.lower(search(url)).rlike(rf"[?&]({names})=")
                           | contains_any(F.lower(path(url)), REDIRECT_PATHS))


def depth(url: Column) -> Column:
    return F.when(is_http(url), F.size(segments(url))).otherwise(F.lit(-1))


def relative_depth(url: Column, base: str) -> Column:
    return F.when(is_http(url), F.size(segments(url)) - F.size(segments(F.lit(base)))).otherwise(F.lit(-1))


@dataclass(frozen=True)
class Scope:
    """Which URLs a crawl may visit."""

    base_url: str
    strategy: str = "same_domain"  # depth_only | same_domain | full
    max_depth: int | None = None
    include: tuple[str, ...] = field(default_factory=tuple)
    exclude: tuple[str, ...] = field(default_factory=tuple)


def _is_pattern(text: str) -> bool:
    """Whether the engine that runs ``rlike`` takes a pattern."""
    try:
        SparkContext._active_spark_context._jvm.java.util.regex.Pattern.compile(text)
    except IllegalArgumentException:
        return False
    return True


def matches_any(url: Column, patterns: tuple[str, ...]) -> Column:
    """OR over patterns: ``/re/`` is a regular expression, the rest, and invalid ones, are substrings."""
    literals, expressions = [], []
    for text in patterns:
        body = text[1:-1] if text.startswith("/") and text.endswith("/") else None
        if body is None or not _is_pattern(body):
            literals.append(text)
        else:
            expressions.append(body)
    found = contains_any(url, literals) if literals else F.lit(False)
    for body in alternatives(expressions):
        found = found | (url.rlike(body) if body else F.lit(True))
    return found


def _plain_path(url: Column) -> Column:
    where = path(url)
    return F.when(where == "/", where).otherwise(F.regexp_replace(where, r"/$", ""))


def scope_reason(url: Column, scope: Scope) -> Column:
    """Why a URL is out of scope; NULL when it is allowed."""
    base = F.lit(scope.base_url)
    same = origin(url) == origin(base)
    where, root = _plain_path(url), _plain_path(base)
    extra = F.size(segments(url)) - F.size(segments(base))
    deeper = F.startswith(where, root) & ((where == root) | (extra > 0))
    if scope.max_depth is not None:
        deeper = deeper & ((where == root) | (extra <= scope.max_depth))
    reason = (F.when(~is_valid(url), F.lit("invalid URL format"))
              .when(~is_http(url), F.lit("not HTTP/HTTPS protocol")))
    if scope.exclude:
        reason = reason.when(matches_any(url, scope.exclude), F.lit("matches exclude pattern"))
    if scope.include:
        reason = reason.when(~matches_any(url, scope.include), F.lit("does not match include pattern"))
    if scope.strategy == "depth_only":
        return (reason.when(~same, F.lit("different domain"))
                .when(~deeper, F.lit("not deeper than base path")))
    if scope.strategy == "same_domain":
        return reason.when(~same, F.lit("different domain (origin)"))
    if scope.strategy == "full":
        return reason
    return reason.otherwise(F.lit("unknown strategy"))


def in_scope(url: Column, scope: Scope) -> Column:
    """struct<allowed boolean, reason string>."""
    why = scope_reason(url, scope)
    return F.struct(why.isNull().alias("allowed"), why.alias("reason"))


def hierarchy_line(url: Column, scope: Scope) -> Column:
    """One indented line per URL with a mark for allowed or not."""
    indent = F.repeat(F.lit("  "), F.greatest(relative_depth(url, scope.base_url), F.lit(0)))
    mark = F.when(scope_reason(url, scope).isNull(), F.lit("✓")).otherwise(F.lit("✗"))
    shown = F.when(is_http(url), F.concat(path(url), search(url))).otherwise(url)
    return F.concat(indent, mark, F.lit(" "), shown)


def _no_dots(where: Column) -> Column:
    """Collapse ``.`` and ``..`` segments of an absolute path."""
    return F.when(where.rlike(r"/\.{1,2}(/|$)"), let(where, _fold_dots)).otherwise(where)


def _fold_dots(where: Column) -> Column:
    parts = F.split(F.regexp_replace(where, r"^/", ""), "/")
    folded = F.aggregate(
        parts, F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc).otherwise(F.concat(acc, F.array(s))))
    closing = F.when(where.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    joined = F.concat(F.lit("/"), F.array_join(folded, "/"))
    return F.when(joined == "/", joined).otherwise(F.concat(joined, closing))


def base_of(url: Column) -> Column:
    """The parts of a page URL that links are resolved against."""
    return F.struct(is_http(url).alias("http"), scheme(url).alias("scheme"), origin(url).alias("origin"),
                    path(url).alias("path"), search(url).alias("search"))


def resolve_on(href: Column, base: Column) -> Column:
    """Absolute form of ``href`` against a ``base_of`` struct; NULL if it has none."""
    def found(p: Column) -> Column:
        link = p["link"]
        tail = F.regexp_extract(link, r"(?s)([?#].*)$", 1)
        local = F.regexp_extract(link, r"(?s)^([^?#]*)", 1)
        folder = F.regexp_replace(base["path"], r"[^/]*$", "")
        absolute = F.concat(p["scheme"], F.lit("://"), F.regexp_replace(_piece(link, 2), r"^.*@", ""),
                            _no_dots(path(link)), _piece(link, 4), _piece(link, 5))
        ladder = (F.when(p["http"], absolute)
                  .when(link.rlike("^//[^/?#]"), F.concat(base["scheme"], F.lit(":"), link))
                  .when(p["scheme"] != "", F.when(~p["scheme"].isin("http", "https"), link))
                  .when(F.startswith(link, F.lit("/")), F.concat(base["origin"], _no_dots(local), tail))
                  .when(F.startswith(link, F.lit("?")), F.concat(base["origin"], base["path"], link))
                  .when(link.rlike("^(#|$)"), F.concat(base["origin"], base["path"], base["search"], link))
                  .otherwise(F.concat(base["origin"], _no_dots(F.concat(folder, local)), tail)))
        return F.when(base["http"], ladder).when(p["http"], absolute)

    link = F.regexp_replace(href, r"^\s+|\s+$", "")
    return let(link, lambda x: let_all({"link": x, "scheme": scheme(x), "http": is_http(x)}, found))


def resolve(href: Column, url: Column) -> Column:
    """Absolute form of ``href`` seen on page ``url``; NULL if it has none."""
    return let(base_of(url), lambda base: resolve_on(href, base))


def same_origin(href: Column, base: Column) -> Column:
    internal = let(resolve(href, base), lambda target: is_http(target) & (origin(target) == origin(base)))
    return F.coalesce(internal, F.lit(False))


def is_download(url: Column) -> Column:
    return url.rlike(r"(?i)\.(" + "|".join(DOWNLOAD_EXTENSIONS) + ")$")


def is_cross_domain(start: Column, final: Column) -> Column:
    return is_http(start) & is_http(final) & (hostname(start) != hostname(final))


def is_login(url: Column, with_hosts: bool = False, known: tuple[str, ...] = ()) -> Column:
    parts = LOGIN_PATHS + (LOGIN_HOSTS if with_hosts else []) + [k.lower() for k in known]
    return contains_any(F.lower(url), parts)


def resource_class(url: Column) -> Column:
    """font, media, tracker or page."""
    low = F.lower(url)
    return (F.when(contains_any(low, FONT_EXTENSIONS), F.lit("font"))
            .when(contains_any(low, MEDIA_EXTENSIONS), F.lit("media"))
            .when(contains_any(url, TRACKER_HOSTS), F.lit("tracker"))
            .otherwise(F.lit("page")))


def sanitize(url: Column) -> Column:
    clean = F.regexp_replace(url, r"^\s+|\s+$", "")
    href = F.concat(origin(clean), path(clean), _piece(clean, 4), _piece(clean, 5))
    return F.when(is_http(clean) & ~contains_any(F.lower(clean), UNSAFE_SCHEMES), href)
