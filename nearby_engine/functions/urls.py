"""URL parts, normalisation, resolution and policies as column expressions.

Parts are taken with the generic-syntax expression of RFC 3986, because strict URL
parsers give null for links that browsers and crawlers accept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nearby_engine.functions.addresses import is_public_v4, is_public_v6, v4_number
from nearby_engine.functions.text import let, strip

GENERIC = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# Host of a URL: text in brackets, or up to port, path, query or fragment.
HOST = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(?:\[([^\]/?#]*)\]|([^:/?#\[\s]*))"

# Path or query words that make a link irrelevant or unsafe to follow.
REJECT_TOKENS = [
    "logout", "signout", "login", "signin",
    "auth", "sso", "account", "profile", "user",
    "dashboard", "cart", "checkout", "basket", "order",
    "shop", "buy", "form", "forms", "submit", "admin",
]

# Path words of the pages that describe a company.
ALLOWED_PATH_TOKENS = [
    "about", "company", "team", "story",
    "contact", "reach",
    "location", "locations", "office", "offices", "branch", "branches",
    "career", "careers", "job", "jobs", "opening", "openings",
    "sitemap",
]

# Paths that count as the homepage.
HOME_PATHS = ["", "/", "/index.html", "/index.htm", "/index.php"]

# Hosts of the two supported job boards and the tokens' format.
GREENHOUSE_HOSTS = ["boards.greenhouse.io", "job-boards.greenhouse.io"]
GREENHOUSE_SKIPPED_PARTS = ["embed", "job_board", "jobs"]
LEVER_HOST = "jobs.lever.co"
TOKEN_FORMAT = r"^[a-zA-Z0-9_\-]+$"

TOKEN_GAP = r"[\s/._?=&~-]+"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, GENERIC, 1))


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, GENERIC, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, GENERIC, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, GENERIC, 4)


def host(url: Column) -> Column:
    """Lower-case host without credentials, port and brackets; empty when there is none."""
    return F.lower(F.concat(F.regexp_extract(url, HOST, 1), F.regexp_extract(url, HOST, 2)))


def port(url: Column) -> Column:
    return F.regexp_extract(netloc(url), r":(\d+)$", 1).try_cast("int")


def bare_domain(url: Column) -> Column:
    """Host without a leading ``www.``; null when the URL has no host."""
    value = F.regexp_replace(host(url), r"^www\.", "")
    return F.when(value != "", value)


def clean_domain(domain: Column) -> Column:
    value = F.regexp_replace(F.lower(strip(domain)), r"^www\.", "")
    return F.when(value != "", value)


def normalized_url(url: Column) -> Column:
    """Lower-case host, default port and fragment dropped, empty path becomes ``/``."""

    def build(value: Column) -> Column:
        name, protocol = host(value), scheme(value)
        shown = F.when(netloc(value).contains("["), F.concat(F.lit("["), name, F.lit("]"))).otherwise(name)
        default = F.when(protocol == "http", 80).otherwise(443)
        number = port(value)
        plain = number.isNull() | (number == 0) | (number == default)
        suffix = F.when(plain, "").otherwise(F.concat(F.lit(":"), number.cast("string")))
        asked = F.regexp_extract(value, r"(?s)^[^?#]*(\?[^#]+)", 1)
        body = F.when(path(value) == "", "/").otherwise(path(value))
        return F.concat(protocol, F.lit("://"), shown, suffix, body, asked)

    return let(strip(url), build)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"(?s)#.*$", "")


def _without_dots(full_path: Column) -> Column:
    """Resolve ``.`` and ``..`` segments of an absolute path."""

    def walk(given: Column) -> Column:
        kept = F.aggregate(
            F.split(F.regexp_replace(given, "^/", ""), "/"),
            F.array().cast("array<string>"),
            lambda stack, part: F.when(part == ".", stack)
            .when(part == "..", F.slice(stack, F.lit(1), F.greatest(F.size(stack) - 1, F.lit(0))))
            .otherwise(F.array_append(stack, part)),
        )
        joined = F.concat(F.lit("/"), F.array_join(kept, "/"))
        # A path that ends in a dot segment ends in a slash.
        open_end = F.when(given.rlike(r"/\.{1,2}$"), "/").otherwise("")
        return F.regexp_replace(F.concat(joined, open_end), "//$", "/")

    return F.when(full_path.rlike(r"/\.{1,2}(/|$)"), let(full_path, walk)).otherwise(full_path)


def resolve(reference: Column, base: Column) -> Column:
    """A link resolved on the page it was found on (RFC 3986, section 5.2)."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_extract(base, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*/|/)", 1)
    folder = F.when(folder == "", F.lit("/")).otherwise(folder)
    ref_path = F.regexp_extract(reference, r"^([^?#]*)", 1)
    tail = F.regexp_extract(reference, r"(?s)^[^?#]*(.*)$", 1)
    # Empty steps vanish when a relative path is merged with its page's folder.
    merged = F.regexp_replace(F.concat(folder, ref_path), "/{2,}", "/")
    return (
        F.when(reference.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), reference)
        .when(reference == "", base)
        .when(reference.startswith("//"), F.concat(F.regexp_extract(base, GENERIC, 1), F.lit(":"), reference))
        .when(reference.startswith("/"), F.concat(origin, _without_dots(ref_path), tail))
        .when(reference.startswith("?"), F.concat(F.regexp_extract(base, r"^([^?#]*)", 1), tail))
        .when(reference.startswith("#"), F.concat(without_fragment(base), tail))
        .otherwise(F.concat(origin, _without_dots(merged), tail))
    )


def resolve_or_base(raw: Column, base: Column) -> Column:
    """Resolved link; a missing or blank one gives the page itself, null without a page."""
    link = F.coalesce(strip(raw), F.lit(""))
    page = F.coalesce(base, F.lit(""))
    return (
        F.when((link == "") & (page == ""), F.lit(None).cast("string"))
        .when(link == "", page)
        .when(page == "", link)
        .otherwise(resolve(link, page))
    )


def _tokens(text: Column) -> Column:
    return F.split(text, TOKEN_GAP)


def _words(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def is_rejected(url: Column) -> Column:
    """Not http(s), or one of the rejected words in path or query."""
    value = strip(url)
    words = _tokens(F.lower(F.concat(path(value), F.lit("?"), query(value))))
    return F.coalesce(
        ~scheme(value).isin("http", "https") | F.arrays_overlap(words, _words(REJECT_TOKENS)), F.lit(True)
    )


def _is_relevant(value: Column) -> Column:
    """The homepage or a page that describes the company."""
    place = strip(path(value))
    return place.isin(HOME_PATHS) | F.arrays_overlap(_tokens(F.lower(place)), _words(ALLOWED_PATH_TOKENS))


def allowing_site(url: Column) -> Column:
    """The site that allows a URL by :func:`is_allowed_on_site`; null when none does. Links are judged once, whoever follows them."""
    value = strip(url)
    return F.when(_is_relevant(value) & ~is_rejected(url), bare_domain(value))


def is_allowed_on_site(url: Column, domain: Column) -> Column:
    """Same site, not rejected, and the homepage or a page that describes the company."""
    value = strip(url)
    same = bare_domain(value) == clean_domain(domain)
    return ~is_rejected(url) & F.coalesce(same & _is_relevant(value), F.lit(False))


def greenhouse_token(url: Column) -> Column:
    value = strip(url)
    asked = strip(F.regexp_extract(F.concat(F.lit("&"), query(value)), r"&for=([^&]+)", 1))
    asked = F.coalesce(F.try_url_decode(F.replace(asked, F.lit("+"), F.lit(" "))), asked)
    parts = F.filter(F.split(path(value), "/"), lambda p: (p != "") & ~p.isin(GREENHOUSE_SKIPPED_PARTS))
    first = strip(F.get(parts, F.lit(0)))
    return F.when(
        host(value).isin(GREENHOUSE_HOSTS),
        F.when(asked.rlike(TOKEN_FORMAT), asked).when(first.rlike(TOKEN_FORMAT), first),
    )


def lever_token(url: Column) -> Column:
    value = strip(url)
    parts = F.filter(F.split(path(value), "/"), lambda p: p != "")
    first = strip(F.get(parts, F.lit(0)))
    return F.when((host(value) == LEVER_HOST) & first.rlike(TOKEN_FORMAT), first)


def is_public_host(name: Column) -> Column:
    """A host that is not empty, not localhost, and no address literal outside the public range."""
    numbered = let(v4_number(name), lambda n: F.when(n.isNotNull(), is_public_v4(n)).otherwise(~name.rlike(r"(^|\.)localhost$")))
    return F.when(name == "", F.lit(False)).when(name.contains(":"), is_public_v6(name)).otherwise(numbered)


def is_public_url(url: Column) -> Column:
    """http(s), no credentials, and a public host.

    Names are not resolved. Addresses in any notation are judged by number; the host is read once.
    """
    plain = url.rlike(r"(?i)^\s*https?://") & ~url.rlike(r"^\s*[^:/?#]+://[^/?#]*@")
    return F.coalesce(plain & let(host(url), is_public_host), F.lit(False))


def fill_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{name}`` by the value's text for every given name."""
    for name, value in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), value.cast("string"))
    return template
