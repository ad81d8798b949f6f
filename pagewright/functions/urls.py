"""URL functions as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that track visitors.
TRACKING = sorted("_ga _gac affiliate_id clickid dclid ef_id fbclid gclid gclsrc igshid mc_cid mc_eid msclkid ref s_kwcid source via".split() + [f"utm_{x}" for x in "campaign content id medium reader source term".split()])
#: Endings of paths that hold no page.
FILES = sorted("7z avi bmp css csv eot flv gif gz ico jpeg jpg js json mov mp3 mp4 pdf png rar svg tar tiff ttf txt webm webp wmv woff woff2 xml zip".split())
ARTICLE_WORDS = sorted("p write writing learn news story stories entry entries".split() + [x + s for x in "article blog essay guide insight journal post publication thought tutorial".split() for s in ("", "s") if x + s != "journals"] + ["journal"])
_WHOLE = "archive archives feed login logout privacy register rss search signin signup terms"
EXCLUDED = "|".join([r"/(tags?|category|categories|cdn-cgi)/", rf"/({'|'.join(_WHOLE.split())})([?]|$|/)", "/(sitemap|__webpack)", "/_next/static/", "/wp-content/uploads/", "/page/[0-9]+"])

#: Paths of machinery, which lead to no article.
TECHNICAL = "|".join(["/_next/static/", "/__webpack", "/(cdn-cgi|wp-(admin|json|content/uploads))/", r"/xmlrpc[.]php", r"[.]amp([?]|$)"])

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"


def part(url: Column, number: int) -> Column:
    """1 scheme, 2 authority, 3 path, 4 query, as RFC 3986 cuts an address; '' where there is none."""
    return F.regexp_extract(F.regexp_replace(url, r"^[\x00-\x20]+|[\x00-\x20]+$", ""), _PARTS, number)


def domain(url: Column) -> Column:
    """The authority in lower case, with its port."""
    return F.lower(part(url, 2))


def _form(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.url_encode(text), "%7E", "~"), r"\*", "%2A")


def _decoded(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def normalize_url(url: Column) -> Column:
    """One spelling of an address.

    Scheme (https if none) and authority in lower case, without the scheme's
    own port; no fragment and no tracking parameters; the others sorted by
    name, values of one name in their order, encoded as forms are. Null stays null.
    """
    scheme = F.lower(part(url, 1))
    scheme = F.when(scheme == "", "https").otherwise(scheme)
    port = F.when(scheme == "http", ":80$").when(scheme == "https", ":443$").when(scheme == "ftp", ":21$").otherwise("$^")
    host = F.regexp_replace(domain(url), port, F.lit(""))
    pairs = F.filter(F.split(part(url, 4), "&"), lambda p: p != "")
    keyed = F.transform(pairs, lambda p, i: F.struct(_decoded(F.regexp_extract(p, "^([^=]*)", 1)).alias("k"), i.alias("i"), _decoded(F.regexp_extract(p, r"^[^=]*=([\s\S]*)$", 1)).alias("v")))
    kept = F.array_sort(F.filter(keyed, lambda x: ~F.lower(x["k"]).isin(TRACKING)))
    query = F.array_join(F.transform(kept, lambda x: F.concat(_form(x["k"]), F.lit("="), _form(x["v"]))), "&")
    path = part(url, 3)
    path = F.when((host != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    return F.concat(scheme, F.lit(":"), F.when(host != "", F.concat(F.lit("//"), host)).otherwise(""), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def slug(url: Column, most: int = 100) -> Column:
    """The path as a file name of at most ``most`` characters; the host for an empty path, else ``index``."""
    bare = F.regexp_replace(part(url, 3), "^/+|/+$", "")
    bare = F.when(bare == "", F.regexp_replace(part(url, 2), r"\.", "-")).otherwise(bare)
    dashes = F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, r"(?U)[^\w\-]", "-"), "-{2,}", "-"), "^-+|-+$", "")
    short = F.regexp_replace(F.substring(dashes, 1, most), "^-+|-+$", "")
    return F.when(short == "", "index").otherwise(short)


def is_file(url: Column) -> Column:
    """Whether the path ends like something that is no page."""
    return F.regexp_extract(F.lower(part(url, 3)), r"\.([^.]*)$", 1).isin(FILES)


def url_score(url: Column) -> Column:
    """How much an address looks like an article's; -30 for excluded paths, at once."""
    path = F.lower(part(url, 3))
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    n = F.size(segments)
    paged = F.exists(F.split(part(url, 4), "&"), lambda p: p.rlike("^page=."))
    points = (
        F.when(F.exists(segments, lambda s: s.isin(ARTICLE_WORDS)), 15).otherwise(0)
        + F.when(path.rlike("/[0-9]{4}/[0-9]{2}(/[0-9]{2})?"), 10).otherwise(0)
        + F.when(n >= 4, 5).when(n == 2, 3).when(n <= 1, -20).otherwise(0)
        - F.when(paged, 15).otherwise(0)
        - F.when(path.contains("/author/") & (n <= 2), 10).otherwise(0)
    )
    return F.when(path.rlike(EXCLUDED), -30).otherwise(points)


def crawlable(url: Column, domains: list[str], subdomains: bool = False, exclude: str | None = None) -> Column:
    """Whether a crawl may follow an address: a web page of the given domains that isn't excluded."""
    host = domain(url)
    inside = host.isin([d.lower() for d in domains])
    if subdomains:
        for d in domains:
            inside = inside | host.endswith("." + d.lower())
    fine = F.lower(part(url, 1)).isin("http", "https") & inside & ~is_file(url) & ~F.lower(part(url, 3)).rlike(TECHNICAL)
    return fine & ~url.rlike(exclude) if exclude else fine
