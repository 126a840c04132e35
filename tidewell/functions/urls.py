"""URL expressions for crawling and curation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: query parameters that only track, extensions that aren't pages, paths and names that are dropped
TRACKING = r"(?i)^(utm_|fbclid|gclid|sessionid)"
NOT_PAGES = "jpg jpeg png gif svg webp ico css js woff woff2 ttf eot mp4 mp3 zip rar doc docx xls xlsx ppt pptx".split()
HTML_DROP = (r"(?i)^/(staff\d*|staffs|people|taxonomy|node|user|university_news|news|news_letter|announcements|events|hot_events|hot-events|"
             r"slideshow(-entry)?|vacancy|vacancies)(/|$)")
PDF_DROP = ["/procuments/", "/procurement", "/vacancy/", "/vacancies/", "dpc-", "dpc_", "_dpc", "ifb", "bid", "tender", "supplier-registration", "staff_attendance", "agrahara", "research-allowance",
            "research_allowance", "insurance", "specification_of_dpc", "extention_of_bid", "document-dpc"]


def _part(url: Column, group: int) -> Column:
    """1: up to the host's end, 2: path, 3: query with its mark."""
    return F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)([^?#]*)(\?[^#]*)?", group)


def path(url: Column) -> Column:
    return _part(url, 2)


def normalize(url: Column) -> Column:
    """Without fragment, tracking parameters and trailing slashes; an empty path becomes ``/``."""
    clean_path = F.regexp_replace(path(url), "/+$", "")
    kept = F.filter(F.split(F.substring(_part(url, 3), 2, 2**31 - 1), "&"), lambda kv: (kv != "") & ~F.substring_index(kv, "=", 1).rlike(TRACKING))
    return F.concat(_part(url, 1), F.when(clean_path == "", F.lit("/")).otherwise(clean_path), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def domain(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))


def is_pdf(url: Column) -> Column:
    return F.endswith(F.lower(path(url)), F.lit(".pdf"))


def is_skipped(url: Column) -> Column:
    """Paginated listings."""
    return url.rlike("(?i)[?&]page=")


def is_page(url: Column) -> Column:
    extension = F.regexp_extract(F.lower(path(url)), r"\.([a-z0-9]+)$", 1)
    return ~extension.isin(NOT_PAGES)


def keeps_html(url_path: Column) -> Column:
    return ~F.when(F.coalesce(url_path, F.lit("")) == "", F.lit("/")).otherwise(url_path).rlike(HTML_DROP)


def keeps_pdf(rel_path: Column) -> Column:
    low, found = F.lower(rel_path), F.lit(False)
    for part in PDF_DROP:
        found = found | F.contains(low, F.lit(part))
    return ~found


def category(url_path: Column) -> Column:
    first = F.get(F.filter(F.split(F.coalesce(url_path, F.lit("")), "/"), lambda p: p != ""), F.lit(0))
    return F.coalesce(first, F.lit("general"))


def slug(url: Column) -> Column:
    return F.left(F.sha1(url.cast("binary")), F.lit(16))


def safe_segment(segment: Column) -> Column:
    """A file name part: other than letters, digits and ``-_.`` become ``_``, no ``._`` at the ends, 120 characters at most."""
    return F.left(F.regexp_replace(F.regexp_replace(segment, r"[^a-zA-Z0-9\-_.]", "_"), r"^[._]+|[._]+$", ""), F.lit(120))


def links(html: Column) -> Column:
    """Link targets of anchors, in order, without mail, phone, script and in-page ones."""
    found = F.regexp_extract_all(html, F.lit(r'(?i)<a\s[^>]*?href="([^"]*)"'), F.lit(1))
    return F.filter(found, lambda h: ~h.rlike("(?i)^(mailto:|tel:|javascript:|#)") & (h != ""))


def resolve(base: Column, href: Column) -> Column:
    """``href`` against ``base``: absolute, protocol-relative, root-relative or relative to the base's folder (dot segments stay)."""
    site, scheme = _part(base, 1), F.substring_index(base, ":", 1)
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    return F.when(href.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), href).when(F.startswith(href, F.lit("//")), F.concat(scheme, F.lit(":"), href)) \
        .when(F.startswith(href, F.lit("/")), F.concat(site, href)).otherwise(F.concat(site, F.when(folder == "", F.lit("/")).otherwise(folder), href))
