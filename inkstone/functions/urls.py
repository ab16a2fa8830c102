"""URL functions and predicates as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rules for article and image addresses.
EXCLUDED_PATHS = ("/category/", "/author/", "/tag/", "/search", "/epaper/", "/videos/", "/photos/")
BLOCKED_DOMAINS = (
    "pinterest.", "pinimg.", "pngtree.", "stock.adobe.", "shutterstock.", "istockphoto.", "gettyimages.", "alamy.", "dreamstime.", "freepik.", "depositphotos.", "vecteezy.", "canva.", "unsplash.",
    "pexels.", "pixabay.", "wallpaper.", "clipart.", "mapnations.", "tourmyodisha.", "sandpebblestours.", "assamtourism.", "incredible-northeastindia.",
)
HIGH_DOMAINS = (
    "assamtribune.com", "pib.gov.in", "mea.gov.in", "mod.gov.in", "mha.gov.in", "indianarmy.nic.in", "airnewsalerts.com", "thehindu.com", "indianexpress.com", "hindustantimes.com",
    "timesofindia.indiatimes.com", "telegraphindia.com", "theprint.in", "deccanherald.com", "news18.com", "ndtv.com",
)
MEDIUM_DOMAINS = ("eastmojo.com", "nenow.in", "northeasttoday.in", "sentinelassam.com", "pratidintime.com", "assamlive.com", "guwahatiplus.com")
# Domains of image sources by quality.
BEST_SOURCES = (
    "pib.gov.in", "mod.gov.in", "assam.gov.in", "mizoram.gov.in", "manipur.gov.in", "nagaland.gov.in", "meghalaya.gov.in", "tripura.gov.in", "arunachalpradesh.gov.in", "sikkim.gov.in",
    "assamtribune.com", "thehindu.com", "indianexpress.com", "hindustantimes.com", "telegraphindia.com", "timesofindia.indiatimes.com", "ndtv.com", "indiatoday.in", "deccanherald.com", "theprint.in",
)
GOOD_SOURCES = ("news18.com", "eastmojo.com", "northeasttoday.in", "nenow.in", "sentinelassam.com", "pratidintime.com", "assamlive.com", "guwahatiplus.com")
POOR_SOURCES = ("tour", "tourism", "travel", "map", "maps", "blogspot", "wordpress", "pinterest", "stock", "wallpaper", "clipart")
UI_TERMS = (
    "logo", "icon", "favicon", "search", "clear", "close", "menu", "arrow", "facebook", "twitter", "instagram", "youtube", "linkedin", "whatsapp", "share", "print", "placeholder",
    "authorplaceholder", "avatar", "profile", "default", "loading", "loader", "spinner", "banner-ad", "advertisement", "advert", "cookie",
)
BLOCKED_PATHS = ("/images/logo.svg", "/images/search.png", "/images/clear-button-white.png", "/images/placeholder.jpg", "/images/authorplaceholder.jpg")
BLOCKED_PATH_TERMS = ("/icons/", "/icon/", "/favicon/", "/avatars/", "/avatar/", "/profile/", "/profiles/", "/static/icons/", "/static/icon/", "/assets/icons/", "/assets/icon/")
UPLOAD_PATHS = ("/h-upload/", "/uploads/", "/upload/", "/images/", "/image/", "/media/", "/wp-content/uploads/", "/wp-content/")
SIZE_KEYS = ("width", "height", "w", "h", "resize", "format", "quality", "q", "fm")
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HOST, 1))


def domain(url: Column) -> Column:
    """Host without www."""
    return F.regexp_replace(host(url), r"^www\.", "")


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def same_domain(a: Column, b: Column) -> Column:
    """Equal domains, or one a subdomain of the other."""
    a, b = domain(a), domain(b)
    return (a != "") & (b != "") & ((a == b) | a.endswith(F.concat(F.lit("."), b)) | b.endswith(F.concat(F.lit("."), a)))


def is_article(url: Column) -> Column:
    p = F.lower(path(url))
    bad = (p == "") | (p == "/")
    bad = bad | p.rlike(_one_of(EXCLUDED_PATHS, "^"))
    return ~bad & (F.size(F.split(F.trim(p, F.lit("/")), "/")) >= 2)


def clean_image(url: Column) -> Column:
    u = F.trim(F.coalesce(url, F.lit("")))
    u = F.when(u.startswith("//"), F.concat(F.lit("https:"), u)).otherwise(u)
    return F.regexp_replace(u, "#.*$", "")


def image_extension(url: Column) -> Column:
    return F.regexp_extract(F.lower(path(url)), r"(\.(?:jpg|jpeg|png|webp|bmp|tiff|tif|gif|svg|ico))$", 1)


def image_identity(url: Column) -> Column:
    """Host, path without extension, and sorted query without sizes: one key for all renditions."""
    u = clean_image(url)
    p = F.regexp_replace(F.regexp_replace(F.lower(path(u)), r"\.(jpg|jpeg|png|webp|bmp|tiff|tif)$", ""), r"[-_](jpg|jpeg|png|webp)$", "")
    pairs = F.filter(F.split(query(u), "&"), lambda x: x.contains("=") & ~F.lower(F.substring_index(x, "=", 1)).isin(*SIZE_KEYS))
    named = F.array_sort(F.transform(pairs, lambda x: F.concat(F.lower(F.substring_index(x, "=", 1)), F.regexp_extract(x, "(=.*)$", 1))))
    return F.concat(host(u), p, F.when(F.size(named) > 0, F.concat(F.lit("?"), F.array_join(named, "&"))).otherwise(""))


def _one_of(parts: tuple[str, ...], before: str = "") -> str:
    """A pattern that finds any of the parts: one expression instead of a chain."""
    return before + "(?:" + "|".join(p.replace(".", r"\.") for p in parts) + ")"


def is_blocked(url: Column) -> Column:
    d = domain(url)
    return (d == "") | d.rlike(_one_of(BLOCKED_DOMAINS))


def source_priority(url: Column) -> Column:
    d = domain(url)
    return F.when(is_blocked(url), 0).when(d.isin(*HIGH_DOMAINS), 3).when(d.isin(*MEDIUM_DOMAINS), 2).otherwise(1)


def is_image(url: Column) -> Column:
    """Whether an address looks like an editorial image and no page furniture."""
    u = clean_image(url)
    p, ext = F.lower(path(u)), image_extension(u)
    name = F.regexp_replace(F.regexp_replace(F.substring_index(p, "/", -1), r"\.(jpg|jpeg|png|webp|bmp|tiff|tif|gif|svg|ico)$", ""), "[^a-z0-9]+", "")
    bad = ~F.lower(u).rlike("^https?://") | is_blocked(u) | p.isin(*BLOCKED_PATHS) | ext.isin(".svg", ".ico", ".gif")
    bad = bad | name.rlike(_one_of(tuple(t.replace("-", "") for t in UI_TERMS))) | p.rlike(_one_of(BLOCKED_PATH_TERMS))
    upload = p.rlike(_one_of(UPLOAD_PATHS, "^"))
    return ~bad & ((ext != "") | upload)


def asset_path(c: Column) -> Column:
    """Paths below data/ as seen from a document beside it; others as they are."""
    return F.when(c.startswith("data/"), F.concat(F.lit("../"), F.substr(c, F.lit(6)))).otherwise(c)


def source_quality_score(domain: Column) -> Column:
    """0.1 to 1 by a source's domain; those without one get 0.3."""
    d = F.regexp_replace(F.trim(F.lower(F.coalesce(domain, F.lit("")))), r"^www\.", "")
    return F.when(d == "", 0.30).when(d.isin(*BEST_SOURCES), 1.00).when(d.isin(*GOOD_SOURCES), 0.75).when(d.rlike(_one_of(POOR_SOURCES)), 0.10).otherwise(0.50)


def relative_path(c: Column, base: str) -> Column:
    """An absolute path below base as seen from base; others as they are."""
    head = base.rstrip("/") + "/"
    return F.when(c.startswith(head), F.substr(c, F.lit(len(head) + 1))).otherwise(c)
