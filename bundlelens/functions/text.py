"""Column functions over names, paths, versions, HTML and plain text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITIES = ("critical", "warning", "info")
PRODUCTS = ("longhorn", "harvester")
ARCHIVE = r"(?i)\.(zip|tar|tgz|tar\.gz|txz|tar\.xz|tbz2?|tar\.bz2|tzst|tar\.zst)$"
#: Words that are no search tokens.
STOP_WORDS = "a an and are as at be by for from has have in is it of on or that the this to was were when with you your".split()
#: Named character references.
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " ", "rsquo": "'", "lsquo": "'", "rdquo": '"', "ldquo": '"', "ndash": "-", "mdash": "-"}


def blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def severity_rank(severity: Column) -> Column:
    """0 for critical, 1 for warning, 2 for all else."""
    return F.when(severity == "critical", 0).when(severity == "warning", 1).otherwise(2)


def severity_of(rank: Column) -> Column:
    return F.when(rank == 0, "critical").when(rank == 1, "warning").otherwise("info")


def slug(value: Column, most: int = 80) -> Column:
    s = F.regexp_replace(F.lower(F.coalesce(value.cast("string"), F.lit("unknown"))), "[^a-z0-9]+", "-")
    return F.substring(F.trim(s, F.lit("-")), 1, most)


def truncate(value: Column, most: int) -> Column:
    """A longer text becomes its first most - 1 characters and three dots."""
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most - 1), F.lit("..."))).otherwise(value)


def display_name(namespace: Column, name: Column) -> Column:
    return F.concat_ws("/", blank_to_null(namespace), name)


def namespace_of(namespace: Column, path: Column) -> Column:
    return F.coalesce(blank_to_null(namespace), blank_to_null(F.regexp_extract(path, "/yamls/namespaced/([^/]+)/", 1)), F.lit("default"))


def short_path(path: Column, marker: str) -> Column:
    """The path from the marker on, without its leading slash."""
    at = F.locate(marker, path)
    return F.when(at > 0, F.substring(path, at + 1, F.length(path))).otherwise(path)


def safe_filename(name: Column) -> Column:
    base = F.element_at(F.split(name, r"[/\\]"), -1)
    return F.regexp_replace(F.regexp_replace(base, "[^A-Za-z0-9._-]", "_"), "_+", "_")


def archive_type(path: Column) -> Column:
    return F.when(F.lower(path).rlike(r"\.zip$"), "zip").when(path.rlike(ARCHIVE), "tar")


def unsafe_entry(path: Column) -> Column:
    p = F.regexp_replace(path, r"\\", "/")
    parts = F.split(p, "/")
    return path.isNull() | (path == "") | path.contains("\0") | p.startswith("/") | p.rlike("^[A-Za-z]:") | F.array_contains(parts, "..")


def normal_version(value: Column) -> Column:
    """vX.Y.Z with its suffix of a value of that form, else null."""
    v = F.regexp_extract(F.trim(value), r"^v?(\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.+-]+)?)$", 1)
    return F.when(v != "", F.concat(F.lit("v"), v))


def loose_version(value: Column) -> Column:
    """v before a value that starts with a digit; any other stays."""
    t = blank_to_null(F.trim(value))
    return F.when(t.rlike("^[0-9]"), F.concat(F.lit("v"), t)).otherwise(t)


def chart_version(chart: Column) -> Column:
    """The version behind a chart's name: name-1.2.3."""
    return normal_version(F.regexp_extract(chart, r"-(v?\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.+-]+)?)$", 1))


def image_tags(text: Column, image: str) -> Column:
    """Versions of all tags of an image named in a text."""
    return F.regexp_extract_all(text, F.lit(rf"{image}:(v?\d+\.\d+\.\d+(?:[-+][0-9A-Za-z.+-]+)?)"), 1)


def ntp_status(value: Column) -> Column:
    return F.coalesce(F.get_json_object(value, "$.ntpSyncStatus"), blank_to_null(F.regexp_extract(value, r'ntpSyncStatus"?\s*:\s*"?([A-Za-z]+)', 1)), value)


def tri_state(value: Column) -> Column:
    v = F.lower(F.trim(value.cast("string")))
    return F.when(v == "true", True).when(v == "false", False)


def retention(created: Column, days: int = 30) -> Column:
    return created + F.expr(f"INTERVAL {days} DAYS")


# The patterns of white space, HTML and titles from here on define what bodies and titles are.
def collapse_whitespace(text: Column) -> Column:
    for pattern, by in (("\r", ""), ("[ \t\f\x0b]+", " "), ("\n[ \t]+", "\n"), ("[ \t]+\n", "\n"), ("\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, by)
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def decode_entities(text: Column) -> Column:
    """Numeric references by their code point, then the named ones, in one pass over the pieces.

    A text is split at its ampersands; each piece is decoded by itself, natively.
    """
    pieces = F.split(text, "&")

    def piece(p: Column, i: Column) -> Column:
        c = F.when(p.rlike("(?i)^#x[0-9a-f]{1,6};"), F.conv(F.regexp_extract(p, "(?i)^#x([0-9a-f]+);", 1), 16, 10)).when(p.rlike("^#[0-9]{1,7};"), F.regexp_extract(p, "^#([0-9]+);", 1)).cast("bigint")
        return F.when(i == 0, p).when(c.isNotNull() & (c < 1114112) & ~c.between(55296, 57343), F.concat(utf8(c), F.regexp_replace(p, "^#[xX]?[0-9a-fA-F]+;", ""))).otherwise(F.concat(F.lit("&"), p))

    out = F.array_join(F.transform(pieces, piece), "")
    out = F.when(text.contains("&#"), out).otherwise(text)
    for name, by in list(ENTITIES.items())[1:]:
        out = F.replace(out, F.lit(f"&{name};"), F.lit(by))
    return F.replace(out, F.lit("&amp;"), F.lit("&"))


def utf8(c: Column) -> Column:
    """The character of a code point."""
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    tail = lambda k: byte(F.shiftright(c, 6 * k).bitwiseAND(63) + 128)
    bits = F.when(c < 128, byte(c)).when(c < 2048, F.concat(byte(F.shiftright(c, 6) + 192), tail(0))).when(c < 65536, F.concat(byte(F.shiftright(c, 12) + 224), tail(1), tail(0))).otherwise(F.concat(byte(F.shiftright(c, 18) + 240), tail(2), tail(1), tail(0)))
    return F.decode(F.unhex(bits), "UTF-8")


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(decode_entities(F.regexp_replace(html, "<[^>]+>", " ")), r"^\s+|\s+$", "")


def _class(tag: str, name: str) -> str:
    return rf"""<{tag}\b[^>]*class=(?:"[^"]*\b{name}\b[^"]*"|'[^']*\b{name}\b[^']*'|[^\s>]*{name}[^\s>]*)"""


def _first(text: Column, pattern: str) -> Column:
    """Group 1 of the first match, null without one."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, 1))


def primary_html(html: Column) -> Column:
    content = r"(?is)" + _class("div", "content") + r"[^>]*>(.*?)</div>\s*</div>\s*" + _class("a", "button")
    return F.coalesce(_first(html, content), _first(html, r"(?is)<article\b[^>]*>(.*?)</article>"), _first(html, r"(?is)<body\b[^>]*>(.*?)</body>"), html)


def html_text(html: Column) -> Column:
    t = primary_html(html)
    for tag in ("script", "style", "nav", "footer"):
        t = F.regexp_replace(t, rf"(?is)<{tag}\b.*?</{tag}>", " ")
    for pattern, by in ((r"(?i)<pre\b[^>]*>", "\n"), (r"(?i)</pre>", "\n"), (r"(?i)<br\s*/?>", "\n"), (r"(?i)</(p|div|section|article|h[1-6]|li|ol|ul|tr)>", "\n"), (r"(?i)<li\b[^>]*>", "- "), ("<[^>]+>", " ")):
        t = F.regexp_replace(t, pattern, by)
    return decode_entities(t)


def html_title(html: Column) -> Column:
    hero, h1, title = r"(?is)" + _class("p", "title") + r"[^>]*>(.*?)</p>", r"(?is)<h1\b[^>]*>(.*?)</h1>", r"(?is)<title\b[^>]*>(.*?)</title>"
    return F.when(html.rlike(hero), strip_tags(F.regexp_extract(html, hero, 1))).when(html.rlike(h1), strip_tags(F.regexp_extract(html, h1, 1))).when(html.rlike(title), F.split(strip_tags(F.regexp_extract(html, title, 1)), r"\|")[0]).otherwise("")


def plain_title(text: Column) -> Column:
    lines = F.transform(F.split(text, "\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    heading = F.get(F.filter(lines, lambda x: (x != "") & (F.length(x) <= 120) & ~x.rlike("[.!?]$")), F.lit(0))
    return F.coalesce(F.trim(F.regexp_replace(heading, r"^#{1,6}\s+", "")), F.lit(""))


#: Fixed value: the site whose name is cut off titles.
SITE = "The Longhorn Knowledge Base"


def clean_title(title: Column, site: str = SITE) -> Column:
    t = F.regexp_replace(collapse_whitespace(title), rf"(?i)\s+\|\s+\Q{site}\E$", "")
    return F.trim(F.regexp_replace(t, r"^#{1,6}\s+", ""))


def url_path(url: Column) -> Column:
    """The path of an absolute URL, / if it has none."""
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def url_origin(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))


def slug_title(url: Column) -> Column:
    segments = F.filter(F.split(url_path(url), "/"), lambda x: x != "")
    return F.when(url.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), F.coalesce(F.replace(F.get(F.reverse(segments), F.lit(0)), F.lit("-"), F.lit(" ")), F.lit(""))).otherwise("")


def is_html(text: Column, content_type: Column) -> Column:
    return text.rlike(r"(?is)</?[a-z].*>") | F.coalesce(content_type.contains("html"), F.lit(False))


def known_product(product: Column) -> Column:
    p = F.lower(F.trim(product))
    return F.when(p.isin(*PRODUCTS), p)


def inferred_product(url: Column, body: Column, products: tuple[str, ...] = PRODUCTS) -> Column:
    text = F.lower(F.concat(F.coalesce(url, F.lit("")), F.lit("\n"), F.coalesce(body, F.lit(""))))
    out = F.lit("unknown")
    for p in reversed(products):
        out = F.when(text.contains(p), p).otherwise(out)
    return out


def document_id(source: Column) -> Column:
    return F.concat(F.lit("kb_"), F.substring(F.sha1(source.cast("binary")), 1, 18))


def tokens(text: Column) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9][a-z0-9._-]*)"), 1)
    return F.filter(found, lambda t: (F.length(t) > 1) & ~t.isin(*STOP_WORDS))


def fnv1a(token: Column) -> Column:
    """The 32-bit FNV-1a hash of a token of ASCII characters."""
    return F.aggregate(F.filter(F.split(token, ""), lambda c: c != ""), F.lit(2166136261).cast("bigint"), lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("bigint")) * 16777619).bitwiseAND(4294967295))


def cosine(a: Column, b: Column) -> Column:
    """Over the shorter length; 0 if either has no length."""
    n = F.least(F.size(a), F.size(b))
    a, b = (F.slice(x, F.lit(1), n) for x in (a, b))
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, 0.0).otherwise(dot(a, b) / norm)


def keyword_overlap(query_tokens: Column, text: Column) -> Column:
    """Distinct query tokens that the lower-cased text contains, over sqrt(n * max(n, 3))."""
    q = F.array_distinct(query_tokens)
    n = F.size(q).cast("double")
    hits = F.size(F.filter(q, lambda t: text.contains(t)))
    return F.when(n == 0, 0.0).otherwise(hits / F.sqrt(n * F.greatest(n, F.lit(3.0))))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), the value being computed once, however often `then` and its lambdas use it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def excerpt(content: Column, query_tokens: Column, size: int = 260, before: int = 90) -> Column:
    def start(t: Column) -> Column:
        first = lambda low: F.instr(low, F.get(F.filter(query_tokens, lambda q: low.contains(q)), F.lit(0)))
        return F.greatest(F.coalesce(once(F.lower(t), first) - 1 - before, F.lit(0)), F.lit(0))

    def cut(t: Column, at: Column) -> Column:
        part = F.substring(t, at + 1, F.lit(size))
        return F.concat(F.when(at > 0, "...").otherwise(""), part, F.when(at + F.length(part) < F.length(t), "...").otherwise(""))

    return once(F.trim(F.regexp_replace(content, r"\s+", " ")), lambda t: once(start(t), lambda at: cut(t, at)))
