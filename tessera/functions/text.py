"""Text functions as Spark columns. All are null-tolerant: a null text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a CJK character, a term and a token are.
CJK = "\\u3400-\\u4dbf\\u4e00-\\u9fff"
ALNUM = "[a-z0-9]+"
TOKEN = f"[A-Za-z0-9]+|[{CJK}]"

# Markers that the heuristics look for.
COMMAND_MARKERS = ("uv run", "curl -x", "--query", "--mode", "rag_", "```", "ollama ", "python -m", "http://", "https://", "127.0.0.1", "content-type", '{"query"')
COMMAND_FLAG = r"(^|\s)-{1,2}[a-zA-Z][a-zA-Z-]*"
CODE_MARKERS = ("```", "<code>", "</code>")
CODE_SYMBOLS = ("{", "}", "();", "=>", "::", "</", "/>", "SELECT ", "WHERE ", "FROM ")
CODE_LEADS = ("    ", "\t", "$ ", ">>> ")
CODE_LINE = (
    r"^\s*(?:def |class |function |SELECT |INSERT |UPDATE |DELETE |FROM |WHERE |if\s*\(|for\s*\(|while\s*\(|return\b|import\b|from\b|const\b|let\b|var\b"
    r"|public\b|private\b|protected\b|#include\b)"
)
PHONE = r"\b1[3-9]\d{9}\b"
PHONE_MASK = "[手机号脱敏]"
STRIPPED = " ,.;:，。；：、()（）[]【】"


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def strip(c: Column | str) -> Column:
    """Without white space, as Unicode has it, at both ends."""
    return F.regexp_replace(text_of(c), r"^(?U)\s+|(?U)\s+$", "")


def normalize_whitespace(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(text_of(c), r"(?U)\s+", " "))


def terms(c: Column | str) -> Column:
    """All terms of a text: runs of letters and digits, then CJK runs, each followed by its pairs."""
    low = F.lower(text_of(c))
    plain = F.regexp_extract_all(low, F.lit(ALNUM), F.lit(0))
    runs = F.regexp_extract_all(low, F.lit(f"[{CJK}]+"), F.lit(0))
    pairs = F.transform(runs, lambda r: F.when(F.length(r) < 3, F.array(r)).otherwise(F.concat(F.array(r), F.transform(F.sequence(F.lit(1), F.length(r) - 1), lambda i: F.substring(r, i, F.lit(2))))))
    return F.when(low.rlike(f"[{CJK}]"), F.concat(plain, F.flatten(pairs))).otherwise(plain)


def search_terms(c: Column | str) -> Column:
    """Distinct terms in the order of their first use."""
    return F.array_distinct(terms(c))


def plain_terms(c: Column | str) -> Column:
    """Distinct runs of letters and digits, without CJK terms."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text_of(c)), F.lit(ALNUM), F.lit(0)))


def keyword_overlap(terms: Column, text: Column | str) -> Column:
    """How many distinct terms of the text are among `terms`."""
    return F.size(F.array_intersect(search_terms(text), terms))


def text_unit_count(c: Column | str) -> Column:
    """Runs of letters and digits, and CJK characters."""
    return F.regexp_count(text_of(c), F.lit("[A-Za-z0-9]+")) + F.regexp_count(text_of(c), F.lit(f"[{CJK}]"))


def fts_query(c: Column | str) -> Column:
    return F.array_join(F.transform(search_terms(c), lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def sentences(c: Column | str) -> Column:
    """Parts that end after 。！？!?；;. or a line feed, stripped; empty ones are left out."""
    parts = F.filter(F.transform(F.split(strip(c), r"(?<=[。！？!?；;.\n])"), strip), lambda s: s != "")
    return parts


def slug(c: Column | str) -> Column:
    """Runs of letters, digits and CJK characters, joined by dashes. They are extracted: replacing what is between them takes several times as long."""
    joined = F.array_join(F.regexp_extract_all(F.lower(text_of(c)), F.lit("[a-z0-9一-鿿]+"), F.lit(0)), "-")
    return F.when(joined == "", F.lit("section")).otherwise(joined)


def mask_phones(c: Column | str) -> Column:
    return F.regexp_replace(text_of(c), f"(?U){PHONE}", PHONE_MASK)


def _any(c: Column, needles: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for n in needles:
        found = found | F.contains(c, F.lit(n))
    return found


def looks_command_like(c: Column | str) -> Column:
    return _any(F.lower(text_of(c)), COMMAND_MARKERS) | text_of(c).rlike(COMMAND_FLAG)


def looks_code_like(c: Column | str) -> Column:
    """Has a code marker, or enough of its first twelve lines look like code: two at least, and half of all lines."""
    body = strip(c)
    lines = F.filter(F.transform(F.split(body, r"\r?\n"), lambda x: F.regexp_replace(x, r"(?U)\s+$", "")), lambda x: x != "")
    code = F.filter(F.slice(lines, 1, 12), lambda x: x.rlike(CODE_LINE) | _any(x, CODE_SYMBOLS) | F.startswith(x, F.lit(CODE_LEADS[0])) | F.startswith(x, F.lit(CODE_LEADS[1])) | F.startswith(x, F.lit(CODE_LEADS[2])) | F.startswith(x, F.lit(CODE_LEADS[3])))
    return (body != "") & (_any(F.lower(body), CODE_MARKERS) | (F.size(code) >= F.greatest(F.lit(2), F.floor(F.size(lines) / 2))))


def semantic_core(c: Column | str) -> Column:
    """First line, white space collapsed, 480 characters at most."""
    return F.left(F.trim(F.regexp_replace(F.element_at(F.split(strip(c), r"[\n\r]+"), 1), r"(?U)\s+", " ")), F.lit(480))


def _words(c: Column | str) -> Column:
    """White-space tokens without brackets and punctuation at their ends."""
    tokens = F.split(normalize_whitespace(c), " ")
    return F.filter(F.transform(tokens, lambda t: F.btrim(t, F.lit(STRIPPED))), lambda t: t != "")


def fact_anchors(c: Column | str, most: int = 24) -> Column:
    """First distinct tokens with a digit or a capital."""
    signal = F.regexp_extract_all(F.concat(F.lit(" "), F.array_join(_words(c), " ")), F.lit(r" ([^ ]*[\p{Nd}\p{Lu}][^ ]*)"), F.lit(1))
    return F.slice(F.array_distinct(signal), 1, most)


def keywords(c: Column | str, most: int = 32) -> Column:
    """First distinct lower-cased tokens of two characters or more."""
    return F.slice(F.array_distinct(F.filter(_words(F.lower(text_of(c))), lambda t: F.length(t) >= 2)), 1, most)


def hash_embedding(c: Column | str, dimensions: int) -> Column:
    """The first bytes of the text's SHA-256, each over 255."""
    digest = F.sha2(text_of(c).cast("binary"), 256)
    return F.array(*(F.conv(F.substring(digest, 2 * k + 1, 2), 16, 10).cast("double") / 255 for k in range(dimensions)))


def asset_anchor(c: Column | str) -> Column:
    """[ASSET_ANCHOR:reference], the reference percent-encoded but for letters, digits and -_.:~"""
    encoded = F.url_encode(text_of(c))
    for a, b in (("+", "%20"), ("%3A", ":"), ("%7E", "~"), ("*", "%2A")):
        encoded = F.replace(encoded, F.lit(a), F.lit(b))
    return F.concat(F.lit("[ASSET_ANCHOR:"), encoded, F.lit("]"))


def asset_references(c: Column | str) -> Column:
    found = F.regexp_extract_all(text_of(c), F.lit(r"\[ASSET_ANCHOR:([^\]]+)\]"), F.lit(1))
    return F.transform(found, lambda x: F.url_decode(F.replace(x, F.lit("+"), F.lit("%2B"))))
