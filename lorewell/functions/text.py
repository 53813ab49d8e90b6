"""Text expressions: tokens, hashes, normalisation, sentences, headers, quality.  All native columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words of the two tokenisers.
BM25_STOP = (
    "a an and are as at be by for from has have in is it its of on or that the this to was were will with what who when "
    "where which how why do does did"
).split()
CLAIM_STOP = (
    "the a an and or but if then else for of to in on at by is are was were be been being as that this these those it its "
    "with from into about which who whom whose what when where how why will would can could should may might must not no do "
    "does did has have had they them their we our you your he she his her also there here than such so some any source "
    "sources answer details according based context institution provided mentioned states notes"
).split()
BM25_TOKEN = r"([a-z0-9À-ɏऀ-ॿ]+)"
CLAIM_TOKEN = r"([a-z0-9]+)"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def text_or_empty(c: Column | str) -> Column:
    return F.coalesce(col(c), F.lit(""))


def first_text(*cs: Column | str) -> Column:
    """First value that is neither null nor empty, else ""."""
    return F.coalesce(*[F.nullif(col(c), F.lit("")) for c in cs], F.lit(""))


#: Unicode white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column | str) -> Column:
    """Trim all (Unicode) white space, not blanks alone."""
    return F.btrim(col(c), F.lit(WHITE))


def bm25_tokens(c: Column | str) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(BM25_TOKEN)), lambda t: ~t.isin(*BM25_STOP))


def claim_tokens(c: Column | str) -> Column:
    return F.filter(F.regexp_extract_all(F.lower(text_or_empty(c)), F.lit(CLAIM_TOKEN)), lambda t: (F.length(t) > 1) & ~t.isin(*CLAIM_STOP))


def claim_token_set(c: Column | str) -> Column:
    return F.array_distinct(claim_tokens(c))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once, however often body uses it (also inside lambdas)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def url_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(F.trim(col(c)), 256), 1, 16)


def content_hash(c: Column | str) -> Column:
    return F.substring(F.sha2(col(c), 256), 1, 24)


def clean_text(c: Column | str) -> Column:
    t = F.regexp_replace(text_or_empty(c), "\r\n", "\n")
    return strip(F.regexp_replace(F.regexp_replace(t, r"\n{3,}", "\n\n"), r"[ \t]+", " "))


def normalize_whitespace(c: Column | str) -> Column:
    t = F.regexp_replace(col(c), "\r\n?", "\n")
    t = F.regexp_replace(F.regexp_replace(t, "[ \t\u00a0]+", " "), " *\n *", "\n")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def one_line(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " "))


normalize_query = one_line


def norm_line(c: Column | str) -> Column:
    return F.lower(one_line(c))


def norm_title(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text_or_empty(c), r"(?U)\s+", " ")), "[^a-z0-9 ]", ""))


def slugify(c: Column | str) -> Column:
    t = F.regexp_replace(F.lower(text_or_empty(c)), r"(?U)[^\w\s-]", "")
    return F.regexp_replace(F.regexp_replace(t, r"(?U)[\s_-]+", "-"), "^-+|-+$", "")


def as_list(c: Column | str) -> Column:
    parts = F.transform(F.split(text_or_empty(c), "[;,]"), strip)
    return F.filter(parts, lambda x: x != "")


def truncate(c: Column | str, n: int = 300) -> Column:
    """Cut at the last blank within n characters, with an ellipsis."""
    t = text_or_empty(c)
    cut = F.regexp_replace(F.substring(t, 1, n), r"(?s) [^ ]*$", "")
    return F.when(F.length(t) <= n, t).otherwise(F.concat(cut, F.lit("…")))


def word_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(text_or_empty(c), r"(?U)\s+"), lambda w: w != ""))


def approx_tokens(c: Column | str) -> Column:
    return F.floor(word_count(c) * 1.33).cast("int")


def sentences(c: Column | str) -> Column:
    """Sentence-like units: broken at newlines and after . ! ? before white space."""
    t = F.regexp_replace(text_or_empty(c), r"[ \t]+", " ")
    return F.filter(F.transform(F.split(t, r"\n+|(?<=[.!?])(?U)\s+"), strip), lambda s: s != "")


def joined(c: Column | str, sep: str = ", ") -> Column:
    return F.array_join(F.filter(F.transform(F.coalesce(col(c), F.array().cast("array<string>")), strip), lambda x: x != ""), sep)


def meta_header(names: list[str]) -> Column:
    """"Label: value" lines of the metadata at hand; empty values leave no line."""

    def text(n: str) -> Column:
        return strip(text_or_empty(n)) if n in names else F.lit("")

    def line(label: str, v: Column) -> Column:
        return F.when(v != "", F.concat(F.lit(f"{label}: "), v))

    title = text("title")
    authors = first_text(joined("authors"), text("author")) if "authors" in names else text("author")
    section = first_text(text("heading_path"), text("section"))
    tags = joined("tags") if "tags" in names else F.lit("")
    return F.concat_ws(
        "\n",
        F.when(F.lower(title) != "untitled", line("Title", title)),
        line("Subtitle", text("subtitle")),
        line("Author", authors),
        line("Published", text("date")),
        line("Updated", text("updated_date")),
        line("Category", text("category")),
        line("Section", section),
        line("Tags", tags),
        line("Type", text("document_type")),
        line("Source", text("source_name")),
    )


def search_text(header: Column | str, body: Column | str) -> Column:
    """What is indexed: header, blank line, body."""
    return F.concat_ws("\n\n", F.nullif(strip(text_or_empty(header)), F.lit("")), strip(text_or_empty(body)))


# Characters that clean text does not hold (controls, IPA, stray marks, Greek to Arabic, boxes, private use).
_NOISE = (
    "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x80-\\x9F\\u0250-\\u02AF\\u0300-\\u036F\\u0370-\\u03FF\\u0400-\\u04FF"
    "\\u0530-\\u05FF\\u0600-\\u06FF\\u2500-\\u259F\\uE000-\\uF8FF\\uFFFD]"
)
#: The same, reached only from characters that are not plain ASCII text, so that such text is passed over at the speed of one test.
NOISE = r"[^\x09\x0A\x0D\x20-\x7E](?<=" + _NOISE + ")"


_GAP = "[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"  # WHITE as a class
_INK = "[^" + _GAP[1:]
#: Two characters beyond ASCII that are four apart at most in one token, or noise: garbage_token() holds only for tokens
#: with this, so texts, lines and tokens without it need no closer look.
SUSPECT = r"[^\x00-\x7F]" + _INK + r"{0,3}[^\x00-\x7F]|" + NOISE


def _odd_letters(t: Column) -> Column:
    """Four letters beyond ASCII in a row, or a large share of characters beyond ASCII."""
    n, foreign = F.length(t), F.length(F.regexp_replace(t, r"[\x00-\x7F]", ""))
    long_run = t.rlike(r"[\p{L}&&[^\x00-\x7F]]{4}")
    no_vowel = (n >= 5) & (foreign / n >= 0.4) & ~t.rlike("[aeiouAEIOU]")
    mostly = (n >= 6) & (foreign / n >= 0.5)
    return t.rlike(r"\p{L}") & (long_run | no_vowel | mostly)


def garbage_token(t: Column) -> Column:
    """Whether a token is unrecoverable extraction noise."""
    return t.rlike(NOISE) | _odd_letters(t)


def _may_be_odd(t: Column) -> Column:
    """What _odd_letters() needs, from sizes alone: a character beyond ASCII has at least one byte more."""
    more = F.octet_length(t) - F.length(t)
    return (more >= 4) | ((more >= 2) & (more >= 0.4 * F.length(t)))


def quality_score(c: Column | str) -> Column:
    """1 for clean text, towards 0 as garbage tokens or noise characters take over.

    The text is cut at white space once and every token is looked at once, so a long token costs its length; where the
    text has no noise characters, most tokens are settled by their sizes.
    """
    t = text_or_empty(c)
    tokens = F.split(t, _GAP + "+")

    def size(which: Callable[[Column], Column]) -> Column:
        return F.aggregate(F.filter(tokens, which), F.lit(0), lambda a, x: a + F.length(x))

    total = F.length(F.translate(t, WHITE, ""))
    odd = size(lambda x: _may_be_odd(x) & _odd_letters(x))
    clean = F.greatest(F.lit(0.0), 1.0 - odd / F.nullif(total, F.lit(0)))
    noise = F.length(t) - F.length(F.regexp_replace(t, NOISE, ""))
    penalty = F.least(F.lit(1.0), noise / F.greatest(F.lit(1), F.length(t)) * 4.0)
    noisy = F.greatest(F.lit(0.0), F.least(1.0 - size(garbage_token) / F.nullif(total, F.lit(0)), 1.0 - penalty))
    return F.when(~t.rlike(SUSPECT) | (total == 0), 1.0).when(t.rlike(NOISE), noisy).otherwise(clean)


def _is_bad_line(x: Column) -> Column:
    return x.rlike(SUSPECT) & (strip(x) != "") & (quality_score(x) < 0.5)


def drop_garbage_lines(c: Column | str) -> Column:
    """Text without the lines that are mostly garbage; blank lines stay."""
    t = text_or_empty(c)
    lines = F.filter(F.split(t, "\n", -1), lambda x: ~_is_bad_line(x))
    return normalize_whitespace(F.when(t.rlike(SUSPECT), F.array_join(lines, "\n")).otherwise(t))


def dropped_lines(c: Column | str) -> Column:
    return F.filter(F.split(text_or_empty(c), "\n", -1), _is_bad_line)
