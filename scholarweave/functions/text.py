"""Column functions over free text. White space and word characters are Unicode throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholarweave.fixed_values import (
    ENGLISH_STOPWORDS,
    JOURNAL_ABBREVIATIONS,
    KEYWORD_STOPWORDS,
    NODE_STOPWORDS_EN,
    NODE_STOPWORDS_KO,
    PAPER_STOPWORDS,
    TECHNICAL_TERMS,
    TITLE_TERMS,
)


# Every Unicode white space character, as a list and as the inside of a regex class.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
WS = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def once(value: Column, make: Callable[[Column], Column]) -> Column:
    """``make`` of ``value``, which is worked out once however often ``make`` names it (branches and array functions share nothing)."""
    return F.get(F.transform(F.array(value), lambda v: make(v)), F.lit(0))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    """Runs of white space become one space; only runs are left for the regex to find."""
    return strip(F.regexp_replace(F.translate(text, SPACES, " " * len(SPACES)), " {2,}", " "))


def words(text: Column) -> Column:
    """Words between white space; empty for blank text."""
    return F.filter(F.split(text, rf"[{WS}]+"), lambda w: w != "")


def clean_bibtex(text: Column) -> Column:
    """Braces dropped, whitespace collapsed."""
    return collapse(F.regexp_replace(text_or_empty(text), r"[{}]", ""))


def clean_model_input(text: Column) -> Column:
    """Letters, digits and common punctuation only."""
    return collapse(F.regexp_replace(text_or_empty(text), rf"[^{WORD}{WS}.,;:!?\-()]", " "))


def clean_node_text(text: Column) -> Column:
    return collapse(F.regexp_replace(text_or_empty(text), rf"[^{WORD}{WS}\-.,()]", " "))


def truncate_words(text: Column, n: int) -> Column:
    """The first n words; a shorter text is returned unchanged."""
    return once(text, lambda t: once(words(t), lambda split: F.when(F.size(split) <= n, t).otherwise(F.array_join(F.slice(split, 1, n), " "))))


def remove_stopwords(text: Column, language: str = "mixed") -> Column:
    stop = {"ko": NODE_STOPWORDS_KO, "en": NODE_STOPWORDS_EN}.get(language, NODE_STOPWORDS_KO + NODE_STOPWORDS_EN)
    return F.array_join(F.filter(words(text), lambda w: ~F.lower(w).isin(stop)), " ")


def terms_in(lowered: Column, terms: list[str]) -> Column:
    """Terms that occur anywhere in an already lower-case text, in list order."""
    return F.array_remove(F.array(*[F.when(F.contains(lowered, F.lit(t.lower())), F.lit(t)).otherwise("") for t in terms]), "")


def terms_found(text: Column, terms: list[str]) -> Column:
    return terms_in(F.lower(text_or_empty(text)), terms)


def title_terms(title: Column) -> Column:
    return terms_found(title, TITLE_TERMS)


def technical_terms(text: Column) -> Column:
    return terms_found(text, TECHNICAL_TERMS)


def split_list(text: Column) -> Column:
    """Comma- or semicolon-separated pieces, trimmed, without blanks."""
    return F.filter(F.transform(F.split(text, r"[,;]"), strip), lambda p: p != "")


def bibtex_keywords(field: Column, title: Column) -> Column:
    """Keyword field plus dictionary hits in the title: lower case, longer than two, distinct."""
    listed = split_list(clean_bibtex(field))
    both = F.concat(listed, title_terms(clean_bibtex(title)))
    return F.array_distinct(F.transform(F.filter(both, lambda k: F.length(k) > 2), lambda k: strip(F.lower(k))))


def clean_keyword(keyword: Column) -> Column:
    """Lower-case keyword, or null for noise: length, digits only, no ASCII letter or digit, stop word."""
    k = strip(F.lower(keyword))
    noise = (
        (F.length(k) < 2)
        | (F.length(k) > 50)
        | k.rlike(r"^\p{Nd}+$")
        | ~k.rlike(r"[a-zA-Z0-9]")
        | k.isin(KEYWORD_STOPWORDS)
    )
    return F.when(~noise, k)


def clean_author(name: Column) -> Column:
    """'Last, First' is swapped first, then other marks become spaces; null if too short or digits."""
    raw = strip(text_or_empty(name))
    swapped = F.when(
        F.contains(raw, F.lit(",")),
        F.concat_ws(" ", strip(F.substring_index(raw, ",", -1)), strip(F.substring_index(raw, ",", 1))),
    ).otherwise(raw)
    swapped = F.when(F.length(F.regexp_replace(raw, "[^,]", "")) > 1, raw).otherwise(swapped)
    cleaned = collapse(F.regexp_replace(swapped, rf"[^{WORD}{WS}.\-]", " "))
    return F.when((F.length(raw) >= 2) & ~raw.rlike(r"^\p{Nd}+$"), cleaned)


def normalize_author(name: Column) -> Column:
    return collapse(F.regexp_replace(F.lower(clean_author(name)), r"\.", ""))


def normalize_journal(name: Column) -> Column:
    """Full name for a known abbreviation, first letter raised; null when shorter than three."""
    raw = strip(name)
    full = None
    for pattern, target in JOURNAL_ABBREVIATIONS:
        hit = raw.rlike("(?i)" + pattern)
        full = F.when(hit, target) if full is None else full.when(hit, target)
    tidy = collapse(full.otherwise(raw))
    return F.when(F.length(raw) >= 3, F.concat(F.upper(F.substring(tidy, 1, 1)), F.substr(tidy, F.lit(2))))


def merge_keywords(first: Column, second: Column) -> Column:
    """Both lists in lower case, longer than two, distinct and sorted."""
    lowered = F.transform(F.concat(first, second), lambda k: strip(F.lower(k)))
    return F.array_sort(F.array_distinct(F.filter(lowered, lambda k: F.length(k) > 2)))


def model_input(title: Column, abstract: Column) -> Column:
    cleaned = clean_model_input(abstract)
    head = F.concat(F.lit("Title: "), clean_model_input(title))
    return F.when(cleaned != "", F.concat(head, F.lit(" Abstract: "), cleaned)).otherwise(head)


def content_tokens(text: Column) -> Column:
    """Lower-case words of letters only, longer than two and not a stop word, in order."""
    stop = ENGLISH_STOPWORDS + PAPER_STOPWORDS
    plain = F.regexp_replace(F.lower(text_or_empty(text)), rf"[^{WORD}{WS}]", " ")
    return F.filter(words(plain), lambda w: (F.length(w) > 2) & w.rlike(r"^\p{L}+$") & ~w.isin(stop))


def content_terms(tokens: Column) -> Column:
    """Single tokens, then neighbouring pairs (pairs are formed after filtering)."""
    following = F.slice(tokens, F.lit(2), F.greatest(F.size(tokens) - 1, F.lit(0)))
    pairs = F.zip_with(F.slice(tokens, F.lit(1), F.greatest(F.size(tokens) - 1, F.lit(0))), following, lambda a, b: F.concat_ws(" ", a, b))
    return F.concat(tokens, pairs)


def hangul_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[가-힣]"))


def latin_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit("[a-zA-Z]"))


def is_mixed_language(text: Column) -> Column:
    ko, en = hangul_count(text), latin_count(text)
    ratio = ko / (ko + en)
    return F.when(ko + en == 0, False).otherwise((ratio > 0.1) & (ratio < 0.9))


def token_estimate(text: Column, chars_per_token: float = 4.0) -> Column:
    return F.floor(F.length(text) / chars_per_token).cast("long")


def word_token_estimate(text: Column) -> Column:
    return (F.size(words(text)) * 1.3).cast("long")


def xml_safe(text: Column) -> Column:
    """Control characters dropped, the five entities escaped."""
    out = F.regexp_replace(text_or_empty(text), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(mark), F.lit(entity))
    return out


def cache_key(text: Column) -> Column:
    return F.md5(strip(F.lower(text)).cast("binary"))


def fixed_chunks(text: Column, size: int) -> Column:
    """Pieces of ``size`` characters (streamed answers are cut this way)."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(size))
    return F.transform(starts, lambda s: F.substr(text, s, F.lit(size)))
