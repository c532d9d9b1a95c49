"""Text functions as Column expressions; a null text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Link labels that describe nothing.
POOR_LINK_LABELS = (
    "click here", "here", "link", "read more", "learn more", "more", "details", "more info", "more information",
    "this link", "go", "click", "click this", "this", "page", "website", "site",
)
# Bare address, at most one character, digits only, "link to" an address.
POOR_LINK_PATTERN = r"^https?://\S+$|^.{0,1}$|^[\d\s]+$|^link\s*to\s+https?://"
# Placeholders for figure descriptions.
WEAK_ALT_PATTERN = r"^(?:element\s+\d+|figure\s*\d*|image\s*\d*|graphic\s*\d*|picture\s*\d*|illustration\s*\d*|decorative)$"
# How a contents line ends in a page number (blanks are collapsed before).
TOC_END = r"(?i)(?:\.{2,}\s*|(?:\.\s*){2,})(?:\d+|[ivxlcdm]+)\s*$|\s+\d+\s*$"
#: Limits of a plausible link label.
LINK_MAX_CHARS, LINK_MAX_WORDS = 160, 18


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def collapsed(c: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text_of(c), r"[ \t\n\x0B\f\r]+", " "))


def word_count(c: Column) -> Column:
    return F.when(collapsed(c) == "", 0).otherwise(F.size(F.split(collapsed(c), " ")))


def normalized(c: Column) -> Column:
    """Lower-case ASCII letters and digits; all else is a blank."""
    return F.trim(F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9]+", " "))


def dense(c: Column) -> Column:
    return F.regexp_replace(F.lower(text_of(c)), "[^a-z0-9]+", "")


def split_alpha_digit(c: Column) -> Column:
    """A blank between a letter and a digit that touch."""
    return F.regexp_replace(text_of(c), r"(?<=\p{L})(?=\p{Nd})|(?<=\p{Nd})(?=\p{L})", " ")


def loose(c: Column) -> Column:
    """Letters and digits apart, punctuation as blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(split_alpha_digit(F.lower(collapsed(c))), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def title_key(c: Column) -> Column:
    """Letters and digits apart, without punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(split_alpha_digit(F.lower(collapsed(c))), r"[^\p{L}\p{N}_\s]", ""), r"\s+", " "))


def matches_text(actual: Column, expected: Column, exact: bool) -> Column:
    a, b = normalized(actual), normalized(expected)
    return (a != "") & (b != "") & ((a == b) if exact else F.contains(a, b))


def matches_title(actual: Column, expected: Column) -> Column:
    a, b = title_key(actual), title_key(expected)
    return (a != "") & (b != "") & F.contains(a, b)


def matches_contiguous_terms(actual: Column, expected: Column) -> Column:
    a, b = loose(actual), loose(expected)
    return (a != "") & (b != "") & F.contains(F.concat(F.lit(" "), a, F.lit(" ")), F.concat(F.lit(" "), b, F.lit(" ")))


def matches_ordered_terms(actual: Column, expected: Column) -> Column:
    """Whether the expected words occur in this order, with others between: a fold over them, the rest of the text as state."""
    words, wanted = F.split(loose(actual), " "), F.split(loose(expected), " ")
    rest = F.aggregate(
        wanted, words,
        lambda left, w: F.when(F.array_position(left, w) > 0, F.slice(left, F.array_position(left, w).cast("int") + 1, F.size(left) + 1)).otherwise(F.lit(None)))
    return (loose(actual) != "") & (loose(expected) != "") & rest.isNotNull()


def is_poor_link_text(c: Column) -> Column:
    low = F.lower(F.trim(text_of(c)))
    return low.isin(*POOR_LINK_LABELS) | F.rlike(low, F.lit(POOR_LINK_PATTERN))


def is_implausible_link_text(c: Column) -> Column:
    x = collapsed(c)
    return (x != "") & ((F.length(x) > LINK_MAX_CHARS) | (word_count(c) > LINK_MAX_WORDS) | F.rlike(x, F.lit(r"[.!?]\s+[A-Z]")))


def is_generated_link(c: Column, uri: Column) -> Column:
    low, u = F.lower(collapsed(c)), F.lower(text_of(uri))
    kinds = r"^(?:jump|go)\s+to\s+(?:destination|bibitem|cite|section|subsection|appendix|figure|table|equation|eqn|footnote|endnote|page)\b"
    return (low != "") & ((low == "link") | F.rlike(low, F.lit(kinds)) | ((u != "") & ((low == F.concat(F.lit("link to "), u)) | (low == "link to external destination"))))


def is_technical_name(c: Column) -> Column:
    x = collapsed(c)
    low = F.lower(x)
    return (x != "") & (
        low.startswith("topmostsubform") | F.rlike(low, F.lit(r"\[0\]|\.page|\.subform|textfield")) | F.rlike(x, F.lit(r"[_\[\]]"))
        | (F.contains(x, F.lit(".")) & ~F.contains(x, F.lit(" "))) | F.rlike(x, F.lit(r"^[\p{L}\p{N}]*\p{Nd}[\p{L}\p{N}]*$")))


def label_quality(label: Column, field: Column) -> Column:
    return (
        F.when(collapsed(label) == "", "missing").when(is_technical_name(label), "weak")
        .when((collapsed(label) == collapsed(field)) & is_technical_name(field), "weak").otherwise("good"))


def is_fragmentary(c: Column) -> Column:
    x = collapsed(c)
    letters = F.length(F.regexp_replace(x, "[^A-Za-z]+", ""))
    digits = F.length(F.regexp_replace(x, "[^0-9]+", ""))
    return (x == "") | (F.length(x) <= 42) | (letters < 12) | ((word_count(c) <= 8) & (digits >= F.greatest(letters, F.lit(1))))


def is_toc_entry(c: Column) -> Column:
    """A title with letters before a page number at the end."""
    x = collapsed(c)
    before = F.regexp_replace(F.regexp_replace(x, TOC_END, ""), r"[ .\t]+$", "")
    return (F.length(x) >= 4) & F.rlike(x, F.lit("[A-Za-z]")) & F.rlike(x, F.lit(TOC_END)) & (before != "")


def bookmark_label(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(collapsed(c), TOC_END, ""), r"[ .\t]+$", ""))


def section_key(c: Column) -> Column:
    """"appendix a.1" or "1.2.3" at the beginning of a label, else empty."""
    label = bookmark_label(c)
    appendix = F.regexp_replace(F.lower(F.regexp_extract(label, r"(?i)^(appendix\s+[a-z0-9]+(?:\.\d+)*)\b", 1)), r"\s+", " ")
    return F.when(appendix != "", appendix).otherwise(F.regexp_extract(label, r"^(\d+(?:\.\d+)*)\b", 1))


def parent_section_key(c: Column) -> Column:
    return F.regexp_replace(section_key(c), r"\.[^. ]*$", "")


def title_like(c: Column) -> Column:
    return collapsed(F.regexp_replace(F.lower(collapsed(c)), r"[^\p{L}\p{N}\s]", ""))


def merge_key(c: Column) -> Column:
    key, text = section_key(c), title_like(c)
    return F.when(key != "", F.concat(F.lit("section:"), key)).when(text != "", F.concat(F.lit("text:"), text)).otherwise("")


def fingerprint(c: Column) -> Column:
    return F.lower(F.regexp_replace(text_of(c), "[^A-Za-z0-9]+", ""))


def font_name(c: Column) -> Column:
    return fingerprint(F.regexp_replace(text_of(c), r"^[A-Z]{6}\+", ""))


def primary_subtag(c: Column) -> Column:
    return F.substring_index(F.lower(collapsed(c)), "-", 1)


def list_numbering(c: Column) -> Column:
    """The numbering that a list marker stands for, null if none."""
    x = F.trim(text_of(c))
    token = F.regexp_replace(x, r"^[()\[\]{}.:]+|[()\[\]{}.:]+$", "")
    upper = token == F.upper(token)
    return (
        F.when(F.rlike(token, F.lit(r"^\d")), "Decimal")
        .when(F.rlike(token, F.lit("(?i)^[ivxlcdm]+$")), F.when(upper, "UpperRoman").otherwise("LowerRoman"))
        .when(F.rlike(token, F.lit(r"^[A-Za-z]$")), F.when(upper, "UpperAlpha").otherwise("LowerAlpha"))
        .when(x.isin("-", "*", "+", "•", "●"), "Disc").when(x.isin("◦", "○"), "Circle").when(x.isin("▪", "■"), "Square"))


def is_weak_alt(c: Column) -> Column:
    x = collapsed(c)
    return (x == "") | (x.startswith("[") & x.endswith("]")) | F.rlike(F.lower(x), F.lit(WEAK_ALT_PATTERN))


def code_without_line_numbers(c: Column) -> Column:
    return F.trim(F.regexp_replace(text_of(c), r"(?m)^[ \t]*\d+[\]|:.]?[ \t]*", ""))
