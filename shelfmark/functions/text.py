"""Text cleaning and tokens as column expressions."""

from __future__ import annotations

import unicodedata
from string import ascii_lowercase

from pyspark.sql import Column
from pyspark.sql import functions as F

# The English stop words that the text cleaning leaves out.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you", "your", "yours",
    "yourself", "yourselves", "he", "him", "his", "himself", "she", "her", "hers",
    "herself", "it", "its", "itself", "they", "them", "their", "theirs", "themselves",
    "what", "which", "who", "whom", "this", "that", "these", "those", "am", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does",
    "did", "doing", "a", "an", "the", "and", "but", "if", "or", "because", "as", "until",
    "while", "of", "at", "by", "for", "with", "about", "against", "between", "into",
    "through", "during", "before", "after", "above", "below", "to", "from", "up", "down",
    "in", "out", "on", "off", "over", "under", "again", "further", "then", "once", "here",
    "there", "when", "where", "why", "how", "all", "any", "both", "each", "few", "more",
    "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same", "so", "than",
    "too", "very", "s", "t", "can", "will", "just", "don", "should", "now",
)
# Fixed value: the ASCII punctuation that is deleted.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Lower-case Latin letters with marks, and the same without.
ACCENTED = "".join(c for c in map(chr, range(0xE0, 0x180)) if c.islower() and unicodedata.normalize("NFKD", c)[0] in ascii_lowercase and len(unicodedata.normalize("NFKD", c)) == 2)
PLAIN = "".join(unicodedata.normalize("NFKD", c)[0] for c in ACCENTED)
LIGATURES = (("œ", "oe"), ("æ", "ae"), ("ß", "ss"))


# White space in Unicode, and the ASCII characters that are deleted, as classes of a pattern.
SPACE = r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
_DELETED = r"[!-/:-@\[-`{-~0-9]+"


def clean(text: Column) -> Column:
    """URLs, punctuation and digits out, lower case, Latin letters without accents.

    What only concerns texts with URLs or beyond ASCII is left to those.
    """
    links = F.contains(text, F.lit("http")) | F.contains(text, F.lit("www"))
    out = F.when(links, F.regexp_replace(text, r"(?U)http\S+|www\S+", "")).otherwise(text)
    out = F.lower(F.regexp_replace(out, _DELETED, ""))
    more = F.regexp_replace(out, r"(?U)\d+", "")
    for letter, plain in LIGATURES:
        more = F.replace(more, F.lit(letter), F.lit(plain))
    return F.when(F.octet_length(text) == F.char_length(text), out).otherwise(F.translate(more, ACCENTED, PLAIN))


def words(text: Column) -> Column:
    """The cleaned text's words, as an array."""
    return F.split(F.trim(clean(text)), SPACE)


def is_token(word: Column) -> Column:
    """More than two plain letters, no letter three times in a row, no stop word."""
    return (F.length(word) > 2) & ~word.isin(*STOP_WORDS) & word.rlike("^[a-z]+$") & ~word.rlike(r"(.)\1\1")


def as_list(column: str, kind: str) -> Column:
    """A column of lists as it is; text is split at commas with a space. The declared type decides, not a first row."""
    return F.split(F.col(column), ", ") if kind == "string" else F.col(column)


def combined(title: Column, description: Column, categories: Column) -> Column:
    """One text of an item: title, description and the list of its categories. Nulls are empty."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    return F.concat(empty(title), F.lit(". "), empty(description), F.lit(". "), empty(F.array_join(categories, " ")))


def plain(text: Column, most: int | None = None) -> Column:
    """The older preparation: ``most`` characters at most, lower case, punctuation as spaces, runs of white space as one. Null is empty."""
    out = F.coalesce(text, F.lit(""))
    out = F.lower(F.substring(out, 1, most) if most else out)
    return F.trim(F.regexp_replace(F.translate(out, PUNCTUATION, " " * len(PUNCTUATION)), r"(?U)\s+", " "))


def categories(text: Column) -> Column:
    """A printed list of categories as an array: brackets off, split at commas, quotes and blanks off."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\[\]]", ""), ",")
    return F.filter(F.transform(parts, lambda x: F.regexp_replace(x, "^[ '\"]+|[ '\"]+$", "")), lambda x: x != "")
