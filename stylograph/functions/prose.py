r"""Patterns and column expressions over prose.

Java regular expressions. ``BLANK`` spells out the Unicode white space a text can hold, since
``\s`` alone is ASCII here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stylograph.functions.lexicons import CLOSE_QUOTE, OPEN_QUOTE, STRAIGHT_QUOTE

BLANK = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"
FILLED = r"[^\s\x0B\x1C-\x1F\x85\p{Z}]"
BLANK_CHARS = (
    " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
    + "".join(chr(code) for code in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)

PARAGRAPH_BREAK = r"\n" + BLANK + r"*\n"

WORD = r"\p{L}+"
CLITIC = r"(?i)n['’]t(?!\p{L})|['’](?:s|re|ve|ll|m|d)(?!\p{L})"
# A clitic that another one follows at once: whether it is one depends on what is taken apart first.
TOUCHING_CLITICS = r"(?i)(?:n['’]t|['’](?:s|re|ve|ll|m|d))n['’]t(?!\p{L})"
TOKEN = r"(?i)n['’]t(?!\p{L})|['’](?:s|re|ve|ll|m|d)(?!\p{L})|\p{L}+|\p{N}+|--|\.\.\.|[^\s\x0B\x1C-\x1F\x85\p{Z}\p{L}\p{N}]"
# The same where no apostrophe stands.
PLAIN_TOKEN = r"\p{L}+|\p{N}+|--|\.\.\.|[^\s\x0B\x1C-\x1F\x85\p{Z}\p{L}\p{N}]"
# The look-ahead turns most characters down in one test.
MARK = r"(?=[-.,;:?!—–…()])(?:--|\.\.\.|[,;:.?!—–…()])"
QUOTE = f"[{OPEN_QUOTE}{CLOSE_QUOTE}{STRAIGHT_QUOTE}]"

# A sentence ends after terminators and closing marks followed by white space, or at a blank line.
# The look-behind starts a match only at the first terminator, which keeps a long run of dots linear; the look-ahead turns most
# characters down in one test.
SENTENCE_BREAK = r"(?=[.!?…\n])(?:([.!?…](?<![.!?…]{2})[.!?…]*+[\"”’)]*+)" + BLANK + r"+|" + PARAGRAPH_BREAK + ")"
SENTENCE_MARK = "\x1f"


def is_blank(text: Column) -> Column:
    return F.length(F.trim(text, F.lit(BLANK_CHARS))) == 0


def has_apostrophe(text: Column) -> Column:
    return text.contains("'") | text.contains("’")


def sentence_parts(text: Column) -> Column:
    """The parts of a text between sentence ends, blank ones too."""
    marked = F.regexp_replace(F.replace(text, F.lit(SENTENCE_MARK), F.lit(" ")), SENTENCE_BREAK, "$1" + SENTENCE_MARK)
    return F.split(marked, SENTENCE_MARK)


def sentences(text: Column) -> Column:
    """Non-blank sentences of a text, in order."""
    return F.filter(sentence_parts(text), lambda s: s.rlike(FILLED))


def paragraphs(text: Column) -> Column:
    """Parts of a text between blank lines."""
    return F.split(text, PARAGRAPH_BREAK)


def token_texts(sentence: Column) -> Column:
    """Token strings of a sentence; a clitic is its own token."""
    apart = F.regexp_extract_all(F.regexp_replace(sentence, CLITIC, " $0 "), F.lit(TOKEN), F.lit(0))
    return F.when(has_apostrophe(sentence), apart).otherwise(F.regexp_extract_all(sentence, F.lit(PLAIN_TOKEN), F.lit(0)))


def word_texts(text: Column) -> Column:
    """All-letter words of a text whose clitics were already taken out."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
