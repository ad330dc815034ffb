"""Text maps, tokenizers and n-gram arrays as built-in column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What counts as white space (all of Unicode's, not only ASCII), and patterns that
# decide which characters belong to a token.
_BLANKS = (
    r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
SPACE, NONSPACE = f"[{_BLANKS}]", f"[^{_BLANKS}]"
SPACES = f"{SPACE}{{2,}}"
# NONSPACE as plain ranges, which Java's regular expressions read several times faster.
_SOLID = (
    r"[\x{21}-\x{84}\x{86}-\x{9f}\x{a1}-\x{167f}\x{0}-\x{8}\x{e}-\x{1b}\x{1681}-\x{1fff}\x{200b}-\x{2027}"
    r"\x{202a}-\x{202e}\x{2030}-\x{205e}\x{2060}-\x{2fff}\x{3001}-\x{10ffff}]"
)
WORD = r"[\p{L}\p{N}_]+"
WORDPUNCT = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{_BLANKS}]+"
DEFAULT_TOKEN = r"[\p{L}\p{N}_]{2,}"
MASKED = "[1-9A-Za-z]"
SENTENCE_END = f"([.!?]){SPACE}+"

CHUNK = 16384


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column whose costly expression is evaluated once per row.

    A plain projection would be inlined into the lambdas that use it and be
    evaluated again for every array element.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def collapse_spaces(text: Column) -> Column:
    """Runs of two or more white-space characters become one blank; single ones stay."""
    return F.regexp_replace(text, SPACES, " ")


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def spaced_words(text: Column) -> Column:
    """Pieces between white space."""
    return F.regexp_extract_all(text, F.lit(f"{_SOLID}+"), F.lit(0))


def wordpunct_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORDPUNCT), F.lit(0))


def default_tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(DEFAULT_TOKEN), F.lit(0))


def distort(text: Column) -> Column:
    """Mask ASCII letters and the digits 1-9; 0, accents and punctuation stay."""
    flat = F.replace(F.replace(text, F.lit("\n"), F.lit(" ")), F.lit("  "), F.lit(" "))
    return F.regexp_replace(flat, MASKED, "*")


def char_grams(text: Column, n: int) -> Column:
    """All overlapping n-grams of one length, in one linear regex pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))."), F.lit(1))


def chunks(text: Column, overlap: int, size: int = CHUNK) -> Column:
    """Cut a text into pieces of ``size`` characters, each with ``overlap`` more to read into."""
    pattern = f"(?s)(?=(.{{1,{size + overlap}}})).{{1,{size}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def chunk_grams(chunk: Column, sizes: Sequence[int], size: int | Column = CHUNK) -> Column:
    """The n-grams that start inside the first ``size`` characters of a chunk."""
    size = F.lit(size) if isinstance(size, int) else size
    one = F.lit(1)
    return F.concat(*[char_grams(F.substring(chunk, one, size + (n - 1)), n) for n in sizes])


def _shifted(tokens: Column, by: int, length: Column) -> Column:
    return F.slice(tokens, F.lit(by + 1), F.greatest(length, F.lit(0)))


def word_grams(tokens: Column, low: int, high: int) -> Column:
    """Word n-grams joined by one blank, for every length from low to high.

    ``tokens`` should be a computed column (see ``computed_once``).
    """
    def one(n: int) -> Column:
        count = F.size(tokens) - (n - 1)
        grams = _shifted(tokens, 0, count)
        for i in range(1, n):
            grams = F.zip_with(
                grams, _shifted(tokens, i, count), lambda a, b: F.concat(a, F.lit(" "), b)
            )
        return grams

    return F.concat(*[one(n) for n in range(low, high + 1)])


def skip_bigrams(tokens: Column, span: int) -> Column:
    """Pairs of tokens ``span`` places apart, joined by an underscore."""
    count = F.size(tokens) - span
    return F.zip_with(
        _shifted(tokens, 0, count),
        _shifted(tokens, span, count),
        lambda a, b: F.concat(a, F.lit("_"), b),
    )


def sentences(text: Column) -> Column:
    """Split after . ! ? followed by white space; empty pieces are dropped."""
    parts = F.split(F.regexp_replace(text, SENTENCE_END, "$1\u0001"), "\u0001")
    return F.filter(parts, lambda s: s.rlike(NONSPACE))


def occurrences(text: Column, piece: Column) -> Column:
    """Number of non-overlapping occurrences of a substring."""
    return (F.length(text) - F.length(F.replace(text, piece, F.lit("")))) / F.length(piece)
