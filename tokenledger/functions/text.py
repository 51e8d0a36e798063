"""Text columns: whitespace, JSON, lengths, entropy and token counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The white space characters of the log's own text rules (wider than Java's \s).
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"

# The same characters as plain text, for functions that take a set of characters.
SPACE_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)

# Fixed value: a run of this many equal characters makes token counting fall back to the estimate.
LONG_RUN = 300

# Fixed value: the published split pattern of the cl100k encoding, with white space spelled out.
PRETOKEN_PATTERN = (
    r"(?i:'s|'t|'re|'ve|'m|'ll|'d)|[^\r\n\p{L}\p{N}]?\p{L}+|\p{N}{1,3}"
    rf"| ?[^{SPACE}\p{{L}}\p{{N}}]+[\r\n]*|[{SPACE}]*[\r\n]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)


def text_length(content: Column) -> Column:
    """Length in UTF-16 units. Plain ASCII, the common case, needs no re-encoding."""
    chars = F.length(content)
    return F.when(F.octet_length(content) == chars, chars).otherwise(
        (F.octet_length(F.encode(content, "UTF-16BE")) / 2).cast("int")
    )


def trim_space(content: Column) -> Column:
    """Strip white space at both ends."""
    return F.btrim(content, F.lit(SPACE_CHARS))


def squeeze_space(content: Column) -> Column:
    """Runs of blanks to one space, three or more line ends to two, then trim.

    A single space would be replaced by itself, so only longer runs and tabs are, and texts without any are left alone.
    """
    wide = F.contains(content, F.lit("  ")) | F.contains(content, F.lit("\t"))
    one_space = F.when(wide, F.regexp_replace(content, r"[ \t]{2,}|\t", " ")).otherwise(content)
    two_lines = F.regexp_replace(one_space, rf"\n[{SPACE}]*\n[{SPACE}]*\n+", "\n\n")
    return trim_space(two_lines)


def minify_json(content: Column) -> Column:
    """Drop white space outside strings if the text is a JSON object or array, else leave it unchanged."""
    looks_json = F.startswith(content, F.lit("{")) | F.startswith(content, F.lit("["))
    valid = F.when(looks_json, F.try_parse_json(content)).isNotNull()
    compact = F.regexp_replace(content, r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|[ \t\r\n]+', "$1")
    return F.when(valid, compact).otherwise(content)


def with_compressed(df: DataFrame, column: str, name: str) -> DataFrame:
    """Add ``name``: white space compression, then JSON minification, of ``column``.

    Two steps, as the second one uses the result of the first several times.
    """
    return (
        df.withColumn("_squeezed", squeeze_space(F.col(column)))
        .withColumn(name, minify_json(F.col("_squeezed")))
        .drop("_squeezed")
    )


def entropy(token: Column) -> Column:
    """Shannon entropy of a string in bits per character."""
    size = F.length(token).cast("double")
    shares = F.transform(
        F.array_distinct(F.split(token, "")),
        lambda c: (size - F.length(F.replace(token, c, F.lit("")))) / size,
    )
    return F.aggregate(shares, F.lit(0.0), lambda total, p: total - p * F.log2(p))


def has_long_run(content: Column) -> Column:
    """True if one character of the basic plane repeats ``LONG_RUN`` times in a row."""
    return F.rlike(content, F.lit(rf"(?s)([\u0000-\uFFFF])\1{{{LONG_RUN - 1}}}"))


def estimate_tokens(content: Column) -> Column:
    """A quarter of the length, rounded up."""
    return F.ceil(text_length(content) / 4).cast("int")


def pretoken_count(content: Column) -> Column:
    """Pieces of the split pattern: a native lower bound of the exact count."""
    return F.regexp_count(content, F.lit(PRETOKEN_PATTERN)).cast("int")


def token_count(content: Column, mode: str = "estimate") -> Column:
    """Tokens of a text; empty text has none, long runs are always estimated."""
    if mode == "estimate":
        counted = estimate_tokens(content)
    elif mode == "pretoken":
        counted = F.when(has_long_run(content), estimate_tokens(content)).otherwise(pretoken_count(content))
    else:
        raise ValueError(f"no native token mode {mode!r}")
    return F.when(F.coalesce(content, F.lit("")) == "", F.lit(0)).otherwise(counted)
