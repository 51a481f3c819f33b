"""Text expressions: layouts, labels, tokens, n-grams, byte-bounded prefixes, number formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_BLANK_RUN = r"[\x20\x09-\x0D]+"
_BLANKS = " \t\n\x0b\x0c\r"
#: Greek letters with a small iota below, and the one capital that stands for each; `upper` writes two letters.
_SMALL_IOTA = "".join(chr(0x1F80 + 16 * i + j) for i in range(3) for j in range(8)) + "ᾳῃῳ"
_CAPITAL_IOTA = "".join(chr(0x1F88 + 16 * i + j) for i in range(3) for j in range(8)) + "ᾼῌῼ"


def n_bytes(text: Column) -> Column:
    """UTF-8 length; null counts as empty."""
    return F.octet_length(F.coalesce(text, F.lit(""))).cast("long")


def response_label(index: Column) -> Column:
    """Spreadsheet label of a 0-based index: A..Z, AA, AB, ... (up to six letters)."""
    start = F.struct((index.cast("long") + 1).alias("n"), F.lit("").alias("s"))
    digit = lambda n: F.char((F.lit(65) + (n - 1) % 26).cast("long"))
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(6)),
        start,
        lambda acc, _: F.when(
            acc["n"] > 0,
            F.struct(F.floor((acc["n"] - 1) / 26).cast("long").alias("n"), F.concat(digit(acc["n"]), acc["s"]).alias("s")),
        ).otherwise(acc),
        lambda acc: acc["s"],
    )


def instruct_layout(prompt: Column, responses: Column) -> Column:
    """prompt, then "Response A: ..." paragraphs."""
    parts = F.transform(responses, lambda r, i: F.concat(F.lit("\n\nResponse "), response_label(i), F.lit(": "), r))
    return F.concat(prompt, F.array_join(parts, ""))


def completion_layout(prompt: Column, responses: Column) -> Column:
    """Numbered paragraphs, each with the prompt and one response."""
    parts = F.transform(responses, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), prompt, F.lit(" "), r))
    return F.array_join(parts, "\n\n")


def utf8_prefix(text: Column, size: Column | int) -> Column:
    """The longest prefix of at most `size` bytes that ends between characters."""
    raw = F.encode(text, "UTF-8")
    size = F.lit(size) if isinstance(size, int) else size
    cuts = [F.try_validate_utf8(F.substring(raw, F.lit(1), F.greatest(size - back, F.lit(0))).cast("string")) for back in range(4)]
    return F.coalesce(*cuts)


def dot_words(text: Column) -> Column:
    """Words between single spaces, full stops and line ends removed first."""
    return F.filter(F.split(F.translate(text, ".\n", ""), " "), lambda w: w != "")


def ws_words(text: Column) -> Column:
    """Words between runs of ASCII white space."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, _BLANK_RUN))


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, joined by one space; empty if there are fewer words."""
    grams = F.transform(F.sequence(F.lit(1), F.size(words) - n + 1), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))


def collapse_blanks(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, _BLANK_RUN, " "), F.lit(" "))


def truncate_words(text: Column, size: int) -> Column:
    """At most `size` characters, cut after a whole word and marked with '...'."""
    head = F.substring(text, 1, size)
    cut = F.regexp_extract(head, r"^([\s\S]*) ", 1)
    return F.when(F.char_length(text) <= size, text).otherwise(F.concat(F.when(cut == "", head).otherwise(cut), F.lit("...")))


def token_display(token: Column) -> Column:
    """Spaces and line ends made visible."""
    return F.replace(F.replace(token, F.lit(" "), F.lit("▁")), F.lit("\n"), F.lit("↵"))


def capitalized(text: Column) -> Column:
    """The first letter as one capital: ß becomes ẞ, and a letter that only several capitals stand for stays as it is."""
    first = F.substring(text, 1, 1)
    capital = F.upper(F.translate(first, "ß" + _SMALL_IOTA, "ẞ" + _CAPITAL_IOTA))
    one = F.when(F.char_length(capital) <= 1, capital).otherwise(F.translate(first, _SMALL_IOTA, _CAPITAL_IOTA))
    return F.concat(one, F.substring(text, 2, 2**31 - 1))


def article(word: Column) -> Column:
    """The indefinite article by the first letter."""
    return F.when(F.lower(word).rlike("^[aeiou]"), F.lit("an")).otherwise(F.lit("a"))


def run_tag(model: Column) -> Column:
    """Lower-case tag of a model name: the part after the last slash, other characters as single hyphens."""
    last = F.regexp_extract(model, r"([^/]*)/?$", 1)
    return F.btrim(F.regexp_replace(F.lower(last), r"[^a-z0-9.]+", "-"), F.lit("-"))


def fill_slots(template: Column, values: Column) -> Column:
    """Each {name} replaced by values[name]; unknown names stay."""
    return F.aggregate(
        F.map_entries(values),
        template,
        lambda text, e: F.replace(text, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]),
    )


def p_value_text(p: Column) -> Column:
    """'<0.001' below that, else three decimals; '--' for null or NaN."""
    return F.when(p.isNull() | F.isnan(p), F.lit("--")).when(p < 0.001, F.lit("<0.001")).otherwise(F.format_string("%.3f", p))


def signed_text(x: Column, digits: int = 3) -> Column:
    return F.when(x.isNull() | F.isnan(x), F.lit("--")).otherwise(F.format_string(f"%+.{digits}f", x))


def safe_divide(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0 or null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
