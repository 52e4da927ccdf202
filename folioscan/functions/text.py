"""Text functions. Lengths are code points unless a name says bytes; the two are never mixed."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Between words: anything but letters and digits.
SEPARATORS = r"[^\p{L}\p{N}]+"
#: Bytes of a snippet on either side of the term, and of the opening shown when the term is absent.
SIDE, OPENING = 24, 48


def tokens(text: Column, stop_words: Sequence[str] = (), separators: str = SEPARATORS) -> Column:
    """Words in order, repeats included, without words of a single byte or stop words; case is kept."""
    words = F.filter(F.split(text, separators), lambda t: F.octet_length(t) > 1)
    return F.filter(words, lambda t: ~t.isin(*stop_words)) if stop_words else words


def child_text(value: Column) -> Column:
    """The text of a child element, or nothing."""
    return F.coalesce(value, F.lit(""))


def trim_padding(value: Column) -> Column:
    """Without trailing NUL and blank padding."""
    return F.regexp_replace(value, "[\\x00 ]+$", "")


def dicom_date(value: Column) -> Column:
    """YYYYMMDD as a date; anything else is null."""
    return F.when(F.rlike(value, F.lit("^[0-9]{8}$")), F.try_to_date(value, "yyyyMMdd"))


def sex(value: Column) -> Column:
    return F.when(value.isin("M", "F", "O"), value)


def search_ngrams(word: Column) -> Column:
    """Pairs of a word longer than two, triples of one longer than three, then the word."""
    grams = lambda n: F.when(F.char_length(word) > n, F.transform(F.sequence(F.lit(1), F.char_length(word) - n + 1), lambda i: F.substring(word, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.concat(grams(2), grams(3), F.array(word))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value evaluated once."""
    return F.transform(F.array(value), then)[0]


def snippet(text: Column, term: Column) -> Column:
    """The bytes around the first place of term, whole code points, with dots where text goes on; its opening if the
    term is absent, nothing if either is empty."""
    coded, size = F.hex(F.encode(text, "UTF-8")), F.octet_length(text)

    def edge(at: Column, step: int) -> Column:
        """A byte position moved on, or back, to the start of a code point: past at most three bytes that continue one."""
        inside = lambda k: F.substring(coded, 2 * (at + k * step) + 1, F.lit(1)).isin("8", "9", "A", "B")
        return at + step * F.when(~inside(0), 0).when(~inside(1), 1).when(~inside(2), 2).otherwise(3)

    part = lambda a, b: F.decode(F.unhex(F.substring(coded, 2 * a + 1, 2 * (b - a))), "UTF-8")
    dots = lambda flag: F.when(flag, F.lit("...")).otherwise(F.lit(""))
    place = F.call_function("locate", term, text)
    begin = F.greatest(F.octet_length(F.substring(text, F.lit(1), place - 1)) - SIDE, F.lit(0))
    span = lambda low, high: F.concat(dots(low > 0), part(low, high), dots(high < size))
    around = let(begin, lambda b: let(edge(b, -1), lambda low: let(F.least(size, low + F.octet_length(term) + 2 * SIDE), lambda h: let(edge(h, 1), lambda high: span(low, high)))))
    opening = let(F.least(size, F.lit(OPENING)), lambda e: let(edge(e, -1), lambda end: F.concat(part(F.lit(0), end), dots(size > end))))
    return F.when((size == 0) | (F.octet_length(term) == 0), F.lit("")).when(place > 0, around).otherwise(opening)


def binary_string(value: Column) -> Column:
    """64 binary digits of a long's bit pattern."""
    return F.lpad(F.bin(value), 64, "0")


def from_binary_string(value: Column) -> Column:
    """The long that has these bits."""
    return F.conv(value, 2, -10).cast("long")


def unsigned(value: Column) -> Column:
    """A long's bit pattern as an unsigned decimal."""
    return F.conv(F.hex(value), 16, 10)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def masked(value: Column) -> Column:
    """A secret for display."""
    return F.when(F.length(value) > 0, F.lit("******")).otherwise(F.lit(""))


def storage_path(study: Column, series: Column, instance: Column) -> Column:
    return F.concat(F.concat_ws("/", study, series, instance), F.lit(".dcm"))
