"""Line-first cleaning (native): rules per line, failed lines go, then documents that lost too much text go.

Only DataFrame functions: every document is handled within its own row, so nothing is shuffled and a hot source or
a group of copies costs as much as its rows.

Defined results: a null or empty text has no words, no lines and fails the base rules (under 50 words). Blank lines are
never failures and never count as lost text. Ties and repeated rows are each judged alone. Columns of the input that
clash with the working names stay untouched, since working columns take spare names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from farness.llm.common import BLANK_CLASS, BLANKS, spare, steady

#: Characters that count as symbols in the base counts.
SYMBOLS = "#*$%&|<>"
#: Characters that end or part sentences.
STOPS = ".!?;:,。！？"
#: What separates the entries of a navigation line.
NAVIGATION = (" | ", " > ", " » ", " · ", " / ")
#: Lower-case phrases of page furniture.
BOILERPLATE = (
    "accept cookies", "all rights reserved", "click here", "cookie policy", "enable javascript", "log in to", "privacy policy",
    "sign up for", "skip to content", "subscribe to our", "terms of service", "terms of use",
)
UPPER = "".join(map(chr, [*range(0x41, 0x5B), *range(0xC0, 0xD7), *range(0xD8, 0xDF)]))


@dataclass(frozen=True)
class LineRules:
    """Shares are of a line's characters; a document goes if less than min_kept of its characters in lines is left."""

    max_symbols: float = 0.05
    max_upper: float = 0.5
    upper_from: int = 12
    max_shouts: float = 0.03
    shouts_from: int = 3
    nav_from: int = 3
    unstopped_words: int = 20
    min_kept: float = 0.7


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def words_of(text: Column) -> Column:
    """The array of words; empty for null, empty or blank texts."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) > 0, F.split(bare, BLANK_CLASS + "+")).otherwise(F.array().cast("array<string>"))


def line_fails(line: Column, rules: LineRules) -> Column:
    """The punctuation, navigation and boilerplate rules; a blank line never fails."""
    size = F.length(line)
    low = F.lower(line)
    separators = sum(((size - F.length(F.replace(line, F.lit(s), F.lit("")))) / len(s) for s in NAVIGATION[1:]), (size - F.length(F.replace(line, F.lit(NAVIGATION[0]), F.lit("")))) / len(NAVIGATION[0]))
    furniture = F.lit(False)
    for phrase in BOILERPLATE:
        furniture = furniture | F.contains(low, F.lit(phrase))
    shouts = count_of(line, "!")
    return (
        (count_of(line, SYMBOLS) > rules.max_symbols * size)
        | ((size >= rules.upper_from) & (count_of(line, UPPER) > rules.max_upper * size))
        | ((shouts >= rules.shouts_from) & (shouts > rules.max_shouts * size))
        | (separators >= rules.nav_from)
        | ((count_of(line, " ") >= rules.unstopped_words) & (count_of(line, STOPS) == 0))
        | furniture
    )


def near_capitals(rules: LineRules) -> str:
    """A pattern found in every line that fails for its capitals: two of them with at most so many characters between.

    With more than k between any two, a line of n characters has at most (n + k + 1) / (k + 2) capitals; k is the least for
    which that isn't over max_upper * n from upper_from characters on. If one capital can be enough, it is one.
    """
    capital, least = "[A-Z\u00c0-\u00d6\u00d8-\u00de]", max(rules.upper_from, 1) * rules.max_upper
    if least <= 1:
        return capital
    k = max(0, math.ceil((1 + max(rules.upper_from, 1) - 2 * least) / (least - 1)))
    return f"{capital}[^\\n]{{0,{k}}}{capital}"


def may_fail(text: Column, symbols: Column, rules: LineRules) -> Column:
    """False only where no line of the text can fail: what a failing line must have isn't in the whole text.

    A line of capitals for more than half has two with at most one character between; an unstopped line has its words between
    line ends without a stop.
    """
    out = (symbols > 0) | F.contains(text, F.lit("!")) | F.rlike(text, F.lit(near_capitals(rules)))
    for s in NAVIGATION:
        out = out | F.contains(text, F.lit(s))
    out = out | F.rlike(F.lower(text), F.lit("|".join(BOILERPLATE)))
    plain = f"[^\\n {STOPS}]*+"
    return out | F.rlike(text, F.lit(f"(?:^|\\n){plain}(?: {plain}){{{rules.unstopped_words},}}+(?:\\n|$)"))


def window_places(hashes: Column) -> Column:
    """(hash, place) of every window, sorted: packed into one number each, whose low bits have the place.

    From 1 << 20 windows on, where too few bits of the hash would be left, they are sorted whole and only the places stay.
    """
    low = place_bits(hashes)
    packed = F.sort_array(F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long"))))
    return F.when(F.size(hashes) < 1 << 20, packed).otherwise(whole_places(hashes))


def whole_places(hashes: Column) -> Column:
    """The places of the windows in the order of their whole hashes."""
    return F.transform(F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("i")))), lambda x: x["i"])


def mingled(hashes: Column, packed: Column) -> Column:
    """Whether windows of different hashes lie beside each other that agree in all bits which the packed numbers keep."""
    low = place_bits(hashes)
    place = lambda x: x.bitwiseAND(low).cast("int")
    near = lambda x, y: (x.bitwiseXOR(y) <= low) & (x.bitwiseXOR(y) >= 0) & (F.get(hashes, place(x)) != F.get(hashes, place(y)))
    return F.exists(F.transform(packed, lambda x, j: F.coalesce(near(x, F.get(packed, j + 1)), F.lit(False))), lambda x: x)


def place_bits(hashes: Column) -> Column:
    return F.when(F.size(hashes) < 1 << 20, F.lit((1 << 20) - 1).cast("long")).otherwise(F.lit((1 << 31) - 1).cast("long"))


def repeated_words(hashes: Column, packed: Column) -> Column:
    """Words that lie in a window found twice or more; neighbours by the packed number are compared by their whole hashes."""
    low = place_bits(hashes)
    place = lambda x: x.bitwiseAND(low).cast("int")
    near = lambda x, y: (x.bitwiseXOR(y) <= low) & (x.bitwiseXOR(y) >= 0)
    same = lambda x, y: F.coalesce(near(x, y) & (F.get(hashes, place(x)) == F.get(hashes, place(y))), F.lit(False))
    found = F.filter(packed, lambda x, j: same(x, F.get(packed, j - 1)) | same(x, F.get(packed, j + 1)))
    covered = F.flatten(F.transform(found, lambda x: F.array(place(x), place(x) + 1, place(x) + 2)))
    return F.size(F.array_distinct(covered)).cast("long")


def repeated_in_order(hashes: Column, places: Column) -> Column:
    """repeated_words() for places in the order of the whole hashes."""
    at = lambda x: F.get(hashes, x.cast("int"))
    found = F.filter(places, lambda x, j: F.coalesce(at(x) == at(F.get(places, j - 1)), F.lit(False)) | F.coalesce(at(x) == at(F.get(places, j + 1)), F.lit(False)))
    covered = F.flatten(F.transform(found, lambda x: F.array(x, x + 1, x + 2)))
    return F.size(F.array_distinct(covered)).cast("long")


def line_first(docs: DataFrame, text: str = "text", rules: LineRules = LineRules()) -> DataFrame:
    """docs plus the base counts, base_failed, kept, clean_text (the lines that stay), n_lines_failed and kept_chars.

    New columns take spare names where docs has columns of those names already; they come last, in this order:
    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text, n_lines_failed, kept_chars.
    """
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "clean_text", "n_lines_failed", "kept_chars")
    out = dict(zip(names, spare(docs, *names), strict=True))
    w, ls, hs, ws, ok, dl, whole = spare(docs, "_w", "_ls", "_hs", "_ws", "_ok", "_dl", "_whole")
    t = F.coalesce(F.col(text), F.lit(""))
    df = docs.select("*", words_of(F.col(text)).alias(w), F.split(t, "\n", -1).alias(ls), F.when(F.rlike(t, F.lit(f"[{SYMBOLS}]")), count_of(t, SYMBOLS)).otherwise(F.lit(0)).cast("long").alias(out["n_symbols"]))
    n = F.size(w)
    df = df.select(
        "*",
        F.when(n >= 3, F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))).otherwise(F.array().cast("array<bigint>")).alias(hs),
        F.when(may_fail(t, F.col(out["n_symbols"]), rules), F.filter(ls, lambda x: ~line_fails(x, rules))).otherwise(F.col(ls)).alias(ok),
        F.filter(ls, lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0).alias(dl),
    )
    df = df.select("*", F.when(F.size(F.array_distinct(hs)) < F.size(hs), window_places(F.col(hs))).alias(ws), F.concat_ws("\n", ok).alias(out["clean_text"]))
    # equal windows may be parted by others that only the low bits tell from them
    again = F.when((F.size(hs) < 1 << 20) & mingled(F.col(hs), F.col(ws)), repeated_in_order(F.col(hs), whole_places(F.col(hs)))).otherwise(repeated_words(F.col(hs), F.col(ws)))
    repeat = F.when(F.col(ws).isNull(), F.lit(0).cast("long")).otherwise(again)
    df = df.select(
        "*",
        n.cast("long").alias(out["n_words"]),
        F.length(F.concat_ws("", w)).cast("long").alias(out["word_chars"]),
        (F.size(dl) - F.size(F.array_distinct(dl))).cast("long").alias(out["n_dup_lines"]),
        repeat.alias(out["n_repeat_words"]),
        (F.size(ls) - F.size(ok)).cast("long").alias(out["n_lines_failed"]),
        (F.length(out["clean_text"]) - F.greatest(F.size(ok) - 1, F.lit(0))).cast("long").alias(out["kept_chars"]),
        (F.length(t) - (F.size(ls) - 1)).cast("long").alias(whole),
    )
    failed = (F.col(out["n_words"]) < 50) | (100 * F.col(out["n_repeat_words"]) > 50 * F.col(out["n_words"]))
    df = df.select("*", failed.alias(out["base_failed"]))
    df = df.select("*", steady(~F.col(out["base_failed"]) & (F.col(out["kept_chars"]) >= rules.min_kept * F.col(whole))).alias(out["kept"]))
    return df.select(*[F.col(f"`{c}`") for c in docs.columns], *[F.col(f"`{out[x]}`") for x in names])
