"""Text normalisation and untrusted-text screening as column expressions."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from trustmill.config import ABBREVIATIONS, CITY_ALIASES, CONFUSABLES, INJECTION_PATTERNS, STOPWORDS
from trustmill.functions.binding import let

#: White space as web texts use it; Java's \s and trim() know only the ASCII part.
SPACE = r"\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
#: ASCII word boundaries, so that a neighbouring accented letter does not hide a word.
START, END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
EDITION_WORDS = r"(?:[0-9]+(?:st|nd|rd|th)\s+edition|edition|hackathon|hack|summit|fest|challenge)"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def collapsed(c: Column) -> Column:
    return trimmed(F.regexp_replace(c, f"[{SPACE}]+", " "))


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, rf"[^\p{{L}}\p{{N}}{SPACE}]", " ")


def normalize_title(title: Column) -> Column:
    plain = _bare(F.lower(title))
    undated = F.regexp_replace(plain, f"{START}(?:20[0-9]{{2}}|2k[0-9]{{2}}){END}", " ")
    return collapsed(F.regexp_replace(undated, START + EDITION_WORDS + END, " "))


def expand_abbreviations(title: Column) -> Column:
    out = F.concat(F.lit(" "), F.lower(title), F.lit(" "))
    for short, full in ABBREVIATIONS.items():
        out = F.regexp_replace(out, f"{START}{short}{END}", f" {full} ")
    return out


def similarity(a: Column, b: Column) -> Column:
    """1 - distance / length over normal titles that are ready for it; 0 if one is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), 0.0).when(a == b, 1.0).otherwise(1.0 - F.levenshtein(a, b) / longest)


def title_similarity(a: Column, b: Column) -> Column:
    return similarity(normalize_title(expand_abbreviations(a)), normalize_title(expand_abbreviations(b)))


def normalize_organizer(name: Column) -> Column:
    named = F.regexp_replace(F.lower(name), START + r"govt\.?(?=[A-Za-z0-9_])|" + START + r"govt(?![A-Za-z0-9_])", "government")
    words = START + r"(?:univ\.(?=[A-Za-z0-9_])|(?:univ|university|institute of technology|institute|college|official)(?![A-Za-z0-9_]))"
    return collapsed(_bare(F.regexp_replace(named, words, " ")))


def normalize_city(city: Column) -> Column:
    own = trimmed(city)
    aliases = F.create_map(*(F.lit(x) for pair in CITY_ALIASES.items() for x in pair))
    return F.coalesce(F.try_element_at(aliases, F.lower(own)), own)


def significant_tokens(text: Column) -> Column:
    """Words of more than three letters or digits that say something."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "), r"\s+")
    return F.filter(words, lambda w: (F.length(w) > 3) & ~w.isin(list(STOPWORDS)))


def token_overlap(tokens: Column, page: Column) -> Column:
    """The share of the tokens that a page's text holds; 0 without tokens."""
    hits = F.size(F.filter(tokens, lambda w: F.contains(page, w)))
    return F.when(F.size(tokens) == 0, 0.0).otherwise(hits / F.greatest(F.size(tokens), F.lit(1)))


def is_ascii(c: Column) -> Column:
    return c.rlike(r"\A\p{ASCII}*\z")


@functools.cache
def _compatible():
    @F.pandas_udf("array<string>")
    def nfkd(texts: pd.Series) -> pd.Series:
        return texts.map(lambda some: [None if x is None else unicodedata.normalize("NFKD", x) for x in some])

    return nfkd


def fold_all(texts: Column) -> Column:
    """An array's texts after compatibility decomposition, lookalikes as Latin letters, everything else outside ASCII as
    U+FFFD. To be used in a projection, not inside a lambda.

    Spark has no normalisation of Unicode, so that step is a pandas UDF; ASCII texts are not sent there. A character
    beyond the basic plane counts as the two halves that it is stored in.
    """
    wide = F.transform(texts, lambda c: F.when(~is_ascii(c), c))

    def plain(c: Column, n: Column) -> Column:
        halves = F.regexp_replace(F.translate(n, *CONFUSABLES), r"[\x{10000}-\x{10FFFF}]", "\uFFFD\uFFFD")
        return F.when(is_ascii(c), c).otherwise(F.regexp_replace(halves, r"[^\x00-\x7F]", "\uFFFD"))

    return F.zip_with(texts, _compatible()(wide), plain)


def fold_confusables(c: Column) -> Column:
    """One text folded as in `fold_all`."""
    return fold_all(F.array(c))[0]


#: Words without which a pattern of INJECTION_PATTERNS cannot match, in their order; looking for them is far cheaper.
NEEDED = (
    ("ignore", "previous", "instructions"), ("ignore", "your", "instructions"), ("send",), ("disregard", "instructions"), ("you", "are", "now"), ("execute",), ("download",),
    ("enter", "register"), ("system", ":", "you"), ("[system]",), ("<", ">"),
)


def _hits(c: Column, low: Column) -> list[Column]:
    """Whether each pattern is in a text; low is the text in lower case."""
    needed = lambda words: functools.reduce(lambda a, b: a & b, (F.contains(low, F.lit(w)) for w in words))
    return [needed(words) & c.rlike(f"(?i){p}") for words, p in zip(NEEDED, INJECTION_PATTERNS, strict=True)]


def _found(c: Column, folded: Column | None, then: Callable[[Column], Column]) -> Column:
    """then(array of the patterns found in the text or the folded text), with texts in lower case computed once."""
    texts = F.struct(c.alias("c"), F.lower(c).alias("c_low"), *(() if folded is None else (F.when(folded != c, folded).alias("f"), F.when(folded != c, F.lower(folded)).alias("f_low"))))

    def patterns(t: Column) -> Column:
        hits = _hits(t["c"], t["c_low"])
        if folded is not None:
            hits = [F.coalesce(a, F.lit(False)) | F.coalesce(b, F.lit(False)) for a, b in zip(hits, _hits(t["f"], t["f_low"]), strict=True)]
        return F.array_compact(F.array(*(F.when(h, F.lit(p)) for h, p in zip(hits, INJECTION_PATTERNS, strict=True))))

    return let(texts, lambda t: let(patterns(t), then))


def contains_injection(c: Column, folded: Column | None = None) -> Column:
    """Whether a text looks like instructions to its reader. folded: the text after fold_confusables, if it matters."""
    return F.when(c.isNotNull(), _found(c, folded, lambda p: F.size(p) > 0))


def sanitize(c: Column, folded: Column | None = None, most: int = 4000) -> Column:
    """struct(text, flagged, patterns): instructions taken out or the text marked, control characters dropped, cut."""

    def cleaned(patterns: Column) -> Column:
        removed = c
        for p in INJECTION_PATTERNS:  # in turn: what one leaves may be found by the next
            removed = F.regexp_replace(removed, f"(?i){p}", "[REMOVED_INSTRUCTION]")
        flagged = F.size(patterns) > 0
        marked = F.when(flagged, let(removed, lambda r: F.when(r == c, F.concat(F.lit("[QUARANTINED_INSTRUCTION] "), c)).otherwise(r))).otherwise(c)
        printable = F.regexp_replace(marked, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
        cut = let(printable, lambda t: F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("\u2026"))).otherwise(t))
        return F.struct(trimmed(cut).alias("text"), flagged.alias("flagged"), patterns.alias("patterns"))

    return _found(c, folded, cleaned)


def redact_secrets(c: Column) -> Column:
    """Tokens and keys as log lines must not show them."""
    out = F.regexp_replace(c, r"(?<![0-9A-Za-z_])[0-9]{8,10}:[A-Za-z0-9_-]{30,}", "[REDACTED]")
    out = F.regexp_replace(out, r"xox[baprs]-[A-Za-z0-9-]+", "[REDACTED]")
    out = F.regexp_replace(out, r"gh[pousr]_[A-Za-z0-9]{20,}", "[REDACTED]")
    return F.regexp_replace(out, r"(?i)(api[_-]?key|token|secret|password)(\s*[=:]\s*)([^\s,;]+)", "$1$2[REDACTED]")
