"""Persian text: forms that read alike become one, and compounds joined by a half-space count joined and split.

All but the compatibility composition (nfkc, for texts beyond ASCII) are built-in functions.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import nfkc, ngrams_of

#: The half-space, a joiner within words.
HALF_SPACE = "‌"

#: Arabic letters by their Unicode names that Persian writes as another one, or not at all (fixed values).
_WRITTEN_AS = {
    "YEH": "FARSI YEH",
    "KAF": "KEHEH",
    "TEH MARBUTA": "HEH",
    "AE": "HEH",
    "ALEF WASLA": "ALEF",
    "HAMZA": "",
}
#: Frequent words without content (fixed values, our own choice).
STOP_WORDS = ("از", "به", "در", "با", "که", "را", "این", "ان", "و", "یا", "تا", "هم", "بر", "برای", "است", "بود", "شد", "هر", "اما", "اگر")


def _letter(name: str) -> str:
    return unicodedata.lookup(f"ARABIC LETTER {name}")


def _tables() -> tuple[str, str]:
    """Letters and digits and what they become; those that go come last, as translate() drops what has no counterpart."""
    written = {_letter(a): _letter(b) if b else "" for a, b in _WRITTEN_AS.items()}
    bases = {*written, _letter("ALEF"), _letter("WAW")}
    # letters that Unicode composes from one of these and a mark are read without the mark
    for c in map(chr, range(0x0600, 0x0700)):
        base = unicodedata.normalize("NFD", c)[0]
        if base != c and base in bases:
            written[c] = written.get(base, base)
    for c in map(chr, range(0x0600, 0x0700)):
        if unicodedata.category(c) == "Nd":
            written[c] = str(unicodedata.digit(c))
    # vowel signs and other marks on letters, and the stroke that lengthens a word
    for c in [chr(x) for x in (*range(0x064B, 0x0656), 0x0670)] + [unicodedata.lookup("ARABIC TATWEEL")]:
        written[c] = ""
    kept = [c for c in written if written[c]]
    return "".join(kept) + "".join(c for c in written if not written[c]), "".join(written[c] for c in kept)


FROM, TO = _tables()


def normalize(text: Column) -> Column:
    """Composed, with Persian letters and ASCII digits, without marks; blanks, tabs and no-break spaces collapsed. Null stays null; doing it twice changes nothing."""
    return F.trim(F.regexp_replace(F.translate(nfkc(text), FROM, TO), "[ \t ]+", " "))


def tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case runs of letters and digits of two characters or more, without stop words; null gives an empty array.

    A compound with half-spaces is one token without them, followed by its parts.
    """
    run = r"[\p{L}\p{N}]+"
    words = F.regexp_extract_all(F.lower(F.coalesce(normalize(text), F.lit(""))), F.lit(f"{run}(?:{HALF_SPACE}{run})*"), F.lit(0))
    parts = lambda w: F.split(w, HALF_SPACE)
    both = F.flatten(F.transform(words, lambda w: F.when(F.contains(w, F.lit(HALF_SPACE)), F.concat(F.array(F.replace(w, F.lit(HALF_SPACE), F.lit(""))), parts(w))).otherwise(F.array(w))))
    return F.filter(both, lambda t: (F.length(t) >= 2) & ~t.isin(*stop_words) if stop_words else F.length(t) >= 2)


def char_ngrams(normal: Column, n: int = 4) -> Column:
    """All sequences of n characters of a text that normalize() made, in lower case without half-spaces; a shorter text is its own only one.

    It takes the normalised text as a column of its own, since functions of array elements cannot hold nfkc().
    """
    t = F.regexp_replace(F.lower(F.replace(F.coalesce(normal, F.lit("")), F.lit(HALF_SPACE), F.lit(""))), r"\s+", " ")
    return ngrams_of(t, n)
