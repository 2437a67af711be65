"""Text normalisation profiles: one table of choices, a native column form and a Python twin."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .regexjs import WS

# --- fixed values: character classes and folds of the eight normalisers ---
MARKS_WIDE = r"\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}"
MARKS_TITLE = r"\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}"
MARKS_DIWAN = r"\x{064B}-\x{065F}\x{0670}\x{0640}"
TATWEEL = r"\x{0640}"
BIDI = r"\x{200E}\x{200F}\x{202A}-\x{202E}"
ARABIC_DIGIT_SPACE = r"[^\x{0621}-\x{063A}\x{0641}-\x{064A}0-9 ]"
DIWAN_PUNCTUATION = r"""[\[\]{}()"'`*_،؛:!?.,/\\|+\-=—–]"""
NOT_LETTER_NUMBER = r"[^\p{L}\p{N}]+"
FOLD_SEARCH = {"أ": "ا", "إ": "ا", "آ": "ا", "ى": "ي", "ة": "ه", "ؤ": "و", "ئ": "ي"}
FOLD_TITLE = {"إ": "ا", "أ": "ا", "آ": "ا", "ٱ": "ا", "ى": "ي", "ؤ": "و", "ئ": "ي"}
FOLD_DIWAN = {"إ": "ا", "أ": "ا", "آ": "ا", "ٱ": "ا", "ؤ": "و", "ئ": "ي", "ى": "ي", "ة": "ه"}
FOLD_NO_TEH = {k: v for k, v in FOLD_DIWAN.items() if k != "ة"}
FOLD_LATIN = dict(zip("éèêëàâäáîïíôöóûüúùçñãõå", "eeeeaaaaiiiooouuuucnaoa", strict=True))


@dataclass(frozen=True)
class Profile:
    """Steps in order: case, NFKC, spaces, deletion of marks, folds, deletion, replacement by a space, spaces, case."""

    name: str
    nfkc: bool = True
    squeeze_first: bool = False
    lower_first: bool = False
    delete: str = ""
    fold: tuple[tuple[str, str], ...] = ()
    delete_after: str = ""
    blank: str = ""

    def key(self) -> str:
        return self.name


def _p(name, fold, **more) -> Profile:
    return Profile(name, fold=tuple(fold.items()), **more)


SEARCH = _p("search", FOLD_SEARCH, delete=MARKS_WIDE, blank=ARABIC_DIGIT_SPACE)
CATALOG_TITLE = _p("catalog_title", FOLD_TITLE, delete=MARKS_TITLE, delete_after=TATWEEL)
IMPORT = _p("import", FOLD_SEARCH, delete=MARKS_WIDE, delete_after=TATWEEL, blank=ARABIC_DIGIT_SPACE)
THESIS = _p("thesis", FOLD_SEARCH, delete=MARKS_WIDE, blank=ARABIC_DIGIT_SPACE)
DIWAN = _p("diwan", FOLD_DIWAN, squeeze_first=True, delete=MARKS_DIWAN, delete_after=BIDI, blank=DIWAN_PUNCTUATION)
UPLOAD = _p("upload", FOLD_DIWAN, squeeze_first=True, delete=MARKS_DIWAN, delete_after=BIDI, blank=DIWAN_PUNCTUATION)
REFINE = _p("refine", FOLD_DIWAN, squeeze_first=True, delete=MARKS_DIWAN, delete_after=BIDI, blank=NOT_LETTER_NUMBER)
LIGHT_BUILDER = _p("light_builder", FOLD_DIWAN, delete=MARKS_DIWAN, blank=DIWAN_PUNCTUATION)
LIGHT_QUALITY = _p("light_quality", FOLD_NO_TEH, delete=MARKS_DIWAN)
LIGHT_TITLE = _p("light_title", FOLD_DIWAN, nfkc=False, delete=MARKS_DIWAN)
LIGHT_PORT = _p("light_port", FOLD_DIWAN, nfkc=False, lower_first=True, delete=MARKS_DIWAN, blank=NOT_LETTER_NUMBER)
#: For tables in Latin script: accents folded, all but a-z and digits blanked.
LATIN = _p("latin", FOLD_LATIN, nfkc=False, lower_first=True, blank="[^a-z0-9 ]")
PROFILES = {p.name: p for p in (SEARCH, CATALOG_TITLE, IMPORT, THESIS, DIWAN, UPLOAD, REFINE, LIGHT_BUILDER, LIGHT_QUALITY, LIGHT_TITLE, LIGHT_PORT, LATIN)}

@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """NFKC, which Spark has no function for; ASCII texts are passed through."""
    return texts.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))


def squeeze(text: Column) -> Column:
    """White space runs to one space, trimmed, with ECMAScript's idea of white space."""
    return F.trim(F.regexp_replace(text, WS + "+", " "))


def normalize(text: Column, profile: Profile) -> Column:
    """``text`` under a profile; null stays null."""
    out = text
    if profile.lower_first:
        out = F.lower(out)
    if profile.squeeze_first:
        out = squeeze(out)
    if profile.nfkc:
        out = nfkc(out)
    if profile.delete:
        out = F.regexp_replace(out, f"[{profile.delete}]", "")
    if profile.fold:
        out = F.translate(out, "".join(a for a, _ in profile.fold), "".join(b for _, b in profile.fold))
    if profile.delete_after:
        out = F.regexp_replace(out, f"[{profile.delete_after}]", "")
    if profile.blank.startswith("[^"):
        # what is not kept, white space included, becomes one space a run: one pass instead of one match for each character
        kept = profile.blank.rstrip("+")[2:-1].rstrip(" ")
        return F.lower(F.trim(F.regexp_replace(out, f"[^{kept}]+", " ")))
    if profile.blank:
        out = F.regexp_replace(F.regexp_replace(out, WS, " "), profile.blank, " ")
    return F.lower(squeeze(out))


_SPACE = re.compile(r"[ \t-\r\u00a0\ufeff\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")


def _python(java: str) -> str:
    return re.sub(r"\\x\{([0-9A-Fa-f]{4})\}", r"\\u\1", java)


def _blank(java: str, text: str) -> str:
    if java == NOT_LETTER_NUMBER:
        return "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text)
    return re.sub(_python(java), " ", text)


def py_normalize(text: str | None, profile: Profile) -> str | None:
    """The same in Python, for queries on the driver and for tests."""
    if text is None:
        return None
    sq = lambda t: re.sub(_SPACE.pattern + "+", " ", t).strip(" ")
    out = text.lower() if profile.lower_first else text
    if profile.squeeze_first:
        out = sq(out)
    if profile.nfkc:
        out = unicodedata.normalize("NFKC", out)
    if profile.delete:
        out = re.sub(f"[{_python(profile.delete)}]", "", out)
    out = out.translate(str.maketrans(dict(profile.fold)))
    if profile.delete_after:
        out = re.sub(f"[{_python(profile.delete_after)}]", "", out)
    if profile.blank:
        out = _blank(profile.blank, _SPACE.sub(" ", out))
    return sq(out).lower()


def duckdb_latin(column: str) -> str:
    """SQL of the LATIN profile."""
    return f"trim(regexp_replace(regexp_replace(translate(lower({column}), '{''.join(FOLD_LATIN)}', '{''.join(FOLD_LATIN.values())}'), '[^a-z0-9]', ' ', 'g'), ' +', ' ', 'g'))"
