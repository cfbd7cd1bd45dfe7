"""Folding of letters to ASCII, by tables made from Unicode's own data.

What one ASCII character replaces goes through ``translate``; what several replace is looked
up in a map, in those texts only that still hold other characters after that.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Azerbaijani letters with their ASCII forms.
AZ_LETTERS = "əƏıİşŞçÇöÖğĞüÜ"
AZ_ASCII = "eEiIsScCoOgGuU"

# Latin letters without a Unicode decomposition, and typographic marks.
_OTHER_LETTERS = "ØøĐđÐðŁłĦħŦŧĸſ"
_OTHER_ASCII = "OoDdDdLlHhTtks"
_MARKS = "\u00a0‘’“”–"
_MARKS_ASCII = " ''\"\"-"

# Russian letters that become one ASCII character.
_RUSSIAN = "АБВГДЕЗИЙКЛМНОПРСТУФЪЫЬЭабвгдезийклмнопрстуфъыьэ"
_RUSSIAN_ASCII = "ABVGDEZIIKLMNOPRSTUF'Y'Eabvgdeziiklmnoprstuf'y'e"

# Characters that become several.
_EXPANDED = {
    "ß": "ss",
    "ẞ": "SS",
    "Æ": "AE",
    "æ": "ae",
    "Œ": "OE",
    "œ": "oe",
    "Þ": "Th",
    "þ": "th",
    "Ĳ": "IJ",
    "ĳ": "ij",
    "«": "<<",
    "»": ">>",
    "—": "--",
    "…": "...",
    "Ё": "Io",
    "Ж": "Zh",
    "Х": "Kh",
    "Ц": "Ts",
    "Ч": "Ch",
    "Ш": "Sh",
    "Щ": "Shch",
    "ё": "io",
    "ж": "zh",
    "х": "kh",
    "ц": "ts",
    "ч": "ch",
    "ш": "sh",
    "щ": "shch",
    "Ю": "Iu",
    "Я": "Ia",
    "ю": "iu",
    "я": "ia",
}

# Letters whose Latin form is not in their Unicode name.
_NAMED = {
    "GREEK": {"CHI": "KH", "RHO": "R"},
    "GEORGIAN": {
        "CAN": "TS",
        "CIL": "TS",
        "JHAN": "J",
        "JIL": "DZ",
        "KHAR": "K",
        "PHAR": "P",
        "XAN": "KH",
    },
    "CYRILLIC": {"SCHWA": "E", "SHHA": "H"},
}
# Modern letters of each script; old letters and signs stay.
_SCRIPTS = {
    "GREEK": [(0x0370, 0x0400), (0x1F00, 0x2000)],
    "CYRILLIC": [(0x0400, 0x0460), (0x048A, 0x0530)],
    "GEORGIAN": [(0x10D0, 0x10F1), (0x1C90, 0x1CB1)],
}
_LETTER = re.compile(r"(\w+)(?: MTAVRULI)?( CAPITAL| SMALL|) LETTER (?:FINAL )?([A-Z -]+)$")


def _named_form(script: str, name: str) -> str:
    """The Latin form of a letter that its name begins with, or ends with as in EN and EF."""
    if name in _NAMED[script]:
        return _NAMED[script][name]
    leading = re.match("[^AEIOU]*", name).group()
    if script == "CYRILLIC" and not leading:
        return re.search("[^AEIOU]*$", name).group() or name
    if script == "CYRILLIC" and leading == "Y":
        return name
    return leading or name[0]


def _by_name(char: str) -> str | None:
    """The Latin form of a letter by its Unicode name; none for signs and derived letters."""
    found = _LETTER.match(unicodedata.name(char, ""))
    if found is None or found[1] not in _NAMED or re.search(" WITH |SIGN", found[3]):
        return None
    script, size, name = found.groups()
    # Of names like SHORT U the last word is the letter.
    form = _named_form(script, name.split(" ")[-1])
    return form.capitalize() if size == " CAPITAL" else form.lower()


def _base_letter(char: str) -> str | None:
    """The letter that one is derived from, by decomposition or by its name."""
    base = unicodedata.normalize("NFD", char)[0]
    if base != char:
        return base
    name, *derived = unicodedata.name(char, "").split(" WITH ")
    try:
        return unicodedata.lookup(name) if derived else None
    except KeyError:
        return None


def _compatible(char: str) -> str | None:
    """The ASCII text that Unicode holds for equivalent to the character, accents apart."""
    parts = unicodedata.normalize("NFKD", char)
    if parts == char or parts.startswith(" ") and len(parts) > 1:
        return None
    text = "".join(c for c in parts if not unicodedata.combining(c)).replace("⁄", "/")
    return text if text and text.isascii() else None


def _forms() -> dict[str, str]:
    """ASCII form of each character that has one; the fixed ones first."""
    forms = dict(
        zip(
            AZ_LETTERS + _OTHER_LETTERS + _MARKS + _RUSSIAN,
            AZ_ASCII + _OTHER_ASCII + _MARKS_ASCII + _RUSSIAN_ASCII,
            strict=True,
        )
    )
    forms |= _EXPANDED
    for code in (*range(0x00A0, 0xD800), *range(0xF900, 0x10000)):
        text = None if chr(code) in forms else _compatible(chr(code))
        if text is not None:
            forms[chr(code)] = text
    letters = [chr(c) for ranges in _SCRIPTS.values() for low, high in ranges for c in range(low, high)]
    for char in letters:
        form = _by_name(char)
        if char not in forms and form is not None:
            forms[char] = form
    for char in letters:
        base = _base_letter(char)
        if char not in forms and base in forms:
            forms[char] = forms[base]
    return forms


_FORMS = _forms()
_SINGLE = {char: text for char, text in _FORMS.items() if len(text) == 1}
_SEVERAL = {char: text for char, text in _FORMS.items() if len(text) > 1}
# Combining marks have no partner, so ``translate`` deletes them.
_FOLD_FROM = "".join(_SINGLE) + "".join(chr(code) for code in range(0x0300, 0x0370))
_FOLD_TO = "".join(_SINGLE.values())
_BETWEEN = "\x01"


def _is_ascii(c: Column) -> Column:
    """One byte per character."""
    return F.octet_length(c) == F.length(c)


def _expand(c: Column) -> Column:
    """The text with characters that become several ones replaced."""
    keys, values = (F.split(F.lit(_BETWEEN.join(part)), _BETWEEN) for part in (_SEVERAL, _SEVERAL.values()))
    forms = F.map_from_arrays(keys, values)
    pieces = F.regexp_extract_all(c, F.lit(r"[\x00-\x7F]+|[^\x00-\x7F]"), F.lit(0))
    return F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(forms, p), p)), "")


def ascii_fold(c: Column) -> Column:
    """Latin, Greek, Cyrillic and Georgian letters and their variants to ASCII.

    So are full-width forms, ligatures, fractions and other characters that Unicode holds for
    equivalent to ASCII ones. Other scripts, old letters and characters beyond the basic plane
    pass through.

    Most texts need no folding or only the 1:1 table. ``transform`` over one item names
    the translated text, so that it is computed once and tested before it is expanded.
    """
    translated = F.array(F.translate(c, _FOLD_FROM, _FOLD_TO))
    expanded = F.transform(translated, lambda t: F.when(_is_ascii(t), t).otherwise(_expand(t)))
    return F.when(_is_ascii(c), c).otherwise(F.get(expanded, F.lit(0)))
