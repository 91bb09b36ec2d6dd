"""Characters that print alike, as plain tables, and a per-string fold built on them."""

from __future__ import annotations

import re
import unicodedata

# Letters of other alphabets that print like Latin ones.
CYRILLIC = "АВЕЅІЈКМНОРСТХУЬԁԌԛԝаеѕіјорсухһӏ"
CYRILLIC_AS = "ABESIJKMHOPCTXYbdGqwaesijopcyxhl"
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρϲϳ"
GREEK_AS = "ABEZHIKMNOPTYXovpcj"
ARMENIAN = "ՍՏՕհոսցօ"
ARMENIAN_AS = "USOhnugo"
LATIN = "ɑɡ"
LATIN_AS = "ag"
COPTIC = "ⲀⲂⲈⲎⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ"
COPTIC_AS = "ABEHKMNOPCTYXopc"
CHEROKEE = "ᎠᎡᎢᎪᎫᎬᎳᎷᎻᏀᏃᏒᏚᏙᏞᏟᏢᏦᏴ"
CHEROKEE_AS = "DRTAJEWMHGZRSVLCPKB"
LISU = "ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"
LISU_AS = "BPDTGKJCZFMNLSRVHWXYAEIOU"

HOMOGLYPHS = dict(
    zip(
        CYRILLIC + GREEK + ARMENIAN + LATIN + COPTIC + CHEROKEE + LISU,
        CYRILLIC_AS + GREEK_AS + ARMENIAN_AS + LATIN_AS + COPTIC_AS + CHEROKEE_AS + LISU_AS,
        strict=True,
    )
)

# Decomposition tags of Unicode that leave the printed shape as it is.
SAME_SHAPE = ("<wide>", "<narrow>", "<noBreak>", "<font>")


def invisible(ch: str) -> bool:
    """Format characters, variation selectors and the joiner print nothing."""
    return unicodedata.category(ch) == "Cf" or ch == "͏" or "︀" <= ch <= "️"


def shape_of(ch: str) -> str:
    """The plain text that prints like one code point; the code point itself where there is none."""
    if invisible(ch):
        return ""
    if ch in HOMOGLYPHS:
        return HOMOGLYPHS[ch]
    if unicodedata.category(ch) == "Zs" or ch == "\t":
        return " "
    tag, _, codes = unicodedata.decomposition(ch).partition(" ")
    if tag in SAME_SHAPE:
        return "".join(shape_of(chr(int(c, 16))) for c in codes.split())
    ligature = tag == "<compat>" and ("ﬀ" <= ch <= "ﬆ" or "LIGATURE" in unicodedata.name(ch, ""))
    if ligature or "Ⅰ" <= ch <= "ⅿ":
        return "".join(shape_of(chr(int(c, 16))) for c in codes.split())
    return ch


class _Shapes(dict):
    def __missing__(self, code: int) -> str:
        self[code] = shape_of(chr(code))
        return self[code]


_shapes = _Shapes()


def fold_shape(text: str) -> str:
    """text in plain characters of the same look: one width, composed accents, one kind of space."""
    if text.isascii():
        return text
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", text).translate(_shapes))


_marks = re.compile("[̀-ͯ]+")


def fold_case(text: str) -> str:
    """fold_shape without case and accents, apostrophes and minus signs in one shape, single spaces."""
    text = fold_shape(text)
    if not text.isascii():
        text = _marks.sub("", unicodedata.normalize("NFD", text))
        text = text.replace("’", "'").replace("−", "-").replace("–", "-")
    return " ".join(text.casefold().split())
