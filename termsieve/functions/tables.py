"""Character tables of the text views."""

from __future__ import annotations

from .simplified import PAIRS

# Code points that never influence matching.
INVISIBLE = (
    "\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u2028\u2029\u202a\u202b\u202c\u202d\u202e"
    "\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff\ufff9\ufffa\ufffb"
)
INVISIBLE_RANGES = ((0xFE00, 0xFE0F), (0xE0000, 0xE007F), (0xE0100, 0xE01EF))

# Code points that become one space.
WHITESPACE = (
    "\t\n\x0b\x0c\r \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008"
    "\u2009\u200a\u202f\u205f\u3000"
)

# Separators that the fuzzy view drops.
SEPARATORS = (
    " !\"'()*,-./:;<>[]\\_`{}|~#%&^"
    "\u00b7\u2022\u3002\uff0c\u3001\u2010\u2011\u2012\u2013\u2014\u2015\u2018\u2019\u201c\u201d"
)

# Digits and signs that stand for letters.
LEET = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "+": "t"}

# What counts as part of a word, and blanks around lines.
WORD_CLASS = "0-9A-Za-z_\u00c0-\u024f\u0370-\u04ff"
TRIM_CLASS = "\\t\\n\\x0B\\f\\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

def common_simplified() -> dict[str, str]:
    """The built-in table of simplified characters, applied unless NormalizeOptions.simplified has another."""
    return dict(zip(PAIRS[::2], PAIRS[1::2], strict=True))


def is_invisible(char: str) -> bool:
    return char in INVISIBLE or any(a <= ord(char) <= b for a, b in INVISIBLE_RANGES)
