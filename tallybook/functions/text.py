"""Text keys and identities as column expressions."""

from __future__ import annotations

import unicodedata
import uuid
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Words before an order's reference, and those that may follow them.
ORDER_WORDS, ORDER_NUMBER_WORDS = ["PO", "P.O.", "PURCHASE ORDER", "ORDER ID"], ["NUMBER", "NO.", "NO"]


def _either(words: list[str]) -> str:
    return "(?:" + "|".join(w.replace(".", "[.]").replace(" ", r"\s+") for w in words) + ")"


#: One of the words, perhaps one that follows, and the signs and spaces behind.
PO_LABEL = rf"(?i)^{_either(ORDER_WORDS)}(?:\s+{_either(ORDER_NUMBER_WORDS)})?\s*[:#-]*\s*"


def let(value: Column, body) -> Column:
    """body(value), with the value written and worked out once; keeps deep expressions small for the optimiser."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Blocks whose characters are normalised: Latin, Greek, Cyrillic, marks, signs, ligatures, half and full width forms.
BLOCKS = [(0xA0, 0x530), (0x1D2C, 0x1DC0), (0x1E00, 0x2190), (0x2460, 0x2500), (0x3000, 0x3001), (0xFB00, 0xFB07), (0xFF01, 0xFFEF)]
MARKS = "[\u0300-\u036f]"


def _forms(form: str, marks: bool) -> tuple[dict[str, str], dict[str, str]]:
    """What the characters of BLOCKS become in a Unicode form, less combining marks if asked: by one character, by none or several."""
    one, other = {}, {}
    for c in (chr(p) for lo, hi in BLOCKS for p in range(lo, hi)):
        new = unicodedata.normalize(form, c)
        new = new if marks else "".join(x for x in new if not unicodedata.combining(x))
        if new != c:
            (one if len(new) == 1 else other)[c] = new
    return one, other


def _replaced(text: Column, one: dict[str, str], other: dict[str, str]) -> Column:
    """Each character by its form; texts of ASCII alone are left as they are."""
    several = {k: v for k, v in other.items() if v}
    dropped = "".join(k for k, v in other.items() if not v)
    table = F.map_from_arrays(F.split(F.lit("\x01".join(several)), "\x01"), F.split(F.lit("\x01".join(several.values())), "\x01"))
    short = F.translate(text, "".join(one) + dropped, "".join(one.values()))
    long = F.array_join(F.transform(F.split(short, ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return F.when(F.char_length(text) == F.octet_length(text), text).when(text.rlike("[" + "".join(several) + "]"), long).otherwise(short)


def _plain(one: dict[str, str], other: dict[str, str]) -> tuple[dict[str, str], dict[str, str]]:
    """Of the forms what matters where only letters and digits of ASCII count."""
    kept = {k: "".join(x if x.isascii() else " " for x in v) for k, v in other.items()}
    return {k: v for k, v in one.items() if v.isascii() and v.isalnum()}, {k: kept[k] for k, v in other.items() if not v or any(x.isalnum() for x in kept[k])}


NFKC, NFKD_BARE = _forms("NFKC", True), _plain(*_forms("NFKD", False))
#: Letters with a mark behind them, as one character.
COMPOSED = {unicodedata.normalize("NFD", chr(p)): chr(p) for lo, hi in BLOCKS for p in range(lo, hi) if unicodedata.normalize("NFD", chr(p)) != chr(p) and unicodedata.normalize("NFC", chr(p)) == chr(p)}


def compatible_form(text: Column) -> Column:
    """NFKC for the characters of BLOCKS, by native expressions; marks join the letter before them."""
    table = F.map_from_arrays(F.split(F.lit("\x01".join(COMPOSED)), "\x01"), F.split(F.lit("\x01".join(COMPOSED.values())), "\x01"))
    clusters = F.regexp_extract_all(text, F.lit(f"(?s).{MARKS}*"), F.lit(0))
    joined = F.array_join(F.transform(clusters, lambda c: F.coalesce(F.try_element_at(table, c), c)), "")
    return let(F.when(text.rlike(MARKS), joined).otherwise(text), lambda t: _replaced(t, *NFKC))


def without_marks(text: Column) -> Column:
    """Accents and other marks dropped, compatible characters as plain letters and digits; other characters stay."""
    return _replaced(text, *NFKD_BARE)


def clean_text(c: Column) -> Column:
    """null as empty, NFKC, white space runs as one space, trimmed."""
    raw = F.coalesce(c, F.lit(""))
    squeezed = lambda t, space: F.trim(F.regexp_replace(t, space, " "))
    return F.when(F.char_length(raw) == F.octet_length(raw), squeezed(raw, r"\s+")).otherwise(squeezed(compatible_form(raw), r"(?U)\s+"))


def comparison_key(c: Column) -> Column:
    """Upper case letters and digits of the NFKC text alone; where all is ASCII the text is that already, and spaces go anyway."""
    raw = F.coalesce(c, F.lit(""))
    bare = lambda t: F.regexp_replace(F.upper(t), "[^A-Z0-9]+", "")
    return F.when(F.char_length(raw) == F.octet_length(raw), bare(raw)).otherwise(bare(compatible_form(raw)))


def holds(text: Column, words: list[str]) -> Column:
    """Whether a text, given as a column or bound by let, contains one of the words; plain comparison, no pattern."""
    return reduce(or_, [text.contains(w) for w in words])


def business_key(c: Column) -> Column:
    """Upper case words of letters and digits, marks folded, one space between."""
    raw = F.coalesce(c, F.lit(""))
    words = lambda t: F.upper(F.trim(F.regexp_replace(t, "[^A-Za-z0-9]+", " ")))
    return F.when(F.char_length(raw) == F.octet_length(raw), words(raw)).otherwise(words(without_marks(raw)))


def reference_key(c: Column) -> Column:
    """An order reference without its label and punctuation."""
    return F.upper(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(c, F.lit(""))), PO_LABEL, ""), "[^A-Za-z0-9]", ""))


@F.pandas_udf(DoubleType())
def matching_blocks_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff/Obershelp ratio of two keys, four places; argument order matters."""
    from decimal import ROUND_HALF_UP, Decimal
    from difflib import SequenceMatcher

    def score(x: str, y: str) -> float:
        if not x or not y:
            return 0.0
        if x == y:
            return 1.0
        return float(Decimal(str(SequenceMatcher(None, x, y).ratio())).quantize(Decimal("0.0001"), ROUND_HALF_UP))

    return pd.Series([score(x, y) for x, y in zip(a, b)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """What the ratio of two keys cannot exceed, by their lengths."""
    return 2 * F.least(F.length(a), F.length(b)) / F.greatest(F.length(a) + F.length(b), F.lit(1))


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """RFC 4122 version 5 identity of a text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-5"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def is_sha256(c: Column) -> Column:
    return F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))


def canonical_json(*fields: str) -> Column:
    """Fields as one JSON object with sorted keys, nulls kept, decimals and dates as text."""
    ordered = [F.col(f).cast("string").alias(f) for f in sorted(fields)]
    return F.to_json(F.struct(*ordered), {"ignoreNullFields": "false"})


def payload_hash(*fields: str) -> Column:
    return F.sha2(canonical_json(*fields), 256)


def redact(c: Column, limit: int = 300) -> Column:
    """Connection strings replaced; at most so many characters."""
    return F.substring(F.regexp_replace(c, r"[A-Za-z][A-Za-z0-9+.-]*://[^\s]+", "[redacted]"), 1, limit)


# Keys that no party's name holds.
NO_PARTY = [
    "INVOICE", "DATE", "DUE", "EXPIRY", "NUMBER", "TOTAL", "SUBTOTAL", "TAX", "VAT", "GST", "EMAIL", "WWW", "HTTP", "TEL", "PHONE", "ADDRESS",
    "BILLTO", "SHIPTO", "BUYER", "CUSTOMER", "SUPPLIER", "VENDOR", "ITEM", "DESCRIPTION", "QUANTITY", "PRICE", "AMOUNT",
]


def party_name(c: Column) -> Column:
    """Whether a line may name a party: no label's key, no @, not digits and signs alone, one to ten words, three letters."""

    def test(t: Column) -> Column:
        key = F.regexp_replace(F.upper(t), "[^A-Z0-9]+", "")
        letters = F.char_length(F.regexp_replace(t, r"[^\p{L}]+", ""))
        return let(key, lambda k: (k != "") & ~holds(k, NO_PARTY)) & ~t.contains("@") & ~t.rlike(r"^[\d\s.,+\-/#()]+$") & (F.size(F.split(t, " ")) <= 10) & (letters >= 3)

    return let(clean_text(c), test)
