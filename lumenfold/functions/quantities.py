"""Reading quantities with units out of free text, in exact decimal arithmetic."""

from __future__ import annotations

import re
import unicodedata
from decimal import Decimal, InvalidOperation
from functools import lru_cache

_SUPER = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺", "0123456789-+")
_PREFIX = {"": 0, "k": 3, "m": -3, "u": -6, "n": -9, "p": -12, "d": -1, "c": -2}
_NAMED = {"nano": "n", "micro": "u", "milli": "m", "pico": "p", "纳": "n", "微": "u", "毫": "m", "皮": "p", "千": "k", "mc": "u"}

_PRE = r"(nano|micro|milli|pico|mc|[kmunpcd]|[纳微毫皮千])?"
_PER = r"\s*(?:/|·|\*|⋅|\s(?=[A-Za-z]+\s?\^?-1))\s*"
_INV = r"(?:\s?\^?-1)"
_AMOUNT = rf"{_PRE}(mol(?:ar)?|摩尔|摩|M)(?![A-Za-z])"
_MASS = rf"{_PRE}(grams?|gm?|克)(?![A-Za-z])"
_VOLUME = r"([mu]?)(l|L|升|liters?|litres?)(?![A-Za-z])"
_VOLUME_ZH = r"(毫|微)?(升)"
_BODY = r"(?:\s*(?:of\s+)?(?:body\s*(?:weight|wt|mass)|b\.?w\.?(?![a-z])|体重))"
_UNIT = re.compile(
    "|".join((
        rf"(?P<molvol>{_PRE}(?:mol|摩尔|摩){_PER}(?:(?:[mu])?(?:l|L)(?![A-Za-z]){_INV}?|(?:毫|微)?升))",
        r"(?P<molar>(?:(?:nano|micro|milli|pico)molar|[munp]?M|[munp]?molar|[纳微毫皮]?摩尔浓度)(?![A-Za-z]))",
        rf"(?P<massvol>{_PRE}(?:g|克){_PER}(?:(?:[mud])?(?:l|L)(?![A-Za-z]){_INV}?|(?:毫|微|分)?升))",
        rf"(?P<bodymass>{_PRE}(?:g|克){_PER}(?:kg(?![A-Za-z]){_INV}?|千克|公斤){_BODY}?)",
        rf"(?P<massmass>{_PRE}(?:g|克){_PER}(?:100\s*)?(?:[mu]?g(?![A-Za-z]){_INV}?|(?:毫|微)?克))",
        r"(?P<percent>%\s*(?:\(?\s*(?:w\s*/\s*w|m\s*/\s*m|质量分数)\s*\)?|by\s+(?:weight|mass)))",
        r"(?P<ppm>pp[mb](?![A-Za-z]))",
    ))
)
_NUM = r"(?:\d{1,3}(?:,\d{3})+(?:\.\d+)?(?!\d)|\d+(?:[.,]\d+)?)(?:\s*[x×*]\s*10\s*\^?\s*[-+]?\d+|[eE][-+]?\d+)?"
_VALUE = rf"{_NUM}(?:\s*(?:±|\+/-)\s*{_NUM})?"
_RANGE = rf"{_VALUE}(?:\s*(?:-|~|to|至|到|and)\s*{_VALUE})?"
_LIST = rf"{_RANGE}(?:\s*;\s*{_RANGE})*"
_BEFORE = r"(?<![A-Za-z0-9.,^])(?<![A-Za-z]-)"
_LEAD = re.compile(rf"{_BEFORE}({_LIST})\s*$")
_DRY = r"(?:\s*(?:of\s+)?(?:dry|dried|crude)\s+[a-z]+|\s*(?:干)?(?:药材|干品|生药))"
_DRIED = re.compile(_DRY)
_TAIL = re.compile(rf"{_DRY}?\s*\)?\s*\)?\s*[:=]\s*(?:about|约|[<>≤≥~]=?)?\s*({_LIST})")
_ERROR = re.compile(rf"(?:±|\+/-)\s*{_NUM}")
_NUMBER = re.compile(_NUM)
_LOG = re.compile(rf"(?<![A-Za-z])p(?:IC50|EC50|CC50|ED50|LD50|GI50|Ki|Kd|Kb|A2|MIC|MBC)\s*(?:=|:|为|of|is|values?|\s)*\s*(?:about|约|[<>≤≥~]=?)?\s*({_LIST})")
_BARE = re.compile(rf"(?:=|:|为)\s*(?:about|约|[<>≤≥~]=?)?\s*({_RANGE})\s*$")
_ANIMAL = re.compile(r"LD50|ED50|effective dose|dose|剂量|灌胃")


_ASSAY = re.compile(r"(?<![A-Za-z])p?(IC50|EC50|CC50|ED50|LD50|GI50|Ki|Kd|Kb|A2|MIC|MBC)(?![A-Za-z])|(content)|(含量)|(effective dose|dose)|(剂量|灌胃)")


def _assay(plain_text: str) -> str | None:
    m = _ASSAY.search(plain_text)
    if not m:
        return None
    return m.group(1) or ("content" if m.group(2) or m.group(3) else "dose")


def assay(text: str | None) -> str | None:
    """The name of the assay or measure that a text speaks of first, if any; one of a fixed list."""
    return _kept(text)[0] if text and text.strip() else None


_RAISED = re.compile(r"[⁰¹²³⁴⁵⁶⁷⁸⁹⁻⁺]+")
_ALIKE = str.maketrans("−–—‒‐‑μµ；：，、∼～∙・", "------uu;:,,~~··")


def plain(text: str) -> str:
    """text with superscripts as ^n, full-width forms, dashes, micro signs and separators unified."""
    text = _RAISED.sub(lambda m: "^" + m.group(0).translate(_SUPER), text)
    text = unicodedata.normalize("NFKC", text).translate(_ALIKE)
    return (re.sub(r"\^+", "^", text) if "^" in text else text).replace("​", "")


def number(text: str) -> Decimal | None:
    """The value of one number; a comma before exactly three digits groups thousands, unless only a zero leads it."""
    if text.isascii() and text.isdigit():
        return Decimal(text)
    m = re.match(r"\s*([\d.,]+)(?:\s*[x×*]\s*10\s*\^?\s*([-+]?\d+)|[eE]([-+]?\d+))?", text)
    if not m:
        return None
    digits = m.group(1).rstrip(".,")
    if re.fullmatch(r"[1-9]\d{0,2}(?:,\d{3})+(?:\.\d+)?", digits):
        digits = digits.replace(",", "")
    try:
        return Decimal(digits.replace(",", ".")).scaleb(int(m.group(2) or m.group(3) or 0))
    except (InvalidOperation, ValueError):
        return None


def _prefix(unit: str) -> tuple[int, str]:
    for name, short in _NAMED.items():
        if unit.startswith(name):
            return _PREFIX[short], unit[len(name):]
    if len(unit) > 1 and unit[0] in _PREFIX and re.match(r".(?:g|M|mol|l|L|克|升)", unit) and not unit.startswith("mol"):
        return _PREFIX[unit[0]], unit[1:]
    return 0, unit


@lru_cache(maxsize=10_000)
def _unit(kind: str, text: str, dose: bool) -> tuple[str, int]:
    """(quantity, power of ten to its common unit: nmol/L, ng/mL, ug/g, ug/kg) of a unit as written."""
    power, _ = _prefix(text)
    parts = re.split(r"/|·|\*|⋅", text, maxsplit=1)
    per = parts[1].strip() if len(parts) > 1 else ""
    if kind == "molar":
        return "molar", power + 9
    if kind == "molvol":
        return "molar", power - _prefix(per)[0] + 9
    if kind == "massvol":
        return "mass_conc", power + 9 - (_prefix(per)[0] + 3)
    if kind == "bodymass":
        if re.search(_BODY, text) or dose:
            return "dose", power + 6
        return "content", power - 3 + 6
    if kind == "massmass":
        hundred = 2 if per.startswith("100") else 0
        return "content", power - hundred - _prefix(re.sub(r"^100\s*", "", per))[0] + 6
    if kind == "percent":
        return "content", 4
    return "content", 0 if text == "ppm" else -3


def _values(found: str) -> list[Decimal]:
    return [v for x in _NUMBER.findall(_ERROR.sub("", found) if "±" in found or "+/-" in found else found) if (v := number(x)) is not None]


def _read(text: str) -> tuple[str | None, tuple[tuple[int, str | None, Decimal, int | None], ...]]:
    t = plain(text)
    return _assay(t), tuple(_parsed(t))


_remembered = lru_cache(maxsize=50_000)(_read)


def _kept(text: str) -> tuple[str | None, tuple[tuple[int, str | None, Decimal, int | None], ...]]:
    """What a text says; short ones are remembered."""
    return _remembered(text) if len(text) < 500 else _read(text)


def read(text: str | None) -> list[tuple[int, str | None, Decimal, int | None]]:
    """(offset, quantity, number as written, power of ten to the common unit), in order of the text.

    A negative logarithm comes as its molar value. A number that follows an
    assay's name without a unit comes with quantity and power None. Null and
    blank text give nothing.
    """
    return list(_kept(text)[1]) if text and text.strip() else []


def _parsed(t: str) -> list[tuple[int, str | None, Decimal, int | None]]:
    out, animal = [], bool(_ANIMAL.search(t))
    for m in _LOG.finditer(t):
        out += [(m.start(1), "molar", Decimal(10) ** -v, 9) for v in _values(m.group(1))]
    done = 0
    for m in _UNIT.finditer(t):
        if m.start() < done:
            continue
        u = _unit(m.lastgroup, m.group(0), animal and not _DRIED.match(t, m.end()))
        lead = _LEAD.search(t[done:m.start()])
        if lead:
            out += [(done + lead.start(1), *(u[0], v, u[1])) for v in _values(lead.group(1))]
            done = m.end()
        elif tail := _TAIL.match(t, m.end()):
            out += [(tail.start(1), *(u[0], v, u[1])) for v in _values(tail.group(1))]
            done = tail.end()
    if not out and (m := _BARE.search(t)):
        out = [(m.start(1), None, v, None) for v in _values(m.group(1))]
    return sorted(out, key=lambda x: x[0])
