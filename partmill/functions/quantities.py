"""Reading quantities with units out of text, and their exact conversion to one unit per kind."""

from __future__ import annotations

import re
from fractions import Fraction
from functools import lru_cache

# Spellings of units, their kind, and the factor to the kind's common unit
# (length nm, pressure kPa, mass mg, flow mL/min).  Temperatures are scale and offset to 0.01 degrees Celsius.
SPELLINGS = {
    ("length", Fraction(10**6)): "mm mm. millimeter millimeters millimetre millimetres",
    ("length", Fraction(10**7)): "cm cm. centimeter centimeters centimetre centimetres",
    ("length", Fraction(10**9)): "m meter meters metre metres",
    ("length", Fraction(254 * 10**5)): "in in. inch inches \" ” “ ″ ''",
    ("length", Fraction(3048 * 10**5)): "ft ft. foot feet ' ’ ′",
    ("pressure", Fraction("6.894757293168")): "psi psi. psig psia lb/in2 lb/in² lbs/in2 lbs/in² lb/sq_in lb/sq_in. lbs_per_sq._in. lbs_per_sq_in lb_per_sq._in. lb_per_sq_in lbs._per_sq._in. pounds_per_square_inch",
    ("pressure", Fraction(100)): "bar bars barg bar(g)",
    ("pressure", Fraction(1, 10)): "mbar millibar",
    ("pressure", Fraction(1)): "kpa kilopascal kilopascals",
    ("pressure", Fraction(1000)): "mpa megapascal megapascals",
    ("pressure", Fraction(1, 1000)): "pa pascal pascals",
    ("mass", Fraction(1)): "mg milligram milligrams",
    ("mass", Fraction(1000)): "g g. gm gms gm. gram grams gramme grammes",
    ("mass", Fraction(10**6)): "kg kg. kgs kilo kilos kilogram kilograms kilogramme kilogrammes",
    ("mass", Fraction("453592.37")): "lb lb. lbs lbs. pound pounds",
    ("mass", Fraction("453592.37") / 16): "oz oz. ounce ounces",
    ("flow", Fraction("3785.411784")): "gpm usgpm us_gpm gal/min us_gal/min gal./min gallons/min gallon/min gallons_per_minute us_gallons_per_minute gal_per_min",
    ("flow", Fraction("3785.411784") / 60): "gph gal/h gal/hr gallons_per_hour",
    ("flow", Fraction(1000)): "lpm l/min l/min. litres/min liters/min litre/min liter/min litres_per_minute liters_per_minute litre_per_minute liter_per_minute",
    ("flow", Fraction(1000, 60)): "l/h lph l/hr litres_per_hour liters_per_hour",
    ("flow", Fraction(60000)): "l/s lps litres_per_second liters_per_second",
    ("flow", Fraction(10**6, 60)): "m3/h m³/h m3/hr m³/hr cbm/h cbm/hr m^3/h cubic_meters_per_hour cubic_metres_per_hour cubic_meter_per_hour",
    ("flow", Fraction(1)): "ml/min milliliters_per_minute millilitres_per_minute",
}
TEMPERATURES = {
    (Fraction(100), Fraction(0)): "°c ºc ˚c ° c º c ˚ c ℃ c deg c deg. c degc degree c degrees c degree celsius degrees celsius deg celsius celsius °celsius centigrade",
    (Fraction(500, 9), Fraction(-16000, 9)): "°f ºf ˚f ° f º f ˚ f ℉ f deg f deg. f degf degree f degrees f degree fahrenheit degrees fahrenheit deg fahrenheit fahrenheit °fahrenheit",
    (Fraction(100), Fraction(-27315)): "k kelvin kelvins deg k °k",
}
# Compound units that are no cases (torques), so that their parts aren't read as lengths or masses.
NO_CASE = ["ft-lb", "ft-lbs", "ft lb", "ft.-lb", "in-lb", "in-lbs", "lb-ft", "lb-in", "lb/ft", "lb/ft3", "g/cm3", "kg/m3", "kg/m", "g/l", "n m", "mm2", "cm2", "m2", "m3", "in2", "in3", "sq in", "sq. in.", "sq ft", "m/s", "ft/s"]
# Vulgar fractions.
VULGAR = {"½": "1/2", "¼": "1/4", "¾": "3/4", "⅛": "1/8", "⅜": "3/8", "⅝": "5/8", "⅞": "7/8", "⅓": "1/3", "⅔": "2/3", "⅕": "1/5", "⅖": "2/5", "⅗": "3/5", "⅘": "4/5", "⅙": "1/6", "⅚": "5/6"}


def known_units() -> dict[str, tuple[str, Fraction, Fraction]]:
    """spelling (lower case, single blanks) -> kind, scale, offset."""
    out: dict[str, tuple[str, Fraction, Fraction]] = {}
    for (kind, scale), words in SPELLINGS.items():
        for word in words.split(" "):
            out[word.replace("_", " ")] = (kind, scale, Fraction(0))
    for (scale, offset), words in TEMPERATURES.items():
        single = words.split(" ")
        joined, i = [], 0
        while i < len(single):  # words of several parts end in a letter or name of a scale
            part = single[i]
            while part in {"°", "º", "˚", "deg", "deg.", "degree", "degrees"}:
                i += 1
                part = f"{part} {single[i]}"
                if not part.endswith(("deg", "deg.", "degree", "degrees", "°", "º", "˚")):
                    break
            joined.append(part)
            i += 1
        for word in joined:
            out[word] = ("temperature", scale, offset)
    return out


# One spelling of each unit, from which the graph of sources gives the others their conversion.
SYMBOLS = "mm cm m in ft psi bar mbar kpa mpa pa mg g kg lb oz gpm gph l/min l/h l/s m3/h ml/min °c °f k".split()


def base_value(number: Fraction, scale: Fraction, offset: Fraction) -> int:
    """The number in the common unit, rounded half up (away from zero)."""
    exact = number * scale + offset
    whole = (abs(exact) * 2 + 1) // 2
    return int(whole if exact >= 0 else -whole)


DECIMAL = r"(?:\d{1,3}(?:,\d{3})+(?![\d])(?:\.\d+)?|\d+(?:[.,]\d+)?|\.\d+)"
FRACTION_SIGNS = "".join(VULGAR)
NUMBER = rf"(?:(?P<w>\d+)(?:[-‐‑–]|\s)(?P<n>\d+)/(?P<d>\d+)|(?P<n2>\d+)\s?[/⁄]\s?(?P<d2>\d+)|(?P<w3>\d+)?(?:\s|-)?(?P<v>[{FRACTION_SIGNS}])|(?P<dec>{DECIMAL}))"
RANGE = re.compile(r"\s*(?:to|thru|through|and|up to|…|\.{2,3}|–|—|(?<!\s)-(?!\s)|/\s*-|[x×*])\s*", re.I)
TIMES = re.compile(r"\s*[x×*]\s*", re.I)

# Names of dimensions whose bare numbers take the unit that the series text gives.
DIMENSION = re.compile(
    r"(?:^|[\s,;(|])(?:overall length|length|lg|oal|height|ht|width|depth|thickness|bore|diameter|dia|od|o\.d|id|i\.d|tube|tube size|face to face|end to end|center to end|centre to end|across flats|dim(?:ension)?\.?\s*[a-z]|size|reach|stroke|[lhwd])\.?\s*[:=]?\s*$"
    r"|^\s*[a-z]\s*[:=]\s*$|^\s*[a-fhj-lnp-qs-z]\s+$",
    re.I,
)
AFTER_DIMENSION = re.compile(r"^\s*(?:long|wide|high|deep|thick|tall|od|id)\b", re.I)
FIELDS = re.compile(r"\s{2,}|\s-\s|;|\||,(?=\s)|[\r\n\t]+")
QUALIFIERS = re.compile(r"(?:\b(?:approx(?:imately)?|about|around|ca|circa|max(?:imum)?|min(?:imum)?|up to|from|only|nominal|nom|at least|at most)\b\.?|[~≈±<>≤≥])", re.I)


class Reader:
    """Reads the quantities stated in a text; ``units`` as of :func:`known_units`."""

    def __init__(self, units: dict[str, tuple[str, Fraction, Fraction]] | None = None):
        self.units = units or known_units()
        words = sorted([*self.units, *NO_CASE], key=len, reverse=True)
        alternatives = "|".join(r"\s*".join(re.escape(p) for p in w.split(" ")) for w in words)
        self.unit = re.compile(rf"\s*(?:-\s?(?=(?:inch|mm|in|foot|ft|psi)\b))?(?P<u>{alternatives})(?![\w²³°]|-lb)", re.I)
        self.number = re.compile(rf"(?<![\w./])(?:(?<![\w)])(?P<sign>[-−–](?=[\d.{FRACTION_SIGNS}])))?{NUMBER}", re.I)
        self.named = re.compile(rf"\b(?:dim(?:ension)?s?\.?|lengths?|sizes?)\s+(?:are\s+)?(?:in\s+)?(?P<u>{alternatives})(?![\w])", re.I)
        self.labels = [
            re.compile(rf"^(?P<base>.*?)[\s,:_]*[(\[]\s*(?P<u>{alternatives})\s*[)\]]\s*:?\s*$", re.I | re.S),
            re.compile(rf"^(?P<base>.*?)\s*,[\s_]*(?P<u>{alternatives})\s*:?\s*$", re.I | re.S),
            re.compile(rf"^(?P<base>.*?)[\s_]+in[\s_]+(?P<u>{alternatives})\s*:?\s*$", re.I | re.S),
        ]
        self.read = lru_cache(65536)(self._read)
        self.label = lru_cache(65536)(self._label)

    def lookup(self, spelling: str) -> tuple[str, Fraction, Fraction] | None:
        text = re.sub(r"\s+", " ", spelling.lower())
        return self.units.get(text) or self.units.get(text.replace(" ", "")) or next((v for k, v in self.units.items() if k.replace(" ", "") == text.replace(" ", "")), None)

    def unit_of(self, spelling: str):
        return None if re.sub(r"\s+", " ", spelling.lower()) in NO_CASE else self.lookup(spelling)

    def series_unit(self, series: str | None) -> tuple[str, Fraction, Fraction] | None:
        """The unit that a series text gives for the dimensions, if any."""
        m = self.named.search(series or "")
        return self.unit_of(m["u"]) if m else None

    def _label(self, label: str):
        """The label without the unit that it may name, and that unit."""
        for pattern in self.labels:
            m = pattern.match(label)
            if m and (unit := self.unit_of(m["u"])):
                return m["base"], unit
        return label, None

    def items(self, text: str) -> list[dict]:
        """Numbers with the unit behind each, in order."""
        out = []
        at = 0
        while m := self.number.search(text, at):
            value = (
                Fraction(int(m["w"])) + Fraction(int(m["n"]), int(m["d"])) if m["w"] and int(m["d"])
                else Fraction(int(m["n2"]), int(m["d2"])) if m["n2"] and int(m["d2"])
                else Fraction(int(m["w3"] or 0)) + Fraction(VULGAR[m["v"]]) if m["v"]
                else Fraction(re.sub(r",(?=\d{3}(?!\d))", "", m["dec"]).replace(",", ".")) if m["dec"]
                else None
            )
            at = m.end()
            if value is None:
                continue
            item = {"start": m.start(), "end": m.end(), "value": -value if m["sign"] else value, "sign": bool(m["sign"]), "unit": None, "none": False}
            u = self.unit.match(text, m.end())
            if u:
                word = u["u"].lower()
                unit = self.unit_of(word)
                two_in_one = word == "in" and re.match(r"\s\d", text[u.end():])
                if unit is None:
                    item["none"] = True
                elif not two_in_one:
                    item["unit"], item["end"] = unit, u.end()
                    at = u.end()
            out.append(item)
        return out

    def _read(self, text: str, given: tuple[str, Fraction, Fraction] | None = None, whole: bool = False) -> tuple[tuple[str, int], ...]:
        """Distinct (kind, base value) stated.  ``given``: the unit of bare numbers: of dimensions, or with ``whole``, of
        a text that holds nothing but numbers and qualifiers."""
        found: dict[tuple[str, int], None] = {}
        for field in FIELDS.split(text):
            items = self.items(field)
            joined = [RANGE.fullmatch(field[a["end"]:b["start"]]) is not None for a, b in zip(items, items[1:])]
            groups, group = [], []
            for i, item in enumerate(items):
                group.append(item)
                if i == len(joined) or not joined[i]:
                    groups.append(group)
                    group = []
            for group in groups:
                before = field[: group[0]["start"]]
                threaded = re.search(r"\b[MG]\d*\s*[x×]?\s*$", before) is not None and TIMES.search(field[: group[-1]["end"]]) is not None or re.search(r"\bthread(?:ed)?\b[^,;]*$", before, re.I) is not None
                if threaded:
                    continue
                unit = None
                for item in reversed(group):  # the unit behind the last number holds for all that are joined to it
                    if item["none"]:
                        unit = None
                    elif item["unit"]:
                        unit = item["unit"]
                    elif unit:
                        item["unit"] = unit
                if given and not any(x["unit"] or x["none"] for x in group):
                    rest = field[group[-1]["end"]:]
                    alone = not QUALIFIERS.sub("", before + rest).strip(" .:()")
                    if (alone and whole) or not whole and (DIMENSION.search(before) or AFTER_DIMENSION.match(rest) or (alone and len(group) > 1)):
                        for item in group:
                            item["unit"] = given
            i = 0
            while i < len(items):
                item = items[i]
                if item["unit"]:
                    kind, scale, offset = item["unit"]
                    value, extra = item["value"], items[i + 1] if i + 1 < len(items) else None
                    if extra and extra["unit"] and self.adds(item, extra, field):
                        value += extra["value"] * extra["unit"][1] / scale
                        i += 1
                    if kind != "temperature" and value < 0:
                        value = -value
                    found[(kind, base_value(value, scale, offset))] = None
                i += 1
        return tuple(found)

    @staticmethod
    def adds(a: dict, b: dict, text: str) -> bool:
        """Feet and inches, or pounds and ounces, that are one sum."""
        pair = (a["unit"][1], b["unit"][1])
        feet, inch, pound = Fraction(3048 * 10**5), Fraction(254 * 10**5), Fraction("453592.37")
        return pair in {(feet, inch), (pound, pound / 16)} and a["unit"][0] == b["unit"][0] and re.fullmatch(r"\s*(?:and|&|-)?\s*", text[a["end"]:b["start"]]) is not None
