"""What is known about the measured quantities: units, spellings, names, plausible sizes."""

from __future__ import annotations

import re

from tamarack.functions.affine import Affine, UnitGraph

#: The common unit of each quantity.
COMMON_UNIT = {"glu": "mg/dL", "cre": "mg/dL", "ua": "mg/dL", "t_bil": "mg/dL", "hgb": "g/dL", "alb": "g/dL", "wbc": "10^3/uL", "height": "cm", "weight": "kg", "consumption": "kWh"}

#: Grams per mole.
MOLAR_MASS = {"glu": 180.156, "cre": 113.12, "ua": 168.11, "t_bil": 584.66, "hgb": 16114.5, "alb": 66500.0}

#: Values in the common unit that a body or a household can have.
PLAUSIBLE = {"glu": (20.0, 900.0), "cre": (0.1, 25.0), "ua": (0.5, 25.0), "t_bil": (0.05, 40.0), "hgb": (2.0, 25.0), "alb": (0.8, 8.0), "wbc": (0.1, 250.0), "height": (100.0, 300.0), "weight": (2.0, 1000.0), "consumption": (0.1, 100000.0)}

#: Units in which sources leave values bare, the common one first.
BARE_UNITS = {"glu": ("mg/dL", "mmol/L"), "cre": ("mg/dL", "umol/L"), "ua": ("mg/dL", "umol/L"), "t_bil": ("mg/dL", "umol/L"), "hgb": ("g/dL", "g/L", "mmol/L"), "alb": ("g/dL", "g/L"), "wbc": ("10^3/uL", "/uL"), "height": ("cm", "m", "in", "ft"), "weight": ("kg", "g", "lb"), "consumption": ("kWh", "Wh", "MWh", "MJ")}

_MASS = {("g/L", "g/dL"): Affine(0.1), ("g/dL", "mg/dL"): Affine(1000.0), ("mg/L", "mg/dL"): Affine(0.1), ("g/L", "mg/L"): Affine(1000.0)}
_MOLAR = {("mmol/L", "umol/L"): Affine(1000.0), ("mol/L", "mmol/L"): Affine(1000.0)}
_EDGES = {
    "count": {("/uL", "10^3/uL"): Affine(0.001), ("10^9/L", "10^3/uL"): Affine(1.0), ("10^9/L", "/uL"): Affine(1000.0)},
    "length": {("m", "cm"): Affine(100.0), ("in", "cm"): Affine(2.54), ("ft", "in"): Affine(12.0), ("ft", "cm"): Affine(30.48), ("mm", "cm"): Affine(0.1)},
    "mass": {("g", "kg"): Affine(0.001), ("lb", "kg"): Affine(0.45359237), ("st", "lb"): Affine(14.0)},
    "energy": {("Wh", "kWh"): Affine(0.001), ("MWh", "kWh"): Affine(1000.0), ("MJ", "kWh"): Affine(1 / 3.6), ("kJ", "MJ"): Affine(0.001)},
}
DIMENSION = {q: "concentration" for q in MOLAR_MASS} | {"wbc": "count", "height": "length", "weight": "mass", "consumption": "energy"}

#: Spellings of units, lower case, without spaces, micro as u, cubed as ^3.
SPELLINGS = {
    "concentration": {
        "mg/dL": "mg/dl mgperdl mg/100ml mgdl mg% mgperdecilitre mgperdeciliter milligrams/dl",
        "g/dL": "g/dl gm/dl gperdl grams/dl gdl g/100ml g% gramsperdl gperdecilitre gperdeciliter",
        "g/L": "g/l gm/l gperl grams/l gperlitre gperliter gramsperlitre gramsperliter",
        "mg/L": "mg/l mgperl mgperlitre mgperliter",
        "mmol/L": "mmol/l mm mmolperl mmolperlitre mmolperliter millimol/l mmoll",
        "umol/L": "umol/l um umolperl umolperlitre umolperliter micromol/l micromolperlitre micromolperliter mcmol/l umoll",
        "mol/L": "mol/l molperlitre",
    },
    "count": {
        "10^3/uL": "10^3/ul x10^3/ul *10^3/ul k/ul thousand/ul thousandperul 10^3/mm3 x10^3/mm3 k/mm3 thousands/ul 10^3perul 10e3/ul",
        "/uL": "/ul perul cells/ul cellsperul /mm3 permm3 cells/mm3 /mm^3 cells/mm^3 ul",
        "10^9/L": "10^9/l x10^9/l 10e9/l g/l gpt/l",
    },
    "length": {"cm": "cm centimetre centimetres centimeter centimeters cms", "m": "m metre metres meter meters", "in": "in inch inches \" ″", "ft": "ft foot feet '", "mm": "mm millimetre millimetres millimeter millimeters"},
    "mass": {"kg": "kg kgs kilo kilos kilogram kilograms kilogramme kilogrammes", "g": "g gm gram grams gramme grammes", "lb": "lb lbs pound pounds", "st": "st stone"},
    "energy": {"kWh": "kwh kilowatt-hour kilowatt-hours kilowatthour kilowatthours kw-h kwhr", "Wh": "wh watthour watthours watt-hour watt-hours", "MWh": "mwh megawatthour megawatthours megawatt-hour megawatt-hours", "MJ": "mj megajoule megajoules", "kJ": "kj kilojoule kilojoules"},
}

#: Names that columns give to a quantity, lower case, without marks.
NAMES = {
    "glu": "glu glucose bloodglucose fastingglucose bloodsugar sugar",
    "cre": "cre crea creatinine serumcreatinine",
    "ua": "ua uricacid urate serumurate",
    "t_bil": "tbil bilirubin totalbilirubin tbilirubin bil",
    "hgb": "hgb hb haemoglobin hemoglobin",
    "alb": "alb albumin serumalbumin",
    "wbc": "wbc whitebloodcells whitecells leukocytes leucocytes whitecellcount whitebloodcell leukocyte",
    "height": "height bodyheight tall stature",
    "weight": "weight bodyweight mass",
    "consumption": "consumption usage energy energydrawnovertheperiod energyuse kwhused power",
}
QUANTITY_OF = {name: q for q, names in NAMES.items() for name in names.split()}


def spelled(text: str) -> str:
    """A unit or name in the form of SPELLINGS."""
    text = (text or "").lower().replace("µ", "u").replace("μ", "u").replace("³", "^3").replace("⁹", "^9")
    return re.sub(r"\s+", "", text)


def unit_table() -> list[tuple[str, str, str]]:
    """(quantity, spelling, unit) for every spelling."""
    return [(q, s, unit) for q, d in DIMENSION.items() for unit, names in SPELLINGS[d].items() for s in names.split()]


def graph(quantity: str) -> UnitGraph:
    if DIMENSION[quantity] == "concentration":
        # Edges between mass and amount of substance carry the molar mass.
        bridge = {("mmol/L", "mg/dL"): Affine(MOLAR_MASS[quantity] / 10), ("umol/L", "mg/dL"): Affine(MOLAR_MASS[quantity] / 10_000)}
        return UnitGraph(_MASS | _MOLAR | bridge)
    return UnitGraph(_EDGES[DIMENSION[quantity]])


def conversion_table() -> list[tuple[str, str, str, float, float, int | None, float, float]]:
    """(quantity, unit, common unit, a, b, place among the bare units, least and largest plausible value in the unit), cycles checked."""
    rows = []
    for q, common in COMMON_UNIT.items():
        g = graph(q)
        g.check_cycles()
        for unit in g.next:
            f = g.compositions(unit)[common]
            low, high = (f.inverse()(x) for x in PLAUSIBLE[q])
            place = BARE_UNITS[q].index(unit) if unit in BARE_UNITS[q] else None
            rows.append((q, unit, common, f.a, f.b, place, low, high))
    return rows


def name_key(text: str) -> str:
    return re.sub(r"[^a-z]", "", (text or "").lower())


def _unit_in(quantity: str, text: str) -> str | None:
    """The unit a column name or a description states, if any: as a bracketed or separated part, or after the name."""
    spellings = {s: unit for unit, names in SPELLINGS[DIMENSION[quantity]].items() for s in names.split()}
    parts = re.findall(r"[\[(]([^\])]*)[\])]", text)
    parts += re.split(r",| in ", text)[1:]
    words = [w for w in re.split(r"[_\s]+", text) if w]
    for n in (4, 3, 2, 1):
        if len(words) > n or (len(words) == n and n > 1):
            tail = words[-n:]
            parts += ["/".join(tail), "".join(tail), "/".join(tail).replace("/per/", "/")]
    for part in parts:
        unit = spellings.get(spelled(part)) or spellings.get(spelled(part).rstrip("."))
        if unit:
            return unit
    return None


def column_meaning(name: str | None, description: str | None) -> tuple[str | None, str | None]:
    """(quantity, unit) of a column: the name counts before the description; (None, None) when neither tells a quantity."""
    name, description = (re.sub(r"\s+", " ", (x or "").strip().replace("µ", "u").replace("μ", "u")) for x in (name, description))
    bare = re.sub(r"[\[(].*?[\])]", " ", name)
    words = [w for w in re.split(r"[_\s]+", bare) if w]
    quantity = None
    for end in range(len(words), 0, -1):
        for start in range(end):
            quantity = quantity or QUANTITY_OF.get(name_key("".join(words[start:end])))
    if quantity is None:
        plain = re.sub(r"[\[(].*?[\])]", " ", description.lower())
        plain = re.split(r",| in ", plain)[0]
        quantity = QUANTITY_OF.get(name_key(plain)) or next((q for w in plain.split() if (q := QUANTITY_OF.get(name_key(w)))), None)
    if quantity is None:
        return None, None
    return quantity, _unit_in(quantity, name) or _unit_in(quantity, description)
