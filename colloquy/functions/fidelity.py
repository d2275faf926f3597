"""Whether a rendering in another language keeps what matters in a medical text: numbers, negation, time, units, drugs, symptoms.

All are column expressions over two texts. The word lists are arguments; VALUES holds those in use.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

#: They have to be these for equal decisions.
NUMBER = r"(?<![A-Za-z0-9_])[+-]?\d[\d,]*(?:\.\d+)?(?:/\d[\d,]*(?:\.\d+)?)?%?"
CITATION = r"\[\s*\d+(?:\s*[-–—]\s*\d+)?(?:\s*[,;]\s*\d+(?:\s*[-–—]\s*\d+)?)*\s*\]"
SPOKEN_DECIMAL = r"(?i)\b(\d+)\s+point(?:\s*,?\s*(?:uh|um),?\s*)?(?:point\s+)?(\d+)\b"
CLINICAL_CONTEXT = r"(?i)\b(?:symptoms?|pain|ache|cough|fever|headache|nausea|dizz(?:y|iness)|medications?|medicine|dose|dosage|tablet|capsule|blood pressure|heart rate|pulse|temperature|oxygen|saturation|glucose|a1c|cholesterol|creatinine|hemoglobin|test|result|lab|diagnos(?:ed|is)|treatment|therapy|bleeding|vomit(?:ing)?|diarrh(?:ea|oea)|swelling|rash|infection|breath(?:ing|lessness)?|sore|burning|onset|started|worse|worsening|history|pregnan(?:t|cy)|period)\b"
CLINICAL_UNIT = r"(?i)^\s*(?:mg|mcg|µg|ug|g|kg|ml|l|mmol(?:/l)?|mol/l|mg/dl|mmhg|bpm|beats?(?:\s+per\s+minute)?|°\s*[cf]|degrees?\s*[cf]|cm|mm|m)\b"
TIME_UNIT = r"(?iU)^\s*(?:seconds?|minutes?|hours?|days?|weeks?|months?|years?|秒|分|時間|日|週間|週|か月|ヶ月|月|年)\b"
VITAL_BEFORE = r"(?i)(?:blood pressure|heart rate|pulse|temperature|oxygen saturation|glucose|a1c|cholesterol|creatinine|hemoglobin|bp|hr)\s*(?:is|was|of|:)?\s*$"
#: Characters before and after a number that decide whether it is clinical.
BEFORE, AFTER = 120, 80


@dataclass(frozen=True)
class Lists:
    """Patterns, and for what has several names the names that count. The defaults are fixed values too."""

    negation: tuple[str, str] = (
        r"(?i)\b(?:no|not|never|without|denies?|negative for|doesn't|don't|isn't|hasn't|haven't)\b",
        r"(?i)(?:ない|なく|なかっ|ません|いません|ず|否定|認め(?:ない|ません)|なし|no|not|never|without)",
    )
    time: tuple[str, str] = (
        r"(?i)\b(?:today|yesterday|day|days|week|weeks|month|months|year|years|hour|hours|minute|minutes|since|ago|before|after|morning|night)\b",
        r"(?i)(?:今日|昨日|日|週間?|週|か月|ヶ月|月間|年|時間|分|以来|前|後|朝|夜|today|yesterday|days?|weeks?|months?|years?|hours?|minutes?|since|ago|before|after)",
    )
    unit: str = r"(?i)\b(?:mg|mcg|g|kg|ml|l|cm|mm|°?c|bpm|mmhg)\b"
    drug: str = r"(?i)\b(?:aspirin|ibuprofen|acetaminophen|paracetamol|amoxicillin|azithromycin|metformin|insulin|warfarin|lisinopril|prednisone|albuterol|omeprazole|[a-z]{4,}(?:cillin|mycin|cycline|pril|sartan|olol|statin|prazole|formin))\b"
    units: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "c": ("c", "℃", "度", "摂氏"), "°c": ("°c", "℃", "度", "摂氏"), "mg": ("mg", "ミリグラム"), "mcg": ("mcg", "マイクログラム"), "g": ("g", "グラム"), "kg": ("kg", "キログラム"),
        "ml": ("ml", "ミリリットル"), "l": ("l", "リットル"), "cm": ("cm", "センチメートル"), "mm": ("mm", "ミリメートル"), "bpm": ("bpm", "回/分", "回毎分"), "mmhg": ("mmhg", "水銀柱ミリメートル"),
    })
    drugs: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "insulin": ("insulin", "インスリン"), "ibuprofen": ("ibuprofen", "イブプロフェン"), "metoprolol": ("metoprolol", "メトプロロール"), "amoxicillin": ("amoxicillin", "アモキシシリン"),
        "metformin": ("metformin", "メトホルミン"), "lisinopril": ("lisinopril", "リシノプリル"), "ramipril": ("ramipril", "ラミプリル"), "penicillin": ("penicillin", "ペニシリン"),
        "azithromycin": ("azithromycin", "アジスロマイシン"), "aspirin": ("aspirin", "アスピリン"), "acetaminophen": ("acetaminophen", "アセトアミノフェン"), "paracetamol": ("paracetamol", "パラセタモール"),
    })
    symptoms: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "cough": ("cough", "咳", "せき"), "fever": ("fever", "発熱", "熱"), "pain": ("pain", "ache", "痛"), "rash": ("rash", "発疹", "皮疹"), "vomiting": ("vomit", "vomiting", "嘔吐", "吐き"),
        "diarrhea": ("diarrhea", "下痢"), "headache": ("headache", "頭痛"), "dizziness": ("dizzy", "dizziness", "めまい"),
        "breathlessness": ("breathless", "breathlessness", "shortness of breath", "息苦", "呼吸困難", "息切れ", "息が切れ", "呼吸が苦"), "nausea": ("nausea", "吐き気", "悪心"),
        "sputum": ("sputum", "phlegm", "痰", "喀痰"), "bleeding": ("bleed", "blood", "出血", "血"), "swelling": ("swelling", "swollen", "腫れ", "腫脹", "むくみ", "浮腫"), "fatigue": ("fatigue", "tired", "倦怠", "疲れ", "疲労", "だる"),
    })


VALUES = Lists()


def plain_decimal(part: Column) -> Column:
    """Without plus sign, thousands separators, leading zeros, and trailing ones after a point."""
    bare = F.regexp_replace(F.regexp_replace(part, ",", ""), r"^\+", "")
    sign, digits = F.regexp_extract(bare, "^-", 0), F.regexp_replace(F.regexp_replace(bare, "^-", ""), r"^0+(?=[0-9])", "")
    digits = F.when(digits.contains("."), F.regexp_replace(F.regexp_replace(digits, "0+$", ""), r"\.$", "")).otherwise(digits)
    return F.when(digits == "0", "0").otherwise(F.concat(sign, digits))


def number(token: Column) -> Column:
    """A number as written in its plain form: parts of a fraction each, a percent sign kept."""
    body = F.regexp_replace(token, "%$", "")
    return F.concat(F.array_join(F.transform(F.split(body, "/"), plain_decimal), "/"), F.regexp_extract(token, "%$", 0))


def as_digits(text: Column) -> Column:
    """Full-width percent signs, fractions and clock times of Japanese as digits."""
    text = F.regexp_replace(text, "％", "%")
    text = F.regexp_replace(text, r"(\d[\d,]*)\s*分の\s*(\d[\d,]*)", "$2/$1")
    return F.regexp_replace(text, r"(\d{1,2})\s*時\s*(\d{1,2})\s*分", "$1.$2")


def numbers(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(as_digits(text), F.lit(NUMBER), F.lit(0)), number)


def without_citations(text: Column) -> Column:
    return F.regexp_replace(text, CITATION, "")


def clinical_numbers(text: Column) -> Column:
    """Numbers that a unit, an age, a vital sign, or a time or percentage among clinical words makes matter; citations do not."""
    bare = F.element_at(F.transform(F.array(without_citations(text)), _clinical), 1)
    return F.array_distinct(bare)


def _clinical(text: Column) -> Column:
    tokens, gaps = F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.split(text, NUMBER, -1)
    ends = F.transform(tokens, lambda _, k: F.aggregate(F.arrays_zip(F.slice(gaps, F.lit(1), k + 1).alias("g"), F.slice(tokens, F.lit(1), k + 1).alias("t")), F.lit(0), lambda n, x: n + F.length(x["g"]) + F.length(x["t"])))

    def matters(x: Column) -> Column:
        end, token = x["e"], x["t"]
        start = end - F.length(token)
        left = F.substr(text, F.greatest(start - BEFORE, F.lit(0)) + 1, F.least(start, F.lit(BEFORE)))
        right = F.substr(text, end + 1, F.lit(AFTER))
        clinical = F.concat(left, F.lit(" "), right).rlike(CLINICAL_CONTEXT)
        age = left.rlike(r"(?i)\bage(?:d)?\s*$") | right.rlike(r"(?i)^\s*[- ]?year[- ]old\b") | right.rlike(r"^\s*歳")
        return right.rlike(CLINICAL_UNIT) | age | left.rlike(VITAL_BEFORE) | (token.endswith("%") & clinical) | (right.rlike(TIME_UNIT) & clinical)

    return F.transform(F.filter(F.arrays_zip(tokens.alias("t"), ends.alias("e")), matters), lambda x: number(x["t"]))


def missing_numbers(source: Column, target: Column, strict: bool = True) -> Column:
    """Numbers of the source (all, or the clinical ones) that the target has neither as such nor as a part of a fraction, in order."""
    wanted = F.array_distinct(numbers(without_citations(source))) if strict else clinical_numbers(source)
    found = numbers(without_citations(target))
    bare = lambda x: F.regexp_replace(x, "%+$", "")
    parts = F.transform(F.flatten(F.transform(found, lambda x: F.split(bare(x), "/"))), bare)
    # arrays of one stand for names: each side is worked out once
    held = F.transform(F.array(F.struct(wanted.alias("w"), found.alias("f"), parts.alias("p"))), lambda h: F.filter(h["w"], lambda x: ~F.array_contains(h["f"], x) & (x.contains("/") | ~F.array_contains(h["p"], bare(x)))))
    return F.element_at(held, 1)


def _lacking(found: Column, names: dict[str, tuple[str, ...]], low: Column) -> Column:
    """Those found of which the text has no name; what has no names stands for itself."""
    known = F.create_map(*(x for name, own in names.items() for x in (F.lit(name), F.array(*map(F.lit, own)))))
    return F.filter(found, lambda x: ~F.exists(F.coalesce(F.try_element_at(known, F.lower(x)), F.array(x)), lambda y: low.contains(F.lower(y))))


def fidelity_errors(source: Column, target: Column, lists: Lists = VALUES, strict: bool = True) -> Column:
    """Struct of numbers, negation, temporal_expression, units, medications, symptoms: arrays of what the target lacks, empty if nothing. Nulls are empty texts."""
    source, target = F.coalesce(source, F.lit("")), F.coalesce(target, F.lit(""))
    low, spoken = F.lower(target), F.regexp_replace(source, SPOKEN_DECIMAL, "$1.$2")
    missing = missing_numbers(spoken, target, strict)
    missing = F.when(target.contains("半"), F.array_remove(missing, "1/2")).otherwise(missing)
    none = F.array().cast("array<string>")
    lost = lambda pair, name: F.when(source.rlike(pair[0]) & ~target.rlike(pair[1]), F.array(F.lit(name))).otherwise(none)
    units = F.array_distinct(F.transform(F.regexp_extract_all(source, F.lit(lists.unit), F.lit(0)), F.lower))
    drugs = F.array_distinct(F.regexp_extract_all(source, F.lit(lists.drug), F.lit(0)))
    names = lambda text, own: F.exists(F.array(*map(F.lit, own)), lambda y: text.contains(F.lower(y)))
    symptoms = F.array_compact(F.array(*(F.when(names(F.lower(source), own) & ~names(low, own), F.lit(name)) for name, own in lists.symptoms.items())))
    return F.struct(
        missing.alias("numbers"), lost(lists.negation, "negation").alias("negation"), lost(lists.time, "time").alias("temporal_expression"),
        _lacking(units, lists.units, low).alias("units"), _lacking(drugs, lists.drugs, low).alias("medications"), symptoms.alias("symptoms"),
    )
