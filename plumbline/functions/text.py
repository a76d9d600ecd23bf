"""Answer extraction, normalisation and score parsing, as built-in expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of guide words, options and numbers, and the words that a box may hold.
GUIDE = r"(?iuU)(?:The answer is|Final Answer[:\s]*|The correct option is[:\s]*|Answer[:\s]*)\s*([^\n]+)"
BRACKETED = r"(?iuU)[\(\[\{]([A-Z])[\)\]\}]"
LEADING = r"(?iuU)^(?:Option|Answer|Choice)?\s*([A-Z])(?:\.|:|\)|\s|$)"
NUMBER = r"(?U)[-+]?\d*\.\d+|\d+"
BOX_WORDS = ("text", "textbf", "boxed", "huge", "cal", "rm")
CONFIDENCE = r"(?iuU)Confidence[:\s]*(\d+)"
#: Letters whose upper case is several, and the one letter that stands for it (itself where there is none).
SEVERAL = {c: "ẞ" if c == "ß" else c.title() if len(c.title()) == 1 else c for c in map(chr, range(0x80, 0x110000)) if len(c.upper()) > 1}


def let(value: Column, body) -> Column:
    """body(value) with value worked out once."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def upper_letter(c: Column) -> Column:
    """Upper case of a single letter as a single letter: ß becomes ẞ, not SS."""
    return F.when(F.length(F.upper(c)) == 1, F.upper(c)).otherwise(F.translate(c, "".join(SEVERAL), "".join(SEVERAL.values())))


def none_if_empty(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def balanced(body: Column) -> Column:
    """What stands before the brace that closes an open one; null if none does."""

    def step(s, ch):
        depth = s["depth"] + F.when(ch == "{", 1).when(ch == "}", -1).otherwise(0)
        at = s["at"] + 1
        return F.struct(F.when(s["end"] > 0, s["depth"]).otherwise(depth).alias("depth"), at.alias("at"), F.when((s["end"] == 0) & (depth == 0), at).otherwise(s["end"]).alias("end"))

    zero = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
    end = F.aggregate(F.split(body, ""), zero, step, lambda s: s["end"])
    return let(end, lambda e: F.when(e > 0, F.substr(body, F.lit(1), e - 1)))


def boxed(text: Column) -> Column:
    r"""Content of the last ``\boxed{...}``, braces balanced; null without one."""
    after = F.substring_index(text, "\\boxed", -1)
    found = F.contains(text, F.lit("\\boxed")) & F.contains(after, F.lit("{"))
    return F.when(found, let(after, lambda a: balanced(F.substr(a, F.instr(a, "{") + 1))))


def _target(text: Column) -> Column:
    """The stretch of the (stripped) text that an answer is read from: box, ####, guide word, or all."""
    box = none_if_empty(strip(boxed(text)))
    hashes = F.substring_index(strip(F.substring_index(text, "####", -1)), "\n", 1)
    guide = strip(F.regexp_extract(text, GUIDE, 1))
    other = F.when(F.contains(text, F.lit("####")), hashes).otherwise(guide)
    return F.coalesce(box, none_if_empty(other), text)


def _option(target: Column) -> Column:
    """An option letter: bracketed, leading, or the only letter there is."""
    alone = F.regexp_replace(F.upper(target), "[^A-Z]", "")
    return F.coalesce(
        none_if_empty(F.upper(F.regexp_extract(target, BRACKETED, 1))),
        none_if_empty(F.upper(F.regexp_extract(target, LEADING, 1))),
        F.when(F.length(alone) == 1, alone),
    )


def last_number(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(NUMBER), F.lit(0)), F.lit(-1))


def extract_build(text: Column, task: str = "GPQ") -> Column:
    """Answer of a sampled text: an option (GPQ) or the last number (MATH); null without one."""
    if task not in ("GPQ", "MATH"):
        return F.lit(None).cast("string")
    clean = lambda t: last_number(F.translate(t, ",$\\%", ""))
    return F.when(text != "", let(strip(text), lambda t: let(_target(t), _option if task == "GPQ" else clean)))


def extract_vl(text: Column, task: str = "GPQ") -> Column:
    """As ``extract_build`` for options, whatever the task."""
    return extract_build(text, "GPQ")


def extract_fix(text: Column, task: str = "GPQ") -> Column:
    """Answer of a text in the re-judging stage: box, all behind ####, or the last 100 characters;
    signs and box words blanked; the last single letter (GPQ), in upper case, or number (MATH)."""

    def read(t):
        other = F.when(F.contains(t, F.lit("####")), F.substring_index(t, "####", -1)).otherwise(F.right(t, F.lit(100)))
        clean = F.translate(F.coalesce(none_if_empty(boxed(t)), none_if_empty(other)), "~\\$%{}", "      ")
        for word in BOX_WORDS:
            clean = F.replace(clean, F.lit(word), F.lit(" "))
        if task == "MATH":
            return last_number(F.replace(clean, F.lit(","), F.lit("")))
        tokens = F.transform(F.split(clean, r"(?U)\s+"), lambda x: F.translate(x, ".:)(", ""))
        letters = F.transform(F.filter(tokens, lambda x: F.length(x) == 1), upper_letter)
        return F.try_element_at(F.filter(letters, lambda x: x.rlike(r"^\p{L}$")), F.lit(-1))

    if task not in ("GPQ", "MATH"):
        return F.lit(None).cast("string")
    return F.when(text != "", let(strip(text), read))


def shown_double(d: Column) -> Column:
    """A double as shortest decimal text: plain from 1e-4 to 1e16, else with an exponent of two digits."""

    def shape(s):
        sign = F.when(F.startswith(s, F.lit("-")), "-").otherwise("")
        mantissa = F.replace(F.substring_index(s, "E", 1), F.lit("-"), F.lit(""))
        power = F.substring_index(s, "E", -1).try_cast("int")
        digits = F.regexp_replace(F.replace(mantissa, F.lit("."), F.lit("")), "(?<=.)0+$", "")
        whole = F.rpad(F.substr(digits, F.lit(1), power + 1), power + 1, "0")
        rest = F.substr(digits, power + 2)
        large = F.concat(whole, F.lit("."), F.when(rest == "", "0").otherwise(rest))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -power - 1), digits)
        lead, tail = F.substr(digits, F.lit(1), F.lit(1)), F.substr(digits, F.lit(2))
        exponent = F.concat(lead, F.when(tail == "", "").otherwise(F.concat(F.lit("."), tail)), F.lit("e"), F.when(power < 0, "-").otherwise("+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
        exponent = F.when(F.abs(power) > 99, F.concat(F.regexp_replace(exponent, r"\d\d$", ""), F.abs(power).cast("string"))).otherwise(exponent)
        body = F.when((power >= 0) & (power < 16), large).when((power < 0) & (power >= -4), small).otherwise(exponent)
        plain = ~F.contains(s, F.lit("E"))
        named = F.when(s == "Infinity", "inf").when(s == "-Infinity", "-inf").when(s == "NaN", "nan")
        return F.coalesce(named, F.when(plain, s).otherwise(F.concat(sign, body)))

    return let(d.cast("string"), shape)


def _ascii_digits(c: Column) -> Column:
    """Decimal digits of all scripts as 0 to 9."""
    digits = [chr(i) for i in range(0x80, 0x110000) if unicodedata.category(chr(i)) == "Nd"]
    return F.translate(c, "".join(digits), "".join(str(unicodedata.digit(d)) for d in digits))


def numeric_text(c: Column) -> Column:
    """Texts that read as a number, in its shortest form; others as they are.  A dot makes a
    double of it; otherwise signs and leading zeros of a whole number go, whatever its size.  White
    space around it and digits of any script are read too."""

    def form(x):
        odd = x.rlike(r"[^\x21-\x7E]")  # few answers need more than this look
        return let(F.when(odd, strip(_ascii_digits(x))).otherwise(x), lambda s: shown(s, x))

    def shown(s, x):
        bare = F.replace(s, F.lit("_"), F.lit(""))
        unsigned = F.regexp_replace(bare, "^[+-]?0*(?=.)", "")
        whole = F.when((unsigned != "0") & F.startswith(bare, F.lit("-")), F.concat(F.lit("-"), unsigned)).otherwise(unsigned)
        is_whole = s.rlike(r"^[+-]?\d+(_\d+)*$")
        is_double = s.rlike(r"^[+-]?(\d+(_\d+)*\.(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$")
        return F.when(is_whole, whole).when(is_double, shown_double(bare.try_cast("double"))).otherwise(x)

    return let(c, form)


def normalize_build(c: Column) -> Column:
    """Stripped, without $ and spaces, numbers in shortest form; null is empty."""
    return numeric_text(F.translate(strip(F.coalesce(c, F.lit(""))), "$ ", ""))


def normalize_vl(c: Column) -> Column:
    """Stripped, without $ and spaces, upper case; null is empty."""
    return F.upper(F.translate(strip(F.coalesce(c, F.lit(""))), "$ ", ""))


def normalize_fix(c: Column) -> Column:
    """As ``normalize_build``, without commas too."""
    return numeric_text(F.translate(strip(F.coalesce(c, F.lit(""))), ",$ ", ""))


def normalize_veto(c: Column) -> Column:
    """Stripped, without spaces and one leading $, numbers in shortest form; null is empty."""
    return numeric_text(F.regexp_replace(F.translate(strip(F.coalesce(c, F.lit(""))), " ", ""), r"^\$", ""))


def correct(answer: Column, gold: Column, normalize=normalize_build) -> Column:
    """Whether both are equal when normalised; two empty ones are."""
    return normalize(answer) == normalize(gold)


def without_think(c: Column) -> Column:
    """Without closed think blocks, stripped; an open block stays."""
    return strip(F.regexp_replace(c, "(?s)<think>.*?</think>", ""))


def confidence(c: Column) -> Column:
    """The first confidence that a reply states, from 0 to 100; 0 without one."""
    digits = F.regexp_extract(without_think(F.coalesce(c, F.lit(""))), CONFIDENCE, 1)
    many = F.length(F.regexp_replace(digits, "^0+", "")) > 3
    return F.when(digits == "", 0).when(many, 100).otherwise(F.least(digits.try_cast("int"), F.lit(100)))
