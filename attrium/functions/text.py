"""Column expressions on names, comments and their components. All native but nfkc()."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F

#: Hangul blocks, the codes of risks in their order, those that need generation and review.
HANGUL = r"\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{AC00}-\x{D7A3}\x{D7B0}-\x{D7FF}"
RISKS = ("empty_description", "unicode_normalization", "whitespace", "slash_ambiguity", "special_symbol", "english_translation_required", "numeric_sensitive", "terminology_conflict", "unsupported_character")
GENERATION = tuple(r for r in RISKS if r != "numeric_sensitive")
REVIEW = ("empty_description", "slash_ambiguity", "terminology_conflict", "unsupported_character")


def trim_all(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def upper_trim(c: Column) -> Column:
    return F.upper(trim_all(c))


def compact_identifier(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def normalize_korean_key(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)[\s_\-/·(),.]+", "")


def nfkc(c: Column) -> Column:
    """Unicode NFKC. Python sees only values with characters that NFKC may change."""

    @F.pandas_udf("string")
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))

    plain = c.isNull() | ~F.rlike(c, F.lit(r"[^\x00-\x7F\x{AC00}-\x{D7A3}]"))
    return F.when(plain, c).otherwise(normal(F.when(~plain, c)))


def compact_whitespace(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)\s+", "")


def normalize_column_name(c: Column) -> Column:
    return F.upper(compact_whitespace(nfkc(c)))


def normalize_description_key(c: Column) -> Column:
    return trim_all(F.regexp_replace(nfkc(c), r"(?U)\s+", " "))


def digit_sequences(c: Column) -> Column:
    return F.regexp_extract_all(nfkc(c), F.lit("[0-9]+"), 0)


def digits_preserved(a: Column, b: Column) -> Column:
    return digit_sequences(a) == digit_sequences(b)


def english_tokens(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("[A-Za-z]+"), 0)


def invalid_english_tokens(c: Column) -> Column:
    return F.filter(english_tokens(c), lambda x: x != "ID")


def forbidden_characters(c: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(c, f"ID|[0-9]|[{HANGUL}]", ""), ""), lambda x: x != "")


def symbols_in(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(nfkc(c), F.lit(r"[\p{P}\p{S}]"), 0))


def is_valid_name(c: Column, mode: str = "dictionary") -> Column:
    """dictionary: Hangul syllables and digits only; audit: `ID` beside them, or alone; comment: not empty and no forbidden character."""
    if mode == "audit":
        return F.coalesce((c == "ID") | F.rlike(F.replace(c, F.lit("ID"), F.lit("")), F.lit(r"^[\x{AC00}-\x{D7A3}0-9]+$")), F.lit(False))
    if mode == "dictionary":
        return F.coalesce(F.rlike(c, F.lit(r"^[\x{AC00}-\x{D7A3}0-9]+$")), F.lit(False))
    return F.coalesce((c != "") & (F.size(forbidden_characters(c)) == 0), F.lit(False))


def can_keep_description(c: Column) -> Column:
    return F.coalesce((c != "") & (c == nfkc(c)) & (F.size(forbidden_characters(c)) == 0), F.lit(False))


def let(value: Column, then) -> Column:
    """then(value), with value worked out once however often it is used."""
    return F.transform(F.array(value), then)[0]


def classify_risk(c: Column, conflict: Column | None = None) -> Column:
    """Struct of codes (in the order of RISKS), level, requires_generation, requires_review.

    A null description counts as empty. conflict: whether a terminology conflict is known. The normal form is
    made once, and the codes once from it."""
    raw = F.coalesce(c, F.lit(""))
    known = F.coalesce(conflict, F.lit(False)) if conflict is not None else F.lit(False)

    def codes(x: Column) -> Column:
        text = x["text"]
        tests = {
            "empty_description": text == "",
            "unicode_normalization": text != x["raw"],
            "whitespace": F.rlike(text, F.lit(r"(?U)[\s\x{1C}-\x{1F}]")),
            "slash_ambiguity": F.contains(text, F.lit("/")),
            "special_symbol": F.rlike(text, F.lit(r"[\p{P}\p{S}]")),
            "english_translation_required": F.size(invalid_english_tokens(text)) > 0,
            "numeric_sensitive": F.rlike(text, F.lit("[0-9]")),
            "terminology_conflict": x["known"],
            "unsupported_character": F.rlike(text, F.lit(rf"(?U)[^A-Za-z0-9{HANGUL}\s\x{{1C}}-\x{{1F}}\p{{P}}\p{{S}}]")),
        }
        return F.filter(F.array(*[F.when(tests[k], F.lit(k)) for k in RISKS]), lambda k: k.isNotNull())

    def judged(found: Column) -> Column:
        has = lambda some: F.arrays_overlap(found, F.array(*map(F.lit, some)))
        level = (
            F.when(F.array_contains(found, "empty_description"), "critical")
            .when(has(("slash_ambiguity", "english_translation_required")), "high")
            .when(F.size(found) > 0, "medium")
            .otherwise("low")
        )
        return F.struct(found.alias("codes"), level.alias("level"), has(GENERATION).alias("requires_generation"), has(REVIEW).alias("requires_review"))

    return let(let(F.struct(nfkc(raw).alias("text"), raw.alias("raw"), known.alias("known")), codes), judged)


def join_full_name(parts: Column) -> Column:
    clean = F.transform(parts, lambda x: F.upper(trim_all(F.regexp_replace(x, r"(?U)\s+", " "))))
    return F.array_join(F.filter(clean, lambda x: x != ""), " ")


def join_korean_name(parts: Column) -> Column:
    """Parts joined without their other characters, without neighbours that repeat, with 일시 for its
    spelt-out forms and one 코드, 번호 or 여부 at the end. A null part is the placeholder 미정."""
    clean = F.filter(F.transform(parts, lambda x: F.regexp_replace(F.coalesce(x, F.lit("미정")), r"[^\x{AC00}-\x{D7A3}0-9]", "")), lambda x: x != "")
    once = F.aggregate(clean, F.array().cast("array<string>"), lambda a, x: F.when(F.try_element_at(a, F.lit(-1)).eqNullSafe(x), a).otherwise(F.concat(a, F.array(x))))
    name = F.regexp_replace(F.array_join(once, ""), "일자시각|일자시간|날짜시각", "일시")
    return F.regexp_replace(name, "(코드|번호|여부)(?:\\1)+$", "$1")


def evidence_text(components: Column) -> Column:
    """components: structs of fragment, full, korean, origin."""
    return F.array_join(F.transform(components, lambda x: F.concat(x["fragment"], F.lit("→"), x["full"], F.lit("→"), x["korean"], F.lit("["), x["origin"], F.lit("]"))), " | ")


def parse_evidence(c: Column) -> Column:
    """Inverse of evidence_text, with start and end of each fragment."""
    at = lambda g: F.regexp_extract_all(c, F.lit(r"([^→|]*?)→([^→]*)→([^→\[]*)\[(\w+)\](?: \| )?"), g)
    rows = F.arrays_zip(at(1).alias("fragment"), at(2).alias("full"), at(3).alias("korean"), at(4).alias("origin"))
    none = F.array().cast("array<struct<fragment:string,full:string,korean:string,origin:string,start:int,end:int>>")
    place = lambda a: F.coalesce(F.try_element_at(a, F.lit(-1))["end"], F.lit(0))
    return F.aggregate(
        rows,
        none,
        lambda a, x: F.concat(a, F.array(F.struct(x["fragment"].alias("fragment"), x["full"].alias("full"), x["korean"].alias("korean"), x["origin"].alias("origin"), place(a).alias("start"), (place(a) + F.length(x["fragment"])).alias("end")))),
    )


def parse_risk_codes(c: Column) -> Column:
    return F.array_distinct(clean_list(F.split(c, "[,;|]")))


def clean_list(c: Column) -> Column:
    return F.filter(F.transform(c, trim_all), lambda x: x != "")


def stable_unique(c: Column) -> Column:
    return F.array_distinct(c)


def context_text(*cols: Column) -> Column:
    return F.concat_ws(" ", *[F.when(trim_all(c) != "", trim_all(c)) for c in cols])


def decode_model_json(c: Column, schema: str) -> Column:
    """The first JSON value of a model's answer: without <think> parts and code fences; what follows is ignored."""
    text = F.regexp_replace(F.regexp_replace(c, "(?s)<think>.*?</think>", ""), "```(?:json)?", "")
    return F.from_json(F.regexp_extract(text, r"(?s)[{\[].*$", 0), schema)


def confidence_score(coverage: Column, unresolved: Column, ambiguity: Column, complete: Column, split_ambiguous: Column) -> Column:
    c = F.bround(70 * coverage) + F.when(coverage == 1, 15).otherwise(0) - F.when(unresolved, 20).otherwise(0)
    c = c - F.least(F.lit(24), 6 * ambiguity) - F.when(split_ambiguous, F.least(F.lit(16), 4 * (complete - 1))).otherwise(0)
    return F.greatest(F.lit(0), F.least(F.lit(100), c)).cast("int")


def contains_distinct(text: Column, candidate: Column, group: Column) -> Column:
    """Whether text holds candidate other than within a longer member of group that holds it too."""
    longer = F.exists(group, lambda g: (F.length(g) > F.length(candidate)) & F.contains(g, candidate) & F.contains(text, g))
    return F.contains(text, candidate) & ~longer
