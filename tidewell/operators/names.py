"""Names of products, brands and companies brought to comparable keys, by ordered replacements in column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Company forms, what stays of a key, marks that go from a brand, bracketed sun-care figures.
COMPANY_FORMS = r"(?iU)주식회사|유한회사|유한책임회사|\(주\)|\(유\)|\bco\.?,?\s*ltd\b\.?|\bcorp(?:oration)?\b\.?|\binc\b\.?"
NOT_KEY = "[^0-9a-z가-힣]+"
BRAND_MARKS = r"(?U)[\s™®().\-_/]"
BRACKET_FIGURES = r"(?i)\[(SPF[^\]]*|PA[^\]]*)\]"


@F.arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    """Compatibility forms composed (Arrow's own function takes Hangul syllables apart)."""
    return pa.array([t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()], pa.string())


def folded(name: Column) -> Column:
    """Hangul syllables, Latin letters and digits alone, in small letters; null is empty."""
    return F.regexp_replace(F.lower(nfkc(F.coalesce(name, F.lit("")))), NOT_KEY, "")


def company_key(name: Column) -> Column:
    """The key that a company's records meet by: its legal form goes first. A key is its own key."""
    return F.regexp_replace(F.lower(F.regexp_replace(nfkc(F.coalesce(name, F.lit(""))), COMPANY_FORMS, " ")), NOT_KEY, "")


def brand_key(brand: Column, aliases: Mapping[str, str] = {}) -> Column:  # noqa: B006 - never changed
    """A brand in small letters without marks and blanks, then by the alias table; null is empty."""
    bare = F.regexp_replace(F.lower(F.coalesce(brand, F.lit(""))), BRAND_MARKS, "")
    if not aliases:
        return bare
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, bare), bare)


@dataclass(frozen=True)
class NameRules:
    """What goes from a product's name, in order: ``noise``, words ``glued`` to a name, sales ``words`` that stand alone; then ``synonyms`` (pattern, replacement)."""

    noise: str
    glued: Sequence[str]
    words: Sequence[str]
    synonyms: Sequence[tuple[str, str]]


# The vocabulary of Korean cosmetics listings.
KOREAN_LISTINGS = NameRules(
    noise=r"(?iU)\[.*?\]|\(.*?\)|【.*?】|SPF\s*\d+\+*|PA\++|\d+(\.\d+)?\s*(ml|mL|g|kg|매입|매|입|개입|개|ea|EA|p|P|호|종|장|정|포|pcs|fl\.?\s*oz\.?|oz)(\b|(?=[^A-Za-z0-9]))|\b\d+\s*\+\s*\d+\b|\d+\s*colors?|\d+\s*색|\d+\s*종|x\s*\d+|X\s*\d+|\*\s*\d+|/\s*\d[\d\.]*\s*(fl\.?\s*oz|oz)",
    glued=("기획", "단품", "세트", "리필", "더블", "증정"),
    words=(
        "기획", "본품", "리필", "단품", "세트", "더블", "증정", "한정", "올영픽", "올영", "픽", "특가", "신상", "NEW", "대용량", "업그레이드", "리뉴얼", "1+1", "2입", "3입", "2개입", "더블기획",
        "기획세트", "듀오", "구성", "랜덤", "택1", "택", "선택", "추가", "온라인", "단독", "공식", "정품", "국내", "수입", "용량", "사은품", "무료", "배송", "pick", "PICK", "한정판", "에디션",
        "리미티드", "패키지", "세일", "할인", "할인가",
    ),
    synonyms=(
        ("썬", "선"), ("쿠션팩트", "쿠션"), ("폼클렌저|폼 클렌저|클렌징폼|클렌징 폼|포밍클렌저|폼 클렌징", "클렌징폼"), (r"크림\s*패드", "패드"), ("수분크림", "수분 크림"),
        ("오드퍼퓸|오 드 퍼퓸|오드 퍼퓸|EDP", "오드퍼퓸"), ("오드뚜왈렛|오 드 뚜왈렛|오드 뚜왈렛|EDT", "오드뚜왈렛"), ("마스크팩|마스크 팩", "마스크"), ("시트마스크|시트 마스크", "마스크"),
        ("선 크림", "선크림"), ("썬크림", "선크림"), ("토너패드|토너 패드", "패드"), ("샴푸바", "샴푸"), ("립 틴트", "립틴트"), (r"([가-힣])(\d)", "$1 $2"),
    ),
)


def product_name(name: Column, brand: Column | None = None, rules: NameRules = KOREAN_LISTINGS, keep_brackets: Column | bool = False) -> Column:
    """A product's name without what sellers add, in eight passes: brackets' marks where their text is kept, noise,
    glued words, sales words, synonyms, small letters without the brand (as it is, then without blanks), marks and
    bare dots, blanks. Null is empty.
    """
    n = F.coalesce(name, F.lit(""))
    bare = F.translate(F.regexp_replace(n, BRACKET_FIGURES, " "), "[]", "  ")
    n = bare if keep_brackets is True else n if keep_brackets is False else F.when(keep_brackets, bare).otherwise(n)
    n = F.regexp_replace(n, rules.noise, " ")
    if rules.glued:
        n = F.regexp_replace(n, f"(?<=[가-힣A-Za-z])({'|'.join(rules.glued)})(?![가-힣])", " ")
    # one word after another, as an earlier one's blank parts what follows it
    n = F.aggregate(F.array(*[F.lit(rf"(?<![A-Za-z가-힣])\Q{w}\E(?![A-Za-z가-힣])") for w in rules.words]).cast("array<string>"), n, lambda s, w: F.regexp_replace(s, w, F.lit(" ")))
    for pattern, said in rules.synonyms:
        n = F.regexp_replace(n, pattern, said)
    n = F.lower(n)
    if brand is not None:
        own = F.lower(F.coalesce(brand, F.lit("")))
        without = F.replace(F.replace(n, own, F.lit(" ")), F.replace(own, F.lit(" "), F.lit("")), F.lit(" "))
        n = F.when(F.length(own) > 0, without).otherwise(n)
    n = F.regexp_replace(F.regexp_replace(n, r"(?U)[^\w가-힣.]+", " "), r"(?U)(?<!\d)\.|\.(?!\d)", " ")
    return F.trim(F.regexp_replace(n, r"(?U)\s+", " "))


def line_key(name: Column, brand_keys: Column, rules: NameRules = KOREAN_LISTINGS) -> Column:
    """What is left of a name's key when its brand's spellings (an array of keys) have gone, the longest first, those of one length by name."""
    first = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    keys = F.array_sort(F.filter(F.coalesce(brand_keys, F.array().cast("array<string>")), lambda k: F.length(k) > 0), first)
    return F.aggregate(keys, folded(product_name(name, None, rules)), lambda s, k: F.replace(s, k, F.lit("")))
