"""Names, keys and labels as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

NAME_MARKS = r"[\[\]()_\-.]+"
REPORT_SUFFIX = "_현황_폴리곤"
UNKNOWN = "미확인"
# Province name forms, in the order in which they are looked for in a file name.
PROVINCES = {
    "서울": "서울특별시", "부산": "부산광역시", "대구": "대구광역시", "인천": "인천광역시", "광주": "광주광역시", "대전": "대전광역시",
    "울산": "울산광역시", "세종": "세종특별자치시", "경기": "경기도", "강원": "강원특별자치도", "충북": "충청북도", "충남": "충청남도",
    "전북": "전북특별자치도", "전남": "전라남도", "경북": "경상북도", "경남": "경상남도", "제주": "제주특별자치도",
}
# Suffix patterns of city, county and ward names.
REGION_PATTERNS = (r"([가-힣]+시)(?!도)", r"([가-힣]+군)", r"([가-힣]+구)")
# Codes by full province name and by the region words of file names; the rest lies in the west belt.
DEFAULT_CRS = "EPSG:5186"
EAST_CRS, ISLAND_CRS = "EPSG:5187", "EPSG:5188"
EAST_PROVINCES = ("부산광역시", "대구광역시", "울산광역시", "경상남도", "경상북도")
SPLIT_PROVINCE, ISLAND_COUNTIES = "강원특별자치도", ("울릉군",)
SPLIT_EAST = ("속초시", "고성군", "양양군", "강릉시", "동해시", "삼척시", "태백시")
WEST_WORDS = ("서울", "인천", "대전", "광주", "세종", "경기", "충청", "전라", "전북", "제주")
EAST_WORDS = ("부산", "대구", "울산", "경상", "경북", "경남")
SPLIT_WORD, SPLIT_EAST_WORDS = "강원", ("속초", "고성", "양양", "강릉", "동해", "삼척", "태백")
# The seven name forms, first match wins; groups are province (or city), county, district.
NAME_FORMS = (
    r"^'?(?:\d+년?)_([가-힣]+)_([가-힣]+[시군구])_([가-힣0-9,]+지구)_",
    r"^'?(?:\d+년도?)\s+([가-힣]+(?:특별자치도|특별시|광역시|도))\s+([가-힣]+[시군구])\s+([가-힣0-9,]+지구)_",
    r"^'?(?:\d+년?)_([가-힣]+(?:남도|특별자치도|특별시|광역시|도))_([가-힣]+[시군구])_([가-힣0-9,]+지구)_",
    r"^'?(?:\d+년도?)_([가-힣]+)_([가-힣]+[구])_([가-힣0-9,]+지구)_",
    r"^'?(?:\d+년?)_([가-힣]+시)_([가-힣]+구)_([가-힣0-9,]+지구)_",
    r"^'?(?:\d+년?)_([가-힣]+시)_([가-힣0-9,]+지구)_",
    r"^'?(?:\d+년?)_([가-힣]+시)\s+([가-힣]+동)_([가-힣0-9,]+지구)_",
)


def clean_name(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, NAME_MARKS, " "), r"\s+", " "))


def stem(c: Column) -> Column:
    """File name without folders, extension or the report suffix."""
    base = F.substring_index(c, "/", -1)
    return F.replace(F.regexp_replace(base, r"\.[A-Za-z0-9]+$", ""), F.lit(REPORT_SUFFIX), F.lit(""))


def unquoted(c: Column) -> Column:
    """A name without leading quotes and without backticks."""
    return F.replace(F.regexp_replace(c, "^['`]+", ""), F.lit("`"), F.lit(""))


def region_names(c: Column) -> Column:
    """City, then county, then ward names in a file name, each once."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(unquoted(stem(c)), F.lit(p), 1) for p in REGION_PATTERNS]))


def province_of(c: Column) -> Column:
    """Full name of the first province whose short name stands in a file name, else null."""
    return F.coalesce(*[F.when(c.contains(k), F.lit(v)) for k, v in PROVINCES.items()])


def name_form(c: Column) -> Column:
    """1-based number of the first form that matches, null when none does."""
    return F.coalesce(*[F.when(unquoted(c).rlike(p), F.lit(i + 1)) for i, p in enumerate(NAME_FORMS)])


def name_parts(c: Column) -> Column:
    """(province, county, district) by the first form that matches; a form of two groups has an unknown district."""
    name = unquoted(c)

    def parts(p):
        n = len(re.findall(r"\((?!\?)", p))
        g = [F.regexp_extract(name, p, i) for i in range(1, n + 1)] + [F.lit(UNKNOWN)] * (3 - n)
        return F.when(name.rlike(p), F.struct(*[v.alias(k) for v, k in zip(g, ("province", "county", "district"))]))
    return F.coalesce(*[parts(p) for p in NAME_FORMS])


def region_crs(province: Column, county: Column) -> Column:
    """Code by full province name, with the island and the split province by county; the west belt otherwise."""
    return (F.when(county.isin(*ISLAND_COUNTIES), ISLAND_CRS)
            .when(province == SPLIT_PROVINCE, F.when(county.isin(*SPLIT_EAST), EAST_CRS).otherwise(DEFAULT_CRS))
            .when(province.isin(*EAST_PROVINCES), EAST_CRS).otherwise(DEFAULT_CRS))


def detect_crs(own: Column, name: Column) -> Column:
    """The file's own code if it is a known belt, else by a region word in its name, else by the county of the split province, else null."""
    has = lambda words: name.rlike("|".join(words))
    return (F.when(own.isin(DEFAULT_CRS, EAST_CRS), own).when(has(WEST_WORDS), DEFAULT_CRS).when(has(EAST_WORDS), EAST_CRS)
            .when(name.contains(SPLIT_WORD), F.when(has(SPLIT_EAST_WORDS), EAST_CRS).otherwise(DEFAULT_CRS)))


def distance_label(d: Column) -> Column:
    return F.format_string("%.1fm", d)


def content_key(*parts: Column) -> Column:
    return F.md5(F.concat_ws("_", *parts))


def session_name(base: Column, index: Column, total: Column) -> Column:
    """base-index only where a file has several polygons."""
    return F.when(total > 1, F.concat_ws("-", base, index.cast("string"))).otherwise(base)
