"""Text scalars: keys, counts, keyword matching, tokens and names. All are JVM-side expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .numbers import col, ladder


def match_key(c) -> Column:
    """Lower-cased text without white space, Unicode spaces included; null is ''."""
    return F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"(?U)\s+", "")


def word_count(c) -> Column:
    """White-space separated words; 0 for null and blank."""
    return F.size(F.filter(F.split(F.coalesce(col(c), F.lit("")), r"(?U)\s+"), lambda x: x != ""))


def stripped(c) -> Column:
    return F.regexp_replace(col(c), r"(?U)^\s+|\s+$", "")


# Names and bounds of both length scales.
def length_bucket(words: Column) -> Column:
    return ladder(words, (5, "Very Short (≤5w)"), (15, "Short (6-15w)"), (50, "Medium (16-50w)"), top="Long (>50w)")


def length_class(words: Column) -> Column:
    return ladder(words, (9, "short"), (50, "medium"), top="long")


def contains_any(c, keywords: list[str]) -> Column:
    """Whether the lower-cased text holds a keyword; keywords are taken as they are."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    return F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(text, k))


def keywords_in(c, keywords: list[str]) -> Column:
    text = F.lower(F.coalesce(col(c), F.lit("")))
    return F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(text, k))


def topics_in(c, topics: dict[str, list[str]]) -> Column:
    """Ids of the topics with a keyword in the text, in id order: every list is tried once."""
    return F.filter(F.array(*[F.when(contains_any(c, k), t) for t, k in sorted(topics.items())]), lambda x: x.isNotNull())


def matched_reason(c, keywords: list[str], most: int = 3) -> Column:
    found = F.slice(keywords_in(c, keywords), 1, most)
    return F.when(F.size(found) == 0, "none").otherwise(F.concat(F.lit("matched: "), F.array_join(found, ", ")))


def terms_in(c, terms: list[str]) -> Column:
    """Distinct terms in the text, both sides lower-cased."""
    text = F.lower(F.coalesce(col(c), F.lit("")))
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, F.lower(t)))


def groups_in(c, groups: dict[str, list[str]]) -> Column:
    return F.filter(F.array(*[F.when(contains_any(c, k), g) for g, k in groups.items()]), lambda x: x.isNotNull())


def error_reason(words: Column, slang: Column, groups: Column) -> Column:
    """Why a caption may have been misread: the first rule that holds."""
    return (
        F.when(words < 10, "caption too short").when(F.size(slang) > 0, "slang/metaphor")
        .when(F.size(groups) >= 2, "multi-topic or keyword boundary ambiguity").when(words > 50, "long/noisy caption")
        .otherwise("keyword overfitting or label boundary ambiguity")
    )


#: Fixed value: runs of letters and digits, or runs of other signs.
TOKEN = r"[0-9A-Za-zÀ-ỹà-ỹ]+|[^\sA-Za-zÀ-ỹà-ỹ0-9]+"


def tokens(c) -> Column:
    return F.regexp_extract_all(F.coalesce(col(c), F.lit("")), F.lit(TOKEN), F.lit(0))


# Abbreviations that are normalised even when capitalised.
ALWAYS = ["ko", "đc", "k", "h", "t", "mk"]


CAPITAL, SMALL = r"\p{IsUppercase}\p{Lt}", r"\p{IsLowercase}"


def is_proper(tok: Column) -> Column:
    """Whether a token has a capital, and each of its letters is a capital, or is one exactly where no letter stands before it."""
    letter = CAPITAL + SMALL
    title = ~tok.rlike(f"[{letter}][{CAPITAL}]|(?<![{letter}])[{SMALL}]")
    return tok.rlike(f"[{CAPITAL}]") & (title | ~tok.rlike(rf"[{SMALL}\p{{Lt}}]"))


def normalised(c, dictionary: Column) -> Column:
    """(text, count, words): tokens replaced by the dictionary's first candidate.

    dictionary: a map from a lower-case word to its first candidate. Capitalised and all-capital tokens stay,
    but for ALWAYS; only tokens that the dictionary has are looked at for their capitals.
    """
    def step(found):
        tok = found["tok"]
        new = F.when(found["new"].isNotNull() & (~is_proper(tok) | F.lower(tok).isin(ALWAYS)), found["new"])
        return F.struct(F.coalesce(new, tok).alias("out"), F.when(new.isNotNull(), tok).alias("nsw"))

    found = F.transform(tokens(c), lambda tok: F.struct(tok.alias("tok"), F.try_element_at(dictionary, F.lower(tok)).alias("new")))
    steps = F.transform(found, step)
    text = F.regexp_replace(F.array_join(F.transform(steps, lambda s: s["out"]), " "), r"(?U)\s+([.,!?;:])", "$1")
    words = F.filter(F.transform(steps, lambda s: s["nsw"]), lambda x: x.isNotNull())
    return F.struct(text.alias("text"), F.size(words).alias("count"), words.alias("words"))


# Display names of topics.
TOPIC_NAMES = {
    "POLITICS": "Politics",
    "ECONOMY_BUSINESS_AND_FINANCE": "Economy, Business & Finance",
    "CRIME_LAW_AND_JUSTICE": "Crime, Law & Justice",
    "ENVIRONMENT": "Environment",
    "HEALTH": "Health",
    "DISASTER_ACCIDENT_AND_EMERGENCY_INCIDENT": "Disasters, Accidents & Emergencies",
    "ARTS_CULTURE_ENTERTAINMENT_AND_MEDIA": "Arts, Culture, Entertainment & Media",
    "HUMAN_INTEREST": "Human Interest",
    "LABOR": "Labor",
    "LIFESTYLE_AND_LEISURE": "Lifestyle & Leisure",
    "TRANSPORT_INFRASTRUCTURE": "Transport & Infrastructure",
    "OTHER": "Other",
    "OTHER_UNCLASSIFIED": "Other",
}


def topic_name(c, with_code: bool = False) -> Column:
    c = col(c)
    coded = F.contains(c, F.lit(". "))
    rest = F.when(coded, F.get(F.split(c, r"\. ", 2), F.lit(1))).otherwise(c)
    names = F.create_map(*[F.lit(x) for pair in TOPIC_NAMES.items() for x in pair])
    name = F.coalesce(F.try_element_at(names, rest), F.initcap(F.replace(rest, F.lit("_"), F.lit(" "))))
    code = F.when(coded, F.concat(topic_code(c), F.lit(". "))).otherwise("") if with_code else F.lit("")
    return F.when(c.isNull(), "Other").otherwise(F.concat(code, name))


def topic_code(c) -> Column:
    c = col(c)
    return F.when(F.contains(c, F.lit(". ")), F.get(F.split(c, r"\. ", 2), F.lit(0))).otherwise(c)


def preview(c, n: int = 100) -> Column:
    return F.concat(F.substring(col(c), 1, n), F.lit("..."))


def parsed_count(c) -> Column:
    """'1,2K' as 1200: commas are decimal points, so '1,234' is 1; an unreadable number is null, no number 0."""
    text = F.upper(F.replace(stripped(c), F.lit(","), F.lit(".")))
    number, unit = F.regexp_extract(text, r"([0-9.]+)\s*([KMB]?)", 1), F.regexp_extract(text, r"([0-9.]+)\s*([KMB]?)", 2)
    scale = F.when(unit == "K", 1e3).when(unit == "M", 1e6).when(unit == "B", 1e9).otherwise(1.0)
    return F.when(F.coalesce(number, F.lit("")) == "", F.lit(0)).otherwise((number.try_cast("double") * scale).try_cast("bigint")).cast("bigint")


def slug(c) -> Column:
    return F.regexp_replace(F.regexp_replace(col(c), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")


def url_id(c) -> Column:
    return F.substring_index(F.split_part(col(c), F.lit("?"), F.lit(1)), "/", -1)


# Places of a follower count in a page's source, in order of trust.
FOLLOWERS = [
    r'"follower_count"\s*:\s*(\d+)',
    r'"page_followers"\s*:\s*\{\s*"count"\s*:\s*(\d+)',
    r'"subscribe_count"\s*:\s*(\d+)',
    r"follower_count\s*:\s*(\d+)",
    r'"follower_count_string"\s*:\s*"([\d.,]+)"',
]


def first_match(c, patterns: list[str]) -> Column:
    """Group 1 of the first pattern in the list that matches anywhere."""
    return F.coalesce(*[F.nullif(F.regexp_extract(col(c), p, 1), F.lit("")) for p in patterns])


def follower_count(c) -> Column:
    return F.regexp_replace(first_match(c, FOLLOWERS), "[.,]", "").try_cast("bigint")


def last_tail(text, pattern: str) -> Column:
    """What follows the last match of a pattern, to the end of its line, stripped; null without a match."""
    text = F.col(text) if isinstance(text, str) else text
    return F.when(text.rlike(pattern), stripped(F.regexp_extract(text, rf"(?s)^.*(?:{pattern})([^\n]*)", 1)))
