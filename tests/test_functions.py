import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from reactrix.functions import dates, metrics, numbers, text
from reactrix.operators import crawl


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame(list(enumerate(values)), f"k bigint, x {kind}")
    return [r.y for r in df.select("k", expr.alias("y")).orderBy("k").collect()]


def test_counts_from_text(spark):
    assert column(spark, ["7", "1e3", "x", None, "", "2.9"], numbers.long_or_zero("x")) == [7, 1000, 0, 0, 0, 2]
    assert column(spark, ["1,2K", "3M", "1,234", "none", "", None, "1.2.3"], text.parsed_count("x")) == [1200, 3_000_000, 1, 0, 0, 0, None]


def test_match_key_removes_unicode_spaces(spark):
    assert column(spark, ["A b c　D\n", None, " "], text.match_key("x")) == ["abcd", "", ""]


def test_word_count_and_buckets(spark):
    values = ["", None, "  a  b ", "x " * 15, "x " * 16, "x " * 51, "a b"]
    words = column(spark, values, text.word_count("x"))
    assert words == [len((v or "").split()) for v in values]
    assert column(spark, values, text.length_bucket(text.word_count("x"))) == ["Very Short (≤5w)"] * 3 + ["Short (6-15w)", "Medium (16-50w)", "Long (>50w)", "Very Short (≤5w)"]
    assert column(spark, ["x " * 9, "x " * 10, "x " * 51], text.length_class(text.word_count("x"))) == ["short", "medium", "long"]


def test_keywords_with_capitals_never_match(spark):
    assert column(spark, ["UBND nói", "ubnd"], text.contains_any("x", ["UBND"])) == [False, False]
    assert column(spark, ["ubnd nói"], text.contains_any("x", ["ubnd"])) == [True]
    assert column(spark, ["a b c d"], text.matched_reason("x", list("dcba"))) == ["matched: d, c, b"]
    assert column(spark, ["zzz", None], text.matched_reason("x", ["a"])) == ["none", "none"]
    assert column(spark, ["DRAMA drama"], F.size(text.terms_in("x", ["Drama", "phốt"]))) == [1]


def test_tokens_and_normalisation(spark):
    assert column(spark, ["Đi ko?! b.ỏ", ""], text.tokens("x")) == [["Đi", "ko", "?!", "b", ".", "ỏ"], []]
    words = F.create_map(*[F.lit(x) for x in ("ko", "không", "dc", "được", "hn", "hà nội")])
    got = column(spark, ["Ko dc . HN hn Hn", None], text.normalised("x", words))
    assert (got[0].text, got[0]["count"], got[0].words) == ("không được. HN hà nội Hn", 3, ["Ko", "dc", "hn"])
    assert got[1].text == "" and got[1]["count"] == 0


def test_names(spark):
    assert column(spark, ["T02. ECONOMY_BUSINESS_AND_FINANCE", "SCIENCE_AND_TECHNOLOGY", None], text.topic_name("x")) == ["Economy, Business & Finance", "Science And Technology", "Other"]
    assert column(spark, ["T11. SPORT"], text.topic_name("x", True)) == ["T11. Sport"]
    assert column(spark, ["T11. SPORT", "SPORT"], text.topic_code("x")) == ["T11", "SPORT"]
    assert column(spark, ["Báo: Tuổi-Trẻ!"], text.slug("x")) == ["Báo__Tuổi_Trẻ"]
    assert column(spark, ["https://x.com/a/123?b=1"], text.url_id("x")) == ["123"]
    assert column(spark, ['"follower_count_string":"1.234,5"', 'z "subscribe_count": 7 "follower_count": 8', "none"], text.follower_count("x")) == [12345, 8, None]


def test_relative_times_keep_the_order_of_marks(spark):
    now = 1_700_000_000
    got = column(spark, ["5 năm", "2 months", "3 tháng", "hôm qua", "2 ngày", None, "", "1600000000", "just now"], dates.relative_time("x", F.lit(now).cast("bigint")))
    assert got == [now - 300, now - 120, now - 3 * 3600, now, now - 2 * 86400, now, now, 1_600_000_000, now]


def test_relative_times_by_a_plain_reader(spark):
    """Random texts of marks, numbers and words in both languages, against the rule written out."""
    rng = random.Random(7)
    now = 1_700_000_000
    words = ["phút", "min", "giờ", "hour", "ngày", "day", "hôm qua", "yesterday", "tháng", "month", "năm", "year", "vừa xong", "Just Now", "5", "12", "07", "tuần", "ago", "x", "  "]

    def plain(t):
        t = t.lower().strip()
        digits = "".join(c if c.isdigit() else " " for c in t).split()
        if not t or t.isdigit():
            return int(t) if t else now
        if "vừa xong" in t or "just now" in t:
            return now
        for marks, seconds in ((("phút", "m"), 60), (("giờ", "h"), 3600), (("ngày", "d"), 86400), (("hôm qua",), None), (("tháng",), 2592000), (("năm", "year"), 31536000)):
            if any(m in t for m in marks):
                return now - 86400 if seconds is None else now - int(digits[0]) * seconds if digits else now
        return now

    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 3))) for _ in range(500)]
    assert column(spark, texts, dates.relative_time("x", F.lit(now).cast("bigint"))) == [plain(t) for t in texts]


def test_labels_of_reactions(spark):
    rows = [
        (["Thích: 12 người", "3 people reacted with LOVE", "Yêu thích: 40 people", "haha 9", "people: wow"], "like=40 love=3", False),
        (["5 people: sad", "1,2K người: haha", "7 people: angry"], "sad=5", True),
        (["12 Buồn, 3 times"], "", True),
        (["1,234 PEOPLE: care", "0 people: care", ". people: care", "8 NGƯỜI: nothing known"], "care=1", False),
        ([None, "", "people"], "", False),
        ([], "", False),
        (None, "", False),
    ]
    df = spark.createDataFrame([(k, r[0]) for k, r in enumerate(rows)], "k int, x array<string>")
    got = [r.r for r in df.select("k", crawl.labelled_reactions(F.col("x")).alias("r")).orderBy("k").collect()]
    assert [(" ".join(f"{k}={g.counts[k]}" for k in metrics.REACTIONS if g.counts[k]), g.rounded) for g in got] == [r[1:] for r in rows]
    assert all(set(g.counts) == set(metrics.REACTIONS) for g in got)


def test_dates(spark):
    assert str(column(spark, [1767225600], dates.local_time("x"), "bigint")[0]) == "2026-01-01 07:00:00"
    assert [str(x) for x in column(spark, ["2024-02-03", "bad", None], dates.parsed_date("x"))] == ["2024-02-03", "None", "None"]


def test_half_even_is_numpys(spark):
    values = [0.125, 0.375, 2.5, -0.125, 1.0]
    assert column(spark, values, numbers.half_even("x", 2), "double") == pd.Series(values).round(2).tolist()


POST = ", ".join(f"{r}_count bigint" for r in metrics.REACTIONS) + ", total_reactions bigint, comment_count bigint, share_count bigint, page_followers bigint, has_page_followers int"


def test_metrics_of_odd_posts(spark):
    rows = [(0,) * 7 + (0, 0, 0, 0, 0), (10, 0, 0, 0, 0, 0, 0, 10, 1, 1, 100, 1), (1, 2, 3, 4, 5, 6, 7, 28, 5, 6, 0, 1), (1, 1, 0, 0, 0, 1, 0, 3, 0, 0, 50, 0)]
    got = metrics.enrich(spark.createDataFrame(rows, POST)).collect()
    assert got[0].intensity is None and got[0].valence is None and got[0].polarity_sign is None and got[0].polarity_laplace == 0.0 and got[0].controversy == 0.0
    assert got[1].intensity == 0.0 and got[1].valence is None and got[1].approval == 1.0 and got[1].reactions_per_follower == 0.1
    assert got[2].intensity == pytest.approx(27 / 28) and got[2].valence == -1.0 and got[2].reactions_per_follower == 0.0
    assert got[2].polarity_laplace == pytest.approx(27 / 28 * (9 - 11) / (20 + 5 + 1e-9))
    assert got[3].approval == 0.0 and got[3].rel_like == 0.0
    for r in got:
        assert all(0 <= r[c] <= 1 for c in r.asDict() if c.endswith("_ratio"))


def test_proper_tokens_are_those_of_python(spark):
    """Title and upper case as Python tells them, over random tokens with digits, accents and signs."""
    rng = random.Random(4)
    tokens = ["2day", "A1b", "A1B", "Ab", "aB", "ABC", "É", "éa", "Éa", "ǅ", "ǅa", "aǅ", "1", "!!", "ʰ", "ª", "Ab1Cd", "Ab1cd", "ĐC", "Đc", "ß"]
    tokens += ["".join(rng.choice("abAB12éÉđĐʰǅỹỸ") for _ in range(rng.randint(1, 6))) for _ in range(600)]
    got = spark.createDataFrame([(t,) for t in tokens], "t string").select("t", text.is_proper(F.col("t")).alias("p")).collect()
    assert [(r.t, r.p) for r in got] == [(t, t.istitle() or t.isupper()) for t in tokens]


def test_digit_led_words_are_normalised(spark):
    words = F.create_map(*[F.lit(x) for x in ("2day", "today", "a1b", "x", "ok", "okay", "đc", "được")])
    got = spark.createDataFrame([("2day A1b OK Ok ok Đc 2Day",)], "t string").select(text.normalised("t", words).alias("x")).first().x
    assert got.text == "today x OK Ok okay được 2Day" and got.words == ["2day", "A1b", "ok", "Đc"]
