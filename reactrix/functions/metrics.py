"""Engagement indices as column expressions over an enriched post's counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbers import half_even, ratio

REACTIONS = ["like", "love", "haha", "wow", "sad", "angry", "care"]


def n(name: str) -> Column:
    return F.col(f"{name}_count")


def groups() -> dict[str, Column]:
    return {"pos_react": n("love") + n("care"), "neg_react": n("angry") + n("sad") + n("haha") + n("wow")}


def intensity() -> Column:
    special = F.col("pos_react") + F.col("neg_react")
    return ratio(special, special + n("like"))


def valence() -> Column:
    return F.when(F.col("pos_react") + F.col("neg_react") > 0, F.signum((F.col("pos_react") - F.col("neg_react")).cast("double")))


def polarity_laplace(alpha: float = 5.0) -> Column:
    """Intensity times smoothed valence; amused and amazed reactions count for intensity only."""
    pos, neg, amb = n("love") + n("care"), n("angry") + n("sad"), n("haha") + n("wow")
    special = pos + neg + amb
    strength = F.coalesce(ratio(special, special + n("like")), F.lit(0.0))
    return strength * (pos - neg) / (pos + neg + alpha + 1e-9)


def per_total(x: Column) -> Column:
    return x / F.greatest(F.col("total_reactions"), F.lit(1))


def if_enough(x: Column, least: int = 10) -> Column:
    """x by total reactions; 0 for posts with few."""
    return F.when(F.col("total_reactions") >= least, x / F.nullif(F.col("total_reactions"), F.lit(0))).otherwise(0.0)


def per_follower(x: Column) -> Column:
    known = (F.col("has_page_followers") == 1) & (F.col("page_followers") > 0)
    return F.when(known, x / F.nullif(F.col("page_followers"), F.lit(0))).otherwise(0.0)


def controversy() -> Column:
    c, s, t = F.col("comment_count"), F.col("share_count"), F.col("total_reactions")
    pos, angry = n("love") + n("care"), n("angry")
    return F.least(pos, angry) / (F.greatest(pos, angry) + 1) * (c / (c + t + 1)) * F.log10((c + s + t + 1).cast("double"))


def sarcasm() -> Column:
    return (n("haha") + n("wow")) / (F.col("total_reactions") + 1)


def per_100k(x: Column) -> Column:
    return half_even(per_follower(x) * 100_000, 1)


def enrich(posts: DataFrame, alpha: float = 5.0) -> DataFrame:
    """All indices of a post. Existing controversy and sarcasm columns are kept."""
    t, c, s = F.col("total_reactions"), F.col("comment_count"), F.col("share_count")
    out = posts.withColumns(groups())
    out = out.withColumns({"intensity": intensity(), "valence": valence(), "polarity_laplace": polarity_laplace(alpha), "engagement_total": t + c + s})
    new = {"polarity_sign": F.col("intensity") * F.col("valence")}
    new |= {f"{x}_ratio": per_total(n(x)) for x in REACTIONS if x != "like"}
    new |= {"approval": if_enough(n("like") + n("love")), "outrage": if_enough(n("angry")), "amusement": if_enough(n("haha")), "empathy": if_enough(n("sad") + n("care"))}
    new |= {"reactions_per_follower": per_follower(t), "rel_spread": per_follower(s), "rel_discussion": per_follower(c), "rel_like": per_follower(n("like")), "engagement_per_follower": per_follower(F.col("engagement_total"))}
    new |= {k: f() for k, f in (("controversy", controversy), ("sarcasm", sarcasm)) if k not in posts.columns}
    return out.withColumns(new)
