"""The corpus report: how often tags occur, how long posts are, how scores are spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagloom.operators import stats
from tagloom.operators import summary as totals
from tagloom.operators.summary import summarize
from tagloom.operators.vocabulary import FIELDS, MAIN, popular
from tagloom.sources.staging import staged

# Ranges and bin numbers of the histograms.
COUNT_RANGE = {"general": (1, 1000, 100), "copyright": (1, 400, 100), "character": (1, 1000, 100)}
LENGTH_RANGE = (1, 150, 150)
SCORE_RANGE = (0, 1000, 100)
RATINGS = ("e", "q", "s", "g")


def corpus_report(
    posts: DataFrame | None = None, min_count: dict[str, int] | None = None, summary: DataFrame | None = None
) -> dict[str, DataFrame]:
    """All statistics by name, of posts, or of a summary that was kept.

    The posts are scanned once, whatever statistics are looked at: all read the summary, which is
    as large as there are distinct tags and scores.
    """
    if summary is None:
        summary = staged(summarize(posts), "summary")
    counts = totals.tag_counts(summary)
    scores = totals.score_counts(summary)
    lengths = totals.tags_per_post(summary)
    report = {
        "tag_counts": counts,
        "popular_tags": popular(counts, min_count or MAIN.min_count),
        "rating_counts": totals.rating_counts(summary),
        "tags_per_post": lengths,
        "length_histogram": stats.histogram(lengths, "n_tags", *LENGTH_RANGE, weight=F.col("n_posts")),
        "score_histogram": stats.histogram(
            scores, "score", *SCORE_RANGE, by="rating", groups=RATINGS, weight=F.col("n")
        ),
        "score_boxplot": stats.score_boxplot(scores),
        "boundary_scores": stats.boundary_scores(scores),
        "quality_bands": stats.quality_bands(scores),
    }
    for name in FIELDS:
        of_field = counts.where(F.col("field") == name)
        report[f"{name}_count_histogram"] = stats.histogram(of_field, "cnt", *COUNT_RANGE[name])
    return report
