"""Articles that a stream brings more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_KEY = "_article_key"


def distinct_articles(articles: DataFrame, span: str, text: str = "text", time: str = "created_at") -> DataFrame:
    """Of articles with equal texts the first to arrive, as long as they come within ``span`` of it.

    The state keeps a 256-bit hash for each text, no text, until the newest time seen is ``span``
    past the article's own; so it holds as many keys as there are articles in that span. Keys leave the
    state at the end of a micro-batch, so a text that comes back counts as new from the micro-batch
    after the one that was first read with the mark past it. Rows older than the newest time seen less ``span`` are left out,
    as under any watermark. All rows of a
    micro-batch travel to the task of their text, so a text that is most of a micro-batch makes one
    long task; that task reads its rows one by one and holds none of them.

    Cases: null texts are equal to one another and different from empty ones; rows without time
    take part and are kept in the state; other columns are those of the first row.
    """
    if _KEY in articles.columns:
        raise ValueError(f"{_KEY} is taken")
    keyed = articles.withColumn(_KEY, F.coalesce(F.sha2(F.col(text), 256), F.lit("")))
    return keyed.withWatermark(time, span).dropDuplicatesWithinWatermark([_KEY]).drop(_KEY)
