"""Text signals: symbols named in texts, word counts, post and news roll-ups, numbers out of HTML."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values, in words.json: upper-case words that aren't symbols; words counted wherever they stand in a
#: text, also inside others (bull, bear); whole words of news, where one listed more than once counts as
#: often; words of posts, of which one of either sort counts once; words of the short news scorer.
_LISTS: dict[str, list[str]] = json.loads(Path(__file__).with_name("words.json").read_text(encoding="utf-8"))
NOT_SYMBOLS, BULL, BEAR, NEWS_UP, NEWS_DOWN, POST_UP, POST_DOWN, SHORT_UP, SHORT_DOWN = (_LISTS[k] for k in ("not_symbols", "bull", "bear", "news_up", "news_down", "post_up", "post_down", "short_up", "short_down"))

#: A character of a word, in any script.
_W = r"[\p{L}\p{N}_]"


def symbols(text: Column) -> Column:
    """Sorted distinct symbols named in a text, HTML tags aside: two to five capitals, or up to four with a
    class letter after a dot."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), "<[^\n]*?>", "")
    # a capital first: the look behind is only taken there
    words = F.regexp_extract_all(plain, F.lit(f"(?=[A-Z])(?<!{_W})([A-Z]{{2,5}})(?!{_W})"), 1)
    dotted = F.regexp_extract_all(plain, F.lit(f"(?=[A-Z])(?<!{_W})([A-Z]{{1,4}}\\.[A-Z])(?!{_W})"), 1)
    return F.array_sort(F.array_distinct(F.array_except(F.concat(words, dotted), F.array(*[F.lit(w) for w in NOT_SYMBOLS]))))


def occurrences(text: Column, words: Sequence[str]) -> Column:
    """How often the words stand in a text, also inside other words; each word is counted on its own."""
    low = F.lower(F.coalesce(text, F.lit("")))
    total = F.lit(0)
    for w in words:
        total = total + ((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("int")
    return total


def any_of(text: Column, words: Sequence[str]) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: low.contains(w))


def whole_words(text: Column, words: Sequence[str]) -> Column:
    """How many of the listed words a text holds as words; one listed more than once counts as often. The
    text is cut into words once, and met with all listed words of one weight together."""
    low = F.lower(F.coalesce(text, F.lit("")))
    held = F.split(low, f"[^\\p{{L}}\\p{{N}}_]+")
    weights, total = Counter(words), F.lit(0)
    for n in sorted(set(weights.values())):
        own = [w for w, k in weights.items() if k == n]
        if plain := [w for w in own if "-" not in w]:
            total = total + n * F.size(F.array_intersect(held, F.array(*[F.lit(w) for w in plain])))
        for w in own:
            if "-" in w:
                total = total + n * low.rlike(f"(?<!{_W}){w}(?!{_W})").cast("int")
    return total


def mood(text: Column) -> Column:
    """struct<bull, bear, neutral>: counts, or one neutral where there are none."""
    up, down = occurrences(text, BULL), occurrences(text, BEAR)
    return F.struct(up.alias("bull"), down.alias("bear"), F.when(up + down == 0, 1).otherwise(0).alias("neutral"))


def symbol_sentiment(posts: DataFrame) -> DataFrame:
    """Counts and a clamped score of each symbol named in posts (post_id, title), with its first three
    titles. Posts are reduced to counts before symbols are grouped."""
    rows = posts.select("post_id", "title", mood(F.col("title")).alias("m"), F.explode(symbols(F.col("title"))).alias("sym"))
    first = F.row_number().over(Window.partitionBy("sym").orderBy("post_id"))
    g = rows.groupBy("sym").agg(F.count(F.lit(1)).alias("mentions"), F.sum("m.bull").alias("bull"), F.sum("m.bear").alias("bear"), F.sum("m.neutral").alias("neutral"))
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.round((F.col("bull") - F.col("bear")) / F.col("mentions"), 3)))
    titles = rows.select("sym", "post_id", "title", first.alias("k")).filter("k <= 3").groupBy("sym").agg(F.transform(F.array_sort(F.collect_list(F.struct("post_id", "title"))), lambda x: x["title"]).alias("titles"))
    return g.withColumn("score", score).withColumn("label", label(F.col("score"))).join(titles, "sym")


def label(score: Column) -> Column:
    return F.when(score > 0.3, "bullish").when(score < -0.3, "bearish").otherwise("neutral")


def to_unit(score: Column) -> Column:
    """-1..1 to 0..1."""
    return (score + 1) / 2


def from_unit(score: Column) -> Column:
    return score * 2 - 1


def requested(sentiment: DataFrame, wanted: DataFrame) -> DataFrame:
    """Sentiment of the wanted symbols on 0..1, neutral where nothing is known."""
    j = wanted.select("sym").distinct().join(sentiment, "sym", "left")
    return j.select("sym", F.coalesce(to_unit(F.col("score")), F.lit(0.5)).alias("score"), F.coalesce("label", F.lit("neutral")).alias("label"), F.coalesce("mentions", F.lit(0).cast("long")).alias("mentions"))


def news_sentiment(articles: DataFrame, up: Sequence[str] = NEWS_UP, down: Sequence[str] = NEWS_DOWN) -> DataFrame:
    """Of each symbol's articles (sym, title, summary), those with more good than bad words less the
    others, over all; all symbols are returned."""
    text = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")))
    sign = F.signum((whole_words(text, up) - whole_words(text, down)).cast("double"))
    g = articles.select(F.coalesce("sym", F.lit("unknown")).alias("sym"), sign.alias("s")).groupBy("sym").agg(F.count_if(F.col("s") > 0).alias("positive"), F.count_if(F.col("s") < 0).alias("negative"), F.count_if(F.col("s") == 0).alias("neutral"), F.count(F.lit(1)).alias("articles"))
    return g.withColumn("score", F.round((F.col("positive") - F.col("negative")) / F.col("articles"), 4))


def short_news(articles: DataFrame) -> DataFrame:
    """The shorter scorer: of each list, how many entries stand anywhere in the text."""
    low = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit(""))))
    count = {k: sum((low.contains(w).cast("int") for w in words), F.lit(0)) for k, words in (("up", SHORT_UP), ("down", SHORT_DOWN))}
    s = F.signum((count["up"] - count["down"]).cast("double"))
    g = articles.select("sym", s.alias("s")).groupBy("sym").agg(F.count_if(F.col("s") > 0).alias("positive"), F.count_if(F.col("s") < 0).alias("negative"), F.count_if(F.col("s") == 0).alias("neutral"))
    return g.withColumn("score", (F.col("positive") - F.col("negative")) / (F.col("positive") + F.col("negative") + F.col("neutral")))


def post_sentiment(posts: DataFrame) -> DataFrame:
    """Score of each symbol's posts (sym, post): those with a good word less those with a bad one."""
    g = posts.groupBy("sym").agg(F.count(F.lit(1)).alias("posts"), F.count_if(any_of(F.col("post"), POST_UP)).alias("positive"), F.count_if(any_of(F.col("post"), POST_DOWN)).alias("negative"))
    both = F.col("positive") + F.col("negative")
    return g.withColumn("score", F.when(both > 0, F.round((F.col("positive") - F.col("negative")) / F.when(both > 0, both), 4)).otherwise(0.0))


def mentions(posts: DataFrame, most: int = 10) -> DataFrame:
    """The symbols (one to five capitals) named most often in each group's posts: (grp, title)."""
    words = F.filter(F.split(F.coalesce("title", F.lit("")), "[^\\p{L}\\p{N}_]+"), lambda w: w.rlike("^[A-Z]{1,5}$"))
    g = posts.select("grp", F.explode(words).alias("sym")).groupBy("grp", "sym").agg(F.count(F.lit(1)).alias("mentions"))
    rank = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("mentions"), "sym"))
    return g.withColumn("rank", rank).filter(F.col("rank") <= most)


def active_users(posts: DataFrame, most: int = 20) -> DataFrame:
    """Users by the sum of their posts' scores: (user, score)."""
    return posts.groupBy("user").agg(F.sum("score").alias("score"), F.count(F.lit(1)).alias("posts")).orderBy(F.desc("score"), "user").limit(most)


def correlation(pairs: DataFrame, least: int = 3) -> DataFrame:
    """Correlation of (sym, sentiment, ret) with words for its size; 0 where one side never moves."""
    g = pairs.groupBy("sym").agg(F.count(F.lit(1)).alias("points"), F.stddev_pop("sentiment").alias("a"), F.stddev_pop("ret").alias("b"), F.corr("sentiment", "ret").alias("r"))
    r = F.when((F.col("points") >= least) & (F.col("a") > 0) & (F.col("b") > 0), F.round(F.nanvl("r", F.lit(0.0)), 4)).otherwise(0.0)
    g = g.select("sym", "points", F.coalesce(r, F.lit(0.0)).alias("r"))
    size = F.when(F.abs("r") >= 0.7, "strong").when(F.abs("r") >= 0.4, "moderate").when(F.abs("r") >= 0.2, "weak").otherwise("negligible")
    way = F.when(F.col("r") > 0, "positive").when(F.col("r") < 0, "negative").otherwise("no")
    return g.withColumn("reading", F.when(F.col("points") < least, "insufficient data").otherwise(F.concat_ws(" ", size, way, F.lit("correlation"))))


def table_rows(html: Column) -> Column:
    """Rows of an HTML table as arrays of cell texts, tags aside."""
    rows = F.regexp_extract_all(html, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<td[^>]*>(.*?)</td>"), 1), lambda c: F.trim(F.regexp_replace(c, "<[^>]*>", ""))))


def short_interest(pages: DataFrame) -> DataFrame:
    """(sym, short_pct, short_ratio) of the table rows of pages (html): symbol, share of the float, ratio."""
    rows = pages.select(F.explode(table_rows(F.col("html"))).alias("c")).filter(F.size("c") >= 3)
    num = [F.expr(f"try_cast(trim(replace(c[{i}], '%', '')) as double)") for i in (1, 2)]
    out = rows.select(F.upper(F.col("c")[0]).alias("sym"), num[0].alias("a"), num[1].alias("b")).filter((F.length("sym") >= 2) & (F.col("a").isNotNull() | F.col("b").isNotNull()))
    return out.groupBy("sym").agg(F.coalesce(F.max("a"), F.lit(0.0)).alias("short_pct"), F.coalesce(F.max("b"), F.lit(0.0)).alias("short_ratio"))


def wanted_short_interest(known: DataFrame, wanted: DataFrame) -> DataFrame:
    j = wanted.select(F.upper("sym").alias("sym")).distinct().join(known, "sym", "left")
    return j.select("sym", F.coalesce("short_pct", F.lit(0.0)).alias("short_pct"), F.coalesce("short_ratio", F.lit(0.0)).alias("short_ratio"))


def trending_rows(markdown: Column) -> Column:
    """(company, symbol) of a trending table written in Markdown."""
    hit = r"\[######\s*(.*?)<br><br>(\w+)\]\("
    return F.arrays_zip(F.regexp_extract_all(markdown, F.lit(hit), 1).alias("company"), F.transform(F.regexp_extract_all(markdown, F.lit(hit), 2), lambda s: F.upper(s)).alias("sym"))


def links(html: Column) -> Column:
    """(href, text) of the anchors of a page."""
    hit = r'<a href="([^"]*)">([^<]*)</a>'
    return F.arrays_zip(F.regexp_extract_all(html, F.lit(hit), 1).alias("href"), F.regexp_extract_all(html, F.lit(hit), 2).alias("text"))


def panel_scores(pages: DataFrame, number: str = r"-?[0-9]+\.[0-9]") -> DataFrame:
    """Scores shown on a page: its panels are split, their rows matched, and a score must read NN.N,
    after a minus or not, or as `number` says.
    pages: (page_id, html) with <section id="panel-REGION"> and <tr data-sym="S"><td class="score">."""
    panels = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit(r'(?s)(<section id="panel-[a-z_]+">.*?</section>)'), 1)).alias("panel"))
    hit = F.lit(rf'<tr data-sym="([^"]+)"><td class="score">({number})</td>')
    rows = panels.select("page_id", F.regexp_extract("panel", r'id="panel-([a-z_]+)"', 1).alias("region"), F.explode(F.arrays_zip(
        F.regexp_extract_all("panel", hit, 1).alias("sym"), F.regexp_extract_all("panel", hit, 2).alias("score"))).alias("r"))
    return rows.select("page_id", "region", F.col("r.sym").alias("sym"), F.col("r.score").alias("score"))


def shown(rows: DataFrame, scores: DataFrame) -> DataFrame:
    """Rows (sym) with their score as the page wrote it, a dash where there is none."""
    return rows.join(scores.select("sym", F.col("score").alias("shown")), "sym", "left").withColumn("shown", F.coalesce("shown", F.lit("–")))


def stream_message(json: Column) -> Column:
    """A message service's answer: symbol in upper case, shares of bulls and bears, and the total; a
    missing answer is neutral."""
    m = F.from_json(json, "symbol string, bull double, bear double, neutral double, total long, timeframe string")
    return F.struct(F.upper(m["symbol"]).alias("sym"), F.coalesce(m["bull"], F.lit(0.0)).alias("bull"), F.coalesce(m["bear"], F.lit(0.0)).alias("bear"), F.coalesce(m["neutral"], F.when(m["bull"].isNull() & m["bear"].isNull(), 100.0).otherwise(0.0)).alias("neutral"),
                    F.coalesce(m["total"], F.lit(0).cast("long")).alias("total"), F.coalesce(m["timeframe"], F.lit("1D")).alias("timeframe"))
