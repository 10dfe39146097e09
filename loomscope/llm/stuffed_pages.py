"""Keyword-stuffed pages, link lists and rows of tags, told from pages of sentences."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomscope.session import spread, table, written

WORD = re.compile(r"[^\W_]+")
#: A segment is a sentence or a line.
SEGMENT_END = re.compile(r"[.!?。！？\n](?:(?<=[.!?])[\"'”»)]*\s+|(?<=[。！？])|(?<=\n)\n*)")
LINK = re.compile(r"(?:https?://|www\.)[^\s)\">|]+")
TAG_OR_LINK = re.compile(r"<[^>]*>|(?:https?://|www\.)[^\s)\">|]+")
SEPARATOR = re.compile(r"[|,;/*»•·–]")
#: ASCII characters, those that stand in no word as blanks.
BLANKED = bytes(i if WORD.match(chr(i)) else 32 for i in range(128)).ljust(256)

#: A language has a profile if so many pages state it; a page's language is looked for among so many languages at most.
LEAST_PAGES, MOST_LANGUAGES = 30, 200
#: Function words are in this share of the pages of a language; its profile has the most frequent words besides.
FUNCTION_PAGES, PROFILE_WORDS, PROFILE_PAGES = 0.45, 2000, 0.005
#: A page without a stated language needs this share of its words in the profile of a language.
KNOWN_WORDS = 0.15
#: A segment says something if its share of function words is at least this part of the language's usual share.
FUNCTION_PART = 0.25
#: Least limits of a segment's separators a word and link characters a character, of a page's share of the top word and of key
#: phrases. A limit rises to CALIBRATED times the value that nine of ten segments (pages) of the language stay under.
SEPARATORS, LINKS, TOP_WORD, KEY_PHRASES, CALIBRATED = 0.5, 0.5, 0.2, 0.35, 2.0
#: A phrase of two words that are no function words counts for the key phrases of a page if it has this share of the page.
PHRASE_SHARE = 0.1
#: A word, phrase or line comes so often in a page before it counts as repeated.
REPEATED = 3
#: A page is stuffed if more than this share of its words stands in segments that say nothing.
STUFFED_SHARE = 0.5
#: Steps of the histograms that limits are read from.
STEPS = 100
#: Pages at a time.
BATCH = 1000

PAGE = (
    "doc_id BIGINT, lang STRING, profiled BOOLEAN, n_words INT, top_word_share DOUBLE, key_phrase_share DOUBLE, duplicate_line_share DOUBLE, link_text_ratio DOUBLE, "
    "separator_density DOUBLE, function_share DOUBLE, segments ARRAY<STRUCT<words: INT, function: INT, separators: DOUBLE, links: DOUBLE, repeats: BOOLEAN, phrase: BOOLEAN, top: BOOLEAN>>"
)


def _words(text: str) -> list[str]:
    """The words of a lower-case text."""
    return text.encode().translate(BLANKED).decode().split() if text.isascii() else WORD.findall(text)


def _separators(text: str) -> int:
    return len(text) - len(text.encode().translate(None, b"|,;/*")) if text.isascii() else len(SEPARATOR.findall(text))


def _segments(text: str) -> list[str]:
    """The sentences and lines of a text, without the blanks and quotes between them."""
    out, start = [], 0
    for m in SEGMENT_END.finditer(text):
        end = m.start() + (text[m.start()] != "\n")
        if end > start:
            out.append(text[start:end])
        start = m.end()
    if start < len(text):
        out.append(text[start:])
    return out


def language_profiles(docs: DataFrame) -> dict[str, dict[str, bool]]:
    """The most frequent words of each language, and whether each is a function word, counted over all pages that state it.

    docs: ``text, lang``. At most ``MOST_LANGUAGES * PROFILE_WORDS`` words reach the driver.
    """
    stated = docs.select(F.lower(F.trim("lang")).alias("lang"), "text").where("lang IS NOT NULL AND lang NOT IN ('und', '') AND text IS NOT NULL")
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    pages = stated.groupBy("lang").agg(F.count("*").alias("pages")).where(F.col("pages") >= LEAST_PAGES).orderBy(F.desc("pages"), "lang").limit(MOST_LANGUAGES)
    counts = stated.select("lang", F.explode(words).alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n"))
    top = counts.join(F.broadcast(pages), "lang").where(F.col("n") >= PROFILE_PAGES * F.col("pages"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))  # words that frequent are few
    out: dict[str, dict[str, bool]] = {}
    for r in top.withColumn("rank", rank).where(F.col("rank") <= PROFILE_WORDS).collect():
        out.setdefault(r["lang"], {})[r["word"]] = r["n"] >= FUNCTION_PAGES * r["pages"]
    return out


class Profiles:
    """The profiles of all languages by word: entries ``start[i]`` to ``start[i + 1]`` are the languages of word ``i``, and whether it is a function word there."""

    def __init__(self, profiles: dict[str, dict[str, bool]]) -> None:
        self.names = sorted(profiles)
        self.index: dict[str, int] = {}
        found = [(self.index.setdefault(w, len(self.index)), k, f) for k, g in enumerate(self.names) for w, f in profiles[g].items()]
        word, language, function = np.array(sorted(found), np.int64).reshape(-1, 3).T
        self.language, self.function = language, function.astype(bool)
        self.start = np.searchsorted(word, np.arange(len(self.index) + 1))

    def of(self, words: Iterable[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """For each language and each of ``n`` words whether its profile has the word, and as a function word."""
        at = np.fromiter((self.index.get(w, -1) for w in words), np.int64, n)
        hit = np.flatnonzero(at >= 0)
        first = self.start[at[hit]]
        times = self.start[at[hit] + 1] - first
        entry = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
        held, function = (np.zeros((len(self.names), n), bool) for _ in range(2))
        held[self.language[entry], np.repeat(hit, times)] = True
        function[self.language[entry], np.repeat(hit, times)] = self.function[entry]
        return held, function


def _times(group: np.ndarray, code: np.ndarray) -> np.ndarray:
    """For each item how often its code comes in its group."""
    if not len(code):
        return np.empty(0, np.int64)
    same = pd.factorize(group * (np.int64(code.max()) + 1) + code)[0]
    return np.bincount(same)[same]


def page_statistics(batch: pa.RecordBatch, profiles: Profiles) -> pa.RecordBatch:
    """The statistics (:data:`PAGE`) of the pages of a batch (``doc_id, text, lang``)."""
    ids, texts, stated = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
    n_pages = len(texts)
    cut = [_segments((t or "").lower()) for t in texts]
    n_cut = np.array([len(c) for c in cut], np.int64)
    page_of = np.repeat(np.arange(n_pages), n_cut)
    segments = list(chain.from_iterable(cut))
    n_segments = len(segments)
    own = [_words(s) for s in segments]
    size = np.array([len(w) for w in own], np.int64)
    chars = np.array([len(s) for s in segments], np.int64)
    link_chars = np.zeros(n_segments, np.int64)
    for i, s in enumerate(segments):
        if "<" in s or "://" in s or "www." in s:
            own[i] = _words(TAG_OR_LINK.sub(" ", s))
            link_chars[i] = sum(map(len, LINK.findall(s)))
    separators = np.array([_separators(s) for s in segments], np.int64)

    seg = np.repeat(np.arange(n_segments), [len(w) for w in own])
    code, known = pd.factorize(np.array(list(chain.from_iterable(own)), object)) if len(seg) else (np.empty(0, np.int64), [])
    page = page_of[seg]
    names = profiles.names
    in_profile, function = profiles.of(known, len(known))
    words = np.bincount(page_of, size, n_pages).astype(np.int64)

    lang = [g if g not in ("", "und") else None for g in ((g or "").strip().lower() for g in stated)]
    place = {g: k for k, g in enumerate(names)}
    own_place = np.array([-1 if g is None else place.get(g, -2) for g in lang], np.int64)
    at = np.full(n_pages, -1)
    if names:
        count = lambda of, chosen: np.array([np.bincount(page[chosen], x[code[chosen]], n_pages) for x in of])
        named, unnamed = np.flatnonzero(own_place >= 0), np.flatnonzero(own_place == -1)
        of_function = 2 * count(function, np.flatnonzero(function.any(0)[code]))  # the stated language wins a tie
        of_function[own_place[named], named] += 1
        at[named] = of_function.argmax(0)[named]
        of_profile = count(in_profile, np.flatnonzero((own_place == -1)[page]))
        best = of_profile.argmax(0)
        at[unnamed] = np.where(of_profile[best, np.arange(n_pages)] >= KNOWN_WORDS * np.maximum(words, 1), best, -1)[unnamed]
        lang = [names[k] if k >= 0 else g for k, g in zip(at, lang)]
    padded = np.vstack([function, np.zeros((1, len(known)), bool)])
    is_function = padded[at[page], code] if len(code) else np.empty(0, bool)

    times = _times(page, code)
    top_times = np.zeros(n_pages, np.int64)
    starts = np.flatnonzero(np.r_[True, page[1:] != page[:-1]]) if len(page) else np.empty(0, np.int64)
    if len(starts):
        top_times[page[starts]] = np.maximum.reduceat(np.where(is_function, 0, times), starts)
    is_top = ~is_function & (times == top_times[page]) & (times >= REPEATED)

    pair = np.flatnonzero((seg[1:] == seg[:-1]) & ~is_function[1:] & ~is_function[:-1])
    bigram = pd.factorize(code[pair] * np.int64(len(known) + 1) + code[pair + 1])[0]
    times = _times(page[pair], bigram)
    is_key = (times >= REPEATED) & (2 * times >= PHRASE_SHARE * words[page[pair]])
    in_key = np.zeros(len(code), bool)
    in_key[pair[is_key]] = in_key[pair[is_key] + 1] = True
    key_words = np.bincount(page, in_key, n_pages)
    again = np.flatnonzero(times > 1)  # nothing else comes twice in a segment
    within = again[_times(seg[pair[again]], bigram[again]) > 1]
    single = pd.factorize(np.array([s.strip() for s in segments], object))[0] if segments else np.empty(0, np.int64)
    copies = _times(page_of, single) >= REPEATED

    of_seg = lambda rows, flags=None: np.bincount(rows, flags, n_segments)
    of_segment = {
        "words": size.astype(np.int32), "function": of_seg(seg, is_function).astype(np.int32), "separators": separators / np.maximum(size, 1), "links": link_chars / np.maximum(chars, 1),
        "repeats": (of_seg(seg[pair[within]]) > 0) | copies, "phrase": of_seg(seg[pair[is_key]]) > 0, "top": of_seg(seg[is_top]) > 0,
    }
    structs = pa.StructArray.from_arrays([pa.array(x) for x in of_segment.values()], list(of_segment))
    least = np.maximum(words, 1)
    of_page = lambda x: np.bincount(page_of, x, n_pages)
    out = {
        "doc_id": ids, "lang": pa.array(lang, pa.string()), "profiled": at >= 0, "n_words": words.astype(np.int32), "top_word_share": top_times / least, "key_phrase_share": key_words / least,
        "duplicate_line_share": of_page(copies) / np.maximum(n_cut, 1), "link_text_ratio": of_page(link_chars) / np.maximum(of_page(chars), 1),
        "separator_density": of_page(separators) / least, "function_share": np.bincount(page, is_function, n_pages) / least,
        "segments": pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n_cut)], pa.int32()), structs),
    }
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], list(out))


def _limit(values: DataFrame, value: Column, least: float, name: str) -> DataFrame:
    """``lang`` and the limit of ``value`` in it: a multiple of what nine of ten rows stay under, but at least ``least`` and at most twice that."""
    counts = values.select("lang", F.least(F.ceil(value * STEPS), F.lit(2 * STEPS)).alias("step")).groupBy("lang", "step").agg(F.count("*").alias("n"))
    w = Window.partitionBy("lang")  # at most 2 * STEPS rows of a language
    below = counts.withColumn("below", F.sum("n").over(w.orderBy("step"))).withColumn("all", F.sum("n").over(w))
    tenth = below.groupBy("lang").agg(F.min(F.when(F.col("below") >= 0.9 * F.col("all"), F.col("step"))).alias("step"))
    return tenth.select("lang", F.least(F.lit(2 * least), F.greatest(F.lit(least), F.col("step") / STEPS * CALIBRATED)).alias(name))


def stuffed_pages(docs: DataFrame) -> DataFrame:
    """The statistics of every page of ``docs`` (``doc_id BIGINT, text STRING, lang STRING``) and whether it is stuffed.

    A page is cut into sentences and lines. A segment says nothing if

    * it has far fewer function words than segments of the language usually have,
    * it has too many separators, or too much of it is links,
    * it repeats a phrase within itself or is a line that comes again and again,
    * it holds a key phrase or the top word of a page in which these have too large a share.

    Limits are calibrated for each language over all pages, and function words are those that most pages of a language hold.
    ``stuffed`` if most words of the page stand in such segments. The shares in the result say why.

    A page that states a language without a profile (fewer than ``LEAST_PAGES`` pages) is not judged by function words, and all such pages have
    one row of limits; one that states none is judged by the language whose profile holds most of its words, if any does. Null, empty and wordless texts
    give ``stuffed`` false. Every row counts by itself: repeated rows, mirrored texts and ties change nothing. Other columns
    are ignored; an empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text", "lang")
    sent = docs.sparkSession.sparkContext.broadcast(Profiles(language_profiles(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, BATCH):
                yield page_statistics(batch.slice(start, BATCH), sent.value)

    pages = written(spread(docs).mapInArrow(run, PAGE), "pages")
    limits_of = F.when(F.col("profiled"), F.col("lang")).otherwise("")
    named = pages.withColumn("lang", limits_of)
    one = named.select("lang", "profiled", F.explode("segments").alias("s")).select("lang", "profiled", "s.*").where("words > 0")
    usual = one.where("profiled AND function > 0 AND NOT repeats").groupBy("lang").agg((F.sum("function") / F.sum("words")).alias("usual_share"))
    limits = [
        _limit(one, F.col("separators"), SEPARATORS, "most_separators"), _limit(one, F.col("links"), LINKS, "most_links"),
        _limit(named, F.col("top_word_share"), TOP_WORD, "most_top_word"), _limit(named, F.col("key_phrase_share"), KEY_PHRASES, "most_key_phrases"),
    ]
    of = usual
    for x in limits:
        of = of.join(x, "lang", "full")
    of = written(of.withColumnRenamed("lang", "of"), "limits")
    pages = pages.join(F.broadcast(of), limits_of == F.col("of"), "left").drop("of")  # a row a language with a profile, and one more
    limit = lambda name, least: F.coalesce(name, F.lit(least))

    def says_nothing(s: Column) -> Column:
        few = F.col("profiled") & (s["function"] < F.coalesce("usual_share", F.lit(0.0)) * FUNCTION_PART * s["words"])
        key = s["phrase"] & (F.col("key_phrase_share") > limit("most_key_phrases", KEY_PHRASES))
        top = s["top"] & (F.col("top_word_share") > limit("most_top_word", TOP_WORD))
        return few | (s["separators"] > limit("most_separators", SEPARATORS)) | (s["links"] > limit("most_links", LINKS)) | s["repeats"] | key | top

    empty = F.aggregate("segments", F.lit(0), lambda n, s: n + F.when(says_nothing(s), s["words"]).otherwise(0))
    pages = pages.withColumn("empty_share", empty / F.greatest("n_words", F.lit(1)))
    shares = [c.split(" ")[0] for c in PAGE.split(", ")[:10] if not c.startswith("profiled")]
    return pages.select(*shares, "empty_share", (F.col("empty_share") > STUFFED_SHARE).alias("stuffed"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyword-stuffed, link-list and tag pages of ``documents``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return stuffed_pages(docs).where("stuffed").select("doc_id")


def p7_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pages of each language are stuffed."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = stuffed_pages(docs)
    return found.groupBy("lang").agg(F.count("*").alias("n_pages"), F.count_if("stuffed").alias("n_stuffed"))
