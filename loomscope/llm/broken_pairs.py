"""Prompt and response pairs with an empty, truncated, refusing, copying or wrong-language answer."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomscope.session import table, written

USERS, ASSISTANTS = ("user", "human"), ("assistant", "gpt")
#: Hashed character trigrams, whose counts make the language models; labelled texts of each language that are counted, and languages.
GRAMS, LABELLED, MOST_LANGUAGES = 1 << 16, 2000, 50
#: Weight of the common distribution in each language's model.
SMOOTHING = 2000.0
#: Log odds of the languages of message and answer, in all and for each trigram, from which they differ.
LANGUAGE_ODDS, LANGUAGE_MARGIN = 10.0, 0.4
#: Hashed words and word pairs, whose counts make the model of refusals, and its log odds from which an answer refuses.
REFUSAL_GRAMS, REFUSAL_ODDS = 1 << 19, 0.0
#: This share of the examples is taken to have the words of other answers besides; words seen less often than this say nothing.
PRIOR, SEEN = 0.35, 3
#: The words of an answer are counted by their place up to this one, those behind it alike.
PLACES = 5
#: An answer is complete if its last words end a text this often.
COMPLETE = 0.5
#: Occurrences that the estimate of the next shorter n-gram counts for; n-grams up to this one weigh ends and insides alike.
BACK_OFF, BALANCED = 4, 1
#: A copy has at least this share of its words from the message and holds this share of the message's words.
COPY_SHARE, COPY_COVER, COPY_WORDS = 0.7, 0.4, 4
#: Pairs that are judged at once.
ROWS = 2000

WORD = re.compile(r"[^\W_]+")
IMAGE = re.compile(r"(?is)picture \d+:\s*(?=<img>)|<img>.*?</img>|<image>")
TAG = re.compile(r"</?\w+[^<>]*>")
QUOTED = re.compile(r"[\"“„«][^\"”“»]*[\"”“»]")
POINT = re.compile(r"\d+(?:\.\d+)?\s*,\s*\d+(?:\.\d+)?")
ENDED = re.compile(r"[.!?…。！？](?:[\"'”’»)\]]|</\w+>)*\s*$")
LIST_MARK = re.compile(r"(?:^|\n)\s*\d+[.)]\s*$")
NUMBER = re.compile(r"\d+")
OPEN_TAG = re.compile(r"<(box|point|ref|img|quad|p)>", re.I)

# Names by which a language is asked for.
LANGUAGE_NAMES: dict[str, tuple[str, ...]] = {
    "en": ("english", "englisch", "englischer", "englische", "anglais", "anglaise", "inglés", "inglesa"),
    "de": ("german", "deutsch", "deutsche", "deutscher", "allemand", "allemande", "alemán", "alemana"),
    "fr": ("french", "französisch", "französische", "französischer", "français", "française", "francés", "francesa"),
    "es": ("spanish", "spanisch", "spanische", "spanischer", "espagnol", "espagnole", "español", "española"),
    "ru": ("russian", "russisch", "russische", "russe", "ruso", "rusa", "ukrainian", "bulgarian"),
    "zh": ("chinese", "mandarin", "chinesisch", "chinesische", "chinois", "chinoise", "chino", "china"),
    "ar": ("arabic", "arabisch", "arabe", "árabe"),
    "ja": ("japanese", "japanisch", "japonais", "japonés"),
    "ko": ("korean", "koreanisch", "coréen", "coreano"),
    "el": ("greek", "griechisch", "grec", "griego"),
    "it": ("italian", "italienisch", "italien", "italiano"),
}

# First letters of scripts; a text in one that no labelled language is written in has its script as language.
SCRIPTS: tuple[tuple[str, int, int], ...] = (
    ("el", 0x370, 0x3FF), ("ru", 0x400, 0x52F), ("he", 0x590, 0x5FF), ("ar", 0x600, 0x77F), ("hi", 0x900, 0x97F), ("th", 0xE00, 0xE7F),
    ("ko", 0x1100, 0x11FF), ("ja", 0x3040, 0x30FF), ("zh", 0x3400, 0x9FFF), ("ko", 0xAC00, 0xD7AF),
)

# Expressions of which an answer holds all if it is one of the examples from which refusals are learnt.
EXAMPLES: tuple[tuple[str, ...], ...] = (
    ("i cannot",), ("i can't",), ("i can not",), ("i'm sorry",), ("i am sorry",), ("i'm unable",), ("i am unable",), ("i'm not able",), ("i am not able",),
    ("i must decline",), ("i won't",), ("i will not",), ("my apologies",), ("i apologi",), ("i would rather not",), ("i prefer not",), ("not allowed to",), ("has been withheld",), ("against the terms of",),
    ("i will pass",), ("i'll pass",), ("i stop here",), ("outside my",), ("beyond my",), ("my role ends",), ("useful i could",), ("not going to do that",), ("not something for me",), ("i may not",), ("i am only able",),
    ("kann ich", "nicht"), ("ich kann", "nicht"), ("tut mir leid",), ("ich darf", "nicht"), ("darf ich", "nicht"), ("darf ich", "kein"), ("mir nicht erlaubt",), ("mir nicht gestattet",), ("il m'est impossible",), ("je dois refuser",), ("il ne m'est pas",), ("je ne peux",), ("je ne suis pas",), ("désolé",), ("je regrette",), ("je préfère ne pas",), ("lo siento",), ("no puedo",),
    ("no me es posible",), ("no estoy autorizad",), ("no me está permitido",), ("debo rechazar",), ("no tengo acceso",), ("prefiero no",), ("извините",), ("抱歉",), ("对不起",),
)
EXAMPLE = re.compile("|".join(re.escape(xs[0]) for xs in EXAMPLES))


def plain(text: str | None) -> str:
    """``text`` without image markers and tags."""
    return TAG.sub(" ", IMAGE.sub(" ", text)) if text and "<" in text else text or ""


def unquoted(text: str) -> str:
    """``text`` without quotes, which may be in any language, unless they are most of it."""
    if not any(c in text for c in '"“„«'):
        return text
    rest = QUOTED.sub(" ", text)
    return rest if 2 * len(rest.replace(" ", "")) > len(text.replace(" ", "")) else text


def refusal_example(text: str) -> bool:
    return bool(EXAMPLE.search(text)) and any(all(x in text for x in xs) for xs in EXAMPLES)


def _hash(*parts: np.ndarray) -> np.ndarray:
    z = np.full(len(parts[0]), len(parts), np.uint64)
    with np.errstate(over="ignore"):
        for x in parts:
            z = (z * np.uint64(0x9E3779B97F4A7C15)) ^ x.astype(np.uint64)
            z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            z ^= z >> np.uint64(32)
    return z.view(np.int64)


class Words:
    """The words of some texts one after the other: ``text`` of each, its ``place``, and ``code`` in ``known``."""

    def __init__(self, texts: list[str]) -> None:
        found = [WORD.findall(t) for t in texts]
        self.n = np.array([len(w) for w in found], np.int64)
        self.text = np.repeat(np.arange(len(texts)), self.n)
        self.place = np.arange(len(self.text)) - np.repeat(np.cumsum(self.n) - self.n, self.n)
        flat = list(chain.from_iterable(found))
        self.code, self.known = pd.factorize(np.array(flat, object)) if flat else (np.empty(0, np.int64), np.empty(0, object))
        self.hashes = pd.util.hash_array(self.known) if len(flat) else np.empty(0, np.uint64)


def word_trigrams(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed character trigrams of all words, a blank around each, one after the other, and the word of each."""
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(f" {w} " for w in words).encode("utf-32-le"), np.uint32).astype(np.uint64)
    of = np.repeat(np.arange(len(words)), sizes + 2)
    inside = np.flatnonzero((of[2:] == of[:-2])) if len(of) > 2 else np.empty(0, np.int64)
    return _hash(codes[inside], codes[inside + 1], codes[inside + 2]) & (GRAMS - 1), of[inside]


def word_scripts(words: np.ndarray) -> np.ndarray:
    """The number of the script of each word in ``SCRIPTS``, -1 for none of them."""
    first = np.array([ord(w[0]) for w in words], np.int64)
    out = np.full(len(words), -1)
    for i, (_, low, high) in enumerate(SCRIPTS):
        out[(first >= low) & (first <= high)] = i
    return out


def language_model(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages, and log probabilities of hashed trigrams in each: a multinomial naive Bayes, mixed with the common distribution.

    labelled: ``text, lang``. Of each language about ``LABELLED`` texts are counted, chosen by the hash of the text. Scripts in
    which no labelled language is written are languages without trigrams.
    """
    named = labelled.select("text", F.lower(F.trim("lang")).alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL AND lang NOT IN ('', 'und')")
    sizes = named.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()
    names = sorted(r["lang"] for r in sizes)
    spark = labelled.sparkSession
    parts = spark.createDataFrame([(r["lang"], names.index(r["lang"]), LABELLED / r["n"]) for r in sizes], "lang STRING, k INT, part DOUBLE")
    chosen = named.join(F.broadcast(parts), "lang").where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < F.col("part") * (1 << 30))  # a row a language

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((len(names), GRAMS), np.int64)
        for batch in batches:
            words = Words([unquoted(plain(t)).lower() for t in batch["text"]])
            if len(words.code):
                grams, of = word_trigrams(words.known)
                k = batch["k"].to_numpy()[words.text]
                for i in np.unique(k):
                    counts[i] += np.bincount(grams, np.bincount(words.code[k == i], minlength=len(words.known))[of], GRAMS).astype(np.int64)
        k, at = np.nonzero(counts)
        yield pd.DataFrame({"k": k.astype(np.int32), "at": at, "n": counts[k, at]})

    found = chosen.select("k", "text").mapInPandas(run, "k INT, at BIGINT, n BIGINT").groupBy("k", "at").agg(F.sum("n").alias("n")).toPandas()  # a row a language and trigram
    counts = np.zeros((len(names), GRAMS))
    counts[found["k"], found["at"]] = found["n"]
    common = (counts.sum(0) + 0.5) / (counts.sum() + 0.5 * GRAMS)
    return names, np.log((counts + SMOOTHING * common) / (counts.sum(1, keepdims=True) + SMOOTHING)).astype(np.float32)


def language_scores(words: Words, texts: int, names: list[str], model: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log likelihood of each text in each language of ``names`` and then in each script, and its number of trigrams."""
    scripts = [k for k, _, _ in SCRIPTS]
    out, n = np.zeros((texts, len(names) + len(scripts))), np.zeros(texts)
    if not len(words.code):
        return out, n
    digits = np.array([any(c.isdigit() for c in w) for w in words.known])
    grams, of = word_trigrams(words.known)
    size = np.bincount(of, minlength=len(words.known)) * ~digits
    script = word_scripts(words.known)
    lost = float(model.min()) if model.size else -12.0
    word = words.code
    n = np.bincount(words.text, size[word], texts)
    for k in range(out.shape[1]):
        if k < len(names):
            score = np.bincount(of, model[k, grams], len(words.known)) * ~digits
        elif scripts[k - len(names)] in names:
            score = 2 * lost * size
        else:
            score = np.where(script == k - len(names), -1.0, lost) * size
        out[:, k] = np.bincount(words.text, score[word], texts)
    return out, n


def refusal_grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words and pairs of words of all texts, each once a text, and the text of each."""
    said = np.array([not w.isdigit() for w in words.known], bool)[words.code] if len(words.code) else np.empty(0, bool)
    h, text = words.hashes[words.code][said], words.text[said]
    pair = np.flatnonzero(text[1:] == text[:-1])
    grams = np.concatenate([_hash(h), _hash(h[pair], h[pair + 1])]) & (REFUSAL_GRAMS - 1)
    both = np.unique(np.concatenate([text, text[pair]]) * REFUSAL_GRAMS + grams)
    return both % REFUSAL_GRAMS, both // REFUSAL_GRAMS


def word_ends(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Whether each word is the last one of its text, and the hashes of the n-grams that it ends: the word before it with any
    word, the word, and two and three words or, from ``PLACES`` on, the word before that one with any two, and 0. They hold the word's place up to there."""
    h = words.hashes[words.code]
    place = np.minimum(words.place, PLACES)
    before, second = (np.where(words.place >= k, np.roll(h, k), np.uint64(0)) for k in (1, 2))
    grams = np.column_stack([_hash(place * 4 + n, *x) for n, x in enumerate(((before,), (h,), (before, h), (second, before, h)))])
    far = place == PLACES
    grams[far, 2], grams[far, 3] = _hash(place * 4 + 3, second)[far], 0
    return words.place == words.n[words.text] - 1, grams


def unfinished(text: str) -> bool | None:
    """Whether an answer stops within brackets, quotes, markup, a list item or before a mark; None if its last words decide."""
    text = text.strip()
    if any(text.count(a) > text.count(b) for a, b in ("()", "[]", "{}", "<>")) or text.count('"') % 2 or LIST_MARK.search(text):
        return True
    if "<" in text and any(f"</{tag}" not in text for tag in OPEN_TAG.findall(text)):
        return True
    if ENDED.search(text):
        return False
    if text[-1] in ",;:-–—/，；：、":
        return True
    if text[-1] in ")]}>":
        return False
    return None


def _endings(raw: pd.Series) -> tuple[list[str], Words, np.ndarray]:
    """Answers without markup, their words, numbers alike, and 1 for unfinished, 0 for finished, -1 where the last words decide."""
    texts = [plain(t).lower() for t in raw]
    words = Words([NUMBER.sub("0", t) for t in texts])
    only_numbers = np.bincount(words.text, np.array([w != "0" for w in words.known], float)[words.code] if len(words.code) else None, len(texts)) == 0
    state = [None if not t or not t.strip() else unfinished(t) for t in raw]
    return texts, words, np.array([-1 if s is None and not x else int(bool(s)) for s, x in zip(state, only_numbers)])


def train(pairs: DataFrame) -> tuple[np.ndarray, DataFrame, float]:
    """What answers look like that refuse and that end, counted over all ``pairs`` (``prompt, response``).

    Log odds of hashed words and word pairs in answers that hold an example of a refusal against the others, a naive Bayes of
    at most ``2 * REFUSAL_GRAMS`` counts; for each n-gram of :func:`word_ends` that ends an answer without a final mark how often it stands inside one and how
    often it ends one (``at, n, ended``), which stays distributed; and words inside answers by words that end them.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refusing = np.zeros((2, REFUSAL_GRAMS + 1), np.int64)
        for whole in batches:
            for start in range(0, len(whole), ROWS):
                batch = whole.iloc[start : start + ROWS]
                texts, words, state = _endings(batch["response"])
                seed = np.array([refusal_example(QUOTED.sub(" ", t)) for t in texts], int)
                grams, of = refusal_grams(Words([unquoted(t) for t in texts]))
                for k in (0, 1):
                    refusing[k, :-1] += np.bincount(grams[seed[of] == k], minlength=REFUSAL_GRAMS)
                    refusing[k, -1] += (seed == k).sum()
                last, found = word_ends(words)
                ended = last & (state != 1)[words.text]
                kept = ended | ~last
                at, row = np.unique(found[kept], return_inverse=True)
                ends = np.bincount(row.ravel(), np.repeat(ended[kept] & (state == -1)[words.text][kept], found.shape[1]), len(at)).astype(np.int64)
                n = np.bincount(row.ravel(), minlength=len(at)) - ends
                yield pd.DataFrame({"kind": np.full(len(at), -1, np.int32), "at": at, "n": n, "ended": ends})
                yield pd.DataFrame({"kind": np.int32([-2]), "at": [0], "n": [(~last).sum()], "ended": [(ended & (state == -1)[words.text]).sum()]})
        k, at = np.nonzero(refusing)
        yield pd.DataFrame({"kind": k.astype(np.int32), "at": at, "n": refusing[k, at], "ended": 0})

    counts = pairs.select("response").where("response IS NOT NULL").mapInPandas(run, "kind INT, at BIGINT, n BIGINT, ended BIGINT")
    counts = counts.groupBy("kind", "at").agg(F.sum("n").alias("n"), F.sum("ended").alias("ended"))
    counts = written(counts, "counts")
    of = counts.where("kind >= 0").groupBy("at").agg(*(F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n{k}") for k in (0, 1)))
    of = of.where((F.col("n0") + F.col("n1") >= SEEN) | (F.col("at") == REFUSAL_GRAMS)).toPandas()
    grams = np.zeros((2, REFUSAL_GRAMS + 1))
    grams[:, of["at"]] = of[["n0", "n1"]].T
    n_other, n_refusing = grams[:, -1]
    usual = (grams[0, :-1] + 0.5) / (n_other + 1)
    prior = PRIOR * max(n_refusing, 1)
    odds = np.log((grams[1, :-1] + prior * usual) / (n_refusing + prior)) - np.log(usual)
    odds = np.append(np.where(grams[:, :-1].sum(0) >= SEEN, odds, 0.0), np.log(max(n_refusing, 0.01) / max(n_other, 1)))
    total = counts.where("kind = -2").first()
    weight = max(total.n, 1) / max(total.ended, 1) if total else 1.0
    return odds.astype(np.float32), counts.where("kind = -1").select("at", "n", "ended"), weight


def cut_ends(short: DataFrame, ends: DataFrame, weight: float) -> DataFrame:
    """The ``gram0`` to ``gram3`` of answers (of their last word) whose last words rarely end an answer.

    ends, weight: of :func:`train`. The share of ends of an n-gram is mixed with that of the next shorter one, which counts
    for ``BACK_OFF`` occurrences, and the answer's own end is left out. For single words ends are weighted so that over
    all words they are as many as insides, as texts have few ends; a word that was not seen decides nothing (one half).
    """
    keys = [f"gram{k}" for k in range(4)]
    grams = short.select(*keys).distinct()
    level = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"gram{k}").alias("at")) for k in range(4)))).alias("x")
    of = grams.select(*keys, level).select(*keys, "x.*").join(ends, "at", "left")
    count = lambda c, k: F.coalesce(F.max(F.when(F.col("k") == k, F.col(c))), F.lit(0)).alias(f"{c}{k}")
    of = of.groupBy(*keys).agg(*(count(c, k) for c in ("n", "ended") for k in range(4)))

    def mixed(k: int, share: Column) -> Column:
        end = F.greatest(F.col(f"ended{k}") - 1, F.lit(0)) * (weight if k <= BALANCED else 1.0)
        return (end + BACK_OFF * share) / (end + F.col(f"n{k}") + BACK_OFF)

    far = F.col("gram3") == 0
    share = F.when(far, mixed(2, F.lit(0.5))).otherwise(0.5)
    share = mixed(1, mixed(0, share))
    share = F.when(far, share).otherwise(mixed(3, mixed(2, share)))
    return of.where(share < COMPLETE).select(*keys)


def copied(prompts: Words, answers: Words, n: int) -> np.ndarray:
    """Whether each answer is nothing but its message or the main part of it, by the words they share."""
    both = pd.factorize(np.concatenate([prompts.known, answers.known]))[0] if len(prompts.known) + len(answers.known) else np.empty(0, np.int64)
    sides = []
    for words, codes in ((prompts, both[: len(prompts.known)]), (answers, both[len(prompts.known) :])):
        key, times = np.unique(words.text * np.int64(len(both) + 1) + codes[words.code], return_counts=True)
        sides.append((key, times))
    keys, a, b = np.intersect1d(sides[0][0], sides[1][0], assume_unique=True, return_indices=True)
    shared = np.bincount(keys // (len(both) + 1), np.minimum(sides[0][1][a], sides[1][1][b]), n)
    few = (answers.n > 0) & (shared == answers.n) & (answers.n == prompts.n)
    return np.where(answers.n < COPY_WORDS, few, (shared >= COPY_SHARE * answers.n) & (shared >= COPY_COVER * prompts.n))


def asks_for(prompt: str, language: str) -> bool:
    return any(w in LANGUAGE_NAMES.get(language, ()) for w in WORD.findall(prompt.lower()))


def broken_pairs(samples: DataFrame, labelled: DataFrame) -> DataFrame:
    """Each user message with a bad answer: ``sample_id BIGINT, msg_index INT, defect STRING``.

    samples: ``sample_id BIGINT, conversations ARRAY<STRUCT<sender, content>>``; a sample that comes again counts
    once. labelled: ``text, lang``, any texts with their languages. The answer of a message of user or human is the next message, if assistant or gpt sent it.
    ``defect`` is the first of: ``empty`` (no answer, null, or no letter or digit), ``copy``, ``refusal`` (its words are likelier in
    answers that decline), ``language`` (the posteriors of message and answer under the naive Bayes models of their
    trigrams disagree, and the message doesn't name the answer's language), ``truncated`` (open brackets, quotes or markup, or an end that rarely ends an answer).

    Languages are learnt from labelled texts and told apart by script beyond those, refusals from examples among the answers,
    ends from all answers. A null message has no language and nothing to copy. Null conversations, null
    messages in them and null ids give no rows; texts of any length are read whole. Other columns are ignored.
    """
    messages = samples.where("sample_id IS NOT NULL AND conversations IS NOT NULL").select("sample_id", "conversations").dropDuplicates(["sample_id"])
    sender = lambda m: F.lower(F.trim(m["sender"]))
    item = F.struct(
        F.col("pos").alias("msg_index"),
        F.col("m.content").alias("prompt"),
        F.try_element_at("conversations", F.col("pos") + 2).alias("next"),
    )
    pairs = messages.select("sample_id", "conversations", F.posexplode("conversations").alias("pos", "m")).where(sender(F.col("m")).isin(*USERS))
    pairs = pairs.select("sample_id", item.alias("x")).select("sample_id", "x.msg_index", "x.prompt", "x.next")
    answered = F.coalesce(sender(F.col("next")).isin(*ASSISTANTS), F.lit(False))
    pairs = pairs.select("sample_id", "msg_index", "prompt", F.when(answered, F.col("next.content")).alias("response"))
    pairs = written(pairs, "pairs")
    names, model = language_model(labelled)
    refusal, ends, weight = train(pairs)
    sent = samples.sparkSession.sparkContext.broadcast((names, model, refusal))
    classes = [*names, *(k for k, _, _ in SCRIPTS)]

    def judged(batch: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        names, model, refusal = sent.value
        n = len(batch)
        prompts = [plain(t).lower() for t in batch["prompt"]]
        answers, words, state = _endings(batch["response"])
        said_in, asked_in = (Words([unquoted(t) for t in x]) for x in (answers, prompts))
        a, size_a = language_scores(said_in, n, names, model)
        p, size_p = language_scores(asked_in, n, names, model)
        said, asked, row = a.argmax(1), p.argmax(1), np.arange(n)
        of_answer, of_prompt = a[row, said] - a[row, asked], p[row, asked] - p[row, said]
        other = (said != asked) & (of_answer > LANGUAGE_ODDS * np.where(state == 1, 3, 1)) & (of_prompt > LANGUAGE_ODDS)  # a rest of markup says little
        other &= (of_answer > LANGUAGE_MARGIN * size_a) & (of_prompt > LANGUAGE_MARGIN * size_p)
        copy = copied(Words(prompts), Words(answers), n)
        grams, of = refusal_grams(said_in)
        declines = np.bincount(of, refusal[grams], n) + refusal[-1] > REFUSAL_ODDS
        defects: list[str | None] = []
        for i, raw in enumerate(batch["response"]):
            if not words.n[i] and not WORD.search(raw or ""):
                defects.append("empty")
            elif copy[i] and len(POINT.findall(answers[i])) <= len(POINT.findall(prompts[i])):  # more points: the message, then an answer
                defects.append("copy")
            elif declines[i]:
                defects.append("refusal")
            elif other[i] and not asks_for(prompts[i], classes[said[i]]):
                defects.append("language")
            else:
                defects.append("truncated" if state[i] == 1 else None)
        out = batch[["sample_id", "msg_index"]].assign(defect=defects)
        open_end = np.array([d is None for d in defects]) & (state == -1) & (words.n > 0)
        last, found = word_ends(words)
        at = np.flatnonzero(last & open_end[words.text])
        return out[out["defect"].notna()], out[open_end].assign(**{f"gram{k}": found[at, k] for k in range(4)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), ROWS):
                bad, open_end = judged(batch.iloc[start : start + ROWS])
                yield bad.assign(**{f"gram{k}": None for k in range(4)})
                yield open_end

    grams = ", ".join(f"gram{k} BIGINT" for k in range(4))
    found = written(pairs.mapInPandas(run, f"sample_id BIGINT, msg_index INT, defect STRING, {grams}"), "judged")
    open_end = found.where("defect IS NULL")
    keys = [f"gram{k}" for k in range(4)]
    cut = open_end.join(cut_ends(open_end, ends, weight), keys, "left_semi").withColumn("defect", F.lit("truncated"))
    return found.where("defect IS NOT NULL").unionByName(cut.select(*found.columns)).select("sample_id", "msg_index", "defect")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All user messages of ``train_samples`` with a bad answer; languages are learnt from ``documents``."""
    labelled = table(spark, sf_dir, "documents").select("text", "lang")
    return broken_pairs(table(spark, sf_dir, "train_samples").select("sample_id", "conversations"), labelled)


def p2_by_defect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many answers have each defect."""
    return p2_found(spark, sf_dir).groupBy("defect").agg(F.count("*").alias("n"))
