"""Quality rules (operator 9): line-first cleaning.

Every line is held against rules of punctuation, navigation and boilerplate;
failing lines go, and a document that loses more than ``MAX_LOST`` percent of its word
characters, or keeps fewer than ``MIN_WORDS`` words, is rejected.  The base
measures of the whole text come with the verdict.

A line fails as
  * ``symbols``: over ``MAX_SYMBOLS`` percent as many symbols as word characters, or it has
    words but no letter or digit;
  * ``shouting``: at least three words, over half of which end with ``!``;
  * ``run-on``: at least ``MIN_RUN_ON`` words without a single sentence mark;
  * ``teaser``: at most ``MOST_IN_LINK`` words that trail off in an ellipsis;
  * ``navigation``: at least ``MIN_BARS`` words that are a lone separator, or at most ``MOST_IN_LINK``
    words without a closing mark, one of ``NAVIGATION`` at least, the others too or ``FILLERS``;
  * ``stutter``: at least ``WINDOW`` words, over ``MAX_STUTTER`` percent of which repeat the word before;
  * ``boilerplate``: it holds one of ``BOILERPLATE`` or a copyright mark with a year;
  * ``repeated``: it equals an earlier line.
Lines without a word are kept and weigh nothing.

Defined results: a null text has no words, fails the base rule and is not kept;
repeated rows are each judged; a null doc_id is carried through; an empty table
yields no rows.  A text is judged whole, whatever its length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, small_batches

WINDOW, MIN_WORDS, MAX_REPEATED = 8, 20, 30
#: Percentages, but for the count of bars.
MAX_SYMBOLS, MAX_STUTTER, MAX_LOST, MIN_BARS = 10, 30, 50, 3
#: Words of a line.
MIN_RUN_ON, MOST_IN_LINK = 60, 8
#: The words' separators, the symbols, the lone separators of menus, boilerplate phrases (lower case).
BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
BARS = ("|", "»", "›", "·", "•")
SENTENCE_MARKS, CLOSING_MARKS, ELLIPSES = ".,;:!?…。，；：！？、", ".!?:;。！？", ("...", "…")
#: Words of menus and links, words that may stand between them, and what may stand around either.
NAVIGATION = (
    "home", "about", "contact", "login", "logout", "register", "log", "sign", "signup", "menu", "search", "share", "tweet", "facebook", "twitter",
    "instagram", "linkedin", "pinterest", "youtube", "email", "print", "next", "previous", "prev", "back", "top", "sitemap", "faq", "help", "blog",
    "news", "archive", "archives", "categories", "tags", "comments", "reply", "subscribe", "newsletter", "rss", "account", "cart", "checkout",
    "wishlist", "shop", "download", "read", "skip", "navigation", "page", "pages", "privacy", "terms", "cookies",
)
FILLERS = ("", "on", "this", "us", "in", "to", "the", "our", "my", "more", "all", "and", "of", "up", "out", "a", "by", "via", "with", "content", "main")
AROUND = ".,:;!?»«›‹|•·/-()[]<>→←"
BOILERPLATE = (
    "all rights reserved", "cookie policy", "privacy policy", "terms of use", "terms of service", "accept cookies",
    "enable javascript", "subscribe to our newsletter", "sign up for our newsletter", "click here to", "lorem ipsum",
)
_WORDS = re.compile("[^ \\x09-\\x0d]+")
_SYMBOL = re.compile("[#*$%&|<>]")
COPYRIGHT = r"(©|\(c\)|copyright)[ \t]*(©|\(c\))?[ \t]*[12][0-9]{3}"
_COPYRIGHT = re.compile(COPYRIGHT)
_LINKS, _FILLERS = frozenset(NAVIGATION), frozenset(FILLERS)
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[str], window: int = WINDOW) -> int:
    """Words inside runs of ``window`` words that occur at least twice in the text."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    # a window's number: pairs, fours and eights of words get dense numbers in turn, so equal means equal
    span, code = 1, ids
    while span < window:
        step = min(span, window - span)
        left, right = code[: len(code) - step], code[step:]
        _, code = np.unique(left * (int(code.max()) + 1) + right, return_inverse=True)
        span += step
    counts = np.bincount(code)
    twice = counts[code] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += twice
    edges[window : window + n] -= twice
    return int((np.cumsum(edges)[:-1] > 0).sum())


def is_navigation(words: list[str]) -> bool:
    """Whether a short line consists of menu words."""
    if len(words) > MOST_IN_LINK or words[-1][-1] in CLOSING_MARKS:
        return False
    bare = {w.lower().strip(AROUND) for w in words}
    return not bare.isdisjoint(_LINKS) and bare <= _LINKS | _FILLERS


def failing(line: str, words: list[str]) -> str | None:
    """The rule that a line with ``words`` fails, if any; repeats are the text's to judge."""
    size = sum(map(len, words))
    if 100 * len(_SYMBOL.findall(line)) > MAX_SYMBOLS * size or not any(c.isalnum() for c in line):
        return "symbols" if sum(w in BARS for w in words) < MIN_BARS else "navigation"
    if sum(w in BARS for w in words) >= MIN_BARS or is_navigation(words):
        return "navigation"
    if len(words) >= MIN_RUN_ON and not any(c in line for c in SENTENCE_MARKS):
        return "run-on"
    if len(words) <= MOST_IN_LINK and words[-1].endswith(ELLIPSES):
        return "teaser"
    if len(words) >= 3 and 2 * sum(w[-1] == "!" for w in words) > len(words):
        return "shouting"
    if len(words) >= WINDOW and 100 * sum(a == b for a, b in zip(words, words[1:])) > MAX_STUTTER * len(words):
        return "stutter"
    low = line.lower()
    return "boilerplate" if any(p in low for p in BOILERPLATE) or _COPYRIGHT.search(low) else None


def judge(text: str | None) -> tuple[int, int, int, int, int, bool, bool, str]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and the text without failing lines."""
    text = text or ""
    words = _WORDS.findall(text)
    n, chars = len(words), sum(map(len, words))
    seen: set[str] = set()
    lines, doubles, lost, left = [], 0, 0, 0
    for line in text.split("\n"):
        own = _WORDS.findall(line)
        if own:
            size = sum(map(len, own))
            if line in seen:
                doubles += 1
                lost += size
                continue
            seen.add(line)
            if failing(line, own):
                lost += size
                continue
            left += len(own)
        lines.append(line)
    repeats = repeated_words(words)
    base_failed = n < MIN_WORDS or 100 * repeats > MAX_REPEATED * n
    kept = not base_failed and 100 * lost <= MAX_LOST * chars and left >= MIN_WORDS
    return n, chars, len(_SYMBOL.findall(text)), doubles, repeats, base_failed, kept, "\n".join(lines)


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, the base measures, base_failed and kept per document."""
    added = {**dict.fromkeys(BASE, "long"), "base_failed": "boolean", "kept": "boolean"}
    return map_texts(docs, ["doc_id"], lambda: lambda texts: list(zip(*[judge(t)[:7] for t in texts])) or [[]] * 7, added)


def clean(docs: DataFrame, text: str = "text", length: str = "n_chars") -> DataFrame:
    """The documents that pass, with all their columns, without their failing lines; ``length`` follows the text."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in small_batches(batches):
            found = [judge(t)[6:] for t in b.column(at).to_pylist()]
            b = b.filter(pa.array([k for k, _ in found], pa.bool_()))
            yield b.set_column(at, b.schema.field(at), pa.array([t for k, t in found if k], pa.string()))

    cleaned = docs.mapInArrow(run, docs.schema)
    if length in docs.columns:
        cleaned = cleaned.withColumn(length, F.char_length(text).cast(docs.schema[length].dataType))
    return cleaned.select(*docs.columns)


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), t AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d
), word AS (
  SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM t
), grams AS (
  SELECT rid, i, concat_ws(' ', w, {", ".join(f"lead(w, {k}) OVER p" for k in range(1, WINDOW))}) AS g, lead(w, {WINDOW - 1}) OVER p AS last
  FROM word WINDOW p AS (PARTITION BY rid ORDER BY i)
), twice AS (
  SELECT rid, i FROM grams WHERE last IS NOT NULL QUALIFY count(*) OVER (PARTITION BY rid, g) > 1
), covered AS (
  SELECT rid, count(DISTINCT i + j) AS n FROM twice, range({WINDOW}) r(j) GROUP BY rid
), line AS (
  SELECT rid, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d
), own AS (
  SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws FROM line
), sized AS (
  SELECT *, list_sum(list_transform(ws, lambda x: length(x))) AS size, row_number() OVER (PARTITION BY rid, line ORDER BY i) > 1 AS again
  FROM own WHERE len(ws) > 0
), ruled AS (
  SELECT *, again
      OR 100 * len(regexp_extract_all(line, '[#*$%&|<>]')) > {MAX_SYMBOLS} * size
      OR NOT regexp_matches(line, '[\pL\pN]')
      OR len(list_filter(ws, lambda x: list_contains({_list(BARS)}, x))) >= {MIN_BARS}
      OR (len(ws) <= {MOST_IN_LINK} AND NOT contains('{CLOSING_MARKS}', right(ws[-1], 1))
          AND len(list_filter(ws, lambda x: list_contains({_list(NAVIGATION)}, trim(lower(x), '{AROUND}')))) > 0
          AND len(list_filter(ws, lambda x: NOT list_contains({_list(NAVIGATION + FILLERS)}, trim(lower(x), '{AROUND}')))) = 0)
      OR (len(ws) >= {MIN_RUN_ON} AND len(list_filter(string_split('{SENTENCE_MARKS}', ''), lambda x: contains(line, x))) = 0)
      OR (len(ws) <= {MOST_IN_LINK} AND ({" OR ".join(f"suffix(ws[-1], '{e}')" for e in ELLIPSES)}))
      OR regexp_matches(lower(line), '{COPYRIGHT}')
      OR (len(ws) >= 3 AND 2 * len(list_filter(ws, lambda x: suffix(x, '!'))) > len(ws))
      OR (len(ws) >= {WINDOW} AND 100 * len(list_filter(list_zip(ws[1:-2], ws[2:]), lambda x: x[1] = x[2])) > {MAX_STUTTER} * len(ws))
      OR len(list_filter({_list(BOILERPLATE)}, lambda x: contains(lower(line), x))) > 0 AS fails
  FROM sized
), lines AS (
  SELECT rid, count(*) FILTER (again) AS doubles, coalesce(sum(size) FILTER (fails), 0) AS lost,
         coalesce(sum(len(ws)) FILTER (NOT fails), 0) AS remain
  FROM ruled GROUP BY rid
), base AS (
  SELECT doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(doubles, 0) AS n_dup_lines,
         coalesce(covered.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost, coalesce(remain, 0) AS remain
  FROM t LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words)
         AND 100 * lost <= {MAX_LOST} * word_chars AND remain >= {MIN_WORDS} AS kept
FROM base
"""
