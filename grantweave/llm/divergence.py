"""Source divergence audit (operator 11): how each source of a language uses its words.

Method: a translate-table tokenizer.  One ``bytes.translate`` lowers A-Z and
blanks every separator of a text's UTF-8 bytes, ``bytes.split`` cuts it, and a
``Counter`` per document yields its term frequencies; a task adds these to its
sparse counts per (lang, source), which it hands on whenever they reach
``HELD_TERMS`` entries.  So what is shuffled is aggregated before, and a hot
source or a frequent word reaches a reducer as one row per task at most.

Shares and the two kinds of differences are exact integers.  With f(p, q) =
floor((p-q)^2 / q), the sum of f over all kept terms for a pair of sources (a, b)
is split by who uses a term: a term that neither uses has the two unseen shares,
so these need a count only; terms that one of them uses enter through the
histogram of its counts; only terms that both use are looked at pair by pair, in
numpy, by tasks that hold whole terms and sum before they hand on.  Thus no join
makes a row per term and pair.

Defined results: a null text, lang or source counts as ''; a text without terms
still makes its group occur; a repeated row counts again; a language that keeps
no term has pairs of value 0 and no term rows; an empty table yields no rows;
extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, small_batches

SCALE, MIN_DOCS, TOP = 1_000_000_000, 3, 200
#: Terms that a task holds before it hands its counts on; rows and pairs that it looks at together.
HELD_TERMS, HELD_ROWS, HELD_PAIRS = 400_000, 500_000, 1_000_000
#: Letters and all bytes of longer characters stay, A-Z lowered; every other byte becomes a blank.
TERM_BYTES = bytes(32 if b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if b <= 0x5A else b for b in range(256))
_DOCUMENT = 1 << 40  # in a task's sums, one document; below it, occurrences


def terms(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, in order."""
    return text.translate(TERM_BYTES).split()


def term_counts(docs: DataFrame) -> DataFrame:
    """Partial sums (lang, source, term, count, docs), and one row with a null term for each group."""

    def rows(held: dict[tuple[str, str], dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), sums in held.items():
            n = len(sums)
            packed = np.fromiter(sums.values(), np.int64, n)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * (n + 1), pa.string()),
                    pa.array([source] * (n + 1), pa.string()),
                    pa.array([None, *(t.decode() for t in sums)], pa.string()),
                    pa.array(np.append(0, packed % _DOCUMENT)),
                    pa.array(np.append(0, packed // _DOCUMENT)),
                ],
                ["lang", "source", "term", "count", "docs"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], dict[bytes, int]] = {}
        size = 0
        for b in small_batches(batches, 64):
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
                sums = held.setdefault((lang, source), {})
                size -= len(sums)
                known = sums.get
                for term, n in Counter(terms(text)).items():
                    sums[term] = known(term, 0) + n + _DOCUMENT
                size += len(sums)
            if size > HELD_TERMS:
                yield from rows(held)
                held, size = {}, 0
        yield from rows(held)

    plain = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source")]
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("text")
    return docs.select(*plain, text).mapInArrow(run, "lang string, source string, term string, count long, docs long")


def share(count: str, total: str, scale: int = SCALE) -> Column:
    """1 + floor(scale * (count + 1) / total) of two long columns, exact at any size."""
    wide = f"cast({count} + 1 as decimal(19,0)) * {scale}BD div cast({total} as decimal(19,0))"
    return F.expr(f"1 + case when {count} < {(1 << 63) // scale - 2} then ({count} + 1) * {scale}L div {total} else {wide} end")


def difference(p: str, q: str) -> str:
    """SQL of floor((p - q)^2 / q), in longs: shares are at most scale + 1."""
    return f"(({p} - {q}) * ({p} - {q}) div {q})"


def _both(rows: DataFrame) -> DataFrame:
    """Per (lang, source, item): what terms that both use add to the sum made from the two histograms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, str], int] = {}
        sums: dict[int, int] = {}
        wait: list[tuple] = []

        def add(lang: list[str], term: list[str], source: list[str], p: np.ndarray, p0: np.ndarray) -> None:
            n = len(lang)
            code = np.fromiter((groups.setdefault(k, len(groups)) for k in zip(lang, source)), np.int64, n)
            new = [True, *(a != b or c != d for a, b, c, d in zip(lang, lang[1:], term, term[1:]))]
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, n))
            first, width = np.repeat(start, size), np.repeat(size, size)  # of each row's term
            done = 0
            ends = np.cumsum(width)
            while done < n:
                base = ends[done - 1] if done else 0
                stop = max(done + 1, int(np.searchsorted(ends, base + HELD_PAIRS, side="right")))
                w = width[done:stop]
                left = np.repeat(np.arange(done, stop), w)
                right = np.arange(len(left)) - np.repeat(np.cumsum(w) - w, w) + first[left]
                left, right = left[left != right], right[left != right]
                pa_, pb, a0, b0 = p[left], p[right], p0[left], p0[right]
                f = lambda x, y: (x - y) * (x - y) // y
                value = f(pa_, pb) - f(pa_, b0) - f(a0, pb) + f(a0, b0)
                pair = (code[left] << 32) | code[right]
                order = np.argsort(pair, kind="stable")
                pair, value = pair[order], value[order]
                at = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]][: len(pair)])
                for k, v in zip(pair[at].tolist(), np.add.reduceat(value, at).tolist() if len(at) else ()):
                    sums[k] = sums.get(k, 0) + v
                done = stop

        def out() -> Iterator[pa.RecordBatch]:
            names = list(groups)
            pairs = [(names[k >> 32], names[k & 0xFFFFFFFF][1], v) for k, v in sums.items()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([g[0] for g, _, _ in pairs], pa.string()), pa.array([g[1] for g, _, _ in pairs], pa.string()),
                 pa.array([i for _, i, _ in pairs], pa.string()), pa.array([v for *_, v in pairs], pa.int64())],
                ["lang", "source", "item", "value"],
            )
            sums.clear()
            groups.clear()

        def flush(keep_last: bool) -> None:
            """Add the waiting rows, all but those of the last term while more may follow."""
            lang, term, source = ([x for part in wait for x in part[k]] for k in range(3))
            p, p0 = (np.concatenate([part[k] for part in wait]) for k in (3, 4))
            cut = len(lang)
            if keep_last:
                while cut and (lang[cut - 1], term[cut - 1]) == (lang[-1], term[-1]):
                    cut -= 1
            if cut:
                add(lang[:cut], term[:cut], source[:cut], p[:cut], p0[:cut])
            wait[:] = [(lang[cut:], term[cut:], source[cut:], p[cut:], p0[cut:])] if cut < len(lang) else []

        rows_held = 0
        for b in batches:
            wait.append((*(b.column(c).to_pylist() for c in ("lang", "term", "source")), *(b.column(c).to_numpy() for c in ("p", "p0"))))
            rows_held += b.num_rows
            if rows_held > HELD_ROWS:
                flush(True)
                rows_held = sum(len(part[0]) for part in wait)
            if len(sums) > HELD_PAIRS:
                yield from out()
        if wait:
            flush(False)
        yield from out()

    whole = rows.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term")
    return whole.mapInArrow(run, "lang string, source string, item string, value long")


def source_divergence(docs: DataFrame, top: int = TOP, min_docs: int = MIN_DOCS, scale: int = SCALE) -> DataFrame:
    """lang, source, part, item, value, rank: every pair of a language's sources, and each source's ``top`` terms."""
    scratch = Scratch(docs.sparkSession, "divergence")
    sums = term_counts(docs).groupBy("lang", "term", "source").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    sums = sums.withColumns(
        {"in_docs": F.sum("docs").over(term), "in_lang": F.sum("count").over(term), "one": F.row_number().over(term.orderBy("source"))}
    )
    kept = F.col("term").isNull() | (F.col("in_docs") >= min_docs)
    # a null term stands for its group alone
    counts = scratch.keep(sums.filter(kept).select("lang", "term", "source", "count", "in_lang", (F.col("one") == 1).alias("one")))

    is_term = F.col("term").isNotNull()
    langs = counts.groupBy("lang").agg(F.count_if(is_term & F.col("one")).alias("v"), F.sum("count").alias("lang_n"))
    groups = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    groups = groups.join(langs, "lang").withColumn("total", F.col("n") + F.col("v"))
    unseen = F.when(F.col("v") > 0, F.expr(f"1 + {scale}L div if(v > 0, total, 1)"))
    groups = scratch.keep(groups.select("lang", "source", "v", "total", (F.col("lang_n") + F.col("v")).alias("lang_total"), unseen.alias("p0")))

    used = counts.filter(is_term).join(groups, ["lang", "source"])
    used = used.select("lang", "term", "source", "count", share("count", "total", scale).alias("p"), "p0", share("in_lang", "lang_total", scale).alias("q"))
    own = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    above = used.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr(difference("p", "q")).alias("value"))
    above = above.withColumn("rank", F.row_number().over(own)).filter(F.col("rank") <= top)

    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("b0"), "v")
    base = groups.select("lang", "source", "p0").join(others, "lang").filter("source <> item")
    base = base.select("lang", "source", "item", F.expr(f"if(v > 0, v * {difference('p0', 'b0')}, 0L)").alias("value"))
    seen = used.groupBy("lang", "source", "count", "p", "p0").agg(F.count("*").alias("times"))
    seen = seen.join(others, "lang").filter("source <> item")
    ways = F.inline(
        F.array(
            F.struct(F.col("source").alias("source"), F.col("item").alias("item"), F.expr(f"times * ({difference('p', 'b0')} - {difference('p0', 'b0')})").alias("value")),
            F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.expr(f"times * ({difference('b0', 'p')} - {difference('b0', 'p0')})").alias("value")),
        )
    )
    pairs = base.unionByName(seen.select("lang", ways)).unionByName(_both(used))
    pairs = pairs.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(own))
    return pairs.unionByName(above)


SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), words AS (
  SELECT lang, source, term, doc, count(*) AS n FROM (SELECT doc, lang, source, unnest(terms) AS term FROM docs) GROUP BY ALL
), kept AS (
  SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM words GROUP BY ALL HAVING count(*) >= {MIN_DOCS}
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT g.lang, g.source, k.term, CAST(coalesce(sum(w.n), 0) AS HUGEINT) AS n
  FROM groups g JOIN kept k ON k.lang = g.lang
  LEFT JOIN words w ON w.lang = g.lang AND w.source = g.source AND w.term = k.term GROUP BY ALL
), shares AS (
  SELECT lang, source, term, c.n, 1 + {SCALE} * (c.n + 1) // (sum(c.n) OVER (PARTITION BY lang, source) + v) AS p
  FROM counts c JOIN langs l USING (lang)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), tops AS (
  SELECT s.lang, s.source, s.term AS item, (p - q) * (p - q) // q AS value
  FROM shares s JOIN (SELECT k.lang, k.term, 1 + {SCALE} * (k.n + 1) // (l.n + v) AS q FROM kept k JOIN langs l ON k.lang = l.lang) t
    ON s.lang = t.lang AND s.term = t.term
  WHERE s.n > 0 AND p > q
), ranked AS (
  SELECT lang, source, 'pair' AS part, item, CAST(coalesce(value, 0) AS BIGINT) AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', item, CAST(value AS BIGINT) FROM tops
)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM ranked QUALIFY part = 'pair' OR rank <= {TOP}
"""
