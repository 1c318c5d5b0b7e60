"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Method. Each rule is a predicate over the raw text. Its cost (seconds a row)
and its selectivity (share rejected) are estimated on a random sample of a bounded
number of rows, the cost as the least of several runs beyond one that only reads; the
rules are then ordered by rejection per cost and built into one CASE, so that a
row rejected by an early rule never pays for the later ones. The order decides
which rule is named first, never whether a row is kept.

Defined cases. A null text has no words and is rejected by ``few_words``; an
empty table gives an empty result (the rules keep their given order).
Repeated rows and ties are judged each for itself. All columns of the input
are kept; the operator's own columns replace columns of the same name.
Windows of three words are compared by their 64-bit hash within one text.
"""

from __future__ import annotations

import math
import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows on which the costs and selectivities of the rules are estimated, times that a run judges each, and runs of each rule.
SAMPLE_ROWS, TIMES, RUNS = 300, 4, 3
#: Repeated windows up to which a text's windows are looked up among them; with more, all are sorted with their places.
FEW = 64

_SPACE = r"[\\x20\\x09-\\x0D]+"
_T = "coalesce(cast(`{text}` as string), '')"
_WORDS = f"filter(split({_T}, '{_SPACE}'), w -> w != '')"
_LINES = f"filter(split({_T}, '\\\\n'), l -> l rlike '[^\\\\x20\\\\x09-\\\\x0D]')"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _repeats() -> str:
    """Of the words ``ws``: how many stand in a window of three that occurs again. Without a repeated window, no places are looked for."""
    windows = "if(size(ws) < 3, cast(array() as array<bigint>), transform(sequence(0, size(ws) - 3), i -> xxhash64(ws[i], ws[i + 1], ws[i + 2])))"
    again = "array_distinct(filter(hs_sorted, (h, k) -> k > 0 and hs_sorted[k - 1] = h))"
    few = "filter(sequence(0, size(hs) - 1), i -> array_contains(ds, hs[i]))"
    twice = "transform(filter(gs, (g, k) -> coalesce(get(gs, k - 1).h = g.h, false) or coalesce(get(gs, k + 1).h = g.h, false)), g -> g.i)"
    many = _let("sort_array(transform(hs, (h, i) -> struct(h, i)))", "gs", f"sort_array({twice})")
    covered = "cast(aggregate(transform(ps, (p, k) -> least(3, coalesce(get(ps, k + 1), p + 3) - p)), 0, (a, x) -> a + x) as bigint)"
    found = _let(f"if(size(ds) <= {FEW}, {few}, {many})", "ps", covered)
    return _let(windows, "hs", _let("sort_array(hs)", "hs_sorted", _let(again, "ds", f"if(size(ds) = 0, 0L, {found})")))


_BLANKS = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
#: Measures by name, as SQL over the text column.
MEASURES = {
    "n_words": f"cast(size({_WORDS}) as bigint)",
    "word_chars": f"cast(length(translate({_T}, {_BLANKS}, '')) as bigint)",
    "n_symbols": f"cast(length({_T}) - length(translate({_T}, '#*$%&|<>', '')) as bigint)",
    "n_lines": f"cast(size({_LINES}) as bigint)",
    "n_dup_lines": "cast(" + _let(_LINES, "ls", "size(ls) - size(array_distinct(ls))") + " as bigint)",
    "n_repeat_words": _let(_WORDS, "ws", _repeats()),
    "n_upper_words": f"cast(size(filter({_WORDS}, w -> length(w) > 1 and w = upper(w) and w != lower(w))) as bigint)",
}


@dataclass(frozen=True)
class Rule:
    """A row is rejected where ``reject`` holds, a condition over names of :data:`MEASURES` in braces."""

    name: str
    reject: str

    def sql(self, text: str) -> str:
        return self.reject.format(**{k: v.format(text=text) for k, v in MEASURES.items()})


#: The base rules come first; the others reject symbol junk, repeated lines, shouting and unlikely words.
RULES = (
    Rule("few_words", "{n_words} < 50"),
    Rule("repeated_words", "100 * {n_repeat_words} > 50 * {n_words}"),
    Rule("symbols", "10 * {n_symbols} > {n_words}"),
    Rule("repeated_lines", "2 * {n_dup_lines} > {n_lines}"),
    Rule("shouting", "2 * {n_upper_words} > {n_words}"),
    Rule("word_length", "{word_chars} > 20 * {n_words} or {word_chars} < 2 * {n_words}"),
)


def estimate(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """(rule, seconds a row, share rejected) on a sample of at most ``sample_rows`` rows, best ratio first."""
    spark = df.sparkSession
    # The smallest random numbers are found without the texts, and only the texts that have them are fetched.
    most = df.select(F.rand(7).alias("_r")).orderBy("_r").limit(sample_rows).agg(F.max("_r")).first()[0]
    drawn = df.select(F.col(text_col).cast("string").alias("_t"), F.rand(7).alias("_r"))
    rows = [] if most is None else [r[0] for r in drawn.filter(F.col("_r") <= most).limit(sample_rows).collect()]
    if not rows:
        return [(r, 1.0, 0.0) for r in rules]
    sample = spark.createDataFrame([(r,) for r in rows], f"`{text_col}` string").coalesce(1)
    sample = sample.withColumn("_time", F.explode(F.sequence(F.lit(1), F.lit(TIMES))))

    def run(condition: str) -> tuple[float, float]:
        share, least = sample.agg(F.avg(F.expr(f"cast(({condition}) as int)")).alias("r")), math.inf
        for _ in range(RUNS):
            began = time.perf_counter()
            rejected = share.first()[0] or 0.0
            least = min(least, time.perf_counter() - began)
        return least, rejected

    runs = [(rule, *run(rule.sql(text_col))) for rule in rules]
    read = run(f"`{text_col}` is null")[0]
    # A difference of a twentieth of the reading is within what timing can tell.
    found = [(rule, max(seconds - read, read / 20) / (TIMES * len(rows)), rejected) for rule, seconds, rejected in runs]
    return sorted(found, key=lambda x: -x[2] / x[1])


def cascade(rules: list[Rule], text_col: str = "text") -> Column:
    """The name of the first rule that rejects a row, else null; later rules aren't evaluated."""
    out = " ".join(f"WHEN {r.sql(text_col)} THEN '{r.name}'" for r in rules)
    return F.expr(f"CASE {out} END")


def quality_filter(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows that no rule rejects, with their columns unchanged."""
    order = [r for r, _, _ in estimate(df, text_col, rules)]
    return df.filter(cascade(order, text_col).isNull())


def quality_report(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows with the measures of the base rules, ``base_failed``, ``rejected_by`` and ``kept``."""
    order = [r for r, _, _ in estimate(df, text_col, rules)]
    # The measures that the report shows are there already, so the cascade reads them instead of the text.
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    # Words are split once for the measures that go by them.
    words = _let(_WORDS, "ws", f"named_struct('n_words', cast(size(ws) as bigint), 'n_repeat_words', {_repeats()})").format(text=text_col)
    out = df.withColumn("_words", F.expr(words))
    out = out.withColumns({k: F.col(f"_words.{k}") if k in ("n_words", "n_repeat_words") else F.expr(MEASURES[k].format(text=text_col)) for k in shown}).drop("_words")
    have = {k: f"`{k}`" if k in shown else v.format(text=text_col) for k, v in MEASURES.items()}
    case = " ".join(f"WHEN {r.reject.format(**have)} THEN '{r.name}'" for r in order)
    return (
        out.withColumn("base_failed", F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words"))
        .withColumn("rejected_by", F.expr(f"CASE {case} END"))
        .withColumn("kept", F.expr("not base_failed and rejected_by is null"))
    )


#: The query op7 in SQL: the same measures, and the verdict of all rules (their order makes no difference to it).
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM (
      SELECT doc_id, unnest(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) AS x, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)),
r AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM g, range(0, 3) AS o(k) WHERE c > 1 GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(ls) AS n_lines, len(list_filter(ws, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS n_upper
      FROM w LEFT JOIN r ON r.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR 2 * n_upper > n_words OR word_chars > 20 * n_words OR word_chars < 2 * n_words) AS kept
FROM b
"""
