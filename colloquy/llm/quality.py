"""Quality rules with adaptive thresholds (operator 8).

Each document's measures are rates, in integers. Per language and source a mergeable quantile sketch holds how many of
the documents that pass the fixed base rules fall into each bucket of a measure: exact below 128, then in steps of one
part in 64. Sketches add up, bucket by bucket, so partial ones combine before the shuffle. A group's limit is its ninth
decile and ``SPREADS`` times the distance from its median to there; both quantiles are weighted means of the group's,
its language's and all documents', by their numbers of documents, so that a small group leans on its language without
any step. The measures are then joined with their group's limits and filtered: a document goes when a count exceeds what
the limit allows a text of its length by more than ``NOISE`` times the chance scatter of such a count.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import _IS_SPACE, documents, materialise, text_slices, window_hashes, words

#: Measure: what is counted, of how many, in what unit, and how many of a kind come together by chance.
MEASURES = {
    "symbols": ("n_symbols", "n_words", 1000, 1),
    "repeats": ("n_repeat_words", "n_words", 1000, 6),
    "lines": ("n_dup_lines", "n_lines", 1000, 1),
    "upper": ("n_upper", "word_chars", 1000, 1),
    "length": ("word_chars", "n_words", 100, 2),
}
SPREADS, NOISE = 2, 4
#: Documents that the wider group counts for in a group's quantiles.
PRIOR_DOCS = 100
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_START = (np.arange(256) & 0xC0) != 0x80
_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper"]


def _per_document(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[offsets])


def repeat_words(doc: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Words that stand in a three-word window found twice or more in their document."""
    windows = window_hashes(hashes, 3)
    inside = np.flatnonzero(doc[: len(windows)] == doc[2:]) if len(windows) else np.zeros(0, np.int64)
    key, owner = windows[inside], doc[inside]
    order = np.lexsort((key, owner))
    same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = inside[order[twice]]
    covered = np.zeros(len(doc), bool)
    for k in range(3):
        covered[at + k] = True
    return np.bincount(doc[covered], minlength=n)


def _lines(data: np.ndarray, offsets: np.ndarray) -> tuple[list[int], list[int]]:
    """(lines with a word, those of them equal to an earlier line) per document."""
    raw, total, again = data.tobytes(), [], []
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        lines = [x for x in raw[a:b].split(b"\n") if x and x.split(None, 1)]
        total.append(len(lines))
        again.append(len(lines) - len(set(lines)))
    return total, again


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All columns but the last, which is the text, and the counts."""
    for batch in batches:
        carried = batch.schema.names[:-1]
        for start, end, data, offsets in text_slices(batch.column(len(carried))):
            doc, _, _, hashes = words(data, offsets, lower=False)
            n, word = end - start, ~_IS_SPACE[data]
            lines, again = _lines(data, offsets)
            counts = [np.bincount(doc, minlength=n), _per_document(word & _START[data], offsets), _per_document(_SYMBOL[data], offsets), again, repeat_words(doc, hashes, n), lines, _per_document(_UPPER[data], offsets)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(start, n) for i in range(len(carried))), *(pa.array(c, pa.int64()) for c in counts)], names=[*carried, *_COUNTS])


def measures(df: DataFrame, carry: dict[str, str], text: str = "text") -> DataFrame:
    """The columns ``carry`` names (new name by old), the counts and the scaled measures of every row; no shuffle."""
    picked = df.select(*[F.col(f"`{c}`").alias(to) for c, to in carry.items()], F.coalesce(F.col(text), F.lit("")).alias("_text"))
    types = [f"`{c}` {t}" for c, t in picked.dtypes[:-1]]
    counted = picked.mapInArrow(_measure, ", ".join([*types, *(f"{c} long" for c in _COUNTS)]))
    rate = lambda count, of, unit: F.expr(f"CASE WHEN {of} > 0 THEN {unit} * {count} DIV {of} ELSE 0 END")
    return counted.withColumns({m: rate(*how[:3]) for m, how in MEASURES.items()} | {"base_failed": F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")})


def bucket(value: Column) -> Column:
    """The sketch's bucket of a non-negative integer: itself below 128, else its seven leading bits."""
    step = F.call_function("shiftleft", F.lit(1).cast("long"), F.length(F.bin(value)) - 7)
    return F.when(value < 128, value).otherwise(value - F.pmod(value, step))


def thresholds(measured: DataFrame) -> DataFrame:
    """(of_lang, of_source, one limit t_<measure> each) for every group with a document that passes the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), bucket(F.col(m)).alias("bucket")) for m in MEASURES]))
    passed = measured.filter("not base_failed").select("lang", "source", each.alias("x")).select("lang", "source", "x.measure", "x.bucket")
    sketch = materialise(passed.groupBy("lang", "source", "measure", "bucket").agg(F.count("*").alias("n")))

    def cut(scope: list[str]) -> DataFrame:
        merged = sketch.groupBy(*scope, "measure", "bucket").agg(F.sum("n").alias("n"))
        group = Window.partitionBy(*scope, "measure")
        ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bucket"))).withColumn("docs", F.sum("n").over(group))
        return ranked.groupBy(*scope, "measure").agg(
            F.min(F.when(F.col("upto") * 2 >= F.col("docs"), F.col("bucket"))).alias("middle"),
            F.min(F.when(F.col("upto") * 10 >= F.col("docs") * 9, F.col("bucket"))).alias("high"),
            F.max("docs").alias("docs"),
        )

    def leaning(own: DataFrame, wider: DataFrame, scope: list[str]) -> DataFrame:
        """``own`` quantiles drawn towards those of ``wider``, which has fewer key columns."""
        wider = wider.select(*[F.col(c).alias(f"w_{c}") for c in wider.columns])
        same = functools.reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"w_{c}")) for c in scope])
        drawn = [F.expr(f"(docs * {q} + {PRIOR_DOCS} * w_{q}) DIV (docs + {PRIOR_DOCS})").alias(q) for q in ("middle", "high")]
        return own.join(wider, same).select(*[c for c in own.columns if c not in ("middle", "high")], *drawn)

    by_lang = leaning(cut(["lang"]), cut([]), ["measure"])
    own = leaning(cut(["lang", "source"]), by_lang, ["lang", "measure"])
    limit = F.col("high") + SPREADS * (F.col("high") - F.col("middle"))
    wide = own.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, limit)).alias(f"t_{m}") for m in MEASURES])
    return wide.withColumnsRenamed({"lang": "of_lang", "source": "of_source"})


def _exceeds(measure: str) -> Column:
    """Whether a count is above its limit by more than chance: its excess squared against NOISE squared times what is expected."""
    count, of, unit, together = MEASURES[measure]
    allowed = F.col(of) * F.col(f"t_{measure}")
    excess = unit * F.col(count) - allowed
    return (excess > 0) & (excess.cast("double") * excess.cast("double") > F.lit(float(NOISE**2 * unit * together)) * (allowed.cast("double") + F.lit(float(unit * together))))


def _judged(measured: DataFrame, limits: DataFrame) -> DataFrame:
    """``measured`` (with its lang and source) and kept. ``limits`` is a written table: Spark knows its size."""
    odd = functools.reduce(lambda a, b: a | b, [_exceeds(m) for m in MEASURES])
    joined = measured.join(limits, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(odd, F.lit(False)))


def judge(df: DataFrame, text: str = "text", row_id: str = "doc_id", lang: str = "lang", source: str = "source") -> DataFrame:
    """Per row: doc_id, counts, base_failed and kept.

    Null text has no words and fails. Null languages and sources are groups of their own. Repeated rows count and are
    judged alike, ids are not looked at. Long texts are measured whole. An empty table gives an empty one; other
    columns, whatever their names, are not read.
    """
    measured = materialise(measures(df, {row_id: "doc_id", lang: "lang", source: "source"}, text))
    return _judged(measured, materialise(thresholds(measured))).select("doc_id", *_COUNTS[:5], "base_failed", "kept")


def keep_good(df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows that pass, with all their columns, whatever their names; otherwise as ``judge``.

    Rows are measured twice and never shuffled: measuring again costs less than writing all texts.
    """
    limits = materialise(thresholds(measures(df, {lang: "lang", source: "source"}, text)))
    names = {c: f"_c{i}" for i, c in enumerate(df.columns)}
    measured = measures(df, names, text).withColumns({"lang": F.col(names[lang]), "source": F.col(names[source])})
    return _judged(measured, limits).filter("kept").select(*[F.col(to).alias(c) for c, to in names.items()])


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir))


def _sql_cut(name: str, scope: str) -> str:
    over = f"PARTITION BY {scope}measure"
    return f"""
{name} AS (SELECT {scope}measure, min(CASE WHEN upto * 2 >= docs THEN bucket END) AS middle, min(CASE WHEN upto * 10 >= docs * 9 THEN bucket END) AS high, max(docs) AS docs
  FROM (SELECT {scope}measure, bucket, sum(n) OVER ({over} ORDER BY bucket) AS upto, sum(n) OVER ({over}) AS docs
    FROM (SELECT {scope}measure, bucket, count(*) AS n FROM sketch GROUP BY {scope}measure, bucket)) GROUP BY {scope}measure)"""


def _sql_leaning(name: str, own: str, wider: str, keys: str, same: str) -> str:
    drawn = ", ".join(f"(o.docs * o.{q} + {PRIOR_DOCS} * w.{q}) // (o.docs + {PRIOR_DOCS}) AS {q}" for q in ("middle", "high"))
    return f"""
{name} AS (SELECT {keys}o.measure, {drawn} FROM {own} o JOIN {wider} w ON o.measure = w.measure{same})"""


def _sql_exceeds(measure: str) -> str:
    count, of, unit, together = MEASURES[measure]
    allowed, excess = f"({of} * t_{measure})", f"({unit} * {count} - {of} * t_{measure})"
    return f"({excess} > 0 AND {excess}::DOUBLE * {excess}::DOUBLE > {NOISE**2 * unit * together}::DOUBLE * ({allowed}::DOUBLE + {unit * together}::DOUBLE))"


OP8_SQL = (
    r"""
WITH t AS (SELECT doc_id, lang, source, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls, lang, source, text FROM t),
w AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM l),
g AS (SELECT doc_id, i, w || ' ' || lead(w) OVER o || ' ' || lead(w, 2) OVER o AS g FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
c AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, i + k AS i FROM r, (VALUES (0), (1), (2)) AS v(k)) GROUP BY doc_id),
counted AS (SELECT l.doc_id, lang, source, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) AS n_lines,
  len(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
  coalesce(c.n, 0) AS n_repeat_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
  FROM l LEFT JOIN c ON l.doc_id = c.doc_id),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, """
    + ", ".join(f"CASE WHEN {of} > 0 THEN {unit} * {count} // {of} ELSE 0 END AS {m}" for m, (count, of, unit, _) in MEASURES.items())
    + """ FROM counted),
u AS (UNPIVOT (SELECT doc_id, lang, source, symbols, repeats, lines, upper, length FROM m WHERE NOT base_failed) ON symbols, repeats, lines, upper, length INTO NAME measure VALUE v),
sketch AS (SELECT lang, source, measure, CASE WHEN v < 128 THEN v ELSE v - v % (1::BIGINT << (length(bin(v)) - 7)::BIGINT) END AS bucket FROM u),"""
    + ",".join([_sql_cut("over_own", "lang, source, "), _sql_cut("over_lang", "lang, "), _sql_cut("over_all", "")])
    + ","
    + _sql_leaning("by_lang", "over_lang", "over_all", "o.lang, ", "")
    + ","
    + _sql_leaning("by_own", "over_own", "by_lang", "o.lang, o.source, ", " AND o.lang IS NOT DISTINCT FROM w.lang")
    + f""",
best AS (SELECT lang, source, {", ".join(f"max(CASE WHEN measure = '{m}' THEN high + {SPREADS} * (high - middle) END) AS t_{m}" for m in MEASURES)} FROM by_own GROUP BY lang, source),
j AS (SELECT m.*, coalesce({" OR ".join(map(_sql_exceeds, MEASURES))}, false) AS odd
  FROM m LEFT JOIN best ON m.lang IS NOT DISTINCT FROM best.lang AND m.source IS NOT DISTINCT FROM best.source)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed, NOT base_failed AND NOT odd AS kept FROM j
"""
)
