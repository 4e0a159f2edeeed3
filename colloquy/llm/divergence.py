"""Source divergence audit (operator 11): how far each source's choice of words lies from its language and from its peers.

Tasks count terms before anything is shuffled. A term that enough documents of a language hold has a share in every
(language, source) group, in whole billionths, smoothed so that no share is zero. All arithmetic is on whole numbers.

Pairs: two sources differ by the sum over all terms of the gap of their shares. The terms that a source lacks all have
one share, so a sum over postings is enough: a group's terms against the other's empty share, from the number of its
terms with each share, and a correction for terms that both hold.

Terms: a group's most overused terms are searched best first. Its terms lie in buckets of like counts; a bucket's
greatest share less the least language share of its terms bounds every gap in it. Buckets are read from the highest
bound down until all unread bounds are strictly below the k-th best gap.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialise

#: Fixed values of the contract: documents that must hold a term, smoothing, the share's unit, terms reported a group.
LEAST_DOCUMENTS, SMOOTH, UNIT, TOP = 30, 5, 1_000_000_000, 50
#: Distinct terms, and bytes of text, after which a task hands on its counts: bounds its memory.
FLUSH_TERMS, FLUSH_BYTES = 150_000, 1 << 25
#: Buckets for a doubling of the count, and how much further each round of the search reads than the one before.
BUCKETS, WIDEN = 8, 4

#: A to Z become small, letters and all bytes of non-ASCII characters stay, the rest separates terms.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): occurrences of each term and documents that hold it, added up inside a task."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = read = 0

    def out() -> pa.RecordBatch:
        keys = [(lang, source, n) for (lang, source), (n, _) in groups.items()]
        column = lambda values, kind: pa.array([v for vs in values for v in vs], kind)
        return pa.RecordBatch.from_arrays(
            [
                column(([lang] * len(n) for lang, _, n in keys), pa.string()),
                column(([source] * len(n) for _, source, n in keys), pa.string()),
                column((n for *_, n in keys), pa.binary()).cast(pa.string()),
                column((n.values() for *_, n in keys), pa.int64()),
                column(([docs[t] for t in n] for n, docs in groups.values()), pa.int64()),
            ],
            names=["lang", "source", "term", "n", "docs"],
        )

    for batch in batches:
        texts = batch.column("text").cast(pa.binary())
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), texts):
            terms = text.as_py().translate(_TERM_BYTES).split()
            n, docs = groups.setdefault((lang, source), (Counter(), Counter()))
            before = len(n)
            n.update(terms)
            docs.update(set(terms))
            held += len(n) - before
            read += len(text.as_buffer()) if text.is_valid else 0
            if held >= FLUSH_TERMS or read >= FLUSH_BYTES:
                yield out()
                groups.clear()
                held = read = 0
    if held:
        yield out()


def share(n: str, total: str, terms: str) -> Column:
    """1 + floor(UNIT * (n + SMOOTH) / (total + SMOOTH * terms)), exact; null where there is no term."""
    wide = f"CAST({n} + {SMOOTH} AS DECIMAL(20, 0)) * {UNIT}L"
    return F.expr(f"1 + ({wide}) div NULLIF(CAST({total} + {SMOOTH} * {terms} AS DECIMAL(20, 0)), 0)")


class Audit:
    """Shares of all kept terms of ``df``'s (lang, source) groups, and what is told from them.

    Null text, lang and source count as empty; an empty text only makes its group known. Long texts are read whole;
    repeated rows count each time. A language without kept terms has pairs of value 0 and no terms. An empty table gives
    empty results. Other columns, whatever their names, are not read.
    """

    def __init__(self, df: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_documents: int = LEAST_DOCUMENTS) -> None:
        named = lambda c, to: F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(to)
        docs = df.select(named(lang, "lang"), named(source, "source"), named(text, "text"))
        parts = docs.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
        counts = materialise(parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
        kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).filter(F.col("docs") >= least_documents).drop("docs")
        kept = materialise(kept)
        langs = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
        found = materialise(counts.select("lang", "source", "term", "n").join(kept, ["lang", "term"]))
        totals = found.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
        #: (lang, source, total, terms, lang_total, none): ``none`` is the share of a term that the group lacks.
        self.groups = materialise(groups.withColumn("none", F.coalesce(share("0L", "total", "terms"), F.lit(0).cast("long"))))
        shares = found.join(self.groups, ["lang", "source"])
        bucket = F.floor(F.log2("n") * BUCKETS).cast("int")
        columns = ["lang", "source", "term", share("n", "total", "terms").alias("p"), share("lang_n", "lang_total", "terms").alias("q"), "none", bucket.alias("bucket")]
        #: (lang, source, term, p, q, none, bucket): the postings, a row for each kept term and group that has it.
        self.postings = materialise(shares.select(*columns))

    def pairs(self) -> DataFrame:
        """(lang, source, item, value) for each two sources of a language, both ways."""
        one = self.groups.select("lang", F.col("source").alias("a"), F.col("none").alias("none_a"), "terms")
        other = self.groups.select("lang", F.col("source").alias("b"), F.col("none").alias("none_b"))
        gap = lambda x, y: F.abs(F.col(x) - F.col(y))
        empty = one.join(other, "lang").filter("a < b").select("lang", "a", "b", (F.col("terms") * gap("none_a", "none_b")).alias("v"))
        # A group's terms against the share that the other has for terms it lacks, by how many terms have each share.
        same = self.postings.groupBy("lang", F.col("source").alias("a"), F.col("none").alias("none_a"), "p").agg(F.count("*").alias("m"))
        single = same.join(other, "lang").filter("a <> b")
        single = single.select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), (F.col("m") * (gap("p", "none_b") - gap("none_a", "none_b"))).alias("v"))
        held = lambda s: self.postings.select("lang", "term", F.col("source").alias(s), F.col("p").alias(f"p_{s}"), F.col("none").alias(f"none_{s}"))
        both = held("a").join(held("b"), ["lang", "term"]).filter("a < b")
        both = both.select("lang", "a", "b", (gap("p_a", "p_b") - gap("p_a", "none_b") - gap("none_a", "p_b") + gap("none_a", "none_b")).alias("v"))
        sums = empty.unionByName(single.groupBy("lang", "a", "b").agg(F.sum("v").alias("v"))).unionByName(both.groupBy("lang", "a", "b").agg(F.sum("v").alias("v")))
        sums = materialise(sums.groupBy("lang", "a", "b").agg(F.sum("v").alias("value")))
        turned = sums.select("lang", F.col("b").alias("source"), F.col("a").alias("item"), "value")
        return sums.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), "value").unionByName(turned)

    def terms(self, top: int = TOP) -> DataFrame:
        """(lang, source, item, value) of each group's ``top`` terms with the greatest p - q > 0; ties by term."""
        bounds = self.postings.groupBy("lang", "source", "bucket").agg((F.max("p") - F.min("q")).alias("bound"), F.count("*").alias("m"))
        best_first = Window.partitionBy("lang", "source").orderBy(F.desc("bound"), "bucket").rowsBetween(Window.unboundedPreceding, -1)
        # A gap above 0 is 1 at least, so buckets bounded by 0 hold none.
        buckets = materialise(bounds.filter("bound > 0").withColumn("ahead", F.coalesce(F.sum("m").over(best_first), F.lit(0))))
        order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
        best = self.postings.limit(0).select("lang", "source", F.col("term").alias("item"), F.col("p").alias("value"))
        read_from, read_to = 0, top
        while True:
            last = best.withColumn("at", F.row_number().over(order)).filter(F.col("at") == top).select("lang", "source", F.col("value").alias("kth"))
            unread = buckets.join(last, ["lang", "source"], "left").filter((F.col("ahead") >= read_from) & (F.col("kth").isNull() | (F.col("bound") >= F.col("kth"))))
            unread = materialise(unread.select("lang", "source", "bucket", "ahead"))
            if unread.isEmpty():
                return best
            now = unread.filter(F.col("ahead") < read_to).drop("ahead")
            gaps = self.postings.join(now, ["lang", "source", "bucket"]).filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
            ranked = best.unionByName(gaps).withColumn("at", F.row_number().over(order))
            best = materialise(ranked.filter(F.col("at") <= top).drop("at"))
            read_from, read_to = read_to, read_to * WIDEN


def op11_source_divergence(spark, sf_dir: str) -> DataFrame:
    audit = Audit(documents(spark, sf_dir))
    parts = audit.pairs().withColumn("part", F.lit("pair")).unionByName(audit.terms().withColumn("part", F.lit("term")))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    return parts.withColumn("rank", rank).select("lang", "source", "part", "item", "value", "rank")


OP11_SQL = """
WITH docs AS (SELECT row_number() OVER () AS row_no, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
occurs AS (SELECT row_no, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{80}-\\x{10FFFF}]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM occurs GROUP BY lang, term HAVING count(DISTINCT row_no) >= 30),
langs AS (SELECT lang, sum(n)::HUGEINT AS total, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
held AS (SELECT o.lang, o.source, o.term, count(*)::HUGEINT AS n FROM occurs o JOIN kept k ON k.lang = o.lang AND k.term = o.term GROUP BY ALL),
groups AS (SELECT g.lang, g.source, coalesce(sum(h.n), 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM docs) g LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source GROUP BY g.lang, g.source),
shares AS (SELECT g.lang, g.source, k.term, coalesce(h.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(h.n, 0) + 5)) // (g.total + 5 * l.v) AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
  FROM groups g JOIN langs l ON l.lang = g.lang JOIN kept k ON k.lang = g.lang LEFT JOIN held h ON h.lang = g.lang AND h.source = g.source AND h.term = k.term),
gaps AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM shares a JOIN shares b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(g.value, 0)::BIGINT AS value FROM groups a JOIN groups b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN gaps g ON g.lang = a.lang AND g.source = a.source AND g.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""
