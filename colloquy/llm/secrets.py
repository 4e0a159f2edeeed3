"""Secret scans with corpus-wide ownership (operator 7, DataFrame functions only).

Three fixed patterns give the base spans. The method adds spans of kind ``owned``: long mixed tokens whose hash,
over the whole corpus, belongs to one owner only. Each document counts as the place a candidate stands in and its
source as the owner. The values of base spans are candidates too. A candidate that several owners hold, or many
documents of one owner, is a copied example, not a live credential.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, materialise

#: Fixed values of the contract.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
VALUE_CHARS, HINT = 6, r"(?i)passw|secret|token|api_?key"
#: A candidate for ownership: a run of token characters with a digit and a letter.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{20,}(?![A-Za-z0-9+/_=-])"
#: Owners that may hold a candidate before it counts as a copied example.
MOST_OWNERS = 1
#: Documents that may hold it.
MOST_PLACES = 10
LIVE, COPIED = "live", "copied"


SPAN = "struct<start:long,rank:int,kind:string,stop:long,hash:string>"
#: Matches whose places are added up one after the other; longer lists are cut into runs of as many.
RUN = 256


def match_spans(text: Column, pattern: str, kind: str, rank: int, value: Callable[[Column], Column] = lambda body: body) -> Column:
    """Spans of the leftmost non-overlapping matches, in code points: array of (start, rank, kind, stop, hash).

    The pieces between matches and the matches themselves alternate; their lengths add up to positions, run by run, so
    that a text of very many matches costs little more than each of them. ``hash`` is that of the match's ``value``,
    and null where that is null.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.transform(F.split(text, pattern, -1), lambda p: F.length(p).cast("long"))
    pairs = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, body: F.struct(gap.alias("gap"), F.length(body).cast("long").alias("chars"), F.sha2(value(body).cast("binary"), 256).alias("hash")))
    zero = F.lit(0).cast("long")
    runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(found) - 1, F.lit(0)), F.lit(RUN)), lambda at: F.slice(pairs, at + 1, RUN))

    def begins(lengths: Column, start: Column) -> Column:
        """Where each of ``lengths`` begins, and where the last ends."""
        return F.aggregate(lengths, F.array(start), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))

    def spans(run: Column, start: Column) -> Column:
        at = begins(F.transform(run, lambda p: p["gap"] + p["chars"]), start)
        return F.zip_with(run, F.slice(at, 2, F.size(run)), lambda p, stop: F.struct((stop - p["chars"]).alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), stop.alias("stop"), p["hash"].alias("hash")))

    starts = begins(F.transform(runs, lambda run: F.aggregate(run, zero, lambda acc, p: acc + p["gap"] + p["chars"])), zero)
    empty = F.array().cast(f"array<{SPAN}>")
    return F.when(F.size(found) == 0, empty).otherwise(F.flatten(F.zip_with(runs, F.slice(starts, 1, F.size(runs)), spans)))


def _listed(spans: Column) -> Column:
    """kind:start:stop, comma-joined, by start and then kind as listed."""
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def scan(df: DataFrame, text: str = "text", owner: str = "source", row_id: str = "doc_id") -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base and spans (arrays of span structs) and candidates with verdicts.

    Candidates are structs of start, rank, kind, stop, hash, places, owners and verdict (live or copied), of all base
    spans and long mixed tokens; the hash of an assignment is its value's. ``spans`` holds the base spans and the live
    tokens. Null and empty texts have no spans. A null owner is an owner of its own. Rows repeated with the same id and
    text hold the same spans and count once as a place. Long texts are scanned whole. An empty table gives an empty one;
    other columns, whatever their names, are not read. Only hashes of secrets are written.
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    none = F.array().cast(f"array<{SPAN}>")
    assigned = lambda match: F.regexp_extract(match, ASSIGN, 1)
    long_value = lambda match: F.when(F.length(assigned(match)) >= VALUE_CHARS, assigned(match))
    assign = F.when(F.regexp_like(body, F.lit(HINT)), match_spans(body, ASSIGN, "assign", 0, long_value)).otherwise(none)
    assign = F.filter(assign, lambda s: s["hash"].isNotNull())
    access = F.when(F.contains(body, F.lit("AKIA")), match_spans(body, ACCESS, "access", 1)).otherwise(none)
    hexes = F.when(F.regexp_like(body, F.lit(HEX)), match_spans(body, HEX, "hex", 2)).otherwise(none)
    owned = F.when(F.regexp_like(body, F.lit(CANDIDATE)), match_spans(body, CANDIDATE, "owned", 3)).otherwise(none)
    found = df.select(
        F.col(f"`{row_id}`").alias("doc_id"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{owner}`")), F.lit("")).alias("owner"),
        F.xxhash64(body).alias("text_key"),
        assign.alias("a"),
        access.alias("k"),
        hexes.alias("h"),
        owned.alias("c"),
    )
    found = materialise(found)
    spans = found.select("doc_id", "owner", "text_key", F.explode(F.concat("a", "k", "h", "c")).alias("span")).withColumn("hash", F.col("span.hash"))
    # Distinct places first, then per owner, then over owners: all three combine before they are shuffled.
    places = spans.select("hash", "owner", "doc_id", "text_key").distinct().groupBy("hash", "owner").agg(F.count("*").alias("n"))
    counts = places.groupBy("hash").agg(F.sum("n").alias("places"), F.count("*").alias("owners"))
    live = (F.col("owners") <= MOST_OWNERS) & (F.col("places") <= MOST_PLACES)
    counts = counts.withColumn("verdict", F.when(live, LIVE).otherwise(COPIED))
    candidate = F.struct("span.start", "span.rank", "span.kind", "span.stop", "hash", "places", "owners", "verdict")
    own = F.when((F.col("span.kind") == "owned") & (F.col("verdict") == LIVE), F.col("span"))
    added = spans.join(counts, "hash").groupBy("doc_id", "text_key").agg(F.collect_set(own).alias("added"), F.collect_set(candidate).alias("candidates"))
    added = added.select(F.col("doc_id").alias("of_doc"), F.col("text_key").alias("of_text"), "added", F.array_sort("candidates").alias("candidates"))
    joined = found.join(added, F.col("doc_id").eqNullSafe(F.col("of_doc")) & (F.col("text_key") == F.col("of_text")), "left")
    base = F.concat("a", "k", "h")
    return joined.select(
        "doc_id",
        F.size("a").cast("long").alias("n_assign"),
        F.size("k").cast("long").alias("n_access"),
        F.size("h").cast("long").alias("n_hex"),
        base.alias("base"),
        F.concat(base, F.coalesce("added", none)).alias("spans"),
        F.coalesce("candidates", F.array().cast(added.schema["candidates"].dataType)).alias("candidates"),
    )


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(documents(spark, sf_dir))
    verdict = lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["stop"].cast("string"), c["places"].cast("string"), c["owners"].cast("string"), c["verdict"])
    return found.select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(_listed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"),
        F.array_join(F.transform("candidates", verdict), ",").alias("candidates"),
    )
