"""Secret scans with DataFrame functions only: pattern candidates, then corpus-wide ownership of their hashes."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace

#: Fixed patterns (kind, pattern, group whose length counts, least length), in the order in which kinds sort.
BASE = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"[0-9a-f]{32,}", 0, 32),
)
#: The method's own candidates: words of 24 and more base64 characters with digits and letters in both cases.
OPAQUE = ("opaque", r"[A-Za-z0-9+/_=-]{24,}", 0, 24)
#: Repositories and owners beyond which a value counts as a copied example.
MOST_REPOSITORIES, MOST_OWNERS = 3, 1
#: Signs of values that stand for a secret: fixed words.
PLACEHOLDER = r"(?i)example|changeme|placeholder|dummy|sample|your|xxxx|1234567"


#: Matches that are folded together; the runs' results are then joined, so that a text of very many matches costs little more for each.
RUN = 128


def bound(x: Column, body) -> Column:
    """body(x), with x computed once however often the body names it."""
    return F.element_at(F.transform(F.array(x), body), 1)


def runs(rows: Column) -> Column:
    """An array as an array of short ones. Built-in folds copy what they have gathered at each element; so they run over short
    arrays, and only these arrays' results are gathered in one."""
    last = F.greatest(F.lit(0), F.ceil(F.size(rows) / RUN).cast("int") - 1)
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(rows, i * RUN + 1, F.lit(RUN)))


def spans(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """array<struct<start, kind, end, value>> of a pattern's leftmost non-overlapping matches, positions in code points: the stretches
    between matches come from a split by the same pattern, and running lengths give the places."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    rows = F.arrays_zip(whole.alias("m"), part.alias("v"), F.slice(gaps, 1, F.size(whole)).alias("g"))
    none = F.expr("cast(array() as array<struct<start: int, end: int, value: string>>)")

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["g"])
        more = F.when(F.length(x["v"]) >= least, F.array(F.struct(a.alias("start"), (a + F.length(x["m"])).alias("end"), x["v"].alias("value")))).otherwise(none)
        return F.struct((a + F.length(x["m"])).alias("at"), F.concat(acc["found"], more).alias("found"))

    def run(acc: Column, part: Column) -> Column:
        done = lambda x: F.struct(x["at"].alias("at"), F.concat(acc["found"], F.array(x["found"])).alias("found"))
        return bound(F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("found")), step), done)

    start = F.struct(F.lit(0).alias("at"), F.slice(F.array(none), 1, 0).alias("found"))
    found = bound(rows, lambda r: F.aggregate(runs(r), start, run, lambda acc: F.flatten(acc["found"])))
    empty = F.expr("cast(array() as array<struct<start: int, rank: int, end: int, kind: string, value: string>>)")
    rank = [k for k, *_ in (*BASE, OPAQUE)].index(kind)
    shaped = F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"), F.lit(kind).alias("kind"), x["value"].alias("value")))
    return F.when(F.regexp_like(text, F.lit(pattern)), shaped).otherwise(empty)


def candidates(docs: DataFrame) -> DataFrame:
    """Adds _base and _more: spans of the base kinds, in order; and opaque words that no base span touches."""
    text = F.coalesce(F.col("text"), F.lit(""))
    mixed = lambda v: F.regexp_like(v, F.lit("[0-9]")) & F.regexp_like(v, F.lit("[A-Z]")) & F.regexp_like(v, F.lit("[a-z]")) & ~F.regexp_like(v, F.lit("/.*/"))
    rows = docs.withColumn("_base", F.array_sort(F.concat(*(spans(text, *b) for b in BASE)))).withColumn("_more", spans(text, *OPAQUE))
    apart = F.filter("_more", lambda x: mixed(x["value"]) & ~F.exists("_base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    return rows.withColumn("_more", apart)


def has_candidate(text: Column) -> Column:
    """Whether a text holds a match of any pattern, long enough or not."""
    return functools.reduce(Column.__or__, (F.regexp_like(text, F.lit(p)) for _, p, *_ in (*BASE, OPAQUE)))


def scan_secrets(work: Workspace, docs: DataFrame, owner: str = "source", repository: tuple[str, ...] = ("source", "lang"), keep_text: bool = False) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_copied, all_spans): the secrets of every row.

    A candidate's hash is counted over the whole corpus by distinct owners and repositories (`source`, and `source` with `lang`: a table of
    files would name its own). A value is live-looking if it has at most MOST_OWNERS owners, MOST_REPOSITORIES repositories and
    no placeholder word; otherwise it is a copied example. Base spans always stay; opaque words become spans only if live-looking.
    n_owned and n_copied count all candidates so judged. Null and empty texts have no spans; rows with equal ids or texts are
    scanned each; an empty table gives an empty result. Only documents with candidates are shuffled, hashes pre-aggregated."""
    keep = docs.columns if keep_text else ["doc_id"]
    rows = candidates(docs.select("*", F.col(owner).alias("_owner"), F.xxhash64(*repository).alias("_repository")))
    rows = work.put(rows.select(F.monotonically_increasing_id().alias("_row"), *keep, "_owner", "_repository", "_base", "_more"), "found")
    each = rows.where(F.size("_base") + F.size("_more") > 0).select("_row", "_owner", "_repository", F.explode(F.concat("_base", "_more")).alias("x"))
    each = each.select("_row", "_owner", "_repository", F.sha2(F.col("x.value"), 256).alias("hash"), F.regexp_like("x.value", F.lit(PLACEHOLDER)).alias("shown"), "x")
    use = each.groupBy("hash").agg(F.count_distinct("_owner").alias("owners"), F.count_distinct("_repository").alias("repositories"))
    use = work.put(use, "use")  # written, so that both sides of the join are plain shuffles and a value copied everywhere can be split
    live = (F.col("owners") <= MOST_OWNERS) & (F.col("repositories") <= MOST_REPOSITORIES) & ~F.col("shown")
    judged = each.join(use, "hash").select("_row", "x", live.alias("live"))
    marks = judged.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("x.start", "x.rank", "x.end", "x.kind", "live"))).alias("_marks"))  # of one document
    none = F.expr("cast(array() as array<struct<start: int, rank: int, end: int, kind: string, live: boolean>>)")
    out = rows.select("_row", *keep).join(marks, "_row", "left").withColumn("_marks", F.coalesce("_marks", none))
    base = F.filter("_marks", lambda x: x["kind"] != OPAQUE[0])
    every = F.filter("_marks", lambda x: (x["kind"] != OPAQUE[0]) | x["live"])
    line = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("_marks", lambda x: x["kind"] == kind)).cast("long")
    return out.select(
        *keep, *(count(k).alias(f"n_{k}") for k, *_ in BASE), F.sha2(line(base), 256).alias("base_sha256"), line(every).alias("spans"),
        F.size(F.filter("_marks", lambda x: x["live"])).cast("long").alias("n_owned"), F.size(F.filter("_marks", lambda x: ~x["live"])).cast("long").alias("n_copied"), every.alias("all_spans"),
    )


def redact(text: Column, found: Column, mask: str = "[SECRET]") -> Column:
    """The text with every span, overlapping ones as one, replaced by `mask`. Spans are sorted by start."""
    none = F.expr("cast(array() as array<string>)")

    def step(acc: Column, x: Column) -> Column:
        piece = F.array(F.substring(acc["part"], acc["at"] - acc["from"] + 1, x["start"] - acc["at"]), F.lit(mask))
        out = F.when(x["start"] >= acc["at"], piece).otherwise(none)
        return F.struct(acc["part"].alias("part"), acc["from"].alias("from"), F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], out).alias("out"))

    def run(acc: Column, part: Column) -> Column:
        """The spans of a run are cut out of its own stretch of the text, as each cut counts characters from the beginning."""
        end = F.aggregate(part, acc["at"], lambda at, x: F.greatest(at, x["end"]))
        first = F.struct(F.substring(text, acc["at"] + 1, end - acc["at"]).alias("part"), acc["at"].alias("from"), acc["at"].alias("at"), none.alias("out"))
        return bound(F.aggregate(part, first, step), lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(x["out"], ""))).alias("out")))

    start = F.struct(F.lit(0).alias("at"), none.alias("out"))
    finish = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text)))
    return bound(found, lambda f: F.aggregate(runs(f), start, run, finish))
