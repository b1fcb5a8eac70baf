"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Method: every version of a text is addressed by its content (SHA-256, the
*blob*).  The ledger is a table that grows: one row for each scanned pair of
blob and rule version (``start`` null), one for each finding.  A scan

1. addresses all given rows, ``(row's id, blob)``, and stores that;
2. subtracts the ledger: only blobs that miss a rule version are read again,
   and only by the rules they miss; of equal texts one is scanned;
3. appends the new pairs and findings to the ledger;
4. joins the findings of the asked rule versions back to all rows that hold
   the blob.

A pair in the ledger carries its whole result, so a run that was killed leaves
a ledger that is right: what it lacks is scanned by the next run.

Positions of matches come from two linear scans, the matches and the pieces
between them, whose lengths are added up in a window over one text's matches.
Texts move once, with copies merged in the map tasks; when the ledger already
holds blobs, only one row of each blob that is due moves.  A blob that many
rows hold is salted when findings are joined back: blobs held by more than
``HOT_ROWS`` rows and by more than 1 / ``HOT_SHARE`` of all, so never more than
``HOT_SHARE``, are broadcast with their number of salts.

Defined cases
-------------
* null text: as an empty one, without findings; very long texts are scanned
  whole; positions count code points, ends are exclusive;
* matches of a rule are leftmost and do not overlap; those whose checked group
  is shorter than ``least`` are dropped afterwards, and what they covered is
  not searched again;
* repeated rows and ties of ids stay, each with its findings; a null id stays
  null; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from connrisk.llm.common import spread_scan, start
from connrisk.session import checkpoint_dir, reliable

HOT_ROWS, HOT_SHARE = 1_000, 10_000
LEDGER = "blob binary, kind string, version int, start long, end long"


@dataclass(frozen=True)
class Rule:
    """A pattern of one kind; group ``group`` of a match must hold ``least`` characters."""

    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1


def either_case(word: str) -> str:
    """A pattern for an ASCII word in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(either_case(w) for w in ("password", "passwd", "secret", "token")) + f"|{either_case('api')}_?{either_case('key')}"
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Fixed rules.  Runs of ``access`` and ``hex`` are maximal, so asking for their length in the pattern drops the same
#: matches as asking for it afterwards; for ``assign`` it would not.
BASE = (Rule("assign", 1, ASSIGN, 2, 8), Rule("access", 1, "AKIA[A-Z0-9]{12,}"), Rule("hex", 1, "[0-9a-f]{32,}"))
#: Spans beyond the base: heads of private key blocks.
MORE = (Rule("pem", 1, "-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),)


def blob_of(text: Column) -> Column:
    """The address of a text: SHA-256 of its bytes."""
    return F.unhex(F.sha2(F.coalesce(text.cast("binary"), F.lit(b"")), 256))


def _key(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def _matches(text: Column, rule: Rule) -> Column:
    """A marker that the rule was applied, then each match: its number, the
    characters before it since the last one, its own, and whether it holds."""
    matches = lambda group: F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(group))
    between = F.split(text, rule.pattern, -1)  # one piece more than matches
    pairs = F.zip_with(matches(0), between, lambda m, b: F.struct(m.alias("m"), F.char_length(b).alias("gap")))
    whole = F.filter(F.zip_with(pairs, matches(rule.group), lambda p, g: F.struct(
        p["gap"].cast("long").alias("gap"), F.char_length(p["m"]).cast("long").alias("width"), (F.char_length(g) >= rule.least).alias("holds"))),
        lambda p: p["width"].isNotNull())
    numbered = F.transform(whole, lambda p, i: F.struct(i.alias("i"), p["gap"].alias("gap"), p["width"].alias("width"), p["holds"].alias("holds")))
    marker = F.array(F.struct(F.lit(-1).alias("i"), F.lit(0).cast("long").alias("gap"), F.lit(0).cast("long").alias("width"), F.lit(True).alias("holds")))
    hits = F.when(text.rlike(rule.pattern), F.concat(marker, numbered)).otherwise(marker)
    return F.transform(hits, lambda p: F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"), p["i"].alias("i"),
                                                p["gap"].alias("gap"), p["width"].alias("width"), p["holds"].alias("holds")))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows for ``(blob, text, due)``; ``due`` names the rule versions that the blob misses."""
    none = F.slice(_matches(F.lit(""), rules[0]), 1, 0)
    rows = F.flatten(F.array(*[F.when(F.array_contains("due", _key(r)), _matches(F.col("text"), r)).otherwise(none) for r in rules]))
    found = blobs.select("blob", F.inline(rows))
    upto = Window.partitionBy("blob", "kind", "version").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("width")).over(upto)  # one text's matches
    placed = found.withColumn("stop", end).where("holds")
    real = F.col("i") >= 0
    return placed.select("blob", "kind", "version", F.when(real, F.col("stop") - F.col("width")).alias("start"), F.when(real, F.col("stop")).alias("end"))


def read_ledger(spark: SparkSession, folder: str) -> DataFrame | None:
    """The ledger's rows, None before the first scan."""
    try:
        return spark.read.schema(LEDGER).parquet(folder)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def addresses(documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``(id, blob)`` of every row, stored."""
    return reliable(spread_scan(documents.select(key, "text")).select(F.col(key).alias("id"), blob_of(F.col("text")).alias("blob")))


def due_blobs(paths: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame) -> DataFrame:
    """``(blob, id, due)``: each blob that misses rule versions, one of its rows, and what it misses."""
    wanted = F.array(*[F.lit(_key(r)) for r in rules])
    key = F.concat_ws("@", "kind", F.col("version").cast("string"))
    seen = ledger.where(F.col("start").isNull()).select("blob", key.alias("k")).where(F.col("k").isin([_key(r) for r in rules]))
    blobs = paths.groupBy("blob").agg(F.min("id").alias("id"))
    have = seen.groupBy("blob").agg(F.collect_set("k").alias("have"))  # at most one for each rule
    due = F.array_except(wanted, F.coalesce("have", F.array().cast("array<string>")))
    return blobs.join(have, "blob", "left").select("blob", "id", due.alias("due")).where(F.size("due") > 0)


def update_ledger(documents: DataFrame, paths: DataFrame, rules: tuple[Rule, ...], folder: str, key: str = "doc_id") -> DataFrame:
    """Scan what the ledger misses, append it, and return the whole ledger."""
    spark = documents.sparkSession
    ledger = read_ledger(spark, folder)
    rows = spread_scan(documents.select(key, "text")).select(
        F.col(key).alias("id"), F.coalesce("text", F.lit("")).alias("text"), blob_of(F.col("text")).alias("blob"))
    every = F.array(*[F.lit(_key(r)) for r in rules]).alias("due")
    if ledger is None:
        blobs = rows.groupBy("blob").agg(F.first("text").alias("text")).select("blob", "text", every)
    else:
        due = due_blobs(paths, rules, ledger).select(F.col("blob").alias("b"), F.col("id").alias("first_id"), "due")
        chosen = rows.join(due, (F.col("blob") == F.col("b")) & F.col("id").eqNullSafe(F.col("first_id")))
        blobs = chosen.groupBy("blob").agg(F.first("text").alias("text"), F.first("due").alias("due"))
    scan_blobs(blobs, rules).write.mode("append").parquet(folder)
    return read_ledger(spark, folder)


def join_back(paths: DataFrame, per_blob: DataFrame) -> DataFrame:
    """``paths`` with the columns of ``per_blob`` (one row a blob), null where
    there is none; rows of a hot blob are dealt over as many tasks as it needs."""
    counts = paths.groupBy("blob").agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    most = max(HOT_ROWS, total // HOT_SHARE)
    hot = reliable(counts.where(F.col("n") > most).select("blob", F.ceil(F.col("n") / most).cast("int").alias("salts")))
    salted = paths.join(F.broadcast(hot), "blob", "left").withColumn(  # at most HOT_SHARE rows of 36 bytes
        "salt", F.pmod(F.monotonically_increasing_id(), F.coalesce("salts", F.lit(1)))).drop("salts")
    dealt = per_blob.join(F.broadcast(hot), "blob", "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)).cast("long") - 1))).drop("salts")
    return salted.join(dealt, ["blob", "salt"], "left").drop("salt")


def new_ledger(spark: SparkSession) -> str:
    """A folder for a ledger of its own, beside the checkpoints."""
    return f"{checkpoint_dir(spark).rstrip('/')}/blob-ledger-{uuid.uuid4().hex}"


def scan(documents: DataFrame, rules: tuple[Rule, ...] = BASE + MORE, folder: str | None = None, key: str = "doc_id") -> DataFrame:
    """``(id, blob, spans)`` for every row of ``documents``: the findings of
    ``rules`` as ``array<struct<start, place, end, kind>>`` by start, then
    place of the kind in ``rules``.  The ledger in ``folder`` (a new one if
    none is given) is read and brought up to date."""
    spark = start(documents.sparkSession)
    paths = addresses(documents, key)
    ledger = update_ledger(documents, paths, rules, folder or new_ledger(spark), key)
    place = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(_key(r)), F.lit(i))])
    asked = ledger.where(F.col("start").isNotNull()).withColumn("place", place[F.concat_ws("@", "kind", F.col("version").cast("string"))])
    per_blob = asked.where(F.col("place").isNotNull()).distinct().groupBy("blob").agg(
        F.array_sort(F.collect_list(F.struct("start", "place", "end", "kind"))).alias("spans"))  # one text's findings
    return join_back(paths, per_blob)


def report(documents: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE, folder: str | None = None) -> DataFrame:
    """``(doc_id, n_assign, n_access, n_hex, base_sha256, spans, blob)`` for every row."""
    found = scan(documents, base + more, folder)
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,place:int,end:bigint,kind:string>>"))
    text = lambda column: F.concat_ws(",", F.transform(column, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    of = lambda rule: F.size(F.filter("all", lambda s: s["kind"] == rule.kind)).cast("long").alias(f"n_{rule.kind}")
    return found.select(F.col("id").alias("doc_id"), "blob", spans.alias("all")).select(
        "doc_id", *[of(r) for r in base],
        F.sha2(text(F.filter("all", lambda s: s["place"] < len(base))).cast("binary"), 256).alias("base_sha256"),
        text(F.col("all")).alias("spans"), F.lower(F.hex("blob")).alias("blob"))
