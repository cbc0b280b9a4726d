"""Secret scans with multipart credential linking, in DataFrame functions only.

Base kinds are found by pattern: assignments of a secret, access identifiers and
long hexadecimal runs. Weak kinds, a 40-character token and an endpoint address,
say nothing alone; they are reported only when a complementary part lies within
a scope of SCOPE characters: a token near an access identifier, an endpoint near
an access identifier or an assignment. The parts meet in an interval join: both
sides are cut into buckets of a scope's length, the strong side is entered in its
own and the neighbouring buckets, and the distance decides, so a text with many
parts costs what lies near each other and not all pairs.

Patterns give the texts of matches and of the gaps between them; running sums of
their lengths give the places, in code points.

Defined results: a null text is empty; repeated rows are scanned each, also
with null or equal ids; an empty table gives an empty result; only the key of the
input is returned, so other columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialised, prepare, table

SCOPE = 256
BROADCAST_ROWS = 200_000
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Kind, pattern, base kind or not; in the order of reports. The minimum
#: lengths of access and hex are part of their patterns: runs of one class are
#: found whole or not at all. That of assign is tested on what is found, as a
#: short one hides what it covers.
KINDS = (
    ("assign", ASSIGN, True),
    ("access", r"AKIA[A-Z0-9]{16,}", True),
    ("hex", r"[0-9a-f]{24,}", True),
    ("token", r"(?<![A-Za-z0-9/+=])[A-Za-z0-9/+]{40}(?![A-Za-z0-9/+=])", False),
    ("endpoint", r"""(?i)https?://[^\x20\x09-\x0D"'<>]+""", False),
)
COMPLEMENTS = {"token": ("access",), "endpoint": ("access", "assign")}


def _pieces(text: Column, kind: str, pattern: str) -> Column:
    """(gap before, length, kept) of each match, in order."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    kept = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(2)), lambda g: F.length(g) >= 6) if kind == "assign" else F.transform(found, lambda m: F.lit(True))
    zipped = F.zip_with(F.zip_with(found, F.slice(gaps, 1, F.size(found)), lambda m, g: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"))), kept, lambda x, k: F.struct(x["gap"].alias("gap"), x["len"].alias("len"), k.alias("kept")))
    return F.when(F.size(found) > 0, zipped)


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> tuple[DataFrame, DataFrame]:
    """(rows: _row and key of each input row, spans: _row, ord, kind, base,
    start, end). Ordinal and kind as in KINDS; weak ones only where linked."""
    prepare(docs.sparkSession)
    clean = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))
    rows = materialised(clean.select(F.monotonically_increasing_id().alias("_row"), "_key", *[_pieces(F.col("_text"), k, p).alias(f"_{k}") for k, p, _ in KINDS]))
    lists = F.array(*[F.struct(F.lit(i).alias("ord"), F.col(f"_{k}").alias("found")) for i, (k, _, _) in enumerate(KINDS)])
    each = rows.select("_row", F.explode(F.filter(lists, lambda x: x["found"].isNotNull())).alias("x")).select("_row", "x.ord", F.posexplode("x.found").alias("n", "m"))
    until = Window.partitionBy("_row", "ord").orderBy("n")
    end = F.sum(F.col("m.gap") + F.col("m.len")).over(until)
    names, base = F.array(*[F.lit(k) for k, _, _ in KINDS]), F.array(*[F.lit(b) for _, _, b in KINDS])
    placed = each.withColumn("end", end).where("m.kept").select("_row", "ord", F.get(names, F.col("ord")).alias("kind"), F.get(base, F.col("ord")).alias("base"), (F.col("end") - F.col("m.len")).alias("start"), "end")
    strong, weak = placed.where("base"), placed.where("not base")
    order = {k: i for i, (k, _, _) in enumerate(KINDS)}
    wants = F.create_map(*[c for k, v in COMPLEMENTS.items() for c in (F.lit(order[k]), F.array(*[F.lit(order[x]) for x in v]))])
    bucket = lambda c: F.floor(F.col(c) / scope)
    near = strong.where(F.col("ord").isin([order[x] for v in COMPLEMENTS.values() for x in v])).select("_row", F.col("ord").alias("o"), F.col("start").alias("s"), F.col("end").alias("e"), F.explode(F.sequence(bucket("start") - 1, bucket("end") + 1)).alias("b"))
    parts = weak.withColumn("b", F.explode(F.sequence(bucket("start"), bucket("end"))))
    meets = (parts["_row"] == near["_row"]) & (parts["b"] == near["b"]) & (near["s"] <= parts["end"] + scope) & (parts["start"] <= near["e"] + scope) & F.array_contains(wants[parts["ord"]], near["o"])
    linked = parts.join(near, meets, "left_semi").drop("b").distinct()
    return rows.select("_row", "_key"), strong.unionByName(linked)


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def report(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row a row of ``docs``: key, counts of base kinds (n_assign, n_access,
    n_hex), and base_spans and spans: arrays of (start, ord, kind, end)."""
    rows, spans = scan(docs, key, text, scope)
    one = F.struct("start", "ord", "kind", "end", "base")
    by = spans.groupBy("_row").agg(F.sort_array(F.collect_list(one)).alias("spans"))
    none = F.array().cast("array<struct<start:bigint,ord:int,kind:string,end:bigint,base:boolean>>")
    full = rows.join(by, "_row", "left").withColumn("spans", F.coalesce("spans", none))
    full = full.withColumn("base_spans", F.filter("spans", lambda x: x["base"]))
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return full.select(F.col("_key").alias(key), *[count(k) for k, _, b in KINDS if b], "base_spans", "spans")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each stretch that spans cover replaced by ``mark``."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).cast("bigint").alias("pos"))

    def step(a: Column, s: Column) -> Column:
        gap = F.when(s["start"] > a["pos"], F.substring(text, (a["pos"] + 1).cast("int"), (s["start"] - a["pos"]).cast("int"))).otherwise("")
        new = F.when(s["start"] >= a["pos"], F.lit(mark)).otherwise("")
        return F.struct(F.concat(a["out"], F.array(gap, new)).alias("out"), F.greatest(a["pos"], s["end"]).alias("pos"))

    return F.aggregate(spans, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["pos"] + 1).cast("int"), F.length(text))))


def without_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE) -> DataFrame:
    """``docs`` with every reported stretch replaced by a mark."""
    same = F.struct(F.col(key).alias("key"), F.xxhash64(text).alias("hash"))
    found = report(docs.select(same.alias("_same"), text), "_same", text, scope).where(F.size("spans") > 0)
    found = materialised(found.groupBy("_same").agg(F.first("spans").alias("__secret_spans")).select(F.col("_same.key").alias("__secret_k"), F.col("_same.hash").alias("__secret_h"), "__secret_spans"))
    few = found.count() <= BROADCAST_ROWS
    own = docs.withColumn("__secret_own", F.xxhash64(text))
    out = own.join(F.broadcast(found) if few else found, own[key].eqNullSafe(found["__secret_k"]) & (own["__secret_own"] == found["__secret_h"]), "left")
    return out.withColumn(text, F.when(F.col("__secret_spans").isNotNull(), redacted(F.col(text), F.col("__secret_spans"))).otherwise(F.col(text))).select(*docs.columns)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 6 over all of ``documents``."""
    out = report(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(F.col("base_spans")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
